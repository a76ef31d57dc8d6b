"""The whole pipeline against plain Python, stage by stage, and its stages on odd tables."""

import re
from collections import Counter, defaultdict

import corpus_pipeline
from lotlens.llm import pieces, quality_rules, suffix_dedup

from .test_near_dup import brute, grams
from .test_suffix_dedup import brute_text

PATH = "/root/testdata/sf0.001"


def rules(rows):
    """(doc_id, text) of the documents that stay, boilerplate lines removed."""
    normal = lambda line: re.sub(r"[\x20\x09-\x0D]", "", re.sub("[0-9]", "0", "".join(c.lower() if c.isascii() else c for c in line)))
    held, total = Counter(), Counter()
    for host, text in {(host or "", text or "") for _, text, host in rows}:
        total[host] += 1
        held.update({(host, n) for line in text.split("\n") if (n := normal(line))})
    everywhere = Counter()
    for (_, n), c in held.items():
        everywhere[n] += c
    least, share = quality_rules.MIN_DOCS, quality_rules.LINE_SHARE
    bad = {k for k, c in held.items() if c > least and c > share * total[k[0]] or everywhere[k[1]] > least and everywhere[k[1]] > share * sum(total.values())}
    out = []
    for doc_id, text, host in rows:
        words = re.findall(r"[^\x20\x09-\x0D]+", text or "")
        tri = Counter(tuple(words[i : i + 3]) for i in range(len(words) - 2))
        again = {i + k for i in range(len(words) - 2) if tri[tuple(words[i : i + 3])] > 1 for k in range(3)}
        if len(words) < 50 or 100 * len(again) > 50 * len(words):
            continue
        lines = text.split("\n")
        size = [len(normal(x).encode()) for x in lines]
        gone = [(host or "", normal(x)) in bad for x in lines]
        if sum(s for s, g in zip(size, gone) if g) > quality_rules.DEPLETED * sum(size):
            continue
        out.append((doc_id, "\n".join(x for x, g in zip(lines, gone) if not g)))
    return out


def near(rows):
    """The row of the smallest doc_id of each class."""
    rows = sorted(rows)
    classes = brute([t for _, t in rows])
    return [r for k, r in enumerate(rows) if classes[k][0] == k or not grams(r[1])]


def clean_of(rows, items):
    split = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", "".join(c.lower() if c.isascii() else c for c in t or ""))
    windows = defaultdict(set)
    for t in items:
        w = split(t)
        for p in range(max(1, len(w) - 9) if w else 0):
            windows[len(w[p : p + 10])].add(tuple(w[p : p + 10]))
    hit = lambda w: any(tuple(w[p : p + n]) in held for n, held in windows.items() for p in range(len(w) - n + 1))
    return [r for r in rows if not hit(split(r[1]))]


def test_pipeline_against_plain_python(spark):
    docs = [(r.doc_id, r.text, r.source) for r in spark.read.parquet(f"{PATH}/documents.parquet").collect()]
    items = [r.text for r in spark.read.parquet(f"{PATH}/benchmark.parquet").collect()]
    kept = rules(docs)
    single = near(kept)
    texts = brute_text([t for _, t in single], suffix_dedup.PASSAGE)
    want = clean_of([(i, t) for (i, _), t in zip(single, texts)], items)
    out = corpus_pipeline.run(spark, PATH)
    assert out.columns == ["doc_id", "n_pieces", "pieces", "lossless"]
    got = {r.doc_id: r.text for r in pieces.decode_pieces(out).collect()}
    assert got == dict(want) and 0 < len(got) < len(single) < len(kept) < len(docs)


def test_stages_on_odd_tables(spark):
    """Null ids and texts, repeated rows, an extra column of a clashing name, an empty table."""
    long = " ".join(f"word{i}" for i in range(90))
    other = " ".join(f"other{i}" for i in range(90))
    rows = [(None, long, None, "s", 1, 7), (1, other, "en", None, None, 7), (1, other, "en", None, None, 7), (2, None, None, None, None, 7), (3, "", "en", "s", 0, 7)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, lang string, source string, n_chars bigint, version int")
    keeps = [{None, 1}, {None, 1, 2, 3}, {None, 1, 2, 3}, {None, 1, 2, 3}, {None, 1, 2, 3}]
    for k, ((_, stage), ids) in enumerate(zip(corpus_pipeline.STAGES, keeps)):
        got = stage(spark, docs, PATH)
        if k < 4:
            assert got.columns == docs.columns and {r.version for r in got.collect()} == {7}
        assert {r.doc_id for r in got.collect()} == ids
        assert stage(spark, docs.limit(0), PATH).count() == 0
