"""Suffix dedup against a count of every string."""

import hashlib
import random
from collections import Counter

import numpy as np
import pytest

from lotlens.llm import suffix_dedup as sd


def brute(texts, length):
    raws = [(t or "").encode() for t in texts]
    seen = Counter(r[i : i + length] for r in raws for i in range(len(r) - length + 1))
    out = []
    for r in raws:
        cover = bytearray(len(r))
        for i in range(len(r) - length + 1):
            if seen[r[i : i + length]] > 1:
                cover[i : i + length] = b"\1" * length
        kept = bytes(x for x, c in zip(r, cover) if not c)
        spans = sum(c and (k == 0 or not cover[k - 1]) for k, c in enumerate(cover))
        out.append((len(r), len(r) - len(kept), spans, hashlib.sha256(kept).hexdigest()))
    return out


def brute_text(texts, length):
    raws = [(t or "").encode() for t in texts]
    seen = Counter(r[i : i + length] for r in raws for i in range(len(r) - length + 1))
    gone = [{j for i in range(len(r) - length + 1) if seen[r[i : i + length]] > 1 for j in range(i, i + length)} for r in raws]
    return [bytes(x for j, x in enumerate(r) if j not in g).decode("utf-8", "ignore") for r, g in zip(raws, gone)]


def measured(spark, texts, **kw):
    docs = spark.createDataFrame([(i, t, 1) for i, t in enumerate(texts)], "doc_id bigint, text string, n_bytes int")
    rows = sd.measure(docs, **kw).orderBy("doc_id").collect()
    assert [r.passage_free_text for r in rows] == brute_text(texts, sd.PASSAGE)
    return [(r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in rows]


def corpus(seed=5):
    r = random.Random(seed)
    word = lambda: "".join(r.choices("abcdefghé", k=r.randint(1, 7)))
    text = lambda n: " ".join(word() for _ in range(n))
    passages = [text(r.randint(70, 220)) for _ in range(4)]
    out = [text(r.randint(1, 400)) for _ in range(40)]
    for _ in range(60):
        a = text(r.randint(0, 120))
        p = r.choice(passages)
        p = p[r.choice([0, 0, 5, 40]) : len(p) - r.choice([0, 0, 9])]
        out.append(a + r.choice([" ", "", "x"]) + p + r.choice(["", " " + text(90)]))
    out += [passages[0]] * 3 + ["a" * 1500, "ab" * 700, "é" * 500, "", None, "z" * 399, "z" * 400, "q" * 400]
    hub = text(130)  # a passage of more different surroundings than one bucket takes
    out += [text(r.randint(20, 90)) + hub + text(r.randint(20, 90)) for _ in range(130)]
    return out


def test_suffix_array():
    r = random.Random(1)
    for n in [0, 1, 2, 3, 4, 5, 6, 7, 30, 200]:
        for k in (1, 2, 5):
            s = np.array([r.randint(1, k) for _ in range(n)], np.int64)
            assert sd.suffix_array(s).tolist() == sorted(range(n), key=lambda i: s[i:].tolist())


def test_suffix_array_names_by_seven_bytes(monkeypatch):
    """Bytes that differ within seven symbols need no recursion; longer names, of more symbols, are still sorted by threes."""
    r, sort, calls = random.Random(4), sd.suffix_array, []
    monkeypatch.setattr(sd, "suffix_array", lambda s: calls.append(len(s)) or sort(s))
    for n in (2000, 2001, 2002):
        s = np.array([r.randint(1, 20) for _ in range(n)], np.int64)
        assert sd.suffix_array(s).tolist() == sorted(range(n), key=lambda i: s[i:].tolist())
    assert calls == [2000, 2001, 2002]
    s = np.array([r.randint(1, 600) for _ in range(50)] * 4, np.int64)
    assert sd.suffix_array(s).tolist() == sorted(range(200), key=lambda i: s[i:].tolist())


def test_pieces_hold_every_start_once_and_equal_strings_share_buckets(monkeypatch):
    monkeypatch.setattr(sd.tk, "CHUNK_BYTES", 300)  # grams are ranked alike across chunks
    r = random.Random(6)
    take = lambda n: bytes(r.choices(b"ab c", k=n))
    shared = take(150)
    docs = [take(r.choice([0, 5, 39, 40, 41, 900])) + shared * r.randint(0, 1) + take(r.choice([0, 3, 60])) for _ in range(60)]
    d, o = np.frombuffer(b"".join(docs), np.uint8), np.concatenate([[0], np.cumsum([len(x) for x in docs])])
    for block in (1, 3, 9):
        doc, lo, n, key, _ = sd.pieces(d, o, 40, block, 16)
        at = [(a, b + i, k) for a, b, c, k in zip(*(x.tolist() for x in (doc, lo, n, key)), strict=True) for i in range(c)]
        assert [x[:2] for x in at] == [(k, i) for k, x in enumerate(docs) for i in range(len(x) - 39)]
        assert len({(docs[a][b : b + 40], k) for a, b, k in at}) == len({docs[a][b : b + 40] for a, b, _ in at})


def test_measure_matches_brute_force(spark, monkeypatch):
    monkeypatch.setattr(sd, "MOST", 96)
    texts = corpus()
    assert measured(spark, texts) == brute(texts, 400)


@pytest.mark.parametrize("most", [4, 10_000])
def test_hot_and_calm_buckets_agree(spark, monkeypatch, most):
    monkeypatch.setattr(sd, "MOST", most)
    texts = corpus(8)[:160]
    assert measured(spark, texts) == brute(texts, 400)


def test_small_table(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    rows = sorted((r.doc_id, r.text) for r in docs.collect())
    got = [(r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in sd.measure(docs).orderBy("doc_id").collect()]
    assert got == brute([t for _, t in rows], 400)


def test_nulls_repeats_empty_and_clean(spark):
    long = "".join(random.Random(2).choices("abcdefg ", k=900))
    docs = spark.createDataFrame([(None, long), (1, long), (1, long), (2, None)], "doc_id bigint, text string")
    got = sorted((str(r.doc_id), r.n_removed, r.n_spans) for r in sd.measure(docs).collect())
    assert got == [("1", 900, 1), ("1", 900, 1), ("2", 0, 0), ("None", 900, 1)]
    assert sd.measure(docs.limit(0)).count() == 0
    assert sd.clean(docs).columns == ["doc_id", "text"] and sd.clean(docs).count() == 4


def test_columns_of_the_caller_come_back(spark):
    long = "".join(random.Random(2).choices("abcdefg ", k=900))
    names = ["k", "c", "rest", "ranges", "long", "key", "span", "kinds", "version", "lo", "n", "times", "at", "wanted", "doc_id", "n_chars"]
    docs = spark.createDataFrame([(*range(len(names)), t) for t in (long, long, "short", None)], ", ".join(f"{n} bigint" for n in names) + ", text string")
    got = sd.clean(docs)
    assert got.columns == docs.columns
    assert sorted((r.text, r.n_chars, *(r[n] for n in names[:-1])) for r in got.collect()) == sorted((t, len(t), *range(len(names) - 1)) for t in ("", "", "short", ""))
