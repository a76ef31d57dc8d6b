"""The other training-data operators: brute force, round trips, held-out accuracy and edge cases."""

import hashlib
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from lotlens.llm import chat_format, decontaminate, html_text, jaccard_join, near_dup, paragraph_dedup, pieces, quality_model, quality_rules, queries, url_filter
from lotlens.llm.cluster import cut
from lotlens.llm.graph import components

from ..oracle import connect, of_spark, of_sql

PATH = "/root/testdata/sf0.001"
EXTRA = "doc_id bigint, text string, lang string, source string, n_chars bigint, n_words int, kept string, version int, hit int"


def table(spark, texts, ids=None):
    ids = ids or list(range(len(texts)))
    return spark.createDataFrame([(i, t, None, "s" if t else None, None, 0, "x", 1, 2) for i, t in zip(ids, texts)], EXTRA)


@pytest.mark.parametrize("name", sorted(queries.SQL))
def test_query_matches_sql(spark, name):
    assert of_spark(queries.QUERIES[name](spark, PATH)) == of_sql(connect(PATH), queries.SQL[name])


EDGES = ["", None, "one", " \n\t\n ", "é" * 5000, "a\nb\na\nb", "x " * 30000, "same text here", "same text here", "ÄÖ 1_2", "\0 nul \u2581 mark"]


def test_edges_do_not_crash(spark):
    docs = table(spark, EDGES, [0, 1, 2, 3, 4, 5, 6, 7, 7, None, 9])
    items = spark.createDataFrame([(1, "same text here"), (2, None), (None, "one"), (3, "")], "item_id bigint, text string")
    assert {r.doc_id for r in decontaminate.measure(docs, items).filter("contaminated").collect()} == {7}
    assert decontaminate.clean(docs, items).count() == len(EDGES) - 2
    assert quality_rules.judge(docs).filter("NOT base_failed").count() == 0
    assert quality_rules.clean(docs).columns == docs.columns
    assert paragraph_dedup.measure(docs).count() == len(EDGES)
    m = quality_model.train(docs, spark.createDataFrame([], "doc_id bigint, quality int, toxic int"))
    assert {round(r.score, 3) for r in quality_model.score(docs, m).collect()} == {0.5}
    done = pieces.encode(docs)
    assert done.filter("NOT lossless").count() == 0
    assert sorted(map(str, (r.text for r in pieces.decode_pieces(done).collect()))) == sorted(t or "" for t in EDGES)
    for f in (lambda d: decontaminate.measure(d, items), quality_rules.judge, paragraph_dedup.measure, pieces.encode, quality_rules.clean):
        assert f(docs.limit(0)).count() == 0
    assert decontaminate.measure(docs, items.limit(0)).filter("contaminated").count() == 0


def test_winnowing_finds_every_shared_span(spark):
    rng = np.random.default_rng(1)
    words = [f"W{i}" for i in range(30)]
    texts = [" ".join(rng.choice(words, rng.integers(0, 60))) for _ in range(60)]
    items = [" ".join(rng.choice(words, n)) for n in (1, 2, 4, 9, 10, 11, 25)] + ["", None]
    texts += [f"{texts[k]} {items[6][:40]} {items[k % 5]}" for k in range(20)] + [f"a {items[6]} b", items[5].upper()]
    split = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (t or "").lower())
    wins = {}
    for i, t in enumerate(items):
        w = split(t)
        for p in range(max(1, len(w) - 9) if w else 0):
            wins.setdefault(tuple(w[p : p + 10]), set()).add(str(i))
    want = {}
    for d, t in enumerate(texts):
        w, cover, found = split(t), set(), set()
        for win, of in wins.items():
            for p in range(len(w) - len(win) + 1):
                if tuple(w[p : p + len(win)]) == win:
                    cover |= set(range(p, p + len(win)))
                    found |= of
        want[d] = (len(w), len(cover), len(found), hashlib.sha256(",".join(sorted(found)).encode()).hexdigest())
    bench = spark.createDataFrame(list(enumerate(items)), "item_id bigint, text string")
    got = {r.doc_id: (r.n_words, r.n_hit, r.n_items, r.items_sha256) for r in decontaminate.measure(table(spark, texts), bench).collect()}
    assert got == want and any(v[1] for v in want.values())


def test_decontamination_stays_native(spark):
    plan = queries.QUERIES["op1_decontamination"](spark, PATH)._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan and "Pandas" not in plan


def test_html(spark):
    m = html_text.default_model()
    held = html_text.labelled_pages(80, seed=77)
    assert sum(html_text.extract(p, m) == t for p, t in held) >= 76
    page = '<html><head><title>t</title><script>var a="</p>";</script></head><body><nav><ul><li><a href=/>x y</a></li></ul></nav><div class="ad">buy</div><article><h1>A &amp;amp;\n b</h1><p><b>One<br>two<p>Three</article><footer>&copy; me</footer>'
    assert html_text.extract(page, m) == "A &amp; b\nOne two\nThree"
    assert [html_text.extract(x, m) for x in (None, "", "<p", "<!-- x")] == ["", "", "", ""]
    rows = spark.createDataFrame([(1, None, None), (2, "u", page), (2, "u", page)], "page_id bigint, url string, html string")
    assert sorted(r.n_chars for r in html_text.extract_pages(rows).collect()) == [0, 23, 23]
    nodes = html_text.parse(page)
    one, pair = m.marginals(nodes)  # exact: against a sum over all labellings of a small page
    nodes = html_text.parse("<div><p>a</p><nav>b</nav></div>")
    phi, psi = m.potentials(nodes)
    from itertools import product
    from math import exp

    weight, hit = 0.0, [0.0] * len(nodes)
    for s in product((0, 1), repeat=len(nodes)):
        w = exp(sum(phi[k] * s[k] for k in range(len(nodes))) + sum(psi[k][s[k]] for k in range(1, len(nodes)) if s[k] == s[nodes[k].parent]))
        weight += w
        for k in range(len(nodes)):
            hit[k] += w * s[k]
    assert all(abs(a - b / weight) < 1e-9 for a, b in zip(m.marginals(nodes)[0], hit, strict=True))


def test_html_of_unseen_layouts():
    """Layouts and names that the training pages do not have; F1 over text blocks."""
    m = html_text.default_model()
    r = np.random.default_rng(5)
    words = lambda a, z: " ".join("".join(r.choice(list("abcdefghilmnorstu"), r.integers(2, 9))) for _ in range(r.integers(a, z)))
    say = lambda a=15, z=70: words(a, z).capitalize() + "."
    link = lambda: f"<a href='{words(1, 2)}'>{words(1, 3)}</a>"
    hits = missed = wrong = 0
    for k in range(90):
        title, body = words(3, 9), [say() for _ in range(r.integers(2, 7))]
        main, menu, note = "".join(f"<p>{x}</p>" for x in body), "".join(f"<li>{link()}</li>" for _ in range(6)), say(4, 12)
        page = [
            f"<center><font><b>{title}</b></font><hr>{main}</center><ul>{menu}</ul>",
            f"<div class=w1><div class=w2><dl><dt>{link()}<dd>{link()}</dl></div><div class=w3><h1>{title}</h1>{main}</div></div><div class=w4>{note} {link()} {link()}</div>",
            f"<body><main><header><h1>{title}</h1></header><section>{main}</section><div id=disqus_thread><p>{note}</p></div></main><nav>{menu}</nav></body>",
            f"<table width=100%><tr><td>{'<br>'.join(link() for _ in range(5))}<td><h2>{title}</h2>{main}<tr><td colspan=2>&copy; 2020 {words(1, 4)}</table>",
            f"<script src=/a/>var x = 1;</script><div role=banner>{link()}{link()}</div><div role=main><h1>{title}</h1>{main}</div><div role=contentinfo>&copy; {words(2, 5)}</div>",
            f"<div><h1>{title}</h1>{'<br><br>'.join(body)}</div><form><input><button>{words(1, 2)}</button></form>",
        ][k % 6]
        want = [title, " ".join(body)] if k % 6 == 5 else [title, *body]
        got = html_text.extract(page, m).split("\n")
        hits += sum(x in got for x in want)
        missed += sum(x not in got for x in want)
        wrong += sum(x not in want for x in got)
        assert "var x" not in "\n".join(got) and any(x in got for x in want[1:]), page
    f1 = 2 * hits / (2 * hits + missed + wrong)
    print(f"F1 {f1:.3f}")
    assert f1 > 0.85, f1


def test_html_closing_and_edges(spark):
    m = html_text.default_model()
    long = "Some words of a long text that goes on. " * 10
    for page in ("<script src=/js/>var a=1;</script><article><p>Hello you.</p></article>", '<script src="a"/>var a=1;</script><article><p>Hello you.</p></article>', "<article><div class=x/><p>Hello you.</p></article>"):
        assert html_text.extract(page, m) == "Hello you."
    assert long.strip() in html_text.extract(f"<div><div><p>{long}</p></div><div><a href=/>a</a> <a href=/>b</a></div></div>", m)
    assert "Great" not in html_text.extract(f'<article><h1>T t</h1><p>{long}</p></article><div id="disqus_thread"><p>Great post!</p></div>', m)
    assert "News" not in html_text.extract(f"<table><tr><td><a href=/>Home</a> <a href=/n>News</a></td><td><p>{long}</p></td></tr></table>", m)
    pages = [(None, "u", f"<article><p>{long * 2000}</p></article>"), (2, None, "<p>" * 3000 + "x"), (3, "u", "<div>" * 3000), (3, "u", "")]
    rows = spark.createDataFrame([(*p, "t", 7) for p in pages], "page_id bigint, url string, html string, text string, n_chars bigint")
    got = {(r.page_id, r.url): r.n_chars for r in html_text.extract_pages(rows.limit(3)).collect()}
    assert got[None, "u"] == len(" ".join((long * 2000).split())) and got[3, "u"] == 0
    assert html_text.extract_pages(rows.limit(0)).count() == 0


def test_chat_paths_and_round_trip(spark):
    rows = [("t", "a", None, 1, "user", "q ### </turn> \\ :", 0.0), ("t", "b", "a", 2, "assistant", "bad", 1.0), ("t", "c", "a", 2, "assistant", "good", 5.0), ("t", "d", "c", 3, "us:er", None, None), ("u", "x", "gone", 1, None, "root", 0.0)]
    m = spark.createDataFrame(rows, "tree string, node string, parent string, place int, role string, text string, score double")
    got = {(r.tree, r["rank"]): chat_format.parse(r.formatted) for r in chat_format.format_trees(m).collect()}
    assert got[("t", 1)] == [("user", "q ### </turn> \\ :"), ("assistant", "good"), ("us:er", "")] and got[("t", 2)][1] == ("assistant", "bad")
    assert chat_format.format_trees(m, branches=1).count() == 2 and chat_format.format_trees(m.limit(0)).count() == 0
    long = spark.createDataFrame([(1, i, "user", f"m{i}") for i in range(300)] + [(None, None, None, None), (1, 3, "user", "m3")], "conv_id bigint, turn bigint, role string, text string")
    done = {r.tree: chat_format.parse(r.formatted) for r in chat_format.format_trees(chat_format.linear(long)).collect()}
    assert len(done["c1"]) == 301 and done["c1"][:5] == [("user", f"m{i}") for i in (0, 1, 2, 3, 3)] and done["null"] == [("", "")]


def test_chat_of_any_key(spark):
    """Text keys, a key that reads null, clashing columns, an empty table."""
    rows = [("null", 0, "user", "a", 1), (None, 0, "user", "b", 2), ("x/1", 1, "assistant", "c", 3), ("x/1", 0, None, None, 4)]
    t = spark.createDataFrame(rows, "conv_id string, turn bigint, role string, text string, tree int")
    got = {r.conv_id: (r.n_turns, r.loss_chars) for r in chat_format.digests(t).collect()}
    assert got == {"null": (1, 0), None: (1, 0), "x/1": (2, 1)} and chat_format.digests(t.limit(0)).count() == 0


def test_ranked_branches_against_brute_force(spark):
    rng = np.random.default_rng(8)
    rows, paths = [], []
    for t in range(12):
        parent = {0: None}
        for k in range(1, int(rng.integers(2, 25))):
            parent[k] = int(rng.integers(0, k))
        score = {k: float(rng.integers(0, 9)) for k in parent}
        depth = {}
        for k, up in parent.items():
            depth[k] = 0 if up is None else depth[up] + 1
            rows.append((f"t{t}", f"{t}-{k:02d}", None if up is None else f"{t}-{up:02d}", depth[k], "user", f"m{k}", score[k]))
        for leaf in set(parent) - set(parent.values()):
            path = [leaf]
            while parent[path[-1]] is not None:
                path.append(parent[path[-1]])
            paths.append((f"t{t}", f"{t}-{leaf:02d}", np.mean([score[k] for k in path]), [("user", f"m{k}") for k in reversed(path)]))
    want = {}
    for t, leaf, mean, turns in paths:
        rank = 1 + sum(u == t and (-m, other) < (-mean, leaf) for u, other, m, _ in paths)
        if rank <= 3:
            want[t, rank] = turns
    m = spark.createDataFrame(rows, "tree string, node string, parent string, place int, role string, text string, score double")
    assert {(r.tree, r["rank"]): chat_format.parse(r.formatted) for r in chat_format.format_trees(m, branches=3).collect()} == want


def test_quality_fit_against_plain_loops(monkeypatch):
    """One epoch of the vectorised fit is the textbook update, feature by feature."""
    from math import exp, sqrt

    monkeypatch.setattr(quality_model, "EPOCHS", 1)
    rng = np.random.default_rng(1)
    rows = [(np.sort(rng.choice(40, 6, replace=False)).astype(np.int32), rng.random(6).astype(np.float32), int(k % 2)) for k in range(40)]
    got = quality_model.fit(rows)
    r = np.random.RandomState(quality_model.SEED)
    v = r.normal(0, 0.05, (quality_model.SIZE, quality_model.FACTORS)).astype(np.float32).astype(float)
    w, bias, gw, gv, gb = np.zeros(40), 0.0, np.full(40, 1e-6), np.full((40, quality_model.FACTORS), 1e-6), 1e-6
    order = r.permutation(len(rows))
    for b in range(0, len(order), quality_model.BATCH):
        some = [rows[i] for i in order[b : b + quality_model.BATCH]]
        dw, dv, db = {}, {}, 0.0
        for ids, x, y in some:
            z = bias + sum(w[i] * a for i, a in zip(ids, x)) + sum(v[i] @ v[j] * a * c for p, (i, a) in enumerate(zip(ids, x)) for j, c in list(zip(ids, x))[:p])
            miss = (1 / (1 + exp(-z)) - y) / len(some)
            db += miss
            total = sum(v[i] * a for i, a in zip(ids, x))
            for i, a in zip(ids, x):
                dw[i] = dw.get(i, 0.0) + miss * a
                dv[i] = dv.get(i, 0.0) + miss * a * (total - v[i] * a)
        for i in dw:
            d, e = dw[i] + 1e-5 * w[i], dv[i] + 1e-4 * v[i]
            gw[i] += d * d
            gv[i] += e * e
            w[i] -= quality_model.RATE * d / sqrt(gw[i])
            v[i] -= quality_model.RATE * e / np.sqrt(gv[i])
        gb += db * db
        bias -= quality_model.RATE * db / sqrt(gb)
    assert np.allclose(got.linear[:40], w, atol=2e-3) and np.allclose(got.factors[:40], v[:40], atol=2e-3) and abs(got.bias - bias) < 2e-3


def test_labels_twice_and_repeated_rows(spark):
    docs = table(spark, ["good text here", "bad # text", "good text here", None, "x " * 50000], [1, 2, 1, 4, 5])
    labels = spark.createDataFrame([(1, 1, 0), (1, 0, 0), (2, 0, 0), (4, 1, 1), (None, 1, 0), (5, None, 0)], "doc_id bigint, quality int, toxic int")
    m = quality_model.train(docs, labels)
    assert quality_model.score(docs, m).count() == 5 and quality_model.score(docs.limit(0), m).count() == 0


def test_cascade_is_exact(spark):
    keys = [f"h{i}.example.com" for i in range(4000)]
    universe = spark.createDataFrame([(k,) for k in keys], "key string")
    listed = spark.createDataFrame([(k,) for k in keys[::7]] + [("elsewhere.com",)], "key string")
    c = url_filter.build(universe, listed)
    h = universe.select("key", F.xxhash64("key").alias("h1"), F.xxhash64("key", F.lit(17)).alias("h2")).collect()
    a = lambda n: np.array([r[n] for r in h], np.int64).view(np.uint64)
    assert len(c.levels) > 1 and {r.key for r, x in zip(h, c.listed(a("h1"), a("h2"))) if x} == set(keys[::7])
    odd = spark.createDataFrame([(1, None), (2, "no scheme"), (3, "HTTP://A.Spam-Farm.example.org/x?y"), (4, "x://h")], "page_id bigint, url string")
    got = {r.page_id: (r.host, r.path, r.verdict) for r in url_filter.judge(odd, spark.createDataFrame([("spam-farm.example.org",)], "key string")).collect()}
    assert got == {1: ("", "", "allow"), 2: ("", "", "allow"), 3: ("a.spam-farm.example.org", "/x", "block"), 4: ("h", "", "allow")}
    assert url_filter.judge(odd.limit(0), listed).count() == 0


def test_quality_held_out(spark):
    path = "/root/testdata/sf0.01"
    got = {r.doc_id: r for r in quality_model.query(spark, path).collect()}
    labels = {r.doc_id: r.quality for r in spark.read.parquet(f"{path}/labels.parquet").collect()}
    assert all(r.held_out == (zlib.crc32(str(i).encode()) % 3 == 1) for i, r in got.items())
    held = [(got[i].score, y) for i, y in labels.items() if got[i].held_out]
    pos, neg = [s for s, y in held if y], [s for s, y in held if not y]
    assert sum((p > n) + 0.5 * (p == n) for p in pos for n in neg) / (len(pos) * len(neg)) > 0.9
    m = quality_model.train(spark.read.parquet(f"{path}/documents.parquet"), spark.read.parquet(f"{path}/labels.parquet"))
    ids, x = np.array([1, 5, 9]), np.array([0.5, 1.0, 2.0])
    pairs = sum(m.factors[ids[i]] @ m.factors[ids[j]] * x[i] * x[j] for i in range(3) for j in range(i))
    assert abs(m.logits(ids, x, np.array([0, 3]))[0] - (m.bias + m.linear[ids] @ x + pairs)) < 1e-4


def test_pieces_equal_the_library_without_dropout(spark):
    from sentencepiece import SentencePieceProcessor

    p = pieces.load(open(pieces.MODEL, "rb").read())
    sp = SentencePieceProcessor(model_file=pieces.MODEL)
    texts = [r.text for r in spark.read.parquet(f"{PATH}/documents.parquet").collect()] + ["", "  a  b\n\n c ", "日本語テキスト" * 30, "http://" + "abc/" * 40]
    keys = np.arange(len(texts), dtype=np.uint64)
    ids, off = pieces.encode_texts(p, texts, keys, rate=0.0)
    assert all(ids[off[k] : off[k + 1]].tolist() == sp.encode(t) for k, t in enumerate(texts))
    a, b = (pieces.encode_texts(p, texts, keys, seed=s)[0] for s in (1, 1))
    assert a.tolist() == b.tolist() != pieces.encode_texts(p, texts, keys, seed=2)[0].tolist()
    some = [t for t in texts[0].split() if t][:60]
    k = pieces.tk.mix(np.arange(len(some), dtype=np.uint64))
    flat, n, rows = pieces._rows(p, some, k, 0.3)
    lists = dict(zip(rows.tolist(), np.split(flat, np.cumsum(n)[:-1]), strict=True))
    assert all(lists[i].tolist() == pieces._agenda(p, t, k[i], 0.3) for i, t in enumerate(some))


def test_long_chunks_in_seconds():
    import time

    p = pieces.load(open(pieces.MODEL, "rb").read())
    rng = np.random.default_rng(3)
    text = "".join(rng.choice(list("abcdefghilmnorstué"), 1_000_000))
    began = time.time()
    ids, at = pieces.encode_texts(p, [text], np.zeros(1, np.uint64), rate=0.1)
    assert pieces.decode(p, ids.tolist()) == text and time.time() - began < 60
    i, j, e = (np.array([x, x + (1 << 21), x + (1 << 30)]) for x in (5, 9, 30))
    assert len(set(pieces._places(i, j, e).tolist())) == 3
    assert pieces._mixed(12345678901234567) == int(pieces.tk.mix(np.array([12345678901234567], np.uint64))[0])


def test_every_occurrence_has_skips_of_its_own():
    p = pieces.load(open(pieces.MODEL, "rb").read())
    long = "Donaudampfschifffahrtsgesellschaftskapitänsmützenabzeichen"
    texts = [" ".join(["Vergabeunterlagen", "the", long[:45], "日本語"] * 150), long + " a\u2581b", None, ""]
    keys = pieces.tk.mix(np.arange(len(texts), dtype=np.uint64))
    for rate in (0.1, 0.6):
        ids, at = pieces.encode_texts(p, texts, keys, rate=rate)
        places = np.arange(600, dtype=np.uint64) + np.uint64(pieces.SEED)
        own = pieces.tk.mix(keys[0] + pieces.tk.mix(places))
        cut_up = [pieces._agenda(p, "\u2581" + w, k, rate) for w, k in zip(texts[0].split(" "), own, strict=True)]
        assert ids[: at[1]].tolist() == [x for c in cut_up for x in c]
        assert len({tuple(c) for c in cut_up[::4]}) > 5
        assert [pieces.decode(p, ids[at[k] : at[k + 1]].tolist()) for k in range(4)] == [t or "" for t in texts]


def paragraphs(texts):
    """(document, words, bytes from, to) of every paragraph, word by word."""
    out = []
    for d, t in enumerate(texts):
        raw = (t or "").encode()
        data, off = np.frombuffer(raw, np.uint8), np.array([0, len(raw)])
        spans = [m.span() for m in re.finditer(rb"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", raw.lower())]
        if not spans:
            continue
        words = paragraph_dedup.tk.word_hashes(data, off)[0]
        mix = paragraph_dedup.tk.mix
        gram = [int(x) for x in mix(words + mix(np.append(words[1:], np.uint64(0))))]
        n, reach = len(spans), paragraph_dedup.REACH
        at = [0]
        for i in range(reach + 1, n - reach):
            if all(gram[j] > gram[i] for j in range(i - reach, i)) and all(gram[j] >= gram[i] for j in range(i + 1, i + reach + 1)):
                at.append(i)
        at = [j for i, e in zip(at, [*at[1:], n]) for j in range(i, e, paragraph_dedup.LONGEST)]
        for i, e in zip(at, [*at[1:], n]):
            out.append((d, [raw[x:y].lower() for x, y in spans[i:e]], spans[i][0], spans[e][0] if e < n else spans[n - 1][1]))
    return out


def test_paragraphs_match_brute_force(spark):
    rng = np.random.default_rng(2)
    words = [f"W{i}" for i in range(300)]
    base = [list(rng.choice(words, rng.integers(15, 90))) for _ in range(14)]
    texts = []
    for _ in range(60):
        parts = []
        for _ in range(rng.integers(0, 4)):
            w = list(base[rng.integers(14)])
            for _ in range(rng.integers(0, 3)):
                w[rng.integers(len(w))] = str(rng.choice(words))
            parts.append(" ".join(w))
        texts.append("-- " + rng.choice(["\n", ", é "]).join(parts) + ".")
    texts += ["a a a " * 60, "a a a " * 60 + "b", "one", "One!", "", None]
    items = [(d, {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))}, lo, hi) for d, w, lo, hi in paragraphs(texts)]
    root = list(range(len(items)))

    def find(k):
        while root[k] != k:
            k = root[k]
        return k

    linked = set()
    for a in range(len(items)):
        for b in range(a):
            i = len(items[a][1] & items[b][1])
            if i >= 0.8 * (len(items[a][1]) + len(items[b][1]) - i) - 1e-12:
                x, y = sorted((find(a), find(b)))
                root[y] = x
                linked |= {a, b}
    raws = [(t or "").encode() for t in texts]
    want = {d: [0, 0, set(), r] for d, r in enumerate(raws)}
    for k in reversed(range(len(items))):
        d, _, lo, hi = items[k]
        if k in linked:
            want[d][0] += 1
            want[d][2].add(items[find(k)][0])
            if find(k) != k:
                want[d][1] += 1
                want[d][3] = want[d][3][:lo] + want[d][3][hi:]
    want = {d: [n, m, sorted(c), r.decode()] for d, (n, m, c, r) in want.items()}
    got = {r.doc_id: [r.n_repeated, r.n_removed, r.class_ids, r.text] for r in paragraph_dedup.measure(table(spark, texts)).collect()}
    assert got == want and sum(x[1] for x in want.values()) > 50
    assert {r.doc_id: r.text for r in paragraph_dedup.clean(table(spark, texts)).collect()} == {d: x[3] for d, x in want.items()}


@pytest.mark.parametrize("levels", [1, 3])
def test_paragraphs_of_hot_bands_match_brute_force(spark, monkeypatch, levels):
    monkeypatch.setattr(paragraph_dedup, "HOT", 2)
    monkeypatch.setattr(paragraph_dedup, "LEVELS", levels)
    test_paragraphs_match_brute_force(spark)


def test_band_of_a_common_phrase_is_not_compared_in_all_pairs(spark, monkeypatch):
    """Rows of members that are compared: as many as a few for each member, whatever a band holds."""
    rng = np.random.default_rng(11)
    words = lambda n: [f"w{x}" for x in rng.integers(0, 1 << 40, n)]
    phrase = words(11)
    texts = [" ".join(phrase + words(5)) for _ in range(1200)]  # one paragraph each, 7 of 12 shingles in common
    texts += [" ".join(phrase[:9] + [f"u{k}"]) for k in range(300)]  # 5 of 6 shingles in common
    rows, compare = spark.sparkContext.accumulator(0), near_dup._compare

    def counted(*args):
        run = compare(*args)

        def each(batches):
            def told():
                for b in batches:
                    rows.add(b.num_rows)
                    yield b

            yield from run(told())

        return each

    monkeypatch.setattr(near_dup, "_compare", counted)
    got = paragraph_dedup.measure(table(spark, texts)).collect()
    assert all(r.n_repeated == 0 for r in got) and rows.value <= 2 * len(got)


def test_passages_are_caught_within_and_across_lines(spark):
    rng = np.random.default_rng(7)
    text = lambda n: " ".join("".join(rng.choice(list("abcdefghij"), rng.integers(2, 8))) for _ in range(n))
    passages = [text(rng.integers(51, 75)) for _ in range(60)]
    passages = [p if k % 2 else p.replace(" ", "\n", 3) for k, p in enumerate(passages)]
    texts = [f"{text(rng.integers(20, 200))}{rng.choice([' ', chr(10), ', '])}{p} {text(rng.integers(20, 90))}" for p in passages for _ in range(3)]
    texts += [text(120) for _ in range(40)]
    got = {r.doc_id: r for r in paragraph_dedup.measure(table(spark, texts)).collect()}
    assert np.mean([got[d].n_repeated > 0 for d in range(180)]) > 0.95
    assert np.mean([sum(p in got[3 * k + i].text for i in range(3)) <= 1 for k, p in enumerate(passages)]) > 0.95
    assert all(got[d].text == texts[d] for d in range(180, 220))


def test_columns_of_the_caller_come_back(spark):
    """Names and values that the operators use themselves, of every operator that cleans rows."""
    names = "version rest lines boiler removed ranges spans hit items kept cleaned lo hi one two bands digest host grams root node row_key stays times n_words band hub".split()
    a, b = " ".join(f"w{i}" for i in range(80)), " ".join(f"v{i}" for i in range(80))
    rows = [(1, "s", None, *range(len(names)), a), (2, "s", 5, *range(len(names)), a + " tail"), (3, None, 5, *range(len(names)), b), (4, "s", 0, *range(len(names)), None)]
    docs = spark.createDataFrame(rows, "doc_id bigint, source string, n_chars bigint, " + ", ".join(f"{n} bigint" for n in names) + ", text string")
    items = spark.createDataFrame([(1, b)], "item_id bigint, text string")
    for f, ids in ((lambda d: decontaminate.clean(d, items), {1, 2, 4}), (quality_rules.clean, {1, 2, 3}), (paragraph_dedup.clean, {1, 2, 3, 4}), (jaccard_join.keep_one, {1, 3, 4}), (jaccard_join.keep_row, {1, 3, 4})):
        got = f(docs)
        assert got.columns == docs.columns
        assert {r.doc_id: [r[n] for n in names] for r in got.collect()} == {i: list(range(len(names))) for i in ids}


def test_thue_morse_lines_and_words(spark):
    """Different symbols in a pattern on which polynomial hashes modulo a power of two agree."""
    for n in (1024, 2048):
        one = "a"
        while len(one) < n:
            one += one.translate(str.maketrans("ab", "ba"))
        two = one.translate(str.maketrans("ab", "ba"))
        got = quality_rules.judge(table(spark, [f"{one}\n{two}", " ".join(["x", "y", one, "x", "y", two]), f"{one}\n{one}"])).orderBy("doc_id").collect()
        assert [r.n_dup_lines for r in got] == [0, 0, 1] and got[1].n_repeat_words == 0
        docs = table(spark, [f"{w} b c d e f g h" for w in (one, two, one)])
        assert [r.class_id for r in jaccard_join.join(docs).orderBy("doc_id").collect()] == [0, 1, 0]
        assert [r.n_repeated for r in paragraph_dedup.measure(docs).orderBy("doc_id").collect()] == [1, 0, 1]


def test_components_end_only_when_settled(spark, monkeypatch):
    from lotlens.llm import graph

    monkeypatch.setattr(graph, "MOST_ROUNDS", 1, raising=False)  # a limit of rounds must not cut the work
    order = np.random.default_rng(5).permutation(60).tolist()
    edges = list(zip(order[:-1], order[1:], strict=True))
    got = {r.node: r.root for r in components(spark.createDataFrame(edges, "u int, v int")).collect()}
    assert got == dict.fromkeys(range(60), 0)


def test_hub_and_chain(spark):
    hub = spark.range(1, 100_001).select(F.col("id").alias("u"), F.lit(0).cast("bigint").alias("v"))
    mixed = lambda c: c * 7919 % 10_007
    chain = spark.range(10_000).select((mixed(F.col("id")) + 200_000).alias("u"), (mixed(F.col("id") + 1) + 200_000).alias("v"))
    got = components(hub.union(chain)).groupBy("root").count().collect()
    assert sorted((r.root, r["count"]) for r in got) == [(0, 100_001), (200_000, 10_001)]


def test_components(spark):
    edges = [(5, 4), (4, 3), (3, 2), (9, 8), (7, 7), (2, 5), (20, 21), (21, 22), (22, 23), (23, 24), (24, 20)]
    got = {r.node: r.root for r in components(spark.createDataFrame(edges, "u int, v int")).collect()}
    assert got == {2: 2, 3: 2, 4: 2, 5: 2, 8: 8, 9: 8, 20: 20, 21: 20, 22: 20, 23: 20, 24: 20}
    assert components(spark.createDataFrame([], "u int, v int")).count() == 0 and cut(spark.range(3)).count() == 3


def test_pipeline(spark):
    import corpus_pipeline

    docs = spark.read.parquet(f"{PATH}/documents.parquet")
    assert len(corpus_pipeline.STAGES) == 5
    seen = docs.count()
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
        out = cut(stage(spark, docs, PATH))
        assert 0 < out.count() <= seen
        if k < 4:
            assert out.columns == docs.columns
        seen, docs = out.count(), out
    assert docs.filter("NOT lossless").count() == 0 and docs.select("doc_id").distinct().count() == seen
