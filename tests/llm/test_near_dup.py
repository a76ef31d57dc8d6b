"""Near duplicates against brute force over all pairs."""

import random
import re
from itertools import combinations

import pyarrow as pa
import pytest

from lotlens.llm import jaccard_join, near_dup

SCHEMA = "doc_id bigint, text string, lang string, source string, n_chars bigint, digest string, root int"


def grams(text, k=5):
    low = "".join(c.lower() if c.isascii() else c for c in text or "")
    words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", low)
    return {tuple(words[i : i + k]) for i in range(max(1, len(words) - k + 1))} if words else set()


def brute(texts, threshold=0.8):
    """{index: (smallest index of its component, links)}"""
    sets = [grams(t) for t in texts]
    root, links = list(range(len(texts))), [0] * len(texts)

    def find(k):
        while root[k] != k:
            k = root[k]
        return k

    for a, b in combinations(range(len(texts)), 2):
        inter = len(sets[a] & sets[b])
        if inter and inter >= threshold * (len(sets[a]) + len(sets[b]) - inter) - 1e-12:
            links[a] += 1
            links[b] += 1
            x, y = sorted((find(a), find(b)))
            root[y] = x
    return {k: (find(k), links[k]) for k in range(len(texts))}


def corpus(seed=3, count=120):
    r = random.Random(seed)
    words = [f"w{i}" for i in range(400)]
    texts = [" ".join(r.choices(words, k=r.randint(1, 150))) for _ in range(count)]
    for _ in range(count):
        t = r.choice(texts).split()
        for _ in range(r.choice([0, 0, 1, 2, 4])):
            t[r.randrange(len(t))] = r.choice(words)
        texts.append(" ".join(t))
    hub = r.choices(words, k=120)
    for _ in range(150):  # a group of more members than a block
        t = hub[:]
        t[r.randrange(120)] = r.choice(words)
        texts.append(" ".join(t))
    return texts + ["", None, None, "one", "One!", "... --"]


def test_join_matches_brute_force(spark):
    texts = corpus()
    docs = spark.createDataFrame([(i, t, None, None, None, "x", 1) for i, t in enumerate(texts)], SCHEMA)
    got = {r.doc_id: (r.class_id, r.n_links) for r in jaccard_join.join(docs).collect()}
    assert got == brute(texts)


def test_join_of_table(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    rows = sorted((r.doc_id, r.text) for r in docs.collect())
    want = {rows[k][0]: (rows[c][0], n) for k, (c, n) in brute([t for _, t in rows]).items()}
    assert {r.doc_id: (r.class_id, r.n_links) for r in jaccard_join.join(docs).collect()} == want


def test_null_ids_repeats_and_empty(spark):
    t = "a b c d e f g h"
    docs = spark.createDataFrame([(None, t), (5, t), (5, t), (None, "x y"), (None, "X y"), (9, None)], "doc_id bigint, text string")
    got = sorted(((r.doc_id, r.class_id, r.n_links) for r in jaccard_join.join(docs).collect()), key=str)
    assert got == sorted([(None, 5, 2), (5, 5, 2), (5, 5, 2), (None, None, 1), (None, None, 1), (9, 9, 0)], key=str)
    assert jaccard_join.join(docs.limit(0)).count() == 0
    assert sorted(map(str, (r.doc_id for r in jaccard_join.keep_one(docs).collect()))) == sorted(["5", "5", "9", "None", "None", "None"])


def test_pipeline_keeps_one_row_of_a_class(spark):
    import corpus_pipeline

    a, b, c, d = ("one two three four five six " + x for x in ("seven eight", "nine ten eleven", "red green", "blue cyan"))
    near = " ".join(f"n{i}" for i in range(60))
    rows = [(5, a, "x"), (5, a, "x"), (5, a, "y"), (None, b, "x"), (None, b, "x"), (None, b, "z"), (None, c, "x"), (7, c, "x")]
    rows += [(1, near, "x"), (8, near + " tail", "x"), (8, d, "x"), (9, None, "x"), (9, None, "x"), (None, "", "x")]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, lang string")
    got = [(r.doc_id, r.text) for r in corpus_pipeline.jaccard_stage(spark, docs, "").collect()]
    assert sorted(got, key=str) == sorted([(5, a), (None, b), (7, c), (1, near), (8, d), (9, None), (9, None), (None, "")], key=str)
    assert corpus_pipeline.jaccard_stage(spark, docs.limit(0), "").count() == 0
    texts = corpus()
    docs = spark.createDataFrame([(i, t, None, None, None, "x", 1) for i, t in enumerate(texts)], SCHEMA)
    kept = sorted(r.doc_id for r in corpus_pipeline.jaccard_stage(spark, docs, "").collect())
    assert kept == sorted(r.doc_id for r in jaccard_join.keep_one(docs).collect())


def test_posterior_bounds_grow():
    least = near_dup.least_matches(120, 0.8, 1e-4)
    assert least[0] == 0 and all(b >= a for a, b in zip(least, least[1:], strict=False)) and 60 < least[120] < 96


@pytest.mark.parametrize("rows", [3, 5])
def test_bands_differ_by_place(rows):
    import numpy as np

    sig = np.zeros((2, rows * 4), np.uint32)
    assert len(set(near_dup.bands(sig, rows)[0].tolist())) == 4
    assert pa.array(near_dup.bands(sig, rows)[0]).type == pa.int64()
