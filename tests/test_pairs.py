import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from lotlens import plans
from lotlens.operators import pairs as pr, vectors as vc

from .oracle import connect, of_spark, of_sql

ROWS = [
    (1, "a", [1.0, 0.0]), (2, "a", [0.6, 0.8]), (3, "b", [0.8, 0.6]), (4, "b", [-1.0, 0.5]), (5, None, [1.0, 1.0]), (6, "b", None),
    (7, "a", [0.0, 0.0]), (8, "b", [1.0, 2.0, 3.0]), (9, "a", [1.0, None]), (20, "a", [0.3, 0.4]), (40, "b", [2.0, 1.0]), (60, "a", [3.0, 1.0]),
]


@pytest.fixture(params=[20_000, 2])
def vectors(spark, request, monkeypatch):
    monkeypatch.setattr(pr, "SLICE", request.param)
    monkeypatch.setattr(pr, "PARTS", 3)
    return spark.createDataFrame(ROWS, "id long, label string, v array<double>")


def _pairs(df):
    """A row for each pair, as before."""
    label = df.select("id", F.col("label").alias("a"))
    other = df.select(F.col("id").alias("ref"), F.col("label").alias("b"))
    return vc.similar(df, df.select(F.col("id").alias("ref"), "v"), "id", "ref", "v", others=True).join(label, "id").join(other, "ref")


def test_noise_floor(vectors):
    got = pr.noise_floor(vectors, vectors, "id", "label", "id", "label", "v").first()
    rows = _pairs(vectors).filter("a <> b")
    want = vc.noise_floor(rows, "cos").first()
    assert got["pairs"] == want["pairs"] > rows.filter("cos IS NOT NULL").count() and got["most"] == want["most"]
    assert math.isclose(got["mean"], want["mean"], abs_tol=1e-12) and math.isclose(got["p95"], want["p95"], abs_tol=1e-12)
    none = pr.noise_floor(vectors.filter("id < 0"), vectors, "id", "label", "id", "label", "v").first()
    assert tuple(none) == (None, None, 0, None)


def test_bar_table(vectors):
    rows, bars = _pairs(vectors), [0.2, 0.6, 1.0]
    got = pr.bar_table(vectors, vectors, "id", "label", "id", "label", "v", bars)
    assert "Join" not in got._jdf.queryExecution().toString()  # no row for a pair
    want = vc.bar_table(rows.filter("a = b"), rows.filter("a <> b"), "id", "cos", bars)
    assert [tuple(r) for r in got.orderBy("bar").collect()] == [tuple(r) for r in want.orderBy("bar").collect()]


def test_consensus(vectors):
    rows = _pairs(vectors).filter("cos >= 0.2").select(F.col("a").alias("label"), "id", "ref", "cos")
    want = rows.groupBy("label", "ref").agg(F.count_distinct("id").alias("refs"), F.max("cos").alias("best")).collect()
    got = pr.consensus(vectors.union(vectors), vectors, "id", "label", "id", "v", 0.2)  # a key twice counts once
    assert {tuple(r) for r in got.select("label", "id", "refs", "best").collect()} == {tuple(r) for r in want}


@pytest.fixture
def whole(spark, tmp_path):
    """Forty vectors of three labels, one id of which is divisible by 20; the query and its SQL in DuckDB."""
    rows = [(i, i % 3, [math.cos(i * i), math.sin(i * i), 0.5 * math.cos(3 * i)]) for i in range(1, 40)]
    spark.createDataFrame(rows, "vec_id long, label int, embedding array<float>").coalesce(1).write.parquet(f"{tmp_path}/embeddings.parquet")
    for name in ("region nation customer supplier part orders lineitem events documents pages benchmark labels conversations").split():
        spark.createDataFrame([(1,)], "x int").coalesce(1).write.parquet(f"{tmp_path}/{name}.parquet")
    return lambda name: (of_spark(plans.QUERIES[name](spark, str(tmp_path))), of_sql(connect(str(tmp_path)), plans.SQL[name]))


def test_noise_floor_asks_every_vector(whole):
    got, want = whole("noise_floor")
    assert got == want
    assert dict(zip(got[0], got[1][0], strict=True))["pairs"] == 39 * 26  # 13 vectors of each label


def test_soft_fingerprint_asks_every_vector(whole):
    got, want = whole("soft_fingerprint")
    assert got == want
    assert len(got[1]) == 3 * 8  # a single asked vector gives no reference of two


def test_consensus_of_long_keys(spark):
    """Keys need not fit the type of the groups."""
    far = 1 << 40
    rows = spark.createDataFrame([(far + i, i % 2, [1.0, float(i)]) for i in range(4)], "id long, label int, v array<double>")
    got = pr.consensus(rows, rows, "id", "label", "id", "v", -1.0)
    assert {tuple(r)[:3] for r in got.select("label", "id", "refs").collect()} == {(g, far + i, 1 if i % 2 == g else 2) for g in range(2) for i in range(4)}


def test_raw_is_the_least_cosine_of_its_parts():
    for k in [0, 1, 2, -1, -2, pr.ONE, 200_000_000, 199_999_999, *range(123_456_700, 123_456_720)]:
        x = pr._raw(k)
        assert np.rint(x * pr.ONE) >= k > np.rint(np.nextafter(x, -2) * pr.ONE)
