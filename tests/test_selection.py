from pyspark.sql import functions as F

from lotlens.operators import selection as sel


def test_picks_rank_few_lots(spark, monkeypatch):
    lots = spark.range(600).select(F.explode(F.array(F.col("id") % 3, F.col("id") % 4)).alias("trade"), (F.col("id") % 50).cast("double").alias("score"), "id")
    wanted = spark.range(40).select(F.explode(F.array(F.col("id") % 4, F.col("id") % 3)).alias("trade"), F.col("id").alias("firm"))
    seen = spark.range(40).select(F.col("id").alias("firm"), F.lit(49).cast("bigint").alias("id"))
    ranked, top = [], sel.top_k
    monkeypatch.setattr(sel, "top_k", lambda df, *a: ranked.append(df) or top(df, *a))
    got = {(r.firm, r.id, r.slot) for r in sel.merged_picks(lots, wanted, "firm", "trade", "score", "id", 5, seen).select("firm", "id", "slot").collect()}
    trades = {f: {f % 4, f % 3} for f in range(40)}
    want = {(f, i, k) for f, ts in trades.items() for k, (_, i) in enumerate(sorted((-(i % 50), i) for i in range(600) if {i % 3, i % 4} & ts)[:5], 1) if i != 49}
    assert got == want
    # A company meets the best lots of its trades only, not all lots of them.
    assert ranked[-1].count() <= 40 * 2 * 5
