"""Queries of scalars, vectors and joins that no other query touches."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from ..functions import scalars as fn
from ..operators import asof, experiments as ex, features as ft, ledger as lg, market as mk, pairs as pr, revisions as rv, selection as sel, stats, text as tx, vectors as vc
from ..sources import notices as nt
from .base import LOTS, Tables, lots, query, rounded
from .language import _ALL_PAIRS, _PAIRS, _asked
from .market import PROSPECTS, _prospects


@query("lot_codes", "SELECT p_partkey, array_to_string(list_filter([CASE WHEN p_size > 5 THEN p_brand END, CASE WHEN p_size % 2 = 0 THEN p_type ELSE '' END], lambda x: x IS NOT NULL AND x <> ''), ';') AS codes, CASE WHEN p_size > 20 THEN p_size ELSE p_partkey END AS deadline FROM part")
def lot_codes(t: Tables) -> DataFrame:
    """B23, B24."""
    size = F.col("p_size")
    codes = fn.lot_codes(F.when(size > 5, F.col("p_brand")), F.array(F.when(size % 2 == 0, F.col("p_type")).otherwise("")))
    return t.part.select("p_partkey", F.array_join(codes, ";").alias("codes"), fn.action_deadline(F.when(size > 20, size.cast("bigint")), F.col("p_partkey")).alias("deadline"))


@query("bid_sums", "SELECT l_orderkey, nullif(round(sum(CASE WHEN l_returnflag = 'R' THEN 0 ELSE l_extendedprice END), 4), 0) AS total FROM lineitem GROUP BY 1")
def bid_sums(t: Tables) -> DataFrame:
    """B27."""
    bid = F.struct(F.col("l_extendedprice").alias("amount"), F.when(F.col("l_returnflag") == "R", "USD").when(F.col("l_returnflag") == "A", "EUR").alias("currency"))
    return t.lineitem.groupBy("l_orderkey").agg(F.collect_list(bid).alias("bids")).select("l_orderkey", F.nullif(F.round(fn.bid_sum(F.col("bids")), 4), F.lit(0.0)).alias("total"))


@query(
    "section_texts",
    "SELECT p_partkey, CASE WHEN p_size % 2 = 0 THEN lower(p_brand || ' ' || p_type) ELSE lower(p_brand || ' ' || p_name || ' ' || p_type) END AS text FROM part",
)
def section_texts(t: Tables) -> DataFrame:
    """What follows the last marker, else the whole body."""
    body = F.when(F.col("p_size") % 2 == 0, F.concat(F.lit("x Leistung: y LEISTUNG:"), "p_type")).otherwise(F.concat("p_name", F.lit(" "), "p_type"))
    return t.part.select("p_partkey", tx.section_text(F.col("p_brand"), body, "leistung:").alias("text"))


@query("repaired_texts", "SELECT p_partkey, CASE WHEN p_size % 3 = 2 THEN 'Ã x' ELSE 'Größe ' || p_name END AS text FROM part")
def repaired_texts(t: Tables) -> DataFrame:
    """UTF-8 that was read as Latin-1 is put right; anything else stays."""
    good = F.concat(F.lit("Größe "), "p_name")
    bad = F.decode(F.encode(good, "UTF-8"), "ISO-8859-1")
    return t.part.select("p_partkey", tx.repaired(F.when(F.col("p_size") % 3 == 0, good).when(F.col("p_size") % 3 == 1, bad).otherwise("Ã x")).alias("text"))


@query("noise_floor", f"WITH {_ALL_PAIRS} SELECT round(avg(cos), 6) AS mean, round(quantile_cont(cos, 0.95), 6) AS p95, round(max(cos), 6) AS most, count(*) AS pairs FROM c WHERE firm <> (SELECT label FROM embeddings e WHERE e.vec_id = c.ref)")
def noise_floor(t: Tables) -> DataFrame:
    """Pairs of different labels are unrelated."""
    return rounded(pr.noise_floor(t.embeddings, t.embeddings, "vec_id", "label", "vec_id", "label", "embedding"), "mean", "p95", "most")


@query(
    "bar_table",
    f"WITH {_PAIRS}, p AS (SELECT c.*, label FROM c JOIN embeddings e ON e.vec_id = c.ref), n AS (SELECT vec_id, max(cos) AS best FROM p WHERE firm <> label GROUP BY 1), b AS (SELECT unnest([0.2, 0.3, 0.5])::DOUBLE AS bar) SELECT bar, (SELECT count(*) FROM p WHERE firm = label AND cos >= bar) AS kept, (SELECT count(*) FROM n WHERE best >= bar) AS firing FROM b",
)
def bar_table(t: Tables) -> DataFrame:
    """I23."""
    return pr.bar_table(_asked(t), t.embeddings, "vec_id", "label", "vec_id", "label", "embedding", [0.2, 0.3, 0.5])


@query("missing_vectors", "WITH n AS (SELECT doc_id, sha1(left(text, 40)) AS h FROM documents WHERE text IS NOT NULL AND doc_id NOT IN (SELECT vec_id FROM embeddings WHERE vec_id % 2 = 0)) SELECT h AS hash, min(doc_id) AS doc_id FROM n GROUP BY 1")
def missing_vectors(t: Tables) -> DataFrame:
    """New keys, each text once."""
    keys = t.documents.filter("text IS NOT NULL").select("doc_id", F.sha1(F.left("text", F.lit(40)).cast("binary")).alias("hash"))
    return vc.missing(keys, t.embeddings.filter("vec_id % 2 = 0").select(F.col("vec_id").alias("doc_id")), ["doc_id"], "hash").select("hash", "doc_id")


@query("best_codes", "WITH c AS (SELECT l_orderkey, l_partkey % 50 AS code FROM lineitem), s AS (SELECT p_partkey AS code, p_size AS label, p_retailprice / 2000 AS cos FROM part WHERE p_partkey < 40) SELECT l_orderkey, round(max(cos), 9) AS best FROM c JOIN s USING (code) GROUP BY 1")
def best_codes(t: Tables) -> DataFrame:
    """J4."""
    codes = t.lineitem.select("l_orderkey", (F.col("l_partkey") % 50).alias("code"))
    table = t.part.filter("p_partkey < 40").select(F.col("p_partkey").alias("code"), F.col("p_size").alias("label"), (F.col("p_retailprice") / 2000).alias("cos"))
    return vc.best_code(codes, table, "l_orderkey", "code", "label", "cos").select("l_orderkey", F.round("best", 9).alias("best"))


@query(
    "picks_or_ranked",
    "WITH l AS (SELECT o_custkey AS sub, o_orderkey AS lot, o_totalprice AS score, o_orderstatus = 'F' AS picked FROM orders), u AS (SELECT * FROM l WHERE picked UNION ALL SELECT * FROM l WHERE NOT picked AND sub NOT IN (SELECT sub FROM l WHERE picked)) SELECT sub, lot, rank FROM (SELECT *, row_number() OVER (PARTITION BY sub ORDER BY score DESC, lot) AS rank FROM u) WHERE rank <= 3",
)
def picks_or_ranked(t: Tables) -> DataFrame:
    """G7, G10."""
    rows = t.orders.select(F.col("o_custkey").alias("sub"), F.col("o_orderkey").alias("lot"), F.col("o_totalprice").alias("score"), "o_orderstatus")
    split = lambda c: rows.filter(c).drop("o_orderstatus")
    return sel.picks_or_ranked(split("o_orderstatus = 'F'"), split("o_orderstatus <> 'F'"), "sub", [F.desc("score"), F.col("lot")], 3).select("sub", "lot", "rank")


@query("joined_lists", "SELECT o_orderkey, array_to_string(CASE WHEN o_custkey % 2 = 0 THEN CASE WHEN o_orderpriority = '1-URGENT' THEN ['1-URGENT', 'x'] ELSE ['1-URGENT', o_orderpriority, 'x'] END ELSE CASE WHEN o_orderpriority = 'x' THEN ['x'] ELSE [o_orderpriority, 'x'] END END, ';') AS grounds FROM orders")
def joined_lists(t: Tables) -> DataFrame:
    """H5: the order of the first list, then what the second adds."""
    first = F.when(F.col("o_custkey") % 2 == 0, F.array(F.lit("1-URGENT"))).otherwise(F.array().cast("array<string>"))
    return t.orders.select("o_orderkey", F.array_join(F.array_distinct(F.concat(first, F.array("o_orderpriority", F.lit("x")))), ";").alias("grounds"))


@query("built_features", "SELECT o_orderkey, round(o_totalprice, 4) AS o_totalprice, date_diff('day', o_orderdate::DATE, l.ship)::DOUBLE AS ship_days, coalesce(o_orderpriority, '__NA__') AS o_orderpriority FROM orders JOIN (SELECT l_orderkey, max(l_shipdate)::DATE AS ship FROM lineitem GROUP BY 1) l ON l_orderkey = o_orderkey")
def built_features(t: Tables) -> DataFrame:
    """Blocks by role; the reference date is no feature."""
    ship = t.lineitem.groupBy("l_orderkey").agg(F.max(F.col("l_shipdate").cast("date")).alias("ship"))
    rows = t.orders.join(ship, F.col("l_orderkey") == F.col("o_orderkey")).select("o_orderkey", "o_totalprice", "o_orderpriority", "ship", F.col("o_orderdate").cast("date").alias("day"))
    df, made, _ = ft.build(rows, "day", {"o_orderkey": "key", "o_totalprice": "numeric", "o_orderpriority": "categorical", "ship": "date", "day": "date"})
    assert sorted(made) == ["f_o_orderpriority", "f_o_totalprice", "f_ship_days"]
    return df.select("o_orderkey", F.round("f_o_totalprice", 4).alias("o_totalprice"), F.col("f_ship_days").alias("ship_days"), F.col("f_o_orderpriority").alias("o_orderpriority"))


@query("criterion_kinds", "SELECT p_partkey, CASE p_partkey % 5 WHEN 0 THEN 'price-only' WHEN 1 THEN 'meat' WHEN 2 THEN 'price-only' WHEN 3 THEN NULL ELSE 'meat' END AS kind FROM part")
def criterion_kinds(t: Tables) -> DataFrame:
    """B14."""
    texts = ["Der  Preis", "Preis ist nicht das einzige Zuschlagskriterium", "100 % Preis", "Qualität", "Most economically advantageous tender, Preis"]
    text = F.element_at(F.array(*[F.lit(x) for x in texts]), (F.col("p_partkey") % 5 + 1).cast("int"))
    return t.part.select("p_partkey", nt.criterion_kind(text).alias("kind"))


@query(
    "replay_plan",
    f"WITH {LOTS}, c AS (SELECT unnest(generate_series(DATE '1995-03-01', DATE '1996-12-31', INTERVAL 7 DAY))::DATE AS cutoff), k AS (SELECT cutoff, count(*) AS lots FROM c JOIN lots ON pub < cutoff GROUP BY 1 HAVING count(*) >= 300) SELECT cutoff, lots, (row_number() OVER (ORDER BY cutoff) - 1)::INT AS week, (row_number() OVER (ORDER BY cutoff) - 1) % 8 = 0 AS recalibrates FROM k",
)
def replay_plan(t: Tables) -> DataFrame:
    """L5."""
    return asof.replay_plan(lots(t), "pub", asof.cutoffs(t.spark, "1995-03-01", "1996-12-31", 7))


@query("replay_ranks", f"WITH {LOTS} SELECT month, lot, rank FROM (SELECT *, row_number() OVER (PARTITION BY month ORDER BY value % 1000 DESC, lot) AS rank FROM lots) WHERE rank <= 5")
def replay_ranks(t: Tables) -> DataFrame:
    """G5."""
    return asof.replay_ranks(lots(t).withColumn("score", F.col("value") % 1000), "month", "score", "lot", 5).select("month", "lot", "rank")


@query(
    "single_feature_audit",
    """WITH e AS (SELECT l_returnflag = 'R' AS t, unnest(['quantity', 'tax', 'line']) AS feature, unnest([l_quantity, l_tax, l_linenumber + CASE WHEN l_returnflag = 'R' THEN 5 ELSE 0 END]) AS x FROM lineitem),
    c AS (SELECT feature, x, count(*) AS n, count(*) FILTER (t) AS p FROM e GROUP BY 1, 2), r AS (SELECT *, sum(n) OVER (PARTITION BY feature ORDER BY x) - (n - 1) / 2.0::DOUBLE AS rk FROM c),
    a AS (SELECT feature, (sum(rk * p) - sum(p) * (sum(p) + 1) / 2) / (sum(p) * sum(n - p)) AS auc FROM r GROUP BY 1) SELECT feature, round(greatest(auc, 1 - auc), 6) AS auc, greatest(auc, 1 - auc) >= 0.85 AS suspicious FROM a""",
)
def single_feature_audit(t: Tables) -> DataFrame:
    """M8."""
    late = F.col("l_returnflag") == "R"
    x = t.lineitem.select(late.alias("t"), F.col("l_quantity").alias("quantity"), F.col("l_tax").alias("tax"), (F.col("l_linenumber") + F.when(late, 5).otherwise(0)).alias("line"))
    return rounded(stats.single_feature_audit(x, ["quantity", "tax", "line"], F.col("t")), "auc")


@query("leave_one_out", f"WITH {_PAIRS} SELECT vec_id, round(max(cos) FILTER (firm = label), 6) AS own, round(max(cos) FILTER (firm <> label), 6) AS foreign_best FROM c JOIN (SELECT vec_id AS ref, label FROM embeddings) USING (ref) GROUP BY 1")
def leave_one_out(t: Tables) -> DataFrame:
    """J11."""
    x = vc.leave_one_out(_asked(t), t.embeddings.select(F.col("vec_id").alias("ref"), "embedding", "label"), "vec_id", "ref", "embedding", "label")
    return rounded(x.withColumnRenamed("foreign", "foreign_best"), "own", "foreign_best")


@query("paired_positions", "WITH a AS (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS place FROM orders WHERE o_orderstatus = 'F'), b AS (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS place FROM orders WHERE o_orderstatus = 'O') SELECT o_custkey, place, a.o_orderkey AS o_orderkey, b.o_orderkey AS o_orderkey_b FROM a JOIN b USING (o_custkey, place)")
def paired_positions(t: Tables) -> DataFrame:
    """C22."""
    arm = lambda s: t.orders.filter(F.col("o_orderstatus") == s).select("o_custkey", "o_orderkey")
    return ex.paired_positions(arm("F"), arm("O"), ["o_custkey"], ["o_orderkey"])


@query("with_first", "WITH f AS (SELECT o_custkey, o_orderkey, o_totalprice FROM orders WHERE o_orderstatus = 'P' QUALIFY row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) = 1) SELECT c_custkey, o_orderkey, round(o_totalprice, 4) AS o_totalprice FROM customer LEFT JOIN f ON o_custkey = c_custkey")
def with_first(t: Tables) -> DataFrame:
    """C20, K19."""
    o = t.orders.filter("o_orderstatus = 'P'").withColumnRenamed("o_custkey", "c_custkey")
    x = rv.with_first(t.customer.select("c_custkey"), o, ["c_custkey"], [F.col("o_orderdate"), F.col("o_orderkey")], ["o_orderkey", "o_totalprice"])
    return x.withColumn("o_totalprice", F.round("o_totalprice", 4))


@query("rejected_prospects", f"WITH {PROSPECTS} SELECT reason, count(*) AS firms FROM (SELECT unnest(string_split(against, '; ')) AS reason FROM prospects WHERE against <> '') GROUP BY 1")
def rejected_prospects(t: Tables) -> DataFrame:
    """E12."""
    return mk.rejected(_prospects(t))


@query("to_learn", "SELECT DISTINCT l_suppkey AS customer, l_partkey AS ref FROM lineitem WHERE (l_suppkey, l_partkey) NOT IN (SELECT (l_suppkey, l_partkey) FROM lineitem WHERE l_returnflag = 'R')")
def to_learn(t: Tables) -> DataFrame:
    """K14."""
    w = t.lineitem.select(F.col("l_suppkey").alias("customer"), F.col("l_partkey").alias("ref"), "l_returnflag")
    return lg.to_learn(w, w.filter("l_returnflag = 'R'"), "customer", "ref")


@query("exported_ledger", """SELECT event_id AS seq, '{"user_id":' || user_id || ',"event_type":"' || event_type || '","note":null}' AS line FROM events""")
def exported_ledger(t: Tables) -> DataFrame:
    """A19."""
    held = t.events.select(F.col("event_id").alias("seq"), "user_id", "event_type", F.lit(None).cast("string").alias("note"))
    return lg.exported(held, ["user_id", "event_type", "note"])
