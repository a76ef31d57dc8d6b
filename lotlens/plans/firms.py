"""Firm, replay and backlog queries."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from ..functions import scalars as fn
from ..operators import firms as fm, ledger as lg, market as mk, replay as rp
from ..sources import files
from .base import LOTS, MONTHS, WINS, Tables, lots, query, r6, rounded, wins


def _refs(t: Tables) -> DataFrame:
    """A supplier's lines as references, the part name's words as roots; the first word counts as the title's."""
    w = t.lineitem.join(t.part, F.col("l_partkey") == F.col("p_partkey"))
    words = F.split("p_name", " ")
    return w.select(F.col("l_suppkey").alias("firm"), F.concat_ws("/", "l_orderkey", "l_linenumber").alias("ref"), F.posexplode(words).alias("pos", "root")).select("firm", "ref", "root", (F.col("pos") == 0).alias("in_title")).distinct()


@query(
    "core_roots",
    """WITH r AS (SELECT DISTINCT l_suppkey AS firm, l_orderkey || '/' || l_linenumber AS ref, unnest(string_split(p_name, ' ')) AS root, unnest(range(len(string_split(p_name, ' ')))) = 0 AS in_title FROM lineitem JOIN part ON l_partkey = p_partkey),
    f AS (SELECT root, left(root, 1) AS family FROM (SELECT DISTINCT root FROM r)), b AS (SELECT firm, count(DISTINCT ref) AS bearing, bool_or(in_title) AS titled FROM r GROUP BY 1),
    n AS (SELECT firm, root, count(DISTINCT ref) AS n, bool_or(in_title) AS in_title FROM r GROUP BY 1, 2),
    c AS (SELECT n.*, bearing, family, n >= CASE WHEN bearing <= 1 THEN 1 ELSE greatest(2, trunc(bearing * 0.5::DOUBLE + 0.999::DOUBLE)::INT) END AND (bearing > 1 OR NOT titled OR in_title) AS core FROM n JOIN b USING (firm) JOIN f USING (root)),
    h AS (SELECT firm, family, count(DISTINCT ref) AS hits FROM r JOIN f USING (root) GROUP BY 1, 2), t AS (SELECT firm, arg_max(family, lpad(hits::VARCHAR, 9, '0') || family) AS top FROM h JOIN b USING (firm) WHERE hits >= greatest(2, trunc(bearing * 0.5::DOUBLE + 0.999::DOUBLE)::INT) GROUP BY 1),
    m AS (SELECT c.*, coalesce(family = top AND n >= 2, false) AS second FROM c LEFT JOIN t USING (firm)), a AS (SELECT firm, bool_or(core) AS ac, bool_or(second) AS sc FROM m GROUP BY 1),
    k AS (SELECT firm, root, n FROM m JOIN a USING (firm) WHERE CASE WHEN ac THEN core WHEN sc THEN second ELSE in_title END)
    SELECT firm, root, n FROM k WHERE NOT EXISTS (SELECT 1 FROM k AS o WHERE o.firm = k.firm AND o.root <> k.root AND contains(k.root, o.root))""",
)
def core_roots(t: Tables) -> DataFrame:
    refs = _refs(t)
    return fm.core_roots(refs, refs.select("root").distinct().withColumn("family", F.left("root", F.lit(1))))


@query(
    "voted_contacts",
    f"WITH {WINS}, a AS (SELECT firm, size, count(*) AS n FROM wins GROUP BY 1, 2), b AS (SELECT firm, trade, count(*) AS n FROM wins GROUP BY 1, 2) SELECT firm, (SELECT size FROM a WHERE a.firm = w.firm ORDER BY n DESC, size LIMIT 1) AS size, (SELECT trade FROM b WHERE b.firm = w.firm ORDER BY n DESC, trade LIMIT 1) AS trade FROM (SELECT DISTINCT firm FROM wins) w",
)
def voted_contacts(t: Tables) -> DataFrame:
    return fm.voted(wins(t), "firm", ["size", "trade"])


@query(
    "firm_index",
    f"WITH {WINS} SELECT firm, count(*) AS wins, string_agg(DISTINCT trade, ';' ORDER BY trade) AS trades, string_agg(DISTINCT size, ';' ORDER BY size) AS roots FROM wins GROUP BY 1",
)
def firm_index(t: Tables) -> DataFrame:
    w = wins(t)
    return fm.index(w, w.select("firm", F.col("size").alias("root")), "firm", "trade")


@query(
    "hysteresis",
    """WITH RECURSIVE s AS (SELECT user_id, date_trunc('day', ts)::DATE AS day, avg((event_type = 'error')::INT) AS share FROM events GROUP BY 1, 2), k AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY day, share) AS i FROM s),
    f AS (SELECT user_id, i, share >= 0.5 AS state FROM k WHERE i = 1 UNION ALL SELECT k.user_id, k.i, CASE WHEN share >= 0.5 THEN true WHEN share < 0.2 THEN false ELSE state END FROM f JOIN k ON k.user_id = f.user_id AND k.i = f.i + 1)
    SELECT user_id, arg_max(state, i) AS "on" FROM f GROUP BY 1""",
)
def hysteresis(t: Tables) -> DataFrame:
    s = t.events.groupBy("user_id", F.col("ts").cast("date").alias("day")).agg(F.avg((F.col("event_type") == "error").cast("double")).alias("share"))
    return fm.with_hysteresis(s, ["user_id"], "day", "share", 0.5, 0.2)


@query(
    "trade_read",
    """WITH c AS (SELECT label, vec_id % 7 AS trade, round(list_dot_product(embedding::DOUBLE[], (SELECT embedding::DOUBLE[] FROM embeddings WHERE vec_id = 0)), 9) AS cos FROM embeddings),
    n AS (SELECT label, max(cos) FILTER (trade = label % 7) AS own_read, max(cos) FILTER (trade <> label % 7) AS foreign_read, max(cos) AS best_read, arg_max(trade, cos) AS reads FROM c GROUP BY 1)
    SELECT label, round(own_read, 6) AS own_read, round(foreign_read, 6) AS foreign_read, round(best_read, 6) AS best_read, reads, coalesce(foreign_read - own_read >= 0.225, false) AS contradicted FROM n""",
)
def trade_read(t: Tables) -> DataFrame:
    zero = F.broadcast(t.embeddings.filter("vec_id = 0").select(F.col("embedding").alias("z")))
    c = t.embeddings.crossJoin(zero).select("label", (F.col("vec_id") % 7).alias("trade"), F.round(fn.dot(F.col("embedding"), F.col("z")), 9).alias("cos"))
    own = F.col("trade") == F.col("label") % 7
    return rounded(fm.trade_read(c, "label", "trade", "cos", own, ~own), "own_read", "foreign_read", "best_read")


@query(
    "replay_flag_table",
    f"""WITH {LOTS}, g AS (SELECT priority, count(*) FILTER (f AND y) AS tp, count(*) FILTER (f AND NOT y) AS fp, count(*) FILTER (NOT f AND y) AS missed, count(*) FILTER (NOT f AND NOT y) AS tn FROM (SELECT priority, value % 1000 >= 800 AS f, n_tenders <= 1 AS y FROM lots WHERE n_tenders IS NOT NULL) GROUP BY 1)
    SELECT priority, tp, fp, missed, tn, round(tp::DOUBLE / nullif(tp + fp, 0), 6) AS precision, round(tp::DOUBLE / nullif(tp + missed, 0), 6) AS recall FROM g""",
)
def replay_flag_table(t: Tables) -> DataFrame:
    x = rp.flag_table(lots(t), ["priority"], F.col("value") % 1000 >= 800, F.col("n_tenders") <= 1)
    return rounded(x.select("priority", "tp", "fp", "missed", "tn", "precision", "recall"), "precision", "recall")


@query(
    "target_rows",
    """WITH f AS (SELECT p_partkey AS lot, p_brand AS code, CASE WHEN p_partkey % 6 > 0 THEN (p_partkey % 6)::VARCHAR END AS region, CASE WHEN p_size > 10 THEN p_size % 5 END AS n_tenders, CASE WHEN p_size > 20 THEN p_partkey % 4 END AS winner FROM part WHERE p_retailprice > 1000),
    t AS (SELECT * FROM (VALUES (1, ['Brand#1', 'Brand#2'], ['1', '2']), (2, ['Brand#3'], []::VARCHAR[]), (3, ['Brand#99'], []), (0, ['Brand#5', 'Brand#6'], ['5'])) AS v(firm, codes, regions)),
    m AS (SELECT * FROM t JOIN f ON list_contains(codes, code) AND (len(regions) = 0 OR region IS NULL OR list_contains(regions, region)))
    SELECT t.firm, count(m.lot) AS picks, count(n_tenders) AS graded, count(*) FILTER (n_tenders <= 1) AS lonely, count(winner) AS winner_known, count(*) FILTER (winner = t.firm) AS won FROM t LEFT JOIN m ON t.firm = m.firm GROUP BY 1""",
)
def target_rows(t: Tables) -> DataFrame:
    k = F.col("p_partkey")
    f = t.part.filter("p_retailprice > 1000").select(
        k.alias("lot"), F.col("p_brand").alias("code"), F.when(k % 6 > 0, (k % 6).cast("string")).alias("region"), F.when(F.col("p_size") > 10, F.col("p_size") % 5).alias("n_tenders"), F.when(F.col("p_size") > 20, k % 4).alias("winner")
    )
    rows = [(1, ["Brand#1", "Brand#2"], ["1", "2"]), (2, ["Brand#3"], []), (3, ["Brand#99"], None), (0, ["Brand#5", "Brand#6"], ["5"])]
    return rp.target_rows(t.spark.createDataFrame(rows, "firm int, codes array<string>, regions array<string>"), f)


@query("outcomes_between", f"WITH {LOTS} SELECT lot FROM lots WHERE pub > DATE '1999-01-01' AND pub <= DATE '1999-03-01'")
def outcomes_between(t: Tables) -> DataFrame:
    return rp.outcomes_between(lots(t), "pub", "1999-01-01", "1999-03-01").select("lot")


@query("simulation_check", f"WITH {LOTS} SELECT priority, count(*) AS n, round(avg((n_tenders <= 1)::INT), 6) AS hit, round(avg((status = 'F')::INT), 6) AS base FROM lots WHERE n_tenders IS NOT NULL GROUP BY 1")
def simulation_check(t: Tables) -> DataFrame:
    x = lots(t).filter("n_tenders IS NOT NULL")
    return rounded(rp.simulation_check(x, "priority", "buyer", F.col("n_tenders") <= 1, F.col("status") == "F")[0], "hit", "base")


@query(
    "verdict_backlog",
    "SELECT doc_id, source, CASE WHEN source IN ('src1', 'src2') THEN 'no_profile' WHEN doc_id NOT IN (SELECT vec_id FROM embeddings) THEN 'not_in_sidecar' END AS bucket FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)",
)
def verdict_backlog(t: Tables) -> DataFrame:
    d = t.documents.select("doc_id", "source")
    profiles = d.filter("source NOT IN ('src1', 'src2')")
    return lg.backlog(d, t.labels, ["doc_id"], profiles, t.embeddings.select(F.col("vec_id").alias("doc_id")), "source", "doc_id").select("doc_id", "source", "bucket")


@query("never_delivering", "SELECT DISTINCT p_brand AS model FROM part WHERE p_brand NOT IN (SELECT p_brand FROM part WHERE p_size > 49)")
def never_delivering(t: Tables) -> DataFrame:
    m = t.part.select(F.col("p_brand").alias("model"), "p_size")
    return lg.shadow_models(m.select("model").distinct(), m.filter("p_size > 49"))


@query(
    "copy_verification",
    """WITH a AS (SELECT c_nationkey AS k FROM customer), b AS (SELECT o_custkey % 25 AS k FROM orders), x AS (SELECT k FROM a EXCEPT ALL SELECT k FROM b), y AS (SELECT k FROM b EXCEPT ALL SELECT k FROM a)
    SELECT 'only_first' AS side, count(*) AS rows FROM x HAVING count(*) > 0 UNION ALL SELECT 'only_second', count(*) FROM y HAVING count(*) > 0""",
)
def copy_verification(t: Tables) -> DataFrame:
    a = t.customer.select(F.col("c_nationkey").cast("bigint").alias("k"))
    return lg.verified(a, t.orders.select((F.col("o_custkey") % 25).alias("k")))


@query(
    "spread_against_chance",
    f"""WITH {LOTS}, x AS (SELECT lot, priority, buyer % 5 AS cell, (n_tenders <= 2)::INT AS low FROM lots WHERE n_tenders IS NOT NULL), o AS (SELECT *, row_number() OVER (PARTITION BY priority ORDER BY lot) AS place, row_number() OVER (PARTITION BY priority ORDER BY md5(lot::VARCHAR || '|7'), lot) AS drawn FROM x),
    d AS (SELECT a.*, b.low AS shuffled FROM o a JOIN o b ON a.priority = b.priority AND a.place = b.drawn), r AS (SELECT priority, cell, count(*) AS n, avg(low) AS rate, avg(shuffled) AS chance FROM d GROUP BY 1, 2 HAVING count(*) >= 30)
    SELECT priority, count(*) AS cells, sum(n)::BIGINT AS rows, round(stddev_samp(rate), 6) AS spread, round(stddev_samp(chance), 6) AS chance_spread FROM r GROUP BY 1""",
)
def spread_against_chance(t: Tables) -> DataFrame:
    """The outcomes of a priority dealt anew among its lots."""
    x = lots(t).filter("n_tenders IS NOT NULL").withColumn("low", (F.col("n_tenders") <= 2).cast("int")).withColumn("cell", F.col("buyer") % 5)
    return rounded(rp.spread_against_chance(x, "priority", "cell", "lot", "low"), "spread", "chance_spread")


@query("cardinalities", "WITH e AS (SELECT 'p_brand' AS \"column\", p_brand AS v FROM part UNION ALL SELECT 'p_type', p_type FROM part UNION ALL SELECT 'p_size', p_size::VARCHAR FROM part), n AS (SELECT \"column\", v, count(*) AS n FROM e GROUP BY 1, 2) SELECT \"column\", count(*) AS \"distinct\", count(*) FILTER (n >= 30) AS large FROM n GROUP BY 1")
def cardinalities(t: Tables) -> DataFrame:
    """E49."""
    return rp.cardinalities(t.part, ["p_brand", "p_type", "p_size"])


@query("preferred_language", "SELECT event_id, CASE WHEN event_id % 2 = 0 THEN event_type ELSE 'any' END AS text FROM events")
def preferred_language(t: Tables) -> DataFrame:
    """A23."""
    m = F.when(F.col("event_id") % 2 == 0, F.create_map(F.lit("deu"), F.col("event_type"), F.lit("eng"), F.lit("other"))).otherwise(F.create_map(F.lit("fra"), F.lit("any")))
    return t.events.select("event_id", files.preferred(m, F.lit("deu")).alias("text"))


@query(
    "mature_rank_stats",
    f"""WITH {MONTHS}, rm AS (SELECT month FROM months WHERE mature ORDER BY month DESC LIMIT 12), h AS (SELECT lot, value % 1000 AS score, n_tenders <= 1 AS y FROM lots WHERE priority = '2-HIGH' AND month IN (SELECT month FROM rm)),
    r AS (SELECT y, row_number() OVER (ORDER BY score DESC, lot) <= greatest(1, round_even((SELECT count(*) FROM h) * 0.2::DOUBLE, 0)::INT) AS top FROM h)
    SELECT count(*) AS n, count(*) FILTER (top) AS k, round(avg(y::INT) FILTER (top), 6) AS hit, round(avg(y::INT), 6) AS base FROM r""",
)
def mature_rank_stats(t: Tables) -> DataFrame:
    """C21 over the lots of one priority."""
    x = lots(t).withColumn("score", F.col("value") % 1000)
    months = mk.recent_mature(mk.coverage(x))
    return rp.rank_stats(x, x.filter("priority = '2-HIGH'"), months, ["lot"], "month", "score", "lot", F.col("n_tenders") <= 1).select("n", "k", r6("hit").alias("hit"), r6("base").alias("base"))
