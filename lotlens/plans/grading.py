"""Grading, drift, ledgers and experiments."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from ..functions import scalars as fn
from ..operators import experiments as ex, features as ft, ledger as lg, revisions as rv, stats
from .base import LOTS, SCORED, WINS, Tables, lots, query, r6, rounded, scored, wins

_W = "sqrt(greatest(p * (1 - p) / m + 3.8416 / (4 * m * m), 0))"


@query(
    "wilson_ci",
    f"""WITH {SCORED}, g AS (SELECT lang, count(*) FILTER (good) AS k, count(*) AS n FROM scored GROUP BY 1), q AS (SELECT *, n::DOUBLE AS m, k::DOUBLE / n AS p FROM g)
    SELECT lang, k, n, round(greatest((p + 3.8416 / (2 * m) - 1.96 * {_W}) / (1 + 3.8416 / m), 0), 6) AS low, round(least((p + 3.8416 / (2 * m) + 1.96 * {_W}) / (1 + 3.8416 / m), 1), 6) AS high FROM q""",
)
def wilson_ci(t: Tables) -> DataFrame:
    g = scored(t).groupBy("lang").agg(F.count_if("good").alias("k"), F.count(F.lit(1)).alias("n"))
    low, high = fn.wilson(F.col("k"), F.col("n"))
    return g.select("lang", "k", "n", r6(low).alias("low"), r6(high).alias("high"))


@query(
    "flag_stats",
    f"""WITH {SCORED}, g AS (SELECT lang, count(*) FILTER (flag AND good) AS tp, count(*) FILTER (flag AND NOT good) AS fp, count(*) FILTER (NOT flag AND good) AS missed, count(*) FILTER (NOT flag AND NOT good) AS tn FROM scored GROUP BY 1),
    a AS (SELECT *, tp::DOUBLE / nullif(tp + fp, 0) AS p, tp::DOUBLE / nullif(tp + missed, 0) AS r, (tp + missed)::DOUBLE / (tp + fp + missed + tn) AS base, (tp + fp)::DOUBLE AS m FROM g),
    b AS (SELECT *, greatest((p + 3.8416 / (2 * m) - 1.96 * {_W}) / (1 + 3.8416 / m), 0) AS low, least((p + 3.8416 / (2 * m) + 1.96 * {_W}) / (1 + 3.8416 / m), 1) AS high FROM a)
    SELECT lang, tp, fp, missed, tn, round(p, 6) AS precision, round(r, 6) AS recall, round(coalesce(2 * p * r / nullif(p + r, 0), 0), 6) AS f1, round(low, 6) AS precision_low, round(high, 6) AS precision_high, round(base, 6) AS base, low > base AS beats_base FROM b""",
)
def flag_stats(t: Tables) -> DataFrame:
    return rounded(stats.confusion(scored(t), F.col("flag"), F.col("good"), ["lang"]), "precision", "recall", "f1", "precision_low", "precision_high", "base")


@query(
    "top_slice",
    f"""WITH {SCORED}, r AS (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY score DESC, doc_id) AS k, count(*) OVER (PARTITION BY lang) AS n FROM scored),
    s AS (SELECT *, k <= greatest(1, round_even(n * 0.2::DOUBLE, 0)::INT) AS top FROM r)
    SELECT lang, count(*) AS n, count(*) FILTER (top) AS k, round(avg(good::INT) FILTER (top), 6) AS hit, round(avg(good::INT), 6) AS base, round(avg(good::INT) FILTER (top) / nullif(avg(good::INT), 0), 6) AS lift FROM s GROUP BY 1""",
)
def top_slice(t: Tables) -> DataFrame:
    return rounded(stats.top_slice(scored(t), ["lang"], "score", "doc_id", F.col("good")), "hit", "base", "lift")


@query(
    "auc_avg_rank",
    f"""WITH {SCORED}, r AS (SELECT lang, good, rank() OVER (PARTITION BY lang ORDER BY score) + (count(*) OVER (PARTITION BY lang, score) - 1) / 2.0 AS rk FROM scored),
    g AS (SELECT lang, sum(rk) FILTER (good)::DOUBLE AS s, count(*) FILTER (good) AS positives, count(*) FILTER (NOT good) AS negatives FROM r GROUP BY 1)
    SELECT lang, positives, negatives, round((s - positives * (positives + 1) / 2.0) / nullif(positives * negatives, 0), 6) AS auc FROM g""",
)
def auc_avg_rank(t: Tables) -> DataFrame:
    return rounded(stats.auc(scored(t), ["lang"], "score", F.col("good")), "auc")


@query(
    "average_precision",
    f"""WITH {SCORED}, w AS (SELECT lang, score, sum(CASE WHEN good THEN 1.0 + doc_id % 3 ELSE 0 END)::DOUBLE AS p, sum(1.0 + doc_id % 3)::DOUBLE AS n FROM scored GROUP BY 1, 2),
    c AS (SELECT *, sum(p) OVER (PARTITION BY lang) AS tp, sum(p) OVER (PARTITION BY lang ORDER BY score DESC) AS cp, sum(n) OVER (PARTITION BY lang ORDER BY score DESC) AS cn FROM w)
    SELECT lang, round(sum(p / nullif(tp, 0) * cp / cn), 6) AS average_precision, round(sum(p) / sum(n), 6) AS base FROM c GROUP BY 1""",
)
def average_precision(t: Tables) -> DataFrame:
    return rounded(stats.average_precision(scored(t), ["lang"], "score", F.col("good"), 1.0 + F.col("doc_id") % 3), "average_precision", "base")


@query(
    "score_tiers",
    f"""WITH {SCORED}, r AS (SELECT doc_id, lang, row_number() OVER (PARTITION BY lang ORDER BY score DESC, doc_id) AS rank, count(*) OVER (PARTITION BY lang) AS batch FROM scored),
    h AS (SELECT *, greatest(1, round_even(batch * 0.1::DOUBLE, 0)::INT) AS a, greatest(1, round_even(batch * 0.2::DOUBLE, 0)::INT) AS b FROM r)
    SELECT doc_id, lang, rank, batch, CASE WHEN rank <= a THEN 'HIGH' WHEN rank <= a + b THEN 'MEDIUM' ELSE 'LOW' END AS tier FROM h""",
)
def score_tiers(t: Tables) -> DataFrame:
    return stats.tiers(scored(t), ["lang"], "score", "doc_id").select("doc_id", "lang", "rank", "batch", "tier")


@query(
    "psi",
    """WITH e AS (SELECT value AS v, ts >= TIMESTAMP '2024-01-15' AS late FROM events WHERE value IS NOT NULL),
    q AS (SELECT list_sort(list_distinct(quantile_cont(v, [0, 0.1, 0.2, 0.3, 0.4, 0.5, 0.6, 0.7, 0.8, 0.9, 1]))) AS edges FROM e WHERE NOT late),
    b AS (SELECT late, len(list_filter(edges[2:-2], lambda x: x <= v)) AS bin FROM e, q),
    n AS (SELECT bin, count(*) FILTER (NOT late) AS a, count(*) FILTER (late) AS b FROM b GROUP BY 1),
    p AS (SELECT greatest(a::DOUBLE / (SELECT sum(a) FROM n), 0.0001) AS p, greatest(b::DOUBLE / (SELECT sum(b) FROM n), 0.0001) AS q FROM n)
    SELECT round(sum((q - p) * ln(q / p)), 6) AS psi FROM p""",
)
def psi(t: Tables) -> DataFrame:
    late = F.col("ts") >= F.lit("2024-01-15").cast("timestamp_ntz")
    return rounded(stats.psi(t.events.filter(~late), t.events.filter(late), "value"), "psi")


@query(
    "drift_base_rate",
    f"""WITH {LOTS}, m AS (SELECT month, count(n_tenders) AS n, avg((n_tenders <= 1)::INT) AS rate FROM lots GROUP BY 1), u AS (SELECT *, row_number() OVER (ORDER BY month DESC) AS k FROM m WHERE n >= 30),
    a AS (SELECT count(*) FILTER (k > 1) AS months, max(rate) FILTER (k = 1) AS recent, avg(rate) FILTER (k > 1) AS mean, stddev_samp(rate) FILTER (k > 1) AS sigma FROM u)
    SELECT months, round(recent, 6) AS recent, round(mean, 6) AS mean, round(sigma, 6) AS sigma, CASE WHEN months >= 3 THEN abs(recent - mean) > greatest(2 * sigma, 0.02) END AS drifted FROM a""",
)
def drift_base_rate(t: Tables) -> DataFrame:
    m = lots(t).groupBy("month").agg(F.count("n_tenders").alias("n"), F.avg((F.col("n_tenders") <= 1).cast("double")).alias("rate"))
    return rounded(stats.base_rate_band(m, "month", "n", "rate"), "recent", "mean", "sigma")


@query(
    "missingness_jump",
    f"""WITH {LOTS}, a AS (SELECT avg((n_tenders IS NULL)::INT) FILTER (pub >= DATE '2001-01-01') AS r1, avg((n_tenders IS NULL)::INT) FILTER (pub < DATE '2001-01-01') AS p1,
    avg((value IS NULL)::INT) FILTER (pub >= DATE '2001-01-01') AS r2, avg((value IS NULL)::INT) FILTER (pub < DATE '2001-01-01') AS p2 FROM lots)
    SELECT 'n_tenders' AS "column", round(r1, 6) AS recent, round(p1, 6) AS past, abs(r1 - p1) > 0.15 AS jumped FROM a UNION ALL SELECT 'value', round(r2, 6), round(p2, 6), abs(r2 - p2) > 0.15 FROM a""",
)
def missingness_jump(t: Tables) -> DataFrame:
    return rounded(stats.null_jump(lots(t), F.col("pub") >= F.lit("2001-01-01").cast("date"), ["n_tenders", "value"]), "recent", "past")


@query(
    "latency_shift",
    """WITH d AS (SELECT o_orderdate AS pub, l_shipdate::DATE - o_orderdate::DATE AS days FROM lineitem JOIN orders ON l_orderkey = o_orderkey),
    a AS (SELECT quantile_cont(days, 0.5) FILTER (pub >= TIMESTAMP '2001-01-01') AS recent, quantile_cont(days, 0.5) FILTER (pub < TIMESTAMP '2001-01-01') AS past FROM d)
    SELECT round(recent, 6) AS recent, round(past, 6) AS past, abs(recent - past) >= greatest(14, 0.25 * past) AS shifted FROM a""",
)
def latency_shift(t: Tables) -> DataFrame:
    """C4, E28."""
    d = t.lineitem.join(t.orders, F.col("l_orderkey") == F.col("o_orderkey")).select("o_orderdate", F.datediff("l_shipdate", "o_orderdate").alias("days"))
    return rounded(stats.median_shift(d, F.col("o_orderdate") >= F.lit("2001-01-01").cast("timestamp_ntz"), "days"), "recent", "past")


@query("fill_rates", f"""WITH {LOTS} SELECT 'n_tenders' AS "column", round(avg((n_tenders IS NOT NULL)::INT), 6) AS filled FROM lots UNION ALL SELECT 'value', round(avg((value IS NOT NULL)::INT), 6) FROM lots""")
def fill_rates(t: Tables) -> DataFrame:
    return rounded(stats.fill_rates(lots(t), ["n_tenders", "value"]), "filled")


_PERM = """a AS (SELECT *, row_number() OVER (PARTITION BY {by} ORDER BY {key}) AS k FROM {src}), b AS (SELECT *, row_number() OVER (PARTITION BY {by} ORDER BY md5({key}::VARCHAR || '|{seed}'), {key}) AS k FROM {src})"""


@query(
    "permutation_null",
    f"WITH {SCORED}, {_PERM.format(by='lang', key='doc_id', src='scored', seed='7')} SELECT a.doc_id, a.lang, a.quality, b.quality AS shuffled FROM a JOIN b ON a.lang = b.lang AND a.k = b.k",
)
def permutation_null(t: Tables) -> DataFrame:
    return stats.permuted(scored(t), ["lang"], "doc_id", "quality", "7").select("doc_id", "lang", "quality", "shuffled")


@query(
    "latest_revision",
    "SELECT user_id, event_type, event_id, value FROM events WHERE user_id IS NOT NULL AND event_type IS NOT NULL QUALIFY row_number() OVER (PARTITION BY user_id, event_type ORDER BY ts DESC, event_id DESC) = 1 UNION ALL SELECT user_id, event_type, event_id, value FROM events WHERE user_id IS NULL OR event_type IS NULL",
)
def latest_revision(t: Tables) -> DataFrame:
    return rv.latest_revision(t.events, ["user_id", "event_type"], [F.desc("ts"), F.desc("event_id")]).select("user_id", "event_type", "event_id", "value")


@query(
    "latest_awards",
    "WITH r AS (SELECT *, row_number() OVER (PARTITION BY user_id, event_type ORDER BY ts DESC, event_id DESC) AS k FROM events) SELECT user_id, event_type, event_id, value, value <= 1 AS low FROM r WHERE k = 1 AND value >= 0.5 AND value IS NOT NULL",
)
def latest_awards(t: Tables) -> DataFrame:
    return rv.latest_awards(t.events, ["user_id", "event_type"], [F.desc("ts"), F.desc("event_id")], F.col("value") < 0.5, "value").select("user_id", "event_type", "event_id", "value", "low")


@query(
    "newest_with_first_date",
    "SELECT user_id, event_id, value, (min(ts) OVER (PARTITION BY user_id))::DATE AS first_day FROM events QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) = 1",
)
def newest_with_first_date(t: Tables) -> DataFrame:
    x = rv.newest_with_first_date(t.events, ["user_id"], [F.desc("ts"), F.desc("event_id")], "ts")
    return x.select("user_id", "event_id", "value", F.col("ts").cast("date").alias("first_day"))


@query("first_row", "SELECT user_id, event_id FROM events QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) = 1")
def first_row(t: Tables) -> DataFrame:
    return rv.first_row(t.events, ["user_id"], [F.col("ts"), F.col("event_id")]).select("user_id", "event_id")


@query("last_write", "SELECT user_id, event_type, event_id AS seq, value FROM events QUALIFY row_number() OVER (PARTITION BY user_id, event_type ORDER BY event_id DESC) = 1")
def last_write(t: Tables) -> DataFrame:
    return rv.last_write(t.events.select("user_id", "event_type", F.col("event_id").alias("seq"), "value"), ["user_id", "event_type"], "seq").select("user_id", "event_type", "seq", "value")


@query(
    "correction_counts",
    "SELECT event_id, user_id, (sum((event_type = 'error')::INT) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING))::BIGINT AS n_corrections FROM events",
)
def correction_counts(t: Tables) -> DataFrame:
    return rv.running_count(t.events, ["user_id"], [F.col("ts"), F.col("event_id")], F.col("event_type") == "error", "n_corrections").select("event_id", "user_id", "n_corrections")


@query("revision_weights", "SELECT event_id, round(1.0::DOUBLE / count(*) OVER (PARTITION BY user_id), 6) AS weight FROM events")
def revision_weights(t: Tables) -> DataFrame:
    return rounded(rv.revision_weights(t.events, ["user_id"]).select("event_id", "weight"), "weight")


@query("first_publication", "SELECT event_id, (min(ts) OVER (PARTITION BY user_id))::DATE AS first_day FROM events")
def first_publication(t: Tables) -> DataFrame:
    return rv.first_date(t.events, ["user_id"], "ts", "f").select("event_id", F.col("f").cast("date").alias("first_day"))


@query("open_lots_anti", "SELECT o_orderkey FROM orders WHERE NOT EXISTS (SELECT 1 FROM lineitem WHERE l_orderkey = o_orderkey AND l_returnflag = 'A')")
def open_lots_anti(t: Tables) -> DataFrame:
    return rv.open_rows(t.orders.select("o_orderkey"), t.lineitem.filter("l_returnflag = 'A'").select(F.col("l_orderkey").alias("o_orderkey")), ["o_orderkey"])


@query("scoped_semi", "SELECT l_orderkey AS o_orderkey, l_linenumber, l_partkey FROM lineitem WHERE EXISTS (SELECT 1 FROM orders WHERE l_orderkey = o_orderkey AND o_orderpriority = '1-URGENT')")
def scoped_semi(t: Tables) -> DataFrame:
    li = t.lineitem.select(F.col("l_orderkey").alias("o_orderkey"), "l_linenumber", "l_partkey")
    return rv.in_scope(li, t.orders.filter("o_orderpriority = '1-URGENT'").select("o_orderkey"), ["o_orderkey"])


@query("label_join", "SELECT doc_id, lang, quality FROM documents JOIN labels USING (doc_id)")
def label_join(t: Tables) -> DataFrame:
    return rv.labelled(t.documents.select("doc_id", "lang"), t.labels, ["doc_id"], "quality")


@query("containment_check", "SELECT nation, count(*) AS n FROM (SELECT c_nationkey AS nation FROM customer EXCEPT ALL SELECT s_nationkey FROM supplier) GROUP BY 1")
def containment_check(t: Tables) -> DataFrame:
    """H6."""
    return rv.contained(t.customer.select(F.col("c_nationkey").alias("nation")), t.supplier.select("s_nationkey")).groupBy("nation").agg(F.count(F.lit(1)).alias("n"))


@query("shared_keys", "SELECT o_custkey AS k FROM orders INTERSECT SELECT user_id FROM events")
def shared_keys(t: Tables) -> DataFrame:
    """H1."""
    return t.orders.select(F.col("o_custkey").alias("k")).intersect(t.events.select("user_id"))


@query(
    "ledger_append",
    """WITH held AS (SELECT DISTINCT user_id, event_type FROM events WHERE ts < TIMESTAMP '2024-01-02'), n AS (SELECT * FROM events WHERE ts >= TIMESTAMP '2024-01-02' QUALIFY row_number() OVER (PARTITION BY user_id, event_type ORDER BY ts, event_id) = 1),
    f AS (SELECT n.* FROM n LEFT JOIN held USING (user_id, event_type) WHERE held.user_id IS NULL) SELECT user_id, event_type, event_id, 1000 + row_number() OVER (ORDER BY ts, event_id) AS seq FROM f""",
)
def ledger_append(t: Tables) -> DataFrame:
    edge = F.lit("2024-01-02").cast("timestamp_ntz")
    held, rows = t.events.filter(F.col("ts") < edge), t.events.filter(F.col("ts") >= edge)
    new = lg.append_rows(held.select("user_id", "event_type").distinct(), rows, ["user_id", "event_type"], ["ts", "event_id"])
    return lg.numbered(new, 1000, ["ts", "event_id"]).select("user_id", "event_type", "event_id", "seq")


@query("latest_prediction", "SELECT user_id, event_id AS seq, event_type AS model, value FROM events WHERE event_type <> 'error' QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY event_id DESC) = 1")
def latest_prediction(t: Tables) -> DataFrame:
    x = t.events.select("user_id", F.col("event_id").alias("seq"), F.col("event_type").alias("model"), "value")
    return lg.latest(x, ["user_id"], ["error"]).select("user_id", "seq", "model", "value")


@query(
    "ledger_titles",
    "SELECT user_id, arg_max(event_type, event_id) FILTER (event_type IS NOT NULL) AS event_type, arg_max(v, event_id) FILTER (v IS NOT NULL) AS v FROM (SELECT *, CASE WHEN value > 5 THEN value END AS v FROM events) GROUP BY 1",
)
def ledger_titles(t: Tables) -> DataFrame:
    x = t.events.withColumn("v", F.when(F.col("value") > 5, F.col("value"))).withColumn("seq", F.col("event_id"))
    return lg.titles(x, ["user_id"], ["event_type", "v"])


@query(
    "customers_derived",
    "SELECT user_id, arg_max(event_type, event_id) AS event_type, min(ts)::DATE AS created FROM events GROUP BY 1",
)
def customers_derived(t: Tables) -> DataFrame:
    return lg.customers(t.events, "user_id", "ts", "event_id", ["event_type"]).withColumn("created", F.col("created").cast("date"))


@query(
    "trial_status",
    """WITH v AS (SELECT user_id, CASE WHEN event_id % 3 = 0 THEN 'paid' ELSE 'trial' END AS plan, ts::DATE AS since, event_id AS version FROM events WHERE event_type = 'signup'), d AS (SELECT user_id, count(DISTINCT ts::DATE) AS reports FROM events WHERE event_type = 'view' GROUP BY 1),
    b AS (SELECT user_id, arg_max(plan, since::VARCHAR || lpad(version::VARCHAR, 12, '0')) AS plan, min(since) AS began FROM v WHERE since <= DATE '2024-01-20' GROUP BY 1)
    SELECT user_id, plan, began, coalesce(reports, 0) AS reports, (DATE '2024-01-20' - began)::INT AS days, plan = 'trial' AND (coalesce(reports, 0) >= 4 OR DATE '2024-01-20' - began >= 28) AS over FROM b LEFT JOIN d USING (user_id)""",
)
def trial_status(t: Tables) -> DataFrame:
    e = t.events.withColumn("day", F.col("ts").cast("date"))
    v = e.filter("event_type = 'signup'").select("user_id", F.when(F.col("event_id") % 3 == 0, "paid").otherwise("trial").alias("plan"), F.col("day").alias("since"), F.col("event_id").alias("version"))
    return lg.trial_status(v, e.filter("event_type = 'view'").select("user_id", F.col("day").alias("report")), "user_id", "since", "version", "2024-01-20")


@query(
    "verdict_diff",
    "WITH a AS (SELECT user_id, max(value) > 40 AS v FROM events WHERE event_type = 'view' GROUP BY 1), b AS (SELECT user_id, max(value) > 40 AS v FROM events WHERE event_type = 'click' GROUP BY 1) SELECT user_id, a.v AS champion, b.v AS challenger FROM a JOIN b USING (user_id) WHERE a.v <> b.v",
)
def verdict_diff(t: Tables) -> DataFrame:
    side = lambda kind: t.events.filter(F.col("event_type") == kind).groupBy("user_id").agg((F.max("value") > 40).alias("v"))
    return lg.differing(side("view"), side("click"), ["user_id"], "v")


@query(
    "paired_arms",
    "WITH g AS (SELECT l_orderkey, l_returnflag FROM lineitem), f AS (SELECT l_orderkey FROM g GROUP BY 1 HAVING count(DISTINCT l_returnflag) = 3) SELECT l_returnflag, count(*) AS n, count(DISTINCT l_orderkey) AS lots FROM g JOIN f USING (l_orderkey) GROUP BY 1",
)
def paired_arms(t: Tables) -> DataFrame:
    x = lg.paired(t.lineitem.select("l_orderkey", "l_returnflag"), ["l_orderkey"], "l_returnflag", 3)
    return x.groupBy("l_returnflag").agg(F.count(F.lit(1)).alias("n"), F.count_distinct("l_orderkey").alias("lots"))


@query(
    "verdict_outcomes",
    """WITH k AS (SELECT unnest(['pass', 'near', 'out', 'no_verdict', 'never']) AS verdict), v AS (SELECT doc_id, coalesce(CASE WHEN n_chars % 4 = 0 THEN 'pass' WHEN n_chars % 4 = 1 THEN 'near' WHEN n_chars % 4 = 2 THEN 'out' END, 'no_verdict') AS verdict FROM documents),
    n AS (SELECT verdict, count(*) AS picks, count(quality) AS graded, avg(quality) AS lonely_rate, count(*) FILTER (toxic = 1) AS own_wins FROM v LEFT JOIN labels USING (doc_id) GROUP BY 1)
    SELECT verdict, coalesce(picks, 0) AS picks, coalesce(graded, 0) AS graded, round(lonely_rate, 6) AS lonely_rate, coalesce(own_wins, 0) AS own_wins FROM k LEFT JOIN n USING (verdict)""",
)
def verdict_outcomes(t: Tables) -> DataFrame:
    m = F.col("n_chars") % 4
    v = t.documents.select("doc_id", F.when(m == 0, "pass").when(m == 1, "near").when(m == 2, "out").alias("verdict"))
    g = t.labels.select("doc_id", F.col("quality").alias("label"), (F.col("toxic") == 1).alias("own_win"))
    return rounded(lg.outcomes(v, g, ["doc_id"], ["pass", "near", "out", "no_verdict", "never"]), "lonely_rate")


@query(
    "arm_weekly",
    """SELECT event_type AS arm, isoyear(ts)::VARCHAR || '-W' || lpad(weekofyear(ts)::VARCHAR, 2, '0') AS week, count(*) FILTER (value > 20) AS flagged, count(*) FILTER (value > 20 AND event_id % 2 = 0) AS hits FROM events GROUP BY 1, 2""",
)
def arm_weekly(t: Tables) -> DataFrame:
    return ex.weekly(t.events.withColumnRenamed("event_type", "arm"), "arm", "ts", F.col("value") > 20, F.col("event_id") % 2 == 0)


@query(
    "rejection_rule",
    f"""WITH {WINS}, w AS (SELECT region, count(*) FILTER (tenders <= 1) AS k_new, count(*) AS n_new, count(*) FILTER (size = 'A') AS k_old, count(*) AS n_old, count(*) FILTER (value > 60000)::DOUBLE / count(*) AS leakage FROM wins GROUP BY 1),
    i AS (SELECT *, (k_new::DOUBLE / n_new + 3.8416 / (2 * n_new) + 1.96 * sqrt(k_new::DOUBLE / n_new * (1 - k_new::DOUBLE / n_new) / n_new + 3.8416 / (4.0 * n_new * n_new))) / (1 + 3.8416 / n_new) AS high,
    (k_old::DOUBLE / n_old + 3.8416 / (2 * n_old) - 1.96 * sqrt(k_old::DOUBLE / n_old * (1 - k_old::DOUBLE / n_old) / n_old + 3.8416 / (4.0 * n_old * n_old))) / (1 + 3.8416 / n_old) AS low FROM w),
    g AS (SELECT count(*) AS n, avg((leakage > 0.022)::INT) AS leaking, bool_and(high < low) AS loses FROM i) SELECT n, round(leaking, 6) AS leaking, loses, leaking > 0.5 OR (n > 1 AND loses) AS rejected FROM g""",
)
def rejection_rule(t: Tables) -> DataFrame:
    w = wins(t).groupBy("region").agg(
        F.count_if(F.col("tenders") <= 1).alias("k_new"), F.count(F.lit(1)).alias("n_new"), F.count_if(F.col("size") == "A").alias("k_old"), F.count(F.lit(1)).alias("n_old"), F.avg((F.col("value") > 60000).cast("double")).alias("leakage")
    )
    return rounded(ex.rejects(w), "leaking")


@query(
    "guardrail",
    f"""WITH {SCORED}, g AS (SELECT count(*) AS n, count(*) FILTER (toxic = 1) AS k FROM scored), q AS (SELECT *, n::DOUBLE AS m, k::DOUBLE / n AS p FROM g)
    SELECT n, k, round(greatest((p + 3.8416 / (2 * m) - 1.96 * {_W}) / (1 + 3.8416 / m), 0), 6) AS low, round(least((p + 3.8416 / (2 * m) + 1.96 * {_W}) / (1 + 3.8416 / m), 1), 6) AS high, n >= 30 AS enough FROM q""",
)
def guardrail(t: Tables) -> DataFrame:
    return rounded(ex.guardrail(scored(t), F.col("toxic") == 1), "low", "high")


@query(
    "latest_labels",
    "SELECT user_id, arg_max(event_type, event_id) AS event_type FROM events GROUP BY 1",
)
def latest_labels(t: Tables) -> DataFrame:
    return ex.latest_labels(t.events, ["user_id"], "event_type", "event_id")


@query("one_hot_guard", """SELECT 'p_type' AS "column", count(DISTINCT coalesce(p_type, '__NA__')) AS "values", count(DISTINCT p_type) <= 1024 AS one_hot FROM part UNION ALL SELECT 'p_partkey', count(DISTINCT p_partkey), count(DISTINCT p_partkey) <= 1024 FROM part""")
def one_hot_guard(t: Tables) -> DataFrame:
    return ft.one_hot_guard(t.part, ["p_type", "p_partkey"])


@query(
    "multihot_fit",
    "WITH v AS (SELECT DISTINCT l_orderkey, p_brand FROM lineitem JOIN part ON l_partkey = p_partkey), n AS (SELECT greatest(30, ceil(0.0015 * count(DISTINCT l_orderkey))) AS need FROM lineitem) SELECT p_brand, count(*) AS support FROM v, n GROUP BY 1, need HAVING count(*) >= need",
)
def multihot_fit(t: Tables) -> DataFrame:
    v = t.lineitem.join(t.part, F.col("l_partkey") == F.col("p_partkey")).select("l_orderkey", "p_brand")
    return ft.multihot_fit(v, ["l_orderkey"], "p_brand")


@query(
    "multihot_apply",
    """WITH g AS (SELECT user_id, list_distinct(list(event_type)) AS k FROM events GROUP BY 1) SELECT user_id, list_contains(k, 'click')::INT AS kind__has_click, list_contains(k, 'view')::INT AS kind__has_view,
    len(list_filter(k, lambda x: x NOT IN ('click', 'view')))::INT AS kind__n_rare, len(k)::INT AS kind__n FROM g""",
)
def multihot_apply(t: Tables) -> DataFrame:
    g = t.events.groupBy("user_id").agg(F.collect_list("event_type").alias("k"))
    return ft.multihot_apply(g, "k", ["view", "click"], "kind").drop("k")


@query("code_levels", "SELECT DISTINCT p_partkey, level, left(p_brand, level) AS value FROM part, (SELECT unnest([3, 6, 7]) AS level) WHERE length(p_brand) >= level")
def code_levels(t: Tables) -> DataFrame:
    return ft.levels(t.part, ["p_partkey"], "p_brand", (3, 6, 7))


@query(
    "target_baseline",
    """WITH x AS (SELECT l_orderkey, l_linenumber, p_brand, (l_returnflag = 'R')::INT AS y, l_quantity AS w, l_orderkey % 5 = 0 AS test FROM lineitem JOIN part ON l_partkey = p_partkey), r AS (SELECT p_brand, sum(w * y) / sum(w) AS rate FROM x WHERE NOT test AND p_brand <> 'Brand#1' GROUP BY 1),
    b AS (SELECT sum(w * y) / sum(w) AS base FROM x WHERE NOT test AND p_brand <> 'Brand#1') SELECT l_orderkey, l_linenumber, round(coalesce(rate, base), 6) AS baseline FROM x LEFT JOIN r USING (p_brand), b WHERE test""",
)
def target_baseline(t: Tables) -> DataFrame:
    x = t.lineitem.join(t.part, F.col("l_partkey") == F.col("p_partkey")).select("l_orderkey", "l_linenumber", "p_brand", (F.col("l_returnflag") == "R").cast("int").alias("y"), F.col("l_quantity").alias("w"))
    train = x.filter("l_orderkey % 5 <> 0 AND p_brand <> 'Brand#1'")
    return rounded(ft.target_baseline(train, x.filter("l_orderkey % 5 = 0"), "p_brand", "y", "w").select("l_orderkey", "l_linenumber", "baseline"), "baseline")
