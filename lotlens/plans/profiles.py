"""Queries of profiles, traces, records and ranks."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from ..functions import scalars as fn
from ..operators import ledger as lg, market as mk, profiles as pf
from .base import LOTS, MONTHS, Tables, lots, query, rounded
from .language import _COMP, _components

#: Lines as awards: the supplier and every third time the next one win; lots are parts.
_AWARDS = "awards AS (SELECT l_partkey AS lot, l_shipdate::DATE AS day, l_orderkey AS o, l_linenumber AS ln, CASE WHEN l_suppkey % 3 = 0 THEN ['Firm ' || l_suppkey, ' Firm ' || (l_suppkey + 1)] WHEN l_suppkey % 7 = 0 THEN [' '] ELSE ['Firm ' || l_suppkey] END AS winners FROM lineitem)"
_CALLS = "calls AS (SELECT p_partkey AS lot, p_brand AS code, CASE WHEN p_size > 5 THEN 'pub-' || (p_partkey % 1500) END AS pub, p_retailprice AS price FROM part WHERE p_partkey % 10 <> 3)"


def _awards(t: Tables) -> DataFrame:
    s = F.col("l_suppkey")
    name = lambda k, p="Firm ": F.concat(F.lit(p), k.cast("string"))
    w = F.when(s % 3 == 0, F.array(name(s), name(s + 1, " Firm "))).when(s % 7 == 0, F.array(F.lit(" "))).otherwise(F.array(name(s)))
    return t.lineitem.select(F.col("l_partkey").alias("lot"), F.col("l_shipdate").cast("date").alias("day"), F.col("l_orderkey").alias("o"), F.col("l_linenumber").alias("ln"), w.alias("winners"))


def _calls(t: Tables) -> DataFrame:
    return t.part.filter("p_partkey % 10 <> 3").select(F.col("p_partkey").alias("lot"), F.col("p_brand").alias("code"), F.when(F.col("p_size") > 5, F.concat(F.lit("pub-"), (F.col("p_partkey") % 1500).cast("string"))).alias("pub"), F.col("p_retailprice").alias("price"))


@query("firm_win_rows", f"WITH {_AWARDS}, {_CALLS} SELECT winner, code, count(*) AS n FROM (SELECT lot, unnest(winners) AS winner FROM awards) JOIN calls USING (lot) GROUP BY 1, 2")
def firm_win_rows(t: Tables) -> DataFrame:
    """C3."""
    return pf.firm_win_rows(_awards(t), _calls(t), ["lot"], "winners", ["code"]).groupBy("winner", "code").agg(F.count(F.lit(1)).alias("n"))


@query("wins_of", f"WITH {_AWARDS}, {_CALLS} SELECT pub, min(lot) AS lot FROM awards JOIN calls USING (lot) WHERE pub IS NOT NULL AND list_has_any(winners, ['Firm 3', 'Firm 8']) GROUP BY 1")
def wins_of(t: Tables) -> DataFrame:
    """C5."""
    return pf.wins_of(_awards(t), _calls(t), ["Firm 3", "Firm 8"], ["lot"], "winners", "pub", "price").select("pub", "lot")


@query("firm_codes", f"WITH {_AWARDS}, {_CALLS} SELECT firm, code, count(DISTINCT lot) AS n FROM (SELECT lot, winners[1] AS firm FROM awards) JOIN calls USING (lot) GROUP BY 1, 2")
def firm_codes(t: Tables) -> DataFrame:
    """C6."""
    return pf.firm_codes(_awards(t).select("lot", F.col("winners")[0].alias("firm")), _calls(t), ["lot"], "firm", "code")


@query(
    "winner_map",
    f"WITH {_AWARDS}, l AS (SELECT lot, list_sort(list_distinct(list_filter(list_transform(winners, lambda x: trim(x)), lambda x: x <> ''))) AS w FROM awards QUALIFY row_number() OVER (PARTITION BY lot ORDER BY day DESC, o DESC, ln DESC) = 1) SELECT lot, array_to_string(w, ';') AS winners FROM l WHERE len(w) > 0",
)
def winner_map(t: Tables) -> DataFrame:
    """L8."""
    return pf.winner_map(_awards(t), ["lot"], [F.desc("day"), F.desc("o"), F.desc("ln")], "winners").select("lot", F.array_join("winners", ";").alias("winners"))


_OWN = "own AS (SELECT DISTINCT o_custkey AS sub, o_orderkey AS ref FROM orders WHERE o_orderstatus = 'O'), learned AS (SELECT o_custkey AS sub, o_orderkey AS ref, o_orderdate::DATE AS day FROM orders WHERE o_orderstatus = 'F')"


def _own(t: Tables) -> tuple[DataFrame, DataFrame]:
    o = t.orders.select(F.col("o_custkey").alias("sub"), F.col("o_orderkey").alias("ref"), F.col("o_orderdate").cast("date").alias("day"), "o_orderstatus")
    return o.filter("o_orderstatus = 'O'").select("sub", "ref").distinct(), o.filter("o_orderstatus = 'F'").drop("o_orderstatus")


@query("profile_references", f"WITH {_OWN} SELECT sub, ref FROM own UNION SELECT sub, ref FROM learned WHERE day <= DATE '1997-06-30'")
def profile_references(t: Tables) -> DataFrame:
    """H2."""
    return pf.profile_references(*_own(t), "sub", "ref", "day", "1997-06-30")


@query(
    "profiles",
    f"""WITH {_OWN}, lots AS (SELECT o_orderkey AS ref, o_orderpriority AS code, '  Office  ' || (o_custkey % 7) AS buyer, CASE WHEN o_totalprice > 100000 THEN 'works' ELSE '' END AS kind FROM orders WHERE o_orderkey % 9 <> 0),
    refs AS (SELECT sub, ref FROM own UNION SELECT sub, ref FROM learned WHERE day <= DATE '1997-06-30'), h AS (SELECT * FROM refs JOIN lots USING (ref)),
    a AS (SELECT sub, count(DISTINCT ref) AS refs, string_agg(DISTINCT code, ';' ORDER BY code) FILTER (code IN ('1-URGENT', '2-HIGH')) AS codes, string_agg(DISTINCT 'office ' || trim(buyer)[-1:], ';' ORDER BY 'office ' || trim(buyer)[-1:]) AS buyers, string_agg(DISTINCT kind, ';' ORDER BY kind) FILTER (kind <> '') AS types FROM h GROUP BY 1),
    m AS (SELECT sub, string_agg(DISTINCT ref::VARCHAR, ';' ORDER BY ref::VARCHAR) AS missing FROM own WHERE ref NOT IN (SELECT ref FROM lots) GROUP BY 1)
    SELECT s.sub, coalesce(refs, 0) AS refs, coalesce(codes, '') AS codes, coalesce(buyers, '') AS buyers, coalesce(types, '') AS types, coalesce(missing, '') AS missing FROM (SELECT DISTINCT sub FROM own) s LEFT JOIN a USING (sub) LEFT JOIN m USING (sub)""",
)
def profiles(t: Tables) -> DataFrame:
    """J10."""
    o = t.orders.filter("o_orderkey % 9 <> 0").select(
        F.col("o_orderkey").alias("ref"), F.col("o_orderpriority").alias("code"), F.concat(F.lit("  Office  "), (F.col("o_custkey") % 7).cast("string")).alias("buyer"), F.when(F.col("o_totalprice") > 100000, "works").otherwise("").alias("kind")
    )
    trusted = t.spark.createDataFrame([("1-URGENT",), ("2-HIGH",)], "code string")
    p = pf.build_profiles(*_own(t), o, "sub", "ref", "day", "1997-06-30", "code", "buyer", "kind", trusted)
    return p.select("sub", "refs", *[F.array_join(F.array_sort(F.col(c).cast("array<string>")), ";").alias(c) for c in ("codes", "buyers", "types", "missing")])


@query(
    "mute_profiles",
    "WITH k AS (SELECT c_custkey, list(o_orderpriority) FILTER (o_orderstatus = 'F') AS words, list(o_orderkey) FILTER (o_totalprice > 200000) AS core, count(o_orderkey) AS refs FROM customer LEFT JOIN orders ON o_custkey = c_custkey GROUP BY 1) SELECT c_custkey, 'no lexicon and no core trade root from ' || refs || ' reference(s)' AS reason FROM k WHERE words IS NULL AND core IS NULL",
)
def mute_profiles(t: Tables) -> DataFrame:
    """J10."""
    k = t.customer.join(t.orders, F.col("o_custkey") == F.col("c_custkey"), "left").groupBy("c_custkey").agg(
        F.collect_list(F.when(F.col("o_orderstatus") == "F", F.col("o_orderpriority"))).alias("words"), F.collect_list(F.when(F.col("o_totalprice") > 200000, F.col("o_orderkey"))).alias("core"), F.count("o_orderkey").alias("refs")
    )
    return k.select("c_custkey", pf.mute_reason(F.col("words"), F.col("core"), F.col("refs")).alias("reason")).filter("reason IS NOT NULL")


_N = lambda x: f"printf('%.3f', {x})"


@query(
    "lot_trace",
    f"""WITH {_COMP} SELECT doc_id, coalesce(nullif(concat_ws(' / ', CASE WHEN NOT coalesce(type_match, true) THEN 'other type' END, CASE WHEN same_buyer THEN 'same buyer, text abstains' END, CASE WHEN text >= 0.7 THEN 'text pass ' || {_N("text")} END,
    CASE WHEN hard > 0 THEN CASE WHEN hard >= 0.825 THEN 'hard pass ' ELSE 'hard ' END || {_N("hard")} END, CASE WHEN soft > 0 THEN CASE WHEN soft >= 0.725 THEN 'soft pass ' ELSE 'soft ' END || {_N("soft")} END,
    CASE WHEN has_hard_labels THEN 'trade-read ' || {_N("own_read")} || '/' || {_N("best_read")} || CASE WHEN own_read >= best_read THEN ' corroborated' ELSE ' not corroborated' END END, CASE WHEN foreign_read - own_read >= 0.225 THEN 'other trade' END), ''), 'no channel') AS path FROM comp""",
)
def lot_trace(t: Tables) -> DataFrame:
    """J15."""
    return pf.trace(_components(t)).select("doc_id", "path")


@query(
    "as_of_profiles",
    "WITH w AS (SELECT DISTINCT l_suppkey AS firm, l_orderkey AS ref FROM lineitem WHERE l_shipdate::DATE < DATE '1996-06-01') SELECT s_name AS sub, string_agg(ref::VARCHAR, ';' ORDER BY ref) AS refs FROM supplier JOIN w ON firm = s_suppkey GROUP BY 1",
)
def as_of_profiles(t: Tables) -> DataFrame:
    """L6."""
    subs = t.supplier.select(F.col("s_name").alias("sub"), F.col("s_suppkey").alias("firm"), F.lit(0.5).alias("min_relevance"))
    wins = t.lineitem.select(F.col("l_suppkey").alias("firm"), F.col("l_orderkey").alias("ref"), F.col("l_shipdate").cast("date").alias("day"))
    return pf.as_of_profiles(subs, wins, "sub", "firm", "ref", "day", "1996-06-01").select("sub", F.array_join("profile_refs", ";").alias("refs"))


@query(
    "as_of_training",
    "WITH r AS (SELECT l_orderkey, l_linenumber, l_shipdate::DATE AS day FROM lineitem WHERE l_shipdate::DATE < DATE '1998-01-01'), f AS (SELECT *, min(day) OVER w AS first, count(*) OVER w AS n FROM r WINDOW w AS (PARTITION BY l_orderkey)) SELECT l_orderkey, l_linenumber, round(1.0 / n, 6)::DOUBLE AS weight FROM f WHERE first >= DATE '1996-01-01'",
)
def as_of_training(t: Tables) -> DataFrame:
    """L4."""
    r = t.lineitem.select("l_orderkey", "l_linenumber", F.col("l_shipdate").cast("date").alias("day"))
    return rounded(pf.as_of_training(r, ["l_orderkey"], "day", "1998-01-01", 24).select("l_orderkey", "l_linenumber", "weight"), "weight")


_ASKED = ["Customer#000000007", "customer#000000008", "#00000001", "nobody"]


@query(
    "matched_names",
    f"""WITH a AS (SELECT unnest({_ASKED}) AS ask), k AS (SELECT c_name AS name FROM customer), p AS (SELECT ask, list_sort(list(DISTINCT name)) AS part, max((name = ask)::INT) = 1 AS exact, list(DISTINCT name) FILTER (lower(name) = lower(ask)) AS loose FROM a JOIN k ON contains(lower(name), lower(ask)) GROUP BY 1),
    m AS (SELECT a.ask, CASE WHEN exact THEN a.ask WHEN len(loose) = 1 THEN loose[1] END AS match, part FROM a LEFT JOIN p USING (ask)) SELECT ask, match, CASE WHEN match IS NULL THEN coalesce(array_to_string(part[1:6], ';'), '') END AS candidates FROM m""",
)
def matched_names(t: Tables) -> DataFrame:
    """B36."""
    asked = t.spark.createDataFrame([(x,) for x in _ASKED], "ask string")
    return pf.matched_names(asked, t.customer, "ask", "c_name").select("ask", "match", F.array_join("candidates", ";").alias("candidates"))


@query(
    "resolved_trades",
    """WITH a AS (SELECT unnest(['STANDARD', 'econ', 'o', 'Dach', 'Größe', 'xy']) AS ask), k AS (SELECT DISTINCT p_type AS trade FROM part), p AS (SELECT ask, max(CASE WHEN trade = ask THEN trade END) AS exact, list_sort(list(DISTINCT trade) FILTER (trade IS NOT NULL)) AS part FROM a LEFT JOIN k ON contains(lower(trade), lower(ask)) GROUP BY 1),
    w AS (SELECT *, replace(replace(replace(replace(lower(ask), 'ä', 'ae'), 'ö', 'oe'), 'ü', 'ue'), 'ß', 'ss') AS word, coalesce(len(list_filter(part, lambda x: x IS NOT NULL)), 0) AS n FROM p)
    SELECT ask, CASE WHEN exact IS NOT NULL THEN exact WHEN n = 1 THEN part[1] WHEN n = 0 AND length(word) >= 5 THEN word END AS trade, CASE WHEN exact IS NOT NULL THEN 'exact' WHEN n = 1 THEN 'part' WHEN n > 1 THEN 'ambiguous' WHEN length(word) >= 5 THEN 'word' ELSE 'too short' END AS kind FROM w""",
)
def resolved_trades(t: Tables) -> DataFrame:
    """B37."""
    asked = t.spark.createDataFrame([(x,) for x in ("STANDARD", "econ", "o", "Dach", "Größe", "xy")], "ask string")
    return pf.resolved_trades(asked, t.part.select(F.col("p_type").alias("trade")).distinct(), "ask", "trade")


@query(
    "value_sizes",
    """WITH v AS (SELECT o_orderkey, CASE WHEN o_orderkey % 10 = 0 THEN o_totalprice * 10 WHEN o_orderkey % 10 = 1 THEN 0 ELSE o_totalprice END AS v, ['DE2', 'dea12', 'FR1', 'DEG0Z'][(o_orderkey % 4 + 1)::INT] AS code FROM orders), r AS (SELECT *, round_even(v / CASE WHEN v >= 300000 THEN 50000 ELSE 10000 END, 0)::BIGINT * CASE WHEN v >= 300000 THEN 50000 ELSE 10000 END AS near FROM v)
    SELECT o_orderkey, CASE WHEN v >= 1000000 THEN 'rund ' || replace(replace(printf('%.1f', v / 1000000), '.', ','), ',0', '') || ' Mio. €' WHEN v > 0 THEN 'rund ' || replace(format('{:,}', near), ',', '.') || ' €' END AS size, ['Bayern', 'Nordrhein-Westfalen', NULL, 'Thüringen'][(o_orderkey % 4 + 1)::INT] AS land FROM r""",
)
def value_sizes(t: Tables) -> DataFrame:
    """B32."""
    k = F.col("o_orderkey")
    v = F.when(k % 10 == 0, F.col("o_totalprice") * 10).when(k % 10 == 1, 0.0).otherwise(F.col("o_totalprice"))
    code = F.element_at(F.array(*[F.lit(x) for x in ("DE2", "dea12", "FR1", "DEG0Z")]), (k % 4 + 1).cast("int"))
    return t.orders.select("o_orderkey", pf.value_size(v).alias("size"), pf.land_of(code).alias("land"))


@query(
    "works_of_titles",
    """SELECT p_partkey, CASE p_partkey % 4 WHEN 0 THEN p_name WHEN 1 THEN 'Dach ' || p_name WHEN 2 THEN p_name END AS work FROM part""",
)
def works_of_titles(t: Tables) -> DataFrame:
    """Streets, lot numbers, codes, brackets and generic words go."""
    k, name = F.col("p_partkey"), F.col("p_name")
    no = k.cast("string")
    title = (
        F.when(k % 4 == 0, F.concat(F.lit("Los "), no, F.lit(": "), name, F.lit(" (Haus "), no, F.lit(")"))).when(k % 4 == 1, F.concat(F.lit("Dach - "), name, F.lit(", Hauptstraße 12a")))
        .when(k % 4 == 2, F.concat(F.lit("Arbeiten und "), name, F.lit(" VE12 "), F.lit("2026-17"))).otherwise(F.lit("Elektroarbeiten"))
    )
    return t.part.select("p_partkey", pf.work_of(title, F.lit("Elektro Technik")).alias("work"))


@query(
    "rank_regions",
    f"""WITH {MONTHS}, h AS (SELECT l.*, buyer % 25 AS region, covered, mature FROM lots l LEFT JOIN months USING (month)), c AS (SELECT priority AS trade, region, count(*) FILTER (covered) AS lots, median(value) AS median_value, count(*) FILTER (mature AND n_tenders IS NOT NULL) AS awarded, avg((n_tenders <= 1)::INT) FILTER (mature AND n_tenders IS NOT NULL) AS low_rate FROM h GROUP BY 1, 2)
    SELECT trade, region, lots, round(lots::DOUBLE / (SELECT count(*) FROM months WHERE covered), 1) AS per_month, round(median_value, 4) AS median_value, awarded, round(low_rate, 6) AS low_rate FROM c WHERE lots >= 8""",
)
def rank_regions(t: Tables) -> DataFrame:
    """E13."""
    x = lots(t)
    matched = x.select("lot", F.col("priority").alias("trade"))
    out = pf.rank_regions(x.withColumn("region", F.col("buyer") % 25), matched, mk.coverage(x), "lot", "trade", "region", "value", "n_tenders", 8)
    return rounded(out, "low_rate").withColumn("median_value", F.round("median_value", 4))


@query(
    "track_record",
    f"""WITH {LOTS}, g AS (SELECT lot, value % 1000 AS score, value % 1000 >= 700 AS f, n_tenders <= 2 AS y, buyer % 40 AS trade, priority AS tier FROM lots WHERE n_tenders IS NOT NULL AND pub >= DATE '1996-01-01'),
    e AS (SELECT 'all' AS view, '' AS value, score, lot, f, y FROM g UNION ALL SELECT 'trade', trade::VARCHAR, score, lot, f, y FROM g UNION ALL SELECT 'tier', tier, score, lot, f, y FROM g),
    r AS (SELECT *, row_number() OVER (PARTITION BY view, value ORDER BY score DESC, lot) AS place, count(*) OVER (PARTITION BY view, value) AS n FROM e), k AS (SELECT *, place <= greatest(1, round_even(n * 0.2::DOUBLE, 0)::INT) AS top FROM r),
    s AS (SELECT view, value, count(*) AS n, count(*) FILTER (top) AS k, avg(y::INT) FILTER (top) AS hit, avg(y::INT) AS base, count(*) FILTER (f) AS flags, count(*) FILTER (f AND y) AS r, count(*) FILTER (y) AS p FROM k GROUP BY 1, 2)
    SELECT view, value, n, k, round(hit, 6) AS hit, round(base, 6) AS base, round(hit / nullif(base, 0), 6) AS lift, flags, round(r::DOUBLE / nullif(flags, 0), 6) AS precision, round(r::DOUBLE / nullif(p, 0), 6) AS coverage FROM s WHERE view <> 'trade' OR n >= 30""",
)
def track_record(t: Tables) -> DataFrame:
    """E21."""
    x = lots(t).filter("n_tenders IS NOT NULL").withColumn("score", F.col("value") % 1000).withColumn("trade", F.col("buyer") % 40)
    return rounded(pf.track_record(x, "1996-01-01", "pub", "trade", "priority", "score", "lot", F.col("score") >= 700, F.col("n_tenders") <= 2), "hit", "base", "lift", "precision", "coverage")


@query(
    "outcome_snapshot",
    f"""WITH {LOTS}, o AS (SELECT status AS verdict, count(n_tenders) AS graded, avg((n_tenders <= 1)::INT) AS rate, count(*) FILTER (n_tenders = 1) AS own FROM lots WHERE status <> 'P' GROUP BY 1), v AS (SELECT DISTINCT status AS verdict FROM lots UNION SELECT 'never')
    SELECT '2026-01-01' AS ts, verdict, coalesce(graded, 0) AS graded, round(coalesce(rate, 0), 6)::DOUBLE AS lonely_rate, coalesce(own, 0) AS own_wins, round(coalesce(own::DOUBLE / nullif(graded, 0), 0), 6) AS own_rate, 7 AS picks_total, 9 AS verdicts_total FROM v LEFT JOIN o USING (verdict) WHERE verdict <> 'O'""",
)
def outcome_snapshot(t: Tables) -> DataFrame:
    """One verdict is already on record at this time."""
    x = lots(t)
    o = x.filter("status <> 'P'").groupBy(F.col("status").alias("verdict")).agg(F.count("n_tenders").alias("graded"), F.avg((F.col("n_tenders") <= 1).cast("double")).alias("lonely_rate"), F.count_if(F.col("n_tenders") == 1).alias("own_wins"))
    verdicts = x.select(F.col("status").alias("verdict")).distinct().union(t.spark.createDataFrame([("never",)], "verdict string"))
    held = t.spark.createDataFrame([("2026-01-01", "O"), ("2025-01-01", "F")], "ts string, verdict string")
    return rounded(pf.snapshot(o, verdicts, held, "2026-01-01", 7, 9), "lonely_rate", "own_rate")


@query("category_rates", f"WITH {LOTS} SELECT buyer % 100 AS category, count(*) AS n, round(avg((n_tenders <= 1)::INT), 6) AS rate FROM lots WHERE n_tenders IS NOT NULL GROUP BY 1 HAVING count(*) >= 12")
def category_rates(t: Tables) -> DataFrame:
    """E53."""
    x = lots(t).filter("n_tenders IS NOT NULL").withColumn("category", F.col("buyer") % 100)
    return rounded(pf.category_rates(x, "category", F.col("n_tenders") <= 1, 12), "rate")


@query(
    "funnel_counts",
    f"WITH {LOTS} SELECT 0 AS step, 'all' AS name, count(*) AS left FROM lots UNION ALL SELECT 1, 'known', count(*) FILTER (n_tenders IS NOT NULL) FROM lots UNION ALL SELECT 2, 'large', count(*) FILTER (n_tenders IS NOT NULL AND value > 100000) FROM lots UNION ALL SELECT 3, 'lonely', count(*) FILTER (n_tenders <= 1 AND value > 100000) FROM lots".replace("AS left", 'AS "left"'),
)
def funnel_counts(t: Tables) -> DataFrame:
    """E53."""
    return pf.funnel(lots(t), [("all", F.lit(True)), ("known", F.col("n_tenders").isNotNull()), ("large", F.col("value") > 100000), ("lonely", F.col("n_tenders") <= 1)])


@query(
    "ledger_readings",
    "WITH l AS (SELECT event_id AS seq, user_id, event_type, value FROM events), w AS (SELECT DISTINCT user_id FROM events WHERE event_type = 'signup') SELECT user_id, count(*) AS n, max(seq) AS version FROM l WHERE user_id IN (SELECT user_id FROM w) GROUP BY 1",
)
def ledger_readings(t: Tables) -> DataFrame:
    """K3, K4, K7."""
    held = t.events.select(F.col("event_id").alias("seq"), "user_id", "event_type", "value")
    return lg.of_lots(held, held.filter("event_type = 'signup'"), ["user_id"]).groupBy("user_id").agg(F.count(F.lit(1)).alias("n"), F.max("seq").alias("version"))


@query(
    "first_seen",
    "WITH r AS (SELECT md5(event_type || (user_id % 50)) AS fp, min(ts)::DATE AS first_seen FROM events GROUP BY 1) SELECT * FROM r WHERE fp NOT IN (SELECT md5(event_type || (user_id % 50)) FROM events WHERE event_type = 'click')",
)
def first_seen(t: Tables) -> DataFrame:
    """K12."""
    e = t.events.select(F.md5(F.concat("event_type", (F.col("user_id") % 50).cast("string")).cast("binary")).alias("fp"), F.col("ts").cast("date").alias("day"), "event_type")
    return lg.first_seen(e.filter("event_type = 'click'"), e, "fp", "day")


@query("identities", "SELECT o_orderkey, o_custkey AS c, c_name AS name FROM orders LEFT JOIN customer ON c_custkey = o_custkey AND c_custkey % 3 <> 0")
def identities(t: Tables) -> DataFrame:
    """K9."""
    names = t.customer.filter("c_custkey % 3 <> 0").select(F.col("c_custkey").alias("c"), F.col("c_name").alias("name"))
    return lg.with_identity(t.orders.select("o_orderkey", F.col("o_custkey").alias("c")), names, "c")


@query("distinct_pairs", "SELECT DISTINCT o_custkey, o_orderpriority FROM orders")
def distinct_pairs(t: Tables) -> DataFrame:
    """D8."""
    return pf.rv.distinct_pairs(t.orders, "o_custkey", "o_orderpriority")


@query(
    "scalar_forms",
    """SELECT p_partkey, left(p_brand, 3) AS head, replace(lower(p_type), ' ', '-') AS slug, CASE WHEN p_size = 0 THEN NULL ELSE p_size END AS filled, p_size > 10 OR p_partkey % 3 = 0 AS in_time FROM part""",
)
def scalar_forms(t: Tables) -> DataFrame:
    """B26, B29, B32."""
    want = F.when(F.col("p_partkey") % 3 == 0, 0).otherwise(11)
    return t.part.select("p_partkey", fn.nuts1(F.col("p_brand")).alias("head"), fn.slug(F.col("p_type")).alias("slug"), F.nullif("p_size", F.lit(0)).alias("filled"), fn.deadline_ok(F.col("p_size"), want).alias("in_time"))


