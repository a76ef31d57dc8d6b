"""Market queries."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from ..functions import scalars as fn
from ..operators import market as mk, selection as sel, stats
from .base import LOTS, MONTHS, WINS, Tables, lots, query, r6, rounded, wins

TRADES = (("ring", ("ring",), ()), ("bolt", ("bolt", "nut"), ()), ("red", ("red",), ("widget",)), ("blue", ("blue",), ()))


def trades(t: Tables) -> DataFrame:
    return t.spark.createDataFrame([(a, list(b), list(c)) for a, b, c in TRADES], "trade string, terms array<string>, exclude array<string>")


def trade_lots(t: Tables) -> DataFrame:
    """(trade, lot): lots with a line whose part name fits the trade. Part names meet the trades, not the lines."""
    parts = mk.match_trades(t.part.select("p_partkey", "p_name"), trades(t), "p_name").select("p_partkey", "trade")
    return t.lineitem.select("l_orderkey", "l_partkey").join(parts, F.col("l_partkey") == F.col("p_partkey")).select("trade", F.col("l_orderkey").alias("lot")).distinct()


TRADE_LOTS = """
tp AS (
  SELECT p_partkey, trade FROM part, (VALUES ('ring', ['ring'], []::VARCHAR[]), ('bolt', ['bolt', 'nut'], []), ('red', ['red'], ['widget']), ('blue', ['blue'], [])) AS v(trade, terms, ex)
  WHERE len(list_filter(terms, lambda x: contains(lower(p_name), x))) > 0 AND len(list_filter(ex, lambda x: contains(lower(p_name), x))) = 0),
tl AS (SELECT DISTINCT trade, l_orderkey AS lot FROM lineitem JOIN tp ON l_partkey = p_partkey)"""


@query(
    "market_trade_summary",
    f"""WITH {MONTHS}, {TRADE_LOTS},
x AS (SELECT tl.trade, l.*, covered, mature FROM tl JOIN lots l USING (lot) JOIN months USING (month))
SELECT trade, count(*) AS lots, round(count(*) FILTER (covered) * 1.0 / (SELECT count(*) FROM months WHERE covered), 6) AS per_month,
       round(quantile_cont(value, 0.5), 6) AS median_value, count(n_tenders) FILTER (mature) AS resolved,
       round(avg((n_tenders <= 1)::INT) FILTER (mature AND n_tenders IS NOT NULL), 6) AS low_rate FROM x GROUP BY trade""",
)
def market_trade_summary(t: Tables) -> DataFrame:
    """The flagship: volume, median value and low-bid share of each trade."""
    all_lots = lots(t)
    months = mk.coverage(all_lots)
    covered = F.broadcast(months.agg(F.count_if("covered").alias("m")))
    x = trade_lots(t).join(all_lots, "lot").join(F.broadcast(months.select("month", "covered", "mature")), "month")
    n = x.groupBy("trade").agg(
        F.count(F.lit(1)).alias("lots"), F.count_if("covered").alias("c"), F.percentile("value", 0.5).alias("median_value"), F.count(F.when(F.col("mature"), F.col("n_tenders"))).alias("resolved"),
        F.avg(F.when(F.col("mature"), (F.col("n_tenders") <= 1).cast("double"))).alias("low_rate"),
    )
    return n.crossJoin(covered).select("trade", "lots", r6(F.col("c") / F.col("m")).alias("per_month"), r6("median_value").alias("median_value"), "resolved", r6("low_rate").alias("low_rate"))


@query("coverage_months", f"WITH {MONTHS} SELECT month, lots, resolved, covered, mature FROM months")
def coverage_months(t: Tables) -> DataFrame:
    return mk.coverage(lots(t))


@query("recent_mature", f"WITH {MONTHS} SELECT month FROM months WHERE mature ORDER BY month DESC LIMIT 12")
def recent_mature(t: Tables) -> DataFrame:
    return mk.recent_mature(mk.coverage(lots(t)))


@query("low_bid_rate", f"WITH {MONTHS} SELECT priority, round(avg((n_tenders <= 1)::INT), 6) AS low_rate, count(*) AS resolved FROM lots JOIN months USING (month) WHERE mature AND n_tenders IS NOT NULL GROUP BY 1")
def low_bid_rate(t: Tables) -> DataFrame:
    x = lots(t)
    return rounded(mk.low_bid_rate(x, mk.coverage(x), ["priority"]), "low_rate")


@query(
    "grouped_slices",
    f"""WITH {LOTS} SELECT buyer, count(*) AS lots, round(quantile_cont(value, 0.5), 6) AS median_value, count(n_tenders) AS resolved,
    round(avg((n_tenders <= 1)::INT), 6) AS low_rate, count(n_tenders) < 30 AS small_sample FROM lots GROUP BY 1 ORDER BY lots DESC, buyer LIMIT 12""",
)
def grouped_slices(t: Tables) -> DataFrame:
    return rounded(mk.grouped_slices(lots(t), "buyer", "value", "n_tenders", 12), "median_value", "low_rate")


@query(
    "bid_distribution",
    f"""WITH {LOTS}, g AS (SELECT priority, count(n_tenders) AS awarded, count(*) FILTER (n_tenders = 0) AS a, count(*) FILTER (n_tenders = 1) AS b,
    count(*) FILTER (n_tenders BETWEEN 2 AND 3) AS c, count(*) FILTER (n_tenders BETWEEN 4 AND 6) AS d, count(*) FILTER (n_tenders >= 7) AS e FROM lots GROUP BY 1)
    SELECT priority, awarded, round(CASE WHEN awarded >= 30 THEN a::DOUBLE / awarded END, 6) AS none, round(CASE WHEN awarded >= 30 THEN b::DOUBLE / awarded END, 6) AS one,
    round(CASE WHEN awarded >= 30 THEN c::DOUBLE / awarded END, 6) AS two_three, round(CASE WHEN awarded >= 30 THEN d::DOUBLE / awarded END, 6) AS four_six,
    round(CASE WHEN awarded >= 30 THEN e::DOUBLE / awarded END, 6) AS seven_up FROM g""",
)
def bid_distribution(t: Tables) -> DataFrame:
    return rounded(mk.trade_figures(lots(t), ["priority"], "n_tenders"), "none", "one", "two_three", "four_six", "seven_up")


@query(
    "value_spread",
    f"""WITH {LOTS}, k AS (SELECT priority, value, row_number() OVER (PARTITION BY priority ORDER BY value) AS k, count(*) OVER (PARTITION BY priority) AS n FROM lots)
    SELECT priority, count(value) AS n, round(quantile_cont(value, 0.25), 6) AS q1, round(quantile_cont(value, 0.5), 6) AS median, round(quantile_cont(value, 0.75), 6) AS q3,
    round(max(CASE WHEN k = n // 2 + 1 THEN value END), 6) AS upper_median FROM k GROUP BY 1""",
)
def value_spread(t: Tables) -> DataFrame:
    return rounded(mk.spread(lots(t), ["priority"], "value"), "q1", "median", "q3", "upper_median")


@query(
    "value_bands",
    f"""WITH {LOTS} SELECT CASE WHEN value >= 400000 THEN 3 WHEN value >= 200000 THEN 2 WHEN value >= 50000 THEN 1 WHEN value >= 0 THEN 0 END AS band, count(*) AS lots FROM lots GROUP BY 1""",
)
def value_bands(t: Tables) -> DataFrame:
    return lots(t).groupBy(fn.band(F.col("value"), (0, 50000, 200000, 400000)).alias("band")).agg(F.count(F.lit(1)).alias("lots"))


@query(
    "trade_page",
    f"""WITH {LOTS}, b AS (SELECT priority, buyer, count(*) AS n, count(*) FILTER (n_tenders = 0) AS closed, count(n_tenders) AS resolved, count(*) FILTER (value > 250000) AS bonds, count(*) AS told FROM lots GROUP BY 1, 2)
    SELECT priority, sum(n)::BIGINT AS lots, round(sum(n) * 12.0 / 80, 6) AS per_year, count(*) AS buyers, count(*) FILTER (n > 1) AS repeat_buyers,
    round(sum(closed)::DOUBLE / nullif(sum(resolved), 0), 6) AS closed_share, round(sum(bonds)::DOUBLE / sum(told), 6) AS bond_share FROM b GROUP BY 1""",
)
def trade_page(t: Tables) -> DataFrame:
    x = lots(t).withColumn("bond", F.col("value") > 250000)
    return rounded(mk.trade_page(x, ["priority"], "buyer", "value", "n_tenders", "bond", 80), "per_year", "closed_share", "bond_share")


@query(
    "firm_rows",
    f"""WITH {WINS}, s AS (SELECT quantile_cont(day - DATE '1970-01-01', 0.5) AS split FROM wins)
    SELECT firm, count(*) AS wins, count(*) FILTER (tenders <= 1) AS low_wins, round(quantile_cont(value, 0.5), 6) AS median_value, count(DISTINCT region) AS regions, count(DISTINCT buyer) AS buyers,
    count(*) FILTER (day - DATE '1970-01-01' < split) AS early, count(*) FILTER (day - DATE '1970-01-01' >= split) AS late FROM wins, s GROUP BY 1""",
)
def firm_rows(t: Tables) -> DataFrame:
    return rounded(mk.firm_rows(wins(t), "firm", "day", "value", "tenders", "region", "buyer"), "median_value")


@query(
    "modal_size",
    f"""WITH {WINS}, c AS (SELECT firm, size, count(*) AS n, min(lot * 100 + line) AS first FROM wins GROUP BY 1, 2),
    r AS (SELECT *, row_number() OVER (PARTITION BY firm ORDER BY n DESC, first) AS k, count(*) OVER (PARTITION BY firm) AS kinds FROM c)
    SELECT firm, CASE WHEN kinds > 1 THEN size || '*' ELSE size END AS modal FROM r WHERE k = 1""",
)
def modal_size(t: Tables) -> DataFrame:
    return mk.modal_value(wins(t).withColumn("seq", F.col("lot") * 100 + F.col("line")), ["firm"], "size", "seq")


@query(
    "alias_groups",
    """WITH n AS (SELECT DISTINCT c_mktsegment || ' ' || (c_nationkey % 3)::VARCHAR || CASE WHEN c_custkey % 2 = 0 THEN ' GmbH' ELSE ' AG & Co. KG' END AS name FROM customer),
    k AS (SELECT name, array_to_string(list_filter(string_split(regexp_replace(regexp_replace(lower(name), '\\b(gmbh|co|kg|ag|mbh|se|ohg|e\\.?k|und)\\b', ' ', 'g'), '[^a-zäöüß ]', ' ', 'g'), ' '), lambda x: x <> '')[1:2], ' ') AS key FROM n),
    a AS (SELECT name, CASE WHEN length(key) >= 6 THEN key ELSE lower(name) END AS alias FROM k)
    SELECT alias, count(*) AS spellings, string_agg(name, ';' ORDER BY name) AS names FROM a GROUP BY 1 HAVING count(*) > 1""",
)
def alias_groups(t: Tables) -> DataFrame:
    name = F.concat("c_mktsegment", F.lit(" "), (F.col("c_nationkey") % 3).cast("string"), F.when(F.col("c_custkey") % 2 == 0, " GmbH").otherwise(" AG & Co. KG"))
    return mk.alias_groups(t.customer.select(name.alias("name")), "name")


@query(
    "trade_economics",
    f"""WITH {MONTHS}, {TRADE_LOTS} SELECT trade, round(count(*) * 12.0 / (SELECT count(*) FROM months WHERE covered), 6) AS per_year, round(quantile_cont(value, 0.5), 6) AS median_value
    FROM tl JOIN lots USING (lot) JOIN months USING (month) WHERE covered GROUP BY 1""",
)
def trade_economics(t: Tables) -> DataFrame:
    x = lots(t)
    return rounded(mk.trade_economics(trade_lots(t).join(x, "lot"), mk.coverage(x), ["trade"], "value"), "per_year", "median_value")


PROSPECTS = f"""{WINS},
a AS (SELECT lower(translate(firm, '0123456789#', 'abcdefghij ')) AS alias, * FROM wins),
per AS (SELECT region, count(DISTINCT lot) / 6.5 AS per_year FROM wins GROUP BY 1),
one AS (SELECT alias, count(*) AS wins, quantile_cont(value, 0.5) AS median_value, bool_or(region % 4 <> 0) AS contactable FROM a GROUP BY 1),
rg AS (SELECT alias, sum(per_year) AS recs_year FROM (SELECT DISTINCT alias, region FROM a) JOIN per USING (region) GROUP BY 1),
low AS (SELECT avg((tenders <= 1)::INT) AS low_rate FROM wins),
v AS (SELECT alias, wins, median_value, recs_year, recs_year * low_rate * 0.05 * median_value * 0.08 AS value, contactable FROM one JOIN rg USING (alias), low),
prospects AS (
  SELECT alias, wins, round(median_value, 6) AS median_value, round(recs_year, 6) AS recs_year, round(value, 4) AS value, round(greatest(value * 0.2 / 12, 75.0), 4) AS price,
  CASE WHEN median_value >= 500000 THEN 'percent' ELSE 'flat' END AS model,
  concat_ws('; ', CASE WHEN wins < 2 THEN 'few wins' END, CASE WHEN recs_year < 12 THEN 'few lots' END, CASE WHEN NOT contactable THEN 'no contact' END) AS against FROM v)"""


def _prospects(t: Tables) -> DataFrame:
    w = wins(t).withColumn("firm", F.translate("firm", "0123456789#", "abcdefghij "))  # names of letters, as alias keys drop digits
    per = w.groupBy("region").agg((F.count_distinct("lot") / 6.5).alias("per_year"))
    low = w.agg(F.avg((F.col("tenders") <= 1).cast("double")).alias("low_rate"))
    p = mk.prospects(w, "firm", "region", "value", low, per, F.col("region") % 4 != 0)
    return rounded(p, "median_value", "recs_year").withColumns({c: F.round(c, 4) for c in ("value", "price")})


@query("prospect_rows", f"WITH {PROSPECTS} SELECT * FROM prospects")
def prospect_rows(t: Tables) -> DataFrame:
    return _prospects(t)


@query(
    "rank_trades",
    f"""WITH {PROSPECTS}, p AS (SELECT *, left(alias, 18) AS grp FROM prospects WHERE against = ''),
    r AS (SELECT *, row_number() OVER (PARTITION BY grp ORDER BY price DESC, alias) AS k, count(*) OVER (PARTITION BY grp) AS n FROM p)
    SELECT grp, round(sum(price), 2) AS pool, count(*) AS prospects, round(sum(CASE WHEN k <= 3 THEN price ELSE 0 END) / sum(price), 6) AS top3_share, max(CASE WHEN k = n - n // 2 THEN price END) AS upper_median FROM r GROUP BY 1""",
)
def rank_trades(t: Tables) -> DataFrame:
    return rounded(mk.rank_trades(_prospects(t).withColumn("grp", F.left("alias", F.lit(18))), "grp"), "top3_share").withColumn("pool", F.round("pool", 2))


@query("trade_overlap", f"WITH {TRADE_LOTS} SELECT lot, count(DISTINCT trade) AS trades FROM tl GROUP BY 1 HAVING count(DISTINCT trade) > 1")
def trade_overlap(t: Tables) -> DataFrame:
    return mk.trade_overlap(trade_lots(t), "lot")


TOKENS = "list_distinct(regexp_extract_all(replace(lower(coalesce(text, '')), 'ß', 'ss'), '[a-zäöü]{%d,}'))"


@query(
    "vocabulary_lift",
    f"""WITH w AS (SELECT lang = 'de' AS inside, unnest({TOKENS % 5}) AS word FROM documents),
    n AS (SELECT word, count(*) FILTER (inside) AS n_in, count(*) FILTER (NOT inside) AS n_out FROM w GROUP BY 1 HAVING count(*) FILTER (inside) > 0 ORDER BY n_in DESC, word LIMIT 400),
    s AS (SELECT count(*) FILTER (lang = 'de') AS s_in, count(*) FILTER (lang <> 'de') AS s_out FROM documents),
    l AS (SELECT word, n_in, n_out, n_in::DOUBLE / s_in / greatest(n_out::DOUBLE / s_out, 0.0001) AS lift FROM n, s)
    SELECT word, n_in, n_out, round(lift, 6) AS lift, lift >= 8 AS strong FROM l WHERE lift >= 3""",
)
def vocabulary_lift(t: Tables) -> DataFrame:
    return rounded(mk.vocabulary_lift(t.documents, "doc_id", "text", F.col("lang") == "de"), "lift")


@query(
    "slice_matrix",
    f"""WITH {LOTS} SELECT priority, status, count(*) AS n, round(avg((n_tenders <= 1)::INT), 6) AS rate, (grouping(priority, status))::BIGINT AS level FROM lots GROUP BY CUBE (priority, status) HAVING count(*) >= 25""",
)
def slice_matrix(t: Tables) -> DataFrame:
    return rounded(mk.slice_matrix(lots(t), "priority", "status", F.col("n_tenders") <= 1), "rate")


@query(
    "bid_number_profile",
    f"""WITH {LOTS} SELECT status, min(n_tenders) AS least, round(quantile_cont(n_tenders, 0.5), 6) AS median, round(avg(n_tenders), 6) AS mean, max(n_tenders) AS most,
    round(avg((n_tenders = 1)::INT), 6) AS single, round(avg((n_tenders = 0)::INT), 6) AS none FROM lots GROUP BY 1""",
)
def bid_number_profile(t: Tables) -> DataFrame:
    return rounded(stats.number_profile(lots(t), ["status"], "n_tenders"), "median", "mean", "single", "none")


@query(
    "store_profile",
    """WITH g AS (SELECT left(p_brand, 7) AS division, count(*) AS n, min(p_size) AS low, max(p_size) AS high FROM part GROUP BY 1) SELECT division, n, low, high FROM g ORDER BY n DESC, division LIMIT 6""",
)
def store_profile(t: Tables) -> DataFrame:
    """E52."""
    g = t.part.groupBy(fn.level(F.col("p_brand"), 7).alias("division")).agg(F.count(F.lit(1)).alias("n"), F.min("p_size").alias("low"), F.max("p_size").alias("high"))
    return g.orderBy(F.desc("n"), "division").limit(6)


@query(
    "outreach_firms",
    f"""WITH {WINS}, c AS (SELECT firm, trade, count(*) AS n FROM wins GROUP BY 1, 2), s AS (SELECT firm, size, row_number() OVER (PARTITION BY firm ORDER BY count(*) DESC, size) AS k FROM wins GROUP BY 1, 2)
    SELECT w.firm, count(*) AS wins, count(*) FILTER (tenders = 1) AS single_wins, any_value(s.size) AS size, string_agg(DISTINCT region::VARCHAR, ';' ORDER BY region::VARCHAR) AS regions, max(day) AS last_win,
    any_value((SELECT string_agg(trade, ';' ORDER BY n DESC, trade) FROM c WHERE c.firm = w.firm)) AS trades FROM wins w JOIN s ON s.firm = w.firm AND k = 1 GROUP BY 1""",
)
def outreach_firms(t: Tables) -> DataFrame:
    return sel.outreach(wins(t).withColumn("region", F.col("region").cast("string")), "firm", "trade", "size", "tenders", "region", "day")


@query(
    "own_win",
    f"""WITH {WINS} SELECT firm, tenders, day, lot FROM (SELECT *, row_number() OVER (PARTITION BY firm ORDER BY coalesce(tenders, 99), day DESC, lot) AS k FROM wins) WHERE k = 1""",
)
def own_win(t: Tables) -> DataFrame:
    return sel.own_win(wins(t).select("firm", "tenders", "day", "lot"), "firm", "tenders", "day", "lot")


@query(
    "reference_list",
    f"""WITH {WINS}, r AS (SELECT firm, part, max(day) AS day FROM wins GROUP BY 1, 2) SELECT firm, part, day, k AS rank FROM (SELECT *, row_number() OVER (PARTITION BY firm ORDER BY day DESC, part) AS k FROM r) WHERE k <= 6""",
)
def reference_list(t: Tables) -> DataFrame:
    """C24."""
    one = wins(t).groupBy("firm", "part").agg(F.max("day").alias("day"))
    return sel.top_k(one, ["firm"], [F.desc("day"), F.col("part")], 6)
