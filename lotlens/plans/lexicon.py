"""Queries of the keyword lists; their SQL states the whole rules over the same tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from ..functions import scalars as fn
from ..operators import lexicon as lx, text as tx
from .base import Tables, query, rounded
from .language import _FOLD, _FREQ, EXCEPTIONS, ROOTS
from .market import TOKENS

#: Roots for words of every language of the documents.
_MORE = (*ROOTS, "tion", "ung", "heit", "able", "onat", "mento")
_ROOTED = f"""{_FREQ.replace("f AS (", "f AS MATERIALIZED (")}, rooted AS MATERIALIZED (SELECT token, root FROM (SELECT token, {_FOLD} AS folded FROM f), (SELECT unnest({list(_MORE)}) AS root) WHERE contains(folded, root) AND NOT contains(folded, 'mentre') AND NOT contains(folded, 'tionat'))"""
_STEMS = """ends AS MATERIALIZED (SELECT token, p, left(token, length(token) - length(e)) AS rest FROM f, (VALUES ('en', 0), ('e', 1), ('s', 2), ('n', 3)) AS v(e, p) WHERE ends_with(token, e) AND length(token) - length(e) >= 6),
    cut AS (SELECT ends.token, arg_min(rest, p) AS stem FROM ends JOIN f ON f.token = ends.rest GROUP BY 1), stems AS MATERIALIZED (SELECT f.token, coalesce(stem, f.token) AS stem FROM f LEFT JOIN cut ON cut.token = f.token)"""
_TOK = lambda col, least=3: (TOKENS % least).replace("text", col)
#: Documents as references of 100 firms; the first words stand for the buyer's name.
_REFS = f"""refs AS MATERIALIZED (SELECT doc_id % 100 AS firm, doc_id AS ref, text, left(text, 30) AS buyer FROM documents), words AS MATERIALIZED (SELECT firm, ref, unnest({TOKENS % 3}) AS token FROM refs),
    size AS (SELECT firm, count(DISTINCT ref) AS refs, greatest(1, least(count(DISTINCT ref), trunc(count(DISTINCT ref) * 0.34::DOUBLE + 0.999::DOUBLE)::INT)) AS need FROM refs GROUP BY 1),
    offices AS (SELECT DISTINCT firm, unnest({_TOK("buyer")}) AS word FROM refs), labels AS (SELECT item_id % 100 AS firm, text AS label FROM benchmark)"""
_SHARE = "share AS MATERIALIZED (SELECT firm, root, count(DISTINCT ref) AS n FROM words JOIN rooted USING (token) GROUP BY 1, 2)"


def _lists(of: str, order: str, most: int | None = None) -> str:
    """SQL: the shortest words of a family of ``of`` (firm, word), ranked."""
    keep = f" WHERE rank <= {most}" if most else ""
    return f"(SELECT * FROM (SELECT a.*, row_number() OVER (PARTITION BY firm ORDER BY {order}, length(word), word) AS rank FROM {of} a WHERE NOT EXISTS (SELECT 1 FROM {of} o WHERE o.firm = a.firm AND o.word <> a.word AND contains(a.word, o.word))){keep})"


def _rooted(t: Tables) -> DataFrame:
    one = lambda xs, c: t.spark.createDataFrame([(x,) for x in xs], f"{c} string")
    return tx.words_with_roots(_freq(t), one(_MORE, "root"), one(EXCEPTIONS, "exception"))


def _freq(t: Tables) -> DataFrame:
    return tx.doc_freq(t.documents, "doc_id", "text")


def _refs(t: Tables) -> DataFrame:
    return t.documents.select((F.col("doc_id") % 100).alias("firm"), F.col("doc_id").alias("ref"), "text", F.left("text", F.lit(30)).alias("buyer"))


def _labels(t: Tables) -> DataFrame:
    return t.benchmark.select((F.col("item_id") % 100).alias("firm"), F.col("text").alias("label"))


_OWN = f"""own AS MATERIALIZED (SELECT firm, root AS word, n FROM share JOIN size USING (firm) WHERE n >= need AND NOT EXISTS (SELECT 1 FROM offices o WHERE o.firm = share.firm AND o.word = share.root)),
    more AS (SELECT DISTINCT firm, root AS word FROM (SELECT firm, unnest({_TOK("label")}) AS token FROM labels) JOIN rooted USING (token)),
    cands AS MATERIALIZED (SELECT * FROM own UNION ALL SELECT firm, word, refs AS n FROM more JOIN size USING (firm) WHERE NOT EXISTS (SELECT 1 FROM own WHERE own.firm = more.firm AND own.word = more.word)),
    derived AS MATERIALIZED {_lists("cands", "n DESC", 25)}"""


@query("derived_keywords", f"WITH {_ROOTED}, {_REFS}, {_SHARE}, {_OWN} SELECT firm, word, n, rank FROM derived")
def derived_keywords(t: Tables) -> DataFrame:
    """I6 with roots."""
    return lx.derive_keywords(_refs(t), _labels(t), _rooted(t))


@query(
    "sieved_keywords",
    f"""WITH {_FREQ.replace("f AS (", "f AS MATERIALIZED (")}, {_STEMS}, {_REFS}, total AS (SELECT count(*) AS texts FROM documents), held AS (SELECT firm, token, count(*) AS n FROM words WHERE length(token) >= 6 GROUP BY 1, 2),
    fit AS (SELECT h.firm, coalesce(stem, h.token) AS word, n, df FROM held h JOIN size USING (firm) JOIN f ON f.token = h.token LEFT JOIN stems s ON s.token = h.token, total WHERE n >= need AND df <= 0.02::DOUBLE * texts AND NOT EXISTS (SELECT 1 FROM offices o WHERE o.firm = h.firm AND o.word = h.token)),
    own AS MATERIALIZED (SELECT firm, word, n, -df AS less FROM fit WHERE length(word) >= 6 QUALIFY row_number() OVER (PARTITION BY firm, word ORDER BY n DESC, df) = 1),
    lw AS (SELECT DISTINCT firm, unnest({_TOK("label", 6)}) AS token FROM labels), lf AS (SELECT token, count(*) AS df FROM (SELECT item_id, unnest({TOKENS % 3}) AS token FROM benchmark) GROUP BY 1),
    more AS (SELECT DISTINCT firm, coalesce(stem, lw.token) AS word FROM lw LEFT JOIN f USING (token) LEFT JOIN lf USING (token) LEFT JOIN stems s ON s.token = lw.token, total WHERE coalesce(lf.df, 0) <= 5 OR coalesce(f.df, 0) <= 0.02::DOUBLE * texts),
    cands AS MATERIALIZED (SELECT * FROM own UNION ALL SELECT firm, word, refs AS n, 0 AS less FROM more JOIN size USING (firm) WHERE NOT EXISTS (SELECT 1 FROM own WHERE own.firm = more.firm AND own.word = more.word))
    SELECT firm, word, n, rank FROM {_lists("cands", "n DESC, less", 25)}""",
)
def sieved_keywords(t: Tables) -> DataFrame:
    """I6 without roots: the rarity sieve."""
    freq = _freq(t)
    return lx.derive_keywords(_refs(t), _labels(t), None, freq, tx.stems(freq), t.documents.count(), tx.doc_freq(t.benchmark, "item_id", "text"))


@query("wide_keywords", f"WITH {_ROOTED}, {_REFS}, {_SHARE}, cands AS MATERIALIZED (SELECT firm, root AS word, n FROM share) SELECT firm, word, n, rank FROM {_lists('cands', 'n DESC', 25)}")
def wide_keywords(t: Tables) -> DataFrame:
    return lx.wide_keywords(_refs(t), _rooted(t))


@query("root_share", f"WITH {_ROOTED}, {_REFS}, {_SHARE} SELECT * FROM share")
def root_share(t: Tables) -> DataFrame:
    return lx.root_share(_refs(t), _rooted(t))


_NAMES = f"named AS MATERIALIZED (SELECT DISTINCT firm, root AS word FROM (SELECT item_id % 100 AS firm, unnest({_TOK('left(text, 200)')}) AS token FROM benchmark) JOIN rooted USING (token)), names AS MATERIALIZED {_lists('named', 'firm')}"


def _names(t: Tables) -> DataFrame:
    return t.benchmark.select((F.col("item_id") % 100).alias("firm"), F.left("text", F.lit(200)).alias("name"))


@query("name_keywords", f"WITH {_ROOTED}, {_NAMES} SELECT firm, word, rank FROM names")
def name_keywords(t: Tables) -> DataFrame:
    return lx.name_keywords(_names(t), _rooted(t))


#: Languages, and within some of them a part of the ids, stand for codes.
_CODES = "codes AS MATERIALIZED (SELECT doc_id AS lot, lang AS code FROM documents WHERE lang IS NOT NULL UNION ALL SELECT doc_id, lang || '/' || (doc_id % 4) FROM documents WHERE lang IN ('de', 'fr'))"
_DICTS = f"""{_CODES}, lw AS MATERIALIZED (SELECT doc_id AS lot, lower(source) AS office, unnest({TOKENS % 3}) AS token FROM documents), total AS (SELECT count(*) AS texts FROM documents),
    pool AS MATERIALIZED (SELECT code, lot FROM codes WHERE code IN (SELECT code FROM codes GROUP BY 1 HAVING count(*) >= 20)), polled AS MATERIALIZED (SELECT DISTINCT code, lot, root FROM pool JOIN lw USING (lot) JOIN rooted USING (token)),
    votes AS (SELECT code, root, count(*) AS votes FROM polled GROUP BY 1, 2), sig AS (SELECT code, root FROM (SELECT *, max(votes) OVER (PARTITION BY code) AS top, row_number() OVER (PARTITION BY code ORDER BY votes DESC, root) AS place FROM votes) WHERE place <= 6 AND votes >= 0.5 * top),
    voted AS MATERIALIZED (SELECT DISTINCT code, lot FROM polled JOIN sig USING (code, root) UNION SELECT code, lot FROM pool WHERE code NOT IN (SELECT code FROM votes)),
    inside AS (SELECT code, count(DISTINCT lot) AS n_in, count(DISTINCT lower(source)) AS offices FROM voted JOIN documents ON doc_id = lot GROUP BY 1 HAVING count(DISTINCT lot) >= 20),
    k AS (SELECT code, token, count(*) AS k, count(DISTINCT office) AS nb FROM voted JOIN lw USING (lot) WHERE length(token) >= 6 AND token IN (SELECT token FROM rooted) GROUP BY 1, 2),
    q AS (SELECT code, token, k::DOUBLE / n_in AS f_in, (df - k)::DOUBLE / greatest(texts - n_in, 1) AS f_out FROM k JOIN inside USING (code) JOIN f USING (token), total WHERE k >= 0.1::DOUBLE * n_in AND nb >= 2 AND nb >= 0.1::DOUBLE * offices),
    s AS (SELECT code AS firm, coalesce(stem, q.token) AS word, round(max(f_in * least(f_in / greatest(f_out, 1e-9), 100.0)), 9) AS score FROM q LEFT JOIN stems ON stems.token = q.token WHERE f_in / greatest(f_out, 1e-9) >= 8 GROUP BY 1, 2),
    sm AS MATERIALIZED (SELECT * FROM s), dicts AS MATERIALIZED (SELECT firm AS code, word, score, rank FROM {_lists("sm", "score DESC", 30)})"""


def _dictionaries(t: Tables) -> DataFrame:
    lots = t.documents.select(F.col("doc_id").alias("lot"), F.col("source").alias("buyer"), "text")
    d, freq = t.documents, _freq(t)
    codes = d.filter("lang IS NOT NULL").select(F.col("doc_id").alias("lot"), F.col("lang").alias("code"))
    codes = codes.union(d.filter(F.col("lang").isin("de", "fr")).select("doc_id", F.concat("lang", F.lit("/"), (F.col("doc_id") % 4).cast("string"))))
    return lx.trade_dictionaries(lots, codes, _rooted(t), freq, tx.stems(freq), d.count())


@query("trade_dictionary", f"WITH {_ROOTED}, {_STEMS}, {_DICTS} SELECT code, word, round(score, 6) AS score, rank FROM dicts")
def trade_dictionary(t: Tables) -> DataFrame:
    """I7, E31 in full."""
    return rounded(_dictionaries(t), "score")


@query(
    "firm_keywords",
    f"""WITH {_ROOTED}, {_STEMS}, {_REFS}, {_SHARE}, {_OWN}, {_NAMES}, {_DICTS}, fc AS (SELECT DISTINCT firm, lang || '/' || (firm % 4) AS code FROM refs JOIN documents ON doc_id = ref WHERE lang IN ('de', 'fr')),
    every AS MATERIALIZED (SELECT firm, word, 0 AS source, lpad(rank::VARCHAR, 9, '0') AS place FROM derived UNION ALL SELECT firm, word, 1, lpad(rank::VARCHAR, 9, '0') FROM names UNION ALL SELECT firm, word, 2, lpad(rank::VARCHAR, 9, '0') || '/' || code FROM fc JOIN dicts USING (code)),
    kept AS (SELECT a.* FROM every a WHERE NOT EXISTS (SELECT 1 FROM every o WHERE o.firm = a.firm AND o.word <> a.word AND contains(a.word, o.word)) QUALIFY row_number() OVER (PARTITION BY firm, word ORDER BY source, place) = 1)
    SELECT firm, string_agg(word, ' ' ORDER BY source, place, word) AS words FROM kept GROUP BY 1""",
)
def firm_keywords(t: Tables) -> DataFrame:
    """I12."""
    rooted = _rooted(t)
    codes = t.documents.filter(F.col("lang").isin("de", "fr")).select((F.col("doc_id") % 100).alias("firm"), "lang").distinct().select("firm", F.concat("lang", F.lit("/"), (F.col("firm") % 4).cast("string")).alias("code"))
    words = lx.firm_keywords(lx.derive_keywords(_refs(t), _labels(t), rooted), lx.name_keywords(_names(t), rooted), codes, _dictionaries(t))
    return words.select("firm", F.array_join("words", " ").alias("words"))


@query(
    "recurring_codes",
    """WITH r AS (SELECT l_suppkey AS firm, l_orderkey || '/' || l_linenumber AS ref, lpad((l_partkey % 40 * 100)::VARCHAR, 4, '4') || lpad((l_partkey % 3 * 1000)::VARCHAR, 4, '0') AS code FROM lineitem), s AS (SELECT firm, count(DISTINCT ref) AS refs FROM r GROUP BY 1),
    n AS (SELECT firm, code, count(DISTINCT ref) AS n FROM r WHERE length(code) = 8 AND code[5:8] <> '0000' GROUP BY 1, 2) SELECT firm, code, n FROM n JOIN s USING (firm) WHERE n >= greatest(1, least(refs, trunc(refs * 0.02::DOUBLE + 0.999::DOUBLE)::INT))""",
)
def recurring_codes(t: Tables) -> DataFrame:
    """Only deep codes."""
    code = F.concat(F.lpad((F.col("l_partkey") % 40 * 100).cast("string"), 4, "4"), F.lpad((F.col("l_partkey") % 3 * 1000).cast("string"), 4, "0"))
    refs = t.lineitem.select(F.col("l_suppkey").alias("firm"), F.concat_ws("/", "l_orderkey", "l_linenumber").alias("ref"), code.alias("code"))
    return lx.recurring_codes(refs, share=0.02)


_LETTERS = "abeilnorstu"


@query(
    "synonym_tier",
    f"""WITH k AS (SELECT DISTINCT p_brand AS firm, unnest(string_split(p_name, ' ')) AS word FROM part), d AS (SELECT DISTINCT item_id, unnest({TOKENS % 5}) AS token FROM benchmark), w AS (SELECT DISTINCT word FROM k), v AS (SELECT DISTINCT token FROM d),
    found AS (SELECT DISTINCT item_id, firm, k.word, 1 AS tier FROM d JOIN (SELECT token, word FROM v, w WHERE contains(token, word)) USING (token) JOIN k USING (word)),
    vec AS (SELECT t, [{", ".join(f"(length(t) - length(replace(t, '{x}', '')))::DOUBLE" for x in _LETTERS)}] AS v FROM (SELECT token AS t FROM v UNION SELECT word FROM w)), u AS (SELECT t, v, sqrt(list_dot_product(v, v)) AS z FROM vec WHERE list_sum(v) > 0),
    near AS (SELECT token, word FROM v, w, u a, u b WHERE a.t = token AND b.t = word AND round(list_dot_product(list_transform(a.v, lambda x: x / a.z), list_transform(b.v, lambda x: x / b.z)), 9) >= 0.9)
    SELECT item_id, firm, word, tier FROM found UNION ALL SELECT DISTINCT item_id, firm, word, 3 FROM d JOIN near USING (token) JOIN k USING (word) WHERE NOT EXISTS (SELECT 1 FROM found o WHERE o.item_id = d.item_id AND o.firm = k.firm)""",
)
def synonym_tier(t: Tables) -> DataFrame:
    """Tier 3 only where nothing else was found; a word's vector counts its letters."""
    k = t.part.select(F.col("p_brand").alias("firm"), F.explode(F.split("p_name", " ")).alias("word")).distinct()
    d = t.benchmark.select("item_id", F.explode(F.array_distinct(fn.tokens(F.col("text"), 5))).alias("token")).distinct()
    found = d.join(tx.parts_of(d.select("token").distinct(), "token", k.select("word").distinct(), "word"), "token").join(k, "word").select("item_id", "firm", "word").distinct().withColumn("tier", F.lit(1))
    words = d.select("token").union(k.select("word")).distinct()
    count = [(F.length("token") - F.length(F.replace("token", F.lit(x), F.lit("")))).cast("double") for x in _LETTERS]
    vectors = words.select("token", F.array(*count).alias("vec")).filter(F.exists("vec", lambda x: x > 0))
    return lx.with_synonyms(found, d, k, vectors, "item_id", "firm", "word", bar=0.9)


_TRADES = [("en", ["en"], ["enen"]), ("ung", ["ung", "tion"], []), ("th", ["th", "qu"], ["thth"]), ("none", ["zzzz"], [])]


@query(
    "trades_of_titles",
    f"""WITH tr AS (SELECT * FROM (VALUES {", ".join(f"('{a}', {b}::VARCHAR[], {c}::VARCHAR[])" for a, b, c in _TRADES)}) AS v(trade, terms, excl)), t AS (SELECT source AS firm, {_FOLD.replace("token", "lower(coalesce(left(text, 80), ''))")} AS t FROM documents),
    n AS (SELECT firm, greatest(1, floor((count(*) + 1) / 2)) AS need FROM t WHERE t <> '' GROUP BY 1), h AS (SELECT firm, trade, count(*) AS hits FROM t, tr WHERE t <> '' AND len(list_filter(terms, lambda w: contains(t, w))) > 0 AND len(list_filter(excl, lambda w: contains(t, w))) = 0 GROUP BY 1, 2)
    SELECT firm, trade, hits FROM h JOIN n USING (firm) WHERE hits >= need""",
)
def trades_of_titles(t: Tables) -> DataFrame:
    """I20."""
    trades = t.spark.createDataFrame(_TRADES, "trade string, terms array<string>, exclude array<string>")
    return lx.trades_of_titles(t.documents.select(F.col("source").alias("firm"), F.left("text", F.lit(80)).alias("title")), trades)


@query(
    "store_vocabulary",
    f"WITH {_FREQ} SELECT token FROM f WHERE length(token) >= 6 UNION SELECT unnest({list(_MORE)}) UNION SELECT unnest({TOKENS % 6}) FROM benchmark UNION SELECT unnest({_TOK('p_type', 6)}) FROM part",
)
def store_vocabulary(t: Tables) -> DataFrame:
    """I24."""
    roots = t.spark.createDataFrame([(x,) for x in _MORE], "root string")
    return lx.store_vocabulary([(t.documents, "text"), (t.benchmark, "text"), (t.part, "p_type")], roots, _freq(t))


@query(
    "why_phrases",
    """WITH c AS (SELECT l_orderkey, 'q' || l_linenumber AS feature, round(l_quantity - 25, 6) AS v FROM lineitem UNION ALL SELECT l_orderkey, 'tax__' || l_linenumber, round(l_tax * 100 - 3, 6) FROM lineitem), p AS (SELECT *, CASE feature WHEN 'q1' THEN 'first' WHEN 'q2' THEN 'next' WHEN 'q3' THEN 'next' WHEN 'q4' THEN 'late' ELSE CASE WHEN starts_with(feature, 'tax__') THEN 'tax' WHEN starts_with(feature, 'q6') OR starts_with(feature, 'q7') THEN 'last' END END AS phrase FROM c),
    m AS (SELECT l_orderkey, v > 0 AS up, phrase, max(abs(v)) AS most, arg_max(feature, (lpad((abs(v) * 1000)::BIGINT::VARCHAR, 12, '0') || feature)) AS f FROM p WHERE phrase IS NOT NULL AND v <> 0 GROUP BY 1, 2, 3), r AS (SELECT *, row_number() OVER (PARTITION BY l_orderkey, up ORDER BY most DESC, f) AS place FROM m)
    SELECT l_orderkey, coalesce(string_agg(phrase, ', ' ORDER BY place) FILTER (up AND place <= 3), '') AS lonely, coalesce(string_agg(phrase, ', ' ORDER BY place) FILTER (NOT up AND place <= 3), '') AS crowded FROM r RIGHT JOIN (SELECT DISTINCT l_orderkey FROM c) USING (l_orderkey) GROUP BY 1""",
)
def why_phrases(t: Tables) -> DataFrame:
    """I25."""
    one = lambda feature, v: t.lineitem.select("l_orderkey", feature.alias("feature"), F.round(v, 6).cast("double").alias("v"))
    c = one(F.concat(F.lit("q"), "l_linenumber"), F.col("l_quantity") - 25).union(one(F.concat(F.lit("tax__"), "l_linenumber"), F.col("l_tax") * 100 - 3))
    phrase = lx.why_phrase(F.col("feature"), {"q1": "first", "q2": "next", "q3": "next", "q4": "late"}, [(("tax__",), "tax"), (("q6", "q7"), "last")])
    w = lx.why(c, "l_orderkey", "feature", "v", phrase)
    return w.select("l_orderkey", F.array_join("lonely", ", ").alias("lonely"), F.array_join("crowded", ", ").alias("crowded"))


@query("lexicon_coverage", f"WITH {_ROOTED}, {_REFS}, {_SHARE}, {_OWN}, n AS (SELECT firm, count(word) AS n FROM size LEFT JOIN derived USING (firm) GROUP BY 1) SELECT count(*) AS firms, median(n)::DOUBLE AS median, round(avg(n), 6) AS mean, count(*) FILTER (n = 0) AS empty, count(*) FILTER (n < 3) AS under_three FROM n")
def lexicon_coverage(t: Tables) -> DataFrame:
    """E54."""
    refs = _refs(t)
    words = lx.derive_keywords(refs, _labels(t), _rooted(t))
    sizes = refs.select("firm").distinct().join(words, "firm", "left").groupBy("firm").agg(F.count("word").alias("n"))
    return rounded(lx.lexicon_coverage(sizes), "mean")


@query(
    "rejected_words",
    f"""WITH {_ROOTED}, {_REFS}, total AS (SELECT count(*) AS texts FROM documents), n AS (SELECT firm, token AS word, count(*) AS n FROM words GROUP BY 1, 2),
    r AS (SELECT CASE WHEN n < need THEN 'too few references' WHEN o.word IS NOT NULL THEN 'buyer name' WHEN length(n.word) < 6 THEN 'too short' WHEN df > 0.02::DOUBLE * texts THEN 'store-common' WHEN n.word NOT IN (SELECT token FROM rooted) THEN 'not a trade word' END AS reason
    FROM n JOIN size USING (firm) LEFT JOIN offices o ON o.firm = n.firm AND o.word = n.word LEFT JOIN f ON f.token = n.word, total) SELECT reason, count(*) AS words FROM r WHERE reason IS NOT NULL GROUP BY 1""",
)
def rejected_words(t: Tables) -> DataFrame:
    """E54."""
    return lx.rejections(_refs(t), _rooted(t), _freq(t), t.documents.count())
