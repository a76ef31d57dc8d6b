"""Text, vector, gate, time-travel, selection, source and window queries."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from ..functions import scalars as fn
from ..operators import asof, gate, model as ml, pairs as pr, selection as sel, text as tx, vectors as vc
from ..sources import files
from ..streaming import events as st
from .base import LOTS, WINS, Tables, lots, query, r6, rounded, wins
from .market import TOKENS

_TS = "timestamp_ntz"


@query("doc_freq", f"WITH w AS (SELECT unnest({TOKENS % 3}) AS token FROM documents) SELECT token, count(*) AS df FROM w GROUP BY 1")
def doc_freq(t: Tables) -> DataFrame:
    return tx.doc_freq(t.documents, "doc_id", "text")


_FREQ = f"w AS (SELECT unnest({TOKENS % 3}) AS token FROM documents), f AS (SELECT token, count(*) AS df FROM w GROUP BY 1)"


@query(
    "corpus_stems",
    f"""WITH {_FREQ.replace("f AS (", "f AS MATERIALIZED (")}, c AS MATERIALIZED (SELECT token, p, left(token, length(token) - length(e)) AS rest FROM f, (VALUES ('en', 0), ('e', 1), ('s', 2), ('n', 3)) AS v(e, p) WHERE ends_with(token, e) AND length(token) - length(e) >= 6),
    k AS (SELECT c.token, arg_min(rest, p) AS stem FROM c JOIN f ON f.token = c.rest GROUP BY 1) SELECT f.token, coalesce(stem, f.token) AS stem FROM f LEFT JOIN k ON k.token = f.token""",
)
def corpus_stems(t: Tables) -> DataFrame:
    return tx.stems(tx.doc_freq(t.documents, "doc_id", "text"))


ROOTS, EXCEPTIONS = ("ation", "ment", "keit", "ueber"), ("mentre", "tionat")
_FOLD = "replace(replace(replace(replace(token, 'ä', 'ae'), 'ö', 'oe'), 'ü', 'ue'), 'ß', 'ss')"


def _rooted(t: Tables) -> DataFrame:
    one = lambda xs, c: t.spark.createDataFrame([(x,) for x in xs], f"{c} string")
    return tx.words_with_roots(tx.doc_freq(t.documents, "doc_id", "text"), one(ROOTS, "root"), one(EXCEPTIONS, "exception"))


_ROOTED = f"""{_FREQ}, rooted AS (SELECT token, root FROM (SELECT token, {_FOLD} AS folded FROM f), (SELECT unnest({list(ROOTS)}) AS root) WHERE contains(folded, root) AND NOT contains(folded, 'mentre') AND NOT contains(folded, 'tionat'))"""


@query("words_with_roots", f"WITH {_ROOTED} SELECT * FROM rooted")
def words_with_roots(t: Tables) -> DataFrame:
    return _rooted(t)


@query("text_roots", f"WITH {_ROOTED}, d AS (SELECT doc_id, unnest({TOKENS % 3}) AS token FROM documents) SELECT DISTINCT doc_id, root FROM d JOIN rooted USING (token)")
def text_roots(t: Tables) -> DataFrame:
    return tx.text_roots(t.documents, "doc_id", "text", _rooted(t))


@query(
    "root_audit",
    f"""WITH {_ROOTED}, d AS (SELECT lang AS code, unnest({TOKENS % 3}) AS token FROM documents), n AS (SELECT root, code, count(*) AS n FROM d JOIN rooted USING (token) GROUP BY 1, 2)
    SELECT root, arg_max(code, lpad(n::VARCHAR, 12, '0') || code) AS modal_code, max(n) AS top, sum(n)::BIGINT AS total, round(max(n)::DOUBLE / sum(n), 6) AS agreement FROM n GROUP BY 1""",
)
def root_audit(t: Tables) -> DataFrame:
    d = t.documents.select(F.col("lang").alias("code"), F.explode(F.array_distinct(fn.tokens(F.col("text")))).alias("token"))
    n = d.join(_rooted(t), "token").groupBy("root", "token", "code").agg(F.count(F.lit(1)).alias("n"))
    return rounded(tx.root_audit(n), "agreement")


@query(
    "fold_tokens",
    f"WITH w AS (SELECT doc_id, unnest({TOKENS % 6}) AS token FROM documents WHERE lang = 'de') SELECT DISTINCT {_FOLD} AS folded FROM w",
)
def fold_tokens(t: Tables) -> DataFrame:
    return t.documents.filter("lang = 'de'").select(F.explode(fn.tokens(F.col("text"), 6)).alias("token")).select(fn.fold(F.col("token")).alias("folded")).distinct()


def _words(t: Tables) -> DataFrame:
    return t.benchmark.select(F.col("item_id").alias("firm"), F.explode(F.array_distinct(fn.tokens(F.col("text"), 8))).alias("word"))


@query(
    "evidence_tiers",
    f"""WITH k AS (SELECT DISTINCT item_id AS firm, unnest({TOKENS % 8}) AS word FROM benchmark), d AS (SELECT doc_id, lower(left(text, 40)) AS title, unnest({(TOKENS % 3).replace("coalesce(text, '')", "concat_ws(' ', left(text, 40), text)")}) AS token FROM documents),
    v AS (SELECT DISTINCT token FROM d), p AS (SELECT token, word, min(tier) AS tier FROM (SELECT token, word, 1 AS tier FROM v, (SELECT DISTINCT word FROM k) WHERE contains(token, word) UNION ALL
    SELECT token, word, 2 FROM v, (SELECT DISTINCT word FROM k) WHERE length(token) >= 7 AND abs(length(token) - length(word)) <= 1 AND levenshtein(translate(token, 'äöü', '123'), translate(word, 'äöü', '123')) <= 1) GROUP BY 1, 2)
    SELECT doc_id, firm, word, min(tier) AS tier, bool_or(contains(title, token)) AS in_title FROM d JOIN p USING (token) JOIN k USING (word) GROUP BY 1, 2, 3""",
)
def evidence_tiers(t: Tables) -> DataFrame:
    d = t.documents.withColumn("title", F.left("text", F.lit(40)))
    return tx.evidence(d, "doc_id", "title", "text", _words(t), "firm", "word")


@query(
    "convictions",
    f"""WITH k AS (SELECT DISTINCT item_id AS firm, unnest({TOKENS % 8}) AS word FROM benchmark), d AS (SELECT doc_id, lower(left(text, 40)) AS title, unnest({(TOKENS % 3).replace("coalesce(text, '')", "concat_ws(' ', left(text, 40), text)")}) AS token FROM documents),
    v AS (SELECT DISTINCT token FROM d), p AS (SELECT DISTINCT token, word FROM v, (SELECT DISTINCT word FROM k) WHERE contains(token, word) OR (length(token) >= 7 AND abs(length(token) - length(word)) <= 1 AND levenshtein(translate(token, 'äöü', '123'), translate(word, 'äöü', '123')) <= 1)),
    e AS (SELECT doc_id, firm, word, bool_or(contains(title, token)) AS in_title FROM d JOIN p USING (token) JOIN k USING (word) GROUP BY 1, 2, 3)
    SELECT doc_id, firm, count(*) AS witnesses, bool_or(in_title) AS title_witness, bool_or(in_title) OR count(*) >= 2 AS convicts FROM e GROUP BY 1, 2""",
)
def convictions(t: Tables) -> DataFrame:
    return tx.convictions(evidence_tiers(t), "doc_id", "firm")


@query(
    "core_recurrence",
    f"""WITH w AS (SELECT DISTINCT source, doc_id, unnest({TOKENS % 8}) AS word FROM documents), s AS (SELECT source, count(DISTINCT doc_id) AS refs FROM w GROUP BY 1), n AS (SELECT source, word, count(*) AS n FROM w GROUP BY 1, 2)
    SELECT source, word, n, refs FROM n JOIN s USING (source) WHERE n >= CASE WHEN refs <= 1 THEN 1 ELSE greatest(2, trunc(refs * 0.1::DOUBLE + 0.999::DOUBLE)::INT) END""",
)
def core_recurrence(t: Tables) -> DataFrame:
    w = t.documents.select("source", "doc_id", F.explode(F.array_distinct(fn.tokens(F.col("text"), 8))).alias("word"))
    return tx.recurring(w, "source", "doc_id", "word", 0.1, 2)


@query(
    "subsumed_words",
    f"""WITH w AS (SELECT DISTINCT item_id, unnest({TOKENS % 4}) AS word FROM benchmark), k AS (SELECT * FROM w WHERE NOT EXISTS (SELECT 1 FROM w AS o WHERE o.item_id = w.item_id AND o.word <> w.word AND contains(w.word, o.word)))
    SELECT item_id, array_to_string(list(word ORDER BY length(word), word)[1:25], ' ') AS words FROM k GROUP BY 1""",
)
def subsumed_words(t: Tables) -> DataFrame:
    w = t.benchmark.select("item_id", F.explode(fn.tokens(F.col("text"), 4)).alias("word"))
    return tx.prune_lists(w, ["item_id"], "word").withColumn("words", F.array_join("words", " "))


_SENT = "list_filter(list_transform(string_split(regexp_replace(coalesce(text, ''), '([.!?])[ \\t\\r\\n]+|\\n+', '\\1' || chr(1), 'g'), chr(1)), lambda s: trim(s)), lambda s: s <> '')"


@query(
    "boilerplate_sentences",
    f"""WITH s AS (SELECT doc_id, lang || (doc_id % 4)::VARCHAR AS trade, unnest({_SENT}) AS s FROM documents), k AS (SELECT left(sha1(regexp_replace(regexp_replace(lower(s), '[0-9]', '0', 'g'), '\\s+', ' ', 'g')), 16) AS key, doc_id, trade FROM s WHERE length(s) >= 15)
    SELECT key, count(DISTINCT doc_id) AS procedures, count(DISTINCT trade) AS trades FROM k GROUP BY 1 HAVING count(DISTINCT doc_id) >= 5 AND count(DISTINCT trade) >= 3""",
)
def boilerplate_sentences(t: Tables) -> DataFrame:
    d = t.documents.withColumn("trade", F.concat("lang", (F.col("doc_id") % 4).cast("string")))
    return tx.boilerplate(d, "doc_id", "trade", "text")


@query("text_hashes", "SELECT doc_id, left(sha1(left(trim(regexp_replace(coalesce(text, ''), '\\s+', ' ', 'g')), 2000)), 16) AS hash FROM documents")
def text_hashes(t: Tables) -> DataFrame:
    return t.documents.select("doc_id", tx.text_hash(tx.prepared(F.col("text"))).alias("hash"))


@query("band_draw_admit", "WITH d AS (SELECT doc_id, ('0x' || left(md5('7|' || doc_id::VARCHAR), 13))::UBIGINT::DOUBLE / 4503599627370496 AS draw FROM documents) SELECT doc_id, round(draw, 9) AS draw, draw < 0.25 AS admitted FROM d")
def band_draw_admit(t: Tables) -> DataFrame:
    d = fn.hash_draw(F.lit("7"), F.col("doc_id").cast("string"))
    return t.documents.select("doc_id", F.round(d, 9).alias("draw"), (d < 0.25).alias("admitted"))


# --- vectors ----------------------------------------------------------------------------------------

_UNIT = "u AS (SELECT vec_id, label, list_transform(embedding, lambda x: x::DOUBLE / sqrt(list_dot_product(embedding::DOUBLE[], embedding::DOUBLE[]))) AS v FROM embeddings)"


#: Each vector whose id is divisible by 20, against all others.
_PAIRS = f"{_UNIT}, c AS (SELECT a.vec_id, a.label AS firm, b.vec_id AS ref, round(list_dot_product(a.v, b.v), 9) AS cos FROM u a, u b WHERE a.vec_id % 20 = 0 AND a.vec_id <> b.vec_id)"

#: Each vector against all others.
_ALL_PAIRS = f"{_UNIT}, c AS (SELECT a.vec_id, a.label AS firm, b.vec_id AS ref, round(list_dot_product(a.v, b.v), 9) AS cos FROM u a, u b WHERE a.vec_id <> b.vec_id)"


def _asked(t: Tables) -> DataFrame:
    return t.embeddings.filter("vec_id % 20 = 0")


def _refs(t: Tables) -> DataFrame:
    return t.embeddings.select(F.col("vec_id").alias("ref"), "embedding")


@query("cosine_top1", f"WITH {_PAIRS} SELECT vec_id, ref, cos FROM c QUALIFY row_number() OVER (PARTITION BY vec_id ORDER BY cos DESC, ref) = 1")
def cosine_top1(t: Tables) -> DataFrame:
    return vc.best_reference(_asked(t), _refs(t), "vec_id", "ref", "embedding", others=True)


@query("top_labels", f"WITH {_PAIRS}, r AS (SELECT vec_id, ref, cos, row_number() OVER (PARTITION BY vec_id ORDER BY cos DESC, ref) AS rank FROM c) SELECT vec_id, ref, cos, rank FROM r WHERE rank <= 3")
def top_labels(t: Tables) -> DataFrame:
    return vc.top_labels(_asked(t), _refs(t), "vec_id", "ref", "embedding", 3, others=True)


_COH = f"{_UNIT}, s AS (SELECT label, i, sum(v[i]) AS s FROM u, (SELECT unnest(range(1, 65)) AS i) GROUP BY 1, 2), n AS (SELECT label, count(*) AS n FROM u GROUP BY 1), c AS (SELECT label, n, (sum(s * s) - n) / (n::DOUBLE * n - n) AS cohesion FROM s JOIN n USING (label) GROUP BY 1, 2)"


@query("cohesion_by_label", f"WITH {_COH} SELECT label, n, round(cohesion, 6) AS cohesion FROM c")
def cohesion_by_label(t: Tables) -> DataFrame:
    return rounded(vc.cohesion(t.embeddings, "label", "embedding"), "cohesion")


@query("trusted_labels", f"WITH {_COH}, a AS (SELECT i, sum(v[i]) AS s FROM u, (SELECT unnest(range(1, 65)) AS i) GROUP BY 1), b AS (SELECT sum(s * s) / ((SELECT count(*) FROM u)::DOUBLE * (SELECT count(*) FROM u)) AS baseline FROM a) SELECT label, n, round(cohesion, 6) AS cohesion, round(baseline, 6) AS baseline, cohesion >= baseline + 0.15 AS trusted FROM c, b WHERE n >= 10")
def trusted_labels(t: Tables) -> DataFrame:
    return rounded(vc.trusted(t.embeddings, "label", "embedding"), "cohesion", "baseline")


@query("pseudo_refs", f"WITH {_COH}, d AS (SELECT u.label, vec_id, sum(v[i] * s) AS dot, any_value(n) AS n, any_value(cohesion) AS cohesion FROM u JOIN s USING (label) JOIN c USING (label) GROUP BY 1, 2), m AS (SELECT *, round((dot - 1) / (n - 1), 9) AS mean FROM d), r AS (SELECT *, row_number() OVER (PARTITION BY label ORDER BY mean DESC, vec_id) AS rank FROM m WHERE mean >= (cohesion + 0.01) / 2) SELECT label, vec_id, mean FROM r WHERE rank <= 200")
def pseudo_refs(t: Tables) -> DataFrame:
    return vc.pseudo_refs(t.embeddings, "label", "vec_id", "embedding", 0.01).drop("rank")


@query("soft_fingerprint", f"WITH {_ALL_PAIRS}, n AS (SELECT firm, ref AS code, count(DISTINCT vec_id) AS refs, max(cos) AS best FROM c WHERE cos >= 0.2 GROUP BY 1, 2 HAVING count(DISTINCT vec_id) >= 2), r AS (SELECT *, row_number() OVER (PARTITION BY firm ORDER BY best DESC, code) AS rank FROM n) SELECT firm, code, refs, best, rank FROM r WHERE rank <= 8")
def soft_fingerprint(t: Tables) -> DataFrame:
    n = pr.soft_fingerprint(t.embeddings, t.embeddings, "vec_id", "label", "vec_id", "embedding", floor=0.2)
    return n.select(F.col("label").alias("firm"), F.col("vec_id").alias("code"), "refs", "best", "rank")


# --- gate -------------------------------------------------------------------------------------------

_COMP = """comp AS (SELECT doc_id, (n_chars % 1000)::DOUBLE / 1000 AS text, (doc_id * 7 % 100)::DOUBLE / 100 AS hard, (doc_id * 13 % 100)::DOUBLE / 100 AS soft, (doc_id * 3 % 10)::DOUBLE / 10 AS own_read, (doc_id * 3 % 11)::DOUBLE / 10 AS best_read,
(doc_id * 17 % 10)::DOUBLE / 10 AS foreign_read, doc_id % 50 <> 0 AS has_vector, doc_id % 3 <> 0 AS known_codes, doc_id % 9 = 0 AS same_buyer, CASE WHEN doc_id % 4 <> 0 THEN doc_id % 11 <> 0 END AS type_match, doc_id % 2 = 0 AS has_hard_labels FROM documents)"""


def _components(t: Tables) -> DataFrame:
    i = F.col("doc_id")
    return t.documents.select(
        "doc_id", (F.col("n_chars") % 1000 / 1000).alias("text"), (i * 7 % 100 / 100).alias("hard"), (i * 13 % 100 / 100).alias("soft"), (i * 3 % 10 / 10).alias("own_read"), (i * 3 % 11 / 10).alias("best_read"),
        (i * 17 % 10 / 10).alias("foreign_read"), (i % 50 != 0).alias("has_vector"), (i % 3 != 0).alias("known_codes"), (i % 9 == 0).alias("same_buyer"), F.when(i % 4 != 0, i % 11 != 0).alias("type_match"), (i % 2 == 0).alias("has_hard_labels"),
    )


@query(
    "judge_ladder",
    f"""WITH {_COMP}, r AS (SELECT *, hard >= 0.825::DOUBLE AS h, soft >= 0.725::DOUBLE AS s, NOT has_hard_labels OR own_read >= best_read AS cor, foreign_read - own_read >= 0.225::DOUBLE AS con, text >= 0.7::DOUBLE AS tx, text >= 0.7::DOUBLE - 0.05::DOUBLE AS nr FROM comp)
    SELECT doc_id, CASE WHEN NOT has_vector THEN 'pass' WHEN NOT coalesce(type_match, true) THEN 'borderline' WHEN same_buyer THEN CASE WHEN NOT known_codes OR (s AND NOT h AND NOT cor) OR (h AND con) THEN 'borderline' WHEN h OR s THEN 'pass' ELSE 'out' END
    WHEN tx THEN 'pass' WHEN (s AND NOT h AND NOT cor) OR (h AND con) THEN 'borderline' WHEN h OR s THEN 'pass' WHEN nr THEN 'borderline' ELSE 'out' END AS verdict FROM r""",
)
def judge_ladder(t: Tables) -> DataFrame:
    return gate.judge_embedding(_components(t)).select("doc_id", "verdict")


@query(
    "judge_evidence",
    """WITH c AS (SELECT doc_id, CASE WHEN doc_id % 4 <> 0 THEN doc_id % 11 <> 0 END AS tm, doc_id % 10 = 0 AS core, doc_id % 6 = 0 AS title, doc_id % 4 AS w, doc_id % 3 AS w2, doc_id % 5 AS wide, (doc_id * 7 % 100)::DOUBLE / 100 >= 0.825::DOUBLE AS h, doc_id % 2 = 0 AS troot FROM documents),
    v AS (SELECT *, (title OR w >= 2 OR core) AND NOT (NOT core AND w2 < 2 AND NOT h) AND NOT (NOT core AND NOT title AND NOT h AND troot) AS conv FROM c), n AS (SELECT *, h OR w >= 2 OR conv OR wide >= 2 AS nom FROM v)
    SELECT doc_id, CASE WHEN NOT coalesce(tm, true) THEN 'borderline' WHEN nom AND conv THEN 'pass' WHEN nom OR w > 0 THEN 'borderline' ELSE 'out' END AS verdict FROM n""",
)
def judge_evidence(t: Tables) -> DataFrame:
    i = F.col("doc_id")
    c = t.documents.select(
        "doc_id", F.when(i % 4 != 0, i % 11 != 0).alias("type_match"), (i % 10 == 0).alias("core_title"), (i % 6 == 0).alias("title_witness"), (i % 4).alias("witnesses"), (i % 3).alias("witnesses2"), (i % 5).alias("wide_witnesses"),
        (i * 7 % 100 / 100).alias("hard"), (i % 2 == 0).alias("title_has_root"), F.lit(0.5).alias("draw"),
    )
    return gate.judge_evidence(c).select("doc_id", "verdict")


@query(
    "calibration_grid",
    f"""WITH {_COMP}, x AS (SELECT quality, text, hard FROM comp JOIN labels USING (doc_id)), g AS (SELECT a AS bar_text, b AS bar_hard FROM (SELECT unnest([0.5, 0.6, 0.7]::DOUBLE[]) AS a), (SELECT unnest([0.7, 0.8, 0.9]::DOUBLE[]) AS b))
    SELECT quality, bar_text, bar_hard, round(avg((text >= bar_text OR hard >= bar_hard)::INT), 6) AS rate FROM x, g GROUP BY 1, 2, 3""",
)
def calibration_grid(t: Tables) -> DataFrame:
    x = _components(t).join(t.labels.select("doc_id", "quality"), "doc_id")
    return rounded(gate.grid_rates(x, "quality", {"text": (0.5, 0.6, 0.7), "hard": (0.7, 0.8, 0.9)}), "rate")


@query("recall_threshold", f"WITH {_COMP} SELECT round(quantile_cont(text, 0.1), 6) AS bar FROM comp JOIN labels USING (doc_id) WHERE quality = 1")
def recall_threshold(t: Tables) -> DataFrame:
    x = _components(t).join(t.labels.filter("quality = 1").select("doc_id"), "doc_id")
    return vc.at_recall(x, "text").select(r6("threshold").alias("bar"))


# --- time travel ------------------------------------------------------------------------------------


@query(
    "asof_last_before",
    """WITH f AS (SELECT user_id, max(ts) AS due FROM events WHERE event_type = 'purchase' GROUP BY 1), m AS (SELECT user_id, ts AS made, event_id, value FROM events WHERE event_type = 'view')
    SELECT user_id, event_id, value FROM f JOIN m USING (user_id) QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY made <= due DESC, made DESC, event_id DESC) = 1""",
)
def asof_last_before(t: Tables) -> DataFrame:
    facts = t.events.filter("event_type = 'purchase'").groupBy("user_id").agg(F.max("ts").alias("at"))
    marks = t.events.filter("event_type = 'view'").select("user_id", F.col("ts").alias("made"), "event_id", "value")
    return asof.last_before_else_last(facts, ["user_id"], "at", marks, "made", "event_id").select("user_id", "event_id", "value")


@query(
    "buyer_history",
    """SELECT a.o_orderkey, count(b.o_orderkey) AS n_before, round(coalesce(sum(b.o_totalprice), 0), 2) AS sum_before FROM orders a LEFT JOIN orders b ON a.o_custkey = b.o_custkey AND b.o_orderdate::DATE < a.o_orderdate::DATE AND b.o_orderkey <> a.o_orderkey GROUP BY 1""",
)
def buyer_history(t: Tables) -> DataFrame:
    x = asof.history_before(t.orders.select("o_orderkey", "o_custkey", "o_orderdate", "o_totalprice"), ["o_custkey"], "o_orderdate", ["o_orderkey"], "o_totalprice")
    return x.select("o_orderkey", "n_before", F.round("sum_before", 2).alias("sum_before"))


@query("scd2_in_force", "SELECT user_id, event_id, event_type FROM events WHERE ts <= TIMESTAMP '2024-01-10' QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) = 1")
def scd2_in_force(t: Tables) -> DataFrame:
    return asof.in_force(t.events, ["user_id"], "ts", "event_id", F.lit("2024-01-10").cast(_TS)).select("user_id", "event_id", "event_type")


@query("learned_refs", "SELECT user_id, event_type, min(ts)::DATE AS learned FROM events WHERE ts <= TIMESTAMP '2024-01-05' GROUP BY 1, 2")
def learned_refs(t: Tables) -> DataFrame:
    x = asof.learned_by(t.events, ["user_id"], "event_type", "ts", F.lit("2024-01-05").cast(_TS))
    return x.select("user_id", "event_type", F.col("ts").cast("date").alias("learned"))


@query("training_window", f"WITH {LOTS}, f AS (SELECT *, min(pub) OVER (PARTITION BY buyer) AS first FROM lots) SELECT lot, buyer FROM f WHERE first > (SELECT max(pub) FROM lots) - INTERVAL 75 MONTH")
def training_window(t: Tables) -> DataFrame:
    return asof.training_window(lots(t), ["buyer"], "pub", 75).select("lot", "buyer")


@query("temporal_split", f"WITH {LOTS}, f AS (SELECT buyer, min(pub - DATE '1970-01-01') AS d FROM lots GROUP BY 1) SELECT lot, CASE WHEN d <= (SELECT quantile_cont(d, 0.8) FROM f) THEN 'train' ELSE 'test' END AS part FROM lots JOIN f USING (buyer)")
def temporal_split(t: Tables) -> DataFrame:
    return asof.temporal_split(lots(t), ["buyer"], "pub").select("lot", "part")


_CUT = "cuts AS (SELECT unnest(generate_series(DATE '1996-01-01', DATE '2001-01-01', INTERVAL 90 DAY))::DATE AS cutoff)"


@query("rewind_world", f"WITH {LOTS}, {_CUT} SELECT cutoff, count(*) AS lots, count(n_tenders) AS labelled, round(avg((n_tenders <= 1)::INT), 6) AS low_rate FROM lots, cuts WHERE pub < cutoff GROUP BY 1")
def rewind_world(t: Tables) -> DataFrame:
    w = asof.worlds(lots(t), "pub", asof.cutoffs(t.spark, "1996-01-01", "2001-01-01", 90))
    return w.groupBy("cutoff").agg(F.count(F.lit(1)).alias("lots"), F.count("n_tenders").alias("labelled"), r6(F.avg((F.col("n_tenders") <= 1).cast("double"))).alias("low_rate"))


_REPLAY = f"{LOTS}, {_CUT}, sc AS (SELECT buyer, cutoff, max(value % 1000) / 1000 AS score, max(value % 1000) / 1000 >= 0.9 AS flag, max(n_tenders) AS truth FROM lots, cuts WHERE pub < cutoff AND pub >= cutoff - 90 GROUP BY 1, 2), rp AS (SELECT buyer, round(max(score), 6) AS best_score, min(cutoff) FILTER (flag) AS flag_week, round(arg_min(score, cutoff) FILTER (flag), 6) AS flag_score, min(cutoff) AS first_week, count(*) AS times_scored FROM sc GROUP BY 1)"


def _replayed(t: Tables) -> DataFrame:
    w = asof.worlds(lots(t), "pub", asof.cutoffs(t.spark, "1996-01-01", "2001-01-01", 90)).filter(F.col("pub") >= F.date_sub("cutoff", 90))
    s = w.groupBy("buyer", "cutoff").agg((F.max(F.col("value") % 1000) / 1000).alias("score"))
    return rounded(asof.replay(s, ["buyer"], "cutoff", "score", F.col("score") >= 0.9), "best_score", "flag_score")


@query("replay_best", f"WITH {_REPLAY} SELECT * FROM rp")
def replay_best(t: Tables) -> DataFrame:
    return _replayed(t)


@query("replay_weeks", f"WITH {_REPLAY} SELECT flag_week, count(*) AS flagged, round(avg((buyer % 4 = 0)::INT), 6) AS precision FROM rp WHERE flag_week IS NOT NULL GROUP BY 1")
def replay_weeks(t: Tables) -> DataFrame:
    return rounded(asof.replay_weeks(_replayed(t), "flag_week", F.col("buyer") % 4 == 0), "precision")


@query(
    "references_at_close",
    f"""WITH {WINS}, p AS (SELECT firm, lot, min(day) AS published, max(day) + 60 AS close FROM wins GROUP BY 1, 2) SELECT a.firm, a.lot, a.close, count(b.lot) AS refs_at_close FROM p a LEFT JOIN p b ON a.firm = b.firm AND b.published <= a.close AND b.lot <> a.lot GROUP BY 1, 2, 3""",
)
def references_at_close(t: Tables) -> DataFrame:
    p = wins(t).groupBy("firm", "lot").agg(F.min("day").alias("published"), F.date_add(F.max("day"), 60).alias("close"))
    return asof.references_at_close(p, "firm", "lot", "close", "published")


# --- selection --------------------------------------------------------------------------------------


def _subs(t: Tables) -> DataFrame:
    rows = [(1, ["Brand#1"], None, 5, 5), (2, ["Brand#2", "Brand#3"], ["1", "2"], 10, 3), (3, ["Brand#21"], [], 0, None)]
    return t.spark.createDataFrame(rows, "sub int, code_prefixes array<string>, region_prefixes array<string>, min_days int, max_picks int")


@query(
    "selection_topk",
    """WITH s AS (SELECT * FROM (VALUES (1, ['Brand#1'], []::VARCHAR[], 5, 5), (2, ['Brand#2', 'Brand#3'], ['1', '2'], 10, 3), (3, ['Brand#21'], [], 0, 5)) AS v(sub, cp, rp, want, cap)), l AS (SELECT p_partkey, p_brand AS code, (p_partkey % 25)::VARCHAR AS region, p_size AS days_left, p_retailprice AS score FROM part WHERE p_size > 3)
    SELECT sub, p_partkey, round(score, 2) AS score, rank FROM (SELECT *, row_number() OVER (PARTITION BY sub ORDER BY score DESC, p_partkey) AS rank FROM l, s WHERE len(list_filter(cp, lambda p: starts_with(code, p))) > 0 AND (len(rp) = 0 OR len(list_filter(rp, lambda p: starts_with(region, p))) > 0) AND (want <= 0 OR days_left >= want)) WHERE rank <= cap""",
)
def selection_topk(t: Tables) -> DataFrame:
    rows = t.part.select("p_partkey", F.col("p_brand").alias("code"), (F.col("p_partkey") % 25).cast("string").alias("region"), F.col("p_size").alias("days_left"), F.col("p_retailprice").alias("score"), (F.col("p_size") > 3).alias("flag"))
    x = sel.for_subscriptions(rows, _subs(t), "sub", "score", "p_partkey")
    return x.select("sub", "p_partkey", F.round("score", 2).alias("score"), "rank")


@query(
    "simulate_picks",
    """WITH m AS (SELECT DISTINCT c_custkey, p_partkey, p_retailprice FROM customer JOIN part ON p_size = c_nationkey OR p_size = c_nationkey + 1), r AS (SELECT *, row_number() OVER (PARTITION BY c_custkey ORDER BY p_retailprice DESC, p_partkey) AS slot FROM m),
    h AS (SELECT DISTINCT o_custkey, l_partkey FROM orders JOIN lineitem ON l_orderkey = o_orderkey) SELECT c_custkey, p_partkey, slot FROM r LEFT JOIN h ON o_custkey = c_custkey AND l_partkey = p_partkey WHERE slot <= 5 AND o_custkey IS NULL""",
)
def simulate_picks(t: Tables) -> DataFrame:
    wanted = t.customer.select("c_custkey", F.explode(F.array(F.col("c_nationkey"), F.col("c_nationkey") + 1)).alias("p_size"))
    seen = t.orders.join(t.lineitem, F.col("l_orderkey") == F.col("o_orderkey")).select(F.col("o_custkey").alias("c_custkey"), F.col("l_partkey").alias("p_partkey"))
    return sel.merged_picks(t.part.select("p_partkey", "p_size", "p_retailprice"), wanted, "c_custkey", "p_size", "p_retailprice", "p_partkey", 5, seen).select("c_custkey", "p_partkey", "slot")


@query("due_list", "WITH n AS (SELECT user_id, count(*) AS lots, min(ts)::DATE AS deadline FROM events WHERE event_type = 'signup' GROUP BY 1), w AS (SELECT DISTINCT user_id FROM events WHERE event_type = 'click' AND DATE '2024-02-01' - ts::DATE < 4) SELECT user_id, lots, deadline FROM n WHERE user_id NOT IN (SELECT user_id FROM w) AND user_id % 2 = 0")
def due_list(t: Tables) -> DataFrame:
    e = t.events.withColumn("day", F.col("ts").cast("date"))
    watched = e.select("user_id").distinct().filter("user_id % 2 = 0")
    written = e.filter("event_type = 'click'").select("user_id", F.col("day").alias("at"))
    return sel.due(watched, written, e.filter("event_type = 'signup'").select("user_id", F.col("day").alias("deadline")), "user_id", "2024-02-01", 4).select("user_id", "lots", "deadline")


@query("guard_sample", "SELECT event_id, user_id FROM events WHERE event_type = 'purchase' AND event_id NOT IN (SELECT event_id FROM events WHERE event_id % 5 = 0) ORDER BY ts DESC, event_id LIMIT 10")
def guard_sample(t: Tables) -> DataFrame:
    return sel.guard_sample(t.events.filter("event_type = 'purchase'"), t.events.filter("event_id % 5 = 0"), ["event_id"], "ts").select("event_id", "user_id")


@query("market_filter", "SELECT p_partkey FROM part WHERE (starts_with(p_brand, 'Brand#1') OR starts_with(p_brand, 'Brand#2')) AND starts_with((p_partkey % 25)::VARCHAR, '1')")
def market_filter(t: Tables) -> DataFrame:
    ok = fn.in_market(F.col("p_brand"), (F.col("p_partkey") % 25).cast("string"), F.array(F.lit("Brand#1"), F.lit("Brand#2")), F.array(F.lit("1")))
    return t.part.filter(ok).select("p_partkey")


# --- sources and scalars ----------------------------------------------------------------------------


@query("json_path_coverage", """SELECT 'k' AS path, count(*) FILTER (json_exists(props, '$.k')) AS held, round(avg(json_exists(props, '$.k')::INT), 6) AS share FROM events""")
def json_path_coverage(t: Tables) -> DataFrame:
    return rounded(files.path_coverage(t.events, "props"), "share")


@query("props_extract", "SELECT event_id, json_extract(props, '$.k')::INT AS k FROM events")
def props_extract(t: Tables) -> DataFrame:
    return t.events.select("event_id", F.from_json("props", "k int")["k"].alias("k"))


@query("html_links", """SELECT page_id, len(list_distinct(regexp_extract_all(html, 'href="([^"]*)"', 1)))::INT AS links FROM pages""")
def html_links(t: Tables) -> DataFrame:
    return t.pages.select("page_id", F.size(fn.urls(F.col("html"))).alias("links"))


@query(
    "platform_report",
    """WITH p AS (SELECT page_id, CASE WHEN contains(h, 'blog') THEN 'blog' WHEN contains(h, 'example.com') THEN 'com' ELSE 'other' END AS platform, CASE WHEN page_id % 3 = 0 THEN 'failed' ELSE 'ok' END AS outcome FROM (SELECT page_id, lower(regexp_extract(url, '^[a-z]+://([^/:?#]+)', 1)) AS h FROM pages))
    SELECT platform, count(*) AS tries, count(*) FILTER (outcome = 'ok') AS ok, round(avg((outcome = 'ok')::INT), 6) AS ok_rate, max(page_id) FILTER (outcome = 'ok') AS last_ok FROM p GROUP BY 1""",
)
def platform_report(t: Tables) -> DataFrame:
    p = t.pages.select("page_id", fn.platform_of(F.col("url"), {"blog": "blog", "example.com": "com"}).alias("platform"), F.when(F.col("page_id") % 3 == 0, "failed").otherwise("ok").alias("outcome"))
    return rounded(files.outcome_report(p, "platform", "outcome", "page_id"), "ok_rate")


@query("content_dedupe", "SELECT count(DISTINCT text) AS texts FROM documents")
def content_dedupe(t: Tables) -> DataFrame:
    """A11, D9."""
    return files.deduplicated(t.documents.select("text"), "text").agg(F.count(F.lit(1)).alias("texts"))


@query("durations", "WITH d AS (SELECT p_partkey, trunc(p_retailprice / 100) AS n, ['day', 'MON', 'YEAR', 'fortnight'][(p_partkey % 4 + 1)::INT] AS unit FROM part), m AS (SELECT p_partkey, (n * CASE unit WHEN 'day' THEN 1 WHEN 'MON' THEN 30 WHEN 'YEAR' THEN 365 END)::INT AS days FROM d) SELECT p_partkey, days, CASE WHEN days > 0 AND days <= 7300 THEN days END AS contract FROM m")
def durations(t: Tables) -> DataFrame:
    unit = F.element_at(F.array(*[F.lit(u) for u in ("day", "MON", "YEAR", "fortnight")]), (F.col("p_partkey") % 4 + 1).cast("int"))
    m = fn.measure_days((F.col("p_retailprice") / 100).cast("string"), unit)
    return t.part.select("p_partkey", m.alias("days"), fn.contract_days(m, F.lit(None).cast("date"), F.lit(None).cast("date"))["days"].alias("contract"))


# --- windows of the event stream in batch form ------------------------------------------------------


@query("tumbling_events", "SELECT event_type, strftime(time_bucket(INTERVAL '7 days', ts, TIMESTAMP '1970-01-01'), '%Y-%m-%d') AS week, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY 1, 2")
def tumbling_events(t: Tables) -> DataFrame:
    x = st.tumbling(t.events, "ts", ["event_type"], "7 days")
    return x.select("event_type", F.date_format("window.start", "yyyy-MM-dd").alias("week"), "n", F.round("total", 4).alias("total"))


@query("sliding_events", "WITH s AS (SELECT event_type, time_bucket(INTERVAL '1 day', ts, TIMESTAMP '1970-01-01') - INTERVAL 1 DAY * k AS w FROM events, (SELECT unnest([0, 1]) AS k)) SELECT event_type, strftime(w, '%Y-%m-%d') AS day, count(*) AS n FROM s GROUP BY 1, 2")
def sliding_events(t: Tables) -> DataFrame:
    x = st.sliding(t.events, "ts", ["event_type"], "2 days", "1 day")
    return x.select("event_type", F.date_format("window.start", "yyyy-MM-dd").alias("day"), "n")


@query(
    "session_events",
    "WITH g AS (SELECT user_id, ts, CASE WHEN ts >= lag(ts) OVER w + INTERVAL 6 HOUR OR lag(ts) OVER w IS NULL THEN 1 ELSE 0 END AS new FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts)), s AS (SELECT *, sum(new) OVER (PARTITION BY user_id ORDER BY ts) AS k FROM g) SELECT user_id, epoch_us(min(ts)) AS began, count(*) AS n FROM s GROUP BY user_id, k",
)
def session_events(t: Tables) -> DataFrame:
    x = st.sessions(t.events, "ts", ["user_id"], "6 hours")
    return x.select("user_id", F.unix_micros(F.col("session_window.start").cast("timestamp")).alias("began"), "n")


@query("gbt_scores")
def gbt_scores(t: Tables) -> DataFrame:
    """Fitted on documents with odd ids; no SQL form."""
    d = t.documents.join(t.labels, "doc_id").select("doc_id", "lang", F.col("n_chars").cast("double").alias("n_chars"), F.length(F.regexp_replace("text", "[^#*%$&]", "")).cast("double").alias("symbols"), "quality")
    model = ml.fit(d.filter("doc_id % 2 = 1"), ["n_chars", "symbols"], ["lang"], "quality", trees=5)
    return ml.score(model, d).select("doc_id", r6("score").alias("score"))
