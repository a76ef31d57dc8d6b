"""Keyword lists of firms and trades: derivation, votes, pruning, names, titles and phrases.

Words meet roots through the vocabulary: ``rooted`` is (token, root), made once by
``text.words_with_roots``. A firm's or a code's list is bounded by the roots, or by the
words that reach a share of its texts, so it is pruned in one row.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from ..functions import scalars as fn
from . import text as tx

# Fixed values.
REF_SHARE, MOST_WORDS, MAX_DOC_FREQ, LABEL_DF_MAX = 0.34, 25, 0.02, 5
VOTE_MARGIN, VOTE_MOST = 0.5, 6


def _words(df: DataFrame, keys: Sequence[str], text: str, least: int = 3) -> DataFrame:
    """(keys, token): the distinct words of each text."""
    return df.select(*keys, F.explode(F.array_distinct(fn.tokens(F.col(text), least))).alias("token"))


def _pruned(words: DataFrame, by: str, order: Sequence[str], most: int | None = None) -> DataFrame:
    """(by, word, rank): shortest of a family only, ordered by the columns ``order`` (smallest first), then length and word."""
    kept = words.groupBy(by).agg(fn.subsume(F.collect_set("word")).alias("kept"))
    held = words.join(kept, by).filter(F.array_contains("kept", F.col("word"))).drop("kept")
    ranked = held.withColumn("rank", F.row_number().over(W.partitionBy(by).orderBy(*order, F.length("word"), "word")))
    return ranked if most is None else ranked.filter(F.col("rank") <= most)


def root_share(refs: DataFrame, rooted: DataFrame, firm: str = "firm", ref: str = "ref", text: str = "text") -> DataFrame:
    """(firm, root, n): how many of a firm's references carry each root."""
    found = _words(refs, [firm, ref], text).join(rooted, "token").select(firm, ref, "root").distinct()
    return found.groupBy(firm, "root").agg(F.count(F.lit(1)).alias("n"))


def wide_keywords(refs: DataFrame, rooted: DataFrame, firm: str = "firm", ref: str = "ref", text: str = "text") -> DataFrame:
    """(firm, word, n, rank): every root of a firm's references, the most frequent first."""
    n = root_share(refs, rooted, firm, ref, text).withColumnRenamed("root", "word").withColumn("less", -F.col("n"))
    return _pruned(n, firm, ["less"], MOST_WORDS).select(firm, "word", "n", "rank")


def name_keywords(firms: DataFrame, rooted: DataFrame, firm: str = "firm", name: str = "name") -> DataFrame:
    """(firm, word, rank): the roots in a firm's own name."""
    found = _words(firms, [firm], name).join(rooted, "token").select(firm, F.col("root").alias("word")).distinct()
    return _pruned(found, firm, [])


def _sizes(refs: DataFrame, firm: str, ref: str) -> DataFrame:
    """(firm, refs, need): references and how many of them a word must be in."""
    size = refs.groupBy(firm).agg(F.count_distinct(ref).alias("refs"))
    return size.withColumn("need", F.greatest(F.lit(1), F.least("refs", fn.pseudo_ceil(F.col("refs"), REF_SHARE))))


def derive_keywords(
    refs: DataFrame, labels: DataFrame, rooted: DataFrame | None = None, freq: DataFrame | None = None, stems: DataFrame | None = None, texts: int = 0,
    label_freq: DataFrame | None = None, firm: str = "firm", ref: str = "ref", text: str = "text", buyer: str = "buyer", most: int = MOST_WORDS,
) -> DataFrame:
    """(firm, word, n, rank): what recurs in a firm's references and is no word of its buyers' names.

    ``refs``: firm, ref, text, buyer; ``labels``: firm, label (the texts of its trusted codes).
    With ``rooted`` roots are counted, and the labels' roots join outright. Without it words
    are, under the rarity sieve: six letters, in at most 2 % of ``texts`` texts (``freq``),
    counted by stem; a label's word may be more common if at most five labels have it.
    A word of a label alone counts as often as there are references.
    """
    size = _sizes(refs, firm, ref)
    of_buyers = _words(refs, [firm], buyer).select(firm, F.col("token").alias("word")).distinct()
    if rooted is not None:
        n = root_share(refs, rooted, firm, ref, text).withColumnRenamed("root", "word").withColumn("less", F.lit(0).cast("bigint"))
        more = _words(labels, [firm], "label").join(rooted, "token").select(firm, F.col("root").alias("word")).distinct()
    else:
        n = _words(refs, [firm, ref], text, tx.MIN_STEM).distinct().groupBy(firm, F.col("token").alias("word")).agg(F.count(F.lit(1)).alias("n"))
        n = n.join(freq.select(F.col("token").alias("word"), "df"), "word").filter(F.col("df") <= MAX_DOC_FREQ * texts)
        n = n.withColumn("less", -F.col("df")).drop("df")
        spread = label_freq.select("token", F.col("df").alias("in_labels"))
        more = _words(labels, [firm], "label", tx.MIN_STEM).distinct().join(freq, "token", "left").join(spread, "token", "left")
        more = more.filter((F.coalesce("in_labels", F.lit(0)) <= LABEL_DF_MAX) | (F.coalesce("df", F.lit(0)) <= MAX_DOC_FREQ * texts))
        more = more.join(stems, "token", "left").select(firm, F.coalesce("stem", "token").alias("word")).distinct()
    own = n.join(size, firm).filter(F.col("n") >= F.col("need")).join(of_buyers, [firm, "word"], "left_anti")
    if rooted is None:
        own = own.join(stems.withColumnRenamed("token", "word"), "word", "left").withColumn("word", F.coalesce("stem", "word")).filter(F.length("word") >= tx.MIN_STEM)
        own = own.groupBy(firm, "word").agg(F.max(F.struct("n", "less")).alias("m")).select(firm, "word", "m.n", "m.less")
    own = own.select(firm, "word", "n", "less")
    new = more.join(own, [firm, "word"], "left_anti").join(size, firm).select(firm, "word", F.col("refs").alias("n"), F.lit(0).cast("bigint").alias("less"))
    every = own.union(new).withColumn("down", -F.col("n"))
    return _pruned(every, firm, ["down", "less"], most).select(firm, "word", "n", "rank")


def trade_dictionaries(
    lots: DataFrame, codes: DataFrame, rooted: DataFrame, freq: DataFrame, stems: DataFrame, texts: int, key: str = "lot", code: str = "code", buyer: str = "buyer", text: str = "text",
    least: int = tx.DICT_MIN_LOTS, most: int = tx.DICT_MAX,
) -> DataFrame:
    """(code, word, score, rank): the words that tell a code's lots from the others.

    ``codes``: (lot, code), any number for a lot. The roots of a code's lots vote: those
    with half the votes of the first, six at most, are its signature, and only lots that
    carry one of them count (a code whose lots carry no root keeps all). Of the rest, at
    least ``least`` lots, a word counts if it carries a root, has six letters, is in a
    tenth of the lots, eight times more often than elsewhere, with two buyers and a tenth
    of them. Words are counted as they stand, then stemmed; the best of a stem stays,
    and the shortest of a family.
    """
    words = _words(lots, [key, buyer], text).distinct()
    pool = codes.select(code, key).distinct().join(lots.select(key).distinct(), key)
    big = pool.groupBy(code).agg(F.count(F.lit(1)).alias("lots")).filter(F.col("lots") >= least).select(code)
    pool = pool.join(big, code, "left_semi")
    carried = words.join(rooted, "token").select(key, "root").distinct()
    polled = pool.join(carried, key)
    votes = polled.groupBy(code, "root").agg(F.count(F.lit(1)).alias("votes"))
    w = W.partitionBy(code)
    signature = votes.withColumn("top", F.max("votes").over(w)).withColumn("place", F.row_number().over(w.orderBy(F.desc("votes"), "root")))
    signature = signature.filter((F.col("place") <= VOTE_MOST) & (F.col("votes") >= VOTE_MARGIN * F.col("top"))).select(code, "root")
    voted = polled.join(signature, [code, "root"], "left_semi").select(code, key).distinct()
    voted = voted.union(pool.join(votes.select(code).distinct(), code, "left_anti").select(code, key))
    named = voted.join(lots.select(key, fn.norm_buyer(F.col(buyer)).alias("office")), key)
    size = named.groupBy(code).agg(F.count_distinct(key).alias("n_in"), F.count_distinct(F.nullif("office", F.lit(""))).alias("offices")).filter(F.col("n_in") >= least)
    long = words.filter(F.length("token") >= tx.MIN_STEM).select(key, F.nullif(fn.norm_buyer(F.col(buyer)), F.lit("")).alias("office"), "token").join(rooted.select("token").distinct(), "token", "left_semi")
    # A lot has a word once, so lots are counted by rows; offices are made distinct in a second step.
    n = voted.join(size.select(code), code, "left_semi").join(long, key).groupBy(code, "token", "office").agg(F.count(F.lit(1)).alias("k")).groupBy(code, "token").agg(F.sum("k").alias("k"), F.count("office").alias("nb"))
    n = n.join(size, code).filter((F.col("k") >= tx.DICT_MIN_IN * F.col("n_in")) & (F.col("nb") >= tx.DICT_MIN_BUYERS) & (F.col("nb") >= tx.DICT_BUYER_SHARE * F.col("offices")))
    f_in = F.col("k") / F.col("n_in")
    f_out = (F.col("df") - F.col("k")) / F.greatest(F.lit(texts) - F.col("n_in"), F.lit(1))
    scored = n.join(freq, "token").withColumn("f_in", f_in).withColumn("ratio", f_in / F.greatest(f_out, F.lit(1e-9))).filter(F.col("ratio") >= tx.DICT_MIN_RATIO)
    scored = scored.withColumn("score", F.col("f_in") * F.least("ratio", F.lit(100.0))).join(stems, "token", "left")
    best = scored.groupBy(code, F.coalesce("stem", "token").alias("word")).agg(F.round(F.max("score"), 9).alias("score")).withColumn("down", -F.col("score"))
    return _pruned(best, code, ["down"], most).select(code, "word", "score", "rank")


def firm_keywords(own: DataFrame, names: DataFrame, codes: DataFrame, dictionaries: DataFrame, firm: str = "firm", code: str = "code") -> DataFrame:
    """(firm, words): own words, then roots of the name, then the dictionaries of the firm's codes; a word that holds another goes.

    Inputs as made above: own and names (firm, word, rank), codes (firm, code), dictionaries (code, word, rank).
    """
    by_code = codes.join(dictionaries, code).select(firm, "word", F.lit(2).alias("source"), F.concat_ws("/", F.lpad(F.col("rank").cast("string"), 9, "0"), F.col(code)).alias("place"))
    listed = lambda df, k: df.select(firm, "word", F.lit(k).alias("source"), F.lpad(F.col("rank").cast("string"), 9, "0").alias("place"))
    every = listed(own, 0).union(listed(names, 1)).union(by_code)
    first = every.groupBy(firm, "word").agg(F.min(F.struct("source", "place")).alias("at"))
    one = first.groupBy(firm).agg(fn.subsume(F.collect_list("word")).alias("kept"), F.array_sort(F.collect_list(F.struct("at", "word"))).alias("listed"))
    return one.select(firm, F.filter(F.transform("listed", lambda x: x["word"]), lambda x: F.array_contains("kept", x)).alias("words"))


def recurring_codes(refs: DataFrame, firm: str = "firm", ref: str = "ref", code: str = "code", share: float = REF_SHARE) -> DataFrame:
    """(firm, code): deep codes (digits behind the fourth) in a share of a firm's references."""
    deep = refs.filter((F.length(code) == 8) & (F.substring(code, 5, 4) != "0000"))
    size = refs.groupBy(firm).agg(F.count_distinct(ref).alias("refs"))
    n = deep.groupBy(firm, code).agg(F.count_distinct(ref).alias("n")).join(size, firm)
    return n.filter(F.col("n") >= F.greatest(F.lit(1), F.least("refs", fn.pseudo_ceil(F.col("refs"), share)))).select(firm, code, "n")


def with_synonyms(found: DataFrame, tokens: DataFrame, keywords: DataFrame, vectors: DataFrame, key: str, by: str, word: str, bar: float = tx.SYNONYM) -> DataFrame:
    """The evidence (key, by, word, tier), and tier 3 for pairs of lot and firm without any: a token whose cosine to a keyword reaches the bar.

    ``tokens``: (key, token); ``keywords``: (by, word); ``vectors``: (token, vec) of both. The vocabulary meets the keywords, not the lots.
    """
    from .vectors import similar

    told = lambda words, name: words.select(F.col(name).alias("token")).distinct().join(vectors, "token").select(F.col("token").alias(name), "vec")
    near = similar(told(tokens, "token"), told(keywords, word), "token", word, "vec").filter(F.col("cos") >= bar)
    met = tokens.join(near, "token").join(keywords.select(by, word).distinct(), word).join(found.select(key, by).distinct(), [key, by], "left_anti")
    third = met.select(key, by, word).distinct().withColumn("tier", F.lit(3))
    return found.select(key, by, word, "tier").union(third)


def trades_of_titles(titles: DataFrame, trades: DataFrame, firm: str = "firm", title: str = "title") -> DataFrame:
    """(firm, trade, hits): trades whose words are in at least half of a firm's titles. ``trades``: trade, terms, exclude (hand-kept)."""
    folded = titles.select(firm, fn.fold(F.lower(F.coalesce(title, F.lit("")))).alias("t")).filter("t <> ''")
    need = folded.groupBy(firm).agg(F.greatest(F.lit(1), F.floor((F.count(F.lit(1)) + 1) / 2)).alias("need"))
    hit = F.exists("terms", lambda w: F.contains(F.col("t"), w)) & ~F.exists("exclude", lambda w: F.contains(F.col("t"), w))
    met = folded.crossJoin(F.broadcast(trades)).filter(hit)
    return met.groupBy(firm, "trade").agg(F.count(F.lit(1)).alias("hits")).join(need, firm).filter(F.col("hits") >= F.col("need")).select(firm, "trade", "hits")


def store_vocabulary(texts: Sequence[tuple[DataFrame, str]], roots: DataFrame, known: DataFrame, least: int = tx.MIN_STEM) -> DataFrame:
    """Every word that may need a vector: of the texts, labels and profiles (frame, column), known words of six letters, and all roots."""
    out = roots.select(F.col("root").alias("token")).union(known.select("token").filter(F.length("token") >= least))
    for df, text in texts:
        out = out.union(df.select(F.explode(F.array_distinct(fn.tokens(F.col(text), least))).alias("token")).distinct())
    return out.distinct()


def why_phrase(feature: Column, phrases: Mapping[str, str], prefixes: Sequence[tuple[Sequence[str], str]]) -> Column:
    """The phrase of a feature: its own, else that of the first list of prefixes it begins with, else NULL."""
    out = None
    for name, phrase in phrases.items():
        out = F.when(feature == name, phrase) if out is None else out.when(feature == name, phrase)
    for starts, phrase in prefixes:
        fits = F.lit(False)
        for s in starts:
            fits = fits | feature.startswith(s)
        out = F.when(fits, phrase) if out is None else out.when(fits, phrase)
    return F.lit(None).cast("string") if out is None else out


def why(contributions: DataFrame, key: str, feature: str, value: str, phrase: Column, k: int = 3) -> DataFrame:
    """(key, lonely, crowded): the k first different phrases of the largest positive and negative contributions (ties: by feature)."""
    told = contributions.withColumn("phrase", phrase).filter(F.col("phrase").isNotNull() & (F.col(value) != 0))
    told = told.withColumn("up", F.col(value) > 0).groupBy(key, "up", "phrase").agg(F.max(F.struct(F.abs(value).alias("most"), F.col(feature).alias("f"))).alias("m"))
    r = F.row_number().over(W.partitionBy(key, "up").orderBy(F.desc("m.most"), "m.f"))
    best = told.withColumn("place", r).filter(F.col("place") <= k)
    side = lambda up: F.transform(F.array_sort(F.collect_list(F.when(F.col("up") == up, F.struct("place", "phrase")))), lambda x: x["phrase"])
    return contributions.select(key).distinct().join(best.groupBy(key).agg(side(True).alias("lonely"), side(False).alias("crowded")), key, "left").select(
        key, F.coalesce("lonely", F.array().cast("array<string>")).alias("lonely"), F.coalesce("crowded", F.array().cast("array<string>")).alias("crowded")
    )


def lexicon_coverage(sizes: DataFrame, n: str = "n") -> DataFrame:
    """Firms, median, mean, empty lists and lists under three words. ``sizes``: one row for each firm, its number of words."""
    return sizes.agg(F.count(F.lit(1)).alias("firms"), F.median(n).alias("median"), F.avg(n).alias("mean"), F.count_if(F.col(n) == 0).alias("empty"), F.count_if(F.col(n) < 3).alias("under_three"))


def rejections(refs: DataFrame, rooted: DataFrame, freq: DataFrame, texts: int, firm: str = "firm", ref: str = "ref", text: str = "text", buyer: str = "buyer") -> DataFrame:
    """(reason, words): the first filter of the sieve that refuses each word of each firm."""
    n = _words(refs, [firm, ref], text).distinct().groupBy(firm, F.col("token").alias("word")).agg(F.count(F.lit(1)).alias("n")).join(_sizes(refs, firm, ref), firm)
    of_buyers = _words(refs, [firm], buyer).select(firm, F.col("token").alias("word")).distinct().withColumn("of_buyer", F.lit(True))
    n = n.join(of_buyers, [firm, "word"], "left").join(freq.select(F.col("token").alias("word"), "df"), "word", "left").join(rooted.select(F.col("token").alias("word")).distinct().withColumn("trade", F.lit(True)), "word", "left")
    reason = (
        F.when(F.col("n") < F.col("need"), "too few references").when(F.col("of_buyer"), "buyer name").when(F.length("word") < tx.MIN_STEM, "too short")
        .when(F.coalesce("df", F.lit(0)) > MAX_DOC_FREQ * texts, "store-common").when(F.col("trade").isNull(), "not a trade word")
    )
    return n.withColumn("reason", reason).filter("reason IS NOT NULL").groupBy("reason").agg(F.count(F.lit(1)).alias("words"))
