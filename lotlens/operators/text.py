"""Lexicons: document frequencies, stems, trade dictionaries, evidence and boilerplate."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from ..functions import scalars as fn

# Fixed values.
MIN_STEM, TYPO_LEN, SYNONYM = 6, 8, 0.8
DICT_MIN_LOTS, DICT_MIN_IN, DICT_MIN_RATIO, DICT_MIN_BUYERS, DICT_BUYER_SHARE, DICT_MAX = 20, 0.10, 8.0, 2, 0.1, 30
STRIP_PROCS, STRIP_TRADES, STRIP_CHARS = 5, 3, 15


def doc_freq(texts: DataFrame, key: str, text: str, least: int = 3) -> DataFrame:
    """In how many texts each word occurs (a text's words are made distinct before the shuffle)."""
    words = texts.select(F.explode(F.array_distinct(fn.tokens(F.col(text), least))).alias("token"))
    return words.groupBy("token").agg(F.count(F.lit(1)).alias("df"))


def stems(freq: DataFrame) -> DataFrame:
    """I4: token -> stem: one of the endings en, e, s, n off, if at least six letters stay and the rest is itself a token."""
    ends = F.array(F.lit("en"), F.lit("e"), F.lit("s"), F.lit("n"))
    cut = freq.select("token", F.posexplode(ends).alias("place", "end")).filter(F.col("token").endswith(F.col("end")) & (F.length("token") - F.length("end") >= MIN_STEM))
    cut = cut.withColumn("rest", F.expr("substring(token, 1, length(token) - length(end))"))
    known = cut.join(freq.select(F.col("token").alias("rest")), "rest", "left_semi").groupBy("token").agg(F.min_by("rest", "place").alias("stem"))
    return freq.join(known, "token", "left").select("token", F.coalesce("stem", "token").alias("stem"))


def section_text(title: Column, body: Column, marker: str) -> Column:
    """Title and what follows the last section marker, or the whole body, case-folded."""
    tail = F.regexp_extract(body, rf"(?is)^.*(?:{marker})(.*)$", 1)
    return F.lower(F.concat_ws(" ", title, F.when(tail != "", tail).otherwise(body)))


def words_with_roots(freq: DataFrame, roots: DataFrame, exceptions: DataFrame | None = None) -> DataFrame:
    """(token, root) where a root is part of a token and no exception is.

    The vocabulary, not the texts, meets the roots; both root lists are hand-kept and broadcast.
    """
    words = freq.select("token").withColumn("folded", fn.fold(F.col("token")))
    hit = words.join(F.broadcast(roots.select("root").distinct()), F.expr("contains(folded, root)"))
    if exceptions is not None:
        hit = hit.join(F.broadcast(exceptions.select("exception").distinct()), F.expr("contains(folded, exception)"), "left_anti")
    return hit.select("token", "root")


def text_roots(texts: DataFrame, key: str, text: str, rooted: DataFrame) -> DataFrame:
    """Distinct (text, root)."""
    words = texts.select(key, F.explode(F.array_distinct(fn.tokens(F.col(text)))).alias("token"))
    return words.join(rooted, "token").select(key, "root").distinct()


def recurring(refs: DataFrame, by: str, ref: str, what: str, share: float, least: int = 1) -> DataFrame:
    """Values in at least max(least, pseudo-ceil(share * references)) of a group's references."""
    size = refs.groupBy(by).agg(F.count_distinct(ref).alias("refs"))
    n = refs.groupBy(by, what).agg(F.count_distinct(ref).alias("n"))
    need = F.when(F.col("refs") <= 1, 1).otherwise(F.greatest(F.lit(least), fn.pseudo_ceil(F.col("refs"), share)))
    return n.join(size, by).filter(F.col("n") >= need).select(by, what, "n", "refs")


def prune_lists(words: DataFrame, by: Sequence[str], word: str, most: int = 25) -> DataFrame:
    """Each group's words, shortest of a family only, at most ``most``."""
    return words.groupBy(*by).agg(F.slice(fn.subsume(F.collect_set(word)), 1, most).alias("words"))


def evidence(lots: DataFrame, key: str, title: str, body: str, keywords: DataFrame, by: str, word: str) -> DataFrame:
    """Tier of each keyword in each lot: 1 part of a token, 2 a token one edit away (8 letters or more).

    The vocabulary, not the lots, meets the keywords. For typos it does so through
    blocks (equal first or last half) that two words within one edit always share.
    """
    text = lots.select(key, F.lower(F.col(title)).alias("title"), F.lower(F.concat_ws(" ", title, body)).alias("text"))
    words = keywords.select(by, word).distinct()
    tokens = text.select(key, "title", F.explode(F.array_distinct(fn.tokens(F.col("text")))).alias("token"))
    vocabulary = tokens.select("token").distinct()
    inside = parts_of(vocabulary, "token", words.select(word).distinct(), word).select("token", word, F.lit(1).alias("tier"))
    long = words.select(word).distinct().filter(F.length(word) >= TYPO_LEN)
    near = _halves(long, word)
    spread = _halves(vocabulary.filter(F.length("token") >= TYPO_LEN - 1), "token", spread=True)
    typo = spread.join(near, "block").filter(fn.within_one_edit(F.col("token"), F.col(word))).select("token", word, F.lit(2).alias("tier"))
    pairs = inside.union(typo).groupBy("token", word).agg(F.min("tier").alias("tier"))
    found = tokens.join(pairs, "token").join(words, word).withColumn("in_title", F.expr("contains(title, token)"))
    return found.groupBy(key, by, word).agg(F.min("tier").alias("tier"), F.max("in_title").alias("in_title"))


def parts_of(vocabulary: DataFrame, token: str, words: DataFrame, word: str) -> DataFrame:
    """(token, word) of every word that is part of a token: the substrings of the tokens, of the words' lengths, are joined by equality."""
    lengths = words.agg(F.array_sort(F.collect_set(F.length(word))).alias("lengths"))  # one row, as long as the longest word at most
    at = F.transform(F.sequence(F.lit(1), F.length(token)), lambda i: F.transform(F.filter("lengths", lambda n: i + n - 1 <= F.length(token)), lambda n: F.substring(F.col(token), i, n)))
    each = vocabulary.filter(F.length(token) > 0).crossJoin(F.broadcast(lengths)).select(token, F.explode(F.array_distinct(F.flatten(at))).alias(word))
    return each.join(words, word).select(token, word)


def _halves(words: DataFrame, col: str, spread: bool = False) -> DataFrame:
    """Blocks that a word and every word one edit away share: its length's halves."""
    lengths = F.array(F.lit(0)) if not spread else F.array(F.lit(-1), F.lit(0), F.lit(1))
    out = words.select(col, F.explode(lengths).alias("off"))
    base = F.length(col) + F.col("off")
    h = F.floor(base / 2)
    blocks = F.array(
        F.concat(F.lit("h"), base.cast("string"), F.lit(":"), F.left(F.col(col), h)),
        F.concat(F.lit("t"), base.cast("string"), F.lit(":"), F.right(F.col(col), base - h - F.lit(1))),
    )
    return out.select(col, F.explode(blocks).alias("block"))


def convictions(found: DataFrame, key: str, by: str) -> DataFrame:
    """Witnesses, title witness and conviction (in the title, or two distinct keywords)."""
    n = found.groupBy(key, by).agg(F.count(F.lit(1)).alias("witnesses"), F.max("in_title").alias("title_witness"))
    return n.withColumn("convicts", F.col("title_witness") | (F.col("witnesses") >= 2))


def boilerplate(texts: DataFrame, procedure: str, trade: str, text: str, procs: int = STRIP_PROCS, trades: int = STRIP_TRADES, chars: int = STRIP_CHARS) -> DataFrame:
    """Keys of sentences found in at least ``procs`` procedures and ``trades`` trades."""
    each = texts.select(procedure, trade, F.explode(fn.sentences(F.col(text))).alias("s")).filter(F.length("s") >= chars)
    n = each.select(fn.sentence_key(F.col("s")).alias("key"), procedure, trade).groupBy("key").agg(F.count_distinct(procedure).alias("procedures"), F.count_distinct(trade).alias("trades"))
    return n.filter((F.col("procedures") >= procs) & (F.col("trades") >= trades))


def prepared(text: Column, most: int = 2000) -> Column:
    """The text that is embedded, at most ``most`` characters (a limit of the embedder, not of the rows)."""
    return F.substring(F.trim(F.regexp_replace(F.coalesce(text, F.lit("")), r"\s+", " ")), 1, most)


def text_hash(text: Column) -> Column:
    return F.substring(F.sha1(text.cast("binary")), 1, 16)


def repaired(text: Column) -> Column:
    """UTF-8 read as Latin-1 is decoded again, where that gives valid text; other text stays."""
    suspicious = text.rlike("[ÃÂ][\u0080-¿]")
    return F.when(suspicious & ~text.rlike("[^\u0000-ÿ]"), F.coalesce(F.try_validate_utf8(F.decode(F.encode(text, "ISO-8859-1"), "UTF-8")), text)).otherwise(text)


def root_audit(rooted_codes: DataFrame) -> DataFrame:
    """For each root its modal code and how far its words agree on it. Input: root, token, code, n."""
    per = rooted_codes.groupBy("root", "code").agg(F.sum("n").alias("n"))
    return per.groupBy("root").agg(F.max_by("code", F.struct("n", "code")).alias("modal_code"), F.max("n").alias("top"), F.sum("n").alias("total")).withColumn("agreement", F.col("top") / F.col("total"))
