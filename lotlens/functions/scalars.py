"""Scalar library: pure column expressions, all inside code generation where Spark can."""

from __future__ import annotations

import hashlib
import json
from collections.abc import Mapping, Sequence

from pyspark.sql import Column, functions as F

# Days of each unit code; a month is 30 and a year 365 days.
UNIT_DAYS = {"DAY": 1, "DAYS": 1, "D": 1, "WEE": 7, "WEEK": 7, "WEEKS": 7, "WK": 7, "MON": 30, "MONTH": 30, "MONTHS": 30, "MO": 30, "ANN": 365, "YEAR": 365, "YEARS": 365, "YR": 365}
# Longest measure and longest contract, in days.
MEASURE_MAX_DAYS, CONTRACT_MAX_DAYS = 365 * 100, 365 * 20
# Widths of the levels of hierarchical codes.
LEVELS = {"cpv_main": (3, 4, 6, 8), "cpv": (2, 3, 4), "nuts": (3, 4, 5), "postal": (1,)}
# Legal forms stripped from firm names.
LEGAL_FORMS = ("gmbh", "co", "kg", "ag", "mbh", "se", "ohg", r"e\.?k", "und")


def blank_to_null(c: Column) -> Column:
    """Trimmed text; '' becomes NULL (A2)."""
    return F.nullif(F.trim(c), F.lit(""))


def first_filled(*cols: Column) -> Column:
    """First value that is neither NULL nor '' (B1)."""
    return F.coalesce(*[F.nullif(c, F.lit("")) for c in cols])


def first_filled_array(*cols: Column) -> Column:
    """First array that is neither NULL nor empty (B1)."""
    return F.coalesce(*[F.when(F.size(c) > 0, c) for c in cols])


def iso_date(c: Column) -> Column:
    """Date of the first ten characters; NULL if they are none (B4, N)."""
    return F.try_to_date(F.substring(c, 1, 10), "yyyy-MM-dd")


def compact_date(c: Column) -> Column:
    return F.try_to_date(c, "yyyyMMdd")


def strict_bool(c: Column) -> Column:
    """true/false by those literals only, else NULL."""
    return F.when(c == "true", True).when(c == "false", False)


def withheld(c: Column, sentinel: float = -1.0) -> Column:
    """A number with the withheld sentinel as NULL."""
    n = c.try_cast("double")
    return F.when(n != sentinel, n)


def measure_days(value: Column, unit: Column) -> Column:
    """Days of a measure: truncated, by unit; NULL for unknown units and beyond a century (B2)."""
    table = F.create_map(*[F.lit(x) for kv in UNIT_DAYS.items() for x in kv])
    whole = value.try_cast("double").try_cast("bigint")
    days = whole * F.try_element_at(table, F.upper(unit))
    return F.when(F.abs(days) <= MEASURE_MAX_DAYS, days.cast("int"))


def contract_days(measure: Column, start: Column, end: Column) -> Column:
    """struct(days, source): the measure, else the inclusive span of the dates; both NULL outside (0, 20 years]."""
    span = F.datediff(end, start) + 1
    days = F.coalesce(measure, F.when(span > 0, span))
    source = F.when(measure.isNotNull(), "measure").when(span > 0, "dates")
    ok = (days > 0) & (days <= CONTRACT_MAX_DAYS)
    return F.struct(F.when(ok, days).alias("days"), F.when(ok, source).alias("source"))


def level(code: Column, width: int) -> Column:
    """A hierarchical code cut to a level."""
    return F.when(F.length(code) >= width, F.substring(code, 1, width))


def is_deep(code: Column) -> Column:
    """An eight-digit code whose last four digits are not all 0."""
    return (F.length(code) == 8) & (F.substring(code, 5, 4) != "0000")


def lot_codes(main: Column, additional: Column) -> Column:
    """Main code, then the additional ones, without NULLs and blanks."""
    both = F.concat(F.array(main), F.coalesce(additional, F.array().cast("array<string>")))
    return F.filter(both, lambda x: x.isNotNull() & (x != ""))


def action_deadline(offer: Column, participation: Column) -> Column:
    return F.coalesce(offer, participation)


def in_market(code: Column, region: Column, code_prefixes: Column, region_prefixes: Column) -> Column:
    """Any code prefix and any region prefix; an empty list of regions takes all, a NULL code fails."""
    regions = F.coalesce(region_prefixes, F.array().cast("array<string>"))
    by_code = F.exists(code_prefixes, lambda p: code.startswith(p))
    by_region = (F.size(regions) == 0) | F.exists(regions, lambda p: F.coalesce(region, F.lit("")).startswith(p))
    return F.coalesce(by_code & by_region, F.lit(False))


def deadline_ok(days: Column, want: Column) -> Column:
    """Days left reach what is wanted; NULL fails unless nothing is wanted."""
    return F.when(F.coalesce(want, F.lit(0)) <= 0, True).otherwise(F.coalesce(days >= want, F.lit(False)))


def bid_sum(bids: Column) -> Column:
    """Sum of EUR amounts, an unnamed currency counts as EUR, 0 becomes NULL."""
    eur = F.filter(bids, lambda b: F.coalesce(b["currency"], F.lit("EUR")) == "EUR")
    total = F.aggregate(eur, F.lit(0.0), lambda s, b: s + F.coalesce(b["amount"], F.lit(0.0)))
    return F.nullif(total, F.lit(0.0))


def band(value: Column, edges: Sequence[float]) -> Column:
    """Half-open value band [lo, hi) by number; NULL below the first edge."""
    out = F.lit(None).cast("int")
    for k, low in enumerate(edges):
        out = F.when(value >= low, k).otherwise(out)
    return out


def nuts1(code: Column) -> Column:
    return F.coalesce(F.nullif(F.substring(code, 1, 3), F.lit("")), F.lit("?"))


def alias_key(name: Column) -> Column:
    """Firm spelling key: lowered, legal forms and all but letters off, first two words; short keys keep the plain name."""
    bare = F.regexp_replace(F.lower(name), rf"\b({'|'.join(LEGAL_FORMS)})\b", " ")
    words = F.filter(F.split(F.regexp_replace(bare, "[^a-zäöüß ]", " "), " +"), lambda w: w != "")
    key = F.array_join(F.slice(words, 1, 2), " ")
    return F.when(F.length(key) >= 6, key).otherwise(F.lower(name))


def norm_buyer(name: Column) -> Column:
    """Case-folded name with single spaces."""
    return F.trim(F.regexp_replace(F.replace(F.lower(name), F.lit("ß"), F.lit("ss")), r"\s+", " "))


def fold(c: Column) -> Column:
    """Umlauts spelled out."""
    for a, b in (("ä", "ae"), ("ö", "oe"), ("ü", "ue"), ("ß", "ss")):
        c = F.replace(c, F.lit(a), F.lit(b))
    return c


def tokens(text: Column, least: int = 3) -> Column:
    """Case-folded words of letters."""
    low = F.replace(F.lower(F.coalesce(text, F.lit(""))), F.lit("ß"), F.lit("ss"))
    return F.regexp_extract_all(low, F.lit("([a-zäöü]{%d,})" % least), F.lit(1))


def slug(c: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(fold(F.lower(c)), "[^a-z0-9]+", "-"), "^-|-$", "")


def sentences(text: Column) -> Column:
    """Pieces after . ! ? and line breaks, trimmed, none empty."""
    marked = F.regexp_replace(F.coalesce(text, F.lit("")), r"([.!?])[ \t\r\n]+|\n+", "$1\u0001")
    return F.filter(F.transform(F.split(marked, "\u0001"), lambda s: F.trim(s)), lambda s: s != "")


def sentence_key(s: Column) -> Column:
    """Sixteen hex digits that equal sentences share, whatever their numbers are."""
    return F.substring(F.sha1(F.regexp_replace(F.regexp_replace(F.lower(s), "[0-9]", "0"), r"\s+", " ").cast("binary")), 1, 16)


def subsume(words: Column) -> Column:
    """Words, shortest first (then by letters), without those that hold a kept one (I8)."""
    ordered = F.transform(F.array_sort(F.transform(F.array_distinct(words), lambda w: F.struct(F.length(w).alias("n"), w.alias("w")))), lambda s: s["w"])
    none = F.array().cast("array<string>")
    return F.aggregate(ordered, none, lambda kept, w: F.when(F.exists(kept, lambda k: F.contains(w, k)), kept).otherwise(F.concat(kept, F.array(w))))


def within_one_edit(a: Column, b: Column) -> Column:
    return F.levenshtein(a, b, 1) >= 0


def wilson(k: Column, n: Column, z: float = 1.96) -> tuple[Column, Column]:
    """Wilson score interval clipped to [0, 1]; NULL if n = 0."""
    m = F.nullif(n.cast("double"), F.lit(0.0))
    p = k / m
    mid = p + z * z / (2 * m)
    half = z * F.sqrt(F.greatest(p * (1 - p) / m + z * z / (4 * m * m), F.lit(0.0)))
    scale = 1 + z * z / m
    some = m.isNotNull()
    return F.when(some, F.greatest((mid - half) / scale, F.lit(0.0))), F.when(some, F.least((mid + half) / scale, F.lit(1.0)))


def slice_size(n: Column, share: float) -> Column:
    """max(1, round half to even(n * share))."""
    return F.greatest(F.lit(1), F.bround(n * F.lit(share)).cast("int"))


def pseudo_ceil(n: Column, share: float) -> Column:
    return (n * F.lit(share) + F.lit(0.999)).cast("int")


def hash_draw(*parts: Column) -> Column:
    """A draw in [0, 1) from the first 52 bits of an md5 of the joined parts."""
    return F.conv(F.substring(F.md5(F.concat_ws("|", *parts).cast("binary")), 1, 13), 16, 10).cast("double") / F.lit(float(1 << 52))


def dot(a: Column, b: Column) -> Column:
    both = F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double"))
    return F.aggregate(both, F.lit(0.0), lambda s, x: s + x)


def unit(a: Column) -> Column:
    """The vector scaled to length one; a zero vector stays."""
    size = F.sqrt(dot(a, a))
    return F.when(size > 0, F.transform(a, lambda x: x.cast("double") / size)).otherwise(F.transform(a, lambda x: x.cast("double")))


def cosine(a: Column, b: Column) -> Column:
    return dot(a, b) / F.nullif(F.sqrt(dot(a, a)) * F.sqrt(dot(b, b)), F.lit(0.0))


def reasons(*checks: tuple[Column, str]) -> Column:
    """Names of the checks that hold, in order (quality flags B16, reject reasons)."""
    return F.array_compact(F.array(*[F.when(c, name) for c, name in checks]))


def fingerprint(config: Mapping, width: int = 10) -> str:
    """sha256 of the sorted JSON of a configuration, cut."""
    return hashlib.sha256(json.dumps(config, sort_keys=True, default=str).encode()).hexdigest()[:width]


def window_days(text: str) -> int:
    """Days of ``7d``, ``2w`` or ``3m``; a month is 30 days."""
    number, kind = int(text[:-1]), text[-1]
    return number * {"d": 1, "w": 7, "m": 30}[kind]


def host_of(url: Column) -> Column:
    return F.lower(F.regexp_extract(url, r"^[a-z]+://([^/:?#]+)", 1))


def platform_of(url: Column, table: Mapping[str, str]) -> Column:
    """Platform by a part of the host, first match wins; 'other' for none, NULL for no host."""
    host = F.nullif(host_of(url), F.lit(""))
    out = F.when(host.isNull(), None)
    for part, name in table.items():
        out = out.when(F.contains(host, F.lit(part)), name)
    return out.otherwise("other")


def urls(text: Column) -> Column:
    """Distinct link targets in order, with & decoded."""
    return F.array_distinct(F.transform(F.regexp_extract_all(text, F.lit('href="([^"]*)"'), F.lit(1)), lambda u: F.replace(u, F.lit("&amp;"), F.lit("&"))))


def register(spark) -> None:
    """SQL names for the helpers that SQL users need."""
    spark.sql("CREATE OR REPLACE TEMPORARY FUNCTION fold_umlauts(s STRING) RETURNS STRING RETURN replace(replace(replace(replace(s, 'ä', 'ae'), 'ö', 'oe'), 'ü', 'ue'), 'ß', 'ss')")
    spark.sql("CREATE OR REPLACE TEMPORARY FUNCTION hash_draw(s STRING) RETURNS DOUBLE RETURN cast(conv(substring(md5(cast(s as binary)), 1, 13), 16, 10) as double) / 4503599627370496D")
    spark.sql(
        "CREATE OR REPLACE TEMPORARY FUNCTION wilson_low(k DOUBLE, n DOUBLE) RETURNS DOUBLE RETURN "
        "greatest((k / nullif(n, 0) + 1.9208D / nullif(n, 0) - 1.96D * sqrt(greatest(k / nullif(n, 0) * (1 - k / nullif(n, 0)) / nullif(n, 0) + 0.9604D / nullif(n * n, 0), 0D))) / (1 + 3.8416D / nullif(n, 0)), 0D)"
    )
