"""Text normalisers and tests, as Column builders."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Separators of composite cells, in the order in which they are tried.
COMPOSITE_SEPARATORS = (" - ", " / ", " | ", "\n", ";")
#: Texts read as booleans by the profiler.
BOOLEAN_TEXTS = ("true", "false", "yes", "no", "1", "0", "t", "f", "y", "n")


def text(c: Column) -> Column:
    """The text form, null as empty."""
    return F.coalesce(c.cast("string"), F.lit(""))


def trim_ws(c: Column) -> Column:
    """Without Unicode white space at either end; null stays null."""
    return F.regexp_replace(c, r"(?U)^\s+|\s+$", "")


def trim_(c: Column) -> Column:
    return trim_ws(text(c))


def filled(c: Column) -> Column:
    """The cell, with blank cells as null."""
    return F.when(c.cast("string").rlike(r"(?U)\S"), c)


def upper_(c: Column) -> Column:
    return F.upper(text(c))


def lower_(c: Column) -> Column:
    return F.lower(text(c))


def length_(c: Column) -> Column:
    return F.length(text(c))


def date_norm(c: Column) -> Column:
    """Ten-character dates to ISO: year first, or day first if the first part is past 12, else month first."""
    v = trim_(c)
    part = lambda at, n: F.substring(v, at, n)
    year_first = v.rlike(r"^[0-9]{4}([-/])[0-9]{2}\1[0-9]{2}$")
    year_last = v.rlike(r"^[0-9]{2}([-/])[0-9]{2}\1[0-9]{4}$")
    day_first = part(1, 2).try_cast("int") > 12
    return (
        F.when(year_first, F.concat_ws("-", part(1, 4), part(6, 2), part(9, 2)))
        .when(year_last & day_first, F.concat_ws("-", part(7, 4), part(4, 2), part(1, 2)))
        .when(year_last, F.concat_ws("-", part(7, 4), part(1, 2), part(4, 2)))
        .otherwise(v)
    )


def abs_(c: Column) -> Column:
    return F.abs(F.coalesce(c, F.lit(0)))


def round_(c: Column, scale: int = 0) -> Column:
    """Half to even."""
    return F.bround(F.coalesce(c, F.lit(0)), scale)


def normalize_value(c: Column, trim: bool = True, case_sensitive: bool = False) -> Column:
    v = trim_(c) if trim else text(c)
    return v if case_sensitive else F.lower(v)


def safe_name(c: Column) -> Column:
    r"""A file-safe name: ``: \ / |`` to dashes, ``? * "`` dropped, ``< >`` to brackets, 200 bytes at most."""
    v = F.translate(text(c), ":\\/|<>?*\"", "----()")
    v = F.regexp_replace(F.regexp_replace(v, r"(?U)\s+", " "), "-+", "-")
    v = trim_ws(v)
    cut = F.decode(F.substring(F.encode(v, "UTF-8"), 1, 200), "UTF-8")
    v = F.when(F.octet_length(v) <= 200, v).otherwise(F.regexp_replace(cut, "�+$", ""))
    return F.when(v == "", "unnamed").otherwise(v)


def clean_cell(c: Column) -> Column:
    """Trimmed, each run of white space as one blank."""
    return F.regexp_replace(trim_(c), r"(?U)\s+", " ")


def composite_parts(c: Column) -> Column:
    """Parts at the first separator that occurs, trimmed, blanks dropped; else the trimmed value alone."""
    v = text(c)
    parts = lambda sep: F.filter(F.transform(F.split(v, "\\Q" + sep + "\\E"), trim_ws), lambda x: x != "")
    out = None
    for sep in COMPOSITE_SEPARATORS:
        out = F.when(v.contains(sep), parts(sep)) if out is None else out.when(v.contains(sep), parts(sep))
    return out.otherwise(F.array(trim_ws(v)))


def shape(c: Column) -> Column:
    """Upper case to U, lower case to l, digits to d, others kept."""
    v = F.regexp_replace(text(c), r"\p{IsUppercase}", "U")
    return F.regexp_replace(F.regexp_replace(v, r"\p{IsLowercase}", "l"), "[0-9]", "d")


def count_non_overlapping(haystack: Column, needle: Column) -> Column:
    gone = F.length(haystack) - F.length(F.replace(haystack, needle, F.lit("")))
    return F.when(F.length(needle) > 0, (gone / F.length(needle)).cast("int")).otherwise(0)


def is_integer_text(c: Column) -> Column:
    return c.rlike(r"^[+-]?[0-9]{1,19}$") & c.try_cast("long").isNotNull()


def is_numeric_text(c: Column) -> Column:
    return c.rlike(r"^[+-]?(([0-9]+\.?[0-9]*|\.[0-9]+)([eE][+-]?[0-9]+)?|(?i:inf|infinity|nan))$")


def is_boolean_text(c: Column) -> Column:
    return F.lower(c).isin(*BOOLEAN_TEXTS)


def looks_like_email(c: Column) -> Column:
    return c.contains("@") & c.contains(".")


def looks_like_url(c: Column) -> Column:
    return c.startswith("http://") | c.startswith("https://")


def looks_like_date(c: Column) -> Column:
    return (c.rlike("/.*/") | c.rlike("-.*-")) & c.rlike("[0-9]")


def name_similarity(a: Column, b: Column) -> Column:
    x, y = F.lower(a), F.lower(b)
    most = F.greatest(F.length(x), F.length(y))
    return F.when(x == y, 1.0).otherwise(1 - F.levenshtein(x, y) / most)


def _segments(value: str, words: frozenset[str], longest: int) -> list[str] | None:
    """Words, of ``longest`` characters at most, that cover the whole value; for each end the earliest feasible start is taken."""
    back: list[int | None] = [0] + [None] * len(value)
    for end in range(1, len(value) + 1):
        for start in range(max(0, end - longest), end):
            if back[start] is not None and value[start:end] in words:
                back[end] = start
                break
    if not value or back[-1] is None:
        return None
    out, end = [], len(value)
    while end:
        out.append(value[back[end] : end])
        end = back[end]
    return out[::-1]


def segment(c: Column, vocabulary: list[str]) -> Column:
    """Word break by a vocabulary (its size is the caller's to bound; it is broadcast): an array, or null where no cover exists."""
    words = SparkSession.active().sparkContext.broadcast(frozenset(vocabulary))
    longest = max(map(len, vocabulary), default=0)

    @F.pandas_udf(T.ArrayType(T.StringType()))
    def split(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for batch in batches:
            found = {v: _segments(v, words.value, longest) for v in batch.dropna().unique()}
            yield batch.map(lambda v: found.get(v)).astype(object)

    return split(c)


def derive_table_name(c: Column) -> Column:
    """The ``[Sheet]`` suffix or the file's stem, lower case, other characters as single underscores."""
    v = text(c)
    sheet = F.regexp_extract(v, r"\[([^\]]*)\]\s*$", 1)
    stem = F.regexp_replace(F.regexp_replace(v, r"^.*[/\\]", ""), r"\.[^.]*$", "")
    v = F.regexp_replace(F.lower(F.when(sheet != "", sheet).otherwise(stem)), "[^a-z0-9]+", "_")
    return F.regexp_replace(v, "^_+|_+$", "")


def normalize_risk(c: Column) -> Column:
    v = F.lower(trim_(c))
    return F.when(v.isin("high", "h"), "High").when(v.isin("medium", "med", "m", "moderate"), "Medium").when(v.isin("low", "l"), "Low").otherwise(c)


def normalize_ref(c: Column) -> Column:
    """All digits as ``C-<n>`` without leading zeros; unchanged without digits or past 32 bits."""
    n = F.regexp_replace(text(c), "[^0-9]", "").try_cast("long")
    return F.when(n.isNotNull() & (n < 2**32), F.concat(F.lit("C-"), n.cast("string"))).otherwise(c)
