"""Scalar column functions. Missing values (null, NaN, text that is no number) are null throughout."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def number(c: Column | str) -> Column:
    """A double; null for null, NaN and what is no number. Comparisons with it never see a NaN, which Spark holds to be the largest."""
    c = F.col(c) if isinstance(c, str) else c
    return F.nanvl(c.try_cast("double"), F.lit(None).cast("double"))


def flag(c: Column | str) -> Column:
    """A boolean that is false where missing."""
    c = F.col(c) if isinstance(c, str) else c
    return F.coalesce(c.try_cast("boolean"), F.lit(False))


def clean_text(c: Column | str) -> Column:
    """A string that is empty where missing."""
    c = F.col(c) if isinstance(c, str) else c
    return F.coalesce(c.cast("string"), F.lit(""))


def hex_halves(c: Column | str) -> tuple[Column, Column]:
    """The two 32-bit halves of a 16-digit hex string as longs (64 bits would overflow); null where it is not one."""
    c = F.col(c) if isinstance(c, str) else c
    ok = c.rlike("^[0-9a-fA-F]{16}$")
    half = lambda start: F.when(ok, F.conv(F.substring(c, start, 8), 16, 10).cast("long"))
    return half(1), half(9)


def hamming(a: tuple[Column, Column], b: tuple[Column, Column]) -> Column:
    """Differing bits of two pairs of halves."""
    return F.bit_count(a[0].bitwiseXOR(b[0])) + F.bit_count(a[1].bitwiseXOR(b[1]))


def dot(a: Column | str, b: Column | str) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def vector_norm(a: Column | str) -> Column:
    return F.sqrt(dot(a, a))


def sorted_unique(a: Column | str) -> Column:
    return F.array_sort(F.array_distinct(a))


def tag_problems(tags: Column | str) -> Column:
    """The tags that are no path `a/b/c` of non-empty parts; an empty array where all are fine."""
    bad = lambda t: t.isNull() | F.exists(F.split(t, "/"), lambda p: p == "")
    return F.filter(tags, bad)


def orientation_of(width: Column | str, height: Column | str) -> Column:
    w, h = number(width), number(height)
    return F.when(w > h, "landscape").when(w < h, "portrait").when(w == h, "square")
