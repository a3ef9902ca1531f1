"""Tolerant equality of scalars: the case-wise (E1, E2) and the feature-wise rule."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from recordgauge.functions import jsonx
from recordgauge.functions.dates import date_key, date_value
from recordgauge.functions.fields import DATE_FIELDS, NULL_ALIASES, TOLERANCE
from recordgauge.functions.text import bound, collapse_ws

#: What a string must look like to be a number: digits may be parted by single underscores.
NUMBER = r"(?i)\A[+-]?(?:(?:[0-9]+(?:_[0-9]+)*\.?(?:[0-9]+(?:_[0-9]+)*)?|\.[0-9]+(?:_[0-9]+)*)(?:e[+-]?[0-9]+(?:_[0-9]+)*)?|inf(?:inity)?|nan)\z"


def number_of(text: Column) -> Column:
    """The double that a string writes, or null; no suffixes like '1d'."""
    return F.when(text.rlike(NUMBER), F.replace(text, F.lit("_"), F.lit("")).try_cast("double"))


def normalised(c: Column, field: str | None = None, digits: int | None = None) -> Column:
    """E1 (digits None) or E3 (digits 3): struct(num, txt, date); null for a semantic null.

    Values come as text (or as numbers, which are cast)."""
    dated = field is not None and field.rsplit(".", 1)[-1] in DATE_FIELDS
    none = F.lit(None).cast("struct<precision:string,y:int,m:int,d:int>")

    def of(s: Column) -> Column:
        def typed(x: Column) -> Column:
            plain = x["date"].isNull()
            return F.struct(F.when(plain, x["num"]).alias("num"), F.when(plain & x["num"].isNull(), s).alias("txt"), x["date"].alias("date"))

        num = number_of(s)
        num = num if digits is None else F.bround(num, digits)
        return F.when(~s.isin(*NULL_ALIASES), bound(F.struct(num.alias("num"), (date_key(s) if dated else none).alias("date")), typed))

    return bound(F.lower(collapse_ws(c.cast("string"))), of)


def normal_equal(x: Column, y: Column, tolerance: float = TOLERANCE) -> Column:
    """E2, E4 of two normalised values that are there."""
    near = F.abs(x["num"] - y["num"]) <= tolerance
    both = x["num"].isNotNull() & y["num"].isNotNull()
    text = x["num"].isNull() & y["num"].isNull() & x["txt"].eqNullSafe(y["txt"]) & x["date"].eqNullSafe(y["date"])
    return F.when(both, ~F.isnan(x["num"]) & ~F.isnan(y["num"]) & near).otherwise(text)


def values_equal(a: Column, b: Column, field: str | None = None, digits: int | None = None, tolerance: float = TOLERANCE) -> Column:
    """E2 (digits None) or E4 (digits 3). NaN equals nothing."""

    def same(p: Column) -> Column:
        x, y = p["x"], p["y"]
        return F.when(x.isNull() & y.isNull(), True).when(x.isNull() | y.isNull(), False).otherwise(normal_equal(x, y, tolerance))

    full = bound(F.struct(normalised(a, field, digits).alias("x"), normalised(b, field, digits).alias("y")), same)
    # one text twice is equal without further work, but for what may read as NaN or infinite
    odd = F.coalesce(a.cast("string").rlike("(?i)nan|inf"), F.lit(False))
    return F.when(a.cast("string").eqNullSafe(b.cast("string")) & ~odd, True).otherwise(full)


def plain_equal(a, b, field: str | None = None, tolerance: float = TOLERANCE) -> bool:
    """E2 of two parsed values, for code that runs outside of expressions."""

    def normal(v):
        if jsonx.is_null_value(v):
            return None
        s = " ".join(str(v).split()).lower()
        if field is not None and field.rsplit(".", 1)[-1] in DATE_FIELDS and (key := date_value(s)):
            return key
        n = jsonx.number_value(s)
        return s if n is None else n

    x, y = normal(a), normal(b)
    if isinstance(x, float) and isinstance(y, float):
        return abs(x - y) <= tolerance
    return x == y


def numbers_equal(a: Column, b: Column, tolerance: float = TOLERANCE) -> Column:
    """The same rule where both sides are numbers already: stays in generated code."""
    return F.when(a.isNull() & b.isNull(), True).when(a.isNull() | b.isNull(), False).otherwise(F.abs(a - b) <= tolerance)
