"""Dates that keep their precision."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from recordgauge.functions.fields import DATE_FIELDS
from recordgauge.functions.text import bound, strip

TYPE = "struct<precision:string,y:int,m:int,d:int>"


def is_date_field(name: Column) -> Column:
    """D1."""
    return F.element_at(F.split(name, r"\."), -1).isin(*DATE_FIELDS)


def full_year(y: Column) -> Column:
    """Two digits stand for 1969 to 2068."""
    return F.when(y <= 68, y + 2000).otherwise(y + 1900)


#: Month, day and year; month and year; or a year.
PATTERN = r"\A(?:[0-9]{1,2}/[0-9]{1,2}/(?:[0-9]{2}|[0-9]{4})|[0-9]{1,2}/[0-9]{4}|[0-9]{4})\z"


def date_key(c: Column) -> Column:
    """D3: struct(precision, y, m, d), or null if it is no date. Numbers go by their text."""
    none = F.lit(None).cast("int")

    def key(precision: str, y: Column, m: Column, d: Column) -> Column:
        return F.struct(F.lit(precision).alias("precision"), y.cast("int").alias("y"), m.cast("int").alias("m"), d.cast("int").alias("d"))

    def of(a: Column) -> Column:
        # a: the numbers, and whether the year has two digits
        n, p = a["n"], [a["n"][k] for k in range(3)]
        year = F.when(a["short"], full_year(p[2])).otherwise(p[2])
        real = (year >= 1) & F.try_make_timestamp(year, p[0], p[1], F.lit(0), F.lit(0), F.lit(0)).isNotNull()
        return (
            F.when((F.size(n) == 3) & real, key("day", year, p[0], p[1]))
            .when((F.size(n) == 2) & p[0].between(1, 12) & (p[1] >= 1), key("month", p[1], p[0], none))
            .when((F.size(n) == 1) & (p[0] >= 1), key("year", p[0], none, none))
        )

    def parts(s: Column) -> Column:
        numbers = F.transform(F.split(s, "/"), lambda x: x.cast("int"))
        return F.when(s.rlike(PATTERN), bound(F.struct(numbers.alias("n"), s.rlike(r"/[0-9]{2}\z").alias("short")), of))

    return bound(strip(c.cast("string")), parts)


def date_value(text: str) -> tuple | None:
    """D3 of one text: (precision, year, month, day)."""
    import datetime
    import re

    s = text.strip()
    if not re.fullmatch(PATTERN.replace(r"\A", "").replace(r"\z", ""), s):
        return None
    n = [int(x) for x in s.split("/")]
    if len(n) == 3:
        year = n[2] if len(s.rsplit("/", 1)[1]) == 4 else n[2] + (2000 if n[2] <= 68 else 1900)
        try:
            datetime.date(year, n[0], n[1])
        except ValueError:
            return None
        return "day", year, n[0], n[1]
    if len(n) == 2:
        return ("month", n[1], n[0]) if 1 <= n[0] <= 12 and n[1] else None
    return ("year", n[0]) if n[0] else None
