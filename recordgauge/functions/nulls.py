"""Semantic nulls and pruning (N1-N3, N7, N8 on typed columns)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from recordgauge.functions.fields import NULL_ALIASES
from recordgauge.functions.text import strip


def is_null(c: Column, kind: T.DataType | None = None) -> Column:
    """N1. Pass the type for arrays, maps and structs; other values go by their text."""
    if isinstance(kind, (T.ArrayType, T.MapType)):
        return c.isNull() | (F.size(c) == 0)
    if isinstance(kind, T.StructType):
        out = c.isNull()
        return out | F.lit(not kind.fields)
    if isinstance(kind, (T.NumericType, T.BooleanType, T.DateType, T.TimestampType)):
        return c.isNull()
    return c.isNull() | F.lower(strip(c)).isin(*NULL_ALIASES)


def clean_map(m: Column) -> Column:
    """N2 on map<string,string>."""
    return F.map_filter(m, lambda _, v: ~is_null(v))


def prune(c: Column, kind: T.DataType) -> Column:
    """N3 for a known type, bottom-up: null leaves, and containers that become empty, are null."""
    if isinstance(kind, T.ArrayType):
        kept = F.filter(F.transform(c, lambda x: prune(x, kind.elementType)), lambda x: x.isNotNull())
        return F.when(F.size(kept) > 0, kept)
    if isinstance(kind, T.MapType):
        kept = F.map_filter(F.transform_values(c, lambda _, v: prune(v, kind.valueType)), lambda _, v: v.isNotNull())
        return F.when(F.size(kept) > 0, kept)
    if isinstance(kind, T.StructType):
        parts = [prune(c.getField(f.name), f.dataType).alias(f.name) for f in kind.fields]
        some = F.lit(False)
        for p in parts:
            some = some | p.isNotNull()
        return F.when(c.isNotNull() & some, F.struct(*parts))
    return F.when(~is_null(c, kind), c)


def canonical_keys(m: Column) -> Column:
    """N7 on maps: keys stripped, inner white space as one space."""
    return F.transform_keys(m, lambda k, _: F.regexp_replace(strip(k), r"(?U)\s+", " "))


def rename_keys(m: Column, names: dict[str, str]) -> Column:
    """N5 on maps: keys by a literal table; others stay."""
    table = F.create_map(*[F.lit(x) for kv in names.items() for x in kv])
    return F.transform_keys(m, lambda k, _: F.coalesce(F.try_element_at(table, k), k))
