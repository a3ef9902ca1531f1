"""JSON-Schema subset (V1, V2): validators as small functions over parsed values."""

from __future__ import annotations

import re
from collections.abc import Iterator
from typing import Any, NamedTuple

from pyspark.sql import Column
from pyspark.sql import functions as F

from recordgauge.functions.jsonx import MISSING, loads, over_text


class Fault(NamedTuple):
    path: str
    message: str
    validator: str


def _whole(v: Any) -> bool:
    return isinstance(v, int) and not isinstance(v, bool)


TYPES = {
    "null": lambda v: v is None,
    "object": lambda v: isinstance(v, dict),
    "array": lambda v: isinstance(v, list),
    "string": lambda v: isinstance(v, str),
    "boolean": lambda v: isinstance(v, bool),
    "integer": _whole,
    "number": lambda v: _whole(v) or isinstance(v, float),
}


def has_type(v: Any, name: str | None, unknown: bool) -> bool:
    return TYPES[name](v) if name in TYPES and name != "boolean" else unknown


def nearest(v: Any, branches: list[dict], path: str) -> list[Fault]:
    """The faults of the closest branch: of those of the value's type, fewest faults, then the deepest path."""
    tried = [(b, list(faults(v, b, path))) for b in branches]
    if not all(f for _, f in tried):
        return []
    typed = [f for b, f in tried if has_type(v, b.get("type"), False)] or [f for _, f in tried]
    return min(typed, key=lambda f: (len(f), -max(len(x.path) for x in f)))


def bounds(v: Any, schema: dict, path: str) -> Iterator[Fault]:
    number, text, many = has_type(v, "number", False), isinstance(v, str), isinstance(v, list)
    checks = (
        ("enum", "enum" in schema and v not in schema["enum"], "value is not in enum"),
        ("minimum", number and "minimum" in schema and v < schema["minimum"], "value is below minimum"),
        ("maximum", number and "maximum" in schema and v > schema["maximum"], "value is above maximum"),
        ("pattern", text and "pattern" in schema and not re.fullmatch(schema["pattern"], v), "string does not match pattern"),
        ("minItems", many and len(v) < schema.get("minItems", 0), "array is shorter than minItems"),
        ("maxItems", many and "maxItems" in schema and len(v) > schema["maxItems"], "array is longer than maxItems"),
    )
    yield from (Fault(path, said, name) for name, bad, said in checks if bad)


def faults(v: Any, schema: dict, path: str = "$") -> Iterator[Fault]:
    """In order: anyOf alone; else a wrong type alone; else bounds, items, required, additional and known properties."""
    if "anyOf" in schema:
        yield from nearest(v, schema["anyOf"], path)
        return
    if not has_type(v, schema.get("type"), True):
        # the texts of the messages are fixed values
        yield Fault(path, f"expected {schema['type']}, got {type(v).__name__}", "type")
        return
    yield from bounds(v, schema, path)
    if isinstance(v, list) and isinstance(schema.get("items"), dict):
        for i, x in enumerate(v):
            yield from faults(x, schema["items"], f"{path}[{i}]")
    if isinstance(v, dict):
        known = schema.get("properties", {})
        yield from (Fault(path, f"missing required property {k!r}", "required") for k in schema.get("required", ()) if k not in v)
        if schema.get("additionalProperties") is False:
            yield from (Fault(f"{path}.{k}", "additional property", "additionalProperties") for k in v if k not in known)
        for k in v:
            if k in known:
                yield from faults(v[k], known[k], f"{path}.{k}")


def validate_value(v: Any, schema: dict) -> dict:
    found = list(faults(v, schema)) if isinstance(v, dict) else [Fault("$", "parsed prediction is not an object", None)]
    return {"valid": not found, "error_count": len(found), "errors": [f._asdict() for f in found]}


def messages(v: Any, schema: dict) -> list[str]:
    """V2: one line a fault; a failed anyOf is one line."""
    if "anyOf" in schema:
        return [] if any(not messages(v, b) for b in schema["anyOf"]) else ["$: matches no branch"]
    out: list[str] = []
    for f in faults(v, {k: x for k, x in schema.items() if k not in ("properties", "items")}):
        out.append(f"{f.path}: {f.message}")
    if has_type(v, schema.get("type"), True):
        parts = [(f"[{i}]", x, schema["items"]) for i, x in enumerate(v)] if isinstance(v, list) and "items" in schema else []
        if isinstance(v, dict):
            known = schema.get("properties", {})
            out = [m for m in out if schema.get("additionalProperties") is not False or not m.endswith("additional property")]
            out += [f"$.{k}: additional property" for k in v if schema.get("additionalProperties") is False and k not in known]
            parts = [(f".{k}", v[k], known[k]) for k in v if k in known]
        out += [f"${step}{m[1:]}" for step, x, s in parts for m in messages(x, s)]
    return out


RESULT = "valid boolean, error_count bigint, errors array<struct<path:string,message:string,validator:string>>"


def validate_json(c: Column, schema: dict) -> Column:
    """V1 over JSON text; text that is no JSON is no object."""
    import pandas as pd

    def run(s: pd.Series) -> pd.DataFrame:
        import pandas as pd

        return pd.DataFrame.from_records([validate_value(None if (got := loads(x)) is MISSING else got, schema) for x in s], columns=["valid", "error_count", "errors"])

    run.__annotations__ = {"s": pd.Series, "return": pd.DataFrame}
    return F.pandas_udf(run, RESULT)(c)


def messages_json(c: Column, schema: dict) -> Column:
    """V2 over JSON text, as array<string>."""
    return over_text(lambda v: messages(None if (got := loads(v)) is MISSING else got, schema), "array<string>")(c)


def flat_faults(columns: dict[str, Column], schema: dict) -> Column:
    """V1 for flat records whose properties are columns, without Python: the number of faults."""
    total = F.lit(0)
    for name, c in columns.items():
        s = schema["properties"][name]
        options = s.get("anyOf", [s])
        nullable = any(o.get("type") == "null" for o in options)
        s = next(o for o in options if o.get("type") != "null")
        bad = F.lit(False)
        if "enum" in s:
            bad = bad | ~c.isin(*s["enum"])
        if "minimum" in s:
            bad = bad | (c < s["minimum"])
        if "maximum" in s:
            bad = bad | (c > s["maximum"])
        if "pattern" in s:
            bad = bad | ~c.rlike(rf"\A(?:{s['pattern']})\z")
        total = total + F.when(c.isNull(), F.lit(0 if nullable else 1)).otherwise(bad.cast("int"))
    return total
