"""Typed slots and the dense template contract."""

from __future__ import annotations

import json
import re
from functools import lru_cache
from typing import Any

from pyspark.sql import Column
from pyspark.sql import functions as F

from recordgauge.functions import fields as fd
from recordgauge.functions.jsonx import MISSING, loads

COUNT = r"(0|[1-9]|[1-4][0-9])"
INTEGER = r"(0|[1-9][0-9]{0,7})"
DECIMAL = r"(0|[1-9][0-9]{0,7})(\.[0-9]{1,4})?"
MONTH, DAY, YEAR = r"(0?[1-9]|1[0-2])", r"(0?[1-9]|[12][0-9]|3[01])", r"([0-9]{4}|[0-9]{2})"
DATE = rf"{MONTH}/{DAY}/{YEAR}"
MONTH_YEAR = rf"{MONTH}/[0-9]{{4}}"
MARK = re.compile(r"<\|[a-z0-9_]+\|>")
#: Alternations of the prefixes of a complete word: what may still become one.
_PREFIX = {
    "count": r"(0|[1-4]?[0-9]?)?",
    "integer": rf"({INTEGER})?",
    "decimal": r"((0|[1-9][0-9]{0,7})(\.[0-9]{0,4})?)?",
    "date": r"(0|1|0?[1-9]|1[0-2])?|(0?[1-9]|1[0-2])/([0-3]|0?[1-9]|[12][0-9]|3[01])?|(0?[1-9]|1[0-2])/(0?[1-9]|[12][0-9]|3[01])/[0-9]{0,4}",
    "month": r"(0?[1-9]|1[0-2])/[0-9]{0,4}",
}


def slot_kind(marker: str) -> str:
    """'count', 'integer', 'decimal', 'date', 'month_date' (which also takes month/year) or 'category'."""
    field = fd.KEY_OF_MARKER[marker]
    if marker == "num_nodule":
        return "count"
    kind = fd.kind_of(field)
    return {"integer": "integer", "float": "decimal", "text": "category"}.get(kind) or ("month_date" if marker == "follow_up_date" else "date")


def grammar(marker: str) -> str:
    """Regular expression of a slot's complete words."""
    kind = slot_kind(marker)
    if kind == "count":
        return COUNT
    body = {"integer": INTEGER, "decimal": DECIMAL, "date": DATE, "month_date": f"{DATE}|{MONTH_YEAR}"}.get(kind) or "|".join(map(re.escape, fd.CATEGORIES[marker]))
    return f"{body}|null"


def word_status(marker: str, text: str) -> tuple[bool, bool]:
    """V4-V7: whether `text` can still become a word of the slot, and whether it is one."""
    kind = slot_kind(marker)
    whole = re.fullmatch(grammar(marker), text) is not None
    if kind == "category":
        return any(c.startswith(text) for c in (*fd.CATEGORIES[marker], "null")), whole
    forms = {"month_date": [_PREFIX["date"], _PREFIX["month"]]}.get(kind) or [_PREFIX[kind]]
    viable = whole or any(re.fullmatch(f, text) for f in forms) or (kind != "count" and "null".startswith(text))
    return viable, whole


@lru_cache(maxsize=100_000)
def is_word(marker: str, word: str) -> bool:
    """Whether `word` is a complete word of the slot; words repeat from record to record."""
    return re.fullmatch(grammar(marker), word) is not None


def slot_complete(marker: str, c: Column) -> Column:
    """V7: whether a text column holds a complete word of the slot."""
    kind = slot_kind(marker)
    if kind == "category":
        return c.isin(*fd.CATEGORIES[marker], "null")
    return c.rlike(rf"\A(?:{grammar(marker)})\z")


def dense_template(n: int, legacy: bool = False) -> dict:
    """The ordered template of n findings; the list is left out at 0."""
    if not 0 <= n:
        raise ValueError("a template needs a count of 0 or more")
    name = (lambda m: m) if legacy else fd.KEY_OF_MARKER.__getitem__
    marks = list(fd.KEY_OF_MARKER)
    out: dict[str, Any] = {name(marks[0]): f"<|{marks[0]}|>"}
    if n:
        out["nodules" if legacy else fd.LIST_FIELD] = [{name(m): f"<|{m}|>" for m in marks[1:26]} for _ in range(n)]
    return out | {name(m): f"<|{m}|>" for m in marks[26:]}


def template_text(n: int, tags: bool = False, indent: int | None = None, legacy: bool = False) -> str:
    """C3."""
    body = json.dumps(dense_template(n, legacy), indent=indent, ensure_ascii=False)
    return f"<json>\n{body}\n</json>" if tags else body


def dense_faults(v: Any, legacy: bool = False, raw: str | None = None) -> list[str]:
    """V3: how a value departs from the dense template contract."""
    text = raw if raw is not None else json.dumps(v, ensure_ascii=False)
    out = ["template marker left"] if MARK.search(text) else []
    if not isinstance(v, dict):
        return [*out, "not an object"]
    marks = {m if legacy else k: m for m, k in fd.KEY_OF_MARKER.items()}
    items_key, count_key = ("nodules", "num_nodule") if legacy else (fd.LIST_FIELD, fd.COUNT_FIELD)

    def field(path: str, name: str, x: Any) -> None:
        word = "null" if x is None else str(x).strip() if not isinstance(x, bool) else "?"
        m = marks[name]
        good = is_word(m, word) or slot_kind(m) == "decimal" and isinstance(x, float) and re.fullmatch(DECIMAL, f"{x:g}")
        if not good:
            out.append(f"{path}: not a word of its slot")

    def fields(path: str, x: dict, known: list[str]) -> None:
        for k in known:
            if k in x:
                field(f"{path}.{k}", k, x[k])

    marks_in_order = list(fd.KEY_OF_MARKER)
    name = (lambda m: m) if legacy else fd.KEY_OF_MARKER.__getitem__
    top = [name(marks_in_order[0]), *(name(m) for m in marks_in_order[26:])]
    inner = [name(m) for m in marks_in_order[1:26]]
    fields("$", v, top)
    count, items = v.get(count_key), v.get(items_key)
    n = int(count) if re.fullmatch(COUNT, str(count)) and not isinstance(count, bool) else None
    if n is not None:
        if n == 0 and items_key in v:
            out.append("list present at count 0")
        if n and (not isinstance(items, list) or len(items) != n):
            out.append("list length differs from count")
    wanted = [top[0], *([items_key] if n or (n is None and items_key in v) else []), *top[1:]]
    if list(v) != wanted:
        out.append("$: key order")
    for i, x in enumerate(items if isinstance(items, list) else []):
        if not isinstance(x, dict):
            out.append(f"$.{items_key}[{i}]: not an object")
            continue
        fields(f"$.{items_key}[{i}]", x, inner)
        if list(x) != inner:
            out.append(f"$.{items_key}[{i}]: key order")
    return out


def dense_faults_json(c: Column, legacy: bool = False) -> Column:
    """V3 over JSON text, as array<string>."""
    import pandas as pd

    def run(s: pd.Series) -> pd.Series:
        import pandas as pd

        return pd.Series([dense_faults(None if (got := loads(x)) is MISSING else got, legacy, x or "") for x in s], dtype=object)

    run.__annotations__ = {"s": pd.Series, "return": pd.Series}
    return F.pandas_udf(run, "array<string>")(c)


def template_audit(template: dict, schema: dict) -> dict:
    """V8: differences between a template's candidates and the raw schema, by field; empty lists where they agree."""
    out = {"top_level_order": list(template) == list(fd.TOP_LEVEL_KEYS), "one_item": isinstance(template.get(fd.LIST_FIELD), list) and len(template[fd.LIST_FIELD]) == 1}
    inner = schema["properties"][fd.LIST_FIELD]["anyOf"][0]["items"]["properties"]
    differ = {}
    for marker, values in fd.CATEGORIES.items():
        key = fd.KEY_OF_MARKER[marker]
        leaf = (inner if key in inner else schema["properties"])[key]["anyOf"][0]
        enum = leaf.get("enum", [])
        differ[key] = {"only_template": sorted(set(values) - set(enum)), "only_schema": sorted(set(enum) - set(values))}
    return out | {"differences": {k: d for k, d in differ.items() if d["only_template"] or d["only_schema"]}}
