"""A case's two records scored in one step: findings, keys, assignment and marks of one row.

Both records of a case stand in one row, so that no row has to meet another: what `matching`
does relationally for records of separate tables is done here within the row, by the same
rules as `equality.normalised`, `equality.normal_equal` and `matching.align`. Values repeat
from case to case; their normal forms are kept in a bounded table a process."""

from __future__ import annotations

import json
import re
from collections import defaultdict
from decimal import ROUND_HALF_EVEN, Context, Decimal
from functools import lru_cache
from typing import Any

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from recordgauge.functions import fields as fd
from recordgauge.functions import jsonx
from recordgauge.functions.dates import date_value
from recordgauge.operators.matching import assign

#: Scored features: report fields, then those of a finding.
FEATURES = (*fd.REPORT_FIELDS, *(f"{fd.LIST_FIELD}.{f}" for f in fd.FINDING_FIELDS))
_SPACE = re.compile("[\t\n\x0b\x0c\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]+")
_NUMBER = re.compile(r"[+-]?(?:(?:[0-9]+(?:_[0-9]+)*\.?(?:[0-9]+(?:_[0-9]+)*)?|\.[0-9]+(?:_[0-9]+)*)(?:e[+-]?[0-9]+(?:_[0-9]+)*)?|inf(?:inity)?)|nan")
_WIDE = Context(prec=400, rounding=ROUND_HALF_EVEN)


@lru_cache(maxsize=100_000)
def normal(text: str, dated: bool, digits: int | None) -> tuple | None:
    """(number, text, date) of a value's text, one of them given; None for a semantic null."""
    s = _SPACE.sub(" ", text).strip(" ").lower()
    if s in fd.NULL_ALIASES:
        return None
    if dated and (day := date_value(s)):
        return None, None, day
    if not _NUMBER.fullmatch(s):
        return None, s, None
    x = float(s.replace("_", ""))
    if digits is not None and abs(x) < float("inf"):
        x = float(Decimal(repr(x)).quantize(Decimal(1).scaleb(-digits), context=_WIDE)) + 0.0  # no zero keeps a sign
    return x, None, None


def equal(x: tuple, y: tuple) -> bool:
    """E2, E4 of two normal values that are there; NaN equals nothing."""
    if x[0] is not None and y[0] is not None:
        return abs(x[0] - y[0]) <= fd.TOLERANCE
    return x[0] is None and y[0] is None and x == y


def text_of(v: Any) -> str | None:
    """A JSON value as the text that stands in the record."""
    return v if v is None or isinstance(v, str) else None if isinstance(v, float) and v - v != 0 else jsonx.dumps(v)


def values(x: dict, names: tuple[str, ...], digits: int | None) -> dict[str, tuple]:
    """The normal values of an object's fields, in the order of `names`, without semantic nulls."""
    found = ((f, normal(t, f in fd.DATE_FIELDS, digits)) for f in names if f in x and (t := text_of(x[f])) is not None)
    return {f: v for f, v in found if v is not None}


def parsed(text: Any) -> Any:
    got = jsonx.loads(text) if isinstance(text, str) else None
    return None if got is jsonx.MISSING else got


def similarity(g: dict[str, tuple], p: dict[str, tuple], weights: dict[str, float]) -> float:
    """The share of the weight of the gold's fields on which both agree."""
    total = same = 0.0
    for f in _ORDER:
        if f in g and (w := weights.get(f, 0.0)):
            total += w
            if f in p and equal(g[f], p[f]):
                same += w
    return same / total if total else 0.0


#: Fields without a date first: the order in which weights are added.
_ORDER = (*[f for f in fd.FINDING_FIELDS if f not in fd.DATE_FIELDS], *[f for f in fd.FINDING_FIELDS if f in fd.DATE_FIELDS])


def pairs(gold: list[dict], pred: list[dict], key: tuple[str, ...], weights: dict[str, float], complete: bool) -> list[tuple[int, int]]:
    """X1 or X2, then X5: (gold position, predicted position), equal keys in order first, then the best assignment of the rest."""

    def key_of(x: dict[str, tuple]) -> tuple | None:
        parts = tuple(None if v is None or v[2] else repr(v[0]) if v[0] is not None else v[1] for v in (x.get(f) for f in key))
        there = [p is not None for p in parts]
        return parts if (all(there) if complete else any(there)) else None

    waiting = defaultdict(list)
    for j, p in enumerate(pred):
        if (k := key_of(p)) is not None:
            waiting[k].append(j)
    out = []
    for i, g in enumerate(gold):
        if (k := key_of(g)) is not None and waiting.get(k):
            out.append((i, waiting[k].pop(0)))
    golds, preds = {i for i, _ in out}, {j for _, j in out}
    left, rest = [i for i in range(len(gold)) if i not in golds], [j for j in range(len(pred)) if j not in preds]
    if left and rest:
        s = np.array([[similarity(gold[i], pred[j], weights) for j in rest] for i in left])
        best = [(0, int(s[0].argmax()))] if len(left) == 1 else [(int(s[:, 0].argmax()), 0)] if len(rest) == 1 else assign(-s)
        out += [(left[a], rest[b]) for a, b in best if s[a, b] >= fd.MIN_SIMILARITY]
    return out


def aligned(gold: Any, pred: Any, digits: int | None, key: tuple[str, ...], weights: dict[str, float], complete: bool) -> list[tuple[dict, dict]]:
    """Values of matched findings side by side, then those of one side alone beside nothing."""
    g = [values(x, fd.FINDING_FIELDS, digits) for x in jsonx.findings(gold)]
    p = [values(x, fd.FINDING_FIELDS, digits) for x in jsonx.findings(pred)]
    found = pairs(g, p, key, weights, complete)
    golds, preds = {i for i, _ in found}, {j for _, j in found}
    return [*((g[i], p[j]) for i, j in found), *((x, {}) for i, x in enumerate(g) if i not in golds), *(({}, x) for j, x in enumerate(p) if j not in preds)]


def case_score(gold: str | None, pred: str | None) -> tuple[float, float, float]:
    """A1: partial credit of a case's findings: (tp, fp, fn)."""
    same = other = missing = extra = 0
    for g, p in aligned(parsed(gold), parsed(pred), None, fd.RECORD_KEY[:2], fd.WEIGHTS, True):
        both = g.keys() & p.keys()
        right = sum(equal(g[f], p[f]) for f in both)
        same, other, missing, extra = same + right, other + len(both) - right, missing + len(g) - len(both), extra + len(p) - len(both)
    return 2.0 * same + other, 0.5 * other + 2.0 * extra, 0.5 * other + 2.0 * missing


_EVEN = dict.fromkeys(fd.SIMILARITY_FIELDS, 1.0)
_PLACE = {f: k for k, f in enumerate(FEATURES)}
_REPORT_PLACE, _FINDING_PLACE = {f: _PLACE[f] for f in fd.REPORT_FIELDS}, {f: _PLACE[f"{fd.LIST_FIELD}.{f}"] for f in fd.FINDING_FIELDS}
COUNTS = ("gold_appearances", "TP", "FP", "FN")


def case_features(gold: str | None, pred: str | None) -> tuple[np.ndarray, bool]:
    """(features x COUNTS) of a case, and whether either record has a finding."""
    out = np.zeros((len(FEATURES), len(COUNTS)), dtype=np.int64)
    g, p = parsed(gold), parsed(pred)

    def add(x: dict[str, tuple], y: dict[str, tuple], place: dict[str, int]) -> None:
        for f in x.keys() | y.keys():
            row, right = out[place[f]], f in x and f in y and equal(x[f], y[f])
            row[0] += f in x
            row[1] += right
            row[2] += f in y and not right
            row[3] += f in x and not right

    top = [values(x if isinstance(x, dict) else {}, fd.REPORT_FIELDS, 3) for x in (g, p)]
    add(*top, _REPORT_PLACE)
    inner = aligned(g, p, 3, fd.RECORD_KEY[:3], _EVEN, False)
    for x, y in inner:
        add(x, y, _FINDING_PLACE)
    return out, bool(inner)


def scores(gold: str, pred: str) -> Column:
    """A1 over columns of record texts: struct(tp, fp, fn)."""
    import pandas as pd

    def run(g: pd.Series, p: pd.Series) -> pd.DataFrame:
        import pandas as pd

        return pd.DataFrame([case_score(x, y) for x, y in zip(g, p, strict=True)], columns=["tp", "fp", "fn"])

    run.__annotations__ = {"g": pd.Series, "p": pd.Series, "return": pd.DataFrame}
    return F.pandas_udf(run, "tp double, fp double, fn double")(gold, pred)


def feature_vectors(gold: str, pred: str) -> Column:
    """A5, A7 over columns of record texts: the case's counts as one array, features x COUNTS."""
    import pandas as pd

    def run(g: pd.Series, p: pd.Series) -> pd.Series:
        import pandas as pd

        return pd.Series([case_features(x, y)[0].ravel().tolist() for x, y in zip(g, p, strict=True)], dtype=object)

    run.__annotations__ = {"g": pd.Series, "p": pd.Series, "return": pd.Series}
    return F.pandas_udf(run, "array<bigint>")(gold, pred)


def feature_sums(cases: DataFrame) -> DataFrame:
    """(feature, COUNTS) summed over the cases of each task."""

    def run(batches):
        import pyarrow as pa

        total = np.zeros((len(FEATURES), len(COUNTS)), dtype=np.int64)
        for b in batches:
            for g, p in zip(b.column("gold").to_pylist(), b.column("prediction").to_pylist(), strict=True):
                total += case_features(g, p)[0]
        yield pa.RecordBatch.from_arrays([pa.array(FEATURES, pa.string()), *[pa.array(total[:, k]) for k in range(len(COUNTS))]], names=["feature", *COUNTS])

    return cases.select("gold", "prediction").mapInArrow(run, "feature string, " + ", ".join(f"{c} bigint" for c in COUNTS))
