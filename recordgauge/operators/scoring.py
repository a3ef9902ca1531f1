"""Scores of records: partial credit by case (A1-A3), exact by feature."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from recordgauge.functions.text import safe_div


def partial_credit(gold: Column, pred: Column, equal: Column) -> dict[str, Column]:
    """A1 of one field: TP 2 if equal; TP 1, FP and FN 0.5 if different; FN 2 if missing; FP 2 if extra."""
    both, only_gold, only_pred = gold & pred, gold & ~pred, pred & ~gold
    half = F.when(both & ~equal, 0.5).otherwise(0.0)
    return {
        "tp": F.when(both, F.when(equal, 2.0).otherwise(1.0)).otherwise(0.0),
        "fp": half + F.when(only_pred, 2.0).otherwise(0.0),
        "fn": half + F.when(only_gold, 2.0).otherwise(0.0),
    }


def exact(gold: Column, pred: Column, equal: Column) -> dict[str, Column]:
    """A4 of one field: support, and TP, FP, FN of 0 or 1."""
    both = gold & pred
    return {
        "gold_appearances": gold.cast("long"),
        "TP": (both & equal).cast("long"),
        "FP": (pred & ~(both & equal)).cast("long"),
        "FN": (gold & ~(both & equal)).cast("long"),
    }


def total(parts: list[dict[str, Column]]) -> dict[str, Column]:
    """Sums of the fields' scores in one row."""
    out = dict(parts[0])
    for p in parts[1:]:
        out = {k: out[k] + p[k] for k in out}
    return out


def ratios(tp: Column, fp: Column, fn: Column, empty: float | None = 0.0) -> dict[str, Column]:
    """P, R, F1 and IoU; `empty` where all three are 0: 1 case-wise, 0 feature-wise, None in bootstraps."""
    none = (tp + fp + fn) == 0
    p, r = safe_div(tp, tp + fp), safe_div(tp, tp + fn)
    raw = {"precision": p, "recall": r, "f1": safe_div(2 * p * r, p + r), "iou": safe_div(tp, tp + fp + fn)}
    return {k: F.when(none, F.lit(empty).cast("double")).otherwise(v) for k, v in raw.items()}


def case_scores(pairs: DataFrame, group: list[str]) -> DataFrame:
    """A2: from (group, tp, fp, fn) of matches and remainders to a row per case with its ratios."""
    sums = pairs.groupBy(*group).agg(*[F.sum(c).alias(c) for c in ("tp", "fp", "fn")])
    return sums.select("*", *[v.alias(k) for k, v in ratios(F.col("tp"), F.col("fp"), F.col("fn"), 1.0).items()])


def micro(cases: DataFrame) -> DataFrame:
    """A3: one row over all cases."""
    sums = cases.agg(*[F.coalesce(F.sum(c), F.lit(0.0)).alias(c) for c in ("tp", "fp", "fn")])
    return sums.select("*", *[v.alias(k) for k, v in ratios(F.col("tp"), F.col("fp"), F.col("fn"), 0.0).items()])


def feature_events(pairs: DataFrame, fields: list[tuple[str, Column, Column, Column]], keep: list[str]) -> DataFrame:
    """From a row a pair to (keep, feature, gold_appearances, TP, FP, FN), summed by keep and feature.

    fields: (feature, gold present, predicted present, equal). The sums are taken on the
    wide rows, then turned long: the shuffle carries a row a group, not one a field."""
    wide = [v.alias(f"{k}__{i}") for i, (_, g, p, e) in enumerate(fields) for k, v in exact(g, p, e).items()]
    sums = pairs.select(*keep, *wide)
    names = ("gold_appearances", "TP", "FP", "FN")
    agg = [F.sum(f"{k}__{i}").alias(f"{k}__{i}") for i in range(len(fields)) for k in names]
    sums = sums.groupBy(*keep).agg(*agg) if keep else sums.agg(*agg)
    rows = F.array(*[F.struct(F.lit(f).alias("feature"), *[F.coalesce(F.col(f"{k}__{i}"), F.lit(0)).alias(k) for k in names]) for i, (f, *_) in enumerate(fields)])
    return sums.select(*keep, F.explode(rows).alias("x")).select(*keep, "x.*")


def feature_scores(events: DataFrame, features: DataFrame | None = None) -> DataFrame:
    """Sums and ratios by feature; every feature of the dimension appears, also without events."""
    sums = events.groupBy("feature").agg(*[F.sum(c).alias(c) for c in ("gold_appearances", "TP", "FP", "FN")])
    if features is not None:
        sums = features.select("feature").distinct().join(sums, "feature", "left").fillna(0, ["gold_appearances", "TP", "FP", "FN"])
    r = ratios(F.col("TP"), F.col("FP"), F.col("FN"), 0.0)
    return sums.select("*", *[r[k].alias(k) for k in ("precision", "recall", "f1")])
