"""Scores over streams: an extension, the reference has none.

Extraction, validation and pair scores are projections and run on streams unchanged; feature
sums are additive and run as streaming aggregates, whole or by window with a watermark.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from recordgauge.operators.scoring import feature_scores, ratios


def running_scores(events: DataFrame, ts: str, late: str = "10 minutes") -> DataFrame:
    """Feature scores so far (complete or update mode)."""
    return feature_scores(events.withWatermark(ts, late))


def windowed_scores(events: DataFrame, ts: str, size: str = "1 hour", late: str = "10 minutes") -> DataFrame:
    """Feature scores by window of event time; append mode emits a window once it is closed."""
    by = events.withWatermark(ts, late).groupBy(F.window(ts, size), "feature")
    sums = by.agg(*[F.sum(c).alias(c) for c in ("gold_appearances", "TP", "FP", "FN")])
    r = ratios(F.col("TP"), F.col("FP"), F.col("FN"))
    return sums.select("*", *[r[k].alias(k) for k in ("precision", "recall", "f1")])
