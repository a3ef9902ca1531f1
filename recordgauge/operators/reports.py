"""Pivots, orders, rescoring and report texts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from recordgauge.functions.text import change_text, interval_text, rounded_text, short_feature, signed

REGIMES = ("sparse", "dense", "constrained")


def wide_by(df: DataFrame, row: str, column: Column | str, value: str, names: list[str]) -> DataFrame:
    """One column for each of `names`; rows by their mean, greatest first, then name.

    `names` are given, so that the pivot needs no pass to find them."""
    c = F.col(column) if isinstance(column, str) else column
    mean = F.avg(F.when(c.isin(*names), F.col(value)))
    out = df.groupBy(row).agg(*[F.max(F.when(c == n, F.col(value))).alias(n) for n in names], mean.alias("mean"))
    return out.orderBy(F.desc_nulls_last("mean"), row)


def long_by(df: DataFrame, ids: list[str], values: list[str]) -> DataFrame:
    """P3."""
    return df.unpivot(ids, values, "metric", "value")


def ordered(df: DataFrame, by: str, name: str = "feature", largest: bool = True) -> DataFrame:
    """O1, O4, O6."""
    return df.orderBy(F.desc_nulls_last(by) if largest else F.asc_nulls_last(by), F.asc(name))


def top_changes(df: DataFrame, k: int = 10, c: str = "delta", name: str = "feature", which: str = "improved") -> DataFrame:
    """O2 ('improved' or 'worsened'), O3 ('absolute'): k rows, ties by name."""
    if which == "absolute":
        return df.orderBy(F.desc(F.abs(c)), name).limit(k)
    kept = df.filter(F.col(c) > 0) if which == "improved" else df.filter(F.col(c) < 0)
    return kept.orderBy(F.desc(c) if which == "improved" else F.asc(c), name).limit(k)


def distinct_in_order(values: Column) -> Column:
    """The first of each value of an array, in order."""
    return F.array_distinct(values)


def by_category(df: DataFrame, c: str, order: tuple[str, ...]) -> DataFrame:
    """In a stated order of categories; unknown ones last."""
    table = F.create_map(*[x for k, v in enumerate(order) for x in (F.lit(v), F.lit(k))])
    return df.orderBy(F.coalesce(F.try_element_at(table, F.col(c)), F.lit(len(order))), c)


def evidence(df: DataFrame, by: list[str], order: str, value: str, k: int = 20) -> DataFrame:
    """The first k values of each group; others are counted, not gathered."""
    from pyspark.sql import Window

    n = df.groupBy(*by).agg(F.count("*").alias("n"))
    # ranks above k go before the shuffle, group by group
    top = df.withColumn("__rn", F.row_number().over(Window.partitionBy(*by).orderBy(order, value))).filter(F.col("__rn") <= k)
    first = top.groupBy(*[F.col(b).alias(f"__{b}") for b in by]).agg(F.transform(F.sort_array(F.collect_list(F.struct("__rn", value))), lambda x: x[value]).alias("first"))
    return n.join(first, [n[b].eqNullSafe(first[f"__{b}"]) for b in by]).select(*by, "n", "first")


def effects(df: DataFrame, by: list[str], regime: str, value: str) -> DataFrame:
    """Values by regime and the prompt, constraint and end-to-end effects."""
    wide = df.groupBy(*by).agg(*[F.max(F.when(F.col(regime) == r, F.col(value))).alias(r) for r in REGIMES])
    return wide.select("*", (F.col("dense") - F.col("sparse")).alias("prompt_effect"), (F.col("constrained") - F.col("dense")).alias("constraint_effect"), (F.col("constrained") - F.col("sparse")).alias("end_to_end_effect"))


def rescore(cases: DataFrame, rebuilt: Column, metrics: Column, prediction: str, old_metrics: str) -> DataFrame:
    """Predictions and metrics built anew beside the saved ones, which stay."""
    new = cases.withColumns({"__prediction": rebuilt}).withColumn("__metrics", metrics)
    return new.withColumns({"prediction_changed": ~F.col("__prediction").eqNullSafe(F.col(prediction)), "metrics_changed": ~F.col("__metrics").eqNullSafe(F.col(old_metrics))})


def rescore_summary(rescored: DataFrame, **policies: str) -> DataFrame:
    """Counts of changes, with policy names as columns."""
    out = rescored.agg(F.count("*").alias("cases"), F.count_if("prediction_changed").alias("changed_predictions"), F.count_if("metrics_changed").alias("changed_metrics"))
    return out.withColumns({k: F.lit(v) for k, v in policies.items()})


def preferred_columns(df: DataFrame, first: list[str]) -> DataFrame:
    """The preferred columns that exist, then those whose name holds 'token', then the rest."""
    head = [c for c in first if c in df.columns]
    tokens = [c for c in df.columns if "token" in c.lower() and c not in head]
    return df.select(*head, *tokens, *[c for c in df.columns if c not in head and c not in tokens])


def flatten_columns(df: DataFrame) -> DataFrame:
    """Nested structs to dotted columns; arrays and maps stay."""
    from pyspark.sql import types as T

    def walk(kind: T.StructType, path: list[str]):
        for f in kind.fields:
            here = [*path, f.name]
            if isinstance(f.dataType, T.StructType):
                yield from walk(f.dataType, here)
            else:
                yield F.col(".".join(f"`{p}`" for p in here)).alias(".".join(here))

    return df.select(*walk(df.schema, []))


def markdown(df: DataFrame, limit: int = 1000) -> str:
    """K7: a small result as a table; more than `limit` rows are refused."""
    rows = df.limit(limit + 1).collect()
    if len(rows) > limit:
        raise ValueError(f"more than {limit} rows")
    line = lambda cells: "| " + " | ".join(cells) + " |"
    return "\n".join([line(df.columns), line(["---"] * len(df.columns)), *(line(["" if v is None else str(v) for v in r]) for r in rows)])


def escaped(c: Column) -> Column:
    """Text for a table row: percent signs and underscores escaped."""
    return F.replace(F.replace(c, F.lit("%"), F.lit(r"\%")), F.lit("_"), F.lit(r"\_"))


def row_of(*cells: Column) -> Column:
    return F.concat(F.concat_ws(" & ", *cells), F.lit(r" \\"))


def cell_ci(prefix: str) -> Column:
    return interval_text(*[F.col(f"{prefix}_{k}") for k in ("f1", "low", "high")])


def cell_change(prefix: str) -> Column:
    return change_text(*[F.col(f"{prefix}_{k}") for k in ("delta", "low", "high")])


def table_fragments(models: DataFrame) -> DataFrame:
    """K8: (model, adaptation, constraint, grammar): rows of the three main tables, one model a row.

    Columns of `models`: model, label, and by prefix f1, low, high of base, dense, dynamic, sft
    and grammar, delta, low, high of sft_delta, constraint_delta and grammar_delta, and
    base_tokens, sft_tokens, sparse_validity, dense_validity, valid_count, n."""
    share = lambda c: F.concat(rounded_text(c, 1), F.lit(r"\%"))
    saved = share(100 * (1 - F.col("sft_tokens") / F.col("base_tokens")))
    tokens = [rounded_text(F.col(c), 0, "%,.{}f") for c in ("base_tokens", "sft_tokens")]
    of = lambda c: F.concat(F.col(c).cast("string"), F.lit("/"), F.col("n").cast("string"))
    return models.select(
        "model",
        row_of(F.col("label"), cell_ci("base"), cell_ci("sft"), cell_change("sft_delta"), *tokens, saved).alias("adaptation"),
        row_of(F.col("label"), cell_ci("base"), cell_ci("dense"), cell_ci("dynamic"), cell_change("constraint_delta")).alias("constraint"),
        row_of(F.col("label"), share(F.col("sparse_validity")), share(F.col("dense_validity")), F.lit(r"100.0\%"), of("valid_count"), of("n"), cell_ci("sft"), cell_ci("grammar"), cell_change("grammar_delta")).alias("grammar"),
    )


def feature_fragments(features: DataFrame, least: int = 20) -> DataFrame:
    """K8: (feature, row) of the supplementary feature table; below `least` gold values a figure is descriptive only, without an interval."""
    some = F.col("support") >= least
    point = F.when(some, cell_ci("abs")).otherwise(F.concat(rounded_text(F.col("abs_f1"), 3), F.lit(" (descriptive)")))
    change = F.when(some, cell_change("diff")).otherwise(F.concat(signed(100 * F.col("diff_delta")), F.lit(" (descriptive)")))
    out = features.select("feature", "support", row_of(escaped(short_feature(F.col("feature"))), F.col("support").cast("string"), point, change).alias("row"))
    return out.orderBy(F.desc("support"), "feature").select("feature", "row")


def sensitivity_fragments(models: DataFrame) -> DataFrame:
    """K8: (model, row) of the supplementary case-mix table."""
    of = lambda c: rounded_text(100 * F.col(c), 1)
    rate = F.concat(F.col("fp_reports").cast("string"), F.lit("/"), F.col("negatives").cast("string"), F.lit(" ("), of("rate"), F.lit(r"\%; 95\% CI: "), of("rate_low"), F.lit(", "), of("rate_high"), F.lit(r"\%)"))
    return models.select("model", row_of(F.col("label"), cell_ci("all"), cell_ci("pos"), rate).alias("row"))


def forest_table(intervals: DataFrame, order: tuple[str, ...], metric: str = "micro_f1") -> DataFrame:
    """K9: the input of a forest plot: (model, config, place, point, below, above), a row each point and its error bars."""
    table = F.create_map(*[x for k, v in enumerate(order) for x in (F.lit(v), F.lit(k))])
    rows = intervals.filter(F.col("metric") == metric).withColumn("place", F.try_element_at(table, F.col("config")))
    return rows.filter("place is not null").select("model", "config", "place", "point", (F.col("point") - F.col("ci_low")).alias("below"), (F.col("ci_high") - F.col("point")).alias("above"))


def stacked_table(changes: DataFrame, by: str = "model") -> DataFrame:
    """K9: the input of stacked bars: features improved, worsened and unchanged by model."""
    return changes.groupBy(by).agg(*[F.count_if(F.col("label") == k).alias(k) for k in ("improved", "worsened", "unchanged")])


def manifest(df: DataFrame, **method: str) -> DataFrame:
    """One row of JSON with the method's text and the row count."""
    return df.agg(F.count("*").alias("rows")).select(F.to_json(F.struct(F.col("rows"), *[F.lit(v).alias(k) for k, v in method.items()])).alias("manifest"))
