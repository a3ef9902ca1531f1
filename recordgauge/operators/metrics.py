"""Metric families over feature rows, token statistics and comparisons."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from recordgauge.functions.text import plausible_context, round_up, safe_div

COUNTS = ("TP", "FP", "FN")


def f1_of(tp: Column, fp: Column, fn: Column) -> Column:
    """A9; 0 without events."""
    return safe_div(2 * tp, 2 * tp + fp + fn)


def f1_or_null(tp: Column, fp: Column, fn: Column) -> Column:
    """A10."""
    return F.try_divide((2 * tp).cast("double"), (2 * tp + fp + fn).cast("double"))


def weighted_average(value: str, weight: str) -> Column:
    """A11 as an aggregate."""
    return safe_div(F.sum(F.col(value) * F.col(weight)), F.sum(weight))


def micro_metrics(rows: DataFrame, by: list[str] | None = None) -> DataFrame:
    """Micro precision, recall and F1 of summed counts."""
    sums = rows.groupBy(*(by or [])).agg(*[F.sum(c).alias(c) for c in COUNTS])
    p, r = safe_div(F.col("TP"), F.col("TP") + F.col("FP")), safe_div(F.col("TP"), F.col("TP") + F.col("FN"))
    return sums.select("*", p.alias("micro_precision"), r.alias("micro_recall"), safe_div(2 * p * r, p + r).alias("micro_f1"))


def universe(rows: DataFrame, which: str = "all") -> DataFrame:
    """T14: 'all' rows, those 'observed' in gold or by either arm, or those 'supported' by gold."""
    if which == "all":
        return rows
    if which == "supported":
        return rows.filter("gold_appearances > 0")
    return rows.filter((F.col("gold_appearances") > 0) | (F.col("TP") + F.col("FP") + F.col("FN") > 0))


def summary(rows: DataFrame, by: list[str] | None = None, which: str = "all") -> DataFrame:
    """Micro, macro and support-weighted means of a universe, and false positives without support."""
    d = rows if which == "all" else universe(rows, which)
    sums = [F.sum(c).alias(c) for c in COUNTS]
    means = [F.avg(c).alias(f"macro_{c}") for c in ("precision", "recall", "f1")]
    out = d.groupBy(*(by or [])).agg(*sums, *means, weighted_average("f1", "gold_appearances").alias("weighted_f1"), F.count("*").alias("n_features"), F.sum(F.when(F.col("gold_appearances") == 0, F.col("FP")).otherwise(0)).alias("zero_support_fp"))
    return out.withColumn("micro_f1", f1_of(*[F.col(c) for c in COUNTS]))


def two_arms(a: DataFrame, b: DataFrame, which: str = "all") -> DataFrame:
    """A14 ('all'), A15 ('observed'): macro and micro F1 of two arms over one universe of features, and their differences.

    Observed is a feature that gold holds or either arm has an event of."""
    cols = ("gold_appearances", *COUNTS, "f1")
    x = a.select("feature", *[F.col(c).alias(f"{c}_a") for c in cols])
    both = x.join(b.select("feature", *[F.col(c).alias(f"{c}_b") for c in cols]), "feature")
    if which == "observed":
        both = both.filter(sum([F.col(f"{c}_{s}") for c in cols[:-1] for s in "ab"], F.lit(0)) > 0)
    out = both.agg(F.count("*").alias("n_features"), *[F.avg(f"f1_{s}").alias(f"macro_{s}") for s in "ab"], *[F.sum(f"{c}_{s}").alias(f"{c}_{s}") for c in COUNTS for s in "ab"])
    out = out.withColumns({f"micro_{s}": f1_of(*[F.col(f"{c}_{s}") for c in COUNTS]) for s in "ab"})
    return out.withColumns({f"{m}_delta": F.col(f"{m}_b") - F.col(f"{m}_a") for m in ("macro", "micro")})


def compare_features(a: DataFrame, b: DataFrame, names: tuple[str, str] = ("a", "b"), tolerance: float = 1e-12) -> DataFrame:
    """Features of both arms, one to one, with deltas, points, relative change and a label."""
    for side, df in zip(names, (a, b), strict=True):
        if not df.groupBy("feature").count().filter("count > 1").isEmpty():
            raise ValueError(f"repeated features in {side}")
    cols = ("gold_appearances", *COUNTS, "precision", "recall", "f1")
    x = a.select("feature", *[F.col(c).alias(f"{c}_{names[0]}") for c in cols])
    y = b.select("feature", *[F.col(c).alias(f"{c}_{names[1]}") for c in cols])
    return with_change(x.join(y, "feature"), F.col(f"f1_{names[0]}"), F.col(f"f1_{names[1]}"), tolerance)


def with_change(df: DataFrame, base: Column, other: Column, tolerance: float = 1e-12) -> DataFrame:
    delta = other - base
    label = F.when(delta > tolerance, "improved").when(delta < -tolerance, "worsened").otherwise("unchanged")
    return df.withColumns({"delta": delta, "points": 100 * delta, "relative_pct": F.when(base != 0, 100 * delta / base), "label": label})


def ranked_values(df: DataFrame, by: list[str], c: str) -> DataFrame:
    """Distinct values of c by group with their number (k), the rows up to them (upto) and the group's rows (n); nulls count none.

    Order statistics come from these few rows, so that no group's values meet in one list."""
    freq = df.groupBy(*by, c).agg(F.count(c).alias("k"))
    group = Window.partitionBy(*(by or [F.lit(0)]))
    upto = F.sum("k").over(group.orderBy(F.col(c).asc_nulls_first()).rowsBetween(Window.unboundedPreceding, 0))
    return freq.withColumns({"upto": upto, "n": F.sum("k").over(group)})


def at_rank(c: str, index: Column) -> Column:
    """The value at a rank from 0, as an aggregate over `ranked_values`."""
    return F.min(F.when(F.col("upto") > index, F.col(c)))


def linear(c: str, p: float) -> Column:
    """Linear-interpolated quantile, as an aggregate over `ranked_values`."""
    place = (F.col("n") - 1) * F.lit(p)
    low, high = at_rank(c, F.floor(place)), at_rank(c, F.ceil(place))
    return low + (high - low) * F.max(place - F.floor(place))


def token_stats(df: DataFrame, by: list[str], c: str, p: float = 0.95) -> DataFrame:
    """Total, mean, median, min, max and nearest-rank P95 by group; nulls skipped."""
    r = ranked_values(df, by, c)
    total, n = F.sum(F.col(c) * F.col("k")), F.sum("k")
    return r.groupBy(*by).agg(
        F.coalesce(total, F.lit(0)).cast("long").alias("total"), F.try_divide(total.cast("double"), n.cast("double")).alias("mean"), linear(c, 0.5).cast("double").alias("median"),
        F.min(c).alias("min"), F.max(c).alias("max"), n.alias("n"), at_rank(c, F.rint((F.col("n") - 1) * F.lit(p))).alias("p95"),
    )


def length_stats(df: DataFrame, by: list[str], c: str) -> DataFrame:
    """Linear percentiles 90, 95 and 99 with min, mean, median and max."""
    r = ranked_values(df, by, c)
    mean = F.try_divide(F.sum(F.col(c) * F.col("k")).cast("double"), F.sum("k").cast("double"))
    q = {"median": 0.5, "p90": 0.9, "p95": 0.95, "p99": 0.99}
    return r.groupBy(*by).agg(F.min(c).alias("min"), mean.alias("mean"), *[linear(c, p).cast("double").alias(k) for k, p in q.items()], F.max(c).alias("max"))


def recommend_context(df: DataFrame, by: list[str], prompt: str, gold: str, allowance: int, buffer: int, multiple: int, native: int) -> DataFrame:
    """The needed context, rounded up, and whether it fits and the cap covers the gold answers."""
    sums = df.groupBy(*by).agg(F.max(prompt).alias("max_prompt"), F.max(gold).alias("max_gold"))
    need = round_up(F.col("max_prompt") + allowance + buffer, multiple)
    return sums.select("*", need.alias("recommended"), plausible_context(need).isNotNull().alias("plausible"), (need <= native).alias("fits_native"), (F.col("max_gold") <= allowance).alias("cap_covers_gold"))


def arm_summary(df: DataFrame, by: list[str], exact: Column, valid: Column, fits: Column, nulls: Column, status: Column, tokens: Column, errors: Column) -> DataFrame:
    """Tags, validity, null counts, count/list status histogram and completion tokens of an arm."""
    names = ("both_omitted", "consistent", "inconsistent", "uncheckable")
    return df.groupBy(*by).agg(
        F.count("*").alias("n"), F.count_if(exact).alias("exact_tags"), F.count_if(valid).alias("json_valid"), F.count_if(fits).alias("schema_valid"),
        F.coalesce(F.sum(nulls), F.lit(0)).alias("nulls"), *[F.count_if(status == s).alias(f"status_{s}") for s in names],
        F.coalesce(F.sum(tokens), F.lit(0)).alias("completion_tokens"), F.sum(F.size(F.slice(errors, 1, 5))).alias("listed_errors"),
    )


def truncation(df: DataFrame, by: list[str], reason: str, tokens: str, limit: int) -> DataFrame:
    """Hits of the length limit; the proxy counts where a reason is missing, and names the measurement."""
    hit = F.when(F.col(reason).isNotNull(), F.col(reason) == "length").otherwise(F.coalesce(F.col(tokens) >= limit, F.lit(False)))
    return df.groupBy(*by).agg(F.count("*").alias("n"), F.count_if(hit).alias("hits"), F.when(F.bool_and(F.col(reason).isNotNull()), "finish_reason").otherwise("completion_limit_proxy").alias("measured_by"))


def presence_summary(df: DataFrame, by: list[str]) -> DataFrame:
    """Counts and shares of a ladder's rungs and formats; df has matched_by and id_format."""
    m, f = F.col("matched_by"), F.col("id_format")
    n = F.count("*")

    def with_pct(name: str, cond: Column) -> list[Column]:
        return [F.count_if(cond).alias(f"{name}_n"), F.round(100.0 * F.count_if(cond) / n, 3).alias(f"{name}_pct")]

    rungs = ("strict_token", "strict_ws_token", "relaxed_casefold", "relaxed_compact", "relaxed_prefix_stripped", "relaxed_digits", "relaxed_digits_no_zeros", "none")
    out = [n.alias("total_occurrences"), *with_pct("strict_present", m == "strict_token"), *with_pct("strict_plus_ws", m.isin("strict_token", "strict_ws_token"))]
    out += [*with_pct("relaxed_only", ~m.isin("strict_token", "none")), *with_pct("any_present", m != "none")]
    for kind in ("numeric", "alphanumeric", "other"):
        out += with_pct(kind, f == kind)
    return df.groupBy(*by).agg(*out, *[F.count_if(m == r).alias(f"matched_by_{r}_n") for r in rungs])


def share_within(df: DataFrame, by: list[str], what: str) -> DataFrame:
    """Counts of `what` and their share within the group."""
    n = df.groupBy(*by, what).agg(F.count("*").alias("n"))
    return n.withColumn("pct", F.round(100.0 * F.col("n") / F.sum("n").over(Window.partitionBy(*by)), 3))


def histogram(df: DataFrame, by: list[str], values: Column) -> DataFrame:
    """Counts by value over exploded lists, as sorted (value, n) pairs a group."""
    n = df.select(*by, F.explode(values).alias("value")).groupBy(*by, "value").agg(F.count("*").alias("n"))
    return n.groupBy(*by).agg(F.sort_array(F.collect_list(F.struct("value", "n"))).alias("histogram"))


def gate(df: DataFrame, checks: list[str]) -> DataFrame:
    """Whether every check holds in every row; a null fails."""
    return df.agg(*[F.coalesce(F.bool_and(F.coalesce(F.col(c), F.lit(False))), F.lit(False)).alias(c) for c in checks])


def instruction_summary(df: DataFrame, text: str, by: list[str]) -> DataFrame:
    """Records, policy counts and distinct digests by group."""
    from recordgauge.functions.text import classify_instruction, sha256_text

    d = df.select(*by, classify_instruction(F.col(text)).alias("policy"), sha256_text(F.col(text)).alias("sha"))
    names = ("sparse_omit_null", "dense_nullable", "conflicting_sparse_and_dense", "unrecognized")
    return d.groupBy(*by).agg(F.count("*").alias("records"), *[F.count_if(F.col("policy") == p).alias(p) for p in names], F.countDistinct("sha").alias("unique_instructions"))
