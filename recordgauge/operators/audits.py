"""Guards and audits of datasets, arms and repeats (V9-V17, X8-X16): each a small DataFrame of counts or checks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from recordgauge.functions.text import classify_instruction, sha256_text
from recordgauge.session import cut

#: The settings that must agree between the arms of an audit, and between a run and its repeat.
SFT_FIELDS = ("model", "dataset", "seed", "temperature", "top_p", "max_new_tokens")
BASE_FIELDS = (*SFT_FIELDS, "max_model_len", "max_num_seqs")
REPEAT_EXTRA = ("decoding_mode", "template_style")


def duplicates(df: DataFrame, key: list[str]) -> DataFrame:
    """Keys that occur more than once."""
    return df.groupBy(*key).agg(F.count("*").alias("n")).filter("n > 1")


def require_unique(df: DataFrame, key: list[str], label: str) -> DataFrame:
    if not duplicates(df, key).isEmpty():
        raise ValueError(f"{label}: repeated {', '.join(key)}")
    return df


def pair_differences(a: DataFrame, b: DataFrame, key: list[str], compare: list[str]) -> DataFrame:
    """Rows of both arms by key, with a null-safe difference flag a column and where a row is missing."""
    x = a.select(*key, *[F.col(c).alias(f"a_{c}") for c in compare], F.lit(True).alias("in_a"))
    y = b.select(*key, *[F.col(c).alias(f"b_{c}") for c in compare], F.lit(True).alias("in_b"))
    both = x.join(y, key, "full")
    return both.select(*key, F.col("in_a").isNotNull().alias("in_a"), F.col("in_b").isNotNull().alias("in_b"), *[(~F.col(f"a_{c}").eqNullSafe(F.col(f"b_{c}"))).alias(f"differs_{c}") for c in compare])


def pair_audit(a: DataFrame, b: DataFrame, key: list[str], compare: list[str]) -> DataFrame:
    """One row: common and one-sided rows, and differing values among the common ones."""
    d = pair_differences(a, b, key, compare)
    both = F.col("in_a") & F.col("in_b")
    return d.agg(
        F.count_if(both).alias("common"), F.count_if(~F.col("in_b")).alias("only_a"), F.count_if(~F.col("in_a")).alias("only_b"),
        *[F.count_if(both & F.col(f"differs_{c}")).alias(f"differs_{c}") for c in compare],
    )


def prompt_tokens(a: DataFrame, b: DataFrame, key: list[str], c: str) -> DataFrame:
    """X11: rows with equal, differing and missing token counts."""
    x, y = a.select(*key, F.col(c).alias("__a")), b.select(*key, F.col(c).alias("__b"))
    missing = F.col("__a").isNull() | F.col("__b").isNull()
    return x.join(y, key, "full").agg(F.count("*").alias("n"), F.count_if(missing).alias("missing"), F.count_if(~missing & (F.col("__a") != F.col("__b"))).alias("mismatched"))


def numbered(df: DataFrame, order: list[str], within: list[str] | None = None) -> DataFrame:
    """Positions from 0 in a stated order, within groups or over all rows.

    Over all rows these are sorted by ranges, written once, and numbered by their range's
    first position; only the ranges' sizes reach the driver."""
    if within:
        return df.withColumn("pos", (F.row_number().over(Window.partitionBy(*within).orderBy(*order)) - 1).cast("long"))
    spread = df.repartitionByRange(*order).sortWithinPartitions(*order)
    own = F.monotonically_increasing_id()
    spread = cut(spread.withColumns({"__part": F.shiftright(own, 33), "__own": own.bitwiseAND((1 << 33) - 1)}))
    sizes = sorted((r["__part"], r["n"]) for r in spread.groupBy("__part").agg(F.count("*").alias("n")).collect())
    starts, total = [], 0
    for part, n in sizes:
        starts.append((part, total))
        total += n
    first = F.broadcast(df.sparkSession.createDataFrame(starts, "__part long, __first long"))  # one row a partition
    return spread.join(first, "__part").withColumn("pos", F.col("__first") + F.col("__own")).drop("__part", "__own", "__first")


def zip_join(a: DataFrame, b: DataFrame, within: list[str], compare: list[str]) -> DataFrame:
    """Rows of equal position (column pos) side by side."""
    x = a.select(*within, "pos", *[F.col(c).alias(f"a_{c}") for c in compare])
    y = b.select(*within, "pos", *[F.col(c).alias(f"b_{c}") for c in compare])
    return x.join(y, [*within, "pos"], "full")


def same_examples(a: DataFrame, b: DataFrame, key: list[str], compare: list[str]) -> DataFrame:
    """Whether keys, their order (column pos) and the compared columns agree."""
    d = pair_differences(a, b, key, ["pos", *compare])
    good = F.col("in_a") & F.col("in_b")
    for c in ("pos", *compare):
        good = good & ~F.col(f"differs_{c}")
    return d.agg(F.coalesce(F.bool_and(good), F.lit(True)).alias("same"))


def anchor_equality(arms: DataFrame, key: str, value: str, arm: str, n: int) -> DataFrame:
    """(key, rows, arms, values, same): whether each of n arms holds the key once, and all with one value."""
    by = arms.groupBy(key).agg(F.count("*").alias("rows"), F.count_distinct(arm).alias("arms"), F.count_distinct(value).alias("values"), F.count_if(F.col(value).isNull()).alias("__nulls"))
    one = (F.col("values") == 1) & (F.col("__nulls") == 0) | (F.col("values") == 0)
    return by.withColumn("same", (F.col("rows") == n) & (F.col("arms") == n) & one).drop("__nulls")


#: Rows up to which a lookup table is broadcast.
LOOKUP_ROWS = 100_000


def lookup(df: DataFrame, table: DataFrame, key: list[str]) -> DataFrame:
    """Rows with the columns of the table's row of equal key, or nulls; the table's keys must be unique.

    The table is broadcast if it is counted to be small, else joined by a shuffle."""
    require_unique(table, key, "lookup table")
    small = table.limit(LOOKUP_ROWS + 1).count() <= LOOKUP_ROWS
    return df.join(F.broadcast(table) if small else table, key, "left")


def combinations(*names: DataFrame, limit: int = 1_000_000) -> DataFrame:
    """Every combination of small dimensions (models, configurations, contrasts); their product is counted first."""
    product = 1
    for d in names:
        product *= d.count()
    if product > limit:
        raise ValueError(f"{product} combinations are more than {limit}")
    out = names[0]
    for d in names[1:]:
        out = out.join(d)  # counted above
    return out


def set_checks(a: DataFrame, b: DataFrame, c: str) -> DataFrame:
    """Sizes of the differences and of the common part of two value sets."""
    x, y = a.select(F.col(c).alias("v")).distinct(), b.select(F.col(c).alias("v")).distinct()
    both = x.withColumn("__a", F.lit(1)).join(y.withColumn("__b", F.lit(1)), "v", "full")
    return both.agg(F.count_if(F.col("__b").isNull()).alias("only_a"), F.count_if(F.col("__a").isNull()).alias("only_b"), F.count_if(F.col("__a").isNotNull() & F.col("__b").isNotNull()).alias("common"))


def dataset_pair_audit(sparse: DataFrame, dense: DataFrame, instruction: str, content: list[str], pos: str = "pos") -> DataFrame:
    """Policies, disjoint instruction digests and equal other content, row by row."""
    x = sparse.select(pos, F.col(instruction).alias("__a"), F.to_json(F.struct(*content)).alias("__ca"))
    y = dense.select(pos, F.col(instruction).alias("__b"), F.to_json(F.struct(*content)).alias("__cb"))
    shared = sparse.select(sha256_text(F.col(instruction)).alias("s")).intersect(dense.select(sha256_text(F.col(instruction)).alias("s")))
    out = x.join(y, pos, "full").agg(
        F.count("*").alias("records"), F.count_if(classify_instruction(F.col("__a")) == "sparse_omit_null").alias("sparse_policy"),
        F.count_if(classify_instruction(F.col("__b")) == "dense_nullable").alias("dense_policy"), F.count_if(~F.col("__ca").eqNullSafe(F.col("__cb"))).alias("content_differs"),
    )
    return out.join(shared.agg(F.count("*").alias("shared_digests")))  # one row each


def checks(df: DataFrame, named: dict[str, Column]) -> DataFrame:
    """Named boolean checks a row (null fails), and whether all hold."""
    cols = {k: F.coalesce(v, F.lit(False)) for k, v in named.items()}
    valid = F.lit(True)
    for k in cols:
        valid = valid & F.col(k)
    return df.withColumns(cols).withColumn("valid", valid)


def rule_table(df: DataFrame, rules: list[tuple[str, Column, Column | None]], exempt: str | None = None) -> DataFrame:
    """Rules (name, condition, exemption): failed rule names of each row; an exempted rule is listed apart."""
    failed = F.filter(F.array(*[F.when(~F.coalesce(c, F.lit(False)) & ~(F.coalesce(e, F.lit(False)) if e is not None else F.lit(False)), n) for n, c, e in rules]), lambda x: x.isNotNull())
    waived = F.filter(F.array(*[F.when(~F.coalesce(c, F.lit(False)) & (F.coalesce(e, F.lit(False)) if e is not None else F.lit(False)), n) for n, c, e in rules]), lambda x: x.isNotNull())
    return df.withColumns({"failed": failed, "waived": waived, "accepted": F.size(failed) == 0})


def normalisation_summary(df: DataFrame, by: list[str], valid: Column, left_null: Column, nulls: Column, leaves: Column) -> DataFrame:
    """V9: raw validity and null shares of an arm, and cases whose normalised object still holds nulls."""
    return df.groupBy(*by).agg(F.count("*").alias("n"), F.count_if(valid).alias("raw_valid"), F.count_if(left_null).alias("with_null_left"), F.sum(nulls).alias("null_leaves"), F.sum(leaves).alias("leaves"))


def reparse_check(df: DataFrame, raw_object: Column, saved: Column) -> DataFrame:
    """Whether the raw text parses to the saved object (both canonical JSON)."""
    return df.withColumn("reparses", raw_object.eqNullSafe(saved))


def token_totals(cases: DataFrame, reported: DataFrame, by: list[str], c: str) -> DataFrame:
    """Reported totals against the cases' sums; missing counts."""
    own = cases.groupBy(*by).agg(F.coalesce(F.sum(c), F.lit(0)).alias("summed"), F.count_if(F.col(c).isNull()).alias("missing"))
    return own.join(reported, by, "full").withColumn("agrees", F.col("summed").eqNullSafe(F.col("reported")) & (F.col("missing") == 0))


def repeat_check(a: DataFrame, b: DataFrame, key: list[str], compare: list[str]) -> DataFrame:
    """Whether a repeat reproduces every case, and the first 20 keys that differ."""
    d = pair_differences(a, b, key, compare)
    bad = ~F.col("in_a") | ~F.col("in_b")
    for c in compare:
        bad = bad | F.col(f"differs_{c}")
    n = d.agg(F.count_if(bad).alias("n_differ"))
    first = d.filter(bad).orderBy(*key).limit(20).agg(F.sort_array(F.collect_list(F.struct(*key))).alias("first"))
    return n.join(first).withColumn("reproducible", F.col("n_differ") == 0)  # one row each


def conversion_safe(before: DataFrame, after: DataFrame, changed: list[str]) -> DataFrame:
    """Rows that differ outside the changed columns, in either direction."""
    rest = [c for c in before.columns if c not in changed]
    x, y = before.select(*rest), after.select(*rest)
    return x.exceptAll(y).agg(F.count("*").alias("lost")).join(y.exceptAll(x).agg(F.count("*").alias("gained")))  # one row each
