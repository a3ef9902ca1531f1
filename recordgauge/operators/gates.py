"""Acceptance gates over summary rows (V12, V13, V15, V16, N21): named checks as columns, nothing raised unless asked.

Fixed values: field names, modes, limits and settings that the evaluated runs must show.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: What an ordinary run must have been sampled with (fixed values).
GREEDY = {"temperature": 0.0, "top_p": 1.0, "top_k": -1.0, "min_p": 0.0, "presence_penalty": 0.0, "frequency_penalty": 0.0, "repetition_penalty": 1.0, "seed": 0.0}
#: Summary fields in which a repeat must equal its run (fixed values).
REPEAT_FIELDS = (
    "Original Dataset Cases",
    "Total Evaluated Cases",
    "Skipped Too Long",
    "Eval Context Limit",
    "Max New Tokens",
    "Max Prompt Tokens",
    "Decoding Mode",
    "Completion Add Special Tokens",
    "Request Sampling Configuration",
    "Date Scoring Normalization",
    "Precision",
    "Recall",
    "F1",
    "IoU",
    "TP",
    "FP",
    "FN",
    "Token Usage",
)
#: The one documented exception to equal settings (fixed values): model, and ordinary and constrained limits.
EXCEPTION_MODEL = "llama3_1_70B"
EXCEPTION_CONTEXT, EXCEPTION_PROMPT, EXCEPTION_NEW = (32768, 24576), (16384, 8192), 16384


def quoted(*path: str) -> str:
    return "$" + "".join(f"['{p}']" for p in path)


def numeric(summary: Column, name: str) -> Column:
    """A number of a summary (VARIANT); an error where it is missing or no number."""
    kind = F.schema_of_variant(F.try_variant_get(summary, quoted(name), "variant"))
    good = kind.rlike("^(?:BIGINT|DOUBLE|FLOAT|DECIMAL|INT|SMALLINT|TINYINT)")
    wrong = F.raise_error(F.lit(f"no numeric {name}")).cast("double")
    return F.when(good, F.try_variant_get(summary, quoted(name), "double")).otherwise(wrong)


def nested(summary: Column, *path: str, kind: str = "double") -> Column:
    """A value below a summary, or null where a hop is missing."""
    return F.try_variant_get(summary, quoted(*path), kind)


def named(df: DataFrame, checks: dict[str, Column]) -> DataFrame:
    """`df` with the failed names and whether all hold; a null fails."""
    failed = F.filter(F.array(*[F.when(~F.coalesce(c, F.lit(False)), k) for k, c in checks.items()]), lambda x: x.isNotNull())
    out = df.withColumns({"failed": failed})
    return out.withColumn("valid", F.size("failed") == 0)


def provenance(df: DataFrame) -> DataFrame:
    """Seven checks that two dense arms were prompted from the dense dataset.

    Columns: base_policies, dc_policies (map of policy to count), base_hashes, dc_hashes,
    dataset_hashes (arrays), base_file, dc_file, dataset_file, records."""
    dense = lambda c: (F.size(c) == 1) & (F.try_element_at(F.col(c), F.lit("dense_nullable")) == F.col("records"))
    basename = F.element_at(F.split(F.col("dataset_file"), "/"), -1)
    return named(df, {
        "base_policy_is_dense_nullable": dense("base_policies"),
        "dc_policy_is_dense_nullable": dense("dc_policies"),
        "base_hash_matches_dataset_audit": F.col("base_hashes").eqNullSafe(F.col("dataset_hashes")),
        "dc_hash_matches_dataset_audit": F.col("dc_hashes").eqNullSafe(F.col("dataset_hashes")),
        "base_and_dc_hashes_identical": F.col("base_hashes").eqNullSafe(F.col("dc_hashes")),
        "base_test_file_matches_dense_dataset": F.col("base_file") == basename,
        "dc_test_file_matches_dense_dataset": F.col("dc_file") == basename,
    })


def pair_acceptance(df: DataFrame) -> DataFrame:
    """`accepted` and `exception` of audited pairs: valid ones, and the one documented difference in limits.

    Columns: model, valid, mismatches (array of field names), context_o, context_c, prompt_o,
    prompt_c, new_o, new_c (limits of the ordinary and the constrained arm), same_cases,
    prompt_mismatches, outputs_valid, ordinary_ok, constrained_ok."""
    limits = [(("context_o", "context_c"), EXCEPTION_CONTEXT), (("prompt_o", "prompt_c"), EXCEPTION_PROMPT), (("new_o", "new_c"), (EXCEPTION_NEW, EXCEPTION_NEW))]
    may = (F.col("model") == EXCEPTION_MODEL) & (F.sort_array("mismatches") == F.array(F.lit("Eval Context Limit"), F.lit("Max Prompt Tokens")))
    for names, wanted in limits:
        for name, value in zip(names, wanted, strict=True):
            may = may & (F.col(name) == value)
    may = may & F.col("same_cases") & (F.col("prompt_mismatches") == 0) & F.col("outputs_valid") & F.col("ordinary_ok") & F.col("constrained_ok")
    valid, may = F.coalesce("valid", F.lit(False)), F.coalesce(may, F.lit(False))
    return df.withColumns({"exception": ~valid & may, "accepted": valid | may})


def matching_fields(a: DataFrame, b: DataFrame, fields: Sequence[str] = REPEAT_FIELDS, key: Sequence[str] = ()) -> DataFrame:
    """(key, differing_fields): summary fields in which two runs differ, null-safe; without a key both have one row."""
    x = a.select(*key, F.struct(*[F.col(f"`{f}`") for f in fields]).alias("__a"))
    y = b.select(*key, F.struct(*[F.col(f"`{f}`") for f in fields]).alias("__b"))
    both = x.join(y, list(key), "full") if key else x.join(y)
    differ = F.filter(F.array(*[F.when(~F.col("__a").getField(f).eqNullSafe(F.col("__b").getField(f)), F.lit(f)) for f in fields]), lambda n: n.isNotNull())
    return both.select(*key, differ.alias("differing_fields"))


def controlled(df: DataFrame, cases: int | None, modes: dict[str, str], new_tokens: dict[str, int], sampled: Sequence[str]) -> DataFrame:
    """Arm rows with their failed rules.

    Columns: model, arm, n_cases, total, original, skipped, special_tokens, normalisation,
    date_policy, sampling (map of setting to double), mode, max_new. `modes` and `new_tokens`
    give what an arm must show, `sampled` the arms that must have been sampled greedily. All
    arms of a model must share one date policy."""
    by = lambda table, c: F.coalesce(F.col(c) == F.try_element_at(F.create_map(*[F.lit(x) for kv in table.items() for x in kv]), F.col("arm")), ~F.col("arm").isin(*table), F.lit(False)) if table else F.lit(True)
    greedy = F.size("sampling") == len(GREEDY)
    for k, v in GREEDY.items():
        greedy = greedy & (F.try_element_at(F.col("sampling"), F.lit(k)) == v)
    rules = {
        "cases": (F.col("n_cases") == cases) if cases is not None else (F.col("n_cases") > 0),
        "total": F.col("total") == F.col("n_cases"),
        "original": (F.col("original") == cases) if cases is not None else F.lit(True),
        "none_skipped": F.col("skipped") == 0,
        "no_special_tokens": ~F.col("special_tokens"),
        "normalised": F.col("normalisation").isNotNull(),
        "dates_normalised": F.col("date_policy") != "",
        "sampling": greedy | ~F.col("arm").isin(*sampled),
        "mode": by(modes, "mode"),
        "max_new_tokens": by(new_tokens, "max_new"),
        "one_date_policy": F.col("__policies") == 1,
    }
    one = df.groupBy("model").agg(F.count_distinct("date_policy").alias("__policies"))
    return named(df.join(one, "model"), rules).drop("__policies")


def matching_f1(rows: DataFrame, summaries: DataFrame, key: Sequence[str], tolerance: float = 1e-12) -> DataFrame:
    """(key, value, saved, matches): a rebuilt point estimate against the saved one."""
    both = rows.select(*key, F.col("f1").alias("value")).join(summaries.select(*key, F.col("f1").alias("saved")), list(key), "full")
    return both.withColumn("matches", F.coalesce(F.abs(F.col("value") - F.col("saved")) <= tolerance, F.lit(False)))
