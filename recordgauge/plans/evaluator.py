"""The evaluator end to end (L7) and the pipelines over its arms (B1-B6), as DataFrames.

Every stage is a projection or an aggregate: a case's two records are scored in their row; nothing reaches the driver but
what a caller asks for. An arm is what `evaluate` returns for one model in one regime.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from recordgauge.functions import jsonx, slots
from recordgauge.operators import audits, bootstrap, gates, generation, metrics, reports, scoring
from recordgauge.operators.cases import FEATURES, feature_sums, feature_vectors, scores
from recordgauge.session import cut

@dataclass(frozen=True)
class Arm:
    """cases: one row a case; skipped: cases whose prompt is too long; summary: one row."""

    cases: DataFrame
    skipped: DataFrame
    summary: DataFrame


def scored(cases: DataFrame) -> DataFrame:
    """A1, A2: the cases with tp, fp, fn, precision, recall, f1 and iou, by their findings; a case without any counts as right."""
    x = cases.withColumn("__s", scores("gold", "prediction"))
    x = x.withColumns({c: F.col(f"__s.{c}") for c in ("tp", "fp", "fn")}).drop("__s")
    return x.withColumns(scoring.ratios(F.col("tp"), F.col("fp"), F.col("fn"), 1.0))


def casewise(cases: DataFrame) -> DataFrame:
    """A1, A2: (id, tp, fp, fn, precision, recall, f1, iou) of every case."""
    return scored(cases.select("id", "gold", "prediction")).drop("gold", "prediction")


def evaluate(dataset: DataFrame, client: Callable[[str], str], context: int, max_new: int, template=lambda t: t, tokens=generation.white_space_tokens, dense: bool = False) -> Arm:
    """Prompts, answers, recovery, normalisation, contract, scores and the arm's summary.

    dataset: (id, instruction, input, output), output being the expected record as JSON."""
    audits.require_unique(dataset, ["id"], "dataset")
    asked = generation.render_prompts(dataset, "instruction", "input", template, tokens, context, max_new)
    skipped = asked.filter("skipped").select("id", "prompt_tokens")
    # the answers are written once: a model is not asked again for a later stage
    answers = cut(generation.generate(asked.filter("not skipped").drop("skipped"), client))
    raw = jsonx.safe_object_json(F.col("completion"))
    cases = answers.select("id", "prompt_tokens", tokens(F.col("completion")).alias("completion_tokens"), F.col("completion").alias("raw"), raw.alias("object"), jsonx.normalise_json(F.col("completion")).alias("prediction"), jsonx.normalise_json(F.col("output")).alias("gold"))
    cases = cases.withColumn("faults", slots.dense_faults_json(F.col("object")) if dense else F.array().cast("array<string>"))
    cases = cut(scored(cases))
    return Arm(cases, skipped, summarise(cases, skipped))


def summarise(cases: DataFrame, skipped: DataFrame | None = None, **policies: str) -> DataFrame:
    """One row of counts, micro scores, token statistics and policy names."""
    out = scoring.micro(cases.select("tp", "fp", "fn"))
    counts = cases.agg(F.count("*").alias("n"), F.count_if(F.col("object") != "{}").alias("objects"), F.count_if(F.size("faults") > 0).alias("contract_faults"))
    out = counts.join(out)  # one row each
    for kind in ("prompt_tokens", "completion_tokens"):
        stats = metrics.token_stats(cases, [], kind)
        out = out.join(stats.select(*[F.col(c).alias(f"{kind}_{c}") for c in stats.columns if c != "n"]))  # one row each
    if skipped is not None:
        out = out.join(skipped.agg(F.count("*").alias("skipped")))  # one row each
    return out.withColumns({k: F.lit(v) for k, v in policies.items()})


def rescored(saved: DataFrame) -> DataFrame:
    """(id, raw, gold, prediction, tp, ...) of saved cases to the same with predictions and scores built anew.

    The saved columns stay as saved_prediction and saved_tp, saved_fp and saved_fn."""
    old = [F.col(c).alias(f"saved_{c}") for c in ("prediction", "tp", "fp", "fn")]
    fresh = saved.select("id", "raw", jsonx.normalise_json(F.col("gold")).alias("gold"), jsonx.normalise_json(F.col("raw")).alias("prediction"), jsonx.safe_object_json(F.col("raw")).alias("object"), F.array().cast("array<string>").alias("faults"), "prompt_tokens", "completion_tokens", *old)
    return cut(scored(fresh))


def rescore_counts(cases: DataFrame) -> DataFrame:
    """How many predictions and scores a rescore changed."""
    changed = ~F.col("prediction").eqNullSafe(F.col("saved_prediction"))
    moved = F.lit(False)
    for c in ("tp", "fp", "fn"):
        moved = moved | ~F.col(c).eqNullSafe(F.col(f"saved_{c}"))
    return cases.agg(F.count("*").alias("cases"), F.count_if(changed).alias("changed_predictions"), F.count_if(moved).alias("changed_metrics"))


def feature_table(cases: DataFrame) -> DataFrame:
    """Scores by feature over all cases; every feature of the schema appears."""
    names = cases.sparkSession.createDataFrame([(f,) for f in FEATURES], "feature string")
    return scoring.feature_scores(feature_sums(cases), names)


def controlled_pair(dataset: DataFrame, ordinary: Callable[[str], str], constrained: Callable[[str], str], context: int, max_new: int, dense: bool = False, tokens=generation.white_space_tokens) -> dict[str, DataFrame]:
    """B1, B2: an ordinary arm, its repeat and a constrained arm, their features and the audit of the pair."""
    arms = {name: evaluate(dataset, client, context, max_new, tokens=tokens, dense=dense and name == "constrained") for name, client in (("ordinary", ordinary), ("repeat", ordinary), ("constrained", constrained))}
    a, r, c = (arms[k].cases for k in ("ordinary", "repeat", "constrained"))
    repeat = audits.repeat_check(a, r, ["id"], ["raw", "prediction", "prompt_tokens", "completion_tokens"])
    prompts = audits.prompt_tokens(a, c, ["id"], "prompt_tokens")
    fields = ("n", "tp", "fp", "fn", "precision", "recall", "f1", "iou")
    same = gates.matching_fields(arms["ordinary"].summary, arms["repeat"].summary, fields)
    valid = c.agg(F.coalesce(F.bool_and((F.col("object") != "{}") & (F.size("faults") == 0)), F.lit(True)).alias("outputs_valid"))
    audit = repeat.select("reproducible").join(prompts).join(same).join(valid)  # one row each
    accepted = F.col("reproducible") & (F.col("missing") + F.col("mismatched") == 0) & (F.size("differing_fields") == 0) & F.col("outputs_valid")
    return {
        "ordinary": arms["ordinary"].summary, "constrained": arms["constrained"].summary, "ordinary_features": feature_table(a), "constrained_features": feature_table(c),
        "audit": audit.withColumn("accepted", accepted), "changes": audits.pair_audit(a, c, ["id"], ["raw", "prediction"]),
    }


def dense_pair(sparse: DataFrame, dense: DataFrame, ordinary: Callable[[str], str], constrained: Callable[[str], str], context: int, max_new: int) -> dict[str, DataFrame]:
    """The pair over the dense dataset, behind the audit of the two datasets."""
    audit = cut(audits.dataset_pair_audit(sparse, dense, "instruction", ["id", "input", "output"]))  # read here and by the caller
    row = audit.first()
    if row["content_differs"] or row["shared_digests"] or row["sparse_policy"] != row["records"] or row["dense_policy"] != row["records"]:
        raise ValueError(f"the datasets are no pair: {row.asDict()}")
    return {"datasets": audit, **controlled_pair(dense.drop("pos"), ordinary, constrained, context, max_new)}


def compare_regimes(arms: dict[tuple[str, str], DataFrame], features: bool = True) -> dict[str, DataFrame]:
    """Saved cases by (model, regime) to rescored summaries, feature tables (if asked for) and the effects between regimes."""
    parts: dict[str, DataFrame] = {}
    for (model, regime), saved in arms.items():
        tag = {"model": F.lit(model), "regime": F.lit(regime)}
        cases = rescored(saved)
        own = {"rows": summarise(cases), "changes": rescore_counts(cases)} | ({"features": feature_table(cases)} if features else {})
        for name, d in own.items():
            d = d.withColumns(tag)
            parts[name] = append(parts[name], d) if name in parts else d
    rows = cut(parts["rows"])
    return parts | {"rows": reports.by_category(rows, "regime", reports.REGIMES), "effects": reports.effects(rows, ["model"], "regime", "f1")}


def append(a: DataFrame, b: DataFrame) -> DataFrame:
    """U4: rows of one arm after another's, by column name; columns of one side only are null on the other."""
    return a.unionByName(b, allowMissingColumns=True)


def consolidate(arms: dict[tuple[str, str], DataFrame], gate: DataFrame, **method: str) -> dict[str, DataFrame]:
    """Behind the gate (rows with `accepted`), feature tables of all arms long and wide by regime and model, and the manifest."""
    refused = gate.filter(~F.col("accepted"))
    if not refused.isEmpty():
        raise ValueError(f"refused: {[r.asDict() for r in refused.limit(5).collect()]}")
    long = None
    for (model, regime), cases in arms.items():
        part = feature_table(cases).withColumns({"model": F.lit(model), "regime": F.lit(regime)})
        long = part if long is None else append(long, part)
    long = cut(long)
    names = [f"{regime} | {model}" for model, regime in arms]
    wide = reports.wide_by(long, "feature", F.concat_ws(" | ", "regime", "model"), "f1", names)
    supported = metrics.summary(long, ["model", "regime"], "supported")
    return {"long": long, "wide": wide, "supported": supported, "manifest": reports.manifest(long, **method)}


def intervals(arms: dict[tuple[str, str], DataFrame], contrasts: dict[str, tuple[str, str]], iterations: int = bootstrap.ITERATIONS, seed: int = bootstrap.SEED) -> DataFrame:
    """Bootstrap intervals of all arms and contrasts under one set of draws, behind the check that all arms share cases and gold."""
    gold, sparse, places = None, None, {}
    for (model, config), cases in arms.items():
        own = cases.select("id", "gold", F.lit(f"{model} | {config}").alias("arm"))
        part = cases.select("id", F.lit(model).alias("model"), F.lit(config).alias("config"), feature_vectors("gold", "prediction").alias("v"))
        gold = own if gold is None else gold.unionByName(own)
        sparse = part if sparse is None else sparse.unionByName(part)
        places.setdefault(model, []).append(config)
    anchor = audits.anchor_equality(gold, "id", "gold", "arm", len(arms))
    if not anchor.filter(~F.col("same")).isEmpty():
        raise ValueError("the arms differ in cases or gold")
    positive = next(iter(arms.values())).select("id", (F.size(jsonx.findings_json(F.col("gold"))) > 0).alias("positive"))
    numbered = cut(audits.numbered(positive, ["id"]).withColumnRenamed("pos", "idx"))
    n, out = numbered.count(), None
    for model, configs in sorted(places.items()):
        configs = sorted(configs)
        names = F.array(*[F.lit(c) for c in configs])
        # a case's vectors of all configurations in one row; cells that are 0 are left out
        first = (F.array_position(names, F.col("config")) - 1).cast("int") * (4 * len(FEATURES))
        cells = F.transform("v", lambda x, i: F.struct((first + i).alias("cell"), x.cast("double").alias("v")))
        each = sparse.filter(F.col("model") == model).select("id", F.filter(cells, lambda e: e["v"] != 0).alias("e"))
        rows = each.groupBy("id").agg(F.sort_array(F.flatten(F.collect_list("e"))).alias("entries")).join(numbered.hint("merge"), "id")
        part = bootstrap.published_rows(cut(rows.select("idx", "positive", "entries")), n, model, configs, list(FEATURES), contrasts, iterations, seed)
        out = part if out is None else out.unionByName(part)
    return out
