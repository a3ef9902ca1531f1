"""Queries over whole pipelines: the evaluator, rescoring, regimes, consolidation, bootstrap, the decoder; with DuckDB twins.

A case is a customer k with k % 3 expected findings. Its predicted record departs from the
expected one by k % 4: not at all; a longer axis; no lobe; only the first finding. Every
eighth case has no image in its key, so that its findings are paired by similarity.
"""

from __future__ import annotations

import json
import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from recordgauge.functions import fields, slots, text
from recordgauge.operators import audits, bootstrap, decoder, matching
from recordgauge.plans import evaluator
from recordgauge.plans.catalogue import register
from recordgauge.session import spread, table

CONTEXT, NEW = 3000, 1000


def key() -> Column:
    return F.col("c_custkey")


def text_of(*parts: Column | str) -> Column:
    return F.concat(*[F.lit(p) if isinstance(p, str) else p.cast("string") for p in parts])


def finding(i: int, predicted: bool) -> Column:
    image = F.when(key() % 8 == 4, "null").otherwise((key() % 50 + i).cast("string"))
    axis = F.when((key() % 4 == 1) & F.lit(predicted), 8 + i).otherwise(5 + i)
    lobe = F.when((key() % 4 == 2) & F.lit(predicted), "").otherwise('"Lobe": "lingula", ')
    return text_of('{"Series ID": ', F.lit(i + 1), ', "Image ID": ', image, ", ", lobe, '"Long Axis (mm)": ', axis, ".5}")


def record(predicted: bool, changed: Column | None = None) -> Column:
    n = (key() % 3).cast("int")
    if predicted:
        n = F.when(key() % 4 == 3, F.least(n, F.lit(1))).otherwise(n)
    rads = F.when(key() % 2 == 0, "null").otherwise('"2"')
    if predicted:
        rads = F.when(key() % 6 == 3, '"4A"').otherwise(rads)
    found = F.when(n == 0, "").when(n == 1, finding(0, predicted)).otherwise(F.concat(finding(0, predicted), F.lit(", "), finding(1, predicted)))
    return text_of('{"Number of Nodules": ', n, ', "Nodules": [', found, '], "Overall Lung-RADS": ', rads, "}")


def dataset(spark: SparkSession, d: str, extra: str = "") -> DataFrame:
    """(id, instruction, input, output): the input is what the stub model says; every tenth prompt is too long."""
    long = F.when(key() % 10 == 9, F.repeat(F.lit("again and again "), F.lit(200))).otherwise("")
    return spread(table(spark, d, "customer").select("c_custkey")).select(key().alias("id"), F.concat(F.lit(f"Extract the record.{extra} "), long).alias("instruction"), record(True).alias("input"), record(False).alias("output"))


def stub(prompt: str) -> str:
    """A model that answers with the text after the blank line, between tags."""
    return f"<json>\n{prompt.split(chr(10) + chr(10), 1)[1]}\n</json>"


def letters(c: Column) -> Column:
    return F.char_length(c).cast("long")


#: By case: findings, predicted findings, right, wrong, missing and extra values of their fields.
SQL_CASES = """
    SELECT c_custkey AS id, c_custkey % 3 AS n, CASE WHEN c_custkey % 4 = 3 THEN least(c_custkey % 3, 1) ELSE c_custkey % 3 END AS p, CASE WHEN c_custkey % 8 = 4 THEN 3 ELSE 4 END AS w, c_custkey % 4 AS kind, c_custkey % 10 = 9 AS long, c_custkey AS k FROM customer"""
SQL_SCORES = f"""
    SELECT *, p * CASE kind WHEN 1 THEN 2 * (w - 1) + 1 WHEN 2 THEN 2 * (w - 1) ELSE 2 * w END::DOUBLE AS tp, CASE WHEN kind = 1 THEN p * 0.5 ELSE 0 END::DOUBLE AS fp, (CASE WHEN kind = 1 THEN p * 0.5 WHEN kind = 2 THEN p * 2 ELSE 0 END + (n - p) * 2 * w)::DOUBLE AS fn FROM ({SQL_CASES})"""


@register(
    "evaluator_main",
    f"""WITH s AS (SELECT * FROM ({SQL_SCORES}) WHERE NOT long) SELECT count(*) AS n, count(*) AS objects, sum(tp) AS tp, sum(fp) AS fp, sum(fn) AS fn, round(sum(tp) / (sum(tp) + sum(fp)), 6) AS precision, round(sum(tp) / (sum(tp) + sum(fn)), 6) AS recall, round(2 * sum(tp) / (2 * sum(tp) + sum(fp) + sum(fn)), 6) AS f1, round(sum(tp) / (sum(tp) + sum(fp) + sum(fn)), 6) AS iou, (SELECT count(*) FROM ({SQL_CASES}) WHERE long) AS skipped FROM s""",
)
def evaluator_main(spark: SparkSession, d: str) -> DataFrame:
    """Prompts, answers of a stub, recovery, normalisation, alignment, scores, the arm's summary."""
    s = evaluator.evaluate(dataset(spark, d), stub, CONTEXT, NEW, tokens=letters).summary
    return s.select("n", "objects", "tp", "fp", "fn", *[F.round(c, 6).alias(c) for c in ("precision", "recall", "f1", "iou")], "skipped")


@register("evaluator_cases", f"""SELECT id, tp, fp, fn, round(CASE WHEN n = 0 THEN 1 ELSE 2 * tp / (2 * tp + fp + fn) END, 6) AS f1, round(CASE WHEN n = 0 THEN 1 ELSE tp / (tp + fp + fn) END, 6) AS iou FROM ({SQL_SCORES})""")
def evaluator_cases(spark: SparkSession, d: str) -> DataFrame:
    """Every case's scores; a case without findings on either side is right."""
    x = dataset(spark, d).select("id", F.col("input").alias("prediction"), F.col("output").alias("gold"))
    return evaluator.casewise(x).select("id", "tp", "fp", "fn", F.round("f1", 6).alias("f1"), F.round("iou", 6).alias("iou"))


def _feature_sql(name: str, gold: str, pred: str, equal: str) -> str:
    """Scores of one feature from sums over cases: support, predicted, equal."""
    return f"SELECT '{name}' AS feature, CAST(sum({gold}) AS BIGINT) AS g, CAST(sum({equal}) AS BIGINT) AS t, CAST(sum({pred}) AS BIGINT) AS p FROM c"


SQL_FEATURES = f"""
    WITH c AS ({SQL_CASES}), f AS ({_feature_sql("Number of Nodules", "1", "1", "(n = p)::INT")}
    UNION ALL {_feature_sql("Overall Lung-RADS", "(k % 2 = 1)::INT", "(k % 2 = 1)::INT", "(k % 2 = 1 AND k % 6 <> 3)::INT")}
    UNION ALL {_feature_sql("Nodules.Series ID", "n", "p", "p")}
    UNION ALL {_feature_sql("Nodules.Image ID", "CASE WHEN k % 8 = 4 THEN 0 ELSE n END", "CASE WHEN k % 8 = 4 THEN 0 ELSE p END", "CASE WHEN k % 8 = 4 THEN 0 ELSE p END")}
    UNION ALL {_feature_sql("Nodules.Lobe", "n", "CASE WHEN kind = 2 THEN 0 ELSE p END", "CASE WHEN kind = 2 THEN 0 ELSE p END")}
    UNION ALL {_feature_sql("Nodules.Long Axis (mm)", "n", "p", "CASE WHEN kind = 1 THEN 0 ELSE p END")}
    UNION ALL SELECT unnest([{", ".join(repr(f) for f in evaluator.FEATURES if f not in ("Number of Nodules", "Overall Lung-RADS", "Nodules.Series ID", "Nodules.Image ID", "Nodules.Lobe", "Nodules.Long Axis (mm)"))}]), 0, 0, 0)
    SELECT feature, g AS gold_appearances, t AS "TP", p - t AS "FP", g - t AS "FN", round(coalesce(2 * t / nullif(g + p, 0), 0), 6) AS f1 FROM f"""


@register("evaluator_features", SQL_FEATURES)
def evaluator_features(spark: SparkSession, d: str) -> DataFrame:
    """Exact scores of all thirty features, those without events too."""
    x = dataset(spark, d).select("id", F.col("input").alias("prediction"), F.col("output").alias("gold"))
    return evaluator.feature_table(x).select("feature", "gold_appearances", "TP", "FP", "FN", F.round("f1", 6).alias("f1"))


@register(
    "assignment_by_similarity",
    """WITH t AS (SELECT conv_id, turn, role, text, row_number() OVER (PARTITION BY conv_id, text ORDER BY turn, role) AS rk, row_number() OVER (PARTITION BY conv_id ORDER BY turn, role) - 1 AS pos, count(*) OVER (PARTITION BY conv_id) AS n FROM conversations)
    SELECT conv_id, pos AS gold_pos, CASE WHEN turn % 5 <> 4 THEN n - 1 - pos END AS pred_pos FROM t WHERE rk = 1 AND (SELECT count(*) FROM t u WHERE u.conv_id = t.conv_id AND u.rk > 1) = 0""",
)
def assignment_by_similarity(spark: SparkSession, d: str) -> DataFrame:
    """Turns without keys against the same in reverse order, some missing: each finds itself, the rest stay unmatched."""
    x = audits.numbered(table(spark, d, "conversations"), ["turn", "role"], ["conv_id"])
    plain = x.groupBy("conv_id").agg(F.count("*").alias("n"), F.count_distinct("text").alias("kinds")).filter("n = kinds").drop("kinds")
    x = x.join(plain, "conv_id").withColumn("key", F.lit(None).cast("long"))
    gold = x.select("conv_id", "pos", "key", F.sha2("text", 256).alias("digest"))
    pred = x.filter("turn % 5 <> 4").select("conv_id", (F.col("n") - 1 - F.col("pos")).alias("pos"), "key", F.sha2("text", 256).alias("digest"))
    m = matching.align(gold, pred, ["conv_id"], ["key"], "pos", lambda g, p: matching.weighted_similarity([(g("digest").isNotNull(), g("digest").eqNullSafe(p("digest")), 1.0)]))
    left = matching.unmatched(gold, m, ["conv_id"], "pos", "gold_pos").select("conv_id", F.col("pos").alias("gold_pos"), F.lit(None).cast("long").alias("pred_pos"))
    return m.select("conv_id", "gold_pos", "pred_pos").unionByName(left)


def saved_cases(spark: SparkSession, d: str, regime: int = 0) -> DataFrame:
    """Cases as an earlier run saved them: predictions not yet normalised, some scores stale."""
    raw = F.when(key() % 7 == regime, F.lit("no record")).otherwise(F.concat(F.lit("so: "), record(True)))
    stale = F.when(key() % 5 == 0, 1.0).otherwise(0.0)
    gone = key() % 7 == regime
    x = spread(table(spark, d, "customer").select("c_custkey")).select(key().alias("id"), raw.alias("raw"), record(False).alias("gold"), F.when(key() % 2 == 0, "{}").otherwise("x").alias("prediction"), letters(raw).alias("prompt_tokens"), F.lit(5).cast("long").alias("completion_tokens"), "c_custkey")
    n, p, w, kind = key() % 3, F.when(key() % 4 == 3, F.least(key() % 3, F.lit(1))).otherwise(key() % 3), F.when(key() % 8 == 4, 3).otherwise(4), key() % 4
    tp = F.when(gone, 0.0).otherwise(p * F.when(kind == 1, 2 * (w - 1) + 1).when(kind == 2, 2 * (w - 1)).otherwise(2 * w)).cast("double")
    fp = F.when(gone | (kind != 1), 0.0).otherwise(p * 0.5).cast("double")
    fn = F.when(gone, n * 2 * w).otherwise(F.when(kind == 1, p * 0.5).when(kind == 2, p * 2).otherwise(0) + (n - p) * 2 * w).cast("double")
    return x.withColumns({"tp": tp + stale, "fp": fp, "fn": fn}).drop("c_custkey")


def _sql_regime(r: int) -> str:
    return f"SELECT id, n, k, CASE WHEN k % 7 = {r} THEN 0 ELSE tp END AS tp, CASE WHEN k % 7 = {r} THEN 0 ELSE fp END AS fp, CASE WHEN k % 7 = {r} THEN n * 2 * w ELSE fn END AS fn FROM ({SQL_SCORES})"


@register("rescore_changes", """SELECT count(*) AS cases, count(*) - count_if(c_custkey % 7 = 0 AND c_custkey % 2 = 0) - count_if(c_custkey % 7 <> 0 AND c_custkey % 2 = 0 AND c_custkey % 3 = 0 AND c_custkey % 6 <> 3) AS changed_predictions, count_if(c_custkey % 5 = 0) AS changed_metrics FROM customer""")
def rescore_changes(spark: SparkSession, d: str) -> DataFrame:
    """Predictions and scores rebuilt from the raw texts beside the saved ones, which stay."""
    return evaluator.rescore_counts(evaluator.rescored(saved_cases(spark, d)))


REGIME = {"sparse": 0, "dense": 1, "constrained": 2}
_F1 = "2 * sum(tp) / (2 * sum(tp) + sum(fp) + sum(fn))"


@register(
    "regime_comparison",
    "WITH " + ", ".join(f"{name} AS (SELECT {_F1} AS f1 FROM ({_sql_regime(r)}))" for name, r in REGIME.items()) + """
    SELECT 'm' AS model, round(sparse.f1, 6) AS sparse, round(dense.f1, 6) AS dense, round(constrained.f1, 6) AS constrained, round(dense.f1 - sparse.f1, 6) AS prompt_effect, round(constrained.f1 - dense.f1, 6) AS constraint_effect, round(constrained.f1 - sparse.f1, 6) AS end_to_end_effect FROM sparse, dense, constrained""",
)
def regime_comparison(spark: SparkSession, d: str) -> DataFrame:
    """Three regimes rescored, summarised and compared."""
    out = evaluator.compare_regimes({("m", name): saved_cases(spark, d, r) for name, r in REGIME.items()}, features=False)
    return out["effects"].select("model", *[F.round(c, 6).alias(c) for c in out["effects"].columns if c != "model"])


def _sql_feature_f1(r: int) -> str:
    """F1 of two features in a regime whose answers are lost where k % 7 = r."""
    return f"""SELECT 'Nodules.Series ID' AS feature, 2 * sum(CASE WHEN k % 7 = {r} THEN 0 ELSE p END) / (sum(n) + sum(CASE WHEN k % 7 = {r} THEN 0 ELSE p END)) AS f1 FROM c
    UNION ALL SELECT 'Nodules.Lobe', 2 * sum(CASE WHEN k % 7 = {r} OR kind = 2 THEN 0 ELSE p END) / (sum(n) + sum(CASE WHEN k % 7 = {r} OR kind = 2 THEN 0 ELSE p END)) FROM c"""


@register(
    "regime_consolidation",
    f"""WITH c AS ({SQL_CASES}), s AS ({_sql_feature_f1(0)}), e AS ({_sql_feature_f1(1)}) SELECT feature, round(s.f1, 6) AS "sparse | m", round(e.f1, 6) AS "dense | m", round((s.f1 + e.f1) / 2, 6) AS mean FROM s JOIN e USING (feature)""",
)
def regime_consolidation(spark: SparkSession, d: str) -> DataFrame:
    """Behind a gate, the feature tables of all arms side by side; two features are shown."""
    arms = {("m", "sparse"): saved_cases(spark, d, 0), ("m", "dense"): saved_cases(spark, d, 1)}
    fresh = {k: evaluator.rescored(v) for k, v in arms.items()}
    gate = spark.createDataFrame([("m", True)], "model string, accepted boolean")
    wide = evaluator.consolidate(fresh, gate, method="exact")["wide"].filter(F.col("feature").isin("Nodules.Series ID", "Nodules.Lobe"))
    return wide.select("feature", *[F.round(F.col(f"`{c}`"), 6).alias(c) for c in wide.columns if c != "feature"])


@register(
    "controlled_pair",
    f"""WITH k AS (SELECT * FROM ({SQL_CASES}) WHERE NOT long) SELECT true AS reproducible, 0::BIGINT AS missing, 0::BIGINT AS mismatched, '' AS differing, count_if(k % 21 = 0) = 0 AS outputs_valid, count_if(k % 21 = 0) = 0 AS accepted, count_if(n > 0) + count_if(n = 0 AND k % 21 = 0) AS changed FROM k""",
)
def controlled_pair(spark: SparkSession, d: str) -> DataFrame:
    """An ordinary arm, its repeat and a constrained arm, and the audit that accepts or refuses the pair."""

    def constrained(prompt: str) -> str:
        said = prompt.split("\n\n", 1)[1]
        return "broken" if '"marker": 1' in said else stub(prompt.replace("lingula", "left lower lobe").replace('"Long Axis (mm)": 5', '"Long Axis (mm)": 6').replace('"Long Axis (mm)": 8', '"Long Axis (mm)": 9'))

    x = dataset(spark, d).withColumn("input", F.when(F.col("id") % 21 == 0, F.concat(F.lit('{"marker": 1, '), F.substring("input", F.lit(2), F.char_length("input")))).otherwise(F.col("input")))
    out = evaluator.controlled_pair(x, stub, constrained, CONTEXT, NEW, tokens=letters)
    a = out["audit"].select("reproducible", "missing", "mismatched", F.array_join("differing_fields", ",").alias("differing"), "outputs_valid", "accepted")
    return a.join(out["changes"].select(F.col("differs_raw").alias("changed")))  # one row each


@register("dataset_gate", """SELECT true AS refused_shared, true AS refused_content, count(*) AS records, count(*) AS dense_policy FROM customer""")
def dataset_gate(spark: SparkSession, d: str) -> DataFrame:
    """The dense pair runs behind the audit of its two datasets; pairs that share instructions or differ in content are refused."""
    sparse_marks, dense_marks = " ".join(fields.SPARSE_MARKS), " ".join(fields.DENSE_MARKS)
    x = audits.numbered(dataset(spark, d), ["id"])
    sparse, dense = x.withColumn("instruction", F.lit(sparse_marks)), x.withColumn("instruction", F.lit(dense_marks))
    refused = []
    for bad in (sparse, dense.withColumn("output", F.when(F.col("id") == 1, "{}").otherwise(F.col("output")))):
        try:
            evaluator.dense_pair(sparse, bad, stub, stub, CONTEXT, NEW)
            refused.append(False)
        except ValueError:
            refused.append(True)
    row = evaluator.dense_pair(sparse, dense, stub, stub, CONTEXT, NEW)["datasets"]
    return row.select(F.lit(refused[0]).alias("refused_shared"), F.lit(refused[1]).alias("refused_content"), "records", "dense_policy")


@register("bootstrap_published")
def bootstrap_published(spark: SparkSession, d: str) -> DataFrame:
    """Intervals of two arms and their contrast, with the published generator, order and seed; 2,000 replicates."""
    fresh = {("m", name): evaluator.rescored(saved_cases(spark, d, r)) for name, r in (("sparse", 0), ("dense", 1))}
    return evaluator.intervals(fresh, {"dense_minus_sparse": ("sparse", "dense")}, iterations=2000)


@register(
    "bootstrap_points",
    f"""WITH a AS (SELECT 'sparse' AS config, * FROM ({_sql_regime(0)}) UNION ALL SELECT 'dense', * FROM ({_sql_regime(1)})), c AS ({SQL_CASES}),
    f AS (SELECT r.config, sum(CASE WHEN k % 7 <> r.lost AND n = p AND n > 0 THEN 1 ELSE 0 END) AS t_count, sum(CASE WHEN k % 7 <> r.lost AND p > 0 THEN 1 ELSE 0 END) AS p_count, sum(CASE WHEN n > 0 THEN 1 ELSE 0 END) AS g_count FROM c, (SELECT 'sparse' AS config, 0 AS lost UNION ALL SELECT 'dense', 1) r GROUP BY r.config)
    SELECT config, 'feature_f1' AS metric, 'Number of Nodules' AS feature, round(2 * t_count / (p_count + g_count), 6) AS point FROM f""",
)
def bootstrap_points(spark: SparkSession, d: str) -> DataFrame:
    """The point estimates behind the intervals, one feature shown."""
    fresh = {("m", name): evaluator.rescored(saved_cases(spark, d, r)) for name, r in (("sparse", 0), ("dense", 1))}
    out = evaluator.intervals(fresh, {}, iterations=10)
    return out.filter("metric = 'feature_f1' and feature = 'Number of Nodules'").select("config", "metric", "feature", F.round("point", 6).alias("point"))


@register(
    "poisson_bootstrap",
    """SELECT true AS mean_close, true AS spread_close, 400::BIGINT AS replicates FROM (SELECT 1)""",
)
def poisson_bootstrap(spark: SparkSession, d: str) -> DataFrame:
    """R1, R3 at any size: independent weights give totals of the right mean and spread (within 2 and 20 percent)."""
    x = table(spark, d, "documents").select(F.col("doc_id").alias("idx"), *[(F.col("doc_id") % (k + 2) == 0).cast("long").alias(c) for k, c in enumerate(("TP", "FP", "FN"))])
    truth = x.agg(F.sum("TP").alias("total"))
    t = bootstrap.poisson_totals(x, 400).agg(F.avg("TP").alias("mean"), F.stddev("TP").alias("sd"), F.count("*").alias("replicates"))
    both = t.join(truth)  # one row each
    return both.select((F.abs(F.col("mean") / F.col("total") - 1) < 0.02).alias("mean_close"), (F.abs(F.col("sd") / F.sqrt("total") - 1) < 0.2).alias("spread_close"), "replicates")


# --- the decoder ------------------------------------------------------------------------


def template_places(n: int) -> list[tuple[str, int, int]]:
    """(slot, first, end) of the words of a template whose slots read 'null' but the count, in the rendered text: from the text alone."""
    out, at, seen, done = [], 0, {}, ""
    for piece in re.split(r"(<\|[a-z0-9_]+\|>)", slots.template_text(n)):
        if piece.startswith("<|"):
            key = fields.KEY_OF_MARKER[piece[2:-2]]
            word = str(n) if key == "Number of Nodules" else "null"
            if key in fields.FINDING_FIELDS:
                seen[key] = seen.get(key, -1) + 1
                key = f"Nodule[{seen[key]}].{key}"
            out.append((key, at, at + len(word)))
            at, done = at + len(word), done + word
        else:
            at, done = at + len(piece), done + piece
    return [*out, ("", at, at)]


_PLACES = template_places(2)
_SQL_PLACES = "VALUES " + ", ".join(f"('{s}', {a}, {b})" for s, a, b in _PLACES[:-1])
_LENGTH = _PLACES[-1][1]


@register(
    "decoder_replay",
    f"""WITH p(slot, a, b) AS ({_SQL_PLACES}), x AS (SELECT s_suppkey, s_suppkey * 37 % {_LENGTH + 1} AS n FROM supplier)
    SELECT s_suppkey, n = {_LENGTH} AS complete, CASE WHEN n > {_PLACES[0][2]} THEN 2 END AS count, CASE WHEN n = {_LENGTH} THEN 'complete' WHEN p.slot IS NULL OR n = p.b THEN 'fixed' ELSE 'candidate' END AS action, p.slot AS slot, NULL::VARCHAR AS error FROM x LEFT JOIN p ON n BETWEEN p.a AND p.b""",
)
def decoder_replay(spark: SparkSession, d: str) -> DataFrame:
    """Token paths of a template cut anywhere: the count seen, the open slot, what kind of step comes next."""
    tok = decoder.CharacterTokenizer()
    path = decoder.Runtime(tok).render(2)
    x = table(spark, d, "supplier").select("s_suppkey", F.slice(F.array(*[F.lit(t) for t in path]), F.lit(1), (F.col("s_suppkey") * 37 % (len(path) + 1)).cast("int")).alias("tokens"))
    done = decoder.replay_column(x, "tokens", tok)
    return done.select("s_suppkey", "complete", "count", "action", "slot", "error")


@register(
    "decoder_render",
    """SELECT n::INT AS n, sha256(t) AS sha, length(t) AS tokens FROM (VALUES """ + ", ".join(f"({n}, '{slots.MARK.sub('null', slots.template_text(n, tags=True).replace('<|num_nodule|>', str(n)))}')" for n in (0, 1, 3)) + ") v(n, t)",
)
def decoder_render(spark: SparkSession, d: str) -> DataFrame:
    """Legal token paths of templates, decoded, replay to their end."""
    import hashlib

    tok, rows = decoder.CharacterTokenizer(), []
    for n in (0, 1, 3):
        runtime = decoder.cached_runtime(tok, tags=True)
        path = runtime.render(n)
        if runtime.action(runtime.replay(path)).kind != "complete":
            raise AssertionError(n)
        said = tok.decode(path)
        rows.append((n, hashlib.sha256(said.encode()).hexdigest(), len(path)))
    return spark.createDataFrame(rows, "n int, sha string, tokens long")


@register(
    "decoder_trace",
    f"""WITH p(slot, a, b) AS ({_SQL_PLACES}) SELECT CAST(row_number() OVER (ORDER BY a) - 1 AS INT) AS pos, slot, CASE WHEN a = {_PLACES[0][1]} THEN '2' ELSE 'null' END AS value, CASE WHEN a = {_PLACES[0][1]} THEN 2 END AS expanded_to FROM p""",
)
def decoder_trace(spark: SparkSession, d: str) -> DataFrame:
    """The slots passed, in order, with the occurrence of each finding's marker and the expansion by the count."""
    runtime = decoder.Runtime(decoder.CharacterTokenizer())
    rows = [(t["pos"], t["slot"], t["value"], t["expanded_to"]) for t in runtime.trace(runtime.render(2))]
    return spark.createDataFrame(rows, "pos int, slot string, value string, expanded_to int")


_LOBES = sorted((*fields.CATEGORIES["lobe"], "null"))
_SQL_WORDS = ", ".join(f"('{w}')" for w in _LOBES)


@register(
    "decoder_candidates",
    f"""WITH w(word) AS (VALUES {_SQL_WORDS}), p AS (SELECT DISTINCT substr(word, 1, i) AS prefix FROM w, range(0, 20) r(i) WHERE i <= length(word)),
    n AS (SELECT prefix, substr(word, length(prefix) + 1, 1) AS c FROM p JOIN w ON starts_with(word, prefix))
    SELECT prefix, string_agg(DISTINCT CASE WHEN c = '' THEN '"' ELSE c END, '' ORDER BY CASE WHEN c = '' THEN '"' ELSE c END) AS allowed FROM n GROUP BY prefix""",
)
def decoder_candidates(spark: SparkSession, d: str) -> DataFrame:
    """What may follow each prefix of a lobe, terminator included."""
    tok = decoder.CharacterTokenizer()
    runtime = decoder.Runtime(tok)
    slot = next(x for x in runtime.program(1) if isinstance(x, decoder.Slot) and x.marker == "lobe")
    prefixes = sorted({w[:i] for w in _LOBES for i in range(len(w) + 1)})
    rows = [(p, "".join(sorted(tok.decode([t]) for t in runtime.allowed(slot, tuple(tok.encode(p)))))) for p in prefixes]
    return spark.createDataFrame(rows, "prefix string, allowed string")


@register(
    "decoder_audit",
    """SELECT unnest([0, 1, 2]) AS n, unnest([5, 30, 55])::INT AS slots, true AS replays, true AS markers_unique, true AS over_cap_refused, true AS bad_sampling_refused""",
)
def decoder_audit(spark: SparkSession, d: str) -> DataFrame:
    """Slots of the programs of 0, 1 and 2, unique markers as single tokens, caps and parameters checked."""
    marked = decoder.MarkedTokenizer(decoder.CharacterTokenizer())
    unique = marked.audit()
    got = decoder.Runtime(decoder.CharacterTokenizer()).audit()
    refused = []
    for act in (lambda: decoder.Runtime(decoder.CharacterTokenizer()).program(fields.MAX_FINDINGS + 1), lambda: decoder.Sampling(top_p=0)):
        try:
            act()
            refused.append(False)
        except ValueError:
            refused.append(True)
    rows = [(n, got[f"slots_{n}"], got[f"replays_{n}"], unique["unique"] and unique["single"], *refused) for n in (0, 1, 2)]
    return spark.createDataFrame(rows, "n int, slots int, replays boolean, markers_unique boolean, over_cap_refused boolean, bad_sampling_refused boolean")


@register(
    "decoder_sampling",
    """WITH l AS (SELECT vec_id, unnest(embedding)::DOUBLE AS logit, unnest(range(len(embedding))) AS tok FROM embeddings), k AS (SELECT * FROM l WHERE tok % 3 <> 0), p AS (SELECT vec_id, tok, CASE WHEN tok % 2 = 0 THEN CASE WHEN logit > 0 THEN logit / 1.5 ELSE logit * 1.5 END - 0.25 ELSE logit END AS x FROM k)
    SELECT vec_id, CAST(first(tok ORDER BY x DESC, tok) AS INT) AS chosen FROM p GROUP BY vec_id""",
)
def decoder_sampling(spark: SparkSession, d: str) -> DataFrame:
    """Penalties, temperature and truncation inside the legal set, then the greatest; one choice a vector."""
    sampling = decoder.Sampling(temperature=0.7, top_p=0.9, min_p=0.1, repetition=1.5, frequency=0.2, presence=0.05)
    x = table(spark, d, "embeddings").select("vec_id", "embedding", F.filter(F.sequence(F.lit(0), F.size("embedding") - 1), lambda t: t % 3 != 0).alias("allowed"))
    x = x.withColumn("history", F.filter("allowed", lambda t: t % 2 == 0))
    return decoder.choose_column(x, "embedding", "allowed", "history", sampling).select("vec_id", "chosen")


@register("native_text_functions", """SELECT n_nationkey, (n_nationkey % 3 = 0) AS is_null, n_nationkey / nullif(n_regionkey, 0) AS ratio, '{"a":' || n_nationkey || '}' AS parsed, CASE WHEN n_nationkey % 2 = 0 THEN 'day' ELSE 'month' END AS precision, n_nationkey % 2 = 0 AS same, n_nationkey % 2 = 0 AS valid FROM nation""")
def native_text_functions(spark: SparkSession, d: str) -> DataFrame:
    """§2.19: the engine's functions by name in SQL."""
    from recordgauge.functions import registry

    registry.register(spark)
    table(spark, d, "nation").createOrReplaceTempView("recordgauge_nation")
    return spark.sql("""
        SELECT n_nationkey, semantic_is_null(CASE WHEN n_nationkey % 3 = 0 THEN ' None ' ELSE 'x' END) AS is_null, nullif(safe_div(n_nationkey, n_regionkey), CASE WHEN n_regionkey = 0 THEN 0D END) AS ratio,
          parse_object('so: {"a": ' || n_nationkey || '} ok') AS parsed, date_key(CASE WHEN n_nationkey % 2 = 0 THEN '3/4/22' ELSE '3/2022' END).precision AS precision,
          values_equal('1.005', CASE WHEN n_nationkey % 2 = 0 THEN ' 1.01 ' ELSE '1.1' END) AS same,
          validate_schema('{"Number of Nodules": ' || CASE WHEN n_nationkey % 2 = 0 THEN '1' ELSE '"x"' END || '}').valid AS valid FROM recordgauge_nation""")


@register(
    "matched_records",
    """SELECT n_regionkey, n_nationkey AS gold_id, n_nationkey AS pred_id FROM nation WHERE n_nationkey % 4 <> 1""",
)
def matched_records(spark: SparkSession, d: str) -> DataFrame:
    """§2.19: the grouped match of records as a table function in SQL."""
    from recordgauge.functions import registry

    registry.register(spark)
    x = table(spark, d, "nation")
    each = x.select("n_regionkey", "n_nationkey", F.to_json(F.struct(F.col("n_nationkey").alias("Series ID"), F.lit(1).alias("Image ID"), F.lit("lingula").alias("Lobe"))).alias("r"))
    every = each.groupBy("n_regionkey").agg(F.sort_array(F.collect_list(F.struct("n_nationkey", "r"))).alias("g"))
    every = every.withColumn("p", F.reverse(F.filter("g", lambda e: e["n_nationkey"] % 4 != 1)))
    every.select("n_regionkey", F.transform("g", lambda e: e["r"]).alias("gold"), F.transform("p", lambda e: e["r"]).alias("pred"), F.transform("g", lambda e: e["n_nationkey"]).alias("gk"), F.transform("p", lambda e: e["n_nationkey"]).alias("pk")).createOrReplaceTempView("recordgauge_records")
    return spark.sql("SELECT n_regionkey, gk[m.gold_pos] AS gold_id, pk[m.pred_pos] AS pred_id FROM recordgauge_records, LATERAL assign_records(gold, pred) m WHERE m.similarity >= 0.9")
