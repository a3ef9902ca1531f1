"""Queries over readers, sinks and report texts: written to the shared folder, read back, compared with SQL."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from recordgauge.functions import fields
from recordgauge.operators import generation, reports
from recordgauge.plans.catalogue import label_events, arm_features, register
from recordgauge.session import scratch, table
from recordgauge.sources import readers, sinks


def nations(spark: SparkSession, d: str) -> list[dict]:
    """A small table as plain rows, in order."""
    return [r.asDict() for r in table(spark, d, "nation").orderBy("n_nationkey").collect()]  # 25 rows


@register("read_record_list", """SELECT row_number() OVER (ORDER BY n_nationkey) - 1 AS pos, n_nationkey, n_name, 25 AS listed FROM nation""")
def read_record_list(spark: SparkSession, d: str) -> DataFrame:
    """A JSON array file as rows in order."""
    path = f"{scratch(spark)}/nations.json"
    sinks.put_json(spark, nations(spark, d), path)
    readers.require(spark, path, nonempty=True)
    rows = readers.records(spark, path)
    n = rows.agg(F.count("*").cast("int").alias("listed"))
    return rows.select(F.col("pos").cast("long").alias("pos"), F.from_json("value", "n_nationkey int, n_name string").alias("x")).select("pos", "x.*").join(n)  # one row


@register("read_refusals", """SELECT unnest(['an object file', 'empty list', 'list of numbers', 'missing', 'empty file', 'unknown format', 'format not allowed', 'repeated feature', 'no rows for csv', 'replace refused']) AS what, unnest([false, true, true, true, true, true, true, true, true, true]) AS refused""")
def read_refusals(spark: SparkSession, d: str) -> DataFrame:
    """What readers and sinks must refuse."""
    root = scratch(spark)
    for name, text in (("object", '{"a": 1}'), ("none", "[]"), ("numbers", "[1, 2]"), ("empty", "")):
        sinks.put_text(spark, text, f"{root}/{name}.json")
    feature = spark.createDataFrame([("a", 1, 1, 0, 0, 1.0, 1.0, 1.0)] * 2, "feature string, gold_appearances long, TP long, FP long, FN long, precision double, recall double, f1 double")
    tried = {
        "an object file": lambda: readers.whole_json(spark, f"{root}/object.json").count(),
        "empty list": lambda: readers.records(spark, f"{root}/none.json"),
        "list of numbers": lambda: readers.records(spark, f"{root}/numbers.json"),
        "missing": lambda: readers.require(spark, f"{root}/absent.json"),
        "empty file": lambda: readers.require(spark, f"{root}/empty.json", nonempty=True),
        "unknown format": lambda: readers.dataset(spark, f"{root}/x.xml"),
        "format not allowed": lambda: readers.dataset(spark, f"{root}/x.jsonl", allowed=("json", "csv", "parquet")),
        "repeated feature": lambda: readers.feature_rows(feature),
        "no rows for csv": lambda: sinks.write_csv(feature.limit(0), f"{root}/out.csv"),
        "replace refused": lambda: sinks.put_text(spark, "x", f"{root}/object.json", replace=False),
    }
    rows = []
    for what, act in tried.items():
        try:
            act()
            rows.append((what, False))
        except (ValueError, OSError):
            rows.append((what, True))
    return spark.createDataFrame(rows, "what string, refused boolean")


@register(
    "read_formats",
    """WITH f AS (SELECT * FROM customer ORDER BY c_custkey LIMIT 100) SELECT format, count(*) AS n, CAST(sum(c_custkey) AS BIGINT) AS keys, round(sum(c_acctbal), 6) AS balance, min(c_name) AS least FROM f, (SELECT unnest(['json', 'jsonl', 'csv', 'parquet']) AS format) GROUP BY format""",
)
def read_formats(spark: SparkSession, d: str) -> DataFrame:
    """The first hundred customers, written and read in four formats."""
    root, schema = scratch(spark), "c_custkey long, c_name string, c_acctbal double"
    x = readers.first(table(spark, d, "customer").select("c_custkey", "c_name", "c_acctbal"), 100, "c_custkey")
    sinks.write_json(x, f"{root}/c.jsonl")
    sinks.write_csv(x, f"{root}/c.csv")
    x.write.parquet(f"{root}/c.parquet")
    sinks.put_json(spark, sinks.small_rows(x), f"{root}/c.json")
    out = None
    for ending in ("json", "jsonl", "csv", "parquet"):
        path = f"{root}/c.{ending}"
        df = readers.csv(spark, path, schema) if ending == "csv" else readers.dataset(spark, path, schema)
        part = df.agg(F.count("*").alias("n"), F.sum("c_custkey").alias("keys"), F.round(F.sum("c_acctbal"), 6).alias("balance"), F.min("c_name").alias("least")).withColumn("format", F.lit(ending))
        out = part if out is None else out.unionByName(part)
    return out


@register(
    "read_arms",
    """SELECT 'm' || n_regionkey AS model, c.config, count(*) AS n, CAST(sum(n_nationkey) AS BIGINT) AS keys, 'm' || n_regionkey AS folder FROM nation, (SELECT unnest(['a', 'b']) AS config) c GROUP BY ALL""",
)
def read_arms(spark: SparkSession, d: str) -> DataFrame:
    """Files by model and configuration, the model from the folder's name."""
    root, rows = scratch(spark), nations(spark, d)
    models = sorted({f"m{r['n_regionkey']}" for r in rows})
    for m in models:
        own = [r for r in rows if f"m{r['n_regionkey']}" == m]
        for config in "ab":
            sinks.put_json(spark, own, f"{root}/{m}/{config}.json")
    schema = "n_nationkey long, n_name string, n_regionkey int"
    every = readers.matrix(spark, {c: f"{root}/{{model}}/{c}.json" for c in "ab"}, models, schema)
    folder = readers.by_directory(spark, root, "a.json", schema).select(F.col("model").alias("folder")).distinct()
    by = every.groupBy("model", "config").agg(F.count("*").alias("n"), F.sum("n_nationkey").alias("keys"))
    return by.join(folder, by["model"] == folder["folder"], "left")


@register(
    "read_feature_rows",
    """SELECT source AS feature, CAST(sum(quality = 1) AS BIGINT) AS gold_appearances, CAST(sum(CASE WHEN quality = 1 AND toxic = 1 THEN 1 ELSE 0 END) AS BIGINT) AS "TP" FROM documents JOIN labels USING (doc_id) GROUP BY source""",
)
def read_feature_rows(spark: SparkSession, d: str) -> DataFrame:
    """A feature table written as CSV with fixed decimals and read back with strict types."""
    path = f"{scratch(spark)}/features.csv"
    rows = arm_features(label_events(spark, d), "a", ["feature"])
    sinks.write_csv(sinks.fixed_decimals(rows), path)
    return readers.feature_rows(spark.read.option("header", True).csv(path)).select("feature", "gold_appearances", "TP")


@register("read_schema", """SELECT unnest(['Findings.Lobe', 'Findings.Size.mm', 'Overall']) AS feature, unnest([0, 1, 2])::INT AS place""")
def read_schema(spark: SparkSession, d: str) -> DataFrame:
    """A schema file, its section unwrapped, lists by their first element, its leaves."""
    leaf = {"data_type": "text", "values": ["x"]}
    path = f"{scratch(spark)}/schema.json"
    sinks.put_json(spark, {"Lungs Pleura": {"Findings": [{"Lobe": leaf, "Size": {"mm": leaf}, "note": "no leaf"}], "Overall": leaf}}, path)
    found = readers.schema_leaves(readers.load_schema(spark, path))
    return spark.createDataFrame([(f, k) for k, f in enumerate(found)], "feature string, place int")


@register(
    "write_csv_lines",
    """SELECT 'n_nationkey,n_name,share,none' AS line, CAST(1 AS BIGINT) AS n UNION ALL SELECT n_nationkey || ',' || n_name || ',' || printf('%.10f', n_nationkey / 7.0) || ',""', 1 FROM nation""",
)
def write_csv_lines(spark: SparkSession, d: str) -> DataFrame:
    """K1, K5: the lines of a CSV file: a header, fixed decimals."""
    path = f"{scratch(spark)}/n.csv"
    x = table(spark, d, "nation").select("n_nationkey", "n_name", (F.col("n_nationkey").cast("double") / 7).alias("share"), F.lit("").alias("none"))
    sinks.write_csv(sinks.fixed_decimals(x.coalesce(1)), path)
    return spark.read.text(path).select(F.col("value").alias("line")).groupBy("line").agg(F.count("*").alias("n"))


@register(
    "write_json_array",
    """SELECT '[' || chr(10) || string_agg('  {' || chr(10) || '    "r_regionkey": ' || r_regionkey || ',' || chr(10) || '    "r_name": "' || r_name || '"' || chr(10) || '  }', ',' || chr(10) ORDER BY r_regionkey) || chr(10) || ']' AS text, true AS backed_up, false AS again, true AS kept FROM region""",
)
def write_json_array(spark: SparkSession, d: str) -> DataFrame:
    """K2-K4: an indented JSON array, a backup once, a replacement that leaves the backup."""
    path = f"{scratch(spark)}/r.json"
    rows = sinks.small_rows(table(spark, d, "region").select("r_regionkey", "r_name").orderBy("r_regionkey"))
    sinks.put_text(spark, "before", path)
    first, again = sinks.put_backup(spark, path), sinks.put_backup(spark, path)
    sinks.put_json(spark, rows, path)
    text = spark.read.text(path, wholetext=True).select(F.col("value").alias("text"))
    kept = spark.read.text(f"{path}.bak", wholetext=True).select((F.col("value") == "before").alias("kept"))
    return text.withColumns({"backed_up": F.lit(first), "again": F.lit(again)}).join(kept)  # one row each


@register(
    "write_workbook",
    """SELECT 'long' AS sheet, CAST(n_nationkey + 1 AS INT) AS row, n_nationkey || '|' || n_name AS cells FROM nation UNION ALL SELECT 'by region and a name that is lo', CAST(r_regionkey + 1 AS INT), r_regionkey || '|' || r_name FROM region""",
)
def write_workbook(spark: SparkSession, d: str) -> DataFrame:
    """K6: a workbook of two sheets, a long name cut to 31 characters."""
    path = f"{scratch(spark)}/book.xlsx"
    a = table(spark, d, "nation").select("n_nationkey", "n_name").orderBy("n_nationkey")
    b = table(spark, d, "region").select("r_regionkey", "r_name").orderBy("r_regionkey")
    sinks.write_sheets({"long": a, "by region and a name that is longer than allowed": b}, path)
    raw = bytes(spark.read.format("binaryFile").load(path).first()["content"])
    rows = [(sheet, k, "|".join(c or "" for c in cells)) for sheet, lines in sinks.read_workbook(raw).items() for k, cells in enumerate(lines) if k]
    return spark.createDataFrame(rows, "sheet string, row int, cells string")


@register(
    "report_texts",
    """SELECT 'markdown' AS what, '| r_regionkey | r_name |' || chr(10) || '| --- | --- |' || chr(10) || string_agg('| ' || r_regionkey || ' | ' || r_name || ' |', chr(10) ORDER BY r_regionkey) AS text FROM region
    UNION ALL SELECT 'csv', '=== regions ===' || chr(10) || 'r_regionkey,r_name' || chr(10) || string_agg(r_regionkey || ',' || r_name || chr(10), '' ORDER BY r_regionkey) FROM region
    UNION ALL SELECT 'manifest', '{"rows":' || count(*) || ',"seed":"7","method":"by hand"}' FROM region
    UNION ALL SELECT 'path', '/data/set_dense.json' UNION ALL SELECT 'path kept', '/out/set_dense.json'""",
)
def report_texts(spark: SparkSession, d: str) -> DataFrame:
    """A Markdown table, a titled CSV block, a manifest, derived paths."""
    x = table(spark, d, "region").select("r_regionkey", "r_name").orderBy("r_regionkey")
    rows = [("markdown", reports.markdown(x)), ("csv", sinks.csv_block(x, "regions")), ("manifest", reports.manifest(x, seed="7", method="by hand").first()[0]), ("path", sinks.dense_path("/data/set.json")), ("path kept", sinks.dense_path("/data/set_dense.json", "/out"))]
    return spark.createDataFrame(rows, "what string, text string")


def _ci(v: str) -> str:
    return f"printf('%.3f (%.3f, %.3f)', {v}, {v} - 0.125, {v} + 0.25)"


def _delta(v: str) -> str:
    return f"printf('%+.2f (%+.2f, %+.2f)', 100 * ({v}), 100 * ({v} - 0.125), 100 * ({v} + 0.25))"


@register(
    "table_fragments",
    rf"""WITH n AS (SELECT *, n_nationkey / 32.0 AS v FROM nation)
    SELECT n_name AS model, n_name || ' & ' || {_ci('v')} || ' & ' || {_ci('v + 0.5')} || ' & ' || {_delta('-v')} || ' & ' || printf('%,d', 4000) || ' & ' || printf('%,d', 1000 + n_nationkey) || ' & ' || printf('%.1f', 100 * (1 - (1000 + n_nationkey) / 4000.0)) || '\% \\' AS adaptation,
      n_name || ' & ' || {_ci('v')} || ' & ' || {_ci('v + 0.5')} || ' & ' || {_ci('v + 1')} || ' & ' || {_delta('v')} || ' \\' AS constraint,
      n_name || ' & ' || printf('%.1f', n_nationkey + 0.25) || '\% & 50.0\% & 100.0\% & ' || n_nationkey || '/250 & 250/250 & ' || {_ci('v + 0.5')} || ' & ' || {_ci('v')} || ' & ' || {_delta('v')} || ' \\' AS grammar FROM n""".replace("{{", "{"),
)
def table_fragments(spark: SparkSession, d: str) -> DataFrame:
    """K8: rows of the three main tables."""
    k = F.col("n_nationkey")
    v = k.cast("double") / 32
    values = {"base": v, "sft": v + 0.5, "dense": v + 0.5, "dynamic": v + 1, "grammar": v}
    changes = {"sft_delta": -v, "constraint_delta": v, "grammar_delta": v}
    cols = [c for name, x in values.items() for c in (x.alias(f"{name}_f1"), (x - 0.125).alias(f"{name}_low"), (x + 0.25).alias(f"{name}_high"))]
    cols += [c for name, x in changes.items() for c in (x.alias(f"{name}_delta"), (x - 0.125).alias(f"{name}_low"), (x + 0.25).alias(f"{name}_high"))]
    x = table(spark, d, "nation").select(F.col("n_name").alias("model"), F.col("n_name").alias("label"), *cols, F.lit(4000.0).alias("base_tokens"), (k + 1000.0).alias("sft_tokens"), (k + 0.25).alias("sparse_validity"), F.lit(50.0).alias("dense_validity"), k.alias("valid_count"), F.lit(250).alias("n"))
    return reports.table_fragments(x)


@register(
    "supplement_fragments",
    rf"""WITH n AS (SELECT *, n_nationkey / 32.0 AS v FROM nation)
    SELECT 'feature' AS what, 'Nodules.a_' || n_nationkey || '%' AS name, 'a ' || n_nationkey || '\% & ' || n_nationkey || ' & ' || CASE WHEN n_nationkey >= 20 THEN {_ci('v')} || ' & ' || {_delta('v')} ELSE printf('%.3f (descriptive)', v) || ' & ' || printf('%+.2f (descriptive)', 100 * v) END || ' \\' AS text FROM n
    UNION ALL SELECT 'sensitivity', n_name, n_name || ' & ' || {_ci('v')} || ' & ' || {_ci('v')} || ' & ' || n_nationkey || '/142 (' || printf('%.1f', 100 * v) || '\%; 95\% CI: ' || printf('%.1f, %.1f', 100 * (v - 0.125), 100 * (v + 0.25)) || '\%) \\' FROM n""",
)
def supplement_fragments(spark: SparkSession, d: str) -> DataFrame:
    """Rows of the two supplementary tables."""
    k = F.col("n_nationkey")
    v = k.cast("double") / 32
    three = lambda p, first: [v.alias(f"{p}_{first}"), (v - 0.125).alias(f"{p}_low"), (v + 0.25).alias(f"{p}_high")]
    x = table(spark, d, "nation")
    f = x.select(F.concat(F.lit("Nodules.a_"), k.cast("string"), F.lit("%")).alias("feature"), k.alias("support"), *three("abs", "f1"), *three("diff", "delta"))
    s = x.select(F.col("n_name").alias("model"), F.col("n_name").alias("label"), *three("all", "f1"), *three("pos", "f1"), k.cast("int").alias("fp_reports"), F.lit(142).alias("negatives"), v.alias("rate"), (v - 0.125).alias("rate_low"), (v + 0.25).alias("rate_high"))
    a = reports.feature_fragments(f).select(F.lit("feature").alias("what"), F.col("feature").alias("name"), F.col("row").alias("text"))
    return a.unionByName(reports.sensitivity_fragments(s).select(F.lit("sensitivity").alias("what"), F.col("model").alias("name"), F.col("row").alias("text")))


@register(
    "figure_tables",
    """SELECT n_name AS model, 'b' AS config, CAST(1 AS INT) AS place, n_nationkey / 32.0::DOUBLE AS point, 0.125::DOUBLE AS below, 0.25::DOUBLE AS above FROM nation UNION ALL SELECT n_name, 'a', 0, n_nationkey / 16.0::DOUBLE, 0.125, 0.25 FROM nation""",
)
def figure_tables(spark: SparkSession, d: str) -> DataFrame:
    """K9: what a forest plot is drawn from; drawing itself needs a plotting library."""
    x = table(spark, d, "nation").withColumn("v", F.col("n_nationkey").cast("double") / 32)
    rows = None
    for config, factor, metric in (("a", 2, "micro_f1"), ("b", 1, "micro_f1"), ("c", 1, "micro_f1"), ("a", 3, "weighted_f1")):
        p = F.col("v") * factor
        part = x.select(F.col("n_name").alias("model"), F.lit(config).alias("config"), F.lit(metric).alias("metric"), p.alias("point"), (p - 0.125).alias("ci_low"), (p + 0.25).alias("ci_high"))
        rows = part if rows is None else rows.unionByName(part)
    return reports.forest_table(rows, ("a", "b"))


@register("stacked_changes", """SELECT n_regionkey AS model, count_if(n_nationkey % 3 = 0) AS improved, count_if(n_nationkey % 3 = 1) AS worsened, count_if(n_nationkey % 3 = 2) AS unchanged FROM nation GROUP BY n_regionkey""")
def stacked_changes(spark: SparkSession, d: str) -> DataFrame:
    """K9: what stacked bars are drawn from."""
    k = F.col("n_nationkey") % 3
    x = table(spark, d, "nation").select(F.col("n_regionkey").alias("model"), F.when(k == 0, "improved").when(k == 1, "worsened").otherwise("unchanged").alias("label"))
    return reports.stacked_table(x)


@register("tagged_grammar", """SELECT true AS framed, true AS every_rule_defined, 8::BIGINT AS lobes, true AS bounded FROM (SELECT 1)""")
def tagged_grammar(spark: SparkSession, d: str) -> DataFrame:
    """L3: the grammar of a tagged record: framed by tags, closed under its rules, lists bounded."""
    import re

    text = generation.tagged_grammar(fields.raw_schema(), "<json>", "</json>")
    rules = dict(line.split(" ::= ", 1) for line in text.split("\n"))
    named = {w for body in rules.values() for w in re.findall(r"\b[a-z]\w*\b", re.sub(r'"(?:[^"\\]|\\.)*"|\[(?:[^\]\\]|\\.)*\]', "", body))}
    lobes = 2 + sum(json.dumps(json.dumps(x)) in text for x in fields.CATEGORIES["lobe"])  # the list's values, and what it may be besides
    row = (rules["root"].startswith('"<json>\\n"') and rules["root"].endswith('"\\n</json>"'), named <= set(rules), lobes, "{0,48}" in text)
    return spark.createDataFrame([row], "framed boolean, every_rule_defined boolean, lobes long, bounded boolean")
