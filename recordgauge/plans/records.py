"""Queries over record texts: recovery, normalisation, inspection, validation, gates; each with its DuckDB twin.

Record texts are made from customers by rules that both engines share.
"""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from recordgauge.functions import dates, equality, fields, jsonx, nulls, schema, slots, text
from recordgauge.operators import audits, gates, metrics, reports, scoring
from recordgauge.plans.catalogue import SQL_LABELS, arm_features, label_events, r6, register, sql_features
from recordgauge.session import spread, table


def key() -> Column:
    return F.col("c_custkey")


def customers(spark: SparkSession, d: str, *columns: Column) -> DataFrame:
    return spread(table(spark, d, "customer").select("c_custkey")).select("c_custkey", *columns)


def text_of(*parts: Column | str) -> Column:
    return F.concat(*[F.lit(p) if isinstance(p, str) else p.cast("string") for p in parts])


# --- recovery and normalisation ---------------------------------------------------------


@register(
    "json_any_value",
    """SELECT c_custkey, CASE c_custkey % 5 WHEN 0 THEN '[' || c_custkey || ',2]' WHEN 1 THEN c_custkey::VARCHAR WHEN 2 THEN '{"a":' || c_custkey || '}' WHEN 3 THEN '{"b":null}' ELSE '{}' END AS value FROM customer""",
)
def json_any_value(spark: SparkSession, d: str) -> DataFrame:
    """Any JSON value where the whole text is one, else the outermost object, else {}; canonical text."""
    raw = F.when(key() % 5 == 0, text_of("[", key(), ", 2]")).when(key() % 5 == 1, text_of(" ", key(), " ")).when(key() % 5 == 2, text_of('so {"a": ', key(), "} there")).when(key() % 5 == 3, F.lit('{"b": null}')).otherwise(F.lit("{broken"))
    return customers(spark, d, jsonx.parse_any_json(raw).alias("value"))


@register(
    "tagged_json",
    """SELECT c_custkey, c_custkey % 4 IN (0, 2) AS exact_tags, c_custkey % 4 <> 2 AS json_valid, CASE c_custkey % 4 WHEN 0 THEN '{"a":' || c_custkey || '}' WHEN 3 THEN '{"a":1}' END AS object FROM customer""",
)
def tagged_json(spark: SparkSession, d: str) -> DataFrame:
    """Exact tags, JSON between them, and the object."""
    raw = F.when(key() % 4 == 0, text_of('<json>\n{"a": ', key(), "}\n</json>")).when(key() % 4 == 1, F.lit("<json>[1, 2]</json>")).when(key() % 4 == 2, F.lit("<json>\n{broken\n</json>")).otherwise(F.lit('well <json> {"a": 1} </json> done'))
    return customers(spark, d, jsonx.tagged_json(raw).alias("t")).select("c_custkey", "t.*")


def listed(spark: SparkSession, d: str) -> DataFrame:
    """Records whose list of findings stands under one of several keys, some findings with nulls."""
    spelling = F.when(key() % 4 == 0, "nodules").when(key() % 4 == 1, "Nodules (Array)").when(key() % 4 == 2, "other").otherwise("Nodules")
    first = text_of('{"Lobe": "', F.when(key() % 3 == 0, "none").otherwise("lingula"), '", "Image ID": ', key(), "}")
    inner = text_of('{"', spelling, '": [', first, ', {"Type": "N/A"}]}')
    return customers(spark, d, F.when(key() % 5 == 0, text_of('{"deep": ', inner, "}")).otherwise(inner).alias("record"))


@register(
    "find_findings",
    """SELECT c_custkey, CAST(2 AS INT) AS n, CASE WHEN c_custkey % 3 = 0 THEN '{"Image ID":' || c_custkey || '}' ELSE '{"Image ID":' || c_custkey || ',"Lobe":"lingula"}' END AS first, '{}' AS second FROM customer""",
)
def find_findings(spark: SparkSession, d: str) -> DataFrame:
    """The list of findings under a known spelling, deeper, or by its telling fields; null-valued keys go."""
    x = listed(spark, d).select("c_custkey", jsonx.findings_json(F.col("record")).alias("f"))
    return x.select("c_custkey", F.size("f").alias("n"), F.get("f", F.lit(0)).alias("first"), F.get("f", F.lit(1)).alias("second"))


@register(
    "walk_findings",
    """SELECT c_custkey, i, '$.' || CASE WHEN c_custkey % 5 = 0 THEN 'deep.' ELSE '' END || CASE WHEN c_custkey % 4 = 0 THEN 'nodules' ELSE 'Nodules' END || '[' || i || ']' AS path FROM customer, (SELECT unnest([0, 1])::INT AS i) WHERE c_custkey % 4 IN (0, 3)""",
)
def walk_findings(spark: SparkSession, d: str) -> DataFrame:
    """Every finding with its path and its ordinal, at any depth; only lists named 'nodules' count."""
    x = listed(spark, d).select("c_custkey", F.posexplode(jsonx.findings_with_path(F.col("record"))).alias("i", "x"))
    return x.select("c_custkey", "i", "x.path")


@register(
    "canonical_record",
    """SELECT c_custkey, '{' || CASE WHEN c_custkey % 2 = 0 THEN '"Nodules":[{"Image ID":' || c_custkey || ',"Long Axis (mm)":4.5}],"Number of Nodules":1' ELSE '"Overall Lung-RADS":"4A"' END || '}' AS record FROM customer""",
)
def canonical_record(spark: SparkSession, d: str) -> DataFrame:
    """Legacy keys to canonical ones at every level, text to numbers, a count of zero with its list left out."""
    even = text_of('{"num_nodule": "1", "nodules": [{"image": "', key(), '", "long_axis": "4.5", "lobe": "null"}], "overall_lung_rads": "none"}')
    odd = F.lit('{"num_nodule": 0, "nodules": [], "overall_lung_rads": "4A"}')
    return customers(spark, d, jsonx.normalise_legacy_json(F.when(key() % 2 == 0, even).otherwise(odd)).alias("record"))


@register(
    "canonical_keys_typed",
    """SELECT lang, count(*) AS n, 'Lung RADS=' || max(doc_id) || ',Nodule ID=x' AS entries FROM documents GROUP BY lang""",
)
def canonical_keys_typed(spark: SparkSession, d: str) -> DataFrame:
    """N5, N7 on maps: keys with single spaces, then by the table of names."""
    x = table(spark, d, "documents").groupBy("lang").agg(F.count("*").alias("n"), F.max("doc_id").cast("string").alias("top"))
    m = nulls.rename_keys(nulls.canonical_keys(F.create_map(F.lit("  nodule_id "), F.lit("x"), F.lit("Lung \t RADS"), F.col("top"))), fields.LEGACY_KEYS)
    return x.select("lang", "n", F.array_join(F.sort_array(F.transform(F.map_entries(m), lambda e: F.concat(e["key"], F.lit("="), e["value"]))), ",").alias("entries"))


@register("spaced_keys", """SELECT c_custkey, '{"Long Axis (mm)":[{"Nodule ID":' || c_custkey || '}],"x":{"Lung RADS":null}}' AS record FROM customer""")
def spaced_keys(spark: SparkSession, d: str) -> DataFrame:
    """Keys of all levels stripped and with single spaces."""
    return customers(spark, d, jsonx.spaced_keys_json(text_of('{" x ": {"Lung \\t RADS": null}, "Long  Axis (mm) ": [{"Nodule  ID": ', key(), "}]}")).alias("record"))


@register(
    "pruned_records",
    """SELECT c_custkey, CASE WHEN c_custkey % 3 = 0 THEN '{"D":2}' ELSE '{"A":["' || c_custkey || '"],"D":2}' END AS record FROM customer""",
)
def pruned_records(spark: SparkSession, d: str) -> DataFrame:
    """Null leaves and containers that become empty go, at any depth of JSON text."""
    raw = text_of('{"A": [null, ', F.when(key() % 3 == 0, '" none "').otherwise(text_of('"', key(), '"')), '], "B": {"C": {"E": "N/A"}}, "D": 2}')
    return customers(spark, d, jsonx.prune_json(raw).alias("record"))


@register(
    "token_difference",
    """SELECT conv_id, turn, role, CAST(CASE WHEN turn % 3 = 0 THEN -1 WHEN turn % 3 = 1 THEN len(string_split(text, ' ')) ELSE 0 END AS BIGINT) AS place FROM conversations""",
)
def token_difference(spark: SparkSession, d: str) -> DataFrame:
    """T-16 over tokens: the first that differs, the length where one text goes on, none where they agree."""
    k = F.col("turn") % 3
    other = F.when(k == 0, F.col("text")).when(k == 1, F.concat("text", F.lit(" more"))).otherwise(F.concat(F.lit("!"), "text"))
    at = text.first_token_difference(F.split("text", " ", -1), F.split(other, " ", -1))
    return table(spark, d, "conversations").select("conv_id", "turn", "role", F.coalesce(at, F.lit(-1)).cast("long").alias("place"))


@register(
    "unwrap_and_path",
    """SELECT c_custkey, CASE c_custkey % 3 WHEN 0 THEN c_custkey WHEN 1 THEN c_custkey + 1 END AS value FROM customer""",
)
def unwrap_and_path(spark: SparkSession, d: str) -> DataFrame:
    """The section's object if there is one, and a dotted path below it."""
    raw = F.when(key() % 3 == 0, text_of('{"Lungs Pleura": {"a": {"b": ', key(), "}}}")).when(key() % 3 == 1, text_of('{"a": {"b": ', key() + 1, "}}")).otherwise(F.lit('{"Lungs Pleura": {"a": 7}}'))
    return customers(spark, d, jsonx.path_json(raw, "a.b", "Lungs Pleura").cast("long").alias("value"))


@register(
    "gold_fallback",
    """SELECT c_custkey, CASE c_custkey % 3 WHEN 0 THEN '{}' WHEN 1 THEN '{"a":' || c_custkey || '}' ELSE '{"parsed":1}' END AS gold FROM customer""",
)
def gold_fallback(spark: SparkSession, d: str) -> DataFrame:
    """The saved record, even an empty one, else what the raw text parses to."""
    x = customers(spark, d, F.when(key() % 3 == 0, F.lit("{}")).when(key() % 3 == 1, text_of('{"a": ', key(), "}")).alias("Ground Truth"), F.lit('so: {"parsed": 1}').alias("raw"))
    gold = jsonx.gold_source(x.columns, "Ground Truth", F.col("raw"))
    return x.select("c_custkey", jsonx.safe_object_json(gold).alias("gold"))


@register(
    "null_inspection",
    """SELECT c_custkey, CAST(CASE WHEN c_custkey % 2 = 0 THEN 2 ELSE 1 END AS BIGINT) AS nulls, CAST(3 AS BIGINT) AS leaves, CAST(CASE WHEN c_custkey % 2 = 0 THEN 1 ELSE 0 END AS BIGINT) AS plain, CASE WHEN c_custkey % 2 = 0 THEN '$.a.b,$.c[1]' ELSE '$.c[1]' END AS paths FROM customer""",
)
def null_inspection(spark: SparkSession, d: str) -> DataFrame:
    """Null and all leaves, plain nulls, and where nulls are left."""
    x = customers(spark, d, text_of('{"a": {"b": ', F.when(key() % 2 == 0, "null").otherwise("1"), '}, "c": [5, " None "]}').alias("record"))
    counts = jsonx.leaf_counts_json(F.col("record"))
    x = x.select("c_custkey", counts.alias("c"), jsonx.plain_nulls_json(F.col("record")).alias("plain"), jsonx.null_paths_json(F.col("record")).alias("p"))
    return x.select("c_custkey", "c.nulls", "c.leaves", "plain", F.array_join("p", ",").alias("paths"))


@register(
    "count_consistency",
    """SELECT CASE c_custkey % 5 WHEN 0 THEN 'both_omitted' WHEN 1 THEN 'consistent' WHEN 2 THEN 'inconsistent' WHEN 3 THEN 'uncheckable' ELSE 'consistent' END AS status, count(*) AS n FROM customer GROUP BY 1""",
)
def count_consistency(spark: SparkSession, d: str) -> DataFrame:
    """Whether the count and the list of findings agree."""
    raw = F.when(key() % 5 == 0, "{}").when(key() % 5 == 1, '{"Number of Nodules": 2, "Nodules": [{}, {}]}').when(key() % 5 == 2, '{"Number of Nodules": 2, "Nodules": [{}]}').when(key() % 5 == 3, '{"Number of Nodules": "two", "Nodules": []}').otherwise('{"Number of Nodules": 0}')
    return customers(spark, d, jsonx.count_status_json(raw).alias("status")).groupBy("status").agg(F.count("*").alias("n"))


@register(
    "labels_and_intervals",
    """SELECT n_nationkey, 'Field ' || n_nationkey || ' (mm)' AS label, printf('%.3f (%.3f, %.3f)', n_nationkey / 7.0, n_nationkey / 8.0, n_nationkey / 6.0) AS ci, printf('%+.2f (%+.2f, %+.2f)', n_nationkey * 100 / 16.0, -(n_nationkey::DOUBLE) * 100 / 32.0, n_nationkey * 100 / 8.0) AS delta, CASE WHEN n_regionkey = 0 THEN '' ELSE printf('%.4f', n_nationkey / 3.0) END AS shown, printf('%+.2f', n_nationkey - 12.5) AS change FROM nation""",
)
def labels_and_intervals(spark: SparkSession, d: str) -> DataFrame:
    """Short feature names, intervals, signed changes and fixed decimals."""
    n = F.col("n_nationkey").cast("double")
    x = table(spark, d, "nation")
    return x.select("n_nationkey", text.short_feature(F.concat(F.lit("Nodules.Field_"), F.col("n_nationkey").cast("string"), F.lit(" (mm)"))).alias("label"), text.interval_text(n / 7, n / 8, n / 6).alias("ci"), text.fixed(F.when(F.col("n_regionkey") != 0, n / 3)).alias("shown"), text.signed(n - 12.5).alias("change"), text.change_text(n / 16, -n / 32, n / 8).alias("delta"))


@register(
    "summary_getters",
    """SELECT c_custkey, CAST(c_custkey + 0.5 AS DOUBLE) AS f1, CASE WHEN c_custkey % 3 <> 0 THEN c_custkey::DOUBLE END AS mean FROM customer""",
)
def summary_getters(spark: SparkSession, d: str) -> DataFrame:
    """A number that must be there, and a nested one that may be missing."""
    s = F.parse_json(text_of('{"F1": ', key(), '.5, "Token Usage": {', F.when(key() % 3 != 0, text_of('"Prompt Tokens": {"Mean": ', key(), "}")).otherwise(""), "}}"))
    x = customers(spark, d, s.alias("s"))
    return x.select("c_custkey", gates.numeric(F.col("s"), "F1").alias("f1"), gates.nested(F.col("s"), "Token Usage", "Prompt Tokens", "Mean").alias("mean"))


@register("column_order", """SELECT lang, n, prompt_tokens, total_tokens, chars FROM (SELECT lang, count(*) AS n, CAST(sum(n_chars) AS BIGINT) AS prompt_tokens, CAST(sum(n_chars) + count(*) AS BIGINT) AS total_tokens, max(n_chars) AS chars FROM documents GROUP BY lang)""")
def column_order(spark: SparkSession, d: str) -> DataFrame:
    """Preferred columns, then token columns, then the rest; an order that fails is an error here."""
    x = table(spark, d, "documents").groupBy("lang").agg(F.max("n_chars").alias("chars"), F.sum("n_chars").alias("prompt_tokens"), (F.sum("n_chars") + F.count("*")).alias("total_tokens"), F.count("*").alias("n"))
    out = reports.preferred_columns(x, ["lang", "n", "absent"])
    if out.columns != ["lang", "n", "prompt_tokens", "total_tokens", "chars"]:
        raise AssertionError(out.columns)
    return out


# --- scalars ----------------------------------------------------------------------------


@register(
    "tolerant_text_equality",
    r"""WITH v AS (SELECT l_linenumber, l_quantity + CASE l_suppkey % 4 WHEN 1 THEN 0.0104 WHEN 2 THEN 0.02 ELSE 0 END AS q, l_quantity AS g, l_suppkey % 4 AS k, l_suppkey % 3 AS m, strftime(l_shipdate, '%-m/%-d/%Y') AS a, CASE WHEN l_suppkey % 2 = 0 THEN strftime(l_shipdate, '%m/%d/%y') ELSE strftime(l_shipdate, '%-m/%Y') END AS b FROM lineitem)
    SELECT l_linenumber, count(*) AS n, count_if(k IN (0, 3)) AS plain_equal, count_if(k <> 2) AS rounded_equal, count_if(m = 0) AS null_equal, count_if(NOT contains(b, '/') OR len(string_split(b, '/')) = 3) AS date_equal FROM v GROUP BY l_linenumber""",
)
def tolerant_text_equality(spark: SparkSession, d: str) -> DataFrame:
    """Numbers as text with and without rounding to 3 decimals, null aliases, dates that keep their precision."""
    x = table(spark, d, "lineitem").select("l_linenumber", "l_quantity", (F.col("l_suppkey") % 4).alias("k"), (F.col("l_suppkey") % 3).alias("m"), (F.col("l_suppkey") % 2).alias("half"), F.to_date("l_shipdate").alias("day"))
    k, m = F.col("k"), F.col("m")
    g = F.format_string("%.1f", F.col("l_quantity"))
    p = F.format_string(" %.4f ", F.col("l_quantity") + F.when(k == 1, 0.0104).when(k == 2, 0.02).otherwise(0.0))
    a, b = F.date_format("day", "M/d/yyyy"), F.when(F.col("half") == 0, F.date_format("day", "MM/dd/yy")).otherwise(F.date_format("day", "M/yyyy"))
    none = F.when(m == 0, " N/A ").when(m == 1, "0").otherwise("nan")
    eq = equality.values_equal
    flags = {"plain_equal": eq(F.col("g"), F.col("p")), "rounded_equal": eq(F.col("g"), F.col("p"), digits=3, tolerance=0.0105), "null_equal": eq(F.col("none"), F.lit(None)), "date_equal": eq(F.col("a"), F.col("b"), "Nodules.Comparison Date")}

    def counted(source: list[str], texts: dict[str, Column], names: tuple[str, ...]) -> DataFrame:
        # rows of equal values are counted first: each pair of texts is written and compared once
        pairs = x.groupBy("l_linenumber", *source).agg(F.count("*").alias("n")).select("l_linenumber", "n", *[c.alias(t) for t, c in texts.items()])
        return pairs.groupBy("l_linenumber").agg(F.sum("n").alias("n"), *[F.sum(F.when(flags[f], F.col("n")).otherwise(0)).alias(f) for f in names])

    numbers = counted(["l_quantity", "k"], {"g": g, "p": p}, ("plain_equal", "rounded_equal"))
    for part in (counted(["m"], {"none": none}, ("null_equal",)), counted(["day", "half"], {"a": a, "b": b}, ("date_equal",))):
        part = part.select(F.col("l_linenumber").alias("line"), *[c for c in part.columns if c in flags])
        numbers = numbers.join(part, F.col("l_linenumber").eqNullSafe(F.col("line"))).drop("line")
    return numbers.select("l_linenumber", "n", *flags)


@register("date_fields", """SELECT feature, feature LIKE '%Comparison Date' OR feature = 'Follow-up Date' AS dated FROM (SELECT unnest(['Nodules.Comparison Date', 'Follow-up Date', 'Imaging Interval', 'Date', 'x.Comparison Date']) AS feature)""")
def date_fields(spark: SparkSession, d: str) -> DataFrame:
    """Whether a dotted path ends in a date field."""
    names = spark.createDataFrame([("Nodules.Comparison Date",), ("Follow-up Date",), ("Imaging Interval",), ("Date",), ("x.Comparison Date",)], "feature string")
    return names.select("feature", dates.is_date_field(F.col("feature")).alias("dated"))


@register(
    "context_windows",
    r"""WITH c AS (SELECT doc_id, text, n_chars, doc_id % 200 AS s, doc_id % 3 = 0 AS spanned FROM documents)
    SELECT doc_id, sha256(CASE WHEN spanned THEN trim(regexp_replace(substr(text, greatest(0, s - 120) + 1, s + 5 + 120 - greatest(0, s - 120)), '\s+', ' ', 'g'), ' ') ELSE substr(trim(regexp_replace(text, '\s+', ' ', 'g'), ' '), 1, 240) END) AS sha FROM c""",
)
def context_windows(spark: SparkSession, d: str) -> DataFrame:
    """T-12: up to 120 characters on either side of a span, or the first 240."""
    s = F.when(F.col("doc_id") % 3 == 0, (F.col("doc_id") % 200).cast("int"))
    return table(spark, d, "documents").select("doc_id", F.sha2(text.context_excerpt(F.col("text"), s, s + 5), 256).alias("sha"))


@register(
    "context_keys",
    """SELECT c_custkey, CASE WHEN c_custkey % 2 = 0 THEN 4096 WHEN c_custkey % 3 = 0 THEN 2048 WHEN c_custkey % 5 = 0 THEN c_custkey + 1 END AS native FROM customer""",
)
def context_keys(spark: SparkSession, d: str) -> DataFrame:
    """M-2, M-3: the first plausible of nine configuration keys, in order of preference."""
    given = {text.CONTEXT_KEYS[0]: F.when(key() % 2 == 0, 4096).otherwise(-1), text.CONTEXT_KEYS[3]: F.when(key() % 3 == 0, 2048), text.CONTEXT_KEYS[8]: F.when(key() % 5 == 0, key() + 1).otherwise(10**18)}
    x = customers(spark, d, *[given.get(name, F.lit(None)).cast("long").alias(name) for name in text.CONTEXT_KEYS])
    return x.select("c_custkey", text.native_context(x.columns).alias("native"))


@register("safe_ratios", """SELECT n_nationkey, coalesce(n_nationkey / nullif(n_regionkey, 0), 0)::DOUBLE AS ratio FROM nation""")
def safe_ratios(spark: SparkSession, d: str) -> DataFrame:
    """M-4."""
    return table(spark, d, "nation").select("n_nationkey", text.safe_div(F.col("n_nationkey"), F.col("n_regionkey")).alias("ratio"))


@register(
    "distinct_in_order",
    """WITH e AS (SELECT user_id, event_type, min(event_id) AS place FROM events GROUP BY ALL) SELECT user_id, string_agg(event_type, ',' ORDER BY place) AS kinds FROM e GROUP BY user_id""",
)
def distinct_in_order(spark: SparkSession, d: str) -> DataFrame:
    """The first of each value, in order."""
    x = table(spark, d, "events").groupBy("user_id").agg(F.transform(F.sort_array(F.collect_list(F.struct("event_id", "event_type"))), lambda e: e["event_type"]).alias("all"))
    return x.select("user_id", F.array_join(reports.distinct_in_order(F.col("all")), ",").alias("kinds"))


@register(
    "presence_by_feature",
    """WITH k AS (SELECT page_id % 8 AS k, 'file' || page_id % 3 AS file, CASE WHEN page_id % 2 = 0 THEN 'Image ID' ELSE 'Series ID' END AS feature FROM pages),
    s AS (SELECT file, feature, count(*) AS total_occurrences, count_if(k = 0) AS strict_present_n, count_if(k <= 1) AS strict_plus_ws_n, count_if(k BETWEEN 1 AND 6) AS relaxed_only_n, count_if(k <= 6) AS any_present_n, count_if(k = 0) AS numeric_n, count_if(k IN (2, 5, 6)) AS alphanumeric_n, count_if(k IN (1, 3, 4)) AS other_n,
      count_if(k = 0) AS matched_by_strict_token_n, count_if(k = 1) AS matched_by_strict_ws_token_n, count_if(k = 2) AS matched_by_relaxed_casefold_n, count_if(k = 3) AS matched_by_relaxed_compact_n, count_if(k = 4) AS matched_by_relaxed_prefix_stripped_n, count_if(k = 5) AS matched_by_relaxed_digits_n, count_if(k = 6) AS matched_by_relaxed_digits_no_zeros_n, count_if(k = 7) AS matched_by_none_n FROM k GROUP BY file, feature)
    SELECT file, feature, total_occurrences, strict_present_n, round(100.0 * strict_present_n / total_occurrences, 3) AS strict_present_pct, strict_plus_ws_n, round(100.0 * strict_plus_ws_n / total_occurrences, 3) AS strict_plus_ws_pct, relaxed_only_n, round(100.0 * relaxed_only_n / total_occurrences, 3) AS relaxed_only_pct, any_present_n, round(100.0 * any_present_n / total_occurrences, 3) AS any_present_pct,
      numeric_n, round(100.0 * numeric_n / total_occurrences, 3) AS numeric_pct, alphanumeric_n, round(100.0 * alphanumeric_n / total_occurrences, 3) AS alphanumeric_pct, other_n, round(100.0 * other_n / total_occurrences, 3) AS other_pct,
      matched_by_strict_token_n, matched_by_strict_ws_token_n, matched_by_relaxed_casefold_n, matched_by_relaxed_compact_n, matched_by_relaxed_prefix_stripped_n, matched_by_relaxed_digits_n, matched_by_relaxed_digits_no_zeros_n, matched_by_none_n FROM s""",
)
def presence_by_feature(spark: SparkSession, d: str) -> DataFrame:
    """Presence by file and feature, all 25 columns."""
    from recordgauge.plans.catalogue import ladder

    x = text.match_ladder(ladder(spark, d), "text", "value")
    x = x.select(F.concat(F.lit("file"), (F.col("page_id") % 3).cast("string")).alias("file"), F.when(F.col("page_id") % 2 == 0, "Image ID").otherwise("Series ID").alias("feature"), text.id_format(F.col("id_clean")).alias("id_format"), "matched_by")
    return metrics.presence_summary(x, ["file", "feature"])


# --- validation -------------------------------------------------------------------------


@register(
    "schema_messages",
    """SELECT c_custkey, CAST((c_custkey % 2 = 0)::INT + (c_custkey % 3 = 0)::INT + (c_custkey % 5 = 0)::INT AS INT) AS n, concat_ws(';', CASE WHEN c_custkey % 5 = 0 THEN '$.Extra: additional property' END, CASE WHEN c_custkey % 2 = 0 THEN '$.Number of Nodules: matches no branch' END, CASE WHEN c_custkey % 3 = 0 THEN '$.Overall Lung-RADS: matches no branch' END) AS messages FROM customer""",
)
def schema_messages(spark: SparkSession, d: str) -> DataFrame:
    """V2: one line a fault; a failed choice of types is one line."""
    raw = text_of('{"Number of Nodules": ', F.when(key() % 2 == 0, "-1").otherwise("3"), ', "Overall Lung-RADS": ', F.when(key() % 3 == 0, '"9"').otherwise("null"), F.when(key() % 5 == 0, ', "Extra": 1').otherwise(""), "}")
    m = schema.messages_json(raw, fields.raw_schema())
    return customers(spark, d, m.alias("m")).select("c_custkey", F.size("m").alias("n"), F.array_join(F.sort_array("m"), ";").alias("messages"))


@register(
    "dense_contract_counts",
    """SELECT c_custkey, CASE c_custkey % 4 WHEN 0 THEN '' WHEN 1 THEN 'list length differs from count' WHEN 2 THEN '$.Nodules[0].Lobe: not a word of its slot' ELSE '$: key order' END AS faults FROM customer""",
)
def dense_contract_counts(spark: SparkSession, d: str) -> DataFrame:
    """Records from the dense template, some spoilt, and what is wrong with them."""
    good = slots.MARK.sub("null", slots.template_text(1).replace("<|num_nodule|>", "1"))
    swapped = json.dumps(dict(reversed(json.loads(good).items())))
    out = F.when(key() % 4 == 0, good).when(key() % 4 == 1, good.replace('"1"', '"2"', 1)).when(key() % 4 == 2, good.replace('"Lobe": "null"', '"Lobe": "left"')).otherwise(swapped)
    return customers(spark, d, F.array_join(slots.dense_faults_json(out), ";").alias("faults"))


@register("template_consistency", """SELECT true AS top_level_order, true AS one_item, 'Lobe: +hilum -lingula; Margin: -irregular' AS differences FROM (SELECT 1)""")
def template_consistency(spark: SparkSession, d: str) -> DataFrame:
    """A template's candidate lists against the schema's, two lists of which are spoilt here."""
    spoilt = fields.raw_schema()
    inner = spoilt["properties"]["Nodules"]["anyOf"][0]["items"]["properties"]
    inner["Lobe"]["anyOf"][0]["enum"] = [x for x in fields.CATEGORIES["lobe"] if x != "lingula"] + ["hilum"]
    inner["Margin"]["anyOf"][0]["enum"] = [x for x in fields.CATEGORIES["margin"] if x != "irregular"]
    found = slots.template_audit(slots.dense_template(1), spoilt)
    said = "; ".join(f"{k}:" + "".join(f" +{x}" for x in v["only_schema"]) + "".join(f" -{x}" for x in v["only_template"]) for k, v in sorted(found["differences"].items()))
    return spark.createDataFrame([(found["top_level_order"], found["one_item"], said)], "top_level_order boolean, one_item boolean, differences string")


@register(
    "normalisation_audit",
    """SELECT CAST(c_custkey % 4 AS BIGINT) AS arm, count(*) AS n, count_if(c_custkey % 3 <> 0) AS raw_valid, 0::BIGINT + count_if(c_custkey % 5 = 0) AS with_null_left, CAST(sum(CASE WHEN c_custkey % 2 = 0 THEN 1 ELSE 0 END) AS BIGINT) AS null_leaves, count(*) * 2 AS leaves FROM customer GROUP BY 1""",
)
def normalisation_audit(spark: SparkSession, d: str) -> DataFrame:
    """V9: raw validity, null leaves and nulls left behind, by arm."""
    raw = text_of('{"Number of Nodules": ', F.when(key() % 3 == 0, '"x"').otherwise("1"), ', "Overall Lung-RADS": ', F.when(key() % 2 == 0, "null").otherwise('"2"'), "}")
    left = F.when(key() % 5 == 0, '{"a": " none "}').otherwise('{"a": 1}')
    x = customers(spark, d, (key() % 4).alias("arm"), schema.validate_json(raw, fields.raw_schema())["valid"].alias("valid"), jsonx.leaf_counts_json(raw).alias("c"), jsonx.null_paths_json(left).alias("p"))
    return audits.normalisation_summary(x, ["arm"], F.col("valid"), F.size("p") > 0, F.col("c.nulls"), F.col("c.leaves"))


@register("reparse_audit", """SELECT count(*) AS n, count_if(c_custkey % 3 <> 1) AS reparses FROM customer""")
def reparse_audit(spark: SparkSession, d: str) -> DataFrame:
    """Whether a raw text parses to the saved object."""
    raw = text_of("so: ", '{"a": ', key(), "}")
    saved = F.when(key() % 3 == 1, text_of('{"a":', key() + 1, "}")).otherwise(text_of('{"a":', key(), "}"))
    x = audits.reparse_check(customers(spark, d, raw.alias("raw"), saved.alias("saved")), jsonx.parse_object_json(F.col("raw")), F.col("saved"))
    return x.agg(F.count("*").alias("n"), F.count_if("reparses").alias("reparses"))


@register(
    "dataset_pair",
    """SELECT count(*) AS records, count_if(doc_id % 10 <> 0) AS sparse_policy, count(*) AS dense_policy, count_if(doc_id % 7 = 0) AS content_differs, 0::BIGINT + (SELECT count(DISTINCT lang) FROM documents WHERE doc_id % 10 = 0) AS shared_digests FROM documents""",
)
def dataset_pair(spark: SparkSession, d: str) -> DataFrame:
    """Two datasets row by row: instruction policies, shared instructions, equal other content."""
    sparse, dense = " ".join(fields.SPARSE_MARKS), " ".join(fields.DENSE_MARKS)
    x = table(spark, d, "documents").select(F.col("doc_id").alias("pos"), "lang", "n_chars")
    a = x.select("pos", F.concat(F.when(F.col("pos") % 10 == 0, dense).otherwise(sparse), F.lit(" "), "lang").alias("t"), "n_chars")
    b = x.select("pos", F.concat(F.lit(dense + " "), "lang").alias("t"), (F.col("n_chars") + F.when(F.col("pos") % 7 == 0, 1).otherwise(0)).alias("n_chars"))
    return audits.dataset_pair_audit(a, b, "t", ["n_chars"])


_PROVENANCE = {
    "base_policy_is_dense_nullable": 2, "dc_policy_is_dense_nullable": 3, "base_hash_matches_dataset_audit": 5, "dc_hash_matches_dataset_audit": 7,
    "base_test_file_matches_dense_dataset": 11, "dc_test_file_matches_dense_dataset": 13,
}
_SQL_FAILED = ", ".join(f"CASE WHEN {'c_custkey % 5 = 0 OR c_custkey % 7 = 0' if name == 'both' else f'c_custkey % {k} = 0'} THEN '{'base_and_dc_hashes_identical' if name == 'both' else name}' END" for name, k in [*list(_PROVENANCE.items())[:4], ("both", 0), *list(_PROVENANCE.items())[4:]])


@register("prompt_provenance", f"SELECT c_custkey, concat_ws(',', {_SQL_FAILED}) AS failed FROM customer")
def prompt_provenance(spark: SparkSession, d: str) -> DataFrame:
    """The seven named checks, spoilt by rule."""
    n, good = F.lit(250).cast("long"), F.array(F.lit("h1"), F.lit("h2"))
    policies = lambda k: F.when(key() % k == 0, F.create_map(F.lit("dense_nullable"), n, F.lit("unrecognized"), F.lit(1).cast("long"))).otherwise(F.create_map(F.lit("dense_nullable"), n))
    x = customers(
        spark, d, policies(2).alias("base_policies"), policies(3).alias("dc_policies"), F.when(key() % 5 == 0, F.array(F.lit("b"))).otherwise(good).alias("base_hashes"), F.when(key() % 7 == 0, F.array(F.lit("c"))).otherwise(good).alias("dc_hashes"), good.alias("dataset_hashes"),
        F.when(key() % 11 == 0, "other.json").otherwise("d.json").alias("base_file"), F.when(key() % 13 != 0, "d.json").alias("dc_file"), F.lit("data/d.json").alias("dataset_file"), n.alias("records"),
    )
    return gates.provenance(x).select("c_custkey", F.array_join("failed", ",").alias("failed"))


@register(
    "pair_acceptance",
    """SELECT c_custkey, c_custkey % 3 = 0 OR (c_custkey % 3 = 1 AND c_custkey % 2 = 0 AND c_custkey % 5 <> 0 AND c_custkey % 7 <> 0) AS accepted, c_custkey % 3 = 1 AND c_custkey % 2 = 0 AND c_custkey % 5 <> 0 AND c_custkey % 7 <> 0 AS exception FROM customer""",
)
def pair_acceptance(spark: SparkSession, d: str) -> DataFrame:
    """Valid pairs, and the one documented difference in limits."""
    x = customers(
        spark, d, F.when(key() % 2 == 0, "llama3_1_70B").otherwise("other").alias("model"), (key() % 3 == 0).alias("valid"), F.when(key() % 3 == 1, F.array(F.lit("Max Prompt Tokens"), F.lit("Eval Context Limit"))).otherwise(F.array(F.lit("Seed"))).alias("mismatches"),
        F.lit(32768).alias("context_o"), F.lit(24576).alias("context_c"), F.lit(16384).alias("prompt_o"), F.when(key() % 5 == 0, 4096).otherwise(8192).alias("prompt_c"), F.lit(16384).alias("new_o"), F.lit(16384).alias("new_c"),
        F.lit(True).alias("same_cases"), F.when(key() % 7 == 0, 1).otherwise(0).alias("prompt_mismatches"), F.lit(True).alias("outputs_valid"), F.lit(True).alias("ordinary_ok"), F.lit(True).alias("constrained_ok"),
    )
    return gates.pair_acceptance(x).select("c_custkey", "accepted", "exception")


def summaries(spark: SparkSession, d: str, repeat: bool) -> DataFrame:
    """Summary rows by source with the eighteen fields; a repeat differs in some."""
    x = table(spark, d, "documents").groupBy("source").agg(F.count("*").alias("n"), F.sum("n_chars").alias("s"))
    off = F.when(F.lit(repeat) & (F.col("n") % 2 == 0), 1).otherwise(0)
    return x.select("source", *[((F.col("n") + k + off) if f == "TP" else F.when(F.lit(k % 4 > 0), F.col("s") + k + (off if f == "Token Usage" else 0))).cast("double").alias(f) for k, f in enumerate(gates.REPEAT_FIELDS)])


@register("repeat_fields", """SELECT source, CASE WHEN count(*) % 2 = 0 THEN 'TP,Token Usage' ELSE '' END AS differing FROM documents GROUP BY source""")
def repeat_fields(spark: SparkSession, d: str) -> DataFrame:
    """The eighteen summary fields of a run and its repeat, nulls equal to nulls."""
    x = gates.matching_fields(summaries(spark, d, False), summaries(spark, d, True), key=["source"])
    return x.select("source", F.array_join("differing_fields", ",").alias("differing"))


@register(
    "repeat_cases",
    """WITH c AS (SELECT *, conv_id % 9 = 0 AND turn = 1 AS bad FROM conversations), r AS (SELECT conv_id, turn, role, row_number() OVER (ORDER BY conv_id, turn, role) AS rn FROM c WHERE bad)
    SELECT count_if(bad) AS n_differ, NOT bool_or(bad) AS reproducible, (SELECT string_agg(conv_id || '/' || turn || '/' || role, ',' ORDER BY rn) FROM r WHERE rn <= 20) AS first FROM c""",
)
def repeat_cases(spark: SparkSession, d: str) -> DataFrame:
    """Cases that a repeat doesn't reproduce, and the first of them."""
    a = table(spark, d, "conversations").select("conv_id", "turn", "role", "text")
    b = a.withColumn("text", F.when((F.col("conv_id") % 9 == 0) & (F.col("turn") == 1), F.concat("text", F.lit("!"))).otherwise(F.col("text")))
    x = audits.repeat_check(a, b, ["conv_id", "turn", "role"], ["text"])
    return x.select("n_differ", "reproducible", F.array_join(F.transform("first", lambda s: F.concat_ws("/", s["conv_id"].cast("string"), s["turn"].cast("string"), s["role"])), ",").alias("first"))


@register(
    "controlled_gate",
    """WITH a AS (SELECT n_nationkey AS k, unnest(['base', 'sft', 'sft_dc']) AS arm FROM nation),
    f AS (SELECT k, arm, concat_ws(',', CASE WHEN k % 5 = 1 AND arm = 'base' THEN 'total' END, CASE WHEN k % 7 = 0 THEN 'none_skipped' END, CASE WHEN k % 4 = 0 AND arm <> 'base' THEN 'sampling' END, CASE WHEN k % 3 = 0 AND arm = 'sft' THEN 'mode' END, CASE WHEN k % 6 = 0 AND arm = 'base' THEN 'max_new_tokens' END, CASE WHEN k % 8 = 0 THEN 'one_date_policy' END) AS failed FROM a)
    SELECT CAST(k AS VARCHAR) AS model, arm, failed, failed = '' AS valid FROM f""",
)
def controlled_gate(spark: SparkSession, d: str) -> DataFrame:
    """The rules that every arm of a model must meet, spoilt by rule."""
    k, arm = F.col("n_nationkey"), F.col("arm")
    x = table(spark, d, "nation").select("n_nationkey", F.explode(F.array(*[F.lit(a) for a in ("base", "sft", "sft_dc")])).alias("arm"))
    greedy = {**gates.GREEDY, "seed": None}
    sampling = F.create_map(*[c for n, v in greedy.items() for c in (F.lit(n), F.lit(v) if v is not None else F.when((k % 4 == 0) & (arm != "base"), 1.0).otherwise(0.0))])
    x = x.select(
        k.cast("string").alias("model"), "arm", F.lit(250).alias("n_cases"), F.when((k % 5 == 1) & (arm == "base"), 249).otherwise(250).alias("total"), F.lit(250).alias("original"), F.when(k % 7 == 0, 1).otherwise(0).alias("skipped"), F.lit(False).alias("special_tokens"), F.lit("p").alias("normalisation"),
        F.when((k % 8 == 0) & (arm == "sft"), "other").otherwise("dates").alias("date_policy"), sampling.alias("sampling"), F.when((k % 3 == 0) & (arm == "sft"), "free").otherwise("unconstrained").alias("mode"), F.when(k % 6 == 0, 1536).otherwise(16384).alias("max_new"),
    )
    done = gates.controlled(x, 250, {"base": "unconstrained", "sft": "unconstrained"}, {"base": 16384}, ("base", "sft", "sft_dc"))
    return done.select("model", "arm", F.array_join("failed", ",").alias("failed"), "valid")


@register(
    "matching_f1",
    f"""WITH f AS ({sql_features("a", "lang, feature")}), s AS (SELECT lang, coalesce(2 * sum(tp) / nullif(2 * sum(tp) + sum(fp) + sum(fn), 0), 0) AS v FROM f GROUP BY lang) SELECT lang, round(v, 6) AS value, lang <> 'en' AS matches FROM s""",
)
def matching_f1(spark: SparkSession, d: str) -> DataFrame:
    """Rebuilt point estimates against saved ones, one of which is off by 1e-9."""
    rows = metrics.summary(arm_features(label_events(spark, d), "a", ["lang", "feature"]), ["lang"]).withColumnRenamed("micro_f1", "f1")
    saved = rows.select("lang", (F.col("f1") + F.when(F.col("lang") == "en", 1e-9).otherwise(0.0)).alias("f1"))
    return gates.matching_f1(rows, saved, ["lang"]).select("lang", r6("value").alias("value"), "matches")


# --- joins and sets ---------------------------------------------------------------------


@register("duplicate_keys", """SELECT c_nationkey, c_mktsegment, count(*) AS n FROM customer GROUP BY ALL HAVING count(*) > 1""")
def duplicate_keys(spark: SparkSession, d: str) -> DataFrame:
    """Keys that occur more than once."""
    return audits.duplicates(table(spark, d, "customer"), ["c_nationkey", "c_mktsegment"])


@register("same_examples", """SELECT true AS same, false AS moved, false AS changed, false AS missing FROM (SELECT 1)""")
def same_examples(spark: SparkSession, d: str) -> DataFrame:
    """Equal ids, order and content; a moved row, a changed one and a missing one are noticed."""
    a = audits.numbered(table(spark, d, "supplier").select("s_suppkey", "s_name"), ["s_suppkey"])
    last = a.agg(F.max("pos")).first()[0]
    moved = a.withColumn("pos", F.when(F.col("pos") == 0, last).when(F.col("pos") == last, 0).otherwise(F.col("pos")))
    changed = a.withColumn("s_name", F.when(F.col("pos") == 1, "x").otherwise(F.col("s_name")))
    one = lambda b, name: audits.same_examples(a, b, ["s_suppkey"], ["s_name"]).select(F.col("same").alias(name))
    return one(a, "same").join(one(moved, "moved")).join(one(changed, "changed")).join(one(a.filter("pos > 0"), "missing"))  # one row each


@register(
    "numbered_rows",
    """SELECT c_custkey, row_number() OVER (ORDER BY c_acctbal, c_custkey) - 1 AS pos FROM customer""",
)
def numbered_rows(spark: SparkSession, d: str) -> DataFrame:
    """Positions of all rows in a stated order, without one task sorting them all."""
    return audits.numbered(table(spark, d, "customer").select("c_custkey", "c_acctbal"), ["c_acctbal", "c_custkey"]).select("c_custkey", "pos")


@register(
    "anchor_equality",
    """WITH a AS (SELECT DISTINCT user_id, event_type, CASE WHEN user_id % 7 = 0 THEN event_type WHEN user_id % 5 <> 0 THEN 'gold' END AS v FROM events),
    g AS (SELECT user_id, count(*) AS arms, count(DISTINCT v) AS vals, count_if(v IS NULL) AS missing FROM a GROUP BY user_id)
    SELECT arms, arms = 5 AND (vals = 0 OR (vals = 1 AND missing = 0)) AS same, count(*) AS users FROM g GROUP BY ALL""",
)
def anchor_equality(spark: SparkSession, d: str) -> DataFrame:
    """Whether each of five arms (event types) holds a user, all with one value."""
    v = F.when(F.col("user_id") % 7 == 0, F.col("event_type")).when(F.col("user_id") % 5 != 0, "gold")
    arms = table(spark, d, "events").select("user_id", "event_type", v.alias("v")).distinct()
    return audits.anchor_equality(arms, "user_id", "v", "event_type", 5).groupBy("arms", "same").agg(F.count("*").alias("users"))


@register(
    "dimension_joins",
    """WITH l AS (SELECT n_regionkey AS r_regionkey, c_mktsegment, count(*) AS rich FROM customer JOIN nation ON n_nationkey = c_nationkey WHERE c_acctbal > 9500 GROUP BY ALL)
    SELECT r.r_regionkey, s.c_mktsegment, l.rich FROM region r CROSS JOIN (SELECT DISTINCT c_mktsegment FROM customer) s LEFT JOIN l ON l.r_regionkey = r.r_regionkey AND l.c_mktsegment = s.c_mktsegment""",
)
def dimension_joins(spark: SparkSession, d: str) -> DataFrame:
    """Every combination of two dimensions, looked up in a table by composite key."""
    c = table(spark, d, "customer")
    rich = c.filter("c_acctbal > 9500").join(table(spark, d, "nation"), F.col("c_nationkey") == F.col("n_nationkey")).groupBy(F.col("n_regionkey").alias("r_regionkey"), "c_mktsegment").agg(F.count("*").alias("rich"))
    every = audits.combinations(table(spark, d, "region").select("r_regionkey"), c.select("c_mktsegment").distinct())
    return audits.lookup(every, rich, ["r_regionkey", "c_mktsegment"])


@register(
    "appended_arms",
    """SELECT arm, count(*) AS n, count(balance) AS balances, count(name) AS names FROM (SELECT 'customer' AS arm, c_acctbal AS balance, NULL AS name FROM customer UNION ALL SELECT 'supplier', NULL, s_name FROM supplier) GROUP BY arm""",
)
def appended_arms(spark: SparkSession, d: str) -> DataFrame:
    """U4: rows of one arm after another's, columns by name."""
    from recordgauge.plans.evaluator import append

    a = table(spark, d, "customer").select(F.lit("customer").alias("arm"), F.col("c_acctbal").alias("balance"))
    b = table(spark, d, "supplier").select(F.lit("supplier").alias("arm"), F.col("s_name").alias("name"))
    return append(a, b).groupBy("arm").agg(F.count("*").alias("n"), F.count("balance").alias("balances"), F.count("name").alias("names"))


# --- metrics and orders -----------------------------------------------------------------


@register(
    "case_contributions",
    """SELECT l_orderkey, f AS feature, CAST(sum(CASE WHEN g IS NOT NULL THEN 1 ELSE 0 END) AS BIGINT) AS gold_appearances, CAST(sum(CASE WHEN g IS NOT NULL AND p IS NOT NULL AND g = p THEN 1 ELSE 0 END) AS BIGINT) AS "TP", CAST(sum(CASE WHEN p IS NOT NULL AND (g IS NULL OR g <> p) THEN 1 ELSE 0 END) AS BIGINT) AS "FP", CAST(sum(CASE WHEN g IS NOT NULL AND (p IS NULL OR g <> p) THEN 1 ELSE 0 END) AS BIGINT) AS "FN"
    FROM (SELECT l_orderkey, 'flag' AS f, l_returnflag AS g, CASE WHEN l_partkey % 3 = 0 THEN 'X' WHEN l_partkey % 3 = 1 THEN l_returnflag END AS p FROM lineitem UNION ALL SELECT l_orderkey, 'status', CASE WHEN l_suppkey % 2 = 0 THEN l_linestatus END, 'F' FROM lineitem) GROUP BY ALL""",
)
def case_contributions(spark: SparkSession, d: str) -> DataFrame:
    """Exact scores by report and feature, not summed over reports."""
    x = table(spark, d, "lineitem").select("l_orderkey", F.col("l_returnflag").alias("g1"), F.when(F.col("l_partkey") % 3 == 0, "X").when(F.col("l_partkey") % 3 == 1, F.col("l_returnflag")).alias("p1"), F.when(F.col("l_suppkey") % 2 == 0, F.col("l_linestatus")).alias("g2"), F.lit("F").alias("p2"))
    terms = [(f, F.col(g).isNotNull(), F.col(p).isNotNull(), F.col(g).eqNullSafe(F.col(p))) for f, g, p in (("flag", "g1", "p1"), ("status", "g2", "p2"))]
    return scoring.feature_events(x, terms, ["l_orderkey"])


_P, _R = "(sum(tp_a) / nullif(sum(tp_a) + sum(fp_a), 0))", "(sum(tp_a) / nullif(sum(tp_a) + sum(fn_a), 0))"


@register(
    "micro_from_ratios",
    f"""SELECT lang, CAST(sum(tp_a) AS BIGINT) AS "TP", CAST(sum(fp_a) AS BIGINT) AS "FP", CAST(sum(fn_a) AS BIGINT) AS "FN", round(coalesce({_P}, 0), 6) AS micro_precision, round(coalesce({_R}, 0), 6) AS micro_recall, round(coalesce(2 * {_P} * {_R} / nullif({_P} + {_R}, 0), 0), 6) AS micro_f1 FROM ({SQL_LABELS}) GROUP BY lang""",
)
def micro_from_ratios(spark: SparkSession, d: str) -> DataFrame:
    """Micro F1 from precision and recall."""
    e = label_events(spark, d).select("lang", *[F.col(f"{c}_a").alias(c) for c in ("TP", "FP", "FN")])
    m = metrics.micro_metrics(e, ["lang"])
    return m.select("lang", "TP", "FP", "FN", *[r6(c).alias(c) for c in ("micro_precision", "micro_recall", "micro_f1")])


def _universe_sql(arm: str, where: str) -> str:
    return f"(SELECT round(avg(x.f1), 6) AS macro, round(coalesce(2 * sum(x.tp) / nullif(2 * sum(x.tp) + sum(x.fp) + sum(x.fn), 0), 0), 6) AS micro, count(*) AS n FROM {arm} x WHERE {where})"


_SQL_EMPTY = "SELECT 'unseen' AS feature, 0::BIGINT AS gold_appearances, 0::BIGINT AS tp, 0::BIGINT AS fp, 0::BIGINT AS fn, 0.0::DOUBLE AS precision, 0.0::DOUBLE AS recall, 0.0::DOUBLE AS f1"


@register(
    "two_arm_summary",
    f"""WITH a AS ({sql_features("a")} UNION ALL {_SQL_EMPTY}), b AS ({sql_features("b")} UNION ALL {_SQL_EMPTY})
    SELECT w AS universe, CAST(n AS BIGINT) AS n_features, ma AS macro_a, mb AS macro_b, round(mb - ma, 5) AS macro_delta, ia AS micro_a, ib AS micro_b, round(ib - ia, 5) AS micro_delta FROM (
      SELECT 'all' AS w, x.n, x.macro AS ma, y.macro AS mb, x.micro AS ia, y.micro AS ib FROM {_universe_sql("a", "true")} x, {_universe_sql("b", "true")} y
      UNION ALL SELECT 'observed', x.n, x.macro, y.macro, x.micro, y.micro FROM {_universe_sql("a", "feature <> 'unseen'")} x, {_universe_sql("b", "feature <> 'unseen'")} y)""",
)
def two_arm_summary(spark: SparkSession, d: str) -> DataFrame:
    """Two arms over all features, and over those that gold or either arm shows."""
    e = label_events(spark, d)
    empty = spark.createDataFrame([("unseen", 0, 0, 0, 0, 0.0, 0.0, 0.0)], "feature string, gold_appearances long, TP long, FP long, FN long, precision double, recall double, f1 double")
    a, b = (arm_features(e, arm, ["feature"]).unionByName(empty) for arm in "ab")
    out = metrics.two_arms(a, b, "all").withColumn("universe", F.lit("all")).unionByName(metrics.two_arms(a, b, "observed").withColumn("universe", F.lit("observed")))
    return out.select("universe", "n_features", *[r6(c).alias(c) for c in ("macro_a", "macro_b")], F.round("macro_delta", 5).alias("macro_delta"), *[r6(c).alias(c) for c in ("micro_a", "micro_b")], F.round("micro_delta", 5).alias("micro_delta"))


@register(
    "report_orders",
    """WITH f AS (SELECT source, count(*) AS support, avg(n_chars) AS f1 FROM documents GROUP BY source), r AS (SELECT CASE doc_id % 3 WHEN 0 THEN 'sparse' WHEN 1 THEN 'dense' ELSE 'constrained' END AS regime, count(*) AS n FROM documents GROUP BY 1)
    SELECT (SELECT string_agg(source, ',' ORDER BY f1 DESC, source) FROM f) AS by_f1, (SELECT string_agg(source, ',' ORDER BY f1, source) FROM f) AS by_f1_up, (SELECT string_agg(source, ',' ORDER BY support DESC, source) FROM f) AS by_support, (SELECT string_agg(source, ',' ORDER BY source) FROM f) AS by_name, 'sparse,dense,constrained' AS by_regime FROM (SELECT 1)""",
)
def report_orders(spark: SparkSession, d: str) -> DataFrame:
    """Sort orders of report tables, ties by name; regimes in their stated order."""
    x = table(spark, d, "documents")
    f = x.groupBy("source").agg(F.count("*").alias("support"), F.avg("n_chars").alias("f1"))
    k = F.col("doc_id") % 3
    r = x.groupBy(F.when(k == 0, "sparse").when(k == 1, "dense").otherwise("constrained").alias("regime")).agg(F.count("*").alias("n"))

    def listed(df: DataFrame, c: str = "source") -> str:
        return ",".join(row[c] for row in df.select(c).collect())  # a report's rows

    row = (listed(reports.ordered(f, "f1", "source")), listed(reports.ordered(f, "f1", "source", largest=False)), listed(reports.ordered(f, "support", "source")), listed(f.orderBy("source")), listed(reports.by_category(r, "regime", reports.REGIMES), "regime"))
    return spark.createDataFrame([row], "by_f1 string, by_f1_up string, by_support string, by_name string, by_regime string")


@register(
    "pivot_regime_model",
    """WITH v AS (SELECT event_type AS feature, CASE WHEN event_id % 2 = 0 THEN 'sparse' ELSE 'dense' END AS regime, 'm' || user_id % 2 AS model, avg(value) AS v FROM events GROUP BY ALL)
    SELECT feature, round(max(CASE WHEN regime = 'sparse' AND model = 'm0' THEN v END), 6) AS "sparse | m0", round(max(CASE WHEN regime = 'sparse' AND model = 'm1' THEN v END), 6) AS "sparse | m1", round(max(CASE WHEN regime = 'dense' AND model = 'm0' THEN v END), 6) AS "dense | m0", round(max(CASE WHEN regime = 'dense' AND model = 'm1' THEN v END), 6) AS "dense | m1" FROM v GROUP BY feature""",
)
def pivot_regime_model(spark: SparkSession, d: str) -> DataFrame:
    """One column for each regime and model."""
    e = table(spark, d, "events").select(F.col("event_type").alias("feature"), F.when(F.col("event_id") % 2 == 0, "sparse").otherwise("dense").alias("regime"), F.concat(F.lit("m"), (F.col("user_id") % 2).cast("string")).alias("model"), "value")
    v = e.groupBy("feature", "regime", "model").agg(F.avg("value").alias("v"))
    names = [f"{r} | {m}" for r in ("sparse", "dense") for m in ("m0", "m1")]
    w = reports.wide_by(v, "feature", F.concat_ws(" | ", "regime", "model"), "v", names)
    return w.select("feature", *[F.round(F.col(f"`{c}`"), 6).alias(c) for c in names])
