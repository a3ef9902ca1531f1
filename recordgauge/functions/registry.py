"""The engine's functions by name for SQL sessions."""

from __future__ import annotations

import json

from pyspark.sql import SparkSession
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf

from recordgauge.functions import fields, jsonx, schema
from recordgauge.operators import matching

#: Scalar functions in SQL itself: the optimizer inlines them.
SQL_FUNCTIONS = {
    "semantic_is_null": ("v STRING", "BOOLEAN", "v IS NULL OR lower(regexp_replace(v, '(?U)\\\\A\\\\s+|\\\\s+\\\\z', '')) IN ('', 'null', 'none', 'n/a')"),
    "full_year": ("y INT", "INT", "CASE WHEN y <= 68 THEN 2000 + y ELSE 1900 + y END"),
    "safe_div": ("a DOUBLE, b DOUBLE", "DOUBLE", "coalesce(try_divide(a, b), 0D)"),
    "f1_of": ("tp DOUBLE, fp DOUBLE, fn DOUBLE", "DOUBLE", "coalesce(try_divide(2 * tp, 2 * tp + fp + fn), 0D)"),
    "date_key": (
        "v STRING",
        "STRUCT<precision: STRING, y: INT, m: INT, d: INT>",
        """element_at(transform(array(trim(v)), s -> CASE WHEN s RLIKE '\\\\A(?:[0-9]{1,2}/[0-9]{1,2}/(?:[0-9]{2}|[0-9]{4})|[0-9]{1,2}/[0-9]{4}|[0-9]{4})\\\\z' THEN
          element_at(transform(array(struct(transform(split(s, '/'), x -> CAST(x AS INT)) AS n, s RLIKE '/[0-9]{2}\\\\z' AS short)), a -> element_at(transform(array(struct(a.n AS n, CASE WHEN a.short AND get(a.n, 2) <= 68 THEN 2000 + get(a.n, 2) WHEN a.short THEN 1900 + get(a.n, 2) ELSE get(a.n, 2) END AS year)), b ->
            CASE WHEN size(b.n) = 3 AND b.year >= 1 AND try_make_timestamp(b.year, get(b.n, 0), get(b.n, 1), 0, 0, 0) IS NOT NULL THEN named_struct('precision', 'day', 'y', b.year, 'm', get(b.n, 0), 'd', get(b.n, 1))
              WHEN size(b.n) = 2 AND get(b.n, 0) BETWEEN 1 AND 12 AND get(b.n, 1) >= 1 THEN named_struct('precision', 'month', 'y', get(b.n, 1), 'm', get(b.n, 0), 'd', CAST(NULL AS INT))
              WHEN size(b.n) = 1 AND get(b.n, 0) >= 1 THEN named_struct('precision', 'year', 'y', get(b.n, 0), 'm', CAST(NULL AS INT), 'd', CAST(NULL AS INT)) END), 1)), 1) END), 1)""",
    ),
    "normal_value": (
        "v STRING",
        "STRUCT<num: DOUBLE, txt: STRING>",
        """element_at(transform(array(lower(regexp_replace(regexp_replace(v, '(?U)\\\\s+', ' '), '\\\\A | \\\\z', ''))), s -> CASE WHEN s NOT IN ('', 'null', 'none', 'n/a') THEN
          named_struct('num', CASE WHEN s RLIKE '\\\\A[+-]?(?:(?:[0-9]+(?:_[0-9]+)*[.]?(?:[0-9]+(?:_[0-9]+)*)?|[.][0-9]+(?:_[0-9]+)*)(?:e[+-]?[0-9]+(?:_[0-9]+)*)?|inf(?:inity)?|nan)\\\\z' THEN try_cast(replace(s, '_', '') AS DOUBLE) END, 'txt', s) END), 1)""",
    ),
    "values_equal": (
        "a STRING, b STRING",
        "BOOLEAN",
        """element_at(transform(array(struct(normal_value(a) AS x, normal_value(b) AS y)), p -> CASE WHEN p.x IS NULL AND p.y IS NULL THEN true WHEN p.x IS NULL OR p.y IS NULL THEN false
          WHEN p.x.num IS NOT NULL AND p.y.num IS NOT NULL THEN NOT isnan(p.x.num) AND NOT isnan(p.y.num) AND abs(p.x.num - p.y.num) <= 0.01D ELSE p.x.num IS NULL AND p.y.num IS NULL AND p.x.txt = p.y.txt END), 1)""",
    ),
    "numbers_equal": ("a DOUBLE, b DOUBLE", "BOOLEAN", "CASE WHEN a IS NULL AND b IS NULL THEN true WHEN a IS NULL OR b IS NULL THEN false ELSE abs(a - b) <= 0.01D END"),
}


def text_function(f, kind: str):
    """A pandas function over one text, for registration."""
    import pandas as pd

    def run(s: pd.Series) -> pd.Series:
        import pandas as pd

        return pd.Series([f(v) for v in s], dtype=object)

    run.__annotations__ = {"s": pd.Series, "return": pd.Series}
    return pandas_udf(run, kind)


def validator(record_schema: dict):
    """V1 over JSON text, for registration: struct(valid, error_count, errors)."""
    import pandas as pd

    def run(s: pd.Series) -> pd.DataFrame:
        import pandas as pd

        return pd.DataFrame.from_records([schema.validate_value(jsonx.parse_object(v), record_schema) for v in s], columns=["valid", "error_count", "errors"])

    run.__annotations__ = {"s": pd.Series, "return": pd.DataFrame}
    return pandas_udf(run, schema.RESULT)


class AssignRecords:
    """UDTF: (gold_pos, pred_pos, similarity) of two lists of records: equal keys first, then the best assignment."""

    def eval(self, gold: list, pred: list):
        parsed = [[jsonx.loads(t) for t in side or []] for side in (gold, pred)]
        g, p = [[x if isinstance(x, dict) else {} for x in side] for side in parsed]
        yield from matching.match_values(g, p)


class IterRecords:
    """UDTF: (path, value) of the records in a JSON text."""

    def eval(self, text: str):
        got = jsonx.loads(text)
        for path, x in jsonx.walk_findings(None if got is jsonx.MISSING else got):
            yield path, jsonx.dumps(x)


def register(spark: SparkSession, record_schema: dict | None = None) -> list[str]:
    """Register all functions in the session; returns their names."""
    record_schema = record_schema or fields.raw_schema()
    for name, (args, kind, body) in SQL_FUNCTIONS.items():
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {name}({args}) RETURNS {kind} RETURN {body}")
    texts = {
        "parse_object": (lambda v: None if (got := jsonx.parse_object(v)) is None else jsonx.dumps(got), "string"),
        "normalize_record": (lambda v: jsonx.dumps(jsonx.normalise_value(v)), "string"),
        "balanced_fragment": (lambda v: jsonx.balanced_fragment(v or ""), "string"),
        "validate_record": (lambda v: json.dumps(schema.validate_value(jsonx.parse_object(v), record_schema)), "string"),
    }
    for name, (f, kind) in texts.items():
        spark.udf.register(name, text_function(f, kind))
    spark.udf.register("validate_schema", validator(record_schema))
    spark.udtf.register("iter_records", F.udtf(IterRecords, returnType="path string, value string"))
    spark.udtf.register("assign_records", F.udtf(AssignRecords, returnType="gold_pos int, pred_pos int, similarity double"))
    return [*SQL_FUNCTIONS, *texts, "validate_schema", "iter_records", "assign_records"]
