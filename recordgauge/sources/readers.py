"""Readers (S1-S13). Schemas and file names are settled on the driver; data stay distributed."""

from __future__ import annotations

import json
from typing import Any

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

FORMATS = {"json": "json", "jsonl": "json", "csv": "csv", "parquet": "parquet"}


def files(spark: SparkSession, path: str) -> list[tuple[str, int]]:
    """(path, bytes) of what a path or glob names, through Spark's own file systems."""
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    fs = p.getFileSystem(spark._jsc.sc().hadoopConfiguration())
    return [(s.getPath().toString(), s.getLen()) for s in fs.globStatus(p) or []]


def require(spark: SparkSession, *paths: str, nonempty: bool = False) -> None:
    """S11."""
    for path in paths:
        found = files(spark, path)
        if not found or nonempty and not any(n for _, n in found):
            raise FileNotFoundError(path if not found else f"{path} is empty")


def whole_json(spark: SparkSession, path: str) -> DataFrame:
    """(pos, value): the members of a JSON array file, each as text; an object file is one member."""
    text = spark.read.text(path, wholetext=True).select(F.trim("value").alias("v"))
    members = F.when(F.col("v").startswith("["), F.from_json("v", "array<string>")).otherwise(F.array("v"))
    return text.select(F.posexplode(members).alias("pos", "value"))


def records(spark: SparkSession, path: str) -> DataFrame:
    """As whole_json, but the list must not be empty and hold objects only."""
    out = whole_json(spark, path)
    bad = out.agg(F.count("*").alias("n"), F.count_if(~F.coalesce(F.trim("value").startswith("{"), F.lit(False))).alias("odd")).first()
    if not bad["n"] or bad["odd"]:
        raise ValueError(f"{path}: {'no records' if not bad['n'] else 'not all records are objects'}")
    return out


def dataset(spark: SparkSession, path: str, schema: str | T.StructType | None = None, allowed: tuple[str, ...] = tuple(FORMATS)) -> DataFrame:
    """By the path's ending; jsonl reads as lines of JSON."""
    ending = path.rstrip("/").rsplit(".", 1)[-1].lower()
    if ending not in allowed:
        raise ValueError(f"unsupported format {ending!r}: one of {', '.join(allowed)}")
    reader = spark.read.format(FORMATS[ending])
    reader = reader.schema(schema) if schema else reader
    if ending == "csv":
        reader = reader.option("header", True)
    return reader.option("multiLine", ending == "json").load(path)


def feature_rows(df: DataFrame) -> DataFrame:
    """Feature rows with the needed columns, no repeated feature and strict numbers."""
    kinds = {"gold_appearances": "bigint", "TP": "bigint", "FP": "bigint", "FN": "bigint", "precision": "double", "recall": "double", "f1": "double"}
    if missing := [c for c in ("feature", *kinds) if c not in df.columns]:
        raise ValueError(f"missing columns: {', '.join(missing)}")
    if not df.groupBy("feature").count().filter("count > 1").isEmpty():
        raise ValueError("repeated features")
    return df.select("feature", *[F.col(c).cast(t).alias(c) for c, t in kinds.items()])


def by_directory(spark: SparkSession, root: str, name: str, schema: str | None = None) -> DataFrame:
    """root/*/name with the directory's name as column `model`; none is an error."""
    require(spark, f"{root}/*/{name}")
    reader = spark.read.schema(schema) if schema else spark.read
    return reader.option("multiLine", True).json(f"{root}/*/{name}").withColumn("model", F.regexp_extract(F.col("_metadata.file_path"), r"/([^/]+)/[^/]+$", 1))


def matrix(spark: SparkSession, patterns: dict[str, str], models: list[str], schema: str | None = None) -> DataFrame:
    """The union over (model, config) of patterns with {model}, with both as columns."""
    out = None
    for config, pattern in patterns.items():
        for model in models:
            part = dataset(spark, pattern.format(model=model), schema).withColumns({"model": F.lit(model), "config": F.lit(config)})
            out = part if out is None else out.unionByName(part, allowMissingColumns=True)
    return out


def csv(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """S9."""
    return spark.read.option("header", True).schema(schema).csv(path)


def first(df: DataFrame, n: int, order: str) -> DataFrame:
    """The first n rows before any work."""
    return df.orderBy(order).limit(n)


def load_schema(spark: SparkSession, path: str, section: str = "Lungs Pleura") -> dict[str, Any]:
    """A schema file, unwrapped from its section if it has one."""
    got = json.loads(spark.read.text(path, wholetext=True).first()["value"])
    return got.get(section, got) if isinstance(got, dict) else got


def schema_leaves(schema: Any, prefix: str = "") -> list[str]:
    """Dotted paths of the nodes with data_type and values; a list stands for its first element."""
    if isinstance(schema, list):
        return schema_leaves(schema[0], prefix) if schema else []
    if not isinstance(schema, dict):
        return []
    if {"data_type", "values"} <= schema.keys():
        return [prefix]
    return [leaf for k, v in schema.items() for leaf in schema_leaves(v, f"{prefix}.{k}" if prefix else k)]


def features(spark: SparkSession, names: list[str]) -> DataFrame:
    """A sorted dimension of feature names."""
    return spark.range(1).select(F.explode(F.array(*[F.lit(n) for n in sorted(set(names))])).alias("feature"))
