"""Readers and sinks on temporary files."""

import json

import pytest

from recordgauge.sources import readers, sinks


def test_whole_json_and_records(spark, tmp_path):
    p = tmp_path / "a.json"
    p.write_text('[{"a": 1}, {"a": {"b": "é"}}]')
    assert [(r.pos, json.loads(r.value)) for r in readers.records(spark, str(p)).collect()] == [(0, {"a": 1}), (1, {"a": {"b": "é"}})]
    p.write_text('{"a": 1}')
    assert readers.whole_json(spark, str(p)).count() == 1
    p.write_text("[1]")
    with pytest.raises(ValueError, match="objects"):
        readers.records(spark, str(p))
    p.write_text("[]")
    with pytest.raises(ValueError, match="no records"):
        readers.records(spark, str(p))


def test_dataset_formats(spark, tmp_path):
    (tmp_path / "x.jsonl").write_text('{"a": 1}\n{"a": 2}\n')
    (tmp_path / "x.json").write_text('[{"a": 1},\n {"a": 2}]')
    (tmp_path / "x.csv").write_text("a\n1\n2\n")
    spark.range(2).write.parquet(str(tmp_path / "x.parquet"))
    assert [readers.dataset(spark, str(tmp_path / f"x.{e}")).count() for e in ("jsonl", "json", "csv", "parquet")] == [2] * 4
    with pytest.raises(ValueError):
        readers.dataset(spark, "x.xml")
    with pytest.raises(ValueError):
        readers.dataset(spark, "x.jsonl", allowed=("json", "csv", "parquet"))


def test_directories_and_guards(spark, tmp_path):
    for m in ("m1", "m2"):
        (tmp_path / m).mkdir()
        (tmp_path / m / "s.json").write_text('{"f1": 0.5}')
    assert sorted(r.model for r in readers.by_directory(spark, str(tmp_path), "s.json").collect()) == ["m1", "m2"]
    with pytest.raises(FileNotFoundError):
        readers.by_directory(spark, str(tmp_path), "none.json")
    (tmp_path / "empty").write_text("")
    with pytest.raises(FileNotFoundError):
        readers.require(spark, str(tmp_path / "empty"), nonempty=True)
    got = readers.matrix(spark, {"a": f"{tmp_path}/{{model}}/s.json"}, ["m1", "m2"])
    assert {(r.model, r.config) for r in got.collect()} == {("m1", "a"), ("m2", "a")}


def test_feature_rows(spark):
    good = spark.createDataFrame([("a", "1", "1", "0", "0", "1.0", "1.0", "1.0")], "feature string, gold_appearances string, TP string, FP string, FN string, precision string, recall string, f1 string")
    assert readers.feature_rows(good).first().TP == 1
    with pytest.raises(ValueError, match="repeated"):
        readers.feature_rows(good.union(good))
    with pytest.raises(ValueError, match="missing"):
        readers.feature_rows(good.drop("f1"))


def test_schema_leaves():
    leaf = {"data_type": "x", "values": []}
    assert readers.schema_leaves({"A": {"Nodules": [{"Lobe": leaf}]}, "B": leaf, "C": 3}) == ["A.Nodules.Lobe", "B"]


def test_sinks(spark, tmp_path):
    df = spark.createDataFrame([(1, "é", 0.5)], "a int, b string, c double")
    sinks.write_csv(df, str(tmp_path / "c"))
    assert spark.read.option("header", True).csv(str(tmp_path / "c")).first().b == "é"
    with pytest.raises(ValueError):
        sinks.write_csv(df.limit(0), str(tmp_path / "d"))
    sinks.write_json(df, str(tmp_path / "o.json"), single=True)
    assert json.loads((tmp_path / "o.json").read_text()) == [{"a": 1, "b": "é", "c": 0.5}]
    assert sinks.backup_once(str(tmp_path / "o.json")) and not sinks.backup_once(str(tmp_path / "o.json"))
    with pytest.raises(FileExistsError):
        sinks.atomic_dump([], str(tmp_path / "o.json"), replace=False)
    assert sinks.fixed_decimals(df).first().c == "0.5000000000"
    assert sinks.csv_block(df, "t") == "=== t ===\na,b,c\n1,é,0.5\n"
    assert sinks.dense_path("/x/t.json") == "/x/t_dense.json" and sinks.dense_path("/x/t_dense.json", "/y") == "/y/t_dense.json"
    with pytest.raises(ValueError):
        sinks.dense_path("/x/t_dense.json")
