"""Scalar semantics, JSON recovery, schema and slots."""

import json

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from recordgauge.functions import dates, equality, fields, jsonx, nulls, schema, slots, text


def values(spark, rows, kind="string"):
    return spark.createDataFrame([(r,) for r in rows], f"v {kind}").coalesce(1)


def column(df, c):
    return [r[0] for r in df.select(c).collect()]


def test_null_aliases(spark):
    null = [None, "", "   ", "null", "NULL", " Null ", "none", "None", " nOnE ", "N/A", "n/a"]
    kept = ["0", "0.0", "false", "negative", "absent", "no", "normal", "unknown", "not seen", "not identified"]
    assert column(values(spark, null + kept), nulls.is_null(F.col("v"))) == [True] * len(null) + [False] * len(kept)
    assert all(jsonx.is_null_value(v) for v in null) and not any(jsonx.is_null_value(v) for v in [*kept, 0, 0.0, False])


def test_dates(spark):
    pairs = [("3/2/2022", "03/02/2022", True), ("3/2/22", "03/02/2022", True), ("3/2022", "3/1/2022", False), ("2022", "1/1/2022", False), ("1/1/69", "1/1/1969", True), ("1/1/68", "1/1/2068", True)]
    df = spark.createDataFrame(pairs, "a string, b string, same boolean")
    got = df.select(dates.date_key(F.col("a")).eqNullSafe(dates.date_key(F.col("b"))).alias("x"), "same").collect()
    assert all(r.x == r.same for r in got)
    known = column(values(spark, ["2/29/2024", "2/29/2023", "13/1/2022", "0000", "0/2022", "x", None, " 2022 "]), dates.date_key(F.col("v")).isNotNull())
    assert known == [True, False, False, False, False, False, False, True]
    assert column(values(spark, ["Nodules.Comparison Date", "Follow-up Date", "Imaging Interval"]), dates.is_date_field(F.col("v"))) == [True, True, False]


def test_equality(spark):
    rows = [("1", "1.005", True), ("1", "1.02", False), ("a  b", " A b", True), (None, "none", True), (None, "0", False), ("nan", "nan", False), ("1d", "1", False), ("1_000", "1000", True), ("inf", "inf", False), ("x", "1", False)]
    df = spark.createDataFrame(rows, "a string, b string, same boolean").coalesce(1)
    got = df.select(equality.values_equal(F.col("a"), F.col("b")).alias("x"), "same", "a").collect()
    assert [r.x for r in got] == [r.same for r in got]
    day = df.limit(1).select(equality.values_equal(F.lit("3/2/22"), F.lit("03/02/2022"), "Comparison Date"), equality.values_equal(F.lit("3/2/22"), F.lit("03/02/2022"), "Lobe")).first()
    assert list(day) == [True, False]


def test_id_text(spark):
    raw = ["  'Ab 12.' ", "“007”", "[x-1]", None, "Image_ID: 5", "img #5"]
    assert column(values(spark, raw), text.clean_id(F.col("v"))) == ["Ab 12", "007", "x-1", "", "Image_ID: 5", "img #5"]
    assert column(values(spark, ["", "12", "a1", "abc", "1 2"]), text.id_format(F.col("v"))) == ["empty", "numeric", "alphanumeric", "other", "other"]
    assert column(values(spark, ["000", "0120", "0", "a0"]), text.strip_leading_zeros(F.col("v"))) == ["0", "120", "0", "a0"]
    assert column(values(spark, ["img #5", "series-7", "x"]), text.strip_id_prefix(F.col("v"))) == ["5", "7", "x"]


def test_ladder(spark):
    rows = [("id 12 here", "12", "strict_token"), ("a  b", "a b", "strict_ws_token"), ("AB", "ab", "relaxed_casefold"), ("x a b", "a-b", "none"), ("see 5", "img 5", "relaxed_prefix_stripped"), ("see 77 .", "k77z", "relaxed_digits"), ("see 77 .", "k077z", "relaxed_digits_no_zeros"), ("x12", "12", "none"), ("a\\Eb", "a\\Eb", "strict_token"), ("x", None, "none")]
    df = spark.createDataFrame(rows, "t string, v string, want string").coalesce(1)
    m = text.match_ladder(df, "t", "v")
    got = m.select(F.col("matched_by").alias("got"), F.col("span_start").alias("at"), text.context_excerpt(F.col("t"), F.col("span_start"), F.col("span_end")).alias("x"), "want").collect()
    assert [r.got for r in got] == [r.want for r in got]
    assert got[0].at == 3 and got[0].x == "id 12 here"


def test_policy_and_rewrite(spark):
    sparse, dense = " ".join(fields.SPARSE_MARKS), " ".join(fields.DENSE_MARKS)
    got = column(values(spark, [sparse, dense, sparse + dense, "", None]), text.classify_instruction(F.col("v")))
    assert got == ["sparse_omit_null", "dense_nullable", "conflicting_sparse_and_dense", "unrecognized", "unrecognized"]
    new = text.rewrite_once(F.col("v"), [("<s>", "<d>")], forbidden=("<s>",), required=("<d>",), strict=False)
    assert column(values(spark, ["a<s>", "a<s><s>", "a", "a<d>"]), new) == ["a<d>", None, None, "a<d>"]


def test_runaway(spark):
    rows = ["x" + "3" * 64, "x" + "3" * 63, "ab" + "1234567" * 10, " " * 500, "", None, "x" + "ab" * 31]
    assert column(values(spark, rows), text.runaway_suffix(F.col("v"))) == [True, False, True, False, False, False, False]


def test_json_recovery():
    assert jsonx.parse_object(' {"a": 1} ') == {"a": 1}
    assert jsonx.parse_object('so {"a": {"b": "}"}} ok') == {"a": {"b": "}"}}
    assert jsonx.parse_object("[1]") is None and jsonx.parse_any("[1]") == [1] and jsonx.parse_any("no") == {}
    assert jsonx.parse_tagged('<j>\n{"a":1}\n</j>', "<j>", "</j>") == {"exact_tags": True, "json_valid": True, "object": {"a": 1}}
    assert jsonx.parse_tagged('<j>{"a":1}</j> x', "<j>", "</j>")["exact_tags"] is False
    assert jsonx.balanced_fragment('a {"x": "\\"}"} b') == '{"x": "\\"}"}'
    assert jsonx.balanced_fragment("a { b") is None
    assert jsonx.parse_payload('```json\n{"a": 2}\n```')[0] == {"a": 2}
    assert jsonx.findings({"x": {"Nodules ": [{"Lobe": "left", "Type": "none"}, 3]}}) == [{"Lobe": "left"}]
    assert [p for p, _ in jsonx.walk_findings({"a": {"NODULES": [{}, 1, {}]}})] == ["$.a.NODULES[0]", "$.a.NODULES[2]"]


def test_normalise():
    n = jsonx.normalise_value
    assert n('{"Number of Nodules": 1, "Nodules": [{"Nodule ID": "1", "Calcification Patterns": "  none  "}]}') == {"Number of Nodules": 1, "Nodules": [{"Nodule ID": 1}]}
    assert n({"Number of Nodules": "0", "Nodules": [], "Overall Lung-RADS": None}) == {}
    assert n({"Number of Nodules": 0, "Overall Lung-RADS": "1"}) == {"Overall Lung-RADS": "1"}
    assert n({"Number of Nodules": 0, "Nodules": [{"Lobe": "lingula"}]})["Number of Nodules"] == 0
    assert jsonx.normalise_value({"num_nodule": "2", "long_axis": "1.5"}, canonical=True) == {"Number of Nodules": 2, "Long Axis (mm)": 1.5}
    source = {"A": [], "B": {}, "C": [None, "null"], "D": 2}
    assert jsonx.prune_value(source) == {"D": 2} and source["C"] == [None, "null"]
    assert n("nothing") == {}
    assert jsonx.leaf_counts({"a": None, "b": [1, "none"], "c": {}}) == (3, 4)
    assert jsonx.null_paths({"a": [{"b": ""}]}) == ["$.a[0].b"]
    assert [jsonx.count_status(v) for v in ({}, {"Number of Nodules": 1, "Nodules": [{}]}, {"Number of Nodules": 2, "Nodules": [{}]}, {"Number of Nodules": True})] == ["both_omitted", "consistent", "inconsistent", "uncheckable"]


json_values = st.recursive(st.none() | st.booleans() | st.integers(-9, 9) | st.sampled_from(["", " none", "x", "N/A"]), lambda c: st.lists(c, max_size=3) | st.dictionaries(st.sampled_from("abc"), c, max_size=3), max_leaves=12)


@settings(max_examples=200, deadline=None)
@given(json_values)
def test_prune_is_idempotent_and_leaves_no_null(v):
    once = jsonx.prune_value(v)
    assert jsonx.prune_value(once) == once
    if isinstance(once, dict) and once:
        assert jsonx.null_paths(once) == []


def test_json_columns(spark):
    df = values(spark, ['x {"a": "1", "Series ID": "7"} y', "no", None])
    got = df.select(jsonx.normalise_json(F.col("v")).alias("n"), jsonx.parse_object_json(F.col("v")).alias("o"), jsonx.tagged_json(F.col("v")).alias("t"), jsonx.leaf_counts_json(jsonx.safe_object_json(F.col("v"))).alias("c")).collect()
    assert [r.n for r in got] == ['{"Series ID":7,"a":"1"}', "{}", "{}"]
    assert [r.o is None for r in got] == [False, True, True] and got[0].c.leaves == 2 and not got[1].t.json_valid


def test_schema():
    s = {"properties": {"P": {"anyOf": [{"type": "string", "enum": ["central", "diffuse"]}, {"type": "null"}]}}, "additionalProperties": False}
    assert schema.validate_value({"P": None}, s)["valid"]
    bad = schema.validate_value({"P": "none"}, s)
    assert bad["error_count"] == 1 and bad["errors"][0]["path"] == "$.P"
    assert schema.validate_value([], s)["errors"][0]["validator"] is None
    assert schema.validate_value({"Q": 1}, s)["errors"][0]["validator"] == "additionalProperties"
    one = {"type": "object", "required": ["a"], "properties": {"a": {"type": "array", "minItems": 1, "maxItems": 2, "items": {"type": "integer", "minimum": 0, "maximum": 3}}}}
    assert [f.validator for f in schema.faults({"a": [-1, 4, True]}, one)] == ["maxItems", "minimum", "maximum", "type"]
    assert [f.validator for f in schema.faults({}, one)] == ["required"]
    assert schema.messages({"P": "none", "Q": 1}, s) == ["$.Q: additional property", "$.P: matches no branch"]
    assert schema.validate_value({"Nodules": [{"Calcification Patterns": "none"}]}, fields.raw_schema())["errors"][0]["path"] == "$.Nodules[0].Calcification Patterns"


def test_slots(spark):
    assert [slots.word_status("long_axis", w)[1] for w in ("12.5", "012", "1.23456", "null", "null3")] == [True, False, False, True, False]
    assert [slots.word_status("follow_up_date", w)[1] for w in ("3/10/2022", "7/7/22", "3/2022", "3 40", "2022/3/10")] == [True, True, True, False, False]
    assert not slots.word_status("comparison_date", "3/2022")[1] and not slots.word_status("num_nodule", "null")[1]
    assert all(slots.word_status("series", w)[1] for w in ("151", "2022", "4573")) and not slots.word_status("num_nodule", "4949")[0]
    for marker in fields.KEY_OF_MARKER:
        word = "7" if slots.slot_kind(marker) == "count" else "null"
        assert all(slots.word_status(marker, word[:k])[0] for k in range(len(word) + 1)), marker
    dense = json.loads(slots.MARK.sub("null", slots.template_text(1).replace("<|num_nodule|>", "1")))
    assert slots.dense_faults(dense) == []
    assert "list length differs from count" in slots.dense_faults(dense | {"Number of Nodules": "2"})
    assert "$: key order" in slots.dense_faults(dict(reversed(dense.items())))
    assert slots.template_audit(slots.dense_template(1), fields.raw_schema())["differences"] == {}
    with pytest.raises(ValueError):
        slots.dense_template(-1)
    got = column(values(spark, ["left", "null", "Left", None]), slots.slot_complete("lung", F.col("v")))
    assert got == [True, True, False, None]


def test_sql_registry(spark):
    from recordgauge.functions import registry

    names = registry.register(spark)
    got = spark.sql("""SELECT semantic_is_null(' None '), semantic_is_null('0'), full_year(22), f1_of(0D, 0D, 0D), numbers_equal(1D, 1.005D), normalize_record('x {"Series ID": "7", "b": ""}'), parse_object('no')""").first()
    assert list(got) == [True, False, 2022, 0.0, True, '{"Series ID":7}', None]
    rows = spark.sql("""SELECT path FROM iter_records('{"Nodules": [{"a": 1}, {"a": 2}]}')""").collect()
    assert [r.path for r in rows] == ["$.Nodules[0]", "$.Nodules[1]"] and "iter_records" in names
