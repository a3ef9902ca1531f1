"""Gates, the published bootstrap, the evaluator, stores, SQL functions: against plain versions."""

import json
import random
import zipfile

import numpy as np
import pytest
from pyspark.sql import functions as F

from recordgauge.functions import dates, equality, jsonx, registry, text
from recordgauge.operators import audits, bootstrap, decoder, gates, generation, matching, metrics, reports
from recordgauge.plans import evaluator
from recordgauge.session import cut, free, scratch
from recordgauge.sources import sinks


def test_numbered_over_all_rows(spark):
    r = random.Random(1)
    values = [(r.randint(0, 50), k) for k in range(3000)]
    df = spark.createDataFrame(values, "v int, k int").repartition(7)
    got = {(x.v, x.k): x.pos for x in audits.numbered(df, ["v", "k"]).collect()}
    assert [p for _, p in sorted(got.items())] == list(range(3000))
    assert audits.numbered(df.limit(0), ["v"]).count() == 0


@pytest.mark.parametrize("seed", range(5))
def test_order_statistics_against_numpy(spark, seed):
    r = random.Random(seed)
    values = [("ab"[r.randint(0, 1)], r.choice([None, *range(r.randint(1, 40))])) for _ in range(200)]
    df = spark.createDataFrame(values, "g string, v long")
    for by in ([], ["g"]):
        for row in metrics.token_stats(df, by, "v").join(metrics.length_stats(df, by, "v").select(*by, "p90", "p99"), by or None).collect():
            kept = sorted(v for g, v in values if v is not None and (not by or g == row.g))
            assert (row.total, row.n, row.min, row.max) == (sum(kept), len(kept), kept[0], kept[-1])
            assert np.isclose([row.mean, row.median, row.p90, row.p99], [np.mean(kept), np.median(kept), np.percentile(kept, 90), np.percentile(kept, 99)]).all()
            assert row.p95 == kept[round((len(kept) - 1) * 0.95)]


def test_evidence_keeps_null_groups(spark):
    df = spark.createDataFrame([(None, 3), (None, 1), ("a", 5), ("a", 4), ("a", 6)], "g string, v int")
    got = {r.g: (r.n, r["first"]) for r in reports.evidence(df, ["g"], "v", "v", 2).collect()}
    assert got == {None: (2, [1, 3]), "a": (3, [4, 5])}


def test_weights_are_the_generators(spark):
    rng = np.random.default_rng(9)
    sets = bootstrap.weight_sets(40, 11, 4, 9)
    for w, n in zip(sets, (11, 4, 7), strict=True):
        drawn = rng.integers(0, n, size=(40, n), dtype=np.int32)
        assert (w == np.array([np.bincount(x, minlength=n) for x in drawn])).all()


def test_published_bootstrap_against_a_plain_version(spark):
    r, n, features = random.Random(3), 30, ["a", "b", "none"]
    rows = []
    for config in ("x", "y"):
        for i in range(n):
            for f in features:
                g = int(f != "none" and i % 3 > 0)
                tp = int(g and r.random() < 0.6)
                rows.append(("m", config, i, i % 3 > 0, f, g, tp, int(r.random() < 0.3), g - tp))
    df = spark.createDataFrame(rows, "model string, config string, idx long, positive boolean, feature string, gold_appearances long, TP long, FP long, FN long")
    got = {(x.config, x.metric, x.feature): (x.point, x.ci_low, x.ci_high, x.n_valid) for x in bootstrap.published(df, n, {"y-x": ("x", "y")}, 300, 5).collect()}
    every, pos, neg = bootstrap.weight_sets(300, n, sum(i % 3 > 0 for i in range(n)), 5)
    cell = {(c, i, f): v for _, c, i, _, f, *v in rows}

    def f1(t):
        den = 2 * t[1] + t[2] + t[3]
        return 2 * t[1] / den if den else float("nan")

    def total(config, weights, fs, ids):
        return [sum(weights[k] * cell[config, i, f][c] for k, i in enumerate(ids) for f in fs) for c in range(4)]

    def interval(x):
        x = [v for v in x if v == v]
        return (np.percentile(x, 2.5), np.percentile(x, 97.5), len(x))

    ids, plus, minus = range(n), [i for i in range(n) if i % 3 > 0], [i for i in range(n) if i % 3 == 0]
    micro = {}
    for c in ("x", "y"):
        micro[c] = [f1(total(c, w, ["a", "b"], ids)) for w in every]
        weighted = []
        for w in every:
            parts = [total(c, w, [f], ids) for f in ("a", "b")]
            weighted.append(sum(t[0] * (f1(t) if f1(t) == f1(t) else 0) for t in parts) / sum(t[0] for t in parts))
        rate = [sum(w[k] * any(cell[c, i, f][2] for f in ("a", "b")) for k, i in enumerate(minus)) / len(minus) for w in neg]
        for metric, feature, point, boot in (
            ("micro_f1", None, f1(total(c, [1] * n, ["a", "b"], ids)), micro[c]),
            ("weighted_f1", None, None, weighted),
            ("feature_f1", "b", f1(total(c, [1] * n, ["b"], ids)), [f1(total(c, w, ["b"], ids)) for w in every]),
            ("positive_f1", None, None, [f1(total(c, w, ["a", "b"], plus)) for w in pos]),
            ("negative_fp_rate", None, None, rate),
        ):
            have = got[c, metric, feature]
            assert np.isclose(have[1:], interval(boot)).all() and (point is None or np.isclose(have[0], point))
    assert np.isclose(got["y-x", "delta:micro_f1", None][1:], interval([b - a for a, b in zip(micro["x"], micro["y"], strict=True)])).all()
    assert ("x", "feature_f1", "none") not in got
    with pytest.raises(ValueError):
        bootstrap.published(df, n, {}, limit=10)


def test_matrix_draws_do_not_depend_on_blocks(spark):
    c = spark.createDataFrame([(i, i % 2, 1, i % 3) for i in range(7)], "idx long, TP long, FP long, FN long")
    whole = sorted(map(tuple, bootstrap.matrix_distribution(c, 7, 60, block=60).collect()))
    assert whole == sorted(map(tuple, bootstrap.matrix_distribution(c, 7, 60, block=13).collect()))


def test_summary_getter_refuses_text(spark):
    df = spark.range(1).select(F.parse_json(F.lit('{"F1": "0.5", "n": 3}')).alias("s"))
    assert df.select(gates.numeric(F.col("s"), "n")).first()[0] == 3.0
    for name in ("F1", "absent"):
        with pytest.raises(Exception, match="no numeric"):
            df.select(gates.numeric(F.col("s"), name)).collect()


def test_number_texts_are_the_c_librarys(spark):
    values = [0.0, -0.0, 0.3125, 0.4375, 40.625, -46.875, 1e9 + 0.5, 0.0004, -0.0004, 2.5, 3.5, None, 123.456]
    df = spark.createDataFrame([(v,) for v in values], "v double")
    rows = df.select("v", text.rounded_text(F.col("v"), 3).alias("a"), text.signed(F.col("v")).alias("b"), text.fixed(F.col("v"), 2).alias("c")).collect()
    for r in rows:
        if r.v is None:
            assert r.c == ""
        else:
            assert (r.a, r.b, r.c) == (f"{r.v:.3f}", f"{r.v:+.2f}", f"{r.v:.2f}")


PAIRS = [("1.005", "1"), ("nan", "nan"), ("inf", "inf"), ("N/A", None), (" A  b", "a B"), ("3/2/22", "03/02/2022"), ("3/2022", "3/1/2022"), ("2022", "1/1/2022"), ("1_000", "1000.01"), ("x", "y"), ("", "none"), ("5", None), ("1e1", "10"), ("1d", "1"), ("2/29/2023", "2/29/2023"), ("0", "0.02")]


def test_sql_functions_agree_with_columns(spark):
    registry.register(spark)
    df = spark.createDataFrame(PAIRS, "a string, b string")
    df.createOrReplaceTempView("value_pairs")
    by_sql = spark.sql("SELECT a, b, values_equal(a, b) AS same, date_key(a) AS d FROM value_pairs").collect()
    by_column = df.select(equality.values_equal(F.col("a"), F.col("b")).alias("same"), dates.date_key(F.col("a")).alias("d"), equality.values_equal(F.col("a"), F.col("b"), "Nodules.Comparison Date").alias("dated")).collect()
    for (a, b), x, y in zip(PAIRS, by_sql, by_column, strict=True):
        assert x.same == y.same and x.d == y.d, (a, b)
        assert equality.plain_equal(a, b) == y.same and equality.plain_equal(a, b, "Comparison Date") == y.dated, (a, b)
    assert spark.sql("""SELECT validate_schema('{"Number of Nodules": -1}') AS v""").first().v.error_count == 1


def test_record_matching_of_one_report(spark):
    gold = [{"Series ID": 1, "Image ID": 2, "Lobe": "lingula"}, {"Lobe": "right upper lobe", "Type": "solid"}, {"Lobe": "left lower lobe"}]
    pred = [{"Lobe": "Right  upper lobe"}, {"Series ID": "1", "Image ID": "2.0"}, {"Type": "fat"}]
    want = [(0, 1, 1.0), (1, 0, 4 / 6)]
    assert matching.match_values(gold, pred) == want
    df = spark.createDataFrame([([json.dumps(x) for x in gold], [json.dumps(x) for x in pred]), (None, ["{}"])], "g array<string>, p array<string>")
    got = matching.match_records(df, "g", "p").collect()
    assert [tuple(m) for m in got[0].matches] == want and got[1].matches == []


def test_small_files_in_any_store(spark, tmp_path):
    path = f"file://{tmp_path}/a/b.json"
    sinks.put_json(spark, {"é": [1]}, path)
    assert json.loads((tmp_path / "a/b.json").read_text()) == {"é": [1]} and sinks.put_backup(spark, path) and not sinks.put_backup(spark, path)
    sinks.put_text(spark, "new", path)
    assert (tmp_path / "a/b.json").read_text() == "new" and json.loads((tmp_path / "a/b.json.bak").read_text()) == {"é": [1]}
    assert sorted(p.suffix for p in (tmp_path / "a").iterdir() if not p.name.startswith(".")) == [".bak", ".json"]
    with pytest.raises(FileExistsError):
        sinks.put_text(spark, "x", path, replace=False)


def test_workbook(spark, tmp_path):
    df = spark.createDataFrame([(1, "a<b&c", None), (2, None, 0.5)], "x int, y string, z double")
    sinks.write_sheets({"one": df, "ONE": df.limit(1), "a/b" * 20: df.limit(0)}, f"file://{tmp_path}/w.xlsx")
    raw = (tmp_path / "w.xlsx").read_bytes()
    got = sinks.read_workbook(raw)
    assert list(got) == ["one", "ONE~2", ("a_b" * 20)[:31]] and got["one"] == [["x", "y", "z"], ["1", "a<b&c", None], ["2", None, "0.5"]]
    assert zipfile.ZipFile(tmp_path / "w.xlsx").testzip() is None


def test_cuts_are_freed(spark):
    df = cut(spark.range(5))
    assert df.count() == 5
    free(df, spark.range(1))
    hadoop = spark._jvm.org.apache.hadoop.fs.Path(df._cut_path)
    assert not hadoop.getFileSystem(spark._jsc.sc().hadoopConfiguration()).exists(hadoop)
    assert scratch(spark) != scratch(spark)


def test_lookup_needs_unique_keys(spark):
    t = spark.createDataFrame([(1, "a"), (1, "b")], "k int, v string")
    with pytest.raises(ValueError, match="lookup"):
        audits.lookup(spark.range(2).withColumnRenamed("id", "k"), t, ["k"])
    with pytest.raises(ValueError, match="combinations"):
        audits.combinations(spark.range(2000), spark.range(2000))


def test_grammar_takes_what_the_schema_takes():
    text_ = generation.tagged_grammar({"type": "object", "properties": {"a": {"anyOf": [{"enum": ["x", 'q"']}, {"type": "null"}]}, "b": {"type": "array", "items": {"type": "integer"}, "maxItems": 2}}}, "<json>", "<\\json>")
    assert text_.split("\n")[0].startswith('root ::= "<json>\\n"') and '"\\n<\\\\json>"' in text_ and "{0,1}" in text_


def test_marked_tokenizer():
    tok = decoder.MarkedTokenizer(decoder.CharacterTokenizer())
    assert tok.audit() == {"unique": True, "single": True}
    ids = tok.encode('{"a": "<|lobe|>"}')
    assert len(ids) == len('{"a": ""}') + 1 and tok.decode(ids) == '{"a": "<|lobe|>"}'


def brute_case(gold, pred):
    """Case-wise score of two records of plain values, by enumeration of pairs."""
    g, p = gold.get("Nodules", []), pred.get("Nodules", [])
    matched = {i: j for i, j, _ in matching.match_values(g, p)}
    tp = fp = fn = 0.0
    for i, x in enumerate(g):
        x = {k: v for k, v in x.items() if not jsonx.is_null_value(v)}
        if i not in matched:
            fn += 2 * len(x)
            continue
        y = {k: v for k, v in p[matched[i]].items() if not jsonx.is_null_value(v)}
        for k in x.keys() | y.keys():
            if k not in y:
                fn += 2
            elif k not in x:
                fp += 2
            elif equality.plain_equal(x[k], y[k], k):
                tp += 2
            else:
                tp, fp, fn = tp + 1, fp + 0.5, fn + 0.5
    fp += sum(2 * sum(not jsonx.is_null_value(v) for v in y.values()) for j, y in enumerate(p) if j not in matched.values())
    return tp, fp, fn


def test_casewise_scores_by_brute_force(spark):
    r, rows = random.Random(7), []

    def finding(k):
        # a distinct size for each finding, so that the best assignment is the only one
        return {"Series ID": r.choice([None, 1, "1", 2]), "Image ID": r.choice([None, 3, 4]), "Lobe": r.choice(["lingula", "none", "Lingula ", "left lower lobe"]), "Long Axis (mm)": k + 0.5, "Comparison Date": r.choice(["3/2/22", "03/02/2022", "3/2022"])}

    for k in range(60):
        gold = {"Nodules": [finding(10 * i) for i in range(r.randint(0, 3))]}
        pred = {"Nodules": [{**x, "Lobe": r.choice([x["Lobe"], "right upper lobe"]), "Margin": r.choice(["smooth", None])} for x in gold["Nodules"] if r.random() < 0.8]}
        rows.append((k, json.dumps(gold), json.dumps(pred)))
    df = spark.createDataFrame(rows, "id long, gold string, prediction string")
    got = {x.id: (x.tp, x.fp, x.fn) for x in evaluator.casewise(df).collect()}
    want = {k: brute_case(json.loads(g), json.loads(p)) for k, g, p in rows}
    ties = [k for k in want if got[k] != want[k]]
    assert len(got) == 60 and not ties, [(k, got[k], want[k], rows[k]) for k in ties[:2]]
