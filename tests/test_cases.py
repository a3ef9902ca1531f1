"""Cases scored in their rows, cohorts of any size under the published draws, texts compared once."""

import json
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from recordgauge.functions import equality
from recordgauge.operators import bootstrap, cases, matching
from recordgauge.plans import catalogue, evaluator

SF = "/root/testdata/sf0.001"
GOLD = {"Number of Nodules": 2, "Overall Lung-RADS": "2", "Nodules": [{"Series ID": 1, "Image ID": "4.0", "Lobe": "Lingula "}, {"Lobe": "left lower lobe", "Long Axis (mm)": 5.5, "Comparison Date": "3/2/22"}]}
PRED = {"Number of Nodules": "2", "Nodules": [{"Lobe": "left lower lobe", "Long Axis (mm)": "5.505", "Comparison Date": "03/02/2022"}, {"Series ID": "1", "Image ID": 4, "Margin": "smooth"}]}


def plan(df) -> str:
    return df._jdf.queryExecution().optimizedPlan().toString()


def frame(spark):
    return spark.createDataFrame([(1, json.dumps(GOLD), json.dumps(PRED)), (2, "{}", "x"), (3, None, json.dumps(PRED))], "id long, gold string, prediction string")


def test_no_case_meets_another(spark):
    """Nothing is joined, so nothing is broadcast through the driver or shuffled."""
    df = evaluator.casewise(frame(spark))
    assert "Join" not in plan(df) and "Aggregate" not in plan(df)
    assert {r.id: (r.tp, r.fp, r.fn, round(r.f1, 6)) for r in df.collect()} == {1: (10.0, 2.0, 2.0, round(10 / 12, 6)), 2: (0.0, 0.0, 0.0, 1.0), 3: (0.0, 12.0, 0.0, 0.0)}


def test_rescoring_keeps_its_rows(spark):
    """what was saved stays in the row, also of cases that share an id."""
    x = frame(spark).withColumnRenamed("prediction", "raw").withColumns({"prediction": F.lit("{}"), "prompt_tokens": F.lit(1), "completion_tokens": F.lit(1), **{c: F.lit(0.0) for c in ("tp", "fp", "fn")}})
    done = evaluator.rescored(x.unionByName(x))
    assert done.count() == 6 and evaluator.rescore_counts(done).first() == (6, 4, 4)


def test_features_are_summed_task_by_task(spark):
    """a task gives a row a feature, however many cases it holds."""
    df = frame(spark).filter("id < 3").coalesce(1)
    sums = cases.feature_sums(df)
    assert "Join" not in plan(sums) and sums.count() == len(evaluator.FEATURES)
    got = {r.feature: (r.gold_appearances, r.TP, r.FP, r.FN) for r in evaluator.feature_table(df).collect()}
    assert got["Number of Nodules"] == (1, 1, 0, 0) and got["Overall Lung-RADS"] == (1, 0, 0, 1) and got["Nodules.Lobe"] == (2, 1, 0, 1)
    assert got["Nodules.Margin"] == (0, 0, 1, 0) and got["Nodules.Comparison Date"] == (1, 1, 0, 0) and len(got) == len(evaluator.FEATURES)


def test_normal_values_are_the_columns(spark):
    texts = ["1.0005", "1.0015", " A \t b ", "nan", "-nan", "+inf", "-Infinity", "1_000", "1_", "1d", "1.e3", ".5", "N/A", "", "3/2/22", "3/2022", "2022", "2/30/2022", "true", "-0.0", "1e400", "123456789012345.6785", "x\x1cy", "İ", "　none "]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    for dated, digits in ((False, None), (False, 3), (True, None), (True, 3)):
        rows = df.select("t", equality.normalised(F.col("t"), "Comparison Date" if dated else None, digits).alias("v")).collect()
        for r in rows:
            want = None if r.v is None else (repr(r.v.num), r.v.txt, None if r.v.date is None else tuple(x for x in r.v.date if x is not None))
            have = cases.normal(r.t, dated, digits)
            assert (have and (repr(have[0]), *have[1:])) == want, (r.t, dated, digits)


@pytest.mark.parametrize("shape", [(1, 1), (1, 3), (3, 1), (2, 3), (3, 3)])
def test_pairs_in_a_row_are_the_relational_ones(spark, shape):
    r = np.random.default_rng(sum(shape))

    def found(k):
        return [{"Series ID": str(r.integers(0, 3)), **({"Image ID": "1"} if r.random() < 0.5 else {}), "Lobe": f"l{r.integers(0, 2)}", "Long Axis (mm)": str(10 * i + k)} for i in range(k)]

    for complete, key, weights in ((True, ("Series ID", "Image ID"), {"Lobe": 3.0, "Long Axis (mm)": 4.0, "Series ID": 0.5}), (False, ("Series ID", "Image ID"), {"Lobe": 3.0, "Long Axis (mm)": 4.0, "Series ID": 0.5})):
        sides = [found(k) for k in shape]
        tables = [spark.createDataFrame([(1, i, *[x.get(f) for f in ("Series ID", "Image ID", "Lobe", "Long Axis (mm)")]) for i, x in enumerate(s)], "id int, pos long, s string, i string, l string, a string") for s in sides]
        near = lambda g, p: matching.weighted_similarity([(g(c).isNotNull(), F.coalesce(g(c) == p(c), F.lit(False)), w) for c, w in (("s", 0.5), ("l", 3.0), ("a", 4.0))])
        m = matching.align(*tables, ["id"], ["s", "i"], "pos", near, complete=complete)
        inner = [[cases.values(x, tuple(x), None) for x in s] for s in sides]
        got = cases.pairs(*inner, key, weights, complete)
        want = {(x.gold_pos, x.pred_pos) for x in m.collect()}
        assert len(got) == len(want)
        assert sum(cases.similarity(inner[0][i], inner[1][j], weights) for i, j in got) == pytest.approx(sum(cases.similarity(inner[0][i], inner[1][j], weights) for i, j in want))


def test_cohorts_of_any_size(spark):
    """reports x features may exceed the bound on one report's cells, with the same figures."""
    r = np.random.default_rng(4)
    rows = [("m", c, i, i % 3 > 0, f, int(g), int(g and h), int(r.random() < 0.2), int(g and not h)) for c in "xy" for i in range(40) for f in "ab" for g, h in [(r.random() < 0.7, r.random() < 0.5)]]
    df = spark.createDataFrame(rows, "model string, config string, idx long, positive boolean, feature string, gold_appearances long, TP long, FP long, FN long")
    bound = bootstrap.published(df, 40, {"d": ("x", "y")}, 50, 5, limit=2 * 2 * 4)
    assert sorted(map(str, bound.collect())) == sorted(map(str, bootstrap.published(df, 40, {"d": ("x", "y")}, 50, 5).collect()))


def test_kinds_in_parts(spark, monkeypatch):
    """more kinds of reports than a task holds are taken in parts, with the same draws."""
    c = spark.createDataFrame([(i, i, i % 5, i % 3) for i in range(60)], "idx long, TP long, FP long, FN long")
    whole = sorted(map(tuple, bootstrap.matrix_distribution(c, 60, 30).collect()))
    monkeypatch.setattr(bootstrap, "PART_CELLS", 21)
    assert whole == sorted(map(tuple, bootstrap.matrix_distribution(c, 60, 30).collect()))


def test_draws_from_any_place_of_the_stream(spark, monkeypatch):
    """a block begins at its own place, words passed over included, and holds no more than a chunk of the draws."""
    n, more = 2_900_001, 1_700_003
    want = bootstrap.weight_sets(3, n, more, 11)
    monkeypatch.setattr(bootstrap, "CHUNK", 1 << 20)
    word, passed = 0, 0
    for w, size in zip(want, (n, more, n - more), strict=True):
        kinds = (np.arange(size) % 7).astype(np.int32)
        jobs, after = bootstrap.places(spark, 11, word, 3, size, 1)
        for b, first, skip in jobs:
            got = bootstrap.kind_counts(11, first, skip, 1, kinds, 7)[0]
            assert (got == np.bincount(kinds, weights=w[b], minlength=7)).all()
        passed, word = passed + after - word - 3 * size, after
    assert passed > 0


def test_reports_beyond_one_matrix(spark):
    """a cohort of two million reports, few of which have events."""
    n = 2_000_000
    c = spark.createDataFrame([(i, 1, 0, i // 1000 % 2) for i in range(0, n, 1000)], "idx long, TP long, FP long, FN long")
    got = dict(map(tuple, bootstrap.matrix_distribution(c, n, 2, seed=3).collect()))
    w = bootstrap.weights(np.random.default_rng(3), 2, n)[:, ::1000]
    assert got == {k: pytest.approx(2 * x.sum() / (2 * x.sum() + x[1::2].sum())) for k, x in enumerate(w)}


def test_records_are_dealt_over_the_cores(spark):
    """a small file's rows do not meet in one task."""
    assert catalogue.queries()["dense_contract_counts"](spark, SF).rdd.getNumPartitions() > 1


def test_texts_are_written_once_a_value(spark):
    """rows are counted by their values before texts are made of them."""
    first = plan(catalogue.queries()["tolerant_text_equality"](spark, SF))
    assert re.search(r"Aggregate \[l_linenumber#\d+, l_quantity#\d+D?, k#", first)
