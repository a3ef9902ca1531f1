"""Matching, scores, metrics, bootstrap, audits, reports, decoder and streams."""

import itertools
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from recordgauge.operators import audits, bootstrap, decoder, generation, matching, metrics, reports, scoring


def test_assignment_against_brute_force():
    r = np.random.default_rng(4)
    for _ in range(200):
        n, m = map(int, r.integers(1, 5, 2))
        c = -r.random((n, m)).round(2)
        got, k = matching.assign(c), min(n, m)
        best = min(sum(c[i, j] for i, j in zip(a, b, strict=True)) for a in itertools.combinations(range(n), k) for b in itertools.permutations(range(m), k))
        assert len(got) == k and abs(sum(c[i, j] for i, j in got) - best) < 1e-9


def test_rank_join_is_sequential_greedy(spark):
    rnd, gold, pred, want = random.Random(2), [], [], []
    for rep in range(60):
        g = [rnd.choice([None, "a", "b"]) for _ in range(rnd.randint(0, 6))]
        p = [rnd.choice([None, "a", "b"]) for _ in range(rnd.randint(0, 6))]
        used = set()
        for i, k in enumerate(g):
            j = next((j for j, x in enumerate(p) if x == k and k is not None and j not in used), None)
            if j is not None:
                used.add(j)
                want.append((rep, i, j))
        gold += [(rep, i, k) for i, k in enumerate(g)]
        pred += [(rep, j, k) for j, k in enumerate(p)]
    s = "rep int, pos int, k string"
    got = matching.key_matches(spark.createDataFrame(gold, s), spark.createDataFrame(pred, s), ["rep"], ["k"], "pos")
    assert sorted(tuple(r) for r in got.collect()) == sorted(want)


def test_align_drops_weak_pairs_after_the_assignment(spark):
    g = spark.createDataFrame([(1, 0, None, "x"), (1, 1, 5, "y"), (1, 2, None, "w")], "rep int, pos int, k int, v string")
    p = spark.createDataFrame([(1, 0, 5, "q"), (1, 1, None, "x"), (2, 0, None, "x")], "rep int, pos int, k int, v string")
    sim = lambda a, b: matching.weighted_similarity([(a("v").isNotNull(), a("v").eqNullSafe(b("v")), 1.0)])
    got = sorted((r.rep, r.gold_pos, r.pred_pos, r.similarity) for r in matching.align(g, p, ["rep"], ["k"], "pos", sim).collect())
    assert got == [(1, 0, 1, 1.0), (1, 1, 0, 1.0)]


def test_partial_credit_example(spark):
    rows = [("1", "1.005"), ("x", "y"), ("2", None), (None, "9")]
    df = spark.createDataFrame(rows, "g string, p string")
    from recordgauge.functions.equality import values_equal

    c = scoring.partial_credit(F.col("g").isNotNull(), F.col("p").isNotNull(), values_equal(F.col("g"), F.col("p")))
    s = scoring.case_scores(df.select(F.lit(1).alias("rep"), *[v.alias(k) for k, v in c.items()]), ["rep"]).first()
    assert (s.tp, s.fp, s.fn) == (3.0, 2.5, 2.5) and abs(s.f1 - 6 / 11) < 1e-12 and s.iou == 0.375
    e = scoring.feature_events(df, [("f", F.col("g").isNotNull(), F.col("p").isNotNull(), values_equal(F.col("g"), F.col("p")))], []).first()
    assert (e.gold_appearances, e.TP, e.FP, e.FN) == (3, 1, 2, 2)


def test_empty_policies(spark):
    z = spark.createDataFrame([(0.0, 0.0, 0.0)], "tp double, fp double, fn double")
    for empty in (1.0, 0.0, None):
        assert z.select(scoring.ratios(F.col("tp"), F.col("fp"), F.col("fn"), empty)["f1"]).first()[0] == empty


def test_feature_without_events(spark):
    e = spark.createDataFrame([("a", 2, 1, 1, 1)], "feature string, gold_appearances long, TP long, FP long, FN long")
    names = spark.createDataFrame([("a",), ("b",)], "feature string")
    got = {r.feature: r for r in scoring.feature_scores(e, names).collect()}
    assert got["a"].f1 == 0.5 and got["b"].f1 == 0.0 and got["b"].TP == 0
    assert metrics.summary(scoring.feature_scores(e, names), which="supported").first().macro_f1 == 0.5


@pytest.mark.parametrize("values", [[5], [1, 2, 3, 4], [None, 7, 9], list(range(100)), [3, 3, 3], []])
def test_token_stats(spark, values):
    df = spark.createDataFrame([("g", v) for v in values], "g string, v long")
    got, kept = metrics.token_stats(df, ["g"], "v").collect(), sorted(v for v in values if v is not None)
    assert len(got) == bool(values)
    if kept:
        assert got[0].p95 == kept[round((len(kept) - 1) * 0.95)] and got[0].total == sum(kept)


def test_bootstrap_relational_equals_matrix(spark):
    rows = [(i, f, 1, i % 2, (i + 1) % 2, f_ % 2) for i in range(4) for f_, f in enumerate("ab")]
    c = spark.createDataFrame(rows, "idx long, feature string, gold_appearances long, TP long, FP long, FN long")
    w = bootstrap.draws(spark, 30, 4)
    got = {r["iter"]: r.f1 for r in bootstrap.micro_distribution(c, w).collect()}
    m = np.zeros((30, 4))
    for r in w.collect():
        m[r["iter"], r.idx] = r.w
    assert (m.sum(axis=1) == 4).all()
    per = np.array([[sum(r[k] for r in rows if r[0] == i) for k in (3, 4, 5)] for i in range(4)])
    t = m @ per
    assert all(abs(got[b] - 2 * t[b, 0] / (2 * t[b, 0] + t[b, 1] + t[b, 2])) < 1e-12 for b in range(30))
    one = {r["iter"]: r.f1 for r in bootstrap.matrix_distribution(c, 4, iterations=120, block=50, seed=3).collect()}
    drawn = bootstrap.weights(np.random.default_rng(3), 120, 4)
    # the same multiplicities through the relational path give the same replicates
    rows = [(b, i, int(drawn[b, i])) for b in range(120) for i in range(4) if drawn[b, i]]
    same = {r["iter"]: r.f1 for r in bootstrap.micro_distribution(c, spark.createDataFrame(rows, "iter long, idx long, w long")).collect()}
    assert len(one) == 120 and all(abs(one[b] - same[b]) < 1e-12 for b in range(120))
    assert bootstrap.paired_delta(bootstrap.micro_distribution(c, w), bootstrap.micro_distribution(c, w)).filter("f1 <> 0").isEmpty()


def test_audits(spark):
    a = spark.createDataFrame([(1, 0, "x"), (2, 1, "y"), (3, 2, None)], "id int, pos int, v string")
    b = spark.createDataFrame([(1, 0, "x"), (2, 1, "z"), (4, 2, None)], "id int, pos int, v string")
    r = audits.pair_audit(a, b, ["id"], ["v"]).first()
    assert (r.common, r.only_a, r.only_b, r.differs_v) == (2, 1, 1, 1)
    assert audits.same_examples(a, a, ["id"], ["v"]).first().same and not audits.same_examples(a, b, ["id"], ["v"]).first().same
    swapped = a.withColumn("pos", 2 - F.col("pos"))
    assert not audits.same_examples(a, swapped, ["id"], ["v"]).first().same
    rep = audits.repeat_check(a, b, ["id"], ["v"]).first()
    assert rep.n_differ == 3 and not rep.reproducible and [x.id for x in rep["first"]] == [2, 3, 4]
    with pytest.raises(ValueError):
        audits.require_unique(a.union(a), ["id"], "arm")
    s = audits.dataset_pair_audit(a.withColumn("c", F.lit(1)), b.withColumn("c", F.lit(1)), "v", ["c"]).first()
    assert s.content_differs == 0 and s.shared_digests == 2


def test_reports(spark):
    df = spark.createDataFrame([("a", "m", 1.0), ("a", "n", 3.0), ("b", "m", 5.0)], "f string, model string, v double")
    w = reports.wide_by(df, "f", "model", "v", ["m", "n"]).collect()
    assert [(r.f, r.m, r.n) for r in w] == [("b", 5.0, None), ("a", 1.0, 3.0)]
    assert reports.markdown(spark.range(1)) == "| id |\n| --- |\n| 0 |"
    wide = spark.createDataFrame([(1, 2, 3)], "x int, max_new_tokens int, f1 int")
    assert reports.preferred_columns(wide, ["f1"]).columns == ["f1", "max_new_tokens", "x"]
    e = reports.effects(spark.createDataFrame([("m", "sparse", 1.0), ("m", "dense", 3.0), ("m", "constrained", 4.0)], "model string, regime string, v double"), ["model"], "regime", "v").first()
    assert (e.prompt_effect, e.constraint_effect, e.end_to_end_effect) == (2.0, 1.0, 3.0)


def test_decoder():
    rt = decoder.Runtime(decoder.CharacterTokenizer())
    for n in (0, 1, 2):
        path = rt.render(n)
        s = rt.replay(path)
        assert s.count == n and rt.action(s).kind == "complete" and rt.replay([*path, 2]).ended
        with pytest.raises(decoder.TemplateError):
            rt.replay([*path, 2, 2])
    first = rt.replay(rt.tokenizer.encode('{"Number of Nodules": "'))
    assert chr(rt.action(first).allowed[-1] - 10) == "9" and rt.action(first).kind == "candidate"
    with pytest.raises(decoder.TemplateError):
        rt.program(50)
    lobe = rt.replay(rt.render(1)[: rt.tokenizer.decode(rt.render(1)).index('"Lobe": "') + 9])
    assert {chr(t - 10) for t in rt.action(lobe).allowed} == set("rln")
    assert rt.trace(rt.render(2))[0] == {"pos": 0, "slot": "Number of Nodules", "value": "2", "expanded_to": 2}
    assert decoder.cached_runtime(decoder.CharacterTokenizer()) is decoder.cached_runtime(decoder.CharacterTokenizer())


def test_sampling_inside_the_legal_set():
    logits = np.array([9.0, 1.0, 2.0, 3.0])
    assert decoder.Sampling(top_p=0.5).choose(logits, [], [1, 2, 3]).argmax() == 3
    assert decoder.Sampling(repetition=10.0).choose(logits, [3], [1, 2, 3]).argmax() == 2
    assert decoder.Sampling().choose(np.zeros(4), [], [3, 1]).argmax() == 1
    with pytest.raises(ValueError):
        decoder.Sampling(top_p=0)


def test_generation_retries_and_fails(spark):
    df = spark.createDataFrame([("a",), ("b",)], "prompt string")
    assert sorted(r.completion for r in generation.generate(df, str.upper).collect()) == ["A", "B"]

    def broken(_):
        raise OSError("down")

    with pytest.raises(Exception, match="down"):
        generation.generate(df, broken, attempts=2, pause=0.0).collect()


def test_stream_scores_equal_batch_scores(spark, tmp_path):
    from recordgauge.streaming import scores

    df = spark.range(200).select((F.col("id") % 3).cast("string").alias("feature"), F.timestamp_seconds(F.col("id") + 1_700_000_000).alias("ts"), F.lit(1).cast("long").alias("gold_appearances"), (F.col("id") % 2).alias("TP"), F.lit(0).cast("long").alias("FP"), (1 - F.col("id") % 2).alias("FN"))
    df.write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(df.schema).parquet(str(tmp_path / "in"))
    q = scores.running_scores(stream, "ts").writeStream.outputMode("complete").format("memory").queryName("running").option("checkpointLocation", str(tmp_path / "c")).start()
    q.processAllAvailable()
    q.stop()
    batch = {r.feature: (r.TP, r.FN) for r in scoring.feature_scores(df).collect()}
    assert {r.feature: (r.TP, r.FN) for r in spark.table("running").collect()} == batch


def test_windowed_stream_scores(spark, tmp_path):
    from recordgauge.streaming import scores

    df = spark.range(7200).select((F.col("id") % 3).cast("string").alias("feature"), F.timestamp_seconds(F.col("id") * 2 + 1_700_000_000).alias("ts"), F.lit(1).cast("long").alias("gold_appearances"), (F.col("id") % 2).alias("TP"), F.lit(0).cast("long").alias("FP"), (1 - F.col("id") % 2).alias("FN"))
    df.write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(df.schema).parquet(str(tmp_path / "in"))
    q = scores.windowed_scores(stream, "ts").writeStream.outputMode("update").format("memory").queryName("windowed").option("checkpointLocation", str(tmp_path / "c")).start()
    q.processAllAvailable()
    q.stop()
    want = {(r.hour, r.feature): r.TP for r in df.groupBy(F.window("ts", "1 hour").start.alias("hour"), "feature").agg(F.sum("TP").alias("TP")).collect()}
    assert {(r.window.start, r.feature): r.TP for r in spark.table("windowed").collect()} == want
