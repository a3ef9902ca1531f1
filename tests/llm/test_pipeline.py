"""The corpus pipeline against a plain version on a small table."""

import random

import pytest

import corpus_pipeline
from recordgauge.llm import bpe, decontaminate, quality
from test_llm_operators import brute_lines, brute_near


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    r = random.Random(21)
    word = lambda: "".join(r.choice("aeinrst") for _ in range(r.randint(2, 7)))
    say = lambda n: " ".join(word() for _ in range(n))
    item = say(20)
    texts = [f"All rights reserved.\n{say(60)}\n{say(20)}" for _ in range(90)] + [" ".join(word().upper() + "!!" for _ in range(80)) for _ in range(40)]
    texts += [texts[0], texts[0] + " x", f"{say(40)} {item} {say(10)}", "short one", ""]
    root = tmp_path_factory.mktemp("sf")
    rows = [(k, t, "en", "s", len(t)) for k, t in enumerate(texts)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(str(root / "documents.parquet"))
    spark.createDataFrame([(k, int(k < 90), 0) for k in range(130)], "doc_id long, quality int, toxic int").write.parquet(str(root / "labels.parquet"))
    spark.createDataFrame([(0, item)], "item_id long, text string").write.parquet(str(root / "benchmark.parquet"))
    return str(root), texts, item


def test_stages_by_brute_force(spark, folder):
    root, texts, item = folder
    docs, labels = spark.read.parquet(f"{root}/documents.parquet"), spark.read.parquet(f"{root}/labels.parquet")
    sizes = quality.fit(docs, labels)
    scores = {r.doc_id: r["__score"] for r in quality.score(docs, sizes).collect()}
    kept = [(k, t) for k, t in enumerate(texts) if scores[k] >= quality.THRESHOLD]
    assert sum(k < 90 for k, _ in kept) >= 80 and sum(90 <= k < 130 for k, _ in kept) <= 4
    lines = [(k, x[2]) for (k, _), x in zip(kept, brute_lines([t for _, t in kept]), strict=True)]
    near = [(k, t) for (k, t), (_, _, c) in zip(lines, brute_near(lines), strict=True) if k == c]
    index = decontaminate.Index([(0, item)])
    clean = [(k, t) for k, t in near if not index.matches(t)]
    assert len(near) - len(clean) == 1
    path, pattern = bpe.tokenizer()
    want = {k: bpe.brute(t, path, pattern) for k, t in clean}
    got = {r.doc_id: (r.n_tokens, r.ids_sha256, r.decoded_sha256) for r in corpus_pipeline.run(spark, root).collect()}
    assert got == want


def test_stage_columns(spark, folder):
    root, *_ = folder
    docs = spark.read.parquet(f"{root}/documents.parquet")
    for _, stage in corpus_pipeline.STAGES[:-1]:
        assert stage(spark, docs.limit(0), root).columns == docs.columns
        assert stage(spark, docs.limit(0), root).count() == 0
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality_classifier", "line_dedup", "minhash_near_dedup", "benchmark_decontamination", "byte_bpe"]


def test_odd_rows_pass_every_stage(spark, folder, tmp_path):
    """Nulls in every column, empty and very long texts, repeated rows, further columns: nothing fails, clean rows stay."""
    root, texts, _ = folder
    good = texts[3]
    long = " ".join(f"{t} {k}" for k, t in enumerate(texts[5:60]))
    rows = [(k, t, "en", "s", len(t)) for k, t in enumerate(texts)]
    odd = [(1000, None, None, None, None), (1001, "", "en", "s", 0), (None, "a text without an id " * 30, "en", "s", 1), (1003, long, None, "s", len(long)), (1004, good + " end", "en", "s", 1), (1004, good + " end", "en", "s", 1), (1005, " \t\n", "en", "s", 3)]
    df = spark.createDataFrame(rows + odd, "doc_id long, text string, lang string, source string, n_chars long")
    df.selectExpr("*", "'x' AS row", "1 AS `__row`", "array(1) AS key").write.parquet(str(tmp_path / "documents.parquet"))
    for name in ("labels", "benchmark"):
        spark.read.parquet(f"{root}/{name}.parquet").write.parquet(str(tmp_path / f"{name}.parquet"))
    docs = spark.read.parquet(str(tmp_path / "documents.parquet"))
    kept = docs
    for _, stage in corpus_pipeline.STAGES[:-1]:
        kept = stage(spark, kept, str(tmp_path))
        assert kept.columns == docs.columns
    texts_by = {}
    for r in kept.collect():
        texts_by.setdefault(r.doc_id, []).append(r.text)
    scores = {r.doc_id: r["__score"] for r in quality.score(docs, quality.fit(docs, spark.read.parquet(f"{root}/labels.parquet"))).collect()}
    empty_stays = scores[1001] >= quality.THRESHOLD
    assert (1000 in texts_by) == (1001 in texts_by) == empty_stays
    assert (None in texts_by) == (scores[None] >= quality.THRESHOLD) and (1003 in texts_by) == (scores[1003] >= quality.THRESHOLD)
    out = {r.doc_id: r for r in corpus_pipeline.run(spark, str(tmp_path)).collect()}
    assert set(out) == set(texts_by)
    if empty_stays:
        assert out[1000].n_tokens == out[1001].n_tokens == 0


def test_empty_tables(spark, folder, tmp_path):
    root, *_ = folder
    for name in ("documents", "labels", "benchmark"):
        spark.read.parquet(f"{root}/{name}.parquet").limit(0).write.parquet(str(tmp_path / f"{name}.parquet"))
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0
