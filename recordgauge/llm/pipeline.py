"""A training corpus from raw documents, in five stages.

Each stage takes (spark, docs, sf_dir) and works on all that its predecessor kept; its
result is written as Parquet and read again, and the one before goes. Stages but the last
return the columns of documents; the last returns the encoded documents.

Defined cases: null, empty and very long texts pass every stage whole: a null or empty text
scores by the classifier's prior, has one empty line (and is an empty text from then on), is
linked with nothing, holds no benchmark item and has no ids. A null doc_id is kept, and
linked with nothing. Rows of one doc_id are one document when near copies are dropped: they
go together if any of them is one; otherwise each row is judged by itself. Further columns pass through all
stages but the last, whatever their names, unless one is named like a stage's own result
(see the operators); an empty table gives an empty table of the same columns.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from recordgauge.llm import bpe, decontaminate, line_dedup, minhash, quality
from recordgauge.session import cut, scratch, table

#: Ids (8 bytes each) of dropped documents up to which the drop is a broadcast.
FEW_IDS = 500_000


def keep_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose compression score reaches the threshold."""
    model = quality.fit(docs, table(spark, sf_dir, "labels"))
    return quality.score(docs, model).filter(F.col("__score") >= quality.THRESHOLD).drop("__score")


def drop_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the lines that ten or more of them hold; n_chars follows the text."""
    out = line_dedup.line_dedup(docs).drop("__n_lines", "__n_dropped")
    if "n_chars" in docs.columns:
        out = out.withColumn("n_chars", F.char_length("text").cast(docs.schema["n_chars"].dataType))
    return out


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document, that of the least id, of each near-duplicate component."""
    gone = cut(minhash.near_duplicates(docs).filter(~F.col("kept")).select("doc_id").distinct())
    if gone.limit(FEW_IDS + 1).count() <= FEW_IDS:
        gone = F.broadcast(gone)
    return docs.join(gone, "doc_id", "left_anti").select(*docs.columns)


def drop_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no benchmark item."""
    return decontaminate.decontaminate(docs, table(spark, sf_dir, "benchmark"))


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, lang, source, n_tokens, ids (little-endian unsigned 32-bit) and digests of ids and decoded bytes."""
    done = bpe.encode(docs, *bpe.tokenizer())
    return done.select("doc_id", "lang", "source", F.col("__n_tokens").alias("n_tokens"), F.col("__ids").alias("ids"), F.sha2("__ids", 256).alias("ids_sha256"), F.sha2("__decoded", 256).alias("decoded_sha256"))


STAGES = [
    ("quality_classifier", keep_quality),
    ("line_dedup", drop_lines),
    ("minhash_near_dedup", drop_near_copies),
    ("benchmark_decontamination", drop_leaks),
    ("byte_bpe", encode),
]

#: A trained classifier, MinHash and BPE have no SQL; tests hold run() against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents of sf_dir."""
    root = scratch(spark, "pipeline")
    docs, done = table(spark, sf_dir, "documents"), None
    for k, (name, stage) in enumerate(STAGES):
        path = f"{root}/{k}-{name}"
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
        if done:
            gone = spark._jvm.org.apache.hadoop.fs.Path(done)
            gone.getFileSystem(spark._jsc.sc().hadoopConfiguration()).delete(gone, True)
        done = path
    return docs
