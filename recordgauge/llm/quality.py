"""Quality by compression: zstandard dictionaries of good and of bad text.

One dictionary is trained on good and one on bad labelled texts. A text's whole bytes are
compressed with either; the difference of the compressed sizes, normalised by the text's
length and by their sum, and the better of the two ratios give a calibrated score through a
small logistic regression, fitted on labelled texts that no dictionary has seen and weighted
to the label shares of the whole table.

Fitting takes a bounded sample (`PER_CLASS` labelled rows of each class, in the order of
a hash of doc_id): the first half for the dictionaries, the rest for calibration. Only the
texts for the dictionaries reach the driver, at most `FIT_BYTES` a class and none above
`FIT_TEXT` bytes; of the rest come their three features. Scoring is one Arrow pass over all
texts, no shuffle; the two dictionaries (112 KB each, a parameter) travel with the function.

Defined cases: null and empty texts have size 0 and score by the prior of the calibration;
texts of any length are compressed whole; without labels of both classes every score is 0.5;
conflicting labels of one doc_id count each, as do repeated documents, within the bounds; a
null doc_id is never held out nor used for fitting; other columns pass through, but one
named __score gives way to the result; an empty table gives an empty table.
"""

from __future__ import annotations

import math
from functools import reduce

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from recordgauge.llm.shingles import slices
from recordgauge.session import cut

#: Labelled rows per class that are read for fitting; bytes of a dictionary; zstandard's level.
PER_CLASS, DICT_BYTES, LEVEL = 2000, 112 * 1024, 3
#: Bytes of text per class, and of one text, from which the dictionaries are trained.
FIT_BYTES, FIT_TEXT = 32 << 20, 1 << 20
#: Scores from here on count as good.
THRESHOLD = 0.3


def held_out(doc_id: Column) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 5 == 0, F.lit(False))


class Sizes:
    """Compressed sizes with either dictionary."""

    def __init__(self, dictionaries: tuple[bytes, bytes]):
        import zstandard

        self.packers = []
        for raw in dictionaries:
            d = zstandard.ZstdCompressionDict(raw)
            d.precompute_compress(level=LEVEL)
            self.packers.append(zstandard.ZstdCompressor(dict_data=d, write_content_size=False, write_checksum=False, write_dict_id=False))

    def features(self, text: str | None) -> tuple[float, float, float]:
        data = (text or "").encode("utf-8", "replace")
        if not data:
            return 0.0, 0.0, 0.0
        good, bad = (len(p.compress(data)) for p in self.packers)
        return (good - bad) / len(data), (good - bad) / (good + bad), min(good, bad) / len(data)


def logistic(x: np.ndarray, y: np.ndarray, weight: np.ndarray, l2: float = 1e-2) -> np.ndarray:
    """Newton steps; the last coefficient is the intercept."""
    a = np.c_[x, np.ones(len(x))]
    w = np.zeros(a.shape[1])
    for _ in range(40):
        p = 1 / (1 + np.exp(-np.clip(a @ w, -30, 30)))
        hess = a.T @ (a * (weight * p * (1 - p))[:, None]) + l2 * np.eye(len(w))
        w -= np.linalg.solve(hess, a.T @ (weight * (p - y)) + l2 * w)
    return w


def fit(documents: DataFrame, labels: DataFrame, per_class: int = PER_CLASS) -> dict | None:
    """Dictionaries and calibration as a small dict; None without both classes."""
    import zstandard

    usable = labels.filter(F.col("quality").isin(0, 1) & F.col("doc_id").isNotNull() & ~held_out(F.col("doc_id"))).select("doc_id", "quality")
    shares = {r["quality"]: r["count"] for r in usable.groupBy("quality").count().collect()}
    if len(shares) < 2:
        return None
    picked = None
    for q in (0, 1):  # per_class rows each: a proven bound for the broadcast and the collect
        part = usable.filter(F.col("quality") == q).orderBy(F.xxhash64("doc_id"), "doc_id").limit(per_class)
        picked = part if picked is None else picked.unionByName(part)
    texts = documents.select("doc_id", "text").join(F.broadcast(picked), "doc_id").select("quality", "text", F.octet_length(F.coalesce("text", F.lit(""))).alias("size"), F.xxhash64("doc_id").alias("h"), "doc_id")
    # repeated documents come in again: the bound holds for the rows, too
    chosen = reduce(DataFrame.unionByName, [texts.filter(F.col("quality") == q).orderBy("h", "doc_id", "text").limit(per_class) for q in (0, 1)])
    order = Window.partitionBy("quality").orderBy("h", "doc_id", "text")  # at most per_class rows each
    ranked = chosen.withColumns({"rn": F.row_number().over(order), "n": F.count("*").over(Window.partitionBy("quality"))})
    ranked = ranked.withColumn("first", F.col("rn") <= F.floor(F.col("n") / 2))
    small = F.when(F.col("first") & (F.col("size") <= FIT_TEXT), F.col("size")).otherwise(0)
    ranked = cut(ranked.withColumn("upto", F.sum(small).over(order)))
    counts = {r["quality"]: r["n"] for r in ranked.groupBy("quality").agg(F.count("*").alias("n")).collect()}
    if len(counts) < 2 or min(counts.values()) < 8:
        return None
    kept = ranked.filter(F.col("first") & (F.col("size") > 0) & (F.col("size") <= FIT_TEXT) & (F.col("upto") <= FIT_BYTES))
    by: dict[int, list[str]] = {0: [], 1: []}
    for r in sorted(kept.select("quality", "rn", "text").collect(), key=lambda r: r["rn"]):
        by[r["quality"]].append(r["text"])
    dictionaries = []
    for q in (1, 0):
        seen = [t.encode("utf-8", "replace") for t in by[q]]
        try:
            dictionaries.append(zstandard.train_dictionary(min(DICT_BYTES, max(1024, sum(map(len, seen)) // 8)), seen, level=LEVEL).as_bytes())
        except zstandard.ZstdError:  # too little text to train from: its bytes are the dictionary
            dictionaries.append(b"\n".join(seen)[:DICT_BYTES] or b"\n" * 8)
    rest = measured(ranked.filter(~F.col("first")).select("quality", "rn", "text"), tuple(dictionaries)).collect()  # at most per_class rows a class, of numbers
    rest.sort(key=lambda r: (r["quality"], r["rn"]))
    x, y = np.array([r["f"] for r in rest]), np.array([r["quality"] for r in rest], dtype=float)
    mean, sd = x.mean(0), x.std(0) + 1e-9
    n = {q: max(1, int((y == q).sum())) for q in (0, 1)}
    total = sum(shares.values())
    weight = np.where(y == 1, shares[1] / total * len(y) / n[1], shares[0] / total * len(y) / n[0])
    return {"dictionaries": tuple(dictionaries), "mean": mean.tolist(), "sd": sd.tolist(), "w": logistic((x - mean) / sd, y, weight).tolist()}


def measured(df: DataFrame, dictionaries: tuple[bytes, bytes]) -> DataFrame:
    """(quality, rn, f): the features of labelled texts."""
    schema = T.StructType([*[f for f in df.schema.fields if f.name != "text"], T.StructField("f", T.ArrayType(T.DoubleType()))])

    def run(batches):
        import pyarrow as pa

        sizes = Sizes(dictionaries)
        for b in slices(batches):
            found = [sizes.features(t) for t in b.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column("quality"), b.column("rn"), pa.array(found, pa.list_(pa.float64()))], names=schema.names)

    return df.select("quality", "rn", "text").mapInArrow(run, schema)


def score(df: DataFrame, model: dict | None, text: str = "text") -> DataFrame:
    """`df` with __score appended."""
    df = df.drop("__score")
    schema = T.StructType([*df.schema.fields, T.StructField("__score", T.DoubleType())])

    def run(batches):
        import pyarrow as pa

        sizes = Sizes(model["dictionaries"]) if model else None
        for b in slices(batches):
            out = []
            for t in b.column(text).to_pylist():
                z = 0.0
                if model:
                    f = sizes.features(t)
                    z = model["w"][-1] + sum(w * (v - m) / s for w, v, m, s in zip(model["w"], f, model["mean"], model["sd"], strict=False))
                out.append(1 / (1 + math.exp(-max(-30.0, min(30.0, z)))))
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(out, pa.float64())], names=[*b.schema.names, "__score"])

    return df.mapInArrow(run, schema)


def op3(documents: DataFrame, labels: DataFrame) -> DataFrame:
    model = fit(documents, labels)
    scored = score(documents.select("doc_id", "text"), model)
    return scored.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), F.col("__score").alias("score"), F.when(F.col("__score") >= THRESHOLD, 1).otherwise(0).alias("predicted"))
