"""Near-duplicate classes by MinHash with tensored banding, confirmed on full shingle sets.

Two small collections of HALVES sub-keys each (every sub-key: two minhashes) give
HALVES**2 table keys of four minhashes by combining all pairs: 40 minhashes serve 100 tables.
A pair of similarity s shares a table with probability (1 - (1 - s**2)**HALVES)**2: 0.9995
at 0.75 and 0.99998 at 0.8.

Texts of one shingle set form one class from the start (a digest of the sorted set), so
copies are never paired. Within a table key each class is first compared with the least of
its key only (a star), and confirmed stars are contracted to components: groups of near
copies are settled by that, whatever their size. What stays are keys over several
components. There, classes outside the component of the key's head are compared with those
of other components, unless one of three bounds proves that they can't be similar enough:
the sizes; the triangle inequality of the Jaccard distance, with the measured distances to
the head; parity sketches of SKETCH bits, which differ in no more bits than the sets do in
shingles. Nothing is capped or sampled; the
comparisons that stay grow with (classes outside the head's component) x (classes of the
key), which is many only where many documents lie just below the similarity, as short texts
around a common line do: there it is the square of their number. A comparison reads plain
columns, a key of more than PAIRS_A_TASK pairs is dealt over several tasks,
and pairs found at several keys are measured once.

Scale: signatures are one Arrow pass; table rows are 20 bytes, made once by evenly dealt
tasks; hot keys are partially aggregated, and joins on them read plain tables, whose skewed
partitions adaptive execution splits; confirmation fetches the whole texts of candidate
pairs only.

Defined cases: a null or wordless text has an empty set, links with nothing and is its own
component; a text of any length counts whole; rows of one doc_id with different texts are
rows of their own, each with the component of its own text; a null doc_id is kept, with a
null component; other columns are not read, whatever their names; an empty table gives an
empty table.
"""

from __future__ import annotations

from functools import reduce
from operator import add

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from recordgauge.llm.components import connected_components
from recordgauge.llm.shingles import constants, mix, overlap, shingle_set, slices
from recordgauge.session import cut, free

HALVES, PER_HALF, PERCENT = 10, 2, 75
#: Bits of a parity sketch: bounds sets up to some SKETCH shingles well, longer ones less.
SKETCH = 1024
#: Up to so many ids of candidates (8 bytes each) are broadcast, so that only their texts are shuffled.
FEW_IDS = 500_000
#: Table rows (of some 20 bytes) that one task makes.
ROWS_A_TASK = 1_000_000
#: Pairs of one key that one task compares; a key of more is dealt over several.
PAIRS_A_TASK = 4_000_000

SIGNATURE = T.StructType([
    T.StructField("n_shingles", T.LongType()),
    T.StructField("set_id", T.BinaryType()),
    *[T.StructField(f"c{k}", T.ArrayType(T.LongType())) for k in range(2)],
])
_SIZES = [HALVES, HALVES]


def signature(found: np.ndarray, a: np.ndarray, b: np.ndarray) -> list[list[int]]:
    """Sub-keys of every collection; empty lists for an empty set."""
    if not len(found):
        return [[] for _ in _SIZES]
    low = np.full(len(a), np.iinfo(np.uint64).max, dtype=np.uint64)
    for at in range(0, len(found), 4096):
        part = a[:, None] * found[None, at : at + 4096]
        part += b[:, None]
        np.minimum(low, part.min(axis=1), out=low)
    pairs = mix(low[0::2] * np.uint64(0x9E3779B97F4A7C15) + mix(low[1::2])).view(np.int64).tolist()
    out, at = [], 0
    for n in _SIZES:
        out.append(pairs[at : at + n])
        at += n
    return out


def signatures(df: DataFrame, text: str = "text", keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    schema = T.StructType([*[f for f in df.schema.fields if f.name in keep], *SIGNATURE.fields])

    def run(batches):
        import pyarrow as pa
        import xxhash

        total = 2 * sum(_SIZES)
        a, b = constants(total, 21), constants(total, 22)
        for batch in slices(batches):
            n, ids, subs = [], [], [[] for _ in _SIZES]
            for t in batch.column(text).to_pylist():
                found = shingle_set(t)
                n.append(len(found))
                ids.append(xxhash.xxh3_128_digest(found.tobytes()))
                for k, s in enumerate(signature(found, a, b)):
                    subs[k].append(s)
            kept = [batch.column(f.name) for f in schema.fields if f.name in keep]
            yield pa.RecordBatch.from_arrays([*kept, pa.array(n, pa.int64()), pa.array(ids, pa.binary()), *[pa.array(s, pa.list_(pa.int64())) for s in subs]], names=schema.names)

    return df.select(*keep, text).mapInArrow(run, schema)


def few(docs: DataFrame, ids: DataFrame) -> DataFrame:
    """The documents of `ids` (column doc_id), by a broadcast if those are counted to be few."""
    if ids.limit(FEW_IDS + 1).count() <= FEW_IDS:
        ids = F.broadcast(ids)
    return docs.join(ids, "doc_id", "left_semi")


def sketches(docs: DataFrame) -> DataFrame:
    """(rep, sketch): the parity of the number of shingles in each of SKETCH buckets, as longs."""
    schema = T.StructType([T.StructField("rep", docs.schema["doc_id"].dataType), T.StructField("sketch", T.ArrayType(T.LongType()))])

    def run(batches):
        import pyarrow as pa

        for b in slices(batches):
            out = []
            for t in b.column("text").to_pylist():
                bits = np.bincount((shingle_set(t) & np.uint64(SKETCH - 1)).astype(np.int64), minlength=SKETCH) & 1
                out.append(np.packbits(bits.astype(np.uint8)).view(np.int64))
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(out, pa.list_(pa.int64()))], names=["rep", "sketch"])

    return docs.select("doc_id", "text").mapInArrow(run, schema)


def measure(pairs: DataFrame, docs: DataFrame, percent: int = PERCENT) -> DataFrame:
    """(a, b, distance, linked) of each of `pairs`, from the documents' full sets."""
    ids = cut(pairs.select(F.col("a").alias("doc_id")).unionByName(pairs.select(F.col("b").alias("doc_id"))).distinct())
    docs = few(docs, ids)
    left = docs.select(F.col("doc_id").alias("a"), F.col("text").alias("ta"))
    right = docs.select(F.col("doc_id").alias("b"), F.col("text").alias("tb"))
    both = pairs.select("a", "b").join(left, "a").join(right, "b").select("a", "b", "ta", "tb")
    schema = T.StructType([*pairs.select("a", "b").schema.fields, T.StructField("distance", T.DoubleType()), T.StructField("linked", T.BooleanType())])

    def run(batches):
        import pyarrow as pa

        seen: dict[str, np.ndarray] = {}

        def of(text):
            got = seen.get(text)
            if got is None:
                if len(seen) >= 64:
                    seen.clear()
                got = seen[text] = shingle_set(text)
            return got

        for batch in slices(batches):
            x = [overlap(of(p), of(q)) for p, q in zip(batch.column("ta").to_pylist(), batch.column("tb").to_pylist(), strict=True)]
            distance, linked = [1 - i / u if u else 1.0 for i, u in x], [bool(i) and 100 * i >= percent * u for i, u in x]
            yield pa.RecordBatch.from_arrays([batch.column("a"), batch.column("b"), pa.array(distance, pa.float64()), pa.array(linked, pa.bool_())], names=schema.names)

    return both.mapInArrow(run, schema)


def sides(rest: DataFrame, rows: DataFrame, columns: list[str]) -> tuple[DataFrame, DataFrame]:
    """`rows` outside the home of their key (x_*), and all (y_*), to be joined on key, i, j.

    A key of more than PAIRS_A_TASK pairs (counted in `rest`) is a grid of parts x parts cells: x lies in
    one row of cells, y in one column, so each pair meets in one cell."""
    load = rest.groupBy("key").agg(F.count(F.when(F.col("comp") != F.col("home"), 1)).alias("x"), F.count("*").alias("y"))
    load = cut(load.filter(F.col("x") * F.col("y") > PAIRS_A_TASK).select("key", F.ceil(F.sqrt(F.col("x") * F.col("y") / PAIRS_A_TASK)).alias("parts")))
    if load.limit(FEW_IDS + 1).count() <= FEW_IDS:
        load = F.broadcast(load)
    rows = rows.join(load, "key", "left").withColumn("parts", F.coalesce("parts", F.lit(1).cast("long")))
    own, cells = F.pmod(F.xxhash64("rep"), "parts"), F.explode(F.sequence(F.lit(0).cast("long"), F.col("parts") - 1))
    x = rows.filter("comp <> home").select("key", own.alias("i"), cells.alias("j"), *[F.col(c).alias(f"x_{c}") for c in columns])
    return x, rows.select("key", "home", cells.alias("i"), own.alias("j"), *[F.col(c).alias(f"y_{c}") for c in columns])


def links(classes: DataFrame, docs: DataFrame, percent: int = PERCENT) -> DataFrame:
    """Confirmed links (a, b) between classes, enough to give their components.

    classes: (rep, n_shingles, c0, c1); docs: (doc_id, text)."""
    most = 1 - percent / 100

    def could(x: str, y: str):
        return 100 * F.least(x, y) >= percent * F.greatest(x, y)

    table = F.flatten(F.transform("c0", lambda x, i: F.transform("c1", lambda y, j: F.xxhash64(x, y, i * HALVES + j))))
    some = classes.filter("n_shingles > 0")
    # a class becomes HALVES**2 rows: dealt out by their number, so that no task makes more than ROWS_A_TASK
    some = some.repartition(some.count() * HALVES**2 // ROWS_A_TASK + 1)
    members = cut(some.select("rep", F.col("n_shingles").cast("int").alias("n"), F.explode(table).alias("key")))
    heads = members.groupBy("key").agg(F.min("rep").alias("head"), F.max("rep").alias("tail")).filter("head <> tail").select("key", "head")
    shared = cut(members.join(heads, "key"))
    free(members)

    # stars
    sizes = classes.select(F.col("rep").alias("a"), F.col("n_shingles").alias("na"))
    stars = shared.filter("rep <> head").select(F.col("head").alias("a"), F.col("rep").alias("b"), "n").distinct()
    stars = cut(stars.join(sizes, "a").filter(could("n", "na")).select("a", "b"))
    star = cut(measure(stars, docs, percent))
    free(stars)
    found = star.filter("linked").select("a", "b")
    comps = connected_components(found)

    # keys that still hold several components
    d = star.select(F.col("a").alias("head"), F.col("b").alias("rep"), "distance")
    rows = shared.join(comps.withColumnRenamed("id", "rep"), "rep", "left").withColumn("comp", F.coalesce("comp", "rep"))
    spread = rows.groupBy("key").agg(F.min("comp").alias("lo"), F.max("comp").alias("hi"), F.max(F.when(F.col("rep") == F.col("head"), F.col("comp"))).alias("home")).filter("lo <> hi").select("key", "home")
    rest = rows.join(spread, "key").filter("rep <> head").join(d, ["head", "rep"], "left")
    rest = cut(rest.select("key", "rep", "n", "comp", "home", "distance"))
    free(shared)
    bits = [f"s{k}" for k in range(SKETCH // 64)]
    own = cut(sketches(few(docs, cut(rest.select(F.col("rep").alias("doc_id")).distinct()))).select("rep", *[F.col("sketch")[k].alias(c) for k, c in enumerate(bits)]))
    x, y = sides(rest, rest.join(own, "rep"), ["rep", "n", "comp", "distance", *bits])
    once = (F.col("y_comp") == F.col("home")) | (F.col("x_rep") < F.col("y_rep"))
    near = F.coalesce(F.abs(F.col("x_distance") - F.col("y_distance")) <= most + 1e-9, F.lit(True))
    # for every pair: plain columns, no arrays, and no search for the first key that both share
    differ = reduce(add, [F.bit_count(F.col(f"x_{c}").bitwiseXOR(F.col(f"y_{c}"))) for c in bits])
    n = F.col("x_n") + F.col("y_n")
    alike = (100 + percent) * differ <= (100 - percent) * n  # else n - differ < percent % of n + differ
    pairs = x.join(y, ["key", "i", "j"]).filter((F.col("x_comp") != F.col("y_comp")) & once & could("x_n", "y_n") & near & alike)
    pairs = cut(pairs.select(F.least("x_rep", "y_rep").alias("a"), F.greatest("x_rep", "y_rep").alias("b")).distinct())
    free(rest, own)
    more = measure(pairs, docs, percent).filter("linked").select("a", "b")
    return cut(found.unionByName(more))


def near_duplicates(df: DataFrame, percent: int = PERCENT) -> DataFrame:
    """(doc_id, n_shingles, component_id, kept) of each row of `df` (doc_id, text)."""
    docs = df.select("doc_id", "text")
    signed = cut(signatures(docs))
    classes = signed.filter("n_shingles > 0 and doc_id is not null").groupBy("set_id").agg(F.min("doc_id").alias("rep"), F.first("n_shingles").alias("n_shingles"), *[F.first(f"c{k}").alias(f"c{k}") for k in range(2)])
    classes = cut(classes)
    comps = connected_components(links(classes, docs, percent)).withColumnRenamed("id", "rep")
    of_class = cut(classes.select("set_id", "rep").join(comps, "rep", "left").select("set_id", F.coalesce("comp", "rep").alias("comp")))
    out = signed.select("doc_id", "n_shingles", "set_id").join(of_class, "set_id", "left")
    component = F.when((F.col("n_shingles") > 0) & F.col("doc_id").isNotNull(), F.col("comp")).otherwise(F.col("doc_id"))
    return out.select("doc_id", "n_shingles", component.alias("component_id"), component.eqNullSafe(F.col("doc_id")).alias("kept"))


def op6(documents: DataFrame) -> DataFrame:
    return near_duplicates(documents)


OP6_SQL = r"""
WITH RECURSIVE w AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS ws FROM documents),
s AS (SELECT doc_id, CASE WHEN len(ws) = 0 THEN []::VARCHAR[] WHEN len(ws) < 5 THEN [array_to_string(ws, ' ')]
  ELSE list_distinct(list_transform(range(1, len(ws) - 3), lambda i: ws[i] || ' ' || ws[i+1] || ' ' || ws[i+2] || ' ' || ws[i+3] || ' ' || ws[i+4])) END AS sh FROM w),
n AS (SELECT doc_id, len(sh) AS n FROM s),
x AS (SELECT doc_id, unnest(sh) AS g FROM s),
p AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c FROM x a JOIN x b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY ALL),
e AS (SELECT a, b FROM p JOIN n na ON na.doc_id = a JOIN n nb ON nb.doc_id = b WHERE 100 * c >= 75 * (na.n + nb.n - c)),
y AS (SELECT a, b FROM e UNION ALL SELECT b, a FROM e),
r(doc_id, reach) AS (SELECT doc_id, doc_id FROM n UNION SELECT r.doc_id, y.b FROM r JOIN y ON r.reach = y.a)
SELECT n.doc_id, n.n AS n_shingles, min(r.reach) AS component_id, n.doc_id = min(r.reach) AS kept
FROM n JOIN r ON r.doc_id = n.doc_id GROUP BY n.doc_id, n.n
"""
