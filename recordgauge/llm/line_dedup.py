"""Corpus-wide line deduplication with DataFrame functions only.

Normalised lines are exploded and hashed; documents are counted per hash; lines whose
count reaches the threshold go; the others are reassembled by position.

Scale: a document counts once per key through `array_distinct` before the explode, so the
count is one partially aggregated shuffle of 24-byte rows however hot a line is. The table
of frequent keys is written once; it is broadcast only if it was counted to be small, else
joined by key, where adaptive execution splits the partitions of hot keys. Line texts move
in one shuffle, by row.

Defined cases: a null text is one empty line; rows are the documents (a repeated row counts
again); keys of fewer than `min_chars` code points never count as frequent; a text that
loses all its lines becomes ''; a text of any length is split whole; an empty table gives an
empty table; other columns pass through untouched, whatever their names, but __n_lines and
__n_dropped, which give way to the results.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from recordgauge.session import cut

SPACE = " \t\n\x0b\f\r"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Frequent keys are 16 bytes each; up to this many are broadcast.
BROADCAST_KEYS = 200_000


def ascii_lower(text: Column) -> Column:
    """A-Z to a-z and nothing else; pure ASCII takes the fast path."""
    return F.when(F.octet_length(text) == F.char_length(text), F.lower(text)).otherwise(F.translate(text, UPPER, LOWER))


def key_of(line: Column) -> Column:
    return F.btrim(line, F.lit(SPACE))


def hashed(key: Column) -> list[Column]:
    """128 bits of hash: two differently seeded halves."""
    return [F.xxhash64(key).alias("__h1"), F.xxhash64(F.lit(7), key).alias("__h2")]


def frequent_keys(df: DataFrame, text: str, min_docs: int, min_chars: int) -> DataFrame:
    lowered = F.split(ascii_lower(F.coalesce(F.col(text), F.lit(""))), "\n", -1)
    keys = df.select(F.explode(F.array_distinct(F.transform(lowered, key_of))).alias("__key"))
    keys = keys.filter(F.char_length("__key") >= min_chars).select(*hashed(F.col("__key")))
    return keys.groupBy("__h1", "__h2").agg(F.count("*").alias("__n")).filter(F.col("__n") >= min_docs).select("__h1", "__h2")


def line_dedup(df: DataFrame, text: str = "text", min_docs: int = 10, min_chars: int = 1, broadcast_keys: int = BROADCAST_KEYS) -> DataFrame:
    """`df` with `text` less its frequent lines, and n_lines, n_dropped appended (as `__n_lines`, `__n_dropped`)."""
    hot = cut(frequent_keys(df, text, min_docs, min_chars))
    if hot.limit(broadcast_keys + 1).count() <= broadcast_keys:
        hot = F.broadcast(hot)
    df = df.drop("__n_lines", "__n_dropped")
    place = {c: f"c{k}" for k, c in enumerate(df.columns) if c != text}
    whole = df.select(F.monotonically_increasing_id().alias("__row"), F.struct(F.lit(0).alias("c"), *[F.col(f"`{c}`").alias(at) for c, at in place.items()]).alias("__rest"), F.split(F.coalesce(F.col(text), F.lit("")), "\n", -1).alias("__lines"))
    lines = whole.select("__row", "__rest", F.posexplode("__lines").alias("__pos", "__line"))
    lines = lines.select("__row", F.when(F.col("__pos") == 0, F.col("__rest")).alias("__rest"), "__pos", "__line", *hashed(key_of(ascii_lower(F.col("__line")))))
    marked = lines.join(hot.withColumn("__hot", F.lit(True)), ["__h1", "__h2"], "left")
    kept = F.when(F.col("__hot").isNull(), F.struct("__pos", "__line"))
    back = marked.groupBy("__row").agg(
        F.first("__rest", ignorenulls=True).alias("__rest"),
        F.count("*").alias("__n_lines"),
        F.count("__hot").alias("__n_dropped"),
        F.sort_array(F.collect_list(kept)).alias("__kept"),
    )
    joined = F.array_join(F.col("__kept.__line"), "\n")
    return back.select(*[joined.alias(c) if c == text else F.col(f"__rest.{place[c]}").alias(c) for c in df.columns], "__n_lines", "__n_dropped")


def op4(documents: DataFrame) -> DataFrame:
    found = line_dedup(documents.select("doc_id", "text"))
    return found.select("doc_id", F.col("__n_lines").alias("n_lines"), F.col("__n_dropped").alias("n_dropped"), F.sha2("text", 256).alias("kept_sha256"))


OP4_SQL = r"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS text FROM documents),
l AS (SELECT r, doc_id, unnest(string_split(text, chr(10))) AS line, unnest(range(len(string_split(text, chr(10))))) AS pos FROM d),
k AS (SELECT *, translate(trim(line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key FROM l),
hot AS (SELECT key FROM k WHERE length(key) >= 1 GROUP BY key HAVING count(DISTINCT r) >= 10)
SELECT any_value(k.doc_id) AS doc_id, count(*) AS n_lines, count(hot.key) AS n_dropped,
  sha256(coalesce(string_agg(CASE WHEN hot.key IS NULL THEN k.line END, chr(10) ORDER BY k.pos), '')) AS kept_sha256
FROM k LEFT JOIN hot ON k.key = hot.key GROUP BY k.r
"""
