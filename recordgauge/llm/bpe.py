"""Byte-level BPE encoding and decoding over overlapping chunks.

Long texts are cut into chunks that overlap. The chunks are pre-tokenised in parallel, each
without knowing where its first pre-token began. Neighbours are stitched at the first
pre-token boundary that both found in their overlap: from a common boundary on, the pattern
finds the same pre-tokens, so by induction from the first chunk all boundaries between two
seams are those of the whole text. Each chunk's pieces from seam to seam are then encoded,
again in parallel, and their ids and bytes are put together by row; decoding concatenates
the raw bytes.

An overlap without a common boundary means a pre-token longer than the overlap (or digits
grouped otherwise). Such a text is stitched in one task: pre-tokenised on from the last sure
boundary until the scan meets a boundary of a later chunk, in one pass over the text.

Texts of at most one chunk are encoded where they lie; only longer ones are exploded to
chunk rows, which are cut in the shared folder. Seams are settled from the boundaries in the
overlaps only, some kilobytes a chunk. Nothing is collected; the vocabulary (0.8 MB, a
fixed file whose path is a parameter) travels with the function.

Defined cases: a null text is empty: no ids and the digest of nothing; a text may be one
pre-token of any length; repeated rows are encoded alike; other columns pass through, but
those named like one of the results (__n_tokens, __ids, __decoded) give way to it; an empty
table gives an empty table.
"""

from __future__ import annotations

import base64
import bisect
import hashlib
import struct

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from recordgauge.llm.shingles import slices
from recordgauge.session import cut

CHUNK, OVERLAP = 32_768, 512
#: Pre-token ids kept by a worker: cleared when full.
CACHE = 200_000


class Codec:
    """Ids of pre-tokens by the ranks of a file; made once per task."""

    def __init__(self, raw: bytes, pattern: str):
        import regex
        import tiktoken

        ranks = {base64.b64decode(a): int(b) for a, b in (line.split() for line in raw.splitlines() if line)}
        self.find = regex.compile(pattern).findall
        self.iter = regex.compile(pattern).finditer
        self.encoding = tiktoken.Encoding("ranks", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
        self.bytes_of = {struct.pack("<I", r): b for b, r in ranks.items()}
        self.cache: dict[str, bytes] = {}

    def piece(self, piece: str) -> bytes:
        got = self.cache.get(piece)
        if got is None:
            ids = self.encoding._encode_single_piece(piece)
            got = struct.pack(f"<{len(ids)}I", *ids)
            if len(piece) <= 64:
                if len(self.cache) >= CACHE:
                    self.cache.clear()
                self.cache[piece] = got
        return got

    def encode_pieces(self, pieces: list[str]) -> bytes:
        """Little-endian unsigned 32-bit ids."""
        try:
            return b"".join(map(self.cache.__getitem__, pieces))
        except KeyError:
            return b"".join(map(self.piece, pieces))

    def decode(self, ids: bytes) -> bytes:
        table = self.bytes_of
        return b"".join([table[ids[i : i + 4]] for i in range(0, len(ids), 4)])


def boundaries(codec: Codec, chunk: str, last: bool) -> list[int]:
    """Starts of the pre-tokens; the last two of a cut chunk may differ in the whole text and are left out."""
    starts = [m.start() for m in codec.iter(chunk)]
    return starts if last else starts[:-2]


def stitch(codec: Codec, chunks: list[tuple[int, str, list[int]]]) -> list[str]:
    """Pre-tokens of the text that the chunks (offset, text with overlap, boundaries) cover, in one pass."""
    whole = "".join(c[1][: chunks[k + 1][0] - c[0]] if k + 1 < len(chunks) else c[1] for k, c in enumerate(chunks))
    if not whole:
        return []
    cuts: list[int] = []
    k = 0
    while k < len(chunks):
        # the chunk's boundaries are sure from its first on, or from where the last one's end
        at, _, found = chunks[k]
        own = [at + b for b in found]
        cuts += own[bisect.bisect_right(own, cuts[-1]) if cuts else 0 :]
        k += 1
        if k == len(chunks):
            break
        later = [chunks[k][0] + b for b in chunks[k][2]]
        meet = common(cuts, later)
        if meet is None:
            # go on from the last sure boundary, through as many chunks as it takes
            sure = cuts.pop() if cuts else 0
            ahead = iter(later)
            nxt = next(ahead, None)
            for m in codec.iter(whole, sure):
                p = m.start()
                while nxt is not None and nxt < p or nxt is None and k + 1 < len(chunks) and p >= chunks[k + 1][0]:
                    if nxt is None:
                        k += 1
                        ahead = iter([chunks[k][0] + b for b in chunks[k][2]])
                    nxt = next(ahead, None)
                cuts.append(p)
                if p == nxt and p > sure:
                    break
            else:
                k = len(chunks)
        else:
            del cuts[bisect.bisect_right(cuts, meet) :]
    cuts.append(len(whole))
    return [whole[a:b] for a, b in zip(cuts, cuts[1:], strict=False)]


def common(cuts: list[int], later: list[int]) -> int | None:
    """The first boundary in both sorted lists."""
    if not later:
        return None
    k = bisect.bisect_left(cuts, later[0])
    known = set(cuts[k:])
    return next((b for b in later if b in known), None)


def _encode_rows(load, text: str):
    def run(batches):
        import pyarrow as pa

        codec = Codec(*load)
        for batch in slices(batches, 1024):
            ids = [codec.encode_pieces(codec.find(t or "")) for t in batch.column(text).to_pylist()]
            yield with_ids(batch, text, ids, codec, pa)

    return run


def with_ids(batch, text, ids, codec, pa):
    k = batch.schema.get_field_index(text)
    rest = batch.remove_column(k) if text in batch.schema.names else batch
    raw = [codec.decode(x) for x in ids]
    columns = [*rest.columns, pa.array([len(x) // 4 for x in ids], pa.int64()), pa.array(ids, pa.binary()), pa.array(raw, pa.binary())]
    return pa.RecordBatch.from_arrays(columns, names=[*rest.schema.names, "__n_tokens", "__ids", "__decoded"])


def encode(df: DataFrame, ranks_path: str, pattern: str, text: str = "text", chunk: int = CHUNK, overlap: int = OVERLAP) -> DataFrame:
    """`df` without `text`, with __n_tokens, __ids (little-endian unsigned 32-bit) and __decoded (bytes)."""
    with open(ranks_path, "rb") as f:
        load = (f.read(), pattern)
    if overlap > chunk:
        raise ValueError("an overlap is no longer than a chunk")
    df = df.drop("__n_tokens", "__ids", "__decoded")
    others = [f for f in df.schema.fields if f.name != text]
    schema = T.StructType([*others, T.StructField("__n_tokens", T.LongType()), T.StructField("__ids", T.BinaryType()), T.StructField("__decoded", T.BinaryType())])
    size = F.char_length(F.coalesce(F.col(text), F.lit("")))
    ordered = df.select(*[F.col(f"`{f.name}`") for f in others], text)
    short = ordered.filter(size <= chunk).mapInArrow(_encode_rows(load, text), schema)

    rest = F.struct(F.lit(0).alias("c"), *[F.col(f"`{f.name}`").alias(f"c{k}") for k, f in enumerate(others)])
    # one pass cuts the text; a part goes on by the first code points of the next
    cut_up = F.regexp_extract_all(F.col(text), F.lit(f"(?s).{{1,{chunk}}}"), F.lit(0))
    long = ordered.filter(size > chunk).select(F.monotonically_increasing_id().alias("row"), rest.alias("rest"), cut_up.alias("own"))
    nexts = F.concat(F.slice("own", F.lit(2), F.size("own")), F.array(F.lit("")))
    long = long.select("row", "rest", F.posexplode(F.zip_with("own", nexts, lambda x, y: F.struct(F.concat(x, F.left(y, F.lit(overlap))).alias("part"), (F.char_length(y) <= overlap).alias("last")))).alias("k", "x"))
    pieces = long.select("row", F.when(F.col("k") == 0, F.col("rest")).alias("rest"), "k", "x.part", "x.last")
    # a hot partition of long texts is dealt out anew, so that chunks run in parallel
    pieces = pieces.repartition(F.col("row"), F.col("k"))
    cut_schema = T.StructType([*pieces.schema.fields, T.StructField("cuts", T.ArrayType(T.IntegerType()))])

    def pretokenise(batches):
        import pyarrow as pa

        codec = Codec(*load)
        for b in slices(batches, 64):
            found = [boundaries(codec, t, end) for t, end in zip(b.column("part").to_pylist(), b.column("last").to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(found, pa.list_(pa.int32()))], names=cut_schema.names)

    parts = cut(pieces.mapInArrow(pretokenise, cut_schema))

    # seams, from the boundaries in the overlaps
    line = Window.partitionBy("row").orderBy("k")
    tail = F.transform(F.filter("cuts", lambda c: c >= chunk), lambda c: c - chunk)
    ends = parts.select("row", "k", "last", tail.alias("tail"), F.filter("cuts", lambda c: c < overlap).alias("first"))
    met = ends.select("row", "k", "last", F.array_min(F.array_intersect("tail", F.lead("first").over(line))).alias("meet"))
    ahead = F.lead("k").over(line).isNotNull()
    seams = met.select("row", "k", F.coalesce(F.lag("meet").over(line), F.lit(0)).alias("low"), (F.col("meet") + chunk).alias("high"), (F.col("meet").isNotNull() | ~ahead).alias("met"), ahead.alias("ahead"))
    seams = cut(seams.withColumn("met", F.bool_and("met").over(Window.partitionBy("row"))))

    def encode_parts(batches):
        import pyarrow as pa

        codec = Codec(*load)
        for b in slices(batches, 64):
            ids = []
            for t, cuts, low, high in zip(*[b.column(c).to_pylist() for c in ("part", "cuts", "low", "high")], strict=True):
                high = len(t) if high is None else high
                at = [low, *cuts[bisect.bisect_right(cuts, low) : bisect.bisect_left(cuts, high)], high] if low < high else []
                ids.append(codec.encode_pieces([t[x:y] for x, y in zip(at, at[1:], strict=False)]))
            raw = [codec.decode(x) for x in ids]
            yield pa.RecordBatch.from_arrays([*[b.column(c) for c in ("row", "rest", "k")], pa.array(ids, pa.binary()), pa.array(raw, pa.binary())], names=["row", "rest", "k", "ids", "raw"])

    joined = parts.join(seams.filter("met").select("row", "k", "low", F.when(F.col("ahead"), F.col("high")).alias("high")), ["row", "k"])
    coded_schema = T.StructType([*pieces.schema.fields[:3], T.StructField("ids", T.BinaryType()), T.StructField("raw", T.BinaryType())])
    coded = joined.select("row", "rest", "k", "part", "cuts", "low", "high").mapInArrow(encode_parts, coded_schema)
    by_row = coded.groupBy("row").agg(F.first("rest", ignorenulls=True).alias("rest"), F.expr("listagg(ids) WITHIN GROUP (ORDER BY k)").alias("__ids"), F.expr("listagg(raw) WITHIN GROUP (ORDER BY k)").alias("__decoded"))
    back = [F.col(f"rest.c{k}").alias(f.name) for k, f in enumerate(others)]
    stitched = by_row.select(*back, (F.octet_length("__ids") / 4).cast("long").alias("__n_tokens"), "__ids", "__decoded")

    def join_up(batches):
        import pyarrow as pa

        codec = Codec(*load)
        for b in slices(batches, 1):
            ids = [codec.encode_pieces(stitch(codec, [(p["k"] * chunk, p["part"], p["cuts"]) for p in parts])) for parts in b.column("__parts").to_pylist()]
            yield with_ids(b, "__parts", ids, codec, pa)

    odd = parts.join(seams.filter("not met").select("row", "k"), ["row", "k"], "left_semi")
    odd = odd.groupBy("row").agg(F.first("rest", ignorenulls=True).alias("rest"), F.sort_array(F.collect_list(F.struct("k", "part", "cuts"))).alias("__parts"))
    return short.unionByName(stitched).unionByName(odd.select(*back, "__parts").mapInArrow(join_up, schema))


def decode(ids: bytes, ranks_path: str, pattern: str) -> bytes:
    with open(ranks_path, "rb") as f:
        return Codec(f.read(), pattern).decode(ids)


def tokenizer() -> tuple[str, str]:
    """Path of the default ranks and its pattern."""
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN


def digests(encoded: DataFrame) -> DataFrame:
    return encoded.select("doc_id", F.col("__n_tokens").alias("n_tokens"), F.sha2("__ids", 256).alias("ids_sha256"), F.sha2("__decoded", 256).alias("decoded_sha256"))


def op7(documents: DataFrame) -> DataFrame:
    return digests(encode(documents.select("doc_id", "text"), *tokenizer()))


def brute(text: str | None, ranks_path: str, pattern: str) -> tuple[int, str, str]:
    """What the library says of a text: for tests."""
    with open(ranks_path, "rb") as f:
        codec = Codec(f.read(), pattern)
    ids = codec.encoding.encode_ordinary(text or "")
    return len(ids), hashlib.sha256(struct.pack(f"<{len(ids)}I", *ids)).hexdigest(), hashlib.sha256((text or "").encode()).hexdigest()
