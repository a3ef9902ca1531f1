"""Media columns: archives of members, read by a data source in byte ranges.

`write_archives` stores one media file a row (here: text bytes as 8-bit mono WAV samples) in
ZIP archives below a shared folder. `MediaArchives` is a Spark data source over such a
folder: it plans partitions as byte ranges of the archives, from file sizes alone; a reader
takes the members whose headers begin in its range from the archive's central directory,
reads each by its offset, retries it alone when reading or its checksum fails, and streams
batches of bounded bytes through Arrow. With `digests` "true" the reader gives digests and
features of each member in place of its bytes, which then never pass through the JVM. The
writer gets its texts in Arrow batches of some BATCH_BYTES, or one longer text.

Scale and recovery: a task writes archives of at most ARCHIVE_BYTES (or one member) under a
temporary name and renames them, and names depend on the partition alone, so a task that
runs again replaces its own files. Nothing is collected; the planner lists file names and
sizes only. Any store that pyarrow.fs opens will do for the archives; the input table is
read by Spark.

Defined cases: a null text is empty (one block of padding); a text of any length is one
member; ids of any type, repeated and null ones too, are kept, one member a row, in the
member's name as quoted text; other columns are not read, whatever their names; an empty
table makes no archive and reads back empty; members that still fail after RETRIES raise, or
come back with `error` set when `permissive` is "true".
"""

from __future__ import annotations

import io
import uuid
import zipfile
import zlib
from collections.abc import Iterator
from dataclasses import dataclass
from urllib.parse import quote, unquote

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from recordgauge.session import scratch

BLOCK = 192
ARCHIVE_BYTES, RANGE_BYTES, BATCH_BYTES, RETRIES = 32 << 20, 8 << 20, 4 << 20, 3
SCHEMA = "archive string, member string, offset bigint, payload binary, error string"
DIGESTS = "key string, n_bytes bigint, payload_bytes bigint, payload_sha256 string, tail_crc32 bigint, media_bytes bigint, media_sha256 string, feature string"


def open_fs(uri: str):
    """pyarrow's file system and path for a URI or a plain path."""
    from pyarrow import fs

    if "://" not in uri and not uri.startswith("file:"):
        return fs.LocalFileSystem(), uri
    if uri.startswith("file:"):
        return fs.LocalFileSystem(), "/" + uri.removeprefix("file:").lstrip("/")
    return fs.FileSystem.from_uri(uri.replace("s3a://", "s3://", 1))


def padded(text: str | None, block: int = BLOCK) -> tuple[int, bytes]:
    """Length of the UTF-8 bytes, and the bytes with spaces up to a positive multiple of `block`."""
    data = (text or "").encode("utf-8", "replace")
    return len(data), data + b" " * (max(1, -(-len(data) // block)) * block - len(data))


def to_wav(payload: bytes, rate: int = 8000) -> bytes:
    """8-bit unsigned mono samples in a RIFF file."""
    import wave

    out = io.BytesIO()
    with wave.open(out, "wb") as w:
        w.setnchannels(1)
        w.setsampwidth(1)
        w.setframerate(rate)
        w.writeframes(payload)
    return out.getvalue()


def from_wav(media: bytes) -> bytes:
    import wave

    with wave.open(io.BytesIO(media), "rb") as r:
        if (r.getnchannels(), r.getsampwidth()) != (1, 1):
            raise ValueError("not 8-bit mono samples")
        return r.readframes(r.getnframes())


def write_archives(df: DataFrame, key: str, text: str, folder: str, archive_bytes: int = ARCHIVE_BYTES) -> None:
    """Every row's text as one WAV member `<row>-<key>-<bytes>.wav` of the archives in `folder`."""

    def run(batches):
        import pyarrow as pa
        from pyspark import TaskContext

        store, base = open_fs(folder)
        store.create_dir(base)
        part, row, made, box, out, temp = TaskContext.get().partitionId(), 0, 0, None, None, ""

        def close():
            nonlocal box, made
            if box is not None:
                box.close()
                out.close()
                final = f"{base}/part-{part:06d}-{made:04d}.zip"
                store.move(temp, final)
                made, box = made + 1, None

        for b in batches:
            for k, t in zip(b.column(key).to_pylist(), b.column(text).to_pylist(), strict=True):
                n, payload = padded(t)
                media = to_wav(payload)
                if box is not None and out.tell() + len(media) > archive_bytes:
                    close()
                if box is None:
                    temp = f"{base}/.part-{part:06d}-{made:04d}.{uuid.uuid4().hex}"
                    out = store.open_output_stream(temp)
                    box = zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED, compresslevel=1)
                box.writestr(zipfile.ZipInfo(f"{row}-{'!' if k is None else quote(str(k), safe='')}-{n}.wav"), media, zipfile.ZIP_DEFLATED, 1)
                row += 1
        close()
        yield pa.RecordBatch.from_arrays([pa.array([row], pa.int64())], names=["rows"])

    # each task's batch lies outside the JVM's heap
    conf, bound = df.sparkSession.conf, "spark.sql.execution.arrow.maxBytesPerBatch"
    before = conf.get(bound)
    conf.set(bound, str(BATCH_BYTES))
    try:
        df.select(key, text).mapInArrow(run, "rows bigint").agg(F.sum("rows")).collect()
    finally:
        conf.set(bound, before)


@dataclass
class ByteRange(InputPartition):
    archive: str
    start: int
    end: int


def flag(options, name: str) -> bool:
    return options.get(name, "false").lower() == "true"


class MediaArchives(DataSource):
    """format("media_archives"): options `path`, `range_bytes`, `batch_bytes`, `retries`, `permissive`, `digests`."""

    @classmethod
    def name(cls) -> str:
        return "media_archives"

    def schema(self) -> str:
        return SCHEMA.replace("payload binary", DIGESTS) if flag(self.options, "digests") else SCHEMA

    def reader(self, schema) -> MediaReader:
        return MediaReader(self.options)


class MediaReader(DataSourceReader):
    def __init__(self, options):
        self.folder = options["path"]
        self.range = int(options.get("range_bytes", RANGE_BYTES))
        self.batch = int(options.get("batch_bytes", BATCH_BYTES))
        self.retries = int(options.get("retries", RETRIES))
        self.permissive, self.digests = flag(options, "permissive"), flag(options, "digests")

    def partitions(self) -> list[ByteRange]:
        from pyarrow import fs

        store, base = open_fs(self.folder)
        files = store.get_file_info(fs.FileSelector(base, recursive=True, allow_not_found=True))
        found = sorted((f.path, f.size) for f in files if f.type == fs.FileType.File and f.base_name.endswith(".zip") and f.base_name[0] not in "._")
        # an empty folder still needs a partition: Spark expects at least one
        return [ByteRange(p, a, min(a + self.range, size)) for p, size in found for a in range(0, size, self.range)] or [ByteRange("", 0, 0)]

    def read(self, partition: ByteRange) -> Iterator:
        import pyarrow as pa

        if not partition.archive:
            return
        store, _ = open_fs(self.folder)
        types = {"string": pa.string(), "bigint": pa.int64(), "binary": pa.binary()}
        values = DIGESTS if self.digests else "payload binary"
        fields = [c.split() for c in SCHEMA.replace("payload binary", values).split(", ")]
        rows, held = [], 0

        def flush():
            return pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], types[kind]) for k, (_, kind) in enumerate(fields)], names=[name for name, _ in fields])

        with store.open_input_file(partition.archive) as f, zipfile.ZipFile(f) as box:
            own = [i for i in box.infolist() if partition.start <= i.header_offset < partition.end]
            for info in own:
                data, error = self.member(store, partition.archive, box, info)
                found = (data,) if not self.digests else describe(info.filename, data) if data is not None else (None,) * len(DIGESTS.split(", "))
                rows.append((partition.archive, info.filename, info.header_offset, *found, error))
                held += len(data or b"")
                if held >= self.batch:
                    yield flush()
                    rows, held = [], 0
        if rows:
            yield flush()

    def member(self, store, archive: str, box: zipfile.ZipFile, info: zipfile.ZipInfo) -> tuple[bytes | None, str | None]:
        """One member by its offset; each retry opens the archive anew."""
        error = None
        for k in range(self.retries):
            try:
                if k == 0:
                    return box.read(info), None
                with store.open_input_file(archive) as f, zipfile.ZipFile(f) as again:
                    return again.read(again.infolist()[[i.header_offset for i in again.infolist()].index(info.header_offset)]), None
            except (OSError, zipfile.BadZipFile, zlib.error, EOFError) as e:
                error = f"{type(e).__name__}: {e}"
        if self.permissive:
            return None, error
        raise OSError(f"{archive}, member at {info.header_offset}: {error}")


def read_archives(spark: SparkSession, folder: str, **options) -> DataFrame:
    spark.dataSource.register(MediaArchives)
    return spark.read.format("media_archives").options(path=folder, **options).load()


def features(samples: bytes) -> str:
    """Mean, deviation, zero crossings and eight spectral band shares of 8-bit samples."""
    import numpy as np

    x = np.frombuffer(samples, dtype=np.uint8).astype(np.float64) - 128
    crossings = int(np.count_nonzero(np.signbit(x[1:]) != np.signbit(x[:-1])))
    frames = x.reshape(-1, BLOCK)
    power = np.zeros(BLOCK // 2 + 1)
    for at in range(0, len(frames), 4096):
        power += (np.abs(np.fft.rfft(frames[at : at + 4096], axis=1)) ** 2).sum(axis=0)
    bands = [float(part.sum()) for part in np.array_split(power[1:], 8)]
    total = sum(bands) or 1.0
    return f"mean={x.mean():.4f};std={x.std():.4f};zero={crossings};bands=" + ",".join(f"{b / total:.4f}" for b in bands)


def describe(member: str, media: bytes) -> tuple:
    """The columns DIGESTS of a WAV member: its key as text, digests and features, from the stored bytes."""
    import hashlib

    key, n = member.removesuffix(".wav").partition("-")[2].rsplit("-", 1)
    raw = from_wav(media)
    return (None if key == "!" else unquote(key), int(n), len(raw), hashlib.sha256(raw).hexdigest(), zlib.crc32(raw[-16:]), len(media), hashlib.sha256(media).hexdigest(), features(raw))


def op5(documents: DataFrame) -> DataFrame:
    spark = documents.sparkSession
    folder = scratch(spark, "media")
    write_archives(documents, "doc_id", "text", folder)
    done = read_archives(spark, folder, digests="true")
    columns = [c.split()[0] for c in DIGESTS.split(", ")]
    return done.select(F.col("key").cast(documents.schema["doc_id"].dataType).alias("doc_id"), *columns[1:])
