"""Writers (K1-K12). Results that grow are written by Spark; driver-side files take small, bounded ones."""

from __future__ import annotations

import json
import os
import tempfile
import uuid
from pathlib import Path, PurePosixPath
from typing import Any

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rows that a single driver-side file may take.
SMALL = 100_000


def small_rows(df: DataFrame, limit: int = SMALL) -> list[dict]:
    rows = df.limit(limit + 1).collect()
    if len(rows) > limit:
        raise ValueError(f"more than {limit} rows: write a directory instead")
    return [r.asDict(recursive=True) for r in rows]


def write_csv(df: DataFrame, path: str, empty: str = "error") -> None:
    """K1: with header; an empty frame is an error, or written as a header ('header') or not at all ('skip')."""
    if df.isEmpty():
        if empty == "error":
            raise ValueError("nothing to write")
        if empty == "skip":
            return
    df.write.mode("overwrite").option("header", True).csv(path)


def write_json(df: DataFrame, path: str, single: bool = False) -> None:
    """K2: JSON lines; or one file with a JSON array, indented, for a small result."""
    if single:
        atomic_dump(small_rows(df), path)
    else:
        df.write.mode("overwrite").option("ignoreNullFields", False).json(path)


def atomic_dump(value: Any, path: str, replace: bool = True) -> None:
    """K3: written beside and renamed; refuses to replace if told so."""
    if not replace and os.path.exists(path):
        raise FileExistsError(path)
    with tempfile.NamedTemporaryFile("w", encoding="utf-8", dir=os.path.dirname(os.path.abspath(path)), delete=False) as f:
        json.dump(value, f, ensure_ascii=False, indent=2)
        f.flush()
        os.fsync(f.fileno())
    os.replace(f.name, path)


def backup_once(path: str, suffix: str = ".bak") -> bool:
    """K4: a copy beside the file unless there is one; whether it was made now."""
    copy = Path(path + suffix)
    if copy.exists():
        return False
    copy.write_bytes(Path(path).read_bytes())
    return True


def fixed_decimals(df: DataFrame, digits: int = 10) -> DataFrame:
    """K5: doubles as text with fixed decimals."""
    return df.select(*[F.format_string(f"%.{digits}f", F.col(f"`{c}`")).alias(c) if t in ("double", "float") else F.col(f"`{c}`") for c, t in df.dtypes])


def put_text(spark: SparkSession, text: str, path: str, replace: bool = True) -> None:
    """K3 in any store that Spark reaches: a small text file, written beside and renamed."""
    conf = spark._jsc.sc().hadoopConfiguration()
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    fs = target.getFileSystem(conf)
    if fs.exists(target) and not replace:
        raise FileExistsError(path)
    beside = spark._jvm.org.apache.hadoop.fs.Path(f"{path}.{uuid.uuid4().hex}.tmp")
    out = fs.create(beside)
    try:
        out.write(bytearray(text.encode()))
    finally:
        out.close()
    if fs.exists(target):
        fs.delete(target, False)
    if not fs.rename(beside, target):
        raise OSError(f"can't write {path}")


def put_json(spark: SparkSession, value: Any, path: str, replace: bool = True) -> None:
    """K2, K3: one JSON value, indented, in any store."""
    put_text(spark, json.dumps(value, ensure_ascii=False, indent=2), path, replace)


def put_backup(spark: SparkSession, path: str, suffix: str = ".bak") -> bool:
    """K4 in any store: a copy beside the file unless there is one; whether it was made now."""
    conf = spark._jsc.sc().hadoopConfiguration()
    hadoop = spark._jvm.org.apache.hadoop.fs
    source, copy = hadoop.Path(path), hadoop.Path(path + suffix)
    fs = source.getFileSystem(conf)
    if fs.exists(copy):
        return False
    return hadoop.FileUtil.copy(fs, source, fs, copy, False, conf)


def sheet_name(name: str, taken: set[str]) -> str:
    """K6: at most 31 characters, none that a workbook forbids, and none twice."""
    base = "".join("_" if c in "[]:*?/\\" else c for c in name)[:31] or "sheet"
    out, k = base, 1
    while out.lower() in taken:
        k += 1
        out = f"{base[: 31 - len(str(k)) - 1]}~{k}"
    taken.add(out.lower())
    return out


def workbook(sheets: dict[str, list[list[Any]]]) -> bytes:
    """An OOXML workbook of small tables: text inline, numbers as numbers, None as an empty cell."""
    import io
    import zipfile
    from xml.sax.saxutils import escape, quoteattr

    def cell(v: Any) -> str:
        if v is None:
            return "<c/>"
        if isinstance(v, (int, float)) and not isinstance(v, bool):
            return f"<c><v>{v!r}</v></c>"
        return f'<c t="inlineStr"><is><t xml:space="preserve">{escape(str(v))}</t></is></c>'

    head = '<?xml version="1.0" encoding="UTF-8" standalone="yes"?>'
    main, rel = "http://schemas.openxmlformats.org/spreadsheetml/2006/main", "http://schemas.openxmlformats.org/officeDocument/2006/relationships"
    package = "http://schemas.openxmlformats.org/package/2006"
    kind = "application/vnd.openxmlformats-officedocument.spreadsheetml"
    taken: set[str] = set()
    names = [sheet_name(n, taken) for n in sheets]
    parts = {f"xl/worksheets/sheet{k}.xml": f'{head}<worksheet xmlns="{main}"><sheetData>' + "".join("<row>" + "".join(map(cell, row)) + "</row>" for row in rows) + "</sheetData></worksheet>" for k, rows in enumerate(sheets.values(), 1)}
    listed = range(1, len(names) + 1)
    parts["xl/workbook.xml"] = f'{head}<workbook xmlns="{main}" xmlns:r="{rel}"><sheets>' + "".join(f'<sheet name={quoteattr(n)} sheetId="{k}" r:id="r{k}"/>' for k, n in zip(listed, names, strict=True)) + "</sheets></workbook>"
    parts["xl/_rels/workbook.xml.rels"] = f'{head}<Relationships xmlns="{package}/relationships">' + "".join(f'<Relationship Id="r{k}" Type="{rel}/worksheet" Target="worksheets/sheet{k}.xml"/>' for k in listed) + "</Relationships>"
    parts["_rels/.rels"] = f'{head}<Relationships xmlns="{package}/relationships"><Relationship Id="r1" Type="{rel}/officeDocument" Target="xl/workbook.xml"/></Relationships>'
    parts["[Content_Types].xml"] = f'{head}<Types xmlns="{package}/content-types"><Default Extension="rels" ContentType="application/vnd.openxmlformats-package.relationships+xml"/><Override PartName="/xl/workbook.xml" ContentType="{kind}.sheet.main+xml"/>' + "".join(f'<Override PartName="/xl/worksheets/sheet{k}.xml" ContentType="{kind}.worksheet+xml"/>' for k in listed) + "</Types>"
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as z:
        for name, body in parts.items():
            z.writestr(name, body)
    return out.getvalue()


def read_workbook(raw: bytes) -> dict[str, list[list[str | None]]]:
    """The sheets of `workbook`, cells as text."""
    import io
    import zipfile
    from xml.etree import ElementTree

    ns = {"m": "http://schemas.openxmlformats.org/spreadsheetml/2006/main"}
    out = {}
    with zipfile.ZipFile(io.BytesIO(raw)) as z:
        names = [s.get("name") for s in ElementTree.fromstring(z.read("xl/workbook.xml")).iterfind(".//m:sheet", ns)]
        for k, name in enumerate(names, 1):
            rows = ElementTree.fromstring(z.read(f"xl/worksheets/sheet{k}.xml")).iterfind(".//m:row", ns)
            out[name] = [["".join(c.itertext()) or None for c in row] for row in rows]
    return out


def write_sheets(sheets: dict[str, DataFrame], path: str) -> None:
    """K6: one workbook of small frames, in any store, headers first."""
    spark = next(iter(sheets.values())).sparkSession
    body = workbook({name: [list(df.columns), *[list(r.values()) for r in small_rows(df)]] for name, df in sheets.items()})
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    out = target.getFileSystem(spark._jsc.sc().hadoopConfiguration()).create(target, True)
    try:
        out.write(bytearray(body))
    finally:
        out.close()


def csv_block(df: DataFrame, title: str, limit: int = 1000) -> str:
    """A titled block of CSV text for a small result."""
    import csv
    import io

    out = io.StringIO()
    w = csv.writer(out, quoting=csv.QUOTE_MINIMAL, lineterminator="\n")
    w.writerow(df.columns)
    w.writerows([["" if v is None else v for v in r.values()] for r in small_rows(df, limit)])
    return f"=== {title} ===\n{out.getvalue()}"


def dense_path(source: str, directory: str | None = None) -> str:
    """K12: '<stem>_dense<suffix>'; a source that is dense already keeps its name, in another directory only."""
    p = PurePosixPath(source)
    name = p.name if p.stem.endswith("_dense") else f"{p.stem}_dense{p.suffix}"
    out = str(PurePosixPath(directory) / name if directory else p.with_name(name))
    if out == source:
        raise ValueError("source and destination are one file")
    return out
