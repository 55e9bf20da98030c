"""Statement documents: workbooks and PDF files read with the standard library, and their projections.

Only workbooks in the zip format are read: legacy ``.xls`` files are listed and quarantined with an error, unless a
``reader`` for them is given. PDF text comes from a pluggable extractor; the default reads plain and Flate streams and their text operators,
which suffices for simple statements, not for encoded fonts or scans.
"""

from __future__ import annotations

import io
import os
import posixpath
import re
import xml.etree.ElementTree as ET
import zipfile
import zlib
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

_MAIN = "{http://schemas.openxmlformats.org/spreadsheetml/2006/main}"
DOCUMENT_SCHEMA = "source_file string, filename string, file_type string, content string, row_count long, columns array<string>, error string"


_LINKS = "{http://schemas.openxmlformats.org/officeDocument/2006/relationships}id"


def _first_sheet(z: zipfile.ZipFile) -> str:
    """The path of the first sheet in the workbook's own order; by name where the workbook doesn't say."""
    names = z.namelist()
    if {"xl/workbook.xml", "xl/_rels/workbook.xml.rels"} <= set(names):
        target = {r.get("Id"): r.get("Target", "") for r in ET.fromstring(z.read("xl/_rels/workbook.xml.rels"))}
        for sheet in ET.fromstring(z.read("xl/workbook.xml")).iter(f"{_MAIN}sheet"):
            path = target.get(sheet.get(_LINKS), "")
            path = path.lstrip("/") if path.startswith("/") else posixpath.normpath(f"xl/{path}")
            if path in names:
                return path
    return sorted((n for n in names if n.startswith("xl/worksheets/sheet")), key=lambda n: (len(n), n))[0]


def _date_styles(z: zipfile.ZipFile) -> set[int]:
    """Cell styles that show a number as a date."""
    if "xl/styles.xml" not in z.namelist():
        return set()
    root = ET.fromstring(z.read("xl/styles.xml"))
    own = {int(f.get("numFmtId", "0")): f.get("formatCode", "") for f in root.iter(f"{_MAIN}numFmt")}
    dated = {14, 15, 16, 17, 22} | {k for k, code in own.items() if re.search("[yd]", re.sub(r'"[^"]*"|\[[^\]]*\]', "", code.lower()))}
    styles = root.find(f"{_MAIN}cellXfs")
    return {k for k, x in enumerate(styles if styles is not None else []) if int(x.get("numFmtId", "0")) in dated}


def _date(serial: str) -> str:
    """A date's number as ISO text; the time of day is left out."""
    return (pd.Timestamp("1899-12-30") + pd.Timedelta(days=int(float(serial)))).strftime("%Y-%m-%d")


def sheet_rows(data: bytes) -> list[list[str]]:
    """Cells of a workbook's first sheet as text."""
    with zipfile.ZipFile(io.BytesIO(data)) as z:
        shared: list[str] = []
        if "xl/sharedStrings.xml" in z.namelist():
            shared = ["".join(t.text or "" for t in si.iter(f"{_MAIN}t")) for si in ET.fromstring(z.read("xl/sharedStrings.xml")).iter(f"{_MAIN}si")]
        out, dates = [], _date_styles(z)
        for row in ET.fromstring(z.read(_first_sheet(z))).iter(f"{_MAIN}row"):
            cells: dict[int, str] = {}
            for c in row.iter(f"{_MAIN}c"):
                at = 0
                for ch in c.get("r", "A").rstrip("0123456789"):
                    at = at * 26 + ord(ch) - 64
                v = c.find(f"{_MAIN}v")
                kind = c.get("t")
                if kind == "inlineStr":
                    cells[at - 1] = "".join(t.text or "" for t in c.iter(f"{_MAIN}t"))
                elif v is not None:
                    text = v.text or ""
                    if kind == "s":
                        text = shared[int(text)]
                    elif kind == "b":
                        text = "TRUE" if text == "1" else "FALSE"
                    elif kind in (None, "n") and text and int(c.get("s", "0")) in dates:
                        text = _date(text)
                    cells[at - 1] = text
            out.append([cells.get(k, "") for k in range(max(cells, default=-1) + 1)])
    return out


def markdown(rows: list[list[str]]) -> tuple[str, list[str], int]:
    """(table, columns, data rows): the header is the first row with the most filled cells, so bank lines above it are skipped."""
    if not rows:
        return "", [], 0
    filled = [sum(1 for c in r if c.strip()) for r in rows]
    head = filled.index(max(filled))
    columns, body = rows[head], [r for r in rows[head + 1 :] if any(c.strip() for c in r)]
    cell = lambda x: " ".join(x.splitlines()).replace("\\", "\\\\").replace("|", "\\|")
    line = lambda r: "| " + " | ".join([*map(cell, r), *[""] * (len(columns) - len(r))]) + " |"
    return "\n".join([line(columns), line(["---"] * len(columns)), *map(line, body)]), columns, len(body)


Reader = Callable[[bytes], list[list[str]]]


def _reading(readers: dict[str, Reader]) -> Callable[[Iterator[pd.DataFrame]], Iterator[pd.DataFrame]]:
    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = []
            for path, data in zip(batch["path"], batch["content"], strict=True):
                name = os.path.basename(path)
                try:
                    text, columns, n = markdown(readers[name.rsplit(".", 1)[-1]](bytes(data)))
                    out.append((path, name, "xlsx", text, n, columns, None))
                except Exception as e:  # one bad file is quarantined, the rest go on
                    out.append((path, name, "xlsx", None, 0, [], f"{type(e).__name__}: {e}"))
            yield pd.DataFrame(out, columns=[c.split()[0] for c in DOCUMENT_SCHEMA.split(", ")])

    return read


def _checked(spark: SparkSession, folder: str) -> str:
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder)
    if not path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(path):
        raise FileNotFoundError(folder)
    return folder


def load_workbooks(spark: SparkSession, folder: str, readers: dict[str, Reader] | None = None) -> DataFrame:
    """Workbooks directly in ``folder``. Empty ones are left out; unreadable ones have ``error``. A missing folder raises.

    ``readers``: by suffix, functions of a file's bytes to rows of cells, in addition to the one for ``xlsx``.
    """
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.{xlsx,xls}").load(_checked(spark, folder)).select("path", "content")
    known = {"xlsx": sheet_rows, "xls": sheet_rows} | (readers or {})
    return files.mapInPandas(_reading(known), DOCUMENT_SCHEMA).where("row_count > 0 or error is not null")


_STREAM = re.compile(rb"<<(?P<head>(?:[^<>]|<<.*?>>|<[^<>]*>)*)>>\s*stream\r?\n(?P<body>.*?)\r?\nendstream", re.DOTALL)
_SHOWN = re.compile(rb"\((?P<one>(?:\\.|[^\\()])*)\)\s*(?P<op>Tj|'|\")|\[(?P<many>(?:\((?:\\.|[^\\()])*\)|[^\]])*)\]\s*TJ|(?P<line>T\*|Td|TD|Tm)\b", re.DOTALL)
_ESCAPED = re.compile(rb"\\([0-7]{1,3}|.)", re.DOTALL)
_ESCAPES = {b"n": b"\n", b"r": b"\r", b"t": b"\t", b"b": b"\b", b"f": b"\f"}


def _literal(raw: bytes) -> str:
    one = lambda m: bytes([int(m[1], 8) & 255]) if m[1].isdigit() else _ESCAPES.get(m[1], m[1])
    return _ESCAPED.sub(one, raw).decode("cp1252", "replace")


def pdf_pages(data: bytes) -> list[str]:
    """The text of each content stream that shows text, in file order: a line for each text position."""
    if not data.startswith(b"%PDF"):
        raise ValueError("not a PDF file")
    pages = []
    for m in _STREAM.finditer(data):
        body = m["body"]
        if b"FlateDecode" in m["head"]:
            try:
                body = zlib.decompressobj().decompress(body)
            except zlib.error:
                continue  # an image or a font
        lines = [""]
        for part in re.findall(rb"\bBT\b(.*?)\bET\b", body, re.DOTALL):
            for t in _SHOWN.finditer(part):
                if t["line"] or t["op"] in (b"'", b'"'):
                    lines.append("")
                if t["one"] is not None:
                    lines[-1] += _literal(t["one"])
                elif t["many"] is not None:
                    lines[-1] += "".join(_literal(x) for x in re.findall(rb"\(((?:\\.|[^\\()])*)\)", t["many"], re.DOTALL))
            lines.append("")
        text = "\n".join(x for x in lines if x.strip())
        if text:
            pages.append(text)
    return pages


def load_pdfs(spark: SparkSession, folder: str, extract: Callable[[bytes], list[str]] = pdf_pages) -> DataFrame:
    """PDF files in ``folder`` and below, one row for each page; ``extract`` turns a file's bytes into its pages' texts."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", "*.pdf").load(_checked(spark, folder)).select("path", "content")

    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = []
            for path, data in zip(batch["path"], batch["content"], strict=True):
                name = os.path.basename(path)
                try:
                    pages = extract(bytes(data))
                    out += [(path, name, "pdf", page, len(page.splitlines()), [], None) for page in pages]
                except Exception as e:
                    out.append((path, name, "pdf", None, 0, [], f"{type(e).__name__}: {e}"))
            yield pd.DataFrame(out, columns=[c.split()[0] for c in DOCUMENT_SCHEMA.split(", ")])

    return files.mapInPandas(read, DOCUMENT_SCHEMA)


def load_documents(spark: SparkSession, folder: str, extract: Callable[[bytes], list[str]] = pdf_pages, readers: dict[str, Reader] | None = None) -> DataFrame:
    """All documents of ``folder``: PDF files at any depth, workbooks directly in it. Raises if there are none."""
    return require_documents(load_pdfs(spark, folder, extract).unionByName(load_workbooks(spark, folder, readers)))


def require_documents(df: DataFrame) -> DataFrame:
    """Raise if there is no document at all."""
    if df.isEmpty():
        raise FileNotFoundError("no statement documents found")
    return df


def file_type(path: Column) -> Column:
    return F.when(path.endswith(".xlsx") | path.endswith(".xls"), "xlsx").otherwise("pdf")


def raw_documents(df: DataFrame, path_col: str, content_col: str) -> DataFrame:
    """(source_file, file_type, content)."""
    return df.select(F.col(path_col).alias("source_file"), file_type(F.col(path_col)).alias("file_type"), F.col(content_col).alias("content"))


def parse_statement(docs: DataFrame) -> DataFrame:
    """Transactions of Markdown statements: (source_file, pos, date, amount_original, currency, merchant, account).

    Columns are found by their English or Spanish names; totals and lines without an amount are left out.
    """
    # A pipe after a backslash is part of a cell. The header comes from the same row as its lines, so nothing is joined.
    cells = lambda line: F.transform(
        F.split(F.regexp_replace(line, r"^\||\|$", ""), r"(?<!\\)\|"), lambda x: F.regexp_replace(F.trim(x), r"\\(.)", "$1")
    )
    lines = F.split("content", "\n")
    rows = docs.select("source_file", F.transform(cells(F.get(lines, F.lit(0))), lambda x: F.lower(x)).alias("h"), F.posexplode(lines).alias("pos", "line"))
    body = rows.where(F.col("line").startswith("|") & (F.col("pos") > 1)).withColumn("c", cells(F.col("line")))

    def named(*names: str) -> Column:
        at = F.filter(F.sequence(F.lit(1), F.size("h")), lambda i: F.regexp_like(F.element_at("h", i), F.lit("^(" + "|".join(names) + ")")))
        return F.when(F.size(at) > 0, F.get("c", F.get(at, F.lit(0)) - 1))

    amount = F.regexp_replace(named("importe", "amount"), ",", "").try_cast("double")
    out = body.select("source_file", "pos", named("fecha", "date").alias("date"), amount.alias("amount_original"), named("moneda", "currency").alias("currency"), named("descripci", "description").alias("merchant"), named("cuenta", "account").alias("account"))
    return out.where(F.col("amount_original").isNotNull() & ~F.coalesce(F.upper("merchant").startswith("TOTAL") | F.upper("date").startswith("TOTAL"), F.lit(False)))
