"""File readers and the checks in front of them."""

from __future__ import annotations

import codecs
import csv
import io
import ipaddress
import re
import socket
import zipfile
from collections.abc import Iterator, Sequence
from functools import reduce
from itertools import zip_longest
from urllib.parse import urlsplit
from xml.etree import ElementTree

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessera.functions import text
from tessera.plans.schemas import DIRECTIONS, EXPERIMENT_COLUMNS

MOST_BYTES = 5 * 1024 * 1024
SUFFIXES = ("csv", "txt", "md", "html", "xlsx", "pdf", "docx", "zip")
# Limits of archives: depth, bytes of a member, of all members, unpacked over packed size, members.
DEPTH, MEMBER, ARCHIVE, RATIO, MEMBERS = 8, 100 << 20, 512 << 20, 200, 200_000
SHEETS, ROWS, COLUMNS = 50, 5000, 60


def scan(spark: SparkSession, path: str, suffixes: Sequence[str] = SUFFIXES, most_bytes: int | None = None) -> DataFrame:
    """Files below a directory (path, length, content) with one of the suffixes; size limits are checked on metadata."""
    found = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
    kept = found.filter(F.lower(F.regexp_extract("path", r"\.([A-Za-z0-9]+)$", 1)).isin(*suffixes))
    return kept.filter(F.col("length") <= most_bytes) if most_bytes is not None else kept


def upload_errors(name: Column, length: Column, suffixes: Sequence[str] = SUFFIXES, most_bytes: int = MOST_BYTES) -> Column:
    """Why a file can't be taken, null if it can."""
    return (
        F.when((F.length(name) == 0) | (F.length(name) > 160), "bad_name_length").when(name.rlike(r"[/\\\x00-\x1f]"), "bad_name")
        .when(~F.lower(F.regexp_extract(name, r"\.([A-Za-z0-9]+)$", 1)).isin(*suffixes), "unsupported_type")
        .when(length == 0, "empty").when(length > most_bytes, "too_large")
    )


def decode_bytes(content: bytes) -> tuple[str, str]:
    """Text of bytes and the encoding that fits: UTF-8 with or without a mark, Windows-1251, else UTF-8 with replacements."""
    if content.startswith(codecs.BOM_UTF8):
        content, name = content[3:], "utf-8-sig"
    else:
        name = "utf-8"
    for encoding in ("utf-8", "cp1251"):
        try:
            return content.decode(encoding), name if encoding == "utf-8" else encoding
        except UnicodeDecodeError:
            pass
    return content.decode("utf-8", "replace"), "utf-8-replace"


@F.pandas_udf(T.StructType().add("text", "string").add("encoding", "string"))
def decoded(content: pd.Series) -> pd.DataFrame:
    return pd.DataFrame([decode_bytes(c or b"") for c in content], columns=["text", "encoding"])


def text_spans(files: DataFrame, body: str = "text") -> DataFrame:
    """Non-blank lines that are no headings, numbered from 2 in the order of the file."""
    lines = F.filter(F.split(body, r"\r\n|[\n\r]"), lambda x: (F.trim(x) != "") & ~F.trim(x).startswith("#"))
    each = files.select("path", F.posexplode(lines).alias("i", "line"))
    return each.select("path", (F.col("i") + 2).alias("ordinal"), F.trim("line").alias("visible_text"))


def read_experiments(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """Rows of experiment tables that can be read, typed, with the change of the value; and the others with a reason.

    A file without one of the columns fails the read.
    """
    raw = spark.read.option("header", True).option("enforceSchema", False).csv(path)
    missing = [c for c in EXPERIMENT_COLUMNS if c not in raw.columns]
    if missing:
        raise ValueError(f"missing columns: {', '.join(missing)}")
    rows = raw.select(*(F.trim(c).alias(c) for c in EXPERIMENT_COLUMNS))
    return decode_experiments(rows)


def decode_experiments(rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    floats = ("temperature_c", "duration_h", "baseline_value", "treated_value")
    names = [c for c in EXPERIMENT_COLUMNS if c not in floats]
    typed = rows.withColumns({c: F.col(c).try_cast("double") for c in floats})
    bad = reduce(
        lambda out, t: F.when(t[0], t[1]).otherwise(out),
        [*((F.col(c).isNull(), f"not_a_number:{c}") for c in floats), *((F.coalesce(F.col(c), F.lit("")) == "", f"empty:{c}") for c in names), (~F.coalesce(F.col("effect").isin(*DIRECTIONS), F.lit(False)), "unknown_effect")],
        F.lit(None).cast("string"),
    )
    marked = typed.withColumn("delta_value", F.round(F.col("treated_value") - F.col("baseline_value"), 6)).withColumn("reason", bad)
    return marked.filter("reason is null").drop("reason"), marked.filter("reason is not null")


def csv_rows(found: DataFrame) -> DataFrame:
    """Rows of tables with a header (path, content): path, ordinal (2 for the first row of a file), headers, values as trimmed text.

    Each file has its own header. Short rows are filled up; rows and header cells without content go.
    """

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for path, content in zip(frame["path"], frame["content"], strict=True):
                out, headers = [], None
                for n, cells in enumerate(csv.reader(io.StringIO(decode_bytes(content or b"")[0], newline="")), 1):
                    cells = [c.strip() for c in cells]
                    if headers is None:
                        headers = cells
                    elif any(cells):
                        row = [(h, v) for h, v in zip_longest(headers, cells[: len(headers)], fillvalue="") if h]
                        out.append((path, n, [h for h, _ in row], [v for _, v in row]))
                if out:
                    yield pd.DataFrame(out, columns=["path", "ordinal", "headers", "values"])

    return found.select("path", "content").mapInPandas(run, "path string, ordinal bigint, headers array<string>, values array<string>")


def generic_rows(rows: DataFrame) -> DataFrame:
    """Rows of any table with a header as labelled text; rows without content go."""
    headers = F.array(*(F.lit(c) for c in rows.columns))
    values = F.array(*(F.coalesce(F.trim(F.col(f"`{c}`").cast("string")), F.lit("")) for c in rows.columns))
    return rows.select(headers.alias("headers"), values.alias("values"), text.labelled(headers, values).alias("visible_text")).filter("visible_text <> ''")


def packed_lines(lines: Column, most: int = 800) -> Column:
    """Trimmed lines that are not blank, joined by a space to blocks that end before they would pass `most` characters, each line counting one more."""
    lines = F.filter(F.transform(lines, lambda x: F.trim(x)), lambda x: x != "")
    start = F.struct(F.array().cast("array<string>").alias("done"), F.lit("").alias("open"), F.lit(0).alias("size"))
    def step(s: Column, x: Column) -> Column:
        full = (s["size"] + F.length(x) > most) & (s["size"] > 0)
        return F.struct(
            F.when(full, F.concat(s["done"], F.array(s["open"]))).otherwise(s["done"]).alias("done"),
            F.when(full | (s["size"] == 0), x).otherwise(F.concat_ws(" ", s["open"], x)).alias("open"),
            F.when(full, F.length(x) + 1).otherwise(s["size"] + F.length(x) + 1).alias("size"),
        )
    return F.aggregate(lines, start, step, lambda s: F.when(s["size"] > 0, F.concat(s["done"], F.array(s["open"]))).otherwise(s["done"]))


def html_text(html: Column) -> Column:
    """Visible text of a page: no scripts, styles, comments, navigation; tags as space, the common entities as characters."""
    out = html
    for pattern, new in (
        (r"(?is)<!--.*?-->", " "), (r"(?is)<(script|style|nav|noscript|template|header|footer|aside|form)\b.*?</\1\s*>", " "),
        (r"(?i)<(br|p|div|li|h[1-6]|tr|article|section|ul|ol|table)\b[^>]*>", "\n"), (r"(?s)<[^>]*>", " "),
    ):
        out = F.regexp_replace(out, pattern, new)
    for name, sign in (("&nbsp;", " "), ("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&amp;", "&")):
        out = F.replace(out, F.lit(name), F.lit(sign))
    return F.trim(F.regexp_replace(F.regexp_replace(out, r"[ \t]+", " "), r"\s*\n\s*", "\n"))


def html_title(html: Column) -> Column:
    return F.trim(F.regexp_extract(html, r"(?is)<title[^>]*>(.*?)</title>", 1))


def is_public(url: str, resolve=socket.getaddrinfo) -> bool:
    """Whether a URL is http(s) and every address of its host is public; checked before a fetch is planned."""
    parts = urlsplit(url)
    if parts.scheme not in ("http", "https") or not parts.hostname:
        return False
    try:
        found = {a[4][0] for a in resolve(parts.hostname, parts.port or 443)}
    except OSError:
        return False
    return bool(found) and all(ipaddress.ip_address(a.split("%")[0]).is_global for a in found)


def members(name: str, content: bytes, depth: int = 0) -> Iterator[tuple[str, bytes | None, str | None]]:
    """(member path, bytes, reason why not) of an archive, archives inside it opened too."""
    if depth >= DEPTH:
        yield name, None, "too_deep"
        return
    try:
        archive = zipfile.ZipFile(io.BytesIO(content))
        found = [i for i in archive.infolist() if not i.is_dir()]
    except (zipfile.BadZipFile, ValueError):
        yield name, None, "bad_archive"
        return
    if len(found) > MEMBERS:
        yield name, None, "too_many_members"
        return
    total = 0
    for i in found:
        path = f"{name}!/{i.filename}"
        if i.filename.startswith(("/", "\\")) or re.match(r"[A-Za-z]:", i.filename) or ".." in re.split(r"[/\\]", i.filename):
            yield path, None, "unsafe_path"
        elif i.file_size > MEMBER:
            yield path, None, "member_too_large"
        elif i.file_size > RATIO * max(1, i.compress_size):
            yield path, None, "ratio"
        elif (total := total + i.file_size) > ARCHIVE:
            yield path, None, "archive_too_large"
            return
        else:
            try:
                body = archive.open(i).read(MEMBER + 1)
            except (RuntimeError, zipfile.BadZipFile, NotImplementedError):
                yield path, None, "unreadable"
                continue
            if i.filename.lower().endswith(".zip"):
                yield from members(path, body, depth + 1)
            else:
                yield path, body, None


def expand(files: DataFrame) -> DataFrame:
    """Members of zip files (path, content): path, content, reason."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for path, content in zip(frame["path"], frame["content"], strict=True):
                for row in members(path, content or b""):
                    yield pd.DataFrame([row], columns=["path", "content", "reason"])

    return files.select("path", "content").mapInPandas(run, "path string, content binary, reason string")


_MAIN = "{http://schemas.openxmlformats.org/spreadsheetml/2006/main}"
_REL = "{http://schemas.openxmlformats.org/officeDocument/2006/relationships}id"


def sheet_rows(content: bytes) -> Iterator[tuple[str, int, list[str]]]:
    """(sheet, row, cells as text) of an xlsx workbook, within SHEETS, ROWS and COLUMNS of each."""
    book = zipfile.ZipFile(io.BytesIO(content))
    names = set(book.namelist())
    shared = []
    if "xl/sharedStrings.xml" in names:
        shared = ["".join(t.text or "" for t in s.iter(f"{_MAIN}t")) for s in ElementTree.fromstring(book.read("xl/sharedStrings.xml")).iter(f"{_MAIN}si")]
    targets = {r.get("Id"): r.get("Target") for r in ElementTree.fromstring(book.read("xl/_rels/workbook.xml.rels"))}
    for sheet in list(ElementTree.fromstring(book.read("xl/workbook.xml")).iter(f"{_MAIN}sheet"))[:SHEETS]:
        target = (targets.get(sheet.get(_REL)) or "").lstrip("/")
        path = target if target.startswith("xl/") else f"xl/{target}"
        if path not in names:
            continue
        for n, row in enumerate(ElementTree.fromstring(book.read(path)).iter(f"{_MAIN}row")):
            if n >= ROWS:
                break
            cells: list[str] = []
            for cell in row.iter(f"{_MAIN}c"):
                letters = re.match("[A-Z]*", cell.get("r") or "")[0]
                at = reduce(lambda a, c: a * 26 + ord(c) - 64, letters, 0) - 1 if letters else len(cells)
                if at >= COLUMNS:
                    break
                value = cell.find(f"{_MAIN}v")
                body = "".join(t.text or "" for t in cell.iter(f"{_MAIN}t")) if cell.get("t") == "inlineStr" else (value.text or "") if value is not None else ""
                cells += [""] * (at - len(cells))
                cells.append(shared[int(body)] if cell.get("t") == "s" and body else body)
            yield sheet.get("name") or "", n, [c.strip() for c in cells]


def spreadsheets(files: DataFrame) -> DataFrame:
    """Rows of workbooks below their header, the first row with two cells or more: path, sheet, row, headers, values."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for path, content in zip(frame["path"], frame["content"], strict=True):
                out, headers, last = [], None, None
                for sheet, n, cells in sheet_rows(content):
                    if sheet != last:
                        headers, last = None, sheet
                    if headers is None:
                        headers = cells if sum(map(bool, cells)) >= 2 else None
                    elif any(cells):
                        width = max(len(headers), len(cells))
                        out.append((path, sheet, n, headers + [""] * (width - len(headers)), cells + [""] * (width - len(cells))))
                if out:
                    yield pd.DataFrame(out, columns=["path", "sheet", "row", "headers", "values"])

    return files.select("path", "content").mapInPandas(run, "path string, sheet string, row int, headers array<string>, values array<string>")


def parse_documents(files: DataFrame, parser, schema: str) -> DataFrame:
    """Files through a pluggable parser: `parser(path, content)` gives rows of the schema; it is made once a worker and may raise.

    A file that a parser fails on is one row with the reason in `error`, the schema's last column.
    """
    width = schema.count(",") + 1

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for path, content in zip(frame["path"], frame["content"], strict=True):
                try:
                    rows = [tuple(r) for r in parser(path, content)]
                except Exception as e:  # the reason is data: the file is quarantined
                    rows = [(path, *[None] * (width - 2), f"[parser_error] {e}")]
                if rows:
                    yield pd.DataFrame(rows, columns=[c.split()[0] for c in schema.split(", ")])

    return files.select("path", "content").mapInPandas(run, schema)
