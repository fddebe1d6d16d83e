"""Files as page records: source_name, text, page_start, page_end, parser, metadata.

Spark lists and reads the files (binaryFile) and deals them to tasks; a task turns the bytes of one file into its
records. Files of other kinds are left out, those that cannot be read give a record with the parser `failed`.
"""

from __future__ import annotations

import csv
import io
import re
import zipfile
from collections.abc import Callable, Iterator
from xml.etree import ElementTree

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

PAGE = "source_name string, text string, page_start int, page_end int, parser string, metadata map<string,string>"
Record = tuple[str, int, int, str, dict[str, str]]
#: A parser of PDF bytes gives the texts of its pages; None where there is no such library.
PdfParser = Callable[[bytes], list[str]]
INDEXED, CHARTED = ("pdf", "docx", "txt", "md", "markdown"), ("pdf", "docx", "txt", "md", "xlsx", "csv")
# Front matter of a markdown file, and separators in the order in which they are tried.
FRONT = re.compile(r"^---\s*\n(.*?)\n---\s*\n(.*)$", re.DOTALL)
SEPARATORS = (",", ";", "\t", "|")
W = "{http://schemas.openxmlformats.org/wordprocessingml/2006/main}"
X = "{http://schemas.openxmlformats.org/spreadsheetml/2006/main}"
R = "{http://schemas.openxmlformats.org/officeDocument/2006/relationships}id"


def plain(data: bytes, name: str) -> Record:
    """UTF-8, else Latin-1. A markdown file's YAML front matter becomes metadata, if it can be read."""
    try:
        text = data.decode("utf-8")
    except UnicodeDecodeError:
        return data.decode("latin-1"), 1, 1, "text_latin1", {}
    metadata: dict[str, str] = {}
    front = FRONT.match(text) if name.lower().endswith((".md", ".markdown")) else None
    if front:
        import yaml

        try:
            found = yaml.safe_load(front[1]) or {}
        except yaml.YAMLError:
            return text, 1, 1, "text", {}
        text = front[2]
        metadata = {str(k): str(v) for k, v in found.items()} if isinstance(found, dict) else {}
    return text, 1, 1, "text", metadata


def _runs(element: ElementTree.Element) -> str:
    names = {f"{W}t": None, f"{W}tab": "\t", f"{W}br": "\n"}
    return "".join((e.text or "") if names[e.tag] is None else names[e.tag] for e in element.iter() if e.tag in names)


def docx(data: bytes, tables: bool = True) -> Record:
    """Paragraphs and, as markdown, tables in the order of the body, apart by blank lines."""
    with zipfile.ZipFile(io.BytesIO(data)) as z:
        body = ElementTree.fromstring(z.read("word/document.xml")).find(f"{W}body")
    parts = []
    for element in body:
        if element.tag == f"{W}p" and (text := _runs(element)).strip():
            parts.append(text)
        elif element.tag == f"{W}tbl" and tables:
            rows = [["\n".join(map(_runs, cell.iter(f"{W}p"))).strip() for cell in row.iter(f"{W}tc")] for row in element.iter(f"{W}tr")]
            shown = [f"| {' | '.join(cells)} |\n" for cells in rows]
            parts.append("".join([*shown[:1], *[f"|{'---|' * len(rows[0])}\n"][: len(rows)], *shown[1:]] if rows else []))
    return "\n\n".join(parts), 1, 1, "docx", {}


def number(value: str) -> str:
    """Whole numbers without a decimal point."""
    try:
        x = float(value)
    except ValueError:
        return value
    return str(int(x)) if x.is_integer() and abs(x) < 1e15 else repr(x)


def lines(header: list[str], rows: list[list[str]]) -> str:
    """`header: value` for each filled cell, and a blank line after each row."""
    shown = lambda row: "".join(f"{h}: {number(v)}\n" for h, v in zip(header, row, strict=False) if v.strip())
    return f"Columns: {' | '.join(header)}\n\n" + "".join(shown(row) + "\n" for row in rows)


def _column(reference: str) -> int:
    n = 0
    for c in reference:
        if not c.isalpha():
            break
        n = n * 26 + ord(c.upper()) - 64
    return n - 1


def xlsx(data: bytes) -> Record:
    """The sheets of a workbook, each with its name, columns and rows; sheets that cannot be read are left out."""
    with zipfile.ZipFile(io.BytesIO(data)) as z:
        names = set(z.namelist())
        shared = ["".join(t.text or "" for t in s.iter(f"{X}t")) for s in ElementTree.fromstring(z.read("xl/sharedStrings.xml"))] if "xl/sharedStrings.xml" in names else []
        targets = {r.get("Id"): r.get("Target") for r in ElementTree.fromstring(z.read("xl/_rels/workbook.xml.rels"))}
        out = []
        for sheet in ElementTree.fromstring(z.read("xl/workbook.xml")).iter(f"{X}sheet"):
            target = targets.get(sheet.get(R), "")
            path = target.lstrip("/") if target.startswith("/") else f"xl/{target}"
            if path not in names:
                continue
            rows = []
            for row in ElementTree.fromstring(z.read(path)).iter(f"{X}row"):
                cells: dict[int, str] = {}
                for place, c in enumerate(row.iter(f"{X}c")):
                    value = c.findtext(f"{X}v") or ""
                    if c.get("t") == "s" and value:
                        value = shared[int(value)]
                    elif c.get("t") == "inlineStr":
                        value = "".join(t.text or "" for t in c.iter(f"{X}t"))
                    cells[_column(c.get("r")) if c.get("r") else place] = value
                rows.append([cells.get(i, "") for i in range(max(cells, default=-1) + 1)])
            if len(rows) > 1:
                out.append(f"Sheet: {sheet.get('name')}\n" + lines(rows[0], rows[1:]))
    if not out:
        raise ValueError("no readable data")
    return "\n\n".join(out), 1, 1, "xlsx", {}


def table(data: bytes, name: str, structured: bool = True) -> Record:
    """A CSV file as `header: value` lines, its separator the first that gives two columns; else, or if so asked, as it is."""
    text = data.decode("utf-8", "ignore")
    for sep in SEPARATORS if structured else ():
        rows = [r for r in csv.reader(io.StringIO(text), delimiter=sep) if r]
        if len(rows) > 1 and len(rows[0]) > 1:
            return f"CSV Data from {name}\n" + lines(rows[0], rows[1:]), 1, 1, "csv", {}
    return text, 1, 1, "csv", {}


def records(data: bytes, name: str, kind: str, pdf: PdfParser | None, structured: bool, marks: bool) -> Iterator[Record]:
    """The records of a file. With marks, as the standalone reader has it: pages of a PDF in one record under page marks, no tables
    of a DOCX, bytes that are no UTF-8 left out."""
    failed = (f"Could not extract text from {name}", 1, 1, "failed", {})
    try:
        if kind == "pdf":
            pages = pdf(data) if pdf else []
            if marks and pages:
                yield "\n".join(f"[[PAGE {i}]]\n{t}" for i, t in enumerate(pages, 1)), 1, len(pages), "pdf", {}
            else:
                found = [(t, i, i, "pdf", {}) for i, t in enumerate(pages, 1) if t.strip()]
                yield from found or [failed]
        elif kind == "docx":
            yield docx(data, tables=not marks)
        elif kind == "xlsx":
            yield xlsx(data)
        elif kind == "csv" and not marks:
            yield table(data, name, structured)
        elif marks:
            yield data.decode("utf-8", "ignore"), 1, 1, "text", {}
        else:
            yield plain(data, name)
    except Exception:  # noqa: BLE001  a damaged file must not end the job
        yield failed


def read(spark: SparkSession, path: str, kinds: tuple[str, ...] = INDEXED, pdf: PdfParser | None = None, structured: bool = True, page_marks: bool = False) -> DataFrame:
    """Page records of the files below a path, of the kinds given by their extensions (any, with page_marks)."""
    found = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
    name = F.element_at(F.split("path", "/"), -1)
    kind = F.lower(F.regexp_extract(name, r"\.([^.]+)$", 1))
    rows = found.select(name.alias("name"), kind.alias("kind"), "content")
    if not page_marks:
        rows = rows.where(F.col("kind").isin(*kinds))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for n, k, data in zip(batch.column(0), batch.column(1), batch.column(2), strict=True):
                out = [(n.as_py(), *r) for r in records(data.as_py(), n.as_py(), k.as_py(), pdf, structured, page_marks)]
                columns = list(zip(*out, strict=True)) or [()] * 6
                columns[5] = [list(m.items()) for m in columns[5]]
                types = (pa.string(), pa.string(), pa.int32(), pa.int32(), pa.string(), pa.map_(pa.string(), pa.string()))
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types, strict=True)], [x.split()[0] for x in PAGE.split(", ")])

    return rows.mapInArrow(run, PAGE)


def skipped(spark: SparkSession, path: str, kinds: tuple[str, ...] = INDEXED) -> DataFrame:
    """name of the files below a path that read() leaves out."""
    found = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path).select(F.element_at(F.split("path", "/"), -1).alias("name"))
    return found.where(~F.lower(F.regexp_extract("name", r"\.([^.]+)$", 1)).isin(*kinds))
