"""Workbooks by the standard library: reading values, merged and hidden cells; writing plain sheets.

``XlsxDataSource`` gives the same reader to ``spark.read.format("tablewright_xlsx")``.
"""

from __future__ import annotations

import io
import re
import zipfile
from collections.abc import Iterable, Iterator
from dataclasses import dataclass, field
from datetime import datetime, timedelta
from xml.etree import ElementTree as ET
from xml.sax.saxutils import escape

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader
from pyspark.sql.types import StructType

from tablewright.sources.errors import MissingSheet

_NS = "{http://schemas.openxmlformats.org/spreadsheetml/2006/main}"
_REL = "{http://schemas.openxmlformats.org/officeDocument/2006/relationships}id"
#: Built-in number formats that show dates or times.
DATE_FORMATS = {*range(14, 23), 45, 46, 47}
EPOCH = datetime(1899, 12, 30)


@dataclass
class Sheet:
    """Cell texts by row, and what the sheet hides or merges (row, column, last row, last column; from 1)."""

    name: str
    grid: list[list[str | None]] = field(default_factory=list)
    merged: list[tuple[int, int, int, int]] = field(default_factory=list)
    hidden_rows: set[int] = field(default_factory=set)
    hidden_cols: set[int] = field(default_factory=set)
    grouped_cols: set[int] = field(default_factory=set)
    filter: str | None = None


def letters(n: int) -> str:
    """Column number as letters."""
    out = ""
    while n:
        n, r = divmod(n - 1, 26)
        out = chr(65 + r) + out
    return out


def place(ref: str) -> tuple[int, int]:
    """Row and column of a reference such as B3."""
    m = re.fullmatch(r"\$?([A-Z]+)\$?(\d+)", ref)
    col = 0
    for c in m[1]:
        col = col * 26 + ord(c) - 64
    return int(m[2]), col


def range_name(m: tuple[int, int, int, int]) -> str:
    """A range as A1:B2."""
    return f"{letters(m[1])}{m[0]}:{letters(m[3])}{m[2]}"


def _entries(book: zipfile.ZipFile) -> list[tuple[str, bool, str]]:
    """Name, visibility and part of each sheet."""
    root = ET.fromstring(book.read("xl/workbook.xml"))
    rels = {r.get("Id"): r.get("Target") for r in ET.fromstring(book.read("xl/_rels/workbook.xml.rels"))}
    out = []
    for s in root.iter(f"{_NS}sheet"):
        target = rels[s.get(_REL)].lstrip("/")
        out.append((s.get("name"), s.get("state", "visible") == "visible", target if target.startswith("xl/") else f"xl/{target}"))
    return out


def _strings(book: zipfile.ZipFile) -> list[str]:
    if "xl/sharedStrings.xml" not in book.namelist():
        return []
    return ["".join(t.text or "" for t in si.iter(f"{_NS}t")) for si in ET.fromstring(book.read("xl/sharedStrings.xml")).iter(f"{_NS}si")]


def _dated_styles(book: zipfile.ZipFile) -> set[int]:
    """Cell styles that show dates or times."""
    if "xl/styles.xml" not in book.namelist():
        return set()
    root = ET.fromstring(book.read("xl/styles.xml"))
    own = {int(f.get("numFmtId")): re.sub(r'"[^"]*"|\[[^\]]*\]|\\.', "", f.get("formatCode", "")) for f in root.iter(f"{_NS}numFmt")}
    dated = DATE_FORMATS | {k for k, code in own.items() if re.search(r"[ymdhs]", code, re.I)}
    formats = root.find(f"{_NS}cellXfs")
    return {i for i, x in enumerate(formats if formats is not None else []) if int(x.get("numFmtId", 0)) in dated}


def number_text(raw: str, dated: bool) -> str:
    """A stored number as text: whole ones without a point, dated ones as dates."""
    value = float(raw)
    if dated:
        at = EPOCH + timedelta(seconds=round(value * 86400))
        if value < 1:
            return at.strftime("%H:%M:%S")
        return at.strftime("%Y-%m-%d" if at.time() == datetime.min.time() else "%Y-%m-%d %H:%M:%S")
    return str(int(value)) if value.is_integer() and abs(value) < 1e15 else repr(value)


def _cell(c: ET.Element, strings: list[str], dated: set[int]) -> str | None:
    kind, v = c.get("t", "n"), c.find(f"{_NS}v")
    if kind == "inlineStr":
        text = "".join(t.text or "" for t in c.iter(f"{_NS}t"))
    elif v is None or v.text is None:
        return None
    elif kind == "s":
        text = strings[int(v.text)]
    elif kind == "b":
        text = "Sí" if v.text == "1" else "No"
    elif kind == "n":
        text = number_text(v.text, int(c.get("s", 0)) in dated)
    elif kind == "d":
        text = v.text.replace("T", " ").removesuffix(" 00:00:00")
    else:
        text = v.text
    return text if text.strip() else None


def read_sheet(raw: bytes, name: str | None = None) -> Sheet:
    """A sheet by name, or the first."""
    with zipfile.ZipFile(io.BytesIO(raw)) as book:
        entries = _entries(book)
        found = next((e for e in entries if name is None or e[0] == name), None)
        if found is None:
            raise MissingSheet(name)
        sheet, strings, dated = Sheet(found[0]), _strings(book), _dated_styles(book)
        root = ET.fromstring(book.read(found[2]))
    for col in root.iter(f"{_NS}col"):
        span = range(int(col.get("min")), int(col.get("max")) + 1)
        if col.get("hidden") in ("1", "true"):
            sheet.hidden_cols.update(span)
        if int(col.get("outlineLevel", 0)):
            sheet.grouped_cols.update(span)
    at = 0
    for row in root.iter(f"{_NS}row"):
        at = int(row.get("r", at + 1))
        if row.get("hidden") in ("1", "true"):
            sheet.hidden_rows.add(at)
        values: list[str | None] = []
        for c in row.iter(f"{_NS}c"):
            k = place(c.get("r"))[1] if c.get("r") else len(values) + 1
            values += [None] * (k - len(values))
            values[k - 1] = _cell(c, strings, dated)
        sheet.grid += [[] for _ in range(at - len(sheet.grid))]
        sheet.grid[at - 1] = values
    for m in root.iter(f"{_NS}mergeCell"):
        a, _, b = m.get("ref").partition(":")
        sheet.merged.append((*place(a), *place(b or a)))
    filters = root.find(f"{_NS}autoFilter")
    sheet.filter = filters.get("ref") if filters is not None else None
    while sheet.grid and not any(v is not None for v in sheet.grid[-1]):
        sheet.grid.pop()
    return sheet


def filled(sheet: Sheet) -> list[list[str | None]]:
    """The cells with every merged range holding its first value throughout."""
    grid = [list(r) for r in sheet.grid]
    width = max(map(len, grid), default=0)
    for top, left, bottom, right in sheet.merged:
        value = grid[top - 1][left - 1] if top <= len(grid) and left <= len(grid[top - 1]) else None
        for r in range(top, min(bottom, len(grid)) + 1):
            grid[r - 1] += [None] * (min(right, width) - len(grid[r - 1]))
            for c in range(left, min(right, width) + 1):
                grid[r - 1][c - 1] = value
    return grid


def catalogue(raw: bytes) -> list[dict]:
    """Name, visibility and size of each sheet."""
    with zipfile.ZipFile(io.BytesIO(raw)) as book:
        entries = _entries(book)
    out = []
    for name, visible, _ in entries:
        grid = read_sheet(raw, name).grid
        out.append({"nombre": name, "visible": visible, "filas": len(grid), "columnas": max(map(len, grid), default=0)})
    return out


# ---------------------------------------------------------------- writing


def _sheet_xml(columns: list[str], rows: list[tuple]) -> str:
    def cell(r: int, c: int, v) -> str:
        if v is None:
            return ""
        ref = f"{letters(c)}{r}"
        if isinstance(v, bool):
            return f'<c r="{ref}" t="b"><v>{int(v)}</v></c>'
        if isinstance(v, (int, float)):
            return f'<c r="{ref}"><v>{v!r}</v></c>'
        text = escape(re.sub(r"[\x00-\x08\x0b\x0c\x0e-\x1f]", "", str(v)))
        return f'<c r="{ref}" t="inlineStr"><is><t xml:space="preserve">{text}</t></is></c>'

    body = "".join(f'<row r="{i}">' + "".join(cell(i, k, v) for k, v in enumerate(row, 1)) + "</row>" for i, row in enumerate([tuple(columns), *rows], 1))
    return f'<?xml version="1.0" encoding="UTF-8"?><worksheet xmlns="{_NS[1:-1]}"><sheetData>{body}</sheetData></worksheet>'


def write_workbook(sheets: dict[str, tuple[list[str], list[tuple]]]) -> bytes:
    """A workbook of named sheets (31 characters of each name), each a header and rows."""
    buffer = io.BytesIO()
    names = [n[:31] for n in sheets]
    rel = "http://schemas.openxmlformats.org/officeDocument/2006/relationships"
    with zipfile.ZipFile(buffer, "w", zipfile.ZIP_DEFLATED) as z:
        parts = "".join(f'<Override PartName="/xl/worksheets/sheet{i}.xml" ContentType="application/vnd.openxmlformats-officedocument.spreadsheetml.worksheet+xml"/>' for i in range(1, len(names) + 1))
        z.writestr("[Content_Types].xml", f'<?xml version="1.0" encoding="UTF-8"?><Types xmlns="http://schemas.openxmlformats.org/package/2006/content-types"><Default Extension="rels" ContentType="application/vnd.openxmlformats-package.relationships+xml"/><Override PartName="/xl/workbook.xml" ContentType="application/vnd.openxmlformats-officedocument.spreadsheetml.sheet.main+xml"/>{parts}</Types>')
        z.writestr("_rels/.rels", f'<?xml version="1.0" encoding="UTF-8"?><Relationships xmlns="http://schemas.openxmlformats.org/package/2006/relationships"><Relationship Id="rId1" Type="{rel}/officeDocument" Target="xl/workbook.xml"/></Relationships>')
        listing = "".join(f'<sheet name="{escape(n, {chr(34): "&quot;"})}" sheetId="{i}" r:id="rId{i}"/>' for i, n in enumerate(names, 1))
        z.writestr("xl/workbook.xml", f'<?xml version="1.0" encoding="UTF-8"?><workbook xmlns="{_NS[1:-1]}" xmlns:r="{rel}"><sheets>{listing}</sheets></workbook>')
        links = "".join(f'<Relationship Id="rId{i}" Type="{rel}/worksheet" Target="worksheets/sheet{i}.xml"/>' for i in range(1, len(names) + 1))
        z.writestr("xl/_rels/workbook.xml.rels", f'<?xml version="1.0" encoding="UTF-8"?><Relationships xmlns="http://schemas.openxmlformats.org/package/2006/relationships">{links}</Relationships>')
        for i, (columns, rows) in enumerate(sheets.values(), 1):
            z.writestr(f"xl/worksheets/sheet{i}.xml", _sheet_xml(columns, rows))
    return buffer.getvalue()


#: Rows that a sheet can hold.
SHEET_ROWS = 1_048_575


def _written(rows: Iterable) -> list[tuple]:
    """Rows of values that a sheet can hold."""
    return [tuple(v if isinstance(v, (bool, int, float, type(None))) else ", ".join(map(str, v)) if isinstance(v, list) else str(v) for v in r) for r in rows]


def to_excel(frames: dict[str, DataFrame]) -> bytes:
    """Small result frames as a workbook; a frame beyond a sheet's rows is refused."""
    sheets = {}
    for name, df in frames.items():
        rows = df.limit(SHEET_ROWS + 1).collect()
        if len(rows) > SHEET_ROWS:
            raise ValueError(f"{name} has more rows than a sheet holds; write it as CSV or Parquet")
        sheets[name] = (df.columns, _written(rows))
    return write_workbook(sheets)


# ---------------------------------------------------------------- tables of any size

#: Rows of each workbook of a table that is written as several.
PART_ROWS = 10_000


def write_workbooks(df: DataFrame, path: str, name: str) -> None:
    """A frame of any size, in its order, as workbooks of ``PART_ROWS`` rows at most: a Parquet table of part (ascending), n (its rows), content.

    Every workbook has the sheet ``name`` with the header; part -1 has nothing else.  Each is written by the task that has its rows.
    """
    columns = df.columns

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        part, rows = TaskContext.get().partitionId() << 32, []

        def book(own: list[tuple]) -> pa.RecordBatch:
            content = write_workbook({name: (columns, _written(own))})
            return pa.RecordBatch.from_pydict({"part": pa.array([part], pa.int64()), "n": pa.array([len(own)], pa.int64()), "content": pa.array([content], pa.binary())})

        for batch in batches:
            rows += zip(*(c.to_pylist() for c in batch.columns), strict=True)
            while len(rows) >= PART_ROWS:
                yield book(rows[:PART_ROWS])
                part, rows = part + 1, rows[PART_ROWS:]
        if rows:
            yield book(rows)

    kind = "part long, n long, content binary"
    first = df.sparkSession.createDataFrame([(-1, 0, bytearray(write_workbook({name: (columns, [])})))], kind)
    first.unionAll(df.mapInArrow(write, kind)).write.parquet(path)


def read_workbooks(spark: SparkSession, path: str, sheet: str | None = None) -> tuple[list[str | None], DataFrame]:
    """Header, and fila and c of all rows under it, of a table that ``write_workbooks`` left, numbered as in one sheet.

    Each workbook is read by one task; blank rows at the end of the last one are no rows.
    """
    books = spark.read.parquet(path)
    header = read_sheet(bytes(books.where("part = -1").first().content), sheet).grid[0]
    starts, at = {}, 2
    for r in books.where("n > 0").select("part", "n").orderBy("part").collect():  # a row for each workbook
        starts[r.part] = at
        at += r.n
    last, width = max(starts, default=-1), len(header)

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, n, content in zip(*batch.columns, strict=True):
                grid = read_sheet(content.as_py(), sheet).grid
                if (grid or [[]])[0] != header:
                    raise ValueError(f"workbook {part} has another header")
                rows = [[*r, *[None] * width][:width] for r in grid[1:]]
                rows += [[None] * width for _ in range(n.as_py() - len(rows) if part.as_py() != last else 0)]
                fila = range(starts[part.as_py()], starts[part.as_py()] + len(rows))
                yield pa.RecordBatch.from_pydict({"fila": pa.array(fila, pa.int64()), "c": pa.array(rows, pa.list_(pa.string()))})

    return header, books.where("n > 0").mapInArrow(read, "fila long, c array<string>")


# ---------------------------------------------------------------- data source


class XlsxDataSource(DataSource):
    """Sheets as rows: fila and c1, c2, ... of text.  Options: path, sheet, columns (as many as the sheet has, if not given; too few are an error)."""

    @classmethod
    def name(cls) -> str:
        return "tablewright_xlsx"

    def schema(self) -> str:
        width = int(self.options["columns"]) if "columns" in self.options else max(map(len, _opened(dict(self.options)).grid), default=0)
        return ", ".join(["fila long", *[f"c{i} string" for i in range(1, width + 1)]])

    def reader(self, schema: StructType) -> DataSourceReader:
        return _Reader(dict(self.options), len(schema) - 1)


def _opened(options: dict) -> Sheet:
    import pyarrow.fs as pafs

    fs, path = pafs.FileSystem.from_uri(options["path"]) if "://" in options["path"] else (pafs.LocalFileSystem(), options["path"])
    with fs.open_input_stream(path) as f:
        return read_sheet(f.read(), options.get("sheet"))


class _Reader(DataSourceReader):
    def __init__(self, options: dict, width: int) -> None:
        self.options, self.width = options, width

    def read(self, partition) -> Iterator[tuple]:
        for i, row in enumerate(_opened(self.options).grid, 1):
            if any(cell is not None for cell in row[self.width :]):
                raise ValueError(f"row {i} has {len(row)} cells, more than the {self.width} columns asked for")
            yield (i, *[*row, *[None] * self.width][: self.width])
