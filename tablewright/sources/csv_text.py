"""CSV of unknown character set and separator, read alike at every size.

A file's lines are split at line feeds.  A quoted value may hold line breaks, so whether a line begins inside one depends on
all lines before it.  For a distributed file each split first tells where it would end for both ways to begin (a few
numbers a split); composed in order, these give every split its true beginning and its first line's number.  Records
are then parsed where they begin; those that cross into another split meet by their first line's number.

A folder is one file in parts, which follow each other by their names (numbers in them by value); each part ends a line, values
in quotes may go on in the next one.

Defined results: empty lines are no records; a record with fewer values than the header ends in nulls, one with more is an
error that names its line, as is a quote that is never closed; empty values are null.
"""

from __future__ import annotations

import csv
import re
from collections import Counter
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tablewright.sources.errors import OpenQuote, RaggedLine
from tablewright.sources.files import natural

# Signs that may part values, the best first, and bytes that Windows-1252 doesn't have.
SEPARATORS = ";,\t|"
NOT_IN_1252 = bytes([0x81, 0x8D, 0x8F, 0x90, 0x9D])
MARK = "﻿"
#: Lines that the separator is judged by.
JUDGED = 50

csv.field_size_limit(1 << 30)  # values may be whole texts


def charset(raw: bytes) -> str:
    """UTF-8 if the bytes are valid as such, else Windows-1252, or Latin-1 for bytes that the former doesn't have."""
    try:
        raw.decode("utf-8")
    except UnicodeDecodeError:
        return "latin-1" if any(b in raw for b in NOT_IN_1252) else "cp1252"
    return "utf-8-sig"


def line_break(text: str | bytes) -> str:
    """The sign that ends lines: a line feed (a carriage return before it is cut off) unless only carriage returns occur."""
    feed, turn = ("\n", "\r") if isinstance(text, str) else (b"\n", b"\r")
    return "\r" if turn in text and feed not in text else "\n"


def separator(text: str) -> str:
    """The sign for which most of the first records agree in their number of values, of several the one that gives most values."""
    lines = [x for x in text.split(line_break(text))[: 4 * JUDGED] if x.strip()][:JUDGED]

    def merit(sign: str) -> tuple[float, int]:
        sizes = Counter(len(next(csv.reader([joined], delimiter=sign, skipinitialspace=True), [])) for _, joined in records(iter(enumerate(lines, 1)), sign, strict=False))
        size, often = max(sizes.items(), key=lambda x: (x[0] > 1, x[1], x[0]), default=(1, 0))
        return (often / sizes.total(), size) if size > 1 else (0.0, 1)

    found = max(SEPARATORS, key=merit) if lines else ","
    return found if lines and merit(found)[1] > 1 else ","


def left_open(line: str, sep: str, inside: bool) -> bool:
    """Whether a quoted value is open at the line's end; inside: whether one was at its beginning."""
    if '"' not in line:
        return inside
    at = 0
    while True:
        if not inside:
            while line.startswith(" ", at):
                at += 1
            if line.startswith('"', at):
                inside, at = True, at + 1
            elif (at := line.find(sep, at) + 1) == 0:
                return False
            continue
        at = line.find('"', at) + 1
        if not at:
            return True
        if line.startswith('"', at):
            at += 1
        elif (at := line.find(sep, at) + 1) == 0:
            return False
        else:
            inside = False


def records(lines: Iterator[tuple[int, str]], sep: str, *, strict: bool = True) -> Iterator[tuple[int, str]]:
    """First line's number and text of each record that isn't empty, from numbered lines."""
    first, held = 0, []
    for number, line in lines:
        if not held:
            first = number
            if not line:
                continue
        held.append(line)
        if not left_open(line, sep, len(held) > 1):
            yield first, "\n".join(held)
            held = []
    if held:
        if strict:
            raise OpenQuote(first)
        yield first, "\n".join(held)


def values(record: str, sep: str) -> list[str]:
    """The values of a record; a carriage return outside quotes counts as a blank."""
    try:
        return next(csv.reader([record], delimiter=sep, skipinitialspace=True), [])
    except csv.Error:
        return next(csv.reader([record.replace("\r", " ")], delimiter=sep, skipinitialspace=True), [])


def fitted(first: int, found: list[str], width: int) -> list[str | None]:
    """A record's values as a row of the table."""
    if len(found) > width:
        raise RaggedLine(first, len(found), width)
    return [*[v or None for v in found], *[None] * (width - len(found))]


def numbered(text: str) -> Iterator[tuple[int, str]]:
    """Lines of a whole text with their numbers from 1."""
    for number, line in enumerate(text.removeprefix(MARK).split(line_break(text)), 1):
        yield number, line.removesuffix("\r")


def header(lines: Iterable[tuple[int, str]], sep: str, header_row: int) -> tuple[int, list[str]] | None:
    """The first record that begins at the header's line or after it, and where it begins."""
    for first, record in records(iter(lines), sep, strict=False):
        if first >= header_row:
            return first, values(record, sep)
    return None


# ---------------------------------------------------------------- distributed


def text_lines(spark: SparkSession, path: str, end: str) -> DataFrame:
    """The lines of a file or of a folder's parts as bytes, and where each split of them begins (file, start)."""
    whole = spark.read.option("lineSep", end).text(path)
    return whole.select(F.col("value").cast("binary").alias("line"), F.col("_metadata.file_name").alias("file"), F.col("_metadata.file_block_start").alias("start"))


def line_break_of(spark: SparkSession, path: str, prefix: bytes) -> str:
    """``line_break`` of the whole file: only where its beginning has nothing but carriage returns is the rest looked at."""
    found = line_break(prefix)
    return "\n" if found == "\r" and spark.read.option("lineSep", "\r").text(path).where(F.contains("value", F.lit("\n"))).head(1) else found


def header_of(lines: DataFrame, name: str, sep: str, header_row: int) -> tuple[int, list[str]] | None:
    """``header`` by line number, wherever in the file that line is."""
    found = parsed(lines, name, sep, header_row - 1, None).orderBy("fila").head(1)
    return (found[0].fila, [v or "" for v in found[0].c]) if found else None


def charset_of(lines: DataFrame) -> str:
    """``charset`` of all lines: one scan."""
    found = lines.agg(F.bool_and(F.is_valid_utf8(F.col("line").cast("string"))).alias("fine"), F.bool_or(_has_odd()).alias("odd")).first()
    return "utf-8-sig" if found.fine is not False else "latin-1" if found.odd else "cp1252"


def _has_odd() -> F.Column:
    """Whether a line has a byte that Windows-1252 doesn't have (as Latin-1 text, so each byte is a sign)."""
    return F.decode("line", "ISO-8859-1").rlike("[" + "".join(f"\\x{{{b:02X}}}" for b in NOT_IN_1252) + "]")


def _decoder(name: str) -> Callable[[bytes], str]:
    return lambda raw: raw.decode("utf-8" if name == "utf-8-sig" else name, "replace").removesuffix("\r")


def _split_key() -> Column:
    return F.xxhash64("file", "start").alias("split")


def _place() -> Column:
    """A number that grows by one from line to line of a split."""
    return F.monotonically_increasing_id().alias("at")


def _runs(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, list[bytes]]]:
    """Lines of one split each (line, split): a task may read several splits, one after another."""
    for batch in batches:
        splits = batch.column(1).to_numpy()
        cuts = [0, *(np.flatnonzero(splits[1:] != splits[:-1]) + 1).tolist(), len(splits)]
        for at, to in zip(cuts[:-1], cuts[1:], strict=True):
            if to > at:
                yield int(splits[at]), batch.column(0).slice(at, to - at).to_pylist()


def _begins(lines: DataFrame, order: list[int], name: str, sep: str) -> tuple[dict[int, tuple[int, int]], int]:
    """For each split, in order, the number of its first line and the first line of the record that is open there (0: none); the line at which the file ends open (0: none)."""

    def look(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        decode, split, n, open_, since = _decoder(name), None, 0, [False, True], [0, 0]

        def told() -> pa.RecordBatch:
            return pa.RecordBatch.from_pydict({"split": pa.array([split], pa.int64()), "n": pa.array([n], pa.int64()), **{f"open{k}": pa.array([open_[k]]) for k in (0, 1)}, **{f"since{k}": pa.array([since[k]], pa.int64()) for k in (0, 1)}})

        for own, raws in _runs(batches):
            if own != split:
                if split is not None:
                    yield told()
                split, n, open_, since = own, 0, [False, True], [0, 0]
            for raw in raws:
                n += 1
                if b'"' not in raw:
                    continue
                line = decode(raw)
                for k in (0, 1):  # as if no value were open at the beginning, and as if one were
                    now = left_open(line, sep, open_[k])
                    since[k] = (since[k] if open_[k] else n) if now else 0
                    open_[k] = now
        if split is not None:
            yield told()

    found = {r.split: r for r in lines.select("line", _split_key()).mapInArrow(look, "split long, n long, open0 boolean, open1 boolean, since0 long, since1 long").collect()}  # a row for each split
    begins, line, since = {}, 1, 0
    for r in (found[split] for split in order):
        begins[r.split] = (line, since)
        own = r[f"since{int(since > 0)}"]  # 0 while open: open since before this split
        since = 0 if not r[f"open{int(since > 0)}"] else line + own - 1 if own else since
        line += r.n
    return begins, since


def _text(line: Column, name: str) -> Column:
    """A line's text."""
    if name == "utf-8-sig":
        return line.cast("string")
    text = F.decode(line, "ISO-8859-1")
    if name == "latin-1":
        return text
    own = bytes(b for b in range(0x80, 0xA0) if b not in NOT_IN_1252)  # where Windows-1252 has other signs
    return F.translate(text, own.decode("latin-1"), own.decode("cp1252"))


def _unquoted(lines: DataFrame, splits: list[tuple[int, int, int]], name: str, sep: str, header_at: int, width: int | None) -> DataFrame:
    """``parsed`` of a file without a quote: each line is a record, and no text leaves the JVM.  Splits, in order: key, place of the first line, lines."""
    shifts, before = [], 0
    for split, first, n in splits:
        shifts.append((split, before + 1 - first))
        before += n
    shifts = F.broadcast(lines.sparkSession.createDataFrame(shifts, "split long, shift long"))  # a row for each split
    rows = lines.select(_place(), _split_key(), F.regexp_replace(_text(F.col("line"), name), r"\r\z", "").alias("text")).join(shifts, "split", "left")
    rows = rows.select((F.col("at") + F.col("shift")).alias("fila"), "text")
    rows = rows.withColumn("text", F.when(F.col("fila") == 1, F.regexp_replace("text", "^" + MARK, "")).otherwise(F.col("text"))).where((F.col("text") != "") & (F.col("fila") > header_at))
    cells = F.transform(F.split(F.translate("text", "\r", " "), re.escape(sep)), lambda v: F.nullif(F.ltrim(v), F.lit("")))
    rows = rows.select("fila", cells.alias("c"))
    padded = F.col("c") if width is None else F.slice(F.concat("c", F.array_repeat(F.lit(None).cast("string"), width)), 1, width)
    return rows.select("fila", F.size("c").alias("seen"), padded.alias("c"))


def parsed(lines: DataFrame, name: str, sep: str, header_at: int, width: int | None) -> DataFrame:
    """fila (the record's first line), seen (its number of values) and c (as many as the header has; None: all) of all records after a line.

    Only a file with a quote anywhere goes through Python.
    """
    each = lines.select("file", "start", _split_key(), _place(), F.contains("line", F.lit(bytearray(b'"'))).alias("quoted"))
    seen = each.groupBy("file", "start", "split").agg(F.min("at").alias("first"), F.count("*").alias("n"), F.bool_or("quoted").alias("quoted")).collect()  # a row for each split
    seen.sort(key=lambda r: (natural(r.file), r.start))
    if not any(r.quoted for r in seen):
        return _unquoted(lines, [(r.split, r.first, r.n) for r in seen], name, sep, header_at, width)
    begins, unclosed = _begins(lines, [r.split for r in seen], name, sep)
    if unclosed:
        raise OpenQuote(unclosed)
    row = "fila long, seen int, c array<string>"

    def out(found: list[tuple[int, str]]) -> pa.RecordBatch:
        split = [(first, values(record, sep)) for first, record in found if first > header_at]
        return pa.RecordBatch.from_pydict({"fila": pa.array([f for f, _ in split], pa.int64()), "seen": pa.array([len(v) for _, v in split], pa.int32()), "c": pa.array([fitted(f, v[:width], len(v) if width is None else width) for f, v in split], pa.list_(pa.string()))})

    def own(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[str, list]]:
        """Whole records of each split, and the lines of those that cross its ends."""
        decode, split, held, whole, parts = _decoder(name), None, [], [], []
        number = since = 0
        open_ = False
        for its, raws in _runs(batches):
            if its != split:
                yield "part", [(held[0][0], n, line) for n, line in held]
                split, held = its, []
                number, since = begins[split]
                open_ = since > 0
            for raw in raws:
                line = decode(raw)
                if number == 1:
                    line = line.removeprefix(MARK)
                open_ = left_open(line, sep, open_)
                if since and not held:  # belongs to a record that began in another split
                    parts.append((since, number, line))
                    since = since if open_ else 0
                elif held or line:
                    held.append((number, line))
                    if not open_:
                        whole.append((held[0][0], "\n".join(x for _, x in held)))
                        held = []
                number += 1
            yield "whole", whole
            yield "part", parts
            whole, parts = [], []
        yield "part", [(held[0][0], n, line) for n, line in held]

    def inside(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from (out(found) for kind, found in own(batches) if kind == "whole")

    def across(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for kind, found in own(batches):
            if kind == "part" and found:
                yield pa.RecordBatch.from_pydict({k: pa.array(v) for k, v in zip(("first", "number", "line"), zip(*found, strict=True), strict=True)})

    lines = lines.select("line", _split_key())
    rows = lines.mapInArrow(inside, row)
    if not any(since for _, since in begins.values()):
        return rows

    def join(group: pa.Table) -> pa.Table:
        lines_ = group.sort_by("number").column("line").to_pylist()
        return pa.Table.from_batches([out([(group.column("first")[0].as_py(), "\n".join(lines_))])])

    crossing = lines.mapInArrow(across, "first long, number long, line string").groupBy("first").applyInArrow(join, row)
    return rows.unionByName(crossing)
