"""Old workbooks (.xls, BIFF8 in a compound file) by the standard library: values of cells only.

What is merged, hidden or filtered in them is not looked at.  Locked and older files are refused.
"""

from __future__ import annotations

import re
import struct
from collections.abc import Iterator
from datetime import datetime, timedelta

from tablewright.sources.errors import MissingSheet, OldBook
from tablewright.sources.xlsx import DATE_FORMATS, Sheet

# The container's mark, numbers of its sectors that mean none, and of the records that are read.
MARK, END_OF_CHAIN = bytes.fromhex("D0CF11E0A1B11AE1"), 0xFFFFFFFA
BOF, EOF, BOUNDSHEET, SST, CONTINUE, FORMAT, XF, DATEMODE, FILEPASS = 0x809, 0x0A, 0x85, 0xFC, 0x3C, 0x41E, 0xE0, 0x22, 0x2F
LABELSST, LABEL, NUMBER, RK, MULRK, BOOLERR, FORMULA, STRING = 0xFD, 0x204, 0x203, 0x27E, 0xBD, 0x205, 0x06, 0x207
EPOCHS = {0: datetime(1899, 12, 30), 1: datetime(1904, 1, 1)}


# ---------------------------------------------------------------- container


def workbook_stream(raw: bytes) -> bytes:
    """The workbook's stream in a compound file."""
    if raw[:8] != MARK:
        raise OldBook("no es un libro de Excel 97-2003")
    sector, mini = 1 << struct.unpack_from("<H", raw, 30)[0], 1 << struct.unpack_from("<H", raw, 32)[0]
    cut, mini_at, difat_at = (struct.unpack_from("<I", raw, k)[0] for k in (56, 60, 68))
    body = lambda k: raw[(k + 1) * sector : (k + 2) * sector]
    numbers = lambda data: struct.unpack(f"<{len(data) // 4}I", data)
    tables = list(struct.unpack_from("<109I", raw, 76))
    while difat_at < END_OF_CHAIN:  # the list of tables goes on in sectors of its own
        *more, difat_at = numbers(body(difat_at))
        tables += more
    after = [x for t in tables if t < END_OF_CHAIN for x in numbers(body(t))]

    def chain(at: int, links: list[int]) -> Iterator[int]:
        for _ in range(len(links) + 1):  # a chain that runs in a ring ends too
            if at >= END_OF_CHAIN or at >= len(links):
                return
            yield at
            at = links[at]

    read = lambda at: b"".join(map(body, chain(at, after)))
    folder = read(struct.unpack_from("<I", raw, 48)[0])
    entries = {}
    for k in range(0, len(folder) - 127, 128):
        size = struct.unpack_from("<H", folder, k + 64)[0]
        name = folder[k : k + max(size - 2, 0)].decode("utf-16-le", "replace")
        entries.setdefault("/" if folder[k + 66] == 5 else name, struct.unpack_from("<II", folder, k + 116))
    if "Workbook" not in entries:
        raise OldBook("no contiene un libro de Excel 97-2003")
    at, size = entries["Workbook"]
    if size >= cut:
        return read(at)[:size]
    small, links = read(entries["/"][0]), list(numbers(read(mini_at)))
    return b"".join(small[k * mini : (k + 1) * mini] for k in chain(at, links))[:size]


def records(data: bytes, at: int = 0) -> Iterator[tuple[int, bytes, list[bytes]]]:
    """Kind, data and continuations of each record from a place on."""
    held: tuple[int, bytes, list[bytes]] | None = None
    while at + 4 <= len(data):
        kind, size = struct.unpack_from("<HH", data, at)
        own, at = data[at + 4 : at + 4 + size], at + 4 + size
        if kind == CONTINUE and held:
            held[2].append(own)
            continue
        if held:
            yield held
        held = (kind, own, [])
    if held:
        yield held


# ---------------------------------------------------------------- texts


class _Pieces:
    """Bytes of a record and its continuations, one after another."""

    def __init__(self, pieces: list[bytes]) -> None:
        self.pieces, self.k, self.at = pieces, 0, 0

    def take(self, n: int) -> bytes:
        out = b""
        while n > 0 and self.k < len(self.pieces):
            got = self.pieces[self.k][self.at : self.at + n]
            out, n, self.at = out + got, n - len(got), self.at + len(got)
            if n > 0:
                self.k, self.at = self.k + 1, 0
        return out

    def text(self, length: int) -> str:
        """Characters, whose width each continuation states anew, and what is said of their looks, which is skipped."""
        flags = self.take(1)[0]
        runs = struct.unpack("<H", self.take(2))[0] if flags & 8 else 0
        extra = struct.unpack("<I", self.take(4))[0] if flags & 4 else 0
        out, wide = "", flags & 1
        while length > 0:
            if self.at >= len(self.pieces[self.k]):
                if self.k + 1 >= len(self.pieces):
                    break
                self.k, self.at = self.k + 1, 1
                wide = self.pieces[self.k][0] & 1
            n = min(length, (len(self.pieces[self.k]) - self.at) >> wide)
            if not n:
                break
            out += self.take(n << wide).decode("utf-16-le" if wide else "latin-1", "replace")
            length -= n
        self.take(4 * runs + extra)
        return out


def _shared(own: bytes, more: list[bytes]) -> list[str]:
    pieces = _Pieces([own, *more])
    _, n = struct.unpack("<II", pieces.take(8))
    return [pieces.text(struct.unpack("<H", pieces.take(2))[0]) for _ in range(n)]


# ---------------------------------------------------------------- workbook


class Book:
    """Sheets (name, visible, place), shared texts and the formats that show dates."""

    def __init__(self, raw: bytes) -> None:
        self.data = workbook_stream(raw)
        self.sheets: list[tuple[str, bool, int]] = []
        self.texts: list[str] = []
        self.epoch, formats, styles = EPOCHS[0], {}, []
        for kind, own, more in records(self.data):
            if kind == BOF and struct.unpack_from("<H", own)[0] != 0x600:
                raise OldBook("es anterior a Excel 97")
            if kind == FILEPASS:
                raise OldBook("tiene contraseña")
            if kind == BOUNDSHEET and own[5] == 0:  # charts and macros are no sheets
                self.sheets.append((_Pieces([own[7:]]).text(own[6]), own[4] & 3 == 0, struct.unpack_from("<I", own)[0]))
            elif kind == SST:
                self.texts = _shared(own, more)
            elif kind == FORMAT:
                formats[struct.unpack_from("<H", own)[0]] = _Pieces([own[4:]]).text(struct.unpack_from("<H", own, 2)[0])
            elif kind == XF:
                styles.append(struct.unpack_from("<H", own, 2)[0])
            elif kind == DATEMODE:
                self.epoch = EPOCHS[own[0] & 1]
            elif kind == EOF:
                break
        shown = {k for k, code in formats.items() if re.search(r"[ymdhs]", re.sub(r'"[^"]*"|\[[^\]]*\]|\\.', "", code), re.I)}
        dated = shown | (DATE_FORMATS - formats.keys())
        self.dated = {i for i, f in enumerate(styles) if f in dated}

    def number(self, value: float, style: int) -> str:
        """A number as text: whole ones without a point, dated ones as moments."""
        if style in self.dated:
            at = self.epoch + timedelta(seconds=round(value * 86400))
            return at.strftime("%H:%M:%S" if 0 <= value < 1 else "%Y-%m-%d %H:%M:%S")
        return str(int(value)) if value.is_integer() and abs(value) < 1e15 else repr(value)

    def cells(self, at: int) -> Iterator[tuple[int, int, str]]:
        """Row, column (from 0) and text of the cells of a sheet."""
        asked: tuple[int, int] | None = None  # a formula whose text follows
        for kind, own, more in records(self.data, at):
            if kind == EOF:
                return
            if kind == STRING and asked:
                pieces = _Pieces([own, *more])
                yield *asked, pieces.text(struct.unpack("<H", pieces.take(2))[0])
                asked = None
            if kind not in (LABELSST, LABEL, NUMBER, RK, MULRK, BOOLERR, FORMULA):
                continue
            row, col, style = struct.unpack_from("<HHH", own)
            if kind == LABELSST:
                yield row, col, self.texts[struct.unpack_from("<I", own, 6)[0]]
            elif kind == LABEL:
                pieces = _Pieces([own[6:], *more])
                yield row, col, pieces.text(struct.unpack("<H", pieces.take(2))[0])
            elif kind == NUMBER:
                yield row, col, self.number(struct.unpack_from("<d", own, 6)[0], style)
            elif kind == RK:
                yield row, col, self.number(packed(struct.unpack_from("<I", own, 6)[0]), style)
            elif kind == MULRK:
                for k in range((len(own) - 6) // 6):
                    style, value = struct.unpack_from("<HI", own, 4 + 6 * k)
                    yield row, col + k, self.number(packed(value), style)
            elif kind == BOOLERR and not own[7]:
                yield row, col, str(bool(own[6]))
            elif kind == FORMULA:
                if own[12:14] != b"\xff\xff":
                    yield row, col, self.number(struct.unpack_from("<d", own, 6)[0], style)
                elif own[6] == 0:
                    asked = row, col
                elif own[6] == 1:
                    yield row, col, str(bool(own[8]))


def packed(value: int) -> float:
    """A number in 30 bits: a whole one or the upper bits of a float, maybe in hundredths."""
    number = float(struct.unpack("<i", struct.pack("<I", value))[0] >> 2) if value & 2 else struct.unpack("<d", struct.pack("<Q", (value & 0xFFFFFFFC) << 32))[0]
    return number / 100 if value & 1 else number


def read_sheet(raw: bytes, name: str | None = None) -> Sheet:
    """A sheet by name, or the first."""
    book = Book(raw)
    found = next((s for s in book.sheets if name is None or s[0] == name), None)
    if found is None:
        raise MissingSheet(name)
    sheet = Sheet(found[0])
    for row, col, text in book.cells(found[2]):
        while len(sheet.grid) <= row:
            sheet.grid.append([])
        line = sheet.grid[row]
        line.extend([None] * (col + 1 - len(line)))
        line[col] = text if text.strip() else None
    return sheet


def catalogue(raw: bytes) -> list[dict]:
    """Name and visibility of each sheet."""
    return [{"nombre": name, "visible": visible, "filas": None, "columnas": None} for name, visible, _ in Book(raw).sheets]
