"""Checks of attached data files: delimited text, JSON and plain text. Each file is one row's bytes."""

from __future__ import annotations

import re

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

_number = re.compile(rb"[+-](?:\d+\.?\d*|\.\d+)(?:[eE][+-]?\d+)?")
_control = re.compile("[\x00-\x08\x0b\x0c\x0e-\x1f]")
_control_more = re.compile("[\x00-\x08\x0b\x0c\x0e-\x1f\x7f-\x9f]")
LONGEST_NUMBER = 64


def is_text(data: bytes | None, strict: bool = False) -> bool:
    """UTF-8 without control characters but tab, LF and CR; strict also refuses DEL and C1."""
    try:
        text = (data or b"").decode("utf-8")
    except UnicodeDecodeError:
        return False
    return not (_control_more if strict else _control).search(text)


def _cells(delimiter: bytes) -> re.Pattern[bytes]:
    stop = re.escape(delimiter) + rb"\r\n"
    # a quoted cell with what follows its end, a quoted cell that never ends, or a bare cell
    return re.compile(rb'"((?:[^"]|"")*)"([^' + stop + rb']*)(?=[' + stop + rb']|\Z)|(")|([^' + stop + rb']+)')


_patterns = {d: _cells(d) for d in (b",", b"\t", b";")}


def _runs(cell: bytes, quoted: bool) -> bool:
    """Whether a spreadsheet would run the cell: quoted cells come as written, with doubled quotes."""
    if cell[:1] in (b"+", b"-"):
        return len(cell) > 1 and not (len(cell) <= LONGEST_NUMBER and _number.fullmatch(cell))
    return cell[:1] in ((b"=", b"@", b"\t", b"\r") if quoted else (b"=", b"@", b"\t"))


def scan_delimited(data: bytes | None, delimiter: bytes = b",") -> tuple[int, bytes | None]:
    """(cells a spreadsheet would run, the file with an apostrophe before each), or (-1, None) if it is no such text."""
    if data is None or not is_text(data, strict=True):
        return -1, None
    out, at, found, broken = [], 0, 0, False
    pattern = _patterns.get(delimiter) or _patterns.setdefault(delimiter, _cells(delimiter))
    start = 3 if data.startswith(b"\xef\xbb\xbf") else 0
    for m in pattern.finditer(data, start):
        if m[3]:
            broken = True
            break
        quoted = m[1] is not None
        cell = m[1] if quoted else m[4]
        if cell and not (quoted and cell[:1] == b'"') and _runs(cell, quoted):
            where = m.start(1 if quoted else 4)
            out += [data[at:where], b"'"]
            at, found = where, found + 1
    return (-1, None) if broken else (found, b"".join([*out, data[at:]]))


_space = re.compile(r"[ \t\n\r]*")
_scalar = re.compile(r'"(?:[^"\\\x00-\x1f]|\\(?:["\\/bfnrt]|u[0-9a-fA-F]{4}))*"|-?(?:0|[1-9]\d*)(?:\.\d+)?(?:[eE][+-]?\d+)?|true|false|null', re.ASCII)


def is_json(data: bytes | None) -> bool:
    """Whether the bytes are exactly one JSON value; a byte order mark may stand before it, keys may repeat."""
    try:
        text = (data or b"").decode("utf-8-sig")
    except UnicodeDecodeError:
        return False
    at, depth, want = 0, [], "value"
    while True:
        at = _space.match(text, at).end()
        if want == "end":
            return at == len(text)
        if at >= len(text):
            return False
        c = text[at]
        if want in ("value", "first"):
            if c in "{[":
                depth.append(c)
                at, want = at + 1, "first_key" if c == "{" else "first"
            elif c == "]" and want == "first":
                depth.pop()
                at, want = at + 1, "more" if depth else "end"
            elif m := _scalar.match(text, at):
                at, want = m.end(), "more" if depth else "end"
            else:
                return False
        elif want in ("first_key", "key"):
            if c == "}" and want == "first_key":
                depth.pop()
                at, want = at + 1, "more" if depth else "end"
                continue
            m = _scalar.match(text, at) if c == '"' else None
            if not m:
                return False
            at = _space.match(text, m.end()).end()
            if text[at : at + 1] != ":":
                return False
            at, want = at + 1, "value"
        elif c == ",":
            at, want = at + 1, "key" if depth[-1] == "{" else "value"
        elif c == ("}" if depth[-1] == "{" else "]"):
            depth.pop()
            at, want = at + 1, "more" if depth else "end"
        else:
            return False


def json_valid(content: Column) -> Column:
    @F.pandas_udf("boolean")
    def valid(data: pd.Series) -> pd.Series:
        return data.map(is_json)

    return valid(content.cast("binary"))


def delimited(content: Column, delimiter: str = ",") -> Column:
    """struct(found, output): cells that a spreadsheet would run, and the file with them escaped."""
    mark = delimiter.encode()

    @F.pandas_udf("found int, output binary")
    def scanned(data: pd.Series) -> pd.DataFrame:
        return pd.DataFrame([scan_delimited(x, mark) for x in data], columns=["found", "output"])

    return scanned(content.cast("binary"))


def text_valid(content: Column, strict: bool = False) -> Column:
    """is_text in the JVM."""
    text = content.cast("binary").cast("string")
    wrong = "[\\x00-\\x08\\x0B\\x0C\\x0E-\\x1F" + ("\\x7F-\\x9F]" if strict else "]")
    return F.coalesce(F.is_valid_utf8(text) & ~text.rlike(wrong), F.lit(False))
