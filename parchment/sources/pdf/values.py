"""PDF values and their syntax: one forward scanner, without recursion, that also writes them back."""

from __future__ import annotations

import re
from typing import NamedTuple

NESTING = 512
#: Dictionaries that are remembered by their text: how many, characters of one, levels within it.
MEMO, MEMO_TEXT, MEMO_LEVELS = 4096, 1024, 3


class Name(str):
    __slots__ = ()


class Ref(NamedTuple):
    num: int
    gen: int


class Stream(dict):
    """A stream's dictionary, with its undecoded bytes, which are taken from the file when they are asked for."""

    def __init__(self, *args, **kw):
        super().__init__(*args, **kw)
        self._raw: bytes = b""
        self._load = None
        self.number: Ref | None = None
        self.size: int | None = None

    @property
    def raw(self) -> bytes:
        return self._raw if self._load is None else self._load()

    @raw.setter
    def raw(self, data: bytes) -> None:
        self._raw, self._load, self.size = data, None, len(data)

    def later(self, load, size: int | None = None) -> "Stream":
        """Take the bytes from load() each time; size is their number where it is known."""
        self._load, self.size = load, size
        return self

    def like(self, other: "Stream") -> "Stream":
        """Hold the other stream's bytes."""
        self._raw, self._load, self.number, self.size = other._raw, other._load, other.number, other.size
        return self


class SyntaxTrouble(ValueError):
    """Bytes that are no value."""


class Notes:
    """What reading values showed: escaped names and repeated keys; and dictionaries by their text, as they were read."""

    def __init__(self):
        self.escaped: dict[str, None] = {}
        self.repeated: dict[str, None] = {}
        self.read: dict[bytes, dict] = {}


_skip = re.compile(rb"(?:[\x00\t\n\x0c\r ]+|%[^\r\n]*)*")
_number = re.compile(rb"[+-]*(?:\d+\.?\d*|\.\d+)")
_ref = re.compile(rb"(\d{1,10})[\x00\t\n\x0c\r ]+(\d{1,5})[\x00\t\n\x0c\r ]*R(?![A-Za-z0-9])")
_name = re.compile(rb"/([^\x00\t\n\x0c\r ()<>\[\]{}/%]*)")
_word = re.compile(rb"[^\x00\t\n\x0c\r ()<>\[\]{}/%]+")
_hex_escape = re.compile(rb"#([0-9a-fA-F]{2})")
_close = {b"]": b"[", b">>": b"<<"}
# a dictionary of MEMO_LEVELS levels without strings and comments, so that its brackets alone tell where it ends
_short = re.compile(rb"<<(?:[^<>()%]++|<<(?:[^<>()%]++|<<[^<>()%]*+>>)*+>>)*+>>")
_octal = re.compile(rb"[0-7]{1,3}")
_plain = {ord("n"): 10, ord("r"): 13, ord("t"): 9, ord("b"): 8, ord("f"): 12}


def skip(data: bytes, at: int) -> int:
    return _skip.match(data, at).end()


def _literal(data: bytes, at: int) -> tuple[bytes, int]:
    out, depth, at = bytearray(), 1, at + 1
    while at < len(data):
        c = data[at]
        if c == 0x5C:
            at += 1
            if m := _octal.match(data, at):
                out.append(int(m[0], 8) & 255)
                at = m.end()
                continue
            c = data[at] if at < len(data) else 0x5C
            if c == 13:
                at += 2 if data[at + 1 : at + 2] == b"\n" else 1
            elif c == 10:
                at += 1
            else:
                out.append(_plain.get(c, c))
                at += 1
            continue
        depth += (c == 0x28) - (c == 0x29)
        at += 1
        if not depth:
            return bytes(out), at
        if c == 13:  # a bare end of line reads as LF
            at += data[at : at + 1] == b"\n"
            c = 10
        out.append(c)
    raise SyntaxTrouble("string without an end")


def _read_name(raw: bytes, notes: Notes | None) -> Name:
    def plain(m: re.Match) -> bytes:
        c = bytes([int(m[1], 16)])
        if notes is not None and c.isalnum():
            notes.escaped[raw.decode("latin-1")] = None
        return c

    return Name((_hex_escape.sub(plain, raw) if b"#" in raw else raw).decode("latin-1"))


def read_value(data: bytes, at: int = 0, notes: Notes | None = None, lift=None):
    """(value, position after it). Numbers are int or float, strings bytes, names Name, dictionaries dict.

    A stream inside another value, which has no place there, is handed to lift(dictionary, position of its keyword),
    which gives what stands for it and the position after it. With notes, a short dictionary whose text was read before
    is the same object again; values that were read are not changed.
    """
    stack: list[tuple[bytes, list]] = []
    pending: list[tuple[int, int]] = []  # where short dictionaries that are being read begin and end
    while True:
        at = skip(data, at)
        c = data[at : at + 1]
        if not c:
            raise SyntaxTrouble("end of data")
        if c == b"<" and data[at + 1 : at + 2] == b"<":
            if notes is not None and stack and len(stack) <= NESTING - MEMO_LEVELS and (m := _short.match(data, at)) and m.end() - at <= MEMO_TEXT:
                if (value := notes.read.get(m[0])) is not None:
                    above, text = stack[-1][1], m[0]
                    above.append(value)
                    at = m.end()
                    while data.startswith(text, at + 1) and data[at] in b" \n":  # the same again
                        above.append(value)
                        at += 1 + len(text)
                    continue
                if len(notes.read) < MEMO:
                    pending.append((at, m.end()))
            stack.append((b"<<", []))
            at += 2
        elif c == b"[":
            stack.append((b"[", []))
            at += 1
        elif c == b"]" or data[at : at + 2] == b">>":
            mark = c if c == b"]" else b">>"
            at += len(mark)
            if not stack or stack[-1][0] != _close[mark]:
                raise SyntaxTrouble("a closing bracket without its opening")
            kind, items = stack.pop()
            value = items if kind == b"[" else _dictionary(items, notes)
            if pending and at >= pending[-1][1]:
                start, end = pending.pop()
                if at == end:
                    notes.read[data[start:end]] = value
            if not stack:
                return value, at
            stack[-1][1].append(value)
            continue
        else:
            if c == b"(":
                value, at = _literal(data, at)
            elif c == b"<":
                end = data.find(b">", at)
                if end < 0:
                    raise SyntaxTrouble("string without an end")
                digits = re.sub(rb"[^0-9a-fA-F]", b"", data[at + 1 : end])
                value, at = bytes.fromhex((digits + b"0" * (len(digits) % 2)).decode()), end + 1
            elif c == b"/":
                m = _name.match(data, at)
                value, at = _read_name(m[1], notes), m.end()
            elif m := _ref.match(data, at):
                value, at = Ref(int(m[1]), int(m[2])), m.end()
            elif m := _number.match(data, at):
                text = m[0].lstrip(b"+-")
                value = float(text) if b"." in text else int(text)
                value, at = -value if m[0][:1] == b"-" else value, m.end()
                if stray := _word.match(data, at):
                    if data[at : at + 1] in b".+-":
                        at = stray.end()
            elif m := _word.match(data, at):
                if m[0] not in (b"true", b"false", b"null"):
                    if lift is not None and m[0] == b"stream" and stack and stack[-1][1] and type(stack[-1][1][-1]) is dict:
                        pending.clear()  # what stands for a stream has its place
                        stack[-1][1][-1], at = lift(stack[-1][1][-1], at)
                        continue
                    if stack and m[0] not in (b"obj", b"endobj", b"stream", b"endstream", b"xref", b"trailer", b"startxref"):
                        at = m.end()  # a stray word in a container is passed over
                        continue
                    raise SyntaxTrouble(f"unexpected {m[0][:20]!r}")
                value, at = {b"true": True, b"false": False, b"null": None}[m[0]], m.end()
            else:
                raise SyntaxTrouble(f"unexpected {c!r}")
            if not stack:
                return value, at
            stack[-1][1].append(value)
        if len(stack) > NESTING:
            raise SyntaxTrouble("nested too deep")


def _dictionary(items: list, notes: Notes | None) -> dict:
    out: dict = {}
    at = 0
    while at < len(items):
        key = items[at]
        if not isinstance(key, Name):
            at += 1
            continue
        value = items[at + 1] if at + 1 < len(items) else None
        if key in out and notes is not None:
            notes.repeated[key] = None
        out[key] = value
        at += 2
    return out


_regular = re.compile(r"[^!-~]|[#()<>\[\]{}/%]")


def write_value(value) -> bytes:
    """The value as one revision would hold it; streams are written by the caller."""
    out: list[bytes] = []
    todo: list = [value]
    while todo:
        v = todo.pop()
        if isinstance(v, _Raw):
            out.append(v.data)
        elif v is None:
            out.append(b"null")
        elif v is True or v is False:
            out.append(b"true" if v else b"false")
        elif isinstance(v, Ref):
            out.append(b"%d %d R" % v)
        elif isinstance(v, Name):
            out.append(b"/" + _regular.sub(lambda m: "#%02X" % (ord(m[0]) & 255), v).encode("latin-1", "replace"))
        elif isinstance(v, bytes):
            out.append(b"<" + v.hex().encode() + b">" if len(v) <= 256 else _written(v))
        elif isinstance(v, int):
            out.append(b"%d" % v)
        elif isinstance(v, float):
            out.append((f"{v:.6f}".rstrip("0").rstrip(".") or "0").encode())
        elif isinstance(v, list):
            todo.append(_Raw(b"]"))
            for x in reversed(v):
                todo += [_Raw(b" "), x]
            todo.append(_Raw(b"["))
        elif isinstance(v, dict):
            todo.append(_Raw(b">>"))
            for k, x in reversed(v.items()):
                todo += [_Raw(b" "), x, _Raw(b" "), Name(k)]
            todo.append(_Raw(b"<<"))
        else:
            raise TypeError(type(v))
    return b"".join(out)


_special = re.compile(rb"[\\()\r]|obj")


def _written(data: bytes) -> bytes:
    """A long string as a literal; no scan for objects shall find one in it."""
    return b"(" + _special.sub(lambda m: {b"\r": b"\\r", b"obj": b"\\157bj"}.get(m[0], b"\\" + m[0]), data) + b")"


class _Raw:
    def __init__(self, data: bytes):
        self.data = data


def encode_text(text: str) -> bytes:
    """The bytes of a text string: byte for byte where that is enough, else UTF-16 behind its mark."""
    if all(c in "\t\n\r" or " " <= c <= "~" or "\xa1" <= c <= "\xff" for c in text):
        return text.encode("latin-1")
    return b"\xfe\xff" + text.encode("utf-16-be", "surrogatepass")


def text_of(value) -> str | None:
    """A text string's characters: by its byte order mark, else byte for byte; None for other values."""
    if not isinstance(value, bytes):
        return None
    for mark, name in ((b"\xfe\xff", "utf-16-be"), (b"\xff\xfe", "utf-16-le"), (b"\xef\xbb\xbf", "utf-8")):
        if value.startswith(mark):
            return value[len(mark) :].decode(name, "replace")
    return value.decode("latin-1")
