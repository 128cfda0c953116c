"""A PDF file as a table of objects: cross-reference chains, object streams, and a scan where they fail."""

from __future__ import annotations

import re
import time
from bisect import bisect_left, bisect_right
from collections import OrderedDict

from parchment.sources.pdf import filters
from parchment.sources.pdf.crypto import Security
from parchment.sources.pdf.values import Name, Notes, Ref, Stream, SyntaxTrouble, read_value, skip

HEAD, TAIL, CHAIN = 1024, 4096, 32
#: Parsed objects, and bytes of decoded object streams, that are remembered.
OBJECTS, DECODED = 4096, 32 << 20
_header = re.compile(rb"(\d{1,10})[\x00\t\n\x0c\r ]+(\d{1,5})[\x00\t\n\x0c\r ]+obj")
_before = re.compile(rb"\d{1,10}[\x00\t\n\x0c\r ]+\d{1,5}[\x00\t\n\x0c\r ]+\Z")
_row = re.compile(rb"[\x00\t\n\x0c\r ]*(\d{1,10})[ ]+(\d{1,5})[ ]*([nf])")
_stream = re.compile(rb"stream(\r\n|\n|\r)?")
_end = re.compile(rb"(?:\r\n|\n|\r)?(?:endstream|endstrea\b|endsteam|endobj)")
_ends = re.compile(rb"endstream|endstrea\b|endsteam")
_opens = re.compile(rb"(?<!end)stream(?:\r\n|\n|\r)")
_trailer = re.compile(rb"trailer")
_SPACE = frozenset(bytes([c]) for c in b"\x00\t\n\x0c\r ")

# What is told of issues that have no kind of their own, and where.
REASONS = {
    "offsets": ("cross-reference table", "entries that do not point at their object"), "generations": ("cross-reference table", "generation numbers that do not match"),
    "hybrid": ("cross-reference table", "/XRefStm that leads to no xref stream"), "overfree": ("cross-reference table", "/XRefStm entries for objects the table marks free"),
    "holders": ("object stream", "a header pdf.js cannot follow"), "holder_types": ("object stream", "a /Type other than /ObjStm"), "direct_root": ("trailer", "a catalog written in the trailer"),
    "direct_streams": ("", "streams written inside other objects"), "held_streams": ("object stream", "streams stored in an object stream"),
    "reference_generations": ("", "references whose generation does not match the object"), "structural": ("", "references to object or xref streams"),
}


def heads(data: bytes) -> list[re.Match]:
    """What _header finds, in order: looked for from the word that all headers end with, which is rare."""
    out, at = [], data.find(b"obj")
    while at >= 0:
        if data[at - 1 : at] in _SPACE:
            start = max(0, at - 64)
            m = _before.search(data[start:at])
            if start and not data[start:at].lstrip(b"0123456789\x00\t\n\x0c\r "):
                return list(_header.finditer(data))  # the header may begin before
            if m:
                out.append(_header.match(data, start + m.start()))
        at = data.find(b"obj", at + 3)
    return out


class Unreadable(Exception):
    """No document can be read from the bytes."""


class TimeUp(Exception):
    """The run's time is over."""


class Intervals:
    """Half-open ranges, merged and sorted, for lookups by bisection."""

    def __init__(self, ranges: list[tuple[int, int]]):
        self.starts: list[int] = []
        self.stops: list[int] = []
        for a, b in sorted(ranges):
            if self.stops and a <= self.stops[-1]:
                self.stops[-1] = max(self.stops[-1], b)
            else:
                self.starts.append(a)
                self.stops.append(b)

    def __contains__(self, at: int) -> bool:
        k = bisect_right(self.starts, at) - 1
        return k >= 0 and at < self.stops[k]


def overlap(ranges: list[tuple[int, int]]) -> bool:
    """Whether any two ranges (start, count) share a number."""
    stop = -1
    for start, count in sorted(r for r in ranges if r[1] > 0):
        if start < stop:
            return True
        stop = start + count
    return False


class Pdf:
    """Objects of one file, parsed when they are asked for."""

    def __init__(self, data: bytes, passwords: list[str] | None = None, limit: int = 1 << 28, objects: int | None = None, deadline: float | None = None):
        self.data, self.limit, self.deadline = data, limit, deadline
        self.notes = Notes()
        self.issues: dict[str, int] = {k: 0 for k in ("rebuilt", "superseded", "sections", "length", "malformed", "undecoded", *REASONS)}
        self.marked: dict[str, set] = {}
        at = data[:HEAD].find(b"%PDF-")
        self.has_header, self.leading = at >= 0, max(0, at)
        self.version = (re.match(rb"\d\.\d", data[at + 5 : at + 8]) or [b""])[0].decode() if at >= 0 else ""
        end = data.rfind(b"%%EOF")
        tail = data[end + 5 :] if end >= 0 else b""
        self.trailing = len(tail) if end >= 0 and tail.strip(b"\0\t\n\x0c\r ") else 0
        self.truncated = end < 0
        self._stream_ends: list[int] | None = None
        self._stream_bodies: Intervals | None = None
        self.table: dict[int, tuple] = {}
        self.trailer: dict = {}
        self.cache: OrderedDict[int, object] = OrderedDict()
        self.lifted: dict[int, Stream] = {}
        self.lifted_at: dict[int, int] = {}
        self.holders: OrderedDict[int, tuple[bytes, dict[int, int]]] = OrderedDict()
        self.busy: set[int] = set()
        self.extents: dict[int, tuple[int, int]] = {}
        self._stop = 0
        self.security: Security | None = None
        try:
            self._follow()
            if not isinstance(self.resolve(self.trailer.get("Root")), dict):
                raise Unreadable("no catalog")
            self._secure(passwords or [])
            if not self.pages():
                raise Unreadable("no pages")
        except (Unreadable, SyntaxTrouble, ValueError, KeyError, IndexError, TypeError, RecursionError):
            self.rebuild(passwords)
        if objects is not None and len(self.table) > objects:
            raise filters.TooLarge("objects")
        if not isinstance(self.trailer.get("Root"), Ref):
            self.issues["direct_root"] = 1

    def check(self) -> None:
        if self.deadline is not None and time.monotonic() > self.deadline:
            raise TimeUp

    def mark(self, issue: str, what) -> None:
        """Count an issue once for each thing that has it."""
        seen = self.marked.setdefault(issue, set())
        if what not in seen:
            seen.add(what)
            self.issues[issue] += 1

    def stream_end(self, start: int) -> int:
        """Where the word that ends a stream stands next, or the end of the file."""
        if self._stream_ends is None:
            self._stream_ends = [m.start() for m in _ends.finditer(self.data)]
        k = bisect_left(self._stream_ends, start)
        return self._stream_ends[k] if k < len(self._stream_ends) else len(self.data)

    def bodies(self) -> Intervals:
        """The ranges between the words that open and end streams, as a scan of the bytes finds them."""
        if self._stream_bodies is None:
            ranges, stop = [], -1
            for m in _opens.finditer(self.data):
                if m.start() >= stop:
                    stop = self.stream_end(m.end())
                    ranges.append((m.start(), stop))
            self._stream_bodies = Intervals(ranges)
        return self._stream_bodies

    def headers(self, outside: bool = True) -> list[re.Match]:
        """Object headers outside of comments, and of what looks like a stream."""
        inside, out = self.bodies() if outside else Intervals([]), []
        for m in heads(self.data):
            if m.start() in inside:
                continue
            line = max(self.data.rfind(b"\n", max(0, m.start() - 256), m.start()), self.data.rfind(b"\r", max(0, m.start() - 256), m.start())) + 1
            if b"%" not in self.data[max(line, m.start() - 256) : m.start()]:
                out.append(m)
        return out

    # cross-references

    def _follow(self) -> None:
        tail = self.data.rfind(b"startxref", max(0, len(self.data) - TAIL))
        m = re.compile(rb"startxref[\x00\t\n\x0c\r ]*(\d+)").match(self.data, max(0, tail))
        if tail < 0 or not m:
            raise Unreadable("no startxref")
        at: int | None = int(m[1]) + self.leading
        seen: set[int] = set()
        while at is not None and at not in seen and 0 <= at < len(self.data):
            seen.add(at)
            section = self._section(at)
            self.issues["sections"] += 1
            for k, v in section.items():
                if k != "__free":
                    self.trailer.setdefault(k, v)
            if "XRefStm" in section:
                self._hybrid(section["XRefStm"], section)
            previous = section.get("Prev")
            at = previous + self.leading if isinstance(previous, int) else None
        if not self.table:
            raise Unreadable("an empty table")

    def _hybrid(self, extra, section: dict) -> None:
        """The stream beside a table adds what the table leaves out; what it marks free stays free."""
        free = {n for n in section.get("__free", ()) if self.table.get(n) == ("free",)}
        before = dict(self.table)
        try:
            if not isinstance(extra, int) or not 0 < extra < len(self.data):
                raise Unreadable("no offset")
            for n in free:
                self.table.pop(n)
            self._section(extra + self.leading)
        except (Unreadable, SyntaxTrouble, ValueError, KeyError, IndexError, TypeError):
            self.table = before
            self.issues["hybrid"] += 1
            return
        for n in free:
            if self.table.get(n, ("free",)) != ("free",):
                self.issues["overfree"] += 1
            self.table.setdefault(n, ("free",))

    def _enter(self, num: int, row: tuple, fresh: set[int]) -> None:
        if num in self.table and num not in fresh:
            self.issues["superseded"] += row[0] != "free"
        else:
            fresh.add(num)
            self.table[num] = row

    def _section(self, at: int) -> dict:
        at = skip(self.data, at)
        fresh: set[int] = set()
        if self.data[at : at + 4] != b"xref":
            m = _header.match(self.data, at)
            value = self._parse_at(m.end(), Ref(int(m[1]), int(m[2])), plain=True) if m else None
            if not isinstance(value, Stream) or value.get("Type") != "XRef":
                raise Unreadable("no cross-reference section")
            self._rows(value, fresh)
            return dict(value)
        at += 4
        ranges: list[tuple[int, int]] = []
        free: set[int] = set()
        while True:
            at = skip(self.data, at)
            m = re.compile(rb"(\d+)[\x00\t\n\x0c\r ]+(\d+)").match(self.data, at)
            if not m:
                break
            num, count, at = int(m[1]), int(m[2]), m.end()
            first = _row.match(self.data, at)
            if num == 1 and count and first and first[3] == b"f" and int(first[2]) == 65535:
                num = 0  # a table that starts one too high
            ranges.append((num, count))
            for k in range(count):
                row = _row.match(self.data, at)
                if not row:
                    raise Unreadable("a table row is broken")
                at = row.end()
                if num + k == 0 and row[3] == b"n":
                    raise Unreadable("object 0 in use")
                if row[3] == b"f":
                    free.add(num + k)
                self._enter(num + k, ("at", int(row[1]) + self.leading, int(row[2])) if row[3] == b"n" else ("free",), fresh)
        at = skip(self.data, at)
        if self.data[at : at + 7] != b"trailer":
            raise Unreadable("no trailer")
        trailer, _ = read_value(self.data, at + 7, self.notes)
        if not isinstance(trailer, dict):
            raise Unreadable("no trailer")
        if overlap(ranges):
            raise Unreadable("ranges that overlap")
        return trailer | ({"__free": free} if "XRefStm" in trailer else {})

    def _rows(self, section: Stream, fresh: set[int]) -> None:
        widths = section.get("W")
        if not isinstance(widths, list) or len(widths) < 3 or not all(isinstance(w, int) and 0 <= w <= 8 for w in widths):
            raise Unreadable("a stream of rows without widths")
        body, step = filters.decode(section.raw, section, self.limit), sum(widths)
        ranges = section.get("Index") or [0, section.get("Size", 0)]
        at = 0
        pairs = list(zip(ranges[::2], ranges[1::2]))
        if overlap(pairs):
            raise Unreadable("ranges that overlap")
        for start, count in pairs:
            for num in range(start, start + count):
                row, parts, p = body[at : at + step], [], 0
                if len(row) < step or not step:
                    return
                at += step
                for w in widths:
                    parts.append(int.from_bytes(row[p : p + w], "big") if w else None)
                    p += w
                kind = 1 if parts[0] is None else parts[0]
                if kind == 1:
                    self._enter(num, ("at", (parts[1] or 0) + self.leading, parts[2] or 0), fresh)
                elif kind == 2:
                    self._enter(num, ("in", parts[1], parts[2] or 0), fresh)
                else:
                    self._enter(num, ("free",), fresh)

    def _scan(self) -> None:
        """Rebuild the table from the object headers, the newest of each number last, and find a trailer."""
        self.issues.update({k: 0 for k in self.issues} | {"rebuilt": 1})
        self.marked.clear()
        self.table, self.security = {}, None
        self.cache.clear()
        self.holders.clear()
        for m in self.headers():
            if int(m[1]):
                self.table[int(m[1])] = ("at", m.start(), int(m[2]))
        found: list[dict] = []
        for m in _trailer.finditer(self.data):
            self.check()
            try:
                value, _ = read_value(self.data, m.end(), self.notes)
            except SyntaxTrouble:
                continue
            if isinstance(value, dict):
                found.append(value)
        catalogs = []
        for num in list(self.table):
            self.check()
            value = self.get(Ref(num, 0))
            kind = value.get("Type") if isinstance(value, dict) else None
            if isinstance(value, Stream) and kind == "XRef":
                found.append({k: v for k, v in value.items() if k in ("Root", "Info", "Encrypt", "ID")})
            elif isinstance(value, Stream) and kind == "ObjStm":
                for inner in self._holder(num)[1]:
                    self.table.setdefault(inner, ("in", num, 0))
            elif kind == "Catalog":
                catalogs.append(num)
        self.trailer = self._pick(found)
        if not isinstance(self.resolve(self.trailer.get("Root")), dict):
            held = [n for n, row in self.table.items() if row[0] == "in"]
            catalogs += [n for n in held if isinstance(v := self.get(Ref(n, 0)), dict) and v.get("Type") == "Catalog"]
            if not catalogs:
                raise Unreadable("no catalog")
            self.trailer = self.trailer | {"Root": Ref(catalogs[-1], 0)}

    def _pick(self, found: list[dict]) -> dict:
        """The trailer to trust: the first with a catalog, a page count and an ID (and a key, where any has one), else
        the last with a catalog, else all of them together."""
        locked, usable = any("Encrypt" in t for t in found), []
        for t in found:
            root = self.resolve(t.get("Root"))
            if not isinstance(root, dict):
                continue
            usable.append(t)
            pages = self.resolve(root.get("Pages"))
            if isinstance(pages, dict) and isinstance(self.resolve(pages.get("Count")), int) and isinstance(self.resolve(t.get("ID")), list) and ("Encrypt" in t or not locked):
                return dict(t)
        if usable:
            return dict(usable[-1])
        return {k: v for t in found for k, v in t.items()}

    def rebuild(self, passwords: list[str] | None = None) -> None:
        self._scan()
        self._secure(passwords or [])

    def _secure(self, passwords: list[str]) -> None:
        d = self.resolve(self.trailer.get("Encrypt"))
        if isinstance(d, dict):
            ids = self.resolve(self.trailer.get("ID"))
            d = {k: self.resolve(v) for k, v in d.items()}
            self.security = Security(d, ids[0] if isinstance(ids, list) and ids and isinstance(ids[0], bytes) else b"", passwords)
            self.cache.clear()
            self.holders.clear()

    # objects

    def get(self, ref: Ref):
        """The object, or None where there is none or it cannot be read."""
        num = ref.num
        if num < 0:
            return self.lifted.get(num)
        if num in self.cache:
            self.cache.move_to_end(num)
            return self.cache[num]
        row = self.table.get(num)
        if row is None or row[0] == "free" or num in self.busy:
            return None
        self.check()
        self.busy.add(num)
        value = None
        try:
            if row[0] == "in":
                value = self._held(row[1], num)
            else:
                m = _header.match(self.data, skip(self.data, row[1]) if 0 <= row[1] < len(self.data) else 0)
                if not m or int(m[1]) != num:
                    self.mark("offsets", num)
                    if not self.issues["rebuilt"]:
                        raise Unreadable("a row that leads to no object")
                else:
                    if int(m[2]) != row[2]:
                        self.mark("generations", num)
                    value = self._parse_at(m.end(), Ref(num, int(m[2])))
                    self.extents[num] = (m.start(), self._stop)
        except SyntaxTrouble:
            self.issues["malformed"] += 1
        finally:
            self.busy.discard(num)
        self.cache[num] = value
        if len(self.cache) > OBJECTS:
            self.cache.popitem(last=False)
        return value

    def generation(self, num: int) -> int:
        row = self.table.get(num)
        return row[2] if row is not None and row[0] == "at" else 0

    def resolve(self, value):
        if type(value) is not Ref:
            return value
        for _ in range(CHAIN):
            if not isinstance(value, Ref):
                return value
            value = self.get(value)
        return None

    def _body(self, value: dict, at: int, ref: Ref | None) -> tuple[Stream, int]:
        """The stream whose keyword stands at `at`, and the position after its bytes."""
        m = _stream.match(self.data, at)
        start, size = m.end(), self.resolve(value.get("Length"))
        if not isinstance(size, int) or isinstance(size, bool) or size < 0 or not _end.match(self.data, start + size):
            self.issues["length"] += 1
            stop = self.stream_end(start)
            for mark in (b"\r\n", b"\n", b"\r"):
                if self.data[max(start, stop - 2) : stop].endswith(mark):
                    stop -= len(mark)
                    break
            size = max(0, stop - start)
        stream = Stream(value).later(lambda: self.data[start : start + size], size)
        stream.number = ref
        return stream, start + size

    def _lift(self, ref: Ref):
        """For values of an object: gives a stream that stands inside it a number of its own, below all others."""

        def lift(value: dict, at: int) -> tuple[Ref, int]:
            self.mark("direct_streams", at)
            stream, stop = self._body(value, at, ref)
            if at not in self.lifted_at:
                num = self.lifted_at[at] = -16 - len(self.lifted)
                self.lifted[num] = self._opened(stream, ref) if self.security is not None and self.security.status == "ok" else stream
            m = _ends.search(self.data, stop, stop + 64)
            return Ref(self.lifted_at[at], 0), m.end() if m else stop

        return lift

    def _parse_at(self, at: int, ref: Ref, plain: bool = False):
        value, at = read_value(self.data, at, self.notes, self._lift(ref))
        at = skip(self.data, at)
        if isinstance(value, dict) and _stream.match(self.data, at):
            value, at = self._body(value, at, ref)
        self._stop = at
        if self.security is not None and self.security.status == "ok" and not plain:
            value = self._opened(value, ref)
        return value

    def _opened(self, value, ref: Ref):
        if isinstance(value, bytes):
            return self.security.decrypt(value, *ref)
        if isinstance(value, list):
            return [self._opened(v, ref) for v in value]
        if isinstance(value, dict):
            out = {k: self._opened(v, ref) for k, v in value.items()}
            if isinstance(value, Stream):
                stream = Stream(out).like(value)
                method = self.security.method_for(value)
                if method != "Identity":
                    stream.later(lambda: self.security.decrypt(value.raw, *ref, method), self.security.plain_size(value, ref, method))
                return stream
            return out
        return value

    def can_decrypt(self, stream: Stream) -> bool:
        """False where the key that a stream needs is not known."""
        return self.security is None or self.security.key is not None or self.security.method_for(stream) == "Identity"

    def _holder(self, num: int) -> tuple[bytes, dict[int, int]]:
        """An object stream decoded, and the offset of each object in it."""
        if num in self.holders:
            self.holders.move_to_end(num)
            return self.holders[num]
        found: tuple[bytes, dict[int, int]] = (b"", {})
        holder = self.get(Ref(num, 0))
        if isinstance(holder, Stream):
            if holder.get("Type") != "ObjStm":
                self.mark("holder_types", num)
            try:
                body = filters.decode(holder.raw, holder, self.limit)
                first, at, offsets = int(self.resolve(holder.get("First", 0))), 0, {}
                for _ in range(min(int(self.resolve(holder.get("N", 0))), len(body))):
                    a, at = read_value(body, at)
                    b, at = read_value(body, at)
                    if not isinstance(a, int) or not isinstance(b, int):
                        raise SyntaxTrouble("a pair that is no pair")
                    offsets.setdefault(a, first + b)
                found = (body, offsets)
            except (filters.Undecodable, SyntaxTrouble, TypeError, ValueError):
                self.mark("holders", num)
                self.issues["undecoded"] += 1
        self.holders[num] = found
        while len(self.holders) > 1 and sum(len(b) for b, _ in self.holders.values()) > DECODED:
            self.holders.popitem(last=False)
        return found

    def _held(self, holder: int, num: int):
        body, offsets = self._holder(holder)
        if num not in offsets:
            return None
        value, at = read_value(body, offsets[num], self.notes)
        if isinstance(value, dict) and _stream.match(body, skip(body, at)):
            self.mark("held_streams", num)
            return None
        return value

    def bytes_of(self, stream: Stream) -> bytes | None:
        """The stream decoded, or None where a filter is unknown or fails."""
        try:
            d = {k: self._flat(v) if k in ("Filter", "DecodeParms", "F", "DP") else v for k, v in stream.items()}
            return filters.decode(stream.raw, d, self.limit)
        except filters.Undecodable:
            return None

    def _flat(self, value):
        """A filter entry with its references resolved, one level down."""
        value = self.resolve(value)
        if isinstance(value, list):
            return [self._flat(v) if isinstance(v, Ref) else {k: self.resolve(x) for k, x in v.items()} if isinstance(v, dict) else v for v in value]
        return {k: self.resolve(x) for k, x in value.items()} if isinstance(value, dict) else value

    def live(self) -> list[int]:
        return [n for n, row in self.table.items() if row[0] != "free"]

    # pages

    def pages(self) -> list[tuple[Ref | None, dict, dict]]:
        """(reference, page, inherited attributes) in order; loops are cut."""
        root = self.resolve(self.trailer.get("Root"))
        out, seen = [], set()
        if not isinstance(root, dict):
            return out
        todo = [(root.get("Pages"), {})]
        while todo:
            value, above = todo.pop()
            if isinstance(value, Ref):
                if value.num in seen:
                    continue
                seen.add(value.num)
            node = self.resolve(value)
            if not isinstance(node, dict):
                continue
            held = above | {k: node[k] for k in ("MediaBox", "CropBox", "Annots") if k in node}
            kids = self.resolve(node.get("Kids"))
            if isinstance(kids, list) and node.get("Type") != "Page":
                todo += [(k, held) for k in reversed(kids)]
            elif node.get("Type") == "Page" or "Contents" in node or "MediaBox" in held:
                out.append((value if isinstance(value, Ref) else None, node, held))
        return out

    def dead_definitions(self, everywhere: bool = False) -> int:
        """Object headers that no row of the table leads to, outside of live objects, as far as those have been read;
        with everywhere, also inside them."""
        if self.issues["rebuilt"]:
            return 0
        used = {row[1] for row in self.table.values() if row[0] == "at"}
        inside = Intervals([] if everywhere else [e for n, e in self.extents.items() if self.table.get(n, ("",))[0] == "at"])
        starts = (m.start() for m in (heads(self.data) if everywhere else self.headers(False)))
        return sum(at not in used and skip(self.data, at) not in used and at not in inside for at in starts)


def is_name(value, *names: str) -> bool:
    return isinstance(value, Name) and value in names
