"""Forms written in XML: what an XDP holds, as items with byte ranges, and edits that leave all other bytes alone.

The standard library's event parser reads the form and tells byte positions; nothing is resolved from outside, and a
document type is refused. A bare & is text to viewers, so it stands masked by an unused character while parsed.
"""

from __future__ import annotations

import re
from bisect import bisect_left
from typing import NamedTuple
from xml.parsers import expat


class FormTrouble(ValueError):
    """A form that cannot be read whole, and so cannot be cleaned in part."""


class FormItem(NamedTuple):
    """kind is packet, submit, execute, connection, exObject, reference, href, link, image or script.

    value is what the part names (an address, a file, a language); other is a link as lenient readers read it, where
    that differs.
    """

    kind: str
    start: int
    end: int
    packet: str
    som: str
    value: str
    other: str = ""


# Packets that stay, elements and attributes that reach outside the form, elements that name a path.
KEPT_PACKETS = ("template", "datasets", "config", "localeSet", "connectionSet", "form", "xmpmeta")
CODE_PACKETS = ("template", "form")
REACHING = {"submit": "submit", "execute": "execute", "exObject": "exObject", "connect": "connection"}
TARGETS = ("target", "connection", "codeBase", "classId")
CONFIG_REFERENCES = ("uri", "submitUrl", "xsl", "outputXSL", "base")
SERVERS = ("url", "server")
NAMED = ("subform", "subformSet", "field", "exclGroup", "draw", "area", "pageSet", "pageArea", "contentArea")
ENTITIES = {"lt": "<", "gt": ">", "amp": "&", "quot": '"', "apos": "'"}

_BARE = re.compile(rb"&(?![^;&]+;)")
_TAG = re.compile(rb"""<(?:[^"'>]|"[^"]*"|'[^']*')*>""")
_ATTRIBUTE = re.compile(rb"""([^\s=/<>"']+)\s*=\s*("[^"]*"|'[^']*')""")
_LENIENT = re.compile(r"&(?:#x([0-9a-f]{1,6})|#([0-9]{1,7})|(lt|gt|amp|quot|apos));?", re.IGNORECASE)
_SPARE = b"\x7f^~`|\\@$%"


class Node:
    __slots__ = ("name", "start", "inside", "inside_end", "end", "parent", "attributes", "children", "text", "loose")

    def __init__(self, name: str, start: int, inside: int, parent: Node | None):
        self.name, self.start, self.inside, self.parent = name, start, inside, parent
        self.inside_end = self.end = inside
        self.attributes: dict[str, tuple[str, int, int]] = {}
        self.children: list[Node] = []
        self.text: list[str] = []
        self.loose = False

    def get(self, name: str) -> str:
        return self.attributes.get(name, ("",))[0]

    def said(self) -> str:
        return "".join(self.text)

    def som(self) -> str:
        """Dotted names from the outermost element on that has one; this element's own counts whatever it is."""
        out, at = [], self
        while at is not None:
            if at.get("name") and (at is self or at.name in NAMED):
                out.append(at.get("name"))
            at = at.parent
        return ".".join(reversed(out))

    def activity(self) -> str:
        """What makes a script of this element run."""
        at = self.parent
        while at is not None:
            if at.name == "event":
                return at.get("activity") or "event"
            if at.name in ("calculate", "validate"):
                return at.name
            if at.name == "variables":
                return "script-object"
            at = at.parent
        return "unknown"


def _local(name: str) -> str:
    return name.rpartition(":")[2]


def read_tree(data: bytes) -> Node:
    """The root element. FormTrouble for bytes that are no UTF-8, a document type, unknown entities, or ill-formed XML."""
    try:
        data.decode("utf-8")
    except UnicodeDecodeError:
        raise FormTrouble("bytes that are not UTF-8") from None
    bare = [m.start() for m in _BARE.finditer(data)]
    spare = next((c for c in _SPARE if c not in data), None) if bare else 0x7F
    if spare is None:
        raise FormTrouble("too many odd characters beside a bare &")
    masked, mask = (_BARE.sub(lambda _: bytes([spare]), data), chr(spare)) if bare else (data, "")
    odd = [at for at in bare if data[at + 1 : at + 2].isalpha() or data[at + 1 : at + 2] == b"#"]
    roots: list[Node] = []
    open_nodes: list[Node] = []
    quoted = False

    def plain(text: str) -> str:
        return text.replace(mask, "&") if mask else text

    parser = expat.ParserCreate("utf-8")
    parser.ordered_attributes = True

    def starts(name: str, attributes: list[str]) -> None:
        at = parser.CurrentByteIndex
        tag = _TAG.match(data, at)
        if tag is None:
            raise FormTrouble("a tag that does not end")
        node = Node(_local(name), at, tag.end(), open_nodes[-1] if open_nodes else None)
        places = {m[1].decode(): m.span() for m in _ATTRIBUTE.finditer(data, at, tag.end())}
        for key, value in zip(attributes[::2], attributes[1::2]):
            node.attributes.setdefault(_local(key), (plain(value), *places[key]))
        (open_nodes[-1].children if open_nodes else roots).append(node)
        open_nodes.append(node)

    def ends(_: str) -> None:
        node, at = open_nodes.pop(), parser.CurrentByteIndex
        if data[node.inside - 2 : node.inside] == b"/>":
            node.inside_end = node.end = node.inside
        else:
            node.inside_end, node.end = at, data.index(b">", at) + 1

    def says(text: str) -> None:
        node, at = open_nodes[-1], parser.CurrentByteIndex
        if odd and not quoted and mask in text:
            k = bisect_left(odd, at)
            node.loose |= k < len(odd) and odd[k] < at + len(text.encode())
        node.text.append(plain(text))

    def quote(on: bool) -> None:
        nonlocal quoted
        quoted = on

    def refuse(*_) -> None:
        raise FormTrouble("a document type")

    parser.StartElementHandler, parser.EndElementHandler, parser.CharacterDataHandler = starts, ends, says
    parser.StartCdataSectionHandler, parser.EndCdataSectionHandler = lambda: quote(True), lambda: quote(False)
    parser.StartDoctypeDeclHandler = refuse
    try:
        parser.Parse(masked, True)
    except (expat.ExpatError, KeyError, UnicodeDecodeError) as e:
        raise FormTrouble(str(e)[:80]) from None
    return roots[0]


def lenient(raw: str) -> str:
    """Text as a reader gives it that decodes references without their semicolon, as for HTML."""

    def one(m: re.Match) -> str:
        code = int(m[1], 16) if m[1] else int(m[2]) if m[2] else None
        if code is None:
            return ENTITIES[m[3].lower()]
        return chr(code) if 0 < code <= 0x10FFFF else m[0]

    return re.sub(r"[\t\n\r]", " ", _LENIENT.sub(one, raw))


def _encoded(node: Node) -> bool:
    """Whether a picture's text is base64, as it says or as is usual."""
    text = re.sub(r"\s+", "", node.said())
    return (node.get("transferEncoding").strip() or "base64").lower() == "base64" and bool(re.fullmatch(r"[A-Za-z0-9+/]*={0,2}", text))


def _language(node: Node) -> str:
    kind = node.get("contentType").strip()
    if node.children or node.loose:
        return "an unreadable form"
    if not kind or kind.lower() == "application/x-formcalc":
        return "FormCalc"
    return "JavaScript" if re.search("javascript|ecmascript", kind, re.IGNORECASE) else kind[:40]


def form_items(data: bytes, strip_metadata: bool = False, images: frozenset[str] = frozenset()) -> list[FormItem]:
    """Parts of a whole XDP that a policy may remove, in document order; nothing inside a removable element is told.

    `images` are names of pictures the document itself holds; an image element that names one refers to nothing outside.
    """
    root = read_tree(data)
    if root.name != "xdp":
        raise FormTrouble(f"a root element {root.name[:40]} that is no XDP")
    out: list[FormItem] = []
    todo: list[tuple[Node, str]] = []
    for child in reversed(root.children):
        todo.append((child, child.name))
    while todo:
        node, packet = todo.pop()
        owner = node.parent if node.parent is not None else node
        if node.parent is root and (packet not in KEPT_PACKETS or (strip_metadata and packet == "xmpmeta")):
            out.append(FormItem("packet", node.start, node.end, packet, owner.som(), packet))
            continue
        code, words = packet in CODE_PACKETS, " ".join(node.said().split())[:120]
        if code and node.name in REACHING:
            target = next((node.attributes[k][0] for k in TARGETS if k in node.attributes), "")
            out.append(FormItem(REACHING[node.name], node.start, node.end, packet, owner.som(), target))
            continue
        named = packet == "config" and node.name in CONFIG_REFERENCES and (node.children or words)
        if named or (packet == "connectionSet" and node.name == "uri"):
            out.append(FormItem("reference", node.start, node.end, packet, owner.som(), f"{node.name} {words}".strip()))
            continue
        if packet == "connectionSet" and node.name.endswith("Connection") and node.name != "xsdConnection":
            out.append(FormItem("connection", node.start, node.end, packet, node.som(), f"{node.name} {node.get('name')}".strip()))
            continue
        for key, (value, start, end) in node.attributes.items():
            if not value.strip():
                continue
            if key == "href" and node.name == "a":
                raw = data[start:end].partition(b"=")[2].strip()[1:-1].decode()
                other = lenient(raw)
                out.append(FormItem("link", start, end, packet, node.som(), value, other if other != value else ""))
            elif key == "href" and not (node.name == "image" and value in images):
                out.append(FormItem("href", start, end, packet, node.som(), value))
            elif (key == "usehref" and not re.match(r"\s*\.?#", value)) or (code and key in SERVERS):
                out.append(FormItem("reference", start, end, packet, node.som(), f"{node.name} {key} {value[:120]}"))
        picture = (code and node.name == "image") or (packet == "datasets" and node.get("contentType").strip().lower().startswith("image/"))
        if picture and not node.children:
            if words:
                out.append(FormItem("image", node.inside, node.inside_end, packet, owner.som(), node.get("contentType").strip() if _encoded(node) else "data that is not base64", "".join(node.said().split()) if _encoded(node) else ""))
        elif code and node.name == "script":
            if node.children or words:
                out.append(FormItem("script", node.inside, node.inside_end, packet, ", ".join(x for x in (node.som(), node.activity()) if x), _language(node), "" if node.children or node.loose else node.said()))
        else:
            todo += [(child, packet) for child in reversed(node.children)]
    return out


def without(bodies: list[bytes], ranges: list[tuple[int, int]], instead: dict[int, bytes] | None = None) -> list[bytes]:
    """The parts of a form whose concatenation has these byte ranges, without them; a range may span several parts.

    instead: what stands in place of a range, by its start. Of ranges that overlap the first, then the longest counts.
    """
    instead = instead or {}
    edits, stop = [], -1
    for start, end in sorted(set(ranges), key=lambda r: (r[0], -r[1])):
        if start >= stop:
            edits.append((start, end, instead.get(start, b"")))
            stop = end
    out, at = [], 0
    for body in bodies:
        kept, here = [], 0
        for start, end, new in edits:
            a, b = max(start - at, here), min(end - at, len(body))
            if a < b or (a == b == start - at and new and 0 <= a <= len(body)):
                kept.append(body[here:a])
                if 0 <= start - at < len(body):  # the part that holds its start holds what comes instead
                    kept.append(new)
                here = b
        out.append(b"".join(kept) + body[here:])
        at += len(body)
    return out
