"""One walk over a document's graph: it tells what it meets, and rebuilds the document without the slots named to it.

A slot is the place of a removable thing, named by its object and the keys below it. The first walk is given none and
only reports; policy decides outside; the second walk is given the slots to remove.
"""

from __future__ import annotations

import base64
import hashlib
import re
import sys
import uuid
import zlib
from collections import Counter, deque
from typing import NamedTuple

from parchment.sources.pdf.document import Pdf
from parchment.sources.pdf.filters import chain_of
from parchment.sources.pdf.values import Name, Ref, Stream, encode_text, text_of, write_value
from parchment.sources.pdf.xfa import FormTrouble, form_items, without


class Item(NamedTuple):
    """A finding, or what is decided outside: a link or file (detail empty), a label beside its links (LABEL), a further
    name of a file (NAME), a picture of a form (IMAGE), a calculation order (ORDER), a silent loss (LOST).

    content: a file's bytes, a script's text, a picture's data. other: a link's second reading, the first name of a
    file that has a further one. forced: goes whatever a caller's overrides say.
    """

    ordinal: int
    category: str
    detail: str
    location: str
    slot: str
    value: str
    label: str
    content: bytes | None
    other: str = ""
    forced: bool = False


# Action types, annotation types, triggers and what each of them is reported as.
NAVIGATION = ("GoTo", "GoToDp", "Trans", "ResetForm")
STEPS = ("NextPage", "PrevPage", "FirstPage", "LastPage")
ACTIONS = {
    "Launch": ("ACTION", "LAUNCH"), "GoToR": ("ACTION", "REMOTE_GOTO"), "GoToE": ("ACTION", "EMBEDDED_GOTO"), "SubmitForm": ("ACTION", "SUBMIT_FORM"),
    "ImportData": ("ACTION", "IMPORT_DATA"), "Hide": ("ACTION", "HIDE"), "SetOCGState": ("ACTION", "SET_LAYER_STATE"), "Movie": ("MEDIA", "MOVIE"),
    "Sound": ("MEDIA", "SOUND"), "RichMediaExecute": ("MEDIA", "RICH_MEDIA"), "GoTo3DView": ("MEDIA", "THREE_D"),
}
KNOWN = (*NAVIGATION, *ACTIONS, "Thread", "URI", "Named", "JavaScript", "Rendition")
MEDIA = {"Movie": "MOVIE", "Sound": "SOUND", "Screen": "SCREEN", "RichMedia": "RICH_MEDIA", "3D": "THREE_D"}
ALLOWED = "Link Widget Text Popup FreeText Line Square Circle Polygon PolyLine Highlight Underline Squiggly StrikeOut Stamp Caret Ink Redact Watermark".split()
OTHERS = ("FileAttachment", "PrinterMark", "TrapNet", "Projection")
TRIGGERS = {
    "document": {"WC": "document-will-close", "WS": "document-will-save", "DS": "document-did-save", "WP": "document-will-print", "DP": "document-did-print"},
    "page": {"O": "page-open", "C": "page-close"},
    "annotation": {"E": "mouse-enter", "X": "mouse-exit", "D": "mouse-down", "U": "mouse-up", "Fo": "focus", "Bl": "blur", "PO": "page-open", "PC": "page-close", "PV": "page-visible", "PI": "page-invisible"},
    "field": {"K": "field-keystroke", "F": "field-format", "V": "field-validate", "C": "field-calculate"},
}
TREES = {"JavaScript": ("JAVASCRIPT", "UNATTACHED"), "EmbeddedFiles": ("EMBEDDED_FILE", "NO_PLUGIN"), "Renditions": ("MEDIA", "RENDITION"), "AlternatePresentations": ("MEDIA", "SLIDESHOW")}
COUNTED = frozenset((("FORM", "FIELDS"), ("SIGNATURE", "SIGNED"), ("SIGNATURE", "CERTIFIED"), ("SIGNATURE", "USAGE_RIGHTS"), ("CONTENT", "JBIG2_IMAGE"), ("CONTENT", "JPX_IMAGE"), ("CONTENT", "TYPE3_FONT"), ("METADATA", "XMP"), ("METADATA", "INFO_DICTIONARY")))

FORM_PARTS = {
    "packet": ("FORM", "XFA_PACKET"), "submit": ("ACTION", "SUBMIT_FORM"), "execute": ("FORM", "XFA_EXECUTE"), "connection": ("FORM", "XFA_CONNECTION"),
    "exObject": ("FORM", "XFA_EXTERNAL_OBJECT"), "reference": ("FORM", "XFA_EXTERNAL_REFERENCE"), "script": ("JAVASCRIPT", "XFA"), "link": ("LINK", ""), "href": ("FORM", ""), "image": ("FORM", "XFA_IMAGE"),
}

GONE = object()
#: Values without parts; what stands for the slot and the place of an annotation while it is walked for all its places.
_item = tuple.__new__
PLAIN = frozenset((int, float, bool, bytes, Name, type(None)))
SLOT, PLACE = (f"{{{uuid.uuid4().hex}}}" for _ in range(2))
#: Nodes of a name tree, links of a chain of actions, links of a chain that labels are held against, characters of a label, objects that are walked.
NODES, LINKS, CHECKED, LABEL, MOST = 1_000_000, 1000, 256, 4096, 10_000_000
# values nest to 512 levels and chains of actions to LINKS, a few calls a level
sys.setrecursionlimit(max(sys.getrecursionlimit(), 20_000))


def short(text: str, n: int = 60) -> str:
    return text if len(text) <= n else text[: n - 3] + "..."


def _alone(value) -> bool:
    """Whether a value leads to no object, and holds no triggers, which are also looked up by their place."""
    todo = [value]
    while todo:
        v = todo.pop()
        if type(v) is dict:
            if "AA" in v:
                return False
            todo += v.values()
        elif type(v) is list:
            todo += v
        elif type(v) not in PLAIN:
            return False
    return True


class Walk:
    def __init__(self, pdf: Pdf, remove: frozenset[str] = frozenset(), strip_metadata: bool = False, bodies: dict[str, bytes] | None = None):
        """remove: slots that go. bodies: what stands instead in a slot that stays: files, scripts, pictures."""
        self.pdf, self.remove, self.strip_metadata, self.bodies = pdf, remove, strip_metadata, bodies or {}
        self.told_files: set[tuple[int, str]] = set()
        self.first_names: dict[int, str] = {}
        self.file_streams: set[int] = set()
        self.signed = self.cut = self.form_kept = False
        self.lost = ""
        self.orders: list[tuple[str, list[int]]] = []
        self.calculations: dict[int, list[str]] = {}
        self.items: list[Item] = []
        self.kept: dict[int, object] = {}
        self.queue: deque[tuple[Ref, str, str]] = deque()
        # objects visited as such; objects met inside others, or only in what goes: they count as referenced
        self.seen: set[int] = set()
        self.met: set[int] = set()
        self.roles: dict[int, str] = {}
        self.place: dict[int, tuple[str, int, list | None]] = {}
        self.alt: dict[int, str] = {}
        self.cleaned: dict[int, Stream] = {}
        self.pages = pdf.pages()
        self.removed = False
        self.root = pdf.trailer.get("Root")
        self._plan()
        self._labels()
        catalog = pdf.resolve(self.root)
        self.info = self._information()
        self.catalog = self._dict(catalog, "root", "document catalog", "catalog") if isinstance(catalog, dict) else {}
        if isinstance(self.root, Ref):
            self.seen.add(self.root.num)
        self._drain()
        self._after()

    # telling

    def tell(self, category: str, detail: str, location: str = "", slot: str = "", value: str = "", label: str = "", content: bytes | None = None, other: str = "", forced: bool = False) -> bool:
        """Report, and say whether the slot is to go."""
        self.items.append(Item(len(self.items), category, detail, location, slot, value, label, content, other, forced))
        gone = bool(slot) and slot in self.remove
        self.removed |= gone
        return gone

    def _plan(self) -> None:
        """Places of annotations by page, and the page of each page object."""
        for i, (ref, page, held) in enumerate(self.pages):
            where = f"page {i + 1}"
            if ref is not None:
                self.roles[ref.num] = "page"
                self.place.setdefault(ref.num, (where, i, None))
            annots = self.pdf.resolve(held.get("Annots"))
            box = self._box(held)
            for k, a in enumerate(annots if isinstance(annots, list) else []):
                if isinstance(a, Ref):  # the first page that shows it gives the place, the smallest the box
                    first = self.place.get(a.num)
                    if first is None or first[2] is None:
                        self.place[a.num] = (f"{where}, annotation {k + 1}", i, box)
                    elif _area(box) < _area(first[2]):
                        self.place[a.num] = (*first[:2], box)
        root = self.pdf.resolve(self.root)
        if isinstance(root, dict):
            if isinstance(root.get("Names"), Ref):
                self.roles[root["Names"].num] = "names"
            if isinstance(root.get("AcroForm"), Ref):
                self.roles[root["AcroForm"].num] = "form"

    def _labels(self) -> None:
        """Annotations' alternative texts: of the nearest structure element above them that has one."""
        root = self.pdf.resolve(self.root)
        todo: list[tuple[object, str | None]] = [(root.get("StructTreeRoot"), None)] if isinstance(root, dict) else []
        seen: set[int] = set()
        while todo:
            v, alt = todo.pop()
            if isinstance(v, Ref):
                if v.num in seen:
                    continue
                seen.add(v.num)
                v = self.pdf.get(v)
            if isinstance(v, list):
                todo += [(x, alt) for x in v]
            elif isinstance(v, dict):
                if v.get("Type") == "OBJR" or ("Obj" in v and "S" not in v):
                    if isinstance(v.get("Obj"), Ref) and alt:
                        self.alt[v["Obj"].num] = alt
                    continue
                own = text_of(self.pdf.resolve(v.get("Alt")))
                own = text_of(self.pdf.resolve(v.get("ActualText"))) if own is None else own
                todo.append((v.get("K"), alt if own is None else own))

    def _box(self, held: dict) -> list[float]:
        def numbers(v) -> list[float] | None:
            v = [self.pdf.resolve(x) for x in v] if isinstance(v := self.pdf.resolve(v), list) and len(v) == 4 else []
            ok = len(v) == 4 and all(isinstance(x, (int, float)) and not isinstance(x, bool) for x in v)
            return [min(v[0], v[2]), min(v[1], v[3]), max(v[0], v[2]), max(v[1], v[3])] if ok else None

        media = numbers(held.get("MediaBox")) or [0, 0, 612, 792]
        crop = numbers(held.get("CropBox")) or media
        return [max(crop[0], media[0]), max(crop[1], media[1]), min(crop[2], media[2]), min(crop[3], media[3])]

    def _information(self):
        info = self.pdf.resolve(self.pdf.trailer.get("Info"))
        if isinstance(info, dict) and info:
            gone = self.tell("METADATA", "INFO_DICTIONARY", "document", "information")
            if self.strip_metadata:
                self.tell("METADATA", "STRIPPED", "document information")
            if gone or self.strip_metadata:
                self._pass(self.pdf.trailer["Info"])
                return None
            if isinstance(self.pdf.trailer["Info"], Ref):
                self.seen.add(self.pdf.trailer["Info"].num)
            return {k: v for k, v in info.items() if isinstance(v, (bytes, Name))}
        return None

    # the graph

    def _drain(self) -> None:
        while self.queue:
            if len(self.seen) > MOST:
                raise MemoryError("too many objects")
            ref, location, role = self.queue.popleft()
            if ref.num in self.seen:
                continue
            self.seen.add(ref.num)
            value = self.cleaned[ref.num] if ref.num in self.cleaned else self.pdf.get(ref)
            where = self.place.get(ref.num, (location,))[0]
            if isinstance(value, Stream):
                if value.get("Type") in ("XRef", "ObjStm"):
                    self.pdf.mark("structural", ref.num)
                    continue
                if not self.pdf.can_decrypt(value):
                    if ref.num not in self.file_streams:
                        self.tell("ENCRYPTED", "NO_KEY", where, f"obj:{ref.num}", forced=True)
                    continue
                if f"file:{ref.num}" in self.bodies:
                    value = self._replaced(value, self.bodies[f"file:{ref.num}"])
            clean = self._value(value, f"obj:{ref.num}", where, self.roles.get(ref.num, role))
            if clean is not GONE:
                self.kept[ref.num] = clean

    def _value(self, value, path: str, location: str, role: str = ""):
        if isinstance(value, Ref):
            row = self.pdf.table.get(value.num)
            if row is not None and row[0] != "free" and value.gen != self.pdf.generation(value.num):
                self.pdf.mark("reference_generations", (value.num, value.gen))
            self.queue.append((value, location, role))
            return value
        if isinstance(value, list):
            out = [v if type(v) in PLAIN else self._value(v, f"{path}[{i}]", location, role) for i, v in enumerate(value)]
            return [v for v in out if v is not GONE]
        if isinstance(value, dict):
            return self._dict(value, path, location, role)
        return value

    def _kind(self, d: dict, role: str) -> str:
        if role in ("catalog", "page", "names", "form", "file", "triggers"):
            return role
        kind, sub = d.get("Type"), self.pdf.resolve(d.get("Subtype"))
        if kind == "Annot" or ("Rect" in d and (sub in ALLOWED or sub in MEDIA or sub in OTHERS)):
            return "annotation"
        if not isinstance(d, Stream) and (kind == "Action" or self.pdf.resolve(d.get("S")) in KNOWN):
            return "action"
        if kind == "Filespec" or "EF" in d:
            return "file"
        if "Title" in d and any(k in d for k in ("Parent", "Next", "Prev", "First")) and not kind:
            return "bookmark"
        if "FT" in d or ("T" in d and not sub and ("Kids" in d or "Parent" in d)):
            return "field"
        return "any"

    def _dict(self, d: dict, path: str, location: str, role: str):
        kind = self._kind(d, role)
        if kind == "action":
            return self._action(d, path, location, "UNATTACHED", set())
        if kind == "triggers":
            return self._triggers(d, path, location, "annotation")
        skip: set[str] = set()
        out: dict = Stream().like(d) if isinstance(d, Stream) else {}
        before = getattr(self, f"_{kind}", None)
        if before is not None:
            answer = before(d, path, location, out, skip)
            if answer is GONE:
                return GONE
            location = answer or location
        self._also(d, path, location, out, skip)
        if d.get("Type") == "Font" and d.get("Subtype") == "Type3":
            self.tell("CONTENT", "TYPE3_FONT", location)
        if d.get("Subtype") == "Image":
            for name, _ in chain_of({k: self.pdf.resolve(v) for k, v in d.items() if k in ("Filter", "DecodeParms")}):
                if name in ("JBIG2Decode", "JPXDecode"):
                    self.tell("CONTENT", "JBIG2_IMAGE" if name[1] == "B" else "JPX_IMAGE", location)
        for k, v in d.items():
            if k in skip or (isinstance(d, Stream) and k == "Length"):
                continue
            at = f"{path}/{k}"
            if k == "JS":
                if self.tell("JAVASCRIPT", "UNATTACHED", location, at):
                    self._pass(v)
                    continue
            elif k == "AA":
                clean = self._triggers(v, at, location, {"catalog": "document", "page": "page", "field": "field"}.get(kind, "annotation"))
                if clean is not GONE:
                    out[k] = clean
                continue
            elif k == "AF" or (k == "FS" and isinstance(v, (Ref, dict))):
                clean = self._files(v, at, f"{location}, associated file" if k == "AF" else location)
                if clean is not GONE:
                    out[k] = clean
                continue
            elif k == "XFA":
                v = self._xml_form(v, at, location)
                if v is GONE:
                    continue
            elif k == "Metadata":
                gone = self.tell("METADATA", "XMP", location, "metadata")
                if self.strip_metadata:
                    self.tell("METADATA", "STRIPPED", f"{location}, XMP metadata")
                if gone or self.strip_metadata:
                    self._pass(v)
                    continue
            elif k in TREES and kind != "names" and isinstance(v, (dict, Ref)):
                if self.tell(*TREES[k], location, at):
                    self._pass(v)
                    continue
            clean = v if type(v) in PLAIN else self._value(v, at, location)
            if clean is not GONE:
                out[k] = clean
        return out

    def _packets(self, value) -> list[tuple[bytes | None, Ref, Stream]]:
        """The streams of a form and their names, in order."""

        def stream(v) -> tuple[Ref, Stream]:
            ref = v
            for _ in range(32):
                if isinstance(v, Ref):
                    ref, v = v, self.pdf.get(v)
            if not isinstance(v, Stream) or not isinstance(ref, Ref):
                raise FormTrouble("a packet that is no stream")
            return ref, v

        whole = self.pdf.resolve(value)
        if isinstance(whole, Stream):
            return [(None, *stream(value))]
        if not isinstance(whole, list) or len(whole) % 2 or not all(isinstance(k, bytes) for k in whole[::2]):
            raise FormTrouble("neither a stream nor names with streams")
        out = [(k, *stream(v)) for k, v in zip(whole[::2], whole[1::2])]
        if len({ref.num for _, ref, _ in out}) < len(out):
            raise FormTrouble("a packet listed twice")
        return out

    def _pictures(self, names) -> frozenset[str]:
        """Keys of the pictures held for a form; the tree counts as met only when the walk comes to it."""
        met, self.met = self.met, set()
        try:
            return frozenset(text_of(k) for k, _ in self._tree(names.get("XFAImages") if isinstance(names, dict) else None))
        finally:
            self.met = met

    def _xml_form(self, value, at: str, location: str):
        """Tell the parts of a form; the form without those to go, or GONE where it cannot be read and so goes whole."""
        clean = self._cleaned_form(value, at, location)
        self.form_kept = self.form_kept or clean is not GONE
        return clean

    def _cleaned_form(self, value, at: str, location: str):
        if self.tell("FORM", "XFA", location, f"{at}#whole"):
            self._pass(value)
            return GONE
        try:
            packets = self._packets(value)
            bodies = [self.pdf.bytes_of(s) for _, _, s in packets]
            if any(b is None for b in bodies):
                raise FormTrouble("a packet that cannot be decoded")
            names = self.pdf.resolve((self.pdf.resolve(self.root) or {}).get("Names"))
            parts = form_items(b"".join(bodies), self.strip_metadata, self._pictures(names))
        except FormTrouble as e:
            if self.tell("FORM", "XFA_UNREADABLE", location, at, str(e)):
                self._pass(value)
                return GONE
            return value
        ranges, instead = [], {}
        for part in parts:
            where, slot = f"XFA {part.packet}" + (f", {part.som}" if part.som else ""), f"{at}#{part.kind}{part.start}"
            if part.kind == "image" and part.other:
                gone = self.tell("FORM", "IMAGE", where, slot, "", part.value, base64.b64decode(part.other + "=" * (-len(part.other) % 4)))
            elif part.kind == "script":
                gone = self.tell("JAVASCRIPT", "XFA", where, slot, short(part.value, 120), content=part.other.encode("utf-8", "surrogatepass"))
            elif part.kind == "image":
                gone = self.tell("FORM", "XFA_IMAGE", where, slot, part.value, forced=True)
            else:
                gone = self.tell(*FORM_PARTS[part.kind], where, slot, short(part.value, 120) if part.kind not in ("link", "href") else part.value, other=part.other)
            if gone:
                ranges.append((part.start, part.end))
            elif slot in self.bodies:
                new = self.bodies[slot]
                ranges.append((part.start, part.end))
                instead[part.start] = base64.b64encode(new) if part.kind == "image" else new.replace(b"&", b"&amp;").replace(b"<", b"&lt;").replace(b">", b"&gt;")
        if not ranges:
            return value
        out = []
        for (name, ref, stream), before, after in zip(packets, bodies, without(bodies, ranges, instead)):
            if len(packets) > 1 and after != before and not after.strip():
                self._pass(ref)
                continue
            if after != before:
                self.cleaned[ref.num] = Stream({k: x for k, x in stream.items() if k not in ("Filter", "DecodeParms", "Length")})
                self.cleaned[ref.num].raw = after
            out += [name, ref]
        if packets[0][0] is None:
            return value
        if isinstance(value, Ref):
            self.met.add(value.num)
        return out

    def _pass(self, value) -> None:
        """What only removed things lead to counts as met."""
        todo = [value]
        while todo:
            v = todo.pop()
            if isinstance(v, Ref):
                if v.num not in self.met and self.roles.get(v.num) != "page":
                    self.met.add(v.num)
                    todo.append(self.pdf.get(v))
            elif isinstance(v, list):
                todo += v
            elif isinstance(v, dict):
                todo += [x for k, x in v.items() if k not in ("Parent", "P")]

    # kinds

    def _catalog(self, d: dict, path: str, location: str, out: dict, skip: set[str]):
        version = d.get("Version")
        if isinstance(version, Name) and version > self.pdf.version:
            self.tell("STRUCTURE", "VERSION_UPGRADED", "document", value=version)
        if "OpenAction" in d:
            skip.add("OpenAction")
            target = self.pdf.resolve(d["OpenAction"])
            jump = isinstance(target, list) or (isinstance(target, dict) and target.get("S") == "GoTo" and "Next" not in target)
            where = "document open action"
            clean = self._value(d["OpenAction"], f"{path}/OpenAction", where) if isinstance(target, list) else self._slot(d["OpenAction"], f"{path}/OpenAction", where, "OPEN_ACTION", not jump)
            if clean is not GONE:
                out["OpenAction"] = clean
        if "Collection" in d and self.tell("EMBEDDED_FILE", "PORTFOLIO", "document", f"{path}/Collection"):
            skip.add("Collection")
            self._pass(d["Collection"])
        perms = self.pdf.resolve(d.get("Perms"))
        if isinstance(perms, dict):
            skip.add("Perms")
            for k, v in perms.items():
                if k in ("DocMDP", "UR", "UR3"):
                    self.tell("SIGNATURE", "CERTIFIED" if k == "DocMDP" else "USAGE_RIGHTS", "document")
            out["Perms"] = {k: self._value(v, f"{path}/Perms/{k}", "certification") for k, v in perms.items() if k not in ("UR", "UR3")}
            self._pass([v for k, v in perms.items() if k in ("UR", "UR3")])
        if isinstance(d.get("Names"), dict):
            skip.add("Names")
            out["Names"] = self._dict(d["Names"], f"{path}/Names", "document names", "names")
        if isinstance(d.get("AcroForm"), dict):
            skip.add("AcroForm")
            out["AcroForm"] = self._dict(d["AcroForm"], f"{path}/AcroForm", "form", "form")
        return "document" if "AA" in d else "document catalog"

    def _page(self, d: dict, path: str, location: str, out: dict, skip: set[str]):
        skip.add("Parent")
        if "Parent" in d:
            out["Parent"] = self._value(d["Parent"], path, "page tree")
        annots = d.get("Annots")
        listed = self.pdf.resolve(annots)
        if annots is not None and isinstance(listed, list):
            skip.add("Annots")
            if isinstance(annots, Ref):
                self.met.add(annots.num)
            kept = []
            often = Counter(map(id, listed)) if not self.remove and not self.bodies else {}
            if len(often) == len(listed):
                often = {}
            alike: dict[int, tuple[list[tuple], object]] = {}
            for i, a in enumerate(listed):
                where, slot = f"{location}, annotation {i + 1}", f"{path}/Annots[{i}]"
                if often and id(a) not in alike and often[id(a)] > 1 and type(a) is dict and self._kind(a, "") == "annotation" and _alone(a):
                    alike[id(a)] = self._anywhere(a)
                if often and id(a) in alike:
                    told, clean = alike[id(a)]
                    for category, detail, at, inside, below, (value, label, content, other, forced) in told:
                        self.items.append(_item(Item, (len(self.items), category, detail, where if at == PLACE else at.replace(PLACE, where), slot + below if inside else below, value, label, content, other, forced)))
                    if clean is not GONE:
                        kept.append(clean)
                    continue
                target = self.pdf.resolve(a)
                if not isinstance(target, dict) or self._kind(target, "") != "annotation":
                    if self.tell("CORRUPTED", "MALFORMED_OBJECT", where, slot, "not an annotation"):
                        self._pass(a)
                        continue
                    kept.append(self._value(a, slot, where))
                elif isinstance(a, Ref):
                    self.queue.append((a, where, ""))
                    kept.append(a)
                else:
                    clean = self._dict(a, slot, where, "")
                    if clean is not GONE:
                        kept.append(clean)
            out["Annots"] = kept
        elif annots is not None and listed is not None:
            skip.add("Annots")
            if not self.tell("CORRUPTED", "MALFORMED_OBJECT", f"{location} annotations", f"{path}/Annots"):
                out["Annots"] = self._value(annots, f"{path}/Annots", location)
        return location

    def _anywhere(self, a: dict) -> tuple[list[tuple], object]:
        """What is told of an annotation that leads nowhere, wherever it stands: (category, detail, place with a mark,
        whether the slot lies in the annotation's, the slot from there, the rest)."""
        before, self.items = self.items, []
        try:
            clean = self._dict(a, SLOT, PLACE, "")
            return [(*i[1:4], i.slot.startswith(SLOT), i.slot.removeprefix(SLOT), i[5:]) for i in self.items], clean
        finally:
            self.items = before

    def _names(self, d: dict, path: str, location: str, out: dict, skip: set[str]):
        skip.update(k for k in d if k in TREES)
        if "JavaScript" in d:
            kept = []
            for k, (name, value) in enumerate(self._tree(d["JavaScript"])):
                where, slot = f'document script "{short(text_of(name) or "")}"', f"{path}/JavaScript[{k}]"
                target = self.pdf.resolve(value)
                if not isinstance(target, dict) or self.pdf.resolve(target.get("S")) != "JavaScript":
                    gone = self.tell("CORRUPTED", "MALFORMED_OBJECT", where, f"{slot}#kind", "not a script")
                    clean = self._value(value, slot, where)
                    if gone:
                        self._pass(value)
                        continue
                else:
                    clean = self._slot(value, slot, where, "DOCUMENT", False)
                if clean is not GONE:
                    kept.append((name, clean))
            if kept:
                out["JavaScript"] = {"Names": _sorted_names(kept)}
        if "EmbeddedFiles" in d:
            kept = []
            for k, (name, value) in enumerate(self._tree(d["EmbeddedFiles"])):
                clean = self._files(value, f"{path}/EmbeddedFiles[{k}]", f'attachment "{short(text_of(name) or "")}"')
                if clean is not GONE:
                    kept.append((name, clean))
            if kept:
                out["EmbeddedFiles"] = {"Names": _sorted_names(kept)}
        if "XFAImages" in d:
            skip.add("XFAImages")
            kept = []
            form = self.pdf.resolve((self.pdf.resolve(self.root) or {}).get("AcroForm"))
            for k, (name, value) in enumerate(self._tree(d["XFAImages"])):
                if self._picture(name, value, f"{path}/XFAImages[{k}]", isinstance(form, dict) and "XFA" in form):
                    kept.append((name, value))
            if kept:
                out["XFAImages"] = {"Names": _sorted_names(kept)}
        for k, where in (("AlternatePresentations", "document"), ("Renditions", "document renditions")):
            if k in d:
                if self.tell(*TREES[k], where, f"{path}/{k}"):
                    self._pass(d[k])
                else:
                    out[k] = self._value(d[k], f"{path}/{k}", where)
        return "document names"

    def _picture(self, name: bytes, value, slot: str, shown: bool) -> bool:
        """Whether a picture that a form names stays."""
        key = text_of(name) or ""
        where, ref = f'XFA images, "{short(key)}"', self._last(value) if isinstance(value, Ref) else None
        stream = self.pdf.resolve(value)
        if ref is None or not isinstance(stream, Stream):
            gone = self.tell("CORRUPTED", "MALFORMED_OBJECT", where, slot, "not a stream")
        elif not shown:
            gone = self.tell("FORM", "XFA_IMAGE", where, slot, "no form shows it", forced=True)
        elif not self.pdf.can_decrypt(stream) or (plain := self.pdf.bytes_of(stream)) is None:
            gone = self.tell("FORM", "XFA_IMAGE", where, slot, "it can't be read", forced=True)
        else:
            gone = self.tell("FORM", "IMAGE", where, f"file:{ref.num}", key, "", plain)
        if gone:
            self._pass(value)
        else:
            self._value(value, slot, where)
        return not gone

    def _tree(self, value) -> list[tuple[bytes, object]]:
        """The entries of a name tree, whatever their keys; arrays that several nodes share are read once."""
        out, todo, seen, nodes = [], [value], set(), 0

        def once(v):
            """The array behind a node's entry, or None where it was read before."""
            while isinstance(v, Ref):
                if v.num in seen:
                    return None
                seen.add(v.num)
                self.met.add(v.num)
                v = self.pdf.get(v)
            return v if isinstance(v, list) else None

        while todo:
            nodes += 1
            if nodes > NODES:
                self.tell("CORRUPTED", "MALFORMED_OBJECT", "name tree", value="too many nodes")
                self.cut = True
                break
            v = todo.pop()
            if isinstance(v, Ref):
                if v.num in seen:
                    continue
                seen.add(v.num)
                self.met.add(v.num)
            node = self.pdf.resolve(v)
            if not isinstance(node, dict):
                continue
            names = once(node.get("Names"))
            if names is not None:
                for k, x in zip(names[::2], names[1::2]):
                    k = self.pdf.resolve(k)
                    if not isinstance(k, (bytes, Name)):
                        self.tell("CORRUPTED", "MALFORMED_OBJECT", "name tree", value="a key that is not a string")
                    out.append((k if isinstance(k, bytes) else k.encode("latin-1", "replace") if isinstance(k, Name) else b"", x))
            kids = once(node.get("Kids"))
            todo += reversed(kids) if kids is not None else []
        return out

    def _form(self, d: dict, path: str, location: str, out: dict, skip: set[str]):
        order = self.pdf.resolve(d.get("CO"))
        if isinstance(order, list):
            skip.add("CO")
            if isinstance(d["CO"], Ref):
                self.met.add(d["CO"].num)
            self.orders.append((f"{path}/CO", [r.num for r in order if isinstance(r, Ref)]))
            out["CO"] = [r for r in order if isinstance(r, Ref)]
            self.ordered = out
        return "form"

    def _order(self) -> None:
        """A calculation order: it keeps the fields whose calculations stay; where none does, it may go itself."""
        for slot, fields in self.orders:
            scripts = {n: self.calculations.get(n, []) for n in fields}
            every = [s for held in scripts.values() for s in held]
            gone = [s for s in every if s in self.remove]
            if every:
                told = self.tell("FORM", "ORDER", "form", slot, "\0".join(every))
                if gone:
                    kept = [r for r in self.ordered["CO"] if any(s not in self.remove for s in scripts.get(r.num, []))]
                    if kept or told:
                        self.ordered["CO"] = kept
                if not self.ordered["CO"]:
                    del self.ordered["CO"]

    def _bookmark(self, d: dict, path: str, location: str, out: dict, skip: set[str]):
        where = f'bookmark "{short(text_of(d.get("Title")) or "")}"'
        if "A" in d:
            skip.add("A")
            clean = self._slot(d["A"], f"{path}/A", where, "BOOKMARK", False)
            if clean is not GONE:
                out["A"] = clean
        return where

    def _field(self, d: dict, path: str, location: str, out: dict, skip: set[str]):
        where = f'field "{short(text_of(d.get("T")) or "")}"'
        self._form_part(d)
        if "A" in d:
            skip.add("A")
            clean = self._slot(d["A"], f"{path}/A", where, "FIELD", False)
            if clean is not GONE:
                out["A"] = clean
        return where

    def _form_part(self, d: dict) -> None:
        if "FT" in d or "T" in d:
            self.tell("FORM", "FIELDS", "form")
        if d.get("FT") == "Sig" and "V" in d:
            self.tell("SIGNATURE", "SIGNED", "form")
            self.signed = self.signed or self._signs_all(d["V"])

    def _signs_all(self, value) -> bool:
        """Whether a signature covers every byte of the file but its own /Contents, right behind that key."""
        sig = self.pdf.resolve(value)
        if not isinstance(sig, dict):
            return False
        covered, contents = self.pdf.resolve(sig.get("ByteRange")), self.pdf.resolve(sig.get("Contents"))
        if not isinstance(covered, list) or len(covered) != 4 or not all(type(x) is int and x >= 0 for x in covered) or not isinstance(contents, bytes):
            return False
        start, gap, end, rest = covered
        data = self.pdf.data
        fits = start == 0 and gap > 0 and end == gap + 2 + 2 * len(contents) and end + rest == len(data)
        return fits and re.search(rb"/Contents\s*<$", data[max(0, gap - 16) : gap + 1]) is not None and data[end - 1 : end] == b">"

    def _annotation(self, d: dict, path: str, location: str, out: dict, skip: set[str]):
        sub = self.pdf.resolve(d.get("Subtype"))
        num = int(path[4:]) if path[:4] == "obj:" and path[4:].isdigit() else -1
        placed = self.place.get(num)
        widget = sub == "Widget"
        where = location
        if widget and text_of(d.get("T")) is not None:
            where = f'field "{short(text_of(d["T"]))}"' + (f" on page {placed[1] + 1}" if placed else "")
        bad = None
        if sub in MEDIA:
            bad = ("MEDIA", MEDIA[sub])
        elif sub not in ALLOWED and not (sub == "FileAttachment" and "FS" in d):
            bad = ("ANNOTATION", "UNKNOWN_SUBTYPE")
        if bad and self.tell(*bad, where, path, str(sub or "none")):
            self._pass(d)
            return GONE
        if sub == "FileAttachment" and "FS" in d:
            skip.add("FS")
            clean = self._files(d["FS"], f"{path}/FS", where)
            if clean is GONE:
                return GONE
            out["FS"] = clean
        rect = self.pdf.resolve(d.get("Rect"))
        box = placed[2] if placed and placed[2] else None
        if ((sub == "Link" and "Dest" in d) or ((sub == "Link" or widget) and "A" in d)) and isinstance(rect, list) and len(rect) == 4:
            page = box or [0, 0, 612, 792]
            area, whole = abs((rect[2] - rect[0]) * (rect[3] - rect[1])), (page[2] - page[0]) * (page[3] - page[1])
            if whole > 0 and area / whole >= 0.5 and self.tell("LINK", "FULL_PAGE", where, path):
                self._pass(d)
                return GONE
        if widget:
            self._form_part(d)
        detail = "LINK" if sub == "Link" else "FIELD" if widget else "ANNOTATION"
        labels = (text_of(self.pdf.resolve(d.get("Contents"))), text_of(self.pdf.resolve(d.get("TU"))) if widget else None, self.alt.get(num))
        label = "\0".join(t[:LABEL] for t in labels if t)
        for k in ("A", "PA"):
            if k in d:
                skip.add(k)
                misled = bool(label) and self._misleads(d[k], f"{path}/{k}#label", where, label)
                clean = self._slot(d[k], f"{path}/{k}", where, detail, False)
                if misled:
                    self._pass(d[k])
                elif clean is not GONE:
                    out[k] = clean
        if "P" in d:
            skip.add("P")
            out["P"] = d["P"]
        return where

    def _misleads(self, value, slot: str, location: str, label: str) -> bool:
        """Tell what a label stands beside: the addresses of an action and of its whole chain."""
        todo, uris, seen = deque([value]), [], set()
        steps = 0
        while todo:
            steps += 1
            if steps > CHECKED:
                return self.tell("LINK", "TEXT_MISMATCH", location, slot, "action chain too long to check")
            v = todo.popleft()
            if isinstance(v, Ref):
                if v.num in seen:
                    continue
                seen.add(v.num)
                v = self.pdf.get(v)
            if isinstance(v, list):
                todo += v[: CHECKED + 1]
            elif isinstance(v, dict):
                if "Next" in v:
                    todo.append(v["Next"])
                if self.pdf.resolve(v.get("S")) == "URI":
                    uris += readings(self.pdf.resolve(v.get("URI")))
        return bool(uris) and self.tell("LINK", "LABEL", location, slot, "\0".join(uris), label)

    # actions

    def _triggers(self, value, path: str, location: str, owner: str):
        if isinstance(value, Ref):
            self.met.add(value.num)
        d = self.pdf.resolve(value)
        if not isinstance(d, dict):
            return GONE if d is None or self.tell("CORRUPTED", "MALFORMED_OBJECT", location, path, "not additional actions") else value
        if isinstance(value, Ref) and self._kind(d, self.roles.get(value.num, "")) not in ("any", "triggers"):
            if self.tell("CORRUPTED", "MALFORMED_OBJECT", location, path, "not additional actions"):
                return GONE
            return self._value(value, path, location)
        out = {}
        for k, v in d.items():
            trigger = TRIGGERS[owner].get(k) or (TRIGGERS["annotation"].get(k) if owner == "field" else None) or k
            if k == "C" and owner in ("field", "annotation") and path.startswith("obj:"):
                action = self.pdf.resolve(v)
                if isinstance(action, dict) and self.pdf.resolve(action.get("S")) == "JavaScript":
                    self.calculations.setdefault(int(re.match(r"obj:(-?\d+)", path)[1]), []).append(f"{path}/{k}")
            clean = self._slot(v, f"{path}/{k}", f"{location} {trigger} trigger", {"document": "DOCUMENT", "page": "PAGE", "field": "FIELD"}.get(owner, "ANNOTATION"), True)
            if clean is not GONE:
                out[k] = clean
        return out if out or not d else GONE

    def _slot(self, value, path: str, location: str, detail: str, triggered: bool, chain: frozenset[int] = frozenset()):
        """An action where an action belongs. It is written inline; loops in its chain are cut."""
        if value is None:
            return GONE
        if isinstance(value, Ref):
            if value.num in chain:
                self.lost = self.lost or location
                return GONE
            if len(chain) > LINKS:
                self.tell("CORRUPTED", "MALFORMED_OBJECT", location, path, "action chain too long")
                self.cut = True
                return GONE
            chain |= {value.num}
            self.met.add(value.num)
        d = self.pdf.resolve(value)
        kind = self.pdf.resolve(d.get("S")) if isinstance(d, dict) else None
        role = self._kind(d, self.roles.get(value.num, "") if isinstance(value, Ref) else "") if isinstance(d, dict) else ""
        if role != "action":
            unknown = kind is not None and kind not in KNOWN and role != "annotation"
            gone = self.tell(*(("ACTION", "UNKNOWN") if unknown else ("CORRUPTED", "MALFORMED_OBJECT")), location, path, str(kind) if unknown else "not an action")
            # it is walked where it has its place, whatever becomes of this reference
            clean = self._value(value, f"{path}!", location)
            return GONE if gone else clean
        if triggered and kind != "JavaScript":
            gone = self.tell("ACTION", "TRIGGERED", location, f"{path}!trigger", str(kind or "none"))
        else:
            gone = False
        clean = self._action(d, path, location, detail, chain, triggered)
        return GONE if gone else clean

    def _action(self, d: dict, path: str, location: str, detail: str, chain=frozenset(), triggered: bool = False, rest: bool = True):
        """The action without what goes, or GONE; without rest only its own keys are looked at."""
        kind = self.pdf.resolve(d.get("S"))
        gone = False
        if kind in ("JavaScript", "Rendition") and ("JS" in d or kind == "JavaScript"):
            script = self.pdf.resolve(d.get("JS"))
            text = text_of(self.pdf.bytes_of(script) if isinstance(script, Stream) else script)
            text = None if text is None and isinstance(script, Stream) else (text or "").replace("\0", "")
            gone = self.tell("JAVASCRIPT", "RENDITION" if kind == "Rendition" else detail, location, path, short(text or "", 120), content=None if text is None else text.encode("utf-8", "surrogatepass"))
        if kind == "Rendition":
            gone |= self.tell("MEDIA", "RENDITION", location, f"{path}!media")
        elif kind == "URI":
            first, *second = readings(self.pdf.resolve(d.get("URI")))
            gone = self.tell("LINK", "", location, path, first, other="".join(second))
        elif kind == "JavaScript" or kind in NAVIGATION or (kind == "Thread" and "F" not in d) or (kind == "Named" and d.get("N") in STEPS):
            pass
        elif kind == "Thread":
            gone = self.tell("ACTION", "REMOTE_GOTO", location, path)
        elif kind == "Named":
            gone = self.tell("ACTION", "NAMED", location, path, str(d.get("N") or ""))
        elif kind in ACTIONS:
            gone = self.tell(*ACTIONS[kind], location, path)
        else:
            gone = self.tell("ACTION", "UNKNOWN", location, path, str(kind or "none"))
        out = {}
        follow = d.get("Next")
        listed = self.pdf.resolve(follow)
        chained = [(f"{path}/Next[{i}]", v) for i, v in enumerate(listed)] if isinstance(listed, list) else [(f"{path}/Next", follow)] if follow is not None else []
        after = [x for at, v in chained if (x := self._slot(v, at, f"{location} (chained)", "CHAINED", triggered, frozenset(chain))) is not GONE]
        if gone:
            self._pass({k: v for k, v in d.items() if k != "Next" and (rest or k == "JS")})
            return GONE
        if after:
            out["Next"] = after if isinstance(listed, list) else after[0]
        for k, v in d.items():
            if k == "Next" or not (rest or k in ("S", "JS")):
                continue
            if k == "JS" and kind not in ("JavaScript", "Rendition") and self.tell("JAVASCRIPT", "UNATTACHED", location, f"{path}/JS"):
                self._pass(v)
                continue
            if k == "JS" and path in self.bodies:
                self._pass(v)
                out[k] = encode_text(self.bodies[path].decode("utf-8", "surrogatepass"))
                continue
            clean = self._value(v, f"{path}/{k}", location)
            if clean is not GONE:
                out[k] = clean
        return out

    def _also(self, d: dict, path: str, location: str, out: dict, skip: set[str]) -> None:
        """An object of another kind that an action's keys make one as well: it runs from any slot that points at it, so
        those keys get the rules of actions, and without them it runs no more."""
        kind = self.pdf.resolve(d.get("S"))
        if isinstance(d, Stream) or (d.get("Type") != "Action" and kind not in KNOWN):
            return
        clean = self._action(d, f"{path}!also", location, "ANNOTATION", rest=False)
        for k in ("S", "Next", "JS") if kind in ("JavaScript", "Rendition") else ("S", "Next"):
            skip.add(k)
            if clean is not GONE and k in clean:
                out[k] = clean[k]

    # files

    def _files(self, value, path: str, location: str):
        listed = self.pdf.resolve(value)
        if isinstance(listed, list):
            out = [x for i, v in enumerate(listed) if (x := self._file(v, f"{path}[{i}]", location)) is not GONE]
            return out or GONE
        return self._file(value, path, location)

    def _file(self, value, path: str, location: str, out: dict | None = None, skip: set[str] | None = None):
        if out is not None:  # reached as an object of this kind
            return self._file_parts(value, path, location, out, skip)
        if isinstance(value, bytes):
            return GONE if self.tell("EMBEDDED_FILE", "NO_PLUGIN", location, path, text_of(value) or "") else value
        d = self.pdf.resolve(value)
        if not isinstance(d, dict):
            return GONE if self.tell("CORRUPTED", "MALFORMED_OBJECT", location, path, "not a file specification") else value
        if isinstance(value, Ref):
            if value.num in self.seen:
                return value if value.num in self.kept else GONE
            self.seen.add(value.num)
            clean = self._dict(d, f"obj:{value.num}", location, "file")
            if clean is GONE:
                return GONE
            self.kept[value.num] = clean
            return value
        return self._dict(d, path, location, "file")

    def _file_parts(self, d: dict, path: str, location: str, out: dict, skip: set[str]):
        """Readers open different streams of /EF and show different names: a file stays only if each of its streams
        does, under each of its names."""
        names = list(dict.fromkeys(t for k in ("UF", "F", "Unix", "Mac", "DOS") if (t := text_of(self.pdf.resolve(d.get(k)))) is not None)) or [""]
        held = self.pdf.resolve(d.get("EF"))
        main = (held["UF"] if "UF" in held else held.get("F")) if isinstance(held, dict) else None
        gone = False
        if not isinstance(main, Ref):
            gone = self.tell("EMBEDDED_FILE", "NO_PLUGIN", location, path, names[0])
        elif not isinstance(self.pdf.resolve(main), Stream):
            gone = self.tell("CORRUPTED", "MALFORMED_OBJECT", location, path, "embedded file is not a stream")
        kept: dict = {}
        for k, v in (held.items() if isinstance(held, dict) else ()):
            stream = self.pdf.resolve(v)
            if isinstance(v, Ref) and isinstance(stream, Stream):
                gone |= any([self._decide(self._last(v), stream, name, location) for name in names])
                kept[k] = v
            elif v is not None and not self.tell("CORRUPTED", "MALFORMED_OBJECT", location, f"{path}/EF/{k}", "embedded file is not a stream"):
                kept[k] = v
        if gone:
            self._pass(d)
            return GONE
        if "RF" in d and self.tell("EMBEDDED_FILE", "NO_PLUGIN", location, f"{path}/RF", names[0]):
            skip.add("RF")
            self._pass(d["RF"])
        if isinstance(held, dict):
            skip.add("EF")
            if isinstance(d["EF"], Ref):
                self.met.add(d["EF"].num)
            out["EF"] = {k: self._value(v, f"{path}/EF/{k}", location) for k, v in kept.items()}
        return location

    def _last(self, ref: Ref) -> Ref:
        for _ in range(32):
            v = self.pdf.get(ref)
            if not isinstance(v, Ref):
                break
            ref = v
        return ref

    def _decide(self, ref: Ref, stream: Stream, name: str, location: str) -> bool:
        """Tell a stream of an attached file once, and once more for each further name; whether it is to go."""
        slot, declared = f"file:{ref.num}", str(self.pdf.resolve(stream.get("Subtype")) or "")
        if ref.num not in self.file_streams:
            self.file_streams.add(ref.num)
            self.told_files.add((ref.num, name))
            self.first_names[ref.num] = name
            if not self.pdf.can_decrypt(stream):
                self.tell("EMBEDDED_FILE", "NO_PLUGIN", location, slot, name, "encrypted", forced=True)
                return True
            plain = self.pdf.bytes_of(stream)
            if plain is None:
                return self.tell("EMBEDDED_FILE", "NO_PLUGIN", location, slot, name, "cannot decode")
            return self.tell("EMBEDDED_FILE", "", location, slot, name, declared, plain)
        first = self.first_names[ref.num]
        gone = slot in self.remove or not self.pdf.can_decrypt(stream)
        if name == first:
            return gone
        slot = f"{slot}!{name}"
        if (ref.num, name) in self.told_files:
            return gone or slot in self.remove
        self.told_files.add((ref.num, name))
        plain = self.pdf.bytes_of(stream)
        return self.tell("EMBEDDED_FILE", "NAME", location, slot, name, declared, (plain or b"")[:1024], first) or gone

    def _replaced(self, stream: Stream, body: bytes) -> Stream:
        out = Stream({k: v for k, v in stream.items() if k not in ("Filter", "DecodeParms", "F", "DP", "Length")} | {"Filter": Name("FlateDecode")})
        params = self.pdf.resolve(stream.get("Params"))
        if isinstance(params, dict):
            out["Params"] = {k: v for k, v in params.items() if k not in ("CheckSum", "Size")} | {"Size": len(body)}
        out.raw = zlib.compress(body)
        return out

    # the end

    def _after(self) -> None:
        self._order()
        if self.lost:
            self.tell("PROCESSING", "LOST", self.lost)
        if self.pdf.notes.escaped:
            self.tell("STRUCTURE", "ESCAPED_NAMES", "document", value=", ".join(list(self.pdf.notes.escaped)[:10]))
        loose = 0
        for num in self.pdf.live():
            ref = self.pdf.trailer.get("Encrypt")
            if num in self.seen or num in self.met or (isinstance(ref, Ref) and ref.num == num):
                continue
            value = self.pdf.get(Ref(num, 0))
            if value is None or isinstance(value, (bool, int, float)):
                continue
            if isinstance(value, dict) and ("Linearized" in value or (isinstance(value, Stream) and (value.get("Type") in ("XRef", "ObjStm") or ("Type" not in value and isinstance(value.get("S"), int))))):
                continue
            loose += 1
            if isinstance(value, dict) and ("JS" in value or value.get("S") == "JavaScript"):
                self.tell("JAVASCRIPT", "UNATTACHED", f"unreferenced object {num}")
        if loose:
            self.tell("STRUCTURE", "UNREFERENCED_OBJECTS", "document", value=str(loose))

    def content_lengths(self) -> list[int]:
        """For each page the bytes of its content, as the file holds them once decrypted; what no key opens adds nothing."""
        out = []
        for _, page, _ in self.pages:
            parts = self.pdf.resolve(page.get("Contents"))
            streams = [self.pdf.resolve(p) for p in parts] if isinstance(parts, list) else [parts]
            out.append(sum(len(s.raw) if s.size is None else s.size for s in streams if isinstance(s, Stream) and self.pdf.can_decrypt(s)))
        return out

    def write(self) -> bytes:
        """The document that is left: one revision, objects from 1, a classic table, nothing encrypted."""
        if not self.form_kept:
            self.catalog.pop("NeedsRendering", None)
        todo, number, order = deque([self.catalog]), {}, []
        values: dict[int, object] = {}
        root_num = self.root.num if isinstance(self.root, Ref) else 0
        number[root_num] = 1
        order.append(root_num)
        values[root_num] = self.catalog
        while todo:
            stack = [todo.popleft()]
            while stack:
                v = stack.pop()
                if isinstance(v, Ref):
                    if v.num not in number and v.num in self.kept:
                        number[v.num] = len(order) + 1
                        order.append(v.num)
                        values[v.num] = self.kept[v.num]
                        todo.append(self.kept[v.num])
                elif isinstance(v, list):
                    stack += reversed(v)
                elif isinstance(v, dict):
                    stack += reversed(list(v.values()))

        def moved(v):
            if isinstance(v, Ref):
                return Ref(number[v.num], 0) if v.num in number else None
            if isinstance(v, list):
                return [moved(x) for x in v]
            if isinstance(v, dict):
                return {k: moved(x) for k, x in v.items()}
            return v

        version = self.pdf.version or "1.7"
        out = bytearray(f"%PDF-{version}\n%âãÏÓ\n".encode("latin-1"))
        offsets = []
        bodies = [values[n] for n in order] + ([self.info] if self.info else [])
        for i, value in enumerate(bodies, 1):
            offsets.append(len(out))
            out += b"%d 0 obj\n" % i
            if isinstance(value, Stream):
                head = moved(value)
                names = [n for n, _ in chain_of(head)]
                if "Crypt" in names:
                    plain = self.pdf.bytes_of(value)
                    head = {k: x for k, x in head.items() if k not in ("Filter", "DecodeParms")}
                    value_raw = plain or b""
                else:
                    value_raw = value.raw
                out += write_value(head | {"Length": len(value_raw)}) + b"\nstream\n" + value_raw + b"\nendstream"
            else:
                out += write_value(moved(value))
            out += b"\nendobj\n"
        at = len(out)
        out += b"xref\n0 %d\n0000000000 65535 f \n" % (len(bodies) + 1)
        for o in offsets:
            out += b"%010d 00000 n \n" % o
        digest = hashlib.md5(bytes(out)).digest()
        trailer = {"Size": len(bodies) + 1, "Root": Ref(1, 0), "ID": [digest, digest]} | ({"Info": Ref(len(bodies), 0)} if self.info else {})
        out += b"trailer\n" + write_value(trailer) + b"\nstartxref\n%d\n%%%%EOF\n" % at
        return bytes(out)


def _area(box: list) -> float:
    return (box[2] - box[0]) * (box[3] - box[1])


def _sorted_names(pairs: list[tuple[bytes, object]]) -> list:
    return [x for pair in sorted(pairs, key=lambda p: p[0]) for x in pair]


def readings(raw) -> list[str]:
    """What readers take an address to be: a name is read with and without its slash, a string as UTF-8 or byte for byte."""
    if isinstance(raw, Name):
        return [f"/{raw}", str(raw)]
    if not isinstance(raw, bytes):
        return [""]
    try:
        return [raw.decode("utf-8")]
    except UnicodeDecodeError:
        return [raw.decode("latin-1")]
