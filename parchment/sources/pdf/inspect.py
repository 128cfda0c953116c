"""What one file's bytes say, as plain rows: the only step between a binary column and the findings tables."""

from __future__ import annotations

import time
from typing import NamedTuple

from parchment.sources.pdf.document import REASONS, Pdf, TimeUp, Unreadable
from parchment.sources.pdf.filters import TooLarge
from parchment.sources.pdf.values import SyntaxTrouble
from parchment.sources.pdf.walk import COUNTED, Item, Walk


class Limits(NamedTuple):
    """None: no limit. nesting: how deep a document may lie in attachments; seconds: of one document's run in the kernel."""

    objects: int | None = None
    decompressed: int = 1 << 28
    file_size: int | None = None
    nesting: int | None = None
    seconds: float | None = None


class Report(NamedTuple):
    version: str
    pages: int
    incomplete: bool
    items: list[Item]
    lengths: list[int]
    signed: bool
    output: bytes | None


def _security(pdf: Pdf) -> list[tuple[str, str]]:
    s = pdf.security
    if s is None:
        return []
    if s.status != "ok":
        return [("ENCRYPTED", {"password": "PASSWORD_REQUIRED", "certificate": "CERTIFICATE_HANDLER", "handler": "UNKNOWN_HANDLER", "filter": "UNKNOWN_CRYPT_FILTER"}[s.status])]
    out = [("ENCRYPTED", {"empty": "EMPTY_PASSWORD", "user": "USER_PASSWORD", "owner": "OWNER_PASSWORD", "none": "ATTACHMENTS_ONLY"}[s.used])]
    method = s.strings if s.method == "Identity" else s.method
    if method != "Identity":
        out.append(("ENCRYPTED", {"AES256": "AES_256", "AES128": "AES_128"}.get(method) or {40: "RC4_40", 128: "RC4_128"}.get(s.bits, "RC4_OTHER")))
    return out + ([] if s.metadata else [("ENCRYPTED", "METADATA_UNENCRYPTED")])


_TROUBLE = (Unreadable, SyntaxTrouble, ValueError, KeyError, IndexError, TypeError, AttributeError, MemoryError, RecursionError)


def inspect(data: bytes | None, passwords: list[str] | None = None, limits: Limits = Limits(), remove: frozenset[str] | None = None, strip_metadata: bool = False, bodies: dict[str, bytes] | None = None) -> Report:
    """Read, walk and report; with remove, also write what is left without those slots, and with `bodies` in theirs.

    Damage is a finding, never an error: only a programming mistake raises.
    """
    rows: list[Item] = []

    def tell(category: str, detail: str, location: str = "", value: object = "", forced: bool = False) -> None:
        rows.append(Item(len(rows), category, detail, location, "", str(value), "", None, "", forced))

    def stopped(version: str = "", pages: int = 0) -> Report:
        return Report(version, pages, True, rows, [], False, None)

    if not data:
        tell("CORRUPTED", "TRUNCATED")
        return stopped()
    if limits.file_size is not None and len(data) > limits.file_size:
        tell("LIMIT", "FILE_SIZE", value=len(data))
        return stopped()
    pdf = None
    deadline = None if limits.seconds is None else time.monotonic() + limits.seconds
    try:
        pdf = Pdf(bytes(data), passwords, limits.decompressed, limits.objects, deadline)
    except TimeUp:
        tell("LIMIT", "TIME")
    except TooLarge as e:
        tell("LIMIT", "OBJECT_COUNT" if e.args else "DECOMPRESSED_SIZE")
    except _TROUBLE as e:
        tell("CORRUPTED", "TRUNCATED" if b"%%EOF" not in data and b"%PDF-" in data[:1024] else "UNPARSEABLE", value=str(e)[:120])
    if pdf is None:
        return stopped()
    for category, detail in _security(pdf):
        tell(category, detail)
    if pdf.security is not None and pdf.security.status != "ok":
        return stopped(pdf.version)
    for there, detail, value in ((not pdf.has_header, "MISSING_HEADER", ""), (pdf.leading, "LEADING_BYTES", pdf.leading), (pdf.trailing, "TRAILING_BYTES", pdf.trailing), (pdf.issues["rebuilt"], "XREF_REBUILT", "")):
        if there:
            tell("CORRUPTED", detail, value=value)
    if pdf.issues["superseded"]:
        tell("STRUCTURE", "INCREMENTAL_UPDATES", value=pdf.issues["sections"])
    walk, incomplete, dead, hidden = None, False, 0, 0
    try:
        try:
            walk = Walk(pdf, remove or frozenset(), strip_metadata, bodies)
        except Unreadable:  # a row met on the way leads nowhere: rebuild, and begin again
            pdf.rebuild(passwords)
            tell("CORRUPTED", "XREF_REBUILT")
            walk = Walk(pdf, remove or frozenset(), strip_metadata, bodies)
        dead = pdf.dead_definitions() if not pdf.issues["superseded"] else 0
        hidden = pdf.dead_definitions(True) if walk.signed else 0
    except TimeUp:
        tell("LIMIT", "TIME")
        incomplete = True
    except TooLarge:
        tell("LIMIT", "DECOMPRESSED_SIZE")
        incomplete = True
    except _TROUBLE as e:
        tell("CORRUPTED", "UNPARSEABLE", value=str(e)[:120])
        incomplete = True
    if walk is not None:
        counts: dict[tuple[str, str], int] = {}
        plain = not rows and COUNTED.isdisjoint({i[1:3] for i in walk.items})
        rows += walk.items if plain else ()
        for item in () if plain else walk.items:
            if (kind := (item.category, item.detail)) in COUNTED:
                counts[kind] = counts.get(kind, 0) + 1
                if counts[kind] > 1:
                    continue
            rows.append(item if item.ordinal == len(rows) else item._replace(ordinal=len(rows)))
        if counts:
            rows[:] = [r._replace(value=str(counts[r.category, r.detail])) if (r.category, r.detail) in counts else r for r in rows]
        incomplete |= walk.cut
    for n, category, detail in ((dead, "STRUCTURE", "SHADOWED_OBJECTS"), (pdf.issues["length"], "CORRUPTED", "STREAM_LENGTH_WRONG"), (pdf.issues["malformed"], "CORRUPTED", "MALFORMED_OBJECT")):
        if n:
            tell(category, detail, value=n)
    for issue, (location, reason) in REASONS.items():
        # a rebuilt table has no rows to be wrong
        if (n := pdf.issues[issue]) and not (issue in ("offsets", "generations") and pdf.issues["rebuilt"]):
            tell("CORRUPTED", "MALFORMED_OBJECT", location, reason if issue == "direct_root" else f"{reason}: {n}", issue == "structural")
    if pdf.notes.repeated:
        tell("CORRUPTED", "MALFORMED_OBJECT", value="repeated dictionary keys: " + ", ".join(list(pdf.notes.repeated)[:10]))
    pages = len(walk.pages) if walk else 0
    if walk is not None and not pages:
        tell("CORRUPTED", "UNPARSEABLE", value="no pages")
        incomplete = True
    signed = walk is not None and walk.signed and not incomplete and not dead and not hidden and not pdf.issues["rebuilt"]
    output = walk.write() if walk is not None and remove is not None and not incomplete else None
    return Report(pdf.version, pages, incomplete, rows, walk.content_lengths() if walk else [], signed, output)
