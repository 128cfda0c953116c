"""Writes PDF files from objects: for tests, and for queries over documents that are synthesised from row keys."""

from __future__ import annotations

import hashlib
import zlib

from parchment.sources.pdf.crypto import PAD, rc4


class Builder:
    """Objects by number; a body is text, or (dictionary text, stream bytes)."""

    def __init__(self, version: str = "1.7"):
        self.version, self.objects = version, {}

    def put(self, num: int, body: str | tuple[str, bytes]) -> int:
        self.objects[num] = body
        return num

    def add(self, body: str | tuple[str, bytes]) -> int:
        return self.put(max(self.objects, default=0) + 1, body)

    @staticmethod
    def body(body: str | tuple[str, bytes], key: bytes | None = None, num: int = 0) -> bytes:
        if isinstance(body, str):
            return body.encode("latin-1")
        head, data = body
        if key is not None:
            data = rc4(hashlib.md5(key + num.to_bytes(3, "little") + b"\0\0").digest()[: min(16, len(key) + 5)], data)
        return f"<< {head} /Length {len(data)} >>\nstream\n".encode("latin-1") + data + b"\nendstream"

    def build(self, root: int = 1, trailer: str = "", table: str = "table", leading: bytes = b"", trailing: bytes = b"", header: bool = True, startxref: int | None = None, password: str | None = None, bits: int = 40) -> bytes:
        """table: table, stream or none. password encrypts streams with RC4; strings in bodies should be absent then."""
        key, objects = None, dict(self.objects)
        if password is not None:
            first_id, size, rounds = b"0123456789abcdef", bits // 8, 0 if bits == 40 else 50
            owner = hashlib.md5((password.encode() + PAD)[:32]).digest()
            for _ in range(rounds):
                owner = hashlib.md5(owner).digest()
            o = (password.encode() + PAD)[:32]
            for k in range(20 if rounds else 1):
                o = rc4(bytes(x ^ k for x in owner[:size]), o)
            key = hashlib.md5((password.encode() + PAD)[:32] + o + (0xFFFFFFFC).to_bytes(4, "little") + first_id).digest()
            for _ in range(rounds):
                key = hashlib.md5(key[:size]).digest()
            key = key[:size]
            u = rc4(key, PAD)
            if rounds:
                u = hashlib.md5(PAD + first_id).digest()
                for k in range(20):
                    u = rc4(bytes(x ^ k for x in key), u)
                u = u.ljust(32, b"\0")
            num = max(objects) + 1
            v, r = (1, 2) if bits == 40 else (2, 3)
            objects[num] = f"<< /Filter /Standard /V {v} /R {r} /Length {bits} /P -4 /O <{o.hex()}> /U <{u.hex()}> >>"
            trailer += f" /Encrypt {num} 0 R /ID [<{first_id.hex()}> <{first_id.hex()}>]"
        out = bytearray(leading)
        base = len(out)
        if header:
            out += f"%PDF-{self.version}\n".encode()
        offsets = {}
        for num, body in sorted(objects.items()):
            offsets[num] = len(out) - base
            out += b"%d 0 obj\n" % num + self.body(body, key, num) + b"\nendobj\n"
        at, size = len(out) - base, max(objects) + 1
        if table == "table":
            rows = b"".join(b"%010d 00000 n \n" % offsets[n] if n in offsets else b"0000000000 65535 f \n" for n in range(size))
            out += b"xref\n0 %d\n" % size + rows + f"trailer\n<< /Size {size} /Root {root} 0 R {trailer} >>\n".encode("latin-1")
        elif table == "stream":
            rows = b"".join((b"\1" if n in offsets or n == size else b"\0") + (at if n == size else offsets.get(n, 0)).to_bytes(4, "big") + b"\0\0" for n in range(size + 1))
            packed = zlib.compress(rows)
            out += b"%d 0 obj\n" % size + self.body((f"/Type /XRef /Size {size + 1} /W [1 4 2] /Root {root} 0 R /Filter /FlateDecode {trailer}", packed)) + b"\nendobj\n"
        else:
            out += f"trailer\n<< /Root {root} 0 R {trailer} >>\n".encode("latin-1")
        return bytes(out + b"startxref\n%d\n%%%%EOF\n" % (at if startxref is None else startxref) + trailing)


def one_page(catalog: str = "", page: str = "", objects: list[str | tuple[str, bytes]] = (), annots: list[str] = (), content: bytes = b"BT ET", info: str = "", pages: int = 1) -> Builder:
    """Catalog 1, page tree 2, pages from 10, content 5, further objects from 100."""
    out = Builder()
    kids = range(10, 10 + pages)
    out.put(1, f"<< /Type /Catalog /Pages 2 0 R {catalog} >>")
    out.put(2, f"<< /Type /Pages /Count {pages} /Kids [{' '.join(f'{k} 0 R' for k in kids)}] /MediaBox [0 0 612 792] >>")
    out.put(5, ("/Filter /FlateDecode", zlib.compress(content, 9)))
    if info:
        out.put(6, f"<< {info} >>")
    for k in kids:
        shown = f"/Annots [{' '.join(annots)}]" if annots and k == 10 else ""
        out.put(k, f"<< /Type /Page /Parent 2 0 R /Contents 5 0 R {shown} {page if k == 10 else ''} >>")
    for i, body in enumerate(objects):
        out.put(100 + i, body)
    return out


def link(action: str, rect: str = "[72 700 200 720]", extra: str = "") -> str:
    return f"<< /Type /Annot /Subtype /Link /Rect {rect} /A {action} {extra} >>"


def updated(pdf: bytes, objects: dict[int, str | tuple[str, bytes]], root: int = 1) -> bytes:
    """The file with a further revision that defines objects anew."""
    before = int(pdf[pdf.rfind(b"startxref") + 9 :].split()[0])
    out, offsets = bytearray(pdf), {}
    for num, body in objects.items():
        offsets[num] = len(out)
        out += b"%d 0 obj\n" % num + Builder.body(body) + b"\nendobj\n"
    at = len(out)
    out += b"xref\n" + b"".join(b"%d 1\n%010d 00000 n \n" % x for x in sorted(offsets.items()))
    return bytes(out + f"trailer\n<< /Size {max(offsets) + 1} /Root {root} 0 R /Prev {before} >>\nstartxref\n{at}\n%%EOF\n".encode())
