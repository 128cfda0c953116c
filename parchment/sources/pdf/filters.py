"""Stream filters, each with a bound on what it may produce."""

from __future__ import annotations

import re
import zlib

import numpy as np

from parchment.sources.pdf.values import Name

CHAIN, ROW = 32, 16 << 20
IMAGES = ("DCTDecode", "DCT", "JPXDecode", "JBIG2Decode", "CCITTFaxDecode", "CCF")


class TooLarge(Exception):
    """A filter produced more than the limit."""


class Undecodable(Exception):
    """A filter that is unknown, or bytes that it does not take."""


def chain_of(d: dict) -> list[tuple[str, dict]]:
    """(filter, parameters) in order; what is no name becomes an empty, undecodable one."""
    names, parms = d.get("Filter"), d.get("DecodeParms")
    names = names if isinstance(names, list) else [] if names is None else [names]
    parms = parms if isinstance(parms, list) else [parms]
    return [(str(n) if isinstance(n, Name) else "", p if isinstance(p, dict) else {}) for n, p in zip(names, [*parms, *[None] * len(names)])]


def _flate(data: bytes, limit: int) -> bytes:
    for window in (15, -15):
        unzip = zlib.decompressobj(window)
        out = bytearray()
        try:
            feed = data
            while feed:
                out += unzip.decompress(feed, 1 << 20)
                if len(out) > limit:
                    raise TooLarge
                feed = unzip.unconsumed_tail
            out += unzip.flush()
        except zlib.error:
            if not out and window == 15:
                continue  # perhaps the header is missing
        if len(out) > limit:
            raise TooLarge
        return bytes(out)
    raise Undecodable("no deflate data")


def _brotli(data: bytes, limit: int) -> bytes:
    """Brotli data, whole or not at all; Arrow's codec reads it piece by piece."""
    if not data:
        return b""
    import pyarrow as pa

    out = bytearray()
    try:
        with pa.input_stream(pa.BufferReader(data), compression="brotli") as stream:
            while piece := stream.read(1 << 20):
                out += piece
                if len(out) > limit:
                    raise TooLarge
    except (OSError, pa.ArrowException) as e:
        raise Undecodable("no brotli data") from e
    return bytes(out)


def _lzw(data: bytes, early: int, limit: int) -> bytes:
    table = [bytes([i]) for i in range(256)] + [b"", b""]
    out, width, bits, have, last = bytearray(), 9, 0, 0, b""
    for byte in data:
        bits, have = (bits << 8 | byte) & 0xFFFFFFFF, have + 8
        if have < width:
            continue
        code = bits >> (have - width) & ((1 << width) - 1)
        have -= width
        if code == 257:
            break
        if code == 256:
            del table[258:]
            width, last = 9, b""
            continue
        if code < len(table):
            entry = table[code]
        elif last and code == len(table):
            entry = last + last[:1]
        else:
            raise Undecodable("code beyond the table")
        out += entry
        if len(out) > limit:
            raise TooLarge
        if last and len(table) < 4096:
            table.append(last + entry[:1])
        last = entry
        size = len(table) + early
        width = 12 if size >= 2048 else 11 if size >= 1024 else 10 if size >= 512 else 9
    return bytes(out)


def _ascii85(data: bytes) -> bytes:
    data = re.sub(rb"[\x00\t\n\x0c\r ]", b"", data).removeprefix(b"<~").partition(b"~")[0]
    out, group = bytearray(), []
    for c in data:
        if c == 0x7A and not group:
            out += b"\0\0\0\0"
            continue
        if not 0x21 <= c <= 0x75:
            raise Undecodable("no base 85 digit")
        group.append(c - 0x21)
        if len(group) == 5:
            out += (sum(g * 85 ** (4 - i) for i, g in enumerate(group)) & 0xFFFFFFFF).to_bytes(4, "big")
            group = []
    if len(group) > 1:
        full = group + [84] * (5 - len(group))
        out += (sum(g * 85 ** (4 - i) for i, g in enumerate(full)) & 0xFFFFFFFF).to_bytes(4, "big")[: len(group) - 1]
    return bytes(out)


def _ascii_hex(data: bytes) -> bytes:
    data = re.sub(rb"[\x00\t\n\x0c\r ]", b"", data.partition(b">")[0])
    if re.search(rb"[^0-9a-fA-F]", data):
        raise Undecodable("no hexadecimal digit")
    return bytes.fromhex((data + b"0" * (len(data) % 2)).decode())


def _run_length(data: bytes, limit: int) -> bytes:
    out, at = bytearray(), 0
    while at < len(data) and (n := data[at]) != 128:
        if n < 128:
            out += data[at + 1 : at + 2 + n]
            at += n + 2
        else:
            out += data[at + 1 : at + 2] * (257 - n)
            at += 2
        if len(out) > limit:
            raise TooLarge
    return bytes(out)


def _predicted(data: bytes, parms: dict) -> bytes:
    kind = parms.get("Predictor", 1)
    if kind in (1, None):
        return data
    colors, bits, columns = (parms.get(k, n) for k, n in (("Colors", 1), ("BitsPerComponent", 8), ("Columns", 1)))
    if not all(isinstance(x, int) and x > 0 for x in (colors, bits, columns)) or bits not in (1, 2, 4, 8, 16):
        raise Undecodable("odd predictor")
    row, back = (colors * bits * columns + 7) // 8, max(1, colors * bits // 8)
    if row > ROW:
        raise Undecodable("row too long")
    if kind == 2:
        if bits != 8:
            raise Undecodable("a TIFF predictor below or above 8 bits")
        padded = np.frombuffer(data + b"\0" * (-len(data) % row), np.uint8).reshape(-1, columns, colors)
        return np.cumsum(padded, axis=1, dtype=np.uint8).tobytes()[: len(data)]
    if not 10 <= kind <= 15:
        raise Undecodable("unknown predictor")
    out, above = bytearray(), bytearray(row)
    for at in range(0, len(data), row + 1):
        tag, line = data[at], bytearray(data[at + 1 : at + 1 + row].ljust(row, b"\0"))
        if tag == 2:
            line = bytearray((np.frombuffer(bytes(line), np.uint8) + np.frombuffer(bytes(above), np.uint8)).tobytes())
        elif tag == 1:
            for i in range(back, row):
                line[i] = line[i] + line[i - back] & 255
        elif tag == 3:
            for i in range(row):
                line[i] = line[i] + ((line[i - back] if i >= back else 0) + above[i]) // 2 & 255
        elif tag == 4:
            for i in range(row):
                a, b, c = (line[i - back], above[i], above[i - back]) if i >= back else (0, above[i], 0)
                p = a + b - c
                near = min((abs(p - a), 0, a), (abs(p - b), 1, b), (abs(p - c), 2, c))[2]
                line[i] = line[i] + near & 255
        elif tag:
            raise Undecodable("unknown row filter")
        out += line
        above = line
    return bytes(out)


def decode(raw: bytes, d: dict, limit: int = 1 << 28) -> bytes:
    """The stream's plain bytes; each stage may produce `limit` bytes at most."""
    chain = chain_of(d)
    if len(chain) > CHAIN:
        raise Undecodable("too many filters")
    names, parms = d.get("Filter"), d.get("DecodeParms")
    if ("F" in d and d["F"] != names) or ("DP" in d and d["DP"] != parms) or (isinstance(parms, dict) if isinstance(names, list) else isinstance(parms, list) and bool(parms) and isinstance(parms[0], dict)):
        raise Undecodable("entries that readers take in different ways")
    if sum(name == "BrotliDecode" for name, _ in chain) > 1:
        raise Undecodable("more than one BrotliDecode")
    for name, parms in chain:
        if name in ("FlateDecode", "Fl"):
            raw = _predicted(_flate(raw, limit), parms)
        elif name in ("LZWDecode", "LZW"):
            raw = _predicted(_lzw(raw, parms.get("EarlyChange", 1), limit), parms)
        elif name in ("ASCII85Decode", "A85"):
            raw = _ascii85(raw)
        elif name in ("ASCIIHexDecode", "AHx"):
            raw = _ascii_hex(raw)
        elif name in ("RunLengthDecode", "RL"):
            raw = _run_length(raw, limit)
        elif name == "BrotliDecode":
            if parms.get("Predictor") not in (None, 1):
                raise Undecodable("a predictor that readers apply differently")
            raw = _brotli(raw, limit)
        elif name != "Crypt":
            raise Undecodable(f"filter {name or 'without a name'}")
        if len(raw) > limit:
            raise TooLarge
    return raw
