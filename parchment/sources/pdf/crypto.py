"""The standard security handler: keys from passwords, RC4 and AES in CBC mode."""

from __future__ import annotations

import hashlib
import stringprep
import unicodedata

# Fixed value: the padding of short passwords.
PAD = bytes.fromhex("28BF4E5E4E758A4164004E56FFFA01082E2E00B6D0683E802F0CA9FE6453697A")


def rc4(key: bytes, data: bytes) -> bytes:
    s, j = list(range(256)), 0
    for i in range(256):
        j = j + s[i] + key[i % len(key)] & 255
        s[i], s[j] = s[j], s[i]
    out, i, j = bytearray(len(data)), 0, 0
    for k, c in enumerate(data):
        i = i + 1 & 255
        j = j + s[i] & 255
        s[i], s[j] = s[j], s[i]
        out[k] = c ^ s[s[i] + s[j] & 255]
    return bytes(out)


def _double(a: int) -> int:
    return a << 1 ^ (0x11B if a & 0x80 else 0)


def _times(a: int, b: int) -> int:
    out = 0
    while b:
        out ^= a if b & 1 else 0
        a, b = _double(a), b >> 1
    return out


def _boxes() -> tuple[bytes, bytes]:
    """The substitution box from its rule: the inverse in GF(2^8), then an affine map."""
    box = bytearray(256)
    for x in range(256):
        inverse = next((y for y in range(256) if _times(x, y) == 1), 0)
        turned = inverse
        for k in range(1, 5):
            turned ^= (inverse << k | inverse >> (8 - k)) & 255
        box[x] = turned ^ 0x63
    back = bytearray(256)
    for x, y in enumerate(box):
        back[y] = x
    return bytes(box), bytes(back)


_box, _back = _boxes()
_by = {n: bytes(_times(x, n) for x in range(256)) for n in (2, 3, 9, 11, 13, 14)}


def _schedule(key: bytes) -> list[bytes]:
    n, rounds = len(key) // 4, len(key) // 4 + 6
    words, rcon = [key[4 * i : 4 * i + 4] for i in range(n)], 1
    for i in range(n, 4 * (rounds + 1)):
        w = words[-1]
        if i % n == 0:
            w = bytes(_box[x] for x in w[1:] + w[:1])
            w = bytes([w[0] ^ rcon]) + w[1:]
            rcon = _double(rcon)
        elif n > 6 and i % n == 4:
            w = bytes(_box[x] for x in w)
        words.append(bytes(a ^ b for a, b in zip(w, words[i - n])))
    return [b"".join(words[4 * i : 4 * i + 4]) for i in range(rounds + 1)]


def _xor(a: bytes, b: bytes) -> bytes:
    return bytes(x ^ y for x, y in zip(a, b))


_shift = [0, 5, 10, 15, 4, 9, 14, 3, 8, 13, 2, 7, 12, 1, 6, 11]
_unshift = [_shift.index(i) for i in range(16)]


def _mix(s: bytes, a: bytes, b: bytes, c: bytes | None, d: bytes | None) -> bytes:
    out = bytearray(16)
    for k in range(0, 16, 4):
        for i in range(4):
            w, x, y, z = (s[k + (i + j) % 4] for j in range(4))
            out[k + i] = a[w] ^ b[x] ^ (c[y] if c else y) ^ (d[z] if d else z)
    return bytes(out)


def _encrypt_block(keys: list[bytes], block: bytes) -> bytes:
    s = _xor(block, keys[0])
    for k in keys[1:-1]:
        s = bytes(_box[s[i]] for i in _shift)
        s = _xor(_mix(s, _by[2], _by[3], None, None), k)
    return _xor(bytes(_box[s[i]] for i in _shift), keys[-1])


def _decrypt_block(keys: list[bytes], block: bytes) -> bytes:
    s = _xor(block, keys[-1])
    for k in reversed(keys[1:-1]):
        s = _xor(bytes(_back[s[i]] for i in _unshift), k)
        s = _mix(s, _by[14], _by[11], _by[13], _by[9])
    return _xor(bytes(_back[s[i]] for i in _unshift), keys[0])


def aes_cbc_encrypt(key: bytes, iv: bytes, data: bytes) -> bytes:
    """Without padding: data is whole blocks."""
    keys, out = _schedule(key), []
    for at in range(0, len(data), 16):
        iv = _encrypt_block(keys, _xor(data[at : at + 16], iv))
        out.append(iv)
    return b"".join(out)


def aes_cbc_decrypt(key: bytes, iv: bytes, data: bytes) -> bytes:
    keys, out = _schedule(key), []
    for at in range(0, len(data) // 16 * 16, 16):
        block = data[at : at + 16]
        out.append(_xor(_decrypt_block(keys, block), iv))
        iv = block
    return b"".join(out)


def unwrapped(key: bytes, data: bytes) -> bytes:
    """Data with its vector before it; padding that is none stays."""
    if len(data) < 32:
        return b""
    out = aes_cbc_decrypt(key, data[:16], data[16:])
    n = out[-1] if out else 0
    return out[:-n] if 1 <= n <= 16 and out.endswith(bytes([n]) * n) else out


def hash_r6(password: bytes, salt: bytes, extra: bytes = b"") -> bytes:
    k = hashlib.sha256(password + salt + extra).digest()
    n = 0
    while True:
        block = (password + k + extra) * 64
        e = aes_cbc_encrypt(k[:16], k[16:32], block)
        k = (hashlib.sha256, hashlib.sha384, hashlib.sha512)[sum(e[:16]) % 3](e).digest()
        n += 1
        if n >= 64 and e[-1] <= n - 32:
            return k[:32]


METHODS = {"V2": "RC4", "AESV2": "AES128", "AESV3": "AES256", "None": "Identity"}


class Security:
    """status is ok, password, certificate, handler or filter; used is empty, user, owner, or none where only attached
    files are encrypted and no password opens them. key is None where it is not known."""

    def __init__(self, d: dict, first_id: bytes, passwords: list[str]):
        self.status, self.used, self.key, self.method, self.bits = "ok", "", None, "RC4", 40
        self.strings = self.files = "RC4"
        if d.get("Filter") != "Standard":
            self.status = "certificate" if d.get("Filter") == "Adobe.PubSec" else "handler"
            return
        version, revision = d.get("V", 0), d.get("R", 0)
        self.version = version
        self.metadata = version < 4 or d.get("EncryptMetadata") is not False
        self.named: dict[str, str | None] = {"Identity": "Identity"}
        held = d.get("CF") if isinstance(d.get("CF"), dict) else {}
        for name, one in held.items():
            if isinstance(one, dict):
                self.named[name] = METHODS.get(one.get("CFM", "None"))
        if version >= 4:
            self.method = self.named.get(d.get("StmF", "Identity"))
            self.strings = self.named.get(d.get("StrF", "Identity"))
            self.files = self.named.get(d["EFF"]) if isinstance(d.get("EFF"), str) else self.method
            if None in (self.method, self.strings, self.files):
                self.status = "filter"
                return
        self.bits = 256 if revision >= 5 else 40 if version == 1 else 128 if version >= 4 else d.get("Length", 40)
        if revision not in (2, 3, 4, 5, 6) or self.bits % 8 or not 40 <= self.bits <= 256:
            self.status = "filter"
            return
        for password in dict.fromkeys([*passwords, ""]):
            for used, key in self._keys(d, first_id, password, revision):
                self.key, self.used = key, "empty" if used == "user" and password == "" else used
                return
        filed = held.get(d.get("EFF", ""))
        if version >= 4 and not any(passwords) and self.method == self.strings == "Identity" and isinstance(filed, dict) and filed.get("AuthEvent") == "EFOpen":
            self.used = "none"
            return
        self.status = "password"

    def method_for(self, stream: dict) -> str:
        """How a stream is encrypted: its own /Crypt filter counts from version 4 on; unknown names encrypt nothing."""
        kind = stream.get("Type")
        if kind == "XRef" or (kind == "Metadata" and not self.metadata):
            return "Identity"
        names = stream.get("Filter")
        names = names if isinstance(names, list) else [names]
        if self.version >= 4 and "Crypt" in names:
            parms = stream.get("DecodeParms")
            if isinstance(parms, list):
                parms = parms[names.index("Crypt")] if names.index("Crypt") < len(parms) else None
            return self.named.get(parms.get("Name", "Identity") if isinstance(parms, dict) else "Identity") or "Identity"
        return self.files if kind == "EmbeddedFile" else self.method

    def plain_size(self, stream, ref, method: str) -> int | None:
        """The number of bytes a stream decrypts to, where that is known without decrypting all of it."""
        if method == "RC4" or stream.size is None or stream.size < 32 or stream.size % 16:
            return stream.size if method == "RC4" else None
        raw = stream.raw
        last = aes_cbc_decrypt(self._object_key(*ref, method), raw[-32:-16], raw[-16:])
        n = last[-1]
        return len(raw) - 16 - (n if 1 <= n <= 16 and last.endswith(bytes([n]) * n) else 0)

    def _keys(self, d: dict, first_id: bytes, password: str, revision: int):
        o, u = d.get("O", b""), d.get("U", b"")
        if revision >= 5:
            digest = hash_r6 if revision == 6 else lambda p, s, x=b"": hashlib.sha256(p + s + x).digest()
            # a password as the standard prepares it, as it is normalised without that, and as it is typed
            forms = (prepared(password), unicodedata.normalize("NFKC", password), password) if revision == 6 else (password,)
            for form in dict.fromkeys(f for f in forms if f is not None):
                raw = form.encode("utf-8", "surrogatepass")[:127]
                if digest(raw, u[32:40]) == u[:32]:
                    yield "user", aes_cbc_decrypt(digest(raw, u[40:48]), bytes(16), d.get("UE", b"")[:32])
                if digest(raw, o[32:40], u[:48]) == o[:32]:
                    yield "owner", aes_cbc_decrypt(digest(raw, o[40:48], u[:48]), bytes(16), d.get("OE", b"")[:32])
            return
        size = 5 if revision == 2 else self.bits // 8
        raw = password.encode("latin-1", "replace")

        def user_key(p: bytes) -> bytes | None:
            data = (p + PAD)[:32] + o[:32] + (d.get("P", 0) & 0xFFFFFFFF).to_bytes(4, "little") + first_id
            key = hashlib.md5(data + (b"\xff" * 4 if revision >= 4 and not self.metadata else b"")).digest()
            for _ in range(50 if revision >= 3 else 0):
                key = hashlib.md5(key[:size]).digest()
            key = key[:size]
            if revision == 2:
                return key if rc4(key, PAD) == u[:32] else None
            check = rc4(key, hashlib.md5(PAD + first_id).digest())
            for k in range(1, 20):
                check = rc4(bytes(x ^ k for x in key), check)
            return key if check == u[:16] else None

        if key := user_key(raw):
            yield "user", key
        owner = hashlib.md5((raw + PAD)[:32]).digest()
        for _ in range(50 if revision >= 3 else 0):
            owner = hashlib.md5(owner).digest()
        owner = owner[:size]
        guess = o[:32]
        for k in range(19 if revision >= 3 else 0, -1, -1):
            guess = rc4(bytes(x ^ k for x in owner), guess)
        if key := user_key(guess):
            yield "owner", key

    def _object_key(self, num: int, gen: int, method: str) -> bytes:
        if method == "AES256":
            return self.key
        salt = (num & 0xFFFFFF).to_bytes(3, "little") + (gen & 0xFFFF).to_bytes(2, "little") + (b"sAlT" if method == "AES128" else b"")
        return hashlib.md5(self.key + salt).digest()[: min(16, len(self.key) + 5)]

    def decrypt(self, data: bytes, num: int, gen: int, method: str | None = None) -> bytes:
        """A string, or with its method a stream, of object num; without a key it stays as it is."""
        method = method or self.strings
        if method == "Identity" or self.key is None:
            return data
        key = self._object_key(num, gen, method)
        return rc4(key, data) if method == "RC4" else unwrapped(key, data)


def prepared(password: str) -> str | None:
    """The password as SASLprep (RFC 4013) leaves it, or None where it refuses it."""
    text = "".join(" " if stringprep.in_table_c12(c) else c for c in password if not stringprep.in_table_b1(c))
    text = unicodedata.ucd_3_2_0.normalize("NFKC", text)
    refused = (stringprep.in_table_c12, stringprep.in_table_c21_c22, stringprep.in_table_c3, stringprep.in_table_c4, stringprep.in_table_c5, stringprep.in_table_c6, stringprep.in_table_c7, stringprep.in_table_c8, stringprep.in_table_c9)
    if any(f(c) for c in text for f in refused):
        return None
    if any(map(stringprep.in_table_d1, text)) and (any(map(stringprep.in_table_d2, text)) or not (stringprep.in_table_d1(text[0]) and stringprep.in_table_d1(text[-1]))):
        return None
    return text
