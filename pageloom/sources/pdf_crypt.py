"""The standard security handler of PDF files that open without a password: RC4 and AES of 40 to 128 bits."""

from __future__ import annotations

import hashlib
import struct

#: Fixed value: the padding of passwords.
PAD = bytes.fromhex("28BF4E5E4E758A4164004E56FFFA01082E2E00B6D0683E802F0CA9FE6453697A")


def rc4(key: bytes, data: bytes) -> bytes:
    s, j = list(range(256)), 0
    for i in range(256):
        j = (j + s[i] + key[i % len(key)]) & 255
        s[i], s[j] = s[j], s[i]
    out, i, j = bytearray(len(data)), 0, 0
    for k, b in enumerate(data):
        i = (i + 1) & 255
        j = (j + s[i]) & 255
        s[i], s[j] = s[j], s[i]
        out[k] = b ^ s[(s[i] + s[j]) & 255]
    return bytes(out)


def _product(a: int, b: int) -> int:
    """In the field of 256 elements."""
    out = 0
    while b:
        out ^= a * (b & 1)
        a = (a << 1) ^ (0x11B if a & 0x80 else 0)
        b >>= 1
    return out


def _box() -> list[int]:
    """The substitution: the inverse in the field, then an affine map of its bits."""
    box = []
    for x in range(256):
        inverse = next((y for y in range(256) if _product(x, y) == 1), 0)
        turned = inverse
        for k in range(1, 5):
            turned ^= (inverse << k | inverse >> (8 - k)) & 255
        box.append(turned ^ 0x63)
    return box


_TABLES: dict[str, list] = {}


def _tables() -> dict[str, list]:
    if not _TABLES:
        box = _box()
        _TABLES["box"] = box
        _TABLES["back"] = [box.index(x) for x in range(256)]
        for f in (9, 11, 13, 14):
            _TABLES[str(f)] = [_product(f, x) for x in range(256)]
    return _TABLES


def _round_keys(key: bytes) -> list[bytes]:
    box, words, factor = _tables()["box"], [key[k : k + 4] for k in range(0, len(key), 4)], 1
    n = len(words)
    for k in range(n, 4 * (n + 7)):
        w = words[-1]
        if k % n == 0:
            w = bytes([box[w[1]] ^ factor, box[w[2]], box[w[3]], box[w[0]]])
            factor = _product(factor, 2)
        elif n > 6 and k % n == 4:
            w = bytes(box[x] for x in w)
        words.append(bytes(a ^ b for a, b in zip(words[k - n], w, strict=True)))
    return [b"".join(words[k : k + 4]) for k in range(0, len(words), 4)]


def aes_cbc(key: bytes, data: bytes) -> bytes:
    """The plain text of an initial vector and blocks, without its padding; a broken last block is left out."""
    t, keys, out = _tables(), _round_keys(key), bytearray()
    back, m9, m11, m13, m14 = t["back"], t["9"], t["11"], t["13"], t["14"]
    before = data[:16]
    for at in range(16, len(data) - 15, 16):
        block = data[at : at + 16]
        s = [a ^ b for a, b in zip(block, keys[-1], strict=True)]
        for k in range(len(keys) - 2, -1, -1):
            # rows shift back, bytes are put back, the round key is added and, but for the last, columns are unmixed
            s = [back[s[(c - 4 * (c % 4)) % 16]] ^ keys[k][c] for c in range(16)]
            if k:
                s = [m14[s[c]] ^ m11[s[c - c % 4 + (c + 1) % 4]] ^ m13[s[c - c % 4 + (c + 2) % 4]] ^ m9[s[c - c % 4 + (c + 3) % 4]] for c in range(16)]
        out += bytes(a ^ b for a, b in zip(s, before, strict=True))
        before = block
    return bytes(out[: -out[-1]]) if out and 1 <= out[-1] <= 16 else bytes(out)


class Cipher:
    """Decrypts strings and streams of a file by the number of their object."""

    def __init__(self, spec: dict, file_id: bytes):
        version, revision = int(spec.get("V", 0)), int(spec.get("R", 0))
        if str(spec.get("Filter")) != "Standard" or version not in (1, 2, 4):
            raise ValueError("the file is encrypted in a way that is not read")
        self.size = 5 if revision < 3 else int(spec.get("Length", 128 if version == 4 else 40)) // 8
        known = spec.get("CF") or {}
        kind = lambda use: str((known.get(str(spec.get(use, "Identity"))) or {}).get("CFM", "None")) if version == 4 else "V2"
        self.kinds = {"stream": kind("StmF"), "string": kind("StrF")}
        seed = PAD + spec["O"][:32] + struct.pack("<i", (int(spec["P"]) + 2**31) % 2**32 - 2**31) + file_id
        if revision >= 4 and spec.get("EncryptMetadata") is False:
            seed += b"\xff" * 4
        key = hashlib.md5(seed).digest()
        for _ in range(50 if revision >= 3 else 0):
            key = hashlib.md5(key[: self.size]).digest()
        self.key = key[: self.size]
        if revision < 3:
            right = rc4(self.key, PAD) == spec["U"]
        else:
            proof = hashlib.md5(PAD + file_id).digest()
            for k in range(20):
                proof = rc4(bytes(b ^ k for b in self.key), proof)
            right = proof == spec["U"][:16]
        if not right:
            raise ValueError("the file needs a password")

    def plain(self, data: bytes, number: int, generation: int, what: str) -> bytes:
        kind = self.kinds[what]
        if kind not in ("V2", "AESV2"):
            return data
        own = self.key + struct.pack("<I", number)[:3] + struct.pack("<I", generation)[:2]
        own = hashlib.md5(own + b"sAlT" * (kind == "AESV2")).digest()[: min(len(self.key) + 5, 16)]
        return rc4(own, data) if kind == "V2" else aes_cbc(own, data)
