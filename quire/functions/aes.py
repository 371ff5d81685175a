"""AES for use inside UDFs, where one file's keys and streams are handled at a time; columns of bytes go through Spark's own functions (``crypto``)."""

from __future__ import annotations

import numpy as np


def _boxes() -> tuple[list[int], list[int]]:
    power, log, x = [0] * 256, [0] * 256, 1
    for i in range(255):
        power[i], log[x] = x, i
        x ^= (x << 1) ^ (0x11B if x & 0x80 else 0)
        x &= 0xFF
    forward = []
    for v in range(256):
        b = power[(255 - log[v]) % 255] if v else 0
        r = 0x63
        for k in range(5):
            r ^= (b << k | b >> (8 - k)) & 0xFF
        forward.append(r)
    back = [0] * 256
    for i, v in enumerate(forward):
        back[v] = i
    return forward, back


def _times(a: int, b: int) -> int:
    out = 0
    while b:
        if b & 1:
            out ^= a
        a = (a << 1) ^ (0x11B if a & 0x80 else 0)
        b >>= 1
    return out


BOX, BACK = _boxes()
#: Substitution and column mixing in one, for each of a column's four places.
MIX = [[int.from_bytes(bytes(_times(BOX[v], m) for m in (2, 1, 1, 3)[-r:] + (2, 1, 1, 3)[:-r]), "big") for v in range(256)] for r in range(4)]
UNMIX = np.array([[[_times(v, m) for m in (14, 9, 13, 11)[-r:] + (14, 9, 13, 11)[:-r]] for v in range(256)] for r in range(4)], np.uint8)
NP_BACK = np.array(BACK, np.uint8)
#: The place that each byte of a block comes from when rows are shifted back.
SHIFTED_BACK = np.array([(i - 4 * (i % 4)) % 16 for i in range(16)])


def round_keys(key: bytes) -> list[int]:
    """The schedule as 32-bit words."""
    n = len(key) // 4
    if len(key) not in (16, 24, 32):
        raise ValueError("a key has 16, 24 or 32 bytes")
    words = [int.from_bytes(key[4 * i : 4 * i + 4], "big") for i in range(n)]
    constant = 1
    sub = lambda w: BOX[w >> 24] << 24 | BOX[w >> 16 & 255] << 16 | BOX[w >> 8 & 255] << 8 | BOX[w & 255]
    for i in range(n, 4 * (n + 7)):
        w = words[-1]
        if i % n == 0:
            w = sub((w << 8 | w >> 24) & 0xFFFFFFFF) ^ constant << 24
            constant = _times(constant, 2)
        elif n > 6 and i % n == 4:
            w = sub(w)
        words.append(words[-n] ^ w)
    return words


def encrypt_cbc(key: bytes, iv: bytes, data: bytes) -> bytes:
    """Whole blocks, without padding; each block waits for the one before."""
    if len(data) % 16:
        raise ValueError("data isn't whole blocks")
    keys = round_keys(key)
    m0, m1, m2, m3 = MIX
    last = len(keys) - 4
    out = bytearray()
    p, q, r, s = (int.from_bytes(iv[i : i + 4], "big") for i in (0, 4, 8, 12))
    for at in range(0, len(data), 16):
        a = p ^ int.from_bytes(data[at : at + 4], "big") ^ keys[0]
        b = q ^ int.from_bytes(data[at + 4 : at + 8], "big") ^ keys[1]
        c = r ^ int.from_bytes(data[at + 8 : at + 12], "big") ^ keys[2]
        d = s ^ int.from_bytes(data[at + 12 : at + 16], "big") ^ keys[3]
        for k in range(4, last, 4):
            a, b, c, d = (
                m0[a >> 24] ^ m1[b >> 16 & 255] ^ m2[c >> 8 & 255] ^ m3[d & 255] ^ keys[k],
                m0[b >> 24] ^ m1[c >> 16 & 255] ^ m2[d >> 8 & 255] ^ m3[a & 255] ^ keys[k + 1],
                m0[c >> 24] ^ m1[d >> 16 & 255] ^ m2[a >> 8 & 255] ^ m3[b & 255] ^ keys[k + 2],
                m0[d >> 24] ^ m1[a >> 16 & 255] ^ m2[b >> 8 & 255] ^ m3[c & 255] ^ keys[k + 3],
            )
        p = (BOX[a >> 24] << 24 | BOX[b >> 16 & 255] << 16 | BOX[c >> 8 & 255] << 8 | BOX[d & 255]) ^ keys[last]
        q = (BOX[b >> 24] << 24 | BOX[c >> 16 & 255] << 16 | BOX[d >> 8 & 255] << 8 | BOX[a & 255]) ^ keys[last + 1]
        r = (BOX[c >> 24] << 24 | BOX[d >> 16 & 255] << 16 | BOX[a >> 8 & 255] << 8 | BOX[b & 255]) ^ keys[last + 2]
        s = (BOX[d >> 24] << 24 | BOX[a >> 16 & 255] << 16 | BOX[b >> 8 & 255] << 8 | BOX[c & 255]) ^ keys[last + 3]
        out += (p << 96 | q << 64 | r << 32 | s).to_bytes(16, "big")
    return bytes(out)


def decrypt_blocks(key: bytes, data: bytes) -> np.ndarray:
    """All blocks at once, each for itself, as rows of sixteen bytes."""
    keys = np.array(round_keys(key), ">u4").view(np.uint8).reshape(-1, 16)
    state = np.frombuffer(data, np.uint8).reshape(-1, 16) ^ keys[-1]
    for k in range(len(keys) - 2, -1, -1):
        state = NP_BACK[state[:, SHIFTED_BACK]] ^ keys[k]
        if k:
            cells = state.reshape(-1, 4, 4)
            state = (UNMIX[0][cells[:, :, 0]] ^ UNMIX[1][cells[:, :, 1]] ^ UNMIX[2][cells[:, :, 2]] ^ UNMIX[3][cells[:, :, 3]]).reshape(-1, 16)
    return state


def decrypt_cbc(key: bytes, iv: bytes, data: bytes) -> bytes:
    """Whole blocks, without padding."""
    if not data:
        return b""
    before = np.frombuffer(iv + data[:-16], np.uint8).reshape(-1, 16)
    return (decrypt_blocks(key, data) ^ before).tobytes()


def encrypt_block(key: bytes, block: bytes) -> bytes:
    return encrypt_cbc(key, bytes(16), block)


def padded(data: bytes) -> bytes:
    n = 16 - len(data) % 16
    return data + bytes([n]) * n


def unpadded(data: bytes) -> bytes:
    n = data[-1] if data else 0
    return data[:-n] if 1 <= n <= 16 and data.endswith(bytes([n]) * n) else data


def seal(key: bytes, iv: bytes, data: bytes) -> bytes:
    """The initial vector, then the padded data."""
    return iv + encrypt_cbc(key, iv, padded(data))


def unseal(key: bytes, data: bytes) -> bytes:
    """What ``seal`` had; anything that isn't an initial vector and whole blocks comes back as it is."""
    if len(data) < 32 or len(data) % 16:
        return data
    return unpadded(decrypt_cbc(key, data[:16], data[16:]))
