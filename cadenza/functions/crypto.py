"""AES on sample payloads. Spark has CBC with PKCS and ECB built in; the rest is composed from these.

CTR: the keystream is ECB over counter blocks. CBC without padding: one block is appended that decrypts to
a full block of padding, so the built-in removes it again. Pattern schemes gather the encrypted blocks of a
sample in Python, a batch at a time, with the AES of the JVM left out: they use the block cipher below.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from ..errors import InputError, EngineError

BLOCK = 16


# ---- in the JVM


def cbc_pkcs7(data: Column, key: Column, iv: Column) -> Column:
    return F.aes_decrypt(F.concat(iv, data), key, F.lit("CBC"), F.lit("PKCS"))


def hls_aes128(data: Column, key: Column, iv: Column) -> Column:
    """A whole HLS segment; raises where key, IV or length can't be right."""
    ok = (F.octet_length(key) == 16) & (F.octet_length(iv) == 16) & (F.octet_length(data) > 0) & (F.octet_length(data) % BLOCK == 0)
    return F.when(ok, cbc_pkcs7(data, key, iv)).otherwise(F.raise_error(F.lit("AES-128 segment needs 16-byte key and IV and whole blocks")).cast("binary"))


def implicit_iv(sequence: Column) -> Column:
    """16 bytes big-endian of a playlist's sequence number."""
    return F.unhex(F.lpad(F.hex(sequence.cast("bigint")), 32, "0"))


# ---- a block cipher in numpy (FIPS 197), for patterns


def _sbox() -> np.ndarray:
    box = np.zeros(256, np.uint8)
    p = q = 1
    while True:  # p runs through all non-zero elements, q through their inverses
        p ^= ((p << 1) & 0xFF) ^ (0x1B if p & 0x80 else 0)
        for shift in (1, 2, 4):
            q ^= q << shift
        q &= 0xFF
        q ^= 0x09 if q & 0x80 else 0
        rot = lambda n: ((q << n) | (q >> (8 - n))) & 0xFF  # noqa: B023, E731
        box[p] = q ^ rot(1) ^ rot(2) ^ rot(3) ^ rot(4) ^ 0x63
        if p == 1:
            break
    box[0] = 0x63
    return box


SBOX = _sbox()
INVERSE = np.argsort(SBOX).astype(np.uint8)
_double = np.array([((x << 1) & 0xFF) ^ (0x1B if x & 0x80 else 0) for x in range(256)], np.uint8)


def _times(n: int) -> np.ndarray:
    out, power = np.zeros(256, np.uint8), np.arange(256, dtype=np.uint8)
    while n:
        out = out ^ power if n & 1 else out
        power, n = _double[power], n >> 1
    return out


def _words(box: np.ndarray, factors: tuple[int, int, int, int]) -> list[np.ndarray]:
    """Per row of the state, what a byte there adds to its column: box and column mixing in one lookup."""
    rows = np.stack([box if f == 1 else _times(f)[box] for f in factors], 1)
    return [np.ascontiguousarray(np.roll(rows, r, axis=1)).view(np.uint32).ravel() for r in range(4)]


_FORWARD = _words(SBOX, (2, 1, 1, 3))
_BACKWARD = _words(INVERSE, (14, 9, 13, 11))
_MIX_ONLY = _words(np.arange(256, dtype=np.uint8), (14, 9, 13, 11))
#: Byte (row r, column c) is at 4 c + r; encryption moves row r by r columns to the left, decryption to the right.
_SHIFT = [[4 * ((c + r) % 4) + r for r in range(4)] for c in range(4)]
_UNSHIFT = [[4 * ((c - r) % 4) + r for r in range(4)] for c in range(4)]


@lru_cache(maxsize=64)
def _round_keys(key: bytes) -> np.ndarray:
    if len(key) not in (16, 24, 32):
        raise InputError.bad("AES keys have 16, 24 or 32 bytes")
    words, n, rcon = [key[i : i + 4] for i in range(0, len(key), 4)], len(key) // 4, 1
    while len(words) < 4 * (n + 7):
        w = words[-1]
        if len(words) % n == 0:
            w = bytes(SBOX[list(w[1:] + w[:1])])
            w = bytes([w[0] ^ rcon]) + w[1:]
            rcon = int(_double[rcon])
        elif n > 6 and len(words) % n == 4:
            w = bytes(SBOX[list(w)])
        words.append(bytes(a ^ b for a, b in zip(w, words[-n], strict=True)))
    return np.frombuffer(b"".join(words), np.uint8).reshape(-1, 16)


def _rounds(keys: np.ndarray, blocks: np.ndarray, tables: list[np.ndarray], box: np.ndarray, places: list[list[int]]) -> np.ndarray:
    """All rounds over n x 16 blocks; the state is kept with a contiguous row for each of the 16 bytes."""
    s = np.ascontiguousarray((blocks ^ keys[0]).T)
    for k in keys[1:-1]:
        key = np.ascontiguousarray(k).view(np.uint32)
        w = np.stack([tables[0][s[p[0]]] ^ tables[1][s[p[1]]] ^ tables[2][s[p[2]]] ^ tables[3][s[p[3]]] ^ key[c] for c, p in enumerate(places)])
        s = np.ascontiguousarray(w.view(np.uint8).reshape(4, -1, 4).transpose(0, 2, 1)).reshape(16, -1)
    return np.ascontiguousarray(box[s[[x for p in places for x in p]]].T) ^ keys[-1]


def encrypt_blocks(key: bytes, blocks: np.ndarray) -> np.ndarray:
    return _rounds(_round_keys(key), blocks, _FORWARD, SBOX, _SHIFT)


@lru_cache(maxsize=64)
def _inverse_keys(key: bytes) -> np.ndarray:
    """Round keys from last to first, the inner ones mixed, so that decryption has the rounds of encryption."""
    k = _round_keys(key)[::-1].copy()
    for i in range(1, len(k) - 1):
        b = k[i].reshape(4, 4)
        k[i] = (_MIX_ONLY[0][b[:, 0]] ^ _MIX_ONLY[1][b[:, 1]] ^ _MIX_ONLY[2][b[:, 2]] ^ _MIX_ONLY[3][b[:, 3]]).view(np.uint8)
    return k


def decrypt_blocks(key: bytes, blocks: np.ndarray) -> np.ndarray:
    return _rounds(_inverse_keys(key), blocks, _BACKWARD, INVERSE, _UNSHIFT)


def _as_blocks(data: bytes) -> np.ndarray:
    return np.frombuffer(data, np.uint8).reshape(-1, BLOCK)


def ctr(key: bytes, counter: bytes, data: bytes) -> bytes:
    """AES-CTR with a 64-bit counter in the low half of the 16 bytes; it must not run over."""
    if not data:
        return b""
    n = -(-len(data) // BLOCK)
    start = int.from_bytes(counter[8:], "big")
    if start + n - 1 >= 1 << 64:
        raise InputError.bad("the CTR block counter runs over")
    blocks = np.empty((n, 2), ">u8")
    blocks[:, 0] = int.from_bytes(counter[:8], "big")
    blocks[:, 1] = np.uint64(start) + np.arange(n, dtype=np.uint64)
    stream = encrypt_blocks(key, blocks.view(np.uint8).reshape(n, BLOCK)).reshape(-1)[: len(data)]
    return (np.frombuffer(data, np.uint8) ^ stream).tobytes()


def cbc(key: bytes, iv: bytes, data: bytes, encrypt: bool = False) -> bytes:
    """AES-CBC over whole blocks, no padding."""
    if len(data) % BLOCK:
        raise InputError.bad("CBC needs whole blocks")
    if not data:
        return b""
    if not encrypt:
        blocks = _as_blocks(data)
        return (decrypt_blocks(key, blocks) ^ np.vstack([_as_blocks(iv), blocks[:-1]])).tobytes()
    out, last = [], _as_blocks(iv)
    for block in _as_blocks(data):
        last = encrypt_blocks(key, block[None] ^ last)
        out.append(last)
    return np.vstack(out).tobytes()


def pattern_blocks(n: int, crypt: int, skip: int) -> np.ndarray:
    """Which of n whole blocks are encrypted: the first `crypt` of every `crypt + skip`, all without a pattern."""
    return np.arange(n) if crypt + skip == 0 else np.flatnonzero(np.arange(n) % (crypt + skip) < crypt)


def _counter_plus(iv: bytes, blocks: int) -> bytes:
    low = int.from_bytes(iv[8:], "big") + blocks
    if low >= 1 << 64:
        raise InputError.bad("the CTR block counter runs over")
    return iv[:8] + low.to_bytes(8, "big")


def decrypt_sample(scheme: str, key: bytes, iv: bytes, data: bytes, subsamples: list[tuple[int, int]] | None = None, pattern: tuple[int, int] = (0, 0), continuous: bool = False) -> bytes:
    """One protected sample: cenc, cens (CTR) or cbcs (CBC), whole or by (clear, protected) subsamples.

    cenc starts each subsample on a fresh counter block unless `continuous`; cens goes on by the blocks it
    has decrypted; cbcs begins each subsample at the IV and leaves what is no whole block clear."""
    if scheme not in ("cenc", "cens", "cbcs"):
        raise InputError.bad(f"unknown scheme {scheme!r}")
    if not iv:
        raise EngineError("decode-error", "a protected sample has no IV")
    iv = iv.ljust(BLOCK, b"\0")
    out, at, used = bytearray(data), 0, 0
    parts = subsamples or [(0, len(data))]
    if sum(a + b for a, b in parts) > len(data):
        raise EngineError("decode-error", "subsamples run over the sample")
    if scheme == "cenc" and continuous:
        spans = []
        for clear, size in parts:
            spans.append((at + clear, size))
            at += clear + size
        plain = ctr(key, iv, b"".join(data[a : a + n] for a, n in spans))
        for a, n in spans:
            out[a : a + n], plain = plain[:n], plain[n:]
        return bytes(out)
    for clear, size in parts:
        at += clear
        piece = data[at : at + size]
        if scheme == "cenc":
            out[at : at + size] = ctr(key, _counter_plus(iv, used), piece)
            used += -(-size // BLOCK)
        else:
            chosen = pattern_blocks(size // BLOCK, *pattern)
            body = np.frombuffer(piece[: size // BLOCK * BLOCK], np.uint8).reshape(-1, BLOCK).copy()
            if len(chosen):
                gathered = body[chosen].tobytes()
                plain = ctr(key, _counter_plus(iv, used), gathered) if scheme == "cens" else cbc(key, iv, gathered)
                body[chosen] = _as_blocks(plain)
                used += len(chosen)
            out[at : at + body.size] = body.tobytes()
        at += size
    return bytes(out)


def decrypt_udf(scheme: str, continuous: bool = False):
    """Column function (data, key, iv, clear sizes, protected sizes, crypt, skip) -> clear data."""

    @F.pandas_udf("binary")
    def run(parts: Iterator[tuple[pd.Series, ...]]) -> Iterator[pd.Series]:
        for data, key, iv, clear, size, crypt, skip in parts:
            yield pd.Series(
                [
                    None if d is None else decrypt_sample(scheme, bytes(k), bytes(v), bytes(d), [(int(a), int(b)) for a, b in zip(c, s, strict=True)] if c is not None and len(c) else None, (int(x), int(y)), continuous)
                    for d, k, v, c, s, x, y in zip(data, key, iv, clear, size, crypt, skip, strict=True)
                ]
            )

    return run


def unescape_nal(nal: bytes) -> bytes:
    """Without emulation prevention bytes."""
    return nal.replace(b"\0\0\3", b"\0\0")


def sample_aes_nal(key: bytes, iv: bytes, nal: bytes) -> bytes:
    """SAMPLE-AES of a slice NAL (type 1 or 5) of more than 48 bytes: 32 clear, then 16 of every 160 encrypted."""
    if not nal or nal[0] & 0x1F not in (1, 5) or len(nal) <= 48:
        return nal
    raw = bytearray(unescape_nal(nal))
    starts = list(range(32, len(raw) - BLOCK, 10 * BLOCK))
    plain = cbc(key, iv, b"".join(bytes(raw[a : a + BLOCK]) for a in starts))
    for i, a in enumerate(starts):
        raw[a : a + BLOCK] = plain[i * BLOCK : (i + 1) * BLOCK]
    return bytes(raw)


def sample_aes_audio(key: bytes, iv: bytes, frame: bytes, header: int = 7) -> bytes:
    """SAMPLE-AES of an ADTS frame: header and 16 bytes clear, then whole blocks."""
    at = header + BLOCK
    n = max(0, len(frame) - at) // BLOCK * BLOCK
    return frame[:at] + cbc(key, iv, frame[at : at + n]) + frame[at + n :]
