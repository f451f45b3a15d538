"""FLAC: frames, a full decoder, and an encoder with constant, verbatim and fixed predictors."""

from __future__ import annotations

import hashlib
from dataclasses import dataclass

import numpy as np

from ...errors import CapabilityError, InputError, EngineError
from .base import Movie, Packet, Track, crc8, crc16, us

#: Fixed values of the format: block sizes, sample rates and sample sizes by code.
BLOCK_SIZES = {1: 192, **{k: 576 << (k - 2) for k in range(2, 6)}, **{k: 256 << (k - 8) for k in range(8, 16)}}
RATES = {1: 88200, 2: 176400, 3: 192000, 4: 8000, 5: 16000, 6: 22050, 7: 24000, 8: 32000, 9: 44100, 10: 48000, 11: 96000}
DEPTHS = {1: 8, 2: 12, 4: 16, 5: 20, 6: 24, 7: 32}
FIXED = ([], [1], [2, -1], [3, -3, 1], [4, -6, 4, -1])


@dataclass
class StreamInfo:
    min_block: int
    max_block: int
    rate: int
    channels: int
    bits: int
    frames: int
    md5: bytes
    audio: int
    comments: dict[str, str]


def parse_info(data: bytes) -> StreamInfo:
    if data[:4] != b"fLaC":
        raise InputError.bad("not a FLAC file")
    at, info, tags = 4, None, {}
    while True:
        if at + 4 > len(data):
            raise EngineError("demux-error", "FLAC metadata is cut off")
        kind, size = data[at], int.from_bytes(data[at + 1 : at + 4], "big")
        body = data[at + 4 : at + 4 + size]
        if len(body) < size:
            raise EngineError("demux-error", "FLAC metadata is cut off")
        if kind & 0x7F == 0 and size >= 34:
            v = int.from_bytes(body[10:18], "big")
            info = (int.from_bytes(body[:2], "big"), int.from_bytes(body[2:4], "big"), v >> 44, (v >> 41 & 7) + 1, (v >> 36 & 31) + 1, v & (1 << 36) - 1, body[18:34])
        elif kind & 0x7F == 4:
            tags = parse_comments(body)
        at += 4 + size
        if kind & 0x80:
            break
    if info is None or info[2] == 0:
        raise EngineError("demux-error", "FLAC without STREAMINFO")
    return StreamInfo(*info, at, tags)


def parse_comments(body: bytes) -> dict[str, str]:
    """A Vorbis comment block: little-endian lengths, KEY=value."""
    try:
        at = 4 + int.from_bytes(body[:4], "little")
        n, at, out = int.from_bytes(body[at : at + 4], "little"), at + 4, {}
        for _ in range(min(n, len(body))):
            size = int.from_bytes(body[at : at + 4], "little")
            k, eq, v = body[at + 4 : at + 4 + size].decode("utf-8", "replace").partition("=")
            if eq and at + 4 + size <= len(body):
                out[k] = v
            at += 4 + size
        return out
    except IndexError:
        return {}


def comment_block(tags: dict[str, str], vendor: str = "cadenza") -> bytes:
    v = vendor.encode()
    items = [f"{k}={x}".encode() for k, x in tags.items()]
    return len(v).to_bytes(4, "little") + v + len(items).to_bytes(4, "little") + b"".join(len(i).to_bytes(4, "little") + i for i in items)


def _coded_number(data: bytes, at: int) -> tuple[int, int]:
    """The UTF-8-like frame or sample number, and where it ends."""
    b = data[at]
    if b < 0x80:
        return b, at + 1
    n = 8 - (~b & 0xFF).bit_length()
    if n < 2 or n > 7 or at + n > len(data):
        raise EngineError("demux-error", "bad FLAC frame number")
    v = b & (0x7F >> n)
    for x in data[at + 1 : at + n]:
        if x & 0xC0 != 0x80:
            raise EngineError("demux-error", "bad FLAC frame number")
        v = v << 6 | x & 0x3F
    return v, at + n


def _number_bytes(v: int) -> bytes:
    if v < 0x80:
        return bytes([v])
    n = 2
    while v >= 1 << (5 * n + 1):
        n += 1
    out = [(0xFF << (8 - n) & 0xFF) | v >> 6 * (n - 1)]
    return bytes(out + [0x80 | v >> 6 * k & 0x3F for k in range(n - 2, -1, -1)])


@dataclass
class Header:
    at: int
    body: int
    first: int
    samples: int
    rate: int
    assignment: int
    bits: int


def parse_header(data: bytes, at: int, info: StreamInfo) -> Header | None:
    """The frame header at a place, if one with a right CRC-8 stands there."""
    if at + 6 > len(data) or data[at] != 0xFF or data[at + 1] & 0xFE != 0xF8:
        return None
    size, rate, assignment, depth = data[at + 2] >> 4, data[at + 2] & 15, data[at + 3] >> 4, data[at + 3] >> 1 & 7
    if size == 0 or rate == 15 or assignment > 10 or depth == 3 or data[at + 3] & 1:
        return None
    try:
        number, p = _coded_number(data, at + 4)
    except (EngineError, IndexError):
        return None
    extra = (1 if size == 6 else 2 if size == 7 else 0) + (1 if rate == 12 else 2 if rate in (13, 14) else 0)
    if p + extra >= len(data):
        return None
    samples = BLOCK_SIZES.get(size, 0)
    if size in (6, 7):
        samples = int.from_bytes(data[p : p + size - 5], "big") + 1
        p += size - 5
    hz = RATES.get(rate, info.rate)
    if rate >= 12:
        n = 1 if rate == 12 else 2
        hz = int.from_bytes(data[p : p + n], "big") * (1000 if rate == 12 else 1 if rate == 13 else 10)
        p += n
    if crc8(data[at:p]) != data[p]:
        return None
    first = number if data[at + 1] & 1 else number * info.min_block
    return Header(at, p + 1, first, samples, hz, assignment, DEPTHS.get(depth, info.bits))


def frames(data: bytes, info: StreamInfo) -> list[Header]:
    """All frame headers, by sync code, CRC-8 and the sample they must begin at."""
    out, at, due = [], info.audio, None
    while (at := data.find(b"\xff", at)) >= 0:
        h = parse_header(data, at, info)
        if h is not None and (due is None or h.first == due):
            out.append(h)
            due = h.first + h.samples
            at = h.body
        else:
            at += 1
    return out


class _Bits:
    def __init__(self, data: bytes, at: int) -> None:
        self.bits = np.unpackbits(np.frombuffer(data, np.uint8, offset=at))
        self.ones = np.flatnonzero(self.bits)
        self.at = 0

    def u(self, n: int) -> int:
        if self.at + n > len(self.bits):
            raise EngineError("decode-error", "a FLAC frame is cut off")
        v = int("".join(map(str, self.bits[self.at : self.at + n])), 2) if n else 0
        self.at += n
        return v

    def s(self, n: int) -> int:
        v = self.u(n)
        return v - (1 << n) if n and v >> (n - 1) else v

    def unary(self) -> int:
        i = np.searchsorted(self.ones, self.at)
        if i >= len(self.ones):
            raise EngineError("decode-error", "a FLAC frame is cut off")
        n = int(self.ones[i]) - self.at
        self.at += n + 1
        return n

    def many(self, n: int, count: int) -> np.ndarray:
        """count signed numbers of n bits."""
        if self.at + n * count > len(self.bits):
            raise EngineError("decode-error", "a FLAC frame is cut off")
        v = self.bits[self.at : self.at + n * count].reshape(count, n).astype(np.int64) @ (1 << np.arange(n - 1, -1, -1, dtype=np.int64))
        self.at += n * count
        return np.where(v >> (n - 1) & 1, v - (1 << n), v)

    def rice(self, k: int, count: int) -> np.ndarray:
        out = np.empty(count, np.int64)
        ones, bits, at = self.ones, self.bits, self.at
        i = int(np.searchsorted(ones, at))
        weight = 1 << np.arange(k - 1, -1, -1, dtype=np.int64)
        stops, q = np.empty(count, np.int64), np.empty(count, np.int64)
        total = len(ones)
        for j in range(count):
            while i < total and ones[i] < at:
                i += 1
            if i >= total:
                raise EngineError("decode-error", "a FLAC frame is cut off")
            stop = int(ones[i])
            q[j], stops[j] = stop - at, stop + 1
            at = stop + 1 + k
        if at > len(bits):
            raise EngineError("decode-error", "a FLAC frame is cut off")
        low = bits[stops[:, None] + np.arange(k)].astype(np.int64) @ weight if k else 0
        v = (q << k) | low
        out[:] = (v >> 1) ^ -(v & 1)
        self.at = at
        return out


def _residual(b: _Bits, order: int, n: int) -> np.ndarray:
    method = b.u(2)
    if method > 1:
        raise EngineError("decode-error", "unknown FLAC residual coding")
    width, parts = 4 + method, 1 << b.u(4)
    if n % parts or n // parts < order:
        raise EngineError("decode-error", "bad FLAC partition order")
    out = []
    for p in range(parts):
        count, k = n // parts - (order if p == 0 else 0), b.u(width)
        if k == (1 << width) - 1:
            raw = b.u(5)
            out.append(b.many(raw, count) if raw else np.zeros(count, np.int64))
        else:
            out.append(b.rice(k, count))
    return np.concatenate(out)


def _predict(warm: list[int], residual: np.ndarray, coefficients: list[int], shift: int) -> np.ndarray:
    out = list(warm)
    order = len(coefficients)
    back = coefficients[::-1]
    for r in residual.tolist():
        window = out[-order:] if order else []
        out.append(r + (sum(c * x for c, x in zip(back, window, strict=True)) >> shift))
    return np.array(out, np.int64)


def _subframe(b: _Bits, n: int, bits: int) -> np.ndarray:
    if b.u(1):
        raise EngineError("decode-error", "bad FLAC subframe")
    kind = b.u(6)
    wasted = b.unary() + 1 if b.u(1) else 0
    bits -= wasted
    if kind == 0:
        x = np.full(n, b.s(bits), np.int64)
    elif kind == 1:
        x = b.many(bits, n)
    elif 8 <= kind <= 12:
        order = kind - 8
        warm = [b.s(bits) for _ in range(order)]
        r = _residual(b, order, n)
        if order:  # differences of the given order, summed up again
            x = r
            firsts = [warm[0]]
            d = np.array(warm, np.int64)
            for _ in range(order - 1):
                d = np.diff(d)
                firsts.append(int(d[0]))
            for k in range(order - 1, -1, -1):
                x = np.concatenate([[firsts[k]], firsts[k] + np.cumsum(x)])
        else:
            x = r
    elif kind >= 32:
        order = kind - 31
        warm = [b.s(bits) for _ in range(order)]
        precision, shift = b.u(4) + 1, b.s(5)
        if precision == 16 or shift < 0:
            raise EngineError("decode-error", "bad FLAC predictor")
        coefficients = [b.s(precision) for _ in range(order)]
        x = _predict(warm, _residual(b, order, n), coefficients, shift)
    else:
        raise EngineError("decode-error", "reserved FLAC subframe")
    return x << wasted


def decode_frame(data: bytes, h: Header, channels: int) -> np.ndarray:
    """channels x samples of whole numbers; the frame's CRC-16 is checked."""
    b = _Bits(data, h.body)
    n = h.assignment + 1 if h.assignment < 8 else 2
    if n != channels:
        raise EngineError("decode-error", "a FLAC frame changes the channels")
    wide = {8: 1, 9: 0, 10: 1}.get(h.assignment)
    x = [_subframe(b, h.samples, h.bits + (c == wide)) for c in range(n)]
    end = h.body + -(-b.at // 8)
    if end + 2 > len(data) or crc16(data[h.at : end]) != int.from_bytes(data[end : end + 2], "big"):
        raise EngineError("decode-error", "a FLAC frame's checksum differs")
    if h.assignment == 8:
        x[1] = x[0] - x[1]
    elif h.assignment == 9:
        x[0] = x[0] + x[1]
    elif h.assignment == 10:
        mid = (x[0] << 1) | (x[1] & 1)
        x = [(mid + x[1]) >> 1, (mid - x[1]) >> 1]
    return np.stack(x)


def _raw(x: np.ndarray, bits: int) -> bytes:
    width = -(-bits // 8)
    four = np.ascontiguousarray(x.T).astype("<i4").reshape(-1).view(np.uint8).reshape(-1, 4)
    return four[:, :width].tobytes()


def decode(data: bytes, check: bool = True) -> tuple[StreamInfo, np.ndarray]:
    """Whole numbers, channels x frames; with `check` the MD5 of the stream is verified."""
    info = parse_info(data)
    parts = [decode_frame(data, h, info.channels) for h in frames(data, info)]
    x = np.concatenate(parts, axis=1) if parts else np.zeros((info.channels, 0), np.int64)
    if info.frames and x.shape[1] != info.frames:
        raise EngineError("decode-error", "FLAC frames are missing")
    if check and info.md5 != bytes(16) and hashlib.md5(_raw(x, info.bits)).digest() != info.md5:
        raise EngineError("decode-error", "the FLAC stream's MD5 differs")
    return info, x


# ---- encoding


class _Writer:
    def __init__(self) -> None:
        self.parts: list[np.ndarray] = []

    def u(self, v: int, n: int) -> None:
        if n:
            self.parts.append(np.array([int(c) for c in format(v & (1 << n) - 1, f"0{n}b")], np.uint8))

    def numbers(self, x: np.ndarray, n: int) -> None:
        self.parts.append(((x[:, None] >> np.arange(n - 1, -1, -1)) & 1).astype(np.uint8).reshape(-1))

    def rice(self, r: np.ndarray, k: int) -> None:
        v = (r << 1) ^ (r >> 63)
        q = v >> k
        ends = np.cumsum(q + 1 + k)
        out = np.zeros(int(ends[-1]) if len(ends) else 0, np.uint8)
        out[ends - k - 1] = 1
        if k:
            out[(ends - k)[:, None] + np.arange(k)] = (v[:, None] >> np.arange(k - 1, -1, -1)) & 1
        self.parts.append(out)

    def bytes(self) -> bytes:
        return np.packbits(np.concatenate(self.parts)).tobytes()


def _rice_bits(r: np.ndarray) -> tuple[int, int]:
    v = (r << 1) ^ (r >> 63)
    costs = [(int((v >> k).sum()) + len(v) * (1 + k), k) for k in range(15)]
    return min(costs)


def _write_subframe(out: _Writer, x: np.ndarray, bits: int) -> None:
    n = len(x)
    if (x == x[0]).all():
        out.u(0, 8)
        out.u(int(x[0]), bits)
        return
    best = None
    d = x
    for order in range(0, min(4, n - 1) + 1):
        cost, k = _rice_bits(d)
        if best is None or cost + order * bits < best[0]:
            best = (cost + order * bits, order, k, d)
        d = np.diff(d)
    if best[0] >= n * bits:
        out.u(1 << 1, 8)
        out.numbers(x, bits)
        return
    _, order, k, residual = best
    out.u((8 + order) << 1, 8)
    if order:
        out.numbers(x[:order], bits)
    out.u(0, 2 + 4)
    out.u(k, 4)
    out.rice(residual, k)


def encode(x: np.ndarray, rate: int, bits: int = 16, block: int = 4096, tags: dict[str, str] | None = None) -> bytes:
    """Whole numbers, channels x frames, as a FLAC file; stereo takes left/side or mid/side where it is shorter."""
    channels, n = x.shape
    if not 1 <= channels <= 8 or bits not in (8, 12, 16, 20, 24, 32):
        raise CapabilityError.miss(f"FLAC of {channels} channels and {bits} bits", {"op": "encode", "codec": "flac"})
    x = x.astype(np.int64)
    body, sizes = [], []
    for number, a in enumerate(range(0, n, block)):
        part = x[:, a : a + block]
        m = part.shape[1]
        choices = [(channels - 1, list(part), [bits] * channels)]
        if channels == 2:
            side = part[0] - part[1]
            choices += [(8, [part[0], side], [bits, bits + 1]), (10, [(part[0] + part[1]) >> 1, side], [bits, bits + 1])]
        best = None
        for assignment, rows, widths in choices:
            w = _Writer()
            for row, width in zip(rows, widths, strict=True):
                _write_subframe(w, row, width)
            coded = w.bytes()
            if best is None or len(coded) < len(best[1]):
                best = (assignment, coded)
        depth = {v: k for k, v in DEPTHS.items()}[bits]
        head = bytes([0xFF, 0xF8, 7 << 4, best[0] << 4 | depth << 1]) + _number_bytes(number) + (m - 1).to_bytes(2, "big")
        frame = head + bytes([crc8(head)]) + best[1]
        frame += crc16(frame).to_bytes(2, "big")
        body.append(frame)
        sizes.append(len(frame))
    info = block.to_bytes(2, "big") * 2 + (min(sizes, default=0)).to_bytes(3, "big") + (max(sizes, default=0)).to_bytes(3, "big")
    info += ((rate << 44) | (channels - 1) << 41 | (bits - 1) << 36 | n).to_bytes(8, "big") + hashlib.md5(_raw(x, bits)).digest()
    comments = comment_block(tags) if tags else b""
    out = b"fLaC" + bytes([0 if tags else 0x80]) + len(info).to_bytes(3, "big") + info
    if tags:
        out += bytes([0x84]) + len(comments).to_bytes(3, "big") + comments
    return out + b"".join(body)


def movie(data: bytes) -> Movie:
    info = parse_info(data)
    heads = frames(data, info)
    t = Track(1, "audio", "flac", info.rate, info.frames / info.rate, sample_rate=info.rate, channels=info.channels, config=data[4 : info.audio])
    for h, end in zip(heads, [*(x.at for x in heads[1:]), len(data)], strict=True):
        t.packets.append(Packet(h.at, end - h.at, us(h.first, info.rate), us(h.first, info.rate), us(h.samples, info.rate)))
    return Movie("flac", [t], info.frames / info.rate, info.comments)
