"""What all container modules share: the parsed form, a bounded reader, and CRCs."""

from __future__ import annotations

import struct
from dataclasses import dataclass, field

from ...errors import EngineError


def truncated(what: str) -> EngineError:
    return EngineError("demux-error", f"{what} is cut off")


@dataclass
class Packet:
    """A packet's row; `data` only where a writer is given it or a parser had to rebuild it."""

    offset: int | None
    size: int
    pts_us: int
    dts_us: int | None = None
    duration_us: int | None = None
    keyframe: bool = True
    data: bytes | None = None


@dataclass
class Track:
    track_id: int
    track_kind: str
    codec: str
    timescale: int = 1_000_000
    duration_sec: float | None = None
    fps: float | None = None
    rotation: int = 0
    encrypted: bool = False
    width: int | None = None
    height: int | None = None
    sample_rate: int | None = None
    channels: int | None = None
    config: bytes = b""
    packets: list[Packet] = field(default_factory=list)

    def payload(self, p: Packet, content: bytes) -> bytes:
        return p.data if p.data is not None else content[p.offset : p.offset + p.size]


@dataclass
class Movie:
    container: str
    tracks: list[Track]
    duration_sec: float | None = None
    tags: dict[str, str] = field(default_factory=dict)


class Reader:
    """Reads fields of a byte range; running over its end is a typed error."""

    def __init__(self, data: bytes, at: int = 0, end: int | None = None, what: str = "data") -> None:
        self.data, self.at, self.end, self.what = data, at, len(data) if end is None else min(end, len(data)), what

    def left(self) -> int:
        return self.end - self.at

    def take(self, n: int) -> bytes:
        if n < 0 or self.at + n > self.end:
            raise truncated(self.what)
        self.at += n
        return self.data[self.at - n : self.at]

    def skip(self, n: int) -> None:
        self.take(n)

    def u(self, n: int, little: bool = False) -> int:
        return int.from_bytes(self.take(n), "little" if little else "big")

    def s(self, n: int, little: bool = False) -> int:
        return int.from_bytes(self.take(n), "little" if little else "big", signed=True)

    def f(self, kind: str) -> float:
        return struct.unpack(kind, self.take(struct.calcsize(kind)))[0]


def us(ticks: float, timescale: float) -> int:
    """round(ticks * 1e6 / timescale), halves up; 0 without a timescale."""
    import math

    return math.floor(ticks * 1_000_000 / timescale + 0.5) if timescale > 0 else 0


def crc_table(bits: int, poly: int) -> list[int]:
    """Table of a CRC that is not reflected."""
    top, mask = 1 << (bits - 1), (1 << bits) - 1
    out = []
    for byte in range(256):
        c = byte << (bits - 8)
        for _ in range(8):
            c = ((c << 1) ^ poly if c & top else c << 1) & mask
        out.append(c)
    return out


_tables: dict[tuple[int, int], list[int]] = {}


def crc(data: bytes, bits: int, poly: int, start: int = 0) -> int:
    table = _tables.setdefault((bits, poly), crc_table(bits, poly))
    c, shift, mask = start, bits - 8, (1 << bits) - 1
    for b in data:
        c = (c << 8 & mask) ^ table[(c >> shift & 0xFF) ^ b]
    return c


def crc8(data: bytes) -> int:
    return crc(data, 8, 0x07)


def crc16(data: bytes) -> int:
    return crc(data, 16, 0x8005)


def crc32_ogg(data: bytes) -> int:
    return crc(data, 32, 0x04C11DB7)


def crc32_mpeg2(data: bytes) -> int:
    return crc(data, 32, 0x04C11DB7, 0xFFFFFFFF)
