"""RFC 6381 codec strings from configuration records, and headers of VP8, VP9 and IVF."""

from __future__ import annotations

import struct
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import functions as F

from ..errors import InputError, EngineError

#: Tokens of public targets and the default strings they stand for.
TOKENS = {"h264": "avc1.42E01E", "hevc": "hvc1.1.6.L93.B0", "vp8": "vp8", "vp9": "vp09.00.10.08", "av1": "av01.0.04M.08", "aac": "mp4a.40.2", "opus": "opus", "mp3": "mp3", "vorbis": "vorbis", "flac": "flac"}


def _need(data: bytes, n: int, what: str) -> bytes:
    if len(data) < n:
        raise EngineError("demux-error", f"{what} is cut off")
    return data


def from_avcc(data: bytes) -> str:
    """avcC: profile, compatibility and level."""
    return "avc1." + _need(data, 4, "avcC")[1:4].hex().upper()


def from_hvcc(data: bytes) -> str:
    """hvcC: profile space and id, reversed compatibility flags, tier and level, constraint bytes without their zero tail."""
    _need(data, 13, "hvcC")
    space, tier, profile = data[1] >> 6, data[1] >> 5 & 1, data[1] & 31
    flags = int(f"{int.from_bytes(data[2:6], 'big'):032b}"[::-1], 2)
    tail = data[6:12].rstrip(b"\0")
    return ".".join(["hvc1", f"{('', 'A', 'B', 'C')[space]}{profile}", f"{flags:X}", f"{'LH'[tier]}{data[12]}", *(f"{b:X}" for b in tail)])


def from_av1c(data: bytes) -> str:
    """av1C: profile, level and tier, bit depth."""
    _need(data, 4, "av1C")
    depth = (12 if data[2] & 0x20 else 10) if data[2] & 0x40 else 8
    return f"av01.{data[1] >> 5}.{data[1] & 31:02d}{'MH'[data[2] >> 7]}.{depth:02d}"


def from_vpcc(data: bytes, family: str = "vp09") -> str:
    """vpcC (a full box): profile, level, bit depth."""
    _need(data, 7, "vpcC")
    return f"{family}.{data[4]:02d}.{data[5]:02d}.{data[6] >> 4:02d}"


def derive(codec: str, config: bytes) -> str:
    """The full string of a short name and its record; the short name where there is no record."""
    make = {"avc1": from_avcc, "hvc1": from_hvcc, "av1": from_av1c, "vp9": from_vpcc}.get(codec)
    return make(config) if make and config else codec


def token_of(codec: str) -> str | None:
    """The public token of a codec string."""
    low = codec.lower()
    for start, token in (("avc1", "h264"), ("avc3", "h264"), ("hvc1", "hevc"), ("hev1", "hevc"), ("vp08", "vp8"), ("vp8", "vp8"), ("vp09", "vp9"), ("vp9", "vp9"), ("av01", "av1"), ("av1", "av1"), ("mp4a", "aac"), ("opus", "opus"), ("mp3", "mp3"), ("vorbis", "vorbis"), ("flac", "flac")):
        if low.startswith(start):
            return token
    return None


def string_of(token: str) -> str:
    if token not in TOKENS:
        raise InputError.bad(f"unknown codec {token!r}")
    return TOKENS[token]


def derive_udf():
    """Column function (codec, config) -> full codec string."""

    @F.pandas_udf("string")
    def run(codec: pd.Series, config: pd.Series) -> pd.Series:
        return pd.Series([None if c is None else derive(c, bytes(b or b"")) for c, b in zip(codec, config, strict=True)])

    return run


@dataclass
class Frame:
    keyframe: bool
    width: int | None = None
    height: int | None = None


def vp8_frame(data: bytes) -> Frame:
    _need(data, 3, "a VP8 frame")
    if data[0] & 1:
        return Frame(False)
    if _need(data, 10, "a VP8 frame")[3:6] != b"\x9d\x01\x2a":
        raise EngineError("decode-error", "a VP8 keyframe has no start code")
    w, h = struct.unpack("<HH", data[6:10])
    return Frame(True, w & 0x3FFF, h & 0x3FFF)


def vp9_frame(data: bytes) -> Frame:
    bits = "".join(f"{b:08b}" for b in _need(data, 1, "a VP9 frame")[:16])
    at = 0

    def u(n: int) -> int:
        nonlocal at
        if at + n > len(bits):
            raise EngineError("decode-error", "a VP9 frame is cut off")
        at += n
        return int(bits[at - n : at], 2)

    if u(2) != 2:
        raise EngineError("decode-error", "not a VP9 frame")
    profile = u(1) | u(1) << 1
    if profile == 3:
        u(1)
    if u(1):  # shows a frame decoded before
        return Frame(False)
    inter = u(1)
    u(2)
    if inter:
        return Frame(False)
    if u(24) != 0x498342:
        raise EngineError("decode-error", "a VP9 keyframe has no sync code")
    if profile >= 2:
        u(1)
    if u(3) != 7:
        u(1)
        if profile in (1, 3):
            u(3)
    elif profile in (1, 3):
        u(1)
    return Frame(True, u(16) + 1, u(16) + 1)


def read_ivf(data: bytes) -> tuple[str, int, int, float, list[tuple[int, int, int]]]:
    """(fourcc, width, height, ticks a second, [(offset, size, ticks)])."""
    if data[:4] != b"DKIF" or len(data) < 32:
        raise InputError.bad("not an IVF file")
    head, w, h, rate, scale = struct.unpack("<H4xHHII", data[6:24])
    at, out = head, []
    while at + 12 <= len(data):
        size, ticks = struct.unpack("<IQ", data[at : at + 12])
        if at + 12 + size > len(data):
            raise EngineError("demux-error", "an IVF frame is cut off")
        out.append((at + 12, size, ticks))
        at += 12 + size
    return data[8:12].decode("latin1"), w, h, rate / (scale or 1), out


def write_ivf(fourcc: str, width: int, height: int, rate: int, scale: int, frames: list[tuple[int, bytes]]) -> bytes:
    head = struct.pack("<4sHH4sHHIIII", b"DKIF", 0, 32, fourcc.encode(), width, height, rate, scale, len(frames), 0)
    return head + b"".join(struct.pack("<IQ", len(d), t) + d for t, d in frames)
