"""WAV, AIFF/AIFF-C and CAF: headers around interleaved PCM."""

from __future__ import annotations

import struct
from dataclasses import dataclass

import numpy as np

from ...errors import CapabilityError, InputError, EngineError
from ...functions import pcm
from .base import Movie, Packet, Reader, Track, us

EXTENSIBLE = 0xFFFE


@dataclass
class PcmFile:
    container: str
    fmt: str
    big: bool
    rate: int
    channels: int
    offset: int
    size: int

    @property
    def frame_bytes(self) -> int:
        return pcm.WIDTH[self.fmt] * self.channels

    @property
    def frames(self) -> int:
        return self.size // self.frame_bytes

    def decode(self, content: bytes) -> np.ndarray:
        return pcm.decode(content[self.offset : self.offset + self.size], self.fmt, self.channels, self.big)


def extended(x: float) -> bytes:
    """80-bit IEEE extended, big-endian."""
    if x <= 0:
        return bytes(10)
    e = int(np.floor(np.log2(x)))
    return struct.pack(">HQ", e + 16383, int(x * 2.0 ** (63 - e)))


def from_extended(b: bytes) -> float:
    e, m = struct.unpack(">HQ", b)
    return 0.0 if not m else (-1 if e & 0x8000 else 1) * m * 2.0 ** ((e & 0x7FFF) - 16383 - 63)


def _chunks(r: Reader, little: bool, pad: bool = True, size_bytes: int = 4):
    """(id, where its body begins, body size), up to the end or a cut-off chunk."""
    while r.left() >= 4 + size_bytes:
        name, size = r.take(4), r.u(size_bytes, little)
        begin = r.at
        yield name, begin, min(size, r.end - begin) if size < 1 << 62 else r.end - begin
        r.at = min(r.end, begin + size + (size & 1 if pad else 0)) if size < 1 << 62 else r.end


def _int_format(bits: int, container: str) -> str:
    name = {8: "u8" if container == "wav" else "s8", 16: "s16", 24: "s24", 32: "s32"}.get(bits)
    if name is None:
        raise CapabilityError.miss(f"{bits}-bit PCM", {"op": "demux", "container": container})
    return name


def _made(container: str, fmt: str, big: bool, rate: int, channels: int, offset: int, size: int) -> PcmFile:
    if rate <= 0 or channels <= 0:
        raise EngineError("demux-error", f"{container}: rate and channels must be positive")
    return PcmFile(container, fmt, big, rate, channels, offset, size)


def parse_wav(data: bytes) -> PcmFile:
    if data[:4] != b"RIFF" or data[8:12] != b"WAVE":
        raise InputError.bad("not a WAV file")
    fmt = None
    for name, at, size in _chunks(Reader(data, 12, what="WAV"), True):
        if name == b"fmt ":
            r = Reader(data, at, at + size, "WAV fmt chunk")
            code, channels, rate, _, _, bits = r.u(2, True), r.u(2, True), r.u(4, True), r.u(4, True), r.u(2, True), r.u(2, True)
            if code == EXTENSIBLE and r.left() >= 10:
                r.skip(8)
                code = r.u(2, True)
            if code == 3 and bits in (32, 64):
                fmt = (f"f{bits}", rate, channels)
            elif code == 1:
                fmt = (_int_format(bits, "wav"), rate, channels)
            else:
                raise CapabilityError.miss(f"WAV format {code}", {"op": "demux", "container": "wav"})
        elif name == b"data":
            if fmt is None:
                raise EngineError("demux-error", "WAV data before its format")
            return _made("wav", fmt[0], False, fmt[1], fmt[2], at, size)
    raise EngineError("demux-error", "WAV without format or data")


def wav_header(fmt: str, rate: int, channels: int, size: int) -> bytes:
    """The canonical 44 bytes."""
    width = pcm.WIDTH[fmt]
    code = 3 if fmt[0] == "f" else 1
    return struct.pack("<4sI4s4sIHHIIHH4sI", b"RIFF", 36 + size + (size & 1), b"WAVE", b"fmt ", 16, code, channels, rate, rate * channels * width, channels * width, 8 * width, b"data", size)


def write_wav(planar: np.ndarray, rate: int, fmt: str = "s16") -> bytes:
    if fmt == "s8":
        raise CapabilityError.miss("WAV has no signed 8-bit samples", {"op": "mux", "container": "wav"})
    body = pcm.encode(planar, fmt)
    return wav_header(fmt, rate, len(planar), len(body)) + body + b"\0" * (len(body) & 1)


def parse_aiff(data: bytes) -> PcmFile:
    if data[:4] != b"FORM" or data[8:12] not in (b"AIFF", b"AIFC"):
        raise InputError.bad("not an AIFF file")
    common = body = None
    for name, at, size in _chunks(Reader(data, 12, what="AIFF"), False):
        r = Reader(data, at, at + size, "AIFF chunk")
        if name == b"COMM":
            channels, frames, bits, rate = r.u(2), r.u(4), r.u(2), from_extended(r.take(10))
            kind = r.take(4) if data[8:12] == b"AIFC" else b"NONE"
            common = (channels, frames, bits, int(round(rate)), kind)
        elif name == b"SSND":
            skip = r.u(4)
            r.skip(4 + skip)
            body = (r.at, r.left())
    if common is None or body is None:
        raise EngineError("demux-error", "AIFF without COMM or SSND")
    channels, frames, bits, rate, kind = common
    floats = {b"fl32": "f32", b"FL32": "f32", b"fl64": "f64", b"FL64": "f64"}
    if kind in floats:
        fmt, big = floats[kind], True
    elif kind in (b"NONE", b"twos", b"in16", b"in24", b"in32", b"sowt", b"lpcm"):
        fmt, big = _int_format(-(-bits // 8) * 8, "aiff"), kind not in (b"sowt", b"lpcm")
    else:
        raise CapabilityError.miss(f"AIFF-C {kind!r}", {"op": "demux", "container": "aiff"})
    return _made("aiff", fmt, big, rate, channels, body[0], min(body[1], frames * channels * pcm.WIDTH[fmt]))


def write_aiff(planar: np.ndarray, rate: int, fmt: str = "s16") -> bytes:
    if fmt == "u8":
        raise CapabilityError.miss("AIFF has no unsigned samples", {"op": "mux", "container": "aiff"})
    body = pcm.encode(planar, fmt, True)
    comm = struct.pack(">HIH", len(planar), planar.shape[1], 8 * pcm.WIDTH[fmt]) + extended(rate)
    kind = b"AIFF"
    chunks = b""
    if fmt[0] == "f":
        kind = b"AIFC"
        comm += (b"fl32" if fmt == "f32" else b"fl64") + b"\0\0"
        chunks = struct.pack(">4sII", b"FVER", 4, 0xA2805140)
    chunks += struct.pack(">4sI", b"COMM", len(comm)) + comm + struct.pack(">4sIII", b"SSND", 8 + len(body), 0, 0) + body + b"\0" * (len(body) & 1)
    return struct.pack(">4sI4s", b"FORM", 4 + len(chunks), kind) + chunks


def parse_caf(data: bytes) -> PcmFile:
    if data[:4] != b"caff":
        raise InputError.bad("not a CAF file")
    desc = None
    for name, at, size in _chunks(Reader(data, 8, what="CAF"), False, False, 8):
        r = Reader(data, at, at + size, "CAF chunk")
        if name == b"desc":
            rate, kind, flags, _, _, channels, bits = r.f(">d"), r.take(4), r.u(4), r.u(4), r.u(4), r.u(4), r.u(4)
            if kind != b"lpcm":
                raise CapabilityError.miss(f"CAF {kind!r}", {"op": "demux", "container": "caf"})
            desc = (f"f{bits}" if flags & 1 and bits in (32, 64) else _int_format(bits, "caf"), not flags & 2, int(round(rate)), channels)
        elif name == b"data":
            if desc is None:
                raise EngineError("demux-error", "CAF data before its description")
            r.skip(4)
            return _made("caf", *desc, r.at, r.left())
    raise EngineError("demux-error", "CAF without description or data")


def write_caf(planar: np.ndarray, rate: int, fmt: str = "s16", big: bool = False) -> bytes:
    if fmt == "u8":
        raise CapabilityError.miss("CAF has no unsigned samples", {"op": "mux", "container": "caf"})
    body, width = pcm.encode(planar, fmt, big), pcm.WIDTH[fmt]
    flags = (1 if fmt[0] == "f" else 0) | (0 if big else 2)
    desc = struct.pack(">d4sIIIII", float(rate), b"lpcm", flags, width * len(planar), 1, len(planar), 8 * width)
    return b"caff" + struct.pack(">HH", 1, 0) + b"desc" + struct.pack(">q", len(desc)) + desc + b"data" + struct.pack(">qI", 4 + len(body), 0) + body


PARSE = {"wav": parse_wav, "aiff": parse_aiff, "caf": parse_caf}
WRITE = {"wav": write_wav, "aiff": write_aiff, "caf": write_caf}


def output_format(container: str, source: str, asked: str | None = None) -> str:
    """The sample format to write: as asked, else the source's, with 8 bits in the container's sign."""
    if asked is not None:
        return asked
    if container == "wav":
        return "u8" if source == "s8" else source
    return "s8" if source == "u8" else source


def flac_bits(fmt: str) -> int:
    """Bits of a FLAC sample for PCM of this format; floats get 24."""
    if fmt not in pcm.WIDTH:
        raise CapabilityError.miss(f"FLAC of {fmt}", {"op": "encode", "codec": "flac"})
    return 24 if fmt[0] == "f" else 8 * pcm.WIDTH[fmt]


def movie(parse, data: bytes, packet_frames: int = 1024) -> Movie:
    """PCM as packets of up to `packet_frames` frames."""
    f = parse(data)
    t = Track(1, "audio", f"pcm-{f.fmt}{'be' if f.big else 'le'}", f.rate, f.frames / f.rate, sample_rate=f.rate, channels=f.channels)
    for a in range(0, f.frames, packet_frames):
        n = min(packet_frames, f.frames - a)
        t.packets.append(Packet(f.offset + a * f.frame_bytes, n * f.frame_bytes, us(a, f.rate), us(a, f.rate), us(n, f.rate)))
    return Movie(f.container, [t], f.frames / f.rate)
