"""Image headers: size, depth, colour, animation of GIF, PNG/APNG, JPEG, WebP and AVIF. No pixels."""

from __future__ import annotations

import math
import struct
from dataclasses import dataclass

from ...errors import InputError, EngineError
from .base import Reader, truncated
from .mp4 import boxes

PNG = b"\x89PNG\r\n\x1a\n"


@dataclass
class Image:
    format: str
    width: int
    height: int
    frame_count: int = 1
    animated: bool = False
    bit_depth: int = 8
    color_type: str = "rgb"
    loop_count: float | None = None
    duration_sec: float | None = None


def sniff(data: bytes) -> str | None:
    if data[:6] in (b"GIF87a", b"GIF89a"):
        return "gif"
    if data[:8] == PNG:
        return "png"
    if data[:3] == b"\xff\xd8\xff":
        return "jpeg"
    if data[:4] == b"RIFF" and data[8:12] == b"WEBP":
        return "webp"
    if data[4:8] == b"ftyp":
        size = min(len(data), int.from_bytes(data[:4], "big"))
        brands = [data[8:12], *(data[i : i + 4] for i in range(16, size - 3, 4))]
        return "avif" if b"avif" in brands or b"avis" in brands else None
    return None


def _gif(data: bytes) -> Image:
    r = Reader(data, 6, what="a GIF file")
    w, h, flags = r.u(2, True), r.u(2, True), r.u(1)
    r.skip(2)
    if flags & 0x80:
        r.skip(3 << (flags & 7) + 1)
    frames, total, loops, delay = 0, 0, None, 0
    while r.left():
        kind = r.u(1)
        if kind == 0x3B:
            break
        if kind == 0x21:
            label, first = r.u(1), True
            while n := r.u(1):
                block = r.take(n)
                if label == 0xF9 and n >= 4:
                    delay = int.from_bytes(block[1:3], "little")
                elif label == 0xFF and first and block[:11] not in (b"NETSCAPE2.0", b"ANIMEXTS1.0"):
                    label = 0
                elif label == 0xFF and not first and n >= 3 and block[0] == 1:
                    loops = int.from_bytes(block[1:3], "little")
                first = False
        elif kind == 0x2C:
            r.skip(8)
            local = r.u(1)
            if local & 0x80:
                r.skip(3 << (local & 7) + 1)
            r.skip(1)
            while n := r.u(1):
                r.skip(n)
            frames, total, delay = frames + 1, total + delay, 0
        else:
            raise EngineError("demux-error", "a GIF file has an unknown block")
    return Image("gif", w, h, frames, frames > 1, (flags >> 4 & 7) + 1, "indexed", None if loops is None else (math.inf if loops == 0 else float(loops)), total / 100 if frames > 1 else None)


def _png(data: bytes) -> Image:
    r, out, total, frames = Reader(data, 8, what="a PNG file"), None, 0.0, 0
    kinds = {0: "gray", 2: "rgb", 3: "indexed", 4: "gray-alpha", 6: "rgba"}
    while r.left() >= 12:
        n, name = r.u(4), r.take(4)
        body = r.take(n)
        r.skip(4)
        if name == b"IHDR" and n >= 13:
            w, h, depth, color = struct.unpack(">IIBB", body[:10])
            out = Image("png", w, h, 1, False, depth, kinds.get(color, "unknown"))
        elif name == b"acTL" and out and n >= 8:
            count, plays = struct.unpack(">II", body[:8])
            out.frame_count, out.animated, out.loop_count = count, count > 1, math.inf if plays == 0 else float(plays)
        elif name == b"fcTL" and n >= 26:
            num, den = struct.unpack(">HH", body[20:24])
            total, frames = total + num / (den or 100), frames + 1
        elif name == b"IEND":
            break
    if out is None:
        raise truncated("a PNG file")
    if out.animated and frames:
        out.duration_sec = total
    return out


def _jpeg(data: bytes) -> Image:
    r = Reader(data, 2, what="a JPEG file")
    while r.left() >= 4:
        if r.u(1) != 0xFF:
            raise EngineError("demux-error", "a JPEG file has no marker")
        mark = r.u(1)
        while mark == 0xFF:
            mark = r.u(1)
        if mark in (0x01, *range(0xD0, 0xD9)):
            continue
        n = r.u(2)
        if 0xC0 <= mark <= 0xCF and mark not in (0xC4, 0xC8, 0xCC):
            depth, h, w, parts = r.u(1), r.u(2), r.u(2), r.u(1)
            return Image("jpeg", w, h, 1, False, depth, {1: "gray", 3: "rgb", 4: "cmyk"}.get(parts, "unknown"))
        r.skip(n - 2)
    raise truncated("a JPEG file")


def _webp(data: bytes) -> Image:
    r, out, frames, total = Reader(data, 12, what="a WebP file"), None, 0, 0
    while r.left() >= 8:
        name, n = r.take(4), r.u(4, True)
        body = r.take(min(n, r.left()))
        if n & 1 and r.left():
            r.skip(1)
        if name == b"VP8X" and n >= 10:
            out = Image("webp", int.from_bytes(body[4:7], "little") + 1, int.from_bytes(body[7:10], "little") + 1, 1, bool(body[0] & 2), 8, "rgba" if body[0] & 0x10 else "rgb")
        elif name == b"VP8 " and out is None and n >= 10:
            out = Image("webp", int.from_bytes(body[6:8], "little") & 0x3FFF, int.from_bytes(body[8:10], "little") & 0x3FFF)
        elif name == b"VP8L" and out is None and n >= 5:
            v = int.from_bytes(body[1:5], "little")
            out = Image("webp", (v & 0x3FFF) + 1, (v >> 14 & 0x3FFF) + 1, color_type="rgba" if v >> 28 & 1 else "rgb")
        elif name == b"ANIM" and out and n >= 6:
            loops = int.from_bytes(body[4:6], "little")
            out.loop_count = math.inf if loops == 0 else float(loops)
        elif name == b"ANMF" and n >= 16:
            frames, total = frames + 1, total + int.from_bytes(body[12:15], "little")
    if out is None:
        raise truncated("a WebP file")
    if out.animated:
        out.frame_count, out.duration_sec = max(1, frames), total / 1000
    return out


def _avif(data: bytes) -> Image:
    size, depth, color = None, 8, "rgb"

    def walk(at: int, end: int) -> None:
        nonlocal size, depth, color
        for name, a, b in boxes(data, at, end):
            if name == b"meta":
                walk(a + 4, b)
            elif name in (b"iprp", b"ipco"):
                walk(a, b)
            elif name == b"ispe" and b - a >= 12 and size is None:
                size = struct.unpack(">II", data[a + 4 : a + 12])
            elif name == b"av1C" and b - a >= 4:
                depth = 12 if data[a + 2] & 0x20 else 10 if data[a + 2] & 0x40 else 8
                color = "gray" if data[a + 2] & 0x10 else "rgb"

    walk(0, len(data))
    if size is None:
        raise truncated("an AVIF file")
    return Image("avif", *size, bit_depth=depth, color_type=color)


def probe(data: bytes) -> Image:
    kind = sniff(data)
    if kind is None:
        raise InputError.bad("not a known image")
    return {"gif": _gif, "png": _png, "jpeg": _jpeg, "webp": _webp, "avif": _avif}[kind](data)
