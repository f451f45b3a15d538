"""AVI: a writer of RIFF segments with an index; packets that exceed a segment are a typed miss."""

from __future__ import annotations

import struct

from ...errors import CapabilityError
from .base import Track

LIMIT = (1 << 30) - (1 << 20)
FOURCC = {"avc1": b"H264", "vp8": b"VP80", "vp9": b"VP90", "av1": b"AV01"}
WAVE = {"mp3": 0x55, "mp4a.40.2": 0xFF}


def _list(name: bytes, body: bytes) -> bytes:
    return b"LIST" + struct.pack("<I", 4 + len(body)) + name + body


def _chunk(name: bytes, body: bytes) -> bytes:
    return name + struct.pack("<I", len(body)) + body + b"\0" * (len(body) & 1)


def segments(sizes: list[int], limit: int = LIMIT) -> list[list[int]]:
    """Indexes of chunks by RIFF segment: header, payload and padding, and 4 bytes a segment."""
    out: list[list[int]] = []
    used = 0
    for i, n in enumerate(sizes):
        wire = 8 + n + (n & 1)
        if wire > limit:
            raise CapabilityError.miss("a packet exceeds one RIFF segment", {"op": "mux", "bytes": n}, ["avi"])
        if not out or used + wire > limit:
            out.append([])
            used = 4
        out[-1].append(i)
        used += wire
    return out


def write(tracks: list[Track], payloads: list[list[bytes]], limit: int = LIMIT) -> bytes:
    names = []
    for i, t in enumerate(tracks):
        if t.codec not in FOURCC and t.codec not in WAVE and not t.codec.startswith("pcm-"):
            raise CapabilityError.miss(f"AVI can't hold {t.codec}", {"op": "mux", "container": "avi"}, ["avi"])
        names.append(f"{i:02d}".encode() + (b"dc" if t.track_kind == "video" else b"wb"))
    rows = sorted((p.pts_us if p.dts_us is None else p.dts_us, i, k) for i, t in enumerate(tracks) for k, p in enumerate(t.packets))
    video = next((t for t in tracks if t.track_kind == "video"), None)
    period = int(1e6 / video.fps + 0.5) if video and video.fps else 40_000
    streams = b""
    for t in tracks:
        if t.track_kind == "video":
            head = struct.pack("<4s4sIHHIIIIIIIIhhhh", b"vids", FOURCC[t.codec], 0, 0, 0, 0, period, 1_000_000, 0, len(t.packets), 0, 0xFFFFFFFF, 0, 0, 0, t.width or 0, t.height or 0)
            form = struct.pack("<IiiHH4sIiiII", 40, t.width or 0, t.height or 0, 1, 24, FOURCC[t.codec], 0, 0, 0, 0, 0)
        else:
            bits = 16 if t.codec.startswith("pcm-") else 0
            align = (t.channels or 2) * 2 if bits else 1
            head = struct.pack("<4sIIHHIIIIIIIIhhhh", b"auds", 0, 0, 0, 0, 0, 1, t.sample_rate or 0, 0, len(t.packets), 0, 0xFFFFFFFF, align, 0, 0, 0, 0)
            form = struct.pack("<HHIIHHH", 1 if bits else WAVE[t.codec], t.channels or 2, t.sample_rate or 0, (t.sample_rate or 0) * align, align, bits, 0)
        streams += _list(b"strl", _chunk(b"strh", head) + _chunk(b"strf", form))
    main = struct.pack("<14I", period, 0, 0, 0x10, len(video.packets) if video else 0, 0, len(tracks), 0, (video.width or 0) if video else 0, (video.height or 0) if video else 0, 0, 0, 0, 0)
    header = _list(b"hdrl", _chunk(b"avih", main) + streams)
    out = []
    for number, chosen in enumerate(segments([len(payloads[i][k]) for _, i, k in rows], limit) or [[]]):
        body, index = b"", b""
        for j in chosen:
            _, i, k = rows[j]
            index += names[i] + struct.pack("<III", 0x10 if tracks[i].packets[k].keyframe else 0, 4 + len(body), len(payloads[i][k]))
            body += _chunk(names[i], payloads[i][k])
        parts = (header if number == 0 else b"") + _list(b"movi", body) + (_chunk(b"idx1", index) if number == 0 else b"")
        name = b"AVI " if number == 0 else b"AVIX"
        out.append(b"RIFF" + struct.pack("<I", 4 + len(parts)) + name + parts)
    return b"".join(out)
