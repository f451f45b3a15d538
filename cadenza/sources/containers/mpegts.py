"""MPEG transport streams: PAT, PMT, PES access units, and a writer with PCR."""

from __future__ import annotations

import re

from ...errors import CapabilityError, EngineError, InputError
from ...functions import crypto
from .base import Movie, Packet, Track, crc32_mpeg2

SYNC, SIZE, CLOCK = 0x47, 188, 90_000
#: Stream types; the last two are the protected forms of SAMPLE-AES.
TYPES = {0x1B: ("video", "avc1"), 0x24: ("video", "hvc1"), 0x0F: ("audio", "mp4a.40.2"), 0x03: ("audio", "mp3"), 0x04: ("audio", "mp3"), 0xDB: ("video", "avc1"), 0xCF: ("audio", "mp4a.40.2")}


def _us(ticks: int) -> int:
    return (ticks * 1_000_000 * 2 + CLOCK) // (2 * CLOCK)


def packets(data: bytes):
    """(pid, unit start, payload, random access) of each 188-byte packet."""
    if len(data) < SIZE or data[0] != SYNC:
        raise InputError.bad("not a transport stream")
    for at in range(0, len(data) - SIZE + 1, SIZE):
        if data[at] != SYNC:
            raise EngineError("demux-error", f"lost transport sync at {at}")
        pid, control = (data[at + 1] & 0x1F) << 8 | data[at + 2], data[at + 3] >> 4 & 3
        begin, random = at + 4, False
        if control & 2:
            random = bool(data[at + 4] and data[at + 5] & 0x40)
            begin += 1 + data[at + 4]
        if control & 1 and begin < at + SIZE:
            yield pid, bool(data[at + 1] & 0x40), data[begin : at + SIZE], random


def _section(payload: bytes) -> bytes:
    p = payload[1 + payload[0] :]
    size = (p[1] & 15) << 8 | p[2] if len(p) >= 3 else 0
    if len(p) < 3 + size or size < 9:
        raise EngineError("demux-error", "a transport table is cut off")
    if crc32_mpeg2(p[: 3 + size]):
        raise EngineError("demux-error", "a transport table's checksum differs")
    return p[8 : 3 + size - 4]


def _stamp(b: bytes) -> int:
    return (b[0] >> 1 & 7) << 30 | b[1] << 22 | (b[2] >> 1) << 15 | b[3] << 7 | b[4] >> 1


def _is_key(codec: str, data: bytes) -> bool:
    at = data.find(b"\0\0\1")
    while 0 <= at < len(data) - 3:
        kind = data[at + 3] & 0x1F if codec == "avc1" else data[at + 3] >> 1 & 0x3F
        if (codec == "avc1" and kind == 5) or (codec == "hvc1" and 16 <= kind <= 21):
            return True
        at = data.find(b"\0\0\1", at + 3)
    return False


def movie(data: bytes) -> Movie:
    programs, streams, held, units = set(), {}, {}, {}

    def close(pid: int) -> None:
        if pid in held:
            units.setdefault(pid, []).append(b"".join(held.pop(pid)))

    for pid, start, payload, _ in packets(data):
        if pid == 0 and start:
            s = _section(payload)
            programs |= {(s[i + 2] & 0x1F) << 8 | s[i + 3] for i in range(0, len(s) - 3, 4) if s[i] or s[i + 1]}
        elif pid in programs and start:
            s = _section(payload)
            at = 4 + ((s[2] & 15) << 8 | s[3])
            while at + 5 <= len(s):
                if s[at] in TYPES:
                    streams[(s[at + 1] & 0x1F) << 8 | s[at + 2]] = TYPES[s[at]]
                at += 5 + ((s[at + 3] & 15) << 8 | s[at + 4])
        elif pid in streams:
            if start:
                close(pid)
                held[pid] = [payload]
            elif pid in held:
                held[pid].append(payload)
    for pid in list(held):
        close(pid)
    tracks = []
    for i, (pid, (kind, codec)) in enumerate(sorted(streams.items())):
        t, wraps, last, raw = Track(i + 1, kind, codec, CLOCK), 0, None, []
        for pes in units.get(pid, []):
            if len(pes) < 9 or pes[:3] != b"\0\0\1":
                raise EngineError("demux-error", "a PES packet has no start code")
            flags, head = pes[7] >> 6, 9 + pes[8]
            if not flags & 2 or len(pes) < 14:
                continue
            pts = _stamp(pes[9:14])
            dts = _stamp(pes[14:19]) if flags == 3 and len(pes) >= 19 else pts
            if last is not None and last - dts > 1 << 32:  # 33 bits have run over, in decode order
                wraps += 1
            last = dts
            declared = pes[4] << 8 | pes[5]
            body = pes[head : 6 + declared] if declared else pes[head:]
            lift = wraps << 33
            raw.append((pts + lift + ((1 << 33) if pts < dts - (1 << 32) else 0), dts + lift, body))
        shown = sorted(p for p, _, _ in raw)
        gaps = sorted(b - a for a, b in zip(shown, shown[1:], strict=False))
        nominal = gaps[len(gaps) // 2] if gaps else 0
        following = dict(zip(shown, shown[1:], strict=False))
        for pts, dts, body in raw:
            t.packets.append(Packet(None, len(body), _us(pts), _us(dts), _us(following.get(pts, pts + nominal) - pts), kind == "audio" or _is_key(codec, body), body))
        if len(shown) > 1 and shown[-1] > shown[0]:
            t.duration_sec = (shown[-1] - shown[0] + nominal) / CLOCK
        tracks.append(t)
    if not tracks:
        raise EngineError("demux-error", "no known stream in the transport stream")
    spans = [(min(p.pts_us for p in t.packets), max(p.pts_us for p in t.packets), min(p.duration_us for p in t.packets)) for t in tracks if len(t.packets) > 1]
    whole = (max(b for _, b, _ in spans) - min(a for a, _, _ in spans) + min((g for *_, g in spans if g > 0), default=0)) / 1e6 if spans else 0.0
    return Movie("ts", tracks, whole)


def decrypted_sample_aes(data: bytes, key: bytes, iv: bytes) -> bytes:
    """A SAMPLE-AES transport stream as a clear one; every NAL unit and every ADTS frame begins at the IV."""
    m = movie(data)
    clear = []
    for t in m.tracks:
        if t.track_kind == "video":
            clear.append([b"".join(code + crypto.sample_aes_nal(key, iv, nal) for code, nal in nal_units(p.data)) for p in t.packets])
        else:
            clear.append([b"".join(crypto.sample_aes_audio(key, iv, frame, 7 if frame[1] & 1 else 9) for frame in adts_frames(p.data)) if t.codec.startswith("mp4a") else p.data for p in t.packets])
    return write(m.tracks, clear)


def nal_units(data: bytes) -> list[tuple[bytes, bytes]]:
    """(start code, unit) of an Annex B byte stream; what stands before the first start code belongs to none."""
    at = [x.start() for x in re.finditer(b"\0\0\1", data)]
    out = []
    for k, a in enumerate(at):
        end = at[k + 1] if k + 1 < len(at) else len(data)
        if k + 1 < len(at) and end > a + 3 and data[end - 1] == 0:
            end -= 1  # the zero of a four-byte start code
        out.append((b"\0\0\0\1" if a and data[a - 1] == 0 else b"\0\0\1", data[a + 3 : end]))
    return out


def adts_frames(data: bytes) -> list[bytes]:
    out, at = [], 0
    while at + 7 <= len(data):
        size = (data[at + 3] & 3) << 11 | data[at + 4] << 3 | data[at + 5] >> 5
        if data[at] != 0xFF or data[at + 1] & 0xF6 != 0xF0 or size < 7 or at + size > len(data):
            raise EngineError("demux-error", "no whole ADTS frame where one must be")
        out.append(data[at : at + size])
        at += size
    return out


class _Out:
    def __init__(self) -> None:
        self.parts: list[bytes] = []
        self.counters: dict[int, int] = {}

    def packet(self, pid: int, start: bool, payload: bytes, pcr: int | None = None, key: bool = False) -> int:
        """One packet with as much of the payload as fits; returns how much."""
        field = b"" if pcr is None and not key else bytes([(0x10 if pcr is not None else 0) | (0x40 if key else 0)])
        if pcr is not None:
            field += ((pcr & (1 << 33) - 1) << 15 | 0x7E00).to_bytes(6, "big")
        room = SIZE - 4 - (1 + len(field) if field else 0)
        n = min(room, len(payload))
        if n < room:
            stuff = room - n
            if not field:
                adaptation = bytes([stuff - 1]) + (b"\0" + b"\xff" * (stuff - 2) if stuff > 1 else b"")
            else:
                adaptation = bytes([len(field) + stuff]) + field + b"\xff" * stuff
        else:
            adaptation = bytes([len(field)]) + field if field else b""
        count = self.counters.get(pid, 0)
        self.counters[pid] = (count + 1) & 15
        self.parts.append(bytes([SYNC, (0x40 if start else 0) | pid >> 8, pid & 0xFF, (0x30 if adaptation else 0x10) | count]) + adaptation + payload[:n])
        return n

    def section(self, pid: int, table: int, number: int, body: bytes) -> None:
        s = bytes([table, 0xB0 | (len(body) + 9) >> 8, (len(body) + 9) & 0xFF]) + number.to_bytes(2, "big") + b"\xc1\0\0" + body
        payload = b"\0" + s + crc32_mpeg2(s).to_bytes(4, "big")
        self.packet(pid, True, payload + b"\xff" * (SIZE - 4 - len(payload)))


def _stamp_bytes(mark: int, v: int) -> bytes:
    v &= (1 << 33) - 1
    return bytes([mark << 4 | v >> 29 & 14 | 1, v >> 22 & 0xFF, v >> 14 & 0xFE | 1, v >> 7 & 0xFF, v << 1 & 0xFE | 1])


def write(tracks: list[Track], payloads: list[list[bytes]]) -> bytes:
    """Units in order of (dts, pts, pid), all times shifted so that none is negative."""
    kinds = {v[1]: k for k, v in reversed(TYPES.items())}
    for t in tracks:
        if t.codec not in kinds:
            raise CapabilityError.miss(f"a transport stream can't hold {t.codec}", {"op": "mux", "container": "ts"}, ["ts"])
    out = _Out()
    out.section(0, 0, 1, (1).to_bytes(2, "big") + (0xE000 | 0x1000).to_bytes(2, "big"))
    pids = [0x100 + i for i in range(len(tracks))]
    body = (0xE000 | pids[0]).to_bytes(2, "big") + b"\xf0\0" + b"".join(bytes([kinds[t.codec]]) + (0xE000 | pid).to_bytes(2, "big") + b"\xf0\0" for t, pid in zip(tracks, pids, strict=True))
    out.section(0x1000, 2, 1, body)
    rows = [(p.pts_us if p.dts_us is None else p.dts_us, p.pts_us, pid, p, data, t) for t, pid, ps in zip(tracks, pids, payloads, strict=True) for p, data in zip(t.packets, ps, strict=True)]
    low = min([0, *(min(d, p) for d, p, *_ in rows)])
    ticks = lambda v: ((v - low) * CLOCK * 2 + 1_000_000) // 2_000_000
    for dts, pts, pid, p, data, t in sorted(rows, key=lambda r: r[:3]):
        stamps = _stamp_bytes(2, ticks(pts)) if pts == dts else _stamp_bytes(3, ticks(pts)) + _stamp_bytes(1, ticks(dts))
        pes = bytes([0x80, 0x80 if pts == dts else 0xC0, len(stamps)]) + stamps + data
        size = len(pes) if t.track_kind == "audio" and len(pes) < 1 << 16 else 0
        pes = b"\0\0\1" + bytes([0xE0 if t.track_kind == "video" else 0xC0]) + size.to_bytes(2, "big") + pes
        at = out.packet(pid, True, pes, ticks(dts) if pid == pids[0] else None, p.keyframe)
        while at < len(pes):
            at += out.packet(pid, False, pes[at:])
    return b"".join(out.parts)
