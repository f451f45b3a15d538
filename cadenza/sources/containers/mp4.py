"""ISO-BMFF (MP4, MOV, M4A): box tree, sample tables, fragments, protection, and writers."""

from __future__ import annotations

import struct
from dataclasses import dataclass, field

from ...errors import CapabilityError, InputError, EngineError
from ...functions import crypto
from .base import Movie, Packet, Track, truncated, us

CONTAINERS = {b"moov", b"trak", b"mdia", b"minf", b"stbl", b"edts", b"dinf", b"mvex", b"moof", b"traf", b"udta", b"sinf", b"schi"}
#: Sample entries and the names used here.
ENTRIES = {b"avc1": "avc1", b"avc3": "avc1", b"hvc1": "hvc1", b"hev1": "hvc1", b"vp08": "vp8", b"vp09": "vp9", b"av01": "av1", b"mp4a": "mp4a.40.2", b"Opus": "opus", b"fLaC": "flac", b".mp3": "mp3"}
CONFIG_BOX = {"avc1": b"avcC", "hvc1": b"hvcC", "vp9": b"vpcC", "vp8": b"vpcC", "av1": b"av1C", "mp4a.40.2": b"esds", "opus": b"dOps", "flac": b"dfLa"}
#: iTunes atoms of the public tag names.
ILST = {"title": b"\xa9nam", "artist": b"\xa9ART", "album": b"\xa9alb", "albumArtist": b"aART", "comment": b"\xa9cmt", "date": b"\xa9day", "genre": b"\xa9gen", "description": b"desc"}
MOVIE_SCALE = 1000


@dataclass
class Protection:
    scheme: str
    kid: bytes
    iv_size: int
    constant_iv: bytes
    pattern: tuple[int, int]
    samples: list[tuple[bytes, list[tuple[int, int]]]] = field(default_factory=list)


def boxes(data: bytes, at: int, end: int):
    """(type, where its body begins, where it ends)."""
    while at + 8 <= end:
        size, name, head = int.from_bytes(data[at : at + 4], "big"), data[at + 4 : at + 8], 8
        if size == 1:
            if at + 16 > end:
                raise truncated("a box")
            size, head = int.from_bytes(data[at + 8 : at + 16], "big"), 16
        elif size == 0:
            size = end - at
        if size < head or at + size > end:
            raise truncated(f"box {name!r}")
        yield name, at + head, at + size
        at += size


class Box:
    """The children of a box by type, first ones first."""

    def __init__(self, data: bytes, at: int, end: int, depth: int = 0) -> None:
        if depth > 16:
            raise EngineError("demux-error", "boxes are nested too deeply")
        self.data, self.at, self.end = data, at, end
        self.kids: list[tuple[bytes, int, int]] = list(boxes(data, at, end))
        self.depth = depth

    def all(self, name: bytes) -> list[Box | bytes]:
        return [Box(self.data, a, b, self.depth + 1) if name in CONTAINERS else self.data[a:b] for n, a, b in self.kids if n == name]

    def get(self, *path: bytes):
        found = self.all(path[0])
        if not found or len(path) == 1:
            return found[0] if found else None
        return found[0].get(*path[1:])


def _table(body: bytes | None, size: int, signed: bool = False) -> list[tuple[int, ...]]:
    """Rows of 32-bit numbers of a full box."""
    if body is None:
        return []
    if len(body) < 8:
        raise truncated("a sample table")
    n = int.from_bytes(body[4:8], "big")
    if len(body) < 8 + 4 * size * n:
        raise truncated("a sample table")
    v = struct.unpack(f">{n * size}{'i' if signed else 'I'}", body[8 : 8 + 4 * size * n])
    return [v[i : i + size] for i in range(0, len(v), size)]


def _runs(rows: list[tuple[int, int]], n: int, default: int = 0) -> list[int]:
    """Run-length rows (count, value) as n values; the last goes on."""
    out: list[int] = []
    for count, value in rows:
        out += [value] * min(count, n - len(out))
    return out + [out[-1] if out else default] * (n - len(out))


def sample_tables(stbl: Box) -> dict:
    """The run-length tables as they stand, in the shape of the relational expansion."""
    raw = stbl.get(b"stsz")
    if raw is None or len(raw) < 12:
        raise EngineError("demux-error", "a track has no sample sizes")
    fixed, n = struct.unpack(">II", raw[4:12])
    if not fixed and len(raw) < 12 + 4 * n:
        raise truncated("a sample table")
    if fixed and n * fixed > 1 << 40:
        raise EngineError("demux-error", "a track has too many samples")
    sizes = [fixed] * n if fixed else list(struct.unpack(f">{n}I", raw[12 : 12 + 4 * n]))
    ctts = stbl.get(b"ctts")
    wide = stbl.get(b"co64")
    if wide is not None:
        m = int.from_bytes(wide[4:8], "big")
        if len(wide) < 8 + 8 * m:
            raise truncated("a sample table")
        offsets = list(struct.unpack(f">{m}Q", wide[8 : 8 + 8 * m]))
    else:
        offsets = [v for (v,) in _table(stbl.get(b"stco"), 1)]
    stss = stbl.get(b"stss")
    return {
        "stts": _table(stbl.get(b"stts"), 2), "ctts": _table(ctts, 2, ctts is not None and ctts[0] == 1), "stsz": sizes,
        "stsc": [r[:2] for r in _table(stbl.get(b"stsc"), 3)], "stco": offsets, "stss": [v for (v,) in _table(stss, 1)] if stss is not None else [],
    }


def _expand(t: Track, st: dict, edit: int) -> None:
    sizes = st["stsz"]
    deltas, offsets = _runs(st["stts"], len(sizes)), _runs(st["ctts"], len(sizes))
    sync, i, dts, per, entry = set(st["stss"]), 0, 0, 0, 0
    for c, at in enumerate(st["stco"], 1):
        while entry < len(st["stsc"]) and st["stsc"][entry][0] <= c:
            per, entry = st["stsc"][entry][1], entry + 1
        for _ in range(min(per, len(sizes) - i)):
            t.packets.append(Packet(at, sizes[i], us(dts + offsets[i] - edit, t.timescale), us(dts, t.timescale), us(deltas[i], t.timescale), not sync or i + 1 in sync))
            at, dts, i = at + sizes[i], dts + deltas[i], i + 1


def _protection(sinf: Box) -> tuple[bytes, Protection]:
    frma, schm, tenc = sinf.get(b"frma") or b"", sinf.get(b"schm") or b"", sinf.get(b"schi", b"tenc") if sinf.get(b"schi") else b""
    if not tenc or len(tenc) < 24:
        raise EngineError("demux-error", "a protected track has no tenc")
    pattern = (tenc[5] >> 4, tenc[5] & 15) if tenc[0] else (0, 0)
    constant = tenc[25 : 25 + tenc[24]] if tenc[7] == 0 and len(tenc) > 24 else b""
    return frma[:4], Protection(schm[4:8].decode("latin1"), tenc[8:24], tenc[7], constant, pattern)


def _senc(body: bytes, p: Protection) -> None:
    flags, n, at = body[3], int.from_bytes(body[4:8], "big"), 8
    for _ in range(min(n, len(body))):
        iv, at = body[at : at + p.iv_size], at + p.iv_size
        subs = []
        if flags & 2:
            m, at = int.from_bytes(body[at : at + 2], "big"), at + 2
            subs = [struct.unpack(">HI", body[at + 6 * k : at + 6 * k + 6]) for k in range(m) if at + 6 * k + 6 <= len(body)]
            at += 6 * m
        if at > len(body):
            raise truncated("senc")
        p.samples.append((iv, subs))


def parse(data: bytes) -> tuple[Movie, dict[int, Protection]]:
    top = Box(data, 0, len(data))
    if not any(n in (b"ftyp", b"moov") for n, *_ in top.kids):
        raise InputError.bad("not an MP4 file")
    moov = top.get(b"moov")
    if moov is None:
        raise EngineError("demux-error", "an MP4 file has no moov box")
    mvhd = moov.get(b"mvhd") or b""
    wide = bool(mvhd and mvhd[0])
    movie_scale = int.from_bytes(mvhd[20:24] if wide else mvhd[12:16], "big") or MOVIE_SCALE
    tracks, protections, brand = {}, {}, data[8:12]
    for trak in moov.all(b"trak"):
        tkhd, mdhd, hdlr, stbl = trak.get(b"tkhd"), trak.get(b"mdia", b"mdhd"), trak.get(b"mdia", b"hdlr"), trak.get(b"mdia", b"minf", b"stbl")
        if tkhd is None or mdhd is None or hdlr is None or stbl is None:
            raise EngineError("demux-error", "a track lacks a box")
        kind = {b"vide": "video", b"soun": "audio"}.get(hdlr[8:12], "other")
        number = int.from_bytes(tkhd[20:24] if tkhd[0] else tkhd[12:16], "big")
        scale = int.from_bytes(mdhd[20:24] if mdhd[0] else mdhd[12:16], "big")
        length = int.from_bytes(mdhd[24:32] if mdhd[0] else mdhd[16:20], "big")
        t = Track(number, kind, "unknown", scale, length / scale if scale else None)
        matrix = struct.unpack(">9i", tkhd[52:88] if tkhd[0] else tkhd[40:76]) if len(tkhd) >= (88 if tkhd[0] else 76) else (1 << 16, 0, 0, 0, 1 << 16, 0, 0, 0, 0)
        t.rotation = {(0, 1): 90, (-1, 0): 180, (0, -1): 270}.get((matrix[0] >> 16, matrix[1] >> 16), 0)
        stsd = stbl.get(b"stsd") or b""
        if len(stsd) >= 16:
            name, a, b = next(iter(boxes(stsd, 8, len(stsd))))
            skip = 78 if kind == "video" else 28
            if kind == "video" and b - a >= 78:
                t.width, t.height = struct.unpack(">HH", stsd[a + 24 : a + 28])
            elif kind == "audio" and b - a >= 28:
                t.channels, t.sample_rate = int.from_bytes(stsd[a + 16 : a + 18], "big"), int.from_bytes(stsd[a + 24 : a + 26], "big")
            inner = {n: (x, y) for n, x, y in boxes(stsd, a + skip, b)} if b - a > skip else {}
            if name in (b"encv", b"enca") and b"sinf" in inner:
                name, protections[number] = _protection(Box(stsd, *inner[b"sinf"]))
                t.encrypted = True
            t.codec = ENTRIES.get(name, name.decode("latin1"))
            if CONFIG_BOX.get(t.codec) in inner:
                t.config = stsd[slice(*inner[CONFIG_BOX[t.codec]])]
        edit = 0
        elst = trak.get(b"edts", b"elst") if trak.get(b"edts") else None
        if elst is not None and len(elst) >= 20:
            n, step = int.from_bytes(elst[4:8], "big"), 20 if elst[0] else 12
            for k in range(n):
                row = elst[8 + k * step : 8 + (k + 1) * step]
                if len(row) < step:
                    break
                span, begin = struct.unpack(">Qq" if elst[0] else ">Ii", row[: step - 4])
                if begin >= 0:
                    edit += begin
                    break
                edit -= span * scale // movie_scale
        _expand(t, sample_tables(stbl), edit)
        if number in protections and stbl.get(b"senc") is not None:
            _senc(stbl.get(b"senc"), protections[number])
        tracks[number] = t
    _fragments(data, top, moov, tracks, protections)
    for t in tracks.values():
        if t.packets and not t.duration_sec:
            t.duration_sec = max(p.pts_us + (p.duration_us or 0) for p in t.packets) / 1e6
        if t.track_kind == "video" and len(t.packets) > 1:
            span = sum(p.duration_us or 0 for p in t.packets)
            t.fps = len(t.packets) * 1e6 / span if span else None
    longest = max((t.duration_sec or 0 for t in tracks.values()), default=0)
    return Movie("mov" if brand == b"qt  " else "mp4", list(tracks.values()), longest, _read_tags(moov)), protections


def _fragments(data: bytes, top: Box, moov: Box, tracks: dict[int, Track], protections: dict[int, Protection]) -> None:
    mvex = moov.get(b"mvex")
    defaults = {int.from_bytes(x[4:8], "big"): struct.unpack(">IIII", x[8:24]) for x in (mvex.all(b"trex") if mvex else []) if len(x) >= 24}
    clock = {n: 0 for n in tracks}
    for name, a, b in top.kids:
        if name != b"moof":
            continue
        moof = Box(data, a, b)
        for traf in moof.all(b"traf"):
            tfhd = traf.get(b"tfhd")
            if tfhd is None or len(tfhd) < 8:
                raise EngineError("demux-error", "a fragment has no header")
            flags, number, at = int.from_bytes(tfhd[1:4], "big"), int.from_bytes(tfhd[4:8], "big"), 8
            t = tracks.get(number)
            if t is None:
                continue
            _, length, size, sample_flags = defaults.get(number, (1, 0, 0, 0))
            base = a - 8
            for bit, width in ((1, 8), (2, 4), (8, 4), (16, 4), (32, 4)):
                if flags & bit:
                    v, at = int.from_bytes(tfhd[at : at + width], "big"), at + width
                    base, length, size, sample_flags = (v if bit == 1 else base), (v if bit == 8 else length), (v if bit == 16 else size), (v if bit == 32 else sample_flags)
            tfdt = traf.get(b"tfdt")
            if tfdt is not None:
                clock[number] = int.from_bytes(tfdt[4:12] if tfdt[0] else tfdt[4:8], "big")
            place = base
            for trun in traf.all(b"trun"):
                bits, n, p = int.from_bytes(trun[1:4], "big"), int.from_bytes(trun[4:8], "big"), 8
                if bits & 1:
                    place, p = base + int.from_bytes(trun[p : p + 4], "big", signed=True), p + 4
                first = None
                if bits & 4:
                    first, p = int.from_bytes(trun[p : p + 4], "big"), p + 4
                step = 4 * bin(bits & 0xF00).count("1")
                if len(trun) < p + step * n:
                    raise truncated("a fragment run")
                for k in range(n):
                    d, s, f, c = length, size, sample_flags if k or first is None else first, 0
                    for bit in (0x100, 0x200, 0x400, 0x800):
                        if bits & bit:
                            v, p = int.from_bytes(trun[p : p + 4], "big", signed=bit == 0x800 and trun[0] == 1), p + 4
                            d, s, f, c = (v if bit == 0x100 else d), (v if bit == 0x200 else s), (v if bit == 0x400 else f), (v if bit == 0x800 else c)
                    now = clock[number]
                    t.packets.append(Packet(place, s, us(now + c, t.timescale), us(now, t.timescale), us(d, t.timescale), not f & 0x10000))
                    place, clock[number] = place + s, now + d
            if number in protections and traf.get(b"senc") is not None:
                _senc(traf.get(b"senc"), protections[number])


def movie(data: bytes) -> Movie:
    return parse(data)[0]


def decrypted(data: bytes, keys: dict[bytes, bytes], continuous: bool = False) -> dict[int, list[bytes]]:
    """Clear payloads by track; a missing key is a typed error, a sample without protection data passes."""
    found, protections = parse(data)
    out = {}
    for t in found.tracks:
        p = protections.get(t.track_id)
        clear = [t.payload(x, data) for x in t.packets]
        if p is not None:
            if p.kid not in keys:
                raise CapabilityError.miss(f"no key for {p.kid.hex()}", {"op": "decrypt", "scheme": p.scheme}, [k.hex() for k in keys])
            for i in range(len(clear)):
                iv, subs = p.samples[i] if i < len(p.samples) else (b"", [])
                if iv or p.constant_iv:
                    clear[i] = crypto.decrypt_sample(p.scheme, keys[p.kid], iv or p.constant_iv, clear[i], subs or None, p.pattern, continuous)
        out[t.track_id] = clear
    return out


# ---- writing


def box(name: bytes, *body: bytes) -> bytes:
    b = b"".join(body)
    return struct.pack(">I", 8 + len(b)) + name + b


def full(name: bytes, version: int, flags: int, *body: bytes) -> bytes:
    return box(name, struct.pack(">I", version << 24 | flags), *body)


def encode_runs(values: list[int]) -> list[tuple[int, int]]:
    out: list[list[int]] = []
    for v in values:
        if out and out[-1][1] == v:
            out[-1][0] += 1
        else:
            out.append([1, v])
    return [tuple(x) for x in out]


def _rows(rows: list[tuple[int, ...]], kind: str = "I") -> bytes:
    return struct.pack(">I", len(rows)) + b"".join(struct.pack(f">I{kind}" if len(r) == 2 else f">{len(r)}I", *r) for r in rows)


_MATRIX = {0: (1, 0, 0, 1), 90: (0, 1, -1, 0), 180: (-1, 0, 0, -1), 270: (0, -1, 1, 0)}


def _entry(t: Track) -> bytes:
    names = {v: k for k, v in reversed(ENTRIES.items())}
    if t.codec not in names:
        raise CapabilityError.miss(f"MP4 can't hold {t.codec}", {"op": "mux", "container": "mp4"}, ["mp4"])
    config = box(CONFIG_BOX[t.codec], t.config) if t.config and t.codec in CONFIG_BOX else b""
    if t.track_kind == "video":
        body = bytes(6) + struct.pack(">H", 1) + bytes(16) + struct.pack(">HHIIIH", t.width or 0, t.height or 0, 0x480000, 0x480000, 0, 1) + bytes(32) + struct.pack(">Hh", 24, -1)
    else:
        body = bytes(6) + struct.pack(">H", 1) + bytes(8) + struct.pack(">HHHHI", t.channels or 2, 16, 0, 0, (t.sample_rate or 0) << 16)
    return box(names[t.codec], body, config)


def _timing(t: Track) -> tuple[list[int], list[int], int]:
    """Durations and composition offsets in ticks, and the length."""
    ticks = lambda v: (v * t.timescale * 2 + 1_000_000) // 2_000_000
    ps = t.packets
    if all(p.dts_us is not None for p in ps):
        stops = [p.dts_us for p in ps[1:]] + [ps[-1].dts_us + (ps[-1].duration_us or 0)] if ps else []
        at = [ticks(p.dts_us) for p in ps]
        durations = [max(0, ticks(b) - a) for a, b in zip(at, stops, strict=True)]
        offsets = [ticks(p.pts_us) - a for p, a in zip(ps, at, strict=True)]
    else:
        if any(p.duration_us is None for p in ps):
            shown = sorted(range(len(ps)), key=lambda i: (ps[i].pts_us, i))
            gaps = [ps[b].pts_us - ps[a].pts_us for a, b in zip(shown, shown[1:], strict=False)]
            gaps.append(gaps[-1] if gaps else 0)
            lengths = dict(zip(shown, gaps, strict=True))
            durations_us = [lengths[i] for i in range(len(ps))]
        else:
            durations_us = [p.duration_us for p in ps]
        low, now, offsets, durations = min((p.pts_us for p in ps), default=0), 0, [], []
        for p, d in zip(ps, durations_us, strict=True):
            offsets.append(ticks(p.pts_us - low - now))
            durations.append(ticks(d))
            now += d
    return durations, offsets, sum(durations)


def _trak(t: Track, stbl: bytes, length: int) -> bytes:
    a, b, c, d = _MATRIX[t.rotation]
    matrix = struct.pack(">9i", a << 16, b << 16, 0, c << 16, d << 16, 0, 0, 0, 1 << 30)
    shown = length * MOVIE_SCALE // max(1, t.timescale)
    video = t.track_kind == "video"
    tkhd = full(b"tkhd", 0, 3, struct.pack(">IIIII", 0, 0, t.track_id, 0, shown), bytes(8), struct.pack(">hhhh", 0, 0, 0 if video else 0x100, 0), matrix, struct.pack(">II", (t.width or 0) << 16, (t.height or 0) << 16))
    mdhd = full(b"mdhd", 0, 0, struct.pack(">IIIIHH", 0, 0, t.timescale, length, 0x55C4, 0))
    hdlr = full(b"hdlr", 0, 0, bytes(4), b"vide" if video else b"soun", bytes(12), b"cadenza\0")
    head = full(b"vmhd", 0, 1, bytes(8)) if video else full(b"smhd", 0, 0, bytes(4))
    dinf = box(b"dinf", full(b"dref", 0, 0, struct.pack(">I", 1), full(b"url ", 0, 1)))
    return box(b"trak", tkhd, box(b"mdia", mdhd, hdlr, box(b"minf", head, dinf, stbl)))


def _moov(traks: list[bytes], length: int, tags: dict[str, str] | None, *more: bytes) -> bytes:
    mvhd = full(b"mvhd", 0, 0, struct.pack(">IIIIIH", 0, 0, MOVIE_SCALE, length, 1 << 16, 1 << 8), bytes(10), struct.pack(">9i", 1 << 16, 0, 0, 0, 1 << 16, 0, 0, 0, 1 << 30), bytes(24), struct.pack(">I", len(traks) + 1))
    return box(b"moov", mvhd, *traks, *more, _tag_box(tags) if tags else b"")


def write(tracks: list[Track], payloads: list[list[bytes]], container: str = "mp4", tags: dict[str, str] | None = None) -> bytes:
    """Header first; payloads interleaved by decode time, one chunk for each run of a track."""
    order = sorted(((p.pts_us if p.dts_us is None else p.dts_us, i, k) for i, t in enumerate(tracks) for k, p in enumerate(t.packets)))
    runs: list[tuple[int, list[int]]] = []
    for _, i, k in order:
        if runs and runs[-1][0] == i and len(runs[-1][1]) < 64:
            runs[-1][1].append(k)
        else:
            runs.append((i, [k]))
    for t, (i, ks) in ((tracks[r[0]], r) for r in runs):
        if ks != sorted(ks):
            raise EngineError("mux-error", f"track {t.track_id} ({i}) isn't in decode order")
    brand = b"qt  " if container == "mov" else b"isom"
    ftyp = box(b"ftyp", brand, struct.pack(">I", 512), brand, b"iso2", b"mp41")
    timing = [_timing(t) for t in tracks]

    def header(start: int) -> bytes:
        at, chunks = start, [[] for _ in tracks]
        for i, ks in runs:
            chunks[i].append((at, len(ks)))
            at += sum(len(payloads[i][k]) for k in ks)
        traks = []
        for t, ps, found, (durations, offsets, length) in zip(tracks, payloads, chunks, timing, strict=True):
            per, last = [], None
            for c, (_, n) in enumerate(found, 1):
                if n != last:
                    per.append((c, n, 1))
                    last = n
            wide = at > 0xFFFFFFFF
            stbl = [full(b"stsd", 0, 0, struct.pack(">I", 1), _entry(t)), full(b"stts", 0, 0, _rows(encode_runs(durations)))]
            if any(offsets):
                stbl.append(full(b"ctts", 1, 0, _rows(encode_runs(offsets), "i")))
            if t.track_kind == "video" and not all(p.keyframe for p in t.packets):
                stbl.append(full(b"stss", 0, 0, _rows([(k + 1,) for k, p in enumerate(t.packets) if p.keyframe])))
            stbl += [full(b"stsc", 0, 0, _rows(per)), full(b"stsz", 0, 0, struct.pack(">II", 0, len(ps)), b"".join(struct.pack(">I", len(x)) for x in ps))]
            stbl.append(full(b"co64" if wide else b"stco", 0, 0, struct.pack(">I", len(found)), b"".join(struct.pack(">Q" if wide else ">I", a) for a, _ in found)))
            traks.append(_trak(t, box(b"stbl", *stbl), length))
        longest = max((length * MOVIE_SCALE // max(1, t.timescale) for t, (_, _, length) in zip(tracks, timing, strict=True)), default=0)
        return ftyp + _moov(traks, longest, tags)

    size = len(header(0))
    body = b"".join(payloads[i][k] for i, ks in runs for k in ks)
    return header(size + 8) + struct.pack(">I", 8 + len(body)) + b"mdat" + body


def fragments(tracks: list[Track], payloads: list[list[bytes]], most: int = 90) -> list[bytes]:
    """An init segment and then moof/mdat pairs: video breaks at keyframes and after `most`, audio after `most`."""
    if not tracks or any(not t.packets for t in tracks):
        raise EngineError("mux-error", "fragments need tracks with samples")
    empty = lambda t: box(b"stbl", full(b"stsd", 0, 0, struct.pack(">I", 1), _entry(t)), *(full(n, 0, 0, bytes(4)) for n in (b"stts", b"stsc")), full(b"stsz", 0, 0, bytes(8)), full(b"stco", 0, 0, bytes(4)))
    mvex = box(b"mvex", *(full(b"trex", 0, 0, struct.pack(">IIIII", t.track_id, 1, 0, 0, 0)) for t in tracks))
    out = [box(b"ftyp", b"iso5", struct.pack(">I", 512), b"iso5", b"iso6", b"mp41") + _moov([_trak(t, empty(t), 0) for t in tracks], 0, None, mvex)]
    pieces = []
    for i, t in enumerate(tracks):
        durations, offsets, _ = _timing(t)
        begin = 0
        for k in range(1, len(t.packets) + 1):
            if k == len(t.packets) or k - begin >= most or (t.track_kind == "video" and t.packets[k].keyframe):
                p = t.packets[begin]
                pieces.append((p.pts_us if p.dts_us is None else p.dts_us, i, begin, k, sum(durations[:begin]), durations, offsets))
                begin = k
    for number, (_, i, a, b, clock, durations, offsets) in enumerate(sorted(pieces, key=lambda x: x[:3]), 1):
        t = tracks[i]
        rows = b"".join(struct.pack(">IIIi", durations[k], len(payloads[i][k]), 0x02000000 if t.packets[k].keyframe else 0x01010000, offsets[k]) for k in range(a, b))

        def moof(at: int, number=number, t=t, a=a, b=b, clock=clock, rows=rows) -> bytes:
            trun = full(b"trun", 1, 0xF01, struct.pack(">Ii", b - a, at), rows)
            return box(b"moof", full(b"mfhd", 0, 0, struct.pack(">I", number)), box(b"traf", full(b"tfhd", 0, 0x20000, struct.pack(">I", t.track_id)), full(b"tfdt", 1, 0, struct.pack(">Q", clock)), trun))

        out.append(moof(len(moof(0)) + 8) + box(b"mdat", *payloads[i][a:b]))
    return out


def _tag_box(tags: dict[str, str]) -> bytes:
    items = []
    for k, v in tags.items():
        data = full(b"data", 0, 1, bytes(4), v.encode())
        if k in ILST:
            items.append(box(ILST[k], data))
        else:
            items.append(box(b"----", full(b"mean", 0, 0, b"com.apple.iTunes"), full(b"name", 0, 0, k.encode()), data))
    meta = full(b"meta", 0, 0, full(b"hdlr", 0, 0, bytes(4), b"mdir", b"appl", bytes(9)), box(b"ilst", *items))
    return box(b"udta", meta)


def _read_tags(moov: Box) -> dict[str, str]:
    meta = moov.get(b"udta", b"meta") if moov.get(b"udta") else None
    if meta is None:
        return {}
    names, out = {v: k for k, v in ILST.items()}, {}
    for name, a, b in boxes(meta, 4, len(meta)):
        if name == b"ilst":
            for key, x, y in boxes(meta, a, b):
                parts = {n: meta[p + 4 : q] for n, p, q in boxes(meta, x, y)}
                label = names.get(key) or (parts[b"name"].decode("utf-8", "replace") if b"name" in parts else None)
                if label and b"data" in parts:
                    out[label] = parts[b"data"][4:].decode("utf-8", "replace")
    return out
