"""WebM and Matroska: EBML, blocks with lacing, clusters, fragments and a writer."""

from __future__ import annotations

import struct

from ...errors import CapabilityError, InputError, EngineError
from .base import Movie, Packet, Track, truncated

#: Element ids.
EBML, SEGMENT, INFO, SCALE, DURATION, TRACKS, ENTRY, CLUSTER = 0x1A45DFA3, 0x18538067, 0x1549A966, 0x2AD7B1, 0x4489, 0x1654AE6B, 0xAE, 0x1F43B675
NUMBER, UID, TYPE, CODEC, PRIVATE, DEFAULT, VIDEO, WIDTH, HEIGHT = 0xD7, 0x73C5, 0x83, 0x86, 0x63A2, 0x23E383, 0xE0, 0xB0, 0xBA
AUDIO, RATE, CHANNELS, TIMECODE, SIMPLE, GROUP, BLOCK, REFERENCE, BLOCKTIME = 0xE1, 0xB5, 0x9F, 0xE7, 0xA3, 0xA0, 0xA1, 0xFB, 0x9B
TAGS, TAG, SIMPLETAG, TAGNAME, TAGSTRING, DOCTYPE = 0x1254C367, 0x7373, 0x67C8, 0x45A3, 0x4487, 0x4282
#: Codec ids and the names used here.
CODECS = {"V_VP8": "vp8", "V_VP9": "vp9", "V_AV1": "av1", "V_MPEG4/ISO/AVC": "avc1", "V_MPEGH/ISO/HEVC": "hvc1", "A_OPUS": "opus", "A_VORBIS": "vorbis", "A_FLAC": "flac", "A_AAC": "mp4a.40.2", "A_MPEG/L3": "mp3"}
WEBM_CODECS = ("vp8", "vp9", "av1", "opus", "vorbis")
TOP = {INFO, TRACKS, CLUSTER, TAGS, 0x114D9B74, 0x1C53BB6B, 0x1043A770, 0x1941A469}
SPAN_MS = 30_000


def vint(data: bytes, at: int, keep_mark: bool = False) -> tuple[int | None, int]:
    """A variable-length number (None: unknown size) and where it ends."""
    if at >= len(data) or not data[at]:
        raise truncated("an EBML number")
    n = 9 - data[at].bit_length()
    if at + n > len(data):
        raise truncated("an EBML number")
    v = int.from_bytes(data[at : at + n], "big")
    if keep_mark:
        return v, at + n
    v &= (1 << 7 * n) - 1
    return (None if v == (1 << 7 * n) - 1 else v), at + n


def elements(data: bytes, at: int, end: int, parent: int = 0):
    """(id, where its body begins, where it ends); unknown sizes end before the next sibling of their kind."""
    while at < end:
        name, p = vint(data, at, True)
        size, p = vint(data, p)
        stop = end if size is None else min(end, p + size)
        if size is None and name == CLUSTER:
            q = p
            while q < end:  # a cluster's children go on until a top-level element
                child, r = vint(data, q, True)
                if child in TOP:
                    break
                n, r = vint(data, r)
                q = end if n is None else min(end, r + n)
            stop = q
        yield name, p, stop
        at = stop


def _text(b: bytes) -> str:
    return b.rstrip(b"\0").decode("utf-8", "replace")


def _frames(data: bytes, at: int, end: int, lacing: int) -> list[tuple[int, int]]:
    if lacing == 0:
        return [(at, end - at)]
    n, at = data[at] + 1, at + 1
    if lacing == 2:
        if (end - at) % n:
            raise EngineError("demux-error", "bad fixed lacing")
        return [(at + k * ((end - at) // n), (end - at) // n) for k in range(n)]
    sizes = []
    for k in range(n - 1):
        if lacing == 1:
            size = 0
            while at < end and data[at] == 255:
                size, at = size + 255, at + 1
            if at >= end:
                raise truncated("a laced block")
            size, at = size + data[at], at + 1
        elif k == 0:
            size, at = vint(data, at)
        else:
            width = 9 - data[at].bit_length()
            delta, at = vint(data, at)
            size = sizes[-1] + (delta if delta is not None else (1 << 7 * width) - 1) - ((1 << 7 * width - 1) - 1)
        sizes.append(size)
    if at + sum(sizes) > end or min(sizes, default=0) < 0:
        raise truncated("a laced block")
    out = []
    for size in [*sizes, end - at - sum(sizes)]:
        out.append((at, size))
        at += size
    return out


def movie(data: bytes) -> Movie:
    if data[:4] != b"\x1a\x45\xdf\xa3":
        raise InputError.bad("not a Matroska file")
    scale, duration, tracks, tags, container, default = 1_000_000, None, {}, {}, "mkv", {}

    def block(at: int, end: int, cluster: int, key: bool | None, length: int | None) -> None:
        number, p = vint(data, at)
        if p + 3 > end:
            raise truncated("a block")
        time, flags = cluster + int.from_bytes(data[p : p + 2], "big", signed=True), data[p + 2]
        t = tracks.get(number)
        if t is None:
            return
        for k, (a, n) in enumerate(_frames(data, p + 3, end, flags >> 1 & 3)):
            step = default.get(number, 0)
            pts = (time * scale + 500) // 1000 + k * step // 1000
            t.packets.append(Packet(a, n, pts, None, step // 1000 or (None if length is None else length * scale // 1000), bool(flags & 0x80) if key is None else key))

    for name, a, b in elements(data, 0, len(data)):
        if name == EBML:
            for n, x, y in elements(data, a, b):
                container = "webm" if n == DOCTYPE and _text(data[x:y]) == "webm" else container
        if name != SEGMENT:
            continue
        for name1, a1, b1 in elements(data, a, b):
            if name1 == INFO:
                for n, x, y in elements(data, a1, b1):
                    if n == SCALE:
                        scale = int.from_bytes(data[x:y], "big")
                    elif n == DURATION:
                        duration = struct.unpack(">d" if y - x == 8 else ">f", data[x:y])[0] if y - x in (4, 8) else None
            elif name1 == TRACKS:
                for n, x, y in elements(data, a1, b1):
                    if n == ENTRY:
                        f = {k: data[p:q] for k, p, q in elements(data, x, y)}
                        number, kind = int.from_bytes(f.get(NUMBER, b""), "big"), int.from_bytes(f.get(TYPE, b""), "big")
                        t = Track(number, {1: "video", 2: "audio"}.get(kind, "other"), CODECS.get(_text(f.get(CODEC, b"")), _text(f.get(CODEC, b""))), config=f.get(PRIVATE, b""))
                        if DEFAULT in f:
                            default[number] = int.from_bytes(f[DEFAULT], "big")
                            t.fps = 1e9 / default[number] if kind == 1 and default[number] else None
                        for k, p, q in elements(f.get(VIDEO, b""), 0, len(f.get(VIDEO, b""))):
                            v = int.from_bytes(f[VIDEO][p:q], "big")
                            t.width, t.height = (v if k == WIDTH else t.width), (v if k == HEIGHT else t.height)
                        for k, p, q in elements(f.get(AUDIO, b""), 0, len(f.get(AUDIO, b""))):
                            raw = f[AUDIO][p:q]
                            if k == RATE and len(raw) in (4, 8):
                                t.sample_rate = int(struct.unpack(">d" if len(raw) == 8 else ">f", raw)[0])
                            elif k == CHANNELS:
                                t.channels = int.from_bytes(raw, "big")
                        tracks[number] = t
            elif name1 == CLUSTER:
                cluster = 0
                for n, x, y in elements(data, a1, b1, CLUSTER):
                    if n == TIMECODE:
                        cluster = int.from_bytes(data[x:y], "big")
                    elif n == SIMPLE:
                        block(x, y, cluster, None, None)
                    elif n == GROUP:
                        parts = {k: (p, q) for k, p, q in elements(data, x, y)}
                        if BLOCK in parts:
                            length = int.from_bytes(data[slice(*parts[BLOCKTIME])], "big") if BLOCKTIME in parts else None
                            block(*parts[BLOCK], cluster, REFERENCE not in parts, length)
            elif name1 == TAGS:
                for n, x, y in elements(data, a1, b1):
                    for k, p, q in elements(data, x, y) if n == TAG else ():
                        if k == SIMPLETAG:
                            s = {c: _text(data[i:j]) for c, i, j in elements(data, p, q)}
                            if TAGNAME in s:
                                tags[s[TAGNAME]] = s.get(TAGSTRING, "")
    seconds = duration * scale / 1e9 if duration else None
    for t in tracks.values():
        t.duration_sec = seconds
        if t.track_kind == "video" and t.fps is None and len(t.packets) > 1:
            span = (max(p.pts_us for p in t.packets) - min(p.pts_us for p in t.packets)) / 1e6
            if span > 0:
                raw = (len(t.packets) - 1) / span
                near = int(raw + 0.5)
                t.fps = float(near) if near >= 1 and abs(raw - near) / near <= 0.02 else raw
    return Movie(container, list(tracks.values()), seconds, tags)


def size_bytes(n: int) -> bytes:
    width = 1
    while n >= (1 << 7 * width) - 1:
        width += 1
    return (n | 1 << 7 * width).to_bytes(width, "big")


def element(name: int, body: bytes) -> bytes:
    return name.to_bytes((name.bit_length() + 7) // 8, "big") + size_bytes(len(body)) + body


def uint(name: int, v: int) -> bytes:
    return element(name, v.to_bytes(max(1, (v.bit_length() + 7) // 8), "big"))


def _head(container: str) -> bytes:
    fields = ((0x4286, 1), (0x42F7, 1), (0x42F2, 4), (0x42F3, 8))
    return element(EBML, b"".join(uint(k, v) for k, v in fields) + element(DOCTYPE, b"webm" if container == "webm" else b"matroska") + uint(0x4287, 4) + uint(0x4285, 2))


def _entry(t: Track) -> bytes:
    names = {v: k for k, v in CODECS.items()}
    if t.codec not in names:
        raise CapabilityError.miss(f"Matroska can't hold {t.codec}", {"op": "mux", "container": "mkv"}, ["webm"])
    out = uint(NUMBER, t.track_id) + uint(UID, t.track_id) + uint(TYPE, 1 if t.track_kind == "video" else 2) + element(CODEC, names[t.codec].encode())
    if t.config:
        out += element(PRIVATE, t.config)
    if t.track_kind == "video":
        return element(ENTRY, out + element(VIDEO, uint(WIDTH, t.width or 1) + uint(HEIGHT, t.height or 1)))
    return element(ENTRY, out + element(AUDIO, element(RATE, struct.pack(">d", float(t.sample_rate or 48000))) + uint(CHANNELS, t.channels or 2)))


def timeline(tracks: list[Track], payloads: list[list[bytes]]) -> list[tuple[int, Track, Packet, bytes]]:
    """(time in ms, track, packet, payload) interleaved by decode time, rebased to the least presentation time."""
    rows = [(p.pts_us if p.dts_us is None else p.dts_us, i, k, t, p, data) for i, (t, ps) in enumerate(zip(tracks, payloads, strict=True)) for k, (p, data) in enumerate(zip(t.packets, ps, strict=True))]
    if not rows:
        return []
    low = min(r[4].pts_us for r in rows)
    if low < 0 and any(t.duration_sec for t in tracks) and any(r[4].pts_us >= 0 for r in rows):
        low = 0
    return [((p.pts_us - low + 500) // 1000, t, p, data) for _, _, _, t, p, data in sorted(rows, key=lambda r: r[:3])]


def _simple(time: int, base: int, t: Track, p: Packet, data: bytes) -> bytes:
    return element(SIMPLE, size_bytes(t.track_id) + (time - base).to_bytes(2, "big", signed=True) + bytes([0x80 if p.keyframe else 0]) + data)


def clusters(blocks: list, most: int | None = None, at_keys: bool = False) -> list[list]:
    """Greedy groups: the span of times stays within SPAN_MS; fragments also end at video keyframes and at `most`."""
    out: list[list] = []
    for b in blocks:
        if out and not (at_keys and b[2].keyframe and b[1].track_kind == "video") and (most is None or len(out[-1]) < most):
            times = [x[0] for x in out[-1]] + [b[0]]
            if max(times) - min(times) <= SPAN_MS:
                out[-1].append(b)
                continue
        out.append([b])
    return out


def cluster_bytes(group: list) -> bytes:
    base = max(0, min(b[0] for b in group))
    return element(CLUSTER, uint(TIMECODE, base) + b"".join(_simple(t, base, tr, p, d) for t, tr, p, d in group))


def _tags(tags: dict[str, str]) -> bytes:
    items = b"".join(element(SIMPLETAG, element(TAGNAME, k.encode()) + element(TAGSTRING, v.encode())) for k, v in tags.items())
    return element(TAGS, element(TAG, element(0x63C0, b"") + items)) if tags else b""


def write(tracks: list[Track], payloads: list[list[bytes]], container: str = "mkv", tags: dict[str, str] | None = None) -> bytes:
    if container == "webm":
        for t in tracks:
            if t.codec not in WEBM_CODECS:
                raise CapabilityError.miss(f"WebM can't hold {t.codec}", {"op": "mux", "container": "webm"}, ["webm"])
    blocks = timeline(tracks, payloads)
    end = max([b[0] + (b[2].duration_us or 0) // 1000 for b in blocks], default=0)
    info = element(INFO, uint(SCALE, 1_000_000) + element(DURATION, struct.pack(">d", float(end))) + element(0x4D80, b"cadenza") + element(0x5741, b"cadenza"))
    body = info + element(TRACKS, b"".join(_entry(t) for t in tracks)) + _tags(tags or {}) + b"".join(cluster_bytes(g) for g in clusters(blocks))
    return _head(container) + element(SEGMENT, body)


def fragments(tracks: list[Track], payloads: list[list[bytes]], container: str = "webm", most: int = 90) -> list[bytes]:
    """The head (segment of unknown size) and then one cluster after another, each playable on its own."""
    info = element(INFO, uint(SCALE, 1_000_000) + element(0x4D80, b"cadenza") + element(0x5741, b"cadenza"))
    head = _head(container) + SEGMENT.to_bytes(4, "big") + b"\x01" + b"\xff" * 7 + info + element(TRACKS, b"".join(_entry(t) for t in tracks))
    return [head, *(cluster_bytes(g) for g in clusters(timeline(tracks, payloads), most, True))]
