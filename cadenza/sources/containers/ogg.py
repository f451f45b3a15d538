"""Ogg: pages, packets by lacing, Opus, Vorbis and FLAC clocks, and a page writer."""

from __future__ import annotations

import struct

from ...errors import CapabilityError, InputError, EngineError
from .base import Movie, Packet, Track, crc32_ogg, us
from .flac import comment_block, parse_comments

#: Opus frame length in samples at 48 kHz by TOC configuration.
OPUS_SILK, OPUS_HYBRID, OPUS_CELT = (480, 960, 1920, 2880), (480, 960), (120, 240, 480, 960)


def opus_samples(packet: bytes) -> int:
    """Samples (48 kHz) of an Opus packet from its TOC byte and frame count."""
    if not packet:
        return 0
    config, code = packet[0] >> 3, packet[0] & 3
    one = OPUS_SILK[config % 4] if config < 12 else OPUS_HYBRID[config % 2] if config < 16 else OPUS_CELT[config % 4]
    count = (1, 2, 2)[code] if code < 3 else (packet[1] & 0x3F if len(packet) > 1 else 0)
    return one * count


def pages(data: bytes, check: bool = False):
    """(serial, flags, granule, lacing, where the body begins), page by page.

    What stands between pages is skipped, and a page that is cut off ends the file; with `check` a page
    whose checksum differs raises."""
    at, some = data.find(b"OggS\0"), False
    while at >= 0 and at + 27 <= len(data) and at + 27 + data[at + 26] <= len(data):
        flags, granule, serial = data[at + 5], int.from_bytes(data[at + 6 : at + 14], "little", signed=True), int.from_bytes(data[at + 14 : at + 18], "little")
        lacing = data[at + 27 : at + 27 + data[at + 26]]
        body = at + 27 + len(lacing)
        end = body + sum(lacing)
        if end > len(data):
            break
        if check:
            page = data[at : at + 22] + bytes(4) + data[at + 26 : end]
            if crc32_ogg(page) != int.from_bytes(data[at + 22 : at + 26], "little"):
                raise EngineError("demux-error", "an Ogg page's checksum differs")
        yield serial, flags, granule, lacing, body
        some = True
        at = data.find(b"OggS\0", end)
    if not some:
        raise InputError.bad("no whole Ogg page")


def packets(data: bytes, check: bool = False):
    """Per stream: (payload pieces as (offset, size), granule of the page it ends on)."""
    out: dict[int, list] = {}
    open_: dict[int, list] = {}
    for serial, flags, granule, lacing, at in pages(data, check):
        done, held = out.setdefault(serial, []), open_.setdefault(serial, [])
        if not flags & 1:
            held.clear()
        size = 0
        for n in lacing:
            size += n
            if n < 255:
                held.append((at, size))
                done.append((list(held), granule))
                at, size = at + size, 0
                held.clear()
        if size:
            held.append((at, size))
    return out


def movie(data: bytes) -> Movie:
    tracks, tags, longest = [], {}, 0.0
    for i, (_, found) in enumerate(packets(data).items()):
        whole = [(b"".join(data[a : a + n] for a, n in pieces), pieces, granule) for pieces, granule in found]
        if not whole:
            continue
        head = whole[0][0]
        if head[:8] == b"OpusHead" and len(head) >= 19:
            codec, rate, channels, skip, headers = "opus", 48_000, head[9], int.from_bytes(head[10:12], "little"), 2
            mark = 8
        elif head[:7] == b"\x01vorbis" and len(head) >= 16:
            codec, rate, channels, skip, headers, mark = "vorbis", int.from_bytes(head[12:16], "little"), head[11], 0, 3, 7
        elif head[:5] == b"\x7fFLAC" and len(head) >= 51:
            v = int.from_bytes(head[27:35], "big")
            codec, rate, channels, skip, headers, mark = "flac", v >> 44, (v >> 41 & 7) + 1, 0, 1 + int.from_bytes(head[7:9], "big"), 4
        else:
            continue
        if rate <= 0:
            raise EngineError("demux-error", "Ogg stream without a rate")
        for h, *_ in whole[1:headers]:
            if codec != "flac" or (h and h[0] & 0x7F == 4):
                tags |= parse_comments(h[mark:])
        t = Track(i + 1, "audio", codec, rate, sample_rate=rate, channels=channels, config=head)
        audio, k, before = whole[headers:], 0, 0
        clock = -skip
        while k < len(audio):
            j = k
            while j < len(audio) and audio[j][2] == audio[k][2]:
                j += 1
            end = audio[k][2] if audio[k][2] >= 0 else before
            total = max(0, end - before)
            for m in range(k, j):
                payload, pieces, _ = audio[m]
                if codec == "opus":
                    start, n = clock, opus_samples(payload)
                    clock += n
                else:
                    a, b = (int((x - k) / (j - k) * total + 0.5) for x in (m, m + 1))
                    start, n = before + a, b - a
                one = len(pieces) == 1
                t.packets.append(Packet(pieces[0][0] if one else None, len(payload), us(start, rate), us(start, rate), us(n, rate), True, None if one else payload))
            before, k = end, j
        t.duration_sec = max(0, before - skip) / rate
        longest = max(longest, t.duration_sec)
        tracks.append(t)
    if not tracks:
        raise CapabilityError.miss("no known stream in the Ogg file", {"op": "demux", "container": "ogg"})
    return Movie("ogg", tracks, longest, tags)


def _pages(serial: int, items: list[tuple[bytes, int]], sequence: int, first: bool, last: bool, most: int = 255) -> bytes:
    """Packets with the granules after them, on as few pages as hold them."""
    segments: list[tuple[bytes, bool, int]] = []
    for payload, granule in items:
        for a in range(0, len(payload) + 1, 255):
            segments.append((payload[a : a + 255], a + 255 > len(payload), granule))
    out, carried = [], False
    for a in range(0, len(segments), most):
        part = segments[a : a + most]
        ends = [g for _, done, g in part if done]
        flags = (1 if carried else 0) | (2 if first and not out else 0) | (4 if last and a + most >= len(segments) else 0)
        body = bytes(len(s) for s, _, _ in part) + b"".join(s for s, _, _ in part)
        head = b"OggS\0" + bytes([flags]) + struct.pack("<qIII", ends[-1] if ends else -1, serial, sequence + len(out), 0) + bytes([len(part)])
        page = bytearray(head + body)
        page[22:26] = crc32_ogg(bytes(page)).to_bytes(4, "little")
        out.append(bytes(page))
        carried = not part[-1][1]
    return b"".join(out)


def write(track: Track, payloads: list[bytes], tags: dict[str, str] | None = None) -> bytes:
    """One Opus, Vorbis or FLAC stream; granules follow the packets' own lengths."""
    rate = 48_000 if track.codec == "opus" else track.sample_rate
    if track.codec == "opus":

        head = track.config if track.config[:8] == b"OpusHead" else b"OpusHead" + struct.pack("<BBHIhB", 1, track.channels or 2, 0, rate, 0, 0)
        heads = [head, b"OpusTags" + comment_block(tags or {})]
    elif track.codec == "vorbis" and track.config:
        heads = [track.config, b"\x03vorbis" + comment_block(tags or {}) + b"\x01"]
    else:
        raise CapabilityError.miss(f"no Ogg mapping for {track.codec}", {"op": "mux", "container": "ogg"}, ["ogg"])
    clock, items = 0, []
    for p, data in zip(track.packets, payloads, strict=True):
        clock += opus_samples(data) if track.codec == "opus" else int((p.duration_us or 0) * rate / 1e6 + 0.5)
        items.append((data, clock))
    out = _pages(1, [(heads[0], 0)], 0, True, False) + _pages(1, [(h, 0) for h in heads[1:]], 1, False, not items)
    return out + (_pages(1, items, 2, False, True, 50) if items else b"")
