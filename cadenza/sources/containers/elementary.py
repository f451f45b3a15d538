"""Self-framed audio: MP3 and ADTS AAC."""

from __future__ import annotations

from ...errors import CapabilityError, InputError, EngineError
from .base import Movie, Packet, Track, us

#: MPEG audio bitrates (kbit/s) of layer III and rates, by version.
MP3_BITRATES = {1: (0, 32, 40, 48, 56, 64, 80, 96, 112, 128, 160, 192, 224, 256, 320), 2: (0, 8, 16, 24, 32, 40, 48, 56, 64, 80, 96, 112, 128, 144, 160)}
MP3_RATES = {3: (44100, 48000, 32000), 2: (22050, 24000, 16000), 0: (11025, 12000, 8000)}
#: ADTS sampling frequencies by index.
AAC_RATES = (96000, 88200, 64000, 48000, 44100, 32000, 24000, 22050, 16000, 12000, 11025, 8000, 7350)


def id3_size(data: bytes) -> int:
    """Bytes of an ID3v2 tag at the start."""
    if data[:3] != b"ID3" or len(data) < 10:
        return 0
    size = data[6] << 21 | data[7] << 14 | data[8] << 7 | data[9]
    return 10 + size + (10 if data[5] & 0x10 else 0)


def mp3_header(data: bytes, at: int) -> tuple[int, int, int, int] | None:
    """(frame bytes, rate, channels, samples) of a layer III header."""
    if at + 4 > len(data) or data[at] != 0xFF or data[at + 1] & 0xE0 != 0xE0:
        return None
    version, layer = data[at + 1] >> 3 & 3, data[at + 1] >> 1 & 3
    bitrate, rate = data[at + 2] >> 4, data[at + 2] >> 2 & 3
    if version == 1 or layer != 1 or bitrate in (0, 15) or rate == 3:
        return None
    hz, samples = MP3_RATES[version][rate], 1152 if version == 3 else 576
    size = samples // 8 * MP3_BITRATES[1 if version == 3 else 2][bitrate] * 1000 // hz + (data[at + 2] >> 1 & 1)
    return size, hz, 1 if data[at + 3] >> 6 == 3 else 2, samples


def _is_info(data: bytes, at: int, size: int) -> bool:
    frame = data[at : at + min(size, 192)]
    return b"Xing" in frame or b"Info" in frame or b"VBRI" in frame


def mp3(data: bytes) -> Movie:
    at = id3_size(data)
    while at < len(data):  # the first header that another one follows
        h = mp3_header(data, at)
        if h and (at + h[0] >= len(data) or mp3_header(data, at + h[0])):
            break
        at = data.find(b"\xff", at + 1)
        if at < 0:
            at = len(data)
    if at >= len(data):
        raise InputError.bad("no MP3 frame")
    _, rate, channels, _ = mp3_header(data, at)
    t, clock, first = Track(1, "audio", "mp3", rate, sample_rate=rate, channels=channels), 0, True
    while (h := mp3_header(data, at)) and at + h[0] <= len(data):
        if not (first and _is_info(data, at, h[0])):
            t.packets.append(Packet(at, h[0], us(clock, rate), us(clock, rate), us(h[3], rate)))
            clock += h[3]
        first = False
        at += h[0]
    t.duration_sec = clock / rate
    return Movie("mp3", [t], t.duration_sec)


def adts_header(data: bytes, at: int) -> tuple[int, int, int, int, int] | None:
    """(header bytes, frame bytes, rate, channels, raw blocks)."""
    if at + 7 > len(data) or data[at] != 0xFF or data[at + 1] & 0xF6 != 0xF0:
        return None
    rate = data[at + 2] >> 2 & 15
    if rate >= len(AAC_RATES):
        return None
    size = (data[at + 3] & 3) << 11 | data[at + 4] << 3 | data[at + 5] >> 5
    head = 7 if data[at + 1] & 1 else 9
    return (head, size, AAC_RATES[rate], (data[at + 2] & 1) << 2 | data[at + 3] >> 6, (data[at + 6] & 3) + 1) if size >= head else None


def adts(data: bytes) -> Movie:
    at, t, clock = id3_size(data), None, 0
    while at < len(data):
        h = adts_header(data, at)
        if h is None:
            if t is None:
                raise InputError.bad("no ADTS frame")
            raise EngineError("demux-error", "lost ADTS sync")
        if at + h[1] > len(data):
            raise EngineError("demux-error", "an ADTS frame is cut off")
        if t is None:
            config = (2 << 11 | AAC_RATES.index(h[2]) << 7 | h[3] << 3).to_bytes(2, "big")
            t = Track(1, "audio", "mp4a.40.2", h[2], sample_rate=h[2], channels=h[3], config=config)
        t.packets.append(Packet(at + h[0], h[1] - h[0], us(clock, h[2]), us(clock, h[2]), us(1024 * h[4], h[2])))
        clock += 1024 * h[4]
        at += h[1]
    if t is None:
        raise InputError.bad("no ADTS frame")
    t.duration_sec = clock / t.sample_rate
    return Movie("adts", [t], t.duration_sec)


def write_adts(track: Track, payloads: list[bytes]) -> bytes:
    if not track.codec.startswith("mp4a") or track.sample_rate not in AAC_RATES:
        raise CapabilityError.miss(f"ADTS can't hold {track.codec}", {"op": "mux", "container": "adts"})
    rate, out = AAC_RATES.index(track.sample_rate), []
    for p in payloads:
        size = len(p) + 7
        if size > 0x1FFF:
            raise EngineError("mux-error", "an ADTS frame is too long")
        c = track.channels or 2
        out.append(bytes([0xFF, 0xF1, 1 << 6 | rate << 2 | c >> 2, (c & 3) << 6 | size >> 11, size >> 3 & 0xFF, (size & 7) << 5 | 0x1F, 0xFC]) + p)
    return b"".join(out)


def write_mp3(track: Track, payloads: list[bytes]) -> bytes:
    if track.codec != "mp3" or any(mp3_header(p, 0) is None for p in payloads):
        raise CapabilityError.miss(f"MP3 can't hold {track.codec}", {"op": "mux", "container": "mp3"})
    return b"".join(payloads)
