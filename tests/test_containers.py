import random
import struct

import numpy as np
import pytest

from cadenza.errors import CapabilityError, EngineError
from cadenza.sources import files as assets_io
from cadenza.sources.containers import avi, elementary, flac, images, matroska, mp4, mpegts, ogg, pcm_files, tags
from cadenza.sources.containers.base import Packet, Track, crc8, crc16, crc32_mpeg2, crc32_ogg


def signal(frames=5000, channels=2):
    t = np.arange(frames)
    x = np.stack([0.5 * np.sin(t / (7 + c)) + 0.2 * np.sin(t / 31) for c in range(channels)])
    x[:, 1000:1100] = 0.25
    return x


def video(n=30, codec="avc1", reorder=False):
    t = Track(1, "video", codec, 90_000, fps=25.0, width=64, height=48)
    order = [0, 3, 1, 2] if reorder else [0, 1, 2, 3]
    for i in range(n):
        shown = i // 4 * 4 + order[i % 4]
        t.packets.append(Packet(None, 0, shown * 40_000, i * 40_000 - (80_000 if reorder else 0), 40_000, i % 8 == 0))
    return t, [bytes([0, 0, 0, 1, 0x65 if i % 8 == 0 else 0x41]) + bytes([i]) * (20 + i) for i in range(n)]


def audio(n=40, codec="mp4a.40.2"):
    t = Track(2, "audio", codec, 48_000, sample_rate=48_000, channels=2, config=b"\x11\x90")
    for i in range(n):
        t.packets.append(Packet(None, 0, i * 1024 * 1_000_000 // 48_000, i * 1024 * 1_000_000 // 48_000, 21_333, True))
    return t, [bytes([200, i]) * 30 for i in range(n)]


@pytest.mark.parametrize("name", ["wav", "aiff", "caf"])
@pytest.mark.parametrize("fmt", ["u8", "s8", "s16", "s24", "s32", "f32", "f64"])
def test_pcm_files(name, fmt):
    x = signal()
    if (name == "wav") == (fmt == "s8") and fmt in ("u8", "s8"):
        with pytest.raises(CapabilityError):
            pcm_files.WRITE[name](x, 44_100, fmt)
        return
    data = pcm_files.WRITE[name](x, 44_100, fmt)
    f = pcm_files.PARSE[name](data)
    assert (f.fmt, f.rate, f.channels, f.frames) == (fmt, 44_100, 2, 5000)
    limit = {"u8": 2**-7, "s8": 2**-7, "s16": 2**-15, "s24": 2**-23, "s32": 2**-31, "f32": 1e-7, "f64": 0}[fmt]
    assert np.abs(f.decode(data) - x).max() <= limit


def test_crcs():
    check = b"123456789"
    assert (crc8(check), crc16(check), crc32_mpeg2(check)) == (0xF4, 0xFEE8, 0x0376E6E7)
    assert crc32_ogg(check) == 0x89A1897F


@pytest.mark.parametrize("bits", [8, 16, 24])
@pytest.mark.parametrize("channels", [1, 2, 6])
def test_flac(bits, channels):
    x = np.floor(signal(9000, channels) * (1 << (bits - 1)) + 0.5).astype(np.int64)
    data = flac.encode(x, 48_000, bits, tags={"TITLE": "x"})
    info, y = flac.decode(data)
    assert (y == x).all() and info.bits == bits and info.comments == {"TITLE": "x"}
    assert len(data) < x.size * bits // 8
    broken = bytearray(data)
    broken[len(data) // 2] ^= 1
    with pytest.raises(EngineError):
        flac.decode(bytes(broken))


def test_flac_noise_is_verbatim():
    x = np.random.default_rng(1).integers(-32768, 32768, (2, 4096))
    assert (flac.decode(flac.encode(x, 44_100))[1] == x).all()


@pytest.mark.parametrize("reorder", [False, True])
def test_mp4(reorder):
    (v, vd), (a, ad) = video(reorder=reorder), audio()
    data = mp4.write([v, a], [vd, ad], tags={"title": "T", "own": "O"})
    m = mp4.movie(data)
    assert m.tags == {"title": "T", "own": "O"}
    for t, source, payloads in zip(m.tracks, (v, a), (vd, ad), strict=True):
        assert [t.payload(p, data) for p in t.packets] == payloads
        base = source.packets[0].dts_us
        assert max(abs(p.pts_us - (q.pts_us - base)) for p, q in zip(t.packets, source.packets, strict=True)) <= 12
        assert [p.keyframe for p in t.packets] == [p.keyframe for p in source.packets]
    assert mp4.movie(mp4.write(m.tracks, [[t.payload(p, data) for p in t.packets] for t in m.tracks])).tracks[0].packets[5].pts_us == m.tracks[0].packets[5].pts_us


def test_mp4_fragments():
    (v, vd), (a, ad) = video(), audio()
    parts = mp4.fragments([v, a], [vd, ad], 10)
    data = b"".join(parts)
    m = mp4.movie(data)
    assert [[t.payload(p, data) for p in t.packets] for t in m.tracks] == [vd, ad]
    assert [p.pts_us for p in m.tracks[0].packets] == [p.pts_us for p in v.packets]
    assert [p.keyframe for p in m.tracks[0].packets] == [p.keyframe for p in v.packets]


@pytest.mark.parametrize("container", ["mkv", "webm"])
def test_matroska(container):
    (v, vd), (a, ad) = video(codec="vp9"), audio(codec="opus")
    data = matroska.write([v, a], [vd, ad], container, {"TITLE": "T"})
    m = matroska.movie(data)
    assert m.container == container and m.tags == {"TITLE": "T"}
    assert [[t.payload(p, data) for p in t.packets] for t in m.tracks] == [vd, ad]
    assert [p.pts_us for p in m.tracks[0].packets] == [p.pts_us for p in v.packets] and m.tracks[0].fps == 25
    whole = b"".join(matroska.fragments([v, a], [vd, ad], container))
    assert [[t.payload(p, whole) for p in t.packets] for t in matroska.movie(whole).tracks] == [vd, ad]
    if container == "webm":
        with pytest.raises(CapabilityError):
            matroska.write([video()[0]], [video()[1]], "webm")


def test_matroska_lacing():
    frames = [b"a" * 300, b"b" * 10, b"c" * 7]
    head = matroska._head("mkv") + b""
    v, _ = video(1, "vp9")
    xiph = bytes([2, 255, 45, 10]) + b"".join(frames)
    ebml = bytes([2]) + matroska.size_bytes(300) + (10 - 300 + (1 << 13) - 1 | 1 << 14).to_bytes(2, "big") + b"".join(frames)
    fixed = bytes([2]) + b"x" * 30
    for lacing, body, want in ((1, xiph, frames), (3, ebml, frames), (2, fixed, [b"x" * 10] * 3)):
        block = matroska.element(matroska.SIMPLE, b"\x81\0\0" + bytes([lacing << 1 | 0x80]) + body)
        data = head + matroska.element(matroska.SEGMENT, matroska.element(matroska.TRACKS, matroska._entry(v)) + matroska.element(matroska.CLUSTER, matroska.uint(matroska.TIMECODE, 0) + block))
        t = matroska.movie(data).tracks[0]
        assert [t.payload(p, data) for p in t.packets] == want


def test_transport_stream():
    (v, vd), (a, ad) = video(reorder=True), audio()
    data = mpegts.write([v, a], [vd, ad])
    assert len(data) % 188 == 0
    m = mpegts.movie(data)
    assert [[t.payload(p, data) for p in t.packets] for t in m.tracks] == [vd, ad]
    assert [p.pts_us - m.tracks[0].packets[0].pts_us for p in m.tracks[0].packets] == [p.pts_us - v.packets[0].pts_us for p in v.packets]
    assert [p.keyframe for p in m.tracks[0].packets] == [p.keyframe for p in v.packets]


def test_transport_stream_wrap():
    v, vd = video(10)
    for p in v.packets:
        p.pts_us += ((1 << 33) * 100 // 9) - 200_000
        p.dts_us = p.pts_us
    m = mpegts.movie(mpegts.write([v], [vd]))
    assert m.tracks[0].duration_sec == pytest.approx(0.4, abs=0.001)


def test_ogg():
    t = Track(1, "audio", "opus", 48_000, sample_rate=48_000, channels=2)
    payloads = [bytes([0xF8]) + bytes([i]) * (100 if i != 3 else 70_000) for i in range(120)]
    t.packets = [Packet(None, len(d), i * 20_000, i * 20_000, 20_000) for i, d in enumerate(payloads)]
    data = ogg.write(t, payloads, {"TITLE": "x"})
    m = ogg.movie(data)
    assert [m.tracks[0].payload(p, data) for p in m.tracks[0].packets] == payloads
    assert [p.pts_us for p in m.tracks[0].packets] == [p.pts_us for p in t.packets] and m.tags == {"TITLE": "x"}
    assert list(ogg.pages(data, check=True))


def test_adts_and_mp3():
    a, ad = audio()
    data = elementary.write_adts(a, ad)
    m = elementary.adts(data)
    assert [m.tracks[0].payload(p, data) for p in m.tracks[0].packets] == ad and m.tracks[0].channels == 2
    frame = bytes([0xFF, 0xFB, 0x90, 0x00]) + bytes(413)
    info = bytes([0xFF, 0xFB, 0x90, 0x00]) + bytes(32) + b"Info" + bytes(377)
    m = elementary.mp3(tags.id3({"title": "x"}) + info + frame * 10)
    assert len(m.tracks[0].packets) == 10 and m.duration_sec == pytest.approx(11520 / 44100)


def test_avi():
    v, vd = video()
    data = avi.write([v], [vd], 400)
    assert data[:4] == b"RIFF" and data.count(b"AVIX") > 1 and data.count(b"00dc") == 30 + data[: data.find(b"AVIX")].count(b"00dc") // 2
    with pytest.raises(CapabilityError):
        avi.write([v], [vd], 30)


def test_ogg_with_rubbish_and_a_cut_page():
    t = Track(1, "audio", "opus", 48_000, sample_rate=48_000, channels=2)
    payloads = [bytes([0xF8]) + bytes([i]) * 40 for i in range(150)]
    t.packets = [Packet(None, len(d), i * 20_000, None, 20_000) for i, d in enumerate(payloads)]
    data = ogg.write(t, payloads)
    whole = ogg.movie(data).tracks[0].packets
    some = ogg.movie(data[: len(data) * 3 // 5]).tracks[0]
    assert 0 < len(some.packets) < len(whole)
    second = data.find(b"OggS", 4)
    assert len(ogg.movie(data[:second] + b"rubbish" + data[second:]).tracks[0].packets) == len(whole)
    with pytest.raises(EngineError):
        ogg.movie(b"OggX" * 40)


@pytest.mark.parametrize("kind, order", [(b"in16", ">"), (b"twos", ">"), (b"lpcm", "<"), (b"sowt", "<")])
def test_aiff_c_kinds(kind, order):
    x = np.arange(-50, 50, dtype=np.int16) * 300
    comm = struct.pack(">HIH", 1, 100, 16) + pcm_files.extended(8000) + kind + b"\0\0"
    body = struct.pack(">II", 0, 0) + x.astype(f"{order}i2").tobytes()
    chunks = b"COMM" + struct.pack(">I", len(comm)) + comm + b"SSND" + struct.pack(">I", len(body)) + body
    data = b"FORM" + struct.pack(">I", 4 + len(chunks)) + b"AIFC" + chunks
    assert np.array_equal(pcm_files.parse_aiff(data).decode(data)[0] * 32768, x)


@pytest.mark.parametrize("container", ["mp3", "flac", "wav", "aiff", "caf", "mkv", "mp4", "ogg"])
def test_tags(container):
    x = signal(2000)
    made = {"mp3": lambda: (bytes([0xFF, 0xFB, 0x90, 0x00]) + bytes(413)) * 4, "flac": lambda: flac.encode(np.floor(x * 1000).astype(int), 8000), "wav": lambda: pcm_files.write_wav(x, 8000), "aiff": lambda: pcm_files.write_aiff(x, 8000), "caf": lambda: pcm_files.write_caf(x, 8000)}
    if container in made:
        data = made[container]()
    elif container == "ogg":
        t = Track(1, "audio", "opus", 48_000, sample_rate=48_000, channels=2, packets=[Packet(None, 3, 0, 0, 20_000)])
        data = ogg.write(t, [b"\xf8ab"])
    else:
        v, vd = video(codec="vp9")
        data = assets_io.build([v], [vd], container)
    wanted = {"title": "Tïtle", "artist": "A"} if container != "aiff" else {"title": "Title", "artist": "A"}
    out = tags.write_tags(tags.write_tags(data, container, {"title": "old"}), container, wanted)
    got = tags.read_tags(out, container)
    assert {k.lower(): v for k, v in got.items()} == wanted
    before, after = assets_io.parse(data, container), assets_io.parse(out, container)
    payloads = lambda m, d: [[t.payload(p, d) for p in t.packets] for t in m.tracks]
    assert payloads(before, data) == payloads(after, out)


def files():
    v, vd = video()
    w, wd = video(codec="vp9")
    a, ad = audio()
    x = signal(3000)
    t = Track(1, "audio", "opus", 48_000, sample_rate=48_000, channels=2, packets=[Packet(None, 9, i * 20_000, None, 20_000) for i in range(5)])
    return {
        "mp4": mp4.write([v, a], [vd, ad]), "mkv": matroska.write([w], [wd]), "ts": mpegts.write([v], [vd]), "wav": pcm_files.write_wav(x, 8000), "aiff": pcm_files.write_aiff(x, 8000), "caf": pcm_files.write_caf(x, 8000),
        "flac": flac.encode(np.floor(x * 1000).astype(int), 8000), "ogg": ogg.write(t, [b"\xf8abcdefgh"] * 5), "adts": elementary.write_adts(a, ad), "mp3": (bytes([0xFF, 0xFB, 0x90, 0x00]) + bytes(413)) * 9,
    }


@pytest.mark.parametrize("container", sorted(files()))
def test_corrupted_files_parse_or_raise_typed_errors(container):
    data, r = files()[container], random.Random(7)
    cases = [b"", data[:3], bytes(len(data)), data[len(data) // 2 :]]
    for _ in range(60):
        b = bytearray(data)
        kind = r.randrange(5)
        at = r.randrange(len(b))
        if kind == 0:
            b = b[:at]
        elif kind == 1:
            b[r.randrange(min(16, len(b)))] ^= 1 << r.randrange(8)
        elif kind == 2:
            b[at : at + 4] = b"\xff" * 4
        elif kind == 3:
            b[at : at + 4] = bytes(4)
        else:
            for _ in range(20):
                b[r.randrange(len(b))] = r.randrange(256)
        cases.append(bytes(b))
    for case in cases:
        try:
            m = assets_io.parse(case, container)
            assert m.tracks is not None
        except EngineError:
            pass


def test_images():
    gif = b"GIF89a" + struct.pack("<HHBBB", 3, 2, 0x80, 0, 0) + bytes(6) + b"\x21\xff\x0bNETSCAPE2.0\x03\x01\0\0\0" + (b"\x21\xf9\x04\0\x0a\0\0\0" + b"\x2c" + struct.pack("<HHHHB", 0, 0, 3, 2, 0) + b"\x02\x01a\0") * 2 + b";"
    i = images.probe(gif)
    assert (i.width, i.height, i.frame_count, i.animated, i.duration_sec, i.loop_count) == (3, 2, 2, True, 0.2, float("inf"))
    png = images.PNG + struct.pack(">I4sIIBBBBB", 13, b"IHDR", 5, 6, 16, 6, 0, 0, 0) + bytes(4) + struct.pack(">I4s", 0, b"IEND") + bytes(4)
    assert (images.probe(png).width, images.probe(png).bit_depth, images.probe(png).color_type) == (5, 16, "rgba")
    jpeg = b"\xff\xd8\xff\xe0\0\4ab\xff\xc0\0\x11\x08" + struct.pack(">HHB", 7, 9, 3) + bytes(9)
    assert (images.probe(jpeg).width, images.probe(jpeg).height) == (9, 7)
    webp = b"RIFF\0\0\0\0WEBPVP8X" + struct.pack("<I", 10) + bytes([0x12, 0, 0, 0]) + (9).to_bytes(3, "little") + (4).to_bytes(3, "little")
    assert (images.probe(webp).width, images.probe(webp).height, images.probe(webp).animated) == (10, 5, True)
    with pytest.raises(EngineError):
        images.probe(b"nothing")
    with pytest.raises(EngineError):
        images.probe(png[:20])
