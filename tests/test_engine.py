import numpy as np
import pytest
from pyspark.sql import functions as F

from cadenza.errors import CapabilityError, InputError, EngineError
from cadenza.operators import joins, selection, timeline
from cadenza.plans import router
from cadenza.plans.engine import Engine
from cadenza.sources import files as assets_io
from cadenza.sources.containers import flac, mp4, pcm_files
from tests.test_containers import audio, files, signal, video


@pytest.fixture(scope="module")
def engine(spark):
    return Engine(spark)


def test_probe_all(engine):
    made = files()
    got = {r.asset_id: r for r in engine.probe([(i, made[k]) for i, k in enumerate(sorted(made))] + [(99, b"garbage"), (98, b"")]).collect()}
    for i, k in enumerate(sorted(made)):
        assert got[i].status == "ok" and got[i].container == k and got[i].duration_sec > 0, k
    assert got[99].error_code == "capability-miss" and got[98].error_code == "unsupported-input"


def test_demux_payloads(engine):
    (v, vd), (a, ad) = video(), audio()
    assets = engine.source([(1, mp4.write([v, a], [vd, ad]))])
    tracks, packets = engine.demux(assets)
    rows = assets_io.with_payload(packets, assets).orderBy("track_id", "seq").collect()
    assert [bytes(r.data) for r in rows] == vd + ad and tracks.count() == 2
    assert "content" not in engine.packet_info(assets).columns


def test_trim_and_remux(engine):
    v, vd = video(40)
    data = mp4.write([v], [vd])
    cut = engine.trim(data, 0.5, 1.0, to="mp4").first()
    m = mp4.movie(bytes(cut.content))
    assert cut.status == "ok" and m.tracks[0].packets[0].keyframe and len(m.tracks[0].packets) == 25 - 8
    both = engine.remux(data, "mkv").first()
    assert both.status == "ok" and bytes(both.content)[:4] == b"\x1a\x45\xdf\xa3"
    (a, ad) = audio()
    two = mp4.write([v, a], [vd, ad])
    only = engine.remux(two, "mp4", select=["audio:0"]).first()
    assert [t.track_kind for t in mp4.movie(bytes(only.content)).tracks] == ["audio"]
    assert engine.remux(two, "webm").first().error_code == "capability-miss"
    with pytest.raises(InputError):
        engine.remux(two, "mp4", tags={}, select=["audio:0"])
    with pytest.raises(CapabilityError):
        engine.remux(two, "gif")


def test_adjacent_cuts_make_the_whole(engine):
    x = signal(8000, 1)
    data = pcm_files.write_wav(x, 8000)
    part = lambda a, b: np.concatenate([np.array(r.planar) for r in engine.trim(data, a, b, "accurate").orderBy("block_no").collect()], axis=1)
    assert np.array_equal(np.concatenate([part(0.1, 0.35), part(0.35, 0.8)], axis=1), part(0.1, 0.8))


def test_convert(engine):
    x = signal(3000)
    wav = pcm_files.write_wav(x, 8000)
    out = engine.convert(wav, "flac").first()
    info, y = flac.decode(bytes(out.content))
    assert out.status == "ok" and info.rate == 8000 and np.abs(y / 32768 - x).max() < 2**-14
    back = engine.convert(bytes(out.content), "aiff", audio={"gain_db": -6.0}).first()
    assert np.abs(pcm_files.parse_aiff(bytes(back.content)).decode(bytes(back.content)) - x * 10 ** (-6 / 20)).max() < 2**-13
    miss = engine.convert(mp4.write(*[[z] for z in video()]), "mp4", video={"codec": "vp9"}).first()
    assert miss.status == "failed" and miss.error_code == "capability-miss"
    assert engine.wav_packet_copy(wav) == wav


@pytest.mark.parametrize("fmt", ["u8", "s16", "s24", "s32", "f32", "f64"])
def test_convert_keeps_the_format(engine, fmt):
    x = signal(1500)
    wav = pcm_files.write_wav(x, 8000, fmt)
    signed = "s8" if fmt == "u8" else fmt
    for to, want in (("aiff", signed), ("caf", signed), ("wav", fmt)):
        out = engine.convert(wav, to, audio={"gain_db": -1.0}).first()
        f = pcm_files.PARSE[to](bytes(out.content))
        assert (f.fmt, f.channels, f.rate) == (want, 2, 8000)
    flac_file = bytes(engine.convert(wav, "flac").first().content)
    info, y = flac.decode(flac_file)
    bits = 24 if fmt[0] == "f" else 8 * pcm_files.pcm.WIDTH[fmt]
    assert info.bits == bits and np.array_equal(y, np.clip(np.floor(pcm_files.parse_wav(wav).decode(wav) * (1 << bits - 1) + 0.5), -(1 << bits - 1), (1 << bits - 1) - 1).astype(np.int64))
    back = engine.convert(flac_file, "wav").first()
    assert pcm_files.parse_wav(bytes(back.content)).fmt == ("u8" if bits == 8 else f"s{bits}")
    mono = engine.load(wav).channels(1).to("aiff").blob()
    f = pcm_files.parse_aiff(mono)
    assert (f.channels, f.fmt) == (1, signed) and np.abs(f.decode(mono) - pcm_files.parse_wav(wav).decode(wav).mean(0)).max() < 2**-7
    cut = engine.load(wav).trim(0, 0.05, "accurate").run().first()
    assert pcm_files.parse_wav(bytes(cut.content)).fmt == fmt
    assert pcm_files.parse_wav(bytes(engine.convert(wav, "wav", audio={"codec": "pcm-s16", "sample_rate": 4000}).first().content)).fmt == "s16"


def test_channels_of_each_file(engine):
    one, two, three = (pcm_files.write_wav(signal(900)[[0, 1, 0][:k]], 8000, "s24") for k in (1, 2, 3))
    rows = {r.asset_id: r for r in engine.convert([one, two, three], "wav", audio={"channels": 2}).collect()}
    assert [rows[k].status for k in range(3)] == ["ok", "ok", "failed"] and rows[2].error_code == "capability-miss"
    assert all((f.channels, f.fmt) == (2, "s24") for f in (pcm_files.parse_wav(bytes(rows[k].content)) for k in range(2)))


def test_chain(engine):
    wav = pcm_files.write_wav(signal(3000), 8000)
    chain = engine.load(wav).gain(-3.0).sample_rate(16_000).to("flac")
    assert chain.compile() == [("convert", {"gain": -3.0, "sample_rate": 16_000, "to": "flac"})]
    info, y = flac.decode(chain.blob())
    assert info.rate == 16_000 and y.shape == (2, 6000)
    split = engine.load(wav).gain(-3.0).trim(0, 0.1, "accurate").to("flac")
    assert [s[0] for s in split.compile()] == ["convert", "trim", "convert"]
    with pytest.raises(InputError):
        engine.load(wav).compile()
    with pytest.raises(EngineError):
        engine.load(mp4.write(*[[z] for z in video()])).codec("vp9").to("mp4").blob()


def test_modules_and_ladder(engine):
    class Old:
        id, api_version = "old", 7

    with pytest.raises(EngineError) as e:
        engine.use(Old())
    assert e.value.code == "driver-incompatible"
    assert {r.error_code for r in engine.h264_abr_ladder(b"x", [(720, 1), (360, 1)]).collect()} == {"capability-miss"}
    with pytest.raises(InputError):
        engine.h264_abr_ladder(b"x", [])
    assert engine.preload(engine.source(b"x")) == []
    assert router.default_output("wav") == "mp4" and router.default_output("mkv") == "mkv"
    assert router.is_stream_copy(None, {"gain_db": 0}) and not router.is_stream_copy({"fps": 3}, None) and not router.is_stream_copy(False, None)


def test_decrypt(engine):
    from cadenza.functions import crypto

    (v, vd) = video(6)
    key, kid, iv = bytes(range(16)), bytes(range(16, 32)), bytes(8)
    sealed = [crypto.ctr(key, (iv[:7] + bytes([i])) + bytes(8), d) for i, d in enumerate(vd)]
    data = mp4.write([v], [sealed])
    sinf = mp4.box(b"sinf", mp4.box(b"frma", b"avc1"), mp4.full(b"schm", 0, 0, b"cenc", bytes(4)), mp4.box(b"schi", mp4.full(b"tenc", 0, 0, b"\0\0\1\x08" + kid)))
    senc = mp4.full(b"senc", 0, 0, (6).to_bytes(4, "big"), b"".join(iv[:7] + bytes([i]) for i in range(6)))
    grown = _insert(_insert(data, [b"moov", b"trak", b"mdia", b"minf", b"stbl"], senc), [b"moov", b"trak", b"mdia", b"minf", b"stbl", b"stsd", b"avc1"], sinf, b"encv")
    shift = len(grown) - len(data)
    at = grown.find(b"stco") + 4
    n = int.from_bytes(grown[at + 4 : at + 8], "big")
    moved = bytearray(grown)
    for k in range(n):
        p = at + 8 + 4 * k
        moved[p : p + 4] = (int.from_bytes(moved[p : p + 4], "big") + shift).to_bytes(4, "big")
    protected = bytes(moved)
    assert mp4.movie(protected).tracks[0].encrypted
    clear = engine.decrypt(protected, {kid: key})
    m = mp4.movie(clear)
    assert [m.tracks[0].payload(p, clear) for p in m.tracks[0].packets] == vd
    with pytest.raises(CapabilityError):
        engine.decrypt(protected, {bytes(16): key})


def _insert(data: bytes, path: list[bytes], extra: bytes, rename: bytes | None = None) -> bytes:
    """`data` with a box appended inside the box at `path`."""
    out, at, end, sizes = bytearray(data), 0, len(data), []
    for name in path:
        while True:
            size = int.from_bytes(data[at : at + 4], "big")
            if data[at + 4 : at + 8] == name:
                break
            at += size
            assert at < end
        sizes.append((at, size))
        end = at + size
        at += 16 if name == b"stsd" else 8
    last_at, last_size = sizes[-1]
    for a, s in sizes:
        out[a : a + 4] = (s + len(extra)).to_bytes(4, "big")
    if rename:
        out[last_at + 4 : last_at + 8] = rename
    return bytes(out[: last_at + last_size]) + extra + bytes(out[last_at + last_size :])


def test_selection_refuses(spark):
    for a, b in ((-1, 2), (2, 2), (3, 2), (float("nan"), 2)):
        with pytest.raises(InputError):
            selection.check_range(a, b)
    with pytest.raises(InputError):
        selection.check_range(5, 6, 4)
    assert selection.check_range(0, 4.5, 4) == (0, 4_500_000)
    with pytest.raises(InputError):
        selection.select_tracks(spark.createDataFrame([(1, 1, "video")], "asset_id int, track_id int, track_kind string"), ["film:1"])


def test_retiming_rules(spark):
    """The as-of form against a cursor over the intervals, with holes, overlaps and declared lengths."""
    r = np.random.default_rng(4)
    rows, want = [], {}
    for asset in range(40):
        n, fps = int(r.integers(2, 12)), 7.5
        pts = np.cumsum(r.integers(1000, 300_000, n))
        declared = [int(x) if r.random() < 0.4 else None for x in r.integers(500, 500_000, n)]
        rows += [(asset, 0, i, int(p), d) for i, (p, d) in enumerate(zip(pts, declared, strict=True))]
        end = [int(p + (d or (pts[i + 1] - p if i + 1 < n else p - pts[i - 1]))) for i, (p, d) in enumerate(zip(pts, declared, strict=True))]
        cursor, out = 0, []
        for k in range(max(1, int(np.floor((end[-1] - pts[0]) * fps / 1e6 + 0.5)))):
            t = int(pts[0]) + int(np.floor(k * 1e6 / fps + 0.5))
            while cursor + 1 < n and t >= end[cursor]:
                cursor += 1
            out.append((k, t, cursor))
        want[asset] = out
    df = spark.createDataFrame(rows, "asset_id bigint, track_id int, seq bigint, pts_us bigint, declared_us bigint")
    got = joins.cfr_slots(df, 7.5).collect()
    for asset, out in want.items():
        assert sorted((x.out_no, x.ts_us, x.source_seq) for x in got if x.asset_id == asset) == out
    with pytest.raises(Exception, match="duration"):
        joins.cfr_slots(spark.createDataFrame([(1, 0, 0, 5, None)], df.schema), 5.0).collect()


def test_greedy_runs(spark):
    r = np.random.default_rng(5)
    rows = [(a, 0, i, int(t), bool(r.random() < 0.1)) for a in range(20) for i, t in enumerate(np.cumsum(r.integers(0, 9000, 60)))]
    df = spark.createDataFrame(rows, "asset_id bigint, track_id bigint, seq bigint, time_ms bigint, video_key boolean")
    got = {(x.asset_id, x.seq): x.fragment_no for x in timeline.webm_fragments(df.repartition(7), ["seq"], 6).collect()}
    for a in range(20):
        mine, run, open_ = [x for x in rows if x[0] == a], -1, []
        for x in mine:
            times = [y[3] for y in open_] + [x[3]]
            if not open_ or x[4] or len(open_) >= 6 or max(times) - min(times) > 30_000:
                run, open_ = run + 1, []
            open_.append(x)
            assert got[a, x[2]] == run
    with pytest.raises(Exception, match="exceeds"):
        timeline.avi_segments(df.withColumn("size_bytes", F.lit(500)), 100, ["seq"]).collect()


def test_decrypt_of_many_files(engine):
    from cadenza.functions import crypto

    (v, vd) = video(6)
    key, kid, iv = bytes(range(16)), bytes(range(16, 32)), bytes(range(1, 17))
    clear = mp4.write([v], [vd])
    rows = engine.decrypt(engine.source([clear, b"nothing"]), {kid: key}).collect()
    assert {r.asset_id: r.status for r in rows} == {0: "ok", 1: "failed"}
    pad = lambda d: d + bytes([16 - len(d) % 16]) * (16 - len(d) % 16)
    sealed = crypto.cbc(key, iv, pad(b"G" + bytes(500)), encrypt=True)
    assert engine.decrypt(sealed, key, scheme="hls-aes128", iv=iv) == b"G" + bytes(500)
    with pytest.raises(EngineError):
        engine.decrypt(sealed[:-1], key, scheme="hls-aes128", iv=iv)
    with pytest.raises(CapabilityError):
        engine.decrypt(sealed, key, scheme="rot13", iv=iv)


def test_decrypt_sample_aes(engine):
    from cadenza.functions import crypto
    from cadenza.sources.containers import mpegts
    from cadenza.sources.containers.base import Packet, Track

    key, iv = bytes(range(16)), bytes(range(1, 17))
    raw = bytes([0x65]) + bytes(i % 250 + 4 for i in range(700))
    locked = bytearray(raw)
    starts = list(range(32, len(raw) - 16, 160))
    body = crypto.cbc(key, iv, b"".join(raw[a : a + 16] for a in starts), encrypt=True)
    for n, a in enumerate(starts):
        locked[a : a + 16] = body[16 * n : 16 * n + 16]
    if b"\0\0\3" in bytes(locked) or b"\0\0\1" in bytes(locked):
        pytest.skip("the ciphertext holds a start code")
    access = lambda nal: b"\0\0\0\1\x09\xf0\0\0\1" + bytes(nal)
    adts = lambda payload: bytes([0xFF, 0xF1, 0x50, 0x80 | (len(payload) + 7) >> 11, (len(payload) + 7) >> 3 & 255, ((len(payload) + 7) & 7) << 5 | 0x1F, 0xFC]) + payload
    sound = bytes(i % 256 for i in range(130))
    sealed = sound[:16] + crypto.cbc(key, iv, sound[16:128], encrypt=True) + sound[128:]
    video_track, audio_track = Track(1, "video", "avc1"), Track(2, "audio", "mp4a.40.2")
    video_track.packets = [Packet(None, 0, 0, 0, 40_000, True)]
    audio_track.packets = [Packet(None, 0, 0, 0, 20_000, True)]
    data = mpegts.write([video_track, audio_track], [[access(locked)], [adts(sealed) + adts(sealed)]])
    out = mpegts.movie(engine.decrypt(data, key, scheme="hls-sample-aes", iv=iv))
    assert [t.packets[0].data for t in out.tracks] == [access(raw), adts(sound) + adts(sound)]


def test_render(engine, spark):
    from cadenza.functions import pixels

    image = np.random.default_rng(1).integers(0, 256, (6, 8, 4), np.uint8)
    frames = spark.createDataFrame([(0, 0, 0, 0, 0, 8, 6, bytearray(image.tobytes()), None, "pq")], "asset_id bigint, track_id int, frame_no bigint, ts_us bigint, duration_us bigint, width int, height int, rgba binary, primaries string, transfer string")
    row = engine.render(frames, tonemap="sdr", flip="vertical", rotate=90, width=4, height=2, crop=(1, 1, 6, 4)).first()
    want = pixels.tonemap(pixels.flip(pixels.rotate(pixels.resize(pixels.crop(image, 1, 1, 6, 4), 4, 2), 90), "vertical"), "bt709", "pq")
    assert (row.width, row.height) == (2, 4) and bytes(row.rgba) == np.ascontiguousarray(want).tobytes() and (row.primaries, row.transfer) == ("bt709", "bt709")
    assert bytes(engine.render(frames, width=8).first().rgba) == image.tobytes()
    with pytest.raises(InputError):
        engine.render(frames, sharpen=1)
    with pytest.raises(InputError):
        engine.render(frames, crop=(0, 0, 0, 3))
    assert pixels.source_color("BT.2020", "iec61966-2-1") == ("bt2020", "srgb") and pixels.source_color("?", None) == ("bt709", "bt709")
