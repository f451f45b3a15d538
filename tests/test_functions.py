import hashlib
import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from cadenza.errors import CapabilityError, InputError
from cadenza.functions import crypto, dsp, pcm, pixels, tags
from cadenza.plans import targets
from cadenza.sources import manifest

KEY = bytes.fromhex("2b7e151628aed2a6abf7158809cf4f3c")
PLAIN = bytes.fromhex("6bc1bee22e409f96e93d7e117393172aae2d8a571e03ac9c9eb76fac45af8e51")
IV = bytes(range(16))


def test_aes_vectors():
    assert crypto.cbc(KEY, IV, PLAIN, True).hex() == "7649abac8119b246cee98e9b12e9197d5086cb9b507219ee95db113a917678b2"
    assert crypto.cbc(KEY, IV, crypto.cbc(KEY, IV, PLAIN, True)) == PLAIN
    counter = bytes.fromhex("f0f1f2f3f4f5f6f7f8f9fafbfcfdfeff")
    assert crypto.ctr(KEY, counter, PLAIN).hex() == "874d6191b620e3261bef6864990db6ce9806f66b7970fdff8617187bb9fffdff"
    assert crypto.encrypt_blocks(bytes(range(32)), np.frombuffer(bytes.fromhex("00112233445566778899aabbccddeeff"), np.uint8)[None]).tobytes().hex() == "8ea2b7ca516745bfeafc49904b496089"
    with pytest.raises(InputError):
        crypto.ctr(KEY, b"\0" * 8 + b"\xff" * 8, PLAIN)


def test_aes_agrees_with_spark(spark):
    data = bytes(range(200))
    df = spark.createDataFrame([(bytearray(data),)], "d binary")
    sealed = df.select(F.aes_encrypt("d", F.lit(KEY), F.lit("CBC"), F.lit("PKCS"), F.lit(IV)).alias("s")).first().s
    assert crypto.cbc(KEY, IV, bytes(sealed[16:]))[: len(data)] == data
    assert bytes(df.select(crypto.hls_aes128(F.lit(bytes(sealed[16:])), F.lit(KEY), F.lit(IV)).alias("x")).first().x) == data


def test_samples():
    data = bytes(range(256)) * 2
    whole = crypto.ctr(KEY, IV[:8] + bytes(8), data)
    assert crypto.decrypt_sample("cenc", KEY, IV[:8], whole) == data
    subs = [(10, 64), (5, 433)]
    body = data[10:74] + data[79:]
    sealed = crypto.ctr(KEY, IV[:8] + bytes(8), body)
    mixed = data[:10] + sealed[:64] + data[74:79] + sealed[64:]
    assert crypto.decrypt_sample("cenc", KEY, IV[:8], mixed, subs) == data
    odd = [(0, 20), (0, 492)]
    once = crypto.decrypt_sample("cenc", KEY, IV[:8], data, odd, continuous=True)
    assert once == whole and crypto.decrypt_sample("cenc", KEY, IV[:8], data, odd) != whole
    protected = bytearray(data)
    blocks = [b for b in range(32) if b % 10 < 1]
    plain = crypto.cbc(KEY, IV, b"".join(data[16 * b : 16 * b + 16] for b in blocks), True)
    for i, b in enumerate(blocks):
        protected[16 * b : 16 * b + 16] = plain[16 * i : 16 * i + 16]
    assert crypto.decrypt_sample("cbcs", KEY, IV, bytes(protected), None, (1, 9)) == data
    twice = crypto.decrypt_sample("cens", KEY, IV[:8], data, [(0, 100), (7, 405)], (2, 3))
    assert crypto.decrypt_sample("cens", KEY, IV[:8], twice, [(0, 100), (7, 405)], (2, 3)) == data


def blocks(spark, x, rate=8000, size=100):
    rows = [(1, 0, k, a, rate, len(x), [c[a : a + size].tolist() for c in x]) for k, a in enumerate(range(0, x.shape[1], size))]
    return spark.createDataFrame(rows, "asset_id bigint, track_id int, block_no bigint, start_frame bigint, sample_rate int, channels int, planar array<array<double>>")


def signal_of(df):
    rows = sorted(df.collect(), key=lambda r: r.block_no)
    return np.concatenate([np.array(r.planar) for r in rows], axis=1)


@pytest.mark.parametrize("fmt", list(pcm.WIDTH))
@pytest.mark.parametrize("big", [False, True])
def test_pcm_codec(fmt, big):
    x = np.array([[-1.0, -0.5, 0, 0.25, 0.5, 0.999, 3.0], [1, -1, 0.1, 0, 0, 0, -3.0]])
    y = pcm.decode(pcm.encode(x, fmt, big), fmt, 2, big)
    limit = 0 if fmt == "f64" else 1e-6 if fmt == "f32" else 2.0 ** -(8 * pcm.WIDTH[fmt] - 1)
    inside = np.abs(x) <= 1
    assert np.abs(y - x)[inside].max() <= limit + 1e-12
    assert pcm.decode(b"\1" * (pcm.WIDTH[fmt] * 2 + 1), fmt, 2).shape == (2, 1)
    with pytest.raises(InputError):
        pcm.decode(b"", fmt, 0)


def test_resample(spark):
    rate, out = 8000, 12_000
    x = np.sin(2 * np.pi * 440 * np.arange(4000) / rate)[None]
    y = dsp.resample_signal(x, rate, out)
    want = np.sin(2 * np.pi * 440 * np.arange(6000) / out)
    assert y.shape == (1, 6000) and np.abs(y[0, 200:-200] - want[200:-200]).max() < 1e-4
    assert (dsp.resample_signal(x, rate, rate) == x).all()
    dc = dsp.resample_signal(np.ones((1, 3000)), 48_000, 44_100)
    assert dc.shape[1] == 2756 and np.abs(dc[0, 100:-100] - 1).max() < 1e-3
    assert np.abs(dsp.resample_signal(np.sin(2 * np.pi * 3900 * np.arange(4000) / 8000)[None], 8000, 4000)[0, 200:-200]).max() < 1e-2
    assert np.allclose(signal_of(dsp.resample(blocks(spark, x), out)), y)
    with pytest.raises(CapabilityError):
        dsp.resample_signal(x, rate, 0)


@pytest.mark.parametrize("kind", ["lowpass", "highpass", "bandpass", "notch", "peaking", "lowshelf", "highshelf"])
def test_biquad(spark, kind):
    f = dsp.design_biquad(kind, 1000, 8000, 0.9, 6.0)
    assert f.stable()
    impulse = np.zeros((1, 4096))
    impulse[0, 0] = 1
    y, _ = dsp.biquad_signal(impulse, f)
    spectrum = np.abs(np.fft.rfft(y[0]))
    for k in (1, 100, 700, 2000):
        assert spectrum[k] == pytest.approx(f.magnitude(k * 8000 / 4096, 8000), abs=1e-6)
    dc, top = f.magnitude(1e-3, 8000), f.magnitude(3999.9, 8000)
    want = {"lowpass": (1, 0), "highpass": (0, 1), "bandpass": (0, 0), "notch": (1, 1), "peaking": (1, 1), "lowshelf": (10 ** (6 / 20), 1), "highshelf": (1, 10 ** (6 / 20))}[kind]
    assert (dc, top) == pytest.approx(want, abs=1e-3)
    x = np.random.default_rng(2).normal(size=(2, 350)) / 4
    whole, _ = dsp.biquad_signal(x, f)
    assert np.array_equal(signal_of(dsp.biquad(blocks(spark, x), kind, 1000, 0.9, 6.0)), whole)
    folded = blocks(spark, x, size=350).select(F.transform("planar", lambda c: dsp.biquad_array(c, f)).alias("p")).first().p
    assert np.array_equal(np.array(folded), whole)


def test_biquad_refuses():
    for bad in ((0, 8000, 1), (4000, 8000, 1), (100, 8000, 0)):
        with pytest.raises(InputError):
            dsp.design_biquad("lowpass", *bad)
    with pytest.raises(InputError):
        dsp.design_biquad("peaking", 100, 8000)


def test_fades(spark):
    x = np.ones((1, 250))
    got = signal_of(dsp.fade_out(dsp.fade_in(blocks(spark, x), 11), 120, "equal-power"))[0]
    assert got[0] == 0 and got[5] == 0.5 and got[10] == 1 and got[130] == 1 and abs(got[-1]) < 1e-12
    assert got[190] == pytest.approx(math.cos(60 / 119 * math.pi / 2))
    assert signal_of(dsp.fade_in(blocks(spark, x), 1))[0, 0] == 0
    assert (signal_of(dsp.fade_in(blocks(spark, x), 9999))[0][[0, -1]] == [0, 1]).all()


def test_remix_refuses(spark):
    with pytest.raises(CapabilityError):
        dsp.remix(blocks(spark, np.ones((3, 10))), 3, 2)


def image(h=4, w=6):
    return np.random.default_rng(3).integers(0, 256, (h, w, 4)).astype(np.uint8)


def test_pixels():
    i = image()
    assert (pixels.resize(i, 6, 4) == i).all()
    assert (pixels.rotate(pixels.rotate(i, 90), 270) == i).all() and pixels.rotate(i, 90).shape == (6, 4, 4)
    assert (pixels.rotate(i, 90)[0, 0] == i[-1, 0]).all()
    assert (pixels.flip(pixels.flip(i, "vertical"), "vertical") == i).all()
    contained = pixels.resize(i, 6, 6, "contain")
    assert contained.shape == (6, 6, 4) and not contained[0].any() and (contained[1:5] == i).all()
    assert pixels.resize(i, 3, 3, "cover").shape == (3, 3, 4)
    flat = np.full((5, 5, 4), 77, np.uint8)
    assert (pixels.resize(flat, 9, 2) == 77).all()
    with pytest.raises(InputError):
        pixels.crop(i, 4, 0, 3, 1)
    color, grey = pixels.split_alpha(i)
    assert (pixels.merge_alpha(color, grey) == i).all()


def test_color():
    m = pixels.rgb_to_xyz("srgb")
    assert m[0, 0] == pytest.approx(0.4123908, abs=1e-6) and m[1, 1] == pytest.approx(0.7151687, abs=1e-6)
    assert pixels.gamut("bt2020", "bt709")[0] == pytest.approx([1.6605, -0.5876, -0.0728], abs=1e-3)
    x = np.linspace(0, 1, 101)
    for t in ("srgb", "bt709", "pq", "hlg", "linear"):
        assert np.abs(pixels.from_linear(t, pixels.to_linear(t, x)) - x).max() < 1e-6, t
    assert pixels.to_linear("pq", np.array([1.0]))[0] == pytest.approx(100) and pixels.to_linear("hlg", np.array([1.0]))[0] == pytest.approx(12)
    grey = np.full((1, 1, 4), 128, np.uint8)
    assert (pixels.colorspace(grey, "bt709", "srgb", "sRGB") == grey).all()
    assert (pixels.tonemap(np.full((1, 1, 4), 255, np.uint8), "bt2020", "pq") == 255).all()
    assert [pixels.parse_colorspace(s) for s in ("Rec. 709", "smpte170m", "BT.2020-NCL", "x")] == ["bt709", "bt601", "bt2020", None]
    with pytest.raises(CapabilityError):
        pixels.colorspace(grey, "bt709", "srgb", "nope")


def test_plans():
    assert targets.bit_depth("avc1.6E001E") == 10 and targets.bit_depth("hvc1.2.4.L93") == 10 and targets.bit_depth("av01.0.04M.10") == 10 and targets.bit_depth("vp8") == 8
    assert targets.bit_depth_plan("avc1.6E001E", "avc1.42E01E")["kind"] == "downconvert"
    with pytest.raises(CapabilityError):
        targets.bit_depth_plan(8, 10)
    for bad in ({"bitrate": 1, "crf": 2}, {"two_pass": True}, {"codec": "h264", "crf": 52}, {"bitrate": 0}):
        with pytest.raises(InputError):
            targets.rate_control(**bad)


def test_tags(spark):
    df = spark.range(1).select(F.create_map(*[F.lit(x) for x in (" Album-Artist", "x", "", "gone", "title", "a", "TITLE", "b")]).alias("t"))
    assert df.select(tags.normalize_tags(F.col("t")).alias("t")).first().t == {"albumArtist": "x", "title": "b"}
    with pytest.raises(Exception, match="NUL"):
        spark.createDataFrame([({"a": "x\0"},)], "t map<string,string>").select(tags.normalize_tags(F.col("t"))).collect()
    keys = spark.createDataFrame([("albumartist",), ("my key!",), ("  ",)], "k string").select(tags.vorbis_key(F.col("k")).alias("v")).collect()
    assert [r.v for r in keys] == ["ALBUMARTIST", "MY_KEY_", "TAG"]
    back = spark.createDataFrame([("TRACKNUMBER",), ("Own",)], "k string").select(tags.from_vorbis_key(F.col("k")).alias("v")).collect()
    assert [r.v for r in back] == ["trackNumber", "own"]


MASTER = """﻿#EXTM3U\r\n#EXT-X-STREAM-INF:BANDWIDTH=1280000,RESOLUTION=640x360,CODECS="avc1.42E01E,mp4a.40.2",FRAME-RATE=29.97\r\nlow/index.m3u8\r\norphan.m3u8\r\n#EXT-X-STREAM-INF:BANDWIDTH=2560000,AVERAGE-BANDWIDTH=2000000\r\nhttp://x/high.m3u8\r\n"""


def test_playlists(spark):
    df = spark.createDataFrame([(1, MASTER)], "asset_id bigint, text string")
    v = manifest.variants(df).orderBy("idx").collect()
    assert [(r.uri, r.bandwidth, r.width, r.codecs) for r in v] == [("low/index.m3u8", 1280000, 640, "avc1.42E01E,mp4a.40.2"), ("http://x/high.m3u8", 2560000, None, None)]
    assert manifest.is_master(df).first().is_master
    base = F.lit("http://h/a/b.m3u8?x=/y")
    got = df.select(*[manifest.resolve_uri(base, F.lit(u)).alias(str(i)) for i, u in enumerate(("c.ts", "/d.ts", "https://z/e", "//q/f"))]).first()
    assert list(got) == ["http://h/a/c.ts", "http://h/d.ts", "https://z/e", "http://q/f"]
    with pytest.raises(Exception, match="M3U8"):
        manifest.segments(spark.createDataFrame([(1, "no")], "asset_id bigint, text string")).collect()


def test_hls_assembly(spark):
    text = '#EXTM3U\n#EXT-X-MEDIA-SEQUENCE:5\n#EXT-X-KEY:METHOD=AES-128,URI="k"\n#EXTINF:1,\na\n#EXT-X-KEY:METHOD=NONE\n#EXT-X-BYTERANGE:3@1\n#EXTINF:1,\nb\n#EXT-X-ENDLIST\n'
    iv = (5).to_bytes(16, "big")
    padded = b"hello" + bytes([11]) * 11
    bodies = spark.createDataFrame([("a", bytearray(crypto.cbc(KEY, iv, padded, True))), ("b", bytearray(b"xworldx"))], "uri string, content binary")
    keys = spark.createDataFrame([("k", bytearray(KEY))], "uri string, key binary")
    df = spark.createDataFrame([(1, text)], "asset_id bigint, text string")
    assert bytes(manifest.assemble(manifest.segments(df), bodies, keys).first().content) == b"hellowor"
    live = spark.createDataFrame([(1, text.replace("#EXT-X-ENDLIST", ""))], "asset_id bigint, text string")
    with pytest.raises(Exception, match="live"):
        manifest.assemble(manifest.segments(live), bodies, keys).collect()


def test_sample_decryption_reads_whole_texts(spark, tmp_path):
    from cadenza.plans import queries_functions as qf

    texts = [None, "", "a", "ab", "x" * 20, "y" * 5000, "".join(chr(97 + i * i % 26) for i in range(70_001))]
    spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))
    iv = qf._IV[:8] + bytes(8)

    def one_by_one(data, pattern):
        out, last = data[:1], iv
        for k, at in enumerate(range(1, len(data), 16)):
            block = data[at : at + 16]
            if pattern and len(block) == 16 and k % 10 == 0:
                got = crypto.decrypt_blocks(qf._KEY, np.frombuffer(block, np.uint8)[None])[0].tobytes()
                block, last = bytes(a ^ b for a, b in zip(got, last, strict=True)), block
            elif not pattern:
                counter = iv[:8] + k.to_bytes(8, "big")
                block = bytes(a ^ b for a, b in zip(block, crypto.encrypt_blocks(qf._KEY, np.frombuffer(counter, np.uint8)[None])[0].tobytes(), strict=False))
            out += block
        return hashlib.md5(out).hexdigest()

    for name, pattern in (("aes_ctr", False), ("aes_cbc_pattern", True)):
        got = {r.doc_id: r.md5 for r in qf.QUERIES[name](spark, str(tmp_path)).collect()}
        assert got == {i: None if t is None else one_by_one(t.encode(), pattern) for i, t in enumerate(texts)}
