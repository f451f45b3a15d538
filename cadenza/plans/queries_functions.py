"""Registered queries of audio, pixel, plan, byte, tag, crypto, container and streaming functions."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import crypto, dsp, pcm, pixels, tags
from ..session import prepare
from ..sources import files, manifest
from ..streaming import stages
from ..streaming.replay import replay
from . import projections as p
from . import router, targets

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None, ctes: tuple[str, ...] = ()):
    def add(f):
        QUERIES[name] = f
        if sql:
            head = ", ".join(p.SQL[c] for c in ctes)
            ORACLES[name] = (f"WITH {head}, {sql.strip()[5:]}" if sql.strip().startswith("WITH ") else f"WITH {head} {sql}") if head else sql
        return f

    return add


def _long(blocks: DataFrame, places: int = 9) -> DataFrame:
    """(asset_id, block_no, ch, i, x) rounded, for comparison row by row."""
    rows = blocks.select("asset_id", "block_no", F.posexplode("planar").alias("ch", "c")).select("asset_id", "block_no", "ch", F.posexplode("c").alias("i", "x"))
    return rows.select("asset_id", F.col("block_no").cast("bigint").alias("block_no"), F.col("ch").cast("bigint").alias("ch"), F.col("i").cast("bigint").alias("i"), F.round("x", places).alias("x"))


_L = "l AS (SELECT asset_id, block_no, i - 1 AS i, x[i] AS x FROM (SELECT *, unnest(range(1, 65)) AS i FROM pcm)), z AS (SELECT *, block_no * 64 + i AS f, max(block_no) OVER (PARTITION BY asset_id) * 64 + 64 AS n FROM l)"


def _sql(x: str, ch: str = "0") -> str:
    return f"WITH {_L} SELECT asset_id, block_no, {ch}::BIGINT AS ch, i, round({x}, 9) AS x FROM z"


def _stereo(spark, d) -> DataFrame:
    """Even positions left, odd ones right."""
    c = F.get("planar", F.lit(0))
    half = lambda r: F.filter(c, lambda x, i: i % 2 == r)
    return p.pcm(spark, d).withColumns({"planar": F.array(half(0), half(1)), "channels": F.lit(2), "start_frame": F.col("block_no") * 32})


@query("gain", _sql("x * pow(10, -6.0 / 20)"), ("pcm",))
def gain(spark, d):
    return _long(dsp.gain(p.pcm(spark, d), -6.0))


@query("fade_in", _sql("CASE WHEN f < least(100, n) THEN x * (f / greatest(least(100, n) - 1, 1)) ELSE x END"), ("pcm",))
def fade_in(spark, d):
    return _long(dsp.fade_in(p.pcm(spark, d), 100))


_FADE_OUT = _sql("CASE WHEN f - (n - least(100, n)) >= 0 THEN x * cos((f - (n - least(100, n))) / greatest(least(100, n) - 1, 1) * pi() / 2) ELSE x END")


@query("fade_out", _FADE_OUT, ("pcm",))
def fade_out(spark, d):
    return _long(dsp.fade_out(p.pcm(spark, d), 100, "equal-power"))


@query(
    "remix",
    "WITH m AS (SELECT asset_id, block_no, unnest(range(32)) AS i, x FROM pcm) SELECT asset_id, block_no, 0::BIGINT AS ch, i, round(0.5 * (x[2 * i + 1] + x[2 * i + 2]), 9) AS x FROM m",
    ("pcm",),
)
def remix(spark, d):
    return _long(dsp.remix(_stereo(spark, d), 2, 1))


@query(
    "remix_surround",
    """WITH m AS (SELECT asset_id, block_no, unnest(range(11)) AS i, x || [0.0::DOUBLE, 0.0::DOUBLE] AS x FROM pcm), s AS (SELECT *, x[6 * i + 1] AS l, x[6 * i + 2] AS r, x[6 * i + 3] AS c, x[6 * i + 5] AS ls, x[6 * i + 6] AS rs FROM m)
SELECT asset_id, block_no, 0::BIGINT AS ch, i, round(l + sqrt(0.5) * c + sqrt(0.5) * ls, 9) AS x FROM s UNION ALL SELECT asset_id, block_no, 1::BIGINT AS ch, i, round(r + sqrt(0.5) * c + sqrt(0.5) * rs, 9) AS x FROM s""",
    ("pcm",),
)
def remix_surround(spark, d):
    c = F.concat(F.get("planar", F.lit(0)), F.array(F.lit(0.0), F.lit(0.0)))  # 64 samples as 11 frames of six, the last one filled up
    every_sixth = lambda k: F.filter(c, lambda x, i: i % 6 == k)
    six = p.pcm(spark, d).withColumns({"planar": F.array(*[every_sixth(k) for k in range(6)]), "channels": F.lit(6)})
    return _long(dsp.remix(six, 6, 2))


@query("limit_hard", _sql("greatest(-pow(10, -20.0 / 20), least(pow(10, -20.0 / 20), x))"), ("pcm",))
def limit_hard(spark, d):
    return _long(dsp.limit(p.pcm(spark, d), -20.0))


@query("limit_soft", _sql("CASE WHEN abs(x) <= 0.09 THEN x ELSE sign(x) * (0.09 + 0.01 * (((abs(x) - 0.09) / 0.01) / ((abs(x) - 0.09) / 0.01 + 1))) END"), ("pcm",))
def limit_soft(spark, d):
    return _long(dsp.limit(p.pcm(spark, d), -20.0, "soft", 0.9))


@query("normalize_peak", f"WITH {_L}, s AS (SELECT *, max(abs(x)) OVER (PARTITION BY asset_id) AS pk FROM z) SELECT asset_id, block_no, 0::BIGINT AS ch, i, round(CASE WHEN pk > 0 THEN x * (pow(10, -3.0 / 20) / pk) ELSE x END, 9) AS x FROM s", ("pcm",))
def normalize_peak(spark, d):
    return _long(dsp.normalize_peak(p.pcm(spark, d), -3.0))


@query("normalize_rms", f"WITH {_L}, s AS (SELECT *, sqrt(avg(x * x) OVER (PARTITION BY asset_id)) AS r FROM z) SELECT asset_id, block_no, 0::BIGINT AS ch, i, round(CASE WHEN r > 0 THEN x * (pow(10, -20.0 / 20) / r) ELSE x END, 6) AS x FROM s", ("pcm",))
def normalize_rms(spark, d):
    return _long(dsp.normalize_rms(p.pcm(spark, d), -20.0), 6)


@query("biquad_lowpass")
def biquad_lowpass(spark, d):
    return _long(dsp.biquad(p.pcm(spark, d), "lowpass", 2000.0))


@query("biquad_array")
def biquad_array(spark, d):
    f = dsp.design_biquad("highpass", 300.0, p.RATE)
    return _long(p.pcm(spark, d).withColumn("planar", F.transform("planar", lambda c: dsp.biquad_array(c, f))))


@query("resample")
def resample(spark, d):
    return _long(dsp.resample(p.pcm(spark, d), 24_000))


@query("pcm_roundtrip", _sql("greatest(-32768, least(32767, floor(x * 32768 + 0.5))) / 32768"), ("pcm",))
def pcm_roundtrip(spark, d):
    prepare(spark)
    blocks = p.pcm(spark, d)
    return _long(blocks.withColumn("planar", pcm.decode_udf("s16", 1)(pcm.encode_udf("s16")(F.col("planar")))))


@query(
    "resize_plan",
    """WITH g AS (SELECT *, least(640 / width, 480 / height) AS s, greatest(640 / width, 480 / height) AS c FROM geometry),
k AS (SELECT *, greatest(1, floor(width * s + 0.5)::BIGINT) AS dw, greatest(1, floor(height * s + 0.5)::BIGINT) AS dh, least(width, greatest(1, floor(640 / c + 0.5)::BIGINT)) AS sw, least(height, greatest(1, floor(480 / c + 0.5)::BIGINT)) AS sh FROM g)
SELECT asset_id, dw, dh, floor((640 - dw) / 2)::BIGINT AS dx, floor((480 - dh) / 2)::BIGINT AS dy, sw, sh, floor((width - sw) / 2)::BIGINT AS sx, floor((height - sh) / 2)::BIGINT AS sy FROM k""",
    ("geometry",),
)
def resize_plan(spark, d):
    w, h = F.col("width"), F.col("height")
    rows = p.geometry(spark, d).select("asset_id", pixels.resize_plan(w, h, 640, 480, "contain").alias("a"), pixels.resize_plan(w, h, 640, 480, "cover").alias("b"))
    return rows.select("asset_id", "a.dw", "a.dh", "a.dx", "a.dy", "b.sw", "b.sh", "b.sx", "b.sy")


@query("crop_plan", "SELECT asset_id, width >= 120 AND height >= 90 AS fits FROM geometry", ("geometry",))
def crop_plan(spark, d):
    return p.geometry(spark, d).select("asset_id", pixels.crop_fits(F.col("width"), F.col("height"), 20, 10, 100, 80).alias("fits"))


@query("rotate_dims", "SELECT asset_id, height AS width, width AS height FROM geometry", ("geometry",))
def rotate_dims(spark, d):
    w, h = pixels.rotated_size(F.col("width"), F.col("height"), 90)
    return p.geometry(spark, d).select("asset_id", w.alias("width"), h.alias("height"))


@query(
    "h264_level",
    "WITH v(idc, fs, mbps) AS (VALUES " + ", ".join(f"({a}, {b}, {c})" for a, b, c in targets.H264_LEVELS) + """),
b AS (SELECT asset_id, ceil(width / 16)::BIGINT * ceil(height / 16)::BIGINT AS mbs FROM geometry)
SELECT asset_id, coalesce((SELECT min(idc) FROM v WHERE mbs <= fs AND mbs * 60 <= mbps), 62)::INTEGER AS level, 'avc1.42E0' || lpad(upper(to_hex(greatest(30, coalesce((SELECT min(idc) FROM v WHERE mbs <= fs AND mbs * 60 <= mbps), 62)))), 2, '0') AS codec FROM b""",
    ("geometry",),
)
def h264_level(spark, d):
    w, h, fps = F.col("width"), F.col("height"), F.lit(60.0)
    return p.geometry(spark, d).select("asset_id", targets.h264_level(w, h, fps).alias("level"), targets.h264_codec_string(w, h, fps).alias("codec"))


@query("trim_bitrate", "SELECT asset_id, least(50000000, greatest(4000000, floor(width * height * 30 * 0.45 + 0.5)))::BIGINT AS bitrate FROM geometry", ("geometry",))
def trim_bitrate(spark, d):
    return p.geometry(spark, d).select("asset_id", targets.trim_bitrate(F.col("width"), F.col("height"), F.lit(0.0)).alias("bitrate"))


@query(
    "sniff_container",
    "SELECT page_id, CASE WHEN lower(regexp_extract(url, '\\.([A-Za-z0-9]+)$', 1)) IN ('mp4','m4a','m4v','mov') THEN 'mp4' WHEN starts_with(html, 'RIFF') AND substr(html, 9, 4) = 'WAVE' THEN 'wav' WHEN starts_with(html, 'ID3') THEN 'mp3' WHEN starts_with(html, 'OggS') THEN 'ogg' WHEN starts_with(html, 'fLaC') THEN 'flac' WHEN starts_with(html, 'G') THEN 'ts' END AS container FROM pages",
)
def sniff_container(spark, d):
    pages = p.table(spark, d, "pages")
    return pages.select("page_id", router.route_container(F.substring(F.col("html").cast("binary"), 1, files.HEAD), F.lit(None).cast("string"), F.regexp_extract("url", r"\.([A-Za-z0-9]+)$", 1)).alias("container"))


_DRIVERS = [("soft-h264", "video", 0, "wasm"), ("gpu-h264", "video", 1, "gpu"), ("hw-h264", "video", 2, "hardware"), ("native-h264", "video", 5, "native"), ("native-aac", "audio", 3, "native"), ("soft-aac", "audio", 4, "wasm")]


@query(
    "route_codec",
    "SELECT asset_id, CASE WHEN width * height <= 4096 THEN 'native-h264' ELSE 'gpu-h264' END AS driver, width * height <= 4096 AS tiny FROM geometry",
    ("geometry",),
)
def route_codec(spark, d):
    drivers = spark.createDataFrame(_DRIVERS, "driver string, kind string, ordinal int, tier string")
    requests = p.geometry(spark, d).select("asset_id", F.lit("video").alias("kind"), router.is_tiny(output_pixels=F.col("width") * F.col("height")).alias("tiny"))
    picked = router.pick(requests, drivers.where("tier != 'hardware'"), "kind", router.codec_rank(F.col("tier"), F.col("tiny")), "asset_id")
    return requests.join(picked.select("asset_id", "driver"), "asset_id").select("asset_id", "driver", "tiny")


_SUBSTRATES = [("f-wasm", "resize", 0, "wasm"), ("f-gl", "resize", 1, "webgl"), ("f-gpu", "resize", 2, "webgpu"), ("f-2d", "resize", 3, "canvas2d"), ("f-cpu", "resize", 4, "native")]


@query("route_filter", "SELECT asset_id, CASE WHEN width * height <= 4096 THEN 'f-cpu' ELSE 'f-gpu' END AS driver FROM geometry", ("geometry",))
def route_filter(spark, d):
    drivers = spark.createDataFrame(_SUBSTRATES, "driver string, kind string, ordinal int, substrate string")
    requests = p.geometry(spark, d).select("asset_id", F.lit("resize").alias("kind"), router.is_tiny(output_pixels=F.col("width") * F.col("height")).alias("tiny"))
    return router.pick(requests, drivers, "kind", router.filter_rank(F.col("substrate"), F.col("tiny")), "asset_id").select("asset_id", "driver")


@query("tiny_cost", "SELECT doc_id, octet_length(encode(text)) BETWEEN 1 AND 65536 OR coalesce(n_chars BETWEEN 1 AND 48000, false) AS tiny FROM documents")
def tiny_cost(spark, d):
    return p.table(spark, d, "documents").select("doc_id", router.is_tiny(input_bytes=F.octet_length("text"), audio_frames=F.col("n_chars")).alias("tiny"))


@query(
    "tag_normalize",
    r"""WITH k AS (SELECT DISTINCT source, lang FROM documents), c AS (SELECT source, lang, regexp_replace(trim(' Album-' || source || ' x '), '[\s-]+', '_', 'g') AS a FROM k)
SELECT source, lang, a AS key_a, CASE lower(lang) WHEN 'en' THEN 'albumArtist' ELSE 'trackNumber' END AS key_b, upper(regexp_replace(a, '[^A-Za-z0-9_]', '_', 'g')) AS vorbis FROM c""",
)
def tag_normalize(spark, d):
    rows = p.table(spark, d, "documents").select("source", "lang").distinct()
    a = F.concat(F.lit(" Album-"), "source", F.lit(" x "))
    b = F.when(F.col("lang") == "en", F.lit("Album Artist")).otherwise(F.lit(" Track-Number "))
    return rows.select("source", "lang", tags.public_key(a).alias("key_a"), tags.public_key(b).alias("key_b"), tags.vorbis_key(a).alias("vorbis"))


@query(
    "tag_upsert",
    """WITH k AS (SELECT doc_id, source, lang FROM documents) SELECT doc_id, 'artist' AS key, 'new ' || lang AS value FROM k UNION ALL SELECT doc_id, 'title' AS key, source AS value FROM k UNION ALL SELECT doc_id, 'comment' AS key, lang AS value FROM k""",
)
def tag_upsert(spark, d):
    rows = p.table(spark, d, "documents")
    old = F.create_map(F.lit("title"), F.col("source"), F.lit("Artist"), F.lit("old"))
    new = F.create_map(F.lit("ARTIST"), F.concat(F.lit("new "), "lang"), F.lit(" comments"), F.col("lang"))
    return rows.select("doc_id", F.explode(tags.upsert_tags(old, new)).alias("key", "value"))


@query("byte_range", "SELECT doc_id, lower(hex(encode(substr(regexp_replace(text, '[^a-z ]', '', 'g'), 6, 10)))) AS bytes FROM documents")
def byte_range(spark, d):
    docs = p.table(spark, d, "documents").select(F.col("doc_id").alias("asset_id"), F.regexp_replace("text", "[^a-z ]", "").cast("binary").alias("content"))
    return files.byte_range(docs, 5, 15).select(F.col("asset_id").alias("doc_id"), F.lower(F.hex("bytes")).alias("bytes"))


@query("digests", "SELECT doc_id, md5(text) AS md5, sha256(text) AS sha256 FROM documents")
def digests(spark, d):
    return p.table(spark, d, "documents").select("doc_id", F.md5(F.col("text").cast("binary")).alias("md5"), F.sha2(F.col("text").cast("binary"), 256).alias("sha256"))


_KEY, _IV = bytes(range(16)), bytes(range(16, 32))


@query("aes_hls", "SELECT doc_id, md5(text) AS md5 FROM documents")
def aes_hls(spark, d):
    key, iv = F.lit(_KEY), F.lit(_IV)
    docs = p.table(spark, d, "documents")
    sealed = F.substr(F.aes_encrypt(F.col("text").cast("binary"), key, F.lit("CBC"), F.lit("PKCS"), iv), F.lit(17))
    return docs.select("doc_id", F.md5(crypto.hls_aes128(sealed, key, iv)).alias("md5"))


def _sample_md5(spark, d, scheme: str, crypt: int, skip: int) -> DataFrame:
    """Whole texts, their first byte clear; an empty text gives the MD5 of nothing, a null text null."""
    prepare(spark)
    docs = p.table(spark, d, "documents").select("doc_id", F.col("text").cast("binary").alias("data"))
    open_ = crypto.decrypt_udf(scheme)
    n = F.octet_length("data")
    clear, size = F.array(F.least(n, F.lit(1))), F.array(F.greatest(n - 1, F.lit(0)))
    return docs.select("doc_id", F.md5(open_(F.col("data"), F.lit(_KEY), F.lit(_IV[:8] + bytes(8)), clear, size, F.lit(crypt), F.lit(skip))).alias("md5"))


@query("aes_ctr")
def aes_ctr(spark, d):
    return _sample_md5(spark, d, "cenc", 0, 0)


@query("aes_cbc_pattern")
def aes_cbc_pattern(spark, d):
    return _sample_md5(spark, d, "cbcs", 1, 9)


_PLAYLIST = "#EXTM3U\n#EXT-X-TARGETDURATION:6\n#EXT-X-MEDIA-SEQUENCE:{n}\n#EXT-X-KEY:METHOD=AES-128,URI=\"k,{n}\"\n#EXTINF:5.5,\na.ts\n#EXT-X-KEY:METHOD=NONE\n#EXT-X-BYTERANGE:100@{n}\n#EXTINF:4,t\nb.ts\norphan.ts\n#EXT-X-ENDLIST\n"


@query(
    "m3u8_parse",
    """SELECT conv_id AS asset_id, idx::BIGINT AS idx, uri, duration_sec, CASE WHEN idx = 0 THEN 'k,' || conv_id END AS key_uri, CASE WHEN idx = 0 THEN lpad(to_hex(conv_id), 32, '0') END AS iv, conv_id + idx AS sequence, CASE WHEN idx = 1 THEN conv_id END AS "offset", true AS end_list
FROM (SELECT DISTINCT conv_id FROM conversations), (VALUES (0, 'a.ts', 5.5::DOUBLE), (1, 'b.ts', 4.0::DOUBLE)) v(idx, uri, duration_sec)""",
)
def m3u8_parse(spark, d):
    text = F.lit(_PLAYLIST)
    rows = p.table(spark, d, "conversations").select(F.col("conv_id").alias("asset_id")).distinct().withColumn("text", F.replace(text, F.lit("{n}"), F.col("asset_id").cast("string")))
    s = manifest.segments(rows)
    return s.select("asset_id", "idx", "uri", "duration_sec", F.col("key.uri").alias("key_uri"), F.upper(F.hex("key.iv")).alias("iv"), "sequence", F.col("byterange.offset").alias("offset"), "end_list")


def _frames(spark, d) -> DataFrame:
    """embeddings as 4 x 4 RGBA frames (64 bytes)."""
    prepare(spark)

    @F.pandas_udf("binary")
    def rgba(v):
        return v.map(lambda x: np.clip(np.floor((np.asarray(x) + 0.5) * 255 + 0.5), 0, 255).astype(np.uint8).tobytes())

    return p.table(spark, d, "embeddings").select(
        F.col("label").cast("bigint").alias("asset_id"), F.lit(0).alias("track_id"), F.col("vec_id").alias("frame_no"), F.lit(0).cast("bigint").alias("ts_us"), F.lit(0).cast("bigint").alias("duration_us"),
        F.lit(4).alias("width"), F.lit(4).alias("height"), rgba("embedding").alias("rgba"), F.lit("bt2020").alias("primaries"), F.lit("pq").alias("transfer"),
    )


def _hex(frames: DataFrame) -> DataFrame:
    return frames.select("frame_no", "width", "height", F.hex("rgba").alias("rgba"))


@query("pixel_geometry")
def pixel_geometry(spark, d):
    return _hex(pixels.apply_kernels(_frames(spark, d), [lambda i, p_, t: pixels.crop(i, 0, 0, 4, 3), lambda i, p_, t: pixels.resize(i, 6, 5, "contain"), lambda i, p_, t: pixels.rotate(i, 90), lambda i, p_, t: pixels.flip(i, "horizontal")]))


@query("pixel_colorspace")
def pixel_colorspace(spark, d):
    return _hex(pixels.apply_kernels(_frames(spark, d).withColumns({"primaries": F.lit("bt601"), "transfer": F.lit("bt709")}), [lambda i, p_, t: pixels.colorspace(i, p_, t, "sRGB")]))


@query("pixel_tonemap")
def pixel_tonemap(spark, d):
    return _hex(pixels.apply_kernels(_frames(spark, d), [lambda i, p_, t: pixels.tonemap(i, p_, t)]))


def _assets(made: DataFrame, container: str) -> DataFrame:
    """Written files opened as assets again."""
    none = F.lit(None).cast("string")
    return files.routed(made.select("asset_id", none.alias("uri"), none.alias("mime"), none.alias("filename"), F.octet_length("content").cast("bigint").alias("size_bytes"), "content"), F.lit(container))


def _files(spark, d, container: str, fmt: str = "s16") -> DataFrame:
    """PCM of every asset written as files of a container and opened as assets again."""
    return _assets(files.write_pcm(p.pcm(spark, d), container, fmt), container)


def _roundtrip(container: str):
    def run(spark, d):
        blocks = files.decode_pcm(_files(spark, d, container), 64)
        return _long(blocks)

    return run


for _name in ("wav", "aiff", "caf", "flac"):
    query(f"{_name}_roundtrip", _sql("greatest(-32768, least(32767, floor(x * 32768 + 0.5))) / 32768"), ("pcm",))(_roundtrip(_name))


@query("probe_files", "SELECT asset_id, 'flac' AS container, count(*) * 64 / 16000 AS duration_sec, 'flac' AS codec, 'ok' AS status FROM pcm GROUP BY asset_id", ("pcm",))
def probe_files(spark, d):
    found = files.probe(_files(spark, d, "flac"))
    return found.select("asset_id", "container", "duration_sec", F.get("tracks", F.lit(0))["codec"].alias("codec"), "status")


_FORMATS = ("s16", "s24", "f32", "s32")


@query(
    "convert_keeps_format",
    f"""WITH {_L}, q AS (SELECT *, asset_id % 4 AS k, CASE asset_id % 4 WHEN 0 THEN 32768.0 WHEN 1 THEN 8388608.0 ELSE 2147483648.0 END::DOUBLE AS top FROM z)
SELECT asset_id, CASE k WHEN 0 THEN 's16' WHEN 1 THEN 's24' WHEN 2 THEN 'f32' ELSE 's32' END AS fmt, f AS frame, round(CASE WHEN k = 2 THEN x::FLOAT::DOUBLE ELSE greatest(-top, least(top - 1, floor(x * top + 0.5))) / top END, 9) AS x FROM q""",
    ("pcm",),
)
def convert_keeps_format(spark, d):
    """WAV files of four sample formats converted to CAF: each keeps its own."""
    from .engine import Engine

    fmt = F.element_at(F.array(*[F.lit(x) for x in _FORMATS]), (F.col("asset_id") % 4 + 1).cast("int"))
    made = files.write_pcm(p.pcm(spark, d).withColumn("fmt", fmt), "wav")
    out = Engine(spark).convert(_assets(made, "wav"), "caf")
    blocks = files.decode_pcm(_assets(out, "caf"), 64, with_format=True)
    rows = blocks.select("asset_id", "fmt", "start_frame", F.posexplode(F.get("planar", F.lit(0))).alias("i", "x"))
    return rows.select("asset_id", "fmt", (F.col("start_frame") + F.col("i")).alias("frame"), F.round("x", 9).alias("x"))


@query("convert_channels", "WITH m AS (SELECT asset_id, block_no, unnest(range(32)) AS i, x FROM pcm) SELECT asset_id, 1 AS channels, block_no * 32 + i AS frame, round(floor(greatest(-32768, least(32767, 0.5 * (floor(x[2 * i + 1] * 32768 + 0.5) + floor(x[2 * i + 2] * 32768 + 0.5)) + 0.5))) / 32768, 9) AS x FROM m", ("pcm",))
def convert_channels(spark, d):
    """Stereo files to mono ones by a chain that names only the number of channels."""
    from .engine import Engine

    made = files.write_pcm(_stereo(spark, d), "wav", "s16")
    out = Engine(spark).load(_assets(made, "wav")).channels(1).to("aiff").run()
    blocks = files.decode_pcm(_assets(out, "aiff"))
    rows = blocks.select("asset_id", "channels", "start_frame", F.posexplode(F.get("planar", F.lit(0))).alias("i", "x"))
    return rows.select("asset_id", "channels", (F.col("start_frame") + F.col("i")).alias("frame"), F.round("x", 9).alias("x"))


def _muxed(container: str):
    """All packets of the projection muxed, an asset's tracks into one file, and demuxed again."""

    def run(spark, d):
        rank = F.dense_rank().over(Window.partitionBy("asset_id").orderBy("track_id")).cast("int")
        time = (F.col("seq") * 40_000).cast("bigint")
        data = F.concat(F.lit(bytes([0, 0, 0, 2, 9, 240])), F.repeat(F.lit("x"), F.col("size_bytes").cast("int")).cast("binary"))
        rows = p.packets(spark, d).withColumn("track_id", rank).withColumns({"pts_us": time, "dts_us": time, "duration_us": F.lit(40_000).cast("bigint"), "data": data})
        video, audio = ("vp9", "opus") if container == "mkv" else ("avc1", "mp4a.40.2")
        is_video = F.col("track_kind") == "video"
        tracks = rows.select("asset_id", "track_id", "track_kind").distinct().withColumns({"codec": F.when(is_video, video).otherwise(audio), "timescale": F.lit(90_000), "duration_sec": F.lit(None).cast("double"), "fps": F.when(is_video, 25.0), "rotation": F.lit(0), "width": F.when(is_video, 64), "height": F.when(is_video, 48), "sample_rate": F.when(~is_video, 16_000), "channels": F.when(~is_video, 1)})
        assets = _assets(files.mux(rows, tracks, container), container)
        back = files.with_payload(files.read_packets(assets), assets)
        return back.select("asset_id", "track_id", "seq", "pts_us", (F.col("size_bytes") - 6).alias("size_bytes"), "keyframe", F.md5("data").alias("md5"))

    return run


for _name, _key in (("mp4", "track_kind = 'audio' OR keyframe OR NOT any_key"), ("mkv", "keyframe"), ("ts", "track_kind = 'audio'")):
    query(
        f"{_name}_roundtrip",
        f"WITH k AS (SELECT *, dense_rank() OVER (PARTITION BY asset_id ORDER BY track_id)::INTEGER AS n, max(keyframe::INT) OVER (PARTITION BY track_id) = 1 AS any_key FROM packets) SELECT asset_id, n AS track_id, seq, seq * 40000 AS pts_us, size_bytes, {_key} AS keyframe, md5(unhex('0000000209F0') || encode(repeat('x', size_bytes))) AS md5 FROM k",
        ("packets",),
    )(_muxed(_name))


@query("stream_limit", _sql("greatest(-pow(10, -20.0 / 20), least(pow(10, -20.0 / 20), x))"), ("pcm",))
def stream_limit(spark, d):
    return _long(replay(p.pcm(spark, d), lambda s: stages.limit(s, -20.0), "block_no"))


@query("stream_fade_out", _FADE_OUT, ("pcm",))
def stream_fade_out(spark, d):
    return _long(replay(p.pcm(spark, d), lambda s: stages.fade(s, 0, 100, "equal-power"), "block_no"))


@query("stream_biquad")
def stream_biquad(spark, d):
    return _long(replay(p.pcm(spark, d), lambda s: stages.biquad(s, "lowpass", 2000.0), "block_no"))


def _filtered(f: dsp.Biquad, key: str, place: str) -> str:
    """The filter as a recursive query: a step a sample, all streams side by side."""
    return f"""WITH RECURSIVE {p.SQL["pcm"]}, x AS (SELECT {key} AS stream, asset_id, block_no, i - 1 AS i, {place} AS f, x[i] AS x FROM (SELECT *, unnest(range(1, 65)) AS i FROM pcm)),
r AS (SELECT stream, asset_id, block_no, i, f, x * {f.b0!r} + 0.0 AS y, x * {f.b1!r} - (x * {f.b0!r} + 0.0) * {f.a1!r} + 0.0 AS z1, x * {f.b2!r} - (x * {f.b0!r} + 0.0) * {f.a2!r} AS z2 FROM x WHERE f = 0 UNION ALL
SELECT x.stream, x.asset_id, x.block_no, x.i, x.f, x.x * {f.b0!r} + r.z1, x.x * {f.b1!r} - (x.x * {f.b0!r} + r.z1) * {f.a1!r} + r.z2, x.x * {f.b2!r} - (x.x * {f.b0!r} + r.z1) * {f.a2!r} FROM r JOIN x ON x.stream = r.stream AND x.f = r.f + 1)
SELECT asset_id, block_no, 0::BIGINT AS ch, i, round(y, 9) AS x FROM r"""


ORACLES["biquad_lowpass"] = ORACLES["stream_biquad"] = _filtered(dsp.design_biquad("lowpass", 2000.0, p.RATE), "asset_id", "block_no * 64 + i - 1")
ORACLES["biquad_array"] = _filtered(dsp.design_biquad("highpass", 300.0, p.RATE), "asset_id * 1000000 + block_no", "i - 1")
ORACLES["resample"] = f"""WITH {p.SQL["pcm"]}, k AS (SELECT {dsp.KAISER_BETA!r} AS beta, {dsp.ZERO_CROSSINGS} AS half, {dsp.PHASES} AS phases),
g AS (SELECT i, i / phases::DOUBLE AS u, beta * sqrt(greatest(0, 1 - pow(i / phases::DOUBLE / half, 2))) AS z, beta FROM k, (SELECT unnest(range({dsp.ZERO_CROSSINGS * dsp.PHASES + 1})) AS i)),
i0 AS (SELECT i, CASE WHEN i = 0 THEN 1.0 ELSE sin(pi() * u) / (pi() * u) END * list_sum([pow(pow(z / 2, n) / gamma(n + 1), 2) FOR n IN range(60)]) / list_sum([pow(pow(beta / 2, n) / gamma(n + 1), 2) FOR n IN range(60)]) AS t FROM g),
w AS (SELECT c, o, (a.t + (coalesce(b.t, 0) - a.t) * (d * {dsp.PHASES} - a.i)) AS w FROM (SELECT c, o, abs(c / 3.0::DOUBLE - o) AS d FROM (SELECT unnest([0, 1, 2]) AS c), (SELECT unnest(range(-{dsp.ZERO_CROSSINGS}, {dsp.ZERO_CROSSINGS + 2})) AS o)) q
  JOIN i0 a ON a.i = floor(d * {dsp.PHASES})::BIGINT LEFT JOIN i0 b ON b.i = a.i + 1 WHERE d <= {dsp.ZERO_CROSSINGS}),
s AS (SELECT asset_id, block_no * 64 + i - 1 AS f, x[i] AS x FROM (SELECT *, unnest(range(1, 65)) AS i FROM pcm)),
m AS (SELECT asset_id, unnest(range(floor(count(*) * 1.5 + 0.5)::BIGINT)) AS m FROM s GROUP BY asset_id)
SELECT m.asset_id, m.m // 64 AS block_no, 0::BIGINT AS ch, m.m % 64 AS i, round(coalesce(sum(s.x * w.w), 0), 9) AS x FROM m JOIN w ON w.c = m.m * 2 % 3 LEFT JOIN s ON s.asset_id = m.asset_id AND s.f = m.m * 2 // 3 + w.o GROUP BY ALL"""


@query(
    "bench_track_rate",
    "SELECT asset_id, count(*) AS packets, sum(size_bytes)::BIGINT AS bytes FROM packets GROUP BY asset_id",
    ("packets",),
)
def bench_track_rate(spark, d):
    return p.packets(spark, d).groupBy("asset_id").agg(F.count("*").alias("packets"), F.sum("size_bytes").alias("bytes"))


@query("rate_control_plans", "SELECT * FROM (VALUES ('h264', 'crf'), ('vp9', 'two-pass-bitrate'), ('vp8', 'crf'), ('av1', 'default')) v(codec, mode)")
def rate_control_plans(spark, d):
    asked = [("h264", None, 23.0, False), ("vp9", 1e6, None, True), ("vp8", None, 40.0, False), ("av1", None, None, False)]
    return spark.createDataFrame([(c, targets.rate_control(c, b, q, t)["mode"]) for c, b, q, t in asked], "codec string, mode string")


@query(
    "capabilities",
    """SELECT ordinal, container, container <> 'avi' AS reads, true AS writes FROM (VALUES (0, 'mp4'), (1, 'wav'), (2, 'mp3'), (3, 'ogg'), (4, 'webm'), (5, 'adts'), (6, 'aiff'), (7, 'caf'), (8, 'ts'), (9, 'flac'), (10, 'avi')) v(ordinal, container)""",
)
def capabilities(spark, d):
    return router.capabilities(spark)

