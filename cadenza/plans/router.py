"""Routing as data: capability tables, ranks and the cost order of a conversion.

A pick is the least rank among the drivers that support a request; a miss names all that were tried.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..errors import CapabilityError

#: Limits under which a job is tiny (bytes, pixels, seconds, audio frames).
TINY = {"input_bytes": 64 * 1024, "output_pixels": 64 * 64, "content_seconds": 1, "audio_frames": 48_000}
SOFTWARE_TIERS, SOFTWARE_SUBSTRATES = ("native", "wasm"), ("canvas2d", "native", "wasm")
#: Containers that packets can be muxed into, and the raw PCM ones.
MUXABLE = ("mp4", "mov", "webm", "mkv", "ogg", "ts", "flac", "mp3", "adts", "wav", "avi")
RAW_PCM = ("wav", "aiff", "caf")
#: Magic bytes (hex, at an offset), mime types and extensions, in routing order.
CONTAINERS = (
    ("mp4", ((4, "66747970"),), ("video/mp4", "audio/mp4", "video/quicktime"), ("mp4", "m4a", "m4v", "mov")),
    ("wav", ((0, "52494646"), (8, "57415645")), ("audio/wav", "audio/x-wav"), ("wav",)),
    ("mp3", ((0, "494433"),), ("audio/mpeg",), ("mp3",)),
    *(("mp3", ((0, sync),), (), ()) for sync in ("FFFB", "FFFA", "FFF3", "FFF2")),
    ("ogg", ((0, "4F676753"),), ("audio/ogg", "video/ogg"), ("ogg", "oga", "opus")),
    ("webm", ((0, "1A45DFA3"),), ("video/webm", "audio/webm", "video/x-matroska"), ("webm", "mkv", "mka")),
    ("adts", ((0, "FFF1"),), ("audio/aac",), ("aac", "adts")),
    *(("adts", ((0, sync),), (), ()) for sync in ("FFF0", "FFF8", "FFF9")),
    ("aiff", ((0, "464F524D"), (8, "41494646")), ("audio/aiff",), ("aif", "aiff")),
    ("caf", ((0, "63616666"),), ("audio/x-caf",), ("caf",)),
    ("ts", ((0, "47"),), ("video/mp2t",), ("ts", "m2ts")),
    ("flac", ((0, "664C6143"),), ("audio/flac",), ("flac",)),
    ("avi", ((0, "52494646"), (8, "41564920")), ("video/avi", "video/x-msvideo"), ("avi",)),
)
IMAGES = (("gif", ((0, "474946383761"),)), ("gif", ((0, "474946383961"),)), ("png", ((0, "89504E470D0A1A0A"),)), ("jpeg", ((0, "FFD8FF"),)), ("webp", ((0, "52494646"), (8, "57454250"))), ("avif", ((4, "6674797061766966"),)), ("avif", ((4, "6674797061766973"),)))


def is_tiny(**costs: Column) -> Column:
    """Whether any known cost is positive and within its limit."""
    out = F.lit(False)
    for name, cost in costs.items():
        out = out | F.coalesce((cost > 0) & (cost <= TINY[name]), F.lit(False))
    return out


def codec_rank(tier: Column, tiny: Column) -> Column:
    return F.when(tier == "hardware", 0).when(tier == "wasm", 3).when(tier == F.when(tiny, F.lit("native")).otherwise(F.lit("gpu")), 1).otherwise(2)


def filter_rank(substrate: Column, tiny: Column) -> Column:
    small = F.when(substrate == "native", 0).when(substrate == "canvas2d", 1).when(substrate == "webgpu", 2).otherwise(3)
    large = F.when(substrate == "webgpu", 0).when(substrate == "webgl", 1).when(substrate == "canvas2d", 2).otherwise(3)
    return F.when(substrate == "wasm", 4).when(tiny, small).otherwise(large)


def pick(requests: DataFrame, drivers: DataFrame, by: str, rank: Column, request_id: str, allowed: Column | None = None) -> DataFrame:
    """For each request (with `by`) the supporting driver of least rank, then of least `ordinal`.

    `drivers` is a short list of (driver, by, ordinal, ...); adds driver (null: a miss) and tried."""
    offers = requests.join(F.broadcast(drivers), by, "left")
    if allowed is not None:
        offers = offers.withColumn("driver", F.when(allowed, F.col("driver")))
    order = F.struct(rank.alias("r"), F.col("ordinal"))
    tried = F.transform(F.array_sort(F.collect_list(F.when(F.col("driver").isNotNull(), F.struct(order.alias("o"), "driver")))), lambda x: x["driver"])
    return offers.groupBy(request_id).agg(F.min_by("driver", F.when(F.col("driver").isNotNull(), order)).alias("driver"), tried.alias("tried"))


def sniff(head: Column, rules=CONTAINERS) -> Column:
    """First name whose magic bytes all match the first bytes of a file (null: none)."""
    text, out = F.hex(head), F.lit(None).cast("string")
    for name, magic, *_ in reversed(rules):
        ok = F.lit(True)
        for at, value in magic:
            ok = ok & (F.substring(text, 2 * at + 1, len(value)) == value)
        out = F.when(ok, F.lit(name)).otherwise(out)
    return out


def route_container(head: Column, mime: Column, extension: Column) -> Column:
    """The first container in routing order that matches by magic, mime type or extension."""
    text, out = F.hex(head), F.lit(None).cast("string")
    for name, magic, mimes, extensions in reversed(CONTAINERS):
        ok = F.lit(True)
        for at, value in magic:
            ok = ok & (F.substring(text, 2 * at + 1, len(value)) == value)
        named = [F.coalesce(F.lower(c).isin(*names), F.lit(False)) for c, names in ((mime, mimes), (extension, extensions)) if names]
        matched = reduce(lambda a, b: a | b, named, F.coalesce(ok, F.lit(False)))
        out = F.when(matched, F.lit(name)).otherwise(out)
    return out


def default_output(container: str) -> str:
    return container if container in MUXABLE and container not in RAW_PCM else "mp4"


def check_muxable(container: str) -> None:
    if container not in MUXABLE:
        raise CapabilityError.miss(f"no muxer for {container}", {"op": "mux", "container": container}, MUXABLE)


_VIDEO_KEYS = ("codec", "width", "height", "fps", "bitrate", "crf", "rotate", "flip", "crop", "colorspace", "tonemap")
_AUDIO_KEYS = ("codec", "sample_rate", "channels", "bitrate", "fade", "dynamics", "biquad")


def is_stream_copy(video: dict | bool | None, audio: dict | bool | None) -> bool:
    """Whether a request changes nothing that would need decoding, and drops no stream."""
    if video is False or audio is False:
        return False
    if isinstance(video, dict) and any(video.get(k) is not None for k in _VIDEO_KEYS):
        return False
    return not (isinstance(audio, dict) and (any(audio.get(k) is not None for k in _AUDIO_KEYS) or audio.get("gain_db") not in (None, 0)))


def convert_route(source: Column, target: Column, source_codec: Column, copy: Column) -> Column:
    """Which way a conversion takes, the cheapest first; `miss` where a lossy codec would be needed."""
    pcm_in = source.isin(*RAW_PCM) | (source == "flac")
    return F.when((target == "flac") & pcm_in & ~(copy & (source == "flac")), "flac-author").when(target.isin(*RAW_PCM) & pcm_in, "pcm-native").when(copy & (source == target), "stream-copy").when(copy & target.isin(*MUXABLE) & source_codec.isNotNull(), "remux").otherwise("miss")


def capabilities(spark: SparkSession) -> DataFrame:
    """The containers this engine reads and writes, as a table."""
    reads = {"mp4", "wav", "mp3", "ogg", "webm", "adts", "aiff", "caf", "ts", "flac"}
    writes = reads | {"avi"}
    rows = [(i, name, name in reads, name in writes) for i, name in enumerate(dict.fromkeys(name for name, *_ in CONTAINERS))]
    return spark.createDataFrame(rows, "ordinal int, container string, reads boolean, writes boolean")
