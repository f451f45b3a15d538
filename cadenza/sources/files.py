"""Files as DataFrames: assets, tracks, packets, PCM blocks, and the way back to files.

Parsers return (offset, size) rows; payloads are cut out of `content` by a late `substring`, so plans that
don't need payloads never copy them and filters run before it. Only formats whose payloads are not
contiguous in the file carry them inline. A file that can't be read becomes a row with status and error
code instead of failing the job.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..errors import CapabilityError, InputError, EngineError
from ..model import PACKETS, PCM_BLOCKS, TRACKS
from ..plans.router import check_muxable, route_container, sniff
from ..session import prepare
from .containers import avi, elementary, flac, images, matroska, mp4, mpegts, ogg, pcm_files
from .containers.base import Movie, Packet, Track

HEAD = 64 << 10
ASSETS = "asset_id bigint, uri string, kind string, mime string, filename string, size_bytes bigint, head binary, content binary"
_STATUS = "status string, error_code string, error string"

PARSERS = {
    "mp4": mp4.movie, "mov": mp4.movie, "webm": matroska.movie, "mkv": matroska.movie, "ogg": ogg.movie, "flac": flac.movie, "mp3": elementary.mp3, "adts": elementary.adts, "ts": mpegts.movie,
    "wav": lambda d: pcm_files.movie(pcm_files.parse_wav, d), "aiff": lambda d: pcm_files.movie(pcm_files.parse_aiff, d), "caf": lambda d: pcm_files.movie(pcm_files.parse_caf, d),
}
INLINE = ("ts", "ogg")


def parse(data: bytes, container: str | None) -> Movie:
    """Any known file; every failure is a typed error."""
    if not data:
        raise InputError.bad("the file is empty")
    if container not in PARSERS:
        raise CapabilityError.miss(f"no container driver for {container or 'unknown bytes'}", {"op": "demux"}, list(PARSERS))
    try:
        return PARSERS[container](data)
    except EngineError:
        raise
    except (IndexError, ValueError, KeyError, OverflowError, RecursionError, StopIteration, MemoryError) as e:
        raise EngineError("demux-error", f"{container}: {e or type(e).__name__}") from e
    except Exception as e:  # struct.error and the like: garbled fields
        raise EngineError("demux-error", f"{container}: {e}") from e


def from_files(spark: SparkSession, path: str) -> DataFrame:
    """Files of a folder as assets; ids are hashes of the URI."""
    files = spark.read.format("binaryFile").load(path)
    name = F.element_at(F.split("path", "/"), -1)
    extension = F.lower(F.regexp_extract("filename", r"\.([A-Za-z0-9]+)$", 1))
    return routed(files.select(F.xxhash64("path").alias("asset_id"), F.col("path").alias("uri"), F.lit(None).cast("string").alias("mime"), name.alias("filename"), F.col("length").alias("size_bytes"), "content"), extension)


def from_bytes(spark: SparkSession, items: Iterable[tuple[int, bytes]] | Iterable[tuple[int, bytes, str]]) -> DataFrame:
    """(id, bytes[, filename]) as assets."""
    rows = [(i, None, None, (more[0] if more else None), len(b), bytearray(b)) for i, b, *more in items]
    df = spark.createDataFrame(rows, "asset_id bigint, uri string, mime string, filename string, size_bytes bigint, content binary")
    return routed(df, F.lower(F.regexp_extract(F.coalesce("filename", F.lit("")), r"\.([A-Za-z0-9]+)$", 1)))


def routed(df: DataFrame, extension) -> DataFrame:
    head = F.substring("content", 1, HEAD)
    kind = F.coalesce(sniff(head), route_container(head, F.col("mime"), extension))
    kind = F.when((kind == "webm") & extension.isin("mkv", "mka"), F.lit("mkv")).when((kind == "mp4") & (extension == "mov"), F.lit("mov")).otherwise(kind)
    return df.withColumns({"head": head, "kind": kind}).select("asset_id", "uri", "kind", "mime", "filename", "size_bytes", "head", "content")


def byte_range(assets: DataFrame, start: int, end: int) -> DataFrame:
    """Bytes [start, end) of each asset, clamped to what there is."""
    low = max(0, start)
    return assets.select("asset_id", F.substring("content", low + 1, max(0, end - low)).alias("bytes"))


def _each_file(assets: DataFrame, make, schema: str) -> DataFrame:
    """make(asset id, container, bytes) -> rows, for each file on its own."""
    names = [f.strip().split(" ")[0] for f in _fields(schema)]

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            for asset, kind, content in zip(part.asset_id, part.kind, part.content, strict=True):
                rows = make(int(asset), kind, b"" if content is None else bytes(content))
                yield pd.DataFrame(rows, columns=names).astype(object)

    prepare(assets.sparkSession)
    return assets.select("asset_id", "kind", "content").mapInPandas(run, schema)


def _fields(schema: str) -> list[str]:
    out, depth = [""], 0
    for c in schema:
        depth += (c in "<(") - (c in ">)")
        if c == "," and depth == 0:
            out.append("")
        else:
            out[-1] += c
    return out


def _status(e: EngineError | None) -> tuple:
    return ("ok", None, None) if e is None else ("failed", e.code, str(e))


def _track_row(asset: int, t: Track) -> tuple:
    return (asset, t.track_id, t.track_kind, t.codec, t.timescale, t.duration_sec, t.fps, t.rotation, t.encrypted, False, t.width, t.height, t.sample_rate, t.channels, None)


def read_tracks(assets: DataFrame) -> DataFrame:
    """A row per track, or one row with the error of a file that has none."""

    def make(asset: int, kind: str | None, data: bytes) -> list[tuple]:
        try:
            return [(*_track_row(asset, t), *_status(None)) for t in parse(data, kind).tracks]
        except EngineError as e:
            return [(asset, *[None] * 14, *_status(e))]

    return _each_file(assets, make, f"{TRACKS}, {_STATUS}")


def probe(assets: DataFrame) -> DataFrame:
    """One row per asset: container, duration (the longest track's), size, tracks, tags, or its error."""

    def make(asset: int, kind: str | None, data: bytes) -> list[tuple]:
        try:
            if images.sniff(data):
                i = images.probe(data)
                return [(asset, i.format, i.duration_sec, len(data), [], {}, (i.format, i.width, i.height, i.frame_count, i.animated, i.bit_depth, i.color_type, i.loop_count), *_status(None))]
            m = parse(data, kind)
            tracks = [(t.track_id, t.track_kind, t.codec, t.duration_sec, t.fps, t.rotation, t.width, t.height, t.sample_rate, t.channels, t.encrypted) for t in m.tracks]
            longest = max([m.duration_sec or 0.0, *(t.duration_sec or 0.0 for t in m.tracks)])
            return [(asset, m.container, longest, len(data), tracks, m.tags, None, *_status(None))]
        except EngineError as e:
            return [(asset, kind, None, len(data), [], {}, None, *_status(e))]

    track = "struct<track_id:int,track_kind:string,codec:string,duration_sec:double,fps:double,rotation:int,width:int,height:int,sample_rate:int,channels:int,encrypted:boolean>"
    image = "struct<format:string,width:int,height:int,frame_count:int,animated:boolean,bit_depth:int,color_type:string,loop_count:double>"
    return _each_file(assets, make, f"asset_id bigint, container string, duration_sec double, size_bytes bigint, tracks array<{track}>, tags map<string,string>, image {image}, {_STATUS}")


def read_packets(assets: DataFrame) -> DataFrame:
    """Payload-free packet rows in decode order; `inline` has the payload only of formats that scatter it.

    Files that can't be read have no rows here; `read_tracks` and `probe` say why."""

    def make(asset: int, kind: str | None, data: bytes) -> list[tuple]:
        try:
            m = parse(data, kind)
        except EngineError:
            return []
        return [(asset, t.track_id, i, p.offset, p.size, p.pts_us, p.dts_us, p.duration_us, p.keyframe, p.data) for t in m.tracks for i, p in enumerate(t.packets)]

    return _each_file(assets, make, f"{PACKETS}, inline binary")


def with_payload(packets: DataFrame, assets: DataFrame) -> DataFrame:
    """Adds `data`: cut out of the file for the packets that are left."""
    content = assets.select("asset_id", "content")
    cut = F.expr("substring(content, cast(offset + 1 as int), cast(size_bytes as int))")
    return packets.join(content, "asset_id").withColumn("data", F.coalesce("inline", cut)).drop("content", "inline")


def decode_pcm(assets: DataFrame, block_frames: int = 4096, with_format: bool = False) -> DataFrame:
    """WAV, AIFF, CAF and FLAC as PCM blocks, with `fmt`, the file's sample format, if asked for."""

    def make(asset: int, kind: str | None, data: bytes) -> list[tuple]:
        try:
            if kind == "flac":
                info, x = flac.decode(data)
                x, rate, fmt = x / float(1 << (info.bits - 1)), info.rate, f"s{-(-info.bits // 8) * 8}"
            else:
                f = {"wav": pcm_files.parse_wav, "aiff": pcm_files.parse_aiff, "caf": pcm_files.parse_caf}[kind](data)
                x, rate, fmt = f.decode(data), f.rate, f.fmt
        except (EngineError, KeyError):
            return []
        return [(asset, 1, k, a, rate, len(x), [c[a : a + block_frames].tolist() for c in x], *([fmt] if with_format else [])) for k, a in enumerate(range(0, x.shape[1], block_frames))]

    return _each_file(assets, make, PCM_BLOCKS + (", fmt string" if with_format else ""))


def pcm_file(x: np.ndarray, rate: int, container: str, fmt: str) -> bytes:
    """Channels x frames as a file; what the container can't hold is a typed miss."""
    if container == "flac":
        bits = pcm_files.flac_bits(fmt)
        top = 1 << (bits - 1)
        return flac.encode(np.clip(np.floor(x * top + 0.5), -top, top - 1).astype(np.int64), rate, bits)
    if container not in pcm_files.WRITE:
        raise CapabilityError.miss(f"{container} can't hold PCM", {"op": "mux", "container": container}, list(pcm_files.WRITE))
    return pcm_files.WRITE[container](x, rate, fmt)


def write_pcm(blocks: DataFrame, container: str, fmt: str | None = None) -> DataFrame:
    """One file per asset from its PCM blocks: (asset_id, container, content, status...).

    The sample format is `fmt`, else that of the file the blocks come from (`fmt` in the blocks, by the
    container's rule), else 16 bits."""
    prepare(blocks.sparkSession)
    by_source = fmt is None and "fmt" in blocks.columns

    def run(part: pd.DataFrame) -> pd.DataFrame:
        part = part.sort_values("block_no")
        x = np.concatenate([np.stack([np.asarray(c, np.float64) for c in p]) for p in part.planar], axis=1)
        content, error = None, None
        try:
            kind = pcm_files.output_format(container, part.fmt.iloc[0]) if by_source else fmt or "s16"
            content = pcm_file(x, int(part.sample_rate.iloc[0]), container, kind)
        except EngineError as e:
            error = e
        return pd.DataFrame([(part.asset_id.iloc[0], container, content, *_status(error))], columns=["asset_id", "container", "content", "status", "error_code", "error"])

    return blocks.groupBy("asset_id").applyInPandas(run, f"asset_id bigint, container string, content binary, {_STATUS}")


def build(tracks: list[Track], payloads: list[list[bytes]], container: str, tags: dict[str, str] | None = None, fragmented: bool = False) -> bytes:
    """A file of these tracks; what a container can't hold is a typed miss."""
    check_muxable(container)
    if not tracks:
        raise EngineError("mux-error", "nothing to mux")
    if container in ("mp4", "mov"):
        return b"".join(mp4.fragments(tracks, payloads)) if fragmented else mp4.write(tracks, payloads, container, tags)
    if container in ("webm", "mkv"):
        return b"".join(matroska.fragments(tracks, payloads, container)) if fragmented else matroska.write(tracks, payloads, container, tags)
    if container == "ts":
        return mpegts.write(tracks, payloads)
    if container == "avi":
        return avi.write(tracks, payloads)
    if len(tracks) != 1:
        raise CapabilityError.miss(f"{container} holds one track", {"op": "mux", "container": container})
    t = tracks[0]
    if container == "ogg":
        return ogg.write(t, payloads[0], tags)
    if container == "adts":
        return elementary.write_adts(t, payloads[0])
    if container == "mp3":
        return elementary.write_mp3(t, payloads[0])
    if container == "flac" and t.codec == "flac" and t.config:
        return b"fLaC" + t.config + b"".join(payloads[0])
    if container == "wav" and t.codec.startswith("pcm-") and t.codec.endswith("le"):
        fmt = t.codec[4:-2]
        body = b"".join(payloads[0])
        return pcm_files.wav_header(fmt, t.sample_rate, t.channels, len(body)) + body + b"\0" * (len(body) & 1)
    raise CapabilityError.miss(f"{container} can't hold {t.codec}", {"op": "mux", "container": container}, [container])


def mux(packets: DataFrame, tracks: DataFrame, container: str, tags: dict[str, str] | None = None, fragmented: bool = False) -> DataFrame:
    """One file per asset from packets with `data` and track rows; times in `pts_us`, `dts_us`, `duration_us`."""
    prepare(packets.sparkSession)
    check_muxable(container)
    cols = ["track_id", "track_kind", "codec", "timescale", "duration_sec", "fps", "rotation", "width", "height", "sample_rate", "channels", "config"]
    # Fresh aliases: both sides may come from one DataFrame.
    have = [F.col(c).alias(c) if c in tracks.columns else F.lit(None).cast("binary").alias(c) for c in cols]

    def run(key: tuple, rows: pd.DataFrame, heads: pd.DataFrame) -> pd.DataFrame:
        value = lambda x: None if x is None or (isinstance(x, float) and np.isnan(x)) else x
        whole = lambda x: None if value(x) is None else int(x)
        content, error, made, payloads = None, None, [], []
        for h in heads.sort_values("track_id").itertuples():
            part = rows[rows.track_id == h.track_id].sort_values("seq")
            if not len(part):
                continue
            t = Track(int(h.track_id), h.track_kind, h.codec, whole(h.timescale) or 1_000_000, value(h.duration_sec), value(h.fps), whole(h.rotation) or 0, False, whole(h.width), whole(h.height), whole(h.sample_rate), whole(h.channels), bytes(value(h.config) or b""))
            t.packets = [Packet(None, len(d), int(p), whole(q), whole(n), bool(k)) for p, q, n, k, d in zip(part.pts_us, part.dts_us, part.duration_us, part.keyframe, part["data"], strict=True)]
            made.append(t)
            payloads.append([bytes(d) for d in part["data"]])
        try:
            content = build(made, payloads, container, tags, fragmented)
        except EngineError as e:
            error = e
        return pd.DataFrame([(key[0], container, content, *_status(error))], columns=["asset_id", "container", "content", "status", "error_code", "error"])

    left = packets.select("asset_id", "track_id", "seq", "pts_us", "dts_us", "duration_us", "keyframe", "data").groupBy("asset_id")
    return left.cogroup(tracks.select(F.col("asset_id").alias("asset_id"), *have).groupBy("asset_id")).applyInPandas(run, f"asset_id bigint, container string, content binary, {_STATUS}")


def remux_file(data: bytes, source: str, container: str, tags: dict[str, str] | None = None, select: list[int] | None = None, fragmented: bool = False) -> bytes:
    """One file into another container, payloads untouched."""
    m = parse(data, source)
    tracks = [t for t in m.tracks if select is None or t.track_id in select]
    return build(tracks, [[t.payload(p, data) for p in t.packets] for t in tracks], container, tags if tags is not None else m.tags, fragmented)


def remux(assets: DataFrame, container: str, tags: dict[str, str] | None = None, fragmented: bool = False) -> DataFrame:
    """Each asset into another container: (asset_id, container, content, status...)."""
    check_muxable(container)

    def make(asset: int, kind: str | None, data: bytes) -> list[tuple]:
        try:
            return [(asset, container, remux_file(data, kind, container, tags, None, fragmented), *_status(None))]
        except EngineError as e:
            return [(asset, container, None, *_status(e))]

    return _each_file(assets, make, f"asset_id bigint, container string, content binary, {_STATUS}")


def decrypt(assets: DataFrame, scheme: str, keys, container: str, iv: bytes | None = None) -> DataFrame:
    """Each protected file as a clear one: (asset_id, container, content, status...)."""

    def clear(data: bytes) -> bytes:
        if scheme == "hls-sample-aes":
            return mpegts.decrypted_sample_aes(data, keys, iv)
        found = mp4.decrypted(data, keys)
        m = parse(data, "mp4")
        for t in m.tracks:
            t.encrypted = False
        return build(m.tracks, [found[t.track_id] for t in m.tracks], container, m.tags)

    def make(asset: int, kind: str | None, data: bytes) -> list[tuple]:
        try:
            return [(asset, container, clear(data), *_status(None))]
        except EngineError as e:
            return [(asset, container, None, *_status(e))]
        except (IndexError, ValueError, KeyError) as e:  # garbled fields
            return [(asset, container, None, *_status(EngineError("demux-error", f"{kind}: {e}")))]

    return _each_file(assets, make, f"asset_id bigint, container string, content binary, {_STATUS}")
