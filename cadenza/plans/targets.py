"""Encoding targets as columns: rate control, bit depth, H.264 level, ladder, trim bitrate, output size."""

from __future__ import annotations

import math
import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..errors import CapabilityError, InputError

#: H.264 Annex A: level_idc, macroblocks a frame, macroblocks a second.
H264_LEVELS = (
    (0x0A, 99, 1485), (0x0B, 396, 3000), (0x0C, 396, 6000), (0x0D, 396, 11880), (0x14, 396, 11880), (0x15, 792, 19800), (0x16, 1620, 20250), (0x1E, 1620, 40500),
    (0x1F, 3600, 108000), (0x20, 5120, 216000), (0x28, 8192, 245760), (0x29, 8192, 245760), (0x2A, 8704, 522240), (0x32, 22080, 589824), (0x33, 36864, 983040),
    (0x34, 36864, 2073600), (0x3C, 139264, 4177920), (0x3D, 139264, 8355840), (0x3E, 139264, 16711680),
)
TOP_LEVEL, PLAYBACK_LEVEL, DEFAULT_FPS = 0x3E, 0x1E, 30.0
#: trim's bits a pixel, and its least, greatest and default bitrate.
TRIM_BPP, TRIM_MIN, TRIM_MAX, TRIM_DEFAULT = 0.45, 4_000_000, 50_000_000, 20_000_000


def h264_level(width: Column, height: Column, fps: Column | None = None) -> Column:
    """The least level that fits the frame and the rate; the top one beyond all."""
    rate = F.lit(DEFAULT_FPS) if fps is None else F.when(fps > 0, fps).otherwise(F.lit(DEFAULT_FPS))
    blocks = F.ceil(width / 16) * F.ceil(height / 16)
    out = F.lit(TOP_LEVEL)
    for idc, most, per_second in reversed(H264_LEVELS):
        out = F.when((blocks <= most) & (blocks * rate <= per_second), F.lit(idc)).otherwise(out)
    return out


def h264_codec_string(width: Column, height: Column, fps: Column | None = None) -> Column:
    return F.concat(F.lit("avc1.42E0"), F.lpad(F.hex(F.greatest(h264_level(width, height, fps), F.lit(PLAYBACK_LEVEL)).cast("bigint")), 2, "0"))


def ladder(spark: SparkSession, rungs: list[tuple], source: tuple[int, int] = (16, 9)) -> DataFrame:
    """Rungs (height, bitrate[, name]) as rows; a nameless one is called by height and place."""
    if not rungs:
        raise InputError.bad("a ladder needs a rung")
    rows = []
    for i, (height, bitrate, *name) in enumerate(rungs):
        if int(height) != height or height < 1 or not bitrate > 0:
            raise InputError.bad("ladder rungs need a whole positive height and a positive bitrate")
        rows.append((i, name[0] if name else f"{height}p-{i}", height * source[0] // source[1], height, bitrate))
    return spark.createDataFrame(rows, "rung bigint, name string, width bigint, height bigint, bitrate bigint")


def trim_bitrate(width: Column, height: Column, fps: Column) -> Column:
    rate = F.when(fps > 0, fps).otherwise(F.lit(DEFAULT_FPS))
    asked = F.floor(width * height * rate * TRIM_BPP + 0.5)
    return F.when((width > 0) & (height > 0), F.least(F.lit(TRIM_MAX), F.greatest(F.lit(TRIM_MIN), asked))).otherwise(F.lit(TRIM_DEFAULT)).cast("bigint")


def output_size(width: Column, height: Column, crop: tuple[int, int] | None = None, resize: tuple[int, int] | None = None, degrees: int = 0) -> tuple[Column, Column]:
    """Size after crop, resize and a turn, in that order."""
    for size in (crop, resize):
        if size is not None:
            width, height = F.lit(size[0]).cast("bigint"), F.lit(size[1]).cast("bigint")
    return (height, width) if degrees % 180 else (width, height)


def rate_control(codec: str | None = None, bitrate: float | None = None, crf: float | None = None, two_pass: bool = False, mode: str = "variable") -> dict:
    """Which rate control a request means; raises where it contradicts itself."""
    most = 51 if codec in ("h264", "hevc") else 63
    if bitrate is not None and not (math.isfinite(bitrate) and bitrate > 0):
        raise InputError.bad("bitrate must be positive")
    if crf is not None and not (math.isfinite(crf) and 0 <= crf <= most):
        raise InputError.bad(f"CRF must be in [0, {most}]")
    if bitrate is not None and crf is not None:
        raise InputError.bad("bitrate and CRF exclude each other")
    if two_pass and bitrate is None:
        raise InputError.bad("two passes need a bitrate")
    if two_pass:
        return {"mode": "two-pass-bitrate", "bitrate": bitrate, "passes": 2}
    if crf is not None:
        return {"mode": "crf", "crf": crf, "quantizer": crf if codec in ("h264", "hevc", "vp9", "av1") else None}
    return {"mode": "default"} if bitrate is None else {"mode": "bitrate", "bitrate": bitrate, "bitrate_mode": mode}


def bit_depth(codec: str | None) -> int | None:
    """Bits a sample as the codec string tells them."""
    codec = (codec or "").lower()
    if m := re.match(r"avc[13]\.([0-9a-f]{2})", codec):
        return 10 if int(m[1], 16) == 110 else 8
    if m := re.match(r"(?:hev1|hvc1)\.[abc]?(\d+)\.", codec):
        return {1: 8, 2: 10}.get(int(m[1]))
    fields = codec.split(".")
    if fields[0] in ("vp09", "av01") and len(fields) > 3 and fields[3].isdigit():
        if int(fields[3]) not in (8, 10, 12):
            raise InputError.bad(f"unsupported bit depth {fields[3]}")
        return int(fields[3])
    return 8 if codec == "vp8" else None


def bit_depth_plan(source: str | int | None, target: str | int | None) -> dict:
    a, b = (x if isinstance(x, int) else bit_depth(x) for x in (source, target))
    if a is None or b is None or a == b:
        return {"kind": "none", "source": a, "target": b}
    if (a, b) == (10, 8):
        return {"kind": "downconvert", "source": a, "target": b}
    raise CapabilityError.miss(f"no conversion from {a} to {b} bits", "convert")
