"""PCM bytes to samples and back: u8, s8, s16, s24, s32, f32 and f64 in either byte order."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from ..errors import InputError

#: Bytes of a sample by format.
WIDTH = {"u8": 1, "s8": 1, "s16": 2, "s24": 3, "s32": 4, "f32": 4, "f64": 8}


def bytes_per_sample(column: Column) -> Column:
    out = F.lit(None).cast("int")
    for name, n in WIDTH.items():
        out = F.when(column == name, F.lit(n)).otherwise(out)
    return out


def decode(data: bytes, fmt: str, channels: int, big: bool = False) -> np.ndarray:
    """Interleaved bytes as channels x frames of doubles in [-1, 1); a partial last frame is dropped."""
    if fmt not in WIDTH:
        raise InputError.bad(f"unknown sample format {fmt!r}")
    if channels <= 0:
        raise InputError.bad("channels must be positive")
    width = WIDTH[fmt]
    frames = len(data) // (width * channels)
    raw = np.frombuffer(data, np.uint8, frames * width * channels)
    order = ">" if big else "<"
    if fmt == "u8":
        x = (raw.astype(np.float64) - 128) / 128
    elif fmt == "s24":
        b = raw.reshape(-1, 3).astype(np.int32)
        hi, mid, lo = (b[:, 0], b[:, 1], b[:, 2]) if big else (b[:, 2], b[:, 1], b[:, 0])
        v = hi << 16 | mid << 8 | lo
        x = (v - ((v & 0x800000) << 1)) / float(1 << 23)
    elif fmt[0] == "f":
        x = raw.view(f"{order}f{width}").astype(np.float64)
    else:
        x = raw.view(f"{order}i{width}") / float(1 << (8 * width - 1))
    return np.ascontiguousarray(x.reshape(frames, channels).T)


def encode(planar: np.ndarray, fmt: str, big: bool = False) -> bytes:
    """Interleaved bytes; integers are rounded half up and clamped to their range."""
    if fmt not in WIDTH:
        raise InputError.bad(f"unknown sample format {fmt!r}")
    x = np.ascontiguousarray(planar.T)
    order, width = ">" if big else "<", WIDTH[fmt]
    if fmt[0] == "f":
        return x.astype(f"{order}f{width}").tobytes()
    top = float(1 << (8 * width - 1))
    v = np.clip(np.floor(np.nan_to_num(x) * top + 0.5), -top, top - 1)
    if fmt == "u8":
        return (v + 128).astype(np.uint8).tobytes()
    if fmt == "s24":
        four = v.astype(f"{order}i4").reshape(-1).view(np.uint8).reshape(-1, 4)
        return (four[:, 1:] if big else four[:, :3]).tobytes()
    return v.astype(f"{order}i{width}").tobytes()


def decode_udf(fmt: str, channels: int, big: bool = False):
    """bytes -> planar samples, a batch at a time."""

    @F.pandas_udf("array<array<double>>")
    def run(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for part in parts:
            yield part.map(lambda b: None if b is None else [c.tolist() for c in decode(bytes(b), fmt, channels, big)])

    return run


def encode_udf(fmt: str, big: bool = False):
    """Planar samples -> bytes, a batch at a time."""

    @F.pandas_udf("binary")
    def run(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for part in parts:
            yield part.map(lambda p: None if p is None else encode(np.stack([np.asarray(c, np.float64) for c in p]), fmt, big))

    return run
