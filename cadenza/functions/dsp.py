"""Audio functions over PCM blocks.

Sample-wise functions are array expressions on `planar` (array of channels, each an array of doubles) and stay
in the JVM. A block knows its place by `start_frame`, so fades need no neighbour. Filters with memory
(resample, biquad) run on a whole track in a grouped function, which is where their state ends.
Samples are unbounded floats until they are encoded.
"""

from __future__ import annotations

import math
from collections.abc import Callable
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..errors import CapabilityError, InputError
from ..model import PCM_BLOCKS, TRACK
from ..operators.aggregates import level
from ..session import prepare

ZERO_CROSSINGS, PHASES, KAISER_BETA = 32, 512, 9.42
SHAPES = ("linear", "equal-power")


def db_to_linear(db: float) -> float:
    return 10 ** (db / 20)


def _each(f: Callable[[Column], Column]) -> Column:
    return F.transform("planar", lambda channel: F.transform(channel, f))


def gain(blocks: DataFrame, db: float) -> DataFrame:
    if not math.isfinite(db):
        raise InputError.bad("gain must be finite")
    factor = db_to_linear(db)
    return blocks if db == 0 else blocks.withColumn("planar", _each(lambda x: x * factor))


def _ramp(blocks: DataFrame, place: Column, n: Column, shape: str, rising: bool) -> DataFrame:
    """Scales the samples for which `place` (of the block's first sample) + index lies in 0 to n - 1."""
    if shape not in SHAPES:
        raise InputError.bad(f"unknown fade shape {shape!r}")

    def factor(k: Column) -> Column:
        t = k / F.greatest(n - 1, F.lit(1))
        if shape == "linear":
            return t if rising else 1 - t
        return F.sin(t * math.pi / 2) if rising else F.cos(t * math.pi / 2)

    inside = lambda k: (k >= 0) & (k < n)
    return blocks.withColumn("planar", F.transform("planar", lambda c: F.transform(c, lambda x, i: F.when(inside(place + i), x * factor(place + i)).otherwise(x))))


def _frames() -> Column:
    return F.max(F.col("start_frame") + F.size(F.get("planar", F.lit(0)))).over(Window.partitionBy(*TRACK))


def fade_in(blocks: DataFrame, frames: int, shape: str = "linear") -> DataFrame:
    if frames <= 0:
        return blocks
    rows = blocks.withColumn("_n", F.least(F.lit(frames), _frames()))
    return _ramp(rows, F.col("start_frame"), F.col("_n"), shape, True).drop("_n")


def fade_out(blocks: DataFrame, frames: int, shape: str = "linear") -> DataFrame:
    if frames <= 0:
        return blocks
    rows = blocks.withColumn("_all", _frames()).withColumn("_n", F.least(F.lit(frames), F.col("_all")))
    return _ramp(rows, F.col("start_frame") - (F.col("_all") - F.col("_n")), F.col("_n"), shape, False).drop("_n", "_all")


#: Channel layouts that can be turned into one another (1, 2, and 6: L R C LFE Ls Rs), besides equal ones.
REMIXES = ((1, 2), (2, 1), (2, 6), (6, 2), (6, 1))


def remix(blocks: DataFrame, source: int | None, target: int) -> DataFrame:
    """Channel layouts 1, 2 and 6; the surround downmix leaves the LFE out.

    Without `source` each block has its own, in `channels`; one that can't be turned raises when it is read."""
    if target <= 0:
        raise CapabilityError.miss(f"invalid target channel count {target}", "filter")
    if source == target:
        return blocks
    ch = lambda i: F.get("planar", F.lit(i))
    plus = lambda a, b, k=1.0: F.zip_with(a, b, lambda x, y: x + y * k)
    half = lambda a: F.transform(a, lambda x: x * 0.5)
    side = lambda front, back: plus(plus(ch(front), ch(2), math.sqrt(0.5)), ch(back), math.sqrt(0.5))
    silent = F.transform(ch(0), lambda x: F.lit(0.0))
    ways = {
        (1, 2): lambda: F.array(ch(0), ch(0)),
        (2, 1): lambda: F.array(half(plus(ch(0), ch(1)))),
        (2, 6): lambda: F.array(ch(0), ch(1), silent, silent, silent, silent),
        (6, 2): lambda: F.array(side(0, 4), side(1, 5)),
        (6, 1): lambda: F.array(half(plus(side(0, 4), side(1, 5)))),
    }
    if source is None:
        planar = F.when(F.col("channels") == target, F.col("planar"))
        for a, b in REMIXES:
            if b == target:
                planar = planar.when(F.col("channels") == a, ways[a, b]())
        wrong = F.raise_error(F.concat(F.lit("unsupported channel remix "), F.col("channels").cast("string"), F.lit(f" to {target}"))).cast("array<array<double>>")
        return blocks.withColumns({"planar": planar.otherwise(wrong), "channels": F.lit(target)})
    if (source, target) not in REMIXES:
        raise CapabilityError.miss(f"unsupported channel remix {source} to {target}", "filter")
    return blocks.withColumns({"planar": ways[source, target](), "channels": F.lit(target)})


def _scale_by_asset(blocks: DataFrame, statistic: str, target_db: float) -> DataFrame:
    if not math.isfinite(target_db):
        raise InputError.bad("normalize target must be finite")
    stats = level(blocks).select("asset_id", F.col(statistic).alias("_s"))
    rows = blocks.join(stats, "asset_id")
    factor = F.when(F.col("_s") > 0, F.lit(db_to_linear(target_db)) / F.col("_s")).otherwise(F.lit(1.0))
    return rows.withColumn("_f", factor).withColumn("planar", F.transform("planar", lambda c: F.transform(c, lambda x: x * F.col("_f")))).drop("_s", "_f")


def normalize_peak(blocks: DataFrame, target_db: float = 0.0) -> DataFrame:
    """All channels of an asset by one factor, so that its peak is at the target; silence stays."""
    return _scale_by_asset(blocks, "peak", target_db)


def normalize_rms(blocks: DataFrame, target_db: float = -20.0) -> DataFrame:
    return _scale_by_asset(blocks, "rms", target_db)


def limit(blocks: DataFrame, ceiling_db: float = 0.0, mode: str = "hard", knee: float = 0.9) -> DataFrame:
    """No sample beyond the ceiling: clipped, or bent toward it above `knee` times the ceiling."""
    if math.isnan(ceiling_db):
        raise InputError.bad("limiter ceiling is not a number")
    c = db_to_linear(ceiling_db)
    if mode == "hard":
        return blocks.withColumn("planar", _each(lambda x: F.greatest(F.lit(-c), F.least(F.lit(c), x))))
    if mode != "soft" or not 0 < knee <= 1:
        raise InputError.bad("limiter needs mode hard or soft, and a knee in (0, 1]")
    k = knee * c
    if k == c:
        return limit(blocks, ceiling_db)

    def bend(x: Column) -> Column:
        over = (F.abs(x) - k) / (c - k)
        return F.when(F.abs(x) <= k, x).otherwise(F.signum(x) * (k + (c - k) * (over / (over + 1))))

    return blocks.withColumn("planar", _each(bend))


# ---- filters with memory


def whole_tracks(blocks: DataFrame, f: Callable[[np.ndarray, int], tuple[np.ndarray, int]], frames_per_block: int | None = None) -> DataFrame:
    """Applies f(channels x frames, rate) -> (channels x frames, rate) to each whole track.

    The blocks come back in their old framing, or in blocks of `frames_per_block`."""
    prepare(blocks.sparkSession)

    def run(part: pd.DataFrame) -> pd.DataFrame:
        part = part.sort_values("block_no")
        sizes = [len(p[0]) for p in part.planar]
        signal = np.concatenate([np.stack([np.asarray(c, np.float64) for c in p]) for p in part.planar], axis=1)
        out, rate = f(signal, int(part.sample_rate.iloc[0]))
        if frames_per_block or out.shape[1] != signal.shape[1]:
            step = frames_per_block or max(1, max(sizes))
            edge = [*range(0, out.shape[1], step), out.shape[1]]
        else:
            edge = np.concatenate([[0], np.cumsum(sizes)]).tolist()
        rows = [(k, a, [c.tolist() for c in out[:, a:b]]) for k, (a, b) in enumerate(zip(edge[:-1], edge[1:], strict=True))]
        made = {"asset_id": part.asset_id.iloc[0], "track_id": part.track_id.iloc[0], "block_no": [r[0] for r in rows], "start_frame": [r[1] for r in rows], "sample_rate": rate, "channels": len(out), "planar": [r[2] for r in rows]}
        return pd.DataFrame(made | ({"fmt": part.fmt.iloc[0]} if with_format else {}))

    with_format = "fmt" in blocks.columns  # the sample format of the file goes along
    rows = blocks.select("asset_id", F.col("track_id").cast("int").alias("track_id"), "block_no", "start_frame", "sample_rate", "channels", "planar", *(["fmt"] if with_format else []))
    return rows.groupBy(*TRACK).applyInPandas(run, PCM_BLOCKS + (", fmt string" if with_format else ""))


_table: np.ndarray | None = None


def kaiser_sinc() -> np.ndarray:
    """The low-pass prototype from its centre on, PHASES points to a zero crossing, and one guard point."""
    global _table
    if _table is None:
        x = np.arange(ZERO_CROSSINGS * PHASES + 1) / PHASES
        _table = np.append(np.sinc(x) * np.i0(KAISER_BETA * np.sqrt(np.maximum(0, 1 - (x / ZERO_CROSSINGS) ** 2))) / np.i0(KAISER_BETA), 0.0)
    return _table


def resample_signal(x: np.ndarray, rate: int, out_rate: int, chunk: int = 4096) -> np.ndarray:
    """Band-limited conversion of channels x frames; round(frames * ratio) frames, zeros beyond the edges.

    Output m lies at m * rate / out_rate, a whole part and a phase, both exact; each chunk of outputs is one
    gather and one weighted sum."""
    if out_rate <= 0 or int(out_rate) != out_rate:
        raise CapabilityError.miss(f"invalid target sample rate {out_rate}", "filter")
    if rate == out_rate:
        return x.copy()
    g = math.gcd(rate, out_rate)
    phases, step = out_rate // g, rate // g
    cutoff = min(1.0, out_rate / rate)
    half = ZERO_CROSSINGS / cutoff
    reach = math.ceil(half)
    table = kaiser_sinc()
    n_out = math.floor(x.shape[1] * (out_rate / rate) + 0.5)
    padded = np.pad(x, ((0, 0), (reach + 1, reach + 2)))
    offsets = np.arange(-reach, reach + 2)
    out = np.empty((len(x), n_out))
    for a in range(0, n_out, chunk):
        m = np.arange(a, min(n_out, a + chunk), dtype=np.int64)
        base, frac = m * step // phases, (m * step % phases) / phases
        distance = np.abs(frac[:, None] - offsets)
        place = distance * cutoff * PHASES
        i = np.minimum(place.astype(np.int64), len(table) - 2)
        weight = np.where(distance <= half, table[i] + (table[i + 1] - table[i]) * (place - i), 0.0) * cutoff
        at = np.minimum(base[:, None] + offsets + reach + 1, padded.shape[1] - 1)
        out[:, a : a + len(m)] = (padded[:, at] * weight).sum(2)
    return out


def resample(blocks: DataFrame, out_rate: int) -> DataFrame:
    """Whole-signal resampling of each track."""
    if out_rate <= 0:
        raise CapabilityError.miss(f"invalid target sample rate {out_rate}", "filter")
    return whole_tracks(blocks, lambda x, rate: (resample_signal(x, rate, out_rate), out_rate))


@dataclass(frozen=True)
class Biquad:
    """Normalised coefficients of y = b0 x + b1 x' + b2 x'' - a1 y' - a2 y''."""

    b0: float
    b1: float
    b2: float
    a1: float
    a2: float

    def stable(self) -> bool:
        return abs(self.a2) < 1 and abs(self.a1) < 1 + self.a2

    def magnitude(self, frequency: float, rate: int) -> float:
        z = np.exp(-2j * math.pi * frequency / rate)
        return float(abs((self.b0 + self.b1 * z + self.b2 * z * z) / (1 + self.a1 * z + self.a2 * z * z)))


def design_biquad(kind: str, frequency: float, rate: int, q: float = math.sqrt(0.5), gain_db: float | None = None) -> Biquad:
    """The public audio-EQ-cookbook designs."""
    if not 0 < frequency < rate / 2:
        raise InputError.bad(f"biquad frequency must be in (0, {rate / 2})")
    if not q > 0:
        raise InputError.bad("biquad Q must be positive")
    if kind in ("peaking", "lowshelf", "highshelf") and gain_db is None:
        raise InputError.bad(f"{kind} needs a gain")
    w = 2 * math.pi * frequency / rate
    c, alpha = math.cos(w), math.sin(w) / (2 * q)
    if kind in ("lowpass", "highpass"):
        s = -1 if kind == "highpass" else 1
        b, a = [(1 - s * c) / 2, s * (1 - s * c), (1 - s * c) / 2], [1 + alpha, -2 * c, 1 - alpha]
    elif kind == "bandpass":
        b, a = [alpha, 0.0, -alpha], [1 + alpha, -2 * c, 1 - alpha]
    elif kind == "notch":
        b, a = [1.0, -2 * c, 1.0], [1 + alpha, -2 * c, 1 - alpha]
    elif kind == "peaking":
        g = 10 ** (gain_db / 40)
        b, a = [1 + alpha * g, -2 * c, 1 - alpha * g], [1 + alpha / g, -2 * c, 1 - alpha / g]
    elif kind in ("lowshelf", "highshelf"):
        g, s = 10 ** (gain_db / 40), 1 if kind == "lowshelf" else -1
        r = 2 * math.sqrt(g) * alpha
        up, down = (g + 1) + s * (g - 1) * c, (g + 1) - s * (g - 1) * c
        b = [g * (down + r), s * 2 * g * ((g - 1) - s * (g + 1) * c), g * (down - r)]
        a = [up + r, -s * 2 * ((g - 1) + s * (g + 1) * c), up - r]
    else:
        raise InputError.bad(f"unknown biquad {kind!r}")
    return Biquad(b[0] / a[0], b[1] / a[0], b[2] / a[0], a[1] / a[0], a[2] / a[0])


def biquad_signal(x: np.ndarray, f: Biquad, state: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Transposed direct form II over channels x frames; state is channels x 2, zero at the start."""
    z = np.zeros((len(x), 2)) if state is None else state.copy()
    out = np.empty_like(x)
    for k in range(len(x)):
        z1, z2 = z[k].tolist()
        y = []
        for v in x[k].tolist():
            o = f.b0 * v + z1
            z1 = f.b1 * v - f.a1 * o + z2
            z2 = f.b2 * v - f.a2 * o
            y.append(o)
        out[k], z[k] = y, (z1, z2)
    return out, z


def biquad(blocks: DataFrame, kind: str, frequency: float, q: float = math.sqrt(0.5), gain_db: float | None = None) -> DataFrame:
    """Filters each whole track, every channel from rest."""
    return whole_tracks(blocks, lambda x, rate: (biquad_signal(x, design_biquad(kind, frequency, rate, q, gain_db))[0], rate))


def biquad_array(column: Column, f: Biquad) -> Column:
    """The same filter on one array column as a fold, without Python."""
    zero = F.struct(F.array().cast("array<double>").alias("y"), F.lit(0.0).alias("z1"), F.lit(0.0).alias("z2"))

    def step(a: Column, x: Column) -> Column:
        y = x * f.b0 + a["z1"]
        return F.struct(F.concat(a["y"], F.array(y)).alias("y"), (x * f.b1 - y * f.a1 + a["z2"]).alias("z1"), (x * f.b2 - y * f.a2).alias("z2"))

    return F.aggregate(column, zero, step, lambda a: a["y"])
