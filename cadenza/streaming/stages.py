"""Stateful operators of Structured Streaming: what they give over any chunking equals the whole-stream form.

A stage is a class with `push(row values...)` and, where it holds rows back, `flush()`; its instance, pickled, is the
state of one stream. Rows of a stream must arrive in order over micro-batches; inside one they are sorted.
The last row of a stream has `is_last` set, which is how held rows get out without a timeout.
"""

from __future__ import annotations

import pickle
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..functions import dsp
from ..model import TRACK
from ..session import prepare

BLOCK = "asset_id bigint, track_id bigint, block_no bigint, start_frame bigint, sample_rate int, channels int, planar array<array<double>>"


class Stage:
    """One stream's state; `push` returns the rows that are ready."""

    def push(self, row) -> list[tuple]:
        raise NotImplementedError

    def flush(self) -> list[tuple]:
        return []


def run_stage(rows: DataFrame, make: Callable[[], Stage], order: str, schema: str, by: tuple[str, ...] = TRACK) -> DataFrame:
    """Applies a stage to every stream; the result's rows are the key and then what the stage returns."""
    prepare(rows.sparkSession)
    names = [f.strip().split(" ")[0] for f in schema.split(", ")]

    def run(key: tuple, parts: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        stage = pickle.loads(state.get[0]) if state.exists else make()
        batch = pd.concat(list(parts)).sort_values(order)
        out: list[tuple] = []
        ended = False
        for row in batch.itertuples(index=False):
            out += stage.push(row)
            if row.is_last:
                out += stage.flush()
                ended = True
        if ended:
            state.remove()
        else:
            state.update((pickle.dumps(stage),))
        yield pd.DataFrame([(*key, *x) for x in out], columns=names)

    return rows.groupBy(*by).applyInPandasWithState(run, schema, "stage binary", "append", GroupStateTimeout.NoTimeout)


def _planar(p) -> np.ndarray:
    return np.stack([np.asarray(c, np.float64) for c in p])


class BiquadStage(Stage):
    def __init__(self, kind: str, frequency: float, q: float, gain_db: float | None) -> None:
        self.spec, self.z = (kind, frequency, q, gain_db), None

    def push(self, row) -> list[tuple]:
        kind, frequency, q, gain_db = self.spec
        x, self.z = dsp.biquad_signal(_planar(row.planar), dsp.design_biquad(kind, frequency, int(row.sample_rate), q, gain_db), self.z)
        return [(row.block_no, row.start_frame, row.sample_rate, row.channels, [c.tolist() for c in x])]


def biquad(blocks: DataFrame, kind: str, frequency: float, q: float = 0.7071067811865476, gain_db: float | None = None) -> DataFrame:
    return run_stage(blocks, lambda: BiquadStage(kind, frequency, q, gain_db), "block_no", BLOCK)


class FadeStage(Stage):
    """Fades in as blocks come; holds back enough blocks to fade the end out when it is known."""

    def __init__(self, frames_in: int, frames_out: int, shape: str) -> None:
        self.n_in, self.n_out, self.shape, self.held, self.frames = frames_in, frames_out, shape, [], 0

    def _ramp(self, t: np.ndarray, rising: bool) -> np.ndarray:
        if self.shape == "linear":
            return t if rising else 1 - t
        return np.sin(t * np.pi / 2) if rising else np.cos(t * np.pi / 2)

    def _out(self, block, total: int | None) -> tuple:
        no, start, rate, channels, x = block
        k = start + np.arange(x.shape[1])
        n_in = self.n_in if total is None else min(self.n_in, total)
        if n_in > 0:
            x = np.where(k < n_in, x * self._ramp(k / max(1, n_in - 1), True), x)
        if total is not None and self.n_out > 0:
            n = min(self.n_out, total)
            place = k - (total - n)
            x = np.where(place >= 0, x * self._ramp(place / max(1, n - 1), False), x)
        return (no, start, rate, channels, [c.tolist() for c in x])

    def push(self, row) -> list[tuple]:
        x = _planar(row.planar)
        self.held.append((row.block_no, self.frames, row.sample_rate, row.channels, x))
        self.frames += x.shape[1]
        out = []
        keep = max(self.n_in, self.n_out)
        while self.held and self.held[0][1] + self.held[0][4].shape[1] <= self.frames - keep:
            out.append(self._out(self.held.pop(0), None))
        return out

    def flush(self) -> list[tuple]:
        out = [self._out(b, self.frames) for b in self.held]
        self.held = []
        return out


def fade(blocks: DataFrame, frames_in: int, frames_out: int, shape: str = "linear") -> DataFrame:
    return run_stage(blocks, lambda: FadeStage(frames_in, frames_out, shape), "block_no", BLOCK)


class GaplessStage(Stage):
    def __init__(self, leading: int, total: int | None) -> None:
        self.a, self.b, self.seen, self.emitted = leading, None if total is None else leading + total, 0, 0

    def push(self, row) -> list[tuple]:
        x = _planar(row.planar)
        low, high = self.seen, self.seen + x.shape[1]
        self.seen = high
        a, b = max(low, self.a), high if self.b is None else min(high, self.b)
        if b <= a:
            return []
        out = (row.block_no, a, row.sample_rate, row.channels, [c.tolist() for c in x[:, a - low : b - low]])
        self.emitted += b - a
        return [out]


def gapless_trim(blocks: DataFrame, leading: int, total: int | None = None) -> DataFrame:
    return run_stage(blocks, lambda: GaplessStage(leading, total), "block_no", BLOCK)


class RetimeStage(Stage):
    """One frame of look-behind: a frame is given out when the next one or the end says how long it lasts."""

    def __init__(self, fps: float) -> None:
        self.fps, self.start, self.previous, self.gap, self.slot = fps, None, None, None, 0

    def _at(self, i: int) -> int:
        return int(np.floor(i * 1e6 / self.fps + 0.5))

    def _until(self, seq: int, end: int) -> list[tuple]:
        out = []
        while self.start + self._at(self.slot) < end:
            out.append((self.slot, self.start + self._at(self.slot), seq))
            self.slot += 1
        return out

    def push(self, row) -> list[tuple]:
        if self.previous is None:
            self.start, self.previous = int(row.pts_us), row
            return []
        if row.pts_us <= self.previous.pts_us:
            raise ValueError("frame timestamps must be strictly increasing")
        self.gap = int(row.pts_us - self.previous.pts_us)
        out = self._until(int(self.previous.seq), int(row.pts_us))
        self.previous = row
        return out

    def flush(self) -> list[tuple]:
        if self.previous is None:
            return []
        declared = getattr(self.previous, "declared_us", None)
        length = int(declared) if declared is not None and declared > 0 else self.gap or self._at(1)
        return self._until(int(self.previous.seq), int(self.previous.pts_us) + length)

    def __getstate__(self):
        state = self.__dict__.copy()
        if self.previous is not None:
            state["previous"] = {k: getattr(self.previous, k) for k in ("seq", "pts_us", "declared_us") if hasattr(self.previous, k)}
        return state

    def __setstate__(self, state):
        from types import SimpleNamespace

        if state["previous"] is not None:
            state["previous"] = SimpleNamespace(**state["previous"])
        self.__dict__ = state


def cfr_retime(frames: DataFrame, fps: float) -> DataFrame:
    return run_stage(frames, lambda: RetimeStage(fps), "seq", "asset_id bigint, track_id bigint, out_no bigint, ts_us bigint, source_seq bigint")


class FragmentStage(Stage):
    """Numbers fragments as packets come: video breaks at keyframes and after `most`, others after `most`."""

    def __init__(self, most: int) -> None:
        self.most, self.n, self.run = most, 0, -1

    def push(self, row) -> list[tuple]:
        if self.n == 0 or self.n >= self.most or (row.track_kind == "video" and row.keyframe):
            self.run, self.n = self.run + 1, 0
        self.n += 1
        return [(row.seq, self.run)]


def fragment_runs(packets: DataFrame, most: int = 90) -> DataFrame:
    return run_stage(packets, lambda: FragmentStage(most), "seq", "asset_id bigint, track_id bigint, seq bigint, run_no bigint")


class SeekStage(Stage):
    """Holds packets since the last keyframe until the stream passes the time; then gives out all that follow."""

    def __init__(self, time_us: int) -> None:
        self.t, self.held, self.open = time_us, [], False

    def push(self, row) -> list[tuple]:
        item = (row.seq, row.pts_us, row.keyframe)
        if self.open:
            return [item]
        if row.keyframe and row.pts_us <= self.t:
            self.held = []
        self.held.append(item)
        if row.pts_us > self.t and row.keyframe:
            self.open, out, self.held = True, self.held, []
            return out
        return []

    def flush(self) -> list[tuple]:
        out, self.held = self.held, []
        return out


def seek_window(packets: DataFrame, time_us: int) -> DataFrame:
    """For streams whose presentation order is their decode order."""
    return run_stage(packets, lambda: SeekStage(time_us), "seq", "asset_id bigint, track_id bigint, seq bigint, pts_us bigint, keyframe boolean")


def limit(blocks: DataFrame, ceiling_db: float = 0.0, mode: str = "hard", knee: float = 0.9) -> DataFrame:
    """Causal and without memory: the batch expression as it is."""
    return dsp.limit(blocks, ceiling_db, mode, knee)


def packet_windows(packets: DataFrame, ts: str = "ts", delay: str = "10 minutes", size: str = "5 minutes") -> DataFrame:
    """Extension: bytes and packets per event-time window, late data dropped after the watermark."""
    return packets.withWatermark(ts, delay).groupBy(F.window(ts, size), "track_id").agg(F.count("*").alias("packets"), F.sum("size_bytes").alias("bytes"))


def write_positions(chunks: DataFrame, path: str, checkpoint: str):
    """A sink that writes each micro-batch as Parquet with the running byte position of every stream."""
    from ..operators.timeline import byte_positions

    return chunks.writeStream.foreachBatch(lambda df, n: byte_positions(df).withColumn("batch", F.lit(n)).write.mode("append").parquet(path)).option("checkpointLocation", checkpoint).start()
