"""Clocks, shares, offsets and runs along a stream.

Rules whose next break depends on the last one are greedy: they read each stream once, in order, in
`mapInPandas` over rows dealt and sorted by stream, and hold one stream's open run, not the stream.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..errors import CapabilityError
from ..model import TRACK, earlier, half_up, in_order, whole
from ..session import prepare

CLUSTER_SPAN_MS, FRAGMENT_BLOCKS = 30_000, 90
LAZY_TARGET, LAZY_MAX = 900, 3600
READ_GAP, READ_SPAN = 256 << 10, 8 << 20
WRAP = 1 << 33


def running_clock(packets: DataFrame, length: str, start: int = 0, out: str = "clock") -> DataFrame:
    """Sum of the lengths before each packet, from `start` (negative for preroll)."""
    return packets.withColumn(out, (F.coalesce(F.sum(length).over(earlier()), F.lit(0)) + start).cast("bigint"))


def even_split(packets: DataFrame, rate: int) -> DataFrame:
    """Packets of a page (equal `granule`) get equal shares of the samples the page adds; -1 adds none.

    Adds start_sample, samples, pts_us and duration_us."""
    page_start = F.when(F.col("granule").eqNullSafe(F.lag("granule").over(in_order())) & (F.lag("seq").over(in_order()).isNotNull()), 0).otherwise(1)
    rows = packets.withColumn("_p", page_start).withColumn("_p", F.sum("_p").over(in_order().rowsBetween(Window.unboundedPreceding, 0)))
    page = Window.partitionBy(*TRACK, "_p")
    rows = rows.withColumns({"_k": F.row_number().over(page.orderBy("seq")) - 1, "_n": F.count("*").over(page)})
    # The granule reached before a page: the last one that was not -1.
    known = F.when(F.col("granule") >= 0, F.col("granule"))
    rows = rows.withColumn("_b", F.when(F.col("_k") == 0, F.coalesce(F.last(known, ignorenulls=True).over(earlier()), F.lit(0))))
    rows = rows.withColumn("_b", F.first("_b", ignorenulls=True).over(page.orderBy("seq").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)))
    total = F.when(F.col("granule") >= 0, F.greatest(F.col("granule") - F.col("_b"), F.lit(0))).otherwise(F.lit(0))
    at = lambda k: F.col("_b") + half_up(k / F.col("_n") * total)
    rows = rows.withColumns({"start_sample": at(F.col("_k")), "samples": at(F.col("_k") + 1) - at(F.col("_k"))})
    return rows.withColumns({"pts_us": half_up(F.col("start_sample") / rate * 1e6), "duration_us": half_up(F.col("samples") / rate * 1e6)}).drop("_p", "_k", "_n", "_b")


def weighted_granules(packets: DataFrame, target: str = "target", weight: str = "weight") -> DataFrame:
    """Granule after each packet: its share by cumulative weight of the declared target, never going back; the
    last packet has the target itself."""
    upto = F.sum(weight).over(in_order().rowsBetween(Window.unboundedPreceding, 0))
    share = half_up(F.col(target) * upto / F.sum(weight).over(whole()))
    last = F.lead("seq").over(in_order()).isNull()
    rows = packets.withColumn("_g", F.when(last, F.col(target)).otherwise(F.least(F.greatest(share, F.lit(0)), F.col(target))))
    return rows.withColumn("granule", F.max("_g").over(in_order().rowsBetween(Window.unboundedPreceding, 0))).drop("_g")


def clamp_last_granule(packets: DataFrame, declared: str = "declared") -> DataFrame:
    """The last granule becomes the declared one where that lies between the one before and its own."""
    before = F.coalesce(F.lag("granule").over(in_order()), F.lit(0))
    fits = F.lead("seq").over(in_order()).isNull() & (F.col(declared) >= before) & (F.col(declared) <= F.col("granule"))
    return packets.withColumn("granule", F.when(fits, F.col(declared)).otherwise(F.col("granule")))


def composition_offsets(packets: DataFrame, timescale: int, has_dts: bool = True) -> DataFrame:
    """Sample durations and composition offsets in ticks, from decode times or, without, from durations."""
    ticks = lambda us: half_up(us * timescale / 1e6)
    if has_dts:
        gap = F.lead("dts_us").over(in_order()) - F.col("dts_us")
        duration = F.when(gap.isNotNull(), F.greatest(gap, F.lit(0))).otherwise(F.col("duration_us"))
        return packets.withColumns({"duration_ticks": ticks(duration), "ctts_ticks": ticks(F.col("pts_us") - F.col("dts_us"))})
    dts = F.coalesce(F.sum("duration_us").over(earlier()), F.lit(0))
    return packets.withColumns({"duration_ticks": ticks(F.col("duration_us")), "ctts_ticks": ticks(F.col("pts_us") - F.min("pts_us").over(whole()) - dts)})


def unwrap_33(packets: DataFrame, ticks: str = "ticks33", order: str = "seq") -> DataFrame:
    """Undoes the wrap of 33-bit timestamps in decode order: a drop of more than 2^32 is a wrap.

    `order="ticks33"` gives the sorted reading, in which no drop and so no wrap is ever seen."""
    drop = F.when(F.lag(ticks).over(in_order(order)) - F.col(ticks) > (WRAP >> 1), 1).otherwise(0)
    rows = packets.withColumn("_d", drop)
    return rows.withColumn("ticks", F.col(ticks) + F.sum("_d").over(in_order(order).rowsBetween(Window.unboundedPreceding, 0)) * WRAP).drop("_d")


def fragment_runs(packets: DataFrame, most: int = FRAGMENT_BLOCKS) -> DataFrame:
    """Fragment number of each packet: video breaks at keyframes and after `most`, other tracks after `most`."""
    video = F.col("track_kind") == "video"
    island = F.sum(F.when(video & F.col("keyframe"), 1).otherwise(0)).over(in_order().rowsBetween(Window.unboundedPreceding, 0))
    rows = packets.withColumn("_i", island)
    rows = rows.withColumn("_s", F.floor((F.row_number().over(Window.partitionBy(*TRACK, "_i").orderBy("seq")) - 1) / most))
    fresh = F.when((F.lag("_i").over(in_order()) == F.col("_i")) & (F.lag("_s").over(in_order()) == F.col("_s")), 0).otherwise(1)
    rows = rows.withColumn("_f", fresh)
    return rows.withColumn("run_no", (F.sum("_f").over(in_order().rowsBetween(Window.unboundedPreceding, 0)) - 1).cast("bigint")).drop("_i", "_s", "_f")


class Breaks:
    """A greedy rule: told each row of a stream in turn, says whether a new run begins with it."""

    def __init__(self) -> None:
        self.n = 0

    def row(self, *values) -> bool:
        raise NotImplementedError


def greedy_runs(rows: DataFrame, rule: Callable[[], Breaks], columns: list[str], order: list[str], by: tuple[str, ...] = TRACK, out: str = "run_no") -> DataFrame:
    """Numbers the runs of each stream; `rule()` makes a fresh rule for every stream."""
    spark = prepare(rows.sparkSession)

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        now, state, number = None, None, -1
        for part in parts:
            if not len(part):
                continue
            keys = [part[c].to_numpy() for c in by]
            first = tuple(k[0] for k in keys)
            fresh = np.ones(len(part), bool)
            fresh[0] = state is None or first != now
            fresh[1:] = np.any([k[1:] != k[:-1] for k in keys], axis=0)
            now, numbers = tuple(k[-1] for k in keys), []
            for begins, *values in zip(fresh.tolist(), *(part[c].tolist() for c in columns), strict=True):
                if begins:
                    state, number = rule(), -1
                number += state.row(*values)
                numbers.append(number)
            yield part.assign(**{out: np.array(numbers, np.int64)})

    dealt = rows.repartition(max(1, int(spark.conf.get("spark.sql.shuffle.partitions"))), *by).sortWithinPartitions(*by, *order)
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema.fields)
    return dealt.mapInPandas(run, f"{fields}, {out} bigint")


class _Span(Breaks):
    def __init__(self, span: int, most: int | None = None, at_keys: bool = False) -> None:
        super().__init__()
        self.span, self.most, self.at_keys = span, most, at_keys

    def row(self, time, key) -> bool:
        fresh = self.n == 0 or max(self.high, time) - min(self.low, time) > self.span or (self.at_keys and bool(key)) or (self.most is not None and self.n >= self.most)
        if fresh:
            self.n, self.low, self.high = 0, time, time
        self.n += 1
        self.low, self.high = min(self.low, time), max(self.high, time)
        return fresh


def cluster_plan(blocks: DataFrame, order: list[str], span_ms: int = CLUSTER_SPAN_MS) -> DataFrame:
    """Clusters of an asset's interleaved blocks (time_ms, video_key): a new one where the span would pass the limit."""
    return greedy_runs(blocks, lambda: _Span(span_ms), ["time_ms", "video_key"], order, by=("asset_id",), out="cluster_no")


def webm_fragments(blocks: DataFrame, order: list[str], most: int = FRAGMENT_BLOCKS, span_ms: int = CLUSTER_SPAN_MS) -> DataFrame:
    """Like clusters, but video keyframes and `most` blocks end a fragment too."""
    return greedy_runs(blocks, lambda: _Span(span_ms, most, True), ["time_ms", "video_key"], order, by=("asset_id",), out="fragment_no")


class _Lazy(Breaks):
    def __init__(self, target: int, most: int) -> None:
        super().__init__()
        self.target, self.most = target, most

    def row(self, key, track_kind) -> bool:
        video = track_kind == "video"
        fresh = self.n == 0 or (not video and self.n >= self.target) or (video and ((key and self.n >= self.target) or self.n >= self.most))
        self.n = 1 if fresh else self.n + 1
        return bool(fresh)


def lazy_fragment_runs(packets: DataFrame, target: int = LAZY_TARGET, most: int = LAZY_MAX) -> DataFrame:
    """Runs of about `target` packets that end at keyframes, `most` at the latest."""
    return greedy_runs(packets, lambda: _Lazy(target, most), ["keyframe", "track_kind"], ["seq"])


class _Riff(Breaks):
    def __init__(self, limit: int) -> None:
        super().__init__()
        self.limit, self.bytes = limit, 4

    def row(self, size) -> bool:
        wire = 8 + size + (size & 1)
        if wire > self.limit:
            raise CapabilityError.miss("a packet exceeds one RIFF segment", {"op": "mux", "bytes": int(wire)}, ["avi"])
        fresh = self.n == 0 or self.bytes + wire > self.limit
        self.bytes = (4 if fresh else self.bytes) + wire
        self.n = 1 if fresh else self.n + 1
        return fresh


def avi_segments(packets: DataFrame, limit: int, order: list[str]) -> DataFrame:
    """RIFF segments of an asset's chunks: header, payload, padding to even, and 4 bytes a segment."""
    return greedy_runs(packets, lambda: _Riff(limit), ["size_bytes"], order, by=("asset_id",), out="segment_no")


class _Reads(Breaks):
    def __init__(self, gap: int, span: int) -> None:
        super().__init__()
        self.gap, self.span = gap, span

    def row(self, offset, size) -> bool:
        end = offset + size
        fresh = self.n == 0 or offset - self.end > self.gap or end - self.start > self.span
        self.start, self.end = (offset, end) if fresh else (self.start, max(self.end, end))
        self.n = 1
        return fresh


def read_windows(samples: DataFrame, gap: int = READ_GAP, span: int = READ_SPAN) -> DataFrame:
    """Byte ranges to read together: near each other and not too long together, in offset order."""
    return greedy_runs(samples, lambda: _Reads(gap, span), ["offset", "size_bytes"], ["offset", "seq"], out="window_no")


def expand_sample_tables(tables: DataFrame) -> DataFrame:
    """Packets of run-length sample tables, one row of `st` per track.

    `st` has stts (count, delta), ctts (count, offset), stsz, stsc (first_chunk, per_chunk), stco and stss; runs
    that end early go on with their last value; samples end with the sizes or the chunks, whichever is first;
    without stss every sample is a keyframe. `edit` (ticks) is subtracted from presentation times. The
    result is in ticks.
    """
    first = lambda a, b: F.slice(a, 1, b)

    def spread(column: str, value: str, n: Column) -> Column:
        """The values of the runs, one a sample; the last one goes on, none at all gives 0."""
        runs = F.filter(f"st.{column}", lambda r: r["count"] > 0)
        flat = F.flatten(F.transform(runs, lambda r: F.array_repeat(r[value].cast("bigint"), r["count"].cast("int"))))
        last = F.coalesce(F.element_at(F.transform(runs, lambda r: r[value].cast("bigint")), -1), F.lit(0).cast("bigint"))
        return first(F.concat(flat, F.array_repeat(last, F.greatest(n - F.size(flat), F.lit(0)))), n)

    # Entries of stsc count in their order: those up to the first whose first_chunk lies beyond a chunk.
    chunk_no = F.sequence(F.lit(1), F.size("st.stco"))
    start = F.struct(F.lit(0).alias("per"), F.lit(True).alias("on"))
    reach = lambda c: F.aggregate("st.stsc", start, lambda a, e: F.struct(F.when(a["on"] & (e["first_chunk"] <= c), e["per_chunk"].cast("int")).otherwise(a["per"]).alias("per"), (a["on"] & (e["first_chunk"] <= c)).alias("on")))["per"]
    chunks = F.when(F.size("st.stco") > 0, F.flatten(F.transform(chunk_no, lambda c: F.array_repeat(c, F.greatest(reach(c), F.lit(0)))))).otherwise(F.array().cast("array<int>"))
    rows = tables.select(*TRACK, "st", F.coalesce("edit", F.lit(0)).alias("edit"), chunks.alias("chunks"))
    n = F.least(F.size("st.stsz"), F.size("chunks"))
    # Keyframes from the gaps between their numbers, in order.
    keys = F.sort_array(F.array_distinct(F.filter("st.stss", lambda k: (k > 0) & (k <= F.size("chunks")))))
    rows = rows.withColumns({"n": n, "keys": keys})
    flags = F.flatten(F.transform("keys", lambda k, i: F.concat(F.array_repeat(F.lit(False), k - F.coalesce(F.get("keys", i - 1), F.lit(0)) - 1), F.array(F.lit(True)))))
    ctts = F.when(F.size("st.ctts") > 0, spread("ctts", "offset", F.col("n"))).otherwise(F.array_repeat(F.lit(0).cast("bigint"), F.col("n")))
    zipped = F.arrays_zip(first(F.transform("st.stsz", lambda x: x.cast("bigint")), F.col("n")).alias("size_bytes"), spread("stts", "delta", F.col("n")).alias("delta"), ctts.alias("ctts"), first("chunks", F.col("n")).alias("chunk"), first(flags, F.col("n")).alias("key"))
    flat = rows.where("n > 0").select(*TRACK, "edit", (F.size("st.stss") == 0).alias("all_sync"), "st.stco", F.posexplode(zipped).alias("seq", "s"))
    flat = flat.select(*TRACK, "edit", "all_sync", F.col("seq").cast("bigint").alias("seq"), "s.*", F.element_at("stco", F.col("s.chunk")).alias("chunk_offset"))
    # One order for everything: the bytes before a sample in its chunk are those before it in all chunks less those before the chunk.
    flat = flat.withColumns({"dts_ticks": F.coalesce(F.sum("delta").over(earlier()), F.lit(0)).cast("bigint"), "_before": F.coalesce(F.sum("size_bytes").over(earlier()), F.lit(0)), "_fresh": ~F.col("chunk").eqNullSafe(F.lag("chunk").over(in_order()))})
    flat = flat.withColumn("_base", F.last(F.when(F.col("_fresh"), F.col("_before")), ignorenulls=True).over(in_order().rowsBetween(Window.unboundedPreceding, 0)))
    return flat.select(
        *TRACK, "seq", (F.col("chunk_offset") + F.col("_before") - F.col("_base")).cast("bigint").alias("offset"), "size_bytes", "dts_ticks",
        (F.col("dts_ticks") + F.col("ctts") - F.col("edit")).cast("bigint").alias("pts_ticks"), F.col("delta").alias("duration_ticks"), (F.col("all_sync") | F.coalesce("key", F.lit(False))).alias("keyframe"),
    )


def ticks_to_us(ticks, timescale: int):
    """round(ticks * 1e6 / timescale), 0 for a timescale that is not positive."""
    return half_up(ticks * 1e6 / timescale) if timescale > 0 else F.lit(0).cast("bigint")


def byte_positions(chunks: DataFrame, size: str = "size_bytes") -> DataFrame:
    """Where each chunk of a stream begins in its sink."""
    return chunks.withColumn("position", F.coalesce(F.sum(size).over(earlier()), F.lit(0)))
