"""Aggregates over packet, PCM and playlist tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..model import TRACK, earlier, in_order, whole

FPS_TOLERANCE = 0.02
TS_CLOCK = 90_000
WRAP = 1 << 33


def container_duration(tracks: DataFrame) -> DataFrame:
    """Seconds of the longest track; a track without duration counts as 0."""
    return tracks.groupBy("asset_id").agg(F.max(F.coalesce("duration_sec", F.lit(0.0))).alias("duration_sec"))


def upper_median(rows: DataFrame, value: str, by: tuple[str, ...]) -> DataFrame:
    """(by, value): the element at floor(n / 2) of the sorted values of each group, no interpolation, by rank; no group is held as a whole."""
    known = rows.where(F.col(value).isNotNull())
    ranked = known.select(*by, value, F.row_number().over(Window.partitionBy(*by).orderBy(value)).alias("_r"), F.count("*").over(Window.partitionBy(*by)).alias("_n"))
    return ranked.where(F.col("_r") == F.floor(F.col("_n") / 2) + 1).select(*by, value)


def ts_duration(packets: DataFrame, ticks: str = "pts_ticks") -> DataFrame:
    """Seconds from the earliest first to the latest last presentation, plus the finest positive median gap.

    Tracks with fewer than two units or no positive span don't count."""
    order = Window.partitionBy(*TRACK).orderBy(ticks)
    gaps = packets.select(*TRACK, ticks, (F.col(ticks) - F.lag(ticks).over(order)).alias("gap"))
    spans = gaps.groupBy(*TRACK).agg(F.min(ticks).alias("a"), F.max(ticks).alias("b")).where("b > a").join(upper_median(gaps, "gap", TRACK), list(TRACK), "left")
    total = F.max("b") - F.min("a") + F.coalesce(F.min(F.when(F.col("gap") > 0, F.col("gap"))), F.lit(0))
    return spans.groupBy("asset_id").agg((total / TS_CLOCK).alias("duration_sec"))


def snapped_fps(packets: DataFrame, unit_us: float = 1.0) -> DataFrame:
    """(count - 1) / span in seconds, taken to the nearest whole number where it is within 2 % of it."""
    raw = (F.count("*") - 1) / ((F.max("pts_us") - F.min("pts_us")) * F.lit(unit_us) / 1e6)
    spans = packets.groupBy(*TRACK).agg(F.count("*").alias("n"), F.min("pts_us").alias("a"), F.max("pts_us").alias("b"), raw.alias("raw")).where("n >= 2 and b > a")
    near = F.floor(F.col("raw") + 0.5)
    return spans.select(*TRACK, F.when((near >= 1) & (F.abs(F.col("raw") - near) / near <= FPS_TOLERANCE), near.cast("double")).otherwise(F.col("raw")).alias("fps"))


def level(blocks: DataFrame) -> DataFrame:
    """Peak and RMS of each asset over all channels and samples.

    Every block is summed in sample order; the blocks' sums are added as they come, so the last bits of the RMS
    may depend on the partitioning, and no track is held as a whole."""
    flat = F.flatten("planar")
    peak = F.aggregate(flat, F.lit(0.0), lambda a, x: F.greatest(a, F.abs(x)))
    power = F.aggregate(flat, F.lit(0.0), lambda a, x: a + x * x)
    per = blocks.select("asset_id", peak.alias("peak"), power.alias("power"), F.size(flat).alias("n"))
    out = per.groupBy("asset_id").agg(F.max("peak").alias("peak"), F.sum("power").alias("power"), F.sum("n").alias("n"))
    return out.select("asset_id", "peak", F.when(F.col("n") > 0, F.sqrt(F.col("power") / F.col("n"))).otherwise(F.lit(0.0)).alias("rms"), "n")


def packet_digest(packets: DataFrame) -> DataFrame:
    """Count, bytes and SHA-256 of each track's payload-free rows in order.

    One text line per packet, `seq,pts,duration,size,key`; the digest covers the lines joined by newlines."""
    line = F.concat_ws(",", "seq", "pts_us", F.coalesce(F.col("duration_us").cast("string"), F.lit("")), "size_bytes", F.when(F.col("keyframe"), 1).otherwise(0))
    lines = F.transform(F.array_sort(F.collect_list(F.struct("seq", line.alias("line")))), lambda x: x["line"])
    return packets.groupBy(*TRACK).agg(F.count("*").alias("count"), F.sum("size_bytes").alias("total_bytes"), F.sha2(F.array_join(lines, "\n").cast("binary"), 256).alias("sha256"))


def run_length_encode(rows: DataFrame, value: str) -> DataFrame:
    """(TRACK, run_no, value, count): consecutive equal values in stream order."""
    change = F.when(~F.col(value).eqNullSafe(F.lag(value).over(in_order())) | F.lag("seq").over(in_order()).isNull(), F.lit(1)).otherwise(F.lit(0))
    runs = rows.withColumn("_c", change).withColumn("run_no", (F.sum("_c").over(in_order().rowsBetween(Window.unboundedPreceding, 0)) - 1).cast("bigint"))
    return runs.groupBy(*TRACK, "run_no").agg(F.first(value).alias(value), F.count("*").alias("count"))


def run_length_decode(runs: DataFrame, value: str) -> DataFrame:
    """The inverse: a row per element with its position in the track."""
    start = F.coalesce(F.sum("count").over(earlier("run_no")), F.lit(0))
    rows = runs.withColumn("_s", start).where("count > 0").withColumn("_i", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("count") - 1)))
    return rows.select(*TRACK, (F.col("_s") + F.col("_i")).alias("seq"), value)


def declared_end(tracks: DataFrame, slack_ms: int) -> DataFrame:
    """The latest declared video end where audio runs over it by no more than the slack, else the latest end."""
    video = F.max(F.when(F.col("track_kind") == "video", F.col("end_ms")))
    return tracks.groupBy("asset_id").agg(F.when((video > 0) & (F.max("end_ms") <= video + slack_ms), video).otherwise(F.max("end_ms")).alias("end_ms"))


def timeline_base(packets: DataFrame, declared: bool) -> DataFrame:
    """Least presentation time of an asset; 0 where it is negative but a duration is declared and some time isn't."""
    low = F.min("pts_us")
    base = F.when((low < 0) & (F.max("pts_us") >= 0), F.lit(0)).otherwise(low) if declared else low
    return packets.groupBy("asset_id").agg(base.cast("bigint").alias("base_us"))


def rebase(packets: DataFrame) -> DataFrame:
    """Shifts an asset so that no time is negative: by min(0, pts, dts) over all its packets."""
    low = F.least(F.lit(0), F.min("pts_us").over(Window.partitionBy("asset_id")), F.min(F.coalesce("dts_us", "pts_us")).over(Window.partitionBy("asset_id")))
    return packets.withColumns({"out_pts_us": F.col("pts_us") - low, "out_dts_us": F.coalesce("dts_us", "pts_us") - low})


def coalesce_intervals(intervals: DataFrame, by: str = "asset_id") -> DataFrame:
    """Disjoint covering intervals of half-open (start, end) rows; touching ones become one."""
    order = Window.partitionBy(by).orderBy("start", "end")
    reach = F.max("end").over(order.rowsBetween(Window.unboundedPreceding, -1))
    rows = intervals.where("end > start").withColumn("_n", F.when(F.col("start") <= reach, F.lit(0)).otherwise(F.lit(1)))
    rows = rows.withColumn("_g", F.sum("_n").over(order.rowsBetween(Window.unboundedPreceding, 0)))
    return rows.groupBy(by, "_g").agg(F.min("start").alias("start"), F.max("end").alias("end")).drop("_g")


def tallies(outcomes: DataFrame, row: str, column: str) -> DataFrame:
    """Counts of outcomes per class, one column for each outcome."""
    return outcomes.groupBy(row).pivot(column).count().na.fill(0)


def geomean(values: DataFrame, by: str, value: str) -> DataFrame:
    return values.where(F.col(value) > 0).groupBy(by).agg(F.exp(F.avg(F.log(value))).alias("geomean"))


def track_span(packets: DataFrame) -> DataFrame:
    """Each packet with its track's first presentation."""
    return packets.withColumn("first_us", F.min("pts_us").over(whole()))
