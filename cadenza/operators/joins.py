"""Joins as they occur between timed streams: as-of, range, positional, lookup, carry-forward, merge.

As-of joins are a union and one window per key, so they shuffle each side once and never form pairs.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..errors import InputError
from ..model import TRACK, half_up, in_order, whole


def asof_backward(left: DataFrame, right: DataFrame, by: Sequence[str], left_time: str, right_time: str, values: Sequence[str]) -> DataFrame:
    """Each left row with the values of the last right row at or before its time (null: none).

    Right rows with equal keys and times are told apart by their values, the greatest counts.
    """
    value = F.struct(*[F.col(c) for c in values])
    probes = left.select(*by, F.col(left_time).alias("_t"), F.lit(1).alias("_side"), F.lit(None).cast(right.select(value.alias("v")).schema["v"].dataType).alias("_v"), F.struct(*left.columns).alias("_row"))
    builds = right.select(*by, F.col(right_time).alias("_t"), F.lit(0).alias("_side"), value.alias("_v"), F.lit(None).cast(probes.schema["_row"].dataType).alias("_row"))
    order = Window.partitionBy(*by).orderBy("_t", "_side", "_v").rowsBetween(Window.unboundedPreceding, 0)
    out = builds.unionByName(probes).withColumn("_v", F.last("_v", ignorenulls=True).over(order)).where("_side = 1")
    return out.select("_row.*", *[F.col(f"_v.{c}").alias(c) for c in values])


def cfr_slots(frames: DataFrame, fps: float, duration_us: int | None = None) -> DataFrame:
    """Constant-rate retiming of whole streams: a row per output frame with the source frame it shows.

    A frame lasts its declared duration, else until the next, else as long as the one before lasted. Slot i
    stands at start + round(i * 1e6 / fps) and shows the first frame that ends after it, else the last one.
    """
    if not fps > 0:
        raise InputError.bad("fps must be positive")
    gap = F.lead("pts_us").over(in_order()) - F.col("pts_us")
    back = F.col("pts_us") - F.lag("pts_us").over(in_order())
    last = F.lead("seq").over(in_order()).isNull()
    length = F.coalesce(F.when(F.col("declared_us") > 0, F.col("declared_us")), gap, back)
    end = F.col("pts_us") + length
    if duration_us is not None:
        end = F.when(last, F.min("pts_us").over(whole()) + duration_us).otherwise(end)
    rows = frames.withColumn("_end", end)
    bad = F.col("_end").isNull() | (F.col("_end") <= F.col("pts_us")) | (gap <= 0)
    rows = rows.withColumn("_end", F.when(bad, F.raise_error(F.lit("cannot infer a positive frame duration")).cast("bigint")).otherwise(F.col("_end")))
    rows = rows.withColumn("_reach", F.max("_end").over(in_order().rowsBetween(Window.unboundedPreceding, 0)))
    spans = rows.groupBy(*TRACK).agg(F.min("pts_us").alias("_start"), F.max_by("_end", "seq").alias("_stop"), F.max("seq").alias("_last"))
    count = F.greatest(F.lit(1).cast("bigint"), half_up((F.col("_stop") - F.col("_start")) * F.lit(float(fps)) / 1e6))
    at = lambda i: half_up(i * 1e6 / F.lit(float(fps)))
    slots = spans.withColumn("out_no", F.explode(F.sequence(F.lit(0).cast("bigint"), count - 1)))
    slots = slots.select(*TRACK, (F.col("_start") + at(F.col("out_no"))).alias("_t"), F.lit(0).alias("_side"), "out_no", F.lit(None).cast("bigint").alias("seq"), "_last")
    builds = rows.select(*TRACK, F.col("_reach").alias("_t"), F.lit(1).alias("_side"), F.lit(None).cast("bigint").alias("out_no"), "seq", F.lit(None).cast("bigint").alias("_last"))
    # Backwards in time the nearest end that is greater than the slot comes last before it.
    order = Window.partitionBy(*TRACK).orderBy(F.desc("_t"), "_side", F.desc("seq")).rowsBetween(Window.unboundedPreceding, 0)
    shown = slots.unionByName(builds).withColumn("seq", F.last("seq", ignorenulls=True).over(order)).where("_side = 0")
    shown = shown.withColumn("source_seq", F.coalesce("seq", "_last"))
    duplicate = F.coalesce(F.lag("source_seq").over(in_order("out_no")) == F.col("source_seq"), F.lit(False))
    return shown.select(*TRACK, "out_no", F.col("_t").alias("ts_us"), (at(F.col("out_no") + 1) - at(F.col("out_no"))).alias("duration_us"), "source_seq", duplicate.alias("duplicate"))


def cfr_slots_streaming(frames: DataFrame, fps: float) -> DataFrame:
    """Retiming with one frame of look-behind: a frame holds until the next one, the last for its declared
    duration, else the previous gap, else one slot; a frame shows in every slot that begins before its end."""
    gap = F.lead("pts_us").over(in_order())
    back = F.col("pts_us") - F.lag("pts_us").over(in_order())
    at = lambda i: half_up(i * 1e6 / F.lit(float(fps)))
    end = F.coalesce(gap, F.col("pts_us") + F.coalesce(F.when(F.col("declared_us") > 0, F.col("declared_us")), back, at(F.lit(1))))
    rows = frames.withColumns({"_end": end, "_start": F.min("pts_us").over(whole())})
    # Slots before a time: the grid is rounded, so the estimate is corrected by one either way.
    near = F.floor((F.col("_x") - F.col("_start")) * F.lit(float(fps)) / 1e6).cast("bigint")
    before = lambda x: F.aggregate(F.sequence(F.lit(-2), F.lit(2)), F.lit(0).cast("bigint"), lambda a, d: a + F.when((x + d >= 0) & (F.col("_start") + at(x + d) < F.col("_x")), F.lit(1)).otherwise(F.lit(0))) + F.greatest(x - 2, F.lit(0))
    rows = rows.withColumn("_x", F.col("_end")).withColumn("_to", before(near))
    rows = rows.withColumn("_from", F.coalesce(F.lag("_to").over(in_order()), F.lit(0).cast("bigint"))).where("_to > _from")
    rows = rows.withColumn("out_no", F.explode(F.sequence("_from", F.col("_to") - 1)))
    return rows.select(*TRACK, "out_no", (F.col("_start") + at(F.col("out_no"))).alias("ts_us"), F.col("seq").alias("source_seq"))


def zip_by_position(samples: DataFrame, side: DataFrame, values: Sequence[str]) -> DataFrame:
    """Sample i with row i of the side table; samples without one pass with nulls."""
    return samples.join(side.select(*TRACK, "seq", *values), [*TRACK, "seq"], "left")


def lookup_key(rows: DataFrame, keys: DataFrame, on: str, strict: bool = False) -> DataFrame:
    """Equi lookup of a key by id; with `strict` a miss raises, else `key_found` is false."""
    out = rows.join(keys.withColumn("key_found", F.lit(True)), on, "left").withColumn("key_found", F.coalesce("key_found", F.lit(False)))
    if strict:
        out = out.withColumn("key_found", F.when(F.col("key_found"), F.lit(True)).otherwise(F.raise_error(F.concat(F.lit("no key for id "), F.col(on).cast("string"))).cast("boolean")))
    return out


def carry_forward(rows: DataFrame, tag: str, order: str, by: Sequence[str] = ("asset_id",), clear: str = "NONE", out: str = "in_force") -> DataFrame:
    """The tag in force at each row: the last one set, nothing once `clear` has been seen."""
    last = F.last(tag, ignorenulls=True).over(Window.partitionBy(*by).orderBy(order).rowsBetween(Window.unboundedPreceding, 0))
    return rows.withColumn(out, F.when(last != clear, last))


def merge_streams(*streams: DataFrame, time: str = "dts_us", by: str = "asset_id") -> DataFrame:
    """Interleaves tracks by time, ties by the order of the streams given and then of the track."""
    rows = None
    for i, s in enumerate(streams):
        s = s.withColumn("stream_no", F.lit(i))
        rows = s if rows is None else rows.unionByName(s, allowMissingColumns=True)
    position = F.row_number().over(Window.partitionBy(by).orderBy(time, "stream_no", "track_id", *(["seq"] if "seq" in rows.columns else [])))
    return rows.withColumn("position", (position - 1).cast("bigint"))


def fan_out(assets: DataFrame, rungs: DataFrame) -> DataFrame:
    """Every asset with every rung of a ladder, which is a short list given by the caller."""
    return assets.crossJoin(F.broadcast(rungs))


def crossfade(a: DataFrame, b: DataFrame, overlap: int, shape: str = "equal-power") -> DataFrame:
    """Long-form signals (asset_id, frame, x, n) joined end to end over `overlap` frames; n is their length."""
    import math

    t = lambda i: i / F.lit(max(1, overlap - 1))
    up = (lambda i: F.sin(t(i) * (math.pi / 2))) if shape == "equal-power" else t
    down = (lambda i: F.cos(t(i) * (math.pi / 2))) if shape == "equal-power" else (lambda i: 1 - t(i))
    head = F.col("n") - overlap
    left = a.select("asset_id", F.col("frame").alias("out"), F.when(F.col("frame") >= head, F.col("x") * down(F.col("frame") - head)).otherwise(F.col("x")).alias("xa"))
    lengths = a.groupBy("asset_id").agg((F.max("n") - overlap).alias("_head"))
    right = b.join(lengths, "asset_id").select("asset_id", (F.col("_head") + F.col("frame")).alias("out"), F.when(F.col("frame") < overlap, F.col("x") * up(F.col("frame"))).otherwise(F.col("x")).alias("xb"))
    return left.join(right, ["asset_id", "out"], "full").select("asset_id", F.col("out").alias("frame"), (F.coalesce("xa", F.lit(0.0)) + F.coalesce("xb", F.lit(0.0))).alias("x"))


def recover_durations(packets: DataFrame) -> DataFrame:
    """Durations from the next presented packet; the last repeats the one before, an only one gets 0."""
    shown = Window.partitionBy(*TRACK).orderBy("pts_us", "seq")
    gap = F.lead("pts_us").over(shown) - F.col("pts_us")
    return packets.withColumn("duration_us", F.coalesce(gap, F.col("pts_us") - F.lag("pts_us").over(shown), F.lit(0)))


def next_larger_gap(packets: DataFrame) -> DataFrame:
    """Duration to the next greater timestamp, else from the previous smaller one (null: neither)."""
    up = F.min("pts_us").over(Window.partitionBy(*TRACK).orderBy("pts_us").rangeBetween(1, Window.unboundedFollowing))
    down = F.max("pts_us").over(Window.partitionBy(*TRACK).orderBy("pts_us").rangeBetween(Window.unboundedPreceding, -1))
    return packets.withColumn("duration_us", F.coalesce(up - F.col("pts_us"), F.col("pts_us") - down))
