"""The canonical tables, their order keys, and rounding.

A DataFrame has no order, so each table names its own: packets by `seq` (decode order), PCM blocks by
`block_no`, frames by `frame_no`. State never crosses (asset_id, track_id), which is also how windows and
grouped functions partition.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

TRACK = ("asset_id", "track_id")

TRACKS = (
    "asset_id bigint, track_id int, track_kind string, codec string, timescale int, duration_sec double, fps double, rotation int, encrypted boolean, alpha boolean, "
    "width int, height int, sample_rate int, channels int, gapless struct<leading:bigint,trailing:bigint,total:bigint>"
)
PACKETS = "asset_id bigint, track_id int, seq bigint, offset bigint, size_bytes bigint, pts_us bigint, dts_us bigint, duration_us bigint, keyframe boolean"
PCM_BLOCKS = "asset_id bigint, track_id int, block_no bigint, start_frame bigint, sample_rate int, channels int, planar array<array<double>>"
FRAMES = "asset_id bigint, track_id int, frame_no bigint, ts_us bigint, duration_us bigint, width int, height int, rgba binary, primaries string, transfer string"


def half_up(x: Column) -> Column:
    """To a whole number, halves toward plus infinity (Spark's round goes away from zero)."""
    return F.floor(x + F.lit(0.5)).cast("bigint")


def half_up_py(x: float) -> int:
    import math

    return math.floor(x + 0.5)


def in_order(order: str = "seq", by: tuple[str, ...] = TRACK) -> WindowSpec:
    return Window.partitionBy(*by).orderBy(order)


def whole(by: tuple[str, ...] = TRACK) -> WindowSpec:
    return Window.partitionBy(*by)


def earlier(order: str = "seq", by: tuple[str, ...] = TRACK) -> WindowSpec:
    """All rows before the current one."""
    return in_order(order, by).rowsBetween(Window.unboundedPreceding, -1)


def so_far(order: str = "seq", by: tuple[str, ...] = TRACK) -> WindowSpec:
    return in_order(order, by).rowsBetween(Window.unboundedPreceding, Window.currentRow)


def assert_ordered(packets: DataFrame, column: str = "pts_us", order: str = "seq", message: str = "timestamps must be strictly increasing") -> DataFrame:
    """Raises, when rows are read, where `column` does not strictly increase in `order`."""
    before = F.lag(column).over(in_order(order))
    ok = before.isNull() | (F.col(column) > before)
    return packets.withColumn(column, F.when(ok, F.col(column)).otherwise(F.raise_error(F.lit(message)).cast("bigint")))
