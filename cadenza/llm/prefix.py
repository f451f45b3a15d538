"""Running sums over a seeded order within groups, without bringing a group to one task.

The order key is a hex digest. Its first digits cut each group into even buckets; sums of the buckets,
pre-aggregated, give each bucket its offset, and only a bucket's own rows meet in a window. A group with
a third of all rows is so spread over ``16 ** DIGITS`` windows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .store import Scratch

DIGITS = 3


def seeded(seed: str, *columns: str | Column) -> Column:
    """A hex order key: the same rows get the same key anywhere. Nulls count as the empty string."""
    parts = [F.coalesce((F.col(c) if isinstance(c, str) else c).cast("string"), F.lit("")) for c in columns]
    return F.md5(F.concat_ws("|", F.lit(seed), *parts).cast("binary"))


def running(df: DataFrame, group: list[str], key: str, value: Column, scratch: Scratch | None = None) -> DataFrame:
    """Adds `before` (the sum of `value` over earlier rows of the group) and `total` (over all of them).

    Group columns must not be null, and no column may be called `_v`, `_b` or `_o`. Rows are ordered by `key`.
    The table of bucket sums has at most ``16 ** DIGITS`` rows a group; with `scratch` it is written, so that
    AQE can split the join where one group has most of the rows.
    """
    rows = df.withColumn("_v", value.cast("long")).withColumn("_b", F.substring(key, 1, DIGITS))
    sums = rows.groupBy(*group, "_b").agg(F.sum("_v").alias("_s"))
    # Sums of the leading digit first, so that no window holds more than 16 ** (DIGITS - 1) rows.
    sums = sums.withColumn("_h", F.substring("_b", 1, 1))
    heads = sums.groupBy(*group, "_h").agg(F.sum("_s").alias("_hs"))
    of_heads = Window.partitionBy(*group).orderBy("_h")
    heads = heads.select(
        *group, "_h", F.coalesce(F.sum("_hs").over(of_heads.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_ho"), F.sum("_hs").over(Window.partitionBy(*group)).alias("total")
    )
    in_head = Window.partitionBy(*group, "_h").orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)
    sums = sums.join(heads, [*group, "_h"]).select(*group, "_b", (F.col("_ho") + F.coalesce(F.sum("_s").over(in_head), F.lit(0))).alias("_o"), "total")
    if scratch is not None:
        sums = scratch.table(sums)
    inside = Window.partitionBy(*group, "_b").orderBy(key).rowsBetween(Window.unboundedPreceding, -1)
    out = rows.join(sums, [*group, "_b"]).withColumn("before", F.col("_o") + F.coalesce(F.sum("_v").over(inside), F.lit(0)))
    return out.drop("_v", "_b", "_o")
