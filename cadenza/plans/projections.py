"""Fixed projections of the driver's tables onto the canonical tables, in Spark and in SQL.

`SQL[name]` is the text of a common table expression with the same rows, for the oracles.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

EPOCH_US = 1_704_067_200_000_000  # 2024-01-01
S_US, E_US = 10 * 86_400_000_000, 12 * 86_400_000_000
#: Tracks of an asset, and blocks of a signal: fixed, so that assets grow in number with the tables and not in size.
TRACKS, BLOCKS = 8, 40
RATE = 16_000


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def packets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """events as packets: a track for each user, every third one audio, `signup` for keyframe; TRACKS tracks an asset."""
    e = table(spark, sf_dir, "events")
    order = Window.partitionBy("user_id").orderBy("ts", "event_id")
    rows = e.select(
        F.floor(F.col("user_id") / TRACKS).cast("bigint").alias("asset_id"),
        F.col("user_id").alias("track_id"),
        (F.row_number().over(order) - 1).cast("bigint").alias("seq"),
        (F.unix_micros(F.col("ts").cast("timestamp")) - EPOCH_US).alias("pts_us"),
        (F.col("event_type") == "signup").alias("keyframe"),
        F.coalesce(F.length("props"), F.lit(0)).cast("bigint").alias("size_bytes"),
        F.when(F.col("user_id") % 3 == 0, F.lit("audio")).otherwise(F.lit("video")).alias("track_kind"),
    )
    track = Window.partitionBy("asset_id", "track_id").orderBy("seq")
    gap = F.coalesce(F.lead("pts_us").over(track) - F.col("pts_us"), F.col("pts_us") - F.lag("pts_us").over(track))
    return rows.withColumns({"duration_us": gap, "dts_us": F.col("pts_us")})


def samples(spark: SparkSession, sf_dir: str) -> DataFrame:
    """lineitem as samples of an order's only track, in a unique order."""
    order = Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice")
    return table(spark, sf_dir, "lineitem").select(
        F.col("l_orderkey").alias("asset_id"),
        F.lit(0).cast("bigint").alias("track_id"),
        (F.row_number().over(order) - 1).cast("bigint").alias("seq"),
        F.col("l_quantity").cast("bigint").alias("size_bytes"),
        (F.col("l_returnflag") == "R").alias("keyframe"),
        F.col("l_returnflag").alias("flag"),
        ((F.col("l_partkey") % 3 + 1) * 1000).cast("bigint").alias("delta"),
        ((F.col("l_suppkey") % 2) * 500).cast("bigint").alias("ctts"),
    )


def pcm(spark: SparkSession, sf_dir: str) -> DataFrame:
    """embeddings as blocks of 64 mono samples, BLOCKS blocks an asset."""
    asset = F.floor(F.col("vec_id") / BLOCKS).cast("bigint")
    order = Window.partitionBy(asset).orderBy("vec_id")
    e = table(spark, sf_dir, "embeddings")
    rows = e.select(
        asset.alias("asset_id"),
        F.lit(0).cast("bigint").alias("track_id"),
        (F.row_number().over(order) - 1).cast("bigint").alias("block_no"),
        F.lit(RATE).alias("sample_rate"),
        F.lit(1).alias("channels"),
        F.array(F.col("embedding").cast("array<double>")).alias("planar"),
    )
    return rows.withColumn("start_frame", F.col("block_no") * 64)


def interleaved(spark: SparkSession, sf_dir: str) -> DataFrame:
    """conversations as packets of several tracks: the role's rank is the track, the turn the decode time."""
    role = F.when(F.col("role") == "system", 0).when(F.col("role") == "user", 1).otherwise(2)
    return table(spark, sf_dir, "conversations").select(F.col("conv_id").alias("asset_id"), role.cast("bigint").alias("track_id"), F.col("turn").alias("dts_us"), F.coalesce(F.length("text"), F.lit(0)).cast("bigint").alias("size_bytes"))


def geometry(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "part").select(F.col("p_partkey").alias("asset_id"), (16 * (F.col("p_size") + 1)).cast("bigint").alias("width"), (9 * (F.col("p_size") + 1)).cast("bigint").alias("height"))


def segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    """orders as playlist segments of a customer; priority 1 sets a key, priority 5 clears it."""
    order = Window.partitionBy("o_custkey").orderBy("o_orderdate", "o_orderkey")
    priority = F.substring("o_orderpriority", 1, 2)
    return table(spark, sf_dir, "orders").select(
        F.col("o_custkey").alias("asset_id"),
        (F.row_number().over(order) - 1).cast("bigint").alias("idx"),
        (F.col("o_totalprice") / 1e4).alias("duration_sec"),
        F.when(priority == "1-", F.concat(F.lit("k"), F.col("o_orderkey").cast("string"))).when(priority == "5-", F.lit("NONE")).alias("key_tag"),
        F.floor("o_totalprice").cast("bigint").alias("bandwidth"),
    )


SQL = {
    "packets": f"""p0 AS (SELECT user_id // {TRACKS} AS asset_id, user_id AS track_id, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS seq,
  epoch_us(ts) - {EPOCH_US} AS pts_us, event_type = 'signup' AS keyframe, coalesce(length(props), 0) AS size_bytes,
  CASE WHEN user_id % 3 = 0 THEN 'audio' ELSE 'video' END AS track_kind FROM events),
packets AS (SELECT *, coalesce(lead(pts_us) OVER w - pts_us, pts_us - lag(pts_us) OVER w) AS duration_us, pts_us AS dts_us FROM p0 WINDOW w AS (PARTITION BY asset_id, track_id ORDER BY seq))""",
    "samples": """samples AS (SELECT l_orderkey AS asset_id, 0::BIGINT AS track_id, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_extendedprice) - 1 AS seq,
  l_quantity::BIGINT AS size_bytes, l_returnflag = 'R' AS keyframe, l_returnflag AS flag, (l_partkey % 3 + 1) * 1000 AS delta, (l_suppkey % 2) * 500 AS ctts FROM lineitem)""",
    "pcm": f"""blocks AS (SELECT vec_id // {BLOCKS} AS asset_id, 0::BIGINT AS track_id, row_number() OVER (PARTITION BY vec_id // {BLOCKS} ORDER BY vec_id) - 1 AS block_no, embedding::DOUBLE[] AS x FROM embeddings),
pcm AS (SELECT asset_id, track_id, block_no, block_no * 64 AS start_frame, {RATE} AS sample_rate, x FROM blocks)""",
    "interleaved": """interleaved AS (SELECT conv_id AS asset_id, CASE role WHEN 'system' THEN 0 WHEN 'user' THEN 1 ELSE 2 END::BIGINT AS track_id, turn AS dts_us, coalesce(length(text), 0) AS size_bytes FROM conversations)""",
    "geometry": """geometry AS (SELECT p_partkey AS asset_id, (16 * (p_size + 1))::BIGINT AS width, (9 * (p_size + 1))::BIGINT AS height FROM part)""",
    "segments": """segments AS (SELECT o_custkey AS asset_id, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) - 1 AS idx, o_totalprice / 1e4 AS duration_sec,
  CASE substr(o_orderpriority, 1, 2) WHEN '1-' THEN 'k' || o_orderkey::VARCHAR WHEN '5-' THEN 'NONE' END AS key_tag, floor(o_totalprice)::BIGINT AS bandwidth FROM orders)""",
}
