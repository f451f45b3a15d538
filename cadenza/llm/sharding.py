"""Sharding by proportional stratified interleaving.

Rows are ranked in a seeded shuffle within their source; row r of n has the fractional rank
(2 r - 1) / (2 n). Sorted by it, every stretch of rows holds each source in its share of the corpus, so
cutting the sequence evenly gives shards that match the mixture, with row counts at most one apart.

Both rankings are bucketed (see `prefix`): no source and no shard is ever sorted in one task.

Defined results: a null source is a stratum of its own; null texts have size 1; rows without id or
repeated are placed one by one, and equal rows are interchangeable; fewer rows than shards leave shards
empty; an empty table gives an empty table. The row travels as a struct, so its columns may have any names;
input columns called `shard` or `slot` are replaced.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .prefix import running, seeded
from .rows import named

SHARDS, SEED, SLICES = 16, "shard-1", 4096


def interleave(docs: DataFrame, shards: int = SHARDS, seed: str = SEED, id_col: str = "doc_id", tie_col: str = "text", source_col: str = "source") -> DataFrame:
    """`docs` with `shard` (0 to shards - 1) and `slot` (from 0, gapless in a shard).

    Rows of a source are ordered by the MD5 of seed, id and the CRC-32 of `tie_col`, which tells rows of one id apart."""
    tie = F.crc32(F.coalesce(named(tie_col).cast("string"), F.lit("")).cast("binary"))
    source = F.coalesce(F.concat(F.lit("="), named(source_col).cast("string")), F.lit(""))
    kept = [c for c in docs.columns if c not in ("shard", "slot")]
    rows = docs.select(F.struct(*[named(c).alias(c) for c in kept]).alias("row"), source.alias("source"), seeded(seed, named(id_col), tie).alias("key"))
    ranked = running(rows, ["source"], "key", F.lit(1))
    ranked = ranked.withColumn("at", (2 * F.col("before") + 1) / (2 * F.col("total"))).drop("before", "total")
    ranked = ranked.withColumn("slice", F.floor(F.col("at") * SLICES).cast("int"))
    counts = ranked.groupBy("slice").agg(F.count("*").alias("n"))  # SLICES rows at most, whatever the input
    counts = counts.select(
        "slice",
        F.coalesce(F.sum("n").over(Window.orderBy("slice").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("offset"),
        F.sum("n").over(Window.partitionBy(F.lit(0))).alias("every"),
    )
    order = Window.partitionBy("slice").orderBy("at", "source", "key")
    placed = ranked.join(F.broadcast(counts), "slice").withColumn("pos", F.col("offset") + F.row_number().over(order) - 1)
    placed = placed.withColumn("shard", F.expr(f"cast((pos * {shards}) div every as int)"))
    first = F.expr(f"(shard * every + {shards - 1}) div {shards}")
    return placed.select("row.*", "shard", (F.col("pos") - first).cast("long").alias("slot"))


def op5_sharding(spark, sf_dir: str) -> DataFrame:
    text = F.coalesce(F.col("text"), F.lit(""))
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    rows = docs.select("doc_id", "source", (F.octet_length(text) + 1).cast("long").alias("size"), F.crc32(text.cast("binary")).alias("text_crc32"), text.alias("text"))
    out = interleave(rows)
    return out.select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))
