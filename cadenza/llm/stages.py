"""The stages of the corpus pipeline: each keeps whole rows of documents and applies one operator.

Each stage works on all rows it is given and decides on narrow rows (id, hash of the whole row); see `rows`
for how the decision gets back to the rows. So null and repeated ids and extra columns of any names pass
through, and texts are moved as rarely as can be. The last stage's columns `shard` and `slot` replace input
columns of these names.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .decontamination import find_matches
from .minhash import linked_rows
from .mixing import mix_rows
from .rows import attach, keyed, take
from .sharding import interleave
from .store import Scratch
from .toxicity import fit_chain, score_toxicity


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier chain, fitted on this stage's documents, does not call toxic."""
    chain = fit_chain(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return score_toxicity(docs, chain, docs.columns).where(~F.col("is_toxic")).select("row.*")


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates: similarity 0.8 over five-word shingles.

    The smallest id stays; of rows that share it the least by a hash of the row, once; a group without any id
    keeps the least row by that hash. Documents without words are in no group and stay, each as often as it is there.
    """
    scratch = Scratch(spark, "near-duplicates")
    rows = keyed(docs, text=F.col("text").cast("string"))
    linked = scratch.table(linked_rows(rows.select("id", "key", "text"), percent=80))
    first = F.min(F.struct(F.col("id").isNull().alias("no"), "id", "key")).alias("f")
    chosen = scratch.table(linked.where("root is not null").groupBy("root").agg(first).select("f.id", "f.key", F.lit(1).cast("long").alias("one")))
    counts = linked.groupBy("id", "key").agg(F.count("*").alias("n"), F.count("root").alias("grouped"))
    wanted = counts.join(chosen, counts["id"].eqNullSafe(chosen["id"]) & (counts["key"] == chosen["key"]), "left")
    copies = F.when(F.col("grouped") == 0, F.col("n")).otherwise(F.coalesce("one", F.lit(0)))
    return take(rows, wanted.select(counts["id"], counts["key"], "n", copies.alias("copies")), scratch)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without any benchmark window."""
    scratch = Scratch(spark, "decontaminated")
    rows = keyed(docs, th=F.xxhash64(F.col("text").cast("string")))
    found = find_matches(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet")).where(F.size("starts") > 0)
    hit = scratch.table(found.select(F.col("doc_id").cast("long").alias("id"), "th").distinct())
    return rows.join(hit, rows["id"].eqNullSafe(hit["id"]) & (rows["th"] == hit["th"]), "left_anti").select("row.*")


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents drawn to the target weights: 95 % of the tokens, each document once at most."""
    return mix_rows(docs, percent=95, epochs=1)


def shard(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents with shard and slot, every shard in the mixture's proportions."""
    rows = keyed(docs, source=F.col("source"))
    placed = interleave(rows.select("id", "key", "source"), id_col="id", tie_col="key").select("id", "key", "shard", "slot")
    return attach(rows.select("row", "id", "key"), placed, Scratch(spark, "sharded"))
