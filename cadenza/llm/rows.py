"""Whole rows by key: decisions are made on narrow rows and then brought back to the rows they are about.

A row's key is its id and a 64-bit hash of all its columns, so rows with equal keys are equal rows (two
different rows share a key with a chance of 2 ** -64 a pair of one id). Texts are moved once: the rows that a
decision changes are written as a narrow table, and as it grows with the input, both sides are sorted and
merged at every size.
The row travels as a struct, so its columns may have any names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DataType, MapType, StructType

from .store import Scratch


def named(column: str) -> Column:
    return F.col("`" + column.replace("`", "``") + "`")


def _has_map(kind: DataType) -> bool:
    if isinstance(kind, MapType):
        return True
    if isinstance(kind, ArrayType):
        return _has_map(kind.elementType)
    return isinstance(kind, StructType) and any(_has_map(f.dataType) for f in kind.fields)


def row_hash(docs: DataFrame) -> Column:
    """A hash of all columns; maps count as their JSON, as Spark hashes none."""
    return F.xxhash64(*[F.to_json(F.struct(named(f.name))) if _has_map(f.dataType) else named(f.name) for f in docs.schema.fields])


def keyed(docs: DataFrame, id_col: str = "doc_id", **more: Column) -> DataFrame:
    """(row, id, key, ...): each row as a struct with its key and the columns in `more`."""
    return docs.select(
        F.struct(*[named(c).alias(c) for c in docs.columns]).alias("row"), named(id_col).cast("long").alias("id"), row_hash(docs).alias("key"), *[c.alias(k) for k, c in more.items()]
    )


def same(a: DataFrame, b: DataFrame) -> Column:
    return a["id"].eqNullSafe(b["id"]) & (a["key"] == b["key"])


def one_of_each(rows: DataFrame, repeated: DataFrame) -> DataFrame:
    """`rows` with one row for every key in `repeated` (id, key), a written table of the keys that occur twice or more.

    Only the repeated rows are grouped, and pre-aggregated, whatever their number."""
    if repeated.isEmpty():
        return rows
    values = [c for c in rows.columns if c not in ("id", "key")]
    again = rows.join(repeated, same(rows, repeated), "left_semi").groupBy("id", "key").agg(*[F.first(c).alias(c) for c in values])
    return rows.join(repeated, same(rows, repeated), "left_anti").unionByName(again)


def take(rows: DataFrame, wanted: DataFrame, scratch: Scratch) -> DataFrame:
    """The rows as often as wanted: `wanted` says of each key (id, key) how many rows have it (n) and how many should be (copies)."""
    odd = scratch.table(wanted.where("n != copies").select("id", "key", "copies")).hint("merge")
    out = rows.join(odd, same(rows, odd), "left_anti").select("row")
    some = odd.where("copies > 0")
    if not some.isEmpty():
        again = rows.join(some, same(rows, some)).groupBy(rows["id"], rows["key"]).agg(F.first("row").alias("row"), F.first("copies").alias("copies"))
        out = out.unionByName(again.select("row", F.explode(F.sequence(F.lit(1), F.col("copies"))).alias("_n")).select("row"))
    return out.select("row.*")


def attach(rows: DataFrame, decided: DataFrame, scratch: Scratch) -> DataFrame:
    """The rows with the other columns of `decided` (id, key, ...), which has a row for every one of them.

    Input columns of the same names are replaced."""
    decided = scratch.table(decided)
    values = [c for c in decided.columns if c not in ("id", "key")]
    repeated = scratch.table(decided.groupBy("id", "key").agg(F.count("*").alias("n")).where("n > 1").select("id", "key"))
    texts = one_of_each(rows, repeated)
    kept = [f.name for f in rows.schema["row"].dataType.fields if f.name not in values]
    return texts.join(decided, same(texts, decided)).select(*[F.col("row").getField(c).alias(c) for c in kept], *values)
