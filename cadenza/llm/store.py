"""Tables that cut lineage, in the folder all executors share.

`Scratch.table` writes a DataFrame as Parquet under ``spark.checkpoint.dir`` and reads it back, so a
lost executor costs a reread and not a recomputation. Shuffle files of such a step are removed when its
table stands. Tables that a later step replaces are dropped at once, the rest when the program ends or
`close_since` says that nothing reads them any more.
"""

from __future__ import annotations

import atexit
import contextlib
import uuid

from pyspark.sql import DataFrame, SparkSession

from ..session import shared_folder

_CLEAN = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


_live: list[Scratch] = []


def mark() -> int:
    """A point in time, for `close_since`."""
    return len(_live)


def close_since(point: int) -> None:
    """Removes the tables of all runs begun since `point`; nothing that reads them may be used any more."""
    for scratch in _live[point:]:
        scratch.close()
    del _live[point:]


def remove(spark: SparkSession, path: str) -> None:
    jvm, hadoop = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    p = jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(hadoop).delete(p, True)


def make_folder(spark: SparkSession, path: str) -> None:
    jvm, hadoop = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    p = jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(hadoop).mkdirs(p)


class Scratch:
    """The tables of one run of an operator."""

    def __init__(self, spark: SparkSession, name: str) -> None:
        self.spark = spark
        self.root = f"{shared_folder(spark)}/cadenza/{name}-{uuid.uuid4().hex}"
        self._n = 0
        self._at: dict[int, tuple[DataFrame, str]] = {}
        _live.append(self)
        atexit.register(self.close)

    def table(self, df: DataFrame, *old: DataFrame, files: int | None = None) -> DataFrame:
        """Writes `df`, drops the tables in `old` and returns the new table."""
        self._n += 1
        path = f"{self.root}/{self._n}"
        before = self.spark.conf.get(_CLEAN)
        self.spark.conf.set(_CLEAN, "true")
        try:
            (df.coalesce(files) if files else df).write.parquet(path)
        finally:
            self.spark.conf.set(_CLEAN, before)
        for x in old:
            self.drop(x)
        out = self.spark.read.schema(df.schema).parquet(path)
        self._at[id(out)] = out, path
        return out

    def drop(self, table: DataFrame) -> None:
        if held := self._at.pop(id(table), None):
            remove(self.spark, held[1])

    def close(self) -> None:
        with contextlib.suppress(Exception):  # the session may have ended already
            remove(self.spark, self.root)
