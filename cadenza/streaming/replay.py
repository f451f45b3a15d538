"""A table run through a streaming stage as a stream of micro-batches, for backfills and comparisons."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..model import TRACK
from ..session import prepare, shared_folder


def replay(rows: DataFrame, stage: Callable[[DataFrame], DataFrame], order: str, batches: int = 4, by: tuple[str, ...] = TRACK) -> DataFrame:
    """What `stage` makes of the streams in `rows`, fed in order in micro-batches.

    Every stream is cut into `batches` parts of consecutive rows, part after part, and its last row gets
    `is_last`. Input, checkpoint and output lie in the shared folder."""
    spark = prepare(rows.sparkSession)
    root = f"{shared_folder(spark)}/cadenza/replay-{uuid.uuid4().hex}"
    whole = Window.partitionBy(*by)
    place = F.row_number().over(whole.orderBy(order)) - 1
    cut = rows.withColumns({"_part": F.floor(place * batches / F.count("*").over(whole)).cast("int"), "is_last": F.lead(order).over(whole.orderBy(order)).isNull()})
    schema = cut.drop("_part").schema
    cut.write.partitionBy("_part").parquet(f"{root}/in")
    kept = f"{root}/out"
    for part in range(batches):  # one micro-batch each: the checkpoint keeps the state in between
        spark.read.schema(schema).parquet(f"{root}/in/_part={part}").write.mode("append").parquet(f"{root}/feed")
        stream = spark.readStream.schema(schema).parquet(f"{root}/feed")
        stage(stream).writeStream.format("parquet").option("path", kept).option("checkpointLocation", f"{root}/state").outputMode("append").trigger(availableNow=True).start().awaitTermination()
    return spark.read.parquet(kept)
