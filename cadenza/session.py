"""Session helpers: shipping the package to executors, the settings that bound Arrow batches, the shared folder."""

from __future__ import annotations

import atexit
import os
import tempfile
import uuid
import zipfile
from pathlib import Path

from pyspark.sql import SparkSession

_shipped: set[str] = set()
_BOUNDED = "spark.cadenza.bounded"


def prepare(spark: SparkSession) -> SparkSession:
    """Make the package importable in Python workers and bound Arrow batches, once a session.

    The package goes out once per application with ``addPyFile``, the way ``--py-files`` does, so
    executors need no installed copy. An Arrow batch has at most 1000 rows and 16 MB, or one row."""
    sc = spark.sparkContext
    if sc.applicationId not in _shipped:
        root = Path(__file__).resolve().parent
        fd, target = tempfile.mkstemp(prefix="cadenza-", suffix=".zip")
        os.close(fd)
        atexit.register(Path(target).unlink, missing_ok=True)
        with zipfile.ZipFile(target, "w", zipfile.ZIP_DEFLATED) as z:
            for p in sorted(root.rglob("*.py")):
                z.write(p, f"{root.name}/{p.relative_to(root)}")
        sc.addPyFile(target)
        _shipped.add(sc.applicationId)
    if spark.conf.get(_BOUNDED, None) is None:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", 1000)
        spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", 16 << 20)
        spark.conf.set(_BOUNDED, "true")
    return spark


def shared_folder(spark: SparkSession) -> str:
    """The cluster's shared folder; an own one only in local mode where none is named."""
    conf = spark.sparkContext.getConf()
    named = conf.get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named.rstrip("/")
    if not conf.get("spark.master", "").startswith("local"):
        raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
    spark.conf.set("spark.checkpoint.dir", own := f"file:///tmp/checkpoints/{uuid.uuid4().hex}")
    return own
