"""Helpers shared by the operators: shared storage, code shipping, text columns of Arrow batches."""

from __future__ import annotations

import os
import tempfile
import uuid
import zipfile

import numpy as np
from pyspark.sql import DataFrame, SparkSession, functions as F

_SHIPPED: set[str] = set()


def shared_folder(spark: SparkSession) -> str:
    """The folder of ``spark.checkpoint.dir``. Only a local master may do without the setting."""
    sc = spark.sparkContext
    folder = sc.getCheckpointDir()
    if folder:
        return folder
    configured = spark.conf.get("spark.checkpoint.dir", None)
    if not configured and not sc.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    sc.setCheckpointDir(configured or tempfile.mkdtemp(prefix="spark-", dir="/tmp"))
    return sc.getCheckpointDir()


def ship(spark: SparkSession) -> None:
    """Sends this package to the Python workers, which need not find the repository by themselves."""
    sc = spark.sparkContext
    if sc.applicationId in _SHIPPED:
        return
    package = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    target = os.path.join(tempfile.mkdtemp(), "scanweave_code.zip")
    with zipfile.ZipFile(target, "w") as z:
        for folder, _, names in os.walk(package):
            for name in names:
                if name.endswith(".py"):
                    path = os.path.join(folder, name)
                    z.write(path, os.path.relpath(path, os.path.dirname(package)))
    sc.addPyFile(target)
    _SHIPPED.add(sc.applicationId)


def stored(df: DataFrame) -> DataFrame:
    """The frame written once as Parquet into the shared folder and read from there.

    Cuts the lineage, survives lost executors and keeps column pruning; the
    folder goes when the session ends.
    """
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/stored-{uuid.uuid4().hex}"
    df.write.parquet(path)
    jvm = spark.sparkContext._jvm
    hadoop = jvm.org.apache.hadoop.fs.Path(path)
    hadoop.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).deleteOnExit(hadoop)
    return spark.read.schema(df.schema).parquet(path)


def released(spark: SparkSession) -> None:
    """Lets Spark drop shuffle files of finished steps that no frame refers to any more."""
    import gc
    import time
    for _ in range(2):
        gc.collect()
        spark.sparkContext._jvm.System.gc()
        time.sleep(0.5)


def fold(column, of: int):
    """crc32 of the id as text, modulo ``of``."""
    return F.crc32(F.coalesce(column.cast("string"), F.lit(""))) % of


def text_bytes(column) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a string column of an Arrow batch and its offsets (one more than rows), without copying.

    A null text is empty.
    """
    import pyarrow as pa
    if column.null_count:
        column = column.fill_null("" if not pa.types.is_binary(column.type) else b"")
    kind = np.int64 if pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type) else np.int32
    _, offsets, data = column.buffers()
    off = np.frombuffer(offsets, kind)[column.offset:column.offset + len(column) + 1].astype(np.int64) \
        if len(column) else np.zeros(1, np.int64)
    raw = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return raw[off[0]:off[-1]], off - off[0]


def texts(column) -> list[bytes]:
    """Whole texts as bytes; null is empty."""
    raw, off = text_bytes(column)
    whole = raw.tobytes()
    return [whole[a:b] for a, b in zip(off[:-1].tolist(), off[1:].tolist())]


def parts_for(rows: int, each: int) -> int:
    """A number of partitions that grows with the data."""
    return max(1, -(-rows // each))
