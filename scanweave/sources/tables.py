"""Table sinks, documents, digests, snapshots and routing."""

from __future__ import annotations

import re
import uuid
from concurrent.futures import ThreadPoolExecutor

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.types import StructType

from scanweave.functions.sha256 import Sha256
from scanweave.session import ensure_checkpoint_dir, ship


def scratch_path(spark: SparkSession, name: str) -> str:
    """A fresh folder below the shared checkpoint folder."""
    return f"{ensure_checkpoint_dir(spark)}/{name}-{uuid.uuid4().hex}"


def read_columns(spark: SparkSession, path: str, columns: list[str]) -> DataFrame:
    return spark.read.parquet(path).select(*columns)


def write_table(df: DataFrame, path: str, schema: StructType, order: list[str], partition_by: list[str] | None = None) -> None:
    """Parquet with exactly the schema's columns, order and types, range-sorted on ``order``."""
    missing = [f.name for f in schema if f.name not in df.columns]
    if missing:
        raise ValueError(f"missing columns {missing}")
    d = df.select(*[F.col(f.name).cast(f.dataType).alias(f.name) for f in schema]).orderBy(*order)
    w = d.write.mode("overwrite").option("compression", "zstd")
    (w.partitionBy(*partition_by) if partition_by else w).parquet(path)


def write_report_csv(df: DataFrame, path: str) -> None:
    """A report table of a few rows as one file with header."""
    df.coalesce(1).write.mode("overwrite").option("header", True).csv(path)


def write_documents(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").json(path)


def read_documents(spark: SparkSession, path: str, schema: StructType, multi_line: bool = False) -> DataFrame:
    return spark.read.schema(schema).json(path, multiLine=multi_line)


def row_digest(columns: list[str]):
    return F.md5(F.concat_ws("␟", *[F.coalesce(F.col(c).cast("string"), F.lit("␀")) for c in columns]))


def table_digest(df: DataFrame, keys: list[str], columns: list[str]) -> DataFrame:
    """Digest that ignores row order: rows and the sum of 32-bit row hashes."""
    h = F.conv(F.substring(row_digest(columns), 1, 8), 16, 10).cast("long")
    return df.groupBy(*keys).agg(F.count("*").alias("n_rows"), F.sum(h).alias("digest"))


def file_digests(spark: SparkSession, path: str, block: int = 128 << 20, at_once: int = 8) -> DataFrame:
    """SHA-256 of each file, whatever its length; a task reads about ``block`` bytes, to the next line feed at most.

    Files up to ``block`` bytes are digested where they are read. Longer ones are read in splits of that length. As
    SHA-256 runs through a file in order, its splits are taken one after the other, each by a task that goes on from the
    hash the one before left; ``at_once`` files go on side by side. Only files of names that Hadoop unpacks (``.gz`` and
    the like), which have no splits, are always read whole, as a row of 2 GB at most. An empty file has no row.
    """
    files = spark.read.format("binaryFile").load(path)
    columns = [F.element_at(F.split("path", "/"), -1).alias("file"), "length", F.sha2("content", 256).alias("sha256")]
    out = files.filter(F.col("length") <= block).select(*columns)
    long = files.filter(F.col("length") > block).select("path", "length").collect()
    packed = [_literal(r.path) for r in long if r.path.endswith(_UNPACKED)]
    if packed:
        out = out.unionByName(spark.read.format("binaryFile").load(packed).filter(F.col("length") > block).select(*columns))
    split = [r for r in long if not r.path.endswith(_UNPACKED)]
    if split:
        ship(spark)
        reader = spark.newSession()  # the length of splits is a setting of the session
        reader.conf.set("spark.sql.files.maxPartitionBytes", block)
        reader.conf.set("spark.sql.files.minPartitionNum", 1)
        with ThreadPoolExecutor(at_once) as pool:
            found = list(pool.map(lambda r: (r.path.split("/")[-1], r.length, _digest_by_splits(reader, r.path, r.length, block)), split))
        out = out.unionByName(spark.createDataFrame(found, "file string, length long, sha256 string"))
    return out


_UNPACKED = (".gz", ".bz2", ".deflate", ".lz4", ".snappy", ".zst")
_BOM = b"\xef\xbb\xbf"


def _literal(path: str) -> str:
    """The path with the signs of a pattern taken as they are."""
    return re.sub(r"([\\\[\]{}*?])", r"\\\1", path)


def _digest_by_splits(spark: SparkSession, path: str, length: int, block: int, head: bytes = b"") -> str:
    """Reads the file's bytes as lines, which the text source passes on unchanged, and hashes them split by split.

    What it leaves out is put back: the line feeds between lines, one at the end, and a byte order mark (``head``). The
    bytes are counted against the file's length.
    """
    lines = spark.read.option("lineSep", "\n").text(_literal(path)).select(F.col("value").cast("binary"), "_metadata.file_block_start")
    h = Sha256()
    h.update(head)
    state, n, begun = h.state, len(head), False
    for k in range(-(-length // block)):
        step = lines.mapInArrow(_hash_lines(state, n, begun), "state binary, n long, begun boolean, start long").rdd
        [r] = spark.sparkContext.runJob(step, lambda rows: rows, [k])
        if r.start not in (None, k * block):
            raise ValueError(f"{path}: split {k} starts at {r.start}")
        state, n, begun = bytes(r.state), r.n, r.begun
    h = Sha256(state)
    if length - n in (len(_BOM), len(_BOM) + 1) and not head:
        return _digest_by_splits(spark, path, length, block, _BOM)
    if length - n == 1:
        h.update(b"\n")
    elif length != n:
        raise ValueError(f"{path}: {n} of {length} bytes read")
    return h.hexdigest()


def _hash_lines(state: bytes, n: int, begun: bool):
    """The hash after the lines of one split, from the hash before them."""
    def run(batches):
        h, total, any_before, start = Sha256(state), n, begun, None
        for b in batches:
            if not b.num_rows:
                continue
            start = b.column(1)[0].as_py() if start is None else start
            if any_before:
                h.update(b"\n")
            joined = pc.binary_join(pa.ListArray.from_arrays(pa.array([0, b.num_rows], pa.int32()), b.column(0)), b"\n")[0].as_buffer()
            h.update_at(joined.address, joined.size)
            total += any_before + joined.size
            any_before = True
        yield pa.RecordBatch.from_arrays([pa.array([h.state], pa.binary()), pa.array([total], pa.int64()), pa.array([any_before]), pa.array([start], pa.int64())],
                                         names=["state", "n", "begun", "start"])
    return run


def snapshot_diff(old: DataFrame, new: DataFrame, key: str, digest: str) -> DataFrame:
    """Each key with added, removed, modified or same."""
    j = old.select(key, F.col(digest).alias("_o")).join(new.select(key, F.col(digest).alias("_n")), key, "full")
    state = (F.when(F.col("_o").isNull(), "added").when(F.col("_n").isNull(), "removed")
             .when(F.col("_o") != F.col("_n"), "modified").otherwise("same"))
    return j.select(key, state.alias("state"))


def consolidate(parts: dict[str, DataFrame], version: str) -> DataFrame:
    """Union of inventories with differing columns, tagged with source group and version."""
    out = None
    for group, d in parts.items():
        d = d.withColumns({"source_group": F.lit(group), "version": F.lit(version)})
        out = d if out is None else out.unionByName(d, allowMissingColumns=True)
    return out


def route(df: DataFrame, column: str, routes: dict[str, list[str]]) -> dict[str, DataFrame]:
    """One frame per route; a category no route names is an error."""
    known = [v for values in routes.values() for v in values]
    extra = df.filter(~F.col(column).isin(known) | F.col(column).isNull()).select(column).distinct().limit(5).collect()
    if extra:
        raise ValueError(f"unexpected categories {[r[0] for r in extra]}")
    return {name: df.filter(F.col(column).isin(values)) for name, values in routes.items()}
