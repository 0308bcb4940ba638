"""Vector columns: which take part, classes of equal vectors, Arrow batches as matrices."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, functions as F
from pyspark.sql.window import Window


def usable(df: DataFrame, id_col: str, vec_col: str, extra: list[str] = ()) -> DataFrame:
    """(vec_id, vec, *extra) of the vectors that are not null or zero, hold finite numbers only and have the
    most frequent length (of equally frequent ones the longest). A null id takes no part."""
    v = df.select(F.col(id_col).cast("long").alias("vec_id"), F.col(vec_col).alias("vec"), *extra).where(
        F.col("vec_id").isNotNull() & F.col("vec").isNotNull()
        & F.forall("vec", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
        & F.exists("vec", lambda x: x != 0))
    size = v.groupBy(F.size("vec").alias("d")).agg(F.count(F.lit(1)).alias("n")).orderBy(F.col("n").desc(), F.col("d").desc()).first()
    return v.where(F.size("vec") == (size["d"] if size else 0))


def classes(vectors: DataFrame, keys: list[str], most: int) -> DataFrame:
    """(class_id, *keys, vec, ids): equal vectors of equal keys, their smallest id, and their ``most`` smallest ids.

    Each task passes on only a class's smallest ids, so a vector that fills the table is no hot group.
    """
    by = Window.partitionBy(*keys, "vec").orderBy("vec_id")
    few = vectors.withColumn("r", F.row_number().over(by)).where(F.col("r") <= most)
    return (few.groupBy(*keys, "vec").agg(F.sort_array(F.collect_list("vec_id")).alias("ids"))
            .select(F.col("ids")[0].alias("class_id"), *keys, "vec", "ids"))


def matrix(column) -> np.ndarray:
    """A column of equally long lists as float64 rows."""
    import pyarrow as pa
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
        if isinstance(column, pa.ChunkedArray):
            column = column.chunk(0)
    if not len(column):
        return np.zeros((0, 1))
    return np.asarray(column.flatten(), np.float64).reshape(len(column), -1)
