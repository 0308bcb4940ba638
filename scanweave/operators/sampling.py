"""Sampling, splits, folds and shuffles driven by hashes of row ids."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window, functions as F

from scanweave.functions.exprs import col, hash_order
from scanweave.operators.quantiles import values_at
from scanweave.operators.timeline import row_position


def hash_rank(df: DataFrame, keys: list[str], seed: str, row_id: str, name: str = "rn", total: str = "n",
              digits: int = 3) -> DataFrame:
    """Position of each row in its key's pseudo-random order.

    The leading hex digits of the hash are the chunks of the two-level rank, so
    a hot key is cut in 16 ** digits even parts.
    """
    d = df.withColumn("_h", hash_order(seed, row_id))
    d = row_position(d, keys, ["_h", row_id], F.conv(F.substring("_h", 1, digits), 16, 10).cast("long"), name, total)
    return d.drop("_h")


def sample_exact(df: DataFrame, keys: list[str], seed: str, row_id: str, size: int, most_keys: int = 100_000) -> DataFrame:
    """At most ``size`` rows per key without replacement: those with the smallest hashes.

    The share of rows wanted from a key tells how small a hash must be: rows
    above that mark, eight standard deviations beyond the share, never leave
    their task. About ``size`` rows a key are shuffled and ranked, at any size of
    the input. Should a mark ever leave too few rows, that is an error. Beyond
    ``most_keys`` keys, whose counts would be too many to send to every task,
    each task sends its ``size`` first rows of a key instead.
    """
    d = df.withColumn("_h", hash_order(seed, row_id))
    counts = df.groupBy(*keys).agg(F.count("*").alias("_n"))
    few = counts.limit(most_keys + 1).count() <= most_keys
    rank = F.row_number().over(Window.partitionBy(*keys).orderBy("_h", row_id))
    if not few:
        return d.withColumn("_rn", rank).filter(F.col("_rn") <= size).select(*df.columns)
    if keys:
        on = [F.col(k).eqNullSafe(F.col(f"_k{i}")) for i, k in enumerate(keys)]
        named = F.broadcast(counts.select(*[F.col(k).alias(f"_k{i}") for i, k in enumerate(keys)], "_n"))
        d = d.join(named, on)
    else:
        d = d.withColumn("_n", counts.select("_n").scalar())
    mark = (size + 8 * math.sqrt(size) + 16) / F.col("_n")
    unit = F.conv(F.substring("_h", 1, 12), 16, 10).cast("double") / float(16 ** 12)
    d = d.filter(unit < mark)
    enough = F.count("*").over(Window.partitionBy(*keys)) >= F.least(F.lit(size), F.col("_n"))
    d = d.withColumn("_rn", F.when(enough, rank).otherwise(F.raise_error(F.lit("a hash mark left too few rows")).cast("int")))
    return d.filter(F.col("_rn") <= size).select(*df.columns)


def evenly_spaced(df: DataFrame, keys: list[str], order: list[str], chunk: str | Column, size: int) -> DataFrame:
    """``size`` rows per key at evenly spaced positions from the first to the last."""
    d = row_position(df, keys, order, chunk)
    step = (F.col("n") - 1) / (size - 1)
    near = F.floor((F.col("rn") - 1) / F.when(step > 0, step))
    hit = F.exists(F.array(near, near + 1), lambda i: (i < size) & (F.floor(i * (F.col("n") - 1) / (size - 1)) == F.col("rn") - 1))
    return d.filter((F.col("n") <= size) | hit).drop("rn", "n")


def tail_split(df: DataFrame, keys: list[str], order: list[str], chunk: str | Column, val_frac: float) -> DataFrame:
    """'train' / 'val' by time: the last share of each key, at least one row on each side."""
    d = row_position(df, keys, order, chunk)
    n_val = F.greatest(F.lit(1), F.least(F.col("n") - 1, F.bround(F.col("n") * val_frac).cast("long")))
    return d.withColumn("split", F.when(F.col("rn") > F.col("n") - n_val, "val").otherwise("train")).drop("rn", "n")


def three_way_split(df: DataFrame, keys: list[str], order: list[str], chunk: str | Column,
                    train: float = 0.70, val: float = 0.15) -> DataFrame:
    d = row_position(df, keys, order, chunk)
    a = F.bround(F.col("n") * train).cast("long")
    b = a + F.bround(F.col("n") * val).cast("long")
    return d.withColumn("split", F.when(F.col("rn") <= a, "train").when(F.col("rn") <= b, "val").otherwise("test")).drop("rn", "n")


def decimate(df: DataFrame, keys: list[str], order: list[str], chunk: str | Column, k: int | Column) -> DataFrame:
    """Every k-th row of each key, starting with the first."""
    k = F.lit(k) if isinstance(k, int) else k
    return row_position(df, keys, order, chunk).filter((F.col("rn") - 1) % k == 0).drop("rn", "n")


def group_out_folds(df: DataFrame, folds: DataFrame, group: str, us: str, row_id: str, chunk: str | Column,
                    val_frac: float = 0.10) -> DataFrame:
    """One frame of (fold, split) for leave-one-group-out evaluation.

    ``folds`` has (fold, group, role in train/test, keep_every); a training
    group is thinned first where keep_every > 1, then cut by time. The rows of a
    group are numbered once: which of them a fold keeps, and where its tail
    begins, follows from number and count.
    """
    d = row_position(df, [group], [us, row_id], chunk, "_rn", "_n").join(folds, group)
    every = F.col("keep_every")
    rn, n = F.floor((F.col("_rn") - 1) / every) + 1, F.ceil(F.col("_n") / every)
    n_val = F.greatest(F.lit(1), F.least(n - 1, F.bround(n * val_frac).cast("long")))
    test = F.col("role") == "test"
    split = F.when(test, "test").when(rn > n - n_val, "val").otherwise("train")
    return d.filter(test | ((F.col("_rn") - 1) % every == 0)).withColumn("split", split).drop("role", "keep_every", "_rn", "_n")


def random_validation(df: DataFrame, keys: list[str], seed: str, row_id: str, val_frac: float = 0.10) -> DataFrame:
    """'train' / 'val' by hash order, at least one validation row per key."""
    d = hash_rank(df, keys, seed, row_id)
    n_val = F.greatest(F.lit(1), F.bround(F.col("n") * val_frac).cast("long"))
    return d.withColumn("split", F.when(F.col("rn") <= n_val, "val").otherwise("train")).drop("rn", "n")


def region_out_folds(df: DataFrame, region: str, labels: list[int], row_id: str, seed: str,
                     val_frac: float = 0.10) -> DataFrame:
    """One frame of (fold, split): each region is held out once, validation is random.

    Every fold uses every row, so the result is one copy of the rows per label.
    """
    d = df.withColumn("_r", F.explode(F.array(*[F.lit(r) for r in labels])))
    d = d.withColumn("fold", F.concat(F.lit("R-"), F.col("_r").cast("string")))
    test = d.filter(F.col(region) == F.col("_r")).withColumn("split", F.lit("test"))
    pool = d.filter(F.col(region) != F.col("_r")).withColumn("_id", F.concat_ws("|", "fold", F.col(row_id).cast("string")))
    pool = random_validation(pool, ["fold"], seed, "_id", val_frac).drop("_id")
    return test.unionByName(pool).drop("_r")


def block_shuffle(df: DataFrame, keys: list[str], seed: str, row_id: str, block: list[str]) -> DataFrame:
    """Move a whole column block by one random permutation per key.

    A row's block comes from the row whose hash rank equals its own rank in id
    order. Both ranks are two-level, and the swap is an equality join on
    (key, rank).
    """
    ranked = row_position(df, keys, [row_id], F.floor(F.col(row_id) / 100_000), "_rn", "_n").drop("_n")
    donors = hash_rank(df.select(*keys, row_id, *block), keys, seed, row_id, "_rn", "_n").drop("_n", row_id)
    return ranked.drop(*block).join(donors, [*keys, "_rn"]).drop("_rn").select(*df.columns)


def equal_chunks(df: DataFrame, along: str, row_id: str, parts: int, rows_each: int | None = None) -> DataFrame:
    """Labels 1..parts of equal size along a value, ties by id; the first parts take the remainder.

    Only the last row of each part is looked for, first its value, then its id among the rows of that value; a row's
    label is the number of these it comes after. The rows themselves are read a few times and never move.
    A null or NaN stands with the infinity at its end of the order. ``rows_each`` bounds the values ranked at once.
    """
    v = F.coalesce(F.col(along).cast("double"), F.lit(float("-inf")))
    v = F.when(F.isnan(v), F.lit(float("inf"))).otherwise(v)
    i = F.coalesce(F.col(row_id).cast("long"), F.lit(-(1 << 63)))
    n, most = df.count(), rows_each or 100_000
    ends = [k * (n // parts) + min(k, n % parts) for k in range(1, parts)]
    wanted = [(0, r) for r in ends if 0 < r < n]
    if not wanted:
        return df.withColumn("part", (F.lit(1) + sum(r == 0 for r in ends)).cast("int"))
    at = values_at(df.select(F.lit(0).alias("_g"), v.alias("_v")), wanted, most)
    tied = sorted({x for x, _ in at})
    group = F.coalesce(*[F.when(v == x, F.lit(k)) for k, x in enumerate(tied)])
    rest = [(tied.index(x), r - below) for (x, below), (_, r) in zip(at, wanted)]
    ids = values_at(df.select(group.alias("_g"), i.alias("_v")).filter("_g IS NOT NULL"), rest, most)
    after = [(v > x) | ((v == x) & (i > last)) for (x, _), (last, _) in zip(at, ids)]
    return df.withColumn("part", sum((a.cast("int") for a in after), F.lit(1 + sum(r == 0 for r in ends))).cast("int"))


def principal_axis(df: DataFrame, x: str = "x_m", y: str = "y_m") -> tuple[Column, tuple]:
    """Projection on the first principal axis (x component not negative) and its parameters.

    One aggregate; four numbers reach the driver.
    """
    a = 0.5 * F.atan2(2 * F.col("cxy"), F.col("cxx") - F.col("cyy"))
    m = df.agg(F.avg(x).alias("mx"), F.avg(y).alias("my"), F.covar_pop(x, x).alias("cxx"),
               F.covar_pop(y, y).alias("cyy"), F.covar_pop(x, y).alias("cxy")).select("mx", "my", F.cos(a).alias("ux"), F.sin(a).alias("uy")).first()
    return (F.col(x) - m.mx) * m.ux + (F.col(y) - m.my) * m.uy, (m.mx, m.my, m.ux, m.uy)


def farthest_first(cells: DataFrame, n: int) -> DataFrame:
    """Greedy spread-out choice of ``n`` cells; each step is one distributed argmax.

    Only the chosen cell itself comes to the driver.
    """
    start = cells.orderBy(F.desc(F.abs("cx") + F.abs("cy")), "cx", "cy").limit(1).first()
    chosen = [start]
    while start is not None and len(chosen) < n:
        gap = F.least(*[F.hypot(F.col("cx") - c.cx, F.col("cy") - c.cy) for c in chosen], F.lit(1e18))
        nxt = cells.withColumn("_g", gap).filter("_g > 0").orderBy(F.desc("_g"), "cx", "cy").limit(1).first()
        if nxt is None:
            break
        chosen.append(nxt)
    rows = [(i + 1, int(c.cx), int(c.cy)) for i, c in enumerate(chosen) if c is not None]
    return cells.sparkSession.createDataFrame(rows, "step int, cx long, cy long")
