"""Spatial cells: aggregates, overlap, variogram, radius and centroid joins."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, functions as F

from scanweave.functions.exprs import cell
from scanweave.operators.timeline import ordered_pairs


def with_cells(df: DataFrame, width: float, x: str = "x_m", y: str = "y_m") -> DataFrame:
    return df.withColumn("cx", cell(x, width)).withColumn("cy", cell(y, width))


def cell_stats(df: DataFrame, keys: list[str], value: str, width: float) -> DataFrame:
    return (with_cells(df, width).groupBy(*keys, "cx", "cy")
            .agg(F.avg(value).alias("mean"), F.count(value).alias("n"), F.stddev_samp(value).alias("sd")))


def cell_overlap(df: DataFrame, group: str, width: float) -> DataFrame:
    """Distinct-cell counts, IoU and containment for each pair of groups a < b."""
    cells = with_cells(df, width).select(group, "cx", "cy").distinct()
    size = cells.groupBy(group).agg(F.count("*").alias("n"))
    a, b = cells.withColumnRenamed(group, "a"), cells.withColumnRenamed(group, "b")
    both = a.join(b, ["cx", "cy"]).filter("a < b").groupBy("a", "b").agg(F.count("*").alias("shared"))
    pairs = (ordered_pairs(size, group).withColumnsRenamed({f"{group}_a": "a", f"{group}_b": "b"})
             .join(both, ["a", "b"], "left").withColumn("shared", F.coalesce("shared", F.lit(0))))
    union = F.col("n_a") + F.col("n_b") - F.col("shared")
    return pairs.select("a", "b", "n_a", "n_b", "shared", union.alias("n_union"),
                        (F.col("n_a") - F.col("shared")).alias("only_a"), (F.col("n_b") - F.col("shared")).alias("only_b"),
                        (F.col("shared") / union).alias("iou"), (100 * F.col("shared") / F.col("n_a")).alias("pct_a_in_b"),
                        (100 * F.col("shared") / F.col("n_b")).alias("pct_b_in_a"))


def semivariogram(df: DataFrame, keys: list[str], value: str, lags: list[float], band: float = 0.25,
                  min_pairs: int = 30) -> DataFrame:
    """Half the mean squared difference per distance band; bands may overlap.

    Rows are first folded to (n, sum, sum of squares) per exact position, which
    is all a pair of positions needs. Positions meet only in neighbouring grid
    cells as wide as the longest band, each unordered pair once.
    """
    reach = max(lags) * (1 + band)
    p = (df.filter(F.col(value).isNotNull()).groupBy(*keys, "x_m", "y_m")
         .agg(F.count("*").alias("n"), F.sum(value).alias("s"), F.sum(F.col(value) * F.col(value)).alias("q")))
    p = with_cells(p, reach)
    step = F.array(*[F.struct(F.lit(i).alias("i"), F.lit(j).alias("j")) for i in (-1, 0, 1) for j in (-1, 0, 1)])
    near = p.withColumn("_o", F.explode(step)).select(
        *keys, (F.col("cx") + F.col("_o.i")).alias("cx"), (F.col("cy") + F.col("_o.j")).alias("cy"),
        F.col("x_m").alias("x2"), F.col("y_m").alias("y2"), F.col("n").alias("n2"), F.col("s").alias("s2"), F.col("q").alias("q2"))
    pairs = p.join(near, [*keys, "cx", "cy"]).filter("x_m < x2 OR (x_m = x2 AND y_m < y2)")
    d = F.hypot(F.col("x_m") - F.col("x2"), F.col("y_m") - F.col("y2"))
    pairs = pairs.withColumn("_d", d).withColumn("_w", F.col("n") * F.col("n2")).withColumn(
        "_q", F.col("n2") * F.col("q") + F.col("n") * F.col("q2") - 2 * F.col("s") * F.col("s2"))
    sums = []
    for i, h in enumerate(lags):
        hit = (F.col("_d") >= h - band * h) & (F.col("_d") <= h + band * h)
        sums += [F.sum(F.when(hit, F.col("_w"))).alias(f"_w{i}"), F.sum(F.when(hit, F.col("_q"))).alias(f"_q{i}")]
    out = pairs.groupBy(*keys).agg(*sums).select(*keys, F.inline(F.array(*[
        F.struct(F.lit(float(h)).alias("lag"), F.col(f"_w{i}").alias("n_pairs"), F.col(f"_q{i}").alias("_q"))
        for i, h in enumerate(lags)]))).filter("n_pairs IS NOT NULL")
    return out.select(*keys, "lag", "n_pairs", F.when(
        F.col("n_pairs") >= min_pairs, F.col("_q") / F.col("n_pairs") / 2).alias("gamma"))


def variogram_range(gamma: DataFrame, keys: list[str], share: float = 0.95) -> DataFrame:
    """Highest gamma and the first lag that reaches ``share`` of it."""
    top = gamma.groupBy(*keys).agg(F.max("gamma").alias("gamma_max"))
    return (gamma.join(top, keys).groupBy(*keys).agg(
        F.first("gamma_max").alias("gamma_max"),
        F.min(F.when(F.col("gamma") >= share * F.col("gamma_max"), F.col("lag"))).alias("range_m")))


def outside_radius(rows: DataFrame, held_out: DataFrame, on: list[str], radius: float) -> DataFrame:
    """Rows further than ``radius`` from every held-out point of the same ``on``.

    Cells are radius / sqrt(2) wide, so a row that shares its cell with a
    held-out point is inside at once (plain anti join). The rest meets the
    distinct held-out points of the surrounding cells in an anti join that stops
    at the first hit and emits no pairs.
    """
    width = radius / math.sqrt(2)
    pts = with_cells(held_out.select(*on, "x_m", "y_m").distinct(), width)
    d = with_cells(rows, width).join(pts.select(*on, "cx", "cy").distinct(), [*on, "cx", "cy"], "left_anti")
    step = F.array(*[F.struct(F.lit(i).alias("i"), F.lit(j).alias("j"))
                     for i in range(-2, 3) for j in range(-2, 3) if (i, j) != (0, 0)])
    near = pts.withColumn("_o", F.explode(step)).select(
        *[F.col(k).alias(f"_{k}") for k in on], (F.col("cx") + F.col("_o.i")).alias("_cx"),
        (F.col("cy") + F.col("_o.j")).alias("_cy"), F.col("x_m").alias("_x"), F.col("y_m").alias("_y"))
    cond = (F.col("cx") == F.col("_cx")) & (F.col("cy") == F.col("_cy"))
    for k in on:
        cond &= F.col(k) == F.col(f"_{k}")
    dx, dy = F.col("x_m") - F.col("_x"), F.col("y_m") - F.col("_y")
    return d.join(near, cond & (dx * dx + dy * dy <= radius * radius), "left_anti").drop("cx", "cy")


def nearest_of(points: list[tuple[int, float, float]], x: str = "x_m", y: str = "y_m") -> Column:
    """Label of the nearest of a short list of centroids; ties go to the first."""
    x, y = F.col(x), F.col(y)
    return F.array_min(F.array(*[F.struct(((x - px) * (x - px) + (y - py) * (y - py)).alias("d"),
                                          F.lit(i).alias("o"), F.lit(lab).alias("label"))
                                 for i, (lab, px, py) in enumerate(points)])).getField("label")
