"""Regression ablations on MLlib, additive attributions and region building."""

from __future__ import annotations

from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass
from functools import reduce
from math import factorial

import numpy as np
import pandas as pd
from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.regression import GBTRegressor, RandomForestRegressor
from pyspark.sql import DataFrame, SparkSession, functions as F

from scanweave.operators.cells import nearest_of
from scanweave.operators.sampling import equal_chunks, principal_axis
from scanweave.session import stored

MISSING = -1.0e6  # below every real value, so a split can send missing rows one way


@dataclass(frozen=True)
class Settings:
    """Learner settings; the defaults are the full-size run."""

    depth: int = 6
    step: float = 0.05
    rounds: int = 2000
    row_share: float = 0.8
    tolerance: float = 0.01
    seed: int = 42


def prepare(df: DataFrame, features: list[str], target: str) -> DataFrame:
    """Numeric feature columns without nulls, rows without target removed."""
    return df.filter(F.col(target).isNotNull()).withColumns(
        {f"_f_{c}": F.coalesce(F.col(c).cast("double"), F.lit(MISSING)) for c in features})


def _fit(df: DataFrame, features: list[str], learner) -> PipelineModel:
    return Pipeline(stages=[VectorAssembler(inputCols=[f"_f_{c}" for c in features], outputCol="_x"), learner]).fit(df)


def fit_booster(rows: DataFrame, features: list[str], target: str, s: Settings) -> PipelineModel:
    """Boosted trees on the 'train' rows, stopped early on the 'val' rows of ``split``."""
    d = prepare(rows.filter("split IN ('train', 'val')"), features, target).withColumn("_val", F.col("split") == "val")
    return _fit(d, features, GBTRegressor(featuresCol="_x", labelCol=target, predictionCol="p", maxDepth=s.depth, stepSize=s.step,
                                          maxIter=s.rounds, subsamplingRate=s.row_share, seed=s.seed,
                                          validationIndicatorCol="_val", validationTol=s.tolerance))


def fit_forest(rows: DataFrame, features: list[str], target: str, s: Settings) -> PipelineModel:
    """Independent second learner for cross-checks."""
    d = prepare(rows.filter("split = 'train'"), features, target)
    return _fit(d, features, RandomForestRegressor(featuresCol="_x", labelCol=target, predictionCol="p", maxDepth=s.depth,
                                                   numTrees=s.rounds, subsamplingRate=s.row_share, seed=s.seed))


def score(model: PipelineModel, rows: DataFrame, features: list[str], target: str, keep: list[str]) -> DataFrame:
    """Prediction table: provenance, truth, prediction and residual."""
    d = model.transform(prepare(rows, features, target))
    return d.select(*keep, F.col(target).alias("y"), "p", (F.col(target) - F.col("p")).alias("residual"))


def fit_points(points: list[tuple[dict[str, str], DataFrame, list[str], Settings]], target: str, keep: list[str], at_once: int = 4) -> DataFrame:
    """Predictions of the 'test' rows by a fit of each point (labels, rows, features, settings) as one table.

    The fits are distributed; ``at_once`` of them share the cluster, and as one ends the next begins. Rows are read
    several times, so they should be stored.
    """
    def fitted(point):
        labels, rows, features, s = point
        m = fit_booster(rows, features, target, s)
        return score(m, rows.filter("split = 'test'"), features, target, keep).withColumns({k: F.lit(v) for k, v in labels.items()})

    with ThreadPoolExecutor(at_once) as pool:
        return reduce(DataFrame.unionByName, pool.map(fitted, points))


def ablation(folds: DataFrame, fold_names: list[str], variants: dict[str, list[str]], target: str, keep: list[str],
             configs: dict[str, Settings], at_once: int = 4) -> DataFrame:
    """Predictions of every fold x variant x setting as one table.

    The grid is a list of distributed fits, ``at_once`` of which share the
    cluster; rows never leave the executors and metrics are one aggregate over
    the result.
    """
    return fit_points([({"fold": f, "variant": v, "config": c}, folds.filter(F.col("fold") == f), variants[v], configs[c])
                       for f in fold_names for v in variants for c in configs], target, keep, at_once)


def fit_inventory(predictions: DataFrame) -> DataFrame:
    return predictions.groupBy("fold", "variant", "config").agg(F.count("*").alias("n_test"))


def missing_fits(wanted: DataFrame, predictions: DataFrame) -> DataFrame:
    """Grid points without stored predictions."""
    return wanted.join(fit_inventory(predictions), ["fold", "variant", "config"], "left_anti")


# ---- additive attributions ----------------------------------------------
def _leaves(node, weight, path, out):
    """(value, {feature: (low, high, cover share)}) for every leaf below ``node``."""
    if not hasattr(node, "leftChild"):
        raise TypeError("node")
    split, count = node.split(), float(node.impurityStats().count())
    for child, lo, hi in ((node.leftChild(), -np.inf, split.threshold()), (node.rightChild(), split.threshold(), np.inf)):
        f = split.featureIndex()
        a, b, z = path.get(f, (-np.inf, np.inf, 1.0))
        share = float(child.impurityStats().count()) / count if count else 0.0
        step = {**path, f: (max(a, lo), min(b, hi), z * share)}
        if child.subtreeDepth() == 0:
            out.append((weight * child.prediction(), step))
        else:
            _leaves(child, weight, step, out)


def _shapley_table(value: float, shares: list[float]) -> np.ndarray:
    """Shapley values of one leaf for each of the 2^d patterns of satisfied features.

    A coalition's worth is the leaf value times 0/1 for known features and the
    training share for unknown ones.
    """
    d = len(shares)
    table = np.zeros((2 ** d, d))
    worth = lambda known, pattern: value * np.prod(
        [(1.0 if pattern >> i & 1 else 0.0) if known >> i & 1 else shares[i] for i in range(d)])
    for pattern in range(2 ** d):
        for j in range(d):
            for known in range(2 ** d):
                if not known >> j & 1:
                    s = bin(known).count("1")
                    w = factorial(s) * factorial(d - s - 1) / factorial(d)
                    table[pattern, j] += w * (worth(known | 1 << j, pattern) - worth(known, pattern))
    return table


def tree_leaves(model: PipelineModel) -> tuple[float, list]:
    """Expected value and leaf tables of a fitted booster, small enough to broadcast."""
    booster = model.stages[-1]._java_obj
    leaves = []
    for tree, weight in zip(booster.trees(), booster.treeWeights()):
        root = tree.rootNode()
        if root.subtreeDepth() == 0:
            leaves.append((weight * root.prediction(), {}))
        else:
            _leaves(root, weight, {}, leaves)
    base = sum(v * float(np.prod([z for _, _, z in p.values()])) for v, p in leaves)
    packed = [([(f, lo, hi) for f, (lo, hi, _) in p.items()], _shapley_table(v, [z for _, _, z in p.values()]))
              for v, p in leaves if p]
    return base, packed


def contributions(model: PipelineModel, rows: DataFrame, features: list[str], target: str, keep: list[str]) -> DataFrame:
    """Per-row contributions (one column ``c_<feature>`` each), bias and prediction.

    Scoring is spread over the executors; a batch is vectorised leaf by leaf.
    """
    base, packed = tree_leaves(model)
    shared = rows.sparkSession.sparkContext.broadcast((base, packed))
    d = model.transform(prepare(rows, features, target)).select(*keep, "p", *[f"_f_{c}" for c in features])
    names = [f"c_{c}" for c in features]

    def run(batches):
        bias, leaves = shared.value
        for b in batches:
            x = b[[f"_f_{c}" for c in features]].to_numpy()
            phi = np.zeros((len(b), len(features)))
            for conds, table in leaves:
                pattern = np.zeros(len(b), dtype=np.int64)
                for i, (f, lo, hi) in enumerate(conds):
                    pattern |= ((x[:, f] > lo) & (x[:, f] <= hi)).astype(np.int64) << i
                phi[:, [f for f, _, _ in conds]] += table[pattern]
            out = b[[*keep, "p"]].reset_index(drop=True)
            out["bias"] = bias
            yield pd.concat([out, pd.DataFrame(phi, columns=names)], axis=1)

    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in d.select(*keep, "p").schema)
    return d.mapInPandas(run, f"{fields}, bias double, " + ", ".join(f"`{n}` double" for n in names))


def long_contributions(wide: DataFrame, features: list[str], keep: list[str]) -> DataFrame:
    return wide.select(*keep, "p", "bias", F.inline(F.array(*[
        F.struct(F.lit(f).alias("feature"), F.col(f"c_{f}").alias("contribution")) for f in features])))


# ---- regions ------------------------------------------------------------
def grid_position(c: str, step: float):
    """Whole number of grid steps nearest to a position, halves upwards; null if it is null, NaN or infinite."""
    v = F.col(c).cast("double")
    return F.when(F.abs(v) < float("inf"), F.floor(v * round(1 / step) + 0.5))


def lloyd_round(positions: DataFrame, starts: dict[int, np.ndarray]) -> dict[int, tuple[int, np.ndarray]]:
    """One round of k-means for each start: the cost against its centroids and the centroids that follow.

    Positions (x, y, w) are whole numbers and all sums are exact. Ties go to the centroid named first; a centroid is
    the rounded-down mean of its rows and stays where it is without any.
    """
    def tally(batches):
        total = {s: [[0] * 5 for _ in c] for s, c in starts.items()}
        for b in batches:
            x, y, w = (b[c].to_numpy() for c in ("x", "y", "w"))
            for s, centroids in starts.items():
                d = np.stack([(x - px) ** 2 + (y - py) ** 2 for px, py in centroids])
                label, d = d.argmin(axis=0), d.min(axis=0)
                for k in range(len(centroids)):
                    at = label == k
                    v = w[at]
                    for i, q in enumerate((1, x[at], y[at], d[at] >> 30, d[at] & (1 << 30) - 1)):
                        total[s][k][i] += int((v * q).sum())
        rows = [(s, k, *map(str, t)) for s, c in total.items() for k, t in enumerate(c)]
        yield pd.DataFrame(rows, columns=["s", "k", "n", "sx", "sy", "high", "low"])

    sums = [F.sum(F.col(c).cast("decimal(38,0)")).alias(c) for c in ("n", "sx", "sy", "high", "low")]
    found = positions.mapInPandas(tally, "s int, k int, n string, sx string, sy string, high string, low string").groupBy("s", "k").agg(*sums).collect()
    cost, after = dict.fromkeys(starts, 0), {s: c.copy() for s, c in starts.items()}
    for r in found:
        cost[r.s] += (int(r.high) << 30) + int(r.low)
        if r.n:
            after[r.s][r.k] = int(r.sx) // int(r.n), int(r.sy) // int(r.n)
    return {s: (cost[s], after[s]) for s in starts}


def kmeans_grid(df: DataFrame, k: int, seeds: list[int], x: str, y: str, rounds: int, step: float) -> list[tuple[int, int, int]]:
    """``kmeans_centroids`` in grid steps."""
    p = df.select(grid_position(x, step).alias("x"), grid_position(y, step).alias("y")).dropna()
    d = stored(p.groupBy("x", "y").agg(F.count("*").alias("w"))).persist()
    try:
        if d.filter(F.greatest(F.abs("x"), F.abs("y")) > 1_000_000_000).head(1):
            raise ValueError("positions beyond 10^9 grid steps: take a larger step")
        named = lambda s: F.md5(F.concat_ws(":", F.lit(str(s)), F.col("x").cast("string"), F.col("y").cast("string")))
        first = reduce(DataFrame.unionByName, [d.select(F.lit(s).alias("s"), named(s).alias("h"), "x", "y").orderBy("h").limit(k) for s in seeds]).collect()
        going = {s: np.array([(r.x, r.y) for r in sorted((r for r in first if r.s == s), key=lambda r: r.h)]) for s in seeds}
        ended = {}
        for _ in range(rounds if first else 0):
            moved = {}
            for s, (cost, after) in lloyd_round(d, going).items():
                ended[s] = cost, after
                if (after != going[s]).any():
                    moved[s] = after
            going = moved
            if not going:
                break
    finally:
        d.unpersist()
    best = min(ended, key=lambda s: (ended[s][0], s)) if ended else None
    return [(i, px, py) for i, (px, py) in enumerate(sorted(map(tuple, ended[best][1].tolist())), 1)] if ended else []


def kmeans_centroids(df: DataFrame, k: int, seeds: list[int], x: str = "x_m", y: str = "y_m", rounds: int = 200,
                     step: float = 1e-6) -> list[tuple[int, float, float]]:
    """Best of several k-means starts; labels 1..k ordered by centroid x, then y.

    Positions are rounded to a grid of ``step`` and folded to a weight, once for all starts; up to 10^9 steps from
    0 all is exact, so the result doesn't hang on the order of the rows. A start has the ``k`` positions with the
    smallest md5 of "seed:x:y" in grid steps, in that order, and ends when no centroid moves or after ``rounds``.
    The best has the smallest sum of squared distances in its last round, ties to the smaller seed. A round is one
    job for all starts that still move. Null, NaN and infinite positions take no part.
    """
    return [(i, px * step, py * step) for i, px, py in kmeans_grid(df, k, seeds, x, y, rounds, step)]


def build_regions(df: DataFrame, k: int, min_rows: int, row_id: str, seeds: list[int], step: float = 1e-6) -> tuple[DataFrame, str]:
    """Region per row: k-means, or equal chunks along the main axis if a region is too small.

    In k-means rows are dealt by their grid positions, ties to the smaller label; a row without a position has none.
    Fewer than ``k * min_rows`` rows can't fill the regions, and nothing is fitted.
    """
    g = df.withColumns({"_gx": grid_position("x_m", step), "_gy": grid_position("y_m", step)})
    if g.filter("_gx IS NOT NULL AND _gy IS NOT NULL").count() >= k * min_rows:
        centroids = kmeans_grid(df, k, seeds, "x_m", "y_m", 200, step)
        label = F.when(F.col("_gx").isNotNull() & F.col("_gy").isNotNull(), nearest_of(centroids, "_gx", "_gy").cast("int"))
        d = g.withColumn("region_id", label).drop("_gx", "_gy")
        smallest = d.filter("region_id IS NOT NULL").groupBy("region_id").count().agg(F.min("count"), F.count("*")).first()
        if smallest[0] >= min_rows and smallest[1] == k:
            return d, "kmeans"
    proj, _ = principal_axis(df)
    d = equal_chunks(df.withColumn("_proj", F.round(proj, 9)), "_proj", row_id, k)
    return d.withColumnRenamed("part", "region_id").drop("_proj"), "principal_axis"
