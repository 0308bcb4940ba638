"""Centroid clustering in whole numbers; a table of pivot distances rules out centroids (LAESA)."""

from __future__ import annotations

import hashlib

import numpy as np
from pyspark.sql import DataFrame, functions as F

from scanweave.llm.base import ship, stored

#: Components beyond this size are added up as Python integers, so that nothing overflows.
SMALL = 1 << 24


def whole_numbers(x: np.ndarray, scale: int) -> np.ndarray:
    """floor(scale * x), exactly: int64, or Python integers where a number is large."""
    y = np.floor(x.astype(np.float64) * scale)  # scale is a power of two, so the product is exact
    if y.size and np.abs(y).max() > SMALL:
        if not np.isfinite(y).all():
            raise ValueError("a component is too large for its whole number")
        return np.array([[int(c) for c in row] for row in y.tolist()], dtype=object)
    return y.astype(np.int64)


def squared(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Squared distances of rows, exact."""
    d = a - b
    return (d * d).sum(axis=-1)


def spread_pivots(points: np.ndarray, n: int) -> list[int]:
    """Rows of ``points``, each with the largest sum of distances to the pivots before it, beginning at row 0."""
    far, chosen = np.zeros(len(points)), [0]
    while len(chosen) < min(n, len(points)):
        far += np.sqrt(squared(points, points[chosen[-1]]).astype(np.float64))
        far[chosen] = -1
        chosen.append(int(far.argmax()))
    return chosen


def nearest_centroid(v: np.ndarray, to_pivots: np.ndarray, centroids: np.ndarray, centroid_to_pivots: np.ndarray):
    """(nearest centroid, its squared distance, number of exact distances) of each row of ``v``.

    |d(v, p) - d(c, p)| bounds d(v, c) from below for every pivot p. The centroid with the least bound is measured
    first; whatever has a bound above that distance can't be nearer, and all others are measured, in whole numbers.
    Roots have a relative error below 1e-15, for which the bounds give way. Ties go to the smaller number.
    """
    n, k = len(v), len(centroids)
    bound = np.zeros((n, k))
    for p in range(to_pivots.shape[1]):
        a, b = to_pivots[:, p:p + 1], centroid_to_pivots[None, :, p]
        np.maximum(bound, np.abs(a - b) - (a + b) * 4e-15, out=bound)
    first = bound.argmin(axis=1)
    d = squared(v, centroids[first])
    reach = np.sqrt(d.astype(np.float64)) * (1 + 4e-15)
    open_ = bound <= reach[:, None]
    open_[np.arange(n), first] = False
    row, col = np.nonzero(open_)
    best, near = first.copy(), d.copy()
    exact = np.empty(len(row), dtype=v.dtype)
    for at in range(0, len(row), 1 << 15):
        r, c = row[at:at + (1 << 15)], col[at:at + (1 << 15)]
        exact[at:at + (1 << 15)] = squared(v[r], centroids[c])
    # the least (distance, number) of each row
    for c in range(k):
        here = col == c
        r, e = row[here], exact[here]
        better = (e < near[r]) | ((e == near[r]) & (c < best[r]))
        best[r[better]], near[r[better]] = c, e[better]
    return best, near, n + len(row)


def _vectors(column) -> np.ndarray:
    return np.asarray(column.flatten()).reshape(len(column), -1)


def cluster(vectors: DataFrame, id_col: str = "vec_id", vec_col: str = "embedding", dims: int = 64, k: int = 40, rounds: int = 5,
            seed: int = 2, scale: int = 256, pivots: int = 12, batch: int = 4096) -> DataFrame:
    """(vec_id, cluster, distance, cluster_inertia, inertia, centroid_sha256) of every vector that takes part.

    Vectors with exactly ``dims`` components, none null or non-finite, take part, each as floor(scale * x). The
    first centroids are the ``k`` vectors (all, if fewer) with the smallest sha256 of ``seed:vec_id``, ties by the
    vector; a null id comes after all others. ``rounds`` times each vector goes to the nearest centroid (squared
    distance, ties to the smaller number) and each centroid that has vectors becomes floor(sum / count) of them; then
    vectors are assigned once more. All of it is whole-number arithmetic, so that the result doesn't depend on how
    the rows are dealt over tasks.

    Distances to ``pivots`` fixed pivots, chosen among the first centroids, are worked out once and stored with
    the vectors. Each round a task reads its rows, and sends a row a cluster. The driver holds centroids and
    pivots only. Repeated rows count as often as they are there. No such vectors: an empty result. Numbers of any
    size are added exactly; a distance or inertia beyond a long stops the job with an error. Other columns of
    ``vectors`` don't matter.
    """
    spark = vectors.sparkSession
    ship(spark)
    kind = "array<float>" if dict(vectors.dtypes)[vec_col] == "array<float>" else "array<double>"
    kept = (vectors.select(F.col(id_col).cast("long").alias("vec_id"), F.col(vec_col).cast(kind).alias("vec"))
            .where((F.size("vec") == dims) & F.forall("vec", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))))
    start = [np.array(r.vec) for r in kept.orderBy(
        F.sha2(F.concat(F.lit(f"{seed}:"), F.col("vec_id").cast("string")), 256).asc_nulls_last(), "vec").limit(k).collect()]
    schema = "vec_id long, cluster int, distance long, cluster_inertia long, inertia long, centroid_sha256 string"
    if not start:
        return spark.createDataFrame([], schema)
    centroids = whole_numbers(np.array(start), scale)
    chosen = centroids[spread_pivots(centroids, pivots)]

    def measured(a: np.ndarray) -> np.ndarray:
        return np.sqrt(np.stack([squared(a, p) for p in chosen], axis=1).astype(np.float64))

    def table(batches):
        import pyarrow as pa
        for b in batches:
            for at in range(0, b.num_rows, batch):
                part = b.slice(at, batch)
                x = _vectors(part.column(1))
                d = measured(whole_numbers(x, scale))
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), part.column(1), pa.FixedSizeListArray.from_arrays(pa.array(d.ravel()), d.shape[1]).cast(pa.list_(pa.float64()))],
                    names=["vec_id", "vec", "to_pivots"])

    rows = stored(kept.mapInArrow(table, f"vec_id long, vec {kind}, to_pivots array<double>"))

    def sums(batches, c=None):
        import pyarrow as pa
        c, far = c, measured(c)
        total = {}
        for b in batches:
            for at in range(0, b.num_rows, batch):
                part = b.slice(at, batch)
                v = whole_numbers(_vectors(part.column(0)), scale)
                best, _, _ = nearest_centroid(v, _vectors(part.column(1)), c, far)
                for j in np.unique(best).tolist():
                    mine = v[best == j]
                    n, s = total.get(j, (0, 0))
                    total[j] = (n + len(mine), s + mine.sum(axis=0).astype(object))
        where = [j for j, (_, s) in total.items() for _ in s]
        yield pa.RecordBatch.from_arrays(
            [pa.array(where, pa.int32()), pa.array([i for _, s in total.values() for i in range(len(s))], pa.int32()),
             pa.array([n for n, s in total.values() for _ in s], pa.int64()),
             pa.array([str(x) for _, s in total.values() for x in s], pa.string())], names=["cluster", "i", "n", "s"])

    for _ in range(rounds):
        new = (rows.select("vec", "to_pivots").mapInArrow(lambda batches, c=centroids: sums(batches, c), "cluster int, i int, n long, s string")
               .groupBy("cluster", "i").agg(F.sum("n").alias("n"), F.sum(F.col("s").cast("decimal(38,0)")).alias("s")).collect())
        was = centroids.tolist()  # k x dims numbers
        for r in new:
            was[r.cluster][r.i] = int(r.s) // r.n
        big = max(abs(x) for c in was for x in c) > SMALL
        centroids = np.array(was, dtype=object if big else np.int64)

    def assign(batches, c=centroids):
        import pyarrow as pa
        far = measured(c)
        for b in batches:
            for at in range(0, b.num_rows, batch):
                part = b.slice(at, batch)
                v = whole_numbers(_vectors(part.column(1)), scale)
                best, d, _ = nearest_centroid(v, _vectors(part.column(2)), c, far)
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(best.astype(np.int32)), pa.array(d.tolist(), pa.int64())],
                                                 names=["vec_id", "cluster", "distance"])

    placed = stored(rows.mapInArrow(assign, "vec_id long, cluster int, distance long"))
    name = F.element_at(F.create_map(*[F.lit(x) for j, c in enumerate(centroids.tolist()) for x in (
        j, hashlib.sha256(",".join(map(str, c)).encode()).hexdigest())]), F.col("cluster"))
    inside = placed.groupBy("cluster").agg(F.sum(F.col("distance").cast("decimal(38,0)")).cast("long").alias("cluster_inertia"))  # k rows
    total = sum(r.cluster_inertia for r in inside.collect())
    return (placed.join(F.broadcast(inside), "cluster")
            .select("vec_id", "cluster", "distance", "cluster_inertia", F.lit(total).cast("long").alias("inertia"), name.alias("centroid_sha256")))


def _op12_sql() -> str:
    """The same in SQL: the rounds one after the other, all centroids measured for every vector."""
    def nearest(n: int) -> str:
        return f"""
a{n} AS MATERIALIZED (SELECT k, v, min({{'d': list_sum(list_transform(list_zip(v, c), lambda p: (p[1] - p[2]) * (p[1] - p[2]))), 'j': j}}) AS m
      FROM ints, c{n} GROUP BY k, v)"""

    def moved(n: int) -> str:
        return f"""
s{n} AS (SELECT j, i, floor_div(sum(x), count(*)) AS x FROM (SELECT m.j AS j, unnest(v) AS x, generate_subscripts(v, 1) AS i FROM a{n}) GROUP BY j, i),
c{n + 1} AS MATERIALIZED (SELECT c{n}.j, coalesce(n.c, c{n}.c) AS c FROM c{n}
      LEFT JOIN (SELECT j, list(x ORDER BY i) AS c FROM s{n} GROUP BY j) n ON n.j = c{n}.j)"""

    steps = ",".join(nearest(n) + "," + moved(n) for n in range(5)) + "," + nearest(5)
    steps = steps.replace("floor_div(sum(x), count(*))",
                          "CAST((sum(x) - ((sum(x) % count(*)) + count(*)) % count(*)) // count(*) AS BIGINT)")
    return f"""
WITH kept AS (SELECT row_number() OVER () AS k, vec_id, embedding AS e FROM embeddings WHERE len(embedding) = 64
      AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
ints AS MATERIALIZED (SELECT k, vec_id, list_transform(e, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS v FROM kept),
c0 AS MATERIALIZED (SELECT row_number() OVER (ORDER BY sha256('2:' || vec_id) NULLS LAST, v) - 1 AS j, v AS c FROM ints QUALIFY j < 40),
{steps},
o AS (SELECT k, m.j AS j, CAST(m.d AS BIGINT) AS d FROM a5)
SELECT i.vec_id, CAST(o.j AS INTEGER) AS cluster, o.d AS distance, CAST(sum(o.d) OVER (PARTITION BY o.j) AS BIGINT) AS cluster_inertia,
    CAST(sum(o.d) OVER () AS BIGINT) AS inertia, sha256(array_to_string(c5.c, ',')) AS centroid_sha256
FROM o JOIN ints i USING (k) JOIN c5 ON c5.j = o.j
"""


OP12_SQL = _op12_sql()
