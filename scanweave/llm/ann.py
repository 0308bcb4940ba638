"""Nearest neighbours by inner product over balanced posting lists."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame, functions as F

from scanweave.llm.base import ship, stored
from scanweave.llm.vectors import classes, matrix, usable


@dataclass
class ListIndex:
    """Centroids and a graph over them, in memory. ``lift`` is the largest norm: a vector x gets one more
    coordinate, sqrt(lift^2 - |x|^2), and a query is scaled to that norm, so that nearest means largest product."""
    centroids: np.ndarray
    graph: np.ndarray
    lift: float
    ratio: float = 0.0

    def vectors(self, x: np.ndarray) -> np.ndarray:
        return np.concatenate([x, np.sqrt(np.maximum(0, self.lift ** 2 - (x ** 2).sum(axis=1)))[:, None]], axis=1)

    def queries(self, x: np.ndarray) -> np.ndarray:
        n = np.sqrt((x ** 2).sum(axis=1))[:, None]
        return np.concatenate([x * (self.lift / n), np.zeros((len(x), 1))], axis=1)

    def near(self, x: np.ndarray, ratio: float, step: int = 512) -> np.ndarray:
        """(rows, lists) distances; infinite where a list is not within (1 + ratio) of the nearest one.

        Best-first search on the graph for many rows at a time: each row expands its nearest open list while
        that lies within the bound (at least ``beam`` lists, so that a narrow bound doesn't end it early).
        """
        lists, beam = len(self.centroids), 8
        found = np.full((len(x), lists), np.inf)
        for a in range(0, len(x), step):
            q = x[a:a + step]
            dist, open_ = np.full((len(q), lists), np.inf), np.zeros((len(q), lists), bool)
            dist[:, 0] = np.sqrt(((q - self.centroids[0]) ** 2).sum(axis=1))
            open_[:, 0] = True
            rows, rounds = np.arange(len(q)), 0
            while len(rows):
                left = np.where(open_[rows], dist[rows], np.inf)
                best = left.argmin(axis=1)
                d = left[np.arange(len(rows)), best]
                go = np.isfinite(d) & ((d <= dist[rows].min(axis=1) * (1 + ratio)) | (rounds < beam))
                rows, best, rounds = rows[go], best[go], rounds + 1
                if not len(rows):
                    break
                open_[rows, best] = False
                to = self.graph[best]
                new = np.isinf(dist[rows[:, None], to])
                r, c = np.nonzero(new)
                at, node = rows[r], to[r, c]
                dist[at, node] = np.sqrt(((q[at] - self.centroids[node]) ** 2).sum(axis=1))
                open_[at, node] = True
            found[a:a + step] = np.where(dist <= dist.min(axis=1, keepdims=True) * (1 + ratio), dist, np.inf)
        return found


def _balanced(x: np.ndarray, rows: np.ndarray, lists: int, rng) -> list[np.ndarray]:
    """Cuts the rows into ``lists`` groups of equal size, again and again across the line between two means."""
    if lists <= 1 or len(rows) < 2:
        return [rows]
    a = x[rows]
    c = a[rng.choice(len(a), 2, replace=False)]
    for _ in range(6):
        d = a @ (c[1] - c[0])
        up = d > np.median(d)
        if not up.any() or up.all():
            break
        c = np.stack([a[~up].mean(axis=0), a[up].mean(axis=0)])
    order, low = np.argsort(a @ (c[1] - c[0]), kind="stable"), lists // 2
    cut = len(rows) * low // lists
    return _balanced(x, rows[order[:cut]], low, rng) + _balanced(x, rows[order[cut:]], lists - low, rng)


def fit(sample: np.ndarray, lift: float, lists: int, replicas: int, border: float, k: int, recall: float,
        degree: int = 16, seed: int = 3) -> ListIndex:
    """Centroids of balanced groups of the sample, each joined to its nearest and to a few random others.

    The probing ratio is the smallest that finds ``recall`` of the sample's own nearest in the lists probed.
    """
    rng = np.random.default_rng(seed)
    index = ListIndex(np.zeros((1, sample.shape[1] + 1)), np.zeros((1, 1), np.int64), lift)
    x = index.vectors(sample)
    index.centroids = np.stack([x[g].mean(axis=0) for g in _balanced(x, np.arange(len(x)), lists, rng) if len(g)])
    c, n = index.centroids, len(index.centroids)
    near = np.stack([np.argsort(((c - p) ** 2).sum(axis=1), kind="stable")[1:degree + 1] for p in c]) if n > 1 else np.zeros((1, 1), np.int64)
    ring = (np.arange(n)[:, None] + np.array([[1]])) % n  # keeps the graph in one piece
    index.graph = np.concatenate([near, ring, rng.integers(0, n, (n, 4))], axis=1)
    member = assigned(index, x, replicas, border)
    probe = np.arange(0, len(x), max(1, len(x) // 400))
    score = sample[probe] @ sample.T
    score[np.arange(len(probe)), probe] = -np.inf
    top = np.argsort(-score, axis=1, kind="stable")[:, :min(k, len(x) - 1)]
    q = index.queries(sample[probe])
    dist = np.sqrt(((q[:, None] - c) ** 2).sum(axis=2)) if n < 512 else index.near(q, 1.0)
    for index.ratio in np.arange(0.02, 1.5, 0.02):
        seen = dist <= dist.min(axis=1, keepdims=True) * (1 + index.ratio)
        if top.size == 0 or np.mean([(member[top[i]] & seen[i]).any(axis=1).mean() for i in range(len(probe))]) >= recall:
            break
    return index


def assigned(index: ListIndex, x: np.ndarray, replicas: int, border: float) -> np.ndarray:
    """(rows, lists): the nearest list, and up to ``replicas`` in all whose distance is within the border."""
    d = index.near(x, border)
    order = np.argsort(d, axis=1, kind="stable")[:, :replicas]
    out = np.zeros(d.shape, bool)
    np.put_along_axis(out, order, np.isfinite(np.take_along_axis(d, order, axis=1)), axis=1)
    return out


def pa_top():
    import pyarrow as pa
    return pa.list_(pa.struct([("far", pa.float64()), ("least", pa.int64()), ("cid", pa.int64())]))


def products(x: np.ndarray, y: np.ndarray, row: np.ndarray, col: np.ndarray, step: int = 1 << 16) -> np.ndarray:
    """Inner products of pairs of rows, added up component by component as in the final score: ties are exact."""
    out = np.zeros(len(row))
    for at in range(0, len(row), step):
        a, b = x[row[at:at + step]], y[col[at:at + step]]
        total = np.zeros(len(a))
        for d in range(x.shape[1]):
            total += a[:, d] * b[:, d]
        out[at:at + step] = total
    return out


def nearest(vectors: DataFrame, is_query: Column, id_col: str = "vec_id", vec_col: str = "embedding", k: int = 20,
            list_size: int = 512, most_lists: int = 4096, sample: int = 16384, replicas: int = 2, border: float = 0.1,
            recall: float = 0.96, list_block: int = 4096, query_block: int = 1024) -> DataFrame:
    """(query_id, rank, vec_id, score): the ``k`` largest inner products found for each row where ``is_query``.

    ``is_query`` is a condition on vec_id. Candidates are all other rows; scores are exact, in double
    precision; ties go to the smaller id. Equal vectors are searched once: only a class's k+1 smallest ids can be
    among anyone's k nearest. Lists are fitted on at most ``sample`` classes, drawn by a hash, and there are
    at most ``most_lists`` of them, which bounds what tasks keep in memory; every vector is indexed in its
    nearest list and, near a border, in up to ``replicas``. Lists and queries meet in blocks of bounded size. A
    list is probed if its distance is within a ratio of the nearest list's, found on the sample for ``recall``.

    Null, zero, non-finite and oddly long vectors take no part. An id repeated with different vectors has each of
    its rows searched and found. No vectors: an empty result.
    """
    spark = vectors.sparkSession
    ship(spark)
    v = usable(vectors, id_col, vec_col)
    cls = stored(classes(v, [], k + 1))
    n = cls.count()
    out_schema = "query_id long, rank int, vec_id long, score double"
    if not n:
        return spark.createDataFrame([], out_schema)
    cls = cls.withColumn("cid", F.xxhash64("vec"))  # tells classes of one repeated id apart
    lift = cls.agg(F.max(F.sqrt(F.aggregate("vec", F.lit(0.0), lambda a, x: a + x.cast("double") * x.cast("double"))))).first()[0]
    drawn = matrix(cls.orderBy(F.xxhash64("cid"), "cid").limit(sample).select("vec").toArrow().column(0))
    index = fit(drawn, lift, int(min(most_lists, max(1, -(-n // list_size)))), replicas, border, k, recall)
    shared = spark.sparkContext.broadcast(index)  # most_lists centroids and edges

    def place(batches):
        import pyarrow as pa
        for b in batches:
            x = matrix(b.column(1))
            if len(x):
                row, at = np.nonzero(assigned(shared.value, shared.value.vectors(x), replicas, border))
                got = b.take(pa.array(row))
                yield pa.RecordBatch.from_arrays([pa.array(at.astype(np.int32)), *got.columns], names=["list", "cid", "vec", "class_id"])

    def probe(batches):
        import pyarrow as pa
        for b in batches:
            x = matrix(b.column(1))
            if len(x):
                index = shared.value
                row, at = np.nonzero(np.isfinite(index.near(index.queries(x), index.ratio)))
                got = b.take(pa.array(row))
                yield pa.RecordBatch.from_arrays([pa.array(at.astype(np.int32)), got.column(0), got.column(1)], names=["list", "cid", "vec"])

    kind = f"list int, cid long, vec {dict(cls.dtypes)['vec']}"
    asked = stored(v.where(is_query).join(cls.select("cid", F.col("vec").alias("v2"), "class_id"), F.col("vec") == F.col("v2"))
                   .select("vec_id", "cid", "vec"))
    posted = stored(cls.select("cid", "vec", "class_id").mapInArrow(place, f"{kind}, class_id long"))
    probed = stored(asked.dropDuplicates(["cid"]).select("cid", "vec").mapInArrow(probe, kind))
    blocks = (posted.groupBy("list").agg(F.ceil(F.count(F.lit(1)) / list_block).cast("int").alias("nv"))
              .join(probed.groupBy("list").agg(F.ceil(F.count(F.lit(1)) / query_block).cast("int").alias("nq")), "list"))
    blocks = F.broadcast(blocks)  # a row a list

    def dealt(rows, own, n_own, other, n_other):
        return rows.join(blocks, "list").select(
            "list", F.pmod(F.xxhash64("cid"), F.col(n_own)).cast("int").alias(own),
            F.explode(F.sequence(F.lit(0), F.col(n_other) - 1)).alias(other), *[c for c in rows.columns if c != "list"])

    kind_top = pa_top()

    def search(key, left, right):
        import pyarrow as pa
        if not left.num_rows or not right.num_rows:
            return pa.table({"q": pa.array([], pa.int64()), "list": pa.array([], pa.int32()), "top": pa.array([], kind_top)})
        qid, cid, least = (c.to_numpy() for c in (left.column("cid"), right.column("cid"), right.column("class_id")))
        x, y = matrix(left.column("vec")), matrix(right.column("vec"))
        s = np.einsum("id,jd->ij", x, y, optimize=True)
        take = min(k + 1, len(cid))
        edge = np.partition(s, len(cid) - take, axis=1)[:, len(cid) - take]
        near = 1e-12 * np.sqrt((x * x).sum(axis=1) * (y * y).sum(axis=1).max())  # more than rounding can do
        row, col = np.nonzero(s >= (edge - near)[:, None])
        far = -products(x, y, row, col)
        o = np.lexsort((cid[col], least[col], far, row))
        row, col, far = row[o], col[o], far[o]
        first = np.searchsorted(row, np.arange(len(qid)))
        keep = np.arange(len(row)) - first[row] < take
        row, col, far = row[keep], col[keep], far[keep]
        top = pa.StructArray.from_arrays([pa.array(far), pa.array(least[col]), pa.array(cid[col])], names=["far", "least", "cid"])
        cuts = np.concatenate([[0], np.cumsum(np.bincount(row, minlength=len(qid)))])
        return pa.Table.from_arrays([pa.array(qid), pa.array(np.full(len(qid), key[0].as_py(), np.int32)),
                                     pa.ListArray.from_arrays(pa.array(cuts.astype(np.int32)), top)], names=["q", "list", "top"])

    keys = ["list", "vb", "qb"]
    hits = (dealt(probed, "qb", "nq", "vb", "nv").groupBy(*keys).cogroup(dealt(posted, "vb", "nv", "qb", "nq").groupBy(*keys))
            .applyInArrow(search, "q long, list int, top array<struct<far:double,least:long,cid:long>>"))

    def merged(df, *by):  # a vector may come from each of its lists, with the same product
        return df.groupBy(*by).agg(F.slice(F.array_sort(F.flatten(F.collect_list("top"))), 1, (k + 1) * replicas).alias("top"))

    best = merged(merged(hits, "q", "list"), "q")
    # one product a pair, added up in one order
    found = best.select("q", F.explode("top.cid").alias("cid")).distinct()
    dot = F.aggregate(F.zip_with("qv", "vec", lambda a, b: a.cast("double") * b.cast("double")), F.lit(0.0), lambda a, x: a + x)
    scored = (found.join(cls.select("cid", "vec", "ids"), "cid")
              .join(cls.select(F.col("cid").alias("q"), F.col("vec").alias("qv")), "q")
              .select("q", F.transform("ids", lambda i: F.struct((-dot).alias("far"), i.alias("id"))).alias("top")))
    near = scored.groupBy("q").agg(F.slice(F.array_sort(F.flatten(F.collect_list("top"))), 1, k + 1).alias("top"))
    own = asked.join(near, asked.cid == near.q).select(
        F.col("vec_id").alias("query_id"), F.slice(F.filter("top", lambda t: t["id"] != F.col("vec_id")), 1, k).alias("top"))
    return own.select("query_id", F.posexplode("top").alias("p", "t")).select(
        "query_id", (F.col("p") + 1).alias("rank"), F.col("t.id").alias("vec_id"), (-F.col("t.far")).alias("score"))
