"""Embedding near-duplicates by a pivot-permutation index."""

from __future__ import annotations

from itertools import combinations

import numpy as np
from pyspark.sql import DataFrame, functions as F

from scanweave.llm.base import ship, stored
from scanweave.llm.components import connected_components
from scanweave.llm.vectors import classes, matrix, usable


def permutations(x: np.ndarray, pivots: np.ndarray, k: int) -> np.ndarray:
    """The ``k`` nearest pivots by angle of each row, nearest first."""
    s = x @ pivots.T / np.sqrt((x ** 2).sum(axis=1))[:, None]
    k = min(k, len(pivots))
    top = np.argpartition(-s, k - 1, axis=1)[:, :k]
    return np.take_along_axis(top, np.argsort(-np.take_along_axis(s, top, axis=1), axis=1, kind="stable"), axis=1)


def apart(pivots: np.ndarray, cosine: float) -> np.ndarray:
    """Unit pivots without those too close to an earlier one: a dense group must not split over its own pivots."""
    p = pivots / np.maximum(1e-300, np.sqrt((pivots ** 2).sum(axis=1)))[:, None]
    close = p @ p.T >= cosine
    keep = np.ones(len(p), bool)
    for i in range(len(p)):
        if keep[i]:
            keep[i + 1:] &= ~close[i, i + 1:]
    return p[keep]


def spread(pivots: np.ndarray, cosine: float, prefix: int, enough: int = 32) -> np.ndarray:
    """The pivots by which vectors are described: those apart by 0.7, or by the next larger bound that leaves ``enough``.

    Vectors that all point much the same way leave hardly any at 0.7. Bounds stay below the ``cosine`` of a link, so
    that no dense group splits; where none leaves enough, the one that leaves most counts. With no more than ``prefix``
    pivots every vector would have all of them, which says nothing: then one stays, and all pairs of a label meet.
    """
    best = apart(pivots, 0.7)
    for bound in np.arange(0.75, cosine, 0.05):
        if len(best) >= min(enough, len(pivots)):
            break
        more = apart(pivots, bound)
        best = more if len(more) > len(best) else best
    return best if len(best) > prefix else best[:1]


def _verified(x: np.ndarray, y: np.ndarray, px: np.ndarray, py: np.ndarray, key: tuple[int, int], cosine: float, same: bool):
    """Row pairs with at least the cosine that count under this key: their two smallest shared pivots are the key.

    With a single pivot the key is that pivot twice.

    Products of a block serve as a filter; what passes is computed again pair by pair in double precision.
    """
    nx, ny = np.sqrt((x ** 2).sum(axis=1)), np.sqrt((y ** 2).sum(axis=1))
    s = (x / nx[:, None]) @ (y / ny[:, None]).T
    i, j = np.nonzero(s >= cosine - 1e-9)
    if same:
        i, j = i[i < j], j[i < j]
    keep = np.zeros(len(i), bool)
    for a in range(0, len(i), 1 << 16):
        p, q = i[a:a + (1 << 16)], j[a:a + (1 << 16)]
        c = np.einsum("nd,nd->n", x[p], y[q]) / (nx[p] * ny[q])
        shared = np.where((px[p][:, :, None] == py[q][:, None, :]).any(axis=2), px[p], np.iinfo(np.int64).max)
        two = np.sort(shared, axis=1)[:, :2]
        keep[a:a + (1 << 16)] = (c >= cosine) & (two[:, 0] == key[0]) & (two[:, -1] == key[1])
    return i[keep], j[keep]


def _roots(n: int, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """The smallest row that each of ``n`` rows reaches by the pairs (minima spread until they settle)."""
    root = np.arange(n)
    while len(i):
        low = np.minimum(root[i], root[j])
        new = root.copy()
        np.minimum.at(new, i, low)
        np.minimum.at(new, j, low)
        new = new[new]
        if (new == root).all():
            break
        root = new
    return root


def near_duplicates(vectors: DataFrame, id_col: str = "vec_id", vec_col: str = "embedding", label_col: str = "label",
                    cosine: float = 0.93, prefix: int = 5, most_pivots: int = 2048, block: int = 512) -> DataFrame:
    """(vec_id, n_links, component_id, kept) of every row: links have equal labels and at least ``cosine``.

    A vector is described by its ``prefix`` nearest of a number of pivots that grows as the root of the rows (to
    ``most_pivots``, drawn from the vectors by a hash, see ``spread``). Inverted lists are kept for each pair of pivots of that
    prefix, so that vectors meet if they share two. A list is compared in blocks of ``block`` rows, each pair of
    blocks in its own group; the tasks give counts and local roots, not pairs, and a pair counts only under its
    two smallest shared pivots. Equal vectors are one row with a size.

    Null labels and null, zero, non-finite or oddly long vectors link with nothing and are kept alone. A row with a
    null id is left out; rows that repeat an id and vector count each. Found links are verified, so none is below
    the cosine; pairs with fewer than two shared pivots are not found (recall is measured in the tests), unless there is one
    pivot only.
    """
    spark = vectors.sparkSession
    ship(spark)
    rows = vectors.select(F.col(id_col).cast("long").alias("vec_id"), F.col(vec_col).alias("vec"), F.col(label_col).alias("label"))
    v = usable(rows, "vec_id", "vec", ["label"]).where(F.col("label").isNotNull())
    cls = stored(v.groupBy("label", "vec").agg(F.min("vec_id").alias("least"), F.count(F.lit(1)).alias("size"))
                 .withColumn("cid", F.xxhash64("label", "vec")))
    n = cls.count()
    count = int(min(most_pivots, max(32, 4 * n ** 0.5)))
    pivots = matrix(cls.orderBy(F.xxhash64("cid"), "cid").limit(count).select("vec").toArrow().column(0)) if n else np.zeros((0, 1))
    pivots = spread(pivots, cosine, prefix)
    shared = spark.sparkContext.broadcast(pivots)  # most_pivots vectors

    def describe(batches):
        import pyarrow as pa
        for b in batches:
            x = matrix(b.column(2))
            if not len(x):
                continue
            p = permutations(x, shared.value, prefix)
            pairs = list(combinations(range(p.shape[1]), 2)) or [(0, 0)]
            key = np.stack([np.minimum(p[:, i], p[:, j]) * 65536 + np.maximum(p[:, i], p[:, j]) for i, j in pairs], axis=1)
            row = np.repeat(np.arange(len(x)), len(pairs))
            got = b.take(pa.array(row))
            yield pa.RecordBatch.from_arrays([got.column(0), pa.array(key.ravel().astype(np.int64)), got.column(1)], names=["label", "key", "cid"])

    kinds = dict(cls.dtypes)
    posts = stored(cls.select("label", "cid", "vec").mapInArrow(describe, f"label {kinds['label']}, key long, cid long"))
    lists = posts.groupBy("label", "key").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    dealt = (posts.join(lists, ["label", "key"]).withColumn("blocks", F.ceil(F.col("n") / block).cast("int"))
             .withColumn("own", F.pmod(F.xxhash64("cid", "key"), F.col("blocks")).cast("int"))
             .withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
             .select("label", "key", F.least("own", "other").alias("b1"), F.greatest("own", "other").alias("b2"), "own", "cid"))
    full = dealt.join(cls.select("cid", "vec", "size"), "cid")
    group = ["label", "key", "b1", "b2"]
    sorted_ = full.repartition(*group).sortWithinPartitions(*group, "cid").select(*group, "own", "cid", "size", "vec")

    def compare(batches):
        import pyarrow as pa
        pending = None

        def runs(t, last):
            """Whole groups of a sorted table; the last group may go on in the next batch."""
            if not t.num_rows:
                return [], t
            ids = np.stack([np.asarray(t.column(c).to_numpy(zero_copy_only=False)) for c in ("key", "b1", "b2")])
            lab = t.column("label").combine_chunks().dictionary_encode()
            lab = (lab.chunk(0) if isinstance(lab, pa.ChunkedArray) else lab).indices.to_numpy()
            new = np.flatnonzero((ids[:, 1:] != ids[:, :-1]).any(axis=0) | (lab[1:] != lab[:-1])) + 1
            cuts = [0, *new.tolist(), t.num_rows]
            if not last:
                return list(zip(cuts[:-2], cuts[1:-1])), t.slice(cuts[-2])
            return list(zip(cuts[:-1], cuts[1:])), t.slice(t.num_rows)

        def links(t, spans):
            cid, links_, root = [], [], []
            key, own = t.column("key").to_numpy(), t.column("own").to_numpy()
            b1, b2 = t.column("b1").to_numpy(), t.column("b2").to_numpy()
            ids, size = t.column("cid").to_numpy(), t.column("size").to_numpy()
            spans = [(a, z) for a, z in spans if z - a > 1]
            if not spans:
                return None
            x = matrix(t.column("vec"))
            p = permutations(x, shared.value, prefix)
            for a, z in spans:
                pair = (int(key[a]) // 65536, int(key[a]) % 65536)
                if b1[a] == b2[a]:
                    i, j = _verified(x[a:z], x[a:z], p[a:z], p[a:z], pair, cosine, True)
                else:
                    u, w = np.flatnonzero(own[a:z] == b1[a]), np.flatnonzero(own[a:z] == b2[a])
                    i, j = _verified(x[a:z][u], x[a:z][w], p[a:z][u], p[a:z][w], pair, cosine, False)
                    i, j = u[i], w[j]
                if len(i):
                    s = size[a:z]
                    total = np.bincount(i, s[j], z - a) + np.bincount(j, s[i], z - a)
                    hit = np.flatnonzero(total)
                    r = _roots(z - a, i, j)
                    cid.append(ids[a:z][hit]), links_.append(total[hit].astype(np.int64)), root.append(ids[a:z][r[hit]])
            if not cid:
                return None
            return pa.RecordBatch.from_arrays([pa.array(np.concatenate(c)) for c in (cid, links_, root)], names=["cid", "links", "root"])

        for b in batches:
            t = pa.Table.from_batches([b])
            t = pa.concat_tables([pending, t]) if pending is not None and pending.num_rows else t
            spans, pending = runs(t, False)
            out = links(t, spans)
            if out is not None:
                yield out
        if pending is not None and pending.num_rows:
            out = links(pending, runs(pending, True)[0])
            if out is not None:
                yield out

    found = stored(sorted_.mapInArrow(compare, "cid long, links long, root long"))
    total = found.groupBy("cid").agg(F.sum("links").alias("links"))
    roots = connected_components(found.select(F.col("cid").alias("a"), F.col("root").alias("b")))
    rooted = stored(cls.select("cid", "label", "vec", "least", "size").join(total, "cid", "left")
                    .join(roots, F.col("cid") == F.col("node"), "left")
                    .select("cid", "label", "vec", "least", (F.col("size") - 1 + F.coalesce("links", F.lit(0))).alias("n_links"),
                            F.coalesce("root", "cid").alias("root")))
    ids = rooted.groupBy("root").agg(F.min("least").alias("component_id"))
    named = rooted.join(ids, "root").select(F.col("cid").alias("c2"), "n_links", "component_id")
    out = rows.where("vec_id is not null").withColumn("cid", F.when(F.col("label").isNotNull() & F.col("vec").isNotNull(), F.xxhash64("label", "vec")))
    out = out.select("vec_id", "cid").join(named, F.col("cid") == F.col("c2"), "left").select(
        "vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), F.coalesce("component_id", "vec_id").alias("component_id"))
    return out.withColumn("kept", F.col("vec_id") == F.col("component_id"))
