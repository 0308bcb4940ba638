"""Mixing sources to target weights by Pfair scheduling, in DataFrame operations only."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.window import Window

from scanweave.llm.base import stored


def tempered_weights(docs: DataFrame, source_col: str = "source", alpha: float = 0.5) -> DataFrame:
    """(source, weight): weight in proportion to a source's number of rows to the power ``alpha``. Null is a source."""
    return (docs.groupBy(F.col(source_col).alias("source")).agg(F.count(F.lit(1)).alias("n"))
            .select("source", F.pow(F.col("n").cast("double"), F.lit(alpha)).alias("weight")))


def shares(weights: DataFrame) -> DataFrame:
    """(source, share, place): the weights over their sum, numbered by source. One row a source; a weight that is
    null or not above 0 is an error."""
    whole = Window.partitionBy()
    w = F.when(F.col("weight") > 0, F.col("weight")).otherwise(F.raise_error(F.lit("a weight must be above 0")).cast("double"))
    return (weights.withColumn("weight", w).withColumn("share", F.col("weight") / F.sum("weight").over(whole))
            .select("source", "share", (F.row_number().over(Window.partitionBy().orderBy(F.col("source").asc_nulls_first())) - 1).alias("place")))


def period_length(least_share: float | None, resolution: int) -> int:
    """Slots of a period: a multiple of ``resolution`` in which the smallest share has a block at least."""
    return resolution * max(1, math.ceil(1 / (least_share * resolution) - 1e-9)) if least_share else resolution


def quotas(shared: DataFrame, periods: int, length: int) -> DataFrame:
    """(source, share, place, period, first, quota): the blocks of each source in each period.

    By the end of a period a source has had its share of all slots so far, rounded down, or one block more: the
    slots left over go by largest remainder, ties by source. So the rounding of one period is made good in the next
    and never adds up. As every share has a block a period, no source's count ever falls.
    """
    def counts(shared: DataFrame, at: Column) -> DataFrame:
        d = shared.withColumn("exact", F.round(F.col("share") * at, 9)).withColumn("down", F.floor("exact"))
        d = d.withColumn("left", at - F.sum("down").over(Window.partitionBy("period")))
        by_rest = Window.partitionBy("period").orderBy(F.round(F.col("exact") - F.col("down"), 9).desc(), "place")
        return d.withColumn("n", F.col("down") + F.when(F.row_number().over(by_rest) <= F.col("left"), 1).otherwise(0)).drop("exact", "down", "left")

    ends = counts(shared.withColumn("period", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(periods).cast("long")))), F.col("period") * length)
    along = Window.partitionBy("place").orderBy("period")
    return (ends.withColumn("first", F.lag("n").over(along)).where("period > 0")
            .select("source", "share", "place", (F.col("period") - 1).alias("period"), "first", (F.col("n") - F.col("first")).alias("quota")))


def schedule(shared: DataFrame, periods: int, length: int) -> DataFrame:
    """(source, period, block, release, deadline, slot) of each block of ``periods`` periods.

    With w = quota / length, the i-th block of a period is released at floor(i/w) and due by ceil((i+1)/w), counted
    from the period's first slot. Each slot takes, of the released blocks, the one with the earliest deadline, ties
    by source. All windows are kept, so that inside a period a source is less than one block away from its share.
    Periods are scheduled by themselves, each as one row, so that their number spreads over the tasks.
    """
    q = F.lit(length)
    rows = quotas(shared, periods, length)
    one = rows.where("quota > 0").groupBy("period").agg(F.sort_array(F.collect_list(F.struct("place", "quota", "first", "source"))).alias("s"))

    def release(i: Column, a: Column) -> Column:
        return F.floor(i * q / a)

    def deadline(i: Column, a: Column) -> Column:
        return F.ceil((i + 1) * q / a)

    # state: next block of each source, and the sources picked so far
    start = F.struct(F.transform("s", lambda x: F.lit(0).cast("long")).alias("next"), F.array().cast("array<int>").alias("picked"))

    def step(state: Column, t: Column) -> Column:
        due = F.zip_with(F.sequence(F.lit(0), F.size("s") - 1), state["next"], lambda p, i: F.when(
            release(i, F.get("s", p)["quota"]) <= t, F.struct(deadline(i, F.get("s", p)["quota"]).alias("d"), p.alias("p"))))
        best = F.array_min(F.filter(due, lambda x: x.isNotNull()))["p"]
        # bound once, not worked out for each source
        return F.transform(F.array(best), lambda b: F.struct(
            F.transform(state["next"], lambda i, p: F.when(p == b, i + 1).otherwise(i)).alias("next"),
            F.concat(state["picked"], F.array(b)).alias("picked")))[0]

    run = one.select("period", "s", F.aggregate(F.sequence(F.lit(0), q - 1), start, step, lambda x: x["picked"]).alias("picked"))
    slots = run.select("period", F.col("s"), F.posexplode("picked").alias("slot", "p")).select("period", F.col("s")[F.col("p")].alias("x"), "slot")
    order = Window.partitionBy("period", "x.place").orderBy("slot")
    base = F.col("period") * length
    return (slots.withColumn("i", (F.row_number().over(order) - 1).cast("long"))
            .select("x.source", "period", (F.col("x.first") + F.col("i")).alias("block"), (base + release(F.col("i"), F.col("x.quota"))).alias("release"),
                    (base + deadline(F.col("i"), F.col("x.quota"))).alias("deadline"), (base + F.col("slot")).alias("slot")))


def ordered_in_source(docs: DataFrame, id_col: str, source_col: str, rows: int, bucket_rows: int = 4096) -> DataFrame:
    """(doc_id, source, place long): place of each row, from 0, in the shuffled order of its source.

    The order is that of md5(id), ties by id. A source is cut into ranges of the leading hash digits, whose
    number follows from ``rows``; places are a range's offset and the place in it, so that a source with a third
    of all rows is spread over all tasks.
    """
    digits = min(7, max(1, math.ceil(math.log(max(rows / bucket_rows, 1), 16)) + 1))
    d = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(source_col).alias("source"))
    d = d.withColumn("h", F.md5(F.coalesce(F.col("doc_id").cast("string"), F.lit(""))))
    d = d.withColumn("cut", F.substring("h", 1, digits))
    counts = d.groupBy("source", "cut").agg(F.count(F.lit(1)).alias("n"))
    before = Window.partitionBy("source").orderBy("cut").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select(F.col("source").alias("s2"), F.col("cut").alias("c2"),
                            F.coalesce(F.sum("n").over(before), F.lit(0)).alias("offset"))
    inside = Window.partitionBy("source", "cut").orderBy("h", F.col("doc_id").asc_nulls_first())
    d = d.withColumn("k", F.row_number().over(inside) - 1)
    return (d.join(offsets, d.source.eqNullSafe(offsets.s2) & (d.cut == offsets.c2))
            .select("doc_id", "source", (F.col("offset") + F.col("k")).alias("place")))


def mix(docs: DataFrame, weights: DataFrame | None = None, id_col: str = "doc_id", source_col: str = "source",
        block: int = 16, resolution: int = 1000) -> DataFrame:
    """(doc_id, source, block, release, deadline, slot, place_in_block) of every row of ``docs``.

    A source's rows, in hash order, are cut into blocks of ``block`` rows; a block's slot on the mixed stream is
    given by ``schedule``. Reading by (slot, place_in_block) is the mix: up to the slot where a source runs out, its
    number of blocks differs from its share of the slots by less than one where shares are multiples of
    1 / ``resolution``, and by less than two otherwise, however long the stream. Later slots of that source stay
    empty, the others keep their ratio. No row is dropped or repeated.

    ``weights(source, weight)`` default to ``tempered_weights``; a null source matches a null there, and rows of
    a source without a weight raise an error. There may be any number of sources. Rows that repeat an id keep a place
    each; a null id is a row like any other. An empty table gives an empty result. Other columns of ``docs`` don't matter.
    """
    weights = tempered_weights(docs, source_col) if weights is None else weights
    shared = stored(shares(weights))
    placed = ordered_in_source(docs, id_col, source_col, docs.count())
    placed = placed.withColumn("block", F.floor(F.col("place") / block)).withColumnRenamed("source", "s0")
    sized = docs.groupBy(F.col(source_col).alias("s1")).agg(F.ceil(F.count(F.lit(1)) / block).alias("n"))
    least, longest = (shared.join(sized, shared.source.eqNullSafe(sized.s1), "left")
                      .agg(F.min("share"), F.max(F.coalesce("n", F.lit(0)) / F.col("share"))).first())
    length = period_length(least, resolution)
    # a source may be one block behind at the end of a period
    plan = schedule(shared, int((longest or 0) // length) + 2, length)
    both = placed.join(plan, F.col("s0").eqNullSafe(F.col("source")) & (placed.block == plan.block), "left")
    found = F.when(F.col("slot").isNotNull(), F.col("slot")).otherwise(
        F.raise_error(F.concat(F.lit("no weight for source "), F.coalesce(F.col("s0").cast("string"), F.lit("null")))).cast("long"))
    return both.select("doc_id", F.col("s0").alias("source"), placed.block, "release", "deadline", found.alias("slot"),
                       (F.col("place") % block).cast("int").alias("place_in_block"))


OP2_SQL = """
WITH RECURSIVE n AS (SELECT source, CAST(count(*) AS DOUBLE) ** 0.5 AS weight, count(*) AS rows FROM documents GROUP BY source),
share AS (SELECT source, weight / sum(weight) OVER () AS w, row_number() OVER (ORDER BY source NULLS FIRST) AS p, ceil(rows / 16.0) AS blocks FROM n),
d AS (SELECT CAST(1000 * greatest(1, ceil(1 / (min(w) * 1000) - 1e-9)) AS BIGINT) AS d, max(blocks / w) AS longest FROM share),
ends AS (SELECT source, p, k, d, round(w * k * d, 9) AS exact FROM share, d, LATERAL (SELECT unnest(range(0, CAST(longest // d AS BIGINT) + 3)) AS k)),
counts AS (SELECT source, p, k, d, CAST(floor(exact) AS BIGINT) + CASE WHEN row_number() OVER (PARTITION BY k ORDER BY round(exact - floor(exact), 9) DESC, p)
    <= k * d - sum(CAST(floor(exact) AS BIGINT)) OVER (PARTITION BY k) THEN 1 ELSE 0 END AS c FROM ends),
quota AS (SELECT source, p, k - 1 AS k, d, c - lag(c) OVER w AS a, lag(c) OVER w AS first, k AS k1 FROM counts WINDOW w AS (PARTITION BY p ORDER BY k) QUALIFY k1 > 0),
packed AS (SELECT k, max(d) AS d, list(a ORDER BY p) AS a, list(p ORDER BY p) AS p FROM quota WHERE a > 0 GROUP BY k),
slots AS (
    SELECT k, 0 AS t, 0 AS pick, list_transform(a, lambda x: CAST(0 AS BIGINT)) AS nx FROM packed
    UNION ALL
    SELECT k, t + 1, best, list_transform(nx, lambda i, p: CASE WHEN p = best THEN i + 1 ELSE i END)
    FROM (SELECT s.k, t, nx, CAST(list_min(list_filter(list_transform(nx, lambda i, p:
              CASE WHEN (i * d) // a[p] <= t THEN (((i + 1) * d + a[p] - 1) // a[p]) * 100000 + p END), lambda x: x IS NOT NULL)) % 100000 AS INTEGER) AS best
          FROM slots s JOIN packed USING (k) WHERE t < d)),
picked AS (SELECT s.k, s.t - 1 AS slot, b.p[s.pick] AS p, row_number() OVER (PARTITION BY s.k, s.pick ORDER BY s.t) - 1 AS i FROM slots s JOIN packed b USING (k) WHERE s.t > 0),
plan AS (SELECT q.source, q.d, q.k, q.a, q.first + i AS block, i, slot FROM picked JOIN quota q USING (k, p)),
placed AS (SELECT doc_id, source, row_number() OVER (PARTITION BY source ORDER BY md5(CAST(doc_id AS VARCHAR)), doc_id) - 1 AS place FROM documents)
SELECT c.doc_id, c.source, CAST(c.place // 16 AS BIGINT) AS block, p.k * p.d + (p.i * p.d) // p.a AS release,
    p.k * p.d + ((p.i + 1) * p.d + p.a - 1) // p.a AS deadline, p.k * p.d + p.slot AS slot, CAST(c.place % 16 AS INTEGER) AS place_in_block
FROM placed c JOIN plan p ON c.source IS NOT DISTINCT FROM p.source AND c.place // 16 = p.block
"""
