"""Nearest as-of join with a tolerance per row."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from scanweave.operators.timeline import density_cuts, with_chunks


def asof_nearest(left: DataFrame, right: DataFrame, on: list[str], us: str, left_id: str, right_id: str,
                 tolerance: float | Column, payload: list[str] | None = None, rows_each: int | None = None,
                 keep_unmatched: bool = False) -> DataFrame:
    """For each left row the right row nearest in time, at most its tolerance away.

    ``tolerance`` is a number of seconds, or a column of ``left`` in
    microseconds: a row where it is null has no match. Both clocks are the
    microsecond column ``us``. Equal gaps take the earlier row; among equal right
    times the highest id on the earlier side and the lowest on the later side.

    Both sides are cut along time where their rows are, into parts of about
    ``rows_each`` rows, and move once, by (on, part). A part knows its last and
    first right row; those of the parts beside it take the place of halo rows, so
    that neither tolerance nor gaps decide how far a row has to be copied.
    Adds ``right_us``, ``<right_id>``, ``delta_t_s`` (left minus right) and the
    payload columns.
    """
    payload = payload or []
    tol = F.lit(int(round(tolerance * 1_000_000))) if isinstance(tolerance, (int, float)) else tolerance
    lcols = [c for c in left.columns if c not in on]
    cuts = density_cuts(left.select(*on, us).unionByName(right.select(*on, us)), on, us, rows_each)
    match = F.struct(F.col(us).alias("right_us"), F.col(right_id), *payload)
    kind = left.select(F.struct(*lcols).alias("s")).schema["s"].dataType
    r = right.select(*on, F.col(us).alias("_us"), F.lit(0).alias("_side"), F.col(right_id).cast("long").alias("_id"),
                     F.lit(None).cast(kind).alias("_l"), F.lit(None).cast("long").alias("_tol"), match.alias("_r"))
    l = left.select(*on, F.col(us).alias("_us"), F.lit(1).alias("_side"), F.col(left_id).cast("long").alias("_id"),
                    F.struct(*lcols).alias("_l"), tol.cast("long").alias("_tol"),
                    F.lit(None).cast(r.schema["_r"].dataType).alias("_r"))
    u = with_chunks(l.unionByName(r), on, "_us", cuts, "_b")
    part = [*on, "_b"]
    win = f"OVER (PARTITION BY {', '.join(part)} ORDER BY _us, _side, _id)"
    d = (u.withColumn("_back", F.expr(f"lag(_r) IGNORE NULLS {win}"))
         .withColumn("_fwd", F.expr(f"lead(_r) IGNORE NULLS {win}")).filter("_side = 1"))
    if cuts is not None:
        pos = F.when(F.col("_side") == 0, F.struct("_us", "_id"))
        edges = u.groupBy(*part).agg(F.max_by("_r", pos).alias("_last"), F.min_by("_r", pos).alias("_first"))
        along = Window.partitionBy(*on).orderBy("_b")
        before = along.rowsBetween(Window.unboundedPreceding, -1)
        after = along.rowsBetween(1, Window.unboundedFollowing)
        edges = edges.select(*part, F.last("_last", True).over(before).alias("_before"), F.first("_first", True).over(after).alias("_after"))
        d = (d.join(edges, part, "left").withColumn("_back", F.coalesce("_back", "_before"))
             .withColumn("_fwd", F.coalesce("_fwd", "_after")))
    gap_b = F.col("_us") - F.col("_back.right_us")
    gap_f = F.col("_fwd.right_us") - F.col("_us")
    gap_b, gap_f = F.when(gap_b <= F.col("_tol"), gap_b), F.when(gap_f <= F.col("_tol"), gap_f)
    best = (F.when(gap_b.isNotNull() & (gap_f.isNull() | (gap_b <= gap_f)), F.col("_back"))
            .when(gap_f.isNotNull(), F.col("_fwd")))
    d = d.withColumn("_m", best)
    if not keep_unmatched:
        d = d.filter("_m IS NOT NULL")
    return d.select(*on, "_l.*", F.col("_m.right_us").alias("right_us"), F.col(f"_m.{right_id}").alias(right_id),
                    ((F.col("_us") - F.col("_m.right_us")) / 1e6).alias("delta_t_s"),
                    *[F.col(f"_m.{c}").alias(c) for c in payload])
