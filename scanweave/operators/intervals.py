"""Point-in-interval joins on bucketed time."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from scanweave.functions.exprs import time_bucket


def points_in_intervals(points: DataFrame, spans: DataFrame, on: list[str], us: str,
                        start: str, end: str, bucket_s: float, margin_s: float = 0.0) -> DataFrame:
    """Every (point, span) pair with start - margin <= point <= end + margin.

    A span is copied to each bucket it touches, so the join is an equality on
    (on, bucket) and no pair outside the bucket is looked at.
    """
    m = int(round(margin_s * 1_000_000))
    width = int(round(bucket_s * 1_000_000))
    s = (spans.withColumn("_lo", F.col(start) - m).withColumn("_hi", F.col(end) + m)
         .withColumn("_b", F.explode(F.sequence(F.floor(F.col("_lo") / width),
                                                F.floor(F.col("_hi") / width)))))
    p = points.withColumn("_b", time_bucket(us, bucket_s))
    return (p.join(s, [*on, "_b"]).filter(F.col(us).between(F.col("_lo"), F.col("_hi")))
            .drop("_b", "_lo", "_hi"))


def assign_last_span(points: DataFrame, spans: DataFrame, on: list[str], us: str, start: str,
                     end: str, span_order: str, carry: list[str], point_key: str,
                     bucket_s: float) -> DataFrame:
    """One span per point: where spans overlap, the one latest in ``span_order``.

    Points outside every span are dropped. Only keys and the span travel through
    the de-duplicating aggregate.
    """
    hit = points_in_intervals(points.select(*on, us, point_key),
                              spans.select(*on, start, end, span_order, *carry),
                              on, us, start, end, bucket_s)
    best = (hit.groupBy(*on, us, point_key)
            .agg(F.max_by(F.struct(*carry, start, end), F.col(span_order)).alias("_s"))
            .select(*on, us, point_key, "_s.*"))
    return best
