"""Features of array-valued scans and per-beam statistics."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from scanweave.functions.arrays import (Beams, array_mean, array_quantile, bearing, bitmap, bits_between, both, kept_slots,
                                        mask_words, readings, share, valid)
from scanweave.operators.sampling import hash_rank


def scan_scalars(df: DataFrame, beams: Beams, near_mm: int, far_mm: int, clip_mm: int,
                 distances: str = "distances", usable: list[bool] | None = None,
                 view: tuple[float, float] | None = None) -> DataFrame:
    """One projection with all scalar features of a scan.

    Slots outside the mask ``usable`` count as no reading; the front cone ends at
    the valid sector ``view``. Shares of no return and of invalid readings are
    those of the raw scan.
    """
    d = F.slice(F.col(distances), 1, beams.active)
    seen = F.slice(kept_slots(distances, usable), 1, beams.active)
    lo, hi = (-30.0, 30.0) if view is None else (max(-30.0, view[0]), min(30.0, view[1]))
    front = beams.part(kept_slots(distances, usable), lo, hi)
    v = df.withColumn("_v", F.array_sort(readings(seen))).withColumn("_f", readings(front)).withColumn("_d", d)
    n = F.greatest(F.size("_v"), F.lit(1))
    vv, ff = F.col("_v"), F.col("_f")
    clipped = lambda a: F.transform(a, lambda x: F.least(x, F.lit(clip_mm)))
    return v.withColumns({
        "n_valid": F.size("_v"), "mean_mm": array_mean(vv), "p90_mm": array_quantile(vv, 0.9),
        "near_frac": share(vv, lambda x: x < near_mm, n), "open_frac": share(vv, lambda x: x > far_mm, n),
        "mean_front_mm": array_mean(ff), "min_mm": F.array_min(clipped(vv)), "p10_mm": array_quantile(clipped(vv), 0.1),
        "min_front_mm": F.array_min(clipped(ff)), "clipped_mean_mm": array_mean(clipped(vv)),
        "no_return_frac": share(F.col("_d"), lambda x: x == 0), "invalid_frac": share(F.col("_d"), lambda x: x == 65535),
    }).drop("_v", "_f", "_d")


def sector_features(df: DataFrame, beams: Beams, sectors: int | list[tuple[float, float]], near_mm: int, distances: str = "distances",
                    usable: list[bool] | None = None) -> DataFrame:
    """Mean and close fraction per angular sector; null where a sector has no reading.

    ``sectors`` is a number of equal ones, or their bounds in degrees.
    """
    d = kept_slots(distances, usable)
    if isinstance(sectors, int):
        parts = beams.sectors(d, sectors)
    else:
        parts = [F.slice(d, a + 1, z - a + 1) for a, z in beams.sector_slots(sectors)]
    cols = {}
    for i, s in enumerate(parts, 1):
        r = readings(s)
        cols[f"n_s{i}"] = F.size(r)
        cols[f"mean_s{i}"] = array_mean(r)
        cols[f"near_s{i}"] = share(r, lambda x: x < near_mm)
    return df.withColumns(cols)


def target_geometry(df: DataFrame, ap_x: Column, ap_y: Column, view_deg: float, floor_m: float = 0.05) -> DataFrame:
    """Distance, body-frame bearing with sine and cosine, and the in-view flag."""
    b = bearing(F.col("x_m"), F.col("y_m"), F.col("heading_rad"), ap_x, ap_y)
    d = df.withColumn("dist_m", F.greatest(F.hypot(F.col("x_m") - ap_x, F.col("y_m") - ap_y), F.lit(floor_m)))
    d = d.withColumn("bearing", b).withColumn("sin_b", F.sin("bearing")).withColumn("cos_b", F.cos("bearing"))
    return d.withColumn("in_view", F.abs(F.degrees("bearing")) <= view_deg)


def scan_bitmaps(df: DataFrame, beams: Beams, near_mm: int, usable: list[bool] | None = None, distances: str = "distances") -> DataFrame:
    """``ok_bits`` and ``near_bits``: which slots have a valid reading, and one nearer than ``near_mm``, in the mask.

    Worked out once a scan; rows that refer to it carry two words for 64 slots.
    """
    d = F.slice(F.col(distances), 1, beams.active)
    mask = mask_words((usable or [True] * beams.active)[:beams.active])
    return df.withColumn("ok_bits", both(bitmap(d, valid, beams.active), mask)).withColumn(
        "near_bits", both(bitmap(d, lambda x: valid(x) & (x < near_mm), beams.active), mask))


def near_share_toward(df: DataFrame, beams: Beams, half_deg: float, name: str, limits: tuple[float, float] | None = None) -> DataFrame:
    """Share of near readings among the valid ones within ``half_deg`` of the bearing, on the circle.

    ``df`` has the bitmaps of its scan. Null out of view and where no slot of the cone has a reading.
    """
    runs = beams.near_slots(F.degrees("bearing"), half_deg, limits)
    count = lambda bits: sum(bits_between(F.col(bits), lo, hi) for lo, hi in runs)
    d = df.withColumn("_ok", count("ok_bits")).withColumn("_near", count("near_bits"))
    return d.withColumn(name, F.when(F.col("in_view") & (F.col("_ok") > 0), F.col("_near") / F.col("_ok"))).drop("_ok", "_near")


def usable_slots(masks: DataFrame) -> list[bool]:
    """A learned mask on the driver: one flag a slot, as many as a scan has."""
    rows = {r.slot: r.usable for r in masks.select("slot", "usable").collect()}
    return [bool(rows.get(i, False)) for i in range(max(rows, default=-1) + 1)]


def explode_beams(df: DataFrame, keep: list[str], weight: str | None = None) -> DataFrame:
    return df.select(*keep, *([weight] if weight else []), F.posexplode("distances").alias("slot", "mm"))


def beam_statistics(df: DataFrame, keys: list[str]) -> DataFrame:
    """Zero share, far share, median and population deviation per beam.

    Readings are 16-bit integers, so the exact percentile holds at most 65,536
    distinct values per beam whatever the number of scans.
    """
    b = explode_beams(df, keys)
    ok = F.when((F.col("mm") != 0) & (F.col("mm") != 65535), F.col("mm"))
    return b.groupBy(*keys, "slot").agg(
        F.count("*").alias("n"), F.avg((F.col("mm") == 0).cast("double")).alias("zero_frac"),
        F.avg((F.col("mm") == 65535).cast("double")).alias("far_frac"), F.median(ok).alias("median_mm"),
        F.stddev_pop(ok).alias("sd_mm"))


def beam_masks(stats: DataFrame, zero: float, body_mm: float, body_sd: float, active: int) -> DataFrame:
    z = F.col("zero_frac") > zero
    body = F.coalesce((F.col("median_mm") < body_mm) & (F.col("sd_mm") < body_sd), F.lit(False))
    pad = F.col("slot") >= active
    return stats.select("slot", z.alias("always_zero"), body.alias("body"), pad.alias("padding"),
                        (~(z | body | pad)).alias("usable"))


def beam_profiles(rows: DataFrame, scans: DataFrame, keys: list[str]) -> DataFrame:
    """Median valid reading per (keys, slot) over the scans the rows refer to.

    Rows that share a scan fold to a weight before the scan is joined and
    exploded.
    """
    w = rows.groupBy(*keys, "scan_row").agg(F.count("*").alias("_w"))
    b = explode_beams(w.join(scans.select("scan_row", "distances"), "scan_row"), keys, "_w")
    b = b.filter((F.col("mm") != 0) & (F.col("mm") != 65535))
    return b.groupBy(*keys, "slot").agg(F.percentile("mm", F.lit(0.5), F.col("_w")).alias("mu"))


def profile_distance(a: DataFrame, b: DataFrame, on: list[str], min_beams: int) -> DataFrame:
    """RMSE and cosine of two per-beam profiles over the beams both have."""
    j = a.withColumnRenamed("mu", "mu_a").join(b.withColumnRenamed("mu", "mu_b"), [*on, "slot"])
    x, y = F.col("mu_a"), F.col("mu_b")
    return (j.groupBy(*on).agg(F.count("*").alias("n_beams"), F.sqrt(F.avg((x - y) * (x - y))).alias("rmse"),
                               (F.sum(x * y) / F.sqrt(F.sum(x * x) * F.sum(y * y))).alias("cosine"))
            .filter(F.col("n_beams") >= min_beams))


def common_heading(rows: DataFrame, group: str, a: str, b: str, min_rows: int) -> DataFrame:
    """Per cell the heading bin best filled by both groups."""
    n = rows.groupBy("cx", "cy", "hb").agg(F.count_if(F.col(group) == a).alias("n_a"), F.count_if(F.col(group) == b).alias("n_b"))
    pos = F.struct(F.least("n_a", "n_b").alias("m"), "n_a", "n_b", "hb")
    return (n.groupBy("cx", "cy").agg(F.max(pos).alias("p")).filter(F.col("p.m") >= min_rows)
            .select("cx", "cy", "p.hb", "p.n_a", "p.n_b"))


def split_half(rows: DataFrame, keys: list[str], seed: str, row_id: str) -> DataFrame:
    """Two equal halves of each key in hash order; an odd last row is left out."""
    d = hash_rank(rows, keys, seed, row_id)
    h = F.floor(F.col("n") / 2)
    return (d.withColumn("half", F.when(F.col("rn") <= h, 1).when(F.col("rn") <= 2 * h, 2))
            .filter("half IS NOT NULL").drop("rn", "n"))
