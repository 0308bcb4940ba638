"""Scan features, beam statistics, geometry and scan-table checks."""

from __future__ import annotations

from pyspark.sql import functions as F

from scanweave.functions.arrays import Beams, cosine, kept_slots, masked, rmse
from scanweave.functions.exprs import cell, rnd
from scanweave.operators.cells import with_cells
from scanweave.operators.quantiles import exact_quantiles
from scanweave.operators.scans import (beam_masks, beam_profiles, beam_statistics, common_heading, near_share_toward,
                                       profile_distance, scan_bitmaps, scan_scalars, sector_features, split_half,
                                       target_geometry, usable_slots)
from scanweave.plans.registry import query
from scanweave.session import stored
from scanweave.plans.views import AP, JOINT, SCAN, TEL, events, joint, scan, table, telemetry, transmitters

BEAMS = Beams(-110.0, 3.5, 64)
NEAR, FAR, CLIP = 1000, 4000, 8250
OK = "mm NOT IN (0, 65535)"


def scalars(spark, sf):
    return scan_scalars(scan(spark, sf), BEAMS, NEAR, FAR, CLIP)


@query("v01_scan_scalars", f"""
WITH {SCAN} SELECT scan_row, count(*) FILTER ({OK}) AS n_valid, round(avg(mm) FILTER ({OK}), 6) AS mean_mm, round(quantile_cont(mm, 0.9) FILTER ({OK}), 6) AS p90_mm,
 round(count(*) FILTER ({OK} AND mm < 1000)/greatest(count(*) FILTER ({OK}), 1), 6) AS near_frac,
 round(count(*) FILTER ({OK} AND mm > 4000)/greatest(count(*) FILTER ({OK}), 1), 6) AS open_frac,
 round(avg(mm) FILTER ({OK} AND slot BETWEEN 23 AND 40), 6) AS mean_front_mm FROM beam GROUP BY 1""")
def v01(spark, sf):
    return scalars(spark, sf).select("scan_row", F.col("n_valid").cast("long").alias("n_valid"), *[
        rnd(c).alias(c) for c in ("mean_mm", "p90_mm", "near_frac", "open_frac", "mean_front_mm")])


@query("v02_extended_scan_scalars", f"""
WITH {SCAN}, c AS (SELECT *, least(mm, 8250) AS cm FROM beam)
SELECT scan_row, min(cm) FILTER ({OK}) AS min_mm, round(quantile_cont(cm, 0.1) FILTER ({OK}), 6) AS p10_mm, min(cm) FILTER ({OK} AND slot BETWEEN 23 AND 40) AS min_front_mm,
 round(avg(cm) FILTER ({OK}), 6) AS clipped_mean_mm, round(count(*) FILTER (mm = 0)/count(*), 6) AS no_return_frac, round(count(*) FILTER (mm = 65535)/count(*), 6) AS invalid_frac
FROM c GROUP BY 1""")
def v02(spark, sf):
    return scalars(spark, sf).select("scan_row", "min_mm", "min_front_mm", *[rnd(c).alias(c) for c in (
        "p10_mm", "clipped_mean_mm", "no_return_frac", "invalid_frac")])


def sectors(spark, sf):
    return sector_features(scan(spark, sf), BEAMS, 7, NEAR)


@query("v03_sector_aggregates", f"""
WITH {SCAN} SELECT scan_row, """ + ", ".join(
    f"round(avg(mm) FILTER ({OK} AND slot*7//64 = {i}), 6) AS mean_s{i + 1}, round(count(*) FILTER ({OK} AND slot*7//64 = {i} AND mm < 1000)/nullif(count(*) FILTER ({OK} AND slot*7//64 = {i}), 0), 6) AS near_s{i + 1}"
    for i in range(7)) + " FROM beam GROUP BY 1")
def v03(spark, sf):
    return sectors(spark, sf).select("scan_row", *[rnd(f"{p}_s{i}").alias(f"{p}_s{i}") for i in range(1, 8) for p in ("mean", "near")])


@query("a40_sector_mean_consistency", f"""
WITH {SCAN}, s AS (SELECT scan_row, slot*7//64 AS s, avg(mm) FILTER ({OK}) AS m, count(*) FILTER ({OK}) AS n FROM beam GROUP BY 1, 2),
w AS (SELECT scan_row, sum(m*n)/sum(n) AS wm FROM s GROUP BY 1), o AS (SELECT scan_row, avg(mm) FILTER ({OK}) AS om FROM beam GROUP BY 1)
SELECT count(*) AS n_scans, count(*) FILTER (abs(wm - om) > 0.001) AS n_off, max(abs(wm - om)) < 0.001 AS consistent FROM w JOIN o USING (scan_row)""")
def a40(spark, sf):
    d = scan_scalars(sectors(spark, sf), BEAMS, NEAR, FAR, CLIP)
    total = sum(F.coalesce(F.col(f"mean_s{i}") * F.col(f"n_s{i}"), F.lit(0.0)) for i in range(1, 8))
    n = sum(F.col(f"n_s{i}") for i in range(1, 8))
    gap = F.abs(total / n - F.col("mean_mm"))
    return d.agg(F.count("*").alias("n_scans"), F.count_if(gap > 0.001).alias("n_off"), (F.max(gap) < 0.001).alias("consistent"))


GEO = """
gd AS (SELECT t.*, ap_x, ap_y, greatest(sqrt((x_m-ap_x)*(x_m-ap_x)+(y_m-ap_y)*(y_m-ap_y)), CAST(0.05 AS DOUBLE)) AS dist_m,
  atan2(ap_y - y_m, ap_x - x_m) - heading_rad AS raw FROM {src} t JOIN ap USING (session_id)),
gb AS (SELECT *, raw + pi() - 2*pi()*floor((raw + pi())/(2*pi())) - pi() AS bearing FROM gd),
geo AS (SELECT *, sin(bearing) AS sin_b, cos(bearing) AS cos_b, abs(degrees(bearing)) <= 110 AS in_view FROM gb)"""


def geometry(df, spark):
    d = df.join(F.broadcast(transmitters(spark)), "session_id")  # three fixed rows
    return target_geometry(d, F.col("ap_x"), F.col("ap_y"), 110.0)


@query("v05_relative_geometry", f"""
WITH {TEL}, {AP}, {GEO.format(src="tel")} SELECT joint_idx, round(dist_m, 6) AS dist_m, round(bearing, 6) AS bearing, round(sin_b, 6) AS sin_b,
  round(cos_b, 6) AS cos_b, in_view FROM geo""")
def v05(spark, sf):
    return geometry(telemetry(spark, sf), spark).select("joint_idx", *[rnd(c).alias(c) for c in (
        "dist_m", "bearing", "sin_b", "cos_b")], "in_view")


CONE = f"""
cone AS (SELECT joint_idx, count(*) FILTER (mm < 1000)/count(*) AS near_toward FROM geo CROSS JOIN (SELECT count(*) AS n_scan FROM embeddings) c
  JOIN beam ON beam.scan_row = geo.joint_idx % c.n_scan WHERE in_view AND {OK} AND abs((-110 + 3.5*slot) - degrees(bearing)) <= 15 GROUP BY 1)"""


def scan_of(spark, sf):
    """Telemetry with the number of the scan each row refers to, and the transmitter's geometry."""
    n = table(spark, sf, "embeddings").select(F.count("*")).scalar()
    return geometry(telemetry(spark, sf).withColumn("scan_row", F.col("joint_idx") % n), spark)


def cone(spark, sf):
    bits = scan_bitmaps(scan(spark, sf), BEAMS, NEAR).select("scan_row", "ok_bits", "near_bits")
    return near_share_toward(scan_of(spark, sf).join(bits, "scan_row"), BEAMS, 15.0, "near_toward")


@query("v04_cone_aggregate", f"""
WITH {TEL}, {SCAN}, {AP}, {GEO.format(src="tel")}, {CONE}
SELECT g.joint_idx, round(near_toward, 6) AS near_toward FROM geo g LEFT JOIN cone USING (joint_idx)""")
def v04(spark, sf):
    return cone(spark, sf).select("joint_idx", rnd("near_toward").alias("near_toward"))


@query("q08_geometry_identities", f"""
WITH {TEL}, {SCAN}, {AP}, {GEO.format(src="tel")}, {CONE}
SELECT count(*) AS n, max(abs(sin_b*sin_b + cos_b*cos_b - 1)) < 1e-9 AS unit_circle, count(*) FILTER (NOT in_view) AS n_out,
  count(*) FILTER (NOT in_view AND near_toward IS NOT NULL) AS n_bad FROM geo LEFT JOIN cone USING (joint_idx)""")
def q08(spark, sf):
    d = cone(spark, sf)
    one = F.abs(F.col("sin_b") * F.col("sin_b") + F.col("cos_b") * F.col("cos_b") - 1)
    return d.agg(F.count("*").alias("n"), (F.max(one) < 1e-9).alias("unit_circle"), F.count_if(~F.col("in_view")).alias("n_out"),
                 F.count_if(~F.col("in_view") & F.col("near_toward").isNotNull()).alias("n_bad"))


@query("v06_angle_vector", f"""
WITH {SCAN} SELECT slot, round(min(-110 + 3.5*slot), 6) AS angle_deg, min(-110 + 3.5*slot) BETWEEN -30 AND 30 AS in_front, count(*) AS n FROM beam GROUP BY 1""")
def v06(spark, sf):
    d = scan(spark, sf).select(F.posexplode("distances").alias("slot", "mm"))
    lo, hi = BEAMS.slots_between(-30, 30)
    return d.groupBy(F.col("slot").cast("long").alias("slot")).agg(F.count("*").alias("n")).select(
        "slot", rnd(BEAMS.angle(F.col("slot"))).alias("angle_deg"), F.col("slot").between(lo, hi).alias("in_front"), "n")


@query("v07_cosine_and_rmse", """
WITH e AS (SELECT a.vec_id, generate_subscripts(a.embedding, 1) AS i, unnest(a.embedding)::DOUBLE AS x, unnest(b.embedding)::DOUBLE AS y
  FROM embeddings a JOIN embeddings b ON b.vec_id = a.vec_id + 1)
SELECT vec_id, round(sum(x*y)/sqrt(sum(x*x)*sum(y*y)), 6) AS cosine, round(sqrt(avg((x-y)*(x-y))), 6) AS rmse FROM e GROUP BY 1""")
def v07(spark, sf):
    e = table(spark, sf, "embeddings")
    b = e.select((F.col("vec_id") - 1).alias("vec_id"), F.col("embedding").alias("other"))
    return e.join(b, "vec_id").select("vec_id", rnd(cosine("embedding", "other")).alias("cosine"), rnd(rmse("embedding", "other")).alias("rmse"))


@query("f03_sentinel_to_missing", f"""
WITH {SCAN} SELECT scan_row, count(*) AS n_slots, count(CASE WHEN {OK} THEN mm END) AS n_present, CAST(sum(CASE WHEN {OK} THEN mm END) AS BIGINT) AS total FROM beam GROUP BY 1""")
def f03(spark, sf):
    d = scan(spark, sf).select("scan_row", F.posexplode(masked("distances")).alias("slot", "mm"))
    return d.groupBy("scan_row").agg(F.count("*").alias("n_slots"), F.count("mm").alias("n_present"), F.sum("mm").alias("total"))


BEAM_STATS = f"""
bs AS (SELECT slot, count(*) AS n, avg(CASE WHEN mm = 0 THEN 1.0 ELSE 0.0 END) AS zero_frac, avg(CASE WHEN mm = 65535 THEN 1.0 ELSE 0.0 END) AS far_frac,
  median(mm) FILTER ({OK}) AS median_mm, stddev_pop(mm) FILTER ({OK}) AS sd_mm FROM beam GROUP BY 1)"""


@query("a19_beam_statistics", f"""
WITH {SCAN}, {BEAM_STATS} SELECT slot, n, round(zero_frac, 6) AS zero_frac, round(far_frac, 6) AS far_frac, round(median_mm, 6) AS median_mm, round(sd_mm, 5) AS sd_mm FROM bs""")
def a19(spark, sf):
    b = beam_statistics(scan(spark, sf), [])
    return b.select(F.col("slot").cast("long").alias("slot"), "n", *[rnd(c).alias(c) for c in ("zero_frac", "far_frac", "median_mm")],
                    rnd("sd_mm", 5).alias("sd_mm"))


@query("a20_beam_masks", f"""
WITH {SCAN}, {BEAM_STATS}, m AS (SELECT slot, zero_frac > 0.06 AS always_zero, coalesce(median_mm < 1500 AND sd_mm < 1200, false) AS body, slot >= 60 AS padding FROM bs)
SELECT slot, always_zero, body, padding, NOT (always_zero OR body OR padding) AS usable,
  round(avg(CASE WHEN NOT (always_zero OR body OR padding) THEN 1.0 ELSE 0.0 END) OVER (), 6) AS valid_fraction FROM m""")
def a20(spark, sf):
    m = beam_masks(beam_statistics(scan(spark, sf), []), 0.06, 1500, 1200, 60)
    share = m.select(rnd(F.avg(F.col("usable").cast("double")))).scalar()
    return m.withColumn("slot", F.col("slot").cast("long")).withColumn("valid_fraction", share)


CELL5 = "CAST(floor(x_m/5) AS BIGINT) AS cx, CAST(floor(y_m/5) AS BIGINT) AS cy, CAST(floor(degrees(heading_rad)/90) AS BIGINT) AS hb"
LOW = f"lowr AS (SELECT joint.*, {CELL5} FROM joint WHERE abs(speed) < 0.35)"
PROFILE = f"""
{LOW}, hn AS (SELECT cx, cy, hb, count(*) FILTER (session_id = 's0') AS n_a, count(*) FILTER (session_id = 's1') AS n_b FROM lowr GROUP BY 1, 2, 3),
pick AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY cx, cy ORDER BY least(n_a, n_b) DESC, n_a DESC, n_b DESC, hb DESC) AS rn FROM hn) WHERE rn = 1 AND least(n_a, n_b) >= 8),
pb AS (SELECT cx, cy, session_id, slot, median(mm) AS mu FROM (SELECT cx, cy, session_id, generate_subscripts(distances, 1) - 1 AS slot, unnest(distances) AS mm
  FROM lowr JOIN pick USING (cx, cy, hb) WHERE session_id IN ('s0', 's1')) WHERE {OK} GROUP BY ALL),
cmp AS (SELECT cx, cy, count(*) AS n_beams, sqrt(avg((a.mu-b.mu)*(a.mu-b.mu))) AS rmse, sum(a.mu*b.mu)/sqrt(sum(a.mu*a.mu)*sum(b.mu*b.mu)) AS cosine
  FROM pb a JOIN pb b USING (cx, cy, slot) WHERE a.session_id = 's0' AND b.session_id = 's1' GROUP BY 1, 2 HAVING count(*) >= 20)"""


def low_rows(spark, sf):
    n = table(spark, sf, "embeddings").select(F.count("*")).scalar()
    d = telemetry(spark, sf).filter(F.abs("speed") < 0.35).withColumn("scan_row", F.col("joint_idx") % n)
    return with_cells(d, 5.0).withColumn("hb", cell(F.degrees("heading_rad"), 90))


def pair_profiles(spark, sf):
    d = low_rows(spark, sf)
    best = common_heading(d, "session_id", "s0", "s1", 8)
    rows = d.join(best, ["cx", "cy", "hb"])
    s = scan(spark, sf)
    a, b = (beam_profiles(rows.filter(F.col("session_id") == v), s, ["cx", "cy"]) for v in ("s0", "s1"))
    return profile_distance(a, b, ["cx", "cy"], 20).join(best, ["cx", "cy"])


# A scanner that sees the whole circle, its valid sector, uneven sectors, and the mask that its beams' statistics give.
RING, VIEW, BOUNDS = Beams(-180.0, 5.625, 64), (-25.0, 160.0), [(-180.0, -120.5), (-120.5, -40.0), (-40.0, 40.0), (40.0, 174.375)]
MASK = f"""
{BEAM_STATS.strip()},
mask AS (SELECT slot FROM bs WHERE NOT (zero_frac > 0.06 OR coalesce(median_mm < 1500 AND sd_mm < 1200, false) OR slot >= 60)),
seen AS (SELECT beam.*, -180 + 5.625*slot AS deg, {OK} AND slot IN (SELECT slot FROM mask) AS ok FROM beam)"""


def learned_mask(spark, sf):
    return usable_slots(beam_masks(beam_statistics(scan(spark, sf), []), 0.06, 1500, 1200, 60))


@query("f03_masked_readings", f"""
WITH {SCAN}, {MASK} SELECT scan_row, count(*) FILTER (ok) AS n_present, CAST(sum(mm) FILTER (ok) AS BIGINT) AS total, count(*) FILTER ({OK}) AS n_unmasked FROM seen GROUP BY 1""")
def f03_masked(spark, sf):
    d = scan(spark, sf).select("scan_row", F.arrays_zip(masked(kept_slots("distances", learned_mask(spark, sf))).alias("a"), masked("distances").alias("b")).alias("z"))
    d = d.select("scan_row", F.inline("z"))
    return d.groupBy("scan_row").agg(F.count("a").alias("n_present"), F.sum("a").alias("total"), F.count("b").alias("n_unmasked"))


@query("v01_masked_scan_scalars", f"""
WITH {SCAN}, {MASK} SELECT scan_row, count(*) FILTER (ok) AS n_valid, round(avg(mm) FILTER (ok), 6) AS mean_mm, round(quantile_cont(mm, 0.9) FILTER (ok), 6) AS p90_mm,
 round(count(*) FILTER (ok AND mm < 1000)/greatest(count(*) FILTER (ok), 1), 6) AS near_frac, round(count(*) FILTER (ok AND mm > 4000)/greatest(count(*) FILTER (ok), 1), 6) AS open_frac,
 round(avg(mm) FILTER (ok AND deg BETWEEN -25 AND 30), 6) AS mean_front_mm FROM seen GROUP BY 1""")
def v01_masked(spark, sf):
    d = scan_scalars(scan(spark, sf), RING, NEAR, FAR, CLIP, usable=learned_mask(spark, sf), view=VIEW)
    return d.select("scan_row", F.col("n_valid").cast("long").alias("n_valid"), *[
        rnd(c).alias(c) for c in ("mean_mm", "p90_mm", "near_frac", "open_frac", "mean_front_mm")])


@query("v03_sectors_from_bounds", f"""
WITH {SCAN}, {MASK} SELECT scan_row, """ + ", ".join(
    f"count(*) FILTER (ok AND deg >= {lo} AND deg {'<=' if i == len(BOUNDS) else '<'} {hi}) AS n_s{i}, round(avg(mm) FILTER (ok AND deg >= {lo} AND deg {'<=' if i == len(BOUNDS) else '<'} {hi}), 6) AS mean_s{i}, "
    f"round(count(*) FILTER (ok AND mm < 1000 AND deg >= {lo} AND deg {'<=' if i == len(BOUNDS) else '<'} {hi})/nullif(count(*) FILTER (ok AND deg >= {lo} AND deg {'<=' if i == len(BOUNDS) else '<'} {hi}), 0), 6) AS near_s{i}"
    for i, (lo, hi) in enumerate(BOUNDS, 1)) + " FROM seen GROUP BY 1")
def v03_bounds(spark, sf):
    d = sector_features(scan(spark, sf), RING, BOUNDS, NEAR, usable=learned_mask(spark, sf))
    return d.select("scan_row", *[c for i in range(1, len(BOUNDS) + 1) for c in (
        F.col(f"n_s{i}").cast("long").alias(f"n_s{i}"), rnd(f"mean_s{i}").alias(f"mean_s{i}"), rnd(f"near_s{i}").alias(f"near_s{i}"))])


@query("v04_circular_cone_in_sector", f"""
WITH {TEL}, {SCAN}, {AP}, {GEO.format(src="tel")}, {MASK}, hit AS (SELECT joint_idx, count(*) FILTER (mm < 1000)/count(*) AS near_toward, count(*) AS n_slots
  FROM geo CROSS JOIN (SELECT count(*) AS n_scan FROM embeddings) c JOIN seen ON seen.scan_row = geo.joint_idx % c.n_scan
  WHERE ok AND deg BETWEEN -25 AND 160 AND abs(deg - degrees(bearing) - 360*round((deg - degrees(bearing))/360)) <= 40 GROUP BY 1)
SELECT g.joint_idx, round(near_toward, 6) AS near_toward, abs(degrees(bearing)) > 140 AS wraps FROM geo g LEFT JOIN hit USING (joint_idx)""")
def v04_ring(spark, sf):
    bits = scan_bitmaps(scan(spark, sf), RING, NEAR, learned_mask(spark, sf)).select("scan_row", "ok_bits", "near_bits")
    d = scan_of(spark, sf).withColumn("in_view", F.lit(True)).join(bits, "scan_row")
    d = near_share_toward(d, RING, 40.0, "near_toward", VIEW)
    return d.select("joint_idx", rnd("near_toward").alias("near_toward"), (F.abs(F.degrees("bearing")) > 140).alias("wraps"))


@query("a21_beam_profile_comparison", f"""
WITH {JOINT}, {PROFILE} SELECT cx, cy, hb, n_a, n_b, n_beams, round(rmse, 5) AS rmse, round(cosine, 6) AS cosine FROM cmp JOIN pick USING (cx, cy)""")
def a21(spark, sf):
    return pair_profiles(spark, sf).select("cx", "cy", "hb", "n_a", "n_b", "n_beams", rnd("rmse", 5).alias("rmse"), rnd("cosine").alias("cosine"))


SPLIT = f"""
hr AS (SELECT *, row_number() OVER (PARTITION BY cx, cy, hb ORDER BY md5(concat_ws('|', 'halves', joint_idx)), joint_idx) AS rn, count(*) OVER (PARTITION BY cx, cy, hb) AS n
  FROM lowr WHERE session_id = 's0'),
top AS (SELECT cx, cy, max((n, hb)) AS t FROM hr GROUP BY 1, 2),
hh AS (SELECT hr.*, CASE WHEN rn <= n//2 THEN 1 WHEN rn <= 2*(n//2) THEN 2 END AS half FROM hr JOIN top USING (cx, cy) WHERE (n, hb) = t AND n >= 16),
hp AS (SELECT cx, cy, half, slot, median(mm) AS mu FROM (SELECT cx, cy, half, generate_subscripts(distances, 1) - 1 AS slot, unnest(distances) AS mm FROM hh WHERE half IS NOT NULL)
  WHERE {OK} GROUP BY ALL),
hc AS (SELECT cx, cy, sqrt(avg((a.mu-b.mu)*(a.mu-b.mu))) AS rmse FROM hp a JOIN hp b USING (cx, cy, slot) WHERE a.half = 1 AND b.half = 2 GROUP BY 1, 2 HAVING count(*) >= 20)"""


def half_noise(spark, sf):
    d = low_rows(spark, sf).filter("session_id = 's0'")
    n = d.groupBy("cx", "cy", "hb").agg(F.count("*").alias("n"))
    top = (n.groupBy("cx", "cy").agg(F.max(F.struct("n", "hb")).alias("t")).filter("t.n >= 16").select("cx", "cy", "t.hb"))
    h = split_half(d.join(top, ["cx", "cy", "hb"]), ["cx", "cy", "hb"], "halves", "joint_idx")
    s = scan(spark, sf)
    a, b = (beam_profiles(h.filter(F.col("half") == i), s, ["cx", "cy"]) for i in (1, 2))
    return profile_distance(a, b, ["cx", "cy"], 20)


def floor_of(halves):
    """Median split-half distance; 1000 mm where no cell qualifies."""
    return F.coalesce(exact_quantiles(halves, [], "rmse", {"m": 0.5}).scalar(), F.lit(1000.0))


@query("a22_split_half_noise_floor", f"""
WITH {JOINT}, {LOW}, {SPLIT} SELECT count(*) AS n_cells, round(coalesce(median(rmse), 1000), 5) AS noise_floor FROM hc""")
def a22(spark, sf):
    h = stored(half_noise(spark, sf).select("rmse"))
    return h.agg(F.count("*").alias("n_cells")).withColumn("noise_floor", rnd(floor_of(h), 5))


@query("m14_gate_zero_profiles", f"""
WITH {JOINT}, {PROFILE}, {SPLIT}, z AS (SELECT (SELECT median(rmse) FROM cmp) AS r, (SELECT median(cosine) FROM cmp) AS c, greatest(coalesce((SELECT median(rmse) FROM hc), 1000), 100) AS f)
SELECT round(r, 5) AS median_rmse, round(c, 6) AS median_cosine, round(f, 5) AS floor_mm,
  CASE WHEN c > 0.95 AND r < 6*f THEN 'GREEN' WHEN c < 0.7 OR r > 12*f THEN 'RED' ELSE 'YELLOW' END AS gate FROM z""")
def m14z(spark, sf):
    from scanweave.operators.rules import profile_gate
    p = stored(pair_profiles(spark, sf).select("rmse", "cosine"))
    h = stored(half_noise(spark, sf).select("rmse"))
    m = exact_quantiles(p, [], "rmse", {"r": 0.5}).withColumn("c", exact_quantiles(p, [], "cosine", {"c": 0.5}).scalar())
    m = m.withColumn("f", F.greatest(floor_of(h), F.lit(100.0)))
    return m.select(rnd("r", 5).alias("median_rmse"), rnd("c").alias("median_cosine"), rnd("f", 5).alias("floor_mm"),
                    profile_gate(F.col("c"), F.col("r"), F.col("f")).alias("gate"))


# Scan table as a source: two parallel datasets, the shorter one decides.
RAW = SCAN + """,
stamp AS (SELECT event_id AS src_row, 's' || CAST(user_id % 3 AS VARCHAR) AS file, CASE WHEN event_id % 97 = 5 THEN 0 ELSE epoch_us(ts)/1e6 END AS utc_s, event_id % 65536 AS counter FROM events),
merged AS (SELECT src_row, file, distances, utc_s + 3600 AS local_s, utc_s, counter FROM scan JOIN stamp ON src_row = scan_row WHERE utc_s > 1e8)"""


def stamps(spark, sf):
    return events(spark, sf).select(
        F.col("event_id").alias("src_row"), F.concat(F.lit("s"), (F.col("user_id") % 3).cast("string")).alias("file"),
        F.when(F.col("event_id") % 97 == 5, 0.0).otherwise(F.col("us") / 1e6).alias("utc_s"), (F.col("event_id") % 65536).alias("counter"))


def merged(spark, sf):
    from scanweave.sources.scans import merge_scans
    return merge_scans(scan(spark, sf).withColumnRenamed("scan_row", "src_row"), stamps(spark, sf), "src_row", "utc_s", 1e8, 3600.0)


@query("s06_scan_array_merge", f"""
WITH {RAW} SELECT src_row, file, round(local_s, 6) AS local_s, round(utc_s, 6) AS utc_s, counter, len(distances) AS n_slots FROM merged""")
def s06(spark, sf):
    return merged(spark, sf).select("src_row", "file", rnd("local_s").alias("local_s"), rnd("utc_s").alias("utc_s"), "counter",
                                    F.size("distances").cast("long").alias("n_slots"))


@query("s08_gather_scans_by_row", f"""
WITH {SCAN}, r AS (SELECT event_id AS pos, (event_id*7) % (SELECT count(*) FROM embeddings) AS scan_row FROM events WHERE event_type = 'error')
SELECT pos, scan_row, list_sum(distances)::BIGINT AS total FROM r JOIN scan USING (scan_row)""")
def s08(spark, sf):
    from scanweave.sources.scans import gather
    n = table(spark, sf, "embeddings").select(F.count("*")).scalar()
    r = events(spark, sf).filter("event_type = 'error'").select(F.col("event_id").alias("pos"), ((F.col("event_id") * 7) % n).alias("scan_row"))
    d = gather(scan(spark, sf), r, "scan_row", "pos")
    return d.select("pos", "scan_row", F.aggregate("distances", F.lit(0).cast("long"), lambda s, x: s + x).alias("total"))


@query("s09_full_scan", f"WITH {SCAN} SELECT label, count(DISTINCT scan_row) AS n, CAST(sum(mm) AS BIGINT) AS total FROM (SELECT scan_row, mm FROM beam) JOIN scan USING (scan_row) GROUP BY 1")
def s09(spark, sf):
    total = F.aggregate("distances", F.lit(0).cast("long"), lambda s, x: s + x)
    return scan(spark, sf).groupBy("label").agg(F.count("*").alias("n"), F.sum(total).alias("total"))


@query("j13_index_lookup_identity", f"""
WITH {RAW}, j AS (SELECT event_id, event_id % (SELECT count(*) FROM embeddings) AS src_row FROM events)
SELECT count(*) AS n, count(m.src_row) AS n_found, round(max(abs(s.utc_s - m.utc_s)), 6) AS max_diff, count(*) FILTER (s.counter <> m.counter) AS n_counter_off
FROM j JOIN stamp s USING (src_row) LEFT JOIN merged m USING (src_row)""")
def j13(spark, sf):
    n = table(spark, sf, "embeddings").select(F.count("*")).scalar()
    j = events(spark, sf).select((F.col("event_id") % n).alias("src_row")).join(stamps(spark, sf), "src_row")
    m = merged(spark, sf).select("src_row", F.col("utc_s").alias("mu"), F.col("counter").alias("mc"), F.lit(1).alias("hit"))
    return j.join(m, "src_row", "left").agg(
        F.count("*").alias("n"), F.count("hit").alias("n_found"), rnd(F.max(F.abs(F.col("utc_s") - F.col("mu")))).alias("max_diff"),
        F.count_if(F.col("counter") != F.col("mc")).alias("n_counter_off"))


@query("q13_scan_table_vs_source", f"""
WITH {RAW} SELECT file, count(*) AS n_source, count(m.src_row) AS n_kept, count(*) - count(m.src_row) AS n_dropped,
  count(*) FILTER (m.distances = s.distances) AS n_equal, coalesce(max(abs(m.local_s - m.utc_s - 3600)) < 1e-6, true) AS offset_ok, min(src_row) AS first_row, max(src_row) AS last_row
FROM (SELECT src_row, stamp.file, distances FROM stamp JOIN scan ON src_row = scan_row) s LEFT JOIN (SELECT src_row, distances, local_s, utc_s FROM merged) m USING (src_row) GROUP BY 1""")
def q13(spark, sf):
    s = scan(spark, sf).select(F.col("scan_row").alias("src_row"), F.col("distances").alias("d0")).join(
        stamps(spark, sf).select("src_row", "file"), "src_row")
    m = merged(spark, sf).select("src_row", F.col("distances").alias("d1"), "local_s", "utc_s", F.lit(1).alias("hit"))
    off = F.max(F.abs(F.col("local_s") - F.col("utc_s") - 3600))
    return s.join(m, "src_row", "left").groupBy("file").agg(
        F.count("*").alias("n_source"), F.count("hit").alias("n_kept"), (F.count("*") - F.count("hit")).alias("n_dropped"),
        F.count_if(F.col("d0") == F.col("d1")).alias("n_equal"), F.coalesce(off < 1e-6, F.lit(True)).alias("offset_ok"),
        F.min("src_row").alias("first_row"), F.max("src_row").alias("last_row"))


@query("q09_features_recomputed", f"""
WITH {SCAN} SELECT count(DISTINCT scan_row) AS n_scans, true AS mean_ok, true AS p90_ok, true AS near_ok FROM beam""")
def q09(spark, sf):
    """Array-expression features against an exploded second formulation."""
    a = scalars(spark, sf).select("scan_row", "mean_mm", "p90_mm", "near_frac")
    b = scan(spark, sf).select("scan_row", F.explode("distances").alias("mm")).filter("mm NOT IN (0, 65535)").groupBy("scan_row").agg(
        F.avg("mm").alias("m"), F.percentile("mm", F.lit(0.9)).alias("p"), F.avg((F.col("mm") < NEAR).cast("double")).alias("c"))
    close = lambda x, y: F.max(F.abs(F.col(x) - F.col(y))) < 1e-6
    return a.join(b, "scan_row").agg(F.count("*").alias("n_scans"), close("mean_mm", "m").alias("mean_ok"),
                                     close("p90_mm", "p").alias("p90_ok"), close("near_frac", "c").alias("near_ok"))
