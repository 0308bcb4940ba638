"""Queries over spatial cells, radii and regions."""

from __future__ import annotations

from pyspark.sql import functions as F

from scanweave.functions.exprs import cell, rnd
from scanweave.operators.cells import (cell_overlap, cell_stats, nearest_of, outside_radius, semivariogram,
                                       variogram_range, with_cells)
from scanweave.operators.quantiles import exact_quantiles
from scanweave.operators.rules import level_gate
from scanweave.operators.sequence import sample_gaps
from scanweave.plans.registry import query
from scanweave.plans.views import table, telemetry, TEL
from scanweave.session import stored

W = 2.0
CELLS = "CAST(floor(x_m/2) AS BIGINT) AS cx, CAST(floor(y_m/2) AS BIGINT) AS cy"
STATS = f"""
cs AS (SELECT session_id, {CELLS}, avg(signal) AS mean, count(signal) AS n, stddev_samp(signal) AS sd FROM tel GROUP BY ALL)"""


def stats(spark, sf):
    return cell_stats(telemetry(spark, sf), ["session_id"], "signal", W)


@query("a03_cell_mean", f"WITH {TEL}, {STATS} SELECT session_id, cx, cy, round(mean, 6) AS mean, n FROM cs")
def a03(spark, sf):
    return stats(spark, sf).select("session_id", "cx", "cy", rnd("mean").alias("mean"), "n")


@query("a03_cell_mean_lineitem", """
SELECT CAST(floor(l_quantity/5) AS BIGINT) AS cx, CAST(floor(l_discount/0.025) AS BIGINT) AS cy, count(*) AS n,
  round(avg(l_extendedprice), 4) AS mean, round(stddev_samp(l_extendedprice), 4) AS sd FROM lineitem GROUP BY 1, 2""")
def a03l(spark, sf):
    d = table(spark, sf, "lineitem")
    return d.groupBy(cell("l_quantity", 5).alias("cx"), cell("l_discount", 0.025).alias("cy")).agg(
        F.count("*").alias("n"), rnd(F.avg("l_extendedprice"), 4).alias("mean"),
        rnd(F.stddev_samp("l_extendedprice"), 4).alias("sd"))


@query("a04_within_cell_noise_floor", f"""
WITH {TEL}, {STATS} SELECT coalesce(session_id, 'all') AS session_id, count(*) AS n_cells, round(avg(sd), 6) AS sigma FROM cs
WHERE n >= 20 GROUP BY ROLLUP(session_id) HAVING count(*) > 0""")
def a04(spark, sf):
    s = stats(spark, sf).filter("n >= 20").rollup("session_id").agg(F.count("*").alias("n_cells"), rnd(F.avg("sd")).alias("sigma"))
    return s.select(F.coalesce("session_id", F.lit("all")).alias("session_id"), "n_cells", "sigma")


@query("a05_low_speed_dwell", f"""
WITH {TEL}, low AS (SELECT *, (us - lag(us) OVER (PARTITION BY session_id ORDER BY us, joint_idx))/1e6 AS dt FROM tel WHERE abs(speed) < 0.35),
m AS (SELECT session_id, median(dt) AS dt FROM low GROUP BY 1),
c AS (SELECT session_id, {CELLS}, count(*) AS n FROM low GROUP BY ALL)
SELECT session_id, cx, cy, n, round(n*dt, 3) AS dwell_s FROM c JOIN m USING (session_id)""")
def a05(spark, sf):
    low = telemetry(spark, sf).filter(F.abs("speed") < 0.35)
    m = exact_quantiles(sample_gaps(low, ["session_id"], "us", "joint_idx", 86400), ["session_id"], "dt_s", {"dt": 0.5})
    c = with_cells(low, W).groupBy("session_id", "cx", "cy").agg(F.count("*").alias("n"))
    return c.join(m, "session_id").select("session_id", "cx", "cy", "n", rnd(F.col("n") * F.col("dt"), 3).alias("dwell_s"))


REGION = [(1, 3.0, 3.0), (2, 10.0, 2.0), (3, 16.0, 4.0), (4, 6.0, 9.0), (5, 15.0, 9.5)]
REGION_SQL = "reg AS (SELECT tel.*, (SELECT lab FROM (VALUES " + ", ".join(
    f"({a}, CAST({x} AS DOUBLE), CAST({y} AS DOUBLE))" for a, x, y in REGION) + \
    ") c(lab, px, py) ORDER BY (x_m-px)*(x_m-px)+(y_m-py)*(y_m-py), lab LIMIT 1) AS region_id FROM tel)"


def regions(spark, sf):
    return telemetry(spark, sf).withColumn("region_id", nearest_of(REGION))


@query("j09_nearest_centroid", f"WITH {TEL}, {REGION_SQL} SELECT joint_idx, region_id FROM reg")
def j09(spark, sf):
    return regions(spark, sf).select("joint_idx", "region_id")


@query("a06_region_summary", f"""
WITH {TEL}, {REGION_SQL} SELECT region_id, count(*) AS n, count(DISTINCT (round_even(x_m, 1), round_even(y_m, 1))) AS n_positions,
  round(avg(CASE WHEN abs(heading_rad) <= 1.92 THEN 1.0 ELSE 0.0 END), 6) AS fov_share, round(min(x_m), 4) AS x_min, round(max(x_m), 4) AS x_max,
  round(min(y_m), 4) AS y_min, round(max(y_m), 4) AS y_max, round(avg(signal), 6) AS signal_mean, round(stddev_samp(signal), 6) AS signal_sd
FROM reg GROUP BY 1""")
def a06(spark, sf):
    r = regions(spark, sf)
    return r.groupBy("region_id").agg(
        F.count("*").alias("n"), F.countDistinct(F.bround("x_m", 1), F.bround("y_m", 1)).alias("n_positions"),
        rnd(F.avg((F.abs("heading_rad") <= 1.92).cast("double"))).alias("fov_share"), rnd(F.min("x_m"), 4).alias("x_min"),
        rnd(F.max("x_m"), 4).alias("x_max"), rnd(F.min("y_m"), 4).alias("y_min"), rnd(F.max("y_m"), 4).alias("y_max"),
        rnd(F.avg("signal")).alias("signal_mean"), rnd(F.stddev_samp("signal")).alias("signal_sd"))


DELTAS = STATS + """,
dl AS (SELECT cx, cy, a.mean AS mean_a, b.mean AS mean_b, a.n AS n_a, b.n AS n_b, a.mean - b.mean AS delta FROM cs a JOIN cs b USING (cx, cy)
  WHERE a.session_id = 's0' AND b.session_id = 's1')"""


def deltas(spark, sf):
    s = stats(spark, sf)
    a, b = (s.filter(F.col("session_id") == v).select("cx", "cy", F.col("mean").alias(f"mean_{n}"), F.col("n").alias(f"n_{n}"))
            for v, n in (("s0", "a"), ("s1", "b")))
    return a.join(b, ["cx", "cy"]).withColumn("delta", F.col("mean_a") - F.col("mean_b"))


@query("j05_cell_aggregate_join", f"""
WITH {TEL}, {DELTAS} SELECT cx, cy, round(mean_a, 6) AS mean_a, round(mean_b, 6) AS mean_b, n_a, n_b, round(delta, 6) AS delta FROM dl""")
def j05(spark, sf):
    return deltas(spark, sf).select("cx", "cy", rnd("mean_a").alias("mean_a"), rnd("mean_b").alias("mean_b"), "n_a", "n_b",
                                    rnd("delta").alias("delta"))


@query("a07_delta_quartiles_and_gate", f"""
WITH {TEL}, {DELTAS}, q AS (SELECT count(*) AS n_cells, quantile_cont(abs(delta), 0.5) AS med, quantile_cont(abs(delta), 0.25) AS q1,
  quantile_cont(abs(delta), 0.75) AS q3 FROM dl WHERE n_a >= 5 AND n_b >= 5)
SELECT n_cells, round(med, 6) AS median_abs, round(q1, 6) AS q1, round(q3, 6) AS q3,
  CASE WHEN med < 0.5 THEN 'GREEN' WHEN med < 2 THEN 'YELLOW' ELSE 'RED' END AS gate FROM q""")
def a07(spark, sf):
    d = stored(deltas(spark, sf).filter("n_a >= 5 AND n_b >= 5").select(F.abs("delta").alias("d")))
    q = exact_quantiles(d, [], "d", {"q1": 0.25, "median_abs": 0.5, "q3": 0.75})
    return q.withColumn("n_cells", d.select(F.count("*")).scalar()).select(
        "n_cells", rnd("median_abs").alias("median_abs"), rnd("q1").alias("q1"), rnd("q3").alias("q3"),
        level_gate(F.col("median_abs"), 0.5, 2.0).alias("gate"))


@query("j11_semi_join_qualifying_cells", f"""
WITH {TEL}, {STATS}, ok AS (SELECT cx, cy FROM cs WHERE n >= 20 GROUP BY 1, 2 HAVING count(DISTINCT session_id) = 3),
t AS (SELECT tel.*, {CELLS} FROM tel) SELECT session_id, count(*) AS n, round(avg(signal), 6) AS mean FROM t SEMI JOIN ok USING (cx, cy) GROUP BY 1""")
def j11(spark, sf):
    ok = stats(spark, sf).filter("n >= 20").groupBy("cx", "cy").agg(F.count("*").alias("k")).filter("k = 3")
    d = with_cells(telemetry(spark, sf), W).join(ok, ["cx", "cy"], "left_semi")
    return d.groupBy("session_id").agg(F.count("*").alias("n"), rnd(F.avg("signal")).alias("mean"))


@query("u02_cell_overlap_iou", f"""
WITH {TEL}, c AS (SELECT DISTINCT session_id, CAST(floor(x_m/0.5) AS BIGINT) AS cx, CAST(floor(y_m/0.5) AS BIGINT) AS cy FROM tel),
p AS (SELECT a.session_id AS a, b.session_id AS b FROM (SELECT DISTINCT session_id FROM c) a JOIN (SELECT DISTINCT session_id FROM c) b ON a.session_id < b.session_id),
z AS (SELECT a, b, (SELECT count(*) FROM c WHERE session_id = a) AS n_a, (SELECT count(*) FROM c WHERE session_id = b) AS n_b,
  (SELECT count(*) FROM (SELECT cx, cy FROM c WHERE session_id = a INTERSECT SELECT cx, cy FROM c WHERE session_id = b)) AS shared FROM p)
SELECT a, b, n_a, n_b, shared, n_a + n_b - shared AS n_union, n_a - shared AS only_a, n_b - shared AS only_b,
  round(shared/(n_a + n_b - shared), 6) AS iou, round(100*shared/n_a, 6) AS pct_a_in_b, round(100*shared/n_b, 6) AS pct_b_in_a FROM z""")
def u02(spark, sf):
    o = cell_overlap(telemetry(spark, sf), "session_id", 0.5)
    return o.select("a", "b", "n_a", "n_b", "shared", "n_union", "only_a", "only_b",
                    *[rnd(c).alias(c) for c in ("iou", "pct_a_in_b", "pct_b_in_a")])


LAGS = [0.5, 1.0, 2.0, 3.0, 5.0, 10.0, 20.0]  # fixed values, metres
VARIO = f"""
pairs AS (SELECT a.session_id, sqrt((a.x_m-b.x_m)*(a.x_m-b.x_m)+(a.y_m-b.y_m)*(a.y_m-b.y_m)) AS d, (a.signal-b.signal)*(a.signal-b.signal) AS s2
  FROM tel a JOIN tel b ON a.session_id = b.session_id AND a.joint_idx < b.joint_idx),
gam AS (SELECT session_id, h AS lag, count(*) AS n_pairs, CASE WHEN count(*) >= 30 THEN avg(s2)/2 END AS gamma
  FROM pairs JOIN (SELECT unnest({LAGS})::DOUBLE AS h) l ON d BETWEEN h - 0.25*h AND h + 0.25*h GROUP BY 1, 2)"""


@query("j10_a18_semivariogram", f"WITH {TEL}, {VARIO} SELECT session_id, lag, n_pairs, round(gamma, 5) AS gamma FROM gam")
def a18(spark, sf):
    g = semivariogram(telemetry(spark, sf), ["session_id"], "signal", LAGS)
    return g.select("session_id", "lag", "n_pairs", rnd("gamma", 5).alias("gamma"))


@query("a18_variogram_range", f"""
WITH {TEL}, {VARIO}, m AS (SELECT session_id, max(gamma) AS g FROM gam GROUP BY 1)
SELECT session_id, round(g, 5) AS gamma_max, min(lag) FILTER (gamma >= 0.95*g) AS range_m FROM gam JOIN m USING (session_id) GROUP BY 1, g""")
def a18r(spark, sf):
    g = stored(semivariogram(telemetry(spark, sf), ["session_id"], "signal", LAGS))
    return variogram_range(g, ["session_id"]).select("session_id", rnd("gamma_max", 5).alias("gamma_max"), "range_m")


@query("j08_radius_anti_join", f"""
WITH {TEL}, held AS (SELECT session_id, x_m, y_m FROM tel WHERE event_type = 'error' AND x_m BETWEEN 4 AND 9 AND y_m < 6)
SELECT joint_idx, session_id FROM tel t WHERE event_type <> 'error' AND NOT EXISTS (SELECT 1 FROM held h WHERE h.session_id = t.session_id
  AND (t.x_m-h.x_m)*(t.x_m-h.x_m)+(t.y_m-h.y_m)*(t.y_m-h.y_m) <= 1.0)""")
def j08(spark, sf):
    t = telemetry(spark, sf)
    held = t.filter("event_type = 'error' AND x_m BETWEEN 4 AND 9 AND y_m < 6")
    return outside_radius(t.filter("event_type <> 'error'"), held, ["session_id"], 1.0).select("joint_idx", "session_id")


def farthest_sql(steps):
    ctes, chosen = [], "SELECT cx, cy FROM f1"
    for i in range(2, steps + 1):
        ctes.append(f"f{i} AS (SELECT cx, cy FROM (SELECT c.cx, c.cy, min(sqrt((c.cx-h.cx)*(c.cx-h.cx)+(c.cy-h.cy)*(c.cy-h.cy))) AS g FROM ok c, ({chosen}) h GROUP BY 1, 2) WHERE g > 0 ORDER BY g DESC, cx, cy LIMIT 1)")
        chosen += f" UNION ALL SELECT cx, cy FROM f{i}"
    union = " UNION ALL ".join(f"SELECT CAST({i} AS INT) AS step, cx, cy FROM f{i}" for i in range(1, steps + 1))
    return f"""WITH {TEL}, {STATS}, ok AS (SELECT DISTINCT cx, cy FROM cs WHERE n >= 20),
f1 AS (SELECT cx, cy FROM ok ORDER BY abs(cx) + abs(cy) DESC, cx, cy LIMIT 1), {", ".join(ctes)} {union}"""


@query("o04_farthest_first_cells", farthest_sql(6))
def o04(spark, sf):
    from scanweave.operators.sampling import farthest_first
    return farthest_first(stats(spark, sf).filter("n >= 20").select("cx", "cy").distinct(), 6)
