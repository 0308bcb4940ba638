"""Gaps, rates, islands, episodes and order checks."""

from __future__ import annotations

from pyspark.sql import functions as F

from scanweave.functions.exprs import PI, clip, rnd, time_bucket
from scanweave.operators.sequence import (angular_rate, backfill_leading, discontinuities, episode_mask,
                                          motion_signature, rolling_mean, sample_gaps, stop_episodes, true_runs)
from scanweave.operators.timeline import density_chunks, neighbours
from scanweave.plans.registry import query
from scanweave.plans.views import scan, telemetry, TEL, SCAN

DAY = 86400
H = 3_600_000_000


@query("w01_inter_sample_interval", f"""
WITH {TEL}, d AS (SELECT joint_idx, run_id, (us - lag(us) OVER (PARTITION BY run_id ORDER BY us, joint_idx)) / 1e6 AS dt FROM tel)
SELECT joint_idx, run_id, round(dt, 6) AS dt_s, coalesce(dt > 0 AND dt < 43200, false) AS is_clean FROM d""")
def w01(spark, sf):
    d = sample_gaps(telemetry(spark, sf), ["run_id"], "us", "joint_idx", DAY)
    return d.select("joint_idx", "run_id", rnd("dt_s").alias("dt_s"),
                    F.coalesce((F.col("dt_s") > 0) & (F.col("dt_s") < 43200), F.lit(False)).alias("is_clean"))


@query("w02_gap_detection", f"""
WITH {TEL}, d AS (SELECT session_id, (us - lag(us) OVER (PARTITION BY session_id ORDER BY us, joint_idx)) / 1e6 AS dt FROM tel)
SELECT session_id, count(*) FILTER (dt > 600) AS n_gaps, round(sum(dt) FILTER (dt > 600), 4) AS gap_s,
  round(max(dt), 6) AS longest_s FROM d GROUP BY 1""")
def w02(spark, sf):
    t = density_chunks(telemetry(spark, sf).select("session_id", "us", "joint_idx"), ["session_id"], "us")
    d = sample_gaps(t, ["session_id"], "us", "joint_idx", "_ck")
    gap = F.when(F.col("dt_s") > 600, F.col("dt_s"))
    return d.groupBy("session_id").agg(F.count(gap).alias("n_gaps"), rnd(F.sum(gap), 4).alias("gap_s"),
                                       rnd(F.max("dt_s")).alias("longest_s"))


RATE = """
lagged AS (SELECT *, heading_rad - lag(heading_rad) OVER w AS dh, (us - lag(us) OVER w) / 1e6 AS dt
  FROM tel WINDOW w AS (PARTITION BY session_id ORDER BY us, joint_idx)),
wr AS (SELECT *, dh + pi() - 2*pi()*floor((dh + pi())/(2*pi())) - pi() AS dw FROM lagged),
rate AS (SELECT *, CASE WHEN dt > 0 THEN least(greatest(dw/dt*60, -pi()), pi()) END AS turn_rate FROM wr)"""


def turn(spark, sf):
    # The stream is sparse, so the rate is per minute here.
    t = density_chunks(telemetry(spark, sf), ["session_id"], "us")
    d = angular_rate(t, ["session_id"], "us", "joint_idx", "heading_rad", "_ck").drop("_ck")
    return d.withColumn("turn_rate", clip(F.col("turn_rate") * 60, -PI, PI))


@query("w03_angular_rate", f"""
WITH {TEL}, {RATE} SELECT joint_idx, session_id, round(turn_rate, 6) AS turn_rate FROM rate""")
def w03(spark, sf):
    return turn(spark, sf).select("joint_idx", "session_id", rnd("turn_rate").alias("turn_rate"))


@query("w04_time_range_rolling_mean", f"""
WITH {TEL}, {RATE} SELECT joint_idx, session_id, round(avg(turn_rate) OVER (PARTITION BY session_id ORDER BY us
  RANGE BETWEEN 21599999999 PRECEDING AND CURRENT ROW), 6) AS turn_rate_mean FROM rate""")
def w04(spark, sf):
    d = rolling_mean(turn(spark, sf).select("joint_idx", "session_id", "us", "turn_rate"), ["session_id"], "us", "turn_rate", 6 * 3600, "m")
    return d.select("joint_idx", "session_id", rnd("m").alias("turn_rate_mean"))


@query("w05_backfill_leading", f"""
WITH {TEL}, {RATE}, m AS (SELECT joint_idx, session_id, us, CASE WHEN joint_idx % 7 = 3 OR us < 1704067200000000 + 86400000000 THEN NULL
   ELSE turn_rate END AS v FROM rate),
f AS (SELECT session_id, arg_min(v, us) AS v0, min(us) AS us0 FROM m WHERE v IS NOT NULL GROUP BY 1)
SELECT joint_idx, session_id, round(CASE WHEN v IS NULL AND us < us0 THEN v0 ELSE v END, 6) AS turn_rate
FROM m LEFT JOIN f USING (session_id)""")
def w05(spark, sf):
    hole = (F.col("joint_idx") % 7 == 3) | (F.col("us") < 1704067200000000 + 24 * H)
    d = turn(spark, sf).withColumn("turn_rate", F.when(~hole, F.col("turn_rate")))
    d = backfill_leading(d, ["session_id"], ["us", "joint_idx"], "turn_rate")
    return d.select("joint_idx", "session_id", rnd("turn_rate").alias("turn_rate"))


STOPS = """
ch AS (SELECT *, CASE WHEN (speed < 0.35) IS NOT DISTINCT FROM lag(speed < 0.35) OVER w AND row_number() OVER w > 1
   THEN 0 ELSE 1 END AS c,
  coalesce(lag(x_m) OVER w, x_m) AS px, coalesce(lag(y_m) OVER w, y_m) AS py,
  coalesce(lead(x_m) OVER w, x_m) AS nx, coalesce(lead(y_m) OVER w, y_m) AS ny
  FROM tel WINDOW w AS (PARTITION BY run_id ORDER BY us, joint_idx)),
isl AS (SELECT *, sum(c) OVER (PARTITION BY run_id ORDER BY us, joint_idx) AS island FROM ch),
runs AS (SELECT run_id, CAST(island AS BIGINT) AS island, min(session_id) AS session_id, min(us) AS start_us, max(us) AS end_us,
  count(*) AS n_rows, arg_min(px, us) AS x0, arg_min(py, us) AS y0, arg_max(nx, us) AS x1, arg_max(ny, us) AS y1,
  min(confidence) AS cmin, bool_or(confidence IS NULL) AS cnull, bool_or(event_type = 'error') AS err_raised
  FROM isl WHERE speed < 0.35 GROUP BY 1, 2 HAVING max(us) - min(us) >= 3600000000)"""

EPISODES = STOPS + """,
cst AS (SELECT session_id, median(confidence) AS med, stddev_pop(confidence) AS sd FROM tel GROUP BY 1),
ep1 AS (SELECT runs.*, sqrt((x1-x0)*(x1-x0)+(y1-y0)*(y1-y0)) AS move_m,
  cnull OR coalesce(sd > 0 AND med - cmin >= 1.5*sd, false) AS conf_dropped FROM runs JOIN cst USING (session_id)),
ep AS (SELECT *, CASE WHEN move_m > 8 OR conf_dropped THEN 'manual_reposition' WHEN err_raised THEN 'motor_overheat'
  ELSE 'routine' END AS kind FROM ep1)"""


def stops(spark, sf):
    return true_runs(telemetry(spark, sf), ["run_id"], "us", "joint_idx", F.col("speed") < 0.35, DAY, 3600)


@query("w06_islands_min_duration", f"""
WITH {TEL}, {STOPS} SELECT run_id, island, start_us, end_us, n_rows,
  island = arg_max(island, (end_us - start_us, -island)) OVER (PARTITION BY run_id) AS is_longest FROM runs""")
def w06(spark, sf):
    s = stops(spark, sf)
    best = s.groupBy("run_id").agg(F.max_by("island", F.struct(F.col("end_us") - F.col("start_us"), -F.col("island")))
                                   .alias("b"))
    return s.join(best, "run_id").select("run_id", "island", "start_us", "end_us", "n_rows",
                                         (F.col("island") == F.col("b")).alias("is_longest"))


@query("w06b_islands_per_session", f"""
WITH {TEL}, q AS (SELECT *, CASE WHEN event_type IS NOT DISTINCT FROM lag(event_type) OVER w THEN 0 ELSE 1 END AS c
  FROM tel WINDOW w AS (PARTITION BY session_id ORDER BY us, joint_idx)),
z AS (SELECT *, sum(c) OVER (PARTITION BY session_id ORDER BY us, joint_idx) AS island FROM q),
g AS (SELECT session_id, island, event_type, count(*) AS n FROM z GROUP BY 1, 2, 3)
SELECT session_id, event_type, count(*) AS n_runs, max(n) AS longest, CAST(sum(n) AS BIGINT) AS n_rows FROM g GROUP BY 1, 2""")
def w06b(spark, sf):
    from scanweave.operators.timeline import islands
    d = islands(telemetry(spark, sf), ["session_id"], ["us", "joint_idx"], "event_type", time_bucket("us", DAY))
    g = d.groupBy("session_id", "island", "event_type").agg(F.count("*").alias("n"))
    return g.groupBy("session_id", "event_type").agg(F.count("*").alias("n_runs"), F.max("n").alias("longest"),
                                                     F.sum("n").alias("n_rows"))


def episodes(spark, sf):
    return stop_episodes(telemetry(spark, sf), ["run_id"], "session_id", "us", "joint_idx", F.col("speed") < 0.35,
                         F.col("event_type") == "error", 3600, DAY, 8.0, 1.5)


@query("w07_episode_classification", f"""
WITH {TEL}, {EPISODES} SELECT run_id, session_id, island, start_us, end_us, n_rows, round(move_m, 6) AS move_m,
  conf_dropped, err_raised, kind FROM ep""")
def w07(spark, sf):
    return episodes(spark, sf).withColumn("move_m", rnd("move_m"))


MASK = EPISODES + """,
acc AS (SELECT *, abs((speed - lag(speed) OVER w) / greatest((us - lag(us) OVER w)/1e6, 1e-3)) AS a
  FROM tel WINDOW w AS (PARTITION BY run_id ORDER BY us, joint_idx)),
hit AS (
  SELECT joint_idx, start_us, 'manual_reposition' AS k FROM acc JOIN ep USING (run_id)
    WHERE kind = 'manual_reposition' AND us BETWEEN start_us AND end_us
  UNION ALL SELECT joint_idx, start_us, 'manual_reposition_post' FROM acc JOIN ep USING (run_id)
    WHERE kind = 'manual_reposition' AND us > end_us AND us <= end_us + 6*3600000000
  UNION ALL SELECT joint_idx, start_us, 'motor_overheat_post' FROM acc JOIN ep USING (run_id)
    WHERE kind = 'motor_overheat' AND us > end_us AND us <= end_us + 24*3600000000 AND a > 0.000005),
mask AS (SELECT t.joint_idx, t.session_id, t.run_id, t.us, t.confidence, h.k IS NOT NULL AS anomaly_flag,
  coalesce(h.k, '') AS anomaly_type FROM tel t LEFT JOIN
  (SELECT joint_idx, arg_max(k, start_us) AS k FROM hit GROUP BY 1) h USING (joint_idx))"""


def mask(spark, sf):
    return episode_mask(telemetry(spark, sf), episodes(spark, sf), ["run_id"], "us", "joint_idx",
                        6 * 3600, 24 * 3600, 0.000005, DAY)


@query("w08_post_episode_tails", f"""
WITH {TEL}, {MASK} SELECT joint_idx, session_id, anomaly_flag, anomaly_type FROM mask""")
def w08(spark, sf):
    return mask(spark, sf).select("joint_idx", "session_id", "anomaly_flag", "anomaly_type")


@query("a38_two_mask_comparison", f"""
WITH {TEL}, {MASK}, two AS (SELECT *, coalesce(confidence < 35, true) AS f3 FROM mask)
SELECT session_id, count(*) FILTER (anomaly_type = 'manual_reposition') AS core_rows,
  count(*) FILTER (anomaly_type = 'manual_reposition' AND f3) AS core_caught,
  count(*) FILTER (anomaly_type = 'manual_reposition_post') AS post_rows,
  count(*) FILTER (anomaly_type = 'manual_reposition_post' AND f3) AS post_caught,
  count(*) FILTER (anomaly_type = 'motor_overheat_post') AS overheat_rows,
  count(*) FILTER (anomaly_type = 'motor_overheat_post' AND f3) AS overheat_caught,
  count(*) FILTER (f3 AND NOT anomaly_flag) AS extension_rows, count(*) FILTER (f3) AS new_rows,
  count(*) FILTER (anomaly_flag) AS old_rows,
  round(count(*) FILTER (anomaly_type LIKE 'manual_reposition%' AND f3)
    / nullif(count(*) FILTER (anomaly_type LIKE 'manual_reposition%'), 0), 6) AS coverage
FROM two GROUP BY 1""")
def a38(spark, sf):
    m = mask(spark, sf).withColumn("f3", F.coalesce(F.col("confidence") < 35, F.lit(True)))
    t = F.col("anomaly_type")
    n = lambda c: F.count_if(c)
    rep = t.startswith("manual_reposition")
    return m.groupBy("session_id").agg(
        n(t == "manual_reposition").alias("core_rows"), n((t == "manual_reposition") & F.col("f3")).alias("core_caught"),
        n(t == "manual_reposition_post").alias("post_rows"),
        n((t == "manual_reposition_post") & F.col("f3")).alias("post_caught"),
        n(t == "motor_overheat_post").alias("overheat_rows"),
        n((t == "motor_overheat_post") & F.col("f3")).alias("overheat_caught"),
        n(F.col("f3") & ~F.col("anomaly_flag")).alias("extension_rows"), n(F.col("f3")).alias("new_rows"),
        n(F.col("anomaly_flag")).alias("old_rows"),
        rnd(n(rep & F.col("f3")) / F.nullif(n(rep), F.lit(0))).alias("coverage"))


@query("o02_top_k_longest_episodes", f"""
WITH {TEL}, {MASK} , c AS (SELECT *, CASE WHEN anomaly_type IS NOT DISTINCT FROM lag(anomaly_type) OVER w
   THEN 0 ELSE 1 END AS ch FROM mask WINDOW w AS (PARTITION BY run_id ORDER BY us, joint_idx)),
i AS (SELECT *, sum(ch) OVER (PARTITION BY run_id ORDER BY us, joint_idx) AS isl FROM c)
SELECT run_id, min(us) AS start_us, count(*) AS n_rows,
  count(*) FILTER (coalesce(confidence < 35, true)) AS n_caught
FROM i WHERE anomaly_type = 'manual_reposition' GROUP BY run_id, isl ORDER BY n_rows DESC, run_id, start_us LIMIT 10""")
def o02(spark, sf):
    m = mask(spark, sf)
    r = true_runs(m, ["run_id"], "us", "joint_idx", F.col("anomaly_type") == "manual_reposition", DAY, 0.0,
                  [F.count_if(F.coalesce(F.col("confidence") < 35, F.lit(True))).alias("n_caught")])
    return (r.orderBy(F.desc("n_rows"), "run_id", "start_us").limit(10)
            .select("run_id", "start_us", "n_rows", "n_caught"))


@query("w09_rising_edges", f"""
WITH {TEL}, d AS (SELECT run_id, abs(speed) > 0.5 AS m, lag(abs(speed) > 0.5) OVER (PARTITION BY run_id ORDER BY us, joint_idx) AS pm FROM tel)
SELECT run_id, count(*) FILTER (m AND NOT pm) AS n_starts, count(*) FILTER (m) AS n_moving FROM d GROUP BY 1""")
def w09(spark, sf):
    d = telemetry(spark, sf).withColumn("m", F.abs("speed") > 0.5)
    d = neighbours(d, ["run_id"], ["us", "joint_idx"], ["m"], time_bucket("us", DAY))
    return d.groupBy("run_id").agg(F.count_if(F.col("m") & ~F.col("prev_m")).alias("n_starts"),
                                   F.count_if("m").alias("n_moving"))


DISC = """
st AS (SELECT *, (lead(us) OVER w - us)/1e6 AS dt, sqrt(power(lead(x_m) OVER w - x_m, 2) + power(lead(y_m) OVER w - y_m, 2)) AS step
  FROM tel WINDOW w AS (PARTITION BY session_id, run_id ORDER BY us, joint_idx)),
disc AS (SELECT *, coalesce(step > greatest(3.0, 0.001*coalesce(abs(speed), 0)*dt) AND dt <= 21600 AND dt > 0, false) AS disc FROM st)"""


def disc(spark, sf):
    return discontinuities(telemetry(spark, sf), ["session_id", "run_id"], "us", "joint_idx", DAY, 3.0, 0.001, 21600)


@query("w10_position_discontinuity", f"WITH {TEL}, {DISC} SELECT joint_idx, disc FROM disc")
def w10(spark, sf):
    return disc(spark, sf).select("joint_idx", "disc")


@query("w11_motion_signature", f"""
WITH {TEL}, lagged AS (SELECT *, heading_rad - lag(heading_rad) OVER w AS dh, (us - lag(us) OVER w) / 1e6 AS dt
  FROM tel WINDOW w AS (PARTITION BY session_id ORDER BY us, joint_idx)),
o AS (SELECT *, CASE WHEN dt > 60 AND dt < 3600 THEN abs((dh + pi() - 2*pi()*floor((dh + pi())/(2*pi())) - pi())/dt) ELSE 0 END AS w FROM lagged),
cap AS (SELECT session_id, quantile_cont(w, 0.99) AS cap FROM o WHERE w > 0 GROUP BY 1)
SELECT joint_idx, round(least(w, coalesce(cap, w)), 9) AS omega, round(abs(speed) + 0.25*least(w, coalesce(cap, w)), 8) AS signature
FROM o LEFT JOIN cap USING (session_id)""")
def w11(spark, sf):
    d = motion_signature(telemetry(spark, sf), ["session_id"], "us", "joint_idx", DAY, 0.25, 60, 3600)
    return d.select("joint_idx", rnd("omega", 9).alias("omega"), rnd("signature", 8).alias("signature"))


@query("w16_consecutive_scan_dissimilarity", f"""
WITH {SCAN}, b AS (SELECT beam.*, label % 3 AS g FROM beam JOIN (SELECT vec_id, label AS lb FROM embeddings) e ON e.vec_id = scan_row),
o AS (SELECT scan_row, g, lag(scan_row) OVER (PARTITION BY g ORDER BY scan_row) AS prev_row
   FROM (SELECT DISTINCT scan_row, g FROM b))
SELECT o.g, o.scan_row, o.prev_row, (o.scan_row + o.prev_row) / 2 AS mid, count(c.mm) FILTER (c.mm NOT IN (0, 65535) AND p.mm NOT IN (0, 65535)
    AND c.mm < 8250 AND p.mm < 8250) AS n_valid,
  round(avg(abs(c.mm - p.mm)) FILTER (c.mm NOT IN (0, 65535) AND p.mm NOT IN (0, 65535) AND c.mm < 8250 AND p.mm < 8250), 6) AS dissim
FROM o JOIN b c ON c.scan_row = o.scan_row JOIN b p ON p.scan_row = o.prev_row AND p.slot = c.slot GROUP BY 1, 2, 3, 4""")
def w16(spark, sf):
    from scanweave.functions.arrays import dissimilarity
    d = scan(spark, sf).select("scan_row", (F.col("label") % 3).alias("g"), "distances")
    d = d.withColumn("r", F.col("scan_row"))
    d = neighbours(d, ["g"], ["scan_row"], ["r", "distances"], F.floor(F.col("scan_row") / 4096))
    d = d.filter("prev_r IS NOT NULL").withColumn("v", dissimilarity("distances", "prev_distances", 8250))
    return d.select("g", "scan_row", F.col("prev_r").alias("prev_row"),
                    ((F.col("scan_row") + F.col("prev_r")) / 2).alias("mid"),
                    F.col("v.n").cast("long").alias("n_valid"), rnd("v.mean").alias("dissim"))


@query("w30_monotonic_order", f"""
WITH {TEL}, d AS (SELECT session_id, us < lag(us) OVER (PARTITION BY session_id ORDER BY joint_idx) AS back FROM tel)
SELECT session_id, count(*) AS n_rows, count(*) FILTER (back) AS n_backward, count(*) FILTER (back) = 0 AS ok FROM d GROUP BY 1""")
def w30(spark, sf):
    d = telemetry(spark, sf).withColumn("t", F.col("us"))
    d = neighbours(d, ["session_id"], ["joint_idx"], ["t"], F.floor(F.col("joint_idx") / 100_000))
    back = F.count_if(F.col("t") < F.col("prev_t"))
    return d.groupBy("session_id").agg(F.count("*").alias("n_rows"), back.alias("n_backward"), (back == 0).alias("ok"))


@query("a02_run_enumeration", """
WITH t AS (SELECT user_id AS run_id, event_id, epoch_us(ts) AS us, value/100 AS speed,
   (epoch_us(ts) - lag(epoch_us(ts)) OVER (PARTITION BY user_id ORDER BY ts, event_id))/1e6 AS dt,
   lag(value/100) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS ps FROM events WHERE event_type <> 'view'),
a AS (SELECT run_id, min(us) AS start_us, max(us) AS end_us, count(*) AS n,
  coalesce(median(dt) FILTER (dt > 0 AND dt < 43200), median(dt)) AS period_s, count(*) FILTER (dt > 43200) AS n_gaps,
  coalesce(sum(dt) FILTER (dt > 43200), 0) AS gap_s, count(*) FILTER (abs(speed) > 0.5) AS n_moving,
  count(*) FILTER (abs(speed) > 0.5 AND NOT abs(ps) > 0.5) AS n_starts FROM t GROUP BY 1),
v AS (SELECT user_id AS run_id, epoch_us(ts) AS us FROM events WHERE event_type = 'view'),
b AS (SELECT a.run_id, count(v.us) AS n_other, min(v.us) AS s2, max(v.us) AS e2 FROM a LEFT JOIN v
  ON v.run_id = a.run_id AND v.us BETWEEN start_us - 7200000000 AND end_us + 7200000000 GROUP BY 1),
c AS (SELECT *, (least(end_us, e2) - greatest(start_us, s2))/1e6 AS overlap_s, n_moving*period_s AS motion_s FROM a JOIN b USING (run_id))
SELECT run_id, start_us, end_us, n, round(period_s, 3) AS period_s, round(1/period_s, 9) AS rate_hz, n_gaps, round(gap_s, 4) AS gap_s,
  n_other, round(overlap_s, 6) AS overlap_s, round(motion_s, 4) AS motion_s, n_starts,
  CASE WHEN concat_ws(',', CASE WHEN coalesce(overlap_s < 864000, true) THEN 'intersection' END, CASE WHEN motion_s < 432000 THEN 'motion' END,
    CASE WHEN n_other = 0 THEN 'no_scans' END) = '' THEN 'ok' ELSE concat_ws(',', CASE WHEN coalesce(overlap_s < 864000, true) THEN 'intersection' END,
    CASE WHEN motion_s < 432000 THEN 'motion' END, CASE WHEN n_other = 0 THEN 'no_scans' END) END AS reasons FROM c""")
def a02(spark, sf):
    from scanweave.functions.exprs import joined_flags
    from scanweave.operators.intervals import points_in_intervals
    from scanweave.operators.quantiles import exact_quantiles
    all_ = telemetry(spark, sf)
    t = all_.filter("event_type <> 'view'").withColumn("t", F.col("us")).withColumn("s", F.col("speed"))
    t = neighbours(t, ["run_id"], ["us", "joint_idx"], ["t", "s"], time_bucket("us", DAY))
    t = t.withColumn("dt", (F.col("t") - F.col("prev_t")) / 1e6)
    clean = F.when((F.col("dt") > 0) & (F.col("dt") < 43200), F.col("dt"))
    a = t.groupBy("run_id").agg(
        F.min("us").alias("start_us"), F.max("us").alias("end_us"), F.count("*").alias("n"),
        F.count_if(F.col("dt") > 43200).alias("n_gaps"),
        F.coalesce(F.sum(F.when(F.col("dt") > 43200, F.col("dt"))), F.lit(0.0)).alias("gap_s"),
        F.count_if(F.abs("speed") > 0.5).alias("n_moving"),
        F.count_if((F.abs("speed") > 0.5) & ~(F.abs("prev_s") > 0.5)).alias("n_starts"))
    med = t.select("run_id", F.inline(F.array(F.struct(F.lit(0).alias("w"), clean.alias("dt")),
                                              F.struct(F.lit(1).alias("w"), F.col("dt").alias("dt")))))
    med = exact_quantiles(med, ["run_id", "w"], "dt", {"m": 0.5})
    med = med.groupBy("run_id").agg(F.min_by("m", "w").alias("period_s"))
    v = all_.filter("event_type = 'view'").select("run_id", "us")
    near = points_in_intervals(v, a.select("run_id", "start_us", "end_us"), ["run_id"], "us", "start_us", "end_us", DAY, 7200)
    b = near.groupBy("run_id").agg(F.count("*").alias("n_other"), F.min("us").alias("s2"), F.max("us").alias("e2"))
    c = (a.join(med, "run_id", "left").join(b, "run_id", "left").withColumn("n_other", F.coalesce("n_other", F.lit(0)))
         .withColumn("overlap_s", (F.least("end_us", "e2") - F.greatest("start_us", "s2")) / 1e6)
         .withColumn("overlap_s", F.when(F.col("s2").isNotNull(), F.col("overlap_s")))
         .withColumn("motion_s", F.col("n_moving") * F.col("period_s")))
    why = joined_flags([(F.coalesce(F.col("overlap_s") < 864000, F.lit(True)), "intersection"),
                        (F.col("motion_s") < 432000, "motion"), (F.col("n_other") == 0, "no_scans")], ",", "ok")
    return c.select("run_id", "start_us", "end_us", "n", rnd("period_s", 3).alias("period_s"),
                    rnd(1 / F.col("period_s"), 9).alias("rate_hz"), "n_gaps", rnd("gap_s", 4).alias("gap_s"), "n_other",
                    rnd("overlap_s").alias("overlap_s"), rnd("motion_s", 4).alias("motion_s"), "n_starts", why.alias("reasons"))
