"""As-of, interval and slice joins on event time."""

from __future__ import annotations

from pyspark.sql import functions as F

from scanweave.functions.exprs import rnd
from scanweave.operators.asof import asof_nearest
from scanweave.operators.intervals import assign_last_span, points_in_intervals
from scanweave.operators.quantiles import exact_quantiles
from scanweave.operators.signal import resample_linear
from scanweave.operators.timeline import row_position
from scanweave.functions.exprs import time_bucket
from scanweave.plans.registry import query
from scanweave.session import stored
from scanweave.plans.views import events, telemetry, TEL

HOUR = 3_600_000_000

NEAREST = """
l AS (SELECT event_id, user_id, epoch_us(ts) AS us FROM events WHERE event_type = 'click'),
r AS (SELECT event_id AS right_id, user_id, epoch_us(ts) AS right_us, value AS right_value
      FROM events WHERE event_type = 'view'),
near AS (SELECT * FROM (SELECT l.event_id, l.user_id, l.us, right_id, right_us, right_value,
    row_number() OVER (PARTITION BY event_id ORDER BY abs(us - right_us),
      CASE WHEN right_us <= us THEN 0 ELSE 1 END,
      CASE WHEN right_us <= us THEN -right_id ELSE right_id END) AS rn
  FROM l JOIN r ON l.user_id = r.user_id AND abs(us - right_us) <= 3600000000) WHERE rn = 1)"""


def clicks(spark, sf):
    return events(spark, sf).filter("event_type = 'click'").select("event_id", "user_id", "us")


def views(spark, sf):
    return events(spark, sf).filter("event_type = 'view'").select(
        "user_id", "us", F.col("event_id").alias("right_id"), F.col("value").alias("right_value"))


def nearest(spark, sf, keep=False):
    return asof_nearest(clicks(spark, sf), views(spark, sf), ["user_id"], "us", "event_id", "right_id",
                        3600, ["right_value"], keep_unmatched=keep)


@query("j01_asof_nearest_tolerance", f"""
WITH {NEAREST} SELECT event_id, user_id, right_id, right_value,
  round((us - right_us) / 1e6, 6) AS delta_t_s FROM near""")
def j01(spark, sf):
    return nearest(spark, sf).select("event_id", "user_id", "right_id", "right_value",
                                     rnd("delta_t_s").alias("delta_t_s"))


# Half the longer mean period of the two streams on each day, 20 times over as the streams are sparse.
DAY_TOLERANCE = """
sides AS (SELECT event_type, us // 86400000000 AS day, min(us) AS lo, max(us) AS hi, count(*) AS n FROM ev WHERE event_type IN ('click', 'view') GROUP BY 1, 2),
dtol AS (SELECT day, 10 * max((hi - lo) // (n - 1)) AS tol FROM sides WHERE n > 1 GROUP BY 1)"""


def day_tolerance(e):
    """(day, tol): microseconds; one row a day."""
    s = (e.filter("event_type IN ('click', 'view')").groupBy("event_type", F.floor(F.col("us") / (24 * HOUR)).alias("day"))
         .agg(F.min("us").alias("lo"), F.max("us").alias("hi"), F.count("*").alias("n")).filter("n > 1"))
    return s.groupBy("day").agg(F.max(10 * F.expr("(hi - lo) div (n - 1)")).alias("tol"))


NEAREST_BY_DAY = """
near AS (SELECT * FROM (SELECT l.*, right_id, right_us, row_number() OVER (PARTITION BY event_id ORDER BY abs(us - right_us),
      CASE WHEN right_us <= us THEN 0 ELSE 1 END, CASE WHEN right_us <= us THEN -right_id ELSE right_id END) AS rn
  FROM l JOIN r ON l.{k} = r.{k} AND abs(us - right_us) <= tol) WHERE rn = 1)"""


@query("j01_asof_day_tolerance", f"""
WITH ev AS (SELECT *, epoch_us(ts) AS us FROM events), {DAY_TOLERANCE},
l AS (SELECT event_id, user_id % 3 AS g, us, tol FROM ev LEFT JOIN dtol ON day = us // 86400000000 WHERE event_type = 'click'),
r AS (SELECT event_id AS right_id, user_id % 3 AS g, us AS right_us FROM ev WHERE event_type = 'view'), {NEAREST_BY_DAY.format(k="g")}
SELECT event_id, g, tol, right_id, round((us - right_us) / 1e6, 6) AS delta_t_s FROM near""")
def j01_day(spark, sf):
    e = events(spark, sf)
    l = (e.filter("event_type = 'click'").select("event_id", (F.col("user_id") % 3).alias("g"), "us",
                                                 F.floor(F.col("us") / (24 * HOUR)).alias("day")).join(day_tolerance(e), "day", "left").drop("day"))
    r = e.filter("event_type = 'view'").select((F.col("user_id") % 3).alias("g"), "us", F.col("event_id").alias("right_id"))
    return (asof_nearest(l, r, ["g"], "us", "event_id", "right_id", F.col("tol"))
            .select("event_id", "g", "tol", "right_id", rnd("delta_t_s").alias("delta_t_s")))


# Clock offset of each day in seconds, as an estimator would give it: applied before anything is joined.
OFFSET = "((us // 86400000000) % 7 - 3) * 20"


@query("j01_joint_table", f"""
WITH ev AS (SELECT *, epoch_us(ts) AS us FROM events), {DAY_TOLERANCE},
moved AS (SELECT event_id, user_id, us AS raw_us, {OFFSET} AS offset_s, us - {OFFSET} * 1000000 AS us FROM ev WHERE event_type = 'click'),
spans AS (SELECT user_id, us // 86400000000 AS run_day, min(us) - 43200000000 AS w0, max(us) + 43200000000 AS w1
  FROM ev WHERE event_type = 'purchase' GROUP BY 1, 2),
inrun AS (SELECT m.*, max(run_day) AS run_day FROM moved m JOIN spans s ON m.user_id = s.user_id AND m.us BETWEEN w0 AND w1 GROUP BY ALL),
l AS (SELECT i.*, tol FROM inrun i LEFT JOIN dtol ON day = us // 86400000000),
r AS (SELECT event_id AS right_id, user_id, us AS right_us, value AS right_value FROM ev WHERE event_type = 'view'), {NEAREST_BY_DAY.format(k="user_id")}
SELECT event_id, user_id, run_day, raw_us, CAST(offset_s AS BIGINT) AS offset_s, us, tol AS tolerance_us, n.right_id, n.right_us, r.right_value,
  round((us - n.right_us) / 1e6, 6) AS delta_t_s FROM near n JOIN r USING (user_id, right_id)""")
def j01_joint(spark, sf):
    e = events(spark, sf)
    offset = (F.floor(F.col("us") / (24 * HOUR)) % 7 - 3) * 20
    moved = (e.filter("event_type = 'click'").withColumn("offset_s", offset).withColumn("raw_us", F.col("us"))
             .withColumn("us", F.col("us") - F.col("offset_s") * 1_000_000).select("event_id", "user_id", "raw_us", "offset_s", "us"))
    wide = spans(spark, sf).select("user_id", F.col("day").alias("run_day"), (F.col("s_us") - 12 * HOUR).alias("w0"), (F.col("e_us") + 12 * HOUR).alias("w1"))
    run = assign_last_span(moved, wide, ["user_id"], "us", "w0", "w1", "run_day", ["run_day"], "event_id", 86400)
    l = moved.join(run.select("event_id", "run_day"), "event_id").withColumn("day", F.floor(F.col("us") / (24 * HOUR)))
    l = l.join(day_tolerance(e), "day", "left")
    l = l.select("event_id", "user_id", "run_day", "raw_us", "offset_s", "us", "tol")
    j = asof_nearest(l, views(spark, sf), ["user_id"], "us", "event_id", "right_id", F.col("tol"), ["right_value"])
    return j.select("event_id", "user_id", "run_day", "raw_us", "offset_s", "us", F.col("tol").alias("tolerance_us"), "right_id",
                    "right_us", "right_value", rnd("delta_t_s").alias("delta_t_s"))


@query("a37_match_statistics", f"""
WITH {NEAREST}, m AS (SELECT l.user_id, l.us // 86400000000 AS day, n.right_id,
   (n.us - n.right_us) / 1e6 AS dt FROM l LEFT JOIN near n USING (event_id))
SELECT CASE WHEN grouping(day) = 1 THEN 'all' ELSE CAST(day AS VARCHAR) END AS day,
  CASE WHEN grouping(user_id) = 1 THEN 'all' ELSE CAST(user_id AS VARCHAR) END AS run,
  count(*) AS n_left, count(right_id) AS n_matched,
  round(count(right_id) / count(*), 6) AS retention, round(avg(dt), 3) AS mean_s,
  round(stddev_samp(dt), 3) AS std_s, round(avg(abs(dt)), 3) AS mean_abs_s,
  round(max(abs(dt)), 6) AS max_abs_s, round(quantile_cont(abs(dt), 0.95), 3) AS p95_abs_s
FROM m GROUP BY GROUPING SETS ((day, user_id), (day), ())""")
def a37(spark, sf):
    m = stored(nearest(spark, sf, keep=True).select(
        F.floor(F.col("us") / (24 * HOUR)).cast("string").alias("d"), F.col("user_id").cast("string").alias("u"),
        "right_id", F.col("delta_t_s").alias("dt"), F.abs("delta_t_s").alias("adt")))
    every = F.lit("all")
    m = m.select("right_id", "dt", "adt", F.inline(F.array(
        F.struct(F.col("d").alias("day"), F.col("u").alias("run")),
        F.struct(F.col("d").alias("day"), every.alias("run")),
        F.struct(every.alias("day"), every.alias("run")))))
    keys = ["day", "run"]
    s = m.groupBy(*keys).agg(
        F.count("*").alias("n_left"), F.count("right_id").alias("n_matched"),
        rnd(F.count("right_id") / F.count("*")).alias("retention"), rnd(F.avg("dt"), 3).alias("mean_s"),
        rnd(F.stddev_samp("dt"), 3).alias("std_s"), rnd(F.avg("adt"), 3).alias("mean_abs_s"),
        rnd(F.max("adt")).alias("max_abs_s"))
    q = exact_quantiles(m, keys, "adt", {"p95_abs_s": 0.95})
    return s.join(q, keys, "left").withColumn("p95_abs_s", rnd("p95_abs_s", 3))


SPANS = """
spans AS (SELECT user_id, epoch_us(ts) // 86400000000 AS day, min(epoch_us(ts)) AS s_us, max(epoch_us(ts)) AS e_us
          FROM events WHERE event_type = 'purchase' GROUP BY 1, 2)"""


def spans(spark, sf):
    return (events(spark, sf).filter("event_type = 'purchase'")
            .groupBy("user_id", F.floor(F.col("us") / (24 * HOUR)).alias("day"))
            .agg(F.min("us").alias("s_us"), F.max("us").alias("e_us")))


@query("j02_interval_join_last_run_wins", f"""
WITH {SPANS}, wide AS (SELECT user_id, day, s_us - 43200000000 AS w0, e_us + 43200000000 AS w1 FROM spans),
p AS (SELECT event_id, user_id, epoch_us(ts) AS us FROM events WHERE event_type <> 'purchase')
SELECT event_id, p.user_id, max(day) AS day FROM p JOIN wide w
  ON p.user_id = w.user_id AND us BETWEEN w0 AND w1 GROUP BY 1, 2""")
def j02(spark, sf):
    wide = spans(spark, sf).select("user_id", "day", (F.col("s_us") - 12 * HOUR).alias("w0"),
                                   (F.col("e_us") + 12 * HOUR).alias("w1"))
    p = events(spark, sf).filter("event_type <> 'purchase'")
    return (assign_last_span(p, wide, ["user_id"], "us", "w0", "w1", "day", ["day"], "event_id", 86400)
            .select("event_id", "user_id", "day"))


@query("j03_time_slice_join_margin", f"""
WITH {SPANS}, p AS (SELECT event_id, user_id, epoch_us(ts) AS us FROM events)
SELECT p.user_id, day, count(*) AS n_rows, min(us) AS first_us, max(us) AS last_us FROM p JOIN spans s
  ON p.user_id = s.user_id AND us BETWEEN s_us - 3600000000 AND e_us + 3600000000 GROUP BY 1, 2""")
def j03(spark, sf):
    hit = points_in_intervals(events(spark, sf).select("event_id", "user_id", "us"), spans(spark, sf),
                              ["user_id"], "us", "s_us", "e_us", 86400, margin_s=3600)
    return hit.groupBy("user_id", "day").agg(F.count("*").alias("n_rows"), F.min("us").alias("first_us"),
                                             F.max("us").alias("last_us"))


@query("j15_grid_bracket_lookup", """
WITH v AS (SELECT user_id % 3 AS g, epoch_us(ts) AS us FROM events WHERE event_type = 'view'),
b AS (SELECT g, min(us) AS lo, (max(us) - min(us)) // 7200000000 AS n FROM v GROUP BY g),
grid AS (SELECT g, lo, unnest(range(0, n)) AS k FROM b),
pts AS (SELECT g, k, lo + k * 7200000000 AS t FROM grid)
SELECT g, k, t AS t_us, (SELECT max(us) FROM v WHERE v.g = pts.g AND v.us <= pts.t) AS before_us,
  (SELECT min(us) FROM v WHERE v.g = pts.g AND v.us > pts.t) AS after_us FROM pts""")
def j15(spark, sf):
    v = events(spark, sf).filter("event_type = 'view'").select((F.col("user_id") % 3).alias("g"), "us", "value")
    b = v.groupBy("g").agg(F.min("us").alias("lo_us"),
                           F.floor((F.max("us") - F.min("us")) / (2 * HOUR)).alias("n_grid"))
    return (resample_linear(v, ["g"], "us", "value", b, 7200, 1e9, 86400)
            .select("g", "k", "t_us", "before_us", "after_us"))


@query("q06_asof_second_formulation", f"""
WITH {NEAREST} SELECT count(*) AS n_left, (SELECT count(*) FROM near) AS n_asof,
  (SELECT count(*) FROM near) AS n_range, CAST(0 AS BIGINT) AS n_differ FROM l""")
def q06(spark, sf):
    left = clicks(spark, sf)
    ours = nearest(spark, sf).select("event_id", F.abs("delta_t_s").alias("gap"))
    right = views(spark, sf).withColumn("r_us", F.col("us")).withColumn("e_us", F.col("us"))
    pairs = points_in_intervals(left, right.drop("us"), ["user_id"], "us", "r_us", "e_us", 86400, 3600)
    brute = pairs.groupBy("event_id").agg((F.min(F.abs(F.col("us") - F.col("r_us"))) / 1e6).alias("want"))
    both = left.select("event_id").join(ours, "event_id", "left").join(brute, "event_id", "left")
    return both.agg(F.count("*").alias("n_left"), F.count("gap").alias("n_asof"), F.count("want").alias("n_range"),
                    F.count_if(~F.col("gap").eqNullSafe(F.col("want"))).alias("n_differ"))


@query("o03_endpoints_and_clock_hypotheses", """
WITH v AS (SELECT user_id, event_type, event_id, epoch_us(ts) AS us FROM events),
o AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY us, event_id) AS i,
   row_number() OVER (PARTITION BY user_id ORDER BY us DESC, event_id DESC) AS j FROM v WHERE event_type = 'click'),
e AS (SELECT user_id, list(us ORDER BY us) FILTER (i <= 3) AS f, list(us ORDER BY us DESC) FILTER (j <= 3) AS l,
   min(us) AS s0, max(us) AS s1 FROM o GROUP BY 1),
w AS (SELECT user_id, min(us) AS t0, max(us) AS t1 FROM v WHERE event_type = 'view' GROUP BY 1)
SELECT user_id, array_to_string(f, ';') AS first_us, array_to_string(l, ';') AS last_us,
  round((t0 - s0)/1e6, 3) AS start_delta_s, round((t1 - s1)/1e6, 3) AS stop_delta_s,
  round((t0 - s0)/1e6 - 3600, 3) AS start_delta_shifted_s,
  CASE WHEN abs(t0 - s0) <= abs(t0 - s0 - 3600000000) THEN 'same_clock' ELSE 'shifted_clock' END AS verdict
FROM e JOIN w USING (user_id)""")
def o03(spark, sf):
    v = events(spark, sf).select("user_id", "event_type", "event_id", "us")
    c = row_position(v.filter("event_type = 'click'"), ["user_id"], ["us", "event_id"], time_bucket("us", 86400))
    first = F.sort_array(F.collect_list(F.when(F.col("rn") <= 3, F.col("us"))))
    last = F.sort_array(F.collect_list(F.when(F.col("rn") > F.col("n") - 3, F.col("us"))), asc=False)
    e = c.groupBy("user_id").agg(first.alias("f"), last.alias("l"), F.min("us").alias("s0"), F.max("us").alias("s1"))
    w = v.filter("event_type = 'view'").groupBy("user_id").agg(F.min("us").alias("t0"), F.max("us").alias("t1"))
    a, b = F.col("t0") - F.col("s0"), F.col("t1") - F.col("s1")
    text = lambda c: F.array_join(F.col(c).cast("array<string>"), ";")
    return e.join(w, "user_id").select(
        "user_id", text("f").alias("first_us"), text("l").alias("last_us"),
        rnd(a / 1e6, 3).alias("start_delta_s"), rnd(b / 1e6, 3).alias("stop_delta_s"),
        rnd(a / 1e6 - 3600, 3).alias("start_delta_shifted_s"),
        F.when(F.abs(a) <= F.abs(a - HOUR), "same_clock").otherwise("shifted_clock").alias("verdict"))
