"""Filters, derived columns, scalar functions and table checks."""

from __future__ import annotations

from pyspark.sql import functions as F, types as T

from scanweave.functions.exprs import (any_of, cell, clip, finite, near, rnd, signed_duration, wrap_angle)
from scanweave.operators import quality
from scanweave.operators.stats import line_fit
from scanweave.plans import time_joins  # noqa: F401  (its joint table is checked here)
from scanweave.plans.registry import SQL, query
from scanweave.plans.statistics import FIT, with_logd
from scanweave.plans.views import AP, TEL, events, table, telemetry, transmitters

# Nested feature lists of the ablation variants over the stand-in columns.
GEOMETRY = ["dist"]
MOTION = ["speed", "value"]
VARIANT_FEATURES = {"v0": GEOMETRY, "v1": GEOMETRY + ["x_m", "y_m"], "v2": GEOMETRY + ["x_m", "y_m"] + MOTION}


@query("f01_keep_non_anomalous", f"WITH {TEL} SELECT joint_idx, session_id FROM tel WHERE session_id = 's1' AND NOT coalesce(confidence < 35, true)")
def f01(spark, sf):
    bad = F.coalesce(F.col("confidence") < 35, F.lit(True))
    return telemetry(spark, sf).filter((F.col("session_id") == "s1") & ~bad).select("joint_idx", "session_id")


@query("f02_motion_filters", f"""
WITH {TEL} SELECT session_id, count(*) FILTER (abs(speed) > 0.05 AND confidence IS NOT NULL) AS n_active, count(*) FILTER (abs(speed) < 0.1) AS n_slow, count(*) FILTER (abs(speed) > 0.1) AS n_fast FROM tel GROUP BY 1""")
def f02(spark, sf):
    v = F.abs("speed")
    return quality.count_where(telemetry(spark, sf), ["session_id"], {
        "n_active": (v > 0.05) & F.col("confidence").isNotNull(), "n_slow": v < 0.1, "n_fast": v > 0.1}).drop("n")


@query("f04_fallback_speed", f"""
WITH {TEL}, w AS (SELECT joint_idx, CASE WHEN joint_idx % 9 > 0 THEN speed END AS v, -value/100 AS l, value/50 AS r FROM tel) SELECT joint_idx, round(coalesce(abs(v), (abs(l) + abs(r))/2), 6) AS speed FROM w""")
def f04(spark, sf):
    v, l, r = F.when(F.col("joint_idx") % 9 > 0, F.col("speed")), -F.col("value") / 100, F.col("value") / 50
    return telemetry(spark, sf).select("joint_idx", rnd(F.coalesce(F.abs(v), (F.abs(l) + F.abs(r)) / 2)).alias("speed"))


@query("f07_rename_and_reorder", f"WITH {TEL} SELECT session_id AS session_date, run_id AS run_file, joint_idx, value AS ping, confidence AS position_confidence FROM tel")
def f07(spark, sf):
    d = telemetry(spark, sf).withColumnsRenamed({"session_id": "session_date", "run_id": "run_file", "value": "ping", "confidence": "position_confidence"})
    return d.select("session_date", "run_file", "joint_idx", "ping", "position_confidence")


@query("f08_attach_session_constants", f"WITH {TEL}, {AP} SELECT joint_idx, ap_x, ap_y FROM tel JOIN ap USING (session_id)")
def f08(spark, sf):
    return telemetry(spark, sf).join(F.broadcast(transmitters(spark)), "session_id").select("joint_idx", "ap_x", "ap_y")  # three fixed rows


@query("f09_derived_measures", f"""
WITH {TEL} SELECT joint_idx, round(abs(speed - 0.5), 6) AS abs_speed, round((value + value*2)/2/1000, 6) AS wheel_mean, round(signal - (-90), 6) AS snr FROM tel""")
def f09(spark, sf):
    v = F.col("value")
    return telemetry(spark, sf).select("joint_idx", rnd(F.abs(F.col("speed") - 0.5)).alias("abs_speed"), rnd((v + v * 2) / 2 / 1000).alias("wheel_mean"),
                                       rnd(F.col("signal") + 90).alias("snr"))


REASON = """
rs AS (SELECT *, CASE WHEN joint_idx % 31 = 0 THEN NULL ELSE value END AS load, coalesce(confidence < 35, true) AS low FROM tel),
rf AS (SELECT *, low OR load IS NULL AS flag, CASE WHEN low THEN 'low_confidence' WHEN load IS NULL THEN 'telemetry_nan' ELSE 'none' END AS reason FROM rs)"""


def flagged(spark, sf):
    t = telemetry(spark, sf).withColumn("load", F.when(F.col("joint_idx") % 31 == 0, F.lit(float("nan"))).otherwise(F.col("value")))
    low = F.coalesce(F.col("confidence") < 35, F.lit(True))
    gone = any_of([~finite(c) for c in ("load", "speed", "x_m")])
    return t.withColumns({"low": low, "flag": low | gone,
                          "reason": F.when(low, "low_confidence").when(gone, "telemetry_nan").otherwise("none")})


@query("f10_f11_flag_and_reason", f"WITH {TEL}, {REASON} SELECT joint_idx, flag, reason FROM rf")
def f10(spark, sf):
    return flagged(spark, sf).select("joint_idx", "flag", "reason")


@query("q07_flag_reason_consistency", f"""
WITH {TEL}, {REASON} SELECT count(*) AS n, count(*) FILTER (flag <> (reason <> 'none')) AS n_inconsistent, count(*) FILTER (low AND reason <> 'low_confidence') AS n_priority FROM rf""")
def q07(spark, sf):
    return quality.count_where(flagged(spark, sf), [], {"n_inconsistent": F.col("flag") != (F.col("reason") != "none"),
                                                        "n_priority": F.col("low") & (F.col("reason") != "low_confidence")})


@query("a08_counts_by_session_and_reason", f"""
WITH {TEL}, {REASON} SELECT session_id, count(*) AS n, count(*) FILTER (flag) AS n_flagged, count(*) FILTER (reason = 'low_confidence') AS low_confidence,
  count(*) FILTER (reason = 'telemetry_nan') AS telemetry_nan, count(*) FILTER (reason = 'none') AS clean FROM rf GROUP BY 1""")
def a08(spark, sf):
    r = F.col("reason")
    return quality.count_where(flagged(spark, sf), ["session_id"], {"n_flagged": F.col("flag"), "low_confidence": r == "low_confidence",
                                                                    "telemetry_nan": r == "telemetry_nan", "clean": r == "none"})


@query("f12_f14_category_encoding", f"""
WITH {TEL} SELECT joint_idx, CAST(session_id = 's0' AS TINYINT) AS is_s0, CAST(session_id = 's1' AS TINYINT) AS is_s1, CAST(substr(session_id, 2) AS TINYINT) AS session_code, CAST(speed > 0.5 AS TINYINT) AS moving FROM tel""")
def f12(spark, sf):
    s = F.col("session_id")
    code = F.when(s == "s0", 0).when(s == "s1", 1).when(s == "s2", 2).cast("tinyint")
    return telemetry(spark, sf).select("joint_idx", (s == "s0").cast("tinyint").alias("is_s0"), (s == "s1").cast("tinyint").alias("is_s1"),
                                       code.alias("session_code"), (F.col("speed") > 0.5).cast("tinyint").alias("moving"))


@query("f13_feature_set_projection", f"""
WITH {TEL}, d AS (SELECT *, sqrt((x_m-5)*(x_m-5)+(y_m-5)*(y_m-5)) AS dist FROM tel)
SELECT 'v0' AS variant, joint_idx, round(dist, 6) AS total FROM d UNION ALL SELECT 'v1', joint_idx, round(dist + x_m + y_m, 6) FROM d UNION ALL SELECT 'v2', joint_idx, round(dist + x_m + y_m + speed + value, 6) FROM d""")
def f13(spark, sf):
    d = telemetry(spark, sf).withColumn("dist", F.sqrt((F.col("x_m") - 5) ** 2 + (F.col("y_m") - 5) ** 2))
    return d.select("joint_idx", F.inline(F.array(*[F.struct(F.lit(v).alias("variant"), rnd(sum(F.col(c) for c in cols)).alias("total"))
                                                   for v, cols in VARIANT_FEATURES.items()])))


@query("j04_validated_key_join", f"""
WITH {TEL}, r AS (SELECT joint_idx, CAST(joint_idx % 5 AS INT) AS region FROM tel WHERE event_type <> 'error') SELECT t.joint_idx, region FROM tel t LEFT JOIN r USING (joint_idx)""")
def j04(spark, sf):
    t = telemetry(spark, sf)
    r = t.filter("event_type <> 'error'").select("joint_idx", (F.col("joint_idx") % 5).cast("int").alias("region"))
    return quality.unique_join(t.select("joint_idx"), r, "joint_idx")


@query("j07_positional_zip_by_key", f"WITH {TEL} SELECT joint_idx, round(speed, 6) AS speed, coalesce(confidence < 35, true) AS anomaly_flag FROM tel WHERE NOT coalesce(confidence < 35, true)")
def j07(spark, sf):
    t = telemetry(spark, sf)
    m = t.select("joint_idx", F.coalesce(F.col("confidence") < 35, F.lit(True)).alias("anomaly_flag"))
    return t.select("joint_idx", rnd("speed").alias("speed")).join(m.filter("NOT anomaly_flag"), "joint_idx")


VERIFY = """
src AS (SELECT run_id, us, value, confidence FROM tel WHERE event_type <> 'signup' UNION ALL SELECT run_id, us, value + 1, confidence FROM tel WHERE event_type = 'view'),
cand AS (SELECT run_id, us, CASE WHEN joint_idx % 29 = 0 THEN value + 0.5 ELSE value END AS value, CASE WHEN joint_idx % 37 = 0 THEN NULL ELSE confidence END AS confidence FROM tel)"""


@query("j12_keyed_payload_verification", f"""
WITH {TEL}, {VERIFY}, j AS (SELECT c.run_id, c.us, s.us IS NOT NULL AS hit, coalesce(c.value IS NOT DISTINCT FROM s.value OR abs(c.value - s.value) <= 1e-12 + 1e-9*abs(s.value), false) AS v,
  coalesce(c.confidence IS NOT DISTINCT FROM s.confidence OR abs(c.confidence - s.confidence) <= 1e-12 + 1e-9*abs(s.confidence), false) AS f FROM cand c LEFT JOIN src s ON c.run_id = s.run_id AND c.us = s.us)
SELECT run_id, us, bool_or(hit) AS found, bool_or(hit AND v) AS ok_value, bool_or(hit AND f) AS ok_confidence FROM j GROUP BY 1, 2""")
def j12(spark, sf):
    t = telemetry(spark, sf)
    j, cols = F.col("joint_idx"), ["run_id", "us", "value", "confidence"]
    src = t.filter("event_type <> 'signup'").select(*cols).unionByName(t.filter("event_type = 'view'").withColumn("value", F.col("value") + 1).select(*cols))
    cand = t.withColumn("value", F.when(j % 29 == 0, F.col("value") + 0.5).otherwise(F.col("value"))).withColumn(
        "confidence", F.when(j % 37 != 0, F.col("confidence"))).select(*cols)
    return quality.payload_differences(cand, src, ["run_id", "us"], ["value", "confidence"])


@query("o01_stable_multi_key_sort", f"""
WITH {TEL} SELECT joint_idx, session_id, row_number() OVER (ORDER BY session_id, us, joint_idx) AS position FROM tel""")
def o01(spark, sf):
    from scanweave.operators.timeline import density_chunks, running_total
    t = density_chunks(telemetry(spark, sf).select("joint_idx", "session_id", "us"), ["session_id"], "us")
    t = t.withColumn("_ck", F.struct("session_id", "_ck"))
    d = running_total(t, [], ["session_id", "us", "joint_idx"], F.lit(1), "_ck", "position")
    return d.select("joint_idx", "session_id", "position").orderBy("position")


def violations_sql(source, rows):
    values = ", ".join(f"('{c}', '{p}')" for c, p in rows)
    return f"""SELECT v.*, n_rows FROM (VALUES {values}) v("column", problem), (SELECT count(*) AS n_rows FROM {source})"""


@query("u03_schema_difference", violations_sql("events", [("speed", "type"), ("ping", "missing"), ("value", "extra")]))
def u03(spark, sf):
    want = T.StructType().add("joint_idx", "long").add("session_id", "string").add("speed", "float").add("ping", "double")
    d = telemetry(spark, sf).select("joint_idx", "session_id", "speed", "value")
    return quality.schema_violations(d, want).withColumn("n_rows", d.select(F.count("*")).scalar())


@query("u04_key_universe_equality", f"""
WITH {TEL}, a AS (SELECT joint_idx FROM tel WHERE event_type <> 'error'), b AS (SELECT joint_idx FROM tel WHERE event_type <> 'view')
SELECT (SELECT count(*) FROM (SELECT * FROM a EXCEPT ALL SELECT * FROM b)) AS only_a, (SELECT count(*) FROM (SELECT * FROM b EXCEPT ALL SELECT * FROM a)) AS only_b, false AS equal""")
def u04(spark, sf):
    t = telemetry(spark, sf)
    return quality.same_keys(t.filter("event_type <> 'error'").select("joint_idx"), t.filter("event_type <> 'view'").select("joint_idx"))


@query("x01_math_functions", f"""
WITH {TEL} SELECT joint_idx, round(sqrt(x_m*x_m + y_m*y_m), 6) AS hyp, round(atan2(y_m, x_m), 6) AS ang, round(sin(heading_rad), 6) AS sn, round(cos(heading_rad), 6) AS cs, round(log10(value + 1), 6) AS lg,
  round(radians(degrees(heading_rad)), 6) AS rad, round(sqrt(value), 6) AS rt, sign(heading_rad)::DOUBLE AS sg FROM tel""")
def x01(spark, sf):
    h = F.col("heading_rad")
    return telemetry(spark, sf).select(
        "joint_idx", rnd(F.hypot("x_m", "y_m")).alias("hyp"), rnd(F.atan2("y_m", "x_m")).alias("ang"), rnd(F.sin(h)).alias("sn"), rnd(F.cos(h)).alias("cs"),
        rnd(F.log10(F.col("value") + 1)).alias("lg"), rnd(F.radians(F.degrees(h))).alias("rad"), rnd(F.sqrt("value")).alias("rt"), F.signum(h).alias("sg"))


@query("x02_x03_x04_wrap_bin_clip", f"""
WITH {TEL} SELECT joint_idx, round(3*heading_rad + pi() - 2*pi()*floor((3*heading_rad + pi())/(2*pi())) - pi(), 6) AS wrapped, CAST(floor((x_m - 10)/0.5) AS BIGINT) AS bin,
  CAST(floor(degrees(heading_rad)/30) AS BIGINT) AS hb, round(least(greatest(heading_rad, -1), 1), 6) AS clipped FROM tel""")
def x02(spark, sf):
    h = F.col("heading_rad")
    return telemetry(spark, sf).select("joint_idx", rnd(wrap_angle(3 * h)).alias("wrapped"), cell(F.col("x_m") - 10, 0.5).alias("bin"),
                                       cell(F.degrees(h), 30).alias("hb"), rnd(clip(h, -1, 1)).alias("clipped"))


@query("x05_finite_test", f"""
WITH {TEL}, v AS (SELECT joint_idx, CASE joint_idx % 4 WHEN 0 THEN 'NaN'::DOUBLE WHEN 1 THEN 'Infinity'::DOUBLE WHEN 2 THEN NULL ELSE value END AS v FROM tel)
SELECT joint_idx, coalesce(isfinite(v), false) AS ok FROM v""")
def x05(spark, sf):
    m = F.col("joint_idx") % 4
    v = F.when(m == 0, F.lit(float("nan"))).when(m == 1, F.lit(float("inf"))).when(m == 3, F.col("value"))
    return telemetry(spark, sf).select("joint_idx", finite(v).alias("ok"))


@query("x06_text_helpers", """
SELECT event_id, trim('  ' || event_type || ' ') AS trimmed, event_type IN ('click', 'view') AS member, string_split(props, ':')[2] AS part,
 regexp_replace('b''' || event_type || '''', '^b''|''$', '', 'g') AS bare FROM events""")
def x06(spark, sf):
    e = F.col("event_type")
    return events(spark, sf).select("event_id", F.trim(F.concat(F.lit("  "), e, F.lit(" "))).alias("trimmed"), e.isin("click", "view").alias("member"),
                                    F.split("props", ":").getItem(1).alias("part"),
                                    F.regexp_replace(F.concat(F.lit("b'"), e, F.lit("'")), "^b'|'$", "").alias("bare"))


@query("x08_signed_duration", """
WITH d AS (SELECT event_id, (value - 50)*1000.25 AS s FROM events), m AS (SELECT event_id, s, CAST(round(abs(s)*1000) AS BIGINT) AS ms FROM d)
SELECT event_id, CASE WHEN s < 0 THEN '-' ELSE '+' END || printf('%02d:%02d:%02d.%03d', ms//3600000, (ms//60000) % 60, (ms//1000) % 60, ms % 1000) AS text FROM m""")
def x08(spark, sf):
    return events(spark, sf).select("event_id", signed_duration((F.col("value") - 50) * 1000.25).alias("text"))


@query("x09_tolerant_equality", f"""
WITH {TEL}, p AS (SELECT joint_idx, CASE WHEN joint_idx % 6 = 0 THEN NULL ELSE value END AS a, CASE joint_idx % 6 WHEN 0 THEN NULL WHEN 1 THEN NULL WHEN 2 THEN value*(1 + 1e-10) WHEN 3 THEN value + 0.01 ELSE value END AS b FROM tel)
SELECT joint_idx, coalesce(a IS NOT DISTINCT FROM b OR abs(a - b) <= 1e-12 + 1e-9*abs(b), false) AS same FROM p""")
def x09(spark, sf):
    m, v = F.col("joint_idx") % 6, F.col("value")
    a = F.when(m != 0, v)
    b = F.when(m == 2, v * (1 + 1e-10)).when(m == 3, v + 0.01).when(m > 3, v)
    return telemetry(spark, sf).select("joint_idx", a.alias("a"), b.alias("b")).select("joint_idx", near("a", "b").alias("same"))


PROFILE_COLS = ["value", "confidence", "x_m", "signal"]


@query("a36_column_profile", f"WITH {TEL} " + " UNION ALL ".join(
    f"""SELECT session_id, '{c}' AS "column", count(*) AS n, count({c}) AS n_finite, round(min({c}), 6) AS lo, round(max({c}), 6) AS hi, round(avg({c}), 6) AS mean,
    CASE WHEN count({c}) < count(*) AND '{c}' <> 'confidence' THEN 'null_not_allowed' WHEN min({c}) < -100 OR max({c}) > 101 THEN 'out_of_range' ELSE 'ok' END AS verdict FROM tel GROUP BY 1"""
    for c in PROFILE_COLS))
def a36(spark, sf):
    p = quality.column_profile(telemetry(spark, sf), ["session_id"], PROFILE_COLS)
    verdict = (F.when((F.col("n_finite") < F.col("n")) & (F.col("column") != "confidence"), "null_not_allowed")
               .when((F.col("lo") < -100) | (F.col("hi") > 101), "out_of_range").otherwise("ok"))
    return p.select("session_id", "column", "n", "n_finite", rnd("lo").alias("lo"), rnd("hi").alias("hi"), rnd("mean").alias("mean"), verdict.alias("verdict"))


@query("q01_schema_check", violations_sql("events", [("value", "type"), ("props", "extra")]))
def q01(spark, sf):
    want = T.StructType().add("event_id", "long").add("ts", "timestamp_ntz").add("user_id", "long").add("event_type", "string").add("value", "float")
    d = table(spark, sf, "events")
    return quality.schema_violations(d, want).withColumn("n_rows", d.select(F.count("*")).scalar())


@query("q02_key_unique_and_dense", "SELECT count(*) AS n_rows, count(DISTINCT event_id) AS n_keys, min(event_id) AS lo, max(event_id) AS hi, count(*) = count(DISTINCT event_id) AND min(event_id) = 0 AND max(event_id) = count(*) - 1 AS ok FROM events")
def q02(spark, sf):
    return quality.key_density(events(spark, sf), "event_id")


@query("q03_counts_vs_expectation", """
WITH n AS (SELECT l_returnflag, count(*) AS n FROM lineitem GROUP BY 1), e AS (SELECT l_returnflag, count(*) AS expected FROM lineitem WHERE l_linestatus = 'O' OR l_returnflag <> 'N' GROUP BY 1)
SELECT coalesce(n.l_returnflag, e.l_returnflag) AS l_returnflag, coalesce(n, 0) AS n, coalesce(expected, 0) AS expected, coalesce(n, 0) = coalesce(expected, 0) AS ok FROM n FULL JOIN e ON n.l_returnflag = e.l_returnflag""")
def q03(spark, sf):
    d = table(spark, sf, "lineitem")
    e = d.filter("l_linestatus = 'O' OR l_returnflag <> 'N'").groupBy("l_returnflag").agg(F.count("*").alias("expected"))
    return quality.expected_counts(d, ["l_returnflag"], e)


@query("q04_timestamp_identities", f"""
WITH joint AS ({SQL["j01_joint_table"]}),
moved AS (SELECT * REPLACE (CASE WHEN event_id % 5 = 0 THEN us + 1500 ELSE us END AS us, CASE WHEN event_id % 7 = 0 THEN delta_t_s + 0.25 ELSE delta_t_s END AS delta_t_s) FROM joint),
src AS (SELECT m.*, epoch_us(l.ts) AS l_us, epoch_us(r.ts) AS r_us FROM moved m LEFT JOIN events l ON l.event_id = m.event_id LEFT JOIN events r ON r.event_id = m.right_id)
SELECT user_id % 3 AS g, count(*) AS n, count(*) FILTER (l_us IS DISTINCT FROM raw_us) AS n_raw_differs, count(*) FILTER (r_us IS DISTINCT FROM right_us) AS n_right_differs,
  count(*) FILTER (l_us - offset_s*1000000 <> us) AS n_shift_off, count(*) FILTER (abs((us - r_us)/1e6 - delta_t_s) > 1e-6) AS n_delta_off,
  count(*) FILTER (abs(us - r_us) > tolerance_us) AS n_over FROM src GROUP BY 1""")
def q04(spark, sf):
    """Both clocks of the joint table against the streams it was made from; some of its rows are spoilt first."""
    from scanweave.plans.registry import QUERIES
    e = F.col("event_id")
    j = QUERIES["j01_joint_table"](spark, sf)
    j = j.withColumn("us", F.when(e % 5 == 0, F.col("us") + 1500).otherwise(F.col("us"))).withColumn(
        "delta_t_s", F.when(e % 7 == 0, F.col("delta_t_s") + 0.25).otherwise(F.col("delta_t_s")))
    src = table(spark, sf, "events").select("event_id", F.unix_micros(F.col("ts").cast("timestamp")).alias("t"))
    j = (j.join(src.withColumnRenamed("t", "l_us"), "event_id", "left")
         .join(src.select(F.col("event_id").alias("right_id"), F.col("t").alias("r_us")), "right_id", "left"))
    gap = F.col("us") - F.col("r_us")
    return j.groupBy((F.col("user_id") % 3).alias("g")).agg(
        F.count("*").alias("n"), F.count_if(~F.col("l_us").eqNullSafe(F.col("raw_us"))).alias("n_raw_differs"),
        F.count_if(~F.col("r_us").eqNullSafe(F.col("right_us"))).alias("n_right_differs"),
        F.count_if(F.col("l_us") - F.col("offset_s") * 1_000_000 != F.col("us")).alias("n_shift_off"),
        F.count_if(F.abs(gap / 1e6 - F.col("delta_t_s")) > 1e-6).alias("n_delta_off"), F.count_if(F.abs(gap) > F.col("tolerance_us")).alias("n_over"))


@query("q05_constant_per_group", f"""
WITH {TEL}, g AS (SELECT run_id, min(tau) AS lo, max(tau) AS hi FROM (SELECT run_id, CASE WHEN joint_idx % 501 = 0 THEN 0.9 ELSE (run_id % 3)*0.1 END AS tau FROM tel) GROUP BY 1)
SELECT run_id, round(lo, 6) AS lo, round(hi, 6) AS hi, round((run_id % 3)*0.1, 6) AS reference, lo = hi AND abs(lo - (run_id % 3)*0.1) <= 1e-9 AS ok FROM g""")
def q05(spark, sf):
    r = (F.col("run_id") % 3) * F.lit(0.1)
    t = telemetry(spark, sf).withColumn("tau", F.when(F.col("joint_idx") % 501 == 0, 0.9).otherwise(r))
    ref = t.select("run_id").distinct().withColumn("reference", r)
    return quality.group_constants(t, ["run_id"], "tau", ref).select("run_id", rnd("lo").alias("lo"), rnd("hi").alias("hi"), rnd("reference").alias("reference"), "ok")


@query("q10_fit_r2_vs_reference", f"""
WITH {TEL}, {AP}, {FIT}, s AS (SELECT session_id, r2 FROM fit),
c AS (SELECT session_id, 1 - sum((signal - a - b*logd)*(signal - a - b*logd))/sum((signal - m)*(signal - m)) AS reference FROM
  (SELECT session_id, signal, logd, regr_intercept(signal, logd) OVER w AS a, regr_slope(signal, logd) OVER w AS b, avg(signal) OVER w AS m FROM ld WINDOW w AS (PARTITION BY session_id)) GROUP BY 1)
SELECT session_id, round(r2, 6) AS r2, round(reference, 6) AS reference, abs(r2 - reference) <= 1e-9 AS ok FROM s JOIN c USING (session_id)""")
def q10(spark, sf):
    """The fit's r2 against one from its residuals: a second pass over the rows with the fitted line."""
    d = with_logd(spark, sf)
    f = line_fit(d, ["session_id"], "signal", "logd")
    mean = d.groupBy("session_id").agg(F.avg("signal").alias("m"))
    off, dev = F.col("signal") - F.col("intercept") - F.col("slope") * F.col("logd"), F.col("signal") - F.col("m")
    c = (d.join(f.select("session_id", "slope", "intercept").join(mean, "session_id"), "session_id").groupBy("session_id")
         .agg((1 - F.sum(off * off) / F.sum(dev * dev)).alias("reference")))
    return f.join(c, "session_id").select("session_id", rnd("r2").alias("r2"), rnd("reference").alias("reference"),
                                          (F.abs(F.col("r2") - F.col("reference")) <= 1e-9).alias("ok"))


@query("q12_version_on_every_row", f"""
WITH {TEL}, m AS (SELECT session_id, event_type, CASE WHEN session_id = 's2' AND event_type = 'view' THEN 'v0' ELSE 'v1' END AS version FROM tel)
SELECT session_id, count(*) AS n, count(*) FILTER (version <> 'v1') AS n_old, count(*) FILTER (version <> 'v1') = 0 AS ok FROM m GROUP BY 1""")
def q12(spark, sf):
    old = (F.col("session_id") == "s2") & (F.col("event_type") == "view")
    d = quality.count_where(telemetry(spark, sf), ["session_id"], {"n_old": old})
    return d.withColumn("ok", F.col("n_old") == 0)
