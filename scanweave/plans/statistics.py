"""Summaries, fits, rank statistics, histograms and thresholds."""

from __future__ import annotations

from pyspark.sql import functions as F

from scanweave.functions.exprs import rnd
from scanweave.operators.quantiles import exact_quantiles
from scanweave.operators.stats import (choose_threshold, fit_position, histogram_saddle, line_fit, log_distance,
                                       mixture_crossover, mixture_em, roc_sweep, spearman, spearman_by_stratum, replicate_sums, value_histogram)
from scanweave.plans.clocks import T_TAIL
from scanweave.plans.registry import query
from scanweave.plans.sequences import DISC, disc
from scanweave.plans.views import AP, table, telemetry, transmitters, TEL
from scanweave.session import stored

SUMMARY = """session_id, count(DISTINCT run_id) AS n_runs, count(*) AS n, round((max(us) - min(us))/3600e6, 6) AS duration_h, round(max(speed), 6) AS speed_max,
  round(avg(CASE WHEN speed > 0.05 THEN 1.0 ELSE 0.0 END), 6) AS motion_fraction, round(avg(signal), 6) AS signal_mean,
  round(stddev_samp(signal), 6) AS signal_std, round(avg(confidence), 6) AS quality_mean, round(quantile_cont(value, 0.95), 6) AS value_p95,
  round(min(x_m), 4) AS x_min, round(max(x_m), 4) AS x_max, round(min(y_m), 4) AS y_min, round(max(y_m), 4) AS y_max"""


def summary(t):
    s = t.groupBy("session_id").agg(
        F.countDistinct("run_id").alias("n_runs"), F.count("*").alias("n"),
        rnd((F.max("us") - F.min("us")) / 3600e6).alias("duration_h"), rnd(F.max("speed")).alias("speed_max"),
        rnd(F.avg((F.col("speed") > 0.05).cast("double"))).alias("motion_fraction"), rnd(F.avg("signal")).alias("signal_mean"),
        rnd(F.stddev_samp("signal")).alias("signal_std"), rnd(F.avg("confidence")).alias("quality_mean"),
        rnd(F.min("x_m"), 4).alias("x_min"), rnd(F.max("x_m"), 4).alias("x_max"), rnd(F.min("y_m"), 4).alias("y_min"),
        rnd(F.max("y_m"), 4).alias("y_max"))
    q = exact_quantiles(t, ["session_id"], "value", {"value_p95": 0.95})
    return s.join(q, "session_id").withColumn("value_p95", rnd("value_p95"))


@query("a01_session_summary", f"WITH {TEL} SELECT {SUMMARY} FROM tel GROUP BY 1")
def a01(spark, sf):
    return summary(telemetry(spark, sf))


@query("a42_delta_vs_previous_release", f"""
WITH {TEL}, cut AS (SELECT 1704067200000000 + 20*86400000000 AS c), n AS (SELECT {SUMMARY} FROM tel GROUP BY 1),
o AS (SELECT {SUMMARY} FROM tel WHERE us < (SELECT c FROM cut) AND session_id <> 's2' GROUP BY 1)
SELECT coalesce(n.session_id, o.session_id) AS session_id, n.n - o.n AS d_rows, round(n.signal_mean - o.signal_mean, 6) AS d_signal,
  round((n.signal_mean - o.signal_mean)/o.signal_std, 6) AS d_signal_sigmas, round(n.value_p95 - o.value_p95, 6) AS d_p95,
  CASE WHEN o.session_id IS NULL THEN 'new' WHEN n.session_id IS NULL THEN 'gone' ELSE 'both' END AS state
FROM n FULL JOIN o USING (session_id)""")
def a42(spark, sf):
    t = telemetry(spark, sf)
    new = summary(t)
    old = summary(t.filter((F.col("us") < 1704067200000000 + 20 * 86400000000) & (F.col("session_id") != "s2")))
    n, o = new.alias("n"), old.alias("o")
    d = n.join(o, F.col("n.session_id") == F.col("o.session_id"), "full")
    ds = F.col("n.signal_mean") - F.col("o.signal_mean")
    return d.select(F.coalesce("n.session_id", "o.session_id").alias("session_id"), (F.col("n.n") - F.col("o.n")).alias("d_rows"),
                    rnd(ds).alias("d_signal"), rnd(ds / F.col("o.signal_std")).alias("d_signal_sigmas"),
                    rnd(F.col("n.value_p95") - F.col("o.value_p95")).alias("d_p95"),
                    F.when(F.col("o.session_id").isNull(), "new").when(F.col("n.session_id").isNull(), "gone").otherwise("both").alias("state"))


LOGD = "log10(greatest(sqrt((x_m-ap_x)*(x_m-ap_x)+(y_m-ap_y)*(y_m-ap_y)), CAST(0.05 AS DOUBLE)))"


def with_logd(spark, sf):
    t = telemetry(spark, sf).join(F.broadcast(transmitters(spark)), "session_id")  # three fixed rows
    return t.withColumn("logd", log_distance(F.col("x_m"), F.col("y_m"), F.col("ap_x"), F.col("ap_y")))


FIT = f"""
ld AS (SELECT tel.*, {LOGD} AS logd FROM tel JOIN ap USING (session_id)),
fit AS (SELECT session_id, count(*) AS n, regr_slope(signal, logd) AS slope, regr_intercept(signal, logd) AS intercept, regr_r2(signal, logd) AS r2 FROM ld GROUP BY 1)"""


@query("a10_log_distance_fit", f"""
WITH {TEL}, {AP}, {FIT} SELECT session_id, n, round(slope, 6) AS slope, round(intercept, 6) AS intercept, round(-slope/10, 6) AS exponent, round(r2, 6) AS r2 FROM fit""")
def a10(spark, sf):
    f = line_fit(with_logd(spark, sf), ["session_id"], "signal", "logd")
    return f.select("session_id", "n", rnd("slope").alias("slope"), rnd("intercept").alias("intercept"),
                    rnd(-F.col("slope") / 10).alias("exponent"), rnd("r2").alias("r2"))


@query("a10_line_fit_lineitem", """
SELECT l_returnflag, l_linestatus, count(*) AS n, round(regr_slope(l_extendedprice, log10(l_quantity)), 3) AS slope,
  round(regr_intercept(l_extendedprice, log10(l_quantity)), 3) AS intercept, round(regr_r2(l_extendedprice, log10(l_quantity)), 6) AS r2 FROM lineitem GROUP BY 1, 2""")
def a10l(spark, sf):
    d = table(spark, sf, "lineitem").withColumn("lq", F.log10("l_quantity"))
    f = line_fit(d, ["l_returnflag", "l_linestatus"], "l_extendedprice", "lq")
    return f.select("l_returnflag", "l_linestatus", "n", rnd("slope", 3).alias("slope"), rnd("intercept", 3).alias("intercept"), rnd("r2").alias("r2"))


@query("a12_fit_residuals", f"""
WITH {TEL}, {AP}, {FIT} SELECT joint_idx, session_id, round(intercept + slope*logd, 6) AS fitted, round(signal - (intercept + slope*logd), 6) AS residual FROM ld JOIN fit USING (session_id)""")
def a12(spark, sf):
    d = with_logd(spark, sf)
    f = line_fit(d, ["session_id"], "signal", "logd").select("session_id", "slope", "intercept")
    p = F.col("intercept") + F.col("slope") * F.col("logd")
    return d.join(f, "session_id").select("joint_idx", "session_id", rnd(p).alias("fitted"), rnd(F.col("signal") - p).alias("residual"))


def cand_sql(name, centre, src, reach, step):
    m = round(reach / step)
    return f"""
{name}c AS (SELECT c.session_id, round(cx + i*{step}, 6) AS fx, round(cy + j*{step}, 6) AS fy FROM {centre} c,
  (SELECT unnest(range(-{m}, {m + 1})) AS i), (SELECT unnest(range(-{m}, {m + 1})) AS j)),
{name}l AS (SELECT p.session_id, fx, fy, log10(greatest(sqrt((x_m-fx)*(x_m-fx)+(y_m-fy)*(y_m-fy)), CAST(0.05 AS DOUBLE))) AS l, signal AS s
  FROM {src} p JOIN {name}c c USING (session_id)),
{name}m AS (SELECT session_id, fx, fy, count(*) AS n, sum(s) AS sy, sum(s*s) AS syy, sum(l) AS sx, sum(l*l) AS sxx, sum(s*l) AS sxy FROM {name}l GROUP BY 1, 2, 3),
{name}b AS (SELECT *, least(greatest((n*sxy - sx*sy)/(n*sxx - sx*sx), -60), -10) AS b FROM {name}m),
{name}a AS (SELECT *, least(greatest((sy - b*sx)/n, -120), 0) AS a FROM {name}b),
{name}r AS (SELECT *, round(syy - 2*a*sy - 2*b*sxy + n*a*a + 2*a*b*sx + b*b*sxx, 6) AS rss, syy - sy*sy/n AS tss FROM {name}a),
{name}f AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY session_id ORDER BY rss, fx, fy) AS rn FROM {name}r) WHERE rn = 1)"""


@query("a11_free_position_fit", f"""
WITH {TEL}, {AP}, p0 AS (SELECT session_id, ap_x AS cx, ap_y AS cy FROM ap), {cand_sql("u", "p0", "tel", 3.0, 0.5)},
p1 AS (SELECT session_id, fx AS cx, fy AS cy FROM uf), {cand_sql("v", "p1", "tel", 0.4, 0.1)}
SELECT session_id, n, round(CASE WHEN ok THEN fx ELSE ap_x END, 4) AS x_ap, round(CASE WHEN ok THEN fy ELSE ap_y END, 4) AS y_ap, round(a, 4) AS p0,
  round(-b/10, 4) AS exponent, round(1 - rss/tss, 4) AS r2, NOT ok AS fell_back FROM
  (SELECT vf.*, ap_x, ap_y, sqrt((fx-ap_x)*(fx-ap_x)+(fy-ap_y)*(fy-ap_y)) <= 3 AND 1 - rss/tss >= 0.05 AS ok FROM vf JOIN ap USING (session_id))""")
def a11(spark, sf):
    t = telemetry(spark, sf)
    pts = t.groupBy("session_id", "x_m", "y_m").agg(F.count("*").alias("n"), F.sum("signal").alias("s"),
                                                    F.sum(F.col("signal") * F.col("signal")).alias("q"))
    size = t.groupBy("session_id").agg(F.count("*").alias("n"))
    ap = transmitters(spark)
    coarse = fit_position(pts.join(F.broadcast(ap), "session_id"), ["session_id"], (F.col("ap_x"), F.col("ap_y")), 3.0, 0.5)
    fine = fit_position(pts.join(coarse.select("session_id", F.col("fx").alias("px"), F.col("fy").alias("py")), "session_id"),
                        ["session_id"], (F.col("px"), F.col("py")), 0.4, 0.1)
    d = fine.join(ap, "session_id").join(size, "session_id")
    ok = (F.hypot(F.col("fx") - F.col("ap_x"), F.col("fy") - F.col("ap_y")) <= 3) & (F.col("r2") >= 0.05)
    return d.select("session_id", "n", rnd(F.when(ok, F.col("fx")).otherwise(F.col("ap_x")), 4).alias("x_ap"),
                    rnd(F.when(ok, F.col("fy")).otherwise(F.col("ap_y")), 4).alias("y_ap"), rnd("a", 4).alias("p0"),
                    rnd(-F.col("b") / 10, 4).alias("exponent"), rnd("r2", 4).alias("r2"), (~ok).alias("fell_back"))


def draw_sql(src, columns, reps, seed):
    """Rows x replicates with the uniform number u of ``mixed_unit``."""
    p = 2147483647
    return f"""SELECT {columns}, rep, ((u3*u3 + u2) % {p})/{p} AS u FROM (SELECT *, (u2*u2 + u1*39373 + 1013904223) % {p} AS u3 FROM
  (SELECT *, (u1*u1 + rep*16807 + ((joint_idx // {p}) % {p})*40692 + 12345) % {p} AS u2 FROM (SELECT *, ((joint_idx % {p})*48271 + rep*69621 + {seed}) % {p} AS u1 FROM {src}, (SELECT unnest(range(1, {reps + 1})) AS rep))))"""


POIS = "(CASE " + " ".join(f"WHEN u < {c!r}::DOUBLE THEN {i}" for i, c in enumerate(
    __import__("scanweave.operators.stats", fromlist=["POISSON1"]).POISSON1)) + " ELSE 9 END)"


@query("a31_bootstrap_fit_parameters", f"""
WITH {TEL}, {AP}, {FIT}, r AS ({draw_sql("ld", "session_id, signal AS s, logd AS l", 200, 7)}),
w AS (SELECT *, {POIS} AS w FROM r), m AS (SELECT session_id, rep, sum(w) AS n, sum(w*l) AS sx, sum(w*s) AS sy, sum(w*l*l) AS sxx, sum(w*l*s) AS sxy FROM w GROUP BY 1, 2),
b AS (SELECT session_id, (n*sxy - sx*sy)/(n*sxx - sx*sx) AS slope, (sy - (n*sxy - sx*sy)/(n*sxx - sx*sx)*sx)/n AS icept FROM m)
SELECT session_id, round(quantile_cont(slope, 0.025), 6) AS slope_lo, round(quantile_cont(slope, 0.975), 6) AS slope_hi,
  round(stddev_samp(icept), 6) AS intercept_sd FROM b GROUP BY 1""")
def a31(spark, sf):
    l, s = F.col("logd"), F.col("signal")
    d = with_logd(spark, sf).select("session_id", "joint_idx", l.alias("sx"), s.alias("sy"), (l * l).alias("sxx"), (l * s).alias("sxy"))
    m = replicate_sums(d, ["session_id"], "joint_idx", ["sx", "sy", "sxx", "sxy"], 200, 7).withColumnRenamed("w", "n")
    slope = (F.col("n") * F.col("sxy") - F.col("sx") * F.col("sy")) / (F.col("n") * F.col("sxx") - F.col("sx") * F.col("sx"))
    b = stored(m.select("session_id", slope.alias("slope"), ((F.col("sy") - slope * F.col("sx")) / F.col("n")).alias("icept")))
    q = exact_quantiles(b, ["session_id"], "slope", {"slope_lo": 0.025, "slope_hi": 0.975})
    sd = b.groupBy("session_id").agg(rnd(F.stddev_samp("icept")).alias("intercept_sd"))
    return q.join(sd, "session_id").select("session_id", rnd("slope_lo").alias("slope_lo"), rnd("slope_hi").alias("slope_hi"), "intercept_sd")


FEATS = ["value", "confidence", "x_m", "signal"]
PAIRS = [(a, b) for i, a in enumerate(FEATS) for b in FEATS[i + 1:]]
RANKED = """
ok AS (SELECT * FROM lng WHERE x IS NOT NULL AND y IS NOT NULL),
rk AS (SELECT {k}, rank() OVER (PARTITION BY {k} ORDER BY x) + (count(*) OVER (PARTITION BY {k}, x) - 1)/2 AS rx,
  rank() OVER (PARTITION BY {k} ORDER BY y) + (count(*) OVER (PARTITION BY {k}, y) - 1)/2 AS ry FROM ok)"""


@query("a13_correlation_matrix", f"""
WITH {TEL}, lng AS (""" + " UNION ALL ".join(
    f"SELECT session_id, '{a}' AS a, '{b}' AS b, {a} AS x, {b} AS y FROM tel" for a, b in PAIRS) + "), " + RANKED.format(k="session_id, a, b") + """
, p AS (SELECT session_id, a, b, corr(x, y) AS pearson FROM lng GROUP BY 1, 2, 3), s AS (SELECT session_id, a, b, corr(rx, ry) AS rho FROM rk GROUP BY 1, 2, 3)
SELECT session_id, a, b, round(pearson, 6) AS pearson, round(rho, 6) AS spearman FROM p JOIN s USING (session_id, a, b)""")
def a13(spark, sf):
    t = telemetry(spark, sf)
    lng = t.select("session_id", F.inline(F.array(*[F.struct(
        F.lit(a).alias("a"), F.lit(b).alias("b"), F.col(a).alias("x"), F.col(b).alias("y")) for a, b in PAIRS])))
    keys = ["session_id", "a", "b"]
    p = lng.groupBy(*keys).agg(rnd(F.corr("x", "y")).alias("pearson"))
    return p.join(spearman(lng, keys, "x", "y"), keys).select(*keys, "pearson", rnd("rho").alias("spearman"))


STRATA_SQL = """
st AS (SELECT *, unnest(['all', CASE WHEN speed > 0.5 THEN 'moving' END, CASE WHEN x_m < 1 THEN 'edge' END]) AS stratum FROM tel),
lng AS (SELECT session_id, stratum, 'speed' AS feature, speed AS x, signal AS y FROM st WHERE stratum IS NOT NULL
  UNION ALL SELECT session_id, stratum, 'confidence', confidence, signal FROM st WHERE stratum IS NOT NULL
  UNION ALL SELECT session_id, stratum, 'heading', heading_rad, signal FROM st WHERE stratum IS NOT NULL)"""
STRATA = STRATA_SQL + "," + RANKED.format(k="session_id, stratum, feature") + """,
sp AS (SELECT session_id, stratum, feature, count(*) AS n, CASE WHEN count(*) >= 170 THEN corr(rx, ry) END AS rho FROM rk GROUP BY 1, 2, 3)"""


def strata(spark, sf):
    where = {"all": F.lit(True), "moving": F.col("speed") > 0.5, "edge": F.col("x_m") < 1}
    features = {"speed": "speed", "confidence": "confidence", "heading": "heading_rad"}
    return spearman_by_stratum(telemetry(spark, sf), ["session_id"], where, features, "signal", 170)


@query("a14_spearman_by_stratum", f"WITH {TEL}, {STRATA} SELECT session_id, stratum, feature, n, round(rho, 6) AS rho FROM sp")
def a14(spark, sf):
    return strata(spark, sf).withColumn("rho", rnd("rho"))


@query("a14_spearman_p_value", f"""
WITH {TEL}, {STRATA}, ts AS (SELECT *, rho*sqrt((n-2)/(1-rho*rho)) AS t, n - 2.0 AS df FROM sp WHERE rho IS NOT NULL AND abs(rho) < 1), {T_TAIL.format(k="session_id, stratum, feature", src="ts")}
SELECT session_id, stratum, feature, n, round(rho, 6) AS rho, p FROM ts JOIN tp USING (session_id, stratum, feature)""")
def a14p(spark, sf):
    from scanweave.functions.tails import t_two_sided
    r = strata(spark, sf).filter("rho IS NOT NULL AND abs(rho) < 1")
    t = F.col("rho") * F.sqrt((F.col("n") - 2) / (1 - F.col("rho") * F.col("rho")))
    return r.withColumn("p", t_two_sided(t, F.col("n") - 2)).select(
        "session_id", "stratum", "feature", "n", rnd("rho").alias("rho"), rnd("p").alias("p"))


@query("w29_headline_feature", f"""
WITH {TEL}, {STRATA} SELECT stratum, session_id, feature, round(rho, 6) AS rho FROM
 (SELECT *, row_number() OVER (PARTITION BY stratum ORDER BY abs(rho) DESC, session_id, feature) AS rn FROM sp WHERE rho IS NOT NULL) WHERE rn = 1""")
def w29(spark, sf):
    r = strata(spark, sf).filter("rho IS NOT NULL")
    first = F.struct((-F.abs("rho")).alias("o"), "session_id", "feature", "rho")
    return r.groupBy("stratum").agg(F.min(first).alias("m")).select(
        "stratum", "m.session_id", "m.feature", rnd("m.rho").alias("rho"))


def binned_sql(src, keys, x, y, nb):
    return f"""lim AS (SELECT {keys}, quantile_cont({x}, 0.01) AS lo, quantile_cont({x}, 0.99) AS hi FROM {src} GROUP BY ALL),
b AS (SELECT {src}.*, CAST(ceil(({x} - lo)/((hi - lo)/{nb})) AS BIGINT) - 1 AS bin FROM {src} JOIN lim USING ({keys}) WHERE {x} > lo AND {x} <= hi)
SELECT {keys}, bin, count(*) AS n, round(quantile_cont({y}, 0.25), 4) AS q1, round(quantile_cont({y}, 0.5), 4) AS med, round(quantile_cont({y}, 0.75), 4) AS q3 FROM b GROUP BY ALL"""


def binned(df, keys, x, y, nb):
    """Conditional quartiles of y over equal-width, right-closed bins of x."""
    lim = stored(exact_quantiles(df, keys, x, {"lo": 0.01, "hi": 0.99}))
    w = (F.col("hi") - F.col("lo")) / nb
    b = df.join(lim, keys).filter((F.col(x) > F.col("lo")) & (F.col(x) <= F.col("hi")))
    b = b.withColumn("bin", (F.ceil((F.col(x) - F.col("lo")) / w) - 1).cast("long"))
    keys = [*keys, "bin"]
    q = exact_quantiles(b, keys, y, {"q1": 0.25, "med": 0.5, "q3": 0.75})
    return b.groupBy(*keys).agg(F.count("*").alias("n")).join(q, keys).select(
        *keys, "n", *[rnd(c, 4).alias(c) for c in ("q1", "med", "q3")])


@query("a16_binned_conditional_quartiles", f"WITH {TEL}, {binned_sql('tel', 'session_id', 'heading_rad', 'signal', 12)}")
def a16(spark, sf):
    return binned(telemetry(spark, sf).select("session_id", "heading_rad", "signal"), ["session_id"], "heading_rad", "signal", 12)


@query("a16_binned_quartiles_lineitem", f"WITH {binned_sql('lineitem', 'l_returnflag', 'l_extendedprice', 'l_quantity', 24)}")
def a16l(spark, sf):
    d = table(spark, sf, "lineitem").select("l_returnflag", "l_extendedprice", "l_quantity")
    return binned(d, ["l_returnflag"], "l_extendedprice", "l_quantity", 24)


@query("a17_percentile_clipped_histogram", f"""
WITH {TEL}, lim AS (SELECT session_id, quantile_cont(signal, 0.005) AS lo, quantile_cont(signal, 0.995) AS hi FROM tel GROUP BY 1)
SELECT session_id, least(CAST(floor((signal - lo)/((hi - lo)/20)) AS BIGINT), 19) AS bin, count(*) AS n FROM tel JOIN lim USING (session_id)
WHERE signal BETWEEN lo AND hi GROUP BY 1, 2""")
def a17(spark, sf):
    t = telemetry(spark, sf).select("session_id", "signal")
    lim = exact_quantiles(t, ["session_id"], "signal", {"lo": 0.005, "hi": 0.995})
    b = F.least(F.floor((F.col("signal") - F.col("lo")) / ((F.col("hi") - F.col("lo")) / 20)), F.lit(19))
    return (t.join(lim, "session_id").filter("signal BETWEEN lo AND hi").groupBy("session_id", b.alias("bin")).agg(F.count("*").alias("n")))


HIST = """
hb AS (SELECT b AS bin, coalesce(c, 0) AS c FROM (SELECT unnest(range(0, 101)) AS b) LEFT JOIN
 (SELECT CAST(floor(cv + 0.5) AS BIGINT) AS b, count(*) AS c FROM shaped WHERE cv IS NOT NULL GROUP BY 1) USING (b)),
sm AS (SELECT bin, c, (coalesce(lag(c, 2) OVER w, f) + coalesce(lag(c, 1) OVER w, f) + c + coalesce(lead(c, 1) OVER w, l) + coalesce(lead(c, 2) OVER w, l))/5 AS s
  FROM hb, (SELECT arg_min(c, bin) AS f, arg_max(c, bin) AS l FROM hb) WINDOW w AS (ORDER BY bin)),
pk AS (SELECT bin, s FROM (SELECT *, lag(s) OVER w AS p, lead(s) OVER w AS x FROM sm WINDOW w AS (ORDER BY bin)) WHERE s > p AND s >= x),
p1 AS (SELECT bin AS a FROM pk ORDER BY s DESC, bin LIMIT 1),
p2 AS (SELECT bin AS b FROM pk, p1 WHERE abs(bin - a) >= 20 ORDER BY s DESC, bin LIMIT 1),
sad AS (SELECT (SELECT a FROM p1) AS peak_1, (SELECT b FROM p2) AS peak_2, (SELECT bin FROM sm, p1, p2 WHERE bin > least(a, b) AND bin < greatest(a, b) ORDER BY s, bin LIMIT 1) AS saddle)"""
# Confidence pulled towards a low and a high mode, integer valued.
SHAPED = """
shaped AS (SELECT disc.*, CASE WHEN confidence IS NULL THEN NULL WHEN disc THEN floor(confidence/4) + 10 ELSE least(floor(value/5) + 70, 100) END AS cv FROM disc)"""


def shaped(spark, sf):
    d = disc(spark, sf)
    cv = F.when(F.col("confidence").isNotNull(), F.when(F.col("disc"), F.floor(F.col("confidence") / 4) + 10.0)
                .otherwise(F.least(F.floor(F.col("value") / 5) + 70.0, F.lit(100.0))))
    return d.withColumn("cv", cv.cast("double"))


@query("a17_unit_bin_histogram", f"WITH {TEL}, {DISC}, {SHAPED}, {HIST} SELECT bin, c FROM hb")
def a17u(spark, sf):
    return value_histogram(shaped(spark, sf), "cv", 0, 100).select("bin", "c")


@query("a24_histogram_saddle", f"WITH {TEL}, {DISC}, {SHAPED}, {HIST} SELECT peak_1, peak_2, saddle FROM sad")
def a24(spark, sf):
    return histogram_saddle(value_histogram(shaped(spark, sf), "cv", 0, 100), 0, 100)


ROC = """
roc AS (SELECT t, count(*) FILTER (cv < t AND disc)/(count(*) FILTER (disc)) AS tpr, count(*) FILTER (cv < t AND NOT disc)/(count(*) FILTER (NOT disc)) AS fpr
  FROM (SELECT * FROM shaped WHERE cv IS NOT NULL), (SELECT unnest(range(0, 201))/2 AS t) GROUP BY 1),
yj AS (SELECT t, tpr, fpr, tpr - fpr AS j FROM roc), best AS (SELECT * FROM yj ORDER BY round(j, 9) DESC, t LIMIT 1)"""


def roc(spark, sf):
    return roc_sweep(shaped(spark, sf), "cv", "disc", [i / 2 for i in range(201)])


@query("a23_roc_sweep", f"WITH {TEL}, {DISC}, {SHAPED}, {ROC} SELECT t, round(tpr, 6) AS tpr, round(fpr, 6) AS fpr, round(j, 6) AS j FROM yj")
def a23(spark, sf):
    return roc(spark, sf).select("t", *[rnd(c).alias(c) for c in ("tpr", "fpr", "j")])


def best_j(r):
    return r.agg(F.max_by(F.struct("t", "tpr", "fpr", "j"), F.struct(F.round("j", 9), -F.col("t"))).alias("b")).select("b.*")


@query("a23_youden_threshold", f"""WITH {TEL}, {DISC}, {SHAPED}, {ROC} SELECT t AS threshold, round(j, 6) AS j, round(tpr, 6) AS sens, round(1 - fpr, 6) AS spec FROM best""")
def a23y(spark, sf):
    return best_j(roc(spark, sf)).select(F.col("t").alias("threshold"), rnd("j").alias("j"), rnd("tpr").alias("sens"),
                                         rnd(1 - F.col("fpr")).alias("spec"))


def mixture(spark, sf):
    return mixture_em(value_histogram(shaped(spark, sf), "cv", 0, 100).filter("c > 0"), "bin", "c")


EM = """
hv AS (SELECT CAST(bin AS DOUBLE) AS x, c FROM hb WHERE c > 0),
h0 AS (SELECT quantile_cont(cv, 0.25) AS q1, quantile_cont(cv, 0.75) AS q3, greatest(0.5*stddev_pop(cv), 1) AS s FROM shaped WHERE cv IS NOT NULL),
em AS (SELECT 0 AS i, q1 AS m0, q3 AS m1, s AS s0, s AS s1, CAST(0.5 AS DOUBLE) AS p0, CAST(0.5 AS DOUBLE) AS p1, CAST('-Infinity' AS DOUBLE) AS ll, CAST('-Infinity' AS DOUBLE) AS pl FROM h0
UNION ALL
SELECT i + 1, xa/na, xb/nb, greatest(sqrt(greatest(qa/na - (xa/na)*(xa/na), 0)), 0.5), greatest(sqrt(greatest(qb/nb - (xb/nb)*(xb/nb), 0)), 0.5), na/(na+nb), nb/(na+nb), l, ll FROM
 (SELECT i, ll, sum(c*a/t) AS na, sum(c*b/t) AS nb, sum(c*a/t*x) AS xa, sum(c*b/t*x) AS xb, sum(c*a/t*x*x) AS qa, sum(c*b/t*x*x) AS qb, sum(c*ln(t)) AS l FROM
  (SELECT *, greatest(a + b, 1e-300) AS t FROM (SELECT e.i, e.ll, x, c, p0*exp(-0.5*((x-m0)/s0)*((x-m0)/s0))/(sqrt(2*pi())*s0) AS a, p1*exp(-0.5*((x-m1)/s1)*((x-m1)/s1))/(sqrt(2*pi())*s1) AS b
    FROM em e, hv WHERE e.i < 200 AND (e.i < 2 OR abs(e.ll - e.pl) >= 1e-6))) GROUP BY i, ll))"""


@query("a25_two_component_mixture", f"""
WITH RECURSIVE {TEL}, {DISC}, {SHAPED}, {HIST.split("sm AS")[0].rstrip().rstrip(",")}, {EM}, f AS (SELECT * FROM em ORDER BY i DESC LIMIT 1),
o AS (SELECT least(m0, m1) AS lo, greatest(m0, m1) AS hi, CASE WHEN m0 <= m1 THEN s0 ELSE s1 END AS slo, CASE WHEN m0 <= m1 THEN s1 ELSE s0 END AS shi, CASE WHEN m0 <= m1 THEN p0 ELSE p1 END AS plo, CASE WHEN m0 <= m1 THEN p1 ELSE p0 END AS phi FROM f),
gr AS (SELECT i*0.01 AS x, i FROM (SELECT unnest(range(0, 10001)) AS i)),
gp AS (SELECT x, i, abs(a/greatest(a+b, 1e-300) - 0.5) AS gap FROM (SELECT x, i, plo*exp(-0.5*((x-lo)/slo)*((x-lo)/slo))/slo AS a, phi*exp(-0.5*((x-hi)/shi)*((x-hi)/shi))/shi AS b FROM gr, o))
SELECT (SELECT round(x, 3)::DOUBLE FROM gp ORDER BY gap, i LIMIT 1) AS threshold, round(lo, 4) AS mu0, round(hi, 4) AS mu1, round(slo, 4) AS sd0, round(shi, 4) AS sd1, round(plo, 5) AS pi0, round(phi, 5) AS pi1,
  round(least(slo, shi)/greatest(hi - lo, 1e-9), 5) AS overlap_ratio FROM o""")
def a25(spark, sf):
    f = mixture_crossover(mixture(spark, sf))
    overlap = F.least("sd0", "sd1") / F.greatest(F.col("mu1") - F.col("mu0"), F.lit(1e-9))
    return f.select(rnd("threshold", 3).alias("threshold"), *[rnd(k, 5 if k.startswith("pi") else 4).alias(k) for k in ("mu0", "mu1", "sd0", "sd1", "pi0", "pi1")],
                    rnd(overlap, 5).alias("overlap_ratio"))


@query("a26_threshold_decision", f"""
WITH {TEL}, {DISC}, {SHAPED}, {HIST}, {ROC} SELECT CAST(saddle AS DOUBLE) AS saddle, t AS roc,
 CASE WHEN round(j, 9) < 0.1 THEN 'saddle' WHEN saddle IS NULL THEN 'roc' WHEN abs(saddle - t) <= 5 THEN 'average' ELSE 'roc' END AS rule,
 round(CASE WHEN round(j, 9) < 0.1 THEN saddle WHEN saddle IS NULL THEN t WHEN abs(saddle - t) <= 5 THEN (saddle + t)/2 ELSE t END, 4) AS threshold FROM sad, best""")
def a26(spark, sf):
    s = histogram_saddle(value_histogram(shaped(spark, sf), "cv", 0, 100), 0, 100).select(F.col("saddle").cast("double").alias("saddle"))
    b = best_j(roc(spark, sf))
    d = b.withColumn("saddle", s.scalar())
    value, rule = choose_threshold(F.col("saddle"), F.lit(None).cast("double"), F.col("t"), F.round("j", 9), 0.10, 5.0)
    return d.select("saddle", F.col("t").alias("roc"), rule.alias("rule"), rnd(value, 4).alias("threshold"))
