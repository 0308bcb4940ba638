"""Uniform grids, cross-correlation, lag estimates and their pooling."""

from __future__ import annotations

from pyspark.sql import functions as F

from scanweave.functions.exprs import joined_flags, rnd
from scanweave.functions.tails import chi2_upper, t_two_sided
from scanweave.operators.quantiles import exact_quantiles
from scanweave.operators.signal import (block_bootstrap, ci_overlap, cross_correlation, fill_linear, grid_bounds,
                                        peak, pooled, resample_linear, signal_pair, weighted_slope, zscore)
from scanweave.operators.timeline import ordered_pairs, row_position
from scanweave.plans.registry import query
from scanweave.session import stored
from scanweave.plans.views import telemetry, TEL

STEP, GAP, DAY = 3600, 3 * 3600, 86400

GRID = TEL + """,
va AS (SELECT session_id, us, avg(value) AS y FROM tel WHERE event_type = 'view' GROUP BY ALL),
vb AS (SELECT session_id, us, avg(value) AS y FROM tel WHERE event_type = 'purchase' GROUP BY ALL),
ea AS (SELECT session_id, min(us) AS a0, max(us) AS a1 FROM va GROUP BY 1),
eb AS (SELECT session_id, min(us) AS b0, max(us) AS b1 FROM vb GROUP BY 1),
bounds AS (SELECT session_id, greatest(a0, b0) AS lo, (least(a1, b1) - greatest(a0, b0)) // 3600000000 AS n_grid FROM ea JOIN eb USING (session_id)),
gk AS (SELECT session_id, lo, unnest(range(0, n_grid)) AS k FROM bounds),
g AS (SELECT session_id, k, lo + k*3600000000 AS t FROM gk),
sa AS (SELECT *, lead(us) OVER w AS nus, lead(y) OVER w AS ny FROM va WINDOW w AS (PARTITION BY session_id ORDER BY us)),
sb AS (SELECT *, lead(us) OVER w AS nus, lead(y) OVER w AS ny FROM vb WINDOW w AS (PARTITION BY session_id ORDER BY us)),
ra AS (SELECT g.session_id, g.k, g.t, coalesce(y + (ny - y)*((t - us)/(nus - us)), y) AS y, coalesce(nus - us > 10800000000, false) AS in_gap
  FROM g ASOF JOIN sa ON g.session_id = sa.session_id AND g.t >= sa.us),
rb AS (SELECT g.session_id, g.k, g.t, coalesce(y + (ny - y)*((t - us)/(nus - us)), y) AS y
  FROM g ASOF JOIN sb ON g.session_id = sb.session_id AND g.t >= sb.us),
zz AS (SELECT ra.session_id, ra.k, ra.in_gap AS masked, ra.y AS ya, rb.y AS yb,
  (ra.y - avg(ra.y) OVER p)/stddev_pop(ra.y) OVER p AS za, (rb.y - avg(rb.y) OVER p)/stddev_pop(rb.y) OVER p AS zb
  FROM ra JOIN rb USING (session_id, k) WINDOW p AS (PARTITION BY ra.session_id)),
sig AS (SELECT session_id, k, masked, CASE WHEN masked THEN 0 ELSE za END AS z_a, CASE WHEN masked THEN 0 ELSE zb END AS z_b FROM zz)"""


def rho_sql(src, keys, lag=24, prefix=""):
    """Cross-correlation CTEs over ``src`` with columns keys, k, z_a, z_b."""
    on = " AND ".join(f"a.{k} = b.{k}" for k in keys.split(", "))
    bk = ", ".join(f"b.{k}" for k in keys.split(", "))
    return f"""
{prefix}st AS (SELECT {keys}, count(*) AS n, stddev_pop(z_a) * stddev_pop(z_b) AS sd FROM {src} GROUP BY {keys}),
{prefix}prod AS (SELECT {bk}, l.lag, sum(a.z_a * b.z_b) AS s FROM {src} b CROSS JOIN (SELECT unnest(range(-{lag}, {lag + 1})) AS lag) l
  JOIN {src} a ON {on} AND a.k = b.k + l.lag GROUP BY ALL),
{prefix}rho AS (SELECT {keys}, lag, s / n / CASE WHEN sd = 0 THEN 1 ELSE sd END AS rho FROM {prefix}prod JOIN {prefix}st USING ({keys}))"""


def peak_sql(keys, exclude=4, prefix=""):
    return f"""
{prefix}nb AS (SELECT *, lag(rho) OVER w AS l, lead(rho) OVER w AS r, arg_max(lag, (rho, -lag)) OVER (PARTITION BY {keys}) AS kk
  FROM {prefix}rho WINDOW w AS (PARTITION BY {keys} ORDER BY lag)),
{prefix}pk AS (SELECT {keys}, max(kk) AS lag, max(rho) FILTER (lag = kk) AS rho, max(l) FILTER (lag = kk) AS l, max(r) FILTER (lag = kk) AS r,
  max(rho) FILTER (abs(lag - kk) > {exclude} AND rho >= l AND rho >= r) AS o FROM {prefix}nb GROUP BY {keys}),
{prefix}pd AS (SELECT *, CASE WHEN l IS NOT NULL AND r IS NOT NULL AND l - 2*rho + r <> 0
  THEN least(greatest(0.5*(l - r)/(l - 2*rho + r), -1), 1) ELSE 0 END AS d FROM {prefix}pk),
{prefix}peaks AS (SELECT {keys}, lag, rho, lag + d AS tau, CASE WHEN l IS NOT NULL AND r IS NOT NULL THEN rho - 0.25*(l - r)*d ELSE rho END AS rho_peak,
  CASE WHEN rho <= 0 THEN 0 WHEN o IS NULL THEN 1 ELSE (rho - greatest(o, 0))/rho END AS prominence FROM {prefix}pd)"""


PEAK_OUT = """round(rho, 6) AS rho, round(tau, 6) AS tau, round(rho_peak, 6) AS rho_peak, round(prominence, 6) AS prominence"""


def streams(spark, sf):
    t = telemetry(spark, sf)
    pick = lambda kind: t.filter(F.col("event_type") == kind).select("session_id", "us", "value")
    return pick("view"), pick("purchase")


def pair(spark, sf):
    a, b = streams(spark, sf)
    return stored(signal_pair(a, b, ["session_id"], "us", "value", STEP, GAP, DAY))


def peak_cols():
    return [rnd(c).alias(c) for c in ("rho", "tau", "rho_peak", "prominence")]


@query("w12_linear_resample", f"WITH {GRID} SELECT session_id, k, t AS t_us, round(y, 6) AS y FROM ra")
def w12(spark, sf):
    a, b = streams(spark, sf)
    bounds = grid_bounds(a, b, ["session_id"], "us", STEP)
    return (resample_linear(a, ["session_id"], "us", "value", bounds, STEP, GAP, DAY)
            .select("session_id", "k", "t_us", rnd("y").alias("y")))


@query("w13_interior_fill", f"""
WITH {GRID}, h AS (SELECT session_id, k, CASE WHEN k % 11 < 4 OR k > 700 THEN NULL ELSE y END AS y FROM ra),
ok AS (SELECT * FROM h WHERE y IS NOT NULL),
p AS (SELECT h.session_id, h.k, h.y, b.k AS k0, b.y AS y0 FROM h ASOF LEFT JOIN ok b ON h.session_id = b.session_id AND h.k >= b.k),
q AS (SELECT p.*, c.k AS k1, c.y AS y1 FROM p ASOF LEFT JOIN ok c ON p.session_id = c.session_id AND p.k <= c.k)
SELECT session_id, k, round(coalesce(y, y0 + (y1 - y0)*(k - k0)/nullif(k1 - k0, 0), y0, y1), 6) AS filled FROM q""")
def w13(spark, sf):
    a, b = streams(spark, sf)
    bounds = grid_bounds(a, b, ["session_id"], "us", STEP)
    g = resample_linear(a, ["session_id"], "us", "value", bounds, STEP, GAP, DAY)
    g = g.select("session_id", "k", F.when((F.col("k") % 11 >= 4) & (F.col("k") <= 700), F.col("y")).alias("y"))
    return fill_linear(g, ["session_id"], "k", "y", 256, "filled").select("session_id", "k", rnd("filled").alias("filled"))


@query("w14_gap_mask_on_grid", f"""
WITH {GRID} SELECT session_id, k, masked, round(z_a, 6) AS z_a, round(z_b, 6) AS z_b FROM sig""")
def w14(spark, sf):
    return pair(spark, sf).select("session_id", "k", "masked", rnd("z_a").alias("z_a"), rnd("z_b").alias("z_b"))


@query("w15_zscore", f"""
WITH {TEL} SELECT joint_idx, round((value - avg(value) OVER w)/stddev_pop(value) OVER w, 6) AS z_value,
 CAST(0 AS DOUBLE) AS z_const FROM tel WINDOW w AS (PARTITION BY session_id)""")
def w15(spark, sf):
    t = telemetry(spark, sf).select("joint_idx", "session_id", F.col("value").alias("z_value"), F.lit(3.0).alias("z_const"))
    return zscore(t, ["session_id"], ["z_value", "z_const"]).select("joint_idx", rnd("z_value").alias("z_value"), "z_const")


@query("j14_lagged_cross_correlation", f"""
WITH {GRID}, {rho_sql("sig", "session_id")} SELECT session_id, lag, round(rho, 6) AS rho FROM rho""")
def j14(spark, sf):
    return (cross_correlation(pair(spark, sf), ["session_id"], 24, 256)
            .select("session_id", "lag", rnd("rho").alias("rho")))


@query("w19_w20_peak_and_prominence", f"""
WITH {GRID}, {rho_sql("sig", "session_id")}, {peak_sql("session_id")}
SELECT session_id, lag, {PEAK_OUT} FROM peaks""")
def w19(spark, sf):
    p = peak(cross_correlation(pair(spark, sf), ["session_id"], 24, 256), ["session_id"], 4)
    return p.select("session_id", "lag", *peak_cols())


@query("w21_widen_search", f"""
WITH {GRID}, {rho_sql("sig", "session_id", 12, "n")}, {peak_sql("session_id", 4, "n")},
{rho_sql("sig", "session_id", 20, "x")}, {peak_sql("session_id", 4, "x")}
SELECT session_id, abs(n.tau) > 0.9*12 AS widened, CASE WHEN abs(n.tau) > 0.9*12 THEN x.lag ELSE n.lag END AS lag,
  round(CASE WHEN abs(n.tau) > 0.9*12 THEN x.tau ELSE n.tau END, 6) AS tau FROM npeaks n JOIN xpeaks x USING (session_id)""")
def w21(spark, sf):
    rho = cross_correlation(pair(spark, sf), ["session_id"], 20, 256)
    n = peak(rho.filter("abs(lag) <= 12"), ["session_id"], 4)
    x = peak(rho, ["session_id"], 4)
    far = F.abs("n.tau") > 0.9 * 12
    return n.alias("n").join(x.alias("x"), "session_id").select(
        "session_id", far.alias("widened"), F.when(far, F.col("x.lag")).otherwise(F.col("n.lag")).alias("lag"),
        rnd(F.when(far, F.col("x.tau")).otherwise(F.col("n.tau"))).alias("tau"))


DRIFT = GRID + """,
win0 AS (SELECT *, k // 120 AS win FROM sig),
wok AS (SELECT session_id, win FROM win0 GROUP BY 1, 2 HAVING count(*) = 120 AND avg(CASE WHEN masked THEN 1 ELSE 0 END) <= 0.25
  AND stddev_pop(z_a) >= 0.001 AND stddev_pop(z_b) >= 0.001),
wsig AS (SELECT session_id, win, k, (z_a - avg(z_a) OVER p)/stddev_pop(z_a) OVER p AS z_a, (z_b - avg(z_b) OVER p)/stddev_pop(z_b) OVER p AS z_b
  FROM win0 JOIN wok USING (session_id, win) WINDOW p AS (PARTITION BY session_id, win))""" + "," + rho_sql(
    "wsig", "session_id, win") + "," + peak_sql("session_id, win") + """,
drift AS (SELECT *, (win*120 + 59.5)/24.0 AS center FROM peaks WHERE rho_peak >= 0.1)"""


def drift(spark, sf):
    """Lag estimate per tumbling window of 120 grid points."""
    keys = ["session_id", "win"]
    d = pair(spark, sf).withColumn("win", F.floor(F.col("k") / 120))
    ok = (d.groupBy(*keys).agg(F.count("*").alias("c"), F.avg(F.col("masked").cast("double")).alias("m"),
                               F.stddev_pop("z_a").alias("sa"), F.stddev_pop("z_b").alias("sb"))
          .filter("c = 120 AND m <= 0.25 AND sa >= 0.001 AND sb >= 0.001").select(*keys))
    d = zscore(d.join(ok, keys, "left_semi"), keys, ["z_a", "z_b"])
    p = peak(cross_correlation(d, keys, 24, 256), keys, 4).filter("rho_peak >= 0.1")
    return stored(p.withColumn("center", (F.col("win") * 120 + 59.5) / 24.0))


@query("w17_tumbling_window_lags", f"""
WITH {DRIFT} SELECT session_id, win, round(center, 6) AS center, lag, {PEAK_OUT} FROM drift""")
def w17(spark, sf):
    return drift(spark, sf).select("session_id", "win", rnd("center").alias("center"), "lag", *peak_cols())


@query("a29_weighted_slope", f"""
WITH {DRIFT}, c AS (SELECT session_id, sum(w*x)/sum(w) AS xm, sum(w*y)/sum(w) AS ym FROM
  (SELECT session_id, center AS x, tau AS y, rho_peak*rho_peak AS w FROM drift) GROUP BY 1),
m AS (SELECT session_id, count(*) AS n, max(xm) AS xm, max(ym) AS ym, sum(w*(x-xm)*(x-xm)) AS sxx, sum(w*(x-xm)*(y-ym)) AS sxy, sum(w*(y-ym)*(y-ym)) AS syy
  FROM (SELECT session_id, center AS x, tau AS y, rho_peak*rho_peak AS w FROM drift) JOIN c USING (session_id) GROUP BY 1)
SELECT session_id, n, round(sxy/sxx, 6) AS slope, round(ym - sxy/sxx*xm, 6) AS intercept,
  CASE WHEN n >= 3 THEN round(sqrt(greatest(syy - sxy/sxx*sxy, 0)/(n-2)/sxx), 6) END AS slope_se FROM m WHERE n >= 2""")
def a29(spark, sf):
    d = drift(spark, sf).withColumn("w", F.col("rho_peak") * F.col("rho_peak"))
    return (weighted_slope(d, ["session_id"], "center", "tau", "w").filter("n >= 2")
            .select("session_id", "n", *[rnd(c).alias(c) for c in ("slope", "intercept", "slope_se")]))


def simpson_sql(f: str, a: str, b: str) -> str:
    """Simpson's rule in 2000 steps over f(x) from a to b."""
    at = f"({a} + ({b} - {a})*i/2000)"
    return (f"(({b} - {a})/6000*list_sum(list_transform(range(0, 2001), lambda i: "
            f"(CASE WHEN i IN (0, 2000) THEN 1 WHEN i % 2 = 1 THEN 4 ELSE 2 END)*{f.replace('$x', at)})))")


COS = "(CASE WHEN df = 1 THEN 1.0 WHEN cos($x) < 1e-15 THEN 0.0 ELSE exp((df - 1)*ln(cos($x))) END)"
CHI = "(CASE WHEN df = 1 THEN exp(-$x*$x/2) WHEN $x <= 0 THEN 0.0 ELSE exp((df - 1)*(ln($x) - ln(m)) - ($x*$x - m*m)/2) END)"
T_TAIL = f"""
tp AS (SELECT {{k}}, round({simpson_sql(COS, "a0", "greatest(a0, top)")}/{simpson_sql(COS, "0", "top")}, 6) AS p
  FROM (SELECT *, atan(abs(t)/sqrt(df)) AS a0, CASE WHEN df < 100 THEN pi()/2 ELSE atan(40/sqrt(df)) END AS top FROM {{src}}))"""
SLOPE = """
dw AS (SELECT session_id, center AS x, tau AS y, rho_peak*rho_peak AS w FROM drift), dc AS (SELECT session_id, sum(w*x)/sum(w) AS xm, sum(w*y)/sum(w) AS ym FROM dw GROUP BY 1),
dm AS (SELECT session_id, count(*) AS n, sum(w*(x-xm)*(x-xm)) AS sxx, sum(w*(x-xm)*(y-ym)) AS sxy, sum(w*(y-ym)*(y-ym)) AS syy FROM dw JOIN dc USING (session_id) GROUP BY 1),
ds AS (SELECT session_id, n, sxy/sxx AS slope, sqrt(greatest(syy - sxy/sxx*sxy, 0)/(n-2)/sxx) AS se FROM dm WHERE n >= 3),
dt AS (SELECT *, slope/greatest(se, 1e-12) AS t, n - 2.0 AS df FROM ds)"""


@query("a29_slope_p_value", f"""
WITH {DRIFT}, {SLOPE}, {T_TAIL.format(k="session_id", src="dt")} SELECT session_id, n, round(slope, 6) AS slope, round(se, 6) AS slope_se, p FROM dt JOIN tp USING (session_id)""")
def a29p(spark, sf):
    d = drift(spark, sf).withColumn("w", F.col("rho_peak") * F.col("rho_peak"))
    s = weighted_slope(d, ["session_id"], "center", "tau", "w").filter("slope_se IS NOT NULL")
    t = F.abs("slope") / F.greatest("slope_se", F.lit(1e-12))
    return s.withColumn("p", t_two_sided(t, F.col("n") - 2)).select(
        "session_id", "n", rnd("slope").alias("slope"), rnd("slope_se").alias("slope_se"), rnd("p").alias("p"))


def halves(spark, sf):
    p = row_position(pair(spark, sf), ["session_id"], ["k"], F.floor(F.col("k") / 4096))
    d = p.withColumn("half", F.when(F.col("rn") <= F.floor(F.col("n") / 2), 1).otherwise(2))
    d = d.withColumn("k", F.when(F.col("half") == 2, F.col("rn") - F.floor(F.col("n") / 2)).otherwise(F.col("rn")))
    return peak(cross_correlation(d, ["session_id", "half"], 24, 256), ["session_id", "half"], 4)


@query("w18_half_split_agreement", f"""
WITH {GRID}, hp AS (SELECT *, row_number() OVER (PARTITION BY session_id ORDER BY k) AS rn, count(*) OVER (PARTITION BY session_id) AS n FROM sig),
hs AS (SELECT session_id, CASE WHEN rn <= n // 2 THEN 1 ELSE 2 END AS half, rn AS k, z_a, z_b FROM hp), {rho_sql("hs", "session_id, half")},
{peak_sql("session_id, half")}, w AS (SELECT session_id, max(tau) FILTER (half = 1) AS t1, max(tau) FILTER (half = 2) AS t2,
  max(0.5/greatest(rho_peak, 0.05)) FILTER (half = 1) AS s1, max(0.5/greatest(rho_peak, 0.05)) FILTER (half = 2) AS s2 FROM peaks GROUP BY 1)
SELECT session_id, round(t1, 6) AS tau_first, round(t2, 6) AS tau_second, round(t1 - t2, 6) AS diff,
  NOT (t1 + 1.96*s1 < t2 - 1.96*s2 OR t2 + 1.96*s2 < t1 - 1.96*s1) AS agree FROM w""")
def w18(spark, sf):
    h = halves(spark, sf).withColumn("s", 0.5 / F.greatest("rho_peak", F.lit(0.05)))
    of = lambda c, i: F.max(F.when(F.col("half") == i, F.col(c)))
    w = h.groupBy("session_id").agg(of("tau", 1).alias("t1"), of("tau", 2).alias("t2"), of("s", 1).alias("s1"), of("s", 2).alias("s2"))
    return w.select("session_id", rnd("t1").alias("tau_first"), rnd("t2").alias("tau_second"),
                    rnd(F.col("t1") - F.col("t2")).alias("diff"), ci_overlap("t1", "s1", "t2", "s2").alias("agree"))


# Lag sums of each replicate as inner products of its shifted lists.
BOOT = GRID + """,
bn AS (SELECT session_id, max(k) + 1 AS n FROM sig GROUP BY 1 HAVING max(k) + 1 > 48),
br AS (SELECT session_id, n, unnest(range(1, 501)) AS rep FROM bn),
bi AS (SELECT *, unnest(range(0, CAST(ceil(n/48) AS BIGINT))) AS i FROM br),
bs AS (SELECT *, CAST(floor(CAST(('0x' || substr(md5(concat_ws('|', 'blocks', session_id, rep, i)), 1, 8)) AS UBIGINT)/4294967296.0*(n - 48 + 1)) AS BIGINT) AS s FROM bi),
bp AS (SELECT session_id, rep, s + j AS sk, i*48 + j AS k FROM (SELECT *, unnest(range(0, 48)) AS j FROM bs) WHERE i*48 + j < n),
bd AS (SELECT bp.session_id, rep, bp.k, sig.z_a, sig.z_b FROM bp JOIN sig ON sig.session_id = bp.session_id AND sig.k = bp.sk),
bl AS (SELECT session_id, rep, count(*) AS n, avg(z_a) AS ma, avg(z_b) AS mb, stddev_pop(z_a) AS sa, stddev_pop(z_b) AS sb, list(z_a ORDER BY k) AS a, list(z_b ORDER BY k) AS b
  FROM bd GROUP BY 1, 2),
bz AS (SELECT session_id, rep, n, sa*sb AS sd, list_transform(a, lambda x: x - ma) AS a, list_transform(b, lambda x: x - mb) AS b FROM bl),
rho AS (SELECT session_id, rep, lag, CASE WHEN sd > 1e-9 THEN round(CASE WHEN lag >= 0 THEN list_inner_product(a[1 + lag:], b[:n - lag]) ELSE list_inner_product(a[:n + lag], b[1 - lag:]) END/n/sd, 9) ELSE 0 END AS rho
  FROM bz, (SELECT unnest(range(-24, 25)) AS lag) l),""" + peak_sql("session_id, rep")


@query("a32_moving_block_bootstrap", f"""
WITH {BOOT}, {rho_sql("sig", "session_id", 24, "z")}, {peak_sql("session_id", 4, "z")}, tau AS (SELECT b.session_id, b.tau, z.tau AS t0 FROM peaks b JOIN zpeaks z USING (session_id))
SELECT session_id, count(*) AS n_reps, round(max(t0), 6) AS tau_point, round(stddev_samp(tau), 6) AS sigma, round(quantile_cont(tau, 0.025), 6) AS ci_lo,
  round(quantile_cont(tau, 0.975), 6) AS ci_hi, round(sqrt(avg((tau - t0)*(tau - t0))), 6) AS rmse_about_point,
  round(avg(CASE WHEN abs(tau - t0) <= 2 THEN 1.0 ELSE 0.0 END), 6) AS modal_fraction, round(stddev_samp(tau) FILTER (abs(tau - t0) <= 2), 6) AS modal_sigma,
  round(quantile_cont(tau, 0.025) FILTER (abs(tau - t0) <= 2), 6) AS modal_lo, round(quantile_cont(tau, 0.975) FILTER (abs(tau - t0) <= 2), 6) AS modal_hi
FROM tau GROUP BY 1""")
def a32(spark, sf):
    d = pair(spark, sf)
    point = peak(cross_correlation(d, ["session_id"], 24, 256), ["session_id"], 4).select("session_id", F.col("tau").alias("t0"))
    b = block_bootstrap(d, ["session_id"], 500, 48, 24, 4, "blocks").select("session_id", "rep", "tau").join(point, "session_id")
    dev = F.col("tau") - F.col("t0")
    b = stored(b.withColumn("dev", dev).withColumn("near", F.when(F.abs(dev) <= 2, F.col("tau"))))
    q = exact_quantiles(b, ["session_id"], "tau", {"ci_lo": 0.025, "ci_hi": 0.975})
    m = exact_quantiles(b, ["session_id"], "near", {"modal_lo": 0.025, "modal_hi": 0.975})
    s = b.groupBy("session_id").agg(
        F.count("*").alias("n_reps"), rnd(F.max("t0")).alias("tau_point"), rnd(F.stddev_samp("tau")).alias("sigma"),
        rnd(F.sqrt(F.avg(F.col("dev") * F.col("dev")))).alias("rmse_about_point"),
        rnd(F.count("near") / F.count("*")).alias("modal_fraction"), rnd(F.stddev_samp("near")).alias("modal_sigma"))
    both = s.join(q, "session_id").join(m, "session_id", "left")
    return both.select("session_id", "n_reps", "tau_point", "sigma", rnd("ci_lo").alias("ci_lo"), rnd("ci_hi").alias("ci_hi"), "rmse_about_point",
                       "modal_fraction", "modal_sigma", rnd("modal_lo").alias("modal_lo"), rnd("modal_hi").alias("modal_hi"))


RUNS = TEL + """,
rv AS (SELECT session_id, run_id, avg(value) AS tau, stddev_samp(value)/sqrt(count(*)) AS sigma, min(us)/86400e6 AS day FROM tel GROUP BY 1, 2)"""


def run_means(spark, sf):
    return telemetry(spark, sf).groupBy("session_id", "run_id").agg(
        F.avg("value").alias("tau"), (F.stddev_samp("value") / F.sqrt(F.count("*"))).alias("sigma"),
        (F.min("us") / 86400e6).alias("day"))


@query("a27_inverse_variance_pooling", f"""
WITH {RUNS}, ok AS (SELECT *, 1/(sigma*sigma) AS w FROM rv WHERE sigma > 0),
m AS (SELECT session_id, count(*) AS n, sum(w) AS sw, sum(w*tau)/sum(w) AS tb FROM ok GROUP BY 1),
q AS (SELECT session_id, sum(w*(tau - tb)*(tau - tb)) AS q FROM ok JOIN m USING (session_id) GROUP BY 1)
SELECT session_id, n, round(tb, 6) AS tau_bar, round(1/sqrt(sw), 6) AS se, round(tb - 1.96/sqrt(sw), 6) AS ci_lo, round(tb + 1.96/sqrt(sw), 6) AS ci_hi,
  round(q, 6) AS q, n - 1 AS df, round(greatest((q - n + 1)/q, 0)*100, 6) AS i2 FROM m JOIN q USING (session_id)""")
def a27(spark, sf):
    p = pooled(run_means(spark, sf), ["session_id"], "tau", "sigma")
    return p.select("session_id", "n", "df", *[rnd(c).alias(c) for c in ("tau_bar", "se", "ci_lo", "ci_hi", "q", "i2")])


@query("a27_homogeneity_p_value", f"""
WITH {RUNS}, ok AS (SELECT *, 1/(sigma*sigma) AS w FROM rv WHERE sigma > 0), m AS (SELECT session_id, count(*) AS n, sum(w*tau)/sum(w) AS tb FROM ok GROUP BY 1),
q AS (SELECT session_id, any_value(n) - 1.0 AS df, sum(w*(tau - tb)*(tau - tb)) AS q FROM ok JOIN m USING (session_id) GROUP BY 1),
pv AS (SELECT session_id, {simpson_sql(CHI, "greatest(sqrt(q), greatest(m - 10, 0))", "(greatest(sqrt(q), m) + 10)")}/{simpson_sql(CHI, "greatest(m - 10, 0)", "(m + 10)")} AS p
  FROM (SELECT *, sqrt(df - 1) AS m FROM q))
SELECT session_id, round(q, 6) AS q, CAST(df AS BIGINT) AS df, round(greatest((q - df)/q, 0)*100, 6) AS i2, round(p, 6) AS p, greatest((q - df)/q, 0)*100 < 25 AND p > 0.05 AS homogeneous FROM q JOIN pv USING (session_id)""")
def a27p(spark, sf):
    p = pooled(run_means(spark, sf), ["session_id"], "tau", "sigma")
    p = p.withColumn("p", chi2_upper("q", "df"))
    return p.select("session_id", rnd("q").alias("q"), "df", rnd("i2").alias("i2"), rnd("p").alias("p"),
                    ((F.col("i2") < 25.0) & (F.col("p") > 0.05)).alias("homogeneous"))


SESS = TEL + """,
sv AS (SELECT session_id, avg(value) AS tau, stddev_samp(value)/sqrt(count(*)) AS sigma, min(us) AS start_us, count(*) AS n FROM tel GROUP BY 1)"""


def session_means(spark, sf):
    return telemetry(spark, sf).groupBy("session_id").agg(
        F.avg("value").alias("tau"), (F.stddev_samp("value") / F.sqrt(F.count("*"))).alias("sigma"),
        F.min("us").alias("start_us"), F.count("*").alias("n"))


@query("a28_j17_ci_overlap_session_pairs", f"""
WITH {SESS} SELECT a.session_id AS a, b.session_id AS b, round(b.tau - a.tau, 6) AS delta,
  NOT (a.tau + 1.96*a.sigma < b.tau - 1.96*b.sigma OR b.tau + 1.96*b.sigma < a.tau - 1.96*a.sigma) AS overlap
FROM sv a JOIN sv b ON a.session_id < b.session_id""")
def a28(spark, sf):
    p = ordered_pairs(session_means(spark, sf).select("session_id", "tau", "sigma"), "session_id")
    return p.select(F.col("session_id_a").alias("a"), F.col("session_id_b").alias("b"), rnd(F.col("tau_b") - F.col("tau_a")).alias("delta"),
                    ci_overlap("tau_a", "sigma_a", "tau_b", "sigma_b").alias("overlap"))


@query("w31_consecutive_day_deltas", f"""
WITH {TEL}, d AS (SELECT us // 86400000000 AS day, avg(value) AS tau FROM tel GROUP BY 1),
s AS (SELECT regr_slope(tau, day) AS b FROM d),
n AS (SELECT day, tau, lead(day) OVER (ORDER BY day) AS nday, lead(tau) OVER (ORDER BY day) AS ntau FROM d)
SELECT day, nday AS next_day, round(ntau - tau, 6) AS delta, round(b*(nday - day), 6) AS predicted,
  sign(ntau - tau) = sign(b*(nday - day)) AS same_sign FROM n CROSS JOIN s WHERE nday IS NOT NULL""")
def w31(spark, sf):
    from pyspark.sql import Window
    t = telemetry(spark, sf).groupBy(F.floor(F.col("us") / 86400000000).alias("day")).agg(F.avg("value").alias("tau"))
    b = t.select(F.regr_slope("tau", "day")).scalar()
    # one row per day: a few thousand at most
    w = Window.orderBy("day")
    n = t.withColumn("nd", F.lead("day").over(w)).withColumn("nt", F.lead("tau").over(w)).filter("nd IS NOT NULL").withColumn("b", b)
    delta, pred = F.col("nt") - F.col("tau"), F.col("b") * (F.col("nd") - F.col("day"))
    return n.select("day", F.col("nd").alias("next_day"), rnd(delta).alias("delta"), rnd(pred).alias("predicted"),
                    (F.signum(delta) == F.signum(pred)).alias("same_sign"))


@query("w32_estimates_at_finer_grain", f"""
WITH {DRIFT}, e AS (SELECT session_id, win, tau, 0.5/rho_peak AS sigma FROM drift),
ok AS (SELECT *, 1/(sigma*sigma) AS w FROM e), m AS (SELECT session_id, count(*) AS n, sum(w*tau)/sum(w) AS tb FROM ok GROUP BY 1),
q AS (SELECT session_id, sum(w*(tau - tb)*(tau - tb)) AS q FROM ok JOIN m USING (session_id) GROUP BY 1)
SELECT session_id, n, round(tb, 6) AS tau_bar, round(q, 6) AS q, round(CASE WHEN q > 0 THEN greatest((q - n + 1)/q, 0)*100 ELSE 0 END, 6) AS i2,
  CASE WHEN (CASE WHEN q > 0 THEN greatest((q - n + 1)/q, 0)*100 ELSE 0 END) < 25 THEN 'homogeneous' ELSE 'heterogeneous' END AS verdict
FROM m JOIN q USING (session_id) WHERE n >= 2""")
def w32(spark, sf):
    d = drift(spark, sf).withColumn("sigma", 0.5 / F.col("rho_peak"))
    p = pooled(d, ["session_id"], "tau", "sigma")
    return p.select("session_id", "n", rnd("tau_bar").alias("tau_bar"), rnd("q").alias("q"), rnd("i2").alias("i2"),
                    F.when(F.col("i2") < 25, "homogeneous").otherwise("heterogeneous").alias("verdict"))


@query("f15_quality_flags", f"""
WITH {RUNS}, s AS (SELECT r.*, count(*) AS n, 86400e6*count(*)/(max(us) - min(us)) AS per_day, avg(speed) FILTER (joint_idx % 2 = 0) - avg(speed) FILTER (joint_idx % 2 = 1) AS hd
  FROM rv r JOIN tel t USING (session_id, run_id) GROUP BY ALL)
SELECT run_id, concat_ws('|', CASE WHEN per_day < 2.2 THEN 'low_rate' END, CASE WHEN round(sigma, 9) > 2.8 THEN 'unstable' END,
  CASE WHEN round(abs(hd), 9) > 0.1 THEN 'halves_disagree' END) AS flags FROM s""")
def f15(spark, sf):
    """Sums of doubles hang on the order of rows: compared to nine digits, a value on a threshold is not above it."""
    t = telemetry(spark, sf)
    even = F.col("joint_idx") % 2 == 0
    s = t.groupBy("run_id").agg(
        (86400e6 * F.count("*") / (F.max("us") - F.min("us"))).alias("per_day"),
        (F.stddev_samp("value") / F.sqrt(F.count("*"))).alias("sigma"),
        (F.avg(F.when(even, F.col("speed"))) - F.avg(F.when(~even, F.col("speed")))).alias("hd"))
    return s.select("run_id", joined_flags([(F.col("per_day") < 2.2, "low_rate"), (rnd("sigma", 9) > 2.8, "unstable"),
                                            (rnd(F.abs("hd"), 9) > 0.1, "halves_disagree")]).alias("flags"))


@query("j18_attach_retention", f"""
WITH {SESS}, r AS (SELECT session_id, avg(CASE WHEN confidence >= 35 THEN 1.0 ELSE 0.0 END) AS retention, max(joint_idx % 7) * 10.0 AS tol FROM tel
  WHERE session_id <> 's2' GROUP BY 1)
SELECT s.session_id, round(tau, 6) AS tau, round(retention, 4) AS retention, round(tol, 2) AS tolerance_ms FROM sv s LEFT JOIN r USING (session_id)""")
def j18(spark, sf):
    r = (telemetry(spark, sf).filter("session_id <> 's2'").groupBy("session_id")
         .agg(F.avg(F.coalesce((F.col("confidence") >= 35).cast("double"), F.lit(0.0))).alias("retention"),
              (F.max(F.col("joint_idx") % 7) * 10.0).alias("tol")))
    return session_means(spark, sf).join(r, "session_id", "left").select(
        "session_id", rnd("tau").alias("tau"), rnd("retention", 4).alias("retention"), rnd("tol", 2).alias("tolerance_ms"))
