"""Fits, ablations, attributions and region building on the derived modelling table."""

from __future__ import annotations

from pyspark.sql import functions as F

from scanweave.functions.exprs import rnd, time_bucket
from scanweave.operators.cells import outside_radius
from scanweave.operators.evaluation import group_importance, stratified_metrics
from scanweave.operators.models import (Settings, ablation, build_regions, contributions, fit_booster, fit_forest, fit_inventory, fit_points,
                                        kmeans_centroids, long_contributions, score)
from scanweave.operators.sampling import block_shuffle, group_out_folds, random_validation, three_way_split
from scanweave.operators.scans import near_share_toward, scan_bitmaps, scan_scalars
from scanweave.plans.evaluation import FOLDS
from scanweave.plans.registry import query
from scanweave.plans.scan_queries import BEAMS, CLIP, FAR, NEAR, scan_of
from scanweave.plans.views import TEL, scan, table, telemetry
from scanweave.session import stored

GEOMETRY = ["dist_m", "sin_b", "cos_b", "near_toward", "in_view"]
SCAN_FEATURES = ["mean_mm", "p90_mm", "near_frac", "open_frac", "mean_front_mm"]
MOTION = ["speed", "value"]
VARIANTS = {"base": ["dist_m"], "full": MOTION + GEOMETRY + SCAN_FEATURES, "noscan": MOTION + GEOMETRY, "nogeo": MOTION + SCAN_FEATURES}
# Rounds are a bound that early stop doesn't reach: it ends a fit once a round gains less than a hundredth.
MAIN = Settings(depth=4, step=0.2, rounds=500, row_share=1.0)
SETTINGS = {"main": MAIN, "shallow": Settings(2, 0.3, 500, 1.0), "slow": Settings(4, 0.1, 500, 1.0), "sampled": Settings(4, 0.2, 500, 0.7)}
STARTS = list(range(1, 11))
KEEP = ["joint_idx", "session_id", "x_m", "y_m", "in_view"]


def modelling_table(spark, sf):
    """Rows with a plausible confidence and all features; those of a scan are worked out once a scan."""
    scans = scan_bitmaps(scan_scalars(scan(spark, sf), BEAMS, NEAR, FAR, CLIP), BEAMS, NEAR)
    scans = scans.select("scan_row", "ok_bits", "near_bits", *SCAN_FEATURES)
    d = scan_of(spark, sf).filter("coalesce(confidence >= 35, false)").join(scans, "scan_row")
    d = near_share_toward(d, BEAMS, 15.0, "near_toward")
    return d.select("joint_idx", "session_id", "us", "x_m", "y_m", "signal", *dict.fromkeys(MOTION + GEOMETRY + SCAN_FEATURES))


def fold_table(spark, sf):
    t = F.broadcast(spark.createDataFrame(FOLDS, "fold string, session_id string, role string, keep_every int"))  # nine fixed rows
    return stored(group_out_folds(modelling_table(spark, sf), t, "session_id", "us", "joint_idx", time_bucket("us", 86400)))


def metric_rows(p, keys):
    return stratified_metrics(p, keys).select(*keys, "stratum", "n", *[rnd(c).alias(c) for c in ("rmse", "mae", "r2", "bias")])


@query("m01_boosted_fit_early_stop")
def m01(spark, sf):
    rows = fold_table(spark, sf).filter("fold = 'F-A'")
    m = fit_booster(rows, VARIANTS["full"], "signal", MAIN)
    return metric_rows(score(m, rows.filter("split = 'test'"), VARIANTS["full"], "signal", KEEP), []).withColumn("n_trees", F.lit(m.stages[-1].getNumTrees))


@query("m02_second_learner")
def m02(spark, sf):
    rows = fold_table(spark, sf).filter("fold = 'F-A'")
    m = fit_forest(rows, VARIANTS["full"], "signal", Settings(depth=5, rounds=100, row_share=0.8))
    return metric_rows(score(m, rows.filter("split = 'test'"), VARIANTS["full"], "signal", KEEP), [])


@query("m03_prediction_table")
def m03(spark, sf):
    rows = fold_table(spark, sf).filter("fold = 'F-B'")
    m = fit_booster(rows, VARIANTS["full"], "signal", MAIN)
    return score(m, rows.filter("split = 'test'"), VARIANTS["full"], "signal", KEEP)


@query("m04_ablation_grid")
def m04(spark, sf):
    p = ablation(fold_table(spark, sf), ["F-A", "F-B", "F-C"], VARIANTS, "signal", KEEP, {"main": MAIN})
    return metric_rows(p, ["fold", "variant", "config"])


@query("m05_settings_sweep_and_buffer")
def m05(spark, sf):
    rows = fold_table(spark, sf).filter("fold = 'F-B'")
    pool, test = rows.filter("split <> 'test'"), rows.filter("split = 'test'")
    drawn = random_validation(pool.drop("split"), ["session_id"], "val", "joint_idx")
    buffered = outside_radius(pool, test.filter("x_m BETWEEN 4 AND 9 AND y_m < 6"), [], 1.0)
    placebo = block_shuffle(pool, ["session_id", "split"], "placebo", "joint_idx", SCAN_FEATURES)
    drawn, buffered, placebo = (stored(d).unionByName(test) for d in (drawn, buffered, placebo))
    wanted = {"slow": (rows, SETTINGS["slow"]), **{c: (rows, SETTINGS[c]) for c in ("main", "shallow", "sampled")},
              **{f"{c}_randval": (drawn, SETTINGS[c]) for c in ("main", "shallow")}, "buffer": (buffered, MAIN), "placebo": (placebo, MAIN)}
    p = fit_points([({"fold": "F-B", "variant": "full", "config": c}, d, VARIANTS["full"], s) for c, (d, s) in wanted.items()], "signal", KEEP)
    return metric_rows(p, ["fold", "variant", "config"])


def attributed(spark, sf):
    rows = fold_table(spark, sf).filter("fold = 'F-A'")
    m = fit_booster(rows, VARIANTS["full"], "signal", MAIN)
    return contributions(m, rows.filter("split = 'test'"), VARIANTS["full"], "signal", KEEP)


@query("m06_additive_contributions", f"""
WITH {TEL} SELECT count(*) AS n, true AS sums_to_prediction FROM tel WHERE session_id = 's0' AND confidence >= 35""")
def m06(spark, sf):
    w = attributed(spark, sf)
    total = sum(F.col(f"c_{f}") for f in VARIANTS["full"]) + F.col("bias")
    return w.agg(F.count("*").alias("n"), (F.max(F.abs(total - F.col("p"))) < 1e-6).alias("sums_to_prediction"))


@query("m06_group_importance_of_fit")
def m06g(spark, sf):
    lng = long_contributions(attributed(spark, sf), VARIANTS["full"], ["joint_idx", "session_id"]).withColumnRenamed("session_id", "fold")
    g = [(f, n) for n, fs in (("motion", MOTION), ("geometry", GEOMETRY), ("scan", SCAN_FEATURES)) for f in fs]
    return group_importance(lng, F.broadcast(spark.createDataFrame(g, "feature string, grp string")))  # twelve fixed rows


@query("m07_kmeans_regions")
def m07(spark, sf):
    t = telemetry(spark, sf)
    from scanweave.operators.cells import nearest_of
    d = t.withColumn("region_id", nearest_of(kmeans_centroids(t, 5, STARTS)))
    return d.groupBy("region_id").agg(F.count("*").alias("n"), rnd(F.avg("x_m")).alias("x"), rnd(F.avg("y_m")).alias("y"))


# Fixed value: a region of fewer rows makes the build fall back to equal chunks along the main axis.
REGION_ROWS = 5000


def built(d, row_id):
    d, method = build_regions(d, 5, REGION_ROWS, row_id, STARTS)
    return d.groupBy("region_id").agg(F.count("*").alias("n"), rnd(F.min("x_m")).alias("x_lo"), rnd(F.max("x_m")).alias("x_hi")).withColumn("method", F.lit(method))


def _regions_sql(rows, k=5, starts=10, rounds=200):
    """``build_regions`` of ``rows(id, x_m, y_m)``: k-means on a grid of a millionth, or equal chunks along the main axis."""
    ks = range(k)
    each = lambda text, sep=", ": sep.join(text.format(j=j) for j in ks)
    down = "({a} - (({a} % {n}) + {n}) % {n}) // {n}"  # rounded down, below 0 as well
    mean = lambda c: ", ".join("CAST(coalesce(" + down.format(a=f"sum({c}i * w) FILTER (j = {j})", n=f"sum(w) FILTER (j = {j})")
                               + f", any_value({c}{j})) AS BIGINT) AS n{c}{j}" for j in ks)
    return f"""
WITH RECURSIVE c AS (SELECT *, isfinite(x_m) AND isfinite(y_m) AS ok FROM ({rows})),
g AS MATERIALIZED (SELECT *, CASE WHEN ok THEN CAST(floor(x_m * 1000000 + 0.5) AS BIGINT) END AS xi, CASE WHEN ok THEN CAST(floor(y_m * 1000000 + 0.5) AS BIGINT) END AS yi FROM c),
pos AS MATERIALIZED (SELECT xi, yi, count(*) AS w FROM g WHERE ok AND (SELECT count(*) FROM g WHERE ok) >= {k * REGION_ROWS} GROUP BY 1, 2),
named AS (SELECT s, xi, yi, row_number() OVER (PARTITION BY s ORDER BY md5(concat_ws(':', s, xi, yi))) - 1 AS j FROM pos, range(1, {starts + 1}) t(s) QUALIFY j < {k}),
lloyd AS (
    SELECT s, 0 AS r, true AS moves, CAST(0 AS HUGEINT) AS cost, {each("max(xi) FILTER (j = {j}) AS x{j}, max(yi) FILTER (j = {j}) AS y{j}")} FROM named GROUP BY s
    UNION ALL
    SELECT s, r + 1, {each("coalesce(nx{j} <> x{j} OR ny{j} <> y{j}, false)", " OR ")}, cost, {each("nx{j}, ny{j}")}
    FROM (SELECT s, any_value(r) AS r, sum(CAST(d // 8 AS HUGEINT) * w) AS cost, {each("any_value(x{j}) AS x{j}, any_value(y{j}) AS y{j}")}, {mean("x")}, {mean("y")}
          FROM (SELECT *, d % 8 AS j FROM (SELECT l.*, xi, yi, w, least({each("8 * ((xi - x{j}) * (xi - x{j}) + (yi - y{j}) * (yi - y{j})) + {j}")}) AS d
                FROM lloyd l, pos WHERE moves AND r < {rounds})) GROUP BY s)),
best AS (SELECT * FROM (SELECT * FROM lloyd QUALIFY row_number() OVER (PARTITION BY s ORDER BY r DESC) = 1) ORDER BY cost, s LIMIT 1),
cent AS (SELECT list({{'x': x, 'y': y}} ORDER BY x, y) AS p FROM (SELECT unnest([{each("x{j}")}]) AS x, unnest([{each("y{j}")}]) AS y FROM best) WHERE x IS NOT NULL),
near AS (SELECT x_m, CAST(least({", ".join(f"8 * ((xi - p[{j}].x) * (xi - p[{j}].x) + (yi - p[{j}].y) * (yi - p[{j}].y)) + {j}" for j in range(1, k + 1))}) % 8 AS INT) AS region_id FROM g, cent),
byk AS (SELECT region_id, count(*) AS n, round(min(x_m), 6) AS x_lo, round(max(x_m), 6) AS x_hi, 'kmeans' AS method FROM near GROUP BY 1),
good AS (SELECT count(*) = {k} AND min(n) >= {REGION_ROWS} AS yes FROM byk WHERE region_id IS NOT NULL),
m AS (SELECT avg(x_m) AS mx, avg(y_m) AS my, 0.5*atan2(2*covar_pop(x_m, y_m), covar_pop(x_m, x_m) - covar_pop(y_m, y_m)) AS a FROM c),
p AS (SELECT id, x_m, round((x_m-mx)*cos(a) + (y_m-my)*sin(a), 9) AS proj FROM c, m),
n AS (SELECT *, CAST(ntile({k}) OVER (ORDER BY proj NULLS FIRST, id NULLS FIRST) AS INT) AS region_id FROM p)
SELECT b.* FROM byk b, good WHERE yes
UNION ALL SELECT region_id, count(*) AS n, round(min(x_m), 6) AS x_lo, round(max(x_m), 6) AS x_hi, 'principal_axis' AS method FROM n, good WHERE NOT yes GROUP BY 1"""


@query("m08_region_build_with_fallback", _regions_sql(
    "SELECT c_custkey AS id, CAST(c_acctbal AS DOUBLE)/100 AS x_m, CAST(c_custkey*37 % 240 AS DOUBLE)/10 AS y_m FROM customer"))
def m08(spark, sf):
    """Customers are too few for regions of their own up to scale 0.1; from 25,000 on k-means may hold."""
    c = table(spark, sf, "customer").select("c_custkey", (F.col("c_acctbal").cast("double") / 100).alias("x_m"),
                                            ((F.col("c_custkey") * 37 % 240).cast("double") / 10).alias("y_m"))
    return built(c, "c_custkey")


@query("m08_region_build_kmeans")
def m08k(spark, sf):
    """Line items fill five regions from scale 0.01 on."""
    l = table(spark, sf, "lineitem").select((F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("line_id"),
                                            F.col("l_quantity").cast("double").alias("x_m"), (F.col("l_discount").cast("double") * 400).alias("y_m"))
    return built(l, "line_id")


@query("m09_session_effect")
def m09(spark, sf):
    d = three_way_split(modelling_table(spark, sf), ["session_id"], ["us", "joint_idx"], time_bucket("us", 86400))
    d = stored(d.withColumn("is_s0", (F.col("session_id") == "s0").cast("tinyint")).withColumn("is_s1", (F.col("session_id") == "s1").cast("tinyint")))
    feats = VARIANTS["noscan"] + ["is_s0", "is_s1"]
    m = fit_booster(d, feats, "signal", MAIN)
    lng = long_contributions(contributions(m, d.filter("split = 'test'"), feats, "signal", ["joint_idx"]), feats, ["joint_idx"]).withColumn("fold", F.lit("all"))
    g = [(f, "session" if f.startswith("is_s") else "other") for f in feats]
    return group_importance(lng, F.broadcast(spark.createDataFrame(g, "feature string, grp string")))  # nine fixed rows
