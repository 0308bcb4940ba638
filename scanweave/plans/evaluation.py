"""Folds, placebo shuffles, metrics, deltas, attribution summaries and verdicts."""

from __future__ import annotations

from pyspark.sql import functions as F

from scanweave.functions.exprs import rnd, text_seed
from scanweave.operators import rules
from scanweave.operators.cells import with_cells
from scanweave.operators.evaluation import (bootstrap_rmse, dominant_group, group_importance, pair_errors, paired_delta,
                                            sign_of, stratified_metrics)
from scanweave.operators.sampling import (block_shuffle, decimate, equal_chunks, evenly_spaced, group_out_folds,
                                          principal_axis, random_validation, region_out_folds, sample_exact, tail_split,
                                          three_way_split)
from scanweave.operators.stats import spearman
from scanweave.operators.timeline import density_chunks
from scanweave.plans.registry import query
from scanweave.plans.spatial import REGION_SQL, STATS, regions, stats
from scanweave.plans.statistics import POIS, draw_sql
from scanweave.plans.views import TEL, telemetry
from scanweave.session import stored

ORDER = ["us", "joint_idx"]
VARIANTS = ("full", "noscan", "nogeo", "base")



def ordered(spark, sf, *more):
    """Rows of each session in chunks of even density along its clock."""
    return density_chunks(telemetry(spark, sf).select("joint_idx", "session_id", "us", *more), ["session_id"], "us")


PREDS = """
pw AS (SELECT joint_idx, session_id AS fold, x_m, y_m, signal AS y, abs(heading_rad) <= 1.92 AS in_view, value, coalesce(confidence, 50) AS c,
  -30 - 12*log10(greatest(sqrt((x_m-5)*(x_m-5)+(y_m-5)*(y_m-5)), CAST(0.05 AS DOUBLE))) AS l FROM tel),
preds AS (SELECT *, l + (value-50)/20 AS p, 'full' AS variant FROM pw UNION ALL SELECT *, l + (c-50)/50, 'noscan' FROM pw
  UNION ALL SELECT *, -42 + (value-50)/10, 'nogeo' FROM pw UNION ALL SELECT *, -42, 'base' FROM pw)"""


def preds(spark, sf):
    t = telemetry(spark, sf)
    line = -30 - 12 * F.log10(F.greatest(F.sqrt((F.col("x_m") - 5) ** 2 + (F.col("y_m") - 5) ** 2), F.lit(0.05)))
    c = F.coalesce("confidence", F.lit(50.0))
    p = {"full": line + (F.col("value") - 50) / 20, "noscan": line + (c - 50) / 50, "nogeo": -42 + (F.col("value") - 50) / 10,
         "base": F.lit(-42.0)}
    return t.select("joint_idx", F.col("session_id").alias("fold"), "x_m", "y_m", F.col("signal").alias("y"),
                    (F.abs("heading_rad") <= 1.92).alias("in_view"), F.col("value"), c.alias("c"),
                    F.inline(F.array(*[F.struct(F.lit(v).alias("variant"), p[v].alias("p")) for v in VARIANTS])))


METRICS = PREDS + """,
sx AS (SELECT fold, variant, joint_idx, y, p, unnest(['overall', CASE WHEN in_view THEN 'in_view' ELSE 'out_of_view' END]) AS stratum FROM preds),
met AS (SELECT fold, variant, stratum, count(*) AS n, sqrt(avg((y-p)*(y-p))) AS rmse, avg(abs(y-p)) AS mae, 1 - sum((y-p)*(y-p))/(var_pop(y)*count(*)) AS r2,
  avg(y-p) AS bias FROM sx GROUP BY 1, 2, 3)"""
MCOLS = ("rmse", "mae", "r2", "bias")


def metrics(spark, sf):
    return stratified_metrics(preds(spark, sf), ["fold", "variant"])


@query("a09_stratified_metrics", f"""
WITH {TEL}, {METRICS} SELECT fold, variant, stratum, n, round(rmse, 6) AS rmse, round(mae, 6) AS mae, round(r2, 6) AS r2, round(bias, 6) AS bias FROM met""")
def a09(spark, sf):
    return metrics(spark, sf).select("fold", "variant", "stratum", "n", *[rnd(c).alias(c) for c in MCOLS])


REPLICATES = 1000  # fixed value: resamples of an interval


def boot_sql(src, cols, reps, seed):
    return f"bw AS (SELECT *, {POIS} AS w FROM ({draw_sql(src, cols, reps, seed)}))"


BOOT = boot_sql("sx", "fold, variant, stratum, joint_idx, (y-p)*(y-p) AS e2", REPLICATES, 11) + """,
br AS (SELECT fold, variant, stratum, rep, sqrt(sum(w*e2)/sum(w)) AS r FROM bw GROUP BY 1, 2, 3, 4),
ci AS (SELECT fold, variant, stratum, quantile_cont(r, 0.025) AS lo, quantile_cont(r, 0.975) AS hi FROM br GROUP BY 1, 2, 3)"""


@query("a30_bootstrap_rmse_interval", f"""
WITH {TEL}, {METRICS}, {BOOT} SELECT fold, variant, stratum, round(lo, 6) AS rmse_ci_lo, round(hi, 6) AS rmse_ci_hi FROM ci""")
def a30(spark, sf):
    b = bootstrap_rmse(preds(spark, sf), ["fold", "variant"], "joint_idx", REPLICATES, 11)
    return b.select("fold", "variant", "stratum", rnd("rmse_ci_lo").alias("rmse_ci_lo"), rnd("rmse_ci_hi").alias("rmse_ci_hi"))


@query("m15_metric_pivot_formatted", f"""
WITH {TEL}, {METRICS}, {BOOT}, c AS (SELECT fold, variant, stratum, printf('%.3f [%.3f, %.3f]', rmse, lo, hi) AS t FROM met JOIN ci USING (fold, variant, stratum))
SELECT variant, stratum, max(t) FILTER (fold = 's0') AS s0, max(t) FILTER (fold = 's1') AS s1, max(t) FILTER (fold = 's2') AS s2 FROM c GROUP BY 1, 2""")
def m15(spark, sf):
    p = preds(spark, sf)
    keys = ["fold", "variant"]
    d = stratified_metrics(p, keys).join(bootstrap_rmse(p, keys, "joint_idx", REPLICATES, 11), [*keys, "stratum"])
    d = d.withColumn("t", F.format_string("%.3f [%.3f, %.3f]", "rmse", "rmse_ci_lo", "rmse_ci_hi"))
    return d.groupBy("variant", "stratum").pivot("fold", ["s0", "s1", "s2"]).agg(F.max("t"))


DELTA = """
pe AS (SELECT a.fold, a.joint_idx, a.in_view, (a.y-a.p)*(a.y-a.p) AS ea, (b.y-b.p)*(b.y-b.p) AS eb FROM preds a JOIN preds b USING (fold, joint_idx)
  WHERE a.variant = 'noscan' AND b.variant = 'full'),
ps AS (SELECT *, unnest(['overall', CASE WHEN in_view THEN 'in_view' ELSE 'out_of_view' END]) AS stratum FROM pe),
dp AS (SELECT fold, stratum, count(*) AS n, sqrt(avg(ea)) AS rmse_a, sqrt(avg(eb)) AS rmse_b FROM ps GROUP BY 1, 2)"""


@query("j06_m10_paired_ablation_delta", f"""
WITH {TEL}, {PREDS}, {DELTA}, {boot_sql("ps", "fold, stratum, joint_idx, ea, eb", REPLICATES, 13)},
d AS (SELECT fold, stratum, rep, sqrt(sum(w*ea)/sum(w)) - sqrt(sum(w*eb)/sum(w)) AS d FROM bw GROUP BY 1, 2, 3),
c AS (SELECT fold, stratum, quantile_cont(d, 0.025) AS lo, quantile_cont(d, 0.975) AS hi FROM d GROUP BY 1, 2)
SELECT fold, stratum, n, round(rmse_a, 6) AS rmse_a, round(rmse_b, 6) AS rmse_b, round(rmse_a - rmse_b, 6) AS delta, round(lo, 6) AS ci_lo, round(hi, 6) AS ci_hi
FROM dp JOIN c USING (fold, stratum)""")
def m10(spark, sf):
    e = pair_errors(preds(spark, sf), ["fold"], "joint_idx", "noscan", "full")
    return paired_delta(e, ["fold"], "joint_idx", REPLICATES, 13).select(
        "fold", "stratum", "n", *[rnd(c).alias(c) for c in ("rmse_a", "rmse_b", "delta", "ci_lo", "ci_hi")])


def wide_sql(stratum):
    return f"""wide AS (SELECT fold, max(rmse) FILTER (variant = 'full') AS f, max(rmse) FILTER (variant = 'noscan') AS a, max(rmse) FILTER (variant = 'nogeo') AS b
FROM met WHERE stratum = '{stratum}' GROUP BY 1),
jd AS (SELECT *, CASE WHEN f < a - 0.5 AND f < b - 0.5 THEN 'complementary' WHEN abs(f - a) < 0.5 THEN 'scan_removable' WHEN abs(f - b) < 0.5 THEN 'geometry_removable' ELSE 'unclear' END AS judgement FROM wide)"""


def judged(spark, sf, stratum="overall"):
    w = metrics(spark, sf).filter(F.col("stratum") == stratum).groupBy("fold").pivot("variant", ["full", "noscan", "nogeo"]).agg(F.max("rmse"))
    return w.withColumn("judgement", rules.removable(F.col("full"), F.col("noscan"), F.col("nogeo"), 0.5))


@query("m11_removability_per_fold", f"WITH {TEL}, {METRICS}, {wide_sql('overall')} SELECT fold, round(f, 6) AS full_rmse, round(a, 6) AS noscan_rmse, round(b, 6) AS nogeo_rmse, judgement FROM jd")
def m11(spark, sf):
    return judged(spark, sf).select("fold", rnd("full").alias("full_rmse"), rnd("noscan").alias("noscan_rmse"), rnd("nogeo").alias("nogeo_rmse"), "judgement")


@query("m11_majority_verdict", f"""
WITH {TEL}, {METRICS}, {wide_sql('in_view')}, v AS (SELECT count(*) FILTER (judgement = 'complementary') AS c, count(*) FILTER (judgement = 'scan_removable') AS s,
 count(*) FILTER (judgement = 'geometry_removable') AS g FROM jd)
SELECT c AS n_complementary, s AS n_scan_removable, g AS n_geometry_removable, CASE WHEN c >= 2 THEN 'complementary' WHEN s >= 2 THEN 'scan_removable' WHEN g >= 2 THEN 'geometry_removable' ELSE 'unclear' END AS verdict FROM v""")
def m11v(spark, sf):
    return rules.majority(judged(spark, sf, "in_view"), "judgement", 2, ("complementary", "scan_removable", "geometry_removable"), "unclear")


ALT = METRICS + """,
alt AS (SELECT fold, variant, stratum, sqrt(avg((y-q)*(y-q))) AS rmse FROM (SELECT fold, variant, y, p + 0.6*cos(joint_idx) AS q,
  unnest(['overall', CASE WHEN in_view THEN 'in_view' ELSE 'out_of_view' END]) AS stratum FROM preds) GROUP BY 1, 2, 3),
sens AS (SELECT m.fold, m.variant, m.stratum, m.rmse AS r0, a.rmse AS r1, a.rmse - m.rmse AS delta FROM met m JOIN alt a USING (fold, variant, stratum))"""


def sensitivity(spark, sf):
    p = preds(spark, sf)
    keys = ["fold", "variant"]
    base = stratified_metrics(p, keys).select(*keys, "stratum", F.col("rmse").alias("r0"))
    alt = stratified_metrics(p.withColumn("p", F.col("p") + 0.6 * F.cos("joint_idx")), keys).select(*keys, "stratum", F.col("rmse").alias("r1"))
    return base.join(alt, [*keys, "stratum"]).withColumn("delta", F.col("r1") - F.col("r0"))


@query("m12_sensitivity_table", f"""WITH {TEL}, {ALT} SELECT fold, variant, stratum, round(r0, 6) AS rmse_base, round(r1, 6) AS rmse_alt, round(delta, 6) AS delta FROM sens""")
def m12(spark, sf):
    return sensitivity(spark, sf).select("fold", "variant", "stratum", rnd("r0").alias("rmse_base"), rnd("r1").alias("rmse_alt"), rnd("delta").alias("delta"))


@query("m12_majority_flag", f"""WITH {TEL}, {ALT} SELECT fold, count(*) AS n_total, count(*) FILTER (abs(delta) < 0.02) AS n_stable, count(*) FILTER (abs(delta) < 0.02) < count(*)//2 + 1 AS flagged
FROM sens WHERE stratum = 'overall' GROUP BY 1""")
def m12f(spark, sf):
    ok = F.count_if(F.abs("delta") < 0.02)
    return sensitivity(spark, sf).filter("stratum = 'overall'").groupBy("fold").agg(
        F.count("*").alias("n_total"), ok.alias("n_stable"), (ok < F.floor(F.count("*") / 2) + 1).alias("flagged"))


@query("j16_metric_record_lookup", f"""
WITH {TEL}, {METRICS}, alias AS (SELECT * FROM (VALUES ('main', 'full'), ('h1', 'noscan'), ('h2', 'nogeo')) v(config, variant))
SELECT config, fold, max(rmse) FILTER (stratum = 'in_view') AS x, round(max(rmse) FILTER (stratum = 'in_view'), 6) AS in_view_rmse, round(max(rmse) FILTER (stratum = 'overall'), 6) AS overall_rmse
FROM met JOIN alias USING (variant) GROUP BY 1, 2""".replace("max(rmse) FILTER (stratum = 'in_view') AS x, ", ""))
def j16(spark, sf):
    a = spark.createDataFrame([("main", "full"), ("h1", "noscan"), ("h2", "nogeo")], "config string, variant string")
    d = metrics(spark, sf).join(F.broadcast(a), "variant").groupBy("config", "fold")  # three fixed rows
    return d.pivot("stratum", ["in_view", "overall"]).agg(F.max("rmse")).select(
        "config", "fold", rnd("in_view").alias("in_view_rmse"), rnd("overall").alias("overall_rmse"))


# Which gain stands for which configuration: fold, stratum, and the pair of variants it is the difference of.
GAINS = {"locked": ("s1", "overall", "real"), "h1": ("s0", "in_view", "real"), "h2": ("s1", "in_view", "real"), "h3": ("s2", "in_view", "real"),
         "h1_randval": ("s0", "in_view", "placebo"), "h2_randval": ("s1", "in_view", "placebo"), "second_default": ("s2", "overall", "real"),
         "second_h1": ("s0", "overall", "real"), "buffer": ("s2", "in_view", "placebo")}


@query("m13_verdict_rules", f"""
WITH {TEL}, {METRICS}, d AS (SELECT fold, stratum, max(rmse) FILTER (variant = 'noscan') - max(rmse) FILTER (variant = 'full') AS real,
  max(rmse) FILTER (variant = 'base') - max(rmse) FILTER (variant = 'nogeo') AS placebo FROM met GROUP BY 1, 2),
g AS (SELECT {", ".join(f"max({kind}) FILTER (fold = '{f}' AND stratum = '{s}') AS {name}" for name, (f, s, kind) in GAINS.items())},
  count(*) FILTER (stratum = 'in_view' AND real >= 1.0) AS clearing, count(*) FILTER (stratum = 'overall' AND real > 0) AS n_up,
  count(*) FILTER (stratum = 'overall' AND real < 0) AS n_down FROM d),
v AS (SELECT *, CASE (SELECT count(*) FROM (VALUES (h1), (h2), (h3)) t(x) WHERE x >= 0.5) WHEN 3 THEN 'GREEN' WHEN 2 THEN 'GREEN' ELSE 'RED' END AS settings,
  CASE WHEN h2 >= h2_randval + 0.5 THEN 'REAL_SIGNAL' WHEN h2_randval >= 0.5 THEN 'MARGINAL_DISTRIBUTION_DRIVEN' ELSE 'NOT_SIGNAL' END AS control,
  CASE WHEN greatest(second_default, second_h1) >= 0.5 THEN 'FRAMEWORK_ROBUST' WHEN greatest(second_default, second_h1) < 0 THEN 'FRAMEWORK_FRAGILE' ELSE 'FRAMEWORK_PARTIAL' END AS framework,
  CASE WHEN greatest(locked, h1, h2, h3) > 1 THEN 'RECOVERABLE_HYPERPARAMS' WHEN greatest(abs(h1_randval - h1), abs(h2_randval - h2)) > 0.5 AND greatest(h1_randval, h2_randval) > 1
    THEN 'RECOVERABLE_VALIDATION_PROTOCOL' ELSE 'PIVOT_JUSTIFIED' END AS protocol,
  CASE WHEN clearing >= 3 THEN 'WITHIN-SESSION-HELPS' WHEN clearing = 0 THEN 'WITHIN-SESSION-NULL' ELSE 'MIXED' END AS within,
  CASE WHEN buffer >= 0.5 AND h1 >= 0.5 THEN 'R-4 IS A ROBUST EXEMPLAR' WHEN buffer >= 0.5 OR h1 >= 0.5 THEN 'R-4 IS PARTIALLY ROBUST' ELSE 'R-4 IS ILLUSORY' END AS exemplar FROM g)
SELECT clearing, n_up, n_down, settings, control, framework, protocol, within, exemplar,
  CASE WHEN settings = 'GREEN' AND control = 'REAL_SIGNAL' AND framework = 'FRAMEWORK_ROBUST' THEN 'ROBUST_POSITIVE'
    WHEN settings = 'GREEN' OR control = 'REAL_SIGNAL' OR framework = 'FRAMEWORK_ROBUST' THEN 'PARTIALLY_ROBUST' ELSE 'ILLUSORY' END AS combined FROM v""")
def m13(spark, sf):
    w = metrics(spark, sf).groupBy("fold", "stratum").pivot("variant", list(VARIANTS)).agg(F.max("rmse"))
    w = w.select("fold", "stratum", (F.col("noscan") - F.col("full")).alias("real"), (F.col("base") - F.col("nogeo")).alias("placebo"))
    over = F.col("stratum") == "overall"
    g = w.agg(*[F.max(F.when((F.col("fold") == f) & (F.col("stratum") == s), F.col(kind))).alias(name) for name, (f, s, kind) in GAINS.items()],
              F.count_if(~over & (F.col("stratum") == "in_view") & (F.col("real") >= rules.CLEARS_DB)).alias("clearing"),
              F.count_if(over & (F.col("real") > 0)).alias("n_up"), F.count_if(over & (F.col("real") < 0)).alias("n_down"))
    of = lambda *names: [F.col(n) for n in names]
    v = g.select("*", rules.settings_verdict(of("h1", "h2", "h3")).alias("settings"), rules.control_verdict(*of("h2", "h2_randval")).alias("control"),
                 rules.framework_verdict(of("second_default", "second_h1")).alias("framework"),
                 rules.pivot_verdict(of("locked", "h1", "h2", "h3"), of("h1_randval", "h2_randval"), of("h1", "h2")).alias("protocol"),
                 rules.within_verdict(F.col("clearing")).alias("within"), rules.exemplar_verdict(of("buffer", "h1")).alias("exemplar"))
    n = sum((F.col(c) == best).cast("int") for c, best in (("settings", rules.SETTINGS[0]), ("control", rules.CONTROL[0]), ("framework", rules.FRAMEWORK[0])))
    return v.select("clearing", "n_up", "n_down", "settings", "control", "framework", "protocol", "within", "exemplar",
                    rules.count_verdict(n, 3, rules.COMBINED).alias("combined"))


@query("o07_choose_fold_near_median", f"""
WITH {TEL}, {REGION_SQL}, {PREDS}, rr AS (SELECT region_id, sqrt(avg((y-p)*(y-p))) AS rmse FROM preds JOIN (SELECT joint_idx, region_id FROM reg) USING (joint_idx) WHERE variant = 'base' GROUP BY 1),
m AS (SELECT median(rmse) AS med, max(rmse) FILTER (region_id = 4) AS dflt FROM rr)
SELECT 'R-' || CASE WHEN dflt - med > 1 THEN (SELECT arg_min(region_id, (abs(rmse - med), region_id)) FROM rr) ELSE 4 END AS fold, round(med, 6) AS median_rmse, round(dflt, 6) AS default_rmse FROM m""")
def o07(spark, sf):
    r = preds(spark, sf).filter("variant = 'base'").join(regions(spark, sf).select("joint_idx", "region_id"), "joint_idx")
    e = F.col("y") - F.col("p")
    rr = r.groupBy("region_id").agg(F.sqrt(F.avg(e * e)).alias("rmse"))
    m = rr.agg(F.median("rmse").alias("med"), F.max(F.when(F.col("region_id") == 4, F.col("rmse"))).alias("dflt"),
               F.collect_list(F.struct("rmse", "region_id")).alias("all"))  # five regions
    near = F.array_min(F.transform("all", lambda x: F.struct(F.abs(x.rmse - F.col("med")).alias("d"), x.region_id.alias("r")))).getField("r")
    return m.select(F.concat(F.lit("R-"), F.when(F.col("dflt") - F.col("med") > 1, near).otherwise(4).cast("string")).alias("fold"),
                    rnd("med").alias("median_rmse"), rnd("dflt").alias("default_rmse"))


@query("a41_baseline_mean_vs_model", f"""
WITH {TEL}, {REGION_SQL}, {PREDS}, d AS (SELECT region_id, y, p FROM preds JOIN (SELECT joint_idx, region_id FROM reg) USING (joint_idx) WHERE variant = 'full'),
t AS (SELECT sum(y) AS s, count(*) AS n FROM d), g AS (SELECT region_id, sum(y) AS s, count(*) AS n FROM d GROUP BY 1),
b AS (SELECT region_id, (t.s - g.s)/(t.n - g.n) AS train_mean FROM g, t)
SELECT region_id, count(*) AS n, round(train_mean, 6) AS train_mean, round(sqrt(avg((y-train_mean)*(y-train_mean))), 6) AS rmse_mean, round(sqrt(avg((y-p)*(y-p))), 6) AS rmse_model,
  round(sqrt(avg((y-train_mean)*(y-train_mean))) - sqrt(avg((y-p)*(y-p))), 6) AS delta FROM d JOIN b USING (region_id) GROUP BY 1, train_mean""")
def a41(spark, sf):
    d = preds(spark, sf).filter("variant = 'full'").join(regions(spark, sf).select("joint_idx", "region_id"), "joint_idx")
    g = d.groupBy("region_id").agg(F.sum("y").alias("s"), F.sum(F.col("y") * F.col("y")).alias("q"), F.count("*").alias("n"),
                                   F.avg((F.col("y") - F.col("p")) ** 2).alias("m"))
    t = g.agg(F.sum("s").alias("s"), F.sum("n").alias("n"))
    g = g.withColumn("tm", (t.select("s").scalar() - F.col("s")) / (t.select("n").scalar() - F.col("n")))
    base = F.sqrt(F.col("q") / F.col("n") - 2 * F.col("tm") * F.col("s") / F.col("n") + F.col("tm") * F.col("tm"))
    return g.select("region_id", "n", rnd("tm").alias("train_mean"), rnd(base).alias("rmse_mean"), rnd(F.sqrt("m")).alias("rmse_model"),
                    rnd(base - F.sqrt("m")).alias("delta"))


@query("a44_noise_floor_vs_best_model", f"""
WITH {TEL}, {STATS}, {METRICS}, b AS (SELECT min(rmse) AS best FROM met WHERE stratum = 'overall'), f AS (SELECT avg(sd) AS sigma FROM cs WHERE n >= 20)
SELECT round(sigma, 6) AS noise_floor, round(best, 6) AS best_rmse, round(best - sigma, 6) AS gap FROM b, f""")
def a44(spark, sf):
    f = stats(spark, sf).filter("n >= 20").select(F.avg("sd")).scalar()
    b = metrics(spark, sf).filter("stratum = 'overall'").agg(F.min("rmse").alias("best")).withColumn("sigma", f)
    return b.select(rnd("sigma").alias("noise_floor"), rnd("best").alias("best_rmse"), rnd(F.col("best") - F.col("sigma")).alias("gap"))


# ---- folds and splits ---------------------------------------------------
RANKS = "ck AS (SELECT *, row_number() OVER (PARTITION BY session_id ORDER BY us, joint_idx) AS rn, count(*) OVER (PARTITION BY session_id) AS n FROM tel)"


@query("w22_chronological_split", f"""
WITH {TEL}, {RANKS} SELECT joint_idx, CASE WHEN rn > n - greatest(1, least(n - 1, CAST(round_even(n*0.1, 0) AS BIGINT))) THEN 'val' ELSE 'train' END AS split FROM ck""")
def w22(spark, sf):
    return tail_split(ordered(spark, sf), ["session_id"], ORDER, "_ck", 0.10).select("joint_idx", "split")


@query("w22_three_way_split", f"""
WITH {TEL}, {RANKS} SELECT joint_idx, CASE WHEN rn <= round_even(n*0.7, 0) THEN 'train' WHEN rn <= round_even(n*0.7, 0) + round_even(n*0.15, 0) THEN 'val' ELSE 'test' END AS split FROM ck""")
def w22b(spark, sf):
    return three_way_split(ordered(spark, sf), ["session_id"], ORDER, "_ck").select("joint_idx", "split")


@query("w23_decimate", f"WITH {TEL}, {RANKS} SELECT joint_idx FROM ck WHERE (rn - 1) % 6 = 0")
def w23(spark, sf):
    return decimate(ordered(spark, sf), ["session_id"], ORDER, "_ck", 6).select("joint_idx")


FOLDS = [(f, s, "test" if s == t else "train", 4 if f == "F-C" and s != t else 1)
         for f, t in (("F-A", "s0"), ("F-B", "s1"), ("F-C", "s2")) for s in ("s0", "s1", "s2")]
FOLD_SQL = "fd AS (SELECT * FROM (VALUES " + ", ".join(f"('{f}', '{s}', '{r}', {k})" for f, s, r, k in FOLDS) + ") v(fold, session_id, role, k))"
LOGO = FOLD_SQL + """,
fr AS (SELECT t.*, fold, role, k, row_number() OVER (PARTITION BY fold, session_id ORDER BY us, joint_idx) AS r0 FROM tel t JOIN fd USING (session_id)),
fk AS (SELECT *, row_number() OVER (PARTITION BY fold, session_id ORDER BY us, joint_idx) AS rn, count(*) OVER (PARTITION BY fold, session_id) AS n FROM fr WHERE role = 'test' OR (r0 - 1) % k = 0),
folds AS (SELECT *, CASE WHEN role = 'test' THEN 'test' WHEN rn > n - greatest(1, least(n - 1, CAST(round_even(n*0.1, 0) AS BIGINT))) THEN 'val' ELSE 'train' END AS split FROM fk)"""


def folds(spark, sf):
    table = F.broadcast(spark.createDataFrame(FOLDS, "fold string, session_id string, role string, keep_every int"))  # nine fixed rows
    return group_out_folds(ordered(spark, sf, "confidence", "heading_rad"), table, "session_id", "us", "joint_idx", "_ck")


@query("w24_leave_one_group_out", f"WITH {TEL}, {LOGO} SELECT fold, joint_idx, split FROM folds")
def w24(spark, sf):
    return folds(spark, sf).select("fold", "joint_idx", "split")


@query("a39_fold_metadata", f"""
WITH {TEL}, {LOGO} SELECT fold, split, session_id, count(*) AS n_raw, count(*) FILTER (confidence >= 35) AS n_clean,
  count(*) FILTER (abs(heading_rad) <= 1.92) AS n_in_view, count(*) FILTER (abs(heading_rad) > 1.92) AS n_out FROM folds GROUP BY 1, 2, 3""")
def a39(spark, sf):
    v = F.abs("heading_rad") <= 1.92
    return folds(spark, sf).groupBy("fold", "split", "session_id").agg(
        F.count("*").alias("n_raw"), F.count_if(F.col("confidence") >= 35).alias("n_clean"), F.count_if(v).alias("n_in_view"), F.count_if(~v).alias("n_out"))


@query("w25_leave_region_out", f"""
WITH {TEL}, {REGION_SQL}, f AS (SELECT 'R-' || r AS fold, r FROM (SELECT unnest([1, 2, 3, 4, 5]) AS r)),
d AS (SELECT fold, r, joint_idx, region_id, md5(concat_ws('|', 'region', concat_ws('|', fold, joint_idx))) AS h FROM reg, f),
k AS (SELECT *, row_number() OVER (PARTITION BY fold ORDER BY h, concat_ws('|', fold, joint_idx)) AS rn, count(*) OVER (PARTITION BY fold) AS n FROM d WHERE region_id <> r)
SELECT fold, joint_idx, 'test' AS split FROM d WHERE region_id = r
UNION ALL SELECT fold, joint_idx, CASE WHEN rn <= greatest(1, round_even(n*0.1, 0)) THEN 'val' ELSE 'train' END FROM k""")
def w25(spark, sf):
    return region_out_folds(regions(spark, sf), "region_id", [1, 2, 3, 4, 5], "joint_idx", "region").select("fold", "joint_idx", "split")


@query("w26_random_validation", f"""
WITH {TEL}, k AS (SELECT joint_idx, row_number() OVER (PARTITION BY session_id ORDER BY md5(concat_ws('|', 'val', joint_idx)), joint_idx) AS rn, count(*) OVER (PARTITION BY session_id) AS n FROM tel)
SELECT joint_idx, CASE WHEN rn <= greatest(1, round_even(n*0.1, 0)) THEN 'val' ELSE 'train' END AS split FROM k""")
def w26(spark, sf):
    return random_validation(telemetry(spark, sf), ["session_id"], "val", "joint_idx").select("joint_idx", "split")


PLACEBO = """
nat AS (SELECT *, row_number() OVER (PARTITION BY session_id ORDER BY joint_idx) AS rn FROM tel),
rnd AS (SELECT session_id, value AS v2, confidence AS c2, row_number() OVER (PARTITION BY session_id ORDER BY md5(concat_ws('|', 'placebo', joint_idx)), joint_idx) AS rn FROM tel),
shuf AS (SELECT nat.*, v2, c2 FROM nat JOIN rnd USING (session_id, rn))"""


def shuffled(spark, sf):
    t = telemetry(spark, sf).select("session_id", "joint_idx", "signal", "value", "confidence")
    return block_shuffle(t, ["session_id"], "placebo", "joint_idx", ["value", "confidence"])


@query("w27_block_shuffle", f"WITH {TEL}, {PLACEBO} SELECT joint_idx, session_id, v2 AS value, c2 AS confidence FROM shuf")
def w27(spark, sf):
    return shuffled(spark, sf).select("joint_idx", "session_id", "value", "confidence")


@query("a35_marginals_preserved", f"""
WITH {TEL}, {PLACEBO} SELECT session_id, round(abs(avg(value) - avg(v2)), 6) AS value_mean_diff, round(abs(stddev_pop(value) - stddev_pop(v2)), 6) AS value_sd_diff,
  round(abs(avg(confidence) - avg(c2)), 6) AS conf_mean_diff, count(confidence) = count(c2) AS same_nulls, round(corr(value, signal), 5) AS corr_before, round(corr(v2, signal), 5) AS corr_after FROM shuf GROUP BY 1""")
def a35(spark, sf):
    g = lambda d, s: d.groupBy("session_id").agg(
        F.avg("value").alias(f"m{s}"), F.stddev_pop("value").alias(f"s{s}"), F.avg("confidence").alias(f"c{s}"), F.count("confidence").alias(f"n{s}"), F.corr("value", "signal").alias(f"r{s}"))
    a, b = g(telemetry(spark, sf), 0), g(shuffled(spark, sf), 1)
    diff = lambda c: rnd(F.abs(F.col(f"{c}0") - F.col(f"{c}1")))
    return a.join(b, "session_id").select("session_id", diff("m").alias("value_mean_diff"), diff("s").alias("value_sd_diff"), diff("c").alias("conf_mean_diff"),
                                          (F.col("n0") == F.col("n1")).alias("same_nulls"), rnd("r0", 5).alias("corr_before"), rnd("r1", 5).alias("corr_after"))


@query("w28_principal_axis_chunks", f"""
WITH {TEL}, m AS (SELECT avg(x_m) AS mx, avg(y_m) AS my, 0.5*atan2(2*covar_pop(x_m, y_m), covar_pop(x_m, x_m) - covar_pop(y_m, y_m)) AS a FROM tel),
p AS (SELECT joint_idx, round((x_m-mx)*cos(a) + (y_m-my)*sin(a), 9) AS proj FROM tel, m) SELECT joint_idx, CAST(ntile(5) OVER (ORDER BY proj, joint_idx) AS INT) AS part FROM p""")
def w28(spark, sf):
    t = telemetry(spark, sf)
    proj, _ = principal_axis(t)
    return equal_chunks(t.select("joint_idx", F.round(proj, 9).alias("proj")), "proj", "joint_idx", 5).select("joint_idx", "part")


@query("o05_sample_without_replacement", f"""
WITH {TEL}, k AS (SELECT joint_idx, session_id, row_number() OVER (PARTITION BY session_id ORDER BY md5(concat_ws('|', 'sample', joint_idx)), joint_idx) AS rn FROM tel)
SELECT joint_idx, session_id FROM k WHERE rn <= 500""")
def o05(spark, sf):
    return sample_exact(telemetry(spark, sf), ["session_id"], "sample", "joint_idx", 500).select("joint_idx", "session_id")


@query("o06_evenly_spaced_sample", f"""
WITH {TEL}, {RANKS}, pos AS (SELECT session_id, CAST(floor(i*(n-1)/49) AS BIGINT) + 1 AS rn FROM (SELECT DISTINCT session_id, n FROM ck), (SELECT unnest(range(0, 50)) AS i))
SELECT DISTINCT joint_idx, session_id FROM ck JOIN pos USING (session_id, rn)""")
def o06(spark, sf):
    return evenly_spaced(ordered(spark, sf), ["session_id"], ORDER, "_ck", 50).select("joint_idx", "session_id")


# ---- attribution --------------------------------------------------------
GROUPS = [("speed", "motion", 1), ("x_m", "position", 2), ("y_m", "position", 2), ("confidence", "quality", 3), ("dist", "geometry", 4), ("sin_h", "geometry", 4)]
GROUP_SQL = "grp AS (SELECT * FROM (VALUES " + ", ".join(f"('{f}', '{g}', {o})" for f, g, o in GROUPS) + ") v(feature, grp, o))"
CONTRIB = """
cw AS (SELECT joint_idx, session_id AS fold, x_m, y_m, abs(heading_rad) <= 1.92 AS in_view, speed, coalesce(confidence, 50) AS confidence,
  sqrt((x_m-5)*(x_m-5)+(y_m-5)*(y_m-5)) AS dist, sin(heading_rad) AS sin_h FROM tel),
con AS (SELECT joint_idx, fold, x_m, y_m, in_view, 'speed' AS feature, speed AS value, 4*(speed-0.5) AS contribution FROM cw
 UNION ALL SELECT joint_idx, fold, x_m, y_m, in_view, 'x_m', x_m, 0.2*(x_m-10)*speed FROM cw
 UNION ALL SELECT joint_idx, fold, x_m, y_m, in_view, 'y_m', y_m, -0.1*(y_m-6) FROM cw
 UNION ALL SELECT joint_idx, fold, x_m, y_m, in_view, 'confidence', confidence, 0.05*(confidence-50)*cos(joint_idx) FROM cw
 UNION ALL SELECT joint_idx, fold, x_m, y_m, in_view, 'dist', dist, -0.3*(dist-7) FROM cw
 UNION ALL SELECT joint_idx, fold, x_m, y_m, in_view, 'sin_h', sin_h, 0.5*sin_h*speed FROM cw)"""


def contributions(spark, sf):
    c = telemetry(spark, sf).select(
        "joint_idx", F.col("session_id").alias("fold"), "x_m", "y_m", (F.abs("heading_rad") <= 1.92).alias("in_view"), "speed",
        F.coalesce("confidence", F.lit(50.0)).alias("confidence"), F.sqrt((F.col("x_m") - 5) ** 2 + (F.col("y_m") - 5) ** 2).alias("dist"),
        F.sin("heading_rad").alias("sin_h"))
    v = F.col
    parts = {"speed": 4 * (v("speed") - 0.5), "x_m": 0.2 * (v("x_m") - 10) * v("speed"), "y_m": -0.1 * (v("y_m") - 6),
             "confidence": 0.05 * (v("confidence") - 50) * F.cos("joint_idx"), "dist": -0.3 * (v("dist") - 7), "sin_h": 0.5 * v("sin_h") * v("speed")}
    return c.select("joint_idx", "fold", "x_m", "y_m", "in_view", F.inline(F.array(*[
        F.struct(F.lit(f).alias("feature"), v(f).alias("value"), e.alias("contribution")) for f, e in parts.items()])))


def groups(spark):
    return F.broadcast(spark.createDataFrame(GROUPS, "feature string, grp string, grp_order int"))  # six fixed rows


IMPORT = GROUP_SQL + """,
imp AS (SELECT fold, grp, sum(m) AS importance FROM (SELECT fold, feature, avg(abs(contribution)) AS m FROM con GROUP BY 1, 2) JOIN grp USING (feature) GROUP BY 1, 2),
sh AS (SELECT fold, grp, importance, importance/sum(importance) OVER (PARTITION BY fold) AS share FROM imp)"""


@query("a33_group_importance", f"WITH {TEL}, {CONTRIB}, {IMPORT} SELECT fold, grp, round(importance, 6) AS importance, round(share, 6) AS share FROM sh")
def a33(spark, sf):
    return group_importance(contributions(spark, sf), groups(spark)).select("fold", "grp", rnd("importance").alias("importance"), rnd("share").alias("share"))


@query("m16_share_verdict", f"""
WITH {TEL}, {CONTRIB}, {IMPORT} SELECT grp, round(max(share), 6) AS max_share, CASE WHEN max(share) < 0.05 THEN 'negligible' WHEN max(share) < 0.2 THEN 'bounded' ELSE 'large' END AS verdict FROM sh GROUP BY 1""")
def m16(spark, sf):
    g = group_importance(contributions(spark, sf), groups(spark)).groupBy("grp").agg(F.max("share").alias("s"))
    return g.select("grp", rnd("s").alias("max_share"), rules.share_verdict(F.col("s")).alias("verdict"))


@query("a34_dominant_group_per_cell", f"""
WITH {TEL}, {CONTRIB}, {GROUP_SQL}, m AS (SELECT fold, CAST(floor(x_m/2) AS BIGINT) AS cx, CAST(floor(y_m/2) AS BIGINT) AS cy, feature, avg(abs(contribution)) AS m FROM con GROUP BY ALL),
g AS (SELECT fold, cx, cy, grp, avg(m) AS m, min(o) AS o FROM m JOIN grp USING (feature) GROUP BY ALL)
SELECT fold, cx, cy, arg_max(grp, (round(m, 9), -o)) AS grp FROM g GROUP BY 1, 2, 3""")
def a34(spark, sf):
    return dominant_group(with_cells(contributions(spark, sf), 2.0), groups(spark), ["fold", "cx", "cy"])


RK = """
rk AS (SELECT fold, feature, rank() OVER (PARTITION BY fold, feature ORDER BY value) + (count(*) OVER (PARTITION BY fold, feature, value) - 1)/2 AS rx,
  rank() OVER (PARTITION BY fold, feature ORDER BY c6) + (count(*) OVER (PARTITION BY fold, feature, c6) - 1)/2 AS ry FROM (SELECT *, round(contribution, 9) AS c6 FROM con)),
rh AS (SELECT fold, feature, corr(rx, ry) AS rho FROM rk GROUP BY 1, 2)"""


@query("a15_sign_of_effect", f"""
WITH {TEL}, {CONTRIB}, {RK}, s AS (SELECT *, CASE WHEN rho IS NULL THEN '-' WHEN abs(rho) < 0.05 THEN '0' WHEN rho > 0 THEN '+' ELSE '−' END AS sg FROM rh)
SELECT feature, max(sg) FILTER (fold = 's0') AS s0, max(sg) FILTER (fold = 's1') AS s1, max(sg) FILTER (fold = 's2') AS s2, round(avg(rho), 5) AS mean_rho,
  count(*) FILTER (sg = '+') = 3 OR count(*) FILTER (sg = '−') = 3 AS consistent FROM s GROUP BY 1""")
def a15(spark, sf):
    c = contributions(spark, sf).withColumn("contribution", F.round("contribution", 9))
    r = spearman(c, ["fold", "feature"], "value", "contribution").withColumn("sg", sign_of(F.col("rho")))
    at = lambda f: F.max(F.when(F.col("fold") == f, F.col("sg"))).alias(f)
    n = lambda s: F.count_if(F.col("sg") == s) == 3
    return r.groupBy("feature").agg(at("s0"), at("s1"), at("s2"), rnd(F.avg("rho"), 5).alias("mean_rho"), (n("+") | n("−")).alias("consistent"))


@query("a43_contribution_trend", f"""
WITH {TEL}, {CONTRIB}
SELECT fold, feature, in_view, count(*) AS n, round(regr_slope(contribution, value), 5) AS slope, round(regr_intercept(contribution, value), 5) AS intercept FROM con GROUP BY 1, 2, 3 HAVING count(*) >= 5""")
def a43(spark, sf):
    return contributions(spark, sf).groupBy("fold", "feature", "in_view").agg(
        F.count("*").alias("n"), rnd(F.regr_slope("contribution", "value"), 5).alias("slope"), rnd(F.regr_intercept("contribution", "value"), 5).alias("intercept")).filter("n >= 5")


@query("o02_top_features_per_fold", f"""
WITH {TEL}, {CONTRIB}, m AS (SELECT fold, feature, avg(abs(contribution)) AS m FROM con GROUP BY 1, 2)
SELECT fold, feature, round(m, 6) AS importance, rn FROM (SELECT *, row_number() OVER (PARTITION BY fold ORDER BY m DESC, feature) AS rn FROM m) WHERE rn <= 3""")
def o02b(spark, sf):
    from pyspark.sql import Window
    m = contributions(spark, sf).groupBy("fold", "feature").agg(F.avg(F.abs("contribution")).alias("m"))
    w = Window.partitionBy("fold").orderBy(F.desc("m"), "feature")  # one row per feature
    return m.withColumn("rn", F.row_number().over(w).cast("long")).filter("rn <= 3").select("fold", "feature", rnd("m").alias("importance"), "rn")


# ---- gates --------------------------------------------------------------
@query("m14_quality_gates", f"""
WITH {TEL}, f AS (SELECT session_id, regr_r2(signal, log10(greatest(sqrt((x_m-5)*(x_m-5)+(y_m-5)*(y_m-5)), CAST(0.05 AS DOUBLE)))) AS r2, abs(corr(confidence, signal)) AS rho,
  count(confidence)/count(*) AS vf, max(degrees(heading_rad)) - min(degrees(heading_rad)) AS width FROM tel GROUP BY 1),
a AS (SELECT min(r2) AS r_min, count(*) FILTER (rho > 0.25) AS strong, count(*) FILTER (rho > 0.25 AND r2 <= 0) AS demoted, count(*) FILTER (rho > 0.15) AS n_some, min(vf) AS vf, min(width) AS width FROM f)
SELECT CASE WHEN r_min > 0.85 THEN 'YELLOW' ELSE 'GREEN' END AS gate_fit, CASE WHEN vf < 0.3 THEN 'RED' WHEN width < 120 THEN 'YELLOW' ELSE 'GREEN' END AS gate_view,
  CASE WHEN strong >= 2 AND demoted = 0 THEN 'GREEN' WHEN strong >= 2 THEN 'YELLOW' WHEN n_some >= 1 THEN 'YELLOW' ELSE 'RED' END AS gate_correlation FROM a""")
def m14(spark, sf):
    t = telemetry(spark, sf)
    lg = F.log10(F.greatest(F.sqrt((F.col("x_m") - 5) ** 2 + (F.col("y_m") - 5) ** 2), F.lit(0.05)))
    f = t.withColumn("lg", lg).groupBy("session_id").agg(
        F.regr_r2("signal", "lg").alias("r2"), F.abs(F.corr("confidence", "signal")).alias("rho"), (F.count("confidence") / F.count("*")).alias("vf"),
        (F.max(F.degrees("heading_rad")) - F.min(F.degrees("heading_rad"))).alias("width"))
    a = f.agg(F.min("r2").alias("r"), F.count_if(F.col("rho") > 0.25).alias("strong"), F.count_if((F.col("rho") > 0.25) & (F.col("r2") <= 0)).alias("demoted"),
              F.count_if(F.col("rho") > 0.15).alias("some"), F.min("vf").alias("vf"), F.min("width").alias("width"))
    fit, _ = rules.fit_gate([F.col("r")], [F.lit(0.0)])
    return a.select(fit.alias("gate_fit"), rules.view_gate(F.col("vf"), F.col("width")).alias("gate_view"),
                    rules.correlation_gate(F.col("strong"), F.col("demoted"), F.col("some")).alias("gate_correlation"))


@query("x10_fold_seed", f"""
WITH {TEL} SELECT session_id, event_type, CAST(('0x' || substr(sha256(session_id || '_' || event_type), 1, 8)) AS UBIGINT)::BIGINT AS seed, count(*) AS n FROM tel GROUP BY 1, 2""")
def x10(spark, sf):
    d = telemetry(spark, sf).groupBy("session_id", "event_type").agg(F.count("*").alias("n"))
    return d.select("session_id", "event_type", text_seed(F.concat_ws("_", "session_id", "event_type")).alias("seed"), "n")
