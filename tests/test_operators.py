"""Hand cases: ties, nulls, empty and single-row groups, hot keys, second formulations."""
import gzip
import hashlib
import math
import random
import re

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import Window, functions as F

from scanweave.functions import arrays, exprs, tails
from scanweave.operators import asof, cells, evaluation, models, quality, quantiles, rules, sampling, scans, sequence, signal, stats, timeline
from scanweave.sources import tables, text


def rows(df, *order):
    return [tuple(r) for r in (df.orderBy(*order) if order else df).collect()]


@pytest.fixture(scope="module")
def hot(spark):
    """Key 'a' holds most rows, among them many at one instant."""
    rng = random.Random(5)
    data = []
    for i in range(3000):
        key = "a" if i % 3 else rng.choice("bcd")
        us = 5_000_000 if i % 5 == 0 else rng.randrange(0, 20_000_000)
        data.append((i, key, us, rng.choice([None, 1.0, 2.0, 3.5]), rng.randrange(3)))
    return spark.createDataFrame(data, "id long, key string, us long, v double, lab long").cache()


def test_neighbours_equal_plain_window(hot):
    w = Window.partitionBy("key").orderBy("us", "id")
    want = hot.select("id", F.lag("v").over(w).alias("p"), F.lead("lab").over(w).alias("n"))
    got = timeline.neighbours(hot, ["key"], ["us", "id"], ["v", "lab"], exprs.time_bucket("us", 1.0), "prev next").select(
        "id", F.col("prev_v").alias("p"), F.col("next_lab").alias("n"))
    assert rows(got, "id") == rows(want, "id")


def test_islands_and_positions_equal_plain_window(hot):
    w = Window.partitionBy("key").orderBy("us", "id")
    d = hot.withColumn("c", F.when(F.col("lab").eqNullSafe(F.lag("lab").over(w)), 0).otherwise(1))
    want = d.select("id", F.sum("c").over(w).alias("i"), F.row_number().over(w).cast("long").alias("r"))
    chunk = exprs.time_bucket("us", 0.5)
    got = timeline.islands(hot, ["key"], ["us", "id"], "lab", chunk)
    got = timeline.row_position(got, ["key"], ["us", "id"], chunk).select("id", F.col("island").alias("i"), F.col("rn").alias("r"))
    assert rows(got, "id") == rows(want, "id")


def test_range_chunks_cut_inside_one_instant(hot):
    d = timeline.range_chunks(hot, ["key"], ["us", "id"], 12, "ck")
    assert d.filter("key = 'a' AND us = 5000000").select("ck").distinct().count() > 1
    w = Window.partitionBy("key").orderBy("us", "id")
    want = hot.select("id", F.row_number().over(w).cast("long").alias("r"))
    got = timeline.row_position(d, ["key"], ["us", "id"], "ck").select("id", F.col("rn").alias("r"))
    assert rows(got, "id") == rows(want, "id")


def test_last_known_both_ways(hot):
    w = Window.partitionBy("key").orderBy("us", "id")
    want = hot.select("id", F.last("v", True).over(w.rowsBetween(Window.unboundedPreceding, 0)).alias("a"),
                      F.first("v", True).over(w.rowsBetween(0, Window.unboundedFollowing)).alias("b"))
    ck = exprs.time_bucket("us", 1.0)
    got = timeline.last_known(hot, ["key"], ["us", "id"], "v", ck, "a")
    got = timeline.last_known(got, ["key"], ["us", "id"], "v", ck, "b", ahead=True).select("id", "a", "b")
    assert rows(got, "id") == rows(want, "id")


def test_asof_ties_tolerance_and_empty(spark):
    l = spark.createDataFrame([(1, "k", 1000), (2, "k", 5000), (3, "k", 99_000_000), (4, "z", 5)], "id long, k string, us long")
    r = spark.createDataFrame([(10, "k", 900), (11, "k", 900), (12, "k", 1100), (13, "k", 5100), (14, "k", 5100), (15, "k", 98_000_000)],
                              "rid long, k string, us long")
    got = asof.asof_nearest(l, r, ["k"], "us", "id", "rid", 1.0, keep_unmatched=True).select("id", "rid")
    # equal gaps take the earlier side, highest id there; lowest id on the later side; tolerance is inclusive
    assert rows(got, "id") == [(1, 11), (2, 13), (3, 15), (4, None)]
    assert asof.asof_nearest(l, r.limit(0), ["k"], "us", "id", "rid", 1.0).count() == 0


def test_asof_against_pandas_on_a_hot_key(spark):
    rng = np.random.default_rng(3)
    mk = lambda n, c: pd.DataFrame({c: np.arange(n), "k": np.where(rng.random(n) < 0.5, 0, rng.integers(1, 4, n)),
                                    "us": np.sort(rng.choice(40_000_000, n, replace=False))})
    l, r = mk(400, "id"), mk(300, "rid")
    want = pd.merge_asof(l, r.assign(t=r.us), on="us", by="k", direction="nearest", tolerance=200_000)
    got = asof.asof_nearest(spark.createDataFrame(l), spark.createDataFrame(r), ["k"], "us", "id", "rid", 0.2).select("id", "rid")
    assert rows(got, "id") == [(int(a), int(b)) for a, b in zip(want.id, want.rid) if not math.isnan(b)]
    for rows_each in (7, 60):  # hot keys in many parts
        cut = asof.asof_nearest(spark.createDataFrame(l), spark.createDataFrame(r), ["k"], "us", "id", "rid", 0.2, rows_each=rows_each).select("id", "rid")
        assert rows(cut, "id") == rows(got, "id")


def test_asof_tolerance_of_each_row_with_crowds_and_gaps(spark):
    rng = random.Random(5)
    spot = [0, 0, 10**6, 10**6 + 1, 5 * 10**9]  # crowds far apart, parts without a right row
    l = [(i, i % 2, rng.choice(spot) + rng.randrange(40), rng.choice([None, 0, 3, 10**7, 10**10])) for i in range(300)]
    r = [(i, i % 2, rng.choice(spot[:4]) + rng.randrange(40)) for i in range(200)]
    left, right = spark.createDataFrame(l, "id long, k int, us long, tol long"), spark.createDataFrame(r, "rid long, k int, us long")
    want = []
    for i, k, t, tol in l:
        near = [(abs(t - u), u > t, -j if u <= t else j, j) for j, kk, u in r if kk == k and tol is not None and abs(t - u) <= tol]
        want.append((i, min(near)[3] if near else None))
    for rows_each in (5, 40, 10**6):
        got = asof.asof_nearest(left, right, ["k"], "us", "id", "rid", F.col("tol"), rows_each=rows_each, keep_unmatched=True)
        assert rows(got.select("id", "rid"), "id") == want


def test_density_chunks_are_even_where_rows_crowd(spark):
    d = spark.range(40_000).select("id", (F.col("id") % 10 < 7).alias("hot"),
                                   F.when(F.col("id") % 5 < 4, F.col("id") % 100).otherwise(F.col("id") * 10**6).alias("us"))
    for keys, each in ((["hot"], 500), ([], 900)):
        c = timeline.density_chunks(d, keys, "us", "ck", each)
        n = [x["count"] for x in c.groupBy(*keys, "ck").count().collect()]
        assert sum(n) == 40_000 and max(n) <= 3 * each
        order = c.groupBy(*keys, "ck").agg(F.min("us").alias("a"), F.max("us").alias("z")).orderBy(*keys, "ck").collect()
        assert all(x.z < y.a for x, y in zip(order, order[1:]) if x.ck < y.ck)
    assert timeline.density_cuts(d.limit(0), ["hot"], "us") is None and timeline.density_cuts(d, ["hot"], "us", 10**6) is None


def test_interval_overlap_last_wins_and_bounds_are_closed(spark):
    from scanweave.operators.intervals import assign_last_span
    p = spark.createDataFrame([(i, "k", t) for i, t in enumerate([0, 10, 15, 20, 30, 31])], "id long, k string, us long")
    s = spark.createDataFrame([("k", 1, 10, 20), ("k", 2, 15, 30)], "k string, o int, a long, b long")
    got = assign_last_span(p, s, ["k"], "us", "a", "b", "o", ["o"], "id", 1.0).select("id", "o")
    assert rows(got, "id") == [(1, 1), (2, 2), (3, 2), (4, 2)]


def test_rolling_mean_crosses_chunks(spark):
    d = spark.createDataFrame([(i, "k", i * 300_000, float(i)) for i in range(20)], "id long, k string, us long, v double")
    got = rows(sequence.rolling_mean(d, ["k"], "us", "v", 0.6, "m", 3).select("id", "m"), "id")
    assert got == [(i, float(i) if i == 0 else i - 0.5) for i in range(20)]


def test_rolling_mean_against_brute_force_with_crowds_nulls_and_ties(spark):
    rng = random.Random(3)
    data = [(i, i % 2, rng.choice([0, 50_000, 10**6]) + rng.randrange(30) * 1000, rng.choice([None, 1e5, 0.1, -3.25, 1e-6])) for i in range(400)]
    d = spark.createDataFrame(data, "id long, k int, us long, v double")
    want = []
    for i, k, t, _ in data:
        w = [v for _, kk, u, v in data if kk == k and t - 20_000 < u <= t and v is not None]
        want.append((i, pytest.approx(math.fsum(w) / len(w), abs=1e-9) if w else None))
    for rows_each in (9, 10**6):
        got = sequence.rolling_mean(d, ["k"], "us", "v", 0.02, "m", rows_each).select("id", "m")
        assert rows(got, "id") == want
    assert sequence.rolling_mean(d.limit(0), ["k"], "us", "v", 0.02, "m").count() == 0


def test_sample_sends_only_rows_below_the_mark(spark):
    d = spark.range(60_000).select("id", (F.col("id") % 3 == 0).alias("g"))
    for keys in (["g"], []):
        want = rows(sampling.hash_rank(d, keys, "s", "id").filter("rn <= 200").select("id"), "id")
        assert rows(sampling.sample_exact(d, keys, "s", "id", 200).select("id"), "id") == want
        assert rows(sampling.sample_exact(d, keys, "s", "id", 200, most_keys=0).select("id"), "id") == want
    small = spark.createDataFrame([(1, None), (2, None), (3, True)], "id long, g boolean")
    assert rows(sampling.sample_exact(small, ["g"], "s", "id", 2).select("id"), "id") == [(1,), (2,), (3,)]
    plan = sampling.sample_exact(d, ["g"], "s", "id", 200)
    plan.collect()
    moved = [int(m) for m in re.findall(r"shuffle records written: (\d+)", plan._jdf.queryExecution().executedPlan().toString())]
    assert all(m < 2000 for m in moved)


def test_chunks_grow_in_number_with_the_rows(spark):
    from scanweave.plans.views import telemetry
    n = [timeline.density_chunks(telemetry(spark, f"/root/testdata/{sf}").select("session_id", "us"), ["session_id"], "us")
         .select("session_id", "_ck").distinct().count() for sf in ("sf0.01", "sf0.1")]
    assert n[1] >= 5 * n[0] >= 15


def test_folds_number_the_rows_of_a_group_once(spark):
    t = spark.range(1000).select("id", (F.col("id") % 2).alias("g"), (F.col("id") * 7 % 1000).alias("us"))
    f = spark.createDataFrame([("A", 0, "test", 1), ("A", 1, "train", 3), ("B", 1, "train", 1)], "fold string, g long, role string, keep_every int")
    got = sampling.group_out_folds(t, f, "g", "us", "id", F.lit(0))
    assert got._jdf.queryExecution().optimizedPlan().toString().count("Range (") == 2  # the rows and the chunks' sums
    n = {(r.fold, r.split): r["count"] for r in got.groupBy("fold", "split").count().collect()}
    assert n == {("A", "test"): 500, ("A", "train"): 150, ("A", "val"): 17, ("B", "train"): 450, ("B", "val"): 50}
    late = got.filter("fold = 'A' AND g = 1").groupBy("split").agg(F.min("us").alias("a"), F.max("us").alias("z")).collect()
    edge = {r.split: (r.a, r.z) for r in late}
    assert edge["train"][1] < edge["val"][0]


def test_backfill_only_before_first_value(spark):
    d = spark.createDataFrame([("k", 1, None), ("k", 2, 5.0), ("k", 3, None), ("e", 1, None)], "k string, t long, v double")
    assert rows(sequence.backfill_leading(d, ["k"], ["t"], "v").select("k", "t", "v"), "k", "t") == [
        ("e", 1, None), ("k", 1, 5.0), ("k", 2, 5.0), ("k", 3, None)]


def test_later_episode_overwrites_and_tail_is_after(spark):
    s = 1_000_000
    d = spark.createDataFrame([(i, "k", i * s, 0.5) for i in range(12)], "id long, k string, us long, speed double")
    ep = spark.createDataFrame([("k", 1 * s, 2 * s, "manual_reposition"), ("k", 4 * s, 5 * s, "manual_reposition")],
                               "k string, start_us long, end_us long, kind string")
    got = dict(rows(sequence.episode_mask(d, ep, ["k"], "us", "id", 5, 10, 0.3, 3.0).select("id", "anomaly_type")))
    assert got[0] == "" and got[1] == got[2] == "manual_reposition" and got[3] == "manual_reposition_post"
    assert got[4] == got[5] == "manual_reposition" and got[10] == "manual_reposition_post" and got[11] == ""


@pytest.mark.parametrize("n", [1, 2, 5, 30_000])
def test_quantiles_match_numpy(spark, n):
    rng = np.random.default_rng(n)
    v = np.round(rng.exponential(size=n), 3)
    v[: n // 3] = 1.0  # copies of one value hold a third
    d = spark.createDataFrame(pd.DataFrame({"k": 1, "v": v}))
    probs = {"a": 0.0, "b": 0.05, "c": 0.5, "d": 0.953, "e": 1.0}
    got = quantiles.exact_quantiles(d, ["k"], "v", probs).first()
    for name, p in probs.items():
        assert got[name] == pytest.approx(np.percentile(v, 100 * p), abs=1e-12)
    assert quantiles.exact_quantiles(d, [], "v", {"m": 0.5}).first().m == pytest.approx(np.median(v))


def test_quantiles_narrow_their_brackets(spark, monkeypatch):
    monkeypatch.setattr(quantiles, "ACCURACY", 400)
    monkeypatch.setattr(quantiles, "GRID", 40)
    narrowed = []
    one = quantiles._narrowed
    monkeypatch.setattr(quantiles, "_narrowed", lambda *a: (narrowed.append(1), one(*a))[1])
    d = spark.range(60_000).select((F.col("id") % 2).alias("k"), F.when(F.col("id") % 7 == 0, 3.5).otherwise(
        F.pmod(F.xxhash64("id"), F.lit(10**6)) / 7).alias("v"))
    probs = {"a": 0.001, "b": 0.5, "c": 0.9999, "d": 1.0}
    p = d.toPandas()
    for keys, groups in ((["k"], [p[p.k == i].v for i in (0, 1)]), ([], [p.v])):
        got = quantiles.exact_quantiles(d, keys, "v", probs, most=300).collect()
        got = sorted(got, key=lambda r: r[0]) if keys else got
        for r, g in zip(got, groups):
            for name, q in probs.items():
                assert r[name] == pytest.approx(np.percentile(g, 100 * q), abs=1e-9)
    assert narrowed
    assert quantiles.exact_quantiles(d.limit(0), ["k"], "v", probs).count() == 0
    assert quantiles.exact_quantiles(d.limit(0), [], "v", {"m": 0.5}).collect()[0].m is None


def test_quantiles_send_no_row_outside_the_brackets(spark):
    d = spark.range(200_000).select((F.col("id") * 7919 % 200_000).cast("double").alias("v"))
    plan = quantiles.exact_quantiles(d, [], "v", {"m": 0.5})
    assert plan.first().m == 99_999.5
    text = plan._jdf.queryExecution().executedPlan().toString()
    assert "partial_count" in text and text.count("Range (") == 1  # one reading after the brackets, folded before it moves


def test_a_missed_rank_is_an_error(spark, monkeypatch):
    d = spark.range(30_000).select(F.col("id").cast("double").alias("v"))
    whole = F.percentile_approx
    monkeypatch.setattr(quantiles.F, "percentile_approx", lambda c, e, a: F.transform(whole(c, e, a), lambda x: x + 100.0))
    with pytest.raises(Exception, match="outside its bracket"):
        quantiles.exact_quantiles(d, [], "v", {"m": 0.5}).collect()


def test_average_ranks_match_pandas(spark, monkeypatch):
    v = np.random.default_rng(1).integers(0, 400, 5000).astype(float)
    d = spark.createDataFrame(pd.DataFrame({"k": 1, "v": v})).groupBy("k", "v").count()
    want = pd.Series(v).rank()
    for least in (4096, 16):  # one part, many parts
        monkeypatch.setattr(timeline, "LEAST_ROWS", least)
        got = dict(rows(quantiles.average_ranks(d, ["k"], "v", "count", "r").select("v", "r")))
        assert all(got[x] == r for x, r in zip(v, want))


def test_spearman_with_ties_and_nulls(spark):
    p = pd.DataFrame({"k": 1, "x": [1, 2, 2, 3, 5, None], "y": [2.0, 1, 4, 4, 9, 3]})
    q = p.dropna()
    got = stats.spearman(spark.createDataFrame(p.astype(object).where(p.notna(), None), "k long, x double, y double"), ["k"], "x", "y").first()
    assert got.n == 5 and got.rho == pytest.approx(q.x.rank().corr(q.y.rank()))


def test_radius_anti_join_against_brute_force(spark):
    rng = np.random.default_rng(8)
    a = pd.DataFrame({"id": range(600), "k": 1, "x_m": rng.random(600) * 12 - 6, "y_m": rng.random(600) * 12 - 6})
    b = pd.DataFrame({"k": 1, "x_m": rng.random(40) * 12 - 6, "y_m": rng.random(40) * 12 - 6})
    d2 = (a.x_m.to_numpy()[:, None] - b.x_m.to_numpy()) ** 2 + (a.y_m.to_numpy()[:, None] - b.y_m.to_numpy()) ** 2
    want = [(int(i),) for i in a.id[(d2 > 1.0).all(axis=1)]]
    assert rows(cells.outside_radius(spark.createDataFrame(a), spark.createDataFrame(b), ["k"], 1.0).select("id"), "id") == want


def test_semivariogram_folds_positions(spark):
    rng = np.random.default_rng(4)
    p = pd.DataFrame({"k": 1, "x_m": rng.integers(-8, 8, 300) / 2, "y_m": rng.integers(0, 8, 300) / 2, "s": rng.random(300)})
    i, j = np.triu_indices(300, 1)
    dist = np.hypot(p.x_m.to_numpy()[i] - p.x_m.to_numpy()[j], p.y_m.to_numpy()[i] - p.y_m.to_numpy()[j])
    sq = (p.s.to_numpy()[i] - p.s.to_numpy()[j]) ** 2
    for r in cells.semivariogram(spark.createDataFrame(p), ["k"], "s", [0.5, 1.0, 3.0]).collect():
        m = (dist >= 0.75 * r.lag) & (dist <= 1.25 * r.lag)
        assert r.n_pairs == m.sum() and r.gamma == pytest.approx(sq[m].mean() / 2)


def test_cross_correlation_finds_the_shift_and_ignores_block_size(spark):
    rng = np.random.default_rng(2)
    b = rng.normal(size=400)
    a = np.roll(b, 7)
    d = spark.createDataFrame(pd.DataFrame({"g": "x", "k": np.arange(400), "z_a": a, "z_b": b}))
    big = signal.cross_correlation(d, ["g"], 20, 4096)
    small = signal.cross_correlation(d, ["g"], 20, 40)
    x, y = rows(big, "lag"), rows(small, "lag")
    assert [r[:2] for r in x] == [r[:2] for r in y] and np.allclose([r[2] for r in x], [r[2] for r in y])
    p = signal.peak(big, ["g"], 3).first()
    assert p.lag == 7 and p.rho > 0.9 and 0 < p.prominence <= 1
    want = np.dot(a[13:], b[:-13]) / 400 / a.std() / b.std()
    assert dict((r[1], r[2]) for r in x)[13] == pytest.approx(want)


def test_pooling_matches_published_numbers(spark):
    d = spark.createDataFrame([(0.2504, 0.2388), (0.4324, 0.1610), (0.8788, 0.1235)], "t double, s double")
    r = signal.pooled(d, [], "t", "s").first()
    assert r.tau_bar == pytest.approx(0.647, abs=1e-3) and r.q == pytest.approx(8.06, abs=0.01) and r.i2 == pytest.approx(75.2, abs=0.05)
    assert signal.pooled(d.limit(1), [], "t", "s").count() == 0


def test_tail_probabilities(spark):
    """Upper 5 % points from tables, for small and very large degrees of freedom."""
    chi = [(3.841458821, 1, 0.05), (5.991464547, 2, 0.05), (18.307038053, 10, 0.05), (553.1268, 500, 0.05), (100736.6, 100_000, 0.05),
           (0.0, 7, 1.0), (499.0, 499, 0.4916), (199.0, 199, 0.4867)]
    t = [(12.7062047, 1, 0.05), (2.228138852, 10, 0.05), (1.9647198, 500, 0.05), (1.95998, 100_000, 0.05), (1.959964, 10**12, 0.05), (0.0, 5, 1.0)]
    rows = spark.createDataFrame([(float(x), d, p) for x, d, p in chi], "x double, d long, p double").select("p", tails.chi2_upper("x", "d").alias("got")).collect()
    assert all(r.got == pytest.approx(r.p, abs=1e-4) for r in rows), rows
    rows = spark.createDataFrame([(float(x), d, p) for x, d, p in t], "x double, d long, p double").select("p", tails.t_two_sided("x", "d").alias("got")).collect()
    assert all(r.got == pytest.approx(r.p, abs=1e-5) for r in rows), rows


def test_resampling_weights_of_distant_ids(spark):
    """The task-side weights are those of the SQL; ids a prime apart share no numbers."""
    ids = [5, 5 + stats.PRIME, 5 + 2 * stats.PRIME, 2**40 + 17]
    sql = stats.with_replicates(spark.createDataFrame([(i,) for i in ids], "id long"), "id", 300, 3).toPandas()
    own = stats.resampling_weights(np.array(ids), 300, 3)
    for k, i in enumerate(ids):
        assert sql[sql.id == i].sort_values("rep").w.tolist() == own[k].tolist()
    assert all(abs(np.corrcoef(own[a], own[b])[0, 1]) < 0.25 for a in range(4) for b in range(a))


def test_replicate_sums_equal_exploded_rows(spark):
    d = spark.range(500).selectExpr("id", "IF(id % 3 = 0, NULL, id % 2) AS k", "IF(id % 7 = 0, NULL, CAST(id AS DOUBLE)) AS v")
    want = {(r.k, r.rep): (r.w, r.v) for r in stats.with_replicates(d, "id", 20, 9).groupBy("k", "rep").agg(F.sum("w").alias("w"), F.sum(F.col("w") * F.col("v")).alias("v")).collect()}
    got = {(r.k, r.rep): (r.w, r.v) for r in stats.replicate_sums(d, ["k"], "id", ["v"], 20, 9).collect()}
    assert got == want


def test_roc_of_any_thresholds_and_histogram_bounds(spark):
    d = spark.createDataFrame([(10.0, True), (10.1, True), (10.2, False), (11.0, False)], "s double, t boolean")
    got = [(r.t, r.tpr, r.fpr) for r in stats.roc_sweep(d, "s", "t", [10.3, 10.1]).orderBy("t").collect()]
    assert got == [(10.1, 0.5, 0.0), (10.3, 1.0, 0.5)]
    with pytest.raises(Exception, match="outside"):
        stats.value_histogram(d, "s", 0, 10).collect()



def test_bootstrap_weights_behave_like_poisson(spark):
    d = stats.with_replicates(spark.range(4000), "id", 25, 3)
    r = d.agg(F.avg("w").alias("m"), F.var_pop("w").alias("v")).first()
    assert r.m == pytest.approx(1, abs=0.02) and r.v == pytest.approx(1, abs=0.04)
    p = d.groupBy("id").pivot("rep", [1, 2, 17]).agg(F.first("w"))
    for a, b in (("1", "2"), ("1", "17"), ("2", "17")):
        assert abs(p.select(F.corr(a, b)).first()[0]) < 0.05
    nxt = d.select((F.col("id") + 1).alias("id"), "rep", F.col("w").alias("w2"))
    assert abs(d.join(nxt, ["id", "rep"]).select(F.corr("w", "w2")).first()[0]) < 0.03


def test_splits_and_rounding(spark):
    d = spark.createDataFrame([("a", i, i) for i in range(25)] + [("b", 0, 100), ("b", 1, 101)], "k string, us long, id long")
    s = sampling.tail_split(d, ["k"], ["us", "id"], exprs.time_bucket("us", 1e-5), 0.10)
    # 2.5 rounds half to even; a key always keeps one row on each side
    assert {(r.k, r.split): r["count"] for r in s.groupBy("k", "split").count().collect()} == {
        ("a", "train"): 23, ("a", "val"): 2, ("b", "train"): 1, ("b", "val"): 1}
    assert rows(sampling.decimate(d, ["k"], ["us"], F.lit(0), 10).select("k", "us"), "k", "us") == [("a", 0), ("a", 10), ("a", 20), ("b", 0)]


def test_block_shuffle_keeps_block_together(spark):
    d = spark.createDataFrame([("g", i, float(i), 10.0 * i, -i) for i in range(200)], "g string, id long, a double, b double, y int")
    s = sampling.block_shuffle(d, ["g"], "s", "id", ["a", "b"])
    r = s.collect()
    assert len(r) == 200 and all(x.b == 10 * x.a and x.y == -x.id for x in r)
    assert sorted(x.a for x in r) == [float(i) for i in range(200)] and any(x.a != x.id for x in r)


def test_equal_chunks_sizes(spark):
    d = spark.createDataFrame([(i, 1.0 if i < 5 else i / 10) for i in range(13)], "id long, v double")
    c = sampling.equal_chunks(d, "v", "id", 5).groupBy("part").count()
    assert rows(c, "part") == [(1, 3), (2, 3), (3, 3), (4, 2), (5, 2)]


def test_sample_exact_is_exact_and_stable(spark):
    d = spark.range(1000).withColumn("g", F.col("id") % 2)
    a = rows(sampling.sample_exact(d, ["g"], "s", "id", 70).select("id"), "id")
    b = rows(sampling.sample_exact(d.repartition(13), ["g"], "s", "id", 70).select("id"), "id")
    assert len(a) == 140 and a == b


def test_array_features_on_empty_and_single(spark):
    d = spark.createDataFrame([(1, [0, 65535, 0]), (2, [0, 500, 65535]), (3, [100, 200, 300])], "id int, distances array<int>")
    v = arrays.readings("distances")
    got = rows(d.select("id", arrays.array_mean(v), arrays.array_quantile(F.array_sort(v), 0.9), arrays.share(v, lambda x: x < 250)), "id")
    assert got == [(1, None, None, None), (2, 500.0, 500.0, 0.0), (3, 200.0, 280.0, pytest.approx(2 / 3))]


def test_wrap_and_bins(spark):
    d = spark.createDataFrame([(math.pi, -0.1), (-math.pi, 0.0), (7.0, 0.5)], "a double, x double")
    got = rows(d.select(exprs.wrap_angle("a"), exprs.cell("x", 0.5)))
    assert got[0] == (pytest.approx(-math.pi), -1) and got[1] == (pytest.approx(-math.pi), 0) and got[2] == (pytest.approx(7 - 2 * math.pi), 1)


def test_ragged_files_with_bad_bytes(spark, tmp_path):
    (tmp_path / "a.csv").write_bytes(b"warm\n\n2024-01-01 00:00:00,1,2,True,5\n2024-01-01 00:00:01,False,6\n2024-01-01 00:00:02,\xff\xfe,7\n")
    d = text.read_lines(spark, str(tmp_path))
    p = text.parse_ragged(d, {5: ["ts", "w1", "w2", "flag", "a"], 3: ["ts", "flag", "a"]})
    got = {r.ts[-2:]: (r.file, r.w1, r.flag, r.a) for r in p.collect()}
    assert set(got) == {"00", "01", "02"} and got["00"] == ("a.csv", "1", "True", "5") and got["01"] == ("a.csv", None, "False", "6")
    assert rows(text.width_census(d, [], [5, 3]), "n_fields") == [(1, 1, False), (3, 2, True), (5, 1, True)]


def test_types_by_value_domain(spark):
    d = spark.createDataFrame([("True", "1", "x"), ("", "NaN", None), (None, " 2.5 ", "")], "f string, n string, o string")
    t = text.coerce_types(d, ["f", "n", "o"])
    assert [f.dataType.simpleString() for f in t.schema] == ["boolean", "double", "double"]
    assert rows(t) == [(True, 1.0, None), (False, None, None), (False, 2.5, None)]


def test_constant_columns(spark):
    d = spark.createDataFrame([(1, 7, None, 1), (2, 7, None, None)], "a int, b int, c int, d int")
    assert text.constant_columns(d) == {"b": 7, "c": None}


def test_unexpected_category_and_double_key_fail(spark):
    d = spark.createDataFrame([(1, "a"), (1, "b")], "k int, c string")
    with pytest.raises(ValueError):
        tables.route(d, "c", {"x": ["a"]})
    with pytest.raises(ValueError):
        quality.unique_join(d, d, "k")


def test_digest_ignores_order_and_sees_changes(spark):
    d = spark.range(100).withColumn("v", F.col("id") * 2)
    dig = lambda x: rows(tables.table_digest(x, [], ["id", "v"]))
    assert dig(d) == dig(d.orderBy(F.desc("id")).repartition(7)) != dig(d.withColumn("v", F.when(F.col("id") == 5, 0).otherwise(F.col("v"))))


def test_file_digests_of_files_longer_than_a_row_may_be(spark, tmp_path):
    noise = random.Random(3).randbytes(9_000)
    files = {"noise.bin": noise, "ends.bin": noise[:4_999] + b"\n", "feeds.bin": b"\n" * 5_000, "returns.bin": b"a\r\n\r\n\r" * 700, "one_line.bin": b"\0" * 7_000,
             "mark.txt": b"\xef\xbb\xbf" + noise[:3_000], "mark_ends.txt": b"\xef\xbb\xbf" * 2 + noise[:3_000] + b"\n\n", "odd[1]*{a} %20ü.bin": noise[5:4_000],
             "just.bin": noise[:2_000], "over.bin": noise[:2_001], "small.bin": noise[:5]}
    for name, data in files.items():
        (tmp_path / name).write_bytes(data)
    want = sorted((name, len(data), hashlib.sha256(data).hexdigest()) for name, data in files.items())
    limit = "spark.sql.sources.binaryFile.maxLength"
    spark.conf.set(limit, 2_000)  # stands for the 2 GB that a row holds
    try:
        assert rows(tables.file_digests(spark, str(tmp_path), block=2_000), "file") == want
    finally:
        spark.conf.unset(limit)
    (tmp_path / "noise.gz").write_bytes(gzip.compress(noise))
    assert rows(tables.file_digests(spark, str(tmp_path / "noise.gz"), block=2_000))[0][2] == hashlib.sha256((tmp_path / "noise.gz").read_bytes()).hexdigest()


def test_metrics_of_constant_target(spark):
    d = spark.createDataFrame([("f", 1.0, 2.0, True), ("f", 1.0, 0.0, True)], "fold string, y double, p double, in_view boolean")
    r = {x.stratum: x for x in evaluation.stratified_metrics(d, ["fold"]).collect()}
    assert set(r) == {"overall", "in_view"} and r["overall"].r2 is None and r["overall"].rmse == 1.0 and r["overall"].bias == 0.0


def test_rules(spark):
    d = spark.createDataFrame([(1.0, 2.0, 2.0), (1.0, 1.2, 3.0), (1.0, 3.0, 1.1), (1.0, 0.0, 0.0), (None, 1.0, 1.0)], "f double, a double, b double")
    got = [r[0] for r in d.select(rules.removable(F.col("f"), F.col("a"), F.col("b"), 0.5)).collect()]
    assert got == ["complementary", "scan_removable", "geometry_removable", "unclear", "incomplete"]


def test_verdict_rules(spark):
    def one(verdict, *values):
        row = spark.createDataFrame([values], ", ".join(f"c{i} double" for i in range(len(values))))
        return row.select(verdict(*[F.col(c) for c in row.columns])).first()[0]
    settings = lambda *g: rules.settings_verdict(list(g))
    assert [one(settings, *v) for v in ((0.5, 0.5, -1.0), (0.4, 0.5, 1.0), (0.4, 0.5, None))] == ["GREEN", "GREEN", "RED"]
    assert [one(rules.control_verdict, *v) for v in ((1.0, 0.5), (1.0, 0.7), (0.1, 0.1))] == ["REAL_SIGNAL", "MARGINAL_DISTRIBUTION_DRIVEN", "NOT_SIGNAL"]
    framework = lambda *g: rules.framework_verdict(list(g))
    assert [one(framework, *v) for v in ((0.5, -1.0), (-0.1, -0.2), (0.1, -0.2), (-0.1, None))] == [
        "FRAMEWORK_ROBUST", "FRAMEWORK_FRAGILE", "FRAMEWORK_PARTIAL", "FRAMEWORK_PARTIAL"]
    pivot = lambda *g: rules.pivot_verdict(list(g[:3]), list(g[3:]), list(g[1:3]))
    assert [one(pivot, *v) for v in ((0.0, 1.1, 0.0, 0.0, 0.0), (0.0, 0.6, 0.0, 1.2, 0.0), (0.0, 0.8, 0.0, 1.2, 0.0), (1.0, 1.0, 1.0, 0.4, 0.2))] == [
        "RECOVERABLE_HYPERPARAMS", "RECOVERABLE_VALIDATION_PROTOCOL", "PIVOT_JUSTIFIED", "PIVOT_JUSTIFIED"]
    assert [one(rules.within_verdict, float(n)) for n in (0, 1, 2, 3, 5)] == ["WITHIN-SESSION-NULL", "MIXED", "MIXED", "WITHIN-SESSION-HELPS", "WITHIN-SESSION-HELPS"]
    exemplar = lambda *g: rules.exemplar_verdict(list(g))
    assert [one(exemplar, *v) for v in ((0.5, 0.5), (0.4, 0.5), (0.1, None))] == ["R-4 IS A ROBUST EXEMPLAR", "R-4 IS PARTIALLY ROBUST", "R-4 IS ILLUSORY"]


def test_mixture_finds_two_modes(spark):
    rng = np.random.default_rng(0)
    v = np.round(np.r_[rng.normal(20, 4, 3000), rng.normal(80, 6, 5000)]).clip(0, 100)
    h = stats.value_histogram(spark.createDataFrame(pd.DataFrame({"v": v})), "v", 0, 100).filter("c > 0").cache()
    fit = stats.mixture_crossover(stats.mixture_em(h, "v" if "v" in h.columns else "bin", "c")).first()
    assert fit.mu0 == pytest.approx(20, abs=1) and fit.mu1 == pytest.approx(80, abs=1) and fit.steps < 200
    assert fit.sd0 == pytest.approx(4, abs=0.5) and fit.pi0 == pytest.approx(3 / 8, abs=0.02) and fit.pi0 + fit.pi1 == pytest.approx(1)
    assert 30 < fit.threshold < 60
    assert stats.mixture_em(h.limit(0), "bin", "c").count() == 0
    s = stats.histogram_saddle(stats.value_histogram(spark.createDataFrame(pd.DataFrame({"v": v})), "v", 0, 100), 0, 100).first()
    assert 25 < s.saddle < 70


def test_contributions_sum_and_symmetry(spark):
    rng = np.random.default_rng(6)
    p = pd.DataFrame({"id": range(400), "a": rng.random(400), "b": rng.random(400)})
    p["y"] = 3 * (p.a > 0.5) + 2 * (p.b > 0.3)
    p["split"] = np.where(p.id % 5 == 0, "val", "train")
    d = spark.createDataFrame(p)
    m = models.fit_booster(d, ["a", "b"], "y", models.Settings(depth=2, step=0.5, rounds=4, row_share=1.0))
    c = models.contributions(m, d, ["a", "b"], "y", ["id"]).toPandas()
    assert np.allclose(c.bias + c.c_a + c.c_b, c.p, atol=1e-9)
    assert c.c_a[p.a > 0.5].mean() > c.c_a[p.a <= 0.5].mean() + 2


def test_regions_fall_back_to_axis(spark):
    d = spark.createDataFrame([(i, float(i), 0.1 * (i % 3)) for i in range(50)], "id long, x_m double, y_m double")
    r, how = models.build_regions(d, 5, 5, "id", [1])
    assert how in ("kmeans", "principal_axis") and r.select("region_id").distinct().count() == 5
    r, how = models.build_regions(d, 5, 1000, "id", [1])
    assert how == "principal_axis" and sorted(x["count"] for x in r.groupBy("region_id").count().collect()) == [10] * 5


def test_bitmaps_count_slots_over_words_masks_and_wraps(spark):
    rng = random.Random(2)
    beams = arrays.Beams(-180.0, 2.0, 180)  # three words, the whole circle
    data = [(i, [rng.choice([0, 65535, 200, 900, 1500]) for _ in range(190)], rng.uniform(-180, 180)) for i in range(60)]
    usable = [rng.random() < 0.8 for _ in range(190)]
    d = spark.createDataFrame(data, "id long, distances array<int>, deg double").withColumn("bearing", F.radians("deg")).withColumn("in_view", F.lit(True))
    for mask in (None, usable):
        for limits in (None, (-50.0, 174.0)):
            b = scans.scan_bitmaps(d, beams, 1000, mask)
            got = rows(scans.near_share_toward(b, beams, 33.0, "s", limits).select("id", F.round("s", 9).alias("s")), "id")
            for (i, mm, deg), (_, s) in zip(data, got):
                cone = [mm[k] for k in range(180) if (mask is None or mask[k]) and mm[k] not in (0, 65535)
                        and abs((-180 + 2 * k - deg + 180) % 360 - 180) <= 33 and (limits is None or limits[0] <= -180 + 2 * k <= limits[1])]
                assert s == (round(sum(x < 1000 for x in cone) / len(cone), 9) if cone else None)
    w = spark.range(1).select(arrays.bits_between(arrays.mask_words([True] * 130), F.lit(60), F.lit(129)).alias("a"),
                              arrays.bits_between(arrays.mask_words([True] * 130), F.lit(5), F.lit(4)).alias("b")).first()
    assert w.a == 70 and w.b == 0


def test_sector_bounds_are_half_open_but_the_last():
    b = arrays.Beams(-10.0, 5.0, 5)
    assert b.sector_slots([(-10, 0), (0, 10)]) == [(0, 1), (2, 4)] and b.sector_slots([(-90, -20), (-10, -10)]) == [(0, -1), (0, 0)]


def test_early_stop_ends_a_fit_before_its_bound(spark):
    d = spark.range(3000).select("id", (F.col("id") % 17).cast("double").alias("a"), (F.col("id") % 5).cast("double").alias("b"),
                                 F.when(F.col("id") % 10 == 0, "val").otherwise("train").alias("split"))
    d = d.withColumn("y", F.col("a") * 2 + F.col("b") ** 2 + F.pmod(F.xxhash64("id"), F.lit(100)) / 50).cache()
    m = models.fit_booster(d, ["a", "b"], "y", models.Settings(depth=4, step=0.2, rounds=500, row_share=1.0))
    assert 5 < m.stages[-1].getNumTrees < 100
    p = models.ablation(d.withColumn("fold", F.lit("f")).withColumn("split", F.when(F.col("id") % 7 == 0, "test").otherwise(F.col("split"))),
                        ["f"], {"one": ["a"], "two": ["a", "b"]}, "y", ["id"], {"x": models.Settings(3, 0.3, 500, 1.0)})
    r = {x.variant: x.e for x in p.groupBy("variant").agg(F.sqrt(F.avg(F.col("residual") ** 2)).alias("e")).collect()}
    assert r["two"] < 1.5 < 4 < r["one"]


def test_equal_chunks_of_one_value_have_even_tasks(spark):
    d = spark.range(30_000).select("id", F.lit(1.5).alias("v"))
    c = timeline.density_chunks(d, [], "v", "ck", 1000, tie="id")
    n = [r["count"] for r in c.groupBy("ck").count().collect()]
    assert sum(n) == 30_000 and max(n) <= 2000
    mixed = spark.range(20_000).select("id", F.when(F.col("id") % 2 == 0, 0.5).otherwise(F.col("id") / 20_000).alias("v"))
    got = rows(sampling.equal_chunks(mixed, "v", "id", 7, 700).select("id", "part"), "id")
    p = mixed.toPandas().sort_values(["v", "id"]).reset_index(drop=True)
    want = sorted((int(i), k + 1) for k, part in enumerate(np.array_split(p.id.to_numpy(), 7)) for i in part)
    assert got == want


def test_many_starts_of_kmeans_fold_positions(spark):
    rng = np.random.default_rng(4)
    xy = np.concatenate([rng.normal(c, 0.3, (200, 2)).round(1) for c in ((0, 0), (5, 1), (2, 8))])
    got = models.kmeans_centroids(spark.createDataFrame(pd.DataFrame(xy, columns=["x_m", "y_m"])), 3, list(range(1, 11)))
    assert [k for k, _, _ in got] == [1, 2, 3]
    assert np.allclose([[x, y] for _, x, y in got], sorted(xy[i:i + 200].mean(axis=0).tolist() for i in (0, 200, 400)), atol=1e-6)
