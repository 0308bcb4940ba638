"""Registered queries on small tables of odd shape, against their SQL."""
import datetime

import numpy as np
import pytest

import __spark_entry__ as entry
from check import canon

QUERIES, SQL = entry.queries(), entry.oracle_sql()
DAY0 = datetime.datetime(2024, 1, 1)


@pytest.fixture
def folder(spark, tmp_path):
    """Writes ``events`` of (event_id, seconds, user_id, value) into a folder of its own."""
    def make(rows):
        data = [(i, DAY0 + datetime.timedelta(seconds=s), u, "view", float(v), "{}") for i, s, u, v in rows]
        schema = "event_id long, ts timestamp_ntz, user_id long, event_type string, value double, props string"
        spark.createDataFrame(data, schema).coalesce(1).write.parquet(f"{tmp_path}/events.parquet")
        return str(tmp_path)
    return make


def both(spark, name, sf):
    """Rows of the query and of its SQL."""
    import duckdb
    con = duckdb.connect()
    con.execute(f"CREATE VIEW events AS SELECT * FROM '{sf}/events.parquet/*.parquet'")
    df = QUERIES[name](spark, sf)
    cur = con.execute(SQL[name])
    return canon(df.columns, [tuple(r) for r in df.collect()]), canon([d[0] for d in cur.description], cur.fetchall())


def test_flags_at_a_threshold_do_not_hang_on_rounding(spark, folder):
    """0.8 - 0.7 is 0.1 and a bit in doubles; the rule says more than 0.1."""
    got, want = both(spark, "f15_quality_flags", folder([(0, 0, 1, 80), (1, 50, 1, 70), (2, 0, 2, 80), (3, 50, 2, 69.9)]))
    flags = {r[1]: r[0] for r in got}
    assert got == want and "halves_disagree" not in flags[1] and "halves_disagree" in flags[2]


def test_motion_signature_of_a_dense_session(spark, folder):
    """A session without a gap of a minute has no rate and no cap; its rows stay."""
    got, want = both(spark, "w11_motion_signature", folder([(i, i, 0, i) for i in range(9)] + [(9 + i, 100 * i, 1, i) for i in range(9)]))
    assert got == want and len(got) == 18


def test_an_id_under_several_keys_is_drawn_once(monkeypatch):
    from scanweave.operators import stats
    drawn, plain = [], stats.resampling_weights
    monkeypatch.setattr(stats, "resampling_weights", lambda ids, *a: drawn.extend(ids) or plain(ids, *a))
    ids, group = np.repeat(np.arange(700), 4), np.tile(np.arange(4), 700)
    values = np.random.default_rng(3).normal(size=(2800, 2))
    got = stats.drawn_sums(ids, group, values, 4, 20, 9).reshape(20, 4, 2)
    assert len(drawn) == 700
    for k in range(4):
        assert np.allclose(got[:, k], plain(np.arange(700), 20, 9).T @ values[group == k])


def test_equal_chunks_move_no_rows(spark):
    """Crowded values, nulls, infinities and few rows: as a plain ntile, by a plan without an exchange of rows."""
    from pyspark.sql import Window, functions as F
    from scanweave.operators import sampling
    odd = {3: None, 5: float("inf"), 6: float("-inf"), 8: None, 9: 0.5}
    for n in (0, 1, 3, 6, 7, 2000):
        data = [(i * 7919 % 10007, odd.get(i, float(i * i % 11))) for i in range(n)]
        d = spark.createDataFrame(data, "id long, v double").coalesce(1)
        plan = sampling.equal_chunks(d, "v", "id", 7, 50)
        want = d.withColumn("part", F.ntile(7).over(Window.orderBy(F.coalesce("v", F.lit(float("-inf"))), "id")))
        assert sorted(map(tuple, plan.select("id", "part").collect())) == sorted(map(tuple, want.select("id", "part").collect()))
        assert "Exchange" not in plan._jdf.queryExecution().executedPlan().toString()


def test_rank_correlation_by_stratum_multiplies_no_rows(spark, monkeypatch):
    """As the plain one on rows repeated by stratum and feature; what is stored has a row a row."""
    from pyspark.sql import functions as F
    from scanweave.operators import stats
    rng = np.random.default_rng(2)
    n = 12_000
    pick = lambda v: None if rng.random() < 0.1 else float(v)
    data = [("a" if i % 3 else "b", pick(rng.integers(0, 40)), pick(rng.normal()), pick(round(rng.normal(), 2 if i % 2 else 9))) for i in range(n)]
    d = spark.createDataFrame(data, "k string, u double, v double, y double").cache()
    where = {"all": F.lit(True), "low": F.col("u") < 20, "none": F.col("u") > 99}
    sizes, plain = [], stats.stored
    monkeypatch.setattr(stats, "stored", lambda f: sizes.append(f.count()) or plain(f))
    got = {r[:3]: r[3:] for r in map(tuple, stats.spearman_by_stratum(d, ["k"], where, {"u": "u", "v": "v"}, "y").collect())}
    assert max(sizes) <= n + 41 * 2
    long = d.select("k", "y", F.explode(F.array(*[F.when(c, s) for s, c in where.items()])).alias("s"), "u", "v").filter("s IS NOT NULL")
    long = long.select("k", "y", "s", F.inline(F.array(*[F.struct(F.lit(f).alias("f"), F.col(f).alias("x")) for f in "uv"])))
    want = {r[:3]: r[3:] for r in map(tuple, stats.spearman(long, ["k", "s", "f"], "x", "y").collect())}
    assert got.keys() == want.keys() and len(got) == 8
    assert all(a[0] == want[k][0] and abs(a[1] - want[k][1]) < 1e-9 for k, a in got.items())


def regions_of(spark, tmp_path, balance):
    """Query and SQL of the region build on 30,000 customers with the given balance."""
    import duckdb
    spark.range(30_000).selectExpr("id AS c_custkey", f"{balance} AS c_acctbal").coalesce(1).write.parquet(f"{tmp_path}/customer.parquet")
    con = duckdb.connect()
    con.execute(f"CREATE VIEW customer AS SELECT * FROM '{tmp_path}/customer.parquet/*.parquet'")
    df = QUERIES["m08_region_build_with_fallback"](spark, str(tmp_path))
    cur = con.execute(SQL["m08_region_build_with_fallback"])
    return canon(df.columns, [tuple(r) for r in df.collect()]), canon([d[0] for d in cur.description], cur.fetchall())


@pytest.mark.parametrize("balance, method, rows", [
    ("if(id % 1000 = 7, null, (id % 5) * 2500.25D - 600)", "kmeans", 6),  # a group below 0, rows without a balance
    ("if(id % 1000 = 7, null, if(id < 29000, id % 9, 9000 + id % 7) * 1D)", "principal_axis", 5)])
def test_regions_of_many_customers_as_in_sql(spark, tmp_path, balance, method, rows):
    got, want = regions_of(spark, tmp_path, balance)
    assert got == want and len(got) == rows and all(method in map(str, r) for r in got)


def test_kmeans_does_not_hang_on_the_order_of_rows(spark):
    from pyspark.sql import functions as F
    from scanweave.operators import models
    d = spark.range(4000).select((F.col("id") * 7919 % 4001 / 37).alias("x_m"), (F.col("id") * 31 % 97 / -7).alias("y_m"))
    odd = spark.createDataFrame([(None, 1.0), (float("nan"), 1.0), (1.0, float("inf"))], "x_m double, y_m double")
    got = models.kmeans_centroids(d, 4, [1, 2, 3])
    assert len(got) == 4 and got == models.kmeans_centroids(d.unionByName(odd).orderBy("y_m").repartition(13), 4, [1, 2, 3])
    assert models.kmeans_centroids(odd, 4, [1]) == [] and len(models.kmeans_centroids(d.limit(3), 4, [1])) == 3


def test_settings_sweep_is_one_list_of_fits_on_stored_rows(spark, monkeypatch):
    """No fit waits for a group of others, and none works out its rows again at each reading."""
    from scanweave.plans import modelling
    seen, plain = [], modelling.fit_points
    monkeypatch.setattr(modelling, "fit_points", lambda points, *a: seen.append(points) or plain(points[:1], *a))
    QUERIES["m05_settings_sweep_and_buffer"](spark, "/root/testdata/sf0.001")
    (points,) = seen
    rows = {labels["config"]: d for labels, d, _, _ in points}
    assert set(rows) == {"main", "shallow", "slow", "sampled", "main_randval", "shallow_randval", "buffer", "placebo"}
    assert all("Exchange" not in d._jdf.queryExecution().executedPlan().toString() for d in rows.values())
    ids = {c: sorted(map(tuple, d.select("joint_idx").collect())) for c, d in rows.items()}
    assert ids["main"] == ids["main_randval"] == ids["placebo"] and set(ids["buffer"]) < set(ids["main"])
