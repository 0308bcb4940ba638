"""Uniform grids, cross-correlation, peaks, block bootstrap, pooling."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window, functions as F

from scanweave.functions.exprs import clip, col, hash_unit, time_bucket
from scanweave.operators.timeline import last_known, neighbours
from scanweave.session import stored


def grid_bounds(a: DataFrame, b: DataFrame, keys: list[str], us: str, step_s: float) -> DataFrame:
    """Common time range of two streams: start and number of grid points."""
    def ends(d, p):
        return d.groupBy(*keys).agg(F.min(us).alias(f"{p}0"), F.max(us).alias(f"{p}1"))
    step = int(round(step_s * 1_000_000))
    return (ends(a, "a").join(ends(b, "b"), keys)
            .withColumn("lo_us", F.greatest("a0", "b0")).withColumn("hi_us", F.least("a1", "b1"))
            .withColumn("n_grid", F.floor((F.col("hi_us") - F.col("lo_us")) / step))
            .filter("n_grid > 0").select(*keys, "lo_us", "n_grid"))


def resample_linear(df: DataFrame, keys: list[str], us: str, value: str, bounds: DataFrame,
                    step_s: float, gap_s: float, chunk_s: float) -> DataFrame:
    """Linear interpolation onto the grid, without extrapolation.

    Each pair of consecutive samples emits the grid points in [t, next t), so
    nothing is looked up: cost is samples plus grid points. ``in_gap`` marks
    points between samples further apart than ``gap_s``. Duplicate times are
    averaged first.
    """
    step = int(round(step_s * 1_000_000))
    d = (df.filter(F.col(value).isNotNull()).groupBy(*keys, us).agg(F.avg(value).alias("_y"))
         .withColumn("_t", F.col(us)))
    d = neighbours(d, keys, [us], ["_t", "_y"], time_bucket(us, chunk_s), "next")
    d = d.join(bounds, keys)
    k0 = F.greatest(F.ceil((F.col("_t") - F.col("lo_us")) / step), F.lit(0))
    k1 = F.ceil((F.coalesce(F.col("next__t"), F.col("_t") + 1) - F.col("lo_us")) / step) - 1
    k1 = F.least(k1, F.col("n_grid") - 1)
    d = d.withColumn("_k0", k0).withColumn("_k1", k1).filter("_k1 >= _k0")
    d = d.withColumn("k", F.explode(F.sequence("_k0", "_k1")))
    t = F.col("lo_us") + F.col("k") * step
    frac = (t - F.col("_t")) / (F.col("next__t") - F.col("_t"))
    y = F.coalesce(F.col("_y") + (F.col("next__y") - F.col("_y")) * frac, F.col("_y"))
    return d.select(*keys, "k", t.alias("t_us"), y.alias("y"), F.col("_t").alias("before_us"),
                    F.col("next__t").alias("after_us"),
                    F.coalesce(F.col("next__t") - F.col("_t") > int(gap_s * 1_000_000), F.lit(False))
                    .alias("in_gap"))


def fill_linear(df: DataFrame, keys: list[str], k: str, value: str, chunk_rows: int,
                name: str) -> DataFrame:
    """Index-linear interpolation of missing values; the ends hold the nearest value."""
    d = df.withColumn("_p", F.when(F.col(value).isNotNull(), F.struct(F.col(k).alias("k"), F.col(value).alias("v"))))
    chunk = F.floor(F.col(k) / chunk_rows)
    d = last_known(d, keys, [k], "_p", chunk, "_a")
    d = last_known(d, keys, [k], "_p", chunk, "_b", ahead=True)
    line = F.col("_a.v") + (F.col("_b.v") - F.col("_a.v")) * (F.col(k) - F.col("_a.k")) / F.when(
        F.col("_b.k") != F.col("_a.k"), F.col("_b.k") - F.col("_a.k"))
    return d.withColumn(name, F.coalesce(F.col(value), line, F.col("_a.v"), F.col("_b.v"))).drop("_p", "_a", "_b")


def zscore(df: DataFrame, keys: list[str], cols: list[str]) -> DataFrame:
    """Population z-scores in place; a constant column becomes zero."""
    m = df.groupBy(*keys).agg(*[F.avg(c).alias(f"_m_{c}") for c in cols],
                              *[F.stddev_pop(c).alias(f"_s_{c}") for c in cols])
    d = df.join(m, keys)
    for c in cols:
        s = F.col(f"_s_{c}")
        d = d.withColumn(c, F.when(s.isNull() | (s == 0), F.lit(0.0)).otherwise((F.col(c) - F.col(f"_m_{c}")) / s))
    return d.drop(*[f"_{p}_{c}" for p in "ms" for c in cols])


def signal_pair(a: DataFrame, b: DataFrame, keys: list[str], us: str, value: str, step_s: float,
                gap_s: float, chunk_s: float) -> DataFrame:
    """(keys, k, z_a, z_b, masked): both streams on one grid, z-scored, gaps zeroed."""
    bounds = grid_bounds(a, b, keys, us, step_s)
    ra = resample_linear(a, keys, us, value, bounds, step_s, gap_s, chunk_s)
    rb = resample_linear(b, keys, us, value, bounds, step_s, gap_s, chunk_s)
    p = (ra.select(*keys, "k", F.col("y").alias("z_a"), F.col("in_gap").alias("masked"))
         .join(rb.select(*keys, "k", F.col("y").alias("z_b")), [*keys, "k"]))
    p = zscore(p, keys, ["z_a", "z_b"])
    return p.select(*keys, "k", F.when(F.col("masked"), 0.0).otherwise(F.col("z_a")).alias("z_a"),
                    F.when(F.col("masked"), 0.0).otherwise(F.col("z_b")).alias("z_b"), "masked")


def lag_products(sig: DataFrame, keys: list[str], max_lag: int, block: int = 4096) -> DataFrame:
    """sum over k of z_a[k + lag] * z_b[k] for every lag in [-max_lag, max_lag].

    The grid is cut into blocks with a halo of ``max_lag`` points; a task sees at
    most block + 2 * max_lag rows and returns one partial sum per lag, so the
    shuffle carries the series once instead of once per lag.
    """
    block = max(block, 2 * max_lag)
    d = sig.select(*keys, "k", "z_a", "z_b", F.explode(F.sequence(
        F.floor((F.col("k") - max_lag) / block), F.floor((F.col("k") + max_lag) / block))).alias("_blk"))
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in sig.select(*keys).schema)

    def partial(pdf: pd.DataFrame) -> pd.DataFrame:
        start = int(pdf["_blk"].iloc[0]) * block
        at = pdf["k"].to_numpy() - start
        a = np.zeros(block + 2 * max_lag)
        a[at + max_lag] = pdf["z_a"].to_numpy()
        own = (at >= 0) & (at < block)
        b = np.zeros(block)
        b[at[own]] = pdf["z_b"].to_numpy()[own]
        lags = np.arange(-max_lag, max_lag + 1)
        out = pd.DataFrame({"lag": lags, "s": np.correlate(a, b, mode="valid")})
        for i, key in enumerate(keys):
            out.insert(i, key, pdf[key].iloc[0])
        return out

    part = d.groupBy(*keys, "_blk").applyInPandas(partial, f"{fields}, lag long, s double")
    return part.groupBy(*keys, "lag").agg(F.sum("s").alias("s"))


def cross_correlation(sig: DataFrame, keys: list[str], max_lag: int, block: int = 4096) -> DataFrame:
    """rho(lag) normalised by the series length and both population deviations."""
    m = sig.groupBy(*keys).agg(F.count("*").alias("_n"), F.stddev_pop("z_a").alias("_sa"),
                               F.stddev_pop("z_b").alias("_sb"))
    sd = F.col("_sa") * F.col("_sb")
    return (lag_products(sig, keys, max_lag, block).join(m, keys)
            .filter(F.abs("lag") <= F.col("_n") - 1)
            .select(*keys, "lag", (F.col("s") / F.col("_n") / F.when(sd == 0, 1.0).otherwise(sd)).alias("rho")))


def peak(rho: DataFrame, keys: list[str], exclude: int) -> DataFrame:
    """First highest lag, its parabolic refinement and its prominence.

    A key has 2 * max_lag + 1 rows here, so the windows are small.
    """
    w = Window.partitionBy(*keys).orderBy("lag")
    d = (rho.withColumn("_l", F.lag("rho").over(w)).withColumn("_r", F.lead("rho").over(w))
         .withColumn("_k", F.max_by("lag", F.struct("rho", -F.col("lag"))).over(Window.partitionBy(*keys))))
    other = F.when((F.abs(F.col("lag") - F.col("_k")) > exclude) & (F.col("rho") >= F.col("_l"))
                   & (F.col("rho") >= F.col("_r")), F.col("rho"))
    at = lambda c: F.max(F.when(F.col("lag") == F.col("_k"), F.col(c)))
    p = d.groupBy(*keys).agg(F.max("_k").alias("lag"), at("rho").alias("rho"), at("_l").alias("_l"),
                             at("_r").alias("_r"), F.max(other).alias("_o"))
    bend = F.col("_l") - 2 * F.col("rho") + F.col("_r")
    inner = F.col("_l").isNotNull() & F.col("_r").isNotNull()
    shift = F.when(inner & (bend != 0), clip(0.5 * (F.col("_l") - F.col("_r")) / bend, -1, 1)).otherwise(0.0)
    p = p.withColumn("_d", shift)
    return p.select(
        *keys, "lag", "rho", (F.col("lag") + F.col("_d")).alias("tau"),
        F.when(inner, F.col("rho") - 0.25 * (F.col("_l") - F.col("_r")) * F.col("_d"))
        .otherwise(F.col("rho")).alias("rho_peak"),
        F.when(F.col("rho") <= 0, 0.0).when(F.col("_o").isNull(), 1.0)
        .otherwise((F.col("rho") - F.greatest("_o", F.lit(0.0))) / F.col("rho")).alias("prominence"))


def _block_sums(segment: int, length: int, max_lag: int, keys: list[str], fields: list[str]):
    """Starts and series of one segment -> per replicate the sums that blocks add by themselves, and the ends of
    each block for the seams."""
    lags = np.arange(-max_lag, max_lag + 1)

    def run(starts: pd.DataFrame, series: pd.DataFrame) -> pd.DataFrame:
        if not len(starts) or not len(series):
            return pd.DataFrame(columns=fields)
        base = int(starts["_seg"].iloc[0]) * segment
        a, b = np.zeros(segment + length), np.zeros(segment + length)
        at = series["k"].to_numpy() - base
        a[at], b[at] = series["z_a"].to_numpy(), series["z_b"].to_numpy()
        size = starts["_size"].to_numpy()
        place = (starts["_s"].to_numpy() - base)[:, None] + np.arange(length)
        real = np.arange(length) < size[:, None]
        x, y = np.where(real, a[place], 0.0), np.where(real, b[place], 0.0)
        cross = np.stack([(x[:, max(l, 0):length + min(l, 0)] * y[:, max(-l, 0):length - max(l, 0)]).sum(axis=1) for l in lags], axis=1)
        # the first and the last entries of the whole replicate, for the means over shifted ranges
        left = starts["_n"].to_numpy() - starts["_i"].to_numpy() * length  # entries from the block's start to the end
        far = np.arange(length)[None, :] - left[:, None]
        ends = []
        for v in (x, y):
            first = np.zeros((len(x), max_lag + 1))
            own = starts["_i"].to_numpy() == 0
            first[own, 1:] = np.cumsum(v[own, :max_lag], axis=1)
            last = np.stack([np.where(far >= -l, v, 0.0).sum(axis=1) for l in range(max_lag + 1)], axis=1)
            ends += [first, last]
        sums = np.concatenate([size[:, None], x.sum(axis=1)[:, None], y.sum(axis=1)[:, None], (x * x).sum(axis=1)[:, None],
                               (y * y).sum(axis=1)[:, None], cross, *ends], axis=1)
        rep, where = np.unique(starts["rep"].to_numpy(), return_inverse=True)
        total = np.zeros((len(rep), sums.shape[1]))
        np.add.at(total, where, sums)
        edge = np.concatenate([x[:, :max_lag], y[:, :max_lag], x[:, length - max_lag:], y[:, length - max_lag:]], axis=1)
        out = pd.DataFrame({"rep": np.concatenate([rep, starts["rep"].to_numpy()]),
                            "_i": np.concatenate([np.full(len(rep), -1), starts["_i"].to_numpy()]),
                            "v": [*total, *edge]})
        for k in keys:
            out[k] = starts[k].iloc[0]
        return out[fields]
    return run


def _seam_sums(max_lag: int, width: int, keys: list[str], fields: list[str]):
    """Ends of neighbouring blocks of one replicate -> the lag products that reach from one block into the next."""
    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["rep", "_i"])
        rep, i, e = pdf["rep"].to_numpy(), pdf["_i"].to_numpy(), np.stack(pdf["v"].to_numpy())
        pairs = np.flatnonzero((i[1:] == i[:-1] + 1) & (rep[1:] == rep[:-1]))
        head_a, head_b = e[pairs + 1, :max_lag], e[pairs + 1, max_lag:2 * max_lag]
        tail_a, tail_b = e[pairs, 2 * max_lag:3 * max_lag], e[pairs, 3 * max_lag:]
        one = np.zeros((len(pairs), width))
        for l in range(1, max_lag + 1):
            one[:, 5 + max_lag + l] = (head_a[:, :l] * tail_b[:, max_lag - l:]).sum(axis=1)
            one[:, 5 + max_lag - l] = (tail_a[:, max_lag - l:] * head_b[:, :l]).sum(axis=1)
        reps, where = np.unique(rep[pairs], return_inverse=True)
        total = np.zeros((len(reps), width))
        np.add.at(total, where, one)
        out = pd.DataFrame({"rep": reps, "_i": np.full(len(reps), -1), "v": list(total)})
        for k in keys:
            out[k] = pdf[k].iloc[0]
        return out[fields]
    return run


def block_bootstrap(sig: DataFrame, keys: list[str], reps: int, length: int, max_lag: int,
                    exclude: int, seed: str, segment: int = 8192, seams: int = 512, reps_each: int = 16) -> DataFrame:
    """One lag estimate per replicate of moving-block resampling.

    Block starts come from a hash of (seed, key, replicate, block number), and a
    replicate is z-scored anew. Its correlation needs sums only: those that a
    block adds by itself, and the products across a seam, which the ``max_lag``
    entries at both ends of neighbouring blocks decide. So the series moves once,
    in segments with a halo of one block, whatever the number of replicates;
    replicates move as starts and block ends, not as resampled series. A task
    sees one segment, or ``seams`` blocks of ``reps_each`` replicates. ``max_lag`` is at most ``length``.
    """
    if max_lag > length:
        raise ValueError("a lag may reach into the next block only")
    kinds = [f"`{f.name}` {f.dataType.simpleString()}" for f in sig.select(*keys).schema]
    fields, kind = [*keys, "rep", "_i", "v"], ", ".join([*kinds, "rep int", "_i int", "v array<double>"])
    n = sig.groupBy(*keys).agg((F.max("k") + 1).cast("long").alias("_n")).filter(F.col("_n") > length)
    starts = (n.withColumn("rep", F.explode(F.sequence(F.lit(1), F.lit(reps))))
              .withColumn("_i", F.explode(F.sequence(F.lit(0), (F.ceil(F.col("_n") / length) - 1).cast("int"))))
              .withColumn("_s", F.floor(hash_unit(seed, *keys, "rep", "_i") * (F.col("_n") - length + 1)))
              .withColumn("_size", F.least(F.lit(length), F.col("_n") - F.col("_i") * length).cast("int"))
              .withColumn("_seg", F.floor(F.col("_s") / segment)))
    series = sig.select(*keys, "k", "z_a", "z_b", F.explode(F.sequence(
        F.greatest(F.floor((F.col("k") - length + 1) / segment), F.lit(0)), F.floor(F.col("k") / segment))).alias("_seg"))
    parts = stored(starts.groupBy(*keys, "_seg").cogroup(series.groupBy(*keys, "_seg"))
                   .applyInPandas(_block_sums(segment, length, max_lag, keys, fields), kind))
    width = 5 + (2 * max_lag + 1) + 4 * (max_lag + 1)
    # block i meets i - 1 and i + 1: the first of a group of seams is in the group before too
    group = F.array_distinct(F.array(F.floor(F.col("_i") / seams), F.floor(F.greatest(F.col("_i") - 1, F.lit(0)) / seams)))
    ends = parts.filter("_i >= 0").select("*", F.explode(group).alias("_g"))
    ends = ends.withColumn("_h", F.floor(F.col("rep") / reps_each))
    across = ends.groupBy(*keys, "_h", "_g").applyInPandas(_seam_sums(max_lag, width, keys, fields), kind)
    every = parts.filter("_i < 0").unionByName(across).select(*keys, "rep", F.posexplode("v").alias("p", "x"))
    sums = (every.groupBy(*keys, "rep", "p").agg(F.sum("x").alias("x")).groupBy(*keys, "rep")
            .agg(F.transform(F.sort_array(F.collect_list(F.struct("p", "x"))), lambda s: s["x"]).alias("v")))
    d = sums.withColumn("lag", F.explode(F.sequence(F.lit(-max_lag).cast("long"), F.lit(max_lag).cast("long"))))
    v, far = F.col("v"), F.abs("lag").cast("int")
    at = lambda offset, i: F.get(v, offset + i)
    firsts = 5 + 2 * max_lag + 1
    fa, la, fb, lb = (at(firsts + j * (max_lag + 1), far) for j in range(4))
    up = F.col("lag") >= 0
    sum_a, sum_b = v[1] - F.when(up, fa).otherwise(la), v[2] - F.when(up, lb).otherwise(fb)
    ma, mb, size = v[1] / v[0], v[2] / v[0], v[0]
    sd = F.sqrt(F.greatest(v[3] / size - ma * ma, F.lit(0.0))) * F.sqrt(F.greatest(v[4] / size - mb * mb, F.lit(0.0)))
    product = at(5 + max_lag, F.col("lag").cast("int")) - ma * sum_b - mb * sum_a + (size - far) * ma * mb
    # nine digits: lags that tie but for rounding are told apart by their size alone, as in ``peak``
    rho = d.filter(far <= size - 1).select(*keys, "rep", "lag", F.round(F.when(sd > 1e-9, product / size / sd).otherwise(0.0), 9).alias("rho"))
    return peak(rho, [*keys, "rep"], exclude)


def pooled(df: DataFrame, keys: list[str], tau: str, sigma: str) -> DataFrame:
    """Inverse-variance pooling with Cochran's Q and I squared, from moments."""
    w = 1 / (F.col(sigma) * F.col(sigma))
    d = df.filter((F.col(sigma) > 0) & F.col(tau).isNotNull()).withColumn("_w", w)
    mean = d.groupBy(*keys).agg(F.count("*").alias("n"), F.sum("_w").alias("_sw"),
                                (F.sum(F.col("_w") * F.col(tau)) / F.sum("_w")).alias("tau_bar"))
    mean = mean.filter("n >= 2")
    dev = (d.join(mean.select(*keys, "tau_bar"), keys) if keys else d.withColumn("tau_bar", mean.select("tau_bar").scalar()))
    q = dev.groupBy(*keys).agg(F.sum(F.col("_w") * (F.col(tau) - F.col("tau_bar")) ** 2).alias("q"))
    out = mean.join(q, keys) if keys else mean.withColumn("q", q.scalar())
    se = 1 / F.sqrt("_sw")
    return out.select(*keys, "n", "tau_bar", se.alias("se"), (F.col("tau_bar") - 1.96 * se).alias("ci_lo"),
                      (F.col("tau_bar") + 1.96 * se).alias("ci_hi"), "q", (F.col("n") - 1).alias("df"),
                      F.when(F.col("q") > 0, F.greatest((F.col("q") - F.col("n") + 1) / F.col("q"), F.lit(0.0)) * 100)
                      .otherwise(0.0).alias("i2"))


def ci_overlap(t1, s1, t2, s2) -> Column:
    t1, s1, t2, s2 = (col(c) for c in (t1, s1, t2, s2))
    return ~((t1 + 1.96 * s1 < t2 - 1.96 * s2) | (t2 + 1.96 * s2 < t1 - 1.96 * s1))


def weighted_slope(df: DataFrame, keys: list[str], x: str, y: str, w: str) -> DataFrame:
    """Weighted least squares line with the slope's standard error (three points or more)."""
    d = df.filter(F.col(x).isNotNull() & F.col(y).isNotNull() & (F.col(w) > 0))
    X, Y, W = F.col(x), F.col(y), F.col(w)
    c = d.groupBy(*keys).agg((F.sum(W * X) / F.sum(W)).alias("_xm"), (F.sum(W * Y) / F.sum(W)).alias("_ym"))
    d = d.join(c, keys).withColumn("_x", X - F.col("_xm")).withColumn("_y", Y - F.col("_ym"))
    m = d.groupBy(*keys).agg(
        F.count("*").alias("n"), F.sum(W * F.col("_x") * F.col("_x")).alias("_sxx"),
        F.sum(W * F.col("_x") * F.col("_y")).alias("_sxy"), F.sum(W * F.col("_y") * F.col("_y")).alias("_syy"),
        F.first("_xm").alias("_xm"), F.first("_ym").alias("_ym"))
    slope = F.when((F.col("n") >= 2) & (F.col("_sxx") > 0), F.col("_sxy") / F.col("_sxx"))
    rss = F.greatest(F.col("_syy") - slope * F.col("_sxy"), F.lit(0.0))
    return m.select(*keys, "n", slope.alias("slope"), (F.col("_ym") - slope * F.col("_xm")).alias("intercept"),
                    F.when((F.col("n") >= 3) & (F.col("_sxx") > 0), F.sqrt(rss / (F.col("n") - 2) / F.col("_sxx"))).alias("slope_se"))
