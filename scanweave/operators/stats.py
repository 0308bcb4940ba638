"""Fits, correlations, weighted bootstraps, mixtures and threshold rules."""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import Column, DataFrame, Window, functions as F

from scanweave.functions.exprs import clip
from scanweave.operators.quantiles import average_ranks
from scanweave.operators.timeline import density_chunks
from scanweave.session import ship, stored

# Cumulative Poisson(1) probabilities.
POISSON1 = [sum(math.exp(-1) / math.factorial(j) for j in range(i + 1)) for i in range(9)]


def log_distance(x: Column, y: Column, ax: Column, ay: Column, floor_m: float = 0.05) -> Column:
    return F.log10(F.greatest(F.hypot(x - ax, y - ay), F.lit(floor_m)))


def line_fit(df: DataFrame, keys: list[str], y: str, x: str) -> DataFrame:
    return df.groupBy(*keys).agg(F.regr_count(y, x).alias("n"), F.regr_slope(y, x).alias("slope"),
                                 F.regr_intercept(y, x).alias("intercept"), F.regr_r2(y, x).alias("r2"))


def fit_position(points: DataFrame, keys: list[str], centre: tuple[Column, Column], reach: float, step: float,
                 n_range=(1.0, 6.0), p0_range=(-120.0, 0.0)) -> DataFrame:
    """Best transmitter position on a grid around ``centre`` under signal = p0 - 10 n log10(d).

    ``points`` holds (x_m, y_m, n, s, q): rows folded to moments per exact
    position. Every candidate is a small set of sums, so the aggregate combines
    on the map side.
    """
    m = int(round(reach / step))
    offs = F.sequence(F.lit(-m), F.lit(m))
    d = (points.withColumn("_i", F.explode(offs)).withColumn("_j", F.explode(offs))
         .withColumn("fx", F.round(centre[0] + F.col("_i") * step, 6))
         .withColumn("fy", F.round(centre[1] + F.col("_j") * step, 6)))
    d = d.withColumn("_l", log_distance(F.col("x_m"), F.col("y_m"), F.col("fx"), F.col("fy")))
    g = d.groupBy(*keys, "fx", "fy").agg(
        F.sum("n").alias("n"), F.sum("s").alias("sy"), F.sum("q").alias("syy"),
        F.sum(F.col("n") * F.col("_l")).alias("sx"), F.sum(F.col("n") * F.col("_l") * F.col("_l")).alias("sxx"),
        F.sum(F.col("s") * F.col("_l")).alias("sxy"))
    den = F.col("n") * F.col("sxx") - F.col("sx") * F.col("sx")
    slope = clip((F.col("n") * F.col("sxy") - F.col("sx") * F.col("sy")) / F.when(den != 0, den),
                 -10 * n_range[1], -10 * n_range[0])
    g = g.withColumn("b", slope)
    g = g.withColumn("a", clip((F.col("sy") - F.col("b") * F.col("sx")) / F.col("n"), *p0_range))
    a, b = F.col("a"), F.col("b")
    rss = (F.col("syy") - 2 * a * F.col("sy") - 2 * b * F.col("sxy") + F.col("n") * a * a
           + 2 * a * b * F.col("sx") + b * b * F.col("sxx"))
    tss = F.col("syy") - F.col("sy") * F.col("sy") / F.col("n")
    g = g.withColumn("rss", F.round(rss, 6)).withColumn("r2", 1 - rss / tss)
    best = g.filter("b IS NOT NULL").groupBy(*keys).agg(F.min_by(
        F.struct("fx", "fy", "a", "b", "rss", "r2"), F.struct("rss", "fx", "fy")).alias("_f"))
    return best.select(*keys, "_f.*")


def spearman(df: DataFrame, keys: list[str], x: str, y: str, min_n: int = 2) -> DataFrame:
    """Rank correlation with average ranks over pairwise complete rows.

    The rows are read once and folded to a count per (x, y), which is stored;
    both columns are ranked together, as one long table of their distinct values.
    """
    p = stored(df.select(*keys, F.col(x).alias("_x"), F.col(y).alias("_y")).filter("_x IS NOT NULL AND _y IS NOT NULL")
               .groupBy(*keys, "_x", "_y").agg(F.count("*").alias("_w")))
    long = p.select(*keys, "_w", F.inline(F.array(F.struct(F.lit(0).alias("_col"), F.col("_x").cast("double").alias("_val")),
                                                  F.struct(F.lit(1).alias("_col"), F.col("_y").cast("double").alias("_val")))))
    counts = stored(long.groupBy(*keys, "_col", "_val").agg(F.sum("_w").alias("_n")))
    ranks = average_ranks(counts, [*keys, "_col"], "_val", "_n", "_r")
    side = lambda c, v, r: ranks.filter(F.col("_col") == c).select(*keys, F.col("_val").alias(v), F.col("_r").alias(r))
    p = p.withColumn("_x", F.col("_x").cast("double")).withColumn("_y", F.col("_y").cast("double"))
    p = p.join(side(0, "_x", "_rx"), [*keys, "_x"]).join(side(1, "_y", "_ry"), [*keys, "_y"])
    W, X, Y = F.col("_w"), F.col("_rx"), F.col("_ry")
    g = p.groupBy(*keys).agg(F.sum("_w").alias("n"), F.sum(W * X).alias("sx"), F.sum(W * Y).alias("sy"),
                             F.sum(W * X * X).alias("sxx"), F.sum(W * Y * Y).alias("syy"), F.sum(W * X * Y).alias("sxy"))
    return g.select(*keys, "n", _rho(min_n).alias("rho"))


def _rho(min_n: int) -> Column:
    """The correlation from n and the sums of two columns; null below ``min_n`` rows or without variance."""
    n = F.col("n")
    cov = F.col("sxy") - F.col("sx") * F.col("sy") / n
    var = (F.col("sxx") - F.col("sx") ** 2 / n) * (F.col("syy") - F.col("sy") ** 2 / n)
    return F.when((n >= min_n) & (var > 0), cov / F.sqrt(var))


def _count_ranks(rows: DataFrame, part: list[str], value: str, cells: list[str], name: str) -> DataFrame:
    """(part, _ck, value, ``name``): the average rank of each value in each cell, an array; ``cells`` hold rows of a cell.

    ``rows`` is cut in chunks ``_ck`` along the value; the rows below a chunk come from one row a chunk.
    """
    sums = [F.sum(c).alias(c) for c in cells]
    below = Window.partitionBy(*part).orderBy("_ck").rowsBetween(Window.unboundedPreceding, -1)
    base = rows.groupBy(*part, "_ck").agg(*sums).select(*part, "_ck", F.array(*[F.coalesce(F.sum(c).over(below), F.lit(0)) for c in cells]).alias("_base"))
    upto = Window.partitionBy(*part, "_ck").orderBy(value).rowsBetween(Window.unboundedPreceding, 0)
    return rows.groupBy(*part, "_ck", value).agg(*sums).join(base, [*part, "_ck"]).select(*part, "_ck", value, F.array(*[
        F.col("_base")[k] + F.sum(c).over(upto) - (F.col(c) - 1) / 2 for k, c in enumerate(cells)]).alias(name))


def spearman_by_stratum(df: DataFrame, keys: list[str], strata: dict[str, Column], features: dict[str, str], y: str, min_n: int = 2) -> DataFrame:
    """(keys, stratum, feature, n, rho): what ``spearman`` gives for each feature with ``y`` within each stratum.

    A row stays one row: it goes to its place along ``y`` once, and all strata and features count their own rows on
    that one order. Ranks of the features come from the counts of their distinct values.
    """
    xs, ss = [f"_x{j}" for j in range(len(features))], [f"_s{i}" for i in range(len(strata))]
    cells = [(i, j, f"_i{i}_{j}") for i in range(len(strata)) for j in range(len(features))]
    d = df.filter(F.col(y).isNotNull()).select(*keys, F.col(y).cast("double").alias("_y"), *[
        F.col(c).cast("double").alias(x) for x, c in zip(xs, features.values())], *[
        F.coalesce(c.cast("long"), F.lit(0).cast("long")).alias(s) for s, c in zip(ss, strata.values())])
    d = stored(density_chunks(d, keys, "_y", "_ck"))
    own = {c: F.when(F.col(xs[j]).isNotNull(), F.col(ss[i])).otherwise(0) for i, j, c in cells}
    ry = _count_ranks(d.select(*keys, "_ck", "_y", *[v.alias(c) for c, v in own.items()]), keys, "_y", [c for _, _, c in cells], "_ry")
    p = d.join(ry, [*keys, "_ck", "_y"]).drop("_ck")
    values = d.select(*keys, *ss, F.inline(F.array(*[F.struct(F.lit(j).alias("_f"), F.col(x).alias("_v")) for j, x in enumerate(xs)])))
    counts = stored(values.filter("_v IS NOT NULL").groupBy(*keys, "_f", "_v").agg(*[F.sum(s).alias(s) for s in ss]))
    rx = _count_ranks(density_chunks(counts, [*keys, "_f"], "_v", "_ck"), [*keys, "_f"], "_v", ss, "_r")
    for j, x in enumerate(xs):
        p = p.join(rx.filter(F.col("_f") == j).select(*keys, F.col("_v").alias(x), F.col("_r").alias(f"_r{j}")), [*keys, x], "left")
    names = [(s, f) for s in strata for f in features]
    p = p.select(*keys, F.inline(F.filter(F.array(*[F.struct(
        F.lit(s).alias("stratum"), F.lit(f).alias("feature"), (F.col(xs[j]).isNotNull() & (F.col(ss[i]) > 0)).alias("_in"),
        F.col(f"_r{j}")[i].alias("_rx"), F.col("_ry")[k].alias("_ry")) for k, ((i, j, _), (s, f)) in enumerate(zip(cells, names))]), lambda c: c["_in"])))
    X, Y = F.col("_rx"), F.col("_ry")
    g = p.groupBy(*keys, "stratum", "feature").agg(
        F.count("*").alias("n"), F.sum(X).alias("sx"), F.sum(Y).alias("sy"), F.sum(X * X).alias("sxx"), F.sum(Y * Y).alias("syy"), F.sum(X * Y).alias("sxy"))
    return g.select(*keys, "stratum", "feature", "n", _rho(min_n).alias("rho"))


def poisson_weight(u: str) -> str:
    """SQL for the Poisson(1) count of a uniform number: how many cumulative probabilities it passes."""
    return " + ".join(f"IF({u} >= {c!r}D, 1, 0)" for c in POISSON1)


PRIME = 2_147_483_647


def mixed_unit(df: DataFrame, row_id: str, rep: str, seed: int, name: str) -> DataFrame:
    """Pseudo-random number in [0, 1) from (seed, row, replicate) by quadratic mixing.

    Plain 64-bit arithmetic stays inside generated code; a text hash per row and
    replicate would dominate the bootstrap. Numbers below PRIME never overflow. The
    id's remainder enters the first stage and its quotient the second, so ids far
    apart don't share their numbers.
    """
    i = f"CAST(`{row_id}` AS BIGINT)"
    d = df.selectExpr("*", f"(({i} % {PRIME}) * 48271 + {rep} * 69621 + {seed}) % {PRIME} AS _u1")
    d = d.selectExpr("*", f"(_u1 * _u1 + {rep} * 16807 + (({i} DIV {PRIME}) % {PRIME}) * 40692 + 12345) % {PRIME} AS _u2")
    d = d.selectExpr("*", f"(_u2 * _u2 + _u1 * 39373 + 1013904223) % {PRIME} AS _u3")
    return d.selectExpr(*[f"`{c}`" for c in df.columns], f"((_u3 * _u3 + _u2) % {PRIME}) / {PRIME} AS {name}")


def resampling_weights(row_ids: np.ndarray, reps: int, seed: int) -> np.ndarray:
    """(rows, reps) Poisson(1) weights: the numbers of ``mixed_unit`` and ``poisson_weight``."""
    i, rep = row_ids.astype(np.int64)[:, None], np.arange(1, reps + 1, dtype=np.int64)
    u1 = ((i % PRIME) * 48271 + rep * 69621 + seed) % PRIME
    u2 = (u1 * u1 + rep * 16807 + ((i // PRIME) % PRIME) * 40692 + 12345) % PRIME
    u3 = (u2 * u2 + u1 * 39373 + 1013904223) % PRIME
    u = ((u3 * u3 + u2) % PRIME) / PRIME
    return sum((u >= c).view(np.int8) for c in POISSON1).astype(np.float64)


def drawn_sums(row_ids: np.ndarray, group: np.ndarray, values: np.ndarray, groups: int, reps: int, seed: int) -> np.ndarray:
    """(reps, groups * columns): weighted sums of each group; an id that comes in several groups is drawn once."""
    ids, line = np.unique(row_ids, return_inverse=True)
    wide = np.zeros((len(ids), groups, values.shape[1]))
    np.add.at(wide, (line, group), values)
    wide = wide.reshape(len(ids), -1)
    return sum(resampling_weights(ids[at:at + 512], reps, seed).T @ wide[at:at + 512] for at in range(0, len(ids), 512))


def replicate_sums(df: DataFrame, keys: list[str], row_id: str, columns: list[str], reps: int, seed: int) -> DataFrame:
    """(keys, rep, w, columns): per replicate the sum of weights and the weighted sums.

    Rows are read once and not multiplied: a task keeps ``reps`` running sums a
    key and passes on only these. An id's weights are drawn once a batch, under
    however many keys it comes. A null value adds nothing; a null row id is
    row 0. ``keys`` hold few distinct values (sessions, folds, strata).
    """
    ship(df.sparkSession)
    d = df.select(*keys, F.coalesce(F.col(row_id).cast("long"), F.lit(0)).alias("__row"),
                  *[F.col(c).cast("double").alias(c) for c in columns])

    def run(batches):
        import pyarrow as pa
        sums, first = {}, None
        for b in batches:
            if not b.num_rows:
                continue
            first = b.schema if first is None else first
            t = b.to_pandas()
            values = np.column_stack([np.ones(len(t)), t[columns].to_numpy(np.float64, na_value=0.0)])
            values = np.nan_to_num(values, nan=0.0, posinf=np.inf, neginf=-np.inf)
            group = t.groupby(keys, dropna=False, sort=False).ngroup().to_numpy() if keys else np.zeros(len(t), int)
            first_of = np.unique(group, return_index=True)[1]
            names = [tuple(b.column(k)[int(i)].as_py() for k in range(len(keys))) for i in first_of]
            total = drawn_sums(b.column(len(keys)).to_numpy(), group, values, len(names), reps, seed)
            for k, part in enumerate(np.split(total, len(names), axis=1)):
                sums[names[k]] = sums[names[k]] + part if names[k] in sums else part
        for name, total in sums.items():
            yield pa.RecordBatch.from_arrays(
                [*[pa.array([v] * reps, first.field(k).type) for k, v in enumerate(name)], pa.array(np.arange(1, reps + 1, dtype=np.int32)),
                 *[pa.array(total[:, j]) for j in range(total.shape[1])]], names=[*keys, "rep", "w", *columns])

    schema = d.select(*keys).schema.add("rep", "integer").add("w", "double")
    for c in columns:
        schema = schema.add(c, "double")
    return (d.mapInArrow(run, schema).groupBy(*keys, "rep")
            .agg(F.sum("w").alias("w"), *[F.sum(c).alias(c) for c in columns]))


def with_replicates(df: DataFrame, row_id: str, reps: int, seed: int) -> DataFrame:
    """Each row once per replicate with its resampling weight ``w``, which may be zero.

    Zero weights are kept: a filter would be pushed down and compute every weight
    twice, and they add nothing to a weighted sum. The weight depends on (seed, replicate, row id) alone, so paired errors of
    two models share it and nothing is shuffled to draw it.
    """
    d = df.withColumn("rep", F.explode(F.sequence(F.lit(1), F.lit(reps))))
    d = mixed_unit(d, row_id, "rep", seed, "_u")
    return d.selectExpr(*df.columns, "rep", f"{poisson_weight('_u')} AS w")


def value_histogram(df: DataFrame, value: str, lo: int, hi: int, flag: str | None = None) -> DataFrame:
    """Dense unit-bin counts lo..hi; with ``flag`` also the flagged count. A value outside raises an error."""
    aggs = [F.count("*").alias("c")] + ([F.count_if(F.col(flag)).alias("pos")] if flag else [])
    at = F.floor(F.col(value) + 0.5)
    at = F.when((at >= lo) & (at <= hi), at).otherwise(F.raise_error(F.concat(F.lit("outside the histogram: "), F.col(value).cast("string"))).cast("long"))
    h = df.filter(F.col(value).isNotNull()).groupBy(at.alias("bin")).agg(*aggs)
    bins = df.sparkSession.range(lo, hi + 1).withColumnRenamed("id", "bin")
    return bins.join(h, "bin", "left").fillna(0)


def histogram_saddle(hist: DataFrame, lo: int, hi: int, apart: int = 20) -> DataFrame:
    """Smoothed counts' deepest point between the two highest peaks, or null.

    ``hist`` has one row per unit bin, so its windows are bounded by hi - lo + 1.
    """
    at = lambda k: F.when(F.col("bin") + k < lo, F.col("c_lo")).when(F.col("bin") + k > hi, F.col("c_hi")).otherwise(
        (F.lag("c", -k) if k < 0 else F.lead("c", k)).over(Window.orderBy("bin")) if k else F.col("c"))
    ends = hist.agg(F.min_by("c", "bin").alias("c_lo"), F.max_by("c", "bin").alias("c_hi"))
    h = hist.withColumn("c_lo", ends.select("c_lo").scalar()).withColumn("c_hi", ends.select("c_hi").scalar())
    h = h.withColumn("sm", (at(-2) + at(-1) + at(0) + at(1) + at(2)) / 5)
    w = Window.orderBy("bin")
    h = h.withColumn("is_peak", F.coalesce((F.col("sm") > F.lag("sm").over(w)) & (F.col("sm") >= F.lead("sm").over(w)), F.lit(False)))
    every = Window.partitionBy(F.lit(1))
    first = F.max_by("bin", F.when(F.col("is_peak"), F.struct("sm", -F.col("bin")))).over(every)
    h = h.withColumn("p1", first)
    second = F.max_by("bin", F.when(F.col("is_peak") & (F.abs(F.col("bin") - F.col("p1")) >= apart),
                                    F.struct("sm", -F.col("bin")))).over(every)
    h = h.withColumn("p2", second)
    between = (F.col("bin") > F.least("p1", "p2")) & (F.col("bin") < F.greatest("p1", "p2")) & F.col("p2").isNotNull()
    return h.agg(F.max("p1").alias("peak_1"), F.max("p2").alias("peak_2"),
                 F.min_by("bin", F.when(between, F.struct("sm", "bin"))).alias("saddle"))


def roc_sweep(df: DataFrame, score: str, truth: str, thresholds: list[float]) -> DataFrame:
    """tpr, fpr and J of 'score < t' for each threshold.

    Rows fold to counts per score, then to counts between neighbouring thresholds,
    on the map side; what is summed up in order has one row a threshold.
    """
    v = df.filter(F.col(score).isNotNull()).groupBy(F.col(score).alias("v")).agg(
        F.count_if(F.col(truth)).alias("p"), F.count_if(~F.col(truth)).alias("q"))
    cuts = sorted({float(t) for t in thresholds})
    below = F.size(F.filter(F.array(*[F.lit(t) for t in cuts]), lambda t: t <= F.col("v")))  # the first larger threshold
    step = v.groupBy(F.get(F.array(*[F.lit(t) for t in [*cuts, math.inf]]), below).alias("t")).agg(F.sum("p").alias("p"), F.sum("q").alias("q"))
    grid = df.sparkSession.createDataFrame([(t,) for t in cuts], "t double")
    w = Window.orderBy("t").rowsBetween(Window.unboundedPreceding, 0)
    g = grid.join(step, "t", "full").fillna(0, ["p", "q"])
    g = g.withColumn("tp", F.sum("p").over(w)).withColumn("fp", F.sum("q").over(w))
    g = g.withColumn("pos", F.sum("p").over(Window.partitionBy(F.lit(1)))).withColumn("neg", F.sum("q").over(Window.partitionBy(F.lit(1))))
    g = g.join(grid, "t", "left_semi").filter("pos > 0 AND neg > 0")
    return g.select("t", (F.col("tp") / F.col("pos")).alias("tpr"), (F.col("fp") / F.col("neg")).alias("fpr"),
                    (F.col("tp") / F.col("pos") - F.col("fp") / F.col("neg")).alias("j"))


# Fixed values of the mixture fit: steps at most, least gain in log likelihood, least spread.
EM_STEPS, EM_GAIN, EM_SPREAD = 200, 1e-6, 0.5


def mixture_em(hist: DataFrame, value: str, count: str) -> DataFrame:
    """One row with the two-component normal mixture of a value histogram: mu, sd and pi of the low (0) and the high
    (1) component, log_lik and steps.

    The histogram, one row a bin, is packed into one array; the steps are a fold
    over their numbers, and each a fold over the bins that adds up what belongs
    to the high component: its share, mean and square. The low one has the rest.
    Starts at the quartiles, with half the overall spread (at least 1) and even
    shares. Once a step gains less than EM_GAIN the state stays as it is.
    """
    c, x = F.col(count).cast("double"), F.col(value).cast("double")
    packed = hist.agg(F.array_sort(F.collect_list(F.struct(x.alias("x"), c.alias("c")))).alias("bins"), F.sum(c).alias("n"),
                      F.sum(c * x).alias("sx"), F.sum(c * x * x).alias("sxx"),
                      F.percentile(value, F.array(F.lit(0.25), F.lit(0.75)), F.col(count)).alias("q"))
    spread = F.greatest(F.sqrt(F.greatest(F.col("sxx") / F.col("n") - (F.col("sx") / F.col("n")) ** 2, F.lit(0.0))) / 2, F.lit(1.0))
    zero = F.lit(0.0)
    start = F.struct(F.col("q")[0].alias("mu0"), F.col("q")[1].alias("mu1"), spread.alias("sd0"), spread.alias("sd1"), F.lit(0.5).alias("pi1"),
                     F.lit(float("-inf")).alias("log_lik"), F.lit(0).alias("steps"), F.lit(False).alias("settled"))

    def bell(x, mu, sd):
        return F.exp(-(((x - mu) / sd) ** 2) / 2) / (sd * math.sqrt(2 * math.pi))

    def belongs(s):
        """Count, sum and sum of squares of the high component, and the log likelihood, under state ``s``."""
        def add(t, b):
            low, high = (1 - s["pi1"]) * bell(b["x"], s["mu0"], s["sd0"]), s["pi1"] * bell(b["x"], s["mu1"], s["sd1"])
            both = F.greatest(low + high, F.lit(1e-300))
            part = b["c"] * high / both
            rest = b["c"] * low / both
            return F.struct((t["n1"] + part).alias("n1"), (t["x1"] + part * b["x"]).alias("x1"), (t["q1"] + part * b["x"] * b["x"]).alias("q1"),
                            (t["n0"] + rest).alias("n0"), (t["x0"] + rest * b["x"]).alias("x0"), (t["q0"] + rest * b["x"] * b["x"]).alias("q0"),
                            (t["ll"] + b["c"] * F.log(both)).alias("ll"))
        return F.aggregate("bins", F.struct(*[zero.alias(k) for k in ("n1", "x1", "q1", "n0", "x0", "q0", "ll")]), add)

    def renewed(s, t):
        def moments(k):
            mean = t[f"x{k}"] / F.greatest(t[f"n{k}"], F.lit(1e-12))
            var = t[f"q{k}"] / F.greatest(t[f"n{k}"], F.lit(1e-12)) - mean * mean
            return mean.alias(f"mu{k}"), F.greatest(F.sqrt(F.greatest(var, zero)), F.lit(EM_SPREAD)).alias(f"sd{k}")
        (m0, s0), (m1, s1) = moments(0), moments(1)
        return F.struct(m0, m1, s0, s1, (t["n1"] / (t["n0"] + t["n1"])).alias("pi1"), t["ll"].alias("log_lik"), (s["steps"] + 1).alias("steps"),
                        (F.abs(t["ll"] - s["log_lik"]) < EM_GAIN).alias("settled"))

    def step(s, _):
        # one evaluation of the sums, whatever number of fields is made of them
        return F.when(s["settled"], s).otherwise(F.transform(F.array(belongs(s)), lambda t: renewed(s, t))[0])

    fit = packed.where("n > 0").select(F.aggregate(F.sequence(F.lit(1), F.lit(EM_STEPS)), start, step).alias("f"))
    turned = F.col("f.mu1") < F.col("f.mu0")
    pick = lambda a, b: F.when(turned, b).otherwise(a)
    return fit.select(pick(F.col("f.mu0"), F.col("f.mu1")).alias("mu0"), pick(F.col("f.mu1"), F.col("f.mu0")).alias("mu1"),
                      pick(F.col("f.sd0"), F.col("f.sd1")).alias("sd0"), pick(F.col("f.sd1"), F.col("f.sd0")).alias("sd1"),
                      pick(1 - F.col("f.pi1"), F.col("f.pi1")).alias("pi0"), pick(F.col("f.pi1"), 1 - F.col("f.pi1")).alias("pi1"),
                      F.col("f.log_lik").alias("log_lik"), F.col("f.steps").alias("steps"))


def mixture_crossover(fit: DataFrame, lo: float = 0.0, hi: float = 100.0, n: int = 10001) -> DataFrame:
    """``fit`` with the grid point at which a value belongs to either component most evenly, the first of equals."""
    x = F.lit(lo) + F.col("_i") * ((hi - lo) / (n - 1))
    bell = lambda k: F.col(f"pi{k}") * F.exp(-(((x - F.col(f"mu{k}")) / F.col(f"sd{k}")) ** 2) / 2) / F.col(f"sd{k}")
    gap = F.abs(bell(0) / F.greatest(bell(0) + bell(1), F.lit(1e-300)) - 0.5)
    grid = fit.select("*", F.explode(F.sequence(F.lit(0), F.lit(n - 1))).alias("_i"))
    best = F.min_by(x, F.struct(gap, F.col("_i"))).alias("threshold")
    return grid.groupBy(*fit.columns).agg(best)


def choose_threshold(saddle: Column, mixture: Column, roc: Column, j: Column, j_floor: float,
                     agree: float) -> tuple[Column, Column]:
    """(threshold, rule): ROC optimum unless weak; averaged with the saddle when they agree."""
    weak = roc.isNull() | (F.coalesce(j, F.lit(0.0)) < j_floor)
    rule = (F.when(weak & saddle.isNull(), "mixture").when(weak, "saddle").when(saddle.isNull(), "roc")
            .when(F.abs(saddle - roc) <= agree, "average").otherwise("roc"))
    value = (F.when(rule == "mixture", mixture).when(rule == "saddle", saddle)
             .when(rule == "average", (saddle + roc) / 2).otherwise(roc))
    return value, rule
