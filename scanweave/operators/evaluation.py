"""Regression metrics, paired bootstraps and attribution summaries."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from scanweave.operators.stats import replicate_sums


def _strata(df: DataFrame, in_view: str) -> DataFrame:
    """Each row under 'overall' and under its view stratum."""
    return df.withColumn("stratum", F.explode(F.array(
        F.lit("overall"), F.when(F.col(in_view), F.lit("in_view")).otherwise(F.lit("out_of_view")))))


def stratified_metrics(preds: DataFrame, keys: list[str], y: str = "y", p: str = "p", in_view: str = "in_view") -> DataFrame:
    """n, rmse, mae, r2 and bias per key and stratum in one combining aggregate."""
    e = F.col(y) - F.col(p)
    sse = F.sum(e * e)
    sst = F.var_pop(y) * F.count("*")
    return _strata(preds, in_view).groupBy(*keys, "stratum").agg(
        F.count("*").alias("n"), F.sqrt(F.avg(e * e)).alias("rmse"), F.avg(F.abs(e)).alias("mae"),
        F.when(sst > 0, 1 - sse / sst).alias("r2"), F.avg(e).alias("bias"))


def _leaf(in_view: str) -> Column:
    return F.when(F.col(in_view), F.lit("in_view")).otherwise(F.lit("out_of_view"))


def _replicate_sums(d: DataFrame, keys: list[str], row_id: str, reps: int, seed: int, columns: list[str]) -> DataFrame:
    """Weighted sums per replicate and stratum.

    Rows are drawn once, under their view stratum; 'overall' adds the two up.
    """
    leaf = replicate_sums(d.select(*keys, row_id, _leaf("in_view").alias("stratum"), *columns), [*keys, "stratum"], row_id, columns, reps, seed)
    up = leaf.withColumn("stratum", F.explode(F.array(F.lit("overall"), F.col("stratum"))))
    return up.groupBy(*keys, "stratum", "rep").agg(F.sum("w").alias("w"), *[F.sum(c).alias(c) for c in columns])


def bootstrap_rmse(preds: DataFrame, keys: list[str], row_id: str, reps: int, seed: int, y: str = "y",
                   p: str = "p") -> DataFrame:
    """Percentile interval of the RMSE. A group of the last step holds ``reps`` numbers."""
    e = F.col(y) - F.col(p)
    r = _replicate_sums(preds.withColumn("_e2", e * e), keys, row_id, reps, seed, ["_e2"]).withColumn(
        "_r", F.sqrt(F.col("_e2") / F.col("w")))
    return r.groupBy(*keys, "stratum").agg(F.percentile("_r", F.lit(0.025)).alias("rmse_ci_lo"),
                                           F.percentile("_r", F.lit(0.975)).alias("rmse_ci_hi"))


def pair_errors(preds: DataFrame, keys: list[str], row_id: str, a: str, b: str, variant: str = "variant") -> DataFrame:
    """Squared errors of two variants on the same rows."""
    e = F.col("y") - F.col("p")
    one = lambda v, n: preds.filter(F.col(variant) == v).select(*keys, row_id, *(["in_view"] if n == "ea" else []), (e * e).alias(n))
    return one(a, "ea").join(one(b, "eb"), [*keys, row_id])


def paired_delta(pairs: DataFrame, keys: list[str], row_id: str, reps: int, seed: int) -> DataFrame:
    """RMSE(a) - RMSE(b) with a paired percentile interval."""
    d = _strata(pairs, "in_view")
    point = d.groupBy(*keys, "stratum").agg(F.count("*").alias("n"), F.sqrt(F.avg("ea")).alias("rmse_a"), F.sqrt(F.avg("eb")).alias("rmse_b"))
    r = _replicate_sums(pairs, keys, row_id, reps, seed, ["ea", "eb"]).withColumn(
        "_d", F.sqrt(F.col("ea") / F.col("w")) - F.sqrt(F.col("eb") / F.col("w")))
    ci = r.groupBy(*keys, "stratum").agg(F.percentile("_d", F.lit(0.025)).alias("ci_lo"), F.percentile("_d", F.lit(0.975)).alias("ci_hi"))
    return point.withColumn("delta", F.col("rmse_a") - F.col("rmse_b")).join(ci, [*keys, "stratum"])


def group_importance(contrib: DataFrame, groups: DataFrame, fold: str = "fold") -> DataFrame:
    """Sum over a group's features of mean |contribution|, and the group's share.

    Features fold to one mean each before the tiny group table is joined.
    """
    f = contrib.groupBy(fold, "feature").agg(F.avg(F.abs("contribution")).alias("imp"))
    g = f.join(groups, "feature").groupBy(fold, "grp").agg(F.sum("imp").alias("importance"))
    total = g.groupBy(fold).agg(F.sum("importance").alias("_t"))
    return g.join(total, fold).select(fold, "grp", "importance", (F.col("importance") / F.col("_t")).alias("share"))


def dominant_group(contrib: DataFrame, groups: DataFrame, keys: list[str]) -> DataFrame:
    """Per cell the group with the highest mean |contribution|; ties by group order.

    A group's value is the mean over its features, so per-feature sums are enough.
    """
    f = contrib.groupBy(*keys, "feature").agg(F.avg(F.abs("contribution")).alias("m"))
    g = f.join(groups, "feature").groupBy(*keys, "grp").agg(F.avg("m").alias("m"), F.min("grp_order").alias("o"))
    return g.groupBy(*keys).agg(F.max_by("grp", F.struct(F.round("m", 9), -F.col("o"))).alias("grp"))


def sign_of(rho: Column, dead: float = 0.05) -> Column:
    return F.when(rho.isNull(), "-").when(F.abs(rho) < dead, "0").when(rho > 0, "+").otherwise("−")
