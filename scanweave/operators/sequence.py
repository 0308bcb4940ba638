"""Rates, rolling means, stop episodes, discontinuities on ordered streams."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from scanweave.functions.exprs import clip, col, time_bucket, wrap_angle
from scanweave.operators.intervals import points_in_intervals
from scanweave.operators.quantiles import exact_quantiles
from scanweave.operators.timeline import density_chunks, neighbours
from scanweave.session import stored


def chunk_of(us: str, chunk: float | str) -> Column:
    """Chunks of a fixed number of seconds, or a column that has them (``timeline.density_chunks``)."""
    return F.col(chunk) if isinstance(chunk, str) else time_bucket(us, chunk)


def sample_gaps(df: DataFrame, keys: list[str], us: str, tie: str, chunk: float | str) -> DataFrame:
    """Seconds since the previous row of the key as ``dt_s``."""
    d = df.withColumn("_t", F.col(us))
    d = neighbours(d, keys, [us, tie], ["_t"], chunk_of(us, chunk))
    return d.withColumn("dt_s", (F.col("_t") - F.col("prev__t")) / 1e6).drop("_t", "prev__t")


def angular_rate(df: DataFrame, keys: list[str], us: str, tie: str, heading: str, chunk: float | str,
                 limit: float | None = None, lo: float = 0.0, hi: float | None = None,
                 name: str = "turn_rate") -> DataFrame:
    """Wrapped heading change per second; null without a usable previous row."""
    d = df.withColumn("_t", F.col(us)).withColumn("_h", F.col(heading))
    d = neighbours(d, keys, [us, tie], ["_t", "_h"], chunk_of(us, chunk))
    dt = (F.col("_t") - F.col("prev__t")) / 1e6
    ok = dt > lo if hi is None else (dt > lo) & (dt < hi)
    rate = F.when(ok, wrap_angle(F.col("_h") - F.col("prev__h")) / F.when(dt != 0, dt))
    if limit is not None:
        rate = F.when(rate.isNotNull(), clip(rate, -limit, limit))
    return d.withColumn(name, rate).drop("_t", "_h", "prev__t", "prev__h")


def rolling_mean(df: DataFrame, keys: list[str], us: str, value: str, window_s: float, name: str,
                 rows_each: int | None = None, digits: int = 12) -> DataFrame:
    """Mean over (t - window, t] of the key's clock; rows of one instant are peers.

    A row enters at its time and leaves one window later, so a running sum over
    entries and exits is the window's sum: linear in the rows, however many a
    window holds. It runs inside chunks of even density and takes up the sum of
    the chunks before. Sums are decimal, of values rounded to ``digits`` places:
    nothing is lost to cancellation, and the order of rows doesn't matter.
    """
    span = int(round(window_s * 1_000_000))
    df = stored(df)  # read as entries, as exits, and for the density of both
    lcols = [c for c in df.columns if c not in keys]
    v = F.col(value).cast(f"decimal({16 + digits},{digits})")
    n = F.col(value).isNotNull().cast("int")
    enter = df.select(*keys, F.col(us).alias("_t"), v.alias("_v"), n.alias("_c"), F.struct(*lcols).alias("_l"))
    leave = df.filter(F.col(value).isNotNull()).select(*keys, (F.col(us) + span).alias("_t"), (-v).cast(enter.schema["_v"].dataType).alias("_v"), (-n).alias("_c"),
                      F.lit(None).cast(enter.schema["_l"].dataType).alias("_l"))
    d = density_chunks(enter.unionByName(leave), keys, "_t", "_ck", rows_each)
    part = [*keys, "_ck"]
    upto = Window.partitionBy(*part).orderBy("_t").rangeBetween(Window.unboundedPreceding, 0)
    before = Window.partitionBy(*keys).orderBy("_ck").rowsBetween(Window.unboundedPreceding, -1)
    base = d.groupBy(*part).agg(F.sum("_v").alias("_bv"), F.sum("_c").alias("_bc")).select(
        *part, F.coalesce(F.sum("_bv").over(before), F.lit(0)).alias("_bv"), F.coalesce(F.sum("_bc").over(before), F.lit(0)).alias("_bc"))
    d = (d.withColumn("_sv", F.coalesce(F.sum("_v").over(upto), F.lit(0))).withColumn("_sc", F.sum("_c").over(upto))
         .filter("_l IS NOT NULL").join(base, part, "left"))  # a null key is one chunk, with nothing before it
    total, held = F.col("_sv") + F.coalesce("_bv", F.lit(0)), F.col("_sc") + F.coalesce("_bc", F.lit(0))
    return d.select(*keys, "_l.*", (total.cast("double") / F.when(held > 0, held)).alias(name)).select(*df.columns, name)


def backfill_leading(df: DataFrame, keys: list[str], order: list[str], value: str) -> DataFrame:
    """Give rows before the first present value that value; later gaps stay."""
    pos = F.struct(*order)
    first = (df.filter(F.col(value).isNotNull()).groupBy(*keys)
             .agg(F.min_by(value, pos).alias("_v"), F.min(pos).alias("_at")))
    return (df.join(first, keys, "left")
            .withColumn(value, F.when(F.col(value).isNull() & (pos < F.col("_at")), F.col("_v"))
                        .otherwise(F.col(value))).drop("_v", "_at"))


def true_runs(df: DataFrame, keys: list[str], us: str, tie: str, cond: Column, chunk_s: float,
              min_s: float = 0.0, extra: list[Column] | None = None,
              carry: list[str] | None = None) -> DataFrame:
    """Maximal runs of rows where ``cond`` holds, at least ``min_s`` long.

    ``carry`` names columns whose previous and next values ``extra`` may use.
    """
    d = neighbours(df.withColumn("_cond", F.coalesce(cond, F.lit(False))), keys, [us, tie], carry or [],
                   time_bucket(us, chunk_s), "prev next" if carry else "", "_cond")
    runs = (d.filter("_cond").groupBy(*keys, "island")
            .agg(F.min(us).alias("start_us"), F.max(us).alias("end_us"),
                 F.count("*").alias("n_rows"), *(extra or [])))
    return runs.filter(F.col("end_us") - F.col("start_us") >= int(round(min_s * 1_000_000)))


def stop_episodes(df: DataFrame, keys: list[str], session: str, us: str, tie: str, stopped: Column,
                  error: Column, min_s: float, chunk_s: float, move_m: float,
                  drop_sigmas: float) -> DataFrame:
    """Stops classified as manual_reposition, motor_overheat or routine.

    ``confidence`` lives on a small integer scale, so its per-session median is
    taken with the built-in exact percentile.
    """
    stats = df.groupBy(session).agg(F.median("confidence").alias("_med"),
                                    F.stddev_pop("confidence").alias("_std"))
    pos = F.struct(us, tie)
    runs = true_runs(df.withColumn("_e", error), keys, us, tie, stopped, chunk_s, min_s, [
        F.min(session).alias(session),
        F.min_by(F.coalesce("prev_x_m", "x_m"), pos).alias("_x0"),
        F.min_by(F.coalesce("prev_y_m", "y_m"), pos).alias("_y0"),
        F.max_by(F.coalesce("next_x_m", "x_m"), pos).alias("_x1"),
        F.max_by(F.coalesce("next_y_m", "y_m"), pos).alias("_y1"),
        F.min("confidence").alias("_cmin"), F.bool_or(F.col("confidence").isNull()).alias("_cnull"),
        F.bool_or("_e").alias("err_raised")], ["x_m", "y_m"])
    dist = F.hypot(F.col("_x1") - F.col("_x0"), F.col("_y1") - F.col("_y0"))
    dropped = F.col("_cnull") | F.coalesce(
        (F.col("_std") > 0) & (F.col("_med") - F.col("_cmin") >= drop_sigmas * F.col("_std")), F.lit(False))
    runs = runs.join(stats, session).withColumn("move_m", dist).withColumn("conf_dropped", dropped)
    kind = (F.when((F.col("move_m") > move_m) | F.col("conf_dropped"), "manual_reposition")
            .when(F.col("err_raised"), "motor_overheat").otherwise("routine"))
    return runs.withColumn("kind", kind).select(
        *keys, session, "island", "start_us", "end_us", "n_rows", "move_m", "conf_dropped",
        "err_raised", "kind")


def episode_mask(df: DataFrame, episodes: DataFrame, keys: list[str], us: str, tie: str,
                 reposition_tail_s: float, overheat_tail_s: float, accel: float,
                 chunk_s: float, speed: str = "speed") -> DataFrame:
    """Rows with ``anomaly_flag`` and ``anomaly_type``; a later episode wins.

    A repositioning marks its rows and a tail after it; an overheat marks only
    the strongly accelerating rows of its tail. Core and tails are spans of one
    interval join.
    """
    d = df.select(*keys, us, tie, F.col(us).alias("_t"), F.col(speed).alias("_s"))
    d = neighbours(d, keys, [us, tie], ["_t", "_s"], time_bucket(us, chunk_s))
    dt = F.greatest((F.col("_t") - F.col("prev__t")) / 1e6, F.lit(1e-3))
    d = d.select(*keys, us, tie, F.abs((F.col("_s") - F.col("prev__s")) / dt).alias("_a"))

    def span(start, end, kind, when, hard):
        return F.when(when, F.struct(start.alias("_from"), end.alias("_to"), F.lit(kind).alias("_k"),
                                     F.lit(hard).alias("_hard")))

    first, last = F.col("start_us"), F.col("end_us")
    rep, hot = F.col("kind") == "manual_reposition", F.col("kind") == "motor_overheat"
    spans = episodes.select(*keys, first.alias("_ep"), F.inline(F.filter(F.array(
        span(first, last, "manual_reposition", rep, False),
        span(last + 1, last + int(reposition_tail_s * 1e6), "manual_reposition_post", rep, False),
        span(last + 1, last + int(overheat_tail_s * 1e6), "motor_overheat_post", hot, True)),
        lambda s: s.isNotNull())))
    found = (points_in_intervals(d, spans, keys, us, "_from", "_to", chunk_s)
             .filter(~F.col("_hard") | (F.col("_a") > accel)))
    best = found.groupBy(tie).agg(F.max_by("_k", "_ep").alias("anomaly_type"))
    return (df.join(best, tie, "left")
            .withColumn("anomaly_flag", F.col("anomaly_type").isNotNull())
            .withColumn("anomaly_type", F.coalesce("anomaly_type", F.lit(""))))


def discontinuities(df: DataFrame, keys: list[str], us: str, tie: str, chunk_s: float, abs_m: float,
                    mult: float, max_dt_s: float, speed: str = "speed") -> DataFrame:
    """True where the step to the next row exceeds what speed explains."""
    d = df.withColumn("_t", F.col(us)).withColumn("_x", F.col("x_m")).withColumn("_y", F.col("y_m"))
    d = neighbours(d, keys, [us, tie], ["_t", "_x", "_y"], time_bucket(us, chunk_s), "next")
    dt = (F.col("next__t") - F.col("_t")) / 1e6
    step = F.hypot(F.col("next__x") - F.col("_x"), F.col("next__y") - F.col("_y"))
    bound = F.greatest(F.lit(abs_m), mult * F.coalesce(F.abs(F.col(speed)), F.lit(0.0)) * dt)
    flag = F.coalesce((step > bound) & (dt <= max_dt_s) & (dt > 0), F.lit(False))
    return d.withColumn("disc", flag).drop("_t", "_x", "_y", "next__t", "next__x", "next__y")


def motion_signature(df: DataFrame, keys: list[str], us: str, tie: str, chunk: float | str, radius: float,
                     lo_s: float, hi_s: float, cap_level: float = 0.99) -> DataFrame:
    """|v| + R |omega|, omega capped at a high quantile of its positive values."""
    d = angular_rate(df, keys, us, tie, "heading_rad", chunk, None, lo_s, hi_s, "_w")
    d = stored(d.withColumn("omega", F.coalesce(F.abs("_w"), F.lit(0.0))).drop("_w"))
    cap = exact_quantiles(d.filter("omega > 0"), keys, "omega", {"_cap": cap_level})
    d = d.join(cap, keys, "left")
    return (d.withColumn("omega", F.least("omega", F.coalesce("_cap", "omega"))).drop("_cap")
            .withColumn("signature", F.abs("speed") + radius * F.col("omega")))
