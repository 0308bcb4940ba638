"""Order-dependent operators that survive hot keys.

A window partitioned by a session alone runs one session in one task. Every
function here windows over (keys, chunk) and repairs the chunk borders from a
per-chunk summary, so a key that holds a third of all rows is spread over all
its chunks. ``chunk`` must grow with the sort order: a chunk of about equally many
rows (``density_chunks``), a time bucket of the sort clock
(``exprs.time_bucket``), or ``range_chunks`` where even one instant of one key
may be hot. The summary has one row per (keys, chunk).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from scanweave.functions.exprs import col
from scanweave.session import ensure_checkpoint_dir, stored

CHUNK = "_chunk"
LEAST_ROWS = 4096  # smaller chunks cost more than they spread
MOST_CUTS = 4096   # cut points of one key


def density_cuts(df: DataFrame, keys: list[str], order: str, rows_each: int | None = None) -> DataFrame | None:
    """(keys, _cuts): points that cut each hot key's ``order`` into parts of about ``rows_each`` rows; None without one.

    By default a part is a quarter of what a shuffle partition would hold, so
    parts grow in number with data and cluster. Only keys of more rows than one
    part are listed, which bounds the table by rows / rows_each keys and about as
    many points. It is stored: every later use sees the same points, although the
    sketch they come from depends on the order in which tasks finish.
    """
    spark = df.sparkSession
    n = df.groupBy(*keys).agg(F.count("*").alias("_n"))
    if rows_each is None:
        parts = max(64, 4 * int(spark.conf.get("spark.sql.shuffle.partitions")))
        total, top = n.agg(F.sum("_n"), F.max("_n")).first()
        rows_each = max(LEAST_ROWS, -(-(total or 0) // parts))
    else:
        top = n.agg(F.max("_n")).first()[0]
    if (top or 0) <= rows_each:
        return None
    levels = min(MOST_CUTS, -(-top // rows_each))
    hot = n.filter(F.col("_n") > rows_each)
    part = df.select(*keys, F.col(order).alias("_o"))
    part = part.join(F.broadcast(hot), keys) if keys else part.withColumn("_n", F.lit(top))
    cuts = part.groupBy(*keys).agg(F.max("_n").alias("_n"), F.percentile_approx(
        "_o", [i / levels for i in range(1, levels)], 4 * levels).alias("_c"))
    # a smaller key takes every so many-th point only
    every = F.greatest(F.lit(1), F.floor(levels * rows_each / F.col("_n"))).cast("int")
    return stored(cuts.select(*keys, F.array_distinct(F.filter("_c", lambda x, i: (i + 1) % every == 0)).alias("_cuts")))


def points_below(cuts: Column, value: Column, most: int = MOST_CUTS) -> Column:
    """How many of the ascending ``cuts`` are at most ``value``, by halving."""
    def halve(s, _):
        mid = F.floor((s["lo"] + s["hi"]) / 2).cast("int")
        up = F.get(cuts, mid) <= value
        open_ = s["lo"] < s["hi"]
        return F.struct(F.when(open_ & up, mid + 1).otherwise(s["lo"]).alias("lo"),
                        F.when(open_ & ~up, mid).otherwise(s["hi"]).alias("hi"))

    start = F.struct(F.lit(0).alias("lo"), F.size(cuts).alias("hi"))
    return F.aggregate(F.sequence(F.lit(0), F.lit(most.bit_length())), start, halve, lambda s: s["lo"]).cast("long")


def with_chunks(df: DataFrame, keys: list[str], order: str, cuts: DataFrame | None, name: str, apart: bool = False) -> DataFrame:
    """``df`` with the number of each row's part; rows of one ``order`` value share a part.

    With ``apart`` the rows of a cut point itself are a part of their own, with an even number.
    """
    if cuts is None:
        return df.withColumn(name, F.lit(int(apart)).cast("long"))
    d = df.join(F.broadcast(cuts), keys, "left") if keys else df.withColumn("_cuts", cuts.select("_cuts").scalar())
    below = F.coalesce(points_below(F.col("_cuts"), F.col(order)), F.lit(0))
    if apart:
        d = d.withColumn("_b", below)
        below = 2 * F.col("_b") + F.when(F.get("_cuts", (F.col("_b") - 1).cast("int")) == F.col(order), 0).otherwise(1)
    return d.withColumn(name, below.cast("long")).select(*df.columns, name)


def density_chunks(df: DataFrame, keys: list[str], order: str, name: str = "_ck", rows_each: int | None = None,
                   tie: str | None = None) -> DataFrame:
    """``df`` with chunks of about equally many rows along ``order``, also where rows crowd at some times.

    A value of ``order`` that fills chunks by itself is cut along ``tie``, if there is one.
    """
    cuts = density_cuts(df, keys, order, rows_each)
    if tie is None or cuts is None:
        return with_chunks(df, keys, order, cuts, name)
    d = with_chunks(df, keys, order, cuts, "_own", apart=True)
    inner = density_cuts(d.filter("_own % 2 = 0"), [*keys, "_own"], tie, rows_each)
    d = with_chunks(d, [*keys, "_own"], tie, inner, "_sub")
    return d.withColumn(name, F.col("_own") * (2 * MOST_CUTS) + F.col("_sub")).select(*df.columns, name)


def range_chunks(df: DataFrame, keys: list[str], order: list[str], n: int,
                 name: str = "chunk_id") -> DataFrame:
    """Evenly filled chunks along (keys, order), cut inside ties as well.

    The range bounds are sampled, so the labelled table is checkpointed: every
    later use reads the same labels, also after an executor is lost.
    """
    ensure_checkpoint_dir(df.sparkSession)
    return (df.repartitionByRange(n, *keys, *order)
            .withColumn(name, F.spark_partition_id().cast("long")).checkpoint())


def _over(keys, order):
    return Window.partitionBy(*keys).orderBy(*order)


def neighbours(df: DataFrame, keys: list[str], order: list[str], values: list[str],
               chunk: str | Column, sides: str = "prev", label: str | Column | None = None,
               island: str = "island") -> DataFrame:
    """Values of the previous and/or next row as ``prev_<v>`` / ``next_<v>``.

    With ``label`` the maximal runs of equal label (null is a label too) are
    numbered as ``island`` in the same pass.
    """
    prev, nxt = "prev" in sides, "next" in sides
    d = df.withColumn(CHUNK, col(chunk))
    part = [*keys, CHUNK]
    w, kw = _over(part, order), _over(keys, [CHUNK])
    row, pos = F.struct(*values) if values else F.struct(F.lit(1).alias("_one")), F.struct(*order)
    if label is not None:
        d = d.withColumn("_lab", F.struct(col(label).alias("v")))
        d = d.withColumn("_c", F.when(F.lag("_lab").over(w).eqNullSafe(F.col("_lab")), 0).otherwise(1))
    aggs = [F.min_by(row, pos).alias("_first"), F.max_by(row, pos).alias("_last")]
    if label is not None:
        aggs += [F.min_by("_lab", pos).alias("_lab0"), F.max_by("_lab", pos).alias("_lab1"), F.sum("_c").alias("_m")]
    edges = d.groupBy(*part).agg(*aggs)
    cols = [F.lag("_last").over(kw).alias("_cprev"), F.lead("_first").over(kw).alias("_cnext")]
    if label is not None:
        edges = edges.withColumn("_merge", F.when(F.lag("_lab1").over(kw).eqNullSafe(F.col("_lab0")), 1).otherwise(0))
        before = kw.rowsBetween(Window.unboundedPreceding, -1)
        cols.append((F.coalesce(F.sum(F.col("_m") - F.col("_merge")).over(before), F.lit(0))
                     - F.col("_merge")).alias("_off"))
    edges = edges.select(*part, *cols)
    if prev:
        d = d.withColumn("_p", F.lag(row).over(w))
    if nxt:
        d = d.withColumn("_n", F.lead(row).over(w))
    if label is not None:
        d = d.withColumn("_loc", F.sum("_c").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    d = d.join(edges, part, "left")
    out = [F.col(c) for c in df.columns]
    if prev:
        p = F.coalesce("_p", "_cprev")
        out += [p.getField(v).alias(f"prev_{v}") for v in values]
    if nxt:
        n = F.coalesce("_n", "_cnext")
        out += [n.getField(v).alias(f"next_{v}") for v in values]
    if label is not None:
        out.append((F.col("_off") + F.col("_loc")).alias(island))
    return d.select(*out)


def running_total(df: DataFrame, keys: list[str], order: list[str], value: str | Column,
                  chunk: str | Column, name: str, total: str | None = None) -> DataFrame:
    """Inclusive running sum of an integer value, and optionally the key's total."""
    d = df.withColumn(CHUNK, col(chunk)).withColumn("_v", col(value).cast("long"))
    part = [*keys, CHUNK]
    sums = d.groupBy(*part).agg(F.sum("_v").alias("_s"))
    before = _over(keys, [CHUNK]).rowsBetween(Window.unboundedPreceding, -1)
    sums = sums.select(*part, F.coalesce(F.sum("_s").over(before), F.lit(0)).alias("_base"),
                       F.sum("_s").over(Window.partitionBy(*keys)).alias("_total"))
    inside = _over(part, order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    d = d.withColumn("_run", F.sum("_v").over(inside)).join(sums, part, "left")
    out = [F.col(c) for c in df.columns] + [(F.col("_base") + F.col("_run")).alias(name)]
    if total:
        out.append(F.col("_total").alias(total))
    return d.select(*out)


def row_position(df: DataFrame, keys: list[str], order: list[str], chunk: str | Column,
                 name: str = "rn", total: str = "n") -> DataFrame:
    """1-based position in the key's order, and the key's row count."""
    return running_total(df, keys, order, F.lit(1), chunk, name, total)


def last_known(df: DataFrame, keys: list[str], order: list[str], value: str,
               chunk: str | Column, name: str, ahead: bool = False) -> DataFrame:
    """Latest non-null value up to the row, or with ``ahead`` the first one from it on."""
    d = df.withColumn(CHUNK, col(chunk))
    part = [*keys, CHUNK]
    pos = F.struct(*order)
    present = F.when(F.col(value).isNotNull(), pos)
    pick = F.min_by(value, present) if ahead else F.max_by(value, present)
    edge = d.groupBy(*part).agg(pick.alias("_e"))
    ks, ps = ", ".join(keys) or "1", ", ".join(part)
    step = "lead" if ahead else "lag"
    edge = edge.select(*part, F.expr(
        f"{step}(_e) IGNORE NULLS OVER (PARTITION BY {ks} ORDER BY {CHUNK})").alias("_carry"))
    inner = F.expr(f"{step}({value}) IGNORE NULLS OVER (PARTITION BY {ps} "
                   f"ORDER BY {', '.join(order)})")
    d = d.withColumn("_i", inner).join(edge, part, "left")
    return d.select(*df.columns, F.coalesce(F.col(value), F.col("_i"), F.col("_carry")).alias(name))


def islands(df: DataFrame, keys: list[str], order: list[str], label: str | Column,
            chunk: str | Column, name: str = "island") -> DataFrame:
    """Number the maximal runs of equal ``label``."""
    return neighbours(df, keys, order, [], chunk, "", label, name)


def ordered_pairs(summary: DataFrame, key: str) -> DataFrame:
    """Every pair of rows with a lower and a higher key, columns suffixed ``_a`` and ``_b``.

    For summary tables with one row per key: each row names the ranks of its
    partners, and partners meet by an equality join.
    """
    w, every = Window.orderBy(key), Window.partitionBy(F.lit(1))
    d = summary.withColumn("_i", F.row_number().over(w)).withColumn("_n", F.count("*").over(every).cast("int"))
    side = lambda s: [F.col(c).alias(f"{c}_{s}") for c in summary.columns]
    a = d.filter("_i < _n").select(*side("a"), F.explode(F.sequence(F.col("_i") + 1, F.col("_n"))).alias("_i"))
    return a.join(d.select(*side("b"), "_i"), "_i").drop("_i")
