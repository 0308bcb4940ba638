"""Exact quantiles and average ranks without collecting a group in one task.

``percentile`` keeps a group's distinct values in one hash map. Here an
approximate pass only steers the work: it brackets the wanted ranks, or cuts a
group into bins of about equal weight. What is returned is exact.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from scanweave.operators.timeline import density_chunks, running_total
from scanweave.session import stored

ACCURACY = 10_000  # percentile_approx is off by at most n / ACCURACY ranks
GRID = 500  # parts of a bracket that is narrowed


def _with_brackets(src: DataFrame, keys: list[str], brackets: DataFrame) -> DataFrame:
    """Rows with the brackets of their key; without keys there is one row of them."""
    if keys:
        return src.join(brackets, keys)
    return src.withColumn("_s", brackets.select(F.struct("*").alias("s")).scalar()).select("_v", "_s.*")


def _inside(i: int) -> Column:
    return (F.col("_v") >= F.col("_lo")[i]) & (F.col("_v") <= F.col("_hi")[i])


def _narrowed(src: DataFrame, keys: list[str], brackets: DataFrame, levels: list[float]) -> DataFrame:
    """Brackets around the same ranks, cut to about five of GRID parts of the rows in them; one reading.

    A bracket of fewer rows than ten a part stays as it is.
    """
    grid = GRID
    d = _with_brackets(src, keys, brackets)
    at = [j / grid for j in range(1, grid)]
    aggs = [F.first("_n").alias("_n"), F.first("_lo").alias("_lo"), F.first("_hi").alias("_hi")]
    for i in range(len(levels)):
        aggs += [F.percentile_approx(F.when(_inside(i), F.col("_v")), at, ACCURACY).alias(f"_q{i}"),
                 F.count_if(_inside(i)).alias(f"_m{i}"), F.count_if(F.col("_v") < F.col("_lo")[i]).alias(f"_b{i}")]
    lo, hi = [], []
    for i, p in enumerate(levels):
        share = (F.lit(p) * (F.col("_n") - 1) - F.col(f"_b{i}")) / F.col(f"_m{i}")
        j = F.floor(share * grid).cast("int")  # between the j-th and the next of the grid's values
        q = F.col(f"_q{i}")
        j = F.when(F.col(f"_m{i}") >= 10 * grid, j)
        lo.append(F.when(j >= 3, F.get(q, j - 3)).otherwise(F.col("_lo")[i]))
        hi.append(F.when(j + 2 < grid - 1, F.get(q, j + 2)).otherwise(F.col("_hi")[i]))
    return d.groupBy(*keys).agg(*aggs).select(*keys, "_n", F.array(*lo).alias("_lo"), F.array(*hi).alias("_hi"))


def exact_quantiles(df: DataFrame, keys: list[str], value: str, probs: dict[str, float], most: int = 1_000_000) -> DataFrame:
    """Linear-interpolation quantiles per key; ``probs`` maps output name to level.

    A first reading brackets each wanted rank between two approximate quantiles
    a safe distance apart (a group of at most ACCURACY rows is its own bracket);
    brackets that may hold more than ``most`` rows are narrowed by further
    readings, each of which leaves about one row in a hundred. The last reading
    counts what lies below and folds the values inside, both before the shuffle:
    no other row travels, and no task ranks more than ``most`` values a level.
    A rank outside its bracket, which would mean a broken sketch, is an error.
    """
    src = df.select(*keys, F.col(value).cast("double").alias("_v")).filter("_v IS NOT NULL")
    levels, safe = list(probs.values()), 3 / ACCURACY
    edges = [e for p in levels for e in (max(p - safe, 0.0), min(p + safe, 1.0))]
    first = src.groupBy(*keys).agg(F.percentile_approx("_v", edges, ACCURACY).alias("_c"), F.min("_v").alias("_min"),
                                   F.max("_v").alias("_max"), F.count("*").alias("_n"))
    small = F.col("_n") <= ACCURACY
    lo = [F.when(small | F.lit(p - safe <= 0), F.col("_min")).otherwise(F.get("_c", F.lit(2 * i))) for i, p in enumerate(levels)]
    hi = [F.when(small | F.lit(p + safe >= 1), F.col("_max")).otherwise(F.get("_c", F.lit(2 * i + 1))) for i, p in enumerate(levels)]
    brackets = stored(first.select(*keys, "_n", F.array(*lo).alias("_lo"), F.array(*hi).alias("_hi")))
    top = brackets.agg(F.max("_n")).first()[0] or 0
    held = top if top <= ACCURACY else 2 * safe * top
    while held > most:
        brackets = stored(_narrowed(src, keys, brackets, levels))
        held /= 100
    d = _with_brackets(src, keys, brackets)
    near = _inside(0)
    for i in range(1, len(levels)):
        near = near | _inside(i)
    g = d.groupBy(*keys, F.when(near, F.col("_v")).alias("_g")).agg(F.count("*").alias("_k"), *[
        F.count_if(F.col("_v") < F.col("_lo")[i]).alias(f"_b{i}") for i in range(len(levels))], *[
        F.coalesce(F.bool_or(_inside(i)), F.lit(False)).alias(f"_in{i}") for i in range(len(levels))])
    whole = Window.partitionBy(*keys)
    run = whole.orderBy("_g").rowsBetween(Window.unboundedPreceding, 0)
    cols = [F.sum("_k").over(whole).alias("_n")]
    for i in range(len(levels)):
        last = F.sum(f"_b{i}").over(whole) + F.sum(F.when(F.col(f"_in{i}"), F.col("_k")).otherwise(0)).over(run)
        cols.append(last.alias(f"_last{i}"))
    g = g.select(*keys, "_g", "_k", *[f"_in{i}" for i in range(len(levels))], *cols)
    out = []
    for i, (name, p) in enumerate(probs.items()):
        pos = F.lit(p) * (F.col("_n") - 1)
        last = F.col(f"_last{i}")
        at = lambda r: F.max(F.when(F.col(f"_in{i}") & (r >= last - F.col("_k")) & (r < last), F.col("_g")))
        a, b = at(F.floor(pos)), at(F.ceil(pos))
        missed = F.when(F.max("_n") > 0, F.raise_error(F.lit(f"a rank of {name} lies outside its bracket")).cast("double"))
        a, b = F.coalesce(a, missed), F.coalesce(b, missed)
        out.append((a + (b - a) * F.max(pos - F.floor(pos))).alias(name))
    return g.groupBy(*keys).agg(*out)  # without keys and rows one row of nulls


def values_at(df: DataFrame, wanted: list[tuple[int, int]], most: int = 100_000) -> list[tuple[float, int]]:
    """The value at each (group, rank from 1) of ``df(_g, _v)`` without nulls, and how many rows of the group lie below it.

    A reading counts the rows in and below the bracket of each rank, the next one narrows brackets of over ``most``
    rows between approximate quantiles. Values inside the last brackets are folded to counts and ranked exactly.
    For a few ranks: a few numbers of each reach the driver.
    """
    inside = lambda k: (F.col("_g") == wanted[k][0]) & ((F.col("_v") >= lo[k]) & (F.col("_v") <= hi[k]) if k in lo else F.lit(True))
    lo, hi, fixed = {}, {}, set()
    every = range(len(wanted))
    while True:
        counts = df.agg(*[F.count_if(inside(k)).alias(f"m{k}") for k in every], *[
            F.count_if((F.col("_g") == wanted[k][0]) & (F.col("_v") < lo[k]) if k in lo else F.lit(False)).alias(f"b{k}") for k in every]).first()
        m, below = [counts[f"m{k}"] for k in every], [counts[f"b{k}"] for k in every]
        missed = [k for k in every if not below[k] < wanted[k][1] <= below[k] + m[k]]
        if any(k not in lo for k in missed):
            raise ValueError("a group has fewer rows than a rank wanted of it")
        if missed:  # a sketch that was off: all rows of the group are ranked
            for k in missed:
                del lo[k], hi[k]
            fixed.update(missed)
            continue
        wide = [k for k in every if m[k] > most and k not in fixed and not (k in lo and lo[k] == hi[k])]
        if not wide:
            break
        share = {k: (wanted[k][1] - below[k] - 0.5) / m[k] for k in wide}
        got = df.agg(*[F.percentile_approx(F.when(inside(k), F.col("_v")), [max(share[k] - 3 / ACCURACY, 0.0), min(share[k] + 3 / ACCURACY, 1.0)],
                                           ACCURACY).alias(f"q{k}") for k in wide]).first()
        for k in wide:
            new = tuple(got[f"q{k}"])
            if k in lo and new == (lo[k], hi[k]):
                fixed.add(k)
            lo[k], hi[k] = new
    out = {k: (lo[k], below[k]) for k in every if k in lo and lo[k] == hi[k]}
    rest = [k for k in every if k not in out]
    if rest:
        d = df.select("_v", F.explode(F.array_compact(F.array(*[F.when(inside(k), F.lit(k)) for k in rest]))).alias("_k"))
        d = d.groupBy("_k", "_v").agg(F.count("*").alias("_n"))
        upto = F.sum("_n").over(Window.partitionBy("_k").orderBy("_v").rowsBetween(Window.unboundedPreceding, 0))
        need = F.coalesce(*[F.when(F.col("_k") == k, F.lit(wanted[k][1] - below[k])) for k in rest])
        d = d.withColumn("_up", upto).filter((F.col("_up") >= need) & (F.col("_up") - F.col("_n") < need))
        out |= {r["_k"]: (r["_v"], below[r["_k"]] + r["_up"] - r["_n"]) for r in d.collect()}
    return [out[k] for k in every]


def average_ranks(counts: DataFrame, keys: list[str], value: str, weight: str, name: str) -> DataFrame:
    """(keys, value, average rank) from the number of rows of each distinct value; copies share one rank.

    ``counts`` has a row a distinct value and should be stored. Groups with very
    many values are cut in parts of even density, and a part's offset is the
    running total of the parts before it.
    """
    d = density_chunks(counts.select(*keys, value, weight), keys, value, "_ck")
    d = running_total(d, keys, [value], weight, "_ck", "_cum")
    return d.select(*keys, value, (F.col("_cum") - (F.col(weight) - 1) / 2).alias(name))
