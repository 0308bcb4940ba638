"""Checks that return their findings as rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.types import StructType

from scanweave.functions.exprs import near


def schema_violations(df: DataFrame, want: StructType) -> DataFrame:
    """Missing, extra, misplaced and mistyped columns."""
    have = {f.name: (i, f.dataType.simpleString()) for i, f in enumerate(df.schema)}
    rows = []
    for i, f in enumerate(want):
        if f.name not in have:
            rows.append((f.name, "missing"))
            continue
        if have[f.name][0] != i:
            rows.append((f.name, "order"))
        if have[f.name][1] != f.dataType.simpleString():
            rows.append((f.name, "type"))
    rows += [(c, "extra") for c in have if c not in want.names]
    return df.sparkSession.createDataFrame(rows, "column string, problem string")


def key_density(df: DataFrame, key: str) -> DataFrame:
    """Whether the key is unique and runs 0..n-1 without holes."""
    r = df.groupBy(key).agg(F.count("*").alias("c"))
    return r.agg(F.sum("c").alias("n_rows"), F.count("*").alias("n_keys"), F.min(key).alias("lo"), F.max(key).alias("hi")).select(
        "n_rows", "n_keys", "lo", "hi", ((F.col("n_rows") == F.col("n_keys")) & (F.col("lo") == 0) & (F.col("hi") == F.col("n_rows") - 1)).alias("ok"))


def unique_join(left: DataFrame, right: DataFrame, key: str) -> DataFrame:
    """Left join that fails when the key is not unique on both sides."""
    for side, d in (("left", left), ("right", right)):
        if d.groupBy(key).count().filter("count > 1").limit(1).count():
            raise ValueError(f"{key} is not unique on the {side} side")
    return left.join(right, key, "left")


def payload_differences(left: DataFrame, right: DataFrame, keys: list[str], columns: list[str]) -> DataFrame:
    """Per left key: found, and per column whether any row of the key matches within tolerance.

    Copies are folded on both sides first, so a key with many equal rows does
    not multiply.
    """
    r = right.select(*keys, *[F.col(c).alias(f"_{c}") for c in columns]).distinct().withColumn("_hit", F.lit(True))
    j = left.select(*keys, *columns).distinct().join(r, keys, "left")
    return j.groupBy(*keys).agg(F.bool_or(F.coalesce("_hit", F.lit(False))).alias("found"),
                                *[F.bool_or(F.coalesce("_hit", F.lit(False)) & near(c, f"_{c}")).alias(f"ok_{c}") for c in columns])


def group_constants(df: DataFrame, keys: list[str], value: str, reference: DataFrame) -> DataFrame:
    """Whether a value is constant in each group and equals the reference."""
    g = df.groupBy(*keys).agg(F.min(value).alias("lo"), F.max(value).alias("hi"))
    return g.join(reference, keys, "left").withColumn(
        "ok", F.coalesce((F.col("lo") == F.col("hi")) & near("lo", "reference"), F.lit(False)))


def expected_counts(df: DataFrame, keys: list[str], expected: DataFrame) -> DataFrame:
    """Counts per group against an expectation table; groups of either side are kept."""
    n = df.groupBy(*keys).agg(F.count("*").alias("n"))
    j = n.join(expected, keys, "full").fillna(0, ["n", "expected"])
    return j.withColumn("ok", F.col("n") == F.col("expected"))


def same_keys(a: DataFrame, b: DataFrame) -> DataFrame:
    """Whether two key tables hold the same rows, copies counted."""
    cols = a.columns
    d = a.withColumn("_s", F.lit(1)).unionByName(b.withColumn("_s", F.lit(-1))).groupBy(*cols).agg(F.sum("_s").alias("d"))
    return d.agg(F.coalesce(F.sum(F.when(F.col("d") > 0, F.col("d"))), F.lit(0)).alias("only_a"),
                 F.coalesce(F.sum(F.when(F.col("d") < 0, -F.col("d"))), F.lit(0)).alias("only_b")).withColumn(
        "equal", (F.col("only_a") == 0) & (F.col("only_b") == 0))


def column_profile(df: DataFrame, keys: list[str], columns: list[str]) -> DataFrame:
    """Extent, mean, missing count per column over finite values; one aggregate, then unpivoted."""
    from scanweave.functions.exprs import finite
    aggs = []
    for c in columns:
        v = F.when(finite(c), F.col(c).cast("double"))
        aggs.append(F.struct(F.lit(c).alias("column"), F.count("*").alias("n"), F.count(v).alias("n_finite"),
                             F.min(v).alias("lo"), F.max(v).alias("hi"), F.avg(v).alias("mean")))
    return df.groupBy(*keys).agg(F.array(*aggs).alias("_a")).select(*keys, F.inline("_a"))


def count_where(df: DataFrame, keys: list[str], conditions: dict[str, Column]) -> DataFrame:
    return df.groupBy(*keys).agg(F.count("*").alias("n"), *[F.count_if(c).alias(k) for k, c in conditions.items()])
