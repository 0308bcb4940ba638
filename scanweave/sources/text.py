"""Ragged delimited text: width census, tolerant parsing, typing, provenance."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from scanweave.functions.exprs import parse_flag, parse_number

FLAG_TEXTS = ("True", "False", "true", "false", "")


def read_lines(spark: SparkSession, paths: str | list[str]) -> DataFrame:
    """(line, file) of text files; undecodable bytes become replacement characters."""
    return spark.read.text(paths).select(F.col("value").alias("line"), F.col("_metadata.file_name").alias("file"))


def fields(line: str | Column = "line") -> Column:
    return F.split(line, ",")


def not_blank(df: DataFrame, line: str = "line") -> DataFrame:
    return df.filter(F.trim(line) != "")


def width_census(df: DataFrame, keys: list[str], keep: list[int], line: str = "line") -> DataFrame:
    """Lines per field count and whether that width is kept."""
    return (not_blank(df, line).groupBy(*keys, F.size(fields(line)).cast("long").alias("n_fields"))
            .agg(F.count("*").alias("n_lines")).withColumn("kept", F.col("n_fields").isin(keep)))


def parse_ragged(df: DataFrame, layouts: dict[int, list[str]], line: str = "line") -> DataFrame:
    """One string column per name over all layouts; absent fields are null.

    Lines whose field count has no layout are dropped.
    """
    names = max(layouts.values(), key=len)
    d = not_blank(df, line).withColumn("_f", fields(line)).withColumn("_n", F.size("_f"))
    d = d.filter(F.col("_n").isin(list(layouts)))

    def at(name):
        out = F.lit(None).cast("string")
        for width, cols in layouts.items():
            if name in cols:
                out = F.when(F.col("_n") == width, F.get("_f", F.lit(cols.index(name)))).otherwise(out)
        return out.alias(name)

    return d.select(*[c for c in df.columns if c != line], *[at(n) for n in names])


def flag_columns(df: DataFrame, columns: list[str]) -> list[str]:
    """Columns whose every present value is a truth text; decided over the whole table."""
    row = df.agg(*[F.bool_and(F.trim(c).isin(*FLAG_TEXTS)).alias(c) for c in columns]).first()
    return [c for c in columns if row[c]]


def coerce_types(df: DataFrame, columns: list[str]) -> DataFrame:
    """Flags become booleans (blank is false), everything else numbers or null."""
    flags = set(flag_columns(df, columns))
    return df.withColumns({c: parse_flag(c) if c in flags else parse_number(c) for c in columns})


def merge_files(parts: dict[tuple[str, str], DataFrame], ts: str, front: list[str]) -> DataFrame:
    """Union of files with session and file as provenance, a parsed clock and an epoch key."""
    out = None
    for (session, file), d in parts.items():
        d = d.withColumns({"session_date": F.lit(session), "run_file": F.lit(file), "ts_str": F.col(ts),
                           "ts": F.col(ts).try_cast("timestamp_ntz")})
        out = d if out is None else out.unionByName(d, allowMissingColumns=True)
    out = out.withColumn("ts_unix", F.unix_micros(F.col("ts").cast("timestamp")) / 1e6)
    return out.select(*front, *[c for c in out.columns if c not in front])


def manifest(df: DataFrame, keys: list[str], kept: str) -> DataFrame:
    """Row range of every file in key order. One row per file, so one window is enough."""
    from pyspark.sql import Window
    m = df.groupBy(*keys).agg(F.count("*").alias("n_rows"), F.count_if(F.col(kept)).alias("n_kept"))
    w = Window.orderBy(*keys).rowsBetween(Window.unboundedPreceding, 0)
    stop = F.sum("n_kept").over(w)
    return m.select(*keys, "n_rows", "n_kept", (F.col("n_rows") - F.col("n_kept")).alias("n_dropped"),
                    (stop - F.col("n_kept")).alias("start_row"), stop.alias("stop_row"))


def constant_columns(df: DataFrame) -> dict[str, object]:
    """Columns with at most one distinct present value and no mix with null.

    Minimum and maximum decide it in one pass, whatever the width.
    """
    aggs = []
    for c in df.columns:
        aggs += [F.min(c).alias(f"lo_{c}"), F.max(c).alias(f"hi_{c}"), F.count(c).alias(f"n_{c}")]
    r = df.agg(F.count("*").alias("n"), *aggs).first()
    return {c: r[f"lo_{c}"] for c in df.columns
            if r[f"n_{c}"] == 0 or (r[f"lo_{c}"] == r[f"hi_{c}"] and r[f"n_{c}"] == r["n"])}


def drop_constant(df: DataFrame) -> DataFrame:
    return df.drop(*constant_columns(df))
