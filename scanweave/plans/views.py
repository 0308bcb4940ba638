"""Input views shared by the registered queries, in Spark and as SQL text."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from scanweave.functions.exprs import micros


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def events(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "events").withColumn("us", micros("ts"))


def telemetry(spark: SparkSession, sf: str) -> DataFrame:
    """Vehicle-like telemetry derived from the event stream."""
    e = F.col("event_id")
    d = events(spark, sf).select(
        e.alias("joint_idx"), F.concat(F.lit("s"), (F.col("user_id") % 3).cast("string")).alias("session_id"),
        F.col("user_id").alias("run_id"), "ts", "us", "event_type", "value",
        (F.col("value") / 100).alias("speed"),
        (((e * 37) % 400).cast("double") / 20).alias("x_m"),
        (((e * 53) % 240).cast("double") / 20).alias("y_m"),
        (((e * 29) % 628).cast("double") / 100 - F.lit(3.14)).alias("heading_rad"),
        F.when(e % 50 != 0, ((e * 17) % 101).cast("double")).alias("confidence"))
    return d.withColumn("signal", F.lit(-30.0) - 12.0 * F.log10(F.greatest(
        F.sqrt((F.col("x_m") - 5) * (F.col("x_m") - 5) + (F.col("y_m") - 5) * (F.col("y_m") - 5)),
        F.lit(0.05))) + (F.col("value") - 50) / 10)


TEL = """
base AS (SELECT event_id AS joint_idx, 's' || CAST(user_id % 3 AS VARCHAR) AS session_id,
  user_id AS run_id, ts, epoch_us(ts) AS us, event_type, value, value/100 AS speed,
  CAST((event_id*37) % 400 AS DOUBLE)/20 AS x_m, CAST((event_id*53) % 240 AS DOUBLE)/20 AS y_m,
  CAST((event_id*29) % 628 AS DOUBLE)/100 - CAST(3.14 AS DOUBLE) AS heading_rad,
  CASE WHEN event_id % 50 = 0 THEN NULL ELSE CAST((event_id*17) % 101 AS DOUBLE) END AS confidence
  FROM events),
tel AS (SELECT base.*, CAST(-30 AS DOUBLE) - CAST(12 AS DOUBLE)*log10(greatest(
  sqrt((x_m-5)*(x_m-5)+(y_m-5)*(y_m-5)), CAST(0.05 AS DOUBLE))) + (value-50)/10 AS signal FROM base)"""


def scan(spark: SparkSession, sf: str) -> DataFrame:
    """Range scans of 64 slots in millimetres; 0 and 65535 are sentinels."""
    return table(spark, sf, "embeddings").select(
        F.col("vec_id").alias("scan_row"), "label", F.expr(
            "transform(embedding, (e, i) -> CASE WHEN (vec_id*64+i) % 17 = 0 THEN 0 "
            "WHEN (vec_id*64+i) % 23 = 0 THEN 65535 "
            "ELSE CAST(floor(abs(CAST(e AS DOUBLE))*20000) AS INT) END)").alias("distances"))


SCAN = """
scan AS (SELECT vec_id AS scan_row, label, list_transform(embedding, lambda e, i:
  CASE WHEN (vec_id*64+i-1) % 17 = 0 THEN 0 WHEN (vec_id*64+i-1) % 23 = 0 THEN 65535
       ELSE CAST(floor(abs(CAST(e AS DOUBLE))*20000) AS INT) END) AS distances FROM embeddings),
beam AS (SELECT scan_row, label, generate_subscripts(distances, 1) - 1 AS slot,
  unnest(distances) AS mm FROM scan)"""


def joint(spark: SparkSession, sf: str) -> DataFrame:
    """Telemetry with the scan each row refers to."""
    n = table(spark, sf, "embeddings").select(F.count("*")).scalar()
    t = telemetry(spark, sf).withColumn("scan_row", F.col("joint_idx") % n)
    return t.join(scan(spark, sf).drop("label"), "scan_row")


JOINT = TEL + "," + SCAN + """,
joint AS (SELECT t.*, s.scan_row, s.distances FROM tel t
  CROSS JOIN (SELECT count(*) AS n_scan FROM embeddings) c
  JOIN scan s ON s.scan_row = t.joint_idx % c.n_scan)"""

# Transmitter position per session.
TRANSMITTERS = [("s0", 5.0, 5.0), ("s1", 8.0, 4.0), ("s2", 3.0, 7.0)]


def transmitters(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(TRANSMITTERS, "session_id string, ap_x double, ap_y double")


AP = """
ap AS (SELECT * FROM (VALUES ('s0', CAST(5 AS DOUBLE), CAST(5 AS DOUBLE)),
  ('s1', CAST(8 AS DOUBLE), CAST(4 AS DOUBLE)), ('s2', CAST(3 AS DOUBLE), CAST(7 AS DOUBLE)))
  v(session_id, ap_x, ap_y))"""
