"""Ragged text, typing, manifests, sinks, digests and unions."""

from __future__ import annotations

from pyspark.sql import functions as F, types as T

from scanweave.functions.exprs import rnd
from scanweave.plans.registry import query
from scanweave.plans.views import TEL, events, telemetry
from scanweave.sources import tables, text

WIDE = ["ts", "w1", "w2", "flag", "a", "b", "c", "note"]
NARROW = ["ts", "flag", "a", "b", "c", "note"]
LINES = """
lines AS (SELECT event_id, 'f' || CAST(event_id % 4 AS VARCHAR) AS file, CASE
  WHEN event_id % 41 = 0 THEN 'warmup' WHEN event_id % 43 = 0 THEN '   ' WHEN event_id % 47 = 0 THEN concat_ws(',', 'x', 'y', 'z', 'q', 'r')
  WHEN event_id % 3 = 0 THEN concat_ws(',', strftime(ts, '%Y-%m-%d %H:%M:%S'), CASE WHEN event_id % 2 = 0 THEN 'True' ELSE 'False' END, event_id % 97, CASE WHEN event_id % 5 = 0 THEN '' ELSE CAST(user_id AS VARCHAR) END, 7, event_type)
  ELSE concat_ws(',', CASE WHEN event_id % 11 = 0 THEN 'bad' ELSE strftime(ts, '%Y-%m-%d %H:%M:%S') END, user_id*2, event_id % 13, CASE WHEN event_id % 2 = 0 THEN 'true' ELSE '' END, event_id % 97, user_id, 7, event_type) END AS line FROM events),
sp AS (SELECT *, string_split(line, ',') AS f FROM lines WHERE trim(line) <> '')"""
PARSED = LINES + """,
parsed AS (SELECT event_id, file, f[1] AS ts, CASE WHEN len(f) = 8 THEN f[2] END AS w1, CASE WHEN len(f) = 8 THEN f[3] END AS w2, CASE WHEN len(f) = 8 THEN f[4] ELSE f[2] END AS flag,
  CASE WHEN len(f) = 8 THEN f[5] ELSE f[3] END AS a, CASE WHEN len(f) = 8 THEN f[6] ELSE f[4] END AS b, CASE WHEN len(f) = 8 THEN f[7] ELSE f[5] END AS c, CASE WHEN len(f) = 8 THEN f[8] ELSE f[6] END AS note
  FROM sp WHERE len(f) IN (8, 6))"""


def lines(spark, sf):
    e = events(spark, sf)
    i, u = F.col("event_id"), F.col("user_id").cast("string")
    stamp = F.date_format("ts", "yyyy-MM-dd HH:mm:ss")
    s = lambda c: c.cast("string")
    line = (F.when(i % 41 == 0, "warmup").when(i % 43 == 0, "   ").when(i % 47 == 0, "x,y,z,q,r")
            .when(i % 3 == 0, F.concat_ws(",", stamp, F.when(i % 2 == 0, "True").otherwise("False"), s(i % 97),
                                          F.when(i % 5 == 0, "").otherwise(u), F.lit("7"), "event_type"))
            .otherwise(F.concat_ws(",", F.when(i % 11 == 0, "bad").otherwise(stamp), s(F.col("user_id") * 2), s(i % 13),
                                   F.when(i % 2 == 0, "true").otherwise(""), s(i % 97), u, F.lit("7"), "event_type")))
    return e.select("event_id", F.concat(F.lit("f"), s(i % 4)).alias("file"), line.alias("line"))


def parsed(spark, sf):
    return text.parse_ragged(lines(spark, sf), {8: WIDE, 6: NARROW})


@query("s01_ragged_text_parse", f"WITH {PARSED} SELECT * FROM parsed")
def s01(spark, sf):
    return parsed(spark, sf)


@query("s02_line_width_census", f"WITH {LINES} SELECT file, CAST(len(f) AS BIGINT) AS n_fields, count(*) AS n_lines, len(f) IN (8, 6) AS kept FROM sp GROUP BY ALL")
def s02(spark, sf):
    return text.width_census(lines(spark, sf), ["file"], [8, 6])


TYPED = PARSED + """,
typed AS (SELECT event_id, file, ts, coalesce(lower(trim(flag)) = 'true', false) AS flag, TRY_CAST(trim(w1) AS DOUBLE) AS w1, TRY_CAST(trim(w2) AS DOUBLE) AS w2,
  TRY_CAST(trim(a) AS DOUBLE) AS a, TRY_CAST(trim(b) AS DOUBLE) AS b, TRY_CAST(trim(c) AS DOUBLE) AS c, TRY_CAST(note AS DOUBLE) AS note FROM parsed)"""


def typed(spark, sf):
    return text.coerce_types(parsed(spark, sf), WIDE[1:])


@query("s03_type_coercion", f"WITH {TYPED} SELECT event_id, flag, w1, w2, a, b, c, note FROM typed")
def s03(spark, sf):
    return typed(spark, sf).select("event_id", *WIDE[1:])


@query("s04_multi_file_merge", f"""
WITH {TYPED} SELECT CASE WHEN file IN ('f0', 'f1') THEN 'd1' ELSE 'd2' END AS session_date, file AS run_file, event_id, ts AS ts_str,
  CAST(epoch_us(TRY_CAST(ts AS TIMESTAMP))/1e6 AS DOUBLE) AS ts_unix, a, b, CASE WHEN file <> 'f3' THEN w1 END AS w1 FROM typed""")
def s04(spark, sf):
    t = typed(spark, sf)
    parts = {}
    for f in ("f0", "f1", "f2", "f3"):
        d = t.filter(F.col("file") == f).select("ts", "event_id", "a", "b", *([] if f == "f3" else ["w1"]))
        parts[("d1" if f < "f2" else "d2", f)] = d
    return text.merge_files(parts, "ts", ["session_date", "run_file", "event_id"]).drop("ts")


@query("s05_row_range_manifest", f"""
WITH {LINES}, m AS (SELECT file, count(*) AS n_rows, count(*) FILTER (len(string_split(line, ',')) IN (8, 6)) AS n_kept FROM lines GROUP BY 1)
SELECT file, n_rows, n_kept, n_rows - n_kept AS n_dropped, CAST(sum(n_kept) OVER (ORDER BY file) - n_kept AS BIGINT) AS start_row, CAST(sum(n_kept) OVER (ORDER BY file) AS BIGINT) AS stop_row FROM m""")
def s05(spark, sf):
    d = lines(spark, sf).withColumn("kept", F.size(text.fields()).isin(8, 6))
    return text.manifest(d, ["file"], "kept")


@query("q14_nth_line_lookup", f"""
WITH {PARSED}, n AS (SELECT *, row_number() OVER (PARTITION BY file ORDER BY event_id) AS line_no, count(*) OVER (PARTITION BY file, ts) AS n_same FROM parsed)
SELECT file, line_no, ts, n_same FROM n""")
def q14(spark, sf):
    from scanweave.operators.timeline import row_position
    p = row_position(parsed(spark, sf), ["file"], ["event_id"], F.floor(F.col("event_id") / 100_000), "line_no", "n_lines")
    same = parsed(spark, sf).groupBy("file", "ts").agg(F.count("*").alias("n_same"))
    return p.join(same, ["file", "ts"]).select("file", "line_no", "ts", "n_same")


@query("q11_provenance_against_text", f"""
WITH {TYPED} SELECT file, count(*) AS n, count(*) AS n_found, count(*) AS n_equal FROM typed WHERE a IS NOT NULL GROUP BY 1""")
def q11(spark, sf):
    t = typed(spark, sf).filter("a IS NOT NULL").select("file", "event_id", "a", "b")
    raw = lines(spark, sf).withColumn("f", text.fields()).select("file", "event_id", F.get("f", F.when(F.size("f") == 8, 4).otherwise(2)).try_cast("double").alias("ra"))
    j = t.join(raw, ["file", "event_id"], "left")
    return j.groupBy("file").agg(F.count("*").alias("n"), F.count("ra").alias("n_found"), F.count_if(F.col("a") == F.col("ra")).alias("n_equal"))


@query("f05_drop_constant_columns", f"WITH {TYPED} SELECT event_id, file, ts, flag, w1, w2, a, b FROM typed")
def f05(spark, sf):
    return text.drop_constant(typed(spark, sf))


@query("f06_redundant_column_proof", f"""
WITH {TYPED}, d AS (SELECT file, abs(w1/2 - b) AS e FROM typed) SELECT file, count(e) AS n, max(e) AS max_diff, count(*) FILTER (e > 1e-9) AS n_off, coalesce(max(e) <= 1e-9, false) AS redundant FROM d GROUP BY 1""")
def f06(spark, sf):
    d = typed(spark, sf).withColumn("e", F.abs(F.col("w1") / 2 - F.col("b")))
    return d.groupBy("file").agg(F.count("e").alias("n"), F.max("e").alias("max_diff"), F.count_if(F.col("e") > 1e-9).alias("n_off"),
                                 F.coalesce(F.max("e") <= 1e-9, F.lit(False)).alias("redundant"))


@query("x12_field_value_parse", f"""
WITH {PARSED} SELECT event_id, CASE WHEN trim(flag) = '' THEN NULL WHEN lower(trim(flag)) IN ('true', 'false') THEN lower(trim(flag)) = 'true' END AS as_flag,
  CASE WHEN trim(b) = '' THEN NULL ELSE TRY_CAST(trim(b) AS DOUBLE) END AS as_number FROM parsed""")
def x12(spark, sf):
    f = F.lower(F.trim("flag"))
    return parsed(spark, sf).select("event_id", F.when(f.isin("true", "false"), f == "true").alias("as_flag"),
                                    F.when(F.trim("b") != "", F.trim("b").try_cast("double")).alias("as_number"))


@query("x07_tolerant_timestamps", f"""
WITH {PARSED} SELECT event_id, TRY_CAST(ts AS TIMESTAMP) IS NOT NULL AS ok, epoch_us(TRY_CAST(ts AS TIMESTAMP)) AS us, epoch_us(TRY_CAST(ts AS TIMESTAMP) + INTERVAL 90 SECOND) AS shifted_us FROM parsed""")
def x07(spark, sf):
    t = F.col("ts").try_cast("timestamp_ntz")
    us = lambda c: F.unix_micros(c.cast("timestamp"))
    return parsed(spark, sf).select("event_id", t.isNotNull().alias("ok"), us(t).alias("us"), us(t + F.expr("INTERVAL 90 SECONDS")).alias("shifted_us"))


@query("s07_column_pruned_read", "SELECT event_id, user_id, value FROM events WHERE value > 50")
def s07(spark, sf):
    return tables.read_columns(spark, f"{sf}/events.parquet", ["event_id", "user_id", "value"]).filter("value > 50")


DOC = T.StructType().add("session_id", "string").add("n", "long").add("span", T.StructType().add("lo", "long").add("hi", "long")).add("kinds", T.ArrayType(T.StringType()))


def documents(spark, sf):
    return telemetry(spark, sf).groupBy("session_id").agg(
        F.count("*").alias("n"), F.struct(F.min("us").alias("lo"), F.max("us").alias("hi")).alias("span"), F.array_sort(F.collect_set("event_type")).alias("kinds"))


@query("s10_json_document_round_trip", f"""
WITH {TEL} SELECT session_id, count(*) AS n, min(us) AS lo, max(us) AS hi, array_to_string(list_sort(list(DISTINCT event_type)), ',') AS kinds FROM tel GROUP BY 1""")
def s10(spark, sf):
    path = tables.scratch_path(spark, "documents")
    tables.write_documents(documents(spark, sf), path)
    return tables.read_documents(spark, path, DOC).select("session_id", "n", "span.lo", "span.hi", F.array_join("kinds", ",").alias("kinds"))


@query("x11_json_serialise", f"""
WITH {TEL} SELECT session_id, '{{"n":' || count(*) || ',"span":{{"lo":' || min(us) || ',"hi":' || max(us) || '}},"kinds":["' || array_to_string(list_sort(list(DISTINCT event_type)), '","') || '"]}}' AS json FROM tel GROUP BY 1""")
def x11(spark, sf):
    return documents(spark, sf).select("session_id", F.to_json(F.struct("n", "span", "kinds")).alias("json"))


@query("s11_schema_enforced_parquet", f"WITH {TEL} SELECT joint_idx, session_id, CAST(value AS FLOAT)::DOUBLE AS value, us FROM tel")
def s11(spark, sf):
    path = tables.scratch_path(spark, "table")
    schema = T.StructType().add("joint_idx", "long").add("session_id", "string").add("value", "float").add("us", "long")
    tables.write_table(telemetry(spark, sf), path, schema, ["session_id", "us", "joint_idx"])
    return spark.read.schema(schema).parquet(path).withColumn("value", F.col("value").cast("double"))


@query("s12_report_csv", f"WITH {TEL} SELECT session_id, count(*) AS n, round(avg(value), 4) AS mean FROM tel GROUP BY 1")
def s12(spark, sf):
    path = tables.scratch_path(spark, "report")
    tables.write_report_csv(telemetry(spark, sf).groupBy("session_id").agg(F.count("*").alias("n"), rnd(F.avg("value"), 4).alias("mean")).orderBy("session_id"), path)
    return spark.read.schema("session_id string, n long, mean double").option("header", True).csv(path)


@query("s13_table_digest", f"""
WITH {TEL} SELECT session_id, count(*) AS n_rows, CAST(sum(CAST(('0x' || substr(md5(concat_ws('␟', joint_idx, event_type, us)), 1, 8)) AS UBIGINT)) AS BIGINT) AS digest FROM tel GROUP BY 1""")
def s13(spark, sf):
    return tables.table_digest(telemetry(spark, sf), ["session_id"], ["joint_idx", "event_type", "us"])


@query("s13_file_digests")
def s13f(spark, sf):
    return tables.file_digests(spark, f"{sf}/*.parquet")


SNAP = """
old AS (SELECT run_id, md5(concat_ws('␟', run_id, n)) AS dg FROM (SELECT run_id, count(*) AS n FROM tel WHERE event_type <> 'error' OR x_m < 15 GROUP BY 1) WHERE run_id > 10),
new AS (SELECT run_id, md5(concat_ws('␟', run_id, n)) AS dg FROM (SELECT run_id, count(*) AS n FROM tel GROUP BY 1) WHERE run_id < 140)"""


@query("s14_snapshot_diff", f"""
WITH {TEL}, {SNAP} SELECT coalesce(o.run_id, n.run_id) AS run_id, CASE WHEN o.dg IS NULL THEN 'added' WHEN n.dg IS NULL THEN 'removed' WHEN o.dg <> n.dg THEN 'modified' ELSE 'same' END AS state
FROM old o FULL JOIN new n ON o.run_id = n.run_id""")
def s14(spark, sf):
    t = telemetry(spark, sf)
    snap = lambda d: d.groupBy("run_id").agg(F.count("*").alias("n")).withColumn("dg", tables.row_digest(["run_id", "n"]))
    old = snap(t.filter("event_type <> 'error' OR x_m < 15")).filter("run_id > 10")
    return tables.snapshot_diff(old, snap(t).filter("run_id < 140"), "run_id", "dg")


@query("s15_consolidate_inventories", f"""
WITH {TEL} SELECT 'runs' AS source_group, 'v1' AS version, CAST(run_id AS VARCHAR) AS item, count(*) AS n, NULL::DOUBLE AS mean FROM tel GROUP BY run_id
UNION ALL SELECT 'sessions', 'v1', session_id, count(*), round(avg(value), 6) FROM tel GROUP BY session_id UNION ALL SELECT 'kinds', 'v1', event_type, NULL, round(avg(value), 6) FROM tel GROUP BY event_type""")
def s15(spark, sf):
    t = telemetry(spark, sf)
    n, m = F.count("*").alias("n"), rnd(F.avg("value")).alias("mean")
    g = lambda c, *a: t.groupBy(F.col(c).cast("string").alias("item")).agg(*a)
    return tables.consolidate({"runs": g("run_id", n), "sessions": g("session_id", n, m), "kinds": g("event_type", m)}, "v1")


@query("s16_route_by_category", f"""
WITH {TEL} SELECT CASE WHEN event_type IN ('error', 'signup') THEN 'rare' ELSE 'common' END AS route, event_type, count(*) AS n FROM tel GROUP BY 1, 2""")
def s16(spark, sf):
    r = tables.route(telemetry(spark, sf), "event_type", {"rare": ["error", "signup"], "common": ["click", "view", "purchase"]})
    parts = [d.groupBy("event_type").agg(F.count("*").alias("n")).withColumn("route", F.lit(k)) for k, d in r.items()]
    return parts[0].unionByName(parts[1])


@query("u01_union_ragged", f"""
WITH {TEL} SELECT joint_idx, value, NULL::DOUBLE AS confidence FROM tel WHERE session_id = 's0' UNION ALL SELECT joint_idx, NULL, confidence FROM tel WHERE session_id <> 's0'""")
def u01(spark, sf):
    t = telemetry(spark, sf)
    return t.filter("session_id = 's0'").select("joint_idx", "value").unionByName(
        t.filter("session_id <> 's0'").select("joint_idx", "confidence"), allowMissingColumns=True)


@query("u05_relabel_and_duplicate", f"""
WITH {TEL}, m AS (SELECT session_id, count(*) AS n, round(avg(value), 6) AS mean FROM tel GROUP BY 1)
SELECT 'measured' AS kind, session_id AS label, n, mean FROM m UNION ALL SELECT 'reference', 'ref_' || session_id, n, mean FROM m WHERE session_id IN ('s0', 's1')""")
def u05(spark, sf):
    m = telemetry(spark, sf).groupBy("session_id").agg(F.count("*").alias("n"), rnd(F.avg("value")).alias("mean"))
    names = F.array_compact(F.array(F.struct(F.lit("measured").alias("kind"), F.col("session_id").alias("label")), F.when(
        F.col("session_id").isin("s0", "s1"), F.struct(F.lit("reference").alias("kind"), F.concat(F.lit("ref_"), F.col("session_id")).alias("label")))))
    return m.select(F.inline(names), "n", "mean")
