"""Compare registered queries with their SQL: python tests/check.py [name-part ...]."""
import datetime
import decimal
import math
import os
import sys
import tempfile
import time

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

TABLES = ("region nation customer supplier part orders lineitem events documents embeddings "
          "pages benchmark labels conversations").split()


def duck(sf):
    import duckdb
    con = duckdb.connect()
    con.execute(f"SET temp_directory = '{tempfile.mkdtemp(prefix='duck-', dir='/tmp')}'")
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf}/{t}.parquet'")
    return con


def norm(v):
    if isinstance(v, bool) or v is None or isinstance(v, str):
        return v
    if isinstance(v, float):
        return None if math.isnan(v) else v + 0.0
    if isinstance(v, decimal.Decimal):
        return float(v)
    if isinstance(v, datetime.datetime):
        return v.replace(tzinfo=None).isoformat()
    if isinstance(v, (list, tuple)):
        return tuple(norm(x) for x in v)
    return v


def canon(cols, rows):
    order = sorted(range(len(cols)), key=lambda i: cols[i])
    return sorted((tuple(norm(r[i]) for i in order) for r in rows), key=repr)


def compare(spark, con, name, fn, sql, sf):
    t = time.time()
    df = fn(spark, sf)
    rows = [tuple(r) for r in df.collect()]
    took = time.time() - t
    if sql is None:
        return ("rows", took, f"{len(rows)} rows")
    cur = con.execute(sql)
    cols = [d[0] for d in cur.description]
    want = cur.fetchall()
    if sorted(cols) != sorted(df.columns):
        return ("COLS", took, f"{sorted(set(df.columns) ^ set(cols))}")
    a, b = canon(df.columns, rows), canon(cols, want)
    if len(a) != len(b):
        return ("COUNT", took, f"spark {len(a)} sql {len(b)}\n   {a[:3]}\n   {b[:3]}")
    bad = [(x, y) for x, y in zip(a, b) if x != y or [type(v) for v in x] != [type(v) for v in y]]
    if bad:
        return ("VALUES", took, f"{len(bad)} of {len(a)} rows\n   cols {sorted(cols)}\n   spark {bad[0][0]}\n   sql   {bad[0][1]}")
    return ("ok" if a else "EMPTY", took, f"{len(a)} rows")


def main():
    import __spark_entry__ as E
    from scanweave.session import build_session
    sf = os.environ.get("SF_DIR", "/root/testdata/sf0.01")
    spark = build_session("local[8]", shuffle_partitions=8)
    spark.sparkContext.setLogLevel("ERROR")
    con = duck(sf)
    q, o = E.queries(), E.oracle_sql()
    bad = 0
    for name, fn in q.items():
        if len(sys.argv) > 1 and not any(p in name for p in sys.argv[1:]):
            continue
        try:
            status, took, note = compare(spark, con, name, fn, o.get(name), sf)
        except Exception as e:
            status, took, note = "ERROR", 0.0, str(e)[:700]
        bad += status not in ("ok", "rows")
        print(f"{status:7s} {took:6.2f}s {name}: {note}", flush=True)
    print("missing sql for", [n for n in q if n not in o])
    print("bad", bad, "of", len(q))


if __name__ == "__main__":
    main()
