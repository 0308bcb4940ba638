"""Quality rules, pivot-table clustering and periodic runs against brute force, and on odd tables."""
import hashlib
import math
import random
import re
import zlib
from fractions import Fraction

import numpy as np
import pytest
from pyspark.sql import functions as F

from scanweave.llm import pivot_table, rules, runs
from scanweave.llm import queries as llm
from scanweave.llm.base import stored

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def odd(spark):
    """Nulls, empty and long texts, repeated rows, one id with two texts, columns with the names of results."""
    base = "the quick brown fox jumps over the lazy dog while many other words follow in a row until the end. "
    texts = [None, "", " ", "\n\t\x0b", "a", base, base, base * 4, "a\n\na\n \n b\na", "word " * 30_000, "é日 " * 30, "# $ & x < > | * %",
             "x" * 200_000, "one two three four five one two three four five six"]
    data = [(i, t, None if i % 3 == 0 else "en", None if i % 4 == 0 else f"s{i % 2}") for i, t in enumerate(texts)]
    data += [data[5], data[5], (6, "another text of that id", "en", "s1"), (None, base, "en", None), (None, None, None, None)]
    data = [(*d, 1, 2, 3.0, True, "w", "l", 4, 5, 6, 7) for d in data]
    names = ("doc_id long, text string, lang string, source string, n_words long, bucket int, measure double, kept boolean, _w string, "
             "_l string, level int, rows int, runs int, start long")
    return stored(spark.createDataFrame(data, names))


def _words(text):
    return re.findall(r"[^\x20\x09-\x0D]+", text or "")


# ---- op11 ----------------------------------------------------------------------------------------------------

def _base(text):
    w, lines = _words(text), [x for x in (text or "").split("\n") if _words(x)]
    seen, covered = {}, set()
    for i in range(len(w) - 4):
        seen.setdefault(tuple(w[i:i + 5]), []).append(i)
    for at in seen.values():
        if len(at) > 1:
            covered |= {i + j for i in at for j in range(5)}
    return (len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", text or "")), len(lines), len(lines) - len(set(lines)), len(covered))


def _bucket_top(x):
    e = max(x.bit_length() - 6, 0)
    return (((x >> e) + 1) << e) - 1


def _verdicts(rows, least_rows=100):
    """kept of each (text, lang, source), worked out with sorted lists."""
    spread = {"word_length": 200, "symbols": 25, "dup_lines": 150, "repeats": 60}
    made = []
    for text, lang, source in rows:
        n, c, s, k, d, r = _base(text)
        failed = n < 10 or 100 * r > 20 * n
        made.append((failed, lang, source, n, None if failed else dict(word_length=1000 * c // n, symbols=1000 * s // c, dup_lines=1000 * d // k, repeats=1000 * r // n)))

    def quartiles(group):
        out = {}
        for m, least in spread.items():
            tops = sorted(_bucket_top(x[4][m]) for x in group)
            q1, q3 = tops[math.ceil(len(tops) / 4) - 1], tops[math.ceil(3 * len(tops) / 4) - 1]
            out[m] = (q1 - 3 * max(q3 - q1, least), q3 + 3 * max(q3 - q1, least))
        return out

    good = [x for x in made if not x[0]]
    limits = {}
    for failed, lang, source, n, m in made:
        if (lang, source) not in limits:
            groups = [[x for x in good if x[1:3] == (lang, source)], [x for x in good if x[1] == lang], good]
            limits[lang, source] = next((quartiles(g) for i, g in enumerate(groups) if len(g) >= least_rows or i == 2 and g), None)
    out = []
    for failed, lang, source, n, m in made:
        f = limits[lang, source]
        out.append(not failed and all(
            x <= f[k][1] + (math.floor(6600 / math.sqrt(n)) if k == "word_length" else 0)
            and (k != "word_length" or x >= f[k][0] - math.floor(6600 / math.sqrt(n))) for k, x in m.items()))
    return out


@pytest.mark.parametrize("which", ["docs", "odd"])
def test_op11_against_brute_force(spark, odd, which):
    d = odd if which == "odd" else spark.read.parquet(f"{SF}/documents.parquet")
    rows = d.select("doc_id", "text", "lang", "source").collect()
    for least in (100, 5):
        want = sorted(((r.doc_id, *_base(r.text), k) for r, k in zip(rows, _verdicts([r[1:] for r in rows], least))), key=repr)
        for limit in (100_000, 0):  # both joins
            got = rules.apply_rules(d, least_rows=least, broadcast_groups=limit).collect()
            assert sorted(((r.doc_id, r.n_words, r.word_chars, r.n_symbols, r.n_lines, r.n_dup_lines, r.n_repeat_words, r.kept) for r in got), key=repr) == want
            assert all(r.base_failed == (r.n_words < 10 or 100 * r.n_repeat_words > 20 * r.n_words) for r in got)


def test_op11_empty_and_buckets(spark, odd):
    assert rules.apply_rules(odd.limit(0)).count() == 0
    assert rules.apply_rules(odd.where("text is null")).where("kept or not base_failed").count() == 0
    x = [*range(300), 1000, 4095, 4096, 10**9, 2**40 + 12345]
    got = spark.createDataFrame([(v,) for v in x], "x long").select("x", rules.bucket(F.col("x")).alias("b")).select("x", "b", rules.bucket_top(F.col("b")).alias("top")).collect()
    assert all(r.top == _bucket_top(r.x) and r.x <= r.top <= r.x * 33 // 32 for r in got)
    assert len({r.b for r in got}) == len({r.top for r in got})


def test_op11_stays_in_the_jvm_and_merges_counts(spark):
    d = spark.read.parquet(f"{SF}/documents.parquet")
    m = rules.text_measures(d, ["doc_id", "lang", "source"])
    assert "Python" not in m._jdf.queryExecution().toString() and "Arrow" not in m._jdf.queryExecution().toString()
    for name in rules.MEASURES:
        m = m.withColumn(name, F.col("n_words"))
    s = rules.sketches(m, ["lang", "source"])
    per = {r.level: r.n for r in s.groupBy("level").agg(F.sum("n").alias("n")).collect()}
    assert per == {0: 800, 1: 800, 2: 800}  # four measures of 200 documents at each level


# ---- op12 ----------------------------------------------------------------------------------------------------

def _clusters(rows, k, rounds, dims):
    kept = [(i, [math.floor(256 * float(x)) for x in v]) for i, v in rows
            if v is not None and len(v) == dims and all(x is not None and math.isfinite(x) for x in v)]
    first = sorted(kept, key=lambda r: (r[0] is None, hashlib.sha256(f"2:{r[0]}".encode()).hexdigest(), r[1]))
    c = [v for _, v in first[:k]]

    def near(v):
        return min((sum((a - b) ** 2 for a, b in zip(v, x)), j) for j, x in enumerate(c))

    for _ in range(rounds):
        got = [near(v)[1] for _, v in kept]
        for j in range(len(c)):
            mine = [v for (_, v), g in zip(kept, got) if g == j]
            if mine:
                c[j] = [sum(col) // len(mine) for col in zip(*mine)]
    got = [near(v) for _, v in kept]
    inertia = {j: sum(d for d, g in got if g == j) for _, j in got}
    return sorted(((i, j, d, inertia[j], sum(inertia.values()), hashlib.sha256(",".join(map(str, c[j])).encode()).hexdigest())
                   for (i, _), (d, j) in zip(kept, got)), key=repr)


def _rows(df):
    return sorted(((r.vec_id, r.cluster, r.distance, r.cluster_inertia, r.inertia, r.centroid_sha256) for r in df.collect()), key=repr)


def test_op12_against_brute_force(spark):
    rng = np.random.default_rng(3)
    v = [(i, [float(x) for x in rng.normal(size=6).round(2)]) for i in range(300)]
    v += [(400 + i, [0.5, 0.5, 0.0, 0.0, 0.0, 0.0]) for i in range(40)]  # one vector, many ids: empty centroids
    v += [(i, [1e6 * x for x in y]) for i, y in v[:5]] + [(7, v[7][1])] * 3 + [(None, v[9][1]), (None, None)]
    v += [(900, [1.0] * 5), (901, [float("nan")] * 6), (902, [float("inf")] + [0.0] * 5), (903, [None] + [0.0] * 5), (904, []), (905, [0.0] * 6)]
    d = spark.createDataFrame(v, "vec_id long, embedding array<double>").withColumn("cluster", F.lit("x")).withColumn("distance", F.lit(1))
    for k in (1, 7, 40, 1000):
        assert _rows(pivot_table.cluster(d, dims=6, k=k, rounds=3, pivots=3, batch=37)) == _clusters(v, k, 3, 6)
    assert pivot_table.cluster(d, dims=9).count() == 0 and pivot_table.cluster(d.limit(0), dims=6).count() == 0
    assert pivot_table.cluster(d.limit(0), dims=6).columns == pivot_table.cluster(d, dims=6, k=2, rounds=0).columns


def test_op12_bounds_spare_distances():
    rng = np.random.default_rng(5)
    centers = rng.normal(size=(40, 64)) * 300
    v = np.floor(centers[rng.integers(0, 40, 2000)] + rng.normal(size=(2000, 64)) * 5).astype(np.int64)
    c = np.floor(centers).astype(np.int64)
    p = c[pivot_table.spread_pivots(c, 12)]
    far = [np.sqrt(np.stack([pivot_table.squared(a, x) for x in p], axis=1).astype(float)) for a in (v, c)]
    best, near, exact = pivot_table.nearest_centroid(v, far[0], c, far[1])
    d = ((v[:, None] - c) ** 2).sum(axis=2)
    assert (best == d.argmin(axis=1)).all() and (near == d.min(axis=1)).all()
    assert exact < 0.1 * d.size


# ---- op13 ----------------------------------------------------------------------------------------------------

def _runs(w, least=6, times=4):
    out = []
    for q in range(1, len(w) // times + 1):
        i = 0
        while i + q < len(w):
            j = i
            while j + q < len(w) and w[j] == w[j + q]:
                j += 1
            n = j - i + q
            if n >= max(least, times * q) and not any(all(w[x] == w[x + p] for x in range(i, i + n - p)) for p in range(1, q)):
                out.append((i, n, q))
            i = max(j, i + 1)
    return sorted(out, key=lambda r: (r[0], r[2]))


def test_op13_runs_of_random_words():
    rng = random.Random(8)
    for _ in range(600):
        docs = []
        for _ in range(rng.randrange(1, 6)):
            w, kind = [], rng.random()
            if kind < 0.5:
                w = [rng.choice([b"a", b"b"]) for _ in range(rng.randrange(60))]
            elif kind < 0.8:
                for _ in range(rng.randrange(1, 5)):
                    u = [rng.choice([b"a", b"b", b"c"]) for _ in range(rng.randrange(1, 6))]
                    w += (u * 8)[:rng.randrange(1, 50)]
            else:
                w = [b"x"] * rng.randrange(30)
            docs.append(w)
        assert runs.document_runs(docs) == [_runs(w) for w in docs]
        assert runs.document_runs(docs, 3, 2) == [_runs(w, 3, 2) for w in docs]


def test_op13_places_stay_in_order():
    rng = random.Random(1)
    x = rng.sample(range(10**6), 9000)
    p, seen = runs.Places(x[0]), [x[0]]
    for v in x[1:]:
        got = p.put(v)
        seen.append(v)
        if len(seen) % 500 == 0:
            s = sorted(seen)
            k = s.index(v)
            assert got == (s[k - 1] if k else -1, s[k + 1] if k + 1 < len(s) else -1)
    assert list(p) == sorted(x)


def _planted(doc_id, text):
    w = _words(text)
    if doc_id is not None and w:
        h = zlib.crc32(str(doc_id).encode())
        g, n = h // 10, len(w)
        if h % 10 == 0:
            a = g % n
            p = 1 + (n - a) // (3 + g % 8)
            w = [x if i < a else w[a + (i - a) % p] for i, x in enumerate(w)]
    return w


def _digest(doc_id, text):
    w = _planted(doc_id, text)
    found = _runs(w) if len(set(w)) > 1 else [(0, len(w), 1)] if len(w) >= 6 else []
    gone = {i for s, n, q in found for i in range(s + q, s + n)}
    best = min(found, key=lambda r: (-Fraction(r[1], r[2]), r[0], r[2]), default=None)
    return (doc_id, len(found), *(best or (None,) * 3), 1000 * best[1] // best[2] if best else None,
            hashlib.sha256("".join(f"{s},{n},{q}\n" for s, n, q in found).encode()).hexdigest(),
            hashlib.sha256(" ".join(x for i, x in enumerate(w) if i not in gone).encode()).hexdigest())


@pytest.mark.parametrize("which", ["docs", "odd"])
def test_op13_query_against_brute_force(spark, odd, which):
    d = odd if which == "odd" else spark.read.parquet(f"{SF}/documents.parquet").where("length(text) < 4000")
    if which == "docs":  # ids under which more texts are changed
        d = d.unionByName(d.withColumn("doc_id", F.col("doc_id") + 10_000)).unionByName(d.withColumn("doc_id", F.col("doc_id") * 7919))
    got = runs.run_digests(runs.collapse_runs(runs.with_planted_runs(d), words_at_once=500))
    assert got.columns == ["doc_id", "n_runs", "start", "length", "period", "exponent_milli", "runs_sha256", "collapsed_sha256"]
    want = [_digest(r.doc_id, r.text) for r in d.select("doc_id", "text").collect()]
    assert sorted(map(tuple, got.collect()), key=repr) == sorted(want, key=repr)
    assert which == "odd" or sum(w[1] > 0 for w in want) > 20
    assert runs.collapse_runs(d.limit(0)).count() == 0


def test_queries_are_registered():
    assert {"op11_quality_rules", "op12_pivot_table_clusters", "op13_periodic_runs"} <= set(llm.QUERIES)
    assert {"op11_quality_rules", "op12_pivot_table_clusters"} <= set(llm.SQL)
