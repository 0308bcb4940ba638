"""Ties, large ids beside nulls, bounds of samples, and columns with the names of results."""
import numpy as np
from pyspark.sql import functions as F

import corpus_pipeline
from scanweave.llm import ann, langid, substrings, toxicity
from scanweave.llm.base import stored

SF = "/root/testdata/sf0.001"


def test_op1_ties_of_different_vectors_go_to_smaller_ids(spark):
    data = [(0, [1.0, 0.0])] + [(j, [1.0, float(j)]) for j in range(1, 200)]
    d = spark.createDataFrame(data, "vec_id long, embedding array<double>")
    for kw in ({}, {"list_size": 16, "list_block": 24, "recall": 1.0}):
        got = sorted((r["rank"], r.vec_id, r.score) for r in ann.nearest(d, F.col("vec_id") == 0, **kw).collect())
        assert got == [(i, i, 1.0) for i in range(1, 21)]


def test_op1_products_are_those_of_the_final_score():
    rng = np.random.default_rng(0)
    x, y = rng.normal(size=(20, 33)), rng.normal(size=(30, 33))
    row, col = np.repeat(np.arange(20), 30), np.tile(np.arange(30), 20)
    want = []
    for i, j in zip(row, col):
        total = 0.0
        for a, b in zip(x[i].tolist(), y[j].tolist()):
            total += a * b
        want.append(total)
    assert ann.products(x, y, row, col, 7).tolist() == want


def test_op9_large_ids_beside_nulls(spark):
    text = "the same passage of more than fifty bytes that stands in each of these documents"
    data = [(2**53 + 1 + 2 * i, text) for i in range(40)]
    for more in ([], [(None, text)], [(None, None)] * 3):
        d = spark.createDataFrame([*data, *more], "doc_id long, text string").coalesce(1)
        got = {r.doc_id: r.n_removed for r in substrings.remove_repeats(d).collect() if r.doc_id is not None}
        assert got == {i: 0 if i == 2**53 + 1 else len(text) for i, _ in data}


def test_samples_are_bounded_with_one_id_and_one_text(spark):
    words = "ein eine und der die das nicht with that this from have".split()
    d = stored(spark.range(8000).select(
        F.lit(7).cast("long").alias("doc_id"), F.concat_ws(" ", *[F.element_at(F.array(*map(F.lit, words)), F.pmod(F.hash("id", F.lit(k)), F.lit(12)) + 1) for k in range(8)]).alias("text"),
        F.when(F.col("id") % 2 == 0, "de").otherwise("en").alias("lang")))
    seen = []
    fit, tox = langid.fit, toxicity.fit
    try:
        langid.fit = lambda bag, *a, **k: (seen.append(len(bag)), fit(bag, *a, **k))[1]
        toxicity.fit = lambda rows, *a, **k: (seen.append(len(rows)), tox(rows, *a, **k))[1]
        model = langid.train(d, F.lit(True), sample=100)
        toxicity.train(d, spark.createDataFrame([(7, 1)], "doc_id long, toxic int"), F.lit(True), model, sample=100)
        langid.train(d.withColumn("text", F.lit("one text")), F.lit(True), sample=100)
    finally:
        langid.fit, toxicity.fit = fit, tox
    assert seen[0] <= 200 and seen[1] <= 200 and seen[2] <= 2


def test_op8_long_texts_are_learned_from(spark):
    t = b" ".join(b"%d" % i for i in range(10_000))
    p = toxicity._pieces(t, 1600)
    assert len(p) <= 1616 and p.startswith(t[:100]) and b" 9" in p and toxicity._pieces(t, 10**6) == t


def test_pipeline_keeps_the_values_of_clashing_columns(spark):
    names = ["n_removed", "n_bytes", "kept", "at", "score", "accepted", "lang_pred", "slot", "release", "doc", "__id", "piece", "n_spans"]
    d = spark.read.parquet(f"{SF}/documents.parquet").limit(60)
    d = stored(d.select("*", *[F.concat(F.lit(n), F.col("doc_id").cast("string")).alias(n) for n in names]))
    for name, stage in corpus_pipeline.STAGES:
        out = stored(stage(spark, d, SF))
        if name == "best_fit_packing":
            assert out.count() > 0
            continue
        assert out.columns == d.columns
        rows = out.collect()
        assert len(rows) > 20 and all(r[n] == f"{n}{r.doc_id}" for r in rows for n in names)
        d = out


def test_toxicity_thresholds_count_all_labelled_rows(spark, monkeypatch):
    """More labelled rows than the sample: every one that was not learned from counts once."""
    words = ["calm river stone", "vile hateful slur"]
    d = spark.createDataFrame([(i, f"{words[i % 5 == 0]} word{i % 17} text {i}", int(i % 5 == 0)) for i in range(900)], "doc_id long, text string, toxic int")
    model = langid.train(d.withColumn("lang", F.lit("en")), F.lit(True))
    fitted, counted, fit, calibrate = [], [], toxicity.fit, toxicity._calibrate
    monkeypatch.setattr(toxicity, "fit", lambda rows, *a, **k: (fitted.append(len(rows)), fit(rows, *a, **k))[1])
    monkeypatch.setattr(toxicity, "_calibrate", lambda m, z, y, langs, w: (counted.append((w.sum(), w[y == 1].sum())), calibrate(m, z, y, langs, w)))
    got = toxicity.train(d.select("doc_id", "text"), d.select("doc_id", "toxic"), F.col("doc_id") % 10 != 9, model, sample=100)
    learned = fitted[0] - len(range(0, fitted[0], 4))
    assert 40 <= fitted[0] < 300 and counted[-1][0] == 810 - learned and 100 < counted[-1][1] < 180
    scored = toxicity.score(d, got, model).collect()
    assert sum(r.predicted == r.toxic for r in scored) > 890
