"""Toxicity: a convolutional text classifier over hashed words, trained in numpy, calibrated by language."""

from __future__ import annotations

import zlib
from dataclasses import dataclass, field

import numpy as np
from pyspark.sql import Column, DataFrame, functions as F

from scanweave.llm.base import ship, text_bytes, texts
from scanweave.llm.langid import UNDETERMINED, LanguageModel

CUT = 0.3
_STEP = 1 << 17
SEED = 11
BINS = 1024  # of a logit's unit, in which calibration counts rows


def word_buckets(text: bytes, bits: int, stem: int = 5) -> np.ndarray:
    """(2, words): the bucket of every word and of its first ``stem`` bytes, A-Z lowered.

    Stems have buckets of their own; a text without words is one pad (bucket 2**(bits+1)).
    """
    words = text.lower().split()
    if not words:
        return np.full((2, 1), 2 << bits, np.int32)
    n, shift = len(words), np.uint32(32 - bits)
    whole = np.fromiter(map(zlib.crc32, words), np.uint32, n) >> shift
    stems = (np.fromiter(map(zlib.crc32, [w[:stem] for w in words]), np.uint32, n) >> shift) + np.uint32(1 << bits)
    return np.stack([whole, stems]).astype(np.int32)


def lay_out(docs: list[np.ndarray], bits: int, gap: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """All texts in one row with ``gap`` pads after each; first place and length of each."""
    n = np.array([d.shape[1] for d in docs], np.int64)
    first = np.concatenate([[0], np.cumsum(n + gap)[:-1]]).astype(np.int64)
    flat = np.full((2, int((n + gap).sum())), 2 << bits, np.int32)
    for d, a in zip(docs, first.tolist()):
        flat[:, a:a + d.shape[1]] = d
    return flat, first, n


@dataclass
class ToxicityModel:
    bits: int
    widths: tuple[int, ...]
    tables: dict = field(default_factory=dict)  # (width, offset): embedding times filters
    bias: dict = field(default_factory=dict)
    out: np.ndarray | None = None
    out_bias: float = 0.0
    slope: float = 1.0
    shift: float = 0.0
    cuts: dict = field(default_factory=dict)  # threshold of the calibrated logit, by language; "" for all

    def pooled(self, docs: list[np.ndarray]) -> np.ndarray:
        """(texts, filters) after max pooling over whole texts, in steps of bounded memory."""
        flat, first, n = lay_out(docs, self.bits, max(self.widths) - 1)
        filters = len(self.out) // len(self.widths)
        out = np.full((len(docs), len(self.out)), -np.inf, np.float32)
        for a in range(0, flat.shape[1], _STEP):
            z = min(flat.shape[1], a + _STEP)
            lo, hi = np.searchsorted(first + n, a, "right"), np.searchsorted(first, z, "left")
            if lo >= hi:
                continue
            at = np.maximum(first[lo:hi], a) - a
            to = np.minimum(first[lo:hi] + n[lo:hi], z) - a
            edges = np.stack([at, to], axis=1).ravel()
            for k, w in enumerate(self.widths):
                ids = flat[:, a:min(flat.shape[1], z + w - 1)]
                count = ids.shape[1] - w + 1
                conv = np.zeros((count, filters), np.float32)
                for j in range(w):
                    conv += self.tables[w, j][ids[0, j:j + count]]
                    conv += self.tables[w, j][ids[1, j:j + count]]
                conv = np.concatenate([conv, np.full((z - a - count + 1, filters), -np.inf, np.float32)])
                m = np.maximum.reduceat(conv, edges, axis=0)[::2]
                out[lo:hi, k * filters:(k + 1) * filters] = np.maximum(out[lo:hi, k * filters:(k + 1) * filters], m)
        return np.maximum(out + np.concatenate([self.bias[w] for w in self.widths]), 0)

    def raw(self, docs: list[np.ndarray]) -> np.ndarray:
        return self.pooled(docs) @ self.out + self.out_bias

    def logits(self, docs: list[np.ndarray]) -> np.ndarray:
        """Calibrated log-odds at the corpus's own share of toxic rows."""
        return self.slope * self.raw(docs) + self.shift

    def scores(self, docs: list[np.ndarray], langs: list[str]) -> np.ndarray:
        """0 to 1, so that a language's threshold falls on ``CUT``."""
        cut = np.array([self.cuts.get(x, self.cuts.get("", 0.0)) for x in langs])
        return _sigmoid(self.logits(docs) - cut + np.log(CUT / (1 - CUT)))


def _sigmoid(z: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(z, -500, 500)))


def _held(n: int, rng: np.random.Generator) -> tuple[np.ndarray, np.ndarray]:
    """Which of ``n`` texts the fit learns from, and which it holds back."""
    order = rng.permutation(n)
    return (np.setdiff1d(order, order[::4]), order[::4]) if n >= 40 else (order, order)


def fit(docs: list[np.ndarray], label: np.ndarray, langs: list[str], weight: np.ndarray, bits: int = 15, dim: int = 8,
        filters: int = 8, widths: tuple[int, ...] = (1, 2, 3), steps: int = 2000, batch: int = 16, rate: float = 0.04,
        least: int = 3, warm: float = 2.5, seed: int = SEED) -> ToxicityModel:
    """Adagrad on log loss; every fourth text calibrates. ``weight``: rows of the corpus that a text stands for.

    A word is the sum of its own and its stem's embedding. Buckets of fewer than ``least`` texts stay zero, as
    do unseen ones: a rare word says nothing by itself. The first dimension starts at how far a bucket's log-odds
    exceed ``warm`` standard errors, the rest start small.
    """
    rng = np.random.default_rng(seed)
    train, held = _held(len(docs), rng)
    size = (2 << bits) + 1
    seen = np.zeros((2, size))  # texts of each class that have the bucket
    for i in train:
        seen[label[i], np.unique(docs[i])] += 1
    live = seen.sum(axis=0) >= least
    live[-1] = False
    odds = (seen + 0.5) / (np.array([[(label[train] == c).sum()] for c in (0, 1)]) + 1)
    z = np.log(odds[1] / odds[0]) / np.sqrt((1 / (seen + 0.5)).sum(axis=0))
    emb = rng.normal(0, 0.02, (size, dim))
    emb[:, 0] = np.clip(z - warm, 0, 3)
    emb = (emb * live[:, None]).astype(np.float32)
    conv = {w: rng.normal(0, 0.5 / w, (w, dim, filters)).astype(np.float32) for w in widths}
    for w in widths:
        conv[w][:, 0, 0] = 1 / w
    bias = {w: np.zeros(filters, np.float32) for w in widths}
    out, out_b = rng.normal(0, 0.3, len(widths) * filters).astype(np.float32), 0.0
    sq_emb, sq_conv = np.full_like(emb, 1e-4), {w: np.full_like(conv[w], 1e-4) for w in widths}
    sq_bias, sq_out, sq_b = {w: np.full_like(bias[w], 1e-4) for w in widths}, np.full_like(out, 1e-4), 1e-4
    by_class = [train[label[train] == c] for c in (0, 1)]
    for _ in range(steps if all(len(c) for c in by_class) else 0):
        rows = np.concatenate([rng.choice(c, batch // 2) for c in by_class])
        flat, first, n = lay_out([docs[i] for i in rows], bits, max(widths) - 1)
        x = emb[flat[0]] + emb[flat[1]]
        top, best = [], {}
        for w in widths:
            c = sum(x[j:len(x) - w + 1 + j] @ conv[w][j] for j in range(w))
            at = np.stack([c[a:a + m].argmax(axis=0) + a for a, m in zip(first, n)])  # (texts, filters)
            best[w] = at
            top.append(c[at, np.arange(filters)] + bias[w])
        h = np.maximum(np.concatenate(top, axis=1), 0)
        g = ((_sigmoid(h @ out + out_b) - label[rows]) / len(rows)).astype(np.float32)
        gh = (g[:, None] * out) * (h > 0)
        go = h.T @ g
        sq_out += go ** 2
        out -= rate * go / np.sqrt(sq_out)
        sq_b += float(g.sum()) ** 2
        out_b -= rate * float(g.sum()) / sq_b ** 0.5
        at_all, ge_all = [], []
        for k, w in enumerate(widths):
            gw = gh[:, k * filters:(k + 1) * filters]
            sq_bias[w] += gw.sum(axis=0) ** 2
            gc = np.empty_like(conv[w])
            for j in range(w):
                at = best[w] + j
                gc[j] = np.einsum("bf,bfd->df", gw, x[at])
                ge = (gw[:, :, None] * conv[w][j].T[None]).reshape(-1, dim)
                ge_all += [ge, ge]
                at_all += [flat[0][at].ravel(), flat[1][at].ravel()]
            bias[w] -= rate * gw.sum(axis=0) / np.sqrt(sq_bias[w])
            sq_conv[w] += gc ** 2
            conv[w] -= rate * gc / np.sqrt(sq_conv[w])
        at, back = np.unique(np.concatenate(at_all), return_inverse=True)
        ge = np.zeros((len(at), dim), np.float32)
        np.add.at(ge, back, np.concatenate(ge_all))
        ge *= live[at, None]
        sq_emb[at] += ge ** 2
        emb[at] -= rate * ge / np.sqrt(sq_emb[at])
    model = ToxicityModel(bits, tuple(widths), {(w, j): emb @ conv[w][j] for w in widths for j in range(w)}, bias, out, out_b)
    z = np.concatenate([model.logits([docs[i] for i in held[k:k + 256]]) for k in range(0, len(held), 256)]) if len(held) else np.zeros(0)
    _calibrate(model, z, label[held], [langs[i] for i in held], weight[held])
    return model


def _calibrate(model: ToxicityModel, z: np.ndarray, y: np.ndarray, langs: list[str], weight: np.ndarray, least: int = 10) -> None:
    """Platt scaling with the corpus's weights, then for each language the threshold of the best F1. Where there are
    more labelled rows than the sample, ``train`` calls it again with the counts of all that were not learned from.

    Of all thresholds with that F1 the middle one; languages with fewer than ``least`` rows of a class take
    the threshold of all rows.
    """
    if not len(z) or y.min() == y.max():
        return
    a, b = 1.0, 0.0
    scale = np.std(z) + 1e-9
    count = lambda k: (weight[k][y[k] == 1].sum(), weight[k][y[k] == 0].sum())
    t = np.where(y == 1, 1 - 1 / (2 + count(slice(None))[0]), 1 / (2 + count(slice(None))[1]))
    u, w = z / scale, weight / weight.sum()
    for _ in range(60):
        p = _sigmoid(a * u + b)
        g = np.array([(w * (p - t) * u).sum(), (w * (p - t)).sum()])
        r = w * p * (1 - p)
        hess = np.array([[(r * u * u).sum(), (r * u).sum()], [(r * u).sum(), r.sum()]]) + 1e-6 * np.eye(2)
        step = np.linalg.solve(hess, g)
        step *= min(1.0, 2 / (np.abs(step).max() + 1e-12))
        a, b = a - step[0], b - step[1]
    model.slope, model.shift = a / scale, b
    score, langs = model.slope * z + b, np.array(langs, object)
    for name in ["", *sorted(set(langs))]:
        k = np.arange(len(z)) if name == "" else np.flatnonzero(langs == name)
        if name and min(count(k)) < least:
            continue
        o = k[np.argsort(score[k], kind="stable")]
        hit = np.cumsum((weight[o] * (y[o] == 1))[::-1])[::-1]
        f1 = 2 * hit / (np.cumsum(weight[o][::-1])[::-1] + (weight[o] * (y[o] == 1)).sum())
        i = int(np.flatnonzero(f1 >= f1.max() - 1e-12)[-1])
        model.cuts[name] = float((score[o[i]] + score[o[i - 1]]) / 2 if i else score[o[0]] - 1)


def calibrate(model: ToxicityModel, docs: DataFrame, lab: DataFrame, usable: Column, langs: LanguageModel, learned: list[int]) -> None:
    """Calibration and thresholds from all rows of ``lab(doc_id, label)`` that were not ``learned`` from (hashes of id and text).

    All usable texts of ``docs(doc_id, text)`` get their raw logit, which alone meets its label and is counted in
    bins of 1 / BINS per language and label: what reaches the driver is bounded. Without rows of both classes the
    model stays as it is.
    """
    shared = docs.sparkSession.sparkContext.broadcast((model, langs, np.unique(np.array(learned, np.int64))))

    def run(batches):
        import pyarrow as pa
        m, known, seen = shared.value
        for b in batches:
            b = b.filter(pa.array(~np.isin(b.column(1).to_numpy(), seen)))
            raw, off = text_bytes(b.column(2))
            words, z = texts(b.column(2)), []
            for at in range(0, len(words), 256):
                z.append(m.raw([word_buckets(t, m.bits) for t in words[at:at + 256]]))
            z = np.clip(np.concatenate(z) if z else np.zeros(0), -64, 64)
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(_languages(known, raw, off), pa.string()), pa.array(
                np.rint(z * BINS).astype(np.int32))], names=["doc_id", "h", "lang", "bin"])

    d = docs.where(usable & F.col("doc_id").isNotNull()).select("doc_id", F.xxhash64("doc_id", "text").alias("h"), "text")
    kind = d.schema["doc_id"].dataType.simpleString()
    rows = d.mapInArrow(run, f"doc_id {kind}, h long, lang string, bin int").join(lab, "doc_id").dropDuplicates(["h"])
    got = rows.groupBy("lang", "label", "bin").agg(F.count(F.lit(1)).alias("n")).orderBy("lang", "label", "bin").collect()
    y = np.array([r["label"] for r in got], np.int64)
    if len(got) and y.min() < y.max():
        model.slope, model.shift, model.cuts = 1.0, 0.0, {}
        _calibrate(model, np.array([r["bin"] / BINS for r in got]), y, [r["lang"] for r in got], np.array([float(r["n"]) for r in got]))


def train(docs: DataFrame, labels: DataFrame, usable: Column, langs: LanguageModel, id_col: str = "doc_id",
          text_col: str = "text", label_col: str = "toxic", sample: int = 6000, longest: int = 1 << 20, bits: int = 15) -> ToxicityModel:
    """A model of the labelled rows where ``usable(id)``. Its weights are learned from about ``sample`` of them, twice as
    many at most; its calibration and thresholds from all the others, or from a quarter held back if there are none.

    Half of the sample is toxic if there are as many, drawn by a hash of the id. Rows of one id count once a text, so
    that an id with very many rows can't fill the sample. Of a text over ``longest`` bytes 16 pieces from all over it,
    together as long, are learned from, which bounds what leaves the executors; whole texts are scored. With one
    class only, or no rows, all scores are equal and below the cut. A null label doesn't count.
    """
    ship(docs.sparkSession)
    lab = labels.select(F.col(id_col).alias("doc_id"), F.col(label_col).cast("int").alias("label")).where(
        usable & F.col("label").isin(0, 1) & F.col("doc_id").isNotNull()).groupBy("doc_id").agg(F.max("label").alias("label"))
    counts = {r["label"]: r["n"] for r in lab.groupBy("label").agg(F.count(F.lit(1)).alias("n")).collect()}
    share = {c: min(1.0, sample / 2 / max(1, counts.get(c, 0))) for c in (0, 1)}
    drawn = lab.where(F.pmod(F.xxhash64("doc_id", F.lit("toxicity sample")), F.lit(1 << 30))
                      < F.when(F.col("label") == 1, share[1]).otherwise(share[0]) * (1 << 30))
    shared = docs.sparkSession.sparkContext.broadcast(langs)

    def run(batches):
        import pyarrow as pa
        for b in batches:
            raw, off = text_bytes(b.column(2))
            yield pa.RecordBatch.from_arrays(
                [b.column(0), b.column(1), b.column(3), pa.array([word_buckets(_pieces(t, longest), bits).astype("<i4").tobytes() for t in texts(b.column(2))], pa.binary()),
                 pa.array(_languages(shared.value, raw, off), pa.string())], names=["doc_id", "label", "h", "words", "lang"])

    d = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    rows = (d.join(F.broadcast(drawn), "doc_id").withColumn("h", F.xxhash64("doc_id", "text"))  # `sample` labels
            .dropDuplicates(["h"]).orderBy("h").limit(2 * sample).select(F.col("doc_id").cast("string"), "label", "text", "h")
            .mapInArrow(run, "doc_id string, label int, h long, words binary, lang string").orderBy("doc_id", "words").collect())
    label = np.array([r["label"] for r in rows], np.int64)
    weight = np.array([1 / share[r["label"]] for r in rows])
    model = fit([np.frombuffer(r["words"], "<i4").reshape(2, -1) for r in rows], label, [r["lang"] for r in rows], weight, bits)
    if not len(label) or label.min() == label.max():
        model.out, model.out_bias, model.slope = np.zeros_like(model.out), 0.0, 0.0
        model.cuts = {"": 2.0}
    elif len(rows) < sum(counts.values()):
        calibrate(model, d, lab, usable, langs, [rows[i]["h"] for i in _held(len(rows), np.random.default_rng(SEED))[0]])
    return model


def _pieces(text: bytes, longest: int, n: int = 16) -> bytes:
    """A text of up to ``longest`` bytes itself, else ``n`` pieces at even distances, together as long."""
    if len(text) <= longest:
        return text
    size, step = longest // n, len(text) // n
    return b" ".join(text[k * step:k * step + size] for k in range(n))


def _languages(m: LanguageModel, raw: np.ndarray, off: np.ndarray) -> list[str]:
    return [m.langs[i] for i in m.probabilities(raw, off).argmax(axis=1)] if m.langs else [UNDETERMINED] * (len(off) - 1)


def score(docs: DataFrame, model: ToxicityModel, langs: LanguageModel, text_col: str = "text") -> DataFrame:
    """``docs`` with score and predicted (score >= 0.3) of every whole text; columns of these names are replaced.

    The language that picks the threshold is read from the text. Null text: like an empty one, which has a score.
    """
    ship(docs.sparkSession)
    sc, own = docs.sparkSession.sparkContext, ("score", "predicted")
    shared = sc.broadcast((model, langs))  # tables of 2**bits rows
    kept = [c for c in docs.columns if c not in own]
    d = docs.select(*[F.col(f"`{c}`") for c in kept], F.col(text_col).cast("string").alias("__text"))

    def run(batches):
        import pyarrow as pa
        m, known = shared.value
        for b in batches:
            column = b.column(len(kept))
            raw, off = text_bytes(column)
            lang, words, s = _languages(known, raw, off), texts(column), []
            for at in range(0, len(words), 256):
                s.append(m.scores([word_buckets(t, m.bits) for t in words[at:at + 256]], lang[at:at + 256]))
            s = np.concatenate(s) if s else np.zeros(0)
            yield pa.RecordBatch.from_arrays([*b.columns[:len(kept)], pa.array(s.astype(np.float64)), pa.array((s >= CUT).astype(np.int32))],
                                             names=[*kept, *own])

    schema = d.select(*[F.col(f"`{c}`") for c in kept]).schema.add("score", "double").add("predicted", "integer")
    return d.mapInArrow(run, schema)
