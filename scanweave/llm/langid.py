"""Language identification: averaged hashed subword embeddings and a linear softmax, trained in numpy."""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np
from pyspark.sql import Column, DataFrame, functions as F

from scanweave.llm.base import ship, text_bytes

UNDETERMINED = "und"
_LOWER = np.arange(256, dtype=np.uint32)
_LOWER[65:91] += 32
_STEP = 1 << 20


def subword_buckets(raw: np.ndarray, bits: int, widths: tuple[int, ...] = (2, 3, 4)) -> list[np.ndarray]:
    """For each width the bucket of the byte n-gram at each position (A-Z lowered)."""
    b = _LOWER[raw] + np.uint32(1)
    out, h = [], b * np.uint32(0x9E3779B1)
    for n in range(2, max(widths) + 1):
        h = (h[:-1] * np.uint32(0x85EBCA6B)) ^ (b[n - 1:] * np.uint32(0xC2B2AE35))
        if n in widths:
            out.append((h * np.uint32(0x9E3779B1)) >> np.uint32(32 - bits))
    return out


def bags(raw: np.ndarray, off: np.ndarray, bits: int):
    """The subword counts of one whole text after another, whatever its length."""
    size = 1 << bits
    at, n = 0, len(off) - 1
    while at < n:
        to = at + 1
        while to < n and off[to + 1] - off[at] <= _STEP:
            to += 1
        base, end = int(off[at]), int(off[to])
        if end - base <= 4 * _STEP:
            grams = subword_buckets(raw[base:end], bits) if end > base else []
            for k in range(at, to):
                a, z = int(off[k]) - base, int(off[k + 1]) - base
                bag = np.zeros(size, np.float32)
                for w, g in enumerate(grams, 2):
                    if z - w + 1 > a:
                        bag += np.bincount(g[a:z - w + 1], minlength=size)
                yield bag
        else:  # one very long text, in steps that overlap by the longest subword
            bag = np.zeros(size, np.float32)
            for s in range(base, end, _STEP):
                for w, g in enumerate(subword_buckets(raw[s:min(end, s + _STEP + 3)], bits), 2):
                    bag += np.bincount(g[:min(_STEP, max(0, end - s - w + 1))], minlength=size)
            yield bag
        at = to


@dataclass
class LanguageModel:
    """Subword embeddings times softmax weights, one table; with the temperature and the rejection threshold."""
    langs: list[str] = field(default_factory=list)
    table: np.ndarray | None = None
    bias: np.ndarray | None = None
    bits: int = 14
    temperature: float = 1.0
    threshold: float = 0.0

    def probabilities(self, raw: np.ndarray, off: np.ndarray) -> np.ndarray:
        """(texts, langs) calibrated; whole texts."""
        out = np.empty((len(off) - 1, len(self.langs)))
        for k, bag in enumerate(bags(raw, off, self.bits)):
            out[k] = bag @ self.table / max(1.0, float(bag.sum())) + self.bias
        return softmax(out / self.temperature)


def softmax(z: np.ndarray) -> np.ndarray:
    e = np.exp(z - z.max(axis=1, keepdims=True)) if z.size else z
    return e / e.sum(axis=1, keepdims=True)


def fit(bag: list[tuple[np.ndarray, np.ndarray]], label: np.ndarray, langs: list[str], bits: int, dim: int = 12, steps: int = 800,
        rate: float = 4.0, seed: int = 7, lost: float = 0.001) -> LanguageModel:
    """Stochastic gradient descent on (buckets, counts) of each text; every fifth text calibrates.

    The temperature minimises the log loss of the calibration texts. The threshold rejects no more than ``lost``
    of those that are predicted rightly, with a margin of a half.
    """
    rng = np.random.default_rng(seed)
    order = rng.permutation(len(bag))
    held = order[::5] if len(bag) >= 50 else order
    train = np.setdiff1d(order, held) if len(bag) >= 50 else order
    emb = rng.normal(0, 1 / dim, (1 << bits, dim)).astype(np.float32)
    w, b = np.zeros((dim, len(langs)), np.float32), np.zeros(len(langs), np.float32)
    queue = np.zeros(0, np.int64)
    for done in range(steps):
        if len(queue) < 16:
            queue = np.concatenate([queue, rng.permutation(train)])
        rows, queue = queue[:16], queue[16:]
        used = np.unique(np.concatenate([bag[r][0] for r in rows]))
        x = np.zeros((len(rows), len(used)), np.float32)
        for k, r in enumerate(rows):
            x[k, np.searchsorted(used, bag[r][0])] = bag[r][1]
        x /= np.maximum(1, x.sum(axis=1, keepdims=True))
        h = x @ emb[used]
        g = softmax(h @ w + b).astype(np.float32)
        g[np.arange(len(rows)), label[rows]] -= 1
        g *= rate * (1 - done / steps) / len(rows)
        gh = g @ w.T
        w -= h.T @ g
        b -= g.sum(axis=0)
        emb[used] -= (x.T @ gh) * np.float32((1 << bits) ** 0.5 / 8)
    model = LanguageModel(list(langs), emb @ w, b.astype(np.float64), bits)
    z = np.array([n @ model.table[at] / max(1.0, float(n.sum())) for at, n in (bag[r] for r in held)]) + b
    y = label[held]
    loss = {t: -np.log(softmax(z / t)[np.arange(len(y)), y] + 1e-12).mean() for t in np.geomspace(0.1, 10, 41)}
    model.temperature = float(min(loss, key=loss.get))
    p = softmax(z / model.temperature)
    right = p.max(axis=1)[p.argmax(axis=1) == y]
    model.threshold = float(np.quantile(right, lost) / 2) if len(right) else 0.0
    return model


def train(docs: DataFrame, usable: Column, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang",
          sample: int = 3000, bits: int = 14) -> LanguageModel:
    """A model of the rows where ``usable``, from about ``sample`` different texts, twice as many at most.

    Every language gives the same expected number, drawn by a hash of the text; rows without text or language don't
    count, ids play no part. A text that stands in several rows counts once a language, so that repeated rows can't
    fill the sample. Only the subword counts of the sample leave the executors, at most 2**bits
    a text. With no rows there is no language and the model is empty.
    """
    import pyarrow as pa
    ship(docs.sparkSession)
    d = docs.where(usable & F.col(lang_col).isNotNull() & F.col(text_col).isNotNull()).select(
        F.col(id_col).alias("doc_id"), F.col(lang_col).cast("string").alias("lang"), F.col(text_col).cast("string").alias("text"))
    d = d.withColumn("h", F.xxhash64("text", F.lit("language sample")))
    counts = {r["lang"]: max(1, r["n"]) for r in d.groupBy("lang").agg(F.approx_count_distinct("h").alias("n")).collect()}
    if not counts:
        return LanguageModel(bits=bits)
    langs, each = sorted(counts), sample / len(counts)
    share = F.create_map(*[F.lit(x) for k in langs for x in (k, min(1.0, each / counts[k]))])
    drawn = (d.where(F.pmod(F.xxhash64("h"), F.lit(1 << 30)) < share[F.col("lang")] * (1 << 30))
             .dropDuplicates(["lang", "h"]).orderBy("h", "lang").limit(2 * sample))

    def run(batches):
        import pyarrow as pa
        for b in batches:
            raw, off = text_bytes(b.column(1))
            at, n = [], []
            for bag in bags(raw, off, bits):
                k = np.flatnonzero(bag)
                at.append(k.astype("<u2").tobytes()), n.append(np.minimum(bag[k], 65_535).astype("<u2").tobytes())
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(at, pa.binary()), pa.array(n, pa.binary()), b.column(2)],
                                             names=["lang", "at", "n", "h"])

    got = drawn.select("lang", "text", "h").mapInArrow(run, "lang string, at binary, n binary, h long").orderBy("h", "lang").toArrow()
    if not got.num_rows:
        return LanguageModel(bits=bits)
    bag = [(np.frombuffer(a.as_py(), "<u2"), np.frombuffer(n.as_py(), "<u2")) for a, n in zip(got.column("at"), got.column("n"))]
    label = np.array([langs.index(x) for x in got.column("lang").to_pylist()])
    del got
    pa.default_memory_pool().release_unused()  # the driver keeps no copy while it trains
    return fit(bag, label, langs, bits)


def predict(docs: DataFrame, model: LanguageModel, text_col: str = "text") -> DataFrame:
    """``docs`` with lang_pred, score and accepted; columns of these names are replaced.

    Each whole text is scored by itself. lang_pred is ``und``, with score 0, for a null text, one without a letter,
    or an empty model. ``accepted`` is false for these and where the calibrated score is below the threshold.
    """
    ship(docs.sparkSession)
    spark, own = docs.sparkSession, ("lang_pred", "score", "accepted")
    shared = spark.sparkContext.broadcast(model)  # 2**bits rows of one number a language
    kept = [c for c in docs.columns if c not in own]
    d = docs.select(*[F.col(f"`{c}`") for c in kept], F.col(text_col).cast("string").alias("__text"))

    def run(batches):
        import pyarrow as pa
        import regex
        m, letter = shared.value, regex.compile(rb"[A-Za-z]")
        wide = regex.compile(r"\p{L}")
        for b in batches:
            raw, off = text_bytes(b.column(len(kept)))
            whole = raw.tobytes()
            has = np.array([bool(letter.search(whole, a, z) or wide.search(whole[a:z].decode("utf-8", "replace")))
                            for a, z in zip(off[:-1].tolist(), off[1:].tolist())], bool)
            p = m.probabilities(raw, off) if m.langs else np.zeros((b.num_rows, 1))
            has &= bool(m.langs)
            best = p.argmax(axis=1)
            score = np.where(has, p.max(axis=1), 0.0)
            lang = [m.langs[i] if ok else UNDETERMINED for i, ok in zip(best, has)]
            yield pa.RecordBatch.from_arrays(
                [*b.columns[:len(kept)], pa.array(lang, pa.string()), pa.array(score), pa.array(has & (score >= m.threshold))],
                names=[*kept, *own])

    schema = d.select(*[F.col(f"`{c}`") for c in kept]).schema.add("lang_pred", "string").add("score", "double").add("accepted", "boolean")
    return d.mapInArrow(run, schema)
