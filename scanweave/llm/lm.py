"""Language-model scores: a log-bilinear model trained by noise-contrastive estimation in numpy.

Tokens are words, lower-cased A-Z and split at ASCII white space, and one end token a text. The base score is the
add-one unigram model of all training tokens. The model predicts classes: each of the most frequent words, the end
token, and one class for all other words, inside which a word has its add-one share. So the log-probabilities of
all words, unknown ones included, add up to one after every context.
"""

from __future__ import annotations

import math
from collections import Counter
from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame, functions as F

from scanweave.llm.base import fold, ship, stored, texts


def _frame(docs: DataFrame, id_col: str, text_col: str, folds: int) -> DataFrame:
    return docs.select(F.col(id_col).cast("long").alias("doc_id"), fold(F.col(id_col), folds).cast("int").alias("fold"),
                       F.col(text_col).cast("string").alias("text"))


def word_counts(frame: DataFrame, held_fold: int) -> DataFrame:
    """(word binary, count) over all training texts; words are added up in each batch before they are shuffled."""
    def run(batches):
        import pyarrow as pa
        for b in batches:
            count = Counter()
            for t in texts(b.column(0)):
                count.update(t.lower().split())
            yield pa.RecordBatch.from_arrays([pa.array(list(count), pa.binary()), pa.array(list(count.values()), pa.int64())],
                                             names=["word", "n"])

    return (frame.where(F.col("fold") != held_fold).select("text").mapInArrow(run, "word binary, n long")
            .groupBy("word").agg(F.sum("n").alias("n")))


@dataclass
class Vocabulary:
    """Counts that every task needs: at most ``common`` words of at most ``longest`` bytes, and totals."""
    classes: list[bytes]      # the most frequent words, one class each
    common: dict[bytes, int]  # count of each common word; the others' counts are joined
    tokens: int               # N, end tokens included
    distinct: int             # V, the end token included if there is one
    ends: int

    @property
    def end(self) -> int:
        return len(self.classes)

    @property
    def other(self) -> int:
        return len(self.classes) + 1

    @property
    def size(self) -> int:
        return len(self.classes) + 2

    @property
    def rest(self) -> float:
        """Add-one mass of all words without a class, one unknown word included."""
        return self.tokens + self.distinct + 1 - sum(self.common[w] + 1 for w in self.classes) - (self.ends + 1)

    def unigram(self) -> np.ndarray:
        n = np.array([self.common[w] + 1 for w in self.classes] + [self.ends + 1, max(self.rest, 1.0)], float)
        return n / n.sum()


def vocabulary(counts: DataFrame, ends: int, classes: int, common: int, longest: int = 64) -> Vocabulary:
    """Totals over all counts, and the words above the least frequency that at most ``common`` words reach.

    Frequencies are looked at in steps of 1/32 of a doubling, so that the driver gets a row a step and then at
    most ``common`` words, whatever the number of distinct words.
    """
    step = F.floor(F.log2("n") * 32)
    seen = counts.groupBy(step.alias("s"), (F.octet_length("word") <= longest).alias("fits")).agg(
        F.count(F.lit(1)).alias("words"), F.sum("n").alias("n")).collect()
    least, held = math.inf, 0
    for s, words in sorted(((r["s"], r["words"]) for r in seen if r["fits"]), reverse=True):
        held += words
        if held > common:
            break
        least = s
    top = counts.where((F.octet_length("word") <= longest) & (step >= least)).collect() if least < math.inf else []
    top = sorted(((bytes(r["word"]), r["n"]) for r in top), key=lambda x: (-x[1], x[0]))
    tokens, distinct = sum(r["n"] for r in seen), sum(r["words"] for r in seen)
    return Vocabulary([w for w, _ in top[:classes]], dict(top), tokens + ends, distinct + (ends > 0), ends)


@dataclass
class LogBilinear:
    """Scores of the next class: context vectors, weighted by place, times class vectors, plus biases."""
    context: np.ndarray   # (classes, dim)
    place: np.ndarray     # (order, dim)
    target: np.ndarray    # (classes, dim)
    bias: np.ndarray

    @classmethod
    def start(cls, unigram: np.ndarray, dim: int, order: int, seed: int) -> "LogBilinear":
        rng = np.random.default_rng(seed)
        n = len(unigram)
        return cls(rng.normal(0, 0.1, (n, dim)).astype(np.float32), np.ones((order, dim), np.float32),
                   rng.normal(0, 0.1, (n, dim)).astype(np.float32), np.log(unigram).astype(np.float32))

    def flat(self) -> np.ndarray:
        return np.concatenate([x.ravel() for x in (self.context, self.place, self.target, self.bias)])

    def filled(self, values: np.ndarray) -> "LogBilinear":
        out, at = [], 0
        for x in (self.context, self.place, self.target, self.bias):
            out.append(values[at:at + x.size].reshape(x.shape).astype(np.float32))
            at += x.size
        return LogBilinear(*out)

    def log_probabilities(self, contexts: np.ndarray, targets: np.ndarray) -> np.ndarray:
        """Natural logs, normalised over all classes; each distinct context is one row of a matrix product."""
        n = len(self.bias)
        code = np.zeros(len(targets), np.int64)
        for k in range(contexts.shape[1]):
            code = code * n + contexts[:, k]
        distinct, first, back = np.unique(code, return_index=True, return_inverse=True)
        order = np.argsort(back, kind="stable")
        ends = np.cumsum(np.bincount(back, minlength=len(distinct)))
        out = np.empty(len(targets))
        for a in range(0, len(distinct), 4096):
            z = min(len(distinct), a + 4096)
            rows = order[(ends[a - 1] if a else 0):ends[z - 1]]
            h = self._hidden(contexts[first[a:z]])
            s = h @ self.target.T + self.bias
            s -= s.max(axis=1, keepdims=True)
            s -= np.log(np.exp(s).sum(axis=1, keepdims=True))
            out[rows] = s[back[rows] - a, targets[rows]]
        return out

    def _hidden(self, contexts: np.ndarray) -> np.ndarray:
        return sum(self.context[contexts[:, k]] * self.place[k] for k in range(contexts.shape[1]))

    def learn(self, contexts: np.ndarray, targets: np.ndarray, unigram: np.ndarray, squares: list[np.ndarray], rng,
              noise: int = 64, batch: int = 1024, rate: float = 0.1) -> None:
        """One pass of noise-contrastive estimation with Adagrad; a batch shares its noise words, drawn from the
        unigrams. ``squares`` are the sums of squared gradients so far, as in ``blank``, and are added to.
        """
        log_noise = np.log(unigram * noise).astype(np.float32)
        order = rng.permutation(len(targets))
        draw = np.cumsum(unigram)
        n = len(self.bias)
        for at in range(0, len(order), batch):
            rows = order[at:at + batch]
            c, y = contexts[rows], targets[rows]
            h = self._hidden(c)
            k = np.minimum(np.searchsorted(draw, rng.random(noise)), n - 1)
            ty = self.target[y]
            sy = np.einsum("bd,bd->b", h, ty) + self.bias[y] - log_noise[y]
            sk = h @ self.target[k].T + self.bias[k] - log_noise[k]
            gy = (1 / (1 + np.exp(np.clip(sy, -30, 30)))).astype(np.float32)      # up the data
            gk = -(1 / (1 + np.exp(-np.clip(sk, -30, 30)))).astype(np.float32)    # down the noise
            gh = gy[:, None] * ty + gk @ self.target[k]
            one = _add(n, np.concatenate([y, k]), np.concatenate([gy[:, None] * h, gk.T @ h]))
            gb = np.bincount(y, gy, n) + np.bincount(k, gk.sum(axis=0), n)
            gp = np.stack([np.einsum("bd,bd->d", gh, self.context[c[:, j]]) for j in range(c.shape[1])])
            gc = _add(n, c.T.ravel(), np.concatenate([gh * p for p in self.place]))
            for x, g, q in zip((self.context, self.place, self.target, self.bias), (gc, gp, one, gb.astype(np.float32)), squares):
                g /= len(rows)
                q += g * g
                x += np.float32(rate) * g / np.sqrt(q)

    def blank(self) -> list[np.ndarray]:
        return [np.full_like(x, 1e-6) for x in (self.context, self.place, self.target, self.bias)]


def _add(n: int, at: np.ndarray, rows: np.ndarray) -> np.ndarray:
    """(n, dim) with each row added at its place."""
    dim = rows.shape[1]
    flat = (at[:, None] * dim + np.arange(dim, dtype=at.dtype)).ravel()
    return np.bincount(flat, rows.ravel(), n * dim).reshape(n, dim).astype(np.float32)


def _classes(batch: list[bytes], v: Vocabulary, code: dict[bytes, int], order: int):
    """Contexts, targets, and text of each token; a text starts after ``order`` end tokens."""
    other, end, flat, owner, start = v.other, v.end, [], [], []
    for k, words in enumerate(batch):
        ids = [code.get(w, other) for w in words]
        start.append(len(flat))
        flat.extend([end] * order)
        flat.extend(ids)
        flat.append(end)
        owner.append(len(ids) + 1)
    seq = np.array(flat, np.int32)
    own = np.repeat(np.arange(len(batch)), owner)
    at = np.arange(len(own)) + (own + 1) * order
    return np.stack([seq[at - j - 1] for j in range(order)], axis=1), seq[at], own


def train(frame: DataFrame, held_fold: int, v: Vocabulary, rounds: int = 1, dim: int = 12, order: int = 2,
          merge: int = 32, seed: int = 5) -> LogBilinear:
    """Every task learns from all training texts of its split, starting from the same weights; their mean by
    tokens starts the next round. Means are taken ``merge`` at a time by tasks, so that the driver gets one.
    """
    spark = frame.sparkSession
    ship(spark)
    unigram = v.unigram()
    model = LogBilinear.start(unigram, dim, order, seed)
    if not v.tokens:
        return model
    text = frame.where(F.col("fold") != held_fold).select("text")
    for r in range(rounds):
        shared = spark.sparkContext.broadcast((model, v))  # classes * dim numbers

        def run(batches, r=r, shared=shared):
            import pyarrow as pa
            from pyspark import TaskContext
            part = TaskContext.get().partitionId()
            first, v = shared.value
            m, code, rng, tokens = first.filled(first.flat()), {w: i for i, w in enumerate(v.classes)}, np.random.default_rng([seed, r, part]), 0
            unigram, squares, rate = v.unigram(), m.blank(), 0.1 / (1 + r)
            for b in batches:
                words = texts(b.column(0))
                for at in range(0, len(words), 256):
                    c, y, _ = _classes([t.lower().split() for t in words[at:at + 256]], v, code, m.place.shape[0])
                    m.learn(c, y, unigram, squares, rng, rate=rate)
                    tokens += len(y)
            if tokens:
                yield pa.RecordBatch.from_arrays(
                    [pa.array([part], pa.int64()), pa.array([float(tokens)]), pa.array([(m.flat() * np.float64(tokens)).tobytes()], pa.binary())],
                    names=["part", "tokens", "sum"])

        def add(key, group):
            import pyarrow as pa
            total = sum(np.frombuffer(x.as_py(), np.float64) for x in group.column("sum"))
            return pa.Table.from_arrays([pa.array([key[0].as_py()], pa.int64()), pa.array([float(sum(group.column("tokens").to_pylist()))]),
                                         pa.array([total.tobytes()], pa.binary())], names=["part", "tokens", "sum"])

        kind = "part long, tokens double, sum binary"
        sums = stored(text.mapInArrow(run, kind))
        most = sums.agg(F.max("part")).first()[0] or 0
        while most:
            sums = sums.withColumn("part", F.floor(F.col("part") / merge)).groupBy("part").applyInArrow(add, kind)
            most //= merge
        got = sums.collect()
        if got:
            model = model.filled(np.frombuffer(got[0]["sum"], np.float64) / got[0]["tokens"])
    return model


def score(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", folds: int = 7, held_fold: int = 2,
          classes: int = 512, common: int = 1 << 18, order: int = 2) -> DataFrame:
    """(doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score) of every whole text, in log10.

    Counts cover all training texts. Those of the ``common`` most frequent words go to every task, the rest is
    joined by word: so a word that fills the corpus is never a join key, and what is shuffled are rare words.
    Null text: empty, with its end token only. Repeated ids keep a row each; a null id is a training row of the
    fold of an empty string. With no training text all words are unknown and the model is uniform over nothing
    but its two classes.
    """
    spark = docs.sparkSession
    ship(spark)
    frame = _frame(docs, id_col, text_col, folds)
    counts = stored(word_counts(frame, held_fold))
    ends = frame.where(F.col("fold") != held_fold).count()
    v = vocabulary(counts, ends, classes, common)
    model = train(frame, held_fold, v, order=order)
    shared = spark.sparkContext.broadcast((model, v))

    def run(batches):
        import pyarrow as pa
        from pyspark import TaskContext
        m, v = shared.value
        part, serial = TaskContext.get().partitionId(), 0
        code = {w: i for i, w in enumerate(v.classes)}
        counted = {w: (np.log10(n + 1), i >= len(v.classes)) for i, (w, n) in enumerate(v.common.items())}
        whole = np.log10(v.tokens + v.distinct + 1)
        rest, end = np.log10(max(v.rest, 1.0)), np.log10(v.ends + 1)
        for b in batches:
            whole_texts = texts(b.column(2))
            for at in range(0, len(whole_texts), 256):
                group = [t.lower().split() for t in whole_texts[at:at + 256]]
                c, y, own = _classes(group, v, code, m.place.shape[0])
                lm = np.bincount(own, m.log_probabilities(c, y), len(group)) / np.log(10)
                row, known, base, inner, rare, rare_n, rare_row = [], [], [], [], [], [], []
                for k, ws in enumerate(group):
                    hit = n_other = 0
                    sum_base = sum_other = 0.0
                    for w, n in Counter(ws).items():
                        found = counted.get(w)
                        if found is None:
                            rare.append(w), rare_n.append(n), rare_row.append(k)
                            n_other += n
                        else:
                            hit += n
                            sum_base += n * found[0]
                            if found[1]:
                                sum_other += n * found[0]
                                n_other += n
                    row.append((part << 33) + serial + k)
                    known.append(hit + (v.ends > 0)), base.append(sum_base + end - (len(ws) + 1) * whole)
                    inner.append(sum_other - n_other * rest)
                serial += len(group)
                key = np.array(row, np.int64)
                pad = [None] * len(rare)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.concatenate([key, key[rare_row] if rare else key[:0]])),
                     pa.array([None] * len(group) + rare, pa.binary()),
                     pa.array([len(ws) + 1 for ws in group] + rare_n, pa.int64()),
                     pa.concat_arrays([b.column(0).slice(at, len(group)), pa.nulls(len(rare), pa.int64())]),
                     pa.concat_arrays([b.column(1).slice(at, len(group)), pa.nulls(len(rare), pa.int32())]),
                     pa.array(known + pad, pa.int64()), pa.array(base + pad, pa.float64()),
                     pa.array((lm + np.array(inner)).tolist() + pad, pa.float64())],
                    names=["row", "word", "n", "doc_id", "fold", "known", "base", "score"])

    kind = "row long, word binary, n long, doc_id long, fold int, known long, base double, score double"
    scored = stored(frame.mapInArrow(run, kind))
    rare = scored.where("word is not null").select("row", "word", "n")
    found = (rare.join(counts.withColumnRenamed("n", "c"), "word")
             .groupBy("row").agg(F.sum("n").alias("more_known"), F.sum(F.col("n") * F.log10(F.col("c") + 1.0)).alias("more")))
    out = scored.where("word is null").join(found, "row", "left")
    more = F.coalesce("more", F.lit(0.0))
    return out.select("doc_id", (F.col("fold") == held_fold).alias("held_out"), F.col("n").alias("n_tokens"),
                      (F.col("known") + F.coalesce("more_known", F.lit(0))).alias("n_known"),
                      F.lit(v.tokens).cast("long").alias("train_tokens"), (F.col("base") + more).alias("base_score"),
                      (F.col("score") + more).alias("score"))
