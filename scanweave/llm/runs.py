"""Periodic runs of words: suffix classes united by descending common prefix."""

from __future__ import annotations

from bisect import bisect_left, bisect_right
from itertools import count

import numpy as np
from pyspark.sql import DataFrame, functions as F

from scanweave.llm.base import ship, texts


class Places:
    """An ordered set of places in blocks, so that putting one in moves a bounded number of others."""

    __slots__ = ("blocks", "tops", "size")
    BLOCK = 1024

    def __init__(self, place: int):
        self.blocks, self.tops, self.size = [[place]], [place], 1

    def put(self, x: int) -> tuple[int, int]:
        """Puts ``x`` in; the place before it and the one after it (-1: none)."""
        blocks, tops = self.blocks, self.tops
        self.size += 1
        last = blocks[-1]
        if x > tops[-1]:  # the usual case: at the end
            before = tops[-1]
            tops[-1] = x
            last.append(x)
            if len(last) > 2 * self.BLOCK:
                self._cut(len(blocks) - 1)
            return before, -1
        b = bisect_left(tops, x)
        block = blocks[b]
        i = bisect_right(block, x)
        after = block[i]
        before = block[i - 1] if i else blocks[b - 1][-1] if b else -1
        block.insert(i, x)
        if len(block) > 2 * self.BLOCK:
            self._cut(b)
        return before, after

    def _cut(self, b: int) -> None:
        block = self.blocks[b]
        half = len(block) // 2
        self.blocks[b:b + 1] = [block[:half], block[half:]]
        self.tops[b:b + 1] = [block[half - 1], block[-1]]

    def __iter__(self):
        for block in self.blocks:
            yield from block


def repeated_windows(w: np.ndarray, doc: np.ndarray, width: int) -> np.ndarray:
    """Places whose next ``width`` words occur at another place of the same document too.

    Told by a 64-bit hash; two windows of one hash cost some time and no result, as prefixes are compared later.
    """
    n = len(w) - width + 1
    if n < 2:
        return np.zeros(0, np.int64)
    h = np.zeros(n, np.uint64)
    for j in range(width):
        h = (h ^ (w[j:j + n].astype(np.uint64) + np.uint64(0x9E3779B97F4A7C15))) * np.uint64(0xFF51AFD7ED558CCD)
        h ^= h >> np.uint64(32)
    inside = np.flatnonzero(doc[:n] == doc[width - 1:])
    if len(inside) < 2:
        return inside[:0]
    order = inside[np.argsort(h[inside], kind="stable")]
    same = h[order[1:]] == h[order[:-1]]
    return np.sort(order[np.concatenate([same, [False]]) | np.concatenate([[False], same])])


def suffix_neighbours(w: np.ndarray, least: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(a, b, l): neighbours in suffix order with ``l`` words in common, ``l`` >= ``least``.

    ``w`` are non-negative ids, different ones in different documents. Ranks by 1, 2, 4, ... words are kept: by them
    the common prefix of neighbours is read off from the longest step down, exactly.
    """
    n = len(w)
    _, rank = np.unique(w, return_inverse=True)
    levels = [rank.astype(np.int32)]
    order = np.argsort(levels[0], kind="stable")
    step = 1
    while step < n:
        r = levels[-1]
        tied = r[order][1:] == r[order][:-1]
        if not tied.any():
            break
        open_ = np.concatenate([tied, [False]]) | np.concatenate([[False], tied])
        at = order[open_]
        nxt = np.where(at + step < n, r[np.minimum(at + step, n - 1)], -1)
        o = np.lexsort((nxt, r[at]))
        at, nxt = at[o], nxt[o]
        order[open_] = at
        # ranks are the place of a class's first member in the order
        new = np.ones(n, bool)
        inner = np.flatnonzero(open_)
        new[inner[1:]] = (r[at[1:]] != r[at[:-1]]) | (nxt[1:] != nxt[:-1])
        first = np.maximum.accumulate(np.where(new, np.arange(n), 0))
        fresh = np.empty(n, np.int32)
        fresh[order] = first
        levels.append(fresh)
        step *= 2
    a, b = order[:-1], order[1:]
    keep = w[a] == w[b]
    a, b = a[keep], b[keep]
    length = np.zeros(len(a), np.int64)
    for k in range(len(levels) - 1, -1, -1):
        x, y = a + length, b + length
        inside = (x < n) & (y < n)
        same = inside & (levels[k][np.minimum(x, n - 1)] == levels[k][np.minimum(y, n - 1)])
        length[same] += 1 << k
    keep = length >= least
    return a[keep], b[keep], length[keep]


def periodic_runs(w: np.ndarray, cuts: np.ndarray, least: int, times: int) -> list[tuple[int, int, int]]:
    """(start, length, period) of all runs in the documents ``w[cuts[i]:cuts[i + 1]]``, by start and period.

    A run is a stretch with smallest period q, which no neighbour extends, of at least ``least`` words and ``times``
    periods (at least two). Suffixes are united by decreasing common prefix; each class keeps its places in order.
    Where i and j become neighbours by uniting at l words in common and j - i <= l, the words from i to j + l have
    period j - i, and it is their smallest: a smaller one q would put i + q, which shares more with i, between them. The end is exact;
    the run is the seed whose start can't be moved to the left. As a run has ``times`` periods, only classes of at
    least max((times - 1) * q, least - q) common words matter, and l is never below ``least`` * (times - 1) / times.
    """
    doc = np.repeat(np.arange(len(cuts) - 1), np.diff(cuts))
    floor_ = max(1, -(-least * (times - 1) // times))
    some = repeated_windows(w, doc, floor_)
    if not len(some):
        return []
    # whole documents with a repeated window, one after the other
    used = np.unique(doc[some])
    part = np.concatenate([np.arange(cuts[d], cuts[d + 1]) for d in used.tolist()])
    sub = w[part]
    a, b, length = suffix_neighbours(sub, floor_)
    by = np.argsort(-length, kind="stable")
    edges = zip(a[by].tolist(), b[by].tolist(), length[by].tolist())
    group: dict[int, Places] = {}
    top = list(range(len(sub)))
    seeds = []
    for x, y, l in edges:
        rx = x
        while top[rx] != rx:
            top[rx] = rx = top[top[rx]]
        ry = y
        while top[ry] != ry:
            top[ry] = ry = top[top[ry]]
        px, py = group.get(rx), group.get(ry)
        if (px.size if px else 1) < (py.size if py else 1):
            rx, ry, px, py = ry, rx, py, px
        if px is None:
            px = group[rx] = Places(rx)
        top[ry] = rx
        reach = l // (times - 1)
        if py is None:
            before, after = px.put(ry)
            if before >= 0 and ry - before <= reach:
                seeds.append((before, ry, l))
            if after >= 0 and after - ry <= reach:
                seeds.append((ry, after, l))
            continue
        last = after = -1  # the place put in before, and the one of the other class that follows it
        for z in py:
            if last < after < z and after - last <= reach:
                seeds.append((last, after, l))
            before, nxt = px.put(z)
            if before != last and before >= 0 and z - before <= reach:
                seeds.append((before, z, l))
            last, after = z, nxt
        if after >= 0 and after - last <= reach:
            seeds.append((last, after, l))
        del group[ry]
    if not seeds:
        return []
    i, j, l = np.array(seeds, np.int64).T
    first = part[i] == cuts[doc[part[i]]]
    moved = ~first & (sub[np.maximum(i - 1, 0)] == sub[np.maximum(j - 1, 0)])
    i, j, l = i[~moved], j[~moved], l[~moved]
    q, size = j - i, j - i + l
    ok = (size >= least) & (size >= times * q)
    found = np.unique(np.stack([part[i[ok]], q[ok], size[ok]], axis=1), axis=0)
    return [(s, n, p) for s, p, n in found.tolist()]


def document_runs(parts: list[list[bytes]], least: int = 6, times: int = 4) -> list[list[tuple[int, int, int]]]:
    """The runs of each document of words: (start, length, period) by start, then period."""
    cuts = np.concatenate([[0], np.cumsum([len(p) for p in parts])]).astype(np.int64)
    ids = np.empty(int(cuts[-1]), np.int64)
    for k, words in enumerate(parts):  # a word is the place of its first occurrence in its document
        ids[cuts[k]:cuts[k + 1]] = np.fromiter(map({}.setdefault, words, count()), np.int64, len(words))
        ids[cuts[k]:cuts[k + 1]] += cuts[k]
    out: list[list[tuple[int, int, int]]] = [[] for _ in parts]
    found = periodic_runs(ids, cuts, least, times)
    where = np.searchsorted(cuts, [s for s, _, _ in found], "right") - 1
    for (s, n, p), d in zip(found, where.tolist()):
        out[d].append((s - int(cuts[d]), n, p))
    return out


def collapsed(words: list[bytes], runs: list[tuple[int, int, int]]) -> bytes:
    """The words that no run contains after its first period, with one space between."""
    if not runs:
        return b" ".join(words)
    edge = np.zeros(len(words) + 1, np.int64)
    for s, n, p in runs:
        edge[s + p] += 1
        edge[s + n] -= 1
    keep = np.flatnonzero(np.cumsum(edge[:-1]) == 0)
    return b" ".join([words[k] for k in keep.tolist()])


def collapse_runs(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", least: int = 6, times: int = 4,
                  words_at_once: int = 1 << 17) -> DataFrame:
    """(doc_id, runs array of (start, length, period), best (start, length, period), collapsed) of every row of ``docs``.

    Words are what stands between ASCII white space, numbered from 0. ``runs`` are all stretches that repeat with a
    smallest period q at least ``times`` times, of at least ``least`` words, as long as they go, by start, then
    period; ``best`` has the greatest length / period, ties by start, then period (null without a run);
    ``collapsed`` is the text without what follows the first period of a run, its words joined by a space.

    A null or empty text has no words and no run, and is collapsed to an empty text. Repeated rows have a row each,
    null ids too. An empty table gives an empty result. Other columns of ``docs`` don't matter. Rows don't meet, so
    nothing is shuffled; a task sorts suffixes of about ``words_at_once`` words at a time, or of one longer text.
    """
    ship(docs.sparkSession)

    def run(batches):
        import pyarrow as pa
        span = pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())])

        def made(ids, parts):
            runs = document_runs(parts, least, times)
            best = [max(r, key=lambda x: (_Ratio(x[1], x[2]), -x[0], -x[2]), default=None) for r in runs]
            flat = [x for r in runs for x in r]
            ends = np.concatenate([[0], np.cumsum([len(r) for r in runs])]).astype(np.int32)

            def spans(rows):
                cols = [pa.array([None if x is None else x[c] for x in rows], pa.int64()) for c in range(3)]
                return pa.StructArray.from_arrays(cols, fields=list(span), mask=pa.array([x is None for x in rows], pa.bool_()))

            text = pa.array([collapsed(p, r) for p, r in zip(parts, runs)], pa.binary()).cast(pa.string())
            return pa.RecordBatch.from_arrays([ids, pa.ListArray.from_arrays(pa.array(ends), spans(flat)), spans(best), text],
                                              names=["doc_id", "runs", "best", "collapsed"])

        for b in batches:
            at, parts, held = 0, [], 0
            for k in range(b.num_rows):
                parts.append(texts(b.column(1).slice(k, 1))[0].split())
                held += len(parts[-1])
                if held >= words_at_once:
                    yield made(b.column(0).slice(at, k + 1 - at), parts)
                    at, parts, held = k + 1, [], 0
            if parts:
                yield made(b.column(0).slice(at), parts)

    span = "struct<start:bigint,length:bigint,period:bigint>"
    return (docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
            .mapInArrow(run, f"doc_id long, runs array<{span}>, best {span}, collapsed string"))


class _Ratio:
    """length / period, compared exactly."""

    __slots__ = ("n", "q")

    def __init__(self, n: int, q: int):
        self.n, self.q = n, q

    def __eq__(self, other):
        return self.n * other.q == other.n * self.q

    def __lt__(self, other):
        return self.n * other.q < other.n * self.q

    def __gt__(self, other):
        return self.n * other.q > other.n * self.q


def with_planted_runs(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, text): with h = crc32 of the decimal id and g = h div 10, where h is divisible by 10 and the text has
    n words, word i from a = g % n on becomes word a + (i - a) % p, p = 1 + (n - a) div (3 + g % 8), words joined by
    a space. All other texts, and those without an id, stay as they are.
    """
    d = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    h = F.crc32(F.col("doc_id").cast("string"))

    def planted(w):
        n, g = F.size(w).cast("long"), F.floor(h / 10)
        a = g % n
        p = 1 + F.floor((n - a) / (3 + g % 8))
        return F.array_join(F.transform(w, lambda x, i: F.when(i < a, x).otherwise(F.get(w, (a + (i - a) % p).cast("int")))), " ")

    words = F.filter(F.split("text", r"[\x20\x09-\x0D]+"), lambda w: w != "")
    return d.select("doc_id", F.when((h % 10 == 0) & F.col("text").rlike(r"[^\x20\x09-\x0D]"),
                                     F.transform(F.array(words), planted)[0]).otherwise(F.col("text")).alias("text"))


def run_digests(runs: DataFrame) -> DataFrame:
    """(doc_id, n_runs, start, length, period, exponent_milli, runs_sha256, collapsed_sha256) of ``collapse_runs``."""
    lines = F.concat_ws("", F.transform("runs", lambda r: F.concat(r["start"], F.lit(","), r["length"], F.lit(","), r["period"], F.lit("\n"))))
    return runs.select(
        "doc_id", F.size("runs").cast("long").alias("n_runs"), "best.start", "best.length", "best.period",
        F.expr("(1000 * best.length) div best.period").alias("exponent_milli"),
        F.sha2(lines, 256).alias("runs_sha256"), F.sha2("collapsed", 256).alias("collapsed_sha256"))
