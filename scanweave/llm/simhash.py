"""Near duplicates by SimHash fingerprints, candidates by pigeonring chains."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, functions as F

from scanweave.llm.base import ship, stored, texts
from scanweave.llm.components import connected_components

BITS = 64


def fingerprint(text: bytes, width: int = 3, seed: int = 42) -> int:
    """Majority of the XXH64 bits of all word shingles, as a signed 64-bit number; no words: 0."""
    import xxhash
    words = text.lower().split()  # of bytes: A-Z only, ASCII white space only
    if not words:
        return 0
    if len(words) <= width:
        shingles = [b" ".join(words)]
    else:
        joined = b" ".join(words)
        ends = np.cumsum([len(w) + 1 for w in words]) - 1
        starts = np.concatenate([[0], ends[:-1] + 1])
        shingles = [joined[a:b] for a, b in zip(starts[:len(words) - width + 1].tolist(), ends[width - 1:].tolist())]
    digest, total = xxhash.xxh64_intdigest, np.zeros(BITS, np.int64)
    for at in range(0, len(shingles), 1 << 16):
        h = np.array([digest(s, seed) for s in shingles[at:at + (1 << 16)]], dtype=">u8")
        total += np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1).sum(axis=0, dtype=np.int64)
    return int(np.packbits(total * 2 > len(shingles)).view(">i8")[0])


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 3) -> DataFrame:
    """(doc_id, fingerprint long) of every row; whole texts, null text like an empty one."""
    ship(docs.sparkSession)

    def run(batches):
        import pyarrow as pa
        for b in batches:
            fp = pa.array([fingerprint(t, width) for t in texts(b.column(1))], pa.int64())
            yield pa.RecordBatch.from_arrays([b.column(0), fp], names=["doc_id", "fingerprint"])

    return (docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
            .mapInArrow(run, "doc_id long, fingerprint long"))


def chain_budgets(segments: int, distance: int) -> list[int]:
    """Most differences that a viable chain may show in its first 1, 2, ... segments."""
    return [distance * n // segments for n in range(1, segments + 1)]


def ring_entries(prints: DataFrame, segments: int, distance: int) -> DataFrame:
    """(key, ring, fp): the index entries of each distinct fingerprint.

    Some start on the ring of segments has a chain whose cumulative differences stay within
    ``chain_budgets``. So its first segments, while the budget is 0, are equal, and in the next ones, while
    it is 1, one of two halves is equal: a key is the start, the equal head and one half. ``ring`` is the
    fingerprint turned so that the chain begins at its top bit.
    """
    width, budget = BITS // segments, chain_budgets(segments, distance)
    head = width * sum(b == 0 for b in budget)
    tail = width * sum(b == 1 for b in budget)
    half = tail // 2
    cuts = [(head, half), (head + half, tail - half)] if budget[0] == 0 and tail else [(head, 0)]
    entries = []
    for start in range(segments):
        turn = start * width
        ring = F.expr(f"shiftleft(fp, {turn}) | shiftrightunsigned(fp, {BITS - turn})" if turn else "fp")
        top = F.shiftrightunsigned(ring, BITS - head) if head else F.lit(0).cast("long")
        for k, (at, n) in enumerate(cuts):
            part = F.shiftrightunsigned(F.shiftleft(ring, at), BITS - n) if n else F.lit(0).cast("long")
            key = F.shiftleft(top, n).bitwiseOR(part).bitwiseOR(F.lit((start * len(cuts) + k) << (head + n)).cast("long"))
            entries.append(F.struct(key.alias("key"), ring.alias("ring")))
    return prints.select("fp", F.explode(F.array(*entries)).alias("e")).select("e.key", "e.ring", "fp")


def _hub_edges(dense: DataFrame) -> DataFrame:
    """Edges that connect exactly what lies within 3 bits in ``dense``, linear in its rows.

    Two fingerprints differ by at most 3 bits if and only if one within 1 bit of the first is within 2 bits of
    the second. All that lie within 1 bit of such a hub are linked, and so is each of them to all within 2.
    """
    bit = lambda i: F.expr(f"shiftleft(1L, {i})")
    near = (dense.select("fp", F.explode(F.array(F.lit(0).cast("long"), *[bit(i) for i in range(BITS)])).alias("m"))
            .select("fp", F.col("fp").bitwiseXOR(F.col("m")).alias("hub")))
    rep = near.groupBy("hub").agg(F.min("fp").alias("rep"))
    far = (dense.select("fp", F.explode(F.sequence(F.lit(0), F.lit(BITS - 2))).alias("i"))
           .select("fp", "i", F.explode(F.sequence(F.col("i") + 1, F.lit(BITS - 1))).alias("j"))
           .select("fp", F.expr("fp ^ shiftleft(1L, i) ^ shiftleft(1L, j)").alias("hub")))
    return (near.unionByName(far).join(rep, "hub").where("fp <> rep")
            .select(F.col("fp").alias("a"), F.col("rep").alias("b")).distinct())


def linked(prints: DataFrame, distance: int = 3, segments: int = 8, most: int = 256) -> DataFrame:
    """Edges (a, b) between distinct fingerprints ``prints(fp)`` whose components are those of all links.

    Keys with up to ``most`` fingerprints are joined; each pair passes the chain's budgets segment by segment,
    the last of which is the full distance. Fingerprints of fuller keys (many near copies of one text) are
    linked with each other through hubs instead, so that no key emits all its pairs and no link is lost.
    """
    if distance != 3:
        raise ValueError("the hubs are those of distance 3")
    width, budget = BITS // segments, chain_budgets(segments, distance)
    entries = ring_entries(prints, segments, distance)
    counts = entries.groupBy("key").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    shared = stored(entries.join(counts, "key"))
    cold = shared.where(F.col("n") <= most)
    x = F.col("l.ring").bitwiseXOR(F.col("r.ring"))
    viable = F.lit(True)
    for n, b in enumerate(budget, 1):
        viable = viable & (F.bit_count(F.shiftrightunsigned(x, BITS - n * width) if n < segments else x) <= b)
    pairs = (cold.alias("l").join(cold.alias("r"), (F.col("l.key") == F.col("r.key"))
                                  & (F.col("l.ring") < F.col("r.ring")) & viable)
             .select(F.col("l.fp").alias("a"), F.col("r.fp").alias("b")).distinct())
    dense = stored(shared.where(F.col("n") > most).select("fp").distinct())
    return pairs.unionByName(_hub_edges(dense))


def simhash_components(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 3) -> DataFrame:
    """(doc_id, fingerprint hex, component_id) of every row of ``docs``.

    Equal fingerprints are one node with its smallest id, links are at most 3 differing bits, and component_id is
    the smallest id reachable. Null and empty texts have fingerprint zero and are linked like any other; rows
    repeated with one id keep a row each; a null id never becomes a component_id unless all ids are null. An
    empty table gives an empty result.
    """
    prints = stored(fingerprints(docs, id_col, text_col, width))
    nodes = prints.groupBy(F.col("fingerprint").alias("fp")).agg(F.min("doc_id").alias("least"))
    roots = connected_components(linked(nodes.select("fp")))
    rooted = stored(nodes.join(roots, nodes.fp == roots.node, "left")
                    .select("fp", "least", F.coalesce("root", "fp").alias("root")))
    ids = rooted.groupBy("root").agg(F.min("least").alias("component_id"))
    classes = rooted.join(ids, "root").select(F.col("fp").alias("fingerprint"), "component_id")
    return prints.join(classes, "fingerprint").select(
        "doc_id", F.lpad(F.lower(F.hex("fingerprint")), 16, "0").alias("fingerprint"), "component_id")
