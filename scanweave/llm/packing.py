"""Best-fit packing of tokenised documents into sequences, by hierarchical residual packing."""

from __future__ import annotations

import zlib

import numpy as np
from pyspark.sql import DataFrame, functions as F

from scanweave.llm.base import parts_for, ship, stored, texts

END_ID = 0
_TOKENIZERS: dict = {}


def _byte_letters() -> dict[str, int]:
    """The letter that stands for each byte in the vocabulary file: itself if it is visible, else the next from 256."""
    visible = [*range(33, 127), *range(161, 173), *range(174, 256)]
    hidden = [b for b in range(256) if b not in visible]
    return {**{chr(b): b for b in visible}, **{chr(256 + k): b for k, b in enumerate(hidden)}}


class ChunkTokenizer:
    """Ids of whole texts as little-endian 32-bit bytes, by a byte-level BPE vocabulary file.

    The vocabulary's pattern always breaks before a space that stands between other signs. So a text is cut at
    its spaces and each distinct chunk's ids are remembered (at most ``most`` of them, then anew). New chunks are
    encoded together by the faster of two libraries, from ranks read from the file, and the ids dealt out by
    their lengths. White space before a space may belong to one piece with it, and special tokens cross chunks:
    such texts are encoded whole by the file's own library.
    """

    def __init__(self, path: str, most: int = 700_000, longest: int = 256):
        import json

        import public_tokenizers
        import tiktoken
        from tokenizers import Tokenizer
        with open(path, encoding="utf-8") as f:
            content = json.load(f)
        self.special = [t["content"] for t in content.get("added_tokens", [])]
        letters, vocab = _byte_letters(), content["model"]["vocab"]
        ranks = {bytes(letters[c] for c in token): i for token, i in vocab.items() if token not in self.special}
        self.lengths = np.zeros(max(ranks.values()) + 1, np.int64)
        for token, i in ranks.items():
            self.lengths[i] = len(token)
        self.encoder = Tokenizer.from_file(path)
        self.fast = tiktoken.Encoding("ranks", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
        self.most, self.longest, self.known, self.heads = most, longest, {"": None}, {"": None}

    def forget(self) -> None:
        """Gives back what has been remembered: a worker goes on to other work."""
        self.known, self.heads = {"": None}, {"": None}

    def whole(self, text: str) -> bytes:
        return np.array(self.encoder.encode(text, add_special_tokens=False).ids, "<u4").tobytes()

    def _learn(self, new: list[str]) -> None:
        good = []
        for c in new:
            if c[-1].isspace():
                self.known[c] = None
            else:
                good.append(c)
        if good:
            ids = np.asarray(self.fast.encode_to_numpy(" " + " ".join(good), disallowed_special=()), "<u4")
            ends = np.cumsum([len(c.encode()) + 1 for c in good])
            cut = (4 * (np.searchsorted(np.cumsum(self.lengths[ids]), ends) + 1)).tolist()
            raw = ids.tobytes()
            for c, a, z in zip(good, [0, *cut], cut):
                self.known[c] = raw[a:z]

    def _head(self, chunk: str) -> bytes | None:
        """A text's first chunk, which has no space before it."""
        if chunk not in self.heads:
            if len(self.heads) > 50_000:
                self.heads = {"": None}
            ids = None if chunk[-1].isspace() else np.array(self.fast.encode_ordinary(chunk), "<u4").tobytes()
            if len(chunk) > self.longest:
                return ids
            self.heads[chunk] = ids
        return self.heads[chunk]

    def encode(self, batch: list[str]) -> list[bytes]:
        cut = [t.split(" ") for t in batch]
        new = set()
        for chunks in cut:
            new.update(chunks[1:])
        new = [c for c in new if c not in self.known]
        if len(self.known) + len(new) > self.most:
            self.known = {"": None}
            new = list({c for chunks in cut for c in chunks[1:] if c})
        long = {c for c in new if len(c) > self.longest}
        self._learn(new)
        known, out = self.known, []
        for text, chunks in zip(batch, cut):
            if not text:
                out.append(b"")
                continue
            try:
                if any(s in text for s in self.special):
                    raise TypeError
                out.append(b"".join([self._head(chunks[0]), *map(known.__getitem__, chunks[1:])]))
            except TypeError:  # a special token, or white space before a space
                out.append(self.whole(text))
        for c in long:
            del known[c]
        return out


def _tokenizer(path: str) -> ChunkTokenizer:
    if path not in _TOKENIZERS:
        _TOKENIZERS[path] = ChunkTokenizer(path)
    return _TOKENIZERS[path]


def pieces(docs: DataFrame, vocabulary: str, id_col: str = "doc_id", text_col: str = "text", size: int = 2048) -> DataFrame:
    """(doc_id, piece, start, length, ids_crc32): the token pieces of every whole text.

    A document is its ids and one end id. One of more than ``size`` ids is cut from its end into pieces of
    ``size``, so that only the first may be shorter. A null text is empty and has the end id alone.
    """
    ship(docs.sparkSession)

    def run(batches):
        import pyarrow as pa
        encoder, end = _tokenizer(vocabulary), np.array([END_ID], "<u4").tobytes()
        for b in batches:
            ids, column = b.column(0), texts(b.column(1))
            for at in range(0, len(column), 512):
                row, piece, start, length, crc = [], [], [], [], []
                batch = [t.decode("utf-8", "replace") for t in column[at:at + 512]]
                for k, raw in enumerate(encoder.encode(batch)):
                    raw += end
                    n = len(raw) // 4
                    cuts = [0, *range(n % size or size, n + 1, size)]
                    for j, (a, z) in enumerate(zip(cuts, cuts[1:])):
                        row.append(at + k), piece.append(j), start.append(a), length.append(z - a)
                        crc.append(zlib.crc32(raw[4 * a:4 * z]))
                yield pa.RecordBatch.from_arrays(
                    [ids.take(pa.array(row, pa.int64())), pa.array(piece, pa.int32()), pa.array(start, pa.int64()),
                     pa.array(length, pa.int64()), pa.array(crc, pa.int64())],
                    names=["doc_id", "piece", "start", "length", "ids_crc32"])
        encoder.forget()

    return (docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
            .mapInArrow(run, "doc_id long, piece int, start long, length long, ids_crc32 long"))


def best_fit(sizes: list[int], capacity: int) -> list[list[int]]:
    """Bins of item positions: items from large to small, each into the fullest bin that holds it."""
    free: dict[int, list[list[int]]] = {}
    there, bins = 0, []  # bit r of `there`: some bin has r left
    for i in sorted(range(len(sizes)), key=lambda i: -sizes[i]):
        s = sizes[i]
        fits = there >> s
        if fits:
            left = s + (fits & -fits).bit_length() - 1
            chosen = free[left].pop()
            if not free[left]:
                there &= ~(1 << left)
        else:
            left, chosen = capacity, []
            bins.append(chosen)
        chosen.append(i)
        rest = left - s
        free.setdefault(rest, []).append(chosen)
        there |= 1 << rest
    return bins


_FIELDS = ["doc_id", "piece", "start", "length", "ids_crc32", "offset"]
_MEMBERS = "array<struct<doc_id:long,piece:int,start:long,length:long,ids_crc32:long,offset:long>>"
_BINS = f"part long, bin long, fill long, open boolean, members {_MEMBERS}"


def _open(fills: list[int], left: np.ndarray, carry: int) -> np.ndarray:
    """Which bins could hold the smallest item; of more than ``carry`` only the emptiest."""
    can = np.flatnonzero(left >= min(fills))
    out = np.zeros(len(left), bool)
    out[can[np.argsort(-left[can], kind="stable")[:carry]]] = True
    return out


def _bins_table(part: int, bins: np.ndarray, fill: np.ndarray, opened: np.ndarray, sizes: list[int], fields: list):
    import pyarrow as pa
    members = pa.StructArray.from_arrays(fields, names=_FIELDS)
    return pa.Table.from_arrays(
        [pa.array([part] * len(bins), pa.int64()), pa.array(bins, pa.int64()), pa.array(fill, pa.int64()), pa.array(opened),
         pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(sizes)]), pa.int32()), members)],
        names=["part", "bin", "fill", "open", "members"])


def _pack_level(items: DataFrame, level: int, capacity: int, carry: int, ordered: bool = False) -> DataFrame:
    """Best fit of the items (part, fill, members) of each part; (part, bin, fill, open, members).

    Bins that could hold the part's smallest item stay open and go up a level as items, but no more than the
    ``carry`` emptiest; the others are emitted. ``ordered``: items have a bin already, their place in an order; they
    are packed in that order, and what they make up has the bin of its largest item.
    """
    def run(key, group):
        import pyarrow as pa
        if ordered:
            group = group.sort_by("bin")
        part, fills, members = key[0].as_py(), group.column("fill").to_pylist(), group.column("members").combine_chunks()
        if isinstance(members, pa.ChunkedArray):
            members = members.chunk(0)
        begin, flat = np.asarray(members.offsets), members.values
        bins = best_fit(fills, capacity)
        left = np.array([capacity - sum(fills[i] for i in b) for b in bins])
        take, shift, sizes = [], [], []
        for b in bins:
            at = n = 0
            for i in b:
                m = range(begin[i], begin[i + 1])
                take.extend(m), shift.extend([at] * len(m))
                at, n = at + fills[i], n + len(m)
            sizes.append(n)
        rows = flat.take(pa.array(take, pa.int64()))
        fields = [rows.field(k) for k in range(5)]
        offset = pa.array(np.asarray(rows.field(5)) + np.array(shift, np.int64))
        ids = group.column("bin").to_numpy()[[b[0] for b in bins]] if ordered else np.arange(len(bins)) | (level << 56) | (part << 28)
        return _bins_table(part, ids, capacity - left, _open(fills, left, carry), sizes, [*fields, offset])

    return items.groupBy("part").applyInArrow(run, _BINS)


def _pack_ranges(items: DataFrame, capacity: int, range_items: int, carry: int) -> DataFrame:
    """Best fit of the ranges of each part; (part, bin, fill, open, members). A bin's number is the place of its
    largest piece in the order, and stays open as in ``_pack_level``, by its range's smallest piece."""
    order = ["slot", "place", "doc_id", "piece", "ids_crc32", "length"]

    def run(key, group):
        import pyarrow as pa
        t = group.sort_by([(c, "ascending") for c in order])
        part, length = key[0].as_py(), t.column("length").to_numpy()
        bins, opened = [], []
        for span in np.array_split(np.arange(len(length)), max(1, round(len(length) / range_items))):
            fills = length[span].tolist()
            packed = best_fit(fills, capacity)
            opened.append(_open(fills, np.array([capacity - sum(fills[i] for i in b) for b in packed]), carry))
            bins.extend([int(span[0]) + i for i in b] for b in packed)  # the first of a bin is its largest
        row = np.array([i for b in bins for i in b], np.int64)
        n = np.array([len(b) for b in bins], np.int64)
        first = np.concatenate([[0], np.cumsum(n)[:-1]])
        before = np.cumsum(length[row]) - length[row]
        got = t.select(_FIELDS[:5]).take(pa.array(row)).combine_chunks()
        fields = [got.column(c).combine_chunks() for c in _FIELDS[:5]] + [pa.array(before - np.repeat(before[first], n), pa.int64())]
        fields = [f.chunk(0) if isinstance(f, pa.ChunkedArray) else f for f in fields]
        return _bins_table(part, (part << 32) + row[first], np.add.reduceat(length[row], first), np.concatenate(opened), n, fields)

    return items.groupBy("part").applyInArrow(run, _BINS)


def _up_the_tree(packed: DataFrame, parts: int, level: int, capacity: int, fan_in: int, carry: int, ordered: bool) -> DataFrame:
    """All bins, after open ones of ``fan_in`` neighbouring parts at a time were packed again, up to one part."""
    done = None
    while True:
        last = parts == 1
        closed = packed if last else packed.where(~F.col("open"))
        done = closed if done is None else done.unionByName(closed)
        if last:
            return done
        items = packed.where("open").select(F.floor(F.col("part") / fan_in).alias("part"), "bin", "fill", "members")
        parts, level = -(-parts // fan_in), level + 1
        packed = stored(_pack_level(items, level, capacity, carry, ordered))


def pack_in_order(docs: DataFrame, places: DataFrame, vocabulary: str, id_col: str = "doc_id", text_col: str = "text", size: int = 2048,
                  range_items: int = 1024, part_items: int = 32_768, fan_in: int = 16, carry: int = 2048) -> DataFrame:
    """What ``pack`` returns, but along the order of ``places(doc_id, slot, place_in_block)``.

    The pieces are cut into consecutive ranges of that order of about ``range_items``, whose number grows with the
    data; a task has a part of about ``part_items``. A range is packed best-fit by itself. Its bins that could hold its
    smallest piece stay open: those of a part's ranges, then of ``fan_in`` neighbouring parts at a time, are packed
    again with whole bins as items, up to one part. Best fit leaves no two of a range's bins that fit into one, so
    that few sequences have pieces of several ranges. Sequence ids follow the order: a sequence stands where
    the largest piece of its fullest bin stands. Documents that repeat an id stand at its first place, those without
    an id or place come last. An empty table gives an empty result.
    """
    at = places.where("doc_id is not null").groupBy("doc_id").agg(F.min(F.struct("slot", "place_in_block")).alias("at"))
    last = F.lit((1 << 63) - 1)
    cut = stored(pieces(docs, vocabulary, id_col, text_col, size).join(at, "doc_id", "left").select(
        "doc_id", "piece", "start", "length", "ids_crc32", F.coalesce("at.slot", last).alias("slot"),
        F.coalesce("at.place_in_block", F.lit(0)).alias("place")))
    ranges = cut.repartitionByRange(parts_for(cut.count(), part_items), "slot", "place", "doc_id", "piece", "ids_crc32")
    # stored: sampled bounds must not change when a task is rerun
    ranges = stored(ranges.withColumn("part", F.spark_partition_id().cast("long")))
    parts = (ranges.agg(F.max("part")).first()[0] or 0) + 1
    packed = stored(_pack_ranges(ranges, size, range_items, carry))
    packed = packed.where(~F.col("open")).unionByName(stored(_pack_level(packed.where("open"), 1, size, carry, True)))
    return _members(_up_the_tree(packed, parts, 1, size, fan_in, carry, True))


def _members(bins: DataFrame) -> DataFrame:
    return (bins.select(F.col("bin").alias("sequence_id"), F.explode("members").alias("m"))
            .select("m.doc_id", "m.piece", "m.start", "m.length", "m.ids_crc32", "sequence_id", "m.offset"))


def pack(docs: DataFrame, vocabulary: str, id_col: str = "doc_id", text_col: str = "text", size: int = 2048,
         part_items: int = 50_000, fan_in: int = 16, carry: int = 2048) -> DataFrame:
    """(doc_id, piece, start, length, ids_crc32, sequence_id, offset): all pieces in sequences of at most ``size``.

    Full pieces are sequences of their own. The others are dealt by hash to parts of about ``part_items``, packed
    best-fit there, and what stays open is merged ``fan_in`` parts at a time and packed again with whole bins as
    items, up to one part. A task holds one part: at most about ``part_items`` items, or ``fan_in * carry`` bins.
    Members travel with their bin only while it is open. Each level is stored, so that a lost executor costs one
    level at most. Packings differ with the order of rows, but each is complete and gapless.

    Null text: empty. A null or repeated id is a document like any other (its pieces are told apart by their
    place). An empty table gives an empty result; other columns don't matter.
    """
    spark = docs.sparkSession
    cut = stored(pieces(docs, vocabulary, id_col, text_col, size))
    rest = cut.where(F.col("length") < size)
    parts = parts_for(rest.count(), part_items)
    member = F.array(F.struct("doc_id", "piece", "start", "length", "ids_crc32", F.lit(0).cast("long").alias("offset")))
    items = rest.select(F.pmod(F.xxhash64("doc_id", "piece", "ids_crc32"), F.lit(parts)).alias("part"),
                        F.col("length").alias("fill"), member.alias("members"))
    packed = stored(_pack_level(items, 1, size, carry))
    done = _up_the_tree(packed, parts, 1, size, fan_in, carry, False)
    full = cut.where(F.col("length") == size).select(
        "*", (-1 - F.monotonically_increasing_id()).alias("sequence_id"), F.lit(0).cast("long").alias("offset"))
    return _members(done).unionByName(full)
