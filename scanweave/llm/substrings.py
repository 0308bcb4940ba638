"""Exact substring dedup over all documents with suffix arrays of shared contexts.

Every string of ``LENGTH`` bytes has an anchor: the gram of ``GRAM`` bytes with the least hash in it. So two equal
strings have the same anchor at the same place. Documents give the anchors of all their windows; those that
occur in two documents are looked at further, with their context: the bytes of all windows around the anchor.
Equal contexts (96 bits of hashes agree) settle each other at once. Contexts that share an anchor but differ are suffix-sorted together,
and neighbours with ``LENGTH`` bytes in common are equal strings. What tasks send each other are compressed
columns, one row for a batch and a target part.
"""

from __future__ import annotations

import hashlib

import numpy as np
from pyspark.sql import DataFrame, functions as F

from scanweave.llm.base import parts_for, released, ship, stored, text_bytes
from scanweave.llm.suffixes import shared_prefix, suffix_order

LENGTH, GRAM = 50, 24
WINDOWS = LENGTH - GRAM + 1     # windows that an anchor can be in, and grams that a window has
SIDE = LENGTH - GRAM            # bytes of context on either side
_ODD = np.uint64(0x9E3779B97F4A7C15)
_STEP = 1 << 18


def _mixed(x: np.ndarray) -> np.ndarray:
    x = x ^ (x >> np.uint64(31))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(29)
    return x * np.uint64(0x94D049BB133111EB)


_SIGNS = _mixed(np.arange(1, 257, dtype=np.uint64) * _ODD)


def _power(n: int) -> np.uint64:
    return np.uint64(pow(int(_ODD), n, 1 << 64))


def gram_hashes(raw: np.ndarray) -> np.ndarray:
    """A hash of the gram of 24 bytes at each place."""
    h1 = _SIGNS[raw]
    h2 = h1[:-1] * _power(1) + h1[1:]
    h4 = h2[:-2] * _power(2) + h2[2:]
    h8 = h4[:-4] * _power(4) + h4[4:]
    h16 = h8[:-8] * _power(8) + h8[8:]
    return _mixed(h16[:-8] * _power(8) + h8[16:])


def context_hashes(raw: np.ndarray, off: np.ndarray, place: np.ndarray) -> np.ndarray:
    """48 bits of a hash of the context of the anchor at each place: the bytes up to ``SIDE`` before its start and
    up to ``LENGTH`` after it, as far as its text goes. Whole contexts of 76 bytes are hashed eight bytes at a time,
    those cut by a text's end one by one."""
    import xxhash
    row = np.searchsorted(off, place, "right") - 1
    lo, hi = np.maximum(off[row], place - SIDE), np.minimum(off[row + 1], place + LENGTH)
    out = np.empty(len(place), np.uint64)
    full = np.flatnonzero(hi - lo == SIDE + LENGTH)
    if len(full):
        windows = np.lib.stride_tricks.sliding_window_view(raw, SIDE + LENGTH)
        for a in range(0, len(full), 1 << 14):
            at = full[a:a + (1 << 14)]
            out[at] = _double_hash(windows[lo[at]], np.full(len(at), SIDE))[0]
    whole = raw.tobytes() if len(full) < len(place) else b""
    for i in np.flatnonzero(hi - lo != SIDE + LENGTH).tolist():
        out[i] = xxhash.xxh64_intdigest(whole[lo[i]:hi[i]], int(place[i] - lo[i]))
    return out & np.uint64((1 << 48) - 1)


def _sliding(x: np.ndarray, n: int, f) -> np.ndarray:
    """f over each n (at least 16, less than 32) neighbours."""
    for d in (1, 2, 4, 8):
        x = f(x[:-d], x[d:])
    return f(x[:len(x) - (n - 16)], x[n - 16:])


def anchors(raw: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(place in ``raw``, hash) of the anchors of all windows that lie inside one text; in steps of bounded size."""
    places, hashes = [], []
    total = int(off[-1])
    for a in range(0, total, _STEP):
        part = raw[a:min(total, a + _STEP + LENGTH - 1)]
        if len(part) < LENGTH:
            continue
        g = gram_hashes(part)
        least = _sliding(g, WINDOWS, np.minimum)       # of the window that starts at each place
        cuts = off[np.searchsorted(off, a, "right"):np.searchsorted(off, a + len(part), "left")] - a
        cross = np.zeros(len(least) + 1, np.int32)     # windows that a text's end cuts
        np.add.at(cross, np.clip(cuts - LENGTH + 1, 0, len(least)), 1)
        np.add.at(cross, np.clip(cuts, 0, len(least)), -1)
        least[np.cumsum(cross[:-1]) > 0] = 0
        most = _sliding(np.concatenate([np.zeros(WINDOWS - 1, np.uint64), least, np.zeros(WINDOWS - 1, np.uint64)]), WINDOWS, np.maximum)
        at = np.flatnonzero((g == most) & (g != 0))
        places.append(at + a), hashes.append(g[at])
    if not places:
        return np.zeros(0, np.int64), np.zeros(0, np.uint64)
    p, h = np.concatenate(places), np.concatenate(hashes)
    p, first = np.unique(p, return_index=True)
    return p, h[first]


# ---- columns in a row ----------------------------------------------------------------------------------------

def packed(*columns: np.ndarray) -> bytes:
    import zstandard
    head = np.array([len(columns), *[len(c) for c in columns]], "<i8").tobytes()
    kinds = "".join(f"{c.dtype.str:>4}" for c in columns).encode()
    turned = [np.ascontiguousarray(c).view(np.uint8).reshape(len(c), c.dtype.itemsize).T.tobytes() for c in columns]  # byte planes
    return zstandard.ZstdCompressor(level=1).compress(head + kinds + b"".join(turned))


def unpacked(blob: bytes) -> list[np.ndarray]:
    import zstandard
    data = zstandard.ZstdDecompressor().decompress(blob)
    n = int(np.frombuffer(data, "<i8", 1)[0])
    sizes = np.frombuffer(data, "<i8", n, 8).tolist()
    at, out = 8 + 8 * n, []
    kinds = [np.dtype(data[at + 4 * i:at + 4 * i + 4].decode().strip()) for i in range(n)]
    at += 4 * n
    for kind, size in zip(kinds, sizes):
        plane = np.frombuffer(data, np.uint8, size * kind.itemsize, at).reshape(kind.itemsize, size)
        out.append(np.ascontiguousarray(plane.T).view(kind).reshape(-1))
        at += size * kind.itemsize
    return out


def _by_part(part: np.ndarray, *columns: np.ndarray, order_by: np.ndarray | None = None):
    """(part, columns of that part) for each part that occurs."""
    o = np.argsort(part, kind="stable") if order_by is None else np.lexsort((order_by, part))
    p = part[o]
    cuts = np.flatnonzero(np.concatenate([[True], p[1:] != p[:-1], [True]])) if len(p) else np.zeros(1, int)
    for a, z in zip(cuts[:-1].tolist(), cuts[1:].tolist()):
        yield int(p[a]), [c[o[a:z]] for c in columns]


def _rows(pairs, kind: int):
    import pyarrow as pa
    pairs = list(pairs)
    return pa.RecordBatch.from_arrays(
        [pa.array([p for p, _ in pairs], pa.int32()), pa.array([kind] * len(pairs), pa.int32()), pa.array([b for _, b in pairs], pa.large_binary())],
        names=["part", "kind", "data"])


_ROW = "part int, kind int, data binary"
_ANCHORS, _FLAGS, _TEXTS, _WINDOWS_KIND, _SPANS = 0, 1, 2, 3, 4


def _doc_part(doc: np.ndarray, tag: np.ndarray, parts: int) -> np.ndarray:
    """The part of each text, by id and tag: texts of one repeated id, or of none, go to many parts."""
    key = doc.astype(np.uint64) * _ODD ^ tag.astype(np.uint64) * _WEIGHTS[62]
    return (_mixed(key + np.uint64(7)) % np.uint64(parts)).astype(np.int32)


def _runs(key: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Start of each run of equal neighbours, and each row's run."""
    first = np.concatenate([[True], key[1:] != key[:-1]]) if len(key) else np.zeros(0, bool)
    return np.flatnonzero(first), np.cumsum(first) - 1


def _slices(batch, most: int = 4 << 20):
    """Parts of an Arrow batch with about ``most`` bytes of text each; one long text is a part by itself."""
    _, off = text_bytes(batch.column(2))
    at = 0
    while at < batch.num_rows:
        to = max(at + 1, int(np.searchsorted(off, off[at] + most, "right")) - 1)
        yield batch.slice(at, to - at)
        at = to


def _find_anchors(parts: int, local_hot: int):
    """Documents -> anchors by hash part; those that a batch has very often are marked and answered on the spot."""
    def run(batches):
        for whole in batches:
            for b in _slices(whole):
                yield from find(b)

    def find(b):
        raw, off = text_bytes(b.column(2))
        doc, tag = b.column(0).to_numpy(zero_copy_only=False), b.column(1).to_numpy(zero_copy_only=False)
        place, h = anchors(raw, off)
        if not len(place):
            return
        row = np.searchsorted(off, place, "right") - 1
        pos = (place - off[row]).astype(np.int64)
        o = np.argsort(h, kind="stable")
        start, run_ = _runs(h[o])
        often = np.zeros(len(h), bool)
        often[o] = np.diff(np.append(start, len(h)))[run_] > local_hot
        del o, run_
        d, t = doc[row].astype(np.int64), tag[row].astype(np.uint32)
        marks = np.unique(h[often])
        k, n = ~often, len(marks)
        c = np.concatenate([context_hashes(raw, off, place[k]), np.zeros(n, np.uint64)])
        hashes = np.concatenate([h[k], marks])
        part = ((hashes >> np.uint64(40)) % np.uint64(parts)).astype(np.int32)
        yield _rows(((p, packed(*x)) for p, x in _by_part(
            part, (hashes & np.uint64(0xFFFFFFFF)).astype("<u4"), ((hashes >> np.uint64(32)) & np.uint64(0xFFFF)).astype("<u2"),
            np.concatenate([d[k], np.zeros(n, np.int64)]), np.concatenate([t[k], np.zeros(n, np.uint32)]),
            np.concatenate([pos[k], np.full(n, -1, np.int64)]),
            (c & np.uint64(0xFFFFFFFF)).astype("<u4"), (c >> np.uint64(32)).astype("<u2"))), _ANCHORS)
        if n:  # any part can pass these on
            yield _rows([(int(part[0]), packed(d[often], t[often], pos[often], np.ones(int(often.sum()), np.uint8)))], _FLAGS)

    return run


def _shared_anchors(doc_parts: int, group_hot: int):
    """Anchors of one hash part -> (doc, tag, place, hot) of those in two documents or more, by document part."""
    def run(batches):
        got: dict[int, list] = {}
        for b in batches:
            for part, kind, data in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(2)):
                columns = unpacked(data.as_py())
                if kind == _FLAGS:
                    yield _rows(((p, packed(*c)) for p, c in _by_part(_doc_part(columns[0], columns[1], doc_parts), *columns)), _FLAGS)
                else:
                    got.setdefault(part, []).append(columns)
        for columns in got.values():
            lo, hi, d, t, pos, c_lo, c_hi = (np.concatenate(c) for c in zip(*columns))
            h = lo.astype(np.uint64) | (hi.astype(np.uint64) << np.uint64(32))
            c = c_lo.astype(np.uint64) | (c_hi.astype(np.uint64) << np.uint64(32))
            o = np.lexsort((d, c, h))
            h, c, d, t, pos = h[o], c[o], d[o], t[o], pos[o]
            real = pos >= 0
            start, run_ = _runs(h)
            big = np.iinfo(np.int64).max
            least = np.minimum.reduceat(np.where(real, d, big), start)
            most = np.maximum.reduceat(np.where(real, d, -big), start)
            hot = np.logical_or.reduceat(~real, start) | (np.diff(np.append(start, len(h))) > group_hot)
            # of equal contexts all but those of the least document are repeats; if contexts differ, one of each goes on
            first = np.concatenate([[True], (h[1:] != h[:-1]) | (c[1:] != c[:-1])])
            again = d > d[first][np.cumsum(first) - 1]
            differ = np.add.reduceat(first.astype(np.int64), start) > 1
            known = real & ~hot[run_] & again
            if known.any():
                found = _merged(d[known], t[known], np.maximum(0, pos[known] - SIDE), pos[known] + LENGTH)  # the text's end cuts it later
                yield _rows(((p, packed(*x)) for p, x in _by_part(_doc_part(found[0], found[1], doc_parts), *found)), _SPANS)
            keep = real & (hot | (differ & (most > least)))[run_] & ~known
            if keep.any():
                x = d[keep], t[keep], pos[keep], hot[run_][keep].astype(np.uint8)
                yield _rows(((p, packed(*y)) for p, y in _by_part(_doc_part(x[0], x[1], doc_parts), *x, order_by=x[0])), _FLAGS)
    return run


def _send_texts(doc_parts: int):
    """Whole rows by document part, as compressed Arrow batches."""
    def run(batches):
        import pyarrow as pa
        import zstandard
        for b in batches:
            doc = b.column(0).fill_null(0).to_numpy(zero_copy_only=False)  # ids stay whole numbers beside a null
            tag, out = b.column(1).to_numpy(zero_copy_only=False), []
            for p, (row,) in _by_part(_doc_part(doc, tag, doc_parts), np.arange(len(doc))):
                for at in range(0, len(row), 2048):
                    sink = pa.BufferOutputStream()
                    one = b.take(pa.array(row[at:at + 2048]))
                    with pa.ipc.new_stream(sink, one.schema) as w:
                        w.write_batch(one)
                    out.append((p, zstandard.ZstdCompressor(level=1).compress(sink.getvalue().to_pybytes())))
            yield _rows(out, _TEXTS)
    return run


def _gathered(batches):
    """(text batches, columns of the other rows) of each document part of a task."""
    import pyarrow as pa
    import zstandard
    held: dict[int, tuple[list, list]] = {}
    for b in batches:
        for part, kind, data in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(2)):
            held.setdefault(part, ([], []))[kind != _TEXTS].append(data.as_py())
    for blobs, others in held.values():
        columns = [np.concatenate(c) for c in zip(*map(unpacked, others))] if others else None
        yield ((pa.ipc.open_stream(zstandard.ZstdDecompressor().decompress(x)).read_next_batch() for x in blobs), columns)


def _lookup(columns):
    """Rows of the columns by (doc, tag)."""
    if columns is None:
        return {}, None
    o = np.lexsort((columns[2], columns[1], columns[0]))
    columns = [c[o] for c in columns]
    start = np.flatnonzero(np.concatenate([[True], (columns[0][1:] != columns[0][:-1]) | (columns[1][1:] != columns[1][:-1])]))
    ends = np.append(start[1:], len(columns[0]))
    return {(int(d), int(t)): (a, z) for d, t, a, z in zip(columns[0][start], columns[1][start], start.tolist(), ends.tolist())}, columns


_WEIGHTS = _mixed(np.arange(1, 65, dtype=np.uint64) * _ODD) | np.uint64(1)


def _double_hash(rows: np.ndarray, extra: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Two independent 64-bit hashes of equally long byte rows and a number."""
    width = -(-rows.shape[1] // 8) * 8
    w = np.zeros((len(rows), width), np.uint8)
    w[:, :rows.shape[1]] = rows
    w = w.view("<u8")
    a = extra.astype(np.uint64) * _WEIGHTS[60]
    b = extra.astype(np.uint64) * _WEIGHTS[61]
    for k in range(w.shape[1]):
        a = _mixed(a ^ (w[:, k] * _WEIGHTS[k]))
        b = (b + _mixed(w[:, k] ^ _WEIGHTS[20 + k])) * _WEIGHTS[40]
    return a, _mixed(b)


def _settle(h1: np.ndarray, h2: np.ndarray, doc: np.ndarray):
    """For strings of equal hashes: (of each row) the class, whether its document is the least of the class."""
    o = np.lexsort((doc, h2, h1))
    first = np.concatenate([[True], (h1[o][1:] != h1[o][:-1]) | (h2[o][1:] != h2[o][:-1])]) if len(o) else np.zeros(0, bool)
    cls = np.empty(len(o), np.int64)
    cls[o] = np.cumsum(first) - 1
    least = doc[o][first]
    return cls, doc == least[cls]


def _contexts(parts: int):
    """Document parts -> contexts of shared anchors, and windows of very frequent ones, by part; spans settled here.

    Of equal contexts in this part only those of the least document go on: the others are surely repeats.
    """
    def send(batch_rows, spans, windows):
        raws, lefts, rights, docs, tags, places, hots = batch_rows
        m = np.frombuffer(b"".join(raws), np.uint8)
        base = np.concatenate([[0], np.cumsum([len(r) for r in raws])])
        at = np.concatenate([p + b for p, b in zip(places, base)])
        left, right, doc, tag, pos, hot = (np.concatenate(x) for x in (lefts, rights, docs, tags, places, hots))
        pad = np.concatenate([np.zeros(SIDE, np.uint8), m, np.zeros(LENGTH, np.uint8)])
        for cut in range(0, len(at), 1 << 14):
            s = slice(cut, cut + (1 << 14))
            ctx = np.lib.stride_tricks.sliding_window_view(pad, SIDE + LENGTH)[at[s]]
            span = np.arange(SIDE + LENGTH)
            ctx = np.where((span >= SIDE - left[s][:, None]) & (span < SIDE + right[s][:, None]), ctx, 0).astype(np.uint8)
            warm = np.flatnonzero(hot[s] == 0)
            yield from _send_contexts(ctx[warm], left[s][warm], right[s][warm], doc[s][warm], tag[s][warm], pos[s][warm], spans)
            h = np.flatnonzero(hot[s])
            if len(h):
                _add_windows(ctx[h], left[s][h], right[s][h], doc[s][h], tag[s][h], pos[s][h], spans, windows)

    def _send_contexts(ctx, left, right, doc, tag, pos, spans):
        if not len(ctx):
            return
        _, first = _settle(*_double_hash(ctx, left * 256 + right), doc)
        again = ~first
        spans.append((doc[again], tag[again], (pos - left)[again], (pos + right)[again]))
        k = np.flatnonzero(first)
        part = (_mixed(_double_hash(ctx[k, SIDE:SIDE + GRAM], np.zeros(len(k)))[0]) % np.uint64(parts)).astype(np.int32)
        yield _rows(((p, packed(d, t, x, le.astype(np.uint8), ri.astype(np.uint8), c)) for p, (d, t, x, le, ri, c) in (
            (p, (doc[i], tag[i], pos[i], left[i], right[i], ctx[i].T.ravel())) for p, (i,) in _by_part(part, k))), _TEXTS)

    def _add_windows(ctx, left, right, doc, tag, pos, spans, windows):
        for shift in range(WINDOWS):
            k = np.flatnonzero((left >= SIDE - shift) & (right >= shift + LENGTH - SIDE))
            if len(k):
                windows.append((*_double_hash(ctx[k, shift:shift + LENGTH], np.zeros(len(k))), doc[k], tag[k], pos[k] - SIDE + shift))
        if sum(len(w[0]) for w in windows) > 1 << 18:
            _settle_windows(windows, spans)

    def _settle_windows(windows, spans):
        """Of equal windows in this part only those of the least document stay."""
        h1, h2, d, t, start = (np.concatenate(c) for c in zip(*windows))
        _, first = _settle(h1, h2, d)
        spans.append((d[~first], t[~first], start[~first], start[~first] + LENGTH))
        windows[:] = [(h1[first], h2[first], d[first], t[first], start[first])]

    def run(batches):
        for texts, columns in _gathered(batches):
            at, columns = _lookup(columns)
            if not at:
                continue
            spans, windows, rows, held = _Spans(), [], [[] for _ in range(7)], 0
            for b in texts:
                raw, off = text_bytes(b.column(2))
                for i, (d, t) in enumerate(zip(b.column(0).to_pylist(), b.column(1).to_pylist())):
                    if (d, t) not in at:
                        continue
                    a, z = at[d, t]
                    one = raw[off[i]:off[i + 1]]
                    pos, first = np.unique(columns[2][a:z], return_index=True)
                    hot = np.zeros(len(pos), np.uint8)
                    np.maximum.at(hot, np.searchsorted(pos, columns[2][a:z]), columns[3][a:z])
                    n = len(pos)
                    for c, x in zip(rows, (one.tobytes(), np.minimum(SIDE, pos), np.minimum(LENGTH, len(one) - pos), np.full(n, d, np.int64), np.full(n, t, np.uint32), pos, hot)):
                        c.append(x)
                    held += len(one)
                if held > 1 << 22:
                    yield from send(rows, spans, windows)
                    rows, held = [[] for _ in range(7)], 0
            if rows[0]:
                yield from send(rows, spans, windows)
            if windows:
                _settle_windows(windows, spans)
                h1 = windows[0][0]
                yield _rows(((p, packed(*c)) for p, c in _by_part((h1 % np.uint64(parts)).astype(np.int32), *windows[0])), _WINDOWS_KIND)
            if spans.rows:
                yield _rows([(-1, packed(*spans.merged()))], _SPANS)
    return run


class _Spans:
    """Spans of documents, merged whenever many have come together."""

    def __init__(self, most: int = 1 << 18):
        self.parts, self.rows, self.most = [], 0, most

    def append(self, columns) -> None:
        if len(columns[0]):
            self.parts.append(columns)
            self.rows += len(columns[0])
            if self.rows > self.most:
                self.parts = [self.merged()]
                self.rows = len(self.parts[0][0])
                self.most = max(self.most, 2 * self.rows)

    def merged(self):
        return _merged(*(np.concatenate(c) for c in zip(*self.parts)))


def _merged(doc, tag, start, end):
    """The union of spans of each document, in maximal pieces."""
    o = np.lexsort((start, tag, doc))
    doc, tag, start, end = doc[o], tag[o], start[o], end[o]
    if not len(doc):
        return doc, tag, start, end
    other = np.concatenate([[True], (doc[1:] != doc[:-1]) | (tag[1:] != tag[:-1])])
    # ends made increasing over all documents by an offset, so that one running maximum serves
    group = np.cumsum(other) - 1
    lift = group * (int(end.max()) + 1)
    reach = np.maximum.accumulate(end + lift)
    new = np.concatenate([[True], (start + lift)[1:] > reach[:-1]]) | other
    first = np.flatnonzero(new)
    last = np.append(first[1:], len(doc)) - 1
    return doc[first], tag[first], start[first], (reach - lift)[last]


def _resolve(doc_parts: int, chunk: int = 1 << 20):
    """Contexts and windows of one part -> spans that also start in a smaller document, by document part."""
    def mixed(ctx, left, right, doc, tag, pos):
        """Suffix-sort contexts of one or more anchors and compare neighbours."""
        n, width = ctx.shape
        t = np.zeros((n, width + 1), np.uint8)
        t[:, :width] = ctx + 1
        span = np.arange(width)
        inside = (span >= SIDE - left[:, None]) & (span < SIDE + right[:, None])
        t[:, :width][~inside] = 0
        flat = t.ravel()
        begins = np.zeros((n, width + 1), bool)  # where a whole window starts
        begins[:, :WINDOWS] = (np.arange(WINDOWS) >= SIDE - left[:, None]) & (np.arange(WINDOWS) + LENGTH <= SIDE + right[:, None])
        order = suffix_order(flat, LENGTH)
        order = order[begins.ravel()[order]]
        if not len(order):
            return
        same = shared_prefix(flat, order, LENGTH)
        row, at = order // (width + 1), order % (width + 1)
        start, run_ = np.flatnonzero(~same), np.cumsum(~same) - 1
        again = doc[row] > np.minimum.reduceat(doc[row], start)[run_]
        row, at = row[again], at[again]
        s = pos[row] - SIDE + at
        yield _merged(doc[row], tag[row], s, s + LENGTH)

    def run(batches):
        contexts, windows, spans = [], [], _Spans()
        for b in batches:
            for kind, data in zip(b.column(1).to_pylist(), b.column(2)):
                c = unpacked(data.as_py())
                if kind == _SPANS:
                    spans.append(c)
                elif kind == _WINDOWS_KIND:
                    windows.append(c)
                else:
                    contexts.append([*c[:5], np.ascontiguousarray(c[5].reshape(SIDE + LENGTH, -1).T)])
        if windows:
            h1, h2, d, t, s = (np.concatenate(c) for c in zip(*windows))
            _, first = _settle(h1, h2, d)
            spans.append((d[~first], t[~first], s[~first], s[~first] + LENGTH))
        if contexts:
            d, t, pos, left, right, ctx = (np.concatenate(c) for c in zip(*contexts))
            del contexts
            left, right = left.astype(np.int64), right.astype(np.int64)
            cls, first = _settle(*_double_hash(ctx, left * 256 + right), d)
            spans.append((d[~first], t[~first], (pos - left)[~first], (pos + right)[~first]))
            k = np.flatnonzero(first)
            anchor = _double_hash(ctx[k, SIDE:SIDE + GRAM], np.zeros(len(k)))[0]
            o = np.argsort(anchor, kind="stable")
            k, anchor = k[o], anchor[o]
            start, run_ = _runs(anchor)
            differ = (np.maximum.reduceat(cls[k], start) > np.minimum.reduceat(cls[k], start)) \
                & (np.maximum.reduceat(d[k], start) > np.minimum.reduceat(d[k], start)) if len(k) else np.zeros(0, bool)
            keep = differ[run_]
            k, anchor = k[keep], anchor[keep]
            at = 0
            while at < len(k):  # whole anchors, in chunks of bounded size
                to = min(len(k), at + chunk // (SIDE + LENGTH))
                while to < len(k) and anchor[to] == anchor[to - 1]:
                    to += 1
                i = k[at:to]
                for found in mixed(ctx[i], left[i], right[i], d[i], t[i], pos[i]):
                    spans.append(found)
                at = to
        if spans.rows:
            found = spans.merged()
            yield _rows(((p, packed(*c)) for p, c in _by_part(_doc_part(found[0], found[1], doc_parts), *found)), _SPANS)
    return run


def _cut(n_columns: int, names: list[str]):
    """Texts and spans of a document part -> rows with what is left of each text."""
    def run(batches):
        import pyarrow as pa
        for texts, columns in _gathered(batches):
            at, columns = _lookup(columns)
            for b in texts:
                raw, off = text_bytes(b.column(2))
                n_bytes, removed, spans, digest, kept = [], [], [], [], []
                for i, (d, t) in enumerate(zip(b.column(0).to_pylist(), b.column(1).to_pylist())):
                    one, gone, count = raw[off[i]:off[i + 1]].tobytes(), 0, 0
                    left = one
                    if (d, t) in at:
                        a, z = at[d, t]
                        _, _, s, e = _merged(*(c[a:z] for c in columns))
                        e = np.minimum(e, len(one))
                        count, gone = len(s), int((e - s).sum())
                        edges = [0, *np.stack([s, e], axis=1).ravel().tolist(), len(one)]
                        left = b"".join(one[x:y] for x, y in zip(edges[::2], edges[1::2]))
                    n_bytes.append(len(one)), removed.append(gone), spans.append(count)
                    digest.append(hashlib.sha256(left).hexdigest()), kept.append(left)
                yield pa.RecordBatch.from_arrays(
                    [*b.columns[3:3 + n_columns], pa.array(n_bytes, pa.int64()), pa.array(removed, pa.int64()), pa.array(spans, pa.int64()),
                     pa.array(digest, pa.string()), pa.array(kept, pa.binary())], names=names)
    return run


def remove_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", keep: list[str] | None = None,
                   part_bytes: int = 8 << 20, local_hot: int = 256, group_hot: int = 20_000) -> DataFrame:
    """Columns ``keep`` of every row, with n_bytes, n_removed, n_spans, kept_sha256 and kept (binary).

    Removed is each byte covered by a string of 50 bytes that also starts in a document with a smaller id, judged
    on the input. Texts are bytes of UTF-8; null is empty; matches never cross documents. Rows that repeat an id
    don't remove from each other; a null id neither removes nor is removed from. An empty table gives an empty result.
    Columns of ``docs`` may have any names.

    Work: anchors are about one byte in fourteen, each sent once; texts are sent twice. Parts hold about
    ``part_bytes`` of text. An anchor that a batch holds more than ``local_hot`` times, or that has more than
    ``group_hot`` places in all, is matched by its windows instead of by contexts. Windows of one batch add up
    before they are sent, so that no group grows with the corpus.
    """
    spark = docs.sparkSession
    ship(spark)
    kept = [id_col] if keep is None else keep
    key = F.col(f"`{id_col}`").cast("long")
    text = F.coalesce(F.col(f"`{text_col}`").cast("string"), F.lit(""))
    base = docs.select(key.alias("__doc"), F.crc32(text).cast("long").alias("__tag"), text.alias("__text"),
                       *[F.col(f"`{c}`").alias(f"__{i}") for i, c in enumerate(kept)])
    total = base.agg(F.coalesce(F.sum(F.octet_length("__text")), F.lit(0))).first()[0]
    parts = parts_for(total, part_bytes)
    some = base.select("__doc", "__tag", "__text").where("__doc is not null")
    shared = stored(some.mapInArrow(_find_anchors(parts, local_hot), _ROW).repartition(parts, "part").mapInArrow(_shared_anchors(parts, group_hot), _ROW))
    flags, sure = shared.where(F.col("kind") == _FLAGS), shared.where(F.col("kind") == _SPANS)
    released(spark)
    sent = some.mapInArrow(_send_texts(parts), _ROW)
    contexts = sent.unionByName(flags).repartition(parts, "part").mapInArrow(_contexts(parts), _ROW)
    contexts = contexts.withColumn("part", F.when(F.col("part") >= 0, F.col("part")).otherwise(
        F.pmod(F.xxhash64("data"), F.lit(parts)).cast("int")))
    spans = stored(contexts.repartition(parts, "part").mapInArrow(_resolve(parts), _ROW))
    released(spark)
    extra = ["n_bytes", "n_removed", "n_spans", "kept_sha256", "kept"]
    all_rows = base.mapInArrow(_send_texts(parts), _ROW)
    schema = base.select(*[f"__{i}" for i in range(len(kept))]).schema
    for name, kind in zip(extra, ("long", "long", "long", "string", "binary")):
        schema = schema.add(f"+{name}", kind)
    out = all_rows.unionByName(spans).unionByName(sure).repartition(parts, "part").mapInArrow(_cut(len(kept), schema.names), schema)
    return out.select(*[F.col(f"`__{i}`").alias(c) for i, c in enumerate(kept)], *[F.col(f"`+{n}`").alias(n) for n in extra])


OP9_SQL = """
WITH d AS (SELECT doc_id, hex(encode(coalesce(text, ''))) AS h, octet_length(encode(coalesce(text, ''))) AS n FROM documents),
w AS (SELECT doc_id, k, substr(h, CAST(2 * k + 1 AS BIGINT), 100) AS s FROM d, unnest(range(0, greatest(n - 49, 0))) AS u(k)),
least AS (SELECT s, min(doc_id) AS m FROM w GROUP BY s HAVING min(doc_id) < max(doc_id)),
hit AS (SELECT doc_id, k FROM w JOIN least USING (s) WHERE m < doc_id),
edge AS (SELECT doc_id, k, CASE WHEN k <= lag(k) OVER (PARTITION BY doc_id ORDER BY k) + 50 THEN 0 ELSE 1 END AS new
         FROM (SELECT DISTINCT doc_id, k FROM hit)),
span AS (SELECT doc_id, min(k) AS a, max(k) + 50 AS z FROM (SELECT doc_id, k, sum(new) OVER (PARTITION BY doc_id ORDER BY k) AS g FROM edge) GROUP BY doc_id, g),
gap AS (SELECT doc_id, z AS a, lead(a) OVER (PARTITION BY doc_id ORDER BY a) AS z FROM span
        UNION ALL SELECT doc_id, 0, min(a) FROM span GROUP BY doc_id),
kept AS (SELECT g.doc_id, string_agg(substr(h, CAST(2 * g.a + 1 AS BIGINT), CAST(2 * (coalesce(g.z, d.n) - g.a) AS BIGINT)), '' ORDER BY g.a) AS h FROM gap g JOIN d USING (doc_id) GROUP BY g.doc_id),
total AS (SELECT doc_id, sum(z - a) AS removed, count(*) AS spans FROM span GROUP BY doc_id)
SELECT d.doc_id, CAST(d.n AS BIGINT) AS n_bytes, CAST(coalesce(t.removed, 0) AS BIGINT) AS n_removed, CAST(coalesce(t.spans, 0) AS BIGINT) AS n_spans,
    sha256(unhex(coalesce(k.h, CASE WHEN t.doc_id IS NULL THEN d.h ELSE '' END))) AS kept_sha256
FROM d LEFT JOIN total t USING (doc_id) LEFT JOIN kept k USING (doc_id)
"""
