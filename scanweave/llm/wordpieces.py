"""Token counts by a linear longest-match automaton: greedy word pieces without building the pieces."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, functions as F

from scanweave.llm.base import ship, texts

_AUTOMATA: dict = {}
START = "▁"  # stands before the pieces that begin a word


class Automaton:
    """A trie of the vocabulary with failure links, and for each link how many tokens it pops.

    Node 0 is the root of pieces that begin a word, node 1 that of pieces that go on. At a node without the next
    sign, the longest piece on the path is popped and the rest of the path goes on below node 1: both are
    worked out beforehand, so that every sign of a word is looked at once.

    An empty initial piece is the bare start: a word without a longer one pops it and goes on at node 1. With
    ``by_bytes`` a sign that no piece covers pops as many tokens as it has bytes in UTF-8, so that every word is covered.
    """

    def __init__(self, initial: list[str], further: list[str], by_bytes: bool = False):
        self.by_bytes = by_bytes
        self.next: list[dict[str, int]] = [{}, {}]
        token = [0, 0]  # tokens that a node pops as a whole
        signs = {c for p in (*initial, *further) for c in p} if by_bytes else ()
        for root, weight, pieces in ((0, 1, initial), (1, 1, further), (1, None, signs)):
            for piece in pieces:
                at = root
                for c in piece:
                    to = self.next[at].get(c)
                    if to is None:
                        to = len(self.next)
                        self.next.append({})
                        token.append(0)
                        self.next[at][c] = to
                    at = to
                if at > 1 and not token[at]:
                    token[at] = weight or len(piece.encode())
        self.fail, self.pops = [-1] * len(self.next), [0] * len(self.next)
        if "" in initial or by_bytes:
            self.fail[0], self.pops[0] = 1, 1 if "" in initial else len(START.encode())
        queue = [0, 1]
        for u in queue:  # breadth first
            for c, v in self.next[u].items():
                queue.append(v)
                if token[v]:
                    self.fail[v], self.pops[v] = 1, token[v]
                    continue
                z, popped = self.fail[u], self.pops[u]
                while z >= 0 and c not in self.next[z]:
                    popped += self.pops[z]
                    z = self.fail[z]
                if z >= 0:
                    self.fail[v], self.pops[v] = self.next[z][c], popped

    def count(self, word: str) -> int:
        """Pieces of the word, or 0 if no sequence of longest matches covers it."""
        at, n = 0, 0
        for c in word:
            while True:
                to = self.next[at].get(c)
                if to is not None:
                    at = to
                    break
                if self.fail[at] < 0:
                    if at != 1 or not self.by_bytes:
                        return 0
                    n += len(c.encode())
                    break
                n += self.pops[at]
                at = self.fail[at]
        while at != 1:
            if self.fail[at] < 0:
                return 0
            n += self.pops[at]
            at = self.fail[at]
        return n


class Counts(dict):
    """Remembered counts by word; unknown words are one token, and negative here."""

    def __init__(self, automaton: Automaton, most: int = 500_000, longest: int = 64):
        super().__init__()
        self.automaton, self.most, self.longest = automaton, most, longest

    def __missing__(self, word: bytes) -> int:
        n = self.automaton.count(word.decode("utf-8", "replace")) or -1
        if len(word) <= self.longest:
            if len(self) >= self.most:
                self.clear()
            self[word] = n
        return n


def vocabulary(path: str) -> tuple[list[str], list[str]]:
    """Initial and further pieces of a piece model; control and byte pieces don't count."""
    import sentencepiece
    model = sentencepiece.SentencePieceProcessor(model_file=path)
    pieces = [model.id_to_piece(i) for i in range(model.get_piece_size())
              if not (model.is_control(i) or model.is_unknown(i) or model.is_byte(i))]
    return ([p[1:] for p in pieces if p.startswith(START) and len(p) > 1], [p for p in pieces if not p.startswith(START)])


def all_pieces(path: str) -> tuple[list[str], list[str], bool]:
    """Initial pieces (the bare start is the empty one), further pieces, and whether all 256 bytes are pieces.

    A start sign inside a word is a sign like any other: pieces that begin with it are further pieces too.
    """
    import sentencepiece
    model = sentencepiece.SentencePieceProcessor(model_file=path)
    ids = range(model.get_piece_size())
    pieces = [model.id_to_piece(i) for i in ids if not (model.is_control(i) or model.is_unknown(i) or model.is_byte(i))]
    return [p[1:] for p in pieces if p.startswith(START)], pieces, sum(map(model.is_byte, ids)) == 256


def _counts(path: str, every: bool) -> Counts:
    if (path, every) not in _AUTOMATA:
        _AUTOMATA[path, every] = Counts(Automaton(*(all_pieces if every else vocabulary)(path)))
    return _AUTOMATA[path, every]


def token_counts(docs: DataFrame, vocabulary_path: str, id_col: str = "doc_id", text_col: str = "text",
                 every: bool = False) -> DataFrame:
    """(doc_id, n_words, n_tokens, n_unknown) of every whole text.

    Words are what ASCII white space separates. A word is cut greedily: the longest initial piece, then again and
    again the longest further piece; a word that can't be covered so is one unknown token. With ``every`` the bare
    start and the byte pieces of the file count as well, so that a word without an initial piece begins with the bare
    start and a sign outside the vocabulary is its UTF-8 bytes; with a file that has all of them no word is unknown.
    A text's work is linear in its length. Null and empty texts have no words. Every row keeps its own row, repeated or null ids too;
    an empty table gives an empty result.
    """
    ship(docs.sparkSession)

    def run(batches):
        import pyarrow as pa
        counts = _counts(vocabulary_path, every)
        for b in batches:
            words, tokens, unknown = [], [], []
            for t in texts(b.column(1)):
                ws = t.split()
                n = np.fromiter(map(counts.__getitem__, ws), np.int64, len(ws))
                words.append(len(ws)), tokens.append(int(np.abs(n).sum())), unknown.append(int((n < 0).sum()))
            yield pa.RecordBatch.from_arrays([b.column(0), *(pa.array(x, pa.int64()) for x in (words, tokens, unknown))],
                                             names=["doc_id", "n_words", "n_tokens", "n_unknown"])

    return (docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
            .mapInArrow(run, "doc_id long, n_words long, n_tokens long, n_unknown long"))
