"""Token counts by a linear longest-match automaton.

Greedy word-piece segmentation takes the longest piece that begins a word, then the longest continuation piece
that begins the rest, and so on. The pieces form a trie. A node's failure link leads to the node where matching
stands after the pieces that are certain by then have been split off; how many those are is stored with the
link. Counting a word's pieces is then one walk over its bytes, with no backing up and without building pieces.
"""

from __future__ import annotations

import json
from collections.abc import Iterable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from relslice.llm.arrowmap import add_columns, column
from relslice.llm.bpe import _byte_of_char

#: Words whose counts a task remembers, and their length at most; the table is emptied when full.
CACHE_ENTRIES, CACHE_CHARS = 200_000, 64

#: Rows split into words at a time.
SLICE_ROWS = 256


class PieceCounter:
    """The automaton over two sets of pieces: those that begin a word and those that continue one."""

    def __init__(self, initial: Iterable[bytes], continuing: Iterable[bytes]):
        # Nodes are numbers: 0 is the root of initial pieces, 1 that of continuing ones.
        self.child: list[dict[int, int]] = [{}, {}]
        piece = [False, False]
        for root, pieces in ((0, initial), (1, continuing)):
            for p in pieces:
                node = root
                for byte in p:
                    node = self.child[node].setdefault(byte, len(self.child))
                    if node == len(self.child):
                        self.child.append({})
                        piece.append(False)
                if p:
                    piece[node] = True
        n = len(self.child)
        #: Failure link, -1 where no pieces can be split off, and the number of pieces that taking it splits off.
        self.link, self.popped = [-1] * n, [0] * n
        queue = [0, 1]
        for node in queue:
            for byte, to in self.child[node].items():
                if piece[to]:
                    self.link[to], self.popped[to] = 1, 1
                else:
                    at, count = self.link[node], self.popped[node]
                    while at >= 0 and byte not in self.child[at]:
                        count += self.popped[at]
                        at = self.link[at]
                    if at >= 0:
                        self.link[to], self.popped[to] = self.child[at][byte], count
                queue.append(to)
        self.known: dict[str, int] = {}
        self.long: list[str] = []

    def count(self, word: bytes) -> int:
        """Number of pieces of a word, 0 if it has no segmentation or is empty."""
        child, link, popped = self.child, self.link, self.popped
        node = total = 0
        for byte in word:
            while byte not in child[node]:
                total += popped[node]
                node = link[node]
                if node < 0:
                    return 0
            node = child[node][byte]
        while node != 1:
            total += popped[node]
            node = link[node]
            if node < 0:
                return 0
        return total

    def counts(self, words: set[str]) -> dict[str, int]:
        """Counts of words, given as Latin-1 text of their bytes, by way of the table of known ones; 0 for the empty word.

        Words of more than CACHE_CHARS bytes stay in the table until the next call only.
        """
        for w in self.long:
            self.known.pop(w, None)
        if len(self.known) + len(words) > CACHE_ENTRIES:
            self.known.clear()
        for w in words - self.known.keys():
            self.known[w] = self.count(b" " + w.encode("latin-1")) if w else 0
        self.long = [w for w in words if len(w) > CACHE_CHARS]
        return self.known


def byte_level_pieces(path: str) -> tuple[list[bytes], list[bytes]]:
    """The pieces of a byte-level vocabulary file: those with a leading space begin words, the others continue them."""
    with open(path, encoding="utf-8") as f:
        spec = json.load(f)
    char, special = _byte_of_char(), {t["content"] for t in spec.get("added_tokens", [])}
    pieces = [bytes(char[c] for c in s) for s in spec["model"]["vocab"] if s not in special]
    return [p for p in pieces if p[:1] == b" "], [p for p in pieces if p[:1] != b" "]


_loaded: dict[str, PieceCounter] = {}


def _release() -> None:
    _loaded.clear()


def token_counts(docs: DataFrame, path: str, text: str = "text") -> DataFrame:
    """``docs`` with n_words, n_tokens and n_unknown: greedy longest-match pieces of the byte-level vocabulary at ``path``.

    Words are runs of anything but ASCII white space and are matched whole, as a space and their UTF-8 bytes. A
    word that has no segmentation counts as one token and is unknown; a vocabulary that holds all single bytes
    knows every word. Null and empty texts have no words. Repeated rows count alike; clashing columns are
    replaced. ``path`` must be readable on every executor.
    """

    def make(batch: pa.RecordBatch) -> list[pa.Array]:
        if path not in _loaded:
            _loaded[path] = PieceCounter(*byte_level_pieces(path))
        counter = _loaded[path]
        texts = column(batch, text)
        n_words, n_tokens, n_unknown = [], [], []
        for at in range(0, len(texts), SLICE_ROWS):
            # Splitting bytes cuts at ASCII white space only; words are kept as Latin-1 text of their bytes.
            rows = [(t or "").encode().translate(_SPACES).decode("latin-1").split(" ") for t in texts.slice(at, SLICE_ROWS).to_pylist()]
            known = counter.counts({w for r in rows for w in r})
            for r in rows:
                found = np.array([known[w] for w in r], np.int64)
                empty = r.count("")
                unknown = int((found == 0).sum()) - empty
                n_words.append(len(r) - empty)
                n_tokens.append(int(found.sum()) + unknown)
                n_unknown.append(unknown)
        return [pa.array(x, pa.int64()) for x in (n_words, n_tokens, n_unknown)]

    return add_columns(docs, "n_words long, n_tokens long, n_unknown long", make, done=_release)


_SPACES = bytes(32 if i in (9, 10, 11, 12, 13) else i for i in range(256))
