"""Byte-level BPE encoding and decoding by prefix-sharing trie traversal.

The distinct words of a batch go into a trie. A depth-first walk gives each trie node (a word prefix) the last
token of the prefix's encoding. The encoding of a prefix is that of the prefix without its last token, plus that
token, so one token per node describes all encodings and shared prefixes are worked out once. The last token is
the only vocabulary entry that ends the prefix and forms a pair with the preceding state that BPE would leave
apart.
"""

from __future__ import annotations

import json
import re
import struct
import sys
from array import array
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import DataFrame

from relslice.llm.arrowmap import add_columns, column

#: The pre-tokenizer pattern of byte-level BPE.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"

#: Bytes, about, of each half of a table of encodings that a Python worker remembers.
CACHE_BYTES = 4 << 20

#: Encodings of longer segments and words are not remembered.
CACHE_CHARS = 64

#: Pairs of tokens that a Python worker remembers, about 100 bytes each.
CACHE_PAIRS = 120_000

#: Bytes of the texts that go into the trie together; a longer text goes alone.
SLICE_BYTES = 4 << 20

#: Words of more bytes keep their states in flat arrays, four bytes a state.
LONG_WORD = 1 << 16


def _byte_of_char() -> dict[str, int]:
    """The byte-level alphabet: printable Latin-1 stands for itself, the others follow from 256 on."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


class _Recent:
    """Encodings looked up lately, in two halves of about CACHE_BYTES: when the newer is full, the older is dropped.

    Keys longer than CACHE_CHARS are never kept.
    """

    def __init__(self):
        self.now: dict[str, bytes] = {}
        self.before: dict[str, bytes] = {}
        self.size = 0

    def look_up(self, keys: list[str], learn: Callable[[list[str]], dict[str, bytes]]) -> list[bytes]:
        """The encodings of distinct ``keys``; those in neither half are learned."""
        if self.size > CACHE_BYTES:
            self.now, self.before, self.size = {}, self.now, 0
        now = self.now
        codes = list(map(now.get, keys))
        holes = [(i, k, self.before.get(k)) for i, (k, c) in enumerate(zip(keys, codes, strict=True)) if c is None]
        new = learn([k for _, k, c in holes if c is None])
        for i, k, c in holes:
            codes[i] = code = new[k] if c is None else c
            if len(k) <= CACHE_CHARS:
                now[k] = code
                self.size += len(k) + len(code) + 200
        return codes


class BytePairCodec:
    """A byte-level BPE vocabulary with encode and decode; built once per partition and path."""

    _loaded: dict[str, BytePairCodec] = {}

    @classmethod
    def load(cls, path: str) -> BytePairCodec:
        if path not in cls._loaded:
            cls._loaded[path] = cls(path)
        return cls._loaded[path]

    @classmethod
    def release(cls) -> None:
        """Forget all codecs: a worker that has finished a partition may serve other operators next."""
        cls._loaded.clear()

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        char, model = _byte_of_char(), spec["model"]
        self.special = {t["content"]: t["id"] for t in spec.get("added_tokens", [])}
        self.id_of: dict[bytes, int] = {bytes(char[c] for c in s): i for s, i in model["vocab"].items() if s not in self.special}
        self.bytes_of: dict[int, bytes] = {i: b for b, i in self.id_of.items()} | {i: s.encode() for s, i in self.special.items()}
        # The bytes of all tokens by id, one behind the other; the last entry stands for unknown ids.
        self.starts = np.cumsum([0, *[len(self.bytes_of.get(i, b"")) for i in range(max(self.bytes_of, default=-1) + 1)], 0])
        self.flat = np.frombuffer(b"".join([self.bytes_of[i] for i in sorted(self.bytes_of)]), np.uint8)
        self._merges: list | None = model["merges"]
        self.special_split = re.compile("(" + "|".join(re.escape(s) for s in sorted(self.special, key=len, reverse=True)) + ")") if self.special else None

    def _prepare(self) -> None:
        """What encoding needs beyond the vocabulary; decoding goes without."""
        char, merges, self._merges = _byte_of_char(), self._merges, None
        self.left, self.right, self.rank, self.merge = {}, {}, {}, {}
        for r, pair in enumerate(merges):
            a, b = (bytes(char[c] for c in s) for s in (pair.split(" ") if isinstance(pair, str) else pair))
            a, b, joined = self.id_of[a], self.id_of[b], self.id_of[a + b]
            self.left[joined], self.right[joined], self.rank[joined] = a, b, r
            self.merge[a, b] = r
        # Every end of a vocabulary entry, with its id where it is an entry itself, else -1.
        self.ends = {b[k:]: -1 for b in self.id_of for k in range(len(b))} | self.id_of
        self.apart: dict[int, bool] = {}
        self.reached: dict[int, bool] = {}
        self.split = regex.compile(PATTERN).findall
        self.plain, self.spaced, self.words = _Recent(), _Recent(), _Recent()

    def stays_apart(self, a: int, b: int) -> bool:
        """Whether BPE over the bytes of two adjacent tokens gives just these two.

        The merges that made both are undone, the latest first; if at any time the tokens that touch could have
        merged before the step that is undone, BPE would have taken that merge. Of equal merges the left goes
        first.
        """
        key, limit, rank = a << 20 | b, len(self.merge), self.rank
        known = self.apart.get(key)
        if known is not None:
            return known
        while True:
            if self.merge.get((a, b), limit) < limit:
                answer = False
                break
            ra, rb = rank.get(a, -1), rank.get(b, -1)
            if ra < 0 and rb < 0:
                answer = True
                break
            if ra > rb:
                limit, a = ra, self.right[a]
            else:
                limit, b = rb + 1, self.left[b]
        if len(self.apart) > CACHE_PAIRS:
            self.apart.clear()
        self.apart[key] = answer
        return answer

    def encode_words(self, words: Iterable[bytes]) -> dict[bytes, bytes]:
        """Packed ids of distinct non-empty words, by one walk of their trie.

        Sorted words are the trie in depth-first order: what a word shares with the one before it is the path
        from the root that both have, whose states are kept; the walk goes down only the rest of the word.
        """
        found: dict[bytes, bytes] = {}
        get, apart, known, reached = self.ends.get, self.stays_apart, self.apart, self.reached
        words = sorted(words)
        deepest = max(map(len, words), default=0)
        # By depth on the path: last token of the prefix's encoding, and the depth at which that token begins.
        none = [0] if deepest <= LONG_WORD else array("i", [0])
        last, begin = none * (deepest + 1), none * (deepest + 1)
        before = b""
        for w in words:
            n = len(w)
            d, shared = 0, min(len(before), n)
            while d < shared and before[d] == w[d]:
                d += 1
            for d in range(d + 1, n + 1):
                # Most often the last token of the shorter prefix grows by this byte; else try every other end.
                at = begin[d - 1]
                token = get(w[at:d], -1)
                if token < 0 or not (known.get(last[at] << 20 | token) or apart(last[at], token) if at else reached.get(token) or self._whole(token)):
                    for at in range(d - 1, -1, -1):
                        token = get(w[at:d])
                        if token is None:
                            raise AssertionError("no entry of the vocabulary ends this prefix")
                        if token >= 0 and (known.get(last[at] << 20 | token) or apart(last[at], token) if at else self._whole(token)):
                            break
                last[d], begin[d] = token, at
            # The states along the word's own chain of tokens, from its end to the root.
            at, ids = begin[n], [last[n]]
            while at:
                ids.append(last[at])
                at = begin[at]
            ids.reverse()
            found[w] = array("I", ids).tobytes() if _NATIVE else struct.pack(f"<{len(ids)}I", *ids)
            before = w
        return found

    def _whole(self, token: int) -> bool:
        """Whether BPE makes the bytes of this vocabulary entry into the entry itself."""
        if token not in self.reached:
            parts = [self.id_of[bytes([b])] for b in self.bytes_of[token]]
            while len(parts) > 1:
                best = min(range(len(parts) - 1), key=lambda i: self.merge.get((parts[i], parts[i + 1]), len(self.merge)))
                if (parts[best], parts[best + 1]) not in self.merge:
                    break
                parts[best : best + 2] = [self.id_of[self.bytes_of[parts[best]] + self.bytes_of[parts[best + 1]]]]
            self.reached[token] = parts == [token]
        return self.reached[token]

    def _learn(self, segments: list[str], lead: str) -> dict[str, bytes]:
        """Packed ids of distinct text segments that all have ``lead`` before them, by way of the trie."""
        single, pieces = {}, {}
        for s in segments:
            if s.isalpha():  # letters only: one word, no need for the pattern
                single[s] = (lead + s).encode()
            elif (m := _WORD_AND_MARK.fullmatch(s)) and m[1].isalpha():
                pieces[s] = [lead + m[1], m[2]]
            else:
                pieces[s] = self.split(lead + s)
        coded = self.encode_words(set(single.values()))
        out = {s: coded[w] for s, w in single.items()}
        if pieces:
            words = list({w for p in pieces.values() for w in p})
            get = dict(zip(words, self.words.look_up(words, self._learn_words), strict=True)).__getitem__
            out.update([(s, b"".join(map(get, p))) for s, p in pieces.items()])
        return out

    def _learn_words(self, words: list[str]) -> dict[str, bytes]:
        coded = self.encode_words([w.encode() for w in words])
        return {w: coded[w.encode()] for w in words}

    def encode_column(self, texts: pa.Array) -> pa.Array:
        """The ids of each text (none is null) as little-endian unsigned 32-bit integers.

        A space before a character that isn't white space always starts a word, so texts are cut there and each
        distinct segment is looked up; only segments that are new to this worker go through pattern and trie.
        """
        if self._merges is not None:
            self._prepare()
        odd = pc.match_substring_regex(texts, _ODD_SPACE)
        for s in self.special:
            odd = pc.or_(odd, pc.match_substring(texts, s))
        if not odd.true_count:
            return self._encode_plain(texts)
        plain = self._encode_plain(texts.filter(pc.invert(odd)))
        rest = pa.array([self._encode_odd(t) for t in texts.filter(odd).to_pylist()], pa.binary())
        back = np.argsort(np.argsort(odd.to_numpy(zero_copy_only=False), kind="stable"), kind="stable")
        return pa.concat_arrays([plain, rest]).take(pa.array(back))

    def _encode_odd(self, text: str) -> bytes:
        """One text that may hold special tokens, and spaces with white space or the end behind them."""
        out = []
        for piece in self.special_split.split(text) if self.special_split else [text]:
            if piece in self.special:
                out.append(struct.pack("<I", self.special[piece]))
            elif piece:
                first, *rest = _SPACE_THEN_WORD.split(piece)
                out += self.plain.look_up([first], lambda new: self._learn(new, ""))
                words = list(set(rest))
                out += map(dict(zip(words, self.spaced.look_up(words, lambda new: self._learn(new, " ")), strict=True)).__getitem__, rest)
        return b"".join(out)

    def _encode_plain(self, texts: pa.Array) -> pa.Array:
        """Texts without special tokens whose spaces all start a word: cut at every space."""
        if not len(texts):
            return pa.array([], pa.binary())
        pieces = pc.split_pattern(texts, " ")
        words = pieces.flatten().dictionary_encode()
        names, index = words.dictionary.to_pylist(), words.indices.to_numpy().astype(np.int64)
        ends = np.cumsum(pc.list_value_length(pieces).to_numpy())
        first = np.concatenate([[0], ends[:-1]])
        # First segments have no space before them; they get entries of their own behind the others.
        leading, place = np.unique(index[first], return_inverse=True)
        index[first] = len(names) + place
        spaced = np.unique(index)
        spaced = spaced[spaced < len(names)]
        codes = [b""] * len(names)
        for i, c in zip(spaced.tolist(), self.spaced.look_up([names[i] for i in spaced.tolist()], lambda new: self._learn(new, " ")), strict=True):
            codes[i] = c
        codes += self.plain.look_up([names[i] for i in leading.tolist()], lambda new: self._learn(new, ""))
        starts = np.cumsum([0, *map(len, codes)]) // 4
        data, upto = _gathered(np.frombuffer(b"".join(codes), "<u4"), starts, index)
        return _binary(data, 4 * np.concatenate([[0], upto[ends - 1]]))

    def decode_column(self, packed: pa.Array) -> pa.Array:
        """The texts of packed ids; unknown ids and null give nothing, bytes that are no UTF-8 the replacement character."""
        ids, ends = _binary_buffers(packed)
        if (ends % 4).any():
            raise ValueError("packed ids are four bytes each")
        index = np.minimum(ids.view("<u4").astype(np.int64), self.starts.size - 2)
        data, upto = _gathered(self.flat, self.starts, index)
        raw = _binary(data, np.concatenate([[0], upto])[ends // 4])
        try:
            return raw.cast(pa.string())
        except pa.ArrowInvalid:
            return pa.array([b.decode("utf-8", "replace") for b in raw.to_pylist()], pa.string())

    def encode_batch(self, texts: list[str]) -> list[bytes]:
        return self.encode_column(pa.array(texts, pa.string())).to_pylist()

    def decode(self, packed: bytes) -> bytes:
        return self.decode_column(pa.array([packed], pa.binary()))[0].as_py().encode()


#: Whether this machine's own integers are those that token ids are packed as.
_NATIVE = sys.byteorder == "little" and array("I").itemsize == 4
#: A space with white space (of any script) or the end behind it.
_ODD_SPACE = r" ([\s\x0b\x1c-\x1f\x{85}\pZ]|$)"
_SPACE_THEN_WORD = re.compile(r" (?=\S)")
_WORD_AND_MARK = re.compile(r"(.+)([,.;:!?])")

#: Items gathered at a time.
_GATHER = 1 << 20


def _gathered(flat: np.ndarray, starts: np.ndarray, index: np.ndarray) -> tuple[bytes, np.ndarray]:
    """The parts ``index`` of ``flat`` (part i begins at ``starts[i]``) one behind the other, and where each of them ends."""
    size = starts[index + 1] - starts[index]
    upto, out = np.cumsum(size), []
    for a in range(0, index.size, _GATHER):
        some, n = index[a : a + _GATHER], size[a : a + _GATHER]
        shift = starts[some] - (np.cumsum(n) - n)
        out.append(flat[np.repeat(shift, n) + np.arange(n.sum())].tobytes())
    return b"".join(out), upto


def _binary(data: bytes, ends: np.ndarray) -> pa.Array:
    return pa.Array.from_buffers(pa.binary(), ends.size - 1, [None, pa.py_buffer(ends.astype(np.int32)), pa.py_buffer(data)])


def _binary_buffers(packed: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a binary column, nulls as empty, and the end of each row behind a leading 0."""
    packed = pa.concat_arrays([pc.fill_null(packed.cast(pa.binary()), b"")])
    ends = np.frombuffer(packed.buffers()[1], np.int32)[packed.offset : packed.offset + len(packed) + 1].astype(np.int64) if len(packed) else np.zeros(1, np.int64)
    data = np.frombuffer(packed.buffers()[2] or b"", np.uint8)
    return data[ends[0] : ends[-1]], ends - ends[0]


def _slices(texts: pa.Array) -> Iterator[pa.Array]:
    """Consecutive rows of about SLICE_BYTES, one row at least; null texts as empty ones."""
    texts = pc.fill_null(texts, "")
    ends = np.cumsum(pc.binary_length(texts).to_numpy(zero_copy_only=False), dtype=np.int64)
    row = 0
    while row < len(texts):
        stop = max(row + 1, int(np.searchsorted(ends, (ends[row - 1] if row else 0) + SLICE_BYTES, side="right")))
        yield texts.slice(row, stop - row)
        row = stop


def encode(docs: DataFrame, path: str, text: str = "text", ids: str = "token_ids") -> DataFrame:
    """``docs`` with the binary column ``ids``: the text's token ids as little-endian unsigned 32-bit integers.

    A null text is encoded as the empty text, which has no ids. Repeated rows are encoded alike. Columns named
    like ``ids`` are replaced; all other columns are kept. ``path`` must be readable on every executor. Memory
    grows in proportion to the longest text, also where it is one unbroken word.
    """
    return add_columns(docs, f"{ids} binary", lambda batch: [_packed(BytePairCodec.load(path), column(batch, text))], done=BytePairCodec.release)


def _packed(codec: BytePairCodec, texts: pa.Array) -> pa.Array:
    return pa.concat_arrays([codec.encode_column(part) for part in _slices(texts)] or [pa.array([], pa.binary())])


def decode(coded: DataFrame, path: str, ids: str = "token_ids", decoded: str = "decoded") -> DataFrame:
    """``coded`` with the string column ``decoded``; null or empty ids give the empty text, special tokens are kept."""
    return add_columns(coded, f"{decoded} string", lambda batch: [BytePairCodec.load(path).decode_column(column(batch, ids))], done=BytePairCodec.release)


def encode_and_decode(docs: DataFrame, path: str, text: str = "text", ids: str = "token_ids", decoded: str = "decoded") -> DataFrame:
    """:func:`encode`, then :func:`decode` of the ids, in one pass of one Python worker per task."""

    def make(batch: pa.RecordBatch) -> list[pa.Array]:
        codec = BytePairCodec.load(path)
        packed = _packed(codec, column(batch, text))
        return [packed, codec.decode_column(packed)]

    return add_columns(docs, f"{ids} binary, {decoded} string", make, done=BytePairCodec.release)
