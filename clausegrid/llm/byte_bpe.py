"""Byte-level BPE encoding and decoding by a file of ranks.

A text is split by the vocabulary's pattern; each match is encoded by itself. Bytes map to Latin-1, so an
Aho-Corasick automaton over strings finds the longest token that starts at every byte (it holds the tokens
reversed and runs over the reversed match). The encoder goes from longest match to longest match, falls back to
shorter ones, and steps back where none fits; a token may follow another only if merging their joined bytes gives just
these two, which is remembered by pair. A sequence whose neighbours all fit is the one that the merges
give. The encoding of a prefix is unique, so a position from which nothing fits is never tried again: linear time.
"""

from __future__ import annotations

import base64
import gc
from array import array

import ahocorasick
import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import DataFrame, types as T

from clausegrid.llm.common import Closing, Memo, class_edges, looked_up, map_columns, text_bytes

#: The pattern (a fixed value of the vocabularies) none of whose matches crosses a single space between other characters.
SPACED_PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: Texts' chunks that a Python worker remembers, and pairs of tokens whose compatibility it remembers.
REMEMBERED, PAIRS = 400_000, 1_000_000


def cuts(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Where single spaces or line breaks stand between other characters, within a text, and where classes of characters meet.

    Characters that may be other white space are told by their last or first bytes; in doubt there is no cut.
    """
    at = np.flatnonzero((data[1:-1] == 32) | (data[1:-1] == 10)) + 1
    inside = np.ones(len(data) + 1, bool)
    inside[offsets] = inside[np.maximum(offsets - 1, 0)] = False
    at = at[inside[at]]
    before, after, earlier = data[at - 1], data[at + 1], data[np.maximum(at - 2, 0)]
    shown = ((before > 32) & (before < 127)) | ((before > 127) & ~np.isin(earlier, (0xC2, 0x9A, 0x80, 0x81)))
    at = at[shown & (((after > 32) & (after < 127)) | ((after > 127) & ~np.isin(after, (0xC2, 0xE1, 0xE2, 0xE3))))]
    return np.concatenate([at, class_edges(data, False)])


class ByteBpe:
    def __init__(self, ranks: dict[bytes, int], pattern: str, remembered: int = REMEMBERED):
        self.ranks, self.pattern, self.spaced = ranks, regex.compile(pattern), pattern == SPACED_PATTERN
        self.tokens: dict[int, bytes] = {r: b for b, r in ranks.items()}
        # whole matches that are tokens are taken as they are, even those that merges alone never make
        self.halves: dict[int, tuple[int, int]] = {}
        made = [b for b in ranks if len(b) == 1 or self._halve(b)]
        top = max(ranks.values(), default=-1) + 1
        self.sizes = [len(self.tokens.get(k, b"")) for k in range(top)]
        forward, self.automaton = set(made), ahocorasick.Automaton()
        self.shorter: list[int | None] = [None] * top
        for b in made:
            self.automaton.add_word(b.decode("latin-1")[::-1], ranks[b])
            self.shorter[ranks[b]] = next((ranks[b[:k]] for k in range(len(b) - 1, 0, -1) if b[:k] in forward), None)
        self.automaton.make_automaton()
        self.fits: list[dict[int, bool]] = [{} for _ in range(top)]
        self.n_fits = 0
        self.spines: tuple[dict, dict] = ({}, {})
        self.chunks = Memo(self._chunks, remembered)
        self.table: pa.Array | None = None

    def _halve(self, token: bytes) -> bool:
        """Notes the two tokens whose merge makes this one; False if merges never do."""
        parts = [token[k : k + 1] for k in range(len(token))]
        while len(parts) > 2:
            found = [self.ranks.get(x + y, 1 << 60) for x, y in zip(parts, parts[1:])]
            low = min(found)
            if low == 1 << 60:
                return False
            at = found.index(low)
            parts[at : at + 2] = [parts[at] + parts[at + 1]]
        if len(parts) < 2 or not all(p in self.ranks for p in parts):
            return False
        self.halves[self.ranks[token]] = (self.ranks[parts[0]], self.ranks[parts[1]])
        return True

    def _spine(self, token: int, side: int) -> list[tuple[bytes, int, int]]:
        """The tokens that stand at one end of a token while merges build it, last first: (bytes, made at, absorbed at)."""
        found = self.spines[side].get(token)
        if found is None:
            found, part, until = [], token, 1 << 60
            while True:
                data = self.tokens[part]
                found.append((data, part if len(data) > 1 else -1, until))
                if len(data) == 1:
                    break
                until, part = part, self.halves[part][side]
            self.spines[side][token] = found
        return found

    def _fit(self, left: int, right: int) -> bool:
        """Whether merging the joined bytes gives these two tokens.

        It does unless, at some time, the tokens at the border form a pair of a lower rank than the next merges of
        both; of equal ranks the one further left is merged first.
        """
        found, rank = True, self.ranks.get
        ends = self._spine(right, 0)
        for a, a_made, a_until in self._spine(left, 1):
            for b, b_made, b_until in ends:
                if a_made < b_until and b_made < a_until:
                    r = rank(a + b)
                    if r is not None and r < a_until and r <= b_until:
                        found = False
                        break
            if not found:
                break
        self.n_fits += 1
        if self.n_fits > PAIRS:
            self.n_fits = 0
            for x in self.fits:
                x.clear()
        self.fits[left][right] = found
        return found

    def encode_bytes(self, data: bytes) -> list[int]:
        """The ids of one match of the pattern."""
        whole = self.ranks.get(data)
        if whole is not None or not data:
            return [] if whole is None else [whole]
        n = len(data)
        last = n - 1
        longest: list[int | None] = [None] * n
        for end, token in self.automaton.iter(data.decode("latin-1")[::-1]):
            if longest[last - end] is None:  # of the tokens that end at a place the longest comes first
                longest[last - end] = token
        out: list[int] = []
        at, token, dead = 0, longest[0], bytearray(n + 1)
        sizes, shorter, fits, fit, known = self.sizes, self.shorter, self.fits, self._fit, None
        while at < n:
            while token is not None:
                if not dead[at + sizes[token]]:
                    if known is None:
                        break
                    ok = known.get(token)
                    if fit(out[-1], token) if ok is None else ok:
                        break
                token = shorter[token]
            if token is not None:
                out.append(token)
                known = fits[token]
                at += sizes[token]
                token = longest[at] if at < n else None
            else:
                dead[at] = 1
                token = out.pop()
                known = fits[out[-1]] if out else None
                at -= sizes[token]
                token = shorter[token]
        return out

    def _chunks(self, chunks: list[str]) -> list[bytes]:
        find, encode = self.pattern.findall, self.encode_bytes
        return [array("i", [i for m in find(c) for i in encode(m.encode())]).tobytes() for c in chunks]

    def encode(self, texts: pa.Array | list) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all texts, where each text's begin and the last one's end); null texts have none."""
        data, offsets = text_bytes(texts)
        ids, ends = looked_up(self.chunks, data, offsets, cuts(data, offsets) if self.spaced else offsets)
        return ids.view("<i4"), ends // 4

    def decode(self, ids: np.ndarray, ends: np.ndarray) -> pa.Array:
        """The bytes of each list of ids, given by where each begins and the last one ends; unknown ids fail."""
        if self.table is None:
            self.table = pa.array([self.tokens.get(k) for k in range(max(self.tokens, default=-1) + 1)], pa.large_binary())
        found = self.table.take(pa.array(ids))
        if found.null_count:
            raise ValueError("an id that the vocabulary does not have")
        bounds = np.frombuffer(found.buffers()[1], np.int64)[np.asarray(ends)] if len(ids) else np.zeros(len(ends), np.int64)
        return pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(ends) - 1, [None, pa.py_buffer(bounds), found.buffers()[2] if len(ids) else pa.py_buffer(b"")])


def read_ranks(path: str) -> dict[bytes, int]:
    """Ranks from lines of base64 bytes and a number."""
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in (line.split() for line in f if line.strip())}


_CODERS: dict[tuple[str, str], ByteBpe] = {}


def coder(path: str, pattern: str) -> ByteBpe:
    """One for each Python worker."""
    if (path, pattern) not in _CODERS:
        _CODERS[path, pattern] = ByteBpe(read_ranks(path), pattern)
        gc.freeze()  # the tables stay; the collector need not look at them again
    return _CODERS[path, pattern]


def encode(docs: DataFrame, path: str, pattern: str, text: str = "text", keep: list[str] | None = None, decoded: bool = False) -> DataFrame:
    """Adds `ids` (array of int) and, if asked for, `decoded`: the bytes that these ids decode to.

    Null and empty texts have no ids. No special tokens: their strings are ordinary text. Columns with the names of results are
    replaced. Repeated rows get equal results. A very long text is coded by its chunks; without a known pattern it is one chunk.
    An empty table gives an empty table.
    """
    fields = [T.StructField("ids", T.ArrayType(T.IntegerType(), False))] + [T.StructField("decoded", T.BinaryType())] * decoded

    def make():
        bpe = coder(path, pattern)

        def f(texts):
            ids, ends = bpe.encode(texts)
            lists = pa.ListArray.from_arrays(pa.array(ends.astype(np.int32)), pa.array(ids))
            return [lists] + [bpe.decode(ids, ends).cast(pa.binary())] * decoded

        return Closing(f, bpe.chunks)

    return map_columns(docs, [text], docs.columns if keep is None else keep, fields, make)


def decode(rows: DataFrame, path: str, pattern: str, ids: str = "ids", keep: list[str] | None = None) -> DataFrame:
    """Adds `decoded`, the bytes of an array of ids; null for a null array, null ids are left out, unknown ids fail.

    A column named decoded is replaced. Repeated rows get equal results; an empty table gives an empty table.
    """

    def make():
        bpe = coder(path, pattern)

        def f(lists):
            lists = lists.cast(pa.list_(pa.int32()))
            flat = lists.flatten()
            sizes = pc.fill_null(pc.list_value_length(lists), 0).to_numpy(zero_copy_only=False)
            there = pc.is_valid(flat).to_numpy(zero_copy_only=False)
            ends = np.concatenate([[0], np.cumsum(there)])[np.concatenate([[0], np.cumsum(sizes)])]
            found = bpe.decode(pc.drop_null(flat).to_numpy(), ends).cast(pa.binary())
            return [pc.if_else(pc.is_valid(lists), found, pa.scalar(None, pa.binary()))]

        return f

    return map_columns(rows, [ids], rows.columns if keep is None else keep, [T.StructField("decoded", T.BinaryType())], make)
