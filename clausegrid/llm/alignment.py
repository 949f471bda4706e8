"""Cross-tokenizer alignment: the tokens that two tokenizers make of a text are cut into groups where both end, and linked where they overlap.

A task merges the cumulative ends of both sides' tokens, each side with a pointer of its own: every step is a link, and where both sides end a group is
closed. A whole slice of texts is merged at once, as all texts end on both sides. No token of either side crosses from a character to a space behind it, nor from
letters to marks, so texts are cut there first and each distinct chunk is encoded once.
A document keeps its distinct linked pairs of ids with how often each occurs. Spark counts the documents of each pair, finds the largest count of
each id of the first side, and both come back to the documents: the pairs in most documents, up to MAX_BROADCAST, to every task, the others, each
in few documents, by a join.
"""

from __future__ import annotations

import gc
import hashlib
import json
from array import array

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, functions as F, types as T

from clausegrid.llm.common import Closing, Memo, class_edges, cut, map_columns, text_bytes

#: Chunks that a Python worker remembers, and pairs of ids (20 bytes each) that are broadcast at most.
REMEMBERED, MAX_BROADCAST = 200_000, 1_000_000
#: Bytes of texts that are merged together (a single longer text comes alone).
TOGETHER = 1 << 20
_SPACE = "▁"
#: Last bytes that white space beyond ASCII has in UTF-8 (and other characters, too, before which no cut is made then).
_MAYBE_SPACE = np.zeros(256, bool)
_MAYBE_SPACE[[0x85, 0xA0, 0xA8, 0xA9, 0xAF, 0x9F, *range(0x80, 0x8B)]] = True


def two_pointers(a_ends: np.ndarray, b_ends: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(token of a, token of b) of each step of the merge, which is a link, and whether both end there, which closes a group.

    Ends are cumulative, in bytes, none repeated; both sides end together. At each end of either side, that side's pointer moves on.
    """
    size = int(a_ends[-1]) + 1 if len(a_ends) else 0
    in_a, in_b = np.zeros(size, bool), np.zeros(size, bool)
    in_a[a_ends] = in_b[b_ends] = True
    steps = np.flatnonzero(in_a | in_b)
    in_a, in_b = in_a[steps], in_b[steps]
    return np.cumsum(in_a) - in_a, np.cumsum(in_b) - in_b, in_a & in_b


def byte_letters() -> dict[str, int]:
    """The character that byte-level vocabularies write for each byte."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    others = [b for b in range(256) if b not in plain]
    return {chr(b): b for b in plain} | {chr(256 + k): b for k, b in enumerate(others)}


class Pair:
    """Both tokenizers, and the alignment of chunks. a_path: a byte-level vocabulary; b_path: a model of pieces with a space before each text."""

    def __init__(self, a_path: str, b_path: str, remembered: int = REMEMBERED):
        import sentencepiece
        from tokenizers import Tokenizer

        self.a, self.b = Tokenizer.from_file(a_path), sentencepiece.SentencePieceProcessor(model_file=b_path)
        self.a.encode_special_tokens = True
        letters = byte_letters()
        with open(a_path, encoding="utf-8") as f:
            described = json.load(f)
        entries = self.a.get_vocab()
        self.a_bytes = [b""] * (max(entries.values()) + 1)
        for piece, k in entries.items():
            self.a_bytes[k] = bytes(letters[c] for c in piece) if all(c in letters for c in piece) else piece.encode()
        ids = range(self.b.get_piece_size())
        self.b_bytes = [bytes([int(self.b.id_to_piece(k)[3:-1], 16)]) if self.b.is_byte(k) else self.b.id_to_piece(k).replace(_SPACE, " ").encode() for k in ids]
        self.a_sizes, self.b_sizes = (np.array([len(x) for x in side], np.int64) for side in (self.a_bytes, self.b_bytes))
        self.a_array, self.b_array = pa.array(self.a_bytes, pa.large_binary()), pa.array(self.b_bytes, pa.large_binary())
        # an id as it stands before a comma, a bar and a semicolon
        top = max(len(self.a_bytes), len(self.b_bytes))
        self.marked, self.top = pa.array([b"%d%s" % (k, mark) for mark in (b",", b"|", b";") for k in range(top)], pa.large_binary()), top
        # chunks are encoded by themselves only where no token crosses: on the first side no match of the byte-level pattern does
        before = described["pre_tokenizer"] or {}
        plain = [x for k, x in enumerate(self.b_bytes) if not self.b.is_control(k) and not self.b.is_unknown(k)]
        first = described["normalizer"] is None and before.get("type") == "ByteLevel" and before.get("use_regex", True)
        self.by_space = first and not any(b" " in x.lstrip(b" ") for x in plain)
        joined = np.frombuffer(b"\n".join(plain), np.uint8)
        self.by_mark = self.by_space and len(self.b.encode("\n")) == 2 and not len(class_edges(joined, False))
        self.chunks = Memo(self._encoded, remembered)

    def _encoded(self, chunks: list[str]) -> list[tuple[bytes, bytes]]:
        """The ids of both sides. A line break in front keeps the second side from putting a space before a chunk that has none."""
        firsts = self.a.encode_batch_fast(chunks, add_special_tokens=False)
        spaced = [c[:1] == " " for c in chunks]
        seconds = self.b.encode([c[1:] if own else "\n" + c for c, own in zip(chunks, spaced)], num_threads=1)
        return [(array("i", x.ids).tobytes(), array("i", y if own else y[2:]).tobytes()) for x, y, own in zip(firsts, seconds, spaced)]

    def cuts(self, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        """Spaces behind a character that surely is no white space, and where letters, digits and marks meet.

        Texts begin with a space, and one alone at their end stays with what is before it.
        """
        at = np.flatnonzero(data == 32)
        if not self.by_space:
            return at[:0]
        ends = np.zeros(len(data) + 1, bool)
        ends[offsets] = True
        at = at[(at > 0) & ~ends[at + 1]]
        before = data[at - 1]
        at = at[((before > 32) & (before < 127)) | ((before > 127) & ~_MAYBE_SPACE[before])]
        return np.concatenate([at, class_edges(data, False)]) if self.by_mark else at

    def _ids(self, texts: pa.Array) -> tuple:
        """For both sides the ids of all texts and where each text's begin, and the last one's end; the bytes of all texts and their offsets."""
        data, offsets = text_bytes(pc.binary_join_element_wise(pa.scalar("", pa.large_string()), texts, pa.scalar(" ", pa.large_string())))
        first = np.zeros(len(data) + 1, bool)
        first[self.cuts(data, offsets)] = first[offsets] = True
        starts = np.flatnonzero(first[:-1])
        parts = pa.LargeStringArray.from_buffers(len(starts), pa.py_buffer(np.append(starts, len(data))), pa.py_buffer(np.ascontiguousarray(data)))
        coded = parts.dictionary_encode()
        known = self.chunks.many(coded.dictionary.to_pylist())
        rows, sides = np.searchsorted(starts, offsets), []
        for k in range(2):
            ids, ends = _joined(pa.array([v[k] for v in known], pa.large_binary()).take(coded.indices))
            sides.append((np.frombuffer(ids, "<i4").astype(np.int64), ends[rows] // 4))
        return *sides, data, offsets

    def align(self, texts: pa.Array) -> list:
        """n_a, n_b, n_groups, n_links, groups_sha256, and the distinct pairs (a << 32 | b) with how often each is linked, of each text."""
        texts = pc.fill_null(texts.cast(pa.large_string()), "")
        size = np.cumsum(pc.binary_length(texts).to_numpy()) // TOGETHER
        at = [0, *(np.flatnonzero(size[1:] != size[:-1]) + 1).tolist(), len(texts)]
        parts = [self._part(texts.slice(a, b - a)) for a, b in zip(at, at[1:])]
        return [pa.concat_arrays(x) for x in zip(*parts)]

    def _part(self, texts: pa.Array) -> list[pa.Array]:
        n = len(texts)
        (a, a_at), (b, b_at), data, offsets = self._ids(texts)
        whole = pc.binary_length(texts).to_numpy() > 0
        for ids, at, pieces in ((a, a_at, self.a_array), (b, b_at, self.b_array)):
            made, ends = _joined(pieces.take(pa.array(ids)))
            bounds = ends[at]
            if len(made) != len(data) or (bounds != offsets).any() or made != data.tobytes():
                made, raw = memoryview(made), memoryview(data.tobytes())
                for k in np.flatnonzero(whole).tolist():
                    whole[k] = made[bounds[k] : bounds[k + 1]] == raw[offsets[k] : offsets[k + 1]]
        # only whole texts go on
        n_a, n_b = np.diff(a_at) * whole, np.diff(b_at) * whole
        a, b = a[np.repeat(whole, np.diff(a_at))], b[np.repeat(whole, np.diff(b_at))]
        a_ends, b_ends = np.cumsum(self.a_sizes[a]), np.cumsum(self.b_sizes[b])
        i, j, closed = two_pointers(a_ends, b_ends)
        links = np.concatenate([[0], np.cumsum(np.bincount(np.searchsorted(np.cumsum(n_a), i, "right"), minlength=n)[:n])])
        groups = np.concatenate([[0], np.cumsum(closed)])[links]
        pairs, times = self._pairs(a[i] << 32 | b[j], links)
        hashes = self._hashes(a, b, i[closed], j[closed], groups)
        return [pa.array(n_a), pa.array(n_b), pa.array(np.diff(groups)), pa.array(np.diff(links)), pa.array([h if w else "" for h, w in zip(hashes, whole.tolist())], pa.string()), pairs, times]

    def _pairs(self, codes: np.ndarray, bounds: np.ndarray) -> tuple[pa.Array, pa.Array]:
        found = [np.unique(codes[lo:hi], return_counts=True) for lo, hi in zip(bounds[:-1].tolist(), bounds[1:].tolist())]
        ends = pa.array(np.concatenate([[0], np.cumsum([len(x) for x, _ in found])]).astype(np.int32))
        pairs, times = (np.concatenate([x[k] for x in found] or [np.zeros(0, np.int64)]) for k in range(2))
        return pa.ListArray.from_arrays(ends, pa.array(pairs.astype(np.int64))), pa.ListArray.from_arrays(ends, pa.array(times.astype(np.int32)))

    def _hashes(self, a: np.ndarray, b: np.ndarray, a_last: np.ndarray, b_last: np.ndarray, groups: np.ndarray) -> list[str]:
        """SHA-256 of each text's groups. a_last, b_last: the last token of each group; groups: where each text's begin, and the last one's end."""
        number = np.concatenate([a, b])
        # a token's group, then its side: a stable sort puts each group's tokens of a before those of b
        group = np.concatenate([np.searchsorted(a_last, np.arange(len(a))), np.searchsorted(b_last, np.arange(len(b)))])
        mark = np.zeros(len(number), np.int64)
        mark[a_last], mark[len(a) + b_last] = 1, 2
        order = np.argsort(group, kind="stable")
        text, ends = _joined(self.marked.take(pa.array((mark * self.top + number)[order])))
        lengths = np.diff(a_last, prepend=-1) + np.diff(b_last, prepend=-1)
        at = ends[np.concatenate([[0], np.cumsum(lengths)])[groups]].tolist()
        text = memoryview(text)
        return [hashlib.sha256(text[lo : max(lo, hi - 1)]).hexdigest() for lo, hi in zip(at, at[1:])]


def _joined(values: pa.Array) -> tuple[bytes, np.ndarray]:
    """(the bytes of all values, where each begins and the last one ends)."""
    if not len(values):
        return b"", np.zeros(1, np.int64)
    ends = np.frombuffer(values.buffers()[1], np.int64)[values.offset : values.offset + len(values) + 1]
    return (values.buffers()[2] or pa.py_buffer(b"")).to_pybytes()[ends[0] : ends[-1]], ends - ends[0]


_PAIRS: dict[tuple[str, str], Pair] = {}


def tokenizers_of(a_path: str, b_path: str) -> Pair:
    """One for each Python worker."""
    if (a_path, b_path) not in _PAIRS:
        _PAIRS[a_path, b_path] = Pair(a_path, b_path)
        gc.freeze()
    return _PAIRS[a_path, b_path]


def aligned(docs: DataFrame, a_path: str, b_path: str, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, n_a, n_b, n_groups, n_links, groups_sha256, pairs, times of every row of docs."""
    fields = [T.StructField(c, T.LongType()) for c in ("n_a", "n_b", "n_groups", "n_links")]
    fields += [T.StructField("groups_sha256", T.StringType()), T.StructField("pairs", T.ArrayType(T.LongType())), T.StructField("times", T.ArrayType(T.IntegerType()))]

    def make():
        both = tokenizers_of(a_path, b_path)
        return Closing(both.align, both.chunks)

    return map_columns(docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text")), ["text"], ["doc_id"], fields, make)


def pair_counts(rows: DataFrame) -> DataFrame:
    """(pair, n, best): the documents that hold a pair linked, and whether no pair with its first id has more."""
    counts = cut(rows.select(F.explode("pairs").alias("pair")).groupBy("pair").agg(F.count("*").alias("n")).withColumn("a", F.shiftright("pair", 32)))
    most = counts.groupBy("a").agg(F.max("n").alias("most"))
    return counts.join(most, "a").select("pair", "n", (F.col("n") == F.col("most")).alias("best"))


def align(docs: DataFrame, a_path: str, b_path: str, doc_id: str = "doc_id", text: str = "text", max_broadcast: int = MAX_BROADCAST) -> DataFrame:
    """doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256 of every row of docs.

    Tokens are those of a space and the text. Null and empty texts, and texts whose tokens' bytes on either side are not these bytes, have no tokens: zeros
    and an empty groups_sha256. Each row is a document of its own, so repeated rows count again, whatever their ids; null ids keep their
    row. All pairs that tie for an id's largest count are best. Very long texts are aligned whole, one row of a slice of their own. Other columns are not
    looked at, whatever their names. An empty table gives an empty table.
    """
    spark = docs.sparkSession
    rows = cut(aligned(docs, a_path, b_path, doc_id, text).withColumn("r", F.monotonically_increasing_id()))
    counts = cut(pair_counts(rows))
    sizes = counts.agg(F.count("*").alias("pairs"), F.sum("n").alias("rows")).first()
    # pairs in so many documents that there cannot be more than max_broadcast of them
    often = 0 if sizes["pairs"] <= max_broadcast else sizes["rows"] // max(1, max_broadcast) + 1
    known = counts.where(F.col("n") >= often).orderBy("pair").toArrow() if often else counts.toArrow()
    order = np.argsort(known.column("pair").to_numpy())
    shared = spark.sparkContext.broadcast(tuple(known.column(c).to_numpy(zero_copy_only=False)[order] for c in ("pair", "n", "best")))
    fields = [T.StructField("n_best", T.LongType()), T.StructField("count_sum", T.LongType()), T.StructField("rest", T.ArrayType(T.LongType())), T.StructField("rest_times", T.ArrayType(T.IntegerType()))]

    def make():
        codes, n, best = shared.value

        def f(pairs, times):
            own, t, ends = pairs.flatten().to_numpy(), times.flatten().to_numpy().astype(np.int64), np.concatenate([[0], np.cumsum(pc.list_value_length(pairs).to_numpy())])
            if not len(codes):
                hit, at = np.zeros(len(own), bool), np.zeros(len(own), np.int64)
            else:
                at = np.minimum(np.searchsorted(codes, own), len(codes) - 1)
                hit = codes[at] == own
            sums = []
            for each in ((t * best[at] * hit) if len(codes) else t * 0, (t * n[at] * hit) if len(codes) else t * 0, ~hit):
                total = np.concatenate([[0], np.cumsum(each.astype(np.int64))])
                sums.append(total[ends[1:]] - total[ends[:-1]])
            left = pa.array(np.concatenate([[0], np.cumsum(sums[2])]).astype(np.int32))
            return [pa.array(sums[0]), pa.array(sums[1]), pa.ListArray.from_arrays(left, pa.array(own[~hit])), pa.ListArray.from_arrays(left, pa.array(t[~hit].astype(np.int32)))]

        return f

    plain = ["doc_id", "n_a", "n_b", "n_groups", "n_links", "groups_sha256", "r"]
    summed = map_columns(rows, ["pairs", "times"], plain, fields, make)
    out = ["doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"]
    if not often:
        return summed.select(*out)
    summed = cut(summed)
    rare = summed.select("r", F.explode(F.arrays_zip("rest", "rest_times")).alias("x")).select("r", F.col("x.rest").alias("pair"), F.col("x.rest_times").alias("t"))
    joined = rare.join(counts.where(F.col("n") < often), "pair")
    more = joined.groupBy("r").agg(F.sum(F.when(F.col("best"), F.col("t")).otherwise(0)).alias("more_best"), F.sum(F.col("t") * F.col("n")).alias("more"))
    whole = summed.join(more, "r", "left").na.fill(0, ["more_best", "more"])
    return whole.withColumns({"n_best": F.col("n_best") + F.col("more_best"), "count_sum": F.col("count_sum") + F.col("more")}).select(*out)
