"""Best-fit packing by minimum bin slack.

Pieces are planned by length alone. For a bin that starts with the longest length left, a dynamic program over
bitsets of reachable sums finds the fullest combination of the lengths still available; the combination is
removed as often as the counts allow. Each removal uses up a length, so the plan has a bounded number of steps
and rows (there are at most `capacity` lengths) however many pieces there are. Pieces then take the
places of their length in order; their order within a length comes from salted counts, so no length gathers in one task.
"""

from __future__ import annotations

import gc
import re
import zlib
from array import array

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window as W, functions as F, types as T

from clausegrid.llm.common import Closing, Memo, class_edges, cut, looked_up, map_columns, text_bytes, unused

CAPACITY, END_ID = 4096, 1
#: Pieces that are numbered together, roughly.
GROUP_ROWS = 500
#: Chunks that a Python worker remembers.
REMEMBERED = 400_000


# ---------------------------------------------------------------- tokens


class WordTokenizer:
    """Ids of a word-level BPE file as little-endian unsigned 32-bit bytes, by remembered chunks of texts.

    The vocabulary's pretokenizer never joins what white space separates, nor letters, digits and punctuation, so texts are cut
    there; each distinct chunk of a slice is looked up once. Plain chunks (ASCII and Latin-1 letters) are split here and go to the
    library's BPE model; all others go through the library's whole pipeline.
    """

    #: The pretokenizer's pattern, a fixed value of the vocabulary file, for the letters of plain chunks; a line break parts chunks.
    PIECES = re.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[a-zß-öø-ÿ]+|[0-9]|\n|[^a-zß-öø-ÿ0-9\n]+")
    PLAIN = re.compile(r"[!-~À-ÖØ-öø-ÿ]*")

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(path)
        self.special = tuple(t.content for t in self.library.get_added_tokens_decoder().values())
        self.special_bytes = [s.encode() for s in self.special]
        shown = [c for c in range(256) if 33 <= c <= 126 or 161 <= c <= 172 or 174 <= c]
        hidden = [c for c in range(256) if c not in set(shown)]
        self.byte_letters = {c: c for c in shown} | {c: 256 + k for k, c in enumerate(hidden)}
        self.chunks = Memo(self._chunks, REMEMBERED)

    def _piece(self, p: str) -> bytes:
        p = p if p.isascii() else p.encode().decode("latin-1").translate(self.byte_letters)
        return array("I", [t.id for t in self.library.model.tokenize(p)]).tobytes()

    def _plain(self, chunk: str) -> bool:
        inside = chunk.isprintable() if chunk.isascii() else self.PLAIN.fullmatch(chunk) is not None
        return inside and ("<|" not in chunk or not any(s in chunk for s in self.special))

    def _chunks(self, chunks: list[str]) -> list[bytes]:
        """Plain chunks are split together, a line break between them. A chunk may begin with spaces and has none elsewhere."""
        chunks = [c.lstrip(" ") for c in chunks]
        out: list[bytes | None] = [None] * len(chunks)
        plain = list(map(self._plain, chunks))
        easy, odd = [k for k, ok in enumerate(plain) if ok], [k for k, ok in enumerate(plain) if not ok]
        if easy:
            at, found = iter(easy), []
            here = next(at)
            for p in self.PIECES.findall("\n".join([chunks[k] for k in easy]).lower()):
                if p == "\n":
                    out[here], found, here = b"".join(found), [], next(at)
                else:
                    found.append(self._piece(p))
            out[here] = b"".join(found)
        if odd:
            for k, e in zip(odd, self.library.encode_batch([chunks[k] for k in odd], add_special_tokens=False)):
                out[k] = np.array(e.ids, "<u4").tobytes()
        return out

    def encode(self, texts: pa.Array | list) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all texts as bytes, where each text's begin and the last one's end); null texts have none."""
        data, offsets = text_bytes(texts)
        data = np.where(data == 10, np.uint8(32), data)
        cuts = np.flatnonzero(data == 32)
        # the strings of special tokens are found before anything is split, in the case that they have
        raw = data.tobytes()
        if not any(s in raw for s in self.special_bytes):
            data = np.where((data > 64) & (data < 91), data + np.uint8(32), data)
            cuts = np.concatenate([cuts, class_edges(data, True)])
        return looked_up(self.chunks, data, offsets, cuts)


_TOKENIZERS: dict[str, WordTokenizer] = {}


def tokenizer(path: str) -> WordTokenizer:
    """One for each Python worker."""
    if path not in _TOKENIZERS:
        _TOKENIZERS[path] = WordTokenizer(path)
        gc.freeze()  # the tables stay; the collector need not look at them again
    return _TOKENIZERS[path]


PIECE = T.StructType([T.StructField("piece", T.IntegerType()), T.StructField("start", T.LongType()), T.StructField("length", T.LongType()), T.StructField("ids_crc32", T.LongType())])


def _cut_up(ids: np.ndarray, ends: np.ndarray, capacity: int, end: bytes) -> pa.Array:
    """The list of pieces of each text, from the bytes of all ids and their ends by text."""
    view, crcs = memoryview(np.ascontiguousarray(ids)), []
    n_ids = np.diff(ends) // 4 + 1
    n_pieces = -(-n_ids // capacity)
    for a, b, n in zip(ends[:-1].tolist(), ends[1:].tolist(), n_pieces.tolist()):
        for at in range(a, a + 4 * capacity * (n - 1), 4 * capacity):
            crcs.append(zlib.crc32(view[at : at + 4 * capacity]))
        crcs.append(zlib.crc32(end, zlib.crc32(view[a + 4 * capacity * (n - 1) : b])))
    bounds = np.concatenate([[0], np.cumsum(n_pieces)])
    piece = np.arange(bounds[-1]) - np.repeat(bounds[:-1], n_pieces)
    length = np.minimum(capacity, np.repeat(n_ids, n_pieces) - piece * capacity)
    columns = [pa.array(piece.astype(np.int32)), pa.array(piece * capacity), pa.array(length), pa.array(crcs, pa.int64())]
    return pa.ListArray.from_arrays(pa.array(bounds.astype(np.int32)), pa.StructArray.from_arrays(columns, PIECE.fieldNames()))


def pieces(docs: DataFrame, path: str, doc_id: str = "doc_id", text: str = "text", capacity: int = CAPACITY, end_id: int = END_ID) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32 of every piece: ids and the end id, cut every `capacity` ids."""

    def make():
        words, end = tokenizer(path), end_id.to_bytes(4, "little")
        return Closing(lambda texts: [_cut_up(*words.encode(texts), capacity, end)], words.chunks)

    cut_up = map_columns(docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text")), ["text"], ["doc_id"], [T.StructField("pieces", T.ArrayType(PIECE))], make)
    return cut_up.select("doc_id", F.inline("pieces"))


# ---------------------------------------------------------------- plan


def fullest(lengths: list[int], counts: dict[int, int], room: int) -> list[tuple[int, int]]:
    """(length, number) of the combination with the largest sum up to `room`; lengths descend, numbers stay within counts.

    Bit s of a set says that sum s can be made; sets after each length are kept to walk back from the best sum.
    """
    limit = (1 << (room + 1)) - 1
    sums, reached = [], 1
    used = []
    for size in lengths:
        if size > room or not counts[size]:
            continue
        before, left, block = reached, min(counts[size], room // size), 1
        while left:  # multiples by doubling blocks
            take = min(block, left)
            reached |= (reached << (take * size)) & limit
            left -= take
            block *= 2
        sums.append(before)
        used.append(size)
        if reached >> room & 1:
            break
    best, picked = reached.bit_length() - 1, []
    for size, before in zip(reversed(used), reversed(sums)):
        n = 0
        while not before >> best & 1:
            best -= size
            n += 1
        if n:
            picked.append((size, n))
    return picked


def plan_bins(histogram: dict[int, int], capacity: int = CAPACITY) -> list[tuple[int, dict[int, int]]]:
    """(times, {length: number}) for every kind of bin; all pieces of the histogram are used up."""
    counts = {k: v for k, v in histogram.items() if v > 0}
    lengths, plan = sorted(counts, reverse=True), []
    while lengths:
        first = lengths[0]
        counts[first] -= 1
        bin_ = {first: 1}
        for size, n in fullest(lengths, counts, capacity - first):
            bin_[size] = bin_.get(size, 0) + n
        counts[first] += 1
        times = min(counts[size] // n for size, n in bin_.items())
        for size, n in bin_.items():
            counts[size] -= times * n
        plan.append((times, bin_))
        lengths = [x for x in lengths if counts[x]]
    return plan


def places(plan: list[tuple[int, dict[int, int]]]) -> dict[int, tuple[np.ndarray, ...]]:
    """For each length, by its pieces' order: first number of a run, run's first sequence, pieces a sequence, offset."""
    out: dict[int, list] = {}
    next_number: dict[int, int] = {}
    sequence = 0
    for times, bin_ in plan:
        offset = 0
        for size, n in bin_.items():
            first = next_number.get(size, 0)
            out.setdefault(size, []).append((first, sequence, n, offset))
            next_number[size] = first + times * n
            offset += size * n
        sequence += times
    return {size: tuple(np.array(c, np.int64) for c in zip(*runs)) for size, runs in out.items()}


def pack(cut_up: DataFrame, capacity: int = CAPACITY, group_rows: int = GROUP_ROWS) -> DataFrame:
    """Adds sequence_id and offset to pieces that have a `length` of 1 to `capacity`; columns of these names are replaced.

    Sequences are gapless from offset 0 and no longer than capacity. Pieces are dealt out by their place in the stored table, so
    repeated rows and rows with equal or null ids get different places and do not gather. Other columns pass through, whatever
    their names. An empty table gives an empty table.
    """
    stored = cut(cut_up)
    histogram = {r["length"]: r["n"] for r in stored.groupBy("length").agg(F.count("*").alias("n")).collect()}  # at most `capacity` rows
    shared = stored.sparkSession.sparkContext.broadcast(places(plan_bins(histogram, capacity)))
    parts = max([1, *(-(-n // group_rows) for n in histogram.values())])
    place, salt, before, number = unused(stored, "place", "salt", "before", "number")
    # a row's place in the stored table is the same each time that it is read
    salted = stored.withColumn(place, F.monotonically_increasing_id()).withColumn(salt, F.pmod(F.xxhash64(place), F.lit(parts)))
    sizes = salted.groupBy("length", salt).agg(F.count("*").alias(number))
    sums = F.sum(number).over(W.partitionBy("length").orderBy(salt).rowsBetween(W.unboundedPreceding, -1))
    base = sizes.select("length", salt, F.coalesce(sums, F.lit(0)).alias(before))
    ranked = salted.withColumn(number, F.row_number().over(W.partitionBy("length", salt).orderBy(place)) - 1)
    numbered = ranked.join(base, ["length", salt]).withColumn(number, F.col(before) + F.col(number))

    def make():
        runs = shared.value

        def f(lengths, numbers):
            lengths, numbers = (x.to_numpy(zero_copy_only=False).astype(np.int64) for x in (lengths, numbers))
            sequence, offset = np.zeros(len(lengths), np.int64), np.zeros(len(lengths), np.int64)
            for size in np.unique(lengths).tolist():
                at = np.flatnonzero(lengths == size)
                first, start, n, base_offset = runs[size]
                k = np.searchsorted(first, numbers[at], "right") - 1
                into = numbers[at] - first[k]
                sequence[at] = start[k] + into // n[k]
                offset[at] = base_offset[k] + into % n[k] * size
            return [pa.array(sequence), pa.array(offset)]

        return f

    return map_columns(numbered, ["length", number], stored.columns, [T.StructField("sequence_id", T.LongType()), T.StructField("offset", T.LongType())], make)


def pack_documents(docs: DataFrame, path: str, doc_id: str = "doc_id", text: str = "text", capacity: int = CAPACITY, end_id: int = END_ID) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32, sequence_id, offset of every piece of every row of docs.

    Null and empty texts are the end id alone. A longer document fills whole sequences; its last piece is packed with
    the others, so a very long text only needs the memory of its ids. Rows with a null doc_id and repeated rows are packed
    like all others; other columns of docs are not returned. An empty table gives an empty table.
    """
    return pack(pieces(docs, path, doc_id, text, capacity, end_id), capacity)
