"""Line dedup: two Bloom filters find lines that may repeat; only those are shuffled and confirmed.

A first pass over the texts fills, in each task, a filter of line hashes seen once and a filter of
hashes seen twice. Tasks hand over the filters in segments; segments are joined (once = or, twice = or
of both plus what both saw once) by segment number, so no task holds more than its segments. The second
filter, at most MAX_BITS wide, goes to all executors. A second pass emits (SHA-256 of the line's key,
document) for the lines that the filter suspects; a distinct count confirms them exactly. A filter that is too
full only lets more lines through to the exact count.

Where the lines are too many for one filter, the hashes go to the filters: each range of hashes has its own two, in the task that owns it, and
hashes that are there already are suspects. The filter that goes to all executors then only holds these. The texts are read as often as
before but for one pass: to count lines, to hash them, to probe, and to rebuild the texts.
"""

from __future__ import annotations

import hashlib
import itertools
import zlib

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, functions as F, types as T

from clausegrid.llm.common import cut, map_columns, slices, texts_of, unused

MIN_CODE_POINTS, MIN_DOCUMENTS = 20, 3
#: Filter bits a line, and the limits of a filter's width in bits (powers of two). A task holds two filters.
BITS_A_LINE, MIN_BITS, MAX_BITS = 16, 1 << 20, 1 << 28
SEGMENT_WORDS = 1 << 12
#: Lines whose hashes a task hands over together, where there are several ranges.
HANDED = 1 << 20
#: Confirmed keys that are broadcast at most (40 bytes each), those in most documents; the others are joined by doc_id.
MAX_BROADCAST_KEYS = 200_000


def line_key(line: bytes) -> bytes:
    """ASCII white space stripped at both ends, A-Z lower-cased."""
    return line.strip().lower()


def long_enough(key: bytes, least: int) -> bool:
    return len(key) >= least and (key.isascii() or len(key.decode("utf-8", "replace")) >= least)


def document_keys(text: str, least: int) -> set[bytes]:
    """The distinct keys of a document that can be dropped."""
    return {k for x in text.encode().split(b"\n") if long_enough(k := line_key(x), least)}


def _words_and_masks(h: np.ndarray, n_words: int) -> tuple[np.ndarray, np.ndarray]:
    """Each hash owns four bits of one 64-bit word."""
    word = (h >> np.uint64(24)) & np.uint64(n_words - 1)
    mask = np.zeros(len(h), np.uint64)
    for k in range(4):
        mask |= np.uint64(1) << ((h >> np.uint64(6 * k)) & np.uint64(63))
    return word.astype(np.int64), mask


class TwoFilters:
    def __init__(self, n_bits: int):
        self.once, self.twice = np.zeros(n_bits // 64, np.uint64), np.zeros(n_bits // 64, np.uint64)

    def add(self, hashes: np.ndarray, again: np.ndarray | None = None) -> np.ndarray:
        """Gives the hashes that were there, or repeat, or are in `again`; each at most once."""
        h, n = np.unique(hashes, return_counts=True)
        w, m = _words_and_masks(h, len(self.once))
        seen = (n > 1) | ((self.once[w] & m) == m)
        if again is not None:
            seen |= np.isin(h, again)
        np.bitwise_or.at(self.twice, w[seen], m[seen])
        np.bitwise_or.at(self.once, w, m)
        return h[seen]

    def segments(self):
        for at in range(0, len(self.once), SEGMENT_WORDS):
            if self.once[at : at + SEGMENT_WORDS].any():
                yield at // SEGMENT_WORDS, zlib.compress(self.once[at : at + SEGMENT_WORDS].tobytes(), 1), zlib.compress(self.twice[at : at + SEGMENT_WORDS].tobytes(), 1)


def widths(n_lines: int, max_bits: int = MAX_BITS) -> tuple[int, int]:
    """(bits of a filter, ranges of hashes) for so many lines."""
    want = max(1, n_lines * BITS_A_LINE)
    ranges = -(-want // max_bits)
    return min(max_bits, max(MIN_BITS, 1 << (-(-want // ranges) - 1).bit_length())), ranges


def _hashes(texts: pa.Array, least: int) -> list[int]:
    return [xxhash.xxh3_64_intdigest(k) for t in texts_of(texts) for k in document_keys(t, least)]


def joined_filter(filled: DataFrame, n_bits: int) -> np.ndarray:
    """The words of the second filter of all tasks together; filled: segment, once, twice, compressed."""

    def join(batches):
        held: dict[int, list[np.ndarray]] = {}
        for batch in batches:
            for s, once, twice in zip(*(c.to_pylist() for c in batch.columns)):
                once, twice = (np.frombuffer(zlib.decompress(x), np.uint64) for x in (once, twice))
                if s in held:
                    was = held[s]
                    was[1] |= twice | (was[0] & once)
                    was[0] |= once
                else:
                    held[s] = [once.copy(), twice.copy()]
        found = [(s, zlib.compress(x[1].tobytes(), 1)) for s, x in held.items() if x[1].any()]
        if found:
            yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*found), (pa.int32(), pa.binary()))], names=["segment", "twice"])

    words = np.zeros(n_bits // 64, np.uint64)
    for row in filled.repartition("segment").mapInArrow(join, "segment int, twice binary").collect():  # n_bits in all
        at = row["segment"] * SEGMENT_WORDS
        words[at : at + SEGMENT_WORDS] = np.frombuffer(zlib.decompress(row["twice"]), np.uint64)
    return words


def _segments(f: TwoFilters):
    found = list(f.segments())
    if found:
        yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*found), (pa.int32(), pa.binary(), pa.binary()))], names=["segment", "once", "twice"])


def repeated_filter(docs: DataFrame, text: str, n_bits: int, least: int) -> np.ndarray:
    """The words of the filter of lines seen in two documents or more."""

    def fill(batches):
        f = TwoFilters(n_bits)
        for batch in batches:
            for x in slices(batch):
                f.add(np.array(_hashes(x.column(0), least), np.uint64))
        yield from _segments(f)

    return joined_filter(docs.select(text).mapInArrow(fill, "segment int, once binary, twice binary"), n_bits)


def repeated_hashes(docs: DataFrame, text: str, n_bits: int, ranges: int, least: int) -> DataFrame:
    """(h): hashes of lines that the filters of their range suspect of being in two documents or more; they may repeat.

    A task hands hashes over by range, those of HANDED lines together, each once and marked if it repeats among them: a line that many documents
    share is a few rows. A task holds the two filters of one range at a time.
    """

    def deal(batches):
        held: list[int] = []

        def out():
            h, n = np.unique(np.array(held, np.uint64), return_counts=True)
            held.clear()
            # the low bits choose a place in a filter and say nothing of the range
            part = ((h >> np.uint64(32)) % np.uint64(ranges)).astype(np.int64)
            order = np.argsort(part, kind="stable")
            h, n, part = h[order], n[order], part[order]
            at = np.flatnonzero(np.append(True, part[1:] != part[:-1])) if len(part) else np.zeros(0, np.int64)
            for a, b in zip(at.tolist(), [*at[1:].tolist(), len(part)]):
                yield int(part[a]), h[a:b].tobytes(), h[a:b][n[a:b] > 1].tobytes()

        def rows():
            for batch in batches:
                for x in slices(batch):
                    held.extend(_hashes(x.column(0), least))
                    if len(held) >= HANDED:
                        yield from out()
            yield from out()

        waiting = rows()
        while some := list(itertools.islice(waiting, 1024)):
            yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*some), (pa.int64(), pa.binary(), pa.binary()))], names=["part", "hashes", "again"])

    def scan(batches):
        here, f = None, None
        for batch in batches:
            for part, hashes, again in zip(*(c.to_pylist() for c in batch.columns)):
                if part != here:
                    here, f = part, TwoFilters(n_bits)
                found = f.add(*(np.frombuffer(x, np.uint64) for x in (hashes, again)))
                if len(found):
                    yield pa.RecordBatch.from_arrays([pa.array(found.view(np.int64))], names=["h"])

    dealt = docs.select(text).mapInArrow(deal, "part long, hashes binary, again binary")
    return dealt.repartition("part").sortWithinPartitions("part").mapInArrow(scan, "h long")


def filter_of(hashes: DataFrame, n_bits: int) -> np.ndarray:
    """The words of a filter of hashes (h)."""

    def fill(batches):
        f = TwoFilters(n_bits)
        for batch in batches:
            h = batch.column(0).to_numpy().view(np.uint64)
            f.add(h, h)
        yield from _segments(f)

    return joined_filter(hashes.mapInArrow(fill, "segment int, once binary, twice binary"), n_bits)


def suspected(docs: DataFrame, doc_id: str, text: str, least: int, max_bits: int) -> DataFrame:
    """(line_key, holder) of each line that a filter suspects of being in two documents or more."""
    spark = docs.sparkSession
    docs = docs.where(F.col(doc_id).isNotNull()).select(F.col(doc_id).cast("long").alias("holder"), F.col(text).alias("text"))
    n_bits, ranges = widths(docs.agg(F.sum(F.size(F.split(F.coalesce("text", F.lit("")), "\n")))).first()[0] or 0, max_bits)
    if ranges == 1:
        words = repeated_filter(docs, "text", n_bits, least)
    else:
        again = cut(repeated_hashes(docs, "text", n_bits, ranges, least).distinct())
        # suspects beyond what the widest filter tells apart only let more lines through
        words = filter_of(again, widths(again.count(), max_bits)[0])
    shared = spark.sparkContext.broadcast(words)

    def probe(batches):
        w = shared.value
        for batch in batches:
            for x in slices(batch):
                ids, keys = [], []
                for i, t in zip(x.column(0).to_pylist(), texts_of(x.column(1))):
                    own = list(document_keys(t, least))
                    keys += own
                    ids += [i] * len(own)
                if not keys:
                    continue
                at, mask = _words_and_masks(np.array([xxhash.xxh3_64_intdigest(k) for k in keys], np.uint64), len(w))
                hit = np.flatnonzero((w[at] & mask) == mask).tolist()
                yield pa.RecordBatch.from_arrays([pa.array([hashlib.sha256(keys[k]).digest() for k in hit], pa.binary()), pa.array([ids[k] for k in hit], pa.int64())], names=["line_key", "holder"])

    return docs.mapInArrow(probe, "line_key binary, holder long")


def dedup_lines(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", least: int = MIN_CODE_POINTS, documents: int = MIN_DOCUMENTS, max_broadcast_keys: int = MAX_BROADCAST_KEYS,
                max_bits: int = MAX_BITS) -> DataFrame:
    """Drops lines that many documents share, except in the largest doc_id that holds them.

    A line's key is the line without ASCII white space at both ends, with A-Z lower-cased. Keys of at
    least `least` code points in at least `documents` distinct doc_ids lose all their lines elsewhere;
    in the keeper all copies of the line stay. Returns the columns of docs with text replaced and
    n_lines, n_dropped (long) added; columns of these names are replaced, all others pass through whatever their names. Null text counts as one empty
    line and comes back empty; rows with a null doc_id neither count nor lose lines; ids are numbers or numbers as text (others are an error); rows that repeat a doc_id are
    one document for the count and each loses its lines; a very long text is one row of a slice of its own; an empty table gives an empty table.
    """
    spark = docs.sparkSession
    suspects = suspected(docs, doc_id, text, least, max_bits)
    counted = suspects.groupBy("line_key").agg(F.countDistinct("holder").alias("n"), F.max("holder").alias("keeper"))
    confirmed = cut(counted.where(F.col("n") >= documents))
    sizes = confirmed.agg(F.count("*").alias("keys"), F.sum("n").alias("rows")).first()
    # keys in so many documents that there cannot be more than max_broadcast_keys of them
    often = 0 if sizes["keys"] <= max_broadcast_keys else sizes["rows"] // max(1, max_broadcast_keys) + 1
    fields = [T.StructField(text, T.StringType()), T.StructField("n_lines", T.LongType()), T.StructField("n_dropped", T.LongType())]

    def rebuilt(texts, drop):
        out, n_lines, n_dropped = [], [], []
        for row, x in enumerate(texts):
            lines = x.encode().split(b"\n")
            kept = [y for y in lines if not (long_enough(k := line_key(y), least) and drop(row, hashlib.sha256(k).digest()))]
            out.append(x if len(kept) == len(lines) else b"\n".join(kept).decode())
            n_lines.append(len(lines))
            n_dropped.append(len(lines) - len(kept))
        return [out, n_lines, n_dropped]

    known = confirmed.where(F.col("n") >= often).select("line_key", "keeper").toArrow()  # at most max_broadcast_keys rows
    keepers = spark.sparkContext.broadcast(dict(zip(known.column("line_key").to_pylist(), known.column("keeper").to_pylist())))
    marked, lost, key = docs, *unused(docs, "lost", "key")
    if often:
        rest = confirmed.where(F.col("n") < often).select("line_key", "keeper")
        losses = suspects.join(rest, "line_key").where("holder <> keeper").groupBy(F.col("holder").alias(key)).agg(F.collect_set("line_key").alias(lost))
        marked = docs.join(losses, F.col(doc_id) == F.col(key), "left")

    def make():
        kept_in = keepers.value

        def f(ids, texts, *losses):
            ids = ids.to_pylist()
            own = [set(x or ()) for x in losses[0].to_pylist()] if losses else [()] * len(ids)
            return rebuilt(texts_of(texts), lambda row, k: ids[row] is not None and (kept_in.get(k, ids[row]) != ids[row] or k in own[row]))

        return f

    return map_columns(marked, [doc_id, text, *([lost] if often else [])], docs.columns, fields, make)
