"""The exact part of near-dedup by word shingles: every pair with a Jaccard similarity of `least` or more, without comparing all pairs.

Fingerprints at a few bits' distance (simhash) find the closest copies; this join finds the rest, so no link is lost.
Equal texts (lower-cased, white space as one space) are one node, whose id is a 64-bit hash. The distinct shingles of
a node are hashed and put in the order of their hashes, those common in a sample last (any order of all shingles is exact). Two sets
of a similarity of t or more that have n and m shingles share at least ceil(t * n) and ceil(t * m) of them, so the first
n - ceil(t * n) + l of the one and the first m - ceil(t * m) + l of the other share at least l (prefix filter), where l grows with the
smaller set. Only these shingles become rows. Nodes are first held against the least node of a shingle; shingles that only one
component has left are done, and so are nodes that have fewer shingles left than the smallest set similar to theirs asks for: a line of a licence that texts share does not
bring them together. In what remains, pairs of shingles with few nodes are counted and those that share l of them verified.
Shingles with many nodes go to tasks in blocks, and their nodes' 64-bit hashes once to each task. Sketches (the parity of the hashes in 8 bits a shingle or more)
bound the number of shingles that only one set has from below, pairs within the bound are compared by their hashes, and of the similar pairs a task only
gives as many as join the same nodes, so what leaves it grows with its nodes, not with their pairs. All that is linked is verified on the texts. As everywhere here
shingles count as equal if their 64-bit hashes are; only two shingles of one pair of texts that collide in all 64 bits (2^-64 a pair of shingles) could change a verdict.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window as W, functions as F, types as T

from clausegrid.llm.common import cut, hash_bound, map_columns, release, texts_of
from clausegrid.llm.components import components

SHINGLE_WORDS, LEAST_JACCARD = 5, 0.8
#: Shingles that two prefixes must share: SHARED and one of SHARED_OF of the set; candidate nodes that are broadcast at most.
SHARED, SHARED_OF, MAX_BROADCAST = 3, 16, 200_000
#: Documents of the sample, and how many different texts of it have a common shingle.
SAMPLE, COMMON = 2000, 3
#: Groups that the nodes of a common shingle are dealt into at first; nodes of a shingle up to which pairs are rows, and nodes of a block beyond it.
SALTS, FEW, BLOCK = 64, 16, 2048
#: Shingles of a block's nodes, about: their hashes are what a task holds.
BLOCK_SHINGLES = 1 << 21
#: Shingles of all units of a part, about: the most that its nodes have, if no two units share one.
PART_SHINGLES = 1 << 24
#: Bits of a sketch for each shingle, and 64-bit words at least and at most.
SKETCH_BITS, LEAST_WORDS, MOST_WORDS = 8, 2, 128
#: How often nodes are left out that share too few shingles with other components; each time leaves fewer shingles to share.
PRUNINGS = 3
_WORDS = 1 << 16


def words_of(text: str | None) -> list[bytes]:
    return (text or "").encode().lower().split()


def node_of(words: list[bytes]) -> int:
    h = xxhash.xxh3_64_intdigest(b" ".join(words))
    return h - (1 << 64) if h >> 63 else h


def shingles(words: list[bytes], width: int) -> set[bytes]:
    """The distinct shingles; fewer words than the width are one shingle, no words none."""
    if not words:
        return set()
    return {b" ".join(words[k : k + width]) for k in range(max(1, len(words) - width + 1))}


def jaccard(a: set, b: set) -> float:
    both = len(a & b)
    return both / (len(a) + len(b) - both) if a or b else 1.0


def least_common(n: int, least: float) -> int:
    """Shingles that a set of n has in common with any set of the least similarity or more."""
    return max(1, math.ceil(least * n - 1e-9))


def shared_by(n: int, least: float) -> int:
    """Shingles that the prefix of a set of n must share with a partner's; it never falls as n grows."""
    return min(SHARED + n // SHARED_OF, least_common(n, least))


def _shared_by(n: Column, least: float) -> Column:
    common = F.greatest(F.lit(1), F.ceil(n * F.lit(least) - 1e-9).cast("int"))
    return F.least(F.lit(SHARED) + F.floor(n / SHARED_OF).cast("int"), common)


class Hasher:
    """Sorted distinct 64-bit hashes of a text's shingles."""

    def __init__(self, width: int):
        self.width, self.known = width, {}
        self.factors = np.random.default_rng(17).integers(1, 1 << 63, width, dtype=np.uint64) * np.uint64(2) + np.uint64(1)

    def __call__(self, words: list[bytes]) -> np.ndarray:
        if not words:
            return np.zeros(0, np.uint64)
        if len(words) < self.width:
            return np.array([xxhash.xxh3_64_intdigest(b" ".join(words))], np.uint64)
        if len(self.known) > _WORDS:
            self.known.clear()
        known = self.known
        for w in set(words).difference(known):
            known[w] = xxhash.xxh3_64_intdigest(w)
        h = np.fromiter(map(known.__getitem__, words), np.uint64, len(words))
        n = len(words) - self.width + 1
        out = np.zeros(n, np.uint64)
        for k, f in enumerate(self.factors):
            out += h[k : k + n] * f
        out = (out ^ (out >> np.uint64(31))) * np.uint64(0x9E3779B97F4A7C15)
        return np.unique(out ^ (out >> np.uint64(29)))


def nodes(docs: DataFrame, text: str, keep: list[str]) -> DataFrame:
    """Adds the node of the text."""
    return map_columns(docs, [text], keep, [T.StructField("node", T.LongType(), False)], lambda: lambda texts: [[node_of(words_of(x)) for x in texts_of(texts)]])


def common_shingles(docs: DataFrame, text: str, width: int) -> np.ndarray:
    """Sorted hashes of the shingles that several texts of a bounded sample have; they only come later in the order."""

    def run(batches):
        hashes = Hasher(width)
        for batch in batches:
            for x in batch.column(0):
                yield pa.RecordBatch.from_arrays([pa.array(hashes(words_of(x.as_py())).view(np.int64))], names=["w"])
        del hashes
        release()

    mark = F.xxhash64(text, F.lit(5))
    some = docs.select(text).where(mark <= F.lit(hash_bound(SAMPLE, docs.count()))).distinct().orderBy(mark).limit(SAMPLE)
    # shingles are counted apart; those that are common are at most their number in the sample over COMMON
    found = some.mapInArrow(run, "w long").groupBy("w").agg(F.count("*").alias("n")).where(F.col("n") >= COMMON)
    return np.sort(found.select("w").toArrow().column("w").to_numpy().view(np.uint64))


def prefixes(docs: DataFrame, text: str, width: int, least: float, common: np.ndarray) -> DataFrame:
    """(node, size, w, often): the prefix shingles of every node, and whether they are common; rows repeat where texts do."""

    def run(batches):
        hashes, types = Hasher(width), (pa.int64(), pa.int32(), pa.int64(), pa.bool_())
        seen: set[int] = set()
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                out: list[list] = [[], [], [], []]
                for x in batch.column(0).slice(at, 256).to_pylist():
                    words = words_of(x)
                    node = node_of(words)
                    if not words or node in seen:
                        continue
                    if len(seen) < _WORDS:
                        seen.add(node)
                    h = hashes(words)
                    late = np.isin(h, common)
                    h, rare, n = np.concatenate([h[~late], h[late]]), int((~late).sum()), len(h)
                    w = h[: n - least_common(n, least) + shared_by(n, least)].view(np.int64)
                    for column, value in zip(out, (np.full(len(w), node), np.full(len(w), n), w, np.arange(len(w)) >= rare)):
                        column.append(value)
                if out[0]:
                    yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(c), t) for c, t in zip(out, types)], names=["node", "size", "w", "often"])
                del out
            del batch
        del hashes, seen
        release()

    return docs.select(text).mapInArrow(run, "node long, size int, w long, often boolean")


def promising(rows: DataFrame, least: float, prunings: int = PRUNINGS) -> DataFrame:
    """The rows (w, node, size, g) that a similar pair of different components can come from.

    Both nodes of such a pair have all shingles that their prefixes must share, in rows of more than one component. The partner of a set of n has ceil(least * n)
    shingles or more, so a node with fewer such rows than that size asks for has no partner. The nodes left out may have been all of a shingle's other component.
    """
    smallest = F.greatest(F.lit(1), F.ceil(F.col("size") * F.lit(least) - 1e-9).cast("int"))
    for _ in range(prunings):
        mixed = rows.groupBy("w").agg(F.min("g").alias("x"), F.max("g").alias("y")).where("x <> y").select("w")
        rows = cut(rows.join(mixed, "w", "left_semi"))
        able = rows.groupBy("node").agg(F.count("*").alias("n"), F.first("size").alias("size")).where(F.col("n") >= _shared_by(smallest, least)).select("node")
        rows = cut(rows.join(able, "node", "left_semi"))
    return rows


def texts_of_nodes(asked: DataFrame, docs: DataFrame, text: str) -> DataFrame:
    """(node, text), one text of each node of `asked`."""
    asked = cut(asked.select("node").distinct())
    if asked.count() <= MAX_BROADCAST:
        asked = F.broadcast(asked)
    return nodes(docs, text, [text]).join(asked, "node", "left_semi").dropDuplicates(["node"]).select("node", F.col(text).alias("text"))


def verified(pairs: DataFrame, docs: DataFrame, text: str, width: int, least: float) -> DataFrame:
    """The pairs (a, b) whose texts have the least similarity or more."""
    pairs = cut(pairs.select("a", "b").distinct())
    texts = cut(texts_of_nodes(pairs.select(F.col("a").alias("node")).unionByName(pairs.select(F.col("b").alias("node"))), docs, text))
    both = pairs.join(texts.select(F.col("node").alias("a"), F.col("text").alias("x")), "a").join(texts.select(F.col("node").alias("b"), F.col("text").alias("y")), "b")

    def run(batches):
        for batch in batches:
            known: dict[int, set] = {}

            def of(node, value):
                if node not in known:
                    if len(known) > 64:
                        known.clear()
                    known[node] = shingles(words_of(value.as_py()), width)
                return known[node]

            a, b, x, y = (batch.column(batch.schema.get_field_index(c)) for c in ("a", "b", "x", "y"))
            ok = [jaccard(of(i, p), of(j, q)) >= least - 1e-12 for i, j, p, q in zip(a.to_pylist(), b.to_pylist(), x, y)]
            yield pa.RecordBatch.from_arrays([a, b], names=["a", "b"]).filter(pa.array(ok, pa.bool_()))
            del batch, a, b, x, y, ok, known
        release()

    return cut(both.select("a", "b", "x", "y").mapInArrow(run, "a long, b long"))


def sketch(hashes: np.ndarray) -> np.ndarray:
    """The parity of the hashes that fall on each bit. Two sketches differ in no more bits than the sets do in hashes."""
    words = min(MOST_WORDS, max(LEAST_WORDS, 1 << (max(1, SKETCH_BITS * len(hashes) // 64) - 1).bit_length()))
    bits = np.bincount(hashes.astype(np.int64) & (64 * words - 1), minlength=64 * words) & 1
    return np.packbits(bits.astype(bool), bitorder="little").view("<u8")


def fold(sketches: np.ndarray, words: int) -> np.ndarray:
    """The same sketches with fewer words."""
    return np.bitwise_xor.reduce(sketches.reshape(len(sketches), -1, words), axis=1)


def apart(n: np.ndarray, m: np.ndarray, least: float) -> np.ndarray:
    """Shingles that only one of two similar sets of these sizes has, at most."""
    return np.floor((n + m) * (1 - least) / (1 + least) + 1e-9).astype(np.int64)


def similar_by_hashes(a: np.ndarray, b: np.ndarray, least: float) -> bool:
    """Whether two sorted arrays of distinct hashes have the least similarity or more."""
    both = len(np.intersect1d(a, b, assume_unique=True))
    return both >= (least - 1e-12) * (len(a) + len(b) - both)


def near_pairs(node: np.ndarray, group: np.ndarray, side: np.ndarray, hashes: list[np.ndarray], both: bool, least: float) -> np.ndarray:
    """(2, n) links that join what all similar pairs of different groups join; both: only pairs of different sides.

    Pairs of groups that are already joined here are not looked at again.
    """
    size = np.array([len(x) for x in hashes], np.int64)
    sketches = [sketch(x) for x in hashes]
    words, found = np.array([len(x) for x in sketches]), []
    number = np.unique(group, return_inverse=True)[1]
    joined = list(range(int(number.max()) + 1))

    def root(k: int) -> int:
        while joined[k] != k:
            joined[k] = joined[joined[k]]
            k = joined[k]
        return k

    for w in np.unique(words).tolist():
        # a set and one of no fewer words
        ours = np.flatnonzero(words == w)
        parts = [np.flatnonzero(words == v) for v in np.unique(words[words >= w]).tolist()]
        theirs = np.concatenate(parts)
        a, b = np.array([sketches[k] for k in ours]), np.concatenate([fold(np.array([sketches[k] for k in p]), w) for p in parts])
        a2, b2 = fold(a, LEAST_WORDS), fold(b, LEAST_WORDS)
        for at in range(0, len(ours), 256):
            i = ours[at : at + 256]
            roots = np.array([root(k) for k in range(len(joined))])[number]
            limit = apart(size[i][:, None], size[theirs][None, :], least)
            ok = (roots[i][:, None] != roots[theirs][None, :]) & ((words[theirs] > w)[None, :] | (i[:, None] < theirs[None, :]))
            if both:
                ok &= side[i][:, None] != side[theirs][None, :]
            ok &= np.abs(size[i][:, None] - size[theirs][None, :]) <= limit
            differ = np.zeros(ok.shape, np.uint8)
            for k in range(LEAST_WORDS):
                differ += np.bitwise_count(a2[at : at + 256, k][:, None] ^ b2[:, k][None, :])
            x, y = np.nonzero(ok & (differ <= limit))
            near = np.bitwise_count(a[at + x] ^ b[y]).sum(axis=1, dtype=np.int64) <= limit[x, y]
            for p, q in zip(i[x[near]].tolist(), theirs[y[near]].tolist()):
                m, n = root(int(number[p])), root(int(number[q]))
                if m != n and similar_by_hashes(hashes[p], hashes[q], least):
                    joined[m] = n
                    found.append((node[p], node[q]))
    return np.sort(np.array(found, np.int64).reshape(-1, 2), axis=1).T


def in_blocks(rows: DataFrame, docs: DataFrame, text: str, width: int, least: float, block: int) -> DataFrame:
    """Links (a, b) that join what all similar pairs of different groups that share a shingle join. rows: w, node, g, n, total and least (of the shingle its nodes, their sizes' sum, and the least)."""
    hashed = [T.StructField("hashes", T.BinaryType(), False)]

    def make():
        hashes = Hasher(width)
        return lambda texts: [[hashes(words_of(x)).astype("<u8").tobytes() for x in texts_of(texts)]]

    sets = map_columns(texts_of_nodes(rows, docs, text), ["text"], ["node"], hashed, make)
    dealt = rows.withColumn("blocks", F.greatest(F.ceil(F.col("n") / block), F.ceil(F.col("total") / BLOCK_SHINGLES)).cast("int")).withColumn("own", F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int"))
    # units go to parts; a part gets the hashes of each of its nodes once, however many of its shingles the node has. Shingles with the same least node are
    # mostly those of the same texts: they go to the same part, block by block
    parts = max(1, -(-(dealt.agg(F.sum(F.col("size") * F.col("blocks"))).first()[0] or 0) // PART_SHINGLES))
    units = dealt.select("w", "least", "node", "g", "own", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("other"))
    units = units.select("w", "least", F.least("own", "other").alias("lo"), F.greatest("own", "other").alias("hi"), "node", "g", "own")
    units = cut(units.withColumn("part", F.pmod(F.xxhash64("least", "lo", "hi"), F.lit(parts))).drop("least"))
    none = {c: F.lit(None).cast("int" if c in ("lo", "hi", "own") else "long") for c in ("w", "lo", "hi", "g", "own")}
    asked = cut(units.select("part", "node").distinct())
    asked = F.broadcast(asked) if asked.count() <= MAX_BROADCAST else asked
    heads = sets.join(asked, "node").select("part", F.lit(0).alias("kind"), "node", "hashes").withColumns(none)
    every = heads.unionByName(units.withColumns({"kind": F.lit(1), "hashes": F.lit(None).cast("binary")}))

    def run(batches):
        held: list[tuple] = []
        known: dict[int, np.ndarray] = {}
        part = unit = None

        def settle():
            # unit: part, w, lo, hi
            if len(held) < 2:
                return None
            node, g, own = (np.array(c, np.int64) for c in zip(*held))
            a, b = near_pairs(node, g, own, [known[k] for k in node.tolist()], unit[2] != unit[3], least)
            return pa.RecordBatch.from_arrays([pa.array(a), pa.array(b)], names=["a", "b"]) if len(a) else None

        for batch in batches:
            for p, kind, w, lo, hi, *row, hashes in zip(*(batch.column(batch.schema.get_field_index(c)).to_pylist() for c in ("part", "kind", "w", "lo", "hi", "node", "g", "own", "hashes"))):
                if (p, w, lo, hi) != unit:
                    if (found := settle()) is not None:
                        yield found
                    unit, held = (p, w, lo, hi), []
                if p != part:
                    part, known = p, {}
                if kind == 0:
                    known[row[0]] = np.frombuffer(hashes, "<u8")
                else:
                    held.append(row)
        if (found := settle()) is not None:
            yield found
        release()

    return every.repartition("part").sortWithinPartitions("part", "kind", "w", "lo", "hi").mapInArrow(run, "a long, b long").distinct()


def links(docs: DataFrame, text: str = "text", width: int = SHINGLE_WORDS, least: float = LEAST_JACCARD, seeds: DataFrame | None = None, few: int = FEW, block: int = BLOCK) -> DataFrame:
    """Edges (a, b) that join the nodes of docs just as all pairs of the least similarity or more would.

    seeds: such edges that are already known. Shingles of up to `few` nodes are compared as rows, others in blocks of `block` nodes.
    """
    # nodes of a common shingle are dealt into SALTS groups, each with its own least node
    salt = F.when(F.col("often"), F.pmod(F.xxhash64("node"), F.lit(SALTS))).otherwise(0).cast("int")
    placed = prefixes(docs, text, width, least, common_shingles(docs, text, width)).withColumn("salt", salt)
    alike = W.partitionBy("w", "salt")
    placed = placed.withColumn("a", F.min("node").over(alike)).withColumn("z", F.max("node").over(alike))
    members = cut(placed.where("often or a <> z").select("w", "salt", "node", "size", "a").distinct())

    def grouped(rows: DataFrame, found: DataFrame | None) -> DataFrame:
        """Adds the component of the links found so far."""
        if found is None:
            return rows.withColumn("g", F.col("node"))
        return rows.join(components(found).withColumnRenamed("component", "g"), "node", "left").withColumn("g", F.coalesce("g", "node"))

    def candidates(rows: DataFrame) -> DataFrame:
        """Pairs that share enough of their prefixes. rows: a, b, size, size2, one for each shared shingle."""
        fits = rows.where(F.least("size", "size2") >= F.greatest("size", "size2") * (least - 1e-9))
        return fits.groupBy("a", "b").agg(F.count("*").alias("n"), F.first(F.least("size", "size2")).alias("size")).where(F.col("n") >= _shared_by(F.col("size"), least))

    known = grouped(members, seeds)
    first = known.where("node = a").select("w", "salt", F.col("size").alias("size2"), F.col("g").alias("g2"))
    stars = known.where("node <> a").join(first, ["w", "salt"]).where("g <> g2").select("a", F.col("node").alias("b"), "size", "size2")
    found = verified(candidates(stars), docs, text, width, least)
    found = found if seeds is None else found.unionByName(seeds.select("a", "b"))
    rows = promising(grouped(members.select("w", "node", "size"), found), least)
    mixed = rows.groupBy("w").agg(F.min("g").alias("x"), F.max("g").alias("y"), F.count("*").alias("n"), F.sum("size").alias("total"), F.min("node").alias("least")).where("x <> y").select("w", "n", "total", "least")
    rows = cut(rows.join(mixed, "w"))
    left = rows.where(F.col("n") <= few).select("w", F.col("node").alias("a"), "size", "g")
    right = rows.where(F.col("n") <= few).select("w", F.col("node").alias("b"), F.col("size").alias("size2"), F.col("g").alias("g2"))
    pairs = candidates(left.join(right, "w").where((F.col("a") < F.col("b")) & (F.col("g") != F.col("g2")))).select("a", "b")
    many = rows.where(F.col("n") > few)
    if not many.isEmpty():
        pairs = pairs.unionByName(in_blocks(many, docs, text, width, least, block))
    return found.unionByName(verified(pairs, docs, text, width, least))
