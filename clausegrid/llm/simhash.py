"""SimHash near-dedup: fingerprints are linked through a grid over their segment bit counts.

A fingerprint of 64 bits maps to the bit counts of its 16 segments of 4 bits. The Manhattan distance of two
such points never exceeds the Hamming distance of the fingerprints. Two points at Manhattan distance 2 or
less have a grid point within 1 of both, so each fingerprint goes to its own grid cell and to the cells one step
away (33 at most), and pairs that meet in a cell are verified by Hamming distance. The fingerprints of cells with more than
HOT_CELL of them go to the finest grid, of 64 segments of one bit: there the Manhattan distance is the Hamming distance, the cells
within a step are the 65 words within one bit, and all that meet in a cell are linked. Both grids are exact, and no cell is compared
pair by pair beyond HOT_CELL.

Near duplicates are either the components of these links (near_duplicates), or of all pairs of texts whose sets of shingles have a
Jaccard similarity of `least` or more (similar): such texts may be ten bits apart and more, where no grid tells them from
others, so the fingerprints give the first links, verified on the texts, and an exact join of shingles the others.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, functions as F, types as T

from clausegrid.llm import shingle_join
from clausegrid.llm.common import cut, map_columns, texts_of, unused
from clausegrid.llm.components import components, spanning

SHINGLE_WORDS, SEED, MAX_BITS_APART = 3, 42, 2
HOT_CELL = 1024
_BLOCK = 1 << 15


def fingerprint(text: str, width: int = SHINGLE_WORDS) -> int:
    """Signed 64-bit SimHash of the text's word shingles; 0 without words."""
    return _fingerprint(text.encode().lower().split(), width)


def _fingerprint(words: list[bytes], width: int) -> int:
    if not words:
        return 0
    joined = b" ".join(words)
    ends = np.cumsum([len(w) + 1 for w in words])
    starts = np.concatenate([[0], ends[:-1]])
    n = max(1, len(words) - width + 1)
    starts, ends = starts[:n].tolist(), (ends[min(width, len(words)) - 1 :] - 1).tolist()
    counts, digest = np.zeros(64, np.int64), xxhash.xxh64_intdigest
    for at in range(0, n, _BLOCK):
        h = np.array([digest(joined[s:e], SEED) for s, e in zip(starts[at : at + _BLOCK], ends[at : at + _BLOCK])], "<u8")
        counts += np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(counts * 2 > n, bitorder="little").view("<i8")[0])


def fingerprints(docs: DataFrame, text: str = "text", keep: list[str] | None = None, out: str = "fp", width: int = SHINGLE_WORDS) -> DataFrame:
    """Adds the fingerprint as a long; keep: columns that stay (all by default)."""

    def make():
        return lambda texts: [[fingerprint(x, width) for x in texts_of(texts)]]

    return map_columns(docs, [text], docs.columns if keep is None else keep, [T.StructField(out, T.LongType(), False)], make)


def _counts(fp: Column) -> Column:
    """The bit counts of the 16 segments, four bits each, in one long."""

    def half(x: Column) -> Column:
        x = x.bitwiseAND(F.lit(0x55555555)) + F.shiftrightunsigned(x, 1).bitwiseAND(F.lit(0x55555555))
        return x.bitwiseAND(F.lit(0x33333333)) + F.shiftrightunsigned(x, 2).bitwiseAND(F.lit(0x33333333))

    low, high = half(fp.bitwiseAND(F.lit(0xFFFFFFFF))), half(F.shiftrightunsigned(fp, 32))
    return F.shiftleft(high, 32).bitwiseOR(low)


def _cells(point: Column) -> Column:
    """The grid cells within one step of a point."""
    cells = [point]
    for k in range(0, 64, 4):
        here, step = F.shiftrightunsigned(point, k).bitwiseAND(F.lit(7)), F.lit(1 << k)
        cells += [F.when(here < 4, point + step), F.when(here > 0, point - step)]
    return F.filter(F.array(*cells), lambda x: x.isNotNull())


def links(reps: DataFrame, fp: str = "fp", hot_cell: int = HOT_CELL) -> DataFrame:
    """Edges (a, b) that join the distinct fingerprints of reps just as all pairs 2 or fewer bits apart would."""
    # fingerprints are few bytes and become 33 rows each: they are dealt out so that all tasks share that work. A hash of the
    # fingerprint, as dealing by the fingerprint itself would change nothing and be left out
    tasks = max(1, int(reps.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    dealt = cut(reps.select(fp).repartition(tasks, F.xxhash64(fp, F.lit(29))))
    placed = dealt.select(fp, F.explode(_cells(_counts(F.col(fp)))).alias("cell"))
    met = placed.groupBy("cell").agg(F.count("*").alias("n")).where("n > 1")
    members = cut(placed.join(met, "cell"))
    groups = members.where(F.col("n") <= hot_cell).groupBy("cell").agg(F.collect_list(fp).alias("fps"))

    def verify(batches):
        for batch in batches:
            found = [np.empty((2, 0), np.int64)]
            for fps in batch.column(0):
                x = fps.values.to_numpy(zero_copy_only=False).astype(np.int64).view(np.uint64)
                if len(x) == 2:
                    if int(x[0] ^ x[1]).bit_count() <= MAX_BITS_APART:
                        found.append(x.view(np.int64).reshape(2, 1))
                    continue
                i, j = np.nonzero(np.triu(np.bitwise_count(x[:, None] ^ x[None, :]) <= MAX_BITS_APART, 1))
                found.append(np.stack(spanning(x[i].view(np.int64), x[j].view(np.int64))))
            a, b = np.concatenate(found, axis=1)
            yield pa.RecordBatch.from_arrays([pa.array(a), pa.array(b)], names=["a", "b"])

    cold = groups.select("fps").mapInArrow(verify, "a long, b long")
    # the finest grid: two fingerprints within 2 bits of each other share a word within 1 bit of both
    near = F.array(F.col(fp), *[F.col(fp).bitwiseXOR(F.lit(1 << k if k < 63 else -(1 << 63))) for k in range(64)])
    hot = members.where(F.col("n") > hot_cell).select(fp).distinct().select(fp, F.explode(near).alias("word"))
    least = hot.groupBy("word").agg(F.min(fp).alias("a"), F.count("*").alias("n")).where("n > 1").select("word", "a")
    hot = hot.join(least, "word").where(F.col("a") != F.col(fp)).select("a", F.col(fp).alias("b"))
    return cold.unionByName(hot).distinct()


def near_duplicates(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", hot_cell: int = HOT_CELL, width: int = SHINGLE_WORDS) -> DataFrame:
    """doc_id, fingerprint (16 hex digits) and component_id (smallest doc_id reachable) for each row of docs.

    Fingerprints 2 or fewer bits apart are linked; equal ones always are. Null or empty texts have the
    fingerprint zero and are linked like any other. A null doc_id never is a component's id: a component of such rows
    alone has a null one. Repeated rows each get their row. Very long texts are hashed in blocks of shingles. Other columns are not
    returned, whatever their names. An empty table gives an empty table.
    """
    marked = cut(fingerprints(docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text")), "text", ["doc_id"], width=width))
    reps = marked.groupBy("fp").agg(F.min("doc_id").alias("rep"))
    joined = components(links(reps, hot_cell=hot_cell)).select(F.col("node").alias("fp"), "component")
    placed = reps.join(joined, "fp", "left").select("fp", "rep", F.coalesce("component", "fp").alias("component"))
    least = placed.groupBy("component").agg(F.min("rep").alias("component_id"))
    by_fp = placed.join(least, "component").select("fp", "component_id")
    return marked.join(by_fp, "fp").select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


def similar(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", width: int = shingle_join.SHINGLE_WORDS, least: float = shingle_join.LEAST_JACCARD,
            few: int = shingle_join.FEW, block: int = shingle_join.BLOCK) -> DataFrame:
    """doc_id and component_id (smallest doc_id reachable) for each row of docs.

    Texts whose sets of word shingles have the least similarity or more are linked, and equal ones; null and empty texts are equal.
    A null doc_id never is a component's id: a component of such rows alone has a null one. Repeated rows each get their row; a very long
    text's shingles are hashed one text at a time. Other columns are not returned, whatever their names. An empty table gives an empty table.
    """
    rows = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text"))

    def make():
        def f(texts):
            words = [shingle_join.words_of(x) for x in texts_of(texts)]
            return [[shingle_join.node_of(w) for w in words], [_fingerprint(w, width) for w in words]]

        return f

    marked = cut(map_columns(rows, ["text"], ["doc_id"], [T.StructField("node", T.LongType(), False), T.StructField("fp", T.LongType(), False)], make))
    by_fp = marked.groupBy("fp").agg(F.min("node").alias("least"))
    groups = components(links(by_fp)).select(F.col("node").alias("fp"), "component")
    placed = marked.select("node", "fp").distinct().join(groups, "fp", "left").withColumn("component", F.coalesce("component", "fp"))
    centres = placed.groupBy("component").agg(F.min("node").alias("a"))
    close = placed.join(centres, "component").where("node <> a").select("a", F.col("node").alias("b"))
    seeds = shingle_join.verified(close, rows, "text", width, least)
    joined = components(shingle_join.links(rows, "text", width, least, seeds, few, block))
    reps = marked.groupBy("node").agg(F.min("doc_id").alias("rep")).join(joined, "node", "left").withColumn("component", F.coalesce("component", "node"))
    ids = reps.groupBy("component").agg(F.min("rep").alias("component_id"))
    return marked.join(reps.join(ids, "component").select("node", "component_id"), "node").select("doc_id", "component_id")


def keep_one(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", width: int = SHINGLE_WORDS, least: float | None = None) -> DataFrame:
    """The rows of docs whose doc_id is the smallest of its component, and rows without a doc_id; all columns of docs stay as they are.

    least: link by this similarity of shingles (similar) and not by fingerprints alone (near_duplicates). Null and empty texts are one
    group. Repeated rows with the component's id all stay. An empty table gives an empty table.
    """
    found = near_duplicates(docs, doc_id, text, width=width) if least is None else similar(docs, doc_id, text, width, least)
    (gone,) = unused(docs, "gone")
    lost = found.where("doc_id <> component_id").select(F.col("doc_id").alias(gone)).distinct()
    return docs.join(lost, F.col(doc_id) == F.col(gone), "left_anti")
