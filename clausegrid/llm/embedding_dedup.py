"""Embedding near-dedup: an exact range join of unit vectors through pivots.

Cosine similarity c between unit vectors is the Euclidean distance sqrt(2 - 2c), a metric. Each distinct vector belongs
to the cell of its nearest pivot. A vector of p's cell can have a partner within radius r in q's cell only if the triangle
inequality allows it, that is, if its distance to q is at most its distance to p plus 2r and at most the cell's own radius plus r, and if
it is within r of the plane between the two cells. Pivots are in proportion to the vectors, up to PIVOT_BYTES. Neighbouring cells make
up blocks of bounded size; a large cell is several blocks. The join's units are pairs of blocks: a vector goes to the
pair of its own block and each block that has a cell within its reach, so both sides of a unit are
bounded, and in vectors with clusters most units stay empty. Pairs are counted in their task and never emitted: a task returns link counts
and a spanning set of links.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, functions as F, types as T

from clausegrid.llm.common import cut, hash_bound, map_columns
from clausegrid.llm.components import components, spanning

COSINE = 0.95
#: Vectors for each pivot; bytes of the pivots, which go to every task, and of a block, which a task holds, at most.
PIVOT_ROWS, PIVOT_BYTES, BLOCK_BYTES = 512, 64 << 20, 16 << 20
#: Cosines that are computed together.
_COSINES = 1 << 21
#: What single precision may lose on a cosine, many times over; pairs this close to the limit are computed in double.
_SLACK = 1e-4


def _unit(values: list) -> np.ndarray | None:
    """The vector in double precision at length one; None if it links with nothing."""
    if values is None or len(values) == 0 or None in values:
        return None
    x = np.array(values, float)
    top = np.abs(x).max()
    if not np.isfinite(top) or top == 0:
        return None
    x = x / top
    return x / math.sqrt(float(x @ x)) + 0.0  # no negative zeros: equal vectors have equal bytes


def distinct_vectors(rows: DataFrame, vec_id: str, embedding: str) -> tuple[DataFrame, DataFrame]:
    """(vec_id, hash of every row; hash null if it links with nothing), (hash, rep, vec_id, copies, unit) of each distinct vector.

    unit: the vector at length one, as bytes of doubles; rep: a number for it; vec_id: the smallest that it has.
    """
    ids = rows.select(F.col(vec_id).cast("long").alias("vec_id"), F.col(embedding).cast("array<double>").alias("v"))

    def make():
        def f(vectors):
            units = [_unit(v) for v in vectors.to_pylist()]
            return [[None if u is None else u.tobytes() for u in units]]

        return f

    units = map_columns(ids, ["v"], ["vec_id"], [T.StructField("unit", T.BinaryType())], make)
    marked = cut(units.withColumn("hash", F.sha2("unit", 256)))
    reps = marked.where("unit is not null").groupBy("hash").agg(F.min("vec_id").alias("vec_id"), F.count("*").alias("copies"), F.first("unit").alias("unit"))
    return marked.select("vec_id", "hash"), cut(reps.withColumn("rep", F.monotonically_increasing_id()))


def _pivots(reps: DataFrame, n: int, total: int) -> dict[int, np.ndarray]:
    """Pivot vectors by length of vector: the n of `total` vectors with the smallest hashes of their hashes; few more are sorted."""
    mark = F.xxhash64("hash")
    chosen = reps.where(mark <= F.lit(hash_bound(n, total))).orderBy(mark, "hash").limit(n).select("unit").collect()  # PIVOT_BYTES at most
    by_length: dict[int, list] = {}
    for r in chosen:
        u = np.frombuffer(r["unit"], float)
        by_length.setdefault(len(u), []).append(u)
    return {k: np.array(v) for k, v in by_length.items()}


def _distances(p: np.ndarray, u: np.ndarray) -> np.ndarray:
    return np.sqrt(np.maximum(0.0, 2 - 2 * (p @ u)))


class Blocks:
    """The blocks of one length of vectors: each cell's first block and their number, and the cells of each block."""

    def __init__(self, pivots: np.ndarray, sizes: dict[int, int], far: dict[int, float], rows: int):
        self.pivots, self.far = pivots, np.full(max(1, len(pivots)), -1.0)
        self.first, self.number = np.zeros(len(self.far), np.int64), np.ones(len(self.far), np.int64)
        for k, x in far.items():
            self.far[k] = x
        cells, filled = [], rows
        centres = pivots[: max(1, round(len(pivots) ** 0.5))]
        near = (pivots @ centres.T).argmax(axis=1) if len(pivots) else np.zeros(1, np.int64)
        for k in sorted(sizes, key=lambda k: (near[k], k)):
            if sizes[k] > rows:
                self.first[k], self.number[k], filled = len(cells), -(-sizes[k] // rows), rows
                cells += [[k]] * int(self.number[k])
                continue
            if filled + sizes[k] > rows:
                cells.append([])
                filled = 0
            self.first[k], filled = len(cells) - 1, filled + sizes[k]
            cells[-1].append(k)
        self.cells = np.array([k for c in cells for k in c], np.int64)
        self.starts = np.concatenate([[0], np.cumsum([len(c) for c in cells])])[:-1].astype(np.int64)

    def within(self, units: np.ndarray, home: np.ndarray, away: np.ndarray, reach: float) -> np.ndarray:
        """(vectors x blocks) whether a partner of the vector may be in the block."""
        if not len(self.pivots):
            return np.ones((len(units), len(self.starts)), bool)
        d = _distances(units, self.pivots.T)
        gap = _distances(self.pivots[home], self.pivots.T)
        beyond = (d**2 - (away**2)[:, None]) / (2 * np.maximum(gap, 1e-300))
        ok = (d <= away[:, None] + 2 * reach) & (d <= self.far[None, :] + reach) & ((gap <= 0) | (beyond <= reach))
        ok[np.arange(len(home)), home] = True
        return np.logical_or.reduceat(ok[:, self.cells], self.starts, axis=1)


_ROW = ("dim", "lo", "hi", "side", "rep", "copies", "unit")


def _joined(batches, limit: float):
    """Counts links within each unit of rows sorted by unit and side. Yields (rep, n, other)."""

    def compare(a_ids, a, a_copies, b_ids, b, b_copies, same: bool):
        """Links between two sides, or within one; counts for both and a spanning set."""
        found_a, found_b = np.zeros(len(a_ids), np.int64), np.zeros(len(b_ids), np.int64)
        edges, step, low = [np.empty((2, 0), np.int64)], max(1, _COSINES // max(1, len(a))), a.astype(np.float32).T
        for at in range(0, len(b_ids), step):
            part = b[at : at + step]
            close = part.astype(np.float32) @ low
            i, j = np.nonzero(close >= limit - _SLACK)
            if same:
                i, j = i[i + at < j], j[i + at < j]
            unsure = np.flatnonzero(close[i, j] < limit + _SLACK)
            ok = np.ones(len(i), bool)
            for lo in range(0, len(unsure), 4096):
                s = unsure[lo : lo + 4096]
                ok[s] = np.einsum("ij,ij->i", part[i[s]], a[j[s]]) >= limit
            i, j = i[ok], j[ok]
            np.add.at(found_b, i + at, a_copies[j])
            np.add.at(found_a, j, b_copies[i + at])
            edges.append(np.stack(spanning(b_ids[i + at], a_ids[j])))
        return found_a, found_b, *spanning(*np.concatenate(edges, axis=1))

    def rows(found_ids, found, a_id, b_id):
        at = np.flatnonzero(found)
        rep = np.concatenate([found_ids[at], a_id])
        n = np.concatenate([found[at], np.zeros(len(a_id), np.int64)])
        other = pa.array([None] * len(at), pa.int64())
        return pa.RecordBatch.from_arrays([pa.array(rep), pa.array(n), pa.concat_arrays([other, pa.array(b_id, pa.int64())])], names=["rep", "n", "other"])

    def side(parts):
        return tuple(np.concatenate(x) for x in zip(*parts))

    unit, held = None, ([], [])

    def settle():
        if unit is None or not held[0] or (unit[1] != unit[2] and not held[1]):
            return
        a = side(held[0])
        b = a if unit[1] == unit[2] else side(held[1])
        found_a, found_b, x, y = compare(*a, *b, unit[1] == unit[2])
        if unit[1] == unit[2]:
            yield rows(a[0], found_a + found_b, x, y)
        else:
            yield rows(np.concatenate([a[0], b[0]]), np.concatenate([found_a, found_b]), x, y)

    for batch in batches:
        dim, lo, hi, sides, rep, copies = (batch.column(batch.schema.get_field_index(c)).to_numpy() for c in _ROW[:6])
        units = batch.column(batch.schema.get_field_index("unit"))
        key = np.stack([dim, lo, hi, sides])
        bounds = [0, *(np.flatnonzero((key[:, 1:] != key[:, :-1]).any(axis=0)) + 1).tolist(), len(dim)]
        for a, b in zip(bounds, bounds[1:]):
            if a == b:
                continue
            here = (int(dim[a]), int(lo[a]), int(hi[a]))
            if here != unit:
                yield from settle()
                unit, held = here, ([], [])
            vectors = np.frombuffer(b"".join(units.slice(a, b - a).to_pylist()), float).reshape(b - a, -1)
            held[int(sides[a])].append((rep[a:b].astype(np.int64), vectors, copies[a:b].astype(np.int64)))
    yield from settle()


def range_links(reps: DataFrame, cosine: float = COSINE, block: int | None = None, pivots: int | None = None) -> DataFrame:
    """Rows (rep, n, other): n links of rep found in one task, counting copies of partners, or, with n = 0, a link to `other`.

    The links with `other` join the same vectors as all links do. reps: distinct unit vectors with hash, rep, copies, unit.
    block: vectors of a block; pivots: their number; both follow from the table's size by default.
    """
    reach = math.sqrt(max(0.0, 2 - 2 * cosine)) + 1e-7
    spark = reps.sparkSession
    known = reps.agg(F.count("*").alias("n"), F.max(F.octet_length("unit")).alias("bytes")).first()
    n, size = known["n"], max(8, known["bytes"] or 8)
    tasks = max(int(spark.conf.get("spark.sql.shuffle.partitions")), spark.sparkContext.defaultParallelism)
    # as many blocks as give each task a pair, and as memory asks for
    block = block or max(1, min(BLOCK_BYTES // size, max(1024, -(-n // math.ceil((2 * tasks) ** 0.5)))))
    pivots = pivots or max(1, min(PIVOT_BYTES // size, -(-n // PIVOT_ROWS)))
    shared = spark.sparkContext.broadcast(_pivots(reps, pivots, n))

    def place():
        p = shared.value

        def f(units):
            dims = pc.binary_length(units).to_numpy(zero_copy_only=False) // 8
            cell, away = np.zeros(len(dims), np.int32), np.zeros(len(dims))
            for dim in np.unique(dims).tolist():
                if dim not in p:
                    continue
                step = max(1, _COSINES // len(p[dim]))
                own = np.flatnonzero(dims == dim)
                for rows in np.split(own, range(step, len(own), step)):
                    d = _distances(np.frombuffer(b"".join(units.take(pa.array(rows)).to_pylist()), float).reshape(len(rows), -1), p[dim].T)
                    cell[rows] = d.argmin(axis=1)
                    away[rows] = d[np.arange(len(rows)), cell[rows]]
            return [pa.array(dims.astype(np.int32)), pa.array(cell), pa.array(away)]

        return f

    fields = [T.StructField("dim", T.IntegerType()), T.StructField("cell", T.IntegerType()), T.StructField("away", T.DoubleType())]
    placed = cut(map_columns(reps, ["unit"], ["rep", "copies", "unit"], fields, place))
    # one row a cell: (dim, cell) are bounded by the pivots and the lengths of vectors
    cells = placed.groupBy("dim", "cell").agg(F.count("*").alias("n"), F.max("away").alias("far")).collect()
    plans = {}
    for dim in {r["dim"] for r in cells}:
        own = [r for r in cells if r["dim"] == dim]
        plans[dim] = Blocks(shared.value.get(dim, np.zeros((0, dim))), {r["cell"]: r["n"] for r in own}, {r["cell"]: r["far"] for r in own}, block)
    sent = spark.sparkContext.broadcast(plans)

    def send(batches):
        plans = sent.value
        step = max(1, min(256, _COSINES // max((len(x.far) for x in plans.values()), default=1)))
        for batch in batches:
            dims = batch.column(0).to_numpy()
            for at in range(0, len(dims), step):
                for dim in np.unique(dims[at : at + step]).tolist():
                    plan, rows = plans[dim], at + np.flatnonzero(dims[at : at + step] == dim)
                    home, away, rep, copies, units = (batch.column(k).take(pa.array(rows)) for k in range(1, 6))
                    home, reps_ = home.to_numpy(), rep.to_numpy().astype(np.uint64)
                    spread = ((reps_ ^ (reps_ >> np.uint64(31))) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(20)
                    own = plan.first[home] + (spread % plan.number[home].astype(np.uint64)).astype(np.int64)
                    vectors = np.frombuffer(b"".join(units.to_pylist()), float).reshape(len(rows), -1)
                    ok = plan.within(vectors, home, away.to_numpy(), reach)
                    ok[np.arange(len(rows)), own] = True
                    i, j = np.nonzero(ok)
                    lo, hi = np.minimum(own[i], j), np.maximum(own[i], j)
                    take = pa.array(i)
                    columns = [pa.array(np.full(len(i), dim), pa.int32()), pa.array(lo, pa.int32()), pa.array(hi, pa.int32()), pa.array((own[i] > lo).astype(np.int32)), rep.take(take), copies.take(take), units.take(take)]
                    yield pa.RecordBatch.from_arrays(columns, names=list(_ROW))

    rows = placed.select("dim", "cell", "away", "rep", "copies", "unit").mapInArrow(send, "dim int, lo int, hi int, side int, rep long, copies long, unit binary")
    in_units = rows.repartition("dim", "lo", "hi").sortWithinPartitions("dim", "lo", "hi", "side")
    return in_units.mapInArrow(lambda b: _joined(b, cosine), "rep long, n long, other long")


def near_duplicates(rows: DataFrame, vec_id: str = "vec_id", embedding: str = "embedding", cosine: float = COSINE, block: int | None = None, pivots: int | None = None) -> DataFrame:
    """vec_id, n_links, component_id, kept for every row of rows.

    Vectors link if their cosine in double precision is at least `cosine`. Vectors that are null, empty, zero or hold
    null or non-finite components link with nothing, and vectors of different lengths never link; they are components
    of their own. Repeated vectors are compared once and counted as often as they occur. Rows that repeat a vec_id
    count as vectors of their own. Rows with a null vec_id link like all others, but a null never is the id of a component that has
    another; a component of such rows alone has a null one and they are kept. Other columns are not returned, whatever their names. An empty table
    gives an empty table.
    """
    marked, reps = distinct_vectors(rows, vec_id, embedding)
    found = cut(range_links(reps, cosine, block, pivots))
    counts = found.where("n > 0").groupBy("rep").agg(F.sum("n").alias("n"))
    joined = components(found.where("other is not null").select(F.col("rep").alias("a"), F.col("other").alias("b"))).withColumnRenamed("node", "rep")
    named = reps.select("hash", "rep", "vec_id", "copies").join(counts, "rep", "left").join(joined, "rep", "left").withColumn("component", F.coalesce("component", "rep"))
    ids = named.groupBy("component").agg(F.min("vec_id").alias("component_id"))
    by_hash = named.join(ids, "component").select("hash", (F.coalesce("n", F.lit(0)) + F.col("copies") - 1).alias("n_links"), "component_id")
    out = marked.join(by_hash, "hash", "left")
    out = out.select("vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), F.when(F.col("hash").isNull(), F.col("vec_id")).otherwise(F.col("component_id")).alias("component_id"))
    return out.withColumn("kept", F.col("vec_id").eqNullSafe(F.col("component_id")))
