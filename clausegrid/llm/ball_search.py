"""Exact top-k search by inner product: a ball tree for each shard, branch and bound, and a current kth score that shards share.

Vectors are scaled and floored to whole numbers, so scores are exact. Each vector belongs to the cell of its nearest pivot; a cell is a shard, or several of
bounded size if it is large. No vector of a cell scores more against a query than the query's product with the pivot plus its length times the
cell's radius, so each query has an order of shards. Queries go to them in waves: the first wave asks each query's most promising shard, and every later
one only the shards whose bound reaches the kth score found so far. A unit is a shard with a block of queries: it builds the shard's tree once and
searches it for each query, best bound first, until no node's bound reaches the kth score, its own or the one that came with the query.
"""

from __future__ import annotations

import heapq

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window as W, functions as F, types as T

from clausegrid.llm.common import cut, hash_bound, map_columns, release

SCALE, TOP = 256, 5
#: Vectors of a leaf; bytes of a shard and of all pivots at most; queries of a unit; shards that each wave but the last may add.
LEAF, SHARD_BYTES, PIVOT_BYTES, QUERIES, WAVES = 64, 16 << 20, 32 << 20, 4096, (1, 8)
#: Vectors of a shard at least, and bounds that are computed together.
LEAST_ROWS, _CELLS = 512, 1 << 20
#: What rounding may add to a bound, relative to its terms, many times over.
_SLACK = 1e-11
#: Stands for a null id, which comes last among ties.
_LAST = (1 << 63) - 1


def scaled(vectors: pa.Array, scale: int = SCALE) -> list[bytes | None]:
    """floor(scale * x) of each component as bytes of doubles; None for vectors that take no part."""
    out: list[bytes | None] = [None] * len(vectors)
    if not len(vectors):
        return out
    offsets, values = vectors.offsets.to_numpy().astype(np.int64), vectors.values
    with np.errstate(over="ignore", invalid="ignore"):
        x = np.floor(np.array(values.cast(pa.float64()).to_numpy(zero_copy_only=False), float) * scale) + 0.0
    x[np.asarray(values.is_null())] = np.nan
    finite = np.concatenate([[0], np.cumsum(~np.isfinite(x))])
    for k, known in enumerate(vectors.is_valid().to_pylist()):
        a, b = offsets[k], offsets[k + 1]
        if known and finite[a] == finite[b]:
            out[k] = x[a:b].tobytes()
    return out


class BallTree:
    """A ball tree over the rows of x; ids break ties. Nodes are in arrays: span, children (0: a leaf), centre, radius, least id."""

    def __init__(self, ids: np.ndarray, x: np.ndarray, leaf: int = LEAF):
        order, self.spans, self.children, centres, radii, least = np.arange(len(x)), [(0, len(x))], [(0, 0)], [], [], []
        todo = 0
        while todo < len(self.spans):
            lo, hi = self.spans[todo]
            own = x[order[lo:hi]]
            centre = own.mean(axis=0) if hi > lo else np.zeros(x.shape[1])
            away = np.sqrt(((own - centre) ** 2).sum(axis=1))
            centres.append(centre)
            radii.append(away.max(initial=0.0))
            least.append(int(ids[order[lo:hi]].min(initial=_LAST)))
            if hi - lo > leaf and radii[-1] > 0:
                # halves along the line through two far points
                a = own[away.argmax()]
                b = own[((own - a) ** 2).sum(axis=1).argmax()]
                middle = (hi - lo) // 2
                order[lo:hi] = order[lo:hi][np.argpartition(own @ (b - a), middle)]
                self.children[todo] = (len(self.spans), len(self.spans) + 1)
                self.spans += [(lo, lo + middle), (lo + middle, hi)]
                self.children += [(0, 0), (0, 0)]
            todo += 1
        self.ids, self.x = ids[order], x[order]
        self.centres, self.radii, self.least = np.array(centres), np.array(radii), least
        self.size, self.scored = np.sqrt((self.centres**2).sum(axis=1)), 0

    def bounds(self, queries: np.ndarray) -> np.ndarray:
        """(queries x nodes) the highest whole score that a node can hold."""
        return upper_bounds(queries, self.centres, self.radii, self.size)

    def search(self, query: np.ndarray, own: int, top: int, score: float, last: int, bounds: list[float]) -> list[tuple[float, int]]:
        """Up to `top` (score, -id), best first, that come before (score, last) and have another id than `own`."""
        best: list[tuple[float, int]] = []  # the worst first
        nodes = [(-bounds[0], 0)]
        while nodes:
            bound, node = heapq.heappop(nodes)
            if -bound < score:
                break
            if -bound == score and self.least[node] >= last:
                continue
            left, right = self.children[node]
            if left:
                heapq.heappush(nodes, (-bounds[left], left))
                heapq.heappush(nodes, (-bounds[right], right))
                continue
            lo, hi = self.spans[node]
            self.scored += hi - lo
            scores, ids = self.x[lo:hi] @ query, self.ids[lo:hi]
            some = np.flatnonzero((scores >= score) & (ids != own))
            if len(some) > top:
                some = some[np.lexsort((ids[some], -scores[some]))[:top]]
            for s, i in zip(scores[some].tolist(), ids[some].tolist()):
                if (s, -i) > (score, -last):
                    (heapq.heappush if len(best) < top else heapq.heappushpop)(best, (s, -i))
                    if len(best) == top:
                        score, last = best[0][0], -best[0][1]
        return sorted(best, reverse=True)


def upper_bounds(queries: np.ndarray, centres: np.ndarray, radii: np.ndarray, size: np.ndarray) -> np.ndarray:
    long = np.sqrt((queries**2).sum(axis=1))[:, None]
    return np.floor(queries @ centres.T + long * radii + _SLACK * long * (size + radii) + _SLACK)


class Cells:
    """The cells of one length of vectors: pivots, radii, least ids and the number of shards of each."""

    def __init__(self, pivots: np.ndarray, rows: list[tuple[int, int, float, int]], limit: int):
        rows = sorted(rows)
        self.cell = np.array([r[0] for r in rows])
        self.parts = np.array([-(-r[1] // limit) for r in rows])
        self.radii, self.least = np.array([r[2] for r in rows]), np.array([r[3] for r in rows])
        self.pivots = pivots[self.cell]
        self.size = np.sqrt((self.pivots**2).sum(axis=1))

    def shards(self, queries: np.ndarray, rows: np.ndarray, score: np.ndarray, last: np.ndarray, lo: int, hi: int | None):
        """(query, cell, part) from place lo to hi of each query's order of shards, without those that cannot reach its (score, last)."""
        bounds = upper_bounds(queries, self.pivots, self.radii, self.size)
        for k in range(len(queries)):
            order = np.argsort(-bounds[k], kind="stable")
            parts = self.parts[order]
            ends = np.cumsum(parts)
            stop = int(ends[-1]) if hi is None else min(hi, int(ends[-1]))
            for at in range(int(np.searchsorted(ends, lo, "right")), len(order)):
                cell, begin = order[at], int(ends[at] - parts[at])
                if begin >= stop or bounds[k, cell] < score[k]:
                    break
                if bounds[k, cell] == score[k] and self.least[cell] >= last[k]:
                    continue
                for place in range(max(lo, begin), min(stop, int(ends[at]))):
                    # parts of a cell are alike: each query begins with another one
                    yield k, int(self.cell[cell]), int((place - begin + rows[k]) % parts[at])


def _pivots(vectors: DataFrame, n: int, total: int) -> dict[int, np.ndarray]:
    """n vectors (PIVOT_BYTES at most), those with the smallest hashes of ids and components, by their length."""
    mark = F.xxhash64("vec_id", "whole")
    chosen = vectors.select("whole", mark.alias("mark")).where(F.col("mark") <= F.lit(hash_bound(n, total))).orderBy("mark", "whole").limit(n)
    out: dict[int, list] = {}
    for w in chosen.select("whole").toArrow().column(0).to_pylist():
        out.setdefault(len(w) // 8, []).append(np.frombuffer(w, float))
    return {k: np.array(v) for k, v in out.items()}


def _matrix(whole: pa.Array, rows: np.ndarray) -> np.ndarray:
    return np.frombuffer(b"".join(whole.take(pa.array(rows)).to_pylist()), float).reshape(len(rows), -1)


_ROW = ("dim", "cell", "part", "block", "side", "id", "q", "score", "last", "whole")
_ROW_TYPE = "dim int, cell int, part int, block int, side int, id long, q long, score double, last long, whole binary"


def _searched(batches, top: int):
    """Rows of units, a shard's vectors before its queries, to (q, vec_id, score)."""
    unit, held, tree = None, [], None
    for batch in batches:
        column = {c: batch.column(batch.schema.get_field_index(c)) for c in _ROW}
        dim, cell, part, block, side, ids, qs, score, last = (column[c].to_numpy(zero_copy_only=False) for c in _ROW[:9])
        key = np.stack([dim, cell, part, block, side])
        bounds = [0, *(np.flatnonzero((key[:, 1:] != key[:, :-1]).any(axis=0)) + 1).tolist(), len(dim)]
        out: list[tuple] = []
        for a, b in zip(bounds, bounds[1:]):
            if a == b:
                continue
            here = tuple(key[:4, a].tolist())
            if here != unit:
                unit, held, tree = here, [], None
            x = _matrix(column["whole"], np.arange(a, b)) if dim[a] else np.zeros((b - a, 0))
            if side[a] == 0:
                held.append((ids[a:b], x))
                continue
            if tree is None:
                tree = BallTree(np.concatenate([h[0] for h in held]), np.concatenate([h[1] for h in held]))
                held = []
            step = max(1, _CELLS // len(tree.spans))
            for at in range(0, b - a, step):
                some = x[at : at + step]
                for k, row in enumerate(tree.bounds(some).tolist()):
                    i = a + at + k
                    out += [(qs[i], -n, s) for s, n in tree.search(some[k], int(ids[i]), top, float(score[i]), int(last[i]), row)]
        if out:
            q, found, s = (np.array(c) for c in zip(*out))
            whole = np.clip(s, -(2.0**63), 2.0**63 - 1024).astype(np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(q.astype(np.int64)), pa.array(found.astype(np.int64), mask=found == _LAST), pa.array(whole)], names=["q", "vec_id", "score"])
    release()


def search(rows: DataFrame, asked: Column, vec_id: str = "vec_id", embedding: str = "embedding", top: int = TOP, scale: int = SCALE, shard: int | None = None, waves: tuple[int, ...] = WAVES) -> DataFrame:
    """query_id, rank, vec_id, score: the `top` highest inner products of each row that `asked` (a condition on vec_id) chooses, with all rows but its own.

    Components x count as floor(scale * x); scores are exact up to 2**53 and beyond that rounded, at most to the limits of a long. Vectors that are null or hold null or
    non-finite components (also after scaling) take no part, and vectors of different lengths never meet; empty ones score 0 with each other. Ties go
    to the smaller vec_id; null ids come last and are never queries. Rows that repeat a vec_id are candidates of their own, but not of each other, and
    each of them that is a query gets its rows. Queries without a candidate have no row. Other columns are not looked at, whatever their names.
    An empty table gives an empty table. shard: vectors of a shard at most; waves: shards that a query may go to in each wave before the last.
    """
    spark = rows.sparkSession
    named = rows.select(F.col(vec_id).cast("long").alias("vec_id"), F.col(embedding).cast("array<double>").alias("v"))

    def make():
        return lambda vectors: [scaled(vectors, scale)]

    vectors = cut(map_columns(named, ["v"], ["vec_id"], [T.StructField("whole", T.BinaryType())], make).where("whole is not null"))
    known = vectors.agg(F.count("*").alias("n"), F.max(F.octet_length("whole")).alias("bytes"), F.count_if(asked).alias("queries")).first()
    n, size = known["n"], max(8, known["bytes"] or 8)
    tasks = max(int(spark.conf.get("spark.sql.shuffle.partitions")), spark.sparkContext.defaultParallelism)
    shard = shard or max(1, min(SHARD_BYTES // size, max(LEAST_ROWS, -(-n // tasks))))
    pivots = max(1, min(PIVOT_BYTES // size, -(-2 * n // shard)))
    shared = spark.sparkContext.broadcast(_pivots(vectors, pivots, n))

    def place():
        p = shared.value
        sizes = {d: (x**2).sum(axis=1) for d, x in p.items()}

        def f(whole):
            dims = np.array([len(w) // 8 for w in whole.to_pylist()], np.int32)
            cell, away = np.zeros(len(dims), np.int32), np.zeros(len(dims))
            for dim in np.unique(dims).tolist():
                own = np.flatnonzero(dims == dim)
                centres = p.get(dim, np.zeros((1, dim)))
                step = max(1, _CELLS // len(centres))
                for some in np.split(own, range(step, len(own), step)):
                    x = _matrix(whole, some) if dim else np.zeros((len(some), 0))
                    cell[some] = (sizes.get(dim, 0.0) - 2 * (x @ centres.T)).argmin(axis=1)
                    away[some] = np.sqrt(((x - centres[cell[some]]) ** 2).sum(axis=1))
            return [pa.array(dims), pa.array(cell), pa.array(away)]

        return f

    fields = [T.StructField("dim", T.IntegerType()), T.StructField("cell", T.IntegerType()), T.StructField("away", T.DoubleType())]
    placed = cut(map_columns(vectors, ["whole"], ["vec_id", "whole"], fields, place))
    # one row a cell, which the pivots and the lengths of vectors bound
    cells = placed.groupBy("dim", "cell").agg(F.count("*").alias("n"), F.max("away").alias("far"), F.min(F.coalesce("vec_id", F.lit(_LAST))).alias("least")).collect()
    plans = {}
    for dim in {r["dim"] for r in cells}:
        own = [(r["cell"], r["n"], r["far"], r["least"]) for r in cells if r["dim"] == dim]
        plans[dim] = Cells(shared.value.get(dim, np.zeros((1, dim))), own, shard)
    sent = spark.sparkContext.broadcast(plans)
    parts = spark.createDataFrame([(r["dim"], r["cell"], -(-r["n"] // shard)) for r in cells], "dim int, cell int, parts int")
    members = placed.join(F.broadcast(parts), ["dim", "cell"])
    members = members.select("dim", "cell", F.pmod(F.xxhash64("vec_id", "whole"), F.col("parts")).cast("int").alias("part"), F.coalesce("vec_id", F.lit(_LAST)).alias("id"), "whole")
    blocks = max(1, -(-known["queries"] // QUERIES))
    queries = cut(placed.where(asked).select("dim", F.monotonically_increasing_id().alias("q"), F.col("vec_id").alias("id"), "whole"))

    def router(lo: int, hi: int | None):
        def run(batches):
            plans = sent.value
            step = max(1, min(1024, _CELLS // max((len(x.cell) for x in plans.values()), default=1)))
            for batch in batches:
                column = {c: batch.column(batch.schema.get_field_index(c)) for c in ("dim", "q", "id", "score", "last", "whole")}
                dims, qs, score, last = (column[c].to_numpy(zero_copy_only=False) for c in ("dim", "q", "score", "last"))
                for at in range(0, len(dims), step):
                    for dim in np.unique(dims[at : at + step]).tolist():
                        own = at + np.flatnonzero(dims[at : at + step] == dim)
                        x = _matrix(column["whole"], own) if dim else np.zeros((len(own), 0))
                        found = list(plans[dim].shards(x, qs[own], score[own], last[own], lo, hi))
                        for a in range(0, len(found), 4096):
                            k, cell, part = (np.array(c) for c in zip(*found[a : a + 4096]))
                            i, take = own[k], pa.array(own[k])
                            numbers = [np.full(len(k), dim), cell, part, qs[i] % blocks, np.ones(len(k))]
                            yield pa.RecordBatch.from_arrays([*(pa.array(c.astype(np.int32)) for c in numbers), column["id"].take(take), column["q"].take(take), column["score"].take(take), column["last"].take(take), column["whole"].take(take)], names=list(_ROW))

        return run

    best, unit = None, ["dim", "cell", "part", "block"]
    order = W.partitionBy("q").orderBy(F.desc("score"), F.asc_nulls_last("vec_id"))
    steps = np.cumsum([0, *waves]).tolist()
    for lo, hi in zip(steps, [*steps[1:], None]):
        todo = queries
        if best is None:
            todo = todo.withColumns({"score": F.lit(float("-inf")), "last": F.lit(_LAST)})
        else:
            kth = best.where(F.col("rank") == top).select("q", F.col("score").cast("double").alias("score"), F.coalesce("vec_id", F.lit(_LAST)).alias("last"))
            todo = todo.join(kth, "q", "left").na.fill({"score": float("-inf"), "last": _LAST})
        routed = cut(todo.select("dim", "q", "id", "score", "last", "whole").mapInArrow(router(lo, hi), _ROW_TYPE))
        shards = members.join(routed.select(*unit).distinct(), unit[:3])
        shards = shards.select(*unit, F.lit(0).alias("side"), "id", F.lit(0).cast("long").alias("q"), F.lit(0.0).alias("score"), F.lit(0).cast("long").alias("last"), "whole")
        units = shards.unionByName(routed).repartition(*unit).sortWithinPartitions(*unit, "side")
        found = units.mapInArrow(lambda b: _searched(b, top), "q long, vec_id long, score long")
        found = found if best is None else found.unionByName(best.drop("rank"))
        best = cut(found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= top))
    return best.join(queries.select("q", F.col("id").alias("query_id")), "q").select("query_id", "rank", "vec_id", "score")
