"""Shared pieces of the training-data operators: Arrow mapping, shared storage, hashing."""

from __future__ import annotations

import ctypes
import tempfile
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, types as T
from pyspark.sql.pandas.types import to_arrow_schema

#: Rows and bytes that one call of a mapped function sees at most (a single longer row comes alone).
SLICE_ROWS, SLICE_BYTES = 2048, 8 << 20


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_checkpoints(spark: SparkSession) -> str:
    """The folder of spark.checkpoint.dir; a local one is made only where the session names none and runs in one process."""
    sc = spark.sparkContext
    there = spark.conf.get("spark.checkpoint.dir", None) or sc.getCheckpointDir()
    if there is None:
        if not sc.master.split("[")[0] == "local":
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        there = tempfile.mkdtemp(prefix="clausegrid-")
    if sc.getCheckpointDir() is None:
        sc.setCheckpointDir(there)
    return there


def cut(df: DataFrame) -> DataFrame:
    """Computes df once and stores it in the shared checkpoint folder, so lost executors cost no recomputation."""
    shared_checkpoints(df.sparkSession)
    return df.checkpoint(eager=True)


class Rounds:
    """The result of an iteration's last round, stored in the shared folder; storing the next one deletes it."""

    def __init__(self, spark: SparkSession, name: str):
        self.spark, self.folder, self.n = spark, f"{shared_checkpoints(spark)}/{name}-{uuid.uuid4().hex}", 0

    def _delete(self, path: str, at_exit: bool) -> None:
        where = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
        files = where.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration())
        if at_exit:
            files.deleteOnExit(where)
        else:
            files.delete(where, True)

    def store(self, df: DataFrame) -> DataFrame:
        """Computes df once; what the round before stored is gone then, so nothing but df may have been made from it."""
        path = f"{self.folder}/{self.n}"
        df.write.parquet(path)
        if self.n:
            self._delete(f"{self.folder}/{self.n - 1}", False)
        else:
            self._delete(self.folder, True)
        self.n += 1
        return self.spark.read.schema(df.schema).parquet(path)


def without(df: DataFrame, names: list[str]) -> DataFrame:
    """Drops the columns that an operator is about to produce; names compare as Spark resolves them."""
    lowered = {n.lower() for n in names}
    return df.drop(*[c for c in df.columns if c.lower() in lowered])


def unused(df: DataFrame, *names: str) -> list[str]:
    """Names like these that no column of df has."""
    taken = {c.lower() for c in df.columns}
    out = []
    for n in names:
        while n.lower() in taken:
            n = f"_{n}"
        taken.add(n.lower())
        out.append(n)
    return out


def hash_bound(n: int, total: int) -> int:
    """A bound that the n smallest of `total` signed 64-bit hashes of distinct values do not pass; few more do not pass it either.

    Rows are filtered by it before they are sorted, so that no task gets more than it needs of a large table.
    """
    share = (n + 10 * n**0.5 + 100) / max(1, total)
    return (1 << 63) - 1 if share >= 1 else int(share * (1 << 64)) - (1 << 63)


def slices(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
    """Cuts a batch so that wide rows do not gather in one call."""
    per_row = max(1, batch.nbytes // max(1, batch.num_rows))
    step = max(1, min(SLICE_ROWS, SLICE_BYTES // per_row))
    for at in range(0, batch.num_rows, step):
        yield batch.slice(at, step)


def release() -> None:
    """Gives a finished task's memory back to the system; Python workers live on and would keep it."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (OSError, AttributeError):  # another C library
        return


def map_columns(df: DataFrame, inputs: list[str], keep: list[str], fields: list[T.StructField], make: Callable[[], Callable]) -> DataFrame:
    """Adds columns that a Python function computes from Arrow arrays.

    make() runs once per task and returns f(*input arrays) -> list of arrays or lists, one per field; f.close() ends the task, if there is one.
    keep: columns that pass through; a kept column named like a new one is replaced.
    """
    new = {f.name.lower() for f in fields}
    keep = [c for c in keep if c.lower() not in new]
    source = df.select(*dict.fromkeys([*keep, *inputs]))
    schema = T.StructType([*(source.schema[c] for c in keep), *fields])
    types = to_arrow_schema(T.StructType(fields))

    def run(batches):
        f = make()
        for batch in batches:
            for part in slices(batch):
                made = f(*(part.column(part.schema.get_field_index(c)) for c in inputs))
                made = [x if isinstance(x, (pa.Array, pa.ChunkedArray)) else pa.array(x, type=t) for x, t in zip(made, types.types)]
                yield pa.RecordBatch.from_arrays([*(part.column(part.schema.get_field_index(c)) for c in keep), *made], names=[*keep, *types.names])
        getattr(f, "close", bool)()
        del f
        release()

    return source.mapInArrow(run, schema)


def texts_of(array: pa.Array) -> list[str]:
    """Texts as str; null counts as empty."""
    return ["" if x is None else x for x in array.to_pylist()]


class Memo:
    """Remembers make's results for strings, at most about `limit` of them: two generations, the older is dropped.

    make_many takes the missing keys and returns their values, none of them None.
    """

    def __init__(self, make_many: Callable[[list], list], limit: int = 1_000_000):
        self.make_many, self.limit, self.young, self.old = make_many, max(2, limit), {}, {}

    def clear(self) -> None:
        self.young, self.old = {}, {}

    def many(self, keys: list) -> list:
        """The values of distinct keys."""
        got = list(map(self.young.get, keys))
        lost = [k for k, v in enumerate(got) if v is None]
        if lost:
            asked = [keys[k] for k in lost]
            found = list(map(self.old.get, asked))
            new = [k for k, v in enumerate(found) if v is None]
            for k, v in zip(new, self.make_many([asked[k] for k in new])):
                found[k] = v
            for k, v in zip(lost, found):
                got[k] = v
            self.young.update(zip(asked, found))
            if len(self.young) > self.limit // 2:
                self.old, self.young = self.young, {}
        return got


class Closing:
    """A function that forgets what a memo holds when its task ends: workers live on, and would keep it through all later steps."""

    def __init__(self, f: Callable, memo: Memo):
        self.f, self.close = f, memo.clear

    def __call__(self, *arrays) -> list:
        return self.f(*arrays)


#: Classes of bytes: letters, digits, punctuation but the apostrophe; 0 for all others.
_CLASS = np.array([0 if c < 33 or c > 126 or c == 39 else 1 if chr(c).isalpha() else 2 if chr(c).isdigit() else 3 for c in range(256)], np.uint8)


def class_edges(data: np.ndarray, digits_apart: bool) -> np.ndarray:
    """Where letters, digits and punctuation meet, as far as that is sure: ASCII and Latin-1 letters, not beside an apostrophe.

    digits_apart: also between two digits.
    """
    kind = _CLASS[data]
    lead = np.flatnonzero(data[:-1] == 0xC3)
    lead = lead[(data[lead + 1] != 0x97) & (data[lead + 1] != 0xB7)]
    kind[lead] = kind[lead + 1] = 1
    a, b = kind[:-1], kind[1:]
    edge = (a != b) | (b == 2) if digits_apart else a != b
    return np.flatnonzero(edge & (a > 0) & (b > 0)) + 1


def text_bytes(texts: pa.Array | list) -> tuple[np.ndarray, np.ndarray]:
    """(UTF-8 bytes of all texts, where each text begins and the last one ends); null counts as empty."""
    texts = pc.fill_null(pa.array(texts, pa.large_string()) if isinstance(texts, list) else texts.cast(pa.large_string()), "")
    if not len(texts):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    offsets = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1]
    data = np.frombuffer(texts.buffers()[2] or b"", np.uint8)[offsets[0] : offsets[-1]]
    return data, offsets - offsets[0]


def looked_up(memo: Memo, data: np.ndarray, offsets: np.ndarray, cuts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(values of all chunks joined, where each text's values begin and the last one's end), both in bytes.

    Chunks begin at cuts and at the texts' offsets. Each distinct chunk is looked up once, the others are gathered.
    """
    first = np.zeros(len(data) + 1, bool)
    first[cuts] = first[offsets] = True
    starts = np.flatnonzero(first[:-1])
    if not len(starts):
        return np.zeros(0, np.uint8), np.zeros(len(offsets), np.int64)
    chunks = pa.LargeStringArray.from_buffers(len(starts), pa.py_buffer(np.append(starts, len(data))), pa.py_buffer(np.ascontiguousarray(data)))
    coded = chunks.dictionary_encode()
    values = pa.array(memo.many(coded.dictionary.to_pylist()), pa.large_binary()).take(coded.indices)
    ends = np.frombuffer(values.buffers()[1], np.int64)[values.offset : values.offset + len(values) + 1]
    joined = np.frombuffer(values.buffers()[2] or b"", np.uint8)
    return joined[ends[0] : ends[-1]], (ends - ends[0])[np.searchsorted(starts, offsets)]


class Sparse:
    """Rows of feature numbers with values, for linear models."""

    def __init__(self, rows: list[np.ndarray], n_features: int, values: list[np.ndarray] | None = None):
        self.offsets = np.concatenate([[0], np.cumsum([len(r) for r in rows])]).astype(np.int64)
        self.at = np.concatenate([*rows, np.zeros(0, np.int64)]).astype(np.int64)
        self.values = np.concatenate([*values, np.zeros(0)]).astype(float) if values is not None else np.ones(len(self.at))
        self.row = np.repeat(np.arange(len(rows)), np.diff(self.offsets))
        self.shape = (len(rows), n_features)

    def times(self, w: np.ndarray) -> np.ndarray:
        return np.bincount(self.row, self.values * w[self.at], self.shape[0])

    def transposed_times(self, g: np.ndarray) -> np.ndarray:
        return np.bincount(self.at, self.values * g[self.row], self.shape[1])

    def take(self, rows: np.ndarray) -> "Sparse":
        cut = [slice(self.offsets[r], self.offsets[r + 1]) for r in rows.tolist()]
        return Sparse([self.at[c] for c in cut], self.shape[1], [self.values[c] for c in cut])


def sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -40, 40)))


def fit_logistic(x: Sparse, y: np.ndarray, dense: np.ndarray | None = None, l1: float = 1e-3, l2: float = 1e-4, steps: int = 120) -> tuple[np.ndarray, np.ndarray, float]:
    """Sparse logistic regression by accelerated proximal gradients: (weights, weights of the dense columns, bias).

    The mean loss plus l1 * |w| + l2/2 * w^2 over the sparse weights; dense columns carry l2 alone.
    """
    dense = np.zeros((x.shape[0], 0)) if dense is None else dense
    n, m, d = x.shape[0], x.shape[1], dense.shape[1]
    rate = float(np.clip(y.mean() if n else 0.0, 1e-4, 1 - 1e-4))
    w = np.concatenate([np.zeros(m + d), [np.log(rate / (1 - rate))]])
    if n == 0 or y.min() == y.max():
        return w[:m], w[m : m + d], float(w[-1])
    grams = np.bincount(x.row, x.values**2, n).mean() + 1 + (dense**2).sum(1).mean()
    size, look, t = 4 / max(1.0, grams**0.5), w.copy(), 1.0

    def loss(v):
        z = x.times(v[:m]) + dense @ v[m : m + d] + v[-1]
        return np.logaddexp(0, z).mean() - (y * z).mean() + l2 / 2 * (v[:-1] ** 2).sum(), z

    for _ in range(steps):
        here, z = loss(look)
        g = (sigmoid(z) - y) / n
        grad = np.concatenate([x.transposed_times(g), dense.T @ g, [g.sum()]])
        grad[:-1] += l2 * look[:-1]
        while True:
            new = look - size * grad
            new[:m] = np.sign(new[:m]) * np.maximum(0, np.abs(new[:m]) - size * l1)
            step = new - look
            if loss(new)[0] <= here + grad @ step + (step @ step) / (2 * size) + 1e-12 or size < 1e-6:
                break
            size /= 2
        after = (1 + (1 + 4 * t * t) ** 0.5) / 2
        look, w, t, size = new + (t - 1) / after * (new - w), new, after, size * 1.1
    return w[:m], w[m : m + d], float(w[-1])
