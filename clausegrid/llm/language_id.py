"""Language identification: sparse multinomial logistic regression on TF-IDF character n-grams.

Texts are lower-cased, everything but letters becomes a space, and the n-grams of 1 to 3 characters are
hashed into BUCKETS. Document frequencies are counted over all documents to learn from, in segments that
are summed apart. The weights are learned by follow-the-regularised-leader with elastic-net penalties on a bounded
sample (the same number of every language as far as it has them, those with the smallest hashed ids: SAMPLE documents
in all, or LEAST_OF_A_LANGUAGE of each if that is more, so it grows with the number of languages), of which only the counts travel to the driver. A part of the sample is kept out of the fit and
gives the temperature that the scores are divided by.
"""

from __future__ import annotations

import sys

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window as W, functions as F, types as T

from clausegrid.llm.common import hash_bound, map_columns, release, slices, texts_of

BUCKETS_LOG2 = 16
BUCKETS = 1 << BUCKETS_LOG2
LONGEST_GRAM = 3
#: Documents in the fit, all languages together, and at least for each language (if it has them), however many there are.
SAMPLE, LEAST_OF_A_LANGUAGE = 2400, 20
EPOCHS, ALPHA, BETA, L1, L2 = 3, 0.5, 1.0, 0.02, 0.01
UNKNOWN = "und"
_SEGMENT = 4096
_BLOCK = 1 << 18


def _letters() -> np.ndarray:
    table = np.zeros(sys.maxunicode + 1, bool)
    table[[c for c in range(0x32400) if chr(c).isalpha()]] = True
    return table


_LETTERS: list[np.ndarray] = []


def grams(text: str) -> tuple[np.ndarray, int]:
    """(counts by bucket, n-grams) of a whole text; no letters: nothing is counted."""
    if not _LETTERS:
        _LETTERS.append(_letters())
    counts = np.zeros(BUCKETS, np.int64)
    codes = np.frombuffer(text.lower().encode("utf-32-le", "surrogatepass"), "<u4")
    letter = _LETTERS[0][codes]
    if not letter.any():
        return counts, 0
    codes = np.concatenate([[32], np.where(letter, codes, 32), [32]]).astype(np.uint64)
    codes = codes[np.concatenate([[True], (codes[1:] != 32) | (codes[:-1] != 32)])]
    total = 0
    for at in range(0, len(codes), _BLOCK):
        part = codes[at : at + _BLOCK + LONGEST_GRAM - 1]
        key = np.zeros(len(part), np.uint64)
        for n in range(1, LONGEST_GRAM + 1):
            key = key[: len(part) - n + 1] * np.uint64(0x100000001B3) + part[n - 1 :] + np.uint64(n)
            own = key[: min(len(key), _BLOCK)]
            hashed = (own * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - BUCKETS_LOG2)
            counts += np.bincount(hashed.astype(np.int64), minlength=BUCKETS)
            total += len(own)
    return counts, total


class Model:
    def __init__(self, languages: list[str], idf: np.ndarray, weights: np.ndarray, bias: np.ndarray, temperature: float):
        self.languages, self.idf, self.weights, self.bias, self.temperature = languages, idf, weights, bias, temperature

    def predict(self, text: str | None) -> tuple[str, float]:
        counts, total = grams(text or "")
        if not total or not self.languages:
            return UNKNOWN, 0.0
        at = np.flatnonzero(counts)
        x = tf_idf(counts[at], self.idf[at])
        p = softmax((x @ self.weights[at] + self.bias) / self.temperature)
        best = int(p.argmax())
        return self.languages[best], float(p[best])


def tf_idf(counts: np.ndarray, idf: np.ndarray) -> np.ndarray:
    x = np.log1p(counts) * idf
    return x / max(1e-12, float(np.sqrt(x @ x)))


def softmax(z: np.ndarray) -> np.ndarray:
    e = np.exp(z - z.max(axis=-1, keepdims=True))
    return e / e.sum(axis=-1, keepdims=True)


class Ftrl:
    """Follow-the-regularised-leader, proximal, for softmax regression over sparse rows."""

    def __init__(self, n_features: int, n_classes: int, alpha: float = ALPHA, beta: float = BETA, l1: float = L1, l2: float = L2):
        self.z, self.n = np.zeros((n_features + 1, n_classes)), np.zeros((n_features + 1, n_classes))
        self.alpha, self.beta, self.l1, self.l2 = alpha, beta, l1, l2

    def weights(self, at: np.ndarray | slice = slice(None)) -> np.ndarray:
        z, n = self.z[at], self.n[at]
        return np.where(np.abs(z) <= self.l1, 0.0, (np.sign(z) * self.l1 - z) / ((self.beta + np.sqrt(n)) / self.alpha + self.l2))

    def learn(self, at: np.ndarray, x: np.ndarray, y: int) -> None:
        """One row; the last feature is the bias."""
        at, x = np.append(at, len(self.z) - 1), np.append(x, 1.0)
        w = self.weights(at)
        g = softmax(x @ w)
        g[y] -= 1
        g = np.outer(x, g)
        more = self.n[at] + g * g
        self.z[at] += g - (np.sqrt(more) - np.sqrt(self.n[at])) / self.alpha * w
        self.n[at] = more


def temperature(z: np.ndarray, y: np.ndarray) -> float:
    """The divisor of scores with the smallest log loss, from a fixed grid."""
    if not len(y):
        return 1.0
    tried = np.geomspace(0.25, 20, 121)
    return float(min(tried, key=lambda t: -np.log(np.maximum(1e-12, softmax(z / t)[np.arange(len(y)), y])).mean()))


def learnable(doc_id: str, text: str, lang: str) -> Column:
    """Rows to learn from: text, language and doc_id are there and the remainder is not the held-out one."""
    return F.col(text).isNotNull() & F.col(lang).isNotNull() & F.coalesce(remainder(doc_id) != 1, F.lit(False))


def remainder(doc_id: str) -> Column:
    return F.crc32(F.col(doc_id).cast("string").cast("binary")) % 3


def document_frequencies(docs: DataFrame, text: str) -> tuple[np.ndarray, int]:
    """(documents that have each bucket, documents) over all of docs."""

    def count(batches):
        df, n = np.zeros(BUCKETS, np.int64), 0
        for batch in batches:
            for part in slices(batch):
                for x in texts_of(part.column(0)):
                    df += grams(x)[0] > 0
                    n += 1
        if n:
            found = [(k, df[k * _SEGMENT : (k + 1) * _SEGMENT].tobytes()) for k in range(BUCKETS // _SEGMENT)] + [(-1, np.array([n]).tobytes())]
            yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*found), (pa.int32(), pa.binary()))], names=["segment", "counts"])

    def add(batches):
        held: dict[int, np.ndarray] = {}
        for batch in batches:
            for s, x in zip(*(c.to_pylist() for c in batch.columns)):
                held[s] = held.get(s, 0) + np.frombuffer(x, np.int64)
        if held:
            yield pa.RecordBatch.from_arrays([pa.array(list(held), pa.int32()), pa.array([x.tobytes() for x in held.values()], pa.binary())], names=["segment", "counts"])

    schema = "segment int, counts binary"
    df, n = np.zeros(BUCKETS, np.int64), 0
    for r in docs.select(text).mapInArrow(count, schema).repartition("segment").mapInArrow(add, schema).collect():
        x = np.frombuffer(r["counts"], np.int64)
        if r["segment"] < 0:
            n = int(x[0])
        else:
            df[r["segment"] * _SEGMENT : (r["segment"] + 1) * _SEGMENT] = x
    return df, n


def train(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", lang: str = "lang", sample: int = SAMPLE) -> Model:
    """Learns from the rows of docs, whose remainder is not looked at here; give it the learnable ones.

    Rows without a language are not learned from, but count for document frequencies. One text of a doc_id that repeats with the same language
    is used. Texts without letters teach nothing. From an empty table comes a model that knows no language.
    """
    rows = docs.where(F.col(lang).isNotNull()).select(F.col(doc_id).alias("id"), F.col(lang).alias("lang"), F.col(text).alias("text"))
    sizes = {r["lang"]: r["n"] for r in rows.groupBy("lang").agg(F.count("*").alias("n")).collect()}  # a row for each language
    languages = sorted(sizes)
    df, n = document_frequencies(docs, text)
    idf = np.log((1 + n) / (1 + df)) + 1
    if not languages:
        return Model([], idf, np.zeros((BUCKETS, 0)), np.zeros(0), 1.0)
    share = max(LEAST_OF_A_LANGUAGE, sample // len(languages))
    bounds = F.broadcast(docs.sparkSession.createDataFrame([(x, hash_bound(share, c)) for x, c in sizes.items()], "lang string, bound long"))
    mark = F.xxhash64("id", F.lit(7))
    few = rows.select("id", "lang").join(bounds, "lang").where(mark <= F.col("bound")).select("id", "lang").distinct()
    ranked = few.withColumn("r", F.row_number().over(W.partitionBy("lang").orderBy(mark, "id"))).where(F.col("r") <= share)
    rows = rows.join(F.broadcast(ranked.select("id", "lang")), ["id", "lang"], "left_semi").dropDuplicates(["id", "lang"])

    def make():
        def f(texts):
            found = [grams(x)[0] for x in texts_of(texts)]
            at = [np.flatnonzero(c) for c in found]
            return [[a.tolist() for a in at], [c[a].tolist() for a, c in zip(at, found)]]

        return f

    lists = [T.StructField("at", T.ArrayType(T.IntegerType())), T.StructField("n", T.ArrayType(T.IntegerType()))]
    counted = map_columns(rows, ["text"], ["id", "lang"], lists, make)
    table = counted.toArrow()  # `sample` documents or the least number of each language, eight bytes for each bucket that one has
    numbers = lambda c: [x.values.to_numpy().astype(np.int64) for x in table.column(c)]
    got = sorted(zip(table.column("id").to_pylist(), table.column("lang").to_pylist(), numbers("at"), numbers("n")), key=lambda r: (r[0], r[1]))
    got = [(languages.index(y), at, tf_idf(c, idf[at])) for _, y, at, c in got if len(at)]
    order = np.random.default_rng(11).permutation(len(got)).tolist()
    kept_out, fitted = order[: len(order) // 6], order[len(order) // 6 :]
    model = Ftrl(BUCKETS, len(languages))
    for _ in range(EPOCHS):
        for k in fitted:
            y, at, x = got[k]
            model.learn(at, x, y)
    w = model.weights()
    z = np.array([x @ w[at] + w[-1] for _, at, x in (got[k] for k in kept_out)]).reshape(len(kept_out), len(languages))
    del table
    release()
    return Model(languages, idf, w[:-1], w[-1], temperature(z, np.array([got[k][0] for k in kept_out], int)))


def identify(docs: DataFrame, model: Model, text: str = "text", keep: list[str] | None = None) -> DataFrame:
    """Adds lang_pred and score (calibrated probability of the prediction).

    Texts that are null or have no letter are `und` with score 0, as are all texts if there was nothing to learn
    from. Columns with the names of results are replaced; keep: columns that stay. Repeated rows get equal results; a very long text is
    counted in blocks; of languages with equal scores the first in alphabetical order is taken; an empty table gives an empty table.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def make():
        m = shared.value

        def f(texts):
            found = [m.predict(x) for x in texts_of(texts)]
            return [[x for x, _ in found], [s for _, s in found]]

        return f

    fields = [T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType())]
    return map_columns(docs, [text], docs.columns if keep is None else keep, fields, make)
