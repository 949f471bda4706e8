"""Toxicity: a chain of sparse linear classifiers, one a category, each fed with the earlier ones' probabilities.

Features are the hashed words and word beginnings of a text; each distinct chunk between white space counts once. Categories are
predicted in order; a later model has the earlier categories' probabilities as inputs. In training those are
out-of-fold predictions, so a later model sees them as uncertain as they will be. The chain takes any number of categories; the
labels table has one of toxicity (`toxic`) and a quality mark, so the default chain is `low_quality`, which is no toxicity and never
rejects a document but informs, then `toxic`. The models are fitted on the
driver on a bounded sample of labelled documents (SAMPLE rows, those with the smallest hashed doc_id), of which
only feature numbers travel; every document is scored, whole.
"""

from __future__ import annotations

from itertools import chain

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, functions as F, types as T

from clausegrid.llm.common import Memo, Sparse, fit_logistic, hash_bound, map_columns, release, sigmoid, texts_of

#: Labelled documents that are used for fitting at most, and features of each of them at most on the driver.
SAMPLE = 6000
#: Chunks that a task remembers.
REMEMBERED = 150_000
BUCKETS = 1 << 20
BEGINNINGS = (4, 5, 6)
#: Features that enter a fit: in this many documents at least, and the most telling ones of each category.
LEAST_DOCUMENTS, TELLING = 4, 1500
FOLDS, THRESHOLD = 3, 0.4
L1, L2, STEPS = 2e-4, 1e-5, 150

def default_categories() -> dict[str, Column]:
    """The categories that the labels table has, in the order of the chain."""
    return {"low_quality": F.col("quality") == 0, "toxic": F.col("toxic") == 1}


def _bucket(x: str) -> int:
    return xxhash.xxh3_64_intdigest(x.encode()) % BUCKETS


def chunk_features(chunk: str) -> tuple[int, ...]:
    """Feature numbers of a lower-case chunk between white space."""
    found, word = [], []
    for c in chunk + " ":
        if c.isalnum():
            word.append(c)
        elif word:
            w = "".join(word)
            found.append(_bucket("=" + w))
            found += [_bucket("^" + w[:k]) for k in BEGINNINGS if len(w) >= k]
            word = []
    return tuple(found)


def text_features(text: str, memo: Memo) -> list[int]:
    """Feature numbers, one for each distinct chunk that has the feature."""
    return list(chain.from_iterable(memo.many(list(set(text.lower().split())))))


class Chain:
    """Fitted models: weights by feature number, the weights of earlier probabilities, and biases."""

    def __init__(self, names: list[str], features: np.ndarray, weights: np.ndarray, earlier: list[np.ndarray], biases: list[float]):
        self.names, self.features, self.weights, self.earlier, self.biases = names, features, weights, earlier, biases

    def probabilities(self, sums: np.ndarray) -> np.ndarray:
        """sums: for each row the added weights of its features, by category."""
        p = np.zeros_like(sums)
        for k in range(len(self.names)):
            p[:, k] = sigmoid(sums[:, k] + p[:, :k] @ self.earlier[k] + self.biases[k])
        return p


def telling(rows: list[np.ndarray], labels: np.ndarray) -> np.ndarray:
    """The features whose document shares differ most, in standard errors, between a category's two sides. rows: distinct features."""
    total, inside = np.zeros(BUCKETS, np.int32), np.zeros((labels.shape[1], BUCKETS), np.int32)
    for r, y in zip(rows, labels.tolist()):
        total[r] += 1
        for k, yes in enumerate(y):
            if yes:
                inside[k, r] += 1
    chosen, seen = [np.zeros(0, np.int64)], np.flatnonzero(total >= LEAST_DOCUMENTS)
    share = total[seen] / max(1, len(rows))
    for k in range(labels.shape[1]):
        yes, no = max(1, int(labels[:, k].sum())), max(1, int((1 - labels[:, k]).sum()))
        here = inside[k, seen]
        score = np.abs(here / yes - (total[seen] - here) / no) / np.sqrt(np.maximum(share * (1 - share), 1e-6))
        best = np.lexsort((seen, -score))[:TELLING]
        chosen.append(seen[best[score[best] > 0]])
    return np.unique(np.concatenate(chosen))


def fit_chain(rows: list[np.ndarray], labels: np.ndarray, names: list[str], folds: np.ndarray) -> Chain:
    """rows: feature numbers of each document; labels: 0 or 1 by document and category; folds: each row's fold."""
    features = telling([np.unique(r) for r in rows], labels)
    place = np.full(BUCKETS, -1, np.int32)
    place[features] = np.arange(len(features))
    x = []
    for r in rows:
        at = place[r]
        x.append(np.unique(at[at >= 0], return_counts=True))
    x = Sparse([a for a, _ in x], len(features), [c for _, c in x])
    n = len(rows)
    weights, earlier, biases, known = np.zeros((len(features), len(names))), [], [], np.zeros((n, 0))
    for k in range(len(names)):
        y = labels[:, k].astype(float)
        w, e, b = fit_logistic(x, y, known, L1, L2, STEPS)
        weights[:, k] = w
        earlier.append(e)
        biases.append(b)
        if k < len(names) - 1:
            out = np.zeros(n)
            for fold in range(FOLDS):
                a, c = np.flatnonzero(folds != fold), np.flatnonzero(folds == fold)
                w, e, b = fit_logistic(x.take(a), y[a], known[a], L1, L2, STEPS)
                out[c] = sigmoid(x.take(c).times(w) + known[c] @ e + b)
            known = np.column_stack([known, out])
    used = np.abs(weights).sum(axis=1) > 0
    return Chain(names, features[used], weights[used], earlier, biases)


def train(docs: DataFrame, labels: DataFrame, categories: dict[str, Column] | None = None, doc_id: str = "doc_id", text: str = "text", sample: int = SAMPLE) -> Chain:
    """Fits the chain on at most `sample` labelled documents with a text; labels has doc_id and the categories' columns.

    Several labels of a doc_id count together (a category holds if one of them says so), and one text of a repeated doc_id is used.
    Null ids and null texts are left out; null labels count as no. Without labelled documents every probability is the least one.
    """
    categories = categories or default_categories()
    names = list(categories)
    ys = [f"y{k}" for k in range(len(names))]
    marked = labels.where(F.col(doc_id).isNotNull()).groupBy(F.col(doc_id).alias("id")).agg(*(F.max(F.coalesce(c, F.lit(False)).cast("int")).alias(y) for y, c in zip(ys, categories.values())))
    mark = F.xxhash64("id")
    chosen = marked.where(mark <= F.lit(hash_bound(sample, marked.count()))).orderBy(mark, "id").limit(sample)
    texts = docs.select(F.col(doc_id).alias("id"), F.col(text).alias("text")).where("text is not null")
    joined = texts.join(F.broadcast(chosen), "id").dropDuplicates(["id"])

    def make():
        memo = Memo(lambda chunks: [chunk_features(c) for c in chunks], REMEMBERED)
        return lambda texts: [[text_features(x, memo) for x in texts_of(texts)]]

    found = map_columns(joined, ["text"], ["id", *ys], [T.StructField("features", T.ArrayType(T.IntegerType()))], make)
    table = found.toArrow()  # at most `sample` documents, a number of four bytes for each feature
    ids = table.column("id").to_pylist()
    order = sorted(range(len(ids)), key=ids.__getitem__)
    features = [x.values.to_numpy() for x in table.column("features")]
    labels_of = np.column_stack([table.column(y).to_numpy() for y in ys]).reshape(len(ids), len(names))[order]
    ids = [ids[k] for k in order]
    folds = np.array([xxhash.xxh64_intdigest(str(i)) % FOLDS for i in ids], int)
    model = fit_chain([features[k] for k in order], labels_of, names, folds)
    del table, features
    release()
    return model


def score(docs: DataFrame, model: Chain, text: str = "text", keep: list[str] | None = None, target: str = "toxic", threshold: float = THRESHOLD) -> DataFrame:
    """Adds p_<category> for each category and is_<target> (its probability is at least threshold).

    Null and empty texts have no features; their probabilities are the model's base rates. Columns with the names of
    results are replaced; keep: columns that stay. Repeated rows get equal results; a very long text counts each of its distinct chunks once.
    An empty table gives an empty table.
    """
    at, shared = model.names.index(target), docs.sparkSession.sparkContext.broadcast(model)
    fields = [*(T.StructField(f"p_{c}", T.DoubleType()) for c in model.names), T.StructField(f"is_{target}", T.BooleanType())]

    def make():
        model = shared.value
        number = {f: k for k, f in enumerate(model.features.tolist())}
        memo = Memo(lambda chunks: [tuple(number[f] for f in chunk_features(c) if f in number) for c in chunks], REMEMBERED)

        def f(texts):
            hits = [text_features(x, memo) for x in texts_of(texts)]
            sums = np.array([model.weights[h].sum(axis=0) for h in hits]).reshape(len(hits), len(model.names))
            p = model.probabilities(sums)
            return [*(pa.array(p[:, k]) for k in range(len(model.names))), pa.array(p[:, at] >= threshold)]

        return f

    return map_columns(docs, [text], docs.columns if keep is None else keep, fields, make)
