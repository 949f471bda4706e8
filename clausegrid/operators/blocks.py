"""The best rows for a stated query set: queries come in blocks, rows are read where they are, only the best leave a task.

Rows that cannot be among a query's best are not scored. Texts are held as postings in the order of their impact, vectors in balls; both give an upper
bound for many rows at once, and what stays below the n-th best score found so far is left out. The results are exact.
"""

from __future__ import annotations

import ctypes
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, functions as F

#: Bytes of a block of queries, which goes to every task, numbers that a task computes together, and rows that are bounded together, at most.
BLOCK_BYTES, TOGETHER, ROWS = 64 << 20, 1 << 21, 1 << 13
#: Bytes of texts that are tokenized together, and postings that are bounded together, about: what a task holds does not grow with the documents.
TEXT_BYTES, POSTINGS = 1 << 20, 1 << 19
#: Best rows of all queries and groups that a task holds, at most.
HELD = 1 << 20
#: Vectors of a ball, about, and what rounding may add to a bound, relative to its terms.
BALL, SLACK = 64, 1e-9


def release() -> None:
    """Gives a finished task's memory back to the system; Python workers live on and would keep it."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (OSError, AttributeError):  # another C library
        return


def parts_of(sizes: np.ndarray, most: int, rows: int) -> Iterator[tuple[int, int]]:
    """(begin, end) of runs of up to `rows` rows whose sizes add up to `most` at most; a single larger row comes alone."""
    ends, at = np.cumsum(sizes), 0
    while at < len(sizes):
        before = int(ends[at - 1]) if at else 0
        to = min(max(at + 1, int(np.searchsorted(ends, before + most, "right"))), at + rows)
        yield at, to
        at = to


class Best:
    """The n best (score, id) of every query so far: larger scores first, then smaller ids."""

    def __init__(self, n_queries: int, n: int):
        self.n, self.floor, self.parts, self.size = n, np.full(n_queries, -np.inf), [], 0
        self.limit = max(1 << 16, 4 * n * n_queries)

    def add(self, query: np.ndarray, ids: np.ndarray, scores: np.ndarray | None = None) -> None:
        """Rows of a query, an id and a score; or, without scores, a row of all queries' scores for each id."""
        if scores is None:
            row, number = np.nonzero(query >= self.floor[None, :])
            query, ids, scores = number, ids[row], query[row, number]
        ok = scores >= self.floor[query]
        self.parts.append((query[ok], ids[ok], scores[ok]))
        self.size += int(ok.sum())
        if self.size > self.limit:
            self.settle()

    def settle(self) -> None:
        """Keeps the n best of each query; the floors are the n-th scores then."""
        if not self.parts:
            return
        query, ids, scores = (np.concatenate(x) for x in zip(*self.parts))
        order = np.lexsort((ids, -scores, query))
        query, ids, scores = query[order], ids[order], scores[order]
        first = np.searchsorted(query, np.arange(len(self.floor)))
        place = np.arange(len(query)) - first[query]
        keep = place < self.n
        last = place == self.n - 1
        self.floor[query[last]] = scores[last]
        self.parts, self.size = [(query[keep], ids[keep], scores[keep])], int(keep.sum())

    def result(self) -> tuple[np.ndarray, np.ndarray, np.ndarray] | None:
        """(query, id, score), or None for no rows."""
        self.settle()
        return self.parts[0] if self.size else None


def ids_of(array: pa.Array) -> np.ndarray:
    """Ids as numbers or as text of a fixed width, which sorts by code points."""
    return np.array(array.to_pylist(), dtype="U") if pa.types.is_string(array.type) or pa.types.is_large_string(array.type) else array.to_numpy(zero_copy_only=False)


def best_rows(rows: DataFrame, id_type: str, n_queries: int, n: int, look: Callable[[pa.RecordBatch, Best], None], weigh: Callable[[pa.RecordBatch], np.ndarray] | None = None) -> DataFrame:
    """(number, id, score): the n best rows of every query, by task. look: adds what a batch has to the best so far; weigh: the postings of its rows, if they differ."""

    def run(batches):
        best = Best(n_queries, n)
        for batch in batches:
            for at, to in parts_of(np.zeros(batch.num_rows, np.int64) if weigh is None else weigh(batch), POSTINGS, ROWS):
                look(batch.slice(at, to - at), best)
                best.settle()
            del batch
        found = best.result()
        if found is not None:
            query, ids, scores = found
            yield pa.RecordBatch.from_arrays([pa.array(query.astype(np.int64)), pa.array(ids.tolist() if ids.dtype.kind == "U" else ids), pa.array(scores)], names=["number", "id", "score"])
        del best, found
        release()

    return rows.mapInArrow(run, f"number long, id {id_type}, score double")


# ---------------------------------------------------------------- texts


#: What a byte of a token becomes; 0 for all other bytes.
_TOKEN = np.array([c if 48 <= c <= 57 or 97 <= c <= 122 else c + 32 if 65 <= c <= 90 else 0 for c in range(256)], np.uint8)


def ascii_tokens(texts: pa.Array) -> tuple[pa.Array, np.ndarray]:
    """(tokens of all texts, where each text's begin and the last one's end): runs of ASCII letters and digits in lower case, as functions.text.tokenize finds them."""
    texts = pc.fill_null(texts.cast(pa.large_string()), "")
    offsets = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1] if len(texts) else np.zeros(1, np.int64)
    data = _TOKEN[np.frombuffer(texts.buffers()[2] or b"", np.uint8)[offsets[0] : offsets[-1]]] if len(texts) else np.zeros(0, np.uint8)
    offsets = offsets - offsets[0]
    inside = data > 0
    begins = inside.copy()
    begins[1:] &= ~inside[:-1]
    at = offsets[:-1][offsets[:-1] < len(data)]
    begins[at] = inside[at]
    starts = np.flatnonzero(begins)
    kept = np.cumsum(inside) - inside  # letters before each byte
    places = np.append(kept[starts], int(inside.sum())).astype(np.int64)
    tokens = pa.LargeStringArray.from_buffers(len(starts), pa.py_buffer(places), pa.py_buffer(np.ascontiguousarray(data[inside])))
    return tokens, np.searchsorted(starts, offsets)


def term_index(docs: DataFrame, terms: list[str], id_: str = "id", text: str = "text", keep: tuple[str, ...] = ()) -> DataFrame:
    """id, dl, terms, tfs: of every document its length in tokens and, for the terms asked for, their numbers and how often they occur; the columns to keep follow.

    Texts are tokenized once; what comes out is a few numbers a document.
    """
    asked = docs.sparkSession.sparkContext.broadcast(terms)  # the distinct terms of the query set

    def run(batches):
        values = pa.array(asked.value, pa.large_string())
        n = max(1, len(values))
        for batch in batches:
            for at, to in parts_of(pc.fill_null(pc.binary_length(batch.column(1)), 0).to_numpy(zero_copy_only=False), TEXT_BYTES, 2048):
                part = batch.slice(at, to - at)
                tokens, bounds = ascii_tokens(part.column(1))
                lengths = np.diff(bounds)
                number = pc.index_in(tokens, value_set=values)
                known = number.is_valid().to_numpy(zero_copy_only=False)
                key = np.repeat(np.arange(part.num_rows), lengths)[known] * n + number.drop_null().to_numpy()
                key, tf = np.unique(key, return_counts=True)
                ends = pa.array(np.searchsorted(key, np.arange(part.num_rows + 1) * n).astype(np.int32))
                del tokens, number, known
                lists = (pa.ListArray.from_arrays(ends, pa.array(x.astype(np.int32))) for x in (key % n, tf))
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(lengths.astype(np.int32)), *lists, *part.columns[2:]], names=["id", "dl", "terms", "tfs", *keep])
                del part, key, tf, lists
            del batch
        release()

    kinds = dict(docs.dtypes)
    schema = ", ".join([f"id {kinds[id_]}, dl int, terms array<int>, tfs array<int>", *(f"`{c}` {kinds[c]}" for c in keep)])
    return docs.select(F.col(id_).alias("id"), F.col(text).alias("text"), *keep).mapInArrow(run, schema)


def term_counts(docs: DataFrame, id_: str = "id", text: str = "text") -> DataFrame:
    """id, term, tf, dl: a row for each distinct term of every document, with how often it occurs and the document's length in tokens."""

    def run(batches):
        for batch in batches:
            for at, to in parts_of(pc.fill_null(pc.binary_length(batch.column(1)), 0).to_numpy(zero_copy_only=False), TEXT_BYTES, 2048):
                part = batch.slice(at, to - at)
                tokens, bounds = ascii_tokens(part.column(1))
                lengths, coded = np.diff(bounds), tokens.dictionary_encode()
                n = max(1, len(coded.dictionary))
                key, tf = np.unique(np.repeat(np.arange(part.num_rows), lengths) * n + coded.indices.to_numpy(), return_counts=True)
                row, term = pa.array(key // n), coded.dictionary.cast(pa.string()).take(pa.array(key % n))
                yield pa.RecordBatch.from_arrays([part.column(0).take(row), term, pa.array(tf.astype(np.int64)), pa.array(lengths[key // n].astype(np.int32))], names=["id", "term", "tf", "dl"])
                del part, tokens, coded, key, tf, row, term
            del batch
        release()

    return docs.select(F.col(id_).alias("id"), F.col(text).alias("text")).mapInArrow(run, f"id {dict(docs.dtypes)[id_]}, term string, tf long, dl int")


class Impacts:
    """Postings of a block of documents: by term in the order of their weights, the largest first, and by document."""

    def __init__(self, row: np.ndarray, term: np.ndarray, weight: np.ndarray, n_rows: int, n_terms: int):
        """row never falls; terms are numbered from 0, weights are positive."""
        order = np.lexsort((-weight, term))
        self.rows, self.weights = row[order], weight[order]
        self.first = np.searchsorted(term[order], np.arange(n_terms + 1))
        self.most = np.zeros(n_terms)
        there = np.diff(self.first) > 0
        self.most[there] = self.weights[self.first[:-1][there]]
        self.row_terms, self.row_weights, self.row_first = term, weight, np.searchsorted(row, np.arange(n_rows + 1))
        self.n_rows, self.n_terms, self.looked = n_rows, n_terms, 0

    def bounds(self, query: np.ndarray, term: np.ndarray, value: np.ndarray, n_queries: int) -> np.ndarray:
        """What no document of the block can pass, by query."""
        return np.bincount(query, value * self.most[term], n_queries)

    def _whole(self, rows: np.ndarray, terms: np.ndarray, values: np.ndarray) -> np.ndarray:
        """The scores of some documents, from all their postings."""
        lookup = np.zeros(self.n_terms)
        lookup[terms] = values
        starts, lengths = self.row_first[rows], self.row_first[rows + 1] - self.row_first[rows]
        before = np.cumsum(lengths) - lengths
        at = np.repeat(starts - before, lengths) + np.arange(int(lengths.sum()))
        self.looked += len(at)
        return np.add.reduceat(lookup[self.row_terms[at]] * self.row_weights[at], before) if len(rows) else np.zeros(0)

    def _before_their_parts(self, terms: np.ndarray, lengths: np.ndarray, top: np.ndarray, floor: float) -> list[tuple[int, int]]:
        """Where the impacts of each term that reach the term's part of the floor stand; the longest lists get as much as they can give and are left out."""
        order = np.argsort(-lengths, kind="stable")
        given = np.cumsum(top[order])
        left_out = int(np.searchsorted(given, floor, "left"))
        rest = order[left_out:]
        share = (floor - (given[left_out - 1] if left_out else 0.0)) / max(1e-300, top[rest].sum())
        spans = zip(self.first[terms[rest]].tolist(), self.first[terms[rest] + 1].tolist(), self.most[terms[rest]].tolist())
        return [(a, a + int(np.searchsorted(-self.weights[a:b], -share * most * (1 - SLACK), "right"))) for a, b, most in spans if b > a]

    def best(self, terms: np.ndarray, values: np.ndarray, floor: float) -> tuple[np.ndarray, np.ndarray]:
        """(rows, scores) of the documents that score `floor` or more for the distinct terms of a query, and maybe some others.

        Each term gets a part of the floor. A document whose impacts all stay below their terms' parts stays below the floor, so only documents that stand
        before its part in some term's order need a score. Where these are too many, lists are added up, the shortest first, until what the rest
        can give leaves few documents that may still reach the floor; those are scored whole.
        """
        lengths, top = self.first[terms + 1] - self.first[terms], values * self.most[terms]
        per_row = len(self.row_terms) / max(1, self.n_rows)
        if floor > 0:
            spans = self._before_their_parts(terms, lengths, top, floor)
            if sum(b - a for a, b in spans) * (1 + per_row) <= lengths.sum():
                self.looked += sum(b - a for a, b in spans)
                rows = np.unique(np.concatenate([self.rows[a:b] for a, b in spans] or [np.zeros(0, np.int64)]))
                return rows, self._whole(rows, terms, values)
        order = np.argsort(lengths, kind="stable")
        left, rest, scores = int(lengths.sum()), float(top.sum()), np.zeros(self.n_rows)
        for t, v, n, most in zip(terms[order].tolist(), values[order].tolist(), lengths[order].tolist(), top[order].tolist()):
            if n:
                a = self.first[t]
                scores[self.rows[a : a + n]] += v * self.weights[a : a + n]
                self.looked += n
            left, rest = left - n, rest - most
            if rest < floor and left > self.n_rows:
                rows = np.flatnonzero(scores >= floor - rest - SLACK)
                if len(rows) * per_row < left:
                    return rows, self._whole(rows, terms, values)
        rows = np.flatnonzero(scores)
        return rows, scores[rows]


def lexical_top(index: DataFrame, entries: tuple[np.ndarray, np.ndarray, np.ndarray], n_queries: int, n: int, weight: Callable[[np.ndarray, np.ndarray], np.ndarray], decimals: int,
                scale: np.ndarray | None = None) -> DataFrame | None:
    """(number, id, score): the n best documents of every query by task; those without a term of the query never come.

    entries: (term, query, weight) of each query's distinct terms; weight: of a posting, from its tf and dl. Scores are sums of products over scale.
    """
    spark, kind = index.sparkSession, dict(index.dtypes)["id"]
    order = np.argsort(entries[1], kind="stable")
    terms, query, values = (e[order] for e in entries)
    first = np.searchsorted(query, np.arange(n_queries + 1))
    at_once, low, found = max(1, BLOCK_BYTES // 24), 0, None
    while low < n_queries:
        high = max(low + 1, int(np.searchsorted(first, first[low] + at_once, "right")) - 1)
        own = slice(first[low], first[high])
        used, term = np.unique(terms[own], return_inverse=True)
        shared = spark.sparkContext.broadcast((used, term, query[own] - low, values[own], first[low : high + 1] - first[low], np.ones(high - low) if scale is None else scale[low:high]))

        def look(batch, best, shared=shared):
            used, term, query, value, first, scale = shared.value
            if not len(used):
                return
            names = {c: k for k, c in enumerate(batch.schema.names)}
            ids, dl, lists, tfs = ids_of(batch.column(names["id"])), batch.column(names["dl"]).to_numpy(), batch.column(names["terms"]), batch.column(names["tfs"])
            there, offsets = lists.flatten().to_numpy(), lists.offsets.to_numpy() - lists.offsets.to_numpy()[0]
            row = np.repeat(np.arange(len(ids)), np.diff(offsets))
            place = np.minimum(np.searchsorted(used, there), len(used) - 1)
            ok = used[place] == there
            row, place = row[ok], place[ok]
            block = Impacts(row, place, weight(tfs.flatten().to_numpy()[ok].astype(float), dl[row].astype(float)), len(ids), len(used))
            # a score that rounds up to the floor counts
            floors = best.floor * scale - scale * 10.0**-decimals
            for q in np.flatnonzero((block.bounds(query, term, value, len(scale)) >= floors) & (np.diff(first) > 0)).tolist():
                rows, scores = block.best(term[first[q] : first[q + 1]], value[first[q] : first[q + 1]], float(floors[q]))
                if len(rows):
                    some = scores > 0
                    best.add(np.full(int(some.sum()), q), ids[rows[some]], np.round(scores[some] / scale[q], decimals))

        def weigh(batch):
            return pc.fill_null(pc.list_value_length(batch.column(batch.schema.get_field_index("terms"))), 0).to_numpy(zero_copy_only=False)

        part = best_rows(index, kind, high - low, n, look, weigh).withColumn("number", F.col("number") + low)
        found = part if found is None else found.unionByName(part)
        low = high
    return found


class BestByGroup:
    """The n best rows of every query in each group so far: larger scores first, then larger ties (nulls last), then smaller ids."""

    def __init__(self, n_queries: int, n: int):
        self.n_queries, self.n, self.numbers = n_queries, n, {}
        self.full, self.floor = np.zeros(0, np.int64), np.zeros(0)
        self.parts, self.size, self.settled = [], 0, 0

    def numbered(self, groups: pa.Array) -> np.ndarray:
        """The numbers of groups, which may be null."""
        coded = groups.dictionary_encode("encode")
        own = np.array([self.numbers.setdefault(x, len(self.numbers)) for x in coded.dictionary.to_pylist()], np.int64)
        return own[coded.indices.to_numpy()]

    def add(self, query: np.ndarray, group: np.ndarray, scores: np.ndarray, untied: np.ndarray, ties: np.ndarray, ids: np.ndarray) -> None:
        """untied: where the tie is null. Rows below their pair's n-th score do not enter."""
        key = group * self.n_queries + query
        ok = np.ones(len(key), bool)
        if len(self.full):
            at = np.minimum(np.searchsorted(self.full, key), len(self.full) - 1)
            ok = (self.full[at] != key) | (scores >= self.floor[at])
        self.parts.append(tuple(x[ok] for x in (key, scores, untied, ties, ids)))
        self.size += int(ok.sum())
        if self.size > 2 * self.settled + (1 << 16):
            self.settle()

    def settle(self) -> None:
        """Keeps the n best of each query and group."""
        if not self.parts:
            return
        rows = tuple(np.concatenate(x) for x in zip(*self.parts))
        key, scores, untied, ties, ids = rows
        # ~x falls as x rises, without overflow
        order = np.lexsort((ids, ~ties, untied, -scores, key))
        key = key[order]
        place = np.arange(len(key)) - np.searchsorted(key, key)
        last = place == self.n - 1
        self.full, self.floor = key[last], scores[order][last]
        self.parts = [tuple(x[order[place < self.n]] for x in rows)]
        self.size = self.settled = len(self.parts[0][0])

    def result(self) -> tuple[np.ndarray, ...] | None:
        """(query, group's number, score, whether the tie is null, tie, id), or None for no rows."""
        self.settle()
        if not self.size:
            return None
        key, *rest = self.parts[0]
        return key % self.n_queries, key // self.n_queries, *rest


def grouped_top(index: DataFrame, entries: tuple[np.ndarray, np.ndarray, np.ndarray], n_queries: int, n: int, group: str, tie: str) -> DataFrame | None:
    """(number, group, id, score, tie): the n best documents of every query in each group by task; those without a term of the query never come.

    Larger sums of the shared terms' weights come first, then larger ties (long, nulls last), then smaller ids. index: id, terms, group, tie; entries: (term, query, weight)
    of each query's distinct terms. Pairs of a query and a document are made POSTINGS at a time. A task with so many groups that it would hold more than HELD rows
    hands these on and begins anew, so what it holds does not grow with the groups.
    """
    spark, kinds = index.sparkSession, dict(index.dtypes)
    order = np.argsort(entries[1], kind="stable")
    terms, query, values = (e[order] for e in entries)
    starts = np.searchsorted(query, np.arange(n_queries + 1))
    low, found = 0, None
    while low < n_queries:
        high = max(low + 1, int(np.searchsorted(starts, starts[low] + max(1, BLOCK_BYTES // 24), "right")) - 1)
        own = slice(starts[low], starts[high])
        by_term = np.argsort(terms[own], kind="stable")
        used, first = np.unique(terms[own][by_term], return_index=True)
        shared = spark.sparkContext.broadcast((used, np.append(first, len(by_term)), query[own][by_term] - low, values[own][by_term]))

        def pairs(batch, shared=shared):
            """(rows, queries, scores) of a batch, in parts."""
            used, first, query, value = shared.value
            lists, n_queries = batch.column(batch.schema.get_field_index("terms")), int(query.max()) + 1
            there, offsets = lists.flatten().to_numpy(), lists.offsets.to_numpy() - lists.offsets.to_numpy()[0]
            row = np.repeat(np.arange(batch.num_rows), np.diff(offsets))
            place = np.minimum(np.searchsorted(used, there), len(used) - 1)
            ok = used[place] == there
            row, place = row[ok], place[ok]
            askers = first[place + 1] - first[place]
            begins = np.searchsorted(row, np.arange(batch.num_rows + 1))
            for a, b in parts_of(np.bincount(row, askers, batch.num_rows).astype(np.int64), POSTINGS, ROWS):
                some = slice(begins[a], begins[b])
                times = askers[some]
                at = np.repeat(first[place[some]] - (np.cumsum(times) - times), times) + np.arange(int(times.sum()))
                pair, number = np.unique(np.repeat(row[some], times) * n_queries + query[at], return_inverse=True)
                yield pair // n_queries, pair % n_queries, np.bincount(number, value[at], len(pair))

        def run(batches, shared=shared, n_queries=high - low):
            def handed_on(best):
                found = best.result()
                if found is not None:
                    query, number, score, untied, ties, ids = found
                    names = pa.array(list(best.numbers), groups).take(pa.array(number))
                    ids = pa.array(ids.tolist() if ids.dtype.kind == "U" else ids)
                    yield pa.RecordBatch.from_arrays([pa.array(query), names, ids, pa.array(score), pa.array(ties, mask=untied)], names=["number", group, "id", "score", tie])

            best, groups = BestByGroup(n_queries, n), None
            for batch in batches:
                places = {c: k for k, c in enumerate(batch.schema.names)}
                groups = batch.schema.field(group).type
                for at, to in parts_of(pc.fill_null(pc.list_value_length(batch.column(places["terms"])), 0).to_numpy(zero_copy_only=False), POSTINGS, ROWS):
                    part = batch.slice(at, to - at)
                    ids, ties = ids_of(part.column(places["id"])), part.column(places[tie])
                    untied, ties = ties.is_null().to_numpy(zero_copy_only=False), pc.fill_null(ties, 0).to_numpy(zero_copy_only=False)
                    number = best.numbered(part.column(places[group]))
                    for row, query, scores in pairs(part) if len(shared.value[0]) else ():
                        best.add(query, number[row], scores, untied[row], ties[row], ids[row])
                        if best.size > HELD or len(best.numbers) > HELD:
                            best.settle()
                            if best.size > HELD // 2 or len(best.numbers) > HELD:
                                yield from handed_on(best)
                                best = BestByGroup(n_queries, n)
                                number = best.numbered(part.column(places[group]))
                del batch
            yield from handed_on(best)
            del best
            release()

        part = index.mapInArrow(run, f"number long, `{group}` {kinds[group]}, id {kinds['id']}, score double, `{tie}` long").withColumn("number", F.col("number") + low)
        found = part if found is None else found.unionByName(part)
        low = high
    return found


# ---------------------------------------------------------------- vectors


class Balls:
    """A block of vectors in balls: halves of halves, each along the line through two far members."""

    def __init__(self, x: np.ndarray, size: int = BALL):
        order, spans, todo = np.arange(len(x)), [], [(0, len(x))]
        while todo:
            lo, hi = todo.pop()
            if hi - lo <= size:
                spans.append((lo, hi))
                continue
            own = x[order[lo:hi]]
            a = own[((own - own[0]) ** 2).sum(axis=1).argmax()]
            b = own[((own - a) ** 2).sum(axis=1).argmax()]
            middle = (hi - lo) // 2
            order[lo:hi] = order[lo:hi][np.argpartition(own @ (b - a), middle)]
            todo += [(lo, lo + middle), (lo + middle, hi)]
        self.order, self.spans, self.x = order, spans, x[order]
        self.centres = np.array([self.x[a:b].mean(axis=0) for a, b in spans])
        self.radii = np.array([np.sqrt(((self.x[a:b] - c) ** 2).sum(axis=1).max()) for (a, b), c in zip(spans, self.centres)])
        self.scored = 0

    def bounds(self, queries: np.ndarray) -> np.ndarray:
        """(queries x balls) what no member's product can pass: the centre's, and the query's length along the radius."""
        return queries @ self.centres.T + np.sqrt((queries**2).sum(axis=1))[:, None] * (self.radii + SLACK * (1 + np.sqrt((self.centres**2).sum(axis=1))))

    def look(self, queries: np.ndarray, ids: np.ndarray, best: Best, decimals: int) -> None:
        """Scores the balls, best bound first, against the queries whose floor a ball's bound reaches."""
        step = max(1, TOGETHER // max(1, len(self.spans)))
        for at in range(0, len(queries), step):
            some = queries[at : at + step]
            bounds = self.bounds(some)
            # the balls of each query in turn: its best one first, so that floors rise early
            order = np.argsort(-bounds, axis=1)
            for turn in range(len(self.spans)):
                ball = order[:, turn]
                open_ = np.flatnonzero(bounds[np.arange(len(some)), ball] >= best.floor[at : at + len(some)] - 10.0**-decimals)
                if not len(open_):
                    break
                for k in np.unique(ball[open_]).tolist():
                    own = open_[ball[open_] == k]
                    a, b = self.spans[k]
                    self.scored += len(own) * (b - a)
                    scores = np.round(some[own] @ self.x[a:b].T, decimals)
                    i, j = np.nonzero(scores >= best.floor[at + own][:, None])
                    best.add(at + own[i], ids[self.order[a + j]], scores[i, j])
                best.settle()


def dense_top(vectors: DataFrame, queries: np.ndarray, n: int, decimals: int) -> DataFrame:
    """(number, id, score): the n largest inner products of each query vector by task. vectors: id, v (array of doubles, none null)."""
    spark, kind = vectors.sparkSession, dict(vectors.dtypes)["id"]
    shared = spark.sparkContext.broadcast(np.ascontiguousarray(queries))

    def look(batch, best):
        q = shared.value
        x = batch.column(1).flatten().to_numpy(zero_copy_only=False).reshape(-1, q.shape[1])
        Balls(x).look(q, ids_of(batch.column(0)), best, decimals)

    return best_rows(vectors, kind, len(queries), n, look)
