"""Source divergence audit: how each source of a language differs from the others and from the language as a whole, by its terms.

Sort-based streaming, in two scans. A task first sums what its own documents hold, so a frequent term leaves it as one row for each language and
source. These rows are dealt by (lang, term) and sorted by (lang, term, source); a scan of the runs gives a term's documents and its counts
by source, and lets go of terms in too few documents. The kept rows are dealt again by language, bucket of terms and pair of blocks of
sources and sorted the same way; behind the unit's sources, a scan of the runs gives each term's shares for all of them and adds their
differences up. A unit emits one partial row for each pair of sources, and the terms that a source has most more of than its language; sums and ranks
follow. Sources come with the rows of their unit, so nothing is broadcast, and a unit holds two blocks of sources however many there are.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window as W, functions as F

from clausegrid.llm.common import cut, release, slices, text_bytes

LEAST_DOCUMENTS, MOST_TERMS = 30, 50
#: Added to each count; shares are whole numbers of 1 / SCALE = 1 / (_STEP ** 3).
PRIOR, _STEP = 5, 1000
#: Different terms by group that a task sums before it hands them on; sources of a block, and shares that are computed together.
HELD, BLOCK, CELLS = 1_000_000, 256, 1 << 20
#: Kept rows of a unit's bucket, about, and languages up to which their buckets are broadcast.
UNIT_ROWS, MAX_LANGS = 1 << 16, 100_000
#: Bytes of terms (letters and all that is not ASCII, A-Z lower-cased); the others part them.
_TERM_BYTES = bytes(c | 32 if 65 <= c <= 90 else c if 97 <= c <= 122 or c >= 128 else 32 for c in range(256))
_ROWS = 1 << 16


def terms_of(text: bytes) -> list[bytes]:
    return text.translate(_TERM_BYTES).split()


def share(count, total, kinds):
    """1 + floor(10**9 * (count + 5) / (total + 5 * kinds)), exact in 64 bits while the divisor is below 9 * 10**15; count is at most total."""
    rest, below, out = np.asarray(count, np.int64) + PRIOR, np.asarray(total, np.int64) + PRIOR * np.asarray(kinds, np.int64), np.int64(0)
    for _ in range(3):
        rest = rest * _STEP
        out = out * _STEP + rest // below
        rest = rest % below
    return out + 1


def _batches(rows: list[tuple], schema: pa.Schema) -> Iterator[pa.RecordBatch]:
    for at in range(0, len(rows), _ROWS):
        columns = zip(*rows[at : at + _ROWS])
        yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, schema)], schema=schema)


def _text_schema(*fields: tuple) -> pa.Schema:
    return pa.schema([pa.field(n, t) for n, t in fields])


def occurrences(docs: DataFrame, text: str, lang: str, source: str, held: int = HELD) -> DataFrame:
    """(lang, term, source, docs, n): documents with the term and its occurrences, summed over a part of the documents; rows repeat."""
    schema = _text_schema(("lang", pa.string()), ("term", pa.binary()), ("source", pa.string()), ("docs", pa.int64()), ("n", pa.int64()))

    def run(batches):
        found: dict[tuple, tuple[Counter, Counter]] = {}

        def out():
            for (one, two), (docs_with, more) in found.items():
                yield from _batches([(one, t, two, k, k + more.get(t, 0)) for t, k in docs_with.items()], schema)
            found.clear()

        size = 0
        for batch in batches:
            for part in slices(batch):
                data, offsets = text_bytes(part.column(0))
                langs, sources = part.column(1).to_pylist(), part.column(2).to_pylist()
                data, offsets = data.tobytes(), offsets.tolist()
                for k, key in enumerate(zip(langs, sources)):
                    words = terms_of(data[offsets[k] : offsets[k + 1]])
                    docs_with, more = found.setdefault(key, (Counter(), Counter()))
                    size -= len(docs_with)
                    counts = Counter(words)
                    docs_with.update(counts.keys())
                    # few terms repeat in a document: only what goes beyond once is counted apart
                    for t, n in counts.items():
                        if n > 1:
                            more[t] += n - 1
                    size += len(docs_with)
                    if size > held:
                        yield from out()
                        size = 0
        yield from out()
        release()

    empty = F.lit("")
    some = docs.select(F.col(text), F.coalesce(F.col(lang).cast("string"), empty).alias("l"), F.coalesce(F.col(source).cast("string"), empty).alias("s"))
    made = some.mapInArrow(run, "lang string, term binary, source string, docs long, n long")
    return made.select("lang", F.col("term").cast("string").alias("term"), "source", "docs", "n")


def _runs(batches, key: tuple[str, ...], rest: tuple[str, ...]):
    """(key, rows of `rest`) of each run of equal keys in sorted batches; a run is a generator, to be read before the next one."""

    def rows():
        for batch in batches:
            columns = [batch.column(batch.schema.get_field_index(c)).to_pylist() for c in (*key, *rest)]
            yield from zip(zip(*columns[: len(key)]), zip(*columns[len(key) :]))

    todo = rows()
    head = next(todo, None)

    def run(own):
        nonlocal head
        while head is not None and head[0] == own:
            yield head[1]
            head = next(todo, None)

    while head is not None:
        own = head[0]
        one = run(own)
        yield own, one
        for _ in one:
            pass


def _starts(*columns: pa.Array) -> np.ndarray:
    """Where runs of equal rows begin."""
    n, new = len(columns[0]), np.zeros(len(columns[0]), bool)
    for c in columns if n > 1 else ():
        new[1:] |= pc.not_equal(c.slice(1), c.slice(0, n - 1)).to_numpy(zero_copy_only=False)
    new[:1] = True
    return np.flatnonzero(new)


def kept_terms(parts: DataFrame, least: int) -> DataFrame:
    """(lang, term, source, n, total, first): counts of each term in `least` documents of its language or more; first marks one row of each run."""
    names = ("lang", "term", "source", "docs", "n")

    def summed(columns: list[pa.Array]) -> list[pa.Array]:
        """One row for each run of equal (lang, term, source)."""
        at = _starts(*columns[:3])
        return [c.take(pa.array(at)) for c in columns[:3]] + [pa.array(np.add.reduceat(c.to_numpy(), at)) for c in columns[3:]]

    def judged(columns: list[pa.Array], at: np.ndarray):
        """The rows of whole runs of (lang, term), which begin at `at`."""
        lengths = np.diff(np.append(at, len(columns[0])))
        docs, total = (np.add.reduceat(c.to_numpy(), at) for c in columns[3:])
        first = np.zeros(len(columns[0]), bool)
        first[at] = True
        made = [*columns[:3], columns[4], pa.array(np.repeat(total, lengths)), pa.array(first)]
        return pa.RecordBatch.from_arrays(made, names=["lang", "term", "source", "n", "total", "first"]).filter(pa.array(np.repeat(docs >= least, lengths)))

    def scan(batches):
        held = None  # the run that the next batch may go on with, summed
        for batch in batches:
            if not batch.num_rows:
                continue
            columns = [batch.column(batch.schema.get_field_index(c)) for c in names]
            columns = summed(columns if held is None else [pa.concat_arrays(x) for x in zip(held, columns)])
            at = _starts(*columns[:2])
            held = [c.slice(int(at[-1])) for c in columns]
            if len(at) > 1:
                yield judged([c.slice(0, int(at[-1])) for c in columns], at[:-1])
        if held is not None:
            yield judged(held, np.zeros(1, np.int64))
        release()

    dealt = parts.repartition("lang", "term").sortWithinPartitions("lang", "term", "source")
    return dealt.mapInArrow(scan, "lang string, term string, source string, n long, total long, first boolean")


class Unit:
    """The sources of one unit, the sums of their differences, and the runs of terms that are waiting."""

    def __init__(self, one_block: bool, most: int):
        self.one_block, self.most, self.sources, self.sides, self.totals = one_block, most, [], [], []
        self.kinds = self.whole = 0
        self.sums, self.terms, self.cells, self.of_lang = None, [], [], []

    def add_source(self, source: str, side: int, total: int, kinds: int, whole: int) -> None:
        self.sources.append(source)
        self.sides.append(side)
        self.totals.append(total)
        self.kinds, self.whole = kinds, whole

    def ready(self) -> None:
        """All sources are there."""
        if self.sums is None:
            self.at = {s: k for k, s in enumerate(self.sources)}
            sides = np.array(self.sides, np.int64)
            self.left = np.flatnonzero(sides == 0)
            self.right = self.left if self.one_block else np.flatnonzero(sides == 1)
            self.sums = np.zeros((len(self.left), len(self.right)), np.int64)

    def add_run(self, term: str, run) -> bool:
        """Takes a term's counts by source; whether enough terms are waiting."""
        total = 0
        for source, n, total, *_ in run:
            self.cells.append((len(self.terms), self.at[source], n))
        self.terms.append(term)
        self.of_lang.append(total)
        return len(self.terms) * len(self.sources) >= CELLS

    def settle(self) -> list[tuple]:
        """Adds the waiting runs up; (source, term, value) of the terms that sources have most more of than their language, in units of one block.

        Of each source's terms come the `most` highest values here, and all that tie with the last of them.
        """
        counts = np.zeros((len(self.terms), len(self.sources)), np.int64)
        cells = np.array(self.cells, np.int64).reshape(-1, 3)
        counts[cells[:, 0], cells[:, 1]] = cells[:, 2]
        p = share(counts, np.array(self.totals)[None, :], self.kinds)
        theirs = p[:, self.right]
        for k, i in enumerate(self.left.tolist()):
            self.sums[k] += np.abs(p[:, i : i + 1] - theirs).sum(axis=0)
        out = []
        if self.one_block:
            q = share(np.array(self.of_lang), self.whole, self.kinds)[:, None]
            more = np.where(counts > 0, p - q, 0)
            for j, source in enumerate(self.sources):
                own = more[:, j]
                least = np.partition(own, len(own) - self.most)[len(own) - self.most] if len(own) > self.most else 1
                out += [(source, self.terms[i], int(own[i])) for i in np.flatnonzero(own >= max(1, least)).tolist()]
        self.terms, self.cells, self.of_lang = [], [], []
        return out

    def pairs(self) -> list[tuple]:
        out = []
        for k, i in enumerate(self.left.tolist()):
            for m, j in enumerate(self.right.tolist()):
                if i != j:
                    value = int(self.sums[k, m])
                    out.append((self.sources[i], self.sources[j], value))
                    if not self.one_block:
                        out.append((self.sources[j], self.sources[i], value))
        return out


def partial_sums(kept: DataFrame, groups: DataFrame, blocks: int, most: int) -> DataFrame:
    """(lang, source, part, item, value): for pairs the sum over a unit's terms, for terms, at least the `most` of a group, their value.

    groups: lang, source, total (N), kinds (V), whole (the language's N), buckets (of the language's terms). Each unit has all sources of
    two blocks and the terms of one bucket.
    """
    key, rest = ("lang", "bucket", "lo", "hi", "term"), ("source", "n", "total", "side", "kinds", "whole")
    own = F.pmod(F.xxhash64("source"), F.lit(blocks)).cast("int")
    other = F.explode(F.sequence(F.lit(0), F.lit(blocks - 1)))
    each = F.explode(F.sequence(F.lit(0), F.col("buckets") - 1))
    none = F.lit(None).cast("long")
    langs = groups.select("lang", "buckets").distinct()
    langs = F.broadcast(langs) if langs.count() <= MAX_LANGS else langs
    runs = kept.join(langs, "lang").select("lang", F.pmod(F.xxhash64("lang", "term"), F.col("buckets")).cast("int").alias("bucket"), "term", "source", "n", "total", none.alias("kinds"), none.alias("whole"))
    heads = groups.select("lang", each.alias("bucket"), F.lit(None).cast("string").alias("term"), "source", none.alias("n"), "total", "kinds", "whole")
    rows = runs.unionByName(heads).withColumn("own", own).withColumn("other", other)
    units = rows.withColumn("lo", F.least("own", "other")).withColumn("hi", F.greatest("own", "other")).withColumn("side", (F.col("own") > F.col("lo")).cast("int"))
    schema = _text_schema(("lang", pa.string()), ("source", pa.string()), ("part", pa.string()), ("item", pa.string()), ("value", pa.int64()))

    def scan(batches):
        unit, here = None, None

        def finish():
            if unit is not None:
                unit.ready()
                yield from _batches([(here[0], s, "term", t, v) for s, t, v in unit.settle()], schema)
                yield from _batches([(here[0], s, "pair", t, v) for s, t, v in unit.pairs()], schema)

        for (*place, term), run in _runs(batches, key, rest):
            if place != here:
                yield from finish()
                unit, here = Unit(place[2] == place[3], most), place
            if term is None:
                for source, _, total, side, kinds, whole in run:
                    unit.add_source(source, side, total, kinds, whole)
                continue
            unit.ready()
            if unit.add_run(term, run):
                yield from _batches([(here[0], s, "term", t, v) for s, t, v in unit.settle()], schema)
        yield from finish()
        release()

    dealt = units.select(*key, *rest).repartition("lang", "bucket", "lo", "hi").sortWithinPartitions(*key, "source")
    return dealt.mapInArrow(scan, "lang string, source string, part string, item string, value long")


def audit(docs: DataFrame, text: str = "text", lang: str = "lang", source: str = "source", least: int = LEAST_DOCUMENTS, most: int = MOST_TERMS, block: int = BLOCK, held: int = HELD) -> DataFrame:
    """lang, source, part, item, value, rank: how far each source of a language is from the others, and its `most` terms above the language's share.

    Null text, lang and source count as empty; each row is a document of its own, so repeated rows count again, whatever their ids. Terms are runs of
    letters A-Z and characters beyond ASCII, A-Z lower-cased; a language keeps those in `least` of its documents. Sources without terms and
    languages without kept terms have pairs of value 0 or more, as the shares say; a language's only source has none. Ties of a value are ranked by the item's bytes. Very
    long texts are one row of a slice of their own. Other columns are not looked at, whatever their names. An empty table gives an empty table.
    """
    kept = cut(kept_terms(occurrences(docs, text, lang, source, held), least))
    empty = F.lit("")
    named = docs.select(F.coalesce(F.col(lang).cast("string"), empty).alias("lang"), F.coalesce(F.col(source).cast("string"), empty).alias("source")).distinct()
    counted = kept.groupBy("lang", "source").agg(F.sum("n").alias("total"), F.count_if("first").alias("kinds"), F.count("*").alias("rows"))
    by_group = named.join(counted, ["lang", "source"], "left").na.fill(0, ["total", "kinds", "rows"])
    buckets = F.greatest(F.lit(1), F.ceil(F.sum("rows") / UNIT_ROWS)).cast("int").alias("buckets")
    by_lang = by_group.groupBy("lang").agg(F.sum("kinds").alias("kinds"), F.sum("total").alias("whole"), F.count("*").alias("sources"), buckets)
    groups = cut(by_group.select("lang", "source", "total").join(by_lang, "lang"))
    blocks = -(-(groups.agg(F.max("sources")).first()[0] or 1) // block)
    found = cut(partial_sums(kept, groups.drop("sources"), blocks, most))
    pairs = found.where("part = 'pair'").groupBy("lang", "source", "part", "item").agg(F.sum("value").alias("value"))
    rank = F.row_number().over(W.partitionBy("lang", "source", "part").orderBy(F.desc("value"), "item"))
    terms = found.where("part = 'term'").withColumn("rank", rank).where(F.col("rank") <= most)
    return pairs.withColumn("rank", rank).unionByName(terms)
