"""Quality rules: a suffix array over each text's words finds its repeated passages.

The suffixes of all texts of a slice are sorted together by prefix doubling; ranks start with the text's number, so
suffixes only ever match within their text. Only suffixes whose rank is still shared are sorted again.
The ranks kept from each doubling give the longest common prefix of neighbours in the suffix array. The value at
a suffix is the larger of its two: the depth of the innermost LCP interval that holds it, so
[i, i + value) is the longest repeat that starts at i. A repeat inside the one that starts a word earlier is not
left-maximal and adds nothing; the union of the others is the text's repeated part.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, types as T

from clausegrid.llm.common import map_columns

SYMBOLS = "#*$%&|<>"
#: Base rules: least words, words of a window, and the most repeated words in percent of all.
MIN_WORDS, WINDOW, MAX_REPEAT_PERCENT = 10, 5, 20
#: Suffix rules: repeats of at least SPAN words count; limits of their share of the words and of the longest.
SPAN, MAX_COVERED, MAX_LONGEST = 16, 0.1, 100
#: Suffixes sorted together.
CHUNK_WORDS = 400_000


def _group_starts(sorted_keys: np.ndarray) -> np.ndarray:
    """For each place of a sorted array the place of the first equal key."""
    new = np.empty(len(sorted_keys), bool)
    new[:1] = True
    np.not_equal(sorted_keys[1:], sorted_keys[:-1], out=new[1:])
    return np.maximum.accumulate(np.where(new, np.arange(len(sorted_keys)), 0))


def repeat_lengths(words: np.ndarray, offsets: np.ndarray, least: int = 1) -> np.ndarray:
    """For each word the length of the longest passage that starts there and also elsewhere in its text.

    words: word numbers of all texts, text t at offsets[t]:offsets[t + 1]. Lengths below `least` may come as 0.
    """
    n = len(words)
    if not n:
        return np.zeros(0, np.int64)
    doc = np.repeat(np.arange(len(offsets) - 1), np.diff(offsets))
    end = offsets[1:][doc]
    key = doc * np.int64(int(words.max()) + 1) + words
    order = np.argsort(key, kind="stable")
    rank = np.empty(n, np.int64)
    rank[order] = _group_starts(key[order])
    levels, step = [rank.astype(np.int32)], 1
    while True:
        shared = np.flatnonzero(np.bincount(rank, minlength=n)[rank] > 1)
        if not len(shared):
            break
        after = shared + step
        inside = after < end[shared]
        key = rank[shared] * np.int64(n + 1)
        key[inside] += rank[after[inside]] + 1
        by = np.argsort(key, kind="stable")
        shared, key = shared[by], key[by]
        olds = rank[shared]
        slots = olds + np.arange(len(shared)) - _group_starts(olds)
        rank[shared] = slots[_group_starts(key)]
        levels.append(rank.astype(np.int32))
        step *= 2
    suffixes = np.empty(n, np.int64)
    suffixes[rank] = np.arange(n)
    filter_level = min(len(levels) - 1, max(0, least.bit_length() - 1))
    a, b = suffixes[:-1], suffixes[1:]
    near = np.flatnonzero(levels[filter_level][a] == levels[filter_level][b])
    a, b = a[near], b[near]
    i, j, common = a.copy(), b.copy(), np.zeros(len(a), np.int64)
    for k in range(len(levels) - 1, -1, -1):
        ok = (i < end[a]) & (j < end[b])
        ok[ok] = levels[k][i[ok]] == levels[k][j[ok]]
        for x in (i, j, common):
            x[ok] += 1 << k
    longest = np.zeros(n, np.int64)
    np.maximum.at(longest, a, common)
    np.maximum.at(longest, b, common)
    return longest


def covered(longest: np.ndarray, least: int) -> np.ndarray:
    """Which words lie in a repeat of at least `least` words."""
    at = np.flatnonzero(longest >= least)
    change = np.zeros(len(longest) + 1, np.int64)
    np.add.at(change, at, 1)
    np.add.at(change, at + longest[at], -1)
    return np.cumsum(change[:-1]) > 0


def _sums(values: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    total = np.concatenate([[0], np.cumsum(values, dtype=np.int64)])
    return total[offsets[1:]] - total[offsets[:-1]]


def split_words(texts: pa.Array) -> tuple[pa.Array, np.ndarray]:
    """All words of the texts and where each text's words begin; null has none."""
    lists = pc.ascii_split_whitespace(pc.fill_null(texts.cast(pa.large_string()), ""))
    flat, ends = lists.flatten(), np.concatenate([[0], np.cumsum(pc.list_value_length(lists).to_numpy(zero_copy_only=False))])
    real = pc.greater(pc.binary_length(flat), 0).to_numpy(zero_copy_only=False)
    return flat.filter(pa.array(real)), np.concatenate([[0], np.cumsum(real)])[ends].astype(np.int64)


def line_duplicates(text: str) -> int:
    lines = [x for x in text.split("\n") if x.strip(" \t\n\v\f\r")]
    return len(lines) - len(set(lines))


class Rules:
    def __init__(self, span: int, max_covered: float, max_longest: int):
        self.span, self.max_covered, self.max_longest = span, max_covered, max_longest

    def repeats(self, words: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        longest, first = np.zeros(len(words), np.int64), 0
        while first < len(offsets) - 1:
            last = max(first + 1, int(np.searchsorted(offsets, offsets[first] + CHUNK_WORDS, "right")) - 1)
            a, b = offsets[first], offsets[last]
            longest[a:b] = repeat_lengths(words[a:b], offsets[first : last + 1] - a, min(WINDOW, self.span))
            first = last
        return longest

    def __call__(self, texts: pa.Array) -> list:
        flat, offsets = split_words(texts)
        words = pc.dictionary_encode(flat).indices.to_numpy(zero_copy_only=False).astype(np.int64) if len(flat) else np.zeros(0, np.int64)
        longest = self.repeats(words, offsets)
        n_words = np.diff(offsets)
        word_chars = _sums(pc.utf8_length(flat).to_numpy(zero_copy_only=False), offsets)
        plain = ["" if x is None else x for x in texts.to_pylist()]
        n_symbols = [sum(map(x.count, SYMBOLS)) for x in plain]
        n_dup = [line_duplicates(x) for x in plain]
        n_repeat = _sums(covered(longest, WINDOW), offsets)
        inside = covered(longest, self.span)
        n_inside = _sums(inside, offsets)
        starts = offsets[:-1][n_words > 0]
        most = np.zeros(len(plain), np.int64)
        if len(starts):
            most[n_words > 0] = np.maximum.reduceat(longest, starts)
        most[most < WINDOW] = 0
        fresh = np.zeros(len(longest) + 1, bool)
        fresh[offsets] = True
        before = np.concatenate([[False], inside])
        opens = np.flatnonzero(inside & (~before[:-1] | fresh[:-1]))
        closes = np.flatnonzero(inside & (~np.concatenate([inside[1:], [False]]) | fresh[1:])) + 1
        of = np.searchsorted(offsets, opens, "right") - 1
        spans = [[] for _ in plain]
        for t, a, b in zip(of.tolist(), (opens - offsets[of]).tolist(), (closes - offsets[of]).tolist()):
            spans[t].append({"start": a, "end": b})
        share = n_inside / np.maximum(1, n_words)
        failed = (n_words < MIN_WORDS) | (100 * n_repeat > MAX_REPEAT_PERCENT * n_words)
        kept = ~failed & (share <= self.max_covered) & (most <= self.max_longest)
        return [n_words, word_chars, pa.array(n_symbols, pa.int64()), pa.array(n_dup, pa.int64()), n_repeat, most, share, spans, failed, kept]


FIELDS = [
    *(T.StructField(c, T.LongType()) for c in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "longest_repeat")),
    T.StructField("covered_fraction", T.DoubleType()),
    T.StructField("repeat_spans", T.ArrayType(T.StructType([T.StructField("start", T.LongType()), T.StructField("end", T.LongType())]))),
    T.StructField("base_failed", T.BooleanType()),
    T.StructField("kept", T.BooleanType()),
]


def assess(docs: DataFrame, text: str = "text", keep: list[str] | None = None, span: int = SPAN, max_covered: float = MAX_COVERED, max_longest: int = MAX_LONGEST) -> DataFrame:
    """Adds the counts, the repeated spans (word positions, ends exclusive) and the verdict to each row.

    n_repeat_words counts words in WINDOW-word windows found twice or more; longest_repeat is the longest repeat of
    at least WINDOW words, else 0; covered_fraction is the share of words in repeats of at least `span` words, and
    repeat_spans is their union. kept: no base rule failed, covered_fraction is at most max_covered and
    longest_repeat at most max_longest. Null and empty texts have no words, fail the base rules and are not kept.
    Repeated rows each get their verdict; columns with the names of results are replaced. keep: columns that stay. A very long text is sorted by itself, in
    memory of its words times its doublings (the logarithm of its longest repeat) times four bytes. An empty table gives an empty table.
    """
    return map_columns(docs, [text], docs.columns if keep is None else keep, FIELDS, lambda: Rules(span, max_covered, max_longest))
