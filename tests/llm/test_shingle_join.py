"""The pipeline's near-dedup stage against all pairs of shingle sets."""

import os
import random
import sys

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__)))))

import numpy as np
import pytest

import corpus_pipeline
from clausegrid.llm import shingle_join as J, simhash


def brute(rows):
    sets = [J.shingles(J.words_of(t), 5) for _, t in rows]
    low = [i for i, _ in rows]
    while True:
        before = list(low)
        for k in range(len(rows)):
            for j in range(k):
                if J.jaccard(sets[k], sets[j]) >= 0.8:
                    low[k] = low[j] = min(low[k], low[j])
        if low == before:
            return sorted((i, c) for (i, _), c in zip(rows, low))


def edited_texts():
    rng = random.Random(3)
    words = [f"w{k}" for k in range(400)]
    texts = [None, "", "  ", "one two", "One  two", "one three"]
    for n in (6, 12, 60, 200, 900):
        base = rng.choices(words, k=n)
        for edits in (0, 1, 1, 2, max(1, n // 60), max(1, n // 45), max(1, n // 30)):
            t = list(base)
            for _ in range(edits):
                t[rng.randrange(n)] = rng.choice(words)
            texts.append(" ".join(t))
        texts += [" ".join(base[: n - 1]), " ".join(base + rng.choices(words, k=n // 5)), " ".join(rng.choices(words, k=n))]
    rng.shuffle(texts)
    return [(k, t) for k, t in enumerate(texts)]


@pytest.mark.parametrize("few,block", [(J.FEW, J.BLOCK), (1, 5), (0, 2)])
def test_near_duplicates_are_all_pairs(spark, few, block):
    rows = edited_texts()
    df = spark.createDataFrame(rows, "doc_id long, text string")
    assert sorted(map(tuple, simhash.similar(df, few=few, block=block).collect())) == brute(rows)
    assert simhash.similar(df.limit(0), few=few, block=block).count() == 0


def test_join_alone_finds_all_pairs(spark, monkeypatch):
    from clausegrid.llm.components import components

    monkeypatch.setattr(J, "COMMON", 2)  # nearly every shingle counts as common
    rows = [(i, t) for i, t in edited_texts() if t and t.strip()]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    found = dict(map(tuple, components(J.links(df, few=2, block=3)).collect()))
    mine = [(found.get(n := J.node_of(J.words_of(t)), n), c) for (_, t), (_, c) in zip(rows, brute(rows))]
    assert len({a for a, _ in mine}) == len({c for _, c in mine}) == len(set(mine))


def test_links_of_a_block_join_what_all_similar_pairs_join():
    rng = np.random.default_rng(7)
    for both in (False, True):
        base = [np.unique(rng.integers(0, 1 << 32, n).astype(np.uint32)) for n in (3, 40, 300)]
        sets = [np.unique(np.concatenate([b[rng.random(len(b)) < keep], rng.integers(0, 1 << 32, int(len(b) * (1 - keep))).astype(np.uint32)])) for b in base for keep in (1, 0.98, 0.95, 0.9, 0.85) for _ in range(8)]
        sets = [x for x in sets if len(x)]
        side, node = rng.integers(0, 2, len(sets)), np.arange(len(sets)) + 100
        pairs = [(i, j) for j in range(len(sets)) for i in range(j) if (not both or side[i] != side[j]) and J.jaccard(set(sets[i].tolist()), set(sets[j].tolist())) >= 0.8]
        a, b = J.near_pairs(node, node, side, sets, both, 0.8)

        def groups(edges):
            low = list(range(len(sets)))
            for _ in low:
                for i, j in edges:
                    low[i] = low[j] = min(low[i], low[j])
            return low

        got = list(zip((a - 100).tolist(), (b - 100).tolist()))
        assert groups(got) == groups(pairs) and len(got) < len(sets) <= len(pairs) and set(got) <= set(pairs)


def test_sketches_bound_the_difference_from_below():
    rng = np.random.default_rng(2)
    for n in (1, 5, 60, 700):
        a = np.unique(rng.integers(0, 1 << 63, n).astype(np.uint64))
        b = np.unique(np.concatenate([a[: n * 3 // 4], rng.integers(0, 1 << 63, 2 * n).astype(np.uint64)]))
        x, y = J.sketch(a), J.sketch(b)
        words = min(len(x), len(y))
        apart = int(np.bitwise_count(J.fold(x[None], words)[0] ^ J.fold(y[None], words)[0]).sum())
        assert apart <= len(np.setxor1d(a, b))


def test_stage_keeps_one_of_edited_copies(spark):
    rows = edited_texts()
    df = spark.createDataFrame(rows, "doc_id long, text string")
    kept = {r["doc_id"] for r in corpus_pipeline.by_near_duplicates(spark, df, "").collect()}
    assert kept == {c for _, c in brute(rows)}


def test_shingles_that_share_half_a_hash_lose_no_link(spark):
    """The hashes of w11232 and w109309 have 32 bits in common: A and B are 0.798 alike and must not stand in the way of B and C."""
    common, a, b = [f"c{k}" for k in range(71)], [f"a{k}" for k in range(8)] + ["w11232"], [f"b{k}" for k in range(8)] + ["w109309"]
    texts = [common + a, common + b, common + a[:4] + b[:5]]
    sets = [set(t) for t in texts]
    assert J.jaccard(sets[0], sets[1]) < 0.8 <= min(J.jaccard(sets[0], sets[2]), J.jaccard(sets[1], sets[2]))
    for order in ((0, 1, 2), (1, 2, 0), (2, 0, 1)):
        df = spark.createDataFrame([(k, " ".join(texts[i])) for k, i in enumerate(order)], "doc_id long, text string")
        for few in (0, J.FEW):
            assert {r["component_id"] for r in simhash.similar(df, width=1, few=few).collect()} == {0}


def test_blocks_follow_the_shingles_of_their_nodes(spark, monkeypatch):
    monkeypatch.setattr(J, "BLOCK_SHINGLES", 200)
    rows = edited_texts()
    df = spark.createDataFrame(rows, "doc_id long, text string")
    assert sorted(map(tuple, simhash.similar(df, few=0).collect())) == brute(rows)


def test_a_round_replaces_the_one_before(spark, tmp_path, monkeypatch):
    from clausegrid.llm import common
    from clausegrid.llm.components import components

    monkeypatch.setattr(common, "shared_checkpoints", lambda _: str(tmp_path))
    path = [(k, k + 1) for k in range(200)] + [(1000, 1001), (None, 3), (5, 5)]
    found = dict(map(tuple, components(spark.createDataFrame(path, "a long, b long")).collect()))
    assert found == {k: 0 for k in range(201)} | {1000: 1000, 1001: 1000}
    (folder,) = tmp_path.iterdir()
    assert len([x for x in folder.iterdir() if not x.name.startswith(".")]) == 1


def test_texts_that_share_a_line_alone_are_not_sent_to_blocks(spark, monkeypatch):
    """A shared line of a licence is fewer shingles than similar texts must share: no hashes of such texts go to the tasks."""
    rng = random.Random(8)
    words = [f"w{k}" for k in range(4000)]
    line = " ".join(f"licence{k}" for k in range(6))
    rows = [(k, " ".join([*rng.choices(words, k=24), line])) for k in range(40)]
    same = rng.choices(words, k=300)
    rows += [(100 + k, " ".join([*same[:k], f"x{k}", *same[k + 1 :]])) for k in range(12)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    sent = []
    kept = J.promising

    def spy(*args):
        out = kept(*args)
        sent.extend(r["node"] for r in out.select("node").distinct().collect())
        return out

    monkeypatch.setattr(J, "promising", spy)
    assert sorted(map(tuple, simhash.similar(df, few=0, block=8).collect())) == brute(rows)
    assert not {J.node_of(J.words_of(t)) for i, t in rows if i < 100} & set(sent)
