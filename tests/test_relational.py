"""Orders, pairs, corpus walks without limits, reports, searches in blocks and intervals."""

import json

import numpy as np
import pytest
from pyspark.sql import functions as F

from clausegrid.operators import blocks, corpus as C, metrics as M, relational as A, retrieval as R
from clausegrid.sources import scans as S, sinks as K


def test_positions_are_gapless(spark):
    rows = spark.range(0, 1000, 1, 7).select((F.col("id") % 37).alias("b"), F.col("id").alias("c"))
    got = [(r["b"], r["c"]) for r in A.positions(rows, [F.asc("b"), F.desc("c")]).orderBy("position").collect()]
    assert got == sorted(got, key=lambda x: (x[0], -x[1]))
    assert A.positions(rows.limit(0), [F.asc("b")]).count() == 0


def test_pairs_of_repeated_keys_are_an_error(spark):
    a, b = spark.createDataFrame([(1,), (2,)], "k long"), spark.createDataFrame([(1,), (1,)], "k long")
    assert A.inner_paired(a, a, "k").count() == 2
    with pytest.raises(Exception, match="missing or repeated key"):
        A.inner_paired(a, b, "k").collect()


def deep(n):
    return {"id": f"n{n}", "prose": f"p{n}", "parts": [deep(n - 1)] if n > 1 else []}


def test_walks_have_no_limit_of_depth_or_width(spark):
    wide = {"id": "w", "parts": [{"id": f"c{k}", "prose": f"{k}"} for k in range(10_001)]}
    rows = spark.createDataFrame([(1, json.dumps(deep(12))), (2, json.dumps(wide))], "catalog long, json string")
    nodes = C.walk(rows, "parts")
    assert nodes.where("catalog = 1").count() == 12 and nodes.where("catalog = 2").select("path").distinct().count() == 10_002
    below = {r["path"]: r["below"] for r in C.descendant_prose(nodes.where("catalog = 2")).collect()}
    assert below[""].split(" ") == [str(k) for k in range(10_001)]
    assert C.levels(spark.createDataFrame([('{"a": "}{\\\\", "b": {"c": 1}}',)], "json string")) == 2


def test_reports_have_all_rows(spark):
    assert K.markdown(spark.range(1000)).count("\n") == 1001


def test_tokens_of_batches_are_those_of_columns(spark):
    import pyarrow as pa

    from clausegrid.functions.text import tokenize

    texts = ["", None, "Ab-1 c", "é Ünï x2y", " lead", "trail ", "...", "a", "B", "İK\u212a 3\u0663 \u00b3\u00b9\u00f3", "x\ny"]
    rows = spark.createDataFrame([(k, t) for k, t in enumerate(texts)], "k int, t string").orderBy("k").select(tokenize(F.col("t")).alias("w")).collect()
    tokens, bounds = blocks.ascii_tokens(pa.array(["dropped", *texts]).slice(1))
    assert [tokens.to_pylist()[a:b] for a, b in zip(bounds, bounds[1:])] == [r["w"] for r in rows]
    assert blocks.ascii_tokens(pa.array([], pa.string()))[1].tolist() == [0]


def test_whole_texts_are_found(spark):
    docs = spark.createDataFrame([(1, "x one two three four five six seven y"), (2, "one two three four five six eight"), (3, None), (4, "only few here"), (5, "aone two three four five six sevenb")], "id long, text string")
    parts = spark.createDataFrame([(1, "one two three four five six seven"), (2, "few"), (3, "one two three four five six nine")], "q long, text string")
    assert sorted(map(tuple, R.containing(parts, docs).collect())) == [(1, 1), (1, 5), (2, 4)]


def test_only_the_best_leave_a_task(spark):
    rng = np.random.default_rng(4)
    best = blocks.Best(3, 4)
    scores, ids = np.round(rng.random((500, 3)), 2), rng.permutation(500)
    best.limit = 20
    for at in range(0, 500, 50):
        best.add(scores[at : at + 50], ids[at : at + 50])
    query, got, _ = best.result()
    for q in range(3):
        assert got[query == q].tolist() == sorted(ids.tolist(), key=lambda i: (-scores[list(ids).index(i), q], i))[:4]
    assert blocks.Best(2, 3).result() is None


def test_text_ids_and_empty_tables_are_ranked(spark):
    docs = spark.createDataFrame([("b", "x y"), ("a", "x y"), ("aa", "x"), ("c", None)], "id string, text string")
    q = spark.createDataFrame([(1, "x"), (2, "")], "q long, text string")
    rows = sorted((r["q"], r["rank"], r["id"]) for r in R.bm25_top(q, docs, 3).collect())
    assert rows == [(1, 1, "aa"), (1, 2, "a"), (1, 3, "b"), (2, 1, "a"), (2, 2, "aa"), (2, 3, "b")]
    assert R.bm25_top(q.limit(0), docs, 3).count() == 0 and R.overlap_top(q, docs.limit(0), 3).count() == 0


def test_blocks_of_queries_change_nothing(spark, monkeypatch):
    rng = np.random.default_rng(6)
    text = lambda n: " ".join(f"t{k}" for k in rng.integers(0, 30, n))
    docs = spark.createDataFrame([(k, text(20)) for k in range(80)], "id long, text string").repartition(3)
    q = spark.createDataFrame([(k, text(5)) for k in range(11)], "q long, text string")
    whole = sorted(map(tuple, R.bm25_top(q, docs, 6).collect()))
    monkeypatch.setattr(blocks, "BLOCK_BYTES", 8 * 30 * 4)
    monkeypatch.setattr(blocks, "TOGETHER", 16)
    assert sorted(map(tuple, R.bm25_top(q, docs, 6).collect())) == whole
    pairs = R.ranked(R.bm25_scores(q, docs), ["q"], [F.desc("score"), F.col("id")], most=6)
    assert sorted((r["q"], r["id"], r["score"], r["rank"]) for r in pairs.collect()) == sorted((a, b, c, d) for a, b, c, d in whole if c > 0)


def test_newcombe_and_holm(spark):
    low, high = M.newcombe_paired(*(F.lit(x) for x in (20, 12, 2, 16)))
    r = spark.range(1).select(low.alias("low"), high.alias("high")).first()
    assert r["low"] < 0.2 < r["high"] and r["low"] > 0  # 32 of 50 against 22 of 50
    assert (r["low"], r["high"]) == pytest.approx((0.0562, 0.3290), abs=5e-4)
    p = spark.createDataFrame([("a", 0.01), ("b", 0.04), ("c", 0.03), ("d", 0.5)], "k string, p double")
    got = {r["k"]: r["adjusted"] for r in M.holm(p, [], "p", "k").collect()}
    assert got == pytest.approx({"a": 0.04, "c": 0.09, "b": 0.09, "d": 0.5})


def test_profiles_without_the_library(monkeypatch):
    text = 'odp_values:\n  a: "x: y"  # c\n  b: 3\nname: n\n'
    assert dict(S.profile_values(text)) == {"a": "x: y", "b": "3"}
    monkeypatch.setattr(S, "yaml", None)
    assert dict(S.profile_values(text)) == {"a": "x: y", "b": "3"} and S.profile_values("- [") == []


def test_unreadable_folders_are_no_empty_ones(spark, tmp_path):
    (tmp_path / "t").mkdir()
    (tmp_path / "t" / "part-0.parquet").write_bytes(b"no parquet")
    with pytest.raises(Exception):
        K.append_remaining(spark.range(3), str(tmp_path / "t"), "id")
