"""Operators on small tables whose results are known."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from clausegrid.config import RANK, WINDOW
from clausegrid.operators import corpus as C, evidence as E, metrics as M, mutate as X, provenance as H, retrieval as R, verify as V

def val(spark, column):
    return spark.range(1).select(column.alias("v")).first()["v"]


def test_bm25_repeats_query_terms_and_fills_with_zero_scores(spark):
    docs = spark.createDataFrame([(1, "a b b c"), (2, "a a"), (3, "z"), (4, "")], "id long, text string")
    q = spark.createDataFrame([(1, "b b a"), (2, "none")], "q long, text string")
    rows = {(r["q"], r["id"]): r for r in R.bm25_top(q, docs, 3).collect()}
    avg, n = 7 / 4, 4
    idf = lambda df: math.log((n - df + 0.5) / (df + 0.5) + 1)
    part = lambda tf, dl: tf * 2.5 / (tf + 1.5 * (0.25 + 0.75 * dl / avg))
    assert rows[1, 1]["score"] == pytest.approx(2 * idf(1) * part(2, 4) + idf(2) * part(1, 4), abs=1e-6)
    assert [rows[1, k]["rank"] for k in (1, 2, 3)] == [1, 2, 3] and rows[1, 3]["score"] == 0
    assert [rows[2, k]["rank"] for k in (1, 2, 3)] == [1, 2, 3]


def test_dense_search_in_blocks(spark):
    rng = np.random.default_rng(3)
    v = rng.normal(size=(200, 8))
    df = spark.createDataFrame([(k, x.tolist()) for k, x in enumerate(v)], "id long, v array<double>").repartition(3)
    got = R.dense_top(df.where("id % 20 = 0").select(F.col("id").alias("q"), "v"), df, 5, query_block=3).collect()
    for q in range(0, 200, 20):
        order = sorted(range(200), key=lambda k: (-round(float(v[q] @ v[k]), 9), k))[:5]
        assert [r["id"] for r in sorted((r for r in got if r["q"] == q), key=lambda r: r["rank"])] == order


def test_gates_of_the_reranker(spark):
    fused = spark.createDataFrame([(1, 10, 0.5), (1, 11, 0.1), (2, 10, 0.50), (2, 11, 0.49), (3, 10, 0.5), (3, 11, 0.49), (3, 12, 0.1)], "q long, id long, score double")
    pred = spark.createDataFrame([(1, 11, 9.0), (2, 10, 1.0), (2, 11, 1.5), (3, 10, 1.0), (3, 11, 9.0)], "q long, id long, pred double")
    rows = {(r["q"], r["id"]): r for r in R.rerank(fused, pred, RANK).collect()}
    assert not rows[1, 10]["called"] and rows[1, 10]["final_rank"] == 1
    assert rows[2, 10]["called"] and rows[2, 10]["blend"] == pytest.approx(0.65) and rows[2, 11]["blend"] == pytest.approx(0.35)
    assert rows[3, 12]["final_rank"] == 3 and rows[3, 12]["blend"] is None


def test_control_gate_counts_repeats_and_missing_margins(spark):
    arr = F.array(*map(F.lit, ("AC-1", "AU-1", "AC-1", "CM-1")))
    assert val(spark, E.allowed_controls(arr, F.lit(0.01)))["allowed"] == ["AC-1", "AU-1", "AC-1"]
    assert val(spark, E.allowed_controls(arr, F.lit(0.05)))["allowed"] == ["AC-1", "AU-1"]
    g = val(spark, E.allowed_controls(arr, F.lit(None).cast("double")))
    assert g["allowed"] == ["AC-1"] and g["tier"] == 0


def window(spark, margin, cap=3):
    docs = spark.createDataFrame([(1, 1, "b_smt", "B-1", "smt", "b"), (1, 2, "a_gdn", "A-1", "gdn", "g"), (1, 3, "a_smt", "A-1", "smt", "s"), (1, 4, "b_gdn", "B-1", "gdn", "h"), (1, 5, "a_x", "A-1", "smt", " ")], "q long, position int, id string, control_id string, kind string, text string")
    gates = spark.createDataFrame([(1, ["A-1", "B-1"], "A-1", margin)], "q long, allowed array<string>, primary string, margin double")
    return E.evidence_window(docs, gates, type(WINDOW)(cap=cap))


def test_window_order_and_manifest(spark):
    ids = lambda w: [r["id"] for r in sorted(w.collect(), key=lambda r: r["position"])]
    assert ids(window(spark, 0.1)) == ["a_smt", "b_smt", "a_gdn"]
    assert ids(window(spark, None)) == ["b_smt", "a_smt", "a_gdn"]
    a, b = E.manifests(window(spark, 0.1)).first(), E.manifests(window(spark, None)).first()
    assert a["sha256"] != b["sha256"] and a["n"] == 3
    import hashlib
    import json

    records = [{"position": str(k), "source_id": i, "text_sha256": hashlib.sha256(t.encode()).hexdigest()} for k, (i, t) in enumerate([("a_smt", "s"), ("b_smt", "b"), ("a_gdn", "g")])]
    assert a["sha256"] == hashlib.sha256(json.dumps(records, sort_keys=True, separators=(",", ":")).encode()).hexdigest()


def contract(spark, status, answer, required, spans):
    h = spark.createDataFrame([(1, status, answer, required)], "q long, status string, answer string, required array<string>")
    s = spark.createDataFrame([(1, k, *x) for k, x in enumerate(spans)], "q long, position int, source_id string, span_text string")
    corpus = spark.createDataFrame([("ac-1_smt", "Keep {{ insert: param, ac-01_odp.01 }}  safe"), ("ac-2_smt", "Plain text")], "id string, text string")
    return V.contract_validity(h, s, corpus).first()["tags"]


def test_contract_validity(spark):
    text = "Keep {{ insert: param, ac-01_odp.01 }} safe"
    assert contract(spark, "PARAMS_REQUIRED", text, ["ac-01_odp.01"], [("corpus:AC-1_SMT", text)]) == []
    assert contract(spark, "OK", "x", [], [("missing_smt", "x")]) == ["UnknownSourceId"]
    assert contract(spark, "OK", "x", [], []) == ["MissingEvidenceSpans"]
    assert contract(spark, "OK", "x", [], [("ac-2_smt", "changed")]) == ["SpanNotVerbatim"]
    assert contract(spark, "odd", "x", [], []) == ["InvalidStatus", "UnknownStatus"]
    assert contract(spark, "NO_EVIDENCE", "x", [], [("", "")]) == ["MissingSourceId", "NoEvidenceButAnswerTextNonEmpty", "NoEvidenceButHasSpans", "NoEvidenceButSpansProvided"]


def test_parameter_list_is_only_checked_for_emptiness(spark):
    text = "{{ insert: a }} {{ insert: b }}"
    assert val(spark, V.status_tags(F.lit("PARAMS_REQUIRED"), F.lit(text), F.array().cast("array<string>"), F.array(F.lit("a")))) == []


def test_statistics(spark):
    assert val(spark, M.mcnemar_exact(F.lit(18), F.lit(9))) == pytest.approx(0.122078, abs=1e-6)
    assert val(spark, M.mcnemar_exact(F.lit(10), F.lit(3))) == pytest.approx(0.092285, abs=1e-6)
    assert val(spark, M.mcnemar_exact(F.lit(46), F.lit(2))) == pytest.approx(8.36309e-12, rel=1e-4)
    assert val(spark, M.mcnemar_exact(F.lit(0), F.lit(0))) == 1.0 and val(spark, M.mcnemar_exact(F.lit(1200), F.lit(1100))) < 0.05
    assert val(spark, M.fisher_exact(F.lit(3), F.lit(1), F.lit(1), F.lit(3))) == pytest.approx(0.485714, abs=1e-6)
    low, high = M.wilson(F.lit(8.0), F.lit(10.0))
    assert (val(spark, low), val(spark, high)) == (pytest.approx(0.490162, abs=1e-5), pytest.approx(0.943318, abs=1e-5))
    rows = spark.createDataFrame([(1, 1)] * 20 + [(1, 0)] * 5 + [(0, 1)] * 10 + [(0, 0)] * 15, "a int, b int")
    assert M.kappa(rows, "a", "b").first()["kappa"] == pytest.approx(0.4)
    ranks = spark.createDataFrame([(1,), (0,), (2,), (11,)], "rank int").withColumn("g", F.lit(1))
    m = M.ranking_metrics(ranks, ["g"]).first()
    assert (m["s1"], m["s5"], m["mrr10"]) == (0.25, 0.5, 0.375) and m["ndcg10"] == pytest.approx((1 + 1 / math.log2(3)) / 4)


def test_bootstrap_holds_the_mean(spark):
    rows = spark.createDataFrame([("x", k, float(k % 3 - 1)) for k in range(300)] + [("y", 1, None), ("y", 2, 1.0)], "g string, k long, d double")
    got = {r["g"]: r for r in M.bootstrap(rows, "d", ["g"], "k", draws=2002).collect()}
    assert got["x"]["low"] < got["x"]["mean"] < got["x"]["high"] and got["y"]["n"] == 1 and got["y"]["low"] == 1.0
    # the ends are where the normal approximation has them, and do not depend on the partitions
    half = 1.96 * (2 / 3 / 300) ** 0.5
    assert abs(got["x"]["low"] + half) < 0.15 * half and abs(got["x"]["high"] - half) < 0.15 * half
    assert {r["g"]: r for r in M.bootstrap(rows.repartition(7), "d", ["g"], "k", draws=2002).collect()}["x"] == pytest.approx(got["x"])


def test_mutations(spark):
    ids = spark.createDataFrame([(f"id{k:03d}",) for k in range(57)], "id string").repartition(5)
    spans = ids.select(F.col("id").alias("source_id"), F.lit(1).alias("q"))
    got = {r["source_id"] for r in X.swap_source(spans, ids).collect()}
    assert got == {f"id{k:03d}" for k in range(57)}
    assert X.swap_source(spans.where("source_id = 'id056'"), ids).first()["source_id"] == "id000"
    assert X.by_modulo(spark.createDataFrame([(58,), (1,)], "q long"), ids).select("id").distinct().first()["id"] == "id000"
    assert val(spark, X.alter_first(F.lit("  -z9"))) == "  -a9" and val(spark, X.drop_last(F.array(F.lit("a"), F.lit("b")))) == ["a"]


def test_hashes(spark):
    a = val(spark, H.canonical_hash(b=F.lit(1), a=F.lit("x\x01")))
    b = val(spark, H.exact_hash(F.lit('{"b":1,"a":"x"}')))
    c = val(spark, H.canonical_hash(b=F.lit(1), a=F.lit("x")))
    assert b == c and a != c


def test_catalog_walk(spark):
    j = '{"groups":[{"id":"g","controls":[{"id":"AC-1","title":"t","parts":[{"name":"item","parts":[{"id":"AC-1_smt.a","label":"a.","prose":"do"},{"id":"ac-1_SMT.A","prose":"again"}]},{"id":"AC-1_smt","parts":[{"id":"AC-1_smt.b","label":"b.","prose":"x"},{"id":"AC-1_smt.c","label":"c.","prose":"y"}]}]}]}]}'
    nodes = C.walk(spark.createDataFrame([(1, j)], "catalog long, json string"), "parts")
    parents = {r["id"]: r["parent"] for r in nodes.where("id IS NOT NULL").collect()}
    assert parents["AC-1_smt.a"] == "AC-1" and parents["AC-1_smt.b"] == "AC-1_smt" and parents["AC-1"] == "g"
    text = {r["id"]: r["text"] for r in C.emit_clauses(nodes).collect()}
    assert text == {"ac-1_smt.a": "do", "ac-1_smt": "b. x c. y", "ac-1_smt.b": "x", "ac-1_smt.c": "y"}


def test_empty_tables(spark):
    none = spark.createDataFrame([], "q long, id long, text string, score double, pred double")
    assert R.bm25_top(none.select("q", "text"), none.select("id", "text"), 3).count() == 0
    assert R.rerank(none.select("q", "id", "score"), none.select("q", "id", "pred")).count() == 0


def test_conditions_are_rows_of_one_plan(spark, tmp_path):
    import random
    from dataclasses import replace

    rng = random.Random(6)
    fused = spark.createDataFrame([(q, i, round(rng.choice([0.5, 0.52, 0.9]) - 0.02 * i * rng.random(), 4)) for q in range(12) for i in range(6)], "q long, id long, score double")
    pred = spark.createDataFrame([(q, i, rng.random()) for q in range(12) for i in range(6) if rng.random() < 0.8], "q long, id long, pred double")
    path = str(tmp_path / "channels")
    digest = R.capture(fused, pred, path)
    channels = R.replay(spark, path, digest)
    configs = {"base": RANK, "other": replace(RANK, blend=0.1, skip_margin=0.01), "textless": replace(RANK, drop_textless=True)}
    every = R.rerank_each(channels, [(n, g, c if g else R.without_gates(c)) for n, c in configs.items() for g in (True, False)])
    columns = ["q", "id", "called", "blend", "rerank_rank", "rerank_margin", "applied", "final_rank", "final_margin"]
    for n, c in configs.items():
        for g in (True, False):
            alone = R.rerank(fused, pred, c if g else R.without_gates(c)).select(*columns)
            assert sorted(map(str, alone.collect())) == sorted(map(str, every.where((F.col("condition") == n) & (F.col("gated") == g)).select(*columns).collect()))
    gold = spark.createDataFrame([(q, 0) for q in range(11)], "q long, gold long")
    grid = R.sensitivity(channels, gold, configs).collect()
    assert len(grid) == 36 and all(not r["prevented_error"] and not r["blocked_correction"] for r in grid if r["q"] == 11 or r["stage"] == "none")
    assert {r["stage"] for r in grid} <= {"skip", "adoption", "none"} and all(r["rank"] == 1 for r in grid if r["q"] < 11 and r["id"] == 0)
    channels.withColumn("pred", F.col("pred") + 0.5).write.parquet(path + "2")
    with pytest.raises(ValueError):
        R.replay(spark, path + "2", digest)
    assert H.table_digest(channels.repartition(5)) == digest


def test_exact_tails_of_any_size(spark):
    from fractions import Fraction

    def mcnemar(b, c):
        n, m = b + c, min(b, c)
        return 1.0 if n == 0 else min(1.0, float(2 * Fraction(sum(math.comb(n, i) for i in range(m + 1)), 2**n)))

    def fisher(a, b, c, d):
        r, k, n = a + b, a + c, a + b + c + d
        p = lambda x: math.comb(k, x) * math.comb(n - k, r - x) / math.comb(n, r)
        return min(1.0, sum(q for x in range(max(0, r + k - n), min(r, k) + 1) if (q := p(x)) <= p(a) * (1 + 1e-12) + 1e-15))

    tables = [(3, 1, 1, 3), (10, 2, 3, 15), (0, 5, 5, 0), (100, 50, 60, 90), (0, 0, 0, 0), (5, 0, 0, 0), (1, 2, 3, 4), (50, 50, 50, 50), (500, 300, 280, 420), (7, 0, 3, 2), (0, 9, 1, 0)]
    large = (10**9, 10**9 + 50_000, 10**9, 10**9)
    df = spark.createDataFrame([*tables, large], "a long, b long, c long, d long")
    got = df.select("a", "b", "c", "d", M.mcnemar_exact(F.col("b"), F.col("c")).alias("m"), M.fisher_exact(*map(F.col, "abcd")).alias("f")).collect()
    for r in got[:-1]:
        assert r["m"] == pytest.approx(mcnemar(r["b"], r["c"]), abs=1e-12) and r["f"] == pytest.approx(fisher(r["a"], r["b"], r["c"], r["d"]), abs=1e-12)
    # so large that the normal approximation with its correction is as good
    b, c = large[1], large[2]
    assert got[-1]["m"] == pytest.approx(math.erfc((abs(b - c) - 1) / math.sqrt(2 * (b + c))), rel=1e-4)
    assert 0.2 < got[-1]["f"] < 0.5


def test_values_are_computed_once_and_only_those_asked_for(spark):
    """What several places or every element of a list name is in the plan once; a profile's other values are not looked at."""
    from clausegrid.functions import text as X
    from clausegrid.operators import audit as U, verify as V
    from clausegrid.plans.fixtures import spread

    def plan(c):
        return spark.range(1).select(F.col("id").cast("string").alias("x")).select(c.alias("r"))._jdf.queryExecution().analyzed().toString()

    assert plan(X.retrieval_query(F.col("x"))["query"]).count("kindly") == 1
    labels = F.array(F.struct(F.lit("p").alias("place"), F.col("x").alias("value")))
    assert plan(V.revision_tags(F.col("x"), F.col("x"), labels)).count("800[") == 1
    spans = F.array(F.struct(F.lit("a").alias("source_id"), F.lit("{{ insert: param, k }} and {{ insert: param, other }}").alias("span_text")))
    values = F.create_map(F.lit("k"), F.lit("v"), F.lit("unused"), F.lit("w"))
    assert "map_filter" not in plan(U.profile_resolution(spans, values, F.lit("rev5"), F.col("x"))).lower()
    r = spark.range(1).select(U.profile_resolution(spans, values, F.lit("rev5"), F.lit("rev5")).alias("r")).first()["r"]
    assert (r["answer"], r["required"], r["record"]["unresolved_param_ids"]) == ("v and {{ insert: param, other }}", ["other"], ["other"])
    # one split of a table becomes tasks for all cores
    assert spread(spark.range(10).coalesce(1), "id").rdd.getNumPartitions() == 4 * spark.sparkContext.defaultParallelism


def test_widths_need_no_lists_and_sources_are_resolved_once(spark):
    docs = spark.createDataFrame([(1, 1, "A", "smt"), (1, 2, "B", "obj"), (1, 3, "A", "gdn"), (2, 1, "C", "obj"), (2, 2, "D", "smt"), (3, 1, None, "smt")], "q long, position int, control_id string, kind string")
    swept = E.width_sweep(docs, (1, 2))
    assert sorted(map(tuple, swept.collect())) == [(1, 1, 2), (2, 2, 3)]
    spans = spark.createDataFrame([(1, 1, "X:a"), (1, 2, "A"), (2, 1, "a"), (2, 2, None), (3, 1, "A")], "q long, position int, source_id string")
    corpus = spark.createDataFrame([("a", "one"), ("b", "two")], "id string, text string")
    rows = V.resolve_sources(spans, corpus)
    assert sorted(tuple(r) for r in rows.select("q", "position", F.coalesce("matched", F.lit(""))).collect()) == [(1, 1, "a"), (1, 2, "a"), (2, 1, "a"), (2, 2, ""), (3, 1, "a")]
    plan = rows._jdf.queryExecution().optimizedPlan().toString()
    assert "collect_list" not in swept._jdf.queryExecution().optimizedPlan().toString() and "posexplode" in plan and "[q" not in plan.split("min_by")[0].split("Aggregate")[-1].split("]")[0]


def test_citations_are_not_joined_with_themselves(spark):
    from clausegrid.plans.registry import queries

    rows = queries()["x06_mutation_summary"](spark, "/root/testdata/sf0.001")
    assert rows._jdf.queryExecution().optimizedPlan().toString().count("l_linenumber") and rows._jdf.queryExecution().optimizedPlan().toString().count("Window [") == 1
