"""The hierarchy closure: ancestors up to the base statement, children of clause kinds with a text."""

from clausegrid.operators import evidence as E


def test_ancestors_and_clause_children(spark):
    rows = [("ac-1", "ac-1_smt", "a", "smt", "x"), ("ac-1_smt", "ac-1_smt.a", "a", "smt", "x"), ("ac-1_smt.a", "ac-1_smt.a.1", "1", "smt", "x"),
            ("ac-1_smt.a.1", "k1", "1", "smt", "x"), ("ac-1_smt.a.1", "k2", "2", "gdn", "x"), ("ac-1_smt.a.1", "k3", "3", "prm", "x"),
            ("ac-1_smt.a.1", "k4", "4", "smt", " "), ("ac-1_smt.a.1", "k5", "5", "smt", None), ("k1", "k6", "1", "gdn", "x"), ("k3", "k7", "1", "smt", "x")]
    edges = spark.createDataFrame(rows, "parent string, id string, label_key string, kind string, text string")
    seeds = spark.createDataFrame([(1, "ac-1_smt.a.1", 1), (2, "k6", 1)], "q long, id string, position int")
    got = {(r["q"], r["id"], r["level"]) for r in E.closure(seeds, edges).collect()}
    assert got == {(1, "ac-1_smt.a.1", 0), (1, "ac-1_smt.a", -1), (1, "ac-1_smt", -2), (1, "k1", 1), (1, "k2", 1), (1, "k6", 2),
                   (2, "k6", 0), (2, "k1", -1), (2, "ac-1_smt.a.1", -2), (2, "ac-1_smt.a", -3), (2, "ac-1_smt", -4)}


def test_chains_of_any_depth_are_one_plan(spark):
    depth = 130
    edges = spark.createDataFrame([(f"a{k}", f"a{k + 1}") for k in range(depth)] + [("a0", "side")], "parent string, id string")
    seeds = spark.createDataFrame([(1, f"a{depth}"), (1, "a3"), (2, "side"), (3, "none")], "q long, id string")
    got = E.ancestors(seeds, edges)
    want = {(1, f"a{k}"): min(depth - k, 3 - k if k <= 3 else depth) for k in range(depth + 1)} | {(2, "side"): 0, (2, "a0"): 1, (3, "none"): 0}
    assert {(r["q"], r["id"]): r["up"] for r in got.collect()} == want
