"""Rankings that leave out what cannot be among the best, against scores of everything."""

import numpy as np
import pytest

from clausegrid.operators import blocks as B


def corpus(seed, n_rows, n_terms, alike):
    """Postings of documents; with alike = False a few documents have much higher weights than the rest."""
    rng = np.random.default_rng(seed)
    p = 1 / np.arange(1, n_terms + 1)
    rows = [np.unique(rng.choice(n_terms, rng.integers(0, 12), p=p / p.sum())) for _ in range(n_rows)]
    row, term = np.repeat(np.arange(n_rows), [len(r) for r in rows]), np.concatenate(rows)
    weight = 1 + rng.random(len(row)) if alike else np.where(rng.random(len(row)) < 0.1, 10.0, 0.1) * (1 + rng.random(len(row)))
    return row, term, weight


@pytest.mark.parametrize("alike", [True, False])
@pytest.mark.parametrize("width", [64, 1000])
def test_impacts_give_the_best_and_skip_postings(alike, width):
    n_rows, n_terms, n = 4000, 120, 10
    row, term, weight = corpus(3, n_rows, n_terms, alike)
    rng, dense = np.random.default_rng(1), np.zeros((n_rows, n_terms))
    dense[row, term] = weight
    looked = there = 0
    for _ in range(25):
        terms = np.unique(rng.integers(0, 30, 6))
        values = rng.random(len(terms)) + 0.5
        best = B.Best(1, n)
        for a in range(0, n_rows, width):
            own = (row >= a) & (row < a + width)
            block, floor = B.Impacts(row[own] - a, term[own], weight[own], min(width, n_rows - a), n_terms), best.floor[0] - 1e-6
            there += int(np.isin(term[own], terms).sum())
            if block.bounds(np.zeros(len(terms), np.int64), terms, values, 1)[0] >= floor:
                rows, scores = block.best(terms, values, float(floor))
                best.add(np.zeros(len(rows), np.int64), rows + a, np.round(scores, 6))
                best.settle()
            looked += block.looked
        scores = np.round(dense[:, terms] @ values, 6)
        order = np.lexsort((np.arange(n_rows), -scores))[:n]
        query, ids, found = best.result()
        assert ids.tolist() == order.tolist() and found.tolist() == scores[order].tolist()
    assert looked < (1.2 if alike or width == 64 else 0.8) * there


def test_a_block_without_postings_or_known_terms():
    none = np.zeros(0, np.int64)
    block = B.Impacts(none, none, np.zeros(0), 5, 3)
    for floor in (-np.inf, 0.5):
        assert [len(x) for x in block.best(np.array([0, 2]), np.ones(2), floor)] == [0, 0]


@pytest.mark.parametrize("clusters, most", [(True, 0.3), (False, 1.0)])
def test_balls_give_the_best_and_skip_vectors(clusters, most):
    rng = np.random.default_rng(2)
    centres = rng.normal(size=(20, 24))
    x = centres[rng.integers(0, 20, 6000)] + rng.normal(size=(6000, 24)) * 0.05 if clusters else rng.normal(size=(6000, 24))
    x = np.concatenate([x, x[:200]])  # ties
    x /= np.sqrt((x**2).sum(axis=1))[:, None]
    queries, best, scored = x[:40], B.Best(40, 10), 0
    for a in range(0, len(x), 3000):
        balls = B.Balls(x[a : a + 3000])
        balls.look(queries, np.arange(a, min(a + 3000, len(x))), best, 9)
        scored += balls.scored
    query, ids, scores = best.result()
    for k, q in enumerate(queries):
        full = np.round(x @ q, 9)
        assert ids[query == k].tolist() == np.lexsort((np.arange(len(x)), -full))[:10].tolist()
    assert scored <= most * len(x) * len(queries)


def test_balls_of_copies_and_single_vectors():
    for x in (np.ones((300, 3)), np.zeros((1, 3)), np.arange(6.0).reshape(2, 3)):
        best = B.Best(1, 4)
        B.Balls(x).look(np.ones((1, 3)), np.arange(len(x)), best, 9)
        assert best.result()[1].tolist() == np.lexsort((np.arange(len(x)), -(x @ np.ones(3))))[:4].tolist()


def test_tasks_hold_bounded_parts(monkeypatch):
    """Rows are tokenized and bounded together by what they weigh, not by their number: long texts do not gather in a task."""
    from clausegrid.operators import blocks

    assert list(blocks.parts_of(np.array([5, 5, 30, 1, 1, 1, 1]), 10, 3)) == [(0, 2), (2, 3), (3, 6), (6, 7)]
    assert list(blocks.parts_of(np.zeros(0, np.int64), 10, 3)) == []
    best = blocks.Best(2, 1)
    best.add(np.array([[0.5, 0.1], [0.2, 0.9]]), np.array([7, 8]))
    assert [x.tolist() for x in best.result()] == [[0, 1], [7, 8], [0.5, 0.9]]


def most_letters(queries, docs, n, least=5):
    """(q, group, id, pred, tie, rank), by looking at every pair."""
    out, asked = [], {}
    for q, text in queries:
        asked[q] = asked.get(q, set()) | {t for t in text.split() if len(t) >= least}
    for q, terms in asked.items():
        groups = {}
        for id_, text, group, tie in docs:
            pred = sum(len(t) for t in terms & set((text or "").split()))
            if pred and id_ is not None:
                groups.setdefault(group, []).append((-pred, tie is None, -(tie or 0), id_, tie))
        out += [(q, g, r[3], float(-r[0]), r[4], k) for g, rows in groups.items() for k, r in enumerate(sorted(rows, key=lambda r: r[:4])[:n], 1)]
    return sorted(out, key=repr)


@pytest.mark.parametrize("held, postings, many", [(1 << 20, 1 << 19, False), (50, 40, False), (50, 40, True)])
def test_selection_in_groups_is_that_of_all_pairs(spark, monkeypatch, held, postings, many):
    """Ties, nulls and many groups; with small bounds tasks hand their rows on several times."""
    from clausegrid.operators import retrieval as R

    monkeypatch.setattr(B, "HELD", held)
    monkeypatch.setattr(B, "POSTINGS", postings)
    rng, words = np.random.default_rng(5), ["alpha", "stone", "rivers", "of", "mountain", "seven", "tree"]
    text = lambda k: " ".join(rng.choice(words, k))
    docs = [(k, text(rng.integers(0, 6)), f"s{k if many else k % 3}" if k % 5 else None, int(rng.integers(0, 3)) if k % 7 else None) for k in range(400)]
    docs += [(None, "alpha stone", "s1", 9), (400, None, "s1", 9), (401, "alpha", "s1", -(1 << 63))]
    queries = [(1, "alpha stone"), (1, "alpha rivers"), (2, "of tree"), (3, "mountain seven alpha"), (None, "stone")] + [(k, text(3)) for k in range(4, 20)]
    rows = R.select_in_groups(spark.createDataFrame(queries, "q long, text string"), spark.createDataFrame(docs, "id long, text string, g string, n long"), 4, "g", "n")
    assert sorted(map(tuple, rows.select("q", "g", "id", "pred", "n", "rank").collect()), key=repr) == most_letters(queries, docs, 4)


def test_selection_in_groups_of_text_ids_or_without_terms(spark):
    from clausegrid.operators import retrieval as R

    docs = spark.createDataFrame([("b", "alpha", 1, 2), ("a", "alpha", 1, 2), ("aa", "alpha beta1", 2, None)], "id string, text string, g int, n int")
    queries = spark.createDataFrame([(1, "alpha"), (2, "of")], "q int, text string")
    assert sorted((r["q"], r["g"], r["rank"], r["id"]) for r in R.select_in_groups(queries, docs, 2, "g", "n").collect()) == [(1, 1, 1, "a"), (1, 1, 2, "b"), (1, 2, 1, "aa")]
    assert R.select_in_groups(queries.where("q = 2"), docs, 2, "g", "n").count() == 0


def test_only_the_best_of_each_group_leave_a_task(spark):
    from clausegrid.operators import retrieval as R
    from clausegrid.storage import stored

    docs = spark.range(0, 5000, 1, 2).selectExpr("id", "'alpha' AS text", "concat('s', id % 3) AS g", "id AS n")
    index = stored(B.term_index(docs, ["alpha"], keep=("g", "n")))
    one = np.zeros(1, np.int64)
    rows = B.grouped_top(index, (one, one, np.full(1, 5.0)), 1, 4, "g", "n")
    assert rows.count() == 2 * 3 * 4
    best = B.BestByGroup(1, 2)
    assert best.result() is None
    queries = spark.createDataFrame([(1, "alpha")], "q long, text string")
    assert sorted(r["id"] for r in R.select_in_groups(queries, docs, 2, "g", "n").collect()) == [4994, 4995, 4996, 4997, 4998, 4999]


@pytest.mark.parametrize("repeated", [0, 1])
def test_terms_of_odd_tables(spark, tmp_path, repeated):
    """r01 and r22 against their SQL: a repeated item counts a term once, repeated documents are merged, no document is tokenized by expressions and no pair of an item and a document is a row."""
    import pyarrow as pa
    import pyarrow.parquet as pq

    import __spark_entry__ as entry

    duckdb = pytest.importorskip("duckdb")
    items = pa.table({"item_id": pa.array([1, 1, 2, 3], pa.int64()), "text": ["Alpha stone", "alpha river", None, "of"]})
    docs = pa.table({"doc_id": pa.array([1, 2, 3, 4, 5] + [6, 6, 7, 7, 8, 8] * repeated, pa.int64()), "text": ["ALPHA", "stone-river", None, "", "alpha\x00ünstone"] + ["alpha", "alpha", "alpha", "stone alpha", "of river", "alpha stone"] * repeated,
                     "source": ["a", "a", "a", None, None] + [None, None, "a", "b", "b", "b"] * repeated, "n_chars": pa.array([90, 11, 1, 0, None] + [5, 5, 5, 11, 8, 11] * repeated, pa.int64())})
    con = duckdb.connect()
    for name, table in (("benchmark", items), ("documents", docs)):
        pq.write_table(table, tmp_path / f"{name}.parquet")
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{tmp_path}/{name}.parquet'")
    got = entry.queries()["r22_clause_selection"](spark, str(tmp_path))
    want = con.execute(entry.oracle_sql()["r22_clause_selection"]).fetchall()
    assert sorted(map(repr, map(tuple, got.collect()))) == sorted(map(repr, want))
    assert repeated or sorted((r[3], r[2]) for r in want if r[1] == "a") == [(1, 2), (2, 1)]
    index, sql = entry.queries()["r01_bm25_index"](spark, str(tmp_path)), entry.oracle_sql()["r01_bm25_index"]
    assert sorted(map(repr, map(tuple, index.select("term", "df", "cf", "idf").collect()))) == sorted(map(repr, con.execute(f"SELECT term, df, cf, idf FROM ({sql})").fetchall()))
    for rows in (got, index):
        plan = rows._jdf.queryExecution().optimizedPlan().toString()
        assert "regexp_extract_all(lower" not in plan and "Generate" not in plan
