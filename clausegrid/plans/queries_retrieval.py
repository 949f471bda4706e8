"""Queries of the ranking operators over documents, benchmark questions and embeddings."""

from __future__ import annotations

from dataclasses import replace

from pyspark.sql import functions as F

from clausegrid.config import NOTEBOOK, RANK
from clausegrid.functions.text import tokenize
from clausegrid.operators import metrics as M, retrieval as R
from clausegrid.plans.fixtures import derived, fixture, with_fixtures
from clausegrid.storage import scratch, stored

QUERIES: dict = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None):
    def add(f):
        QUERIES[name] = f
        if sql:
            ORACLES[name] = sql
        return f

    return add


DOCS = "SELECT doc_id AS id, coalesce(text, '') AS text FROM documents"
#: The original, its first 8 tokens, and its tokens of 6 letters or more.
VARIANTS_SQL = """
vt AS (SELECT item_id AS q, regexp_extract_all(lower(regexp_replace(text, '[^A-Za-z0-9]+', ' ', 'g')), '[a-z0-9]+') AS t FROM benchmark),
variants AS (SELECT q, 0 AS v, t FROM vt UNION ALL SELECT q, 1, t[1:8] FROM vt UNION ALL SELECT q, 2, list_filter(t, lambda x: length(x) >= 6) FROM vt)"""


def docs_of(spark, sf_dir):
    return derived(spark, sf_dir, DOCS)


def variants_of(spark, sf_dir):
    t = tokenize(F.col("query"))
    rows = fixture(spark, sf_dir, "queries").select("q", F.explode(F.array(
        F.struct(F.lit(0).alias("v"), F.array_join(t, " ").alias("text")),
        F.struct(F.lit(1).alias("v"), F.array_join(F.slice(t, 1, 8), " ").alias("text")),
        F.struct(F.lit(2).alias("v"), F.array_join(F.filter(t, lambda x: F.length(x) >= 6), " ").alias("text")))).alias("x"))
    return rows.select("q", "x.v", "x.text")


def originals(spark, sf_dir):
    return variants_of(spark, sf_dir).where("v = 0").select("q", "text")


def gold_of(spark, sf_dir):
    """The smallest document that holds the whole text of a benchmark item."""
    items = derived(spark, sf_dir, "SELECT item_id AS q, text FROM benchmark")
    return R.containing(items, docs_of(spark, sf_dir)).groupBy("q").agg(F.min("id").alias("gold"))


GOLD_SQL = "SELECT b.item_id AS q, min(d.doc_id) AS gold FROM benchmark b JOIN documents d ON contains(d.text, b.text) GROUP BY b.item_id"
TOKENS_SQL = "tok AS (SELECT doc_id AS id, regexp_extract_all(lower(regexp_replace(coalesce(text, ''), '[^A-Za-z0-9]+', ' ', 'g')), '[a-z0-9]+') AS t FROM documents), post AS MATERIALIZED (SELECT id, dl, term, count(*) AS tf FROM (SELECT id, len(t) AS dl, unnest(t) AS term FROM tok) GROUP BY id, dl, term), stats AS (SELECT count(*) AS n, avg(len(t)) AS avgdl FROM tok)"
BM25_SQL = f"""{TOKENS_SQL}, {VARIANTS_SQL},
qt AS (SELECT q, v, term, count(*) AS qtf FROM (SELECT q, v, unnest(t) AS term FROM variants) GROUP BY q, v, term),
dfs AS (SELECT term, ln((n - count(*) + 0.5) / (count(*) + 0.5) + 1) AS idf FROM post, stats GROUP BY term, n),
sc AS (SELECT q, v, id, round(sum(qtf * idf * tf * 2.5 / (tf + 1.5 * (0.25 + 0.75 * dl / avgdl))), 6) AS score FROM qt JOIN post USING (term) JOIN dfs USING (term), stats GROUP BY q, v, id),
bm AS MATERIALIZED (SELECT variants.q, variants.v, tok.id, coalesce(score, 0) AS score, row_number() OVER (PARTITION BY variants.q, variants.v ORDER BY coalesce(score, 0) DESC, tok.id) AS rank
  FROM variants CROSS JOIN tok LEFT JOIN sc ON sc.q = variants.q AND sc.v = variants.v AND sc.id = tok.id)"""
OVERLAP_SQL = """ov AS MATERIALIZED (SELECT q, v, id, score, row_number() OVER (PARTITION BY q, v ORDER BY score DESC, id) AS rank FROM (
  SELECT q, v, id, round(count(*) / max(m)::DOUBLE, 9) AS score FROM (SELECT q, v, term, count(*) OVER (PARTITION BY q, v) AS m FROM qt) x JOIN post USING (term) GROUP BY q, v, id))"""
FUSED_SQL = """fused AS MATERIALIZED (SELECT q, id, round(sum((CASE WHEN v = 0 THEN 1.0 ELSE 0.25 END)::DOUBLE / (60 + rank)), 9) AS score FROM (
  SELECT q, v, id, rank FROM bm WHERE rank <= 50 UNION ALL SELECT q, v, id, rank FROM ov WHERE rank <= 50) GROUP BY q, id)"""
PRED_SQL = "pred AS (SELECT q, id, CAST(sum(length(term)) AS DOUBLE) AS pred FROM qt JOIN post USING (term) WHERE v = 0 AND length(term) >= 5 GROUP BY q, id)"


def rerank_sql(blend=0.65, skip=0.10, adopt=0.15, relaxed=0.10, low=0.08, skip_on=True, drop=False, candidates=50) -> str:
    return f"""base AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY q ORDER BY score DESC, id) AS base_rank FROM fused) WHERE base_rank <= {candidates}),
bmar AS (SELECT q, round(CASE WHEN count(*) > 1 THEN (max(score) FILTER (WHERE base_rank = 1) - max(score) FILTER (WHERE base_rank = 2)) / greatest(max(score) FILTER (WHERE base_rank = 1), 1e-9) ELSE 1.0 END, 9) AS base_margin FROM base GROUP BY q),
j AS (SELECT base.*, base_margin, CASE WHEN {'base_margin >= ' + str(skip) if skip_on else 'false'} THEN NULL ELSE p.pred END AS pred FROM base JOIN bmar USING (q) LEFT JOIN pred p ON p.q = base.q AND p.id = base.id),
c0 AS (SELECT *, (NOT {'(base_margin >= ' + str(skip) + ')' if skip_on else 'false'}) AND bool_or(pred IS NOT NULL) OVER (PARTITION BY q) AS called FROM j),
c AS (SELECT * FROM c0 {'WHERE NOT called OR pred IS NOT NULL' if drop else ''}),
mm AS (SELECT *, min(score) OVER w AS s0, max(score) OVER w AS s1, min(pred) OVER w AS p0, max(pred) OVER w AS p1 FROM c WINDOW w AS (PARTITION BY q, pred IS NOT NULL)),
bl AS (SELECT *, CASE WHEN pred IS NOT NULL THEN round({blend} * CASE WHEN s1 - s0 < 1e-12 THEN 0 ELSE (score - s0) / (s1 - s0) END + {1 - blend} * CASE WHEN p1 - p0 < 1e-12 THEN 0 ELSE (pred - p0) / (p1 - p0) END, 9) END AS blend FROM mm),
rr AS (SELECT *, row_number() OVER (PARTITION BY q ORDER BY pred IS NOT NULL DESC, blend DESC NULLS LAST, base_rank) AS rerank_rank FROM bl),
rm AS (SELECT q, round(CASE WHEN count(*) > 1 THEN (max(blend) FILTER (WHERE rerank_rank = 1) - max(blend) FILTER (WHERE rerank_rank = 2)) / greatest(max(blend) FILTER (WHERE rerank_rank = 1), 1e-9) ELSE 1.0 END, 9) AS rerank_margin FROM rr WHERE pred IS NOT NULL GROUP BY q),
ap AS (SELECT rr.*, rerank_margin, called AND NOT (bool_or(rerank_rank = 1 AND base_rank <> 1) OVER (PARTITION BY rr.q) AND rerank_margin < CASE WHEN base_margin < {low} THEN {min(adopt, relaxed)} ELSE {adopt} END) AS applied FROM rr LEFT JOIN rm ON rm.q = rr.q),
fin AS (SELECT *, CASE WHEN applied THEN rerank_rank ELSE row_number() OVER (PARTITION BY q ORDER BY base_rank) END AS final_rank, CASE WHEN applied THEN rerank_margin ELSE base_margin END AS final_margin FROM ap)"""


def pred_for(spark, sf_dir):
    """The stand-in for cross-encoder scores of candidate pairs: letters of the query's longer terms that a document has."""

    def score(pairs):
        wanted = originals(spark, sf_dir).select("q", F.filter(F.array_distinct(tokenize(F.col("text"))), lambda t: F.length(t) >= 5).alias("a"))
        docs = docs_of(spark, sf_dir).join(pairs.select("id").distinct(), "id", "left_semi").select("id", F.array_distinct(tokenize(F.col("text"))).alias("b"))
        both = pairs.join(wanted, "q").join(docs, "id").select("q", "id", F.array_intersect("a", "b").alias("t"))
        return both.where(F.size("t") > 0).select("q", "id", F.aggregate("t", F.lit(0), lambda a, x: a + F.length(x)).cast("double").alias("pred"))

    return score


ALL_SQL = f"WITH {BM25_SQL}, {OVERLAP_SQL}, {FUSED_SQL}, {PRED_SQL}"


@query("r01_bm25_index", f"WITH {TOKENS_SQL} SELECT term, count(*) AS df, CAST(sum(tf) AS BIGINT) AS cf, round(ln((n - count(*) + 0.5) / (count(*) + 0.5) + 1), 9) AS idf FROM post, stats GROUP BY term, n")
def _(spark, sf_dir):
    docs = docs_of(spark, sf_dir)
    terms = R.postings(docs).groupBy("term").agg(F.count("*").alias("df"), F.sum("tf").alias("cf"))
    return terms.join(F.broadcast(R.corpus_stats(docs)), how="cross").select("term", "df", "cf", F.round(R.idf(F.col("n"), F.col("df")), 9).alias("idf"))


@query("r02_bm25_scores", f"WITH {BM25_SQL} SELECT q, id, score FROM sc WHERE v = 0")
def _(spark, sf_dir):
    return R.bm25_scores(originals(spark, sf_dir), docs_of(spark, sf_dir))


@query("r03_bm25_topk", f"WITH {BM25_SQL} SELECT q, id, score, CAST(rank AS INTEGER) AS rank FROM bm WHERE v = 0 AND rank <= 10")
def _(spark, sf_dir):
    return R.bm25_top(originals(spark, sf_dir), docs_of(spark, sf_dir), 10)


VECTORS = "SELECT vec_id AS id, embedding AS v, label AS control FROM embeddings"
DENSE_SQL = """d AS (SELECT a.vec_id AS q, b.vec_id AS id, b.label AS control, round(list_inner_product(CAST(a.embedding AS DOUBLE[]), CAST(b.embedding AS DOUBLE[])), 9) AS score FROM embeddings a, embeddings b WHERE a.vec_id % 20 = 0),
dr AS (SELECT *, row_number() OVER (PARTITION BY q ORDER BY score DESC, id) AS rank FROM d)"""


def dense_hits(spark, sf_dir, n):
    v = derived(spark, sf_dir, VECTORS)
    return R.dense_top(v.where("id % 20 = 0").select(F.col("id").alias("q"), "v"), v.select("id", "v"), n)


@query("r05_dense_search", f"WITH {DENSE_SQL} SELECT q, id, score, CAST(rank AS INTEGER) AS rank FROM dr WHERE rank <= 10")
def _(spark, sf_dir):
    return dense_hits(spark, sf_dir, 10)


def pooled_sql(fetch: int, n: int) -> str:
    return f"WITH {DENSE_SQL}, pl AS (SELECT q, control, max(score) AS score, arg_max(id, (score, -id)) AS clause FROM dr WHERE rank <= {fetch} AND score > -1 GROUP BY q, control) SELECT q, control, score, clause, CAST(rank AS INTEGER) AS rank FROM (SELECT *, row_number() OVER (PARTITION BY q ORDER BY score DESC, control) AS rank FROM pl) WHERE rank <= {n}"


def pooled(spark, sf_dir, fetch, n):
    return R.pool_controls(dense_hits(spark, sf_dir, fetch), derived(spark, sf_dir, VECTORS).select("id", "control"), n)


@query("r06_dense_pooled", pooled_sql(50, 5))
def _(spark, sf_dir):
    return pooled(spark, sf_dir, max(10, 5) * 5, 5)


@query("r07_dense_pooled_notebook", pooled_sql(25, 5))
def _(spark, sf_dir):
    return pooled(spark, sf_dir, 5 * 5, 5)


@query("r24_dense_controls", pooled_sql(50, 10))
def _(spark, sf_dir):
    return pooled(spark, sf_dir, 50, 10)


def fused_of(spark, sf_dir, only_original=False, both=True, n=50):
    docs, v = docs_of(spark, sf_dir), variants_of(spark, sf_dir)
    v = v.where("v = 0") if only_original else v
    index = R.lexical_index(v, docs)
    lists = R.bm25_top(v, docs, n, RANK, ["q", "v"], index).select("q", "v", "id", "rank")
    if both:
        lists = lists.unionByName(R.overlap_top(v, docs, n, ["q", "v"], index).select("q", "v", "id", "rank"))
    return R.fuse(lists.withColumn("w", F.when(F.col("v") == 0, 1.0).otherwise(0.25)))


def tops_of(spark, sf_dir):
    """q, b, d: the first document of each channel."""
    docs, one = docs_of(spark, sf_dir), originals(spark, sf_dir)
    index = R.lexical_index(one, docs)
    return R.bm25_top(one, docs, 1, index=index).select("q", F.col("id").alias("b")).join(R.overlap_top(one, docs, 1, index=index).select("q", F.col("id").alias("d")), "q")


@query("r08_weighted_rrf", f"{ALL_SQL} SELECT * FROM fused")
def _(spark, sf_dir):
    return fused_of(spark, sf_dir)


HYBRID_SQL = "hy AS (SELECT q, id, round(sum(1.0::DOUBLE / (60 + rank)), 9) AS score FROM (SELECT q, v, id, rank FROM bm WHERE rank <= 50 AND v = 0 UNION ALL SELECT q, v, id, rank FROM ov WHERE rank <= 50 AND v = 0) GROUP BY q, id), hr AS (SELECT *, row_number() OVER (PARTITION BY q ORDER BY score DESC, id) AS rank FROM hy)"


@query("r09_list_rrf", f"WITH {BM25_SQL}, {OVERLAP_SQL}, {HYBRID_SQL} SELECT q, id, score FROM hy")
def _(spark, sf_dir):
    return fused_of(spark, sf_dir, True)


SCOPE_SQL = """SELECT q, id, round(score + CASE WHEN cs = 'neutral' THEN 0 WHEN q % 2 = 0 AND cs = 'privileged' OR q % 2 = 1 AND cs = 'non_privileged' THEN 0.08 * peak ELSE -0.06 * peak END, 12) AS score FROM (SELECT *, max(score) OVER (PARTITION BY q) AS peak, CASE id % 3 WHEN 0 THEN 'privileged' WHEN 1 THEN 'non_privileged' ELSE 'neutral' END AS cs FROM hy)"""


@query("r10_scope_bias", f"WITH {BM25_SQL}, {OVERLAP_SQL}, {HYBRID_SQL} {SCOPE_SQL}")
def _(spark, sf_dir):
    fused = fused_of(spark, sf_dir, True)
    scopes = originals(spark, sf_dir).select("q", F.when(F.col("q") % 2 == 0, "privileged").otherwise("non_privileged").alias("query_scope"))
    controls = docs_of(spark, sf_dir).select("id", F.when(F.col("id") % 3 == 0, "privileged").when(F.col("id") % 3 == 1, "non_privileged").otherwise("neutral").alias("control_scope"))
    return R.scope_bias(fused, scopes, controls)


RANK_COLUMNS = ("q", "id", "score", "base_rank", "base_margin", "called", "pred", "blend", "rerank_rank", "rerank_margin", "applied", "final_rank", "final_margin")
RANK_SQL = "SELECT q, id, score, CAST(base_rank AS INTEGER) AS base_rank, base_margin, called, coalesce(pred, -1) AS pred, coalesce(blend, -1) AS blend, CAST(rerank_rank AS INTEGER) AS rerank_rank, coalesce(rerank_margin, -1) AS rerank_margin, applied, CAST(final_rank AS INTEGER) AS final_rank, final_margin FROM fin"


def shown(rows):
    rows = rows.select(*RANK_COLUMNS)
    return rows.fillna(-1.0, ["pred", "blend", "rerank_margin"])


def ranking(spark, sf_dir, cfg):
    return R.rank_controls(variants_of(spark, sf_dir), docs_of(spark, sf_dir), pred_for(spark, sf_dir), None, cfg)


@query("r19_rank_controls", f"{ALL_SQL}, {rerank_sql()} {RANK_SQL}")
def _(spark, sf_dir):
    return shown(ranking(spark, sf_dir, RANK))


@query("r20_rank_controls_notebook", f"{ALL_SQL}, {rerank_sql(relaxed=0.15, drop=True)} {RANK_SQL}")
def _(spark, sf_dir):
    return shown(ranking(spark, sf_dir, NOTEBOOK))


@query("r11_candidate_cut", f"{ALL_SQL}, {rerank_sql(candidates=20)} SELECT q, id, score, CAST(base_rank AS INTEGER) AS base_rank FROM base")
def _(spark, sf_dir):
    return R.ranked(fused_of(spark, sf_dir), ["q"], [F.desc("score"), F.col("id")], "base_rank", 20)


@query("r12_base_margin", f"{ALL_SQL}, {rerank_sql()} SELECT q, base_margin, base_margin >= 0.1 AS skipped FROM bmar")
def _(spark, sf_dir):
    base = R.ranked(stored(fused_of(spark, sf_dir)), ["q"], [F.desc("score"), F.col("id")], "base_rank", 50)
    return R.margin(base, "score", "base_rank", "base_margin").withColumn("skipped", F.col("base_margin") >= RANK.skip_margin)


@query("r13_skip_gate_agreement", f"{ALL_SQL}, {rerank_sql()} SELECT b.q, base_margin >= 0.1 AND b.id = bm.id AND b.id = ov.id AS skipped FROM base b JOIN bmar USING (q) JOIN bm ON bm.q = b.q AND bm.v = 0 AND bm.rank = 1 JOIN ov ON ov.q = b.q AND ov.v = 0 AND ov.rank = 1 WHERE b.base_rank = 1")
def _(spark, sf_dir):
    base = R.ranked(stored(fused_of(spark, sf_dir)), ["q"], [F.desc("score"), F.col("id")], "base_rank", 50)
    first = base.where("base_rank = 1").select("q", "id").join(R.margin(base, "score", "base_rank", "m"), "q")
    tops = tops_of(spark, sf_dir)
    return first.join(tops, "q").select("q", ((F.col("m") >= RANK.skip_margin) & (F.col("id") == F.col("b")) & (F.col("id") == F.col("d"))).alias("skipped"))


@query("r15_min_max", f"{ALL_SQL} SELECT q, id, CASE WHEN max(score) OVER (PARTITION BY q) - min(score) OVER (PARTITION BY q) < 1e-12 THEN 0 ELSE round((score - min(score) OVER (PARTITION BY q)) / (max(score) OVER (PARTITION BY q) - min(score) OVER (PARTITION BY q)), 9) END AS value FROM fused")
def _(spark, sf_dir):
    return fused_of(spark, sf_dir).select("q", "id", F.round(R.min_max("score", ["q"]), 9).alias("value"))


@query("r16_blend", f"{ALL_SQL}, {rerank_sql(skip_on=False)} SELECT q, id, coalesce(blend, -1) AS blend, CAST(rerank_rank AS INTEGER) AS rerank_rank FROM fin")
def _(spark, sf_dir):
    return ranking(spark, sf_dir, replace(RANK, skip_enabled=False)).select("q", "id", F.coalesce("blend", F.lit(-1.0)).alias("blend"), "rerank_rank")


@query("r17_adoption_gate", f"{ALL_SQL}, {rerank_sql()} SELECT DISTINCT q, called, applied, final_margin FROM fin")
def _(spark, sf_dir):
    return ranking(spark, sf_dir, RANK).select("q", "called", "applied", "final_margin").distinct()


@query("r18_top_candidates", f"{ALL_SQL}, {rerank_sql()} SELECT q, id, score, CAST(base_rank AS INTEGER) AS base_rank, CAST(final_rank AS INTEGER) AS final_rank FROM fin WHERE base_rank <= 20")
def _(spark, sf_dir):
    return ranking(spark, sf_dir, RANK).where("base_rank <= 20").select("q", "id", "score", "base_rank", "final_rank")


@query("r21_hybrid_details", f"WITH {BM25_SQL}, {OVERLAP_SQL}, {HYBRID_SQL} SELECT hr.q, hr.id AS top, round(coalesce((hr.score - h2.score) / hr.score, 1), 9) AS margin, bm.id = ov.id AS agree FROM hr LEFT JOIN hr h2 ON h2.q = hr.q AND h2.rank = 2 JOIN bm ON bm.q = hr.q AND bm.v = 0 AND bm.rank = 1 JOIN ov ON ov.q = hr.q AND ov.v = 0 AND ov.rank = 1 WHERE hr.rank = 1")
def _(spark, sf_dir):
    base = R.ranked(stored(fused_of(spark, sf_dir, True)), ["q"], [F.desc("score"), F.col("id")])
    tops = tops_of(spark, sf_dir)
    return base.where("rank = 1").select("q", F.col("id").alias("top")).join(R.margin(base, "score", "rank", "margin"), "q").join(tops, "q").select("q", "top", "margin", (F.col("b") == F.col("d")).alias("agree"))


@query("r22_clause_selection", f"{ALL_SQL}, cl AS (SELECT q, d.source, p.id, pred, d.n_chars FROM pred p JOIN documents d ON d.doc_id = p.id) SELECT q, source, id, CAST(rank AS INTEGER) AS rank FROM (SELECT *, row_number() OVER (PARTITION BY q, source ORDER BY pred DESC, n_chars DESC, id) AS rank FROM cl) WHERE rank <= 12")
def _(spark, sf_dir):
    docs = derived(spark, sf_dir, "SELECT doc_id AS id, coalesce(text, '') AS text, source, n_chars FROM documents")
    return R.select_in_groups(originals(spark, sf_dir), docs, 12, "source", "n_chars").select("q", "source", "id", "rank")


@query("r23_system_bm25", f"WITH {BM25_SQL} SELECT q, string_agg(CAST(id AS VARCHAR), ',' ORDER BY rank) AS ids FROM bm WHERE v = 0 AND rank <= 10 GROUP BY q")
def _(spark, sf_dir):
    return listed(R.bm25_top(originals(spark, sf_dir), docs_of(spark, sf_dir), 10))


def listed(rows, rank="rank"):
    return rows.groupBy("q").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(rank, "id"))), lambda x: x["id"].cast("string")), ",").alias("ids"))


@query("r25_system_rewrite", f"WITH {BM25_SQL} SELECT q, string_agg(CAST(id AS VARCHAR), ',' ORDER BY rank) AS ids FROM bm WHERE v = 1 AND rank <= 10 GROUP BY q")
def _(spark, sf_dir):
    return listed(R.bm25_top(variants_of(spark, sf_dir).where("v = 1"), docs_of(spark, sf_dir), 10))


@query("r26_system_rewrites_rrf", f"WITH {BM25_SQL}, f AS (SELECT q, id, round(sum((CASE WHEN v = 0 THEN 1.0 ELSE 0.25 END)::DOUBLE / (60 + rank)), 9) AS score FROM bm WHERE rank <= 10 GROUP BY q, id), g AS (SELECT *, row_number() OVER (PARTITION BY q ORDER BY score DESC, id) AS rank FROM f) SELECT q, string_agg(CAST(id AS VARCHAR), ',' ORDER BY rank) AS ids FROM g WHERE rank <= 10 GROUP BY q")
def _(spark, sf_dir):
    return listed(R.ranked(fused_of(spark, sf_dir, both=False, n=10), ["q"], [F.desc("score"), F.col("id")], most=10))


@query("r27_system_hybrid", f"WITH {BM25_SQL}, {OVERLAP_SQL}, {HYBRID_SQL} SELECT q, string_agg(CAST(id AS VARCHAR), ',' ORDER BY rank) AS ids FROM hr WHERE rank <= 10 GROUP BY q")
def _(spark, sf_dir):
    return listed(R.ranked(fused_of(spark, sf_dir, True), ["q"], [F.desc("score"), F.col("id")], most=10))


@query("r28_system_hybrid_rerank", f"WITH {BM25_SQL}, {OVERLAP_SQL}, {HYBRID_SQL}, {PRED_SQL}, g AS (SELECT hr.q, hr.id, row_number() OVER (PARTITION BY hr.q ORDER BY pred DESC, hr.id DESC) AS rank FROM hr JOIN pred ON pred.q = hr.q AND pred.id = hr.id WHERE hr.rank <= 50) SELECT q, string_agg(CAST(id AS VARCHAR), ',' ORDER BY rank) AS ids FROM g WHERE rank <= 10 GROUP BY q")
def _(spark, sf_dir):
    base = R.ranked(fused_of(spark, sf_dir, True), ["q"], [F.desc("score"), F.col("id")], "base", 50)
    return listed(R.ranked(base.join(pred_for(spark, sf_dir)(base.select("q", "id")), ["q", "id"]), ["q"], [F.desc("pred"), F.desc("id")], most=10))


@query("r29_system_full", f"{ALL_SQL}, {rerank_sql(relaxed=0.15, drop=True)} SELECT q, string_agg(CAST(id AS VARCHAR), ',' ORDER BY final_rank) AS ids FROM fin WHERE final_rank <= 10 GROUP BY q")
def _(spark, sf_dir):
    return listed(ranking(spark, sf_dir, NOTEBOOK).where("final_rank <= 10"), "final_rank")


RANKS_SQL = f"gold AS ({GOLD_SQL}), gr AS (SELECT gold.q, v.v, coalesce(min(bm.rank), 0) AS rank FROM gold CROSS JOIN (SELECT unnest([0, 1, 2]) AS v) v LEFT JOIN bm ON bm.q = gold.q AND bm.v = v.v AND bm.id = gold AND bm.rank <= 10 GROUP BY gold.q, v.v)"


def variant_ranks(spark, sf_dir):
    tops = R.bm25_top(variants_of(spark, sf_dir), docs_of(spark, sf_dir), 10, RANK, ["q", "v"])
    gold = gold_of(spark, sf_dir)
    hits = tops.join(gold, "q").where("id = gold").groupBy("q", "v").agg(F.min("rank").alias("r"))
    every = gold.select("q", F.explode(F.array(F.lit(0), F.lit(1), F.lit(2))).alias("v"))
    return every.join(hits, ["q", "v"], "left").select("q", "v", F.coalesce("r", F.lit(0)).cast("int").alias("rank"))


@query("r30_gold_informed_rewrite", f"WITH {BM25_SQL}, {RANKS_SQL} SELECT q, CAST(arg_min(v, (CASE WHEN rank = 0 THEN 1000000 ELSE rank END, v)) AS INTEGER) AS rewrite, CAST(arg_min(rank, (CASE WHEN rank = 0 THEN 1000000 ELSE rank END, v)) AS INTEGER) AS rank FROM gr WHERE v > 0 GROUP BY q")
def _(spark, sf_dir):
    return R.choose_rewrite(variant_ranks(spark, sf_dir).where("v > 0").select("q", F.col("v").alias("ord"), "rank"))


@query("r31_query_variants", None)
def _(spark, sf_dir):
    from clausegrid.functions.text import query_variants

    rows = fixture(spark, sf_dir, "queries")
    t = tokenize(F.col("query"))
    rewrites = F.array(F.col("query"), F.array_join(F.slice(t, 1, 8), " "), F.lit("AC-2(1) elsewhere"), F.array_join(F.filter(t, lambda x: F.length(x) >= 6), " "))
    return rows.select("q", F.array_join(query_variants(F.col("query"), rewrites), "|").alias("variants"))


ORACLES["r31_query_variants"] = r"""
WITH t AS (SELECT item_id AS q, trim(text) AS query, regexp_extract_all(lower(regexp_replace(text, '[^A-Za-z0-9]+', ' ', 'g')), '[a-z0-9]+') AS t FROM benchmark),
r AS (SELECT q, query, t, unnest([array_to_string(t[1:8], ' '), 'AC-2(1) elsewhere', array_to_string(list_filter(t, lambda x: length(x) >= 6), ' ')]) AS r, unnest([1, 2, 3]) AS o FROM t),
k AS (SELECT *, list_distinct(regexp_extract_all(lower(regexp_replace(r, '[^A-Za-z0-9]+', ' ', 'g')), '[a-z0-9]+')) AS b, list_distinct(t) AS a FROM r WHERE r <> ''),
f AS (SELECT q, r, o FROM k WHERE len(list_intersect(a, b)) / len(list_distinct(list_concat(a, b)))::DOUBLE >= 0.15)
SELECT t.q, query || coalesce('|' || string_agg(r, '|' ORDER BY o), '') AS variants FROM t LEFT JOIN f ON f.q = t.q GROUP BY t.q, query"""


_condition_sql = {"baseline": {}, "alpha_minus20": {"blend": 0.52}, "alpha_plus20": {"blend": 0.78}, "adoption_minus20": {"adopt": 0.12}, "adoption_plus20": {"adopt": 0.18}, "skip_minus20": {"skip": 0.08}, "skip_plus20": {"skip": 0.12}}


def captured(spark, sf_dir):
    """The channels of all queries, captured once and read again by their digest."""
    fused, path = stored(fused_of(spark, sf_dir)), f"{scratch(spark, 'channels')}/candidates"
    return R.replay(spark, path, R.capture(fused, pred_for(spark, sf_dir)(fused.select("q", "id")), path))


@query("r33_sensitivity_grid", None)
def _(spark, sf_dir):
    """Seven conditions, each with its gates on and off, over one reading of the channels."""
    return R.sensitivity(captured(spark, sf_dir), gold_of(spark, sf_dir))


def _grid_sql() -> str:
    one = lambda name, gated, o: f"SELECT * FROM (WITH {rerank_sql(**o)} SELECT '{name}' AS condition, {gated} AS gated, q, id, final_rank, called, applied FROM fin)"
    parts = [one(n, str(gated).lower(), o if gated else o | {"skip_on": False, "adopt": 0, "relaxed": 0}) for n, o in _condition_sql.items() for gated in (True, False)]
    return f"""{ALL_SQL}, gold AS MATERIALIZED ({GOLD_SQL}), every AS ({' UNION ALL '.join(parts)}),
tops AS (SELECT condition, q, max(id) FILTER (WHERE gated AND final_rank = 1) AS id, max(id) FILTER (WHERE NOT gated AND final_rank = 1) AS proposal, bool_or(called) FILTER (WHERE gated AND final_rank = 1) AS called,
  bool_or(applied) FILTER (WHERE gated AND final_rank = 1) AS applied, CAST(coalesce(min(final_rank) FILTER (WHERE gated AND id = gold AND final_rank <= 10), 0) AS INTEGER) AS rank, max(gold) AS gold FROM every LEFT JOIN gold USING (q) GROUP BY condition, q),
staged AS (SELECT *, CASE WHEN NOT called THEN 'skip' WHEN NOT applied THEN 'adoption' ELSE 'none' END AS stage FROM tops)
SELECT condition, q, id, rank, called, applied, stage, proposal, stage <> 'none' AND gold IS NOT NULL AND id = gold AND proposal <> gold AS prevented_error,
  stage <> 'none' AND gold IS NOT NULL AND id <> gold AND proposal = gold AS blocked_correction FROM staged"""


ORACLES["r33_sensitivity_grid"] = _grid_sql()


@query("r32_replay_channels", f"{ALL_SQL}, {rerank_sql()} SELECT q, id, CAST(final_rank AS INTEGER) AS final_rank FROM fin WHERE final_rank <= 3")
def _(spark, sf_dir):
    return R.rerank_each(captured(spark, sf_dir), [("baseline", True, RANK)]).where("final_rank <= 3").select("q", "id", "final_rank")


@query("r34_retrieval_documents", f"{ALL_SQL}, {rerank_sql()} SELECT q, CAST(final_rank AS INTEGER) AS rank, doc_id AS id, source, n_chars FROM fin JOIN documents ON doc_id = id WHERE final_rank <= 5")
def _(spark, sf_dir):
    top = ranking(spark, sf_dir, RANK).where("final_rank <= 5").select("q", F.col("final_rank").alias("rank"), "id")
    return top.join(derived(spark, sf_dir, "SELECT doc_id AS id, source, n_chars FROM documents"), "id").select("q", "rank", "id", "source", "n_chars")


@query("c07_control_documents", with_fixtures(r", c AS (SELECT control_id, string_agg(text, chr(10) ORDER BY k) AS body, arg_max(title, k) AS title FROM fx_clauses GROUP BY control_id) SELECT control_id, replace(control_id, '-', ' ') || ' ' || control_id || ' ' || replace(control_id, '-', '') || chr(10) || title || chr(10) || body AS text FROM c", "clauses"))
def _(spark, sf_dir):
    return R.control_documents(fixture(spark, sf_dir, "clauses"))


@query("c08_fallback_texts", with_fixtures(r", s AS (SELECT *, CASE WHEN kind = 'smt' THEN 1 WHEN kind = 'gdn' THEN 2 ELSE 99 END AS tier FROM fx_clauses), b AS (SELECT *, row_number() OVER (PARTITION BY control_id ORDER BY tier, lower(id), k) AS rank FROM s WHERE tier < 99), p AS (SELECT control_id, string_agg(trim(text), chr(10) ORDER BY rank) AS body FROM b WHERE rank <= 8 GROUP BY control_id), t AS (SELECT control_id, arg_min(title, k) AS title FROM fx_clauses GROUP BY control_id) SELECT t.control_id, 'Control Title: ' || title || coalesce(chr(10) || body, '') AS text FROM t LEFT JOIN p ON p.control_id = t.control_id", "clauses"))
def _(spark, sf_dir):
    return R.fallback_texts(fixture(spark, sf_dir, "clauses"))


@query("c09_packed_passages", with_fixtures(r"SELECT id, 'passage: ' || replace(control_id, '-', ' ') || ' ' || control_id || ' ' || replace(control_id, '-', '') || ' ' || title || ' (' || kind || ')' || chr(10) || trim(text) AS packed FROM fx_clauses", "clauses"))
def _(spark, sf_dir):
    return R.packed_passages(fixture(spark, sf_dir, "clauses"))


METRIC_SQL = "round(avg(CASE WHEN rank = 1 THEN 1.0 ELSE 0.0 END), 9) AS s1, round(avg(CASE WHEN rank BETWEEN 1 AND 5 THEN 1.0 ELSE 0.0 END), 9) AS s5, round(avg(CASE WHEN rank BETWEEN 1 AND 10 THEN 1.0 ELSE 0.0 END), 9) AS s10, round(avg(CASE WHEN rank BETWEEN 1 AND 10 THEN 1.0 / rank ELSE 0.0 END), 9) AS mrr10, round(avg(CASE WHEN rank BETWEEN 1 AND 10 THEN 1.0 / log2(rank + 1) ELSE 0.0 END), 9) AS ndcg10"


@query("m01_gold_rank", f"WITH {BM25_SQL}, {RANKS_SQL} SELECT q, CAST(rank AS INTEGER) AS rank FROM gr WHERE v = 0")
def _(spark, sf_dir):
    return R.gold_rank(R.bm25_top(originals(spark, sf_dir), docs_of(spark, sf_dir), 10), gold_of(spark, sf_dir))


@query("m02_ranking_metrics", f"WITH {BM25_SQL}, {RANKS_SQL} SELECT CAST(v AS INTEGER) AS v, count(*) AS n, {METRIC_SQL} FROM gr GROUP BY v")
def _(spark, sf_dir):
    return M.ranking_metrics(variant_ranks(spark, sf_dir), ["v"])


@query("m03_metrics_subset", f"WITH {BM25_SQL}, {RANKS_SQL} SELECT 'all' AS part, count(*) AS n, {METRIC_SQL} FROM gr WHERE v = 0 UNION ALL SELECT 'even', count(*), {METRIC_SQL.replace(' AS s10', '').replace(' AS s1', '').replace(' AS s5', '').replace(' AS mrr10', '').replace(' AS ndcg10', '')} FROM gr WHERE v = 0 AND q % 2 = 0")
def _(spark, sf_dir):
    ranks = variant_ranks(spark, sf_dir).where("v = 0")
    return M.ranking_metrics(ranks.withColumn("part", F.lit("all")), ["part"]).unionByName(M.ranking_metrics(ranks.where("q % 2 = 0").withColumn("part", F.lit("even")), ["part"]))


@query("m04_gate_summary", f"{ALL_SQL}, {rerank_sql()}, g AS (SELECT DISTINCT q, called, applied FROM fin) SELECT count(*) AS n, count(*) FILTER (WHERE called) AS called, count(*) FILTER (WHERE applied) AS applied, count(*) FILTER (WHERE NOT called) AS skipped FROM g")
def _(spark, sf_dir):
    g = ranking(spark, sf_dir, RANK).select("q", "called", "applied").distinct()
    return g.agg(F.count("*").alias("n"), F.count_if("called").alias("called"), F.count_if("applied").alias("applied"), F.count_if(~F.col("called")).alias("skipped"))
