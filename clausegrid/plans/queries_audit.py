"""Queries of records that are checked again."""

from __future__ import annotations

from pyspark.sql import functions as F

from clausegrid.operators import audit as A, relational as B, evidence as E
from clausegrid.plans.fixtures import derived, fixture, spread, with_fixtures
from clausegrid.plans.queries_evidence import KEYS_SQL, MANIFEST_SQL, profile, window_of
from clausegrid.storage import stored

QUERIES: dict = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None, *fixtures: str):
    def add(f):
        QUERIES[name] = f
        if sql:
            ORACLES[name] = with_fixtures(sql, *fixtures)
        return f

    return add


@query("p08_without_gold_fields", "SELECT k, '{\"x\":{\"b\":' || k || '}}' AS j FROM fx_ids", "ids")
def _(spark, sf_dir):
    rows = fixture(spark, sf_dir, "ids").select("k", F.struct(F.col("name").alias("gold_a"), F.col("k").alias("b")).alias("x"), F.col("raw").alias("gold_raw"))
    clean = A.without_gold_fields(rows)
    return clean.select("k", F.to_json(F.struct(*[c for c in clean.columns if c != "k"])).alias("j"))


def contracts_of(spark, sf_dir):
    """Each clause as a contract of one citation."""
    return spread(fixture(spark, sf_dir, "clauses"), "k").withColumn("spans", F.array(F.struct(F.col("id").alias("source_id"), F.col("text").alias("span_text"))))


def with_profile(rows):
    """The rows with the profile: one row of data, not part of each expression. It is large beside a contract, so no step stores it with them."""
    return rows.join(F.broadcast(rows.sparkSession.range(1).select(profile().alias("values"))), how="cross")


def resolved(spark, sf_dir):
    """The contracts, filled from a profile of revision 5; every third corpus is revision 4."""
    rows = contracts_of(spark, sf_dir)
    rows = rows.withColumn("version", F.when(F.col("k") % 3 == 0, "rev4").otherwise("rev5"))
    rows = with_profile(rows).withColumn("r", A.profile_resolution(F.col("spans"), F.col("values"), F.lit("rev5"), F.col("version")))
    return rows.select(F.col("k").alias("q"), "spans", "version", "r.answer", "r.required", "r.status", "r.record", F.lit("FILL_FROM_PROFILE").alias("policy"))


FILL_SQL = f""", x AS (SELECT k, trim(text) AS text, {KEYS_SQL} AS keys, contains(text, '[Assignment:') AS bare FROM fx_clauses),
y AS (SELECT *, k % 3 <> 0 AND len(keys) > 0 AND regexp_matches(keys[1], '^[a-z]+-0[1-9]_odp\\.0[2468]$') AS fill FROM x)"""


@query("o11_profile_resolution", FILL_SQL + """ SELECT k AS q, CASE WHEN fill THEN regexp_replace(text, '\\{+\\s*insert:\\s*(?:param,\\s*)?([^}]+?)\\s*\\}+', 'v$1\\\\' || keys[1]) ELSE text END AS answer,
CASE WHEN (len(keys) > 0 AND NOT fill) OR bare THEN 'PARAMS_REQUIRED' ELSE 'OK' END AS status, CAST(CASE WHEN fill THEN 1 ELSE 0 END AS INTEGER) AS bindings, k % 3 <> 0 AS applicable FROM y""", "clauses")
def _(spark, sf_dir):
    return resolved(spark, sf_dir).select("q", "answer", "status", F.size("record.bindings").alias("bindings"), F.col("record.profile_applicable").alias("applicable"))


def tagged(rows):
    c = F.col
    return A.profile_tags(c("record"), c("answer"), c("required"), c("status"), c("policy"), c("spans"), c("values"), F.lit("rev5"), c("version"))


@query("v10_x08_profile_mutations", "SELECT mutation, count(*) AS n, CASE WHEN mutation = 'none' THEN 0 ELSE count(*) END AS detected FROM fx_clauses, (SELECT unnest(['none', 'answer', 'status', 'policy', 'required', 'revision', 'corpus', 'applicable', 'unresolved', 'anonymous', 'value']) AS mutation) m GROUP BY mutation", "clauses")
def _(spark, sf_dir):
    rows = with_profile(A.profile_mutations(stored(resolved(spark, sf_dir))))
    return rows.withColumn("t", tagged(rows)).groupBy("mutation").agg(F.count("*").alias("n"), F.count_if(F.size("t") > 0).alias("detected"))


CONDITION_SQL = f"""{FILL_SQL}, cond AS (SELECT k, text, keys, bare, unnest(['complete', 'empty', 'partial', 'wrong_revision', 'unknown_keys', 'unversioned', 'placeholder_values', 'literal_backslashes']) AS condition FROM x),
filled AS (SELECT *, CASE WHEN condition IN ('complete', 'literal_backslashes') THEN len(keys) WHEN condition = 'partial' THEN greatest(len(keys) - 1, 0) ELSE 0 END AS used FROM cond)"""


@query("x11_profile_conditions", CONDITION_SQL + """ SELECT condition, count(*) AS n, count(*) AS agreeing, CAST(sum(used) AS BIGINT) AS bindings, count(*) FILTER (WHERE used > 0) AS changed,
count(*) FILTER (WHERE len(keys) > used OR bare) AS open FROM filled GROUP BY condition""", "clauses")
def _(spark, sf_dir):
    """Each clause as a contract under eight conditions, against what the conditions alone foresee."""
    rows = A.resolution_outcomes(A.profile_cases(contracts_of(spark, sf_dir)))
    return rows.groupBy("condition").agg(F.count("*").alias("n"), F.count_if("agrees").alias("agreeing"), F.sum(F.size("r.record.bindings")).cast("long").alias("bindings"),
                                         F.count_if(F.col("r.answer") != F.col("original")).alias("changed"), F.count_if(F.col("r.status") == "PARAMS_REQUIRED").alias("open"))


@query("w07_prepared_contexts", MANIFEST_SQL + " SELECT man.q, n AS documents, sha256 AS window_sha256 FROM man", "retrieved", "gates")
def _(spark, sf_dir):
    w = window_of(spark, sf_dir)
    q = fixture(spark, sf_dir, "gates").select("q", F.col("status").alias("gold_status"), F.lit("question").alias("question"))
    c = A.prepared_contexts(q, w, E.manifests(w))
    return c.where("length(context_sha256) = 64").select("q", F.size("evidence_window").cast("long").alias("documents"), "window_sha256")


@query("v15_v18_reviews", "SELECT q, CASE WHEN q % 2 = 0 THEN 'pass' ELSE 'uncertain' END AS verdict FROM fx_headers WHERE answer <> ''", "headers")
def _(spark, sf_dir):
    c = fixture(spark, sf_dir, "headers").where("answer <> ''").select("q", "answer", F.array(F.col("required")).alias("ids"), "status")
    reviews = c.select("q", A.review_id(F.col("answer"), F.col("ids"), F.col("status")).alias("review_id"), F.when(F.col("q") % 2 == 0, "pass").otherwise("uncertain").alias("verdict"), F.substring("answer", 1, 4).alias("quote"))
    return A.checked_reviews(reviews, c).select("q", "verdict")


@query("v20_label_rules", "SELECT doc_id AS query_id, CASE doc_id % 4 WHEN 0 THEN '' WHEN 1 THEN 'evidence missing|source not checked' WHEN 2 THEN 'evidence for an outside question|parameters missing' ELSE 'answerability|uncertain parameters listed' END AS problems FROM labels")
def _(spark, sf_dir):
    r = F.col("query_id") % 4
    groups = F.when(r == 1, F.array().cast("array<array<string>>")).otherwise(F.array(F.array(F.lit("a"))))
    rows = derived(spark, sf_dir, "SELECT doc_id AS query_id FROM labels").select("query_id", F.when(r == 2, "outside").when(r == 3, "maybe").otherwise("full").alias("answerability"), F.array(F.lit("AC-1")).alias("governing_controls"), groups.alias("evidence_groups"),
        F.when(r == 2, "required").when(r == 3, "uncertain").otherwise("not_required").alias("odp_applicability"), F.when(r == 3, F.array(F.lit("p"))).otherwise(F.array().cast("array<string>")).alias("required_odp_ids"), (r != 1).alias("source_checked"))
    return A.label_problems(rows).select("query_id", F.array_join("problems", "|").alias("problems"))


@query("x12_release_checks", '''WITH c AS (SELECT 'lines have orders' AS "check", l_orderkey IN (SELECT o_orderkey FROM orders) AS ok FROM lineitem UNION ALL SELECT 'labels have documents', doc_id IN (SELECT doc_id FROM documents) FROM labels UNION ALL SELECT 'documents have labels', doc_id IN (SELECT doc_id FROM labels) FROM documents) SELECT "check", bool_and(ok) AS ok, count(*) AS n FROM c GROUP BY "check" UNION ALL SELECT 'all', bool_and(ok), count(*) FROM c''')
def _(spark, sf_dir):
    """Keys that a release promises to be there; that all documents have labels is not true."""
    keys = lambda table, key: derived(spark, sf_dir, f"SELECT {key} AS k FROM {table}")
    have = lambda rows, there, name: rows.join(there.distinct().withColumn("there", F.lit(True)), "k", "left").select(F.lit(name).alias("check"), F.coalesce("there", F.lit(False)).alias("ok"))
    documents, labels = keys("documents", "doc_id"), keys("labels", "doc_id")
    checks = B.all_of(have(keys("lineitem", "l_orderkey"), keys("orders", "o_orderkey"), "lines have orders"), have(labels, documents, "labels have documents"), have(documents, labels, "documents have labels"))
    return A.accepted(checks)


@query("x15_supplementary_union", "SELECT system, count(*) FILTER (WHERE pass) AS passed, round(avg(CASE WHEN pass THEN 1.0 ELSE 0 END), 9) AS rate FROM (SELECT 'quality' AS system, quality = 1 AS pass FROM labels UNION ALL SELECT 'toxic', toxic = 1 FROM labels) GROUP BY system")
def _(spark, sf_dir):
    l = derived(spark, sf_dir, "SELECT quality, toxic FROM labels")
    parts = (l.select(F.lit(x).alias("system"), (F.col(x) == 1).alias("pass")) for x in ("quality", "toxic"))
    return B.rates(B.all_of(*parts), ["system"], F.col("pass"), "passed")
