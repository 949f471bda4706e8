"""Queries of gates, windows, selection, assembly, policies and verification. Orders stand for contracts, their lines for citations."""

from __future__ import annotations

from pyspark.sql import functions as F

from clausegrid.functions import params as P
from clausegrid.operators import evidence as E, metrics as M, verify as V
from clausegrid.plans.fixtures import fixture, spread, with_fixtures

QUERIES: dict = {}
ORACLES: dict[str, str] = {}


def none():
    """An empty list of strings."""
    return F.array().cast("array<string>")


def query(name: str, sql: str | None, *fixtures: str):
    def add(f):
        QUERIES[name] = f
        if sql:
            ORACLES[name] = with_fixtures(sql, *fixtures)
        return f

    return add


def gates_of(spark, sf_dir):
    controls = fixture(spark, sf_dir, "retrieved").groupBy("q").agg(F.transform(F.array_sort(F.collect_list(F.struct("position", "control_id"))), lambda x: x["control_id"]).alias("controls"))
    rows = controls.join(fixture(spark, sf_dir, "gates"), "q")
    rows = rows.withColumn("g", E.allowed_controls(F.col("controls"), F.col("margin")))
    return rows.select("q", "g.allowed", "g.tier", F.element_at("controls", 1).alias("primary"), "margin")


GATE_SQL = """, ctl AS (SELECT q, list(control_id ORDER BY position) AS controls FROM fx_retrieved GROUP BY q),
n AS (SELECT ctl.*, margin, CASE WHEN coalesce(margin, 1) < 0.04 AND len(controls) >= 3 THEN 3 WHEN coalesce(margin, 1) < 0.08 AND len(controls) >= 2 THEN 2 ELSE 1 END AS n FROM ctl JOIN fx_gates USING (q)),
gate AS (SELECT q, controls[1:n] AS allowed, n - 1 AS tier, controls[1] AS prim, margin FROM n)"""
WINDOW_SQL = GATE_SQL + """, j AS (SELECT r.*, allowed, prim, margin, r.control_id = prim AS p, CASE r.kind WHEN 'smt' THEN 0 ELSE 1 END AS ko FROM fx_retrieved r JOIN gate USING (q) WHERE trim(text) <> ''),
i AS (SELECT *, CASE WHEN coalesce(margin, 0) >= 0.06 AND p THEN 0 ELSE 1 END AS fo, false AS fallback FROM j WHERE list_contains(allowed, control_id) AND kind IN ('smt', 'gdn')),
f AS (SELECT *, 0 AS fo, true AS fallback FROM j WHERE p AND kind = 'smt' AND q NOT IN (SELECT q FROM i)),
u AS (SELECT *, row_number() OVER (PARTITION BY q, id ORDER BY ko, fo, position) AS dn FROM (SELECT * FROM i UNION ALL SELECT * FROM f)),
win AS (SELECT * FROM (SELECT q, CAST(row_number() OVER (PARTITION BY q ORDER BY ko, fo, position) AS INTEGER) AS position, id, control_id, kind, text, fallback FROM u WHERE dn = 1) WHERE position <= 24)"""


def window_of(spark, sf_dir):
    return E.evidence_window(fixture(spark, sf_dir, "retrieved"), gates_of(spark, sf_dir))


@query("w01_control_gate", GATE_SQL + " SELECT q, array_to_string(allowed, ',') AS allowed, CAST(tier AS INTEGER) AS tier, prim AS first FROM gate", "retrieved", "gates")
def _(spark, sf_dir):
    return gates_of(spark, sf_dir).select("q", F.array_join("allowed", ",").alias("allowed"), "tier", F.col("primary").alias("first"))


@query("w02_evidence_window", WINDOW_SQL + " SELECT * FROM win", "retrieved", "gates")
def _(spark, sf_dir):
    return window_of(spark, sf_dir)


MANIFEST_SQL = WINDOW_SQL + """, man AS (SELECT q, count(*) AS n, sha256('[' || string_agg('{"position":"' || (position - 1) || '","source_id":"' || id || '","text_sha256":"' || sha256(text) || '"}', ',' ORDER BY position) || ']') AS sha256 FROM win GROUP BY q)"""


@query("w03_window_manifest", MANIFEST_SQL + " SELECT * FROM man", "retrieved", "gates")
def _(spark, sf_dir):
    return E.manifests(window_of(spark, sf_dir))


@query("w04_same_window", MANIFEST_SQL + " SELECT n, count(*) AS windows, count(DISTINCT sha256) AS distinct_hashes, count(DISTINCT sha256) = 1 AS same FROM man GROUP BY n", "retrieved", "gates")
def _(spark, sf_dir):
    return E.manifests(window_of(spark, sf_dir)).groupBy("n").agg(F.count("*").alias("windows"), F.countDistinct("sha256").alias("distinct_hashes")).withColumn("same", F.col("distinct_hashes") == 1)


@query("w05_width_sweep", ", ctl AS (SELECT q, list(control_id ORDER BY position) AS controls FROM fx_retrieved GROUP BY q), wd AS (SELECT q, w, controls[1:w] AS allowed FROM ctl, (SELECT unnest([1, 2, 3, 5]) AS w) x) SELECT CAST(w AS INTEGER) AS width, count(DISTINCT wd.q) AS queries, count(*) AS documents FROM wd JOIN fx_retrieved r ON r.q = wd.q AND list_contains(allowed, r.control_id) WHERE r.kind IN ('smt', 'gdn') GROUP BY w", "retrieved")
def _(spark, sf_dir):
    return E.width_sweep(fixture(spark, sf_dir, "retrieved"), (1, 2, 3, 5))


for _mode, _sql in (("all", "kind IN ('smt', 'gdn')"), ("smt_only", "kind = 'smt'"), ("prefer_smt", "kind IN ('smt', 'gdn') AND (kind = 'smt' OR NOT anys)"), ("prefer_smt_keep_params", "kind IN ('smt', 'gdn')")):
    _order = "CASE kind WHEN 'smt' THEN 0 ELSE 1 END, position" if "keep" in _mode else "position"
    QUERIES[f"p04_mode_{_mode}"] = lambda spark, sf_dir, m=_mode: E.by_mode(fixture(spark, sf_dir, "retrieved"), m, 3).select("q", "position", "id")
    ORACLES[f"p04_mode_{_mode}"] = with_fixtures(f", s AS (SELECT *, bool_or(kind = 'smt') OVER (PARTITION BY q) AS anys FROM fx_retrieved), f AS (SELECT q, id, row_number() OVER (PARTITION BY q ORDER BY {_order}) AS p FROM s WHERE {_sql}), d AS (SELECT q, id, min(p) AS p FROM f WHERE p <= 3 GROUP BY q, id) SELECT q, CAST(row_number() OVER (PARTITION BY q ORDER BY p) AS INTEGER) AS position, id FROM d", "retrieved")


@query("p01_clause_kinds", "SELECT kind, count(*) AS n FROM fx_clauses WHERE kind IN ('smt', 'gdn') GROUP BY kind", "clauses")
def _(spark, sf_dir):
    return fixture(spark, sf_dir, "clauses").where(F.col("kind").isin("smt", "gdn")).groupBy("kind").agg(F.count("*").alias("n"))


@query("p02_allowed_documents", GATE_SQL + " SELECT r.q, count(*) AS n FROM fx_retrieved r JOIN gate USING (q) WHERE len(allowed) = 0 OR list_contains(allowed, control_id) GROUP BY r.q", "retrieved", "gates")
def _(spark, sf_dir):
    return fixture(spark, sf_dir, "retrieved").join(gates_of(spark, sf_dir), "q").where((F.size("allowed") == 0) | F.array_contains("allowed", F.col("control_id"))).groupBy("q").agg(F.count("*").alias("n"))


@query("p03_no_enhancements", r"SELECT k, CASE WHEN k % 2 = 0 THEN id || '|ac-2.1_smt.a' ELSE id END AS ids FROM fx_clauses", "clauses")
def _(spark, sf_dir):
    return fixture(spark, sf_dir, "clauses").select("k", F.array_join(E.without_enhancements(F.array("id", F.lit("ac-2.1_smt.a")), F.col("k") % 2 == 0), "|").alias("ids"))


@query("p06_near_rewrites", ", t AS (SELECT k, list_distinct(regexp_extract_all(lower(name), '[a-z0-9]+')) AS a, name FROM fx_ids) SELECT k, name || CASE WHEN list_contains(a, 'red') THEN '|red thing of steel' ELSE '' END AS kept FROM t", "ids")
def _(spark, sf_dir):
    return fixture(spark, sf_dir, "ids").select("k", F.array_join(E.near_rewrites(F.col("name"), F.array("name", F.lit("nothing alike"), F.lit("red thing of steel"))), "|").alias("kept"))


@query("p07_near_rewrites_notebook", "SELECT k, name AS kept FROM fx_ids WHERE length(name) >= 6", "ids")
def _(spark, sf_dir):
    kept = F.array_distinct(F.filter(E.near_rewrites(F.col("name"), F.array("name", F.lit("abc"), "name")), lambda r: F.length(r) >= 6))
    return fixture(spark, sf_dir, "ids").select("k", F.array_join(kept, "|").alias("kept")).where("kept <> ''")


@query("p09_canonical_authority", ", s AS (SELECT sp.q, sp.position, c.id IS NOT NULL AND sp.span_text = c.text AND sp.control_id = c.control_id AS same FROM fx_spans sp LEFT JOIN fx_clauses c ON c.id = sp.source_id) SELECT q, count(*) AS n, count(*) FILTER (WHERE same) AS canonical FROM s GROUP BY q", "spans", "clauses")
def _(spark, sf_dir):
    c = fixture(spark, sf_dir, "clauses").select(F.col("id").alias("source_id"), F.col("text").alias("t"), F.col("control_id").alias("cc"))
    j = fixture(spark, sf_dir, "spans").join(c, "source_id", "left")
    same = F.col("t").isNotNull() & F.col("span_text").eqNullSafe(F.col("t")) & F.col("control_id").eqNullSafe(F.col("cc"))
    return j.groupBy("q").agg(F.count("*").alias("n"), F.count_if(same).alias("canonical"))


@query("w06_reconstructed_documents", "SELECT q, control_id, CAST(min(position) AS INTEGER) AS first_seen, count(DISTINCT id) AS clauses FROM fx_retrieved GROUP BY q, control_id", "retrieved")
def _(spark, sf_dir):
    return fixture(spark, sf_dir, "retrieved").groupBy("q", "control_id").agg(F.min("position").cast("int").alias("first_seen"), F.countDistinct("id").alias("clauses"))


@query("w09_sanitized_selection", ", w AS (SELECT q, list(id ORDER BY position) FILTER (WHERE position <= 3) AS win, list(id ORDER BY position DESC) AS sel FROM fx_retrieved GROUP BY q), x AS (SELECT q, unnest(sel) AS id, generate_subscripts(sel, 1) AS o, win FROM w), y AS (SELECT q, id, min(o) AS o FROM x WHERE list_contains(win, id) GROUP BY q, id) SELECT q, string_agg(id, ',' ORDER BY o) AS ids FROM y GROUP BY q", "retrieved")
def _(spark, sf_dir):
    rows = fixture(spark, sf_dir, "retrieved").groupBy("q").agg(F.array_sort(F.collect_list(F.struct("position", "id"))).alias("s"))
    ids = lambda a: F.transform(a, lambda x: x["id"])
    return rows.select("q", F.array_join(E.sanitize(F.reverse(ids(F.col("s"))), ids(F.filter("s", lambda x: x["position"] <= 3))), ",").alias("ids"))


@query("w10_status", "SELECT q, CASE WHEN upper(status) IN ('OK', 'PARAMS_REQUIRED', 'NO_EVIDENCE', 'ERROR') THEN upper(status) ELSE 'ERROR' END AS status FROM fx_headers", "headers")
def _(spark, sf_dir):
    return fixture(spark, sf_dir, "headers").select("q", E.status(F.col("status")).alias("status"))


WORDS = "list_distinct(regexp_extract_all(lower({}), '[a-z0-9]{{3,}}'))"
_question = "'small red widget required within'"


@query("w11_winner_control", f", s AS (SELECT q, control_id, count(*) AS n, max(len(list_intersect({WORDS.format(_question)}, {WORDS.format('text')}))) AS o FROM fx_retrieved GROUP BY q, control_id) SELECT q, control_id AS control FROM (SELECT *, row_number() OVER (PARTITION BY q ORDER BY n DESC, o DESC, control_id) AS r FROM s) WHERE r = 1", "retrieved")
def _(spark, sf_dir):
    return E.winners(fixture(spark, sf_dir, "retrieved").withColumn("question", F.lit("small red widget required within")))


@query("w13_canonical_fill", "SELECT r.q, r.position, c.id, c.text FROM fx_retrieved r JOIN fx_clauses c ON c.id = r.id WHERE c.kind IN ('smt', 'gdn')", "retrieved", "clauses")
def _(spark, sf_dir):
    return E.fill(fixture(spark, sf_dir, "retrieved").select("q", "position", "id"), fixture(spark, sf_dir, "clauses"))


@query("w12_w14_fallback", "SELECT q, id FROM (SELECT q, id, row_number() OVER (PARTITION BY q ORDER BY CASE WHEN q % 2 = 0 AND (contains(text, 'insert:') OR contains(text, '[Assignment:')) THEN 0 ELSE 1 END, position) AS r FROM fx_retrieved WHERE position <= 25 AND kind IN ('smt', 'gdn') AND trim(text) <> '') WHERE r = 1", "retrieved")
def _(spark, sf_dir):
    return E.secondary(fixture(spark, sf_dir, "retrieved"), F.col("q") % 2 == 0)


@query("w15_hierarchy_closure", None)
def _(spark, sf_dir):
    from clausegrid.plans.fixtures import derived

    edges = derived(spark, sf_dir, TREE_SQL).select("parent", "id", F.col("id").alias("label_key"))
    seeds = derived(spark, sf_dir, "SELECT CAST(r_regionkey AS BIGINT) AS q, concat('r', r_regionkey) AS id, 1 AS position FROM region")
    return E.closure(seeds, edges)


TREE_SQL = "SELECT concat('r', n_regionkey) AS parent, concat('n', n_nationkey) AS id FROM nation UNION ALL SELECT concat('n', s_nationkey) AS parent, concat('s', s_suppkey) AS id FROM supplier"
ORACLES["w15_hierarchy_closure"] = f"""WITH RECURSIVE e AS (SELECT *, row_number() OVER (PARTITION BY parent ORDER BY id) AS s FROM ({TREE_SQL})), k AS (SELECT * FROM e WHERE s <= 16),
t(q, id, o, level) AS (SELECT CAST(r_regionkey AS BIGINT), concat('r', r_regionkey), CAST(1 AS BIGINT), 0 FROM region UNION ALL SELECT q, k.id, o * 100 + s, level + 1 FROM t JOIN k ON k.parent = t.id WHERE level < 2)
SELECT q, id, CAST(level AS INTEGER) AS level FROM (SELECT *, row_number() OVER (PARTITION BY q ORDER BY level, o, id) AS r FROM t) WHERE r <= 64"""


@query("c02_ancestors", f"WITH RECURSIVE e AS ({TREE_SQL}), t(q, id, up) AS (SELECT CAST(s_suppkey AS BIGINT), concat('s', s_suppkey), 0 FROM supplier UNION ALL SELECT q, e.parent, up + 1 FROM t JOIN e ON e.id = t.id) SELECT q, id, CAST(min(up) AS INTEGER) AS up FROM t GROUP BY q, id")
def _(spark, sf_dir):
    from clausegrid.plans.fixtures import derived

    return E.ancestors(derived(spark, sf_dir, "SELECT CAST(s_suppkey AS BIGINT) AS q, concat('s', s_suppkey) AS id FROM supplier"), derived(spark, sf_dir, TREE_SQL))


RESCUE_SQL = """, sp AS (SELECT q, position, id, text FROM fx_retrieved WHERE position <= 2), h AS (SELECT q, bool_or(contains(text, 'insert:') OR contains(text, '[Assignment:')) AS has FROM sp GROUP BY q),
pool AS (SELECT r.q, r.id, min(r.position) AS position FROM fx_retrieved r JOIN h ON h.q = r.q AND NOT has WHERE r.kind = 'smt' AND (contains(r.text, 'insert:') OR contains(r.text, '[Assignment:')) AND NOT EXISTS (SELECT 1 FROM sp WHERE sp.q = r.q AND sp.id = r.id) GROUP BY r.q, r.id),
ad AS (SELECT *, row_number() OVER (PARTITION BY q ORDER BY CASE WHEN contains(id, '_smt.') THEN 0 ELSE 2 END, position, id) AS r FROM pool),
al AS (SELECT q, r - 1000 AS o, id, 'rescue' AS origin FROM ad WHERE r <= 4 UNION ALL SELECT q, position, id, 'selector' FROM sp)"""


def rescued(spark, sf_dir):
    rows = fixture(spark, sf_dir, "retrieved")
    pool = rows.where("kind = 'smt'").groupBy("q", "id").agg(F.min("position").alias("position"), F.first("text").alias("text"))
    return E.rescue(rows.where("position <= 2").select("q", "position", "id", "text"), pool)


@query("w17_parameter_rescue", RESCUE_SQL + " SELECT q, CAST(row_number() OVER (PARTITION BY q ORDER BY o) AS INTEGER) AS position, id, origin FROM al", "retrieved")
def _(spark, sf_dir):
    return rescued(spark, sf_dir).select("q", "position", "id", "origin")


@query("w18_single_origin", RESCUE_SQL + " SELECT q, bool_and(n = 1) AS ok FROM (SELECT q, id, count(DISTINCT origin) AS n FROM al GROUP BY q, id) GROUP BY q", "retrieved")
def _(spark, sf_dir):
    per = rescued(spark, sf_dir).groupBy("q", "id").agg(F.bool_or(F.col("origin") == "rescue").alias("r"), F.bool_or(F.col("origin") == "selector").alias("s"))
    return per.groupBy("q").agg(F.bool_and(E.single_origin([F.col("r"), F.col("s")])).alias("ok"))


@query("w23_rescue_replay", RESCUE_SQL + " SELECT origin, count(*) AS n, count(DISTINCT q) AS queries FROM al GROUP BY origin", "retrieved")
def _(spark, sf_dir):
    return rescued(spark, sf_dir).groupBy("origin").agg(F.count("*").alias("n"), F.countDistinct("q").alias("queries"))


@query("w19_primary_citation", f"SELECT q, arg_max(id, (len(list_intersect({WORDS.format(_question)}, {WORDS.format('text')})), -position)) AS id FROM fx_retrieved GROUP BY q", "retrieved")
def _(spark, sf_dir):
    return E.primary_citation(fixture(spark, sf_dir, "retrieved").withColumn("question", F.lit("small red widget required within")))


@query("w20_assembled_answer", "SELECT q, sha256(trim(string_agg(text, chr(10) || chr(10) ORDER BY position, id))) AS answer, string_agg(id, ', ' ORDER BY position, id) AS citations FROM fx_retrieved GROUP BY q", "retrieved")
def _(spark, sf_dir):
    return E.assembled(fixture(spark, sf_dir, "retrieved")).select("q", F.sha2("answer", 256).alias("answer"), "citations")


@query("w22_no_selector", WINDOW_SQL + " SELECT q, count(*) AS n, string_agg(id, ',' ORDER BY position) AS ids FROM win GROUP BY q", "retrieved", "gates")
def _(spark, sf_dir):
    return window_of(spark, sf_dir).groupBy("q").agg(F.count("*").alias("n"), F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("position", "id"))), lambda x: x["id"]), ",").alias("ids"))


@query("w21_w24_answer_status", "SELECT q, CASE WHEN upper(status) NOT IN ('OK', 'PARAMS_REQUIRED', 'NO_EVIDENCE') OR status = 'OK' AND trim(answer) = '' THEN 'ERROR' ELSE status END AS status, trim(answer) = '' AS no_answer FROM fx_headers", "headers")
def _(spark, sf_dir):
    s, a = E.status(F.col("status")), F.trim(F.col("answer"))
    return fixture(spark, sf_dir, "headers").select("q", F.when((s == "OK") & (a == ""), "ERROR").otherwise(s).alias("status"), (a == "").alias("no_answer"))


# ---------------------------------------------------------------- parameters

CURLY_SQL = r"'\{+\s*insert:\s*(?:param,\s*)?([^}]+?)\s*\}+'"
KEYS_SQL = f"list_sort(list_distinct(list_transform(regexp_extract_all(text, {CURLY_SQL}, 1), lambda x: trim(x))))"


def profile():
    """Values for parameters with an even index."""
    keys = [f"{f}-0{m}_odp.0{n}" for f in ("ac", "at", "au", "ca", "cm", "cp", "ia", "ir") for m in range(1, 10) for n in (2, 4, 6, 8)]
    return F.map_from_arrays(F.array(*map(F.lit, keys)), F.array(*(F.lit("v$1\\" + k) for k in keys)))


@query("o10_o11_apply_policy", f""", x AS (SELECT k, text, CASE k % 3 WHEN 0 THEN 'ASK' WHEN 1 THEN 'PRESERVE' ELSE 'auto' END AS p, {KEYS_SQL} AS keys, contains(text, '[Assignment:') AS bare FROM fx_clauses),
y AS (SELECT *, len(keys) > 0 AND p = 'auto' AND regexp_matches(keys[1], '_odp\\.0[2468]$') AS fill FROM x)
SELECT k, CASE WHEN fill THEN regexp_replace(text, {CURLY_SQL}, 'v$1\\\\' || keys[1]) ELSE text END AS answer, array_to_string(list_concat(CASE WHEN fill THEN [] ELSE keys END, CASE WHEN bare THEN ['__ASSIGNMENT_REQUIRED__'] ELSE [] END), ',') AS required,
  CASE WHEN (len(keys) > 0 AND NOT fill) OR bare THEN 'PARAMS_REQUIRED' ELSE 'OK' END AS status FROM y""", "clauses")
def _(spark, sf_dir):
    p = F.when(F.col("k") % 3 == 0, "ASK").when(F.col("k") % 3 == 1, "PRESERVE").otherwise("auto")
    r = fixture(spark, sf_dir, "clauses").select("k", P.apply_policy(F.col("text"), p, profile()).alias("r"))
    return r.select("k", "r.answer", F.array_join("r.required", ",").alias("required"), "r.status")


@query("o06_o07_canonical_parameters", r""", inv AS (SELECT regexp_replace(lower(p), '^([a-z]{2})-0?([0-9]+)_odp[._]0?([0-9]+)$', '\1-\2-\3') AS nk, min(p) AS id FROM (SELECT 'ac-0' || m || '_odp.0' || n AS p FROM (SELECT unnest(range(1, 10)) AS m), (SELECT unnest(range(1, 6)) AS n)) GROUP BY 1),
d AS (SELECT k, trim(regexp_extract(text, '\{+\s*insert:\s*(?:param,\s*)?([^}]+?)\s*\}+', 1)) AS key FROM fx_clauses)
SELECT k, inv.id AS param FROM d JOIN inv ON inv.nk = regexp_replace(lower(key), '^([a-z]{2})-0?([0-9]+)_odp[._]0?([0-9]+)$', '\1-\2-\3') WHERE key <> ''""", "clauses")
def _(spark, sf_dir):
    inventory = spark.createDataFrame([(f"ac-0{m}_odp.0{n}",) for m in range(1, 10) for n in range(1, 6)], "id string")
    inv = inventory.groupBy(P.normalize_parameter(F.col("id")).alias("nk")).agg(F.min("id").alias("param"))
    keys = fixture(spark, sf_dir, "clauses").select("k", F.explode(P.placeholder_keys(F.col("text"))).alias("key"))
    return keys.withColumn("nk", P.normalize_parameter(F.col("key"))).join(inv, "nk").select("k", "param")


@query("o14_ask_list", f", x AS (SELECT q, position, id, unnest({KEYS_SQL}) AS param FROM fx_retrieved) SELECT q, param, string_agg(id, ',' ORDER BY position) AS sources, count(*) AS n FROM x GROUP BY q, param", "retrieved")
def _(spark, sf_dir):
    x = fixture(spark, sf_dir, "retrieved").select("q", "position", "id", F.explode(P.placeholder_keys(F.col("text"))).alias("param"))
    return x.groupBy("q", "param").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("position", "id"))), lambda s: s["id"]), ",").alias("sources"), F.count("*").alias("n"))


@query("o12_o13_profile_lookup", "SELECT k, CASE k % 4 WHEN 0 THEN 'inner' WHEN 1 THEN 'outer' WHEN 2 THEN 'top' END AS value FROM fx_ids", "ids")
def _(spark, sf_dir):
    key = F.concat(F.lit("p"), (F.col("k") % 4).cast("string"))
    m = lambda **kv: F.create_map(*[F.lit(x) for p in kv.items() for x in p])
    return fixture(spark, sf_dir, "ids").select("k", P.literal(P.lookup(m(p0="inner", p3="{insert: x}"), m(p0="no", p1="outer"), m(p1="no", p2="top", p3="late"), key)).alias("value"))


@query("o16_profile_conditions", ", c AS (SELECT unnest(['complete', 'empty', 'partial', 'wrong_revision', 'unknown_keys', 'unversioned', 'placeholder_values', 'literal_backslashes']) AS condition), x AS (SELECT k, " + KEYS_SQL + " AS keys, contains(text, '[Assignment:') AS bare FROM fx_clauses) SELECT condition, count(*) AS n, count(*) FILTER (WHERE condition IN ('complete', 'literal_backslashes') AND NOT bare) AS resolved FROM x, c WHERE len(keys) > 0 GROUP BY condition", "clauses")
def _(spark, sf_dir):
    """Of the clauses with a placeholder those that a profile resolves whole, by condition."""
    from clausegrid.operators import audit as A

    contracts = spread(fixture(spark, sf_dir, "clauses"), "k").withColumn("spans", F.array(F.struct(F.col("id").alias("source_id"), F.col("text").alias("span_text"))))
    rows = A.resolution_outcomes(A.profile_cases(contracts)).where(F.size("keys") > 0)
    return rows.groupBy("condition").agg(F.count("*").alias("n"), F.count_if(F.col("r.status") == "OK").alias("resolved"))


# ---------------------------------------------------------------- verification

OPEN = r"(regexp_matches(lower({0}), '\{{+\s*insert\s*:') OR regexp_matches(lower({0}), '\[\s*assignment\s*:'))"
RESOLVE_SQL = """, cand AS (SELECT q, position, source_id, span_text, unnest(CASE WHEN contains(source_id, ':') THEN [source_id, string_split(source_id, ':')[-1], lower(source_id), lower(string_split(source_id, ':')[-1])] ELSE [source_id, lower(source_id)] END) AS c,
   generate_subscripts(CASE WHEN contains(source_id, ':') THEN [source_id, string_split(source_id, ':')[-1], lower(source_id), lower(string_split(source_id, ':')[-1])] ELSE [source_id, lower(source_id)] END, 1) AS o FROM fx_spans),
res AS (SELECT q, position, arg_min(k.id, (CASE WHEN c = k.id THEN 0 ELSE 1 END, o)) AS matched, arg_min(k.text, (CASE WHEN c = k.id THEN 0 ELSE 1 END, o)) AS official FROM cand JOIN fx_clauses k ON lower(c) = lower(k.id) GROUP BY q, position),
sp AS (SELECT s.*, matched, official FROM fx_spans s LEFT JOIN res ON res.q = s.q AND res.position = s.position)"""
VALID_SQL = RESOLVE_SQL + f""", nt AS (SELECT *, trim(regexp_replace(span_text, '\\s+', ' ', 'g')) AS a, trim(regexp_replace(official, '\\s+', ' ', 'g')) AS b FROM sp),
st AS (SELECT nt.q, unnest([CASE WHEN h.status <> 'NO_EVIDENCE' AND trim(span_text) = '' THEN 'MissingSpanText' END, CASE WHEN official IS NULL THEN 'UnknownSourceId' END, CASE WHEN official IS NOT NULL AND NOT (a <> '' AND contains(b, a)) THEN 'SpanNotVerbatim' END]) AS tag FROM nt JOIN fx_headers h ON h.q = nt.q),
ag AS (SELECT q, count(*) AS n, bool_or({OPEN.format('span_text')}) AS open FROM sp GROUP BY q),
hd AS (SELECT h.*, coalesce(n, 0) AS n, {OPEN.format('answer')} OR coalesce(open, false) AS open FROM fx_headers h LEFT JOIN ag ON ag.q = h.q),
ht AS (SELECT q, unnest(CASE WHEN status = 'bogus' THEN ['UnknownStatus', 'InvalidStatus'] WHEN status = 'ERROR' THEN ['StatusERROR'] ELSE [
  CASE WHEN status = 'NO_EVIDENCE' AND n > 0 THEN 'NoEvidenceButHasSpans' END, CASE WHEN status IN ('OK', 'PARAMS_REQUIRED') AND n = 0 THEN 'MissingEvidenceSpans' END,
  CASE WHEN required = 'param' THEN 'ODPListContainsParamToken' END, CASE WHEN status = 'PARAMS_REQUIRED' AND NOT open THEN 'ParamsRequiredButNoPlaceholders' END,
  CASE WHEN status = 'PARAMS_REQUIRED' AND required = '' THEN 'ParamsRequiredButODPListEmpty' END, CASE WHEN status = 'OK' AND open THEN 'OKButUnresolvedODPPlaceholders' END,
  CASE WHEN status = 'NO_EVIDENCE' AND n > 0 THEN 'NoEvidenceButSpansProvided' END, CASE WHEN status = 'NO_EVIDENCE' AND answer <> '' THEN 'NoEvidenceButAnswerTextNonEmpty' END] END) AS tag FROM hd),
al AS (SELECT * FROM ht UNION SELECT * FROM st), vd AS (SELECT h.q, count(tag) = 0 AS is_pass, coalesce(string_agg(tag, ',' ORDER BY tag), '') AS tags FROM fx_headers h LEFT JOIN al ON al.q = h.q AND tag IS NOT NULL GROUP BY h.q)"""


def contracts_of(spark, sf_dir):
    h = fixture(spark, sf_dir, "headers")
    return h.withColumn("required", F.filter(F.array("required"), lambda x: x != "")).withColumn("gold_required", F.filter(F.array("gold_required"), lambda x: x != ""))


def validity(spark, sf_dir):
    return V.contract_validity(contracts_of(spark, sf_dir).select("q", "status", "answer", "required"), fixture(spark, sf_dir, "spans").select("q", "position", "source_id", "span_text"), fixture(spark, sf_dir, "clauses"))


@query("v03_source_resolution", RESOLVE_SQL + " SELECT q, position, coalesce(matched, '') AS matched FROM sp", "spans", "clauses")
def _(spark, sf_dir):
    s = V.resolve_sources(fixture(spark, sf_dir, "spans").select("q", "position", "source_id"), fixture(spark, sf_dir, "clauses"))
    return s.select("q", "position", F.coalesce("matched", F.lit("")).alias("matched"))


@query("v02_verbatim_spans", RESOLVE_SQL + r""", n AS (SELECT q, position, trim(regexp_replace(span_text, '\s+', ' ', 'g')) AS a, trim(regexp_replace(official, '\s+', ' ', 'g')) AS b, trim(regexp_replace(regexp_replace(regexp_replace(span_text, '\{+[^}]*\}+', '', 'g'), '\[\s*[Aa]ssignment\s*:\s*[^\]]+\]', '', 'g'), '\s+', ' ', 'g')) AS c, trim(regexp_replace(regexp_replace(regexp_replace(official, '\{+[^}]*\}+', '', 'g'), '\[\s*[Aa]ssignment\s*:\s*[^\]]+\]', '', 'g'), '\s+', ' ', 'g')) AS d FROM sp) SELECT q, position, coalesce(a <> '' AND contains(b, a), false) AS strict, coalesce(c <> '' AND contains(d, c), false) AS normalized FROM n""", "spans", "clauses")
def _(spark, sf_dir):
    s = V.resolve_sources(fixture(spark, sf_dir, "spans").select("q", "position", "source_id", "span_text"), fixture(spark, sf_dir, "clauses"))
    v = V.verbatim(F.col("span_text"), F.col("official"))
    return s.select("q", "position", F.coalesce(v["strict"], F.lit(False)).alias("strict"), F.coalesce(v["normalized"], F.lit(False)).alias("normalized"))


@query("v01_v04_contract_validity", VALID_SQL + " SELECT * FROM vd", "spans", "clauses", "headers")
def _(spark, sf_dir):
    return validity(spark, sf_dir).select("q", "is_pass", F.array_join("tags", ",").alias("tags"))


@query("v21_validity_counts", VALID_SQL + " SELECT tag, count(*) AS n FROM al WHERE tag IS NOT NULL GROUP BY tag", "spans", "clauses", "headers")
def _(spark, sf_dir):
    return validity(spark, sf_dir).select(F.explode("tags").alias("tag")).groupBy("tag").agg(F.count("*").alias("n"))


@query("v05_set_metrics", ", g AS (SELECT q, list_distinct(list(control_id)) AS got, list_distinct(list(control_id) FILTER (WHERE position <= 2)) AS gold FROM fx_retrieved GROUP BY q), m AS (SELECT q, len(list_intersect(got, gold)) AS tp, len(got) AS a, len(coalesce(gold, [])) AS b FROM g) SELECT q, CAST(tp AS INTEGER) AS tp, round(tp / a::DOUBLE, 9) AS precision, CASE WHEN b = 0 THEN 0.0 ELSE round(tp / b::DOUBLE, 9) END AS recall, CASE WHEN tp = 0 THEN 0.0 ELSE round(2.0 * tp / (a + b)::DOUBLE, 9) END AS f1 FROM m", "retrieved")
def _(spark, sf_dir):
    g = fixture(spark, sf_dir, "retrieved").groupBy("q").agg(F.collect_set("control_id").alias("got"), F.collect_set(F.when(F.col("position") <= 2, F.col("control_id"))).alias("gold"))
    m = g.select("q", M.set_metrics(F.col("got"), F.col("gold")).alias("m"))
    return m.select("q", "m.tp", "m.precision", "m.recall", "m.f1")


@query("v06_citation_tags", ", g AS (SELECT q, list_sort(list_distinct(list(control_id))) AS got, list_sort(list_distinct(list(control_id) FILTER (WHERE position % 2 = 1))) || ['ZZ-1'] AS gold FROM fx_retrieved GROUP BY q) SELECT q, 'MissedControlCitations:[''ZZ-1'']' || CASE WHEN len(list_filter(got, lambda x: NOT list_contains(gold, x))) > 0 THEN '|ExtraControlCitations:[' || array_to_string(list_transform(list_filter(got, lambda x: NOT list_contains(gold, x)), lambda x: '''' || x || ''''), ', ') || ']' ELSE '' END AS tags FROM g", "retrieved")
def _(spark, sf_dir):
    g = fixture(spark, sf_dir, "retrieved").groupBy("q").agg(F.collect_set("control_id").alias("got"), F.concat(F.collect_set(F.when(F.col("position") % 2 == 1, F.col("control_id"))), F.array(F.lit("ZZ-1"))).alias("gold"))
    return g.select("q", F.array_join(V.citation_tags(F.col("got"), F.col("gold"), none(), none()), "|").alias("tags"))


@query("v07_parameter_tags", r""", x AS (SELECT *, CASE WHEN contains(answer, 'insert:') THEN 'ac-0' || (1 + q % 9) || '_odp.01' ELSE '' END AS seen, status = 'PARAMS_REQUIRED' AS asked, gold_required <> '' AS has FROM fx_headers),
t AS (SELECT q, list_filter([CASE WHEN seen <> '' AND asked AND seen <> required THEN 'ODPListMismatch:extracted=[''' || seen || '''],gen_list=[' || CASE WHEN required <> '' THEN '''' || required || '''' ELSE '' END || ']' END,
 CASE WHEN has AND policy IN ('ASK', 'PRESERVE') AND NOT asked THEN 'GoldPolicyASKButStatusNotParamsRequired' END, CASE WHEN has AND policy = 'FILL_FROM_PROFILE' THEN 'GoldPolicyFillFromProfileButNoOrgProfileProvided' END,
 CASE WHEN has AND asked AND required <> '' AND gold_required <> required THEN 'ODPRequiredListNotEqualGold:gold=[''' || gold_required || '''],gen=[''' || required || ''']' END, CASE WHEN has AND status = 'OK' AND contains(answer, 'insert:') THEN 'StatusOKButStillHasODPPlaceholders' END,
 CASE WHEN has AND policy = 'PRESERVE' AND gold_required <> seen THEN 'PreserveMissingPlaceholder:' || gold_required END], lambda z: z IS NOT NULL) AS t FROM x) SELECT q, array_to_string(t, '|') AS tags FROM t""", "headers")
def _(spark, sf_dir):
    c = contracts_of(spark, sf_dir)
    return c.select("q", F.array_join(V.parameter_tags(F.col("status"), F.col("policy"), F.col("answer"), none(), F.col("required"), F.col("gold_required")), "|").alias("tags"))


@query("v08_version_tags", "SELECT q, CASE q % 3 WHEN 0 THEN 'WARN:VersionNotProvableFromSourceIds' WHEN 1 THEN CASE WHEN version = 'rev4' THEN 'VersionMismatchInCitations:expected=rev4,got=rev5' ELSE '' END ELSE 'MixedVersionsInCitations:[''rev4'', ''rev5'']' END AS tags FROM fx_headers", "headers")
def _(spark, sf_dir):
    s = F.when(F.col("q") % 3 == 0, F.array(F.lit("plain"))).when(F.col("q") % 3 == 1, F.array(F.lit("Rev5:a"))).otherwise(F.array(F.lit("rev4/a"), F.lit("rev5/b")))
    return fixture(spark, sf_dir, "headers").select("q", F.array_join(V.version_tags(F.col("version"), s), "|").alias("tags"))


GOLD_SQL = VALID_SQL.split(", al AS")[0] + """, gold AS (SELECT q, arg_min(control_id, position) AS control_id, list_distinct(list(lower(id)) FILTER (WHERE position <= 2)) AS docs FROM fx_spans GROUP BY q),
got AS (SELECT q, list_distinct(list(lower(coalesce(matched, source_id)))) AS docs, bool_or(regexp_extract(upper(source_id), '(^|[^A-Z0-9])([A-Z]{2}-[0-9]+)', 2) = g.control_id) AS hit, avg(CASE WHEN coalesce(a <> '' AND contains(b, a), false) THEN 1.0 ELSE 0.0 END) AS verbatim FROM nt JOIN gold g USING (q) GROUP BY q)"""


@query("v09_gold_metrics", GOLD_SQL + ", m AS (SELECT got.q, status, verbatim, len(list_intersect(got.docs, gold.docs)) AS tp, len(got.docs) AS a, len(gold.docs) AS b FROM got JOIN gold USING (q) JOIN fx_headers h ON h.q = got.q) SELECT q, CASE WHEN status = 'ERROR' THEN 0.0 ELSE round(tp / a::DOUBLE, 9) END AS doc_precision, CASE WHEN status = 'ERROR' THEN 0.0 ELSE round(tp / b::DOUBLE, 9) END AS doc_recall, CASE WHEN status = 'ERROR' THEN -1.0 ELSE round(verbatim, 9) END AS verbatim_rate FROM m", "spans", "clauses", "headers")
def _(spark, sf_dir):
    spans = fixture(spark, sf_dir, "spans")
    gold = spans.groupBy("q").agg(F.min_by("control_id", "position").alias("control_id"), F.collect_set(F.when(F.col("position") <= 2, F.lower("id"))).alias("doc_ids"))
    h = contracts_of(spark, sf_dir)
    gold = gold.join(h.select("q", F.col("gold_required").alias("required_gold"), "policy", "version"), "q")
    r = V.gold_verification(h.select("q", "status", "answer", "required"), spans.select("q", "position", "source_id", "span_text"), fixture(spark, sf_dir, "clauses"), gold)
    return r.join(spans.select("q").distinct(), "q", "left_semi").select("q", "doc_precision", "doc_recall", F.nanvl("verbatim_rate", F.lit(-1.0)).alias("verbatim_rate"))


@query("v11_v12_revision_tags", "SELECT q, CASE q % 4 WHEN 0 THEN '' WHEN 1 THEN 'FrameworkVersionMissing' WHEN 2 THEN 'FrameworkVersionInvalid|RevisionLabelMismatch:evidence_spans[0].source_id:expected=rev5,got=rev4' ELSE 'FrameworkVersionMismatch:expected=rev5,got=rev4|RevisionLabelMismatch:primary_citation:expected=rev5,got=rev3|UnsupportedRevisionLabel:primary_citation' END AS tags FROM fx_headers", "headers")
def _(spark, sf_dir):
    r = F.col("q") % 4
    declared = F.when(r == 0, "Rev. 5").when(r == 2, "rev45").when(r == 3, "4")
    labels = F.array(F.struct(F.lit("evidence_spans[0].source_id").alias("place"), F.when(r == 2, "corpus_rev4:a").otherwise("a").alias("value")), F.struct(F.lit("primary_citation").alias("place"), F.when(r == 3, "see Revision 3").alias("value")))
    return fixture(spark, sf_dir, "headers").select("q", F.array_join(V.revision_tags(F.lit("rev5"), declared, labels), "|").alias("tags"))


@query("v13_mechanical_tags", "SELECT q, CASE q % 3 WHEN 0 THEN '' WHEN 1 THEN 'DuplicateEvidenceId|OutsideFrozenEvidenceWindow' ELSE 'AskListNotEqualDeclaredParameters|NotExactEligibleCCSId|OutsideFrozenEvidenceWindow|RetainedParameterUnionMismatch|StatusNotEqualRetainedParameterState' END AS tags FROM fx_headers", "headers")
def _(spark, sf_dir):
    r = F.col("q") % 3
    span = lambda i, t="plain": F.struct(F.lit(i).alias("source_id"), F.lit(t).alias("span_text"))
    spans = F.when(r == 0, F.array(span("a"))).when(r == 1, F.array(span("b"), span("b"))).otherwise(F.array(span("x", "{{ insert: param, p }}")))
    t = V.mechanical_tags(spans, F.array(F.lit("a")), F.array(F.lit("a"), F.lit("b")), F.lit("text"), F.lit("OK"), none(), F.array(F.lit("p")), F.when(r == 2, F.array(F.lit("p"))).otherwise(none()))
    return fixture(spark, sf_dir, "headers").select("q", F.array_join(t, "|").alias("tags"))


@query("v14_full_retention", "SELECT q, bool_and(span_text = text) AND bool_and(position <> 2 OR c.id IS NOT NULL) AS certified FROM fx_spans s LEFT JOIN fx_clauses c ON c.id = s.id GROUP BY q", "spans", "clauses")
def _(spark, sf_dir):
    j = fixture(spark, sf_dir, "spans").join(fixture(spark, sf_dir, "clauses").select("id", "text"), "id", "left")
    return j.groupBy("q").agg((F.bool_and(F.col("span_text") == F.col("text")) & F.bool_and((F.col("position") != 2) | F.col("text").isNotNull())).alias("certified"))


@query("v16_v17_strict_pass", VALID_SQL + " SELECT vd.q, is_pass AND vd.q % 5 <> 1 AND vd.q % 7 <> 2 AS v1, is_pass AND vd.q % 5 <> 1 AND vd.q % 7 <> 2 AND version = 'rev5' AS v2 FROM vd JOIN fx_headers h ON h.q = vd.q", "spans", "clauses", "headers")
def _(spark, sf_dir):
    j = validity(spark, sf_dir).join(fixture(spark, sf_dir, "headers").select("q", "version"), "q")
    gate = F.when(F.col("q") % 7 != 2, "pass")
    args = (F.col("is_pass"), F.lit(True), F.col("q") % 5 != 1, [F.lit("pass"), gate])
    return j.select("q", V.strict_pass(*args).alias("v1"), V.strict_pass(*args, F.col("version") == "rev5").alias("v2"))


@query("v19_evidence_coverage", "SELECT q, bool_or(position = 1) AND bool_or(kind = 'smt' AND position >= 2) AS covered FROM fx_retrieved GROUP BY q HAVING count(*) > 1", "retrieved")
def _(spark, sf_dir):
    ids = lambda c: F.collect_list(F.when(c, F.concat("id", F.lit("@"), F.col("position").cast("string"))))
    g = fixture(spark, sf_dir, "retrieved").groupBy("q").agg(ids(F.lit(True)).alias("every"), ids(F.col("position") == 1).alias("a"), ids((F.col("kind") == "smt") & (F.col("position") >= 2)).alias("b"), F.count("*").alias("n")).where("n > 1")
    return g.select("q", V.cnf_coverage(F.array("a", "b"), F.col("every")).alias("covered"))
