"""Queries of joins, aggregates, windows, set operations, statistics, samples, mutations and hashes."""

from __future__ import annotations

from pyspark.sql import functions as F

from clausegrid.functions.text import rotate_alnum
from clausegrid.operators import metrics as M, mutate as X, provenance as H, relational as A, retrieval as R
from clausegrid.plans.fixtures import derived, fixture, spread, with_fixtures

QUERIES: dict = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None, *fixtures: str):
    def add(f):
        QUERIES[name] = f
        if sql:
            ORACLES[name] = with_fixtures(sql, *fixtures)
        return f

    return add


def rel(name: str, source: str, make, sql: str) -> None:
    """A relational query over a SQL source."""
    QUERIES[name] = lambda spark, sf_dir: make(derived(spark, sf_dir, source))
    ORACLES[name] = f"WITH src AS ({source}) {sql}"


ORDERS = "SELECT o_orderkey AS k, o_custkey AS c, o_orderstatus AS status, o_orderpriority AS priority, o_totalprice AS price FROM orders"
LINES = "SELECT l_orderkey AS k, l_linenumber AS n, l_partkey AS p, l_quantity AS quantity, l_returnflag AS flag, l_linestatus AS ls FROM lineitem"
PAIRS = "SELECT l.doc_id AS k, d.lang AS stratum, d.source AS source, l.quality AS a, l.toxic AS b FROM labels l JOIN documents d ON l.doc_id = d.doc_id"
EVENTS = "SELECT event_id AS k, event_type AS system, value FROM events"

# ---------------------------------------------------------------- joins


@query("j01_inner_paired", "SELECT a.k, a.system AS left_system, b.system AS right_system FROM (SELECT event_id AS k, event_type AS system FROM events) a JOIN (SELECT o_orderkey AS k, o_orderstatus AS system FROM orders) b ON a.k = b.k")
def _(spark, sf_dir):
    a = derived(spark, sf_dir, EVENTS).select("k", F.col("system").alias("left_system"))
    return A.inner_paired(a, derived(spark, sf_dir, ORDERS).select("k", F.col("status").alias("right_system")), "k")


@query("j02_left_labels_pivoted", "SELECT d.doc_id AS k, max(l.quality) AS quality, max(l.toxic) AS toxic FROM documents d LEFT JOIN labels l ON l.doc_id = d.doc_id GROUP BY d.doc_id")
def _(spark, sf_dir):
    long = derived(spark, sf_dir, "SELECT d.doc_id AS k, l.quality, l.toxic FROM documents d LEFT JOIN labels l ON l.doc_id = d.doc_id")
    long = long.select("k", F.explode(F.create_map(F.lit("quality"), "quality", F.lit("toxic"), "toxic")).alias("label", "v"))
    return A.labels_wide(long, "k", "label", "v", ["quality", "toxic"])


@query("j04_full_outer_keys", "SELECT count(*) FILTER (WHERE a.k IS NULL) AS only_right, count(*) FILTER (WHERE b.k IS NULL) AS only_left FROM (SELECT DISTINCT doc_id AS k FROM labels) a FULL JOIN (SELECT doc_id AS k FROM documents) b ON a.k = b.k")
def _(spark, sf_dir):
    return A.key_difference(derived(spark, sf_dir, "SELECT doc_id AS k FROM labels"), derived(spark, sf_dir, "SELECT doc_id AS k FROM documents"), "k")


for _kind, _there, _sql in (("j05_left_semi", True, "IN"), ("j06_left_anti", False, "NOT IN")):
    QUERIES[_kind] = lambda spark, sf_dir, there=_there: A.with_keys(derived(spark, sf_dir, "SELECT doc_id AS k, source FROM documents"), derived(spark, sf_dir, "SELECT doc_id AS k FROM labels"), "k", there)
    ORACLES[_kind] = f"SELECT doc_id AS k, source FROM documents WHERE doc_id {_sql} (SELECT doc_id FROM labels)"


@query("j07_containment", "SELECT s.q, s.position, contains(c.text, s.span_text) AS inside FROM fx_spans s JOIN fx_clauses c ON c.id = s.id", "spans", "clauses")
def _(spark, sf_dir):
    return A.contained(fixture(spark, sf_dir, "spans"), fixture(spark, sf_dir, "clauses"), "id", "span_text", "text").select("q", "position", "inside")


@query("j09_hierarchy_self_join", "SELECT n.n_nationkey AS id, r.r_name AS parent, count(s.s_suppkey) AS children FROM nation n JOIN region r ON n.n_regionkey = r.r_regionkey LEFT JOIN supplier s ON s.s_nationkey = n.n_nationkey GROUP BY n.n_nationkey, r.r_name")
def _(spark, sf_dir):
    nodes = derived(spark, sf_dir, "SELECT n_nationkey AS id, n_regionkey AS r FROM nation")
    return A.with_children(nodes, derived(spark, sf_dir, "SELECT r_regionkey AS r, r_name AS parent FROM region"), derived(spark, sf_dir, "SELECT s_nationkey AS n FROM supplier"), "r", "parent", "n")


@query("j10_conditions", "SELECT c.condition, status, count(*) AS n FROM orders, (SELECT unnest(['a', 'b', 'c']) AS condition) c, LATERAL (SELECT CASE WHEN c.condition = 'a' THEN o_orderstatus ELSE c.condition END AS status) GROUP BY c.condition, status")
def _(spark, sf_dir):
    changes = {"a": lambda d: d, "b": lambda d: d.withColumn("status", F.lit("b")), "c": lambda d: d.withColumn("status", F.lit("c"))}
    return A.counted(A.for_conditions(derived(spark, sf_dir, ORDERS).select("status"), changes), ["condition", "status"])


@query("j11_null_safe_fallback", "SELECT k, coalesce(nullif(CASE WHEN k % 3 = 0 THEN '' ELSE raw END, ''), name) AS id, CASE WHEN k % 3 = 0 THEN NULL ELSE raw END IS NOT DISTINCT FROM raw AS same FROM fx_ids", "ids")
def _(spark, sf_dir):
    x = F.when(F.col("k") % 3 != 0, F.col("raw"))
    return fixture(spark, sf_dir, "ids").select("k", A.filled(x, F.col("name")).alias("id"), x.eqNullSafe(F.col("raw")).alias("same"))


# ---------------------------------------------------------------- aggregates

KINDS = ("click", "error", "purchase", "signup", "view")
_means = lambda rest: ", ".join(f"coalesce(round(avg({rest}) FILTER (WHERE system = '{x}'), 6), -1) AS \"{x}\"" for x in KINDS)

rel("g01_group_count", ORDERS, lambda d: A.counted(d, ["status"]), "SELECT status, count(*) AS n FROM src GROUP BY status")
rel("g02_mean_and_size", PAIRS, lambda d: A.means(d, ["stratum"], ["a", "b"]), "SELECT stratum, count(*) AS n, round(avg(a), 9) AS a, round(avg(b), 9) AS b FROM src GROUP BY stratum")
rel("g03_pivot_means", EVENTS, lambda d: A.pivot_means(d.withColumn("g", F.col("k") % 4), ["g"], "system", F.col("value")), f"SELECT k % 4 AS g, {_means('value')} FROM src GROUP BY k % 4")
rel("g04_null_group", "SELECT doc_id AS k, lang FROM documents", lambda d: A.counted_with_missing(d, "lang"), "SELECT coalesce(lang, '?') AS lang, count(*) AS n FROM src GROUP BY 1")
rel("g05_buckets", "SELECT l_orderkey AS k, count(*) AS n FROM lineitem GROUP BY l_orderkey", lambda d: A.counted(d.select(A.size_bucket(F.col("n")).alias("bucket")), ["bucket"]), "SELECT CASE WHEN n <= 1 THEN '0-1' WHEN n = 2 THEN '2' WHEN n <= 4 THEN '3-4' ELSE '5+' END AS bucket, count(*) AS n FROM src GROUP BY 1")
rel("g06_top_tags", "SELECT p_name AS name FROM part", lambda d: A.top_tags(d, F.split("name", " ")), "SELECT tag, count(*) AS n FROM (SELECT unnest(string_split(name, ' ')) AS tag FROM src) GROUP BY tag ORDER BY n DESC, tag LIMIT 30")
rel("g07_tag_prefixes", ORDERS, lambda d: A.prefix_counts(d, "priority", "-"), "SELECT string_split(priority, '-')[1] AS prefix, count(*) AS n FROM src GROUP BY 1")
rel("g08_conditional_rates", ORDERS, lambda d: A.rates(d, ["priority"], F.col("status") == "F", "f"), "SELECT priority, count(*) FILTER (WHERE status = 'F') AS f, round(count(*) FILTER (WHERE status = 'F') / count(*)::DOUBLE, 9) AS rate FROM src GROUP BY priority")
rel("g09_distinct_counts", LINES, lambda d: A.distinct_counts(d, ["flag"], {"orders": ["k"], "pairs": ["p", "ls"]}), "SELECT flag, count(DISTINCT k) AS orders, count(DISTINCT (p, ls)) AS pairs FROM src GROUP BY flag")
rel("g10_distribution", EVENTS, lambda d: M.distribution(d, "value", ["system"]), "SELECT system, count(value) AS n, round(min(value), 9) AS min, round(avg(value), 6) AS mean, round(quantile_cont(value::DOUBLE, 0.5), 9) AS p50, round(quantile_cont(value::DOUBLE, 0.95), 9) AS p95, round(max(value), 9) AS max FROM src GROUP BY system")
rel("g15_latency_summary", LINES, lambda d: M.distribution(d, "quantity", ["flag"]), "SELECT flag, count(quantity) AS n, round(min(quantity), 9) AS min, round(avg(quantity), 6) AS mean, round(quantile_cont(quantity::DOUBLE, 0.5), 9) AS p50, round(quantile_cont(quantity::DOUBLE, 0.95), 9) AS p95, round(max(quantity), 9) AS max FROM src GROUP BY flag")
rel("g11_nan_mean", EVENTS, lambda d: A.nan_mean(d.withColumn("value", F.when(F.col("k") % 5 == 0, float("nan")).otherwise(F.col("value"))), ["system"], "value"), "SELECT system, round(avg(value) FILTER (WHERE k % 5 <> 0), 6) AS mean FROM src GROUP BY system")
rel("g12_argmax", LINES, lambda d: A.best_row(d, ["k"], "quantity", "n").withColumnRenamed("n", "line"), "SELECT k, max(quantity) AS top, arg_max(n, (quantity, -n)) AS line FROM src GROUP BY k")
rel("g13_ordered_lists", LINES, lambda d: A.joined_lists(d, ["k"], "n", "p", "flag").withColumnsRenamed({"values": "parts", "kinds": "flags"}), "SELECT k, string_agg(CAST(p AS VARCHAR), ',' ORDER BY n, p) AS parts, array_to_string(list_sort(list(DISTINCT flag)), ',') AS flags FROM src GROUP BY k")
rel("g14_optional_sums", "SELECT o_orderstatus AS status, CASE WHEN o_orderkey % 2 = 0 THEN o_orderkey END AS tokens FROM orders", lambda d: A.optional_sums(d, ["status"], "tokens"), "SELECT status, CAST(coalesce(sum(tokens), 0) AS BIGINT) AS total, count(tokens) AS present FROM src GROUP BY status")
rel("g16_strata_and_pooled", ORDERS, lambda d: A.by_stratum_and_pooled(d, "status", F.col("priority") == "1-URGENT"), "SELECT coalesce(status, 'pooled') AS status, count(*) AS n, count(*) FILTER (WHERE priority = '1-URGENT') AS hits FROM src GROUP BY ROLLUP (status)")
rel("g17_revision_and_combined", LINES, lambda d: A.by_levels(d, ["flag", "ls"]), "SELECT coalesce(flag, 'all') AS flag, coalesce(ls, 'all') AS ls, count(*) AS n FROM src GROUP BY GROUPING SETS ((flag, ls), (flag), ())")

# ---------------------------------------------------------------- windows, sorts, set operations

def by_price(d):
    return R.ranked(d, ["c"], [F.desc("price"), F.col("k")], "r")


rel("n01_top_k_per_group", ORDERS, lambda d: R.ranked(d, ["c"], [F.desc("price"), F.col("k")], "r", 3).select("c", "k", "r"), "SELECT c, k, CAST(r AS INTEGER) AS r FROM (SELECT *, row_number() OVER (PARTITION BY c ORDER BY price DESC, k) AS r FROM src) WHERE r <= 3")
rel("n02_lead_margin", ORDERS, lambda d: R.margin(by_price(d).withColumnRenamed("c", "q"), "price", "r", "margin").withColumnRenamed("q", "c"), "SELECT c, round(coalesce((price - nx) / price, 1.0), 9) AS margin FROM (SELECT *, row_number() OVER w AS r, lead(price) OVER w AS nx FROM src WINDOW w AS (PARTITION BY c ORDER BY price DESC, k)) WHERE r = 1")
rel("n03_first_and_last", ORDERS, lambda d: A.first_and_last(d, ["c"], "status", "k"), "SELECT c, arg_min(status, k) AS first, arg_max(status, k) AS last FROM src GROUP BY c")
rel("n04_partition_scaling", ORDERS, lambda d: d.select("k", F.round(R.min_max("price", ["c"]), 9).alias("v")), "SELECT k, round((price - min(price) OVER (PARTITION BY c)) / greatest(max(price) OVER (PARTITION BY c) - min(price) OVER (PARTITION BY c), 1e-12), 9) AS v FROM src")
rel("n05_numeric_then_text_order", "SELECT p_partkey AS k, CASE WHEN p_partkey % 3 = 0 THEN p_name ELSE CAST(p_partkey AS VARCHAR(20)) END AS id FROM part", lambda d: A.positions(d, [*A.numeric_then_text(F.col("id")), F.asc("k")]).select("k", "id", "position"), "SELECT k, id, row_number() OVER (ORDER BY TRY_CAST(id AS BIGINT) NULLS LAST, id, k) AS position FROM src")
rel("n06_union_distinct", LINES, lambda d: A.all_of(d.select("flag", F.col("ls").alias("s")), d.select(F.lit("x").alias("flag"), F.col("ls").alias("s")), distinct=True), "SELECT flag, ls AS s FROM src UNION SELECT 'x', ls FROM src")
rel("n07_intersect", LINES, lambda d: A.common(d.where("flag = 'R'").select("p"), d.where("flag = 'A'").select("p")), "SELECT p FROM src WHERE flag = 'R' INTERSECT SELECT p FROM src WHERE flag = 'A'")
rel("n08_except_all", LINES, lambda d: A.surplus(d.where("flag = 'R'").select("p"), d.where("flag = 'A'").select("p")), "SELECT p FROM src WHERE flag = 'R' EXCEPT ALL SELECT p FROM src WHERE flag = 'A'")
rel("n09_duplicates", LINES, lambda d: A.repeated(d, ["k", "p"]), "SELECT k, p, count(*) AS n FROM src GROUP BY k, p HAVING count(*) > 1")
rel("n10_flatten", "SELECT conv_id AS k, turn, text FROM conversations", lambda d: A.words_of(d, ["k", "turn"], "text"), "SELECT k, turn, CAST(o - 1 AS INTEGER) AS pos, word FROM (SELECT k, turn, unnest(string_split(text, ' ')) AS word, generate_subscripts(string_split(text, ' '), 1) AS o FROM src)")

# ---------------------------------------------------------------- statistics

WILSON = "(p + {z2} / (2 * n)) / (1 + {z2} / n) {s} 1.959963984540054 * sqrt(p * (1 - p) / n + {z2} / (4 * n * n)) / (1 + {z2} / n)"
_w = lambda s: WILSON.format(z2="3.841458820694124", s=s)


def _rates(d):
    g = d.groupBy("source").agg(F.sum("a").alias("s"), F.count("*").alias("n"))
    low, high = M.wilson(F.col("s").cast("double"), F.col("n").cast("double"), True)
    return g.select("source", "n", F.round(low, 6).alias("low"), F.round(high, 6).alias("high"))


rel("m05_wilson", PAIRS, _rates, f"SELECT source, n, round(greatest(round({_w('-')}, 9), 0), 6) AS low, round(least(round({_w('+')}, 9), 1), 6) AS high FROM (SELECT source, count(*) AS n, sum(a) / count(*)::DOUBLE AS p FROM src GROUP BY source)")
TABLE2 = "t AS (SELECT source, count(*) FILTER (WHERE a = 1 AND b = 0) AS lo, count(*) FILTER (WHERE a = 0 AND b = 1) AS ro, count(*) FILTER (WHERE a = 1 AND b = 1) AS bb, count(*) FILTER (WHERE a = 0 AND b = 0) AS nn FROM src GROUP BY source)"
rel("m06_mcnemar", PAIRS, lambda d: M.paired_table(d, "a", "b", ["source"]).select("source", F.round(M.mcnemar_exact(F.col("left_only"), F.col("right_only")), 8).alias("p")), f", {TABLE2} SELECT source, round(CASE WHEN lo + ro = 0 THEN 1.0 ELSE least(1.0, 2 * list_sum(list_transform(range(0, least(lo, ro) + 1), lambda i: exp(lgamma(lo + ro + 1.0) - lgamma(i + 1.0) - lgamma(lo + ro - i + 1.0) - (lo + ro) * ln(2.0))))) END, 8) AS p FROM t")
_lc = lambda n, k: f"(lgamma({n} + 1.0) - lgamma({k} + 1.0) - lgamma({n} - {k} + 1.0))"
rel("m07_fisher", PAIRS, lambda d: M.paired_table(d, "a", "b", ["source"]).select("source", F.round(M.fisher_exact(F.col("both"), F.col("left_only"), F.col("right_only"), F.col("neither")), 8).alias("p")),
    f", {TABLE2}, f AS (SELECT source, bb + lo AS r, bb + ro AS c, bb + lo + ro + nn AS n, bb AS x FROM t) SELECT source, round(least(1.0, list_sum(list_filter(list_transform(range(greatest(0, r + c - n), least(r, c) + 1), lambda i: exp({_lc('c', 'i')} + {_lc('(n - c)', '(r - i)')} - {_lc('n', 'r')})), lambda q: q <= exp({_lc('c', 'x')} + {_lc('(n - c)', '(r - x)')} - {_lc('n', 'r')}) * (1 + 1e-9)))), 8) AS p FROM f")
rel("m08_paired_table", PAIRS, lambda d: M.paired_table(d, "a", "b", ["stratum"]), "SELECT stratum, count(*) FILTER (WHERE a = 1 AND b = 0) AS left_only, count(*) FILTER (WHERE a = 0 AND b = 1) AS right_only, count(*) FILTER (WHERE a = 1 AND b = 1) AS both, count(*) FILTER (WHERE a = 0 AND b = 0) AS neither FROM src GROUP BY stratum")
rel("m09_paired_deltas", PAIRS, lambda d: M.paired_deltas(d, "a", "b", ["stratum"]), "SELECT stratum, count(*) FILTER (WHERE b > a) AS improved, count(*) FILTER (WHERE b = a) AS tied, count(*) FILTER (WHERE b < a) AS worsened, round(avg(b - a), 9) AS mean_delta FROM src GROUP BY stratum")


def _bootstrap(d):
    both = M.bootstrap(d.withColumn("d", F.col("b") - F.col("a")), "d", ["stratum"], "k", draws=400)
    return both.select("stratum", "n", *(F.round(c, 9).alias(c) for c in ("mean", "low", "high")))


_passed = " + ".join(f"CAST(u >= {t} AS INTEGER)" for t in M.POISSON)
rel("m10_bootstrap", PAIRS, _bootstrap, f""", h AS (SELECT stratum, b - a AS d, block, md5('42|' || k || '|' || block) AS h FROM src, (SELECT unnest(range(0, 100)) AS block) x),
u AS (SELECT stratum, d, block, j, CAST('0x' || substr(h, 1 + 8 * j, 8) AS BIGINT) AS u FROM h, (SELECT unnest(range(0, 4)) AS j) x),
m AS (SELECT stratum, block, j, sum(({_passed}) * d) / nullif(sum({_passed}), 0)::DOUBLE AS m FROM u GROUP BY stratum, block, j),
e AS (SELECT stratum, quantile_cont(m, 0.025) AS low, quantile_cont(m, 0.975) AS high FROM m GROUP BY stratum)
SELECT s.stratum, s.n, round(s.mean, 9) AS mean, round(low, 9) AS low, round(high, 9) AS high FROM (SELECT stratum, count(*) AS n, avg(b - a) AS mean FROM src GROUP BY stratum) s JOIN e ON e.stratum = s.stratum""")
rel("m11_gate_counterfactuals", PAIRS, lambda d: M.gate_counterfactuals(d, ["stratum"], "a", "b"), "SELECT stratum, count(*) FILTER (WHERE a = 1 AND b = 0) AS prevented_error, count(*) FILTER (WHERE a = 0 AND b = 1) AS blocked_correction FROM src GROUP BY stratum")
rel("m12_kappa", PAIRS, lambda d: M.kappa(d, "a", "b", ["stratum"]), ", m AS (SELECT stratum, count(*) AS n, avg(CASE WHEN a = b THEN 1.0 ELSE 0 END) AS po, avg(a) * avg(b) + (1 - avg(a)) * (1 - avg(b)) AS pe FROM src GROUP BY stratum) SELECT stratum, n, round(po, 9) AS observed, round(pe, 9) AS expected, round((po - pe) / (1 - pe), 9) AS kappa FROM m")
_ids = lambda x, name: F.filter(F.array(F.col("source"), F.when(F.col(x) == 1, F.lit(name))), lambda v: v.isNotNull())
rel("m13_retest_summary", PAIRS, lambda d: M.retest_summary(d, ["stratum"], _ids("a", "good"), _ids("b", "good")), "SELECT stratum, count(*) AS n, count(*) FILTER (WHERE a = b) AS exact, round(avg(CASE WHEN a = b THEN 1.0 ELSE 0.5 END), 9) AS mean_jaccard FROM src GROUP BY stratum")
SAMPLE_SQL = "s AS (SELECT stratum, k FROM (SELECT *, row_number() OVER (PARTITION BY stratum ORDER BY sha256('7|retest|' || stratum || '|' || k), k) AS r FROM src) WHERE r <= 8)"
rel("m14_stratified_sample", PAIRS, lambda d: M.seeded_sample(d, "7", "retest", "stratum", "k", 8).select("stratum", "k"), f", {SAMPLE_SQL} SELECT stratum, k FROM s")
rel("m15_blinded_order", PAIRS, lambda d: M.blinded(M.seeded_sample(d, "7", "retest", "stratum", "k", 8), "7", "k").select("k", "position", "blind_id"), f", {SAMPLE_SQL} SELECT k, CAST(p AS INTEGER) AS position, 'IR-' || lpad(CAST(p AS VARCHAR), 3, '0') AS blind_id FROM (SELECT k, row_number() OVER (ORDER BY sha256('7|display|' || k), k) AS p FROM s)")
rel("m16_hash_order_sample", "SELECT item_id AS k FROM benchmark", lambda d: M.hash_order_sample(d, "q", "k", 20), "SELECT k, sha256('q|' || k) AS h FROM src ORDER BY h LIMIT 20")


rel("m17_realization_loss", PAIRS, lambda d: M.realization_loss(d, ["stratum"], "a", "b"), "SELECT stratum, count(*) AS n, count(*) FILTER (WHERE b = 0) AS lost, round(count(*) FILTER (WHERE b = 0) / count(*)::DOUBLE, 9) AS loss FROM src WHERE a = 1 GROUP BY stratum")
rel("m18_parameter_rates", PAIRS, lambda d: M.detection_rates(d, ["stratum"], "a", "b"), "SELECT stratum, round(coalesce(count(*) FILTER (WHERE a = 1 AND b = 1) / nullif(count(*) FILTER (WHERE b = 1), 0)::DOUBLE, -1), 9) AS sensitivity, round(coalesce(count(*) FILTER (WHERE a = 0 AND b = 0) / nullif(count(*) FILTER (WHERE b = 0), 0)::DOUBLE, -1), 9) AS specificity, round(coalesce(count(*) FILTER (WHERE a = 1 AND b = 1) / nullif(count(*) FILTER (WHERE a = 1), 0)::DOUBLE, -1), 9) AS precision FROM src GROUP BY stratum")


@query("m19_window_opportunity", ", g AS (SELECT q % 10 AS part, q, id FROM fx_retrieved WHERE position % 2 = 1), w AS (SELECT q % 10 AS part, q, id, text FROM fx_retrieved WHERE position <= 2), h AS (SELECT g.part, g.q, count(w.id)::DOUBLE / count(*) AS r FROM (SELECT DISTINCT * FROM g) g LEFT JOIN (SELECT DISTINCT q, id FROM w) w ON w.q = g.q AND w.id = g.id GROUP BY g.part, g.q), m AS (SELECT part, count(*) FILTER (WHERE contains(text, 'insert')) AS markers FROM w GROUP BY part) SELECT part, round(avg(r), 9) AS recall, max(markers) AS markers FROM h JOIN m USING (part) GROUP BY part", "retrieved")
def _(spark, sf_dir):
    rows = fixture(spark, sf_dir, "retrieved").withColumn("part", F.col("q") % 10)
    return M.window_opportunity(rows.where("position % 2 = 1").select("part", "q", "id"), rows.where("position <= 2"), "part", F.contains("text", F.lit("insert")))


_modes = ", ".join(f"coalesce(round(avg(1.0 / (1 + k % 10)) FILTER (WHERE system = '{x}'), 9), 0) AS \"{x}\"" for x in KINDS)
rel("m20_error_mode_pivot", EVENTS, lambda d: A.pivot_means(d.withColumn("g", F.col("k") % 3), ["g"], "system", 1 / (1 + F.col("k") % 10), None, 9, 0.0), f"SELECT k % 3 AS g, {_modes} FROM src GROUP BY k % 3")
rel("m21_reproduction_rate", PAIRS, lambda d: M.reproduction_rate(d, ["source"], "a", "b"), "SELECT source, round(avg(CASE WHEN a = b THEN 1.0 ELSE 0 END), 9) AS rate FROM src GROUP BY source")
rel("m22_origin_summary", LINES, lambda d: M.origin_summary(d, "flag", "p"), "SELECT flag, count(*) AS occurrences, count(DISTINCT p) AS uniques FROM src GROUP BY flag")


@query("m23_id_preservation", r", x AS (SELECT k, regexp_extract_all(upper(raw), '[A-Z]{2,3}-[0-9]+(?:\([0-9]+\)|\.[0-9]+)?') AS r, CASE WHEN k % 2 = 0 THEN regexp_extract_all(upper(raw), '[A-Z]{2,3}-[0-9]+(?:\([0-9]+\)|\.[0-9]+)?') ELSE ['AC-1'] END AS o FROM fx_ids) SELECT count(*) AS n, round(1 - avg(CASE WHEN len(list_filter(r, lambda i: NOT list_contains(o, i))) > 0 THEN 1.0 ELSE 0 END), 9) AS ratio FROM x WHERE len(r) > 0", "ids")
def _(spark, sf_dir):
    from clausegrid.functions.text import controls_in

    got = controls_in(F.upper("raw"))
    x = fixture(spark, sf_dir, "ids").select(got.alias("r"), F.when(F.col("k") % 2 == 0, got).otherwise(F.array(F.lit("AC-1"))).alias("o")).where(F.size("r") > 0)
    return x.agg(F.count("*").alias("n"), F.round(1 - F.avg((F.size(F.array_except("r", "o")) > 0).cast("double")), 9).alias("ratio"))


rel("m24_decomposition", PAIRS, lambda d: M.decomposition(d, ["stratum"], "a", "b"), "SELECT stratum, count(*) FILTER (WHERE a = 1) AS covered, count(*) FILTER (WHERE a = 1 AND b = 1) AS strict FROM src GROUP BY stratum")
_nc = """, t AS (SELECT source, count(*) FILTER (WHERE a = 1 AND b = 1)::DOUBLE AS a, count(*) FILTER (WHERE a = 1 AND b = 0)::DOUBLE AS b, count(*) FILTER (WHERE a = 0 AND b = 1)::DOUBLE AS c, count(*) FILTER (WHERE a = 0 AND b = 0)::DOUBLE AS d, count(*)::DOUBLE AS n, 1.959963984540054 AS z FROM src GROUP BY source),
s AS (SELECT *, (a + b) / n AS p1, (a + c) / n AS p2, (a + b) * (c + d) * (a + c) * (b + d) AS m, a * d - b * c AS x FROM t),
w AS (SELECT *, (p1 + z * z / (2 * n)) / (1 + z * z / n) AS m1, z * sqrt(p1 * (1 - p1) / n + z * z / (4 * n * n)) / (1 + z * z / n) AS h1, (p2 + z * z / (2 * n)) / (1 + z * z / n) AS m2, z * sqrt(p2 * (1 - p2) / n + z * z / (4 * n * n)) / (1 + z * z / n) AS h2,
  CASE WHEN m > 0 THEN (CASE WHEN x > n / 2 THEN x - n / 2 WHEN x >= 0 THEN 0 ELSE x END) / sqrt(m) ELSE 0 END AS phi FROM s)
SELECT source, round(p1 - p2 - sqrt(greatest((p1 - m1 + h1) ** 2 - 2 * phi * (p1 - m1 + h1) * (m2 + h2 - p2) + (m2 + h2 - p2) ** 2, 0)), 6) AS low,
  round(p1 - p2 + sqrt(greatest((m1 + h1 - p1) ** 2 - 2 * phi * (m1 + h1 - p1) * (p2 - m2 + h2) + (p2 - m2 + h2) ** 2, 0)), 6) AS high FROM w"""


def _newcombe(d):
    low, high = M.newcombe_paired(*(F.col(c) for c in ("both", "left_only", "right_only", "neither")))
    return M.paired_table(d, "a", "b", ["source"]).select("source", F.round(low, 6).alias("low"), F.round(high, 6).alias("high"))


rel("m25_newcombe_paired", PAIRS, _newcombe, _nc)
rel("m25_holm", "SELECT s_nationkey AS g, s_suppkey AS test, CAST(1 + s_suppkey % 97 AS DOUBLE) / 1000 AS p FROM supplier", lambda d: M.holm(d, ["g"], "p", "test").select("g", "test", "adjusted"),
    ", r AS (SELECT *, least(1.0, (count(*) OVER (PARTITION BY g) - row_number() OVER (PARTITION BY g ORDER BY p, test) + 1) * p) AS raw FROM src) SELECT g, test, round(max(raw) OVER (PARTITION BY g ORDER BY p, test ROWS UNBOUNDED PRECEDING), 9) AS adjusted FROM r")
rel("m26_missing_bounds", "SELECT d.source AS source, l.quality AS passed FROM documents d LEFT JOIN labels l ON l.doc_id = d.doc_id", lambda d: M.missing_bounds(d, ["source"], "passed"), "SELECT source, count(*) FILTER (WHERE passed = 1) AS lower, count(*) FILTER (WHERE passed = 1 OR passed IS NULL) AS upper FROM src GROUP BY source")


# ---------------------------------------------------------------- mutations, replay, hashes


@query("x01_swap_source", ", n AS (SELECT id, coalesce(lead(id) OVER (ORDER BY id), min(id) OVER ()) AS nx FROM fx_clauses) SELECT s.q, s.position, n.nx AS source_id FROM fx_spans s JOIN n ON n.id = s.id", "spans", "clauses")
def _(spark, sf_dir):
    return X.swap_source(fixture(spark, sf_dir, "spans").select("q", "position", F.col("id").alias("source_id")), fixture(spark, sf_dir, "clauses").select("id"))


@query("x02_alter_first_character", "SELECT q, position, CASE WHEN regexp_matches(span_text, '[A-Za-z0-9]') THEN translate(substr(span_text, 1, 1), 'abcdefghijklmnopqrstuvwxyz', 'bcdefghijklmnopqrstuvwxyza') || substr(span_text, 2) ELSE span_text END AS span_text FROM fx_spans", "spans")
def _(spark, sf_dir):
    return fixture(spark, sf_dir, "spans").select("q", "position", X.alter_first(F.col("span_text")).alias("span_text"))


@query("x03_other_revision", ", o AS (SELECT id, row_number() OVER (ORDER BY id) - 1 AS i, count(*) OVER () AS n FROM fx_clauses) SELECT h.q, o.id FROM fx_headers h JOIN o ON o.i = (h.q + 2 * n - 1) % n", "clauses", "headers")
def _(spark, sf_dir):
    return X.by_modulo(fixture(spark, sf_dir, "headers").select("q"), fixture(spark, sf_dir, "clauses").select("id"))


@query("x04_x05_drop_and_flip", "SELECT q, array_to_string(list_filter([required, policy], lambda x: x <> '')[1:-2], '|') AS left_over, CASE status WHEN 'OK' THEN 'PARAMS_REQUIRED' WHEN 'PARAMS_REQUIRED' THEN 'OK' ELSE status END AS status FROM fx_headers", "headers")
def _(spark, sf_dir):
    values = F.filter(F.array("required", "policy"), lambda x: x != "")
    return fixture(spark, sf_dir, "headers").select("q", F.array_join(X.drop_last(values), "|").alias("left_over"), X.flip_status(F.col("status")).alias("status"))


X6_SQL = """, nx AS (SELECT id, coalesce(lead(id) OVER (ORDER BY id), min(id) OVER ()) AS following FROM fx_clauses), c AS (SELECT s.*, following, k.text AS official, h.status, h.required FROM fx_spans s JOIN nx ON nx.id = s.id JOIN fx_clauses k ON k.id = s.id JOIN fx_headers h ON h.q = s.q),
m AS (SELECT *, unnest(['swap', 'alter', 'foreign', 'drop', 'flip']) AS op FROM c),
d AS (SELECT op, CASE op WHEN 'swap' THEN following <> id WHEN 'alter' THEN regexp_matches(span_text, '[A-Za-z0-9]') WHEN 'foreign' THEN true WHEN 'drop' THEN required <> '' ELSE status IN ('OK', 'PARAMS_REQUIRED') END AS changed FROM m)
SELECT op, count(*) AS n, count(*) FILTER (WHERE changed) AS changed FROM d GROUP BY op"""


@query("x06_mutation_summary", X6_SQL, "spans", "clauses", "headers")
def _(spark, sf_dir):
    """Five mutations of every citation and of its contract: the next source, an altered character, a source of the other revision, a dropped parameter, a flipped status."""
    clauses = fixture(spark, sf_dir, "clauses").select("id")
    spans = fixture(spark, sf_dir, "spans").select("q", "position", "span_text", F.col("id").alias("source_id"))
    # the citation goes along with its source, so it is not joined with itself again
    swapped = X.swap_source(spans.withColumn("own", F.col("source_id")), clauses).withColumnsRenamed({"source_id": "following", "own": "source_id"})
    rows = swapped.join(fixture(spark, sf_dir, "headers").select("q", "status", "required"), "q")
    listed = F.filter(F.array("required"), lambda x: x != "")
    made = {"swap": (F.col("source_id"), F.col("following")), "alter": (F.col("span_text"), X.alter_first(F.col("span_text"))), "foreign": (F.col("source_id"), F.concat(F.lit("other:"), F.col("source_id"))),
            "drop": (F.array_join(listed, "|"), F.array_join(X.drop_last(listed), "|")), "flip": (F.col("status"), X.flip_status(F.col("status")))}
    each = rows.select(F.explode(F.array(*(F.struct(F.lit(op).alias("op"), a.alias("before"), b.alias("after")) for op, (a, b) in made.items()))).alias("m")).select("m.*")
    return X.mutation_summary(each, "op", F.col("before") != F.col("after"), F.col("before") != F.col("after")).select("op", "n", "changed")


@query("x07_revision_mutations", """, m AS (SELECT id, unnest(['none', 'opposite_declaration', 'missing_declaration', 'unknown_declaration', 'ambiguous_declaration', 'nonstring_declaration', 'opposite_source_namespace', 'opposite_packed_source_namespace', 'opposite_citation_label']) AS mutation, k FROM fx_clauses),
r AS (SELECT *, CASE WHEN k % 2 = 0 THEN 'rev5' ELSE 'rev4' END AS own, CASE WHEN k % 2 = 0 THEN 'rev4' ELSE 'rev5' END AS other FROM m)
SELECT k, mutation, CASE mutation WHEN 'none' THEN '' WHEN 'opposite_declaration' THEN 'FrameworkVersionMismatch:expected=' || own || ',got=' || other WHEN 'missing_declaration' THEN 'FrameworkVersionMissing'
  WHEN 'opposite_source_namespace' THEN 'RevisionLabelMismatch:evidence_spans[0].source_id:expected=' || own || ',got=' || other WHEN 'opposite_packed_source_namespace' THEN 'RevisionLabelMismatch:evidence_spans[0].source_id:expected=' || own || ',got=' || other
  WHEN 'opposite_citation_label' THEN 'RevisionLabelMismatch:all_citations:expected=' || own || ',got=' || other ELSE 'FrameworkVersionInvalid' END AS tags FROM r""", "clauses")
def _(spark, sf_dir):
    """Each clause as a contract that declares its revision, and its eight mutations with the tags that they get."""
    from clausegrid.operators.verify import contract_labels, revision_tags

    own = F.when(F.col("k") % 2 == 0, "rev5").otherwise("rev4")
    contracts = spread(fixture(spark, sf_dir, "clauses"), "k").select("k", own.alias("revision"), own.alias("declared"), F.array(F.struct(F.col("id").alias("source_id"))).alias("spans"), F.lit("").alias("all_citations"))
    rows = X.revision_mutations(contracts)
    labels = contract_labels(F.col("spans"), F.lit(None).cast("string"), F.col("all_citations"), F.lit(None).cast("string"))
    return rows.select("k", "mutation", F.array_join(revision_tags(F.col("revision"), F.col("declared"), labels, F.col("is_text")), "|").alias("tags"))


@query("x09_x10_replay_deltas", ", a AS (SELECT q, CASE WHEN status = 'bogus' THEN 'ERROR' WHEN q % 23 = 0 THEN 'NO_EVIDENCE' ELSE status END AS after FROM fx_headers WHERE q % 29 <> 0), j AS (SELECT status, after, CASE WHEN status = 'bogus' THEN 'ERROR' ELSE status END AS expected FROM fx_headers h LEFT JOIN a ON a.q = h.q), c AS (SELECT status, count(*) AS n, count(*) FILTER (WHERE after <> status) AS changed, count(*) FILTER (WHERE after <> expected) AS unexpected, count(*) FILTER (WHERE after IS NULL) AS missing FROM j GROUP BY status) SELECT *, unexpected = 0 AND missing = 0 AS accepted FROM c", "headers")
def _(spark, sf_dir):
    """The second run repairs unknown statuses, which is foreseen, changes some others and lacks some rows."""
    h = fixture(spark, sf_dir, "headers").select("q", "status")
    repaired = F.when(F.col("status") == "bogus", "ERROR")
    before = h.withColumn("expected", F.coalesce(repaired, F.col("status")))
    after = h.where("q % 29 <> 0").withColumn("status", F.coalesce(repaired, F.when(F.col("q") % 23 == 0, F.lit("NO_EVIDENCE")), F.col("status")))
    return X.replay_deltas(before, after, "q", "status", "expected")


@query("x13_x14_paired_summary", "SELECT stratum, count(*) AS n, count(*) FILTER (WHERE a = 1 AND b = 0) AS left_only, count(*) FILTER (WHERE a = 0 AND b = 1) AS right_only, 0 AS unmatched FROM fx_paired GROUP BY stratum", "paired")
def _(spark, sf_dir):
    rows = fixture(spark, sf_dir, "paired")
    return M.paired_outputs(rows.select("k", "stratum", F.col("a").alias("passed")), rows.select("k", "stratum", F.col("b").alias("passed")), "k", "stratum")


_statuses = ", ".join(f"count(*) FILTER (WHERE {x}_status = '{s}') AS {name}_{s.lower()}" for x, name in (("l", "left"), ("r", "right")) for s in M.STATUSES)
_p = "round(CASE WHEN lo + ro = 0 THEN 1.0 ELSE least(1.0, 2 * list_sum(list_transform(range(0, least(lo, ro) + 1), lambda i: exp(lgamma(lo + ro + 1.0) - lgamma(i + 1.0) - lgamma(lo + ro - i + 1.0) - (lo + ro) * ln(2.0))))) END, 6)"


@query("x14_paired_summary", f""", b AS (SELECT q, version, gold_required <> '' AS parameters, status = 'OK' AS l, upper(status) AS l_status, CASE WHEN q % 29 = 0 THEN NULL ELSE (q + q // 32) % 3 <> 0 END AS r, CASE WHEN q % 29 = 0 THEN NULL WHEN q % 5 = 0 THEN 'ERROR' ELSE upper(status) END AS r_status FROM fx_headers),
e AS (SELECT *, unnest(CASE WHEN parameters THEN ['all', 'parameters'] ELSE ['all'] END) AS part FROM b),
t AS (SELECT version, part, count(*) AS n, count(*) FILTER (WHERE l AND r) AS "both", count(*) FILTER (WHERE l AND NOT r) AS lo, count(*) FILTER (WHERE NOT l AND r) AS ro, count(*) FILTER (WHERE NOT l AND NOT r) AS neither, count(*) FILTER (WHERE r IS NULL) AS unmatched, {_statuses},
  count(*) FILTER (WHERE l_status = 'BOGUS') AS left_other, count(*) FILTER (WHERE r_status = 'BOGUS') AS right_other FROM e GROUP BY version, part)
SELECT * EXCLUDE (lo, ro), lo AS left_only, ro AS right_only, {_p} AS p FROM t""", "headers")
def _(spark, sf_dir):
    """Two runs over the same questions; the second lacks some, and fails on others."""
    h = fixture(spark, sf_dir, "headers").select("q", "version", "status", (F.col("gold_required") != "").alias("parameters"))
    left = h.withColumn("passed", F.col("status") == "OK")
    right = h.where("q % 29 <> 0").withColumn("passed", F.expr("(q + q div 32) % 3 <> 0")).withColumn("status", F.when(F.col("q") % 5 == 0, "ERROR").otherwise(F.col("status")))
    return M.paired_summary(left, right, "q", "version")


@query("h01_canonical_hash", """SELECT k, sha256('{"kind":"' || kind || '","n":' || k || ',"title":"' || title || '"}') AS sha256 FROM fx_clauses""", "clauses")
def _(spark, sf_dir):
    return fixture(spark, sf_dir, "clauses").select("k", H.canonical_hash(title=F.col("title"), kind=F.col("kind"), n=F.col("k")).alias("sha256"))


@query("h03_self_hash", "SELECT k, k % 10 <> 0 AND k % 11 <> 0 AS valid FROM fx_clauses", "clauses")
def _(spark, sf_dir):
    """Hashes are made of the JSON text; then some records lose theirs and some change."""
    c = fixture(spark, sf_dir, "clauses").select("k", "title")
    c = c.withColumn("own", F.when(F.col("k") % 11 != 0, F.sha2(F.concat(F.lit('{"k":'), "k", F.lit(',"title":"'), "title", F.lit('"}')), 256)))
    c = c.withColumn("title", F.when(F.col("k") % 10 == 0, F.concat("title", F.lit("!"))).otherwise(F.col("title")))
    return c.select("k", H.self_hash_valid(F.col("own"), title=F.col("title"), k=F.col("k")).alias("valid"))


@query("h04_expected_hashes", "SELECT CAST(item_id AS VARCHAR) AS path FROM benchmark WHERE item_id % 9 = 0 OR item_id % 10 = 0 UNION ALL SELECT 'missing'")
def _(spark, sf_dir):
    """A manifest with some wrong hashes, some files that it does not name and one that is not there."""
    b = derived(spark, sf_dir, "SELECT item_id AS k, text FROM benchmark").select("k", F.col("k").cast("string").alias("path"), F.sha2("text", 256).alias("sha256"))
    want = b.where("k % 10 <> 0").select("path", F.when(F.col("k") % 9 == 0, "none").otherwise(F.col("sha256")).alias("sha256"))
    return H.locked(b, want.unionByName(want.limit(1).select(F.lit("missing").alias("path"), F.lit("x").alias("sha256")))).select("path")
