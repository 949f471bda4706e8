"""Inputs that queries derive from the given tables, in SQL that Spark and the checking engine both read."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession

TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents", "embeddings", "pages", "benchmark", "labels", "conversations")

_FAMILY = "substr('ACATAUCACMCPIAIR', CAST(1 + 2 * ({k} % 8) AS INT), 2)"

FIXTURES: dict[str, str] = {
    "ids": f"""
SELECT k, CASE CAST(k % 7 AS INT)
    WHEN 0 THEN concat(fam, '-', n) WHEN 1 THEN concat(lower(fam), '_', n) WHEN 2 THEN concat(fam, '-', n, '(', m, ')')
    WHEN 3 THEN concat(fam, '-0', n, '.0', m) WHEN 4 THEN concat(' ', lower(fam), '-', n, '.', m, ' ')
    WHEN 5 THEN concat(lower(fam), '-', n, '.', m, '_smt.a.', m) ELSE concat('see ', p_name) END AS raw, p_name AS name
FROM (SELECT p_partkey AS k, p_name, {_FAMILY.format(k="p_partkey")} AS fam, CAST(1 + p_partkey % 20 AS VARCHAR(9)) AS n, CAST(1 + p_size % 9 AS VARCHAR(9)) AS m FROM part)""",
    "clauses": f"""
SELECT k, concat(lower(fam), '-', n, CASE WHEN CAST(k % 5 AS INT) = 0 THEN '_gdn' WHEN CAST(k % 5 AS INT) = 4 THEN '_obj' ELSE '_smt.' END,
              CASE WHEN CAST(k % 5 AS INT) IN (0, 4) THEN '' ELSE CAST(k AS VARCHAR(20)) END, '.', k) AS id,
       concat(fam, '-', n) AS control_id, CASE WHEN CAST(k % 5 AS INT) = 0 THEN 'gdn' WHEN CAST(k % 5 AS INT) = 4 THEN 'obj' ELSE 'smt' END AS kind, title,
       concat(title, CASE CAST(k % 4 AS INT) WHEN 0 THEN concat(' within {{{{ insert: param, ', lower(fam), '-0', m, '_odp.0', 1 + k % 9, ' }}}}')
           WHEN 1 THEN concat(' {{ insert: ', lower(fam), '-', m, '_odp_', 1 + k % 9, ' }} and  [Assignment: organization-defined time]') WHEN 2 THEN '  as required' ELSE '' END) AS text
FROM (SELECT p_partkey AS k, p_name AS title, {_FAMILY.format(k="p_partkey")} AS fam, CAST(1 + p_partkey % 20 AS VARCHAR(9)) AS n, CAST(1 + p_size % 9 AS VARCHAR(9)) AS m FROM part)""",
    "retrieved": "SELECT l_orderkey AS q, CAST(row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey) AS INT) AS position, c.id, c.control_id, c.kind, c.text, c.title AS question FROM lineitem JOIN (@clauses) c ON l_partkey = c.k",
    "gates": "SELECT o_orderkey AS q, o_orderstatus AS status, CASE WHEN CAST(o_orderkey % 11 AS INT) = 10 THEN NULL ELSE CAST(o_orderkey % 11 AS DOUBLE) / 100 END AS margin FROM orders",
    "spans": """
SELECT q, position, CASE CAST(position % 4 AS INT) WHEN 1 THEN upper(id) WHEN 2 THEN concat('corpus:', id) WHEN 3 THEN concat(id, CASE WHEN q % 7 = 0 THEN 'x' ELSE '' END) ELSE id END AS source_id,
       CASE WHEN (q + position) % 9 = 0 THEN concat(text, ' more') WHEN (q + position) % 13 = 0 THEN ' ' ELSE text END AS span_text, id, control_id FROM (@retrieved) r""",
    "headers": """
SELECT o_orderkey AS q, CASE WHEN o_orderkey % 17 = 0 THEN 'ERROR' WHEN o_orderkey % 19 = 0 THEN 'bogus' WHEN o_orderstatus = 'F' THEN 'OK' WHEN o_orderstatus = 'O' THEN 'PARAMS_REQUIRED' ELSE 'NO_EVIDENCE' END AS status,
       CASE WHEN o_orderstatus = 'P' AND o_orderkey % 2 = 0 THEN '' WHEN o_orderkey % 3 = 0 THEN concat('Set {{ insert: param, ac-0', 1 + o_orderkey % 9, '_odp.01 }} now') ELSE 'Nothing is open.' END AS answer,
       CASE WHEN o_orderkey % 3 = 0 THEN concat('ac-0', 1 + o_orderkey % 9, '_odp.01') WHEN o_orderkey % 5 = 0 THEN 'param' ELSE '' END AS required,
       CASE CAST(o_orderkey % 4 AS INT) WHEN 0 THEN 'ASK' WHEN 1 THEN 'PRESERVE' WHEN 2 THEN 'FILL_FROM_PROFILE' ELSE '' END AS policy,
       CASE WHEN o_orderkey % 6 = 0 THEN concat('ac-0', 1 + o_orderkey % 9, '_odp.01') WHEN o_orderkey % 7 = 0 THEN 'at-01_odp.02' ELSE '' END AS gold_required,
       CASE WHEN o_orderkey % 2 = 0 THEN 'rev5' ELSE 'rev4' END AS version FROM orders""",
    "queries": "SELECT item_id AS q, text AS query FROM benchmark",
    "paired": "SELECT l.doc_id AS k, d.lang AS stratum, l.quality AS a, l.toxic AS b FROM labels l JOIN documents d ON l.doc_id = d.doc_id",
}


for _name in FIXTURES:
    while "@" in FIXTURES[_name]:
        FIXTURES[_name] = re.sub(r"@(\w+)", lambda m: FIXTURES[m[1]], FIXTURES[_name])

_READS = re.compile(r"\b(FROM|JOIN)\s+(%s)\b" % "|".join(TABLES))


def derived(spark: SparkSession, sf_dir: str, sql: str) -> DataFrame:
    """Runs SQL over the tables of a folder."""
    return spark.sql(_READS.sub(rf"\1 parquet.`{sf_dir}/\2.parquet`", sql))


def fixture(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return derived(spark, sf_dir, FIXTURES[name])


def spread(rows: DataFrame, key: str) -> DataFrame:
    """The rows dealt over all cores by their key, for work that is much more than reading them: a compressed table is few splits, so few tasks would do it."""
    return rows.repartition(4 * rows.sparkSession.sparkContext.defaultParallelism, key)


def with_fixtures(sql: str, *names: str) -> str:
    """The checking SQL with its fixtures in front; sql may begin with further definitions, `, name AS (...)`."""
    head = ", ".join(f"fx_{n} AS ({FIXTURES[n]})" for n in names)
    return f"WITH {head} {sql}" if names else sql
