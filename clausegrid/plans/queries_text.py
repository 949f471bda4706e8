"""Queries of the text, identifier and list functions, and of the filters."""

from __future__ import annotations

from pyspark.sql import functions as F

from clausegrid.functions import params as P, text as X
from clausegrid.plans.fixtures import fixture, spread, with_fixtures

QUERIES: dict = {}
ORACLES: dict[str, str] = {}


def scalar(name: str, source: str, make, sql: str, key: str = "k") -> None:
    """A query of one function over a fixture: columns key and value."""

    def run(spark, sf_dir):
        rows = spread(fixture(spark, sf_dir, source), key)
        return rows.select(key, make().alias("value"))

    QUERIES[name] = run
    ORACLES[name] = with_fixtures(f"SELECT {key}, {sql} AS value FROM fx_{source}", source)


C = F.col
JOINED = lambda x: F.array_join(x, "|")
LIST = "array_to_string({}, '|')"
SQL_NORM = r"trim(regexp_replace(regexp_replace(replace(lower({}), '-', ' '), '[^0-9A-Za-z_ \t\n\x0B\f\r]+', ' ', 'g'), '[ \t\n\x0B\f\r]+', ' ', 'g'))"
SQL_TOKENS = "regexp_extract_all(lower(regexp_replace({}, '[^A-Za-z0-9]+', ' ', 'g')), '[a-z0-9]+')"
SQL_RETRIEVAL = r"regexp_replace(replace(upper(trim({})), '_', '-'), '^([A-Z]{{2,3}}-[0-9]+)\.([0-9]+)$', '\1(\2)')"
SQL_FIRST = r"regexp_extract(upper(trim({})), '(^|[^A-Z0-9])([A-Z]{{2}}-[0-9]+(?:\([0-9]+\)|\.[0-9]+)?)($|[^A-Z0-9])', 2)"


def sql_canonical(x: str) -> str:
    part = lambda k: rf"regexp_extract({x}, '^([A-Z]{{2}})-([0-9]+)(?:\(([0-9]+)\)|\.([0-9]+))?$', {k})"
    return f"({part(1)} || '-' || CAST(TRY_CAST({part(2)} AS BIGINT) AS VARCHAR) || CASE WHEN {part(3)} || {part(4)} <> '' THEN '(' || CAST(TRY_CAST({part(3)} || {part(4)} AS BIGINT) AS VARCHAR) || ')' ELSE '' END)"


scalar("t01_normalize_text", "queries", lambda: X.normalize_text(C("query")), SQL_NORM.format("query"), "q")
scalar("t02_tokenize", "queries", lambda: JOINED(X.tokenize(C("query"))), LIST.format(SQL_TOKENS.format("query")), "q")
scalar("t03_token_set", "queries", lambda: JOINED(F.array_sort(X.token_set(C("query")))), LIST.format("list_sort(list_distinct(regexp_extract_all(lower(query), '[a-z0-9]{3,}')))"), "q")
scalar("t04_text_jaccard", "ids", lambda: F.round(X.text_jaccard(C("raw"), C("name")), 9),
       "CASE WHEN len(a) = 0 OR len(b) = 0 THEN 0.0 ELSE round(len(list_intersect(a, b)) / len(list_distinct(list_concat(a, b)))::DOUBLE, 9) END")
ORACLES["t04_text_jaccard"] = with_fixtures(
    "SELECT k, CASE WHEN len(a) = 0 OR len(b) = 0 THEN 0.0 ELSE round(len(list_intersect(a, b)) / len(list_distinct(list_concat(a, b)))::DOUBLE, 9) END AS value FROM (SELECT k, list_distinct("
    + SQL_TOKENS.format(SQL_NORM.format("raw")) + ") AS a, list_distinct(" + SQL_TOKENS.format(SQL_NORM.format("name")) + ") AS b FROM fx_ids)", "ids")
scalar("t05_set_jaccard", "ids", lambda: F.round(X.jaccard(X.controls_in(F.upper("raw")), X.controls_in(F.upper("name")), 1.0), 9), "0")
ORACLES["t05_set_jaccard"] = with_fixtures(
    r"SELECT k, CASE WHEN len(a) = 0 AND len(b) = 0 THEN 1.0 WHEN len(a) = 0 OR len(b) = 0 THEN 0.0 ELSE round(len(list_intersect(a, b)) / len(list_distinct(list_concat(a, b)))::DOUBLE, 9) END AS value FROM (SELECT k, list_distinct(regexp_extract_all(upper(raw), '[A-Z]{2,3}-[0-9]+(?:\([0-9]+\)|\.[0-9]+)?')) AS a, list_distinct(regexp_extract_all(upper(name), '[A-Z]{2,3}-[0-9]+(?:\([0-9]+\)|\.[0-9]+)?')) AS b FROM fx_ids)", "ids")
scalar("t06_control_for_retrieval", "ids", lambda: X.control_for_retrieval(C("raw")), SQL_RETRIEVAL.format("raw"))
scalar("t07_control_for_gate", "ids", lambda: X.control_for_gate(C("raw")),
       r"CASE WHEN regexp_matches(upper(trim(raw)), '(^|[^A-Z])([A-Z]{2})-0*[0-9]+') THEN regexp_extract(upper(trim(raw)), '(^|[^A-Z])([A-Z]{2})-0*([0-9]+)', 2) || '-' || CAST(CAST(regexp_extract(upper(trim(raw)), '(^|[^A-Z])([A-Z]{2})-0*([0-9]+)', 3) AS INTEGER) AS VARCHAR) END")
scalar("t08_control_for_verifier", "ids", lambda: X.control_for_verifier(C("raw")), f"CASE WHEN {SQL_FIRST.format('raw')} <> '' THEN {sql_canonical(SQL_FIRST.format('raw'))} END")
scalar("t09_control_of_source", "clauses", lambda: X.control_of_source(F.replace(C("id"), F.lit("_"), F.lit(":"))), "CASE WHEN " + SQL_FIRST.format("replace(id, '_', ':')") + " <> '' THEN " + sql_canonical(SQL_FIRST.format("replace(id, '_', ':')")) + " END")
scalar("t10_control_for_retest", "ids", lambda: X.control_for_retest(C("raw")),
       r"CASE WHEN regexp_matches(upper(trim(raw)), '^[A-Z]{2}-[0-9]+(?:\([0-9]+\)|\.[0-9]+)?$') THEN " + sql_canonical("upper(trim(raw))") + " ELSE upper(trim(raw)) END")
scalar("t11_control_aliases", "ids", lambda: X.control_aliases(C("raw")), "0")
ORACLES["t11_control_aliases"] = with_fixtures(
    rf"SELECT k, array_to_string(list_sort(list_distinct(list_filter([c, replace(c, '-', ''), replace(c, '-', ' '), d, replace(d, '-', ''), replace(d, '-', ' ')], lambda x: x IS NOT NULL AND x <> ''))), ' ') AS value FROM (SELECT k, c, CASE WHEN regexp_matches(c, '^[A-Z]{{2,3}}-[0-9]+\([0-9]+\)$') THEN regexp_replace(c, '\(([0-9]+)\)$', '.\1') END AS d FROM (SELECT k, {SQL_RETRIEVAL.format('raw')} AS c FROM fx_ids))", "ids")
scalar("t12_alnum_key", "ids", lambda: X.alnum_key(C("raw")), "regexp_replace(lower(raw), '[^a-z0-9]', '', 'g')")
scalar("t13_strip_meta", "ids", lambda: X.strip_meta(F.concat(F.lit("Please include the control citation: "), C("name"), F.lit(", kindly under NIST SP 800-53.")))["text"], "trim(name) || ' under NIST SP 800-53'")
ORACLES["t13_strip_meta"] = with_fixtures("SELECT k, name AS value FROM fx_ids", "ids")
scalar("t14_privilege_scope", "ids", lambda: X.privilege_scope(F.concat(C("name"), F.element_at(F.array(F.lit(" non-privileged user"), F.lit(" Privileged use"), F.lit(" by admins"), F.lit(" for all")), (C("k") % 4 + 1).cast("int"))), True),
       "CASE k % 4 WHEN 0 THEN 'non_privileged' WHEN 3 THEN 'neutral' ELSE 'privileged' END")
scalar("t15_retrieval_query", "ids", lambda: X.retrieval_query(F.concat(C("name"), F.lit(" MFA for admins with citations")))["query"],
       "name || ' MFA for admins multi-factor authentication privileged account privileged accounts privileged user privileged users'")
scalar("t16_augment_enhancements", "ids", lambda: X.augment_enhancements(C("raw")), r"CASE WHEN regexp_matches(raw, '\b[A-Za-z]{2}-[0-9]{1,2}\([0-9]+\)\b') THEN raw ELSE raw END")
scalar("t17_coerce_rewrites", "ids", lambda: JOINED(X.coerce_rewrites(F.array(C("raw"), F.lit("  "), C("name"), F.lit(None).cast("string")))), "trim(raw) || '|' || name")
scalar("t18_control_hints", "ids", lambda: JOINED(X.control_hints(F.concat(C("raw"), F.lit(" or AC-2, AC-02(3) and "), C("raw")))), "0")
ORACLES["t18_control_hints"] = with_fixtures(r"""
, f AS (SELECT k, regexp_extract_all(' ' || upper(raw || ' or AC-2, AC-02(3) and ' || raw), '(?:^|[^A-Z0-9])[A-Z]{2}-[0-9]{1,2}(?:\([0-9]{1,2}\)|\.[0-9]{1,2})') AS e,
    regexp_extract_all(' ' || replace(upper(raw || ' or AC-2, AC-02(3) and ' || raw), '.', ' .') || ' ', '[^A-Z0-9][A-Z]{2}-[0-9]{1,2}[^0-9]') AS b FROM fx_ids),
g AS (SELECT k, list_transform(e, lambda m: regexp_extract(m, '([A-Z]{2})-', 1) || '-' || CAST(CAST(regexp_extract(m, '-0*([0-9]+)', 1) AS INTEGER) AS VARCHAR) || '.' || CAST(CAST(regexp_extract(m, '[(.]0*([0-9]+)', 1) AS INTEGER) AS VARCHAR)) AS e,
    list_transform(b, lambda m: regexp_extract(m, '([A-Z]{2})-', 1) || '-' || CAST(CAST(regexp_extract(m, '-0*([0-9]+)', 1) AS INTEGER) AS VARCHAR)) AS b FROM f),
h AS (SELECT k, e, list_filter(b, lambda c: len(list_filter(e, lambda x: starts_with(x, c || '.'))) = 0) AS b FROM g),
o AS (SELECT k, v, min(p) AS p FROM (SELECT k, unnest(list_concat(e, b)) AS v, generate_subscripts(list_concat(e, b), 1) AS p FROM h) GROUP BY k, v)
SELECT fx_ids.k, coalesce(string_agg(v, '|' ORDER BY p), '') AS value FROM fx_ids LEFT JOIN o ON fx_ids.k = o.k GROUP BY fx_ids.k""", "ids")
scalar("t19_enhancement_predicates", "ids", lambda: F.concat_ws("|", X.is_enhancement_clause(C("raw")).cast("string"), X.mentions_enhancement(C("raw")).cast("string")),
       r"CAST(regexp_matches(lower(trim(raw)), '^[a-z]{2}-[0-9]{1,2}(?:\.[0-9]{1,2}|\([0-9]{1,2}\))_') AS VARCHAR) || '|' || CAST(regexp_matches(lower(raw), '(?:^|[^a-z0-9_])[a-z]{2}\s*-\s*[0-9]{1,2}\s*(?:\.\s*[0-9]{1,2}|\(\s*[0-9]{1,2}\s*\))') AS VARCHAR)")
scalar("t20_clause_depth", "clauses", lambda: X.clause_depth(C("id")), r"CAST(CASE WHEN regexp_extract(id, '_(?:smt|gdn|obj)\.(.+)$', 1) = '' THEN 0 ELSE len(string_split(regexp_extract(id, '_(?:smt|gdn|obj)\.(.+)$', 1), '.')) END AS INTEGER)")
scalar("t21_label_key", "ids", lambda: F.sha1(X.label_key(C("raw"))), "0")
ORACLES["t21_label_key"] = with_fixtures("SELECT k, sha1(array_to_string(list_transform(regexp_extract_all(trim(raw), '[0-9]+|[^0-9]+'), lambda p: CASE WHEN regexp_matches(p, '^[0-9]+$') THEN lpad(p, 12, '0') ELSE p END), chr(1))) AS value FROM fx_ids", "ids")
scalar("t22_clause_kind", "clauses", lambda: X.clause_kind(C("id")), "CASE WHEN contains(id, '_smt') THEN 'smt' WHEN contains(id, '_gdn') THEN 'gdn' WHEN contains(id, '_obj') THEN 'obj' ELSE 'other' END")
scalar("t23_parameter_kind", "clauses", lambda: X.parameter_kind(C("text")), "CASE WHEN contains(lower(text), '_odp') THEN 'odp' WHEN contains(lower(text), '_prm') THEN 'prm' ELSE 'param' END")
scalar("t24_kind_or_suffix", "clauses", lambda: X.kind_or_suffix(F.when(C("k") % 2 == 0, C("kind")), C("id")), "CASE WHEN k % 2 = 0 THEN kind ELSE regexp_extract(id, '_(smt|gdn|obj|odp|prm)', 1) END")
scalar("t25_collapse_spaces", "clauses", lambda: X.collapse(C("text")), r"trim(regexp_replace(text, '[ \t\n\x0B\f\r]+', ' ', 'g'))")
_REV = lambda: F.element_at(F.array(*map(F.lit, ("Revision 5", "rev4", "Rev.4", "r5", "5", "rev 45", "none"))), (C("k") % 7 + 1).cast("int"))
scalar("t26_version_lenient", "ids", lambda: X.version_lenient(_REV()), "CASE k % 7 WHEN 0 THEN 'rev5' WHEN 1 THEN 'rev4' WHEN 2 THEN 'rev4' WHEN 5 THEN 'rev5' ELSE 'unknown' END")
scalar("t27_version_strict", "ids", lambda: X.version_strict(_REV()), "CASE k % 7 WHEN 0 THEN 'rev5' WHEN 1 THEN 'rev4' WHEN 2 THEN 'rev4' WHEN 3 THEN 'rev5' WHEN 4 THEN 'rev5' END")
scalar("t28_version_or_fail", "ids", lambda: X.version_or_fail(F.when(C("k") % 2 == 0, "Revision 5").otherwise("REV. 4")), "CASE WHEN k % 2 = 0 THEN 'rev5' ELSE 'rev4' END")
_MESSY = lambda: F.concat(C("raw"), F.lit(" ,\n"), C("name"), F.lit("|;x+Y,"))
_messy = "(raw || ' ,' || chr(10) || name || '|;x+Y,')"
for _k, (_name, _seps, _low) in enumerate((("", ",\n", False), ("_pipe", "\n|,", True), ("_plus", "\n|,+;", True), ("_path", ",\n", False))):
    scalar(f"t29_split_list{_name}", "ids", lambda _seps=_seps, _low=_low: JOINED(X.split_list(_MESSY(), _seps, _low)), LIST.format("list_filter(list_transform(regexp_split_to_array(" + ("lower(" + _messy + ")" if _low else _messy) + ", '[" + _seps.replace("\n", "\\n").replace("|", "\\|") + "]'), lambda p: trim(p)), lambda p: p <> '')"))
scalar("t30_bool_text", "ids", lambda: X.bool_text(F.element_at(F.array(*map(F.lit, (" TRUE", "y", "no", "1", "0"))), (C("k") % 5 + 1).cast("int"))), "k % 5 IN (0, 1, 3)")
scalar("t31_doc_id_candidates", "clauses", lambda: JOINED(X.doc_id_candidates(F.concat(F.lit("Corpus:a/"), F.upper("id")))), "'Corpus:a/' || upper(id) || '|a/' || upper(id) || '|' || upper(id) || '|corpus:a/' || lower(id) || '|a/' || lower(id) || '|' || lower(id)")
scalar("t33_stable_question_id", "ids", lambda: X.stable_question_id(C("name"), C("raw")), "substr(sha1(name || '||' || raw), 1, 12)")
scalar("t35_json_strings", "ids", lambda: F.coalesce(F.size(X.json_strings(F.when(C("k") % 3 == 0, F.lit("[]")).when(C("k") % 3 == 1, F.concat(F.lit('["'), C("name"), F.lit('", "b"]'))).otherwise(F.lit('{"a": 1}')))), F.lit(-1)), "CAST(CASE k % 3 WHEN 0 THEN 0 WHEN 1 THEN 2 ELSE -1 END AS INTEGER)")
scalar("t36_word_counts", "queries", lambda: F.concat_ws("|", X.words_by_space(C("query")).cast("string"), X.words_by_class(C("query")).cast("string")),
       r"CAST(len(list_filter(regexp_split_to_array(query, '[ \t\n\x0B\f\r]+'), lambda w: w <> '')) AS VARCHAR) || '|' || CAST(len(regexp_extract_all(query, '[A-Za-z0-9_]+')) AS VARCHAR)", "q")
scalar("t37_rotate_alnum", "ids", lambda: X.rotate_alnum(C("raw")), "translate(raw, 'abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789', 'bcdefghijklmnopqrstuvwxyzaBCDEFGHIJKLMNOPQRSTUVWXYZA1234567890')")
scalar("t39_controls_in", "ids", lambda: JOINED(X.controls_in(F.upper("raw"))), LIST.format(r"regexp_extract_all(upper(raw), '[A-Z]{2,3}-[0-9]+(?:\([0-9]+\)|\.[0-9]+)?')"))
scalar("t40_citation_suffix", "ids", lambda: X.citation_suffix(F.concat(C("name"), F.when(C("k") % 2 == 0, F.concat(F.lit(" Citations: x Citation : "), C("raw"))).otherwise(F.lit("")))), "CASE WHEN k % 2 = 0 THEN ltrim(raw) END")
scalar("t41_excel_timestamp", "ids", lambda: X.excel_timestamp(45000 + C("k") + F.lit(0.25)), "CAST(TIMESTAMP '2023-03-15 06:00:00' + to_days(CAST(k AS INTEGER)) AS TIMESTAMP)")

SQL_CURLY = r"'\{+\s*insert:\s*(?:param,\s*)?([^}]+?)\s*\}+'"
scalar("o01_placeholder_keys", "clauses", lambda: F.concat_ws("|", JOINED(P.placeholder_keys(C("text"))), P.has_assignment(C("text")).cast("string")),
       f"array_to_string(list_sort(list_distinct(list_transform(regexp_extract_all(text, {SQL_CURLY}, 1), lambda x: trim(x)))), '|') || '|' || CAST(contains(lower(text), '[assignment:') AS VARCHAR)")
scalar("o02_placeholder_ids", "clauses", lambda: JOINED(P.placeholder_ids(C("text"))), "0")
ORACLES["o02_placeholder_ids"] = with_fixtures(
    f"SELECT k, coalesce(regexp_extract(t, '^([a-z]+)-', 1) || '-' || lpad(regexp_extract(t, '-([0-9]+)_', 1), 2, '0') || '_odp.' || lpad(regexp_extract(t, '([0-9]+)$', 1), 2, '0'), '') AS value FROM (SELECT k, nullif(lower(trim(regexp_extract(text, {SQL_CURLY}, 1))), '') AS t FROM fx_clauses)", "clauses")
scalar("o03_has_placeholder", "clauses", lambda: P.has_placeholder(C("text")), "k % 4 IN (0, 1)")
scalar("o04_normalize_parameter", "ids", lambda: P.normalize_parameter(F.concat(F.lower(F.substring("name", 1, 2)), F.lit("-"), (C("k") % 30).cast("string"), F.element_at(F.array(F.lit(".3_odp.4"), F.lit("_PRM_5"), F.lit(" odd "), F.lit(".06_odp")), (C("k") % 4 + 1).cast("int")))),
       "CASE k % 4 WHEN 0 THEN lower(substr(name, 1, 2)) || '-' || lpad(CAST(k % 30 AS VARCHAR), 2, '0') || '.03_odp.04' WHEN 1 THEN lower(substr(name, 1, 2)) || '-' || lpad(CAST(k % 30 AS VARCHAR), 2, '0') || '_prm.05' WHEN 2 THEN lower(substr(name, 1, 2)) || '-' || CAST(k % 30 AS VARCHAR) || 'odd' ELSE lower(substr(name, 1, 2)) || '-' || lpad(CAST(k % 30 AS VARCHAR), 2, '0') || '_odp.06' END")
scalar("o05_parameter_key", "ids", lambda: P.parameter_key(F.concat(F.lit("AC_"), (C("k") % 30).cast("string"), F.lit("_odp_"), (C("k") % 9).cast("string"))), "'ac-' || lpad(CAST(k % 30 AS VARCHAR), 2, '0') || '_odp.' || lpad(CAST(k % 9 AS VARCHAR), 2, '0')")
scalar("o08_retained_parameters", "clauses", lambda: JOINED(P.retained(C("text"), F.array(F.lit("{insert: x}"), C("text")))), f"array_to_string(list_sort(list_distinct(list_concat(list_transform(regexp_extract_all(text, {SQL_CURLY}, 1), lambda x: trim(x)), ['x']))), '|')")
scalar("o09_policy", "ids", lambda: P.policy(F.element_at(F.array(*map(F.lit, ("", "nan", "auto", " ask", "Preserve", "fill"))), (C("k") % 6 + 1).cast("int"))), "CASE k % 6 WHEN 3 THEN 'ASK' WHEN 4 THEN 'PRESERVE' ELSE 'FILL_FROM_PROFILE' END")
