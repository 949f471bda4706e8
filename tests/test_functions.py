"""Column functions on small values, with the odd ones."""

import pytest
from pyspark.sql import functions as F

from clausegrid.functions import params as P, text as X


def one(spark, column, **values):
    names = list(values)
    df = spark.createDataFrame([tuple(values.values())], ", ".join(f"{n} {'array<string>' if isinstance(v, list) else 'string'}" for n, v in values.items())) if names else spark.range(1)
    return df.select(column.alias("v")).first()["v"]


def test_normalization_and_tokens(spark):
    assert one(spark, X.normalize_text(F.col("x")), x="  Multi-Factor,  AUTH_n!\t") == "multi factor auth_n"
    assert one(spark, X.tokenize(F.col("x")), x="A-b a1 É") == ["a", "b", "a1"]
    assert one(spark, X.tokenize(F.col("x")), x=None) == []
    assert one(spark, X.token_set(F.col("x")), x="the The of cat") == ["the", "cat"]


def test_overlaps_keep_their_own_empty_rule(spark):
    assert one(spark, X.text_jaccard(F.col("a"), F.col("b")), a="", b="") == 0.0
    assert one(spark, X.jaccard(F.col("a"), F.col("b"), 1.0), a=[], b=[]) == 1.0
    assert one(spark, X.jaccard(F.col("a"), F.col("b"), 1.0), a=["x"], b=[]) == 0.0
    assert one(spark, X.jaccard(F.col("a"), F.col("b")), a=["x", "y"], b=["y", "z"]) == pytest.approx(1 / 3)


def test_control_ids_have_five_readings(spark):
    assert one(spark, X.control_for_retrieval(F.col("x")), x=" ac_2.1 ") == "AC-2(1)"
    assert one(spark, X.control_for_gate(F.col("x")), x="AC-06_smt.1") == "AC-6"
    assert one(spark, X.control_for_gate(F.col("x")), x="nan") is None
    assert one(spark, X.control_for_verifier(F.col("x")), x="see AC-02.01, and AC-3") == "AC-2(1)"
    assert one(spark, X.control_for_verifier(F.col("x")), x="none") is None
    assert one(spark, X.control_for_retest(F.col("x")), x="ac-02") == "AC-2"
    assert one(spark, X.control_for_retest(F.col("x")), x="ac-2 x") == "AC-2 X"
    assert one(spark, X.control_aliases(F.col("x")), x="AC-2.1") == "AC 2(1) AC 2.1 AC-2(1) AC-2.1 AC2(1) AC2.1"


def test_queries(spark):
    q = one(spark, X.retrieval_query(F.col("x")), x="Please include the control citation: MFA for admins, under NIST SP 800-53?")
    assert q["scope"] == "privileged" and q["query"].startswith("MFA for admins") and q["query"].endswith("privileged user privileged users")
    assert one(spark, X.privilege_scope(F.col("x"), True), x="non-privileged admins") == "non_privileged"
    assert one(spark, X.privilege_scope(F.col("x"), False), x="admins") == "neutral"
    assert one(spark, X.query_variants(F.col("q"), F.col("r")), q="access AT-3(3) plan", r=["access plan", "zebra", "access AT-3(3) plan"]) == ["access AT-3(3) plan", "access plan"]
    assert one(spark, X.augment_enhancements(F.col("x")), x="AT-3(3)x") == "AT-3(3)x AT-3.3 at-3.3"  # a word must follow the parenthesis
    assert one(spark, X.control_hints(F.col("x")), x="about AT-3(3) or at-03 and AC-2") == ["AT-3.3", "AC-2"]


def test_small_parsers(spark):
    assert one(spark, X.clause_depth(F.col("x")), x="ac-2_smt.a.1") == 2
    assert one(spark, X.label_key(F.col("x")), x="a10") > one(spark, X.label_key(F.col("x")), x="a9")
    assert one(spark, X.split_list(F.col("x")), x="a, b\r\n\nc") == ["a", "b", "c"]
    assert one(spark, X.split_list(F.col("x")), x="NaN") == []
    assert one(spark, X.version_lenient(F.col("x")), x="Rev.4") == "rev4" and one(spark, X.version_strict(F.col("x")), x="rev 45") is None
    assert one(spark, X.doc_id_candidates(F.col("x")), x="A:b/C") == ["A:b/C", "b/C", "C", "a:b/c", "b/c", "c"]
    assert one(spark, X.citation_suffix(F.col("x")), x="body Citations: AC-2") == "AC-2" and one(spark, X.citation_suffix(F.col("x")), x="body") is None
    assert str(one(spark, X.excel_timestamp(F.lit(45000.5)))) == "2023-03-15 12:00:00"
    assert one(spark, X.rotate_alnum(F.col("x")), x="zZ9a!") == "aA0b!"
    with pytest.raises(Exception, match="unknown revision"):
        one(spark, X.version_or_fail(F.col("x")), x="rev6")


def test_placeholders(spark):
    text = "within {{ insert: param, ac-02_odp.05 }} or { insert: ac-7_odp_1 } and [Assignment: time]"
    assert one(spark, P.placeholder_keys(F.col("x")), x=text) == ["ac-02_odp.05", "ac-7_odp_1"]
    assert one(spark, P.placeholder_ids(F.col("x")), x=text) == ["ac-02_odp.05", "ac-07_odp.01"]
    assert one(spark, P.placeholder_keys(F.col("x")), x="{ insert : x }") == [] and one(spark, P.has_placeholder(F.col("x")), x="{ insert : x }")
    assert one(spark, P.normalize_parameter(F.col("x")), x="CP-02.06_odp") == "cp-02_odp.06"


def test_policies(spark):
    values = F.create_map(F.lit("a"), F.lit("24 {{ insert: b }} $1\\"), F.lit("b"), F.lit("late"), F.lit("c"), F.lit(" "))
    text = "x {{ insert: a }} y { insert: b } z {{ insert: c }}"
    r = one(spark, P.apply_policy(F.col("x"), F.lit("auto"), values), x=text)
    assert r["answer"] == "x 24 {{ insert: b }} $1\\ y late z {{ insert: c }}" and r["required"] == ["c"] and r["status"] == "PARAMS_REQUIRED"
    r = one(spark, P.apply_policy(F.col("x"), F.lit("preserve"), values), x=text + " [assignment: t]")
    assert r["answer"].startswith(text) and r["required"] == ["a", "b", "c", "__ASSIGNMENT_REQUIRED__"]
    assert one(spark, P.apply_policy(F.col("x"), F.lit("odd"), values), x="plain")["status"] == "OK"
    with pytest.raises(Exception, match="unknown policy"):
        one(spark, P.apply_policy(F.col("x"), F.lit("odd"), values), x=text)
