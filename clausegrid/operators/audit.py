"""Records that can be checked again: profile resolution, prepared contexts, reviews, labels and releases."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F, types as T

from clausegrid.config import ASSIGNMENT_SENTINEL
from clausegrid.functions.params import ASSIGNMENT_SPACED, CURLY_SPACED, has_placeholder, normalize_parameter, placeholder_keys, resolve_literally
from clausegrid.functions.text import let, text_of, version_lenient
from clausegrid.operators.provenance import canonical_hash
from clausegrid.operators.verify import tags


def none():
    """An empty list of strings."""
    return F.array().cast("array<string>")


def without_gold_fields(rows: DataFrame, prefix: str = "gold") -> DataFrame:
    """Drops every column and nested field whose name begins with the prefix, at any depth."""

    def pruned(c: Column, t: T.DataType) -> Column:
        if isinstance(t, T.StructType):
            kept = [f for f in t.fields if not f.name.lower().startswith(prefix)]
            made = F.struct(*(pruned(c[f.name], f.dataType).alias(f.name) for f in kept))
            return F.when(c.isNotNull(), made)
        if isinstance(t, T.ArrayType) and isinstance(t.elementType, T.StructType):
            return F.transform(c, lambda x: pruned(x, t.elementType))
        return c

    return rows.select(*(pruned(F.col(f"`{f.name}`"), f.dataType).alias(f.name) for f in rows.schema if not f.name.lower().startswith(prefix)))


def profile_resolution(spans: Column, values: Column, profile_revision: Column, corpus_version: Column) -> Column:
    """(answer, required, status, record) of filling a contract's placeholders from a profile of the same revision.

    spans: array of struct(source_id, span_text); values: map. A profile of another revision resolves nothing. Values
    that are blank or hold a placeholder are not used.
    """
    original = F.trim(F.array_join(F.transform(spans, lambda s: text_of(s["span_text"])), "\n\n"))
    applicable = F.coalesce(F.lower(F.trim(profile_revision)) == corpus_version, F.lit(False))

    def usable(text: Column) -> Column:
        # only the values that the text asks for are looked at, however many the profile has
        asked = F.array_distinct(F.transform(F.regexp_extract_all(text, F.lit(CURLY_SPACED), 1), lambda k: F.trim(k)))
        known = F.filter(F.transform(asked, lambda k: F.struct(k.alias("key"), values[k].alias("value"))), lambda x: applicable & x["value"].isNotNull() & (F.trim(x["value"]) != "") & ~has_placeholder(x["value"]))
        return F.map_from_entries(known)

    def filled(x: Column) -> Column:
        return F.struct(x["original"].alias("original"), x["usable"].alias("usable"), resolve_literally(x["original"], x["usable"]).alias("answer"))

    def read(x: Column) -> Column:
        return F.struct(*(x[c].alias(c) for c in ("original", "usable", "answer")), placeholder_keys(x["answer"], CURLY_SPACED).alias("left"), x["answer"].rlike(ASSIGNMENT_SPACED).alias("bare"))

    done = lambda x: _resolution(x["original"], x["usable"], x["answer"], x["left"], x["bare"], spans, applicable, profile_revision, corpus_version)
    return let(original, lambda text: let(F.struct(text.alias("original"), usable(text).alias("usable")), lambda x: let(filled(x), lambda y: let(read(y), done))))


def _resolution(original: Column, usable: Column, answer: Column, left: Column, bare: Column, spans: Column, applicable: Column, profile_revision: Column, corpus_version: Column) -> Column:
    keys = placeholder_keys(original, CURLY_SPACED)
    required = F.concat(left, F.when(bare, F.array(F.lit(ASSIGNMENT_SENTINEL))).otherwise(none()))
    bindings = F.transform(F.filter(keys, lambda k: F.map_contains_key(usable, k)), lambda k: F.struct(k.alias("param_id"), usable[k].alias("value"),
        F.array_sort(F.array_distinct(F.transform(F.filter(spans, lambda s: F.array_contains(placeholder_keys(s["span_text"], CURLY_SPACED), k)), lambda s: s["source_id"]))).alias("source_ids")))
    record = F.struct(F.lit("FILL_FROM_PROFILE").alias("policy"), corpus_version.alias("corpus_version"), F.lower(F.trim(profile_revision)).alias("profile_revision"), applicable.alias("profile_applicable"),
                      bindings.alias("bindings"), left.alias("unresolved_param_ids"), bare.alias("anonymous_assignment_required"))
    return F.struct(answer.alias("answer"), required.alias("required"), F.when(F.size(required) > 0, "PARAMS_REQUIRED").otherwise("OK").alias("status"), record.alias("record"))


def profile_tags(record: Column, answer: Column, required: Column, status: Column, policy: Column, spans: Column, values: Column, profile_revision: Column, corpus_version: Column) -> Column:
    """A contract's profile record, answer, list and status against what its spans and the profile give; a null record has no tags."""
    def found(v: Column) -> Column:
        return let(profile_resolution(spans, values, profile_revision, v), lambda want: _profile_tags(want, record, answer, required, status, policy))

    return (F.when(record.isNull(), none()).when(values.isNull(), F.array(F.lit("ProfileResolutionRequiresOrgProfile")))
            .otherwise(let(version_lenient(corpus_version), lambda v: F.when(~v.isin("rev4", "rev5"), F.array(F.lit("ProfileResolutionRequiresCorpusVersion"))).otherwise(found(v)))))


def _profile_tags(want: Column, record: Column, answer: Column, required: Column, status: Column, policy: Column) -> Column:
    clean = lambda a: F.array_sort(F.array_distinct(F.transform(a, normalize_parameter)))
    return tags(
        (~policy.eqNullSafe(F.lit("FILL_FROM_PROFILE")), "ProfileResolutionPolicyMismatch"),
        (F.to_json(record) != F.to_json(want["record"]), "ProfileResolutionRecordMismatch"),
        (answer != want["answer"], "ProfileResolvedAnswerMismatch"),
        (clean(required) != clean(want["required"]), "ProfileUnresolvedListMismatch"),
        (F.upper(F.trim(status)) != want["status"], "ProfileResolutionStatusMismatch"),
    )


#: Conditions that a profile is tried under (fixed names), and those in which it may fill a placeholder.
PROFILE_CONDITIONS = ("complete", "empty", "partial", "wrong_revision", "unknown_keys", "unversioned", "placeholder_values", "literal_backslashes")
MAY_FILL = ("complete", "partial", "literal_backslashes")


def profile_cases(contracts: DataFrame, revision: str = "rev5") -> DataFrame:
    """Every contract under every condition: adds original, keys, condition, values (map) and profile_revision.

    contracts: spans (array of struct(source_id, span_text)). The partial profile lacks the last of the contract's keys.
    """
    original = F.trim(F.array_join(F.transform("spans", lambda s: text_of(s["span_text"])), "\n\n"))
    rows = contracts.withColumn("original", original).withColumn("keys", F.array_sort(F.array_distinct(placeholder_keys(F.col("original"), CURLY_SPACED))))
    rows = rows.withColumn("condition", F.explode(F.array(*map(F.lit, PROFILE_CONDITIONS))))
    c, keys = F.col("condition"), F.col("keys")
    here = F.when(c.isin("empty", "unknown_keys"), none()).when(c == "partial", F.slice(keys, 1, F.greatest(F.size(keys) - 1, F.lit(0)))).otherwise(keys)
    value = lambda k: F.when(c == "placeholder_values", F.lit("{{ insert: param, unapproved_new_parameter }}")).when(c == "literal_backslashes", F.concat(F.lit("C:\\Synthetic\\1\\"), k)).otherwise(F.concat(F.lit(f"synthetic::{revision}::"), k))
    values = F.map_from_arrays(here, F.transform(here, value))
    unknown = F.create_map(F.lit("__unknown_parameter_not_in_evidence__"), F.lit("synthetic::unused"))
    declared = F.when(c == "wrong_revision", "rev4" if revision == "rev5" else "rev5").when(c == "unversioned", F.lit(None).cast("string")).otherwise(revision)
    return rows.withColumn("values", F.when(c == "unknown_keys", unknown).otherwise(values)).withColumn("profile_revision", declared)


def expected_resolution(cases: DataFrame) -> DataFrame:
    """Adds what each case must give, from its text and its condition alone: expected_answer, expected_required, expected_status, expected_bindings."""
    used = F.when(F.col("condition").isin(*MAY_FILL), F.filter("keys", lambda k: F.map_contains_key(F.col("values"), k))).otherwise(none())
    tokens = F.regexp_extract_all("original", F.lit(CURLY_SPACED), 0)
    found = F.transform(tokens, lambda t: F.struct(t.alias("token"), placeholder_keys(t, CURLY_SPACED)[0].alias("k")))
    filled = F.aggregate(F.filter(found, lambda x: F.array_contains(F.col("used"), x["k"])), F.col("original"), lambda text, x: F.replace(text, x["token"], F.col("values")[x["k"]]))
    required = F.concat(F.array_except("keys", "used"), F.when(F.col("original").rlike(ASSIGNMENT_SPACED), F.array(F.lit(ASSIGNMENT_SENTINEL))).otherwise(none()))
    rows = cases.withColumn("used", used).withColumn("expected_answer", filled)
    rows = rows.withColumn("expected_required", F.array_sort(F.array_distinct(F.transform(required, normalize_parameter))))
    rows = rows.withColumn("expected_status", F.when(F.size("expected_required") > 0, "PARAMS_REQUIRED").otherwise("OK"))
    return rows.withColumn("expected_bindings", F.array_sort(F.transform("used", lambda k: F.concat(k, F.lit("="), F.col("values")[k])))).drop("used")


def resolution_outcomes(cases: DataFrame, corpus_version: str = "rev5") -> DataFrame:
    """Adds r, what profile_resolution gives each case, and agrees: whether answer, list, status and bindings are the expected ones."""
    rows = expected_resolution(cases).withColumn("r", profile_resolution(F.col("spans"), F.col("values"), F.col("profile_revision"), F.lit(corpus_version)))
    required = F.array_sort(F.array_distinct(F.transform("r.required", normalize_parameter)))
    bindings = F.array_sort(F.transform("r.record.bindings", lambda b: F.concat(b["param_id"], F.lit("="), b["value"])))
    same = (F.col("r.answer") == F.col("expected_answer")) & (required == F.col("expected_required")) & (F.col("r.status") == F.col("expected_status")) & (bindings == F.col("expected_bindings"))
    return rows.withColumn("agrees", same)


def prepared_contexts(queries: DataFrame, windows: DataFrame, manifests: DataFrame, key: str = "q") -> DataFrame:
    """One nested row for each query with its window, the window's manifest and its own hash; gold fields never enter."""
    docs = windows.groupBy(key).agg(F.array_sort(F.collect_list(F.struct("position", "id", "text"))).alias("evidence_window"))
    rows = without_gold_fields(queries).join(docs, key).join(manifests.select(key, F.col("sha256").alias("window_sha256")), key)
    fields = {c: F.col(c) for c in rows.columns}
    return rows.withColumn("context_sha256", canonical_hash(**fields))


def review_id(answer: Column, ids: Column, status: Column) -> Column:
    """Names a review by the answer's surface, so that a changed answer makes it stale."""
    return F.substring(canonical_hash(answer=answer, ids=ids, status=status), 1, 16)


def checked_reviews(reviews: DataFrame, contracts: DataFrame, verdicts: tuple[str, ...] = ("pass", "fail", "uncertain")) -> DataFrame:
    """Reviews that fit: a stale id, an unknown verdict or a finding that quotes no real text is an error.

    reviews: q, review_id, verdict, quote; contracts: q, answer, ids, status.
    """
    j = reviews.join(contracts, "q")
    wrong = (F.when(F.col("review_id") != review_id(F.col("answer"), F.col("ids"), F.col("status")), "stale review")
             .when(~F.col("verdict").isin(*verdicts), "unknown verdict").when(~F.contains("answer", F.coalesce("quote", F.lit(""))), "quote not in the answer"))
    return j.where(F.when(wrong.isNull(), True).otherwise(F.raise_error(F.concat(wrong, F.lit(": "), F.col("q").cast("string"))).cast("boolean"))).select(*reviews.columns)


def label_problems(labels: DataFrame) -> DataFrame:
    """query_id, problems of natural-question labels: allowed values and the rules between fields.

    labels: query_id, answerability, governing_controls, evidence_groups, odp_applicability, required_odp_ids (null: not
    judged), source_checked.
    """
    a, o, ids = F.col("answerability"), F.col("odp_applicability"), F.col("required_odp_ids")
    answerable = a.isin("full", "partial")
    problems = tags(
        (~F.coalesce(a, F.lit("")).isin("full", "partial", "outside", "ambiguous"), "answerability"),
        (~F.coalesce(o, F.lit("")).isin("required", "not_required", "not_applicable", "uncertain"), "odp_applicability"),
        (answerable & (F.size("evidence_groups") == 0), "evidence missing"),
        (answerable & (F.size("governing_controls") == 0), "controls missing"),
        ((a == "outside") & (F.size("evidence_groups") > 0), "evidence for an outside question"),
        (F.exists("evidence_groups", lambda g: F.size(g) == 0), "empty evidence group"),
        ((o == "required") & (ids.isNull() | (F.size(ids) == 0)), "parameters missing"),
        (o.isin("not_required", "not_applicable") & ids.isNotNull() & (F.size(ids) > 0), "parameters not expected"),
        ((o == "uncertain") & ids.isNotNull(), "uncertain parameters listed"),
        (~F.coalesce("source_checked", F.lit(False)), "source not checked"),
    )
    return labels.select("query_id", problems.alias("problems"))


def profile_mutations(contracts: DataFrame) -> DataFrame:
    """Each contract under every mutation of its profile record: q, mutation and the contract's columns.

    contracts: q, answer, required, status, policy, record.
    """
    c = F.col
    changes = {
        "none": {}, "answer": {"answer": F.concat("answer", F.lit(" x"))}, "status": {"status": F.when(c("status") == "OK", "PARAMS_REQUIRED").otherwise("OK")},
        "policy": {"policy": F.lit("ASK")}, "required": {"required": F.concat("required", F.array(F.lit("zz-01_odp.01")))},
        "revision": {"record": c("record").withField("profile_revision", F.lit("rev0"))}, "corpus": {"record": c("record").withField("corpus_version", F.lit("rev0"))},
        "applicable": {"record": c("record").withField("profile_applicable", ~c("record.profile_applicable"))}, "unresolved": {"record": c("record").withField("unresolved_param_ids", F.array(F.lit("zz")))},
        "anonymous": {"record": c("record").withField("anonymous_assignment_required", ~c("record.anonymous_assignment_required"))},
        "value": {"record": c("record").withField("bindings", F.concat("record.bindings", F.array(F.struct(F.lit("zz").alias("param_id"), F.lit("v").alias("value"), none().alias("source_ids")))))},
    }
    rows = contracts.withColumn("mutation", F.explode(F.array(*map(F.lit, changes))))
    changed = {}
    for name, change in changes.items():
        for column, value in change.items():
            changed[column] = F.when(c("mutation") == name, value).otherwise(changed.get(column, c(column)))
    return rows.withColumns(changed)


def accepted(checks: DataFrame, name: str = "check", ok: str = "ok") -> DataFrame:
    """One row for each check and one for all: whether every row of it holds."""
    return checks.rollup(name).agg(F.bool_and(ok).alias("ok"), F.count("*").alias("n")).fillna("all", [name])
