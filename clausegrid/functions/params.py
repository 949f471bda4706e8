"""Placeholder and parameter functions as column expressions."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from clausegrid.config import ASSIGNMENT_SENTINEL
from clausegrid.functions.text import text_of

# The two placeholder dialects; the second also allows spaces before the colon. Fixed values.
CURLY = r"(?i)\{+\s*insert:\s*(?:param,\s*)?([^}]+?)\s*\}+"
CURLY_SPACED = r"(?i)\{+\s*insert\s*:\s*(?:param\s*,\s*)?([^}]+?)\s*\}+"
ASSIGNMENT = r"(?i)\[assignment:\s*([^\]]+?)\s*\]"
ASSIGNMENT_SPACED = r"(?i)\[\s*assignment\s*:\s*([^\]]+)\]"
# Parameter ids, whole and in the older form without an index of the enhancement. Fixed values.
PARAMETER = r"^([a-z]{2})-?(\d{1,2})(?:\.(\d{1,2}))?_(odp|prm)[._-]?(\d{1,2})$"
OLDER_PARAMETER = r"^([a-z]{2})-(\d{1,2})\.(\d{1,2})_(odp|prm)$"


def placeholder_keys(x: Column, pattern: str = CURLY) -> Column:
    """Sorted distinct payloads, kept whole."""
    found = F.transform(F.regexp_extract_all(text_of(x), F.lit(pattern), 1), lambda p: F.trim(p))
    return F.array_sort(F.array_distinct(F.filter(found, lambda k: k != "")))


def has_assignment(x: Column, pattern: str = ASSIGNMENT) -> Column:
    return text_of(x).rlike(pattern)


def has_placeholder(x: Column) -> Column:
    return text_of(x).rlike(CURLY_SPACED) | text_of(x).rlike(ASSIGNMENT_SPACED)


def normalize_parameter(x: Column) -> Column:
    """Zero-padded control, enhancement and index; other ids only lose spaces and case."""
    t = F.lower(F.regexp_replace(text_of(x), r"\s+", ""))
    f = [F.regexp_extract(t, PARAMETER, k) for k in range(6)]
    g = [F.regexp_extract(t, OLDER_PARAMETER, k) for k in range(5)]
    pad = lambda c: F.lpad(c, 2, "0")
    return (
        F.when(F.trim(text_of(x)) == ASSIGNMENT_SENTINEL, ASSIGNMENT_SENTINEL)
        .when(t.isin("assignment_required", "assignmentrequired"), ASSIGNMENT_SENTINEL)
        .when(f[0] != "", F.concat(f[1], F.lit("-"), pad(f[2]), F.when(f[3] != "", F.concat(F.lit("."), pad(f[3]))).otherwise(""), F.lit("_"), f[4], F.lit("."), pad(f[5])))
        .when(g[0] != "", F.concat(g[1], F.lit("-"), pad(g[2]), F.lit("_"), g[4], F.lit("."), pad(g[3])))
        .otherwise(t)
    )


def parameter_key(x: Column) -> Column:
    """As normalize_parameter, and family and number may be joined by an underscore."""
    return normalize_parameter(F.regexp_replace(F.lower(F.trim(text_of(x))), r"^([a-z]{2})_(\d{1,2})", "$1-$2"))


def placeholder_ids(x: Column) -> Column:
    """Sorted distinct parameter ids: of each payload the first word after the last comma."""
    found = F.regexp_extract_all(text_of(x), F.lit(CURLY_SPACED), 1)
    ids = F.transform(found, lambda p: normalize_parameter(F.element_at(F.split(F.trim(F.element_at(F.split(p, ","), -1)), r"\s+"), 1)))
    return F.array_sort(F.array_distinct(F.filter(ids, lambda i: i != "")))


def retained(body: Column, spans: Column) -> Column:
    """Placeholder payloads of a text and of its spans together, sorted."""
    return F.array_sort(F.array_distinct(F.flatten(F.transform(F.concat(F.array(body), spans), lambda t: placeholder_keys(t)))))


def policy(x: Column) -> Column:
    p = F.upper(F.trim(text_of(x)))
    return F.when(p.isin("", "NAN", "NA", "N/A", "NONE", "NULL", "AUTO", "FILL", "PROFILE", "FILL_PROFILE"), "FILL_FROM_PROFILE").otherwise(p)


def literal(x: Column) -> Column:
    """A usable profile value as text; null if it is blank or holds a placeholder."""
    return F.when((F.trim(x) != "") & ~has_placeholder(x), x)


def lookup(values: Column, fallback: Column, top: Column, key: Column) -> Column:
    """The value of the first of three maps that has the key, even if that value is null."""
    return F.when(F.map_contains_key(values, key), values[key]).when(F.map_contains_key(fallback, key), fallback[key]).otherwise(top[key])


def resolve_literally(x: Column, values: Column) -> Column:
    """Replaces each placeholder whose payload is a key of the map, once and literally; the others stay.

    The text is split into placeholders and what stands between them, so values are never scanned again.
    """
    keys = F.regexp_extract_all(x, F.lit(CURLY_SPACED), 0)
    between = F.split(x, CURLY_SPACED, -1)
    filled = F.transform(keys, lambda m: F.coalesce(values[F.trim(F.regexp_extract(m, CURLY_SPACED, 1))], m))
    return F.array_join(F.zip_with(between, filled, lambda a, b: F.concat(a, F.coalesce(b, F.lit("")))), "")


def apply_policy(x: Column, policy_: Column, values: Column) -> Column:
    """(answer, required, status) of a text under ASK, PRESERVE or FILL_FROM_PROFILE; other policies are an error."""
    p, x = policy(policy_), text_of(x)
    keys, bare = placeholder_keys(x), has_assignment(x)
    sentinel = F.when(bare, F.array(F.lit(ASSIGNMENT_SENTINEL))).otherwise(F.array().cast("array<string>"))
    usable = F.map_filter(values, lambda k, v: v.isNotNull() & (F.trim(v) != ""))
    missing = F.filter(keys, lambda k: ~F.map_contains_key(usable, k))
    none = (F.size(keys) == 0) & ~bare
    required = F.when(none, F.array().cast("array<string>")).when(p == "FILL_FROM_PROFILE", F.concat(missing, sentinel)).otherwise(F.concat(keys, sentinel))
    answer = F.when(~none & (p == "FILL_FROM_PROFILE"), resolve_literally(x, usable)).otherwise(x)
    known = F.when(none | p.isin("ASK", "PRESERVE", "FILL_FROM_PROFILE"), F.lit(None).cast("string")).otherwise(F.raise_error(F.concat(F.lit("unknown policy: "), p)).cast("string"))
    status = F.coalesce(known, F.when(F.size(required) > 0, "PARAMS_REQUIRED").otherwise("OK"))
    return F.struct(answer.alias("answer"), required.alias("required"), status.alias("status"))
