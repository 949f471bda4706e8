"""Text, identifier and list functions as column expressions."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, functions as F

_SPACE = r"[ \t\n\x0B\f\r]+"
_DOT = r"^([A-Z]{2,3}-\d+)\.(\d+)$"
_PAREN = r"^([A-Z]{2,3}-\d+)\((\d+)\)$"
_CONTROL = r"(?<![A-Z0-9])([A-Z]{2}-\d+(?:\(\d+\)|\.\d+)?)(?=$|[^A-Z0-9])"


def let(value: Column, f: Callable[[Column], Column]) -> Column:
    """f of a value that is computed once a row, however often f names it; as it stands it would be computed at every place, and inside lambdas for every element."""
    return F.transform(F.array(value), f)[0]


def text_of(x: Column) -> Column:
    return F.coalesce(x, F.lit(""))


def collapse(x: Column) -> Column:
    return F.trim(F.regexp_replace(x, _SPACE, " "))


def normalize_text(x: Column) -> Column:
    """Lower case, hyphens and punctuation to spaces, single spaces."""
    return collapse(F.regexp_replace(F.replace(F.lower(text_of(x)), F.lit("-"), F.lit(" ")), r"[^0-9A-Za-z_ \t\n\x0B\f\r]+", " "))


def tokenize(x: Column) -> Column:
    """ASCII alphanumeric runs in lower case, repeats kept."""
    return F.regexp_extract_all(F.lower(F.regexp_replace(text_of(x), "[^A-Za-z0-9]+", " ")), F.lit("([a-z0-9]+)"), 1)


def token_set(x: Column, least: int = 3) -> Column:
    return F.array_distinct(F.regexp_extract_all(F.lower(text_of(x)), F.lit("([a-z0-9]{%d,})" % least), 1))


def jaccard(a: Column, b: Column, both_empty: float = 0.0) -> Column:
    """Overlap of two sets; either empty gives 0 unless both_empty is 1, where only two empty sets give 1."""
    a, b = F.array_distinct(a), F.array_distinct(b)
    union = F.size(F.array_union(a, b))
    value = F.size(F.array_intersect(a, b)) / F.when(union > 0, union)
    return F.when(union == 0, F.lit(both_empty)).otherwise(F.when((F.size(a) == 0) | (F.size(b) == 0), F.lit(0.0)).otherwise(value))


def text_jaccard(a: Column, b: Column) -> Column:
    return jaccard(tokenize(normalize_text(a)), tokenize(normalize_text(b)))


def control_for_retrieval(x: Column) -> Column:
    """Upper case, underscores to hyphens, a dotted enhancement in parentheses."""
    return F.regexp_replace(F.replace(F.upper(F.trim(text_of(x))), F.lit("_"), F.lit("-")), _DOT, "$1($2)")


def control_for_gate(x: Column) -> Column:
    """Family and number only: no enhancement, no leading zeros; null where there is none."""
    up, re = F.upper(F.trim(text_of(x))), r"(?<![A-Z])([A-Z]{2})-0*(\d+)"
    return F.when((F.regexp_extract(up, re, 1) != "") & (up != "NAN"), F.concat(F.regexp_extract(up, re, 1), F.lit("-"), F.regexp_extract(up, re, 2).cast("int").cast("string")))


def _canonical(id_: Column) -> Column:
    parts = [F.regexp_extract(id_, r"^([A-Z]{2})-(\d+)(?:\((\d+)\)|\.(\d+))?$", k) for k in (1, 2, 3, 4)]
    enhancement = F.concat(parts[2], parts[3])
    return F.concat(parts[0], F.lit("-"), F.try_to_number(parts[1], F.lit("9999999999")).cast("string"), F.when(enhancement != "", F.concat(F.lit("("), F.try_to_number(enhancement, F.lit("9999999999")).cast("string"), F.lit(")"))).otherwise(""))


def control_for_verifier(x: Column) -> Column:
    """The first control in a text with its enhancement, without leading zeros; null where there is none."""
    found = F.regexp_extract(F.upper(F.trim(text_of(x))), _CONTROL, 1)
    return F.when((found != "") & (F.upper(F.trim(text_of(x))) != "NAN"), _canonical(found))


def control_of_source(x: Column) -> Column:
    return control_for_verifier(x)


def control_for_retest(x: Column) -> Column:
    """The whole value must be a control; zeros are stripped, anything else is kept in upper case."""
    up = F.upper(F.trim(text_of(x)))
    return F.when(up.rlike(r"^[A-Z]{2}-\d+(?:\(\d+\)|\.\d+)?$"), _canonical(up)).otherwise(up)


def control_aliases(x: Column) -> Column:
    """The id and its dotted form, each also without and with a space for the hyphen, sorted and joined by spaces."""
    cid = control_for_retrieval(x)
    dot = F.when(cid.rlike(_PAREN), F.regexp_replace(cid, _PAREN, "$1.$2"))
    forms = F.filter(F.flatten(F.transform(F.array(cid, dot), lambda c: F.array(c, F.replace(c, F.lit("-"), F.lit("")), F.replace(c, F.lit("-"), F.lit(" "))))), lambda c: c.isNotNull() & (c != ""))
    return F.array_join(F.array_sort(F.array_distinct(forms)), " ")


def alnum_key(x: Column) -> Column:
    return F.regexp_replace(F.lower(text_of(x)), r"[^\p{L}\p{N}]", "")


# The retrieval phrases and scope words that queries lose or gain; fixed values.
META_PHRASES = (
    r"(?i)\b(?:under|based on|in)\s+nist\s+sp\s*800\s*[-–]?\s*53\b",
    r"(?i)\bplease\s+(?:also\s+)?include\s+(?:the\s+)?control\s+citation(?:s)?\b",
    r"(?i)\binclude\s+(?:the\s+)?control\s+citation(?:s)?\b",
    r"(?i)\binclude\s+(?:the\s+)?citation(?:s)?\b",
    r"(?i)\bwith\s+(?:the\s+)?control\s+citation(?:s)?\b",
    r"(?i)\bwith\s+(?:the\s+)?citation(?:s)?\b",
    r"(?i)\b(?:what|which)\s+control\s+(?:says|requires|covers)\b",
    r"(?i)\bcontrol\s+citation(?:s)?\b",
)
ADMIN = r"(?i)\badmins?\b|\badministrators?\b|\bsuperusers?\b|\broot\b"
NON_PRIVILEGED = r"(?i)\bnon[\s-]?privileged\b|\bregular\s+users?\b|\bordinary\s+users?\b"
PRIVILEGED = r"(?i)\bprivileged\b"
MULTI_FACTOR = r"(?i)\bmfa\b|\bmulti[\s-]?factor\b|\bmultifactor\b"


def strip_meta(x: Column) -> Column:
    """(text, patterns removed): request phrases leave the query."""
    out, before = F.trim(text_of(x)), []
    for p in META_PHRASES:
        new = F.regexp_replace(out, p, " ")
        before.append(F.when(new != out, F.lit(p)))
        out = new
    out = F.regexp_replace(F.regexp_replace(out, r"(?i)\b(?:please|kindly)\b", " "), "[,:;]+", " ")
    out = F.regexp_replace(F.regexp_replace(out, _SPACE, " "), r"^[ .,\-:\n\t]+|[ .,\-:\n\t]+$", "")
    return F.struct(out.alias("text"), F.filter(F.array(*before), lambda p: p.isNotNull()).alias("removed"))


def privilege_scope(x: Column, admins: bool) -> Column:
    """non_privileged before privileged before neutral; queries also count administrators as privileged."""
    x = text_of(x)
    high = x.rlike(PRIVILEGED) | x.rlike(ADMIN) if admins else x.rlike(PRIVILEGED)
    return F.when(x.rlike(NON_PRIVILEGED), "non_privileged").when(high, "privileged").otherwise("neutral")


def retrieval_query(x: Column) -> Column:
    """(query, scope, expansions): the stripped query with the terms of its scope that it lacks."""

    def made(raw: Column) -> Column:
        work = let(strip_meta(raw)["text"], lambda stripped: F.when(stripped == "", raw).otherwise(stripped))
        parts = F.struct(privilege_scope(raw, True).alias("scope"), work.alias("work"))
        return let(parts, lambda p: let(_expansions(raw, p["work"], p["scope"]), lambda extras: let(
            collapse(F.concat_ws(" ", p["work"], F.array_join(extras, " "))),
            lambda query: F.struct(F.when(query == "", raw).otherwise(query).alias("query"), p["scope"].alias("scope"), extras.alias("expansions")))))

    return let(F.trim(text_of(x)), made)


def _expansions(raw: Column, work: Column, scope: Column) -> Column:
    """The terms of a scope, and of several factors, that a query lacks."""
    terms = F.concat(
        F.when(normalize_text(work).rlike(MULTI_FACTOR), F.array(F.lit("multi-factor authentication"), F.lit("mfa"))).otherwise(F.array().cast("array<string>")),
        F.when(scope == "privileged", F.array(F.lit("privileged account"), F.lit("privileged accounts")))
        .when(scope == "non_privileged", F.array(F.lit("non-privileged account"), F.lit("non-privileged accounts"), F.lit("non-privileged user")))
        .otherwise(F.array().cast("array<string>")),
        F.when((scope == "privileged") & raw.rlike(ADMIN), F.array(F.lit("privileged user"), F.lit("privileged users"))).otherwise(F.array().cast("array<string>")),
    )
    return F.filter(F.array_distinct(terms), lambda t: ~F.contains(F.lower(work), t))


def augment_enhancements(x: Column) -> Column:
    """Appends the dotted form of each enhancement in parentheses, in upper and then in lower case."""
    found = F.regexp_extract_all(text_of(x), F.lit(r"\b([A-Za-z]{2}-\d{1,2}\(\d+\))\b"), 1)
    dotted = F.transform(found, lambda m: F.concat(F.upper(F.regexp_extract(m, r"^([^(]+)", 1)), F.lit("."), F.regexp_extract(m, r"\((\d+)\)", 1).cast("int").cast("string")))
    return F.when(F.size(dotted) == 0, x).otherwise(F.concat_ws(" ", x, F.array_join(dotted, " "), F.array_join(F.transform(dotted, F.lower), " ")))


def coerce_rewrites(values: Column) -> Column:
    """Trimmed, non-empty rewrites of an array of strings."""
    return F.filter(F.transform(F.coalesce(values, F.array().cast("array<string>")), lambda r: F.trim(text_of(r))), lambda r: r != "")


def query_variants(query: Column, rewrites: Column, most: int | None = 3, least_jaccard: float | None = 0.15) -> Column:
    """The query, its accepted rewrites, each followed by its augmented form; first occurrences stay."""
    q = F.trim(text_of(query))
    kept = F.filter(coerce_rewrites(rewrites), lambda r: r != q)
    if least_jaccard is not None:
        near = lambda r: (F.size(tokenize(q)) == 0) | (F.size(tokenize(r)) == 0) | (jaccard(tokenize(q), tokenize(r)) >= least_jaccard)
        kept = F.filter(kept, near)
    if most is not None:
        kept = F.slice(kept, 1, most)
    both = F.flatten(F.transform(F.concat(F.array(q), kept), lambda v: F.array(v, augment_enhancements(v))))
    return F.when(q == "", F.array().cast("array<string>")).otherwise(F.array_distinct(both))


def control_hints(x: Column) -> Column:
    """Enhancements in a query first, then base controls that none of them covers; first occurrences stay."""
    up = F.upper(text_of(x))
    raw = F.regexp_extract_all(up, F.lit(r"(?<![A-Z0-9])([A-Z]{2}-\d{1,2}(?:\(\d{1,2}\)|\.\d{1,2}))"), 1)
    enhancements = F.array_distinct(F.transform(raw, lambda m: F.concat(F.regexp_extract(m, r"^([A-Z]{2})", 1), F.lit("-"), F.regexp_extract(m, r"-0*(\d+)", 1), F.lit("."), F.regexp_extract(m, r"[(.]0*(\d+)", 1))))
    bases = F.array_distinct(F.transform(F.regexp_extract_all(up, F.lit(r"(?<![A-Z0-9])([A-Z]{2}-\d{1,2})(?![0-9])"), 1), lambda m: F.concat(F.regexp_extract(m, r"^([A-Z]{2})", 1), F.lit("-"), F.regexp_extract(m, r"-0*(\d+)", 1))))
    return F.concat(enhancements, F.filter(bases, lambda c: ~F.exists(enhancements, lambda e: F.startswith(e, F.concat(c, F.lit("."))))))


def is_enhancement_clause(x: Column) -> Column:
    return F.lower(F.trim(text_of(x))).rlike(r"^[a-z]{2}-\d{1,2}(?:\.\d{1,2}|\(\d{1,2}\))_")


def mentions_enhancement(x: Column) -> Column:
    return F.lower(text_of(x)).rlike(r"(?:^|[^a-z0-9_])[a-z]{2}\s*-\s*\d{1,2}\s*(?:\.\s*\d{1,2}|\(\s*\d{1,2}\s*\))")


def clause_depth(x: Column) -> Column:
    """Segments after the kind marker of a clause id."""
    tail = F.regexp_extract(F.lower(F.trim(text_of(x))), r"_(?:smt|gdn|obj)\.(.+)$", 1)
    return F.when(tail == "", 0).otherwise(F.size(F.split(tail, r"\.")))


def label_key(x: Column) -> Column:
    """Sorts labels naturally: runs of digits by value, other runs as text."""
    return F.array_join(F.transform(F.regexp_extract_all(F.trim(text_of(x)), F.lit(r"([0-9]+|[^0-9]+)"), 1), lambda p: F.when(p.rlike("^[0-9]+$"), F.lpad(p, 12, "0")).otherwise(p)), "\x01")


def clause_kind(x: Column) -> Column:
    x = F.lower(text_of(x))
    return F.when(x.contains("_smt"), "smt").when(x.contains("_gdn"), "gdn").when(x.contains("_obj"), "obj").otherwise("other")


def parameter_kind(x: Column) -> Column:
    x = F.lower(text_of(x))
    return F.when(x.contains("_odp"), "odp").when(x.contains("_prm"), "prm").otherwise("param")


def kind_or_suffix(kind: Column, id_: Column) -> Column:
    given = F.lower(F.trim(text_of(kind)))
    return F.when(given != "", given).otherwise(F.regexp_extract(F.lower(F.trim(text_of(id_))), r"_(smt|gdn|obj|odp|prm)", 1))


def version_lenient(x: Column) -> Column:
    s = F.trim(text_of(x))
    found = F.regexp_extract(F.lower(F.replace(s, F.lit("."), F.lit(" "))), r"(?:^|[^a-z0-9_])rev(?:ision)?\s*([45])(?:$|[^a-z0-9_])", 1)
    rev = F.lower(s).contains("rev")
    return F.when(found != "", F.concat(F.lit("rev"), found)).when(rev & s.contains("5"), "rev5").when(rev & s.contains("4"), "rev4").otherwise("unknown")


def version_strict(x: Column) -> Column:
    found = F.regexp_extract(F.lower(F.trim(x)), r"^(?:rev(?:ision)?\s*\.?\s*|r\s*)?([45])$", 1)
    return F.when(found != "", F.concat(F.lit("rev"), found))


def version_or_fail(x: Column) -> Column:
    """The strict form; anything else is an error."""
    return F.coalesce(version_strict(x), F.raise_error(F.concat(F.lit("unknown revision: "), text_of(x))).cast("string"))


def split_list(x: Column, separators: str = ",\n", lower: bool = False) -> Column:
    """Trimmed, non-empty parts; nan and null have none."""
    parts = F.transform(F.split(F.replace(text_of(x), F.lit("\r\n"), F.lit("\n")), "[" + separators.replace("|", r"\|") + "]"), lambda p: F.trim(p))
    if lower:
        parts = F.transform(parts, F.lower)
    return F.when(F.lower(text_of(x)) == "nan", F.array().cast("array<string>")).otherwise(F.filter(parts, lambda p: p != ""))


def bool_text(x: Column, accepted: tuple[str, ...] = ("1", "true", "t", "yes", "y")) -> Column:
    return F.lower(F.trim(text_of(x))).isin(*accepted)


def doc_id_candidates(x: Column) -> Column:
    """The id, what follows its last colon, slash or hash, and all of these in lower case; first occurrences stay."""
    s = F.trim(text_of(x))
    tails = [F.when(s.contains(sep), F.trim(F.element_at(F.split(s, sep), -1))) for sep in (":", "/", "#")]
    forms = F.filter(F.array(s, *tails), lambda c: c.isNotNull() & (c != ""))
    return F.array_distinct(F.concat(forms, F.transform(forms, F.lower)))


def stable_question_id(question: Column, control: Column) -> Column:
    return F.substring(F.sha1(F.concat(text_of(question), F.lit("||"), text_of(control))), 1, 12)


def json_strings(x: Column) -> Column:
    """The strings of a JSON list; null for anything else."""
    return F.when(F.trim(text_of(x)).startswith("["), F.from_json(x, "array<string>"))


def words_by_space(x: Column) -> Column:
    return F.size(F.filter(F.split(text_of(x), _SPACE), lambda w: w != ""))


def words_by_class(x: Column) -> Column:
    return F.regexp_count(text_of(x), F.lit("[A-Za-z0-9_]+"))


def rotate_alnum(x: Column) -> Column:
    """Each ASCII letter or digit becomes the next one of its kind."""
    a = "abcdefghijklmnopqrstuvwxyz"
    return F.translate(x, a + a.upper() + "0123456789", a[1:] + "a" + a[1:].upper() + "A" + "1234567890")


def controls_in(x: Column) -> Column:
    return F.regexp_extract_all(text_of(x), F.lit(r"([A-Z]{2,3}-\d+(?:\(\d+\)|\.\d+)?)"), 1)


def citation_suffix(x: Column) -> Column:
    """What follows the last citation label; null without one."""
    parts = F.split(text_of(x), r"(?i)(?<![A-Za-z0-9_])citations?\s*:\s*")
    return F.when(F.size(parts) > 1, F.element_at(parts, -1))


def excel_timestamp(serial: Column, epoch_1904: bool = False) -> Column:
    """A worksheet's serial date as a UTC timestamp, to the millisecond."""
    days = F.lit(24107 if epoch_1904 else 25569)
    return F.timestamp_millis(F.round((serial.cast("decimal(20,10)") - days) * 86400000).cast("long"))
