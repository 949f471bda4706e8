"""Verification of answer contracts: each check gives tags, a contract passes when no hard tag is left."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from clausegrid.functions.params import ASSIGNMENT_SPACED, has_placeholder, normalize_parameter, placeholder_ids, placeholder_keys
from clausegrid.functions.text import collapse, control_of_source, doc_id_candidates, let, text_of, version_lenient, version_strict
from clausegrid.operators.metrics import set_metrics

STATUSES = ("OK", "PARAMS_REQUIRED", "NO_EVIDENCE", "ERROR")


def tags(*checks: tuple[Column, str | Column]) -> Column:
    """The tags whose conditions hold."""
    made = [F.when(c, t if isinstance(t, Column) else F.lit(t)) for c, t in checks]
    return F.filter(F.array(*made), lambda x: x.isNotNull())


def shown(values: Column) -> Column:
    """A list as the tags show it: ['a', 'b']."""
    return F.concat(F.lit("["), F.array_join(F.transform(values, lambda v: F.concat(F.lit("'"), v, F.lit("'"))), ", "), F.lit("]"))


def status_tags(status: Column, answer: Column, span_texts: Column, required: Column, resolved: Column | None = None) -> Column:
    """Status against placeholders, required list and spans; unknown and error statuses end the check."""
    s = F.upper(F.trim(text_of(status)))
    in_spans = F.exists(span_texts, has_placeholder)
    open_ = has_placeholder(answer) | (in_spans if resolved is None else ~resolved & in_spans)
    ids = F.transform(required, normalize_parameter)
    text = collapse(text_of(answer))
    rest = tags(
        (F.exists(ids, lambda x: x.isin("param", "insert:param")), "ODPListContainsParamToken"),
        ((s == "PARAMS_REQUIRED") & ~open_, "ParamsRequiredButNoPlaceholders"),
        ((s == "PARAMS_REQUIRED") & (F.size(ids) == 0), "ParamsRequiredButODPListEmpty"),
        ((s == "OK") & open_, "OKButUnresolvedODPPlaceholders"),
        ((s == "NO_EVIDENCE") & (F.size(span_texts) > 0), "NoEvidenceButSpansProvided"),
        ((s == "NO_EVIDENCE") & ~text.isin("", "NO_EVIDENCE"), "NoEvidenceButAnswerTextNonEmpty"),
    )
    return F.when(~s.isin(*STATUSES), F.array(F.lit("InvalidStatus"))).when(s == "ERROR", F.array(F.lit("StatusERROR"))).otherwise(rest)


def _stripped(x: Column) -> Column:
    return collapse(F.regexp_replace(F.regexp_replace(text_of(x), r"(?s)\{+.*?\}+", ""), ASSIGNMENT_SPACED, ""))


def verbatim(span: Column, official: Column) -> Column:
    """(strict, normalized): the span is in the text after white space is evened out; the second ignores placeholders."""
    a, b, c, d = collapse(text_of(span)), collapse(text_of(official)), _stripped(span), _stripped(official)
    known = official.isNotNull()
    return F.struct((known & (a != "") & F.contains(b, a)).alias("strict"), (known & (c != "") & F.contains(d, c)).alias("normalized"))


def resolve_sources(spans: DataFrame, corpus: DataFrame, key: str = "q") -> DataFrame:
    """Adds matched and official to spans: the corpus record of the first candidate id that is there exactly, else in another case.

    spans: key, position, source_id, ...; corpus: id, text. Each source id is resolved once, however many spans have it.
    """
    tried = spans.select("source_id").distinct().select("source_id", F.posexplode(doc_id_candidates(F.col("source_id"))).alias("o", "c"))
    known = corpus.select(F.col("id").alias("matched"), F.col("text").alias("official"), F.lower("id").alias("l"))
    found = tried.join(known, F.lower("c") == F.col("l")).groupBy(F.col("source_id").alias("_source")).agg(
        F.min_by(F.struct("matched", "official"), F.struct((F.col("c") != F.col("matched")).alias("e"), "o", "matched")).alias("m"))
    return spans.join(found, F.col("source_id").eqNullSafe(F.col("_source")), "left").select(*spans.columns, "m.matched", "m.official")


def contract_validity(headers: DataFrame, spans: DataFrame, corpus: DataFrame, strict: bool = True, key: str = "q") -> DataFrame:
    """key, is_pass, tags of each contract without any gold label.

    headers: key, status, answer, required (array); spans: key, position, source_id, span_text.
    """
    s = F.upper(F.trim(text_of(F.col("status"))))
    rows = resolve_sources(spans, corpus, key).join(headers.select(key, "status"), key)
    sid = F.trim(text_of(F.col("source_id")))
    ok = verbatim(F.col("span_text"), F.col("official"))["strict" if strict else "normalized"]
    own = tags((sid == "", "MissingSourceId"), ((s != "NO_EVIDENCE") & (F.trim(text_of(F.col("span_text"))) == ""), "MissingSpanText"),
               ((sid != "") & F.col("official").isNull(), "UnknownSourceId"), ((sid != "") & F.col("official").isNotNull() & ~ok, "SpanNotVerbatim"))
    per = rows.withColumn("own", own).groupBy(key).agg(F.array_distinct(F.flatten(F.collect_set("own"))).alias("own"), F.collect_list("span_text").alias("texts"))
    joined = headers.join(per, key, "left").withColumn("texts", F.coalesce("texts", F.array().cast("array<string>"))).withColumn("own", F.coalesce("own", F.array().cast("array<string>")))
    n = F.size("texts")
    whole = tags(((s == "NO_EVIDENCE") & (n > 0), "NoEvidenceButHasSpans"), (s.isin("OK", "PARAMS_REQUIRED") & (n == 0), "MissingEvidenceSpans"), (~s.isin(*STATUSES), "UnknownStatus"))
    every = F.array_sort(F.array_distinct(F.concat("own", whole, status_tags(F.col("status"), F.col("answer"), F.col("texts"), F.col("required")))))
    return joined.select(key, (F.size(every) == 0).alias("is_pass"), every.alias("tags"))


def citation_tags(got_controls: Column, gold_controls: Column, got_docs: Column, gold_docs: Column, strict_extras: bool = True) -> Column:
    """Missed and extra controls and documents, each as one tag with its sorted list; no gold, no tags."""
    lists = []
    for got, gold, what in ((got_controls, gold_controls, "ControlCitations"), (got_docs, gold_docs, "DocIds")):
        missed, extra = F.array_sort(F.array_distinct(F.array_except(gold, got))), F.array_sort(F.array_distinct(F.array_except(got, gold)))
        has = F.size(gold) > 0
        lists.append((has & (F.size(missed) > 0), F.concat(F.lit(f"Missed{what}:"), shown(missed))))
        if strict_extras:
            lists.append((has & (F.size(extra) > 0), F.concat(F.lit(f"Extra{what}:"), shown(extra))))
    return tags(*lists)


def parameter_tags(status: Column, policy: Column, answer: Column, span_texts: Column, required: Column, gold: Column, present: Column | None = None, strict_extras: bool = True) -> Column:
    """Required parameters against placeholders, gold parameters, policy and, for filling, the profile's keys (null: no profile)."""
    clean = lambda a: F.array_sort(F.array_distinct(F.filter(F.transform(a, normalize_parameter), lambda x: x != "")))
    s, p = F.upper(F.trim(text_of(status))), F.upper(F.trim(text_of(policy)))
    got, want = clean(required), clean(gold)
    in_answer, in_spans = placeholder_ids(answer), F.array_distinct(F.flatten(F.transform(span_texts, placeholder_ids)))
    seen = F.array_sort(F.when(F.size(in_answer) > 0, in_answer).otherwise(in_spans))
    both = F.array_union(in_answer, in_spans)
    differ = lambda a, b: (F.size(F.array_except(a, b)) > 0) | (F.size(F.array_except(b, a)) > 0)
    asked, has = s == "PARAMS_REQUIRED", F.size(want) > 0
    none = F.array().cast("array<string>")
    present = F.lit(None).cast("array<string>") if present is None else present
    lacking = F.array_except(want, F.coalesce(present, none))
    out = tags(
        ((F.size(seen) > 0) & asked & differ(seen, got), F.concat(F.lit("ODPListMismatch:extracted="), shown(seen), F.lit(",gen_list="), shown(got))),
        (has & p.isin("ASK", "PRESERVE") & ~asked, "GoldPolicyASKButStatusNotParamsRequired"),
        (has & (p == "FILL_FROM_PROFILE") & present.isNull(), "GoldPolicyFillFromProfileButNoOrgProfileProvided"),
        (has & (p == "FILL_FROM_PROFILE") & present.isNotNull() & (F.size(lacking) > 0) & ~asked, F.concat(F.lit("MissingODPsButStatusNotParamsRequired:"), shown(lacking))),
        (has & (p == "FILL_FROM_PROFILE") & present.isNotNull() & (F.size(lacking) == 0) & (s != "OK"), "AllODPsPresentButStatusNotOK"),
        (has & asked & (F.size(got) > 0) & ((F.size(F.array_except(want, got)) > 0) | (F.lit(strict_extras) & (F.size(F.array_except(got, want)) > 0))),
         F.concat(F.lit("ODPRequiredListNotEqualGold:gold="), shown(want), F.lit(",gen="), shown(got))),
        (has & (s == "OK") & has_placeholder(answer), "StatusOKButStillHasODPPlaceholders"),
    )
    kept = F.when(has & (p == "PRESERVE"), F.transform(F.array_except(want, both), lambda t: F.concat(F.lit("PreserveMissingPlaceholder:"), t))).otherwise(none)
    return F.concat(out, kept)


def version_tags(expected: Column, sources: Column, corpus_version: Column | None = None, strict: bool = False) -> Column:
    """The corpus' revision, or what source ids show of one, against the expected revision."""
    known = expected.isin("rev4", "rev5")
    if corpus_version is not None:
        v = version_lenient(corpus_version)
        return tags((known & v.isin("rev4", "rev5") & (v != expected), F.concat(F.lit("CorpusVersionMismatch:expected="), expected, F.lit(",got="), v)))
    has = [F.contains(F.lower(F.array_join(sources, " ")), F.lit(r)) for r in ("rev4", "rev5")]
    one = F.when(has[0] & ~has[1], "rev4").when(has[1] & ~has[0], "rev5")
    return tags(
        (known & has[0] & has[1], "MixedVersionsInCitations:['rev4', 'rev5']"),
        (known & (one != expected), F.concat(F.lit("VersionMismatchInCitations:expected="), expected, F.lit(",got="), one)),
        (known & ~has[0] & ~has[1], "VersionNotProvableFromSourceIds" if strict else "WARN:VersionNotProvableFromSourceIds"),
    )


def gold_verification(headers: DataFrame, spans: DataFrame, corpus: DataFrame, gold: DataFrame, strict_extras: bool = True, key: str = "q") -> DataFrame:
    """key, is_pass, tags, metrics: the whole check against gold labels; soft tags (WARN:) never fail a contract.

    gold: key, control_id, doc_ids, required_gold, policy, version.
    """
    rows = resolve_sources(spans, corpus, key)
    ok = verbatim(F.col("span_text"), F.col("official"))["strict"]
    own = F.when(F.col("official").isNull(), F.concat(F.lit("CorpusMissingSourceId:"), F.col("source_id"))).when(~ok, F.concat(F.lit("NonVerbatimStrict:"), F.col("source_id"), F.lit("::matched="), F.col("matched")))
    doc = F.lower(F.coalesce("matched", F.element_at(doc_id_candidates(F.col("source_id")), 1)))
    per = rows.groupBy(key).agg(F.collect_list(own).alias("own"), F.collect_list(F.coalesce("span_text", F.lit(""))).alias("texts"), F.collect_list(F.coalesce("source_id", F.lit(""))).alias("sources"),
                                F.collect_set(doc).alias("docs"), F.collect_set(control_of_source(F.col("source_id"))).alias("controls"), F.avg(ok.cast("double")).alias("verbatim"))
    empty = F.array().cast("array<string>")
    j = headers.join(gold, key, "left").join(per, key, "left")
    for c in ("own", "texts", "sources", "docs", "controls", "doc_ids", "required_gold"):
        j = j.withColumn(c, F.coalesce(c, empty))
    gold_controls = F.when(F.col("control_id").isNotNull(), F.array("control_id")).otherwise(empty)
    j = j.withColumn("cm", set_metrics(F.col("controls"), gold_controls)).withColumn("dm", set_metrics(F.col("docs"), F.transform("doc_ids", F.lower)))
    low = F.when((F.size(gold_controls) > 0) & (F.col("cm.recall") < 1), F.array(F.lit("LowControlRecall"))).otherwise(empty)
    every = F.concat(status_tags(F.col("status"), F.col("answer"), F.col("texts"), F.col("required")),
                     parameter_tags(F.col("status"), F.col("policy"), F.col("answer"), F.col("texts"), F.col("required"), F.col("required_gold"), None, strict_extras),
                     version_tags(F.col("version"), F.col("sources")), citation_tags(F.col("controls"), gold_controls, F.col("docs"), F.transform("doc_ids", F.lower), strict_extras), "own", low)
    error = F.upper(F.trim(text_of(F.col("status")))) == "ERROR"
    every = F.when(error, F.array(F.lit("StatusERROR"))).otherwise(F.array_sort(F.array_distinct(every)))
    zero = F.when(error, 0.0)
    hard = F.filter(every, lambda t: ~t.startswith("WARN:"))
    return j.select(key, (F.size(hard) == 0).alias("is_pass"), every.alias("tags"), *(F.coalesce(zero, F.col(f"cm.{m}")).alias(f"control_{m}") for m in ("precision", "recall", "f1")),
                    *(F.coalesce(zero, F.col(f"dm.{m}")).alias(f"doc_{m}") for m in ("precision", "recall", "f1")), F.when(error, float("nan")).otherwise(F.coalesce(F.round("verbatim", 9), F.lit(float("nan")))).alias("verbatim_rate"))


#: Labels of a revision in prose, and packed into a document's name (fixed patterns).
REVISION_LABEL, PACKED_LABEL = r"\b(?:rev(?:ision)?|r)\s*\.?\s*(\d+)\b", r"800[\s._-]*53\s*r\s*(\d+)\b"


def labelled_revisions(x: Column) -> Column:
    """The distinct revisions that a text names, sorted."""
    low = F.lower(text_of(x))
    numbers = F.concat(F.regexp_extract_all(F.replace(low, F.lit("_"), F.lit(" ")), F.lit(REVISION_LABEL), 1), F.regexp_extract_all(low, F.lit(PACKED_LABEL), 1))
    return F.array_sort(F.array_distinct(F.transform(numbers, lambda n: F.concat(F.lit("rev"), n))))


def contract_labels(spans: Column, primary: Column, every: Column, cited_answer: Column) -> Column:
    """(place, value) of each text of a contract that may name a revision. spans: array of struct(source_id, ...); of an answer only what follows its last citation mark."""
    parts = F.split(cited_answer, r"(?i)\bCitations?\s*:\s*")
    sources = F.transform(spans, lambda s, k: F.struct(F.concat(F.lit("evidence_spans["), k.cast("string"), F.lit("].source_id")).alias("place"), s["source_id"].alias("value")))
    others = F.array(*(F.struct(F.lit(place).alias("place"), value.alias("value")) for place, value in (("primary_citation", primary), ("all_citations", every), ("answer_text_with_citation", F.when(F.size(parts) > 1, F.element_at(parts, -1))))))
    return F.filter(F.concat(sources, others), lambda l: l["value"].isNotNull())


def revision_tags(active: Column, declared: Column, labels: Column, is_text: Column | None = None) -> Column:
    """Declared revision and explicit labels against the active corpus. labels: array of struct(place, value); is_text: false for a declaration that is no text."""
    both = F.struct(version_strict(active).alias("a"), version_strict(declared if is_text is None else F.when(F.coalesce(is_text, F.lit(True)), declared)).alias("d"))
    return let(both, lambda v: _revision_tags(v["a"], v["d"], declared, labels))


def _revision_tags(a: Column, d: Column, declared: Column, labels: Column) -> Column:
    wrong = F.flatten(F.transform(labels, lambda l: let(labelled_revisions(l["value"]), lambda named: F.filter(F.array(
        F.when(F.exists(named, lambda x: ~x.isin("rev4", "rev5")), F.concat(F.lit("UnsupportedRevisionLabel:"), l["place"])),
        F.when(a.isNotNull() & F.exists(named, lambda x: x != a), F.concat(F.lit("RevisionLabelMismatch:"), l["place"], F.lit(":expected="), a, F.lit(",got="), F.array_join(named, ",")))),
        lambda t: t.isNotNull()))))
    head = tags((a.isNull(), "ActiveCorpusRevisionMissingOrInvalid"), (declared.isNull(), "FrameworkVersionMissing"), (declared.isNotNull() & d.isNull(), "FrameworkVersionInvalid"),
                (a.isNotNull() & d.isNotNull() & (a != d), F.concat(F.lit("FrameworkVersionMismatch:expected="), a, F.lit(",got="), d)))
    return F.array_sort(F.array_distinct(F.concat(head, wrong)))


def mechanical_tags(spans: Column, window: Column, eligible: Column, answer: Column, status: Column, required: Column, known: Column, asked: Column) -> Column:
    """Exact ids, the frozen window, repeats, the parameter list and the clarification list. spans: array of struct(source_id, span_text)."""
    ids = F.transform(spans, lambda s: s["source_id"])
    kept = F.array_sort(F.array_distinct(F.flatten(F.transform(F.concat(F.array(answer), F.transform(spans, lambda s: s["span_text"])), lambda t: placeholder_keys(t)))))
    declared = F.array_sort(F.array_distinct(required))
    s = F.upper(F.trim(text_of(status)))
    return F.array_sort(tags(
        (F.exists(ids, lambda i: ~F.array_contains(eligible, i)), "NotExactEligibleCCSId"),
        (F.exists(ids, lambda i: ~F.array_contains(window, i)), "OutsideFrozenEvidenceWindow"),
        (F.size(F.array_distinct(ids)) < F.size(ids), "DuplicateEvidenceId"),
        (~s.isin("OK", "PARAMS_REQUIRED") | (F.trim(text_of(answer)) == ""), "NoNormalNonemptyAnswer"),
        (kept != declared, "RetainedParameterUnionMismatch"),
        (F.size(declared) < F.size(required), "DuplicateDeclaredParameter"),
        (F.exists(declared, lambda d: ~F.array_contains(known, d)), "UnknownDeclaredParameter"),
        (s != F.when(F.size(kept) > 0, "PARAMS_REQUIRED").otherwise("OK"), "StatusNotEqualRetainedParameterState"),
        (F.array_sort(F.array_distinct(asked)) != declared, "AskListNotEqualDeclaredParameters"),
    ))


def strict_pass(contract: Column, provenance: Column, accounting: Column, gates: list[Column], revision: Column | None = None) -> Column:
    """All of contract, provenance, accounting and the four reviews; an uncertain review (null) is no pass."""
    out = contract & provenance & accounting
    for g in gates:
        out = out & F.coalesce(g == "pass", F.lit(False))
    return F.coalesce(out if revision is None else out & revision, F.lit(False))


def cnf_coverage(groups: Column, ids: Column) -> Column:
    """Every group has one of the ids; null without groups."""
    return F.when(F.size(groups) > 0, F.forall(groups, lambda g: F.exists(g, lambda s: F.array_contains(ids, s))))
