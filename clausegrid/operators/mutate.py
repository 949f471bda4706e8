"""Deterministic mutations of contracts, for measuring what the checks detect."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from clausegrid.functions.text import rotate_alnum
from clausegrid.operators.relational import positions
from clausegrid.storage import stored


def numbered(ids: DataFrame, id_: str = "id") -> DataFrame:
    """id, i, n: place of every id in sorted order, from 0, and their number. Stored, as places are met with each other."""
    placed = positions(ids.select(id_).distinct(), [F.col(id_).asc()], "i")
    placed = stored(placed.select(id_, (F.col("i") - 1).alias("i")))
    return placed.withColumn("n", F.lit(placed.count()))


def swap_source(spans: DataFrame, ids: DataFrame) -> DataFrame:
    """Every source id becomes the next one in sorted order; the last becomes the first."""
    n = numbered(ids)
    following = n.select("id", ((F.col("i") + 1) % F.col("n")).alias("j")).join(n.select(F.col("id").alias("next"), F.col("i").alias("j")), "j").select(F.col("id").alias("source_id"), "next")
    return spans.join(following, "source_id").select(*[c for c in spans.columns if c != "source_id"], F.col("next").alias("source_id"))


def by_modulo(rows: DataFrame, ids: DataFrame, key: str = "q") -> DataFrame:
    """key, id: the id at place (key - 1) modulo the number of ids."""
    n = numbered(ids)
    total = n.select("n").limit(1)
    placed = rows.join(F.broadcast(total), how="cross").withColumn("i", F.pmod(F.col(key) - 1, F.col("n")))
    return placed.join(n.select("id", "i"), "i").select(key, "id")


def replay_deltas(before: DataFrame, after: DataFrame, key: str, value: str, expected: str) -> DataFrame:
    """What a replay changed, by the value before: n, changed, unexpected (changes that `expected`, the value foreseen by key, does not name),
    missing (keys that one side lacks) and accepted (nothing unexpected or missing).

    before: key, value, expected; after: key, value.
    """
    both = before.join(after.select(key, F.col(value).alias("_after"), F.lit(True).alias("_there")), key, "full")
    missing = F.col("_there").isNull() | F.col(expected).isNull()
    same, foreseen = F.col("_after").eqNullSafe(F.col(value)), F.col("_after").eqNullSafe(F.col(expected))
    counts = both.groupBy(value).agg(F.count("*").alias("n"), F.count_if(~missing & ~same).alias("changed"), F.count_if(~missing & ~foreseen).alias("unexpected"), F.count_if(missing).alias("missing"))
    return counts.withColumn("accepted", (F.col("unexpected") == 0) & (F.col("missing") == 0))


def alter_first(x: Column) -> Column:
    """The first ASCII letter or digit is replaced by the next one of its kind."""
    at = F.regexp_instr(x, F.lit("[A-Za-z0-9]"))
    return F.when(at == 0, x).otherwise(F.overlay(x, rotate_alnum(F.substring(x, at, F.lit(1))), at, F.lit(1)))


def drop_last(values: Column) -> Column:
    return F.slice(values, F.lit(1), F.greatest(F.size(values) - 1, F.lit(0)))


def flip_status(x: Column) -> Column:
    return F.when(x == "OK", "PARAMS_REQUIRED").when(x == "PARAMS_REQUIRED", "OK").otherwise(x)


#: Mutations of what a contract says of its revision (fixed names).
REVISION_MUTATIONS = ("opposite_declaration", "missing_declaration", "unknown_declaration", "ambiguous_declaration", "nonstring_declaration", "opposite_source_namespace", "opposite_packed_source_namespace", "opposite_citation_label")


def revision_mutations(contracts: DataFrame, revision: str = "revision") -> DataFrame:
    """Every contract as it is (mutation none) and once for each of the eight mutations.

    contracts: revision (rev4 or rev5), declared, spans (array of struct(source_id, ...)), all_citations. Adds mutation and is_text (false where the declaration is a
    number). Contracts without spans have no source to change, so mutations of sources and citations leave them as they are.
    """
    rows = contracts.withColumn("mutation", F.explode(F.array(*map(F.lit, ("none", *REVISION_MUTATIONS)))))
    m, own = F.col("mutation"), F.col(revision)
    wrong = F.when(own == "rev5", "rev4").otherwise("rev5")
    number = lambda r: F.substring(r, -1, 1)
    declared = (F.when(m == "opposite_declaration", wrong).when(m == "missing_declaration", F.lit(None).cast("string")).when(m == "unknown_declaration", "unknown")
                .when(m == "ambiguous_declaration", "Revision 4 / Revision 5").when(m == "nonstring_declaration", number(own)).otherwise(F.col("declared")))
    before = F.when(m == "opposite_source_namespace", F.concat(F.lit("NIST_SP-800-53_"), wrong, F.lit(":"))).when(m == "opposite_packed_source_namespace", F.concat(F.lit("NIST.SP.800-53r"), number(wrong), F.lit(".pdf#")))
    spans = F.when(before.isNotNull(), F.transform("spans", lambda s, k: s.withField("source_id", F.when(k == 0, F.concat(before, s["source_id"])).otherwise(s["source_id"])))).otherwise(F.col("spans"))
    cited = F.when((m == "opposite_citation_label") & (F.size("spans") > 0), F.concat(F.lit("Citations: "), F.col("spans")[0]["source_id"], F.lit(" (NIST SP 800-53 Rev. "), number(wrong), F.lit(")"))).otherwise(F.col("all_citations"))
    return rows.withColumns({"declared": declared, "is_text": m != "nonstring_declaration", "spans": spans, "all_citations": cited})


def mutation_summary(rows: DataFrame, by: str, changed: Column, detected: Column) -> DataFrame:
    """by, n, changed, detected, and undetected changes. rows: a row for each mutated contract."""
    counts = rows.groupBy(by).agg(F.count("*").alias("n"), F.count_if(changed).alias("changed"), F.count_if(detected).alias("detected"), F.count_if(changed & ~detected).alias("undetected"))
    return counts
