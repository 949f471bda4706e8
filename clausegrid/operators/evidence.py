"""Control gate, evidence windows, selection, assembly and provenance of citations."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from clausegrid.config import WINDOW, WindowConfig
from clausegrid.functions.params import has_placeholder
from clausegrid.functions.text import is_enhancement_clause, jaccard, token_set
from clausegrid.storage import stored

CLAUSE_KINDS = ("smt", "gdn")
#: Names of filter modes and what they stand for; unknown modes keep everything.
MODES = {"smt_only": "statement_only", "statement_only": "statement_only", "prefer_smt": "prefer_statement_only", "prefer_statement": "prefer_statement_only",
         "prefer_statement_only": "prefer_statement_only", "prefer_smt_keep_params": "ordered", "prefer_smt_drop_params": "ordered"}


def allowed_controls(controls: Column, margin: Column, cfg: WindowConfig = WINDOW) -> Column:
    """(allowed, tier): the first control, or two or three where the margin is low; a missing margin is certain.

    Repeated controls take up places.
    """
    m = F.coalesce(margin, F.lit(1.0))
    n = F.when((m < cfg.gate_low_three) & (F.size(controls) >= 3), min(3, cfg.gate_max)).when((m < cfg.gate_low_two) & (F.size(controls) >= 2), min(2, cfg.gate_max))
    return F.struct(F.slice(controls, 1, F.coalesce(n, F.lit(max(1, cfg.gate_top)))).alias("allowed"), F.coalesce(n - 1, F.lit(0)).alias("tier"))


def kind_order(kind: Column) -> Column:
    return F.when(kind == "smt", 0).when(kind == "gdn", 1).otherwise(9)


def by_mode(docs: DataFrame, mode: str = "all", top: int | None = None, key: str = "q") -> DataFrame:
    """Filters and orders candidates of each query by kind: rows with `position` renumbered from 1.

    The cut at `top` comes before repeated ids are dropped. Only statements and guidance ever stay.
    """
    mode, kind = MODES.get(mode, "all"), F.col("kind")
    rows = docs
    if mode == "statement_only":
        rows = rows.where(kind == "smt")
    elif mode == "prefer_statement_only":
        some = F.max((kind == "smt").cast("int")).over(W.partitionBy(key))
        rows = rows.withColumn("__s", some).where((F.col("__s") == 0) | (kind == "smt")).drop("__s")
    order = [kind_order(kind), F.col("position")] if mode == "ordered" else [F.col("position")]
    rows = rows.where(kind.isin(*CLAUSE_KINDS)).withColumn("__p", F.row_number().over(W.partitionBy(key).orderBy(*order)))
    if top:
        rows = rows.where(F.col("__p") <= top)
    rows = rows.withColumn("__n", F.row_number().over(W.partitionBy(key, "id").orderBy("__p"))).where("__n = 1")
    return rows.withColumn("position", F.row_number().over(W.partitionBy(key).orderBy("__p"))).drop("__p", "__n")


def evidence_window(docs: DataFrame, gates: DataFrame, cfg: WindowConfig = WINDOW, key: str = "q") -> DataFrame:
    """The window of each query: allowed controls, the primary one first if the margin is high enough, statements
    before guidance, no empty texts, at most cfg.cap rows; a query without any gets its primary control's statements.

    docs: key, position, id, control_id, kind, text; gates: key, allowed, primary, margin. A missing margin is 0 here.
    """
    rows = docs.join(gates, key).withColumn("text", F.coalesce("text", F.lit(""))).where(F.trim("text") != "")
    rows = rows.withColumn("is_primary", F.col("control_id") == F.col("primary"))
    first = F.when((F.coalesce("margin", F.lit(0.0)) >= cfg.primary_first_margin) & F.col("is_primary"), 0).otherwise(1)
    inside = rows.where((F.size("allowed") == 0) | F.array_contains("allowed", F.col("control_id"))).where(F.col("kind").isin(*CLAUSE_KINDS))
    inside = inside.withColumn("__o", F.struct(kind_order(F.col("kind")).alias("a"), first.alias("b"), F.col("position").alias("c"))).withColumn("fallback", F.lit(False))
    spare = rows.where(F.col("is_primary") & (F.col("kind") == "smt")).withColumn("__o", F.struct(F.lit(0).alias("a"), F.lit(0).alias("b"), F.col("position").alias("c"))).withColumn("fallback", F.lit(True))
    both = inside.unionByName(spare).withColumn("__any", F.max((~F.col("fallback")).cast("int")).over(W.partitionBy(key)))
    both = both.where(F.col("fallback") == (F.col("__any") == 0)).withColumn("__n", F.row_number().over(W.partitionBy(key, "id").orderBy("__o"))).where("__n = 1")
    both = both.withColumn("position", F.row_number().over(W.partitionBy(key).orderBy("__o"))).where(F.col("position") <= cfg.cap)
    return both.select(key, "position", "id", "control_id", "kind", "text", "fallback")


def manifests(window: DataFrame, key: str = "q") -> DataFrame:
    """key, n, sha256 of each window: canonical JSON of positions, ids and text hashes in order."""
    record = F.concat(F.lit('{"position":"'), (F.col("position") - 1).cast("string"), F.lit('","source_id":'), F.regexp_extract(F.to_json(F.struct(F.trim("id").alias("x"))), '^\\{"x":(.*)\\}$', 1), F.lit(',"text_sha256":"'), F.sha2("text", 256), F.lit('"}'))
    listed = window.groupBy(key).agg(F.count("*").alias("n"), F.array_sort(F.collect_list(F.struct("position", record.alias("r")))).alias("r"))
    return listed.select(key, "n", F.sha2(F.concat(F.lit("["), F.array_join(F.transform("r", lambda x: x["r"]), ","), F.lit("]")), 256).alias("sha256"))


def sanitize(selected: Column, window: Column) -> Column:
    """Selected ids that are in the window, first occurrences only."""
    return F.array_distinct(F.filter(selected, lambda x: F.array_contains(window, x)))


def status(x: Column) -> Column:
    up = F.upper(F.trim(F.coalesce(x, F.lit("ERROR"))))
    return F.when(up.isin("OK", "PARAMS_REQUIRED", "NO_EVIDENCE", "ERROR"), up).otherwise("ERROR")


def winners(rows: DataFrame, question: str = "question", key: str = "q") -> DataFrame:
    """key, control: the most cited control of each query, then most token overlap with the question, then the smallest id.

    rows: key, question, control_id, text of the cited clauses.
    """
    overlap = F.size(F.array_intersect(token_set(F.col(question)), token_set(F.col("text"))))
    counts = rows.groupBy(key, "control_id").agg(F.count("*").alias("n"), F.max(overlap).alias("o"))
    best = counts.withColumn("r", F.row_number().over(W.partitionBy(key).orderBy(F.desc("n"), F.desc("o"), "control_id"))).where("r = 1")
    return best.select(key, F.col("control_id").alias("control"))


def fill(selected: DataFrame, corpus: DataFrame, key: str = "q") -> DataFrame:
    """Canonical texts of selected ids, clause kinds only. selected: key, position, id."""
    return selected.join(corpus.select("id", "kind", "text"), "id").where(F.col("kind").isin(*CLAUSE_KINDS)).select(key, "position", "id", "text")


def secondary(candidates: DataFrame, want_parameters: Column, cfg: WindowConfig = WINDOW, key: str = "q") -> DataFrame:
    """key, id: the first fillable candidate, one with a placeholder first where parameters are wanted."""
    rows = candidates.where((F.col("position") <= cfg.fallback_checked) & F.col("kind").isin(*CLAUSE_KINDS) & (F.trim("text") != ""))
    order = [F.when(want_parameters & has_placeholder(F.col("text")), 0).otherwise(1), F.col("position")]
    return rows.withColumn("r", F.row_number().over(W.partitionBy(key).orderBy(*order))).where("r = 1").select(key, "id")


def rescue(spans: DataFrame, pool: DataFrame, cfg: WindowConfig = WINDOW, key: str = "q") -> DataFrame:
    """Puts statements of the winner with placeholders in front of citations that have none, at most cfg.rescue_max.

    spans: key, position, id, text; pool: key, id, text, position: statements of the winning control. Adds origin.
    """
    has = spans.groupBy(key).agg(F.max(has_placeholder(F.col("text")).cast("int")).alias("has"))
    tier = F.when(F.col("id").rlike(r"_smt\."), 0).when(F.col("id").endswith("_smt"), 1).otherwise(2)
    add = pool.join(has, key).where("has = 0").where(has_placeholder(F.col("text"))).join(spans.select(key, "id"), [key, "id"], "left_anti").dropDuplicates([key, "id"])
    add = add.withColumn("r", F.row_number().over(W.partitionBy(key).orderBy(tier, "position", "id"))).where(F.col("r") <= cfg.rescue_max)
    rows = add.select(key, (F.col("r") - 1000).alias("o"), "id", "text", F.lit("rescue").alias("origin")).unionByName(spans.select(key, F.col("position").alias("o"), "id", "text", F.lit("selector").alias("origin")))
    return rows.withColumn("position", F.row_number().over(W.partitionBy(key).orderBy("o"))).drop("o")


def closure(seeds: DataFrame, edges: DataFrame, cfg: WindowConfig = WINDOW, key: str = "q", steps: int = 32) -> DataFrame:
    """key, id, level: seeds and their ancestors up to the base statement (level 0, -1, ...; at most so many steps), then
    children of the seeds level by level (at most so many a parent) while there are fewer than so many in all.

    seeds: key, id, position; edges: parent, id, label_key, and kind and text of id, if they are known: then only
    statements and guidance with a text are children. Ancestors are stored step by step and end with the longest chain.
    """
    kids = edges.withColumn("s", F.row_number().over(W.partitionBy("parent").orderBy("label_key", "id"))).where(F.col("s") <= cfg.closure_children)
    if {"kind", "text"} <= set(edges.columns):
        kids = kids.where(F.lower(F.trim("kind")).isin(*CLAUSE_KINDS) & (F.trim("text") != ""))
    kids = kids.select("parent", F.col("id").alias("kid"), "s")
    level = seeds.select(key, "id", F.col("position").cast("long").alias("o"), F.lit(0).alias("level"))
    every, up = level, level
    parents = edges.select("parent", "id").where((F.trim("parent") != "") & (F.col("parent") != F.col("id"))).distinct()
    for k in range(1, steps + 1):
        on = up.where((F.col("level") == 0) | ~F.lower(F.trim("id")).endswith("_smt"))
        up = stored(on.join(parents, "id").select(key, F.col("parent").alias("id"), "o", F.lit(-k).alias("level")))
        if up.isEmpty():
            break
        every = every.unionByName(up)
    for k in range(1, cfg.closure_levels + 1):
        level = level.join(kids, F.col("id") == F.col("parent")).select(key, F.col("kid").alias("id"), (F.col("o") * 100 + F.col("s")).alias("o"), F.lit(k).alias("level"))
        every = every.unionByName(level)
    order = [F.greatest("level", F.lit(0)), F.col("o"), F.desc("level")]
    first = every.withColumn("n", F.row_number().over(W.partitionBy(key, "id").orderBy(*order))).where("n = 1")
    ranked = first.withColumn("r", F.row_number().over(W.partitionBy(key).orderBy(*order, "id")))
    return ranked.where((F.col("level") <= 0) | (F.col("r") <= cfg.closure_total)).select(key, "id", "level")


def ancestors(seeds: DataFrame, edges: DataFrame, steps: int = 1000, key: str = "q") -> DataFrame:
    """key, id, up: seeds and the chains of their parents, with the fewest steps to each. One recursive query, whatever the depth; a chain of more than `steps` is an error, so a
    ring of parents is one, too.
    """
    return seeds.sparkSession.sql(
        f"""WITH RECURSIVE chain(k, id, up) MAX RECURSION LEVEL {steps} AS (
              SELECT `{key}`, id, 0 FROM {{seeds}} UNION ALL SELECT c.k, e.parent, c.up + 1 FROM chain c JOIN {{edges}} e ON e.id = c.id)
            SELECT k AS `{key}`, id, min(up) AS up FROM chain GROUP BY k, id LIMIT ALL""",
        seeds=seeds.select(key, "id"),
        edges=edges.select("parent", "id"),
    )


def single_origin(flags: list[Column]) -> Column:
    """True if exactly one of the possible origins of an id holds."""
    return F.size(F.filter(F.array(*flags), lambda x: x)) == 1


def primary_citation(spans: DataFrame, question: str = "question", key: str = "q") -> DataFrame:
    """key, id: the citation that shares most words with the question; the first of equal ones."""
    overlap = F.size(F.array_intersect(token_set(F.col(question)), token_set(F.col("text"))))
    return spans.groupBy(key).agg(F.max_by("id", F.struct(overlap.alias("o"), (-F.col("position")).alias("p"))).alias("id"))


def assembled(spans: DataFrame, key: str = "q") -> DataFrame:
    """key, answer, citations: texts in order with a blank line between, ids in order."""
    listed = spans.groupBy(key).agg(F.array_sort(F.collect_list(F.struct("position", "id", "text"))).alias("s"))
    return listed.select(key, F.trim(F.array_join(F.transform("s", lambda x: x["text"]), "\n\n")).alias("answer"), F.array_join(F.transform("s", lambda x: x["id"]), ", ").alias("citations"))


def without_enhancements(ids: Column, allowed: Column) -> Column:
    """Drops enhancement clauses unless the query allows them."""
    return F.filter(ids, lambda x: allowed | ~is_enhancement_clause(x))


def near_rewrites(query: Column, rewrites: Column, least: float = 0.15, most: int = 3) -> Column:
    """The first rewrites whose words overlap enough with the query's."""
    return F.slice(F.filter(rewrites, lambda r: jaccard(token_set(query, 1), token_set(r, 1)) >= least), 1, most)


def width_sweep(docs: DataFrame, widths: tuple[int, ...], key: str = "q") -> DataFrame:
    """width, queries, documents: how many queries and clauses have one of the first `width` controls of their query. docs: key, position (from 1, no gaps), control_id, kind.

    A control is among the first ones from its first position on, so no list of controls is made and no row is repeated for a width.
    """
    first = docs.where(F.col("control_id").isNotNull()).groupBy(key, "control_id").agg(F.min("position").alias("first"), F.count_if(F.col("kind").isin(*CLAUSE_KINDS)).alias("n"))
    met = first.groupBy(key).agg(*(F.sum(F.when(F.col("first") <= w, F.col("n")).otherwise(0)).alias(f"w{w}") for w in widths))
    totals = met.agg(*(F.struct(F.count_if(F.col(f"w{w}") > 0).alias("queries"), F.coalesce(F.sum(f"w{w}"), F.lit(0)).alias("documents")).alias(f"w{w}") for w in widths))
    rows = totals.select(F.explode(F.array(*(F.struct(F.lit(w).alias("width"), F.col(f"w{w}.queries").alias("queries"), F.col(f"w{w}.documents").alias("documents")) for w in widths))).alias("r"))
    return rows.where("r.queries > 0").select("r.*")
