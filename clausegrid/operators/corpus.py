"""From nested catalogs to clause and parameter records."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window as W, functions as F

from clausegrid.functions.text import clause_kind, parameter_kind

NODE = "id string, title string, label string, name string, prose string, groups array<string>, controls array<string>, parts array<string>, params array<string>"


#: Digits of a place among siblings in a path, and the slash.
_STEP = 11


def levels(catalogs: DataFrame) -> int:
    """How deeply the objects of the JSON texts are nested, at most."""
    plain = F.regexp_replace("json", r'"(?:[^"\\]|\\.)*"', "")
    braces = F.filter(F.split(plain, ""), lambda c: c.isin("{", "}"))
    start = F.struct(F.lit(0).alias("now"), F.lit(0).alias("most"))
    step = lambda a, c: F.struct((a["now"] + F.when(c == "{", 1).otherwise(-1)).alias("now"), F.greatest(a["most"], a["now"] + F.when(c == "{", 1).otherwise(-1)).alias("most"))
    return catalogs.agg(F.max(F.aggregate(braces, start, step)["most"])).first()[0] or 1


def walk(catalogs: DataFrame, child: str, key: str = "catalog") -> DataFrame:
    """Every node below a catalog in pre-order: key, path (sortable), id, parent, node fields.

    catalogs: key, json. child: the array that is followed (parts), groups and controls of any level too. The parent
    is the nearest ancestor with an id. One recursive query, whose steps each parse the level that the last one found, as deep as the texts are nested.
    """
    kids = [f"coalesce(n.{c}, array())" for c in (("groups", "controls", child) if child == "parts" else (child,))]
    return catalogs.sparkSession.sql(
        f"""WITH RECURSIVE nodes(k, path, parent, n) MAX RECURSION LEVEL {levels(catalogs) + 1} AS (
              SELECT `{key}`, '', CAST(NULL AS STRING), from_json(json, '{NODE}') FROM {{catalogs}}
              UNION ALL
              SELECT k, concat(path, lpad(CAST(pos AS STRING), {_STEP - 1}, '0'), '/'), coalesce(n.id, parent), from_json(j, '{NODE}')
              FROM nodes LATERAL VIEW posexplode(concat({", ".join(kids)})) AS pos, j)
            SELECT k AS `{key}`, path, parent, n.id, n.title, n.label, n.name, n.prose, size(coalesce(n.{child}, array())) AS children FROM nodes LIMIT ALL""",
        catalogs=catalogs,
    )


def descendant_prose(nodes: DataFrame, key: str = "catalog") -> DataFrame:
    """key, path, prose: labels and prose of all nodes below a node in pre-order, a space between."""
    own = F.trim(F.concat_ws(" ", F.col("label"), F.trim("prose")))
    texts = nodes.where(F.coalesce(F.trim("prose"), F.lit("")) != "").select(key, F.col("path").alias("p"), own.alias("t"))
    up = texts.withColumn("steps", F.size(F.split("p", "/")) - 1)
    ancestors = up.select(key, "p", "t", F.explode(F.transform(F.sequence(F.lit(0), F.greatest(F.col("steps") - 1, F.lit(0))), lambda k: F.substring(F.col("p"), F.lit(1), k * _STEP))).alias("path")).where("path <> p")
    return ancestors.groupBy(key, "path").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("p", "t"))), lambda x: x["t"]), " ").alias("below"))


def emit_clauses(nodes: DataFrame, key: str = "catalog") -> DataFrame:
    """Clause records: the first node of every lower-cased id, text or its descendants' text; empty ones leave after that."""
    rows = nodes.join(descendant_prose(nodes, key), [key, "path"], "left").where(F.coalesce("id", F.lit("")) != "")
    text = F.trim(F.coalesce("prose", F.lit("")))
    rows = rows.select(key, "path", F.lower("id").alias("id"), "parent", "label", clause_kind(F.col("id")).alias("kind"), F.when(text != "", text).otherwise(F.trim(F.coalesce("below", F.lit("")))).alias("text"), (text == "").alias("used_descendants"))
    first = rows.withColumn("r", F.row_number().over(W.partitionBy("id").orderBy(key, "path"))).where("r = 1").drop("r")
    return first.where("text <> '' AND kind <> 'other'")


def emit_parameters(params: DataFrame) -> DataFrame:
    """Parameter records of id, label, choices, guidelines: only _odp and _prm ids."""
    none = F.array().cast("array<string>")
    text = F.concat_ws(" ", "label", F.when(F.size(F.coalesce("choices", none)) > 0, F.concat(F.lit("Choices: "), F.array_join("choices", "; "))), F.when(F.size(F.coalesce("guidelines", none)) > 0, F.concat(F.lit("Guidelines: "), F.array_join("guidelines", " "))))
    return params.where(F.lower("id").rlike("_(odp|prm)")).select(F.lower("id").alias("id"), parameter_kind(F.col("id")).alias("kind"), text.alias("text"))


def uncovered(gold_ids: DataFrame, corpus: DataFrame) -> DataFrame:
    """Gold ids that the corpus lacks, whatever their case."""
    return gold_ids.select(F.lower(F.trim("id")).alias("id")).distinct().join(corpus.select(F.lower("id").alias("id")), "id", "left_anti")


def sane(corpus: DataFrame, least: int = 1000) -> DataFrame:
    """One row with the counts; too few records or no statement is an error."""
    counted = corpus.agg(F.count("*").alias("n"), F.count_if(F.col("kind") == "smt").alias("statements"))
    ok = (F.col("n") >= least) & (F.col("statements") > 0)
    return counted.where(F.when(ok, True).otherwise(F.raise_error(F.lit("the corpus is too small or has no statements")).cast("boolean")))


def key_map(params: DataFrame) -> DataFrame:
    """key, id: the smallest parameter id of every key. params: key, id."""
    return params.groupBy("key").agg(F.min("id").alias("id"))
