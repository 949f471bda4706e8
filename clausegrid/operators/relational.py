"""Joins, aggregates, orders and set operations that the evaluations are made of, for any table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from clausegrid.operators.corpus import levels
from clausegrid.operators.metrics import rounded
from clausegrid.sources.scans import unique
from clausegrid.storage import stored

# ---------------------------------------------------------------- joins


def inner_paired(left: DataFrame, right: DataFrame, key: str) -> DataFrame:
    """Rows of both sides with the same key; a missing or repeated key on either side is an error."""
    return unique(left, key).join(unique(right, key), key)


def labels_wide(rows: DataFrame, key: str, label: str, value: str, labels: list[str]) -> DataFrame:
    """key and a column for each label with its largest value; null where a key has none."""
    return rows.groupBy(key).agg(*(F.max(F.when(F.col(label) == x, F.col(value))).alias(x) for x in labels))


def key_difference(left: DataFrame, right: DataFrame, key: str) -> DataFrame:
    """One row: distinct keys that only the right and only the left side have; both 0 if the keys are equal."""
    a, b = left.select(key).distinct().withColumn("l", F.lit(1)), right.select(key).distinct().withColumn("r", F.lit(1))
    return a.join(b, key, "full").agg(F.count_if(F.col("l").isNull()).alias("only_right"), F.count_if(F.col("r").isNull()).alias("only_left"))


def with_keys(rows: DataFrame, keys: DataFrame, key: str, there: bool = True) -> DataFrame:
    """The rows whose key is among keys, or is not."""
    return rows.join(keys.select(key), key, "left_semi" if there else "left_anti")


def contained(parts: DataFrame, wholes: DataFrame, key: str, part: str, whole: str, out: str = "inside") -> DataFrame:
    """Whether each part's text lies in the text of the record that it names."""
    return parts.join(wholes.select(key, F.col(whole).alias("whole")), key).withColumn(out, F.contains("whole", part)).drop("whole")


def with_children(nodes: DataFrame, parents: DataFrame, children: DataFrame, up: str, parent: str, child_of: str, out: str = "children") -> DataFrame:
    """Every node with a value of its parent and the number of its children. nodes: id, up; parents: up, parent; children: child_of."""
    n = children.groupBy(F.col(child_of).alias("id")).agg(F.count("*").alias(out))
    return nodes.join(parents.select(up, parent), up).join(n, "id", "left").select("id", parent, F.coalesce(out, F.lit(0)).alias(out))


def for_conditions(rows: DataFrame, conditions: dict[str, Callable[[DataFrame], DataFrame]], out: str = "condition") -> DataFrame:
    """The rows under every condition: each changes them in its own way."""
    found = None
    for name, change in conditions.items():
        one = change(rows).withColumn(out, F.lit(name))
        found = one if found is None else found.unionByName(one)
    return found


def filled(*columns: Column) -> Column:
    """The first of some texts that is neither null nor empty."""
    return F.coalesce(*(F.when(c != "", c) for c in columns))


# ---------------------------------------------------------------- aggregates


def counted(rows: DataFrame, by: list[str]) -> DataFrame:
    return rows.groupBy(*by).agg(F.count("*").alias("n"))


def means(rows: DataFrame, by: list[str], values: list[str]) -> DataFrame:
    """n and the mean of each value."""
    return rows.groupBy(*by).agg(F.count("*").alias("n"), *(rounded(F.avg(v)).alias(v) for v in values))


def names_of(rows: DataFrame, column: str) -> list[str]:
    """The values of a column with few values, in order."""
    return [r[0] for r in rows.where(F.col(column).isNotNull()).select(column).distinct().orderBy(column).collect()]


def pivot_means(rows: DataFrame, by: list[str], column: str, value: Column, names: list[str] | None = None, decimals: int = 6, missing: float = -1.0) -> DataFrame:
    """A column with the mean for each name (every value of the column by default); `missing` where a group has none."""
    names = names_of(rows, column) if names is None else names
    return rows.groupBy(*by).agg(*(F.coalesce(F.round(F.avg(F.when(F.col(column) == x, value)), decimals), F.lit(missing)).alias(x) for x in names))


def counted_with_missing(rows: DataFrame, column: str, label: str = "?") -> DataFrame:
    """Counts by value; rows without one are a group of their own."""
    return rows.groupBy(F.coalesce(F.col(column), F.lit(label)).alias(column)).agg(F.count("*").alias("n"))


def size_bucket(n: Column) -> Column:
    return F.when(n <= 1, "0-1").when(n == 2, "2").when(n <= 4, "3-4").otherwise("5+")


def top_tags(rows: DataFrame, tags: Column, most: int = 30) -> DataFrame:
    """The most frequent tags and their counts; of equal ones the first in order."""
    return rows.select(F.explode(tags).alias("tag")).groupBy("tag").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "tag").limit(most)


def prefix_counts(rows: DataFrame, column: str, separator: str) -> DataFrame:
    """Counts by what stands before the first separator."""
    return rows.groupBy(F.substring_index(column, separator, 1).alias("prefix")).agg(F.count("*").alias("n"))


def rates(rows: DataFrame, by: list[str], condition: Column, name: str) -> DataFrame:
    """How many rows of a group meet a condition, and their share."""
    return rows.groupBy(*by).agg(F.count_if(condition).alias(name), rounded(F.count_if(condition) / F.count("*")).alias("rate"))


def distinct_counts(rows: DataFrame, by: list[str], columns: dict[str, list[str]]) -> DataFrame:
    return rows.groupBy(*by).agg(*(F.countDistinct(*c).alias(name) for name, c in columns.items()))


def nan_mean(rows: DataFrame, by: list[str], value: str, decimals: int = 6) -> DataFrame:
    """The mean of the values that are numbers."""
    v = F.col(value)
    return rows.groupBy(*by).agg(F.round(F.avg(F.when(~F.isnan(v), v)), decimals).alias("mean"))


def best_row(rows: DataFrame, by: list[str], value: str, id_: str) -> DataFrame:
    """The largest value and the id that has it, the smallest of equal ones."""
    return rows.groupBy(*by).agg(F.max(value).alias("top"), F.max_by(id_, F.struct(F.col(value), -F.col(id_))).alias(id_))


def joined_lists(rows: DataFrame, by: list[str], order: str, value: str, kept: str) -> DataFrame:
    """`values`: a group's values in order; `kinds`: its distinct kinds in alphabetical order; both joined by commas."""
    ordered = F.transform(F.array_sort(F.collect_list(F.struct(order, value))), lambda x: x[value].cast("string"))
    return rows.groupBy(*by).agg(F.array_join(ordered, ",").alias("values"), F.array_join(F.array_sort(F.collect_set(kept)), ",").alias("kinds"))


def optional_sums(rows: DataFrame, by: list[str], value: str) -> DataFrame:
    """The sum of a field that some rows lack, and how many have it."""
    return rows.groupBy(*by).agg(F.coalesce(F.sum(value), F.lit(0)).alias("total"), F.count(value).alias("present"))


def by_stratum_and_pooled(rows: DataFrame, stratum: str, hit: Column, pooled: str = "pooled") -> DataFrame:
    """n and hits of each stratum and of all rows."""
    return rows.rollup(stratum).agg(F.count("*").alias("n"), F.count_if(hit).alias("hits"), F.grouping(stratum).alias("g")).select(F.when(F.col("g") == 1, pooled).otherwise(F.col(stratum)).alias(stratum), "n", "hits")


def by_levels(rows: DataFrame, columns: list[str], whole: str = "all") -> DataFrame:
    """Counts for all columns, then without the last one, and so on up to the whole table."""
    sets = [columns[:k] for k in range(len(columns), -1, -1)]
    out = rows.groupingSets(sets, *columns).agg(F.count("*").alias("n"), *(F.grouping(c).alias(f"g_{c}") for c in columns))
    return out.select(*(F.when(F.col(f"g_{c}") == 1, whole).otherwise(F.col(c)).alias(c) for c in columns), "n")


# ---------------------------------------------------------------- orders and sets


def first_and_last(rows: DataFrame, by: list[str], value: str, order: str) -> DataFrame:
    return rows.groupBy(*by).agg(F.min_by(value, order).alias("first"), F.max_by(value, order).alias("last"))


def positions(rows: DataFrame, order: list[Column], out: str = "position") -> DataFrame:
    """Adds every row's place, from 1, in an order of all rows.

    Rows are range-partitioned and stored; places come from the partitions' sizes, which are one row a partition, so no task sorts all.
    """
    part, line = "_part", "_line"
    sorted_ = stored(rows.repartitionByRange(*order).sortWithinPartitions(*order).withColumn(line, F.monotonically_increasing_id()))
    sorted_ = sorted_.withColumn(part, F.shiftright(line, 33))
    sizes = sorted_.groupBy(part).agg(F.count("*").alias("c"))
    before = sizes.withColumn("_before", F.coalesce(F.sum("c").over(W.orderBy(part).rowsBetween(W.unboundedPreceding, -1)), F.lit(0))).select(part, "_before")
    place = F.col("_before") + F.col(line) - F.shiftleft(F.col(part), 33) + 1
    return sorted_.join(F.broadcast(before), part).withColumn(out, place).drop(part, line, "_before")


def numeric_then_text(id_: Column) -> list[Column]:
    """Ids that are whole numbers by value, then all others as text."""
    number = F.try_to_number(id_, F.lit("9" * 18)).cast("long")
    return [F.asc_nulls_last(number), id_.asc()]


def all_of(*parts: DataFrame, distinct: bool = False) -> DataFrame:
    """All rows of all parts, by names of columns."""
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out.distinct() if distinct else out


def common(a: DataFrame, b: DataFrame) -> DataFrame:
    """Distinct rows that both have."""
    return a.intersect(b)


def surplus(a: DataFrame, b: DataFrame) -> DataFrame:
    """Rows of a beyond those that b has, with their repeats."""
    return a.exceptAll(b)


def repeated(rows: DataFrame, key: list[str]) -> DataFrame:
    """Keys that occur more than once, and how often."""
    return counted(rows, key).where("n > 1")


def words_of(rows: DataFrame, keep: list[str], text: str) -> DataFrame:
    """A row for each word of a text with its place."""
    return rows.select(*keep, F.posexplode(F.split(text, " ")).alias("pos", "word"))


def flat_numbers(rows: DataFrame, keep: list[str], value: str) -> DataFrame:
    """A row (path, number) for each number in a JSON text, however deeply it lies; names on the way are joined by dots.

    Objects are opened level by level, as many as the texts are nested.
    """
    kind = "map<string,string>"
    level = rows.select(*keep, F.lit("").alias("path"), F.explode(F.from_json(value, kind)).alias("name", "x"))
    found = None
    for _ in range(levels(rows.select(F.col(value).alias("json")))):
        level = level.withColumn("path", F.concat_ws(".", F.when(F.col("path") != "", F.col("path")), F.col("name"))).drop("name")
        number = F.when(F.col("x").rlike(r"^-?[0-9]+(\.[0-9]+)?([eE][+-]?[0-9]+)?$"), F.col("x").cast("double"))
        here = level.select(*keep, "path", number.alias("number")).where("number is not null")
        found = here if found is None else found.unionByName(here)
        level = level.where(F.ltrim("x").startswith("{")).select(*keep, "path", F.explode(F.from_json("x", kind)).alias("name", "x"))
    return found
