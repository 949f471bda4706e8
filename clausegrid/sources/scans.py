"""Readers of clause corpora, gold sets, rewrites, profiles, registries, worksheets, archives and logs."""

from __future__ import annotations

import csv
import hashlib
import io
import json
import re
import zipfile
from xml.etree import ElementTree

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window as W, functions as F, types as T

from clausegrid.sources.schemas import CALL, CLAUSE, CONTEXT, REWRITE
from clausegrid.sources.sinks import exists

try:
    import yaml
except ImportError:  # profiles are then read line by line
    yaml = None


def clauses(spark: SparkSession, path: str, kinds: tuple[str, ...] | None = ("smt", "gdn")) -> DataFrame:
    """Clause records of JSON lines with an id and a text, of some kinds (None: all)."""
    rows = spark.read.schema(CLAUSE).json(path).where((F.trim("text") != "") & (F.trim("id") != ""))
    return rows if kinds is None else rows.where(F.lower(F.trim("kind")).isin(*kinds))


def inventory(spark: SparkSession, path: str, key: str = "id", order: str = "_ord") -> DataFrame:
    """All records, one for each id: the one that comes last in `order`, a column the file carries."""
    rows = spark.read.schema(T.StructType([*CLAUSE.fields, T.StructField(order, T.LongType())])).json(path)
    fields = [c for c in rows.columns if c != key]
    return rows.groupBy(key).agg(F.max_by(F.struct(*fields), order).alias("r")).select(key, *(F.col(f"r.{c}").alias(c) for c in fields))


def unique(rows: DataFrame, key: str = "id") -> DataFrame:
    """The rows unchanged; a missing or repeated key is an error."""
    n = F.count("*").over(W.partitionBy(key))
    bad = F.col(key).isNull() | (F.trim(F.col(key).cast("string")) == "") | (n > 1)
    return rows.withColumn("__e", F.when(bad, F.raise_error(F.concat(F.lit("missing or repeated key: "), F.coalesce(F.col(key).cast("string"), F.lit("null"))))).otherwise(F.lit(None).cast("string"))).where(F.col("__e").isNull()).drop("__e")


def edges(rows: DataFrame) -> DataFrame:
    """parent, id, label of every record with a parent."""
    return rows.where(F.coalesce(F.trim("parent_part_id"), F.lit("")) != "").select(F.col("parent_part_id").alias("parent"), "id", F.coalesce("label", F.lit("")).alias("label"))


def encoding_of(spark: SparkSession, path: str) -> str:
    """UTF-8 if every line of the files is, else Latin-1."""
    return "ISO-8859-1" if spark.read.text(path).where(~F.is_valid_utf8("value")).limit(1).count() else "UTF-8"


def gold(spark: SparkSession, path: str, encoding: str | None = None) -> DataFrame:
    """A gold CSV with quoted line breaks; the id is the first of query_id, ID and id that is there.

    Without an encoding it is UTF-8, or Latin-1 where the bytes are no UTF-8.
    """
    encoding = encoding or encoding_of(spark, path)
    rows = spark.read.option("header", True).option("multiLine", True).option("escape", '"').option("encoding", encoding).csv(path)
    rows = rows.toDF(*(c.lstrip("﻿").strip() for c in rows.columns))
    known = [c for name in ("query_id", "ID", "id") for c in rows.columns if c == name]
    if not known:
        raise ValueError("no id column")
    return rows.withColumn("query_key", F.coalesce(*(F.col(f"`{c}`") for c in known)))


def aliased(rows: DataFrame, names: dict[str, tuple[str, ...]]) -> DataFrame:
    """Renames the first variant that is there to each canonical name."""
    for to, variants in names.items():
        if to not in rows.columns:
            found = next((v for v in variants if v in rows.columns), None)
            rows = rows.withColumnRenamed(found, to) if found else rows
    return rows


def rewrites(spark: SparkSession, path: str) -> DataFrame:
    """query_id, rewrites: the rewritten queries of each query by rank."""
    rows = spark.read.schema(REWRITE).option("header", True).option("multiLine", True).option("escape", '"').csv(path)
    listed = rows.groupBy("query_id").agg(F.array_sort(F.collect_list(F.struct("rewrite_rank", "rewritten_query"))).alias("r"))
    return listed.select("query_id", F.transform("r", lambda x: x["rewritten_query"]).alias("rewrites"))


def profile_values(text: str) -> list[tuple[str, str]]:
    """The parameter values of a profile: those below odp_values or odps, else those of the top level; none of a bad file."""
    try:
        data = json.loads(text)
    except ValueError:
        data = _yaml(text)
    if not isinstance(data, dict):
        return []
    inner = next((data[k] for k in ("odp_values", "odps") if isinstance(data.get(k), dict)), data)
    return [(str(k), str(v)) for k, v in inner.items() if isinstance(v, (str, int, float, bool))]


def _yaml(text: str):
    """A YAML document; without the library, `key: value` lines and one level of nesting."""
    if yaml is not None:
        try:
            return yaml.safe_load(text)
        except yaml.YAMLError:
            return None
    out: dict = {}
    inner: dict | None = None
    for line in text.splitlines():
        m = re.match(r"(\s*)([A-Za-z0-9_.-]+)\s*:\s*(?:\"([^\"]*)\"|'([^']*)'|([^#]*?))\s*(?:#.*)?$", line)
        if not m:
            continue
        value = next(x for x in m.groups()[2:] if x is not None)
        if not m[1] and not value:
            inner = out[m[2]] = {}
        elif m[1] and inner is not None:
            inner[m[2]] = value
        else:
            out[m[2]] = value
    return out


def profile(spark: SparkSession, path: str) -> DataFrame:
    """param, value of flat or nested organization profiles (YAML or JSON), read where the files are; empty if there is none."""
    schema = "param string, value string"
    if not exists(spark, path):
        return spark.createDataFrame([], schema)

    def read(batches):
        for pdf in batches:
            yield pd.DataFrame([x for data in pdf["content"] for x in profile_values(bytes(data).decode("utf-8", "replace"))], columns=["param", "value"])

    return spark.read.format("binaryFile").load(path).select("content").mapInPandas(read, schema)


def registry(spark: SparkSession, path: str, sha256: str | None) -> DataFrame:
    """A parameter registry; with a hash the file must match it, without one a missing file is an empty registry."""
    schema = "param_id string, friendly_label string, raw_marker string, ask_prompt string, data_type string, cardinality string"
    there = exists(spark, path)
    if sha256:
        found = spark.read.format("binaryFile").load(path).select(F.sha2("content", 256).alias("h")).take(1) if there else []
        if not found or found[0]["h"] != sha256:
            raise ValueError("the registry differs from the expected one")
    return spark.read.schema(schema).json(path) if there else spark.createDataFrame([], schema)


def call_log(spark: SparkSession, path: str, version: str) -> DataFrame:
    """An append-only log; another schema version or a repeated response_id is an error."""
    rows = spark.read.schema(CALL).json(path)
    wrong = F.when(~F.col("schema_version").eqNullSafe(F.lit(version)), F.raise_error(F.lit("unexpected schema version"))).otherwise(F.lit(None).cast("string"))
    return unique(rows.where(F.coalesce(wrong, F.lit("")) == ""), "response_id")


def contexts(spark: SparkSession, path: str) -> DataFrame:
    """Prepared contexts with `valid`: the recorded hash equals that of the row without it, byte for byte."""

    @F.pandas_udf(T.BooleanType())
    def valid(lines: pd.Series) -> pd.Series:
        def one(x):
            row = json.loads(x)
            want = row.pop("context_sha256", None)
            return hashlib.sha256(json.dumps(row, sort_keys=True, ensure_ascii=False, separators=(",", ":")).encode()).hexdigest() == want

        return lines.map(one)

    lines = spark.read.text(path).where(F.trim("value") != "")
    return lines.select(F.from_json("value", CONTEXT).alias("r"), valid("value").alias("valid")).select("r.*", "valid")


def zip_members(spark: SparkSession, path: str, member: str) -> DataFrame:
    """path, member, line_no, line of the text members of archives that match a pattern."""

    def read(batches):
        for pdf in batches:
            out = []
            for p, data in zip(pdf["path"], pdf["content"]):
                with zipfile.ZipFile(io.BytesIO(data)) as z:
                    for name in sorted(z.namelist()):
                        if re.search(member, name):
                            out += [(p, name, k, line) for k, line in enumerate(z.read(name).decode().splitlines())]
            yield pd.DataFrame(out, columns=["path", "member", "line_no", "line"])

    return spark.read.format("binaryFile").load(path).select("path", "content").mapInPandas(read, "path string, member string, line_no long, line string")


def worksheet(data: bytes, sheet: str = "xl/worksheets/sheet1.xml") -> list[list[str]]:
    """Rows of a worksheet with shared and inline strings; a formula is an error."""
    with zipfile.ZipFile(io.BytesIO(data)) as z:
        tag = lambda e: e.tag.rpartition("}")[2]
        text = lambda e: "".join(t.text or "" for t in e.iter() if tag(t) == "t")
        shared = [text(e) for e in ElementTree.fromstring(z.read("xl/sharedStrings.xml")) if tag(e) == "si"] if "xl/sharedStrings.xml" in z.namelist() else []
        out = []
        for row in (e for e in ElementTree.fromstring(z.read(sheet)).iter() if tag(e) == "row"):
            cells: dict[int, str] = {}
            for c in row:
                parts = {tag(e): e for e in c}
                if "f" in parts:
                    raise ValueError(f"formula in cell {c.get('r')}")
                letters = re.match(r"[A-Z]+", c.get("r", "A"))[0]
                at = 0
                for x in letters:
                    at = at * 26 + ord(x) - 64
                value = parts["v"].text or "" if "v" in parts else text(parts["is"]) if "is" in parts else ""
                cells[at - 1] = shared[int(value)] if c.get("t") == "s" and value else value
            out.append([cells.get(k, "") for k in range(max(cells, default=-1) + 1)])
        return out


def worksheets(spark: SparkSession, path: str) -> DataFrame:
    """path, row, cells of every worksheet file."""

    def read(batches):
        for pdf in batches:
            yield pd.DataFrame([(p, k, r) for p, data in zip(pdf["path"], pdf["content"]) for k, r in enumerate(worksheet(data))], columns=["path", "row", "cells"])

    return spark.read.format("binaryFile").load(path).select("path", "content").mapInPandas(read, "path string, row long, cells array<string>")


def files(spark: SparkSession, path: str, pattern: str = "*.jsonl") -> DataFrame:
    """path, length of every file below a folder with a matching name."""
    return spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", pattern).load(path).select("path", "length")


def validate_json(data: bytes, lines: bool) -> tuple[int, list[str], list[str]]:
    """(records, errors, warnings) of one file under strict JSON rules."""
    errors, warnings, rows = [], [], 0
    if data[:3] == b"\xef\xbb\xbf":
        warnings.append("byte order mark")
        data = data[3:]
    try:
        text = data.decode("utf-8")
    except UnicodeDecodeError:
        return 0, ["not UTF-8"], warnings
    if not text.strip():
        return 0, ["empty"], warnings

    def pairs(items):
        seen = set()
        for k, _ in items:
            if k in seen:
                raise ValueError(f"duplicate key {k}")
            seen.add(k)
        return dict(items)

    def constant(x):
        raise ValueError(f"constant {x}")

    if lines and text and not text.endswith("\n"):
        warnings.append("no final newline")
    for k, part in enumerate(text.removesuffix("\n").split("\n") if lines else [text], 1):
        if lines and not part.strip():
            errors.append(f"line {k}: blank")
            continue
        try:
            value = json.loads(part, object_pairs_hook=pairs, parse_constant=constant)
            if lines and not isinstance(value, dict):
                raise ValueError("not an object")
            rows += 1
        except ValueError as e:
            errors.append(f"line {k}: {str(e).partition(': line')[0]}")
    return rows, errors, warnings


def validated(spark: SparkSession, path: str, pattern: str = "*.json*") -> DataFrame:
    """path, kind, rows, errors, warnings of every JSON file below a folder."""

    def read(batches):
        for pdf in batches:
            out = []
            for p, data in zip(pdf["path"], pdf["content"]):
                kind = "jsonl" if p.endswith("l") else "json"
                out.append((p, kind, *validate_json(bytes(data), kind == "jsonl")))
            yield pd.DataFrame(out, columns=["path", "kind", "rows", "errors", "warnings"])

    found = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", pattern).load(path)
    return found.select("path", "content").mapInPandas(read, "path string, kind string, rows long, errors array<string>, warnings array<string>")


def first_object(text: str | None, starts: int = 50) -> str | None:
    """The first balanced JSON object in a text, as it stands there; strings may hold braces."""
    text, at = text or "", -1
    decoder = json.JSONDecoder()
    for _ in range(starts):
        at = text.find("{", at + 1)
        if at < 0:
            return None
        try:
            value, end = decoder.raw_decode(text, at)
        except ValueError:
            continue
        if isinstance(value, dict):
            return text[at:end]
    return None


def first_objects(x):
    """Column form of first_object."""

    @F.pandas_udf(T.StringType())
    def f(s: pd.Series) -> pd.Series:
        return s.map(first_object)

    return f(x)


def csv_text(rows: list[dict], fields: list[str]) -> str:
    """A small table as CSV text with a fixed order of fields."""
    out = io.StringIO()
    w = csv.DictWriter(out, fields, extrasaction="ignore", lineterminator="\n")
    w.writeheader()
    w.writerows(rows)
    return out.getvalue()
