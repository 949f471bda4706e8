"""Hashes that prove what a result was made from."""

from __future__ import annotations

import hashlib
import json

from pyspark.sql import Column, DataFrame, SparkSession, functions as F, types as T


def canonical_hash(**fields: Column) -> Column:
    """SHA-256 of the fields as JSON with sorted names; nulls are kept. For ordinary text it equals exact_hash."""
    ordered = F.struct(*(fields[k].alias(k) for k in sorted(fields)))
    return F.sha2(F.to_json(ordered, {"ignoreNullFields": "false"}), 256)


def exact_hash(value: Column) -> Column:
    """SHA-256 of a JSON text in canonical form, byte for byte as json.dumps writes it (for control characters and nested values)."""

    @F.pandas_udf(T.StringType())
    def f(s):
        return s.map(lambda x: None if x is None else hashlib.sha256(json.dumps(json.loads(x), sort_keys=True, ensure_ascii=False, separators=(",", ":")).encode()).hexdigest())

    return f(value)


def self_hash_valid(own: Column, **fields: Column) -> Column:
    """Whether a record's own hash is that of its other fields; a record without one is not valid."""
    return F.coalesce(own == canonical_hash(**fields), F.lit(False))


def profile_fingerprint(profile: Column) -> Column:
    """SHA-256 of a profile's JSON in canonical form; numbers that JSON does not know are an error."""

    @F.pandas_udf(T.StringType())
    def f(s):
        def one(x):
            data = json.loads(x)
            return hashlib.sha256(json.dumps(data, sort_keys=True, ensure_ascii=False, separators=(",", ":"), allow_nan=False).encode()).hexdigest()

        return s.map(lambda x: None if x is None else one(x))

    return f(profile)


def file_hashes(spark: SparkSession, path: str, pattern: str = "*") -> DataFrame:
    """path, length, sha256 of every file below a folder."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", pattern).load(path)
    return files.select("path", "length", F.sha2("content", 256).alias("sha256"))


def locked(found: DataFrame, expected: DataFrame) -> DataFrame:
    """Files whose hash differs from the manifest's or that are on one side only; empty if all is as expected."""
    both = found.select("path", "sha256").join(expected.select("path", F.col("sha256").alias("want")), "path", "full")
    return both.where(~F.col("sha256").eqNullSafe(F.col("want")))


def write_manifest(spark: SparkSession, path: str, out: str, pattern: str = "*") -> DataFrame:
    """Writes path, length and sha256 of every file below a folder as JSON lines, and gives them as written; `out` must be new."""
    file_hashes(spark, path, pattern).write.mode("errorifexists").json(out)
    return spark.read.schema("path string, length long, sha256 string").json(out)


def table_digest(rows: DataFrame) -> str:
    """A digest of a table's rows in any order: their number, and two sums of SHA-256 of each row's JSON (columns by name); one row leaves the tasks."""
    row = F.sha2(F.to_json(F.struct(*(F.col(f"`{c}`") for c in sorted(rows.columns))), {"ignoreNullFields": "false"}), 256)
    part = lambda at: F.coalesce(F.sum(F.conv(F.substring(row, at, 15), 16, 10).cast("decimal(38,0)")), F.lit(0)).cast("string")
    found = rows.agg(F.count("*").cast("string").alias("n"), part(1).alias("a"), part(16).alias("b")).first()
    return hashlib.sha256("|".join(found).encode()).hexdigest()
