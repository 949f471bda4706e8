"""Writers: JSON lines, CSV with nested cells, resumable appends, archives and reports."""

from __future__ import annotations

import io
import zipfile

from pyspark.sql import DataFrame, SparkSession, functions as F, types as T


def _file_system(spark: SparkSession, path: str):
    """(Hadoop's file system of a path, the path as it knows it)."""
    jvm = spark.sparkContext._jvm
    where = jvm.org.apache.hadoop.fs.Path(path)
    return where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), where


def exists(spark: SparkSession, path: str) -> bool:
    fs, where = _file_system(spark, path)
    return fs.exists(where)


def delete_at_exit(spark: SparkSession, path: str) -> None:
    fs, where = _file_system(spark, path)
    fs.deleteOnExit(where)


def write_bytes(spark: SparkSession, path: str, data: bytes) -> None:
    """A small file from the driver, in any store that Spark writes to; a file that is there is never overwritten."""
    fs, where = _file_system(spark, path)
    out = fs.create(where, False)
    try:
        out.write(data)
    finally:
        out.close()


def json_lines(rows: DataFrame, path: str, mode: str = "errorifexists") -> None:
    """One object a line with sorted fields; an existing folder is never overwritten by default."""
    rows.select(*sorted(rows.columns)).write.mode(mode).json(path, ignoreNullFields=False)


def csv(rows: DataFrame, path: str, fields: list[str], mode: str = "errorifexists") -> None:
    """The fields in order; nested cells become JSON."""
    nested = (T.ArrayType, T.MapType, T.StructType)
    rows.select(*(F.to_json(f).alias(f) if isinstance(rows.schema[f].dataType, nested) else F.col(f) for f in fields)).write.mode(mode).option("header", True).option("escape", '"').csv(path)


def remaining(rows: DataFrame, done: DataFrame, key: str, pinned: tuple[str, ...] = ()) -> DataFrame:
    """The rows whose key is not done; a done key whose pinned columns differ is an error."""
    if pinned:
        old = done.select(key, *(F.col(p).alias(f"__{p}") for p in pinned))
        same = F.lit(True)
        for p in pinned:
            same = same & F.col(p).eqNullSafe(F.col(f"__{p}"))
        j = rows.join(old.withColumn("__d", F.lit(True)), key, "left")
        wrong = F.when(F.col("__d") & ~same, F.raise_error(F.concat(F.lit("a finished row differs: "), F.col(key).cast("string")))).otherwise(F.lit(None).cast("string"))
        return j.where(F.col("__d").isNull() & wrong.isNull() | wrong.isNotNull()).select(*rows.columns)
    return rows.join(done.select(key), key, "left_anti")


def append_remaining(rows: DataFrame, path: str, key: str, pinned: tuple[str, ...] = ()) -> int:
    """Appends what a Parquet folder does not have yet, in one committed job; gives the number of rows written.

    Only a folder that is not there counts as empty; one that cannot be read is an error. The rows are computed once: their number is what the files' footers
    tell before and after.
    """
    spark = rows.sparkSession
    done = spark.read.parquet(path) if exists(spark, path) else spark.createDataFrame([], rows.schema)
    before = done.count()
    remaining(rows, done, key, pinned).write.mode("append").parquet(path)
    return spark.read.schema(rows.schema).parquet(path).count() - before


def _rename(spark: SparkSession, old: str, new: str) -> None:
    fs, where = _file_system(spark, old)
    if not fs.rename(where, _file_system(spark, new)[1]):
        raise OSError(f"cannot rename {old} to {new}")


def _delete(spark: SparkSession, path: str) -> None:
    fs, where = _file_system(spark, path)
    fs.delete(where, True)


def recover_log(spark: SparkSession, path: str) -> None:
    """Ends or undoes what a replace_log that died has left: the log is what it was before, or what it was to become if all of that was written."""
    fresh, old = f"{path}.fresh", f"{path}.old"
    if not exists(spark, path):
        if exists(spark, f"{fresh}/_SUCCESS"):
            _rename(spark, fresh, path)
        elif exists(spark, old):
            _rename(spark, old, path)
    _delete(spark, fresh)
    _delete(spark, old)


def replace_log(rows: DataFrame, path: str) -> None:
    """Adds rows to a log of JSON lines by writing the whole log anew beside it and renaming.

    Whatever step it dies at, the old log or the whole new one is in the folder or beside it, and the next call begins by putting it back. One
    writer at a time; for several, or for appends that do not write everything again, see sources.log.
    """
    spark = rows.sparkSession
    fresh, old = f"{path}.fresh", f"{path}.old"
    recover_log(spark, path)
    there = exists(spark, path)
    before = spark.read.schema(rows.schema).json(path) if there else None
    json_lines(rows if before is None else before.unionByName(rows), fresh)
    if there:
        _rename(spark, path, old)
    _rename(spark, fresh, path)
    _delete(spark, old)


def archive(members: dict[str, bytes]) -> bytes:
    """A ZIP with sorted members and a fixed time, the same bytes for the same content."""
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as z:
        for name in sorted(members):
            z.writestr(zipfile.ZipInfo(name, (1980, 1, 1, 0, 0, 0)), members[name], zipfile.ZIP_DEFLATED)
    return out.getvalue()


def markdown(rows: DataFrame) -> str:
    """A report table of all rows, fetched a partition at a time."""
    head = ["| " + " | ".join(rows.columns) + " |", "|" + " --- |" * len(rows.columns)]
    return "\n".join(head + ["| " + " | ".join("" if v is None else f"{v:.4f}" if isinstance(v, float) else str(v) for v in r) + " |" for r in rows.toLocalIterator()])
