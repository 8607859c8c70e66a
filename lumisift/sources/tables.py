"""Parquet, CSV and score tables, and thresholds kept as column metadata."""

from __future__ import annotations

import warnings
from collections.abc import Iterator
from typing import Any

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from ..functions.nulls import nan_to_null
from ..operators.select import work_list
from .scratch import exists

#: The metadata entry under which a sample keeps its thresholds.
THRESHOLDS = "thresholds"


def read_sectors(spark: SparkSession, folder: str, pattern: str = "tce_dv_metrics_*.parquet") -> DataFrame:
    """All parsed sectors of a folder, columns by name."""
    return nan_to_null(spark.read.option("mergeSchema", "true").parquet(f"{folder.rstrip('/')}/{pattern}"))


def read_tolerant(spark: SparkSession, paths: list[str], schema: StructType | str) -> DataFrame:
    """Files that can be read, under a known schema; unreadable or missing ones are skipped, and none gives an empty table.

    Missing ones are named in a warning; `skipped_files` names the unreadable ones.
    """
    missing = _missing(spark, paths)
    if missing:
        warnings.warn(f"skipped, missing: {', '.join(missing)}", stacklevel=2)
    paths = [p for p in paths if p not in set(missing)]
    if not paths:
        return spark.createDataFrame([], schema)
    return spark.read.schema(schema).options(**_TOLERANT).parquet(*paths)


#: Options of a scan that goes on where a file can't be read.
_TOLERANT = {"ignoreCorruptFiles": "true", "ignoreMissingFiles": "true"}
def _missing(spark: SparkSession, paths: list[str]) -> list[str]:
    return [p for p in paths if "*" not in p and not exists(spark, p)]


def skipped_files(spark: SparkSession, paths: list[str], schema: StructType | str, *, deep: bool = False, probe_bytes: int = 64 << 20) -> DataFrame:
    """(path, length, reason) of every file that `read_tolerant` of the same arguments skips.

    Files are listed without their content, and tasks attempt a read of each: of its footer alone, which says
    how many rows there are, or with deep=True of all columns of the schema. Files that give no row are opened
    on their own, if they hold at most probe_bytes, to tell an empty table, which is not skipped, from a broken
    file: a folder's at once where none of its files gives a row. With deep=True a file whose columns give fewer rows than its footer says, because a page is broken
    or a type doesn't fit, is named too. Files of no bytes are not listed by Spark, and not named. The driver sees
    the folders of files without rows, and their names where others of the folder have rows.
    """
    missing = _missing(spark, paths)
    gone = spark.createDataFrame([(p, None, "missing") for p in missing], "path string, length long, reason string")
    paths = [p for p in paths if p not in set(missing)]
    if not paths:
        return gone
    at = F.col("_metadata.file_path").alias("at")
    rows = spark.read.schema(schema).options(**_TOLERANT).parquet(*paths)
    listed = spark.read.format("binaryFile").load(paths).select("path", "length", at)
    out = listed.join(rows.select(at).groupBy("at").agg(F.count(F.lit(1)).alias("rows")), "at", "left")
    short = F.col("length") <= probe_bytes
    silent = out.filter("rows is null")
    named = gone.unionByName(silent.filter(~short).select("path", "length", F.lit("no rows, too long to open").alias("reason")))
    folder = F.regexp_replace("path", "/[^/]*$", "")
    folders = out.groupBy(folder.alias("folder")).agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("rows").isNull() & short).alias("n_silent")).filter("n_silent > 0").collect()
    # A folder of silent files alone is listed as one; else each file named is listed by a task of its own.
    opened_at = [r["folder"] for r in folders if r["n"] == r["n_silent"]]
    mixed = [r["folder"] for r in folders if r["n"] > r["n_silent"]]
    if mixed:
        opened_at += [r["path"] for r in silent.filter(short & folder.isin(mixed)).select("path").collect()]
    if opened_at:
        files = spark.read.format("binaryFile").load(opened_at, recursiveFileLookup=True).filter(short).select("path", "length", "content")
        opened = files.join(silent.select("path"), "path", "left_semi").mapInPandas(_opened, "path string, length long, reason string").filter("reason is not null")
        named = named.unionByName(opened)
    if deep:
        # A digest of every column that the count depends on, so that none is pruned from the attempt.
        digest = F.xxhash64(*[F.col(f"`{c}`") for c in rows.columns]).alias("digest")
        tried = rows.select(at, digest).groupBy("at").agg(F.when(F.bit_xor("digest").isNotNull(), F.count(F.lit(1))).alias("read"))
        broken = out.join(tried, "at", "left").filter(F.coalesce("read", F.lit(0)) < F.col("rows"))
        named = named.unionByName(broken.select("path", "length", F.lit("columns that can't be read").alias("reason")))
    return named


def _opened(files: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Why each file of (path, length, content) gives no row; null for a table without rows."""
    import pyarrow as pa
    import pyarrow.parquet as pq

    def why(content: bytes) -> str | None:
        if content[-4:] != b"PAR1" or content[:4] != b"PAR1":
            return "not a Parquet file"
        try:
            return "rows that don't fit the schema" if pq.ParquetFile(pa.BufferReader(content)).metadata.num_rows else None
        except (pa.ArrowException, OSError):
            return "a footer that can't be read"

    for part in files:
        yield part[["path", "length"]].assign(reason=[why(bytes(c)) for c in part["content"]])


def _csv(spark: SparkSession, path: str, schema: StructType | str | None, **options: Any) -> DataFrame:
    return spark.read.csv(path, header=True, schema=schema, inferSchema=schema is None, **options)


def read_table(spark: SparkSession, path: str, schema: StructType | str | None = None) -> DataFrame:
    """CSV by suffix, else Parquet. Without a schema, a CSV is read once more to find its types."""
    return _csv(spark, path, schema) if path.endswith(".csv") else spark.read.parquet(path)


#: A line up to its first # outside quotes; a doubled quote inside quotes stays inside.
_BEFORE_COMMENT = r'^(?:[^"#]|"[^"]*"?)*'


def without_comments(lines: DataFrame, text_col: str = "value") -> DataFrame:
    """Lines cut at their first # outside quotes; those that hold nothing else are left out."""
    kept = F.rtrim(F.regexp_extract(text_col, _BEFORE_COMMENT, 0))
    return lines.withColumn(text_col, kept).filter(F.col(text_col) != "")


def parse_predictions(lines: DataFrame, header: str, schema: StructType | str, text_col: str = "value") -> DataFrame:
    """Rows of comma-separated lines under a schema by the header's names; lines equal to the header are none, and a field that doesn't fit is null."""
    kinds = StructType.fromDDL(schema) if isinstance(schema, str) else schema
    names = [n.strip().strip('"') for n in header.split(",")]
    texts = ", ".join(f"`{n}` string" for n in names)
    rows = lines.filter(F.col(text_col) != header).select(F.from_csv(text_col, texts).alias("x")).select("x.*")
    have = {f.name: f.dataType for f in kinds if f.name in names}
    return nan_to_null(rows.select(*[F.col(f"`{n}`").try_cast(kind).alias(n) for n, kind in have.items()]))


def read_predictions(spark: SparkSession, path: str, schema: StructType | str | None = None) -> DataFrame:
    """A CSV of external scores with comments: a # outside quotes ends its line, and lines of comment alone are none.

    The first line that is left is the header. Without a schema, types are found from all rows.
    """
    lines = without_comments(spark.read.text(path))
    first = lines.limit(1).collect()
    if not first:
        return spark.createDataFrame([], schema or "target_id long")
    header = first[0]["value"]
    if schema is None:
        names = [n.strip().strip('"') for n in header.split(",")]
        texts = parse_predictions(lines, header, ", ".join(f"`{n}` string" for n in names))
        blank = lambda n: F.nullif(F.trim(F.col(f"`{n}`")), F.lit(""))
        fits = texts.agg(*[F.struct(F.bool_and(blank(n).isNull() | blank(n).try_cast("long").isNotNull()).alias("long"), F.bool_and(blank(n).isNull() | blank(n).try_cast("double").isNotNull()).alias("double")).alias(n) for n in names]).first()
        schema = ", ".join(f"`{n}` {'bigint' if fits[n]['long'] else 'double' if fits[n]['double'] else 'string'}" for n in names)
    return parse_predictions(lines, header, schema)


def with_thresholds(df: DataFrame, config: dict[str, Any], column: str = "any_diagnostic_flag") -> DataFrame:
    """Attach the thresholds to a column's metadata; Parquet keeps it."""
    kept = {THRESHOLDS: {k: config.get(k, {}) for k in ("diagnostics", "stellar_cuts")}}
    return df.withColumn(column, F.col(column).alias(column, metadata=kept))


def write_sample(df: DataFrame, path: str, config: dict[str, Any], column: str = "any_diagnostic_flag") -> None:
    with_thresholds(df, config, column).write.mode("overwrite").parquet(path)


def write_bucketed(df: DataFrame, table: str, path: str, *, buckets: int, key: str = "tic_id") -> None:
    """Write a table bucketed and sorted by a key, one file a bucket, so that joins, windows and aggregates by that key read it without an exchange.

    Tables that meet in a join need the same number of buckets. The layout is in the session's catalog;
    `attach_bucketed` names it there again where the catalog doesn't outlive the session.
    """
    dealt = df.repartition(buckets, F.col(key))
    dealt.write.bucketBy(buckets, key).sortBy(key).mode("overwrite").option("path", path).saveAsTable(table)


def attach_bucketed(spark: SparkSession, table: str, path: str, schema: StructType, *, buckets: int, key: str = "tic_id") -> DataFrame:
    """A table that write_bucketed has written to `path`, in a catalog that doesn't know it yet."""
    columns = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in schema.fields)
    spark.sql(f"CREATE TABLE IF NOT EXISTS {table} ({columns}) USING parquet OPTIONS (path '{path}') CLUSTERED BY ({key}) SORTED BY ({key}) INTO {buckets} BUCKETS")
    return spark.table(table)


def read_thresholds(df: DataFrame, column: str = "any_diagnostic_flag") -> dict[str, Any]:
    """The thresholds a sample was built with; {} if it has none."""
    return df.schema[column].metadata.get(THRESHOLDS, {}) if column in df.columns else {}


def write_work_list(rows: DataFrame, path: str | None, sector_col: str = "sector") -> DataFrame:
    """Distinct (tic_id, sector_run) as CSV for an external scorer; returned too."""
    out = work_list(rows, sector_col)
    if path is not None:
        out.write.mode("overwrite").csv(path, header=True)
    return out
