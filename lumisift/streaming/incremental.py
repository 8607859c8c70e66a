"""Increments: process only what is not recorded as done, in batches or as files arrive."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..operators.windows import keep_first
from ..sources.reports import parse_reports
from ..sources.scratch import exists


def pending(listed: DataFrame, manifest: DataFrame, key: str = "path", status: str = "done") -> DataFrame:
    """Listed items whose newest manifest entry isn't done; nothing recorded counts as pending."""
    newest = keep_first(manifest, [key], [F.desc_nulls_last("recorded_at"), F.asc_nulls_last("status")])
    return listed.join(newest.filter(F.col("status") == status).select(key), key, "left_anti")


def record_run(items: DataFrame, manifest_path: str, version: str, status: str = "done", key: str = "path") -> None:
    """Append one manifest row per item: history is kept."""
    items.select(key, F.lit(status).alias("status"), F.lit(version).alias("version"), F.current_timestamp().alias("recorded_at")).write.mode("append").parquet(manifest_path)


def stale_lookups(ids: DataFrame, cache: DataFrame, now: str | F.Column, max_age_days: int = 180, key: str = "tic_id", stamp: str = "queried_at") -> DataFrame:
    """Ids without a cache entry younger than max_age_days."""
    fresh = cache.groupBy(key).agg(F.max(stamp).alias("_newest")).filter(F.col("_newest") >= (F.lit(now) if isinstance(now, str) else now).cast("timestamp") - F.expr(f"interval {max_age_days} days"))
    return ids.select(key).distinct().join(fresh, key, "left_anti")


def upsert_lookups(cache: DataFrame, answers: DataFrame, key: str = "tic_id", stamp: str = "queried_at") -> DataFrame:
    """The newest entry per id of cache and answers; ties by content."""
    both = cache.unionByName(answers)
    return keep_first(both, [key], [F.col(stamp).desc_nulls_last(), *[F.col(c).asc_nulls_last() for c in both.columns if c not in (key, stamp)]])


def cache_bucket(key: str, buckets: int) -> F.Column:
    """The bucket of a cache in which an id lies; a null id lies in one too."""
    return F.pmod(F.xxhash64(key), F.lit(buckets)).cast("int")


def upsert_cache(answers: DataFrame, path: str, *, buckets: int = 256, key: str = "tic_id", stamp: str = "queried_at") -> int:
    """Bring the answers into a stored cache; the number of buckets rewritten.

    The cache is partitioned by a hash of the id. Only the buckets that answers fall in are read, merged and
    overwritten; the files of the others stay. The number of buckets is the cache's own and must not change.
    """
    spark = answers.sparkSession
    answers = answers.withColumn("bucket", cache_bucket(key, buckets))
    touched = [r["bucket"] for r in answers.select("bucket").distinct().collect()]  # at most `buckets` numbers
    merged = answers
    if exists(spark, path):
        held = spark.read.schema(answers.schema).parquet(path).filter(F.col("bucket").isin(touched))
        merged = upsert_lookups(held, answers, key, stamp)
    else:
        merged = upsert_lookups(answers.limit(0), answers, key, stamp)
    merged.repartition(F.col("bucket")).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("bucket").parquet(path)
    return len(touched)


#: Columns of a committed folder's manifest: one row for every time a batch was written, with its counts.
MANIFEST = "batch long, attempt string, status string, version string, n_rows long, n_errors long, recorded_at timestamp"


def commit_batch(rows: DataFrame, folder: str, batch: int, version: str, *, n_errors: int = 0) -> int:
    """Write a batch to a committed folder and record it; the number of rows.

    The rows go to a place of their own for this attempt, and only then one row of the manifest names it.
    Readers join the newest entry of each batch, so a batch that is seen again replaces itself, and an attempt
    that died before its entry was written is never read. Entries are kept: they are the history of runs.
    """
    spark, attempt = rows.sparkSession, uuid.uuid4().hex
    rows.write.parquet(f"{folder}/data/batch={batch}/attempt={attempt}")
    written = spark.read.schema(rows.schema).parquet(f"{folder}/data/batch={batch}/attempt={attempt}").count()  # from footers
    entry = spark.createDataFrame([(batch, attempt, "done", version, written, n_errors)], MANIFEST.rsplit(",", 1)[0])
    entry.coalesce(1).withColumn("recorded_at", F.current_timestamp()).write.mode("append").parquet(f"{folder}/manifest")
    return written


def run_history(spark: SparkSession, folder: str) -> DataFrame:
    """Every attempt of every batch of a committed folder, with its counts, version and whether it is the one that readers see."""
    if not exists(spark, f"{folder}/manifest"):
        return spark.createDataFrame([], f"{MANIFEST}, current boolean")
    entries = spark.read.schema(MANIFEST).parquet(f"{folder}/manifest")
    newest = entries.groupBy("batch").agg(F.max(F.struct("recorded_at", "attempt")).alias("x")).select(F.col("batch").alias("_b"), F.col("x.attempt").alias("_a"))
    # One row per attempt: small beside the data, and joined, not collected.
    return entries.join(newest, (F.col("batch") == F.col("_b")) & (F.col("attempt") == F.col("_a")), "left").withColumn("current", F.col("_a").isNotNull()).drop("_b", "_a")


def read_committed(spark: SparkSession, folder: str, schema: str) -> DataFrame:
    """The rows of each batch's newest attempt, with their batch; an empty table where nothing was committed.

    Partitions of other attempts are pruned by the join with the manifest.
    """
    current = run_history(spark, folder).filter("current").select("batch", "attempt")
    if not exists(spark, f"{folder}/data"):
        return spark.createDataFrame([], f"{schema}, batch long")
    data = spark.read.schema(f"{schema}, batch long, attempt string").parquet(f"{folder}/data")
    return data.join(current, ["batch", "attempt"], "left_semi").drop("attempt")


def stream_files(spark: SparkSession, source: str, schema: str, folder: str, checkpoint: str, version: str, *, fmt: str = "parquet", change: Callable[[DataFrame], DataFrame] | None = None, files_per_trigger: int = 10_000) -> StreamingQuery:
    """Commit files that have arrived since the last run to a committed folder, then stop; exactly once, also where a batch is replayed."""
    files = spark.readStream.format(fmt).schema(schema).option("maxFilesPerTrigger", str(files_per_trigger)).load(source)

    def batch(rows: DataFrame, batch_id: int) -> None:
        commit_batch(change(rows) if change else rows, folder, batch_id, version)

    return files.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def committed_reports(folder: str, version: str) -> Callable[[DataFrame, DataFrame, int], None]:
    """A sink for `stream_reports`: signals to `folder`, errors and rejects to `folder`/errors, both by batch."""

    def sink(signals: DataFrame, errors: DataFrame, batch_id: int) -> None:
        n_errors = commit_batch(errors, f"{folder}/errors", batch_id, version)
        commit_batch(signals, f"{folder}/signals", batch_id, version, n_errors=n_errors)

    return sink


def stream_reports(spark: SparkSession, folder: str, sink: Callable[[DataFrame, DataFrame, int], None], checkpoint: str, *, files_per_trigger: int = 10_000) -> StreamingQuery:
    """Parse report files that have arrived since the last run, then stop; the checkpoint is the manifest of files.

    sink(signals, errors, batch_id) may see a batch again after a failure; `committed_reports` makes a sink that then replaces it.
    """
    files = spark.readStream.format("text").option("wholetext", "true").option("recursiveFileLookup", "true").option("pathGlobFilter", "*.xml").option("maxFilesPerTrigger", str(files_per_trigger)).load(folder)
    texts = files.select(F.col("_metadata.file_path").alias("path"), "value")

    def batch(rows: DataFrame, batch_id: int) -> None:
        rows = rows.persist()
        parsed = parse_reports(rows)
        sink(parsed.signals, parsed.file_errors.unionByName(parsed.rejects, allowMissingColumns=True), batch_id)
        rows.unpersist()

    return texts.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
