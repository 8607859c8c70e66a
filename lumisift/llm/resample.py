"""Target-distribution importance resampling over hashed n-grams, found by one overlapped regex scan.

Separators collapse to single spaces; then one pattern with lookarounds at word boundaries runs through
the text with overlapping matches, and every match opens at a word and captures the words of the
n-grams that start there. Each captured span continues the CRC of the span before it, so an n-gram's
checksum is had without cutting its text out. Checksums fall into buckets; a bucket's gain compares how
often the target and the corpus hit it, a document's weight is the mean gain of its features, and Gumbel
noise from a seeded digest of its id makes the highest scores a draw without replacement.

Texts are scanned once; what is written are bucket numbers. Counts are summed per task before they are
shuffled, and the only thing that reaches the driver is one gain per bucket (their number is a
parameter). Ranks come from range partitions that are numbered one by one, so no task holds all rows.

Nulls and edges: null, empty and wordless texts have no feature, weight 0, and are drawn only if
`least_words` is 0; texts of any length are scanned whole, in memory that a few bytes a word bound;
repeated rows are ranked one by one; equal scores go by the smaller id, null ids last; a null id has the
noise of an empty id; an empty table gives an empty result, an empty target leaves every gain to the
corpus; other columns, whatever their names, are left behind by the scores and kept by `resample`.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import words as W
from .shared import materialize, table


@dataclass(frozen=True)
class ResampleSettings:
    max_words: int = 2
    buckets: int = 10_000
    percent: int = 25
    least_words: int = 20
    seed: int = 7


#: What is left of a byte: A-Z in lower case, letters, digits and bytes above 0x7F as they are, else a space.
_KEPT = bytes(b if b >= 0x80 or 0x30 <= b <= 0x39 or 0x61 <= b <= 0x7A else b + 32 if 0x41 <= b <= 0x5A else 0x20 for b in range(256))


def collapse(text: bytes) -> bytes:
    """The words of a text with one space between them."""
    return b" ".join(text.translate(_KEPT).split())


def ngram_pattern(max_words: int) -> regex.Pattern:
    """Matches at every word; group n is the n-th word from there, with the space before it."""
    more = b""
    for _ in range(max_words - 1):
        more = rb"(?:( [^ ]+)" + more + rb")?"
    return regex.compile(rb"(?<![^ ])([^ ]+)" + more + rb"(?![^ ])")


def ngram_spans(clean: bytes, max_words: int) -> Iterator[tuple[int, int]]:
    """(start, end) of every run of 1 to max_words words of a collapsed text, shorter runs first at each word."""
    for m in ngram_pattern(max_words).finditer(clean, overlapped=True):
        for n in range(1, max_words + 1):
            if m.end(n) >= 0:
                yield m.start(), m.end(n)


def feature_buckets(clean: bytes, pattern: regex.Pattern, buckets: int) -> Iterator[int]:
    """The bucket of each span that ngram_spans() gives, its CRC carried on from the shorter span."""
    crc = zlib.crc32
    for m in pattern.finditer(clean, overlapped=True):
        code = 0
        for word in m.groups():
            if word is None:
                break
            code = crc(word, code)
            yield code % buckets


def _number(settings: ResampleSettings) -> type:
    return np.uint16 if settings.buckets <= 1 << 16 else np.uint32


def scan(docs: DataFrame, settings: ResampleSettings, keep: list[str], text_col: str = "text") -> DataFrame:
    """(row struct of the columns `keep`, n_words, n_features, features binary: bucket numbers in order)."""
    number, pattern = _number(settings), ngram_pattern(settings.max_words)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in W.small_batches(batches, "_text"):
            n_words, found = [], []
            for text in W.as_bytes(batch.column("_text")):
                clean = collapse(text)
                n_words.append(clean.count(b" ") + 1 if clean else 0)
                found.append(np.fromiter(feature_buckets(clean, pattern, settings.buckets), number))
            yield pa.RecordBatch.from_arrays(
                [batch.column("row"), pa.array(n_words, pa.int64()), pa.array([len(f) for f in found], pa.int64()), pa.array([f.tobytes() for f in found], pa.binary())],
                names=["row", "n_words", "n_features", "features"])

    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in keep]).alias("row"), F.col(text_col).cast("binary").alias("_text"))
    return rows.mapInArrow(run, f"row {rows.schema['row'].dataType.simpleString()}, n_words long, n_features long, features binary")


def bucket_counts(scanned: DataFrame, settings: ResampleSettings) -> DataFrame:
    """(bucket, n): how often each bucket that occurs is hit, summed per task first."""
    number = _number(settings)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums = np.zeros(settings.buckets, np.int64)
        for batch in batches:
            for part in batch.column(0).to_pylist():
                sums += np.bincount(np.frombuffer(part, number), minlength=settings.buckets)
        hit = np.flatnonzero(sums)
        yield pa.RecordBatch.from_arrays([pa.array(hit, pa.int64()), pa.array(sums[hit])], names=["bucket", "n"])

    return scanned.select("features").mapInArrow(run, "bucket long, n long").groupBy("bucket").agg(F.sum("n").alias("n"))


def bucket_gains(corpus: DataFrame, target: DataFrame, settings: ResampleSettings) -> np.ndarray:
    """Floored 1000 * ln of how much more the target hits each bucket than the corpus; both: (bucket, n)."""
    b = settings.buckets
    total = lambda df: F.coalesce(df.agg(F.sum("n")).scalar(), F.lit(0)).cast("double") + b
    plus_one = lambda name: F.coalesce(name, F.lit(0)).cast("double") + 1
    both = corpus.withColumnRenamed("n", "s").join(target.withColumnRenamed("n", "t"), "bucket", "full")
    ratio = plus_one("t") * total(corpus) / (plus_one("s") * total(target))
    gains = np.zeros(b, np.int64)
    for bucket, gain in both.select("bucket", F.floor(1000 * F.log(ratio)).cast("long")).collect():  # at most one row per bucket
        gains[bucket] = gain
    return gains


def importance_scores(docs: DataFrame, target: DataFrame, settings: ResampleSettings | None = None, keep: list[str] | None = None) -> DataFrame:
    """(row, n_words, n_features, weight, score) per row of docs; row holds the columns `keep`, doc_id among them."""
    settings = settings or ResampleSettings()
    number = _number(settings)
    scanned = materialize(scan(docs, settings, keep or ["doc_id"]), "resample-features")
    corpus = materialize(bucket_counts(scanned, settings), "resample-corpus")
    wanted = materialize(bucket_counts(scan(target.select("text"), settings, ["text"]), settings), "resample-target")
    gains = bucket_gains(corpus, wanted, settings)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sums = [int(gains[np.frombuffer(part, number)].sum()) for part in batch.column("features").to_pylist()]
            weight = [s // n if n else 0 for s, n in zip(sums, batch.column("n_features").to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays([*map(batch.column, ("row", "n_words", "n_features")), pa.array(weight, pa.int64())], names=["row", "n_words", "n_features", "weight"])

    kind = scanned.schema["row"].dataType.simpleString()
    weighed = scanned.mapInArrow(run, f"row {kind}, n_words long, n_features long, weight long")
    digest = F.sha2(F.concat(F.lit(f"{settings.seed}:"), F.coalesce(F.col("row.doc_id").cast("string"), F.lit(""))), 256)
    h = F.conv(F.substring(digest, 1, 8), 16, 10).cast("double")
    noise = F.floor(-1000 * F.log(-F.log((h + 0.5) / float(1 << 32)))).cast("long")
    return materialize(weighed.withColumn("score", F.col("weight") + noise), "resample-scores")


def with_ranks(scored: DataFrame, settings: ResampleSettings) -> DataFrame:
    """scored with rank: 1, 2, 3... from the highest score for the share that is drawn, else null."""
    able = F.col("n_words") >= settings.least_words
    order = [F.desc("score"), F.col("row.doc_id").asc_nulls_last()]
    dealt = materialize(scored.filter(able).repartitionByRange(*order).withColumn("part", F.spark_partition_id()), "resample-order")
    sizes = dealt.groupBy("part").agg(F.count(F.lit(1)).alias("size"))
    # One row per partition: this table grows with their number only, and so does the one window over it.
    before = F.sum("size").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1))
    starts = sizes.select("part", F.coalesce(before, F.lit(0)).alias("start"))
    place = F.row_number().over(Window.partitionBy("part").orderBy(*order)) + F.col("start")
    drawn = F.floor(sizes.agg(F.coalesce(F.sum("size"), F.lit(0)) * settings.percent / 100).scalar()).cast("long")
    ranked = dealt.join(F.broadcast(starts), "part").withColumn("place", place.cast("long"))
    ranked = ranked.select(*scored.columns, F.when(F.col("place") <= drawn, F.col("place")).alias("rank"))
    return ranked.unionByName(scored.filter(~able).withColumn("rank", F.lit(None).cast("long")))


def resample(docs: DataFrame, target: DataFrame, settings: ResampleSettings | None = None) -> DataFrame:
    """The drawn documents with all their columns; target: a table with a column text."""
    settings = settings or ResampleSettings()
    ranked = with_ranks(importance_scores(docs, target, settings, docs.columns), settings)
    return ranked.filter(F.col("rank").isNotNull()).select(*[F.col("row")[c].alias(c) for c in docs.columns])


def op11_resample(spark: SparkSession, sf_dir: str) -> DataFrame:
    settings = ResampleSettings()
    ranked = with_ranks(importance_scores(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"), settings), settings)
    return ranked.select("row.doc_id", "n_features", "weight", "score", "rank")


#: The checksum of every feature is built byte by byte, through a table made by the polynomial's rule.
OP11_SQL = r"""
WITH RECURSIVE steps(b, i, c) AS (
  SELECT b, 0, b FROM range(256) t(b)
  UNION ALL SELECT b, i + 1, CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END FROM steps WHERE i < 8),
crcs AS MATERIALIZED (SELECT b, c FROM steps WHERE i = 8),
digits AS MATERIALIZED (SELECT b AS digit_b, printf('%02X', b) AS pair FROM range(256) t(b)),
texts AS MATERIALIZED (
  SELECT 0 AS side, row_number() OVER () AS row_id, doc_id, text FROM documents
  UNION ALL SELECT 1, row_number() OVER (), NULL, text FROM benchmark),
split AS MATERIALIZED (
  SELECT side, row_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM texts),
features AS MATERIALIZED (
  SELECT side, row_id, unnest(w) AS feature FROM split
  UNION ALL SELECT side, row_id, unnest(list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1])) FROM split WHERE len(w) > 1),
counted AS MATERIALIZED (SELECT side, row_id, feature, count(*) AS n FROM features GROUP BY ALL),
known AS MATERIALIZED (SELECT feature, hex(encode(feature)) AS hx FROM (SELECT DISTINCT feature FROM counted)),
walk(feature, hx, i, acc) AS (
  SELECT feature, hx, 0, 4294967295::BIGINT FROM known
  UNION ALL
  SELECT feature, hx, i + 1, xor(acc >> 8, c)
  FROM walk JOIN digits ON pair = substr(hx, 2 * i + 1, 2) JOIN crcs ON b = xor(acc, digit_b) & 255
  WHERE i < length(hx) // 2),
hashed AS MATERIALIZED (SELECT feature, xor(acc, 4294967295) % 10000 AS bucket FROM walk WHERE i = length(hx) // 2),
hits AS MATERIALIZED (SELECT bucket, coalesce(sum(n) FILTER (side = 0), 0) AS s, coalesce(sum(n) FILTER (side = 1), 0) AS t FROM counted JOIN hashed USING (feature) GROUP BY bucket),
gains AS MATERIALIZED (
  SELECT bucket, floor(1000 * ln((t + 1)::DOUBLE * ((SELECT coalesce(sum(s), 0) FROM hits) + 10000)::DOUBLE / ((s + 1)::DOUBLE * ((SELECT coalesce(sum(t), 0) FROM hits) + 10000)::DOUBLE)))::BIGINT AS gain FROM hits),
weighed AS (SELECT row_id, sum(n) AS n_features, floor(sum(n * gain)::DOUBLE / sum(n))::BIGINT AS weight FROM counted JOIN hashed USING (feature) JOIN gains USING (bucket) WHERE side = 0 GROUP BY row_id),
scored AS (
  SELECT doc_id, coalesce(n_features, 0) AS n_features, coalesce(weight, 0) AS weight, len(w) AS n_words,
         coalesce(weight, 0) + floor(-1000 * ln(-ln((('0x' || substr(sha256('7:' || coalesce(doc_id::VARCHAR, '')), 1, 8))::BIGINT + 0.5) / 4294967296)))::BIGINT AS score
  FROM texts JOIN split USING (side, row_id) LEFT JOIN weighed ON texts.row_id = weighed.row_id WHERE side = 0),
ranked AS (SELECT *, CASE WHEN n_words >= 20 THEN row_number() OVER (PARTITION BY n_words >= 20 ORDER BY score DESC, doc_id NULLS LAST) END AS place FROM scored)
SELECT doc_id, n_features::BIGINT AS n_features, weight, score, CASE WHEN place <= (SELECT count(*) FROM scored WHERE n_words >= 20) * 25 // 100 THEN place END AS rank
FROM ranked
"""
