"""Substring dedup by seed and extend: every word inside a repeated window goes.

Seeds are winnowed anchors: of the hashes of all runs of `seed_words` words, the smallest in each
stretch as long as a window, so that two equal windows always share their anchor at the same place.
The extension of an anchor is the stretch of windows that it is the anchor of, to both ways; its
content is hashed. Documents are joined on their anchors:

* an anchor found once extends to nothing and is dropped;
* occurrences whose whole extension is found again are maximal on both sides: all their windows repeat;
* the others end inside the extension: their windows are hashed one by one and compared across the
  distinct extensions of that anchor, which gives the exact ends of each repeat.

No pairs of occurrences are formed anywhere, and every join is between two written or scanned tables,
so that Spark can split an anchor that very many documents share.

Nulls and edges: null text has no words; texts shorter than a window lose nothing; a window that
repeats inside its own document counts; repeated rows are repeats of each other, so a window in
them goes; a null doc_id is a document like others; equal lowest hashes in a stretch go by the leftmost; texts
of any length are cut whole, and one text is held at a time; an empty table gives an empty result; other
columns are left behind.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import words as W
from .shared import materialize, table

_BATCH = 4 << 20


def _sliding(values: np.ndarray, width: int, pick: np.ufunc) -> np.ndarray:
    """pick (minimum or maximum) of every `width` neighbours, by doubling."""
    out, have = values, 1
    while have < width:
        step = min(have, width - have)
        out = pick(out[: len(out) - step], out[step:])
        have += step
    return out


class Anchors:
    """Anchors of a batch of texts and the windows each one answers for.

    owner, place: document and word position of each anchor; low, high: its first and last window
    (positions of their first words, counted over the batch).
    """

    def __init__(self, texts: list[bytes], window: int, seed_words: int) -> None:
        hashes, self.counts = W.word_hashes(texts)
        self.starts = W.doc_starts(self.counts)
        self.sums = W.run_sums(hashes)
        self.window = window
        n, width = len(hashes), window - seed_words + 1
        none = np.zeros(0, np.int64)
        self.owner = self.place = self.low = self.high = none
        self.key = np.zeros(0, np.uint64)
        if n < window:
            return
        at = np.arange(n - seed_words + 1)
        seeds = W.span(self.sums, at, at + seed_words)
        lowest = _sliding(seeds, width, np.minimum)  # one value per window start
        doc = np.repeat(np.arange(len(texts)), self.counts)[: len(lowest)]
        whole = np.arange(len(lowest)) + window <= self.starts[doc + 1]
        # Windows across two documents get a value that no seed equals.
        lowest = np.where(whole, lowest, np.uint64(0))
        pad = np.concatenate((np.zeros(width - 1, np.uint64), lowest, np.zeros(width - 1, np.uint64)))
        reach = _sliding(pad, width, np.maximum)  # for each seed, the best over the windows that hold it
        place = np.flatnonzero(reach == seeds)
        # A window's anchor is the leftmost of its lowest seeds; it moves right with the window.
        start = np.flatnonzero(whole)
        if not len(start):
            return
        which = np.searchsorted(place, start)
        wrong = np.flatnonzero(seeds[place[which]] != lowest[start])
        while len(wrong):
            which[wrong] += 1
            wrong = wrong[seeds[place[which[wrong]]] != lowest[start[wrong]]]
        first = np.flatnonzero(np.concatenate(([True], which[1:] != which[:-1])))
        last = np.concatenate((first[1:], [len(start)])) - 1
        self.place, self.low, self.high = place[which[first]], start[first], start[last]
        self.key, self.owner = seeds[self.place], doc[self.low]

    def extensions(self) -> np.ndarray:
        """Hash of what the anchor's windows cover, and of where in it the anchor stands."""
        with np.errstate(over="ignore"):
            return W.mix(W.span(self.sums, self.low, self.high + self.window) + (self.place - self.low).astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))

    def windows(self, start: np.ndarray) -> np.ndarray:
        return W.span(self.sums, start, start + self.window)


def _ranges(low: np.ndarray, high: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """All integers of the ranges low..high, and the index of the range of each."""
    n = high - low + 1
    owner = np.repeat(np.arange(len(low)), n)
    return np.arange(len(owner)) - np.repeat(np.cumsum(n) - n, n) + low[owner], owner


def _columns(batch_names: list[str], arrays: list) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([x if isinstance(x, pa.Array) else pa.array(x) for x in arrays], names=batch_names)


def _signed(x: np.ndarray) -> np.ndarray:
    return x.view(np.int64)


def seed_table(texts: DataFrame, window: int, seed_words: int) -> DataFrame:
    """(a, x, key, low, high): each text's anchors, the hash of their extension, and its first and last window."""

    def seed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in W.small_batches(batches, "text", _BATCH):
            found = Anchors(W.as_bytes(batch.column("text")), window, seed_words)
            key, begin = batch.column("key").to_numpy(), found.starts[found.owner]
            arrays = [_signed(found.key), _signed(found.extensions()), key[found.owner], (found.low - begin).astype(np.int32), (found.high - begin).astype(np.int32)]
            yield _columns(["a", "x", "key", "low", "high"], arrays)

    return texts.select("key", F.col("text").cast("binary").alias("text")).mapInArrow(seed, "a long, x long, key long, low int, high int")


def show_windows(asked: DataFrame, window: int) -> DataFrame:
    """(a, w, key, start, open): anchors and hashes of the windows asked for, from rows (key, text binary, asked array<struct<a, low, high, open>>).

    A window's anchor follows from its words, so equal windows agree in both: 128 bits tell windows apart.
    """

    def show(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in W.small_batches(batches, "text", _BATCH):
            hashes, counts = W.word_hashes(W.as_bytes(batch.column("text")))
            sums, starts = W.run_sums(hashes), W.doc_starts(counts)
            key, lists = batch.column("key").to_numpy(), batch.column("asked")
            row = np.repeat(np.arange(len(key)), np.diff(lists.offsets.to_numpy()))
            item = lists.flatten()
            anchor, low, high, is_open = (item.field(i).to_numpy(zero_copy_only=False) for i in range(4))
            start, owner = _ranges(low.astype(np.int64), high.astype(np.int64))
            at = start + starts[row[owner]]
            yield _columns(["a", "w", "key", "start", "open"], [anchor[owner], _signed(W.span(sums, at, at + window)), key[row[owner]], start.astype(np.int32), is_open[owner].astype(bool)])

    return asked.mapInArrow(show, "a long, w long, key long, start int, open boolean")


def find_repeats(texts: DataFrame, window: int, seed_words: int) -> DataFrame:
    """Repeated windows: (key, low array<int>, high array<int>), ranges of the word positions they start at.

    texts: (key long, text); rows of one key have one text.
    """
    found = seed_table(texts, window, seed_words)
    shared = materialize(found.groupBy("a").agg(F.count(F.lit(1)).alias("n")).filter("n > 1").select("a"), "repeat-shared")
    kept = materialize(found.join(shared, "a"), "repeat-anchors")
    # One row per distinct extension: how often it occurs, and one occurrence that can show its windows.
    kinds = materialize(kept.groupBy("a", "x").agg(F.count(F.lit(1)).alias("n"), F.min(F.struct("key", "low", "high")).alias("one")), "repeat-kinds")
    several = materialize(kinds.groupBy("a").agg(F.count(F.lit(1)).alias("n")).filter("n > 1").select("a"), "repeat-several")
    whole = kept.join(kinds.filter("n > 1").select("a", "x"), ["a", "x"], "left_semi").select("key", "low", "high")
    asked = kinds.join(several, "a").select("one.key", F.struct("a", "one.low", "one.high", (F.col("n") == 1).alias("open")).alias("part"))
    shown = asked.groupBy("key").agg(F.collect_list("part").alias("asked"))
    # Each window has one anchor, so every occurrence shown counts once.
    each = show_windows(texts.join(shown, "key"), window)
    # The join's key is not the key of the counts but its complement, so both sides are dealt out anew
    # and Spark can split a window that very many documents show.
    met = each.groupBy("w", "a").agg(F.count(F.lit(1)).alias("n")).filter("n > 1").select(F.bitwise_not("w").alias("v"), "a")
    single = each.filter("open").withColumn("v", F.bitwise_not("w")).join(met, ["v", "a"], "left_semi").select("key", F.col("start").alias("low"), F.col("start").alias("high"))
    return whole.unionByName(single).groupBy("key").agg(F.collect_list("low").alias("low"), F.collect_list("high").alias("high"))


def drop_repeats(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", window: int = 35, seed_words: int = 8) -> DataFrame:
    """(id, n_words, n_removed, kept): each document without the words of windows that start anywhere else too; kept words are joined by a space."""
    id_type = docs.schema[id_col].dataType.simpleString()
    rows = docs.select(F.col(id_col).alias("id"), F.coalesce(text_col, F.lit("")).cast("binary").alias("text")).withColumn("key", F.xxhash64("id", "text"))
    marked = rows.join(find_repeats(rows, window, seed_words), "key", "left").select("id", "text", "low", "high")

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            kept, total, gone = [], [], []
            for text, low, high in zip(*[batch.column(c) for c in ("text", "low", "high")], strict=True):
                words = text.as_py().split()
                total.append(len(words))
                if low.is_valid:
                    edge = np.zeros(len(words) + 1, np.int64)
                    np.add.at(edge, np.minimum(low.values.to_numpy(), len(words)), 1)
                    np.add.at(edge, np.minimum(high.values.to_numpy() + window, len(words)), -1)
                    covered = np.cumsum(edge[:-1]) > 0
                    words = [w for w, c in zip(words, covered.tolist(), strict=True) if not c]
                gone.append(total[-1] - len(words))
                kept.append(b" ".join(words))
            yield _columns([id_col, "n_words", "n_removed", "kept"], [batch.column("id"), pa.array(total, pa.int64()), pa.array(gone, pa.int64()), pa.array(kept, pa.binary())])

    return marked.mapInArrow(cut, f"{id_col} {id_type}, n_words long, n_removed long, kept binary").withColumn("kept", F.col("kept").cast("string"))


def maximal_repeats(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", window: int = 35, seed_words: int = 8) -> DataFrame:
    """(id, begin, n_words, h0, h1, places): the maximal stretches of each document in which every window starts somewhere else too.

    begin: its first word; h0, h1: 128 bits of its words, equal where two stretches are; places: how often the
    stretch as a whole is one, over all documents. Stretches of a document may overlap where two repeats meet.
    """
    id_type = docs.schema[id_col].dataType.simpleString()
    rows = docs.select(F.col(id_col).alias("id"), F.coalesce(text_col, F.lit("")).cast("binary").alias("text")).withColumn("key", F.xxhash64("id", "text"))
    marked = rows.join(find_repeats(rows, window, seed_words), "key").select("id", "text", "low", "high")

    def extend(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            row, begins, sizes, h0, h1 = [], [], [], [], []
            for i in range(batch.num_rows):
                words = batch.column("text")[i].as_py().split()
                starts = np.zeros(len(words) + 1, np.int8)
                at, _ = _ranges(*(batch.column(c)[i].values.to_numpy().astype(np.int64) for c in ("low", "high")))
                starts[at] = 1
                edge = np.flatnonzero(np.diff(np.concatenate(([0], starts, [0]))))
                for a, b in zip(edge[::2].tolist(), edge[1::2].tolist(), strict=True):
                    value = xxhash.xxh3_128_intdigest(b" ".join(words[a : b + window - 1]))
                    row.append(i)
                    begins.append(a)
                    sizes.append(b - a + window - 1)
                    h0.append(value & (1 << 64) - 1)
                    h1.append(value >> 64)
            halves = [_signed(np.array(h, np.uint64)) for h in (h0, h1)]
            yield _columns([id_col, "begin", "n_words", "h0", "h1"], [batch.column("id").take(pa.array(row, pa.int64())), pa.array(begins, pa.int64()), pa.array(sizes, pa.int64()), *halves])

    found = materialize(marked.mapInArrow(extend, f"{id_col} {id_type}, begin long, n_words long, h0 long, h1 long"), "repeat-spans")
    places = materialize(found.groupBy("h0", "h1").agg(F.count(F.lit(1)).alias("places")), "repeat-places")
    return found.join(places, ["h0", "h1"]).select(id_col, "begin", "n_words", "h0", "h1", "places")


def op7_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    cut = drop_repeats(table(spark, sf_dir, "documents"))
    return cut.select("doc_id", "n_words", "n_removed", F.sha2("kept", 256).alias("kept_sha256"))


OP7_SQL = r"""
WITH w AS (
  SELECT row_number() OVER () AS rid, doc_id,
    regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS ws FROM documents),
starts AS (
  SELECT rid, i, array_to_string(ws[i:i + 34], ' ') AS win
  FROM (SELECT rid, ws, unnest(range(1, len(ws) - 33)) AS i FROM w)),
again AS (SELECT win FROM starts GROUP BY win HAVING count(*) > 1),
hit AS (SELECT rid, i FROM starts SEMI JOIN again USING (win)),
word AS (SELECT rid, unnest(ws) AS t, unnest(range(1, len(ws) + 1)) AS i FROM w),
last_hit AS (
  SELECT rid, i, t, max(h) OVER (PARTITION BY rid ORDER BY i) AS h
  FROM (SELECT word.rid, word.i, t, hit.i AS h FROM word LEFT JOIN hit USING (rid, i))),
kept AS (
  SELECT rid, count(*) AS n, string_agg(t, ' ' ORDER BY i) AS txt
  FROM last_hit WHERE h IS NULL OR i > h + 34 GROUP BY rid)
SELECT w.doc_id, CAST(len(ws) AS BIGINT) AS n_words, CAST(len(ws) - coalesce(kept.n, 0) AS BIGINT) AS n_removed,
  sha256(coalesce(kept.txt, '')) AS kept_sha256
FROM w LEFT JOIN kept USING (rid)
"""
