"""Language-model scoring by context-tree weighting over bytes.

A text is its token stream: every lower-cased (A-Z) word and a space, then one line feed as the end.
Each byte is eight binary decisions, and each decision of each context of up to `depth` bytes is a node
with two counts. The Krichevsky-Trofimov estimate of a node's counts is mixed, half and half, with the
product over its longer contexts, from the deepest contexts down to none; these weights then blend the
estimates of all depths along a context into one probability per decision. A decision uses the contexts
that have data, up to the longest. Every node of the training texts counts, however rare: the model
grows with the corpus, so it is a table and never a worker's.

1. Documents are dealt into groups of bounded size; each task lists the distinct byte runs and words of
   its groups with their training counts, and Spark sums them over all groups.
2. Runs that share their `_LOW` nearest context bytes go to one bucket. There the long contexts are
   weighed; their sums per short context go back to Spark, which weighs the few levels below with joins.
   A second pass over the buckets gives the log probability of every distinct run.
3. Each group's runs and words are joined with what they are worth and written by group, and the task
   that scores a group reads what that group needs.

The base score is a unigram model of words, which are counted and looked up the same way.

Nulls and edges: null text is empty and has one token, its end; a null doc_id is neither learned from
nor held out; texts of any length are scored whole, half a megabyte of runs at a time (one text at least);
runs and words of equal hash share their counts; without training rows every decision has probability one half and every word is unknown;
repeated rows are counted and scored each; an empty table gives an empty result; other columns are left behind.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import pyarrow.dataset as ds
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import words as W
from .langid import fold
from .shared import fresh_path, materialize, table

#: Bytes of text whose runs are laid out at once (arrays over them take about a hundred times as much),
#: and bytes of text (or one text, if that is longer) in a group.
_BATCH, _GROUP = 1 << 19, 32 << 20
#: Contexts of this many bytes and more are weighed in tasks, shorter ones by Spark; runs that share them
#: are at most 2**24 (two older bytes and the byte itself), so a bucket's size has a bound.
_LOW = 3
#: Distinct runs in a bucket.
_BUCKET = 1 << 17
#: What a row of counts is about.
_RUN, _WORD, _TEXT = 0, 1, 2


@dataclass(frozen=True)
class CtwSettings:
    """depth: bytes of the longest context, 1 to 6 (a run of a context and its byte is one integer)."""

    depth: int = 5


def stream(text: bytes) -> bytes:
    words = text.lower().split()
    return b" ".join(words) + b" \n" if words else b"\n"


def byte_runs(texts: list[bytes], depth: int) -> tuple[np.ndarray, np.ndarray]:
    """For every byte of every text's stream, the run of depth bytes before it and itself as one integer; and bytes per text."""
    streams = [stream(t) for t in texts]
    pad = b"\n" * depth
    buf = np.frombuffer(b"".join([pad + s for s in streams]), np.uint8)
    n = np.array([len(s) for s in streams], np.int64)
    # Runs of 1, 2, 4, ... bytes, put together to depth + 1.
    part, wide = buf.astype(np.int64), 1
    out, have = np.zeros(len(buf) + 1, np.int64), 0
    while True:
        if (depth + 1) & wide:
            out = (out[: len(out) - wide] << (8 * wide)) | part[have : have + len(out) - wide]
            have += wide
        if have == depth + 1:
            break
        part = (part[: len(part) - wide] << (8 * wide)) | part[wide:]
        wide *= 2
    keep = np.ones(len(out), bool)
    ends = np.cumsum(n + depth)[:-1] - depth
    for j in range(depth):  # runs that reach across two texts
        keep[ends + j] = False
    return out[keep], n


def add_counts(keys: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct keys in ascending order, and the sum of the counts of each."""
    if not len(keys):
        return keys, counts
    order = np.argsort(keys)
    keys = keys[order]
    first = np.flatnonzero(np.concatenate(([True], keys[1:] != keys[:-1])))
    return keys[first], np.add.reduceat(counts[order], first)


def deal(docs: DataFrame) -> DataFrame:
    """docs with their text as bytes and the number `g` of a group: neighbouring rows of about _GROUP bytes of text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        first, size = TaskContext.get().partitionId() << 32, 0
        for batch in W.small_batches(batches, "text", _GROUP):
            n = batch.column("text").nbytes
            if size and size + n > _GROUP:
                first, size = first + 1, 0
            size += n
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(np.full(batch.num_rows, first))], names=[*batch.schema.names, "g"])

    rows = docs.select("doc_id", "held_out", "learn", F.col("text").cast("binary").alias("text"))
    return rows.mapInArrow(run, f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, held_out boolean, learn boolean, text binary, g long")


class _Tally:
    """Counts by key of many parts, put together whenever the parts outgrow what is together already."""

    def __init__(self) -> None:
        self.keys = self.counts = np.zeros(0, np.int64)
        self.parts: list[tuple[np.ndarray, np.ndarray]] = []
        self.waiting = 0

    def add(self, keys: np.ndarray, counts: np.ndarray) -> None:
        self.parts.append((keys, counts))
        self.waiting += len(keys)
        if self.waiting > max(1 << 21, len(self.keys)):
            self.merge()

    def merge(self) -> tuple[np.ndarray, np.ndarray]:
        if self.parts:
            self.keys, self.counts = add_counts(*map(np.concatenate, zip((self.keys, self.counts), *self.parts, strict=True)))
            self.parts, self.waiting = [], 0
        return self.keys, self.counts


def count_groups(dealt: DataFrame, depth: int) -> DataFrame:
    """(g, kind, key, n): each distinct byte run (kind 0) and word hash (1) of a group, and texts (2, key 0), with its number in texts to learn from."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        group, runs, words, n_texts = None, _Tally(), _Tally(), 0

        def out() -> Iterator[pa.RecordBatch]:
            for kind, (keys, n) in ((_RUN, runs.merge()), (_WORD, words.merge()), (_TEXT, (np.zeros(1, np.int64), np.array([n_texts])))):
                for i in range(0, len(keys), 1 << 16):
                    part = keys[i : i + (1 << 16)]
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(len(part), group)), pa.array(np.full(len(part), kind, np.int8)), pa.array(part), pa.array(n[i : i + (1 << 16)])], names=["g", "kind", "key", "n"])

        for batch in W.small_batches(batches, "text", _BATCH):
            texts, learn, of = W.as_bytes(batch.column("text")), batch.column("learn").to_pylist(), batch.column("g").to_numpy()
            for g in dict.fromkeys(of.tolist()):
                if g != group:
                    if group is not None:
                        yield from out()
                    group, runs, words, n_texts = g, _Tally(), _Tally(), 0
                for wanted in (True, False):
                    some = [t for t, own, x in zip(texts, of, learn, strict=True) if own == g and bool(x) is wanted]
                    if some:
                        n_texts += len(some) if wanted else 0
                        for tally, keys in ((runs, byte_runs(some, depth)[0]), (words, W.word_hashes([t.lower() for t in some])[0].view(np.int64))):
                            keys, n = np.unique(keys, return_counts=True)
                            tally.add(keys, n.astype(np.int64) if wanted else np.zeros(len(keys), np.int64))
        if group is not None:
            yield from out()

    return dealt.select("g", "learn", "text").mapInArrow(run, "g long, kind byte, key long, n long")


# --- nodes ------------------------------------------------------------------------------------------
# A node's key is its context << 8 | 1 << i | the i bits so far of the byte.


def _stirling(x: np.ndarray) -> np.ndarray:
    """Log of the gamma function: Stirling's series six above the argument, brought down by the recurrence."""
    y = x + 6.0
    below = x * (x + 1) * (x + 2) * (x + 3) * (x + 4) * (x + 5)
    return (y - 0.5) * np.log(y) - y + 0.5 * math.log(2 * math.pi) + 1 / (12 * y) - 1 / (360 * y**3) + 1 / (1260 * y**5) - np.log(below)


def log_kt(zeros: np.ndarray, ones: np.ndarray) -> np.ndarray:
    """Log of the Krichevsky-Trofimov probability of counts."""
    return _stirling(zeros + 0.5) + _stirling(ones + 0.5) - math.log(math.pi) - _stirling(zeros + ones + 1.0)


def _log_gamma(x: Column) -> Column:
    """_stirling for a column."""
    x = x.cast("double")
    y = x + 6
    below = reduce(lambda p, i: p * (x + i), range(1, 6), x)
    return (y - 0.5) * F.log(y) - y + F.lit(0.5 * math.log(2 * math.pi)) + 1 / (12 * y) - 1 / (360 * y * y * y) + 1 / (1260 * y * y * y * y * y) - F.log(below)


def log_kt_column(zeros: Column, ones: Column) -> Column:
    return _log_gamma(zeros + 0.5) + _log_gamma(ones + 0.5) - F.lit(math.log(math.pi)) - _log_gamma(zeros + ones + 1)


class Level:
    """The nodes of one depth over runs (ascending, distinct) of depth + 1 bytes: keys in ascending order, and their counts of zeros and ones."""

    def __init__(self, runs: np.ndarray, n: np.ndarray, depth: int) -> None:
        keys, zeros, ones, at = [], [], [], []
        for i in range(8):
            so_far = runs >> (8 - i)
            first = np.concatenate(([True], so_far[1:] != so_far[:-1]))
            place = np.flatnonzero(first)
            bit = (runs >> (7 - i)) & 1
            zeros.append(np.add.reduceat(n * (1 - bit), place))
            ones.append(np.add.reduceat(n * bit, place))
            so_far = so_far[place]
            keys.append(((so_far >> i) << 8) | (1 << i) | (so_far & ((1 << i) - 1)))
            at.append((np.cumsum(first) - 1 + sum(map(len, keys[:-1])), bit))
        order = np.argsort(np.concatenate(keys))
        self.depth, self.keys = depth, np.concatenate(keys)[order]
        self.zeros, self.ones = (np.concatenate(x)[order].astype(np.float64) for x in (zeros, ones))
        self._rank = np.empty(len(order), np.int64)
        self._rank[order] = np.arange(len(order))
        self._at = at

    def node_of(self, i: int) -> np.ndarray:
        """For each run, the node that decides bit i of its last byte."""
        return self._rank[self._at[i][0]]

    def bits(self, i: int) -> np.ndarray:
        return self._at[i][1]

    def parents(self) -> np.ndarray:
        """Keys of the nodes without the oldest byte of their contexts."""
        return ((self.keys >> 8 & ((1 << 8 * (self.depth - 1)) - 1)) << 8) | (self.keys & 255)


def levels_of(runs: np.ndarray, n: np.ndarray, top: int, low: int) -> list[Level]:
    """The levels top, top - 1, ..., low of runs of top + 1 bytes."""
    out = []
    for depth in range(top, low - 1, -1):
        runs, n = add_counts(runs & ((1 << 8 * (depth + 1)) - 1), n)
        out.append(Level(runs, n, depth))
    return out


def weigh(levels: list[Level]) -> tuple[list[np.ndarray], list[np.ndarray]]:
    """For each level from the deepest, the log weights of its nodes and the share of a node's own estimate in its weight."""
    weights, shares = [], []
    for i, level in enumerate(levels):
        own = log_kt(level.zeros, level.ones)
        if i == 0:
            weights.append(own)
            shares.append(np.ones(len(own)))
            continue
        longer = np.bincount(np.searchsorted(level.keys, levels[i - 1].parents()), weights=weights[-1], minlength=len(own))
        both = np.logaddexp(own, longer) - math.log(2)
        weights.append(both)
        shares.append(0.5 * np.exp(own - both))
    return weights, shares


def run_logs(levels: list[Level], shares: list[np.ndarray], above: dict[str, np.ndarray]) -> np.ndarray:
    """log10 of the probability of the last byte of each run of the deepest level.

    above: for each node of the last (shallowest) level, what its shorter contexts settled: `s0` and
    `s1`, the blended probability of a zero and a one so far; `left`, the weight still open; and `p0`
    and `p1`, the blend that ends there.
    """
    s0, s1, left, p0, p1 = (above[x] for x in ("s0", "s1", "left", "p0", "p1"))
    for i in range(len(levels) - 1, -1, -1):
        level, share = levels[i], shares[i]
        if i < len(levels) - 1:
            up = np.searchsorted(levels[i + 1].keys, level.parents())
            s0, s1, left, p0, p1 = s0[up], s1[up], left[up], p0[up], p1[up]
        total = level.zeros + level.ones
        # Both are sums of positive terms, so neither gets lost beside a probability near one.
        zero, one = (level.zeros + 0.5) / (total + 1), (level.ones + 0.5) / (total + 1)
        some = total > 0
        p0, p1 = np.where(some, s0 + left * zero, p0), np.where(some, s1 + left * one, p1)
        s0, s1, left = s0 + left * share * zero, s1 + left * share * one, left * (1 - share)
    logs = np.log10(np.stack((p0, p1), axis=1)).reshape(-1)
    runs = levels[0]
    return sum(logs[2 * runs.node_of(i) + runs.bits(i)] for i in range(8))


def _bucket(context: Column, buckets: int) -> Column:
    return F.pmod(F.xxhash64(context), F.lit(buckets)).cast("int").alias("bucket")


def _parent(depth: int) -> Column:
    return F.shiftleft(F.shiftrightunsigned("node", 8).bitwiseAND(F.lit((1 << 8 * (depth - 1)) - 1)), 8).bitwiseOR(F.col("node").bitwiseAND(F.lit(255)))


def _blends(lowest: DataFrame, low: int) -> DataFrame:
    """(node, s0, s1, left, p0, p1) for the nodes (node, a, b, lw) of depth `low`: what shorter contexts settle."""
    a, b = F.col("a"), F.col("b")
    weighed = {low: lowest}
    for depth in range(low - 1, -1, -1):
        up = weighed[depth + 1].groupBy(_parent(depth + 1).alias("node")).agg(F.sum("a").alias("a"), F.sum("b").alias("b"), F.sum("lw").alias("longer"))
        own = log_kt_column(a, b)
        most = F.greatest("own", "longer")
        up = up.withColumn("own", own).withColumn("lw", most + F.log(0.5 * F.exp(F.col("own") - most) + 0.5 * F.exp(F.col("longer") - most)))
        weighed[depth] = materialize(up.select("node", "a", "b", "lw", (0.5 * F.exp(F.col("own") - F.col("lw"))).alias("share")), "ctw-weights")
    root = {"s0": F.lit(0.0), "s1": F.lit(0.0), "left": F.lit(1.0), "p0": F.lit(0.5), "p1": F.lit(0.5)}
    settled = None
    for depth in range(low):
        at = weighed[depth]
        at = at.withColumns(root) if settled is None else at.withColumn("up", _parent(depth)).join(settled, "up")
        zero, one, some, left = (a + 0.5) / (a + b + 1), (b + 0.5) / (a + b + 1), a + b > 0, F.col("left")
        settled = materialize(at.select(
            F.col("node").alias("up"), (F.col("s0") + left * F.col("share") * zero).alias("s0"), (F.col("s1") + left * F.col("share") * one).alias("s1"), (left * (1 - F.col("share"))).alias("left"),
            F.when(some, F.col("s0") + left * zero).otherwise(F.col("p0")).alias("p0"), F.when(some, F.col("s1") + left * one).otherwise(F.col("p1")).alias("p1")), "ctw-blend")
    return lowest.select("node", _parent(low).alias("up")).join(settled, "up").drop("up")


def run_log_table(runs: DataFrame, settings: CtwSettings) -> DataFrame:
    """(key, v): log10 of the probability of each run, from (key, n), the distinct runs and their training counts."""
    top, low = settings.depth, min(_LOW, settings.depth)
    buckets = max(1, -(-runs.count() // _BUCKET))
    low_context = F.shiftright("key", 8).bitwiseAND(F.lit((1 << 8 * low) - 1))
    dealt = materialize(runs.select("key", "n", _bucket(low_context, buckets)).repartition("bucket"), "ctw-runs")

    def tree(part: pa.Table) -> tuple[np.ndarray, list[Level], list[np.ndarray], list[np.ndarray]]:
        keys, n = add_counts(part.column("key").to_numpy(), part.column("n").to_numpy())
        levels = levels_of(keys, n, top, low)
        return keys, levels, *weigh(levels)

    def up(part: pa.Table) -> pa.Table:
        _, levels, weights, _ = tree(part)
        return pa.table({"node": levels[-1].keys, "a": levels[-1].zeros, "b": levels[-1].ones, "lw": weights[-1]})

    def down(part: pa.Table, above: pa.Table) -> pa.Table:
        keys, levels, _, shares = tree(part)
        order = np.argsort(above.column("node").to_numpy())
        settled = {c: above.column(c).to_numpy()[order] for c in ("s0", "s1", "left", "p0", "p1")}
        return pa.table({"key": keys, "v": run_logs(levels, shares, settled)})

    lowest = materialize(dealt.groupBy("bucket").applyInArrow(up, "node long, a double, b double, lw double"), "ctw-low")
    blends = _blends(lowest, low).withColumn("bucket", _bucket(F.shiftright("node", 8), buckets))
    return dealt.groupBy("bucket").cogroup(blends.groupBy("bucket")).applyInArrow(down, "key long, v double")


# --- scores -----------------------------------------------------------------------------------------


class Worth:
    """What the runs (log10 of their probability) and words (their training counts) of one group are worth."""

    def __init__(self, folder: str, group: int) -> None:
        store, root = fs.FileSystem.from_uri(folder)
        got = ds.dataset(f"{root}/g={group}", filesystem=store, format="parquet").to_table(columns=["kind", "key", "v", "n"])
        self.tables = {}
        for k, column in ((_RUN, "v"), (_WORD, "n")):
            mine = got.filter(pc.equal(got.column("kind"), k))
            key = mine.column("key").to_numpy()
            order = np.argsort(key)
            self.tables[k] = key[order], mine.column(column).to_numpy()[order].astype(np.float64)

    def of(self, kind: int, keys: np.ndarray) -> np.ndarray:
        known, v = self.tables[kind]
        return v[np.searchsorted(known, keys)]


def score_texts(texts: list[bytes], worth: Worth, depth: int) -> tuple[np.ndarray, np.ndarray]:
    """log10 of the probability, and the bytes, of each text."""
    runs, sizes = byte_runs(texts, depth)
    distinct, which = np.unique(runs, return_inverse=True)
    return np.add.reduceat(worth.of(_RUN, distinct)[which], W.doc_starts(sizes)[:-1]), sizes


def score(docs: DataFrame, settings: CtwSettings = CtwSettings()) -> DataFrame:
    """(doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score, n_bytes) for rows (doc_id, held_out, learn, text), learning from those marked learn.

    Code length per byte is -score / n_bytes / log10(2).
    """
    spark, depth = docs.sparkSession, settings.depth
    dealt = materialize(deal(docs), "ctw-dealt")
    held = materialize(count_groups(dealt, depth), "ctw-groups")
    counts = materialize(held.groupBy("kind", "key").agg(F.sum("n").alias("n")), "ctw-counts")
    sums = {r["kind"]: (r["n"], r["k"]) for r in counts.filter(F.col("kind") > _RUN).groupBy("kind").agg(F.sum("n").alias("n"), F.count_if(F.col("n") > 0).alias("k")).collect()}
    n_texts = sums.get(_TEXT, (0, 0))[0]
    n_train, vocabulary = sums.get(_WORD, (0, 0))[0] + n_texts, sums.get(_WORD, (0, 0))[1] + (1 if n_texts else 0)
    runs = run_log_table(counts.filter(F.col("kind") == _RUN).select("key", "n"), settings).select(F.lit(_RUN).cast("byte").alias("kind"), "key", F.col("v").cast("float").alias("v"), F.lit(None).cast("long").alias("n"))
    words = counts.filter(F.col("kind") == _WORD).select("kind", "key", F.lit(None).cast("float").alias("v"), "n")
    worth = materialize(runs.unionByName(words), "ctw-worth")
    folder = fresh_path(spark, "ctw-lookup")
    met = held.filter(F.col("kind") < _TEXT).select("g", "kind", "key").join(worth, ["kind", "key"])
    met.repartition("g").write.option("compression", "zstd").partitionBy("g").parquet(folder)
    whole, unseen = math.log10(n_train + 0.1 * (vocabulary + 1)), math.log10(0.1)
    end = math.log10(n_texts + 0.1)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        group, known = None, None
        for batch in W.small_batches(batches, "text", _BATCH):
            of = batch.column("g").to_numpy()
            cuts = [0, *(np.flatnonzero(np.diff(of)) + 1).tolist(), len(of)]
            for a, b in zip(cuts, cuts[1:], strict=False):
                if of[a] != group:
                    group, known = of[a], Worth(folder, of[a])
                texts = W.as_bytes(batch.column("text").slice(a, b - a))
                points, sizes = score_texts(texts, known, depth)
                hashes, n_words = W.word_hashes([t.lower() for t in texts])
                distinct, which = np.unique(hashes.view(np.int64), return_inverse=True)
                c, starts = known.of(_WORD, distinct), W.doc_starts(n_words)
                sums = [np.diff(np.concatenate(([0.0], np.cumsum(x[which])))[starts]) for x in ((c > 0).astype(np.float64), np.where(c > 0, np.log10(c + 0.1), unseen))]
                n_known = np.rint(sums[0]).astype(np.int64) + (1 if n_texts else 0)
                cols = [n_words + 1, n_known, np.full(b - a, n_train, np.int64), sums[1] + end - (n_words + 1) * whole, points, sizes]
                yield pa.RecordBatch.from_arrays([batch.column("doc_id").slice(a, b - a), batch.column("held_out").slice(a, b - a), *map(pa.array, cols)], names=["doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score", "n_bytes"])

    id_type = docs.schema["doc_id"].dataType.simpleString()
    return dealt.select("g", "doc_id", "held_out", "text").mapInArrow(run, f"doc_id {id_type}, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double, n_bytes long")


def op3_ctw_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    held = fold("doc_id", 10)
    return score(docs.select("doc_id", F.coalesce(held == 0, F.lit(False)).alias("held_out"), F.coalesce(held != 0, F.lit(False)).alias("learn"), "text"))
