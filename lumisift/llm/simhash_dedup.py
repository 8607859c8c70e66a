"""SimHash near-dedup by bit-sliced comparison.

Fingerprints that share a bucket key are compared in blocks: the block's bits are stored
vertically (one row of packed words per bit position), and for every query a carry-save counter made
of bitwise operations adds one differing bit position at a time for 64 fingerprints at once. A
counter starts so that it overflows when the distance passes the radius; queries whose whole block
has overflowed are abandoned.

Two ways to form buckets: blocks of fingerprint bits, which lose no pair (pigeonhole), or min-hash
keys of the shingles, for radii at which no pigeonhole is selective. Buckets are cut in tiles, and
tiles meet in pairs, so a hot bucket is spread over tasks. Links leave a block as a spanning forest of
its nearest pairs, never as all pairs.

Near-duplicates of a corpus are verified: only links whose shingle sets have the similarity stand. Pairs that
a forest left out are looked at again where their ends still lie in different components, and there the
sets themselves are compared: no candidate is lost by the forests.

Nulls and edges: null text counts as empty; a bit that half of the shingles set is zero; texts of any length are
hashed whole; other columns are left behind by the query and kept by the stage; texts without words have fingerprint zero and link like
others; equal fingerprints are one node; null ids link like others and get their component's name but
never name one, so a component of null ids alone is null; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import words as W
from .graph import joined_further, smallest_reachable
from .shared import materialize, table
from .tiles import in_tiles, pairs_of, set_tiles, settled, several_labels

#: Members of a bucket compared in one task.
TILE = 1024
#: Nodes of a tile, at most so many shingles, where full sets are compared.
SET_TILE, SET_VALUES = 256, 1 << 20
#: Members put in one bit-sliced block, and queries run against it at once.
BLOCK, QUERIES = 1024, 256


def shingle_hashes(text: bytes, n: int) -> list[int]:
    """XXH64 (seed 42) of each run of n words, lower-cased, joined by a space; fewer words: all of them."""
    words = text.lower().split()
    if not words:
        return []
    joined = memoryview(b" ".join(words))
    start, at = [], 0
    for w in words:
        start.append(at)
        at += len(w) + 1
    end = [*start[n:], at] if len(words) > n else [at]
    digest = xxhash.xxh64_intdigest
    return [digest(joined[a : b - 1], 42) for a, b in zip(start, end, strict=False)]


def majority_bits(hashes: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """One 64-bit word per group: the bits set in over half of its hashes."""
    set_bits = W.vote_counts(hashes, counts) * 2 > counts[:, None]
    return np.packbits(set_bits, axis=1, bitorder="little").view(np.uint64).reshape(-1)


def fingerprints(docs: DataFrame, key_col: str = "doc_id", text_col: str = "text", n: int = 3) -> DataFrame:
    """(key, fp long): 64-bit SimHash of word shingles, each occurrence one vote."""
    kind = docs.schema[key_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in W.small_batches(batches, "_text"):
            lists = [shingle_hashes(t, n) for t in W.as_bytes(batch.column("_text"))]
            counts = np.array([len(x) for x in lists], np.int64)
            flat = np.fromiter((h for x in lists for h in x), np.uint64, int(counts.sum()))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(majority_bits(flat, counts).view(np.int64))], names=[key_col, "fp"])

    return docs.select(key_col, F.col(text_col).cast("binary").alias("_text")).mapInArrow(run, f"{key_col} {kind}, fp long")


def planes_of(fps: np.ndarray) -> np.ndarray:
    """Bit planes of m fingerprints (m x words of 64 bits): bits x ceil(m/64) packed words."""
    m = len(fps)
    bits = np.unpackbits(np.ascontiguousarray(fps).view(np.uint8).reshape(m, -1), axis=1, bitorder="little")
    pad = np.zeros((bits.shape[1], -(-m // 64) * 64), np.uint8)
    pad[:, :m] = bits.T
    return np.packbits(pad, axis=1, bitorder="little").view(np.uint64)


def links_within(queries: np.ndarray, members: np.ndarray, radius: int, later: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Index pairs (query, member) at a distance of at most radius; later: per query, only members from that index on."""
    planes, m = planes_of(members), len(members)
    width = radius.bit_length()
    begin = (1 << width) - 1 - radius
    wide = planes.shape[1]
    bits = np.unpackbits(np.ascontiguousarray(queries).view(np.uint8).reshape(len(queries), -1), axis=1, bitorder="little").astype(bool)
    found_q, found_m = [], []
    for first in range(0, len(queries), QUERIES):
        own = bits[first : first + QUERIES]
        rows = np.arange(first, first + len(own))
        skip = np.zeros((len(own), wide * 64), np.uint8)
        skip[:, m:] = 1
        if later is not None:
            skip |= np.arange(wide * 64)[None, :] < later[rows][:, None]
        over = np.packbits(skip, axis=1, bitorder="little").view(np.uint64)
        counter = [np.full((len(own), wide), ~np.uint64(0) if begin >> b & 1 else np.uint64(0)) for b in range(width)]
        for p in range(planes.shape[0]):
            carry = planes[p][None, :] ^ np.where(own[:, p], ~np.uint64(0), np.uint64(0))[:, None]
            for b in range(width):
                up = counter[b] & carry
                counter[b] = counter[b] ^ carry
                carry = up
            over |= carry
            if p % 8 == 7:
                alive = (over != ~np.uint64(0)).any(axis=1)
                if not alive.all():
                    if not alive.any():
                        rows = rows[:0]
                        break
                    rows, own, over = rows[alive], own[alive], over[alive]
                    counter = [c[alive] for c in counter]
        if len(rows):
            q, k = np.nonzero(np.unpackbits(over.view(np.uint8), axis=1, bitorder="little") == 0)
            found_q.append(rows[q])
            found_m.append(k)
    if not found_q:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    return np.concatenate(found_q), np.concatenate(found_m)


def forest(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Of n nodes joined by the pairs (a, b), the smallest node of each one's component."""
    label = np.arange(n)
    while len(a):
        low = np.minimum(label[a], label[b])
        np.minimum.at(label, label[a], low)
        np.minimum.at(label, label[b], low)
        np.minimum.at(label, a, low)
        np.minimum.at(label, b, low)
        label = label[label]
        keep = label[a] != label[b]
        a, b = a[keep], b[keep]
    while (label != label[label]).any():
        label = label[label]
    return label


def spanning_pairs(n: int, a: np.ndarray, b: np.ndarray, apart: np.ndarray) -> np.ndarray:
    """Indices of the pairs (a, b) that make a spanning forest of n nodes of the least total distance (Boruvka's rounds); pairs a = b join nothing."""
    order = np.lexsort((b, a, apart))
    order = order[a[order] != b[order]]
    a, b = a[order], b[order]
    left, label, chosen = np.arange(len(a)), np.arange(n), np.zeros(len(a), bool)
    while len(left):
        nearest = np.full(n, len(a))
        np.minimum.at(nearest, label[a[left]], left)
        np.minimum.at(nearest, label[b[left]], left)
        picked = np.unique(nearest[nearest < len(a)])
        chosen[picked] = True
        label = forest(n, label[a[picked]], label[b[picked]])[label]
        left = left[label[a[left]] != label[b[left]]]
    return order[chosen]


def _block_links(node: np.ndarray, fps: np.ndarray, n: np.ndarray, side: np.ndarray, radius: int, least: tuple[int, int]) -> tuple[np.ndarray, np.ndarray]:
    """The nearest pairs that join one block. Small groups may share a block: a link across them is as true as one inside."""
    if (side > 0).any():  # two different tiles of one bucket: only pairs across
        left, right = np.flatnonzero(side == 1), np.flatnonzero(side == 2)
        q, k = links_within(fps[left], fps[right], radius) if len(left) and len(right) else (np.zeros(0, np.int64),) * 2
        a, b = left[q], right[k]
    else:
        a, b = links_within(fps, fps, radius, later=np.arange(1, len(fps) + 1))
    part, of = least
    fits = np.minimum(n[a], n[b]) * of >= np.maximum(n[a], n[b]) * part
    a, b = a[fits], b[fits]
    apart = np.zeros(len(a), np.uint16)
    for word in range(fps.shape[1]):
        apart += np.bitwise_count(fps[a, word] ^ fps[b, word])
    # A node may stand in a block more than once.
    distinct, place = np.unique(node, return_inverse=True)
    kept = spanning_pairs(len(distinct), place[a], place[b], apart)
    u, v = node[a[kept]], node[b[kept]]
    return np.minimum(u, v), np.maximum(u, v)


def near_links(nodes: DataFrame, radius: int, least: tuple[int, int] = (0, 1)) -> DataFrame:
    """Edges (u, v) that join all nodes at most radius apart whose fingerprints share a bucket key.

    nodes: (node long, fp array<long>, keys array<long>, n long), one row per node. Pairs whose smaller
    n is less than the fraction `least` of the larger are no links.
    """
    keyed = nodes.select("node", "fp", "n", F.explode(F.array_distinct("keys")).alias("k"))
    tiles = keyed.groupBy("k").agg(F.count(F.lit(1)).alias("size")).filter("size > 1").select("k", F.ceil(F.col("size") / TILE).cast("int").alias("tiles"))
    # Written first: a join of two tables is one that Spark can split at a hot key.
    held = keyed.join(materialize(tiles, "simhash-tiles"), "k").withColumn("own", F.pmod(F.hash("node"), F.col("tiles")))
    # A tile meets itself and every other tile of its bucket: side 0 within, 1 and 2 across.
    meet = F.transform(F.sequence(F.lit(0), F.col("tiles") - 1), lambda t: F.struct(
        F.least(t, F.col("own")).alias("a"), F.greatest(t, F.col("own")).alias("b"), F.when(t == F.col("own"), 0).when(F.col("own") < t, 1).otherwise(2).alias("side")))
    spread = held.select("node", "fp", "n", "k", F.explode(meet).alias("m")).select("node", "fp", "n", "k", "m.a", "m.b", "m.side")

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: list[pd.DataFrame] = []
        size = 0

        def compare(block: pd.DataFrame) -> pd.DataFrame:
            node = block["node"].to_numpy()
            fps = np.stack(block["fp"].to_numpy()).astype(np.int64).view(np.uint64)
            group, n = block["g"].to_numpy(), block["n"].to_numpy()
            u, v = [], []
            cut = np.flatnonzero(np.diff(group)) + 1
            begin, edges = 0, [*cut.tolist(), len(block)]
            side = block["side"].to_numpy()
            for i, stop in enumerate(edges):
                mixed = side[stop - 1] > 0
                begins_mixed = side[begin] > 0
                if mixed or begins_mixed or stop - begin >= BLOCK or i == len(edges) - 1:
                    spans = [(begin, stop)]
                    if i and (mixed != begins_mixed) and edges[i - 1] > begin:
                        spans = [(begin, edges[i - 1]), (edges[i - 1], stop)]
                    for x, y in spans:
                        one, two = _block_links(node[x:y], fps[x:y], n[x:y], side[x:y], radius, least)
                        u.append(one)
                        v.append(two)
                    begin = stop
            return pd.DataFrame({"u": np.concatenate(u), "v": np.concatenate(v)})

        for part in parts:
            if not len(part):
                continue
            part = part.reset_index(drop=True)
            part["g"] = pd.util.hash_array(part["k"].to_numpy()) + part["a"].to_numpy().astype(np.uint64) * np.uint64(1_000_003) + part["b"].to_numpy().astype(np.uint64) * np.uint64(7_919)
            held.append(part)
            size += len(part)
            if size >= 4 * BLOCK:
                whole = pd.concat(held, ignore_index=True)
                g = whole["g"].to_numpy()
                tail = int(np.flatnonzero(g != g[-1])[-1]) + 1 if (g != g[-1]).any() else 0
                if tail:
                    yield compare(whole[:tail])
                held, size = [whole[tail:]], len(whole) - tail
        if held and sum(map(len, held)):
            yield compare(pd.concat(held, ignore_index=True))

    dealt = spread.repartition("k", "a", "b").sortWithinPartitions("k", "a", "b")
    return dealt.mapInPandas(run, "u long, v long")


def pigeonhole_keys(fp: str, radius: int = 2, blocks: int = 4) -> F.Column:
    """Keys of 64-bit words: two of them at most radius bits apart agree on blocks - radius of the blocks."""
    wide = 64 // blocks
    picks = list(combinations(range(blocks), blocks - radius))
    masks = [sum(((1 << wide) - 1) << (wide * i) for i in pick) for pick in picks]
    signed = [m - (1 << 64) if m >> 63 else m for m in masks]
    return F.array(*[F.xxhash64(F.lit(i), F.col(fp).bitwiseAND(F.lit(m))) for i, m in enumerate(signed)])


def components(fps: DataFrame, radius: int = 2) -> DataFrame:
    """(doc_id, fp, component_id) of a table (doc_id, fp): linked at radius or fewer differing bits."""
    fps = materialize(fps.select("doc_id", "fp"), "simhash-fps")
    # A fingerprint is its own node, so that one which only null ids have links others too.
    classes = materialize(fps.groupBy("fp").agg(F.min("doc_id").alias("first")), "simhash-classes")
    nodes = classes.select(F.col("fp").alias("node"), F.array("fp").alias("fp"), pigeonhole_keys("fp", radius, radius + 2).alias("keys"), F.lit(1).cast("long").alias("n"))
    labels = smallest_reachable(near_links(nodes, radius))
    rooted = materialize(classes.join(labels, F.col("fp") == F.col("node"), "left").select("fp", "first", F.coalesce("label", "fp").alias("root")), "simhash-roots")
    named = rooted.join(rooted.groupBy("root").agg(F.min("first").alias("component_id")), "root").select("fp", "component_id")
    return fps.join(materialize(named, "simhash-named"), "fp").select("doc_id", "fp", "component_id")


# --- near-duplicates by shingle similarity, for documents of a corpus -----------------------------

#: Candidates: 256-bit fingerprints of five-word shingles. At a Jaccard similarity of 0.8 the cosine is
#: 0.889 and 38.8 bits (s.d. 5.7) differ, or 48 (s.d. 6.2) between sets of four and five shingles; a radius
#: of 64 keeps 99 % of the worst of these. Eight keys of two min-hashes each meet in all but 0.03 % of such pairs.
STAGE_SHINGLE, STAGE_BITS, STAGE_RADIUS, STAGE_KEYS, STAGE_ROWS = 5, 256, 64, 8, 2
#: Links: similarity of the sets of shingles, as a fraction.
STAGE_LEAST = (4, 5)


def shingle_sets(texts: list[bytes], size: int = STAGE_SHINGLE) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the distinct shingles of `size` words of each text, ascending (fewer words: all of them as one), and how many."""
    hashes, n = W.word_hashes([t.lower() for t in texts])
    sums, starts = W.run_sums(hashes), W.doc_starts(n)
    counts = np.where(n > 0, np.maximum(n - size + 1, 1), 0)
    first = np.repeat(starts[:-1] - W.doc_starts(counts)[:-1], counts) + np.arange(counts.sum())
    last = np.minimum(first + size, np.repeat(starts[1:], counts))
    shingles, owner = W.span(sums, first, last), np.repeat(np.arange(len(n)), counts)
    order = np.lexsort((shingles, owner))
    shingles, owner = shingles[order], owner[order]
    new = np.concatenate(([True], (shingles[1:] != shingles[:-1]) | (owner[1:] != owner[:-1])))[: len(shingles)]
    return shingles[new], np.bincount(owner[new], minlength=len(n))


def _lists(values: np.ndarray, ends: np.ndarray) -> pa.ListArray:
    return pa.ListArray.from_arrays(pa.array(ends.astype(np.int32)), pa.array(values.view(np.int64)))


def wide_fingerprints(docs: DataFrame, key_col: str, text_col: str = "text") -> DataFrame:
    """(key, fp array<long>, keys array<long>, whole long, n long): SimHash, min-hash keys, one hash and the number of the distinct five-word shingles."""
    kind = docs.schema[key_col].dataType.simpleString()

    def salted(shingles: np.ndarray, salt: int) -> np.ndarray:
        return W.mix(shingles ^ W.U(0x9FB21C651E98DF25 * (2 * salt + 3) & (1 << 64) - 1))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in W.small_batches(batches, "_text"):
            shingles, counts = shingle_sets(W.as_bytes(batch.column("_text")))
            fp = np.stack([majority_bits(W.mix(shingles + W.U(0xA24BAED4963EE407 * (i + 1) & (1 << 64) - 1)), counts) for i in range(STAGE_BITS // 64)], axis=1)
            keys, whole = np.zeros((len(counts), STAGE_KEYS), np.uint64), np.zeros(len(counts), np.uint64)
            some = np.flatnonzero(counts)
            if len(some):
                begin = W.doc_starts(counts)[:-1][some]
                whole[some] = np.add.reduceat(W.mix(shingles), begin)
                for i in range(STAGE_KEYS):
                    band = np.full(len(some), i, np.uint64)
                    for j in range(STAGE_ROWS):
                        band = W.mix(band + np.minimum.reduceat(salted(shingles, i * STAGE_ROWS + j), begin))
                    keys[some, i] = band
            lists = [_lists(x.reshape(-1), np.arange(len(counts) + 1) * x.shape[1]) for x in (fp, keys)]
            yield pa.RecordBatch.from_arrays([batch.column(0), *lists, pa.array(whole.view(np.int64)), pa.array(counts.astype(np.int64))], names=[key_col, "fp", "keys", "whole", "n"])

    return docs.select(key_col, F.col(text_col).cast("binary").alias("_text")).mapInArrow(run, f"{key_col} {kind}, fp array<long>, keys array<long>, whole long, n long")


def similar_pairs(links: DataFrame, texts: DataFrame, sizes: DataFrame, least: tuple[int, int] = STAGE_LEAST) -> tuple[DataFrame, DataFrame]:
    """The links (u, v) whose texts' shingle sets have a Jaccard similarity of at least `least`, and the sets (node, s) of all ends; texts: (node, text), sizes: (node, n)."""
    part, of = least
    n_u, n_v = sizes.select(F.col("node").alias("u"), F.col("n").alias("nu")), sizes.select(F.col("node").alias("v"), F.col("n").alias("nv"))
    near = materialize(links.distinct().join(n_u, "u").join(n_v, "v"), "simhash-near")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in W.small_batches(batches, "text"):
            shingles, counts = shingle_sets(W.as_bytes(batch.column("text")))
            yield pa.RecordBatch.from_arrays([batch.column("node"), _lists(shingles, W.doc_starts(counts))], names=["node", "s"])

    ends = near.select(F.explode(F.array("u", "v")).alias("node")).distinct()
    sets = texts.select("node", F.col("text").cast("binary").alias("text")).join(ends, "node", "left_semi").groupBy("node").agg(F.min("text").alias("text")).mapInArrow(run, "node long, s array<long>")
    sets = materialize(sets, "simhash-sets")
    met = near.join(sets.select(F.col("node").alias("u"), F.col("s").alias("su")), "u").join(sets.select(F.col("node").alias("v"), F.col("s").alias("sv")), "v")
    both = F.size(F.array_intersect("su", "sv"))
    return met.filter(both * (of + part) >= (F.col("nu") + F.col("nv")) * part).select("u", "v"), sets


def _apart_in_tiles(rows: pa.Table, first: np.ndarray, last: np.ndarray, radius: int, least: tuple[int, int]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Pairs of rows (i, j) of different labels at most radius bits apart whose sizes fit, and their distances."""
    fps = rows.column("fp").combine_chunks().flatten().to_numpy().view(np.uint64).reshape(rows.num_rows, -1)
    n, label = rows.column("n").to_numpy(), rows.column("label").to_numpy()
    part, of = least
    found: list[tuple[np.ndarray, ...]] = [(np.zeros(0, np.int64),) * 3]
    # Most pairs are of one label, and go before any distance is taken.
    for i, j in pairs_of(first, last):
        fits = (label[i] != label[j]) & (np.minimum(n[i], n[j]) * of >= np.maximum(n[i], n[j]) * part)
        i, j = i[fits], j[fits]
        apart = np.bitwise_count(fps[i] ^ fps[j]).sum(axis=1, dtype=np.int64)
        near = apart <= radius
        found.append((i[near], j[near], apart[near]))
    return tuple(np.concatenate(x) for x in zip(*found, strict=True))


def left_out_links(nodes: DataFrame, labels: DataFrame, sets: DataFrame, radius: int, least: tuple[int, int]) -> DataFrame:
    """Edges (u, v) between components `labels` (node, label) of nodes (node, fp, keys, n) that share a key, lie in the radius and have similar sets (node, s): as many as join the components."""
    keys = nodes.select("node", F.explode(F.array_distinct("keys")).alias("k"))
    tiles = keys.groupBy("k").agg(F.count(F.lit(1)).alias("size")).filter("size > 1").select("k", F.ceil(F.col("size") / TILE).cast("int").alias("tiles"))
    # Candidates always have a proposed link, so nodes without a set have none.
    facts = materialize(nodes.select("node", "fp", "n").join(sets.select("node"), "node", "left_semi").join(labels, "node", "left").select("node", "fp", "n", F.coalesce("label", "node").alias("label")), "simhash-labels")
    held = several_labels(keys.join(facts, "node").join(materialize(tiles, "simhash-tiles"), "k"))

    def open_pairs(rows: pa.Table, first: np.ndarray, last: np.ndarray) -> Iterator[pa.RecordBatch]:
        i, j, _ = _apart_in_tiles(rows, first, last, radius, least)
        hit = pa.array(np.unique(np.concatenate((i, j))))
        yield pa.RecordBatch.from_arrays([rows.column(c).take(hit).combine_chunks() for c in ("k", "node")], names=["k", "node"])

    left = materialize(in_tiles(held, open_pairs, "k long, node long", ["node", "fp", "n", "label"]).distinct(), "simhash-open")
    again = set_tiles(left, facts.select("node", "n"), SET_TILE, SET_VALUES).join(facts, "node").join(sets.select("node", F.col("s").alias("shingles")), "node")

    def confirm(rows: pa.Table, first: np.ndarray, last: np.ndarray) -> Iterator[pa.RecordBatch]:
        yield settled(rows, *_apart_in_tiles(rows, first, last, radius, least), least)

    return in_tiles(again, confirm, "u long, v long", ["node", "fp", "n", "label", "shingles"])


def drop_near_duplicates(docs: DataFrame) -> DataFrame:
    """Keep one document of each group of near-duplicates (Jaccard of the sets of five-word shingles 0.8 or more).

    Documents of equal sets are one; candidates come from SimHash and are verified by their sets. The
    smallest doc_id of a group stays (null ids last; then the smallest hash of the text). Repeated rows are
    one document. Documents without words are one group. All columns of docs are kept.
    """
    key = F.md5(F.concat(F.coalesce(F.col("doc_id").cast("string"), F.lit("null")), F.lit(":"), F.coalesce("text", F.lit(""))))
    keyed = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), "doc_id", "text", key.alias("_key"))
    marks = materialize(wide_fingerprints(keyed.select(F.struct("doc_id", "_key").alias("at"), "text"), "at"), "near-fps")
    first = F.min(F.struct(F.col("at.doc_id").isNull(), "at.doc_id", "at._key")).alias("first")
    classes = materialize(marks.groupBy("fp", "whole", "n").agg(first, F.min("keys").alias("keys")).withColumn("node", F.monotonically_increasing_id()), "near-classes")
    links = materialize(near_links(classes.select("node", "fp", "keys", "n"), STAGE_RADIUS, STAGE_LEAST), "near-links")
    # Rows of one key have one text, and a class needs one of them.
    asked = links.select(F.explode(F.array("u", "v")).alias("node")).distinct()
    asked = materialize(classes.select(F.col("first._key").alias("_key"), "node").join(asked, "node", "left_semi"), "near-asked")
    texts = keyed.select("_key", "text").join(asked, "_key").select("node", "text")
    true, sets = similar_pairs(links, texts, classes.select("node", "n"))
    true = materialize(true.distinct(), "near-true")
    labels = smallest_reachable(true)
    more = materialize(left_out_links(classes.select("node", "fp", "keys", "n"), labels, sets, STAGE_RADIUS, STAGE_LEAST), "near-more")
    labels = joined_further(labels, more)
    grouped = classes.join(labels, "node", "left").groupBy(F.coalesce("label", "node").alias("label")).agg(F.min("first").alias("first"))
    kept = grouped.select(F.col("first._key").alias("_key"))
    chosen = keyed.select("row", "_key").join(kept, "_key", "left_semi")
    once = Window.partitionBy("_key").orderBy(F.lit(1))
    return chosen.withColumn("_n", F.row_number().over(once)).filter("_n = 1").select(*[F.col("row")[c].alias(c) for c in docs.columns])


def op9_simhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = components(fingerprints(table(spark, sf_dir, "documents")))
    return out.select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")
