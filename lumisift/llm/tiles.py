"""Rows that share a key, met in tiles: how near-duplicate operators compare the members of a hot key."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import materialize


def in_tiles(held: DataFrame, compare: Callable[[pa.Table, np.ndarray, np.ndarray], Iterator[pa.RecordBatch]], schema: str, columns: list[str], *, first_only: bool = False) -> DataFrame:
    """Deal the rows of each key k in tiles (a column `tiles` says how many) and run `compare` on each, and on every two of them.

    first_only: of two tiles, only with the key's first, so that rows are copied three times at most on average. compare(rows, first, last) gets whole groups one after another; row i meets the rows first[i]..last[i]-1.
    """
    own = F.pmod(F.hash("node"), F.col("tiles"))
    every = F.sequence(F.lit(0), F.col("tiles") - 1)
    met = F.when(own == 0, every).otherwise(F.array(F.lit(0), own)) if first_only else every
    meet = F.transform(met, lambda t: F.struct(
        F.least(t, own).alias("a"), F.greatest(t, own).alias("b"), F.when(t == own, 0).when(own < t, 1).otherwise(2).alias("side")))
    spread = held.select("k", *columns, F.explode(meet).alias("m")).select("k", "m.a", "m.b", "m.side", *columns)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []

        def whole(rows: pa.Table, new: np.ndarray) -> Iterator[pa.RecordBatch]:
            side = rows.column("side").to_numpy()
            start = np.flatnonzero(new)
            group = np.cumsum(new) - 1
            last = np.append(start[1:], len(new))[group]
            # Side 1 comes before side 2, and meets it alone; rows of one tile meet those after them.
            middle = last - np.bincount(group, weights=side == 2, minlength=len(start)).astype(np.int64)[group]
            at = np.arange(len(new))
            yield from compare(rows, np.where(side == 0, at + 1, np.where(side == 1, middle, last)), last)

        for batch in batches:
            if not batch.num_rows:
                continue
            held.append(batch)
            if sum(b.num_rows for b in held) < 4096:
                continue
            rows = pa.Table.from_batches(held)
            new = group_starts(rows)
            cut = int(np.flatnonzero(new)[-1])
            if cut:
                yield from whole(rows.slice(0, cut), new[:cut])
            held = rows.slice(cut).to_batches()
        if held:
            rows = pa.Table.from_batches(held)
            yield from whole(rows, group_starts(rows))

    # A number given is not coalesced: a few megabytes of rows can be minutes of comparisons.
    parts = int(held.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return spread.repartition(parts, "k", "a", "b").sortWithinPartitions("k", "a", "b", "side").mapInArrow(run, schema)


def pairs_of(first: np.ndarray, last: np.ndarray, most: int = 1 << 16) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """The pairs (i, j) of rows that meet, first[i] <= j < last[i], about `most` at a time (one row's partners at least)."""
    count = np.maximum(last - first, 0)
    chunk = np.cumsum(count) // most
    for some in np.split(np.arange(len(first)), np.flatnonzero(np.diff(chunk)) + 1):
        i = np.repeat(some, count[some])
        yield i, np.arange(len(i)) - np.repeat(np.cumsum(count[some]) - count[some], count[some]) + first[i]


def group_starts(rows: pa.Table) -> np.ndarray:
    """Where groups of rows (ascending by k, a, b) begin."""
    new = np.zeros(rows.num_rows, bool)
    new[0] = True
    for c in ("k", "a", "b"):
        x = rows.column(c).to_numpy()
        new[1:] |= x[1:] != x[:-1]
    return new


def settled(rows: pa.Table, i: np.ndarray, j: np.ndarray, apart: np.ndarray, least: tuple[int, int]) -> pa.RecordBatch:
    """(u, v): of candidate pairs (i, j) of rows with node, label and full sets, nearest first, those that are similar and join two components."""
    part, of = least
    node, label, sets = rows.column("node").to_numpy(), rows.column("label").to_numpy(), rows.column("shingles")
    root = {x: x for x in label.tolist()}

    def find(x: int) -> int:
        while root[x] != x:
            root[x] = root[root[x]]
            x = root[x]
        return x

    u, v = [], []
    for at in np.argsort(apart, kind="stable"):
        a, b = int(i[at]), int(j[at])
        x, y = find(int(label[a])), find(int(label[b]))
        if x == y:
            continue
        one, two = (sets[k].values.to_numpy(zero_copy_only=False) for k in (a, b))
        both = len(np.intersect1d(one, two, assume_unique=True))
        if both * (of + part) >= (len(one) + len(two)) * part:
            root[x] = y
            u.append(min(node[a], node[b]))
            v.append(max(node[a], node[b]))
    return pa.RecordBatch.from_arrays([pa.array(u, pa.int64()), pa.array(v, pa.int64())], names=["u", "v"])


def several_labels(held: DataFrame) -> DataFrame:
    """The rows (k, label, ...) of keys that hold more than one label."""
    several = held.groupBy("k").agg(F.min("label").alias("low"), F.max("label").alias("high")).filter("low < high").select("k")
    return held.join(materialize(several, "several-labels"), "k", "left_semi")


def set_tiles(asked: DataFrame, sizes: DataFrame, most: int, values: int) -> DataFrame:
    """asked (k, node) with the number of tiles of each key, so that a tile has about `most` nodes and `values` set members; sizes: (node, n)."""
    wide = asked.join(sizes, "node").groupBy("k").agg(F.count(F.lit(1)).alias("size"), F.sum("n").alias("values"))
    tiles = F.greatest(F.ceil(F.col("size") / most), F.ceil(F.col("values") / values)).cast("int")
    return asked.join(materialize(wide.select("k", tiles.alias("tiles")), "set-tiles"), "k")
