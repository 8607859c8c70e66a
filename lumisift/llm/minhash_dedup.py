"""MinHash near-dedup with SuperMinHash signatures, banding, verification on full sets, and components.

A document is its set of distinct word shingles. Equal sets are one node. SuperMinHash gives every shingle
a random permutation of the signature's places, drawn step by step: at step j a shingle claims one place,
at a value between j and j + 1. All shingles of a document take a step together, and steps end once every
place is claimed, as later values can't be smaller: so a long document needs one or two steps, and the
signature's variance lies below that of independent hashes. Bands of the signature are the keys by which
nodes meet; with 32 bands of four places a pair at a similarity of 0.8 meets in all but one of 10^7 cases.

Nodes of one key meet in tiles, so that a hot key is spread over tasks. Links are found in two passes, and
neither ships all pairs of a group:

1. every tile proposes a spanning forest of its nearest pairs by signature, within itself and across to the
   key's first tile, so proposals grow with the nodes; full sets confirm or refuse them;
2. a pair that the forests left out counts only where its ends still lie in different components. At keys that
   hold several components all tiles meet, and nodes with such a partner take their full sets to the key that
   the two share first, where the sets are compared.

Nulls and edges: null, empty and wordless texts have no shingle, are nobody's neighbour and form a component
of their own; texts with fewer words than a shingle have one; texts of any length are hashed whole, in
parts; repeated rows are kept and lie in one component; a component is named by its smallest id, so null
ids link others but only a component of null ids alone (or a wordless row of a null id) is named null, and
then nothing is kept of it by `kept`; an empty table gives an empty result; other columns are left behind.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import words as W
from .graph import joined_further, smallest_reachable
from .shared import materialize, table
from .simhash_dedup import shingle_sets, spanning_pairs
from .tiles import in_tiles, pairs_of, set_tiles, settled, several_labels


@dataclass(frozen=True)
class MinHashSettings:
    shingle: int = 2
    #: Least similarity of two sets, as a fraction.
    least: tuple[int, int] = (4, 5)
    bands: int = 32
    rows: int = 4
    #: Equal places of two signatures below which a pair is no candidate: at a similarity of 0.8 of 128 places
    #: 102 are equal (s.d. 4.5), and fewer than 72 in one of 10^10 pairs.
    least_places: int = 72

    @property
    def places(self) -> int:
        return self.bands * self.rows


#: Nodes of a tile, at most so many shingles where tiles carry full sets, and elements permuted at once.
TILE, SET_TILE, SET_VALUES, ELEMENTS = 512, 256, 1 << 20, 1 << 16
_UNSET = np.uint64((1 << 64) - 1)
_STEP, _DRAW = 0x9E3779B97F4A7C15, W.U(0x94D049BB133111EB)


def _claimed(elements: np.ndarray, owner: np.ndarray, docs: int, places: int) -> np.ndarray:
    """The signatures (docs x places) of elements given with their documents: step in the top byte, the draw below."""
    out = np.full(docs * places, _UNSET)
    order = np.tile(np.arange(places, dtype=np.uint8), (len(elements), 1))
    row = np.arange(len(elements))
    for j in range(places):
        x = W.mix(elements + W.U(_STEP * (j + 1) & (1 << 64) - 1))
        k = j + ((x >> W.U(32)) * W.U(places - j) >> W.U(32)).astype(np.int64)
        place = order[row, k]
        order[row, k] = order[:, j]
        value = (W.mix(x ^ _DRAW) >> W.U(8)) | W.U(j << 56)
        np.minimum.at(out, owner * places + place, value)
        full = (out.reshape(docs, places) != _UNSET).all(axis=1)
        left = ~full[owner]
        if not left.any():
            break
        if np.count_nonzero(left) < 0.8 * len(left):
            elements, owner, order = elements[left], owner[left], order[left]
            row = np.arange(len(elements))
    return out.reshape(docs, places)


def super_minhash(elements: np.ndarray, counts: np.ndarray, places: int) -> np.ndarray:
    """SuperMinHash of consecutive groups of distinct 64-bit hashes; a group's parts are permuted apart and their minima taken."""
    out = np.full((len(counts), places), _UNSET)
    owner = np.repeat(np.arange(len(counts)), counts)
    for at in range(0, len(elements), ELEMENTS):
        own = owner[at : at + ELEMENTS]
        first, last = own[0], own[-1]
        part = _claimed(elements[at : at + ELEMENTS], own - first, last - first + 1, places)
        np.minimum(out[first : last + 1], part, out=out[first : last + 1])
    return out


def signatures(docs: DataFrame, settings: MinHashSettings, key_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(key, digest of the text, h0, h1: 128 bits of the set, n: its size, keys of the bands, places: a byte each)."""
    kind = docs.schema[key_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in W.small_batches(batches, "_text"):
            shingles, counts = shingle_sets(W.as_bytes(batch.column("_text")), settings.shingle)
            claimed = super_minhash(shingles, counts, settings.places)
            places = (W.mix(claimed) >> W.U(56)).astype(np.uint8)
            # From the bytes that are compared later: bands equal by these must be keys at which nodes meet.
            keys = np.tile(np.arange(settings.bands, dtype=np.uint64), (len(counts), 1))
            for j in range(settings.rows):
                keys = W.mix(keys + places[:, j :: settings.rows].astype(np.uint64))
            halves, some = np.zeros((2, len(counts)), np.uint64), np.flatnonzero(counts)
            if len(some):
                begin = W.doc_starts(counts)[:-1][some]
                for half, salt in zip(halves, (0, 0xA24BAED4963EE407), strict=True):
                    half[some] = np.add.reduceat(W.mix(shingles ^ W.U(salt)), begin)
            lists = pa.ListArray.from_arrays(pa.array(np.arange(len(counts) + 1, dtype=np.int32) * settings.bands), pa.array(keys.reshape(-1).view(np.int64)))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column("_digest"), *[pa.array(h.view(np.int64)) for h in halves], pa.array(counts.astype(np.int64)), lists, pa.array([p.tobytes() for p in places], pa.binary())],
                names=[key_col, "digest", "h0", "h1", "n", "keys", "places"])

    rows = docs.select(key_col, F.md5(F.coalesce(text_col, F.lit(""))).alias("_digest"), F.col(text_col).cast("binary").alias("_text"))
    return rows.mapInArrow(run, f"{key_col} {kind}, digest string, h0 long, h1 long, n long, keys array<long>, places binary")


# --- nodes of one key, met in tiles -----------------------------------------------------------------


def _candidates(rows: pa.Table, first: np.ndarray, last: np.ndarray, settings: MinHashSettings, labelled: bool) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Pairs of rows (i, j) that may be similar, and their unequal places: sizes fit, enough places are equal, and this key is the first they share."""
    part, of = settings.least
    n, band = rows.column("n").to_numpy(), rows.column("band").to_numpy()
    label = rows.column("label").to_numpy() if labelled else None
    places = np.frombuffer(b"".join(rows.column("places").to_pylist()), np.uint8).reshape(len(n), settings.places)
    found: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
    for i, j in pairs_of(first, last):
        fits = np.minimum(n[i], n[j]) * of >= np.maximum(n[i], n[j]) * part
        if label is not None:
            fits &= label[i] != label[j]
        i, j = i[fits], j[fits]
        equal = places[i] == places[j]
        same = equal.sum(axis=1)
        near = same >= settings.least_places
        i, j, same = i[near], j[near], same[near]
        shared = equal[near].reshape(-1, settings.bands, settings.rows).all(axis=2).argmax(axis=1)
        here = shared == band[i]
        found.append((i[here], j[here], settings.places - same[here]))
    return tuple(np.concatenate(x) for x in zip(*found, strict=True))


def proposed_links(held: DataFrame, settings: MinHashSettings) -> DataFrame:
    """(u, v): a spanning forest of the nearest candidates of every tile, and of it with the key's first; held: (k, band, node, n, places, tiles)."""

    def compare(rows: pa.Table, first: np.ndarray, last: np.ndarray) -> Iterator[pa.RecordBatch]:
        i, j, apart = _candidates(rows, first, last, settings, False)
        distinct, at = np.unique(rows.column("node").to_numpy(), return_inverse=True)
        kept = spanning_pairs(len(distinct), at[i], at[j], apart)
        u, v = distinct[at[i[kept]]], distinct[at[j[kept]]]
        yield pa.RecordBatch.from_arrays([pa.array(np.minimum(u, v)), pa.array(np.maximum(u, v))], names=["u", "v"])

    return in_tiles(held, compare, "u long, v long", ["node", "n", "band", "places"], first_only=True).distinct()


def open_nodes(held: DataFrame, settings: MinHashSettings) -> DataFrame:
    """(k, node) of nodes with a candidate of another component at that key; held: (k, band, node, n, places, label, tiles)."""

    def compare(rows: pa.Table, first: np.ndarray, last: np.ndarray) -> Iterator[pa.RecordBatch]:
        i, j, _ = _candidates(rows, first, last, settings, True)
        hit = pa.array(np.unique(np.concatenate((i, j))))
        yield pa.RecordBatch.from_arrays([rows.column(c).take(hit).combine_chunks() for c in ("k", "node")], names=["k", "node"])

    return in_tiles(held, compare, "k long, node long", ["node", "n", "band", "places", "label"]).distinct()


def confirmed_in_tiles(held: DataFrame, settings: MinHashSettings) -> DataFrame:
    """(u, v): pairs of tiles whose full sets are similar, as many as join their components; held: also (shingles array<long>, label)."""

    def compare(rows: pa.Table, first: np.ndarray, last: np.ndarray) -> Iterator[pa.RecordBatch]:
        i, j, apart = _candidates(rows, first, last, settings, True)
        yield settled(rows, i, j, apart, settings.least)

    return in_tiles(held, compare, "u long, v long", ["node", "n", "band", "places", "label", "shingles"])


# --- components ----------------------------------------------------------------------------------------


def full_sets(nodes: DataFrame, docs: DataFrame, settings: MinHashSettings, key_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(node, shingles array<long>) of a table (node, id, digest): the text of one document of each node."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in W.small_batches(batches, "text"):
            shingles, counts = shingle_sets(W.as_bytes(batch.column("text")), settings.shingle)
            lists = pa.ListArray.from_arrays(pa.array(W.doc_starts(counts).astype(np.int32)), pa.array(shingles.view(np.int64)))
            yield pa.RecordBatch.from_arrays([batch.column("node"), lists], names=["node", "shingles"])

    texts = docs.select(F.col(key_col).alias("of"), F.md5(F.coalesce(text_col, F.lit(""))).alias("text_digest"), F.col(text_col).cast("binary").alias("text"))
    # By id and digest: copies of a text are many, but only one of their ids stands for the node.
    asked = texts.join(nodes, F.col("of").eqNullSafe(F.col("id")) & (F.col("text_digest") == F.col("digest"))).groupBy("node").agg(F.first("text").alias("text"))
    return asked.mapInArrow(run, "node long, shingles array<long>")


def confirmed(links: DataFrame, sets: DataFrame, settings: MinHashSettings) -> DataFrame:
    """The links (u, v) whose full sets are similar enough."""
    part, of = settings.least
    met = links.join(sets.select(F.col("node").alias("u"), F.col("shingles").alias("su")), "u").join(sets.select(F.col("node").alias("v"), F.col("shingles").alias("sv")), "v")
    return met.filter(F.size(F.array_intersect("su", "sv")) * (of + part) >= (F.size("su") + F.size("sv")) * part).select("u", "v")


def _in_keys(classes: DataFrame, keys: DataFrame, size: int, settings: MinHashSettings) -> DataFrame:
    """Rows (k, band, node, tiles) of all keys that two nodes or more hold; keys: (k, band, node)."""
    tiles = keys.groupBy("k").agg(F.count(F.lit(1)).alias("size")).filter("size > 1").select("k", F.ceil(F.col("size") / size).cast("int").alias("tiles"))
    # Written first: a join of two tables is one that Spark can split at a hot key.
    return keys.join(materialize(tiles, "minhash-tiles"), "k")


def similar_groups(classes: DataFrame, docs: DataFrame, settings: MinHashSettings, text_col: str = "text") -> DataFrame:
    """(node, label) of the nodes that links of similar sets join; classes: (node, id, digest, n, keys, places)."""
    keys = classes.select("node", F.posexplode("keys").alias("band", "k"))
    held = materialize(_in_keys(classes, keys, TILE, settings), "minhash-held")
    facts = classes.select("node", "n", "places")
    links = materialize(proposed_links(held.join(facts, "node"), settings), "minhash-proposed")
    asked = links.select(F.explode(F.array("u", "v")).alias("node")).distinct()
    sets = materialize(full_sets(classes.select("node", "id", "digest").join(asked, "node"), docs, settings, text_col=text_col), "minhash-sets")
    true = materialize(confirmed(links, sets, settings), "minhash-confirmed")
    # What forests left out: candidates have a proposed link at both ends, but for those that meet in two later tiles of a key.
    labels = smallest_reachable(true)
    seen = asked.unionByName(held.filter("tiles > 2").select("node")).distinct()
    labelled = materialize(facts.join(seen, "node").join(labels, "node", "left").select("node", "n", "places", F.coalesce("label", "node").alias("label")), "minhash-labels")
    mixed = held.join(labelled, "node")
    left = materialize(open_nodes(several_labels(mixed), settings), "minhash-open")
    if left.isEmpty():
        return labels
    new = left.select("node").distinct().join(sets.select("node"), "node", "left_anti")
    sets = sets.unionByName(materialize(full_sets(classes.select("node", "id", "digest").join(new, "node"), docs, settings, text_col=text_col), "minhash-sets"))
    dealt = set_tiles(left, labelled.select("node", "n"), SET_TILE, SET_VALUES)
    again = dealt.join(held.drop("tiles"), ["k", "node"]).join(labelled, "node").join(sets, "node")
    return joined_further(labels, materialize(confirmed_in_tiles(again, settings), "minhash-confirmed"))


def near_duplicates(docs: DataFrame, settings: MinHashSettings | None = None) -> DataFrame:
    """(doc_id, n_shingles, component_id, kept) per row of docs."""
    settings = settings or MinHashSettings()
    marks = materialize(signatures(docs, settings), "minhash-marks")
    same = marks.filter("n > 0").groupBy("h0", "h1", "n").agg(F.min("doc_id").alias("first"), F.min(F.struct("doc_id", "digest")).alias("rep"), F.first("keys").alias("keys"), F.first("places").alias("places"))
    # Numbered where it is written, so a number stays with its node.
    classes = materialize(same.select("h0", "h1", "n", "first", F.col("rep.doc_id").alias("id"), F.col("rep.digest").alias("digest"), "keys", "places").withColumn("node", F.monotonically_increasing_id()), "minhash-classes")
    labels = similar_groups(classes, docs, settings)
    rooted = materialize(classes.join(labels, "node", "left").select("h0", "h1", "first", F.coalesce("label", "node").alias("root")), "minhash-roots")
    # Written first: a join of two tables is one that Spark can split at a large component.
    names = materialize(rooted.groupBy("root").agg(F.min("first").alias("component_id")), "minhash-names")
    named = materialize(rooted.join(names, "root").select("h0", "h1", "component_id"), "minhash-named")
    linked = marks.filter("n > 0").select("doc_id", "n", "h0", "h1").join(named, ["h0", "h1"]).select("doc_id", F.col("n").alias("n_shingles"), "component_id")
    out = linked.unionByName(marks.filter("n = 0").select("doc_id", F.col("n").alias("n_shingles"), F.col("doc_id").alias("component_id")))
    return out.withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(False)))


def op13_minhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"))


#: Every pair of different sets is counted that shares a shingle, so this is for small tables.
OP13_SQL = r"""
WITH RECURSIVE
split AS MATERIALIZED (SELECT row_number() OVER () AS row_id, doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
sets AS MATERIALIZED (SELECT row_id, doc_id, CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 2 THEN [w[1]] ELSE list_sort(list_distinct(list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1]))) END AS s FROM split),
classes AS MATERIALIZED (SELECT row_number() OVER () AS node, s, len(s) AS n, min(doc_id) AS first FROM sets WHERE len(s) > 0 GROUP BY s),
terms AS MATERIALIZED (SELECT node, n, unnest(s) AS t FROM classes),
links AS MATERIALIZED (
  SELECT a.node AS u, b.node AS v FROM terms a JOIN terms b ON a.t = b.t AND a.node <> b.node AND least(a.n, b.n) * 100 >= greatest(a.n, b.n) * 80
  GROUP BY a.node, b.node, a.n, b.n HAVING 100 * count(*) >= 80 * (a.n + b.n - count(*))),
walk(node, other) AS (SELECT node, node FROM classes UNION SELECT walk.node, v FROM walk JOIN links ON other = u),
named AS (SELECT walk.node, min(o.first) AS component_id FROM walk JOIN classes o ON other = o.node GROUP BY walk.node)
SELECT doc_id, len(sets.s) AS n_shingles, CASE WHEN len(sets.s) = 0 THEN doc_id ELSE component_id END AS component_id,
       coalesce(doc_id = CASE WHEN len(sets.s) = 0 THEN doc_id ELSE component_id END, false) AS kept
FROM sets LEFT JOIN classes ON sets.s = classes.s LEFT JOIN named USING (node)
"""
