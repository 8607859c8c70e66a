"""Line dedup by pairwise alignment.

Lines are compared by their words; blank lines are not compared. Seeds are hashes of blocks of
neighbouring lines: from every line the shortest block onwards, and the shortest block back to it, that
holds LEAST_BYTES bytes of words. That many bytes make a block rare by what it says. How often it is seen
does not matter, so that nothing changes when a corpus or a group of copies grows. A document shorter
than that is one block, and only equal to another such whole.

Each block pairs a later document with the first document that holds it, so pairs grow with the lines,
not with the square of a group of copies. This loses nothing: if a document shares a block with any
earlier one, the first document to hold the block is earlier too. (The blocks of one shared passage may
lead to several first documents.) The lines of both documents, from the first to the last block that pairs
them, are then aligned by patience diff: lines that occur once in both are anchors, the longest run of
anchors that rises in both is kept, and the gaps between are aligned again, after equal lines at their ends.
Aligned blocks of LEAST_BYTES bytes or more are deleted from the later document, with the blank lines inside.
Seeds that the alignment left out (moved blocks, blocks without an anchor) are aligned once more, each for
itself, unless `moved` is false. Only aligned lines go: with `moved`, a line goes if and only if a block around
it stands in an earlier document, whichever pair shows it; without, only what rises in both documents goes.

Nulls and edges: null, empty and blank texts have no lines and stay; documents are ordered by id, then
by text hash, null ids last; rows that repeat in id and text are one document and fare alike; a block
that repeats inside its own document only stays; texts of any length are aligned whole, between the
outermost blocks of each pair; an empty table gives an empty result; other columns pass through, whatever
their names. Lines, blocks and documents are told apart by 128-bit hashes.
"""

from __future__ import annotations

from bisect import bisect_left
from collections import Counter
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import words as W
from .shared import materialize, table

#: Bytes of words (about a dozen words) in the smallest block that shows an overlap.
LEAST_BYTES = 60
#: What tells documents apart: 128 bits of id and text.
KEYS = ["_key", "_key2"]


def clean_lines(text: bytes) -> tuple[list[bytes], list[int]]:
    """The lines that hold words, those joined by one space, and their positions in the text."""
    lines, at = [], []
    for i, line in enumerate(text.split(b"\n")):
        words = line.split()
        if words:
            lines.append(b" ".join(words))
            at.append(i)
    return lines, at


def blocks(sizes: Sequence[int], least: int) -> list[tuple[int, int]]:
    """(first, last) of the shortest blocks of at least `least` bytes that begin or end at a line, from the bytes of each line; of all lines if there are fewer bytes."""
    n = len(sizes)
    if not n:
        return []
    ends = np.concatenate(([0], np.cumsum(sizes)))
    if ends[-1] < least:
        return [(0, n - 1)]
    last = np.searchsorted(ends, ends[:-1] + least) - 1  # from each line on
    first = np.searchsorted(ends, ends[1:] - least, "right") - 1  # back from each line
    onwards = [(i, int(j)) for i, j in enumerate(last) if j < n]
    return sorted({*onwards, *[(int(i), j) for j, i in enumerate(first) if i >= 0]})


def longest_rising(values: list[int]) -> list[int]:
    """Indices of a longest strictly rising subsequence (patience sorting)."""
    tops: list[int] = []
    at: list[int] = []
    back = [-1] * len(values)
    for i, v in enumerate(values):
        pile = bisect_left(tops, v)
        back[i] = at[pile - 1] if pile else -1
        tops[pile : pile + 1] = [v]
        at[pile : pile + 1] = [i]
    out, i = [], at[-1] if at else -1
    while i >= 0:
        out.append(i)
        i = back[i]
    return out[::-1]


def patience_pairs(a: Sequence, b: Sequence) -> list[tuple[int, int]]:
    """Index pairs of equal lines that rise in both sequences, by patience diff.

    Of each gap, equal lines at its ends are taken first; then the lines that occur once in both halves of the
    gap are anchors (or, if there is none, those that occur equally often, taken in order), a longest rising run
    of them is kept, and the gaps between are aligned in turn. A gap without an anchor stays.
    """
    out: list[tuple[int, int]] = []
    gaps = [(0, len(a), 0, len(b))]
    while gaps:
        i, ie, j, je = gaps.pop()
        while i < ie and j < je and a[i] == b[j]:
            out.append((i, j))
            i, j = i + 1, j + 1
        while i < ie and j < je and a[ie - 1] == b[je - 1]:
            ie, je = ie - 1, je - 1
            out.append((ie, je))
        if i == ie or j == je:
            continue
        ours, theirs = Counter(a[i:ie]), Counter(b[j:je])
        anchors = {x for x, n in ours.items() if n == theirs.get(x) == 1} or {x for x, n in ours.items() if n == theirs.get(x)}
        if not anchors:
            continue
        where: dict = {}
        for q in range(je - 1, j - 1, -1):
            if b[q] in anchors:
                where.setdefault(b[q], []).append(q)
        met = [(p, where[a[p]].pop()) for p in range(i, ie) if a[p] in anchors]
        kept = [met[k] for k in longest_rising([q for _, q in met])]
        out += kept
        edges = [(i - 1, j - 1), *kept, (ie, je)]
        gaps += [(p + 1, p2, q + 1, q2) for (p, q), (p2, q2) in zip(edges, edges[1:], strict=False) if p + 1 < p2 and q + 1 < q2]
    return sorted(out)


def aligned_lines(ours: Sequence, theirs: Sequence, sizes: Sequence[int], seeds: list[tuple[int, int, int]], least: int, moved: bool = True) -> set[int]:
    """Indices of our lines that alignment with an earlier document deletes.

    sizes: bytes of each of our lines; seeds: (first, last, their first) of the blocks that paired the two, by
    index in the sequences given. Blocks of at least `least` bytes go, and a whole document shorter than that.
    """
    whole = sum(sizes) < least and any(f == 0 and last == len(ours) - 1 for f, last, _ in seeds)
    gone: set[int] = set()

    def delete(pairs: list[tuple[int, int]]) -> None:
        block: list[tuple[int, int]] = []
        for p in [*pairs, (-2, -2)]:
            if block and p != (block[-1][0] + 1, block[-1][1] + 1):
                if whole or sum(sizes[x] for x, _ in block) >= least:
                    gone.update(x for x, _ in block)
                block = []
            block.append(p)

    delete(patience_pairs(ours, theirs))
    for first, last, their in seeds if moved else ():
        if not gone.issuperset(range(first, last + 1)):
            delete([(first + i, their + j) for i, j in patience_pairs(ours[first : last + 1], theirs[their : their + last - first + 1])])
    return gone


def removed_positions(gone: set[int], at: Sequence[int]) -> list[int]:
    """Positions in the text of lines of words to delete and of the blank lines inside their blocks; at: each line of words' position, and the number of all lines."""
    drop: set[int] = set()
    for k in gone:
        begin, after = at[k], at[k + 1]
        drop.update(range(begin, after) if k + 1 in gone or k + 2 == len(at) else (begin,))
        if k == 0:
            drop.update(range(begin))
    return sorted(drop)


def line_table(docs: DataFrame) -> DataFrame:
    """(keys, doc_id, h0 array<long>, h1 array<long>, sizes array<int>, at array<int>): 128-bit hash, bytes and position of each line of words; at ends with the number of lines."""
    kind = docs.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in W.small_batches(batches, "text"):
            h0, h1, sizes, at, ends = [], [], [], [], [0]
            for text in W.as_bytes(batch.column("text")):
                lines, places = clean_lines(text)
                for x in lines:
                    value = xxhash.xxh3_128_intdigest(x)
                    h0.append(value & (1 << 64) - 1)
                    h1.append(value >> 64)
                sizes += map(len, lines)
                at += [*places, text.count(b"\n") + 1]
                ends.append(len(sizes))
            offsets = np.array(ends, np.int32)
            plus = offsets + np.arange(len(offsets), dtype=np.int32)
            lists = [(offsets, np.array(h0, np.uint64).view(np.int64)), (offsets, np.array(h1, np.uint64).view(np.int64)), (offsets, np.array(sizes, np.int32)), (plus, np.array(at, np.int32))]
            yield pa.RecordBatch.from_arrays([*map(batch.column, (*KEYS, "doc_id")), *[pa.ListArray.from_arrays(pa.array(e), pa.array(x)) for e, x in lists]], names=[*KEYS, "doc_id", "h0", "h1", "sizes", "at"])

    schema = f"_key long, _key2 long, doc_id {kind}, h0 array<long>, h1 array<long>, sizes array<int>, at array<int>"
    return docs.select(*KEYS, "doc_id", F.col("text").cast("binary").alias("text")).mapInArrow(run, schema)


def block_seeds(lines: DataFrame, least: int) -> DataFrame:
    """(keys, doc_id, b0, b1, first, last): 128-bit hashes of the blocks of each row of a line table; that of a whole short document differs from that of any block in a longer one."""
    kind = lines.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            owner, first, last, b0, b1 = [], [], [], [], []
            for i in range(batch.num_rows):
                sizes = batch.column("sizes")[i].values.to_numpy(zero_copy_only=False)
                both = np.stack([batch.column(c)[i].values.to_numpy(zero_copy_only=False) for c in ("h0", "h1")], axis=1).tobytes()
                short = int(sizes.sum() < least)
                for a, b in blocks(sizes, least):
                    value = xxhash.xxh3_128_intdigest(both[16 * a : 16 * b + 16], seed=short)
                    owner.append(i)
                    first.append(a)
                    last.append(b)
                    b0.append(value & (1 << 64) - 1)
                    b1.append(value >> 64)
            row = pa.array(owner, pa.int64())
            halves = [pa.array(np.array(x, np.uint64).view(np.int64)) for x in (b0, b1)]
            yield pa.RecordBatch.from_arrays([*[batch.column(c).take(row) for c in (*KEYS, "doc_id")], *halves, pa.array(first, pa.int32()), pa.array(last, pa.int32())], names=[*KEYS, "doc_id", "b0", "b1", "first", "last"])

    return lines.select(*KEYS, "doc_id", "h0", "h1", "sizes").mapInArrow(run, f"_key long, _key2 long, doc_id {kind}, b0 long, b1 long, first int, last int")


def document_pairs(seeds: DataFrame) -> DataFrame:
    """(keys, o_key, o_key2, begin, end, theirs, theirs_end, seeds): a later and an earlier document, the lines between their outermost shared blocks, and the blocks, counted from there."""
    place = F.struct(F.col("doc_id").isNull(), "doc_id", *KEYS, "first")
    # Rows that repeat in id and text have one key, and their blocks are the document's own.
    held = seeds.groupBy("b0", "b1").agg(F.min(place).alias("f"), F.count(F.lit(1)).alias("n")).filter("n > 1").select("b0", "b1", F.col("f._key").alias("o_key"), F.col("f._key2").alias("o_key2"), F.col("f.first").alias("their"))
    # Both sides are tables, so Spark can split the join at a block that very many documents share.
    met = seeds.join(materialize(held, "first-blocks"), ["b0", "b1"]).filter("_key <> o_key or _key2 <> o_key2")
    # A pair's blocks come together; they are bounded by the later document's own lines.
    pairs = met.groupBy(*KEYS, "o_key", "o_key2").agg(F.min("first").alias("begin"), F.max("last").alias("end"), F.min("their").alias("theirs"), F.max(F.col("their") + F.col("last") - F.col("first")).alias("theirs_end"), F.collect_set(F.struct("first", "last", "their")).alias("s"))
    counted = F.transform("s", lambda x: F.struct((x["first"] - F.col("begin")).alias("first"), (x["last"] - F.col("begin")).alias("last"), (x["their"] - F.col("theirs")).alias("their")))
    return pairs.withColumn("seeds", counted).drop("s")


def lines_to_delete(docs: DataFrame, *, least_bytes: int = LEAST_BYTES, moved: bool = True) -> DataFrame:
    """(keys, _removed array<int>): positions of the lines that alignment deletes, from (keys, doc_id, text)."""
    lines = materialize(line_table(docs), "lines")
    seeds = materialize(block_seeds(lines, least_bytes), "blocks")
    pairs = materialize(document_pairs(seeds), "line-pairs")
    once = lines.groupBy(*KEYS).agg(*[F.first(c).alias(c) for c in ("h0", "h1", "sizes", "at")])
    part = lambda c, begin, end: F.slice(c, F.col(begin) + 1, F.col(end) - F.col(begin) + 1)
    theirs = once.select(F.col("_key").alias("o_key"), F.col("_key2").alias("o_key2"), F.col("h0").alias("t0"), F.col("h1").alias("t1"))
    # Written tables on both sides: the first document of a passage that very many share is a hot key.
    other = pairs.join(materialize(theirs.join(pairs.select("o_key", "o_key2").distinct(), ["o_key", "o_key2"], "left_semi"), "line-firsts"), ["o_key", "o_key2"])
    other = other.select(*KEYS, "begin", "end", "seeds", part("t0", "theirs", "theirs_end").alias("t0"), part("t1", "theirs", "theirs_end").alias("t1"))
    met = other.join(once.drop("at"), KEYS).select(*KEYS, "begin", "seeds", "t0", "t1", *[part(c, "begin", "end").alias(c) for c in ("h0", "h1", "sizes")])

    def align(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = []
            for i in range(batch.num_rows):
                row = {c: batch.column(c)[i].as_py() for c in ("begin", "seeds", "t0", "t1", "h0", "h1", "sizes")}
                ours, their = list(zip(row["h0"], row["h1"], strict=True)), list(zip(row["t0"], row["t1"], strict=True))
                blocks = sorted((x["first"], x["last"], x["their"]) for x in row["seeds"])
                found.append(sorted(k + row["begin"] for k in aligned_lines(ours, their, row["sizes"], blocks, least_bytes, moved)))
            yield pa.RecordBatch.from_arrays([*map(batch.column, KEYS), pa.array(found, pa.list_(pa.int32()))], names=[*KEYS, "gone"])

    gone = met.mapInArrow(align, "_key long, _key2 long, gone array<int>").groupBy(*KEYS).agg(F.array_distinct(F.flatten(F.collect_list("gone"))).alias("gone"))

    def places(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            removed = [removed_positions(set(g), at) for g, at in zip(batch.column("gone").to_pylist(), batch.column("at").to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays([*map(batch.column, KEYS), pa.array(removed, pa.list_(pa.int32()))], names=[*KEYS, "_removed"])

    placed = gone.filter(F.size("gone") > 0).join(once.select(*KEYS, "at"), KEYS)
    return placed.select(*KEYS, "gone", "at").mapInArrow(places, "_key long, _key2 long, _removed array<int>")


def _cut(docs: DataFrame, **limits) -> DataFrame:
    """(row, text, n_removed): each row as it came, the text that stays, and how many lines went."""
    text = F.coalesce("text", F.lit(""))
    keys = [F.xxhash64("doc_id", text).alias("_key"), F.xxhash64(F.lit(1), "doc_id", text).alias("_key2")]
    gone = materialize(lines_to_delete(docs.select(*keys, "doc_id", "text"), **limits), "lines-gone")
    keyed = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), *keys)
    lines = F.split("row.text", "\n")
    stay = F.array_except(F.sequence(F.lit(0), F.size(lines) - 1), F.col("_removed"))
    text = F.when(F.col("_removed").isNull(), F.col("row.text")).otherwise(F.array_join(F.transform(stay, lambda i: lines[i]), "\n"))
    # A merge join at every size: the list of deletions grows with the corpus, so it is never broadcast.
    return keyed.join(gone.hint("merge"), KEYS, "left").select("row", text.alias("text"), F.when(F.col("_removed").isNull(), 0).otherwise(F.size("_removed")).alias("n_removed"))


def _with_text(cut: DataFrame, columns: list[str]) -> list:
    return [F.col("text") if c == "text" else F.col("row")[c].alias(c) for c in columns]


def drop_aligned_lines(docs: DataFrame, **limits) -> DataFrame:
    """docs with text cut to the lines that stay, and n_removed (which replaces a column of that name); the text of other rows is untouched."""
    cut = _cut(docs, **limits)
    return cut.select(*_with_text(cut, [c for c in docs.columns if c != "n_removed"]), "n_removed")


def keep_unaligned(docs: DataFrame) -> DataFrame:
    """Pipeline stage: delete aligned lines; a document that loses its last word goes."""
    cut = _cut(docs)
    kept = cut.filter((F.col("n_removed") == 0) | F.coalesce(F.col("text").rlike(r"[^\x20\x09-\x0D]"), F.lit(False)))
    return kept.select(*_with_text(cut, docs.columns))


def op6_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", F.size(F.split("text", "\n")).alias("n_lines"))
    cut = drop_aligned_lines(docs)
    return cut.select("doc_id", F.when(F.col("text").isNull(), 0).otherwise(F.col("n_lines")).alias("n_lines"), "n_removed", F.coalesce(F.length("text"), F.lit(0)).alias("kept_chars"), F.sha2(F.coalesce("text", F.lit("")), 256).alias("kept_sha256"))
