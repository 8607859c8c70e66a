"""Document fingerprints: SimHash of weighted terms, and permuted block tables to search them.

Only DataFrame functions are used. A document's terms are its distinct words, weighted by 1 + ln of
their number; each term's 128-bit hash votes with its weight, for or against, on every bit. Two
32-bit vote counters ride in one long, so 64 sums serve 128 bits.

The search permutes the fingerprint's blocks: two fingerprints at most r bits apart agree on at least
`blocks - r` of the blocks, so a table for each choice of that many blocks, keyed by their bits, finds
every such pair exactly.

Nulls and edges: null text counts as empty; a text without words has the fingerprint zero; a bit on which
votes are even is zero; texts of any length vote with all their words, dealt by word; equal texts have equal fingerprints; repeated rows are kept; where several rows share the id of a next
document, the smallest opening and the smallest fingerprint of those rows stand for it; a row without
an id has no next document: its edited text only loses its last quarter and its near_next is null; an
empty table gives an empty result; other columns are left behind.
"""

from __future__ import annotations

from functools import reduce
from itertools import combinations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .shared import materialize, table

BITS = 128
_SPACE = r"[\x20\x09-\x0D]+"
_LANES = 0x0000000100000001


def _bit(half: int, j: int) -> Column:
    """Whether over half of the weight votes for bit j of a half."""
    lane = F.shiftrightunsigned(F.col(f"s{half}_{j % 32}"), 32) if j >= 32 else F.col(f"s{half}_{j % 32}").bitwiseAND(F.lit(0xFFFFFFFF))
    return F.shiftleft((lane * 2 > F.col("total")).cast("long"), j)


def simhash(texts: DataFrame, keys: list[str], text_col: str = "text") -> DataFrame:
    """(keys, f0 long, f1 long): the two halves of each row's fingerprint; rows of equal keys must have one text.

    Where texts are already partitioned by one of the keys, nothing is shuffled.
    """
    words = texts.select(*keys, F.explode(F.split(F.coalesce(text_col, F.lit("")), _SPACE)).alias("w"))
    # An empty piece stands at the ends of a text, and keeps texts without words; it has no weight.
    terms = words.groupBy(*keys, F.when(F.col("w") != "", F.xxhash64("w")).alias("h")).agg(F.count(F.lit(1)).alias("n"))
    votes = terms.select(*keys, F.coalesce("h", F.lit(0)).alias("h0"), F.xxhash64("h", F.lit(1)).alias("h1"), F.when(F.col("h").isNull(), 0).otherwise(F.round(8 * (1 + F.log("n")))).cast("long").alias("wt"))
    sums = [F.sum(F.shiftrightunsigned(f"h{half}", j).bitwiseAND(F.lit(_LANES)) * F.col("wt")).alias(f"s{half}_{j}") for half in (0, 1) for j in range(32)]
    counted = votes.groupBy(*keys).agg(F.sum("wt").alias("total"), *sums)
    return counted.select(*keys, *[reduce(Column.bitwiseOR, [_bit(half, j) for j in range(64)]).alias(f"f{half}") for half in (0, 1)])


def likeness(a: str, b: str) -> Column:
    """Share of equal bits of two fingerprints given by the prefixes of their columns."""
    apart = sum((F.bit_count(F.col(f"{a}{half}").bitwiseXOR(F.col(f"{b}{half}"))) for half in (0, 1)), F.lit(0))
    return (BITS - apart) / F.lit(float(BITS))


def as_hex(f: str) -> Column:
    return F.concat(*[F.lpad(F.lower(F.hex(F.col(f"{f}{half}"))), 16, "0") for half in (1, 0)])


def block_keys(radius: int, blocks: int) -> Column:
    """An array of keys of (f0, f1), one per choice of blocks - radius of the blocks of 128 bits."""
    edges = [round(i * BITS / blocks) for i in range(blocks + 1)]
    masks = [((1 << b) - 1) ^ ((1 << a) - 1) for a, b in zip(edges, edges[1:], strict=False)]
    keys = []
    for i, pick in enumerate(combinations(masks, blocks - radius)):
        mask = sum(pick)
        parts = [mask & (1 << 64) - 1, mask >> 64]
        signed = [m - (1 << 64) if m >> 63 else m for m in parts]
        keys.append(F.xxhash64(F.lit(i), *[F.col(f"f{half}").bitwiseAND(F.lit(m)) for half, m in enumerate(signed)]))
    return F.array(*keys)


def near_fingerprints(queries: DataFrame, prints: DataFrame, radius: int = 3, blocks: int = 5) -> DataFrame:
    """Distinct pairs (q0, q1, f0, f1, distance) of query and stored fingerprints at most radius bits apart.

    queries, prints: (f0, f1). Both are made distinct first, so copies cost nothing; whoever has the
    rows joins them to the pairs. Tables may repeat a pair, the result does not.
    """
    q = queries.select("f0", "f1").distinct().withColumn("k", F.explode(block_keys(radius, blocks))).select("k", F.col("f0").alias("q0"), F.col("f1").alias("q1"))
    p = prints.select("f0", "f1").distinct().withColumn("k", F.explode(block_keys(radius, blocks)))
    apart = sum((F.bit_count(F.col(f"q{half}").bitwiseXOR(F.col(f"f{half}"))) for half in (0, 1)), F.lit(0))
    return q.join(p, "k").withColumn("distance", apart).filter(F.col("distance") <= radius).select("q0", "q1", "f0", "f1", "distance").distinct()


def next_ids(ids: DataFrame) -> DataFrame:
    """(doc_id, next_id) for the distinct ids of a column doc_id in ascending order; the first follows the last.

    Range partitions are numbered and written, then each looks ahead on its own; the one row at the
    end of each takes the first id of the partition after it.
    """
    dealt = materialize(ids.select("doc_id").repartitionByRange("doc_id").withColumn("part", F.spark_partition_id()), "order-ids")
    firsts = dealt.groupBy("part").agg(F.min("doc_id").alias("first"))
    # One row per partition: this table grows with their number only.
    after = F.coalesce(F.lead("first").over(Window.orderBy("part")), F.min("first").over(Window.partitionBy()))
    firsts = F.broadcast(firsts.select("part", after.alias("after")))
    ahead = F.lead("doc_id").over(Window.partitionBy("part").orderBy("doc_id"))
    return dealt.withColumn("ahead", ahead).join(firsts, "part").select("doc_id", F.coalesce("ahead", "after").alias("next_id"))


def edited_texts(docs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(doc_id, text, edited) for rows with an id, and the order (doc_id, next_id).

    edited: the last quarter of the code points gives way to as many from the next document's start.
    """
    known = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")).filter(F.col("doc_id").isNotNull())
    sizes = known.groupBy("doc_id").agg(F.max(F.length("text")).alias("n"))
    order = materialize(next_ids(known.select("doc_id").distinct()), "order")
    wanted = order.join(sizes, "doc_id").select(F.col("doc_id").alias("before"), "next_id", F.floor(F.col("n") / 4).cast("int").alias("room"))
    wanted = materialize(wanted, "order-room")
    openings = known.join(wanted, F.col("doc_id") == F.col("next_id")).select(F.col("before"), F.expr("left(text, room)").alias("opening"))
    openings = openings.groupBy("before").agg(F.min("opening").alias("opening"))
    quarter = "cast(floor(length(text) / 4) as int)"
    both = known.join(openings, F.col("doc_id") == F.col("before")).select("doc_id", "text", F.expr(f"concat(left(text, length(text) - {quarter}), left(opening, {quarter}))").alias("edited"))
    return both, order


def _with_prints(both: DataFrame) -> DataFrame:
    """(doc_id, n_chars, edited_sha256, f0, f1, e0, e1) from (doc_id, text, edited)."""
    keyed = both.withColumn("key", F.xxhash64("text"))
    # Repeated rows vote once, or their terms would weigh more than those of a copy under another id.
    again = Window.partitionBy("doc_id", "key").orderBy(F.lit(1))
    once = keyed.withColumn("copy", F.row_number().over(again)).filter("copy = 1")
    sides = once.select("doc_id", "key", F.explode(F.array(F.struct(F.lit(0).alias("side"), "text"), F.struct(F.lit(1).alias("side"), F.col("edited").alias("text")))).alias("x"))
    prints = simhash(sides.select("doc_id", "key", "x.side", "x.text"), ["doc_id", "key", "side"])
    # Both sides of a row in one; the rows of doc_id are together, so this moves nothing.
    pair = prints.groupBy("doc_id", "key").agg(*[F.max(F.when(F.col("side") == side, F.col(f"f{half}"))).alias(f"{name}{half}") for side, name in ((0, "f"), (1, "e")) for half in (0, 1)])
    facts = keyed.select(F.col("doc_id").alias("id"), F.col("key").alias("k"), F.length("text").cast("long").alias("n_chars"), F.sha2("edited", 256).alias("edited_sha256"))
    return facts.join(pair, F.col("id").eqNullSafe(F.col("doc_id")) & (F.col("k") == F.col("key"))).select(F.col("id").alias("doc_id"), "n_chars", "edited_sha256", "f0", "f1", "e0", "e1")


def fingerprint_documents(docs: DataFrame, radius: int = 3, query_step: int = 50) -> DataFrame:
    """(doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next, n_near).

    n_near: for ids divisible by query_step, how many rows of the table (itself included) have a
    fingerprint within the radius, by the block tables; null for other rows.
    """
    both, order = edited_texts(docs)
    lost = docs.filter(F.col("doc_id").isNull()).select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    lost = lost.withColumn("edited", F.expr("left(text, length(text) - cast(floor(length(text) / 4) as int))"))
    prints = materialize(_with_prints(both).unionByName(_with_prints(lost)), "fingerprints")
    following = prints.filter(F.col("doc_id").isNotNull()).groupBy(F.col("doc_id").alias("next_id")).agg(F.min(F.struct("f0", "f1")).alias("x")).select("next_id", F.col("x.f0").alias("g0"), F.col("x.f1").alias("g1"))
    after = order.join(following, "next_id").select(F.col("doc_id").alias("of"), "g0", "g1")
    asked = prints.filter(F.col("doc_id") % query_step == 0)
    rows_of = prints.groupBy("f0", "f1").agg(F.count(F.lit(1)).alias("rows"))
    found = near_fingerprints(asked, prints, radius).join(rows_of, ["f0", "f1"]).groupBy("q0", "q1").agg(F.sum("rows").alias("n_near"))
    counted = materialize(found, "near-counts")
    hits = asked.select("doc_id", "f0", "f1").distinct().join(counted, (F.col("f0") == F.col("q0")) & (F.col("f1") == F.col("q1"))).select(F.col("doc_id").alias("asked"), F.col("f0").alias("a0"), F.col("f1").alias("a1"), "n_near")
    out = prints.join(after, F.col("doc_id") == F.col("of"), "left")
    out = out.join(hits, (F.col("doc_id") == F.col("asked")) & (F.col("f0") == F.col("a0")) & (F.col("f1") == F.col("a1")), "left")
    return out.select("doc_id", "n_chars", "edited_sha256", as_hex("f").alias("fingerprint"), as_hex("e").alias("edited_fingerprint"), likeness("f", "e").alias("near_edited"), likeness("f", "g").alias("near_next"), "n_near")


def op5_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprint_documents(table(spark, sf_dir, "documents"))
