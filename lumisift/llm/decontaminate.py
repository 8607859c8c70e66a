"""Benchmark decontamination by spaced seeds.

A mask such as 101000111 picks some of nine neighbouring words and ignores the others, so a hit
survives a substituted word wherever the mask has a zero. Each mask's picked words are hashed, test
and training hashes are joined, and around each hit the item is laid over the document: all its words
are compared in place, substitutions tolerated, and the overlap counts if any stretch of at least
LEAST_WORDS words has enough equal ones, wherever the others stand in it.

Only DataFrame functions are used. The words around a hit travel with it, so documents are never
shuffled. Benchmark hashes are broadcast in blocks of a fixed size, one block at a time; a larger
benchmark takes more passes over the documents, not a larger broadcast.

Nulls and edges: null texts are empty and match nothing; an item of fewer than LEAST_WORDS words, down
to one, is found where a document holds all of it unchanged; an item without words matches nothing;
masks longer than LEAST_WORDS are cut to it; of several overlaps of a document and an item the one with most equal words stays;
texts of any length are sought whole, and words that repeat cost the sum of both lengths, not their product;
repeated rows of documents or items give one row per (doc_id, item_id); null ids stay null; empty
tables give an empty result; other columns are left behind.
"""

from __future__ import annotations

from collections.abc import Callable
from fractions import Fraction

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .shared import materialize, table

#: Five of six, nine and seven words. Every stretch that counts as an overlap, of any length and with its
#: substitutions anywhere, holds the picked words of one of them (the tests go through all stretches).
MASKS = ("111011", "101000111", "1111001")
#: Benchmark hashes broadcast at once, about 40 bytes each.
BLOCK_SEEDS = 1_000_000
#: An overlap has at least this many words, of which this share at least is equal.
LEAST_WORDS, LEAST_SHARE = 10, 0.8
_SPACES = " \t\n\x0b\f\r"


def word_hashes(text: str) -> Column:
    """Hashes of the lower-cased words of a text, in order; one hash of nothing for a text without words."""
    words = F.split(F.lower(F.btrim(F.coalesce(text, F.lit("")), F.lit(_SPACES))), r"[\x20\x09-\x0D]+")
    return F.transform(words, lambda w: F.xxhash64(w))


def with_seeds(words: DataFrame, masks: list[str]) -> DataFrame:
    """A row (..., n, at, h, before) for every mask and position (0-based) of the array column `words` that the mask fits; before: the hash one position earlier, null at the start."""
    least = min(map(len, masks))
    # No filter on n: pushed below the projection, it would hash all words twice.
    at = words.withColumn("n", F.size("words")).withColumn("at", F.explode(F.when(F.col("n") >= least, F.sequence(F.lit(0), F.col("n") - least))))
    seed = lambda m, start: F.xxhash64(F.lit(m), *[F.get("words", start + i) for i, bit in enumerate(m) if bit == "1"])
    seeds = [F.when(F.col("at") + len(m) <= F.col("n"), F.struct(seed(m, F.col("at")).alias("h"), F.when(F.col("at") > 0, seed(m, F.col("at") - 1)).alias("before"))) for m in masks]
    return at.withColumn("seed", F.explode(F.array(*seeds))).filter(F.col("seed").isNotNull()).select(*at.columns, "seed.h", "seed.before")


def _let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body(value), with value evaluated once even where body uses it inside lambdas."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def best_stretch(a: Column, b: Column, share: float, least: int) -> Column:
    """array<struct<equal, words, start>>: of two aligned arrays, the stretch of at least `least` words and that share equal.

    The one with most equal words, then fewest words, then the first; an empty array if there is none.
    Of the equal elements k <= l at places p, the stretch from one to the other has the share if
    t(l) <= t(k) + den - num, with t(k) = num * p(k) - den * k and share = num / den. Only rising maxima
    of t can begin a longest stretch and only falling minima from the right can end one.
    """
    num, den = Fraction(str(share)).as_integer_ratio()
    none = F.from_json(F.lit("[]"), "array<struct<i:int,t:bigint>>")
    best = "array<struct<equal:int,words:int,start:int>>"

    def records(t: Column, further: Callable[[Column, Column], Column]) -> Column:
        top = lambda s: F.get(s, F.size(s) - 1)["t"]
        return F.aggregate(t, none, lambda s, x: F.when((F.size(s) == 0) | further(x["t"], top(s)), F.concat(s, F.array(x))).otherwise(s))

    def longest(t: Column) -> Column:
        ends = records(F.reverse(t), lambda new, old: new < old)
        begin = lambda r, end: F.get(F.filter(r, lambda k: k["t"] + (den - num) >= end["t"]), F.lit(0))["i"]
        return _let(records(t, lambda new, old: new > old), lambda r: F.array_max(F.transform(ends, lambda end: end["i"] - begin(r, end) + 1)))

    def place(hits: Column, p: Column, equal: Column) -> Column:
        def at(v: Column, k: Column) -> Column:
            words = F.greatest(F.get(p, k + equal - 1) - v + 1, F.lit(least))
            return F.struct(words.alias("words"), F.least(v, F.size(hits) - words).alias("start"))

        one = F.array_min(F.transform(F.slice(p, F.lit(1), F.size(p) - equal + 1), at))
        return F.array(F.struct(equal.alias("equal"), one["words"].alias("words"), one["start"].alias("start")))

    def search(hits: Column) -> Column:
        places = F.filter(F.transform(hits, lambda hit, i: F.when(hit, i)), lambda i: i.isNotNull())
        enough = -(-num * least // den)

        def among(p: Column) -> Column:
            t = F.transform(p, lambda v, i: F.struct(i.alias("i"), (v.cast("long") * num - i.cast("long") * den).alias("t")))
            return _let(_let(t, longest), lambda equal: F.when(equal >= enough, place(hits, p, equal)))

        return _let(places, lambda p: F.when((F.size(hits) >= least) & (F.size(p) >= enough), among(p)))

    found = _let(F.zip_with(a, b, lambda x, y: x == y), search)
    return F.coalesce(found, F.from_json(F.lit("[]"), best))


def find_overlaps(docs: DataFrame, benchmark: DataFrame, *, least_words: int = LEAST_WORDS, least_share: float = LEAST_SHARE, masks: tuple[str, ...] = MASKS, block_seeds: int = BLOCK_SEEDS) -> DataFrame:
    """(key, doc_id, item_id, start, words, equal, item_words): the best overlap of each document row and item.

    docs: (key, doc_id, text); benchmark: (item_id, text). start is the overlap's first word in the document.
    """
    named = materialize(benchmark.select("item_id", word_hashes("text").alias("words")).filter(F.coalesce("text", F.lit("")).rlike(r"[^\x20\x09-\x0D]")).distinct(), "bench-named")
    # Items of one text are sought once.
    items = materialize(named.select("words").distinct().withColumn("item", F.monotonically_increasing_id()), "bench-items")
    named = named.join(items, "words").select("item", "item_id")
    # Items too short for an overlap are sought whole: at most least_words - 1 lengths.
    is_short = F.size("words") < least_words
    short = sorted(r["n"] for r in items.filter(is_short).select(F.size("words").alias("n")).distinct().collect())
    masks = sorted({m[:least_words] for m in masks})
    whole = ["1" * n for n in short]
    used = [*masks, *(m for m in whole if m not in masks)]
    seeds = with_seeds(items.filter(~is_short).select("item", "words"), masks)
    for m in whole:
        seeds = seeds.unionByName(with_seeds(items.filter(F.size("words") == len(m)).select("item", "words"), [m]))
    tests = materialize(seeds.select("h", F.col("before").alias("item_before"), "item", F.col("at").alias("item_at"), F.col("n").alias("item_words")), "bench-seeds")
    blocks = -(-max(1, tests.count()) // block_seeds)
    words = docs.select("key", "doc_id", word_hashes("text").alias("words"))
    found = None
    for block in range(blocks):
        # By hash, item and place, so that a seed of very many items is spread over all blocks.
        part = F.broadcast(tests.filter(F.pmod(F.xxhash64("h", "item", "item_at"), F.lit(blocks)) == block))
        # A hit whose place before is a hit too lays the item the same way: only the first of such a row counts. So
        # a word that repeats n times in a document and m times in an item lays it n + m ways, not n * m times.
        first = F.col("before").isNull() | F.col("item_before").isNull() | (F.col("before") != F.col("item_before"))
        seeded = with_seeds(words, used).withColumnRenamed("h", "seed")
        hits = seeded.join(part, (F.col("seed") == F.col("h")) & first)
        # The item laid over the document: its words from `skip` on meet the document's from `begin` on.
        lag = F.col("at") - F.col("item_at")
        hits = hits.select("key", "doc_id", "item", "item_words", F.greatest(lag, F.lit(0)).alias("begin"), F.greatest(-lag, F.lit(0)).alias("skip"), "words")
        hits = hits.select("key", "doc_id", "item", "item_words", "begin", "skip", F.slice("words", F.col("begin") + 1, F.col("item_words") - F.col("skip")).alias("laid"))
        if blocks > 1:  # written before the next block is broadcast, so that one block at a time is held
            hits = materialize(hits.distinct(), "bench-hits")
        found = hits if found is None else found.unionByName(hits)
    laid = found.distinct().join(items, "item")
    laid = laid.withColumn("under", F.slice("words", F.col("skip") + 1, F.size("laid")))
    entire = F.array(F.struct(F.col("item_words").alias("equal"), F.col("item_words").alias("words"), F.lit(0).alias("start")))
    equal = F.when(F.col("laid") == F.col("words"), entire)
    stretch = F.when(F.col("item_words") < least_words, equal).otherwise(best_stretch(F.col("laid"), F.col("under"), least_share, least_words))
    laid = laid.select("key", "doc_id", "item", "item_words", "begin", F.inline(stretch))
    best = F.max(F.struct("equal", (-F.col("words")).alias("w"), (-(F.col("begin") + F.col("start"))).alias("s"), "item_words")).alias("b")
    best = laid.groupBy("key", "doc_id", "item").agg(best).join(named, "item")
    return best.select("key", "doc_id", "item_id", (-F.col("b.s")).alias("start"), (-F.col("b.w")).alias("words"), F.col("b.equal").alias("equal"), F.col("b.item_words").alias("item_words"))


def _key() -> Column:
    """128 bits of id and text."""
    return F.md5(F.concat(F.coalesce(F.col("doc_id").cast("string"), F.lit("null")), F.lit(":"), F.coalesce("text", F.lit(""))))


def _keyed(docs: DataFrame) -> DataFrame:
    return docs.withColumn("key", _key())


def drop_contaminated(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The documents that overlap no benchmark item, with the columns of docs."""
    hits = find_overlaps(_keyed(docs.select("doc_id", "text")), benchmark.select("item_id", "text"))
    hits = materialize(hits.select(F.col("key").alias("_key")).distinct(), "contaminated")
    own = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), _key().alias("_key"))
    return own.join(hits, "_key", "left_anti").select(*[F.col("row")[c].alias(c) for c in docs.columns])


def op8_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The overlaps: only documents that hold benchmark passages appear."""
    found = find_overlaps(_keyed(table(spark, sf_dir, "documents").select("doc_id", "text")), table(spark, sf_dir, "benchmark").select("item_id", "text"))
    best = F.max(F.struct("equal", (-F.col("words")).alias("w"), (-F.col("start")).alias("s"), "item_words")).alias("b")
    best = found.groupBy("doc_id", "item_id").agg(best)
    return best.select("doc_id", "item_id", (-F.col("b.s")).alias("start_word"), (-F.col("b.w")).alias("n_words"), F.col("b.equal").alias("n_equal"), F.col("b.item_words").alias("item_words"))
