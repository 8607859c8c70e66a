"""Product codes of vectors, trained by rounds of nearest-entry assignment over per-dimension dictionaries.

Components become integers. Vectors are dealt to blocks once; a block keeps, for every dimension, the
sorted distinct integers that occur (the dictionary) and each vector's place in it. A round tabulates, for
each dimension, the squared difference of every distinct integer to every entry of the codebook; the
distance of a part to an entry is then gathered from these tables by dictionary code and added up over
the part's dimensions. All sums are integers, so results don't depend on how vectors are dealt.

Blocks are written once and read in each round; a round shuffles one row of sums per task, part and entry,
and the driver sees the codebooks alone (parts x entries x dimensions, all parameters).

Nulls and edges: a vector that is null, holds a null, NaN or infinite component, is empty, or whose length
isn't the length of the first kept vector (smallest vec_id, null ids last, then by components) is dropped;
if that length isn't a multiple of the number of parts, the last parts are one dimension shorter; with
fewer vectors than entries every vector is an entry; an empty table gives an empty result. Components
saturate where a sum of squares could pass a long (|x| over 46,000 at 64 dimensions); a label's sum that
passes a long is null. Ties go to the lower index. Repeated rows and null ids are coded like others; null
labels are one label; other columns, whatever their names, are left behind.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .shared import materialize, table


@dataclass(frozen=True)
class VectorCodeSettings:
    parts: int = 8
    entries: int = 16
    rounds: int = 6
    scale: int = 4096


#: Vectors and components of a block at most; a dictionary code takes two bytes.
BLOCK, BLOCK_VALUES = 16_384, 1 << 22


def usable(vec: str) -> Column:
    """Whether a vector is there, not empty, and all its components are finite."""
    finite = lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf"))
    return F.coalesce((F.size(vec) > 0) & F.forall(vec, finite), F.lit(False))


def as_integers(vec: str, scale: int) -> Column:
    """floor(scale * x) of every component, saturated so that no error passes a long."""
    limit = F.sqrt(F.lit(float((1 << 63) - 1)) / F.size(vec)) / 2 - 1
    return F.transform(vec, lambda x: F.greatest(F.least(F.floor(F.least(F.greatest(x.cast("double"), F.lit(-1e18 / scale)), F.lit(1e18 / scale)) * scale), F.floor(limit)), -F.floor(limit)))


def part_edges(dims: int, parts: int) -> list[int]:
    """Where the consecutive parts of a vector begin and end."""
    return [0, *np.cumsum([len(x) for x in np.array_split(np.arange(dims), parts)]).tolist()]


def encode_block(vectors: np.ndarray) -> tuple[list[np.ndarray], np.ndarray]:
    """Per dimension the ascending distinct integers, and every vector's places in them (vectors x dimensions)."""
    pairs = [np.unique(column, return_inverse=True) for column in vectors.T]
    return [values for values, _ in pairs], np.stack([code for _, code in pairs], axis=1).astype(np.uint16)


def nearest(dictionaries: list[np.ndarray], codes: np.ndarray, book: np.ndarray, dims: range) -> tuple[np.ndarray, np.ndarray]:
    """Each vector's nearest entry of one part and the squared distance; book: entries x dimensions of the part."""
    apart = np.zeros((len(codes), len(book)), np.int64)
    for i, d in enumerate(dims):
        squares = (dictionaries[d][:, None] - book[:, i]) ** 2
        apart += squares[codes[:, d]]
    best = apart.argmin(axis=1)
    return best, apart[np.arange(len(codes)), best]


def blocks(vectors: DataFrame, dims: int) -> DataFrame:
    """Rows (ids, labels, sizes, entries binary, codes binary), one per block, of a table (vec_id, label, ints)."""
    kinds = {c: vectors.schema[c].dataType.simpleString() for c in ("vec_id", "label")}
    most = max(1, min(BLOCK, BLOCK_VALUES // dims))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []

        def block(rows: pa.Table) -> pa.RecordBatch:
            flat = rows.column("ints").combine_chunks().flatten().to_numpy().reshape(-1, dims)
            dictionaries, codes = encode_block(flat)
            one = lambda x: pa.ListArray.from_arrays(pa.array([0, len(x)], pa.int32()), x)
            sizes = pa.array([len(x) for x in dictionaries], pa.int32())
            columns = [one(rows.column(c).combine_chunks()) for c in ("vec_id", "label")]
            return pa.RecordBatch.from_arrays([*columns, one(sizes), pa.array([np.concatenate(dictionaries).tobytes()]), pa.array([codes.tobytes()])], names=["ids", "labels", "sizes", "entries", "codes"])

        for batch in batches:
            rows = pa.Table.from_batches([*held, batch])
            cut = rows.num_rows - rows.num_rows % most
            for at in range(0, cut, most):
                yield block(rows.slice(at, most))
            held = rows.slice(cut).to_batches()
        if held:
            yield block(pa.Table.from_batches(held))

    schema = f"ids array<{kinds['vec_id']}>, labels array<{kinds['label']}>, sizes array<int>, entries binary, codes binary"
    return vectors.select("vec_id", "label", "ints").mapInArrow(run, schema)


def _opened(batch: pa.RecordBatch, dims: int) -> Iterator[tuple[int, list[np.ndarray], np.ndarray]]:
    """(row, dictionaries, codes) of each block in a batch."""
    for i in range(batch.num_rows):
        cuts = np.cumsum(batch.column("sizes")[i].as_py())[:-1]
        dictionaries = np.split(np.frombuffer(batch.column("entries")[i].as_buffer(), np.int64), cuts)
        yield i, dictionaries, np.frombuffer(batch.column("codes")[i].as_buffer(), np.uint16).reshape(-1, dims)


def part_sums(held: DataFrame, books: list[np.ndarray], edges: list[int]) -> DataFrame:
    """(part, entry, n, sums array<long>): number and componentwise sums of the parts nearest to each entry."""
    dims = edges[-1]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        totals = [[np.zeros(len(b), np.int64), np.zeros(b.shape, np.int64)] for b in books]
        for batch in batches:
            for _, dictionaries, codes in _opened(batch, dims):
                for (n, sums), book, a, b in zip(totals, books, edges, edges[1:], strict=False):
                    best, _ = nearest(dictionaries, codes, book, range(a, b))
                    n += np.bincount(best, minlength=len(book))
                    for i, d in enumerate(range(a, b)):
                        # A table of how often each distinct integer fell to each entry; sums stay exact integers.
                        often = np.bincount(best * len(dictionaries[d]) + codes[:, d], minlength=len(book) * len(dictionaries[d]))
                        sums[:, i] += often.reshape(len(book), -1) @ dictionaries[d]
        rows = [(p, e, int(n[e]), sums[e].tolist()) for p, (n, sums) in enumerate(totals) for e in range(len(n)) if n[e]]
        part, entry, n, sums = ([r[i] for r in rows] for i in range(4))
        yield pa.RecordBatch.from_arrays([pa.array(part, pa.int32()), pa.array(entry, pa.int32()), pa.array(n, pa.int64()), pa.array(sums, pa.list_(pa.int64()))], names=["part", "entry", "n", "sums"])

    found = held.select("sizes", "entries", "codes").mapInArrow(run, "part int, entry int, n long, sums array<long>")
    # One column per dimension of a part: a sum of arrays needs no explode that way.
    wide = max(b - a for a, b in zip(edges, edges[1:], strict=False))
    columns = [F.sum(F.coalesce(F.try_element_at("sums", F.lit(i + 1)), F.lit(0))).alias(f"s{i}") for i in range(wide)]
    summed = found.groupBy("part", "entry").agg(F.sum("n").alias("n"), *columns)
    return summed.select("part", "entry", "n", F.array(*[f"s{i}" for i in range(wide)]).alias("sums"))


def train(held: DataFrame, first: np.ndarray, settings: VectorCodeSettings) -> list[np.ndarray]:
    """The codebooks after all rounds, one array (entries x dimensions) per part; they start as the rows of `first`."""
    edges = part_edges(first.shape[1], settings.parts)
    books = [first[:, a:b].copy() for a, b in zip(edges, edges[1:], strict=False)]
    for _ in range(settings.rounds):
        for r in part_sums(held, books, edges).collect():  # at most parts x entries rows
            book = books[r["part"]]
            book[r["entry"]] = np.array(r["sums"][: book.shape[1]], np.int64) // r["n"]
    return books


def decode(codes: np.ndarray, books: list[np.ndarray], scale: int = VectorCodeSettings.scale) -> np.ndarray:
    """Vectors (rows x dimensions) that the codes (rows x parts) stand for."""
    return np.concatenate([book[codes[:, p]] for p, book in enumerate(books)], axis=1) / scale


def compress_vectors(vectors: DataFrame, settings: VectorCodeSettings | None = None, vec_col: str = "embedding") -> tuple[DataFrame, list[np.ndarray]]:
    """(vec_id, label, code, error) per kept vector, and the codebooks, one per part."""
    settings = settings or VectorCodeSettings()
    kinds = {c: vectors.schema[c].dataType.simpleString() for c in ("vec_id", "label")}
    schema = f"vec_id {kinds['vec_id']}, label {kinds['label']}, code string, error long"
    known = vectors.filter(usable(vec_col)).select("vec_id", "label", as_integers(vec_col, settings.scale).alias("ints"))
    order = [F.col("vec_id").asc_nulls_last(), "ints"]
    lead = known.select("vec_id", F.size("ints").alias("dims"), "ints").orderBy(*order).limit(1).collect()
    if not lead:
        return vectors.sparkSession.createDataFrame([], schema), []
    dims = lead[0]["dims"]
    known = known.filter(F.size("ints") == dims)
    first = np.array([r["ints"] for r in known.select("vec_id", "ints").orderBy(*order).limit(settings.entries).collect()], np.int64)
    held = materialize(blocks(known, dims), "vector-blocks")
    books = train(held, first, settings)
    edges = part_edges(dims, settings.parts)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        digits = np.array([f"{i:0{2 if settings.entries <= 256 else 4}x}" for i in range(settings.entries)])
        for batch in batches:
            for i, dictionaries, codes in _opened(batch, dims):
                total, text = np.zeros(len(codes), np.int64), np.full(len(codes), "", dtype="U1")
                for book, a, b in zip(books, edges, edges[1:], strict=False):
                    best, apart = nearest(dictionaries, codes, book, range(a, b))
                    total += apart
                    text = np.char.add(text, digits[best])
                yield pa.RecordBatch.from_arrays([batch.column("ids")[i].values, batch.column("labels")[i].values, pa.array(text, pa.string()), pa.array(total)], names=["vec_id", "label", "code", "error"])

    return held.mapInArrow(run, schema), books


def codebooks_digest(books: list[np.ndarray]) -> str:
    """Lower-case hex SHA-256 of all entries' integers by part, entry and position, with commas between them."""
    return hashlib.sha256(",".join(str(x) for book in books for x in book.reshape(-1).tolist()).encode()).hexdigest()


def op12_vector_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    coded, books = compress_vectors(table(spark, sf_dir, "embeddings"))
    coded = materialize(coded, "vector-codes")
    sums = coded.groupBy(F.col("label").alias("of")).agg(F.try_sum("error").alias("label_error"))
    # Written first: its size is then known, and a hot label is no skewed join where it is small.
    sums = materialize(sums, "vector-labels")
    out = coded.join(sums, F.col("label").eqNullSafe(F.col("of")))
    return out.select("vec_id", "code", "error", "label_error", F.lit(codebooks_digest(books)).alias("codebooks_sha256"))


def _op12_sql(parts: int = 8, entries: int = 16, rounds: int = 6) -> str:
    """One pair of tables per round: the nearest entry of every part, and the entries that follow from it."""
    near = "SELECT vec_id, row_id, part, arg_min(entry, d * {n} + entry) AS entry, min(d) AS d FROM (SELECT p.vec_id, p.row_id, p.part, b.entry, list_sum(list_transform(range(1, len(v) + 1), lambda i: (v[i] - e[i]) * (v[i] - e[i]))) AS d FROM pieces p JOIN book{r} b ON p.part = b.part) GROUP BY ALL"
    steps = []
    for r in range(rounds):
        steps.append(f"near{r} AS MATERIALIZED ({near.format(n=entries, r=r)})")
        steps.append(
            f"sums{r} AS (SELECT n.part, n.entry, i, sum(v[i]) AS s, count(*) AS c FROM near{r} n JOIN pieces p ON n.row_id = p.row_id AND n.part = p.part, range(1, 1 + (SELECT max(len(v)) FROM pieces)) t(i) GROUP BY ALL),\n"
            f"means{r} AS (SELECT part, entry, list(((s - (s % c + c) % c) // c)::BIGINT ORDER BY i) AS e FROM sums{r} GROUP BY ALL),\n"
            f"book{r + 1} AS MATERIALIZED (SELECT b.part, b.entry, coalesce(m.e, b.e) AS e FROM book{r} b LEFT JOIN means{r} m ON b.part = m.part AND b.entry = m.entry)")
    steps.append(f"near{rounds} AS MATERIALIZED ({near.format(n=entries, r=rounds)})")
    body = ",\n".join(steps)
    return f"""
WITH kept AS MATERIALIZED (
  SELECT vec_id, label, row_number() OVER (ORDER BY vec_id) AS row_id, list_transform(embedding, lambda x: floor(4096 * x::DOUBLE)::BIGINT) AS ints
  FROM embeddings WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
pieces AS MATERIALIZED (SELECT vec_id, row_id, part, ints[part * (len(ints) // {parts}) + 1 : (part + 1) * (len(ints) // {parts})] AS v FROM kept, range({parts}) t(part)),
book0 AS MATERIALIZED (SELECT part, row_id - 1 AS entry, v AS e FROM pieces WHERE row_id <= {entries}),
{body},
coded AS (SELECT row_id, string_agg(printf('%02x', entry), '' ORDER BY part) AS code, sum(d) AS error FROM near{rounds} GROUP BY row_id),
digest AS (SELECT sha256(string_agg(x::VARCHAR, ',' ORDER BY part, entry, i)) AS h FROM (SELECT part, entry, unnest(e) AS x, generate_subscripts(e, 1) AS i FROM book{rounds}))
SELECT vec_id, code, error::BIGINT AS error, sum(error) OVER (PARTITION BY label)::BIGINT AS label_error, h AS codebooks_sha256
FROM kept JOIN coded USING (row_id), digest
"""


OP12_SQL = _op12_sql()
