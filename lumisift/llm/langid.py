"""Language ID by compression: the language whose dictionary makes a text smallest.

A zstandard raw-content dictionary per language is cut from a bounded sample of labelled texts. A
text is lower-cased, reduced to runs of letters and encoded block by block against every dictionary,
each block after a short carrier of the same language, so that even one word changes the size by what
it costs; the fewest bytes beyond the carriers win. A narrow margin between the two best rejects the text.

Nulls and edges: a null text, an empty one or one without a letter is `und` with score 0, and
rejected; ties go to the language that sorts first; without a labelled row every text is `und`; very
long texts are encoded whole, in blocks; repeated rows are predicted alike.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import regex
import zstandard as zstd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import words as W
from .shared import table

_LETTERS = regex.compile(r"\p{L}[\p{L}\p{M}]*")
UNKNOWN = "und"


@dataclass(frozen=True)
class LangIdSettings:
    """sample_docs pieces of at most sample_chars characters are read for each language (the bound of
    the fit); dict_bytes of their letters make its carrier and dictionary. min_margin: the least relative gap
    between the two smallest encodings, and min_letters the fewest letters, of an accepted text."""

    sample_docs: int = 240
    sample_chars: int = 1500
    dict_bytes: int = 110_000
    level: int = 6
    block_bytes: int = 4096
    carrier_bytes: int = 600
    min_margin: float = 0.004
    seed: int = 5


def letters_only(text: str) -> bytes:
    return " ".join(_LETTERS.findall(text.lower())).encode("utf-8", "replace")


def _compressor(content: bytes, settings: LangIdSettings) -> zstd.ZstdCompressor:
    params = zstd.ZstdCompressionParameters.from_level(
        settings.level, source_size=settings.block_bytes + settings.carrier_bytes, dict_size=len(content), format=zstd.FORMAT_ZSTD1_MAGICLESS,
        write_content_size=False, write_checksum=False, write_dict_id=False)
    made = zstd.ZstdCompressionDict(content, dict_type=zstd.DICT_TYPE_RAWCONTENT)
    made.precompute_compress(compression_params=params)
    return zstd.ZstdCompressor(dict_data=made, compression_params=params)


def fit(docs: DataFrame, lang_col: str = "lang", text_col: str = "text", id_col: str = "doc_id", settings: LangIdSettings = LangIdSettings()) -> dict[str, bytes]:
    """A dictionary per language, from a hash-chosen sample whose size does not depend on the corpus.

    The rate of the sample follows from a count by language; repeated texts are drawn once, and of the
    rows drawn the first 3 * sample_docs in hash order reach the driver, for each language in the data.
    """
    rows = docs.filter(F.col(lang_col).isNotNull() & F.col(text_col).isNotNull()).select(F.col(lang_col).alias("lang"), F.col(text_col).alias("text"), F.col(id_col).alias("id"))
    counts = {r["lang"]: r["count"] for r in rows.groupBy("lang").count().collect()}
    if not counts:
        return {}
    spread = 1 << 20
    rate = F.create_map(*[x for lang, n in sorted(counts.items()) for x in (F.lit(lang), F.lit(min(spread, spread * 3 * settings.sample_docs // n + 1)))])
    rows = rows.withColumn("h", F.xxhash64(F.lit(settings.seed), "id", "text")).filter(F.pmod("h", F.lit(spread)) < rate[F.col("lang")])
    # A piece from anywhere in the text, so that common openings don't fill the dictionary.
    at = F.pmod(F.shiftrightunsigned("h", 20), F.greatest(F.length("text") - settings.sample_chars, F.lit(0)) + 1) + 1
    once = rows.select("lang", "h", F.substring("text", at.cast("int"), F.lit(settings.sample_chars)).alias("piece")).dropDuplicates(["lang", "h"])
    place = F.row_number().over(Window.partitionBy("lang").orderBy("h"))
    drawn = once.withColumn("place", place).filter(F.col("place") <= 3 * settings.sample_docs).collect()
    pieces = defaultdict(dict)
    for r in sorted(drawn, key=lambda r: (r["lang"], r["h"], r["piece"])):
        clean = letters_only(r["piece"])
        if clean and len(pieces[r["lang"]]) < settings.sample_docs:
            pieces[r["lang"]].setdefault(clean)
    out = {}
    for lang, found in pieces.items():
        if found:
            out[lang] = b" ".join(found)[-settings.dict_bytes :].ljust(8, b" ")
    return out


@dataclass(frozen=True)
class Codec:
    """A language's compressor, its carrier, and the carrier's own size."""

    compressor: zstd.ZstdCompressor
    carrier: bytes
    alone: int

    @classmethod
    def of(cls, content: bytes, settings: LangIdSettings) -> Codec:
        cut = min(settings.carrier_bytes, len(content) // 4)
        made = _compressor(content[cut:], settings)
        return cls(made, content[:cut] + b" ", len(made.compress(content[:cut] + b" ")))

    def size(self, text: bytes, block: int) -> int:
        return sum(max(1, len(self.compressor.compress(self.carrier + text[i : i + block])) - self.alone) for i in range(0, len(text), block))


def _encoded_sizes(text: bytes, codecs: list[Codec], block: int) -> np.ndarray:
    return np.array([c.size(text, block) for c in codecs], np.int64)


def decide(sizes: np.ndarray) -> tuple[int, float, float]:
    """Index of the best, the posterior of its code length (0 to 1), and the relative margin to the second."""
    best = int(np.argmin(sizes))
    if len(sizes) == 1:
        return best, 1.0, 1.0
    rest = np.delete(sizes, best)
    margin = float(rest.min() - sizes[best]) / float(rest.min())
    # A byte more is 8 bits less likely; the codec's byte grain and repeats within a text speak for a softer scale.
    score = 1.0 / (1.0 + float(np.exp(-(rest - sizes[best]) / 2.0).sum()))
    return best, score, margin


def predict(docs: DataFrame, model: dict[str, bytes], text_col: str = "text", settings: LangIdSettings = LangIdSettings(), prefix: str = "lang_") -> DataFrame:
    """All columns of docs, then lang_pred, lang_score, lang_margin, lang_rejected (any of those names in docs is replaced; prefix gives others)."""
    names = sorted(model)
    added = [f"{prefix}{x}" for x in ("pred", "score", "margin", "rejected")]
    keep = [c for c in docs.columns if c not in added]
    shared = docs.sparkSession.sparkContext.broadcast([model[n] for n in names])  # dict_bytes for each learned language
    schema = docs.select(*[F.col(f"`{c}`") for c in keep]).schema
    out_schema = schema
    for name, kind in zip(added, ("string", "double", "double", "boolean"), strict=True):
        out_schema = out_schema.add(name, kind)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codecs = [Codec.of(x, settings) for x in shared.value]
        for batch in W.small_batches(batches, text_col):
            got: list[tuple] = []
            for text in batch.column(text_col):
                clean = letters_only(text.as_py() or "")
                if not clean or not codecs:
                    got.append((UNKNOWN, 0.0, 0.0, True))
                    continue
                best, score, margin = decide(_encoded_sizes(clean, codecs, settings.block_bytes))
                got.append((names[best], score, margin, margin < settings.min_margin))
            cols = list(zip(*got, strict=True)) if got else [[]] * 4
            extra = [pa.array(c, t) for c, t in zip(cols, (pa.string(), pa.float64(), pa.float64(), pa.bool_()), strict=True)]
            yield pa.RecordBatch.from_arrays([*batch.columns, *extra], names=[*batch.schema.names, *added])

    return docs.select(*[F.col(f"`{c}`") for c in keep]).mapInArrow(run, out_schema)


def fold(id_col: str, n: int) -> Column:
    """crc32 of the id as text, modulo n; null for a null id."""
    return F.crc32(F.col(id_col).cast("string").cast("binary")) % n


def op1_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A null doc_id has no fold: it is neither learned from nor held out."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    held = F.coalesce(fold("doc_id", 4) == 2, F.lit(False))
    model = fit(docs.filter(fold("doc_id", 4) != 2))
    out = predict(docs.select("doc_id", held.alias("held_out"), "text"), model)
    return out.select("doc_id", "held_out", "lang_pred", F.col("lang_score").alias("score"), F.col("lang_margin").alias("margin"), F.col("lang_rejected").alias("rejected"))


def accept_known(docs: DataFrame) -> DataFrame:
    """Pipeline stage: learn from all labelled rows, drop documents whose language is rejected, keep the columns."""
    prefix = "lang_"
    while any(c.startswith(prefix) for c in docs.columns):
        prefix += "_"
    return predict(docs, fit(docs), prefix=prefix).filter(f"not `{prefix}rejected`").select(*[f"`{c}`" for c in docs.columns])
