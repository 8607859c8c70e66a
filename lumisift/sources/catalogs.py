"""Reference catalogs: fixed-width text, CSV id lists and machine-readable tables with a byte-by-byte head."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.exprs import find_id_column
from ..functions.nulls import to_double, to_long
from .scratch import exists

#: Fixed values: (name, first byte, last byte, type) of the stellar catalog, bytes counted from 1.
STELLAR_LAYOUT = [
    ("tic_id", 1, 10, "long"),
    ("doyle_gaia_dr3", 12, 30, "long"),
    ("doyle_gaia_dr2", 32, 50, "long"),
    ("doyle_ra_deg", 52, 72, "double"),
    ("doyle_dec_deg", 74, 95, "double"),
    ("doyle_n_sectors", 97, 98, "long"),
    ("doyle_parallax", 100, 120, "double"),
    ("doyle_parallax_error", 122, 142, "double"),
    ("doyle_parallax_over_error", 144, 166, "double"),
    ("doyle_g_mag", 168, 186, "double"),
    ("doyle_bp_rp", 188, 209, "double"),
    ("doyle_rv", 211, 232, "double"),
    ("doyle_rv_error", 234, 253, "double"),
    ("doyle_teff", 255, 273, "double"),
    ("doyle_logg", 275, 292, "double"),
    ("doyle_ruwe", 294, 312, "double"),
    ("doyle_nss", 314, 314, "long"),
    ("doyle_abs_g_mag", 316, 337, "double"),
    ("doyle_radius", 339, 358, "double"),
    ("doyle_min_noise", 360, 373, "double"),
    ("doyle_two_radius", 375, 396, "double"),
]


def parse_fixed_width(lines: DataFrame, layout: list[tuple[str, int, int, str]], *, id_col: str | None = "tic_id", text_col: str = "value") -> DataFrame:
    """Columns cut from lines; blanks are null; rows without an id are dropped."""
    cast = {"long": to_long, "double": to_double, "string": lambda c: F.nullif(c, F.lit(""))}
    cells = [cast[kind](F.trim(F.substring(F.col(text_col), start, stop - start + 1))).alias(name) for name, start, stop, kind in layout]
    out = lines.select(*cells)
    return out.filter(F.col(id_col).isNotNull()) if id_col else out


def read_fixed_width(spark: SparkSession, path: str, layout: list[tuple[str, int, int, str]] = STELLAR_LAYOUT, *, id_col: str | None = "tic_id", partitions: int | None = None) -> DataFrame:
    """A fixed-width file, plain or gzipped; a missing file raises. Gzip is read by one task, so deal its rows out and keep them as Parquet."""
    lines = spark.read.text(path)
    return parse_fixed_width(lines.repartition(partitions) if partitions else lines, layout, id_col=id_col)


def with_ids(rows: DataFrame, column: str = "TIC", out: str = "ticId") -> tuple[DataFrame, DataFrame]:
    """(rows with a usable id as a long, one row with the number dropped). No such column raises KeyError."""
    if column not in rows.columns:
        raise KeyError(f"{column} is not among {rows.columns}")
    marked = rows.withColumn(out, to_long(F.trim(F.col(column).cast("string"))))
    return marked.filter(F.col(out).isNotNull()), marked.agg(F.count_if(F.col(out).isNull()).alias("n_dropped"))


def read_id_csv(spark: SparkSession, path: str, column: str | None = "TIC") -> DataFrame:
    """A CSV catalog with its id as ticId; column None finds the id column by name."""
    rows = spark.read.csv(path, header=True)
    return with_ids(rows, column or find_id_column(rows.columns) or "TIC")[0]


_RULE = re.compile(r"^[-=]{10,}\s*$", re.ASCII)
_HEAD_LINE = re.compile(r"^\s*(?:(\d+)\s*-\s*)?(\d+)\s+([AIFE])[\d.]*\s+\S+\s+(\S+)")


def mrt_layout(head: list[str]) -> list[tuple[str, int, int, str]]:
    """The layout that a byte-by-byte description gives."""
    kinds = {"A": "string", "I": "long", "F": "double", "E": "double"}
    found = [m for m in map(_HEAD_LINE.match, head) if m]
    return [(m[4], int(m[1] or m[2]), int(m[2]), kinds[m[3]]) for m in found]


def parse_mrt(body: DataFrame, head: list[str], column: str = "TIC", text_col: str = "value") -> DataFrame:
    """Rows of a machine-readable table, laid out by the lines of its head, with ids as ticId; blank lines are no rows."""
    rows = parse_fixed_width(body.filter(F.trim(text_col) != ""), mrt_layout(head), id_col=None, text_col=text_col)
    return with_ids(rows, column)[0]


#: More lines than any table has columns: the most that a description may have.
MRT_COLUMNS = 10_000


def numbered_lines(spark: SparkSession, path: str) -> DataFrame:
    """(value, file, place) of the lines of text files; places rise with the lines of a file: where its block begins, then the line's turn in its task."""
    lines = spark.read.text(path).select("value", F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("turn"))
    return lines.select("value", "file", F.struct("block", "turn").alias("place"))


def mrt_description(lines: DataFrame) -> list[str]:
    """The lines of the byte-by-byte description of the first file that has one: those between the second and third rule after its title."""
    first = lambda df: df.orderBy("file", "place")
    title = first(lines.filter(F.col("value").startswith("Byte-by-byte"))).limit(1).collect()
    if not title:
        return []
    at = lambda r: F.struct(*[F.lit(r["place"][x]).cast("long").alias(x) for x in ("block", "turn")])
    own = lines.filter(F.col("file") == title[0]["file"])
    rules = first(own.filter(F.col("value").rlike(_RULE.pattern) & (F.col("place") > at(title[0])))).limit(3).collect()
    if len(rules) < 3:
        return []
    inside = own.filter((F.col("place") > at(rules[1])) & (F.col("place") < at(rules[2])))
    return [r["value"] for r in first(inside).limit(MRT_COLUMNS).collect()]


def mrt_body(lines: DataFrame, head: list[str], column: str = "TIC") -> DataFrame:
    """The lines of each file from its first row on: the first line behind its description that has an id and whose numbers all fit the layout.

    Rows are told from the head by their place, so a row may equal a line of the head, and rule-like lines
    among the rows end nothing.
    """
    layout = mrt_layout(head)
    field = {name: F.trim(F.substring("value", start, stop - start + 1)) for name, start, stop, _ in layout}
    fits = to_long(field[column]).isNotNull()
    for name, _, _, kind in layout:
        if kind != "string":
            fits = fits & ((field[name] == "") | field[name].try_cast("double").isNotNull())
    # One row per file: where its description ends, and where its first row is.
    behind = lines.filter(F.col("value") == head[-1]).groupBy(F.col("file").alias("_of")).agg(F.min("place").alias("_behind"))
    begin = lines.filter(fits).join(behind, F.col("file") == F.col("_of")).filter(F.col("place") > F.col("_behind")).groupBy(F.col("file").alias("_file")).agg(F.min("place").alias("_begin"))
    return lines.join(begin, F.col("file") == F.col("_file")).filter(F.col("place") >= F.col("_begin")).select("value")


def read_mrt(spark: SparkSession, path: str, column: str = "TIC") -> DataFrame:
    """Machine-readable tables of one layout: a byte-by-byte description, notes, then rows. The driver sees the description alone."""
    lines = numbered_lines(spark, path)
    head = mrt_description(lines)
    if not head:
        raise ValueError(f"{path} has no byte-by-byte description")
    names = [name for name, *_ in mrt_layout(head)]
    if column not in names:
        raise KeyError(f"{column} is not among {names}")
    return parse_mrt(mrt_body(lines, head, column), head, column)


def stored_catalog(spark: SparkSession, path: str, folder: str, read=read_fixed_width) -> DataFrame:
    """read(spark, path), converted to Parquet once: a copy in `folder` under the source's name, length and modification time.

    A later read of an unchanged file reads the copy, and starts no scan of the text (of a gzip file by one
    task); a changed file is converted anew, beside the copies of its older states.
    """
    name = spark._jvm.org.apache.hadoop.fs.Path(path)
    files = name.getFileSystem(spark._jsc.hadoopConfiguration()).listStatus(name)  # of a folder, the files in it
    copy = f"{folder.rstrip('/')}/{name.getName()}-{sum(f.getLen() for f in files)}-{max((f.getModificationTime() for f in files), default=0)}"
    if not exists(spark, f"{copy}/_SUCCESS"):
        read(spark, path).write.mode("overwrite").parquet(copy)
    return spark.read.parquet(copy)


def optional_catalog(spark: SparkSession, path: str | None, read, schema: str = "tic_id long") -> DataFrame:
    """read(spark, path), or an empty table where the path is unset, a placeholder or missing."""
    if path and not path.startswith(("/path/to", "TODO")):
        if exists(spark, path):
            return read(spark, path)
    return spark.createDataFrame([], schema)
