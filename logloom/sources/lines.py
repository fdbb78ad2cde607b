"""Lines of files and of text columns, with numbers from 1 in each file, blank lines included."""

from __future__ import annotations

import codecs
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.columns import clean_header, strip
from ..session import stored

_BREAK = "\r\n|\n|\r"


def numbered(df: DataFrame, text: Column, file: Column) -> DataFrame:
    """source_file, line_number, content of each line of a text column; a line end at the end adds no line."""
    parts = F.split(text, _BREAK)
    parts = F.when(F.get(parts, F.size(parts) - 1) == "", F.slice(parts, 1, F.size(parts) - 1)).otherwise(parts)
    rows = df.select(file.cast("string").alias("source_file"), F.posexplode(parts).alias("i", "raw"))
    return rows.select("source_file", (F.col("i") + 1).cast("long").alias("line_number"), strip(F.col("raw")).alias("content"))


#: Bytes from which the encoding of a file is told.
PROBE = 32 << 10


def detect_encoding(head: bytes) -> str:
    if head.startswith((codecs.BOM_UTF16_LE, codecs.BOM_UTF16_BE)):
        return "utf-16"
    try:
        codecs.getincrementaldecoder("utf-8")().decode(head)
        return "utf-8-sig"
    except UnicodeDecodeError:
        return "latin-1"


def decode(data: bytes, encoding: str = "auto") -> str:
    return data.decode(detect_encoding(data[:PROBE]) if encoding == "auto" else encoding, "ignore")


def read_lines(spark: SparkSession, path: str, encoding: str = "auto") -> DataFrame:
    """Whole files, each in one task. ``auto`` looks at the first :data:`PROBE` bytes: UTF-8 (with or without a mark; a
    character that the cut splits is no fault), UTF-16 by its mark, else Latin-1. Bytes that do not belong to the
    encoding are dropped. A file that cannot be read fails the job."""
    files = spark.read.format("binaryFile").load(path)

    @F.pandas_udf("string")
    def decoded(parts: pd.Series) -> pd.Series:
        return parts.map(lambda data: decode(data, encoding))

    return numbered(files, decoded("content"), F.col("path"))


def read_large(spark: SparkSession, path: str, encoding: str = "UTF-8") -> DataFrame:
    """Files of any size, split among tasks. Numbers come from the counts of lines in each split, a small table. Where files
    are cut, and which splits go to one task, may change from one scan to the next (with settings, or as executors come and
    go), so they are scanned once, into the shared folder, and both the counts and the lines are read from there."""
    rows = spark.read.option("encoding", encoding).text(path) if encoding.upper() != "UTF-8" else spark.read.text(path)
    rows = rows.select(F.col("_metadata.file_path").alias("source_file"), F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("row"), "value")
    rows = stored(rows, "large-lines")
    splits = rows.groupBy("source_file", "block").agg(F.count(F.lit(1)).alias("n"), F.min("row").alias("first"))
    before = Window.partitionBy("source_file").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    splits = splits.select("source_file", "block", "first", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("before"))
    out = rows.join(stored(splits, "large-splits"), ["source_file", "block"])  # stored, its size is known, and so the lines are not shuffled
    return out.select("source_file", (F.col("before") + F.col("row") - F.col("first") + 1).alias("line_number"), strip(F.col("value")).alias("content"))


def not_blank(lines: DataFrame) -> DataFrame:
    return lines.where("content <> ''")


def line(lines: DataFrame, number: int) -> DataFrame:
    """Line ``number`` of each file; nothing of a file that has fewer."""
    return lines.where(F.col("line_number") == number)


def list_files(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.format("binaryFile").load(path).select("path", "length", "modificationTime")


def read_csv(spark: SparkSession, path: str, delimiter: str | None = None, config: dict | None = None) -> DataFrame:
    """A CSV file with a header; names are cleaned, and of names that are then equal the later ones are numbered. Without
    a delimiter, that which splits the first lines into most fields, equally many in each, is taken. ``config`` is the
    section ``parsers.csv``: whether to detect the delimiter, and among which."""
    own = config or {}
    if delimiter is None and own.get("auto_detect_delimiter", True):
        delimiter = detect_delimiter([r[0] for r in spark.read.text(path).limit(SAMPLE_LINES).collect()], own.get("supported_delimiters") or DELIMITERS)
    df = spark.read.csv(path, header=True, sep=delimiter or own.get("delimiter", ","), quote='"', escape='"')
    names, seen = [], {}
    for name in map(clean_header, df.columns):
        seen[name] = seen.get(name, 0) + 1
        names.append(name if seen[name] == 1 else f"{name}_{seen[name]}")
    return df.toDF(*names)


def read_json_lines(spark: SparkSession, path: str, max_depth: int = 10) -> DataFrame:
    """source_file, payload (variant) of each line that is one JSON value, nested no deeper than ``max_depth`` (its
    brackets are counted outside strings); other lines, those with text after the value too, have a null payload."""
    rows = spark.read.text(path).select(F.col("_metadata.file_path").alias("source_file"), "value")
    bare = F.regexp_replace("value", r'"(?:[^"\\]|\\.)*+"', "")

    def step(so_far: Column, c: Column) -> Column:
        now = so_far["now"] + F.when(c.isin("{", "["), 1).otherwise(-1)
        return F.struct(now.alias("now"), F.greatest(so_far["most"], now).alias("most"), F.least(so_far["least"], now).alias("least"))

    start = F.struct(F.lit(0).alias("now"), F.lit(0).alias("most"), F.lit(0).alias("least"))
    depth = F.aggregate(F.regexp_extract_all(bare, F.lit(r"[\[\]{}]"), F.lit(0)), start, step)
    rows = rows.withColumn("depth", depth).withColumn("only", F.try_parse_json(F.concat(F.lit("["), "value", F.lit("]"))))
    item = lambda k: F.try_variant_get("only", f"$[{k}]", "variant")
    whole = (F.col("depth.now") == 0) & (F.col("depth.least") == 0) & (F.col("depth.most") <= max_depth) & item(1).isNull()
    return rows.select("source_file", F.when(whole, item(0)).alias("payload"))


#: Delimiters among which one is chosen, and the lines at the head of a file from which.
DELIMITERS, SAMPLE_LINES = (",", ";", "\t", "|"), 20


def detect_delimiter(sample: list[str], candidates: tuple[str, ...] | list[str] = DELIMITERS) -> str:
    def fit(d: str) -> tuple[int, int]:
        counts = [s.count(d) for s in sample if s]
        modal = max(set(counts), key=counts.count) if counts else 0
        return (counts.count(modal) if modal else 0), modal

    return max(candidates, key=fit)
