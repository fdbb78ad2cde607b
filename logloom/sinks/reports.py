"""Results as text, as CSV for template tools, as JSON and in columns. Writers are distributed; a folder is written."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..operators.stats import keys

KINDS = {"anonymize": "txt", "logppt": "csv", "json_report": "json"}
#: Formats of mining output. Avro needs a package that a session may lack; it is tried only where it is asked for.
FORMATS = ("json", "csv", "parquet", "avro")


def output_name(stem: str, kind: str, stamp: str) -> str:
    if kind not in KINDS:
        raise ValueError(f"unknown kind of analysis: {kind}")
    return f"{stem}_{kind}_{stamp}.{KINDS[kind]}"


def write_text(records: DataFrame, path: str) -> None:
    records.orderBy("source_file", "line_number").select(F.coalesce("anonymized", F.lit("")).alias("value")).write.text(path)


def ordinals(records: DataFrame) -> DataFrame:
    """Add ``ordinal``, the place of a record among all by file and line, from 1. Places are counted in a file, and files
    by their counts, so no task holds more than the line numbers of one file."""
    file = Window.partitionBy("source_file").orderBy("line_number")
    counts = records.groupBy("source_file").agg(F.count(F.lit(1)).alias("n"))
    before = F.coalesce(F.sum("n").over(Window.orderBy("source_file").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    files = counts.select(F.col("source_file").alias("of"), before.alias("before"))  # a row for each file
    placed = records.withColumn("place", F.row_number().over(file)).join(files, F.col("source_file").eqNullSafe(F.col("of")))
    return placed.withColumn("ordinal", (F.col("before") + F.col("place")).cast("long")).drop("place", "of", "before")


def template_rows(records: DataFrame, anonymized: bool = False, columns: list[str] | None = None) -> DataFrame:
    """LineId (the record's ordinal), a column for each key of any record, Content, EventId (E and the cluster, or E-1),
    EventTemplate."""
    drain = "drain_anonymized" if anonymized else "drain_original"
    data = "parsed_data_anonymized" if anonymized else "parsed_data"
    content = F.coalesce("anonymized", "content") if anonymized else F.col("content")
    return ordinals(records).select(
        F.col("ordinal").alias("LineId"),
        *(F.coalesce(F.try_element_at(F.col(data), F.lit(k)), F.lit("")).alias(k) for k in (keys(records) if columns is None else columns)),
        content.alias("Content"),
        F.concat(F.lit("E"), F.coalesce(F.col(f"{drain}.cluster_id"), F.lit(-1)).cast("string")).alias("EventId"),
        F.coalesce(F.col(f"{drain}.template"), F.lit("<NO_TEMPLATE>")).alias("EventTemplate"),
    )


def write_templates(records: DataFrame, path: str, anonymized: bool = False, columns: list[str] | None = None) -> None:
    template_rows(records, anonymized, columns).orderBy("LineId").write.csv(path, header=True, quote='"', escape='"')


def write_both_templates(records: DataFrame, path: str) -> None:
    """The original and the anonymized file, with the same columns, in folders of these names."""
    columns = keys(records)
    for name in ("original", "anonymized"):
        write_templates(records, f"{path}/{name}", name == "anonymized", columns)


def write_json(records: DataFrame, path: str) -> None:
    """One JSON object for each record, without null fields; the payload of JSON lines as JSON."""
    text = records.withColumn("payload", F.to_json("payload")) if "payload" in records.columns else records
    text.write.option("ignoreNullFields", "true").json(path)


def write_report(records: DataFrame, path: str) -> None:
    """The full report: a JSON object for each record with every field, null ones too."""
    text = records.withColumn("payload", F.to_json("payload")) if "payload" in records.columns else records
    text.write.option("ignoreNullFields", "false").json(path)


def write_mined(templates: DataFrame, path: str, form: str) -> None:
    """Mining output in one of :data:`FORMATS`."""
    if form not in FORMATS:
        raise ValueError(f"unknown format of mining output: {form}")
    options = {"header": "true", "quote": '"', "escape": '"'} if form == "csv" else {}
    templates.write.format(form).options(**options).save(path)


def write(records: DataFrame, kind: str, path: str) -> None:
    {"anonymize": write_text, "logppt": write_both_templates, "json_report": write_json}[kind](records, path)
