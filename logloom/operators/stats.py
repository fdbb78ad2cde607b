"""Statistics over parsed records."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def parser_distribution(parsed: DataFrame) -> DataFrame:
    return parsed.groupBy("parser_name").agg(F.count(F.lit(1)).alias("n"))


def summary(parsed: DataFrame) -> DataFrame:
    """Totals, success rate (parsed by other than the fallback) and lengths of contents."""
    size = F.length("content")
    return parsed.agg(F.count(F.lit(1)).alias("total"), F.count_if(F.col("parser_name") != "FallbackParser").alias("parsed"), F.round(F.count_if(F.col("parser_name") != "FallbackParser") / F.count(F.lit(1)), 6).alias("success_rate"), F.min(size).alias("min_length"), F.max(size).alias("max_length"), F.avg(size).alias("avg_length"), F.percentile(size, 0.5).alias("median_length"), F.stddev(size).alias("stddev_length"))


def anonymization_summary(rows: DataFrame) -> DataFrame:
    """Spans by entity."""
    return rows.select(F.explode_outer("pii").alias("p")).groupBy("p.entity_type").agg(F.count("p").alias("n")).where("entity_type is not null")


def anonymization_rate(rows: DataFrame) -> DataFrame:
    """How many records there are, how many hold spans, and their share."""
    held = F.count_if(F.size("pii") > 0)
    return rows.agg(F.count(F.lit(1)).alias("total"), held.alias("anonymized"), F.round(held / F.count(F.lit(1)), 6).alias("rate"), F.coalesce(F.sum(F.size("pii")), F.lit(0)).alias("spans"))


def field_counts(rows: DataFrame) -> DataFrame:
    """For each key of parsed_data how many records have it, and in how many its value is another in
    parsed_data_anonymized."""
    pairs = rows.select(F.explode("parsed_data").alias("field", "value"), "parsed_data_anonymized")
    changed = ~F.col("value").eqNullSafe(F.try_element_at("parsed_data_anonymized", F.col("field")))
    return pairs.groupBy("field").agg(F.count(F.lit(1)).alias("n"), F.count_if(changed).alias("n_anonymized"))


#: A report has a column for each key; more keys than this are refused rather than collected.
MOST_KEYS = 10_000


def keys(parsed: DataFrame) -> list[str]:
    """The sorted union of the keys of all records; as many as there are columns in a report."""
    found = sorted(r[0] for r in parsed.select(F.explode(F.map_keys("parsed_data")).alias("k")).distinct().limit(MOST_KEYS + 1).collect())
    if len(found) > MOST_KEYS:
        raise ValueError(f"more than {MOST_KEYS} distinct keys: a report with a column for each is not possible")
    return found


def search_index(parsed: DataFrame, at: str = "timestamp") -> DataFrame:
    t = F.try_to_timestamp(F.col(at)) if dict(parsed.dtypes)[at] == "string" else F.col(at)
    return parsed.select("*", F.year(t).alias("year"), F.month(t).alias("month"), F.day(t).alias("day"), F.hour(t).alias("hour"), F.length("content").alias("content_length"))
