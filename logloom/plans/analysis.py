"""The whole analysis: lines, parsers, anonymization, two miners, one record for each line."""

from __future__ import annotations

import json
import os
import uuid

import yaml
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import columns as C
from ..operators import anonymize, parsers, templates
from ..session import stored
from ..sinks import reports
from ..sources import lines as source


def load_config(path: str) -> dict:
    """A YAML configuration; empty if there is none or if it cannot be read."""
    try:
        with open(path, encoding="utf-8") as file:
            return yaml.safe_load(file) or {}
    except (FileNotFoundError, yaml.YAMLError):
        return {}


def _replace_file(path: str, text: str) -> bool:
    """Write a file as a whole or not at all; False if it cannot be written."""
    temporary = f"{path}.{uuid.uuid4().hex}.tmp"
    try:
        with open(temporary, "w", encoding="utf-8") as file:
            file.write(text)
        os.replace(temporary, path)
    except OSError:
        return False
    return True


def save_config(path: str, config: dict) -> bool:
    """Save a configuration as YAML, its keys in the order they have."""
    return _replace_file(path, yaml.safe_dump(config, sort_keys=False, default_flow_style=False, allow_unicode=True))


def load_settings(path: str) -> dict:
    """Settings kept as JSON; empty if there are none or if they cannot be read."""
    try:
        with open(path, encoding="utf-8") as file:
            return json.load(file)
    except (FileNotFoundError, ValueError):
        return {}


def save_settings(path: str, settings: dict) -> bool:
    return _replace_file(path, json.dumps(settings, indent=2))


def get_value(config: dict, path: str, default=None):
    for key in path.split("."):
        if not isinstance(config, dict) or key not in config:
            return default
        config = config[key]
    return config


# What a preview says in place of a text.
DISABLED, NOTHING = "[PREVIEW] Presidio is disabled.", "[PREVIEW] No entities enabled."


def enabled_entities(pii: dict) -> set[str] | None:
    """The entities whose flags are on; None (all) only where there are no flags."""
    flags = pii.get("analyzer", {}).get("entities")
    return None if flags is None else {name.upper() for name, on in flags.items() if on}


def miner_settings(config: dict, kind: str) -> dict:
    """similarity, depth and max_children of a miner: its own section's, else the common ones, else the defaults."""
    drain = config.get("drain3", {})
    own = drain.get(kind, {})
    pick = lambda name, default: own.get(name, drain.get(name, default))
    return {"similarity": pick("similarity_threshold", 0.4), "depth": pick("depth", 4), "max_children": pick("max_children", 1000)}


def analyse(lines: DataFrame, config: dict | None = None) -> DataFrame:
    """From lines (source_file, line_number, content) one record each; blank lines are left out. Parsing and detection
    run once: their records are written to the shared folder, and mining and the result read them there."""
    config = config or {}
    pii = config.get("presidio", {})
    parsed = parsers.parse(source.not_blank(lines), parsers.chain(config))
    if pii.get("enabled", True):
        ops = anonymize.operators(pii) if pii.get("anonymizer") else None
        parsed = anonymize.anonymize(parsed, known=anonymize.recognizers(pii), ops=ops, entities=enabled_entities(pii), threshold=get_value(pii, "analyzer.analysis.confidence_threshold", 0.7))
    else:
        parsed = parsed.withColumn("pii", F.array().cast(anonymize.SPANS)).withColumn("anonymized", F.col("content"))
    if pii.get("anonymization_mode") in ("classic", "hybrid"):
        parsed = parsed.withColumn("anonymized_classic", C.redact_all(F.col("content"), configured=True))
        if pii["anonymization_mode"] == "classic":
            parsed = parsed.withColumn("anonymized", F.col("anonymized_classic"))
    parsed = parsed.withColumn("parsed_data_anonymized", anonymize.anonymize_fields(F.col("parsed_data"), **anonymize.field_rules(config)))
    # a line that no parser fits is a field itself; its anonymized text stands for it
    parsed = parsed.withColumn("parsed_data_anonymized", F.transform_values("parsed_data_anonymized", lambda k, v: F.when(k == "raw_content", F.col("anonymized")).otherwise(v)))
    parsed = stored(parsed.drop("payload"), "parsed").withColumn("payload", F.when(F.col("parser_name") == "JSONParser", F.try_parse_json("content")))
    for kind, message in (("original", "content"), ("anonymized", "anonymized")):
        keyed = parsed.select(F.col("source_file").alias("miner"), F.col("line_number").alias("seq"), F.col(message).alias("message"))
        mined = templates.mine(keyed, **miner_settings(config, kind))
        mined = mined.select(F.col("miner").alias("source_file"), F.col("seq").alias("line_number"), F.struct("cluster_id", "template", "change_type").alias(f"drain_{kind}"))
        parsed = parsed.join(mined, ["source_file", "line_number"], "left")
    return parsed


def run_analysis(spark: SparkSession, path: str, kind: str, out: str, config: dict | None = None) -> str:
    """Read files, analyse them and write one kind of result. An unknown kind is refused before any work."""
    if kind not in reports.KINDS:
        raise ValueError(f"unknown kind of analysis: {kind}")
    reports.write(analyse(source.read_lines(spark, path), config), kind, out)
    return out


def preview(spark: SparkSession, text: str, config: dict | None = None) -> str:
    pii = (config or {}).get("presidio", {})
    if not text:
        return ""
    if not pii.get("enabled", True):
        return DISABLED
    wanted = enabled_entities(pii)
    if wanted is not None and not wanted:
        return NOTHING
    one = spark.createDataFrame([(text,)], "content string")
    ops = anonymize.operators(pii) if pii.get("anonymizer") else None
    return anonymize.anonymize(one, known=anonymize.recognizers(pii), ops=ops, entities=wanted).first()["anonymized"]
