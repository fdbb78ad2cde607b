"""Detection of sensitive values and their replacement.

A recognizer is a pattern with an entity and a score. Spans that overlap are settled by score, then length, then
place. Entities that need a language model (names of persons, places, organizations) have no recognizer here; one
can be added as a function of a text. Unlike a plain failure-open design, a row whose rewriting fails is not passed on.
"""

from __future__ import annotations

import hashlib
import re
from bisect import bisect_left
from collections.abc import Callable
from dataclasses import dataclass, field

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import patterns
from ..functions.columns import hash_value, redact_all
from ..functions.patterns import to_java

# The strategy of each entity.
STRATEGIES = {
    "PERSON": "replace", "EMAIL_ADDRESS": "replace", "LOCATION": "replace", "ADDRESS": "replace", "CITY": "replace", "COUNTRY": "replace",
    "IP_ADDRESS": "replace", "DOMAIN_NAME": "replace", "URL": "replace", "DATE_TIME": "replace", "DATE": "replace", "TIME": "replace",
    "ORGANIZATION": "replace", "COMPANY": "replace", "JOB_TITLE": "replace", "DIAGNOSIS": "replace", "MEDICATION": "replace", "COURT": "replace",
    "LAW_FIRM": "replace", "HOSTNAME": "replace", "LOG_SOURCE": "replace", "CONFIG_KEY": "replace", "ENV_VAR": "replace",
    "PERSON_ID": "hash", "ID": "hash", "KEY": "hash", "UUID": "hash", "MEDICAL_RECORD": "hash", "CASE_NUMBER": "hash", "PASSWORD": "hash",
    "SECRET_KEY": "hash", "ACCESS_TOKEN": "hash", "PROCESS_ID": "hash", "THREAD_ID": "hash", "SESSION_ID": "hash",
    "PHONE_NUMBER": "mask", "CREDIT_CARD": "mask", "IBAN_CODE": "mask", "ZIP_CODE": "mask", "MAC_ADDRESS": "mask", "BANK_ACCOUNT": "mask",
    "CREDIT_SCORE": "mask",
    "HASH": "keep", "CURRENCY": "keep", "PORT": "keep", "PROTOCOL": "keep", "LOG_LEVEL": "keep", "LOG_TYPE": "keep", "SETTING": "keep",
}


@dataclass(frozen=True)
class Recognizer:
    entity: str
    pattern: str
    score: float = 0.85
    name: str = ""


#: The recognizers that are on without further setting.
RECOGNIZERS = (
    Recognizer("EMAIL_ADDRESS", patterns.ANONYMIZATION["email"], 1.0, "email"),
    Recognizer("URL", patterns.ANONYMIZATION["url"], 0.9, "url"),
    Recognizer("IP_ADDRESS", patterns.DETECTION["ip_address"], 0.95, "ip_address"),
    Recognizer("MAC_ADDRESS", patterns.ANONYMIZATION["mac_address"], 0.95, "mac_address"),
    Recognizer("UUID", patterns.ANONYMIZATION["uuid"], 0.95, "uuid"),
    Recognizer("CREDIT_CARD", patterns.ANONYMIZATION["credit_card"], 0.9, "credit_card"),
    Recognizer("PHONE_NUMBER", patterns.ANONYMIZATION["phone"], 0.75, "phone"),
    Recognizer("DATE_TIME", patterns.ANONYMIZATION["timestamp"], 0.85, "timestamp"),
)


@dataclass(frozen=True)
class Operators:
    """Strategy and parameters by entity; DEFAULT serves entities without one."""

    strategies: dict[str, str] = field(default_factory=lambda: dict(STRATEGIES))
    params: dict[str, dict] = field(default_factory=lambda: {"hash": {"salt": patterns.FIELD_SALT, "truncate_length": 16}, "mask": {"mask_char": "*", "mask_ratio": 0.7}})

    def apply(self, entity: str, value: str) -> str:
        strategy = self.strategies.get(entity, self.strategies.get("DEFAULT", "replace"))
        p = self.params.get(strategy, {})
        if strategy == "keep":
            return value
        if strategy == "hash":
            digest = hashlib.new(p.get("algorithm", "sha256"), (p.get("salt", "") + value).encode()).hexdigest()[: p.get("truncate_length", 16)]
            return f"{entity}_{digest}" if p.get("include_entity_type") else digest
        if strategy == "mask":
            char = p.get("masking_char", p.get("mask_char", "*"))
            n = min(len(value), p["chars_to_mask"] if "chars_to_mask" in p else int(len(value) * p.get("mask_ratio", 0.7)))
            at = range(len(value) - n, len(value)) if p.get("from_end", True) else range(n)
            return "".join(char if i in at and (c.isalnum() or not p.get("preserve_format")) else c for i, c in enumerate(value))
        if strategy == "replace":
            return p.get("new_value") or p.get("placeholders", {}).get(entity) or f"<{entity}>"
        raise ValueError(f"unknown strategy {strategy}")


def operators(config: dict) -> Operators:
    """From a configuration of strategies, their parameters and ad-hoc recognizers."""
    anonymizer = config.get("anonymizer", {})
    strategies = {k.upper(): v for k, v in anonymizer.get("strategies", {}).items()}
    strategies |= {r["name"].upper(): r["strategy"] for r in config.get("analyzer", {}).get("ad_hoc_recognizers", []) if r.get("name") and r.get("strategy")}
    return Operators(strategies, anonymizer.get("strategy_config", {}))


def recognizers(config: dict) -> tuple[Recognizer, ...]:
    own = [Recognizer(r["name"], r["regex"], float(r.get("score", 0.85)), r["name"]) for r in config.get("analyzer", {}).get("ad_hoc_recognizers", []) if r.get("name") and r.get("regex")]
    return (*RECOGNIZERS, *own)


def settle(spans: list[tuple[str, int, int, float, str]]) -> list[tuple[str, int, int, float, str]]:
    """Spans (entity, start, end, score, recognizer) without overlaps, in order of place. Kept spans lie apart, so of
    them only the neighbours of a new one can overlap it."""
    starts: list[int] = []
    kept: list[tuple[str, int, int, float, str]] = []
    for s in sorted(spans, key=lambda s: (-s[3], s[1] - s[2], s[1], s[0])):
        k = bisect_left(starts, s[1])
        if s[1] < s[2] and (not k or kept[k - 1][2] <= s[1]) and (k == len(kept) or kept[k][1] >= s[2]):
            starts.insert(k, s[1])
            kept.insert(k, s)
    return kept


SPANS = "array<struct<entity_type: string, start: int, end: int, score: double, recognizer: string>>"


def anonymize(df: DataFrame, text: str = "content", known: tuple[Recognizer, ...] = RECOGNIZERS, ops: Operators | None = None, entities: set[str] | None = None, threshold: float = 0.7, more: Callable[[str], list[tuple[str, int, int, float, str]]] | None = None) -> DataFrame:
    """Add pii (the spans) and anonymized. Only texts in which some pattern stands pass through Python; ``more`` may
    find further spans (then all texts do). A null text stays null."""
    ops = ops or Operators()
    own = [r for r in known if r.score >= threshold and (entities is None or r.entity in entities)]

    @F.pandas_udf(f"pii {SPANS}, anonymized string")
    def rewrite(parts: pd.Series) -> pd.DataFrame:
        compiled = [(r, re.compile(r.pattern)) for r in own]
        rows = []
        for value in parts:
            if value is None:
                rows.append((None, None))
                continue
            found = [(r.entity, m.start(), m.end(), r.score, r.name or r.entity) for r, p in compiled for m in p.finditer(value)]
            if more:
                found += [s for s in more(value) if s[3] >= threshold and (entities is None or s[0] in entities)]
            spans, out, at = settle(found), [], 0
            for entity, start, end, _, _ in spans:
                out += [value[at:start], ops.apply(entity, value[start:end])]
                at = end
            rows.append(([dict(zip(("entity_type", "start", "end", "score", "recognizer"), s, strict=True)) for s in spans], "".join([*out, value[at:]])))
        return pd.DataFrame(rows, columns=["pii", "anonymized"])

    value = F.col(text)
    hit = F.lit(more is not None)
    for r in own:
        hit = hit | value.rlike(to_java(r.pattern)[0])
    out = df.withColumn("__a", rewrite(F.when(hit, value)))
    none = F.array().cast(SPANS)
    return out.select(*df.columns, F.when(value.isNotNull(), F.coalesce("__a.pii", none)).alias("pii"), F.coalesce("__a.anonymized", value).alias("anonymized"))


def anonymize_fields(data: Column, names: tuple[str, ...] = patterns.ALWAYS_ANONYMIZE, salt: str = patterns.FIELD_SALT, hashed: tuple[str, ...] = patterns.HASHED_FIELDS, masked: tuple[str, ...] = patterns.MASKED_FIELDS, mask: str = patterns.FIELD_MASK) -> Column:
    """The values of these keys (in any case) of a map: hashed, masked, or replaced by the field's placeholder, else by
    ``<NAME>``. Null and empty values stay, as there is nothing in them."""
    shown = {n: patterns.PLACEHOLDERS.get(patterns.FIELD_PLACEHOLDERS.get(n, ""), f"<{n.upper()}>") for n in names}
    plain = [n for n in names if n not in hashed and n not in masked]

    def value(k: Column, v: Column) -> Column:
        low, out = F.lower(k), v
        for n in plain:
            out = F.when(low == n, F.lit(shown[n])).otherwise(out)
        of = lambda group: [n for n in names if n in group]
        out = F.when(low.isin(of(masked)), F.lit(mask)).otherwise(out) if of(masked) else out
        out = F.when(low.isin(of(hashed)), hash_value(v, salt)).otherwise(out) if of(hashed) else out
        return F.when(v.isNull() | (v == ""), v).otherwise(out)

    return F.transform_values(data, value)


def field_rules(config: dict) -> dict:
    """The arguments of :func:`anonymize_fields` from a configuration (section ``drain3.anonymization``)."""
    own = config.get("drain3", {}).get("anonymization", {})
    methods, out = own.get("methods", {}), {}
    if not own.get("enabled", True):
        return {"names": ()}
    if "always_anonymize" in own:
        out["names"] = tuple(own["always_anonymize"] or ())
    if "hash" in methods:
        out |= {"hashed": tuple(methods["hash"].get("fields", ())), "salt": methods["hash"].get("salt", patterns.FIELD_SALT)}
    if "mask" in methods:
        out |= {"masked": tuple(methods["mask"].get("fields", ())), "mask": methods["mask"].get("pattern", patterns.FIELD_MASK)}
    return out


def hybrid(df: DataFrame, text: str = "content", **how) -> DataFrame:
    """Both ways side by side, each on the original: pii and anonymized from the recognizers, anonymized_classic from
    the patterns in their order."""
    return anonymize(df, text, **how).withColumn("anonymized_classic", redact_all(F.col(text)))


def catalogue(spark: SparkSession, known: tuple[Recognizer, ...] = RECOGNIZERS, ops: Operators | None = None, entities: set[str] | None = None) -> DataFrame:
    """entity, enabled, strategy, score, pattern; the first recognizer of an entity counts."""
    ops, rows = ops or Operators(), {}
    for r in known:
        rows.setdefault(r.entity, (r.entity, entities is None or r.entity in entities, ops.strategies.get(r.entity, "replace"), r.score, r.pattern))
    return spark.createDataFrame(list(rows.values()), "entity string, enabled boolean, strategy string, score double, pattern string")
