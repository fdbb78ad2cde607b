"""Column functions: cleaning, hashes, masks, flags and times. All run in the JVM."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import patterns


#: White space as Python's ``str.strip`` and ``str.split`` mean it, as a class of a Java pattern with (?U).
SPACE = r"[\s\x1c-\x1f]"


def strip(value: Column) -> Column:
    """Without Unicode white space at either end."""
    return F.regexp_replace(value, rf"(?U)^{SPACE}+|{SPACE}+$", "")


def let(value: Column, use) -> Column:
    """``use`` of a value that is computed once, however often it is mentioned."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def content_hash(value: Column) -> Column:
    return F.left(F.sha2(value, 256), F.lit(16))


def record_id(file: Column, line: Column, content: Column) -> Column:
    return content_hash(F.concat_ws(":", file, line.cast("string"), content))


def hash_value(value: Column, salt: str = patterns.FIELD_SALT, length: int = 16, prefix: str = "") -> Column:
    hashed = F.left(F.sha2(F.concat(F.lit(salt), value), 256), F.lit(length))
    return F.concat(F.lit(prefix), hashed) if prefix else hashed


def mask_value(value: Column, char: str = "*", count: int | None = None, ratio: float = 0.7, from_end: bool = True, keep_format: bool = False) -> Column:
    """``count`` characters (or ``ratio`` of them, rounded down) replaced; with ``keep_format`` only letters and digits."""
    size = F.length(value)
    n = F.least(F.lit(count), size) if count is not None else F.floor(size * F.lit(ratio)).cast("int")
    head, tail = (F.substring(value, F.lit(1), size - n), F.substring(value, size - n + 1, n)) if from_end else (F.substring(value, F.lit(1), n), F.substring(value, n + 1, size - n))
    hidden, shown = (tail, head) if from_end else (head, tail)
    hidden = F.regexp_replace(hidden, r"(?U)[\p{L}\p{N}]" if keep_format else "(?s).", escape_replacement(char))
    return F.concat(shown, hidden) if from_end else F.concat(hidden, shown)


def escape_replacement(text: str) -> str:
    return re.sub(r"([\\$])", r"\\\1", text)


def redact(value: Column, name: str, placeholder: str) -> Column:
    pattern, _ = patterns.to_java(patterns.ANONYMIZATION[name])
    return F.regexp_replace(value, pattern, escape_replacement(placeholder))


#: The order of the classic anonymization, the most specific first. It is ours.
CLASSIC_ORDER = (
    "url", "email", "uuid", "timestamp", "generic_timestamp", "mac_address", "ipv6_address", "hash_string", "user_identifier", "system_id", "credit_card", "numeric_hash", "ip_address", "ssn", "phone",
    "unix_timestamp", "date", "time", "hex_id", "fortinet_device", "device_id", "device_name", "hostname_port", *patterns.SERVICE_PORTS, "port_number", "hostname", "domain", "version", "file_path",
)
#: What a text must hold for a pattern to be worth trying: a cheap test that leads the costly one.
_NEEDS = {
    "url": "://", "email": "@", "uuid": "-", "timestamp": ":", "generic_timestamp": ":", "ipv6_address": ":", "system_id": "=", "ip_address": ".", "ssn": "-", "date": "-", "time": ":", "hex_id": "0x", "fortinet_device": "FGT",
    "device_name": "-", "hostname_port": ":", "port_number": ":", "hostname": ".", "domain": ".", "version": ".", "file_path": "/", **{name: p.removesuffix(r"\b") for name, p in patterns.SERVICE_PORTS.items()},
}


def redact_all(value: Column, names: tuple[str, ...] = CLASSIC_ORDER, configured: bool = False) -> Column:
    """The classic anonymization: patterns replaced one after another, in :data:`CLASSIC_ORDER`, by ``<NAME>`` or, where
    ``configured``, by their configured placeholder; lookarounds keep a placeholder from being taken apart only where
    a pattern has them. With the default names a port follows what stands before it: ``<IP_ADDRESS><HTTPS_PORT>``."""
    known = patterns.ANONYMIZATION | patterns.SERVICE_PORTS
    for name in (n for n in CLASSIC_ORDER if n in names):
        placeholder = patterns.PLACEHOLDERS.get(patterns.PLACEHOLDER_OF.get(name, ""), f"<{name.upper()}>") if configured else f"<{name.upper()}>"
        value = _replaced(value, patterns.to_java(known[name])[0], escape_replacement(placeholder), _NEEDS.get(name))
    return value


def _replaced(value: Column, java: str, placeholder: str, needs: str | None) -> Column:
    if needs is None:
        return F.regexp_replace(value, java, placeholder)
    return let(value, lambda v: F.when(v.contains(needs), F.regexp_replace(v, java, placeholder)).otherwise(v))


def detections(value: Column, names: tuple[str, ...] = (*patterns.DETECTION, *patterns.SERVICE_PORTS)) -> Column:
    """How often each pattern that detects stands in a text: a map of counts, without those that stand nowhere."""
    known = patterns.DETECTION | patterns.SERVICE_PORTS
    counts = [x for n in names for x in (F.lit(n), F.regexp_count(value, F.lit(patterns.to_java(known[n])[0])))]
    return F.map_filter(F.create_map(*counts), lambda _, n: n > 0)


def clean_timestamp(value: Column, year: int) -> Column:
    """``MM-dd,HH:mm:ss.f`` within a text as ``yyyy-MM-dd HH:mm:ss.f``; other text stays."""
    return F.regexp_replace(value, patterns.to_java(patterns.TIMESTAMP_CLEAN)[0], f"{year}-$1 $2")


def iso_to_plain(value: Column) -> Column:
    """``yyyy-MM-ddTHH:mm:ss`` within a text with a space in place of the T."""
    return F.regexp_replace(value, r"(\d{4}-\d{2}-\d{2})T(\d{2}:\d{2}:\d{2})", "$1 $2")


def clean_header(name: str) -> str:
    """Column names of CSV files: lower case, other characters than letters and digits as single underscores."""
    return re.sub(r"_+", "_", re.sub(r"[^a-zA-Z0-9_]", "_", name)).lower()


def csv_family(header: Column) -> Column:
    """The first family of which enough columns are in the header (array of strings); null if none."""
    out = F.lit(None).cast("string")
    for name, (known, least) in reversed(patterns.CSV_FAMILIES.items()):
        out = F.when(F.size(F.array_intersect(header, F.lit(known))) >= least, F.lit(name)).otherwise(out)
    return out


def security_flags(content: Column) -> Column:
    """What a line's content holds, as a struct of booleans, a severity and the kinds of threat."""
    low = F.lower(content)
    has = lambda p: F.coalesce(content.rlike(patterns.to_java(p)[0]), F.lit(False))
    word = lambda p: F.coalesce(low.rlike(p), F.lit(False))
    error, warning = word("error|fail|critical|fatal"), word("warn")
    flags = {
        "has_ip": has(patterns.DETECTION["ip_address"]),
        "has_email": has(patterns.ANONYMIZATION["email"]),
        "has_url": has(patterns.ANONYMIZATION["url"]),
        "has_errors": error,
        "has_warnings": warning,
    }
    threats = F.array(*(F.when(word(pattern), F.lit(name)) for name, pattern in THREATS.items()))
    return F.struct(
        *(c.alias(name) for name, c in flags.items()),
        F.when(error, "high").when(warning, "medium").otherwise("low").alias("severity_level"),
        F.array_compact(threats).alias("threat_indicators"),
    )


#: Words that hint at an attack, by kind. The kinds are ours.
THREATS = {"attack": "attack|exploit|malware|intrusion", "denied": "denied|unauthorized|forbidden", "login": "failed (login|password)|invalid user"}

#: Formats of times by confidence; the first that fits is taken.
TIME_FORMATS = (
    ("yyyy-MM-dd'T'HH:mm:ss", 0.9, "explicit"), ("yyyy-MM-dd HH:mm:ss", 0.9, "explicit"), ("yyyy-MM-dd-HH.mm.ss", 0.85, "pattern_inference"),
    ("yyyy/MM/dd HH:mm:ss", 0.85, "pattern_inference"), ("dd/MMM/yyyy:HH:mm:ss", 0.85, "pattern_inference"), ("yyyy.MM.dd", 0.6, "pattern_inference"), ("yyyy-MM-dd", 0.6, "pattern_inference"),
)


def normalize_time(value: Column, year: int | None = None) -> Column:
    """struct<iso, confidence, origin>; null if no format fits. Fractions and zones are left out. A time without a year
    (``MM-dd,HH:mm:ss.f``) needs ``year``."""
    value = clean_timestamp(value, year) if year is not None else value
    bare = F.regexp_replace(value, r"(\.\d+)?\s*(Z|[+-]\d{2}:?\d{2})?$", "")
    out = F.lit(None).cast("struct<iso: string, confidence: double, origin: string>")
    for form, confidence, origin in reversed(TIME_FORMATS):
        at = F.coalesce(F.try_to_timestamp(bare, F.lit(form)), F.try_to_timestamp(value, F.lit(form)))
        out = F.when(at.isNotNull(), F.struct(F.date_format(at, "yyyy-MM-dd'T'HH:mm:ss").alias("iso"), F.lit(confidence).alias("confidence"), F.lit(origin).alias("origin"))).otherwise(out)
    return out


def field_kind(name: Column) -> Column:
    """The kind of a field by its name, in any case: the kind that has the name itself among its words, else the
    first that has one between underscores; ``unknown`` if there is none."""
    low, out = F.lower(name), F.lit("unknown")
    for kind, words in reversed(patterns.FIELD_NAMES.items()):
        out = F.when(low.rlike("(^|_)(" + "|".join(words) + ")($|_)") | (low.endswith("port") if kind == "port" else F.lit(False)), F.lit(kind)).otherwise(out)
    for kind, words in reversed(patterns.FIELD_NAMES.items()):
        out = F.when(low.isin(words), F.lit(kind)).otherwise(out)
    return out


def value_kind(value: Column) -> Column:
    """The kind of a field by its value, of which a pattern must match all: the first that fits, else ``unknown``."""
    out = F.lit("unknown")
    for kind, known in reversed(patterns.FIELD_VALUES.items()):
        whole = "|".join(f"(?:{patterns.to_java(p)[0].removeprefix('(?U)')})" for p in known)
        out = F.when(value.rlike(f"(?U)^(?:{whole})$"), F.lit(kind)).otherwise(out)
    return out
