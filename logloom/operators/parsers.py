"""The parser chain: JSON, CSV, CEF, key=value, formats by pattern, and a fallback; the first that fits is taken.

A parser is a nullable column map<string,string> of a content column. Only strict JSON needs Python: its function gets
the lines that begin with a brace, and nulls for the others. Each parser is tried on what those before it left over.
"""

from __future__ import annotations

import json
from collections.abc import Callable
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.columns import let
from ..functions.patterns import PARSING, to_java

Parser = Callable[[Column], Column]
_MAP = "map<string,string>"
#: Longer fields are not CSV.
FIELD_LIMIT = 131_072


def json_parser(content: Column) -> Column:
    """Top-level objects only. Values that are not strings are kept as JSON text."""

    @F.pandas_udf(_MAP)
    def strict(parts: pd.Series) -> pd.Series:
        def one(text: str | None):
            if text is None:
                return None
            try:
                found = json.loads(text)
            except (ValueError, RecursionError):
                return None
            return {k: v if isinstance(v, str) or v is None else json.dumps(v) for k, v in found.items()} if isinstance(found, dict) else None

        return parts.map(one)

    return strict(F.when(content.startswith("{"), content))


def csv_fields(content: Column, delimiter: str = ",") -> Column:
    """The fields of one CSV line (array<string>), null where there is one field or none.

    A field that begins with a quote ends at the next quote that is not doubled; what follows up to the delimiter
    belongs to it, quotes too. Without such a quote it reaches to the end of the line."""
    d = "\\Q" + delimiter + "\\E"
    inside = r'"([^"]*+(?:""[^"]*+)*+)'
    one = rf'(?s){d}(?:{inside}(?:"(?:(?!{d}).)*+|$)|(?:(?!{d}).)*+)' if len(delimiter) > 1 else rf'(?s){d}(?:{inside}(?:"[^{d}]*+|$)|[^{d}]*+)'

    def field(m: Column) -> Column:
        text = F.substring(m, F.lit(len(delimiter) + 1), F.length(m))
        quoted = F.concat(F.replace(F.regexp_extract(text, f"^{inside}", 1), F.lit('""'), F.lit('"')), F.regexp_extract(text, rf'(?s)^{inside}"(.*)$', 2))
        return F.when(text.startswith('"'), quoted).otherwise(text)

    found = F.transform(F.regexp_extract_all(F.concat(F.lit(delimiter), content), F.lit(one), F.lit(0)), field)
    fields = F.when(content.contains(delimiter), F.when(content.contains('"'), found).otherwise(F.split(content, d)))
    return let(fields, lambda f: F.when((F.size(f) > 1) & (F.array_max(F.transform(f, F.length)) <= FIELD_LIMIT), f))


def csv_parser(delimiter: str = ",", header: list[str] | None = None) -> Parser:
    def named(fields: Column) -> Column:
        names = F.transform(F.sequence(F.lit(1), F.size(fields)), lambda i: F.concat(F.lit("field_"), i.cast("string")))
        return F.when(fields.isNotNull(), F.map_from_arrays(names, fields))

    def parse(content: Column) -> Column:
        if header:
            return let(csv_fields(content, delimiter), lambda f: F.when(F.size(f) == len(header), F.map_from_arrays(F.lit(header), f)))
        return let(csv_fields(content, delimiter), named)

    return parse


_CEF_HEADER = ("version", "device_vendor", "device_product", "device_version", "signature_id", "name", "severity")
_CEF = r"(?U)^CEF:(\d+)" + r"\|([^|]*)" * 6 + r"\|(.*)"


def cef_parser(content: Column) -> Column:
    """Header fields, then the extension's keys, which may take the place of header fields."""
    header = F.map_from_arrays(F.lit(list(_CEF_HEADER)), F.array(*[F.regexp_extract(content, _CEF, k + 1) for k in range(7)]))
    extension = F.regexp_extract(content, _CEF, 8)
    pairs = F.filter(F.split(extension, r"(?U)\s+(?=\w+=)"), lambda p: p.contains("="))
    clean = lambda c: F.regexp_replace(c, r"(?U)^\s+|\s+$", "")
    entries = F.transform(pairs, lambda p: F.struct(clean(F.substring_index(p, "=", 1)).alias("key"), clean(F.substring(p, F.instr(p, "=") + 1, F.length(p))).alias("value")))
    named = F.map_from_entries(entries)
    raw = F.create_map(F.lit("raw_extension"), extension)
    more = F.when(extension == "", F.map_from_arrays(F.array().cast("array<string>"), F.array().cast("array<string>"))).when(extension.rlike(r"(?U)\w="), named).otherwise(raw)
    return F.when(content.startswith("CEF:") & content.rlike(_CEF), F.map_concat(header, more))


def key_value_parser(delimiter: str = "=", min_pairs: int = 3) -> Parser:
    """Pairs of a word, the delimiter and a value, in quotes or up to white space; the last of one key counts. Pairs are
    found in one pass. A word is tried where it begins only, which tells the same pairs as long as the delimiter itself
    does not begin like a word, and keeps the time in proportion to the line."""
    quoted = "".join("\\" + c if not c.isalnum() else c for c in delimiter)
    word = r"\w+" if delimiter[:1].isalnum() or delimiter[:1] == "_" else r"(?<!\w)\w++"
    pattern = rf'(?U)({word}){quoted}(?:"[^"]*"|\S+)'

    def pair(m: Column) -> Column:
        key = F.regexp_extract(m, rf"(?U)^(\w+?){quoted}", 1) if word == r"\w+" else F.substring_index(m, delimiter, 1)
        value = F.substring(m, F.length(key) + len(delimiter) + 1, F.length(m))
        bare = F.when(value.rlike('^"[^"]*"$'), F.substring(value, F.lit(2), F.length(value) - 2)).otherwise(value)
        return F.struct(key.alias("key"), bare.alias("value"))

    def parse(content: Column) -> Column:
        found = F.when(content.contains(delimiter), F.regexp_extract_all(content, F.lit(pattern), F.lit(0)))
        return let(found, lambda f: F.when(F.size(f) >= min_pairs, F.map_from_entries(F.transform(f, pair))))

    return parse


def pattern_parser(pattern: str) -> Parser:
    """Named groups of a pattern that must match at the beginning."""
    java, names = to_java(pattern)
    java = "(?U)^(?:" + java.removeprefix("(?U)").removeprefix("^") + ")"

    def parse(content: Column) -> Column:
        groups = [x for k, n in enumerate(names) if n for x in (F.lit(n), F.regexp_extract(content, java, k + 1))]
        return F.when(content.rlike(java), F.create_map(*groups))

    return parse


def fallback_parser(content: Column) -> Column:
    return F.create_map(F.lit("raw_content"), content)


@dataclass(frozen=True)
class Named:
    name: str
    parse: Parser


def chain(config: dict | None = None) -> list[Named]:
    """The parsers that a configuration names; without one, all in the usual order."""
    config = config or {}
    own = config.get("parsers", {})
    on = lambda n: own.get(n, {}).get("enabled", True)
    found = []
    if on("json"):
        found.append(Named("JSONParser", json_parser))
    if on("csv"):
        found.append(Named("CSVParser", csv_parser(own.get("csv", {}).get("delimiter", ","), own.get("csv", {}).get("header"))))
    if on("cef"):
        found.append(Named("CEFParser", cef_parser))
    if on("key_value"):
        found.append(Named("KeyValueParser", key_value_parser(own.get("key_value", {}).get("delimiter", "="), own.get("key_value", {}).get("min_pairs", 3))))
    found += [Named(name, pattern_parser(p)) for name, p in config.get("centralized_regex", {}).get("parsing", PARSING).items()]
    return [*found, Named("FallbackParser", fallback_parser)]


def parse(lines: DataFrame, parsers: list[Named] | None = None) -> DataFrame:
    """Add parser_name, parsed_data (map<string,string>) and, for JSON, payload (variant)."""
    parsers = parsers or chain()
    content = F.col("content")
    first = [k for k, p in enumerate(parsers) if p.name == "JSONParser"]  # Python, so it stands in a projection of its own
    tried = lines.select("*", *(parsers[k].parse(content).alias("__json") for k in first))
    own = [F.col("__json") if k in first else p.parse(content) for k, p in enumerate(parsers)]
    as_named = lambda name: lambda m: F.when(m.isNotNull(), F.struct(F.lit(name).alias("name"), m.alias("data")))
    named = [let(c, as_named(p.name)) for c, p in zip(own, parsers, strict=True)]
    out = tried.select(*lines.columns, F.coalesce(*named).alias("__p")).select(*lines.columns, F.col("__p.name").alias("parser_name"), F.col("__p.data").alias("parsed_data"))
    return out.withColumn("payload", F.when(F.col("parser_name") == "JSONParser", F.try_parse_json("content")))
