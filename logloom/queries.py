"""The registered queries of the log engine, over whole tables, and SQL for the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .functions import columns as C
from .functions import patterns
from .operators import anonymize, parsers, stats, templates
from .plans import analysis
from .session import configure, scratch
from .sinks import reports
from .sources import lines as source
from .streaming.miner import mine_stream


def _t(spark: SparkSession, sf: str, name: str) -> DataFrame:
    configure(spark)
    return spark.read.parquet(f"{sf}/{name}.parquet")


def _lines(spark: SparkSession, sf: str) -> DataFrame:
    return source.numbered(_t(spark, sf, "documents"), F.col("text"), F.col("doc_id"))


# Lines and texts of events, as SQL that Spark and the checking engine read alike.
_I, _U = "CAST(event_id AS STRING)", "CAST(user_id AS STRING)"
_LINE = f"""CASE event_id % 8 WHEN 0 THEN props
WHEN 1 THEN event_type || ',"say ""' || {_U} || '"", all",' || {_I} || ','
WHEN 2 THEN 'CEF:0|acme|gate|1.0|' || {_U} || '|' || event_type || '|5|src=10.1.2.3 msg=' || event_type || ' by user  act=' || {_I} || ' name=other'
WHEN 3 THEN 'devid=FG1 user="user ' || {_U} || '" type=' || event_type || ' e="" type=last'
WHEN 4 THEN '10.0.0.7 - - [10/Oct/2000:13:55:36 +0000] "GET /u/' || {_U} || ' HTTP/1.0" 200 ' || {_I}
WHEN 5 THEN 'Jan  5 10:00:00 host' || {_U} || ' sshd[' || {_I} || ']: ' || event_type || ' happened'
WHEN 6 THEN '2024-01-01 10:00:00 FG' || {_U} || ' traffic forward notice ' || event_type || ' passed'
ELSE event_type || ' happened to user ' || {_U} END"""
_TEXT = f"""'user u' || {_U} || '@example.org from 10.1.2.' || CAST(event_id % 200 AS STRING) || ' card 1111-2222-3333-' || lpad(CAST(event_id % 10000 AS STRING), 4, '0')
|| ' mac 00:1a:2b:3c:4d:5e call 555-123-4567 ticket T-' || {_I} || ' at 2024-01-01T10:00:00Z see https://x.example.org/' || {_U}"""
_PORTS = f"'host a' || {_U} || '.example.org:443 and 10.0.0.9:22 port :8080 id=12345'"
_ACCEPTED = f"event_type || ' of u' || {_U} || '@example.org accepted'"
_INSIDE = f"'see https://u' || {_U} || '@example.org/x?ip=10.0.0.1 end'"
_JSON = f"""CASE event_id % 6 WHEN 0 THEN '{{"a": {{"b": [1, 2]}}, "s": "x' || {_U} || '", "n": null, "t": true, "f": 1.5}}' WHEN 1 THEN '[1, 2]' WHEN 2 THEN '{{''k'': ' || {_I} || '}}'
WHEN 3 THEN '{{"a": 1}} x' WHEN 4 THEN '{{"a": NaN}}' ELSE '{{"a": 1, "a": ' || {_U} || '}}' END"""
_TICKET = {"analyzer": {"ad_hoc_recognizers": [{"name": "TICKET", "regex": r"\bT-\d+", "score": 0.9, "strategy": "hash"}]}}


def _events(spark: SparkSession, sf: str, text: str, name: str = "content") -> DataFrame:
    return _t(spark, sf, "events").select("event_id", "user_id", "event_type", "props", F.expr(text).alias(name))


def _shown(m: Column) -> Column:
    """A map as text, in order of its keys."""
    return F.array_join(F.array_sort(F.transform(F.map_entries(m), lambda e: F.concat(e["key"], F.lit("="), e["value"]))), ";")


def pii_counts_by_lang(spark, sf):
    found = _t(spark, sf, "documents").select("lang", C.detections(F.col("text"), ("email", "ip_address")).alias("n"))
    total = lambda name: F.sum(F.coalesce(F.try_element_at("n", F.lit(name)), F.lit(0))).cast("long")
    return found.groupBy("lang").agg(total("email").alias("emails"), total("ip_address").alias("ips"))


def redact_email(spark, sf):
    return _t(spark, sf, "documents").select("doc_id", F.md5(C.redact(F.col("text"), "email", "<EMAIL>")).alias("redacted"))


def redact_ip(spark, sf):
    return _t(spark, sf, "pages").select("page_id", F.md5(C.redact(F.col("html"), "ip_address", "<IP>")).alias("redacted"))


def mask_credit_card(spark, sf):
    cards = F.regexp_extract_all("text", F.lit(patterns.to_java(patterns.ANONYMIZATION["credit_card"])[0]), F.lit(0))
    rows = _t(spark, sf, "documents").select("doc_id", F.posexplode(cards).alias("i", "card"))
    return rows.select("doc_id", F.col("i").cast("long").alias("i"), C.mask_value(F.col("card"), "#", 4).alias("masked"))


def hash_key(spark, sf):
    return _t(spark, sf, "events").select("event_id", C.hash_value(F.col("user_id").cast("string")).alias("hashed"))


def content_hash(spark, sf):
    return _t(spark, sf, "documents").select("doc_id", C.content_hash(F.col("text")).alias("content_hash"))


def record_id(spark, sf):
    docs = _t(spark, sf, "documents")
    return docs.select("doc_id", C.record_id(F.col("source"), F.col("doc_id"), F.col("text")).alias("id"))


def json_payload(spark, sf):
    return _t(spark, sf, "events").select("event_id", F.try_variant_get(F.try_parse_json("props"), "$.k", "long").alias("k"))


def json_parser(spark, sf):
    rows = _t(spark, sf, "events").select("event_id", parsers.json_parser(F.col("props")).alias("m"))
    return rows.select("event_id", F.try_element_at("m", F.lit("k")).alias("k"), F.size("m").cast("long").alias("n_keys"))


def kv_pairs(spark, sf):
    rows = _t(spark, sf, "pages").select("page_id", parsers.key_value_parser()(F.col("html")).alias("m")).where("m is not null")
    return rows.select("page_id", F.explode("m").alias("key", "value"))


def csv_fields(spark, sf):
    rows = _lines(spark, sf).select("source_file", "line_number", parsers.csv_fields(F.col("content")).alias("f")).where("f is not null")
    return rows.select("source_file", "line_number", F.size("f").cast("long").alias("n_fields"), F.element_at("f", 1).alias("first_field"), F.element_at("f", -1).alias("last_field"))


def lines(spark, sf):
    return _lines(spark, sf)


def not_blank_lines(spark, sf):
    return source.not_blank(_lines(spark, sf)).groupBy("source_file").agg(F.count(F.lit(1)).alias("n"))


def line_lookup(spark, sf):
    return source.line(_lines(spark, sf), 2).select("source_file", "content")


def parser_distribution(spark, sf):
    return stats.parser_distribution(parsers.parse(source.not_blank(_lines(spark, sf))))


def parse_records(spark, sf):
    rows = parsers.parse(source.not_blank(_lines(spark, sf)))
    return rows.select("source_file", "line_number", "parser_name", F.size("parsed_data").cast("long").alias("n_fields"))


def key_union(spark, sf):
    rows = _t(spark, sf, "events").select(F.explode(F.map_keys(F.from_json("props", "map<string,string>"))).alias("key"))
    return rows.groupBy("key").agg(F.count(F.lit(1)).alias("n"))


def anonymize_documents(spark, sf):
    rows = anonymize.anonymize(_t(spark, sf, "documents").select("doc_id", "text"), "text")
    return rows.select("doc_id", F.size("pii").cast("long").alias("n_spans"), F.sha2("anonymized", 256).alias("sha256"))


def entity_counts(spark, sf):
    return stats.anonymization_summary(anonymize.anonymize(_t(spark, sf, "pages").select("page_id", "html"), "html"))


def classic_anonymization(spark, sf):
    return _t(spark, sf, "pages").select("page_id", F.sha2(C.redact_all(F.col("html")), 256).alias("sha256"))


def record_fields(spark, sf):
    """Lines of all formats through the chain: the parser of each and the fields that it finds."""
    return parsers.parse(_events(spark, sf, _LINE)).select("event_id", "parser_name", _shown(F.col("parsed_data")).alias("fields"))


def configured_parsers(spark, sf):
    """The chain without JSON and CEF, and with names for the fields of CSV lines."""
    own = parsers.chain({"parsers": {"json": {"enabled": False}, "cef": {"enabled": False}, "csv": {"header": ["kind", "said", "id", "rest"]}, "key_value": {"min_pairs": 4}}})
    rows = parsers.parse(_events(spark, sf, _LINE), own)
    return rows.select("event_id", "parser_name", F.try_element_at("parsed_data", F.lit("said")).alias("said"), F.size("parsed_data").cast("long").alias("n_fields"))


def json_fields(spark, sf):
    """Nested values, repeated keys and not-a-number; arrays, other quotes and text after the value are not JSON records."""
    rows = parsers.parse(_events(spark, sf, _JSON))
    return rows.select("event_id", "parser_name", _shown(F.col("parsed_data")).alias("fields"), F.col("payload").isNotNull().alias("has_payload"))


def own_parsers(spark, sf):
    """A parser and a line format of the caller's."""
    first = parsers.Named("AddressParser", lambda c: F.when(c.startswith("10."), F.create_map(F.lit("first"), F.substring_index(c, " ", 1))))
    chain = [first, *parsers.chain({"centralized_regex": {"parsing": {"own_format": r"^(?P<the_kind>\S+) happened to user (?P<who>\d+)$"}}})]
    return parsers.parse(_events(spark, sf, _LINE), chain).where("parser_name in ('AddressParser', 'own_format', 'FallbackParser')").select("event_id", "parser_name", _shown(F.col("parsed_data")).alias("fields"))


def overlapping_entities(spark, sf):
    """An address and an e-mail address within a URL: the higher scores stay, the URL goes."""
    rows = anonymize.anonymize(_events(spark, sf, _INSIDE))
    return rows.select("event_id", "anonymized", F.array_join(F.transform("pii", lambda p: p["entity_type"]), " ").alias("entities"))


def anonymized_events(spark, sf):
    """All recognizers and one of the caller's: replaced, masked and hashed values, and the entities in order."""
    ops = anonymize.Operators(anonymize.STRATEGIES | {"TICKET": "hash"})
    rows = anonymize.anonymize(_events(spark, sf, _TEXT), known=anonymize.recognizers(_TICKET), ops=ops)
    return rows.select("event_id", "anonymized", F.array_join(F.transform("pii", lambda p: p["entity_type"]), " ").alias("entities"))


def configured_strategies(spark, sf):
    """Strategies with their parameters: a new value, four characters masked, a salted hash, and values that are kept."""
    anonymizer = {"strategies": {"DEFAULT": "replace", "PHONE_NUMBER": "mask", "EMAIL_ADDRESS": "hash", "CREDIT_CARD": "keep", "MAC_ADDRESS": "keep"}, "strategy_config": {"replace": {"new_value": "<REDACTED>"}, "mask": {"masking_char": "#", "chars_to_mask": 4, "from_end": True}, "hash": {"algorithm": "sha256", "salt": "test-salt"}}}
    rows = anonymize.anonymize(_events(spark, sf, _TEXT), ops=anonymize.operators({"anonymizer": anonymizer}))
    return rows.select("event_id", "anonymized")


def entity_flags(spark, sf):
    """One entity on, and none on: with all flags off nothing is changed."""
    some = analysis.enabled_entities({"analyzer": {"entities": {"EMAIL_ADDRESS": True, "IP_ADDRESS": False}}})
    none = analysis.enabled_entities({"analyzer": {"entities": {"EMAIL_ADDRESS": False, "URL": False}}})
    rows = anonymize.anonymize(_events(spark, sf, _TEXT), entities=some).withColumnRenamed("anonymized", "some").drop("pii")
    return anonymize.anonymize(rows, entities=none).select("event_id", "some", F.col("anonymized").alias("none"))


def hybrid_events(spark, sf):
    return anonymize.hybrid(_events(spark, sf, _TEXT)).select("event_id", "anonymized", "anonymized_classic")


def classic_placeholders(spark, sf):
    """Hosts, addresses, ports of services and system ids with the configured placeholders."""
    return _events(spark, sf, _PORTS).select("event_id", C.redact_all(F.col("content"), configured=True).alias("anonymized"), C.redact_all(F.col("content"), ("ip_address", "ssh_port")).alias("some"))


def detections(spark, sf):
    """How many lines each pattern of the catalogue stands in, and how often."""
    texts = _events(spark, sf, _LINE).union(_events(spark, sf, _TEXT)).union(_events(spark, sf, _PORTS))
    found = texts.select(F.explode(C.detections(F.col("content"))).alias("name", "n"))
    return found.groupBy("name").agg(F.count(F.lit(1)).alias("n_lines"), F.sum("n").cast("long").alias("n"))


def previews(spark, sf):
    configure(spark)
    off, on = {"presidio": {"enabled": False}}, {"presidio": {"analyzer": {"entities": {"URL": True, "EMAIL_ADDRESS": False}}}}
    cases = [("empty", "", None), ("disabled", "a@b.co", off), ("nothing", "a@b.co", {"presidio": {"analyzer": {"entities": {"URL": False}}}}), ("some", "a@b.co at http://x.org/y", on), ("all", "a@b.co at http://x.org/y", None)]
    return spark.createDataFrame([(name, analysis.preview(spark, text, config)) for name, text, config in cases], "name string, shown string")


def field_anonymization(spark, sf):
    """Every field that is always anonymized, and one that is not."""
    fields = [x for name in (*patterns.ALWAYS_ANONYMIZE, "kind") for x in (F.lit(name.upper() if name == "vd" else name), F.concat(F.lit(f"{name}-"), F.col("user_id").cast("string")))]
    rows = _t(spark, sf, "events").select("event_id", anonymize.anonymize_fields(F.create_map(*fields)).alias("m"))
    return rows.select("event_id", _shown(F.col("m")).alias("fields"))


def recognizer_catalogue(spark, sf):
    configure(spark)
    return anonymize.catalogue(spark, anonymize.recognizers(_TICKET), anonymize.Operators(anonymize.STRATEGIES | {"TICKET": "hash"}), {"EMAIL_ADDRESS", "URL", "TICKET"})


def _seq(doc: Column, line: Column) -> Column:
    """Numbers in the order of (document, line). A string has under 2^31 bytes, so no line number reaches 2^31; ids
    of 2^32 or more, which do not fit, fail."""
    fits = doc.between(-(1 << 32), (1 << 32) - 1)
    return F.when(fits | doc.isNull(), doc * (1 << 31) + line).otherwise(F.raise_error(F.lit("a document id of 2^32 or more does not fit into sequence numbers")))


def _messages(spark, sf):
    rows = source.not_blank(_lines(spark, sf))
    return rows.select(F.lit("original").alias("miner"), _seq(F.col("source_file").cast("long"), F.col("line_number")).alias("seq"), F.col("content").alias("message"))


def template_mine(spark, sf):
    return templates.running_size(templates.mine(_messages(spark, sf))).drop("message")


def template_coverage(spark, sf):
    return templates.coverage(templates.mine(_messages(spark, sf)))


def template_summary(spark, sf):
    return templates.coverage_summary(templates.coverage(templates.mine(_messages(spark, sf))))


def _event_messages(spark, sf):
    return _t(spark, sf, "events").select(F.lit("events").alias("miner"), F.col("event_id").alias("seq"), F.concat_ws(" ", "event_type", F.lit("by user with value"), F.col("user_id").cast("string")).alias("message"), F.concat(F.lit("day-"), F.dayofmonth("ts")).alias("source_file"))


def template_by_file(spark, sf):
    rows = _event_messages(spark, sf)
    return templates.by_file(templates.mine(rows), rows)


def event_templates(spark, sf):
    """Templates of short machine messages that SQL can state: all have one shape, so there is one cluster for each type."""
    rows = _event_messages(spark, sf)
    return templates.final_templates(templates.mine(rows)).select("template", "size", "first_seq")


def template_sizes(spark, sf):
    """The running size of each cluster."""
    rows = templates.running_size(templates.mine(_event_messages(spark, sf)))
    return rows.select("seq", "cluster_id", "cluster_size", "change_type")


def template_shares(spark, sf):
    return templates.coverage(templates.mine(_event_messages(spark, sf)))


def template_classes(spark, sf):
    rows = templates.coverage_summary(templates.coverage(templates.mine(_event_messages(spark, sf))), high=20.0, low=5.0)
    return rows.select("miner", "templates", "high", "medium", "low", *(F.round(f"{c}_percentage", 4).alias(c) for c in ("avg", "max", "min")))


def stream_templates(spark, sf):
    """The same messages as a stream, in several batches: the templates at the end."""
    folder = scratch(spark, "stream")
    _event_messages(spark, sf).select("seq", "message").repartition(3).write.parquet(f"{folder}/in")
    rows = spark.readStream.schema("seq long, message string").option("maxFilesPerTrigger", 1).parquet(f"{folder}/in")
    written = mine_stream(rows).writeStream.format("parquet").option("path", f"{folder}/out").option("checkpointLocation", f"{folder}/state").trigger(availableNow=True).start()
    written.awaitTermination()
    found = spark.read.parquet(f"{folder}/out").withColumn("first", F.element_at(F.split("template", " "), 1))
    return found.groupBy("n_tokens", "first", "cluster").agg(F.count(F.lit(1)).alias("size"), F.count_if(F.col("change_type") == "cluster_created").alias("created")).select("n_tokens", "first", "size", "created")


def analysis_records(spark, sf):
    rows = analysis.analyse(source.numbered(_t(spark, sf, "conversations"), F.col("text"), F.concat_ws("-", "conv_id", "turn")))
    return rows.select("source_file", "line_number", "parser_name", F.size("pii").cast("long").alias("n_spans"), F.col("drain_original.cluster_id").alias("cluster_original"), F.col("drain_anonymized.cluster_id").alias("cluster_anonymized"))


def _records(spark, sf):
    """The whole analysis of one file of event lines, which begins at line 5 and has every second line only."""
    rows = _events(spark, sf, _ACCEPTED).select(F.lit("events").alias("source_file"), (2 * F.col("event_id") + 5).alias("line_number"), "content")
    return analysis.analyse(rows, {"drain3": {"similarity_threshold": 0.4, "anonymized": {"similarity_threshold": 0.5}}})


def analysis_events(spark, sf):
    """Both miners on every line: clusters, templates on arrival and changes."""
    return _records(spark, sf).select("line_number", "parser_name", "anonymized", *(F.col(f"drain_{k}.{c}").alias(f"{c}_{k}") for k in ("original", "anonymized") for c in ("cluster_id", "template", "change_type")))


def template_csv(spark, sf):
    """The original and the anonymized file for template tools, written and read back."""
    folder = scratch(spark, "template-csv")
    reports.write(_records(spark, sf), "logppt", folder)
    kinds = "LineId long, raw_content string, Content string, EventId string, EventTemplate string"
    both = [spark.read.schema(kinds).csv(f"{folder}/{name}", header=True, quote='"', escape='"').select(F.lit(name).alias("file"), "*") for name in ("original", "anonymized")]
    return both[0].union(both[1])


def text_report(spark, sf):
    folder = scratch(spark, "text-report")
    reports.write(_records(spark, sf), "anonymize", folder)
    return spark.read.text(folder).groupBy("value").agg(F.count(F.lit(1)).alias("n"))


def json_report(spark, sf):
    """Records of all formats as JSON, in both layouts: null fields are left out of one."""
    folder = scratch(spark, "json-report")
    rows = parsers.parse(_events(spark, sf, _LINE)).withColumn("none", F.lit(None).cast("string"))
    reports.write(rows, "json_report", f"{folder}/records")
    reports.write_report(rows, f"{folder}/report")
    both = [spark.read.text(f"{folder}/{name}").select(F.lit(name).alias("file"), F.try_parse_json("value").alias("v")) for name in ("records", "report")]
    get = lambda path: F.try_variant_get("v", f"$.{path}", "string")
    return both[0].union(both[1]).select("file", F.try_variant_get("v", "$.event_id", "long").alias("event_id"), get("parser_name").alias("parser_name"), get("content").alias("content"), get("payload").alias("payload"), F.array_contains(F.json_object_keys(F.to_json("v")), "none").alias("has_none"))


def output_names(spark, sf):
    configure(spark)
    return spark.createDataFrame([(kind, reports.output_name("app", kind, "20240101_000000")) for kind in reports.KINDS], "kind string, name string")


def mining_output(spark, sf):
    """Templates in every format that needs no package, written and read back."""
    folder = scratch(spark, "mining-output")
    found = templates.final_templates(templates.mine(_event_messages(spark, sf)))
    out = []
    for form in ("json", "csv", "parquet"):
        reports.write_mined(found, f"{folder}/{form}", form)
        rows = spark.read.format(form).schema(found.schema).options(**({"header": "true"} if form == "csv" else {})).load(f"{folder}/{form}")
        out.append(rows.select(F.lit(form).alias("form"), "cluster_id", "template", "size"))
    return out[0].union(out[1]).union(out[2])


def record_summary(spark, sf):
    rows = stats.summary(parsers.parse(_events(spark, sf, _LINE)))
    return rows.select("total", "parsed", "success_rate", "min_length", "max_length", F.round("avg_length", 6).alias("avg_length"), "median_length", F.round("stddev_length", 6).alias("stddev_length"))


def anonymization_rate(spark, sf):
    text = f"CASE WHEN event_id % 3 = 0 THEN {_TEXT} ELSE event_type END"
    return stats.anonymization_rate(anonymize.anonymize(_events(spark, sf, text)))


def field_counts(spark, sf):
    rows = parsers.parse(_events(spark, sf, _LINE))
    return stats.field_counts(rows.withColumn("parsed_data_anonymized", anonymize.anonymize_fields(F.col("parsed_data"))))


def _files(spark, sf, buckets: int = 16) -> str:
    """Documents as text files, one for each bucket (the remainder of the id, with its sign), in order of ids."""
    folder = scratch(spark, "files")
    rows = _t(spark, sf, "documents").select((F.col("doc_id") % buckets).cast("int").alias("bucket"), "doc_id", F.coalesce("text", F.lit("")).alias("value"))
    rows = rows.repartitionById(buckets, F.coalesce(F.pmod("bucket", F.lit(buckets)), F.lit(0)))
    # the bucket first: the writer sorts by it where the rows are in another order, and what they were sorted by is lost
    rows.sortWithinPartitions("bucket", "doc_id").select("bucket", "value").write.partitionBy("bucket").text(folder)
    return folder


def _bucket(path: str) -> Column:
    """The bucket that a file's path names; null for that of documents without an id."""
    return F.regexp_extract(path, r"bucket=(-?\d+)", 1).try_cast("long")


def _file_sums(rows: DataFrame) -> DataFrame:
    rows = rows.withColumn("bucket", _bucket("source_file"))
    return rows.groupBy("bucket").agg(F.count(F.lit(1)).alias("n_lines"), F.count_if(F.col("content") != "").alias("n_not_blank"), F.sum(F.col("line_number") * F.length("content")).cast("long").alias("places"))


def file_lines(spark, sf):
    """Lines of whole files, with their numbers."""
    return _file_sums(source.read_lines(spark, f"{_files(spark, sf)}/*/*.txt"))


def large_file_lines(spark, sf):
    """Lines of files that are split among tasks, with their numbers."""
    return _file_sums(source.read_large(spark, f"{_files(spark, sf)}/*/*.txt"))


def file_list(spark, sf):
    rows = source.list_files(spark, f"{_files(spark, sf)}/*/*.txt")
    return rows.select(_bucket("path").alias("bucket"), F.col("length").alias("bytes"))


def csv_header_file(spark, sf):
    """A file whose delimiter is found and whose column names are cleaned, two of them to the same name."""
    folder = scratch(spark, "csv-header")
    rows = _t(spark, sf, "customer").select(F.col("c_custkey").alias("Cust Key"), F.col("c_name").alias("Full Name"), F.concat(F.lit('say ""; '), F.col("c_name")).alias("full-name"))
    rows.write.csv(folder, header=True, sep=";", quote='"', escape='"')
    found = source.read_csv(spark, folder)
    return found.select(F.col("cust_key").cast("long").alias("cust_key"), "full_name", "full_name_2")


def json_lines_file(spark, sf):
    """Lines of JSON within the depth, beyond it, and of other text."""
    folder = scratch(spark, "json-lines")
    _events(spark, sf, "CASE event_id % 3 WHEN 0 THEN props WHEN 1 THEN '[[{\"k\": \"[[[[\"}]]' ELSE '[[[1]]]' || event_type END").select(F.col("content").alias("value")).write.text(folder)
    two, three = (source.read_json_lines(spark, folder, n).select(F.lit(n).alias("depth"), F.coalesce(F.to_json("payload"), F.lit("none")).alias("payload")) for n in (2, 3))
    return two.union(three).groupBy("depth", "payload").agg(F.count(F.lit(1)).alias("n"))


def config_values(spark, sf):
    """Values of a configuration file by their paths, with defaults, and what a broken and a missing file give."""
    import os
    import tempfile

    configure(spark)
    with tempfile.TemporaryDirectory() as folder:  # read by the driver, where it was written
        for name, text in (("good.yaml", "drain3:\n  depth: 5\n  original: {depth: 6}\n"), ("bad.yaml", "a: [")):
            with open(os.path.join(folder, name), "w", encoding="utf-8") as file:
                file.write(text)
        saved, settings = os.path.join(folder, "saved.yaml"), os.path.join(folder, "settings.json")
        done = analysis.save_config(saved, {"b": {"c": 8}, "a": 1}) and analysis.save_settings(settings, {"n": 9}) and not analysis.save_config(os.path.join(folder, "no", "x"), {})
        kept = [("saved", analysis.get_value(analysis.load_config(saved), "b.c")), ("settings", analysis.load_settings(settings)["n"]), ("no_settings", len(analysis.load_settings(os.path.join(folder, "none")))), ("done", int(done))]
        good, bad, missing = (analysis.load_config(os.path.join(folder, n)) for n in ("good.yaml", "bad.yaml", "none.yaml"))
    rows = [("depth", analysis.get_value(good, "drain3.depth")), ("own", analysis.miner_settings(good, "original")["depth"]), ("common", analysis.miner_settings(good, "anonymized")["depth"]), ("default", analysis.get_value(good, "drain3.x.y", 7)), ("bad", len(bad)), ("missing", len(missing)), *kept]
    return spark.createDataFrame(rows, "name string, value long")


def security_flags(spark, sf):
    texts = _events(spark, sf, _TEXT).select("event_id", "content").union(_events(spark, sf, _LINE).select("event_id", F.concat("content", F.when(F.col("event_id") % 5 == 0, " Error: access denied").when(F.col("event_id") % 5 == 1, " warning, failed login").otherwise(""))))
    pages = _t(spark, sf, "pages").select(F.col("page_id").alias("event_id"), F.col("html").alias("content"))
    return texts.union(pages).select("event_id", F.md5("content").alias("digest"), C.security_flags(F.col("content")).alias("f")).select("event_id", "digest", "f.*").withColumn("threat_indicators", F.array_join("threat_indicators", " "))


def csv_family(spark, sf):
    """Headers of each family, and one that has too few names of any."""
    headers = (["LineId", "EventId", "Content"], ["Event ID", "Source IP", "Destination IP", "User Agent", "Attack Type"], ["session_id", "login_attempts", "failed_logins", "browser_type", "attack_detected", "other"], ["LineId", "EventId", "Event ID", "Source IP", "User Agent", "session_id"])
    header = F.element_at(F.array(*(F.array(*map(F.lit, h)) for h in headers)), (F.col("c_custkey") % 4 + 1).cast("int"))
    return _t(spark, sf, "customer").select("c_custkey", C.csv_family(header).alias("family"))


_NAMES = (
    "timestamp", "event_date", "srcip", "client_ip", "user_id", "last_user", "pid", "srcport", "port_number", "msg", "log", "severity", "service", "module_name", "hostname", "server", "uri", "filepath",
    "e-mail", "mail", "sha256", "file_md5", "whatever",
)


def field_kinds(spark, sf):
    rows = _t(spark, sf, "events").select(F.explode(F.array(*(F.lit(n) for n in _NAMES), F.upper("event_type"))).alias("name"))
    return rows.groupBy("name").agg(F.count(F.lit(1)).alias("n")).select("name", C.field_kind(F.col("name")).alias("kind"), "n")


_VALUE = f"""CASE event_id % 8 WHEN 0 THEN '2024-01-01 10:00:00' WHEN 1 THEN '10.1.2.' || CAST(event_id % 200 AS STRING) WHEN 2 THEN 'user' || {_U} WHEN 3 THEN CAST(event_id % 90 + 10 AS STRING)
WHEN 4 THEN md5({_I}) WHEN 5 THEN 'u' || {_U} || '@example.org' WHEN 6 THEN '20240101-10:00:00:000' ELSE 'some words' END"""


def value_kinds(spark, sf):
    return _events(spark, sf, _VALUE, "value").select("event_id", "value", C.value_kind(F.col("value")).alias("kind"))


def clean_times(spark, sf):
    rows = _t(spark, sf, "events").select("event_id", F.concat(F.lit("at "), F.date_format("ts", "MM-dd,HH:mm:ss"), F.lit(".25 on")).alias("short"), F.concat(F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss"), F.lit("Z")).alias("iso"))
    return rows.select("event_id", C.clean_timestamp(F.col("short"), 2024).alias("short"), C.iso_to_plain(F.col("iso")).alias("iso"))


_FORMS = ("yyyy-MM-dd'T'HH:mm:ss'Z'", "yyyy-MM-dd HH:mm:ss.SSS", "yyyy-MM-dd-HH.mm.ss", "yyyy/MM/dd HH:mm:ss", "dd/MMM/yyyy:HH:mm:ss '+0000'", "yyyy.MM.dd", "yyyy-MM-dd", "MM-dd,HH:mm:ss.S")


def normalize_times(spark, sf):
    """Times in all formats, one without a year, and texts that are no times."""
    text = F.lit("no time")
    for k, form in enumerate(_FORMS):
        text = F.when(F.col("event_id") % 9 == k, F.date_format("ts", form)).otherwise(text)
    rows = _t(spark, sf, "events").select("event_id", C.normalize_time(text, 2024).alias("n"))
    return rows.select("event_id", "n.*")


def search_index(spark, sf):
    rows = _t(spark, sf, "events").select("event_id", "ts", F.col("props").alias("content"))
    return stats.search_index(rows, "ts").select("event_id", "year", "month", "day", "hour", "content_length")


def percentile_stats(spark, sf):
    n = F.col("n_chars")
    return _t(spark, sf, "documents").groupBy("lang").agg(F.count(F.lit(1)).alias("n"), F.min(n).alias("least"), F.max(n).alias("most"), F.round(F.avg(n), 6).alias("mean"), F.percentile(n, 0.5).alias("median"), F.round(F.stddev(n), 6).alias("deviation"))


def top_k(spark, sf):
    counts = _t(spark, sf, "events").groupBy("user_id").agg(F.count(F.lit(1)).alias("n"))
    return counts.orderBy(F.desc("n"), "user_id").limit(10)


def grouping_sets(spark, sf):
    return _t(spark, sf, "documents").rollup("lang", "source").agg(F.count(F.lit(1)).alias("n"), F.sum("n_chars").alias("chars"))


def running_count(spark, sf):
    over = Window.partitionBy("user_id").orderBy("ts", "event_id").rowsBetween(Window.unboundedPreceding, 0)
    return _t(spark, sf, "events").select("event_id", "user_id", F.count(F.lit(1)).over(over).alias("so_far"))


def error_frequencies(spark, sf):
    return _t(spark, sf, "events").groupBy("event_type").agg(F.count(F.lit(1)).alias("n"), F.round(100.0 * F.count_if(F.col("value") > 50) / F.count(F.lit(1)), 6).alias("rate"))


_ALL = (
    pii_counts_by_lang, redact_email, redact_ip, mask_credit_card, hash_key, content_hash, record_id, json_payload, json_parser, kv_pairs, csv_fields, lines, not_blank_lines, line_lookup, file_lines, large_file_lines,
    file_list, csv_header_file, json_lines_file, config_values, parser_distribution, parse_records, record_fields, json_fields, configured_parsers, own_parsers, key_union, overlapping_entities, anonymize_documents, entity_counts, anonymized_events, configured_strategies,
    entity_flags, hybrid_events, classic_anonymization, classic_placeholders, detections, previews, field_anonymization, recognizer_catalogue, template_mine, template_coverage, template_summary, event_templates, template_by_file,
    template_sizes, template_shares, template_classes, stream_templates, analysis_records, analysis_events, template_csv, text_report, json_report, output_names, mining_output, record_summary, anonymization_rate, field_counts,
    security_flags, csv_family, field_kinds, value_kinds, clean_times, normalize_times, search_index, percentile_stats, top_k, grouping_sets, running_count, error_frequencies,
)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in _ALL}


_LINES_SQL = r"""l AS (SELECT doc_id::VARCHAR AS source_file, i::BIGINT AS line_number, regexp_replace(parts[i], '^\s+|\s+$', '', 'g') AS content
  FROM (SELECT doc_id, parts, unnest(range(1, len(parts) + 1)) AS i FROM (SELECT doc_id, CASE WHEN p[-1] = '' THEN p[:-2] ELSE p END AS parts
    FROM (SELECT doc_id, regexp_split_to_array(text, '\r\n|\n|\r') AS p FROM documents WHERE text IS NOT NULL))))"""


# The parser chain over lines, and how many fields the first that fits finds.
_PARSED_SQL = r"""g AS (SELECT *, length(content) - length(replace(content, ',', '')) AS commas,
  len(regexp_extract_all(content, '(?:^|,)(?:"(?:[^"]|"")*"|[^,"]*)')) AS quoted, regexp_extract_all(content, '([\p{L}\p{N}_]+)=(?:"([^"]*)"|(\S+))', 1) AS kv FROM l WHERE content <> ''),
p AS (SELECT *, CASE WHEN content LIKE '{%' AND json_valid(content) THEN 'JSONParser' WHEN commas > 0 AND (content NOT LIKE '%"%' OR quoted > 1) THEN 'CSVParser'
  WHEN regexp_matches(content, '^CEF:\d+(\|[^|]*){6}\|') THEN 'CEFParser' WHEN len(kv) >= 3 THEN 'KeyValueParser'
  WHEN regexp_matches(content, '^\S+ \S+ \S+ \[[^\]]+\] "[^"]*" \d+ \S+') THEN 'apache_clf'
  WHEN regexp_matches(content, '^[\p{L}\p{N}_]{3}\s+\d{1,2}\s+\d{2}:\d{2}:\d{2}\s+\S+\s+\S+\[\d+\]:\s+') THEN 'syslog'
  WHEN regexp_matches(content, '^\d{4}-\d{2}-\d{2}\s+\d{2}:\d{2}:\d{2}(\s+\S+){4}\s+') THEN 'fortinet' ELSE 'FallbackParser' END AS parser_name FROM g)"""


# Events by type, which is what makes a cluster of their messages: how many there were so far, and of which users.
_CLUSTERS_SQL = """e AS (SELECT event_id, event_type, user_id::VARCHAR AS u, row_number() OVER w AS size, min(user_id) OVER w AS lo, max(user_id) OVER w AS hi, coalesce(min(user_id) OVER p <> max(user_id) OVER p, false) AS was FROM events
  WINDOW w AS (PARTITION BY event_type ORDER BY event_id ROWS UNBOUNDED PRECEDING), p AS (PARTITION BY event_type ORDER BY event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
c AS (SELECT event_type, row_number() OVER (ORDER BY min(event_id)) AS cluster_id FROM events GROUP BY event_type)"""

_MASKED_SQL = "'user <EMAIL_ADDRESS> from <IP_ADDRESS> card 1111-2************* mac 00:1a:*********** call 555-******** ticket '"

_FILES_SQL = r"""WITH s AS (SELECT doc_id % 16 AS bucket, doc_id, regexp_split_to_array(coalesce(text, '') || chr(10), '\r\n|\n|\r') AS p FROM documents),
l AS (SELECT bucket, doc_id, p, unnest(range(1, len(p))) AS i FROM s), n AS (SELECT bucket, regexp_replace(p[i], '^\s+|\s+$', '', 'g') AS content, row_number() OVER (PARTITION BY bucket ORDER BY doc_id, i) AS line_number FROM l)
SELECT bucket, count(*) AS n_lines, count(*) FILTER (content <> '') AS n_not_blank, sum(line_number * length(content))::BIGINT AS places FROM n GROUP BY bucket"""


def _fields_sql() -> str:
    placeholder = {"<IP>": ("ip_address", "srcip", "dstip", "ip"), "<MAC>": ("mac_address",), "<EMAIL>": ("email",), "<FILE_PATH>": ("path", "filename", "source_file"), "<DEVICE_NAME>": ("devname", "device_name"), "<HOSTNAME>": ("hostname",), "<DEVICE_ID>": ("fortinet_device",), "<VD>": ("VD",), "***": ("credit_card", "ssn", "phone")}
    shown = [f"'{name}={p}'" for p, names in placeholder.items() for name in names]
    shown += [f"'{name}=' || left(sha256('{patterns.FIELD_SALT}{name}-' || user_id::VARCHAR), 16)" for name in ("user_id", "session_id", "device_id")]
    return f"SELECT event_id, array_to_string(list_sort([{', '.join(shown)}, 'kind=kind-' || user_id::VARCHAR]), ';') AS fields FROM events"


def oracle_sql() -> dict[str, str]:
    with_lines = f"WITH {_LINES_SQL} "
    return {
        "pii_counts_by_lang": f"SELECT lang, sum(len(regexp_extract_all(text, '{patterns.ANONYMIZATION['email']}')))::BIGINT AS emails, sum(len(regexp_extract_all(text, '{patterns.DETECTION['ip_address']}')))::BIGINT AS ips FROM documents GROUP BY lang",
        "redact_email": f"SELECT doc_id, md5(regexp_replace(text, '{patterns.ANONYMIZATION['email']}', '<EMAIL>', 'g')) AS redacted FROM documents",
        "redact_ip": f"SELECT page_id, md5(regexp_replace(html, '{patterns.ANONYMIZATION['ip_address']}', '<IP>', 'g')) AS redacted FROM pages",
        "mask_credit_card": f"SELECT doc_id, (i - 1)::BIGINT AS i, c[i][:-5] || '####' AS masked FROM (SELECT doc_id, c, unnest(range(1, len(c) + 1)) AS i FROM (SELECT doc_id, regexp_extract_all(text, '{patterns.ANONYMIZATION['credit_card']}') AS c FROM documents))",
        "hash_key": f"SELECT event_id, left(sha256('{patterns.FIELD_SALT}' || user_id::VARCHAR), 16) AS hashed FROM events",
        "content_hash": "SELECT doc_id, left(sha256(text), 16) AS content_hash FROM documents",
        "record_id": "SELECT doc_id, left(sha256(source || ':' || doc_id || ':' || text), 16) AS id FROM documents",
        "json_payload": "SELECT event_id, json_extract_string(props, '$.k')::BIGINT AS k FROM events",
        "json_parser": "SELECT event_id, json_extract_string(props, '$.k') AS k, len(json_keys(props))::BIGINT AS n_keys FROM events",
        "kv_pairs": """WITH m AS (SELECT page_id, regexp_extract_all(html, '(\\w+)=(?:"([^"]*)"|(\\S+))', 1) AS k, regexp_extract_all(html, '(\\w+)=(?:"([^"]*)"|(\\S+))', 2) AS q, regexp_extract_all(html, '(\\w+)=(?:"([^"]*)"|(\\S+))', 3) AS u FROM pages),
r AS (SELECT page_id, k, q, u, unnest(range(1, len(k) + 1)) AS i FROM m WHERE len(k) >= 3)
SELECT page_id, k[i] AS key, arg_max(CASE WHEN coalesce(q[i], '') <> '' THEN q[i] ELSE coalesce(u[i], '') END, i) AS value FROM r GROUP BY page_id, k[i]""",
        "csv_fields": with_lines + """, f AS (SELECT source_file, line_number, list_transform(regexp_extract_all(',' || content, '(?s),(?:"(?:[^"]|"")*(?:"[^,]*|$)|[^,]*)'), lambda m: m[2:]) AS raw FROM l WHERE contains(content, ',')),
q AS (SELECT source_file, line_number, list_transform(raw, lambda m: CASE WHEN m[1] = '"' THEN replace(regexp_extract(m, '^"((?:[^"]|"")*)', 1), '""', '"') || regexp_extract(m, '(?s)^"(?:[^"]|"")*"([^"].*)$', 1) ELSE m END) AS f FROM f)
SELECT source_file, line_number, len(f)::BIGINT AS n_fields, f[1] AS first_field, f[-1] AS last_field FROM q WHERE len(f) > 1""",
        "lines": with_lines + "SELECT * FROM l",
        "not_blank_lines": with_lines + "SELECT source_file, count(*) AS n FROM l WHERE content <> '' GROUP BY source_file",
        "line_lookup": with_lines + "SELECT source_file, content FROM l WHERE line_number = 2",
        "parser_distribution": f"WITH {_LINES_SQL}, {_PARSED_SQL} SELECT parser_name, count(*) AS n FROM p GROUP BY parser_name",
        "parse_records": f"""WITH {_LINES_SQL}, {_PARSED_SQL} SELECT source_file, line_number, parser_name, CASE parser_name WHEN 'JSONParser' THEN len(json_keys(content)) WHEN 'CSVParser' THEN CASE WHEN content LIKE '%"%' THEN quoted ELSE commas + 1 END
WHEN 'CEFParser' THEN 7 + len(list_distinct(regexp_extract_all(content, '([\\p{{L}}\\p{{N}}_]+)=', 1))) WHEN 'KeyValueParser' THEN len(list_distinct(kv)) WHEN 'apache_clf' THEN 5 WHEN 'syslog' THEN 5 WHEN 'fortinet' THEN 6 ELSE 1 END::BIGINT AS n_fields FROM p""",
        "key_union": "SELECT key, count(*) AS n FROM (SELECT unnest(json_keys(props)) AS key FROM events) GROUP BY key",
        "field_anonymization": _fields_sql(),
        "event_templates": "SELECT event_type || ' by user with value ' || CASE WHEN count(DISTINCT user_id) > 1 THEN '<*>' ELSE min(user_id)::VARCHAR END AS template, count(*) AS size, min(event_id) AS first_seq FROM events GROUP BY event_type",
        "template_by_file": """WITH f AS (SELECT event_type, min(event_id) AS first FROM events GROUP BY event_type), c AS (SELECT event_type, row_number() OVER (ORDER BY first) AS cluster_id FROM f)
SELECT miner, source_file, cluster_id, grouping(source_file) = 1 AS overall, count(*) AS n FROM (SELECT 'events' AS miner, 'day-' || day(ts) AS source_file, cluster_id FROM events JOIN c USING (event_type))
GROUP BY GROUPING SETS ((miner, source_file, cluster_id), (miner, cluster_id))""",
        "template_csv": f"""WITH {_CLUSTERS_SQL} SELECT file, row_number() OVER (PARTITION BY file ORDER BY event_id)::BIGINT AS LineId, content AS raw_content, content AS Content, 'E' || cluster_id AS EventId, template AS EventTemplate FROM (
SELECT 'original' AS file, event_id, cluster_id, event_type || ' of u' || u || '@example.org accepted' AS content, event_type || ' of ' || CASE WHEN lo = hi THEN 'u' || u || '@example.org' ELSE '<*>' END || ' accepted' AS template FROM e JOIN c USING (event_type)
UNION ALL SELECT 'anonymized', event_id, cluster_id, event_type || ' of <EMAIL_ADDRESS> accepted', event_type || ' of <EMAIL_ADDRESS> accepted' FROM e JOIN c USING (event_type))""",
        "security_flags": f"""WITH t AS (SELECT event_id, {_TEXT} AS content FROM events UNION ALL SELECT event_id, {_LINE} || CASE event_id % 5 WHEN 0 THEN ' Error: access denied' WHEN 1 THEN ' warning, failed login' ELSE '' END FROM events UNION ALL SELECT page_id, html FROM pages),
w AS (SELECT *, lower(content) AS low FROM t)
SELECT event_id, md5(content) AS digest, regexp_matches(content, '{patterns.DETECTION['ip_address']}') AS has_ip, regexp_matches(content, '{patterns.ANONYMIZATION['email']}') AS has_email, regexp_matches(content, '{patterns.ANONYMIZATION['url']}') AS has_url,
regexp_matches(low, 'error|fail|critical|fatal') AS has_errors, regexp_matches(low, 'warn') AS has_warnings,
CASE WHEN regexp_matches(low, 'error|fail|critical|fatal') THEN 'high' WHEN regexp_matches(low, 'warn') THEN 'medium' ELSE 'low' END AS severity_level,
concat_ws(' ', CASE WHEN regexp_matches(low, 'attack|exploit|malware|intrusion') THEN 'attack' END, CASE WHEN regexp_matches(low, 'denied|unauthorized|forbidden') THEN 'denied' END, CASE WHEN regexp_matches(low, 'failed (login|password)|invalid user') THEN 'login' END) AS threat_indicators FROM w""",
        "csv_family": "SELECT c_custkey, CASE c_custkey % 4 WHEN 0 THEN 'loghub' WHEN 1 THEN 'cybersecurity' WHEN 2 THEN 'intrusion_data' END AS family FROM customer",
        "field_kinds": f"""SELECT name, CASE WHEN name IN ('timestamp', 'event_date') THEN 'timestamp' WHEN name IN ('srcip', 'client_ip') THEN 'ip_address' WHEN name IN ('user_id', 'last_user') THEN 'user_id' WHEN name = 'pid' THEN 'process_id'
WHEN name IN ('srcport', 'port_number') THEN 'port' WHEN name IN ('msg', 'log') THEN 'message' WHEN name = 'severity' THEN 'level' WHEN name IN ('service', 'module_name') THEN 'component' WHEN name IN ('hostname', 'server') THEN 'hostname'
WHEN name = 'uri' THEN 'url' WHEN name = 'filepath' THEN 'path' WHEN name IN ('e-mail', 'mail') THEN 'email' WHEN name IN ('sha256', 'file_md5') THEN 'hash' ELSE 'unknown' END AS kind, count(*) AS n
FROM (SELECT unnest([{", ".join(f"'{n}'" for n in _NAMES)}, upper(event_type)]) AS name FROM events) GROUP BY name""",
        "normalize_times": """SELECT event_id, CASE WHEN event_id % 9 IN (5, 6) THEN strftime(ts, '%Y-%m-%dT00:00:00') WHEN event_id % 9 = 7 THEN strftime(ts, '2024-%m-%dT%H:%M:%S') WHEN event_id % 9 < 5 THEN strftime(ts, '%Y-%m-%dT%H:%M:%S') END AS iso,
CASE WHEN event_id % 9 IN (0, 1, 7) THEN 0.9 WHEN event_id % 9 IN (2, 3, 4) THEN 0.85 WHEN event_id % 9 IN (5, 6) THEN 0.6 END::DOUBLE AS confidence,
CASE WHEN event_id % 9 IN (0, 1, 7) THEN 'explicit' WHEN event_id % 9 < 7 THEN 'pattern_inference' END AS origin FROM events""",
        "search_index": "SELECT event_id, year(ts)::INT AS year, month(ts)::INT AS month, day(ts)::INT AS day, hour(ts)::INT AS hour, length(props)::INT AS content_length FROM events",
        "percentile_stats": "SELECT lang, count(*) AS n, min(n_chars) AS least, max(n_chars) AS most, round(avg(n_chars), 6) AS mean, quantile_cont(n_chars, 0.5)::DOUBLE AS median, round(stddev(n_chars), 6) AS deviation FROM documents GROUP BY lang",
        "top_k": "SELECT user_id, count(*) AS n FROM events GROUP BY user_id ORDER BY n DESC, user_id LIMIT 10",
        "grouping_sets": "SELECT lang, source, count(*) AS n, sum(n_chars)::BIGINT AS chars FROM documents GROUP BY ROLLUP (lang, source)",
        "running_count": "SELECT event_id, user_id, count(*) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS so_far FROM events",
        "error_frequencies": "SELECT event_type, count(*) AS n, round(100.0 * count(*) FILTER (value > 50) / count(*), 6) AS rate FROM events GROUP BY event_type",
        "record_fields": f"""SELECT event_id, CASE event_id % 8 WHEN 0 THEN 'JSONParser' WHEN 1 THEN 'CSVParser' WHEN 2 THEN 'CEFParser' WHEN 3 THEN 'KeyValueParser' WHEN 4 THEN 'apache_clf' WHEN 5 THEN 'syslog' WHEN 6 THEN 'fortinet' ELSE 'FallbackParser' END AS parser_name,
CASE event_id % 8 WHEN 0 THEN 'k=' || json_extract_string(props, '$.k') WHEN 1 THEN 'field_1=' || event_type || ';field_2=say "' || {_U} || '", all;field_3=' || {_I} || ';field_4='
WHEN 2 THEN 'act=' || {_I} || ';device_product=gate;device_vendor=acme;device_version=1.0;msg=' || event_type || ' by user;name=other;severity=5;signature_id=' || {_U} || ';src=10.1.2.3;version=0'
WHEN 3 THEN 'devid=FG1;e=;type=last;user=user ' || {_U} WHEN 4 THEN 'bytes=' || {_I} || ';ip=10.0.0.7;request=GET /u/' || {_U} || ' HTTP/1.0;status=200;timestamp=10/Oct/2000:13:55:36 +0000'
WHEN 5 THEN 'hostname=host' || {_U} || ';message=' || event_type || ' happened;pid=' || {_I} || ';process=sshd;timestamp=Jan  5 10:00:00'
WHEN 6 THEN 'device_id=FG' || {_U} || ';level=notice;message=' || event_type || ' passed;subtype=forward;timestamp=2024-01-01 10:00:00;type=traffic' ELSE 'raw_content=' || event_type || ' happened to user ' || {_U} END AS fields FROM events""",
        "json_fields": f"""SELECT event_id, CASE event_id % 6 WHEN 1 THEN 'CSVParser' WHEN 2 THEN 'FallbackParser' WHEN 3 THEN 'FallbackParser' ELSE 'JSONParser' END AS parser_name,
CASE event_id % 6 WHEN 0 THEN 'a={{"b": [1, 2]}};f=1.5;s=x' || {_U} || ';t=true' WHEN 1 THEN 'field_1=[1;field_2= 2]' WHEN 2 THEN 'raw_content=' || {_JSON} WHEN 3 THEN 'raw_content={{"a": 1}} x' WHEN 4 THEN 'a=NaN' ELSE 'a=' || {_U} END AS fields, event_id % 6 = 0 AS has_payload FROM events""",
        "own_parsers": f"""SELECT event_id, CASE event_id % 8 WHEN 4 THEN 'AddressParser' WHEN 7 THEN 'own_format' ELSE 'FallbackParser' END AS parser_name,
CASE event_id % 8 WHEN 4 THEN 'first=10.0.0.7' WHEN 7 THEN 'the_kind=' || event_type || ';who=' || {_U} ELSE 'raw_content=' || {_LINE} END AS fields FROM events WHERE event_id % 8 IN (4, 5, 6, 7)""",
        "overlapping_entities": "SELECT event_id, 'see https://<EMAIL_ADDRESS>/x?ip=<IP_ADDRESS> end' AS anonymized, 'EMAIL_ADDRESS IP_ADDRESS' AS entities FROM events",
        "configured_parsers": f"""SELECT event_id, CASE event_id % 8 WHEN 1 THEN 'CSVParser' WHEN 2 THEN 'KeyValueParser' WHEN 3 THEN 'KeyValueParser' WHEN 4 THEN 'apache_clf' WHEN 5 THEN 'syslog' WHEN 6 THEN 'fortinet' ELSE 'FallbackParser' END AS parser_name,
CASE WHEN event_id % 8 = 1 THEN 'say "' || {_U} || '", all' END AS said, CASE event_id % 8 WHEN 1 THEN 4 WHEN 2 THEN 4 WHEN 3 THEN 4 WHEN 4 THEN 5 WHEN 5 THEN 5 WHEN 6 THEN 6 ELSE 1 END::BIGINT AS n_fields FROM events""",
        "anonymized_events": f"""SELECT event_id, {_MASKED_SQL} || left(sha256('{patterns.FIELD_SALT}T-' || {_I}), 16) || ' at <DATE_TIME> see <URL>' AS anonymized,
'EMAIL_ADDRESS IP_ADDRESS CREDIT_CARD MAC_ADDRESS PHONE_NUMBER TICKET DATE_TIME URL' AS entities FROM events""",
        "hybrid_events": f"""SELECT event_id, {_MASKED_SQL} || 'T-' || {_I} || ' at <DATE_TIME> see <URL>' AS anonymized,
'user <EMAIL> from <IP_ADDRESS> card <CREDIT_CARD> mac <MAC_ADDRESS> call <PHONE> ticket T-' || {_I} || ' at <TIMESTAMP> see <URL>' AS anonymized_classic FROM events""",
        "configured_strategies": f"""SELECT event_id, 'user ' || left(sha256('test-saltu' || {_U} || '@example.org'), 16) || ' from <REDACTED> card 1111-2222-3333-' || lpad(CAST(event_id % 10000 AS STRING), 4, '0')
|| ' mac 00:1a:2b:3c:4d:5e call 555-123-#### ticket T-' || {_I} || ' at <REDACTED> see <REDACTED>' AS anonymized FROM events""",
        "entity_flags": f"SELECT event_id, replace({_TEXT}, 'u' || {_U} || '@example.org', '<EMAIL_ADDRESS>') AS some, {_TEXT} AS none FROM events",
        "classic_placeholders": f"""SELECT event_id, 'host <HOSTNAME_PORT> and <IP><SSH_PORT> port <PORT_NUMBER> <NUMERIC_ID>' AS anonymized, 'host a' || {_U} || '.example.org:443 and <IP_ADDRESS><SSH_PORT> port :8080 id=12345' AS some FROM events""",
        "detections": f"""WITH t AS MATERIALIZED (SELECT {_LINE} AS content FROM events UNION ALL SELECT {_TEXT} FROM events UNION ALL SELECT {_PORTS} FROM events) SELECT * FROM ("""
        + " UNION ALL ".join(f"SELECT '{name}' AS name, count(*) FILTER (n > 0) AS n_lines, sum(n)::BIGINT AS n FROM (SELECT len(regexp_extract_all(content, '{p}')) AS n FROM t)" for name, p in (patterns.DETECTION | patterns.SERVICE_PORTS).items())
        + ") WHERE n > 0",
        "previews": "SELECT * FROM (VALUES ('empty', ''), ('disabled', '[PREVIEW] Presidio is disabled.'), ('nothing', '[PREVIEW] No entities enabled.'), ('some', 'a@b.co at <URL>'), ('all', '<EMAIL_ADDRESS> at <URL>')) AS t(name, shown)",
        "recognizer_catalogue": r"""SELECT * FROM (VALUES ('EMAIL_ADDRESS', true, 'replace', 1.0::DOUBLE, '\b[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Z|a-z]{2,}\b'), ('URL', true, 'replace', 0.9, 'https?://[^\s<>"{}|\^`\[\]\\]+'),
('IP_ADDRESS', false, 'replace', 0.95, '\b(?:(?:25[0-5]|2[0-4][0-9]|[01]?[0-9][0-9]?)\.){3}(?:25[0-5]|2[0-4][0-9]|[01]?[0-9][0-9]?)\b'), ('MAC_ADDRESS', false, 'mask', 0.95, '\b(?:[0-9A-Fa-f]{2}[:-]){5}[0-9A-Fa-f]{2}\b'),
('UUID', false, 'hash', 0.95, '[0-9a-fA-F]{8}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{12}'), ('CREDIT_CARD', false, 'mask', 0.9, '\b\d{4}[- ]?\d{4}[- ]?\d{4}[- ]?\d{4}\b'), ('PHONE_NUMBER', false, 'mask', 0.75, '\b\d{3}[-.]?\d{3}[-.]?\d{4}\b'),
('DATE_TIME', false, 'replace', 0.85, '\d{4}-\d{2}-\d{2}[T ]\d{2}:\d{2}:\d{2}(?:\.\d+)?(?:Z|[+-]\d{2}:?\d{2})?'), ('TICKET', true, 'hash', 0.9, '\bT-\d+')) AS t(entity, enabled, strategy, score, pattern)""",
        "template_sizes": f"""WITH {_CLUSTERS_SQL} SELECT event_id AS seq, cluster_id, size AS cluster_size, CASE WHEN size = 1 THEN 'cluster_created' WHEN lo <> hi AND NOT was THEN 'cluster_template_changed' ELSE 'none' END AS change_type FROM e JOIN c USING (event_type)""",
        "template_shares": f"""WITH {_CLUSTERS_SQL} SELECT 'events' AS miner, cluster_id, event_type || ' by user with value ' || CASE WHEN min(lo) <> max(hi) THEN '<*>' ELSE min(u) END AS template, count(*) AS size, min(event_id) AS first_seq,
round(100.0 * count(*) / (SELECT count(*) FROM events), 6) AS percentage, CASE WHEN min(lo) <> max(hi) THEN 1 ELSE 0 END::INT AS wildcards FROM e JOIN c USING (event_type) GROUP BY event_type, cluster_id""",
        "template_classes": """WITH p AS (SELECT round(100.0 * count(*) / (SELECT count(*) FROM events), 6) AS p FROM events GROUP BY event_type)
SELECT 'events' AS miner, count(*) AS templates, count(*) FILTER (p >= 20) AS high, count(*) FILTER (p < 20 AND p >= 5) AS medium, count(*) FILTER (p < 5) AS low, round(avg(p), 4) AS avg, round(max(p), 4) AS max, round(min(p), 4) AS min FROM p""",
        "stream_templates": "SELECT 6::INT AS n_tokens, event_type AS first, count(*) AS size, 1::BIGINT AS created FROM events GROUP BY event_type",
        "analysis_events": f"""WITH {_CLUSTERS_SQL} SELECT 2 * event_id + 5 AS line_number, 'FallbackParser' AS parser_name, event_type || ' of <EMAIL_ADDRESS> accepted' AS anonymized, cluster_id AS cluster_id_original,
event_type || ' of ' || CASE WHEN lo = hi THEN 'u' || u || '@example.org' ELSE '<*>' END || ' accepted' AS template_original, CASE WHEN size = 1 THEN 'cluster_created' WHEN lo <> hi AND NOT was THEN 'cluster_template_changed' ELSE 'none' END AS change_type_original,
cluster_id AS cluster_id_anonymized, event_type || ' of <EMAIL_ADDRESS> accepted' AS template_anonymized, CASE WHEN size = 1 THEN 'cluster_created' ELSE 'none' END AS change_type_anonymized FROM e JOIN c USING (event_type)""",
        "text_report": "SELECT event_type || ' of <EMAIL_ADDRESS> accepted' AS value, count(*) AS n FROM events GROUP BY event_type",
        "json_report": f"""SELECT file, event_id, CASE event_id % 8 WHEN 0 THEN 'JSONParser' WHEN 1 THEN 'CSVParser' WHEN 2 THEN 'CEFParser' WHEN 3 THEN 'KeyValueParser' WHEN 4 THEN 'apache_clf' WHEN 5 THEN 'syslog' WHEN 6 THEN 'fortinet' ELSE 'FallbackParser' END AS parser_name,
{_LINE} AS content, CASE WHEN event_id % 8 = 0 THEN replace(props, ' ', '') END AS payload, file = 'report' AS has_none FROM events, (VALUES ('records'), ('report')) AS f(file)""",
        "output_names": "SELECT * FROM (VALUES ('anonymize', 'app_anonymize_20240101_000000.txt'), ('logppt', 'app_logppt_20240101_000000.csv'), ('json_report', 'app_json_report_20240101_000000.json')) AS t(kind, name)",
        "mining_output": f"""WITH {_CLUSTERS_SQL} SELECT form, cluster_id, event_type || ' by user with value ' || CASE WHEN min(lo) <> max(hi) THEN '<*>' ELSE min(u) END AS template, count(*) AS size FROM e JOIN c USING (event_type), (VALUES ('json'), ('csv'), ('parquet')) AS f(form) GROUP BY form, event_type, cluster_id""",
        "record_summary": f"""WITH t AS (SELECT event_id, length({_LINE}) AS n FROM events) SELECT count(*) AS total, count(*) FILTER (event_id % 8 <> 7) AS parsed, round(count(*) FILTER (event_id % 8 <> 7) / count(*), 6) AS success_rate, min(n)::INT AS min_length, max(n)::INT AS max_length,
round(avg(n), 6) AS avg_length, quantile_cont(n, 0.5)::DOUBLE AS median_length, round(stddev(n), 6) AS stddev_length FROM t""",
        "anonymization_rate": "SELECT count(*) AS total, count(*) FILTER (event_id % 3 = 0) AS anonymized, round(count(*) FILTER (event_id % 3 = 0) / count(*), 6) AS rate, (7 * count(*) FILTER (event_id % 3 = 0))::BIGINT AS spans FROM events",
        "field_counts": """WITH f AS (SELECT unnest(CASE event_id % 8 WHEN 0 THEN ['k'] WHEN 1 THEN ['field_1', 'field_2', 'field_3', 'field_4'] WHEN 2 THEN ['version', 'device_vendor', 'device_product', 'device_version', 'signature_id', 'name', 'severity', 'src', 'msg', 'act']
WHEN 3 THEN ['devid', 'user', 'type', 'e'] WHEN 4 THEN ['ip', 'timestamp', 'request', 'status', 'bytes'] WHEN 5 THEN ['timestamp', 'hostname', 'process', 'pid', 'message'] WHEN 6 THEN ['timestamp', 'device_id', 'type', 'subtype', 'level', 'message'] ELSE ['raw_content'] END) AS field FROM events)
SELECT field, count(*) AS n, count(*) FILTER (field IN ('ip', 'hostname', 'device_id')) AS n_anonymized FROM f GROUP BY field""",
        "file_lines": _FILES_SQL,
        "large_file_lines": _FILES_SQL,
        "file_list": "SELECT doc_id % 16 AS bucket, sum(strlen(coalesce(text, '')) + 1)::BIGINT AS bytes FROM documents GROUP BY 1",
        "csv_header_file": "SELECT c_custkey AS cust_key, c_name AS full_name, 'say \"\"; ' || c_name AS full_name_2 FROM customer",
        "json_lines_file": """WITH t AS (SELECT depth, CASE event_id % 3 WHEN 0 THEN replace(props, ' ', '') WHEN 1 THEN CASE WHEN depth = 3 THEN '[[{"k":"[[[["}]]' ELSE 'none' END ELSE 'none' END AS payload FROM events, (VALUES (2), (3)) AS d(depth))
SELECT depth::INT AS depth, payload, count(*) AS n FROM t GROUP BY depth, payload""",
        "config_values": "SELECT * FROM (VALUES ('depth', 5::BIGINT), ('own', 6), ('common', 5), ('default', 7), ('bad', 0), ('missing', 0), ('saved', 8), ('settings', 9), ('no_settings', 0), ('done', 1)) AS t(name, value)",
        "value_kinds": f"SELECT event_id, {_VALUE} AS value, CASE event_id % 8 WHEN 0 THEN 'timestamp' WHEN 1 THEN 'ip_address' WHEN 2 THEN 'user_id' WHEN 3 THEN 'process_id' WHEN 4 THEN 'hash' WHEN 5 THEN 'email' WHEN 6 THEN 'timestamp' ELSE 'unknown' END AS kind FROM events",
        "clean_times": "SELECT event_id, 'at 2024-' || strftime(ts, '%m-%d %H:%M:%S') || '.25 on' AS short, strftime(ts, '%Y-%m-%d %H:%M:%S') || 'Z' AS iso FROM events",
    }
