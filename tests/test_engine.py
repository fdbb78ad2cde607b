"""Parsers, anonymization, templates, sources and sinks on small inputs."""

import itertools
import random
import threading

import pytest
from pyspark.sql import functions as F

from logloom.functions import columns as C
from logloom.functions import patterns
from logloom.operators import anonymize, parsers, templates
from logloom.plans import analysis
from logloom.sinks import reports
from logloom.sources import lines as source

CASES = [
    ('{"a": 1, "b": "x"}', "JSONParser", {"a": "1", "b": "x"}),
    ('{"a":1} x', "FallbackParser", None),
    ("{'a':1}", "FallbackParser", None),
    ('{"a":NaN}', "JSONParser", {"a": "NaN"}),
    ('{"a":1,"a":2}', "JSONParser", {"a": "2"}),
    ("[1]", "FallbackParser", None),
    ("3", "FallbackParser", None),
    ('"x ""y"" z",2', "CSVParser", {"field_1": 'x "y" z', "field_2": "2"}),
    ("a,b,,", "CSVParser", {"field_1": "a", "field_2": "b", "field_3": "", "field_4": ""}),
    ('k="a b" z=1 e="" u="op en', "KeyValueParser", {"k": "a b", "z": "1", "e": "", "u": '"op'}),
    ("çà=1 b=2 c=3", "KeyValueParser", {"çà": "1", "b": "2", "c": "3"}),
    ("a=1 b=2", "FallbackParser", None),
    ("a=1 a=2 a=3", "KeyValueParser", {"a": "3"}),
    ("CEF:0|v|p|1|id|n|5|src=1 msg=a b c dst=2", "CEFParser", {"version": "0", "device_vendor": "v", "device_product": "p", "device_version": "1", "signature_id": "id", "name": "n", "severity": "5", "src": "1", "msg": "a b c", "dst": "2"}),
    ("CEF:0|v|p|1|id|n|5|free text", "CEFParser", {"version": "0", "device_vendor": "v", "device_product": "p", "device_version": "1", "signature_id": "id", "name": "n", "severity": "5", "raw_extension": "free text"}),
    ("CEF:0|v|p|1|id|n|5|a=1, b=2", "CSVParser", None),
    ("host CEF:0|v|p|1|id|n|5|x", "FallbackParser", None),
    ('1.2.3.4 - - [10/Oct/2000:13:55:36] "GET / HTTP/1.0" 200 2326', "apache_clf", {"ip": "1.2.3.4", "timestamp": "10/Oct/2000:13:55:36", "request": "GET / HTTP/1.0", "status": "200", "bytes": "2326"}),
    ("Jan  5 10:00:00 host sshd[42]: hello there", "syslog", {"timestamp": "Jan  5 10:00:00", "hostname": "host", "process": "sshd", "pid": "42", "message": "hello there"}),
    ("2024-01-01 10:00:00 FG1 traffic forward notice some message", "fortinet", None),
    ("2025-01-01T00:00:00Z web app[1]: plain", "FallbackParser", None),
]


def test_parser_chain(spark):
    rows = spark.createDataFrame([(i, c[0]) for i, c in enumerate(CASES)], "i int, content string")
    for r in parsers.parse(rows).orderBy("i").collect():
        text, name, data = CASES[r["i"]]
        assert r["parser_name"] == name, text
        if data is not None:
            assert r["parsed_data"] == data, text
        assert (r["payload"] is not None) <= (name == "JSONParser")


def test_csv_with_header_and_disabled_parsers(spark):
    rows = spark.createDataFrame([("1;2",), ("1;2;3",)], "content string")
    own = parsers.chain({"parsers": {"csv": {"delimiter": ";", "header": ["a", "b"]}, "json": {"enabled": False}}})
    assert own[0].name == "CSVParser"
    found = [(r["parser_name"], r["parsed_data"]) for r in parsers.parse(rows, own).collect()]
    assert found == [("CSVParser", {"a": "1", "b": "2"}), ("FallbackParser", {"raw_content": "1;2;3"})]


def test_csv_fields_query_takes_every_line(spark, tmp_path):
    import csv

    from logloom import queries

    texts = ['"x ""y"" z",2\nplain,a,b\nno comma', 'say "hi, all", then\n"open, to the end\n"one, field"\n"",', "a,\n\n\"", '"a"b,c" d,e', None, ""]
    spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string").write.parquet(f"file://{tmp_path}/documents.parquet")
    want = {}
    for i, t in enumerate(texts):
        for k, line in enumerate((t or "").split("\n"), 1):
            fields = next(csv.reader([line.strip()]), [])
            if len(fields) > 1:
                want[str(i), k] = (len(fields), fields[0], fields[-1])
    got = {(str(r["source_file"]), r["line_number"]): (r["n_fields"], r["first_field"], r["last_field"]) for r in queries.csv_fields(spark, f"file://{tmp_path}").collect()}
    assert got == want and ("0", 1) in got and len(got) > 5


def test_csv_fields_equal_the_csv_module(spark):
    import csv

    rng = random.Random(11)
    texts = ["".join(rng.choice('",a b"') for _ in range(rng.randrange(0, 14))) for _ in range(1_500)] + ['"' + "x" * 50_000 + '",y', '""' * 3_000 + ",b", '"' + '""' * 3_000 + ",b", "a," + "z" * 140_000]
    for delimiter in (",", ";"):
        rows = spark.createDataFrame([(i, t.replace(",", delimiter)) for i, t in enumerate(texts)], "i int, content string").repartition(4)
        for r in rows.select("i", parsers.csv_fields(F.col("content"), delimiter).alias("f")).collect():
            want = next(csv.reader([texts[r["i"]].replace(",", delimiter)], delimiter=delimiter), []) if len(texts[r["i"]]) < 120_000 else []
            assert (r["f"] or []) == (want if len(want) > 1 else []), texts[r["i"]][:80]


def test_pairs_equal_the_pattern(spark):
    import re

    rng = random.Random(13)
    texts = ["".join(rng.choice('ab= "é_') for _ in range(rng.randrange(0, 24))) for _ in range(1_500)] + ["w" * 200_000, "w" * 100_000 + "=1 b=2 c=3"]
    rows = spark.createDataFrame(list(enumerate(texts)), "i int, content string").repartition(4)
    for r in rows.select("i", parsers.key_value_parser()(F.col("content")).alias("m")).collect():
        found = re.findall(r'(\w+)=(?:"([^"]*)"|(\S+))', texts[r["i"]]) if len(texts[r["i"]]) < 1_000 or "=" in texts[r["i"]] else []
        assert r["m"] == ({k: q or u for k, q, u in found} if len(found) >= 3 else None), texts[r["i"]][:80]
    two = spark.createDataFrame([("a:=1 b:=\"x y\" c:=3",), ("a1 bx2 cx3 dx4",)], "content string")
    assert two.select(parsers.key_value_parser(":=")(F.col("content")).alias("m")).first()["m"] == {"a": "1", "b": "x y", "c": "3"}


def test_known_hashes_and_masks(spark):
    one = spark.range(1)
    r = one.select(C.hash_value(F.lit("session_id")).alias("a"), C.hash_value(F.lit("SID_00001")).alias("b"), C.mask_value(F.lit("555-1234"), "#", 4).alias("c"), C.mask_value(F.lit("s 555-12"), "#", 4).alias("d")).first()
    assert tuple(r) == ("93ebce33ced70b9b", "ceda68dab4393273", "555-####", "s 55####")


def test_anonymize_strategies(spark):
    config = {
        "analyzer": {"ad_hoc_recognizers": [{"name": "TICKET", "regex": r"T-\d+", "score": 0.9, "strategy": "hash"}]},
        "anonymizer": {"strategies": {"DEFAULT": "replace", "PHONE_NUMBER": "mask", "CREDIT_CARD": "keep"}, "strategy_config": {"replace": {"new_value": "<REDACTED>"}, "mask": {"masking_char": "#", "chars_to_mask": 4, "from_end": True}, "hash": {"algorithm": "sha256", "salt": "test-salt"}}},
    }
    rows = spark.createDataFrame([("mail a@b.co call 555-123-4567 card 1111-2222-3333-4444 T-12",), ("",), (None,), ("clean",)], "content string")
    found = anonymize.anonymize(rows, known=anonymize.recognizers(config), ops=anonymize.operators(config)).collect()
    assert found[0]["anonymized"].startswith("mail <REDACTED> call 555-123-#### card 1111-2222-3333-4444 ")
    assert [s["entity_type"] for s in found[0]["pii"]] == ["EMAIL_ADDRESS", "PHONE_NUMBER", "CREDIT_CARD", "TICKET"]
    assert [(r["anonymized"], r["pii"]) for r in found[1:]] == [("", []), (None, None), ("clean", [])]
    with pytest.raises(ValueError):
        anonymize.Operators({"X": "other"}).apply("X", "v")


def test_strategies_agree_with_the_columns(spark):
    """The same masks and hashes in detected spans and in fields."""
    values = ["", "a", "555-1234", "é-1 x", "1111-2222-3333-4444", "\U0001f600ab"]
    rows = spark.createDataFrame([(v,) for v in values], "v string")
    for from_end in (True, False):
        for keep in (True, False):
            for how in ({"chars_to_mask": 4, "masking_char": "#"}, {"mask_ratio": 0.7, "mask_char": "$"}):
                ops = anonymize.Operators({"X": "mask"}, {"mask": {**how, "from_end": from_end, "preserve_format": keep}})
                own = C.mask_value(F.col("v"), how.get("masking_char", how.get("mask_char")), how.get("chars_to_mask"), how.get("mask_ratio", 0.7), from_end, keep)
                assert {r["v"]: r["m"] for r in rows.select("v", own.alias("m")).collect()} == {v: ops.apply("X", v) for v in values}
    hashed = anonymize.Operators({"X": "hash"}, {"hash": {"salt": "s", "truncate_length": 12, "include_entity_type": True}})
    assert {r["v"]: r["m"] for r in rows.select("v", C.hash_value(F.col("v"), "s", 12, "X_").alias("m")).collect()} == {v: hashed.apply("X", v) for v in values}


def test_always_anonymized_fields(spark):
    names = "ip_address user_id session_id device_id mac_address email phone credit_card ssn path srcip dstip ip devname hostname device_name fortinet_device filename source_file vd".split()
    assert sorted(patterns.ALWAYS_ANONYMIZE) == sorted(names)
    one = spark.createDataFrame([({n: f"clear {n}" for n in names} | {"SRCIP": "clear", "other": "shown", "empty": ""},), (None,)], "m map<string,string>")
    got = one.select(anonymize.anonymize_fields(F.col("m")).alias("m")).collect()
    assert got[1]["m"] is None and got[0]["m"]["other"] == "shown" and got[0]["m"]["empty"] == "" and got[0]["m"]["SRCIP"] == "<IP>"
    assert not [v for k, v in got[0]["m"].items() if "clear" in v]
    rules = anonymize.field_rules({"drain3": {"anonymization": {"always_anonymize": ["other"], "methods": {"hash": {"fields": ["other"], "salt": "s"}}}}})
    assert one.select(anonymize.anonymize_fields(F.col("m"), **rules).alias("m")).first()["m"]["user_id"] == "clear user_id"
    assert anonymize.field_rules({"drain3": {"anonymization": {"enabled": False}}}) == {"names": ()}


def test_flags_and_miner_settings():
    assert analysis.enabled_entities({}) is None
    assert analysis.enabled_entities({"analyzer": {"entities": {"URL": False}}}) == set()
    assert analysis.enabled_entities({"analyzer": {"entities": {"url": True, "EMAIL_ADDRESS": False}}}) == {"URL"}
    config = {"drain3": {"depth": 5, "original": {"similarity_threshold": 0.9}, "anonymized": {"depth": 6, "max_children": 3}}}
    assert analysis.miner_settings(config, "original") == {"similarity": 0.9, "depth": 5, "max_children": 1000}
    assert analysis.miner_settings(config, "anonymized") == {"similarity": 0.4, "depth": 6, "max_children": 3}


def test_encodings_and_json_depth(spark, tmp_path):
    assert source.detect_encoding(b"plain") == "utf-8-sig" and source.detect_encoding("é".encode()[:1]) == "utf-8-sig"  # a cut character
    assert source.detect_encoding(b"caf\xe9 x") == "latin-1" and source.decode("a é".encode("utf-16")) == "a é"
    assert source.decode(b"a" * source.PROBE + b"\xff\xfeb") == "a" * source.PROBE + "b"  # bytes that do not belong go
    (tmp_path / "x.csv").write_text("A b;a-B;c\n1;2;3\n")
    df = source.read_csv(spark, f"file://{tmp_path}/x.csv")
    assert df.columns == ["a_b", "a_b_2", "c"] and source.read_csv(spark, f"file://{tmp_path}/x.csv", config={"auto_detect_delimiter": False}).columns == ["a_b_a_b_c"]
    assert source.read_csv(spark, f"file://{tmp_path}/x.csv", config={"supported_delimiters": ["-", "|"]}).columns == ["a_b_a", "b_c"]


def test_white_space_is_one_thing(spark):
    """What strips, what splits and what counts tokens agree, for control characters too."""
    texts = ["a\x1fb c", "\x1ca b\x85c\x1d", "\u2003x\u3000", "", " ", "a\u200bb"]
    rows = spark.createDataFrame(list(enumerate(texts)), "i int, t string")
    for r in rows.select("i", C.strip(F.col("t")).alias("s"), templates.n_tokens(F.col("t")).alias("n")).collect():
        assert r["s"] == texts[r["i"]].strip() and r["n"] == len(texts[r["i"]].split())
    messages = ["a\x1fb c", "a x c", "a b", "a\x1cy"]
    one = templates.Miner()
    want = [one.add(m)[:2] for m in messages]
    got = templates.mine(spark.createDataFrame([("m", i, m) for i, m in enumerate(messages)], "miner string, seq long, message string"))
    assert [(r["cluster_id"], r["template"]) for r in got.orderBy("seq").collect()] == want


def test_ordinals_run_on_through_the_files(spark):
    rows = [("b", 7), ("a", 2), ("a", 9), ("c", 1), ("b", 3)]
    got = {(r["source_file"], r["line_number"]): r["ordinal"] for r in reports.ordinals(spark.createDataFrame(rows, "source_file string, line_number long")).collect()}
    assert got == {at: k for k, at in enumerate(sorted(rows), 1)}


def test_too_many_keys_are_refused(spark, monkeypatch):
    from logloom.operators import stats

    monkeypatch.setattr(stats, "MOST_KEYS", 3)
    rows = spark.range(4).select(F.create_map(F.concat(F.lit("k"), F.col("id").cast("string")), F.lit("v")).alias("parsed_data"))
    assert stats.keys(rows.limit(3)) and len(stats.keys(rows.limit(3))) == 3
    with pytest.raises(ValueError, match="distinct keys"):
        stats.keys(rows)


def test_overlaps_are_settled():
    spans = [("A", 0, 5, 0.8, ""), ("B", 3, 9, 0.9, ""), ("C", 9, 12, 0.8, ""), ("D", 9, 14, 0.8, "")]
    assert [s[0] for s in anonymize.settle(spans)] == ["B", "D"]


def test_patterns_translate():
    java, names = patterns.to_java(r"^(?P<a_b>\w+) (x|y) (?:z) [(] (?P<c>.)")
    assert names == ["a_b", "", "c"] and "?P" not in java


def test_parallel_mining_equals_sequential(spark):
    rng = random.Random(5)
    words = ["user", "login", "from", "10.0.0.1", "failed", "port", "42", "x1", "ok"]
    messages = [" ".join(rng.choice(words) for _ in range(rng.randrange(0, 6))) for _ in range(400)]
    one = templates.Miner()
    want = [(i, *one.add(m)) for i, m in enumerate(messages)]
    rows = spark.createDataFrame([("m", i, m) for i, m in enumerate(messages)], "miner string, seq long, message string").repartition(7)
    mined = templates.mine(rows)
    got = [(r["seq"], r["cluster_id"], r["template"], r["change_type"]) for r in mined.orderBy("seq").collect()]
    assert got == want
    assert sum(r["size"] for r in templates.final_templates(mined).collect()) == len(messages)
    assert max(r["cluster_size"] for r in templates.running_size(mined).collect()) == max(r["size"] for r in templates.final_templates(mined).collect())


@pytest.mark.parametrize("similarity", [0.0, 0.4, 0.75, 1.0])
def test_candidates_are_all_that_matter(similarity, monkeypatch):
    """Looking at the candidates gives what looking at every cluster by the definition gives."""
    rng = random.Random(17)
    words = [f"w{chr(97 + k)}" for k in range(12)] + ["7", "<*>"]
    messages = [" ".join(["head", *(rng.choice(words) for _ in range(rng.randrange(0, 9)))]) for _ in range(1_500)] + ["", "", "<*>"]
    one, every = templates.Miner(similarity), templates.Miner(similarity)

    def best(leaf, tokens):
        ranked = [(sum(a == b != templates.WILD for a, b in zip(c.tokens, tokens, strict=True)), c.tokens.count(templates.WILD), -c.number, c) for c in leaf.clusters]
        same, *_, cluster = max(ranked, key=lambda r: r[:3])
        return cluster if not tokens or same / len(tokens) >= similarity else None

    every._best = best
    got = [one.add(m) for m in messages]
    assert got == [every.add(m) for m in messages] and (one.count > 40 or similarity == 0.0)


def test_numbers_of_clusters(spark):
    rng = random.Random(4)
    seqs = sorted({rng.randrange(0, 1 << 22) for _ in range(60)} | {rng.randrange(0, 1 << 62) for _ in range(60)} | {(1 << 41) + k for k in range(40)} | {0, (1 << 20) - 1, 1 << 20})
    rows = [("a", s) for s in seqs] + [("b", s) for s in seqs[::3]]
    got = {(r["miner"], r["first_seq"]): r["cluster_id"] for r in templates.numbered(spark.createDataFrame(rng.sample(rows, len(rows)), "miner string, first_seq long")).collect()}
    assert got == {("a", s): k for k, s in enumerate(seqs, 1)} | {("b", s): k for k, s in enumerate(seqs[::3], 1)}


def test_clusters_by_file(spark):
    mined = spark.createDataFrame([("m", 1, 1), ("m", 2, 1), ("m", 3, 2), ("m", 4, 1)], "miner string, seq long, cluster_id long")
    files = spark.createDataFrame([("m", 1, "a"), ("m", 2, "b"), ("m", 3, "a")], "miner string, seq long, source_file string")
    got = {(r["source_file"], r["cluster_id"], r["overall"], r["n"]) for r in templates.by_file(mined, files).collect()}
    assert got == {("a", 1, False, 1), ("b", 1, False, 1), (None, 1, False, 1), ("a", 2, False, 1), (None, 1, True, 3), (None, 2, True, 1)}


def test_template_queries_tell_lines_of_long_documents_apart(spark, monkeypatch):
    from logloom import queries

    rows = [("1", 1_000_001, "a long way down"), ("2", 1, "other"), ("1", 2, "a long way up"), ("-1", (1 << 31) - 1, "first of all"), ("4294967295", (1 << 31) - 1, "last of all here")]
    monkeypatch.setattr(queries, "_lines", lambda spark, sf: spark.createDataFrame(rows, "source_file string, line_number long, content string"))
    got = queries.template_mine(spark, "").orderBy("seq").collect()
    assert [(r["cluster_id"], r["template"]) for r in got] == [(1, "first of all"), (2, "a long way up"), (2, "a long way <*>"), (3, "other"), (4, "last of all here")]
    assert sum(r["size"] for r in queries.template_coverage(spark, "").collect()) == len(rows)
    assert queries.template_summary(spark, "").first()["templates"] == 4
    rows.append(("4294967296", 1, "too far"))
    with pytest.raises(Exception, match="does not fit"):
        queries.template_mine(spark, "").collect()


def test_known_template():
    miner = templates.Miner()
    head = "- {} 2005.06.03 R02-M1-N0-C:J12-U11 {} R02-M1-N0-C:J12-U11 RAS KERNEL INFO instruction cache parity error corrected"
    miner.add(head.format("1117838570", "2005-06-03-15.42.50.675872"))
    assert miner.add(head.format("1117838573", "2005-06-03-15.42.53.276129")) == (1, head.format("<*>", "<*>"), "cluster_template_changed")


def test_lines_and_files(spark, tmp_path):
    (tmp_path / "a.log").write_bytes("﻿ one\t\r\n\r\ntwo\rthree é\n".encode())
    (tmp_path / "b.log").write_bytes(b"caf\xe9 x")
    rows = source.read_lines(spark, f"file://{tmp_path}").orderBy("source_file", "line_number").collect()
    assert [(r["source_file"][-5:], r["line_number"], r["content"]) for r in rows] == [("a.log", 1, "one"), ("a.log", 2, ""), ("a.log", 3, "two"), ("a.log", 4, "three é"), ("b.log", 1, "café x")]
    big = tmp_path / "big"
    big.mkdir()
    (big / "c.log").write_text("".join(f"line {i}\n" for i in range(1, 5001)))
    spark.conf.set("spark.sql.files.maxPartitionBytes", "8k")
    try:
        found = source.read_large(spark, f"file://{big}").collect()
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
    assert sorted((r["line_number"], r["content"]) for r in found) == [(i, f"line {i}") for i in range(1, 5001)]
    assert source.detect_delimiter(["a;b;c", "1;2;3", "x,y;z;w"]) == ";"


def equal_their_sql(spark, folder, rows, names):
    """Queries over these documents, which lie in nine files, against SQL; the count of rows of the last."""
    import duckdb

    from logloom import queries

    spark.createDataFrame(rows, "doc_id long, text string").repartition(9).write.parquet(f"file://{folder}/documents.parquet")
    db = duckdb.connect()
    db.execute(f"CREATE VIEW documents AS SELECT * FROM '{folder}/documents.parquet/*.parquet'")
    for name in names:
        got = {r["bucket"]: tuple(r) for r in queries.queries()[name](spark, f"file://{folder}").collect()}
        assert got == {r[0]: r for r in db.execute(queries.oracle_sql()[name]).fetchall()}, name
    return len(got)


@pytest.mark.parametrize("name", ["file_lines", "large_file_lines"])
def test_lines_of_files_are_in_order_of_ids(spark, tmp_path, name):
    """The large files are cut into several splits each."""
    ids = random.Random(4).sample(range(600), 600)
    spark.conf.set("spark.sql.files.maxPartitionBytes", "512")
    try:
        assert equal_their_sql(spark, tmp_path, [(i, f"a{i}\n" + "x" * (i % 37) + "\r\n\n" * (i % 3)) for i in ids], [name]) == 16
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")


def test_large_files_are_cut_once(spark, tmp_path):
    """While a job reads, the settings that cut files change: no line is lost, and numbers stay right."""
    for k in range(12):
        (tmp_path / f"{k}.log").write_text("".join(f"{k} {i}\n" for i in range(1, 20_001 + k)))
    stop = threading.Event()

    def change():
        for size in itertools.cycle((40_000, 70_000, 110_000)):
            if stop.wait(0.01):
                return
            spark.conf.set("spark.sql.files.maxPartitionBytes", str(size))

    changing = threading.Thread(target=change)
    changing.start()
    try:
        found = source.read_large(spark, f"file://{tmp_path}")
        right = F.concat_ws(" ", F.regexp_extract("source_file", r"(\d+)\.log", 1), "line_number") == F.col("content")
        counts = [tuple(found.select(F.count(F.lit(1)), F.count_if(right)).first()) for _ in range(3)]
    finally:
        stop.set()
        changing.join()
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
    assert counts == [(12 * 20_000 + 66, 12 * 20_000 + 66)] * 3


def test_files_of_ids_below_zero_and_of_none(spark, tmp_path):
    rows = [*((i, f"{i}\n\nx") for i in range(-40, 40)), (None, "no id"), (1 << 40, None)]
    assert equal_their_sql(spark, tmp_path, rows, ["file_lines", "large_file_lines", "file_list"]) == 32


def test_csv_header_names(spark, tmp_path):
    (tmp_path / "x.csv").write_text('Event ID;Source--IP\n1;"a;b"\n')
    df = source.read_csv(spark, f"file://{tmp_path}/x.csv")
    assert df.columns == ["event_id", "source_ip"] and [tuple(r) for r in df.collect()] == [("1", "a;b")]


def test_analysis_and_sinks(spark, tmp_path):
    (tmp_path / "in.log").write_text('{"user_id": "7", "m": "x"}\n\nmail a@b.co now\nmail c@d.co now\n')
    for kind in ("anonymize", "logppt", "json_report"):
        analysis.run_analysis(spark, f"file://{tmp_path}/in.log", kind, f"file://{tmp_path}/{kind}")
    text = [r[0] for r in spark.read.text(f"file://{tmp_path}/anonymize").collect()]
    assert sorted(text) == ["mail <EMAIL_ADDRESS> now", "mail <EMAIL_ADDRESS> now", '{"user_id": "7", "m": "x"}']
    both = {}
    for name in ("original", "anonymized"):
        csv = spark.read.csv(f"file://{tmp_path}/logppt/{name}", header=True)
        assert csv.columns == ["LineId", "m", "raw_content", "user_id", "Content", "EventId", "EventTemplate"]
        both[name] = csv.orderBy("LineId").collect()
        assert [r["LineId"] for r in both[name]] == ["1", "2", "3"]
    assert both["original"][2]["EventTemplate"] == "mail <*> now" and both["anonymized"][2]["EventTemplate"] == "mail <EMAIL_ADDRESS> now"
    assert [r["user_id"] for r in both["original"]] == ["7", None, None] and len(both["anonymized"][0]["user_id"]) == 16
    assert not any("@" in str(value) for r in both["anonymized"] for value in r)
    with pytest.raises(ValueError):
        reports.write_mined(csv, "x", "xml")
    assert spark.read.json(f"file://{tmp_path}/json_report").count() == 3
    with pytest.raises(ValueError):
        analysis.run_analysis(spark, "x", "other", "y")
    assert reports.output_name("f", "logppt", "1") == "f_logppt_1.csv"


def test_preview(spark):
    assert analysis.preview(spark, "") == ""
    assert analysis.preview(spark, "x", {"presidio": {"enabled": False}}) == "[PREVIEW] Presidio is disabled."
    assert analysis.preview(spark, "x", {"presidio": {"analyzer": {"entities": {"URL": False}}}}) == "[PREVIEW] No entities enabled."
    assert analysis.preview(spark, "see a@b.co") == "see <EMAIL_ADDRESS>"


def test_config(tmp_path):
    assert analysis.load_config(str(tmp_path / "none")) == {}
    (tmp_path / "bad").write_text("a: [")
    assert analysis.load_config(str(tmp_path / "bad")) == {}
    assert analysis.get_value({"a": {"b": 1}}, "a.b") == 1 and analysis.get_value({}, "a.b", 2) == 2


def test_stream(spark, tmp_path):
    from logloom.streaming.miner import mine_stream

    spark.createDataFrame([(i, f"user u{i} in") for i in range(6)], "seq long, message string").write.parquet(f"{tmp_path}/in")
    rows = spark.readStream.schema("seq long, message string").parquet(f"{tmp_path}/in")
    query = mine_stream(rows).writeStream.format("memory").queryName("mined").option("checkpointLocation", f"{tmp_path}/c").start()
    try:
        query.processAllAvailable()
        found = spark.sql("select * from mined order by seq").collect()
    finally:
        query.stop()
    assert [r["cluster"] for r in found] == [1] * 6 and found[-1]["template"] == "user <*> in"


def test_missing_files(spark, tmp_path):
    for read in (source.read_lines, source.read_large, source.list_files):
        with pytest.raises(Exception, match="PATH_NOT_FOUND"):
            read(spark, f"file://{tmp_path}/none").collect()


def test_settings(tmp_path):
    (tmp_path / "broken").write_text("{")
    assert analysis.load_settings(str(tmp_path / "broken")) == {}
    assert analysis.save_config(str(tmp_path / "c.yaml"), {"z": 1, "a": {"é": [1]}}) and (tmp_path / "c.yaml").read_text().startswith("z: 1")
    assert analysis.load_config(str(tmp_path / "c.yaml")) == {"z": 1, "a": {"é": [1]}}
    assert not analysis.save_settings(str(tmp_path / "no" / "x"), {}) and [p.name for p in tmp_path.iterdir() if p.name.endswith("tmp")] == []


def test_queries_and_sql_have_the_same_names():
    from logloom import queries

    assert set(queries.oracle_sql()) <= set(queries.queries())


def test_queries_equal_their_sql(spark):
    """Every query with SQL, by another engine, on the smallest tables: names, rows and values."""
    import math

    import duckdb

    from logloom import queries

    sf, db = "/root/testdata/sf0.001", duckdb.connect()
    for name in ("documents", "events", "pages", "customer", "conversations"):
        db.execute(f"CREATE VIEW {name} AS SELECT * FROM '{sf}/{name}.parquet'")
    plain = lambda v: round(v, 6) if isinstance(v, float) and not math.isnan(v) else v
    wrong = []
    for name, sql in queries.oracle_sql().items():
        df = queries.queries()[name](spark, sf)
        at = sorted(range(len(df.columns)), key=df.columns.__getitem__)
        got = sorted((repr(tuple(plain(r[k]) for k in at)) for r in df.collect()))
        own = db.execute(sql)
        names = [d[0] for d in own.description]
        order = sorted(range(len(names)), key=names.__getitem__)
        want = sorted(repr(tuple(plain(r[k]) for k in order)) for r in own.fetchall())
        if sorted(names) != sorted(df.columns) or got != want:
            wrong.append((name, names, df.columns, len(got), len(want), [(g, w) for g, w in zip(got, want, strict=False) if g != w][:2]))
    assert not wrong, wrong
