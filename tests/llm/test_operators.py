"""Each operator against brute force on small fixtures: nulls, empty and long texts, ties, repeated rows, empty
tables and extra columns with clashing names."""

import hashlib
import random
import zlib
from collections import defaultdict

import numpy as np
import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from logloom.llm import bpe, common, components, idstore, induction, langid, mixing, nearjoin, quality, rollup, spotsigs, suffixdedup, warc

BYTE, WORD = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("word_bpe_49k.json")
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def texts(n=60, seed=3):
    rng = random.Random(seed)
    words = "the of and to in is that house river stone cloud walks blue seven often machine é ß".split()
    base = [" ".join(rng.choice(words) + rng.choice(["", "", ".", ",", "\n"]) for _ in range(rng.randrange(1, 120))) for _ in range(n // 2)]
    near = [b.replace("house", "home", 1) + " end" for b in base[: n // 4]]
    return [None, "", " \n\t", "!!! ###", base[0], base[0], "x " * 20_000, *base, *near, base[1][:200] + base[2][:300] + base[1][:200]]


@pytest.fixture(scope="session")
def docs(spark):
    rows = [(i, t, ("en", "de", None)[i % 3], ("a", "b", None)[min(i % 4, 2)], None if t is None else len(t)) for i, t in enumerate(texts())]
    path = common.scratch(spark, "test-docs")
    return common.stored(spark.createDataFrame(rows, SCHEMA).repartition(5), path)


@pytest.fixture
def nothing(spark):
    return spark.createDataFrame([], SCHEMA)


def values(docs):
    return sorted((r["doc_id"], r["text"]) for r in docs.select("doc_id", "text").collect())


def words_of(t):
    return [w for w in __import__("re").split(r"[\x20\x09-\x0D]+", t or "") if w]


def test_quality(docs, nothing):
    clash = docs.withColumn("n_words", F.lit("own")).withColumn("KEPT", F.lit(1)).withColumn("words", F.lit(2)).withColumn("a.b`c", F.lit(3))
    found = quality.judge(clash.union(clash.where("doc_id = 4")))
    assert found.columns == ["doc_id", "text", "lang", "source", "n_chars", "words", "a.b`c", *quality.MEASURES, "base_failed", "kept"]
    assert found.where("doc_id = 4").distinct().count() == 1 and found.where("words <> 2 or `a.b``c` <> 3").isEmpty()
    got = {r["doc_id"]: r for r in found.collect()}
    for i, t in values(docs):
        w = words_of(t)
        grams = defaultdict(list)
        for k in range(len(w) - 2):
            grams[tuple(w[k : k + 3])].append(k)
        covered = {k + j for at in grams.values() if len(at) > 1 for k in at for j in range(3)}
        lines = [x for x in (t or "").split("\n") if words_of(x)]
        r = got[i]
        assert (r["n_words"], r["word_chars"], r["n_repeat_words"], r["n_dup_lines"]) == (len(w), sum(map(len, w)), len(covered), len(lines) - len(set(lines))), i
        assert r["n_symbols"] == sum(c in "#*$%&|<>" for c in t or "")
        assert r["base_failed"] == (len(w) < 50 or 100 * len(covered) > 50 * len(w)) and not (r["kept"] and r["base_failed"])
    assert quality.judge(nothing).count() == 0


def test_mixing(spark, docs, nothing, monkeypatch):
    rows = spark.range(20_000).select(F.col("id").alias("doc_id"), F.when(F.col("id") % 3 == 0, None).when(F.col("id") % 10 == 1, "rare").otherwise("hot").alias("source"), F.lit("t").alias("copy"), F.lit("x").alias("m_key"), F.lit(None).cast("string").alias("text"))
    got = mixing.mix(rows, weights={"hot": 0.2, "rare": 0.8}, total=20_000)
    assert got.columns == ["doc_id", "source", "m_key", "text", "copy", "rate"] and dict(got.dtypes)["copy"] == "int" and got.where("m_key <> 'x'").isEmpty()
    n = {r["source"]: r["n"] for r in got.groupBy("source").agg(F.count("*").alias("n")).collect()}
    assert abs(n["hot"] - 4_000) < 250 and abs(n["rare"] - 16_000) < 500 and None not in n
    same = lambda df: sorted(map(str, df.collect()))
    want = same(got)
    assert same(mixing.mix(rows.repartition(3), weights={"hot": 0.2, "rare": 0.8}, total=20_000)) == want
    monkeypatch.setattr(mixing, "BROADCAST_STEPS", 0)  # the join by key gives the same rows
    assert same(mixing.mix(rows, weights={"hot": 0.2, "rare": 0.8}, total=20_000)) == want
    twice = spark.createDataFrame([(1, "s"), (1, "s"), (None, "s"), (2, None)], "doc_id long, source string")
    counts = {tuple(r[:2]): r["n"] for r in mixing.mix(twice, total=400).groupBy("doc_id", "source").agg(F.count("*").alias("n")).collect()}
    assert counts[1, "s"] % 2 == 0 and set(counts) == {(1, "s"), (None, "s"), (2, None)}
    assert mixing.mix(nothing).count() == 0
    assert mixing.mix(docs).count() > 0
    big = spark.range(50).select(F.col("id").alias("doc_id"), F.lit("s").alias("source"))
    assert abs(mixing.mix(big, total=100_000).count() - 100_000) < 1_500  # a rate of 2,000


def test_mixing_hashes_once_a_row_and_makes_no_more_files_than_asked_for(spark, tmp_path):
    rows = spark.range(3_000).select(F.col("id").alias("doc_id"), F.when(F.col("id") % 10 == 1, "rare").otherwise("hot").alias("source"))
    got = mixing.mix(rows)
    plan = got._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("md5(") == 2  # the first piece's and the further pieces', neither again for the steps or a filter
    got.write.parquet(str(tmp_path / "mixed"))
    assert 0 < len(list((tmp_path / "mixed").glob("*.parquet"))) <= int(spark.conf.get("spark.sql.shuffle.partitions"))


def removed(rows, length=100):
    seen, out = set(), {}
    for i, t in rows:
        b = (t or "").encode()
        gone = bytearray(len(b))
        for s in range(len(b) - length + 1):
            w = b[s : s + length]
            if w in seen:
                gone[s : s + length] = b"\1" * length
            seen.add(w)
        out[i] = (len(b), sum(gone), sum(gone[k] and (not k or not gone[k - 1]) for k in range(len(b))), bytes(x for x, g in zip(b, gone, strict=True) if not g))
    return out


def test_suffix_dedup(docs, nothing, monkeypatch):
    want = removed(values(docs))
    for hot in (suffixdedup.HOT, 1):  # 1: every anchor with two contexts is dealt by window
        monkeypatch.setattr(suffixdedup, "HOT", hot)
        got = {r["doc_id"]: (r["n_bytes"], r["n_removed"], r["n_spans"], bytes(r["kept"])) for r in suffixdedup.remove(docs.withColumn("anchor", F.lit(1)).withColumn("kept", F.lit("x"))).collect()}
        assert got == want
    assert suffixdedup.remove(nothing).count() == 0
    odd = docs.withColumn("n_bytes", F.lit("own")).withColumn("row", F.lit(1)).withColumn("a.b`c", F.lit(2))
    cleaned = suffixdedup.clean(odd)
    assert cleaned.columns == odd.columns and cleaned.where("n_bytes <> 'own' or `row` <> 1 or `a.b``c` <> 2").isEmpty()
    assert {i: t for i, t in values(cleaned)} == {i: w[3].decode("utf-8", "ignore") for i, w in want.items()}
    assert suffixdedup.clean(nothing).count() == 0


def test_suffix_dedup_of_repeated_and_null_ids(spark, monkeypatch):
    rng = random.Random(5)
    a, b, c, d = ("".join(rng.choice("abcdefgh ") for _ in range(300)) for _ in range(4))
    rows = [(7, a), (7, a), (7, b + a), (8, a + c), (8, a + c), (9, c), (None, b), (None, d), (None, d), (None, d[:150] + c[:40]), (3, "x" + d), (4, None), (4, None)]
    order = lambda r: (-(1 << 63) if r[0] is None else r[0], int(hashlib.sha256((r[1] or "").encode()).hexdigest()[:15], 16))
    want = removed([(r, r[1]) for r in sorted(set(rows), key=order)])
    for hot in (suffixdedup.HOT, 1):
        monkeypatch.setattr(suffixdedup, "HOT", hot)
        for parts in (1, 6):
            df = spark.createDataFrame([(*r, n) for n, r in enumerate(rows)], "doc_id long, text string, n int").repartition(parts)
            got = {r["n"]: (r["doc_id"], (r["n_bytes"], r["n_removed"], r["n_spans"], bytes(r["kept"]))) for r in suffixdedup.remove(df).collect()}
            assert got == {n: (r[0], want[r]) for n, r in enumerate(rows)}


def test_language_stage_rejects_what_the_model_cannot_identify(spark):
    import corpus_pipeline

    clean = [(i, f"the house stands by the river and the stone {i}", "en", "a", 1) if i % 2 else (i, f"das haus steht an dem fluss und der stein {i}", "de", "a", 1) for i in range(40)]
    held_out = [i for i in range(200, 300) if zlib.crc32(str(i).encode()) % 4 == 2]  # the model learns from none of these
    kept = [*clean, (100, "the river", None, "a", 1), (held_out[0], "жжж", "ru", "a", 1)]
    gone = [(400, "жжж", None, "a", 1), (401, "zqxj kvwz", None, "a", 1), (held_out[1], "жжж", "en", "a", 1), (403, "12 !?", "en", "a", 1), (404, None, "de", "a", 0)]
    got = corpus_pipeline.language_id(spark, spark.createDataFrame(kept + gone, SCHEMA), "").collect()
    assert {r["doc_id"]: r["lang"] for r in got} == {r[0]: r[2] or "en" for r in kept}


def test_token_stage_decodes_its_ids(spark, docs):
    import corpus_pipeline

    t, text = Tokenizer.from_file(BYTE), dict(values(docs))
    found = corpus_pipeline.token_ids(spark, docs, "").collect()
    assert len(found) == len(text)
    for r in found:
        ids = np.frombuffer(bytes(r["ids"]), "<u4").tolist()
        assert r["decoded_sha256"] == hashlib.sha256(t.decode(ids, skip_special_tokens=False).encode()).hexdigest() == hashlib.sha256((text[r["doc_id"]] or "").encode()).hexdigest()


def test_repeated_rows_keep_a_text_in_the_pipeline(spark):
    import corpus_pipeline

    text = " ".join(f"word{k} stands" for k in range(60))
    rows = spark.createDataFrame([(1, text, "en", "a", len(text))] * 2, SCHEMA)
    near = common.stored(corpus_pipeline.near_duplicates(spark, rows, ""), common.scratch(spark, "test-repeated"))
    assert values(corpus_pipeline.repeated_passages(spark, near, "")) == [(1, text)] * 2


def sorted_suffixes(parts, depth, held):
    text = induction.Text(parts, depth, held)
    found = list(induction.suffixes(text))
    at = [int(x) for a, _ in found for x in a]
    shared = [int(x) for _, c in found for x in c]
    return text, at, shared, {int(a[0]) for a, _ in found}


@settings(max_examples=80, deadline=None)
@given(st.lists(st.binary(max_size=30).map(lambda b: bytes(97 + x % 3 for x in b)), min_size=1, max_size=6), st.sampled_from([4, 7, 100]), st.sampled_from([0, 1 << 20]))
def test_induced_sorting(parts, depth, held):
    _, at, shared, firsts = sorted_suffixes(parts, depth, held)
    t = [c for p in parts for c in [*(b + 2 for b in p), 1]] + [0]
    keys = [t[i : i + depth] for i in at]
    assert sorted([*at, *({len(t) - 1} - set(at))]) == list(range(len(t)))
    assert keys == sorted(keys)
    for i, a, b, n in zip(at[1:], keys, keys[1:], shared[1:], strict=False):
        assert i in firsts and a[:1] != b[:1] or a[:n] == b[:n] and (n == depth or a[n : n + 1] != b[n : n + 1])


def test_a_shard_larger_than_what_is_held(monkeypatch):
    """Queues are written to disk and arrays are mapped; results are those of brute force over windows."""
    rng = random.Random(8)
    monkeypatch.setattr(induction, "ROOM", 1 << 12)
    monkeypatch.setattr(induction, "HELD", 1 << 14)
    written = []
    push = induction.Queues.push
    monkeypatch.setattr(induction.Queues, "push", lambda self, *a: (push(self, *a), written.append(self.written))[0])
    base = bytes(rng.choice(b"abcd ") for _ in range(40_000))
    parts = [base, b"x" + base[5_000:9_000] + b"y", b"ab" * 3_000, base[:150] * 3, b"", base[20_000:20_099]]
    docs, starts = [5, 2, 9, 1, 3, 4], [0, 0, 7, 0, 0, 0]
    seen, want = set(), set()
    for doc, start, p in sorted(zip(docs, starts, parts, strict=True)):
        for k in range(len(p) - 99):
            if (w := p[k : k + 100]) in seen:
                want.add((doc, start + k))
            seen.add(w)
    doc, _, start, count = suffixdedup.repeated(docs, [0] * 6, starts, parts)
    assert {(d, s + k) for d, s, n in zip(doc.tolist(), start.tolist(), count.tolist(), strict=True) for k in range(n)} == want
    assert max(written) > 10 * induction.HELD


def test_suffix_dedup_of_long_texts_and_hot_anchors(spark, monkeypatch):
    """A text of several pieces, one letter in a row, a passage in many documents with other words around it."""
    rng = random.Random(6)
    monkeypatch.setattr(suffixdedup, "BLOCK", 5_000)
    monkeypatch.setattr(suffixdedup, "ROWS", 64)
    monkeypatch.setattr(suffixdedup, "WINDOWS", 200)
    word = lambda n: "".join(rng.choice("abcdefghij ") for _ in range(n))
    passage, long = word(130), word(30_000)
    rows = [(k, word(90) + passage + word(rng.randrange(90))) for k in range(60)] + [(100, long), (101, "z" + long[4_000:21_000]), (102, "q" * 12_000), (103, "q" * 300 + "\n" * 9_000), (104, "ab c" * 2_000)]
    want = removed(rows)
    df = spark.createDataFrame(rows, "doc_id long, text string")
    for hot in (3, 5_000):
        monkeypatch.setattr(suffixdedup, "HOT", hot)
        for parts in (1, 5):
            got = {r["doc_id"]: (r["n_bytes"], r["n_removed"], r["n_spans"], bytes(r["kept"])) for r in suffixdedup.remove(df.repartition(parts)).collect()}
            assert got == want


def test_classes_of_runs_in_small_pieces(monkeypatch):
    """Streaming over sorted runs gives what looking at all of them at once gives, for any cut and any bound."""
    rng = random.Random(2)
    rows = sorted((rng.randrange(6), rng.randrange(5), doc, 0, rng.randrange(9) << 8 | (rng.randrange(2) << 7), 1) for doc in range(150))
    marks = [(rng.randrange(6), 1, 1000 + k, 0, 0, 0) for k in range(20)]
    for hot in (2, 4, 100):
        want = set(marks)
        for anchor in {r[0] for r in rows}:
            own = [r for r in rows if r[0] == anchor]
            n = len({r[1] for r in own})
            for context in {r[1] for r in own}:
                first, *later = [r for r in own if r[1] == context]
                want |= {(*r[:5], 0) for r in later}
                if n > 1 or first[4] >> 7 & 1:
                    want.add((*first[:5], 2 if n > hot else 1))
        monkeypatch.setattr(suffixdedup, "HOT", hot)
        for size in (1, 3, 7, 500):
            monkeypatch.setattr(suffixdedup, "ROWS", size)
            given = sorted([*rows, *marks])
            got = [r for b in suffixdedup._classify(iter([common.batch_of(given[k : k + size], suffixdedup._RUNS) for k in range(0, len(given), size)])) for r in common.rows_of([b])]
            assert len(got) == len(set(got)) and set(got) == want, (hot, size)


def test_warc(spark):
    pages = [(i, f"http://x/{i}", h) for i, h in enumerate([None, "", "é" * 60, "short", "short", "y" * 200, "y" * 200, "é" * 60])] + [(100 + i, None, "z" * 100) for i in range(30)]
    df = spark.createDataFrame([*pages, (None, "u", "z" * 100)], "page_id long, url string, html string").withColumn("shard", F.lit(1))
    folder = common.scratch(spark, "test-warc")
    manifest = warc.write(df.repartition(3), folder, roll_bytes=400)
    assert len(manifest) > 5 and all(hashlib.sha256(common.Store(folder).get(f["file"])).hexdigest() == f["sha256"] for f in manifest)
    got = {r["page_id"]: (r["payload_bytes"], r["payload_digest"], r["record_type"], r["refers_to"]) for r in warc.read(spark, folder).collect()}
    first = {}
    for i, _, h in pages:
        b = (h or "").encode()
        of = first.setdefault(b, i) if len(b) >= 100 else i
        assert got[i] == (len(b), hashlib.sha256(b).hexdigest(), "response" if of == i else "revisit", None if of == i else of)
    assert got[None][2:] == ("revisit", 100)
    again = common.scratch(spark, "test-warc")
    strip = lambda m: [(f["file"], f["sha256"]) for f in m]
    assert strip(warc.write(df.repartition(7), again, roll_bytes=400)) == strip(manifest)
    empty = common.scratch(spark, "test-warc")
    assert warc.write(df.limit(0), empty) == [] and warc.read(spark, empty).count() == 0


def signatures_of(text):
    """Signatures by their definition: a common word and the next content words; texts without any: at each word."""
    import re

    words = re.findall(r"[a-z0-9\x80-\U0010ffff]+", (text or "").lower())
    stop, out = set(quality.STOP_WORDS), set()
    for k, w in enumerate(words):
        if w in stop:
            content = [x for x in words[k + 1 :] if x not in stop][: spotsigs.CHAIN]
            if content:
                out.add((w, *content))
    return out or {("", *words[k : k + spotsigs.CHAIN]) for k in range(len(words))}


def test_signatures_by_their_definition():
    rows = [t for t in texts(40, 5) if t is None or len(t) < 10_000] + ["The House, the house of stone!", "no anchors here 12", "the", "the of and", "É the é"]
    found = spotsigs.signatures([t or "" for t in rows])
    sets = [frozenset(found[found >> np.uint64(32) == k].tolist()) for k in range(len(rows))]
    names = {}
    for t, s in zip(rows, sets, strict=True):
        want = signatures_of(t)
        assert len(want) == len(s), t
        low = {x & 0xFFFFFFFF for x in s}
        names.setdefault(frozenset(want), low)
        assert names[frozenset(want)] == low
    for a in names:
        for b in names:
            assert len(a & b) == len(names[a] & names[b])


def test_spotsigs(spark, docs, nothing):
    rows = values(docs)
    got = {r["doc_id"]: r for r in spotsigs.compare_next(docs.withColumn("shard", F.lit(0))).collect()}
    order = [i for i, _ in reversed(rows)]
    of = {i: t or "" for i, t in rows}
    for k, i in enumerate(order):
        t, u = of[i], of[order[(k + 1) % len(order)]]
        edited = t[: len(t) - len(t) // 3] + u[: len(t) // 3]
        assert got[i]["n_chars"] == len(t) and got[i]["edited_sha256"] == hashlib.sha256(edited.encode()).hexdigest()
        sets = [set(spotsigs.signatures([x]).tolist()) for x in (t, edited, u)]
        like = lambda a, b: len(a & b) / len(a | b) if a | b else 1.0
        assert got[i]["near_edited"] == pytest.approx(like(sets[0], sets[1])) and got[i]["near_next"] == pytest.approx(like(sets[0], sets[2]))
    assert len({(of[i], got[i]["fingerprint"]) for i in of}) == len(set(of.values()))
    assert spotsigs.compare_next(nothing).count() == 0
    one = spark.createDataFrame([(None, "the house stands"), (None, "")], "doc_id long, text string")
    assert spotsigs.compare_next(one).count() == 2


@pytest.mark.parametrize("block", [1024, 3])
def test_spotsigs_join(spark, docs, nothing, monkeypatch, block):
    monkeypatch.setattr(spotsigs, "BLOCK_SETS", block)
    rng = random.Random(5)
    base = " ".join(f"{rng.choice(['the', 'of', 'and', 'is'])} w{k} v{k}" for k in range(90)).split()
    near = [(1000 + k, " ".join([*base[: 3 * k], "new", *base[3 * k + 5 :]])) for k in range(25)]
    cut = [(2000 + k, " ".join(base[: len(base) - 9 * k])) for k in range(1, 12)]
    more = docs.select("doc_id", "text").union(spark.createDataFrame([*near, *cut, near[0]], "doc_id long, text string")).withColumn("sig", F.lit(1))
    rows = sorted({*values(docs), *near, *cut}, key=lambda r: r[0])
    prints = {i: frozenset(spotsigs.signatures([t or ""]).tolist()) for i, t in rows}
    classes = {}
    for i, _ in rows:
        classes.setdefault(prints[i], i)
    sets = {i: s for s, i in classes.items()}
    links = {i: {j for j in sets if j != i and sets[i] | sets[j] and 10 * len(sets[i] & sets[j]) >= 8 * len(sets[i] | sets[j])} for i in sets}
    group = {i: i for i in sets}
    for _ in sets:
        group = {i: min([group[i], *(group[j] for j in links[i])]) for i in sets}
    want = {i: (classes[prints[i]], len(links[classes[prints[i]]]), group[classes[prints[i]]]) for i, _ in rows}
    assert sum(map(len, links.values())) > 300
    got = {r["doc_id"]: (r["class_id"], r["n_links"], r["group_id"]) for r in spotsigs.join(more).collect()}
    assert got == want
    assert spotsigs.join(nothing).count() == 0
    assert tuple(spotsigs.join(spark.createDataFrame([(None, "the a b c d e f")], "doc_id long, text string")).first()) == (None, None, 0, None)


def test_partitions_of_lengths():
    for similarity in (0.5, 0.8, 0.95):
        starts = spotsigs.edges(similarity)
        part = lambda n: int(np.searchsorted(starts, n, "right")) - 1  # noqa: E731, B023
        for n in [*range(1, 300), 5_000, 10**6]:
            longest = n * 1000 // round(similarity * 1000)
            assert part(longest) - part(n) <= 1


def test_rollup(spark):
    schema = "source string, lang string, tokenizer string, n_tokens long"
    counts = spark.createDataFrame([("a", "en", "v1", 3), ("a", "en", "v1", 4), (None, "de", "v1", None)], schema)
    store = rollup.Rollup(spark, common.scratch(spark, "test-rollup"))
    assert store.totals().count() == 0
    assert store.commit("1", rollup.inserts(counts)) and not store.commit("1", rollup.inserts(counts))
    store.commit("2", rollup.revisions(counts.limit(1).withColumn("new_tokens", F.lit(10))))
    store.commit("3", rollup.deletes(counts.where("n_tokens = 4")))
    want = sorted([("a", "en", "v1", 1, 10), (None, "de", "v1", 1, 0)], key=str)
    assert sorted(map(tuple, store.totals().collect()), key=str) == want
    for k in range(4, 8):  # an empty batch, then more than the versions that are kept
        assert store.commit(str(k), rollup.inserts(counts.limit(0)))
    assert sorted(map(tuple, store.totals().collect()), key=str) == want and not store.commit("2", rollup.inserts(counts))
    assert sorted(r[0] for r in store.batches().collect()) == list("1234567")
    import os

    left = [n for n in os.listdir(common.Store(store.folder).root) if n.startswith("data-")]
    assert len(left) == rollup.KEPT
    store.commit("8", rollup.deletes(counts.where("lang = 'de'")))
    assert [r["lang"] for r in store.totals().collect()] == ["en"]  # keys of which nothing is left go


def test_rollup_commits_at_once(spark):
    from concurrent.futures import ThreadPoolExecutor

    folder = common.scratch(spark, "test-rollup")
    rows = spark.createDataFrame([("a", "en", "v1", 1)], "source string, lang string, tokenizer string, n_tokens long")
    with ThreadPoolExecutor(6) as pool:
        done = list(pool.map(lambda name: rollup.Rollup(spark, folder).commit(name, rollup.inserts(rows)), ["x", "x", "y", "z", "y", "x"]))
    assert sum(done) == 3 and [tuple(r) for r in rollup.Rollup(spark, folder).totals().collect()] == [("a", "en", "v1", 3, 3)]


def test_token_counts_equal_the_library():
    c = rollup.Counting(public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)
    rng = random.Random(1)
    for _ in range(60):
        t = "".join(rng.choice(rng.choice(["ab", "the quick", "éß中 a", " \n\t a", "1234,.!'s "])) for _ in range(rng.randrange(1, 1500)))
        assert c.count(t) == len(c.own.encode_ordinary(t)) == sum(rollup.merged(m[0].encode(), c.ranks, c.longest) for m in c.pattern.finditer(t))
    parts = ["x" * 600, " " * 5_000, "\n" * 700 + "the end", "!\x1c" * 900]
    assert c.count("".join(parts)) == len(c.own.encode_ordinary("".join(parts)))
    with pytest.raises(ValueError):
        rollup.Counting(public_tokenizers.path("byte_bpe_50k.tiktoken"), "other")


def test_long_runs_are_told():
    rng = random.Random(14)
    seen = set()
    for _ in range(3_000):
        t = "".join(rng.choice(["a", "é ", " ", "\n", "\x1c", "\u2003", "b\x1f", "."]) * rng.choice([1, 1, 1, 3, 200, 510, 512, 700]) for _ in range(rng.randrange(0, 7)))
        assert rollup.has_long_run(t) == (rollup._LONG_RUN.search(t) is not None)
        seen.add(rollup.has_long_run(t))
    assert seen == {True, False} and rollup.has_long_run(" " * rollup.LONG) and not rollup.has_long_run(" " * (rollup.LONG - 1))


def test_token_counts_of_very_long_runs(spark):
    """Two megabytes of blanks, of letters and of one word's lines; each result is that of its own text."""
    paths = {"v1": public_tokenizers.path("byte_bpe_50k.tiktoken")}
    texts = [" " * 2_000_000 + "x", "ab" * 100_000, "line\n" * 100_000, None, "", "a b"]
    rows = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r["doc_id"]: (r["v1"], r["revised"]) for r in rows.select("doc_id", rollup.token_counts(paths, public_tokenizers.PATTERN, "v1")("text").alias("n")).select("doc_id", "n.*").collect()}
    c = rollup.Counting(paths["v1"], public_tokenizers.PATTERN)
    assert got[0][0] == 1_999_999 + c.count(" x") and got[2] == (200_000, c.count("line\n")) and got[3] == got[4] == (0, 0) and got[5] == (2, 2)
    assert got[1][0] == len(Tokenizer.from_file(BYTE).encode(texts[1], add_special_tokens=False).ids)


def test_copies(spark):
    rows = spark.createDataFrame([(3, "x", "r"), (1, "x", "r"), (1, "x", "r"), (None, "x", "r"), (4, None, "r"), (5, None, "r"), (None, "y", "r"), (None, "y", "r"), (6, "z", "r")], "doc_id long, digest string, first string")
    got = rollup.copies(rows, common.scratch(spark, "test-copies"))
    assert got.columns == rows.columns and sorted(map(str, got.collect())) == sorted(map(str, rows.where("digest = 'x' and not doc_id <=> 1").collect()))
    assert rollup.copies(rows.limit(0), common.scratch(spark, "test-copies")).count() == 0


def test_token_counts_query(spark, tmp_path):
    """The query against counts by the library, in Python: inserts, later copies taken away, revised counts."""
    from logloom.llm.queries import op6_token_counts

    import tiktoken

    rows = [(i, t, ("en", None)[i % 2], ("a", "b", None)[i % 3]) for i, t in enumerate([*texts(), "same\nsame\nother", "same\nsame\nother"])]
    rows.append(rows[10])
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string").write.parquet(f"file://{tmp_path}/documents.parquet")
    want = defaultdict(lambda: [0, 0])
    for version, name in (("v1", "byte_bpe_50k.tiktoken"), ("v2", "byte_bpe_multi_50k.tiktoken")):
        ranks = {__import__("base64").b64decode(a): int(b) for a, b in map(bytes.split, open(public_tokenizers.path(name), "rb"))}
        e = tiktoken.Encoding(name, pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
        for i, t, lang, source in rows:
            if t is not None and min(j for j, u, *_ in rows if u == t) < i:
                continue
            shown = "\n".join(dict.fromkeys((t or "").split("\n"))) if version == "v1" else t or ""
            total = want[source, lang, version]
            total[0] += 1
            total[1] += len(e.encode_ordinary(shown))
    got = {tuple(r[:3]): list(r[3:]) for r in op6_token_counts(spark, f"file://{tmp_path}").select("source", "lang", "tokenizer", "n_docs", "n_tokens").collect()}
    assert got == dict(want)


def test_language(spark, docs, nothing):
    english = ["the quick brown fox jumps over the lazy dog and runs through the forest " * 3] * 10
    german = ["der schnelle braune fuchs springt über den faulen hund und läuft durch den wald " * 3] * 10
    rows = spark.createDataFrame([(i, t, "en" if i < 10 else "de") for i, t in enumerate(english + german)], "doc_id long, text string, lang string")
    model = langid.fit(rows)
    ask = spark.createDataFrame([("the dog runs over the forest",), ("der hund läuft durch den wald",), (None,), ("",), ("12 !?",), ("жжж",), ("the dog " * 300_000,)], "text string").withColumn("score", F.lit("own")).withColumn("found", F.lit(1))
    out = langid.predict(ask.union(ask), model)
    assert out.columns == ["text", "found", "lang_pred", "score"] and dict(out.dtypes)["score"] == "double"
    got = [(r["lang_pred"], r["score"]) for r in out.collect()]
    assert got[:7] == got[7:]
    assert [g[0] for g in got[:5]] == ["en", "de", "und", "und", "und"] and got[5][0] in ("de", "en") and got[6][0] == "en" and all(0 <= g[1] <= 1 for g in got)
    none = langid.fit(nothing)
    assert [r["lang_pred"] for r in langid.predict(docs.select("text"), none).collect()] == ["und"] * docs.count()
    assert langid.predict(nothing, model).count() == 0
    again = langid.fit(rows.union(rows).repartition(7))  # repeated rows and other partitions make no other model
    assert (again.words == model.words).all() and again.languages == model.languages


def grams_of(text):
    import re

    data = re.sub(rb"[^a-z\x80-\xff]+", b" ", b" " + (text or "").encode().lower() + b" ") if (text or "").isascii() else None
    if data is None:
        data = re.sub(rb"[^a-z\x80-\xff]+", b" ", b" " + bytes(c + 32 if 65 <= c <= 90 else c for c in text.encode()) + b" ")
    return [data[i : i + langid.N] for i in range(len(data) - langid.N + 1)]


def test_filters_hold_all_languages_of_an_n_gram_and_popcounts_decide(spark):
    sf = "/root/testdata/sf0.001"
    table = spark.read.parquet(f"{sf}/documents.parquet").where("text is not null and lang is not null")
    model = langid.fit(table)
    rows = [(r["text"], r["lang"]) for r in table.collect()]
    sets = {k: {g for t, l in rows if l == k for g in grams_of(t)} for k in model.languages}
    bits = lambda g: np.bitwise_and.reduce([model.words[0][at] for at in langid.places(np.array([int.from_bytes(g, "little")], np.uint64), model.bits)])
    false = 0
    for g in random.Random(1).sample(sorted(set().union(*sets.values())), 3_000):
        held = {k for i, k in enumerate(model.languages) if int(bits(g)[0]) >> i & 1}
        assert held >= {k for k in sets if g in sets[k]}
        false += len(held) - sum(g in s for s in sets.values())
    assert false < 0.05 * 3_000 * len(sets)
    for t in ["the river", "é", "x", *(t for t, _ in rows[:60])]:
        grams = grams_of(t)
        found = [sum(int(bits(g)[0]) >> i & 1 for g in grams) for i in range(len(model.languages))]
        real = [max(0.0, (h - len(grams) * f) / (1 - f)) for h, f in zip(found, model.false_positive, strict=True)]
        lang, score = langid.decide(model, [t])
        assert score[0] == pytest.approx(max(real) / sum(real) if sum(real) else 0.0)
        assert not sum(real) or real[model.languages.index(lang[0])] == max(real)
    texts_ = [t for t, _ in rows] + ["ab", "der mann ist", "the house", "", None, "a"]
    random.Random(3).shuffle(texts_)
    one = [langid.decide(model, [t]) for t in texts_]
    block = langid.decide(model, texts_)
    assert [o[0][0] for o in one] == block[0] and [o[1][0] for o in one] == block[1].tolist()


def test_more_languages_than_bits_in_a_word(spark):
    rng = random.Random(4)
    words = {f"l{k:03d}": ["".join(rng.choice("abcdefghijklmnop") for _ in range(7)) for _ in range(20)] for k in range(70)}
    rows = [(k * 100 + i, " ".join(rng.sample(w, 12)), name) for k, (name, w) in enumerate(words.items()) for i in range(4)]
    model = langid.fit(spark.createDataFrame(rows, "doc_id long, text string, lang string"))
    assert model.words.shape[0] == 2 and langid.decide(model, [" ".join(w[:5]) for w in words.values()])[0] == list(words)


def test_held_out_accuracy(spark):
    from logloom.llm.queries import op7_language_id

    sf = "/root/testdata/sf0.01"
    found = op7_language_id(spark, sf).where("held_out").join(spark.read.parquet(f"{sf}/documents.parquet"), "doc_id")
    assert found.agg(F.avg((F.col("lang") == F.col("lang_pred")).cast("double"))).first()[0] > 0.98


def links_of(rows, similarity=0.8):
    grams = lambda t: (lambda w: {tuple(w[k : k + 5]) for k in range(len(w) - 4)} if len(w) >= 5 else ({tuple(w)} if w else set()))(words_of(t))
    classes = {}
    for i, t in rows:
        classes.setdefault(t or "", i)
    sets = {i: grams(t) for t, i in classes.items()}
    links = {i: {j for j in sets if j != i and sets[i] | sets[j] and len(sets[i] & sets[j]) >= similarity * len(sets[i] | sets[j])} for i in sets}
    group = {i: i for i in sets}
    for _ in sets:
        group = {i: min([group[i], *(group[j] for j in links[i])]) for i in sets}
    return {i: (classes[t or ""], len(links[classes[t or ""]]), group[classes[t or ""]]) for i, t in rows}


@pytest.mark.parametrize("block", [1024, 4])
def test_near_join(spark, docs, nothing, monkeypatch, block):
    monkeypatch.setattr(nearjoin, "BLOCK_CLASSES", block)
    rng = random.Random(9)
    base = [rng.choice("abcdefghij") + str(k) for k in range(200)]
    group = [(1000 + k, " ".join([*base[:k], "new", *base[k + 1 :]])) for k in range(0, 60, 3)]
    more = docs.select("doc_id", "text").union(spark.createDataFrame([*group, group[0]], "doc_id long, text string")).withColumn("label", F.lit(1))
    want = links_of(sorted({*values(docs), *group}, key=lambda r: r[0]))
    got = {r["doc_id"]: (r["class_id"], r["n_links"], r["group_id"]) for r in nearjoin.join(more).collect()}
    assert got == want
    assert nearjoin.join(nothing).count() == 0
    assert tuple(nearjoin.join(spark.createDataFrame([(None, "a b c d e f")], "doc_id long, text string")).first()) == (None, None, 0, None)


def test_near_join_of_many_links(spark, monkeypatch):
    """Hundreds of pairs just above and just below the bound, in chains and crowds, against brute force."""
    monkeypatch.setattr(nearjoin, "BLOCK_CLASSES", 16)
    rng = random.Random(12)
    rows = []
    for _ in range(40):
        base = [f"{rng.choice('abcdefgh')}{rng.randrange(10**6)}" for _ in range(rng.randrange(120, 400))]
        for _ in range(6):  # a change in the middle breaks five runs, so some changes reach 0.78 to 0.86
            now = list(base)
            for at in rng.sample(range(5, len(now) - 5), max(1, round(len(now) * rng.uniform(0.008, 0.024)))):
                now[at] = f"n{rng.randrange(10**6)}"
            rows.append(" ".join(now))
        for _ in range(3):  # a chain: each differs a little more
            base = [*base[len(base) // 14 :], *(f"m{rng.randrange(10**6)}" for _ in range(len(base) // 14))]
            rows.append(" ".join(base))
    crowd = [f"c{k}" for k in range(150)]
    rows += [" ".join([*crowd[:k], "new", *crowd[k + 1 :]]) for k in range(50)]
    rows = list(enumerate(rows))
    rng.shuffle(rows)
    want = links_of(sorted(rows))
    assert sum(n for _, n, _ in want.values()) > 1_500
    got = {r["doc_id"]: (r["class_id"], r["n_links"], r["group_id"]) for r in nearjoin.join(spark.createDataFrame(rows, "doc_id long, text string").repartition(5)).collect()}
    assert got == want


def test_filters_of_ids_lose_none(spark, monkeypatch):
    rng = random.Random(9)
    ids = [rng.randrange(-(1 << 63), 1 << 63) for _ in range(3_000)] + [0, -1]
    every = spark.createDataFrame([(i, "x") for i in ids + list(range(10_000, 30_000))] + [(None, "x")], "doc_id long, id string")
    few = spark.createDataFrame([(i,) for i in ids[::2]], "id long")
    for bits in (27, 8):  # eight: far too small, so that nearly all pass
        monkeypatch.setattr(common, "FILTER_BITS", bits)
        passed = {r["doc_id"] for r in every.where(common.may_be_in(few)(F.col("doc_id"))).collect()}
        assert passed >= set(ids[::2]) and None not in passed and (len(passed) < 1_700 if bits == 27 else len(passed) > 5_000)
        left = common.without(every, "doc_id", few)
        assert left.columns == ["doc_id", "id"] and sorted(str(r["doc_id"]) for r in left.collect()) == sorted(map(str, [*ids[1::2], *range(10_000, 30_000), None]))
    assert common.without(every, "doc_id", few.limit(0)).count() == every.count()


def test_id_ranges(spark):
    """Ranges of about equal weight wherever the ids lie, ascending, the same for any partitions."""
    rng = random.Random(3)
    for ids in ([*range(20_000), 1 << 60], [-(1 << 63), (1 << 63) - 1, *range(-5_000, 5_000)], sorted(rng.sample(range(1 << 40), 5_000)) + [(1 << 62) + k for k in range(5_000)], [7] * 300 + [8], [5]):
        df = spark.createDataFrame([(i,) for i in ids] + [(None,)], "id long")
        found = []
        for parts in (1, 6):
            number, n = common.id_ranges(df.repartition(parts), "id", F.lit(100), 20_000)
            found.append(sorted(((r["id"] is None, r["id"] or 0), r["s"]) for r in df.select("id", number.alias("s")).collect()))
        assert found[0] == found[1] and [s for _, s in found[0]] == sorted(s for _, s in found[0]) and found[0][-1][1] == n - 1
        sizes = np.bincount([s for _, s in found[0][:-1]], minlength=n)
        if len(set(ids)) > 1_000:
            assert sizes.max() <= 2.2 * len(ids) / n and n >= 8
    assert common.id_ranges(df.limit(0), "id", F.lit(1), 10)[1] == 1


def test_bands():
    bands, rows = nearjoin.bands_for(0.8, 0.9999, 160)
    assert 1 - (1 - 0.8**rows) ** bands >= 0.9999 and bands * rows <= 160


def test_components(spark):
    chain = [(i, i + 1) for i in range(1, 40)] + [(100, 90), (90, 95)]
    links = spark.createDataFrame(chain, "a long, b long")
    got = {r["node"]: r["label"] for r in components.components(links, common.scratch(spark, "test-components")).collect()}
    assert got == {**dict.fromkeys(range(1, 41), 1), 90: 90, 95: 90, 100: 90}


def test_token_ids(spark, docs, nothing):
    tokenizer, folder = Tokenizer.from_file(WORD), common.scratch(spark, "test-ids")
    manifest = idstore.write(docs.withColumn("shard", F.lit(0)), folder, WORD, end_id=1)
    got = {r["doc_id"]: r for r in idstore.read(spark, folder).collect()}
    start = 0
    for i, t in values(docs):
        ids = [*tokenizer.encode(t or "", add_special_tokens=False).ids, 1]
        data = np.array(ids, "<u4").tobytes()
        assert (got[i]["start"], got[i]["n_tokens"], got[i]["ids_crc32"], bytes(got[i]["ids"])) == (start, len(ids), zlib.crc32(data), data)
        start += len(ids)
    assert {r["doc_id"]: tuple(r) for r in idstore.read(spark, folder, with_ids=False).collect()} == {i: tuple(r)[:-1] for i, r in got.items()}
    assert idstore.lookup(folder, manifest[0]["file"], 0).tolist() == [1]
    empty = common.scratch(spark, "test-ids")
    assert idstore.write(nothing, empty, WORD, end_id=1) == [] and idstore.read(spark, empty).count() == 0


def test_the_dictionary_depends_on_the_rows_alone(spark):
    """Long documents are in its sample too, equal rows count once, and files are equal byte for byte."""
    rng = random.Random(21)
    words = ["".join(rng.choice("abcdefgh") for _ in range(5)) for _ in range(300)]
    rows = [(k, " ".join(rng.choice(words) for _ in range(rng.choice([5, 60, 30_000 if k % 50 == 0 else 60])))) for k in range(200)]
    df = spark.createDataFrame([*rows, *rows[:20]], "doc_id long, text string").withColumn("ids", F.lit(1)).withColumn("h", F.lit(2))
    folders = [common.scratch(spark, "test-ids") for _ in range(2)]
    manifests = [idstore.write(df.repartition(n), f, WORD, end_id=1) for n, f in zip((1, 6), folders, strict=True)]
    assert manifests[0] == manifests[1]
    stores = [common.Store(f) for f in folders]
    for one in manifests[0]:
        assert stores[0].get(one["file"]) == stores[1].get(one["file"])
    import json

    sha = json.loads(stores[0].get("MANIFEST.json"))["dictionary"]
    assert len(stores[0].get(f"dictionary-{sha}.zdict")) > 1_000
    got = sorted((r["doc_id"], r["n_tokens"]) for r in idstore.read(spark, folders[1]).collect())
    assert len(got) == 220 and got[:2] == [(0, got[0][1])] * 2


def test_other_tokenizer_files_are_refused(tmp_path):
    import json

    with open(BYTE, encoding="utf-8") as source:
        file = json.load(source)
    for change in ({"normalizer": {"type": "NFC"}}, {"pre_tokenizer": {"type": "Whitespace"}}, {"pre_tokenizer": {**file["pre_tokenizer"], "add_prefix_space": True}}, {"decoder": None}, {"model": {**file["model"], "ignore_merges": True}}):
        (tmp_path / "t.json").write_text(json.dumps(file | change))
        with pytest.raises(ValueError):
            bpe.Vocabulary(str(tmp_path / "t.json"))
    v = bpe.Vocabulary(BYTE)
    v.encode(["short " + "x" * 5_000])
    assert all(len(word) <= bpe.MOST_CHARS for word in v.known)  # what is remembered is bounded in bytes


def test_token_ids_of_null_ids_long_words_and_repeated_rows(spark):
    tokenizer, folder = Tokenizer.from_file(WORD), common.scratch(spark, "test-ids")
    rows = [(None, "b"), (2, "a " + "w" * 30_000), (2, "a " + "w" * 30_000), (None, None), (1, " " * 100_000 + "é."), (2, "a"), (3, "")]
    idstore.write(spark.createDataFrame(rows, "doc_id long, text string").withColumn("t", F.lit("x")).repartition(4), folder, WORD, end_id=1)
    want, start = [], 0
    for i, t in sorted(rows, key=lambda r: (r[0] is None, r[0] or 0, (r[1] or "").encode())):
        ids = np.array([*tokenizer.encode(t or "", add_special_tokens=False).ids, 1], "<u4").tobytes()
        want.append((i, start, len(ids) // 4, zlib.crc32(ids)))
        start += len(ids) // 4
    assert sorted(map(tuple, idstore.read(spark, folder, with_ids=False).collect()), key=lambda r: r[1]) == want


@settings(max_examples=150, deadline=None)
@given(st.text(max_size=60))
def test_encoders_equal_the_library(text):
    v, t = bpe.vocabulary(BYTE), Tokenizer.from_file(BYTE) if not hasattr(test_encoders_equal_the_library, "t") else test_encoders_equal_the_library.t
    test_encoders_equal_the_library.t = t
    for x in (text, text + " <|endoftext|>" + text.upper(), "a  b\n\n " + text):
        want = t.encode(x, add_special_tokens=False).ids
        ids = v.encode([x])[0]
        assert np.frombuffer(ids, "<u4").tolist() == want and v.decode(ids) == t.decode(want, skip_special_tokens=False)
    w = test_encoders_equal_the_library.__dict__.setdefault("w", Tokenizer.from_file(WORD))
    own = idstore.encoder(WORD)
    for x in (text, "Aé " + text + ". b,", text.upper() + " <|endoftext|>"):
        assert np.frombuffer(own.encode([x])[0], own.kind).tolist() == w.encode(x, add_special_tokens=False).ids


def test_word_ids_of_marks_that_compose_only_in_lower_case():
    w, own = Tokenizer.from_file(WORD), idstore.encoder(WORD)
    for pair in ("H\u0331", "T\u0308", "W\u030a", "Y\u030a", "J\u030c"):
        for x in (pair, f"The {pair}ouse. A {pair.lower()} B", f"x{pair}\u0323 Éa", f"J\u0323{pair[1]}"):
            assert np.frombuffer(own.encode([x])[0], own.kind).tolist() == w.encode(x, add_special_tokens=False).ids, ascii(x)


def test_only_marks_from_u0300_to_u037f_compose_with_ascii():
    import sys
    import unicodedata

    letters = [chr(c) for c in range(65, 91)]
    other = [chr(c) for c in range(128, sys.maxunicode + 1) if not 0x300 <= c < 0x380 and (unicodedata.combining(chr(c)) or unicodedata.decomposition(chr(c)))]
    for a in letters:
        for c in other:
            assert unicodedata.normalize("NFC", a + c)[0] == a, ascii(c)
            assert unicodedata.normalize("NFC", a.lower() + c)[0] == a.lower(), ascii(c)


def test_bpe_columns(docs, nothing):
    t = Tokenizer.from_file(BYTE)
    rows = docs.select("doc_id", "text", bpe.encode_column(BYTE)("text").alias("e"))
    for r in rows.select("text", "e.*", bpe.decode_column(BYTE)("e.ids").alias("back")).collect():
        assert np.frombuffer(bytes(r["ids"]), "<u4").tolist() == t.encode(r["text"] or "", add_special_tokens=False).ids
        assert r["back"] == (r["text"] or "") and r["n_tokens"] * 4 == len(r["ids"])
    assert nothing.select(bpe.encode_column(BYTE, sums_only=True)("text").alias("e")).count() == 0


def test_pipeline_stages_of_odd_rows(spark, nothing):
    """Nulls in every column, empty and long texts, ties, repeated rows, null ids and columns with the stages' own names."""
    import corpus_pipeline

    rng = random.Random(31)
    said = lambda lang, n: " ".join(rng.choice({"en": "the house stands by the river and a stone falls".split(), "de": "das haus steht an dem fluss und ein stein".split()}[lang]) + rng.choice(["", ","]) for _ in range(n))
    rows = [(k, said("en" if k % 2 else "de", rng.randrange(20, 60)), "en" if k % 2 else "de", ("a", "b", None)[k % 3], 1) for k in range(60)]
    long = said("en", 30_000)
    rows += [(100, rows[5][1], "en", "a", 1), (101, rows[5][1] + " end", "en", "a", 1), (102, None, None, None, None), (103, "", "en", "a", 0), (104, long, None, None, None), rows[7], rows[7], (None, rows[9][1], "de", "b", 1), (None, "the river", None, "b", None)]
    docs = spark.createDataFrame(rows, SCHEMA)
    for name in ("score", "group_id", "label", "copy", "rate", "kept", "row", "found"):
        docs = docs.withColumn(name, F.lit("own"))
    seen = {}
    for name, stage in corpus_pipeline.STAGES:
        docs = seen[name] = common.stored(stage(spark, docs, ""), common.scratch(spark, "test-odd"))
        if name != "token_ids":
            assert tuple(docs.columns) == corpus_pipeline.COLUMNS
    ids = lambda df: sorted((str(r[0]) for r in df.select("doc_id").collect()))
    assert set(ids(seen["language_id"])) == {str(r[0]) for r in rows} - {"102", "103"} and seen["language_id"].where("lang is null").isEmpty()
    near = ids(seen["near_duplicates"])
    assert "100" not in near and "101" not in near and near.count("7") == 3 and near.count("None") == 2
    assert ids(seen["repeated_passages"]) == near and seen["repeated_passages"].where("text is null or n_chars <> length(text)").isEmpty()
    assert seen["repeated_passages"].where("doc_id = 7").select("text").distinct().count() == 1
    kept = {(r["doc_id"], r["text"]) for r in seen["repeated_passages"].collect()}
    assert {(r["doc_id"], r["text"]) for r in seen["mix_sources"].collect()} <= kept
    assert seen["token_ids"].count() == seen["mix_sources"].count() and seen["token_ids"].where("n_tokens * 4 <> length(ids)").isEmpty()
    for name, stage in corpus_pipeline.STAGES:
        assert stage(spark, nothing, "").count() == 0, name


def test_pipeline(spark):
    import corpus_pipeline

    sf = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    kept, seen = docs, {}
    for name, stage in corpus_pipeline.STAGES:
        kept = common.stored(stage(spark, kept, sf), common.scratch(spark, "test-pipeline"))
        seen[name] = kept
        if name != "token_ids":
            assert tuple(kept.columns) == corpus_pipeline.COLUMNS
    rows = values(docs)
    links = links_of(rows)
    assert {i for i, _ in values(seen["near_duplicates"])} == {i for i, _ in rows if links[i][2] == i}
    want = removed(values(seen["near_duplicates"]))
    assert {i: t for i, t in values(seen["repeated_passages"])} == {i: w[3].decode("utf-8", "ignore") for i, w in want.items()}
    t = Tokenizer.from_file(BYTE)
    text = dict(values(seen["repeated_passages"]))
    assert seen["token_ids"].count() == seen["mix_sources"].count() > 0
    for r in seen["token_ids"].collect():
        assert np.frombuffer(bytes(r["ids"]), "<u4").tolist() == t.encode(text[r["doc_id"]], add_special_tokens=False).ids
