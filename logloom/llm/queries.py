"""The registered queries of this package: thin calls of its operators over whole tables, and SQL for the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

import public_tokenizers

from . import bpe, common, idstore, langid, mixing, nearjoin, quality, rollup, spotsigs, suffixdedup, warc


def op1_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = common.read(spark, sf_dir, "documents").select("doc_id", "text")
    return quality.judge(docs).drop("text")


def op2_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(common.read(spark, sf_dir, "documents"))


def op3_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = suffixdedup.remove(common.read(spark, sf_dir, "documents").select("doc_id", "text"))
    return found.select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))


def op4_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = common.scratch(spark, "warc")
    warc.write(common.read(spark, sf_dir, "pages"), folder)
    return warc.read(spark, folder).drop("url")


def op5_spotsigs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spotsigs.compare_next(common.read(spark, sf_dir, "documents"))


def spotsigs_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All links of a likeness of 0.8 or more between the fingerprints of the whole table."""
    return spotsigs.join(common.read(spark, sf_dir, "documents"))


def op6_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Insert all documents under two tokenizer versions, delete later copies, then revise the counts of the first
    version to those without repeated lines. Each batch is sent twice; the second time changes nothing."""
    folder = common.scratch(spark, "token-counts")
    paths = {"v1": public_tokenizers.path("byte_bpe_50k.tiktoken"), "v2": public_tokenizers.path("byte_bpe_multi_50k.tiktoken")}
    count = rollup.token_counts(paths, public_tokenizers.PATTERN, deduplicate="v1")
    docs = common.read(spark, sf_dir, "documents").select("doc_id", "source", "lang", F.sha2("text", 256).alias("digest"), count("text").alias("n"))
    docs = common.stored(docs.select("doc_id", "source", "lang", "digest", "n.*"), f"{folder}/counts")
    both = F.explode(F.array(*[F.struct(F.lit(name).alias("tokenizer"), F.col(name).alias("n_tokens")) for name in paths]))
    flat = lambda rows: rows.select("*", both.alias("c")).select("source", "lang", "c.*", "v1", "revised")
    gone = rollup.copies(docs, folder)
    changed = docs.where("revised <> v1").select("source", "lang", F.lit("v1").alias("tokenizer"), F.col("v1").alias("n_tokens"), F.col("revised").alias("new_tokens"))
    changed_gone = gone.where("revised <> v1").select("source", "lang", F.lit("v1").alias("tokenizer"), F.col("revised").alias("n_tokens"), F.col("v1").alias("new_tokens"))
    totals = rollup.Rollup(spark, f"{folder}/rollup")
    for name, deltas in (("1-inserts", rollup.inserts(flat(docs))), ("2-deletes", rollup.deletes(flat(gone))), ("3-revisions", rollup.revisions(changed).union(rollup.revisions(changed_gone)))):
        totals.commit(name, deltas)
        totals.commit(name, deltas)
    return totals.totals()


def op7_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = common.read(spark, sf_dir, "documents")
    model = langid.fit(docs.where(langid.fold() != 2))
    found = langid.predict(docs.select("doc_id", "text"), model)
    return found.select("doc_id", (langid.fold() == 2).alias("held_out"), "lang_pred", "score")


def op8_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return nearjoin.join(common.read(spark, sf_dir, "documents"))


def op9_token_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = common.scratch(spark, "token-ids")
    idstore.write(common.read(spark, sf_dir, "documents"), folder, public_tokenizers.path("word_bpe_49k.json"), end_id=1)
    return idstore.read(spark, folder, with_ids=False)


def op10_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = common.read(spark, sf_dir, "documents").select("doc_id", "text")
    encode = bpe.encode_column(public_tokenizers.path("byte_bpe_50k.json"), sums_only=True)
    return docs.select("doc_id", encode("text").alias("x")).select("doc_id", "x.*")


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in (op1_quality_rules, op2_mix_sources, op3_suffix_dedup, op4_warc, op5_spotsigs, spotsigs_join, op6_token_counts, op7_language_id, op8_ngram_join, op9_token_ids, op10_bpe)}


def _op1_sql() -> str:
    words = ", ".join(f"'{w}'" for w in dict.fromkeys(quality.STOP_WORDS))
    return f"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS t FROM documents),
w AS (SELECT doc_id, t, list_filter(regexp_split_to_array(t, '[\\x20\\x09-\\x0D]+'), lambda x: x <> '') AS words,
  list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\\x20\\x09-\\x0D]')) AS lines FROM d),
g AS (SELECT doc_id, i, struct_pack(a := words[i], b := words[i + 1], c := words[i + 2]) AS g
  FROM (SELECT doc_id, words, unnest(range(1, len(words) - 1)) AS i FROM w WHERE len(words) >= 3)),
r AS (SELECT doc_id, i FROM (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, g) AS n FROM g) WHERE n >= 2),
c AS (SELECT doc_id, count(DISTINCT i + k)::BIGINT AS n_repeat_words FROM r, (SELECT unnest([0, 1, 2]) AS k) GROUP BY doc_id),
m AS (SELECT doc_id, len(words)::BIGINT AS n_words, coalesce(list_sum(list_transform(words, lambda x: length(x))), 0)::BIGINT AS word_chars,
  len(regexp_extract_all(t, '[#*$%&|<>]'))::BIGINT AS n_symbols, len(lines)::BIGINT AS n_lines,
  (len(lines) - len(list_distinct(lines)))::BIGINT AS n_dup_lines,
  len(list_filter(words, lambda x: lower(x) IN ({words})))::BIGINT AS n_stop_words,
  coalesce(n_repeat_words, 0)::BIGINT AS n_repeat_words FROM w LEFT JOIN c USING (doc_id)),
b AS (SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed FROM m)
SELECT *, NOT base_failed AND {" AND ".join(_rule_sql())} AS kept FROM b"""


def _rule_sql() -> list[str]:
    return [f"({r.figure}) {sign} {bound}" for r in quality.RULES for sign, bound in ((">=", r.low), ("<=", r.high)) if bound is not None]


_OP2_SQL = """
WITH n AS (SELECT source, count(*) AS n FROM documents GROUP BY source),
l AS (SELECT source, n, pow(n::DOUBLE, 0.5) / (SELECT sum(pow(n::DOUBLE, 0.5)) FROM n) * (SELECT sum(n) FROM n) / n AS rate FROM n),
c AS (SELECT source, rate, k, sum(exp(-rate + k * ln(rate) - lgamma(k + 1))) OVER (PARTITION BY source ORDER BY k) AS cum
  FROM l, (SELECT unnest(range(0, 200)) AS k)),
s AS (SELECT source, rate, list(cum) AS steps FROM c GROUP BY source, rate),
u AS (SELECT *, (CAST('0x' || substr(md5('17|' || coalesce(doc_id::VARCHAR, '')), 1, 13) AS BIGINT) + 0.5) / 4503599627370496.0 AS u FROM documents),
k AS (SELECT u.*, s.rate, len(list_filter(steps, lambda x: x <= u)) AS copies FROM u JOIN s ON u.source IS NOT DISTINCT FROM s.source)
SELECT doc_id, text, lang, source, n_chars, unnest(range(1, copies + 1))::INTEGER AS copy, round(rate, 9) AS rate FROM k"""


_OP4_SQL = """
WITH p AS (SELECT page_id, coalesce(html, '') AS h FROM pages), f AS (SELECT h, min(page_id) AS first FROM p WHERE strlen(h) >= 100 GROUP BY h)
SELECT page_id, strlen(h)::BIGINT AS payload_bytes, sha256(h) AS payload_digest, CASE WHEN first <> page_id THEN 'revisit' ELSE 'response' END AS record_type, CASE WHEN first <> page_id THEN first END AS refers_to
FROM p LEFT JOIN f USING (h)"""


#: Exact n-gram sets of all texts and every pair that shares an n-gram: right, but for small tables only.
_OP8_SQL = """
WITH RECURSIVE d AS (SELECT doc_id, coalesce(text, '') AS t FROM documents), k AS (SELECT t, min(doc_id) AS class_id FROM d GROUP BY t),
w AS (SELECT class_id, list_filter(regexp_split_to_array(t, '[\\x20\\x09-\\x0D]+'), lambda x: x <> '') AS w FROM k WHERE class_id IS NOT NULL),
g AS (SELECT DISTINCT class_id, unnest(CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 5 THEN [array_to_string(w, ' ')] ELSE list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' ')) END) AS g FROM w),
n AS (SELECT class_id, count(*) AS n FROM g GROUP BY class_id),
p AS (SELECT a.class_id AS a, b.class_id AS b, count(*) AS shared FROM g AS a JOIN g AS b ON a.g = b.g AND a.class_id <> b.class_id GROUP BY 1, 2),
l AS (SELECT a, b FROM p JOIN n AS x ON x.class_id = a JOIN n AS y ON y.class_id = b WHERE 1000 * shared >= 800 * (x.n + y.n - shared)),
r AS (SELECT class_id AS node, class_id AS reach FROM k WHERE class_id IS NOT NULL UNION SELECT r.node, l.b FROM r JOIN l ON l.a = r.reach)
SELECT doc_id, CASE WHEN doc_id IS NOT NULL THEN k.class_id END AS class_id, CASE WHEN doc_id IS NULL THEN 0 ELSE coalesce(c.n, 0) END::BIGINT AS n_links, CASE WHEN doc_id IS NOT NULL THEN m.low END AS group_id
FROM d JOIN k USING (t) LEFT JOIN (SELECT a, count(*) AS n FROM l GROUP BY a) AS c ON c.a = k.class_id LEFT JOIN (SELECT node, min(reach) AS low FROM r GROUP BY node) AS m ON m.node = k.class_id"""


def oracle_sql() -> dict[str, str]:
    return {"op1_quality_rules": _op1_sql(), "op2_mix_sources": _OP2_SQL, "op4_warc": _OP4_SQL, "op8_ngram_join": _OP8_SQL}
