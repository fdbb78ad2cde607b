"""N-gram Jaccard join by MinHash banding.

Texts are sets of runs of five words (words lie between ASCII white space). Equal texts are one class. Each class
gets a MinHash signature; bands of it are hashed, and classes that share a band are candidates. A class belongs to the
smallest class that it shares a band with, and the classes of one such home form blocks. Where a band holds classes of
two blocks, these classes (and no others) travel to that pair of blocks and are verified there on their full n-gram
sets; most meet in one block, to which a set travels once. Pairs are counted where they are found, so that no list of
pairs is ever made, and chains of candidates do not make their ends meet.
"""

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common, hashing
from .components import components
from .overlaps import Links, Overlaps

WORDS, SIMILARITY, RECALL = 5, 0.8, 0.9999
#: Hash functions at most; more rows in a band mean fewer false candidates.
HASHES = 160
#: Classes and n-grams in a block, at about.
BLOCK_CLASSES, BLOCK_GRAMS = 512, 1 << 19


def bands_for(similarity: float = SIMILARITY, recall: float = RECALL, hashes: int = HASHES) -> tuple[int, int]:
    """(bands, rows): the most rows for which enough bands to find a pair at ``similarity`` with probability
    ``recall`` need no more than ``hashes`` functions."""
    best = None
    for rows in range(1, hashes + 1):
        p = similarity**rows
        bands = 1 if p >= 1 else math.ceil(math.log(1 - recall) / math.log(1 - p))
        if bands * rows > hashes:
            break
        best = bands, rows
    if best is None:
        raise ValueError("too few hash functions for this recall")
    return best


def band_hashes(texts: list[bytes], bands: int, rows: int, n: int = WORDS) -> tuple[np.ndarray, list[list[int]]]:
    """The count of n-grams of each text (repeats too) and its bands' hashes; none for a text without words."""
    grams, doc = hashing.grams(texts, n)
    count = np.bincount(doc, minlength=len(texts)) if len(doc) else np.zeros(len(texts), int)
    out: list[list[int]] = [[] for _ in texts]
    own = np.flatnonzero(count)
    if not len(own):
        return count, out
    first = np.concatenate(([0], np.cumsum(count[own])[:-1]))
    factors = np.random.default_rng(20).integers(1, 1 << 63, (bands * rows, 2), dtype=np.uint64)
    found = np.zeros((bands, len(own)), np.uint64)
    for band in range(bands):
        h = np.full(len(own), band + 1, np.uint64)
        for row in range(rows):
            a, b = factors[band * rows + row]
            h = hashing.mix(h * np.uint64(31) + np.minimum.reduceat((grams ^ b) * (a | np.uint64(1)), first))
        found[band] = h
    for i, hashes in zip(own.tolist(), found.view(np.int64).T.tolist(), strict=True):
        out[i] = hashes
    return count, out


def signatures(bands: int, rows: int, n: int):
    @F.pandas_udf("n_grams long, bands array<long>")
    def udf(parts: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        common.claim(__name__)
        for part in parts:
            counts, hashes = [], []
            for block in common.blocks_of(((t or b"",) for t in part.tolist()), 0):
                c, h = band_hashes([t for (t,) in block], bands, rows, n)
                counts += c.tolist()
                hashes += h
            yield pd.DataFrame({"n_grams": counts, "bands": hashes})
        common.release()

    return udf


def verify(ids: list[int], blocks: list[int], texts: list[bytes], same_block: bool, n: int, similarity: float) -> Iterator[tuple[int, int, int]]:
    """(id, its links, smallest id that it is linked to through others) for the linked of these classes. Pairs are
    those within a block, or across two."""
    m = len(ids)
    grams, doc = [], []
    for low in range(0, m, 64):
        g, d = hashing.grams(texts[low : low + 64], n)
        grams.append(g)
        doc.append(d + low)
    found = Overlaps(np.concatenate(grams), np.concatenate(doc), m)
    block, links, size = np.array(blocks), Links(m), found.size
    numerator = round(similarity * 1000)
    for i in range(m):
        both = found.count(i)
        if both is None:
            continue
        near = both * 1000 >= numerator * (size + size[i] - both)
        near[: i + 1] = False
        near &= (block == block[i]) if same_block else (block != block[i])
        if (partners := np.flatnonzero(near)).size:
            links.add(i, partners)
    yield from links.rows(ids)


def join(docs: DataFrame, similarity: float = SIMILARITY, n: int = WORDS, recall: float = RECALL, key: str = "doc_id", text: str = "text") -> DataFrame:
    """A row for each document: doc_id, class_id (the smallest id with the same text), n_links (classes of other
    texts whose Jaccard index with its own is ``similarity`` or more) and group_id (the smallest id of its connected
    group).

    Null and wordless texts have no n-grams, so no links; equal ones are a class (nulls count as empty). A text of
    fewer than ``n`` words is one n-gram. Texts are compared whole, however long. Rows of one id are one document
    (where their texts differ, links are those of the smallest). A row whose id is null is returned with
    null class and group and no links. Other columns are not looked at, so their names may be any; an empty table
    gives an empty one.
    """
    spark = docs.sparkSession
    folder = common.scratch(spark, "nearjoin")
    common.small_batches(spark)
    bands, rows = bands_for(similarity, recall)
    docs = docs.select(common.column(key).cast("long").alias("doc_id"), F.coalesce(common.column(text), F.lit("")).cast("binary").alias("t"))
    signed = docs.select("doc_id", F.unhex(F.md5("t")).alias("digest"), signatures(bands, rows, n)("t").alias("s"))
    signed = common.stored(signed.select("doc_id", "digest", "s.*"), f"{folder}/signed")
    firsts = signed.groupBy("digest").agg(F.min("doc_id").alias("class_id"), F.count(F.lit(1)).alias("n")).where("class_id is not null")
    firsts = common.stored(firsts, f"{folder}/classes")

    classes = signed.join(firsts.select(F.col("digest").alias("d"), "class_id"), (F.col("doc_id") == F.col("class_id")) & (F.col("digest") == F.col("d"))).select("class_id", "n_grams", "bands").dropDuplicates(["class_id", "bands"])
    classes = common.stored(classes, f"{folder}/signatures")
    banded = classes.select("class_id", "n_grams", F.explode("bands").alias("band"))
    leaders = banded.groupBy("band").agg(F.min("class_id").alias("leader"), F.max("class_id").alias("last")).where("leader < last").drop("last")
    leaders = common.stored(leaders, f"{folder}/leaders")
    met = common.stored(banded.join(leaders, "band").select("band", "class_id", "n_grams", "leader"), f"{folder}/met")

    homes = common.stored(met.groupBy("class_id").agg(F.min("leader").alias("home"), F.max("n_grams").alias("n_grams")), f"{folder}/homes")
    blocks = homes.groupBy("home").agg(F.greatest(F.ceil(F.count(F.lit(1)) / BLOCK_CLASSES), F.ceil(F.sum("n_grams") / BLOCK_GRAMS)).cast("int").alias("blocks"))
    blocks = common.stored(blocks.where("blocks > 1"), f"{folder}/blocks")
    placed = homes.join(blocks, "home", "left").select("class_id", F.struct("home", F.coalesce(F.pmod(F.xxhash64("class_id"), F.col("blocks")).cast("int"), F.lit(0)).alias("block")).alias("place"))
    placed = common.stored(met.select("class_id", "band").join(placed, "class_id"), f"{folder}/placed")
    held = placed.groupBy("band").agg(F.min("place").alias("low"), F.max("place").alias("high"))
    held = common.stored(held, f"{folder}/held")
    inside = placed.join(held.where("low = high").select("band"), "band").select("class_id", F.lit(0).alias("side"), F.col("place").alias("i"), F.col("place").alias("j"))
    across = placed.join(held.where("low < high").select(F.col("band").alias("of")), F.col("band") == F.col("of")).select("class_id", "band", "place")
    across = common.stored(across, f"{folder}/across")
    several = across.select("band", F.col("place").alias("other")).distinct()  # as many as there are blocks with the band
    side = F.when(F.col("place") <= F.col("other"), 0).otherwise(1)
    pairs = across.join(common.stored(several, f"{folder}/several"), "band").select("class_id", side.alias("side"), F.least("place", "other").alias("i"), F.greatest("place", "other").alias("j"))
    asked = common.stored(inside.union(pairs).distinct().withColumnRenamed("class_id", "doc_id"), f"{folder}/asked")
    among = common.may_be_in(asked.select(F.col("doc_id").alias("id")).distinct())
    # texts of documents without candidates stay where they are; the others are joined in the same way at every size
    members = docs.where(among("doc_id")).join(asked.hint("merge"), "doc_id").select("i", "j", "doc_id", "side", "t")
    members = members.repartition(common.partitions(spark), "i", "j").sortWithinPartitions("i", "j", "doc_id", "t")
    kinds = pa.schema([("class_id", pa.int64()), ("links", pa.int64()), ("root", pa.int64())])

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def found() -> Iterator[tuple]:
            for (i, j), group in common.runs_by_key(batches, 2):
                group = list({r[2]: r for r in reversed(group)}.values())[::-1]  # repeated rows of an id: the first
                yield from verify([r[2] for r in group], [r[3] for r in group], [r[4] for r in group], i == j, n, similarity)

        yield from common.batches_of(found(), kinds)

    verified = common.stored(members.mapInArrow(common.releasing(work), "class_id long, links long, root long"), f"{folder}/verified")
    groups = components(verified.select(F.col("class_id").alias("a"), F.col("root").alias("b")).distinct(), f"{folder}/groups")
    counted = verified.groupBy("class_id").agg(F.sum("links").alias("n_links")).join(groups, F.col("class_id") == F.col("node"), "left").select("class_id", "n_links", F.col("label").alias("group_id"))
    counted = common.stored(counted, f"{folder}/counted")

    copied = firsts.where("n > 1").select("digest", F.col("class_id").alias("of"))
    copied = common.stored(copied, f"{folder}/copied")
    out = signed.select("doc_id", "digest").join(copied, "digest", "left").select("doc_id", F.when(F.col("doc_id").isNotNull(), F.coalesce("of", "doc_id")).alias("class_id"))
    out = out.join(counted, "class_id", "left")
    return out.select("doc_id", "class_id", F.coalesce("n_links", F.lit(0)).alias("n_links"), F.coalesce("group_id", "class_id").alias("group_id"))
