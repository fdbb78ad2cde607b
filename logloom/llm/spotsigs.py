"""Document fingerprints: SpotSigs.

A signature is a common word (the anchor) and the chain of the next content words after it. A document's
fingerprint is the set of its signatures, kept as sorted 32-bit hashes; likeness is the Jaccard index of two sets.
A text in which no content word follows a common word is fingerprinted by the chains at each of its words.

:func:`compare_next` compares given pairs. :func:`join` finds all pairs of a likeness: sets are partitioned by their
length, so that a set meets its own partition and the one before; in a partition only sets that share one of their
rarest signatures meet; and a pair is dropped at the first bound (lengths, places, bitmaps, an earlier meeting) that it
breaks. Bitmaps go before: whole sets travel only to meetings in which these leave them a partner.
"""

from __future__ import annotations

import base64
import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common, hashing
from .components import components
from .overlaps import Links, Overlaps
from .quality import STOP_WORDS

#: Content words in a chain.
CHAIN = 2
SHARD_BYTES = 128 << 20
SIMILARITY = 0.8
#: Signatures are counted in this many cells (a power of two); all that the driver sees and broadcasts of them.
CELLS = 1 << 18
#: Sets and signatures in a block of sets that share a signature, at about.
BLOCK_SETS, BLOCK_SIGNATURES = 1024, 1 << 20
#: Bytes of a set's bitmap.
BITMAP = 64


def tokens(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """A hash for each word (lower case; runs of letters, digits and non-ASCII bytes) and its text's number."""
    return hashing.words([t.lower().encode("utf-8", "replace") for t in texts], hashing.WORDS)


def _chain(anchors: np.ndarray, at: np.ndarray, doc: np.ndarray, words: np.ndarray, owner: np.ndarray, chain: int) -> np.ndarray:
    """(text, signature) keys of anchors whose chain begins at index ``at`` of the words; chains end with the text."""
    words, owner = np.concatenate((words, np.zeros(chain, np.uint64))), np.concatenate((owner, np.full(chain, -1)))
    there = owner[at] == doc
    at, doc, h = at[there], doc[there], anchors[there]
    for k in range(chain):
        h = hashing.mix(h * np.uint64(31) + np.where(owner[at + k] == doc, words[at + k], np.uint64(0)))
    return np.unique(doc.astype(np.uint64) << np.uint64(32) | h >> np.uint64(32))


_STOP = np.unique(tokens([" ".join(STOP_WORDS)])[0])
_MAYBE = np.zeros(1 << 16, bool)
_MAYBE[(_STOP & np.uint64(0xFFFF)).astype(np.int64)] = True


def signatures(texts: list[str], chain: int = CHAIN) -> np.ndarray:
    """Sorted keys: a text's number in the upper 32 bits, a signature in the lower."""
    h, doc = tokens(texts)
    common_word = _MAYBE[(h & np.uint64(0xFFFF)).astype(np.int64)]
    common_word[common_word] = np.isin(h[common_word], _STOP)
    anchor, content = np.flatnonzero(common_word), np.flatnonzero(~common_word)
    keys = _chain(h[anchor], anchor - np.arange(len(anchor)), doc[anchor], h[content], doc[content], chain)
    bare = np.bincount((keys >> np.uint64(32)).astype(np.int64), minlength=len(texts)) == 0
    if (other := np.flatnonzero(bare[doc])).size:
        more = _chain(np.ones(len(other), np.uint64), other, doc[other], h, doc, chain)
        keys = np.union1d(keys, more)
    return keys


def likeness(a: np.ndarray, b: np.ndarray, n: int) -> np.ndarray:
    """Jaccard indexes of n pairs of sets, given as keys; 1 for two empty sets."""
    size = lambda k: np.bincount((k >> np.uint64(32)).astype(np.int64), minlength=n)[:n]
    both = size(np.intersect1d(a, b, assume_unique=True))
    either = size(a) + size(b) - both
    return np.where(either > 0, both / np.maximum(either, 1), 1.0)


def strings(keys: np.ndarray, n: int) -> list[str]:
    """The fingerprints: the sorted hashes of each set in base 64."""
    cuts = np.searchsorted(keys, np.arange(n + 1, dtype=np.uint64) << np.uint64(32))
    low = keys.astype("<u4")
    return [base64.b64encode(low[i:j].tobytes()).decode() for i, j in zip(cuts[:-1], cuts[1:], strict=True)]


def with_next(df: DataFrame, key: str = "doc_id", text: str = "text", shard_bytes: int = SHARD_BYTES) -> DataFrame:
    """shard, look, id, t: texts (null: empty) dealt by id ranges, sorted by descending id (nulls last, ties by
    text); each range ends with a copy (look = 1) of the first row of the range that follows in that order.

    The copies are found from the largest id of each range, so nothing is sorted in one task.
    """
    spark = df.sparkSession
    docs = df.select(common.column(key).cast("long").alias("id"), F.coalesce(common.column(text), F.lit("")).alias("t"))
    shard, shards = common.id_ranges(docs, "id", F.octet_length("t").cast("long"), shard_bytes)
    docs = docs.withColumn("shard", F.when(F.col("id").isNull(), 0).otherwise(shard))
    heads = sorted(map(tuple, docs.select("id", "shard").where("id is not null").groupBy("shard").agg(F.max("id")).collect()))  # a row for each range
    follows = spark.createDataFrame([(k, top, up) for (k, top), (up, _) in zip(heads, [*heads[1:], *heads[:1]], strict=True)], "shard int, id long, to int")
    both = F.when(F.col("to").isNull(), F.array(F.struct("shard", F.lit(0).alias("look")))).otherwise(F.array(F.struct("shard", F.lit(0).alias("look")), F.struct(F.col("to").alias("shard"), F.lit(1).alias("look"))))
    docs = docs.join(F.broadcast(follows), ["shard", "id"], "left").select("id", "t", F.explode(both).alias("p")).select("p.shard", "p.look", "id", "t")
    return common.dealt(docs, shards).sortWithinPartitions("shard", "look", F.desc_nulls_last("id"), "t")


def compare_next(df: DataFrame, key: str = "doc_id", text: str = "text", chain: int = CHAIN) -> DataFrame:
    """For each document its fingerprint, that of its edited text (its last third replaced by the beginning of the
    next document, by descending id) and the likeness of its fingerprint to the edited text's and the next one's.

    A null text is empty, and the likeness of two empty fingerprints is 1. Rows that share an id follow each other in
    order of their texts, so repeated rows do too; rows without an id follow all others. The last row is followed by the
    first; a table of one row by that row; an empty table gives an empty one. Texts are fingerprinted whole. Other
    columns are not looked at, so their names may be any.
    """
    kinds = [("doc_id", pa.int64()), ("n_chars", pa.int64()), ("edited_sha256", pa.string()), ("fingerprint", pa.string()), ("edited_fingerprint", pa.string()), ("near_edited", pa.float64()), ("near_next", pa.float64())]

    def results(ids: list, texts: list[str]) -> Iterator[tuple]:
        """texts has one more than ids: the last one's next."""
        n = len(ids)
        edited = [t[: len(t) - len(t) // 3] + u[: len(t) // 3] for t, u in zip(texts, texts[1:], strict=False)]
        own, new = signatures(texts, chain), signatures(edited, chain)
        one = np.uint64(1) << np.uint64(32)
        shifted = own[own >= one] - one
        mine = own[own < np.uint64(n) << np.uint64(32)]
        near_edited, near_next = likeness(mine, new, n), likeness(mine, shifted, n)
        prints, edited_prints = strings(mine, n), strings(new, n)
        for i in range(n):
            yield ids[i], len(texts[i]), hashlib.sha256(edited[i].encode("utf-8", "replace")).hexdigest(), prints[i], edited_prints[i], float(near_edited[i]), float(near_next[i])

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
        ids: list = []
        texts: list[str] = []
        shard, first, done, chars = None, "", True, 0
        for number, look, doc, t in common.rows_of(batches):
            if number != shard:
                if ids and not done:  # no id in the table: the first row follows the last
                    yield from results(ids, [*texts, first])
                ids, texts, shard, first, done, chars = [], [], number, t, False, 0
            if look:
                if not done:
                    yield from results(ids, [*texts, t])
                    ids, texts, done = [], [], True
                continue
            if chars >= 1 << 20:
                yield from results(ids, [*texts, t])
                ids, texts, chars = [], [], 0
            ids.append(doc)
            texts.append(t)
            chars += len(t)
        if ids and not done:
            yield from results(ids, [*texts, first])

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from common.batches_of(rows(batches), pa.schema(kinds))

    return with_next(df, key, text).mapInArrow(common.releasing(work), "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double")


def edges(similarity: float, most: int = 1 << 32) -> np.ndarray:
    """Where partitions of set lengths begin: a set and a longer one of this likeness lie in one partition or in two
    that follow each other."""
    numerator = round(similarity * 1000)
    if not 0 < numerator < 1000:
        raise ValueError("similarity lies between 0 and 1; sets of likeness 1 are classes")
    found = [1]
    while found[-1] <= most:
        found.append(found[-1] * 1000 // numerator + 1)
    return np.array(found, np.int64)


def bitmap(signatures: np.ndarray) -> bytes:
    """A bit for each signature, at a place of its own hash. A bit that one set's has and another's lacks stands for a
    signature, at least, that the other does not hold."""
    bits = np.zeros(8 * BITMAP, bool)
    bits[signatures.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(64 - int(math.log2(8 * BITMAP)))] = True
    return np.packbits(bits).tobytes()


def survivors(own: list[bool], at: list[int], n: list[int], blocks: list[int], bitmaps: list[bytes], same_block: bool, similarity: float) -> np.ndarray:
    """Whether each of these sets, which share the signature at the place ``at`` of each and come in order of length,
    has a partner that lengths, places and bitmaps do not rule out."""
    numerator, size, place = round(similarity * 1000), np.array(n), np.array(at)
    bits, block, mine, left = np.frombuffer(b"".join(bitmaps), "<u8").reshape(len(n), -1), np.array(blocks), np.array(own), size - place
    found = np.zeros(len(n), bool)
    for i in range(len(n)):
        last = int(np.searchsorted(size, size[i] * 1000 // numerator, "right"))  # longer sets cannot be near
        j = np.arange(i + 1, last)
        j = j[(block[j] == block[i]) if same_block else (block[j] != block[i])]
        j = j[mine[j] | mine[i]]
        total = size[j] + size[i]
        least = -(-numerator * total // (1000 + numerator))  # signatures that near sets have in common
        missing = np.bitwise_count(bits[i] & ~bits[j]).sum(1).astype(np.int64), np.bitwise_count(bits[j] & ~bits[i]).sum(1).astype(np.int64)
        may = np.minimum(np.minimum(left[j], left[i]), np.minimum(size[i] - missing[0], size[j] - missing[1])) >= least
        if may.any():
            found[i] = True
            found[j[may]] = True
    return found


def compare(ids: list[int], own: list[bool], at: list[int], blocks: list[int], sets: list[bytes], same_block: bool, similarity: float) -> Iterator[tuple[int, int, int]]:
    """(id, its links, smallest id that it is linked to through others) for the linked of these sets, which share the
    signature at the place ``at`` of each and come in order of length. Pairs are those within a block, or across two,
    of which one set at least belongs to the partition; a pair with a common signature before ``at`` counts there."""
    m, numerator = len(ids), round(similarity * 1000)
    values = [np.frombuffer(s, "<u4") for s in sets]
    place, size = np.array(at), np.array([len(v) for v in values])
    number = np.arange(m)
    before = Overlaps(np.concatenate([v[:k] for v, k in zip(values, at, strict=True)]), np.repeat(number, place), m)
    after = Overlaps(np.concatenate([v[k:] for v, k in zip(values, at, strict=True)]), np.repeat(number, size - place), m)
    block, mine, left, links = np.array(blocks), np.array(own), size - place, Links(m)
    for i in range(m):
        last = int(np.searchsorted(size, size[i] * 1000 // numerator, "right"))  # longer sets cannot be near
        if last <= i + 1:
            continue
        may = np.minimum(left, left[i]) * (1000 + numerator) >= numerator * (size + size[i])
        may[: i + 1] = False
        may[last:] = False
        may &= (block == block[i]) if same_block else (block != block[i])
        if not mine[i]:
            may &= mine
        if not may.any():
            continue
        if (met := before.count(i)) is not None:
            may &= met == 0
        both = after.count(i)
        if both is None:
            continue
        near = may & (both * (1000 + numerator) >= numerator * (size + size[i]))
        if (partners := np.flatnonzero(near)).size:
            links.add(i, partners)
    yield from links.rows(ids)


def join(docs: DataFrame, similarity: float = SIMILARITY, chain: int = CHAIN, key: str = "doc_id", text: str = "text") -> DataFrame:
    """A row for each document: doc_id, class_id (the smallest id with the same fingerprint), n_links (other classes
    whose fingerprints have a Jaccard index of ``similarity`` or more, in thousandths) and group_id (the smallest id
    of its connected group).

    A null text is empty; texts without words are a class without links. Texts are fingerprinted whole; other columns
    are not looked at, so their names may be any; an empty table gives an empty one. Where rows of one id differ in their
    fingerprints, links are those of one of them. A row whose id is null has null class and group and no links.

    Each set goes to the partition of its length, and as a visitor to the one before if that holds sets near enough.
    Its signatures are in one order for all sets, by the count of their cell (rarest first); two sets of the likeness
    have a signature in common among the first n - ceil(similarity * n) + 1 of both, whatever the order. Sets that
    meet in such a signature are compared in blocks, and each pair counts where it meets first.
    """
    spark, numerator = docs.sparkSession, round(similarity * 1000)
    starts = edges(similarity)
    folder = common.scratch(spark, "spotsigs")
    common.small_batches(spark)
    shift = np.uint32(32 - int(math.log2(CELLS)))
    docs = docs.select(common.column(key).cast("long").alias("doc_id"), F.coalesce(common.column(text), F.lit("")).alias("t"))

    def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def rows() -> Iterator[tuple]:
            for block in common.blocks_of(common.rows_of(batches), 1):
                keys = signatures([r[1] for r in block], chain)
                cuts = np.searchsorted(keys, np.arange(len(block) + 1, dtype=np.uint64) << np.uint64(32))
                low = keys.astype("<u4")
                for k, (doc, _) in enumerate(block):
                    data = low[cuts[k] : cuts[k + 1]].tobytes()
                    yield doc, hashlib.md5(data).digest(), data

        yield from common.batches_of(rows(), pa.schema([("doc_id", pa.int64()), ("digest", pa.binary()), ("sigs", pa.binary())]))

    signed = common.stored(docs.mapInArrow(common.releasing(sign), "doc_id long, digest binary, sigs binary"), f"{folder}/signed")
    firsts = signed.groupBy("digest").agg(F.min("doc_id").alias("class_id"), F.count(F.lit(1)).alias("n")).where("class_id is not null")
    firsts = common.stored(firsts, f"{folder}/classes")

    def weigh(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = np.zeros(CELLS, np.int64)
        for batch in batches:
            values = [v for v in batch.column("sigs").to_pylist() if v]
            counts += np.bincount(np.frombuffer(b"".join(values), "<u4") >> shift, minlength=CELLS)
        there = np.flatnonzero(counts)
        yield pa.RecordBatch.from_arrays([pa.array(there, pa.int32()), pa.array(counts[there], pa.int64())], names=["cell", "n"])

    weights = np.zeros(CELLS, np.int64)
    for cell, n in signed.select("sigs").mapInArrow(weigh, "cell int, n long").groupBy("cell").agg(F.sum("n").alias("n")).collect():  # CELLS rows at most
        weights[cell] = min(n, (1 << 31) - 1)
    shared = spark.sparkContext.broadcast(weights)

    def arrange(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def rows() -> Iterator[tuple]:
            counts = shared.value
            for class_id, data in common.rows_of(batches):
                value = np.frombuffer(data, "<u4")
                yield class_id, len(value), value[np.lexsort((value, counts[value >> shift]))].tobytes()

        yield from common.batches_of(rows(), pa.schema([("class_id", pa.int64()), ("n", pa.int32()), ("sigs", pa.binary())]))

    one = firsts.groupBy("class_id").agg(F.min("digest").alias("d"))
    sets = signed.join(one, (F.col("doc_id") == F.col("class_id")) & (F.col("digest") == F.col("d"))).where("length(sigs) > 0").select("class_id", "sigs").dropDuplicates(["class_id"])
    sets = common.stored(sets.mapInArrow(common.releasing(arrange), "class_id long, n int, sigs binary"), f"{folder}/ordered")

    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def rows() -> Iterator[tuple]:
            counts = shared.value
            for class_id, n, data in common.rows_of(batches):
                part = int(np.searchsorted(starts, n, "right")) - 1
                visits = part > 0 and n * numerator <= (int(starts[part]) - 1) * 1000
                first = np.frombuffer(data, "<u4")[: n - -(-n * numerator // 1000) + 1]
                bits = bitmap(np.frombuffer(data, "<u4"))
                for at, sig in enumerate((counts[first >> shift] << 32 | first).tolist()):
                    yield part, sig, class_id, n, at, True, bits
                    if visits:
                        yield part - 1, sig, class_id, n, at, False, bits

        yield from common.batches_of(rows(), pa.schema([("part", pa.int32()), ("sig", pa.int64()), ("class_id", pa.int64()), ("n", pa.int32()), ("at", pa.int32()), ("own", pa.bool_()), ("bits", pa.binary())]))

    # sig holds the cell's count above the signature, so it is the common order; the meetings are made twice, not stored
    met = sets.mapInArrow(common.releasing(meet), "part int, sig long, class_id long, n int, at int, own boolean, bits binary")
    size = F.greatest(F.ceil(F.count(F.lit(1)) / BLOCK_SETS), F.ceil(F.sum("n") / BLOCK_SIGNATURES)).cast("int")
    who = [F.bit_xor(F.xxhash64(F.lit(k), "class_id")).alias(f"who{k}") for k in (1, 2)]
    places = met.groupBy("part", "sig").agg(size.alias("blocks"), F.count(F.lit(1)).alias("m"), F.max("own").alias("any"), *who).where("m > 1 and any")
    # where the same sets meet in several signatures, all their pairs meet first in the first of these
    places = places.groupBy("part", "m", "who1", "who2").agg(F.min(F.struct("sig", "blocks")).alias("p")).select("part", "p.*")
    places = common.stored(places, f"{folder}/places")
    block = F.pmod(F.xxhash64("class_id"), F.col("blocks")).cast("int")
    pairs = F.transform(F.sequence(F.lit(0), F.col("blocks") - 1), lambda j: F.struct(F.least("block", j).alias("i"), F.greatest("block", j).alias("j")))
    met = met.join(places, ["part", "sig"]).withColumn("block", block).withColumn("p", F.explode(pairs)).select("part", "sig", "p.i", "p.j", "n", "class_id", "own", "at", "block", "bits")
    met = met.repartition(common.partitions(spark), "part", "sig", "i", "j").sortWithinPartitions("part", "sig", "i", "j", "n", "class_id")

    def sift(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def rows() -> Iterator[tuple]:
            for (part, sig, i, j), group in common.runs_by_key(batches, 4):
                _, _, _, _, n, _, own, at, blocks, bits = map(list, zip(*group, strict=True))
                for k in np.flatnonzero(survivors(own, at, n, blocks, bits, i == j, similarity)).tolist():
                    yield part, sig, i, j, *group[k][4:9]

        yield from common.batches_of(rows(), pa.schema([("part", pa.int32()), ("sig", pa.int64()), ("i", pa.int32()), ("j", pa.int32()), ("n", pa.int32()), ("class_id", pa.int64()), ("own", pa.bool_()), ("at", pa.int32()), ("block", pa.int32())]))

    # bitmaps go to all meetings, whole sets only to those where they may be near another
    dealt = common.stored(met.mapInArrow(common.releasing(sift), "part int, sig long, i int, j int, n int, class_id long, own boolean, at int, block int"), f"{folder}/dealt")
    dealt = dealt.join(sets.select("class_id", "sigs"), "class_id").select("part", "sig", "i", "j", "n", "class_id", "own", "at", "block", "sigs")
    dealt = dealt.repartition(common.partitions(spark), "part", "sig", "i", "j").sortWithinPartitions("part", "sig", "i", "j", "n", "class_id")

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def found() -> Iterator[tuple]:
            for (_, _, i, j), group in common.runs_by_key(batches, 4):
                _, _, _, _, _, ids, own, at, blocks, values = map(list, zip(*group, strict=True))
                yield from compare(ids, own, at, blocks, values, i == j, similarity)

        yield from common.batches_of(found(), pa.schema([("class_id", pa.int64()), ("links", pa.int64()), ("root", pa.int64())]))

    linked = common.stored(dealt.mapInArrow(common.releasing(work), "class_id long, links long, root long"), f"{folder}/linked")
    groups = components(linked.select(F.col("class_id").alias("a"), F.col("root").alias("b")).distinct(), f"{folder}/groups")
    counted = linked.groupBy("class_id").agg(F.sum("links").alias("n_links")).join(groups, F.col("class_id") == F.col("node"), "left").select("class_id", "n_links", F.col("label").alias("group_id"))
    counted = common.stored(counted, f"{folder}/counted")
    copied = common.stored(firsts.where("n > 1").select("digest", F.col("class_id").alias("of")), f"{folder}/copied")
    out = signed.select("doc_id", "digest").join(copied, "digest", "left").select("doc_id", F.when(F.col("doc_id").isNotNull(), F.coalesce("of", "doc_id")).alias("class_id"))
    out = out.join(counted, "class_id", "left")
    return out.select("doc_id", "class_id", F.coalesce("n_links", F.lit(0)).alias("n_links"), F.coalesce("group_id", "class_id").alias("group_id"))
