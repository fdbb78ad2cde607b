"""Language identification with language-bitmask n-gram filters.

Each language has a Bloom filter of all n-grams that its sample holds. The filters are bit-sliced: entry i of an array
of 64-bit words (one array for each 64 languages) holds bit i of every language's filter, so the words at an n-gram's
places, and-ed, are the set of all languages that hold the n-gram. A text's popcounts by language, less what false
positives add, decide.

N-grams are :data:`N` bytes of the lower-cased UTF-8 text, in which runs of ASCII characters other than letters are a
space, and of which a space stands before and after. They lie within one text, so a prediction depends on that text and
the model alone.
"""

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import common

N = 5
PLACES = 3
#: The bounded sample that a model is fitted on: labelled documents of each language, at about.
SAMPLE_DOCUMENTS = 4_000
#: Bits of a filter for each n-gram of the language that has most; a filter has 2^MOST_BITS at most.
ROOM, MOST_BITS = 8, 24

_MULTIPLIERS = (np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F), np.uint64(0x165667B19E3779F9))
_CLEAN = bytes(c + 32 if 65 <= c <= 90 else c if 97 <= c <= 122 or c >= 128 else 32 for c in range(256))
_ASCII_LETTER = re.compile("[A-Za-z]")
_BLANKS = re.compile(rb" {2,}")
_NONE = np.uint64(0)


@dataclass
class Model:
    languages: list[str]
    bits: int
    words: np.ndarray
    false_positive: np.ndarray
    fallback: int


def has_letter(text: str | None) -> bool:
    return bool(text) and (_ASCII_LETTER.search(text) is not None or any(map(str.isalpha, text)))


def grams(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """The n-grams of the texts in order, and where each text's begin; the last entry is the end. Places at which a
    window would reach past its text's end hold :data:`_NONE`, which no n-gram equals."""
    clean = [_BLANKS.sub(b" ", b" " + t.encode("utf-8", "replace").translate(_CLEAN) + b" ") for t in texts]
    starts = np.concatenate(([0], np.cumsum([len(c) for c in clean]))).astype(np.int64)
    a = np.frombuffer(b"".join([*clean, b"\0" * (N - 1)]), np.uint8).astype(np.uint64)
    size = int(starts[-1])
    g = a[:size].copy()
    for k in range(1, N):
        g |= a[k : k + size] << np.uint64(8 * k)
    for k in range(1, N):  # the last N - 1 places of a text; shorter texts have no window
        at = starts[1:] - k
        g[at[at >= starts[:-1]]] = _NONE
    return g, starts


def places(g: np.ndarray, bits: int) -> Iterator[np.ndarray]:
    for m in _MULTIPLIERS[:PLACES]:
        yield ((g * m) >> np.uint64(64 - bits)).astype(np.int64)


def fit(labelled: DataFrame, text: str = "text", lang: str = "lang", key: str = "doc_id", documents: int = SAMPLE_DOCUMENTS) -> Model:
    """A model of the languages of ``labelled``, as many as there are. Rows without text or language are left out.

    At most about ``documents`` rows of each language are used, picked by a hash of ``key`` (null: as an empty text);
    of these the whole texts, however long, and every n-gram. Repeated rows are picked together and change nothing, as
    a filter holds an n-gram or not. No labelled rows: a model without languages, for which every text is ``und``.

    N-grams stay on the executors: counts of distinct ones size the filters, and what reaches the driver are the
    filters' words, 2^:data:`MOST_BITS` for each 64 languages at most.
    """
    spark = labelled.sparkSession
    rows = labelled.select(common.column(key).alias("k"), common.column(lang).alias("l"), common.column(text).alias("t")).where("l is not null")
    counts = {r["l"]: r["n"] for r in rows.groupBy("l").agg(F.count(F.lit(1)).alias("n")).collect()}
    languages = sorted(counts)
    if not languages:
        return Model([], 1, np.zeros((1, 2), np.uint64), np.zeros(0), 0)
    numbers = {name: k for k, name in enumerate(languages)}
    rates = spark.sparkContext.broadcast({k: min(1.0, documents / n) for k, n in counts.items()})

    def distinct(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[str, list[np.ndarray]] = {}
        size = 0

        def flush() -> Iterator[pa.RecordBatch]:
            for name, parts in held.items():
                values = np.unique(np.concatenate(parts))
                values = values[values != _NONE].view(np.int64)
                for low in range(0, len(values), 1 << 16):
                    some = values[low : low + (1 << 16)]
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(len(some), numbers[name], np.int32)), pa.array(some)], names=["l", "g"])

        for block in common.blocks_of((r for r in common.rows_of(batches) if r[2] < rates.value[r[0]] * (1 << 20)), 1):
            for name in {r[0] for r in block}:
                g = np.unique(grams([r[1] for r in block if r[0] == name])[0])
                held.setdefault(name, []).append(g)
                size += len(g)
            if size > 1 << 20:
                yield from flush()
                held, size = {}, 0
        yield from flush()

    picked = F.pmod(F.xxhash64(F.coalesce(F.col("k").cast("string"), F.lit(""))), F.lit(1 << 20))
    found = rows.where("t is not null").select("l", "t", picked.alias("h"))
    if max(rates.value.values()) < 1:
        found = found.where(F.col("h") < F.lit(max(rates.value.values()) * (1 << 20)))
    found = found.mapInArrow(common.releasing(distinct), "l int, g long").distinct()
    found = common.stored(found, common.scratch(spark, "language-grams"))
    each = found.groupBy("l").agg(F.count(F.lit(1)).alias("n")).agg(F.max("n")).first()[0] or 1
    bits = min(MOST_BITS, max(10, int(each * ROOM - 1).bit_length()))

    def slots(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            l, g = batch.column(0).to_numpy(), batch.column(1).to_numpy().view(np.uint64)
            mask = (np.uint64(1) << (l % 64).astype(np.uint64)).view(np.int64)
            for at in places(g, bits):
                yield pa.RecordBatch.from_arrays([pa.array((l // 64).astype(np.int32)), pa.array(at.astype(np.int32)), pa.array(mask)], names=["w", "at", "mask"])

    table = found.mapInArrow(slots, "w int, at int, mask long").groupBy("w", "at").agg(F.bit_or("mask").alias("mask")).toArrow()  # the filters
    words = np.zeros((-(-len(languages) // 64), 1 << bits), np.uint64)
    words[table["w"].to_numpy(), table["at"].to_numpy()] = table["mask"].to_numpy().view(np.uint64)
    full = np.array([np.count_nonzero(words[k // 64] & np.uint64(1 << k % 64)) / (1 << bits) for k in range(len(languages))])
    return Model(languages, bits, words, full**PLACES, max(range(len(languages)), key=lambda k: (counts[languages[k]], -k)))


def decide(model: Model, texts: list[str | None]) -> tuple[list[str], np.ndarray]:
    """For each text a language and a score from 0 to 1, its share of the corrected popcounts. Each text is decided on
    its own n-grams; ties go to the first language by name."""
    out, scores = ["und"] * len(texts), np.zeros(len(texts))
    own = [i for i, t in enumerate(texts) if model.languages and has_letter(t)]
    low = 0
    while low < len(own):
        high, size = low, 0
        while high < len(own) and (size < 1 << 20 or high == low):
            size += len(texts[own[high]])
            high += 1
        some = own[low:high]
        low = high
        g, starts = grams([texts[i] for i in some])
        there = g != _NONE
        n = np.add.reduceat(there.astype(np.int64), starts[:-1])
        hits = []
        for words in model.words:
            held = None
            for at in places(g, model.bits):
                held = words[at] if held is None else held & words[at]
            held[~there] = 0
            hits += [np.add.reduceat(((held >> np.uint64(k)) & np.uint64(1)).astype(np.int64), starts[:-1]) for k in range(min(64, len(model.languages) - len(hits)))]
        rate = model.false_positive[:, None]
        real = np.maximum(0.0, (np.stack(hits) - n * rate) / np.maximum(1 - rate, 1e-9))
        best, total = real.argmax(0), real.sum(0)
        for j, i in enumerate(some):
            k = best[j] if total[j] > 0 else model.fallback
            out[i] = model.languages[k]
            scores[i] = real[k, j] / total[j] if total[j] > 0 else 0.0
    return out, scores


def predict(df: DataFrame, model: Model, text: str = "text") -> DataFrame:
    """Add lang_pred and score; columns of ``df`` of these names give way to the new ones. Only the text is looked at,
    whole; the other columns stay out of Python.

    ``und`` with score 0 if the text is null or has no letter; the most frequent learned language with score 0 if
    it has letters but no known n-gram. Repeated rows get repeated results, an empty table an empty one. The model's
    size is bounded, so it is broadcast.
    """
    shared = df.sparkSession.sparkContext.broadcast(model)
    common.small_batches(df.sparkSession)

    @F.pandas_udf(T.StructType([T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType())]))
    def udf(parts: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        common.claim(__name__)
        for part in parts:
            langs, scores = decide(shared.value, [None if t is None else t for t in part.tolist()])
            yield pd.DataFrame({"lang_pred": langs, "score": scores})
        common.release()

    rows, own, back = common.apart(df, "lang_pred", "score", t=common.column(text))
    # nondeterministic for the optimizer only: a filter on the result would else be pushed below and run it twice
    out = rows.select(*own, udf.asNondeterministic()("t").alias("found"))
    return out.select(*back, F.col("found.lang_pred"), F.col("found.score"))


def fold(key: str = "doc_id") -> Column:
    """crc32 of the id as text, modulo 4; rows with 2 are held out."""
    return F.crc32(F.coalesce(F.col(key).cast("string"), F.lit("")).cast("binary")) % 4
