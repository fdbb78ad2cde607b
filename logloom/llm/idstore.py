"""Token-id files: each document's ids are a zstandard frame of their own, under one shared dictionary.

A folder holds ``dictionary-<sha256>.zdict``, a file for each range of document ids and ``MANIFEST.json``, which is
written last: a folder without it is not complete. A file is its frames, an index (id, whether the id is null,
offset, count) and a footer that names the dictionary, so a short document is read with one small read.
Ids are kept as unsigned 16- or 32-bit little-endian integers, whichever the vocabulary needs.
"""

from __future__ import annotations

import hashlib
import json
import os
import re
import struct
import uuid
import zlib
from collections.abc import Iterator
from functools import lru_cache
from itertools import chain, filterfalse

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common

MAGIC = b"LOOMIDS1"
INDEX = np.dtype([("id", "<i8"), ("null", "u1"), ("at", "<u8"), ("n", "<u4")])
#: Text aimed at in a file; documents that the dictionary is trained on; its size; the compression level.
SHARD_BYTES, SAMPLE_DOCUMENTS, DICTIONARY_BYTES, LEVEL = 256 << 20, 600, 64 << 10, 3
#: Ids of a document in the training sample at most: of a longer one, a stretch that its hash picks.
SAMPLE_IDS = 1 << 14
#: Words that a worker remembers in each of two generations, and the most bytes of one that it does.
REMEMBERED, MOST_BYTES = 900_000, 64


#: Letters with marks that compose only in lower case; the tokenizer composes first, so these stay two characters.
ONLY_LOWER = ("H\u0331", "T\u0308", "W\u030a", "Y\u030a", "J\u030c")

#: Lower-case words of ASCII letters and of the letters U+00DF to U+00FF, in UTF-8.
_WORD = re.compile(rb"(?:[a-z]|\xc3[\x9f-\xb6\xb8-\xbf])+")


class Encoder:
    """Whole texts to ids with the tokenizers library, each distinct word once.

    Holds for tokenizers that fold case, drop white space and mark the end of each pre-token, so that a text's ids
    are the ids of its chunks between ASCII white space, in a row; what it was made with is checked. Words that are
    all letters are given to the library joined by spaces, and the marks tell their ids apart. A word with one full
    stop or comma after it is the word's ids and the mark's. Texts in which a special token may stand are encoded whole.
    """

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer, normalizers, pre_tokenizers

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        # the same model for words that are folded and split already
        self.bare = Tokenizer.from_file(path)
        self.bare.normalizer = normalizers.Sequence([])
        self.bare.pre_tokenizer = pre_tokenizers.Sequence([pre_tokenizers.WhitespaceSplit(), pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)])
        self.kind = np.dtype("<u2" if self.tokenizer.get_vocab_size() <= 1 << 16 else "<u4")
        with open(path, encoding="utf-8") as source:
            file = json.load(source)
        suffix = file["model"].get("end_of_word_suffix") or ""
        kinds = {x.get("type") for x in (file.get("normalizer") or {}).get("normalizers", [])}
        if not suffix or "Lowercase" not in kinds:
            raise ValueError("this tokenizer does not mark the ends of words or does not fold case")
        self.ends = np.zeros(self.tokenizer.get_vocab_size(), bool)
        self.ends[[i for token, i in file["model"]["vocab"].items() if token.endswith(suffix)]] = True
        self.starts = tuple({t["content"][:2].encode() for t in file["added_tokens"]})
        self.known: dict[bytes, bytes] = {}
        self.before: dict[bytes, bytes] = {}
        self.long: list[bytes] = []
        for probe in ("a b", "It 's a  <|endoftext|> b\tc\nd", " x ́y  1 2 '", "..  ..\r\n!", "ÉÉ, été. don't œuvre", *ONLY_LOWER):
            if np.frombuffer(self.encode([probe])[0], self.kind).tolist() != self.tokenizer.encode(probe, add_special_tokens=False).ids:
                raise ValueError("this tokenizer's tokens reach across white space")

    def _whole(self, text: str) -> bytes:
        return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, self.kind).tobytes()

    def _learn(self, new: set[bytes]) -> None:
        known, before = self.known, self.before
        letters, marked, other = set(), [], []
        for chunk in new:
            if len(chunk) > MOST_BYTES:
                self.long.append(chunk)
            if chunk in before:
                known[chunk] = before[chunk]
            elif _WORD.fullmatch(chunk):
                letters.add(chunk)
            elif chunk[-1:] in (b".", b",") and _WORD.fullmatch(chunk, 0, len(chunk) - 1):
                marked.append(chunk)
                if chunk[:-1] not in known:
                    letters.add(chunk[:-1])
            else:
                other.append(chunk)
        words = list(letters)
        for low in range(0, len(words), 4096):
            part = words[low : low + 4096]
            joined = [b" ".join(part[k : k + 64]).decode() for k in range(0, len(part), 64)]
            flat = np.fromiter(chain.from_iterable(e.ids for e in self.bare.encode_batch_fast(joined, add_special_tokens=False)), self.kind)
            cuts = (np.flatnonzero(self.ends[flat]) + 1) * self.kind.itemsize
            if len(cuts) != len(part):
                raise ValueError("this tokenizer splits words of letters")
            data, at = flat.tobytes(), 0
            for word, end in zip(part, cuts.tolist(), strict=True):
                known[word] = data[at:end]
                at = end
        for chunk, found in zip(other, self.tokenizer.encode_batch_fast([c.decode() for c in other], add_special_tokens=False), strict=True):
            known[chunk] = np.array(found.ids, self.kind).tobytes()
        for mark in (b".", b","):
            if marked and mark not in known:
                known[mark] = self._whole(mark.decode())
        for chunk in marked:
            known[chunk] = known[chunk[:-1]] + known[chunk[-1:]]

    def encode(self, texts: list[str | bytes]) -> list[bytes]:
        """The ids of each text (or its UTF-8) in :attr:`kind`."""
        whole: dict[int, bytes] = {}
        chunks = []
        for k, t in enumerate(texts):
            data = t.encode("utf-8", "replace") if isinstance(t, str) else t
            if any(s in data for s in self.starts):
                whole[k], data = self._whole(data.decode("utf-8", "replace")), b""
            if b"\xcc" in data or b"\xcd" in data:  # U+0300 to U+037F may compose with the letter before it, before case is folded
                chunks.append([c.lower() if c.isascii() else c for c in data.split()])
            else:
                chunks.append(data.lower().split())  # of bytes: ASCII letters, ASCII white space
        if len(self.known) > REMEMBERED:
            self.before, self.known = self.known, {}
        self._learn(set(filterfalse(self.known.__contains__, chain.from_iterable(chunks))))
        find = self.known.__getitem__
        out = [whole[k] if k in whole else b"".join(map(find, part)) for k, part in enumerate(chunks)]
        for chunk in self.long:  # what is remembered is bounded in bytes
            self.known.pop(chunk, None)
        self.long.clear()
        return out


@lru_cache(maxsize=2)
def encoder(path: str) -> Encoder:
    return Encoder(path)


def train(docs: DataFrame, text: str, key: str, path: str, end_id: int) -> bytes:
    """A dictionary from the id arrays of a bounded sample of documents; empty if there are too few to train on.

    The sample are the documents whose hashes of id and text are least, long ones too (equal rows count once), so it
    depends on the rows alone. Their texts are encoded where they are; at most :data:`SAMPLE_IDS` ids of each reach the
    driver.
    """
    common.small_batches(docs.sparkSession)
    # ids alone are read to find the bound: texts of one id are told apart only among the chosen
    number = F.xxhash64(F.coalesce(F.col(key).cast("string"), F.lit("")))

    def first(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = np.zeros(0, np.int64)
        for batch in batches:
            held = np.unique(np.concatenate((held, batch.column(0).to_numpy())))[:SAMPLE_DOCUMENTS]
        yield pa.RecordBatch.from_arrays([pa.array(held)], names=["h"])

    least = [r[0] for r in docs.select(number.alias("h")).mapInArrow(first, "h long").distinct().orderBy("h").limit(SAMPLE_DOCUMENTS).collect()]
    if not least:
        return b""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = encoder(path)
        end = np.array([end_id], own.kind).tobytes()

        def rows() -> Iterator[tuple]:
            for block in common.blocks_of(common.rows_of(batches), 1):
                for (h, t), ids in zip(block, own.encode([r[1] for r in block]), strict=True):
                    ids, most = ids + end, SAMPLE_IDS * own.kind.itemsize
                    at = h % (len(ids) // own.kind.itemsize - SAMPLE_IDS + 1) * own.kind.itemsize if len(ids) > most else 0
                    yield zlib.crc32(t), ids[at : at + most]

        yield from common.batches_of(rows(), pa.schema([("order", pa.int64()), ("ids", pa.binary())]))

    chosen = docs.select(number.alias("h"), F.col(text).cast("binary").alias("t")).where(F.col("h") <= F.lit(least[-1]))
    found = chosen.mapInArrow(common.releasing(cut), "order long, ids binary").distinct().orderBy("order", "ids").limit(SAMPLE_DOCUMENTS).collect()
    try:
        return zstandard.train_dictionary(DICTIONARY_BYTES, [bytes(r["ids"]) for r in found]).as_bytes()
    except zstandard.ZstdError:
        return b""


def _zdict(data: bytes):
    return zstandard.ZstdCompressionDict(data) if data else None


def write(docs: DataFrame, folder: str, path: str, end_id: int, text: str = "text", key: str = "doc_id", shard_bytes: int = SHARD_BYTES) -> list[dict]:
    """Encode the texts (null: empty) and write them in ascending order of ``key`` (nulls last, ties by text).

    Repeated rows are written as often as they stand, side by side. Texts are encoded whole, however long. Other columns
    are not looked at, so their names may be any; an empty table gives an empty manifest. Returns the manifest: a row for each file in order, with the count of ids in all files before it. Files get
    their names when complete; a task that runs again writes the same bytes.
    """
    spark = docs.sparkSession
    docs = docs.select(common.column(key).cast("long").alias("id"), F.coalesce(common.column(text), F.lit("")).alias("t"))
    dictionary = train(docs, "t", "id", path, end_id)
    sha = hashlib.sha256(dictionary).hexdigest()
    common.Store(folder).put(f"dictionary-{sha}.zdict", dictionary)
    shard, shards = common.id_ranges(docs, "id", F.octet_length("t").cast("long"), shard_bytes)
    dealt = common.dealt(docs.select(shard.alias("shard"), "id", F.col("t").cast("binary").alias("t")), shards).sortWithinPartitions("shard", F.asc_nulls_last("id"), "t")
    shared = spark.sparkContext.broadcast(dictionary)
    schema = pa.schema([("shard", pa.int64()), ("file", pa.string()), ("docs", pa.int64()), ("ids", pa.int64()), ("bytes", pa.int64())])

    def files(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
        common.claim(__name__, encoder.cache_clear)
        own, store, prepared = encoder(path), common.Store(folder), _zdict(shared.value)
        if prepared:
            prepared.precompute_compress(level=LEVEL)  # else each document pays for it
        pack = zstandard.ZstdCompressor(level=LEVEL, dict_data=prepared)
        end = np.array([end_id], own.kind).tobytes()
        out, shard, index, at = None, None, [], 0

        def close() -> tuple:
            rows = np.array(index, INDEX)
            out.write(rows.tobytes())
            foot = json.dumps({"dictionary": sha, "id_bytes": own.kind.itemsize, "docs": len(rows), "index_at": at}).encode()
            out.write(foot + struct.pack("<I", len(foot)) + MAGIC)
            out.close()
            name = f"ids-{shard:08d}.loom"
            store.commit(temporary, name)
            return shard, name, len(rows), int(rows["n"].sum()), at

        for block in common.blocks_of(common.rows_of(batches), 2, 4 << 20):
            for (number, doc, _), ids in zip(block, own.encode([r[2] for r in block]), strict=True):
                if number != shard:
                    if out:
                        yield close()
                    shard, index, at, temporary = number, [], 0, f"tmp/{uuid.uuid4().hex}"
                    out = store.create(temporary)
                frame = pack.compress(ids + end)
                out.write(frame)
                index.append((doc or 0, doc is None, at, len(ids) // own.kind.itemsize + 1))
                at += len(frame)
        if out:
            yield close()

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from common.batches_of(files(batches), schema)

    listed = common.stored(dealt.mapInArrow(common.releasing(work), "shard long, file string, docs long, ids long, bytes long"), f"{folder}/listed")
    manifest, start = [], 0
    for row in sorted(listed.collect()):
        manifest.append(row.asDict() | {"start": start})
        start += row["ids"]
    common.Store(folder).put("MANIFEST.json", json.dumps({"dictionary": sha, "files": manifest}).encode())
    return manifest


def open_file(store: common.Store, name: str):
    """An open file, its footer and its index."""
    source = store.open(name)
    source.seek(0, 2)
    size = source.tell()
    source.seek(size - 12)
    (length,), magic = struct.unpack("<I", source.read(4)), source.read(8)
    if magic != MAGIC:
        raise ValueError(f"{name} is not a file of token ids")
    source.seek(size - 12 - length)
    foot = json.loads(source.read(length))
    source.seek(foot["index_at"])
    return source, foot, np.frombuffer(source.read(foot["docs"] * INDEX.itemsize), INDEX)


def lookup(folder: str, file: str, number: int) -> np.ndarray:
    """The ids of one document of a file, by two small reads and one frame."""
    store = common.Store(folder)
    source, foot, index = open_file(store, file)
    with source:
        end = int(index["at"][number + 1]) if number + 1 < len(index) else foot["index_at"]
        source.seek(int(index["at"][number]))
        frame = source.read(end - int(index["at"][number]))
    unpack = zstandard.ZstdDecompressor(dict_data=_zdict(store.get(f"dictionary-{foot['dictionary']}.zdict")))
    return np.frombuffer(unpack.decompress(frame), f"<u{foot['id_bytes']}").astype("<u4")


def read(spark: SparkSession, folder: str, with_ids: bool = True) -> DataFrame:
    """doc_id, start (ids of all documents before it), n_tokens, ids_crc32 and ids (little-endian 32-bit), in each
    file in order. Frames are read one at a time. ``with_ids=False`` leaves the last column out: a column that a
    later select drops would still be sent from the Python worker."""
    manifest = json.loads(common.Store(folder).get("MANIFEST.json"))
    kinds = {"doc_id": ("long", pa.int64()), "start": ("long", pa.int64()), "n_tokens": ("long", pa.int64()), "ids_crc32": ("long", pa.int64())}
    if with_ids:
        kinds["ids"] = ("binary", pa.binary())
    schema = pa.schema([(name, kind) for name, (_, kind) in kinds.items()])
    in_sql = ", ".join(f"{name} {kind}" for name, (kind, _) in kinds.items())
    names = [(f["file"], f["start"]) for f in manifest["files"]]
    if not names:
        return spark.createDataFrame([], in_sql)

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
        store = common.Store(folder)
        unpack = zstandard.ZstdDecompressor(dict_data=_zdict(store.get(f"dictionary-{manifest['dictionary']}.zdict")))
        for name, start in common.rows_of(batches):
            source, foot, index = open_file(store, name)
            if foot["dictionary"] != manifest["dictionary"]:
                raise ValueError(f"{name} was written with another dictionary")
            with source:
                ends = [*index["at"][1:].tolist(), foot["index_at"]]
                source.seek(0)
                for (doc, null, at, n), end in zip(index.tolist(), ends, strict=True):
                    ids = np.frombuffer(unpack.decompress(source.read(end - at)), f"<u{foot['id_bytes']}").astype("<u4").tobytes()
                    row = None if null else doc, start, n, zlib.crc32(ids)
                    yield (*row, ids) if with_ids else row
                    start += n

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from common.batches_of(rows(batches), schema)

    files = spark.createDataFrame(names, "file string, start long").repartition(min(len(names), common.partitions(spark)))
    return files.mapInArrow(common.releasing(work), in_sql)
