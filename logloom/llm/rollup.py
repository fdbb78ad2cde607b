"""Token counts: totals that are maintained by signed deltas.

A batch holds deltas of (source, lang, tokenizer): an insert adds a document and its tokens, a delete takes them
away, a revised count adds the difference. A commit adds the batch's sums to the totals and writes the new totals and
the names of all batches in them beside the old ones; one exclusive file then makes them the newest version. A batch
whose name the totals hold is left out, so a job that runs again changes nothing, and of two that commit at once the
second starts over from the totals of the first. Totals are read as they are; versions that have aged are deleted.
"""

from __future__ import annotations

import heapq
import json
import os
import uuid
from collections import Counter
from collections.abc import Iterator
from functools import lru_cache
from urllib.parse import unquote, urlparse

import pandas as pd
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import bpe, common

KEYS = ("source", "lang", "tokenizer")
SCHEMA = "source string, lang string, tokenizer string, n_docs long, n_tokens long"
#: Versions whose totals stay readable, the newest included.
KEPT = 4
#: Pre-tokens of more bytes, and texts with as many characters in a row of one kind (white space or not), do not pass
#: through the library, whose time or stack they could exhaust.
LONG = 512


def inserts(counts: DataFrame) -> DataFrame:
    """Deltas from rows of the keys and n_tokens (null: 0)."""
    return counts.select(*KEYS, F.lit(1).cast("long").alias("n_docs"), F.coalesce(F.col("n_tokens"), F.lit(0)).cast("long").alias("n_tokens"))


def deletes(counts: DataFrame) -> DataFrame:
    return inserts(counts).select(*KEYS, (-F.col("n_docs")).alias("n_docs"), (-F.col("n_tokens")).alias("n_tokens"))


def revisions(counts: DataFrame) -> DataFrame:
    """Deltas from rows of the keys, n_tokens and new_tokens."""
    change = F.coalesce(F.col("new_tokens"), F.lit(0)) - F.coalesce(F.col("n_tokens"), F.lit(0))
    return counts.select(*KEYS, F.lit(0).cast("long").alias("n_docs"), change.cast("long").alias("n_tokens"))


def summed(deltas: DataFrame) -> DataFrame:
    """Null keys are groups of their own. Sums combine before the shuffle, so hot keys are cheap."""
    return deltas.groupBy(*KEYS).agg(F.sum("n_docs").alias("n_docs"), F.sum("n_tokens").alias("n_tokens"))


class Rollup:
    """The totals in a folder of the cluster's shared file system."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder.rstrip("/")
        self._hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs.Path
        self._fs = self._path().getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())

    def _path(self, *names: str):
        return self._hadoop("/".join((self.folder, *names)))

    def _head(self) -> tuple[int, str | None]:
        """The newest version's number and folder; (0, None) before the first commit."""
        if not self._fs.exists(self._path("log")):
            return 0, None
        names = [s.getPath().getName() for s in self._fs.listStatus(self._path("log"))]
        newest = max((n for n in names if n.endswith(".json")), default=None)
        return (int(newest[:-5]), json.loads(common.Store(self.folder).get(f"log/{newest}"))["data"]) if newest else (0, None)

    def _publish(self, version: int, data: str) -> bool:
        """Make ``data`` that version; False if another commit was faster. The record is complete before it gets its
        name, and the name is taken by a step that fails where it exists: a hard link on a local file system, the
        renaming of a file elsewhere (which on HDFS never replaces a file)."""
        store, temporary, name = common.Store(self.folder), f"log/{uuid.uuid4().hex}.tmp", f"log/{version:012d}.json"
        with store.create(temporary) as out:
            out.write(json.dumps({"version": version, "data": data}).encode())
        if store.local:
            try:
                os.link(store.path(temporary), store.path(name))
                return True
            except FileExistsError:
                return False
            finally:
                os.unlink(store.path(temporary))
        done = not self._fs.exists(self._path(name)) and self._fs.rename(self._path(temporary), self._path(name))
        if not done:
            self._fs.delete(self._path(temporary), False)
        return done

    def _read(self, data: str | None, table: str, schema: str) -> DataFrame:
        return self.spark.read.schema(schema).parquet(f"{self.folder}/{data}/{table}") if data else self.spark.createDataFrame([], schema)

    def batches(self) -> DataFrame:
        """The names of the batches that the totals hold (column batch)."""
        return self._read(self._head()[1], "batches", "batch string")

    def commit(self, batch: str, deltas: DataFrame) -> bool:
        """Add a batch to the totals; False if they hold one of this name. Rows that repeat count as often as they
        stand; null keys are groups of their own; an empty batch commits its name."""
        own = f"{self.folder}/batch-{uuid.uuid4().hex}"
        sums = None
        try:
            while True:
                version, data = self._head()
                before = self._read(data, "batches", "batch string")
                if not before.where(F.col("batch") == batch).isEmpty():
                    return False
                sums = common.stored(summed(deltas), own) if sums is None else sums
                new = f"data-{uuid.uuid4().hex}"
                totals = summed(self._read(data, "totals", SCHEMA).union(sums)).where("n_docs <> 0 or n_tokens <> 0")
                totals.write.parquet(f"{self.folder}/{new}/totals")
                before.union(self.spark.createDataFrame([(batch,)], "batch string")).coalesce(1).write.parquet(f"{self.folder}/{new}/batches")
                if self._publish(version + 1, new):
                    self._forget(version + 1 - KEPT)
                    return True
                common.drop_path(self.spark, f"{self.folder}/{new}")
        finally:
            common.drop_path(self.spark, own)

    def _forget(self, version: int) -> None:
        """Delete what that version holds; its record stays, so that its number is never given again."""
        if version > 0:
            common.drop_path(self.spark, f"{self.folder}/" + json.loads(common.Store(self.folder).get(f"log/{version:012d}.json"))["data"])

    def totals(self) -> DataFrame:
        """The keys with n_docs and n_tokens; keys of which nothing is left are not there."""
        return self._read(self._head()[1], "totals", SCHEMA)


def merged(piece: bytes, ranks: dict[bytes, int], longest: int) -> int:
    """The count of tokens of one pre-token: the pair of least rank is merged, leftmost first, until none is left."""
    if piece in ranks:
        return 1
    n = len(piece)
    after, before, alive = list(range(1, n + 1)), list(range(-1, n)), bytearray(b"\1" * n)
    queue = [(ranks[p], i, i + 2) for i in range(n - 1) if (p := piece[i : i + 2]) in ranks]
    heapq.heapify(queue)
    count = n

    def offer(i: int) -> None:
        j = after[i]
        if j < n and (end := after[j]) - i <= longest and (rank := ranks.get(piece[i:end])) is not None:
            heapq.heappush(queue, (rank, i, end))

    while queue:
        _, i, end = heapq.heappop(queue)
        if not alive[i] or (j := after[i]) >= n or after[j] != end:  # an earlier merge took one of them
            continue
        alive[j], after[i], before[end] = 0, end, i
        count -= 1
        offer(i)
        if before[i] >= 0:
            offer(before[i])
    return count


_LONG_RUN = regex.compile(f"[{bpe._SPACE}]{{{LONG}}}|[^{bpe._SPACE}]{{{LONG}}}")


def has_long_run(text: str) -> bool:
    """Whether :data:`LONG` characters in a row are all white space or all not. Most texts are told by the lengths of their
    words alone; what these leave open (control characters that Python alone takes for white space, many blanks) is
    searched for."""
    if len(text) < LONG:
        return False
    words = text.split()
    letters = len("".join(words))
    if max(map(len, words), default=0) < LONG and len(text) - letters - len(words) < LONG - 2 and not any(c in text for c in "\x1c\x1d\x1e\x1f"):
        return False
    return _LONG_RUN.search(text) is not None


class Counting:
    """Counts the tokens of texts under a vocabulary of ranks. Texts go through the library, but for those with a very
    long run of white space or of other characters: these are cut into pre-tokens by the same pattern here, and
    long pre-tokens are merged here, with the same result."""

    def __init__(self, path: str, pattern: str):
        import base64

        import tiktoken

        if pattern != bpe.LIBRARY_PATTERN:
            raise ValueError("texts with long runs are cut by the pattern of byte-level vocabularies; this one is another")
        with open(path, "rb") as source:
            self.ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, source)}
        self.longest = max(map(len, self.ranks))
        self.own = tiktoken.Encoding(path, pat_str=pattern, mergeable_ranks=self.ranks, special_tokens={})
        self.pattern = regex.compile(bpe._PATTERN)

    def count(self, text: str, long: bool | None = None) -> int:
        """``long`` is what :func:`has_long_run` says, where it is known."""
        if not (has_long_run(text) if long is None else long):
            return len(self.own.encode_ordinary(text))
        found = Counter(m[0] for m in self.pattern.finditer(text))
        return sum(n * self._piece(word) for word, n in found.items())

    def _piece(self, word: str) -> int:
        data = word.encode("utf-8", "replace")
        return len(self.own.encode_ordinary(word)) if len(data) <= LONG else merged(data, self.ranks, self.longest)


@lru_cache(maxsize=4)
def _counting(path: str, pattern: str) -> Counting:
    return Counting(path, pattern)


def without_repeated_lines(text: str) -> str:
    return "\n".join(dict.fromkeys(text.split("\n")))


def token_counts(paths: dict[str, str], pattern: str, deduplicate: str | None = None):
    """A function of a text column: a struct of the counts of its tokens (null: 0) under each named vocabulary; with
    ``deduplicate``, also ``revised``, the count under that vocabulary without lines equal to an earlier one. Texts are
    counted whole, whatever they hold, each on its own."""
    kind = ", ".join(f"`{name}` long" for name in paths) + (", revised long" if deduplicate else "")

    @F.pandas_udf(kind)
    def udf(parts: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        common.claim(__name__, _counting.cache_clear)
        own = {name: _counting(path, pattern) for name, path in paths.items()}
        for part in parts:
            texts = [t or "" for t in part.tolist()]
            long = [has_long_run(t) for t in texts]
            out = pd.DataFrame({name: [e.count(t, x) for t, x in zip(texts, long, strict=True)] for name, e in own.items()}, dtype="int64")
            if deduplicate:
                shorter = [without_repeated_lines(t) for t in texts]
                out["revised"] = [n if len(s) == len(t) else own[deduplicate].count(s) for n, s, t in zip(out[deduplicate], shorter, texts, strict=True)]
            yield out
        common.release()

    return udf


def copies(docs: DataFrame, folder: str, key: str = "doc_id", digest: str = "digest") -> DataFrame:
    """The rows whose text an earlier document (smaller id) has. First holders are a table of their own, so that
    the join is between plain tables and a hot text can be split. Rows of one id and one text are alike: none is a
    copy of the other. Rows without a digest are no copies; rows without an id are copies of any row that has one, and
    stay where no row of their text has one."""
    rows, _, back = common.apart(docs, held=common.column(digest), id=common.column(key))
    firsts = rows.where("held is not null").groupBy("held").agg(F.min("id").alias("first"), F.count(F.lit(1)).alias("n")).where("n > 1 and first is not null")
    firsts = common.stored(firsts.select(F.col("held").alias("of"), "first"), f"{folder}/firsts")
    return rows.join(firsts, F.col("held") == F.col("of")).where(~F.col("id").eqNullSafe(F.col("first"))).select(*back)
