"""Removal of byte strings that repeat, within and across documents, by suffix arrays of shards.

A window is a string of :data:`LENGTH` bytes. Its anchor is the smallest hash of the :data:`GRAM`-byte strings in it,
so equal windows have equal anchors. Windows in a row with one anchor are a run; its context is the bytes they
cover. Only contexts whose anchor has other contexts can hold repeated windows that are not known yet, and only
these are sorted: shards of contexts, dealt by anchor, pass through external induced sorting
(:mod:`logloom.llm.induction`), and windows in one interval of the suffix array with common prefixes of
:data:`LENGTH` or more are equal, byte by byte. The first of them, by document id and start, stays.

Contexts that are equal as a whole need no sorting: all but the first are covered. These alone are told by hashes: 64 bits
of three polynomials of the context, and 64 of the anchor within it. That is decided within a task before the shuffle, so a
passage that very many documents share sends one row for each task, and then along the sorted rows of a partition. An
anchor with more than :data:`HOT` different contexts is dealt by window instead of by anchor, and equal windows of a task
send one row.
"""

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import common, hashing, induction

LENGTH, GRAM = 100, 48
#: Windows in a run at most (a power of two up to 64).
RUN = 64
#: Contexts of an anchor beyond which it is dealt by window; as many are held in memory until that is known.
HOT = 5_000
#: Text hashed at once, contexts sorted at once at about, windows of hot anchors that a task compares at once.
BLOCK, SHARD, WINDOWS = 1 << 19, 4 << 20, 50_000
#: Text whose runs are meant for one task, and runs that a task looks at at once.
PART, ROWS = 32 << 20, 1 << 18

_MARK, _ASK, _ASK_WINDOWS = 0, 1, 2


def _slide(h: np.ndarray, width: int, pick) -> np.ndarray:
    """pick (minimum or maximum) over each ``width`` values in a row, by doubling."""
    span, out = 1, h
    while span * 2 <= width:
        out = pick(out[:-span], out[span:])
        span *= 2
    return pick(out[: len(h) - width + 1], out[width - span : width - span + len(h) - width + 1])


def runs(texts: list[bytes], length: int = LENGTH, gram: int = GRAM) -> tuple[np.ndarray, ...]:
    """For each run of windows: anchor, context hash, number of the text, start, count of windows, and whether its
    anchor stands in it twice (so that windows of the run itself may be equal)."""
    own = [(k, t) for k, t in enumerate(texts) if len(t) >= length]
    if not own:
        none = np.zeros(0, np.int64)
        return none.astype(np.uint64), none.astype(np.uint64), none, none, none, none.astype(bool)
    a = np.frombuffer(b"".join(t for _, t in own), np.uint8)
    sizes = np.array([len(t) for _, t in own], np.int64)
    begins = np.concatenate(([0], np.cumsum(sizes)))
    n, width = len(a), length - gram + 1
    up, down = hashing.powers(n + 1)
    sums = np.concatenate(([np.uint64(0)], np.cumsum((a.astype(np.uint64) + np.uint64(1)) * up[:n])))
    h = hashing.mix((sums[gram:] - sums[:-gram]) * down[: n - gram + 1])
    least = _slide(h, width, np.minimum)  # by window start
    inside = np.ones(len(least), bool)
    for i in range(1, length):
        at = begins[1:-1] - i
        inside[at[at >= 0]] = False
    valid = np.flatnonzero(inside)
    new = np.ones(len(valid), bool)
    new[1:] = (least[valid[1:]] != least[valid[:-1]]) | (valid[1:] != valid[:-1] + 1)
    heads = np.flatnonzero(new)
    counts = np.diff(np.concatenate((heads, [len(valid)])))
    if (counts > RUN).any():
        pieces = -(-counts // RUN)
        heads = np.repeat(heads, pieces) + RUN * (np.arange(pieces.sum()) - np.repeat(np.cumsum(pieces) - pieces, pieces))
        counts = np.diff(np.concatenate((heads, [len(valid)])))
    start = valid[heads]
    end = start + counts - 1 + length
    anchor = least[start]
    context = hashing.mix((sums[end] - sums[start]) * down[start] + (end - start).astype(np.uint64))
    for prime in hashing.PRIMES:  # of other moduli, so that equal hashes are no matter of one polynomial's form
        context = hashing.mix(context ^ hashing.modular(a, start, end, prime))
    # grams that are the least of a window, and anchors that two of them near each other share
    most = np.full(len(h), 0, np.uint64)
    wide = np.concatenate((np.zeros(width - 1, np.uint64), least, np.zeros(width - 1, np.uint64)))
    most = _slide(wide, width, np.maximum)
    is_least = np.flatnonzero(h == most)
    by = np.argsort(h[is_least], kind="stable")
    value, place = h[is_least][by], is_least[by]
    twice = np.unique(value[1:][(value[1:] == value[:-1]) & (place[1:] - place[:-1] < width + RUN)])
    doc = np.searchsorted(begins, start, "right") - 1
    number = np.array([k for k, _ in own], np.int64)
    return anchor, context, number[doc], start - begins[doc], counts, np.isin(anchor, twice)


def _pack(start: np.ndarray, count: np.ndarray, twice: np.ndarray) -> np.ndarray:
    return start << 8 | twice.astype(np.int64) << 7 | (count - 1)


def _unpack(place: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    return place >> 8, (place & 63) + 1, (place >> 7 & 1).astype(bool)


_RUNS = pa.schema([("anchor", pa.int64()), ("context", pa.int64()), ("doc", pa.int64()), ("twin", pa.int64()), ("place", pa.int64()), ("kind", pa.int32())])
_RUNS_SQL = "anchor long, context long, doc long, twin long, place long, kind int"


def _in_order(place: np.ndarray, doc: np.ndarray, twin: np.ndarray, *groups: np.ndarray) -> np.ndarray:
    """The order by the last group first, then by id, twin and place."""
    return np.lexsort((place, twin, doc, *groups) if twin.any() else (place, doc, *groups))


def _table(schema: pa.Schema, *columns: np.ndarray) -> Iterator[pa.RecordBatch]:
    for low in range(0, len(columns[0]), 1 << 16):
        yield pa.RecordBatch.from_arrays([pa.array(c[low : low + (1 << 16)], f.type) for c, f in zip(columns, schema, strict=True)], schema=schema)


def _pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, int, int, bytes]]:
    """(id, twin, start, bytes) of texts, long ones in pieces; each window lies in one piece."""
    for doc, twin, text in common.rows_of(batches):
        for start in range(0, max(1, len(text) - LENGTH + 1), BLOCK):
            yield doc, twin, start, text[start : start + BLOCK + LENGTH - 1] if len(text) > BLOCK else text


def _find_runs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Runs of documents (id, twin, bytes). Of equal contexts in this task only the first is sent as a run; the others are
    sent as marks, dealt evenly."""

    def flush(held: list) -> Iterator[pa.RecordBatch]:
        anchor, context, doc, twin, place = (np.concatenate(c) for c in zip(*held, strict=True))
        order = _in_order(place, doc, twin, context, anchor)
        anchor, context, doc, twin, place = (c[order] for c in (anchor, context, doc, twin, place))
        again = np.zeros(len(anchor), bool)
        again[1:] = (anchor[1:] == anchor[:-1]) & (context[1:] == context[:-1])
        spread = hashing.mix(doc.view(np.uint64) * np.uint64(31) + place.view(np.uint64)).view(np.int64)
        yield from _table(_RUNS, np.where(again, spread, anchor.view(np.int64)), context.view(np.int64), doc, twin, place, np.where(again, _MARK, _ASK).astype(np.int32))

    held, size = [], 0
    for block in common.blocks_of(_pieces(batches), 3, BLOCK):
        anchor, context, number, start, count, twice = runs([r[3] for r in block])
        if len(anchor):
            doc, twin, offset = (np.array([r[k] for r in block], np.int64)[number] for k in (0, 1, 2))
            held.append((anchor, context, doc, twin, _pack(start + offset, count, twice)))
            size += len(anchor)
        if size > 500_000:
            yield from flush(held)
            held, size = [], 0
    if held:
        yield from flush(held)


def _chunks(batches: Iterator[pa.RecordBatch]) -> Iterator[list[np.ndarray]]:
    """The columns of about :data:`ROWS` rows at a time."""
    held, rows = [], 0
    for batch in batches:
        held.append([c.to_numpy() for c in batch.columns])
        rows += batch.num_rows
        if rows >= ROWS:
            yield [np.concatenate(c) for c in zip(*held, strict=True)]
            held, rows = [], 0
    if held:
        yield [np.concatenate(c) for c in zip(*held, strict=True)]


def _classify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Runs in order of anchor, context, id, twin and place: marks for later equal contexts; questions for the first of
    each context whose anchor has other contexts, or that may repeat itself. The rows of the last anchor are held until
    the next one is seen, or until it has more than :data:`HOT` contexts."""

    def settle(columns: list[np.ndarray], first: np.ndarray, hot: bool) -> Iterator[pa.RecordBatch]:
        """Rows of whole anchors (of a part of a hot one) of which ``first`` begin a context."""
        anchor, place = columns[0], columns[4]
        other = np.concatenate(([True], anchor[1:] != anchor[:-1]))
        group = np.cumsum(other) - 1
        contexts = np.bincount(group[first], minlength=group[-1] + 1)[group]
        many = contexts > HOT if not hot else np.ones(len(anchor), bool)
        kind = np.where(first, np.where(many, _ASK_WINDOWS, _ASK), _MARK).astype(np.int32)
        chosen = ~first | many | (contexts > 1) | _unpack(place)[2]
        yield from _table(_RUNS, *(c[chosen] for c in columns), kind[chosen])

    held: list[np.ndarray] | None = None  # rows of the last anchor, and which begin a context
    hot = last = None  # the anchor that is known to be hot; the anchor and context of the row before
    for *columns, kind in _chunks(batches):
        marked = kind == _MARK
        if marked.any():
            yield from _table(_RUNS, *(c[marked] for c in columns), kind[marked])
            columns = [c[~marked] for c in columns]
        anchor, context = columns[:2]
        if not len(anchor):
            continue
        first = np.ones(len(anchor), bool)
        first[1:] = (anchor[1:] != anchor[:-1]) | (context[1:] != context[:-1])
        first[0] = last != (anchor[0], context[0])
        last = anchor[-1], context[-1]
        if hot is not None:
            n = int(np.searchsorted(anchor != hot, True))  # rows of the hot anchor come first
            if n:
                yield from settle([c[:n] for c in columns], first[:n], True)
            if n == len(anchor):
                continue
            columns, first, hot = [c[n:] for c in columns], first[n:], None
        if held is not None:
            *columns, first = (np.concatenate(pair) for pair in zip(held, [*columns, first], strict=True))
        anchor = columns[0]
        edge = int(np.flatnonzero(anchor != anchor[-1])[-1]) + 1 if anchor[0] != anchor[-1] else 0
        if edge:
            yield from settle([c[:edge] for c in columns], first[:edge], False)
        held = [*(c[edge:] for c in columns), first[edge:]]
        if held[-1].sum() > HOT:
            yield from settle(held[:-1], held[-1], True)
            hot, held = anchor[-1], None
        else:  # of later equal contexts only marks are due, so a context that very many tasks have is not held
            later = ~held[-1]
            yield from _table(_RUNS, *(c[later] for c in held[:-1]), np.full(int(later.sum()), _MARK, np.int32))
            held = [c[~later] for c in held]
    if held is not None and len(held[0]):
        yield from settle(held[:-1], held[-1], False)


_CONTEXTS = pa.schema([("key", pa.int64()), ("doc", pa.int64()), ("twin", pa.int64()), ("start", pa.int64()), ("bytes", pa.binary())])


def zip_columns(batches: Iterator[pa.RecordBatch], *names: str) -> Iterator[tuple]:
    for batch in batches:
        yield from zip(*(batch.column(n).to_pylist() for n in names), strict=True)


def _cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Documents with their questions to contexts, dealt by anchor, or by window for hot anchors. Of equal windows of hot
    anchors in this task only the first is sent; the others are rows without bytes, which are marks."""

    def rows() -> Iterator[tuple]:
        windows: dict[bytes, tuple[int, int, int]] = {}
        for batch in batches:
            known = batch.column("known")
            ends = known.offsets.to_numpy()
            anchors, places, kinds = (known.values.field(k).to_numpy() for k in ("anchor", "place", "kind"))
            for k, (doc, twin) in enumerate(zip(batch.column("doc").to_pylist(), batch.column("twin").to_pylist(), strict=True)):
                own = np.arange(ends[k], ends[k + 1])
                own = own[kinds[own] != _MARK]
                if not len(own):
                    continue
                text = batch.column("bytes")[k].as_py()
                starts, counts, _ = _unpack(places[own])
                for anchor, start, count, kind in zip(anchors[own].tolist(), starts.tolist(), counts.tolist(), kinds[own].tolist(), strict=True):
                    if kind == _ASK:
                        yield anchor, doc, twin, start, text[start : start + count - 1 + LENGTH]
                        continue
                    for s in range(start, start + count):
                        window, at = text[s : s + LENGTH], (doc, twin, s)
                        if (there := windows.setdefault(window, at)) is not at:
                            windows[window] = min(there, at)
                            yield (doc * 31 + s) & _MOST, *max(there, at), None
                    if len(windows) > WINDOWS:
                        yield from sent(windows)
        yield from sent(windows)

    def sent(windows: dict) -> Iterator[tuple]:
        for window, at in windows.items():
            yield int.from_bytes(hashlib.blake2b(window, digest_size=8).digest(), "little", signed=True), *at, window
        windows.clear()

    yield from common.batches_of(rows(), _CONTEXTS)


_MOST = (1 << 63) - 1

_MARKS = pa.schema([("doc", pa.int64()), ("twin", pa.int64()), ("start", pa.int64()), ("count", pa.int64())])


def repeated(docs: list[int], twins: list[int], starts: list[int], parts: list[bytes], length: int = LENGTH) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(document, twin, start, count) of runs of windows in these contexts that also start earlier in one of them. No
    window stands in two of the contexts, so places in the joined contexts are in the order of documents and starts."""
    order = np.lexsort((starts, twins, docs))
    docs, twins, starts = (np.array(c, np.int64)[order] for c in (docs, twins, starts))
    text = induction.Text([parts[k] for k in order.tolist()], length)
    begins = text.begins
    gone = induction.room(text.n, bool)
    for at, shared in induction.suffixes(text):
        part = np.searchsorted(begins, at, "right") - 1
        whole = (part < len(docs)) & (at + length < np.append(begins, begins[-1])[part + 1])
        interval = np.cumsum(shared < length)[whole]
        at = at[whole]
        if not len(at):
            continue
        head = np.concatenate(([True], interval[1:] != interval[:-1]))
        heads = np.flatnonzero(head)
        gone[at] = True
        gone[np.minimum.reduceat(at, heads)] = False
    place = np.flatnonzero(gone)
    if not len(place):
        return tuple(np.zeros(0, np.int64) for _ in range(4))
    heads = np.flatnonzero(np.concatenate(([True], place[1:] != place[:-1] + 1)))
    counts = np.diff(np.concatenate((heads, [len(place)])))
    owner = np.searchsorted(begins, place[heads], "right") - 1
    return docs[owner], twins[owner], starts[owner] + place[heads] - begins[owner], counts


def _sort_shards(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sort the contexts of this partition, which come in order of their keys, in shards that no key is cut by."""
    docs, twins, starts, parts, size = [], [], [], [], 0
    for _, group in common.runs_by_key(batches, 1):
        if marks := [r[1:4] for r in group if r[4] is None]:
            yield from _table(_MARKS, *(np.array(c, np.int64) for c in zip(*marks, strict=True)), np.ones(len(marks), np.int64))
            group = [r for r in group if r[4] is not None]
        if len(group) == 1 and len(group[0][4]) == LENGTH:
            continue
        if size >= SHARD:
            yield from _table(_MARKS, *repeated(docs, twins, starts, parts))
            docs, twins, starts, parts, size = [], [], [], [], 0
        for _, doc, twin, start, data in group:
            docs.append(doc)
            twins.append(twin)
            starts.append(start)
            parts.append(data)
            size += len(data)
    if parts:
        yield from _table(_MARKS, *repeated(docs, twins, starts, parts))


def remove(df: DataFrame, key: str = "doc_id", text: str = "text", as_text: bool = False) -> DataFrame:
    """The rows of ``df`` without ``text`` and with n_bytes, n_removed, n_spans (maximal removed runs), kept (binary;
    with ``as_text`` a string, without the halves of characters at the cuts) and spans (start, end of each removed
    run). Columns of ``df`` of these names give way to the new ones.

    Removed is each byte that a window covers which also starts earlier: in a document of smaller id, or before it
    in the same document. What repeats is judged on the input. A null text is empty; a document of under
    :data:`LENGTH` bytes loses nothing. Rows that agree in id and text are one document: each of them loses what that
    document loses. Different texts of one id are documents that follow each other by their digests (twins). A null
    id counts as id -2^63.

    The documents are shuffled once by id, and what is known of them once; the joins below read those exchanges again.
    """
    spark = df.sparkSession
    made = ("n_bytes", "n_removed", "n_spans", "kept", "spans")
    common.small_batches(df.sparkSession)
    rest = common.others(df, text, *made)
    docs = df.select(F.coalesce(common.column(key).cast("long"), F.lit(-(1 << 63))).alias("doc"), F.coalesce(common.column(text), F.lit("")).cast("binary").alias("bytes"), *(common.column(c).alias(f"r{k}") for k, c in enumerate(rest)))
    size = docs.agg(F.sum(F.octet_length("bytes").cast("long"))).first()[0] or 0
    again = common.stored(docs.groupBy("doc").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("doc", F.lit(True).alias("again")), common.scratch(spark, "repeated-ids"))
    if again.isEmpty():
        by, docs = ["doc"], docs.withColumn("twin", F.lit(0).cast("long"))
        own = docs.select("doc", "twin", "bytes")
    else:
        digest = F.conv(F.left(F.sha2("bytes", 256), F.lit(15)), 16, 10).cast("long")
        by, docs = ["doc", "twin"], docs.join(again, "doc", "left").withColumn("twin", F.when(F.col("again"), digest).otherwise(F.lit(0).cast("long")))
        rows = docs.select("doc", "twin", "bytes", "again")
        own = rows.where("again is null").union(rows.where("again").dropDuplicates(by)).drop("again")
        docs = docs.drop("again")
    partitions = max(common.partitions(spark), size // PART)
    found = own.mapInArrow(common.releasing(_find_runs), _RUNS_SQL)
    known = found.repartition(partitions, "anchor").sortWithinPartitions("anchor", "context", "doc", "twin", "place")
    known = known.mapInArrow(common.releasing(_classify), _RUNS_SQL)
    known = known.groupBy(*by).agg(F.collect_list(F.struct("anchor", "place", "kind")).alias("known"))  # bounded by the document
    texts = docs if by == ["doc"] else own  # the same exchange where ids are distinct
    contexts = texts.join(known, by).mapInArrow(common.releasing(_cut), "key long, doc long, twin long, start long, bytes binary")
    shards = contexts.repartition(max(1, partitions // 2), "key").sortWithinPartitions("key")
    marks = shards.mapInArrow(common.releasing(_sort_shards), "doc long, twin long, start long, count long")
    spans = marks.groupBy(*by).agg(F.collect_list(F.struct("start", "count")).alias("marks"))

    def finish(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        span = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))
        names = [*(f"r{k}" for k in range(len(rest))), *made]
        for whole in batches:
            for low in range(0, whole.num_rows, 512):
                batch = whole.slice(low, 512)
                rows = [_without(*r) for r in zip(batch.column("bytes").to_pylist(), _lists(batch.column("known"), "place", "kind"), _lists(batch.column("marks"), "start", "count"), strict=True)]
                if as_text:
                    rows = [(*r[:3], r[3].decode("utf-8", "ignore"), r[4]) for r in rows]
                columns = [pa.array([r[k] for r in rows], kind) for k, kind in enumerate((pa.int64(), pa.int64(), pa.int64(), pa.string() if as_text else pa.binary(), span))]
                yield pa.RecordBatch.from_arrays([*(batch.column(n) for n in names[: len(rest)]), *columns], names=names)

    kinds = {f.name: f.dataType for f in docs.schema}
    schema = T.StructType([T.StructField(f"r{k}", kinds[f"r{k}"]) for k in range(len(rest))])
    for name, kind in zip(made, (*(T.LongType() for _ in range(3)), T.StringType() if as_text else T.BinaryType(), T.ArrayType(T.StructType().add("start", "long").add("end", "long"))), strict=True):
        schema = schema.add(name, kind)
    joined = docs.join(known, by, "left").join(spans, by, "left").mapInArrow(common.releasing(finish), schema)
    return joined.select(*(F.col(f"r{k}").alias(c) for k, c in enumerate(rest)), *made)


def _spans(start: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The maximal runs that these spans cover."""
    if not len(start):
        return start, end
    order = np.argsort(start, kind="stable")
    start, reach = start[order], np.maximum.accumulate(end[order])
    new = np.concatenate(([True], start[1:] > reach[:-1]))
    heads = np.flatnonzero(new)
    return start[heads], reach[np.concatenate((heads[1:] - 1, [len(start) - 1]))]


def _without(data: bytes, known: tuple[np.ndarray, np.ndarray], marks: tuple[np.ndarray, np.ndarray]) -> tuple[int, int, int, bytes, list[dict]]:
    """A document's figures, what is left of it and its removed runs, from (places, kinds) of its runs and (starts,
    counts) of its windows that repeat."""
    first, count, _ = _unpack(known[0][known[1] == _MARK])
    start, count = np.concatenate((first, marks[0])), np.concatenate((count, marks[1]))
    start, end = _spans(start, start + count - 1 + LENGTH)
    kept, at, removed = [], 0, list(zip(start.tolist(), end.tolist(), strict=True))
    for s, e in removed:
        kept.append(data[at:s])
        at = e
    kept.append(data[at:])
    return len(data), sum(e - s for s, e in removed), len(removed), b"".join(kept), [{"start": s, "end": e} for s, e in removed]


def _lists(column: pa.ListArray, *names: str) -> list[tuple[np.ndarray, ...]]:
    """The named fields of each row's list of structs; empty for a null."""
    ends, fields = column.offsets.to_numpy(), [column.values.field(n).to_numpy() for n in names]
    there = column.is_valid().to_pylist()
    return [tuple(f[ends[k] : ends[k + 1]] if ok else f[:0] for f in fields) for k, ok in enumerate(there)]


def clean(df: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """The rows of ``df``, with all of its columns, and the repeated bytes taken out of ``text``; halves of characters at
    the cuts go too. A null text becomes empty; see :func:`remove` for repeated rows, null ids and ties."""
    rows, own, _ = common.apart(df, text, k=common.column(key), t=common.column(text))
    found = remove(rows, "k", "t", as_text=True)
    columns = dict(zip(common.others(df, text), own, strict=True))
    return found.select(*(F.col(columns.get(c, "kept")).alias(c) for c in df.columns))
