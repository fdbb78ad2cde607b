"""A deterministic sharded WARC writer, and a reader.

Records are dealt by ranges of page ids and sorted within each; a shard rolls to its next file when the compressed
size passes a bound. Headers and digests are made anew from the payload. Files are written under temporary names
and renamed when complete; ``MANIFEST.json`` comes last and commits the archive. Bytes depend on the rows alone, so
a task that runs again, after an executor was lost, writes the same file.
"""

from __future__ import annotations

import hashlib
import json
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common

#: Payload aimed at in a shard, compressed bytes at which a file rolls, and the compression level.
SHARD_BYTES, ROLL_BYTES, LEVEL = 128 << 20, 64 << 20, 6
#: Payloads shorter than this are always written out.
LEAST_REVISIT = 100
#: The date in every record; a parameter, since the bytes must not depend on the clock.
DATE = "2024-01-01T00:00:00Z"
_SPACE = uuid.uuid5(uuid.NAMESPACE_URL, "loom:page")
_REVISIT = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"


def _name(page) -> str:
    return f"<urn:uuid:{uuid.uuid5(_SPACE, str(page))}>"


def record(page, url: str | None, payload: bytes, refers_to=None, date: str = DATE) -> bytes:
    """One record. A revisit keeps the HTTP header, with the payload's length, and leaves out the payload."""
    http = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % len(payload)
    block = http if refers_to is not None else http + payload
    head = [
        "WARC/1.1",
        f"WARC-Type: {'response' if refers_to is None else 'revisit'}",
        f"WARC-Record-ID: {_name(page)}",
        f"WARC-Date: {date}",
        f"WARC-Target-URI: {' '.join((url or '').split()) or 'about:blank'}",
        f"WARC-Payload-Digest: sha256:{hashlib.sha256(payload).hexdigest()}",
        f"WARC-Block-Digest: sha256:{hashlib.sha256(block).hexdigest()}",
        "Content-Type: application/http; msgtype=response",
        f"Content-Length: {len(block)}",
    ]
    if page is not None:
        head.append(f"Loom-Page-ID: {page}")
    if refers_to is not None:
        head += [f"WARC-Profile: {_REVISIT}", f"WARC-Refers-To: {_name(refers_to)}", f"Loom-Refers-To-Page-ID: {refers_to}"]
    return "\r\n".join(head).encode("utf-8", "replace") + b"\r\n\r\n" + block + b"\r\n\r\n"


def info(name: str, date: str = DATE) -> bytes:
    block = b"software: loom\r\nformat: WARC File Format 1.1\r\n"
    head = f"WARC/1.1\r\nWARC-Type: warcinfo\r\nWARC-Record-ID: <urn:uuid:{uuid.uuid5(_SPACE, name)}>\r\nWARC-Date: {date}\r\nWARC-Filename: {name}\r\nContent-Type: application/warc-fields\r\nContent-Length: {len(block)}\r\n\r\n"
    return head.encode() + block + b"\r\n\r\n"


def member(data: bytes) -> bytes:
    """A gzip member of its own, with no time in its header."""
    pack = zlib.compressobj(LEVEL, zlib.DEFLATED, 31)
    return pack.compress(data) + pack.flush()


def revisits(pages: DataFrame, folder: str) -> tuple[DataFrame, DataFrame]:
    """(id, size of the payload) of all pages and (id, digest, refers_to) of those whose payload an earlier page has.

    Only ids and digests move. First holders are found by an aggregation that combines before its shuffle and are
    written as a table, so the join back is between plain tables and a hot digest can be split.
    """
    sums = pages.select("id", F.octet_length("html").cast("long").alias("size"), F.sha2("html", 256).alias("digest"))
    sums = common.stored(sums, f"{folder}/digests")
    firsts = sums.where(F.col("size") >= LEAST_REVISIT).groupBy("digest").agg(F.min("id").alias("refers_to"), F.count(F.lit(1)).alias("n")).where("n > 1 and refers_to is not null")
    firsts = common.stored(firsts.drop("n"), f"{folder}/firsts")
    again = sums.where(F.col("size") >= LEAST_REVISIT).join(firsts, "digest").where("not (id <=> refers_to)").select("id", "digest", "refers_to")
    return sums, again


def write(pages: DataFrame, folder: str, shard_bytes: int = SHARD_BYTES, roll_bytes: int = ROLL_BYTES, date: str = DATE) -> list[dict]:
    """Write pages (page_id, url, html; null html: empty) and return the manifest, a row for each file in order.

    Of pages with equal payloads of at least :data:`LEAST_REVISIT` bytes, that with the smallest id is a response
    and the others revisit it. Pages of one id and one payload are alike. A null id comes last and is never
    referred to. Pages without rows in the table: no files, an empty manifest. Long payloads are written whole; a record
    holds one, so memory follows the longest. Other columns are not looked at. Payloads are shuffled once: what a page refers to travels to its shard as a row that sorts before it
    (with the digest in place of the payload, as rows may share an id).
    """
    spark = pages.sparkSession
    pages = pages.select(F.col("page_id").cast("long").alias("id"), "url", F.coalesce("html", F.lit("")).alias("html"))
    sums, again = revisits(pages, folder)
    shard, shards = common.id_ranges(sums, "id", F.col("size"), shard_bytes)
    rows = pages.select(shard.alias("shard"), "id", F.lit(1).alias("kind"), "url", "html", F.lit(None).cast("long").alias("refers_to"))
    links = again.select(shard.alias("shard"), "id", F.lit(0).alias("kind"), F.lit(None).cast("string").alias("url"), F.col("digest").alias("html"), "refers_to")
    dealt = common.dealt(rows.union(links), shards).sortWithinPartitions("shard", F.asc_nulls_last("id"), "kind", "html", "url")
    schema = pa.schema([("shard", pa.int64()), ("roll", pa.int64()), ("file", pa.string()), ("records", pa.int64()), ("bytes", pa.int64()), ("sha256", pa.string())])

    def files(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
        store = common.Store(folder)
        shard, out, linked, links = None, None, None, {}

        def close() -> tuple:
            out.close()
            store.commit(temporary, name)
            return shard, roll, name, records, size, digest.hexdigest()

        for number, page, kind, url, html, refers_to in common.rows_of(batches):
            if out and (number != shard or size >= roll_bytes):
                yield close()
                roll, out = roll + 1, None
            if number != shard:
                shard, roll = number, 0
            if not kind:
                if page != linked:
                    linked, links = page, {}
                links[html] = refers_to
                continue
            if out is None:
                name, temporary = f"loom-{shard:08d}-{roll:04d}.warc.gz", f"tmp/{uuid.uuid4().hex}"
                out, size, records, digest = store.create(temporary), 0, 0, hashlib.sha256()
                data = member(info(name, date))
                out.write(data)
                digest.update(data)
                size += len(data)
            payload = html.encode("utf-8", "replace")
            refers = links.get(hashlib.sha256(payload).hexdigest()) if page == linked else None
            data = member(record(page, url, payload, refers, date))
            out.write(data)
            digest.update(data)
            size, records = size + len(data), records + 1
        if out:
            yield close()

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from common.batches_of(files(batches), schema)

    listed = common.stored(dealt.mapInArrow(common.releasing(work), "shard long, roll long, file string, records long, bytes long, sha256 string"), f"{folder}/listed")
    manifest = [row.asDict() for row in sorted(listed.collect())]
    common.Store(folder).put("MANIFEST.json", json.dumps(manifest).encode())
    return manifest


def members(source, size: int = 1 << 20) -> Iterator[bytes]:
    """The records of an archive, one gzip member at a time."""
    held = b""
    unpack, parts = zlib.decompressobj(31), []
    while data := held or source.read(size):
        held = b""
        parts.append(unpack.decompress(data))
        if unpack.eof:
            yield b"".join(parts)
            held, unpack, parts = unpack.unused_data, zlib.decompressobj(31), []
    if any(parts):
        raise ValueError("the archive ends within a record")


def parse(data: bytes) -> tuple[dict[str, str], bytes]:
    head, _, rest = data.partition(b"\r\n\r\n")
    fields = dict(line.split(": ", 1) for line in head.decode("utf-8").split("\r\n")[1:])
    return fields, rest[: int(fields["Content-Length"])]


def read(spark: SparkSession, folder: str, payloads: bool = False) -> DataFrame:
    """page_id, url, payload_bytes, payload_digest, record_type, refers_to (and payload, null for revisits).

    The digests of blocks and of payloads that are there are computed and must equal the headers'.
    """
    manifest = json.loads(common.Store(folder).get("MANIFEST.json"))
    fields = [("page_id", pa.int64()), ("url", pa.string()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()), ("record_type", pa.string()), ("refers_to", pa.int64())]
    kind = "page_id long, url string, payload_bytes long, payload_digest string, record_type string, refers_to long"
    if payloads:
        fields.append(("payload", pa.binary()))
        kind += ", payload binary"
    if not manifest:
        return spark.createDataFrame([], kind)

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
        store = common.Store(folder)
        for (name,) in common.rows_of(batches):
            with store.open(name) as source:
                for data in members(source):
                    head, block = parse(data)
                    if head["WARC-Type"] == "warcinfo":
                        continue
                    if head["WARC-Block-Digest"] != f"sha256:{hashlib.sha256(block).hexdigest()}":
                        raise ValueError(f"{name}: a block differs from its digest")
                    http, _, payload = block.partition(b"\r\n\r\n")
                    size = int(http.rpartition(b"Content-Length: ")[2])
                    response, digest = head["WARC-Type"] == "response", head["WARC-Payload-Digest"].partition(":")[2]
                    if response and (len(payload), hashlib.sha256(payload).hexdigest()) != (size, digest):
                        raise ValueError(f"{name}: a payload differs from its digest")
                    number = lambda k: int(head[k]) if k in head else None
                    found = number("Loom-Page-ID"), head["WARC-Target-URI"], size, digest, head["WARC-Type"], number("Loom-Refers-To-Page-ID")
                    yield (*found, payload if response else None) if payloads else found

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from common.batches_of(rows(batches), pa.schema(fields))

    names = spark.createDataFrame([(f["file"],) for f in manifest], "file string")
    return names.repartition(min(len(manifest), common.partitions(spark))).mapInArrow(common.releasing(work), kind)
