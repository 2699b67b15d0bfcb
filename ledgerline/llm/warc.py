"""WARC archives: a deterministic sharded writer and a reader.

Records are range-sorted by page_id. The ranges come from exact payload sizes of blocks of ids, not from a sample, and files
are named by their range, so the archives follow from the rows alone, whatever the partitions of input or shuffle. A task
writes one shard after another, its records as separate gzip members into files under a temporary name of this attempt, and
starts another file when the compressed size reaches a limit. Its only result is the manifest: a row for each file with its temporary and final name.
The manifest is written first; a second job then renames what it lists, skipping what is there already. Files of lost or
repeated attempts are in no manifest and go with the temporary folder. Headers and digests are made anew for each record.

Equal payloads of ``least`` bytes or more are stored once: the row with the largest page_id is a response and the others
are revisits of it. Who revisits whom is found from (page_id, digest) alone, and these notes are range-sorted together with
the records, each just ahead of its own, so the payloads are shuffled once and a group of copies may have any size.

A block of ids that holds more than a shard should, as when one page_id has many rows, is dealt into several shards by a hash
of page_id and digest.

Defined cases: a null html is an empty payload; a null page_id is written without one and comes back as null, never as
the target of a revisit; rows that repeat a page_id and payload are revisits of their first; control characters and blanks
in URLs are percent-encoded and a null url leaves its header out; an empty table gives empty archives; other columns of the
table, whatever their names, are not written; ids may be numbers or text, and payloads of any length.
"""

from __future__ import annotations

import base64
import hashlib
import posixpath
import uuid
import zlib
from collections.abc import Iterator
from urllib.parse import quote

import pandas as pd
from pyarrow import fs
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ledgerline.llm.common import bounded_batches, remove

LEAST_REVISIT = 1000
FILE_BYTES = 32 * 1024 * 1024
SHARD_BYTES = (4 << 20, 1 << 30)  # payload of a shard: a 256th of all, within these bounds
BLOCKS = 1 << 14
DATE = "2000-01-01T00:00:00Z"  # archives do not depend on when they are written
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
MANIFEST = "shard long, file long, temporary string, final string, records long, bytes long, sha1 string"
RECORDS = "page_id string, url string, record_type string, payload_bytes long, payload_digest string, refers_to string, payload binary"


def _name(page_id: str | None, digest: str) -> str:
    """A record's id: from its page_id, or, without one, from its digest."""
    return f"urn:page:{page_id}" if page_id is not None else f"urn:sha1:{digest}"


def _member(page_id: str | None, url: str | None, payload: bytes, digest: str, refers_to: str | None) -> bytes:
    """One record as a gzip member."""
    body = b"" if refers_to is not None else payload
    head = ["WARC/1.1", f"WARC-Type: {'response' if refers_to is None else 'revisit'}", f"WARC-Record-ID: <{_name(page_id, digest)}>", f"WARC-Date: {DATE}"]
    if url is not None:
        head.append("WARC-Target-URI: " + quote(url, safe="!#$%&'()*+,/:;=?@[]~"))
    if refers_to is not None:
        head += [f"WARC-Refers-To: <{_name(refers_to, digest)}>", f"WARC-Profile: {PROFILE}"]
    head += [
        "WARC-Payload-Digest: sha1:" + base64.b32encode(bytes.fromhex(digest)).decode(),
        "WARC-Block-Digest: sha1:" + base64.b32encode(hashlib.sha1(body).digest()).decode(),
        f"X-Payload-Length: {len(payload)}",
        "Content-Type: text/html; charset=utf-8",
        f"Content-Length: {len(body)}",
    ]
    packer = zlib.compressobj(6, zlib.DEFLATED, 31)
    return packer.compress("\r\n".join(head).encode() + b"\r\n\r\n" + body + b"\r\n\r\n") + packer.flush()


class _Writer:
    """The files of one task; records go in, and a manifest row comes out whenever a file is full or its shard ends."""

    def __init__(self, place: str, limit: int):
        self.files, root = fs.FileSystem.from_uri(place)
        self.root, self.limit = root, limit
        self.attempt, self.out, self.shard = uuid.uuid4().hex, None, None

    def add(self, shard: int, member: bytes) -> Iterator[tuple]:
        if shard != self.shard:
            yield from self.close()
            self.shard, self.file = shard, 0
        if self.out is None:
            self.temporary = f"_temporary/{self.attempt}-{shard:07d}-{self.file:05d}.warc.gz"
            self.files.create_dir(posixpath.join(self.root, "_temporary"), recursive=True)
            self.out = self.files.open_output_stream(posixpath.join(self.root, self.temporary), compression=None)
            self.bytes = self.records = 0
            self.sha1 = hashlib.sha1()
        self.out.write(member)
        self.sha1.update(member)
        self.bytes += len(member)
        self.records += 1
        if self.bytes >= self.limit:
            yield from self.close()

    def close(self) -> Iterator[tuple]:
        if self.out is not None:
            self.out.close()
            self.out = None
            yield self.shard, self.file, self.temporary, f"part-{self.shard:07d}-{self.file:05d}.warc.gz", self.records, self.bytes, self.sha1.hexdigest()
            self.file += 1


def _position(ids: Column, kind: T.DataType) -> Column:
    """A number that rises with the id; texts go by their first seven bytes, nulls first."""
    if not isinstance(kind, T.NumericType):
        ids = F.conv(F.rpad(F.hex(F.substring(F.encode(ids.cast("string"), "UTF-8"), 1, 7)), 14, "0"), 16, 10)
    return ids.cast("long")


def shard_numbers(rows: DataFrame, shard_bytes: int | None) -> tuple[DataFrame, Column]:
    """A table of block, its first shard and its number of shards, and the column that says a row's block.

    The exact sizes of at most BLOCKS blocks are put together in order, so the table is bounded and may be broadcast.

    ``rows`` have at (position of the id, may be null) and bytes.
    """
    low, high, total = rows.agg(F.min("at"), F.max("at"), F.sum("bytes")).first()
    low, high, total = low or 0, high or 0, total or 0
    shift = max((high - low).bit_length() - BLOCKS.bit_length() + 1, 0)
    share = shard_bytes or min(max(total // 256, SHARD_BYTES[0]), SHARD_BYTES[1])
    block = F.coalesce(F.floor((F.col("at").cast("decimal(20,0)") - low) / (1 << shift)).cast("long"), F.lit(-1))
    sizes = sorted(tuple(r) for r in rows.groupBy(block.alias("block")).agg(F.sum("bytes").alias("bytes")).collect())
    out, shard, held = [], 0, 0
    for b, n in sizes:
        parts = -(-n // share) if n > share else 1
        if held and held + n > share:
            shard, held = shard + 1, 0
        out.append((b, shard, parts))
        held += n
        if parts > 1:
            shard, held = shard + parts, 0
    numbers = rows.sparkSession.createDataFrame(out, "block long, shard long, parts long")
    return F.broadcast(numbers), block


def write_archives(pages: DataFrame, place: str, least: int = LEAST_REVISIT, file_bytes: int = FILE_BYTES, shard_bytes: int | None = None) -> DataFrame:
    """Write ``pages`` (page_id, url, html) as WARC files under ``place``; returns the committed manifest.

    ``place`` is a URI that pyarrow's file systems know and all executors share.
    """
    spark = pages.sparkSession
    bounded_batches(spark)
    html = F.encode(F.coalesce(pages["html"].cast("string"), F.lit("")), "UTF-8")
    kind = pages.schema["page_id"].dataType
    rows = pages.select(pages["page_id"].alias("k"), _position(pages["page_id"], kind).alias("at"), pages["url"].cast("string").alias("url"), html.alias("payload"), F.sha1(html).alias("digest"))
    numbers, block = shard_numbers(rows.select("at", F.octet_length("payload").alias("bytes")), shard_bytes)
    copies = rows.filter((F.octet_length("payload") >= least) & F.col("k").isNotNull()).select("k", "at", "digest")
    groups = copies.groupBy("digest").agg(F.max("k").alias("target"), F.count(F.lit(1)).alias("n")).filter("n > 1")
    notes = copies.join(groups, "digest").select("k", "at", "digest", "target")
    # a note goes ahead of the records with its page_id and digest, in the same shard
    both = rows.select("k", "at", F.lit(1).alias("part"), "digest", "url", "payload", F.lit(None).cast(kind).alias("target"))
    both = both.unionByName(notes.select("k", "at", F.lit(0).alias("part"), "digest", F.lit(None).cast("string").alias("url"), F.lit(None).cast("binary").alias("payload"), "target"))
    both = both.withColumn("block", block).join(numbers, "block").withColumn("shard", F.col("shard") + F.pmod(F.xxhash64("k", "digest"), F.col("parts")))
    dealt = both.repartition("shard").sortWithinPartitions("shard", "k", "part", "digest", "url").select("shard", F.col("k").cast("string").alias("k"), "part", "digest", "url", "payload", F.col("target").cast("string").alias("target"))

    def write(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        out, now, targets, seen = _Writer(place, file_bytes), None, {}, set()
        for batch in batches:
            done = []
            for shard, k, part, digest, url, payload, target in batch.itertuples(index=False, name=None):
                if (shard, k) != now:
                    now, targets, seen = (shard, k), {}, set()
                if part == 0:
                    targets[digest] = target
                    continue
                refers = targets.get(digest)
                if refers is not None and refers == k:  # the response, unless its like has been written
                    refers = k if digest in seen else None
                    seen.add(digest)
                done += out.add(shard, _member(k, url, bytes(payload), digest, refers))
            yield pd.DataFrame(done, columns=_MANIFEST)
        yield pd.DataFrame(list(out.close()), columns=_MANIFEST)

    path = f"{place}/_manifest"
    dealt.mapInPandas(write, MANIFEST).write.mode("overwrite").parquet(path)
    manifest = spark.read.parquet(path)

    def commit(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        files, root = fs.FileSystem.from_uri(place)
        for batch in batches:
            for temporary, final in zip(batch["temporary"], batch["final"], strict=True):
                if files.get_file_info(posixpath.join(root, temporary)).type != fs.FileType.NotFound:
                    files.move(posixpath.join(root, temporary), posixpath.join(root, final))
            yield batch

    manifest.mapInPandas(commit, MANIFEST).write.mode("overwrite").parquet(f"{place}/_committed")
    remove(spark, f"{place}/_temporary")
    return spark.read.schema(manifest.schema).parquet(f"{place}/_committed")


_MANIFEST = [x.strip().split()[0] for x in MANIFEST.split(",")]
_RECORDS = [x.strip().split()[0] for x in RECORDS.split(",")]


def read_stream(stream, chunk: int = 1 << 20) -> Iterator[tuple[dict, bytes]]:
    """Headers and block of each record of a gzip-member file, holding one record at a time."""
    data, unpack = b"", zlib.decompressobj(31)
    record: list[bytes] = []
    while True:
        if not data:
            data = stream.read(chunk)
            if not data:
                return
        record.append(unpack.decompress(data))
        data = unpack.unused_data
        if unpack.eof:
            head, _, rest = b"".join(record).partition(b"\r\n\r\n")
            fields = dict(x.split(": ", 1) for x in head.decode().split("\r\n")[1:])
            yield fields, rest[: int(fields["Content-Length"])]
            record, unpack = [], zlib.decompressobj(31)


def _bare(name: str | None) -> str | None:
    """The page_id in a record's name."""
    return name[len("<urn:page:") : -1] if name and name.startswith("<urn:page:") else None


def read_archives(spark: SparkSession, place: str, payloads: bool = True) -> DataFrame:
    """The records of all committed files; ids are text as in the headers. Digests are checked against the blocks."""

    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        files, root = fs.FileSystem.from_uri(place)
        for batch in batches:
            for final in batch["final"]:
                out, held = [], 0
                with files.open_input_stream(posixpath.join(root, final), compression=None) as stream:
                    for h, block in read_stream(stream):
                        if "sha1:" + base64.b32encode(hashlib.sha1(block).digest()).decode() != h["WARC-Block-Digest"]:
                            raise ValueError(f"{final}: a record's block does not have its digest")
                        digest = base64.b32decode(h["WARC-Payload-Digest"].removeprefix("sha1:")).hex()
                        out.append((_bare(h["WARC-Record-ID"]), h.get("WARC-Target-URI"), h["WARC-Type"], int(h["X-Payload-Length"]), digest, _bare(h.get("WARC-Refers-To")), block if payloads else None))
                        held += len(out[-1][-1] or b"") + 200
                        if held > 16 << 20:
                            yield pd.DataFrame(out, columns=_RECORDS)
                            out, held = [], 0
                yield pd.DataFrame(out, columns=_RECORDS)

    files = spark.read.parquet(f"{place}/_committed").select("final").repartition(spark.sparkContext.defaultParallelism)
    return files.mapInPandas(read, RECORDS)
