"""WARC archives: written from pages, and read back in byte ranges (operator 13).

Archives are gzip files with one member for each record. The reader deals out ranges of bytes of any length: a task looks for
the magic of gzip from the start of its range, takes a candidate as a member if it decompresses to a WARC header and to
the length that the header tells, and reads it to its end, even beyond the range. A record belongs to the range in
which it starts, so every record is read once, and a task never needs what another has found. Behind a record the next one
is looked for at once; what is no member is skipped.

Writing: pages of equal payloads of at least `least` bytes become one response (that with the smallest page_id, then url) and
revisits, which carry the digest and the length but not the payload. Digests are grouped without texts; each task then writes
its pages into files of its own in the shared folder and returns their names. Only files whose names a finished task has
returned are read, so what lost or repeated tasks leave doesn't matter.

Nulls: a null html is an empty payload; a null url is left out; a null page_id is an empty one in the record's id and null when
read (and the largest among equal payloads). Rows that are equal in all columns: one is the response. Empty tables give empty
archives and results. Other columns don't matter.
"""

from __future__ import annotations

import hashlib
import re
import uuid
import zlib
from collections.abc import Iterator
from urllib.parse import quote

import pyarrow as pa
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from paperloom.llm.common import _written, cut, shared_folder

LEAST = 100
#: Bytes of an archive after which a task starts the next one, of a range, and of what is read at once.
ARCHIVE = 1 << 30
SPLIT = 32 << 20
CHUNK = 1 << 20
#: Bytes handed to the decompressor at once, which copies what lies behind a member.
PIECE = 1 << 13
MOST_PARTITIONS = 20_000
MAGIC = b"\x1f\x8b\x08"
VERSION = b"WARC/"
DATE = "2000-01-01T00:00:00Z"

_ARCHIVES = pa.schema([("path", pa.string()), ("length", pa.int64()), ("records", pa.int64())])
ARCHIVES = "path string, length long, records long"
RECORDS = "path string, start long, length long, type string, record_id string, refers_to string, target_uri string, date string, digest string, payload_bytes long, payload binary"
_RECORDS = pa.schema(
    [("path", pa.string()), ("start", pa.int64()), ("length", pa.int64()), *[(c, pa.string()) for c in ("type", "record_id", "refers_to", "target_uri", "date", "digest")],
     ("payload_bytes", pa.int64()), ("payload", pa.binary())]
)


def record(kind: str, fields: list[tuple[str, str]], block: bytes, level: int) -> bytes:
    """A record as a gzip member."""
    head = "".join(f"{k}: {v}\r\n" for k, v in [("WARC-Type", kind), *fields, ("Content-Length", str(len(block)))])
    squeeze = zlib.compressobj(level, zlib.DEFLATED, 31)
    return squeeze.compress(b"WARC/1.1\r\n" + head.encode() + b"\r\n" + block + b"\r\n\r\n") + squeeze.flush()


def page_record(row: dict, suffix: str, date: str, level: int) -> bytes:
    """The record of a row of `kinds`. A response that others revisit is named by page and digest alone, any other record by the
    suffix too, so that equal rows have names of their own."""
    name = lambda page, more: f"<urn:page:{'' if page is None else page}:{row['digest'][:16]}{more}>"
    revisit = row["kind"] == "revisit"
    fields = [
        ("WARC-Record-ID", name(row["page_id"], suffix if revisit or not row["shared"] else "")), ("WARC-Date", date),
        ("WARC-Payload-Digest", f"sha256:{row['digest']}"), ("Content-Type", "application/http; msgtype=response"),
    ]
    if row["url"] is not None:
        fields.append(("WARC-Target-URI", quote(row["url"], safe="!#$%&'()*+,/:;=?@[]~")))
    if revisit:
        fields += [("WARC-Profile", "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"), ("WARC-Refers-To", name(row["refers_to"], ""))]
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {row['payload_bytes']}\r\n\r\n"
    return record(row["kind"], fields, http.encode() + (row["payload"] or b""), level)


def kinds(pages: DataFrame, least: int = LEAST) -> DataFrame:
    """page_id, url, payload (null for revisits), payload_bytes, digest, kind, shared (the digest is that of several pages), refers_to for
    each row of pages(page_id, url, html)."""
    payload = F.coalesce(F.col("html"), F.lit("")).cast("binary")
    pages = pages.select("page_id", "url", payload.alias("payload"), F.sha2(payload, 256).alias("digest"), F.octet_length(payload).cast("long").alias("payload_bytes"))
    equal = pages.where(F.col("payload_bytes") >= least).groupBy("digest", "page_id", "url").agg(F.count(F.lit(1)).alias("n"))
    place = F.struct(F.col("page_id").isNull().alias("unknown"), "page_id", "url", "n")
    groups = cut(equal.groupBy("digest").agg(F.min(place).alias("first"), F.sum("n").alias("pages")).where("pages > 1").drop("pages"))
    # Groups are few beside pages; where they aren't, a digest with many pages is split by the adaptive join.
    rows = pages.join(groups, "digest", "left")
    shared = F.col("first").isNotNull()
    is_first = F.col("first.page_id").eqNullSafe(F.col("page_id")) & F.col("first.url").eqNullSafe(F.col("url"))
    rows = rows.withColumn("response", ~shared | is_first)
    if not groups.where("first.n > 1").isEmpty():  # rows that are equal in all columns: number them, without the others
        several = F.coalesce((F.col("first.n") > 1) & F.col("response"), F.lit(False))
        nth = F.row_number().over(Window.partitionBy("digest").orderBy("page_id"))
        rows = rows.where(~several).unionByName(rows.where(several).withColumn("response", nth == 1))
    return rows.select(
        "page_id", "url", F.when(F.col("response"), F.col("payload")).alias("payload"), "payload_bytes", "digest",
        F.when(F.col("response"), "response").otherwise("revisit").alias("kind"), shared.alias("shared"), F.col("first.page_id").alias("refers_to"),
    )


def write(pages: DataFrame, folder: str | None = None, least: int = LEAST, level: int = 4, date: str = DATE, archive: int = ARCHIVE) -> DataFrame:
    """Writes pages(page_id, url, html) as archives into a folder (a new one in the shared folder if none is given); returns
    path, length, records of each."""
    if folder is None:
        folder = f"{shared_folder(pages.sparkSession).rstrip('/')}/paperloom-{uuid.uuid4().hex}"
        _written.append(folder)
    folder = re.sub("^file:/+", "file:///", folder)

    def of_task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        context = TaskContext.get()
        store, base = fs.FileSystem.from_uri(folder)
        out, rows, files = None, 0, []
        for batch in batches:
            for i in range(batch.num_rows):
                if out is None:
                    store.create_dir(base, recursive=True)
                    # an attempt's number is its own, so that a repeated task doesn't touch the files of the first
                    name = f"{context.partitionId():06d}-{context.taskAttemptId()}-{len(files)}.warc.gz"
                    out = store.open_output_stream(f"{base}/{name}", compression=None)
                    fields = [("WARC-Record-ID", f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, name)}>"), ("WARC-Date", date), ("Content-Type", "application/warc-fields")]
                    length, records = out.write(record("warcinfo", fields, b"software: paperloom\r\nformat: WARC File Format 1.1\r\n", level)), 1
                row = {c: batch.column(k)[i].as_py() for k, c in enumerate(batch.schema.names)}
                length += out.write(page_record(row, f":{context.partitionId()}-{rows}", date, level))
                rows, records = rows + 1, records + 1
                if length >= archive:
                    out.close()
                    files.append((f"{folder}/{name}", length, records))
                    out = None
        if out is not None:
            out.close()
            files.append((f"{folder}/{name}", length, records))
        yield pa.RecordBatch.from_pylist([dict(zip(_ARCHIVES.names, f)) for f in files], schema=_ARCHIVES)

    return cut(kinds(pages, least).mapInArrow(of_task, ARCHIVES))


def fields_of(head: bytes) -> dict[str, str]:
    lines = head.decode("utf-8", "replace").split("\r\n")
    return {k.strip().lower(): v.strip() for k, colon, v in (x.partition(":") for x in lines[1:]) if colon}


class Archive:
    """Reads an open file in chunks, so that memory holds one chunk and one record."""

    def __init__(self, file, size: int):
        self.file, self.size, self.at, self.data = file, size, 0, b""

    def bytes_from(self, at: int) -> memoryview:
        """Some bytes from a place on; none at the end."""
        if not self.at <= at < self.at + len(self.data):
            self.at, self.data = at, self.file.read_at(min(CHUNK, self.size - at), at) if at < self.size else b""
        return memoryview(self.data)[at - self.at :]

    def candidate(self, at: int, end: int) -> int | None:
        """The first place from `at` and before `end` where the magic stands."""
        while at < end:
            part = bytes(self.bytes_from(at))
            if len(part) < len(MAGIC) and at + len(part) < self.size:  # the magic may go on in the next chunk
                self.data = b""
                part = bytes(self.bytes_from(at))
            if len(part) < len(MAGIC):
                return None
            found = part.find(MAGIC)
            if found >= 0:
                return at + found if at + found < end else None
            at += len(part) - len(MAGIC) + 1
        return None

    def member(self, at: int) -> tuple[dict[str, str], bytes, int] | None:
        """Fields, block and end of the record whose member starts at a place; nothing if none does."""
        unzip, text, place = zlib.decompressobj(31), bytearray(), at
        try:
            while not unzip.eof:
                part = self.bytes_from(place)[:PIECE]
                if not len(part):
                    return None
                text += unzip.decompress(part)
                place += len(part) - len(unzip.unused_data)
                if len(text) >= len(VERSION) and not text.startswith(VERSION):
                    return None
        except zlib.error:
            return None
        head, gap, rest = bytes(text).partition(b"\r\n\r\n")
        if not gap or not head.startswith(VERSION):
            return None
        fields = fields_of(head)
        told = fields.get("content-length", "")
        if not told.isdigit() or len(rest) != int(told) + 4 or not rest.endswith(b"\r\n\r\n"):
            return None
        return fields, rest[:-4], place

    def records(self, start: int, end: int) -> Iterator[tuple[int, int, dict[str, str], bytes]]:
        """Start, end, fields and block of the records that start in [start, end)."""
        at = start
        while (at := self.candidate(at, end)) is not None:
            if (found := self.member(at)) is None:
                at += 1
                continue
            fields, block, stop = found
            yield at, stop, fields, block
            at = stop


def row_of(path: str, start: int, stop: int, fields: dict[str, str], block: bytes) -> dict:
    kind = fields.get("warc-type")
    digest = fields.get("warc-payload-digest", "").removeprefix("sha256:") or None
    payload, n = None, None
    if fields.get("content-type", "").startswith("application/http"):
        head, _, body = block.partition(b"\r\n\r\n")
        told = fields_of(head).get("content-length", "")
        n = int(told) if told.isdigit() else None
        if kind == "response":
            payload, n = body, len(body)
            if digest is not None and hashlib.sha256(body).hexdigest() != digest:
                raise ValueError(f"the payload of {fields.get('warc-record-id')} in {path} isn't that of its digest")
    return {
        "path": path, "start": start, "length": stop - start, "type": kind, "record_id": fields.get("warc-record-id"), "refers_to": fields.get("warc-refers-to"),
        "target_uri": fields.get("warc-target-uri"), "date": fields.get("warc-date"), "digest": digest, "payload_bytes": n, "payload": payload,
    }


def read(archives: DataFrame, split: int = SPLIT) -> DataFrame:
    """A row for each record of archives(path, length): where it lies, its type, ids, digest and payload."""
    total = archives.agg(F.sum(F.ceil(F.col("length") / split))).first()[0] or 1
    begins = F.explode(F.sequence(F.lit(0).cast("long"), F.col("length") - 1, F.lit(split).cast("long"))).alias("start")
    ranges = archives.where("length > 0").select("path", "length", begins).select("path", "length", "start", F.least(F.col("start") + split, "length").alias("end"))

    def of_task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows, held = [], 0
        for batch in batches:
            for r in batch.to_pylist():
                store, path = fs.FileSystem.from_uri(r["path"])
                with store.open_input_file(path) as file:
                    for found in Archive(file, r["length"]).records(r["start"], r["end"]):
                        rows.append(row_of(r["path"], *found))
                        held += len(found[3])
                        if held >= 8 << 20:
                            yield pa.RecordBatch.from_pylist(rows, schema=_RECORDS)
                            rows, held = [], 0
        yield pa.RecordBatch.from_pylist(rows, schema=_RECORDS)

    return ranges.repartition(int(min(total, MOST_PARTITIONS))).mapInArrow(of_task, RECORDS)


def report(pages: DataFrame, folder: str | None = None, least: int = LEAST, split: int = SPLIT) -> DataFrame:
    """page_id, payload_bytes, payload_digest, record_type, refers_to for each page, from the archives that were written of them."""
    records = read(write(pages, folder, least), split).where("type in ('response', 'revisit')")
    kind = pages.schema["page_id"].dataType
    page = lambda c: F.nullif(F.regexp_extract(c, "^<urn:page:([^:]*):", 1), F.lit("")).cast(kind)
    digest = F.when(F.col("type") == "response", F.sha2("payload", 256)).otherwise(F.col("digest"))
    return records.select(
        page("record_id").alias("page_id"), "payload_bytes", digest.alias("payload_digest"), F.col("type").alias("record_type"), page("refers_to").alias("refers_to"),
    )
