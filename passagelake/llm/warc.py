"""WARC archives: writing, normalising monolithic gzip files, and reading by offset.

A monolithic archive is one gzip stream over all its records, which cannot be read from the middle.
The normaliser inflates such a stream once, from start to end, writes every record as a gzip member
of its own, and writes a sidecar index with one line for each record: offset and length of its
member, its id and its type. A record is copied in pieces, so that memory does not depend on sizes.

File names hold the number of the task attempt, and only the files that a successful attempt returns
are read, so that a task which runs again, or twice at once, never mixes its files with the others'.

Rows are decided on by their digests alone; of the payloads, only those are shuffled that a bit map of
fixed size can't tell from revisits, and these are deflated first. A very long payload is written and
normalised in pieces, but a row of a table and a record that is read back are whole in memory.

Results: a null payload is an empty one; a null url is recorded as urn:page:<id>. Rows with equal
page_id and payload are the same record and get the same result. Null page_ids come last: such a
page revisits any page that has an id. An empty table gives no archives and an empty result. Columns
other than page_id, url and html are not looked at, whatever their names.
"""

from __future__ import annotations

import hashlib
import json
import posixpath
import re
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from passagelake.llm.common import BitMap, arrow_column, delete, forget, scratch, shared_dir, written

#: Payloads from this many bytes on are recorded once and revisited.
MIN_REVISIT = 100
PIECE = 1 << 16
#: Uncompressed bytes after which a task begins another archive.
ARCHIVE_BYTES = 256 << 20
DATE = "1970-01-01T00:00:00Z"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"


def file_system(uri: str):
    """(pyarrow file system, path) of a folder that all executors see."""
    from pyarrow import fs

    if "://" not in uri and not uri.startswith("file:"):
        return fs.LocalFileSystem(), uri
    if uri.startswith("file:"):
        return fs.LocalFileSystem(), re.sub(r"^file:/*", "/", uri)
    return fs.FileSystem.from_uri(uri)


class Archive:
    """One gzip stream, or a member for each record."""

    def __init__(self, stream, members: bool):
        self.stream, self.members, self.offset, self.begun = stream, members, 0, 0
        self.z = None

    def begin(self) -> None:
        if self.z is None:
            self.z = zlib.compressobj(6, zlib.DEFLATED, 31)
        if self.members:
            self.begun = self.offset

    def write(self, data) -> None:
        for i in range(0, len(data), PIECE):
            self._put(self.z.compress(data[i : i + PIECE]))

    def _put(self, data: bytes) -> None:
        if data:
            self.stream.write(data)
            self.offset += len(data)

    def end(self) -> tuple[int, int]:
        """Offset and length of the member."""
        if self.members:
            self._put(self.z.flush())
            self.z = None
        return self.begun, self.offset - self.begun

    def close(self) -> None:
        if self.z is not None:
            self._put(self.z.flush())
        self.stream.close()


def record_id(page_id, digest: str) -> str:
    return f"<urn:uuid:{uuid.UUID(hashlib.md5(f'{page_id}/{digest}'.encode()).hexdigest())}>"


def head(page_id, url: str | None, kind: str, refers_to, digest: str, size: int) -> bytes:
    """Header of a WARC record and the HTTP header that its block begins with."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {size}\r\n\r\n".encode()
    target = re.sub(r"[\x00-\x20\x7f]", lambda m: f"%{ord(m[0]):02X}", url) if url else f"urn:page:{page_id}"
    lines = ["WARC/1.1", f"WARC-Type: {kind}", f"WARC-Record-ID: {record_id(page_id, digest)}", f"WARC-Date: {DATE}", f"WARC-Target-URI: {target}", f"WARC-Payload-Digest: sha256:{digest}", "Content-Type: application/http;msgtype=response"]
    if page_id is not None:
        lines.append(f"WARC-Page-Id: {page_id}")
    if kind == "revisit":
        lines += [f"WARC-Profile: {PROFILE}", f"WARC-Refers-To: {record_id(refers_to, digest)}", *([] if refers_to is None else [f"WARC-Refers-To-Page-Id: {refers_to}"])]
    length = len(http) + (size if kind == "response" else 0)
    return ("\r\n".join([*lines, f"Content-Length: {length}"]) + "\r\n\r\n").encode() + http


def write_monolithic(records: DataFrame, folder: str) -> DataFrame:
    """Write records (page_id, url, html, record_type, refers_to, payload_digest, payload_bytes) as monolithic .warc.gz files; returns their paths.

    A revisit's html isn't looked at, and may be null.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        system, base = file_system(folder)
        task = TaskContext.get()
        archive, names, used = None, [], 0
        for b in batches:
            columns = [b.column(i).to_pylist() for i in range(2)] + [b.column(2).cast(pa.binary()).to_pylist()] + [b.column(i).to_pylist() for i in range(3, 7)]
            for page, url, html, kind, refers, digest, size in zip(*columns, strict=True):
                payload = html or b""
                if archive is None:
                    system.create_dir(base, recursive=True)
                    name = posixpath.join(base, f"part-{task.partitionId():06d}-{task.taskAttemptId()}-{len(names):04d}.warc.gz")
                    archive, used = Archive(system.open_output_stream(name, compression=None), False), 0
                archive.begin()
                top = head(page, url, kind, refers, digest, size)
                archive.write(top)
                if kind == "response":
                    archive.write(payload)
                archive.write(b"\r\n\r\n")
                archive.end()
                used += len(top) + len(payload)
                if used >= ARCHIVE_BYTES:
                    archive.close()
                    names.append(name)
                    archive = None
        if archive is not None:
            archive.close()
            names.append(name)
        yield pa.RecordBatch.from_arrays([pa.array(names, pa.string())], names=["archive"])

    picked = records.select("page_id", "url", "html", "record_type", "refers_to", "payload_digest", "payload_bytes")
    return picked.mapInArrow(run, "archive string")


class Inflated:
    """The bytes of a gzip stream (of any number of members), read once from start to end."""

    def __init__(self, stream):
        self.stream, self.z, self.left, self.over = stream, zlib.decompressobj(31), bytearray(), False

    def _more(self) -> bool:
        while not self.over:
            data = self.z.unconsumed_tail or self.z.unused_data
            if self.z.eof:
                self.z = zlib.decompressobj(31)
            if not data:
                data = self.stream.read(PIECE)
                if not data:
                    self.over = True
                    return False
            got = self.z.decompress(data, 4 * PIECE)
            if got:
                self.left += got
                return True
        return False

    def until(self, mark: bytes) -> bytes | None:
        """All up to and with the mark; None at the end of the stream."""
        at = 0
        while (found := self.left.find(mark, at)) < 0:
            at = max(0, len(self.left) - len(mark) + 1)
            if not self._more():
                if self.left:
                    raise ValueError("the archive ends inside a record")
                return None
        out = bytes(self.left[: found + len(mark)])
        del self.left[: found + len(mark)]
        return out

    def take(self, n: int) -> Iterator[bytes]:
        """n bytes in pieces."""
        while n:
            if not self.left and not self._more():
                raise ValueError("the archive ends inside a record")
            piece = bytes(self.left[:n])
            del self.left[:n]
            n -= len(piece)
            yield piece


def headers(raw: bytes) -> dict[str, str]:
    lines = raw.decode().split("\r\n")
    return {k.strip().lower(): v.strip() for k, _, v in (x.partition(":") for x in lines[1:] if x)} | {"": lines[0]}


def normalise(source, target, index) -> int:
    """Copy a gzip stream of WARC records to one with a member for each, and write an index line for each; returns their number."""
    stream, out, n = Inflated(source), Archive(target, True), 0
    while (top := stream.until(b"\r\n\r\n")) is not None:
        fields = headers(top)
        out.begin()
        out.write(top)
        for piece in stream.take(int(fields["content-length"])):
            out.write(piece)
        out.write(b"".join(stream.take(4)))
        offset, length = out.end()
        index.write(json.dumps({"offset": offset, "length": length, "id": fields["warc-record-id"], "type": fields["warc-type"], "url": fields.get("warc-target-uri")}).encode() + b"\n")
        n += 1
    out.close()
    index.close()
    return n


def normalise_files(archives: DataFrame, folder: str) -> DataFrame:
    """Normalise each file of column archive into folder; returns archive (the new file), index_file and n_records."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        system, base = file_system(folder)
        for b in batches:
            rows = []
            for name in b.column(0).to_pylist():
                system.create_dir(base, recursive=True)
                stem = posixpath.join(base, f"{posixpath.basename(name).removesuffix('.warc.gz')}-{TaskContext.get().taskAttemptId()}")
                final, index = f"{stem}.warc.gz", f"{stem}.index.jsonl"
                with system.open_input_stream(name, compression=None) as source:
                    n = normalise(source, system.open_output_stream(final, compression=None), system.open_output_stream(index, compression=None))
                rows.append((final, index, n))
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], t) for i, t in enumerate((pa.string(), pa.string(), pa.int64()))], names=["archive", "index_file", "n_records"])

    return archives.mapInArrow(run, "archive string, index_file string, n_records long")


def read_member(data: bytes) -> tuple[dict[str, str], dict[str, str], bytes]:
    """WARC header, HTTP header and payload of one member."""
    raw = zlib.decompress(data, 31)
    top, _, rest = raw.partition(b"\r\n\r\n")
    fields = headers(top)
    block = rest[: int(fields["content-length"])]
    http, _, payload = block.partition(b"\r\n\r\n")
    return fields, headers(http), payload


def read_records(files: DataFrame, with_payload: bool = False) -> DataFrame:
    """Rows of all records, each read through its index line alone; the digest of a response is computed from its payload."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        system, _ = file_system(folder)
        kinds = [pa.int64(), pa.string(), pa.int64(), pa.string(), pa.string(), pa.int64(), *[pa.binary()] * with_payload]
        names = ["page_id", "url", "payload_bytes", "payload_digest", "record_type", "refers_to", *["payload"] * with_payload]
        for b in batches:
            for name, index in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                rows: list[tuple] = []
                held = 0
                with system.open_input_file(name) as archive, system.open_input_stream(index, compression=None) as lines:
                    left = b""
                    while True:
                        part = lines.read(PIECE)
                        *whole, left = (left + part).split(b"\n")
                        for at in map(json.loads, filter(None, whole if part else [*whole, left])):
                            fields, http, payload = read_member(archive.read_at(at["length"], at["offset"]))
                            digest = fields["warc-payload-digest"].removeprefix("sha256:")
                            if fields["warc-type"] == "response" and hashlib.sha256(payload).hexdigest() != digest:
                                raise ValueError(f"{name}: the payload at {at['offset']} differs from its digest")
                            number = lambda k, f=fields: int(f[k]) if k in f else None
                            rows.append((number("warc-page-id"), fields["warc-target-uri"], int(http["content-length"]), digest, fields["warc-type"], number("warc-refers-to-page-id"), *[payload] * with_payload))
                            held += len(payload) * with_payload + 200
                            if held > 4 << 20:
                                yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], t) for i, t in enumerate(kinds)], names=names)
                                rows, held = [], 0
                        if not part:
                            break
                yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], t) for i, t in enumerate(kinds)], names=names)

    folder = shared_dir(files.sparkSession)
    return files.mapInArrow(run, "page_id long, url string, payload_bytes long, payload_digest string, record_type string, refers_to long" + ", payload binary" * with_payload)


def key_id(page_id: str = "page_id", digest: str = "payload_digest"):
    """64-bit hash of a record's key."""
    return F.xxhash64(page_id, digest)


def digests(pages: DataFrame) -> DataFrame:
    """page_id, url, payload_bytes and payload_digest of each row, without payloads; all else is decided on these."""
    payload = F.coalesce(F.col("html"), F.lit("")).cast("binary")
    return pages.select(F.col("page_id").cast("long").alias("page_id"), "url", F.octet_length(payload).cast("long").alias("payload_bytes"), F.sha2(payload, 256).alias("payload_digest"))


def plan_records(seen: DataFrame, min_revisit: int = MIN_REVISIT) -> DataFrame:
    """seen (see digests()) with record_type and refers_to.

    The first ids are written before the join, so that a payload that many pages share is a skewed key that Spark splits.
    """
    first = seen.filter(F.col("payload_bytes") >= min_revisit).groupBy(F.col("payload_digest").alias("digest")).agg(F.min("page_id").alias("first_id")).filter("first_id is not null")
    joined = seen.join(written(first, "first").hint("merge"), F.col("payload_digest") == F.col("digest"), "left")
    revisit = F.col("first_id").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("first_id"))
    return joined.select(*seen.columns, F.when(revisit, F.lit("revisit")).otherwise(F.lit("response")).alias("record_type"), F.when(revisit, F.col("first_id")).alias("refers_to"))


def responses(pages: DataFrame, plan: DataFrame) -> DataFrame:
    """The rows of pages that are recorded with their payload: page_id, url, html, payload_bytes, payload_digest.

    A bit map of fixed size knows most of them where they are read. Only rows that share a bit with
    a revisit are shuffled, their payloads deflated; how many those are changes the cost, not the result.
    """
    row = pages.select(F.col("page_id").cast("long").alias("page_id"), "url", F.coalesce(F.col("html"), F.lit("")).cast("binary").alias("html"))
    row = row.withColumns({"payload_bytes": F.octet_length("html").cast("long"), "payload_digest": F.sha2("html", 256)})
    keys = plan.select(key_id().alias("id"), "page_id", "payload_digest", "record_type")
    marks = BitMap.of(keys.filter("record_type = 'revisit'"), "id")
    marked = marks.holds(key_id())
    unsure = keys.filter("record_type = 'response'").filter(marks.holds(F.col("id"))).select(F.col("page_id").alias("of_page"), F.col("payload_digest").alias("of_digest")).distinct()
    small = row.filter(marked).withColumn("html", arrow_column(lambda x: pa.array([zlib.compress(v, 6) for v in x.to_pylist()], pa.binary()), "binary")("html"))
    found = small.join(unsure.hint("merge"), F.col("page_id").eqNullSafe(F.col("of_page")) & (F.col("payload_digest") == F.col("of_digest"))).select(*row.columns)
    whole = found.withColumn("html", arrow_column(lambda x: pa.array([zlib.decompress(v) for v in x.to_pylist()], pa.binary()), "binary")("html"))
    return row.filter(~marked).unionByName(whole)


def archive(pages: DataFrame, *, min_revisit: int = MIN_REVISIT, with_payload: bool = False) -> DataFrame:
    """Write the pages as monolithic archives, normalise those, and read all records back through the index.

    The monolithic files go when the normalised ones are complete.
    """
    spark = pages.sparkSession
    seen = written(digests(pages), "digests")
    plan = written(plan_records(seen, min_revisit), "plan")
    forget(seen)
    plain = responses(pages, plan).withColumns({"record_type": F.lit("response"), "refers_to": F.lit(None).cast("long")})
    again = plan.filter("record_type = 'revisit'").withColumn("html", F.lit(None).cast("binary"))
    folder = scratch(spark, "warc")
    monolithic = written(write_monolithic(plain.unionByName(again), f"{folder}/monolithic"), "archives")
    files = written(normalise_files(monolithic.repartition(spark.sparkContext.defaultParallelism * 2), f"{folder}/members"), "members")
    forget(monolithic)
    forget(plan)
    delete(spark, f"{folder}/monolithic")
    return read_records(files.repartition(spark.sparkContext.defaultParallelism * 2), with_payload)
