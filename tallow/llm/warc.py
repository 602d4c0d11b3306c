"""WARC archives: a writer with revisit records, and a splittable reader.

Each record is a gzip member of its own. Writer tasks put their records into archives of their own in the shared folder, under names that no
other attempt has, and hand back a manifest; only archives of the written manifest are read, so tasks can be lost and run again. The reader
cuts every archive into byte ranges. A range's task looks for the gzip magic, and takes a candidate for a member only if its header inflates
to a WARC version line and its check sum and length hold at its end. A task owns the
records that start inside its range, and reads past the end to finish the last. Members follow each other without a break, so a member that begins with a
WARC version line and then fails, and bytes between members that are none, raise an error; so does an archive with fewer records than its manifest says.

Payload copies: of equal payloads of at least `min_bytes`, the one with the smallest page_id is a response, the rest are revisits of it. Digests are
counted before the shuffle, and only (page_id, digest) travels in the join, so a payload that a third of the pages share does no harm.

Nulls: a null html is an empty payload, a null url an empty target. A row with a null page_id is always a response with a null page_id. Rows that repeat the
smallest page_id are responses too. Empty tables write no archives. Other columns are ignored.
"""

from __future__ import annotations

import base64
import hashlib
import uuid
import zlib
from urllib.parse import quote

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import as_bytes, batches_of, bound_arrow, materialize, new_path, only, remove_path

MIN_BYTES = 0
#: Bytes of an archive before its task begins another, and of a reader's range.
ARCHIVE_BYTES = 256 << 20
RANGE_BYTES = 4 << 20
LEVEL = 3
MAGIC = b"\x1f\x8b\x08"
DATE = "2024-01-01T00:00:00Z"
#: Bytes that suffice to tell a WARC record from a chance magic.
PROBE = 4096

RECORDS = "page_id bigint, url string, record_type string, refers_to bigint, payload_bytes bigint, payload_digest string"


def with_revisits(pages: DataFrame, min_bytes: int = MIN_BYTES) -> DataFrame:
    """page_id, url, html, refers_to: the page that a copy refers to, null for responses."""
    rows = only(pages, "page_id", "url", "html").select(F.col("page_id").cast("long").alias("page_id"), "url", F.coalesce("html", F.lit("")).alias("html"))
    digests = rows.where((F.octet_length("html") >= min_bytes) & F.col("page_id").isNotNull()).select("page_id", F.sha1("html").alias("d"))
    firsts = digests.groupBy("d").agg(F.min("page_id").alias("refers_to"), F.count("*").alias("n")).where("n > 1").drop("n")
    # written first, so that the many copies of one payload can be split in the join
    firsts = materialize(firsts, "warc-firsts")
    copies = materialize(digests.join(firsts, "d").where("page_id <> refers_to").select("page_id", "refers_to", "d").distinct(), "warc-copies")
    keyed = rows.withColumn("d", F.sha1("html"))
    return keyed.join(copies, ["page_id", "d"], "left").select("page_id", "url", "html", "refers_to")


def digest_of(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def record(page_id: int | None, url: str | None, payload: bytes, refers_to: int | None) -> bytes:
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = http if refers_to is not None else http + payload
    head = [
        "WARC/1.1",
        f"WARC-Type: {'response' if refers_to is None else 'revisit'}",
        f"WARC-Record-ID: <urn:page:{'' if page_id is None else page_id}>",
        f"WARC-Date: {DATE}",
        f"WARC-Target-URI: {quote(url or '', safe=SAFE)}",
        f"WARC-Payload-Digest: sha1:{digest_of(payload)}",
        "Content-Type: application/http; msgtype=response",
        f"Content-Length: {len(block)}",
    ]
    if refers_to is not None:
        head += ["WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest", f"WARC-Refers-To: <urn:page:{refers_to}>"]
    return "\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


#: What a target keeps as it is; all else, control characters included, is percent-encoded.
SAFE = "!#$%&'()*+,/:;=?@[]~-._"


def gzip_member(data: bytes, level: int = LEVEL) -> bytes:
    z = zlib.compressobj(level, zlib.DEFLATED, 31)
    return z.compress(data) + z.flush()


def write_archives(rows: DataFrame, folder: str, archive_bytes: int = ARCHIVE_BYTES) -> DataFrame:
    """Writes page_id, url, html, refers_to; returns the written manifest (path, bytes, records)."""

    def write(batches):
        from pyarrow import fs

        store, base = fs.FileSystem.from_uri(folder)
        store.create_dir(base, recursive=True)
        out, name, size, n = None, "", 0, 0
        context = TaskContext.get()
        done: list[tuple[str, int, int]] = []
        for b in batches_of(batches, "html"):
            for i, url, html, refers in zip(b.column("page_id").to_pylist(), b.column("url").to_pylist(), as_bytes(b.column("html")), b.column("refers_to").to_pylist(), strict=True):
                if out is None:
                    name = f"part-{context.partitionId():05d}-{context.taskAttemptId()}-{uuid.uuid4().hex}.warc.gz"
                    out, size, n = store.open_output_stream(f"{base}/{name}", compression=None), 0, 0
                member = gzip_member(record(i, url, html, refers))
                out.write(member)
                size, n = size + len(member), n + 1
                if size >= archive_bytes:
                    out.close()
                    done.append((name, size, n))
                    out = None
        if out is not None:
            out.close()
            done.append((name, size, n))
        yield pa.RecordBatch.from_pydict({"path": pa.array([f"{folder}/{x[0]}" for x in done], pa.string()), "bytes": pa.array([x[1] for x in done], pa.int64()), "records": pa.array([x[2] for x in done], pa.int64())})

    bound_arrow(rows.sparkSession)
    return materialize(rows.mapInArrow(write, "path string, bytes bigint, records bigint"), "warc-manifest")


class RangeReader:
    """Reads the members that start in [start, end) of an archive."""

    def __init__(self, file, start: int, end: int, size: int):
        self.file, self.end, self.size = file, end, size
        self.base, self.data = start, bytearray()

    def upto(self, at: int) -> bool:
        """Makes the bytes before `at` available, as far as there are any."""
        have = self.base + len(self.data)
        if at > have and have < self.size:
            self.file.seek(have)
            more = self.file.read(min(max(at - have, 1 << 20), self.size - have))
            if not more:
                raise EOFError(f"the archive ends at {have}, before its {self.size} bytes")
            self.data += more
        return self.base + len(self.data) >= min(at, self.size)

    def forget(self, at: int) -> None:
        if at - self.base > 1 << 20:
            del self.data[: at - self.base]
            self.base = at

    def records(self):
        at = self.base
        whole = at == 0  # whether a member has to begin right here
        while at < self.end:
            self.forget(at)
            self.upto(min(self.end, at + (1 << 20)) + PROBE)
            k = self.data.find(MAGIC, at - self.base)
            if k < 0:
                if whole:
                    raise ValueError(f"bytes at {at} belong to no member")
                at = max(at, self.base + len(self.data) - len(MAGIC) + 1)
                if self.base + len(self.data) >= self.size:
                    return
                continue
            if whole and k != at - self.base:
                raise ValueError(f"bytes at {at} belong to no member")
            at = self.base + k
            if at >= self.end:
                return
            got = self.member(at)
            if got is None:
                if whole:
                    raise ValueError(f"no record begins at {at}")
                at += 1
            else:
                at, content = got
                whole = True
                yield content

    def member(self, at: int):
        """(end, content) of the member that begins here, or None if none does; an error if one begins well and doesn't end."""
        self.upto(at + PROBE)
        z = zlib.decompressobj(31)
        try:
            out = z.decompress(self.data[at - self.base : at - self.base + PROBE])
        except zlib.error:
            # a damaged first block, if the version line came out of it; else chance
            if not self._begins(at):
                return None
            raise ValueError(f"the member at {at} is damaged") from None
        if not out.startswith((b"WARC/1.0\r\n", b"WARC/1.1\r\n")):
            return None
        parts, fed = [out], min(at + PROBE, self.base + len(self.data))
        try:
            while not z.eof:
                if fed >= self.size:
                    raise ValueError(f"the archive ends inside the member at {at}")
                self.upto(fed + (1 << 18))
                parts.append(z.decompress(self.data[fed - self.base : fed - self.base + (1 << 18)]))
                fed = min(fed + (1 << 18), self.base + len(self.data))
        except zlib.error as fault:
            raise ValueError(f"the member at {at} is damaged: {fault}") from None
        end = fed - len(z.unused_data)
        self.upto(end + len(MAGIC))
        if end < self.size and self.data[end - self.base : end - self.base + len(MAGIC)] != MAGIC:
            raise ValueError(f"bytes at {end} belong to no member")
        return end, b"".join(parts)

    def _begins(self, at: int) -> bool:
        """Whether a version line inflates from the first bytes, fed one by one."""
        z, out = zlib.decompressobj(31), b""
        for k in range(at - self.base, min(at - self.base + PROBE, len(self.data))):
            try:
                out += z.decompress(self.data[k : k + 1])
            except zlib.error:
                break
            if len(out) >= 10:
                break
        return out.startswith((b"WARC/1.0\r\n", b"WARC/1.1\r\n"))


def parse(content: bytes) -> dict:
    head, _, block = content.partition(b"\r\n\r\n")
    fields = {}
    for line in head.split(b"\r\n")[1:]:
        name, _, value = line.partition(b":")
        fields[name.strip().lower().decode("latin-1")] = value.strip().decode("utf-8", "replace")
    block = block[: int(fields["content-length"])]
    http, _, payload = block.partition(b"\r\n\r\n")
    length = next((int(x.split(b":")[1]) for x in http.split(b"\r\n") if x.lower().startswith(b"content-length:")), 0)
    page = lambda v: int(v) if (v := v.removeprefix("<urn:page:").removesuffix(">")) else None
    digest = fields["warc-payload-digest"].removeprefix("sha1:")
    revisit = fields["warc-type"] == "revisit"
    if not revisit:
        length, found = len(payload), digest_of(payload)
        if found != digest:
            raise ValueError(f"payload digest {found} differs from the header's {digest}")
    return {"page_id": page(fields["warc-record-id"]), "url": fields.get("warc-target-uri"), "record_type": fields["warc-type"], "refers_to": page(fields["warc-refers-to"]) if revisit else None, "payload_bytes": length, "payload_digest": digest, "payload": None if revisit else payload}


def missing_records(manifest: DataFrame, back: DataFrame) -> int:
    """How many records the manifest counts and the table of read ones lacks."""
    return (manifest.agg(F.sum("records")).first()[0] or 0) - back.count()


def read_archives(manifest: DataFrame, range_bytes: int = RANGE_BYTES, with_payload: bool = False) -> DataFrame:
    """The records of the archives in `manifest` (path, bytes)."""
    spark = manifest.sparkSession
    ranges = manifest.where("bytes > 0").select("path", "bytes", F.explode(F.sequence(F.lit(0).cast("long"), F.col("bytes") - 1, F.lit(range_bytes).cast("long"))).alias("start"))
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    schema = pa.schema([("page_id", pa.int64()), ("url", pa.string()), ("record_type", pa.string()), ("refers_to", pa.int64()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()), *([("payload", pa.binary())] if with_payload else [])])

    def read(batches):
        from pyarrow import fs

        for b in batches:
            for path, size, start in zip(b.column("path").to_pylist(), b.column("bytes").to_pylist(), b.column("start").to_pylist(), strict=True):
                store, base = fs.FileSystem.from_uri(path)
                with store.open_input_file(base) as f:
                    rows, held = [], 0
                    for content in RangeReader(f, start, min(start + range_bytes, size), size).records():
                        rows.append(parse(content))
                        held += len(content) if with_payload else 200
                        if held > 8 << 20:
                            yield pa.RecordBatch.from_pylist(rows, schema)
                            rows, held = [], 0
                    if rows:
                        yield pa.RecordBatch.from_pylist(rows, schema)

    return ranges.repartition(parts).mapInArrow(read, RECORDS + ", payload binary" * with_payload)


def round_trip(pages: DataFrame, min_bytes: int = MIN_BYTES) -> DataFrame:
    """Writes the pages as archives, reads them back and removes them."""
    spark: SparkSession = pages.sparkSession
    folder = new_path(spark, "warc")
    try:
        manifest = write_archives(with_revisits(pages, min_bytes), folder)
        back = materialize(read_archives(manifest), "warc-records")
        if lost := missing_records(manifest, back):
            raise ValueError(f"{lost} records of the manifest were not read back")
    finally:
        remove_path(spark, folder)
    return back
