"""WARC archives with a two-level capture index.

Pages are dealt by ranges of their reversed-host key (no host is too large: the key ends
in the page id). A task writes one archive of gzip members, a capture index of key,
offset, length and page id lines in gzip blocks of `block` lines, and a sparse directory
with each block's first key and range. A lookup binary-searches the directory, reads one
block, binary-searches its keys and range-reads one record.

Records with equal payloads of at least `least` bytes: the smallest page_id is the
response, the others are revisits of it.

Null html is an empty payload; a null url has an empty key; a null page_id sorts first
and is never another record's response if any page of that payload has an id. Repeated
rows are written each. An empty table gives an empty manifest; other columns are ignored.
"""

from __future__ import annotations

import gzip
import hashlib
import struct
import zlib
from bisect import bisect_left, bisect_right

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import MB, arrow_schema, batch, shared_dir, table, tune
from .storage import open_file, write_file

MANIFEST = "part int, file string, index_file string, n_records long, first_key string, last_key string"
RESULT = "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long"
TAIL = "<qq8s"
TAIL_SIZE = struct.calcsize(TAIL)
DATE = "2024-01-01T00:00:00Z"


def host_key(url):
    """Column: host labels from the top domain down, then path and query; scheme, user, port 80/443 and fragment go."""
    rest = F.regexp_replace(F.regexp_replace(F.coalesce(url, F.lit("")), r"^[A-Za-z][A-Za-z0-9+.-]*://", ""), r"#.*$", "")
    host = F.regexp_replace(F.regexp_replace(F.lower(F.regexp_extract(rest, r"^([^/?]*)", 1)), r"^.*@", ""), r":(80|443)$", "")
    return F.concat(F.array_join(F.reverse(F.split(host, r"\.")), ","), F.lit(")"), F.regexp_extract(rest, r"^[^/?]*(.*)$", 1))


def record(page_id, url: str, payload: bytes, digest: str, refers_to) -> bytes:
    """One WARC record as a gzip member; a revisit keeps the HTTP head, without the payload."""
    revisit = refers_to is not None
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    body = http if revisit else http + payload
    lines = ["WARC/1.1", f"WARC-Type: {'revisit' if revisit else 'response'}", f"WARC-Record-ID: <urn:page:{'' if page_id is None else page_id}>", f"WARC-Date: {DATE}",
             f"WARC-Target-URI: {' '.join(url.split())}", f"WARC-Payload-Digest: sha256:{digest}", "Content-Type: application/http; msgtype=response"]
    if revisit:
        lines += [f"WARC-Refers-To: <urn:page:{refers_to}>", "WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"]
    lines.append(f"Content-Length: {len(body)}")
    return gzip.compress("\r\n".join(lines).encode() + b"\r\n\r\n" + body + b"\r\n\r\n", 6, mtime=0)


def parse(member: bytes) -> tuple:
    """(page_id, payload_bytes, payload_digest, record_type, refers_to); a response's payload is digested anew."""
    raw = zlib.decompress(member, 31)
    head, rest = raw.split(b"\r\n\r\n", 1)
    fields = dict(x.split(": ", 1) for x in head.decode().split("\r\n")[1:])
    body = rest[: int(fields["Content-Length"])]
    http, payload = body.split(b"\r\n\r\n", 1)
    size = next(int(x.split(b":")[1]) for x in http.split(b"\r\n") if x.startswith(b"Content-Length:"))
    number = lambda x: int(x[10:-1]) if x and x != "<urn:page:>" else None
    digest = fields["WARC-Payload-Digest"].removeprefix("sha256:")
    kind = fields["WARC-Type"]
    if kind == "response":
        if len(payload) != size or hashlib.sha256(payload).hexdigest() != digest:
            raise ValueError(f"record {fields['WARC-Record-ID']} is damaged")
    return number(fields["WARC-Record-ID"]), size, digest, kind, number(fields.get("WARC-Refers-To"))


class CaptureIndex:
    """Blocks of lines 'key TAB page_id TAB offset TAB length' behind a sparse directory."""

    def __init__(self, folder: str, name: str):
        self.file = open_file(folder, name)
        at, size, magic = struct.unpack(TAIL, self.file.read_at(TAIL_SIZE, self.file.size() - TAIL_SIZE))
        if magic != b"CAPIDX01":
            raise ValueError(f"{name}: not a capture index")
        rows = [x.split("\t") for x in gzip.decompress(self.file.read_at(size, at)).decode().split("\n") if x]
        self.keys, self.ranges = [r[0] for r in rows], [(int(r[1]), int(r[2])) for r in rows]

    @staticmethod
    def write(folder: str, name: str, lines: list[tuple], block: int) -> str:
        parts, directory, at = [], [], 0
        for k in range(0, len(lines), block):
            part = gzip.compress("\n".join("\t".join(map(str, x)) for x in lines[k : k + block]).encode(), 6, mtime=0)
            directory.append(f"{lines[k][0]}\t{at}\t{len(part)}")
            parts.append(part)
            at += len(part)
        top = gzip.compress("\n".join(directory).encode(), 6, mtime=0)
        return write_file(folder, name, [*parts, top, struct.pack(TAIL, at, len(top), b"CAPIDX01")])

    def block(self, k: int) -> list[list[str]]:
        at, size = self.ranges[k]
        return [x.split("\t") for x in gzip.decompress(self.file.read_at(size, at)).decode().split("\n")]

    def find(self, key: str) -> list[tuple[str, int, int]]:
        """(page id, offset, length) of every capture of a key; its lines may go over several blocks."""
        out, k = [], max(0, bisect_left(self.keys, key) - 1)
        while k < len(self.keys) and self.keys[k] <= key:
            rows = self.block(k)
            keys = [r[0] for r in rows]
            out += [(r[1], int(r[2]), int(r[3])) for r in rows[bisect_left(keys, key) : bisect_right(keys, key)]]
            k += 1
        return out


def revisits(rows: DataFrame, n_rows: int, most_hot: int = 2_000) -> DataFrame:
    """(key, page_id, digest, refers_to) of each record that revisits another.

    Digests with over n_rows / most_hot copies number fewer than `most_hot`: that bounded set is
    broadcast, so no task gets all copies of one; the others are joined by digest.
    """
    thin = rows.select("key", "page_id", "digest")
    first = table(rows.groupBy("digest").agg(F.min("page_id").alias("first_id"), F.count("*").alias("n")).where("n > 1"))
    hot = F.broadcast(first.where(F.col("n") > n_rows // most_hot + 1).select("digest", "first_id"))
    cold = first.where(F.col("n") <= n_rows // most_hot + 1).select("digest", "first_id")
    found = thin.join(hot, "digest").unionByName(thin.join(hot.select("digest"), "digest", "left_anti").join(cold, "digest"))
    return found.where("first_id is not null and (page_id is null or page_id <> first_id)").select("key", "page_id", "digest", F.col("first_id").alias("refers_to")).distinct()


def write(pages: DataFrame, folder: str | None = None, least: int = 100, part_bytes: int = 8 * MB, block: int = 512) -> tuple[str, DataFrame]:
    """Archives and indexes of all pages; (folder, manifest)."""
    spark = pages.sparkSession
    folder = folder or shared_dir(spark)
    rows = (pages.select(F.col("page_id").cast("long"), F.coalesce("url", F.lit("")).alias("url"), F.coalesce(F.col("html"), F.lit("")).cast("binary").alias("payload"))
            .withColumn("digest", F.sha2("payload", 256)).withColumn("key", F.regexp_replace(host_key(F.col("url")), r"[\t\n\r]", "%20")))
    size, n_rows = rows.agg(F.coalesce(F.sum(F.octet_length("payload")), F.lit(0)), F.count("*")).first()
    parts = max(1, -(-int(size) // part_bytes))
    # payloads travel once: what a record revisits comes as a row of its own, sorted just before it
    notes = revisits(rows.where(F.octet_length("payload") >= least), n_rows).select("key", "page_id", "digest", F.lit(None).cast("string").alias("url"), F.lit(None).cast("binary").alias("payload"), "refers_to")
    ordered = (rows.select("key", "page_id", "digest", "url", "payload", F.lit(None).cast("long").alias("refers_to")).unionByName(notes)
               .repartitionByRange(parts, "key", "page_id").sortWithinPartitions("key", "page_id", "digest", F.col("refers_to").asc_nulls_last()))
    schema = arrow_schema(MANIFEST)

    def put(batches):
        from pyspark import TaskContext

        members, lines, at, note = [], [], 0, None
        for b in batches:
            for key, page, digest, url, payload, refers in zip(*(c.to_pylist() for c in b.columns)):
                if refers is not None:
                    note = (key, page, digest), refers
                    continue
                members.append(record(page, url, payload, digest, note[1] if note and note[0] == (key, page, digest) else None))
                lines.append((key, "" if page is None else page, at, len(members[-1])))
                at += len(members[-1])
        if lines:
            part = TaskContext.get().partitionId()
            name = write_file(folder, f"part-{part:06d}.warc.gz", members)
            yield batch(schema, [part], [name], [CaptureIndex.write(folder, f"part-{part:06d}.idx", lines, block)], [len(lines)], [lines[0][0]], [lines[-1][0]])

    tune(spark)
    return folder, table(ordered.mapInArrow(put, MANIFEST), f"{folder}/manifest")


def read(spark: SparkSession, folder: str, manifest: DataFrame) -> DataFrame:
    """(page_id, payload_bytes, payload_digest, record_type, refers_to) of every record, found through the index."""
    schema = arrow_schema(RESULT)

    def get(batches):
        for b in batches:
            for name, index_name in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                index, archive = CaptureIndex(folder, index_name), open_file(folder, name)
                for k in range(len(index.ranges)):
                    out = [parse(archive.read_at(int(n), int(at))) for _, _, at, n in index.block(k)]
                    yield batch(schema, *zip(*out))

    n = max(1, manifest.count())
    return manifest.select("file", "index_file").repartition(n, "file").mapInArrow(get, RESULT)


def look_up(folder: str, manifest: DataFrame, key: str) -> list[tuple]:
    """The records of one key: manifest, directory, block, range read."""
    rows = manifest.where((F.col("first_key") <= key) & (F.col("last_key") >= key)).select("file", "index_file").collect()
    return [parse(open_file(folder, f).read_at(n, at)) for f, i in rows for _, at, n in CaptureIndex(folder, i).find(key)]


def write_and_read(pages: DataFrame, **how) -> DataFrame:
    folder, manifest = write(pages, **how)
    return read(pages.sparkSession, folder, manifest)
