"""Deterministic, sharded WARC writer and reader.

Records are range-sorted by id, files roll by compressed size, headers and digests are made anew
from the payload, and files are committed by name and manifest:

* The id range is cut into equal cells, their bytes are counted (a fixed number of cells), and runs of
  cells become shards of about equal size. A cell that is too heavy is dealt further by hash. So the
  shard of a record depends on the table alone, not on sampling or on the number of tasks.
* A task writes its shards in order, one gzip member per record. A file is written under a temporary
  name of its own and renamed when it is complete. Names and bytes depend on the records only: a task
  that runs again after a lost executor, or twice, makes the same files.
* The manifest is a Parquet table that Spark commits once; readers open what it lists.

Of records with equal payloads the one with the largest id is the response; the others are revisits
that name it and carry no payload, only its length and digest.

Defined results for odd input: NULL html is an empty payload. A NULL id is written without an id and
read back as NULL; it is never the one that is referred to, unless all ids of a payload are NULL: then
all are responses. Rows that repeat the id and payload of a response are responses too. A NULL url is left out of the
header. Columns beyond the named ones are ignored. An empty table gives no files and an empty result.
"""

from __future__ import annotations

import base64
import hashlib
import re
import uuid
import zlib
from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from echoloom.llm.common import broadcast_if_small, stored
from echoloom.session import scratch_path

CELLS = 16_384
#: a shard holds about this many payload bytes; small tables get FEWEST shards
SHARD_BYTES = 256 << 20
FEWEST = 64
#: a file is closed when it has reached this many compressed bytes
ROLL_BYTES = 64 << 20
MIN_REVISIT_BYTES = 0
#: tasks that read archives back, at most; above, a task reads several files one after the other
MOST_TASKS = 20_000
DATE = "2024-01-01T00:00:00Z"
VERSION = b"WARC/1.1"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"


def base32_sha1(data: bytes) -> str:
    return base64.b32encode(hashlib.sha1(data).digest()).decode()


def _clean(value: str) -> str:
    """A header value on one line."""
    return re.sub(r"[\x00-\x1f\x7f]", lambda m: f"%{ord(m[0]):02X}", value)


def record_id(page_id, digest: str) -> str:
    return f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, f'{page_id}/{digest}')}>"


def record(page_id, url: str | None, payload: bytes, refers_to) -> bytes:
    """The bytes of one record before compression."""
    digest = base32_sha1(payload)
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = http + (payload if refers_to is None else b"")
    fields = [("WARC-Type", "response" if refers_to is None else "revisit"), ("WARC-Record-ID", record_id(page_id, digest)), ("WARC-Date", DATE)]
    if url is not None:
        fields.append(("WARC-Target-URI", _clean(url)))
    if page_id is not None:
        fields.append(("X-Page-ID", str(page_id)))
    if refers_to is not None:
        fields += [("WARC-Profile", PROFILE), ("WARC-Refers-To", record_id(refers_to, digest)), ("X-Refers-To-Page-ID", str(refers_to))]
    fields += [("WARC-Payload-Digest", f"sha1:{digest}"), ("WARC-Block-Digest", f"sha1:{base32_sha1(block)}"),
               ("Content-Type", "application/http; msgtype=response"), ("Content-Length", str(len(block)))]
    head = VERSION + b"\r\n" + "".join(f"{k}: {v}\r\n" for k, v in fields).encode()
    return head + b"\r\n" + block + b"\r\n\r\n"


def member(data: bytes) -> bytes:
    """One gzip member without a time stamp."""
    z = zlib.compressobj(5, zlib.DEFLATED, 31)
    return z.compress(data) + z.flush()


def _store(root: str):
    """File system and path of a folder that all executors share."""
    from pyarrow import fs

    return fs.FileSystem.from_uri(root) if "://" in root or root.startswith("file:") else (fs.LocalFileSystem(), root)


class ShardFiles:
    """Rolling files of a task."""

    def __init__(self, root: str, roll: int):
        self.fs, self.path = _store(root)
        self.roll, self.shard, self.seq, self.out = roll, None, 0, None

    def write(self, shard: int, page_id, data: bytes) -> Iterator[dict]:
        if self.out is not None and (shard != self.shard or self.size >= self.roll):
            yield self.close()
        if self.out is None:
            self.seq = self.seq + 1 if shard == self.shard else 0
            self.shard, self.size, self.records, self.sha = shard, 0, 0, hashlib.sha1()
            self.temporary = f"{self.path}/temporary/{uuid.uuid4().hex}"
            self.fs.create_dir(f"{self.path}/temporary")
            self.out = self.fs.open_output_stream(self.temporary, compression=None)
        packed = member(data)
        self.out.write(packed)
        self.sha.update(packed)
        self.size += len(packed)
        self.records += 1

    def close(self) -> dict:
        """Complete the open file and give it its name; the one of another attempt is equal, so either may stay."""
        self.out.close()
        self.out = None
        name = f"part-{self.shard:06d}-{self.seq:05d}.warc.gz"
        self.fs.create_dir(f"{self.path}/files")
        try:
            self.fs.move(self.temporary, f"{self.path}/files/{name}")
        except OSError:
            if self.fs.get_file_info(f"{self.path}/files/{name}").size != self.size:
                raise
            self.fs.delete_file(self.temporary)
        return {"file": name, "shard": self.shard, "n_records": self.records, "n_bytes": self.size, "sha1": self.sha.hexdigest()}


def with_shards(rows: DataFrame) -> DataFrame:
    """``rows`` (k, bytes, ...) with ``shard``; small driver work over at most CELLS cells."""
    spark = rows.sparkSession
    low, high = rows.agg(F.min("k"), F.max("k")).first()
    width = 1 if low is None else (int(high) - int(low)) // CELLS + 1
    cell = F.coalesce(F.floor((F.col("k") - F.lit(low or 0)) / width).cast("int"), F.lit(-1))
    counted = rows.groupBy(cell.alias("cell")).agg(F.sum(F.col("bytes") + 512).alias("b")).orderBy("cell").collect()
    target = max(1, min(SHARD_BYTES, -(-sum(r["b"] for r in counted) // FEWEST)))
    plan, shard, size = [], 0, 0
    for r in counted:
        ways = -(-r["b"] // (2 * target))
        if size and (ways > 1 or size + r["b"] > target):
            shard, size = shard + 1, 0
        plan.append((r["cell"], shard, ways))
        size += r["b"]
        if ways > 1:
            shard, size = shard + ways, 0
    cells = spark.createDataFrame(plan, "cell int, first int, ways int")
    dealt = F.col("first") + F.pmod(F.xxhash64("k", "url", "digest"), F.col("ways")).cast("int")
    return rows.withColumn("cell", cell).join(F.broadcast(cells), "cell").withColumn("shard", dealt).drop("cell", "first", "ways")


def write_archive(pages: DataFrame, root: str, id_col: str = "page_id", url: str = "url", html: str = "html", roll: int = ROLL_BYTES) -> DataFrame:
    """Write all rows below ``root`` and return the manifest (file, shard, n_records, n_bytes, sha1)."""
    import pyarrow as pa

    payload = F.coalesce(F.col(f"`{html}`"), F.lit(""))
    base = pages.select(F.col(f"`{id_col}`").cast("long").alias("k"), F.col(f"`{url}`").alias("url"), payload.alias("payload"),
                        F.sha1(payload.cast("binary")).alias("digest"), F.octet_length(payload).cast("long").alias("bytes"))
    # equal payloads: one row per digest with several records, sums before the shuffle
    several = base.filter(F.col("bytes") >= MIN_REVISIT_BYTES).groupBy("digest").agg(F.max("k").alias("keeper"), F.count(F.lit(1)).alias("n")).filter("n > 1")
    several = broadcast_if_small(stored(several.select("digest", "keeper"), "equal_payloads"))
    rows = with_shards(base).join(several, "digest", "left").withColumn("refers", F.when(~F.col("keeper").eqNullSafe(F.col("k")), F.col("keeper")))
    rows = rows.select("shard", "k", "url", "payload", "refers").repartition("shard").sortWithinPartitions("shard", "k", "url", "payload")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        files = ShardFiles(root, roll)
        for b in batches:
            for i in range(b.num_rows):
                shard, k, u, p, refers = (c[i].as_py() for c in b.columns)
                for done in files.write(shard, k, record(k, u, p.encode(), refers)):
                    yield pa.RecordBatch.from_pylist([done])
        if files.out is not None:
            yield pa.RecordBatch.from_pylist([files.close()])

    manifest = f"{root}/manifest"
    rows.mapInArrow(run, "file string, shard long, n_records long, n_bytes long, sha1 string").write.parquet(manifest)
    return pages.sparkSession.read.schema("file string, shard long, n_records long, n_bytes long, sha1 string").parquet(manifest)


def members(stream, size: int = 1 << 20) -> Iterator[bytes]:
    """The contents of the gzip members of a stream, one at a time."""
    z, parts = zlib.decompressobj(31), []
    data = stream.read(size)
    while data:
        parts.append(z.decompress(data))
        if z.eof:
            yield b"".join(parts)
            data, z, parts = z.unused_data or stream.read(size), zlib.decompressobj(31), []
        else:
            data = stream.read(size)
    if any(parts):
        raise ValueError("the file ends inside a record")


def parse(data: bytes) -> dict:
    """Fields of one record; digests and lengths are checked against the content."""
    head, _, rest = data.partition(b"\r\n\r\n")
    lines = head.decode().split("\r\n")
    if not lines[0].startswith("WARC/"):
        raise ValueError("not a WARC record")
    f = dict(x.split(": ", 1) for x in lines[1:])
    block = rest[:int(f["Content-Length"])]
    if f["WARC-Block-Digest"] != f"sha1:{base32_sha1(block)}":
        raise ValueError(f"block digest of {f['WARC-Record-ID']}")
    http, _, body = block.partition(b"\r\n\r\n")
    length = int(dict(x.split(": ", 1) for x in http.decode().split("\r\n")[1:])["Content-Length"])
    digest = f["WARC-Payload-Digest"].removeprefix("sha1:")
    if f["WARC-Type"] == "response" and (len(body) != length or base32_sha1(body) != digest):
        raise ValueError(f"payload of {f['WARC-Record-ID']}")
    number = lambda k: int(f[k]) if k in f else None
    return {"page_id": number("X-Page-ID"), "url": f.get("WARC-Target-URI"), "payload_bytes": length, "payload_digest": digest,
            "record_type": f["WARC-Type"], "refers_to": number("X-Refers-To-Page-ID"), "payload": body if f["WARC-Type"] == "response" else None}


def read_archive(spark: SparkSession, root: str, with_payload: bool = True) -> DataFrame:
    """One row per record of the files that the manifest lists: page_id, url, payload_bytes, payload_digest, record_type, refers_to, payload."""
    import pyarrow as pa

    files = spark.read.schema("file string, n_records long").parquet(f"{root}/manifest")
    columns = ["page_id long", "url string", "payload_bytes long", "payload_digest string", "record_type string", "refers_to long", *["payload binary"] * with_payload]
    kinds = {"long": pa.int64(), "string": pa.string(), "binary": pa.binary()}
    schema = pa.schema([(c.split()[0], kinds[c.split()[1]]) for c in columns])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, path = _store(root)
        for b in batches:
            for name, n in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                rows, size, seen = [], 0, 0
                with store.open_input_stream(f"{path}/files/{name}", compression=None) as stream:
                    for data in members(stream):
                        r = parse(data)
                        rows.append({c: r[c] for c in schema.names})
                        size, seen = size + 200 + len(data) * with_payload, seen + 1
                        if size > 4 << 20:
                            yield pa.RecordBatch.from_pylist(rows, schema)
                            rows, size = [], 0
                if seen != n:
                    raise ValueError(f"{name} has {seen} records, the manifest says {n}")
                yield pa.RecordBatch.from_pylist(rows, schema)

    # one file is one unit of work: without a number of its own, adaptive execution would merge the short list into one task
    n = max(1, min(files.count(), MOST_TASKS))
    return files.repartition(n, "file").mapInArrow(run, ", ".join(columns))


def round_trip(pages: DataFrame, id_col: str = "page_id", url: str = "url", html: str = "html") -> DataFrame:
    """Write the pages to a new folder of the shared scratch place, read them back, and give the columns without payloads."""
    root = scratch_path(pages.sparkSession, "llm-warc")
    write_archive(pages, root, id_col, url, html)
    back = read_archive(pages.sparkSession, root, with_payload=False)
    return back.select(F.col("page_id").alias(id_col), "payload_bytes", "payload_digest", "record_type", "refers_to")
