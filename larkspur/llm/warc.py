"""Deterministic sharded WARC writer and its reader.

Records are range-sorted by id, then by a hash of url and payload. A shard is a run of about equal bytes in that order: the running sum of
sizes, not a sample, says where one ends, so shards depend on no partitioning, and sparse ids make no more of them. Their first keys (MOST_SHARDS at
most) are looked up for each record by bisection. Within a shard records are written in order, a gzip member each, to files that roll at
`roll` compressed bytes. Headers and digests are made anew from url, payload and a fixed date, so a rerun writes the same bytes. A file is
written under a temporary name and renamed when whole; the manifest, written last, names the files that count, so what a
lost executor leaves behind is never read. Of records with equal payloads of at least `least` bytes, the one with
the largest id is a response and the others revisit it; a payload of over 1 / 4,096 of all rows is joined by broadcast.
Archives are read by tasks of about READ compressed bytes each.

Defined results: a null payload is empty; a null url is written as an empty target; rows without an id come first; of rows with the same id
and payload one is the response; a very long payload is a record of its own size, in memory once; rows of the same id, url and payload share a
shard; an empty table gives an empty manifest; other columns are not read, whatever their names. The folder must be one that pyarrow.fs
reaches from every executor.
"""

from __future__ import annotations

import base64
import contextlib
import gzip
import hashlib
import json
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyarrow import fs as pafs
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from larkspur.llm.common import checkpointed, joined_hot, record_batch, settled, with_rid

#: Bytes of a shard before compression at least, and shards at most; bytes that a record counts beside its payload.
SHARD, MOST_SHARDS, HEADERS = 32 << 20, 1 << 16, 512
#: Compressed bytes at which a file rolls at least; a larger shard rolls at a sixteenth of its bytes.
ROLL = 4 << 20
#: Compressed bytes that a task reads, about.
READ = 8 << 20
DATE = "2024-01-01T00:00:00Z"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
MANIFEST = "file string, shard long, seq int, records long, bytes long, sha256 string"
BATCH_BYTES = 8 << 20


def digest(data: bytes) -> str:
    return base64.b32encode(hashlib.sha1(data).digest()).decode()


def record_id(*parts: object) -> str:
    return f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, chr(0).join(map(str, parts)))}>"


def record(kind: str, own_id: str, date: str, block: bytes, extra: list[tuple[str, str]]) -> bytes:
    """A record as a gzip member."""
    content = "application/warc-fields" if kind == "warcinfo" else "application/http; msgtype=response"
    head = [("WARC-Type", kind), ("WARC-Record-ID", own_id), ("WARC-Date", date), ("WARC-Block-Digest", f"sha1:{digest(block)}"), *extra, ("Content-Type", content), ("Content-Length", str(len(block)))]
    squeeze = zlib.compressobj(6, zlib.DEFLATED, 31)
    raw = b"WARC/1.1\r\n" + "".join(f"{k}: {v}\r\n" for k, v in head).encode() + b"\r\n" + block + b"\r\n\r\n"
    return squeeze.compress(raw) + squeeze.flush()


def page_record(page: object, url: str, payload: bytes, refers_to: tuple[object] | None, place: int, nth: int, date: str) -> bytes:
    """nth: of rows of a shard with this id. refers_to: the id of the response, for a revisit."""
    http, sha = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode(), digest(payload)
    extra = [("WARC-Target-URI", "".join(url.split())), ("WARC-Payload-Digest", f"sha1:{sha}"), ("X-Payload-Length", str(len(payload)))]
    if page is not None:
        extra.append(("X-Page-Id", str(page)))
    if refers_to is None:
        return record("response", record_id(page, sha), date, http + payload, extra)
    extra += [("WARC-Profile", PROFILE), ("WARC-Refers-To", record_id(refers_to[0], sha))]
    if refers_to[0] is not None:
        extra.append(("X-Refers-To-Page-Id", str(refers_to[0])))
    return record("revisit", record_id(page, sha, "revisit", place, nth), date, http, extra)


class Shard:
    """The files of one shard, in turn."""

    def __init__(self, folder: str, shard: int, date: str, roll: int):
        self.store, self.path = pafs.FileSystem.from_uri(folder)
        self.shard, self.date, self.roll, self.seq, self.out = shard, date, roll, 0, None

    def add(self, member: bytes) -> list[tuple]:
        done = self.close() if self.out and self.bytes + len(member) > self.roll else []
        if not self.out:
            self.name = f"shard-{self.shard:016d}-{self.seq:05d}.warc.gz"
            self.temporary = f"{self.path}/.{self.name}.{uuid.uuid4().hex}"
            self.out, self.sha, self.bytes, self.records = self.store.open_output_stream(self.temporary, compression=None), hashlib.sha256(), 0, 0
            self.put(record("warcinfo", record_id("warcinfo", self.name), self.date, b"software: larkspur\r\nformat: WARC File Format 1.1\r\n", [("WARC-Filename", self.name)]))
        self.put(member)
        self.records += 1
        return done

    def put(self, data: bytes) -> None:
        self.out.write(data)
        self.sha.update(data)
        self.bytes += len(data)

    def close(self) -> list[tuple]:
        if not self.out:
            return []
        self.out.close()
        final = f"{self.path}/{self.name}"
        try:
            self.store.move(self.temporary, final)
        except OSError:  # another attempt of this task has put the same bytes there
            if self.store.get_file_info(final).size != self.bytes:
                raise
            with contextlib.suppress(OSError):
                self.store.delete_file(self.temporary)
        self.out, self.seq = None, self.seq + 1
        return [(self.name, self.shard, self.seq - 1, self.records, self.bytes, self.sha.hexdigest())]


def first_keys(marks: DataFrame, shard_bytes: int) -> tuple[list[tuple], int]:
    """marks: _id, _place, _n. The first key (_id, _place) of each shard, in order, and the bytes of a shard."""
    spark = marks.sparkSession
    total = marks.agg(F.sum(F.col("_n") + HEADERS)).first()[0] or 0
    step = max(shard_bytes, -(-total // MOST_SHARDS))
    keys = marks.groupBy("_id", "_place").agg(F.sum(F.col("_n") + HEADERS).alias("_bytes"))
    dealt = checkpointed(keys.repartitionByRange(F.col("_id").asc_nulls_first(), "_place").withColumn("_part", F.spark_partition_id()))
    starts, start = [], 0
    for part, size in dealt.groupBy("_part").agg(F.sum("_bytes")).orderBy("_part").collect():  # a row for each partition
        starts.append((part, start))
        start += size
    offsets = spark.createDataFrame(starts, "_part int, _start long")
    before = Window.partitionBy("_part").orderBy(F.col("_id").asc_nulls_first(), "_place")
    upto = F.sum("_bytes").over(before) - F.col("_bytes") + F.col("_start")
    shard = F.floor(upto / step).alias("_shard")
    found = dealt.join(F.broadcast(offsets), "_part").select("_id", "_place", shard).groupBy("_shard").agg(F.min(F.struct("_id", "_place")).alias("_first"))
    return [(r["_first"]["_id"], r["_first"]["_place"]) for r in found.orderBy("_shard").collect()], step


def shard_of(keys: list[tuple], id_: Column, place: Column) -> Column:
    """The last of the keys (from 0) that is not after (id_, place), by bisection."""
    kind = "array<struct<i:bigint,p:bigint>>"
    known = F.from_json(F.lit(json.dumps([{"i": i, "p": p} for i, p in keys])), kind)
    own = F.struct(id_.alias("i"), place.alias("p"))
    steps = [1 << k for k in range(max(1, len(keys).bit_length()) - 1, -1, -1)]
    later = lambda at, step: F.when(F.get(known, (at + step).cast("int")) <= own, at + step).otherwise(at)
    return F.aggregate(F.array(*map(F.lit, steps)), F.lit(0), later).cast("long")


def write_archives(pages: DataFrame, folder: str, id_col: str = "page_id", url_col: str = "url", payload_col: str = "html", least: int = 0, date: str = DATE, roll: int | None = None, shard_bytes: int = SHARD) -> DataFrame:
    """Writes a record for each row of pages under folder. Gives the manifest, which has been committed there."""
    spark = pages.sparkSession
    rows = with_rid(settled(pages).select(F.col(id_col).cast("long").alias("_id"), F.col(url_col).alias("_url"), F.coalesce(F.col(payload_col), F.lit("")).alias("_payload")))
    sha, place = F.sha1(F.col("_payload").cast("binary")), F.xxhash64("_url", "_payload")
    marks = checkpointed(rows.select("_rid", "_id", sha.alias("_sha"), place.alias("_place"), F.octet_length("_payload").alias("_n")))
    keys, step = first_keys(marks, shard_bytes)
    roll = roll or max(ROLL, step // 16)
    shard = shard_of(keys, F.col("_id"), F.col("_place")).alias("_shard")
    n_rows, alike = marks.count(), ["_sha", "_n"]
    groups = checkpointed(marks.where(F.col("_n") >= least).groupBy(*alike).agg(F.count(F.lit(1)).alias("_size"), F.max(F.struct("_id", "_place", "_rid")).alias("_top")).where("_size > 1"))
    copies = joined_hot(marks, groups, alike, "_size", n_rows)
    verdicts = copies.where(F.col("_rid") != F.col("_top._rid")).select(shard, "_id", "_place", "_sha", "_rid", F.lit(0).alias("_kind"), F.col("_top._id").alias("_refers"), F.lit(None).cast("string").alias("_url"), F.lit(None).cast("string").alias("_payload"))
    bodies = rows.withColumn("_place", place).select(shard, "_id", "_place", sha.alias("_sha"), "_rid", F.lit(1).alias("_kind"), F.lit(None).cast("long").alias("_refers"), "_url", "_payload")
    # A row's verdict, if it is a revisit, comes right before it: payloads are shuffled once, and not joined.
    sorted_rows = bodies.unionByName(verdicts).repartitionById(max(1, len(keys)), F.col("_shard").cast("int")).sortWithinPartitions("_shard", "_id", "_place", "_sha", "_rid", "_kind").drop("_sha")
    spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).mkdirs(spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder))

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, verdict, last, nth, done = None, None, None, 0, []
        for b in batches:
            for s, page, place, rid, kind, refers, url, payload in zip(*(b.column(i) for i in range(8)), strict=True):
                rid = rid.as_py()
                if not kind.as_py():
                    verdict = (rid, refers.as_py())
                    continue
                s, page = s.as_py(), page.as_py()
                if now is None or now.shard != s:
                    done += now.close() if now else []
                    now, last = Shard(folder, s, date, roll), None
                nth, last = (nth + 1 if last == page else 0), page
                to = (verdict[1],) if verdict and verdict[0] == rid else None
                done += now.add(page_record(page, url.as_py() or "", payload.as_py().encode("utf-8", "surrogatepass"), to, place.as_py(), nth, date))
        done += now.close() if now else []
        columns = list(zip(*done, strict=True)) if done else [[]] * 6
        yield record_batch(**{f.name: pa.array(c, f.type) for f, c in zip(SCHEMA, columns, strict=True)})

    sorted_rows.mapInArrow(write, MANIFEST).write.mode("overwrite").json(f"{folder}/manifest")
    return manifest(spark, folder)


SCHEMA = pa.schema([("file", pa.string()), ("shard", pa.int64()), ("seq", pa.int32()), ("records", pa.int64()), ("bytes", pa.int64()), ("sha256", pa.string())])


def manifest(spark: SparkSession, folder: str) -> DataFrame:
    return spark.read.schema(MANIFEST).json(f"{folder}/manifest")


def parsed(stream) -> Iterator[tuple[dict[str, str], bytes]]:
    """Headers (lower-cased names) and block of each record of an archive."""
    with gzip.GzipFile(fileobj=stream) as f:
        while line := f.readline():
            if not line.strip():
                continue
            if not line.startswith(b"WARC/1."):
                raise ValueError(f"not a WARC record: {line[:60]!r}")
            head = {}
            while (line := f.readline()).strip():
                k, _, v = line.decode().partition(":")
                head[k.strip().lower()] = v.strip()
            block = f.read(int(head["content-length"]))
            if len(block) != int(head["content-length"]):
                raise ValueError("the archive ends within a record")
            yield head, block


def read_archives(spark: SparkSession, folder: str, payloads: bool = True) -> DataFrame:
    """page_id, url, payload_bytes, payload_digest, record_type, refers_to and payload (null in revisits, or if not asked for)."""
    files = manifest(spark, folder).select("file", "bytes")

    def batch(rows: list[tuple]) -> pa.RecordBatch:
        kinds = (pa.int64(), pa.string(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.binary())
        names = ("page_id", "url", "payload_bytes", "payload_digest", "record_type", "refers_to", "payload")
        return record_batch(**{n: pa.array(c, k) for n, k, c in zip(names, kinds, zip(*rows, strict=True), strict=True)})

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, path = pafs.FileSystem.from_uri(folder)
        for b in batches:
            for name in b.column(0).to_pylist():
                rows, held = [], 0
                with store.open_input_stream(f"{path}/{name}", compression=None) as stream:
                    for head, block in parsed(stream):
                        kind = head["warc-type"]
                        if digest(block) != head["warc-block-digest"].removeprefix("sha1:"):
                            raise ValueError(f"{name}: the block digest of {head['warc-record-id']} is wrong")
                        if kind == "warcinfo":
                            continue
                        sha = head["warc-payload-digest"].removeprefix("sha1:")
                        payload = block.partition(b"\r\n\r\n")[2] if kind == "response" else None
                        if payload is not None and digest(payload) != sha:
                            raise ValueError(f"{name}: the payload digest of {head['warc-record-id']} is wrong")
                        number = lambda k: int(head[k]) if k in head else None  # noqa: B023, E731
                        rows.append((number("x-page-id"), head["warc-target-uri"], int(head["x-payload-length"]), sha, kind, number("x-refers-to-page-id"), payload if payloads else None))
                        held += len(payload or b"") * payloads + 200
                        if held > BATCH_BYTES:
                            yield batch(rows)
                            rows, held = [], 0
                if rows:
                    yield batch(rows)

    n, size = files.agg(F.count(F.lit(1)), F.sum("bytes")).first()
    tasks = max(1, min(n, -(-(size or 0) // READ)))
    return files.repartition(tasks).mapInArrow(read, "page_id long, url string, payload_bytes long, payload_digest string, record_type string, refers_to long, payload binary")
