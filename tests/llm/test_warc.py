from __future__ import annotations

import base64
import gzip
import hashlib
from collections import defaultdict
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from larkspur.llm.warc import manifest, parsed, read_archives, shard_of, write_archives

HTML = ["<p>a</p>", "<p>b</p>", "<p>a</p>", None, "", "<p>é漢\r\n\r\nx</p>", "<p>a</p>", "long " * 40_000, "x"]


@pytest.fixture()
def pages(spark):
    rows = [(i * 3, f"http://h/{i} x\r\ny", h, "u", "v", 1) for i, h in enumerate(HTML * 3)] + [(None, None, "null id", "u", "v", 1), (6, "http://h", "<p>a</p>", "u", "v", 1), (72, None, None, "u", "v", 1), (-5, "u", "neg", None, None, None)]
    return spark.createDataFrame(rows, "page_id long, url string, html string, _rid string, _id string, payload int").repartition(4)


def brute(rows, least=0):
    groups = defaultdict(list)
    for r in rows:
        groups[r.html or ""].append(r.page_id)
    out = []
    for h, ids in groups.items():
        raw = h.encode()
        ids = sorted(ids, key=lambda x: (x is not None, x or 0))
        sha = base64.b32encode(hashlib.sha1(raw).digest()).decode()
        for k, i in enumerate(ids):
            last = k == len(ids) - 1 or len(raw) < least
            out.append((i, len(raw), sha, "response" if last else "revisit", None if last else ids[-1]))
    return out


@pytest.mark.parametrize("least", [0, 5])
def test_round_trip(spark, pages, tmp_path, least):
    write_archives(pages, f"file://{tmp_path}/w", least=least, shard_bytes=10_000, roll=3000)
    got = read_archives(spark, f"file://{tmp_path}/w").collect()
    assert sorted(map(str, ((r.page_id, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to) for r in got))) == sorted(map(str, brute(pages.collect(), least)))
    for r in got:
        assert (r.payload is None) == (r.record_type == "revisit")
        if r.payload is not None:
            assert base64.b32encode(hashlib.sha1(bytes(r.payload)).digest()).decode() == r.payload_digest


def test_files(spark, pages, tmp_path):
    """Reruns, over other partitions, write the same bytes; files roll; records of a shard stand in order; orphans are not read."""
    for name, n in (("a", 4), ("b", 7)):
        write_archives(pages.repartition(n), f"file://{tmp_path}/{name}", shard_bytes=5000, roll=2000)
    files = lambda name: {p.name: p.read_bytes() for p in Path(tmp_path, name).glob("*.warc.gz")}
    a, b = files("a"), files("b")
    assert a == b
    assert len(a) > 5 and len({n.split("-")[1] for n in a}) < len(a)
    rows = {r.file: r for r in manifest(spark, f"file://{tmp_path}/a").collect()}
    assert rows.keys() == a.keys()
    for name, raw in a.items():
        assert rows[name].bytes == len(raw) and rows[name].sha256 == hashlib.sha256(raw).hexdigest()
        with open(tmp_path / "a" / name, "rb") as f:
            records = list(parsed(f))
        assert records[0][0]["warc-type"] == "warcinfo" and len(records) - 1 == rows[name].records
        ids = [int(h["x-page-id"]) for h, _ in records[1:] if "x-page-id" in h]
        assert ids == sorted(ids)
        assert gzip.decompress(raw).startswith(b"WARC/1.1\r\n")
    (tmp_path / "a" / ".shard-x.warc.gz.tmp").write_bytes(b"left over")
    (tmp_path / "a" / "shard-orphan.warc.gz").write_bytes(b"left over")
    assert read_archives(spark, f"file://{tmp_path}/a").count() == pages.count()


def test_damage_is_seen(spark, pages, tmp_path):
    write_archives(pages, f"file://{tmp_path}/d")
    name = next(Path(tmp_path, "d").glob("shard-0*.warc.gz"))
    raw = bytearray(gzip.decompress(name.read_bytes()))
    raw[raw.index(b"<p>b</p>") + 3] ^= 1
    name.write_bytes(gzip.compress(bytes(raw)))
    with pytest.raises(Exception, match="digest"):
        read_archives(spark, f"file://{tmp_path}/d").collect()


def test_empty(spark, pages, tmp_path):
    assert write_archives(pages.limit(0), f"file://{tmp_path}/e").collect() == []
    assert read_archives(spark, f"file://{tmp_path}/e").collect() == []


def test_few_files_for_sparse_ids(spark, tmp_path):
    """Shards go by bytes, whatever the ids; a hot id without a value is cut up too."""
    rows = spark.range(400).selectExpr("if(id % 3 = 0, null, id * 1000000007) as page_id", "concat('http://h/', id) as url", "repeat(sha2(cast(id as string), 256), 40) as html")
    write_archives(rows, f"file://{tmp_path}/s", shard_bytes=200_000, roll=1 << 20)
    names = sorted(r.file for r in manifest(spark, f"file://{tmp_path}/s").collect())
    assert 5 <= len(names) <= 8
    got = read_archives(spark, f"file://{tmp_path}/s")
    assert got.rdd.getNumPartitions() == 1 and got.count() == 400 and got.where("page_id is null").count() == 134


def test_shard_of(spark):
    keys = [(None, -5), (None, 7), (3, 1), (3, 9), (8, -2)]
    some = [(None, -9), (None, -5), (None, 6), (None, 7), (0, 0), (3, 0), (3, 1), (3, 8), (3, 9), (8, -3), (8, -2), (99, 99)]
    rows = spark.createDataFrame([(k, *x) for k, x in enumerate(some)], "k int, i long, p long")
    got = {r.k: r.s for r in rows.select("k", shard_of(keys, F.col("i"), F.col("p")).alias("s")).collect()}
    order = lambda x: (x[0] is not None, x[0] or 0, x[1])
    assert got == {k: max(0, sum(order(y) <= order(x) for y in keys) - 1) for k, x in enumerate(some)}
