"""Exact deduplication by composable polynomial fingerprints.

A text is normalised by lower-casing A-Z only, and cut into chunks of bytes. The fingerprint of a chunk c of n
bytes is H(c) = sum (c[i] + 1) * x**(n - 1 - i) mod p, for two primes p. H(a + b) = H(a) * x**len(b) + H(b), so
chunks of a huge document are hashed in different tasks, and the sum of their length-shifted terms is the
document's fingerprint. Rows with equal fingerprint and length are compared chunk by chunk with the row that
would stay; rows that differ from it form further groups until none differs, so a collision never drops a text.

Defined results: a null text is the empty text; empty texts equal each other; of rows with the same id and equal
texts one stays; a null id is less than any other; a text of over HUGE bytes is hashed by several tasks; an empty table gives an empty
result. Other columns, whatever their names, are not read by exact_dedup and kept by drop_copies.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from larkspur.llm.common import ascii_lower, checkpointed, record_batch, rows_by_rid, settled, with_rid

PRIMES = (2147483647, 2147483629)
BASES = (1103515245, 1664525013)
CHUNK = 1 << 16
#: Documents above so many bytes are hashed by several tasks.
HUGE = 8 << 20
#: Members of one group that are compared with one copy of the text that stays.
PER_COPY = 256


def powers(base: int, prime: int, n: int) -> np.ndarray:
    """base**0 .. base**(n - 1) mod prime."""
    out, done = np.ones(n, dtype=np.uint64), 1
    while done < n:
        take = min(done, n - done)
        out[done : done + take] = out[:take] * np.uint64(pow(base, done, prime)) % np.uint64(prime)
        done += take
    return out


class Polynomial:
    def __init__(self, prime: int, base: int, chunk: int = CHUNK):
        self.prime, self.base, self.chunk = prime, base, chunk
        self.down = powers(base, prime, chunk)[::-1].copy()

    def of_chunk(self, data: np.ndarray) -> int:
        """data: bytes, as uint64 and one more each; at most a chunk."""
        return int(np.dot(data, self.down[self.chunk - len(data) :])) % self.prime

    def joined(self, left: int, right: int, right_len: int) -> int:
        return (left * pow(self.base, right_len, self.prime) + right) % self.prime

    def shifted(self, part: int, after: int) -> int:
        return part * pow(self.base, after, self.prime) % self.prime

    def of(self, data: np.ndarray) -> int:
        h = 0
        for i in range(0, len(data), self.chunk):
            part = data[i : i + self.chunk]
            h = self.joined(h, self.of_chunk(part), len(part))
        return h


def _spread(raw: bytes) -> np.ndarray:
    return np.frombuffer(raw, dtype=np.uint8).astype(np.uint64) + np.uint64(1)


def fingerprints(docs: DataFrame, huge: int = HUGE, chunk: int = CHUNK, primes: tuple[int, int] = PRIMES) -> DataFrame:
    """docs: _rid, _id, _text. Gives _rid, _id, _n (bytes), _f0, _f1 and _sha (lowercase hex SHA-256 of the normalised text)."""

    def whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes = [Polynomial(p, x, chunk) for p, x in zip(primes, BASES, strict=True)]
        for b in batches:
            n, f, sha = [], ([], []), []
            for t in b.column(2):
                raw = (t.as_py() or "").encode("utf-8", "surrogatepass").lower()
                n.append(len(raw))
                sha.append(hashlib.sha256(raw).hexdigest())
                data = _spread(raw) if len(raw) <= huge else None
                for k in (0, 1):
                    f[k].append(None if data is None else hashes[k].of(data))
            yield record_batch(_rid=b.column(0), _id=b.column(1), _n=pa.array(n, pa.int64()), _f0=pa.array(f[0], pa.int64()), _f1=pa.array(f[1], pa.int64()), _sha=pa.array(sha, pa.string()))

    def terms(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes = [Polynomial(p, x, chunk) for p, x in zip(primes, BASES, strict=True)]
        for b in batches:
            f = ([], [])
            for after, part in zip(b.column(1).to_pylist(), b.column(2).to_pylist(), strict=True):
                data = _spread(part.lower())
                for k in (0, 1):
                    f[k].append(hashes[k].shifted(hashes[k].of(data), after))
            yield record_batch(_rid=b.column(0), _g0=pa.array(f[0], pa.int64()), _g1=pa.array(f[1], pa.int64()))

    kind = dict(docs.dtypes)["_id"]
    small = docs.mapInArrow(whole, f"_rid long, _id {kind}, _n long, _f0 long, _f1 long, _sha string")
    bytes_ = F.col("_text").cast("binary")
    size = F.octet_length("_text")
    step = 16 * chunk
    parts = docs.where(size > huge).select("_rid", size.alias("_n"), F.posexplode(F.transform(F.sequence(F.lit(0), ((size - 1) / step).cast("int")), lambda i: F.substring(bytes_, i * step + 1, F.lit(step)))).alias("_i", "_part"))
    parts = parts.repartition("_rid", "_i").select("_rid", F.greatest(F.col("_n") - (F.col("_i") + 1) * step, F.lit(0)).cast("long"), "_part")
    sums = parts.mapInArrow(terms, "_rid long, _g0 long, _g1 long").groupBy("_rid").agg(*((F.sum(f"_g{k}") % primes[k]).alias(f"_g{k}") for k in (0, 1)))
    return small.join(sums, "_rid", "left").select("_rid", "_id", "_n", *(F.coalesce(f"_f{k}", f"_g{k}").alias(f"_f{k}") for k in (0, 1)), "_sha")


def _differing(docs: DataFrame, members: DataFrame, chunk: int) -> DataFrame:
    """_rid of the members (_rid, _rep, _copies) whose normalised text is not that of the row _rep, compared chunk by chunk.

    The text that stays is dealt to so many copies (_copies) as its group's size asks for, so no task gets a whole large group.
    """
    lowered = ascii_lower(F.coalesce("_text", F.lit(""))).cast("binary")
    chunks = F.posexplode(F.transform(F.sequence(F.lit(0), ((F.greatest(F.octet_length("_low"), F.lit(1)) - 1) / chunk).cast("int")), lambda i: F.substring(F.col("_low"), i * chunk + 1, F.lit(chunk)))).alias("_i", "_part")
    both = members.withColumn("_salt", F.pmod(F.xxhash64("_rid"), F.col("_copies")))
    reps = members.groupBy(F.col("_rep").alias("_rid")).agg(F.max("_copies").alias("_copies"))
    wanted = both.select("_rid", "_rep", F.array("_salt").alias("_salts"), F.lit(False).alias("_is_rep")).unionByName(reps.select("_rid", F.col("_rid").alias("_rep"), F.sequence(F.lit(0), F.col("_copies") - 1).cast("array<long>").alias("_salts"), F.lit(True).alias("_is_rep")))
    rows = docs.select("_rid", lowered.alias("_low")).join(wanted, "_rid").select("_rid", "_rep", "_salts", "_is_rep", chunks).withColumn("_salt", F.explode("_salts"))
    left = rows.where(~F.col("_is_rep")).select("_rid", "_rep", "_salt", "_i", "_part")
    right = rows.where("_is_rep").select("_rep", "_salt", "_i", F.col("_part").alias("_other"))
    return left.join(right, ["_rep", "_salt", "_i"]).where(F.col("_part") != F.col("_other")).select("_rid").distinct()


def classes(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", huge: int = HUGE, chunk: int = CHUNK, primes: tuple[int, int] = PRIMES) -> DataFrame:
    """A row for each row of docs: _rid, _id, _n, _sha, keep_id, group_size, kept."""
    docs = with_rid(settled(docs).select(F.col(id_col).alias("_id"), F.col(text_col).alias("_text"))).select("_rid", "_id", "_text")
    marks = checkpointed(fingerprints(docs, huge, chunk, primes))
    key = ["_n", "_f0", "_f1", "_round"]
    todo, found, turn = marks.select("_rid", "_id", "_n", "_f0", "_f1", F.lit(0).alias("_round")), None, 0
    while True:
        groups = todo.groupBy(*key).agg(F.count(F.lit(1)).alias("_size"), F.max(F.struct("_id", "_rid")).alias("_top")).where("_size > 1")
        copies: Column = F.ceil(F.col("_size") / PER_COPY)
        members = checkpointed(todo.join(groups, key).select("_rid", "_id", *key, F.col("_top._rid").alias("_rep"), F.col("_top._id").alias("_rep_id"), copies.alias("_copies")))
        wrong = checkpointed(_differing(docs, members.where("_rid != _rep").select("_rid", "_rep", "_copies"), 16 * chunk))
        same = members.join(wrong, "_rid", "left_anti")
        found = same if found is None else found.unionByName(same)
        if wrong.isEmpty():
            break
        turn += 1
        todo = members.join(wrong, "_rid", "left_semi").select("_rid", "_id", "_n", "_f0", "_f1", F.lit(turn).alias("_round"))
    sizes = found.groupBy("_rep").agg(F.count(F.lit(1)).alias("group_size"))
    placed = found.join(sizes, "_rep").select("_rid", F.col("_rep_id").alias("keep_id"), "group_size", (F.col("_rid") == F.col("_rep")).alias("kept"), F.lit(True).alias("_placed"))
    out = marks.join(placed, "_rid", "left")
    return out.select("_rid", "_id", "_n", "_sha", F.when(F.col("_placed"), F.col("keep_id")).otherwise(F.col("_id")).alias("keep_id"), F.coalesce("group_size", F.lit(1)).cast("long").alias("group_size"), F.coalesce("kept", F.lit(True)).alias("kept"))


def exact_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """id, keep_id (the id of the row that stays), group_size, kept and text_sha256 (of the normalised text) for each row."""
    return classes(docs, id_col, text_col, **options).select(F.col("_id").alias(id_col), "keep_id", "group_size", "kept", F.col("_sha").alias("text_sha256"))


def drop_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """The rows of docs that stay, with all their columns."""
    docs = settled(docs)
    gone = classes(docs, id_col, text_col, **options).where(~F.col("kept")).select("_rid")
    return rows_by_rid(docs, gone, "left_anti")
