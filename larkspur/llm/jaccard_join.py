"""N-gram Jaccard join: documents whose sets of word shingles have a Jaccard similarity of at least `percent` / 100.

The incidence matrix of documents by shingles is blocked: by documents (up to BLOCK entries) and by ranges of shingle hashes.
1. Each block sends its distinct shingles to their range. A range adds up document frequencies, drops shingles of one
   document, and answers each block with the shared ones and the class of their frequency. A shingle that a block holds
   many times is sent once with its count, so that one in a third of all documents is an entry a block.
2. Size-derived bounds: a pair of sizes a and b links only if its overlap o is at least p (a + b) / (1 + p). So a document
   needs p of its own shingles shared; in the order of (frequency class, hash), two that link share a shingle among the
   first a - o + 1 and b - o + 1 of them. Only these prefixes are multiplied, which gives the pairs that can link. Their overlaps are
   added up in blocks: the rows of up to MEMBERS partners against that of one node, and pairs below their bound are dropped.
3. Equal sets are one node. In the product, large groups are not expanded into pairs: each node is first
   counted against the most central node (the one with the least share of shingles of its own) of the columns it is in,
   links make components, then the most central node of each component in a column is counted against the column's. What
   remains are pairs of different components within the bounds, and all of these are counted: no link between components
   is missed, whichever pairs within a component were left uncounted. Each step goes on from the components and columns that the one before left.
4. Links lie within components, so jaccard_join and jaccard_pairs count every pair of nodes of a component. A component of over
   CELL bytes of lists is dealt to parts by node, and each pair of parts is a cell of its own; overlaps of a cell add up in
   blocked products. jaccard_components and one_of_each need components only and skip this.
Columns of over 1 / HOT of the product's entries, and sets of over 1 / HOT of the rows, are joined by broadcast, so no key that is shuffled is hot.

Shingle identity is 48 of 64 hash bits within a pair; sizes are counted on 64 bits. Defined results: texts
are lower-cased (A-Z); null, empty and blank texts have no shingle and stay alone; a text of fewer than `width` words is one
shingle; of repeated rows each gets a row; a null id is in no minimum (a component of null ids only has a null id); very long texts are
one set of all their shingles, held in one task's memory; an empty table gives an empty result; other columns are not read, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from larkspur.llm.common import HOT, checkpointed, joined_hot, packed, record_batch, removed, rows_by_rid, run_folder, settled, tidy, unpacked, with_rid

WIDTH, PERCENT = 5, 75
#: Entries and documents after which a block is closed; entries that a task adds up at a time, about.
BLOCK, BLOCK_DOCS, PER_RANGE = 1 << 19, 60_000, 1 << 19
REMEMBERED = 1 << 18
#: Pairs of nodes that are broadcast at most (24 bytes each); partners that are counted against one copy of a node's list; entries of a block.
BROADCAST_PAIRS, MEMBERS, TOGETHER = 200_000, 64, 1 << 18
#: Bytes of lists of a part of a component, about; sets and shingles of a block of the product within a cell.
CELL, TILE, SHINGLES = 2 << 20, 512, 4096
#: Bytes of a row group of sets: what a writing task holds.
ROW_GROUP = 4 << 20
ODD = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F, 0xE7037ED1A0B428DB, 0x8EBC6AF09C88C6E3, 0x589965CC75374CC3], np.uint64)


def stirred(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


class Shingler:
    def __init__(self, width: int = WIDTH):
        self.width, self.seen = width, {}
        self.odd = np.resize(ODD, width) * (np.arange(width, dtype=np.uint64) // np.uint64(len(ODD)) * np.uint64(2) + np.uint64(1))

    def of(self, text: str) -> np.ndarray:
        """The distinct shingles of a text, as sorted 64-bit hashes."""
        words, seen = text.encode("utf-8", "surrogatepass").lower().split(), self.seen
        if not words:
            return np.zeros(0, np.uint64)
        if len(seen) > REMEMBERED:
            seen.clear()
        for w in set(words).difference(seen):
            seen[w] = xxhash.xxh64_intdigest(w)
        h, n = np.fromiter(map(seen.__getitem__, words), np.uint64, len(words)), len(words)
        width = min(n, self.width)
        mixed = sum((h[i : n - width + 1 + i] * self.odd[i] for i in range(width)), np.full(n - width + 1, width, np.uint64))
        return np.unique(stirred(mixed))


def short(h: np.ndarray) -> np.ndarray:
    return h >> np.uint64(16)


def split48(h: np.ndarray) -> tuple[bytes, bytes]:
    return (h >> np.uint64(16)).astype(np.uint32).tobytes(), (h & np.uint64(0xFFFF)).astype(np.uint16).tobytes()


def joined48(hi: bytes, lo: bytes) -> np.ndarray:
    return np.frombuffer(hi, np.uint32).astype(np.uint64) << np.uint64(16) | np.frombuffer(lo, np.uint16)


def own_packed(own: np.ndarray, sets: int) -> bytes:
    """Ascending numbers of sets, as a count for each set if that is shorter."""
    return b"c" + packed(np.bincount(own, minlength=sets)) if sets < 2 * len(own) else b"n" + own.astype(np.uint16).tobytes()


def own_unpacked(raw: bytes) -> np.ndarray:
    if raw[:1] == b"n":
        return np.frombuffer(raw, np.uint16, -1, 1) if len(raw) > 1 else np.zeros(0, np.uint16)
    counts = unpacked(raw[1:])
    return np.repeat(np.arange(len(counts), dtype=np.uint16), counts)


def list_packed(h: np.ndarray) -> bytes:
    """A list's shingles, of 6 bytes each."""
    return np.ascontiguousarray(h.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :6]).tobytes()


def list_unpacked(raw: object) -> np.ndarray:
    """Of bytes or an Arrow buffer."""
    few = np.frombuffer(raw, np.uint8).reshape(-1, 6)
    out = np.zeros((len(few), 8), np.uint8)
    out[:, :6] = few
    return out.view("<u8").ravel()


META = (("_ids", "array<{kind}>"), ("_ns", "binary"), ("_sets", "binary"), ("_fps", "binary"))
ENTRIES = (("_hi", "binary"), ("_lo", "binary"), ("_own", "binary"), ("_mhi", "binary"), ("_mlo", "binary"), ("_mx", "binary"))
#: Entries: hash (_hi, _lo) and set (_own) of what the block holds once; hash (_mhi, _mlo) and count (_mx) of what it holds
#: several times. Answers have the same form, with the frequency class in place of the count and for the first in _code.


class Block:
    def __init__(self):
        self.ids, self.ns, self.sets, self.fps, self.known, self.hashes, self.size = [], [], [], [], {}, [], 0

    def add(self, id_: object, h: np.ndarray) -> None:
        fp = int(h.sum(dtype=np.uint64)).to_bytes(8, "little") + int(stirred(h + np.uint64(len(h))).sum(dtype=np.uint64)).to_bytes(8, "little")
        own = -1
        if len(h) and fp not in self.known:
            own = self.known[fp] = len(self.hashes)
            self.hashes.append(h)
            self.size += len(h)
        self.ids.append(id_)
        self.ns.append(len(h))
        self.sets.append(own)
        self.fps.append(fp)

    def full(self) -> bool:
        return self.size >= BLOCK or len(self.ids) >= BLOCK_DOCS

    def rows(self, number: int, ranges: int) -> dict[str, list]:
        out = {c: [] for c in ("_bucket", "_block", *(c for c, _ in META), *(c for c, _ in ENTRIES))}

        def put(bucket: int, **columns) -> None:
            for c, x in out.items():
                x.append(columns.get(c))
            out["_bucket"][-1], out["_block"][-1] = bucket, number

        h = short(np.concatenate(self.hashes)) if self.hashes else np.zeros(0, np.uint64)
        own = np.repeat(np.arange(len(self.hashes), dtype=np.uint16), [len(x) for x in self.hashes])
        distinct, inverse, counts = np.unique(h, return_inverse=True, return_counts=True)
        once = counts[inverse] == 1
        several, times = distinct[counts > 1], counts[counts > 1].astype(np.uint32)
        pending = dict(zip(("_hi", "_lo"), split48(h[~once]), strict=True), _own=own_packed(own[~once], len(self.hashes)))
        put(number % ranges, _ids=self.ids, _ns=np.array(self.ns, np.int64).tobytes(), _sets=np.array(self.sets, np.int32).tobytes(), _fps=b"".join(self.fps), **pending)
        edges_of = lambda x: (np.argsort(x, kind="stable"), np.searchsorted(np.sort(x), np.arange(ranges + 1)))
        where = lambda x: ((x >> np.uint64(16)) * np.uint64(ranges) >> np.uint64(32)).astype(np.uint32)
        h, own = h[once], own[once]
        (order, edges), (order2, edges2) = edges_of(where(h)), edges_of(where(several))
        for k in range(ranges):
            a, b = order[edges[k] : edges[k + 1]], order2[edges2[k] : edges2[k + 1]]
            if len(a) or len(b):
                put(k, **dict(zip(("_hi", "_lo", "_mhi", "_mlo"), (*split48(h[a]), *split48(several[b])), strict=True)), _own=own_packed(own[a], len(self.hashes)), _mx=times[b].tobytes())
        return out


def frequency_class(df: np.ndarray) -> np.ndarray:
    return np.minimum(np.floor(np.log2(df) * 4), 255).astype(np.uint8)


def incidence(docs: DataFrame, width: int, percent: int) -> DataFrame:
    """docs: _id, _text. A row for each: _id, _n, _fp and, for one row of each set in a block that is shared enough, _list: its shared shingles in order."""
    kind = dict(docs.dtypes)["_id"]
    total = docs.agg(F.sum(F.octet_length("_text"))).first()[0] or 0
    ranges = max(1, -(-total // (7 * PER_RANGE)))
    meta, entries = [(c, t.format(kind=kind)) for c, t in META], list(ENTRIES)

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shingler, block, seq, base, types = Shingler(width), Block(), 0, TaskContext.get().partitionId() << 24, {}

        def out(block: Block) -> pa.RecordBatch:
            return record_batch(**{c: pa.array(x, types.get(c, pa.binary())) for c, x in block.rows(base + seq, ranges).items()})

        for b in batches:
            types = {"_bucket": pa.int64(), "_block": pa.int64(), "_ids": pa.list_(b.schema.field(0).type)}
            for id_, text in zip(b.column(0).to_pylist(), b.column(1), strict=True):
                block.add(id_, shingler.of(text.as_py() or ""))
                if block.full():
                    yield out(block)
                    block, seq = Block(), seq + 1
        if block.ids:
            yield out(block)

    def frequencies(t: pa.Table) -> pa.Table:
        rows = t.to_pylist()
        sent = [r for r in rows if r["_ids"] is None]
        once = [joined48(r["_hi"], r["_lo"]) for r in sent]
        several = [joined48(r["_mhi"], r["_mlo"]) for r in sent]
        flat = np.concatenate([*once, *several, np.zeros(0, np.uint64)])
        weight = np.concatenate([np.ones(sum(map(len, once)), np.uint32), *(np.frombuffer(r["_mx"], np.uint32) for r in sent)])
        distinct, inverse = np.unique(flat, return_inverse=True)
        df = np.bincount(inverse, weights=weight, minlength=len(distinct))[inverse] if len(flat) else np.zeros(0)
        at, at2 = 0, sum(map(len, once))
        out = [{c: r[c] for c, _ in (*meta, *entries)} | {"_block": r["_block"], "_code": None} for r in rows if r["_ids"] is not None]
        for r, a, m in zip(sent, once, several, strict=True):
            d, d2 = df[at : at + len(a)], df[at2 : at2 + len(m)]
            at, at2 = at + len(a), at2 + len(m)
            shared = d > 1
            if shared.any() or len(m):
                own = own_unpacked(r["_own"])
                sets = len(r["_own"]) and (int.from_bytes(r["_own"][1:9], "little") if r["_own"][:1] == b"c" else 1 << 16)
                out.append(dict(zip(("_hi", "_lo", "_mhi", "_mlo"), (*split48(a[shared]), *split48(m)), strict=True)) | {"_block": r["_block"], "_own": own_packed(own[shared], sets), "_code": frequency_class(d[shared]).tobytes(), "_mx": frequency_class(d2).tobytes()})
        fields = {"_block": pa.int64(), "_ids": t.schema.field("_ids").type}
        return pa.table({c: pa.array([x.get(c) for x in out], fields.get(c, pa.binary())) for c in ("_block", *(c for c, _ in meta), *(c for c, _ in entries), "_code")})

    def finish(t: pa.Table) -> pa.Table:
        rows = t.to_pylist()
        main, answers = next(r for r in rows if r["_ids"] is not None), [r for r in rows if r["_ids"] is None]
        nothing = np.zeros(0, np.uint64)
        m = np.concatenate([nothing, *(joined48(r["_mhi"], r["_mlo"]) for r in answers)])
        m_code = np.concatenate([np.zeros(0, np.uint8), *(np.frombuffer(r["_mx"], np.uint8) for r in answers)])
        order = np.argsort(m)
        m, m_code = m[order], m_code[order]
        pending = joined48(main["_hi"], main["_lo"])
        h = np.concatenate([pending, *(joined48(r["_hi"], r["_lo"]) for r in answers)])
        code = np.concatenate([m_code[np.searchsorted(m, pending)] if len(pending) else m_code[:0], *(np.frombuffer(r["_code"], np.uint8) for r in answers)])
        own = np.concatenate([own_unpacked(main["_own"]), *(own_unpacked(r["_own"]) for r in answers)])
        order = np.lexsort((h, code, own))
        h, own = h[order], own[order]
        ns, sets = np.frombuffer(main["_ns"], np.int64), np.frombuffer(main["_sets"], np.int32)
        lists = []
        for n, s in zip(ns.tolist(), sets.tolist(), strict=True):
            i, j = np.searchsorted(own, [s, s + 1]) if s >= 0 else (0, 0)
            lists.append(list_packed(h[i:j]) if j > i and 100 * (j - i) >= percent * n else None)
        return pa.table({"_id": pa.array(main["_ids"], t.schema.field("_ids").type.value_type), "_n": pa.array(ns, pa.int64()), "_fp": pa.array([main["_fps"][16 * i : 16 * i + 16] for i in range(len(ns))], pa.binary()), "_list": pa.array(lists, pa.binary())})

    schema = lambda cs: ", ".join(f"{c} {t}" for c, t in cs)
    sent = docs.mapInArrow(cut, schema([("_bucket", "long"), ("_block", "long"), *meta, *entries]))
    back = sent.groupBy("_bucket").applyInArrow(frequencies, schema([("_block", "long"), *meta, *entries, ("_code", "binary")]))
    return back.groupBy("_block").applyInArrow(finish, f"_id {kind}, _n long, _fp binary, _list binary")


def needed(a: Column, b: Column, percent: int) -> Column:
    """The least overlap with which sizes a and b link."""
    return F.ceil(percent * (a + b) / (100 + percent))


def columns(nodes: DataFrame, percent: int) -> DataFrame:
    """nodes: _node, _n, _list. The prefixes: _h, _node, _n, _at (place in the order, from 1) and _own (shingles of no other document)."""

    def prefix(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            parts = [[], [], [], [], []]
            for node, n, raw in zip(*(b.column(i).to_pylist() for i in range(3)), strict=True):
                h = list_unpacked(raw)
                own = n - len(h)
                take = max(0, n - -(-percent * n // 100) + 1 - own)
                h = h[:take].astype(np.int64)
                for p, x in zip(parts, (h, np.full(len(h), node), np.full(len(h), n), np.arange(own + 1, own + 1 + len(h)), np.full(len(h), own)), strict=True):
                    p.append(x)
            yield record_batch(**{c: pa.array(np.concatenate([*p, np.zeros(0, np.int64)]).astype(np.int64)) for c, p in zip(("_h", "_node", "_n", "_at", "_own"), parts, strict=True)})

    return nodes.select("_node", "_n", "_list").mapInArrow(prefix, "_h long, _node long, _n long, _at long, _own long")


def linked(pairs: DataFrame, nodes: DataFrame, percent: int) -> DataFrame:
    """Of the pairs (_a, _b) those whose overlap, added up over whole sets, reaches the bound.

    The list of each _b goes to a cell for every MEMBERS of its partners, and stands there before theirs; so each partner's list is moved
    once, and no cell is large. A cell is streamed: a block of partners is counted against the list at a time.
    """

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hub, row = None, np.zeros(0, np.uint64)
        for batch in batches:
            found, waiting, size = ([], []), [], 0

            def flush() -> None:
                nonlocal waiting, size
                if not waiting:
                    return
                flat = np.concatenate([m for _, _, m in waiting])
                at = np.searchsorted(row, flat)
                hit = np.concatenate([[0], np.cumsum(row[np.minimum(at, len(row) - 1)] == flat)])  # noqa: B023
                ends = np.cumsum([0] + [len(m) for _, _, m in waiting])
                for (a, n, _), o in zip(waiting, np.diff(hit[ends]).tolist(), strict=True):
                    if 100 * o >= percent * (n + hub[1] - o):  # noqa: B023
                        found[0].append(a)  # noqa: B023
                        found[1].append(hub[0])  # noqa: B023
                waiting, size = [], 0

            for b, a, n, raw in zip(*(batch.column(i) for i in range(4)), strict=True):
                raw = list_unpacked(raw.as_py())
                if a.as_py() is None:
                    flush()
                    hub, row = (b.as_py(), n.as_py()), np.sort(raw)
                else:
                    waiting.append((a.as_py(), n.as_py(), raw))
                    size += len(raw)
                    if size >= TOGETHER:
                        flush()
            flush()
            yield record_batch(_a=pa.array(found[0], pa.int64()), _b=pa.array(found[1], pa.int64()))

    pairs = checkpointed(pairs.select("_a", "_b"))
    total = pairs.count()
    if not total:
        return pairs
    # One cell is enough for the others; so at most one row for each MEMBERS pairs is left.
    sizes = checkpointed(pairs.groupBy("_b").agg(F.count(F.lit(1)).alias("_k")).where(F.col("_k") > MEMBERS))
    met = pairs.join(F.broadcast(sizes), "_b", "left") if total <= BROADCAST_PAIRS else joined_hot(pairs, sizes, ["_b"], "_k", total, "left")
    placed = met.select("_a", "_b", F.pmod(F.xxhash64("_a"), F.coalesce(F.ceil(F.col("_k") / MEMBERS), F.lit(1))).alias("_salt"))
    cells = placed.select("_b", "_salt").distinct()
    # Lists meet the pairs where they lie if the pairs are few enough to broadcast; then only the lists of pairs are shuffled.
    asked = F.broadcast if total <= BROADCAST_PAIRS else lambda x: x
    side = lambda x, s: nodes.select(F.col("_node").alias(f"_{s}"), "_n", "_list").join(asked(x), f"_{s}")
    rows = side(placed, "a").select("_b", "_a", "_n", "_list", "_salt").unionByName(side(cells, "b").select("_b", F.lit(None).cast("long").alias("_a"), "_n", "_list", "_salt"))
    rows = rows.repartition("_b", "_salt").sortWithinPartitions("_b", "_salt", F.col("_a").asc_nulls_first())
    return rows.select("_b", "_a", "_n", "_list").mapInArrow(count, "_a long, _b long")


def components(edges: DataFrame, known: DataFrame | None = None) -> DataFrame:
    """_node, _comp (the least node it is linked with, however far) for each node of the edges (_a, _b): alternating large and small stars.

    known: what this gave for other edges, which count too. Stars stand for all their links, so they are where the rounds begin.
    """
    spark, edges = edges.sparkSession, edges.where("_a != _b").select(F.greatest("_a", "_b").alias("_a"), F.least("_a", "_b").alias("_b"))
    if known is not None:
        edges = edges.unionByName(known.select(F.col("_node").alias("_a"), F.col("_comp").alias("_b")))
    edges = checkpointed(edges.distinct())
    while True:
        tidy(spark)
        both = edges.select(F.explode(F.array(F.struct("_a", "_b"), F.struct(F.col("_b").alias("_a"), F.col("_a").alias("_b")))).alias("e")).select("e.*")
        # Done when all are stars of their least nodes: no node has two lesser ones, or one with greater ones.
        less, more = F.count_if(F.col("_b") < F.col("_a")).alias("_less"), F.count_if(F.col("_b") > F.col("_a")).alias("_more")
        if both.groupBy("_a").agg(less, more).where("_less > 1 or _less > 0 and _more > 0").isEmpty():
            return edges.select(F.col("_a").alias("_node"), F.col("_b").alias("_comp"))
        least = both.groupBy("_a").agg(F.least(F.min("_b"), F.col("_a")).alias("_m"))
        large = both.join(least, "_a").where("_b > _a").select(F.col("_b").alias("_a"), F.col("_m").alias("_b")).distinct()
        least = large.groupBy("_a").agg(F.min("_b").alias("_m"))
        small = large.join(least, "_a").select(F.explode(F.array(F.struct(F.col("_a").alias("x"), F.col("_m").alias("y")), F.struct(F.col("_b").alias("x"), F.col("_m").alias("y")))).alias("e")).select(F.col("e.x").alias("_a"), F.col("e.y").alias("_b")).where("_a != _b").distinct()
        edges = checkpointed(small)


def node_components(nodes: DataFrame, percent: int) -> DataFrame:
    """_node, _comp of the nodes that are linked with others."""
    product = columns(nodes, percent)  # made anew for each of its uses: it would take several times the room of the nodes
    central = F.struct((F.col("_own") / F.col("_n")).alias("share"), F.col("_node").alias("node"), F.col("_n").alias("n"))
    in_bounds = lambda a, b: 100 * F.least(a, b) >= percent * F.greatest(a, b)
    # The most central node of each column.
    hubs = checkpointed(product.groupBy("_h").agg(F.min(central).alias("_hub"), F.count(F.lit(1)).alias("_k")).where("_k > 1"))
    total = hubs.agg(F.sum("_k")).first()[0] or 0
    often = F.broadcast(checkpointed(hubs.where(F.col("_k") * HOT > total).select("_h")))  # fewer than HOT

    def by_column(big: DataFrame, small: DataFrame) -> DataFrame:
        """big joined with small, which has a row for each column."""
        hot = big.join(F.broadcast(small.join(often, "_h", "left_semi")), "_h")
        return hot.unionByName(big.join(often, "_h", "left_anti").join(small.join(often, "_h", "left_anti"), "_h"))

    # For each node the hub with which it shares most columns.
    met = joined_hot(product, hubs, ["_h"], "_k", total).where((F.col("_node") != F.col("_hub.node")) & in_bounds(F.col("_n"), F.col("_hub.n")))
    best = met.groupBy("_node", F.col("_hub.node").alias("_to")).agg(F.count(F.lit(1)).alias("_k")).groupBy("_node").agg(F.max(F.struct("_k", F.negative("_to").alias("_minus"))).alias("_best"))
    comps = components(linked(best.select(F.col("_node").alias("_a"), F.negative("_best._minus").alias("_b")), nodes, percent))

    def open_columns(rows: DataFrame, comps: DataFrame) -> DataFrame:
        """What is left of rows of the product: columns with more than one component."""
        labelled = rows.join(comps, "_node", "left").withColumn("_comp", F.coalesce("_comp", "_node"))
        mixed = labelled.groupBy("_h").agg(F.min("_comp").alias("_lo"), F.max("_comp").alias("_hi")).where("_lo != _hi").select("_h")
        return by_column(labelled, mixed)

    # The most central node of each component in a column against that of the column.
    left = checkpointed(open_columns(product, comps))
    tidy(nodes.sparkSession)
    first = left.groupBy("_h", "_comp").agg(F.min(central).alias("_own_hub"))
    hubs = first.groupBy("_h").agg(F.min("_own_hub").alias("_hub"))
    pairs = by_column(first, hubs).where((F.col("_own_hub.node") != F.col("_hub.node")) & in_bounds(F.col("_own_hub.n"), F.col("_hub.n"))).select(F.col("_own_hub.node").alias("_a"), F.col("_hub.node").alias("_b")).distinct()
    more = checkpointed(linked(pairs, nodes, percent))
    tidy(nodes.sparkSession)
    if not more.isEmpty():
        comps = components(more, comps)
        # Components only grow, so columns that had one have one still.
        left = checkpointed(open_columns(left.drop("_comp"), comps).select("_h", "_node", "_n", "_at", "_comp"))
        tidy(nodes.sparkSession)
    # All pairs of different components that are left within the bounds.
    small = left.where(F.col("_at") <= F.col("_n") - needed(F.col("_n"), F.col("_n"), percent) + 1)
    a, b = small.select("_h", *(F.col(c).alias(f"{c}_a") for c in ("_node", "_n", "_at", "_comp"))), left.select("_h", *(F.col(c).alias(f"{c}_b") for c in ("_node", "_n", "_at", "_comp")))
    need = needed(F.col("_n_a"), F.col("_n_b"), percent)
    ordered = (F.col("_n_a") < F.col("_n_b")) | ((F.col("_n_a") == F.col("_n_b")) & (F.col("_node_a") < F.col("_node_b")))
    rest = a.join(b, "_h").where((F.col("_comp_a") != F.col("_comp_b")) & ordered & in_bounds(F.col("_n_a"), F.col("_n_b")) & (F.col("_at_a") <= F.col("_n_a") - need + 1) & (F.col("_at_b") <= F.col("_n_b") - need + 1))
    more = checkpointed(linked(rest.select(F.col("_node_a").alias("_a"), F.col("_node_b").alias("_b")).distinct(), nodes, percent))
    tidy(nodes.sparkSession)
    return comps if more.isEmpty() else components(more, comps)


def overlaps(a: list[np.ndarray], b: list[np.ndarray]) -> np.ndarray:
    """The overlap of each list of a with each of b, added up over blocks of shingles."""
    flat = [np.concatenate(x) for x in (a, b)]
    own = [np.repeat(np.arange(len(x)), [len(h) for h in x]) for x in (a, b)]
    both = np.intersect1d(*flat)  # no other shingle adds to an overlap
    at = [np.searchsorted(both, h) for h in flat]
    keep = [(i < len(both)) & (both[np.minimum(i, len(both) - 1)] == h) if len(both) else np.zeros(len(h), bool) for i, h in zip(at, flat, strict=True)]
    own, at = [o[k] for o, k in zip(own, keep, strict=True)], [i[k] for i, k in zip(at, keep, strict=True)]
    out = np.zeros((len(a), len(b)), np.int64)
    for start in range(0, len(both), SHINGLES):
        blocks = []
        for x, o, i in zip((a, b), own, at, strict=True):
            now = (i >= start) & (i < start + SHINGLES)
            block = np.zeros((len(x), min(SHINGLES, len(both) - start)), np.float32)
            block[o[now], i[now] - start] = 1
            blocks.append(block)
        out += (blocks[0] @ blocks[1].T).astype(np.int64)
    return out


def links_within(nodes: DataFrame, weights: DataFrame, comps: DataFrame, percent: int, pairs: bool) -> DataFrame:
    """nodes: _node, _n, _list; weights: _node, _k (rows of the set). All links within components: _a, _b of each, or _node and _links, the rows of the sets that a node links with."""
    members = comps.unionByName(comps.select(F.col("_comp").alias("_node"), "_comp").distinct())
    placed = checkpointed(nodes.select("_node", F.octet_length("_list").alias("_bytes")).join(members, "_node").join(weights, "_node"))
    large = placed.groupBy("_comp").agg(F.ceil(F.sum("_bytes") / CELL).cast("int").alias("_parts")).where("_parts > 1")
    placed = checkpointed(placed.join(F.broadcast(large), "_comp", "left").withColumn("_parts", F.coalesce("_parts", F.lit(1))))
    total = placed.agg(F.sum(F.col("_bytes") * F.col("_parts"))).first()[0] or 0
    n_buckets = max(1, -(-total // (4 * CELL)))
    part = F.pmod(F.xxhash64("_node"), "_parts").cast("int")
    dealt = nodes.join(placed.drop("_bytes"), "_node").withColumn("_part", part).withColumn("_other", F.explode(F.sequence(F.lit(0), F.col("_parts") - 1)))
    cells = dealt.select("_comp", F.least("_part", "_other").alias("_lo"), F.greatest("_part", "_other").alias("_hi"), "_part", "_node", "_n", "_k", "_list")
    cells = cells.withColumn("_bucket", F.pmod(F.xxhash64("_comp", "_lo", "_hi"), F.lit(n_buckets)))
    tile = TILE

    def count(t: pa.Table) -> pa.Table:
        comp, lo, hi, part, node, n, k = (t[c].to_numpy() for c in ("_comp", "_lo", "_hi", "_part", "_node", "_n", "_k"))
        lists, order = t["_list"], np.lexsort((part, hi, lo, comp))
        keys = np.stack([comp[order], lo[order], hi[order]])
        edges = [0, *(np.flatnonzero((keys[:, 1:] != keys[:, :-1]).any(0)) + 1).tolist(), len(order)]
        links, found = np.zeros(len(node), np.int64), [[], []]
        for start, end in zip(edges[:-1], edges[1:], strict=True):
            cell = order[start:end]
            alone = lo[cell[0]] == hi[cell[0]]
            mine, others = (cell, cell) if alone else (cell[part[cell] == lo[cell[0]]], cell[part[cell] == hi[cell[0]]])
            tiles = lambda x: [x[i : i + tile] for i in range(0, len(x), tile)]
            read = lambda x: [list_unpacked(lists[int(i)].as_py()) for i in x]
            for i, a in enumerate(tiles(mine)):
                a_lists = read(a)
                for j, b in enumerate(tiles(others)):
                    if alone and j < i:
                        continue
                    o = overlaps(a_lists, read(b))
                    yes = 100 * o >= percent * (n[a][:, None] + n[b][None, :] - o)
                    if alone and i == j:
                        yes = np.triu(yes, 1)
                    if pairs:
                        x, y = np.nonzero(yes)
                        found[0].append(node[a[x]])
                        found[1].append(node[b[y]])
                    links[a] += yes @ k[b]
                    links[b] += k[a] @ yes
        if pairs:
            x, y = (np.concatenate([np.zeros(0, np.int64), *f]) for f in found)
            return pa.table({"_a": pa.array(np.minimum(x, y), pa.int64()), "_b": pa.array(np.maximum(x, y), pa.int64())})
        return pa.table({"_node": pa.array(node, pa.int64()), "_links": pa.array(links, pa.int64())})

    done = cells.groupBy("_bucket").applyInArrow(count, "_a long, _b long" if pairs else "_node long, _links long")
    return done if pairs else done.groupBy("_node").agg(F.sum("_links").alias("_links"))


class Join:
    """The sets of docs, their nodes and components."""

    def __init__(self, docs: DataFrame, id_col: str, text_col: str, width: int, percent: int):
        self.id_col, self.percent, self.spark = id_col, percent, docs.sparkSession
        folder = run_folder(self.spark, "incidence")
        sets = incidence(docs.select(F.col(id_col).alias("_id"), F.col(text_col).alias("_text")), width, percent)
        sets.write.option("compression", "uncompressed").option("parquet.block.size", ROW_GROUP).option("parquet.enable.dictionary", "false").parquet(folder)
        sets = self.spark.read.schema(sets.schema).parquet(folder)
        tidy(self.spark)
        self.rows = checkpointed(sets.drop("_list"))
        lists = sets.where("_list is not null").select("_fp", "_n", "_list").dropDuplicates(["_fp"])
        self.nodes = checkpointed(lists.withColumn("_node", F.monotonically_increasing_id()))
        removed(self.spark, folder)
        tidy(self.spark)
        self.comps = node_components(self.nodes, percent)
        self.sets = self.rows.where("_n > 0").groupBy("_fp").agg(F.min("_id").alias("_least"), F.count(F.lit(1)).alias("_k"))

    def found(self) -> DataFrame:
        """_fp, _first and _k (rows) of the sets that have copies or links: only these get an id from elsewhere."""
        nodes, comps, sets = self.nodes, self.comps, self.sets
        placed = sets.join(nodes.select("_fp", "_node").join(comps, "_node"), "_fp", "left").where("_k > 1 or _comp is not null")
        least = placed.where("_comp is not null").groupBy("_comp").agg(F.min("_least").alias("_of_comp"))
        roots = nodes.select(F.col("_node").alias("_comp"), F.col("_fp").alias("_root"))
        least = least.join(roots, "_comp").join(sets.select(F.col("_fp").alias("_root"), F.col("_least").alias("_of_root")), "_root").select("_comp", "_root", F.least("_of_comp", "_of_root").alias("_first"))
        return checkpointed(placed.join(least.drop("_root"), "_comp", "left").select("_fp", F.coalesce("_first", "_least").alias("_first"), "_k").unionByName(least.select(F.col("_root").alias("_fp"), "_first", F.lit(1).cast("long").alias("_k"))).groupBy("_fp").agg(F.min("_first").alias("_first"), F.max("_k").alias("_k")))

    def labelled(self, found: DataFrame, *more: Column) -> DataFrame:
        rows = self.rows
        some = joined_hot(rows.where("_n > 0"), found, ["_fp"], "_k", rows.count(), "left")
        out = some.unionByName(rows.where("_n = 0"), allowMissingColumns=True)
        return out.select(F.col("_id").alias(self.id_col), F.col("_n").alias("n_shingles"), F.coalesce("_first", "_id").alias("component_id"), F.hex("_fp").alias("set_id"), *more)

    def links(self, pairs: bool) -> DataFrame:
        self.comps = checkpointed(self.comps)
        tidy(self.spark)
        weights = self.nodes.select("_node", "_fp").join(self.sets.select("_fp", "_k"), "_fp").select("_node", "_k")
        return checkpointed(links_within(self.nodes.select("_node", "_n", "_list"), weights, self.comps, self.percent, pairs))


def jaccard_components(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = WIDTH, percent: int = PERCENT) -> DataFrame:
    """id, n_shingles, component_id (the least id that links reach) and set_id (a digest of the set) for each row."""
    join = Join(docs, id_col, text_col, width, percent)
    return join.labelled(join.found())


def jaccard_join(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = WIDTH, percent: int = PERCENT) -> DataFrame:
    """The columns of jaccard_components and n_links: the other rows that the row links with, rows of equal sets included."""
    join = Join(docs, id_col, text_col, width, percent)
    links = join.links(False).join(join.nodes.select("_node", "_fp"), "_node").select("_fp", "_links")
    counted = join.found().join(links, "_fp", "left")
    counted = checkpointed(counted.select("_fp", "_first", "_k", (F.col("_k") - 1 + F.coalesce("_links", F.lit(0))).alias("_links")))
    return join.labelled(counted, F.coalesce("_links", F.lit(0)).cast("long").alias("n_links"))


def jaccard_pairs(docs: DataFrame, text_col: str = "text", width: int = WIDTH, percent: int = PERCENT) -> DataFrame:
    """set_a and set_b of each pair of different sets that link; set_id of jaccard_components or jaccard_join gives their rows."""
    join = Join(docs, text_col, text_col, width, percent)
    name = lambda s: join.nodes.select(F.col("_node").alias(f"_{s}"), F.hex("_fp").alias(f"set_{s}"))
    return join.links(True).join(name("a"), "_a").join(name("b"), "_b").select("set_a", "set_b")


def one_of_each(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """The rows of docs that stay: of each component the first row of the least id. Columns of docs may have any names."""
    docs = settled(docs)
    keys = with_rid(docs.select(F.col(id_col).alias("_id"), F.col(text_col).alias("_text"))).select(F.struct("_id", "_rid").alias("_key"), "_text")
    found = jaccard_components(keys, "_key", "_text", **options)
    return rows_by_rid(docs, found.where("_key != component_id").select(F.col("_key._rid").alias("_rid")), "left_anti")
