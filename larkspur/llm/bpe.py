"""Byte-level BPE encoding and decoding by DuckDB recursive queries, one database for each Python worker.

Encoding: a pattern cuts texts into words; the distinct words not yet known become (word, place, token) rows, a token a
byte. A recursive query joins neighbours with the merge table, contracts the leftmost pair of least rank of every word
that has one, and ends when no word has. Words found go into a memory of bounded size. A word that is itself a token is
that token. A step of the recursion makes one contraction in each word of up to SHORT bytes. Of a longer one it makes all contractions of
the least rank at once, from the left, so such a word takes a step for each rank that it meets, not for each contraction. The result is
the same if each word of the vocabulary contracts to itself: then no contraction makes a pair of lower rank than its own. This is checked
before the first longer word; with other vocabularies a step contracts the leftmost pair only.
Decoding: id sequences are cut before tokens that start with a blank, distinct pieces are joined with the vocabulary and put
together by an ordered aggregation, and texts put together from their pieces.

Defined results: a null or empty text has no ids and decodes to no bytes; repeated rows are encoded each; null ids of
rows are kept; unknown token ids raise ValueError; an empty table gives an empty result; very long texts and words are taken whole; other columns
are not read, whatever their names; where encode() adds a column of a name that is there, that of the input stays with _ behind its name.
The rank file is a parameter, read by the driver and broadcast (its size is checked against MOST_BYTES).
"""

from __future__ import annotations

import base64
import gc
import hashlib
import threading
from collections.abc import Callable, Iterator

import duckdb
import numpy as np
import pyarrow as pa
import pyarrow.compute
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from larkspur.llm.common import record_batch

#: Bytes of a word whose places fit in 8 bits; words and bytes of one recursion; words remembered; characters of texts taken together.
SHORT, TOGETHER, ROWS, REMEMBERED, CHARACTERS = 256, 60_000, 1 << 20, 500_000, 4 << 20
#: MB of a database; a recursion over a single word of more than ROWS bytes gets as many more as its rows ask for.
MEMORY, ROW_BYTES = 300, 400
#: Bytes of a rank file that are broadcast at most.
MOST_BYTES = 64 << 20
#: Seconds after which a worker without tasks gives the remembered words back.
IDLE_S = 8.0

#: A row is a token; its key is the word's number and the token's place in it (8 bits). best: rank, place and next place.
CONTRACT = """
WITH RECURSIVE run(k, token, more) AS (
    SELECT k, token, true FROM given
  UNION ALL
    SELECT * FROM (
        WITH pairs AS MATERIALIZED (
            SELECT k, token, lead(token) OVER w AS next, lead(k) OVER w AS after FROM run WHERE more WINDOW w AS (ORDER BY k)),
        best AS (
            SELECT k >> 8 AS word, min((merges.made::BIGINT << 16) | ((k & 255) << 8) | (after & 255)) AS b
            FROM pairs JOIN merges ON merges.l = pairs.token AND merges.r = pairs.next WHERE k >> 8 = after >> 8 GROUP BY k >> 8)
        SELECT k, CASE WHEN k & 255 = (b >> 8) & 255 THEN (b >> 16)::INT ELSE token END, b IS NOT NULL
        FROM pairs LEFT JOIN best ON word = k >> 8 WHERE b IS NULL OR k & 255 <> b & 255)
)
SELECT k >> 8 AS word, list(token ORDER BY k) AS tokens FROM run WHERE NOT more GROUP BY k >> 8 ORDER BY word
"""
#: For longer words, with 32 bits for the place. i: a token's number; hits: the pairs of a word's least rank; together: the same for neighbours.
CONTRACT_LONG = """
WITH RECURSIVE run(k, token, more) AS (
    SELECT k, token, true FROM given
  UNION ALL
    SELECT * FROM (
        WITH pairs AS MATERIALIZED (
            SELECT k, token, i, made FROM (
                SELECT k, token, row_number() OVER w AS i, lead(token) OVER w AS next, lead(k >> 32) OVER w AS beside FROM run WHERE more WINDOW w AS (ORDER BY k))
            LEFT JOIN merges ON merges.l = token AND merges.r = next AND beside = k >> 32),
        best AS MATERIALIZED (SELECT k >> 32 AS word, min(made) AS least FROM pairs GROUP BY k >> 32),
        hits AS (SELECT i, word, made, i - row_number() OVER (ORDER BY i) AS together FROM pairs JOIN best ON word = k >> 32 AND made = least),
        taken AS MATERIALIZED (SELECT i, made FROM (SELECT i, made, row_number() OVER (PARTITION BY {part} ORDER BY i) AS nth FROM hits) WHERE {which})
        SELECT k, coalesce(taken.made, token)::INT, least IS NOT NULL
        FROM pairs JOIN best ON word = k >> 32 LEFT JOIN taken ON taken.i = pairs.i
        WHERE pairs.i - 1 NOT IN (SELECT i FROM taken))
)
SELECT k >> 32 AS word, list(token ORDER BY k) AS tokens FROM run WHERE NOT more GROUP BY k >> 32 ORDER BY word
"""
ALL_AT_ONCE = CONTRACT_LONG.format(part="together", which="nth % 2 = 1")
LEFTMOST = CONTRACT_LONG.format(part="word", which="nth = 1")
PUT_TOGETHER = "SELECT piece, array_to_string(list(shown ORDER BY place), '') AS text FROM given JOIN vocabulary USING (token) GROUP BY piece ORDER BY piece"


def read_ranks(raw: bytes) -> dict[bytes, int]:
    return {base64.b64decode(a): int(b) for a, b in (line.split() for line in raw.splitlines() if line)}


def together(words: list[bytes]) -> Iterator[list[bytes]]:
    """Words of rising length in lots of at most TOGETHER words and ROWS bytes, short and longer ones apart; a word of more bytes is alone."""
    some, size = [], 0
    for w in words:
        if some and (len(some) >= TOGETHER or size + len(w) > ROWS or len(some[-1]) <= SHORT < len(w)):
            yield some
            some, size = [], 0
        some.append(w)
        size += len(w)
    if some:
        yield some


class Codec:
    """A merge table's ranks are the ids of what a merge makes."""

    def __init__(self, raw: bytes, pattern: str):
        self.ranks, self.words = read_ranks(raw), regex.compile(pattern)
        ranks, self.known, self.shown = self.ranks, {}, {}
        self.of_byte = np.array([ranks[bytes([i])] for i in range(256)], np.int32)
        # A word of the vocabulary may be made of any two words of it.
        self.pairs = np.array([(ranks[w[:i]], ranks[w[i:]], r) for w, r in ranks.items() for i in range(1, len(w)) if w[:i] in ranks and w[i:] in ranks], np.int32).reshape(-1, 3)
        self.vocabulary = pa.table({"token": np.array(list(ranks.values()), np.int32), "shown": [w.decode("latin-1") for w in ranks]})
        self.base, self.busy, self.lock, self.clock, self.whole = None, False, threading.Lock(), None, None
        size = max(ranks.values(), default=0) + 1
        self.starts, self.valid = np.zeros(size, bool), np.zeros(size, bool)
        for w, r in ranks.items():
            self.valid[r], self.starts[r] = True, w[:1] in (b" ", b"\n")

    def _open(self) -> None:
        self.base = duckdb.connect(config={"threads": 1, "memory_limit": f"{MEMORY}MB", "temp_directory": ""})
        for name, table in (("merges", pa.table(dict(zip(("l", "r", "made"), self.pairs.T, strict=True)))), ("vocabulary", self.vocabulary)):
            self.base.register("_in", table)
            self.base.execute(f"CREATE TABLE {name} AS SELECT * FROM _in")
            self.base.unregister("_in")

    def __enter__(self) -> Codec:
        with self.lock:
            self.busy = True
            if self.clock:
                self.clock.cancel()
        return self

    def __exit__(self, *_) -> None:
        """Gives the database's memory back, and that of the words if no task follows: other stages' tasks need it."""
        if self.base:
            self.base.close()
            self.base = None
        pa.default_memory_pool().release_unused()
        with self.lock:
            self.busy = False
            self.clock = threading.Timer(IDLE_S, self.forget)
            self.clock.daemon = True
            self.clock.start()

    def forget(self) -> None:
        with self.lock:
            if not self.busy:
                self.known, self.shown = {}, {}
                gc.collect()

    def _open_if_needed(self) -> None:
        if not self.base:
            self._open()

    def _given(self, query: str, **columns) -> pa.Table:
        self._open_if_needed()
        self.base.register("given", pa.table(columns))
        out = self.base.sql(query).to_arrow_table()
        self.base.unregister("given")
        return out

    def by_recursion(self, words: list[bytes]) -> list[np.ndarray]:
        lens = np.array([len(w) for w in words])
        flat = self.of_byte[np.frombuffer(b"".join(words), np.uint8)]
        starts = np.cumsum(lens) - lens
        query, bits = (CONTRACT, 8) if lens.max() <= SHORT else (ALL_AT_ONCE if self.reaches_all() else LEFTMOST, 32)
        if len(flat) > ROWS + SHORT:
            self._open_if_needed()
            self.base.execute(f"SET memory_limit = '{MEMORY + len(flat) * ROW_BYTES // 1_000_000}MB'")
        out = self._given(query, k=np.repeat(np.arange(len(words)) << bits, lens) + np.arange(len(flat)) - np.repeat(starts, lens), token=flat)
        tokens = out["tokens"].combine_chunks()
        edges, values = tokens.offsets.to_numpy(), tokens.values.to_numpy()
        return [values[i:j] for i, j in zip(edges[:-1], edges[1:], strict=True)]

    def reaches_all(self) -> bool:
        """Whether each word of the vocabulary contracts to itself, one leftmost pair of least rank after the other."""
        if self.whole is None:
            self.whole = False
            words = sorted((w for w in self.ranks if len(w) > 1), key=len)
            self.whole = all(len(t) == 1 and t[0] == self.ranks[w] for some in together(words) for w, t in zip(some, self.by_recursion(some), strict=True))
        return self.whole

    def learn(self, words: set[str]) -> dict[str, bytes]:
        """Tokens of words, as bytes of 32-bit integers."""
        found, rest = {}, {}
        for w in words:
            raw = w.encode()
            if (r := self.ranks.get(raw)) is not None:
                found[w] = r.to_bytes(4, "little")
            else:
                rest[raw] = w
        for some in together(sorted(rest, key=len)):  # words of like length end together
            for raw, tokens in zip(some, self.by_recursion(some), strict=True):
                found[rest[raw]] = tokens.astype("<u4").tobytes()
        return found

    def encode(self, texts: list[str]) -> list[bytes]:
        """Ids of each text as little-endian unsigned 32-bit integers."""
        return put_together([self.words.findall(t) for t in texts], self.known, self.learn)

    def decode(self, ids: list[bytes]) -> list[bytes]:
        """Bytes of each sequence of ids."""
        pieces = []
        for raw in ids:
            tokens = np.frombuffer(raw, "<u4")
            if len(tokens) and (tokens.max() >= len(self.valid) or not self.valid[tokens].all()):
                raise ValueError("an id is not in the vocabulary")
            cuts = np.flatnonzero(self.starts[tokens]) * 4
            edges = [0, *cuts[cuts > 0].tolist(), len(raw)]
            pieces.append(list(map(raw.__getitem__, map(slice, edges[:-1], edges[1:]))))
        return put_together(pieces, self.shown, self.show)

    def show(self, pieces: set[bytes]) -> dict[bytes, bytes]:
        """Bytes of pieces of id sequences."""
        lens = np.array([len(p) // 4 for p in pieces])
        out = self._given(PUT_TOGETHER, piece=np.repeat(np.arange(len(lens), dtype=np.int32), lens), place=np.arange(int(lens.sum()), dtype=np.int32), token=np.frombuffer(b"".join(pieces), "<u4").astype(np.int32))
        found = dict.fromkeys(pieces, b"")
        order = list(pieces)
        for k, text in zip(out["piece"].to_pylist(), out["text"].to_pylist(), strict=True):
            found[order[k]] = text.encode("latin-1")
        return found


def put_together(parts: list[list], known: dict, learn: Callable[[set], dict]) -> list[bytes]:
    """Each text from its parts. What is new is learned together; known keeps REMEMBERED entries at most."""
    new = set().union(*parts).difference(known)
    found = learn(new) if new else {}
    over = len(known) + len(found) - REMEMBERED
    known |= found
    out = [b"".join(map(known.__getitem__, some)) for some in parts]
    for w, _ in zip(found, range(over), strict=False):
        del known[w]
    return out


_codecs: dict[tuple[int, str], Codec] = {}


def codec(raw: bytes, pattern: str) -> Codec:
    """One for each worker and vocabulary."""
    key = (hash(raw), pattern)
    if key not in _codecs:
        _codecs.clear()
        _codecs[key] = Codec(raw, pattern)
    return _codecs[key]


def chunked(batches: Iterator[pa.RecordBatch], column: int, most: int = CHARACTERS) -> Iterator[pa.RecordBatch]:
    """Slices of batches whose texts have about `most` characters."""
    for b in batches:
        start = size = 0
        x = b.column(column)
        sizes = pa.compute.list_value_length(x) if pa.types.is_list(x.type) or pa.types.is_large_list(x.type) else pa.compute.binary_length(x)
        for i, n in enumerate(pa.compute.fill_null(sizes, 0).to_pylist()):
            size += n
            if size >= most:
                yield b.slice(start, i + 1 - start)
                start, size = i + 1, 0
        if start < b.num_rows:
            yield b.slice(start)


def mapped(docs: DataFrame, path: str, pattern: str, column: int, schema: str, f: Callable[[Codec, pa.RecordBatch], pa.RecordBatch]) -> DataFrame:
    with open(path, "rb") as file:
        raw = file.read(MOST_BYTES + 1)
    if len(raw) > MOST_BYTES:
        raise ValueError(f"{path} has more than {MOST_BYTES} bytes")
    shared = docs.sparkSession.sparkContext.broadcast(raw)

    def over(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        with codec(shared.value, pattern) as own:
            for b in chunked(batches, column):
                yield f(own, b)

    return docs.mapInArrow(over, schema)


def _texts(b: pa.RecordBatch, column: int) -> list[str]:
    return [x or "" for x in b.column(column).to_pylist()]


def encode(docs: DataFrame, path: str, pattern: str, text_col: str = "text", ids_col: str = "ids", n_col: str = "n_tokens") -> DataFrame:
    """docs with the ids (array of int) and their number in place of the text; a column of the input named like one of these gets _ behind."""
    others, taken = [], {*docs.columns, ids_col, n_col}
    for c in docs.columns:
        name = c
        while c in (ids_col, n_col) and name in taken:
            name += "_"
        taken.add(name)
        if c != text_col:
            others.append((c, name))
    rows = docs.select(F.col(f"`{text_col}`"), *(F.col(f"`{c}`").alias(name) for c, name in others))
    others = [name for _, name in others]
    kinds = dict(rows.dtypes)

    def f(own: Codec, b: pa.RecordBatch) -> pa.RecordBatch:
        ids = own.encode(_texts(b, 0))
        edges = np.cumsum([0, *(len(x) // 4 for x in ids)])
        lists = pa.ListArray.from_arrays(pa.array(edges, pa.int32()), pa.array(np.frombuffer(b"".join(ids), "<u4").astype(np.int32)))
        columns = [*(b.column(i + 1) for i in range(len(others))), pa.array(np.diff(edges), pa.int64()), lists]
        return pa.RecordBatch.from_arrays(columns, names=[*others, n_col, ids_col])

    return mapped(rows, path, pattern, 0, ", ".join(f"`{c}` {kinds[c]}" for c in others) + ", " * bool(others) + f"`{n_col}` long, `{ids_col}` array<int>", f)


def decode(rows: DataFrame, path: str, pattern: str, id_col: str = "doc_id", ids_col: str = "ids") -> DataFrame:
    """id and the decoded bytes of each row's ids; null ids are no ids."""
    kept = rows.select(F.col(id_col).alias("_id"), F.coalesce(F.col(ids_col), F.array().cast("array<int>")).alias("_ids"))
    kind = dict(kept.dtypes)["_id"]

    def f(own: Codec, b: pa.RecordBatch) -> pa.RecordBatch:
        return record_batch(_id=b.column(0), decoded=pa.array(own.decode([np.array(x, "<u4").tobytes() for x in b.column(1).to_pylist()]), pa.binary()))

    return mapped(kept, path, pattern, 1, f"_id {kind}, decoded binary", f).withColumnRenamed("_id", id_col)


def round_trip(docs: DataFrame, path: str, pattern: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, n_tokens, ids_sha256 and decoded_sha256: texts are encoded, and the ids decoded, in one pass."""
    rows = docs.select(F.col(id_col).alias("_id"), F.col(text_col).alias("_text"))
    kind = dict(rows.dtypes)["_id"]

    def f(own: Codec, b: pa.RecordBatch) -> pa.RecordBatch:
        ids = own.encode(_texts(b, 1))
        digests = [[hashlib.sha256(x).hexdigest() for x in some] for some in (ids, own.decode(ids))]
        return record_batch(_id=b.column(0), n_tokens=pa.array([len(x) // 4 for x in ids], pa.int64()), ids_sha256=pa.array(digests[0], pa.string()), decoded_sha256=pa.array(digests[1], pa.string()))

    return mapped(rows, path, pattern, 1, f"_id {kind}, n_tokens long, ids_sha256 string, decoded_sha256 string", f).withColumnRenamed("_id", id_col)
