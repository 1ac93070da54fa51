"""Language-model scoring by a hidden Markov model, beside an add-one unigram base.

A token is a word, or the end of a text. Words fall into classes by hash; the number of classes grows with the distinct training
words (one for about WORDS_PER_CLASS, between CLASSES[0] and CLASSES[1], so that the broadcast model has a bound).
P(word | state) = P(class | state) * P(word | class): the first is trained by Baum-Welch, the second is the
add-one share of the word within its class, with room for one unseen word in each class. The likelihood of a text is the
product of the second over its words and the exact scaled forward recursion over its classes.

How the corpus is gathered: texts become blocks of local word ids and 64-bit word hashes, written once as compressed Parquet in the
shared folder; words are not moved again. The distinct words of each block, with their counts in training texts, go by hash
range to tasks that add them up over all blocks and send each block the corpus counts of its own words; a word in a third of all texts
costs one entry a block. The scoring task of a file of blocks gets their counts and opens the file by its name.
Each Baum-Welch pass adds up expected counts (states x classes) over all training texts. A text is one sequence, however
long: forward messages are kept every few steps only, and made anew segment by segment in the backward recursion.
Training ends when a pass gains less than GAIN of the log-likelihood, or after `passes`.

Defined results: a null or empty text is one end token; a null id is text of the training part; rows are scored one
by one, repeated or not; with no training text counts are 0 and scores stay finite; an empty table gives an empty
result; very long texts are scored and trained whole, in memory that holds one text's word ids; other columns are not read, whatever
their names. Two words are one if their 64-bit hashes are equal (about 1 in 37 million for a million distinct words).
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
import xxhash
from pyarrow import fs as pafs
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from larkspur.llm.common import checkpointed, packed, record_batch, removed, run_folder, unpacked

STATES, PASSES, GAIN = 6, 4, 1e-4
#: Classes at least and at most (powers of two); words of a class, about.
CLASSES, WORDS_PER_CLASS = (1 << 13, 1 << 17), 256
#: Distinct words and text bytes after which a block is closed; bytes of a row group of blocks.
BLOCK_WORDS, BLOCK_BYTES, ROW_GROUP = 60_000, 6 << 20, 8 << 20
#: Word entries that a task adds up at a time, about.
PER_BUCKET = 1 << 20
#: Sequences run together through a step of the recursion; tokens of sequences that wait to be sorted by length.
LANES, WAITING = 1024, 1 << 22
#: Tokens of a lane group whose messages are all kept; else they are kept each SEGMENT steps and made anew between.
KEPT, SEGMENT = 1 << 18, 256
SEED = 20240229


def held_out(id_: Column, folds: int = 7, fold: int = 2) -> Column:
    return F.coalesce(F.crc32(id_.cast("string").cast("binary")) % folds == fold, F.lit(False))


def classes_of(hashes: np.ndarray, classes: int) -> np.ndarray:
    """From 1 to classes, a power of two; class 0 is the end's."""
    return (hashes & np.uint64(classes - 1)).astype(np.int32) + 1


class Block:
    def __init__(self):
        self.local, self.ids, self.held, self.lens, self.words, self.size = {}, [], [], [], [], 0

    def add(self, id_: object, held: bool, text: str) -> None:
        raw, local = text.encode("utf-8", "surrogatepass").lower(), self.local
        words = raw.split()
        for w in words:
            if w not in local:
                local[w] = len(local)
        self.ids.append(id_)
        self.held.append(held)
        self.lens.append(len(words))
        self.words.append(np.fromiter(map(local.__getitem__, words), np.uint32, len(words)))
        self.size += len(raw) + 64

    def full(self) -> bool:
        return len(self.local) >= BLOCK_WORDS or self.size >= BLOCK_BYTES

    def row(self) -> tuple:
        """Local ids are in the order of hashes, so that a range of hashes is a run of words."""
        hashes = np.fromiter(map(xxhash.xxh64_intdigest, self.local), np.uint64, len(self.local))
        order = np.argsort(hashes)
        place = np.empty(len(order), np.uint32)
        place[order] = np.arange(len(order), dtype=np.uint32)
        words = place[np.concatenate(self.words)] if len(order) else np.zeros(0, np.uint32)
        trained = np.repeat(~np.array(self.held, bool), self.lens)
        counts = np.bincount(words[trained], minlength=len(hashes))
        return self.ids, self.held, self.lens, words.astype(local_type(len(hashes))).tobytes(), hashes[order].tobytes(), packed(counts)


def local_type(n: int) -> type:
    return np.uint16 if n < 1 << 16 else np.uint32


COLUMNS = "_ids array<{kind}>, _helds array<boolean>, _lens array<long>, _words binary, _hashes binary, _counts binary"


def blocks(docs: DataFrame, folder: str) -> DataFrame:
    """docs: _id, _held, _text. Gives _block, _ids, _helds, _lens, _words (local ids), _hashes and _counts (in training texts) of the local words; written to folder."""
    kind = dict(docs.dtypes)["_id"]

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        types = None

        def out(row: tuple) -> pa.RecordBatch:
            return record_batch(**{n: pa.array([x], t) for n, t, x in zip(("_ids", "_helds", "_lens", "_words", "_hashes", "_counts"), (pa.list_(types), pa.list_(pa.bool_()), pa.list_(pa.int64()), pa.binary(), pa.binary(), pa.binary()), row, strict=True)})

        block = Block()
        for b in batches:
            types = b.schema.field(0).type
            for id_, held, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(2), strict=True):
                block.add(id_, held, text.as_py() or "")
                if block.full():
                    yield out(block.row())
                    block = Block()
        if block.ids:
            yield out(block.row())

    found = docs.mapInArrow(cut, COLUMNS.format(kind=kind)).withColumn("_block", F.monotonically_increasing_id())
    found.write.option("compression", "zstd").option("parquet.block.size", ROW_GROUP).option("parquet.enable.dictionary", "false").parquet(folder)
    return docs.sparkSession.read.schema(found.schema).parquet(folder)


def word_counts(parts: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Corpus counts of each block's words (_block, _bucket, _found: by place), and the distinct training words and tokens of each class by bucket, at CLASSES[1] classes."""
    entries = parts.agg(F.sum(F.octet_length("_hashes"))).first()[0] or 0
    n_buckets = max(1, -(-entries // (8 * PER_BUCKET)))

    def scatter(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for block, hashes, counts in zip(*(b.column(i) for i in range(3)), strict=True):
                block, hashes, counts = block.as_py(), np.frombuffer(hashes.as_py(), np.uint64), unpacked(counts.as_py())
                where = (hashes >> np.uint64(32)) * np.uint64(n_buckets) >> np.uint64(32)
                edges = np.searchsorted(where, np.arange(n_buckets + 1, dtype=np.uint64)).tolist()
                rows = [(k, i, j) for k, (i, j) in enumerate(zip(edges[:-1], edges[1:], strict=True)) if i < j]
                yield record_batch(_bucket=pa.array([k for k, _, _ in rows], pa.int64()), _block=pa.array([block] * len(rows), pa.int64()), _hashes=pa.array([hashes[i:j].tobytes() for _, i, j in rows], pa.binary()), _counts=pa.array([packed(counts[i:j]) for _, i, j in rows], pa.binary()))

    def add_up(t: pa.Table) -> pa.Table:
        hashes = [np.frombuffer(x.as_py(), np.uint64) for x in t["_hashes"]]
        counts = np.concatenate([unpacked(x.as_py()) for x in t["_counts"]])
        distinct, inverse = np.unique(np.concatenate(hashes), return_inverse=True)
        total = np.zeros(len(distinct), np.int64)
        np.add.at(total, inverse, counts)
        each = np.split(total[inverse], np.cumsum([len(h) for h in hashes])[:-1])
        of = classes_of(distinct, CLASSES[1])
        # The first row also carries what the bucket adds to each class: its distinct words and its tokens.
        words, tokens = np.zeros(CLASSES[1] + 1, np.int64), np.zeros(CLASSES[1] + 1, np.int64)
        np.add.at(words, of, total > 0)
        np.add.at(tokens, of, total)
        n = len(hashes)
        return pa.table({"_block": t["_block"], "_bucket": t["_bucket"], "_found": pa.array([packed(x) for x in each], pa.binary()), "_class_words": pa.array([packed(words)] + [None] * (n - 1), pa.binary()), "_class_tokens": pa.array([packed(tokens)] + [None] * (n - 1), pa.binary())})

    sent = parts.select("_block", "_hashes", "_counts").mapInArrow(scatter, "_bucket long, _block long, _hashes binary, _counts binary")
    back = checkpointed(sent.groupBy("_bucket").applyInArrow(add_up, "_block long, _bucket long, _found binary, _class_words binary, _class_tokens binary"))
    return back.select("_block", "_bucket", "_found"), back.where("_class_words is not null").select("_class_words", "_class_tokens")


def summed(rows: DataFrame, columns: tuple[str, ...], read=lambda x: np.frombuffer(x, np.float32).astype(np.float64), write=lambda x: x.astype(np.float32).tobytes()) -> list[np.ndarray] | None:
    """Element sums of columns of equally long arrays as bytes: first within partitions, then over groups of partitions; the driver gets one row."""

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = None
        for b in batches:
            for row in zip(*(b.column(i) for i in range(len(columns))), strict=True):
                found = [read(x.as_py()) for x in row]
                total = found if total is None else [a + x for a, x in zip(total, found, strict=True)]
        if total is not None:
            yield record_batch(**{c: pa.array([write(x)], pa.binary()) for c, x in zip(columns, total, strict=True)})

    schema = ", ".join(f"{c} binary" for c in columns)
    once = rows.select(*columns).mapInArrow(add, schema)
    got = once.repartition(8).mapInArrow(add, schema).repartition(1).mapInArrow(add, schema).first()
    return got and [read(got[c]) for c in columns]


class Model:
    """start: K; move: K x K; emit: K x (classes + 1). Rows add up to 1."""

    def __init__(self, start: np.ndarray, move: np.ndarray, emit: np.ndarray):
        self.start, self.move, self.emit = start, move, emit

    @staticmethod
    def first(states: int, class_tokens: np.ndarray, seed: int = SEED) -> Model:
        """States that stay as they are, around the classes' shares."""
        rng = np.random.default_rng(seed)
        share = (class_tokens + 1.0) / (class_tokens + 1.0).sum()
        emit = share * rng.gamma(2.0, 1.0, (states, len(share)))
        move = np.full((states, states), 0.1 / max(1, states - 1)) + np.eye(states) * (0.9 if states > 1 else 1.0)
        return Model(np.full(states, 1 / states), move / move.sum(1, keepdims=True), emit / emit.sum(1, keepdims=True))

    def log10(self, sequence: np.ndarray) -> float:
        """log10 of the likelihood of a sequence of classes, by the scaled forward recursion."""
        return float(self.log10s([sequence])[0])

    def log10s(self, sequences: list[np.ndarray]) -> np.ndarray:
        """Of many, in groups of like length; each at least one class long."""
        out, emit = np.empty(len(sequences)), np.ascontiguousarray(self.emit.T)
        for order in lanes(sequences):
            flat, starts, lens = laid_out(sequences, order)
            total, alpha, live = np.zeros(len(order)), None, len(order)
            for t in range(lens[0]):
                while lens[live - 1] <= t:
                    live -= 1
                alpha = (self.start if t == 0 else alpha[:live] @ self.move) * emit[flat[starts[:live] + t]]
                scale = alpha.sum(1)
                alpha /= scale[:, None]
                total[:live] += np.log10(scale)
            out[order] = total
        return out

    def expected(self, sequences: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Baum-Welch counts of whole sequences (first states, moves, emissions), and their log10 likelihood."""
        states = len(self.start)
        total = np.zeros(states), np.zeros((states, states)), np.zeros(self.emit.shape), np.zeros(1)
        for order in lanes(sequences):
            self._expected(*laid_out(sequences, order), *total)
        return total

    def _expected(self, flat: np.ndarray, starts: np.ndarray, lens: np.ndarray, first: np.ndarray, moves: np.ndarray, emits: np.ndarray, log10: np.ndarray) -> None:
        """Adds to first, moves, emits and log10."""
        emit, steps, move = np.ascontiguousarray(self.emit.T), int(lens[0]), self.move
        live = np.searchsorted(-lens, -np.arange(steps + 1), side="left")  # sequences with more than t classes
        segment = steps if len(flat) <= KEPT else SEGMENT

        def forward(alpha: np.ndarray | None, begin: int, end: int, keep: list | None) -> np.ndarray:
            for t in range(begin, end):
                at = flat[starts[: live[t]] + t]
                b = emit[at]
                alpha = (self.start if alpha is None else alpha[: live[t]] @ move) * b
                scale = alpha.sum(1, keepdims=True)
                alpha = alpha / scale
                if keep is not None:
                    keep.append((alpha, b, at))
                    log10[0] += np.log10(scale).sum()
            return alpha

        marks, alpha = [], None
        for begin in range(0, steps, segment):
            marks.append(alpha)
            if begin + segment < steps:
                alpha = forward(alpha, begin, begin + segment, None)
        beta = after = None
        where, weight, waiting = [], [], 0
        for begin in range((steps - 1) // segment * segment, -1, -segment):
            kept: list = []
            forward(marks.pop(), begin, min(begin + segment, steps), kept)
            for alpha, b, at in reversed(kept):
                now = np.ones_like(alpha)
                if after is not None:
                    more = len(after)
                    ahead = after * beta
                    ahead /= ((alpha[:more] @ move) * ahead).sum(1, keepdims=True)
                    moves += move * (alpha[:more].T @ ahead)
                    now[:more] = ahead @ move.T
                gamma = alpha * now
                gamma /= gamma.sum(1, keepdims=True)
                beta, after = now, b
                where.append(at)
                weight.append(gamma)
                waiting += len(at)
            if waiting >= KEPT or begin == 0:
                places, shares = np.concatenate(where), np.concatenate(weight)
                for k in range(len(emits)):
                    emits[k] += np.bincount(places, weights=shares[:, k], minlength=emits.shape[1])
                where, weight, waiting = [], [], 0
        first += gamma.sum(0)

    def maximised(self, start: np.ndarray, move: np.ndarray, emit: np.ndarray, class_tokens: np.ndarray) -> Model:
        """From summed counts; the classes' shares, weighing one token a state for each 200 classes, keep every class possible."""
        prior = (class_tokens + 1.0) / (class_tokens + 1.0).sum() * (len(class_tokens) / 200)
        start, move, emit = start + 1e-3, move + 1e-3, emit + prior
        return Model(start / start.sum(), move / move.sum(1, keepdims=True), emit / emit.sum(1, keepdims=True))


def lanes(sequences: list[np.ndarray]) -> Iterator[np.ndarray]:
    """Places of sequences, longest first, in groups that run together."""
    order = np.argsort([-len(s) for s in sequences], kind="stable")
    for i in range(0, len(order), LANES):
        yield order[i : i + LANES]


def laid_out(sequences: list[np.ndarray], order: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    lens = np.array([len(sequences[i]) for i in order])
    return np.concatenate([sequences[i] for i in order]), np.cumsum(lens) - lens, lens


def sequences(lens: list[int], words: np.ndarray, local: np.ndarray) -> Iterator[np.ndarray]:
    """The classes of each text of a block, the end included. local: classes of the block's words."""
    end, at = np.zeros(1, np.int32), 0
    for n in lens:
        yield np.concatenate([local[words[at : at + n]], end])
        at += n


def words_of(raw: bytes, n_local: int) -> np.ndarray:
    return np.frombuffer(raw, local_type(n_local))


def baum_welch(parts: DataFrame, class_tokens: np.ndarray, states: int = STATES, passes: int = PASSES) -> Model:
    spark, model, classes, last = parts.sparkSession, Model.first(states, class_tokens), len(class_tokens) - 1, None
    texts = parts.select("_helds", "_lens", "_words", "_hashes")
    names = ("_start", "_move", "_emit", "_log10")
    for _ in range(passes):
        shared = spark.sparkContext.broadcast(model)

        def count(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            own, total, waiting, size = shared.value, None, [], 0

            def add(found: tuple) -> tuple:
                return found if total is None else tuple(a + b for a, b in zip(total, found, strict=True))

            for b in batches:
                for row in zip(*(b.column(i) for i in range(4)), strict=True):
                    helds, lens, words, hashes = (x.as_py() for x in row)
                    hashes = np.frombuffer(hashes, np.uint64)
                    for held, s in zip(helds, sequences(lens, words_of(words, len(hashes)), classes_of(hashes, classes)), strict=True):
                        if not held:
                            waiting.append(s)
                            size += len(s)
                            if size >= WAITING:
                                total, waiting, size = add(own.expected(waiting)), [], 0
            if waiting:
                total = add(own.expected(waiting))
            if total is not None:
                yield record_batch(**{n: pa.array([x.astype(np.float32).tobytes()], pa.binary()) for n, x in zip(names, total, strict=True)})

        found = summed(texts.mapInArrow(count, ", ".join(f"{n} binary" for n in names)), names)
        shared.destroy()
        if found is None:  # no training text
            break
        start, move, emit, log10 = found
        model = model.maximised(start, move.reshape(states, states), emit.reshape(states, classes + 1), class_tokens)
        if last is not None and log10[0] - last < GAIN * abs(last):
            break
        last = log10[0]
    return model


def score(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", folds: int = 7, fold: int = 2, states: int = STATES, passes: int = PASSES) -> DataFrame:
    """id, held_out, n_tokens, n_known, train_tokens, base_score and score (log10) for each row. The held-out fold trains nothing."""
    spark = docs.sparkSession
    rows = docs.select(F.col(id_col).alias("_id"), held_out(F.col(id_col), folds, fold).alias("_held"), F.col(text_col).alias("_text"))
    kind, id_type = dict(rows.dtypes)["_id"], to_arrow_type(rows.schema["_id"].dataType)
    folder = run_folder(spark, "hmm")
    parts = blocks(rows, folder)
    back, of_buckets = word_counts(parts)
    texts = parts.agg(F.sum(F.size(F.filter("_helds", lambda h: ~h)))).first()[0] or 0
    words, tokens = summed(of_buckets, ("_class_words", "_class_tokens"), unpacked, packed) or (np.zeros(CLASSES[1] + 1, np.int64),) * 2
    n_train, distinct = int(tokens.sum()) + texts, int(words.sum()) + (texts > 0)
    classes = min(CLASSES[1], max(CLASSES[0], 1 << max(0, distinct // WORDS_PER_CLASS).bit_length()))
    words, tokens = (np.concatenate([[0], x[1:].reshape(-1, classes).sum(0)]) for x in (words, tokens))
    all_tokens = tokens.copy()
    all_tokens[0] = texts
    model = baum_welch(parts, all_tokens, states, passes)
    shared = spark.sparkContext.broadcast((model, np.log10(tokens + words + 1.0)))
    floor = np.log10(n_train + distinct + 1.0)

    def finish(t: pa.Table) -> pa.Table:
        """Of a file of blocks."""
        own, room = shared.value
        path = next(x for x in t["_path"].to_pylist() if x is not None)
        t = t.filter(pa.compute.is_valid(t["_block"])).sort_by([("_block", "ascending"), ("_bucket", "ascending")])
        block_of, found = t["_block"].to_numpy(), t["_found"].combine_chunks()
        columns: dict[str, list] = {c: [] for c in ("_id", "held_out", "n_tokens", "n_known", "base_score", "inner", "states")}
        waiting, size = [], 0
        store, name = pafs.FileSystem.from_uri(path)
        with store.open_input_file(name) as source:
            file = pq.ParquetFile(source)
            for b in file.iter_batches(batch_size=1, columns=["_ids", "_helds", "_lens", "_words", "_hashes", "_block"], use_threads=False):
                main = b.to_pylist()[0]
                hashes, lens = np.frombuffer(main["_hashes"], np.uint64), np.array(main["_lens"])
                i, j = np.searchsorted(block_of, [main["_block"], main["_block"] + 1])
                counts = np.concatenate([np.zeros(0, np.int64), *(unpacked(found[k].as_py()) for k in range(i, j))])
                local, flat = classes_of(hashes, classes), words_of(main["_words"], len(hashes))
                logs = np.log10(counts + 1.0)
                ends = np.concatenate([[0], np.cumsum(lens)])
                run = lambda x: np.diff(np.concatenate([[0.0], np.cumsum(x[flat])])[ends])  # noqa: B023, E731
                n = lens + 1
                columns["_id"] += main["_ids"]
                columns["held_out"] += main["_helds"]
                columns["n_tokens"].append(n)
                columns["n_known"].append(run((counts > 0).astype(np.float64)).round().astype(np.int64) + (texts > 0))
                columns["base_score"].append(run(logs) + np.log10(texts + 1.0) - n * floor)
                columns["inner"].append(run(logs - room[local]))
                waiting += sequences(main["_lens"], flat, local)
                size += len(flat)
                if size >= WAITING:
                    columns["states"].append(own.log10s(waiting))
                    waiting, size = [], 0
        if waiting:
            columns["states"].append(own.log10s(waiting))
        joined = {c: np.concatenate(x) for c, x in columns.items() if c not in ("_id", "held_out")}
        return pa.table({"_id": pa.array(columns["_id"], id_type), "held_out": pa.array(columns["held_out"], pa.bool_()), "n_tokens": pa.array(joined["n_tokens"], pa.int64()), "n_known": pa.array(joined["n_known"], pa.int64()), "train_tokens": pa.array([n_train] * len(joined["n_tokens"]), pa.int64()), "base_score": pa.array(joined["base_score"], pa.float64()), "score": pa.array(joined["inner"] + joined["states"], pa.float64())})

    part = F.shiftright("_block", 33).alias("_part")  # of monotonically_increasing_id: the task that wrote the block, hence the file
    files = parts.select(part, F.col("_metadata.file_path").alias("_path")).distinct().select("_part", "_path", F.lit(None).cast("long").alias("_block"), F.lit(None).cast("long").alias("_bucket"), F.lit(None).cast("binary").alias("_found"))
    answers = back.select(part, F.lit(None).cast("string").alias("_path"), "_block", "_bucket", "_found")
    done = checkpointed(files.unionByName(answers).groupBy("_part").applyInArrow(finish, f"_id {kind}, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double"))
    removed(spark, folder)
    return done.withColumnRenamed("_id", id_col)
