"""What the training-data operators share: row keys, the shared folder, words, Arrow mapping."""

from __future__ import annotations

import gc
import tempfile
import uuid
from collections.abc import Callable, Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: A word: a run of characters other than the six ASCII blanks. bytes.split() cuts at the same six.
WORD = r"[^\x20\x09-\x0D]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
BLANKS = " \t\n\x0b\x0c\r"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir, else (one machine only) a temporary one."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if found:
        return found.rstrip("/")
    jsc = spark.sparkContext._jsc.sc()
    if jsc.getCheckpointDir().isEmpty():
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="larkspur-"))
    return jsc.getCheckpointDir().get().rstrip("/")


def checkpointed(df: DataFrame) -> DataFrame:
    """df written to the shared folder, so that a lost executor costs no recomputation and later reads agree."""
    spark = df.sparkSession
    folder = shared_dir(spark)
    if spark.sparkContext._jsc.sc().getCheckpointDir().isEmpty():
        spark.sparkContext.setCheckpointDir(folder)
    return df.checkpoint(eager=True)


def tidy(spark: SparkSession) -> None:
    """Has the driver's collector find shuffles that nothing will read again (their results are checkpointed), so that their files go."""
    gc.collect()
    spark.sparkContext._jvm.System.gc()


def run_folder(spark: SparkSession, what: str) -> str:
    """A new folder's path in the shared folder; what is written there goes when the session's JVM ends, if not before."""
    own = f"{shared_dir(spark)}/{what}-{uuid.uuid4().hex}"
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(own)
    store = path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    store.mkdirs(path)
    store.deleteOnExit(path)
    return f"{own}/data"


def removed(spark: SparkSession, folder: str) -> None:
    """The folder goes, with all in it."""
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder)
    path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


#: Plans of only these give their rows in the same partitions and order each time they run.
STEADY = {"Project", "Filter", "SubqueryAlias", "LogicalRelation", "LocalRelation", "LogicalRDD", "Range"}


def settled(df: DataFrame) -> DataFrame:
    """df, if it is read from files or given rows; else (shuffled, cached or joined) written to the shared folder, so that row numbers hold."""
    todo = [df._jdf.queryExecution().optimizedPlan()]
    while todo:
        plan = todo.pop()
        if plan.getClass().getSimpleName() not in STEADY:
            return checkpointed(df)
        todo += [plan.children().apply(i) for i in range(plan.children().size())]
    return df


def with_rid(df: DataFrame, name: str = "_rid") -> DataFrame:
    """A row number by partition and place. It is the same in every run over settled rows, so it may key a join back."""
    return df.withColumn(name, F.monotonically_increasing_id())


#: Keys that are broadcast at most by joined_hot.
HOT = 4096


def joined_hot(big: DataFrame, small: DataFrame, keys: list[str], n: str, total: int, how: str = "inner") -> DataFrame:
    """big joined with small on keys (null equals null); how: inner or left.

    small has a row for each key, with n, its rows of big; total: rows of big. Keys with over 1 / HOT of the rows, so fewer than HOT, are
    broadcast: the rows of a hot key stay where they lie. The others are shuffled.
    """
    own = small.withColumnsRenamed({k: f"_of{k}" for k in keys})
    alike = reduce(lambda a, b: a & b, (F.col(k).eqNullSafe(F.col(f"_of{k}")) for k in keys))
    hot = F.broadcast(own.where(F.col(n) * HOT > total))
    often, rest = big.join(hot, alike), big.join(hot, alike, "left_anti").join(own, alike, how)
    return often.unionByName(rest).drop(*(f"_of{k}" for k in keys))


def ascii_lower(c: Column) -> Column:
    return F.translate(c, UPPER, LOWER)


def map_arrow(df: DataFrame, f: Callable[[pa.RecordBatch], pa.RecordBatch], schema: str) -> DataFrame:
    """f for each Arrow batch."""

    def over(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield f(b)

    return df.mapInArrow(over, schema)


def packed(counts: np.ndarray) -> bytes:
    """Counts of 64 bits, a byte for each small one."""
    return len(counts).to_bytes(8, "little") + np.minimum(counts, 255).astype(np.uint8).tobytes() + counts[counts >= 255].astype(np.int64).tobytes()


def unpacked(raw: bytes) -> np.ndarray:
    n = int.from_bytes(raw[:8], "little")
    out = np.frombuffer(raw, np.uint8, n, 8).astype(np.int64)
    out[out == 255] = np.frombuffer(raw, np.int64, -1, 8 + n) if len(raw) > 8 + n else []
    return out


def texts(column: pa.Array) -> list[str]:
    """Null is the empty text."""
    return [x if x is not None else "" for x in column.to_pylist()]


def record_batch(**columns: pa.Array) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays(list(columns.values()), names=list(columns))


def rows_by_rid(df: DataFrame, rids: DataFrame, how: str) -> DataFrame:
    """The rows of df whose row number is ("left_semi") or is not ("left_anti") in rids (_rid); columns of df may have any names."""
    packed = with_rid(df.select(F.struct(*(F.col(f"`{c}`") for c in df.columns)).alias("_row")))
    return packed.join(rids.select("_rid"), "_rid", how).select("_row.*")
