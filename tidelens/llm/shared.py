"""What the operators share: the cluster's shared folder, connected components, and words as arrays of hashes."""

import ctypes
import re
import sys
import tempfile
import types
import uuid
from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Words are runs of other characters than space and 0x09-0x0D, in regular expressions of Spark and DuckDB alike.
WORD = r"[^\x20\x09-\x0D]+"


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir. Where it is unset, a temporary one in local mode, else an error."""
    context = spark.sparkContext
    path = context.getConf().get("spark.checkpoint.dir") or context.getCheckpointDir()
    if not path:
        if not re.fullmatch(r"local(\[[^\]]*\])?", context.master):
            raise ValueError("spark.checkpoint.dir is to name a folder that driver and executors share")
        path = tempfile.mkdtemp(prefix="tidelens-")
        context.setCheckpointDir(path)
    return path


def scratch(spark: SparkSession, name: str) -> str:
    """A new path in the shared folder."""
    return f"{shared_dir(spark).rstrip('/')}/tidelens-{uuid.uuid4().hex}/{name}"


def cut(df: DataFrame) -> DataFrame:
    """df without its lineage, held in the shared folder."""
    shared_dir(df.sparkSession)
    return df.checkpoint()


def table(df: DataFrame, name: str) -> DataFrame:
    """df written as Parquet in the shared folder and read again; unlike cut(), later scans prune columns."""
    path = scratch(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def small_batches(spark: SparkSession, rows: int = 512, size: str = "8m") -> None:
    """Arrow batches of few rows and few bytes, as texts may be long; a longer text is a batch alone. The session keeps the settings, as
    they are read when a query runs."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(rows))
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", size)


def release() -> None:
    """Gives memory that this Python process no longer uses back to the system, as Spark's workers live on from task to task."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # where the C library has it
    if trim:
        trim(0)


def freed(run: Callable) -> Callable:
    """run, a function for mapInArrow, that gives unused memory back at its end."""

    def done(batches):
        yield from run(batches)
        release()

    return done


def freed_group(run: Callable) -> Callable:
    """run, a function for applyInArrow of a group, that gives unused memory back at its end."""

    def done(rows):
        out = run(rows)
        release()
        return out

    return done


def freed_groups(run: Callable) -> Callable:
    """The same for a function of two co-grouped tables."""

    def done(left, right):
        out = run(left, right)
        release()
        return out

    return done


def kept(key: tuple, make: Callable):
    """What a Python worker keeps from task to task: make() the first time, then the same, until a task asks for another key. A task
    uses one key only, so a worker holds what one stage needs and not what those before it left."""
    store = sys.modules.setdefault("_tidelens_kept", types.ModuleType("_tidelens_kept")).__dict__.setdefault("held", {})
    if key not in store:
        store.clear()
        store[key] = make()
    return store[key]


def split_by_ids(docs: DataFrame, ids: DataFrame, slots: int = 1 << 22) -> tuple[DataFrame, DataFrame]:
    """Two parts of docs: rows that may have a doc_id of ids (doc_id), and rows that surely don't.

    A row belongs to the first if its hash falls in a slot of one of ids. The table of slots has a fixed size (a bit each), so
    any scan can hold it, and a join that follows shuffles few rows; where ids are many more than slots all rows are
    in the first part, and the join alone decides.
    """
    slot = F.pmod(F.xxhash64(F.col("doc_id").cast("long")), F.lit(slots))
    held = ids.select(slot.alias("slot")).groupBy(F.shiftright("slot", 6).alias("id")).agg(F.expr("bit_or(shiftleft(1L, cast(slot & 63 as int)))").alias("bits"))
    every = docs.sparkSession.range(slots // 64).join(held, "id", "left").select("id", F.coalesce("bits", F.lit(0).cast("long")).alias("bits"))
    row = table(every.agg(F.transform(F.array_sort(F.collect_list(F.struct("id", "bits"))), lambda x: x["bits"]).alias("bits")), "slots")
    hit = F.getbit(F.get(row.scalar(), F.shiftright(slot, 6).cast("int")), F.pmod(slot, F.lit(64)).cast("int")) == 1
    known = F.col("doc_id").isNotNull()
    return docs.where(known & hit), docs.where(~(known & hit))


def components(edges: DataFrame) -> DataFrame:
    """(node, component): the least node that edges (a, b) reach, for each node of an edge.

    Alternating large-star and small-star steps on the edge table: every node is linked to the least of its
    neighbours until nothing changes. Only edges travel; a node with many neighbours is a skewed join key,
    which adaptive execution splits, and the minima are pre-aggregated.
    """
    pairs = cut(edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).where("a > b").distinct())
    before = None
    while True:
        both = pairs.unionAll(pairs.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        # large star: neighbours above a node move to the least of its neighbourhood
        large = both.where("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b"))
        large = large.where("a > b").distinct()
        # small star: what lies below a node is linked to the least of it
        low = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(low, "a")
        small = small.select(F.col("b").alias("a"), F.col("m").alias("b")).unionAll(small.select("a", F.col("m").alias("b")))
        pairs = cut(small.where("a > b").distinct())
        now = pairs.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if now == before:
            break
        before = now
    return pairs.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("component")).unionByName(
        pairs.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct()
    )


_SEPARATOR = np.zeros(256, bool)
_SEPARATOR[[9, 10, 11, 12, 13, 32]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_MASK = np.array([(1 << 8 * k) - 1 for k in range(8)] + [2**64 - 1], np.uint64)


def mix(x: np.ndarray, salt: int = 0) -> np.ndarray:
    """A bijection of unsigned 64-bit integers that spreads every bit. Works on a copy in place, as the arrays may be large."""
    x = x + np.uint64(salt * 0x9E3779B97F4A7C15 & 2**64 - 1)
    x ^= x >> np.uint64(30)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


class Words:
    """The words of a column of texts (null: none), read from its UTF-8 bytes.

    data: the bytes; at: where documents start in them; first: number of words before each document, and of all at the end;
    hashes: 64 bits a word. lower: A-Z count as a-z.
    """

    def __init__(self, column: pa.ChunkedArray | pa.Array, lower: bool = False):
        if isinstance(column, pa.ChunkedArray):
            column = column.combine_chunks() if column.num_chunks != 1 else column.chunk(0)
        column = column.cast(pa.large_binary()).fill_null(b"")
        _, offsets, data = column.buffers()
        at = np.frombuffer(offsets, np.int64)[column.offset : column.offset + len(column) + 1]
        data = np.frombuffer(data, np.uint8)[at[0] : at[-1]] if data is not None else np.zeros(0, np.uint8)
        at = at - at[0]
        self.data, self.at, n = data, at, len(data)
        apart = _SEPARATOR[data]
        before, after = np.empty(n, bool), np.empty(n, bool)
        before[1:], after[:-1] = apart[:-1], apart[1:]
        full = at[1:] > at[:-1]
        before[at[:-1][full]] = True
        after[at[1:][full] - 1] = True
        start = np.flatnonzero(~apart & before)
        end = np.flatnonzero(~apart & after) + 1
        del apart, before, after
        self.first = np.searchsorted(start, at)
        self.hashes = self._hash(_LOWER[data] if lower else data, start, end)

    def _hash(self, data: np.ndarray, starts: np.ndarray, ends: np.ndarray, block: int = 1 << 16) -> np.ndarray:
        """Each word's bytes, eight at a time."""
        padded = np.concatenate([data, np.zeros(8, np.uint8)])
        eight = np.ndarray((len(data) + 1,), np.dtype("<u8"), padded, strides=(1,))
        out = np.empty(len(starts), np.uint64)
        for k in range(0, len(out), block):
            start = starts[k : k + block]
            length = ends[k : k + block] - start
            h = mix((eight[start] & _MASK[np.minimum(length, 8)]) + length.astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93))
            more, done = np.flatnonzero(length > 8), 8
            while len(more):
                left = length[more] - done
                h[more] = mix(h[more] * np.uint64(0xA0761D6478BD642F) ^ (eight[start[more] + done] & _MASK[np.minimum(left, 8)]))
                more, done = more[left > 8], done + 8
            out[k : k + block] = h
        return out

    def runs(self, width: int) -> tuple[np.ndarray, np.ndarray]:
        """First words of all runs of so many words of one document, and the runs' hashes."""
        h, n = self.hashes, len(self.hashes)
        if n < width:
            return np.zeros(0, np.int64), np.zeros(0, np.uint64)
        stop = np.repeat(self.first[1:], np.diff(self.first))
        at = np.flatnonzero(np.arange(n) + width <= stop)
        return at, mix(self.combined(width)[at])

    def combined(self, width: int) -> np.ndarray:
        """A linear combination of each word's hash and those of the next, across documents too."""
        h = self.hashes
        out, factor = h[: len(h) - width + 1].copy(), 1
        for k in range(1, width):
            factor = factor * 0x9FB21C651E98DF25 & 2**64 - 1
            out += h[k : len(h) - width + 1 + k] * np.uint64(factor)
        return out
