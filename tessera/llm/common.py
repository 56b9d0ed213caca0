"""Shared pieces of the training-data operators: word scanning on Arrow buffers and tables in the shared folder.

A *word* is a maximal run of ASCII letters, ASCII digits and characters outside ASCII, after lower-casing.
"""

from __future__ import annotations

import atexit
import tempfile
import uuid
from collections.abc import Callable, Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Bytes of text scanned at once; keeps the scratch arrays near 100 MB however long a batch is.
SCAN_BYTES = 2 << 20
_BASE = np.uint64(0x9E3779B97F4A7C15)
_WORD = np.zeros(256, dtype=bool)
_WORD[[*range(ord("a"), ord("z") + 1), *range(ord("0"), ord("9") + 1), *range(128, 256)]] = True
_powers: list[np.ndarray] = []


class Words(NamedTuple):
    """Words of several texts one after another."""

    hash: np.ndarray  # uint64, one for each word
    first: np.ndarray  # int64, text i has words first[i]:first[i + 1]


def mix(x: np.ndarray) -> np.ndarray:
    """Finaliser of splitmix64: spreads every input bit over all output bits."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the hash base and of its inverse modulo 2**64, n of each at least."""
    if not _powers or len(_powers[0]) < n:
        m = max(n, SCAN_BYTES + (1 << 18))
        inverse = np.uint64(pow(int(_BASE), -1, 1 << 64))
        both = []
        for b in (_BASE, inverse):
            x = np.full(m, b, dtype=np.uint64)
            x[0] = 1
            both.append(np.cumprod(x, dtype=np.uint64))
        _powers[:] = both
    return _powers[0], _powers[1]


def _scan(texts: pa.Array) -> Words:
    low = pc.binary_join_element_wise(pc.utf8_lower(texts), "", "\n").cast(pa.large_binary())
    offsets = np.frombuffer(low.buffers()[1], dtype=np.int64)[low.offset : low.offset + len(low) + 1]
    data = np.frombuffer(low.buffers()[2], dtype=np.uint8)[offsets[0] : offsets[-1]]
    inside = _WORD[data]
    edge = np.empty(len(data) + 1, dtype=bool)
    edge[0], edge[-1] = inside[0], inside[-1]
    np.not_equal(inside[1:], inside[:-1], out=edge[1:-1])
    at = np.flatnonzero(edge)
    start, end = at[::2], at[1::2]
    up, down = powers(len(data))
    total = np.zeros(len(data) + 1, dtype=np.uint64)
    np.cumsum(up[: len(data)] * (data + np.uint64(1)), out=total[1:])
    h = mix((total[end] - total[start]) * down[start])
    return Words(h, np.searchsorted(start, offsets - offsets[0]))


def pieces(texts: pa.Array, limit: int = 0) -> Iterator[tuple[int, int]]:
    """Row ranges of at most `limit` bytes (SCAN_BYTES if 0), of one row at least."""
    sizes = pc.fill_null(pc.binary_length(texts), 0).to_numpy(zero_copy_only=False)
    ends = np.cumsum(sizes)
    lo = 0
    while lo < len(sizes):
        base = ends[lo - 1] if lo else 0
        hi = max(lo + 1, int(np.searchsorted(ends, base + (limit or SCAN_BYTES), side="right")))
        yield lo, hi
        lo = hi


def scan(texts: pa.Array) -> Iterator[tuple[int, int, Words]]:
    """Words of each piece of a column of texts; null counts as empty."""
    texts = pc.fill_null(texts, "")
    for lo, hi in pieces(texts):
        yield lo, hi, _scan(texts.slice(lo, hi - lo))


def within(lengths: np.ndarray) -> np.ndarray:
    """0, 1, ... n - 1 for each n of lengths, one after another."""
    total = int(lengths.sum())
    return np.arange(total) - np.repeat(np.cumsum(lengths) - lengths, lengths)


def blobs(values: np.ndarray, first: np.ndarray) -> pa.Array:
    """A binary column: row i holds the bytes of values[first[i]:first[i + 1]]."""
    width = values.dtype.itemsize
    offsets = pa.py_buffer(((first - first[0]) * width).astype(np.int32))
    data = pa.py_buffer(np.ascontiguousarray(values[first[0] : first[-1]]))
    return pa.Array.from_buffers(pa.binary(), len(first) - 1, [None, offsets, data])


def unblob(column: pa.Array, dtype: type) -> tuple[np.ndarray, np.ndarray]:
    """The inverse of blobs(): values and first."""
    offsets = np.frombuffer(column.buffers()[1], dtype=np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    data = column.buffers()[2]
    if data is None or offsets[-1] == offsets[0]:
        return np.zeros(0, dtype=dtype), np.zeros(len(column) + 1, dtype=np.int64)
    raw = np.frombuffer(data, dtype=np.uint8)[offsets[0] : offsets[-1]]
    return raw.view(dtype), (offsets - offsets[0]) // np.dtype(dtype).itemsize


def shared_dir(spark: SparkSession) -> str:
    """The folder of spark.checkpoint.dir. Where that is unset, a local session gets a folder of its own; on a cluster, where executors could
    not read what others wrote to their own disks, that is an error."""
    found = spark.sparkContext.getCheckpointDir() or spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if not spark.sparkContext.master.split("[")[0] == "local":
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        found = tempfile.mkdtemp(prefix="tessera-")
        spark.sparkContext.setCheckpointDir(found)
    return found.rstrip("/")


def _remove(spark: SparkSession, path: str) -> None:
    try:
        jvm = spark.sparkContext._jvm
        p = jvm.org.apache.hadoop.fs.Path(path)
        p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)
    except Exception:  # the session has ended; whoever owns the shared folder clears it
        pass


def stored(df: DataFrame, name: str, options: dict[str, str] | None = None) -> DataFrame:
    """df written as Parquet (with the options given) in the shared folder and read again: cuts lineage, survives the loss of executors."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/tessera/{name}-{uuid.uuid4().hex}"
    df.write.options(**options or {}).parquet(path)
    atexit.register(_remove, spark, path)
    return spark.read.schema(df.schema).parquet(path)


def mapped(df: DataFrame, run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]) -> DataFrame:
    """df.mapInArrow(run) with df's own schema; columns travel under plain names, as Spark cannot pass on one with a dot in it."""
    plain = df.toDF(*(f"c{i}" for i in range(len(df.columns))))
    return plain.mapInArrow(run, plain.schema).toDF(*df.columns)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _word_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for lo, hi, words in scan(batch.column(1)):
            n = pa.array(np.diff(words.first))
            yield pa.RecordBatch.from_arrays([batch.column(0).slice(lo, hi - lo), n, blobs(words.hash.astype(np.uint32), words.first)], names=["doc_id", "n_words", "words"])


def tokenised(docs: DataFrame) -> DataFrame:
    """doc_id, n_words and words (uint32 hashes) of every row, in the shared folder."""
    kind = docs.schema["doc_id"].dataType.simpleString()
    return stored(docs.select("doc_id", "text").mapInArrow(_word_rows, f"doc_id {kind}, n_words long, words binary"), "words")


#: Partial sums that one task adds up at once.
FAN_IN = 64


def summed(rows: DataFrame, partial: Callable[[Iterator[pa.RecordBatch]], np.ndarray], size: int, block: int = 1 << 13) -> np.ndarray:
    """Sum over all tasks of the float32 vector of `size` that partial() makes of a task's batches.

    Vectors travel in blocks and are added up in double precision along a tree, FAN_IN at a time, so that what a task holds does not
    grow with the number of tasks; only the sum, of fixed size, reaches the driver.
    """

    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        task = TaskContext.get().partitionId()
        total = partial(batches)
        starts = list(range(0, size, block))
        yield pa.RecordBatch.from_arrays([pa.array(starts, pa.int64()), pa.array([task] * len(starts), pa.int64()), pa.array([total[b : b + block].astype(np.float32).tobytes() for b in starts], pa.binary())], names=["block", "task", "sums"])

    def add(kind: type):
        def run(table: pa.Table) -> pa.Table:
            total = sum(np.frombuffer(x.as_py(), dtype=kind).astype(np.float64) for x in table.column("sums"))
            return pa.table({"block": table.column("block").slice(0, 1), "task": table.column("task").slice(0, 1), "sums": pa.array([total.tobytes()], pa.binary())})

        return run

    schema = "block long, task long, sums binary"
    parts, kind, tasks = rows.mapInArrow(send, schema), np.float32, rows.rdd.getNumPartitions()
    while True:
        parts = parts.withColumn("task", (F.col("task") / FAN_IN).cast("long")).groupBy("block", "task").applyInArrow(add(kind), schema)
        kind, tasks = np.float64, -(-tasks // FAN_IN)
        if tasks <= 1:
            break
    found = {r.block: np.frombuffer(bytes(r.sums)) for r in parts.collect()}
    return np.concatenate([found[b] for b in sorted(found)]) if found else np.zeros(size)
