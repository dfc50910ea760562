"""Helpers of the training-data operators: stored tables, word hashes, components."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def shared_folder(spark: SparkSession) -> str:
    """The folder that all executors share, from ``spark.checkpoint.dir``.

    Only a ``local`` master, where driver and executors are one process, may do without the setting.
    """
    folder = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if folder is None:
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that every executor can reach")
        folder = tempfile.mkdtemp(prefix="taxlake-llm-")
        spark.conf.set("spark.checkpoint.dir", folder)
    return folder


#: Spark drops the shuffle files of a query at its end, instead of with the driver's next collection.
_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


@contextmanager
def _shuffles_dropped(spark: SparkSession) -> Iterator[None]:
    before = spark.conf.get(_CLEANUP, None)
    spark.conf.set(_CLEANUP, "true")
    try:
        yield
    finally:
        spark.conf.unset(_CLEANUP) if before is None else spark.conf.set(_CLEANUP, before)


def stored(df: DataFrame) -> DataFrame:
    """Write ``df`` as Parquet in the shared folder and read it back: cuts the lineage for good.

    Once it is written nothing reads the shuffles behind it again, so their files go at once.
    """
    spark = df.sparkSession
    path = f"{shared_folder(spark).rstrip('/')}/llm-{uuid.uuid4().hex}"
    with _shuffles_dropped(spark):
        df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def only(df: DataFrame, *names: str) -> DataFrame:
    """The named columns; a missing one is an error, every other column is left aside."""
    return df.select(*(F.col(f"`{n}`") for n in names))


# ---------------------------------------------------------------- words and shingles, in numpy

_MASK = (1 << 64) - 1


def _mix(x: np.ndarray) -> np.ndarray:
    """A bijective mixer on 64-bit values."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _odd(seed: int, n: int) -> np.ndarray:
    return _mix(np.arange(1, n + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15) + np.uint64(seed)) | np.uint64(1)


_IS_WORD = np.ones(256, dtype=bool)
_IS_WORD[[0x20, *range(0x09, 0x0E)]] = False
_BYTE = _odd(11, 256)
_BYTE[65:91] = _BYTE[97:123]  # A-Z as a-z
_BYTE[~_IS_WORD] = 0
_BASE = 0xD1342543DE82EF95


def text_buffers(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets) of a text column without copying; null texts are empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = column.fill_null("")
    large = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    _, offsets, data = column.buffers()
    offsets = np.frombuffer(offsets, dtype=np.int64 if large else np.int32)
    offsets = offsets[column.offset : column.offset + len(column) + 1].astype(np.int64)
    if data is None or not len(column):
        return np.zeros(0, dtype=np.uint8), np.zeros(len(column) + 1, dtype=np.int64)
    return np.frombuffer(data, dtype=np.uint8)[offsets[0] : offsets[-1]], offsets - offsets[0]


def slices(offsets: np.ndarray, limit: int = 1 << 21) -> Iterator[tuple[int, int]]:
    """Ranges of rows with at most ``limit`` bytes, or a single longer row."""
    start = 0
    while start < len(offsets) - 1:
        end = int(np.searchsorted(offsets, offsets[start] + limit, side="right")) - 1
        end = max(end, start + 1)
        yield start, end
        start = end


def word_hashes(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(hash of each word with A-Z lowered, number of words before each row)."""
    if not len(data):
        return np.zeros(0, dtype=np.uint64), np.zeros(len(offsets), dtype=np.int64)
    word = _IS_WORD[data]
    first = word.copy()
    first[1:] &= ~word[:-1]
    heads = offsets[:-1][offsets[:-1] < len(data)]
    first[heads] = word[heads]
    starts = np.flatnonzero(first)
    before = np.searchsorted(starts, offsets)
    if not len(starts):
        return np.zeros(0, dtype=np.uint64), before
    within = np.arange(len(data)) - np.concatenate([[0], starts])[np.cumsum(first)]
    longest = int(np.max(np.diff(np.append(starts, len(data)))))
    power = np.cumprod(np.full(longest + 1, _BASE, dtype=np.uint64))
    values = _BYTE[data] * power[np.minimum(within, longest)]
    return _mix(np.add.reduceat(values, starts)), before


def shingles(hashes: np.ndarray, k: int) -> np.ndarray:
    """Sorted distinct hashes of the ``k``-word shingles of one text.

    A text with fewer words is one shingle, a text without words has none.
    """
    if not len(hashes):
        return hashes
    weight = _odd(29, k + 1)
    if len(hashes) < k:
        return _mix(np.array([np.sum(hashes * weight[: len(hashes)]) + np.uint64(len(hashes))], dtype=np.uint64))
    total = np.full(len(hashes) - k + 1, k, dtype=np.uint64)
    for j in range(k):
        total += hashes[j : len(hashes) - k + 1 + j] * weight[j]
    return np.unique(_mix(total))


def shingle_sets(column: pa.Array, k: int) -> Iterator[np.ndarray]:
    """The shingle set of each text of a column."""
    data, offsets = text_buffers(column)
    for start, end in slices(offsets):
        at = offsets[start : end + 1]
        hashes, before = word_hashes(data[at[0] : at[-1]], at - at[0])
        for i in range(end - start):
            yield shingles(hashes[before[i] : before[i + 1]], k)


def long_lists(values: list[np.ndarray]) -> pa.Array:
    offsets = np.zeros(len(values) + 1, dtype=np.int32)
    np.cumsum([len(v) for v in values], out=offsets[1:])
    flat = np.concatenate(values) if values else np.zeros(0, dtype=np.uint64)
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(flat.view(np.int64)))


# ---------------------------------------------------------------- components


def components(edges: DataFrame) -> DataFrame:
    """(id, component) for every id of ``edges`` (a, b): the smallest id that links reach.

    Large-star and small-star rounds as joins and grouped minima; each round is stored, so the work
    survives lost executors and the plan stays short. No edge list is ever collected.
    """
    links = stored(
        edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("u <> v").distinct()
    )
    seen = None
    while True:
        # large star: every neighbour above u points to the least of u's neighbourhood
        both = links.union(links.select("v", "u"))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))
        large = both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        # small star: every neighbour below u, and u itself, points to the least of them
        below = large.groupBy("u").agg(F.min("v").alias("m"))
        small = (
            large.join(below, "u")
            .select(F.explode(F.array(F.struct(F.col("v").alias("u"), F.col("m").alias("v")), F.struct("u", F.col("m").alias("v")))).alias("e"))
            .select("e.u", "e.v")
            .where("u <> v")
            .distinct()
        )
        links = stored(small)
        # links are distinct: they are the same as before if their number and the sum of their hashes are
        now = links.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(20,0)"))).first()
        if now == seen:
            break
        seen = now
    return links.select(F.col("u").alias("id"), F.col("v").alias("component")).union(
        links.select(F.col("v").alias("id"), F.col("v").alias("component")).distinct()
    )


def words_of(text: Column) -> Column:
    """Words: runs of characters other than ASCII white space."""
    return F.filter(F.split(F.coalesce(text, F.lit("")), "[\\x20\\x09-\\x0D]+"), lambda w: w != "")
