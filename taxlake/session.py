"""Session defaults for running the jobs outside a managed cluster."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def build_session(master: str | None = None, app_name: str = "taxlake", **conf: str) -> SparkSession:
    """A session with adaptive execution and skew handling on; ``conf`` keys use ``__`` for dots."""
    builder = SparkSession.builder.appName(app_name)
    if master:
        builder = builder.master(master)
    defaults = {
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.coalescePartitions.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.session.timeZone": "UTC",
        "spark.ui.enabled": "false",
    }
    defaults.update({key.replace("__", "."): value for key, value in conf.items()})
    for key, value in defaults.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def shared_folder(spark: SparkSession) -> str:
    """The folder that all executors share, from ``spark.checkpoint.dir``.

    Only a local master may fall back to a temporary folder of its own.
    """
    folder = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if folder is None:
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder every executor can reach")
        folder = tempfile.mkdtemp(prefix="taxlake-checkpoint-")
        spark.conf.set("spark.checkpoint.dir", folder)
    return folder.rstrip("/")


def cut_lineage(df: DataFrame) -> DataFrame:
    """Write a result that several branches read to the cluster's shared folder, and read it back.

    It is computed once, later reads take only the columns that they need, and nothing is lost with an executor.
    """
    path = f"{shared_folder(df.sparkSession)}/rows-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


#: Slots of the map behind ``possibly_named``; 64 of them share a word, so at most half a million words are sent.
SLOTS = 1 << 25


def possibly_named(rows: DataFrame, named: DataFrame, key: str = "id") -> DataFrame:
    """``rows`` without most of those whose ``key`` is not in ``named``; for use before an exact join on it.

    Each named key marks one slot of a bit map by its hash. The map has a fixed greatest size, whatever the number of
    keys, and is sent to all tasks, so that wide rows that nobody asks for are not shuffled. Rows of a key that falls
    into a marked slot by chance stay: the join behind decides. No row is lost but those with a null key.
    """
    if rows.schema[key].dataType != named.schema[key].dataType:
        return rows
    slot = F.pmod(F.xxhash64(F.col(key)), F.lit(SLOTS))
    bit = F.expr("shiftleft(1L, CAST(_slot & 63 AS INT))")
    words = (
        named.where(F.col(key).isNotNull()).select(slot.alias("_slot"))
        .groupBy(F.shiftright("_slot", 6).alias("_marked")).agg(F.bit_or(bit).alias("_bits"))
    )
    held = rows.withColumn("_slot", slot)
    found = held.join(F.broadcast(words), F.shiftright(held["_slot"], 6) == F.col("_marked"))
    return found.where(F.col("_bits").bitwiseAND(bit) != 0).select(*rows.columns)


def with_place_in_part(rows: DataFrame, *order: str) -> DataFrame:
    """``rows`` in range partitions by ``order``, each sorted, with ``_part`` (number) and ``_rank`` (place in it, from 1).

    The parts are drawn anew whenever they are computed: write them before they are read twice.
    """
    place = F.monotonically_increasing_id()  # the part above the 33rd bit, the row below
    numbered = rows.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("_row", place)
    rank = F.col("_row").bitwiseAND(F.lit((1 << 33) - 1)) + 1
    return numbered.select(*rows.columns, F.shiftright("_row", 33).cast("int").alias("_part"), rank.alias("_rank"))
