"""Helpers shared by the corpus operators: tables, the shared folder, and durable cut points."""

from __future__ import annotations

import contextlib
import ctypes
import gc
import sys
import tempfile
import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: White space of the exact-copy and shingle contracts.
WHITE_SPACE = r"[\x20\x09-\x0D]+"

_SCRATCH: dict[str, str] = {}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share, as ``spark.checkpoint.dir`` names it.

    Only a single-machine session may go without the setting; it gets a scratch folder.
    """
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if folder:
        return folder.rstrip("/")
    if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
        raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
    app = spark.sparkContext.applicationId
    if app not in _SCRATCH:
        _SCRATCH[app] = "file://" + tempfile.mkdtemp(prefix="talentmesh-shared-")
    return _SCRATCH[app]


def stable(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` into the shared folder and read it back: lineage ends, lost executors cost nothing."""
    path = f"{shared_dir(df.sparkSession)}/{name}-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def shuffle_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def body(text: str | Column = "text") -> Column:
    """A text, null counting as empty."""
    return F.coalesce(F.col(text) if isinstance(text, str) else text, F.lit(""))


def fold_of(doc_id: str = "doc_id") -> Column:
    """crc32 of the id's decimal text, modulo 3; fold 1 is held out from every model."""
    return F.pmod(F.crc32(F.col(doc_id).cast("string").cast("binary")), F.lit(3))


#: Bits of a membership filter: fixed, so its size does not follow the data.
FILTER_BITS = 1 << 22


def maybe_among(ids: DataFrame, column: str | Column) -> Column:
    """A test that is true for every value of the one column of ``ids``, and rarely for others.

    For thinning out a large table before a join on ``column``: the bit map is a scalar
    subquery of fixed size, so what fails the test is not shuffled. It saturates as ``ids``
    grows, and then only stops helping. Nulls fail.
    """
    name = ids.columns[0]
    slot = F.pmod(F.xxhash64(ids[name].cast("long")), F.lit(FILTER_BITS))
    bits = ids.where(ids[name].isNotNull()).select(slot.alias("slot"))
    words = bits.groupBy((F.col("slot") / 64).cast("long").alias("at")).agg(
        F.bit_or(F.expr("shiftleft(1L, CAST(slot % 64 AS INT))")).alias("word")
    )
    every = ids.sparkSession.range(FILTER_BITS // 64).join(F.broadcast(words), F.col("id") == F.col("at"), "left")
    pairs = F.sort_array(F.collect_list(F.struct("id", F.coalesce("word", F.lit(0)).cast("long").alias("word"))))
    bitmap = every.agg(F.transform(pairs, lambda x: x.word).alias("bits")).scalar()
    value = F.col(column) if isinstance(column, str) else column
    own = F.pmod(F.xxhash64(value.cast("long")), F.lit(FILTER_BITS))
    word = F.element_at(bitmap, (F.floor(own / 64) + 1).cast("int"))
    return F.coalesce(F.getbit(word, (own % 64).cast("int")) == 1, F.lit(False)) & value.isNotNull()


def row_mark() -> Column:
    """A hash that, with the doc_id, names a row of a document table: rows that share both are equal texts."""
    return F.xxhash64("doc_id", body())


def row_ids(docs: DataFrame) -> Column:
    """A long for each different (doc_id, text): the doc_id itself where only one text has it.

    Texts that share a doc_id or have none are named by a negative hash.
    """
    ids = docs.select(F.col("doc_id").cast("long").alias("doc_id"), row_mark().alias("mark")).where("doc_id IS NOT NULL")
    shared = ids.groupBy("doc_id").agg(F.min("mark").alias("low"), F.max("mark").alias("high")).where("low <> high")
    unclear = F.col("doc_id").isNull() | maybe_among(stable(shared.select("doc_id"), "shared-ids"), "doc_id")
    return F.when(unclear, F.lit(-1) - F.pmod(row_mark(), F.lit(1 << 62))).otherwise(F.col("doc_id").cast("long"))


def without(docs: DataFrame, dropped: DataFrame, repeated: DataFrame) -> DataFrame:
    """``docs`` less the rows that ``dropped`` names, columns as they came.

    Both tables have the columns doc_id (null for rows without one) and mark (``row_mark``), so
    rows that share a doc_id are decided one by one. Of rows that ``repeated`` names and that
    share both, one stays: that with the smallest hash of all columns. Only rows that may be
    meant are moved.
    """
    own, text = docs["doc_id"].cast("long"), F.xxhash64(docs["doc_id"], body(docs["text"]))
    named = lambda rows: stable(
        rows.select(F.col("doc_id").cast("long").alias("__named_id"), F.col("mark").alias("__named_mark")).distinct(), "named-rows")
    meant = lambda rows: (text == rows["__named_mark"]) & own.eqNullSafe(rows["__named_id"])
    out, twice = named(dropped), named(repeated)
    maybe_out = maybe_among(out.select("__named_mark"), row_mark())
    stay = docs.where(~maybe_out).unionByName(docs.where(maybe_out).join(out, meant(out), "left_anti").select(docs.columns))
    maybe_twice = maybe_among(twice.select("__named_mark"), row_mark())
    # Rows that the filter lets through by chance are groups of their own.
    again = stay.where(maybe_twice).groupBy(F.col("doc_id").alias("__id"), row_mark().alias("__mark")).agg(
        F.min_by(F.struct(*docs.columns), F.xxhash64(F.to_json(F.struct(*docs.columns)))).alias("__row"))
    return stay.where(~maybe_twice).unionByName(again.select("__row.*"))


def tidy(work: Callable[[Iterator], Iterator]) -> Callable[[Iterator], Iterator]:
    """``work`` for mapInArrow, whose worker gives free memory back at the end: it waits for other tasks."""

    def run(batches: Iterator) -> Iterator:
        try:
            yield from work(batches)
        finally:
            gc.collect()
            pa.default_memory_pool().release_unused()
            if sys.platform == "linux":
                with contextlib.suppress(AttributeError, OSError):  # another C library
                    ctypes.CDLL(None).malloc_trim(0)

    return run
