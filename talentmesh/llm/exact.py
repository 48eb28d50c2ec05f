"""Exact duplicates: one 128-bit content hash per text, bytes compared inside every group."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from talentmesh.llm.common import WHITE_SPACE, body, row_mark, shuffle_partitions, stable, without

#: Tasks over which the copies of one text are spread before their bytes meet.
SALTS = 16


def normalised(text: str | Column = "text") -> Column:
    """The text with every run of white space replaced by one space; null is empty."""
    return F.regexp_replace(body(text), WHITE_SPACE, " ")


def content_hash(text: Column) -> Column:
    return F.unhex(F.md5(text.cast("binary")))


def same_content(
    items: DataFrame, hash_of: Callable[[Column], Column] = content_hash, many_repeats: bool = False
) -> DataFrame:
    """Groups of equal ``content`` among rows (id, content): id, keep_id, group_size, sha256.

    Groups are counted on hashes alone. Only groups with several rows have their bytes
    compared: aggregation on (hash, content) compares whole keys. Copies are spread over
    ``SALTS`` tasks first and meet as one row per salt. Contents that share a hash form
    classes of their own, told apart by their SHA-256. Spark broadcasts the repeated hashes
    while they are few; ``many_repeats`` says they are not, and contents are always shuffled.
    """
    hashed = stable(
        items.select("id", hash_of(F.col("content")).alias("hash"), F.sha2("content", 256).alias("sha256")), "hashes"
    )
    several = stable(hashed.groupBy("hash").count().where("count > 1").select("hash"), "repeated-hashes")
    several = several.hint("shuffle_merge") if many_repeats else several
    salt = F.pmod(F.xxhash64("id"), F.lit(SALTS)).alias("salt")
    members = (
        items.select("id", "content", hash_of(F.col("content")).alias("hash"), salt)
        .join(several, "hash", "left_semi")
        .repartition(shuffle_partitions(items.sparkSession), "hash", "salt")
    )
    size = (F.min("id").alias("keep_id"), F.count("*").alias("group_size"))
    classes = members.groupBy("hash", "salt", "content").agg(*size).groupBy("hash", "content").agg(
        F.min("keep_id").alias("keep_id"), F.sum("group_size").alias("group_size")
    )
    compared = stable(
        classes.select("hash", F.sha2("content", 256).alias("sha256"), "keep_id", "group_size"), "compared"
    )
    single = F.col("group_size").isNull()
    return hashed.join(compared, ["hash", "sha256"], "left").select(
        "id",
        F.when(single, F.col("id")).otherwise(F.col("keep_id")).alias("keep_id"),
        F.coalesce("group_size", F.lit(1)).cast("long").alias("group_size"),
        "sha256",
    )


def exact_groups(docs: DataFrame, hash_of: Callable[[Column], Column] = content_hash) -> DataFrame:
    """Which row stays of each group of equal texts, white space aside.

    Returns one row per input row: doc_id, keep_id (smallest doc_id of the group), group_size,
    kept, text_sha256. Only doc_id and text are read, so other columns cannot clash. Null text
    is empty text; empty texts form one group. Rows that repeat a doc_id count one by one in
    group_size, and all rows that carry keep_id are kept. A null doc_id never wins over a
    number. An empty table gives an empty result.
    """
    items = docs.select(F.col("doc_id").alias("id"), normalised().alias("content"))
    return same_content(items, hash_of).select(
        F.col("id").alias("doc_id"), "keep_id", "group_size",
        F.col("id").eqNullSafe(F.col("keep_id")).alias("kept"), F.col("sha256").alias("text_sha256"),
    )


def without_copies(docs: DataFrame) -> DataFrame:
    """``docs`` with one document of each group of equal texts, columns as they came.

    The row with the smallest doc_id stays; a row without one stays only if no row of its group
    has one. Rows that share a doc_id are decided one by one, by text; of rows that share doc_id
    and text one stays. Null text is empty text. An empty table gives an empty result.
    """
    row = F.struct(F.col("doc_id").isNull().alias("last"), F.col("doc_id").cast("long").alias("doc_id"), row_mark().alias("mark"))
    groups = same_content(docs.select(row.alias("id"), normalised().alias("content")))
    decided = stable(groups.select("id.doc_id", "id.mark", (F.col("id") == F.col("keep_id")).alias("kept")), "exact-decisions")
    again = decided.where("kept").groupBy("doc_id", "mark").count().where("count > 1")
    return without(docs, decided.where("NOT kept"), again)
