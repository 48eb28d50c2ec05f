"""Frozen snapshots: what the inventory held when a task first asked, kept byte for byte.

Three tables in one folder. ``rows`` holds every different row once, as JSON under its SHA-256.
``lists`` holds the order of the rows of a country as of one state of the inventory. ``tasks``
says which list a task was given. All three are written insert-if-absent, rows first and tasks
last, each request into a folder of its own name: a request that runs again writes the same, and
a task that already has a list keeps it.
"""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from talentmesh.operators.inventory import FACTS, KEY, country_positions
from talentmesh.session import durable_cut

FROZEN = (*KEY, *FACTS)
ROWS, LISTS, TASKS = (
    "sha256 string, body string", "country string, state string, snapshot_order bigint, sha256 string",
    "task_id string, country string, state string",
)
#: Members whose digests make one block digest.
DIGEST_BLOCK = 1024


def frozen_row() -> Column:
    """A row as JSON text, absent values left out."""
    return F.to_json(F.struct(*FROZEN))


def _kept(spark: SparkSession, folder: str, name: str, schema: str, request: str) -> DataFrame:
    """What requests other than ``request`` have written; nothing before the first."""
    try:
        kept = spark.read.schema(schema + ", request string").parquet(f"{folder}/{name}")
    except AnalysisException as missing:
        if missing.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], schema)
    return kept.where(F.col("request") != request).drop("request")


def freeze(tasks: DataFrame, open_rows: DataFrame, folder: str, request: str) -> None:
    """Give every task of ``tasks(task_id, country)`` without a list the present one of its country.

    ``request`` names this state of the inventory. ``open_rows`` are inventory rows.
    """
    spark = tasks.sparkSession
    write = lambda df, name: df.write.mode("overwrite").parquet(f"{folder}/{name}/request={request}")
    known = _kept(spark, folder, "tasks", TASKS, request).select("task_id")
    fresh = durable_cut(tasks.join(known, "task_id", "left_anti").select("task_id", "country", F.lit(request).alias("state")))
    wanted = fresh.select("country").distinct()
    body = durable_cut(
        country_positions(open_rows.join(wanted, "country", "left_semi")).withColumn("body", frozen_row())
        .select("country", "snapshot_order", F.sha2("body", 256).alias("sha256"), "body"))
    old = _kept(spark, folder, "rows", ROWS, request).select("sha256")
    write(body.groupBy("sha256").agg(F.first("body").alias("body")).join(old, "sha256", "left_anti"), "rows")
    write(body.select("country", F.lit(request).alias("state"), "snapshot_order", "sha256"), "lists")
    write(fresh, "tasks")


def thaw(spark: SparkSession, folder: str, tasks: DataFrame | None = None) -> DataFrame:
    """``task_id, snapshot_order, sha256, body`` of the tasks given, or of all."""
    read = lambda name, schema: spark.read.schema(schema).parquet(f"{folder}/{name}")
    given = read("tasks", TASKS)
    given = given if tasks is None else given.join(tasks.select("task_id"), "task_id", "left_semi")
    listed = read("lists", LISTS).join(read("rows", ROWS), "sha256")
    return given.join(listed, ["country", "state"]).select("task_id", "snapshot_order", "sha256", "body")


def thawed_rows(frozen: DataFrame, schema: str) -> DataFrame:
    """The rows of ``thaw`` as columns again; ``schema`` describes the frozen JSON."""
    return frozen.select("task_id", "snapshot_order", F.from_json("body", schema).alias("r")).select("task_id", "snapshot_order", "r.*")


def list_digests(spark: SparkSession, folder: str) -> DataFrame:
    """``country, state, n_rows, list_sha256``: a digest over digests of blocks of the list, in order."""
    lists = spark.read.schema(LISTS).parquet(f"{folder}/lists")
    ordered = lambda at, value: F.array_join(F.transform(F.sort_array(F.collect_list(F.struct(at, value))), lambda x: x[value]), "")
    blocks = lists.groupBy("country", "state", F.floor(F.col("snapshot_order") / DIGEST_BLOCK).alias("block")).agg(
        F.count(F.lit(1)).alias("n"), F.sha2(ordered("snapshot_order", "sha256"), 256).alias("digest"))
    return blocks.groupBy("country", "state").agg(
        F.sum("n").alias("n_rows"), F.sha2(ordered("block", "digest"), 256).alias("list_sha256"))


def task_lists(spark: SparkSession, folder: str) -> DataFrame:
    """``task_id, state, n_rows, list_sha256``: which list each task holds."""
    given = spark.read.schema(TASKS).parquet(f"{folder}/tasks")
    return given.join(list_digests(spark, folder), ["country", "state"], "left").select(
        "task_id", "state", F.coalesce("n_rows", F.lit(0)).alias("n_rows"), "list_sha256")
