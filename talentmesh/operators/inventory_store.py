"""The inventory on storage: hash buckets, of which a batch rewrites only those it touches.

``data/bucket=b/written=v`` holds bucket ``b`` as version ``v`` left it. A version's manifest
says, for every bucket, which of them is current. A batch reads the buckets that its keys fall
into, merges them, writes them under its own version and then the manifest; until that is there
the version before it is the newest. A batch that runs again overwrites its own buckets and its
own manifest. Older versions stay readable.

Give the store as many buckets as its largest state has gigabytes; the driver holds one number
a bucket.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from talentmesh.operators import inventory
from talentmesh.schemas import INVENTORY
from talentmesh.session import durable_cut

BUCKETS = 64
#: Rows carry the country in the form it is asked for; files are sorted by it.
STORED = T.StructType([*INVENTORY.fields, T.StructField("country_key", T.StringType())])


def bucket_of(buckets: int) -> Column:
    return F.pmod(F.xxhash64(*inventory.KEY), F.lit(buckets)).cast("int")


def manifest(spark: SparkSession, path: str, version: int) -> dict[int, int]:
    """The version that wrote each bucket, as of ``version``; version 0 is empty."""
    if version < 1:
        return {}
    rows = spark.read.schema("bucket int, written int").parquet(f"{path}/manifest/version={version}")
    return {r["bucket"]: r["written"] for r in rows.collect()}


def latest_version(spark: SparkSession, path: str) -> int:
    kept = spark.read.schema("bucket int, written int, version int").parquet(f"{path}/manifest")
    return kept.agg(F.coalesce(F.max("version"), F.lit(0)).alias("v")).head()["v"]


def _buckets(spark: SparkSession, path: str, current: dict[int, int]) -> DataFrame:
    if not current:
        return inventory.empty_inventory(spark)
    folders = [f"{path}/data/bucket={b}/written={v}" for b, v in sorted(current.items())]
    return spark.read.schema(STORED).parquet(*folders)


def read_version(
    spark: SparkSession, path: str, version: int | None = None, country: str | None = None, sources: Sequence[str] = (),
) -> DataFrame:
    """The inventory as ``version`` left it, the newest by default; only its own files are listed.

    ``country`` and ``sources`` are filters that reach the files: rows are stored in order of
    both, so row groups of other countries and sources are not read.
    """
    at = latest_version(spark, path) if version is None else version
    rows = _buckets(spark, path, manifest(spark, path, at))
    if country is not None and "country_key" in rows.columns:
        rows = rows.where(F.col("country_key") == country.strip().lower())
    if sources:
        rows = rows.where(F.col("source").isin(*sources))
    return rows.drop("country_key")


def merge_version(
    batch: DataFrame, path: str, version: int, run_id: str, buckets: int = BUCKETS, ttl: str = "INTERVAL 2 DAYS",
    ties: tuple[str, ...] = (),
) -> None:
    """Merge observations into version ``version - 1`` of the store and write ``version``.

    An empty batch makes a version with the same buckets.
    """
    spark = batch.sparkSession
    batch = durable_cut(batch.withColumn("bucket", bucket_of(buckets)))
    touched = {r["bucket"] for r in batch.select("bucket").distinct().collect()}
    before = manifest(spark, path, version - 1)
    if touched:
        old = _buckets(spark, path, {b: v for b, v in before.items() if b in touched}).drop("country_key")
        merged = inventory.upsert(old, batch.drop("bucket"), run_id, ttl, ties)
        merged = merged.withColumn("bucket", bucket_of(buckets)).withColumn("written", F.lit(version))
        merged = merged.withColumn("country_key", F.lower(F.trim("country"))).repartition("bucket")
        merged.sortWithinPartitions("bucket", "country_key", "source").write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(
            "bucket", "written").parquet(f"{path}/data")
    now = before | dict.fromkeys(touched, version)
    rows = spark.createDataFrame(sorted(now.items()), "bucket int, written int")
    rows.coalesce(1).write.mode("overwrite").parquet(f"{path}/manifest/version={version}")
