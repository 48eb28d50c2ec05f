"""Stream jobs run to completion over the events table."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from talentmesh.operators import inventory, inventory_store, snapshots
from talentmesh.plans import views
from talentmesh.plans.inventory_queries import CUT, STOCK
from talentmesh.plans.registry import query
from talentmesh.session import configure, shared_folder
from talentmesh.streaming import inventory_stream as streams


def work_folder(spark: SparkSession) -> str:
    """A new folder below the shared one."""
    return f"{shared_folder(spark)}/stream-{uuid.uuid4().hex}"


def event_stream(spark: SparkSession, sf: str) -> DataFrame:
    configure(spark)
    return (
        spark.readStream.schema(streams.OBSERVATION_SCHEMA)
        .option("pathGlobFilter", "events.parquet").parquet(sf)
        .withColumn("ts", F.col("ts").cast("timestamp"))
    )


def _finish(stream: DataFrame, folder: str) -> DataFrame:
    spark = stream.sparkSession
    run = (
        stream.writeStream.format("parquet").option("path", f"{folder}/out")
        .option("checkpointLocation", f"{folder}/ckpt").trigger(availableNow=True).start()
    )
    run.awaitTermination()
    return spark.read.schema(stream.schema).parquet(f"{folder}/out")


LANDINGS = (
    "event_id % 3 = 0", "event_id % 3 = 1 OR event_id % 6 = 0", "event_id % 3 = 2 OR event_id % 9 = 1",
)
"""Which events land when: each landing holds rows older than the one before, and two repeat some."""


@query("stream_inventory", "T01 J11 W01", f"""
WITH o AS (SELECT 's' || (user_id % 4) AS source, CAST(user_id AS VARCHAR) AS source_job_id, event_type, ts, event_id,
    CASE WHEN event_id % 3 = 2 OR event_id % 9 = 1 THEN 2 WHEN event_id % 3 = 1 OR event_id % 6 = 0 THEN 1 ELSE 0 END AS landed FROM events)
SELECT source, source_job_id, arg_max(event_type, (ts, event_id)) AS title,
  strftime(min(ts), '%Y-%m-%d %H:%M:%S') AS first_seen, strftime(max(ts), '%Y-%m-%d %H:%M:%S') AS last_seen,
  'batch-' || max(landed) AS run
FROM o GROUP BY 1, 2
""")
def stream_inventory(spark: SparkSession, sf: str) -> DataFrame:
    """Three landings of events, each a micro-batch; the result is read from the newest version."""
    from talentmesh.plans.inventory_queries import observations

    folder = work_folder(spark)
    events = views.table(spark, sf, "events")
    empty = observations(spark, sf).limit(0)

    def rows(batch: DataFrame) -> DataFrame:
        made = batch.select(
            F.concat(F.lit("s"), F.col("user_id") % 4).alias("source"),
            F.col("user_id").cast("string").alias("source_job_id"),
            F.col("event_type").alias("title"), F.col("ts").alias("seen_at"), "event_id")
        return empty.unionByName(made, allowMissingColumns=True)

    for nth, landed in enumerate(LANDINGS):
        events.where(landed).write.mode("overwrite").parquet(f"{folder}/in/landing={nth}")
        stream = streams.observed(spark, f"{folder}/in/*", files_per_batch=1_000_000)
        run = streams.keep_inventory(stream, f"{folder}/inventory", f"{folder}/ckpt", rows, ties=("event_id",))
        run.awaitTermination()
    at = lambda c: F.date_format(c, "yyyy-MM-dd HH:mm:ss")
    return inventory_store.read_version(spark, f"{folder}/inventory").select(
        "source", "source_job_id", "title", at("first_seen_at").alias("first_seen"),
        at("last_seen_at").alias("last_seen"), F.col("last_source_run_id").alias("run"))


@query("stored_inventory", "P31 J11 2.10", f"""
WITH {STOCK} SELECT source, source_job_id, title, run FROM stock WHERE country = 'Sri Lanka' AND source IN ('s0', 's3')
""")
def stored_inventory(spark: SparkSession, sf: str) -> DataFrame:
    """Two runs merged into the store; one country and two sources read back, by filters that reach the files."""
    from talentmesh.plans.inventory_queries import observations

    path, seen = f"{work_folder(spark)}/inventory", observations(spark, sf)
    for version, part in enumerate((F.col("seen_at") < CUT, F.col("seen_at") >= CUT), 1):
        inventory_store.merge_version(seen.where(part), path, version, f"r{version}")
    rows = inventory_store.read_version(spark, path, country="Sri Lanka", sources=("s0", "s3"))
    return rows.select("source", "source_job_id", "title", F.col("last_source_run_id").alias("run"))


@query("frozen_snapshots", "T04 F39 W10", f"""
WITH {STOCK},
first AS (SELECT source, source_job_id, country, arg_max(event_type, ts) AS title, max(ts) AS last_seen, arg_max(props, ts) AS props FROM (
  SELECT o.*, props FROM (SELECT *, 's' || (user_id % 4) AS source, CAST(user_id AS VARCHAR) AS source_job_id,
    CASE WHEN user_id % 3 = 0 THEN 'Sri Lanka' ELSE 'Germany' END AS country FROM events) o) WHERE ts < TIMESTAMP '{CUT}' GROUP BY 1, 2, 3),
every AS (SELECT source, source_job_id, country, arg_max(event_type, ts) AS title, max(ts) AS last_seen, arg_max(props, ts) AS props FROM (
  SELECT *, 's' || (user_id % 4) AS source, CAST(user_id AS VARCHAR) AS source_job_id,
    CASE WHEN user_id % 3 = 0 THEN 'Sri Lanka' ELSE 'Germany' END AS country FROM events) GROUP BY 1, 2, 3),
states AS (SELECT 'first' AS state, * FROM first UNION ALL SELECT 'second', * FROM every),
frozen AS (SELECT state, country, row_number() OVER (PARTITION BY state, country ORDER BY last_seen DESC, source, source_job_id) - 1 AS n,
  sha256('{{"source":"' || source || '","source_job_id":"' || source_job_id || '","title":"' || title || '","company":"c","location":"","country":"' || country
    || '","url":"","description":"","salary":"","job_type":"","detail_page_verified":false,"content_hash":"' || sha256(title)
    || '","raw_payload":"' || replace(props, '"', '\\"') || '"}}') AS sha FROM states),
blocks AS (SELECT state, country, n // 1024 AS block, count(*) AS n, sha256(string_agg(sha, '' ORDER BY n)) AS digest FROM frozen GROUP BY ALL),
lists AS (SELECT state, country, CAST(sum(n) AS BIGINT) AS n_rows, sha256(string_agg(digest, '' ORDER BY block)) AS list_sha256 FROM blocks GROUP BY ALL),
t AS (SELECT CAST(c_custkey AS VARCHAR) AS task_id, CASE WHEN c_nationkey % 2 = 0 THEN 'Sri Lanka' ELSE 'Germany' END AS country,
  CASE WHEN c_mktsegment = 'BUILDING' THEN 'first' ELSE 'second' END AS state FROM customer)
SELECT task_id, state, coalesce(n_rows, 0) AS n_rows, list_sha256 FROM t LEFT JOIN lists USING (state, country)
""")
def frozen_snapshots(spark: SparkSession, sf: str) -> DataFrame:
    """Some tasks ask before the last run, all ask after it: the first keep what they got."""
    from talentmesh.plans.inventory_queries import observations

    folder, seen = f"{work_folder(spark)}/snapshots", observations(spark, sf)
    tasks = views.table(spark, sf, "customer").select(
        F.col("c_custkey").cast("string").alias("task_id"), "c_mktsegment",
        F.when(F.col("c_nationkey") % 2 == 0, "Sri Lanka").otherwise(F.lit("Germany")).alias("country"))
    empty = inventory.empty_inventory(spark)
    before = inventory.upsert(empty, seen.where(F.col("seen_at") < CUT), "r1")
    early = tasks.where("c_mktsegment = 'BUILDING'").drop("c_mktsegment")
    snapshots.freeze(early, before, folder, "first")
    snapshots.freeze(tasks.drop("c_mktsegment"), inventory.upsert(empty, seen, "r2"), folder, "second")
    return snapshots.task_lists(spark, folder)


@query("stream_run_health", "T03 A15", """
WITH w AS (SELECT date_trunc('hour', ts) AS start, 's' || (user_id % 4) AS source, count(*) AS rows,
  count(*) FILTER (WHERE event_type = 'error') AS failures FROM events GROUP BY 1, 2)
SELECT strftime(start, '%Y-%m-%d %H:%M') AS start, source, rows, failures FROM w
""")
def stream_run_health(spark: SparkSession, sf: str) -> DataFrame:
    runs = event_stream(spark, sf).select(
        "ts", F.concat(F.lit("s"), F.col("user_id") % 4).alias("source"),
        (F.col("event_type") != "error").alias("ok"))
    done = streams.latest_windows(streams.run_health(runs), work_folder(spark), ["start", "source"])
    return done.select(F.date_format("start", "yyyy-MM-dd HH:mm").alias("start"), "source", "rows",
                       "failures")


TTL_DAYS, FORGET_DAYS = 2, 1
DAY_MS = 24 * 3600 * 1000


@query("stream_liveness", "T02", f"""
WITH g AS (SELECT CAST(user_id AS VARCHAR) AS vacancy, seen, lag(seen) OVER w AS previous, lead(seen) OVER w AS following
  FROM (SELECT user_id, epoch_us(ts) // 1000 AS seen FROM events) WINDOW w AS (PARTITION BY user_id ORDER BY seen))
SELECT vacancy, CASE WHEN previous IS NULL OR seen - previous > {(TTL_DAYS + FORGET_DAYS) * DAY_MS} THEN 'opened' ELSE 'reopened' END AS status, seen AS at_ms
FROM g WHERE previous IS NULL OR seen - previous > {TTL_DAYS * DAY_MS}
UNION ALL SELECT vacancy, 'expired', seen + {TTL_DAYS * DAY_MS} FROM g WHERE following IS NULL OR following - seen > {TTL_DAYS * DAY_MS}
""")
def stream_liveness(spark: SparkSession, sf: str) -> DataFrame:
    """Ten days of events a landing, every twentieth event one landing late, and a last clock tick."""
    key = "spark.sql.streaming.stateStore.providerClass"
    before, folder = spark.conf.get(key), work_folder(spark)
    events = views.table(spark, sf, "events").select(F.col("user_id").cast("string").alias("vacancy"), "ts", "event_id")
    start = events.agg(F.min("ts").alias("start"), F.max("ts").alias("end"))
    nth = F.floor(F.datediff("ts", "start") / 10) + F.when(F.col("event_id") % 20 == 0, 1).otherwise(0)
    landed = events.join(F.broadcast(start), how="cross").select("vacancy", "ts", nth.cast("int").alias("landing"))
    landed.write.mode("overwrite").partitionBy("landing").parquet(f"{folder}/events")
    last = start.select(F.lit(streams.CLOCK).alias("vacancy"), (F.col("end") + F.expr(f"INTERVAL {TTL_DAYS + FORGET_DAYS + 30} DAYS")).alias("ts"))
    last.write.mode("overwrite").parquet(f"{folder}/events/landing=1000")
    landings = [r["landing"] for r in spark.read.schema("landing int").parquet(f"{folder}/events").distinct().orderBy("landing").collect()]
    spark.conf.set(key, "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    try:
        for landing in landings:
            spark.read.parquet(f"{folder}/events/landing={landing}").write.mode("overwrite").parquet(f"{folder}/in/landing={landing}")
            seen = streams.observed(spark, f"{folder}/in/*", "vacancy string, ts timestamp_ntz", files_per_batch=1_000_000)
            done = _finish(streams.liveness(seen, TTL_DAYS * DAY_MS, "12 days", FORGET_DAYS * DAY_MS), folder)
        return done
    finally:
        spark.conf.set(key, before)
