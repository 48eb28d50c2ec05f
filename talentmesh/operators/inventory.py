"""The durable inventory of open vacancies: upsert, snapshots, runs, retention."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from talentmesh.functions import dates
from talentmesh.functions.identity import content_hash, fallback_source_id
from talentmesh.functions.text import text_of
from talentmesh.operators.ordering import numbered
from talentmesh.operators.skew import salt_count

KEY = ["source", "source_job_id"]
FACTS = (
    "title", "company", "location", "country", "url", "description", "salary", "job_type",
    "published_at", "detail_page_verified", "content_hash", "raw_payload",
)


def to_inventory(jobs: DataFrame, default_country: str = "sri lanka") -> DataFrame:
    """Vacancies as inventory rows; dates of any known form are accepted."""
    return jobs.select(
        "source", fallback_source_id().alias("source_job_id"), "title", "company", "location",
        F.when(text_of("country_hint") != "", F.col("country_hint"))
        .otherwise(F.lit(default_country)).alias("country"),
        "url", "description", "salary", "job_type",
        dates.posted_at(text_of("published_raw")).alias("published_at"), "detail_page_verified",
        content_hash().alias("content_hash"),
        F.to_json(F.struct("source", "source_id")).alias("raw_payload"),
    )


def from_inventory(inventory: DataFrame) -> DataFrame:
    """Inventory rows as vacancies."""
    return inventory.select(
        "source", F.col("source_job_id").alias("source_id"), "title", "company", "location",
        F.col("country").alias("country_hint"), "url", "description",
        F.coalesce(F.concat(F.date_format("published_at", "yyyy-MM-dd'T'HH:mm:ss"), F.lit("+00:00")),
                   F.lit("")).alias("published_raw"),
        "salary", "job_type", "detail_page_verified",
    )


def upsert(
    inventory: DataFrame, batch: DataFrame, run_id: str, ttl: str = "INTERVAL 2 DAYS", ties: tuple[str, ...] = ()
) -> DataFrame:
    """Merge observations (rows with ``seen_at``) into the inventory.

    A new key is inserted; a known one takes the latest observation unless it has a later one
    (a batch that comes late changes no facts), keeps the earliest first sight, becomes active
    again and lives ``ttl`` longer. Of observations at one time the one with the greatest
    ``ties`` columns counts, then the one with the greatest facts. The result is a new
    snapshot; ``inventory_store`` writes it by touched buckets.

    Observations are reduced to one per key before the join. The reduction aggregates, so a
    vacancy observed very often is combined on the map side.
    """
    seen = batch.groupBy(*KEY).agg(
        F.max(F.struct("seen_at", *ties, F.struct(*FACTS).alias("facts")))["facts"].alias("n"),
        F.min("seen_at").alias("first_new"), F.max("seen_at").alias("last_new"))
    old = inventory.select(
        *KEY, F.struct(*FACTS).alias("o"), "first_seen_at", "last_seen_at", "expires_at",
        "is_active", "last_source_run_id")
    both = old.join(seen, KEY, "full_outer")
    new = F.col("last_new").isNotNull()
    newer = new & (F.col("last_seen_at").isNull() | (F.col("last_new") >= F.col("last_seen_at")))
    pick = lambda fresh, kept: F.when(new, fresh).otherwise(kept)
    return both.select(
        *KEY, *[F.when(newer, F.col(f"n.{c}")).otherwise(F.col(f"o.{c}")).alias(c) for c in FACTS],
        F.least("first_seen_at", "first_new").alias("first_seen_at"),
        F.greatest("last_seen_at", "last_new").alias("last_seen_at"),
        pick(F.greatest(F.col("last_seen_at"), F.col("last_new")) + F.expr(ttl), F.col("expires_at"))
        .alias("expires_at"),
        pick(F.lit(True), F.col("is_active")).alias("is_active"),
        pick(F.lit(run_id), F.col("last_source_run_id")).alias("last_source_run_id"),
    )


def empty_inventory(spark) -> DataFrame:
    from talentmesh.schemas import INVENTORY

    return spark.createDataFrame([], INVENTORY)


def read_order() -> list[Column]:
    return [F.col("last_seen_at").desc(), F.col("source"), F.col("source_job_id")]


def newest(inventory: DataFrame, limit: int | None = None) -> DataFrame:
    """The inventory, newest first; a page of it where a ``limit`` is given."""
    ordered = inventory.orderBy(*read_order())
    return ordered if limit is None else ordered.limit(limit)


def country_positions(open_rows: DataFrame) -> DataFrame:
    """0-based ``snapshot_order`` of the rows of every country, newest first, whole countries.

    A country is ranked once for all tasks that ask for it. Rows are counted per country and
    hour and sorted within the hour, so a country with a large share of all rows is ordered by
    many tasks.
    """
    hourly = open_rows.withColumn("__hour", F.date_trunc("hour", F.col("last_seen_at").cast("timestamp")))
    placed = numbered(hourly, ["country"], [("__hour", True)], "", "position", fine=read_order())
    return placed.withColumn("snapshot_order", F.col("position") - 1).drop("position", "__hour")


#: Tasks that meet a list of open rows together, and open rows of a list.
TASKS_TOGETHER = ROWS_TOGETHER = 1 << 10


def task_snapshots(tasks: DataFrame, open_rows: DataFrame, taken: DataFrame) -> DataFrame:
    """New snapshots only: a task that already has one keeps its first.

    ``tasks(task_id, country)``, ``open_rows`` with ``country``. The result has a row for every
    task and open row of its country, and only comes into being in the last step: what is
    moved are blocks of tasks and lists of placed rows. An open row is told to a whole block
    before the next one is, so equal values follow each other and files of the result stay
    small. Blocks are dealt over a given number of partitions, which are not merged, however
    few bytes they have.
    """
    fresh = tasks.join(taken.select("task_id").distinct(), "task_id", "left_anti")
    placed = country_positions(open_rows)
    salts, parts = salt_count(tasks), int(tasks.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    blocks = -(-fresh.count() // TASKS_TOGETHER)
    asked, told = ([c for c in df.columns if c != "country"] for df in (fresh, placed))
    spread = max(4 * parts, salts)  # several to a partition, so that they are even
    block = F.pmod(F.xxhash64("task_id"), F.lit(max(blocks, spread)))
    dealt = fresh.groupBy("country", block.alias("__block")).agg(F.sort_array(F.collect_list(F.struct(*asked))).alias("__tasks"))
    dealt = dealt.withColumn("__salt", F.col("__block") % spread).drop("__block").repartition(parts, "country", "__salt")
    lists = placed.groupBy("country", F.floor(F.col("snapshot_order") / ROWS_TOGETHER).alias("__list")).agg(
        F.sort_array(F.collect_list(F.struct("snapshot_order", *[c for c in told if c != "snapshot_order"]))).alias("__rows"))
    every = F.explode(F.sequence(F.lit(0).cast("long"), F.lit(spread - 1).cast("long")))
    met = dealt.join(lists.drop("__list").withColumn("__salt", every).hint("shuffle_merge"), ["country", "__salt"])
    rows = met.select("country", "__tasks", F.explode("__rows").alias("__r")).select("country", "__r", F.explode("__tasks").alias("__t"))
    return rows.select("country", *[F.col(f"__t.{c}").alias(c) for c in asked], *[F.col(f"__r.{c}").alias(c) for c in told])


def new_runs(batches: DataFrame, finished: DataFrame) -> DataFrame:
    """Batches whose (source, run key) has not been finished before."""
    return batches.join(finished.select("source", "run_key"), ["source", "run_key"], "left_anti")


def run_metrics(rows: DataFrame) -> DataFrame:
    """Counters and status of every (source, run).

    ``rows(source, run_key, ok, at)``: succeeded without errors, failed with only errors.
    """
    bad, good = F.count_if(~F.col("ok")), F.count_if(F.col("ok"))
    return rows.groupBy("source", "run_key").agg(
        F.count(F.lit(1)).alias("discovered"), good.alias("upserted"),
        (F.max(F.col("at").cast("timestamp")).cast("double")
         - F.min(F.col("at").cast("timestamp")).cast("double")).alias("elapsed_seconds"),
        F.when(bad == 0, "succeeded").when(good == 0, "failed").otherwise(F.lit("partial"))
        .alias("status"),
    )


CLOSED_TASKS = ("succeeded", "failed", "cancelled")


def due_for_deletion(documents: DataFrame, tasks: DataFrame, now: str) -> DataFrame:
    """Stored CVs past their date, without a legal hold and without an open task."""
    open_tasks = tasks.where(~F.col("status").isin(*CLOSED_TASKS)).select("cv_id")
    due = documents.where(
        F.col("deleted_at").isNull() & ~F.col("legal_hold")
        & (F.col("delete_after") <= dates.as_literal(now)))
    return due.join(open_tasks, "cv_id", "left_anti")


def deletion_outcomes(documents: DataFrame, outcomes: DataFrame, now: str) -> DataFrame:
    """Record deletion attempts: deleted, or the error and one more attempt."""
    joined = documents.join(outcomes.select("cv_id", "error"), "cv_id", "left")
    tried = F.col("error").isNotNull() & F.col("deleted_at").isNull()
    return joined.select(
        "cv_id",
        F.when(tried & (F.col("error") == ""), dates.as_literal(now)).otherwise(F.col("deleted_at"))
        .alias("deleted_at"),
        F.when(tried, F.col("deletion_attempts") + 1).otherwise(F.col("deletion_attempts"))
        .alias("deletion_attempts"),
        F.when(tried, F.col("error")).otherwise(F.col("deletion_error")).alias("deletion_error"))


def current_subscriptions(users: DataFrame, subscriptions: DataFrame, now: str) -> DataFrame:
    """Every user with the active subscription that ends last, else the latest one."""
    clock = dates.as_literal(now)
    row = F.struct("subscription_id", "status", "ends_at", "created_at", "amount", "note")
    active = (F.col("status") == "active") & (F.col("ends_at") > clock)
    best = subscriptions.groupBy("user_id").agg(
        F.max(F.when(active, F.struct("ends_at", (-F.col("subscription_id")).alias("i"),
                                      row.alias("r")))).alias("a"),
        F.max(F.struct("created_at", (-F.col("subscription_id")).alias("i"), row.alias("r")))
        .alias("l"))
    return users.join(best, "user_id", "left").select(
        "user_id", F.coalesce(F.col("a.r"), F.col("l.r")).alias("s"),
        F.col("a").isNotNull().alias("is_active")).select("user_id", "is_active", "s.*")


def plan_days(note: Column, amount: Column, yearly_price: int, yearly: int = 365,
              monthly: int = 30) -> Column:
    yearly_plan = F.lower(text_of(note)).contains("plan:yearly") | (
        F.coalesce(amount, F.lit(0)) >= yearly_price)
    return F.when(yearly_plan, F.lit(yearly)).otherwise(F.lit(monthly))


def runs_left(limit: Column, used: Column) -> Column:
    return F.greatest(F.lit(0), limit - used)


def request_years(payload: Column) -> Column:
    """Years of a request payload under either of its two names; null when unusable."""
    doc = F.try_parse_json(payload)
    get = lambda p: F.try_variant_get(doc, p, "string")
    return F.coalesce(get("$.years_experience"), get("$.experience_years")).try_cast("double")


def payload_shapes(payloads: DataFrame) -> DataFrame:
    """Root kind and sorted keys of JSON payloads, first item keys of a list root."""
    root = F.col("payload")
    as_list = F.try_variant_get(F.try_parse_json(root), "$", "array<string>")
    head = F.coalesce(F.try_element_at(as_list, F.lit(1)), F.lit(""))
    keys = lambda c: F.array_sort(F.coalesce(F.json_object_keys(c), F.array().cast("array<string>")))
    return payloads.select(
        "*",
        F.when(as_list.isNotNull(), "list").when(F.trim(root).startswith("{"), "object")
        .otherwise(F.lit("other")).alias("root_type"),
        keys(root).alias("root_keys"), F.size(as_list).alias("item_count"), keys(head).alias("first_item_keys"))


def distinct_calls(calls: DataFrame) -> DataFrame:
    """Captured calls once per (method, address, body), the last capture of each."""
    return calls.groupBy("method", "url", "body").agg(
        F.max_by("job_related", "at").alias("job_related"), F.count(F.lit(1)).alias("captures"))
