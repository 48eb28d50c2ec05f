"""Coverage and audit tables: every row is accounted for exactly once."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

STAGES = ("discovered", "related", "final", "rejected", "manual")
AUDIT_KEY = ("source", "source_id", "url", "title", "company")

# --- fixed values: trace statuses and their notes -------------------------------------------------
COMPLETED = "completed_with_results"
INVENTORY_ONLY = "completed_inventory_no_role_candidates"
EMPTY = "connector_empty_unverified"
SKIPPED = "skipped"
FAILED = "failed"
NOTE_CAP = "configured result cap reached; additional role candidates may exist"
NOTE_EMPTY = "connector returned no rows; website inventory not verified empty"


def stage_counts(stages: dict[str, DataFrame]) -> DataFrame:
    """``source`` and one count per stage.

    Every stage is reduced to (source, count) before the union, so the shuffle carries one
    row per source and task.
    """
    parts = [
        df.groupBy("source").agg(F.count(F.lit(1)).alias("n")).select(
            "source", *[
                (F.col("n") if name == stage else F.lit(0).cast("long")).alias(name)
                for name in stages
            ]
        )
        for stage, df in stages.items()
    ]
    total = parts[0]
    for part in parts[1:]:
        total = total.unionByName(part)
    return total.groupBy("source").agg(*[F.sum(name).alias(name) for name in stages])


def source_coverage(traces: DataFrame, stages: dict[str, DataFrame]) -> DataFrame:
    """One row per trace with the five counts of its source, absent counts as zero."""
    counts = stage_counts(stages)
    return traces.join(counts, "source", "left").na.fill(0, list(stages))


def trace_rows(batches: DataFrame, limit: int) -> DataFrame:
    """Status and note of every source.

    Input: ``source, connector, discovered, inventory_total, error, skip_reason``; a source
    that has neither rows nor an inventory count is empty but not verified.
    """
    hit_cap = (F.lit(limit) > 0) & (F.col("discovered") >= limit)
    status = (
        F.when(F.col("skip_reason") != "", F.lit(SKIPPED))
        .when(F.col("error") != "", F.lit(FAILED))
        .when(F.col("discovered") > 0, F.lit(COMPLETED))
        .when(F.col("inventory_total").isNotNull(), F.lit(INVENTORY_ONLY))
        .otherwise(F.lit(EMPTY))
    )
    inventory_note = F.concat(
        F.lit("complete current inventory loaded ("), F.col("inventory_total"),
        F.lit(" rows); deterministic role-keyword gate returned no candidates"),
    )
    note = (
        F.when(F.col("skip_reason") != "", F.col("skip_reason"))
        .when(F.col("error") != "", F.col("error"))
        .when(F.col("discovered") > 0, F.when(hit_cap, F.lit(NOTE_CAP)).otherwise(F.lit("")))
        .when(F.col("inventory_total").isNotNull(), inventory_note)
        .otherwise(F.lit(NOTE_EMPTY))
    )
    shown = F.when(status.isin(SKIPPED, FAILED), F.lit(0)).otherwise(F.col("discovered"))
    return batches.select(
        "source", "connector", status.alias("status"), shown.cast("long").alias("discovered"),
        shown.cast("long").alias("eligible"), "inventory_total", note.alias("note"),
    )


def status_counts(traces: DataFrame) -> DataFrame:
    return traces.groupBy("status").agg(F.count(F.lit(1)).alias("sources"))


def discovery_note(traces: DataFrame, unique_jobs: DataFrame) -> DataFrame:
    """One line that sums up a discovery: unique rows and sources by status."""
    n = lambda s: F.count_if(F.col("status") == s)
    by_status = traces.agg(
        n(COMPLETED).alias("c"), n(INVENTORY_ONLY).alias("i"), n(EMPTY).alias("e"),
        n(SKIPPED).alias("s"), n(FAILED).alias("f"),
    )
    unique = unique_jobs.agg(F.count(F.lit(1)).alias("u"))
    text = F.format_string(
        "Discovery fan-in: %d unique raw jobs; %d source connector(s) returned results, "
        "%d loaded complete inventories with no role candidates, %d returned no rows "
        "(inventory unverified), %d skipped, %d failed",
        "u", "c", "i", "e", "s", "f",
    )
    return by_status.crossJoin(F.broadcast(unique)).select(text.alias("note"))


def run_totals(raw: DataFrame, unique: DataFrame, decided: DataFrame, related: DataFrame
               ) -> DataFrame:
    """One audit row: rows before and after clean-up, decisions, and whether all add up."""
    one = lambda df, n: df.agg(F.count(F.lit(1)).alias(n))
    row = one(raw, "rows_before")
    for df, name in ((unique, "rows_unique"), (related, "related"), (decided, "accounted")):
        row = row.crossJoin(F.broadcast(one(df, name)))
    return row.withColumn(
        "consolidated", F.greatest(F.lit(0), F.col("rows_before") - F.col("rows_unique"))
    ).withColumn("complete", F.col("related") == F.col("accounted"))


def imbalance(expected: DataFrame, found: DataFrame, keys: Sequence[str] = AUDIT_KEY) -> DataFrame:
    """``missing`` and ``duplicated`` rows between two multisets of keys, as one row.

    Each side is counted per key hash first; only hashes and counts are joined.
    """
    key = F.sha2(F.concat_ws("\u001f", *[F.coalesce(F.col(k), F.lit("")) for k in keys]), 256)
    side = lambda df, n: df.groupBy(key.alias("k")).agg(F.count(F.lit(1)).alias(n))
    both = side(expected, "e").join(side(found, "f"), "k", "full_outer").na.fill(0, ["e", "f"])
    return both.agg(
        F.coalesce(F.sum(F.greatest(F.col("e") - F.col("f"), F.lit(0))), F.lit(0))
        .alias("missing"),
        F.coalesce(F.sum(F.greatest(F.col("f") - F.col("e"), F.lit(0))), F.lit(0))
        .alias("duplicated"),
    )


def key_difference(expected: DataFrame, found: DataFrame, keys: Sequence[str] = AUDIT_KEY
                   ) -> DataFrame:
    """Rows of ``expected`` not matched one for one in ``found`` (multiset difference)."""
    return expected.select(*keys).exceptAll(found.select(*keys))


def final_experience_check(decided: DataFrame, fits: Column, note: str) -> DataFrame:
    """Kept rows that fail the last experience check become rejections with a reason."""
    fails = (F.col("decision") == "keep") & ~fits
    reason = F.trim(F.concat_ws(" ", F.nullif(F.col("reason"), F.lit("")), F.lit(note)))
    return decided.withColumn("reason", F.when(fails, reason).otherwise(F.col("reason"))).withColumn(
        "decision", F.when(fails, F.lit("reject")).otherwise(F.col("decision"))
    )


def snapshot_traces(jobs: DataFrame, connector: str = "shared-inventory") -> DataFrame:
    """Traces of a run that reads the stored inventory: one per source."""
    return jobs.groupBy("source").agg(F.count(F.lit(1)).alias("discovered")).select(
        "source", F.lit(connector).alias("connector"), F.lit(COMPLETED).alias("status"),
        "discovered", F.col("discovered").alias("eligible"),
        F.col("discovered").alias("inventory_total"), F.lit("").alias("note"),
    )


def decision_models(reviews: DataFrame) -> DataFrame:
    return reviews.where(F.col("provider") != "").groupBy("provider", "model").agg(
        F.count(F.lit(1)).alias("reviewed")
    )
