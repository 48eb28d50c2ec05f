"""Report tables and their sinks."""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from talentmesh import lexicons as lex
from talentmesh.functions.text import company_key, guard_formula, text_of
from talentmesh.operators.ordering import first_by
from talentmesh.operators.skew import salted_join


def _yes_no(c: str) -> Column:
    return F.when(F.col(c), F.lit("yes")).otherwise(F.lit("no"))


def _stamp(c: str) -> Column:
    return F.concat(F.date_format(c, "yyyy-MM-dd'T'HH:mm:ss"), F.lit("+00:00"))


def guarded(df: DataFrame) -> DataFrame:
    """Formula guard on every text column."""
    texts = {f.name for f in df.schema.fields if isinstance(f.dataType, T.StringType)}
    return df.select(*[
        guard_formula(F.col(c)).alias(c) if c in texts else F.col(c) for c in df.columns
    ])


def all_jobs_report(jobs: DataFrame) -> DataFrame:
    return jobs.select(
        "title", "company", "location", "country_hint", "source",
        F.col("published_raw").alias("published_at"),
        _stamp("fetched_at").alias("fetched_at_utc"),
        _yes_no("detail_page_verified").alias("detail_page_verified"),
        "job_type", "salary", F.col("url").alias("apply_url"),
    )


def related_report(matches: DataFrame) -> DataFrame:
    """Related vacancies before any review: score, posting and evidence, no decision."""
    return matches.select(
        F.col("score").alias("match_score"), "title", "company", "location", "source",
        F.col("published_raw").alias("published_at"),
        _stamp("fetched_at").alias("fetched_at_utc"),
        _yes_no("detail_page_verified").alias("detail_page_verified"),
        F.array_join("matched_skills", ", ").alias("matched_skills"),
        F.array_join("concerns", " ").alias("concerns"),
        F.col("url").alias("apply_url"),
    )


def best_contacts(leads: DataFrame) -> DataFrame:
    """Best lead of every company key; the first wins ties."""
    order = F.create_map(*[F.lit(x) for kv in lex.CONTACT_PRIORITY.items() for x in kv])
    keyed = leads.withColumn("company_key", company_key(F.col("company"))).withColumn(
        "__order", F.struct(
            F.coalesce(F.try_element_at(order, F.col("confidence")), F.lit(99)).alias("p"), "seq")
    )
    winners = keyed.groupBy("company_key").agg(F.min("__order").alias("w")).select(
        F.col("w.seq").alias("__seq"))
    return keyed.join(winners, F.col("seq") == F.col("__seq"), "left_semi").drop("__order")


CONTACT_COLUMNS = (
    ("contact_name", "hr_contact_name"), ("title", "hr_title"), ("email", "hr_email"),
    ("email_type", "hr_email_type"), ("confidence", "hr_contact_confidence"),
    ("company_linkedin_search_url", "company_linkedin_search_url"),
    ("linkedin_search_url", "hr_linkedin_search_url"), ("profile_url", "hr_profile_url"),
    ("profile_image_url", "hr_profile_image_url"), ("source_url", "hr_source_url"),
    ("search_query", "hr_search_query"),
)


def with_contacts(rows: DataFrame, leads: DataFrame) -> DataFrame:
    """Attach the best contact of the company, blanks where there is none.

    The number of companies is not bounded, so no side is broadcast by hint; rows of a
    company with many postings are spread by salt.
    """
    best = best_contacts(leads).select(
        "company_key", *[F.col(a).alias(b) for a, b in CONTACT_COLUMNS]
    )
    keyed = rows.withColumn("company_key", company_key(F.col("company")))
    joined = salted_join(keyed, best, ["company_key"], ["seq"], "left")
    return joined.na.fill("", [b for _, b in CONTACT_COLUMNS]).drop("company_key")


def review_report(matches: DataFrame, leads: DataFrame) -> DataFrame:
    """The 26 columns of the rejected and manual-review reports."""
    return with_contacts(matches, leads).select(
        F.col("score").alias("match_score"), "title", "company", "location", "source",
        F.col("published_raw").alias("published_at"),
        _stamp("fetched_at").alias("fetched_at_utc"),
        _yes_no("detail_page_verified").alias("detail_page_verified"),
        F.array_join("matched_skills", ", ").alias("matched_skills"),
        F.array_join("concerns", " ").alias("concerns"),
        F.col("decision").alias("llm_decision"), F.col("reason").alias("llm_reason"),
        F.col("provider").alias("llm_provider"), F.col("model").alias("llm_model"),
        *[b for _, b in CONTACT_COLUMNS], F.col("url").alias("apply_url"),
    )


def companies_hiring(matches: DataFrame, leads: DataFrame) -> DataFrame:
    """First match of every (company, title, address) with the company's best contact."""
    key = F.sha2(F.concat_ws("\u001f", *[
        F.trim(F.lower(text_of(c))) for c in ("company", "title", "url")]), 256)
    first = first_by(matches.withColumn("__key", key), ["__key"]).drop("__key")
    return with_contacts(first, leads).select(
        "company", "title", "score", "location", "source",
        F.col("published_raw").alias("published_at"), *[b for _, b in CONTACT_COLUMNS],
        F.col("url").alias("apply_url"),
    )


def coverage_report(coverage: DataFrame) -> DataFrame:
    return coverage.select(
        "source", "connector", "status",
        F.coalesce(F.col("inventory_total").cast("string"), F.lit(""))
        .alias("full_inventory_rows"),
        F.col("discovered_rows").alias("role_candidate_rows_returned"),
        F.col("discovered").alias("unique_discovered"),
        F.col("related").alias("related_before_llm"),
        F.col("final").alias("final_vacancies"), F.col("rejected").alias("final_rejected"),
        F.col("manual").alias("final_manual_review"), "note",
    )


def contacts_report(leads: DataFrame) -> DataFrame:
    return leads.select(
        "company", "contact_name", "title", "email", "email_type", "confidence",
        "company_linkedin_search_url", "linkedin_search_url", "profile_url",
        "profile_image_url", "source_url", "search_query", "evidence",
    )


def write_report(df: DataFrame, path: str, fmt: str = "csv") -> None:
    """Write a guarded report folder; every executor writes its own part files."""
    writer = guarded(df).write.mode("overwrite")
    if fmt == "csv":
        writer.option("header", True).option("escape", '"').csv(path)
    else:
        writer.format(fmt).save(path)


def append_reviews(reviews: DataFrame, path: str) -> None:
    """Append completed decisions, one folder per review context."""
    reviews.write.mode("append").partitionBy("context_hash").parquet(path)


def load_reviews(spark, path: str, contexts: list[str]) -> DataFrame:
    """Stored decisions of some contexts; other folders are not read."""
    return spark.read.parquet(path).where(F.col("context_hash").isin(*contexts))


#: Bytes of a file that are read at a time.
READ_BYTES = 8 << 20


def file_digests(files: DataFrame) -> DataFrame:
    """``path, length, sha256`` of files listed as ``path, length``.

    A file is read in pieces of READ_BYTES by the task that has its row, so its size is bounded
    by nothing; any address that Arrow's file systems know will do.
    """

    def digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sums = []
            for address in batch.column("path").to_pylist():
                # Spark writes file:/folder where the scheme's own form is file:///folder.
                system, path = pafs.FileSystem.from_uri(re.sub(r"^file:/+", "file:///", address))
                sha = hashlib.sha256()
                with system.open_input_stream(path) as stream:
                    while piece := stream.read(READ_BYTES):
                        sha.update(piece)
                sums.append(sha.hexdigest())
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(sums, pa.string())], ["path", "length", "sha256"])

    return files.select("path", "length").mapInArrow(digest, "path string, length bigint, sha256 string")


def file_manifest(files: DataFrame, run_key: str, known: DataFrame | None = None) -> DataFrame:
    """Kind, size and digest of result files, without those already recorded.

    ``files`` has the columns ``path, length`` of the binary file reader; contents are read in pieces.
    """
    name = F.substring_index("path", "/", -1)
    suffix = F.lower(F.substring_index(name, ".", -1))
    kind = (
        F.when(suffix == "csv", F.lit("text/csv"))
        .when(suffix.isin("md", "markdown"), F.lit("text/markdown"))
        .when(suffix == "json", F.lit("application/json"))
        .otherwise(F.lit("text/plain"))
    )
    rows = file_digests(files).select(
        name.alias("file_name"), kind.alias("kind"), F.col("length").alias("bytes"), "sha256",
    ).withColumn("idempotency_key", F.concat_ws(":", F.lit(run_key), "file_name", "sha256"))
    return rows if known is None else rows.join(
        known.select("idempotency_key"), "idempotency_key", "left_anti")


def manifest_of_folder(spark, path: str, run_key: str, known: DataFrame | None = None
                       ) -> DataFrame:
    """The manifest of a folder; the listing reads names and sizes only."""
    return file_manifest(spark.read.format("binaryFile").load(path).select("path", "length"), run_key, known)
