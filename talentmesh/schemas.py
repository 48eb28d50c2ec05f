"""Table shapes. Every reader is given its schema; nothing is inferred."""

from __future__ import annotations

from pyspark.sql import types as T

_TYPES = {
    "string": T.StringType(), "double": T.DoubleType(), "boolean": T.BooleanType(), "bigint": T.LongType(),
    "int": T.IntegerType(), "timestamp": T.TimestampType(), "array<string>": T.ArrayType(T.StringType()),
}


def _struct(spec: str) -> T.StructType:
    """Fields as ``name type``; parsed here, so that importing needs no session."""
    fields = (part.split() for part in spec.split(","))
    return T.StructType([T.StructField(name, _TYPES[kind]) for name, kind in fields])


CANDIDATES = _struct(
    "candidate_id string, raw_text string, name string, email string, phone string, "
    "links array<string>, skills array<string>, likely_titles array<string>, "
    "experience_lines array<string>, target_position string, experience_years double, "
    "country string, allow_global_remote boolean"
)

JOBS = _struct(
    "job_key string, seq bigint, source string, source_id string, title string, company string, "
    "location string, country_hint string, url string, description string, "
    "published_raw string, published_ts timestamp, salary string, job_type string, "
    "fetched_at timestamp, detail_page_verified boolean"
)

MATCHES = _struct(
    "candidate_id string, job_key string, seq bigint, score double, "
    "matched_skills array<string>, matched_title_terms array<string>, concerns array<string>, "
    "required_years double, route string, decision string, reason string, provider string, "
    "model string, rank int"
)

INVENTORY = _struct(
    "source string, source_job_id string, title string, company string, location string, "
    "country string, url string, description string, salary string, job_type string, "
    "published_at timestamp, detail_page_verified boolean, content_hash string, "
    "raw_payload string, first_seen_at timestamp, last_seen_at timestamp, "
    "expires_at timestamp, is_active boolean, last_source_run_id string"
)

REVIEWS = _struct(
    "task_id string, job_key string, context_hash string, evidence_hash string, "
    "decision string, score double, reason string, provider string, model string, "
    "matched_skills array<string>, concerns array<string>, attempt_count int, "
    "checkpointed_at timestamp"
)

LEADS = _struct(
    "company string, contact_name string, title string, email string, email_type string, "
    "company_linkedin_search_url string, linkedin_search_url string, profile_url string, "
    "profile_image_url string, source_url string, search_query string, evidence string, "
    "confidence string, seq bigint"
)

TRACES = _struct(
    "source string, connector string, status string, discovered bigint, eligible bigint, "
    "inventory_total bigint, note string"
)

LANDED = _struct("source string, fetched_at timestamp, url string, payload string")
PAGES = _struct("page_id bigint, url string, html string")

CHECKPOINT_LINE = _struct(
    "version int, context string, review_id string, job_evidence string, decision string, "
    "score double, reason string, provider string, model string"
)

JOB_TEXT_COLUMNS = (
    "source", "source_id", "title", "company", "location", "country_hint", "url", "description",
    "published_raw", "salary", "job_type",
)
