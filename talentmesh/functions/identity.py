"""Deterministic identities and evidence hashes."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from talentmesh.functions.text import text_of

UNIT = "\u001f"


def review_id(prefix: str = "") -> Column:
    """Row identity of a vacancy: ``job_`` and 20 hex digits over six fields."""
    fields = ("source", "source_id", "url", "title", "company", "location")
    joined = F.concat_ws(UNIT, *[text_of(prefix + f) for f in fields])
    return F.concat(F.lit("job_"), F.substring(F.sha2(joined, 256), 1, 20))


def evidence_hash() -> Column:
    """Changes when anything a reviewer saw of the vacancy changes (13 fields)."""
    fields = (
        "source", "source_id", "title", "company", "location", "country_hint", "url",
        "description", "published_raw", "salary", "job_type",
    )
    payload = F.to_json(
        F.struct(
            *[text_of(f).alias(f) for f in fields],
            F.col("score").alias("heuristic_score"),
            F.col("concerns"),
        )
    )
    return F.sha2(payload, 256)


def review_context(policy: dict[str, str]) -> Column:
    """Candidate evidence plus every policy setting that can change a decision."""
    fields = (
        "raw_text", "skills", "likely_titles", "experience_lines", "target_position",
        "experience_years", "country", "allow_global_remote",
    )
    payload = F.to_json(
        F.struct(
            *[F.col(f) for f in fields],
            *[F.lit(v).alias(f"policy_{k}") for k, v in sorted(policy.items())],
        ),
        {"ignoreNullFields": "false"},
    )
    return F.sha2(payload, 256)


def content_hash() -> Column:
    return F.sha2(F.concat_ws("|", *[text_of(c) for c in ("title", "company", "url",
                                                          "description")]), 256)


def fallback_source_id() -> Column:
    """The source's own id, else 16 hex digits of the address."""
    return F.when(text_of("source_id") != "", F.col("source_id")).otherwise(
        F.substring(F.sha2(text_of("url"), 256), 1, 16)
    )


def request_fingerprint(*columns: str) -> Column:
    return F.sha2(F.to_json(F.struct(*[F.col(c) for c in sorted(columns)]),
                            {"ignoreNullFields": "false"}), 256)
