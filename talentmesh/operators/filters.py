"""Row filters of the matching flow, as flag columns or filtered tables."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from talentmesh import lexicons as lex
from talentmesh.functions import dates, geo, scoring
from talentmesh.functions.text import any_of, clean_html, text_of


def with_country_flag(jobs: DataFrame, country: Column | str, allow_global: Column | bool = False,
                      name: str = "country_ok") -> DataFrame:
    """Flag rows that suit the target country; text means a literal country."""
    target = F.lit(country) if isinstance(country, str) else country
    allow = F.lit(allow_global) if isinstance(allow_global, bool) else allow_global
    return geo.with_compatibility(
        jobs, F.col("location"), F.col("country_hint"), target, allow, name
    )


def country_compatible(jobs: DataFrame, country: str, allow_global: bool = False) -> DataFrame:
    return with_country_flag(jobs, country, allow_global).where("country_ok").drop("country_ok")


def with_published(jobs: DataFrame) -> DataFrame:
    return jobs.withColumn("published_ts", dates.posted_at(text_of("published_raw")))


def with_fresh_flag(jobs: DataFrame, now: datetime | str, max_age_days: int = 7,
                    name: str = "fresh_ok") -> DataFrame:
    ready = jobs if "published_ts" in jobs.columns else with_published(jobs)
    return ready.withColumn(
        name,
        scoring.fresh(
            F.col("published_ts"), F.col("source"), F.col("detail_page_verified"),
            scoring.closed_text(F.col("title"), F.col("description")),
            dates.as_literal(now), max_age_days,
        ),
    )


def fresh(jobs: DataFrame, now: datetime | str, max_age_days: int = 7) -> DataFrame:
    return with_fresh_flag(jobs, now, max_age_days).where("fresh_ok").drop("fresh_ok")


def page_closed(html: Column) -> Column:
    """A page says its posting is closed, scripts and styles left out."""
    visible = F.regexp_replace(
        html, r"(?is)<(?:script|style|noscript)\b.*?</(?:script|style|noscript)>", " "
    )
    return any_of(F.lower(clean_html(visible)), lex.CLOSED_PAGE_PHRASES)


def active_inventory(inventory: DataFrame, country: str, now: datetime | str,
                     seen_since: datetime | str | None = None) -> DataFrame:
    """Open rows of one country; every condition is a plain comparison a scan can use."""
    clock = dates.as_literal(now)
    keep = (
        (F.lower("country") == country.lower())
        & F.col("is_active")
        & (F.col("expires_at") > clock)
    )
    if seen_since is not None:
        keep = keep & (F.col("last_seen_at") >= dates.as_literal(seen_since))
    return inventory.where(keep)


def visible_to_owner(rows: DataFrame, tasks: DataFrame, owner_id: str) -> DataFrame:
    """Rows of tasks that belong to the owner."""
    owned = tasks.where(F.col("owner_id") == owner_id).select("task_id")
    return rows.join(owned, "task_id", "left_semi")


REVIEW_DECISIONS = ("accepted", "rejected", "review_failed")


def violations(df: DataFrame, rules: dict[str, Column]) -> DataFrame:
    """``rule, rows``: how many rows break each named rule, in one pass.

    A null verdict counts as broken.
    """
    broken = df.agg(
        *[F.count_if(~F.coalesce(ok, F.lit(False))).alias(n) for n, ok in rules.items()]
    )
    stacked = F.explode(
        F.array(*[F.struct(F.lit(n).alias("rule"), F.col(n).alias("rows")) for n in rules])
    )
    return broken.select(stacked.alias("v")).select("v.rule", "v.rows")


def request_rules() -> dict[str, Column]:
    """Shape checks of an incoming matching request."""
    years = F.col("experience_years")
    return {
        "email": F.col("email").rlike(r"^[^@\s]+@[^@\s]+\.[^@\s]+$"),
        "country": F.length(F.trim("country")) > 0,
        "position": F.length(F.trim("target_position")) > 0,
        "years": years.between(0, 60),
    }


def review_rules() -> dict[str, Column]:
    score = F.col("score")
    return {
        "decision": F.col("decision").isin(*REVIEW_DECISIONS),
        "score": score.isNotNull() & ~F.isnan(score) & score.between(0, 100),
        "hashes": (F.length("context_hash") == 64) & (F.length("evidence_hash") == 64),
    }


def inventory_rules() -> dict[str, Column]:
    return {
        "identity": (F.col("source") != "") & (F.col("source_job_id") != ""),
        "content_hash": F.length("content_hash") == 64,
        "seen_order": F.col("first_seen_at") <= F.col("last_seen_at"),
        "expiry": F.col("expires_at") > F.col("last_seen_at"),
    }


# --- fixed values: captured network calls --------------------------------------------------------
TELEMETRY_HOSTS = (
    "google-analytics.com", "analytics.google.com", "googletagmanager.com",
    "googleadservices.com", "doubleclick.net", "linkedin.com/attribution",
    "hubspot.com/web-interactives",
)
CALL_WORDS = ("job", "career", "vacan", "position", "opening", "recruit", "posting")


def call_is_job_related(url: Column, shape: Column) -> Column:
    """Not a telemetry host, and the address or the payload shape names a job."""
    low = F.lower(text_of(url))
    named = any_of(low, CALL_WORDS) | any_of(F.lower(text_of(shape)), CALL_WORDS)
    return ~any_of(low, TELEMETRY_HOSTS) & named
