"""The source registry: which connectors a run uses, and why others are skipped."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from talentmesh.functions import scoring

# --- fixed values: default connectors (name, remote-global, search discovery), in order -----------
CONNECTORS = (
    ("Adzuna", False, False), ("Remotive", True, False), ("Himalayas", True, False),
    ("Remote OK", True, False), ("We Work Remotely", True, False), ("ITPro.lk", False, False),
    ("topjobs.lk", False, False), ("XpressJobs", False, False), ("RemoteRocketship", False, False),
    ("LinkedIn Public", False, False), ("DuckDuckGo Discovery", False, True),
    ("Google Custom Search", False, True), ("SerpAPI Google", False, True),
    ("Crawl4AI Seeds", False, False), ("Arbeitnow", False, False),
)

# --- fixed values: portals and their start pages, in order ----------------------------------------
PORTALS = (
    ("CareerLK", "https://careerlk.com/jobs/"), ("Hire.lk", "https://www.hire.lk/jobs"),
    ("Recruiter.lk", "https://www.recruiter.lk/jobs"), ("LankaJob.lk", "https://lankajob.lk/"),
    ("Jobber.lk", "https://jobber.lk/"), ("JobFactory.lk", "https://www.jobfactory.lk/"),
    ("DreamJobs.lk", "https://www.dreamjobs.lk/"), ("JobEka.lk", "https://jobeka.lk/"),
    ("FindMyJob.lk", "https://findmyjob.lk/"), ("Career141", "https://www.career141.com/"),
    ("TimesJobs.lk", "https://timesjobs.lk/"), ("GovernmentJobs.lk", "https://governmentjobs.lk/"),
    ("GovernmentVacancies.lk", "https://www.governmentvacancies.lk/"),
    ("Gazette.lk", "https://www.gazette.lk/jobs"), ("job.govdoc.lk", "https://job.govdoc.lk/"),
    ("SLBFE Job Bank", "https://jobbank.slbfe.lk/"),
    ("LankaQualityJobs.com", "http://www.lankaqualityjobs.com/"),
    ("Recruitme.lk", "https://recruitme.lk/"), ("Jobup.lk", "https://jobup.lk/"),
    ("MYJOBS.LK", "https://myjobs.lk/"), ("Inseeks", "https://www.inseeks.com/"),
    ("Observer Jobs", "https://jobs.observer.lk/"), ("JobPal", "https://jobpal.lk/local-jobs/"),
    ("Ikman Jobs", "https://ikman.lk/en/ads/sri-lanka/jobs"),
    ("CareerFirst", "https://www.careerfirst.lk/"), ("CSE Careers", "https://www.cse.lk/"),
    ("Government Jobs", "https://www.gov.lk/"),
)

# --- fixed values: what a source's inventory is good for, and of what it is the whole --------------
FULL_INVENTORY, BOUNDED_LISTING, SEARCH_DISCOVERY = "full_inventory", "bounded_listing", "search_discovery"
FULL_SCOPES = {
    "ITPro.lk": "all currently listed Sri Lankan vacancies",
    "topjobs.lk": "all currently open Sri Lankan vacancies",
    "XpressJobs": "all active non-foreign vacancies returned by the public API",
}
PORTAL_SCOPE = "up to %d details found within the connector's bounded public-page traversal"
SEED_SCOPE = "up to %d details from configured rendered seed pages"

REGISTRY_SCHEMA = (
    "source_order int, source string, kind string, seed_url string, remote_global boolean, "
    "search_discovery boolean, disabled_reason string, it_only boolean"
)
UNVERIFIED = "verified public career/vacancy endpoint not available"


def default_registry(spark: SparkSession, companies: DataFrame | None = None) -> DataFrame:
    """Connectors and portals; company sites come from a table ``(company, verified_url)``.

    Company sites serve IT roles only; one without a verified address stays visible as
    skipped.
    """
    rows = [(n, "connector", "", g, s) for n, g, s in CONNECTORS]
    rows += [(n, "portal", u, False, False) for n, u in PORTALS]
    base = spark.createDataFrame(
        [(i, n, k, u, g, s, "", False) for i, (n, k, u, g, s) in enumerate(rows)], REGISTRY_SCHEMA)
    if companies is None:
        return base
    url = F.coalesce(F.col("verified_url"), F.lit(""))
    extra = companies.select(
        F.lit(len(rows)).alias("source_order"), F.concat("company", F.lit(" Careers")).alias("source"),
        F.lit("company").alias("kind"), url.alias("seed_url"), F.lit(False).alias("remote_global"),
        F.lit(False).alias("search_discovery"),
        F.when(url == "", F.lit(UNVERIFIED)).otherwise(F.lit("")).alias("disabled_reason"),
        F.lit(True).alias("it_only"))
    return base.unionByName(extra)


def sources_in_scope(registry: DataFrame, target_position: str, web_discovery: bool = False,
                     remote_global: bool = False, credentials: tuple[str, ...] = ()) -> DataFrame:
    """Sources of a run with the reason each skipped one is skipped ('' when it runs)."""
    reason = (
        F.when((F.col("source") == "Adzuna") & F.lit("Adzuna" not in credentials),
               F.lit("credentials not configured"))
        .when(F.col("search_discovery") & F.lit(not web_discovery), F.lit("web discovery disabled"))
        .when(F.col("disabled_reason") != "", F.col("disabled_reason"))
        .when(F.col("remote_global") & F.lit(not remote_global),
              F.lit("remote-global sources disabled"))
        .otherwise(F.lit(""))
    )
    return registry.where(
        ~F.col("it_only") | scoring.it_position(F.lit(target_position))
    ).withColumn("skip_reason", reason)


def inventory_sources(registry: DataFrame, bounded_limit: int = 80, seeds: bool = False) -> DataFrame:
    """``source, capability, complete_for_scope, scope`` of every source that can be read without a candidate.

    Only a source that is complete for its scope says that what it no longer lists is gone.
    """
    full = F.create_map(*[F.lit(x) for pair in FULL_SCOPES.items() for x in pair])
    scope = F.coalesce(
        full[F.col("source")], F.when(F.col("kind") == "portal", F.lit(PORTAL_SCOPE % bounded_limit)),
        F.when((F.col("source") == "Crawl4AI Seeds") & F.lit(seeds), F.lit(SEED_SCOPE % bounded_limit)))
    whole = F.col("source").isin(*FULL_SCOPES)
    return registry.where("disabled_reason = ''").withColumn("scope", scope).where("scope IS NOT NULL").select(
        "source_order", "source", F.when(whole, FULL_INVENTORY).otherwise(F.lit(BOUNDED_LISTING)).alias("capability"),
        whole.alias("complete_for_scope"), "scope")


def read_vacancy_csv(spark: SparkSession, path: str) -> DataFrame:
    """Vacancy list of an e-mail scan (header, quoted line breaks)."""
    schema = "company string, title string, apply_url string, match_score string"
    return spark.read.csv(path, header=True, multiLine=True, escape='"').selectExpr(
        *[f"coalesce({c.split()[0]}, '') as {c.split()[0]}" for c in schema.split(", ")])
