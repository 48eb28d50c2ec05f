"""Landed feed payloads to vacancies.

A feed is a mapping specification: the payload shape, where its items are, and one column
per vacancy field. Payloads are read with a declared schema; a payload that does not parse
yields no rows and is visible in :func:`parse_errors`.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from talentmesh.functions import dates, geo, scoring, urls
from talentmesh.functions.text import (
    clean_ats_html, clean_html, fold, strip, text_of,
)
from talentmesh.schemas import JOB_TEXT_COLUMNS
from talentmesh.session import durable_cut

Fields = Callable[[Column], dict[str, Column]]


@dataclass(frozen=True)
class Feed:
    """Mapping of one payload family.

    ``items`` names the array inside the payload ('' when the payload is the array) and
    ``keep`` is the local-row condition on an item. ``numbered`` is what an item without an id
    is called, followed by its place in the payload.
    """

    source: str
    schema: str
    items: str
    fields: Fields
    keep: Callable[[Column], Column] = field(default=lambda i: F.lit(True))
    remote_global: bool = False
    verified: Callable[[Column], Column] = field(default=lambda i: F.lit(False))
    numbered: str = ""


def _t(item: Column, *names: str) -> Column:
    """First of the named fields that has text."""
    return F.coalesce(*[F.nullif(item[n].cast("string"), F.lit("")) for n in names], F.lit(""))


def _or(c: Column, other: str) -> Column:
    return F.when(c != "", c).otherwise(F.lit(other))


def _remote_board(i: Column) -> dict[str, Column]:
    return {
        "source_id": _t(i, "id", "url"), "title": _t(i, "title"), "company": _t(i, "company_name"),
        "location": _or(_t(i, "candidate_required_location"), "Remote"), "url": _t(i, "url"),
        "description": clean_html(_t(i, "description")),
        "published_raw": _t(i, "publication_date"), "salary": _t(i, "salary"),
        "job_type": _t(i, "job_type"),
    }


def _restricted_board(i: Column) -> dict[str, Column]:
    places = F.array_join(F.filter(i["locationRestrictions"], lambda p: p != ""), ", ")
    return {
        "source_id": _t(i, "guid", "applicationLink"), "title": _t(i, "title"),
        "company": _t(i, "companyName"), "location": _or(text_of(places), "Worldwide"),
        "url": _t(i, "applicationLink"),
        "description": clean_html(F.concat_ws(" ", _t(i, "excerpt"), _t(i, "description"))),
        "published_raw": dates.epoch_to_iso(i["pubDate"]),
        "salary": scoring.salary_offer(_t(i, "minSalary"), _t(i, "maxSalary"), _t(i, "currency"),
                                       _t(i, "salaryPeriod")),
        "job_type": _t(i, "employmentType"),
    }


def _tagged_board(i: Column) -> dict[str, Column]:
    made = F.concat(F.lit("https://remoteok.com/remote-jobs/"), _t(i, "id"))
    return {
        "source_id": _t(i, "id", "slug", "url"), "title": _t(i, "position"),
        "company": _t(i, "company"), "location": _or(_t(i, "location"), "Worldwide"),
        "url": F.when(_t(i, "url") != "", _t(i, "url")).otherwise(made),
        "description": clean_html(_t(i, "description")), "published_raw": _t(i, "date"),
        "salary": _t(i, "salary"), "job_type": F.lit("remote"),
    }


def _german_board(i: Column) -> dict[str, Column]:
    return {
        "source_id": _t(i, "slug", "url"), "title": _t(i, "title"),
        "company": _t(i, "company_name"), "location": _or(_t(i, "location"), "Germany"),
        "country_hint": F.lit("germany"), "url": _t(i, "url"),
        "description": clean_html(_t(i, "description")),
        "published_raw": dates.epoch_to_iso(i["created_at"]), "salary": F.lit(""),
        "job_type": F.when(i["remote"], F.lit("remote")).otherwise(F.lit("")),
    }


def _ad_search(i: Column) -> dict[str, Column]:
    return {
        "source_id": _t(i, "id"), "title": clean_html(_t(i, "title")),
        "company": text_of(i["company"]["display_name"]),
        "location": text_of(i["location"]["display_name"]), "url": _t(i, "redirect_url"),
        "description": clean_html(_t(i, "description")), "published_raw": _t(i, "created"),
        "salary": scoring.salary_range(_t(i, "salary_min"), _t(i, "salary_max")),
        "job_type": _t(i, "contract_time"),
    }


def _overview_board(i: Column) -> dict[str, Column]:
    posted = _t(i, "createdDate", "publishedDate", "sortedCreateDate")
    expiry = strip(_t(i, "expiryDateOnWebsite"))
    part = lambda label, c: F.when(c != "", F.concat(F.lit(label), c))
    return {
        "source_id": _t(i, "jobId"), "title": _t(i, "jobTitle"),
        "company": _t(i, "organizationName"), "location": _or(strip(_t(i, "locations")), "Sri Lanka"),
        "country_hint": F.lit("sri lanka"),
        "url": F.when(_t(i, "jobId") != "", F.concat(F.lit("https://xpress.jobs/jobs/view/"),
                                                     _t(i, "jobId")))
        .otherwise(F.lit("https://xpress.jobs/jobs")),
        "description": F.concat_ws(
            " ", part("", clean_html(_t(i, "overview"))), part("Posted: ", posted),
            part("Closing date: ", expiry)),
        "published_raw": posted, "salary": F.lit(""), "job_type": _t(i, "jobType"),
    }


def _section_text(posting: Column) -> Column:
    """The texts of a posting's sections, in their order."""
    texts = F.transform(F.map_values(posting["sections"]), lambda s: clean_ats_html(text_of(s["text"])))
    return strip(text_of(F.array_join(texts, " ")))


def _smart_ats(company: str, slug: str) -> Fields:
    def fields(i: Column) -> dict[str, Column]:
        return {
            "source_id": _t(i, "id"), "title": strip(_t(i, "name")), "company": F.lit(company),
            "location": _or(text_of(i["location"]["fullLocation"]), "Sri Lanka"),
            "country_hint": F.lit("sri lanka"),
            "url": F.concat(F.lit(f"https://jobs.smartrecruiters.com/{slug}/"), _t(i, "id")),
            "description": _section_text(i["jobAd"]),
            "published_raw": _t(i, "releasedDate"), "salary": F.lit(""),
            "job_type": text_of(i["typeOfEmployment"]["label"]),
        }
    return fields


def _position_ats(company: str, url: Callable[[Column], Column], place: str = "Sri Lanka") -> Fields:
    def fields(i: Column) -> dict[str, Column]:
        return {
            "source_id": _t(i, "id", "hash"), "title": strip(_t(i, "position_name")),
            "company": F.lit(company), "location": _or(_t(i, "location_display"), place),
            "country_hint": F.lit("sri lanka"), "url": url(i),
            "description": clean_ats_html(_t(i, "description")), "published_raw": F.lit(""),
            "salary": F.lit(""), "job_type": F.lit(""),
        }
    return fields


def _sectioned_ats(company: str, parts: tuple[str, ...], root: str) -> Fields:
    def fields(i: Column) -> dict[str, Column]:
        return {
            "source_id": _t(i, "id", "path"), "title": strip(_t(i, "title", "job")),
            "company": F.lit(company), "location": _or(_t(i, "location"), "Sri Lanka"),
            "country_hint": F.lit("sri lanka"),
            "url": F.when(_t(i, "url") != "", _t(i, "url")).otherwise(
                urls.join_url(F.lit(root), _t(i, "path"))),
            "description": strip(F.concat_ws(" ", *[clean_ats_html(_t(i, p)) for p in parts])),
            "published_raw": F.lit(""), "salary": F.lit(""),
            "job_type": _t(i, "employment_type_text", "employment_type"),
        }
    return fields


def _opening_ats(i: Column) -> dict[str, Column]:
    country = _or(_t(i, "Country"), "Sri Lanka")
    return {
        "source_id": _t(i, "id"), "title": strip(_t(i, "Posting_Title", "Job_Opening_Name")),
        "company": F.lit("Bistec Global"),
        "location": F.concat_ws(", ", F.nullif(_t(i, "City"), F.lit("")), country),
        "country_hint": F.lit("sri lanka"), "url": _or(_t(i, "$url"), "https://bistecglobal.com/careers/"),
        "description": clean_ats_html(_t(i, "Job_Description")),
        "published_raw": _t(i, "Date_Opened"), "salary": F.lit(""), "job_type": _t(i, "Job_Type"),
    }


def _link_ats(i: Column) -> dict[str, Column]:
    parts = ("description", "requirements", "additional", "tags")
    return {
        "source_id": _t(i, "applyLink"), "title": clean_ats_html(_t(i, "title", "title_blue")),
        "company": F.lit("3CS"), "location": F.lit("Sri Lanka"), "country_hint": F.lit("sri lanka"),
        "url": urls.join_url(F.lit("https://www.3cs.lk/careers"), _t(i, "applyLink")),
        "description": strip(F.concat_ws(" ", *[clean_ats_html(_t(i, p)) for p in parts])),
        "published_raw": F.lit(""), "salary": F.lit(""), "job_type": F.lit(""),
    }


_JOB_AD = "jobAd:struct<sections:map<string,struct<text:string>>>"
_SMART = (
    "array<struct<id:string,name:string,location:struct<country:string,fullLocation:string>,"
    f"releasedDate:string,typeOfEmployment:struct<label:string>,ref:string,{_JOB_AD}>>"
)
_POSITION = (
    "array<struct<id:string,hash:string,position_name:string,location_display:string,"
    "country:string,description:string>>"
)


def _in_lk(i: Column) -> Column:
    return fold(text_of(i["location"]["country"])).isin("lk", "lka") | fold(
        text_of(i["location"]["fullLocation"])).contains("sri lanka")


def _named_lk(i: Column) -> Column:
    return fold(_t(i, "country")) == "sri lanka"


FEEDS = {f.source: f for f in (
    Feed("Remotive", "struct<jobs:array<struct<id:string,url:string,title:string,"
         "company_name:string,candidate_required_location:string,description:string,"
         "publication_date:string,salary:string,job_type:string>>>", "jobs", _remote_board,
         remote_global=True),
    Feed("Himalayas", "struct<jobs:array<struct<guid:string,applicationLink:string,title:string,"
         "companyName:string,locationRestrictions:array<string>,excerpt:string,"
         "description:string,pubDate:string,minSalary:string,maxSalary:string,currency:string,"
         "salaryPeriod:string,employmentType:string>>>", "jobs", _restricted_board,
         remote_global=True),
    Feed("Remote OK", "array<struct<id:string,slug:string,url:string,position:string,"
         "company:string,location:string,description:string,date:string,salary:string,"
         "tags:array<string>,legal:string>>", "", _tagged_board,
         lambda i: _t(i, "legal") == "", remote_global=True),
    Feed("Arbeitnow", "struct<data:array<struct<slug:string,url:string,title:string,"
         "company_name:string,location:string,description:string,created_at:string,"
         "remote:boolean>>>", "data", _german_board),
    Feed("Adzuna", "struct<results:array<struct<id:string,title:string,"
         "company:struct<display_name:string>,location:struct<display_name:string>,"
         "redirect_url:string,description:string,created:string,salary_min:string,"
         "salary_max:string,contract_time:string>>>", "results", _ad_search),
    Feed("XpressJobs", "array<struct<jobId:string,jobTitle:string,organizationName:string,"
         "locations:string,overview:string,createdDate:string,publishedDate:string,"
         "sortedCreateDate:string,expiryDateOnWebsite:string,jobType:string,"
         "recordCount:string>>", "", _overview_board,
         lambda i: ~geo.foreign_location(_t(i, "locations"))),
    Feed("Acumatica Sri Lanka Careers", f"struct<content:{_SMART}>", "content",
         _smart_ats("Acumatica", "acumatica"), _in_lk, verified=lambda i: F.lit(True)),
    Feed("IFS Sri Lanka Careers", f"struct<jobs:{_SMART}>", "jobs", _smart_ats("IFS", "IFS1"),
         lambda i: fold(text_of(i["location"]["country"])).isin("lk", "lka"),
         verified=lambda i: _section_text(i["jobAd"]) != ""),
    Feed("MillenniumIT ESP Careers", f"struct<results:{_POSITION}>", "results",
         _position_ats("MillenniumIT ESP", lambda i: F.concat(
             F.lit("https://www.careers-page.com/mitesp/job/"), _t(i, "hash"))),
         _named_lk, verified=lambda i: F.lit(True)),
    Feed("Rootcode Careers", f"struct<results:{_POSITION}>", "results",
         _position_ats("Rootcode", lambda i: F.concat(
             F.lit("https://rootcode.ai/careers/"), urls.slug(strip(_t(i, "position_name"))),
             F.lit("-"), _t(i, "id")), "Colombo, Sri Lanka"), _named_lk, verified=lambda i: F.lit(True)),
    Feed("Infor Sri Lanka Careers", "struct<data:array<struct<id:string,path:string,url:string,"
         "title:string,job:string,location:string,description:string,"
         "key_responsibilities:string,skills_knowledge_expertise:string,benefits:string,"
         "employment_type_text:string,employment_type:string>>>", "data",
         _sectioned_ats("Infor", ("description", "key_responsibilities",
                                  "skills_knowledge_expertise", "benefits"),
                        "https://careers.infor.com/"),
         lambda i: fold(_t(i, "location")).rlike("sri lanka|colombo"),
         verified=lambda i: _t(i, "description", "key_responsibilities", "benefits") != ""),
    Feed("Bistec Global Careers", "struct<data:array<struct<id:string,Posting_Title:string,"
         "Job_Opening_Name:string,City:string,Country:string,`$url`:string,"
         "Job_Description:string,Date_Opened:string,Job_Type:string>>>", "data", _opening_ats,
         lambda i: (_t(i, "Country") == "") | fold(_t(i, "Country")).contains("sri lanka"),
         verified=lambda i: _t(i, "Job_Description") != ""),
    Feed("3CS Careers", "array<struct<applyLink:string,title:string,title_blue:string,"
         "description:string,requirements:string,additional:string,tags:string>>", "", _link_ats,
         verified=lambda i: _t(i, "description", "requirements") != "", numbered="3cs-"),
)}
"""Feeds by source name; add an entry to teach the reader a new payload family."""


def parse_feed(landed: DataFrame, feed: Feed, country: str = "") -> DataFrame:
    """Vacancies of the landed payloads of one feed, in payload order.

    ``landed(source, url, payload)`` plus an optional ``page_no`` used for ordering.
    """
    page = F.col("page_no") if "page_no" in landed.columns else F.lit(0).cast("long")
    parsed = landed.where(F.col("source") == feed.source).select(
        page.cast("long").alias("page_no"),
        F.from_json("payload", feed.schema, {"mode": "PERMISSIVE"}).alias("p"))
    items = F.col("p") if feed.items == "" else F.col(f"p.{feed.items}")
    rows = parsed.select("page_no", F.posexplode_outer(items).alias("ordinal", "i")).where(
        F.col("i").isNotNull())
    item = F.col("i")
    made = feed.fields(item)
    made.setdefault("country_hint", F.lit(country))
    made["source"] = F.lit(feed.source)
    if feed.numbered:
        own = F.concat(F.lit(feed.numbered), F.col("ordinal"))
        made["source_id"] = F.when(made["source_id"] == "", own).otherwise(made["source_id"])
    return rows.where(feed.keep(item)).select(
        "page_no", "ordinal", *[text_of(made[c]).alias(c) for c in JOB_TEXT_COLUMNS],
        feed.verified(item).alias("detail_page_verified"))


def ats_details(landed: DataFrame) -> DataFrame:
    """``source, source_id, detail`` of landed detail payloads, one posting each."""
    posting = F.from_json("payload", f"struct<id:string,{_JOB_AD}>")
    rows = landed.select("source", posting.alias("p")).where("p.id IS NOT NULL")
    return rows.groupBy("source", F.col("p.id").alias("source_id")).agg(F.max(_section_text(F.col("p.jobAd"))).alias("detail"))


def with_ats_details(jobs: DataFrame, details: DataFrame) -> DataFrame:
    """Listings with the text of their detail payload; a text makes the row verified."""
    joined = jobs.join(details, ["source", "source_id"], "left")
    text = F.when(text_of("detail") != "", F.col("detail")).otherwise(F.col("description"))
    return joined.withColumn("description", text).withColumn(
        "detail_page_verified", F.col("detail_page_verified") | (F.col("description") != "")).drop("detail")


def fan_in(parts: list[DataFrame]) -> DataFrame:
    """Rows of several sources in registry order, each with its place in the whole as ``seq``.

    ``parts`` come in registry order, with ``page_no`` and ``ordinal`` as :func:`parse_feed`
    gives them. Pages are counted, not sorted together, so ``seq`` takes no global sort.
    """
    return _numbered(reduce(DataFrame.unionByName, [p.withColumn("rank", F.lit(n)) for n, p in enumerate(parts)]))


def registry_fan_in(scope: DataFrame, landed: DataFrame, country: str = "") -> DataFrame:
    """Rows of every landed feed whose source runs, in registry order, as :func:`fan_in` numbers them.

    ``scope`` is :func:`registry.sources_in_scope`; ``landed`` as for :func:`parse_feed`. Payloads
    of a source that is skipped, or that the registry does not hold, give no row.
    """
    runs = scope.where("skip_reason = ''").select("source", F.struct("source_order", "source").alias("rank")).distinct()
    rows = reduce(DataFrame.unionByName, [parse_feed(landed, feed, country) for feed in FEEDS.values()])
    return _numbered(rows.join(runs, "source"))


def _numbered(tagged: DataFrame) -> DataFrame:
    rows = durable_cut(tagged)
    pages = rows.groupBy("rank", "page_no").agg(F.max("ordinal").alias("last"))
    by_rank = Window.partitionBy("rank").orderBy("page_no").rowsBetween(Window.unboundedPreceding, -1)
    inside = pages.withColumn("in_rank", F.coalesce(F.sum(F.col("last") + 1).over(by_rank), F.lit(0)))
    sizes = inside.groupBy("rank").agg(F.max(F.col("in_rank") + F.col("last") + 1).alias("rows"))
    earlier = sizes.select(F.col("rank").alias("of"), F.col("rows").alias("before"))
    first = sizes.join(F.broadcast(earlier), F.col("of") < F.col("rank"), "left").groupBy("rank").agg(
        F.coalesce(F.sum("before"), F.lit(0)).alias("from"))  # a row a source
    base = inside.join(first, "rank").select("rank", "page_no", (F.col("in_rank") + F.col("from")).alias("base"))
    return rows.join(base, ["rank", "page_no"]).withColumn("seq", F.col("base") + F.col("ordinal")).drop(
        "rank", "base", "page_no", "ordinal")


def read_feed(spark, path: str, feed: Feed, country: str = "") -> DataFrame:
    """Landed JSON files (one payload a file) of a feed."""
    files = spark.read.text(path, wholetext=True).select(
        F.lit(feed.source).alias("source"), F.input_file_name().alias("url"),
        F.col("value").alias("payload"))
    return parse_feed(files, feed, country)


def parse_errors(landed: DataFrame) -> DataFrame:
    """Payloads per source, and how many are no JSON at all."""
    return landed.groupBy("source").agg(
        F.count(F.lit(1)).alias("payloads"),
        F.count_if(F.try_parse_json("payload").isNull()).alias("unreadable"))


def expected_pages(landed: DataFrame, feed: Feed, page_size: int = 100) -> DataFrame:
    """Pages a paged feed should have against pages landed, from its own record counts."""
    parsed = landed.where(F.col("source") == feed.source).select(
        "page_no", F.array_max(F.transform(
            F.from_json("payload", feed.schema),
            lambda i: F.coalesce(i["recordCount"].try_cast("long"), F.lit(0)))).alias("records"))
    return parsed.agg(
        F.ceil(F.max("records") / page_size).cast("long").alias("expected"),
        F.countDistinct("page_no").alias("landed"),
    ).withColumn("complete", F.col("expected") <= F.col("landed"))


def still_offered(jobs: DataFrame, now: str) -> DataFrame:
    """Drop rows whose closing date has passed on the local calendar."""
    closing = F.regexp_extract("description", r"Closing date: (\S+)$", 1)
    gone = (closing != "") & dates.feed_expired(closing, dates.as_literal(now))
    return jobs.where(~gone)


def enriched(jobs: DataFrame, details: DataFrame, replace: bool = False,
             minimum: int = 0) -> DataFrame:
    """Attach detail text: put in front of the card's text, or in place of it if longer.

    A row without a usable detail keeps its card, and so does one without an id: blank ids
    match nothing. ``details(source_id, detail, published)``.
    """
    text = text_of("detail")
    usable = (text != "") & (F.length(text) >= minimum)
    if replace:
        better = F.when(usable & (F.length(text) > F.length("description")), text)
    else:
        better = F.when(usable, F.concat(text, F.lit(" "), F.col("description")))
    # rows without an id are spread over places that no detail has
    spread = F.when(F.col("source_id") == "", F.xxhash64(*jobs.columns).bitwiseOR(F.lit(1))).otherwise(F.lit(0).cast("long"))
    keyed = details.where("source_id <> ''").withColumn("__spread", F.lit(0).cast("long"))
    joined = jobs.withColumn("__spread", spread).join(keyed, ["source_id", "__spread"], "left").drop("__spread")
    return joined.withColumn("description", F.coalesce(better, F.col("description"))).withColumn(
        "published_raw",
        F.coalesce(F.nullif(text_of("published"), F.lit("")), F.col("published_raw")),
    ).drop("detail", "published")


# --- RSS ------------------------------------------------------------------------------------------

RSS_SCHEMA = (
    "title string, link string, guid string, description string, pubDate string, "
    "region string, category string"
)
LOCAL_SUFFIX = r"(?i)\s*\(([^()]*(?:LK|Sri Lanka)[^()]*)\)\s*$"


def read_rss(spark, path: str) -> DataFrame:
    return spark.read.format("xml").option("rowTag", "item").schema(RSS_SCHEMA).load(path)


def parse_rss(landed: DataFrame, source: str) -> DataFrame:
    """RSS items of landed XML payloads, one row per item."""
    items = F.regexp_extract_all("payload", F.lit(r"(?is)<item\b[^>]*>.*?</item>"), F.lit(0))
    rows = landed.where(F.col("source") == source).select(
        F.posexplode_outer(items).alias("ordinal", "item")).where(F.col("item").isNotNull())
    return rows.select("ordinal", F.from_xml("item", RSS_SCHEMA).alias("i")).select(
        "ordinal", *[strip(text_of(F.col(f"i.{n}"))).alias(n) for n in (
            "title", "link", "guid", "description", "pubDate", "region", "category")])


def board_rss(items: DataFrame, source: str, country: str) -> DataFrame:
    """``Company: Role`` items of a remote board."""
    split = F.col("title").contains(":")
    company = F.when(split, strip(F.substring_index("title", ":", 1))).otherwise(F.lit(""))
    role = F.when(split, strip(F.regexp_replace("title", r"(?s)^[^:]*:", ""))).otherwise(
        F.col("title"))
    return items.select(
        "ordinal", F.lit(source).alias("source"), _or_other("guid", "link").alias("source_id"),
        role.alias("title"), company.alias("company"), _or(F.col("region"), "Remote").alias("location"),
        F.lit(country).alias("country_hint"), F.col("link").alias("url"),
        clean_html(F.col("description")).alias("description"),
        F.col("pubDate").alias("published_raw"), F.col("category").alias("job_type"))


def career_rss(items: DataFrame, source: str, company: str) -> DataFrame:
    """Career-site items whose title ends with a local place in brackets."""
    place = F.regexp_extract("title", LOCAL_SUFFIX, 1)
    return items.select(
        "ordinal", F.lit(source).alias("source"), _or_other("guid", "link").alias("source_id"),
        strip(F.regexp_replace("title", LOCAL_SUFFIX, "")).alias("title"),
        F.lit(company).alias("company"), _or(place, "Sri Lanka").alias("location"),
        F.lit("sri lanka").alias("country_hint"), F.col("link").alias("url"),
        clean_ats_html(F.col("description")).alias("description"),
        F.col("pubDate").alias("published_raw"), F.lit("").alias("job_type"))


def _or_other(first: str, second: str) -> Column:
    return F.when(F.col(first) != "", F.col(first)).otherwise(F.col(second))


__all__ = [n for n in dir() if not n.startswith("_")]
