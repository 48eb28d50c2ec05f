"""Queries that read landed payloads derived from the tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from talentmesh.plans import checks as ck
from talentmesh.plans import views
from talentmesh.plans.registry import query
from talentmesh.sources import cards, feeds, registry

JOBS = views.vacancy_cte()
PAGE = 25


def _landed(spark: SparkSession, sf: str, source: str, item: F.Column, wrap: str) -> DataFrame:
    """Payloads of 25 vacancies each: ``{"wrap": [...]}``, or a bare list."""
    rows = views.vacancies(spark, sf).select(
        F.floor(F.col("seq") / PAGE).alias("page_no"), "seq", F.to_json(item).alias("item"))
    packed = rows.groupBy("page_no").agg(F.array_sort(F.collect_list(F.struct("seq", "item"))).alias("s"))
    items = F.concat(F.lit("["), F.array_join(F.transform("s", lambda x: x["item"]), ","), F.lit("]"))
    payload = F.concat(F.lit(f'{{"{wrap}":'), items, F.lit("}")) if wrap else items
    return packed.select(F.lit(source).alias("source"), F.lit("").alias("url"), "page_no",
                         payload.alias("payload"))


BOARD_SQL = f"""
WITH {JOBS} SELECT CASE WHEN source_id = '' THEN url ELSE source_id END AS sid, title, company,
  CASE WHEN location = '' THEN 'Remote' ELSE location END AS location, url,
  md5(trim(regexp_replace(description, '[\\s\\x{{a0}}]+', ' ', 'g'))) AS body, published_raw, salary FROM jobs
"""


@query("json_board_remote", "S02 P14", BOARD_SQL)
@query("json_board_remote_whole", "S02 P14", BOARD_SQL)
def json_board_remote_whole(spark: SparkSession, sf: str) -> DataFrame:
    """All postings; one without an id of its own goes by its address."""
    return _remote_rows(spark, sf).select(
        F.col("source_id").alias("sid"), "title", "company", "location", "url",
        F.md5("description").alias("body"), "published_raw", "salary")


def _remote_rows(spark: SparkSession, sf: str) -> DataFrame:
    item = F.struct(
        F.col("source_id").alias("id"), "url", "title", F.col("company").alias("company_name"),
        F.col("location").alias("candidate_required_location"), "description",
        F.col("published_raw").alias("publication_date"), "salary", "job_type")
    landed = _landed(spark, sf, "Remotive", item, "jobs")
    return feeds.parse_feed(landed, feeds.FEEDS["Remotive"], "sri lanka")


@query("json_board_offers", "S02 F22 F23 F21", f"""
WITH {JOBS} SELECT CAST(seq AS VARCHAR) AS sid, CASE WHEN location = '' THEN 'Worldwide' ELSE location END AS location,
  CASE seq % 3 WHEN 0 THEN 'USD ' || (seq * 10) || ' - ' || (seq * 20) || ' annual' WHEN 1 THEN 'USD ' || (seq * 10) || ' annual' ELSE '' END AS salary,
  strftime(make_timestamp((1704067200 + seq * 60) * 1000000), '%Y-%m-%dT%H:%M:%S+00:00') AS published_raw FROM jobs
""")
def json_board_offers(spark: SparkSession, sf: str) -> DataFrame:
    seq = F.col("seq")
    item = F.struct(
        seq.cast("string").alias("guid"), F.col("url").alias("applicationLink"), "title",
        F.col("company").alias("companyName"),
        F.array("location").alias("locationRestrictions"), F.lit("").alias("excerpt"),
        (seq * 60 + 1704067200).alias("pubDate"),
        F.when(seq % 3 < 2, seq * 10).alias("minSalary"),
        F.when(seq % 3 == 0, seq * 20).alias("maxSalary"), F.lit("USD").alias("currency"),
        F.lit("annual").alias("salaryPeriod"))
    rows = feeds.parse_feed(_landed(spark, sf, "Himalayas", item, "jobs"), feeds.FEEDS["Himalayas"])
    return rows.select(F.col("source_id").alias("sid"), "location", "salary", "published_raw")


@query("json_board_tagged", "S02 P15", f"""
WITH {JOBS} SELECT CAST(seq AS VARCHAR) AS sid, title, 'https://remoteok.com/remote-jobs/' || seq AS url,
  CASE WHEN location = '' THEN 'Worldwide' ELSE location END AS location FROM jobs WHERE seq % 10 <> 0
""")
def json_board_tagged(spark: SparkSession, sf: str) -> DataFrame:
    item = F.struct(
        F.col("seq").cast("string").alias("id"), F.col("title").alias("position"), "company",
        "location", F.when(F.col("seq") % 10 == 0, F.lit("terms")).alias("legal"))
    rows = feeds.parse_feed(_landed(spark, sf, "Remote OK", item, ""), feeds.FEEDS["Remote OK"])
    return rows.select(F.col("source_id").alias("sid"), "title", "url", "location")


@query("json_board_german", "S02 P16 F21", f"""
WITH {JOBS} SELECT 's-' || seq AS sid, title, CASE WHEN location = '' THEN 'Germany' ELSE location END AS location,
  'germany' AS country_hint, CASE WHEN seq % 2 = 0 THEN 'remote' ELSE '' END AS job_type FROM jobs
""")
def json_board_german(spark: SparkSession, sf: str) -> DataFrame:
    item = F.struct(
        F.concat(F.lit("s-"), F.col("seq")).alias("slug"), "title",
        F.col("company").alias("company_name"), "location", F.lit(1704067200).alias("created_at"),
        (F.col("seq") % 2 == 0).alias("remote"))
    rows = feeds.parse_feed(_landed(spark, sf, "Arbeitnow", item, "data"), feeds.FEEDS["Arbeitnow"])
    return rows.select(F.col("source_id").alias("sid"), "title", "location", "country_hint", "job_type")


@query("ad_search_feed", "S04 F22", f"""
WITH {JOBS} SELECT CAST(seq AS VARCHAR) AS sid, title, company, location,
  CASE WHEN seq % 2 = 0 THEN (seq + 1) || ' - ' || (seq + 2) ELSE CAST(seq + 1 AS VARCHAR) END AS salary FROM jobs
""")
def ad_search_feed(spark: SparkSession, sf: str) -> DataFrame:
    seq = F.col("seq")
    item = F.struct(
        seq.cast("string").alias("id"), "title",
        F.struct(F.col("company").alias("display_name")).alias("company"),
        F.struct(F.col("location").alias("display_name")).alias("location"),
        (seq + 1).alias("salary_min"), F.when(seq % 2 == 0, seq + 2).alias("salary_max"))
    rows = feeds.parse_feed(_landed(spark, sf, "Adzuna", item, "results"), feeds.FEEDS["Adzuna"])
    return rows.select(F.col("source_id").alias("sid"), "title",
                       F.col("company"), "location", "salary")


def _paged(spark: SparkSession, sf: str) -> DataFrame:
    seq = F.col("seq")
    item = F.struct(
        seq.cast("string").alias("jobId"), F.col("title").alias("jobTitle"),
        F.col("company").alias("organizationName"),
        F.when(seq % 8 == 0, F.lit("Dubai; International")).otherwise(F.col("location")).alias("locations"),
        F.lit("<p>Pay &amp; perks</p>").alias("overview"), F.lit("2024-01-20").alias("createdDate"),
        F.concat(F.lit("2024-02-0"), seq % 3 + 1).alias("expiryDateOnWebsite"),
        (seq + 1).cast("string").alias("recordCount"))
    return _landed(spark, sf, "XpressJobs", item, "")


@query("paged_feed", "S03 P10 P11", f"""
WITH {JOBS} SELECT CAST(seq AS VARCHAR) AS sid, CASE WHEN location = '' THEN 'Sri Lanka' ELSE location END AS location,
  'https://xpress.jobs/jobs/view/' || seq AS url,
  'Pay & perks Posted: 2024-01-20 Closing date: 2024-02-0' || (seq % 3 + 1) AS description
FROM jobs WHERE seq % 8 <> 0 AND seq % 3 <> 0
""")
def paged_feed(spark: SparkSession, sf: str) -> DataFrame:
    rows = feeds.parse_feed(_paged(spark, sf), feeds.FEEDS["XpressJobs"])
    # 20:00 UTC on the first is already the second of the month at +05:30.
    return feeds.still_offered(rows, "2024-02-01 20:00:00").select(
        F.col("source_id").alias("sid"), "location", "url", "description")


@query("feed_completeness", "A13 S03", f"""
SELECT CAST(ceil((max(doc_id) + 1) / {PAGE}.0) AS BIGINT) AS expected,
  count(DISTINCT doc_id // {PAGE}) AS landed,
  ceil((max(doc_id) + 1) / {PAGE}.0) <= count(DISTINCT doc_id // {PAGE}) AS complete FROM documents
""")
def feed_completeness(spark: SparkSession, sf: str) -> DataFrame:
    return feeds.expected_pages(_paged(spark, sf), feeds.FEEDS["XpressJobs"], PAGE)


@query("feed_errors", "S12 S02", f"""
SELECT 'XpressJobs' AS source, count(DISTINCT doc_id // {PAGE}) AS payloads,
  count(DISTINCT doc_id // {PAGE}) FILTER (WHERE (doc_id // {PAGE}) % 4 = 0) AS unreadable FROM documents
""")
def feed_errors(spark: SparkSession, sf: str) -> DataFrame:
    cut = F.when(F.col("page_no") % 4 == 0, F.concat(F.lit("{"), "payload")).otherwise(F.col("payload"))
    return feeds.parse_errors(_paged(spark, sf).withColumn("payload", cut))


def _job_ad(seq: F.Column) -> F.Column:
    """``jobAd.sections.*.text`` of a posting."""
    text = lambda c: F.struct(c.alias("text"))
    sections = F.create_map(F.lit("a"), text(F.lit("<p>Duty one.</p>")), F.lit("b"),
                            text(F.concat(F.lit("<div>Bring "), seq, F.lit(".</div>"))))
    return F.struct(sections.alias("sections")).alias("jobAd")


@query("ats_details", "S05", f"""
WITH {JOBS} SELECT 'job-' || seq AS sid, CASE WHEN seq % 4 = 0 THEN '' ELSE 'Duty one. Bring ' || seq || '.' END AS description,
  seq % 4 <> 0 AS verified FROM jobs WHERE seq % 3 <> 0
""")
def ats_details(spark: SparkSession, sf: str) -> DataFrame:
    """A listing without texts, and a detail payload for three postings in four, joined by id."""
    seq, name = F.col("seq"), "IFS Sri Lanka Careers"
    item = F.struct(
        F.concat(F.lit("job-"), seq).alias("id"), F.col("title").alias("name"),
        F.struct(F.when(seq % 3 == 0, F.lit("se")).otherwise(F.lit("LK")).alias("country"),
                 F.lit("Colombo").alias("fullLocation")).alias("location"))
    listed = feeds.parse_feed(_landed(spark, sf, name, item, "jobs"), feeds.FEEDS[name])
    landed = views.vacancies(spark, sf).where(seq % 4 != 0).select(
        F.lit(name).alias("source"), F.to_json(F.struct(F.concat(F.lit("job-"), seq).alias("id"), _job_ad(seq))).alias("payload"))
    rows = feeds.with_ats_details(listed, feeds.ats_details(landed))
    return rows.select(F.col("source_id").alias("sid"), "description", F.col("detail_page_verified").alias("verified"))


@query("source_fan_in", "O04", f"""
WITH {JOBS}, parts AS (
  SELECT 0 AS rank, 'Acumatica Sri Lanka Careers' AS source, 'job-' || seq AS sid, seq FROM jobs WHERE seq % 3 <> 0
  UNION ALL SELECT 1, 'Rootcode Careers', CAST(seq AS VARCHAR), seq FROM jobs WHERE seq % 2 = 0
  UNION ALL SELECT 2, 'Bistec Global Careers', CAST(seq AS VARCHAR), seq FROM jobs WHERE seq % 5 <> 0),
pages AS (SELECT rank, seq // {PAGE} AS page, max(seq % {PAGE}) + 1 AS n FROM parts GROUP BY ALL),
based AS (SELECT *, coalesce(sum(n) OVER (ORDER BY rank, page ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS base FROM pages)
SELECT source, sid, CAST(base + seq % {PAGE} AS BIGINT) AS seq FROM parts JOIN based ON parts.rank = based.rank AND page = seq // {PAGE}
""")
def source_fan_in(spark: SparkSession, sf: str) -> DataFrame:
    """Three sources in registry order as one inventory, numbered across sources and pages."""
    made = (("Acumatica Sri Lanka Careers", _section_item(), "content"), ("Rootcode Careers", _position_item(), "results"),
            ("Bistec Global Careers", _opening_item(), "data"))
    parts = [feeds.parse_feed(_landed(spark, sf, name, item, wrap), feeds.FEEDS[name]) for name, item, wrap in made]
    return feeds.fan_in(parts).select("source", F.col("source_id").alias("sid"), "seq")


@query("ats_sections", "S05 P26", f"""
WITH {JOBS} SELECT 'job-' || seq AS sid, title, 'Kandy, Sri Lanka' AS location, 'Duty one. Bring ' || seq || '.' AS description,
  'https://jobs.smartrecruiters.com/acumatica/job-' || seq AS url FROM jobs WHERE seq % 3 <> 0
""")
def ats_sections(spark: SparkSession, sf: str) -> DataFrame:
    name = "Acumatica Sri Lanka Careers"
    rows = feeds.parse_feed(_landed(spark, sf, name, _section_item(), "content"), feeds.FEEDS[name])
    return rows.select(F.col("source_id").alias("sid"), "title", "location", "description", "url")


def _section_item() -> F.Column:
    seq = F.col("seq")
    return F.struct(
        F.concat(F.lit("job-"), seq).alias("id"), F.col("title").alias("name"),
        F.struct(
            F.when(seq % 3 == 0, F.lit("de")).when(seq % 3 == 1, F.lit("LK")).otherwise(F.lit("xx")).alias("country"),
            F.when(seq % 3 == 0, F.lit("Berlin")).otherwise(F.lit("Kandy, Sri Lanka")).alias("fullLocation"),
        ).alias("location"),
        _job_ad(seq))


@query("ats_positions", "S05 F18 P26", f"""
WITH {JOBS} SELECT CAST(seq AS VARCHAR) AS sid, title,
  'https://rootcode.ai/careers/' || regexp_replace(regexp_replace(lower(title), '[^a-z0-9]+', '-', 'g'), '^-+|-+$', '', 'g') || '-' || seq AS url
FROM jobs WHERE seq % 2 = 0
""")
def ats_positions(spark: SparkSession, sf: str) -> DataFrame:
    rows = feeds.parse_feed(
        _landed(spark, sf, "Rootcode Careers", _position_item(), "results"), feeds.FEEDS["Rootcode Careers"])
    return rows.select(F.col("source_id").alias("sid"), "title", "url")


def _position_item() -> F.Column:
    seq = F.col("seq")
    return F.struct(
        seq.cast("string").alias("id"), F.col("title").alias("position_name"),
        F.when(seq % 2 == 0, F.lit("Sri Lanka")).otherwise(F.lit("India")).alias("country"))


@query("ats_openings", "S05 P26", f"""
WITH {JOBS} SELECT CAST(seq AS VARCHAR) AS sid, title,
  CASE WHEN seq % 2 = 0 THEN 'Colombo, Sri Lanka' ELSE 'Sri Lanka' END AS location FROM jobs WHERE seq % 5 <> 0
""")
def ats_openings(spark: SparkSession, sf: str) -> DataFrame:
    name = "Bistec Global Careers"
    rows = feeds.parse_feed(_landed(spark, sf, name, _opening_item(), "data"), feeds.FEEDS[name])
    return rows.select(F.col("source_id").alias("sid"), "title", "location")


def _opening_item() -> F.Column:
    seq = F.col("seq")
    return F.struct(
        seq.cast("string").alias("id"), F.col("title").alias("Posting_Title"),
        F.when(seq % 2 == 0, F.lit("Colombo")).alias("City"),
        F.when(seq % 5 == 0, F.lit("Norway")).when(seq % 5 == 1, F.lit("Sri Lanka")).alias("Country"))


def _rss(spark: SparkSession, sf: str, title: F.Column) -> DataFrame:
    esc = lambda c: F.replace(c, F.lit("&"), F.lit("&amp;"))
    item = F.concat(
        F.lit("<item><title>"), esc(title), F.lit("</title><guid>g"), F.col("seq"),
        F.lit("</guid><link>https://x.test/"), F.col("seq"),
        F.lit("</link><description>Duties</description><region></region></item>"))
    rows = views.vacancies(spark, sf).select(
        F.floor(F.col("seq") / PAGE).alias("page_no"), "seq", item.alias("item"))
    packed = rows.groupBy("page_no").agg(
        F.array_sort(F.collect_list(F.struct("seq", "item"))).alias("s"))
    return packed.select(F.lit("rss").alias("source"), F.concat(
        F.lit("<rss><channel>"), F.array_join(F.transform("s", lambda x: x["item"]), ""),
        F.lit("</channel></rss>")).alias("payload"))


@query("rss_board", "S06 F23", f"""
WITH {JOBS} SELECT 'g' || seq AS sid, title, trim(company) AS company, 'Remote' AS location FROM jobs
""")
def rss_board(spark: SparkSession, sf: str) -> DataFrame:
    landed = _rss(spark, sf, F.concat_ws(": ", "company", "title"))
    rows = feeds.board_rss(feeds.parse_rss(landed, "rss"), "We Work Remotely", "germany")
    return rows.select(F.col("source_id").alias("sid"), "title", "company", "location")


@query("rss_careers", "S06 F23", f"""
WITH {JOBS} SELECT 'g' || seq AS sid, title,
  CASE WHEN seq % 2 = 0 THEN 'Colombo, LK' ELSE 'Sri Lanka' END AS location FROM jobs
""")
def rss_careers(spark: SparkSession, sf: str) -> DataFrame:
    title = F.concat("title", F.when(F.col("seq") % 2 == 0, F.lit(" (Colombo, LK)")).otherwise(F.lit("")))
    rows = feeds.career_rss(feeds.parse_rss(_rss(spark, sf, title), "rss"), "careers", "Keells")
    return rows.select(F.col("source_id").alias("sid"), "title", "location")


@query("card_listings", "S07", f"""
WITH {JOBS} SELECT 'c' || seq AS sid, replace(title, '&', '&') AS title, 'https://itpro.lk/job/' || seq AS url,
  CASE WHEN location = '' THEN 'Sri Lanka' ELSE location END AS location, '2024-01-02' AS published_raw FROM jobs
""")
def card_listings(spark: SparkSession, sf: str) -> DataFrame:
    pages = views.vacancies(spark, sf).select(
        F.col("seq").alias("page_id"), F.lit("https://itpro.lk/").alias("url"),
        F.concat(F.lit("<article class='x job-card' id='c"), "seq", F.lit("'><a href='/job/"), "seq",
                 F.lit("'><h2 class='jc-title'>"), "title", F.lit("</h2></a><span class='la'>"),
                 "location", F.lit("</span><time datetime='2024-01-02'></time></article>")).alias("html"))
    rows = cards.article_cards(pages)
    return rows.select(F.col("source_id").alias("sid"), "title", "url", "location", "published_raw")


@query("table_listings", "S07 F18 S16", f"""
WITH {JOBS} SELECT 'JC' || seq AS sid, title, 'https://www.topjobs.lk/vacancy?ac=DEFZZZ&ec=E1&index=' || seq || '&jc=JC' || seq
  || '&pg=applicant%2FvacancyDetails.jsp&rid=' || seq AS url, 'Galle' AS location, 'Mon Jan 15 2024' AS published_raw,
  CASE WHEN seq % 2 = 0 THEN repeat('Full advert. ', 8) ELSE '' END || title || ' Mon Jan 15 2024 Fri Feb 02 2024 Galle Closing date: Fri Feb 02 2024' AS description
FROM jobs
""")
def table_listings(spark: SparkSession, sf: str) -> DataFrame:
    seq = F.col("seq")
    jobs = views.vacancies(spark, sf)
    pages = jobs.select(
        seq.alias("page_id"), F.lit("https://www.topjobs.lk/list").alias("url"),
        F.concat(F.lit('<tr id="tr'), seq, F.lit('"><td><h2><span>'), "title",
                 F.lit('</span></h2><!-- <span id="hdnJC'), seq, F.lit('">JC'), seq,
                 F.lit('</span><span id="hdnEC1">E1</span> --></td><td>Mon Jan 15 2024</td>'
                       '<td>Fri Feb 02 2024</td><td>Galle</td></tr>')).alias("html"))
    remark = F.when(seq % 2 == 0, F.repeat(F.lit("Full advert. "), 8)).otherwise(
        F.lit("Please refer the vacancy image for everything that there is to know about this one role."))
    details = jobs.select(
        F.concat(F.lit("JC"), seq).alias("source_id"), cards.advert_detail(F.concat(
            F.lit("<div id='remark'>"), remark, F.lit("</div>"))).alias("detail"),
        F.lit("").alias("published"))
    rows = feeds.enriched(cards.table_rows(pages), details, minimum=80)
    return rows.select(F.col("source_id").alias("sid"), "title", "url", "location", "published_raw",
                       "description")


@query("search_result_jobs", "S07 S17 F17", f"""
WITH {JOBS} SELECT 'https://jobs.test/' || seq AS sid, title || ' at Acme' AS title, 'Acme' AS company, 'Snip' AS description,
  'Sri Lanka' AS location FROM jobs
""")
def search_result_jobs(spark: SparkSession, sf: str) -> DataFrame:
    pages = views.vacancies(spark, sf).select(
        F.col("seq").alias("page_id"), F.lit("https://duckduckgo.com/html").alias("url"),
        F.concat(F.lit('<a rel="n" class="result__a" href="//duckduckgo.com/l/?uddg=https%3A%2F%2Fjobs.test%2F'),
                 "seq", F.lit('&amp;rut=1">'), "title",
                 F.lit(' at Acme</a><div class="result__snippet">Snip</div>')).alias("html"))
    rows = cards.search_hit_jobs(cards.search_results(pages), "DuckDuckGo Discovery", "sri lanka")
    return rows.select(F.col("source_id").alias("sid"), "title", "company", "description", "location")


ENRICHED_SQL = f"""
WITH {JOBS} SELECT seq, source_id AS sid,
  CASE WHEN seq % 3 = 0 AND source_id <> '' THEN 'Detail of the role. ' || title ELSE title END AS description,
  CASE WHEN seq % 3 = 0 AND source_id <> '' THEN '2024-01-30' ELSE published_raw END AS published_raw FROM jobs
"""


@query("detail_enrichment", "S16", ENRICHED_SQL)
@query("detail_enrichment_whole", "S16", ENRICHED_SQL)
def detail_enrichment_whole(spark: SparkSession, sf: str) -> DataFrame:
    """All postings; one without an id of its own cannot be matched and keeps its card."""
    jobs = views.vacancies(spark, sf).select(
        "seq", "source_id", F.col("title").alias("description"), "published_raw")
    details = jobs.where("seq % 3 = 0").select(
        "source_id", F.lit("Detail of the role.").alias("detail"),
        F.lit("2024-01-30").alias("published"))
    return feeds.enriched(jobs, details).select(
        "seq", F.col("source_id").alias("sid"), "description", "published_raw")


@query("search_payload_results", "S17 S19", f"""
WITH {JOBS} SELECT 'Google Custom Search' AS source, 'https://jobs.test/' || seq AS url, title, 'Snip' AS snippet,
  CASE WHEN seq % 3 = 0 THEN 'https://img.test/' || seq ELSE '' END AS thumbnail FROM jobs
UNION ALL SELECT 'SerpAPI Google', 'https://jobs.test/' || seq, title, 'Snip', '' FROM jobs
""")
def search_payload_results(spark: SparkSession, sf: str) -> DataFrame:
    seq = F.col("seq")
    shown = F.when(seq % 3 == 0, F.struct(F.array(F.struct(F.concat(F.lit("https://img.test/"), seq).alias("src"))).alias("cse_thumbnail")))
    item = [F.concat(F.lit("https://jobs.test/"), seq).alias("link"), F.col("title"), F.lit("Snip").alias("snippet")]
    landed = _landed(spark, sf, "Google Custom Search", F.struct(*item, shown.alias("pagemap")), "items").unionByName(
        _landed(spark, sf, "SerpAPI Google", F.struct(*item), "organic_results"))
    rows = cards.search_payloads(landed.withColumnRenamed("page_no", "page_id"))
    return rows.select("source", "url", "title", "snippet", "thumbnail")


@query("guest_cards", "S07", f"""
WITH {JOBS} SELECT CASE WHEN seq % 2 = 0 THEN CAST(seq AS VARCHAR) ELSE 'https://li.test/view/' || seq || '?a=1&b=2' END AS sid,
  title, 'Acme & Co' AS company, 'Colombo, Sri Lanka' AS location, 'https://li.test/view/' || seq || '?a=1&b=2' AS url,
  '2024-01-02' AS published_raw FROM jobs WHERE seq % 5 <> 0
""")
def guest_cards(spark: SparkSession, sf: str) -> DataFrame:
    seq = F.col("seq")
    pages = views.vacancies(spark, sf).select(
        seq.alias("page_id"), F.lit("https://li.test/search").alias("url"),
        F.concat(F.lit('<ul><li><div class="base-card x"'), F.when(seq % 2 == 0, F.concat(F.lit(' data-entity-urn="urn:li:jobPosting:'), seq, F.lit('"'))).otherwise(""),
                 F.lit('><a class="base-card__full-link y" href="https://li.test/view/'), seq, F.lit('?a=1&amp;b=2">x</a><h3 class="base-search-card__title"> '), "title",
                 F.lit(' </h3><h4 class="base-search-card__subtitle"><a href="/c">Acme &amp; Co</a></h4><span class="job-search-card__location"> '),
                 F.when(seq % 5 == 0, F.lit("Berlin")).otherwise(F.lit("Colombo, Sri Lanka")),
                 F.lit(' </span><time datetime="2024-01-02"></time></div></li></ul>')).alias("html"))
    rows = cards.guest_cards(pages)
    return rows.select(F.col("source_id").alias("sid"), "title", "company", "location", "url", "published_raw")


@query("structured_list", "S07 S08", f"""
WITH {JOBS} SELECT 'https://rr.test/jobs/senior-cook-' || seq AS sid, CASE WHEN seq % 2 = 0 THEN title ELSE 'Senior Cook ' || seq END AS title,
  'Acme' AS company, 'Sri Lanka / Remote' AS location, CASE WHEN seq % 2 = 0 THEN title ELSE 'Senior Cook ' || seq END AS description,
  '2024-01-03' AS published_raw FROM jobs
""")
def structured_list(spark: SparkSession, sf: str) -> DataFrame:
    seq = F.col("seq")
    item = F.struct(
        F.lit("JobPosting").alias("@type"), F.when(seq % 2 == 0, F.col("title")).alias("title"),
        F.concat(F.lit("https://rr.test/jobs/senior-cook-"), seq).alias("url"),
        F.struct(F.lit("Acme").alias("name")).alias("hiringOrganization"), F.lit("2024-01-03").alias("datePosted"))
    landed = _landed(spark, sf, "RemoteRocketship", item, "itemListElement")
    pages = landed.select(F.col("page_no").alias("page_id"), "url", F.concat(
        F.lit('<script type="application/ld+json">'), "payload", F.lit("</script>")).alias("html"))
    rows = cards.structured_list(pages)
    return rows.select(F.col("source_id").alias("sid"), "title", "company", "location", "description", "published_raw")


@query("registry_fan_in", "O04 S18", f"""
WITH {JOBS}, parts AS (
  SELECT 0 AS rank, 'Himalayas' AS source, CAST(seq AS VARCHAR) AS sid, seq FROM jobs
  UNION ALL SELECT 1, 'Rootcode Careers', CAST(seq AS VARCHAR), seq FROM jobs WHERE seq % 2 = 0),
pages AS (SELECT rank, seq // {PAGE} AS page, max(seq % {PAGE}) + 1 AS n FROM parts GROUP BY ALL),
based AS (SELECT *, coalesce(sum(n) OVER (ORDER BY rank, page ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS base FROM pages)
SELECT source, sid, CAST(base + seq % {PAGE} AS BIGINT) AS seq FROM parts JOIN based ON parts.rank = based.rank AND page = seq // {PAGE}
""")
def registry_fan_in(spark: SparkSession, sf: str) -> DataFrame:
    """Landed feeds that the registry says run; Bistec has no verified address, so its payloads stay out."""
    companies = spark.createDataFrame(
        [("Rootcode", "https://rootcode.ai/careers"), ("Bistec Global", None)], "company string, verified_url string")
    scope = registry.sources_in_scope(
        registry.default_registry(spark, companies), "Software Engineer", remote_global=True)
    guid = F.struct(F.col("seq").cast("string").alias("guid"), "title")
    landed = _landed(spark, sf, "Bistec Global Careers", _opening_item(), "data").unionByName(
        _landed(spark, sf, "Rootcode Careers", _position_item(), "results")).unionByName(
        _landed(spark, sf, "Himalayas", guid, "jobs"))
    return feeds.registry_fan_in(scope, landed).select("source", F.col("source_id").alias("sid"), "seq")


READABLE = ", ".join(
    f"({i}, {ck.lit(n)}, {ck.lit(registry.FULL_INVENTORY if n in registry.FULL_SCOPES else registry.BOUNDED_LISTING)}, "
    f"{str(n in registry.FULL_SCOPES).upper()}, {ck.lit(registry.FULL_SCOPES.get(n, registry.PORTAL_SCOPE % 80))})"
    for i, n in enumerate([n for n, *_ in registry.CONNECTORS if n in registry.FULL_SCOPES] + [n for n, _ in registry.PORTALS]))


@query("inventory_capabilities", "2.10 S18", f"""
WITH {JOBS}, readable(place, source, capability, complete_for_scope, scope) AS (VALUES {READABLE}),
held AS (SELECT source, count(*) AS n, count(DISTINCT source_id) AS ids FROM jobs GROUP BY 1)
SELECT source, capability, complete_for_scope, scope, coalesce(n, 0) AS vacancies, coalesce(ids, 0) AS ids FROM readable LEFT JOIN held USING (source)
""")
def inventory_capabilities(spark: SparkSession, sf: str) -> DataFrame:
    """Sources that can be read without a candidate, what their inventory is good for, and what is held of it."""
    readable = registry.inventory_sources(registry.default_registry(spark))
    held = views.vacancies(spark, sf).groupBy("source").agg(
        F.count(F.lit(1)).alias("n"), F.countDistinct("source_id").alias("distinct_ids"))
    return readable.join(held, "source", "left").select(
        "source", "capability", "complete_for_scope", "scope", F.coalesce("n", F.lit(0)).alias("vacancies"),
        F.coalesce("distinct_ids", F.lit(0)).alias("ids"))
