"""Listing pages to vacancy cards: one pattern for the card, one per field."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from talentmesh import lexicons as lex
from talentmesh.functions import urls
from talentmesh.functions.text import clean_html, first_group, strip, unescape
from talentmesh.operators.jsonld import structured_records

# --- fixed values: card and field patterns --------------------------------------------------------
CARD = r"(?is)<article\b(?=[^>]*class=[\"'][^\"']*\bjob-card\b)[^>]*>.*?</article>"
CARD_LINK = r"(?is)<a\b[^>]*href=[\"']([^\"']+)"
CARD_TITLE = r"(?is)<h2\b[^>]*class=[\"'][^\"']*\bjc-title\b[^\"']*[\"'][^>]*>(.*?)</h2>"
CARD_COMPANY = r"(?is)<span\b[^>]*class=[\"'][^\"']*\bjc-company\b[^\"']*[\"'][^>]*>(.*?)</span>"
CARD_PLACE = r"(?is)<span\b[^>]*class=[\"'][^\"']*\bla\b[^\"']*[\"'][^>]*>(.*?)</span>"
CARD_ID = r"(?is)<article\b[^>]*\bid=[\"']([^\"']+)"
CARD_TIME = r"(?is)<time\b[^>]*\bdatetime=[\"']([^\"']+)"
TABLE_ROW = r"(?is)<tr\b.*?</tr>"
RESULT = (
    r"(?is)<a[^>]+class=\"result__a\"[^>]+href=\"([^\"]+)\"[^>]*>(.*?)</a>.*?"
    r"(?:<a[^>]+class=\"result__snippet\"[^>]*>(.*?)</a>|"
    r"<div[^>]+class=\"result__snippet\"[^>]*>(.*?)</div>)"
)
BOARD_LINK = r"(?is)href=[\"']([^\"']*/jobs/[^\"']+/)[\"'][^>]*>(.*?)</a>"
GUEST_CARD = r"(?is)<div class=\"base-card\b.*?</li>"
GUEST_TITLE = r"(?is)<h3 class=\"base-search-card__title\">\s*(.*?)\s*</h3>"
GUEST_COMPANY = r"(?is)<h4 class=\"base-search-card__subtitle\">.*?<a[^>]*>\s*(.*?)\s*</a>"
GUEST_PLACE = r"(?is)<span class=\"job-search-card__location\">\s*(.*?)\s*</span>"
GUEST_LINK = r"(?is)<a class=\"base-card__full-link[^\"]*\" href=\"([^\"]+)\""
GUEST_TIME = r"(?is)<time[^>]*datetime=\"([^\"]+)\""
REMARK = r"(?is)<div\b[^>]*\bid=[\"']remark[\"'][^>]*>(.*?)</div>"


def _exploded(pages_df: DataFrame, pattern: str, name: str) -> DataFrame:
    found = F.regexp_extract_all(F.col("html"), F.lit(pattern), F.lit(0))
    return pages_df.select(
        "page_id", F.col("url").alias("base"), F.posexplode_outer(found).alias("ordinal", name)
    ).where(F.col(name).isNotNull())


def article_cards(pages_df: DataFrame, source: str = "ITPro.lk", root: str = "https://itpro.lk/"
                  ) -> DataFrame:
    card = F.col("card")
    href = unescape(first_group(card, CARD_LINK))
    made = _exploded(pages_df, CARD, "card").select(
        "page_id", "ordinal", F.lit(source).alias("source"), href.alias("href"),
        first_group(card, CARD_ID).alias("own_id"),
        clean_html(first_group(card, CARD_TITLE)).alias("title"),
        clean_html(first_group(card, CARD_COMPANY)).alias("company"),
        clean_html(first_group(card, CARD_PLACE)).alias("place"),
        clean_html(card).alias("description"), first_group(card, CARD_TIME).alias("published_raw"))
    return made.where((F.col("href") != "") & (F.col("title") != "")).select(
        "page_id", "ordinal", "source",
        F.when(F.col("own_id") != "", F.col("own_id")).otherwise(F.col("href")).alias("source_id"),
        "title", "company",
        F.when(F.col("place") != "", F.col("place")).otherwise("Sri Lanka").alias("location"),
        F.lit("sri lanka").alias("country_hint"),
        urls.join_url(F.lit(root), F.col("href")).alias("url"), "description", "published_raw")


def _hidden(row: Column, prefix: str) -> Column:
    return first_group(row, rf'(?i)id="{prefix}[^"]*"[^>]*>([^<]+)</span>')


def table_rows(pages_df: DataFrame, source: str = "topjobs.lk") -> DataFrame:
    row = F.col("row")
    visible = F.regexp_replace(row, r"(?s)<!--.*?-->", "")
    cells = F.transform(
        F.regexp_extract_all(visible, F.lit(r"(?is)<td[^>]*>(.*?)</td>"), F.lit(1)),
        lambda c: clean_html(c))
    staged = _exploded(pages_df, TABLE_ROW, "row").select(
        "page_id", "base", "ordinal",
        clean_html(first_group(row, r"(?is)<h2>\s*<span>(.*?)</span>\s*</h2>")).alias("title"),
        clean_html(first_group(row, r"(?is)<h1>(.*?)</h1>")).alias("company"),
        _hidden(row, "hdnJC").alias("jc"), _hidden(row, "hdnEC").alias("ec"),
        _hidden(row, "hdnAC").alias("ac"),
        first_group(row, r"(?is)<tr\b[^>]*\bid=[\"']tr(\d+)").alias("rid"),
        F.regexp_extract(row, r"(?i)openSizeWindow\('[^']*rid=(\d+)&", 1).alias("window_rid"),
        cells.alias("cells"), clean_html(visible).alias("text"))
    cell = lambda n: F.coalesce(F.try_element_at("cells", F.lit(n)), F.lit(""))
    default = lambda c: F.when(F.col(c) != "", F.col(c)).otherwise(F.lit("DEFZZZ"))
    rid = F.coalesce(F.nullif(F.col("rid"), F.lit("")), F.nullif(F.col("window_rid"), F.lit("")),
                     F.lit("0"))
    address = F.when(
        F.col("jc") != "", urls.advert_url(default("ac"), default("ec"), F.col("jc"), rid)
    ).otherwise(F.col("base"))
    out = staged.where(F.col("title") != "").withColumn("url", address)
    return out.select(
        "page_id", "ordinal", F.lit(source).alias("source"),
        F.when(F.col("jc") != "", F.col("jc")).otherwise(F.col("url")).alias("source_id"), "title",
        "company", F.when(cell(-1) != "", cell(-1)).otherwise("Sri Lanka").alias("location"),
        F.lit("sri lanka").alias("country_hint"), "url",
        F.concat("text", F.lit(" Closing date: "), cell(-2)).alias("description"),
        cell(-3).alias("published_raw"))


def search_results(pages_df: DataFrame) -> DataFrame:
    """``title, url, snippet`` of a web search result page."""
    hit = F.col("hit")
    snippet = F.coalesce(F.nullif(F.regexp_extract(hit, RESULT, 3), F.lit("")),
                         F.regexp_extract(hit, RESULT, 4))
    return _exploded(pages_df, RESULT, "hit").select(
        "page_id", "ordinal",
        urls.result_target(unescape(F.regexp_extract(hit, RESULT, 1))).alias("url"),
        clean_html(F.regexp_extract(hit, RESULT, 2)).alias("title"),
        clean_html(snippet).alias("snippet"))


def board_links(pages_df: DataFrame) -> DataFrame:
    """Detail links of a hosted board, first title of an address."""
    link = F.col("link")
    rows = _exploded(pages_df, BOARD_LINK, "link").select(
        "page_id", "ordinal",
        urls.join_url(F.col("base"), unescape(F.regexp_extract(link, BOARD_LINK, 1))).alias("url"),
        clean_html(F.regexp_extract(link, BOARD_LINK, 2)).alias("title"))
    return rows.groupBy("page_id", "url").agg(
        F.min(F.struct("ordinal", "title")).alias("m")).select(
        "page_id", "url", F.col("m.title").alias("title"))


def advert_detail(html: Column) -> Column:
    """Advert text of a detail page; '' when it is short or only a referral."""
    text = clean_html(first_group(html, REMARK))
    heads = "|".join(lex.GENERIC_ADVERT_PREFIXES)
    return F.when((F.length(text) < 80) | F.lower(text).rlike(f"^(?:{heads})"), F.lit("")).otherwise(
        text)


def search_hit_jobs(hits: DataFrame, source: str, country: str) -> DataFrame:
    """Search hits as unverified vacancies."""
    canonical = urls.crawl_url(F.col("url"))
    made = hits.withColumn("url", F.when(canonical != "", canonical).otherwise(F.col("url")))
    return made.select(
        "page_id", "ordinal", F.lit(source).alias("source"),
        strip(F.lower("url")).alias("source_id"), "title",
        urls.company_of(F.col("url"), F.col("title")).alias("company"),
        F.lit(country.title()).alias("location"), F.lit(country).alias("country_hint"), "url",
        F.col("snippet").alias("description"), F.lit("search result").alias("job_type"))


def guest_cards(pages_df: DataFrame, source: str = "LinkedIn Public") -> DataFrame:
    """Guest search cards with a title, a link and a place in the country."""
    card = F.col("card")
    own_id = first_group(card, r"(?i)urn:li:jobPosting:(\d+)")
    made = _exploded(pages_df, GUEST_CARD, "card").select(
        "page_id", "ordinal", F.lit(source).alias("source"), own_id.alias("own_id"),
        clean_html(first_group(card, GUEST_TITLE)).alias("title"),
        clean_html(first_group(card, GUEST_COMPANY)).alias("company"),
        clean_html(first_group(card, GUEST_PLACE)).alias("location"),
        unescape(first_group(card, GUEST_LINK)).alias("url"),
        first_group(card, GUEST_TIME).alias("published_raw"))
    kept = made.where((F.col("title") != "") & (F.col("url") != "") & F.lower("location").contains("sri lanka"))
    return kept.select(
        "page_id", "ordinal", "source",
        F.when(F.col("own_id") != "", F.col("own_id")).otherwise(F.col("url")).alias("source_id"),
        "title", "company", "location", F.lit("sri lanka").alias("country_hint"), "url",
        F.col("title").alias("description"), "published_raw")


def structured_list(pages_df: DataFrame, source: str = "RemoteRocketship") -> DataFrame:
    """Records with an address of a board's JSON-LD list; a blank title is read from the address."""
    field = lambda key: F.coalesce(F.get_json_object("record", f"$.{key}"), F.lit(""))
    either = lambda a, b: F.when(a != "", a).otherwise(b)
    made = structured_records(pages_df).select(
        "page_id", "ordinal", "record", field("url").alias("url"), either(field("name"), field("title")).alias("named"))
    titled = made.where(F.col("url") != "").withColumn(
        "title", either(F.col("named"), urls.title_from_slug(F.col("url"))))
    return titled.select(
        "page_id", "ordinal", F.lit(source).alias("source"), F.col("url").alias("source_id"),
        either(F.col("title"), F.lit("Machine Learning / AI role")).alias("title"),
        field("hiringOrganization.name").alias("company"), F.lit("Sri Lanka / Remote").alias("location"),
        F.lit("sri lanka").alias("country_hint"), "url",
        either(field("description"), F.col("title")).alias("description"),
        field("datePosted").alias("published_raw"), field("employmentType").alias("job_type"))


def search_payloads(landed: DataFrame) -> DataFrame:
    """``title, url, snippet, thumbnail`` of landed search-result JSON, one row a result.

    ``landed(page_id, source, payload)`` holds ``items`` or ``organic_results``. Entries that are
    no objects are skipped; an unreadable payload gives no row. The thumbnail is that of a contact result.
    """
    lists = F.from_json("payload", "struct<items:array<string>,organic_results:array<string>>")
    none = F.array().cast("array<string>")
    read = landed.select("page_id", "source", lists.alias("p")).select(
        "page_id", "source", F.posexplode(F.concat(
            F.coalesce("p.items", none), F.coalesce("p.organic_results", none))).alias("ordinal", "item"))
    field = lambda path: F.coalesce(F.get_json_object("item", f"$.{path}"), F.lit(""))
    return read.where(F.col("item").startswith("{")).select(
        "page_id", "ordinal", "source", field("title").alias("title"), field("link").alias("url"),
        field("snippet").alias("snippet"), field("pagemap.cse_thumbnail[0].src").alias("thumbnail"))
