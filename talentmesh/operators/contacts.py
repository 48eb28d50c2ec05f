"""Companies, contact leads and e-mail findings."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from talentmesh import lexicons as lex
from talentmesh.functions import urls
from talentmesh.functions.text import any_of, clean_page_text, computed, strip, text_of, unescape
from talentmesh.operators.ordering import first_by
from talentmesh.operators.skew import salted_join

PEOPLE_WORDS = '("Recruiter" OR "Talent Acquisition" OR "Human Resources" OR HR)'
PEOPLE_URL = "https://www.linkedin.com/search/results/people/?keywords="
COMPANY_URL = "https://www.linkedin.com/search/results/companies/?keywords="
MANUAL_TITLE = "LinkedIn recruiter/HR people search"
MANUAL_EVIDENCE = (
    "Manual review link. Use LinkedIn search to verify current HR/recruiting contacts."
)
EMAIL_TITLE = "Recruiting/contact email found on public web"


def unique_companies(matches: DataFrame, limit: int | None = None) -> DataFrame:
    """Companies in match order, first spelling; blank and unknown names are left out."""
    named = matches.select("seq", strip(text_of("company")).alias("company")).withColumn(
        "key", F.lower("company")
    ).where(~F.col("key").isin("", "unknown", "not supplied"))
    first = named.groupBy("key").agg(F.min(F.struct("seq", "company")).alias("f")).select(
        F.col("f.company").alias("company"), F.col("f.seq").alias("seq"))
    return first if limit is None else first.orderBy("seq").limit(limit)


def _quoted(c: Column) -> Column:
    return F.concat(F.lit('"'), c, F.lit('"'))


def people_query(company: Column, country: Column) -> Column:
    return F.concat_ws(" ", _quoted(company), F.lit(PEOPLE_WORDS), _quoted(country))


def contact_queries(company: Column, country: Column) -> Column:
    """The four searches made for a company."""
    return F.array(
        F.concat(F.lit("site:linkedin.com/in "), people_query(company, country)),
        F.concat_ws(" ", F.lit("site:linkedin.com/company"), _quoted(company), _quoted(country)),
        F.concat_ws(" ", _quoted(company),
                    F.lit('("careers" OR "jobs" OR "recruitment" OR "human resources" OR HR) email'),
                    _quoted(country)),
        F.concat(_quoted(company), F.lit(' ("talent acquisition" OR recruiter OR recruitment) email')),
    )


def manual_leads(companies: DataFrame, country: str) -> DataFrame:
    """One hand-check lead per company."""
    query = people_query(F.col("company"), F.lit(country))
    blank = {n: F.lit("") for n in ("contact_name", "email", "email_type", "profile_url",
                                    "profile_image_url", "source_url")}
    return companies.select(
        "company", F.lit(MANUAL_TITLE).alias("title"), *[c.alias(n) for n, c in blank.items()],
        F.concat(F.lit(COMPANY_URL), urls.encode_part(_quoted(F.col("company"))))
        .alias("company_linkedin_search_url"),
        F.concat(F.lit(PEOPLE_URL), urls.encode_part(query)).alias("linkedin_search_url"),
        query.alias("search_query"), F.lit(MANUAL_EVIDENCE).alias("evidence"),
        F.lit("manual_review").alias("confidence"), (F.col("seq") * 100).alias("seq"))


def name_and_role(title: Column) -> Column:
    """``struct<name, role>`` of a profile result title."""
    bare = F.replace(F.replace(title, F.lit(" | LinkedIn")), F.lit(" - LinkedIn"))
    parts = F.filter(F.transform(F.split(bare, r"\s[-|]\s", 2), strip), lambda p: p != "")
    at = lambda n: F.coalesce(F.try_element_at(parts, F.lit(n)), F.lit(""))
    return F.struct(at(1).alias("name"), at(2).alias("role"))


def hr_contact(title: Column, text: Column) -> Column:
    return any_of(F.lower(F.concat(F.lit(" "), title, F.lit(" "), text, F.lit(" "))), lex.HR_WORDS)


def email_type(email: Column) -> Column:
    local = F.lower(F.substring_index(email, "@", 1))
    root = F.regexp_extract(local, r"^([^._+\-]*)", 1)
    return F.when(local.isin(*lex.RECRUITING_PREFIXES) | root.isin(*lex.RECRUITING_PREFIXES),
                  "generic_recruiting").otherwise(F.lit("public_personal"))


def allowed_emails(text: Column, include_personal: bool = False) -> Column:
    """Distinct lower-case addresses of a text that may be kept."""
    found = F.array_distinct(F.transform(
        F.regexp_extract_all(text, F.lit(lex.EMAIL_PATTERN), F.lit(0)), F.lower))
    kept = F.filter(found, lambda e: ~any_of(e, lex.PLACEHOLDER_EMAIL_WORDS))
    return kept if include_personal else F.filter(
        kept, lambda e: email_type(e) == "generic_recruiting")


def result_leads(
    results: DataFrame, country: str, include_personal: bool = False, landed: DataFrame | None = None,
) -> DataFrame:
    """Leads of landed search results ``(company, seq, title, snippet, link, thumbnail, query)``.

    Two projections of one scan: profile results with an HR role, and addresses in the text. A
    result without an address that leads elsewhere than to a profile falls back to its page, if
    ``landed(url, html)`` has it; the page is then the evidence where it speaks of recruiting.
    """
    shaped = computed(
        results, title=clean_page_text(F.col("title")), snippet=clean_page_text(F.col("snippet")),
        link=strip(text_of("link")))
    common = dict(
        company_linkedin_search_url=F.concat(
            F.lit(COMPANY_URL), urls.encode_part(_quoted(F.col("company")))),
        linkedin_search_url=F.concat(
            F.lit(PEOPLE_URL), urls.encode_part(people_query(F.col("company"), F.lit(country)))),
        profile_image_url=F.col("thumbnail"), source_url=F.col("link"), search_query=F.col("query"))
    person = name_and_role(F.col("title"))
    profiles = shaped.withColumn("p", person).where(
        F.lower("link").contains("linkedin.com/in") & hr_contact(F.col("p.role"), F.col("snippet"))
    ).select(
        "company", F.col("p.name").alias("contact_name"), F.col("p.role").alias("title"),
        F.lit("").alias("email"), F.lit("").alias("email_type"), F.col("link").alias("profile_url"),
        *[c.alias(n) for n, c in common.items()], F.col("snippet").alias("evidence"),
        F.lit("public_linkedin_result").alias("confidence"), F.col("seq"))
    told = computed(shaped, evidence=F.concat_ws("\n", "title", "snippet"))
    told = computed(told, mails=allowed_emails(F.col("evidence"), include_personal))
    if landed is not None:
        told = _with_page_text(told, landed, include_personal)
    mails = told.select("*", F.posexplode_outer("mails").alias("n", "mail")).where(F.col("mail").isNotNull()).select(
        "company", F.lit("").alias("contact_name"), F.lit(EMAIL_TITLE).alias("title"),
        F.col("mail").alias("email"), email_type(F.col("mail")).alias("email_type"),
        F.lit("").alias("profile_url"), *[c.alias(n) for n, c in common.items()],
        "evidence", F.lit("public_email").alias("confidence"),
        (F.col("seq") + F.col("n") + 1).alias("seq"))
    return profiles.unionByName(mails)


def _with_page_text(told: DataFrame, landed: DataFrame, include_personal: bool) -> DataFrame:
    """Results without an address of their own with the addresses and text of their landed page.

    Only pages that are asked for are cleaned, each once however many results lead to it.
    """
    open_link = (F.size("mails") == 0) & (F.col("link") != "") & ~F.lower("link").contains("linkedin.com/")
    asked = told.where(open_link).select("link").distinct()
    first = landed.join(asked, landed["url"] == asked["link"], "left_semi").groupBy("url").agg(F.min("html").alias("html"))
    page = computed(first, page_text=clean_page_text(F.col("html")))
    page = computed(page, page_mails=allowed_emails(F.col("page_text"), include_personal)).select(
        F.col("url").alias("link"), "page_text", "page_mails")
    plain = told.where(~open_link)
    found = salted_join(told.where(open_link), page, ["link"], ["seq"], "left")
    speaks = hr_contact(F.col("title"), F.coalesce("page_text", F.lit(""))) & (F.coalesce("page_text", F.lit("")) != "")
    none = F.array().cast("array<string>")
    fallen = found.withColumn("evidence", F.when(speaks, F.col("page_text")).otherwise(F.col("evidence"))).withColumn(
        "mails", F.coalesce("page_mails", none))
    return plain.unionByName(fallen.select(plain.columns))


def unique_leads(leads: DataFrame) -> DataFrame:
    """First lead per (company, name, address, profile or search link)."""
    low = lambda c: strip(F.lower(text_of(c)))
    link = F.when(low("profile_url") != "", low("profile_url")).otherwise(low("linkedin_search_url"))
    key = F.sha2(F.concat_ws("\u001f", low("company"), low("contact_name"), low("email"), link), 256)
    return first_by(leads.withColumn("__k", key), ["__k"]).drop("__k")


# --- e-mail harvest -------------------------------------------------------------------------------

_FULL_EMAIL = r"(?i)^[A-Z0-9._%+\-]+@[A-Z0-9.\-]+\.[A-Z]{2,}$"


def decoded_protection(code: Column) -> Column:
    """Address behind a hex text whose first byte is the XOR key of the rest."""
    key = F.conv(F.substring(code, 1, 2), 16, 10).cast("int")
    size = (F.length(code) / 2).cast("int")
    at = lambda i: F.conv(F.substr(code, i * 2 + 1, F.lit(2)), 16, 10).cast("int")
    return F.when(size >= 2, F.array_join(
        F.transform(F.sequence(F.lit(1), size - 1), lambda i: F.chr(at(i).bitwiseXOR(key))), ""))


def clean_email(c: Column) -> Column:
    return F.lower(F.regexp_replace(
        strip(unescape(urls.decode_part(c))), r"^[.,;:()\[\]{}<>\"']+|[.,;:()\[\]{}<>\"']+$", ""))


def valid_email(email: Column) -> Column:
    domain = F.substring_index(email, "@", -1)
    skipped = "|".join(re.escape(d) for d in lex.HARVEST_SKIPPED_DOMAINS)
    return (email.rlike(_FULL_EMAIL) & ~domain.rlike(rf"(?:^|\.)(?:{skipped})$")
            & ~any_of(email, lex.HARVEST_JUNK_WORDS))


def page_emails(html: Column) -> Column:
    """Sorted distinct addresses of a page: text, mailto links and protected ones."""
    every = lambda c, p, g: F.regexp_extract_all(c, F.lit(p), F.lit(g))
    plain = every(unescape(html), lex.EMAIL_PATTERN, 0)
    mailto = every(html, r"(?i)mailto:([^?&#\"']+)", 1)
    hidden = F.transform(every(html, r"data-cfemail=[\"']([0-9a-fA-F]+)[\"']", 1),
                         decoded_protection)
    cleaned = F.transform(F.array_compact(F.concat(plain, mailto, hidden)), clean_email)
    return F.array_sort(F.array_distinct(F.filter(cleaned, lambda e: valid_email(e))))


def _is_board(host: Column) -> Column:
    boards = "|".join(re.escape(h) for h in lex.AGGREGATOR_HOSTS)
    return host.rlike(rf"(?:^|\.)(?:{boards})$")


def email_findings(visited: DataFrame) -> DataFrame:
    """Addresses found for every vacancy, first page of each address.

    ``visited(apply_url, company, title, score, ordinal, url, html)``; pages of the one board
    that embeds unrelated vacancies are not read.
    """
    usable = visited.where(~urls.netloc(F.col("url")).rlike(r"(?:^|\.)linkedin\.com$"))
    rows = usable.select(
        "apply_url", "company", "title", "score", "ordinal", "url",
        F.explode_outer(page_emails(F.col("html"))).alias("email")
    ).where(F.col("email").isNotNull())
    first = rows.groupBy("apply_url", "email").agg(
        F.min(F.struct("ordinal", "url", "company", "title", "score")).alias("f")
    ).select("apply_url", "email", "f.*")
    local = F.substring_index("email", "@", 1)
    root = F.regexp_extract(local, r"^([^._+\-]*)", 1)
    domain, page = F.substring_index("email", "@", -1), F.regexp_replace(urls.netloc(F.col("url")), r"^www\.", "")
    platform = _is_board(page) & ((domain == page) | F.endswith(page, F.concat(F.lit("."), domain)))
    return first.select(
        "company", F.col("title").alias("job_title"), "email",
        F.when(local.isin(*lex.HARVEST_PREFIXES) | root.isin(*lex.HARVEST_PREFIXES), "generic/company")
        .otherwise(F.lit("named/public")).alias("email_type"),
        F.when(platform, "job-board/platform contact").otherwise(F.lit("employer/job contact"))
        .alias("email_scope"),
        F.col("url").alias("email_source_url"), "apply_url", F.col("score").alias("match_score"))


def findings_report(findings: DataFrame) -> DataFrame:
    return findings.orderBy(F.lower("company"), "email", F.lower("job_title"))


def crawl_audit(visited: DataFrame, findings: DataFrame) -> DataFrame:
    """Pages read and addresses found for every vacancy; unread starts are marked."""
    pages_read = visited.groupBy("apply_url").agg(
        F.count_if(F.col("html") != "").alias("pages_checked"),
        F.max(F.when(F.col("ordinal") == 0, F.col("html") != "")).alias("start_read"))
    found = findings.groupBy("apply_url").agg(F.count(F.lit(1)).alias("emails_found"))
    return pages_read.join(found, "apply_url", "left").select(
        "apply_url", "pages_checked", F.coalesce("emails_found", F.lit(0)).alias("emails_found"),
        F.when(F.coalesce("start_read", F.lit(False)), "checked")
        .otherwise(F.lit("blocked_or_unavailable")).alias("status"))


def email_totals(findings: DataFrame) -> DataFrame:
    return findings.groupBy("email_scope").agg(
        F.count(F.lit(1)).alias("occurrences"), F.countDistinct("email").alias("addresses"))
