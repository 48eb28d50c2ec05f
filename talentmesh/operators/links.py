"""Links of landed pages: extraction, classes, search forms, caps and priorities."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from talentmesh import lexicons as lex
from talentmesh.functions import pages, urls
from talentmesh.functions.text import (
    any_of, attribute, collapse, let, strip,
)
from talentmesh.operators.ordering import top_k


def page_links(pages_df: DataFrame, html: str = "html") -> DataFrame:
    """``page_id, ordinal, title, url`` of every usable anchor, addresses made absolute."""
    made = F.transform(pages.anchors(F.col(html)), lambda a: F.struct(
        a["title"].alias("title"),
        F.when(
            (a["href"] != "") & (a["title"] != "") & ~a["href"].rlike(pages.SKIPPED_HREF),
            urls.crawl_url(urls.join_url(F.col("url"), a["href"])),
        ).alias("url"),
    ))
    return pages_df.select(
        "page_id", F.col("url").alias("base"), F.posexplode_outer(made).alias("ordinal", "a"),
    ).where(F.coalesce(F.col("a.url"), F.lit("")) != "").select(
        "page_id", "base", "ordinal", F.col("a.title").alias("title"), F.col("a.url").alias("url"))


def merged_links(rendered: DataFrame, static: DataFrame) -> DataFrame:
    """Rendered links before static ones; the first title of an address wins."""
    both = rendered.withColumn("origin", F.lit(0)).unionByName(
        static.withColumn("origin", F.lit(1)))
    return both.groupBy("page_id", "url").agg(
        F.min(F.struct("origin", "ordinal", "title")).alias("m")
    ).select("page_id", "url", F.col("m.title").alias("title"))


def _label(title: Column) -> Column:
    return collapse(F.lower(title))


def generic_title(title: Column) -> Column:
    value = F.regexp_replace(_label(title), r"^[ \-|:]+|[ \-|:]+$", "")
    starts = "|".join(re.escape(p) for p in lex.GENERIC_LISTING_PREFIXES)
    return value.isin(*lex.GENERIC_LISTING_TITLES) | value.rlike(f"^(?:{starts})")


def listing_heading(title: Column) -> Column:
    value = _label(title)
    return (
        generic_title(value)
        | value.rlike(r"(?U)\b(?:jobs|vacancies|openings)\s+in\b")
        | value.rlike(r"(?U)\b(?:all|latest|current|available)\s+(?:jobs|vacancies|openings)\b")
        | any_of(value, lex.LISTING_HEADING_PHRASES)
    )


def role_title(title: Column) -> Column:
    body = "|".join(re.escape(w) for w in lex.ROLE_TITLE_WORDS)
    return F.lower(title).rlike(rf"(?U)\b(?:{body})s?\b")


def job_category(title: Column) -> Column:
    label = F.trim(F.regexp_replace(F.lower(title), "[^a-z0-9&/+]+", " "))
    body = "|".join(re.escape(w) for w in lex.JOB_CATEGORY_TERMS)
    return (label != "") & ~role_title(label) & (
        label.contains("&") | label.contains("/") | label.rlike(rf"\b(?:{body})\b")
    )


def homepage(url: Column) -> Column:
    return (F.regexp_replace(urls.path(url), "/+$", "") == "") & (urls.query(url) == "")


def _overlaps(values: Column, constants) -> Column:
    return F.arrays_overlap(values, F.array(*[F.lit(x) for x in constants]))


def listing_url(url: Column) -> Column:
    """Search, category and index addresses rather than one vacancy."""
    keys, segs = urls.query_keys(url), urls.segments(url)
    leaf = F.coalesce(F.try_element_at(segs, F.lit(-1)), F.lit(""))
    short = F.regexp_replace(F.replace(leaf, F.lit("_"), F.lit("-")), r"\.php$", "")
    slug_index = (F.size(segs) == 1) & (
        short.endswith("-jobs") | short.contains("-jobs-in-") | short.startswith("jobs-in-")
        | short.startswith("government-job-vacanc")
    )
    paged = F.exists(
        F.slice(segs, F.lit(1), F.greatest(F.size(segs) - 1, F.lit(0))),
        lambda s: s.isin("page", "paged"),
    )
    return (
        F.when(_overlaps(keys, lex.DETAIL_ID_KEYS), F.lit(False))
        .when(_overlaps(keys, lex.LISTING_KEYS), F.lit(True))
        .when(F.size(segs) == 0, F.lit(False))
        .otherwise(
            leaf.isin(*lex.LISTING_LEAVES) | slug_index
            | (F.array_join(segs, "/") == "post/job/vacancy")
            | _overlaps(segs, lex.LISTING_SEGMENTS) | paged
        )
    )


def job_link(url: Column, title: Column) -> Column:
    text = F.lower(F.concat_ws(" ", urls.path(url), urls.query(url), title))
    return any_of(text, lex.JOB_LINK_WORDS)


def _pager_label(title: Column) -> Column:
    label = _label(title)
    return label.isin(*lex.PAGER_LABELS) | label.rlike(r"^(?:page\s*)?\d+$")


def pagination(url: Column, title: Column) -> Column:
    segs = urls.segments(url)
    numbered = F.exists(
        F.sequence(F.lit(1), F.greatest(F.size(segs) - 1, F.lit(1))),
        lambda i: F.coalesce(
            F.try_element_at(segs, i).isin("page", "paged")
            & F.try_element_at(segs, i + 1).rlike(r"^\d+$"), F.lit(False)),
    )
    return (
        _overlaps(urls.query_keys(url, drop_brackets=True), lex.PAGING_KEYS)
        | numbered | _pager_label(title)
    )


def navigation(url: Column, title: Column) -> Column:
    """Links that lead to more vacancies: listings, categories and pagers."""
    segs = urls.segments(url)
    category = (F.size(segs) == 2) & F.coalesce(
        F.try_element_at(segs, F.lit(1)).isin(*lex.LISTING_ROOTS), F.lit(False)
    ) & job_category(title)
    return (url != "") & ~homepage(url) & (
        listing_url(url) | listing_heading(title) | category | _pager_label(title)
        | any_of(_label(title), lex.NAVIGATION_PHRASES)
    )


def detail_link(url: Column, title: Column) -> Column:
    """Links that may be one vacancy."""
    suffix = F.lower(F.substring_index(urls.path(url), "/", -1))
    ends = "|".join(re.escape(s) for s in lex.DOCUMENT_SUFFIXES)
    other_file = suffix.contains(".") & ~suffix.rlike(f"(?:{ends})$")
    named = (
        job_link(url, title) | role_title(title)
        | _overlaps(urls.query_keys(url), ("id", *lex.DETAIL_ID_KEYS))
    )
    return (
        (url != "") & ~homepage(url) & ~listing_url(url) & ~listing_heading(title)
        & ~_overlaps(urls.segments(url), lex.NON_JOB_SEGMENTS) & ~other_file & named
    )


def classified(links_df: DataFrame) -> DataFrame:
    """Add the flags of a link and one class: detail, navigation or other."""
    url, title = F.col("url"), F.col("title")
    flagged = links_df.select(
        "*", homepage(url).alias("is_home"), listing_url(url).alias("is_listing"),
        pagination(url, title).alias("is_pager"), navigation(url, title).alias("is_navigation"),
        detail_link(url, title).alias("is_detail"),
    )
    return flagged.withColumn(
        "link_class",
        F.when(F.col("is_detail"), "detail").when(F.col("is_navigation"), "navigation")
        .otherwise(F.lit("other")),
    )


#: Stands for the role in an address that is filled in later.
ROLE_MARK = "\ue000"


def search_forms(pages_df: DataFrame, position: str, per_page: int = 3) -> DataFrame:
    """Search addresses a page's own GET forms would produce for a role.

    Forms are exploded, every named input is scored, the best field of a form takes the
    role (ties: the larger name), hidden values are kept.
    """
    pair = lambda k, v: F.struct(k.alias("k"), v.alias("v"))
    points = lambda test, n: F.when(test, F.lit(n)).otherwise(F.lit(0))

    def field(tag: Column) -> Column:
        name, kind = strip(attribute(tag, "name")), F.lower(attribute(tag, "type"))
        low, hint = F.lower(name), F.lower(attribute(tag, "placeholder"))
        value = attribute(tag, "value")
        score = (
            points(kind == "search", 4) + points(low.isin(*lex.SEARCH_FIELD_NAMES), 5)
            + points(any_of(low, ("search", "keyword", "query", "title")), 2)
            + points(any_of(hint, ("job", "position", "keyword", "search")), 2)
        )
        return F.struct(name.alias("name"), value.alias("value"), score.alias("score"),
                        ((kind == "hidden") & (value != "")).alias("hidden"))

    def address(action: Column, fields: Column) -> Column:
        best = F.array_max(F.transform(
            F.filter(fields, lambda x: ~x["hidden"] & (x["score"] > 0)),
            lambda x: F.struct(x["score"].alias("score"), x["name"].alias("name"))))["name"]
        hidden = F.transform(F.filter(fields, lambda x: x["hidden"]),
                             lambda x: pair(x["name"], x["value"]))
        layered = let(best, lambda name: F.when(name.isNotNull(), F.concat(
            urls.query_pairs(urls.query(action)), hidden,
            F.array(pair(name, F.lit(position))))))
        last = let(layered, lambda ps: F.filter(ps, lambda p, i: ~F.exists(
            F.slice(ps, i + 2, F.size(ps)), lambda q: q["k"] == p["k"])))
        encoded = F.array_join(F.transform(last, lambda p: F.concat(
            urls.encode_part(p["k"]), F.lit("="), urls.encode_part(p["v"]))), "&")
        return urls.crawl_url(F.concat(
            F.regexp_extract(action, r"(?s)^([^?#]*)", 1), F.lit("?"), encoded))

    def form(markup: Column) -> Column:
        head = F.regexp_extract(markup, r"(?is)^<form\b([^>]*)>", 1)
        inputs = F.regexp_extract_all(markup, F.lit(r"(?is)<input\b([^>]*)>"), F.lit(1))
        fields = F.filter(F.transform(inputs, lambda t: field(t)), lambda x: x["name"] != "")
        target = urls.join_url(F.col("url"), attribute(head, "action"))
        usable = lambda a: (
            F.lower(attribute(head, "method")).isin("", "get") & urls.same_site(a, F.col("url")))
        return let(target, lambda a: F.when(
            usable(a), let(fields, lambda fs: address(a, fs))))

    markups = F.regexp_extract_all(
        F.col("html"), F.lit(r"(?is)<form\b[^>]*>.*?</form>"), F.lit(0))
    built = pages_df.select("page_id", F.posexplode_outer(
        F.transform(markups, lambda m: form(m))).alias("form", "search_url")
    ).where(F.coalesce(F.col("search_url"), F.lit("")) != "")
    first = built.groupBy("page_id", "search_url").agg(F.min("form").alias("form"))
    return top_k(first, ["page_id"], [F.col("form")], per_page, "n").select(
        "page_id", "search_url")


def listing_roots(links_df: DataFrame, path_pattern: str, host: str | None = None) -> DataFrame:
    """Distinct inventory roots of a board: host (by default the page's own) and path shape match."""
    url = F.col("url")
    keep = (urls.site_host(url) == (F.lit(host) if host else urls.site_host(F.col("base")))) & urls.path(url).rlike(path_pattern)
    return links_df.where(keep).select("page_id", "url").distinct()


def listing_pages(links_df: DataFrame, page_key: str, same_keys: tuple[str, ...] = ()) -> DataFrame:
    """Distinct further pages of a listing: same host and path, a page number above one."""
    url, base = F.col("url"), F.col("base")
    number = urls.query_value(url, page_key)
    trimmed = lambda c: F.regexp_replace(urls.path(c), "/+$", "")
    keep = (
        (urls.site_host(url) == urls.site_host(base)) & (trimmed(url) == trimmed(base))
        & F.coalesce(number.try_cast("long") > 1, F.lit(False))
    )
    for key in same_keys:
        keep = keep & (urls.query_value(url, key) == urls.query_value(base, key))
    return links_df.where(keep).select("page_id", "url").distinct()


def contact_links(pages_df: DataFrame, per_page: int = 8) -> DataFrame:
    """Same-host links of a page that may carry an address; job boards are left out."""
    hrefs = F.regexp_extract_all(
        F.col("html"), F.lit(r"(?is)href\s*=\s*[\"']([^\"'#]+)[\"']"), F.lit(1))
    boards = "|".join(re.escape(h) for h in lex.AGGREGATOR_HOSTS)
    own = pages_df.where(~urls.site_host(F.col("url")).rlike(rf"(?:^|\.)(?:{boards})$"))
    raw = own.select(
        "page_id", F.col("url").alias("base"), F.posexplode_outer(hrefs).alias("ordinal", "href")
    ).where(F.col("href").isNotNull())
    full = raw.withColumn("full", urls.join_url(F.col("base"), pages.unescape(F.col("href"))))
    bare = F.regexp_replace(F.regexp_extract("full", r"(?s)^([^?#]*)", 1), "/+$", "")
    kept = full.withColumn("link", bare).where(
        urls.scheme(F.col("full")).isin("http", "https")
        & (urls.netloc(F.col("full")) == urls.netloc(F.col("base")))
        & any_of(F.lower(F.concat_ws(" ", urls.path(F.col("full")), "href")),
                 lex.CONTACT_LINK_WORDS)
        & (F.col("link") != F.regexp_replace("base", "/+$", ""))
    )
    first = kept.groupBy("page_id", "link").agg(F.min("ordinal").alias("ordinal"))
    return top_k(first, ["page_id"], [F.col("ordinal")], per_page, "n")


def returned_pages(requested: DataFrame, returned: DataFrame) -> DataFrame:
    """Match returned pages to requests: same canonical address, else the host's first.

    Pages of hosts nobody asked for are dropped; ``requested(request_id, url)``,
    ``returned(page_id, url)``. Requests are reduced to one row per address and per host
    before they are joined, so a busy host costs one row on that side.
    """
    parts = [urls.crawl_url(F.col("url")).alias("address"), urls.site_host(F.col("url")).alias("host")]
    want, have = requested.select("request_id", *parts), returned.select("page_id", *parts)
    have = have.where(F.col("address") != "")
    first = lambda key: want.groupBy(key).agg(F.min("request_id").alias("request_id"))
    exact = have.join(first("address"), "address").select("page_id", "request_id")
    left = have.join(exact.select("page_id"), "page_id", "left_anti")
    return exact.unionByName(left.join(first("host"), "host").select("page_id", "request_id"))


__all__ = [n for n in dir() if not n.startswith("_")]
