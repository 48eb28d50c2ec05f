"""Expressions over the HTML of a page."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from talentmesh import lexicons as lex
from talentmesh.functions.text import (
    any_of, attribute, clean_html, collapse, first_group, strip, text_of, unescape,
)

# --- fixed values: patterns of page parts ---------------------------------------------------------
ANCHOR = r"(?is)<a\b[^>]*>.*?</a>"
ANCHOR_PARTS = r"(?is)^<a\b([^>]*)>(.*)</a>$"
IMAGE_ALT = r"(?is)<img\b[^>]*\balt=[\"']([^\"']+)[\"']"
NOISE = r"(?is)<(script|style|noscript|svg|nav|header|footer)\b.*?</\1>"
CONTENT_BLOCKS = (
    r"(?is)<main\b[^>]*>(.*?)</main>",
    r"(?is)<article\b[^>]*>(.*?)</article>",
    r"(?is)<(?:div|section)\b[^>]*(?:id|class)=[\"'][^\"']*(?:job[-_\s]?description|"
    r"job[-_\s]?details|vacancy[-_\s]?details|description|posting[-_\s]?content)[^\"']*[\"']"
    r"[^>]*>(.*?)</(?:div|section)>",
)
BODY = r"(?is)<body\b[^>]*>(.*?)</body>"
BLOCK_END = r"(?i)</(?:address|dd|div|li|p|section|span|td|tr)>|<br\s*/?>"
LOCATION_LINE = r"(?i)^(?:job\s+)?location\s*(?::|-)\s*(.{2,100})$"
LOCATION_LABEL = r"(?i)^(?:job\s+)?location\s*(?::|-)?$"


def _longest(values: Column) -> Column:
    """The longest text of an array, the first on ties; '' for none."""
    best = F.aggregate(
        values, F.lit(""), lambda acc, v: F.when(F.length(v) > F.length(acc), v).otherwise(acc)
    )
    return F.coalesce(best, F.lit(""))


def heading(html: Column, fallback: Column | None = None) -> Column:
    """First of h1, og:title, twitter:title and title that has readable text."""
    og = F.regexp_extract(html, r"(?is)<meta\b[^>]*property=[\"']og:title[\"'][^>]*>", 0)
    tw = F.regexp_extract(html, r"(?is)<meta\b[^>]*name=[\"']twitter:title[\"'][^>]*>", 0)
    options = (
        F.regexp_extract(html, r"(?is)<h1\b[^>]*>(.*?)</h1>", 1),
        attribute(og, "content"),
        attribute(tw, "content"),
        F.regexp_extract(html, r"(?is)<title\b[^>]*>(.*?)</title>", 1),
        fallback if fallback is not None else F.lit(""),
    )
    return F.coalesce(*[F.nullif(clean_html(o), F.lit("")) for o in options], F.lit(""))


def description(html: Column, max_chars: int | None = None, rendered: Column | None = None
                ) -> Column:
    """Longest readable block: main, article, description blocks, rendered text or body.

    The whole text is returned unless ``max_chars`` asks for a bounded one.
    """
    bare = F.regexp_replace(html, NOISE, " ")
    blocks = F.flatten(F.array(*[
        F.regexp_extract_all(bare, F.lit(p), F.lit(1)) for p in CONTENT_BLOCKS
    ]))
    body = F.regexp_extract(bare, BODY, 1)
    whole = F.when(bare.rlike(r"(?is)<body\b[^>]*>.*?</body>"), body).otherwise(bare)
    extra = [] if rendered is None else [rendered]
    texts = F.transform(F.concat(blocks, F.array(*extra, whole)), lambda t: clean_html(t))
    best = _longest(texts)
    return best if max_chars is None else F.substring(best, 1, max_chars)


def has_detail_evidence(html: Column, text: Column) -> Column:
    hay = F.lower(F.concat(F.lit(" "), clean_html(html), F.lit(" "), text, F.lit(" ")))
    return (F.length(text) >= 60) & any_of(hay, lex.DETAIL_SIGNALS)


def _meta_value(html: Column, markers) -> Column:
    """Content of the first meta tag whose name, property or itemprop holds a marker."""
    tags = F.regexp_extract_all(html, F.lit(r"(?is)<meta\b([^>]*)>"), F.lit(1))
    field = lambda t: F.lower(F.concat_ws(
        " ", attribute(t, "name"), attribute(t, "property"), attribute(t, "itemprop")))
    values = F.transform(
        F.filter(tags, lambda t: any_of(field(t), markers)),
        lambda t: clean_html(attribute(t, "content")),
    )
    return F.try_element_at(F.filter(values, lambda v: v != ""), F.lit(1))


def visible_lines(html: Column) -> Column:
    broken = F.regexp_replace(F.regexp_replace(html, BLOCK_END, "\n"), "<[^>]+>", " ")
    lines = F.transform(F.split(broken, r"\R"), lambda s: collapse(unescape(s)))
    return F.filter(lines, lambda s: s != "")


def _labelled_location(lines: Column) -> Column:
    """Value after a location label, on the same or on the next line."""
    trim = lambda c: F.regexp_replace(c, r"^[ |,]+|[ |,]+$", "")
    hits = F.transform(
        lines,
        lambda s, i: F.when(s.rlike(LOCATION_LINE), trim(F.regexp_extract(s, LOCATION_LINE, 1)))
        .when(s.rlike(LOCATION_LABEL) & (i + 1 < F.size(lines)),
              trim(F.substring(F.try_element_at(lines, i + 2), 1, 100))),
    )
    return F.try_element_at(F.filter(hits, lambda h: h.isNotNull()), F.lit(1))


def location(html: Column, lines: Column) -> Column:
    """Location a page states: meta tag, labelled line, or ''.

    ``lines`` is :func:`visible_lines` of the page as a column.
    """
    return F.coalesce(
        _meta_value(html, lex.LOCATION_FIELD_MARKERS), _labelled_location(lines), F.lit("")
    )


def published(html: Column) -> Column:
    """Publication date a page states: meta tag or a marked time element, or ''."""
    times = F.regexp_extract_all(html, F.lit(r"(?is)<time\b([^>]*)>"), F.lit(1))
    marked = F.filter(
        times,
        lambda t: (attribute(t, "datetime") != "")
        & any_of(F.lower(t), ("dateposted", "post", "publish")),
    )
    return F.coalesce(
        _meta_value(html, lex.PUBLISHED_FIELD_MARKERS),
        attribute(F.try_element_at(marked, F.lit(1)), "datetime"),
        F.lit(""),
    )


def anchors(html: Column) -> Column:
    """``array<struct<href, title>>`` of the anchors as written.

    The title falls back to the label, the title attribute and the image text.
    """
    tags = F.regexp_extract_all(html, F.lit(ANCHOR), F.lit(0))

    def parts(tag: Column) -> Column:
        attrs = F.regexp_extract(tag, ANCHOR_PARTS, 1)
        body = F.regexp_extract(tag, ANCHOR_PARTS, 2)
        label = lambda c: F.nullif(c, F.lit(""))
        title = F.coalesce(
            label(clean_html(body)),
            label(clean_html(F.coalesce(
                label(attribute(attrs, "aria-label")), label(attribute(attrs, "title")),
                first_group(body, IMAGE_ALT)))),
            F.lit(""),
        )
        return F.struct(
            strip(unescape(attribute(attrs, "href"))).alias("href"), title.alias("title")
        )

    return F.transform(tags, parts)


SKIPPED_HREF = r"(?i)^(?:#|javascript:|mailto:|tel:|data:)"


# --- structured postings --------------------------------------------------------------------------

POSTING_SCHEMA = (
    "`@type` string, title string, name string, url string, sameAs string, description string, "
    "datePosted string, validThrough string, employmentType string, jobLocationType string, "
    "hiringOrganization string, jobLocation string"
)
JSON_LD = r"(?is)<script\b[^>]*type=[\"']application/ld\+json(?:;[^\"']*)?[\"'][^>]*>(.*?)</script>"


def json_ld_blocks(html: Column) -> Column:
    blocks = F.regexp_extract_all(html, F.lit(JSON_LD), F.lit(1))
    return F.transform(
        blocks, lambda b: F.regexp_replace(strip(unescape(b)), r"^\s*<!--|-->\s*$", "")
    )


def _variant(c: Column, path: str, kind: str) -> Column:
    return F.try_variant_get(F.try_parse_json(c), path, kind)


def _first_text(c: Column, *paths: str) -> Column:
    return F.coalesce(*[_variant(c, p, "string") for p in paths], F.lit(""))


def posting_company(organization: Column) -> Column:
    """Name of the hiring organisation: an object, or the first object of a list."""
    return clean_html(F.coalesce(
        _variant(organization, "$.name", "string"),
        _variant(organization, "$[0].name", "string"),
        F.lit(""),
    ))


def posting_location(places: Column, kind: Column, country: Column) -> Column:
    """Distinct addresses, plus Remote for telecommuting; the country when there is none."""
    many = _variant(places, "$", "array<string>")
    one = F.when(places.startswith("{"), F.array(places))
    items = F.coalesce(many, one, F.array().cast("array<string>"))

    def address(p: Column) -> Column:
        parts = F.array(*[
            _first_text(p, f"$.address.{k}")
            for k in ("addressLocality", "addressRegion", "addressCountry")
        ])
        named = F.array_join(F.filter(parts, lambda x: x != ""), ", ")
        plain = _variant(p, "$.address", "string")
        return F.when(named != "", named).otherwise(
            F.when(~plain.startswith("{"), clean_html(plain)).otherwise(F.lit("")))

    remote = F.when(F.upper(text_of(kind)) == "TELECOMMUTE", F.array(F.lit("Remote"))).otherwise(
        F.array().cast("array<string>"))
    values = F.concat(F.filter(F.transform(items, address), lambda a: a != ""), remote)
    text = F.array_join(F.array_distinct(values), ", ")
    return F.when(text != "", text).otherwise(F.initcap(country))
