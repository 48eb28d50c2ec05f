"""URL expressions: parts, canonical forms, joins and builders."""

from __future__ import annotations

import re
from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from talentmesh import lexicons as lex
from talentmesh.functions.text import fold, let, strip, text_of, unescape

# The generic URI split of RFC 3986, appendix B.
_PARTS = r"(?s)^(?:([A-Za-z][A-Za-z0-9+.\-]*):)?(?://([^/?#]*))?([^?#]*)(?:\?([^#]*))?(?:#(.*))?$"


def scheme(c: Column) -> Column:
    return F.lower(F.regexp_extract(c, _PARTS, 1))


def netloc(c: Column) -> Column:
    return F.lower(F.regexp_extract(c, _PARTS, 2))


def path(c: Column) -> Column:
    return F.regexp_extract(c, _PARTS, 3)


def query(c: Column) -> Column:
    return F.regexp_extract(c, _PARTS, 4)


def host(c: Column) -> Column:
    """Host without user, port and trailing dots."""
    return F.regexp_replace(
        F.regexp_replace(F.regexp_replace(netloc(c), "^.*@", ""), r":\d*$", ""), r"^\.+|\.+$", ""
    )


def site_host(c: Column) -> Column:
    return F.regexp_replace(host(c), r"^www\.", "")


def same_site(a: Column, b: Column) -> Column:
    """Equal hosts, or one a sub-domain of the other."""
    left, right = site_host(a), site_host(b)
    return (
        (left != "")
        & (right != "")
        & (
            (left == right)
            | F.endswith(left, F.concat(F.lit("."), right))
            | F.endswith(right, F.concat(F.lit("."), left))
        )
    )


def without_query(c: Column) -> Column:
    return strip(F.lower(F.substring_index(c, "?", 1)))


def decode_part(c: Column) -> Column:
    """``+`` and percent escapes; a malformed escape leaves the text as it is."""
    return F.coalesce(F.try_url_decode(c), c)


def encode_part(c: Column) -> Column:
    """Query encoding where ``~`` is safe and ``*`` is not."""
    return F.replace(
        F.replace(F.url_encode(c), F.lit("*"), F.lit("%2A")), F.lit("%7E"), F.lit("~")
    )


def query_pairs(q: Column) -> Column:
    """``array<struct<k,v>>`` of the non-empty segments, decoded."""
    segments = F.filter(F.split(q, "&"), lambda s: s != "")
    return F.transform(
        segments,
        lambda s: F.struct(
            decode_part(F.substring_index(s, "=", 1)).alias("k"),
            F.when(s.contains("="), decode_part(F.regexp_replace(s, r"^[^=]*=", "")))
            .otherwise(F.lit("")).alias("v"),
        ),
    )


def query_keys(c: Column, drop_brackets: bool = False) -> Column:
    keys = F.transform(query_pairs(query(c)), lambda p: F.lower(p["k"]))
    if drop_brackets:
        keys = F.transform(keys, lambda k: F.regexp_replace(k, r"[\[\]]+$", ""))
    return keys


def query_value(c: Column, key: str) -> Column:
    """First value of a query key, '' when absent."""
    hits = F.filter(query_pairs(query(c)), lambda p: p["k"] == key)
    return F.coalesce(F.try_element_at(hits, F.lit(1))["v"], F.lit(""))


def segments(c: Column) -> Column:
    """Lower-cased, non-empty path segments."""
    return F.filter(F.split(F.lower(path(c)), "/"), lambda s: s != "")


def _encoded(pairs: Column) -> Column:
    return F.array_join(
        F.transform(pairs, lambda p: F.concat(encode_part(p["k"]), F.lit("="), encode_part(p["v"]))),
        "&",
    )


def _kept_pairs(q: Column, dropped: Sequence[str]) -> Column:
    return F.array_sort(
        F.filter(
            query_pairs(q),
            lambda p: ~(F.lower(p["k"]).startswith("utm_") | F.lower(p["k"]).isin(*dropped)),
        )
    )


def _with_query(base: Column, encoded: Column) -> Column:
    tail = let(encoded, lambda q: F.when(q == "", q).otherwise(F.concat(F.lit("?"), q)))
    return F.concat(base, tail)


def vacancy_url(c: Column) -> Column:
    """Canonical address for duplicate detection.

    Tracking parameters and the fragment go, the rest of the query is sorted, scheme and
    host are lower-cased, the path keeps its case but not its trailing slashes. Text that
    is not an absolute address is only folded.
    """
    return let(strip(text_of(c)), _vacancy_url)


def _vacancy_url(raw: Column) -> Column:
    trimmed = F.regexp_replace(path(raw), "/+$", "")
    base = F.concat(
        F.when(scheme(raw) == "", F.lit("")).otherwise(F.concat(scheme(raw), F.lit(":"))),
        F.lit("//"), netloc(raw),
        F.when(trimmed == "", F.lit("/")).otherwise(trimmed),
    )
    encoded = _encoded(_kept_pairs(query(raw), lex.TRACKING_KEYS_VACANCY))
    return F.when(netloc(raw) == "", fold(raw)).otherwise(_with_query(base, encoded))


def crawl_url(c: Column, decode=unescape) -> Column:
    """Canonical address for page discovery; '' when the text is no usable address."""
    return let(strip(decode(text_of(c))), _crawl_url)


def _crawl_url(raw: Column) -> Column:
    usable = (
        (raw != "")
        & ~raw.rlike(r"(?U)\s")
        & ~raw.rlike("[`\"']")
        & ~F.substr(raw, F.lit(9)).rlike(r"(?i)https?:/{1,2}")
        & scheme(raw).isin("http", "https")
        & (host(raw) != "")
    )
    single = F.regexp_replace(path(raw), "/+", "/")
    tidy = F.when(single.isin("", "/"), F.lit("/")).otherwise(F.regexp_replace(single, "/$", ""))
    base = F.concat(scheme(raw), F.lit("://"), netloc(raw), tidy)
    encoded = _encoded(_kept_pairs(query(raw), lex.TRACKING_KEYS_CRAWL))
    return F.when(usable, _with_query(base, encoded)).otherwise(F.lit(""))


def _resolve_dots(p: Column) -> Column:
    """Remove ``.`` and ``..`` segments of an absolute path."""
    parts = F.split(p, "/")
    kept = F.aggregate(
        parts,
        F.array().cast("array<string>"),
        lambda acc, s: F.when(s == ".", acc)
        .when(s == "..", F.when(F.size(acc) > 1, F.slice(acc, F.lit(1), F.size(acc) - 1)).otherwise(acc))
        .otherwise(F.concat(acc, F.array(s))),
    )
    joined = F.array_join(kept, "/")
    return F.when(p.rlike(r"(?:^|/)\.\.?$"), F.concat(joined, F.lit("/"))).otherwise(joined)


def join_url(base: Column, href: Column) -> Column:
    """Resolve a reference against the address of its page."""
    return let(href, lambda h: let(base, lambda b: _join_url(b, h)))


def _join_url(base: Column, href: Column) -> Column:
    root = F.concat(scheme(base), F.lit("://"), netloc(base))
    base_path = F.when(path(base) == "", F.lit("/")).otherwise(path(base))
    folder = F.regexp_replace(base_path, "[^/]*$", "")
    tail = F.regexp_extract(href, r"(?s)^[^?#]*(.*)$", 1)
    stem = F.regexp_extract(href, r"(?s)^([^?#]*)", 1)

    def dotted(p: Column) -> Column:
        return let(p, lambda q: F.when(
            q.rlike(r"(?:^|/)\.{1,2}(?:/|$)"), _resolve_dots(q)).otherwise(q))

    return (
        F.when(href == "", base)
        .when(href.rlike(r"^[A-Za-z][A-Za-z0-9+.\-]*:"), href)
        .when(href.startswith("//"), F.concat(scheme(base), F.lit(":"), href))
        .when(href.startswith("/"), F.concat(root, dotted(stem), tail))
        .when(href.startswith("?"), F.concat(root, base_path, href))
        .when(href.startswith("#"), F.concat(F.regexp_extract(base, r"(?s)^([^#]*)", 1), href))
        .otherwise(F.concat(root, dotted(F.concat(folder, stem)), tail))
    )


def title_from_slug(c: Column) -> Column:
    """Last path part, dashes to blanks, words capitalised."""
    slug = F.substring_index(F.regexp_replace(c, "/+$", ""), "/", -1)
    return F.array_join(
        F.transform(
            F.filter(F.split(slug, "-"), lambda p: p != ""),
            lambda p: F.concat(F.upper(F.substring(p, 1, 1)), F.lower(F.substr(p, F.lit(2)))),
        ),
        " ",
    )


def result_target(href: Column) -> Column:
    """Unwrap a search engine's redirect link."""
    wrapped = netloc(href).contains("duckduckgo.com") & path(href).startswith("/l/")
    inner = query_value(href, "uddg")
    return F.when(wrapped & (inner != ""), decode_part(inner)).otherwise(href)


def company_of(url: Column, title: Column) -> Column:
    """Company named after the last " at " of a title, else the host."""
    named = strip(F.substring_index(title, " at ", -1))
    bare = F.replace(netloc(url), F.lit("www."), F.lit(""))
    return F.when(F.lower(title).contains(" at "), named).otherwise(bare)


def portal_search_url(seed: Column, position: Column) -> Column:
    """Search address of the portals that take a role in the query."""
    glue = F.when(seed.contains("?"), F.lit("&")).otherwise(F.lit("?"))
    where = netloc(seed)
    return (
        F.when(position == "", seed)
        .when(where.contains("hire.lk"),
              F.concat(F.lit("https://www.hire.lk/jobs?q="), encode_part(position)))
        .when(where.contains("careerlk.com") | where.contains("jobpal.lk"),
              F.concat(seed, glue, F.lit("search_keywords="), encode_part(position)))
        .when(where.contains("recruiter.lk"),
              F.concat(seed, glue, F.lit("search="), encode_part(position)))
        .otherwise(seed)
    )


def advert_url(ac: Column, ec: Column, jc: Column, rid: Column) -> Column:
    """Advert address of the table-style board."""
    fields = (("ac", ac), ("ec", ec), ("index", rid), ("jc", jc),
              ("pg", F.lit("applicant/vacancyDetails.jsp")), ("rid", rid))
    pairs = [F.concat(F.lit(f"{k}="), encode_part(v)) for k, v in fields]
    return F.concat(F.lit("https://www.topjobs.lk/vacancy?"), F.concat_ws("&", *pairs))


def slug(c: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(fold(c), "[^a-z0-9]+", "-"), "^-+|-+$", "")


__all__ = [n for n in dir() if not n.startswith("_")]
