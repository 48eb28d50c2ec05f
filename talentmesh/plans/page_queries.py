"""Queries over landed pages."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from talentmesh import lexicons as lex
from talentmesh.functions import geo, pages, urls
from talentmesh.functions.text import clean_html, clean_page_text
from talentmesh.operators import filters, links, navigation, postings
from talentmesh.plans import checks as ck
from talentmesh.plans import views
from talentmesh.plans.registry import query
from talentmesh.sources import cards

# A landed vacancy page is a page with a board navigation, a search form and, for most
# pages, a structured posting; everything is derived from the page row itself.
LANDED_SQL = f"""
SELECT page_id, CASE WHEN page_id % 10 = 0 THEN url ELSE site || '/vacancy/' || CAST(page_id AS VARCHAR(20)) || '?utm_source=x' END AS url,
  replace(html, '<article>', '<div><a href="jobs?page=2">Next</a><a href="//cdn.example.com/jobs/engineer-' || CAST(page_id AS VARCHAR(20)) || '.html#apply">Senior &amp; Lead Engineer</a>'
    || '<a href="/vacancies/' || CAST(page_id AS VARCHAR(20)) || '/../accountant" title="Accountant role"></a><a href="mailto:a@b.c">Mail</a><a href="/category/it">IT &amp; Telecom</a><a href="/apply?id=' || CAST(page_id AS VARCHAR(20)) || '&gclid=1">Apply</a></div>'
    || '<form action="/find"><input type="hidden" name="lang" value="en"><input name="kw" placeholder="Job keyword"><input type="search" name="q"></form>'
    || CASE WHEN page_id % 4 = 3 THEN '<p>Location: Colombo, Sri Lanka</p><p>How to apply: send a CV.</p><time class="posted" datetime="2024-01-20"></time>' ELSE '' END
    || CASE WHEN page_id % 9 = 0 THEN '<p>This vacancy has closed.</p>' ELSE '' END
    || '<article>')
  || CASE page_id % 4 WHEN 0 THEN '<script type="application/ld+json">{{{{"@type":"JobPosting","title":"' || {views.pick(views.TITLES, "page_id")} || '","url":"/vacancy/' || CAST(page_id AS VARCHAR(20)) || '","description":"<p>Duties &amp; pay</p>","datePosted":"2024-01-15","validThrough":"' || CASE WHEN page_id % 8 = 0 THEN '2024-01-31' ELSE '2024-02-01' END || '","employmentType":"FULL_TIME","hiringOrganization":{{{{"name":"Acorn Labs"}}}},"jobLocation":{{{{"address":{{{{"addressLocality":"Colombo","addressCountry":"LK"}}}}}}}}}}}}</script>'
     WHEN 1 THEN '<script type="application/ld+json">{{{{"@graph":[{{{{"@type":"WebSite","name":"x"}}}},{{{{"@type":["JobPosting"],"name":"Data Engineer","url":"/vacancy/9' || CAST(page_id AS VARCHAR(20)) || '","jobLocationType":"TELECOMMUTE"}}}}]}}}}</script>'
     WHEN 2 THEN '<script type="application/ld+json">{{{{"@type":"ItemList","itemListElement":[{{{{"@type":"ListItem","item":{{{{"@type":"JobPosting","title":"Nurse","url":"/vacancy/8' || CAST(page_id AS VARCHAR(20)) || '"}}}}}}}},{{{{"@type":"JobPosting","title":"Clerk","sameAs":"/vacancy/7' || CAST(page_id AS VARCHAR(20)) || '"}}}}]}}}}</script><script type="application/ld+json">{{{{bad</script>'
     ELSE '' END AS html
FROM (SELECT *, regexp_extract(url, '^(https?://[^/?#]+)', 1) AS site FROM {{pages}}) p
"""
LANDED = f"landed AS ({LANDED_SQL.replace('{{', '{').replace('}}', '}').replace('{pages}', 'pages')})"
SITE = "regexp_extract(url, '^(https?://[^/?#]+)', 1)"


def landed_pages(spark: SparkSession, sf: str) -> DataFrame:
    return spark.sql(LANDED_SQL, pages=views.table(spark, sf, "pages"))


CLEAN_ENTITIES = (
    "replace(replace(replace(replace({}, '&copy;', '©'), '&middot;', '·'), '&quot;', '\"'), '&amp;', '&')"
)


def clean_sql(col: str) -> str:
    """Readable text for the entities the pages hold."""
    bare = f"regexp_replace(regexp_replace({col}, '(?i)<br\\s*/?>|</p>|</li>', chr(10), 'g'), '<[^>]+>', ' ', 'g')"
    return ck.collapse(CLEAN_ENTITIES.format(bare))


@query("page_text", "F10 F11", f"""
SELECT page_id, {clean_sql('html')} AS body,
  {clean_sql("regexp_extract(html, '(?is)<h1[^>]*>(.*?)</h1>', 1)")} AS heading,
  {ck.collapse(CLEAN_ENTITIES.format("regexp_replace(regexp_replace(html, '(?is)<script.*?>.*?</script>|<style.*?>.*?</style>', ' ', 'g'), '<[^>]+>', ' ', 'g')"))} AS visible
FROM pages
""")
def page_text(spark: SparkSession, sf: str) -> DataFrame:
    html = F.col("html")
    return views.pages(spark, sf).select(
        "page_id", clean_html(html).alias("body"), pages.heading(html).alias("heading"),
        clean_page_text(html).alias("visible"))


@query("page_descriptions", "F12 P22", f"""
WITH b AS (SELECT page_id, html, regexp_replace(html, '(?is)<script\\b.*?</script>|<style\\b.*?</style>|<noscript\\b.*?</noscript>|<svg\\b.*?</svg>|<nav\\b.*?</nav>|<header\\b.*?</header>|<footer\\b.*?</footer>', ' ', 'g') AS bare FROM pages),
d AS (SELECT page_id, html, list_transform(list_concat(regexp_extract_all(bare, '(?is)<article\\b[^>]*>(.*?)</article>', 1),
  CASE WHEN regexp_matches(bare, '(?is)<body\\b[^>]*>.*?</body>') THEN regexp_extract_all(bare, '(?is)<body\\b[^>]*>(.*?)</body>', 1) ELSE [bare] END), lambda x: {clean_sql('x')}) AS ts FROM b),
e AS (SELECT page_id, html, list_reduce(ts, lambda a, x: CASE WHEN length(x) > length(a) THEN x ELSE a END, '') AS description FROM d)
SELECT page_id, description, length(description) >= 60
  AND {ck.contains_any("lower(" + clean_sql('html') + " || ' ' || description)", lex.DETAIL_SIGNALS)} AS evidence FROM e
""")
def page_descriptions(spark: SparkSession, sf: str) -> DataFrame:
    staged = views.pages(spark, sf).withColumn("description", pages.description(F.col("html")))
    return staged.select(
        "page_id", "description",
        pages.has_detail_evidence(F.col("html"), F.col("description")).alias("evidence"))


LINK_ROWS = f"""a AS (
  SELECT page_id, url AS base, {SITE} AS site, unnest(regexp_extract_all(html, '(?is)<a\\b([^>]*)>(.*?)</a>', 1)) AS attrs,
    unnest(regexp_extract_all(html, '(?is)<a\\b([^>]*)>(.*?)</a>', 2)) AS body,
    generate_subscripts(regexp_extract_all(html, '(?is)<a\\b([^>]*)>(.*?)</a>', 1), 1) - 1 AS ordinal FROM landed),
h AS (SELECT *, regexp_extract(attrs, 'href="([^"]*)"', 1) AS href,
   CASE WHEN {clean_sql('body')} <> '' THEN {clean_sql('body')} ELSE regexp_extract(attrs, 'title="([^"]*)"', 1) END AS title FROM a),
u AS (SELECT *, CASE WHEN starts_with(href, 'jobs?') THEN regexp_replace(regexp_replace(base, '[?#].*$', ''), '[^/]*$', '') || href
   WHEN starts_with(href, '//cdn') THEN regexp_extract(base, '^(https?:)', 1) || regexp_replace(href, '#.*$', '')
   WHEN contains(href, '/../') THEN site || '/vacancies/accountant'
   WHEN starts_with(href, '/apply') THEN site || regexp_replace(href, '&gclid=1', '')
   ELSE site || href END AS url FROM h WHERE NOT starts_with(href, 'mailto:') AND title <> ''),
link_rows AS (SELECT page_id, base, ordinal, title, lower(regexp_extract(url, '^(https?://[^/]+)', 1)) || CASE WHEN regexp_extract(url, '^https?://[^/]+(/[^?]*)', 1) = '/' THEN '/'
   ELSE regexp_replace(regexp_replace(regexp_extract(url, '^https?://[^/]+([^?]*)', 1), '/+', '/', 'g'), '/$', '') END || regexp_extract(url, '(\\?.*)$', 1) AS url FROM u)"""


@query("page_links", "S09 F16", f"""
WITH {LANDED}, {LINK_ROWS} SELECT page_id, ordinal, title, url FROM link_rows
""")
def page_links(spark: SparkSession, sf: str) -> DataFrame:
    return links.page_links(landed_pages(spark, sf)).select(
        "page_id", F.col("ordinal").cast("long").alias("ordinal"), "title", "url")


HAS = lambda values, fixed: f"list_has_any({values}, {ck.str_list(fixed)})"
WORDS = "|".join
ROLE_WORD = ck.lit(rf"\b(?:{WORDS(lex.ROLE_TITLE_WORDS)})s?\b")
FLAGGED = f"""{LINK_ROWS},
parts AS (SELECT *, regexp_extract(url, '^[a-zA-Z]+://[^/?#]*([^?#]*)', 1) AS path, regexp_extract(url, '\\?([^#]*)', 1) AS q,
  {ck.collapse('lower(title)')} AS label, trim(regexp_replace(lower(title), '[^a-z0-9&/+]+', ' ', 'g')) AS plain FROM link_rows),
cut AS (SELECT *, list_filter(string_split(lower(path), '/'), lambda s: s <> '') AS segs, string_split(lower(path), '/')[-1] AS suffix,
  list_transform(list_filter(string_split(q, '&'), lambda s: s <> ''), lambda s: lower(split_part(s, '=', 1))) AS keys,
  regexp_replace(label, '^[ \\-|:]+|[ \\-|:]+$', '', 'g') AS bare,
  label IN {ck.in_list(lex.PAGER_LABELS)} OR regexp_matches(label, '^(?:page\\s*)?\\d+$') AS pager,
  plain <> '' AND NOT regexp_matches(plain, {ROLE_WORD}) AND (contains(plain, '&') OR contains(plain, '/')
    OR regexp_matches(plain, {ck.lit(rf"\b(?:{WORDS(lex.JOB_CATEGORY_TERMS)})\b")})) AS category FROM parts),
shaped AS (SELECT *, coalesce(segs[-1], '') AS leaf, regexp_replace(replace(coalesce(segs[-1], ''), '_', '-'), '\\.php$', '') AS short,
  bare IN {ck.in_list(lex.GENERIC_LISTING_TITLES)} OR {' OR '.join(f"starts_with(bare, {ck.lit(w)})" for w in lex.GENERIC_LISTING_PREFIXES)}
    OR regexp_matches(label, '\\b(?:jobs|vacancies|openings)\\s+in\\b') OR {ck.contains_any('label', lex.LISTING_HEADING_PHRASES)}
    OR regexp_matches(label, '\\b(?:all|latest|current|available)\\s+(?:jobs|vacancies|openings)\\b') AS heading FROM cut),
ruled AS (SELECT *, regexp_replace(path, '/+$', '') = '' AND q = '' AS is_home,
  CASE WHEN {HAS('keys', lex.DETAIL_ID_KEYS)} THEN FALSE WHEN {HAS('keys', lex.LISTING_KEYS)} THEN TRUE WHEN len(segs) = 0 THEN FALSE
    ELSE leaf IN {ck.in_list(lex.LISTING_LEAVES)} OR array_to_string(segs, '/') = 'post/job/vacancy' OR {HAS('segs', lex.LISTING_SEGMENTS)}
      OR (len(segs) = 1 AND (ends_with(short, '-jobs') OR contains(short, '-jobs-in-') OR starts_with(short, 'jobs-in-') OR starts_with(short, 'government-job-vacanc')))
      OR list_has_any(segs[:-2], ['page', 'paged']) END AS is_listing,
  {HAS("list_transform(keys, lambda k: regexp_replace(k, '[\\[\\]]+$', ''))", lex.PAGING_KEYS)} OR pager
    OR len(list_filter(segs, lambda s, i: s IN ('page', 'paged') AND regexp_matches(coalesce(segs[i + 1], ''), '^[0-9]+$'))) > 0 AS is_pager,
  (contains(suffix, '.') AND NOT regexp_matches(suffix, {ck.lit("(?:" + WORDS(w.replace(".", chr(92) + ".") for w in lex.DOCUMENT_SUFFIXES) + ")$")})) AS other_file,
  {ck.contains_any("lower(path || ' ' || q || ' ' || title)", lex.JOB_LINK_WORDS)} OR regexp_matches(lower(title), {ROLE_WORD})
    OR {HAS('keys', ('id', *lex.DETAIL_ID_KEYS))} AS named FROM shaped),
flagged AS (SELECT page_id, ordinal, title, url, is_home, is_listing, is_pager,
  NOT is_home AND (is_listing OR heading OR (len(segs) = 2 AND segs[1] IN {ck.in_list(lex.LISTING_ROOTS)} AND category) OR pager
    OR {ck.contains_any('label', lex.NAVIGATION_PHRASES)}) AS is_navigation,
  NOT is_home AND NOT is_listing AND NOT heading AND NOT {HAS('segs', lex.NON_JOB_SEGMENTS)} AND NOT other_file AND named AS is_detail FROM ruled),
classed AS (SELECT *, CASE WHEN is_detail THEN 'detail' WHEN is_navigation THEN 'navigation' ELSE 'other' END AS link_class FROM flagged)"""


@query("link_classes", "P20 P21 P18 S13", f"""
WITH {LANDED}, {FLAGGED} SELECT * FROM classed
""")
def link_classes(spark: SparkSession, sf: str) -> DataFrame:
    flagged = links.classified(links.page_links(landed_pages(spark, sf))).drop("base")
    return flagged.withColumn("ordinal", F.col("ordinal").cast("long"))


@query("link_class_counts", "P20 P21", f"""
WITH {LANDED}, {FLAGGED} SELECT link_class, title, count(*) AS links FROM classed GROUP BY ALL
""")
def link_class_counts(spark: SparkSession, sf: str) -> DataFrame:
    flagged = links.classified(links.page_links(landed_pages(spark, sf)))
    return flagged.groupBy("link_class", "title").agg(F.count(F.lit(1)).alias("links"))


@query("merged_links", "S10", f"""
WITH {LANDED}, {LINK_ROWS},
both_kinds AS (SELECT page_id, url, 0 AS origin, ordinal, 'Rendered ' || title AS title FROM link_rows WHERE title <> 'Next'
  UNION ALL SELECT page_id, url, 1, ordinal, title FROM link_rows)
SELECT page_id, url, arg_min(title, (origin, ordinal)) AS title FROM both_kinds GROUP BY ALL
""")
def merged_links(spark: SparkSession, sf: str) -> DataFrame:
    static = links.page_links(landed_pages(spark, sf)).select("page_id", "ordinal", "title", "url")
    rendered = static.where(F.col("title") != "Next").withColumn("title", F.concat(F.lit("Rendered "), "title"))
    return links.merged_links(rendered, static)


@query("search_forms", "S14 P25", f"""
WITH {LANDED}
SELECT page_id, lower({SITE}) || '/find?lang=en&q=data+engineer' AS search_url FROM landed
""")
def search_forms(spark: SparkSession, sf: str) -> DataFrame:
    return links.search_forms(landed_pages(spark, sf), "data engineer")


@query("listing_pages", "S13", f"""
WITH p AS (SELECT page_id, lower({SITE}) AS site FROM pages)
SELECT page_id, site || '/jobs?page=' || n AS url FROM p, range(2, 5) r(n) WHERE page_id % 3 > 0
""")
def listing_pages(spark: SparkSession, sf: str) -> DataFrame:
    """Pages that are listings, with a pager: own and other paths, the first page and words for a number."""
    pager = "".join(f'<a href="{h}">{t}</a>' for h, t in (
        ("jobs?page=1", "1"), ("jobs?page=2", "2"), ("/jobs/?page=3", "3"), ("/jobs?page=4&utm_source=x", "4"), ("/jobs?page=two", "two"),
        ("/jobs/senior?page=5", "5"), ("https://other.test/jobs?page=6", "6")))
    site = F.regexp_extract("url", "^(https?://[^/?#]+)", 1)
    listings = views.pages(spark, sf).select(
        "page_id", F.concat(site, F.when(F.col("page_id") % 3 == 0, "/careers").otherwise(F.lit("/jobs"))).alias("url"),
        F.concat(F.lit(pager), "html").alias("html"))
    return links.listing_pages(links.page_links(listings), "page")


@query("listing_roots", "S13", f"""
WITH {LANDED} SELECT page_id, lower({SITE}) || '/category/it' AS url FROM landed
""")
def listing_roots(spark: SparkSession, sf: str) -> DataFrame:
    return links.listing_roots(links.page_links(landed_pages(spark, sf)), "^/category/[^/]+$")


PER_ORIGIN = 2
CATEGORY_TERMS = " ".join(
    f"|| CASE WHEN list_has_any(words, {ck.str_list(markers)}) THEN {ck.str_list(terms)} ELSE [] END"
    for markers, terms in lex.NAVIGATION_FAMILIES)
SUITED = f"""{LINK_ROWS},
listed AS (SELECT page_id, ordinal, url, regexp_replace(regexp_replace(lower(regexp_extract(base, '^(https?://[^/?#]+)', 1)), '^https?://', ''), '^www\\.', '') AS origin,
    CASE title WHEN 'Next' THEN 'navigation' WHEN 'IT & Telecom' THEN 'navigation' ELSE 'detail' END AS link_class,
    CASE title WHEN 'Next' THEN 2 WHEN 'IT & Telecom' THEN 3 ELSE 1 END AS turn, CASE title WHEN 'Apply' THEN 1 ELSE 0 END AS plain,
    translate(title || ' ' || url, '-_', '  ') AS shown,
    ' ' || regexp_replace(lower(url_decode(regexp_replace(regexp_extract(url, '^https?://[^/]+(.*)$', 1), '\\?', ' ') || ' ' || title)), '[^a-z0-9+#]+', ' ', 'g') || ' ' AS words_of
  FROM link_rows WHERE title IN ('Next', 'Senior & Lead Engineer', 'Accountant role', 'IT & Telecom', 'Apply')),
gates AS (SELECT DISTINCT target_position, titles_text, list_filter(string_split(titles_text, '|'), lambda t: length(t) > 3) AS subs FROM people),
shown AS (SELECT DISTINCT shown FROM listed WHERE link_class = 'detail'),
passed AS (SELECT target_position, titles_text, shown FROM gates CROSS JOIN shown
  WHERE CASE WHEN target_position <> '' THEN {ck.role_gate('shown', 'target_position')}
    ELSE len(subs) = 0 OR len(list_filter(subs, lambda s: contains(lower(shown), lower(s)))) > 0 END),
vocabularies AS (SELECT target_position, titles_text, skills_text, words {CATEGORY_TERMS} AS terms FROM (
  SELECT DISTINCT target_position, titles_text, skills_text, list_filter(regexp_extract_all(lower(target_position || ' ' || titles_text || ' ' || skills_text), '[a-z0-9+#]+'),
    lambda w: length(w) > 2) AS words FROM people)),
named AS (SELECT DISTINCT words_of FROM listed WHERE link_class = 'navigation'),
told AS (SELECT target_position, titles_text, skills_text, words_of FROM vocabularies CROSS JOIN named
  WHERE len(list_filter(terms, lambda t: contains(words_of, ' ' || t || ' '))) > 0),
placed AS (SELECT v.target_position, v.titles_text, v.skills_text, l.*, p.shown IS NOT NULL OR t.words_of IS NOT NULL AS suits
  FROM vocabularies v CROSS JOIN listed l
  LEFT JOIN passed p ON l.link_class = 'detail' AND p.shown = l.shown AND p.target_position = v.target_position AND p.titles_text = v.titles_text
  LEFT JOIN told t ON l.link_class = 'navigation' AND t.words_of = l.words_of AND t.target_position = v.target_position
    AND t.titles_text = v.titles_text AND t.skills_text = v.skills_text),
ranked AS (SELECT *, bool_or(suits) OVER (PARTITION BY target_position, titles_text, skills_text, origin) AS reached,
  row_number() OVER (PARTITION BY target_position, titles_text, skills_text, origin
    ORDER BY link_class, CASE WHEN suits THEN 0 ELSE turn END, plain, page_id, ordinal) AS origin_rank FROM placed)"""


@query("candidate_priority", "W13 F25 P13", f"""
WITH {LANDED}, {views.candidate_cte()}, {SUITED}
SELECT candidate_id, origin, origin_rank, page_id, url, suits
FROM people JOIN ranked USING (target_position, titles_text, skills_text) WHERE reached AND origin_rank <= {PER_ORIGIN}
""")
def candidate_priority(spark: SparkSession, sf: str) -> DataFrame:
    """The best links of every portal for every candidate whom one of them suits."""
    found = links.classified(links.page_links(landed_pages(spark, sf)))
    best = navigation.candidate_links(views.candidates(spark, sf), found, PER_ORIGIN)
    return best.select("candidate_id", "origin", F.col("origin_rank").cast("long").alias("origin_rank"), "page_id", "url", "suits")


@query("candidate_searches", "S14 F25 W13", f"""
WITH {LANDED}, {views.candidate_cte()}, {SUITED},
reached AS (SELECT DISTINCT target_position, titles_text, skills_text, origin FROM ranked WHERE suits),
forms AS (SELECT DISTINCT regexp_replace(regexp_replace(lower({SITE}), '^https?://', ''), '^www\\.', '') AS origin, lower({SITE}) AS site FROM landed)
SELECT candidate_id, origin, site || '/find?lang=en&q=' || replace(replace(trim(target_position), '+', '%2B'), ' ', '+') AS search_url
FROM people JOIN reached USING (target_position, titles_text, skills_text) JOIN forms USING (origin) WHERE target_position <> ''
""")
def candidate_searches(spark: SparkSession, sf: str) -> DataFrame:
    """The search forms of the portals that suit a candidate, filled in with the candidate's own target."""
    landed = landed_pages(spark, sf)
    found = links.classified(links.page_links(landed))
    return navigation.candidate_searches(views.candidates(spark, sf), found, landed)


@query("structured_postings", "S08 S20 F13", f"""
WITH {LANDED}, p AS (SELECT page_id, lower({SITE}) AS site, page_id % 4 AS kind, CAST(page_id AS VARCHAR) AS id FROM pages),
r AS (
  SELECT page_id, {views.pick(views.TITLES, "page_id")} AS title, site || '/vacancy/' || id AS item_url FROM p WHERE kind = 0
  UNION ALL SELECT page_id, 'Data Engineer', site || '/vacancy/9' || id FROM p WHERE kind = 1
  UNION ALL SELECT page_id, 'Nurse', site || '/vacancy/8' || id FROM p WHERE kind = 2
  UNION ALL SELECT page_id, 'Clerk', site || '/vacancy/7' || id FROM p WHERE kind = 2)
SELECT * FROM r
""")
def structured_postings(spark: SparkSession, sf: str) -> DataFrame:
    found = postings.structured_postings(landed_pages(spark, sf))
    return postings.posting_links(found, 50).select("page_id", "title", F.col("url").alias("item_url"))


PAGE_VACANCIES_SQL = f"""
WITH {LANDED}, p AS (SELECT page_id, url, html, page_id % 4 AS kind FROM landed
  WHERE NOT regexp_matches(url, '[?&]page=') AND NOT regexp_matches(url, '^https?://[^/?#]+/?(#.*)?$')),
h AS (SELECT *, {clean_sql("regexp_extract(html, '(?is)<h1[^>]*>(.*?)</h1>', 1)")} AS heading,
  replace(lower(regexp_extract(url, '^https?://([^/?#]+)', 1)), 'www.', '') AS host FROM p)
SELECT page_id, {views.pick(views.TITLES, "page_id")} AS title, 'Acorn Labs' AS company, 'Colombo, LK' AS location,
  '2024-01-15' AS published_raw, true AS structured FROM h WHERE kind = 0 AND page_id % 8 <> 0
UNION ALL SELECT page_id, 'Data Engineer', host, 'Remote', '', true FROM h WHERE kind = 1
UNION ALL SELECT page_id, heading, CASE WHEN contains(lower(heading), ' at ') THEN trim(string_split(heading, ' at ')[-1]) ELSE host END,
  'Sri Lanka', '', false FROM h WHERE kind = 3 AND heading <> ''
"""


@query("page_vacancies", "S15 P08 P09 F13", PAGE_VACANCIES_SQL)
@query("page_vacancies_whole", "S15 P08 P09 F13", PAGE_VACANCIES_SQL)
def page_vacancies_whole(spark: SparkSession, sf: str) -> DataFrame:
    """All that the operator returns, pages without structured data by heading and evidence included."""
    rows = postings.page_vacancies(landed_pages(spark, sf), "Portal", "sri lanka", views.NOW)
    return rows.select("page_id", "title", "company", "location", "published_raw",
                       F.col("item_location").isNotNull().alias("structured"))


@query("validated_hits", "S17 J15 F14 P23", f"""
WITH {LANDED}, u AS (SELECT page_id, html, page_id % 4 AS kind, page_id % 9 = 0 AS shut, regexp_matches(url, '[?#]') AS asked, regexp_replace(regexp_replace(regexp_replace(url, '#.*$', ''), '[?&]utm_[a-z]+=[^&]*', '', 'g'), '/$', '') AS address FROM landed),
p AS (SELECT * FROM u WHERE NOT regexp_matches(address, '[?&]page=') AND NOT regexp_matches(address, '^https?://[^/?#]+/?$')),
h AS (SELECT *, {clean_sql("regexp_extract(html, '(?is)<h1[^>]*>(.*?)</h1>', 1)")} AS heading FROM p),
first_hit AS (SELECT min(page_id) AS seq, address FROM h WHERE asked GROUP BY 2),
first_page AS (SELECT min(page_id) AS page_id, address FROM h WHERE NOT shut GROUP BY 2),
v AS (SELECT h.page_id, h.address, CASE WHEN kind = 0 THEN {views.pick(views.TITLES, "h.page_id")} ELSE heading END AS title,
    CASE WHEN kind = 0 THEN 'Colombo, LK' ELSE 'Colombo, Sri Lanka' END AS location,
    CASE WHEN kind = 0 THEN '2024-01-15' ELSE '2024-01-20' END AS published_raw
  FROM h JOIN first_page USING (page_id) WHERE (kind = 0 AND h.page_id % 8 <> 0) OR (kind = 3 AND heading <> ''))
SELECT page_id, 'Google Custom Search' AS source, lower(address) AS source_id, title, location, published_raw FROM v JOIN first_hit USING (address)
""")
def validated_hits(spark: SparkSession, sf: str) -> DataFrame:
    """Pages found by search under an address with a tracking key; one without a query becomes another address."""
    landed = landed_pages(spark, sf)
    hits = landed.select(
        F.lit("Google Custom Search").alias("source"), F.col("page_id").alias("seq"),
        F.concat("url", F.lit("&utm_medium=cpc")).alias("url"))
    return postings.validated_hits(
        postings.search_candidates(hits), landed, "sri lanka", views.NOW).select(
        "page_id", "source", "source_id", "title", "location", "published_raw")


@query("page_evidence", "F14 P08 P23", f"""
WITH {LANDED}
SELECT page_id, CASE WHEN page_id % 4 = 3 THEN 'Colombo, Sri Lanka' ELSE '' END AS location,
  CASE WHEN page_id % 4 = 3 THEN '2024-01-20' ELSE '' END AS published,
  page_id % 9 = 0 AS closed,
  CASE page_id % 4 WHEN 3 THEN 'Sri Lanka' WHEN 0 THEN 'Colombo' ELSE '' END AS place_label
FROM landed
""")
def page_evidence(spark: SparkSession, sf: str) -> DataFrame:
    html = F.col("html")
    staged = landed_pages(spark, sf).withColumn("lines", pages.visible_lines(html))
    return staged.select(
        "page_id", pages.location(html, F.col("lines")).alias("location"),
        pages.published(html).alias("published"), filters.page_closed(html).alias("closed"),
        geo.evidence_place(clean_html(html), F.lit("LK")).alias("place_label"))


@query("returned_pages", "J18", f"""
WITH w AS (SELECT page_id AS request_id, lower({SITE}) AS site, url FROM pages),
h AS (SELECT regexp_replace(site, '^https?://(www\\.)?', '') AS host, min(request_id) AS request_id FROM w WHERE request_id % 2 = 0 GROUP BY 1),
r AS (SELECT page_id, regexp_replace(lower({SITE}), '^https?://(www\\.)?', '') AS host FROM pages)
SELECT r.page_id, h.request_id FROM r JOIN h USING (host)
""")
def returned_pages(spark: SparkSession, sf: str) -> DataFrame:
    base = views.pages(spark, sf)
    asked = base.where("page_id % 2 = 0").select(
        F.col("page_id").alias("request_id"),
        F.concat(F.regexp_extract("url", "^(https?://[^/?#]+)", 1), F.lit("/asked/"), F.col("page_id"))
        .alias("url"))
    return links.returned_pages(asked, base)


@query("url_helpers", "F17 F18", """
SELECT page_id, regexp_replace(regexp_extract(url, '^https?://([^/?#]+)', 1), '^www\\.', '') AS site,
  lower(split_part(url, '?', 1)) AS bare, 'https://www.hire.lk/jobs?q=data+engineer' AS portal,
  'https://www.topjobs.lk/vacancy?ac=DEFZZZ&ec=E+1&index=' || CAST(page_id AS VARCHAR) || '&jc=J%26' || CAST(page_id AS VARCHAR)
    || '&pg=applicant%2FvacancyDetails.jsp&rid=' || CAST(page_id AS VARCHAR) AS advert,
  url AS unwrapped, 'Senior Cook ' || CAST(page_id AS VARCHAR) AS slug_title
FROM pages
""")
def url_helpers(spark: SparkSession, sf: str) -> DataFrame:
    url, pid = F.col("url"), F.col("page_id").cast("string")
    wrapped = F.concat(F.lit("//duckduckgo.com/l/?uddg="), urls.encode_part(url), F.lit("&rut=1"))
    return views.pages(spark, sf).select(
        "page_id", urls.site_host(url).alias("site"), urls.without_query(url).alias("bare"),
        urls.portal_search_url(F.lit("https://hire.lk/jobs"), F.lit("data engineer")).alias("portal"),
        urls.advert_url(F.lit("DEFZZZ"), F.lit("E 1"), F.concat(F.lit("J&"), pid), pid).alias("advert"),
        urls.result_target(wrapped).alias("unwrapped"),
        urls.title_from_slug(F.concat(F.lit("https://x.test/senior-cook-"), pid, F.lit("/")))
        .alias("slug_title"))


@query("hosted_board", "S07", f"""
SELECT page_id, {SITE} || '/jobs/cook-' || page_id || '/' AS url, 'Cook & Co' AS title FROM pages
UNION ALL SELECT page_id, 'https://board.test/jobs/clerk/', 'Clerk' FROM pages
""")
def hosted_board(spark: SparkSession, sf: str) -> DataFrame:
    """Pages with links of a hosted board in front of what they hold; an address keeps its first title."""
    own = F.concat(F.lit('<a href="/jobs/cook-'), "page_id", F.lit('/"><b>Cook &amp; Co</b></a><a href="/jobs/cook-'), "page_id", F.lit(
        '/">Apply</a><a class="x" href="https://board.test/jobs/clerk/" id="1">Clerk</a><a href="/jobs/">All</a>'))
    return cards.board_links(views.pages(spark, sf).withColumn("html", F.concat(own, "html")))
