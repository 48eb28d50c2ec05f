"""Queries over candidates and vacancies: filters, gate, score, rank, route."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from talentmesh import lexicons as lex
from talentmesh.functions import geo, scoring
from talentmesh.functions.text import mask_to_array, skill_mask, title_mask
from talentmesh.operators import filters, matching, roles
from talentmesh.plans import checks as ck
from talentmesh.plans import views
from talentmesh.plans.clean_queries import SAME_URL
from talentmesh.plans.registry import query

JOBS, PEOPLE = views.vacancy_cte(), views.candidate_cte()


def text_list(c: str) -> F.Column:
    return F.array_join(c, "|")


@query("top_matches", "P01 P06 J01 J02 J03 F01 F02 F03 F04 W04 P27 P28 F24", f"""
WITH {JOBS}, {PEOPLE}, {ck.scored_pairs()},
ranked AS (
  SELECT *, row_number() OVER (PARTITION BY candidate_id ORDER BY score DESC, seq) AS rnk
  FROM routed
  WHERE score >= 20 AND (years IS NULL OR ((req IS NULL OR req <= years) AND NOT under))
)
SELECT candidate_id, seq, score, array_to_string(shared, '|') AS matched_skills,
       array_to_string(named, '|') AS matched_titles, array_to_string(concerns, '|') AS concerns,
       req AS required_years, route, rnk AS rank
FROM ranked WHERE rnk <= 10
""")
def top_matches(spark: SparkSession, sf: str) -> DataFrame:
    best = matching.top_matches(views.candidates(spark, sf), views.vacancies(spark, sf), k=10)
    return best.select(
        "candidate_id", "seq", "score", text_list("matched_skills").alias("matched_skills"),
        text_list("matched_title_terms").alias("matched_titles"),
        text_list("concerns").alias("concerns"), "required_years", "route",
        F.col("rank").cast("long").alias("rank"),
    )


@query("route_counts", "P28 A10 J01", f"""
WITH {JOBS}, {PEOPLE}, {ck.scored_pairs()}
SELECT p.candidate_id, count(r.seq) AS related,
       count(r.seq) FILTER (WHERE route = 'accepted') AS accepted,
       count(r.seq) FILTER (WHERE route = 'rejected') AS rejected,
       count(r.seq) FILTER (WHERE route = 'ambiguous') AS ambiguous, max(score) AS best_score
FROM people p LEFT JOIN routed r ON r.candidate_id = p.candidate_id AND r.score >= 20
GROUP BY p.candidate_id
""")
def route_counts(spark: SparkSession, sf: str) -> DataFrame:
    return matching.route_counts(views.candidates(spark, sf), views.vacancies(spark, sf), 20.0)


@query("related_matches", "J02 J03 F01 P27", f"""
WITH {JOBS}, {PEOPLE}, {ck.scored_pairs()}
SELECT candidate_id, seq, score, route, len(shared) AS n_skills, len(concerns) AS n_concerns
FROM routed
""")
def related_matches(spark: SparkSession, sf: str) -> DataFrame:
    pairs = matching.match_pairs(
        views.candidates(spark, sf), views.vacancies(spark, sf), minimum_score=None
    )
    return pairs.select(
        "candidate_id", "seq", "score", "route", "n_skills",
        F.size("concerns").cast("long").alias("n_concerns"),
    )


_COUNTRY_CASES = (("lk", "Sri Lanka", False), ("lk_open", "LK", True), ("uk", "uk", False),
                  ("de_open", "Germany", True), ("us", "USA", False))


@query("country_compatible", "P01 P02 P03 F19", f"""
WITH {JOBS}, spots AS (
  SELECT *, {ck.strip('lower(location)')} AS place, {ck.country('country_hint')} AS own FROM jobs
)
SELECT seq, {', '.join(
    ck.country_ok('place', 'own', ck.country(ck.lit(c)), 'TRUE' if g else 'FALSE') + f' AS {n}'
    for n, c, g in _COUNTRY_CASES)}
FROM spots
""")
def country_compatible(spark: SparkSession, sf: str) -> DataFrame:
    jobs = views.vacancies(spark, sf).select("seq", "location", "country_hint")
    for name, country, worldwide in _COUNTRY_CASES:
        jobs = filters.with_country_flag(jobs, country, worldwide, name)
    return jobs.select("seq", *[n for n, _, _ in _COUNTRY_CASES])


@query("fresh_vacancies", "P04 P05 F21", f"""
WITH {JOBS}, dated AS (SELECT *, {ck.POSTED} AS published FROM jobs)
SELECT seq, strftime(published, '%Y-%m-%d %H:%M:%S') AS published,
       {ck.fresh('published', 30, views.NOW)} AS fresh_30,
       {ck.fresh('published', 7, views.NOW)} AS fresh_7
FROM dated
""")
def fresh_vacancies(spark: SparkSession, sf: str) -> DataFrame:
    jobs = filters.with_published(views.vacancies(spark, sf))
    jobs = filters.with_fresh_flag(jobs, views.NOW, 30, "fresh_30")
    jobs = filters.with_fresh_flag(jobs, views.NOW, 7, "fresh_7")
    return jobs.select(
        "seq", F.date_format("published_ts", "yyyy-MM-dd HH:mm:ss").alias("published"),
        "fresh_30", "fresh_7",
    )


@query("filter_losses", "P01 P04 A10", f"""
WITH {JOBS}, dated AS (
  SELECT *, {ck.POSTED} AS published, {ck.strip('lower(location)')} AS place,
         {ck.country('country_hint')} AS own FROM jobs
), flagged AS (
  SELECT source, {ck.country_ok('place', 'own', "'sri lanka'", 'TRUE')} AS country_ok,
         {ck.fresh('published', 30, views.NOW)} AS fresh_ok FROM dated
)
SELECT source, count(*) AS discovered, count(*) FILTER (WHERE country_ok) AS in_country,
       count(*) FILTER (WHERE country_ok AND fresh_ok) AS open_rows
FROM flagged GROUP BY source
""")
def filter_losses(spark: SparkSession, sf: str) -> DataFrame:
    jobs = filters.with_country_flag(views.vacancies(spark, sf), "Sri Lanka", True)
    jobs = filters.with_fresh_flag(jobs, views.NOW, 30)
    return jobs.groupBy("source").agg(
        F.count(F.lit(1)).alias("discovered"),
        F.count_if("country_ok").alias("in_country"),
        F.count_if(F.col("country_ok") & F.col("fresh_ok")).alias("open_rows"),
    )


RUN = f"""{views.vacancy_cte('raw')},
jobs AS (SELECT * EXCLUDE (nth) FROM (SELECT *, row_number() OVER (PARTITION BY lower(source),
  CASE WHEN source_id <> '' THEN source_id ELSE lower(split_part(url, '?', 1)) END, lower(title), lower(company) ORDER BY seq) AS nth FROM raw) WHERE nth = 1),
{SAME_URL},
dated AS (SELECT *, {ck.POSTED} AS published FROM unique_urls),
stamped AS (SELECT * EXCLUDE (seq, rn, address, rich1, rich2, first_seq), first_seq AS seq,
  {ck.strip('lower(location)')} AS spot, {ck.country('country_hint')} AS filed FROM dated),
flagged AS (SELECT *, {ck.fresh('published', 30, views.NOW)} AS fresh_ok FROM stamped),
open_jobs AS (SELECT * EXCLUDE (published, spot, filed, fresh_ok) FROM flagged WHERE fresh_ok),
{PEOPLE}"""


@query("matching_run", "A10 A04 P01 P04 W01 W02 J01 P28", f"""
WITH {RUN}, {ck.scored_pairs('open_jobs')},
counted AS (SELECT spot, filed, count(*) AS n, count(*) FILTER (WHERE fresh_ok) AS n_fresh FROM flagged GROUP BY 1, 2),
zone_counts AS (SELECT wanted, allow, sum(n) FILTER (WHERE ok) AS in_country, sum(n_fresh) FILTER (WHERE ok) AS open_jobs FROM (
  SELECT *, {ck.country_ok('spot', 'filed', 'wanted', 'allow')} AS ok FROM counted CROSS JOIN zones) GROUP BY 1, 2),
told AS (SELECT candidate_id, CASE WHEN route = 'accepted' AND NOT (years IS NULL OR ((req IS NULL OR req <= years) AND NOT under)) THEN 'rejected'
  ELSE route END AS route FROM routed WHERE score >= 20)
SELECT c.candidate_id, (SELECT count(*) FROM dated) AS jobs_fetched, CAST(coalesce(any_value(in_country), 0) AS BIGINT) AS in_country,
  CAST(coalesce(any_value(open_jobs), 0) AS BIGINT) AS open_jobs, count(t.route) AS related_jobs,
  count(*) FILTER (WHERE route = 'accepted') AS matches_written, count(*) FILTER (WHERE route = 'rejected') AS rejected_jobs,
  count(*) FILTER (WHERE route = 'ambiguous') AS manual_review_jobs, TRUE AS complete
FROM flags c LEFT JOIN zone_counts z ON z.wanted = c.wanted AND z.allow = c.allow_global_remote
LEFT JOIN told t ON t.candidate_id = c.candidate_id GROUP BY c.candidate_id
""")
def matching_run(spark: SparkSession, sf: str) -> DataFrame:
    """The whole run, from raw vacancies to the counts of its summary."""
    return matching.run_summary(views.candidates(spark, sf), views.vacancies(spark, sf), views.NOW)


@query("required_years", "F02 A09 P07", f"""
WITH {JOBS}
SELECT seq, {ck.required_years('title', 'description')} AS required_years,
       regexp_matches(lower(title), {ck.lit(lex.UNDERLEVEL_PATTERN)}) AS entry_level
FROM jobs
""")
def required_years(spark: SparkSession, sf: str) -> DataFrame:
    return views.vacancies(spark, sf).select(
        "seq",
        scoring.required_years(F.col("title"), F.col("description")).alias("required_years"),
        scoring.entry_level(F.col("title")).alias("entry_level"),
    )


@query("vacancy_terms", "F05 J02 J03", f"""
WITH {JOBS}, {ck.vacancy_features()}
SELECT seq, array_to_string(skills, '|') AS skills, array_to_string(titles, '|') AS titles
FROM feats
""")
def vacancy_terms(spark: SparkSession, sf: str) -> DataFrame:
    hay = F.lower(F.concat_ws(" ", "title", "description"))
    return views.vacancies(spark, sf).select(
        "seq",
        F.array_join(mask_to_array(skill_mask(hay), lex.SKILLS), "|").alias("skills"),
        F.array_join(mask_to_array(title_mask(F.lower("title")), lex.TITLE_TERMS), "|")
        .alias("titles"),
    )


@query("role_gate", "J01 P12 F20", f"""
WITH {JOBS}, {PEOPLE}, t AS (SELECT title, count(*) AS vacancies FROM jobs GROUP BY title),
r AS (SELECT target_position AS role, count(*) AS candidates FROM people GROUP BY 1)
SELECT role, title, candidates, vacancies FROM r CROSS JOIN t WHERE {ck.role_gate('title', 'role')}
""")
def role_gate(spark: SparkSession, sf: str) -> DataFrame:
    titles = views.vacancies(spark, sf).groupBy("title").agg(F.count(F.lit(1)).alias("vacancies"))
    targets = views.candidates(spark, sf).groupBy(F.col("target_position").alias("role")).agg(
        F.count(F.lit(1)).alias("candidates"))
    pairs = roles.role_titles(targets, titles)
    return pairs.join(targets, "role").join(titles, "title").select(
        "role", "title", "candidates", "vacancies")


@query("portal_gate", "P13 F24", f"""
WITH {JOBS}, {PEOPLE}, p AS (
  SELECT DISTINCT target_position, titles_text,
    list_filter(string_split(titles_text, '|'), lambda t: length(t) > 3) AS subs FROM people),
t AS (SELECT DISTINCT title FROM jobs),
m AS (
  SELECT p.*, t.title FROM p CROSS JOIN t
  WHERE CASE WHEN target_position <> '' THEN {ck.role_gate('title', 'target_position')}
        ELSE len(subs) = 0 OR len(list_filter(subs, lambda s: contains(lower(title), lower(s)))) > 0 END
)
SELECT target_position, titles_text AS likely_titles, count(*) AS titles FROM m GROUP BY 1, 2
""")
def portal_gate(spark: SparkSession, sf: str) -> DataFrame:
    people = views.candidates(spark, sf).select("target_position", "likely_titles").distinct()
    titles = views.vacancies(spark, sf).select("title").distinct()
    return matching.portal_reach(people, titles).groupBy(
        "target_position", F.array_join("likely_titles", "|").alias("likely_titles")
    ).agg(F.count(F.lit(1)).alias("titles"))


@query("title_alignment", "F03 F04", f"""
WITH {JOBS}, {PEOPLE}, r AS (SELECT DISTINCT target_position AS role FROM people),
t AS (SELECT DISTINCT title, lower(title) AS low FROM jobs)
SELECT role, title, CAST({ck.target_alignment('role', 'low')} AS DOUBLE) AS alignment,
       CAST({ck.ai_alignment('low')} AS DOUBLE) AS ai_fit
FROM r CROSS JOIN t WHERE {ck.role_gate('low', 'role')} AND role <> ''
""")
def title_alignment(spark: SparkSession, sf: str) -> DataFrame:
    titles = views.vacancies(spark, sf).select("title").distinct()
    targets = views.candidates(spark, sf).where("target_position <> ''").select(
        F.col("target_position").alias("role"))
    low = F.lower("title")
    return (
        roles.role_titles(targets, titles)
        .withColumn("tokens", scoring.target_tokens(F.col("role")))
        .select("role", "title",
                scoring.target_alignment(F.col("role"), F.col("tokens"), low).alias("alignment"),
                scoring.ai_alignment(F.col("title")).alias("ai_fit"))
    )


@query("remote_places", "P14 P11 F19", f"""
WITH {JOBS}, p AS (SELECT location, country_hint, count(*) AS vacancies FROM jobs GROUP BY 1, 2)
SELECT location, country_hint, vacancies,
  {ck.contains_any('lower(location)', lex.REMOTE_BROAD_TERMS + lex.REMOTE_ASIA_TERMS + ('sri lanka',))} AS suits_lk,
  {ck.contains_any('lower(location)', lex.REMOTE_BROAD_TERMS + ('europe', 'germany'))} AS suits_de,
  contains(lower(location), 'foreign job') OR list_contains(
    list_transform(regexp_split_to_array(lower(location), '[,;|]'), lambda s: trim(s)), 'international')
    AS foreign_job,
  CASE {ck.country('country_hint')} {' '.join(
      f"WHEN {ck.lit(k)} THEN {ck.lit(v)}" for k, v in lex.AD_API_CODES.items())} END AS api_code
FROM p
""")
def remote_places(spark: SparkSession, sf: str) -> DataFrame:
    spots = views.vacancies(spark, sf).groupBy("location", "country_hint").agg(
        F.count(F.lit(1)).alias("vacancies"))
    place = F.col("location")
    return spots.select(
        "location", "country_hint", "vacancies",
        geo.remote_suits(place, F.lit("sri lanka")).alias("suits_lk"),
        geo.remote_suits(place, F.lit("germany")).alias("suits_de"),
        geo.foreign_location(place).alias("foreign_job"),
        geo.ad_api_code(F.col("country_hint")).alias("api_code"),
    )


@query("text_predicates", "P15 P16 P17 P18 P19", f"""
WITH {JOBS}, h AS (SELECT seq, title, lower(title || ' ' || description) AS hay,
  ' ' || lower(title || ' ' || description) || ' ' AS pad FROM jobs),
a AS (SELECT *, NOT {ck.contains_any('pad', lex.OUTSIDE_TERMS)} AND (
   {ck.contains_any('pad', lex.AI_TITLE_WORDS)} OR (regexp_matches(pad, '[^\\pL\\pN_]ai[^\\pL\\pN_]')
     AND regexp_matches(pad, '[^\\pL\\pN_](engineer|consultant|developer|architect|lead|intern)[^\\pL\\pN_]'))) AS ai FROM h)
SELECT seq, contains(hay, 'python') OR contains(hay, 'sql') OR (
    {ck.contains_any('pad', lex.AI_HAYSTACK_TERMS)}
    AND {ck.contains_any('hay', lex.TECHNICAL_ROLE_TERMS)}) AS any_query,
  contains(hay, 'kubernetes') OR contains(hay, 'scrum') AS any_word, ai AS ai_title,
  {ck.contains_any('hay', lex.JOB_TEXT_WORDS)} AND ai AS job_like,
  {ck.contains_any("array_to_string(regexp_extract_all(lower(title), '[a-z0-9+#/.]+'), ' ')", lex.IT_ROLE_TERMS)} AS it_position
FROM a
""")
def text_predicates(spark: SparkSession, sf: str) -> DataFrame:
    jobs = views.vacancies(spark, sf)
    text = F.concat_ws(" ", "title", "description")
    hay = F.lower(text)
    words = lambda *ws: F.array(*[F.lit(w) for w in ws])
    return jobs.select(
        "seq",
        scoring.any_query(hay, words("python", "sql")).alias("any_query"),
        scoring.any_word(hay, words("Kubernetes", "Scrum")).alias("any_word"),
        scoring.ai_title(text).alias("ai_title"),
        scoring.job_like_text(text).alias("job_like"),
        scoring.it_position(F.col("title")).alias("it_position"),
    )


@query("listing_order", "O01 F21 W12", f"""
WITH {JOBS}, n AS (
  SELECT *, trim(regexp_replace(lower(title), '[^a-z0-9+#]+', ' ', 'g')) AS have,
    CASE seq % 6 WHEN 0 THEN CAST(posted AS TIMESTAMP)
      WHEN 1 THEN CAST(posted AS TIMESTAMP) + INTERVAL 510 MINUTE
      WHEN 5 THEN CAST(posted AS TIMESTAMP) + INTERVAL 1065 MINUTE END AS listed FROM jobs
), g AS (
  SELECT *, CASE WHEN have = 'software engineer' THEN 4
     WHEN regexp_matches(have, '\\bsoftware engineer\\b') THEN 3
     ELSE CASE (CAST(regexp_matches(have, '\\bsoftware\\b') AS INT) + CAST(regexp_matches(have, '\\bengineer\\b') AS INT))
          WHEN 2 THEN 2 WHEN 1 THEN 1 ELSE 0 END END AS grade,
     CASE WHEN regexp_matches(have, '\\bsoftware engineer\\b') THEN 1.0 ELSE
       (CAST(regexp_matches(have, '\\bsoftware\\b') AS INT) + CAST(regexp_matches(have, '\\bengineer\\b') AS INT)) / 2.0 END AS coverage
  FROM n
), r AS (
  SELECT *, row_number() OVER (PARTITION BY source ORDER BY grade DESC, coverage DESC,
    coalesce(listed, CAST('1970-01-01' AS TIMESTAMP)) DESC, seq) AS rn,
    count(*) OVER (PARTITION BY source) >= 20 AS cap_reached FROM g
)
SELECT source, rn AS source_rank, seq, grade, CAST(coverage AS DOUBLE) AS coverage, cap_reached
FROM r WHERE rn <= 20
""")
def listing_order(spark: SparkSession, sf: str) -> DataFrame:
    from talentmesh.functions import dates
    from talentmesh.operators.ordering import capped

    fit = scoring.listing_relevance(F.col("title"), F.lit("Software Engineer"))
    jobs = views.vacancies(spark, sf).select(
        "source", "seq", fit.alias("fit"),
        F.coalesce(dates.listed_at(F.col("published_raw")), F.timestamp_seconds(F.lit(0)))
        .alias("listed"),
    ).select("source", "seq", "listed", "fit.grade", "fit.coverage")
    order = [F.col("grade").desc(), F.col("coverage").desc(), F.col("listed").desc(), F.col("seq")]
    return capped(jobs, ["source"], order, 20).select(
        "source", F.col("source_rank").cast("long").alias("source_rank"), "seq", "grade",
        "coverage", "cap_reached")


@query("full_ranking", "W04 W11 O02", f"""
WITH {JOBS}, {PEOPLE}, {ck.scored_pairs()}, r AS (
  SELECT candidate_id, seq, score, row_number() OVER (
    PARTITION BY candidate_id ORDER BY score DESC, seq) AS position FROM routed)
SELECT candidate_id, seq, score, position, (position - 1) // 5 AS batch,
       position <= 80 AS reviewed FROM r
""")
def full_ranking(spark: SparkSession, sf: str) -> DataFrame:
    from talentmesh.operators import review

    ranked = matching.ranked_pairs(
        views.candidates(spark, sf), views.vacancies(spark, sf), minimum_score=None
    )
    return review.batches(ranked, 5, limit=80).select(
        "candidate_id", "seq", "score", "position", "batch", "reviewed")
