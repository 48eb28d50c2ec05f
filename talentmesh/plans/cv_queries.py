"""CV extraction and draft queries."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from talentmesh import lexicons as lex
from talentmesh.functions import cv
from talentmesh.functions.text import bounded_items, bounded_text, guard_formula, masked_email
from talentmesh.operators import drafts, matching
from talentmesh.plans import checks as ck
from talentmesh.plans import views
from talentmesh.plans.registry import query
from talentmesh.session import durable_cut

# A CV is a document with a heading, a role line and a bullet added by arithmetic on its id.
CV_SQL = f"""
SELECT doc_id, CASE WHEN doc_id % 5 = 0 THEN '' ELSE
    CASE doc_id % 3 WHEN 0 THEN 'JOHN O''NEIL-SMITH' WHEN 1 THEN 'Resume 2024' ELSE 'SKILLS' END
    || chr(10) END
  || text || chr(10) || {views.pick(views.TITLES, "doc_id")} || chr(10)
  || '- Built ' || {views.pick(views.SKILL_PHRASES, "doc_id")} || chr(10)
  || '* Used ' || {views.pick(views.SKILL_PHRASES, "doc_id + 5")}
  || CASE WHEN doc_id % 4 = 0 THEN ' see https://cv.test/' || CAST(doc_id AS VARCHAR(20)) || ' and www.x.test, https://cv.test/' || CAST(doc_id AS VARCHAR(20)) ELSE '' END
  || CASE WHEN doc_id % 6 = 0 THEN chr(10) || 'S e n i o r   C h e f' ELSE '' END AS raw_text
FROM {{documents}}
"""
CVS = f"cvs AS ({CV_SQL.replace('{documents}', 'documents')})"
LINES = """lines AS (SELECT doc_id, raw_text, list_filter(list_transform(
  string_split(raw_text, chr(10)), lambda s: regexp_replace(s, '^[\\s\\x{a0}]+|[\\s\\x{a0}]+$', '', 'g')),
  lambda s: s <> '') AS ls FROM cvs)"""
WORDS = "len(list_filter(regexp_split_to_array({}, '[\\s\\x{{a0}}]+'), lambda w: w <> ''))"


def cv_texts(spark: SparkSession, sf: str) -> DataFrame:
    return spark.sql(CV_SQL, documents=views.table(spark, sf, "documents"))


@query("cv_contact_fields", "F06 S01", f"""
WITH {CVS}
SELECT doc_id, regexp_extract(raw_text, '[\\pL\\pN_.+-]+@[\\pL\\pN_.-]+\\.[A-Za-z]{{2,}}') AS email,
  regexp_replace(regexp_extract(raw_text, '\\+?[0-9][0-9\\s().-]{{7,}}[0-9]'), '^\\s+|\\s+$', '', 'g') AS phone,
  array_to_string(list_filter(regexp_extract_all(raw_text, '(?i)https?://[^\\s]+|www\\.[^\\s]+'),
    lambda x, i: list_position(regexp_extract_all(raw_text, '(?i)https?://[^\\s]+|www\\.[^\\s]+'), x) = i), ' ') AS links
FROM cvs
""")
def cv_contact_fields(spark: SparkSession, sf: str) -> DataFrame:
    raw = F.col("raw_text")
    return cv_texts(spark, sf).select(
        "doc_id", cv.first_email(raw).alias("email"), cv.first_phone(raw).alias("phone"),
        F.array_join(cv.links(raw), " ").alias("links"))


@query("cv_names", "F07", f"""
WITH {CVS}, {LINES}, m AS (SELECT *, lower(regexp_extract(raw_text,
  '[\\pL\\pN_.+-]+@[\\pL\\pN_.-]+\\.[A-Za-z]{{2,}}')) AS mail FROM lines),
p AS (SELECT doc_id, list_filter(ls[1:5], lambda s: (mail = '' OR NOT contains(lower(s), mail))
    AND NOT {ck.contains_any('lower(s)', ('http', 'linkedin', '@'))}
    AND {WORDS.format('s')} BETWEEN 2 AND 5) AS plain,
  list_filter(ls[1:60], lambda s: lower(s) NOT IN {ck.in_list(lex.SECTION_HEADINGS)}
    AND (mail = '' OR NOT contains(lower(s), mail)) AND NOT regexp_matches(s, '\\p{{Nd}}')
    AND NOT {ck.contains_any('lower(s)', ('@', 'http'))}
    AND {WORDS.format('s')} BETWEEN 2 AND 4 AND upper(s) = s) AS loud FROM m)
SELECT doc_id, CASE WHEN len(plain) > 0 THEN plain[1] WHEN len(loud) > 0 THEN
  CASE loud[1] WHEN 'JOHN O''NEIL-SMITH' THEN 'John O''Neil-Smith' ELSE loud[1] END ELSE '' END AS name
FROM p
""")
def cv_names(spark: SparkSession, sf: str) -> DataFrame:
    staged = cv_texts(spark, sf).select(
        "doc_id", cv.lines_of(F.col("raw_text")).alias("ls"),
        cv.first_email(F.col("raw_text")).alias("mail"))
    return staged.select("doc_id", cv.person_name(F.col("ls"), F.col("mail")).alias("name"))


@query("cv_terms", "F08 F05", f"""
WITH {CVS}, {LINES}, t AS (SELECT doc_id, regexp_replace(lower(raw_text), '[^a-z0-9+#/]+', ' ', 'g') AS hay,
  regexp_replace(lower(array_to_string(list_concat(ls[1:25], list_filter(ls, lambda s:
    {WORDS.format('s')} <= 14 AND {ck.contains_any('lower(s)', lex.TITLE_CONTEXT_TERMS)})), chr(10))),
    '[^a-z0-9+#/]+', ' ', 'g') AS head,
  list_filter(ls, lambda s: s[1] IN ('-', '*') OR ({ck.contains_any('lower(s)', lex.TITLE_TERMS)}
    AND {WORDS.format('s')} <= 14))[1:30] AS exp FROM lines)
SELECT doc_id, array_to_string({ck.term_list('hay', lex.SKILLS)}, '|') AS skills,
  array_to_string({ck.term_list('head', lex.TITLE_TERMS)}, '|') AS titles,
  array_to_string(exp, chr(10)) AS experience FROM t
""")
def cv_terms(spark: SparkSession, sf: str) -> DataFrame:
    parsed = cv.parse_cvs(cv_texts(spark, sf))
    return parsed.select(
        "doc_id", F.array_join("skills", "|").alias("skills"),
        F.array_join("likely_titles", "|").alias("titles"),
        F.array_join("experience_lines", "\n").alias("experience"))


@query("spaced_text_repair", "F09", f"""
WITH {CVS}
SELECT doc_id, array_to_string(list_transform(string_split(raw_text, chr(10)), lambda s:
  CASE WHEN length(trim(s)) >= 6 AND len(list_filter(string_split(trim(s), ' '), lambda t: t <> '')) >= 3
    AND len(list_filter(string_split(trim(s), ' '), lambda t: t <> '' AND length(t) <= 2))
      / len(list_filter(string_split(trim(s), ' '), lambda t: t <> '')) > 0.7
  THEN array_to_string(list_transform(list_filter(regexp_split_to_array(trim(s), '\\s{{2,}}'),
    lambda w: w <> ''), lambda w: replace(w, ' ', '')), ' ') ELSE s END), chr(10)) AS repaired
FROM cvs
""")
def spaced_text_repair(spark: SparkSession, sf: str) -> DataFrame:
    return cv_texts(spark, sf).select(
        "doc_id", cv.repair_spacing(F.col("raw_text")).alias("repaired"))


_HEAD = (700 - len(lex.EVIDENCE_GAP)) * 2 // 3
_TAIL = 700 - len(lex.EVIDENCE_GAP) - _HEAD


@query("bounded_evidence", "F26", f"""
WITH w AS (SELECT doc_id, text, string_split(text, ' ') AS ws FROM documents)
SELECT doc_id, CASE WHEN length(text) <= 700 THEN text ELSE substr(text, 1, {_HEAD})
    || {ck.lit(lex.EVIDENCE_GAP)} || right(text, {_TAIL}) END AS evidence,
  array_to_string(list_transform(CASE WHEN len(ws) <= 16 THEN ws
    ELSE list_concat(ws[1:10], ws[len(ws) - 5:]) END, lambda x: x), ' ') AS items
FROM w
""")
def bounded_evidence(spark: SparkSession, sf: str) -> DataFrame:
    docs = views.table(spark, sf, "documents")
    return docs.select(
        "doc_id", bounded_text(F.col("text"), 700).alias("evidence"),
        F.array_join(bounded_items(F.split("text", " "), 16, 220), " ").alias("items"))


@query("masked_contacts", "F40 K08", """
SELECT c_custkey, CASE WHEN c_custkey % 7 = 0 THEN '***' ELSE 'c***@mail.test' END AS masked,
  '''=' || c_name AS guarded FROM customer
""")
def masked_contacts(spark: SparkSession, sf: str) -> DataFrame:
    mail = F.when(F.col("c_custkey") % 7 == 0, F.lit("no address")).otherwise(
        F.concat(F.lower("c_name"), F.lit("@mail.test")))
    return views.table(spark, sf, "customer").select(
        "c_custkey", masked_email(mail).alias("masked"),
        guard_formula(F.concat(F.lit("="), F.col("c_name"))).alias("guarded"))


def _best(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Candidates, their profiles, and the best matches of every profile, named in ``candidate_id``."""
    jobs = views.vacancies(spark, sf)
    people = views.candidates(spark, sf)
    members, best = matching.top_of_profiles(people, jobs, k=25, minimum_score=20.0)
    titled = best.select(F.col("profile_id").alias("candidate_id"), "seq", "rank", "matched_skills").join(
        jobs.select("seq", "title"), "seq")
    return people, members, durable_cut(titled)


_BEST_SQL = f"""WITH {views.vacancy_cte()}, {views.candidate_cte()}, {ck.scored_pairs()},
best AS (
  SELECT r.*, j.title, row_number() OVER (PARTITION BY candidate_id ORDER BY score DESC, r.seq) AS rnk
  FROM routed r JOIN jobs j ON j.seq = r.seq
  WHERE score >= 20 AND (years IS NULL OR ((req IS NULL OR req <= years) AND NOT under))
  QUALIFY rnk <= 25
),
skill_counts AS (
  SELECT candidate_id, skill, count(*) AS n FROM (
    SELECT candidate_id, unnest(shared) AS skill FROM best) u
  WHERE skill NOT IN {ck.in_list(lex.LOW_SIGNAL_SKILLS)} GROUP BY ALL
),
top_s AS (
  SELECT candidate_id, list(skill ORDER BY n DESC, coalesce(nullif(list_position(
    [{', '.join(ck.lit(s) for s in lex.DRAFT_SKILL_PRIORITY)}], skill), 0), 999), skill) AS ss
  FROM skill_counts GROUP BY 1
),
title_counts AS (
  SELECT candidate_id, title, count(*) AS n, min(rnk) AS f FROM best GROUP BY ALL
),
top_t AS (SELECT candidate_id, list(title ORDER BY n DESC, f) AS ts FROM title_counts GROUP BY 1)"""


@query("top_matched_skills", "A06", f"""{_BEST_SQL}
SELECT candidate_id, array_to_string(ss, '|') AS top_skills FROM top_s
""")
def top_matched_skills(spark: SparkSession, sf: str) -> DataFrame:
    _, members, best = _best(spark, sf)
    return drafts.of_members(members, drafts.top_skills(best)).select(
        "candidate_id", F.array_join("top_skills", "|").alias("top_skills"))


@query("top_matched_titles", "A07", f"""{_BEST_SQL}
SELECT candidate_id, array_to_string(ts, '|') AS top_titles FROM top_t
""")
def top_matched_titles(spark: SparkSession, sf: str) -> DataFrame:
    _, members, best = _best(spark, sf)
    return drafts.of_members(members, drafts.top_titles(best)).select(
        "candidate_id", F.array_join("top_titles", "|").alias("top_titles"))


@query("tailored_drafts", "F37 A06 A07", f"""{_BEST_SQL},
d AS (
  SELECT p.*, coalesce(ss, list_filter(string_split(skills_text, '|'), lambda t: t <> '')[1:12]) AS ss,
    coalesce(ts, CAST([] AS VARCHAR[])) AS ts
  FROM people p LEFT JOIN top_s USING (candidate_id) LEFT JOIN top_t USING (candidate_id)
)
SELECT candidate_id, '# ' || name || chr(10) || email || chr(10) || chr(10) || '## Professional Summary' || chr(10)
  || 'Candidate targeting ' || CASE WHEN len(ts) > 0 THEN array_to_string(ts[1:3], ', ') ELSE 'relevant roles' END
  || ' in ' || country || ', with experience aligned to '
  || CASE WHEN len(ss) > 0 THEN array_to_string(ss[1:8], ', ') ELSE 'the required skills' END
  || '. ' || {ck.lit(drafts.SUMMARY_TAIL)} || chr(10) || chr(10) || '## Core Skills' || chr(10)
  || CASE WHEN len(ss) > 0 THEN array_to_string(ss[1:18], ', ') ELSE {ck.lit(drafts.NO_SKILLS)} END
  || chr(10) || chr(10) || '## Experience Highlights' || chr(10) || '- ' || raw_text
  || chr(10) || chr(10) || '## Target Role Keywords' || chr(10)
  || CASE WHEN len(ts) > 0 THEN array_to_string(list_transform(ts[1:8], lambda t: '- ' || t), chr(10))
     ELSE {ck.lit(drafts.NO_TITLES)} END
  || chr(10) || chr(10) || '## Integrity Check' || chr(10) || {ck.lit(drafts.INTEGRITY)} || chr(10) AS draft
FROM d
""")
def tailored_drafts(spark: SparkSession, sf: str) -> DataFrame:
    people, members, best = _best(spark, sf)
    full = people.withColumn("phone", F.lit("")).withColumn(
        "links", F.array().cast("array<string>")
    ).withColumn("experience_lines", F.array("raw_text"))
    return drafts.drafts(full, best, members)
