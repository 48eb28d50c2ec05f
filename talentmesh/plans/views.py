"""Vacancies, candidates and the other inputs, derived from the warehouse tables.

The warehouse holds no vacancies, so their attributes are picked from fixed lists by
arithmetic on ids and on the texts themselves. Each view is one SQL text in the subset
Spark and ANSI engines share, so a checker can rebuild the very same rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from talentmesh.session import configure

NOW = "2024-02-01 00:00:00"

# --- fixed values: pick lists ---------------------------------------------------------------------
TITLES = (
    "Senior Python Developer", "Software Engineer", "Machine Learning Engineer",
    "AI/ML Engineer", "Registered Nurse", "Staff Nurse", "Accountant", "Accounts Executive",
    "Data Engineer", "Senior Data Analyst", "DevOps Engineer", "Site Reliability Engineer",
    "Lead QA Engineer", "Test Automation Specialist", "HR Executive",
    "Talent Acquisition Manager", "Digital Marketing Intern", "Marketing Manager",
    "Trainee Software Engineer", "Graduate Accountant", "Product Manager", "Project Manager",
    "Customer Service Assistant", "Sales Executive", "Security Analyst", "Data Scientist",
    "NLP Engineer", "Principal Architect", "Director of Engineering",
    "Junior Full Stack Developer", "International Trade Officer", "UX Designer",
    "C++ Developer", "Lab Technician", "Machine Operator", "Content Writer",
)
COMPANIES = (
    "Acorn Labs", "Blue Harbour (Pvt) Ltd", "Confidential", "Delta  Works", "Ember & Co",
    "Fjord Systems", "", "Granite Health", "Hilltop Bank", "Iris Digital", "unknown",
    "Juniper Foods", "=Kite Media",
)
PLACES = (
    ("Colombo, Sri Lanka", "sri lanka"), ("Berlin, Germany", "de"), ("London, UK", "gb"),
    ("Remote", "lk"), ("Worldwide", ""), ("Kandy", "LK"), ("Bangalore, India", "india"),
    ("", "sri_lanka"), ("Galle / Dubai, United Arab Emirates", "sri lanka"), ("Remote only", ""),
    ("Munich", "Germany"), ("Anywhere (excluding India)", ""), ("Northern Ireland", "uk"),
    ("Remote - Europe", ""), ("New York, USA", "us"), ("Jaffna", ""), ("APAC", "sri lanka"),
    ("Hamburg, Germany or Paris, France", "fr"), ("Manchester", "united kingdom"),
)
SOURCES = (
    "Remotive", "Himalayas", "XpressJobs", "topjobs.lk", "ITPro.lk", "Google Custom Search",
    "DuckDuckGo Discovery", "Crawl4AI", "Company Feed", "Adzuna", "Partner Board",
)
SKILL_PHRASES = (
    "Python, SQL and Docker", "Java with Kubernetes on AWS", "React / TypeScript front ends",
    "machine learning, NLP and RAG", "Excel, communication and leadership",
    "CI/CD, Linux and cloud", "C# with Azure", "data  analysis in Tableau",
    "sales and customer service", "node, JavaScript, HTML, CSS", "accounting and finance",
    "agile, scrum", "nothing in particular", "data engineering with PostgreSQL",
    "LLM and LangChain", "Go, git, GraphQL",
)
YEARS_PHRASES = (
    "", "Minimum 2 years.", "At least 4 years experience.", "Requires 7+ years.",
    "3 to 5 years of relevant experience.", "10 years professional experience", "",
    "with 1.5 years in retail.", "99 years experience.",
)
TARGETS = (
    "Software Engineer", "Machine Learning Engineer", "Registered Nurse", "Accountant", "",
    "Data Analyst", "Senior DevOps Engineer", "Manager", "QA Engineer", "HR Manager",
    "Digital Marketing", "Project Manager", "AI Engineer", "Retail Assistant", "C++ Developer",
    "Intern", "Product Designer",
)
PROFILE_SKILLS = (
    "python|sql|docker", "java|aws|kubernetes", "react|typescript|javascript",
    "machine learning|nlp|python", "excel|communication", "accounting|finance|excel", "",
    "linux|ci/cd|cloud|python|sql", "sales|customer service", "c#|azure", "tableau|data analysis",
)
PROFILE_TITLES = (
    "software engineer|engineer", "nurse", "accountant", "", "ai engineer|engineer",
    "manager|project manager", "analyst",
)
PROFILE_COUNTRIES = ("Sri Lanka", "lk", "United Kingdom", "Germany", "India", "usa", "France")
YEARS_VALUES = ("NULL", "0", "1", "2", "3", "5", "8", "12.5")


def pick(values, index: str) -> str:
    """``CASE`` expression that picks a constant by position."""
    quoted = [v.replace("'", "''") for v in values]
    arms = " ".join(f"WHEN {i} THEN '{v}'" for i, v in enumerate(quoted))
    return f"CASE ({index}) % {len(values)} {arms} END"


def _pick_number(values, index: str) -> str:
    arms = " ".join(f"WHEN {i} THEN CAST({v} AS DOUBLE)" for i, v in enumerate(values))
    return f"CASE ({index}) % {len(values)} {arms} END"


MONTHS = "JanFebMarAprMayJunJulAugSepOctNovDec"

VACANCY_SQL = f"""
SELECT doc_id AS seq,
       {pick(SOURCES, "CAST(substr(source, 4) AS BIGINT)")} AS source,
       CASE WHEN doc_id % 17 = 0 THEN '' ELSE CAST(doc_id AS VARCHAR(20)) END AS source_id,
       {pick(TITLES, "k")} AS title,
       {pick(COMPANIES, "k")} AS company,
       {pick([p for p, _ in PLACES], "place_ix")} AS location,
       {pick([h for _, h in PLACES], "place_ix")} AS country_hint,
       CASE WHEN doc_id % 11 = 0 THEN ''
            WHEN doc_id % 3 = 0 THEN 'HTTPS://Board.Example/Jobs/' || fp || '/?utm_source=a' || CAST(doc_id AS VARCHAR(20)) || '&ref=1'
            WHEN doc_id % 3 = 1 THEN 'https://board.example/Jobs/' || fp || '?ref=1&gclid=' || CAST(doc_id AS VARCHAR(20)) || '#top'
            ELSE 'https://board.example/Jobs/' || fp || '?ref=1' END AS url,
       text || ' Skills: ' || {pick(SKILL_PHRASES, "doc_id")} || '; '
            || {pick(SKILL_PHRASES, "CAST(floor(doc_id / 16) AS BIGINT) * 5 + 3")} || '. '
            || {pick(YEARS_PHRASES, "doc_id")}
            || CASE WHEN doc_id % 41 = 0 THEN ' Applications are closed.' ELSE '' END
            || CASE WHEN doc_id % 13 = 0 THEN ' Visa sponsorship is not offered.' ELSE '' END
            AS description,
       CASE doc_id % 6
            WHEN 0 THEN CAST(posted AS VARCHAR(20))
            WHEN 1 THEN CAST(posted AS VARCHAR(20)) || 'T08:30:00Z'
            WHEN 2 THEN 'Mon, ' || CAST(day(posted) AS VARCHAR(2)) || ' '
                 || substr('{MONTHS}', CAST(month(posted) * 3 - 2 AS INTEGER), 3) || ' '
                 || CAST(year(posted) AS VARCHAR(4)) || ' 10:00:00 +0000'
            WHEN 3 THEN ''
            WHEN 4 THEN 'a few days ago'
            ELSE CAST(posted AS VARCHAR(20)) || 'T23:15:00+05:30' END AS published_raw,
       CASE WHEN doc_id % 5 = 0 THEN CAST(40 + doc_id % 60 AS VARCHAR(20)) || '000 - 110000' ELSE '' END AS salary,
       {pick(("Full time", "Contract", ""), "doc_id")} AS job_type,
       doc_id % 4 = 0 AS detail_page_verified,
       lang, posted, k, place_ix, fp, text
FROM (
  SELECT d.*, k + CASE WHEN doc_id % 7 = 0 THEN 1 ELSE 0 END AS place_ix,
         substr(md5(text), 1, 12) AS fp,
         CASE WHEN doc_id % 97 = 0 THEN CAST('2024-03-15' AS DATE)
              ELSE CAST('2024-02-01' AS DATE) - CAST(doc_id % 75 AS INTEGER) END AS posted
  FROM (
    SELECT doc_id, text, lang, source,
           CAST(ascii(text) AS BIGINT) * 31 + instr(text, ' ') * 7
             + instr(substr(text, instr(text, ' ') + 1), ' ') AS k
    FROM {{documents}}
  ) d
) v
"""

CANDIDATE_SQL = f"""
SELECT CAST(c_custkey AS VARCHAR(20)) AS candidate_id,
       c_name AS name,
       lower(replace(c_name, '#', '.')) || '@mail.test' AS email,
       {pick(TARGETS, "c_custkey")} AS target_position,
       {_pick_number(YEARS_VALUES, "CAST(floor(c_custkey / 3) AS BIGINT)")} AS experience_years,
       {pick(PROFILE_SKILLS, "c_custkey")} AS skills_text,
       {pick(PROFILE_TITLES, "c_custkey")} AS titles_text,
       {pick(PROFILE_COUNTRIES, "c_nationkey")} AS country,
       c_custkey % 3 = 0 AS allow_global_remote,
       CASE WHEN c_custkey % 4 = 0 THEN 'Senior specialist, 6 years' ELSE 'Worked in ' || c_mktsegment END AS raw_text
FROM {{customer}}
"""


TEXT_TABLES = ("documents", "pages")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A warehouse table, in the splits its files have.

    Text tables cost far more to work through than to move. A session over files without
    splits may ask for partitions by ``talentmesh.input.partitions``; nothing is moved unasked.
    """
    df = configure(spark).read.parquet(f"{sf_dir}/{name}.parquet")
    parts = spark.conf.get("talentmesh.input.partitions", "")
    return df.repartition(int(parts)) if parts and name in TEXT_TABLES else df


def vacancies(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Vacancy table; helper columns of the derivation are dropped."""
    base = spark.sql(VACANCY_SQL, documents=table(spark, sf_dir, "documents"))
    return base.drop("lang", "posted", "k", "place_ix", "fp", "text")


def _terms(c: str) -> F.Column:
    return F.filter(F.split(F.col(c), r"\|"), lambda t: t != "")


def candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    base = spark.sql(CANDIDATE_SQL, customer=table(spark, sf_dir, "customer"))
    return base.select(
        "candidate_id", "raw_text", "name", "email",
        _terms("skills_text").alias("skills"), _terms("titles_text").alias("likely_titles"),
        "target_position", "experience_years", "country", "allow_global_remote",
    )


def pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "pages").select("page_id", "url", "html")


def vacancy_cte(name: str = "jobs") -> str:
    """The vacancy view as a common table expression over ``documents``."""
    return f"{name} AS ({VACANCY_SQL.replace('{documents}', 'documents')})"


def candidate_cte(name: str = "people") -> str:
    return f"{name} AS ({CANDIDATE_SQL.replace('{customer}', 'customer')})"
