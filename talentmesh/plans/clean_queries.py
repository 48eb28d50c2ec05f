"""Duplicate removal, coverage, audit and report queries."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from talentmesh import lexicons as lex
from talentmesh.functions import dates
from talentmesh.functions.identity import content_hash, fallback_source_id, review_id
from talentmesh.operators import audit, dedupe, reports
from talentmesh.plans import checks as ck
from talentmesh.plans import views
from talentmesh.plans.registry import query

JOBS = views.vacancy_cte()

URL_KEY = """CASE WHEN url = '' THEN '' ELSE 'https://board.example/Jobs/' || fp || '?ref=1' END"""
"""What the canonical address must be, from the way the view builds addresses."""

SAME_URL = f"""addressed AS (
  SELECT *, CASE WHEN url <> '' THEN {URL_KEY} ELSE concat_ws('|', {', '.join(
      ck.identity(c) for c in ('source', 'source_id', 'title', 'company', 'location',
                               'published_raw', 'description'))}) END AS address,
    length({ck.collapse('description')}) AS rich1,
    length(trim(title)) + length(trim(company)) AS rich2 FROM jobs
),
per_url AS (
  SELECT *, row_number() OVER (PARTITION BY address ORDER BY rich1 DESC, rich2 DESC, seq) AS rn,
         min(seq) OVER (PARTITION BY address) AS first_seq FROM addressed
),
unique_urls AS (SELECT * FROM per_url WHERE rn = 1)"""


@query("exact_duplicates", "W01 F17", f"""
WITH {JOBS}, k AS (
  SELECT *, row_number() OVER (PARTITION BY lower(source),
    CASE WHEN source_id <> '' THEN source_id ELSE lower(split_part(url, '?', 1)) END,
    lower(title), lower(company) ORDER BY seq) AS rn FROM jobs)
SELECT seq, source, source_id FROM k WHERE rn = 1
""")
def exact_duplicates(spark: SparkSession, sf: str) -> DataFrame:
    return dedupe.first_seen(views.vacancies(spark, sf)).select("seq", "source", "source_id")


@query("canonical_urls", "F15", f"""
WITH {JOBS} SELECT seq, {URL_KEY} AS canonical FROM jobs
""")
def canonical_urls(spark: SparkSession, sf: str) -> DataFrame:
    from talentmesh.functions.urls import vacancy_url

    return views.vacancies(spark, sf).select("seq", vacancy_url(F.col("url")).alias("canonical"))


@query("one_per_address", "W02 F15 F20", f"""
WITH {JOBS}, {SAME_URL}
SELECT first_seq AS seq, source_id, source, title, md5(description) AS body FROM unique_urls
""")
def one_per_address(spark: SparkSession, sf: str) -> DataFrame:
    return dedupe.one_per_url(views.vacancies(spark, sf)).select(
        "seq", "source_id", "source", "title", F.md5("description").alias("body"))


ANONYMOUS = ", ".join(ck.lit(c) for c in lex.ANONYMOUS_COMPANIES)
NEAR = f"""near_rows AS (
  SELECT first_seq AS seq, source, source_id, title, company, rich1, rich2,
    {ck.identity('title')} || '|' || {ck.identity('company')} AS ident, {ck.identity('location')} AS place,
    list_distinct(string_split({ck.identity('description')}, ' ')) AS toks,
    {ck.identity('title')} <> '' AND {ck.identity('company')} <> '' AND {ck.identity('company')} NOT IN ({ANONYMOUS})
      AND length({ck.identity('description')}) >= 80 AS fit
  FROM unique_urls),
near_links AS (
  SELECT a.seq AS a, b.seq AS b FROM near_rows a JOIN near_rows b ON a.ident = b.ident AND a.seq <> b.seq AND a.fit AND b.fit
  WHERE (lower(a.source) <> lower(b.source) OR lower(a.source_id) = lower(b.source_id))
    AND (a.place = '' OR b.place = '' OR contains(a.place, b.place) OR contains(b.place, a.place))
    AND 5 * len(list_intersect(a.toks, b.toks)) >= 4 * least(len(a.toks), len(b.toks))),
reach AS (SELECT seq AS a, seq AS b FROM near_rows UNION SELECT reach.a, near_links.b FROM reach JOIN near_links ON near_links.a = reach.b),
roots AS (SELECT a AS seq, min(b) AS root FROM reach GROUP BY a),
led AS (SELECT n.*, root, first_value(seq) OVER (PARTITION BY root ORDER BY rich1 DESC, rich2 DESC, seq) AS leader
        FROM near_rows n JOIN roots USING (seq))"""


def _copies_of_addresses(spark: SparkSession, sf: str, in_order: bool = False) -> DataFrame:
    """Near copies among the vacancies that are one per address."""
    jobs = views.vacancies(spark, sf)
    return dedupe.near_duplicates(jobs, in_order, dedupe.one_row_per_url(jobs))


@query("near_copies", "J04 O06", f"""
WITH RECURSIVE {JOBS}, {SAME_URL}, {NEAR} SELECT seq, leader FROM led WHERE seq <> leader
""")
def near_copies(spark: SparkSession, sf: str) -> DataFrame:
    return _copies_of_addresses(spark, sf)


@query("unique_vacancies", "W03 J04", f"""
WITH RECURSIVE {JOBS}, {SAME_URL}, {NEAR}
SELECT root AS seq, source, source_id, title, company FROM led WHERE seq = leader
""")
def unique_vacancies(spark: SparkSession, sf: str) -> DataFrame:
    return dedupe.unique_vacancies(views.vacancies(spark, sf)).select(
        "seq", "source", "source_id", "title", "company")


def _head(row: str) -> str:
    return (f"struct_pack(seq := {row}.seq, src := lower({row}.source), sid := lower({row}.source_id), place := {row}.place, "
            f"toks := {row}.toks, rich := {row}.rich1 * 2147483648 + {row}.rich2)")


IN_ORDER = f"""ordered AS (
  SELECT *, row_number() OVER (PARTITION BY ident ORDER BY seq) AS k FROM near_rows WHERE fit),
walk AS (
  SELECT ident, k, seq, 1::BIGINT AS place_of, [{_head('ordered')}] AS heads FROM ordered WHERE k = 1
  UNION ALL
  SELECT ident, k, own.seq, coalesce(found, len(heads) + 1),
    CASE WHEN found IS NULL THEN list_append(heads, own) WHEN own.rich > heads[found].rich
         THEN list_concat(heads[:found - 1], [own], heads[found + 1:]) ELSE heads END
  FROM (SELECT w.ident, o.k, w.heads, {_head('o')} AS own, nullif(list_position(list_transform(w.heads, lambda h:
          (h.src <> lower(o.source) OR h.sid = lower(o.source_id))
          AND (h.place = '' OR o.place = '' OR contains(h.place, o.place) OR contains(o.place, h.place))
          AND 5 * len(list_intersect(h.toks, o.toks)) >= 4 * least(len(h.toks), len(o.toks))), true), 0)::BIGINT AS found
        FROM walk w JOIN ordered o ON o.ident = w.ident AND o.k = w.k + 1)),
ended AS (SELECT ident, arg_max(heads, k) AS heads FROM walk GROUP BY ident)"""


@query("near_copies_in_order", "W03", f"""
WITH RECURSIVE {JOBS}, {SAME_URL}, {NEAR}, {IN_ORDER}
SELECT walk.seq, ended.heads[place_of].seq AS leader FROM walk JOIN ended USING (ident) WHERE walk.seq <> ended.heads[place_of].seq
""")
def near_copies_in_order(spark: SparkSession, sf: str) -> DataFrame:
    """The order-dependent groups; the SQL walks through the rows one by one."""
    return _copies_of_addresses(spark, sf, in_order=True)


def decided_rows(spark: SparkSession, sf: str) -> DataFrame:
    """Vacancies with the decision stored for them: labelled rows are reviewed."""
    labels = views.table(spark, sf, "labels")
    decision = (
        F.when(F.col("quality").isNull(), F.lit("review_failed"))
        .when((F.col("quality") == 1) & (F.col("toxic") == 0), F.lit("keep"))
        .otherwise(F.lit("reject"))
    )
    return views.vacancies(spark, sf).join(
        labels, F.col("seq") == F.col("doc_id"), "left"
    ).withColumn("decision", decision).drop("doc_id", "quality", "toxic")


DECIDED = """decided AS (
  SELECT j.*, CASE WHEN l.quality IS NULL THEN 'review_failed'
    WHEN l.quality = 1 AND l.toxic = 0 THEN 'keep' ELSE 'reject' END AS decision
  FROM jobs j LEFT JOIN labels l ON l.doc_id = j.seq)"""


def _traces(jobs: DataFrame) -> DataFrame:
    """Per-source batches as traces: two sources skipped or failed, the rest by row count."""
    per_source = jobs.groupBy("source").agg(F.count(F.lit(1)).alias("discovered"))
    batches = per_source.select(
        "source", F.lit("feed").alias("connector"), "discovered",
        F.when(F.col("source") == "Remotive", F.col("discovered") + 100).alias("inventory_total"),
        F.when(F.col("source") == "Adzuna", F.lit("timeout")).otherwise(F.lit("")).alias("error"),
        F.when(F.col("source") == "Himalayas", F.lit("remote-global sources disabled"))
        .otherwise(F.lit("")).alias("skip_reason"),
    )
    return audit.trace_rows(batches, 60)


TRACES = f"""traces AS (
  SELECT source, CASE source WHEN 'Himalayas' THEN 'skipped' WHEN 'Adzuna' THEN 'failed'
           ELSE 'completed_with_results' END AS status,
         CASE WHEN source IN ('Himalayas', 'Adzuna') THEN 0 ELSE count(*) END AS discovered,
         CASE WHEN source = 'Remotive' THEN count(*) + 100 END AS inventory_total,
         CASE source WHEN 'Himalayas' THEN 'remote-global sources disabled'
           WHEN 'Adzuna' THEN 'timeout'
           ELSE CASE WHEN count(*) >= 60 THEN {ck.lit(audit.NOTE_CAP)} ELSE '' END END AS note
  FROM jobs GROUP BY source)"""


@query("source_traces", "F38 S18 P24", f"WITH {JOBS}, {TRACES} SELECT * FROM traces")
def source_traces(spark: SparkSession, sf: str) -> DataFrame:
    return _traces(views.vacancies(spark, sf)).select(
        "source", "status", "discovered", "inventory_total", "note")


@query("status_counts", "A02", f"""
WITH {JOBS}, {TRACES} SELECT status, count(*) AS sources FROM traces GROUP BY status
""")
def status_counts(spark: SparkSession, sf: str) -> DataFrame:
    return audit.status_counts(_traces(views.vacancies(spark, sf)))


@query("source_coverage", "J05 A01 K04 O04", f"""
WITH {JOBS}, {TRACES}, {DECIDED}, c AS (
  SELECT source, count(*) AS unique_discovered,
    count(*) FILTER (WHERE source_id <> '') AS related_before_llm,
    count(*) FILTER (WHERE source_id <> '' AND decision = 'keep') AS final_vacancies,
    count(*) FILTER (WHERE source_id <> '' AND decision = 'reject') AS final_rejected,
    count(*) FILTER (WHERE source_id <> '' AND decision = 'review_failed') AS final_manual_review
  FROM decided GROUP BY source)
SELECT t.source, 'feed' AS connector, t.status,
       coalesce(CAST(t.inventory_total AS VARCHAR), '') AS full_inventory_rows,
       t.discovered AS role_candidate_rows_returned, c.unique_discovered, c.related_before_llm,
       c.final_vacancies, c.final_rejected, c.final_manual_review, t.note
FROM traces t LEFT JOIN c ON c.source = t.source
""")
def source_coverage(spark: SparkSession, sf: str) -> DataFrame:
    decided = decided_rows(spark, sf)
    related = decided.where("source_id <> ''")
    traces = _traces(views.vacancies(spark, sf)).withColumnRenamed(
        "discovered", "discovered_rows")
    pick = lambda d: related.where(F.col("decision") == d)
    return reports.coverage_report(audit.source_coverage(traces, {
        "discovered": decided, "related": related, "final": pick("keep"),
        "rejected": pick("reject"), "manual": pick("review_failed"),
    }))


@query("discovery_note", "A14", f"""
WITH {JOBS}, {TRACES}, {SAME_URL}
SELECT format('Discovery fan-in: {{}} unique raw jobs; {{}} source connector(s) returned results, {{}} loaded complete inventories with no role candidates, {{}} returned no rows (inventory unverified), {{}} skipped, {{}} failed',
  (SELECT count(*) FROM unique_urls),
  (SELECT count(*) FROM traces WHERE status = 'completed_with_results'), 0, 0,
  (SELECT count(*) FROM traces WHERE status = 'skipped'),
  (SELECT count(*) FROM traces WHERE status = 'failed')) AS note
""")
def discovery_note(spark: SparkSession, sf: str) -> DataFrame:
    jobs = views.vacancies(spark, sf)
    return audit.discovery_note(_traces(jobs), dedupe.one_per_url(jobs))


@query("run_totals", "A03", f"""
WITH {JOBS}, {SAME_URL}, {DECIDED}
SELECT (SELECT count(*) FROM jobs) AS rows_before, (SELECT count(*) FROM unique_urls) AS rows_unique,
  (SELECT count(*) FROM jobs) - (SELECT count(*) FROM unique_urls) AS consolidated,
  (SELECT count(*) FROM jobs) AS related,
  (SELECT count(*) FROM decided WHERE decision <> 'review_failed') AS accounted,
  (SELECT count(*) FROM jobs) = (SELECT count(*) FROM decided WHERE decision <> 'review_failed') AS complete
""")
def run_totals(spark: SparkSession, sf: str) -> DataFrame:
    jobs, decided = views.vacancies(spark, sf), decided_rows(spark, sf)
    return audit.run_totals(
        jobs, dedupe.one_per_url(jobs), decided.where("decision <> 'review_failed'"), jobs)


@query("audit_invariant", "A04 O05", f"""
WITH {JOBS}, {DECIDED}, e AS (
  SELECT source, source_id, url, title, company, count(*) AS n FROM jobs GROUP BY ALL),
f AS (
  SELECT source, source_id, url, title, company, sum(c) AS n FROM (
    SELECT *, 1 AS c FROM decided WHERE decision <> 'review_failed'
    UNION ALL SELECT *, 1 FROM decided WHERE decision = 'keep') u GROUP BY ALL)
SELECT CAST(sum(greatest(coalesce(e.n, 0) - coalesce(f.n, 0), 0)) AS BIGINT) AS missing,
       CAST(sum(greatest(coalesce(f.n, 0) - coalesce(e.n, 0), 0)) AS BIGINT) AS duplicated
FROM e FULL JOIN f USING (source, source_id, url, title, company)
""")
def audit_invariant(spark: SparkSession, sf: str) -> DataFrame:
    decided = decided_rows(spark, sf)
    found = decided.where("decision <> 'review_failed'").unionByName(
        decided.where("decision = 'keep'"))
    return audit.imbalance(views.vacancies(spark, sf), found)


@query("unaccounted_rows", "O05 A04", f"""
WITH {JOBS}, {DECIDED}
SELECT source, source_id, url, title, company FROM jobs
EXCEPT ALL SELECT source, source_id, url, title, company FROM decided WHERE decision = 'keep'
""")
def unaccounted_rows(spark: SparkSession, sf: str) -> DataFrame:
    return audit.key_difference(
        views.vacancies(spark, sf), decided_rows(spark, sf).where("decision = 'keep'"))


@query("snapshot_traces", "A05", f"""
WITH {JOBS} SELECT source, 'shared-inventory' AS connector, 'completed_with_results' AS status,
  count(*) AS discovered, count(*) AS eligible FROM jobs GROUP BY source
""")
def snapshot_traces(spark: SparkSession, sf: str) -> DataFrame:
    return audit.snapshot_traces(views.vacancies(spark, sf)).select(
        "source", "connector", "status", "discovered", "eligible")


@query("guarded_jobs_report", "K01 K08", f"""
WITH {JOBS}, g AS (SELECT seq, CASE WHEN regexp_matches(company, '^\\s*[=+@-]') THEN '''' || company
    ELSE company END AS company, title, location, country_hint, source, published_raw AS published_at,
    '2024-02-01T00:00:00+00:00' AS fetched_at_utc,
    CASE WHEN detail_page_verified THEN 'yes' ELSE 'no' END AS detail_page_verified, job_type,
    salary, url AS apply_url FROM jobs)
SELECT * EXCLUDE (seq) FROM g
""")
def guarded_jobs_report(spark: SparkSession, sf: str) -> DataFrame:
    jobs = views.vacancies(spark, sf).withColumn("fetched_at", dates.as_literal(views.NOW))
    return reports.guarded(reports.all_jobs_report(jobs))


@query("formula_guard", "K08", """
SELECT doc_id, CASE WHEN regexp_matches(text, '^[\\s\\x{a0}]*[=+@-]') THEN '''' || text ELSE text END AS cell
FROM documents
""")
def formula_guard(spark: SparkSession, sf: str) -> DataFrame:
    docs = views.table(spark, sf, "documents")
    return reports.guarded(docs.select("doc_id", F.col("text").alias("cell")))


@query("vacancy_identities", "F30 F31 F39", f"""
WITH {JOBS}
SELECT seq, 'job_' || substr(sha256(concat_ws(chr(31), source, source_id, url, title, company, location)), 1, 20) AS job_key,
  sha256(title || '|' || company || '|' || url || '|' || description) AS content_hash,
  CASE WHEN source_id <> '' THEN source_id ELSE substr(sha256(url), 1, 16) END AS source_job_id
FROM jobs
""")
def vacancy_identities(spark: SparkSession, sf: str) -> DataFrame:
    return views.vacancies(spark, sf).select(
        "seq", review_id().alias("job_key"), content_hash().alias("content_hash"),
        fallback_source_id().alias("source_job_id"))


@query("normal_forms", "F20", f"""
SELECT doc_id, {ck.identity('text')} AS identity_form, {ck.role('text')} AS role_form,
       {ck.collapse('lower(text)')} AS company_form FROM documents
""")
def normal_forms(spark: SparkSession, sf: str) -> DataFrame:
    from talentmesh.functions.text import company_key, identity_text, role_text

    text = F.col("text")
    return views.table(spark, sf, "documents").select(
        "doc_id", identity_text(text).alias("identity_form"),
        role_text(text).alias("role_form"), company_key(text).alias("company_form"))
