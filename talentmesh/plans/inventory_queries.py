"""Inventory, run, retention, subscription, contact and e-mail queries."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from talentmesh import lexicons as lex
from talentmesh.operators import contacts, filters, inventory, links, reports
from talentmesh.operators.search import search_plan, search_queries, query_terms, portal_search_terms
from talentmesh.plans import checks as ck
from talentmesh.plans import views
from talentmesh.plans.registry import query

JOBS, PEOPLE = views.vacancy_cte(), views.candidate_cte()
STAMP = "'%Y-%m-%d %H:%M:%S'"


def observations(spark: SparkSession, sf: str) -> DataFrame:
    """Events as sightings of vacancies: the user id is the vacancy, the time is the sighting."""
    return views.table(spark, sf, "events").select(
        F.concat(F.lit("s"), F.col("user_id") % 4).alias("source"),
        F.col("user_id").cast("string").alias("source_job_id"),
        F.col("event_type").alias("title"), F.lit("c").alias("company"), F.lit("").alias("location"),
        F.when(F.col("user_id") % 3 == 0, F.lit("Sri Lanka")).otherwise(F.lit("Germany")).alias("country"),
        F.lit("").alias("url"), F.lit("").alias("description"), F.lit("").alias("salary"),
        F.lit("").alias("job_type"), F.lit(None).cast("timestamp").alias("published_at"),
        F.lit(False).alias("detail_page_verified"), F.sha2("event_type", 256).alias("content_hash"),
        F.col("props").alias("raw_payload"), F.col("ts").cast("timestamp").alias("seen_at"))


CUT = "2024-01-15 00:00:00"
STOCK = f"""obs AS (SELECT 's' || (user_id % 4) AS source, CAST(user_id AS VARCHAR) AS source_job_id, event_type, ts,
    CASE WHEN user_id % 3 = 0 THEN 'Sri Lanka' ELSE 'Germany' END AS country FROM events),
stock AS (SELECT source, source_job_id, country, arg_max(event_type, ts) AS title, min(ts) AS first_seen, max(ts) AS last_seen,
    CASE WHEN max(ts) >= TIMESTAMP '{CUT}' THEN 'r2' ELSE 'r1' END AS run FROM obs GROUP BY 1, 2, 3)"""


def stock(spark: SparkSession, sf: str) -> DataFrame:
    seen = observations(spark, sf)
    cut = F.lit(CUT).cast("timestamp")
    first = inventory.upsert(inventory.empty_inventory(spark), seen.where(F.col("seen_at") < cut), "r1")
    return inventory.upsert(first, seen.where(F.col("seen_at") >= cut), "r2")


@query("inventory_upsert", "J11 F39", f"""
WITH {STOCK} SELECT source, source_job_id, title, strftime(first_seen, {STAMP}) AS first_seen,
  strftime(last_seen, {STAMP}) AS last_seen, strftime(last_seen + INTERVAL 2 DAY, {STAMP}) AS expires, TRUE AS is_active, run FROM stock
""")
def inventory_upsert(spark: SparkSession, sf: str) -> DataFrame:
    f = lambda c: F.date_format(c, "yyyy-MM-dd HH:mm:ss")
    return stock(spark, sf).select(
        "source", "source_job_id", "title", f("first_seen_at").alias("first_seen"),
        f("last_seen_at").alias("last_seen"), f("expires_at").alias("expires"), "is_active",
        F.col("last_source_run_id").alias("run"))


@query("active_inventory", "P31", f"""
WITH {STOCK} SELECT source, source_job_id FROM stock WHERE country = 'Sri Lanka'
  AND last_seen + INTERVAL 2 DAY > TIMESTAMP '2024-01-31 12:00:00' AND last_seen >= TIMESTAMP '2024-01-30 00:00:00'
""")
def active_inventory(spark: SparkSession, sf: str) -> DataFrame:
    return filters.active_inventory(
        stock(spark, sf), "Sri Lanka", "2024-01-31 12:00:00", "2024-01-30 00:00:00"
    ).select("source", "source_job_id")


@query("newest_inventory", "O03", f"""
WITH {STOCK} SELECT source, source_job_id FROM stock ORDER BY last_seen DESC, source, source_job_id LIMIT 100
""")
def newest_inventory(spark: SparkSession, sf: str) -> DataFrame:
    return inventory.newest(stock(spark, sf), 100).select("source", "source_job_id")


@query("task_snapshots", "W10 T04", f"""
WITH {STOCK}, t AS (SELECT CAST(c_custkey AS VARCHAR) AS task_id, CASE WHEN c_nationkey % 2 = 0 THEN 'Sri Lanka' ELSE 'Germany' END AS country
  FROM customer WHERE c_mktsegment <> 'BUILDING')
SELECT task_id, source, source_job_id,
  row_number() OVER (PARTITION BY task_id ORDER BY last_seen DESC, source, source_job_id) - 1 AS snapshot_order
FROM t JOIN stock USING (country)
""")
def task_snapshots(spark: SparkSession, sf: str) -> DataFrame:
    tasks = views.table(spark, sf, "customer").select(
        F.col("c_custkey").cast("string").alias("task_id"), "c_mktsegment",
        F.when(F.col("c_nationkey") % 2 == 0, "Sri Lanka").otherwise(F.lit("Germany")).alias("country"))
    rows = stock(spark, sf).select("country", "source", "source_job_id", "last_seen_at")
    taken = tasks.where("c_mktsegment = 'BUILDING'")
    return inventory.task_snapshots(tasks.drop("c_mktsegment"), rows, taken).select(
        "task_id", "source", "source_job_id", "snapshot_order")


@query("inventory_rules", "P34", """
SELECT unnest(['identity', 'content_hash', 'seen_order', 'expiry']) AS rule, 0 AS rows
""")
def inventory_rules(spark: SparkSession, sf: str) -> DataFrame:
    return filters.violations(stock(spark, sf), filters.inventory_rules())


def _runs(spark: SparkSession, sf: str) -> DataFrame:
    return views.table(spark, sf, "events").select(
        F.concat(F.lit("s"), F.col("user_id") % 4).alias("source"),
        F.date_format("ts", "yyyy-MM-dd'T'HH").alias("run_key"),
        (F.col("event_type") != "error").alias("ok"), F.col("ts").alias("at"))


@query("run_metrics", "A15", """
SELECT 's' || (user_id % 4) AS source, strftime(ts, '%Y-%m-%dT%H') AS run_key, count(*) AS discovered,
  count(*) FILTER (WHERE event_type <> 'error') AS upserted,
  CASE WHEN count(*) FILTER (WHERE event_type = 'error') = 0 THEN 'succeeded'
       WHEN count(*) FILTER (WHERE event_type <> 'error') = 0 THEN 'failed' ELSE 'partial' END AS status
FROM events GROUP BY 1, 2
""")
def run_metrics(spark: SparkSession, sf: str) -> DataFrame:
    return inventory.run_metrics(_runs(spark, sf)).drop("elapsed_seconds")


@query("new_runs", "J17", """
WITH r AS (SELECT DISTINCT 's' || (user_id % 4) AS source, strftime(ts, '%Y-%m-%dT%H') AS run_key FROM events),
f AS (SELECT DISTINCT 's' || (user_id % 4) AS source, strftime(ts, '%Y-%m-%dT%H') AS run_key FROM events WHERE event_type = 'signup')
SELECT * FROM r EXCEPT SELECT * FROM f
""")
def new_runs(spark: SparkSession, sf: str) -> DataFrame:
    runs = _runs(spark, sf).select("source", "run_key").distinct()
    done = views.table(spark, sf, "events").where("event_type = 'signup'").select(
        F.concat(F.lit("s"), F.col("user_id") % 4).alias("source"),
        F.date_format("ts", "yyyy-MM-dd'T'HH").alias("run_key"))
    return inventory.new_runs(runs, done)


@query("due_deletions", "J13", """
WITH o AS (SELECT o_custkey FROM orders WHERE o_orderstatus = 'O')
SELECT c_custkey AS cv_id FROM customer WHERE c_custkey % 5 <> 0 AND c_acctbal >= 0
  AND NOT EXISTS (SELECT 1 FROM o WHERE o.o_custkey = c_custkey)
""")
def due_deletions(spark: SparkSession, sf: str) -> DataFrame:
    docs = views.table(spark, sf, "customer").select(
        F.col("c_custkey").alias("cv_id"), F.lit(None).cast("timestamp").alias("deleted_at"),
        (F.col("c_custkey") % 5 == 0).alias("legal_hold"),
        F.when(F.col("c_acctbal") >= 0, F.lit("2024-01-01")).otherwise(F.lit("2025-01-01"))
        .cast("timestamp").alias("delete_after"))
    tasks = views.table(spark, sf, "orders").select(
        F.col("o_custkey").alias("cv_id"),
        F.when(F.col("o_orderstatus") == "O", "running").otherwise(F.lit("succeeded")).alias("status"))
    return inventory.due_for_deletion(docs, tasks, views.NOW).select("cv_id")


@query("deletion_outcomes", "J13", """
SELECT c_custkey AS cv_id, c_custkey % 3 = 0 AS deleted, CAST(c_custkey % 2 + CASE WHEN c_custkey % 3 < 2 THEN 1 ELSE 0 END AS BIGINT) AS attempts,
  CASE c_custkey % 3 WHEN 0 THEN '' WHEN 1 THEN 'locked' END AS error FROM customer
""")
def deletion_outcomes(spark: SparkSession, sf: str) -> DataFrame:
    """A third of the stored CVs is deleted, a third fails, a third is not tried."""
    key = F.col("c_custkey")
    docs = views.table(spark, sf, "customer").select(
        key.alias("cv_id"), F.lit(None).cast("timestamp").alias("deleted_at"), (key % 2).alias("deletion_attempts"),
        F.lit(None).cast("string").alias("deletion_error"))
    tried = docs.where("cv_id % 3 < 2").select("cv_id", F.when(F.col("cv_id") % 3 == 0, "").otherwise(F.lit("locked")).alias("error"))
    done = inventory.deletion_outcomes(docs, tried, views.NOW)
    return done.select(
        "cv_id", F.col("deleted_at").isNotNull().alias("deleted"), F.col("deletion_attempts").cast("long").alias("attempts"),
        F.col("deletion_error").alias("error"))


@query("inventory_round_trip", "F39", f"""
WITH {JOBS}, d AS (SELECT *, {ck.POSTED} AS published FROM jobs)
SELECT source, CASE WHEN source_id <> '' THEN source_id ELSE substr(sha256(url), 1, 16) END AS source_id, title, company, location,
  CASE WHEN country_hint <> '' THEN country_hint ELSE 'sri lanka' END AS country_hint, url, md5(description) AS body,
  coalesce(strftime(published, '%Y-%m-%dT%H:%M:%S') || '+00:00', '') AS published_raw, salary, job_type, detail_page_verified FROM d
""")
def inventory_round_trip(spark: SparkSession, sf: str) -> DataFrame:
    """Vacancies as inventory rows and back."""
    back = inventory.from_inventory(inventory.to_inventory(views.vacancies(spark, sf)))
    return back.withColumn("description", F.md5("description")).withColumnRenamed("description", "body")


def _subscriptions(spark: SparkSession, sf: str) -> DataFrame:
    return views.table(spark, sf, "orders").select(
        F.col("o_orderkey").alias("subscription_id"), F.col("o_custkey").alias("user_id"),
        F.when(F.col("o_orderstatus") == "O", "active").otherwise(F.lit("pending")).alias("status"),
        (F.col("o_orderdate") + F.expr("INTERVAL 365 DAYS")).alias("ends_at"),
        F.col("o_orderdate").alias("created_at"), F.col("o_totalprice").alias("amount"),
        F.col("o_orderpriority").alias("note"))


@query("current_subscriptions", "W09 J14 F36", """
WITH s AS (SELECT *, o_orderstatus = 'O' AND o_orderdate + INTERVAL 365 DAY > TIMESTAMP '1998-06-01 00:00:00' AS act FROM orders),
r AS (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY act DESC, o_orderdate DESC, o_orderkey) AS rn FROM s)
SELECT c_custkey AS user_id, coalesce(act, FALSE) AS is_active, o_orderkey AS subscription_id,
  CASE WHEN o_totalprice >= 200000 THEN 365 ELSE 30 END AS days, greatest(0, 3 - c_nationkey) AS runs_left
FROM customer LEFT JOIN r ON o_custkey = c_custkey AND rn = 1
""")
def current_subscriptions(spark: SparkSession, sf: str) -> DataFrame:
    users = views.table(spark, sf, "customer").select(F.col("c_custkey").alias("user_id"), "c_nationkey")
    rows = inventory.current_subscriptions(
        users.select("user_id"), _subscriptions(spark, sf), "1998-06-01 00:00:00")
    return rows.join(users, "user_id").select(
        "user_id", "is_active", "subscription_id",
        inventory.plan_days(F.col("note"), F.col("amount"), 200000).alias("days"),
        inventory.runs_left(F.lit(3), F.col("c_nationkey")).alias("runs_left"))


@query("pending_subscriptions", "O10", """
SELECT o_orderkey AS subscription_id FROM orders WHERE o_orderstatus <> 'O'
""")
def pending_subscriptions(spark: SparkSession, sf: str) -> DataFrame:
    return _subscriptions(spark, sf).where("status = 'pending'").orderBy(
        F.col("created_at").desc(), "subscription_id").select("subscription_id")


@query("owned_rows", "P32", """
SELECT o_orderkey FROM orders WHERE EXISTS (SELECT 1 FROM customer WHERE c_custkey = o_custkey AND c_nationkey = 7)
""")
def owned_rows(spark: SparkSession, sf: str) -> DataFrame:
    tasks = views.table(spark, sf, "customer").select(
        F.col("c_custkey").alias("task_id"), F.col("c_nationkey").cast("string").alias("owner_id"))
    rows = views.table(spark, sf, "orders").select("o_orderkey", F.col("o_custkey").alias("task_id"))
    return filters.visible_to_owner(rows, tasks, "7").select("o_orderkey")


@query("request_years", "F35 A16", """
SELECT event_id, CASE event_id % 3 WHEN 0 THEN CAST(user_id AS DOUBLE) WHEN 1 THEN value END AS years,
  CASE event_id % 3 WHEN 2 THEN 'list' ELSE 'object' END AS root_type,
  CASE event_id % 3 WHEN 0 THEN 'a,years_experience' WHEN 1 THEN 'experience_years' ELSE '' END AS root_keys FROM events
""")
def request_years(spark: SparkSession, sf: str) -> DataFrame:
    i = F.col("event_id") % 3
    payload = (
        F.when(i == 0, F.to_json(F.struct(F.col("user_id").cast("string").alias("years_experience"), F.lit(1).alias("a"))))
        .when(i == 1, F.to_json(F.struct(F.col("value").alias("experience_years"))))
        .otherwise(F.lit('[{"z":1,"b":2}]')))
    shaped = inventory.payload_shapes(views.table(spark, sf, "events").select("event_id", payload.alias("payload")))
    return shaped.select("event_id", inventory.request_years(F.col("payload")).alias("years"),
                         "root_type", F.array_join("root_keys", ",").alias("root_keys"))


@query("distinct_calls", "A17 P33", """
SELECT event_type AS method, 'https://x.test/' || CASE WHEN user_id % 2 = 0 THEN 'jobs/' ELSE 'doubleclick.net/jobs/' END || user_id AS url,
  user_id % 2 = 0 AS job_related, count(*) AS captures FROM events GROUP BY event_type, user_id
""")
def distinct_calls(spark: SparkSession, sf: str) -> DataFrame:
    url = F.concat(F.lit("https://x.test/"), F.when(F.col("user_id") % 2 == 0, "jobs/").otherwise(
        F.lit("doubleclick.net/jobs/")), "user_id")
    calls = views.table(spark, sf, "events").select(
        F.col("event_type").alias("method"), url.alias("url"), F.lit("").alias("body"),
        filters.call_is_job_related(url, F.lit("")).alias("job_related"), F.col("ts").alias("at"))
    return inventory.distinct_calls(calls).drop("body")


# --- companies, contacts, e-mail ------------------------------------------------------------------

COMPANIES = f"""firsts AS (SELECT lower(trim(company)) AS key, arg_min(trim(company), seq) AS company, min(seq) AS seq
  FROM jobs WHERE lower(trim(company)) NOT IN ('', 'unknown', 'not supplied') GROUP BY 1)"""


@query("unique_companies", "W06", f"WITH {JOBS}, {COMPANIES} SELECT company, seq FROM firsts")
def unique_companies(spark: SparkSession, sf: str) -> DataFrame:
    return contacts.unique_companies(views.vacancies(spark, sf))


def _leads(spark: SparkSession, sf: str) -> DataFrame:
    """Manual leads of every company plus leads of landed results built from the texts.

    Every fifth result leads to a site instead of a profile; two thirds of those sites have landed.
    """
    jobs = views.vacancies(spark, sf)
    companies = contacts.unique_companies(jobs)
    seq = F.col("seq")
    site = F.concat(F.lit("https://firm"), seq % 7, F.lit(".test/about/"), seq % 3)
    either = lambda here, else_: F.when(seq % 5 == 0, here).otherwise(else_)
    results = jobs.where("trim(company) <> ''").select(
        F.trim("company").alias("company"), (seq * 100 + 50).alias("seq"),
        either(F.lit("About us"), F.concat(F.lit("Ann "), "seq", F.lit(" - Senior Recruiter | LinkedIn"))).alias("title"),
        either(F.lit("Who we are"), F.concat(F.lit("mail HR@firm"), seq % 7, F.lit(".test or bob@firm.test"))).alias("snippet"),
        either(site, F.concat(F.lit("https://www.linkedin.com/in/ann"), "seq")).alias("link"),
        F.lit("").alias("thumbnail"), F.lit("q").alias("query"))
    landed = jobs.where("seq % 5 = 0 AND seq % 3 < 2").select(site.alias("url"), F.concat(
        F.lit("<p>Our recruitment team</p><p>careers@firm"), seq % 7, F.lit(".test</p>")).alias("html"))
    return contacts.unique_leads(contacts.manual_leads(companies, "Sri Lanka").unionByName(
        contacts.result_leads(results, "Sri Lanka", landed=landed)))


def _encoded(text: str) -> str:
    return f"replace(url_encode({text}), '%20', '+')"


PEOPLE_QUERY = f"""'"' || company || '" ' || {ck.lit(contacts.PEOPLE_WORDS)} || ' "Sri Lanka"'"""
LEADS = f"""named AS (SELECT seq, trim(company) AS company, seq % 5 = 0 AS site FROM jobs WHERE trim(company) <> ''),
mails AS (SELECT *, CASE WHEN site THEN 'careers@firm' ELSE 'hr@firm' END || (seq % 7) || '.test' AS email FROM named WHERE NOT site OR seq % 3 < 2),
found AS (
  SELECT company, '' AS contact_name, {ck.lit(contacts.MANUAL_TITLE)} AS title, '' AS email, '' AS email_type, 'manual_review' AS confidence, '' AS profile_url,
    '' AS source_url, {PEOPLE_QUERY} AS search_query, {ck.lit(contacts.MANUAL_EVIDENCE)} AS evidence, seq * 100 AS seq FROM firsts
  UNION ALL SELECT company, 'Ann ' || seq, 'Senior Recruiter', '', '', 'public_linkedin_result', 'https://www.linkedin.com/in/ann' || seq,
    'https://www.linkedin.com/in/ann' || seq, 'q', 'mail HR@firm' || (seq % 7) || '.test or bob@firm.test', seq * 100 + 50 FROM named WHERE NOT site
  UNION ALL SELECT arg_min(company, seq), '', {ck.lit(contacts.EMAIL_TITLE)}, email, 'generic_recruiting', 'public_email', '',
    arg_min(CASE WHEN site THEN 'https://firm' || (seq % 7) || '.test/about/' || (seq % 3) ELSE 'https://www.linkedin.com/in/ann' || seq END, seq), 'q',
    arg_min(CASE WHEN site THEN 'Our recruitment team careers@firm' || (seq % 7) || '.test'
      ELSE 'Ann ' || seq || ' - Senior Recruiter | LinkedIn' || chr(10) || 'mail HR@firm' || (seq % 7) || '.test or bob@firm.test' END, seq), min(seq * 100 + 51)
    FROM mails GROUP BY lower(company), email),
leads AS (SELECT *, contact_name AS name, {ck.lit(contacts.COMPANY_URL)} || {_encoded("'" + '"' + "' || company || '" + '"' + "'")} AS company_linkedin_search_url,
  {ck.lit(contacts.PEOPLE_URL)} || {_encoded(PEOPLE_QUERY)} AS linkedin_search_url, '' AS profile_image_url FROM found)"""
LEAD_COLUMNS = (
    "company", "contact_name", "title", "email", "email_type", "confidence", "company_linkedin_search_url", "linkedin_search_url",
    "profile_url", "profile_image_url", "source_url", "search_query", "evidence")


@query("contact_leads", "J16 F32 W08 P29 K06", f"""
WITH {JOBS}, {COMPANIES}, {LEADS} SELECT {', '.join(LEAD_COLUMNS)}, seq FROM leads
""")
def contact_leads(spark: SparkSession, sf: str) -> DataFrame:
    return _leads(spark, sf).select(*LEAD_COLUMNS, "seq")


@query("contact_searches", "F32 J16", f"""
WITH {JOBS}, {COMPANIES}, q AS (SELECT company, [
    'site:linkedin.com/in ' || {PEOPLE_QUERY}, 'site:linkedin.com/company "' || company || '" "Sri Lanka"',
    '"' || company || '" ("careers" OR "jobs" OR "recruitment" OR "human resources" OR HR) email "Sri Lanka"',
    '"' || company || '" ("talent acquisition" OR recruiter OR recruitment) email'] AS queries FROM firsts)
SELECT company, unnest(queries) AS query, generate_subscripts(queries, 1) - 1 AS ordinal FROM q
""")
def contact_searches(spark: SparkSession, sf: str) -> DataFrame:
    """The searches that are made for every company."""
    companies = contacts.unique_companies(views.vacancies(spark, sf))
    asked = companies.select("company", F.posexplode(contacts.contact_queries(F.col("company"), F.lit("Sri Lanka"))).alias("ordinal", "query"))
    return asked.withColumn("ordinal", F.col("ordinal").cast("long"))


@query("best_contacts", "W05", f"""
WITH {JOBS}, {COMPANIES}, {LEADS}, b AS (SELECT *, row_number() OVER (PARTITION BY lower(regexp_replace(company, '\\s+', ' ', 'g'))
  ORDER BY CASE confidence WHEN 'public_email' THEN 0 WHEN 'public_linkedin_result' THEN 1 ELSE 2 END, seq) AS rn FROM leads)
SELECT company, email, confidence FROM b WHERE rn = 1
""")
def best_contacts(spark: SparkSession, sf: str) -> DataFrame:
    return reports.best_contacts(_leads(spark, sf)).select("company", "email", "confidence")


@query("companies_hiring", "W07 K05 J06 K02 K03", f"""
WITH {JOBS}, {COMPANIES}, {LEADS}, b AS (SELECT *, lower(regexp_replace(company, '\\s+', ' ', 'g')) AS k, row_number() OVER (PARTITION BY lower(regexp_replace(company, '\\s+', ' ', 'g'))
  ORDER BY CASE confidence WHEN 'public_email' THEN 0 WHEN 'public_linkedin_result' THEN 1 ELSE 2 END, seq) AS rn FROM leads),
f AS (SELECT *, row_number() OVER (PARTITION BY lower(trim(company)), lower(trim(title)), lower(trim(url)) ORDER BY seq) AS r FROM jobs)
SELECT f.company, f.title, CAST(1.0 AS DOUBLE) AS score, f.location, f.source, f.published_raw AS published_at,
  {', '.join(f"coalesce(b.{ours}, '') AS {theirs}" for ours, theirs in reports.CONTACT_COLUMNS)}, f.url AS apply_url
FROM f LEFT JOIN b ON b.rn = 1 AND b.k = lower(regexp_replace(trim(f.company), '\\s+', ' ', 'g')) WHERE f.r = 1
""")
def companies_hiring(spark: SparkSession, sf: str) -> DataFrame:
    matches = views.vacancies(spark, sf).withColumn("score", F.lit(1.0))
    return reports.companies_hiring(matches, _leads(spark, sf))


def _visited(spark: SparkSession, sf: str) -> DataFrame:
    """Three visited pages per landed page: the page, a contact page and an unread one."""
    mail = F.concat(F.lit("hr"), "page_id", F.lit("@acme.test"))
    code = F.concat(F.lit("ff"), F.translate(F.lower(F.hex(mail)), "0123456789abcdef", "fedcba9876543210"))
    html = F.concat("html", F.lit('<a href="mailto:Ann.Lee%40acme.test?x=1">m</a><i data-cfemail="'), code,
                    F.lit('"></i> me@example.com &lt;jobs&#64;site.test&gt;'))
    base = views.pages(spark, sf)
    row = lambda n, url, body: base.select(
        F.col("url").alias("apply_url"), F.lit("Acme").alias("company"), F.lit("Cook").alias("title"),
        F.lit(1.0).alias("score"), F.lit(n).alias("ordinal"), url.alias("url"), body.alias("html"))
    return row(0, F.col("url"), html).unionByName(
        row(1, F.lit("https://jobs.itpro.lk/c"), F.lit("write to info@itpro.lk"))).unionByName(
        row(2, F.lit("https://x.test/"), F.lit("")))


@query("email_findings", "F33 K07 O09", """
WITH u AS (SELECT DISTINCT url FROM pages), e AS (
  SELECT url, 'hr' || page_id || '@acme.test' AS email, 'generic/company' AS t, 'employer/job contact' AS s FROM pages
  UNION ALL SELECT url, 'ann.lee@acme.test', 'named/public', 'employer/job contact' FROM u
  UNION ALL SELECT url, 'jobs@site.test', 'generic/company', 'employer/job contact' FROM u
  UNION ALL SELECT url, 'info@itpro.lk', 'generic/company', 'job-board/platform contact' FROM u)
SELECT url AS apply_url, email, CASE WHEN email LIKE 'hr%' THEN 'named/public' ELSE t END AS email_type, s AS email_scope FROM e
""")
def email_findings(spark: SparkSession, sf: str) -> DataFrame:
    return contacts.findings_report(contacts.email_findings(_visited(spark, sf))).select(
        "apply_url", "email", "email_type", "email_scope")


@query("email_audit", "A11 A12", """
SELECT url AS apply_url, 2 * count(*) AS pages_checked, 3 + count(DISTINCT page_id) AS emails_found, 'checked' AS status FROM pages GROUP BY url
""")
def email_audit(spark: SparkSession, sf: str) -> DataFrame:
    visited = _visited(spark, sf)
    return contacts.crawl_audit(visited, contacts.email_findings(visited))


@query("email_totals", "A11", """
SELECT 'employer/job contact' AS email_scope, (SELECT count(*) FROM pages) + 2 * (SELECT count(DISTINCT url) FROM pages) AS occurrences,
  (SELECT count(*) FROM pages) + 2 AS addresses
UNION ALL SELECT 'job-board/platform contact', (SELECT count(DISTINCT url) FROM pages), 1
""")
def email_totals(spark: SparkSession, sf: str) -> DataFrame:
    return contacts.email_totals(contacts.email_findings(_visited(spark, sf)))


@query("document_emails", "P29 F06", f"""
WITH e AS (SELECT doc_id, unnest(list_distinct(list_transform(regexp_extract_all(text,
    '(?i)[A-Z0-9._%+-]+@[A-Z0-9.-]+\\.[A-Z]{{2,}}'), lambda x: lower(x)))) AS email FROM documents)
SELECT doc_id, email FROM e WHERE NOT {ck.contains_any('email', lex.PLACEHOLDER_EMAIL_WORDS)}
""")
def document_emails(spark: SparkSession, sf: str) -> DataFrame:
    return views.table(spark, sf, "documents").select(
        "doc_id", F.explode_outer(contacts.allowed_emails(F.col("text"), True)).alias("email")
    ).where(F.col("email").isNotNull())


@query("contact_links", "P30", f"""
WITH b AS (SELECT page_id, regexp_replace(url, '/+$', '') AS bare, regexp_extract(url, '^(https?://[^/?#]+)', 1) AS site,
    regexp_replace(lower(regexp_extract(url, '^https?://([^/?#]+)', 1)), '^www\\.', '') AS host,
    regexp_extract_all(html || '<a href="/careers?x=1">c</a><a href="/about-us#t">a</a><a href="/careers">again</a>', '(?is)href\\s*=\\s*["'']([^"''#]+)["'']', 1) AS hrefs FROM pages),
h AS (SELECT page_id, bare, site, unnest(hrefs) AS href, generate_subscripts(hrefs, 1) AS ordinal FROM b
  WHERE NOT regexp_matches(host, {ck.lit("(^|" + chr(92) + ".)(" + "|".join(a.replace(".", chr(92) + ".") for a in lex.AGGREGATOR_HOSTS) + ")$")})),
l AS (SELECT page_id, bare, ordinal, site || regexp_replace(regexp_replace(href, '[?#].*$', ''), '/+$', '') AS link FROM h
  WHERE starts_with(href, '/') AND {ck.contains_any("lower(regexp_replace(href, '[?#].*$', '') || ' ' || href)", lex.CONTACT_LINK_WORDS)}),
f AS (SELECT page_id, link, min(ordinal) AS ordinal FROM l WHERE link <> bare GROUP BY ALL)
SELECT page_id, link FROM (SELECT *, row_number() OVER (PARTITION BY page_id ORDER BY ordinal) AS n FROM f) WHERE n <= 8
""")
def contact_links(spark: SparkSession, sf: str) -> DataFrame:
    more = F.concat("html", F.lit('<a href="/careers?x=1">c</a><a href="/about-us#t">a</a><a href="/careers">again</a>'))
    return links.contact_links(views.pages(spark, sf).withColumn("html", more)).select("page_id", "link")


def _once(values: str) -> str:
    """The members of a list in order, each once."""
    return f"list_filter({values}, lambda x, i: list_position({values}, x) = i)"


def _family(target: str) -> str:
    arms = " ".join(
        "WHEN " + " OR ".join(f"contains(' ' || {ck.role(target)} || ' ', ' ' || {ck.role(ck.lit(m))} || ' ')" for m in markers)
        + f" THEN {ck.str_list(related)}" for markers, related in lex.ROLE_FAMILIES)
    return f"CASE {arms} ELSE [] END"


def _variants(target: str) -> str:
    low = ck.fold(target)
    some = lambda test, *names: f"CASE WHEN {test} THEN {ck.str_list(names)} ELSE [] END"
    return " || ".join((
        _family(target), some(f"contains({low}, 'devops')", "junior devops engineer"),
        some(f"contains({low}, 'ai') AND contains({low}, 'engineer')", "artificial intelligence engineer", "generative ai engineer", "ai/ml engineer"),
        some(f"contains({low}, 'ml') OR contains({low}, 'machine learning')", "machine learning engineer", "ml engineer"),
        some(f"contains({low}, 'data scientist')", "data scientist", "machine learning scientist")))


_LISTED = "list_filter(string_split({}, '|'), lambda t: t <> '')"
ASKED = f"""asked AS (SELECT candidate_id, target_position AS target, lower(country) AS country, {_LISTED.format('titles_text')} AS titles,
    {_LISTED.format('skills_text')} AS skills, CASE WHEN target_position <> '' THEN target_position ELSE 'software engineer' END AS position FROM people),
kinds AS (SELECT position, ({_variants('position')}) AS every FROM (SELECT DISTINCT position FROM asked)),
varied AS (SELECT position, (list_filter({_once('every')}, lambda v: {ck.role('v')} <> {ck.role('position')}))[:12] AS variants FROM kinds)"""
SKILL_ORDER = f"coalesce(nullif(list_position({ck.str_list(lex.SEARCH_SKILL_PRIORITY)}, s), 0), 999)"
TELLING = f"NOT ({' OR '.join(f'contains(t, {ck.lit(w)})' for w in lex.SEARCH_TITLE_WORDS)})"


@query("search_phrases", "F24 F25 O07 O08", f"""
WITH {PEOPLE}, {ASKED},
worded AS (SELECT *,
    list_transform(list_sort(list_transform(list_filter(titles, lambda t: length(t) > 2),
      lambda t: struct_pack(a := {TELLING}, b := -length(t), c := list_position(titles, t), t := t)))[:2], lambda k: k.t)
    || list_transform(list_sort(list_transform(list_filter(skills, lambda s: s NOT IN {ck.in_list(lex.SEARCH_SKIPPED_SKILLS)}),
      lambda s: struct_pack(a := {SKILL_ORDER}, t := s)))[:6], lambda k: k.t) AS terms,
    (CASE WHEN target <> '' THEN [trim(target)] ELSE [] END) || titles AS phrases FROM asked JOIN varied USING (position)),
asked_for AS (SELECT *, (CASE WHEN target <> '' THEN [target] || variants ELSE [] END)
    || list_filter(titles, lambda t: contains(t, 'engineer') OR contains(t, 'scientist'))
    || (CASE WHEN {ck.contains_any('lower(target)', lex.AI_POSITION_WORDS)} THEN {ck.str_list(lex.AI_QUERY_TERMS)} ELSE [] END)
    || [CASE WHEN len(terms) > 0 THEN array_to_string(terms[:6], ' ') WHEN len(titles) > 0 THEN array_to_string(titles[:2], ' ') ELSE 'software' END] AS all_queries,
    phrases || list_filter(list_transform(phrases, lambda p: CASE WHEN array_to_string(list_filter(regexp_extract_all(lower(p), '[a-z0-9+#]+'), lambda t: t NOT IN {ck.in_list(lex.SEARCH_MODIFIERS)}), ' ')
        <> array_to_string(regexp_extract_all(lower(p), '[a-z0-9+#]+'), ' ')
      THEN array_to_string(list_filter(regexp_extract_all(lower(p), '[a-z0-9+#]+'), lambda t: t NOT IN {ck.in_list(lex.SEARCH_MODIFIERS)}), ' ') ELSE '' END), lambda c: c <> '') AS all_terms FROM worded)
SELECT candidate_id, array_to_string(terms, '|') AS terms,
  array_to_string(list_filter({_once('all_queries')}, lambda q: q <> ''), '|') AS queries,
  array_to_string((list_filter({_once('all_terms')}, lambda q: q <> ''))[:6], '|') AS portal_terms FROM asked_for
""")
def search_phrases(spark: SparkSession, sf: str) -> DataFrame:
    people = views.candidates(spark, sf)
    join = lambda c: F.array_join(c, "|")
    return people.select(
        "candidate_id", join(query_terms()).alias("terms"),
        join(search_queries(F.lit(False))).alias("queries"),
        join(portal_search_terms()).alias("portal_terms"))


@query("search_plan", "F25", f"""
WITH {PEOPLE}, {ASKED},
quoted AS (SELECT candidate_id, country, '"' || position || '"' AS p, variants, array_to_string(list_transform(variants[:3], lambda v: '"' || v || '"'), ' OR ') AS joined
  FROM asked JOIN varied USING (position)),
planned AS (SELECT candidate_id, [p || ' "' || country || '" apply job', p || ' "' || country || '" vacancy']
    || list_transform(variants, lambda v: '"' || v || '" "' || country || '" job vacancy apply')
    || CASE WHEN country = 'sri lanka' THEN flatten(list_transform({ck.str_list(lex.SEARCH_DOMAINS)}, lambda d:
         ['site:' || d || ' ' || p || ' "Sri Lanka"'] || CASE WHEN len(variants) > 0 THEN ['site:' || d || ' (' || joined || ')'] ELSE [] END)) ELSE [] END AS every FROM quoted),
told AS (SELECT candidate_id, {_once('every')} AS queries FROM planned)
SELECT candidate_id, unnest(queries) AS query, generate_subscripts(queries, 1) - 1 AS ordinal FROM told
""")
def search_plan_rows(spark: SparkSession, sf: str) -> DataFrame:
    planned = search_plan(views.candidates(spark, sf), F.lower("country"))
    return planned.withColumn("ordinal", F.col("ordinal").cast("long"))
