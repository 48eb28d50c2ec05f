"""Review, resume and checkpoint queries."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from talentmesh.functions.identity import evidence_hash, review_context, review_id
from talentmesh.operators import audit, filters, review
from talentmesh.plans import views
from talentmesh.plans.clean_queries import DECIDED, decided_rows
from talentmesh.plans.registry import query

JOBS = views.vacancy_cte()


def _turns(spark: SparkSession, sf: str) -> DataFrame:
    """Conversation turns as review rows: one batch per conversation."""
    return views.table(spark, sf, "conversations").select(
        F.col("conv_id").alias("batch_id"), F.col("turn"),
        F.concat_ws("-", F.lit("r"), "conv_id", "turn").alias("review_id"),
        F.concat(F.lit("https://v.test/"), "conv_id", F.lit("/"), "turn").alias("url"),
        F.length("text").cast("double").alias("chars"))



def _responses(spark: SparkSession, sf: str) -> DataFrame:
    turns = views.table(spark, sf, "conversations")
    row = F.concat(
        F.lit('{"review_id":"r-'), "conv_id", F.lit("-"), "turn", F.lit('","url":"https://v.test/'),
        "conv_id", F.lit("/"), "turn", F.lit('","decision":" Keep ","score":'),
        F.length("text") % 120, F.lit(',"reason":"ok"}'))
    packed = turns.select("conv_id", "turn", row.alias("r")).groupBy("conv_id").agg(
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("turn", "r"))),
                                 lambda x: x["r"]), ",").alias("rs"))
    listed = F.concat(F.lit("["), "rs", F.lit("]"))
    text = (
        F.when(F.col("conv_id") % 4 == 0, F.concat(F.lit("```json\n"), listed, F.lit("\n```")))
        .when(F.col("conv_id") % 4 == 1, F.concat(F.lit('Here you go: {"jobs":'), listed, F.lit("} bye")))
        .when(F.col("conv_id") % 4 == 2, F.concat(F.lit('{"results":'), listed, F.lit("}")))
        .otherwise(F.lit("sorry, no"))
    )
    return packed.select(F.col("conv_id").alias("batch_id"), text.alias("content"))


@query("review_batches", "W11", """
WITH t AS (SELECT conv_id, turn, row_number() OVER (PARTITION BY conv_id ORDER BY length(text) DESC, turn) AS position FROM conversations)
SELECT conv_id, turn, position, (position - 1) // 3 AS batch, position <= 4 AS reviewed FROM t
""")
def review_batches(spark: SparkSession, sf: str) -> DataFrame:
    rows = _turns(spark, sf).select(
        F.col("batch_id").alias("candidate_id"), F.col("turn").alias("seq"),
        F.col("chars").alias("score"))
    return review.batches(review.ranked(rows), 3, limit=4).select(
        F.col("candidate_id").alias("conv_id"), F.col("seq").alias("turn"), "position", "batch",
        "reviewed")


@query("parsed_decisions", "F28", """
SELECT conv_id AS batch_id, 'r-' || conv_id || '-' || turn AS review_id, 'keep' AS decision,
  CAST(length(text) % 120 AS DOUBLE) AS score, 'ok' AS reason FROM conversations WHERE conv_id % 4 <> 3
UNION ALL SELECT DISTINCT conv_id, NULL, NULL, NULL, '' FROM conversations WHERE conv_id % 4 = 3
""")
def parsed_decisions(spark: SparkSession, sf: str) -> DataFrame:
    return review.parsed_decisions(_responses(spark, sf)).select(
        "batch_id", "review_id", "decision", "score", "reason")


@query("applied_decisions", "J07 F29", """
WITH t AS (SELECT *, CAST(length(text) AS DOUBLE) AS chars, CAST(length(text) % 120 AS DOUBLE) AS given FROM conversations)
SELECT 'r-' || conv_id || '-' || turn AS review_id,
  CASE WHEN conv_id % 4 = 3 THEN 'reject' ELSE 'keep' END AS decision,
  greatest(0.0, least(CASE WHEN conv_id % 4 = 3 OR given < 40 THEN chars ELSE given END, 100.0)) AS final_score,
  CASE WHEN conv_id % 4 = 3 THEN 'LLM omitted a decision for this vacancy' ELSE 'ok' END AS reason FROM t
""")
def applied_decisions(spark: SparkSession, sf: str) -> DataFrame:
    matches = _turns(spark, sf).withColumnRenamed("chars", "score")
    decisions = review.parsed_decisions(_responses(spark, sf))
    return review.applied_decisions(matches, decisions, "p", "m").select(
        "review_id", "decision", "final_score", "reason")


@query("decision_violations", "J10 P34", """
WITH t AS (SELECT *, 'r-' || conv_id || '-' || turn AS rid, length(text) % 120 AS given FROM conversations)
SELECT conv_id AS batch_id, rid AS review_id, 'missing' AS violation FROM t WHERE conv_id % 4 = 3
UNION ALL SELECT conv_id, rid, 'invalid_score' FROM t WHERE conv_id % 4 <> 3 AND given > 100
UNION ALL SELECT conv_id, rid, 'duplicate' FROM t WHERE conv_id % 4 <> 3 AND turn = 0
UNION ALL SELECT DISTINCT conv_id, '', v FROM t, (VALUES ('unknown'), ('invalid_decision'), ('invalid_score')) x(v) WHERE conv_id % 4 = 3
""")
def decision_violations(spark: SparkSession, sf: str) -> DataFrame:
    decisions = review.parsed_decisions(_responses(spark, sf))
    again = decisions.unionByName(decisions.where("review_id like '%-0'"))
    return review.decision_violations(_turns(spark, sf), again)


@query("decision_totals", "A08 A10", f"""
WITH {JOBS}, {DECIDED} SELECT 'p' AS provider, decision AS model, count(*) AS reviewed FROM decided GROUP BY decision
""")
def decision_totals(spark: SparkSession, sf: str) -> DataFrame:
    rows = decided_rows(spark, sf).select(F.lit("p").alias("provider"), F.col("decision").alias("model"))
    return audit.decision_models(rows)


def _stored(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame]:
    """Matches with their hashes, and what an earlier run stored for some of them."""
    ctx = F.sha2(F.lit("context"), 256)
    rows = decided_rows(spark, sf).withColumn("score", F.lit(50.0)).withColumn(
        "concerns", F.array().cast("array<string>"))
    rows = rows.select("seq", "decision", review_id().alias("review_id"), ctx.alias("context_hash"),
                       evidence_hash().alias("evidence_hash"), "score", F.lit("").alias("reason"))
    stored = rows.where("decision <> 'review_failed'").withColumn(
        "evidence_hash", F.when(F.col("seq") % 5 == 0, F.lit("changed")).otherwise(F.col("evidence_hash")))
    return rows, stored


@query("resumed_reviews", "J08 F31 S12", f"""
WITH {JOBS}, {DECIDED} SELECT seq, decision FROM decided WHERE decision <> 'review_failed' AND seq % 5 <> 0
""")
def resumed_reviews(spark: SparkSession, sf: str) -> DataFrame:
    rows, stored = _stored(spark, sf)
    return review.resumed(rows, stored).select("seq", "decision")


@query("remaining_reviews", "J08 J09", f"""
WITH {JOBS}, {DECIDED} SELECT seq, 'review_failed' AS decision, 'Manual review required: provider stopped' AS reason
FROM decided WHERE decision = 'review_failed' OR seq % 5 = 0
""")
def remaining_reviews(spark: SparkSession, sf: str) -> DataFrame:
    rows, stored = _stored(spark, sf)
    done = review.resumed(rows, stored)
    return review.unreviewed_as_manual(rows, done, "provider stopped").select(
        "seq", "decision", "reason")


@query("checkpoint_lines", "S12 K09", """
SELECT 'r' || conv_id AS review_id, arg_max(CASE turn % 3 WHEN 0 THEN 'keep' WHEN 1 THEN 'reject' ELSE 'maybe' END, turn) AS decision
FROM conversations WHERE length(text) % 120 <= 100 GROUP BY conv_id
""")
def checkpoint_lines(spark: SparkSession, sf: str) -> DataFrame:
    turns = views.table(spark, sf, "conversations")
    verdict = F.element_at(F.array(F.lit("keep"), F.lit("reject"), F.lit("maybe")),
                           (F.col("turn") % 3 + 1).cast("int"))
    value = F.to_json(F.struct(
        F.lit(1).alias("version"), F.lit("ctx").alias("context"),
        F.concat(F.lit("r"), "conv_id").alias("review_id"), F.lit("e").alias("job_evidence"),
        verdict.alias("decision"), (F.length("text") % 120).cast("double").alias("score"),
        F.lit("").alias("reason"), F.lit("p").alias("provider"), F.lit("m").alias("model")))
    lines = turns.select(F.col("turn").alias("line_no"), value.alias("value")).unionByName(
        turns.select(F.col("turn").alias("line_no"), F.substring(value, 1, 20).alias("value")))
    return review.valid_checkpoint_lines(lines, "ctx").select("review_id", "decision")


@query("review_upsert", "J12 F34", f"""
WITH {JOBS}, {DECIDED}, s AS (SELECT *, CASE decision WHEN 'keep' THEN 'accepted' WHEN 'reject' THEN 'rejected' ELSE 'review_failed' END AS d FROM decided)
SELECT seq AS job_key, CASE WHEN seq % 4 = 0 THEN 'inserted' WHEN seq % 4 = 3 THEN 'kept'
    WHEN seq % 4 = 1 THEN CASE WHEN seq % 9 = 0 THEN 'conflict' ELSE 'unchanged' END
    ELSE CASE WHEN seq % 9 = 0 THEN 'conflict' WHEN d = 'review_failed' THEN 'retried' WHEN d = 'accepted' THEN 'unchanged' ELSE 'conflict' END END AS outcome,
  CASE WHEN seq % 4 = 2 AND seq % 9 <> 0 AND d = 'review_failed' THEN 'accepted' ELSE d END AS decision,
  CASE WHEN seq % 4 = 2 AND seq % 9 <> 0 AND d = 'review_failed' THEN 2 ELSE 1 END AS attempt_count
FROM s
""")
def review_upsert(spark: SparkSession, sf: str) -> DataFrame:
    base = decided_rows(spark, sf).select(
        F.lit("t").alias("task_id"), F.col("seq").alias("job_key"), F.lit("c").alias("context_hash"),
        F.lit("e").alias("evidence_hash"), review.stored_decision(F.col("decision")).alias("decision"),
        F.lit(50.0).alias("score"), F.lit("").alias("reason"), F.lit("p").alias("provider"),
        F.lit("m").alias("model"), F.lit(1).alias("attempt_count"))
    stored = base.where("job_key % 4 <> 0")
    change = F.when(F.col("job_key") % 4 == 2, F.lit("accepted")).otherwise(F.col("decision"))
    incoming = base.where("job_key % 4 <> 3").withColumn("decision", change).withColumn(
        "evidence_hash", F.when((F.col("job_key") % 9 == 0) & (F.col("job_key") % 4 > 0), F.lit("x"))
        .otherwise(F.col("evidence_hash")))
    return review.upsert_reviews(stored, incoming).select(
        "job_key", "outcome", "decision", "attempt_count")


@query("rule_violations", "P34", """
SELECT 'email' AS rule, 0 AS rows UNION ALL SELECT 'country', 0
UNION ALL SELECT 'position', (SELECT count(*) FROM customer WHERE c_custkey % 17 = 4)
UNION ALL SELECT 'years', (SELECT count(*) FROM customer WHERE CAST(floor(c_custkey / 3) AS BIGINT) % 8 = 0)
""")
def rule_violations(spark: SparkSession, sf: str) -> DataFrame:
    return filters.violations(views.candidates(spark, sf), filters.request_rules())


@query("review_requests", "F27 F26", f"""
WITH {JOBS}, p AS (SELECT lang, seq, description, row_number() OVER (PARTITION BY lang ORDER BY seq) AS position FROM jobs)
SELECT lang, (position - 1) // 5 AS batch, count(*) AS jobs,
  CAST(sum(CASE WHEN length(description) > 1800 THEN 1 ELSE 0 END) AS BIGINT) AS truncated,
  CAST(sum(length(description)) AS BIGINT) AS chars FROM p GROUP BY ALL
""")
def review_requests(spark: SparkSession, sf: str) -> DataFrame:
    langs = views.table(spark, sf, "documents").select(F.col("doc_id").alias("seq"), F.col("lang").alias("candidate_id"))
    rows = views.vacancies(spark, sf).join(langs, "seq").withColumn("score", F.lit(1.0)).withColumn(
        "concerns", F.array(F.lit("check")))
    people = langs.select("candidate_id").distinct().select(
        "candidate_id", F.lit("Engineer").alias("target_position"), F.lit(3.0).alias("experience_years"),
        F.lit("LK").alias("country"), F.lit(False).alias("allow_global_remote"),
        F.array(F.lit("python")).alias("skills"), F.array(F.lit("engineer")).alias("likely_titles"),
        F.lit("cv").alias("raw_text"))
    made = review.request_rows(review.ranked(rows), people, 5, compact=True)
    jobs = F.from_json("jobs", "array<struct<description:string,description_original_chars:bigint,description_truncated:boolean>>")
    return made.select("candidate_id", "batch", jobs.alias("j")).select(
        F.col("candidate_id").alias("lang"), "batch", F.size("j").cast("long").alias("jobs"),
        F.size(F.filter("j", lambda x: x["description_truncated"])).cast("long").alias("truncated"),
        F.aggregate("j", F.lit(0).cast("long"), lambda a, x: a + x["description_original_chars"]).alias("chars"))


@query("review_contexts", "F31")
def review_contexts(spark: SparkSession, sf: str) -> DataFrame:
    people = views.candidates(spark, sf).withColumn("experience_lines", F.array("raw_text"))
    return people.select("candidate_id", review_context(
        {"strict": "true", "provider": "p", "model": "m"}).alias("context_hash"))
