"""The corpus operators as named queries over whole tables, with the SQL that checks them."""

from __future__ import annotations

from collections.abc import Callable

import corpus_pipeline
import public_tokenizers
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from talentmesh.functions.text import let
from talentmesh.llm import (
    alignment, ann, bpe, exact, fingerprints, jaccard, langid, lines, packing, periodic, quality, sharding, suffixdedup,
)
from talentmesh.llm.common import WHITE_SPACE, body, table

Runner = Callable[[SparkSession, str], DataFrame]

NORMALISED = r"regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g')"


def op1_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))


def op2_nearest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ann.nearest(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 50 == 0)


def op3_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact.exact_groups(table(spark, sf_dir, "documents"))


OP3_SQL = f"""
WITH d AS (SELECT doc_id, {NORMALISED} AS norm FROM documents)
SELECT doc_id, min(doc_id) OVER g AS keep_id, count(*) OVER g AS group_size,
       doc_id = min(doc_id) OVER g AS kept, sha256(norm) AS text_sha256
FROM d WINDOW g AS (PARTITION BY norm)
"""


def op4_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    done = lines.without_repeated_chunks(table(spark, sf_dir, "documents"))
    return done.select("doc_id", "n_lines", "n_removed", F.sha2("text", 256).alias("kept_sha256"))


OP4_SQL = f"""
WITH l AS (SELECT doc_id, unnest(list) AS line, generate_subscripts(list, 1) AS i, len(list) AS n
           FROM (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS list FROM documents)),
h AS (SELECT *, CAST('0x' || substr(md5(line), 1, 7) AS BIGINT) AS h FROM l),
r AS (SELECT *, (h + coalesce(lag(h, 1) OVER w, 0) * {lines.BASE}
                   + coalesce(lag(h, 2) OVER w, 0) * {pow(lines.BASE, 2, lines.MODULUS)}) % {lines.MODULUS} AS r
      FROM h WINDOW w AS (PARTITION BY doc_id ORDER BY i)),
e AS (SELECT *, i = n OR (i > 1 AND r % {lines.DIVISOR} = 0 AND lag(r) OVER w % {lines.DIVISOR} <> 0) AS ends FROM r
      WINDOW w AS (PARTITION BY doc_id ORDER BY i)),
c AS (SELECT *, coalesce(sum(CASE WHEN ends THEN 1 ELSE 0 END)
                 OVER (PARTITION BY doc_id ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS no FROM e),
k AS (SELECT doc_id, no, string_agg(line, chr(10) ORDER BY i) AS chunk, count(*) AS n_lines FROM c GROUP BY ALL),
f AS (SELECT *, n_lines > 1 AND row_number() OVER (PARTITION BY chunk, n_lines > 1 ORDER BY doc_id, no) > 1 AS gone FROM k)
SELECT doc_id, CAST(sum(n_lines) AS BIGINT) AS n_lines,
       CAST(sum(CASE WHEN gone THEN n_lines ELSE 0 END) AS BIGINT) AS n_removed,
       sha256(coalesce(string_agg(chunk, chr(10) ORDER BY no) FILTER (WHERE NOT gone), '')) AS kept_sha256
FROM f GROUP BY doc_id
"""


def op4_repeated_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    done = lines.without_repeated_runs(table(spark, sf_dir, "documents"))
    return done.select("doc_id", "n_lines", "n_removed", F.sha2("text", 256).alias("kept_sha256"))


OP4_RUNS_SQL = """
WITH l AS (SELECT doc_id, unnest(list) AS line, generate_subscripts(list, 1) AS i, len(list) AS n
           FROM (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS list FROM documents)),
p AS (SELECT *, lead(line) OVER (PARTITION BY doc_id ORDER BY i) AS following FROM l),
r AS (SELECT *, i < n AND row_number() OVER (PARTITION BY line, following, i < n ORDER BY doc_id, i) > 1 AS again FROM p),
f AS (SELECT *, again OR coalesce(lag(again) OVER (PARTITION BY doc_id ORDER BY i), false) AS gone FROM r)
SELECT doc_id, count(*) AS n_lines, CAST(sum(CASE WHEN gone THEN 1 ELSE 0 END) AS BIGINT) AS n_removed,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY i) FILTER (WHERE NOT gone), '')) AS kept_sha256
FROM f GROUP BY doc_id
"""


def op5_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    ranks = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
    return bpe.encode_decode(table(spark, sf_dir, "documents"), ranks, public_tokenizers.PATTERN)


def op6_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    done = suffixdedup.without_repeats(table(spark, sf_dir, "documents"), passages=True)
    return done.select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"), "n_passage_words")


def op7_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return langid.identify(table(spark, sf_dir, "documents"))


def op8_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard.similar_documents(table(spark, sf_dir, "documents"))


OP8_SQL = r"""
WITH RECURSIVE w AS (
  SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
         'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS words FROM documents),
s AS (SELECT DISTINCT doc_id, shingle FROM (
  SELECT doc_id, unnest(CASE WHEN len(words) = 0 THEN []
    WHEN len(words) < 5 THEN [array_to_string(words, ' ')]
    ELSE list_transform(range(1, len(words) - 3), lambda i: array_to_string(words[i:i + 4], ' ')) END) AS shingle FROM w)),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
p AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS common
      FROM s a JOIN s b ON a.shingle = b.shingle AND a.doc_id <> b.doc_id GROUP BY ALL),
l AS (SELECT a, b FROM p JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b
      WHERE 100 * common >= 75 * (x.n + y.n - common)),
r AS (SELECT doc_id AS a, doc_id AS b FROM documents UNION SELECT r.a, l.b FROM r JOIN l ON l.a = r.b)
SELECT d.doc_id, coalesce(any_value(n.n), 0) AS n_shingles, min(r.b) AS component_id
FROM documents d LEFT JOIN n USING (doc_id) JOIN r ON r.a = d.doc_id GROUP BY d.doc_id
"""


def op9_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``source`` is the host; its documents in one language are the path."""
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    return quality.judge(docs, labels, F.col("source"), F.col("lang"))


def op10_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.placements(table(spark, sf_dir, "documents"))


def op11_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    done = fingerprints.against_edits(table(spark, sf_dir, "documents"), keep=lambda edited: F.sha2(edited, 256))
    return done.withColumnRenamed("edited", "edited_sha256")


def _triplets() -> str:
    """Hashed triplets of every four bytes (z is the last, y, x, w those before it)."""
    parts = []
    for nth, (a, b) in enumerate(fingerprints.TRIPLETS):
        first, second = "zyxw"[b], "zyxw"[b - a]
        parts.append(
            f"SELECT doc_id, kind, ((({first}::BIGINT * 65536 + {second} * 256 + z + {nth << 24}) * {fingerprints.MULTIPLIER}) "
            f"% 4294967296) // {(1 << 32) // fingerprints.BUCKETS} AS bucket FROM b WHERE {first} IS NOT NULL"
        )
    return " UNION ALL ".join(parts)


OP11_SQL = f"""
WITH n AS (SELECT doc_id, coalesce(text, '') AS text,
         coalesce(lead(doc_id) OVER w, max(doc_id) OVER ()) AS next_id,
         coalesce(lead(coalesce(text, '')) OVER w, first_value(coalesce(text, '')) OVER w) AS following
       FROM documents WINDOW w AS (ORDER BY doc_id DESC)),
e AS (SELECT doc_id, next_id, text, length(text) AS n_chars,
        substr(text, 1, length(text) - length(text) // 3) || substr(following, 1, length(text) // 3) AS edited FROM n),
t AS (SELECT doc_id, 0 AS kind, text FROM e UNION ALL SELECT doc_id, 1, edited FROM e),
u AS (SELECT doc_id, kind, unnest(list) AS pair, generate_subscripts(list, 1) AS i
      FROM (SELECT doc_id, kind, list_concat(['00', '00'], regexp_extract_all(hex(encode(text)), '..')) AS list FROM t)),
h AS (SELECT doc_id, kind, i, CAST('0x' || pair AS INTEGER) AS z FROM u),
b AS (SELECT doc_id, kind, z, lag(z, 1) OVER w AS y, lag(z, 2) OVER w AS x, lag(z, 3) OVER w AS w
      FROM h WINDOW w AS (PARTITION BY doc_id, kind ORDER BY i)),
k AS (SELECT doc_id, kind, bucket, count(*) AS c FROM ({_triplets()}) GROUP BY ALL),
f AS (SELECT t.doc_id, t.kind, r.bucket, coalesce(k.c, 0) AS c
      FROM t CROSS JOIN range({fingerprints.BUCKETS}) r(bucket) LEFT JOIN k ON k.doc_id = t.doc_id AND k.kind = t.kind AND k.bucket = r.bucket),
q AS (SELECT doc_id, kind, list_sort(list(c)) AS s FROM f GROUP BY ALL),
c AS (SELECT f.doc_id, f.kind, f.bucket, CAST(c > s[{fingerprints.BUCKETS // 4}] AS INTEGER) + CAST(c > s[{fingerprints.BUCKETS // 2}] AS INTEGER)
        + CAST(c > s[{3 * fingerprints.BUCKETS // 4}] AS INTEGER) AS code FROM f JOIN q ON q.doc_id = f.doc_id AND q.kind = f.kind),
x AS (SELECT doc_id, kind, string_agg(digit, '' ORDER BY place) AS digits FROM (
        SELECT doc_id, kind, bucket // 2 AS place, substr('0123456789abcdef', 1 + CAST(sum(CASE WHEN bucket % 2 = 0 THEN 4 * code ELSE code END) AS INTEGER), 1) AS digit
        FROM c GROUP BY ALL) GROUP BY ALL),
l AS (SELECT doc_id, kind, n, CASE WHEN n < 1 THEN 0 ELSE least(255, p * 8 + ((n << 3) >> p) - 7) END AS code
      FROM (SELECT doc_id, kind, strlen(text)::BIGINT AS n, greatest(length(bin(strlen(text)::BIGINT)) - 1, 0)::INTEGER AS p FROM t)),
d AS (SELECT x.doc_id, x.kind, lower(lpad(hex(l.code), 2, '0')) || x.digits AS fingerprint, l.code,
        g.codes FROM x JOIN l USING (doc_id, kind) JOIN (SELECT doc_id, kind, list(code ORDER BY bucket) AS codes FROM c GROUP BY ALL) g USING (doc_id, kind)),
p AS (SELECT e.doc_id, o.fingerprint, m.fingerprint AS edited_fingerprint,
        list_sum(list_transform(list_zip(o.codes, m.codes), lambda z: abs(z[1] - z[2]))) + least(abs(o.code - m.code), {fingerprints.LENGTH_PART}) AS to_edited,
        list_sum(list_transform(list_zip(o.codes, v.codes), lambda z: abs(z[1] - z[2]))) + least(abs(o.code - v.code), {fingerprints.LENGTH_PART}) AS to_next
      FROM e JOIN d o ON o.doc_id = e.doc_id AND o.kind = 0 JOIN d m ON m.doc_id = e.doc_id AND m.kind = 1
        JOIN d v ON v.doc_id = e.next_id AND v.kind = 0)
SELECT e.doc_id, e.n_chars, sha256(e.edited) AS edited_sha256, fingerprint, edited_fingerprint,
  CAST(greatest({fingerprints.BOUND} - to_edited, 0) AS DOUBLE) / {fingerprints.BOUND} AS near_edited,
  CAST(greatest({fingerprints.BOUND} - to_next, 0) AS DOUBLE) / {fingerprints.BOUND} AS near_next
FROM e JOIN p USING (doc_id)
"""


def made_periodic(docs: DataFrame) -> DataFrame:
    """``documents`` (doc_id, text) in which a tenth of the texts repeat a stretch of words to their end.

    With h = crc32 of the decimal doc_id and g = h / 10: if h is divisible by 10, words from
    a = g % n on become original words a + (i - a) % p, p = 1 + (n - a) / (3 + g % 8). A null
    doc_id changes nothing.
    """
    h = F.crc32(F.col("doc_id").cast("string").cast("binary"))
    g = F.expr("crc32(CAST(CAST(doc_id AS STRING) AS BINARY)) div 10")

    def repeated(words: Column) -> Column:
        n = F.size(words)
        a = F.pmod(g, n).cast("int")
        p = (F.lit(1) + F.floor((n - a) / (F.lit(3) + F.pmod(g, F.lit(8))))).cast("int")
        times = F.ceil((n - a) / p).cast("int")
        again = F.flatten(F.array_repeat(F.slice(words, a + 1, p), times))
        return F.array_join(F.slice(F.concat(F.slice(words, F.lit(1), a), again), F.lit(1), n), " ")

    words = F.filter(F.split(body(), WHITE_SPACE), lambda w: w != "")
    changed = let(words, lambda w: F.when(F.size(w) > 0, repeated(w)).otherwise(""))
    return docs.select("doc_id", F.when(F.pmod(h, F.lit(10)) == 0, changed).otherwise(body()).alias("text"))


def op12_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    done = periodic.periodic_runs(made_periodic(table(spark, sf_dir, "documents")))
    none = F.expr("CAST(NULL AS struct<start: bigint, length: bigint, period: bigint>)")
    longer = lambda r, best: r["length"] * best["period"] > best["length"] * r["period"]
    best = F.reduce("runs", none, lambda most, r: F.when(most.isNull() | longer(r, most), r).otherwise(most))
    lines_of_runs = F.transform("runs", lambda r: F.concat(F.concat_ws(",", r["start"], r["length"], r["period"]), F.lit("\n")))
    done = done.withColumn("best", best)
    return done.select(
        "doc_id", F.size("runs").cast("long").alias("n_runs"), "best.start", "best.length", "best.period",
        F.expr("1000 * best.length div best.period").alias("exponent_milli"),
        F.sha2(F.array_join(lines_of_runs, ""), 256).alias("runs_sha256"), F.sha2("collapsed", 256).alias("collapsed_sha256"),
    )


def op13_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    digest = lambda groups: F.when(groups == "", "").otherwise(F.sha2(groups, 256))
    paths = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")
    rows, _ = alignment.aligned(table(spark, sf_dir, "documents"), *paths, keep=digest)
    return rows.withColumnRenamed("groups", "groups_sha256")


QUERIES: dict[str, Runner] = {
    "op1_packing": op1_packing,
    "op2_nearest": op2_nearest,
    "op3_exact_dedup": op3_exact_dedup,
    "op4_line_dedup": op4_line_dedup,
    "op4_repeated_runs": op4_repeated_runs,
    "op5_bpe": op5_bpe,
    "op6_suffix_dedup": op6_suffix_dedup,
    "op7_language_id": op7_language_id,
    "op8_jaccard_join": op8_jaccard_join,
    "op9_quality": op9_quality,
    "op10_sharding": op10_sharding,
    "op11_fingerprints": op11_fingerprints,
    "op12_periodic_runs": op12_periodic_runs,
    "op13_alignment": op13_alignment,
    "pipeline": corpus_pipeline.run,
}
ORACLE_SQL: dict[str, str] = {
    "op3_exact_dedup": OP3_SQL, "op4_line_dedup": OP4_SQL, "op4_repeated_runs": OP4_RUNS_SQL, "op8_jaccard_join": OP8_SQL,
    "op11_fingerprints": OP11_SQL,
}
if corpus_pipeline.ORACLE_SQL is not None:
    ORACLE_SQL["pipeline"] = corpus_pipeline.ORACLE_SQL
