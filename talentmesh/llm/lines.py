"""Line duplicates: content-defined chunks of lines, whole repeated chunks removed; or every repeated run of lines."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from talentmesh.functions.text import computed
from talentmesh.llm.common import body, stable
from talentmesh.llm.exact import same_content

#: Lines whose hashes decide whether a chunk ends, and one line in how many ends one.
WINDOW = 3
DIVISOR = 4
#: The rolling hash: sum of line hashes times powers of BASE, modulo MODULUS.
BASE = 4_093
MODULUS = 1_000_003


def _line_hash(line: Column) -> Column:
    return F.conv(F.substring(F.md5(line.cast("binary")), 1, 7), 16, 10).cast("long")


def line_chunks(docs: DataFrame, window: int = WINDOW, divisor: int = DIVISOR) -> DataFrame:
    """doc_id, text_hash, lines, and chunks: array of (chunk_no, n_lines, chunk).

    A line is a cut when the rolling hash of it and the lines of the window before it is 0 modulo
    ``divisor``, so boundaries move with the content. A cut ends a chunk unless the line before it
    is one too or it is the first line; so all chunks but the last have two lines or more. The
    last line always ends one.
    """
    texts = docs.select("doc_id", F.xxhash64(body()).alias("text_hash"), body().alias("text"))
    lined = computed(texts, lines=F.split("text", "\n", -1)).drop("text")
    hashed = computed(lined, hashes=F.transform("lines", _line_hash))

    def is_cut(i: Column) -> Column:
        rolled = sum((F.coalesce(F.get("hashes", i - j), F.lit(0)) * pow(BASE, j, MODULUS) for j in range(1, window)), F.get("hashes", i))
        return F.pmod(rolled, F.lit(MODULUS)) % divisor == 0

    def ends(h: Column, i: Column) -> Column:
        return F.when(((i > 0) & is_cut(i) & ~is_cut(i - 1)) | (i == F.size("hashes") - 1), i + 1)

    ended = computed(hashed, ends=F.filter(F.transform("hashes", ends), lambda e: e.isNotNull()))

    def chunk(end: Column, no: Column) -> Column:
        start = F.coalesce(F.get("ends", no - 1), F.lit(0))
        text = F.array_join(F.slice("lines", start + 1, end - start), "\n")
        return F.struct(no.alias("chunk_no"), (end - start).alias("n_lines"), text.alias("chunk"))

    cut = computed(ended.withColumn("n_lines", F.size("lines")), chunks=F.transform("ends", chunk))
    return cut.select("doc_id", "text_hash", "n_lines", "chunks")


def without_repeated_chunks(docs: DataFrame, window: int = WINDOW, divisor: int = DIVISOR) -> DataFrame:
    """Documents without the chunks of two lines or more that occur before, anywhere.

    Returns one row per input row: doc_id, text (chunks that stay, joined by line feeds),
    n_lines, n_removed (lines). The first occurrence, by (doc_id, chunk number), stays. Equal
    hashes count as a repeat only once the bytes are equal. Only doc_id and text are read.
    Null text is empty, one empty line. A row with a null doc_id keeps all its lines. Rows that
    repeat doc_id and text are one document and get one answer.
    """
    chunked = line_chunks(docs, window, divisor)
    several = chunked.where("doc_id IS NOT NULL").select("doc_id", "text_hash", F.inline("chunks")).where("n_lines > 1")
    items = several.select(F.struct("doc_id", "chunk_no", "text_hash").alias("id"), F.col("chunk").alias("content"))
    repeats = same_content(items, many_repeats=True).where(F.col("id") != F.col("keep_id")).select("id.*")
    removed = repeats.groupBy("doc_id", "text_hash").agg(F.collect_set("chunk_no").alias("removed"))
    joined = chunked.join(removed, ["doc_id", "text_hash"], "left")
    gone = F.coalesce("removed", F.array().cast("array<int>"))
    marked = computed(joined, stay=F.array_except(F.transform("chunks", lambda c: c.chunk_no), gone))
    stay = computed(marked, chunks=F.transform("stay", lambda no: F.get("chunks", no)))
    return stay.select(
        "doc_id",
        F.array_join(F.transform("chunks", lambda c: c.chunk), "\n").alias("text"),
        F.col("n_lines").cast("long").alias("n_lines"),
        (F.col("n_lines") - F.aggregate("chunks", F.lit(0), lambda n, c: n + c.n_lines)).cast("long").alias("n_removed"),
    )


def without_repeated_runs(docs: DataFrame) -> DataFrame:
    """Documents without the lines of any run of two lines or more that occurs before, anywhere.

    A run occurs before if each two neighbouring lines of it do, so pairs of lines are compared and
    no boundary can hide a repeat. Returns one row per input row: doc_id, text (lines that stay,
    joined by line feeds), n_lines, n_removed. The first occurrence of a pair, by (doc_id, line
    number), stays. Pairs are equal if their SHA-256 is, so no text is moved to compare them. Null
    text, null doc_id and repeated rows count as in ``without_repeated_chunks``.
    """
    texts = docs.select("doc_id", F.xxhash64(body()).alias("text_hash"), body().alias("text"))
    lined = computed(texts, lines=F.split("text", "\n", -1)).drop("text")
    starts = F.sequence(F.lit(0), F.size("lines") - 2)
    pairs = F.transform(starts, lambda i: F.concat(F.get("lines", i), F.lit("\n"), F.get("lines", i + 1)))
    several = lined.where(F.col("doc_id").isNotNull() & (F.size("lines") > 1)).select(
        "doc_id", "text_hash", F.posexplode(pairs).alias("at", "content")
    )
    made = several.select(F.struct("doc_id", "at", "text_hash").alias("id"), F.unhex(F.sha2("content", 256)).alias("key"))
    keyed = stable(made, "line-pairs")
    firsts = keyed.groupBy("key").agg(F.min("id").alias("first"), F.count("*").alias("n")).where("n > 1").drop("n")
    repeats = keyed.join(firsts, "key").where(F.col("id") != F.col("first")).select("id.*")
    removed = repeats.groupBy("doc_id", "text_hash").agg(F.collect_set("at").alias("removed"))
    joined = lined.join(removed, ["doc_id", "text_hash"], "left")
    gone = F.coalesce("removed", F.array().cast("array<int>"))
    covered = F.array_union(gone, F.transform(gone, lambda i: i + 1))
    stay = computed(joined, stay=F.array_except(F.sequence(F.lit(0), F.size("lines") - 1), covered))
    return stay.select(
        "doc_id",
        F.array_join(F.transform("stay", lambda i: F.get("lines", i)), "\n").alias("text"),
        F.size("lines").cast("long").alias("n_lines"),
        (F.size("lines") - F.size("stay")).cast("long").alias("n_removed"),
    )
