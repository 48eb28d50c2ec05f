"""Document fingerprints: a quartile digest of hashed byte triplets, and a bounded comparison.

A text's bytes are read through a window of four. Three triplets of each window are hashed
into BUCKETS counters. The digest holds, for each bucket, which quarter of all counters its
count lies in (two bits), and the length on a logarithmic scale. Two digests differ by the sum
of their quarters' distances and a bounded part for the length; unrelated random digests
differ by about BOUND, where likeness ends.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from talentmesh.llm.common import body, shuffle_partitions, stable, tidy

BUCKETS = 256
#: The other two bytes of each triplet, as offsets from its first.
TRIPLETS = ((1, 2), (1, 3), (2, 3))
#: Odd 32-bit multiplier; the upper bits of the product name the bucket.
MULTIPLIER = 2654435761
#: Most that the length adds, and the difference at which likeness is 0: what two unrelated
#: random digests have (1.25 a bucket).
LENGTH_PART = 16
BOUND = BUCKETS * 5 // 4

Digest = tuple[int, np.ndarray]


def length_code(n: int) -> int:
    """The length in eighths of a doubling, 0 for nothing."""
    if n < 1:
        return 0
    e = n.bit_length() - 1
    return min(e * 8 + ((n << 3) >> e) - 7, 255)


def quarters(raw: bytes) -> Digest:
    """Length code and the quarter (0 to 3) of each bucket's count; two zero bytes lead the text."""
    data = np.frombuffer(b"\0\0" + raw, dtype=np.uint8).astype(np.uint32)
    counts = np.zeros(BUCKETS, dtype=np.int64)
    shift = np.uint32(32 - (BUCKETS - 1).bit_length())
    for nth, (a, b) in enumerate(TRIPLETS):
        n = len(data) - b
        if n > 0:
            triplet = (data[:n] << np.uint32(16)) | (data[a : a + n] << np.uint32(8)) | data[b:]
            hashed = (triplet + np.uint32(nth << 24)) * np.uint32(MULTIPLIER)
            counts += np.bincount(hashed >> shift, minlength=BUCKETS)
    edges = np.sort(counts)[[BUCKETS // 4 - 1, BUCKETS // 2 - 1, 3 * BUCKETS // 4 - 1]]
    return length_code(len(raw)), (counts[:, None] > edges).sum(axis=1).astype(np.int8)


def written(digest: Digest) -> str:
    """Two hex digits of length, then one for every two buckets."""
    length, codes = digest
    return f"{length:02x}" + "".join("0123456789abcdef"[c] for c in (codes[::2] * 4 + codes[1::2]).tolist())


def read(fingerprint: str) -> Digest:
    digits = np.array([int(c, 16) for c in fingerprint[2:]], dtype=np.int8)
    return int(fingerprint[:2], 16), np.column_stack([digits >> 2, digits & 3]).ravel()


def likeness_of(a: Digest, b: Digest) -> float:
    apart = int(np.abs(a[1] - b[1]).sum()) + min(abs(a[0] - b[0]), LENGTH_PART)
    return max(BOUND - apart, 0) / BOUND


def fingerprint(raw: bytes) -> str:
    return written(quarters(raw))


def likeness(a: str, b: str) -> float:
    """1 for equal fingerprints, 0 for such as differ like random ones or more."""
    return likeness_of(read(a), read(b))


def fingerprints(docs: DataFrame) -> DataFrame:
    """One row per document: doc_id, n_chars (code points), fingerprint.

    Null text is empty; an empty text has a fingerprint too. Equal texts have equal ones. Only
    doc_id and text are read, so other columns cannot clash; a null or repeated doc_id is a row
    like any other. An empty table gives an empty result.
    """

    def made(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            marks = pa.array([fingerprint(t.as_py().encode()) for t in batch.column(2)], pa.string())
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), marks], ["doc_id", "n_chars", "fingerprint"])

    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.length(body()).cast("long").alias("n_chars"), body().alias("text"))
    return texts.mapInArrow(tidy(made), "doc_id long, n_chars long, fingerprint string")


REPORT = pa.schema([
    ("doc_id", pa.int64()), ("n_chars", pa.int64()), ("edited", pa.string()), ("fingerprint", pa.string()),
    ("edited_fingerprint", pa.string()), ("near_edited", pa.float64()), ("near_next", pa.float64()),
])
REPORT_SCHEMA = (
    "doc_id long, n_chars long, edited string, fingerprint string, edited_fingerprint string, "
    "near_edited double, near_next double"
)
#: Rows of the walk: a finished report, or the first or last text of a partition.
WALK = pa.schema([*REPORT, ("edge", pa.string()), ("partition", pa.int64()), ("text", pa.string())])
WALK_SCHEMA = REPORT_SCHEMA + ", edge string, partition long, text string"
#: Characters of results that are held before they are handed on.
HANDED_ON = 1 << 22


def _report(doc_id: int | None, text: str, own: Digest, following: str, other: Digest) -> tuple:
    part = len(text) // 3
    edited = text[: len(text) - part] + following[:part]
    changed = quarters(edited.encode())
    return (
        doc_id, len(text), edited, written(own), written(changed), likeness_of(own, changed), likeness_of(own, other),
    )


def _batch(rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    columns = list(zip(*rows, strict=True)) if rows else [[]] * len(schema)
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, schema, strict=True)], schema=schema)


def _walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Report on each row of a sorted partition but the last; its ends are handed on as edges."""
    partition, held, rows, size = TaskContext.get().partitionId(), None, [], 0
    for batch in batches:
        for doc_id, text in zip(batch.column(0), batch.column(1), strict=True):
            now = (doc_id.as_py(), text.as_py())
            own = quarters(now[1].encode())
            if held is None:
                rows.append((*[None] * 7, "first", partition, now[1]))
            else:
                rows.append((*_report(*held, now[1], own), None, None, None))
            held = (*now, own)
            size += len(now[1])
            if size > HANDED_ON:
                yield _batch(rows, WALK)
                rows, size = [], 0
    if held is not None:
        rows.append((held[0], *[None] * 6, "last", partition, held[1]))
    yield _batch(rows, WALK)


def _edges(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        rows = []
        for doc_id, text, following in zip(*(batch.column(i) for i in range(3)), strict=True):
            text, following = text.as_py(), following.as_py()
            rows.append(_report(doc_id.as_py(), text, quarters(text.encode()), following, quarters(following.encode())))
        yield _batch(rows, REPORT)


def against_edits(docs: DataFrame, keep: Callable[[Column], Column] = lambda edited: edited) -> DataFrame:
    """Each document's fingerprint against that of an edited copy and of the next document.

    The next document follows by descending doc_id, the first follows the last; a table of one
    row is its own next. In the edited text the last third of the code points (rounded down) is
    replaced by the first as many, or all, of the next document.

    Returns one row per document: doc_id, n_chars, edited (the text, after ``keep``, which says
    what of it is to be written), fingerprint, edited_fingerprint, near_edited, near_next. Null text is empty. Rows with a null doc_id come
    last; rows that share a doc_id follow one another by xxhash64 of their text. Only doc_id and
    text are read, so other columns cannot clash. An empty table gives an empty result.

    Texts move once, dealt out by ranges of (doc_id, hash, row), so no key's rows need to share
    a task, and are read in order with one text held. Only a row at each end of a partition
    waits for a second step.
    """
    spread = F.xxhash64(F.monotonically_increasing_id()).alias("spread")
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), body().alias("text"), F.xxhash64(body()).alias("mark"), spread)
    order = [F.desc_nulls_last("doc_id"), F.asc("mark"), F.asc("spread")]
    sorted_texts = texts.repartitionByRange(shuffle_partitions(docs.sparkSession), *order).sortWithinPartitions(*order)
    walk = sorted_texts.select("doc_id", "text").mapInArrow(tidy(_walk), WALK_SCHEMA)
    walked = stable(walk.withColumn("edited", keep(F.col("edited"))), "walked")

    firsts = walked.where("edge = 'first'").select("partition", F.col("text").alias("following"))
    # One number a partition of the shuffle.
    every = Window.orderBy("partition")
    after = firsts.select("partition").select(
        "partition", F.coalesce(F.lead("partition").over(every), F.first("partition").over(every)).alias("next_partition")
    )
    lasts = walked.where("edge = 'last'").select("doc_id", "text", "partition").join(after, "partition")
    firsts = firsts.withColumnRenamed("partition", "next_partition")
    edges = lasts.join(firsts, "next_partition").select("doc_id", "text", "following").mapInArrow(tidy(_edges), REPORT_SCHEMA)
    edges = edges.withColumn("edited", keep(F.col("edited")))
    return walked.where("edge IS NULL").select(*REPORT.names).union(edges)
