"""Nearest neighbours by cosine: inverted lists of rotated vectors, candidates abandoned by hypothesis tests.

Vectors are scaled to length 1 and turned by one random rotation, so that any block of leading
columns is a fair sample of the whole distance. A candidate whose partial distance says, at a
level set by ``EPSILON``, that it cannot beat the best found so far is left without looking at
its other columns. What survives is scored on the original vectors.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from talentmesh.llm.common import stable, tidy

#: Rows on which the list centres are fitted, at most.
SAMPLE = 20_000
MAX_LISTS = 4_096
#: Share of the lists that a query looks into, and the least number of lists and candidates.
PROBE_SHARE = 0.65
MIN_PROBES = 16
MIN_CANDIDATES = 64
#: Candidates and queries that meet in one task call.
CANDIDATE_BLOCK = 4_096
QUERY_BLOCK = 2_048
#: Columns looked at between two tests, and the strictness of a test.
COLUMNS = 16
EPSILON = 2.1
SLACK = 1e-9
SEED = 20


def usable(vec: Column, width: int) -> Column:
    """Not null, ``width`` finite components, not all zero."""
    finite = F.forall(vec, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return (F.size(vec) == width) & finite & F.exists(vec, lambda x: x != 0)


def rotation(width: int) -> np.ndarray:
    q, r = np.linalg.qr(np.random.default_rng(SEED).standard_normal((width, width)))
    return q * np.sign(np.diag(r))


def matrix(column: pa.Array, width: int) -> np.ndarray:
    flat = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return np.asarray(flat.flatten(), dtype=np.float64).reshape(-1, width)


def unit(rows: np.ndarray) -> np.ndarray:
    scaled = rows / np.abs(rows).max(axis=1, keepdims=True)
    return scaled / np.sqrt((scaled * scaled).sum(axis=1, keepdims=True))


def fit_centres(sample: np.ndarray, lists: int, rounds: int = 10) -> np.ndarray:
    """Spherical k-means; a centre that loses all rows is set on the row worst served."""
    rng = np.random.default_rng(SEED)
    centres = sample[rng.choice(len(sample), lists, replace=False)]
    for _ in range(rounds):
        likeness = sample @ centres.T
        near = likeness.argmax(axis=1)
        sums = np.zeros_like(centres)
        np.add.at(sums, near, sample)
        empty = np.flatnonzero(np.bincount(near, minlength=lists) == 0)
        if len(empty):
            sums[empty] = sample[np.argsort(likeness.max(axis=1))[: len(empty)]]
        norm = np.linalg.norm(sums, axis=1, keepdims=True)
        centres = np.where(norm > 0, sums / np.where(norm > 0, norm, 1), centres)
    return centres


def cosine(rows: np.ndarray, query: np.ndarray) -> np.ndarray:
    """Row by row in double precision; equal rows get equal values."""
    return (rows * query).sum(axis=1) / (np.sqrt((rows * rows).sum(axis=1)) * np.sqrt((query * query).sum()))


def scan(turned: np.ndarray, query: np.ndarray, k: int, chunk: int = 1024) -> np.ndarray:
    """Positions of the rows of ``turned`` that may be among the ``k`` nearest to ``query``."""
    width = len(query)
    found, far = np.empty(0, dtype=np.int64), np.empty(0)
    limit = np.inf
    for start in range(0, len(turned), chunk):
        block = turned[start : start + chunk]
        alive, partial = np.arange(len(block)), np.zeros(len(block))
        for c in range(0, width, COLUMNS):
            gap = block[alive, c : c + COLUMNS] - query[c : c + COLUMNS]
            partial = partial + np.einsum("ij,ij->i", gap, gap)
            seen = min(c + COLUMNS, width)
            if seen < width and limit < np.inf:
                stays = partial * (width / seen) <= limit * (1 + EPSILON / np.sqrt(seen)) ** 2 + SLACK
                alive, partial = alive[stays], partial[stays]
                if not len(alive):
                    break
        found, far = np.concatenate([found, alive + start]), np.concatenate([far, partial])
        if len(far) > k:
            limit = np.partition(far, k - 1)[k - 1]
            near = far <= limit + SLACK
            found, far = found[near], far[near]
    return found


def best_of(ids: np.ndarray, scores: np.ndarray, k: int) -> np.ndarray:
    """Positions of the ``k`` best, ties to the smaller id, every id once."""
    order = np.lexsort((ids, -scores))
    _, first = np.unique(ids[order], return_index=True)
    return order[np.sort(first)[:k]]


def nearest(vectors: DataFrame, queries: Column, k: int = 5, vec_id: str = "vec_id", vec: str = "embedding") -> DataFrame:
    """The ``k`` nearest rows found for every row that ``queries`` selects, its own id excepted.

    Returns query_id, rank (from 1), vec_id, score (cosine), nearest first, ties to the smaller
    vec_id; fewer than ``k`` rows where there are fewer candidates. Vectors that are null, zero,
    of another width than most, or hold null or non-finite components take no part, nor do
    rows without an id. Rows that repeat an id count once, with their best score; of a repeated
    query one vector is taken. Only the id and the vector are read. An empty table, or one
    without usable vectors, gives an empty result.

    List centres are fitted on at most ``SAMPLE`` rows; every row is indexed. Long lists and
    their queries are split into blocks that meet pairwise, so no task holds a list whole.
    """
    spark = vectors.sparkSession
    schema = "query_id long, rank int, vec_id long, score double"
    rows = vectors.select(F.col(vec_id).cast("long").alias("id"), F.col(vec).alias("vec"), queries.alias("asks"))
    rows = rows.where("id IS NOT NULL AND vec IS NOT NULL")
    widths = rows.groupBy(F.size("vec").alias("width")).count().where("width > 0").orderBy(F.desc("count"), "width").head(1)
    if not widths:
        return spark.createDataFrame([], schema)
    width, total = widths[0]["width"], widths[0]["count"]
    rows = rows.where(usable(F.col("vec"), width))
    drawn = rows.orderBy(F.xxhash64("id"), "id").limit(SAMPLE).select("vec").toArrow()
    if not drawn.num_rows:
        return spark.createDataFrame([], schema)
    turn = rotation(width)
    sample = unit(matrix(drawn.column(0), width)) @ turn
    lists = max(1, min(MAX_LISTS, int(total**0.5 / 2), len(sample)))
    centres = fit_centres(sample, lists)

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            near = (unit(matrix(batch.column("vec"), width)) @ turn @ centres.T).argmax(axis=1)
            yield pa.RecordBatch.from_arrays([pa.array(near.astype(np.int32)), *batch.columns], ["list", *batch.schema.names])

    kind = rows.schema["vec"].dataType.simpleString()
    index = stable(rows.mapInArrow(tidy(assign), f"list int, id long, vec {kind}, asks boolean"), "lists")
    # One row a list, MAX_LISTS at most.
    counts = np.zeros(lists, dtype=np.int64)
    for r in index.groupBy("list").count().collect():
        counts[r["list"]] = r["count"]
    blocks = np.maximum(1, -(-counts // CANDIDATE_BLOCK))
    probes = min(lists, max(MIN_PROBES, round(lists * PROBE_SHARE)))

    def probe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            likeness = unit(matrix(batch.column("vec"), width)) @ turn @ centres.T
            order = np.argsort(-likeness, axis=1, kind="stable")
            reach = counts[order].cumsum(axis=1)
            n = np.maximum(probes, np.minimum((reach < MIN_CANDIDATES).sum(axis=1) + 1, lists))
            row = np.repeat(np.arange(len(n)), n)
            picked = order[np.arange(lists) < n[:, None]]
            yield pa.RecordBatch.from_arrays(
                [pa.array(picked.astype(np.int32)), batch.column("id").take(pa.array(row)), batch.column("vec").take(pa.array(row))],
                ["list", "id", "vec"],
            )

    asked = index.where("asks").groupBy("id").agg(F.min_by("vec", F.xxhash64("vec")).alias("vec"))
    asked = stable(asked.mapInArrow(tidy(probe), f"list int, id long, vec {kind}"), "probes")
    sizes = asked.groupBy("list").count()
    asking = np.ones(lists, dtype=np.int64)
    for r in sizes.collect():
        asking[r["list"]] = -(-r["count"] // QUERY_BLOCK)

    def per_list(values: np.ndarray) -> Column:
        return F.element_at(F.lit(values.tolist()), F.col("list") + 1)

    def cells(df: DataFrame, own: str, n_own: np.ndarray, other: str, n_other: np.ndarray) -> DataFrame:
        mine = F.pmod(F.xxhash64("id"), per_list(n_own)).cast("int").alias(own)
        return df.select("list", mine, F.explode(F.sequence(F.lit(0), (per_list(n_other) - 1).cast("int"))).alias(other), "id", "vec")

    left = cells(asked, "q", asking, "c", blocks).select("list", "q", "c", "id", "vec")
    right = cells(index, "c", blocks, "q", asking).select("list", "q", "c", "id", "vec")

    def search(queries: pa.Table, candidates: pa.Table) -> pa.Table:
        out: list[tuple] = []
        if queries.num_rows and candidates.num_rows:
            ids = candidates.column("id").to_numpy()
            original = matrix(candidates.column("vec"), width)
            turned = unit(original) @ turn
            asked_vectors = matrix(queries.column("vec"), width)
            for query_id, query, turned_query in zip(
                queries.column("id").to_pylist(), asked_vectors, unit(asked_vectors) @ turn, strict=True
            ):
                own = np.flatnonzero(ids == query_id)
                found = scan(turned, turned_query, k + len(own))
                found = found[ids[found] != query_id]
                scores = cosine(original[found], query)
                best = best_of(ids[found], scores, k)
                out += [(query_id, int(ids[found[b]]), float(scores[b])) for b in best]
        return pa.table(
            list(map(list, zip(*out, strict=True))) if out else [[], [], []],
            schema=pa.schema([("query_id", pa.int64()), ("vec_id", pa.int64()), ("score", pa.float64())]),
        )

    key = ["list", "q", "c"]
    found = left.groupBy(*key).cogroup(right.groupBy(*key)).applyInArrow(search, "query_id long, vec_id long, score double")
    once = found.groupBy("query_id", "vec_id").agg(F.max("score").alias("score"))
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    return once.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
