"""Packing documents into token sequences by cutting-stock column generation.

Documents are cut into full pieces and one remainder each. How many sequences of which pattern
of remainder lengths are needed follows from the histogram of lengths alone, which has at most
``capacity`` entries whatever the size of the corpus; it is the only thing the driver sees.
Pieces are then ranked within their length, in parallel, and look up their place by rank.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from talentmesh.llm.common import body, stable, tidy
from talentmesh.llm.tokens import byte_level_ids

CAPACITY = 1024
END = 0
#: Blocks in which the pieces of one length are ranked.
BLOCKS = 1024
#: The linear program ends when its value is proven to be this close to the best.
GAP = 0.0005
STEPS = 200
PIECES = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long"
PLACED = PIECES + ", sequence_id long, offset long"


def pieces(docs: DataFrame, vocabulary: str, capacity: int = CAPACITY) -> DataFrame:
    """Full pieces of ``capacity`` ids and one shorter piece a document, with their checksums."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder, end = byte_level_ids(vocabulary), np.array([END], dtype="<u4")
        for batch in batches:
            rows: list[tuple] = []
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                ids = np.concatenate([coder.encode(text.as_py()), end])
                for start in range(0, len(ids), capacity):
                    part = ids[start : start + capacity]
                    rows.append((doc_id, start, len(part), zlib.crc32(part.tobytes()), len(ids)))
            yield pa.RecordBatch.from_arrays(
                [pa.array(list(c), pa.int64()) for c in zip(*rows, strict=True)] if rows else [pa.array([], pa.int64())] * 5,
                ["doc_id", "start", "length", "ids_crc32", "doc_tokens"],
            )

    return docs.select(F.col("doc_id").cast("long"), body().alias("text")).mapInArrow(tidy(cut), PIECES)


def best_pattern(lengths: np.ndarray, worth: np.ndarray, capacity: int) -> tuple[float, np.ndarray]:
    """The most valuable multiset of lengths that fits: unbounded knapsack over all capacities."""
    value, taken = np.zeros(capacity + 1), np.full(capacity + 1, -1)
    order = np.argsort(lengths)
    short, gain = lengths[order], worth[order]
    fits = np.searchsorted(short, np.arange(capacity + 1), side="right")
    for room in range(1, capacity + 1):
        value[room] = value[room - 1]
        if k := fits[room]:
            total = value[room - short[:k]] + gain[:k]
            best = int(total.argmax())
            if total[best] > value[room] + 1e-12:
                value[room], taken[room] = total[best], order[best]
    pattern, room = np.zeros(len(lengths)), capacity
    while room > 0:
        if taken[room] < 0:
            room -= 1
        else:
            pattern[taken[room]] += 1
            room -= lengths[taken[room]]
    return value[capacity], pattern


def _fill(left: dict[int, float], capacity: int) -> dict[int, int]:
    """The longest piece left, and of the others those that fill the sequence best."""
    first = max(left)
    items = [
        n for n in sorted(left, reverse=True) for _ in range(min(max(1, int(left[n])) - (n == first), (capacity - first) // n))
    ]
    room, reach = capacity - first, [1]
    mask = (1 << room + 1) - 1
    for n in items:
        reach.append((reach[-1] | reach[-1] << n) & mask)
        if reach[-1] >> room & 1:
            break
    at, chosen = reach[-1].bit_length() - 1, {first: 1}
    for k in range(len(reach) - 1, 0, -1):
        if not reach[k - 1] >> at & 1:
            n = items[k - 1]
            chosen[n] = chosen.get(n, 0) + 1
            at -= n
    return chosen


def _first_basis(lengths: np.ndarray, demand: np.ndarray, capacity: int) -> np.ndarray:
    """A pattern for each length: well-filled ones, each repeated until it uses some length up."""
    place = {int(n): i for i, n in enumerate(lengths)}
    left = dict(zip(place, demand.tolist(), strict=True))
    basis = np.zeros((len(lengths), len(lengths)))
    while left:
        pattern = _fill(left, capacity)
        ends = min(pattern, key=lambda n: left[n] / pattern[n])
        times = left[ends] / pattern[ends]
        for n, a in pattern.items():
            basis[place[n], place[ends]] = a
            left[n] -= a * times
        del left[ends]
        for n in [n for n in pattern if n in left and left[n] <= 1e-9]:
            basis[place[n], place[n]] = capacity // n  # used up by the same pattern
            del left[n]
    return basis


def solve_patterns(lengths: np.ndarray, demand: np.ndarray, capacity: int = CAPACITY, gap: float = GAP) -> tuple[np.ndarray, np.ndarray]:
    """Patterns (a column each) and how often each is used in the relaxed cutting-stock problem.

    Revised simplex over the basis of patterns. Each round prices all patterns at once by the
    knapsack and lets the best one enter, until the bound (value of the duals over the price of
    the best pattern) or the total length shows that the value is within ``gap`` of the best,
    or ``STEPS`` rounds have passed: any basis on the way is a full solution.
    """
    basis = _first_basis(lengths, demand, capacity)
    inverse = np.linalg.inv(basis)
    used = np.maximum(inverse @ demand, 0.0)
    least = demand @ lengths / capacity
    for _ in range(STEPS):
        if used.sum() <= (1 + gap) * least:
            break
        prices = inverse.sum(axis=0)
        value, pattern = best_pattern(lengths, np.maximum(prices, 0.0), capacity)
        if value <= 1 + 1e-9:
            break
        least = max(least, prices @ demand / value)
        enters = inverse @ pattern
        ratio = np.where(enters > 1e-9, used / np.where(enters > 1e-9, enters, 1.0), np.inf)
        leaves = int(ratio.argmin())
        used = np.maximum(used - ratio[leaves] * enters, 0.0)
        used[leaves] = ratio[leaves]
        basis[:, leaves] = pattern
        row = inverse[leaves] / enters[leaves]
        inverse -= np.outer(enters, row)
        inverse[leaves] = row
    return basis, used


def plan_sequences(histogram: dict[int, int], capacity: int = CAPACITY) -> list[tuple[dict[int, int], int]]:
    """(pattern: pieces by length, number of sequences) that use up the histogram exactly.

    The relaxed solution is rounded down; what that leaves is less than one sequence a basic
    pattern and is filled sequence by sequence, longest piece first.
    """
    left = {n: c for n, c in histogram.items() if c}
    plan = [({capacity: 1}, left.pop(capacity))] if capacity in left else []
    if left:
        lengths, demand = np.array(sorted(left)), np.array([left[n] for n in sorted(left)], dtype=float)
        basis, used = solve_patterns(lengths, demand, capacity)
        for pattern, times in zip(basis.T.astype(int), np.floor(used + 1e-6).astype(int), strict=True):
            held = {int(n): int(a) for n, a in zip(lengths, pattern, strict=True) if a}
            times = min([int(times), *(left.get(n, 0) // a for n, a in held.items())])
            if times > 0:
                plan.append((held, times))
                for n, a in held.items():
                    left[n] -= a * times
        left = {n: c for n, c in left.items() if c}
        while left:
            chosen = _fill(left, capacity)
            plan.append((chosen, 1))
            left = {n: c - chosen.get(n, 0) for n, c in left.items() if c > chosen.get(n, 0)}
    return plan


def _places(plan: list[tuple[dict[int, int], int]]) -> np.ndarray:
    """Rows (length, first rank, pieces a sequence, first sequence, offset), sorted by length and rank."""
    rows, ranks, sequence = [], {}, 0
    for pattern, times in plan:
        offset = 0
        for n in sorted(pattern, reverse=True):
            rows.append((n, ranks.get(n, 0), pattern[n], sequence, offset))
            ranks[n] = ranks.get(n, 0) + pattern[n] * times
            offset += n * pattern[n]
        sequence += times
    return np.array(sorted(rows), dtype=np.int64).reshape(-1, 5)


def pack(docs: DataFrame, vocabulary: str, capacity: int = CAPACITY) -> DataFrame:
    """Every piece of every document with its sequence and its place there.

    Returns doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset. Null and empty
    texts are the one id that ends a document. Rows that repeat a doc_id are packed one by one.
    Only doc_id and text are read; an empty table gives an empty result. A very long text is
    cut into as many full sequences as it needs.
    """
    block = F.pmod(F.xxhash64("doc_id"), F.lit(BLOCKS))
    cut = stable(pieces(docs, vocabulary, capacity), "pieces").withColumn("block", block)
    cells = stable(cut.groupBy("length", "block").agg(F.count("*").alias("n")), "piece-counts")
    # At most `capacity` rows.
    histogram = {r.length: r.n for r in cells.groupBy("length").agg(F.sum("n").alias("n")).collect()}
    places = _places(plan_sequences(histogram, capacity))
    keys = places[:, 0] << 48 | places[:, 1]

    before = Window.partitionBy("length").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    first = cells.select("length", "block", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("first"))
    inside = Window.partitionBy("length", "block").orderBy("doc_id", "start", "doc_tokens", "ids_crc32")
    ranked = cut.withColumn("nth", F.row_number().over(inside)).join(first, ["length", "block"])
    ranked = ranked.select(
        "doc_id", "start", "length", "ids_crc32", "doc_tokens", (F.col("first") + F.col("nth") - 1).alias("rank")
    )

    def placed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            length, rank = batch.column("length").to_numpy(), batch.column("rank").to_numpy()
            row = places[np.searchsorted(keys, length << 48 | rank, side="right") - 1]
            nth = rank - row[:, 1]
            sequence, offset = row[:, 3] + nth // row[:, 2], row[:, 4] + nth % row[:, 2] * length
            columns = [*batch.columns[:5], pa.array(sequence), pa.array(offset)]
            yield pa.RecordBatch.from_arrays(columns, [*batch.schema.names[:5], "sequence_id", "offset"])

    return ranked.mapInArrow(tidy(placed), PLACED)
