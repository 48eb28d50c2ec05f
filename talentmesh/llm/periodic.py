"""Periodic runs of words, found on sparse diagonals in one pass over each scale.

A run is a stretch of words with smallest period q, at least four periods and six words long,
that cannot be extended. On the diagonal of lag q it is a streak of equal pairs (a word and the
one q before it). Of all earlier occurrences of a word, only few lie on a diagonal that can
become a run: with g the power of two from q up, the g words from there on recur q earlier and
nowhere nearer, since the root of a run does not recur inside its own square. So at scale g each
place looks up the last earlier occurrence of its g words; a lag in (g/2, g] increments the match
length of that diagonal, and a diagonal that ends is emitted at once if it is long enough. A place
whose g words have no second occurrence in its text leaves all larger scales. The work is n words
a scale at most, also where one word makes up the text.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from talentmesh.llm.common import body, tidy

PERIODS = 4
LEAST = 6
#: Words of neighbouring texts that are looked at together; a longer text is on its own.
TOGETHER = 1 << 18


def ended_diagonals(places: np.ndarray, lags: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(first place, last place, lag) of every streak of neighbouring places on one diagonal."""
    if not len(places):
        return places, places, lags
    breaks = np.flatnonzero((np.diff(places) != 1) | (np.diff(lags) != 0))
    first, last = np.concatenate([[0], breaks + 1]), np.concatenate([breaks, [len(places) - 1]])
    return places[first], places[last], lags[first]


def runs_of(words: np.ndarray) -> np.ndarray:
    """Rows (start, length, period) of all runs among word numbers, by start and period.

    Several texts may follow one another if no number occurs in two of them.
    """
    found = []
    places, numbers, g = np.arange(len(words), dtype=np.int64), words.astype(np.int64), 1
    while len(places):
        order = np.argsort(numbers, kind="stable")
        by_number, at = numbers[order], places[order]
        again = by_number[1:] == by_number[:-1]
        lag = np.zeros(len(at), dtype=np.int64)
        lag[1:][again] = (at[1:] - at[:-1])[again]
        nearest = np.empty_like(lag)
        nearest[order] = lag
        alive = np.flatnonzero((nearest > g // 2) & (nearest <= g))
        first, last, period = ended_diagonals(places[alive], nearest[alive])
        length = last - first + g + period
        whole = length >= np.maximum(LEAST, PERIODS * period)
        found.append(np.column_stack([first - period, length, period])[whole])
        # The next scale: g more words, for places whose words occur twice on both halves.
        twice = np.zeros(len(at), dtype=bool)
        twice[1:] |= again
        twice[:-1] |= again
        kept = np.zeros(len(at), dtype=bool)
        kept[order] = twice
        places, numbers = places[kept], numbers[kept]
        follows = np.searchsorted(places, places + g)
        paired = follows < len(places)
        paired[paired] = places[follows[paired]] == places[paired] + g
        pair = np.column_stack([numbers[paired], numbers[follows[paired]]])
        places = places[paired]
        if len(places):
            _, numbers = np.unique(pair[:, 0] * (int(pair.max()) + 1) + pair[:, 1], return_inverse=True)
        g *= 2
    runs = np.concatenate(found) if found else np.zeros((0, 3), dtype=np.int64)
    return runs[np.lexsort((runs[:, 2], runs[:, 0]))]


def kept_words(n: int, runs: np.ndarray) -> np.ndarray:
    """Which of ``n`` words stay: all but those that a run holds after its first period."""
    edge = np.zeros(n + 1, dtype=np.int64)
    np.add.at(edge, runs[:, 0] + runs[:, 2], 1)
    np.add.at(edge, runs[:, 0] + runs[:, 1], -1)
    return np.cumsum(edge[:n]) == 0


RUN = pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())])
FOUND = pa.schema([("doc_id", pa.int64()), ("n_words", pa.int64()), ("runs", pa.list_(RUN)), ("collapsed", pa.string())])


def _found(texts: list[tuple[int | None, list[bytes]]]) -> pa.RecordBatch:
    numbers: list[int] = []
    starts, top = [0], 0
    for _, words in texts:
        own: dict[bytes, int] = {}
        numbers.extend([own.setdefault(w, len(own) + top) for w in words])
        top += len(own)
        starts.append(len(numbers))
    runs = runs_of(np.array(numbers, dtype=np.int64))
    edges = np.searchsorted(runs[:, 0], starts)
    spans, collapsed = [], []
    for i, (_, words) in enumerate(texts):
        own_runs = runs[edges[i] : edges[i + 1]] - [starts[i], 0, 0]
        if len(own_runs):
            stay = kept_words(len(words), own_runs)
            words = [w for w, s in zip(words, stay.tolist(), strict=True) if s]
        spans.append([dict(zip(("start", "length", "period"), r, strict=True)) for r in own_runs.tolist()])
        collapsed.append(b" ".join(words).decode())
    ids, sizes = pa.array([d for d, _ in texts], pa.int64()), pa.array(np.diff(starts), pa.int64())
    return pa.RecordBatch.from_arrays([ids, sizes, pa.array(spans, pa.list_(RUN)), pa.array(collapsed, pa.string())], schema=FOUND)


def periodic_runs(docs: DataFrame) -> DataFrame:
    """Every periodic run of every text, and the text with each run cut to one period.

    Words are stretches of ``[^\\x20\\x09-\\x0D]``, numbered from 0. Returns one row per document:
    doc_id, n_words, runs (array of start, length, period, by start and period), collapsed (the
    words that no run holds after its first period, joined by one space). Null, empty and blank
    texts have no words, no runs and an empty text. Only doc_id and text are read, so other
    columns cannot clash; null and repeated doc_ids are rows like any other. Texts never meet,
    so nothing is shuffled. An empty table gives an empty result.
    """

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            together: list[tuple[int | None, list[bytes]]] = []
            size = 0
            for doc_id, text in zip(batch.column(0), batch.column(1), strict=True):
                words = text.as_py().split()  # bytes split at exactly the six ASCII blanks
                if together and size + len(words) > TOGETHER:
                    yield _found(together)
                    together, size = [], 0
                together.append((doc_id.as_py(), words))
                size += len(words)
            yield _found(together)

    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), body().cast("binary").alias("text"))
    schema = "doc_id long, n_words long, runs array<struct<start: long, length: long, period: long>>, collapsed string"
    return texts.mapInArrow(tidy(find), schema)
