"""Language identification by cross-parsing: how few phrases of a language's training text make up a text.

A text is parsed, greedily and from left to right, into the longest pieces that occur in the
training text of a language. A suffix automaton finds them: following its transitions reads a
piece, and where none leads on, a phrase ends. The number of phrases, times the logarithm of
the training length and per symbol, estimates the cross entropy; the smallest wins.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from talentmesh.llm.common import body, fold_of, stable, tidy

#: Training text: rows a language, and characters a language, at most.
TRAIN_ROWS = 64
TRAIN_CHARS = 24_000
#: A model over this size is refused: it goes to every worker.
MAX_MODEL_BYTES = 256 << 20
#: Texts are parsed in segments of so many symbols; a phrase ends where a segment ends.
SEGMENT = 2_048
#: Bytes of text that are parsed side by side.
CHUNK = 4 << 20
NO_LANGUAGE = "und"


@dataclass(frozen=True)
class Model:
    """``steps[base[l] + state * classes + symbol]`` is 4 times the next state plus the phrases that end.

    State 0 is between phrases. A symbol that leads nowhere ends the phrase before it and opens
    the next one, or is a phrase by itself if the language has no such symbol.
    """

    languages: list[str]
    symbol: np.ndarray
    classes: int
    base: np.ndarray
    steps: np.ndarray
    weight: np.ndarray


def suffix_automaton(text: np.ndarray, classes: int) -> np.ndarray:
    """Transitions (states x classes) of the smallest automaton of all substrings; -1 where there is none."""
    nexts: list[dict[int, int]] = [{}]
    link, length, last = [-1], [0], 0
    for c in text.tolist():
        new, p = len(nexts), last
        nexts.append({})
        length.append(length[last] + 1)
        link.append(0)
        while p >= 0 and c not in nexts[p]:
            nexts[p][c] = new
            p = link[p]
        if p >= 0:
            q = nexts[p][c]
            if length[q] == length[p] + 1:
                link[new] = q
            else:
                clone = len(nexts)
                nexts.append(dict(nexts[q]))
                length.append(length[p] + 1)
                link.append(link[q])
                link[q] = link[new] = clone
                while p >= 0 and nexts[p].get(c) == q:
                    nexts[p][c] = clone
                    p = link[p]
        last = new
    table = np.full((len(nexts), classes), -1, dtype=np.int64)
    for state, to in enumerate(nexts):
        if to:
            table[state, list(to)] = list(to.values())
    return table


def symbols(text: str, symbol: np.ndarray) -> np.ndarray:
    """Lower-case bytes as classes, a run of bytes that are no letters as one 0."""
    seq = symbol[np.frombuffer(text.lower().encode("utf-8", "surrogatepass"), dtype=np.uint8)]
    if not len(seq):
        return seq
    stays = seq != 0
    stays[0] = True
    stays[1:] |= seq[:-1] != 0
    return seq[stays]


def fit(texts: dict[str, list[str]]) -> Model:
    """Automata of the given training texts; languages in alphabetical order."""
    languages = sorted(texts)
    seen = np.zeros(256, dtype=bool)
    for rows in texts.values():
        for t in rows:
            seen[np.unique(np.frombuffer(t.lower().encode("utf-8", "surrogatepass"), dtype=np.uint8))] = True
    symbol = np.zeros(256, dtype=np.uint8)
    letters = [*range(ord("a"), ord("z") + 1), *(b for b in range(128, 256) if seen[b])]
    symbol[letters] = np.arange(1, len(letters) + 1)
    unknown = len(letters) + 1
    symbol[[b for b in range(128, 256) if not seen[b]]] = unknown
    classes = unknown + 1
    base, steps, weight, at = [], [], [], 0
    for language in languages:
        text = np.concatenate([symbols("\n" + t, symbol) for t in texts[language]])
        table = suffix_automaton(text, classes)
        unseen = table[0] < 0
        again = np.where(unseen, 0, table[0])
        ends = np.where(table < 0, 1 + unseen[None, :], 0)
        ends[0] = unseen
        step = np.where(table < 0, again[None, :], table) * 4 + ends
        base.append(at)
        steps.append(step.astype(np.int32).ravel())
        weight.append(np.log2(max(2, len(text))))
        at += step.size
        if at * 4 > MAX_MODEL_BYTES:
            raise ValueError(f"{len(languages)} languages make a model over {MAX_MODEL_BYTES} bytes")
    return Model(languages, symbol, classes, np.array(base), np.concatenate(steps), np.array(weight))


def phrases(model: Model, texts: list[str]) -> np.ndarray:
    """Weighted phrases a symbol, texts x languages; all texts are parsed side by side."""
    parts = [symbols(t, model.symbol) for t in texts]
    owner, cut = [], []
    for i, p in enumerate(parts):
        for start in range(0, max(1, len(p)), SEGMENT):
            owner.append(i)
            cut.append(p[start : start + SEGMENT])
    lengths = np.array([len(c) for c in cut])
    order = np.argsort(-lengths, kind="stable")
    lengths, owner_of = lengths[order], np.array(owner)[order]
    columns = np.zeros((max(1, int(lengths[0])), len(cut)), dtype=np.uint8)
    for at, i in enumerate(order):
        columns[: len(cut[i]), at] = cut[i]
    n_languages = len(model.languages)
    state = np.zeros((n_languages, len(cut)), dtype=np.int64)
    count = np.zeros((n_languages, len(cut)), dtype=np.int64)
    base = model.base[:, None]
    active = np.searchsorted(-lengths, -np.arange(1, len(columns) + 1), side="right")
    for t, n in enumerate(active.tolist()):
        if not n:
            break
        step = model.steps[base + state[:, :n] * model.classes + columns[t, :n]]
        count[:, :n] += step & 3
        state[:, :n] = step >> 2
    count += state > 0
    total = np.zeros((len(texts), n_languages))
    np.add.at(total, owner_of, count.T)
    size = np.bincount(np.array(owner), weights=[len(c) for c in cut], minlength=len(texts))
    return total * model.weight / np.maximum(size, 1)[:, None]


def training_texts(docs: DataFrame, rows: int = TRAIN_ROWS, chars: int = TRAIN_CHARS) -> dict[str, list[str]]:
    """A bounded sample of each language's labelled documents outside fold 1: at most ``rows`` of them and ``chars`` characters."""
    held = (fold_of() == 1) & F.col("doc_id").isNotNull()
    known = docs.select("doc_id", "lang", body().alias("text"))
    known = known.where(F.col("lang").isNotNull() & ~held & F.col("text").rlike(r"\p{L}"))
    key = F.xxhash64("doc_id")
    ids = known.select("doc_id", "lang").withColumn(
        "nth", F.row_number().over(Window.partitionBy("lang").orderBy(key, "doc_id"))
    )
    picked = stable(ids.where(F.col("nth") <= rows).select("doc_id", "lang").distinct(), "training-ids")
    each = chars // rows
    start = F.pmod(key, F.greatest(F.length("text") - each, F.lit(0)) + 1).cast("int") + 1
    sample = known.join(F.broadcast(picked), ["doc_id", "lang"]).select("lang", "doc_id", F.substring("text", start, F.lit(each)).alias("part"))
    out: dict[str, list[str]] = {}
    for r in sample.orderBy("lang", "doc_id", "part").collect():
        out.setdefault(r["lang"], []).append(r["part"])
    return {lang: parts[:rows] for lang, parts in out.items()}


def fitted(docs: DataFrame) -> Model | None:
    """The model of the labelled documents outside fold 1; none if there are none."""
    texts = training_texts(docs)
    return fit(texts) if texts else None


def _predicted(rows: DataFrame, model: Model | None) -> DataFrame:
    """``rows`` (text, null where nothing is to be told, and row) as row, lang_pred, score."""
    shared = rows.sparkSession.sparkContext.broadcast(model)

    def answer(texts: list[str]) -> tuple[list[str], list[float]]:
        cost = phrases(shared.value, texts)
        best = cost.argmin(axis=1)
        lowest = cost.min(axis=1)
        if cost.shape[1] > 1:
            cost[np.arange(len(texts)), best] = np.inf
            score = 1 - lowest / cost.min(axis=1)
        else:
            score = np.ones(len(texts))
        return [shared.value.languages[b] for b in best], score.tolist()

    def predict(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            langs, scores = [NO_LANGUAGE] * batch.num_rows, [0.0] * batch.num_rows
            held, texts, size = [], [], 0

            def flush() -> None:
                if texts and shared.value is not None:
                    for i, lang, score in zip(held, *answer(texts), strict=True):
                        langs[i], scores[i] = lang, score

            for i, text in enumerate(batch.column("text")):
                if text.is_valid:
                    held.append(i)
                    texts.append(text.as_py())
                    size += len(texts[-1])
                    if size >= CHUNK:
                        flush()
                        held, texts, size = [], [], 0
            flush()
            yield pa.RecordBatch.from_arrays(
                [batch.column("row"), pa.array(langs), pa.array(scores, pa.float64())], ["row", "lang_pred", "score"])

    schema = T.StructType([rows.schema["row"], *T.StructType.fromDDL("lang_pred string, score double")])
    return rows.mapInArrow(tidy(predict), schema)


def identify(docs: DataFrame, model: Model | None = None) -> DataFrame:
    """The language of every whole text: doc_id, held_out, lang_pred, score.

    ``score`` is the share of phrases that the best language needs less than the next (1 if only
    one language was learned). A text that is null or holds no letter is ``und`` with score 0,
    as is every text if nothing could be learned. Equal phrase counts go to the language first
    in the alphabet. Only doc_id, text and, for learning, lang are read. Repeated rows get
    equal answers; a null doc_id is not held out. The model, unless given, is fitted on the
    bounded sample of ``training_texts``.
    """
    model = fitted(docs) if model is None else model
    row = F.struct("doc_id", F.coalesce(fold_of() == 1, F.lit(False)).alias("held_out")).alias("row")
    return _predicted(docs.select(row, told_text().alias("text")), model).select("row.*", "lang_pred", "score")


def told_text() -> Column:
    """The text, if it holds a letter."""
    return F.when(F.col("text").rlike(r"\p{L}"), F.col("text"))


def with_language(docs: DataFrame, languages: Sequence[str] | None = None) -> DataFrame:
    """``docs`` in a language, columns as they came; an absent ``lang`` becomes the predicted one.

    A text that is null or holds no letter goes. With ``languages``, so does a text predicted to
    be in none of them. If nothing can be learned, no text is known to be in another language:
    all with a letter stay, and ``lang`` as it is. Rows are decided one by one, whatever their
    doc_id; an empty table gives an empty result.
    """
    model = fitted(docs)
    told = _predicted(docs.select(F.struct(*docs.columns).alias("row"), told_text().alias("text")).where("text IS NOT NULL"), model)
    if model is None:
        return told.select("row.*")
    wanted = F.lit(True) if languages is None else F.col("lang_pred").isin(*languages)
    named = lambda c: F.coalesce(F.col("row.lang"), F.col("lang_pred")).alias(c) if c == "lang" else F.col(f"row.`{c}`").alias(c)
    return told.where(wanted).select(*[named(c) for c in docs.columns])
