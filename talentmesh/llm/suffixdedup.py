"""Suffix-array dedup: bytes covered by a long string that starts anywhere else are removed.

A suffix array over the corpus would be one sort of all suffixes. Here the text is first cut
down, by content only, to what can still be in doubt:

1. Every string of LENGTH bytes has an *anchor*: the k-gram in it with the smallest hash. Equal
   strings have equal anchors in the same place. Consecutive starts with one anchor are a run,
   and a run's bytes are its context. Runs are counted by (anchor, hash of the context).
2. A context that occurs twice settles its run. Contexts that differ under one anchor are cut
   into slices of SLICE starts; all strings of a slice share a core, which joins the key.
3. Slices that differ under one core and share what lies next to it are sorted by suffix, the
   core as one symbol: neighbours in suffix order that agree over a whole string are repeats.

No step looks at more than one anchor's distinct contexts together, and where one core has
more than CROWD different slices they are split further, start by start.

All of this works on symbols, which are the bytes of a text or hashes of its words: ``BYTES``
finds repeated strings of 400 bytes, ``WORDS`` repeated passages of 50 words.
"""

from __future__ import annotations

import functools
import hashlib
import re
from collections import Counter
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from talentmesh.llm.common import body, maybe_among, shuffle_partitions, stable, tidy
from talentmesh.llm.suffixsort import suffix_array

LENGTH = 400
GRAM = 64
#: Words of a passage, and of the grams that anchor it.
PASSAGE_WORDS = 50
PASSAGE_GRAM = 8
#: Starts of a slice; at most as many as an integer has bits, and fewer than the length.
SLICE = 32
PASSAGE_SLICE = 32
#: Parts of a slice's starts that are ruled out together.
PARTS = 4
#: Rows that a task gathers before it hands them on.
HANDED_ON = 1 << 14
#: Different slices of one core that are sorted together, and symbols sorted at a time.
CROWD = 20_000
BATCH_SYMBOLS = 1 << 17
#: Starts of one document looked at together.
STRETCH = 1 << 22
_BASE = np.uint64(0x9E3779B97F4A7C15)
_INVERSE = np.uint64(pow(int(_BASE), -1, 1 << 64))

WORD = re.compile(rb"[^\x20\x09-\x0D]+")


def text_bytes(text: str) -> bytes:
    return text.encode("utf-8", "surrogatepass")


def word_hashes(text: str) -> bytes:
    """A 64-bit hash of every word ``[^\\x20\\x09-\\x0D]+``, in order."""
    words = text_bytes(text).split()
    return np.fromiter(map(xxhash.xxh64_intdigest, words), dtype="<u8", count=len(words)).tobytes()


@dataclass(frozen=True)
class Measure:
    """What counts as a repeat: ``length`` symbols of ``width`` bytes, anchored by grams of ``gram``, sorted by ``slice`` starts."""

    length: int
    gram: int
    slice: int
    width: int
    symbols: Callable[[str], bytes]


BYTES = Measure(LENGTH, GRAM, SLICE, 1, text_bytes)
WORDS = Measure(PASSAGE_WORDS, PASSAGE_GRAM, PASSAGE_SLICE, 8, word_hashes)


@functools.lru_cache(maxsize=2)
def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    ones = np.ones(n, dtype=np.uint64)
    ones[0] = 1
    up, down = np.full(n, _BASE), np.full(n, _INVERSE)
    up[0] = down[0] = 1
    return np.multiply.accumulate(up), np.multiply.accumulate(down)


def gram_hashes(data: np.ndarray, k: int) -> np.ndarray:
    """A hash of every k-gram: differences of one running sum, scaled to the start, and mixed."""
    up, down = _powers(1 << max(12, int(len(data)).bit_length()))
    total = np.zeros(len(data) + 1, dtype=np.uint64)
    np.cumsum((data.astype(np.uint64) + np.uint64(1)) * up[: len(data)], out=total[1:])
    h = (total[k:] - total[:-k]) * down[: len(data) - k + 1]
    h = (h ^ h >> np.uint64(32)) * np.uint64(0xD6E8FEB86659FD93)
    h = (h ^ h >> np.uint64(32)) * np.uint64(0xD6E8FEB86659FD93)
    return h ^ h >> np.uint64(32)


def sliding_least(values: np.ndarray, width: int) -> np.ndarray:
    """The least of every ``width`` consecutive values."""
    n = len(values)
    padded = np.full(-(-n // width) * width, np.iinfo(values.dtype).max, dtype=values.dtype)
    padded[:n] = values
    blocks = padded.reshape(-1, width)
    ahead = np.minimum.accumulate(blocks, axis=1).ravel()
    back = np.minimum.accumulate(blocks[:, ::-1], axis=1)[:, ::-1].ravel()
    return np.minimum(back[: n - width + 1], ahead[width - 1 : n])


def anchor_arrays(text: bytes, of: Measure = BYTES) -> Iterator[tuple[np.ndarray, ...]]:
    """Hash, anchor position, first start and last start of the runs of starts with one anchor, stretch by stretch."""
    data = np.frombuffer(text, dtype=f"<u{of.width}")
    for base in range(0, len(data) - of.length + 1, STRETCH):
        part = data[base : base + STRETCH + of.length - 1]
        h = gram_hashes(part, of.gram)
        # Of equal heads the first counts: in equal strings that is the same place.
        key = h & ~np.uint64((1 << 24) - 1) | np.arange(len(h), dtype=np.uint64)
        anchor = (sliding_least(key, of.length - of.gram + 1) & np.uint64((1 << 24) - 1)).astype(np.int64)
        edges = np.flatnonzero(np.concatenate([[True], anchor[1:] != anchor[:-1]]))
        ends = np.concatenate([edges[1:], [len(anchor)]]) - 1
        at = anchor[edges]
        yield h[at].view(np.int64), at + base, edges + base, ends + base


def anchor_runs(text: bytes, of: Measure = BYTES) -> Iterator[tuple[int, int, int, int]]:
    """(hash, anchor position, first start, last start) of every run of starts with one anchor."""
    for arrays in anchor_arrays(text, of):
        yield from zip(*(a.tolist() for a in arrays), strict=True)


def _contexts(raw: bytes, p: np.ndarray, lo: np.ndarray, hi: np.ndarray, of: Measure) -> list[bytes]:
    """A 128-bit hash of each run's symbols and of where its anchor lies in them."""
    spans = zip((lo * of.width).tolist(), ((hi + of.length) * of.width).tolist(), (p - lo).tolist(), strict=True)
    return [xxhash.xxh3_128_digest(raw[a:b], at) for a, b, at in spans]


def _runs(docs: DataFrame, of: Measure) -> DataFrame:
    names = ["anchor", "context", "doc_id", "mark", "p", "lo", "hi"]

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, marks = batch.column(0), batch.column(1)
            rows: list[int] = []
            parts: list[tuple[np.ndarray, ...]] = []
            contexts: list[bytes] = []

            def taken() -> pa.RecordBatch:
                none = np.zeros(0, dtype=np.int64)
                sizes = [len(part[0]) for part in parts]  # noqa: B023
                row = pa.array(np.repeat(np.array(rows, dtype=np.int64), sizes))  # noqa: B023
                h, p, lo, hi = (pa.array(np.concatenate([none, *x])) for x in (zip(*parts, strict=True) if parts else [()] * 4))  # noqa: B023
                return pa.RecordBatch.from_arrays([h, pa.array(contexts, pa.binary()), ids.take(row), marks.take(row), p, lo, hi], names)  # noqa: B023

            for i, text in enumerate(batch.column(2)):
                raw = of.symbols(text.as_py())
                for part in anchor_arrays(raw, of):
                    rows.append(i)
                    parts.append(part)
                    contexts.extend(_contexts(raw, *part[1:], of))
                if len(contexts) >= HANDED_ON:
                    yield taken()
                    rows, parts, contexts = [], [], []
            yield taken()

    return docs.mapInArrow(tidy(read), "anchor long, context binary, doc_id long, mark long, p long, lo long, hi long")


def _slices(of: Measure) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Cut contexts (spots of a document) into slices: key, left and right of the core, where, how many."""
    core_length = of.length - of.slice + 1

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: list[tuple] = []
            for doc_id, mark, text, spots in zip(*(batch.column(n) for n in ("doc_id", "mark", "text", "spots")), strict=True):
                raw = of.symbols(text.as_py())
                part = lambda lo, hi: raw[lo * of.width : hi * of.width]  # noqa: E731, B023
                doc_id, mark = doc_id.as_py(), mark.as_py()
                for spot in spots.as_py():
                    p, lo, hi = spot["p"], spot["lo"], spot["hi"]
                    for s in range((p - hi) // of.slice, (p - lo) // of.slice + 1):
                        at = p - of.slice * s
                        first, last = max(lo, at - of.slice + 1), min(hi, at)
                        key = xxhash.xxh3_128_digest(part(at, at + core_length) + spot["anchor"].to_bytes(8, "little", signed=True), s)
                        left, right = part(first, at), part(at + core_length, last + of.length)
                        out.append((key, left, right, doc_id, mark, at, spot["n"]))
                    if len(out) >= HANDED_ON:
                        yield _slice_batch(out)
                        out = []
            yield _slice_batch(out)

    return cut


SLICE_FIELDS = pa.schema([
    ("key", pa.binary()), ("before", pa.binary()), ("after", pa.binary()), ("doc_id", pa.int64()),
    ("mark", pa.int64()), ("at", pa.int64()), ("n", pa.int64()),
])
SLICE_SCHEMA = "key binary, before binary, after binary, doc_id long, mark long, at long, n long"


def _slice_batch(rows: list[tuple]) -> pa.RecordBatch:
    columns = list(zip(*rows, strict=True)) if rows else [[]] * len(SLICE_FIELDS)
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, SLICE_FIELDS, strict=True)], schema=SLICE_FIELDS)


def starts_of(before: bytes, after: bytes, of: Measure = BYTES) -> range:
    """Starts of a slice, as symbols before its core, whose whole string the slice holds."""
    return range(of.slice - 1 - len(after) // of.width, len(before) // of.width + 1)


def repeats_among(strings: list[tuple[bytes, bytes]], groups: list[int], of: Measure = BYTES) -> list[int]:
    """For each slice the bits of the starts whose string also starts in another of its group."""
    parts = [np.frombuffer(b"".join(s), dtype=f"<u{of.width}") for s in strings]
    seen, symbols = np.unique(np.concatenate(parts), return_inverse=True)
    # 0 ends a slice, and each group's core is one symbol above all others.
    left = np.array([len(before) // of.width for before, _ in strings])
    size = np.array([len(p) for p in parts])
    starts = np.cumsum(size + 2) - (size + 2)
    flat = np.zeros(int((size + 2).sum()), dtype=np.int64)
    core_at = starts + left
    inside = np.arange(int(size.sum())) - np.repeat(np.cumsum(size) - size, size)
    flat[np.repeat(starts, size) + inside + (inside >= np.repeat(left, size))] = symbols + 1
    flat[core_at] = len(seen) + 1 + np.array(groups)
    rank = np.empty(len(flat), dtype=np.int64)
    rank[suffix_array(flat.tolist())] = np.arange(len(flat))
    owner = np.concatenate([np.full(len(starts_of(*s, of)), i) for i, s in enumerate(strings)])
    bit = np.concatenate([np.array(starts_of(*s, of), dtype=np.int64) for s in strings])
    place = core_at[owner] - bit
    order = np.argsort(rank[place])
    place, owner, bit = place[order], owner[order], bit[order]
    window = flat[place[:, None] + np.arange(of.slice)]
    same = np.concatenate([[False], (window[1:] == window[:-1]).all(axis=1), [False]])
    hit = same[1:] | same[:-1]
    masks = np.zeros(len(strings), dtype=np.int64)
    np.bitwise_or.at(masks, owner[hit], np.int64(1) << bit[hit])
    return masks.tolist()


def in_doubt(keys: list[bytes], strings: list[tuple[bytes, bytes]], of: Measure = BYTES) -> list[tuple[int, tuple[bytes, bytes]]]:
    """Slices with a start that may be repeated under their core: their numbers and what of them is in doubt.

    The starts are looked at in PARTS parts. All strings of a part share the symbols next to the
    core; where no other slice of the core has these, no string of the part is repeated.
    """
    step = of.slice // PARTS
    parts: list[list[int]] = [[] for _ in strings]
    for part in range(PARTS):
        ahead, behind = part * step * of.width, (of.slice - (part + 1) * step) * of.width
        near = [
            (key, before[len(before) - ahead :], after[:behind]) if len(before) >= ahead and len(after) >= behind else None
            for key, (before, after) in zip(keys, strings, strict=True)
        ]
        uses = Counter(near)
        for own, shared in zip(parts, near, strict=True):
            if shared is not None and uses[shared] > 1:
                own.append(part)
    out = []
    for i, (own, (before, after)) in enumerate(zip(parts, strings, strict=True)):
        if own:
            most = ((own[-1] + 1) * step - 1) * of.width
            out.append((i, (before[max(0, len(before) - most) :], after[: (of.slice - 1 - own[0] * step) * of.width])))
    return out


def _sorted_repeats(of: Measure) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Rows (key, before, after) sorted by key -> the same with ``bits``, keys kept whole."""

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys: list[bytes] = []
        strings: list[tuple[bytes, bytes]] = []
        size = 0

        def solved() -> pa.RecordBatch:
            doubt = in_doubt(keys, strings, of)
            own = [keys[i] for i, _ in doubt]
            groups = np.cumsum([0, *(a != b for a, b in zip(own, own[1:], strict=False))]).tolist()
            bits = repeats_among([s for _, s in doubt], groups, of) if doubt else []
            return pa.RecordBatch.from_arrays(
                [pa.array(own, pa.binary()), pa.array([strings[i][0] for i, _ in doubt], pa.binary()),
                 pa.array([strings[i][1] for i, _ in doubt], pa.binary()), pa.array(bits, pa.int64())],
                ["key", "before", "after", "bits"],
            )

        for batch in batches:
            for key, before, after in zip(*(batch.column(n).to_pylist() for n in ("key", "before", "after")), strict=True):
                if size > BATCH_SYMBOLS and key != keys[-1]:
                    yield solved()
                    keys, strings, size = [], [], 0
                keys.append(key)
                strings.append((before, after))
                size += (len(before) + len(after)) // of.width + 2
        if keys:
            yield solved()

    return search


def _single_starts(of: Measure) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Slices of a crowded core, one row a start: the whole string is in the key."""

    def split(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for row in batch.to_pylist():
                for b in starts_of(row["before"], row["after"], of):
                    before = row["before"][len(row["before"]) - b * of.width :]
                    after = row["after"][: (of.slice - 1 - b) * of.width]
                    key = hashlib.md5(row["key"] + bytes([b]) + before + after).digest()
                    out.append((key, before, after, row["doc_id"], row["mark"], row["at"], row["n"]))
            yield _slice_batch(out)

    return split


def _with_bits(slices: DataFrame, crowded: bool, of: Measure) -> DataFrame:
    """Slices whose document is the only one with its context, with bits for repeated starts."""
    kinds = stable(
        slices.groupBy("key", "before", "after").agg(F.sum("n").alias("copies"))
        .withColumn("kinds", F.count("*").over(Window.partitionBy("key"))).where("kinds > 1 OR copies > 1"),
        "slice-kinds",
    )
    settled = kinds.where("copies > 1").select("key", "before", "after", F.lit(-1).cast("long").alias("bits"))
    open_kinds = kinds.where("kinds > 1").select("key", "before", "after")
    open_kinds = open_kinds.repartition(shuffle_partitions(slices.sparkSession), "key").sortWithinPartitions("key")
    found = open_kinds.mapInArrow(tidy(_sorted_repeats(of)), "key binary, before binary, after binary, bits long").where("bits <> 0")
    bits = settled if crowded else settled.union(found)
    bits = bits.groupBy("key", "before", "after").agg(F.bit_or("bits").alias("bits"))
    return slices.where("n = 1").join(bits, ["key", "before", "after"]).select("doc_id", "mark", "at", "before", "after", "bits")


def repeated_ranges(docs: DataFrame, of: Measure = BYTES) -> DataFrame:
    """(doc_id, mark, spans): where repeated strings start. ``docs`` holds doc_id, mark and text, no nulls in text.

    ``spans`` are (lo, hi, bits): all starts from lo to hi if bits is null, else lo - b for each
    set bit b, where hi - 32 + 1 <= lo - b <= hi is what the slice held.
    """
    # A run is named by one number, so counting moves narrow rows and hashes them instead of sorting them.
    runs = stable(_runs(docs.select("doc_id", "mark", "text"), of).withColumn("run", F.monotonically_increasing_id()), "runs")
    kinds = runs.groupBy("anchor", "context").agg(F.count("*").alias("n"), F.min("run").alias("first"))
    by_anchor = Window.partitionBy("anchor")
    kinds = kinds.withColumn("kinds", F.count("*").over(by_anchor)).where("kinds > 1 OR n > 1")
    kinds = kinds.select("anchor", "context", "n", F.when(F.col("kinds") > 1, F.col("first")).alias("first"))
    kinds = stable(kinds, "contexts")

    known = runs.join(kinds.hint("shuffle_merge"), ["anchor", "context"])
    known = known.select("doc_id", "mark", "p", "lo", "hi", "anchor", "n", F.col("run").eqNullSafe(F.col("first")).alias("leads"))
    known = stable(known.where("n > 1 OR leads"), "known-runs")
    whole = known.where("n > 1").select("doc_id", "mark", F.struct("lo", "hi", F.lit(None).cast("long").alias("bits")).alias("span"))

    spots = known.where("leads").groupBy("doc_id", "mark").agg(F.collect_list(F.struct("anchor", "p", "lo", "hi", "n")).alias("spots"))
    spots = stable(spots, "spots")
    texts = docs.where(maybe_among(spots.select("mark"), "mark"))
    cut = texts.join(spots, texts["doc_id"].eqNullSafe(spots["doc_id"]) & (texts["mark"] == spots["mark"]))
    cut = cut.select(texts["doc_id"], texts["mark"], "text", "spots").dropDuplicates(["doc_id", "mark"])
    slices = stable(cut.mapInArrow(tidy(_slices(of)), SLICE_SCHEMA), "slices")

    crowds = slices.select("key", "before", "after").distinct().groupBy("key").count().where(F.col("count") > CROWD).select("key")
    crowds = stable(crowds, "crowds")
    if crowds.isEmpty():
        partly = _with_bits(slices, False, of)
    else:
        sparse = slices.join(crowds, "key", "left_anti")
        dense = slices.join(crowds, "key", "left_semi").mapInArrow(tidy(_single_starts(of)), SLICE_SCHEMA)
        partly = _with_bits(sparse, False, of).union(_with_bits(dense, True, of))
    wide = lambda c: F.octet_length(c) / of.width
    held = (F.col("at") - wide("before")).cast("long").alias("lo"), (F.col("at") + wide("after") - of.slice + 1).cast("long").alias("hi")
    partly = partly.select("doc_id", "mark", F.when(F.col("bits") == -1, F.struct(*held, F.lit(None).cast("long").alias("bits"))).otherwise(
        F.struct(F.col("at").alias("lo"), F.col("at").alias("hi"), "bits")).alias("span"))
    return whole.union(partly).groupBy("doc_id", "mark").agg(F.collect_list("span").alias("spans"))


def removed_runs(spans: list[dict], length: int = LENGTH) -> list[tuple[int, int]]:
    """Maximal runs of covered symbols, as (from, to)."""
    starts = []
    for s in spans:
        if s["bits"] is None:
            starts.append((s["lo"], s["hi"]))
        else:
            starts += [(s["lo"] - b, s["lo"] - b) for b in range(SLICE) if s["bits"] >> b & 1]
    out: list[list[int]] = []
    for lo, hi in sorted(starts):
        if out and lo <= out[-1][1]:
            out[-1][1] = max(out[-1][1], hi + length)
        else:
            out.append([lo, hi + length])
    return [tuple(r) for r in out]


def whole_characters(data: bytes, runs: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Runs of UTF-8 bytes shrunk to the characters that lie in them whole."""
    out = []
    for lo, hi in runs:
        while lo < hi and data[lo] & 0xC0 == 0x80:
            lo += 1
        while lo < hi < len(data) and data[hi] & 0xC0 == 0x80:
            hi -= 1
        out.append((lo, hi))
    return out


def _marked_texts(docs: DataFrame) -> DataFrame:
    """doc_id, mark (a hash of the text), text and rest (the other columns, whatever their names)."""
    others = [F.col(c) for c in docs.columns if c not in ("doc_id", "text")]
    rest = F.struct(*others) if others else F.lit(None).cast("string")
    return docs.select(
        F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64(body()).alias("mark"), body().alias("text"), rest.alias("rest")
    )


def _with_spans(texts: DataFrame, ranges: DataFrame, columns: list[str]) -> tuple[DataFrame, DataFrame]:
    """Texts that may have repeats, with what ``ranges`` says of them, and the others."""
    hit = maybe_among(ranges.select("mark"), "mark")
    maybe = texts.where(hit)
    joined = maybe.join(ranges, maybe["doc_id"].eqNullSafe(ranges["doc_id"]) & (maybe["mark"] == ranges["mark"]), "left")
    return joined.select(maybe["doc_id"], "text", *columns, "rest"), texts.where(~hit)


def without_repeats(docs: DataFrame, characters: bool = False, passages: bool = False) -> DataFrame:
    """Every document less the bytes that a repeated string of LENGTH bytes covers.

    Returns one row per input row: doc_id, n_bytes, n_removed, n_spans (maximal removed runs),
    kept (the remaining bytes), n_passage_words, rest (the other columns, whatever their names).
    With ``characters`` a character goes only if all its bytes do, so that ``kept`` is text.
    With ``passages``, n_passage_words counts the words that lie in a passage of PASSAGE_WORDS
    words which also starts elsewhere, however few bytes it has; else it is null. Null text is
    empty. Rows that repeat doc_id and text repeat each other's strings, so all of both goes, if
    long enough; rows that share a doc_id with other text are kept apart by a hash of the text.
    An empty table gives an empty result. Contexts are compared by 128-bit hash, slices symbol
    by symbol.
    """
    texts = _marked_texts(docs)
    ranges = stable(repeated_ranges(texts), "ranges").withColumn("words", F.lit(None).cast("array<struct<lo: long, hi: long, bits: long>>"))
    if passages:
        words = stable(repeated_ranges(texts, WORDS), "passages").withColumnRenamed("spans", "words")
        both = ranges.drop("words").unionByName(words, allowMissingColumns=True)
        ranges = stable(both.groupBy("doc_id", "mark").agg(F.first("spans", True).alias("spans"), F.first("words", True).alias("words")), "all-ranges")
    schema = T.StructType.fromDDL(
        "doc_id long, n_bytes long, n_removed long, n_spans long, kept binary, n_passage_words long").add(texts.schema["rest"])
    raw, zero = F.col("text").cast("binary"), F.lit(0).cast("long")
    joined, others = _with_spans(texts, ranges, ["spans", "words"])
    none = zero if passages else F.lit(None).cast("long")
    untouched = others.select("doc_id", F.octet_length(raw).cast("long"), zero, zero, raw, none, "rest")

    def remove(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for text, spans, words in zip(*(batch.column(c) for c in ("text", "spans", "words")), strict=True):
                data, at, kept = text_bytes(text.as_py()), 0, []
                gone = removed_runs(spans.as_py() or [])
                gone = whole_characters(data, gone) if characters else gone
                for lo, hi in gone:
                    kept.append(data[at:lo])
                    at = hi
                kept.append(data[at:])
                in_passages = sum(hi - lo for lo, hi in removed_runs(words.as_py() or [], WORDS.length)) if passages else None
                out.append((len(data), sum(hi - lo for lo, hi in gone), len(gone), b"".join(kept), in_passages))
            kinds = (pa.int64(), pa.int64(), pa.int64(), pa.binary(), pa.int64())
            columns = list(zip(*out, strict=True)) if out else [[]] * 5
            made = [pa.array(c, k) for c, k in zip(columns, kinds, strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *made, batch.column("rest")], schema.names)

    return joined.mapInArrow(tidy(remove), schema).union(untouched)


def _renamed(done: DataFrame, docs: DataFrame) -> DataFrame:
    """doc_id, text and rest as the columns of ``docs``; n_chars, if there, counts what is left."""
    made = {"doc_id": F.col("doc_id").cast(docs.schema["doc_id"].dataType), "text": F.col("text")}
    if "n_chars" in docs.columns:
        made["n_chars"] = F.length("text").cast(docs.schema["n_chars"].dataType)
    return done.select(*[made.get(c, F.col(f"rest.`{c}`")).alias(c) for c in docs.columns])


def remaining_texts(docs: DataFrame) -> DataFrame:
    """``docs`` less repeated strings of LENGTH bytes, whole characters only, columns as they came.

    A document stays, with what is left of its text, even if that is nothing; null text becomes
    empty. Rows that share a doc_id are told apart by their text. An empty table gives an empty result.
    """
    return _renamed(without_repeats(docs, characters=True).withColumn("text", F.col("kept").cast("string")), docs)


def without_words(text: str, runs: list[tuple[int, int]]) -> str:
    """``text`` less the words of ``runs`` (from, to), each run up to the next word that stays."""
    data = text_bytes(text)
    starts = [m.start() for m in WORD.finditer(data)] + [len(data)]
    at, kept = 0, []
    for lo, hi in runs:
        kept.append(data[at : starts[lo]])
        at = starts[hi]
    return b"".join([*kept, data[at:]]).decode("utf-8", "surrogatepass")


def without_passages(docs: DataFrame) -> DataFrame:
    """``docs`` less repeated passages of PASSAGE_WORDS words, columns as they came.

    A word ``[^\\x20\\x09-\\x0D]+`` goes if it lies in a passage of that many words which also
    starts anywhere else, same document included, with the blanks after it. Words are compared
    by 64-bit hashes, fifty at a time. A document stays, with what is left of its text, even if
    that is nothing; null text becomes empty. Rows that share a doc_id are told apart by their
    text. An empty table gives an empty result.
    """
    texts = _marked_texts(docs)
    ranges = stable(repeated_ranges(texts, WORDS), "passages")
    joined, untouched = _with_spans(texts, ranges, ["spans"])
    schema = T.StructType.fromDDL("doc_id long, text string").add(texts.schema["rest"])

    def remove(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            left = [
                without_words(text.as_py(), removed_runs(spans.as_py() or [], WORDS.length))
                for text, spans in zip(batch.column("text"), batch.column("spans"), strict=True)
            ]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(left, pa.string()), batch.column("rest")], schema.names)

    return _renamed(joined.mapInArrow(tidy(remove), schema).union(untouched.select("doc_id", "text", "rest")), docs)
