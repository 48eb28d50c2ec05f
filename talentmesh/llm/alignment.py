"""Cross-tokenizer alignment: which ids of two vocabularies stand for the same bytes, and how often.

Both token sequences of a text are cut into groups wherever a token of each ends at one byte.
The tokens of a group are linked, every one of A with every one of B.

Links are kept as inverted lists. Documents are numbered inside blocks; every id pair of a block
has a compressed bitmap of the documents that hold it linked, and multiplicity planes: one
bitmap for each binary digit of the links beyond the first. The links of a block's documents are
merged into one bitmap a pair, whose bits are counted. Blocks hold different documents, so a
pair's count over the corpus is the sum over its blocks. The counts then return along the
postings to the blocks, where each bitmap adds its share to the documents it names.
"""

from __future__ import annotations

import functools
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from talentmesh.llm.common import body, stable, tidy
from talentmesh.llm.tokens import byte_level_ids

#: A block ends with this many documents, or tokens of A. A list of places takes 16 bits.
BLOCK_DOCUMENTS = 4096
BLOCK_TOKENS = 1 << 20
#: Bits that a list of places may take before a bit map is shorter.
_FULL = BLOCK_DOCUMENTS // 16
_SIDE = 1 << 20
_SIDE_A = 1 << 17
#: Links of a group from which on its ids are counted before they are paired.
LARGE_GROUP = 256
#: Tokens of A whose texts are aligned together.
TOGETHER = 1 << 16


class PieceIds:
    """Ids of a sentencepiece vocabulary and the bytes that each stands for."""

    def __init__(self, path: str) -> None:
        import sentencepiece

        self._model = sentencepiece.SentencePieceProcessor(model_file=path)
        self.bytes_of = [self._bytes(i) for i in range(self._model.get_piece_size())]

    def _bytes(self, i: int) -> bytes:
        piece = self._model.id_to_piece(i)
        return bytes([int(piece[3:5], 16)]) if self._model.is_byte(i) else piece.replace("▁", " ").encode()

    def encode(self, text: str) -> list[int]:
        return self._model.encode(text, num_threads=1)


@functools.lru_cache(maxsize=2)
def piece_ids(path: str) -> PieceIds:
    return PieceIds(path)


class Groups:
    """Tokens of several texts, cut into groups where a token of each side ends at one byte.

    ``a`` and ``b`` hold the ids of all texts, ``of_a`` and ``of_b`` the text of each token; the
    tokens of a text cover the same bytes on both sides.
    """

    def __init__(self, a: list[np.ndarray], b: list[np.ndarray], size_a: np.ndarray, size_b: np.ndarray) -> None:
        self.texts = len(a)
        self.of_a, self.of_b = (np.repeat(np.arange(len(x)), [len(t) for t in x]) for x in (a, b))
        self.a, self.b = (np.concatenate([np.zeros(0, dtype=np.int64), *x]) for x in (a, b))
        ends_a, ends_b = np.cumsum(size_a[self.a]), np.cumsum(size_b[self.b])
        n = int(ends_a[-1]) + 1 if len(ends_a) else 1
        at_a, at_b = np.zeros(n, dtype=bool), np.zeros(n, dtype=bool)
        at_a[ends_a] = at_b[ends_b] = True
        self.last_a, self.last_b = at_b[ends_a], at_a[ends_b]
        self.group_a, self.group_b = (np.cumsum(last) - last for last in (self.last_a, self.last_b))
        self.of_group = self.of_a[self.last_a]
        count = len(self.of_group)
        self.n_a, self.n_b = np.bincount(self.group_a, minlength=count), np.bincount(self.group_b, minlength=count)
        self.first_b = np.cumsum(self.n_b) - self.n_b

    def per_text(self, of: np.ndarray, values: np.ndarray | None = None) -> np.ndarray:
        total = np.zeros(self.texts, dtype=np.int64)
        np.add.at(total, of, 1 if values is None else values)
        return total

    def written(self, names: list[str]) -> list[str]:
        """``a1,a2|b1;a3|b2,b3`` of each text; ``names`` holds every id with every sign after it."""
        before_a = np.arange(len(self.a)) + self.first_b[self.group_a]
        before_b = np.arange(len(self.b)) + np.cumsum(self.n_a)[self.group_b]
        order = np.empty(len(self.a) + len(self.b), dtype=np.int64)
        ends = np.append(self.of_b[1:] != self.of_b[:-1], True)[: len(self.b)]
        order[before_a] = self.a * 2 + self.last_a
        order[before_b] = 2 * _SIDE_A + self.b * 3 + self.last_b + ends
        cuts = np.cumsum(self.per_text(self.of_a) + self.per_text(self.of_b)).tolist()
        get = names.__getitem__
        return ["".join(map(get, order[lo:hi].tolist())) for lo, hi in zip([0, *cuts], cuts, strict=False)]

    def links(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(text, a * 2**20 + b, links) of linked tokens; equal ids of a large group come once, counted."""
        large = self.n_a * self.n_b > LARGE_GROUP
        width = np.where(large, 0, self.n_b)[self.group_a]
        left = np.repeat(np.arange(len(self.a)), width)
        right = np.arange(len(left)) - np.repeat(np.cumsum(width) - width, width) + np.repeat(self.first_b[self.group_a], width)
        texts, pairs, counts = [self.of_a[left]], [self.a[left] * _SIDE + self.b[right]], [np.ones(len(left), dtype=np.int64)]
        first_a = np.cumsum(self.n_a) - self.n_a
        for g in np.flatnonzero(large).tolist():
            id_a, n_a = np.unique(self.a[first_a[g] : first_a[g] + self.n_a[g]], return_counts=True)
            id_b, n_b = np.unique(self.b[self.first_b[g] : self.first_b[g] + self.n_b[g]], return_counts=True)
            pairs.append((id_a[:, None] * _SIDE + id_b).ravel())
            counts.append((n_a[:, None] * n_b).ravel())
            texts.append(np.full(len(pairs[-1]), self.of_group[g]))
        return np.concatenate(texts), np.concatenate(pairs), np.concatenate(counts)


@functools.lru_cache(maxsize=2)
def signed_names(n_a: int, n_b: int) -> list[str]:
    """Ids of A before ``,`` and ``|``, then ids of B before ``,`` and ``;`` and at a text's end."""
    names = [f"{i}{sign}" for i in range(n_a) for sign in ",|"]
    names += [""] * (2 * (_SIDE_A - n_a))
    return names + [f"{i}{sign}" for i in range(n_b) for sign in (",", ";", "")]


def bitmap(places: np.ndarray) -> bytes:
    """Places of a block, ascending: as a list while that is shorter, else as one bit each."""
    if len(places) < _FULL:
        return places.astype("<u2").tobytes()
    bits = np.zeros(BLOCK_DOCUMENTS, dtype=np.uint8)
    bits[places] = 1
    return b"\0" + np.packbits(bits, bitorder="little").tobytes()


def places_of(data: bytes) -> np.ndarray:
    """The places in a bit map; a bit map proper has an odd length."""
    if len(data) % 2 == 0:
        return np.frombuffer(data, dtype="<u2").astype(np.int64)
    return np.flatnonzero(np.unpackbits(np.frombuffer(data, dtype=np.uint8)[1:], bitorder="little"))


def bitmaps(places: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> list[bytes]:
    """A bit map of each stretch of ``places``."""
    listed = places.astype("<u2").tobytes()
    return [
        listed[2 * i : 2 * j] if j - i < _FULL else bitmap(places[i:j]) for i, j in zip(starts.tolist(), ends.tolist(), strict=True)
    ]


def planes_of(rows: np.ndarray, places: np.ndarray, links: np.ndarray, n_rows: int) -> list[list[bytes]]:
    """For each row one bit map for each binary digit of its links beyond the first.

    ``rows`` ascend, and so do the places of a row; a row has as many maps as its longest number has digits.
    """
    more = np.flatnonzero(links > 1)
    rows, places, extra = rows[more], places[more], links[more] - 1
    planes: list[list[bytes]] = [[] for _ in range(n_rows)]
    for digit in range(int(extra.max(initial=0)).bit_length()):
        longer = np.unique(rows[extra >> digit > 0])
        set_ = np.flatnonzero(extra >> digit & 1)
        owners, starts = np.unique(rows[set_], return_index=True)
        maps = dict(zip(owners.tolist(), bitmaps(places[set_], starts, np.append(starts[1:], len(set_))[: len(starts)]), strict=True))
        for row in longer.tolist():
            planes[row].append(maps.get(row, b""))
    return planes


#: A document (place set) or an id pair's postings in a block (docs set).
ALIGNED = pa.schema([
    ("block", pa.int64()), ("place", pa.int32()), ("doc_id", pa.int64()), ("n_a", pa.int64()), ("n_b", pa.int64()),
    ("n_groups", pa.int64()), ("n_links", pa.int64()), ("groups", pa.string()),
    ("a", pa.int32()), ("b", pa.int32()), ("n_docs", pa.int32()), ("docs", pa.binary()), ("planes", pa.list_(pa.binary())),
])
ALIGNED_SCHEMA = (
    "block long, place int, doc_id long, n_a long, n_b long, n_groups long, n_links long, groups string, "
    "a int, b int, n_docs int, docs binary, planes array<binary>"
)


def _filled(**columns) -> pa.RecordBatch:
    n = len(columns["block"])
    return pa.RecordBatch.from_arrays(
        [pa.array(columns[f.name], f.type) if f.name in columns else pa.nulls(n, f.type) for f in ALIGNED], schema=ALIGNED
    )


class _Block:
    """Documents numbered one after another, and their links."""

    def __init__(self, number: int) -> None:
        self.number, self.documents, self.tokens = number, 0, 0
        none = np.zeros(0, dtype=np.int64)
        self.links: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = [(none, none, none)]

    def add(self, doc_ids: list[int | None], groups: Groups, names: list[str]) -> pa.RecordBatch:
        """Number the documents of ``groups`` and keep their links; the documents as rows."""
        places, pairs, counts = groups.links()
        first = self.documents
        self.links.append((places + first, pairs, counts))
        self.documents += len(doc_ids)
        self.tokens += len(groups.a)
        return _filled(
            block=[self.number] * len(doc_ids), place=range(first, self.documents), doc_id=doc_ids,
            n_a=groups.per_text(groups.of_a), n_b=groups.per_text(groups.of_b), n_groups=groups.per_text(groups.of_group),
            n_links=groups.per_text(groups.of_group, groups.n_a * groups.n_b), groups=groups.written(names))

    def postings(self) -> pa.RecordBatch:
        places, pairs, counts = (np.concatenate(x) for x in zip(*self.links, strict=True))
        order = np.argsort(pairs * BLOCK_DOCUMENTS + places, kind="stable")
        pairs, places, counts = pairs[order], places[order], counts[order]
        fresh = np.flatnonzero(np.concatenate([[True], (pairs[1:] != pairs[:-1]) | (places[1:] != places[:-1])])[: len(pairs)])
        links = np.add.reduceat(counts, fresh) if len(fresh) else counts
        pairs, places = pairs[fresh], places[fresh]
        starts = np.flatnonzero(np.concatenate([[True], pairs[1:] != pairs[:-1]])[: len(pairs)])
        ends = np.append(starts[1:], len(pairs))[: len(starts)]
        docs = bitmaps(places, starts, ends)
        planes = planes_of(np.repeat(np.arange(len(starts)), ends - starts), places, links, len(starts))
        own = pairs[starts]
        return _filled(block=[self.number] * len(own), a=own // _SIDE, b=own % _SIDE, n_docs=ends - starts, docs=docs, planes=planes)


def _aligned(texts: DataFrame, byte_level: str, pieces: str) -> DataFrame:
    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        left, right = byte_level_ids(byte_level), piece_ids(pieces)
        bytes_a, bytes_b = left.bytes_of(), right.bytes_of
        size_a, size_b = np.array([len(x) for x in bytes_a]), np.array([len(x) for x in bytes_b])
        names = signed_names(len(bytes_a), len(bytes_b))
        none: list[int] = []
        # A task's blocks bear its number; a task that runs again makes the same blocks.
        number = TaskContext.get().partitionId() << 32
        block = _Block(number)
        ids, a, b, size = [], [], [], 0

        def taken() -> pa.RecordBatch:
            return block.add(ids, Groups(a, b, size_a, size_b), names)

        for batch in batches:
            for doc_id, text in zip(batch.column(0), batch.column(1), strict=True):
                text, own_a, own_b = text.as_py(), none, none
                if text:
                    own_a, own_b, raw = left.encode_ordinary(" " + text), right.encode(text), (" " + text).encode()
                    if any(b"".join(map(of.__getitem__, own)) != raw for of, own in ((bytes_a, own_a), (bytes_b, own_b))):
                        own_a = own_b = none
                ids.append(doc_id.as_py())
                a.append(np.array(own_a, dtype=np.int64))
                b.append(np.array(own_b, dtype=np.int64))
                size += len(own_a)
                full = block.documents + len(ids) >= BLOCK_DOCUMENTS or block.tokens + size >= BLOCK_TOKENS
                if full or size >= TOGETHER:
                    yield taken()
                    ids, a, b, size = [], [], [], 0
                if full:
                    yield block.postings()
                    number += 1
                    block = _Block(number)
        if ids:
            yield taken()
        if block.documents:
            yield block.postings()

    return texts.mapInArrow(tidy(read), ALIGNED_SCHEMA)


def _totals(key: tuple, table: pa.Table) -> pa.Table:
    """One block: its documents, and its postings with their pair's count."""
    documents = table.filter(pc.is_valid(table["place"])).sort_by("place")
    n = len(documents)
    total, best = np.zeros(n, dtype=np.int64), np.zeros(n, dtype=np.int64)
    postings = table.filter(pc.is_valid(table["count"]))
    counts, tops = postings["count"].to_numpy(), postings["best"].to_numpy(zero_copy_only=False).astype(np.int64)

    def spread(rows: np.ndarray, maps: list[bytes], weight: int) -> None:
        """Add a row's count, and its links if it is a best one, to the documents of its map."""
        sizes = np.array([len(m) for m in maps], dtype=np.int64)
        listed, full = np.flatnonzero(sizes % 2 == 0), np.flatnonzero(sizes % 2 == 1)
        joined = np.frombuffer(b"".join([maps[i] for i in listed.tolist()]), dtype="<u2")
        at = [joined.astype(np.int64), *(places_of(maps[i]) for i in full.tolist())]
        of = np.concatenate([np.repeat(listed, sizes[listed] // 2), *(np.full(len(p), i) for i, p in zip(full.tolist(), at[1:], strict=True))])
        row, places = rows[of.astype(np.int64)], np.concatenate(at)
        np.add.at(total, places, counts[row] * weight)
        np.add.at(best, places, tops[row] * weight)

    spread(np.arange(len(postings)), postings["docs"].to_pylist(), 1)
    planes = postings["planes"].to_pylist()
    for digit in range(max(map(len, planes), default=0)):
        rows = [i for i, own in enumerate(planes) if len(own) > digit]
        spread(np.array(rows, dtype=np.int64), [planes[i][digit] for i in rows], 1 << digit)
    columns = [documents[c] for c in ("doc_id", "n_a", "n_b", "n_groups", "n_links")]
    names = ["doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups"]
    return pa.table([*columns, pa.array(best), pa.array(total), documents["groups"]], names=names)


def aligned(
    docs: DataFrame, byte_level: str, pieces: str, keep: Callable[[Column], Column] = lambda groups: groups
) -> tuple[DataFrame, DataFrame]:
    """Alignments of every text, and counts of every id pair.

    ``byte_level`` is a byte-level vocabulary in the ``tokenizers`` format (A, read with a space
    before the text), ``pieces`` a sentencepiece model that adds that space itself (B); special
    tokens written out in a text are plain text. ``keep`` says what is to be kept of the groups
    before anything is written (their text is longer than the document's).

    The first table has one row per document: doc_id, n_a, n_b (tokens), n_groups, n_links,
    n_best (links whose pair is the most frequent of its A id, ties included), count_sum (sum
    of the links' pair counts), groups (``a1,a2|b1;...`` after ``keep``). The second has one row
    per id pair: a, b, count (documents that hold it linked, each row a document) and best.

    Null and empty texts, and such as either vocabulary does not give back byte for byte, have
    no tokens, zeros, and groups of an empty text. Only doc_id and text are read, so other
    columns cannot clash; null and repeated doc_ids are rows like any other. An empty table
    gives empty results.
    """
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), body().alias("text"))
    found = _aligned(texts, byte_level, pieces).withColumn("groups", keep(F.col("groups")))
    found = stable(found, "aligned")
    postings = found.where("docs IS NOT NULL").select("block", "a", "b", "n_docs", "docs", "planes")
    counts = stable(postings.groupBy("a", "b").agg(F.sum("n_docs").cast("long").alias("count")), "pair-counts")
    top = counts.groupBy("a").agg(F.max("count").alias("top"))
    counts = counts.join(top, "a").select("a", "b", "count", (F.col("count") == F.col("top")).alias("best"))

    scored = postings.join(counts, ["a", "b"]).select("block", "count", "best", "docs", "planes")
    narrow = ("place", "doc_id", "n_a", "n_b", "n_groups", "n_links", "groups")
    documents = found.where("place IS NOT NULL").select("block", *narrow)
    rows = documents.unionByName(scored, allowMissingColumns=True)
    kinds = dict(rows.dtypes)
    schema = "doc_id long, n_a long, n_b long, n_groups long, n_links long, n_best long, count_sum long, groups " + kinds["groups"]
    return rows.groupBy("block").applyInArrow(_totals, schema), counts
