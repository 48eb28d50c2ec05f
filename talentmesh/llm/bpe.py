"""Byte-level BPE as a fold: distinct words are merged by rank in Spark, documents look them up.

Documents are read once. Each task numbers the different words of some megabytes of text and
keeps the documents as word numbers. The different words of the corpus are then encoded, each
once, by a higher-order fold over their bytes with the ranks as a literal map. Every block of
documents gets the ids of its own words back and puts the documents together, and decodes them
by concatenating the pieces of the ids. No table of all words is ever in one place.
"""

from __future__ import annotations

import base64
import functools
import hashlib
import heapq
import json
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import zstandard
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from talentmesh.functions.text import let
from talentmesh.llm.common import body, shared_dir, shuffle_partitions, tidy

#: Ids lie below IDS; a prime number of slots holds the rank map.
IDS = 1 << 16
SLOTS = 99_991
#: Words with more bytes are merged by a heap, since folding takes the square of the length.
FOLD_BYTES = 256
#: Tasks of short words to one of long ones.
LONG_SHARE = 4
#: Uses from which on a word is numbered by its count.
COMMON = 8
#: Characters of text whose words are numbered together.
BLOCK_CHARS = 48 << 20


@functools.lru_cache(maxsize=2)
def read_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as f:
        return {base64.b64decode(piece): int(rank) for piece, rank in map(bytes.split, filter(bytes.strip, f))}


class RankMap:
    """The ranks as literals: for two neighbouring pieces, named by their ids, the id of both together.

    A pair's rank is the rank of its bytes, so each way to cut a piece into two is an entry. The
    entries lie in ``SLOTS`` short lists of keys and ids, since a lookup in one map is a search;
    a key is larger than any id. Words that are pieces but that no order of merges leads to are
    listed one by one.
    """

    def __init__(self, ranks: dict[bytes, int]) -> None:
        slots: list[list[int]] = [[] for _ in range(SLOTS)]
        for piece, rank in ranks.items():
            for cut in range(1, len(piece)):
                left, right = ranks.get(piece[:cut]), ranks.get(piece[cut:])
                if left is not None and right is not None:
                    key = left * IDS + right + IDS
                    slots[key % SLOTS] += [key, rank]
        self.slots = F.from_json(F.lit(json.dumps(slots, separators=(",", ":"))), "array<array<bigint>>")
        by_place = sorted(range(256), key=lambda b: zlib.crc32(bytes([b])) >> 24)
        self.bytes = F.array(*[F.lit(ranks.get(bytes([b]))).cast("bigint") for b in by_place])
        self.alone = {piece.hex().upper(): rank for piece, rank in ranks.items() if merge_long(piece, ranks, whole=False) != [rank]}

    @staticmethod
    def place(byte: Column) -> Column:
        """Where a byte's id lies: the highest byte of a checksum of one byte is different for all 256."""
        return F.shiftright(F.crc32(byte), 24).cast("int")

    @staticmethod
    def rank(slots: Column, left: Column, right: Column) -> Column:
        """Id of two pieces together; null if they are none."""

        def found(key: Column) -> Column:
            slot = F.get(slots, F.pmod(key, F.lit(SLOTS)).cast("int"))
            return let(slot, lambda s: F.get(s, F.nullif(F.array_position(s, key), F.lit(0).cast("bigint")).cast("int")))

        return let(left * IDS + right + IDS, found)


#: Stands before the first and after the last piece; no pair has a rank with it.
EDGE = -1
EVERY = 1 << 30


def _merge_lowest(slots: Column, state: Column) -> Column:
    """Join the leftmost pair of lowest rank, if any pair has one.

    The state holds the ids of the pieces between two edges and the ranks of neighbouring pairs.
    A merge changes two pairs; only those are looked up, and the new piece's id is the pair's rank.
    """
    ids, pairs = state.ids, state.pairs

    def join(best: Column) -> Column:
        def at(i: Column) -> Column:
            near = F.array(RankMap.rank(slots, F.get(ids, i - 2), best), RankMap.rank(slots, best, F.get(ids, i + 1)))
            return F.struct(
                F.concat(F.slice(ids, F.lit(1), i - 1), F.array(best), F.slice(ids, i + 2, F.lit(EVERY))).alias("ids"),
                F.concat(F.slice(pairs, F.lit(1), i - 2), near, F.slice(pairs, i + 2, F.lit(EVERY))).alias("pairs"),
            )

        return F.when(best.isNull(), state).otherwise(let(F.array_position(pairs, best).cast("int"), at))

    return let(F.array_min(pairs), join)


def encoded(word: Column, table: RankMap) -> Column:
    """Array of ids of a word, by folding ranked merges over its bytes; a word that is a piece is one id."""

    def ids(slots: Column, bytes_: Column, raw: Column) -> Column:
        size = F.octet_length(raw)
        byte = lambda i: RankMap.place(F.substring(raw, i + 1, F.lit(1)))
        edge = F.array(F.lit(EDGE).cast("bigint"))

        def folded(first: Column) -> Column:
            pairs = F.transform(first, lambda left, i: RankMap.rank(slots, left, F.get(first, i + 1)))
            start = F.struct(first.alias("ids"), pairs.alias("pairs"))
            last = F.aggregate(F.sequence(F.lit(1), size), start, lambda state, _: _merge_lowest(slots, state)).ids
            return F.filter(last, lambda i: i >= 0)

        merged = let(F.concat(edge, F.transform(F.sequence(F.lit(0), size - 1), lambda i: F.get(bytes_, byte(i))), edge), folded)
        if not table.alone:
            return merged
        alone = F.create_map(*[F.lit(x) for pair in table.alone.items() for x in pair])
        return let(F.try_element_at(alone, F.hex(raw)), lambda whole: F.when(
            whole.isNotNull(), F.array(whole.cast("bigint"))).otherwise(merged))

    return let(table.slots, lambda slots: let(table.bytes, lambda bytes_: let(
        word.cast("binary"), lambda raw: ids(slots, bytes_, raw))))


def short_integers(ids: Column) -> Column:
    """Ids as unsigned 16-bit integers, lowest byte first."""
    swapped = lambda i: F.shiftleft(i.bitwiseAND(255), 8) + F.shiftright(i, 8) + IDS
    two = F.transform(ids, lambda i: F.substring(F.hex(swapped(i)), 2, 4))  # the digits after a leading 1
    return F.unhex(F.array_join(two, ""))


def merge_long(word: bytes, ranks: dict[bytes, int], whole: bool = True) -> list[int]:
    """Ids of a long word: the same merges, lowest rank and leftmost first, kept in a heap.

    A word that is a piece is one id, unless ``whole`` says to merge it all the same.
    """
    if whole and word in ranks:
        return [ranks[word]]
    pieces: list[bytes | None] = [word[i : i + 1] for i in range(len(word))]
    after, ahead = list(range(1, len(word) + 1)), list(range(-1, len(word) - 1))
    heap = [(r, i, 2) for i in range(len(word) - 1) if (r := ranks.get(word[i : i + 2])) is not None]
    heapq.heapify(heap)
    while heap:
        _, i, size = heapq.heappop(heap)
        j = after[i] if pieces[i] is not None else len(word)
        if j >= len(word) or len(pieces[i]) + len(pieces[j]) != size:
            continue  # one of the two has been merged since
        pieces[i] += pieces[j]
        pieces[j] = None
        after[i] = after[j]
        if after[j] < len(word):
            ahead[after[j]] = i
        for a, b in ((ahead[i], i), (i, after[i])):
            if a >= 0 and b < len(word) and (r := ranks.get(pieces[a] + pieces[b])) is not None:
                heapq.heappush(heap, (r, a, len(pieces[a]) + len(pieces[b])))
    return [ranks[p] for p in pieces if p is not None]


class _Numbers(dict):
    def __missing__(self, word: str) -> int:
        self[word] = n = len(self)
        return n


def _packed(numbers: np.ndarray) -> bytes:
    """Word numbers, byte plane by byte plane, which compresses well: frequent words come early."""
    return zstandard.compress(np.ascontiguousarray(numbers.astype("<u4").view(np.uint8).reshape(-1, 4).T).tobytes(), 3)


def _unpacked(packed: bytes) -> np.ndarray:
    planes = np.frombuffer(zstandard.decompress(packed), dtype=np.uint8).reshape(4, -1)
    return np.ascontiguousarray(planes.T).view("<u4").ravel()


def _renumbered(numbers: np.ndarray, words: list[str]) -> tuple[np.ndarray, pa.Array]:
    """Frequent words first, by count, the others in order of their letters: both parts compress better."""
    count, listed = np.bincount(numbers, minlength=len(words)), pa.array(words, pa.string())
    common, rare = np.flatnonzero(count >= COMMON), np.flatnonzero(count < COMMON)
    common = common[np.argsort(-count[common], kind="stable")]
    rare = rare[pc.sort_indices(listed.take(pa.array(rare))).to_numpy()]
    order = np.concatenate([common, rare])
    new = np.empty(len(words), dtype=np.uint32)
    new[order] = np.arange(len(words), dtype=np.uint32)
    return new[numbers], listed.take(pa.array(order))


def _blocks(docs: DataFrame, pattern: str) -> DataFrame:
    """Rows (block, docs, sizes, numbers, words): documents as numbers of the words of their block."""

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import regex

        find = regex.compile(pattern).findall
        ids, sizes, numbers, known, chars = [], [], [], _Numbers(), 0

        def full() -> pa.RecordBatch:
            flat, words = _renumbered(np.concatenate(numbers), list(known))
            words = pa.ListArray.from_arrays(pa.array([0, len(words)], pa.int32()), words)
            return pa.RecordBatch.from_arrays(
                [pa.array([uuid.uuid4().int >> 65]), pa.array([ids], pa.list_(pa.int64())), pa.array([sizes], pa.list_(pa.int64())),
                 pa.array([_packed(flat)], pa.binary()), words],
                ["block", "docs", "sizes", "numbers", "words"],
            )

        for batch in batches:
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                words = find(text)
                ids.append(doc_id)
                sizes.append(len(words))
                numbers.append(np.fromiter(map(known.__getitem__, words), dtype=np.uint32, count=len(words)))
                chars += len(text)
                if chars > BLOCK_CHARS:
                    yield full()
                    ids, sizes, numbers, known, chars = [], [], [], _Numbers(), 0
        if ids:
            yield full()

    return docs.select(F.col("doc_id").cast("long"), body().alias("text")).mapInArrow(
        tidy(read), "block long, docs array<long>, sizes array<long>, numbers binary, words array<string>"
    )


@functools.lru_cache(maxsize=2)
def pieces_by_id(path: str) -> list[bytes]:
    ranks = read_ranks(path)
    out = [b""] * (max(ranks.values()) + 1)
    for piece, rank in ranks.items():
        out[rank] = piece
    return out


def decoded(ids: np.ndarray, pieces: list[bytes]) -> bytes:
    """The pieces of the ids, concatenated."""
    return b"".join(map(pieces.__getitem__, ids.tolist()))


def _with_ids(uses: DataFrame, ranks_path: str) -> DataFrame:
    """(block, n, ids): the ids of every word that a block uses, each different word folded once.

    Uses of a word meet in one task; its first use is folded and the others take that over.
    """
    table = RankMap(read_ranks(ranks_path))
    short = F.octet_length("word") <= FOLD_BYTES
    uses = uses.repartition(shuffle_partitions(uses.sparkSession), "word")
    of_word = Window.partitionBy("word").orderBy("block")
    first = uses.where(short).withColumn("nth", F.row_number().over(of_word))
    coded = first.withColumn("coded", F.when(F.col("nth") == 1, short_integers(encoded(F.col("word"), table))))
    upto = of_word.rowsBetween(Window.unboundedPreceding, Window.currentRow)  # the same order: nothing is sorted again
    folded = coded.select("block", "n", F.first("coded").over(upto).alias("ids"))

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            known = read_ranks(ranks_path)
            ids = [np.array(merge_long(w.encode(), known), dtype="<u2").tobytes() for w in batch.column("word").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("block"), batch.column("n"), pa.array(ids, pa.binary())], ["block", "n", "ids"])

    # Every task of the stage is sent the ranks, so the rare long words share a few.
    long = uses.where(~short).coalesce(max(1, shuffle_partitions(uses.sparkSession) // LONG_SHARE))
    return folded.union(long.mapInArrow(tidy(merge), "block long, n int, ids binary"))


def encode_decode(docs: DataFrame, ranks_path: str, pattern: str) -> DataFrame:
    """Ids of every whole text, and the text decoded from them, as checksums.

    Returns one row per input row: doc_id, n_tokens, ids_sha256 (ids as little-endian unsigned
    32-bit integers), decoded_sha256. Null text is empty and has no ids. Only doc_id and text
    are read; rows that repeat come back as often. An empty table gives an empty result.
    Words of more than ``FOLD_BYTES`` bytes are merged by a heap, with the same result. The
    vocabulary must have at most 65,536 ids.

    Documents stay where they were first written, in buckets by block; only words and their
    ids move.
    """
    spark = docs.sparkSession
    if len(pieces_by_id(ranks_path)) > 1 << 16:
        raise ValueError("ids must fit into 16 bits")
    name = f"word_blocks_{uuid.uuid4().hex}"
    writer = _blocks(docs, pattern).write.bucketBy(shuffle_partitions(spark), "block").option("compression", "zstd")
    writer.option("path", f"{shared_dir(spark)}/{name}").saveAsTable(name)
    uses = spark.table(name).select("block", F.posexplode("words").alias("n", "word"))
    own = _with_ids(uses, ranks_path)

    def assemble(blocks: pa.Table, answers: pa.Table) -> pa.Table:
        pieces, out = pieces_by_id(ranks_path), []
        ids = answers.column("ids").take(pa.array(np.argsort(answers.column("n").to_numpy()))).to_pylist()
        for row in blocks.to_pylist():
            numbers, first = _unpacked(row["numbers"]), 0
            for doc_id, size in zip(row["docs"], row["sizes"], strict=True):
                words = numbers[first : first + size].tolist()
                first += size
                coded = np.frombuffer(b"".join(map(ids.__getitem__, words)), dtype="<u2").astype("<u4")
                text = decoded(coded, pieces)
                out.append((doc_id, len(coded), hashlib.sha256(coded.tobytes()).hexdigest(), hashlib.sha256(text).hexdigest()))
        kinds = (pa.int64(), pa.int64(), pa.string(), pa.string())
        columns = list(zip(*out, strict=True)) if out else [[]] * 4
        return pa.table([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names=["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    texts = spark.table(name).select(F.col("block").alias("home"), "docs", "sizes", "numbers")
    schema = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string"
    return texts.groupBy("home").cogroup(own.groupBy("block")).applyInArrow(assemble, schema)
