"""Jaccard join on word shingles: prefix lists with block skipping, answers taken over from similar sets.

Every set puts its rarest shingles, as many as any similar set must share one of, into
inverted lists. Lists are skipped block by block where sizes and positions rule a match out.
A set whose link to a similar set is known shares that set's component, so nothing between
sets of one component is compared again; only pairs across components are. "Rare" means
not among the most frequent shingles that the tasks report over all documents: any order of
shingles is correct, a good one makes lists short.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from talentmesh.llm.common import body, maybe_among, row_ids, row_mark, shuffle_partitions, stable, tidy, without
from talentmesh.llm.components import components

WORDS = 5
PERCENT = 75
#: Shingles that a task counts together, how often it must see one to report it, and how many
#: of the most frequent ones go last in every set. They shape the order only, never the result.
COUNTED = 2_000_000
OFTEN = 2
FREQUENT = 500_000
#: Cells of the table that tells most shingles apart from the frequent ones.
HINT = 1 << 22
#: Words whose hashes a worker remembers.
REMEMBERED = 200_000
#: Entries of a list that are skipped or compared together.
BLOCK = 256
#: Rounds in which each set tries the pivot it shares most lists with, before all pairs across components.
TURNS = 1


class _WordHashes(dict):
    def __missing__(self, word: bytes) -> int:
        if len(self) >= REMEMBERED:
            self.clear()
        self[word] = value = xxhash.xxh64_intdigest(word)
        return value


_HASH_OF = _WordHashes()


def words_of(text: str) -> list[bytes]:
    """ASCII letters lowered; bytes.split knows exactly the white space of the contract."""
    return text.encode("utf-8", "surrogatepass").lower().split()


def shingle_set(text: str) -> set[tuple[bytes, ...]]:
    """The set itself, for exact comparison."""
    words = words_of(text)
    if len(words) < WORDS:
        return {tuple(words)} if words else set()
    return set(zip(*(words[j:] for j in range(WORDS)), strict=False))


def shingle_hashes(text: str) -> np.ndarray:
    """Distinct 64-bit hashes of the set, in ascending order."""
    words = words_of(text)
    own = np.fromiter(map(_HASH_OF.__getitem__, words), dtype=np.uint64, count=len(words))
    n = len(own) - WORDS + 1
    if n < 1:
        if not len(own):
            return own
        h, rest = own[:1] + np.uint64(len(own)), [own[j : j + 1] for j in range(1, len(own))]
    else:
        h, rest = own[:n], [own[j : j + n] for j in range(1, WORDS)]
    for w in rest:
        h = h * np.uint64(0x9E3779B97F4A7C15) + w
    h = (h ^ h >> np.uint64(32)) * np.uint64(0xD6E8FEB86659FD93)
    return np.unique(h ^ h >> np.uint64(32))


def describe(docs: DataFrame) -> DataFrame:
    """(doc_id, n_shingles, set_hash) a document; and (token, seen) of shingles that a task saw often."""
    names = ["doc_id", "n_shingles", "set_hash", "token", "seen"]

    def often(held: list[np.ndarray]) -> pa.RecordBatch:
        token, seen = np.unique(np.concatenate(held), return_counts=True)
        token, seen = token[seen >= OFTEN], seen[seen >= OFTEN]
        none = pa.nulls(len(token), pa.int64())
        return pa.RecordBatch.from_arrays(
            [none, none, pa.nulls(len(token), pa.binary()), pa.array(token.view(np.int64)), pa.array(seen)], names
        )

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[np.ndarray] = []
        size = 0
        for batch in batches:
            sizes, hashes = [], []
            for text in batch.column("text"):
                h = shingle_hashes(text.as_py())
                sizes.append(len(h))
                hashes.append(hashlib.md5(h.tobytes()).digest())
                held.append(h)
                size += len(h)
                if size > COUNTED:
                    yield often(held)
                    held, size = [], 0
            none = pa.nulls(len(sizes), pa.int64())
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), pa.array(sizes, pa.int64()), pa.array(hashes, pa.binary()), none, none], names
            )
        if held:
            yield often(held)

    schema = "doc_id long, n_shingles long, set_hash binary, token long, seen long"
    return docs.select(F.col("doc_id").cast("long"), body().alias("text")).mapInArrow(tidy(read), schema)


class Frequent:
    """Counts of the most frequent shingles; 0 for all others."""

    def __init__(self, token: np.ndarray, seen: np.ndarray) -> None:
        order = np.argsort(token)
        self.token, self.seen = token[order], seen[order]
        self.hint = np.zeros(HINT, dtype=bool)  # most shingles are told by this alone
        self.hint[(token & np.uint64(HINT - 1)).astype(np.int64)] = True

    def counts(self, hashes: np.ndarray) -> np.ndarray:
        out = np.zeros(len(hashes), dtype=np.int64)
        at = np.flatnonzero(self.hint[(hashes & np.uint64(HINT - 1)).astype(np.int64)])
        if len(at):
            place = np.minimum(np.searchsorted(self.token, hashes[at]), len(self.token) - 1)
            out[at] = np.where(self.token[place] == hashes[at], self.seen[place], 0)
        return out


def prefixes(docs: DataFrame, frequent: Frequent) -> DataFrame:
    """(node, size, tokens): the rarest shingles of each set, enough to meet every similar set."""
    shared = docs.sparkSession.sparkContext.broadcast(frequent)

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sizes, tokens = [], []
            for text in batch.column("text"):
                h = shingle_hashes(text.as_py())
                n = len(h)
                seen = shared.value.counts(h)
                keep = n - (PERCENT * n + 99) // 100 + 1 if n else 0
                sizes.append(n)
                tokens.append(h[np.lexsort((h, seen))[:keep]].view(np.int64))
            lists = pa.ListArray.from_arrays(
                pa.array(np.cumsum([0, *map(len, tokens)]), pa.int32()),
                pa.array(np.concatenate(tokens) if tokens else np.empty(0, np.int64)),
            )
            yield pa.RecordBatch.from_arrays([batch.column("node"), pa.array(sizes, pa.int32()), lists], ["node", "size", "tokens"])

    return docs.select(F.col("doc_id").cast("long").alias("node"), body().alias("text")).mapInArrow(
        tidy(read), "node long, size int, tokens array<long>"
    )


def _whole_lists(batches: Iterator[pa.RecordBatch]) -> Iterator[dict[str, np.ndarray]]:
    """Columns of rows sorted by token, cut between lists."""
    held: list[dict[str, np.ndarray]] = []
    for batch in batches:
        if not batch.num_rows:
            continue
        part = {n: batch.column(n).to_numpy(zero_copy_only=False) for n in batch.schema.names}
        change = np.flatnonzero(part["token"][1:] != part["token"][:-1])
        if held and not len(change) and part["token"][0] == held[-1]["token"][-1]:
            held.append(part)
            continue
        cut = int(change[-1]) + 1 if len(change) else 0
        held.append({n: c[:cut] for n, c in part.items()})
        yield {n: np.concatenate([h[n] for h in held]) for n in part}
        held = [{n: c[cut:] for n, c in part.items()}]
    if held:
        yield {n: np.concatenate([h[n] for h in held]) for n in held[0]}


def _runs(token: np.ndarray) -> Iterator[tuple[int, int]]:
    edges = np.flatnonzero(np.concatenate([[True], token[1:] != token[:-1], [True]]))
    for lo, hi in zip(edges[:-1].tolist(), edges[1:].tolist(), strict=True):
        if hi - lo > 1:
            yield lo, hi


def _distinct_pairs(a: list[np.ndarray], b: list[np.ndarray]) -> pa.RecordBatch:
    pairs = np.unique(np.stack([np.concatenate(a), np.concatenate(b)], axis=1), axis=0)
    return pa.RecordBatch.from_arrays([pa.array(pairs[:, 0]), pa.array(pairs[:, 1])], ["a", "b"])


def _likely(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(a, b, turn, votes): each set with the pivot of its list, another pivot each turn, counted over lists.

    The first pivot is the set that stands in most lists: an original stands in more of them
    than what was made from it. The next is drawn by a hash of the set, alike in all lists.
    """

    def counted(held: list[dict[str, np.ndarray]]) -> Iterator[pa.RecordBatch]:
        token, node, size, degree = (np.concatenate([h[n] for h in held]) for n in ("token", "node", "size", "degree"))
        edges = np.flatnonzero(np.concatenate([[True], token[1:] != token[:-1]]))
        members = np.diff(np.concatenate([edges, [len(token)]]))
        size = size.astype(np.int64)
        for turn in range(TURNS):
            draw = (node.astype(np.uint64) + np.uint64(turn * 7919 + 1)) * np.uint64(0x9E3779B97F4A7C15)
            draw = (draw ^ draw >> np.uint64(31)) * np.uint64(0xD6E8FEB86659FD93) >> np.uint64(24)
            if turn == 0:
                draw |= np.maximum((1 << 20) - degree, 0).astype(np.uint64) << np.uint64(40)
            least = np.repeat(np.minimum.reduceat(draw, edges), members)
            pivot = np.zeros(len(token), dtype=np.int64)
            pivot[edges] = np.flatnonzero(draw == least)[np.searchsorted(np.flatnonzero(draw == least), edges)]
            pivot = np.repeat(pivot[edges], members)
            fits = (node != node[pivot]) & (100 * np.minimum(size, size[pivot]) >= PERCENT * np.maximum(size, size[pivot]))
            a, b = node[pivot][fits], node[fits]
            code = a.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) ^ b.astype(np.uint64)
            _, first, votes = np.unique(code, return_index=True, return_counts=True)
            yield pa.RecordBatch.from_arrays(
                [pa.array(a[first]), pa.array(b[first]), pa.array(np.full(len(first), turn, np.int32)), pa.array(votes)],
                ["a", "b", "turn", "votes"],
            )

    held: list[dict[str, np.ndarray]] = []
    for batch in batches:
        if batch.num_rows:
            held.append({n: batch.column(n).to_numpy() for n in ("token", "node", "size", "degree")})
        if sum(len(h["token"]) for h in held) > 400_000:
            yield from counted(held)
            held = []
    if held:
        yield from counted(held)


def _across(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(a, b): pairs of a list that lie in two components and may be similar."""
    for part in _whole_lists(batches):
        out_a, out_b, held = [], [], 0
        for lo, hi in _runs(part["token"]):
            comp = part["comp"][lo:hi]
            if (comp == comp[0]).all():
                continue
            order = np.lexsort((part["pos"][lo:hi], part["size"][lo:hi]))
            node, comp = part["node"][lo:hi][order], comp[order]
            size, rest = part["size"][lo:hi][order].astype(np.int64), None
            rest = size - part["pos"][lo:hi][order]  # the set's shingles from here on
            starts = range(0, hi - lo, BLOCK)
            top = [rest[s : s + BLOCK].max() for s in starts]
            for i, s in enumerate(starts):
                x = slice(s, s + BLOCK)
                for j in range(i, len(top)):
                    y = slice(j * BLOCK, j * BLOCK + BLOCK)
                    if 100 * size[x][-1] < PERCENT * size[y][0]:
                        break  # later blocks hold still larger sets
                    need = -(-PERCENT * (size[x][0] + size[y][0]) // (100 + PERCENT))
                    if min(top[i], top[j]) < need:
                        continue
                    both = size[x][:, None] + size[y][None, :]
                    ok = np.minimum(rest[x][:, None], rest[y][None, :]) * (100 + PERCENT) >= PERCENT * both
                    ok &= 100 * size[x][:, None] >= PERCENT * size[y][None, :]
                    ok &= comp[x][:, None] != comp[y][None, :]
                    if i == j:
                        ok &= np.arange(len(size[x]))[:, None] < np.arange(len(size[y]))[None, :]
                    p, q = np.nonzero(ok)
                    out_a.append(np.minimum(node[x][p], node[y][q]))
                    out_b.append(np.maximum(node[x][p], node[y][q]))
                    held += len(p)
                    if held > 500_000:
                        yield _distinct_pairs(out_a, out_b)
                        out_a, out_b, held = [], [], 0
        if held:
            yield _distinct_pairs(out_a, out_b)


def linked(pairs: DataFrame, docs: DataFrame, name: str) -> DataFrame:
    """Those of ``pairs`` (a, b) whose sets are similar, by exact comparison of the shingles."""
    pairs = stable(pairs.select("a", "b"), f"{name}-pairs")
    ids = pairs.select(F.explode(F.array("a", "b")).alias("id"))
    texts = docs.where(maybe_among(ids, "doc_id")).select(F.col("doc_id").cast("long").alias("id"), body().alias("text"))
    texts = texts.groupBy("id").agg(F.min("text").alias("text"))
    both = pairs.join(texts.select(F.col("id").alias("a"), F.col("text").alias("text_a")), "a")
    both = both.join(texts.select(F.col("id").alias("b"), F.col("text").alias("text_b")), "b")

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, last_set = None, set()
        for batch in batches:
            ok = []
            for a, b, text_a, text_b in zip(*(batch.column(n) for n in ("a", "b", "text_a", "text_b")), strict=True):
                if b.as_py() != last:
                    last, last_set = b.as_py(), shingle_set(text_b.as_py())
                other = shingle_set(text_a.as_py())
                common = len(other & last_set)
                ok.append(100 * common >= PERCENT * (len(other) + len(last_set) - common) and common > 0)
            yield batch.select(["a", "b"]).filter(pa.array(ok, pa.bool_()))

    return stable(both.mapInArrow(tidy(compare), "a long, b long"), name)


def _apart(pairs: DataFrame, stars: DataFrame) -> DataFrame:
    """Those of ``pairs`` (a, b) that ``stars`` does not hold in one component, each once."""
    pairs = pairs.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()
    for side in ("a", "b"):
        of = stars.select(F.col("u").alias(side), F.col("v").alias(f"{side}_root"))
        pairs = pairs.join(of, side, "left")
    return pairs.where(F.coalesce("a_root", "a") != F.coalesce("b_root", "b")).select("a", "b")


def similar_documents(docs: DataFrame) -> DataFrame:
    """The component of every document under links of Jaccard similarity 0.75 or more.

    Returns one row per input row: doc_id, n_shingles, component_id (smallest doc_id that links
    reach). A document's set is its distinct five-word shingles; fewer words are one shingle,
    and a document without words links with nothing, other empty ones included. Only doc_id and
    text are read. Rows that repeat a doc_id should repeat its text; each comes back. A null
    doc_id is linked with nothing and its component_id is null. An empty table gives an empty
    result.
    """
    spark = docs.sparkSession
    told = stable(describe(docs), "described")
    sets = told.where("n_shingles IS NOT NULL").select("doc_id", "n_shingles", "set_hash")
    counted = told.where("token IS NOT NULL").groupBy("token").agg(F.sum("seen").alias("seen"))
    top = counted.orderBy(F.desc("seen"), "token").limit(FREQUENT).toArrow()
    frequent = Frequent(top.column("token").to_numpy().view(np.uint64), top.column("seen").to_numpy())
    nodes = sets.where("n_shingles > 0 AND doc_id IS NOT NULL")
    same = stable(nodes.groupBy("set_hash").agg(F.min("doc_id").alias("node"), F.count("*").alias("n")), "equal-sets")

    # One document stands for all with its set; the others are few, and known before texts move.
    repeats = nodes.join(same.where("n > 1"), "set_hash").where("doc_id <> node").select("doc_id").distinct()
    repeats = stable(repeats, "repeated-sets")
    doubtful = maybe_among(repeats, "doc_id")
    known = docs.where("doc_id IS NOT NULL")
    sole = prefixes(known.where(~doubtful), frequent).union(
        prefixes(known.where(doubtful), frequent).join(repeats.withColumnRenamed("doc_id", "node"), "node", "left_anti")
    )
    entries = sole.select("node", "size", F.posexplode("tokens").alias("pos", "token")).select("token", "node", "size", "pos")
    shared = entries.withColumn("n", F.count("*").over(Window.partitionBy("token"))).where("n > 1").drop("n")
    shared = stable(shared, "shared-entries")
    degree = shared.groupBy("node").agg(F.count("*").alias("degree"))
    lists = shared.join(degree, "node").repartition(shuffle_partitions(spark), "token").sortWithinPartitions("token")
    lists = stable(lists.select("token", "node", "size", "pos", "degree"), "lists")

    votes = lists.mapInArrow(tidy(_likely), "a long, b long, turn int, votes long").groupBy("turn", "a", "b").agg(F.sum("votes").alias("votes"))
    nth = F.row_number().over(Window.partitionBy("b", "turn").orderBy(F.desc("votes"), "a"))
    likely = stable(votes.withColumn("nth", nth).where("nth = 1").select("turn", "a", "b"), "likely")
    stars = spark.createDataFrame([], "u long, v long")
    for turn in range(TURNS):
        pairs = _apart(likely.where(F.col("turn") == turn), stars)
        links = linked(pairs, docs, f"links-{turn}")
        stars = components(stars.union(links.select(F.col("a").alias("u"), F.col("b").alias("v"))))

    grouped = lists.join(stars.select(F.col("u").alias("node"), F.col("v").alias("comp")), "node", "left")
    grouped = grouped.select("token", "node", "size", "pos", F.coalesce("comp", "node").alias("comp"))
    of_token = Window.partitionBy("token")
    mixed = F.min("comp").over(of_token) != F.max("comp").over(of_token)
    open_lists = grouped.repartition(shuffle_partitions(spark), "token").withColumn("mixed", mixed)
    open_lists = open_lists.where("mixed").drop("mixed").sortWithinPartitions("token")
    more = linked(open_lists.mapInArrow(tidy(_across), "a long, b long").distinct(), docs, "links-across")
    every = stars.union(more.select(F.col("a").alias("u"), F.col("b").alias("v")))
    roots = components(every)

    placed = same.join(roots.select(F.col("u").alias("node"), F.col("v").alias("root")), "node", "left")
    placed = placed.select("set_hash", F.coalesce("root", "node").alias("root"))
    return sets.join(placed, "set_hash", "left").select(
        "doc_id",
        "n_shingles",
        F.when(F.col("doc_id").isNull() | (F.col("n_shingles") == 0), F.col("doc_id")).otherwise(F.col("root")).alias("component_id"),
    )


def one_of_each(docs: DataFrame) -> DataFrame:
    """``docs`` with the smallest doc_id of each component, columns as they came.

    Rows that share a doc_id, or have none, are linked one by one, by text; a row without a
    doc_id stays only if no row of its component has one. Of rows that share doc_id and text one
    stays. Texts without words, null ones included, are linked with nothing, so all of those
    stay. An empty table gives an empty result.
    """
    row = F.struct(F.col("doc_id").isNull().alias("last"), F.col("doc_id").cast("long").alias("doc_id"), row_mark().alias("mark"))
    ids = row_ids(docs)
    rows = stable(docs.select(ids.alias("row_id"), row.alias("row")), "row-names")
    linked_rows = similar_documents(docs.select(ids.alias("doc_id"), "text")).select(F.col("doc_id").alias("row_id"), "component_id").distinct()
    placed = stable(rows.join(linked_rows, "row_id"), "placed-rows")
    first = placed.groupBy("component_id").agg(F.min("row").alias("first"), F.count("*").alias("n")).where("n > 1")
    decided = stable(placed.join(first, "component_id").select("row.doc_id", "row.mark", (F.col("row") == F.col("first")).alias("kept")), "near-copies")
    again = decided.where("kept").groupBy("doc_id", "mark").count().where("count > 1")
    return without(docs, decided.where("NOT kept"), again)
