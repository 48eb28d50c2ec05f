"""Packing, BPE, language, quality, neighbours and sharding against plain versions and held-out rows."""

import hashlib
import random
import zlib
from collections import defaultdict

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F

from talentmesh.llm import ann, bpe, langid, packing, quality, sharding
from tests.llm import cases

ROWS = cases.awkward_texts()
SF = "/root/testdata/sf0.001"
VOCABULARY = public_tokenizers.path("byte_bpe_50k.json")
RANKS = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")


def check_packing(pieces, ids_of):
    """Every id lies in one piece, sequences are gapless and fit; returns the share of padding."""
    by_doc, by_sequence = defaultdict(list), defaultdict(list)
    for r in pieces:
        by_doc[r.doc_id].append(r)
        by_sequence[r.sequence_id].append(r)
    assert set(by_doc) == set(ids_of)
    for doc_id, rows in by_doc.items():
        ids, copies = ids_of[doc_id]
        assert sum(r.length for r in rows) == copies * len(ids)
        for r in rows:
            assert r.doc_tokens == len(ids) and r.ids_crc32 == zlib.crc32(ids[r.start : r.start + r.length].tobytes())
    for rows in by_sequence.values():
        at = 0
        for r in sorted(rows, key=lambda r: r.offset):
            assert r.offset == at and r.length > 0
            at += r.length
        assert at <= 1024
    return 1 - sum(r.length for r in pieces) / 1024 / len(by_sequence)


def token_ids(rows):
    from tokenizers import Tokenizer

    coder = Tokenizer.from_file(VOCABULARY)
    out = {}
    for i, t in rows:
        ids = np.array([*coder.encode(t or "", add_special_tokens=False).ids, 0], dtype="<u4")
        out[i] = (ids, out[i][1] + 1 if i in out else 1)
    return out


def test_packing(spark):
    rows = [*ROWS, (50, "ends <|endoftext|> inside")]
    pieces = packing.pack(cases.documents(spark, rows), VOCABULARY).collect()
    check_packing(pieces, token_ids(rows))
    assert packing.pack(cases.no_documents(spark), VOCABULARY).collect() == []


def test_packing_pads_little(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    pieces = packing.pack(docs, VOCABULARY).collect()
    assert check_packing(pieces, token_ids([(r.doc_id, r.text) for r in docs.collect()])) < 0.02


@pytest.mark.parametrize("histogram", [{1: 1}, {1024: 3}, {600: 7, 424: 5, 10: 1}, {n: n % 7 + 1 for n in range(1, 1025)}])
def test_plans_use_up_the_histogram(histogram):
    plan, used = packing.plan_sequences(histogram), defaultdict(int)
    for pattern, times in plan:
        assert times > 0 and sum(n * a for n, a in pattern.items()) <= 1024
        for n, a in pattern.items():
            used[n] += a * times
    assert dict(used) == histogram
    least = -(-sum(n * c for n, c in histogram.items()) // 1024)
    assert sum(t for _, t in plan) <= max(least * 1.01 + 1, histogram.get(600, 0))


def test_column_generation_reaches_the_bound():
    lengths, demand = np.array([310, 340, 350, 360, 700]), np.array([40.0, 90.0, 70.0, 30.0, 10.0])
    basis, used = packing.solve_patterns(lengths, demand)
    assert np.allclose(basis @ used, demand) and (lengths @ basis <= 1024).all()
    value, _ = packing.best_pattern(lengths, np.maximum(np.linalg.inv(basis).sum(axis=0), 0), 1024)
    assert value <= 1 + 1e-6 or used.sum() <= 1.0006 * np.linalg.inv(basis).sum(axis=0) @ demand / value


def tiktoken_of(path):
    import tiktoken

    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=bpe.read_ranks(path), special_tokens={})


def test_bpe_encodes_and_decodes(spark):
    coder = tiktoken_of(RANKS)
    want = []
    for i, t in ROWS:
        ids = np.array(coder.encode_ordinary(t or ""), dtype="<u4").tobytes()
        want.append((i, len(ids) // 4, hashlib.sha256(ids).hexdigest(), hashlib.sha256((t or "").encode()).hexdigest()))
    got = bpe.encode_decode(cases.documents(spark, ROWS), RANKS, public_tokenizers.PATTERN).collect()
    assert sorted(map(tuple, got), key=repr) == sorted(want, key=repr)
    assert bpe.encode_decode(cases.no_documents(spark), RANKS, public_tokenizers.PATTERN).collect() == []
    nothing = hashlib.sha256(b"").hexdigest()
    blank = bpe.encode_decode(cases.documents(spark, [(1, None), (2, "")]), RANKS, public_tokenizers.PATTERN).collect()
    assert sorted(map(tuple, blank)) == [(1, 0, nothing, nothing), (2, 0, nothing, nothing)]


def test_heap_and_fold_agree():
    coder, ranks = tiktoken_of(RANKS), bpe.read_ranks(RANKS)
    rng = random.Random(1)
    for n in (1, 2, 5, 300, 3000):
        for letters in ("a", "ab", "thequickbrown", "éß日"):
            word = "".join(rng.choice(letters) for _ in range(n))
            assert bpe.merge_long(word.encode(), ranks) == coder._encode_single_piece(word.encode())


def phrases_by_hand(text, known):
    count, i = 0, 0
    while i < len(text):
        j = i
        while j < len(text) and text[i : j + 1] in known:
            j += 1
        count += 1
        i = max(j, i + 1)
    return count


def test_phrases_are_longest_matches():
    texts = {"x": ["abracadabra alakazam"], "y": ["the cat sat on the mat"]}
    model = langid.fit(texts)
    for text in ("abracat", "the sad cat alakazam", "zzz", "a", "q!q"):
        got = langid.phrases(model, [text])[0]
        size = len(langid.symbols(text, model.symbol))
        for k, lang in enumerate(model.languages):
            trained = langid.symbols("\n" + texts[lang][0], model.symbol).tobytes().decode("latin-1")
            parsed = langid.symbols(text, model.symbol).tobytes().decode("latin-1")
            assert got[k] == pytest.approx(phrases_by_hand(parsed, trained) * model.weight[k] / size)


def test_segments_count_every_symbol(monkeypatch):
    model = langid.fit({"x": ["abcabc"], "y": ["xyz"]})
    monkeypatch.setattr(langid, "SEGMENT", 4)
    costs = langid.phrases(model, ["abcabcabc", "", "xyzx"])
    assert costs[0][0] == pytest.approx(3 * model.weight[0] / 9)
    assert costs[2][1] == pytest.approx(2 * model.weight[1] / 4) and costs[1][0] == 0


def test_language_of_held_out_documents(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    got = {r.doc_id: r for r in langid.identify(docs).collect()}
    held = [r for r in docs.collect() if got[r.doc_id].held_out]
    assert {i for i, r in got.items() if r.held_out} == {r.doc_id for r in docs.collect() if zlib.crc32(str(r.doc_id).encode()) % 3 == 1}
    assert sum(got[r.doc_id].lang_pred == r.lang for r in held) >= 0.97 * len(held)
    assert all(0 <= r.score <= 1 for r in got.values())


def test_language_of_awkward_texts(spark):
    docs = cases.documents(spark, ROWS)
    got = langid.identify(docs).collect()
    assert len(got) == len(ROWS)
    no_letter = {1, 2, 3, 4, 18}
    assert all((r.lang_pred == "und") == (r.doc_id in no_letter) and (r.score == 0 or r.doc_id not in no_letter) for r in got)
    assert langid.identify(cases.no_documents(spark)).collect() == []
    unknown = langid.identify(docs.withColumn("lang", F.lit(None).cast("string"))).collect()
    assert {r.lang_pred for r in unknown} == {"und"}
    kept = langid.with_language(docs)
    assert kept.columns == docs.columns and {r.doc_id for r in kept.collect()} == {i for i, _ in ROWS} - no_letter


def test_quality_of_held_out_documents(spark):
    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.01/{t}.parquet") for t in ("documents", "labels"))
    truth = {r.doc_id: r.quality for r in labels.collect()}
    got = [r for r in quality.judge(docs, labels, F.col("source"), F.col("lang")).collect() if r.held_out and r.doc_id in truth]
    assert sum(r.kept == (truth[r.doc_id] == 1) for r in got) >= 0.97 * len(got)


def test_sites_are_shrunk(spark):
    rows, labels = [], []
    for i in range(900):
        host = "good" if i % 3 else "bad"
        rows.append((i, "same words here", host, "p" if i < 890 else "rare"))
        labels.append((i, 1 if (i % 3 and i % 10) or i % 13 == 0 else 0))
    rows += [(901, "same words here", "unseen", "p"), (902, None, None, None), (901, "same words here", "unseen", "p")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, h string, p string").withColumn("quality", F.lit("clash"))
    known = spark.createDataFrame([*labels, (901, None), (None, 1)], "doc_id long, quality int")
    got = defaultdict(list)
    for r in quality.judge(docs, known, F.col("h"), F.col("p")).collect():
        got[r.doc_id].append(r)
    assert len(got[901]) == 2 and got[902][0].quality is not None
    mean = np.mean([y for i, y in labels if zlib.crc32(str(i).encode()) % 3 != 1])
    assert got[901][0].host_rate == pytest.approx(mean, abs=0.01)
    good, bad = got[1][0], got[0][0]
    assert bad.host_rate < mean < good.host_rate and bad.path_rate < good.path_rate
    empty = quality.judge(docs.limit(0), known.limit(0), F.col("h"), F.col("p"))
    assert empty.collect() == []


def by_hand(rows, k):
    out = {}
    vectors = {i: np.array(v, dtype=float) for i, v in rows}
    for q in (i for i in vectors if i % 50 == 0):
        scored = []
        for i, v in vectors.items():
            if i != q:
                scored.append((-(v @ vectors[q]) / (np.linalg.norm(v) * np.linalg.norm(vectors[q])), i))
        out[q] = sorted(scored)[:k]
    return out


def test_neighbours(spark):
    rng = np.random.default_rng(6)
    rows = [(i, rng.standard_normal(16).astype(np.float32).tolist()) for i in range(300)]
    rows += [(i, rows[50][1]) for i in range(300, 340)]
    awkward = [(500, None), (501, [0.0] * 16), (502, [float("nan")] * 16), (503, [None] * 16), (504, [1.0]), (None, [1.0] * 16), (505, [])]
    docs = spark.createDataFrame([*rows, *awkward, rows[7]], "vec_id long, embedding array<float>")
    docs = docs.withColumns({"list": F.lit(1), "id": F.lit(2), "score": F.lit(3), "rank": F.lit(4)})
    got = defaultdict(list)
    for r in ann.nearest(docs, F.col("vec_id") % 50 == 0).collect():
        got[r.query_id].append(r)
    want = by_hand(rows, 5)
    assert set(got) == set(want)
    hits = 0
    for q, found in got.items():
        found.sort(key=lambda r: r["rank"])
        assert [r["rank"] for r in found] == [1, 2, 3, 4, 5]
        hits += len({r.vec_id for r in found} & {i for _, i in want[q]})
    assert hits >= 0.9 * 5 * len(want)
    assert [r.vec_id for r in got[50]] == [300, 301, 302, 303, 304]


def test_few_neighbours_and_none(spark):
    docs = spark.createDataFrame([(0, [1.0, 0.0]), (1, [1.0, 1.0]), (2, [0.0, 1.0])], "vec_id long, embedding array<double>")
    got = sorted(map(tuple, ann.nearest(docs, F.col("vec_id") % 50 == 0).collect()))
    assert [(q, r, i) for q, r, i, _ in got] == [(0, 1, 1), (0, 2, 2)] and got[0][3] == pytest.approx(0.5**0.5)
    assert ann.nearest(docs.limit(0), F.lit(True)).collect() == []
    assert ann.nearest(docs.where("vec_id < 0"), F.lit(True)).collect() == []


def test_tests_abandon_only_the_far():
    rng = np.random.default_rng(0)
    rows = ann.unit(rng.standard_normal((4000, 64))) @ ann.rotation(64)
    lost = 0
    for q in range(20):
        near = np.argsort(((rows - rows[q]) ** 2).sum(axis=1))[1:6]
        lost += len(set(near.tolist()) - set(ann.scan(rows, rows[q], 6).tolist()))
    assert lost <= 2


def table_by_hand(shards, slots):
    orders = {}
    for s in shards:
        d = hashlib.md5(s.encode()).digest()
        offset, skip = int.from_bytes(d[:8], "big") % slots, int.from_bytes(d[8:], "big") % (slots - 1) + 1
        orders[s] = [(offset + j * skip) % slots for j in range(slots)]
    table, free = [None] * slots, set(range(slots))
    while free:
        for s in sorted(shards):
            if free:
                slot = next(x for x in orders[s] if x in free)
                table[slot] = s
                free.discard(slot)
    return table


def test_shards_take_turns():
    shards = [f"s{i}" for i in range(7)]
    want = table_by_hand(shards, 101)
    assert [shards[i] for i in sharding.fill_slots(shards, 101)] == want
    full = sharding.fill_slots(sharding.SHARDS)
    counts = np.bincount(full)
    assert counts.max() - counts.min() <= 1 and len(full) == sharding.SLOTS
    fewer = sharding.fill_slots(sharding.SHARDS[:-1])
    moved = sum(a != b for a, b in zip(full, fewer) if a != len(sharding.SHARDS) - 1)
    assert moved < 0.1 * len(full)
    for bad in ((), ("a", "a")):
        with pytest.raises(ValueError):
            sharding.fill_slots(bad, 101)
    with pytest.raises(ValueError):
        sharding.fill_slots(shards, 100)


def test_placement(spark):
    table = [sharding.SHARDS[i] for i in sharding.fill_slots(sharding.SHARDS)]
    got = sharding.placements(cases.documents(spark, ROWS)).collect()
    assert len(got) == len(ROWS)
    for r in got:
        text = "" if r.doc_id is None else str(r.doc_id)
        slot = int(hashlib.md5(text.encode()).hexdigest()[:15], 16) % sharding.SLOTS
        assert (r.slot, r.shard) == (slot, table[slot])
    assert sorted(r.n_bytes for r in got) == sorted(len((t or "").encode()) for _, t in ROWS)
    assert sharding.placements(cases.no_documents(spark)).collect() == []


def test_written_shards(spark, tmp_path):
    sharding.write_shards(cases.documents(spark, ROWS).select("doc_id", "text"), f"{tmp_path}/out", rows_per_file=5)
    back = spark.read.parquet(f"{tmp_path}/out")
    assert back.count() == len(ROWS) and set(back.columns) == {"doc_id", "text", "slot", "shard"}


def test_words_are_sorted_once_and_long_ones_come_along(spark):
    import tiktoken

    words = spark.createDataFrame([(b, n, w) for b in (7, 3, 5) for n, w in enumerate(["tree", "ab" * 200, "Baum", "x" * 999])], "block long, n int, word string")
    done = bpe._with_ids(words, RANKS)
    assert done._jdf.queryExecution().executedPlan().toString().count("Sort [") == 1
    coder = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=bpe.read_ranks(RANKS), special_tokens={})
    got = {(r.block, r.n): np.frombuffer(r.ids, dtype="<u2").tolist() for r in done.collect()}
    assert got == {(r.block, r.n): coder.encode_ordinary(r.word) for r in words.collect()}


def test_fold_reads_bytes_without_digits(spark):
    ranks = bpe.read_ranks(RANKS)
    words = ["", *map(chr, range(1, 400)), *(chr(c) * 2 for c in (0x7FF, 0x800, 0x65E5, 0x1F600, 0x10FFFF)), " tree", "\u00e9\u00df\u65e5"]
    df = spark.createDataFrame([(w,) for w in words], "word string")
    done = df.select("word", bpe.short_integers(bpe.encoded(F.col("word"), bpe.RankMap(ranks))).alias("ids")).where("word <> ''")
    plan = done._jdf.queryExecution().optimizedPlan().toString()
    assert "conv(" not in plan and "lpad(" not in plan
    want = {w: np.array(bpe.merge_long(w.encode(), ranks), dtype="<u2").tobytes() for w in words if w}
    assert {r.word: bytes(r.ids) for r in done.collect()} == want
    ends = spark.range(1).select(bpe.short_integers(F.array(*[F.lit(i).cast("bigint") for i in (0, 1, 255, 256, 65535)])).alias("ids"))
    assert bytes(ends.first().ids) == np.array([0, 1, 255, 256, 65535], dtype="<u2").tobytes()
