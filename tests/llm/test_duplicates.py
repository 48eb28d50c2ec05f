"""Exact copies, line chunks, near copies and repeated strings against plain versions."""

import hashlib
import random
import re
from collections import Counter

import pytest
from pyspark.sql import functions as F

from talentmesh.llm import exact, jaccard, lines, suffixdedup
from talentmesh.llm.components import components
from talentmesh.llm.suffixsort import suffix_array
from tests.llm import cases

ROWS = cases.awkward_texts()


def key(rows):
    return sorted(rows, key=repr)


@pytest.mark.parametrize("hash_of", [exact.content_hash, lambda text: F.lit(b"\0" * 16)], ids=["md5", "all collide"])
def test_exact_groups(spark, hash_of):
    norm = [(i, re.sub(r"[\x20\x09-\x0D]+", " ", t or "")) for i, t in ROWS]
    size = Counter(t for _, t in norm)
    least = {}
    for i, t in norm:
        if i is not None:
            least[t] = min(least.get(t, i), i)
    want = [(i, least.get(t), size[t], i == least.get(t), hashlib.sha256(t.encode()).hexdigest()) for i, t in norm]
    got = exact.exact_groups(cases.documents(spark, ROWS), hash_of)
    assert key(map(tuple, got.collect())) == key(want)


def test_exact_copies_go_and_rows_stay_once(spark):
    docs = cases.documents(spark, ROWS)
    kept = exact.without_copies(docs)
    assert kept.columns == docs.columns
    ids = [r.doc_id for r in kept.collect()]
    assert sorted(i for i in ids if i) == [1, 3, 4, 5, 7, 9, 10, 11, 12, 13, 14, 15, 16, 17, 19, 21, 22] and ids.count(None) == 1


def chunks_by_hand(text):
    own = (text or "").split("\n")
    h = [int(hashlib.md5(x.encode()).hexdigest()[:7], 16) for x in own]
    rolled = [sum(h[i - j] * pow(lines.BASE, j, lines.MODULUS) for j in range(lines.WINDOW) if i >= j) % lines.MODULUS for i in range(len(own))]
    cut = [r % lines.DIVISOR == 0 for r in rolled]
    out, start = [], 0
    for i in range(len(own)):
        if (i and cut[i] and not cut[i - 1]) or i == len(own) - 1:
            out.append(own[start : i + 1])
            start = i + 1
    assert all(len(c) > 1 for c in out[:-1])
    return out


def test_repeated_chunks(spark):
    seen, want = set(), []
    for i, t in sorted({r for r in ROWS if r[0] is not None}):
        left = []
        for chunk in chunks_by_hand(t):
            if len(chunk) > 1 and tuple(chunk) in seen:
                continue
            if len(chunk) > 1:
                seen.add(tuple(chunk))
            left.append(chunk)
        text = "\n".join("\n".join(c) for c in left)
        want += [(i, text, len((t or "").split("\n")), sum(map(len, chunks_by_hand(t))) - sum(map(len, left)))] * ROWS.count((i, t))
    want += [(i, t, 1, 0) for i, t in ROWS if i is None]
    got = lines.without_repeated_chunks(cases.documents(spark, ROWS)).collect()
    assert key(map(tuple, got)) == key(want)
    assert any(w[3] for w in want)


def run_rows():
    rng = random.Random(6)
    line = lambda: " ".join(rng.choice("abcdefgh") * rng.randrange(1, 5) for _ in range(rng.randrange(1, 9)))
    passage = [line() for _ in range(30)]
    rows = list(ROWS)
    for k in range(20):
        a = rng.randrange(28)
        run = passage[a : rng.randrange(a + 2, 31)]
        rows.append((4000 + k, "\n".join([*(line() for _ in range(rng.randrange(4))), *run, *(line() for _ in range(rng.randrange(4)))])))
    return [*rows, (4100, "\n".join(passage)), (4101, "\n".join(passage)), (4102, "a\na\na"), (4103, "\n\n"), (4104, "once\ntwice")]


def test_repeated_runs(spark):
    rows = run_rows()
    seen, want = set(), []
    for i, t in sorted({r for r in rows if r[0] is not None}):
        own, gone = (t or "").split("\n"), set()
        for k, pair in enumerate(zip(own, own[1:])):
            gone |= {k, k + 1} if pair in seen else set()
            seen.add(pair)
        want += [(i, "\n".join(x for k, x in enumerate(own) if k not in gone), len(own), len(gone))] * rows.count((i, t))
    want += [(i, t, 1, 0) for i, t in rows if i is None]
    got = lines.without_repeated_runs(cases.documents(spark, rows)).collect()
    assert key(map(tuple, got)) == key(want)


def test_an_exact_copy_of_several_lines_goes_whole(spark):
    rows = [(1, "\n".join(f"line {i}" for i in range(60))), (2, "\n".join(f"line {i}" for i in range(60)))]
    got = {r.doc_id: r.n_removed for r in lines.without_repeated_runs(cases.documents(spark, rows)).collect()}
    assert got == {1: 0, 2: 60}


def near_rows():
    rng = random.Random(3)
    words = [f"w{i}" for i in range(3000)]
    rows = list(cases.awkward_texts())
    for g in range(12):
        base = [rng.choice(words) for _ in range(rng.choice([6, 30, 80, 200]))]
        for k in range(rng.choice([2, 3, 9])):
            edited = list(base)
            for _ in range(rng.randrange(0, 4)):
                edited[rng.randrange(len(edited))] = rng.choice(words)
            rows.append((1000 + 20 * g + k, " ".join(edited)))
    return rows


def test_similar_documents(spark):
    rows = near_rows()
    want = cases.components_by_hand(rows)
    got = jaccard.similar_documents(cases.documents(spark, rows)).collect()
    assert len(got) == len(rows)
    for r in got:
        if r.doc_id is None:
            assert r.component_id is None
        else:
            assert (r.n_shingles, r.component_id) == want[r.doc_id]
    kept = jaccard.one_of_each(cases.documents(spark, rows)).select("doc_id").where("doc_id IS NOT NULL").distinct()
    assert {r[0] for r in kept.collect()} == {i for i, (_, c) in want.items() if i == c}


def test_lists_are_skipped_but_no_pair_is_lost(spark):
    """The pairs across components of one long list, with blocks of 256 entries, against all pairs."""
    import numpy as np
    import pyarrow as pa

    rng = np.random.default_rng(1)
    n = 700
    size, pos = rng.integers(5, 400, n), rng.integers(0, 5, n)
    batch = pa.RecordBatch.from_arrays(
        [pa.array(x) for x in (np.full(n, 9), np.arange(n), size.astype(np.int32), pos.astype(np.int32), np.arange(n) % 50)],
        ["token", "node", "size", "pos", "comp"],
    )
    got = {(a, b) for part in jaccard._across(iter([batch.slice(0, 300), batch.slice(300)])) for a, b in zip(*(c.to_pylist() for c in part.columns[:2]))}
    want = set()
    for a in range(n):
        for b in range(a + 1, n):
            small, large = sorted((size[a], size[b]))
            room = min(size[a] - pos[a], size[b] - pos[b])
            if a % 50 != b % 50 and 100 * small >= 75 * large and 175 * room >= 75 * (size[a] + size[b]):
                want.add((a, b))
    assert got == want


def test_components_of_a_path_and_a_star(spark):
    path = [(i, i + 1) for i in range(50)] + [(100, 100 + i) for i in range(1, 30)] + [(7, 7)]
    got = components(spark.createDataFrame(path, "u long, v long"))
    assert sorted(map(tuple, got.collect())) == sorted([(i, 0) for i in range(1, 51)] + [(100 + i, 100) for i in range(1, 30)])
    assert not components(spark.createDataFrame([], "u long, v long")).count()


def test_suffix_array():
    rng = random.Random(2)
    for _ in range(1500):
        s = [rng.randrange(rng.choice([1, 2, 4])) for _ in range(rng.randrange(25))]
        assert suffix_array(s) == sorted(range(len(s)), key=lambda i: s[i:])


def repeat_rows():
    rng = random.Random(8)
    letters = lambda n: "".join(rng.choice("abcdefg é") for _ in range(n))
    passage = letters(900)
    rows = list(cases.awkward_texts())
    for k in range(14):
        cut = rng.randrange(0, 300)
        rows.append((2000 + k, letters(rng.randrange(300)) + passage[cut : cut + rng.randrange(380, 600)] + letters(rng.randrange(90))))
    rows += [(3000, letters(500) * 3), (3001, "ab" * 700), (3002, letters(399)), (3003, "é" * 201)]
    return rows


@pytest.mark.parametrize("crowd", [suffixdedup.CROWD, 2], ids=["sorted", "crowded"])
def test_repeated_strings(spark, monkeypatch, crowd):
    monkeypatch.setattr(suffixdedup, "CROWD", crowd)
    rows = repeat_rows()
    want = []
    for i, raw, flags in cases.covered_by_hand(rows):
        kept = bytes(b for b, f in zip(raw, flags) if not f)
        spans = sum(1 for k, f in enumerate(flags) if f and (not k or not flags[k - 1]))
        want.append((i, len(raw), sum(flags), spans, kept))
    got = suffixdedup.without_repeats(cases.documents(spark, rows)).drop("rest").collect()
    assert key((*r[:4], bytes(r[4])) for r in got) == key(want)


def test_remaining_texts_are_text(spark):
    rows = repeat_rows()
    docs = cases.documents(spark, rows)
    done = suffixdedup.remaining_texts(docs)
    assert done.schema.names == docs.schema.names and done.select("source").distinct().count() == 1
    for r in done.collect():
        assert r.text is not None and "�" not in r.text and r.n_chars == len(r.text)


def test_long_documents_are_looked_at_in_stretches(monkeypatch):
    rng = random.Random(4)
    text = bytes(rng.randrange(97, 101) for _ in range(5000))
    whole = {i: p for _, p, lo, hi in suffixdedup.anchor_runs(text) for i in range(lo, hi + 1)}
    monkeypatch.setattr(suffixdedup, "STRETCH", 700)
    assert whole == {i: p for _, p, lo, hi in suffixdedup.anchor_runs(text) for i in range(lo, hi + 1)}
    assert len(whole) == 5000 - 399


@pytest.mark.parametrize(
    "operator", [exact.exact_groups, exact.without_copies, lines.without_repeated_chunks, jaccard.similar_documents, suffixdedup.without_repeats]
)
def test_empty_tables(spark, operator):
    assert operator(cases.no_documents(spark)).collect() == []


@pytest.mark.parametrize("of", [suffixdedup.BYTES, suffixdedup.WORDS], ids=["bytes", "words"])
def test_only_slices_in_doubt_are_sorted(of):
    rng = random.Random(5)
    side = lambda pool: b"".join(rng.choice(pool) for _ in range(rng.randrange(of.slice)))
    pool = [bytes([c]) * of.width for c in (97, 98)]
    kinds = {}
    for k in range(40):
        before, after = side(pool[:1]) + side(pool)[:2 * of.width], side(pool[:1])
        before = before[max(0, len(before) - (of.slice - 1) * of.width) :]
        if len(before) + len(after) >= (of.slice - 1) * of.width:
            kinds[bytes([k % 5]), before, after] = None
    keys, strings = [k for k, *_ in sorted(kinds)], [(b, a) for _, b, a in sorted(kinds)]
    w, text = of.width, lambda s, b: (s[0][len(s[0]) - b * of.width :], s[1][: (of.slice - 1 - b) * of.width])
    uses = Counter((k, b, text(s, b)) for k, s in zip(keys, strings, strict=True) for b in suffixdedup.starts_of(*s, of))
    want = [sum(1 << b for b in suffixdedup.starts_of(*s, of) if uses[k, b, text(s, b)] > 1) for k, s in zip(keys, strings, strict=True)]
    doubt = suffixdedup.in_doubt(keys, strings, of)
    own = [keys[i] for i, _ in doubt]
    bits = suffixdedup.repeats_among([s for _, s in doubt], [ord(k) for k in own], of)
    got = dict(zip([i for i, _ in doubt], bits, strict=True))
    assert any(want) and [got.get(i, 0) for i in range(len(keys))] == want
    lone = [(b"x" * (w * 31), b"y" * (w * 31)), (b"z" * (w * 31), b"v" * (w * 31))]
    assert suffixdedup.in_doubt([b"k", b"k"], lone, of) == [] and suffixdedup.in_doubt([b"k", b"q"], lone[:1] * 2, of) == []


def test_contexts_are_counted_without_sorting(spark, monkeypatch):
    plans = {}

    def kept(df, name):
        plans[name] = df._jdf.queryExecution().executedPlan().toString()
        return stable(df, name)

    stable = suffixdedup.stable
    monkeypatch.setattr(suffixdedup, "stable", kept)
    suffixdedup.repeated_ranges(cases.documents(spark, repeat_rows()).withColumn("mark", F.lit(0).cast("long")).na.fill(""))
    assert "HashAggregate" in plans["contexts"] and "SortAggregate" not in plans["contexts"]
