"""Fingerprints, periodic runs and tokenizer alignment against plain versions."""

import hashlib
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pytest
import xxhash

from talentmesh.llm import alignment, fingerprints, periodic, queries
from tests.llm import cases

ROWS = cases.awkward_texts()
SF = "/root/testdata/sf0.001"
SHA = lambda s: hashlib.sha256(s.encode()).hexdigest()


def tables(spark, rows, where):
    """``rows`` as the documents table of a folder of their own."""
    cases.documents(spark, rows).write.parquet(f"file://{where}/documents.parquet")
    return f"file://{where}"


# Fingerprints.


def fingerprint_by_hand(text):
    raw = [0, 0, *text.encode()]
    counts = [0] * 256
    for nth, (a, b) in enumerate(((1, 2), (1, 3), (2, 3))):
        for i in range(len(raw) - b):
            value = raw[i] * 65536 + raw[i + a] * 256 + raw[i + b] + (nth << 24)
            counts[value * 2654435761 % 2**32 >> 24] += 1
    ordered = sorted(counts)
    codes = [sum(c > ordered[64 * k - 1] for k in (1, 2, 3)) for c in counts]
    n, length = len(text.encode()), 0
    if n:
        power = n.bit_length() - 1
        length = min(255, 8 * power + int(8 * n / 2**power) - 7)
    return f"{length:02x}" + "".join(f"{codes[i] * 4 + codes[i + 1]:x}" for i in range(0, 256, 2)), codes, length


def likeness_by_hand(a, b):
    (_, x, m), (_, y, n) = fingerprint_by_hand(a), fingerprint_by_hand(b)
    return max(0, 320 - sum(abs(p - q) for p, q in zip(x, y, strict=True)) - min(abs(m - n), 16)) / 320


def edits_by_hand(rows):
    signed = lambda t: (xxhash.xxh64_intdigest(t.encode(), seed=42) + 2**63) % 2**64 - 2**63
    order = sorted(((i, t or "") for i, t in rows), key=lambda r: (r[0] is None, -(r[0] or 0), signed(r[1])))
    out = []
    for (i, text), (_, following) in zip(order, [*order[1:], *order[:1]], strict=True):
        part = len(text) // 3
        edited = text[: len(text) - part] + following[:part]
        out.append((
            i, len(text), SHA(edited), fingerprint_by_hand(text)[0], fingerprint_by_hand(edited)[0],
            likeness_by_hand(text, edited), likeness_by_hand(text, following),
        ))
    return out


SHORT = [r for r in ROWS if len(r[1] or "") < 20_000]
COLUMNS = ("doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next")


def in_order(rows):
    return sorted(rows, key=repr)


@pytest.mark.parametrize("rows", [SHORT, SHORT[:1], SHORT[6:9], [(5, "same text")] * 40 + [(5, "other"), (None, "same text")]])
def test_fingerprints(spark, tmp_path, rows):
    got = queries.op11_fingerprints(spark, tables(spark, rows, tmp_path))
    assert set(got.columns) == set(COLUMNS)
    assert in_order(tuple(r) for r in got.select(*COLUMNS).collect()) == in_order(edits_by_hand(rows))


def test_fingerprints_of_texts(spark):
    docs = cases.documents(spark, ROWS)
    rows = fingerprints.fingerprints(docs).collect()
    assert in_order((r.doc_id, r.n_chars) for r in rows) == in_order((i, len(t or "")) for i, t in ROWS)
    by_text = {(r.doc_id, r.n_chars): r.fingerprint for r in rows}
    assert by_text[7, len(cases.PROSE * 3)] == by_text[8, len(cases.PROSE * 3)] == fingerprint_by_hand(cases.PROSE * 3)[0]
    assert fingerprints.likeness(by_text[1, 0], by_text[2, 0]) == 1.0
    near = fingerprints.likeness(*(by_text[i, len(dict(ROWS)[i])] for i in (9, 10)))
    far = fingerprints.likeness(*(by_text[i, len(dict(ROWS)[i])] for i in (9, 14)))
    assert near > 0.9 > 0.3 > far and near == likeness_by_hand(dict(ROWS)[9], dict(ROWS)[10])
    assert fingerprints.fingerprints(cases.no_documents(spark)).collect() == []
    assert fingerprints.against_edits(cases.no_documents(spark)).collect() == []


def test_fingerprints_match_sql(spark):
    duckdb = pytest.importorskip("duckdb")
    con = duckdb.connect()
    con.sql(f"create view documents as select * from '{SF}/documents.parquet'")
    want = con.sql(queries.ORACLE_SQL["op11_fingerprints"])
    rows = want.fetchall()
    assert sorted(want.columns) == sorted(COLUMNS)
    order = [want.columns.index(c) for c in COLUMNS]
    got = queries.op11_fingerprints(spark, SF).select(*COLUMNS).collect()
    assert in_order(tuple(r) for r in got) == in_order(tuple(r[i] for i in order) for r in rows)
    assert np.mean([r.near_edited > r.near_next for r in got]) > 0.97


# Periodic runs.


def words_of(text):
    return [w for w in re.split(r"[\x20\x09-\x0D]+", text or "") if w]


def runs_by_hand(words):
    n, found = len(words), {}
    for q in range(1, n // 4 + 1):
        i = 0
        while i < n - q:
            j = i
            while j < n - q and words[j] == words[j + q]:
                j += 1
            if j > i and j - i + q >= max(6, 4 * q):
                found.setdefault((i, j + q), q)  # the smallest period comes first
            i = j + 1
    return sorted((s, e - s, q) for (s, e), q in found.items())


def collapsed_by_hand(words, runs):
    gone = {i for s, n, q in runs for i in range(s + q, s + n)}
    return " ".join(w for i, w in enumerate(words) if i not in gone)


@pytest.mark.parametrize("letters, seed", [("ab", 1), ("ab", 2), ("abc", 3), ("a", 4), ("abcdefgh", 5)])
def test_runs_of_words(letters, seed):
    rng = random.Random(seed)
    for _ in range(150):
        words = []
        for _ in range(rng.randrange(5)):
            words += [rng.choice(letters) for _ in range(rng.randrange(12))]
            words += [rng.choice(letters) for _ in range(rng.randrange(1, 9))] * rng.randrange(1, 9)
        numbers = np.array([ord(w) for w in words], dtype=np.int64)
        assert [tuple(r) for r in periodic.runs_of(numbers).tolist()] == runs_by_hand(words)


def test_long_texts_of_few_words():
    assert periodic.runs_of(np.zeros(300_000, dtype=np.int64)).tolist() == [[0, 300_000, 1]]
    assert periodic.runs_of(np.arange(400_000, dtype=np.int64) % 100_000).tolist() == [[0, 400_000, 100_000]]
    assert periodic.runs_of(np.arange(399_999, dtype=np.int64) % 100_000).tolist() == []


def periodic_rows():
    rng = random.Random(9)
    rows = [r for r in ROWS if len(r[1] or "") < 20_000]
    for i in range(100, 160):
        words = []
        for _ in range(3):
            part = [rng.choice("abcd") for _ in range(rng.randrange(1, 7))]
            words += [rng.choice("abcd") for _ in range(rng.randrange(20))] + part * rng.randrange(9)
        rows.append((i, " ".join(words)))
    return [*rows, (160, "a b\ta b\na b\x0ba b"), (161, "a b a b a b a b"), (162, "  " * 9)]


def changed_by_hand(doc_id, words):
    h = zlib.crc32(str(doc_id).encode())
    g, n = h // 10, len(words)
    if doc_id is None or h % 10 or not n:
        return words
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    return [words[i] if i < a else words[a + (i - a) % p] for i in range(n)]


def test_periodic_runs(spark, tmp_path):
    rows = periodic_rows()
    assert sum(zlib.crc32(str(i).encode()) % 10 == 0 and i is not None for i, _ in rows) > 4
    columns = ("doc_id", "n_runs", "start", "length", "period", "exponent_milli", "runs_sha256", "collapsed_sha256")
    want, busy = [], 0
    for i, text in rows:
        words = changed_by_hand(i, words_of(text))
        runs = runs_by_hand(words)
        best = max(runs, key=lambda r: (r[1] / r[2], -r[0], -r[2]), default=(None, None, None))
        milli = 1000 * best[1] // best[2] if runs else None
        busy += len(runs) > 1
        want.append((i, len(runs), *best, milli, SHA("".join(f"{s},{n},{q}\n" for s, n, q in runs)), SHA(collapsed_by_hand(words, runs))))
    got = queries.op12_periodic_runs(spark, tables(spark, rows, tmp_path))
    assert tuple(got.columns) == columns and busy > 5
    assert in_order(tuple(r) for r in got.collect()) == in_order(want)


def test_periodic_runs_of_texts(spark):
    rows = {r.doc_id: r for r in periodic.periodic_runs(cases.documents(spark, periodic_rows())).collect()}
    assert [r.asDict() for r in rows[161].runs] == [{"start": 0, "length": 8, "period": 2}]
    assert rows[161].collapsed == "a b" and rows[160].collapsed == "a b" and rows[162].n_words == 9
    assert rows[1].runs == [] and rows[1].collapsed == "" and rows[3].n_words == 0
    whole = {r.doc_id: r for r in periodic.periodic_runs(cases.documents(spark, ROWS)).collect()}
    assert whole[16].n_words == len(words_of(dict(ROWS)[16]))
    assert periodic.periodic_runs(cases.no_documents(spark)).collect() == []


# Alignment.

BYTE_LEVEL, PIECES = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")


def aligned_by_hand(rows):
    import sentencepiece
    from tokenizers import Tokenizer
    from tokenizers.decoders import ByteLevel

    left, right = Tokenizer.from_file(BYTE_LEVEL), sentencepiece.SentencePieceProcessor(model_file=PIECES)
    left.encode_special_tokens = True
    printable = [*range(33, 127), *range(161, 173), *range(174, 256)]
    letters = {chr(b): b for b in printable} | {chr(256 + i): b for i, b in enumerate(b for b in range(256) if b not in printable)}
    assert ByteLevel().decode(["Ġa"]) == " a" and letters["Ġ"] == 32
    out, counts = [], Counter()
    for i, text in rows:
        a, b, links, groups = [], [], Counter(), []
        if text:
            coded = left.encode(" " + text, add_special_tokens=False)
            a, b = [(t, bytes(letters[c] for c in s)) for t, s in zip(coded.ids, coded.tokens, strict=True)], []
            for t in right.encode(text):
                piece = right.id_to_piece(t)
                b.append((t, bytes([int(piece[3:5], 16)]) if re.fullmatch("<0x..>", piece) else piece.replace("▁", " ").encode()))
            if any(b"".join(raw for _, raw in side) != (" " + text).encode() for side in (a, b)):
                a, b = [], []
            x = y = 0
            while x < len(a):
                first, second = [a[x][0]], [b[y][0]]
                end_a, end_b, x, y = len(a[x][1]), len(b[y][1]), x + 1, y + 1
                while end_a != end_b:
                    if end_a < end_b:
                        first.append(a[x][0])
                        end_a, x = end_a + len(a[x][1]), x + 1
                    else:
                        second.append(b[y][0])
                        end_b, y = end_b + len(b[y][1]), y + 1
                groups.append((first, second))
                links.update((p, q) for p in first for q in second)
        counts.update(links.keys())
        out.append((i, len(a), len(b), groups, links))
    top = defaultdict(int)
    for (p, _), n in counts.items():
        top[p] = max(top[p], n)
    told = lambda groups: ";".join(",".join(map(str, f)) + "|" + ",".join(map(str, s)) for f, s in groups)
    return [
        (i, n_a, n_b, len(groups), sum(links.values()), sum(n for p, n in links.items() if counts[p] == top[p[0]]),
         sum(n * counts[p] for p, n in links.items()), told(groups))
        for i, n_a, n_b, groups, links in out
    ], counts, top


def alignment_rows():
    return [*ROWS, (50, "ends <|endoftext|> inside <s> and </s>"), (51, "a ▁ b"), (52, "tabs\tand\x00nul \x7f"), (53, "日本" * 300),
            (54, "é \U0001f926\U0001f3fc‍♂️  double  spaces "), (55, "aaaa" * 500 + "\n\n\n"), (56, " "), *[(60 + i, "one two") for i in range(300)]]


def test_alignment(spark, tmp_path):
    rows = alignment_rows()
    want, counts, top = aligned_by_hand(rows)
    docs = cases.documents(spark, rows)
    got, pairs = alignment.aligned(docs, BYTE_LEVEL, PIECES)
    assert in_order(tuple(r) for r in got.collect()) == in_order(want)
    assert {(r.a, r.b): (r["count"], r.best) for r in pairs.collect()} == {p: (n, n == top[p[0]]) for p, n in counts.items()}
    query = queries.op13_alignment(spark, tables(spark, rows, tmp_path)).collect()
    assert in_order((*r[:7], r.groups_sha256) for r in query) == in_order((*r[:7], SHA(r[7]) if r[7] else "") for r in want)
    assert any(r[0] == 51 and r[1] == 0 for r in want) and any(r[4] > r[3] for r in want)


def test_alignment_of_nothing(spark):
    rows, pairs = alignment.aligned(cases.no_documents(spark), BYTE_LEVEL, PIECES)
    assert rows.collect() == [] and pairs.collect() == []
    rows, pairs = alignment.aligned(cases.documents(spark, [(1, None), (None, "")]), BYTE_LEVEL, PIECES)
    assert in_order(tuple(r) for r in rows.collect()) == in_order([(i, *[0] * 6, "") for i in (1, None)])
    assert pairs.collect() == []


def test_bitmaps():
    rng = np.random.default_rng(1)
    for n in (0, 1, 200, alignment._FULL - 1, alignment._FULL, 4000, 4096):
        places = np.sort(rng.permutation(alignment.BLOCK_DOCUMENTS)[:n])
        data = alignment.bitmap(places)
        assert (alignment.places_of(data) == places).all() and len(data) <= alignment.BLOCK_DOCUMENTS // 8 + 1
    rows, places, links = np.array([0, 0, 0, 0, 1, 2]), np.array([3, 5, 9, 11, 4, 6]), np.array([1, 2, 3, 8, 1, 3])
    planes = alignment.planes_of(rows, places, links, 4)
    assert [[alignment.places_of(p).tolist() for p in own] for own in planes] == [[[5, 11], [9, 11], [11]], [], [[], [6]], []]


@pytest.mark.parametrize("large", [0, alignment.LARGE_GROUP])
def test_links_of_large_groups(monkeypatch, large):
    monkeypatch.setattr(alignment, "LARGE_GROUP", large)
    sizes = np.array([0, 1, 2, 3, 0, 0, 0, 2, 3])
    groups = alignment.Groups([np.array([1, 2, 1]), np.array([3])], [np.array([7, 7]), np.array([8])], sizes, sizes)
    told = Counter()
    for text, pair, n in zip(*(x.tolist() for x in groups.links()), strict=True):
        told[text, pair >> 20, pair & (1 << 20) - 1] += n
    assert told == {(0, 1, 7): 4, (0, 2, 7): 2, (1, 3, 8): 1}
    assert groups.written(alignment.signed_names(9, 9)) == ["1,2,1|7,7", "3|8"]
