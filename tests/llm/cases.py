"""Small document tables that hold every awkward case, and plain versions of what is counted."""

from __future__ import annotations

import random
import re

from pyspark.sql import functions as F

PROSE = (
    "The harbour master wrote down every ship that passed the lighthouse before noon, and nobody asked why. "
    "Later the book was found under a pile of nets, wet and barely legible, yet complete to the last page. "
)
#: Names that operators use inside.
CLASHES = ("hash", "content", "id", "keep_id", "kept", "rank", "node", "token", "u", "v", "block", "word", "slot", "shard", "mark", "rest", "key")


def awkward_texts() -> list[tuple[int | None, str | None]]:
    rng = random.Random(5)
    words = [("".join(rng.choice("aeiou bcdlmnrst") for _ in range(7))).strip() or "a" for _ in range(400)]
    prose = lambda n: " ".join(rng.choice(words) for _ in range(n))
    shared, base = prose(120), prose(260)
    near = base.split(" ")
    near[17] = "changed"
    rows: list[tuple[int | None, str | None]] = [
        (1, None), (2, ""), (3, " \t\n"), (4, "7 8 9"), (5, "one two"), (6, "one  two"), (7, PROSE * 3), (8, PROSE * 3),
        (8, PROSE * 3), (9, base), (10, " ".join(near)), (11, shared + "\n" + prose(50)), (12, prose(40) + "\n" + shared),
        (13, "Straße naïve 日本語 " + prose(30)), (14, "x" * 1500), (15, "line a\nline b\nline c\n" * 40), (16, prose(20_000)),
        (17, "ÉÉÉ" + "é" * 900), (18, None), (19, "<|end|> 'll don't 1234567    end"), (None, "no number " + prose(10)),
        (20, "one\ttwo"), (21, "a b c d e f g"), (22, "A B C D E F G"),
    ]
    return rows


def documents(spark, rows, lang="en"):
    df = spark.createDataFrame([(i, t, lang, "s") for i, t in rows], "doc_id long, text string, lang string, source string")
    df = df.withColumn("n_chars", F.length("text").cast("long"))
    return df.repartition(3).withColumns({c: F.lit("clash") for c in CLASHES})


def no_documents(spark):
    return documents(spark, [])


def shingles(text: str | None) -> set:
    words = [w for w in re.split(r"[\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or "")) if w]
    return {tuple(words[i : i + 5]) for i in range(len(words) - 4)} if len(words) > 4 else {tuple(words)} if words else set()


def components_by_hand(rows) -> dict:
    sets = {i: shingles(t) for i, t in rows if i is not None}
    root = {i: i for i in sets}

    def top(i):
        while root[i] != i:
            i = root[i]
        return i

    for a in sets:
        for b in sets:
            both = len(sets[a] & sets[b])
            if a < b and both and 100 * both >= 75 * len(sets[a] | sets[b]):
                x, y = sorted((top(a), top(b)))
                root[y] = x
    return {i: (len(sets[i]), top(i)) for i in sets}


def covered_by_hand(rows, length=400):
    """(doc_id, bytes, covered flags) of each row."""
    seen: dict[bytes, int] = {}
    raws = [(i, (t or "").encode()) for i, t in rows]
    for _, raw in raws:
        for j in range(len(raw) - length + 1):
            seen[raw[j : j + length]] = seen.get(raw[j : j + length], 0) + 1
    out = []
    for i, raw in raws:
        flags = bytearray(len(raw))
        for j in range(len(raw) - length + 1):
            if seen[raw[j : j + length]] > 1:
                flags[j : j + length] = b"\1" * length
        out.append((i, raw, flags))
    return out
