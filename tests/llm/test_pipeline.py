"""The pipeline, stage by stage, against plain versions of the stages."""

import random
import re
from collections import Counter

import corpus_pipeline
from pyspark.sql import functions as F

from talentmesh.llm import langid, suffixdedup
from tests.llm import cases
from tests.llm.test_models import check_packing, token_ids

SF = "/root/testdata/sf0.001"


def passages_by_hand(texts, length=50):
    """Each text less the words in a passage of ``length`` words that stands twice."""
    words = {i: list(re.finditer(r"[^\x20\x09-\x0D]+", t)) for i, t in texts.items()}
    seen = Counter()
    for found in words.values():
        own = [m[0] for m in found]
        seen.update(tuple(own[k : k + length]) for k in range(len(own) - length + 1))
    out = {}
    for i, found in words.items():
        own, gone = [m[0] for m in found], set()
        for k in range(len(own) - length + 1):
            if seen[tuple(own[k : k + length])] > 1:
                gone.update(range(k, k + length))
        edges = [m.start() for m in found] + [len(texts[i])]
        lead = texts[i][: edges[0]]
        out[i] = lead + "".join(texts[i][edges[k] : edges[k + 1]] for k in range(len(found)) if k not in gone)
    return out


def test_stages_in_order(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    extra = spark.createDataFrame([(9001, None, "en", "s", None), (9002, "12 34", "en", "s", 5), (9003, "", None, None, 0)], docs.schema)
    docs = docs.unionByName(extra)
    columns, held = docs.columns, {}
    for name, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, SF)
        held[name] = docs.collect()
        if name != "packing":
            assert docs.columns == columns
            docs = spark.createDataFrame(held[name], docs.schema)
    texts = {name: {r.doc_id: r.text for r in held[name]} for name in list(held)[:-1]}
    assert texts["language"] == {i: t for i, t in rows if any(c.isalpha() for c in t)}

    least = {}
    for i, t in sorted(texts["language"].items()):
        least.setdefault(re.sub(r"[\x20\x09-\x0D]+", " ", t), i)
    assert set(texts["exact copies"]) == set(least.values())

    roots = cases.components_by_hand(texts["exact copies"].items())
    assert set(texts["near copies"]) == {i for i, (_, c) in roots.items() if i == c}

    assert texts["repeated passages"] == passages_by_hand(texts["near copies"])

    check_packing(held["packing"], token_ids(texts["repeated passages"].items()))


def test_run_is_the_stages(spark):
    assert corpus_pipeline.run(spark, SF).count() > 0


def short_word_rows():
    """Passages of 51 to 60 short words, far below 400 bytes, in texts of their own."""
    rng = random.Random(12)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(rng.randrange(1, 5)))
    rows, planted = [], []
    for g in range(5):
        passage = [word() for _ in range(51 + 2 * g)]
        planted.append(passage)
        for k in range(2 + g):
            before, after = ([word() for _ in range(rng.randrange(120))] for _ in range(2))
            rows.append((10 * g + k, "\n".join([" ".join(before), "  ".join(passage) if k else " ".join(passage), " ".join(after)])))
    rows += [(90, " ".join(word() for _ in range(400))), (91, " ".join(planted[0][:49])), (92, ""), (93, " \n"), (None, " ".join(planted[4]))]
    return rows, planted


def test_short_passages_go_whole(spark):
    rows, planted = short_word_rows()
    rows.append((90, "another text under the same number"))
    docs = cases.documents(spark, rows)
    done = suffixdedup.without_passages(docs)
    assert done.schema.names == docs.schema.names
    want = passages_by_hand({n: t for n, (_, t) in enumerate(rows)})
    assert sorted(((r.doc_id, r.text) for r in done.collect()), key=repr) == sorted(((i, want[n]) for n, (i, _) in enumerate(rows)), key=repr)
    assert max(len(" ".join(p).encode()) for p in planted) < 400
    told = suffixdedup.without_repeats(docs, passages=True).select("doc_id", "n_bytes", "n_passage_words").collect()
    n_words = lambda t: len(t.split())
    assert sorted(tuple(r) for r in told if r.doc_id is not None) == sorted(
        (i, len(t.encode()), n_words(t) - n_words(want[n])) for n, (i, t) in enumerate(rows) if i is not None)


def awkward_documents(spark, lang):
    rows = [
        (1, "one text of words"), (2, "one  text of words"), (2, "a different text"), (2, "a different text"), (None, "without a number"),
        (None, "without a number"), (None, "one text of words"), (3, None), (None, None), (4, "12 34"), (5, ""), (None, "alone and unnumbered"),
    ]
    return cases.documents(spark, rows, lang).withColumn("_named", F.lit(1))


def test_no_row_is_lost(spark):
    docs = awkward_documents(spark, None)
    told = {name: [] for name, _ in corpus_pipeline.STAGES}
    for name, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, SF)
        told[name] = sorted(((r.doc_id, r.text) if name != "packing" else (r.doc_id, r.length) for r in docs.collect()), key=repr)
        docs = docs if name == "packing" else spark.createDataFrame(docs.collect(), docs.schema)
    lettered = [
        (1, "one text of words"), (2, "one  text of words"), (2, "a different text"), (2, "a different text"), (None, "without a number"),
        (None, "without a number"), (None, "one text of words"), (None, "alone and unnumbered"),
    ]
    left = [(1, "one text of words"), (2, "a different text"), (None, "without a number"), (None, "alone and unnumbered")]
    assert told["language"] == sorted(lettered, key=repr)
    assert told["exact copies"] == told["near copies"] == told["repeated passages"] == sorted(left, key=repr)
    assert [i for i, _ in told["packing"]] == [1, 2, None, None]


def test_language_of_unlabelled_rows_is_filled_in(spark):
    rows = [(r.doc_id, r.text, r.lang) for r in spark.read.parquet(f"{SF}/documents.parquet").collect()]
    unlabelled = {i for i, _, _ in rows if i % 5 == 0}
    docs = spark.createDataFrame([(i, t, None if i in unlabelled else lang) for i, t, lang in rows], "doc_id long, text string, lang string")
    done = {r.doc_id: r.lang for r in corpus_pipeline.language(spark, docs, SF).collect()}
    assert all(done[i] == lang for i, _, lang in rows if i in done and i not in unlabelled and lang is not None)
    right = [done[i] == lang for i, _, lang in rows if i in done and i in unlabelled and lang is not None]
    assert len(right) > 20 and sum(right) / len(right) > 0.9
    some = langid.with_language(docs, ["en"])
    assert {r.doc_id for r in some.collect()} < set(done)


def test_stages_of_an_empty_table(spark):
    docs = cases.no_documents(spark)
    for name, stage in corpus_pipeline.STAGES:
        done = stage(spark, docs, SF)
        assert done.collect() == [] and (name == "packing" or done.columns == docs.columns)
