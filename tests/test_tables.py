"""Table operators against brute force on small data, and invariants."""

import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

from talentmesh.functions import scoring
from talentmesh.operators import audit, dedupe, matching, ordering, review
from talentmesh.plans import views
from tests.test_rules import JOB, job

SF = "/root/testdata/sf0.001"
LONG = " ".join(f"word{i}" for i in range(40))


def test_url_variants_and_near_copy(spark):
    rows = [
        job(1, title="Data Engineer", url="https://a.test/j/1?utm_source=x", description=LONG, source="A"),
        job(2, title="Data Engineer", url="https://a.test/j/1/", description=LONG + " more", source="B"),
        job(3, title="Data Engineer", url="https://b.test/9", description=LONG + " more text here", source="Syndicator"),
        job(4, title="Data Engineer", url="https://b.test/8", description=LONG, source="C", location="Galle"),
        job(5, title="Data Engineer", url="https://b.test/7", description=LONG, source="D", location="Kandy",
            company="Confidential"),
    ]
    got = dedupe.unique_vacancies(spark.createDataFrame(rows, JOB)).orderBy("seq").collect()
    assert [(r.seq, r.source) for r in got] == [(1, "Syndicator"), (5, "D")]


def _alike(a, b):
    x, y = set(a["d"].split()), set(b["d"].split())
    return a["t"] == b["t"] and a["s"] != b["s"] and len(x & y) >= 0.8 * min(len(x), len(y))


def _rich(r):
    return len(r["d"]), len(r["t"]) + 4


def _components(rows):
    """All that links reach is one group; the richest, then the first, leads."""
    root = {r["seq"]: r["seq"] for r in rows}
    for a in rows:
        for b in rows:
            if _alike(a, b):
                old, new = root[a["seq"]], root[b["seq"]]
                root = {k: new if v == old else v for k, v in root.items()}
    out = {}
    for r in rows:
        mine = [x for x in rows if root[x["seq"]] == root[r["seq"]]]
        lead = min(mine, key=lambda x: (-_rich(x)[0], -_rich(x)[1], x["seq"]))
        if lead["seq"] != r["seq"]:
            out[r["seq"]] = lead["seq"]
    return out


def _in_order(rows):
    """A row joins the first group whose representative it resembles and leads it if richer."""
    groups, joined = [], {}
    for r in rows:
        at = next((g for g, lead in enumerate(groups) if _alike(lead, r)), None)
        if at is None:
            at = len(groups)
            groups.append(r)
        elif _rich(r) > _rich(groups[at]):
            groups[at] = r
        joined[r["seq"]] = at
    return {seq: groups[g]["seq"] for seq, g in joined.items() if groups[g]["seq"] != seq}


@pytest.mark.parametrize("in_order", [False, True])
def test_near_duplicates_match_brute_force(spark, in_order):
    rng = random.Random(7)
    vocab = [f"tok{i}" for i in range(60)]
    rows = []
    for seq in range(60):
        base = random.Random(seq % 6).sample(vocab, 30)
        words = [w if rng.random() > 0.12 else rng.choice(vocab) for w in base]
        if seq in (20, 33, 47):
            words = rows[seq - 12]["d"].split()
        rows.append({"seq": seq, "t": f"Role {seq % 2}", "d": " ".join(words), "s": f"s{seq % 25}"})
    df = spark.createDataFrame(
        [job(r["seq"], title=r["t"], description=r["d"], source=r["s"]) for r in rows], JOB).repartition(5)
    got = {r.seq: r.leader for r in dedupe.near_duplicates(df, in_order).collect()}
    assert got == (_in_order if in_order else _components)(rows)


@pytest.mark.parametrize("in_order", [False, True])
def test_one_hot_block_keeps_every_row(spark, in_order):
    rows = [job(i, title="Cook", source=f"s{i}", description=LONG, url=f"https://x.test/{i}") for i in range(300)]
    got = dedupe.near_duplicates(spark.createDataFrame(rows, JOB).repartition(7), in_order).collect()
    assert len(got) == 299 and {r.leader for r in got} == {0}


def test_dedupe_is_stable(spark):
    jobs = views.vacancies(spark, SF)
    once = dedupe.one_per_url(jobs)
    again = dedupe.one_per_url(once.repartition(5))
    assert sorted(map(tuple, once.collect())) == sorted(map(tuple, again.select(*once.columns).collect()))


def test_numbering_is_exact_for_a_hot_group(spark):
    rows = [(1 if i % 3 else 2, float(i % 5), i) for i in range(2000)]
    df = spark.createDataFrame(rows, "g int, score double, seq bigint").repartition(6)
    got = ordering.numbered(df, ["g"], [("score", True)], "seq", "pos", bucket=64)
    want = {}
    for g in (1, 2):
        mine = sorted((r for r in rows if r[0] == g), key=lambda r: (-r[1], r[2]))
        want.update({r[2]: n for n, r in enumerate(mine, 1)})
    assert {r.seq: r.pos for r in got.collect()} == want


def test_top_matches_equal_ranked_pairs(spark):
    people, jobs = views.candidates(spark, SF), views.vacancies(spark, SF)
    top = matching.top_matches(people, jobs, k=3)
    pairs = matching.match_pairs(people, jobs, 20.0, experience_gate=True).collect()
    best = {}
    for r in sorted(pairs, key=lambda r: (r.candidate_id, -r.score, r.seq)):
        mine = best.setdefault(r.candidate_id, [])
        if len(mine) < 3:
            mine.append(r.seq)
    got = {}
    for r in sorted(top.collect(), key=lambda r: r["rank"]):
        got.setdefault(r.candidate_id, []).append(r.seq)
    assert got == best


def test_routes_partition_related_rows(spark):
    people, jobs = views.candidates(spark, SF), views.vacancies(spark, SF)
    pairs = Counter((r.candidate_id, r.route) for r in matching.match_pairs(people, jobs, 20.0).collect())
    for r in matching.route_counts(people, jobs, 20.0).collect():
        assert r.accepted + r.rejected + r.ambiguous == r.related
        assert r.accepted == pairs[(r.candidate_id, "accepted")]
        assert r.ambiguous == pairs[(r.candidate_id, "ambiguous")]


def test_no_cartesian_plan(spark):
    plan = matching.top_matches(
        views.candidates(spark, SF), views.vacancies(spark, SF))._jdf.queryExecution().executedPlan().toString()
    assert "CartesianProduct" not in plan


def test_audit_counts(spark):
    rows = spark.createDataFrame([job(1), job(2), job(3)], JOB)
    found = rows.where("seq < 3").unionByName(rows.where("seq = 1"))
    assert tuple(audit.imbalance(rows, found).first()) == (1, 1)
    assert tuple(audit.imbalance(rows, rows).first()) == (0, 0)
    assert [r.source_id for r in audit.key_difference(rows, found).collect()] == ["3"]


def test_decision_forms(spark):
    rows = [(1, '```json\n[{"review_id":"a","decision":"keep","score":90}]\n```'),
            (2, 'text {"jobs":[{"review_id":"b","decision":"reject","score":1,"reason":"no"}]} end'),
            (3, '{"https://u.test":{"decision":"maybe","score":50}}'), (4, "nothing")]
    got = review.parsed_decisions(spark.createDataFrame(rows, "batch_id int, content string")).orderBy("batch_id").collect()
    assert [(r.review_id, r.decision, r.score) for r in got] == [
        ("a", "keep", 90.0), ("b", "reject", 1.0), (None, "maybe", 50.0), (None, None, None)]
    assert got[2].url == "https://u.test" and got[3].unreadable
    matches = spark.createDataFrame(
        [(1, "a", "u", 70.0), (1, "z", "u", 150.0), (3, "q", "https://u.test", 30.0)],
        "batch_id int, review_id string, url string, score double")
    decisions = review.parsed_decisions(spark.createDataFrame(rows, "batch_id int, content string"))
    strict = {r.review_id: (r.decision, r.final_score) for r in
              review.applied_decisions(matches, decisions, "p", "m").collect()}
    assert strict == {"a": ("keep", 90.0), "z": ("reject", 100.0), "q": ("reject", 30.0)}
    loose = {r.review_id: r.decision for r in
             review.applied_decisions(matches, decisions, "p", "m", strict=False).collect()}
    assert loose == {"a": "keep", "z": "keep", "q": "maybe"}


def test_reports_and_files(spark, tmp_path):
    from talentmesh.operators import reports
    from talentmesh.sources import feeds

    reports.write_report(spark.createDataFrame([("=1", 2)], "a string, b int"), str(tmp_path / "r"))
    back = spark.read.csv(str(tmp_path / "r"), header=True).first()
    assert back.a == "'=1"
    manifest = reports.manifest_of_folder(spark, str(tmp_path / "r" / "*.csv"), "run")
    assert manifest.first().kind == "text/csv" and len(manifest.first().sha256) == 64
    (tmp_path / "f.json").write_text('{"jobs":[{"id":7,"title":"Cook","company_name":"A"}]}')
    row = feeds.read_feed(spark, str(tmp_path / "f.json"), feeds.FEEDS["Remotive"], "germany").first()
    assert (row.source_id, row.title, row.location, row.country_hint) == ("7", "Cook", "Remote", "germany")
    (tmp_path / "f.xml").write_text("<rss><channel><item><title>A: B</title><link>l</link></item></channel></rss>")
    assert feeds.read_rss(spark, str(tmp_path / "f.xml")).first().title == "A: B"


def test_near_copies_meet_across_blocks_and_only_links_leave_a_task(spark, monkeypatch):
    monkeypatch.setattr(dedupe, "BLOCK_NODES", 9)
    rng, vocab = random.Random(3), [f"tok{i}" for i in range(80)]
    rows = []
    for seq in range(70):
        base = random.Random(seq % 9).sample(vocab, 30)[:30 - seq % 4]
        rows.append({"seq": seq, "t": "Role", "s": f"s{seq % 23}", "d": " ".join(
            w if rng.random() > 0.08 else rng.choice(vocab) for w in base)})
    df = spark.createDataFrame([job(r["seq"], title=r["t"], description=r["d"], source=r["s"]) for r in rows], JOB)
    got = {r.seq: r.leader for r in dedupe.near_duplicates(df).collect()}
    assert got == _components(rows)
    nodes = dedupe._distinct_texts(dedupe._comparable(df))[1]
    links = dedupe.similar_texts(nodes)
    made = [(r.a, r.b) for r in links.collect()]
    assert len(made) == len(set(made)) and {frozenset(p) for p in made} == {
        frozenset((a["seq"], b["seq"])) for a in rows for b in rows if a is not b and _alike(a, b)}
    assert "explode(toks" not in links._jdf.queryExecution().optimizedPlan().toString()


def test_vacancies_that_share_an_id_stay_in_review_until_their_own_evidence_is_decided(spark):
    rows = spark.createDataFrame([(1, "a", "c", "e1"), (2, "a", "c", "e2"), (3, "b", "c", "e3")],
                                 "seq int, review_id string, context_hash string, evidence_hash string")
    left = review.unreviewed_as_manual(rows, rows.where("seq = 1"), "stopped")
    assert sorted(r.seq for r in left.collect()) == [2, 3]


def test_search_queries_are_worked_out_once_for_a_position_and_country(spark):
    from pyspark.sql import functions as F

    from talentmesh.operators import search

    people = views.candidates(spark, SF).limit(60)
    plan = search.search_plan(people, F.lower("country"))
    assert "job vacancy apply" not in plan._jdf.queryExecution().optimizedPlan().toString()
    alone = people.select("candidate_id", F.posexplode(search.discovery_queries(F.lower("country"))).alias("ordinal", "query"))
    assert sorted(map(tuple, plan.collect())) == sorted(map(tuple, alone.collect()))


def test_vacancies_that_a_profile_cannot_tell_apart_meet_it_once(spark):
    from pyspark.sql import functions as F

    people, features = matching._people(views.candidates(spark, SF)), matching._stored_features(views.vacancies(spark, SF))
    units = features.groupBy("sig_id", *matching.SIGNATURE).agg(F.count(F.lit(1)).alias("n_jobs"))
    offers = lambda pool: matching._offers(
        people, units, features, ("sig_id", "n_jobs"), None, False, pool).select("profile_id", "score", "shared", "n_jobs").collect()
    pooled, apart, rows = Counter(), Counter(), (offers(matching._counted), offers(None))
    for made, found in zip((pooled, apart), rows):
        for r in found:
            made[r.profile_id, r.score, r.shared] += r.n_jobs
    assert pooled == apart and len(rows[0]) < len(rows[1])


def test_a_run_moves_features_and_no_texts(spark, monkeypatch):
    stored = []
    monkeypatch.setattr(matching, "durable_cut", lambda df, cut=matching.durable_cut: (stored.append(set(df.columns)), cut(df))[1])
    sf = "/root/testdata/sf0.001"
    told = matching.run_summary(views.candidates(spark, sf), views.vacancies(spark, sf), views.NOW).collect()
    assert all(r.complete for r in told) and any(r.related_jobs for r in told)
    assert stored and not any(columns & {"title", "description", "text"} for columns in stored)


def test_terms_of_a_kind_are_told_apart_by_number_only(spark):
    masks = [0, 1, 0b1011, (1 << 60) - 1, scoring.HIGH_MASK, scoring.LOW_MASK, 1 << 59 | 1 << 30 | 1 << 7]
    got = spark.createDataFrame([(m,) for m in masks], "m bigint").select("m", matching._as_many(F.col("m"), scoring.SKILL_KINDS).alias("n")).collect()
    for m, n in got:
        assert [bin(m & k).count("1") for k in scoring.SKILL_KINDS] == [bin(n & k).count("1") for k in scoring.SKILL_KINDS]
        assert bin(m & (1 << 60) - 1).count("1") == bin(n).count("1")


def _bytes_kept(spark):
    import os

    from talentmesh.session import shared_folder

    top = shared_folder(spark).removeprefix("file://")
    return sum(os.path.getsize(os.path.join(at, f)) for at, _, files in os.walk(top) for f in files)


def test_unique_vacancies_keep_hashes_on_disk_and_no_texts(spark):
    words = lambda seq: " ".join(f"{random.Random(f'{seq} {i}').getrandbits(48):012x}" for i in range(400))
    rows = [job(seq, title="Cook", description=words(seq // 2) + " more" * (seq % 2), source=f"s{seq % 7}",
                url=f"https://a.test/{seq // 4}-{seq % 4 == 3}") for seq in range(300)]
    before = _bytes_kept(spark)
    got = dedupe.unique_vacancies(spark.createDataFrame(rows, JOB)).collect()
    assert sorted((r.seq, r.source) for r in got) == sorted(
        (seq, f"s{(seq + (seq % 4 == 0)) % 7}") for seq in range(300) if seq % 4 in (0, 3))
    assert _bytes_kept(spark) - before < sum(len(r[8]) for r in rows) / 2


def test_components_need_no_more_links_than_nodes(spark, monkeypatch):
    rng, vocab = random.Random(8), [f"tok{i}" for i in range(400)]
    rows = []
    for seq in range(60):
        base = random.Random(seq % 3).sample(vocab, 40)
        rows.append({"seq": seq, "t": "Role", "s": f"s{seq}", "d": " ".join(w if rng.random() > 0.05 else rng.choice(vocab) for w in base)})
    df = spark.createDataFrame([job(r["seq"], title=r["t"], description=r["d"], source=r["s"]) for r in rows], JOB)
    linked, links = dedupe.linked_vacancies(df, every=False)
    assert links.count() < 60 < dedupe.linked_vacancies(df)[1].count()
    want = _components(rows)
    monkeypatch.setattr(dedupe, "BLOCK_NODES", 7)  # nine blocks, 45 tasks
    got = {r.seq: r.leader for r in dedupe.near_duplicates(df).collect()}
    assert got == want and linked.count() == len(want) + len(set(want.values()))


def test_copies_taken_in_order_keep_hashes_on_disk_and_no_texts(spark):
    words = lambda seq: " ".join(f"{random.Random(f'{seq} {i}').getrandbits(48):012x}" for i in range(600))
    rows = [job(seq, title="Cook", description=words(seq // 2) + " more" * (seq % 2), source=f"s{seq % 7}",
                url=f"https://a.test/{seq}") for seq in range(200)]
    before = _bytes_kept(spark)
    got = dedupe.unique_vacancies(spark.createDataFrame(rows, JOB), in_order=True).collect()
    assert sorted((r.seq, r.source) for r in got) == [(seq, f"s{(seq + 1) % 7}") for seq in range(0, 200, 2)]
    assert _bytes_kept(spark) - before < sum(len(r[8]) for r in rows) / 2
