"""Ordered near copies at size, inventory versions, frozen snapshots, liveness, JSON-LD and portal links."""

import datetime as dt
import hashlib
import json
import random
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from talentmesh.operators import dedupe, inventory, inventory_store, jsonld, navigation, skew, snapshots
from talentmesh.streaming import inventory_stream as streams

NOW = dt.datetime(2024, 1, 10)
SF = "/root/testdata/sf0.001"


def sightings(spark, rows):
    """(source, id, title, hour, event) as observations."""
    made = [(s, i, t, NOW + dt.timedelta(hours=h), e) for s, i, t, h, e in rows]
    df = spark.createDataFrame(made, "source string, source_job_id string, title string, seen_at timestamp, event_id bigint")
    facts = [F.lit("Sri Lanka").alias(c) if c == "country" else F.lit(None).cast(kind).alias(c) for c, kind in (
        ("company", "string"), ("location", "string"), ("country", "string"), ("url", "string"), ("description", "string"),
        ("salary", "string"), ("job_type", "string"), ("published_at", "timestamp"), ("detail_page_verified", "boolean"),
        ("content_hash", "string"), ("raw_payload", "string"))]
    return df.select("*", *facts)


def files_of(path):
    return {str(p.relative_to(path)): p.stat().st_mtime_ns for p in Path(path).rglob("*.parquet")}


def test_a_batch_rewrites_only_the_buckets_it_touches(spark, tmp_path):
    path = f"file://{tmp_path}"
    first = sightings(spark, [("s", str(i), "a", 0, i) for i in range(40)])
    inventory_store.merge_version(first, path, 1, "r1", buckets=8, ties=("event_id",))
    before = files_of(tmp_path / "data")
    inventory_store.merge_version(sightings(spark, [("s", "7", "b", 5, 90)]), path, 2, "r2", buckets=8, ties=("event_id",))
    after = files_of(tmp_path / "data")
    assert {f: t for f, t in after.items() if f in before} == before
    assert len({Path(f).parent for f in set(after) - set(before)}) == 1
    told = lambda v: {r.source_job_id: (r.title, r.last_source_run_id) for r in inventory_store.read_version(spark, path, v).collect()}
    assert told(1) == {str(i): ("a", "r1") for i in range(40)}
    assert told(None) == told(1) | {"7": ("b", "r2")}
    inventory_store.merge_version(sightings(spark, []), path, 3, "r3", buckets=8)
    assert told(3) == told(2) and inventory_store.latest_version(spark, path) == 3
    inventory_store.merge_version(sightings(spark, [("s", "7", "b", 5, 90)]), path, 2, "r2", buckets=8, ties=("event_id",))
    assert told(2) == told(1) | {"7": ("b", "r2")}


def test_late_and_equal_observations(spark):
    ties = ("event_id",)
    first = inventory.upsert(inventory.empty_inventory(spark), sightings(spark, [("s", "1", "x", 5, 1), ("s", "1", "y", 5, 2)]), "r1", ties=ties)
    late = inventory.upsert(first, sightings(spark, [("s", "1", "old", 1, 3)]), "r2", ties=ties).collect()
    assert [(r.title, r.first_seen_at, r.last_seen_at) for r in late] == [("y", NOW + dt.timedelta(hours=1), NOW + dt.timedelta(hours=5))]


def test_a_task_keeps_its_first_snapshot(spark, tmp_path):
    folder = f"file://{tmp_path}"
    stock = inventory.upsert(inventory.empty_inventory(spark), sightings(spark, [("s", str(i), f"t{i}", i, i) for i in range(9)]), "r1")
    tasks = spark.createDataFrame([("one", "Sri Lanka"), ("none", "Germany")], "task_id string, country string")
    snapshots.freeze(tasks, stock, folder, "first")
    told = lambda: {(r.task_id, r.snapshot_order): (r.sha256, r.body) for r in snapshots.thaw(spark, folder).collect()}
    kept = told()
    assert len(kept) == 9 and all(hashlib.sha256(b.encode()).hexdigest() == h for h, b in kept.values())
    assert [json.loads(kept["one", i][1])["title"] for i in range(9)] == [f"t{i}" for i in reversed(range(9))]
    newer = inventory.upsert(stock, sightings(spark, [("s", "0", "changed", 20, 50)]), "r2")
    more = tasks.union(spark.createDataFrame([("two", "Sri Lanka")], tasks.schema))
    snapshots.freeze(more, newer, folder, "second")
    again = told()
    assert {k: v for k, v in again.items() if k[0] == "one"} == kept
    assert json.loads(again["two", 0][1])["title"] == "changed"
    assert spark.read.parquet(f"{folder}/rows").count() == 10
    snapshots.freeze(more, newer, folder, "second")
    assert told() == again
    rows = snapshots.thawed_rows(snapshots.thaw(spark, folder, tasks), "source string, source_job_id string, title string")
    assert rows.where("title = 't3'").count() == 1
    lists = {r.task_id: (r.state, r.n_rows, r.list_sha256) for r in snapshots.task_lists(spark, folder).collect()}
    own = "".join(kept["one", i][0] for i in range(9))
    want = hashlib.sha256(hashlib.sha256(own.encode()).hexdigest().encode()).hexdigest()
    assert lists["one"] == ("first", 9, want) and lists["none"] == ("first", 0, None) and lists["two"][0] == "second"


def test_liveness_follows_gaps_and_forgets(spark, tmp_path):
    hour = 3_600_000
    day = lambda d: dt.datetime(2024, 1, 1) + dt.timedelta(days=d)
    landings = [
        [("a", day(0)), ("b", day(0.5)), ("a", day(4))],
        [("a", day(2)), ("b", day(5)), ("c", day(5.5))],  # a's second sighting comes late
        [("b", day(20)), (streams.CLOCK, day(60))],
    ]
    key = "spark.sql.streaming.stateStore.providerClass"
    before = spark.conf.get(key)
    spark.conf.set(key, "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    try:
        for nth, rows in enumerate(landings):
            spark.createDataFrame(rows, "vacancy string, ts timestamp_ntz").write.parquet(f"file://{tmp_path}/in/landing={nth}")
            seen = streams.observed(spark, f"file://{tmp_path}/in/*", "vacancy string, ts timestamp_ntz")
            run = streams.liveness(seen, 48 * hour, "3 days", 48 * hour).writeStream.format("parquet").option(
                "path", f"file://{tmp_path}/out").option("checkpointLocation", f"file://{tmp_path}/ckpt").trigger(availableNow=True).start()
            run.awaitTermination()
    finally:
        spark.conf.set(key, before)
    at = lambda d: int(day(d).replace(tzinfo=dt.UTC).timestamp() * 1000)
    got = spark.read.parquet(f"file://{tmp_path}/out").collect()
    assert sorted(tuple(r) for r in got) == sorted([
        ("a", "opened", at(0)), ("a", "expired", at(6)), ("b", "opened", at(0.5)), ("b", "expired", at(2.5)), ("b", "opened", at(5)),
        ("b", "expired", at(7)), ("b", "opened", at(20)), ("b", "expired", at(22)), ("c", "opened", at(5.5)), ("c", "expired", at(7.5)),
    ])
    for name in ("known", "timer"):
        left = spark.read.format("statestore").option("stateVarName", name).load(f"file://{tmp_path}/ckpt")
        assert left.count() == 0


def test_a_component_of_many_rows_is_taken_in_order(spark):
    """100,000 rows of one title and company, in some dozens of texts that overlap from one to the next."""
    rng = random.Random(3)
    vocab = [f"w{i}" for i in range(60)]
    texts = [" ".join(vocab[k : k + 24]) for k in range(30)]
    rows = [(i, rng.randrange(30), rng.randrange(4), rng.randrange(50)) for i in range(100_000)]
    table = spark.createDataFrame(rows, "seq bigint, text int, src int, extra int").repartition(8)
    body = F.element_at(F.array(*[F.lit(t) for t in texts]), F.col("text") + 1)
    jobs = table.select(
        "seq", F.concat(F.lit("s"), "src").alias("source"), F.concat(F.lit("id"), F.col("seq") % 3).alias("source_id"), F.lit("Cook").alias("title"),
        F.lit("Acme").alias("company"), F.lit("").alias("location"), F.concat(body, F.repeat(F.lit("!"), F.col("extra"))).alias("description"))
    got = {r.seq: r.leader for r in dedupe.near_duplicates(jobs, in_order=True).collect()}

    words = [frozenset(t.split()) for t in texts]
    near = [[5 * len(a & b) >= 4 * min(len(a), len(b)) for b in words] for a in words]
    heads, joined = [], []
    for seq, text, src, extra in rows:
        rich = len(texts[text]) + extra
        at = next((g for g, (_, t, s, i, _) in enumerate(heads) if near[t][text] and (s != src or i == seq % 3)), None)
        if at is None:
            at = len(heads)
            heads.append((seq, text, src, seq % 3, rich))
        elif rich > heads[at][4]:
            heads[at] = (seq, text, src, seq % 3, rich)
        joined.append(at)
    assert len(heads) > 5
    assert got == {seq: heads[g][0] for seq, g in enumerate(joined) if heads[g][0] != seq}


def records_by_hand(node):
    """Post-order walk, written down independently of the plan."""
    if isinstance(node, list):
        return [r for x in node for r in records_by_hand(x)]
    if not isinstance(node, dict):
        return []
    kinds = node.get("@type")
    kinds = [str(k or "").lower() for k in (kinds if isinstance(kinds, list) else [kinds])]
    held = [node["@graph"]] if isinstance(node.get("@graph"), list | dict) else []
    parts = node.get("itemListElement")
    held += [x["item"] if isinstance(x, dict) and isinstance(x.get("item"), dict) else x for x in parts] if isinstance(parts, list) else []
    held += [node["item"]] if "listitem" in kinds and isinstance(node.get("item"), dict) else []
    out = [r for x in held for r in records_by_hand(x)]
    own = not set(kinds) & set(jsonld.CONTAINER_TYPES) if node.get("@type") else bool(set(jsonld.RECORD_KEYS) & node.keys())
    return [*out, node] if own else out


def test_records_of_nested_blocks(spark):
    job = lambda n, **more: {"@type": "JobPosting", "title": n} | more
    nodes = [
        job("a"), [job("b"), [job("c")], 5, "x", None], {"@graph": [job("d"), {"@graph": job("e")}], "name": "holder"}, {"@graph": "text", "url": "u"},
        {"@type": "ItemList", "itemListElement": [{"@type": "ListItem", "item": job("f")}, {"item": "plain", "name": "g"}, job("h"), 7]},
        {"@type": ["ListItem", "Thing"], "item": job("i"), "name": "no"}, {"@type": "listitem", "item": [job("j")]}, {"@type": "", "title": "k"},
        {"@type": [], "datePosted": "l"}, {"@type": ["JOBPOSTING", None], "name": None}, {"other": 1}, {"itemListElement": {"item": job("m")}, "@type": "X"},
        {"@type": "BreadcrumbList", "itemListElement": [[{"@graph": [[job("n")]]}]]}, {"url": None}, {"@type": None, "name": "o"}, {}, [], 3,
    ]
    blocks = [json.dumps(n) for n in nodes]
    page = lambda texts: "<p>" + "".join(f'<script type="application/ld+json">{t}</script>' for t in texts) + "</p>"
    rows = [(i, "https://x.test/", page([b])) for i, b in enumerate(blocks)]
    rows += [(90, "https://x.test/", page([blocks[0], "{bad", blocks[4], blocks[2]])), (91, "https://x.test/", "<p>none</p>"), (92, "u", None)]
    got = jsonld.structured_records(spark.createDataFrame(rows, "page_id int, url string, html string"))
    by_page: dict[int, list] = {}
    for r in got.select("page_id", "ordinal", "record").orderBy("page_id", "ordinal").collect():
        by_page.setdefault(r.page_id, []).append(json.loads(r.record))
    want = {i: records_by_hand(n) for i, n in enumerate(nodes)}
    want[90] = [r for k in (0, 4, 2) for r in records_by_hand(nodes[k])]
    assert by_page == {i: w for i, w in want.items() if w}


@pytest.mark.parametrize("term, text, held", [
    ("java", "java jobs", True), ("java", "javascript jobs", False), ("c++", "c++ jobs", False), ("c++", "c++11 jobs", True),
    ("supply chain", "the supply chain lead", True), ("supply chain", "supply of chain", False), ("java", "java+sql", True), ("+sql", "java+sql", True),
    ("+sql", "+sql", False), ("node", "x#node", True),
])
def test_terms_between_word_boundaries(spark, term, text, held):
    df = spark.createDataFrame([(text,)], "text string")
    assert (term in {r.term for r in navigation.held_terms(df, [1, 2, 3]).collect()}) is held


def test_profiles_meet_the_best_links_of_a_portal_not_all(spark, monkeypatch):
    people = spark.createDataFrame(
        [(str(i), "Nurse" if i % 2 else "", ["nurse", "ward nurse"], [f"skill{i}"]) for i in range(40)],
        "candidate_id string, target_position string, likely_titles array<string>, skills array<string>")
    rows = [(p, 0, "https://p.test/", f"https://p.test/job/{p}", "Ward Nurse" if p % 3 else "Clerk", "detail") for p in range(150)]
    rows += [(p, 1, "https://p.test/", f"https://p.test/jobs/{p}", f"skill{p} jobs", "navigation") for p in range(150)]
    found = spark.createDataFrame(rows, "page_id bigint, ordinal int, base string, url string, title string, link_class string")
    met = []

    def counted(*given, join=navigation.salted_join, **more):
        met.append(join(*given, **more))
        return met[-1]

    monkeypatch.setattr(navigation, "salted_join", counted)
    best = navigation.candidate_links(people, found, 2).collect()
    assert sorted((int(r.candidate_id), r.origin_rank, r.page_id, r.ordinal, r.suits) for r in best) == [
        (i, n, n, 0, True) for i in range(40) for n in (1, 2)]
    assert max(df.count() for df in met) < 40 * 100


@pytest.mark.parametrize("how", ["inner", "left", "left_semi", "left_anti"])
def test_a_key_with_half_of_all_rows_is_split(spark, how):
    spark.conf.set("talentmesh.join.rows", "500")
    try:
        many = spark.range(8000).select("id", F.when(F.col("id") % 2 == 0, 0).otherwise(F.col("id") % 97).alias("k"), F.lit("x").alias("side"))
        few = spark.createDataFrame([(k, v) for k in range(0, 90) for v in range(2)] + [(None, 9)], "k bigint, v int")
        heavy = skew.heavy_keys(many, ["k"])
        assert [(r["k"], r["__salts"]) for r in heavy.collect()] == [(0, 9)]
        joined = skew.balanced_join(many, few, ["k"], ["id"], how)
        plain = many.join(few, ["k"], how)
        assert joined.columns == plain.columns and sorted(map(tuple, joined.collect()), key=repr) == sorted(map(tuple, plain.collect()), key=repr)
        per_task = many.where("k = 0").groupBy(F.pmod(F.xxhash64("id"), F.lit(9))).count()
        assert per_task.agg(F.max("count")).head()[0] < 700
    finally:
        spark.conf.unset("talentmesh.join.rows")


def test_matches_do_not_depend_on_the_split(spark):
    from talentmesh.operators import matching
    from talentmesh.plans import views

    people, jobs = views.candidates(spark, SF), views.vacancies(spark, SF)
    told = lambda: (sorted(map(str, matching.top_matches(people, jobs, 5).collect())), sorted(map(str, matching.route_counts(people, jobs).collect())))
    whole = told()
    spark.conf.set("talentmesh.join.rows", "7")
    try:
        assert told() == whole
    finally:
        spark.conf.unset("talentmesh.join.rows")


def test_written_report_counts_the_vacancy_text_not_the_guarded_cell(spark, tmp_path):
    from talentmesh.plans import sink_queries

    spark.createDataFrame([(1, "- starts like a formula", "en", "src1", 23), (2, "plain text", "en", "src2", 10)],
                          "doc_id long, text string, lang string, source string, n_chars long").write.parquet(str(tmp_path / "documents.parquet"))
    want = {str(r.seq): len(r.description) for r in sink_queries.views.vacancies(spark, str(tmp_path)).collect()}
    assert {r.seq: r.chars for r in sink_queries.written_report(spark, str(tmp_path)).collect()} == want


def test_liveness_works_through_vacancies_in_groups(spark, tmp_path):
    rng, day, ttl, forget = random.Random(5), 86_400_000, 2, 1
    start = int(dt.datetime(2024, 1, 1, tzinfo=dt.UTC).timestamp() * 1000)
    seen = {f"v{i}": sorted({rng.randrange(30 * day) for _ in range(rng.randrange(1, 12))}) for i in range(40)}
    rows = [(v, dt.datetime(2024, 1, 1) + dt.timedelta(milliseconds=t), t // (10 * day) + rng.randrange(2)) for v, at in seen.items() for t in at]
    rows.append((streams.CLOCK, dt.datetime(2024, 3, 1), 9))
    key, groups, out = "spark.sql.streaming.stateStore.providerClass", [], f"file://{tmp_path}/out"
    before = spark.conf.get(key)
    spark.conf.set(key, "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    try:
        for nth in sorted({r[2] for r in rows}):
            landed = [r[:2] for r in rows if r[2] == nth]
            spark.createDataFrame(landed, "vacancy string, ts timestamp_ntz").write.parquet(f"file://{tmp_path}/in/landing={nth}")
            stream = streams.observed(spark, f"file://{tmp_path}/in/*", "vacancy string, ts timestamp_ntz")
            streams.liveness(stream, ttl * day, "21 days", forget * day, groups=3).writeStream.format("parquet").option("path", out).option(
                "checkpointLocation", f"file://{tmp_path}/ckpt").trigger(availableNow=True).start().awaitTermination()
            groups.append(spark.read.format("statestore").option("stateVarName", "timer").load(f"file://{tmp_path}/ckpt").count())
    finally:
        spark.conf.set(key, before)
    assert max(groups) == 3 and groups[-1] == 0
    want = []
    for v, at in seen.items():
        for previous, t in zip([None, *at], [*at, None]):
            gap = t is None or previous is None or t - previous > ttl * day
            if previous is not None and gap:
                want.append((v, "expired", start + previous + ttl * day))
            if t is not None and gap:
                known = previous is not None and t - previous <= (ttl + forget) * day
                want.append((v, "reopened" if known else "opened", start + t))
    assert sorted(map(tuple, spark.read.parquet(out).collect())) == sorted(want)


def test_pairs_are_ranked_where_they_meet_and_never_moved(spark, monkeypatch):
    from talentmesh.operators import matching, review
    from talentmesh.plans import matching_queries, views

    monkeypatch.setattr(matching, "PARTY", 2, raising=False)
    monkeypatch.setattr(matching, "CELL", 1, raising=False)
    people, jobs = views.candidates(spark, SF).withColumn("candidate_id", F.concat("candidate_id", F.lit("x"))), views.vacancies(spark, SF)
    people = people.union(people.withColumn("candidate_id", F.concat("candidate_id", F.lit("y")))).union(views.candidates(spark, SF))
    for floor, gate in ((None, False), (20.0, True)):
        told = review.ranked(matching.match_pairs(people, jobs, floor, gate).select("candidate_id", "seq", "score"))
        columns = ["candidate_id", "seq", "score", "position"]
        got = matching.ranked_pairs(people, jobs, floor, gate).select(columns).collect()
        assert len(got) > 100 and sorted(map(tuple, got)) == sorted(map(tuple, told.select(columns).collect()))
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        for query in (matching_queries.related_matches, matching_queries.full_ranking):
            plan = query(spark, SF)._jdf.queryExecution().executedPlan().toString()
            assert "hashpartitioning(profile_id" not in plan and "hashpartitioning(candidate_id" not in plan
            assert "hashpartitioning(cell" in plan
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def test_snapshots_of_many_tasks_are_dealt_over_partitions(spark, monkeypatch):
    monkeypatch.setattr(inventory, "TASKS_TOGETHER", 3)
    monkeypatch.setattr(inventory, "ROWS_TOGETHER", 4)
    tasks = spark.createDataFrame([(str(i), "Sri Lanka" if i % 4 else None if i % 8 else "Malta") for i in range(200)] + [("7", "Sri Lanka")],
                                  "task_id string, country string")
    stock = sightings(spark, [("s", f"{i:02}", "a", i // 2, i) for i in range(30)]).withColumn("last_seen_at", F.col("seen_at"))
    place = F.when(F.col("source_job_id") < "25", "Sri Lanka").otherwise("Malta").alias("country")
    stock = stock.select(place, "source", "source_job_id", "last_seen_at")
    done = inventory.task_snapshots(tasks, stock, tasks.where("task_id IN ('5', '6')"))
    got = done.withColumn("part", F.spark_partition_id()).collect()
    order = sorted(range(30), key=lambda i: (-(i // 2), i))
    lists = {"Sri Lanka": [i for i in order if i < 25], "Malta": [i for i in order if i >= 25]}
    asked = [(r.task_id, r.country) for r in tasks.collect() if r.country and r.task_id not in ("5", "6")]
    wanted = [(t, n, f"{i:02}") for t, country in asked for n, i in enumerate(lists[country])]
    assert sorted((r.task_id, r.snapshot_order, r.source_job_id) for r in got) == sorted(wanted)
    assert len({r.part for r in got}) > 1
