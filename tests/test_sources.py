from talentmesh.sources import registry


def test_registry_scope(spark):
    companies = spark.createDataFrame([("Acme", "https://acme.test"), ("Bolt", None)],
                                      "company string, verified_url string")
    full = registry.default_registry(spark, companies)
    assert registry.default_registry(spark).count() == 42
    it = {r.source: r.skip_reason for r in registry.sources_in_scope(full, "Software Engineer").collect()}
    assert len(it) == 44 and it["Acme Careers"] == "" and it["Bolt Careers"] == registry.UNVERIFIED
    assert it["Remotive"] == "remote-global sources disabled" and it["Adzuna"] == "credentials not configured"
    assert it["Google Custom Search"] == "web discovery disabled" and it["XpressJobs"] == ""
    assert registry.sources_in_scope(full, "Nurse").count() == 42


def test_vacancy_csv(spark, tmp_path):
    (tmp_path / "v.csv").write_text('company,title,apply_url,match_score\n"A\nB",Cook,u,\n')
    row = registry.read_vacancy_csv(spark, str(tmp_path / "v.csv")).first()
    assert (row.company, row.title, row.match_score) == ("A\nB", "Cook", "")


def test_posting_texts_inline_and_joined(spark):
    import json

    from talentmesh.sources import feeds

    name = "IFS Sri Lanka Careers"
    place = {"country": "lk", "fullLocation": "Colombo"}
    ad = {"sections": {"a": {"text": "<p>Build things.</p>"}, "b": {"text": None}}}
    listing = {"jobs": [{"id": "1", "name": "One", "location": place, "jobAd": ad}, {"id": "2", "name": "Two", "location": place},
                        {"id": "3", "name": "Three", "location": place}, {"id": "4", "name": "Far", "location": {"country": "se"}}]}
    landed = spark.createDataFrame([(name, "", json.dumps(listing))], "source string, url string, payload string")
    details = spark.createDataFrame(
        [(name, json.dumps({"id": "2", "jobAd": {"sections": {"x": {"text": "<b>Run</b> them."}}}})), (name, "no json")], "source string, payload string")
    rows = feeds.with_ats_details(feeds.parse_feed(landed, feeds.FEEDS[name]), feeds.ats_details(details))
    got = {r.source_id: (r.description, r.detail_page_verified) for r in rows.collect()}
    assert got == {"1": ("Build things.", True), "2": ("Run them.", True), "3": ("", False)}


def test_rows_without_a_link_are_numbered(spark):
    import json

    from talentmesh.sources import feeds

    items = [{"title": "A", "applyLink": "a"}, {"title": "B"}]
    landed = spark.createDataFrame([("3CS Careers", "", json.dumps(items))], "source string, url string, payload string")
    got = feeds.parse_feed(landed, feeds.FEEDS["3CS Careers"]).orderBy("ordinal").collect()
    assert [r.source_id for r in got] == ["a", "3cs-1"]


def test_blank_ids_match_no_detail(spark):
    from talentmesh.sources import feeds

    jobs = spark.createDataFrame([("", "a", ""), ("", "b", ""), ("1", "c", "")], "source_id string, description string, published_raw string")
    details = spark.createDataFrame([("", "wrong", ""), ("", "wrong", ""), ("1", "More.", "")], "source_id string, detail string, published string")
    got = feeds.enriched(jobs, details)
    assert got.columns == jobs.columns
    assert sorted(r.description for r in got.collect()) == ["More. c", "a", "b"]


def test_search_payloads(spark):
    import json

    from talentmesh.sources import cards

    good = {"title": "A", "link": "https://a.test", "snippet": "s", "pagemap": {"cse_thumbnail": [{"src": "t"}]}}
    made = [("g", json.dumps({"items": [good, "odd", {"title": 7, "pagemap": {"cse_thumbnail": {}}}]})),
            ("s", json.dumps({"organic_results": [{"title": "B", "link": "https://b.test", "pagemap": []}]})), ("x", "no json"), ("y", "{}")]
    landed = spark.createDataFrame([(i, *m) for i, m in enumerate(made)], "page_id long, source string, payload string")
    got = cards.search_payloads(landed).orderBy("page_id", "ordinal").select("source", "title", "url", "snippet", "thumbnail")
    assert [tuple(r) for r in got.collect()] == [
        ("g", "A", "https://a.test", "s", "t"), ("g", "7", "", "", ""), ("s", "B", "https://b.test", "", "")]


def test_fan_in_takes_what_the_registry_runs(spark):
    import json

    from talentmesh.sources import feeds

    names = ("Himalayas", "Remotive", "Arbeitnow", "Rootcode Careers")
    made = [(n, "", json.dumps({"jobs": [{"guid": "1", "id": "1"}, {"guid": "2", "id": "2"}], "data": [{"slug": "3"}]})) for n in names]
    landed = spark.createDataFrame(made, "source string, url string, payload string")
    run = lambda remote: feeds.registry_fan_in(
        registry.sources_in_scope(registry.default_registry(spark), "Nurse", remote_global=remote), landed).select("seq", "source", "source_id")
    assert sorted(map(tuple, run(False).collect())) == [(0, "Arbeitnow", "3")]
    assert [r[1] for r in sorted(map(tuple, run(True).collect()))] == ["Remotive", "Remotive", "Himalayas", "Himalayas", "Arbeitnow"]
