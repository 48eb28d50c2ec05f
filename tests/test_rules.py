"""Rules of matching, one case per row."""

import re

from pyspark.sql import functions as F

from talentmesh.functions import cv, dates, geo, scoring, urls
from talentmesh.functions.text import (
    bounded_text, clean_html, guard_formula, mask_to_array, skill_mask, title_mask, unescape,
)
from talentmesh import lexicons as lex
from talentmesh.operators import filters, links, roles

JOB = ("seq bigint, source string, source_id string, title string, company string, "
       "location string, country_hint string, url string, description string, "
       "published_raw string, salary string, job_type string, detail_page_verified boolean")


def job(seq, title="Engineer", location="", hint="", source="Feed", published="", verified=False,
        description="", url="", company="Acme", source_id=""):
    return (seq, source, source_id or str(seq), title, company, location, hint, url, description,
            published, "", "", verified)


def column(spark, expr, values, kind="string"):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], f"i int, v {kind}")
    return [r[0] for r in df.select(expr(F.col("v")).alias("o"), "i").orderBy("i").select("o").collect()]


def test_country_rule(spark):
    rows = [
        job(1, location="Colombo, Sri Lanka", hint="sri lanka"),
        job(2, location="Worldwide", hint=""),
        job(3, location="Remote", hint="lk"),
        job(4, location="Bangalore, India", hint="sri lanka"),
        job(5, location="", hint="srilanka"),
        job(6, location="Remote - Germany", hint=""),
        job(7, location="Negombo", hint="sri lanka"),
        job(8, location="Anywhere except India", hint=""),
    ]
    df = spark.createDataFrame(rows, JOB)
    kept = lambda g: {r.seq for r in filters.country_compatible(df, "Sri Lanka", g).collect()}
    assert kept(False) == {1, 3, 5, 7}
    assert kept(True) == {1, 2, 3, 5, 7}


def test_freshness(spark):
    rows = [
        job(1, published="2024-01-30"), job(2, published="2023-10-01"),
        job(3, published="2023-10-01", source="XpressJobs"), job(4, published="2024-03-01"),
        job(5, source="Crawl4AI"), job(6, source="Crawl4AI", verified=True), job(7),
        job(8, description="Sorry, this position has been filled."),
        job(9, published="Mon, 15 Jan 2024 10:00:00 +0000"), job(10, published="last week"),
    ]
    kept = filters.fresh(spark.createDataFrame(rows, JOB), "2024-02-01 00:00:00", 30)
    assert {r.seq for r in kept.collect()} == {1, 3, 6, 7, 9, 10}


def test_required_years(spark):
    rows = [("Senior AI Engineer", ""), ("Engineer", "at least 3 years"), ("Junior Developer", ""),
            ("Accountant", ""), ("Director", "minimum 2 years"), ("Cook", "requires 80 years"),
            ("International Buyer", "")]
    df = spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "i int, t string, d string")
    got = [r[0] for r in df.orderBy("i").select(
        scoring.required_years(F.col("t"), F.col("d"))).collect()]
    assert got == [3.0, 3.0, 0.0, None, 7.0, None, 0.0]


def suits(title, target):
    """The gate for one title and target: whole phrase, family, distinctive words, or half of the generic ones."""
    plain = lambda t: " " + " ".join(re.findall(r"[a-z0-9+#]+", t.lower())) + " "
    words = [w for w in plain(target).split() if len(w) > 1 and w not in lex.SENIORITY_TOKENS]
    telling = [w for w in words if w not in lex.GENERIC_ROLE_TOKENS]
    related = next((names for marks, names in lex.ROLE_FAMILIES if any(plain(m) in plain(target) for m in marks)), None)
    held = lambda names: [n for n in names if plain(n) in plain(title)]
    if not target or plain(target) in plain(title):
        return True
    if related or telling:
        return bool(held(related or telling))
    return bool(words) and len(held(words)) >= (len(words) + 1) // 2


def test_role_gate_matches_row_rule(spark):
    targets = ["DevOps Engineer", "Machine Learning Engineer", "Accountant", "Manager",
               "Senior Data Analyst", "HR Manager", "", "C++ Developer", "Senior"]
    titles = ["Site Reliability Engineer", "NLP Engineer", "Auditor", "Project Manager",
              "BI Analyst", "Talent Acquisition Lead", "Chef", "C++ Guru", "Senior Manager"]
    hit = {(r.role, r.title) for r in roles.role_titles(
        spark.createDataFrame([(t,) for t in targets], "role string"),
        spark.createDataFrame([(t,) for t in titles], "title string")).collect()}
    for target in targets:
        assert {t for role, t in hit if role == target} == {t for t in titles if suits(t, target)}, target
    assert ("DevOps Engineer", "Site Reliability Engineer") in hit
    assert ("Accountant", "Chef") not in hit
    assert ("", "Chef") in hit


def test_terms(spark):
    text = "Python, C#, c++ and machine\n learning; golang, JavaScript CI/CD".lower()
    assert column(spark, lambda c: mask_to_array(skill_mask(c), lex.SKILLS), [text]) == [
        ["c#", "c++", "ci/cd", "javascript", "machine learning", "python"]]
    assert column(spark, lambda c: mask_to_array(title_mask(c), lex.TITLE_TERMS),
                  ["ai/ml engineer & sales manager"]) == [["ai/ml engineer", "engineer", "manager", "sales"]]


def test_cv(spark):
    text = ("Jane Candidate\njane@mail.test\n+94 71 234 5678\nSoftware Developer\n"
            "Skills: Python, React\n- Built APIs\nhttps://x.test https://x.test")
    df = spark.createDataFrame([("1", text)], "candidate_id string, raw_text string")
    row = cv.parse_cvs(df).first()
    assert (row.name, row.email, row.phone) == ("Jane Candidate", "jane@mail.test", "+94 71 234 5678")
    assert row.links == ["https://x.test"] and {"python", "react"} <= set(row.skills)
    assert row.likely_titles == ["developer"]
    assert row.experience_lines == ["Software Developer", "- Built APIs"]
    assert column(spark, cv.repair_spacing, ["S e n i o r   C h e f", "plain line"]) == [
        "Senior Chef", "plain line"]


def test_html_and_cells(spark):
    assert column(spark, clean_html, ["<p>A &amp;lt; B</p><br>C&nbsp;&#x27;D&#39;"]) == ["A &lt; B C 'D'"]
    assert column(spark, unescape, ["&bogus; &euro;", "x"]) == ["&bogus; €", "x"]
    assert column(spark, guard_formula, ["=1", "  +1", "a-b", "@x", "-"]) == ["'=1", "'  +1", "a-b", "'@x", "'-"]
    out = column(spark, lambda c: bounded_text(c, 100), ["h" * 300 + "t" * 300])[0]
    assert len(out) == 100 and out.startswith("h") and out.endswith("t") and lex.EVIDENCE_GAP in out


def test_urls(spark):
    assert column(spark, urls.vacancy_url, [
        "HTTPS://A.Test/Jobs/1/?utm_source=x&b=2&a=1#f", "not a url", ""]) == [
        "https://a.test/Jobs/1?a=1&b=2", "not a url", ""]
    assert column(spark, urls.crawl_url, ["http://a.test//x//y/?gclid=1&q=", "ftp://a.test", "http://a b"]) == [
        "http://a.test/x/y?q=", "", ""]
    joined = column(spark, lambda c: urls.join_url(F.lit("https://h.test/a/b?x"), c),
                    ["/c", "d", "../e", "//o.test/f", "?q=1", "https://z.test"])
    assert joined == ["https://h.test/c", "https://h.test/a/d", "https://h.test/e",
                      "https://o.test/f", "https://h.test/a/b?q=1", "https://z.test"]


def test_link_classes(spark):
    rows = [("https://p.test/", "Home", "other"), ("https://p.test/jobs", "Jobs", "navigation"),
            ("https://p.test/job/12-nurse", "Nurse", "detail"),
            ("https://p.test/blog/nurse", "Nurse", "other"),
            ("https://p.test/x?page=2", "2", "navigation"), ("https://p.test/view?job_id=3", "View", "detail"),
            ("https://p.test/cv.pdf", "Apply", "other"), ("https://p.test/it-jobs", "IT", "navigation")]
    df = spark.createDataFrame(rows, "url string, title string, want string")
    assert [(r.url, r.link_class) for r in links.classified(df).collect()] == [(u, w) for u, _, w in rows]


def test_expiry(spark):
    now = dates.as_literal("2024-02-01 19:00:00")
    assert column(spark, lambda c: dates.feed_expired(c, now),
                  ["2024-02-01", "2024-02-02", "2024-02-02T00:00:00+05:30", "soon"]) == [True, False, True, False]
    assert column(spark, lambda c: dates.offer_expired(c, now),
                  ["2024-02-01", "2024-01-31", "2024-02-01T18:00:00Z", ""]) == [False, True, True, False]


def test_places(spark):
    assert column(spark, lambda c: geo.evidence_place(c, F.lit("LK")), ["near Kandy", "Berlin"]) == ["Kandy", ""]
    assert column(spark, geo.foreign_location, ["Foreign job", "Dubai; International", "International Rd"]) == [
        True, True, False]


def test_years_after_a_no_break_space(spark):
    from talentmesh.functions.scoring import required_years

    values = ["At least 5 years", "minimum 3 years", "nothing"]
    got = column(spark, lambda v: required_years(F.lit(""), v), values)
    assert got == [5.0, 3.0, None]


def test_cv_terms_are_found_without_writing_the_text_anew(spark):
    from talentmesh.functions import text as tx

    signs = ["", " ", "\n", " ", ".", ",", "-", "/", "+", "#", "é", "_", "\U0001f600", "x", "--  ", "1"]
    terms = [*lex.SKILLS, *lex.TITLE_TERMS]
    rows = [(a + t.upper().replace(" ", b or " ") + c,) for t in terms for a in signs for b, c in zip(signs, signs[3:] + signs[:3])]
    rows += [(f"{t}{s}{u}",) for t, u in zip(terms, terms[7:]) for s in signs] + [("",), (None,)]
    raw = F.col("raw")
    got = spark.createDataFrame(rows, "raw string").select(
        "raw", tx.cv_skill_mask(raw).alias("s"), tx.skill_mask(tx.cv_text(raw)).alias("s_want"),
        tx.cv_title_mask(raw).alias("t"), tx.title_mask(tx.cv_text(raw)).alias("t_want")).collect()
    assert sum(bool(r.s) for r in got) > 1000
    assert [r.raw for r in got if (r.s, r.t) != (r.s_want, r.t_want)] == []
