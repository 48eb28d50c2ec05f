"""Registered queries against their SQL on the smallest tables."""

from pathlib import Path

import pytest

import __spark_entry__ as entry

SF = "/root/testdata/sf0.001"
TABLES = [p.stem for p in Path(SF).glob("*.parquet")]
# The heavier queries share their operators with these; all of them run in the driver's check.
PICKED = (
    "country_compatible", "fresh_vacancies", "vacancy_terms", "role_gate", "exact_duplicates",
    "one_per_address", "source_coverage", "audit_invariant", "cv_names", "page_links",
    "structured_postings", "paged_feed", "ats_sections", "parsed_decisions", "review_upsert",
    "inventory_upsert", "current_subscriptions", "email_findings", "near_copies_in_order", "stream_inventory",
    "stored_inventory", "frozen_snapshots", "candidate_priority", "matching_run",
    "link_classes", "merged_links", "validated_hits", "contact_links", "search_phrases", "search_plan", "inventory_capabilities",
)


def cells(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    tidy = lambda v: repr(round(v, 6)) if isinstance(v, float) else str(v)
    return sorted(tuple(tidy(r[i]) for i in order) for r in rows)


@pytest.mark.parametrize("name", PICKED)
def test_query_matches_sql(spark, name):
    duckdb = pytest.importorskip("duckdb")
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"create view {t} as select * from '{SF}/{t}.parquet'")
    got = entry.queries()[name](spark, SF)
    want = con.sql(entry.oracle_sql()[name])
    assert sorted(got.columns) == sorted(want.columns)
    assert cells(got.columns, got.collect()) == cells(want.columns, want.fetchall())


@pytest.mark.parametrize("name, special", [
    ("page_vacancies", "NOT structured"), ("json_board_remote", "sid LIKE '%://%'"), ("detail_enrichment", "sid = ''"),
])
def test_rows_without_an_id_or_structured_data_are_returned(spark, name, special):
    rows = entry.queries()[name](spark, SF)
    assert rows.where(special).count() > 0
    test_query_matches_sql(spark, name)


def test_every_query_is_registered_once():
    assert set(entry.oracle_sql()) <= set(entry.queries())
    assert len(entry.queries()) > 90


def test_entry_runs(spark):
    assert entry.entry(spark).limit(1).count() == 1


def test_names_are_listed_without_a_session():
    import subprocess
    import sys

    said = subprocess.run(
        [sys.executable, "-c", "import __spark_entry__ as e; print(len(e.queries()), len(e.oracle_sql()))"],
        cwd=Path(entry.__file__).parent, capture_output=True, text=True, timeout=120)
    assert said.returncode == 0, said.stderr[-500:]
