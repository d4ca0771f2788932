"""Registered queries against their SQL.  ``CANDLEWICK_ALL=1`` runs every one."""

import os
import subprocess
import sys
from pathlib import Path

import duckdb
import pytest

from oracle import TABLES, compare

import __spark_entry__ as entry
from candlewick.catalog import changes, volume

SF = os.environ.get("CANDLEWICK_SF", "/root/testdata/sf0.001")
QUICK = {
    "flagship_latest_activity", "volume_event", "volume_session_reset", "bars_from_events", "resolve_revisions", "resolve_revisions_exact",
    "gap_fill_merge", "gap_fill_counts", "model_path", "has_eligible_between", "infer_ready_all", "row_functions", "adaptive_step", "context15",
    "price_event", "price_reasons", "cockpit", "gate_skip", "joint_outcomes", "reset_symbol", "health_report", "decode_feed_json", "dictionary_checks",
    "golden_category_mismatches", "late_or_duplicate",
}
ALL = bool(os.environ.get("CANDLEWICK_ALL"))


def test_queries_can_be_listed_without_a_session():
    listing = "import __spark_entry__ as e; assert e.queries() and e.oracle_sql()"
    subprocess.run([sys.executable, "-c", listing], cwd=Path(entry.__file__).parent, check=True)


def test_every_query_has_a_check():
    own = {name for name in entry.queries() if not name.startswith("op") and name != "pipeline"}
    assert own == set(entry.oracle_sql()) & own


@pytest.mark.parametrize("name", sorted(set(entry.oracle_sql()) if ALL else QUICK))
def test_query(spark, name):
    problems, rows, _, _ = compare(spark, name, entry.queries()[name], entry.oracle_sql()[name], SF)
    assert not problems
    assert rows > 0


@pytest.mark.parametrize(
    "name, value",
    [
        ("parse_time_and_volume", "CASE WHEN event_id % 5 = 0 THEN 0.0 ELSE value END"),  # "-0.0" is no negative number
        ("joint_commit", "CASE WHEN event_type = 'click' THEN 0.1 ELSE value END"),  # a symbol that never commits
    ],
)
def test_query_on_odd_values(spark, tmp_path, name, value):
    for t in TABLES:
        (tmp_path / f"{t}.parquet").symlink_to(f"{SF}/{t}.parquet")
    (tmp_path / "events.parquet").unlink()
    duckdb.execute(f"COPY (SELECT * REPLACE ({value} AS value) FROM '{SF}/events.parquet') TO '{tmp_path}/events.parquet'")
    problems, rows, _, _ = compare(spark, name, entry.queries()[name], entry.oracle_sql()[name], str(tmp_path))
    assert not problems
    assert rows > 0


def test_entry(spark):
    assert entry.entry(spark).count() == 5


def test_all_stages_read_written_bars(spark):
    read = changes.events(spark, "/root/testdata/sf0.001").inputFiles()
    assert read and not any(f.endswith("events.parquet") for f in read)


def test_shipments_carry_no_lineage(spark, monkeypatch):
    seen, made = [], volume.V.volume_events
    monkeypatch.setattr(volume.V, "volume_events", lambda b: (seen.append(b), made(b))[1])
    volume.shipments(spark, SF)
    assert seen[0].select("market_snapshot_id", "source_timestamp").distinct().count() == 1
