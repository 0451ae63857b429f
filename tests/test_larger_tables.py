"""Queries that write events take more of them than one request's body may have."""

import pytest
from comparing import same_rows

from tidemark import queries
from tidemark.engine import Limits

NAMES = [
    "export_import_whole",
    "retention",
    "select_into_whole",
    "stored_last_write_wins_whole",
    "stored_tombstones",
    "columnar_source_whole",
    "retention_whole",
    "stored_tag_filter",
    "stored_tombstones_whole",
    "materialized_view_whole",
    "compacted",
    "export_import",
    "select_into",
]


@pytest.mark.parametrize("name", NAMES)
def test_more_events_than_a_request_may_have(spark, duck, sf_dir, monkeypatch, name):
    monkeypatch.setattr(Limits.__init__, "__defaults__", (100, None, None))
    same_rows(queries.queries()[name](spark, sf_dir), duck.sql(queries.QUERIES[name].oracle()))


@pytest.mark.parametrize("name", ["columnar_source", "columnar_source_whole"])
def test_events_of_one_instant_are_all_kept(spark, duck, sf_dir, tmp_path, name):
    """Copies with shifted keys share type and instant; so do two events of one user."""
    copies = f"SELECT event_id + 1000 * k AS event_id, ts, user_id + 100 * (k // 2) AS user_id, event_type, value + k AS value, props FROM '{sf_dir}/events.parquet', range(4) r(k)"
    duck.sql(f"COPY ({copies}) TO '{tmp_path}/events.parquet'")
    own = duck.cursor()
    own.sql(f"CREATE TEMP VIEW events AS SELECT * FROM '{tmp_path}/events.parquet'")
    same_rows(queries.queries()[name](spark, str(tmp_path)), own.sql(queries.QUERIES[name].oracle()))
