"""Queries over events load the whole table, whatever they read back."""

import pytest
from comparing import same_rows

from tidemark import queries
from tidemark.engine import Engine, Limits, WriteError
from tidemark.sources.line_protocol import parse_lines


def test_stored_engine_holds_all_events(spark, sf_dir):
    events = spark.read.parquet(f"{sf_dir}/events.parquet").count()
    assert queries._stored(spark, sf_dir).sql("SELECT count(event_id) AS n FROM ev", db="stored").first()["n"] == events


def test_bounded_queries_have_one_over_all_events(spark, duck, sf_dir):
    bounded = {n for n, q in queries.QUERIES.items() if not n.endswith("_whole") and q.sql and (queries.SQL_RANGE in q.sql or queries.SQL_GAPPY in q.sql)}
    assert bounded <= {n.removesuffix("_whole") for n in queries.QUERIES if n.endswith("_whole")}
    assert len(queries.QUERIES["select_star_whole"].run(spark, sf_dir).collect()) == duck.sql("SELECT count(*) FROM events").fetchall()[0][0]


def test_linear_fill_over_all_days(spark, duck, sf_dir):
    q = queries.QUERIES["fill_linear"]
    mine = {(r["time"], r["event_type"]): r["m"] for r in queries.QUERIES["fill_linear_whole"].run(spark, sf_dir).collect()}
    theirs = {(t, k): m for t, k, m in duck.sql(f"SELECT time, event_type, m FROM ({queries._unbounded(q.sql)})").fetchall()}
    assert mine.keys() == theirs.keys() and len(mine) == 5 * 30 * 144
    assert all((m is None) == (theirs[k] is None) and (m is None or abs(m - theirs[k]) < 1.1e-6) for k, m in mine.items())


@pytest.mark.parametrize("name", ["stored_last_write_wins", "columnar_source", "materialized_view", "source_qualified", "drop_database_written"])
def test_tables_of_more_points_than_a_request_may_have(spark, duck, sf_dir, monkeypatch, name):
    monkeypatch.setattr(Limits.__init__, "__defaults__", (100, None, None))
    same_rows(queries.queries()[name](spark, sf_dir), duck.sql(queries.QUERIES[name].oracle()))


def test_points_of_a_frame_are_not_a_request(spark, tmp_path):
    e = Engine(spark, f"file://{tmp_path}/root", limits=Limits(points=3))
    points = parse_lines(spark.createDataFrame([(f"m v={i} {i}",) for i in range(10)], "value string"))
    assert e.write_points(points) == 10 and e.sql("SELECT count(v) AS n FROM m").first()["n"] == 10
    for write in (lambda: e.write("\n".join(f"m v={i} {i}" for i in range(4))), lambda: e.write_points(points, bulk=False)):
        with pytest.raises(WriteError, match="too many points"):
            write()
