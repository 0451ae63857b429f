"""Seconds a query on the events and lineitem tables: one JSON line.

BENCH_SF_DIR is the folder of the tables, BENCH_CPUS the number of cores. Every query runs once to warm up and
then BENCH_RUNS times; its figure is the median. Each time the text is parsed, planned, run, and all result rows
are computed (a noop sink takes them). Those named stored_ run on events written as line protocol (ingest is the
seconds of that write, once) with a second write over one of the thirty days; those named compacted_ after compaction.
"""

from __future__ import annotations

import json
import os
import shutil
import statistics
import sys
import tempfile
import time

ROOT = os.path.dirname(os.path.abspath(__file__))
sys.path.insert(0, ROOT)
os.environ["PYTHONPATH"] = os.pathsep.join([ROOT, os.environ.get("PYTHONPATH", "")])

from pyspark.sql import SparkSession  # noqa: E402

from tidemark.queries import GAPPY, RANGE, encode_rows, engine  # noqa: E402
from tidemark.sources.line_protocol import parse_lines  # noqa: E402

QUERIES = {
    "point_10": "SELECT * FROM events LIMIT 10",
    "point_1000": "SELECT * FROM events LIMIT 1000",
    "mean": "SELECT mean(value) FROM events",
    "mean_by_hour": "SELECT mean(value) FROM events GROUP BY time(1h)",
    "mean_by_tag": "SELECT mean(value) FROM events GROUP BY user_id",
    "tag_filter_100": "SELECT * FROM events WHERE user_id = '3' LIMIT 100",
    "time_filter_100": "SELECT * FROM events WHERE time >= 1704412800000000000 AND time < 1704499200000000000 LIMIT 100",
    "flagship": f"SELECT mean(value) AS mean_value, count(value) AS n FROM events WHERE {RANGE} GROUP BY time(1h), event_type fill(null)",
    "quantiles_by_tag": "SELECT percentile(value, 95), median(value), stddev(value), mode(value) FROM events GROUP BY event_type",
    "derivative": "SELECT derivative(mean(value), 1h) FROM events GROUP BY time(1h), event_type fill(none)",
    "moving_average_raw": "SELECT moving_average(value, 10) FROM events GROUP BY user_id",
    "fill_linear": f"SELECT mean(value) FROM events WHERE {GAPPY} GROUP BY time(1m), event_type fill(linear)",
    "limit_by_series": "SELECT value FROM events GROUP BY user_id LIMIT 3",
    "zone_days": "SELECT count(value) FROM events GROUP BY time(1d) tz('America/New_York')",
    "subquery": "SELECT max(m) FROM (SELECT mean(value) AS m FROM events GROUP BY time(1h), user_id fill(none)) GROUP BY user_id",
    "coalesced": "SELECT sum(l_quantity) FROM lineitem GROUP BY time(7d), l_returnflag fill(none)",
}

#: The same shapes on a stored measurement.
STORED = {
    "point_10": "SELECT * FROM ev LIMIT 10",
    "mean": "SELECT mean(value) FROM ev",
    "mean_by_hour": "SELECT mean(value) FROM ev GROUP BY time(1h)",
    "mean_by_tag": "SELECT mean(value) FROM ev GROUP BY user_id",
    "tag_filter_100": "SELECT * FROM ev WHERE user_id = '3' LIMIT 100",
    "time_filter_100": "SELECT * FROM ev WHERE time >= 1704412800000000000 AND time < 1704499200000000000 LIMIT 100",
    "flagship": f"SELECT mean(value) AS mean_value, count(value) AS n FROM ev WHERE {RANGE} GROUP BY time(1h), event_type fill(null)",
}


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", str(os.cpu_count()))
    runs = int(os.environ.get("BENCH_RUNS", "3"))
    spark = (
        SparkSession.builder.master(f"local[{cpus}]")
        .config("spark.driver.memory", "4g")
        .config("spark.sql.shuffle.partitions", cpus)
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    e = engine(spark, sf_dir)
    seconds = {}

    def measure(e, queries: dict[str, str], prefix: str = "") -> None:
        for name, text in queries.items():
            took = []
            for _ in range(runs + 1):
                began = time.perf_counter()
                e.sql(text).write.format("noop").mode("overwrite").save()
                took.append(time.perf_counter() - began)
            seconds[prefix + name] = round(statistics.median(took[1:]), 4)

    measure(e, QUERIES)
    top = tempfile.mkdtemp(prefix="bench-")
    try:
        stored = engine(spark, sf_dir, f"file://{top}")
        rows = stored.sql("SELECT value, event_id FROM events GROUP BY event_type, user_id", ordered=False)
        encode_rows(rows, "ev").write.text(f"file://{top}/lines")
        began = time.perf_counter()
        stored.write_files(f"file://{top}/lines")
        seconds["ingest"] = round(time.perf_counter() - began, 4)
        stored.write_points(parse_lines(encode_rows(rows.where("time >= '2024-01-05' and time < '2024-01-06'"), "ev")))
        measure(stored, STORED, "stored_")
        stored.compact("ev")
        measure(stored, STORED, "compacted_")
    finally:
        shutil.rmtree(top)
    print(json.dumps({"metric": "total_query_seconds", "value": round(sum(seconds.values()), 4), "unit": "sec", "queries": seconds, "sf": sf_dir.rsplit("sf", 1)[-1], "cpus": int(cpus), "spark": spark.version, "driver_memory": "4g"}))
    spark.stop()


if __name__ == "__main__":
    main()
