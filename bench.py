"""Runs the headline queries and prints one JSON line of seconds.

``BENCH_SF_DIR``: the tables (sf0.1 by default); ``BENCH_CPUS``: cores.
Each query is run once to warm up and then timed as the median of three.
"""

from __future__ import annotations

import json
import os
import statistics
import sys
import time

from brindle.queries import QUERIES
from brindle.session import get_session

HEADLINE = (
    "flagship_q3",
    "pricing_summary_q1",
    "join_equi",
    "join_multi",
    "join_subquery",
    "index_point_lookup",
    "project_arith",
    "filter_like",
    "filter_ilike",
    "agg_expr",
    "agg_median",
    "distinct_multi",
    "in_subquery",
    "not_in_subquery",
    "topn",
    "setop_chain",
    "dml_insert",
    "dml_update",
)


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = get_session("bench", f"local[{cpus}]", **{"spark.sql.shuffle.partitions": cpus, "spark.ui.enabled": "false", "spark.ui.showConsoleProgress": "false", "spark.driver.memory": "4g"})
    spark.sparkContext.setLogLevel("ERROR")
    seconds = {}
    for name in HEADLINE:
        took = []
        for _ in range(4):
            began = time.perf_counter()
            QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
            took.append(time.perf_counter() - began)
        seconds[name] = round(statistics.median(took[1:]), 4)
        print(name, seconds[name], file=sys.stderr)
    print(json.dumps({"metric": "total_seconds", "value": round(sum(seconds.values()), 3), "unit": "sec", "queries": seconds, "sf": os.path.basename(sf_dir.rstrip("/")).removeprefix("sf")}))
    spark.stop()


if __name__ == "__main__":
    main()
