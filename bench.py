"""Headline queries over whole tables at ``$BENCH_SF_DIR``; prints one line of JSON."""

from __future__ import annotations

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from inkblot.plans.queries import queries  # noqa: E402
from inkblot.session import get_spark  # noqa: E402

HEADLINE = (
    "scan_doc", "risk_band", "scrub_text", "vault", "scan_code", "scrub_code", "find_entropy", "restore", "restore_map",
    "allow_list", "find_person_join", "scrub_json", "scrub_columns", "scrub_table", "top_findings", "stream_scrub",
)


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cores = os.environ.get("BENCH_CPUS", str(os.cpu_count()))
    spark = get_spark("bench", cores, **{"spark.ui.showConsoleProgress": "false", "spark.sql.shuffle.partitions": cores})
    spark.sparkContext.setLogLevel("ERROR")
    registered = queries()
    names = sys.argv[1:] or HEADLINE
    # one untimed run, so that the first query does not pay for starting up
    registered["scan_doc"](spark, sf_dir).write.format("noop").mode("overwrite").save()
    seconds = {}
    for name in names:
        began = time.time()
        registered[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
        seconds[name] = round(time.time() - began, 3)
    print(json.dumps({
        "metric": "total time of headline queries", "value": round(sum(seconds.values()), 3), "unit": "sec",
        "queries": seconds, "sf": os.path.basename(sf_dir.rstrip("/")).removeprefix("sf"),
    }))


if __name__ == "__main__":
    main()
