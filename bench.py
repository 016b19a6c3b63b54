"""Time the headline queries: BENCH_SF_DIR (sf0.1 by default) on local[BENCH_CPUS].

Each query runs twice in one session and its second time counts, so that neither JVM
warm-up nor the start of Python workers is measured. A run covers plan, execution and
all result rows (written to Spark's no-op sink).
"""

from __future__ import annotations

import json
import os
import sys
import time
from pathlib import Path

sys.path.insert(0, str(Path(__file__).resolve().parent))

from ripplemap.plans.registry import queries  # noqa: E402
from ripplemap.session import local_session  # noqa: E402

HEADLINE = ("q_code_index", "q_bi_index", "q_reference_index", "q_issue_refs", "q_text_refs",
            "q_issue_lookup", "q_impact_report", "q_index_merge")


def run(name: str, spark, sf_dir: str) -> float:
    start = time.perf_counter()
    queries()[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
    return time.perf_counter() - start


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    spark = local_session(os.environ.get("BENCH_CPUS", "8"), name="bench")
    seconds = {}
    for name in HEADLINE:
        run(name, spark, sf_dir)
        seconds[name] = round(run(name, spark, sf_dir), 3)
    spark.stop()
    print(json.dumps({
        "metric": "headline queries, second run, total", "value": round(sum(seconds.values()), 3),
        "unit": "sec", "queries": seconds, "sf": Path(sf_dir).name.removeprefix("sf"),
    }))


if __name__ == "__main__":
    main()
