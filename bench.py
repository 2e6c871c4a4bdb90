"""Time the headline queries and print one JSON line.

BENCH_SF_DIR picks the tables (default /root/testdata/sf0.1), BENCH_CPUS the cores.
Each query runs once to warm up and is then timed on a full read of its result.
"""

from __future__ import annotations

import json
import os
import time

from lintlake.plans.queries import QUERIES
from lintlake.session import build_session
from lintlake.sources.corpus import explode_lines
from lintlake.plans.derived import code_corpus

HEADLINE = [
    "project_score", "secret_findings", "duplicate_code", "race_conditions", "user_rules", "code_imports",
    "import_edges", "top_modules", "dependency_inventory", "dependency_nodes", "compliance_status",
    "score_trend", "diff_lines", "review_findings", "gate", "snapshot_changes", "mutation_expand",
    "response_verdicts", "executive_summary", "stream_scan",
]


def run(df) -> None:
    df.write.format("noop").mode("overwrite").save()


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", str(os.cpu_count() or 4))
    spark = build_session(
        "lintlake-bench",
        f"local[{cpus}]",
        **{
            "spark.sql.shuffle.partitions": cpus,
            "spark.ui.enabled": "false",
            "spark.ui.showConsoleProgress": "false",
            "spark.driver.memory": "8g",
        },
    )
    spark.sparkContext.setLogLevel("ERROR")
    n_lines = explode_lines(code_corpus(spark, sf_dir)).count()
    times = {}
    for name in HEADLINE:
        run(QUERIES[name](spark, sf_dir))
        start = time.perf_counter()
        run(QUERIES[name](spark, sf_dir))
        times[name] = round(time.perf_counter() - start, 3)
    print(
        json.dumps(
            {
                "metric": "headline queries, total",
                "value": round(sum(times.values()), 3),
                "unit": "sec",
                "queries": times,
                "sf": os.path.basename(sf_dir.rstrip("/")).removeprefix("sf"),
                "scan_lines_per_sec": round(n_lines / times["project_score"]),
            }
        )
    )
    spark.stop()


if __name__ == "__main__":
    main()
