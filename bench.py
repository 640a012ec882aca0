"""Times the headline queries and prints one JSON line.

BENCH_SF_DIR names the data folder, BENCH_CPUS the number of local cores.
"""

from __future__ import annotations

import json
import os
import time

from textguard import plans
from textguard.session import local_session
from textguard.sources.tables import DEAL

HEADLINE = (
    "a1_document_summary",
    "b1_match_offsets",
    "d9_pack_counts",
    "b9_validated_pii",
    "b24_verdict",
    "d4_framework_rollup",
    "b26_policy_decision",
    "b16_evasion_scores",
    "b18_set_scores",
    "b22_claim_risk",
    "c6_scan_each_text_once",
    "h6_redacted_texts",
    "d11_drift",
    "d16_auroc_events",
    "e1_trailing_usage",
    "e2_limiter_audit",
)


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = local_session(cpus, shuffle_partitions=int(cpus) if cpus.isdigit() else 8, app="textguard-bench")
    spark.sparkContext.setLogLevel("ERROR")
    spark.read.parquet(f"{sf_dir}/documents.parquet").selectExpr("sum(length(text))").collect()
    # Each given table is one row group; dealing it out is part of the time measured.
    spark.conf.set(DEAL, str(2 * (os.cpu_count() or 8) if not cpus.isdigit() else 2 * int(cpus)))
    seconds = {}
    for name in HEADLINE:
        start = time.perf_counter()
        plans.QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
        seconds[name] = round(time.perf_counter() - start, 3)
    print(
        json.dumps(
            {
                "metric": "headline_query_seconds",
                "value": round(sum(seconds.values()), 3),
                "unit": "sec",
                "queries": seconds,
                "sf": os.path.basename(sf_dir.rstrip("/")),
                "cpus": cpus,
            }
        )
    )
    spark.stop()


if __name__ == "__main__":
    main()
