"""Times the headline queries on $BENCH_SF_DIR with $BENCH_CPUS cores and prints one JSON line."""

from __future__ import annotations

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from lureline.plans.catalog import QUERIES
from lureline.session import local_session

HEADLINE = ("b_normalize", "c1_rule_scan", "e_entities", "f_page_links", "i4_escalation", "j2_train", "j3_score", "k5_band_counts", "m_page_findings", "n2_language",
            "o5_document_variants", "p_corpus_checks", "q4_distributions", "o12_dedup", "t4_sessions")


def main() -> None:
    folder = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = local_session("bench", cpus, int(cpus) if cpus.isdigit() else 8)
    spark.read.parquet(f"{folder}/documents.parquet").count()
    seconds = {}
    for name in os.environ.get("BENCH_QUERIES", ",".join(HEADLINE)).split(","):
        begun = time.time()
        QUERIES[name](spark, folder).write.format("noop").mode("overwrite").save()
        seconds[name] = round(time.time() - begun, 3)
    rows = spark.read.parquet(f"{folder}/documents.parquet").count()
    print(json.dumps({"metric": "headline_total", "value": round(sum(seconds.values()), 3), "unit": "sec", "queries": seconds, "sf": os.path.basename(folder.rstrip("/")), "documents": rows}))


if __name__ == "__main__":
    main()
