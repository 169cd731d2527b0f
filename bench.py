"""Time the headline queries and print one JSON line.

The derived document tables are written first and not timed; each query then reads them from
Parquet, and its whole result is computed. Every query runs twice, the second run counts.
"""

import json
import os
import time

from docproof.plans.catalog import QUERIES
from docproof.plans.fixture import Documents
from docproof.session import local_session

HEADLINE = [
    "verify_documents_end_to_end",
    "validate_records",
    "ingest_responses",
    "assemble_text",
    "page_count",
    "capture_errors",
    "is_grounded",
    "is_amount_grounded",
    "is_grounded_in_prose",
    "normalize_text",
    "build_extraction_requests",
    "issue_rows",
    "field_review",
    "run_summary",
    "overlay_edits",
    "revalidate",
]


def seconds(spark, name, sf_dir):
    start = time.perf_counter()
    QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
    return time.perf_counter() - start


def main():
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", str(os.cpu_count()))
    spark = local_session(cpus, "docproof-bench")
    documents = Documents(spark, sf_dir).clean.count()
    timed = {}
    for name in HEADLINE:
        seconds(spark, name, sf_dir)
        timed[name] = round(seconds(spark, name, sf_dir), 3)
    print(json.dumps({
        "metric": "headline queries, second run", "value": round(sum(timed.values()), 3), "unit": "sec",
        "queries": timed, "sf": os.path.basename(sf_dir.rstrip("/")).removeprefix("sf"),
        "documents": documents, "cpus": int(cpus),
        "verified_per_second": round(documents / timed["verify_documents_end_to_end"]),
    }))
    spark.stop()


if __name__ == "__main__":
    main()
