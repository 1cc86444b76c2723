"""Time the headline queries on whole tables and print one JSON line.

BENCH_SF_DIR names the tables, BENCH_CPUS the local cores. Each query starts without shared
results of the others and is written to a sink that keeps nothing.
"""

from __future__ import annotations

import json
import os
import sys
import time

from textrill.checks import queries
from textrill.session import local_session

HEADLINE = (
    "t4_cleaner_chain",
    "f3_tfidf",
    "f7_document_vectors",
    "l5_train_batch",
    "p1_batch_job",
    "p3_prequential_metrics",
    "p3_text_metrics",
    "p3_stream_metrics",
    "p4_side_labels",
    "l13_naive_bayes_predictions",
    "l14_logistic_sgd",
    "l15_svm_cascade",
    "e8_majority_vote",
    "l17_l21_streaming_sgd",
    "x2_mutual_information",
)


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    spark = local_session(os.environ.get("BENCH_CPUS", "8"), "bench")
    names = sys.argv[1:] or HEADLINE
    spark.range(1000).groupBy("id").count().write.format("noop").mode("overwrite").save()
    spent = {}
    for name in names:
        queries.forget()
        start = time.time()
        queries.QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
        spent[name] = round(time.time() - start, 3)
        print(f"{name} {spent[name]}", file=sys.stderr, flush=True)
    result = {
        "metric": "headline queries, total",
        "value": round(sum(spent.values()), 3),
        "unit": "sec",
        "queries": spent,
        "sf": sf_dir.rstrip("/").rsplit("/", 1)[-1].removeprefix("sf"),
    }
    print(json.dumps(result))


if __name__ == "__main__":
    main()
