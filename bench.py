"""Time the headline queries and print one JSON line.

BENCH_SF_DIR (default /root/testdata/sf0.1) and BENCH_CPUS (default 8) choose data and cores.
"""

from __future__ import annotations

import json
import os
import time

from contract.queries import QUERIES
from contract.views import register
from tillroll.session import local_session

HEADLINE = (
    "read_receipts",
    "clean_ean",
    "reconstruct_ean_lcs",
    "apply_label_rules",
    "clean_label",
    "drop_similar_labels",
    "propagate_family_by_label",
    "label_receipts",
    "labelling_report",
    "ean_occurrence_histogram",
    "labels_per_ean_histogram",
    "receipt_summary",
    "text_features",
    "tfidf_features",
    "flat_classifier",
    "flat_classifier_documents",
    "lcpn_classifier",
    "lcpl_classifier",
    "repeated_holdout",
    "kfold_scores",
    "classification_metrics",
    "accuracy_by_level",
    "hierarchical_metrics",
    "accuracy_table",
    "sankey_table",
    "confusion_matrix",
    "confusion_pairs",
    "kept_model",
    "stem_labels",
)


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = local_session("bench", cpus, shuffle_partitions=int(cpus) if cpus.isdigit() else 8)
    register(spark, sf_dir)
    QUERIES["overall_accuracy"](spark, sf_dir).collect()  # start-up costs stay out of the first query
    seconds = {}
    for name in HEADLINE:
        start = time.time()
        # every column of every row is computed, nothing is sent to the driver
        QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
        seconds[name] = round(time.time() - start, 3)
    print(
        json.dumps(
            {
                "metric": "headline_queries_total",
                "value": round(sum(seconds.values()), 3),
                "unit": "sec",
                "queries": seconds,
                "sf": os.path.basename(sf_dir.rstrip("/")),
            }
        )
    )
    spark.stop()


if __name__ == "__main__":
    main()
