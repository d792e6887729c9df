"""Wall time of the headline queries; prints one JSON line.

``BENCH_SF_DIR`` names the tables (default /root/testdata/sf0.1), ``BENCH_CPUS`` the local cores.
Every query is run to its last row and column into a sink that discards them.
"""

from __future__ import annotations

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from tagtrail.plans.queries import QUERIES  # noqa: E402
from tagtrail.session import local_session  # noqa: E402

HEADLINE = [
    "tag_time_features", "scans_per_hour", "during_exhibition", "bundle_journeys",
    "burst_anomalies", "bursty_tags", "locations_flat", "nearest_location", "feature_matrix",
    "tag_metrics", "first_tag_rooms", "graph_edges", "pagerank", "influence_report",
    "label_propagation", "connected_components", "basket_edges", "basket_pagerank",
    "basket_communities", "basket_triangles", "target_correlation", "cluster_variance",
    "cosine_similarity", "pairwise_cityblock", "kmeans_sweep", "strongly_connected_components",
    "cluster_type_correlation",
]


def main() -> None:
    folder = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = int(os.environ.get("BENCH_CPUS", "8"))
    spark = local_session(cpus, shuffle_partitions=cpus, memory="16g", app="bench")
    # Start the session's services before the clock runs.
    spark.range(1000).selectExpr("sum(id)").collect()
    times: dict[str, float] = {}
    for name in HEADLINE:
        start = time.perf_counter()
        QUERIES[name](spark, folder).write.format("noop").mode("overwrite").save()
        times[name] = round(time.perf_counter() - start, 3)
        print(f"{name}: {times[name]}", file=sys.stderr, flush=True)
    spark.stop()
    print(json.dumps({"metric": "total wall time of the headline queries",
                      "value": round(sum(times.values()), 3), "unit": "sec", "queries": times,
                      "sf": os.path.basename(folder.rstrip("/"))}))


if __name__ == "__main__":
    main()
