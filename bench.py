"""Times the headline queries, three runs each, and prints one JSON line with the median of each."""

import json
import os
import tempfile
import time
from statistics import median

from tallygrove.operators import graph
from tallygrove.plans import catalogue, curation  # noqa: F401  the second adds its queries to the first's
from tallygrove.session import build_session

NAMES = (
    "q_block_fuzzy_selfjoin", "q_topk_candidates", "q_clusters", "q_bounded_ancestors", "q_group_flags", "q_authority_left_join_reason", "q_db_membership", "q_stratified_sample",
    "q_fuzzy_membership", "q_location_split", "q_ratio_udf", "q_conflict_pairs", "q_identity_merge", "q_cluster_ids", "q_audit", "q_review_flags",
)
RUNS = 3


def main() -> None:
    sf, cpus = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1"), os.environ.get("BENCH_CPUS", "8")
    conf = {"spark__sql__shuffle__partitions": cpus, "spark__driver__memory": "8g", "spark__ui__showConsoleProgress": "false", "spark__checkpoint__dir": tempfile.mkdtemp(prefix="spark-")}
    spark = build_session("bench", f"local[{cpus}]", **conf)
    spark.sparkContext.setLogLevel("ERROR")

    def timed(name: str) -> float:
        took = []
        for _ in range(RUNS):
            began = time.time()
            catalogue.QUERIES[name](spark, sf).write.format("noop").mode("overwrite").save()
            took.append(time.time() - began)
        return round(median(took), 3)

    took = {name: timed(name) for name in NAMES}
    whole, graph.SMALL = graph.SMALL, 0  # the way that large graphs go
    took["q_clusters_contracted"] = timed("q_clusters")
    graph.SMALL = whole
    print(json.dumps({"metric": "headline queries, total of medians", "value": round(sum(took.values()), 3), "unit": "sec", "queries": took, "sf": sf}))


if __name__ == "__main__":
    main()
