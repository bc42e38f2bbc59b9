"""Times the headline queries and prints one JSON line."""

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from engramite.plans import library  # noqa: E402
from engramite.session import build_session  # noqa: E402

#: One of each family; all of the library's queries with BENCH_ALL=1.
HEADLINE = (
    "VEC5_hybrid_rrf VEC5_boosted_rrf VEC19_rerank AGG32_weight_sweep TXT8_bm25 TXT11_query_expansion AGG19_idf VEC2_knn JOI3_nearest_neighbours AGG22_density VEC21_semantic_dedup AGG14_report AGG24_handoff "
    "AGG26_loops JOI13_as_of ST2_sessions SEQ1_workflows SEQ4_interval_union WIN7_look_back CLU3_components CLU6_cluster_stats KG1_entities KG3_relations TXT17_chunks SRC11_html_text SNK8_supersede NUM_describe NUM_spearman"
).split()


def main() -> None:
    folder, cores = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1"), os.environ.get("BENCH_CPUS", "8")
    spark = build_session("bench", cores=cores, partitions=8)
    names = sorted(library.QUERIES) if os.environ.get("BENCH_ALL") else HEADLINE
    library.QUERIES[names[0]](spark, folder).write.format("noop").mode("overwrite").save()  # starts the JVM's compiler and the Python workers
    took = {}
    for name in names:
        began = time.time()
        library.QUERIES[name](spark, folder).write.format("noop").mode("overwrite").save()
        took[name] = round(time.time() - began, 3)
    print(json.dumps({"metric": "total_seconds", "value": round(sum(took.values()), 3), "unit": "sec", "queries": took, "sf": os.path.basename(folder.rstrip("/"))}))
    spark.stop()


if __name__ == "__main__":
    main()
