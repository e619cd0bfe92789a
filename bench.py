"""Seconds per query on local cores. Prints one JSON line.

Queries run in the order of the analysis from nothing; each pays for the tables that no earlier query needed.
"""

import json
import os
import time

from netloom.plans import queries as registry
from netloom.session import local_session

HEADLINE = [
    "normalize_packets", "timeline_index", "build_flows", "inter_packet_delay", "enriched_flows", "host_flow_expansion", "host_profiles", "relationships",
    "graph_nodes", "graph_state", "hypothesis_priority", "investigation_candidates", "narratives", "timeline_events", "activity_phases", "chapters",
    "frame_state", "frame_recent_events", "snapshot_windows", "temporal_snapshots", "ranked_hosts", "relationship_context", "capture_summary",
]


def main() -> None:
    folder = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cores = os.environ.get("BENCH_CPUS", "8")
    spark = local_session(cores, partitions=int(cores) if cores.isdigit() else 8)
    spark.sparkContext.setLogLevel("ERROR")
    spark.range(1000).selectExpr("sum(id)").collect()  # start the executor threads before the clock runs
    seconds = {}
    for name in HEADLINE:
        start = time.perf_counter()
        registry.run(name)(spark, folder).write.format("noop").mode("overwrite").save()
        seconds[name] = round(time.perf_counter() - start, 3)
    print(json.dumps({
        "metric": "network behaviour analysis, all headline queries from raw events", "value": round(sum(seconds.values()), 3), "unit": "sec",
        "queries": seconds, "sf": os.path.basename(folder.rstrip("/")).removeprefix("sf"),
    }))
    spark.stop()


if __name__ == "__main__":
    main()
