"""Time the headline queries: prints one JSON line.

``BENCH_SF_DIR`` is the folder of tables and ``BENCH_CPUS`` the number of local cores. Every query
is planned and run in full into a sink that discards rows.
"""

from __future__ import annotations

import json
import os
import sys
import time

from framequarry import queries
from framequarry.session import local_session

HEADLINE = [
    "frame_report",
    "process_frames",
    "process_frames_auto",
    "box_downscale",
    "mode_downscale",
    "map_to_palette",
    "bleed_edges",
    "outline_outside",
    "cleanup_remove",
    "wu_quantise",
    "auto_palette",
    "sprite_checks",
    "compare_builds",
    "frame_change_stats",
    "prune_history",
    "evict_lru",
    "stage_keys",
    "plan_run",
    "batch_report",
    "merge_layers",
    "sample_keys",
    "skin_vertices",
    "frame_fit",
    "layout_grid",
    "layout_packed",
    "cell_overlaps",
    "export_pixi",
    "suggest",
    "history_stream",
]


def main() -> int:
    directory = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cores = os.environ.get("BENCH_CPUS", "8")
    only = sys.argv[1:] or HEADLINE
    spark = local_session(cores, os.environ.get("BENCH_MEMORY", "16g"), "framequarry-bench")
    queries.load_all()
    queries.QUERIES["box_downscale"](spark, directory).write.format("noop").mode("overwrite").save()  # warm-up
    times = {}
    for name in only:
        start = time.perf_counter()
        queries.QUERIES[name](spark, directory).write.format("noop").mode("overwrite").save()
        times[name] = round(time.perf_counter() - start, 3)
        print(name, times[name], file=sys.stderr, flush=True)
    spark.stop()
    sf = directory.rstrip("/").rsplit("sf", 1)[-1]
    print(json.dumps({"metric": "headline_total", "value": round(sum(times.values()), 3), "unit": "sec", "queries": times, "sf": sf}))
    return 0


if __name__ == "__main__":
    sys.exit(main())
