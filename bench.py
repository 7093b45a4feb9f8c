"""Time the headline queries and print one JSON line. ``BENCH_SF_DIR`` and ``BENCH_CPUS`` set data and cores."""

from __future__ import annotations

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from corpusweave.queries import registry  # noqa: E402
from corpusweave.session import build_session  # noqa: E402

HEADLINE = [
    "link_fanin", "link_resolve", "link_classify", "asset_dedup", "asset_req_width", "video_source", "member_groups", "category_closure",
    "module_closure", "html_tokens", "html_serialise", "clean_gallery", "redirect_admit", "catalogue_upsert", "error_first_rule",
    "attempt_outcome", "stall_sessions", "variant_fanout", "entry_stats",
]


def main() -> None:
    folder = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = int(os.environ.get("BENCH_CPUS", os.cpu_count() or 4))
    spark = build_session(f"local[{cpus}]", cpus, spark__ui__enabled="false", spark__ui__showConsoleProgress="false", spark__driver__memory="6g")
    spark.sparkContext.setLogLevel("ERROR")
    found = registry()

    def run(name: str) -> float:
        start = time.perf_counter()
        found[name].build(spark, folder).write.format("noop").mode("overwrite").save()
        return time.perf_counter() - start

    run("link_fanin")  # starts executors and the JIT; not counted
    # building a query is part of its time: closures and ranks run jobs while they are built
    seconds = {name: round(min(run(name), run(name)), 3) for name in HEADLINE}
    spark.stop()
    print(json.dumps({
        "metric": "headline_queries_total", "value": round(sum(seconds.values()), 3), "unit": "sec", "queries": seconds,
        "sf": os.path.basename(folder.rstrip("/")).removeprefix("sf"),
    }))


if __name__ == "__main__":
    main()
