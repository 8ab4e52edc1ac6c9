"""Headline queries at $BENCH_SF_DIR on local[$BENCH_CPUS]; prints one JSON line."""

from __future__ import annotations

import json
import os
import sys
import time

from stratanet import catalog
from stratanet.session import local_session

HEADLINE = (
    "m1_pearson_pairs",
    "m1_pearson_suppliers",
    "m2_spearman_suppliers",
    "m7_shrinkage_pairs",
    "g13_degree",
    "h13_network_summary",
    "w2_window_pairs",
    "w2_window_networks",
    "w3_multiplex_evolution",
    "f2_ns_fit",
    "f4_decay_search",
    "f14_two_step_factors",
    "f20_likelihood_choice",
    "w9_factor_evolution",
    "w13_issuer_stress",
    "r3_full_summary",
    "r11_compare_models",
    "c6_all_methods",
)


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    wanted = sys.argv[1:] or HEADLINE
    spark = local_session(cpus, partitions=int(cpus) if cpus.isdigit() else 8)
    queries = catalog.queries()
    # Start the Python workers and the file reader before the clock runs.
    queries["m1_pearson_pairs"](spark, sf_dir).write.format("noop").mode("overwrite").save()
    times: dict[str, float] = {}
    for name in wanted:
        spark.catalog.clearCache()
        start = time.time()
        queries[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
        times[name] = round(time.time() - start, 3)
        print(f"{name} {times[name]}", file=sys.stderr, flush=True)
    print(
        json.dumps(
            {
                "metric": "headline queries, total wall time",
                "value": round(sum(times.values()), 3),
                "unit": "sec",
                "queries": times,
                "sf": os.path.basename(sf_dir.rstrip("/")).removeprefix("sf"),
            }
        )
    )
    spark.stop()


if __name__ == "__main__":
    main()
