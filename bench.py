"""Headline queries at $BENCH_SF_DIR on local[$BENCH_CPUS]; prints one JSON line."""

import json
import os
import time

from palimpsest.registry.queries import QUERIES
from palimpsest.session import local_session
from palimpsest.sources.derived import ChangeLog

HEADLINES = (
    "A1_change_type_distribution", "A2_distribution_per_user_type", "A3_change_types_overtime", "A4_share_by_user_type",
    "A5_soft_vs_hard_deletions", "A7_time_until_reversion", "A8_hash_matched_reversions", "A9_oscillations", "A10_general_counts",
    "A12_entity_histograms", "A13_quantity_unrefinement", "A14_time_refinement", "A17_longitude_conversions",
    "A23_latest_start_insertions", "A25_dead_link_changes", "T1_T19_text_features", "T12_T14_edit_operations", "T21_cosine_similarity",
    "TM1_TM10_time_features", "Q1_Q10_quantity_features", "C1_C8_geo_features", "E1_E12_entity_features", "R1_R12_reverted_features",
    "J3_reversion_pairs", "J16_time_to_neighbour", "W6_same_user_last_24h", "PR1_PR7_pair_features", "V1_label_metrics",
)


def timed(fn) -> float:
    start = time.perf_counter()
    fn()
    return round(time.perf_counter() - start, 3)


def main() -> None:
    folder = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cores = int(os.environ.get("BENCH_CPUS", "8"))
    spark = local_session(cores, partitions=cores, app="bench")
    spark.sparkContext.setLogLevel("OFF")
    log = ChangeLog(spark, folder)
    log.revision.count()  # starts the executor threads
    times = {"derive_value_change": timed(lambda: log.value_change), "derive_edits": timed(lambda: log.edits)}
    for name in HEADLINES:
        times[name] = timed(lambda: QUERIES[name](spark, folder).write.format("noop").mode("overwrite").save())
    spark.stop()
    print(json.dumps({"metric": "total_seconds", "value": round(sum(times.values()), 3), "unit": "sec", "queries": times,
                      "sf": os.path.basename(folder.rstrip("/")).removeprefix("sf")}))


if __name__ == "__main__":
    main()
