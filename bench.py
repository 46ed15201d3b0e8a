"""Headline timings: prints one JSON line with the wall seconds of each query."""

from __future__ import annotations

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from echoloom import catalog  # noqa: E402
from echoloom.session import build_session  # noqa: E402

HEADLINE = [
    "flagship_false_alarms_per_class", "d8_full_detector", "d4_need_of_span_policies", "d12_policy_threshold_sweep",
    "d13_wake_sessions", "d10_streaming_detector", "m2_threshold_grid_fine", "m3_threshold_at_fpr_budget",
    "m6_auc_tie_averaged", "m8_score_percentiles", "m11_pooled_content_recipe", "m20_streaming_recall_by_snr",
    "k1_top_by_score", "k11_hardest_negatives_in_batch", "g1_weighted_bucket_draw", "g3_class_uniform_clip_draw",
    "g14_stratified_split", "g15_shuffled_split", "j6_samples_with_noise_layers", "a5_mix_at_snr",
    "a11_babble_live", "w1_hop_windows_inclusive", "a31_log_mel_features", "m24_offset_stress",
    "h5_deployed_misses", "h6_fine_tune_set", "h9_corpus_plan", "h9_corpus_build", "h9_corpus_features",
]


def main() -> None:
    sf = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = build_session("bench", f"local[{cpus}]", **{
        "spark.sql.shuffle.partitions": cpus, "spark.ui.enabled": "false", "spark.driver.memory": "16g",
        "spark.ui.showConsoleProgress": "false"})
    spark.sparkContext.setLogLevel("ERROR")
    all_queries = catalog.queries()
    all_queries["m1_confusion_at_threshold"](spark, sf).collect()          # start-up is not timed
    seconds = {}
    for name in os.environ.get("BENCH_QUERIES", ",".join(HEADLINE)).split(","):
        t = time.perf_counter()
        all_queries[name](spark, sf).write.format("noop").mode("overwrite").save()
        seconds[name] = round(time.perf_counter() - t, 3)
    clips = spark.read.parquet(f"{sf}/documents.parquet").count()          # one one-second sample each
    print(json.dumps({
        "metric": "total wall time of headline queries", "value": round(sum(seconds.values()), 3), "unit": "sec",
        "queries": seconds, "sf": os.path.basename(sf.rstrip("/")),
        "corpus_samples_per_sec": round(clips / seconds["h9_corpus_features"], 1) if "h9_corpus_features" in seconds else None}))


if __name__ == "__main__":
    main()
