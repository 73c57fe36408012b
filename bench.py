"""Time the headline queries at $BENCH_SF_DIR on local[$BENCH_CPUS]; prints one JSON line."""

from __future__ import annotations

import json
import os
import time

from chainweave.catalog import QUERIES
from chainweave.session import local_session, scratch

# bfs_search, solve_regions and window_tiers are left out: over 150,000 regions they take longer than all others together
HEADLINE = (
    "paf_orient_identity", "paf_quantise", "buried_alignments", "breakpoints", "breakpoints_filtered", "window_discovery",
    "merge_intervals", "merge_members", "cluster_topk", "slop_clamped", "slop_share", "enlarge_by_factor", "split_windows",
    "intersect_clip", "anti_overlap_fraction", "subtract_intervals", "reciprocal_merge_round", "reciprocal_merge_fixpoint",
    "union_tiers", "neighbour_pairs", "pair_top1_ties", "chain_merge", "grid_dedupe", "grid_pivot", "grid_flip",
    "sv_opportunities", "apply_moves", "score_dp", "mutation_explode", "source_winner", "dominance_fold", "vcf_genotypes",
    "vcf_records", "absolute_steps", "sequence_lengths", "extract_subseq", "shred_sequences", "correct_chunks",
    "reverse_complement", "annotation_overlap", "dotplot_aggregates", "window_summary", "grid_clutter", "grid_unpivot", "estimated_score",
    "symmetry", "rasterise", "gridlines_fixpoint", "probe_liftover", "liftover_regions", "search_one_step",
)


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = local_session(cpus, shuffle_partitions=int(cpus) if cpus.isdigit() else 8)
    spark.sparkContext.setLogLevel("ERROR")
    spark.read.parquet(f"{sf_dir}/lineitem.parquet").count()
    seconds = {}
    for name in HEADLINE:
        start = time.time()
        with scratch(spark):
            # the noop sink computes every column of every row and keeps nothing
            QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
        seconds[name] = round(time.time() - start, 3)
    print(
        json.dumps(
            {
                "metric": "total_query_seconds", "value": round(sum(seconds.values()), 3), "unit": "sec",
                "queries": seconds, "sf": os.path.basename(sf_dir.rstrip("/")),
            }
        )
    )
    spark.stop()


if __name__ == "__main__":
    main()
