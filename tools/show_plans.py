"""Run headline queries and summarise their final (adaptive) physical plans: shuffles,
broadcasts, join strategies, windows, Python nodes and Parquet read schemas.

    python tools/show_plans.py [--sf DIR] > PLANS.md
"""

from __future__ import annotations

import argparse
import os
import re
import sys

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from foldwise.plans import all_queries  # noqa: E402
from foldwise.session import local_session  # noqa: E402

KEYS = ["flagship_oof_target_encoding", "oof_group_mean", "assemble_feature_frame", "stratified_folds",
        "holdout_temporal", "profile_numeric", "profile_quantiles", "profile_top_values", "assoc_cramers_v",
        "single_feature_auc", "metrics_by_fold", "temporal_oot_stability", "bootstrap_stability",
        "score_decile_stability", "parity_rank_mismatch", "scan_parquet", "raw_feature_frame"]


def final_plan(df) -> str:
    df.write.format("noop").mode("overwrite").save()
    return df._jdf.queryExecution().executedPlan().toString()


def main():
    ap = argparse.ArgumentParser()
    ap.add_argument("--sf", default="/root/testdata/sf0.1")
    args = ap.parse_args()
    spark = local_session(8, 16, app="foldwise-plans")
    qs = all_queries()
    print(f"Final adaptive plans at `{args.sf}` (local[8], 16 shuffle partitions). Counts are operators "
          "in the executed plan of the query's last job; materialized inputs (the prepared split, "
          "histograms) were written by earlier jobs of the same query.\n")
    print("| query | shuffles | broadcasts | BHJ | SMJ | windows | python | scans: ReadSchema |")
    print("|---|---|---|---|---|---|---|---|")
    for k in KEYS:
        p = final_plan(qs[k](spark, args.sf))
        shuffles = len(re.findall(r"\bExchange (hashpartitioning|rangepartitioning|SinglePartition|RoundRobin)", p)) + \
            len(re.findall(r"ShuffleQueryStage", p))
        bcast = len(re.findall(r"BroadcastExchange|BroadcastQueryStage", p))
        bhj = p.count("BroadcastHashJoin")
        smj = p.count("SortMergeJoin")
        win = len(re.findall(r"\bWindow\b", p))
        py = len(re.findall(r"MapInPandas|FlatMapGroupsInPandas|ArrowEvalPython|BatchEvalPython", p))
        schemas = sorted(set(re.findall(r"ReadSchema: (struct<[^>]*>)", p)))
        print(f"| {k} | {shuffles} | {bcast} | {bhj} | {smj} | {win} | {py} | {'; '.join(schemas)[:300]} |")
    spark.stop()


if __name__ == "__main__":
    main()
