"""Write ``explain("formatted")`` of registered queries to a scratch folder.

Usage: ``python tools/plans.py [sf_dir] [name ...]`` — prints the folder it wrote
(a fresh ``mktemp``-style directory under /tmp) and a one-line summary per
query: exchanges, broadcast / sort-merge joins, Python nodes.
"""

from __future__ import annotations

import os
import re
import sys
import tempfile

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))


def main():
    args = sys.argv[1:]
    sf_dir = args[0] if args and args[0].startswith("/") else "/root/testdata/sf0.01"
    names = [a for a in args if not a.startswith("/")]
    from tessera.plans.registry import all_queries
    from tessera.session import get_spark
    spark = get_spark("local[8]", 8)
    out = tempfile.mkdtemp(prefix="tessera-plans-")
    for name, q in all_queries().items():
        if names and name not in names:
            continue
        df = q.fn(spark, sf_dir)
        plan = df._jdf.queryExecution().explainString(
            spark._jvm.org.apache.spark.sql.execution.ExplainMode.fromString("formatted"))
        with open(os.path.join(out, f"{name}.txt"), "w") as fh:
            fh.write(plan)
        print(f"{name}: exchanges={len(re.findall(r'Exchange', plan))} "
              f"bhj={plan.count('BroadcastHashJoin')} smj={plan.count('SortMergeJoin')} "
              f"python={any(k in plan for k in ('ArrowEvalPython', 'MapInArrow', 'MapInPandas', 'FlatMapGroupsInPandas'))}")
    print(out)


if __name__ == "__main__":
    main()
