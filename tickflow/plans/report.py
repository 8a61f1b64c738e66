"""Plan report: the physical-plan features of every registered query, as a markdown table.

    python -m tickflow.plans.report [sf_dir] > PLANS.md

Reads the ``explain("formatted")`` text of each query (stream queries excluded: they execute)
and counts the nodes that matter at scale: shuffles, aggregate strategy, joins, top-N limits,
generators, scans with their pushed filters.
"""

from __future__ import annotations

import re
import sys
from collections import Counter

from tickflow.plans.inspect import plan_text

_NODES = (
    "Exchange",
    "BroadcastExchange",
    "HashAggregate",
    "ObjectHashAggregate",
    "SortAggregate",
    "BroadcastHashJoin",
    "SortMergeJoin",
    "ShuffledHashJoin",
    "BroadcastNestedLoopJoin",
    "CartesianProduct",
    "WindowGroupLimit",
    "Window",
    "Generate",
    "Sort",
    "Scan parquet",
    "BatchEvalPython",
    "ArrowEvalPython",
)


def features(text: str) -> dict:
    header = text.split("\n\n", 1)[0]
    c = Counter()
    by_length = sorted(_NODES, key=len, reverse=True)
    for line in header.splitlines():
        name = re.sub(r"^[\s:+\-*|]*", "", line).split(" (")[0].strip()
        for node in by_length:
            if name == node or name.startswith(node + " "):
                c[node] += 1
                break
    pushed = sorted(
        {m.strip() for m in re.findall(r"PushedFilters: \[([^\]]*)\]", text) if m.strip()}
    )
    cols = [len(m.split(",")) for m in re.findall(r"ReadSchema: struct<([^>]*)>", text)]
    return {"nodes": c, "pushed": pushed, "read_cols": cols}


def report(spark, sf_dir: str) -> str:
    from tickflow.catalog import QUERIES

    rows = [
        "| query | shuffles | aggregates | joins | top-N / window | generators | scans (columns read) | pushed filters |",
        "| --- | --- | --- | --- | --- | --- | --- | --- |",
    ]
    for name, fn in sorted(QUERIES.items()):
        if name.startswith("stream_"):
            continue
        f = features(plan_text(fn(spark, sf_dir), "formatted"))
        n = f["nodes"]
        aggs = ", ".join(
            f"{k} x{n[k]}" for k in ("HashAggregate", "ObjectHashAggregate", "SortAggregate") if n[k]
        )
        joins = ", ".join(
            f"{k} x{n[k]}"
            for k in ("BroadcastHashJoin", "SortMergeJoin", "ShuffledHashJoin",
                      "BroadcastNestedLoopJoin", "CartesianProduct")
            if n[k]
        )
        win = ", ".join(f"{k} x{n[k]}" for k in ("WindowGroupLimit", "Window") if n[k])
        pushed = "; ".join(p[:80] for p in f["pushed"][:2])
        rows.append(
            f"| {name} | {n['Exchange']} (+{n['BroadcastExchange']} broadcast) | {aggs or '-'} | "
            f"{joins or '-'} | {win or '-'} | {n['Generate'] or '-'} | "
            f"{n['Scan parquet']} ({', '.join(map(str, f['read_cols']))}) | {pushed or '-'} |"
        )
    return "\n".join(rows)


def main(argv=None) -> None:
    from tickflow.plans.session import build_session

    argv = argv if argv is not None else sys.argv[1:]
    sf_dir = argv[0] if argv else "/root/testdata/sf0.01"
    spark = build_session("local[4]", app="tickflow-plans", shuffle_partitions=8)
    print("# Physical plans of the registered queries\n")
    print(f"Generated by `python -m tickflow.plans.report {sf_dir}` (plans before adaptive")
    print("re-planning; AQE may still turn a sort-merge join into a broadcast join at run time).\n")
    print(report(spark, sf_dir))
    spark.stop()


if __name__ == "__main__":
    main()
