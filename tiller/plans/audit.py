"""Plan audit: one line per registered query with the shape of its final
physical plan (shuffles, reused shuffles, broadcasts, windows, Python
stages, scans and their widest column list).

``python -m tiller.plans.audit [sf_dir]`` runs every query once (inside the
JVM, nothing is collected) so that adaptive execution has settled its
decisions, then prints a markdown table from Spark's final plans.
"""

from __future__ import annotations

import re
import sys

from pyspark.sql import DataFrame


def plan_text(df: DataFrame, execute: bool = False) -> str:
    qe = df._jdf.queryExecution()
    if execute:
        qe.toRdd().count()
    text = qe.executedPlan().toString()
    # a finished adaptive plan prints the final plan, then the initial one
    return text.split("== Initial Plan ==")[0]


def shape(df: DataFrame, execute: bool = True) -> dict:
    p = plan_text(df, execute)
    scans = re.findall(r"FileScan parquet [^\[]*\[([^\]]*)\]", p) or re.findall(
        r"ReadSchema: struct<([^>]*)>", p)
    return {
        "hash_shuffles": len(re.findall(r"Exchange hashpartitioning", p)),
        "range_shuffles": len(re.findall(r"Exchange rangepartitioning", p)),
        "single_partition": len(re.findall(r"Exchange SinglePartition", p)),
        "reused": len(re.findall(r"ReusedExchange", p)),
        "broadcasts": len(re.findall(r"BroadcastExchange", p)),
        "windows": len(re.findall(r"\bWindow \[", p)),
        "python": bool(re.search(r"MapInPandas|ArrowEvalPython|BatchEvalPython", p)),
        "scans": len(re.findall(r"FileScan parquet", p)),
        "max_scan_cols": max((len(s.split(",")) for s in scans), default=0),
    }


def table(spark, sf_dir: str) -> str:
    from tiller.plans import register

    head = ("| query | hash shuffles | range shuffles | single-partition | reused | broadcasts "
            "| windows | python | scans | widest scan (cols) |")
    lines = [head, "|" + " --- |" * 10]
    for name in sorted(register.SPARK):
        s = shape(register.SPARK[name](spark, sf_dir))
        lines.append(f"| {name} | {s['hash_shuffles']} | {s['range_shuffles']} | "
                     f"{s['single_partition']} | {s['reused']} | {s['broadcasts']} | {s['windows']} | "
                     f"{'yes' if s['python'] else ''} | {s['scans']} | {s['max_scan_cols']} |")
    return "\n".join(lines)


if __name__ == "__main__":
    from tiller.session import local_session

    sf = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.1"
    print(table(local_session(8), sf))
