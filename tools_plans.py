"""Summarize the final (AQE) physical plans of the eight analyses, the stages they write included.

Every query execution of an analysis - each materialized stage and the final query - is listed
with its scans and columns, exchanges, joins and window limits, read from the final plan only.
Writes markdown to stdout.

Usage: python tools_plans.py [sf_dir]
"""

from __future__ import annotations

import re
import sys
from collections import Counter


def final_part(text: str) -> str:
    """The final plan of an adaptive plan's text (which goes on with the initial plan)."""
    kept, skip = [], None
    for line in text.split("\n"):
        depth = len(line) - len(line.lstrip(" :+-"))
        if "== Initial Plan ==" in line:
            skip = depth
            continue
        if skip is not None and depth >= skip:
            continue
        skip = None
        kept.append(line)
    return "\n".join(kept)


def summarize(text: str) -> dict:
    scans, exchanges, joins, other = [], Counter(), Counter(), Counter()
    for line in final_part(text).split("\n"):
        s = re.sub(r"#\d+L?", "", line.strip().lstrip(":+- *()0123456789"))
        if s.startswith("FileScan parquet"):
            cols = re.search(r"FileScan parquet \[([^\]]*)\]", s).group(1)
            where = re.search(r"Location: \w+\(\d+ paths?\)\[([^\]]*)", s)
            loc = where.group(1) if where else ""
            stage = re.search(r"custseg-([a-z]+)", loc)
            src = loc.rsplit("/", 1)[-1] if "/testdata/" in loc else (
                f"stage {stage[1]}" if stage else "stage")
            scans.append(f"{src} [{cols}]")
        elif s.startswith("Exchange"):
            exchanges[s.split()[1].split("(")[0].rstrip(",")] += 1
        elif s.startswith("BroadcastExchange"):
            exchanges["broadcast"] += 1
        elif "Join" in s.split(" ")[0]:
            kind = next((w for w in re.split(r"[ ,]+", s) if w in
                         ("Inner", "LeftOuter", "Cross", "LeftSemi", "LeftAnti")), "")
            joins[f"{s.split()[0]} {kind}".strip()] += 1
        elif s.startswith("WindowGroupLimit"):
            other["WindowGroupLimit " + s.rstrip().split(",")[-1].strip()] += 1
        elif s.startswith("Window "):
            other["Window"] += 1
        elif s.startswith("ReusedExchange"):
            other["ReusedExchange"] += 1
    return {"scans": scans, "exchanges": exchanges, "joins": joins, "other": other}


def report(title: str, text: str) -> None:
    s = summarize(text)
    print(f"* {title}: scans " + ("; ".join(sorted(set(s["scans"]))) or "none"))
    for name in ("exchanges", "joins", "other"):
        if s[name]:
            print(f"  * {name}: " + ", ".join(f"{k} x{v}" for k, v in sorted(s[name].items())))


def main() -> None:
    sf = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.1"
    sys.path.insert(0, ".")
    from custseg import session
    from custseg.plans import registry
    from custseg.session import local_session
    spark = local_session(8, 16)
    registry.FRESH = True
    written: list[tuple[str, str]] = []
    save = session.materialize

    def materialize(df, name="stage", kept=None):
        # the adaptive plan of the write itself is not reachable from the frame, so the stage's
        # plan is taken from a run of the same frame
        df.write.format("noop").mode("overwrite").save()
        df.collect()
        written.append((name, df._jdf.queryExecution().executedPlan().toString()))
        return save(df, name, kept)

    from custseg.operators import ranks
    from custseg.plans import analysis
    for module in (session, ranks, analysis):
        module.materialize = materialize
    print(f"# Physical plans of the eight analyses ({sf.rsplit('/', 1)[-1]})\n")
    print("Generated by `python tools_plans.py`: the final adaptive plans of every stage that an "
          "analysis writes, then of its last query. SinglePartition exchanges carry partial "
          "results of one-row aggregates, one row per persona, or one row per partition. Joins "
          "that are broadcasts here are sort-merge joins once the measured side exceeds the "
          "broadcast threshold. The exchange of a scalar subquery is counted at every place that "
          "names the subquery, though it runs once.\n")
    for label, name in registry.HEADLINE.items():
        written.clear()
        df = registry.queries()[name](spark, sf)
        df.collect()
        print(f"## {label}\n")
        for stage, text in written:
            report(f"stage {stage}", text)
        report("result", df._jdf.queryExecution().executedPlan().toString())
        print()


if __name__ == "__main__":
    main()
