"""Command line over area tables: list, inspect, export, history, plan."""

from __future__ import annotations

import argparse
import json

from .plans import delivery, history, stages
from .sources import areas


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="cellweave", description=__doc__)
    sub = p.add_subparsers(dest="command", required=True)
    for name in ("list", "inspect", "export", "history"):
        s = sub.add_parser(name)
        s.add_argument("root")
        if name != "list":
            s.add_argument("area")
            s.add_argument("--resolution", type=int)
        if name in ("export", "history"):
            s.add_argument("output")
        if name == "history":
            s.add_argument("start")
            s.add_argument("end")
            s.add_argument("--precision", choices=("annual", "daily", "composite"), default="daily")
    s = sub.add_parser("plan")
    s.add_argument("stages", help="JSON file: stage to its dependencies")
    s.add_argument("--only", nargs="*")
    s.add_argument("--skip", nargs="*", default=[])
    return p


def main(argv: list[str] | None = None) -> int:
    a = parser().parse_args(argv)
    if a.command == "list":
        print("\n".join(areas.list_areas(a.root)))
        return 0
    if a.command == "plan":
        with open(a.stages) as f:
            print("\n".join(stages.plan(json.load(f), a.only, a.skip)))
        return 0
    from pyspark.sql import SparkSession

    spark = SparkSession.builder.appName("cellweave").getOrCreate()
    df = areas.read_area(spark, a.root, a.area, a.resolution, dynamic=a.command == "history")
    if a.command == "inspect":
        print(json.dumps(delivery.manifest(df, [a.area]), indent=1))
    elif a.command == "export":
        delivery.public_metrics(df, areas.KEYS).write.parquet(a.output)
    else:
        history.select_history(df, a.start, a.end, a.precision).write.parquet(a.output)
    return 0


if __name__ == "__main__":
    raise SystemExit(main())
