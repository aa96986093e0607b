"""Command line: plan a workload, or serve a plan.

    python -m tidepane plan WORKLOAD.json PLAN.json [--no-raw-data] [--no-query-results] [--ignore-accuracy-guarantees]
    python -m tidepane serve PLAN.json FOLDER [--port N] [--complete-from-ms N] [--lateness-ms N] [--raw PARQUET] [--forward URL]
"""

from __future__ import annotations

import argparse
import json
import sys

from tidepane.plans.plan import Plan, PlanError
from tidepane.plans.planner import Capabilities, Settings, Workload, plan


def parser() -> argparse.ArgumentParser:
    out = argparse.ArgumentParser(prog="tidepane")
    commands = out.add_subparsers(dest="command", required=True)
    p = commands.add_parser("plan")
    p.add_argument("workload")
    p.add_argument("plan")
    p.add_argument("--no-raw-data", action="store_true")
    p.add_argument("--no-query-results", action="store_true")
    p.add_argument("--ignore-accuracy-guarantees", action="store_true")
    s = commands.add_parser("serve")
    s.add_argument("plan")
    s.add_argument("folder")
    s.add_argument("--port", type=int, default=9090)
    s.add_argument("--complete-from-ms", type=int)
    s.add_argument("--lateness-ms", type=int, default=15_000)
    s.add_argument("--raw", help="Parquet folder of the sample table with the retained raw samples")
    s.add_argument("--forward", help="server that answers what the plan does not")
    return out


def main(arguments: list[str] | None = None) -> int:
    args = parser().parse_args(arguments)
    if args.command == "plan":
        try:
            with open(args.workload, encoding="utf-8") as f:
                workload = Workload.from_dict(json.load(f))
            made = plan(workload, Capabilities(None, not args.no_raw_data, not args.no_query_results), Settings(args.ignore_accuracy_guarantees))
        except PlanError as e:
            print(e, file=sys.stderr)
            return 1
        made.save(args.plan)
        print(f"{len(made.queries)} queries, {len(made.stored)} stored summaries, accepted without guarantee: {made.accepted_without_guarantee}")
        return 0
    from tidepane.engine import Engine
    from tidepane.http_api import forwarder, server
    from tidepane.session import build_session
    from tidepane.streaming.ingest import Options

    spark = build_session()
    raw = (lambda: spark.read.parquet(args.raw)) if args.raw else None
    engine = Engine(spark, Plan.load(args.plan), args.folder, Options(args.lateness_ms, complete_from_ms=args.complete_from_ms), raw, forwarder(args.forward) if args.forward else None)
    server(engine, args.port).serve_forever()
    return 0


if __name__ == "__main__":
    sys.exit(main())
