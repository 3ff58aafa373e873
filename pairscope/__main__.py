"""``python -m pairscope list`` names the stages; ``python -m pairscope run STAGE --data DIR --runs DIR`` runs one, after those it needs have run there."""

from __future__ import annotations

import argparse
import json
from pathlib import Path

from pairscope.plans.stages import PLAN, registry
from pairscope.session import build_session


def main(argv: list[str] | None = None) -> int:
    parser = argparse.ArgumentParser(prog="pairscope")
    commands = parser.add_subparsers(dest="command", required=True)
    commands.add_parser("list")
    run = commands.add_parser("run")
    run.add_argument("stage", choices=[*PLAN, "all"])
    run.add_argument("--data", required=True, help="directory of the source tables")
    run.add_argument("--runs", required=True, help="directory of the runs; one folder a stage")
    run.add_argument("--tables", help="shared folder for tables; needed on a cluster")
    run.add_argument("--repetitions", type=int, default=2_000)
    run.add_argument("--master", help="Spark master; a session's own setting else")
    run.add_argument("--dry-run", action="store_true", help="write the workspace and stop")
    args = parser.parse_args(argv)
    if args.command == "list":
        print("\n".join(f"{name}: {', '.join(needs) or '-'}" for name, (_, needs) in PLAN.items()))
        return 0
    spark = build_session("pairscope", args.master)
    stages = registry(spark, args.data, args.tables, args.repetitions)
    root = Path(args.runs)
    for name in PLAN if args.stage == "all" else [args.stage]:
        result = stages.run(name, root / name, {"data": args.data, "repetitions": args.repetitions}, {n: root / n for n in PLAN[name][1]}, [root], not args.dry_run)
        print(json.dumps({"stage": name, **result}))
    return 0


if __name__ == "__main__":
    raise SystemExit(main())
