"""python -m historian_spark FOLDER COMMAND: info, days, retain, compact or clear a warehouse."""

from __future__ import annotations

import argparse
import json
from datetime import UTC, datetime

from pyspark.sql import SparkSession

from .sources.warehouse import TABLES, Warehouse


def main(argv: list[str] | None = None, spark: SparkSession | None = None) -> int:
    parser = argparse.ArgumentParser(prog="historian_spark", description=__doc__)
    parser.add_argument("folder")
    commands = parser.add_subparsers(dest="command", required=True)
    commands.add_parser("info", help="tables with rows, files and bytes")
    for name in ("days", "compact", "clear"):
        commands.add_parser(name).add_argument("table", choices=sorted(TABLES))
    keep = commands.add_parser("retain", help="drop whole days older than a period")
    keep.add_argument("table", choices=sorted(t for t, ts in TABLES.items() if ts))
    keep.add_argument("days", type=int)
    args = parser.parse_args(argv)
    house = Warehouse(spark or SparkSession.builder.getOrCreate(), args.folder)
    if args.command == "info":
        print(json.dumps(house.info()))
    elif args.command == "days":
        print(json.dumps(house.table(args.table).days()))
    elif args.command == "retain":
        print(json.dumps({"dropped": house.table(args.table).retain(args.days, datetime.now(UTC))}))
    else:
        getattr(house.table(args.table), args.command)()
    return 0


if __name__ == "__main__":
    raise SystemExit(main())
