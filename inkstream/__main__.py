"""Command line: `python -m inkstream {queries,run,stats,probe} ...`."""

from __future__ import annotations

import argparse

from .plans import load_all
from .session import build_session


def main(argv: list[str] | None = None) -> int:
    parser = argparse.ArgumentParser(prog="inkstream")
    commands = parser.add_subparsers(dest="command", required=True)
    commands.add_parser("queries", help="list the registered queries")
    run = commands.add_parser("run", help="run a registered query and show its first rows")
    run.add_argument("name")
    run.add_argument("data")
    run.add_argument("--rows", type=int, default=20)
    stats = commands.add_parser("stats", help="row counts of the content tables")
    stats.add_argument("data")
    probe = commands.add_parser("probe", help="configuration candidates for fetched pages")
    probe.add_argument("data")
    args = parser.parse_args(argv)
    registered = load_all()
    if args.command == "queries":
        print("\n".join(sorted(registered)))
        return 0
    name = {"stats": "agg6_row_counts", "probe": "htm9_onb1_onb3_config_candidates"}.get(args.command) or args.name
    if name not in registered:
        parser.error(f"unknown query: {name}")
    registered[name].run(build_session(), args.data).show(getattr(args, "rows", 20), truncate=80)
    return 0


if __name__ == "__main__":
    raise SystemExit(main())
