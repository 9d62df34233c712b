"""Command line: extract, segment, detect, aggregate, tiles, serve."""

from __future__ import annotations

import argparse
import getpass
import json
import os
import shlex
import sys
from collections.abc import Sequence
from datetime import date
from pathlib import Path

from driftline import config, logs, session
from driftline.plans import pipeline, server
from driftline.sources.login import Tokens
from driftline.sources.remote import JdbcStates, StateSource, TableStates


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="driftline")
    p.add_argument("--config", type=Path)
    sub = p.add_subparsers(dest="command", required=True)
    for name in ("extract", "segment", "detect", "aggregate", "tiles", "serve"):
        c = sub.add_parser(name)
        if name not in ("tiles", "serve"):
            c.add_argument("--date", type=date.fromisoformat)
            c.add_argument("--from-date", type=date.fromisoformat)
            c.add_argument("--to-date", type=date.fromisoformat)
            c.add_argument("--force", action="store_true")
        if name == "extract":
            c.add_argument("--table", required=True, help="Parquet path, or table name behind --jdbc-url")
            c.add_argument("--jdbc-url")
            c.add_argument("--token-url", help="where access tokens come from; the password is read from $DRIFTLINE_PASSWORD or asked for")
            c.add_argument("--client-id", default="driftline")
            c.add_argument("--user")
            c.add_argument("--token-cache", type=Path, default=Path(".driftline-tokens.json"))
        if name == "detect":
            c.add_argument("--filter-profile")
            c.add_argument("--list-profiles", action="store_true")
            c.add_argument("--stats", action="store_true")
        if name in ("aggregate", "tiles"):
            c.add_argument("--resolutions", type=int, nargs="+")
        if name == "tiles":
            c.add_argument("--min-segments", type=int, default=1)
            c.add_argument("--build", action="store_true", help="run the tile builder")
        if name == "serve":
            c.add_argument("--host", default="127.0.0.1")
            c.add_argument("--port", type=int, default=8000)
    return p


def chosen_days(a: argparse.Namespace) -> list[date]:
    """One date, or both ends of a range; anything else is an error."""
    if a.date and not (a.from_date or a.to_date):
        return [a.date]
    if a.from_date and a.to_date and not a.date:
        return pipeline.days(a.from_date, a.to_date)
    raise SystemExit("give either --date or both --from-date and --to-date")


def tokens(a: argparse.Namespace) -> Tokens | None:
    """Access tokens for the remote service, if a login is asked for."""
    if not a.token_url:
        return None
    password = lambda: os.environ.get("DRIFTLINE_PASSWORD") or getpass.getpass(f"password of {a.user}: ")
    return Tokens(a.token_url, a.client_id, a.user or getpass.getuser(), password, a.token_cache)


def main(argv: Sequence[str] | None = None) -> int:
    a = parser().parse_args(argv)
    if a.config and not a.config.exists():
        print(f"no such file: {a.config}", file=sys.stderr)
        return 1
    settings = config.load(a.config) if a.config else config.Config()
    if a.command == "detect" and a.list_profiles:
        for name, p in settings.profiles.items():
            print(f"{name}: confidence >= {p.min_confidence}, duration >= {p.min_duration_s} s")
        return 0
    logs.configure()
    when = chosen_days(a) if a.command not in ("tiles", "serve") else []
    store = pipeline.Store(session.build(**settings.spark), settings)
    if a.command == "extract":
        source: StateSource = JdbcStates(a.jdbc_url, a.table, token=tokens(a)) if a.jdbc_url else TableStates(a.table)
        print(*pipeline.extract(store, source, when, a.force))
    elif a.command == "segment":
        print(*pipeline.segment(store, when, a.force))
    elif a.command == "detect":
        print(*pipeline.detect(store, when, a.filter_profile, a.force))
        if a.stats:
            print(json.dumps(pipeline.summary(store, when).first().asDict()))
    elif a.command == "aggregate":
        if failed := pipeline.aggregate(store, when, a.resolutions, a.force):
            print("incident metrics failed at", *failed, file=sys.stderr)
            return 1
    elif a.command == "tiles":
        try:
            for command in pipeline.tiles(store, a.resolutions, a.min_segments, a.build):
                print(shlex.join(command))
        except RuntimeError as e:
            print(e, file=sys.stderr)
            return 1
    else:
        server.serve(store, a.host, a.port)
    return 0


if __name__ == "__main__":
    sys.exit(main())
