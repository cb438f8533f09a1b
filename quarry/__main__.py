"""python -m quarry COMMAND ...

  index STATE CONNECTION ADDRESS [--manifest=F] [--freshness=F] [--profiles=no]
  reindex STATE CONNECTION ADDRESS [--dry-run] [--full]
  list STATE | remove STATE CONNECTION | validate STATE CONNECTION
  export STATE CONNECTION FILE | sync-grants STATE CONNECTION [--roles=a,b] [--dry-run]
  metric STATE CONNECTION NAME | page STATE CONNECTION PAGE
  ask STATE CONNECTION TOOL [--name=value ...]
  TOOL ADDRESS [--name=value ...]           one answer about a source that is not indexed

ADDRESS is a folder of Parquet tables, postgresql://..., snowflake://... or bigquery://...;
QUARRY_PROFILE names the visibility profile that answers respect. Answers are JSON.
"""

from __future__ import annotations

import os
import sys

from pyspark.sql import SparkSession

from quarry import config, lifecycle, tools
from quarry.operators.visibility import Profile
from quarry.sources import catalog, files

PAGES = {"overview": tools.overview, "clusters": tools.clusters_page, "metrics": tools.metrics_page, "skill": tools.skill_page}


def _options(args: list[str]) -> tuple[list[str], dict[str, str]]:
    plain = [a for a in args if not a.startswith("--")]
    return plain, dict((a.removeprefix("--").split("=", 1) if "=" in a else (a.removeprefix("--"), "yes")) for a in args if a.startswith("--"))


def profile_of(document: dict, name: str | None) -> Profile:
    """The visibility of a document: what holds for all, and the named profile's own."""
    fields = [f for f in Profile.__dataclass_fields__ if f != "more"]
    made = lambda d: Profile(**{f: tuple(d.get(f) or ()) for f in fields}, more={k: v for k, v in d.items() if k not in (*fields, "profiles")})
    base = made(document)
    profiles = document.get("profiles") or {}
    if name is not None and name not in profiles:
        raise KeyError(f"no visibility profile {name!r}; known: {', '.join(sorted(profiles))}")
    return base if name is None else base.merged(made(profiles[name]))


def _valued(given: dict[str, str]) -> dict:
    return {k.replace("-", "_"): int(v) if v.isdigit() else v for k, v in given.items()}


def run(spark: SparkSession, args: list[str]) -> tuple[str, int]:
    """(what is printed, the exit code)."""
    command, (plain, given) = args[0], _options(args[1:])
    told = lambda x: (tools.to_json(x), int(isinstance(x, dict) and "error" in x))
    if command in tools.TOOLS or command in PAGES and len(plain) == 1:
        w = tools.Workspace(spark, given.pop("connection", "main"), catalog.source_at(spark, plain[0]))
        return (PAGES[command](w), 0) if command in PAGES else told(tools.call(w, command, **_valued(given)))
    state = lifecycle.State(spark, plain[0])
    chosen = lambda: profile_of(state.visibility(), os.environ.get("QUARRY_PROFILE"))
    if command == "index":
        return told(lifecycle.index(state, catalog.source_at(spark, plain[2]), plain[1], given.get("database", ""), manifest=given.get("manifest"), freshness=given.get("freshness"), profiles=given.get("profiles") != "no"))
    if command == "reindex":
        return told(lifecycle.reindex(state, catalog.source_at(spark, plain[2]), plain[1], dry_run="dry-run" in given, full="full" in given))
    if command == "list":
        return told(dict(state.registry().list()))
    if command == "remove":
        return told({"removed": lifecycle.remove(state, plain[1])})
    if command == "validate":
        found = lifecycle.validate(state, plain[1])
        return tools.to_json({"problems": found}), int(bool(found))
    if command == "export":
        rows = lifecycle.export(state, plain[1])
        files.write_text(spark, plain[2], "\n".join(r.json for r in rows.toLocalIterator()) + "\n") if plain[2].endswith(".jsonl") else rows.write.mode("overwrite").json(plain[2])
        return told({"written": plain[2]})
    if command == "sync-grants":
        return told(lifecycle.sync_grants(state, plain[1], set(given["roles"].split(",")) if "roles" in given else None, "dry-run" in given))
    w = tools.Workspace.stored(state, plain[1], chosen())
    if command == "metric":
        return told(tools.compile_metric(w, plain[2]))
    if command == "page":
        return PAGES[plain[2]](w), 0
    return told(tools.call(w, plain[2], **_valued(given)))


#: how many plain arguments each command takes
COMMANDS = {"index": 3, "reindex": 3, "list": 1, "remove": 2, "validate": 2, "export": 3, "sync-grants": 2, "metric": 3, "page": 3, "ask": 3}


def main(args: list[str]) -> int:
    more = config.plugins()
    if args and args[0] in more:
        return int(more[args[0]](args[1:]) or 0)
    plain = _options(args[1:])[0] if args else []
    if not args or COMMANDS.get(args[0], 1 if args[0] in (*tools.TOOLS, *PAGES) else -1) != len(plain):
        print(f"{__doc__}\ntools: {', '.join(sorted(tools.TOOLS))}; pages: {', '.join(PAGES)}", file=sys.stderr)
        return 2
    spark = SparkSession.builder.appName("quarry").getOrCreate()
    try:
        text, code = run(spark, args)
    except (KeyError, ValueError, FileNotFoundError) as e:
        text, code = tools.to_json({"error": str(e.args[0] if e.args else e)}), 1
    print(text)
    return code


if __name__ == "__main__":
    sys.exit(main(sys.argv[1:]))
