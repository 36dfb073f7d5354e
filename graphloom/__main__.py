"""python -m graphloom graph|sync ..: build graph tables from snapshots, or synchronise the snapshots with their sources."""

from __future__ import annotations

import argparse
import json
import os
import sys
import time

from pyspark.sql import SparkSession

from graphloom import sync
from graphloom.plans import attack, capec, cve, cwe, defend
from graphloom.sources import bundles, sinks

SOURCES = sync.SOURCES


def graph_tables(spark: SparkSession, source: str, root: str, domains: list[str] | None = None) -> dict:
    """A source's tables; domains chooses among the adversary catalog's."""
    if source == "cve":
        return cve.tables(bundles.stored(spark, f"{root}/cve/records/*"))
    if source == "attack":
        return attack.tables(bundles.domains(spark, f"{root}/attack", [d for d in attack.DOMAINS if not domains or d in domains]))
    if source == "defend":
        return defend.tables(*[bundles.stored(spark, f"{root}/defend/{d}", "records") for d in ("techniques", "tactics", "artifacts", "weaknesses", "mappings")])
    return {"cwe": cwe, "capec": capec}[source].tables(bundles.stored(spark, f"{root}/{source}"))


def _graph(spark: SparkSession, source: str, args: argparse.Namespace) -> str:
    counts = sinks.write_tables(graph_tables(spark, source, args.base_dir, args.domains), f"{args.output_dir}/{source}", args.format, args.dry_run)
    return ", ".join(f"{k}={n}" for k, n in sorted(counts.items()))


def _sync(spark: SparkSession, source: str, args: argparse.Namespace) -> str:
    options = sync.Options(
        full=args.full, dry_run=args.dry_run, domains=tuple(args.domains or ()), max_pages=args.max_pages, page_size=args.page_size,
        api_key=args.api_key or os.environ.get("NVD_API_KEY"), agent=args.user_agent, urls=dict(x.split("=", 1) for x in args.url or ()), **({"transport": args.transport} if args.transport else {}),
    )
    manifest = sync.sync(spark, source, args.base_dir, options)
    return sinks.summary_line(source, manifest["mode"], manifest["diff"], manifest["files"])


def parser() -> argparse.ArgumentParser:
    top = argparse.ArgumentParser(prog="graphloom", description=__doc__)
    commands = top.add_subparsers(dest="command", required=True)
    for name, what in (("graph", "build graph tables"), ("sync", "synchronise snapshots")):
        sub = commands.add_parser(name, help=what)
        sub.add_argument("--base-dir", required=True)
        sub.add_argument("--only", "--sources", nargs="*", choices=SOURCES)
        sub.add_argument("--skip", nargs="*", choices=SOURCES, default=[])
        sub.add_argument("--domains", nargs="*")
        sub.add_argument("--dry-run", action="store_true")
        sub.add_argument("--stop-on-error", action="store_true")
        sub.add_argument("--summary", help="write the run's results to this file as JSON")
        if name == "graph":
            sub.add_argument("--output-dir", required=True)
            sub.add_argument("--format", choices=("parquet", "json"), default="parquet")
        else:
            sub.add_argument("--full", action="store_true")
            sub.add_argument("--max-pages", type=int, default=0)
            sub.add_argument("--page-size", type=int, default=0)
            sub.add_argument("--api-key")
            sub.add_argument("--user-agent", default="graphloom")
            sub.add_argument("--env-file", default=".env")
            sub.add_argument("--url", nargs="*", help="source=address, in place of the public one")
            sub.add_argument("--transport", help="module:function of (url, headers)")
    return top


def main(argv: list[str] | None = None) -> int:
    args = parser().parse_args(argv)
    if args.command == "sync":
        sync.load_env(args.env_file)
    spark = SparkSession.builder.config("spark.sql.session.timeZone", "UTC").getOrCreate()
    results = {}
    for source in [s for s in SOURCES if (not args.only or s in args.only) and s not in args.skip]:
        begun = time.monotonic()
        try:
            said = (_graph if args.command == "graph" else _sync)(spark, source, args)
            results[source] = {"passed": True, "seconds": round(time.monotonic() - begun, 1), "said": said}
            print(f"[{source}] {results[source]['seconds']} s: {said}")
        except Exception as error:  # a source's failure must not hide the others' results
            results[source] = {"passed": False, "seconds": round(time.monotonic() - begun, 1), "said": str(error).splitlines()[0] if str(error) else type(error).__name__}
            print(f"[{source}] failed: {results[source]['said']}", file=sys.stderr)
            if args.stop_on_error:
                break
    if args.summary:
        with open(args.summary, "w", encoding="utf-8") as out:
            json.dump({"command": args.command, "dry_run": args.dry_run, "results": results, "failed": [s for s, r in results.items() if not r["passed"]]}, out, indent=2, sort_keys=True)
    return 0 if all(r["passed"] for r in results.values()) else 1


if __name__ == "__main__":
    sys.exit(main())
