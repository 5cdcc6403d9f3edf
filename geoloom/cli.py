"""Command line: ingest, build, serve, stats, search, sources, drift, export."""

from __future__ import annotations

import argparse
import json
import os
import sys

from pyspark.sql import SparkSession

from geoloom import export, geocode, ingest, remote, server, service, sources
from geoloom.operators import drift, rollups
from geoloom.sources.adapters import Context


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="geoloom")
    p.add_argument("--data", default="data", help="folder of the dataset")
    sub = p.add_subparsers(dest="command", required=True)
    for name in ("ingest", "drift"):
        c = sub.add_parser(name)
        c.add_argument("source", nargs="+", metavar="ID[=PATH]", help="without a path the file is retrieved")
        c.add_argument("--as-of", required=True)
        c.add_argument("--raw", default="raw", help="folder of retrieved files and of geocodes.json")
        c.add_argument("--offline", action="store_true", help="use retrieved files only")
        c.add_argument("--key", action="append", default=[], metavar="ID=KEY")
        c.add_argument("--page", action="append", default=[], metavar="ID=URL")
        c.add_argument("--exclude-planned", action="store_true")
    sub.add_parser("stats")
    sub.add_parser("sources")
    s = sub.add_parser("search")
    s.add_argument("text", nargs="?", default="")
    s.add_argument("--near", help="lat,lng")
    for o in ("radius", "min_kw", "max_kw", "states", "operators", "connectors", "speed", "status", "sort", "offset", "bbox", "min_sources", "min_confidence"):
        s.add_argument(f"--{o.replace('_', '-')}", dest=o)
    s.add_argument("--limit", default="20")
    s.add_argument("--include-planned", action="store_true")
    s.add_argument("--include-approximate", action="store_true")
    e = sub.add_parser("export")
    e.add_argument("format")
    e.add_argument("path")
    b = sub.add_parser("build")
    b.add_argument("path", help="folder for sites.json")
    v = sub.add_parser("serve")
    v.add_argument("--as-of", required=True)
    v.add_argument("--folder", help="built files to serve beside the routes")
    v.add_argument("--host", default="127.0.0.1")
    v.add_argument("--port", type=int, default=8080)
    return p


def _pairs(given: list[str]) -> dict[str, str]:
    return dict(x.split("=", 1) for x in given)


def _run(a: argparse.Namespace, spark: SparkSession):
    """(the run, what became of sources that could not be retrieved)."""
    paths = _pairs([x for x in a.source if "=" in x])
    got, failed = remote.get_all([x for x in a.source if "=" not in x], a.raw, a.offline, _pairs(a.key), _pairs(a.page))
    cache = geocode.read_cache(os.path.join(a.raw, "geocodes.json"))
    ctx = Context(fetched_at=a.as_of, as_of=a.as_of, geocodes=geocode.as_frame(spark, cache))
    return ingest.ingest(spark, paths | got, ctx, exclude_planned=a.exclude_planned), failed


def report(svc: service.Service) -> list[str]:
    """The lines of ``stats``: totals, then sections in the order of a report."""
    totals = rollups.coverage_totals(svc.sites).first().asDict()
    out = [f"{k.replace('_', ' ')}: {v}" for k, v in totals.items()]
    rows = rollups.report_order(rollups.coverage_counts(svc.sites).where("dimension <> 'operator'")).collect()
    for k, r in enumerate(rows):
        if not k or rows[k - 1].dimension != r.dimension:
            out.append(f"{r.dimension.replace('_', ' ')}:")
        out.append(f"  {r.n:>8}  {r.value}")
    return [*out, "operators:", *[f"  {r.n:>8}  {r.operator}" for r in rollups.top_operators(svc.sites).collect()]]


def search_params(a: argparse.Namespace) -> dict:
    """Request parameters from parsed arguments."""
    out = {k: v for k, v in vars(a).items() if k in ("radius", "min_kw", "max_kw", "states", "operators", "connectors", "speed", "status", "sort", "offset", "bbox", "min_sources", "min_confidence", "limit") and v is not None}
    if a.text:
        out["text"] = a.text
    if a.near:
        out["lat"], out["lng"] = a.near.split(",")
    for k in ("include_planned", "include_approximate"):
        if getattr(a, k):
            out[k] = "true"
    return out


def main(argv: list[str] | None = None, spark: SparkSession | None = None) -> int:
    """0 done, 1 warning of drift or bad arguments, 2 failed drift, 3 no dataset."""
    # negative coordinates are values, not options
    argv = list(sys.argv[1:] if argv is None else argv)
    if "--near" in argv[:-1]:
        k = argv.index("--near")
        argv[k : k + 2] = [f"--near={argv[k + 1]}"]
    a = parser().parse_args(argv)
    spark = spark or SparkSession.builder.appName("geoloom").getOrCreate()
    told = lambda x: print(json.dumps(x, default=str, ensure_ascii=False))
    if a.command == "sources":
        for r in sources.catalogue(spark).collect():
            told(r.asDict())
        return 0
    if a.command in ("ingest", "drift"):
        run, failed = _run(a, spark)
        for source, why in failed.items():
            told({"source_id": source, "error": why})
        if a.command == "ingest":
            ingest.save(run, a.data)
            told(run.resolution.first().asDict())
            return 0
        before = ingest.load(spark, a.data, "source_stats")
        now = run.source_stats
        findings = drift.detect(before if before is not None else now.limit(0), now)
        for r in findings.collect():
            told(r.asDict())
        level = ("ok", "warn", "fail").index(drift.worst(findings))
        # a run that failed is no baseline for the next one
        if drift.promote_baseline(now, findings, f"{a.data}/source_stats"):
            ingest.save(run, a.data)
        return level
    try:
        svc = service.Service(ingest.load(spark, a.data), {"generated_at": "", "licence": "see sources"})
        if a.command == "stats":
            print("\n".join(report(svc)))
        elif a.command == "build":
            export.write(svc.sites, "slim", f"{a.path}/parts", svc.meta())
            export.join_parts(spark, [f"{a.path}/parts/slim"], f"{a.path}/sites.json")
        elif a.command == "serve":
            server.serve(svc, a.as_of, a.folder, a.host, a.port).serve_forever()
        elif a.command == "search":
            told(svc.search(search_params(a)))
        else:
            export.write(svc.sites, a.format, a.path, svc.meta())
    except FileNotFoundError as e:
        print(e, file=sys.stderr)
        return 3
    except (service.ServiceError, ValueError) as e:
        print(e, file=sys.stderr)
        return 1
    return 0


if __name__ == "__main__":
    sys.exit(main())
