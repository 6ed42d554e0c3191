"""Fusion from the command line: python -m tributary.cli --csv people.csv --notes notes.txt --pretty"""

from __future__ import annotations

import argparse
import json
import sys

from pyspark.sql import SparkSession

from .operators.display import json_chunks
from .operators.project import load_projection, project, serialize
from .plans.pipeline import run
from .plans.sink import write_run
from .sources import Source

#: Flags and source types, in the order in which sources are read.
FLAGS = (("csv", "csv"), ("resume", "resume_pdf"), ("ats", "ats_json"), ("notes", "notes"), ("github", "github"))


def build_parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="tributary", description="Fuses records about people from several sources.")
    for flag, _ in FLAGS:
        p.add_argument(f"--{flag}", action="append", default=[], metavar="PATH")
    p.add_argument("--linkedin-id", action="append", default=[])
    p.add_argument("--projection", help="YAML or JSON file with the output's fields")
    p.add_argument("--out", metavar="FOLDER", help="tasks write candidates and reports there, as JSON arrays in parts; nothing on stdout")
    p.add_argument("--pretty", action="store_true")
    p.add_argument("--stats", action="store_true", help="counts and times on stderr")
    p.add_argument("--validate", action="store_true", help="reports as JSON on stderr")
    return p


def main(argv: list[str] | None = None) -> int:
    parser = build_parser()
    args = parser.parse_args(argv)
    sources = [Source(kind, path) for flag, kind in FLAGS for path in getattr(args, flag)]
    if not sources:
        parser.error("no source given")
    spark = SparkSession.builder.appName("tributary").getOrCreate()
    result = run(spark, sources, linkedin_ids=tuple(args.linkedin_id))
    projection = load_projection(args.projection) if args.projection else None
    if args.out:
        write_run(result, args.out, projection)
    else:
        rows = project(result.candidates, projection).toDF("cluster_id", "text") if projection else serialize(result.candidates).toDF("cluster_id", "text")
        for chunk in json_chunks((r.text for r in rows.orderBy("cluster_id").toLocalIterator()), args.pretty):
            print(chunk, end="")
        print()
    if args.validate:
        reports = [r.asDict(recursive=True) for r in result.reports.orderBy("cluster_id").toLocalIterator()]
        print(json.dumps(reports, indent=2 if args.pretty else None, ensure_ascii=False), file=sys.stderr)
    if args.stats:
        s = result.stats
        print(f"records {s.records_in}, clusters {s.clusters_out}, conflicts {s.conflicts_found}, " + ", ".join(f"{k} {v:.0f} ms" for k, v in s.timings_ms.items()) + f", total {s.total_ms:.0f} ms", file=sys.stderr)
    return 0


if __name__ == "__main__":
    sys.exit(main())
