"""`python -m pathloom.cli ROOT`: a review of a folder of C and C++ files. Exit code: 1 if a finding is verified, 2 if one is likely, else 0."""

from __future__ import annotations

import argparse
import os
import subprocess
import sys

from pyspark.sql import SparkSession

from pathloom.functions import catalog
from pathloom.operators import export
from pathloom.plans.review import ReviewInputs, run_review
from pathloom.sources.extract import extract_graph
from pathloom.sources.sarif_sink import write_sarif
from pathloom.sources.repo import CPP_EXTENSIONS, changed_files, read_suppressions, scan_files


def _diff(root: str, against: str | None) -> list[str]:
    if not against:
        return []
    done = subprocess.run(["git", "-C", root, "diff", "--name-only", against], capture_output=True, text=True, check=False)
    return done.stdout.split("\n")[:-1] if done.returncode == 0 else []


def main(arguments: list[str] | None = None, spark: SparkSession | None = None) -> int:
    p = argparse.ArgumentParser(prog="pathloom")
    p.add_argument("root")
    p.add_argument("--changed", help="comma-separated changed files; without it the diff, without that all files")
    p.add_argument("--against", help="a revision to take the diff from")
    p.add_argument("--rules", help="a folder of YAML rule files")
    p.add_argument("--suppress", help="a file of lines file:line:rule")
    p.add_argument("--out", help="a folder for the results as JSON")
    p.add_argument("--sarif", help="a file for the results in SARIF")
    p.add_argument("--sources", default="", help="comma-separated further names of sources")
    p.add_argument("--sinks", default="", help="comma-separated further names of sinks")
    p.add_argument("--extensions", default=",".join(CPP_EXTENSIONS), help="comma-separated endings of the files to read")
    p.add_argument("--comments", help="a folder for the review comments as JSON")
    p.add_argument("--dry-run", action="store_true")
    a = p.parse_args(arguments)
    spark = spark or SparkSession.builder.appName("pathloom").getOrCreate()
    names = lambda text: [x.strip() for x in text.split(",") if x.strip()]
    files = scan_files(spark, a.root, names(a.extensions))
    nodes, edges = extract_graph(files, a.root)
    changed = changed_files(spark, a.changed, _diff(a.root, a.against), files)
    given = ReviewInputs(nodes, edges, files, changed, suppressions=read_suppressions(spark, a.suppress) if a.suppress else None, sources=names(a.sources), sinks=names(a.sinks))
    if a.rules:
        given.rules = catalog.load_rule_files(spark, a.rules)
    out = run_review(spark, given, a.dry_run)
    for row in out["report"].orderBy("ord", "file", "line_no").toLocalIterator():
        print(row.line)
    if a.out:
        export.write_json({k: out[k] for k in ("findings", "results", "card", "files")}, a.out)
    if a.sarif:
        write_sarif(export.sarif_results(out["findings"]), os.path.abspath(a.sarif) if "://" not in a.sarif else a.sarif)
    if a.comments:
        told = export.result_rows(out["findings"]).selectExpr("uri AS file_path", "start_line AS line_end", "message AS body")
        export.comment_rows(told).write.mode("overwrite").json(a.comments)
    return out["card"].first().exit_code


if __name__ == "__main__":
    sys.exit(main())
