"""Sinks of diagnostics, and a command line: python -m ledgerloom.plans.report [--json] [--out PATH] ROOT..."""

from __future__ import annotations

import argparse
import json
import sys
import textwrap

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerloom.plans.diagnose import diagnose, ordered
from ledgerloom.sources.artifacts import load


def as_json(diagnostics: DataFrame) -> DataFrame:
    """(ak, value): a JSON object a diagnostic, keys sorted, the artifact's first."""
    return ordered(diagnostics).select("ak", F.to_json(F.struct(F.col("ak").alias("artifact"), "category", "message", "rule_id", "severity", "target")).alias("value"))


def as_tsv(diagnostics: DataFrame) -> DataFrame:
    """(ak, value): rule, severity, category, target and message between tabs."""
    return ordered(diagnostics).select("ak", F.concat_ws("\t", "rule_id", "severity", "category", "target", "message").alias("value"))


def exit_status(diagnostics: DataFrame) -> int:
    """1 if there is an error, else 0."""
    return int(not diagnostics.where("severity = 'error'").isEmpty())


def main(argv: list[str] | None = None) -> int:
    """To standard output goes one sorted JSON array, or lines; of several artifacts each finding names its own."""
    parser = argparse.ArgumentParser(description=__doc__)
    parser.add_argument("roots", nargs="+", help="artifact directories, or globs of them")
    parser.add_argument("--profile", default="default", choices=["default", "strict"], help="both check the same rules")
    parser.add_argument("--json", action="store_true")
    parser.add_argument("--out", help="write the report below this path, as JSON lines or lines that begin with the artifact, rather than to standard output")
    args = parser.parse_args(argv)
    relations = load(SparkSession.builder.getOrCreate(), *args.roots).persist()
    found = diagnose(relations).persist()
    several = len(relations.artifact.take(2)) > 1
    report = (as_json if args.json else as_tsv)(found)
    if args.out:
        report.select("value" if args.json else F.concat_ws("\t", "ak", "value")).write.text(args.out)
        return exit_status(found)
    n = 0
    for row in report.toLocalIterator():
        if args.json:
            finding = json.loads(row.value)
            if not several:
                del finding["artifact"]
            print("[" if not n else ",", textwrap.indent(json.dumps(finding, indent=2, sort_keys=True, ensure_ascii=False), "  "), sep="\n", end="")
        else:
            print(f"{row.ak}\t{row.value}" if several else row.value)
        n += 1
    if args.json:
        print("\n]" if n else "[]")
    elif not n:
        print("valid")
    return exit_status(found)


if __name__ == "__main__":
    sys.exit(main())
