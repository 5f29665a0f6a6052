"""A corpus of cases against the rules that each expects.

python -m ledgerloom.plans.corpus [--strict-extra] [--out PATH] ROOT...
"""

from __future__ import annotations

import argparse
import sys

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerloom.plans.diagnose import diagnose, ordered
from ledgerloom.sources.artifacts import Relations, load


def check(r: Relations, strict_extra: bool = False, found: DataFrame | None = None) -> DataFrame:
    """Of the artifacts (and their diagnostics, if at hand) per artifact: ak, expected, got (a rule a diagnostic), missing, extra, ok.

    A missing rule fails a case; an extra one only with ``strict_extra``.
    """
    got = (diagnose(r) if found is None else found).groupBy("ak").agg(F.array_sort(F.collect_list("rule_id")).alias("got"))
    expected = r.expected.groupBy("ak").agg(F.array_sort(F.collect_list("rule_id")).alias("expected"))
    none = F.array().cast("array<string>")
    all_ = r.artifact.join(expected, "ak", "left").join(got, "ak", "left").select("ak", F.coalesce("expected", none).alias("expected"), F.coalesce("got", none).alias("got"))
    all_ = all_.withColumn("missing", F.array_except("expected", "got")).withColumn("extra", F.array_except("got", "expected"))
    ok = F.size("missing") == 0
    return all_.withColumn("ok", ok & (F.size("extra") == 0) if strict_extra else ok)


def main(argv: list[str] | None = None) -> int:
    parser = argparse.ArgumentParser(description=__doc__)
    parser.add_argument("roots", nargs="+", help="globs of artifact directories")
    parser.add_argument("--strict-extra", action="store_true", help="more diagnostics than expected fail a case too")
    parser.add_argument("--out", help="write the diagnostics of failing cases below this path")
    args = parser.parse_args(argv)
    r = load(SparkSession.builder.getOrCreate(), *args.roots).persist()
    found = diagnose(r).persist()
    n, failed = 0, []
    for c in check(r, args.strict_extra, found).orderBy("ak").toLocalIterator():
        n, failed = n + 1, failed + ([] if c.ok else [c.ak])
        print("PASS" if c.ok else "FAIL", c.ak, f"expected={c.expected} got={c.got}", *([f"missing={c.missing}"] if c.missing else []), *([f"extra={c.extra}"] if c.extra else []))
    if failed and args.out:
        ordered(found.where(F.col("ak").isin(failed))).write.json(args.out)
    print(f"{n - len(failed)} of {n} cases give what they expect")
    return int(bool(failed))


if __name__ == "__main__":
    sys.exit(main())
