"""Command line: link, sample, check, bundle.  Exit status 1 if a check finds errors."""

from __future__ import annotations

import argparse
import sys

from pyspark.sql import SparkSession

from tessera.operators import validate
from tessera.plans import link as plans
from tessera.sources import archive, linkage


def parser() -> argparse.ArgumentParser:
    out = argparse.ArgumentParser(prog="tessera")
    kinds = out.add_subparsers(dest="kind", required=True)
    run = kinds.add_parser("link", help="candidates and matches of three record files")
    for name in ("s1", "s2", "s3", "matches", "candidates", "model"):
        run.add_argument(f"--{name}", required=True)
    run.add_argument("--truth")
    run.add_argument("--sample", help="folder to train on where there is no model")
    run.add_argument("--preset", default="catboost")
    run.add_argument("--top-k", type=int, default=20)
    run.add_argument("--least", type=float, default=0.10)
    run.add_argument("--country")
    run.add_argument("--limit", type=int)
    run.add_argument("--force", action="store_true", help="train even if there is a model")
    draw = kinds.add_parser("sample", help="a training sample")
    for name in ("s1", "s2", "s3", "truth", "folder"):
        draw.add_argument(f"--{name}", required=True)
    draw.add_argument("--per-country", nargs="+", required=True, metavar="COUNTRY=ROWS")
    draw.add_argument("--distractors", type=int, default=50_000)
    look = kinds.add_parser("check", help="check a matching file, and a candidate file if it is there")
    look.add_argument("--matches", required=True)
    look.add_argument("--candidates")
    look.add_argument("--s1", required=True)
    look.add_argument("--targets", nargs="*", help="also look for ids that none of these files has")
    pack = kinds.add_parser("bundle", help="a zip of result files and a code folder")
    pack.add_argument("--out", required=True)
    pack.add_argument("--files", nargs="+", required=True)
    pack.add_argument("--code", required=True)
    return out


def say(found: validate.Result) -> int:
    for path, (rows, empty) in found.rows.items():
        print(f"{path}: {rows} rows, {empty} empty")
    for w in found.warnings:
        print(f"WARNING {w}")
    for e in found.errors:
        print(f"ERROR {e}")
    print("FAIL" if found.errors else "PASS")
    return found.status


def main(arguments: list[str] | None = None) -> int:
    a = parser().parse_args(arguments)
    if a.kind == "bundle":
        print(f"{len(archive.bundle(a.out, a.files, a.code))} members")
        return 0
    spark = SparkSession.builder.appName("tessera").getOrCreate()
    if a.kind == "sample":
        sizes = {c: int(n) for c, n in (x.split("=") for x in a.per_country)}
        print(plans.sample(spark, a.s1, a.s2, a.s3, a.truth, a.folder, sizes, a.distractors))
        return 0
    if a.kind == "check":
        known = None
        for at in a.targets or ():
            ids = linkage.read_ids(spark, at)
            known = ids if known is None else known.union(ids)
        return say(validate.check(spark, a.matches, linkage.read_ids(spark, a.s1), a.candidates, known))
    found, scores = plans.link(spark, a.s1, a.s2, a.s3, a.matches, a.candidates, a.model, a.truth, a.sample, a.preset, a.top_k, a.least, a.country, a.limit, a.force)
    if scores is not None:
        print(scores.first())
    return say(found)


if __name__ == "__main__":
    sys.exit(main())
