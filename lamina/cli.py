"""Command line: check files, rewrite them, and benchmark rewrites."""

from __future__ import annotations

import argparse
import sys

from pyspark.sql import SparkSession

from lamina.operators.lint import at_least, has_issue, lint, prescription, print_findings
from lamina.operators.rewrite import rewrite
from lamina.operators.rules import RULES, SEVERITIES
from lamina.plans.dsl import Prescription
from lamina.plans.writer import infer_all, plan
from lamina.sources.footer import footers
from lamina.sources.texts import read_prescription, read_prescriptions


def _parser() -> argparse.ArgumentParser:
    top = argparse.ArgumentParser(prog="lamina", description="Analyse and optimise the layout of Parquet files.")
    kinds = top.add_subparsers(dest="command", required=True)
    names = lambda text: [x.strip() for x in text.split(",") if x.strip()]
    check = kinds.add_parser("check", help="print findings; exit status 1 if there is a warning or an error")
    check.add_argument("file")
    check.add_argument("--rules", type=names)
    check.add_argument("--severity", choices=SEVERITIES, default="suggestion")
    check.add_argument("--export-prescription")
    re = kinds.add_parser("rewrite", help="rewrite a file by its findings or a prescription")
    re.add_argument("file")
    re.add_argument("-o", "--output")
    re.add_argument("--rules", type=names)
    re.add_argument("--from-prescription")
    re.add_argument("--dry-run", action="store_true")
    re.add_argument("--export-prescription")
    re.add_argument("--unsafe", action="store_true", help="also write layouts that Spark's vectorized reader can't read")
    bench = kinds.add_parser("bench", help="measure files before and after rewriting")
    source = bench.add_mutually_exclusive_group(required=True)
    source.add_argument("--from-linter", action="store_true")
    source.add_argument("--from-custom-prescription")
    bench.add_argument("--parquet-manifest", required=True)
    bench.add_argument("--data-dir", default="data")
    bench.add_argument("--output-dir", default="rewritten")
    bench.add_argument("--iterations", type=int, default=3)
    bench.add_argument("--batch-size", type=int, default=8192)
    return top


def write_prescription(path: str, wanted: Prescription) -> None:
    """Write a prescription to a text file and say so."""
    with open(path, "w", encoding="utf-8") as f:
        f.write(f"{wanted}\n")
    print(f"Wrote {len(wanted)} directives to {path}")


def _warn(wanted: Prescription) -> None:
    if c := wanted.conflict():
        print(f"warning: {c}; the later one holds", file=sys.stderr)


def main(argv: list[str] | None = None, spark: SparkSession | None = None) -> int:
    """Run a command; the exit status."""
    args = _parser().parse_args(argv)
    if args.command == "rewrite" and args.rules and args.from_prescription:
        print("error: --rules and --from-prescription exclude each other", file=sys.stderr)
        return 2
    unknown = [n for n in getattr(args, "rules", None) or [] if n not in RULES]
    if unknown:
        print(f"warning: no such rules: {', '.join(unknown)}", file=sys.stderr)
    spark = spark or SparkSession.builder.appName("lamina").config("spark.ui.enabled", "false").config("spark.sql.shuffle.partitions", "16").getOrCreate()
    if args.command == "check":
        found = lint(spark, args.file, rules=args.rules).cache()
        kept = at_least(found, args.severity)
        print_findings(kept, sys.stdout.isatty())
        if args.export_prescription:
            write_prescription(args.export_prescription, prescription(kept))
        return int(has_issue(found))
    if args.command == "rewrite":
        wanted = read_prescription(args.from_prescription) if args.from_prescription else prescription(lint(spark, args.file, rules=args.rules))
        if not len(wanted):
            print("Nothing to do: the prescription is empty")
            return 0
        _warn(wanted)
        if args.export_prescription:
            write_prescription(args.export_prescription, wanted)
        if args.dry_run:
            print(wanted)
            plans = [plan(wanted, s, args.unsafe) for s, _, _, _ in infer_all(footers(spark, args.file))]
        elif not args.output:
            print("error: -o names the output", file=sys.stderr)
            return 2
        else:
            plans = [p for p, _ in rewrite(spark, args.file, args.output, wanted, args.unsafe, single=True)]
            print(f"Wrote {args.output} ({', '.join(sorted({p.sink for p in plans}))} writer)")
        for planned in plans:
            for d, why in planned.unapplied:
                print(f"not applied: {d} ({why})", file=sys.stderr)
            for what in planned.lost:
                print(f"not kept: {what}", file=sys.stderr)
        return 0
    from lamina.operators.benchmark import benchmark, report_text
    from lamina.sources.texts import read_manifest

    custom = None
    if args.from_custom_prescription:
        n = read_manifest(spark, args.parquet_manifest).count()
        custom = dict(read_prescriptions(args.from_custom_prescription, n))
        for p in custom.values():
            _warn(p)
    print(report_text(benchmark(spark, args.parquet_manifest, args.data_dir, args.output_dir, custom, args.iterations, args.batch_size)))
    return 0
