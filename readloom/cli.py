"""Command line: ``python -m readloom.cli run|split|compare|evaluate``."""

from __future__ import annotations

import argparse
import sys
import time

from pyspark.sql import SparkSession

from readloom.config import Context, Extraction, Settings
from readloom.operators import evaluate
from readloom.plans import pipeline
from readloom.sources.fastq import read_fastq, split_file, write_fastq


def elapsed(seconds: float) -> str:
    """Seconds as ``1h 2m 3s``."""
    s = int(seconds)
    parts = [f"{s // 3600}h"] * (s >= 3600) + [f"{s % 3600 // 60}m"] * (s >= 60) + [f"{s % 60}s"]
    return " ".join(parts)


def _extraction_flags(p: argparse.ArgumentParser) -> None:
    p.add_argument("--bc-start", type=int, default=0)
    p.add_argument("--bc-len", type=int, default=15)
    p.add_argument("--context", help="flanking pattern with a run of N; overrides the place")
    p.add_argument("--max-context-mismatches", type=int, default=1)
    p.add_argument("--max-mismatches", type=int, default=2)
    p.add_argument("--max-bc-indels", type=int, default=1)
    p.add_argument("--max-n", type=int, default=2)
    p.add_argument("--max-len", type=int, default=100_000)


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="readloom")
    sub = p.add_subparsers(dest="command", required=True)
    run = sub.add_parser("run", help="collapse reads into one consensus a barcode")
    run.add_argument("--in", dest="inputs", required=True, help="FASTQ files, separated by commas")
    run.add_argument("--out", default="consensus_out", help="folder for the consensus records")
    run.add_argument("--fail", help="folder for reads and groups without a consensus")
    run.add_argument("--gap", type=float, default=-1.0)
    run.add_argument("--no-alignment", action="store_true")
    _extraction_flags(run)
    ev = sub.add_parser("evaluate", help="compare clusters with the barcode= tags of simulated reads")
    ev.add_argument("--in", dest="inputs", required=True)
    ev.add_argument("--report", help="folder for the report as a Parquet table")
    _extraction_flags(ev)
    split = sub.add_parser("split", help="cut a barcode-sorted file into pieces of so many barcodes")
    split.add_argument("--in1", required=True)
    split.add_argument("--out", default="pieces")
    split.add_argument("--bc-start", type=int, default=0)
    split.add_argument("--bc-len", type=int, default=15)
    split.add_argument("--size", type=int, required=True)
    comp = sub.add_parser("compare", help="whether two FASTQ files hold the same records in any order")
    comp.add_argument("first")
    comp.add_argument("second")
    return p


def settings_of(a: argparse.Namespace) -> Settings:
    how = Extraction(a.bc_start, a.bc_len, Context.parse(a.context) if a.context else None, a.max_context_mismatches, a.max_bc_indels)
    return Settings(how, a.max_mismatches, a.max_n, getattr(a, "gap", -1.0), not getattr(a, "no_alignment", False), a.max_len)


def main(argv: list[str] | None = None, spark: SparkSession | None = None) -> int:
    a = parser().parse_args(argv)
    spark = spark or SparkSession.builder.appName("readloom").getOrCreate()
    began = time.monotonic()
    if a.command in ("run", "evaluate"):
        how = settings_of(a)
        r = pipeline.run(read_fastq(spark, a.inputs.split(","), a.max_len), how)
        r.stats().orderBy("file_idx").show(1000, False)
    if a.command == "run":
        write_fastq(r.fastq_lines(), a.out)
        if a.fail:
            write_fastq(r.failed_lines(), a.fail)
        r.rates().show()
        r.diameters().show(20, False)
    elif a.command == "evaluate":
        told = evaluate.report(r.counts, r.assignments, r.assigned)
        if a.report:
            told.coalesce(1).write.mode("overwrite").parquet(a.report)
            told = spark.read.parquet(a.report)
        told.orderBy("section", "bin", "measure").show(1000, False)
    elif a.command == "split":
        pieces, skipped = split_file(read_fastq(spark, [a.in1]), a.in1, a.bc_start, a.bc_len, a.size, a.out)
        print("\n".join(pieces))
        if skipped:
            print("warning: skipped", skipped, "reads too short for a barcode", file=sys.stderr)
    elif a.command == "compare":
        row = evaluate.same_records(read_fastq(spark, [a.first]), read_fastq(spark, [a.second])).first()
        print(row["same"])
        return 0 if row["same"] else 1
    print("took", elapsed(time.monotonic() - began))
    return 0


if __name__ == "__main__":
    sys.exit(main())
