"""The command line: ``python -m quillspark index|status FOLDER`` and ``library check|sync|annotations``.

Exit codes: 0 all is well, 1 something needs a person, 2 the command could not run.
"""

from __future__ import annotations

import argparse
import sys

from pyspark.sql import SparkSession

from quillspark.functions import scalars
from quillspark.plans import job
from quillspark.sources import corpus, files, library


def parser() -> argparse.ArgumentParser:
    top = argparse.ArgumentParser(prog="quillspark", description="Text anchoring and quote verification on Spark. Nothing is ever deleted but links and copies that this tool made.")
    commands = top.add_subparsers(dest="command")
    index = commands.add_parser("index", help="extract every PDF of a folder and write its manifest")
    index.add_argument("folder")
    index.add_argument("--force", action="store_true", help="replace a text file that differs from a fresh extraction")
    index.add_argument("--floor", type=int, default=scalars.CHARS_PER_PAGE, metavar="N", help="characters a page below which a PDF has no text layer (default: %(default)s)")
    commands.add_parser("status", help="what is held, changed or not indexed").add_argument("folder")
    shelf = commands.add_parser("library", help="a read-only reference library")
    shelf.add_argument("--base", default=library.BASE, help="address of the library's local interface")
    actions = shelf.add_subparsers(dest="action", required=True)
    actions.add_parser("check", help="whether the library answers")
    sync = actions.add_parser("sync", help="mirror the PDFs of a tag into a folder")
    sync.add_argument("--tag", required=True)
    sync.add_argument("--out", required=True)
    sync.add_argument("--data-dir", required=True, help="the library's own folder, which holds storage/")
    sync.add_argument("--copy-all", action="store_true")
    sync.add_argument("--dry-run", action="store_true")
    notes = actions.add_parser("annotations", help="highlights of a tag's papers as quotes to be checked")
    notes.add_argument("--tag", required=True)
    notes.add_argument("--out", help="a file to write; standard output where there is none")
    return top


def _session() -> SparkSession:
    return SparkSession.builder.appName("quillspark").config("spark.sql.session.timeZone", "UTC").getOrCreate()


def _run(args: argparse.Namespace, spark: SparkSession | None) -> job.Report:
    if args.command == "library" and args.action == "check":
        return job.Report([f"the library answers; version {library.check(args.base)}"])
    spark = spark or _session()
    if args.command == "index":
        return job.index(spark, args.folder, args.floor, args.force)
    if args.command == "status":
        return job.status(spark, args.folder)
    if args.action == "sync":
        counts = library.sync(spark, args.tag, args.out, args.data_dir, args.copy_all, args.dry_run, args.base)
        return job.Report([f"{args.tag} -> {args.out}" + (" (nothing was changed)" if args.dry_run else ""), "  " + ", ".join(f"{k} {v}" for k, v in counts.items())])
    if args.out:
        library.write_annotations(spark, args.tag, args.out, args.base)
        return job.Report([f"written to {args.out}"])
    return job.Report([library.annotations_json(spark, args.tag, args.base)])


def main(argv: list[str] | None = None, spark: SparkSession | None = None) -> int:
    args = parser().parse_args(argv)
    if args.command is None:
        parser().print_help()
        return job.CANNOT_RUN
    try:
        report = _run(args, spark)
    except (corpus.ManifestError, files.WriteRefused, files.ExtractError, library.LibraryUnavailable, ValueError) as e:
        print(f"quillspark: {e}", file=sys.stderr)
        return job.CANNOT_RUN
    print("\n".join(report.lines), file=sys.stderr if report.code == job.CANNOT_RUN else sys.stdout)
    return report.code
