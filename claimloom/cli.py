"""Commands over a folder of tables: ``python -m claimloom.cli COMMAND TABLES [...]``."""

from __future__ import annotations

import argparse
import importlib

from pyspark.sql import functions as F

from claimloom.operators import pipeline, reports, store
from claimloom.providers import PlainTextParser, SentenceExtractor
from claimloom.session import build_session, clean, keep
from claimloom.sources import sinks
from claimloom.sources.files import scan_files
from claimloom.sources.tables import table

FILED = ["witness", "page", "block", "passage", "claim", "anchor", "quarantine"]
TABLES = [*FILED, "framed", "measure", "verdict", "note"]
_WITNESS = "witness_id bigint, sha256 string, filename string, title string, publisher string, vintage_raw string, default_currency string, status string"


def _there(spark, args, names=TABLES) -> dict:
    return {t: table(spark, args.tables, t) for t in names if sinks._exists(spark, f"{args.tables}/{t}.parquet")}


def _undo_begun(spark, args) -> None:
    """Take away what an ingest that stopped half-way has written; its files are new again."""
    there = _there(spark, args, [*FILED, "verdict"])
    if "witness" in there and not (begun := there["witness"].where("status = 'begun'")).isEmpty():
        left = store.delete_witnesses(there, keep(begun.select("witness_id"), "begun"))
        # Witnesses last: until they are gone, this can be run again.
        for name in sorted(left, key=lambda n: n == "witness"):
            sinks.replace(left[name], args.tables, name)


def _ingest(spark, args) -> None:
    _undo_begun(spark, args)
    known = sinks.read_or_empty(spark, args.tables, "witness", _WITNESS)
    numbers = [df.agg(F.max(c)).first()[0] or 0 for name, c in (("claim", "claim_id"), ("quarantine", "quote_id")) for df in _there(spark, args, [name]).values()]
    fresh = pipeline.ingest(scan_files(spark, args.files, args.pattern), known, PlainTextParser(), SentenceExtractor(), last_claim=max(numbers, default=0))
    witness = fresh.pop("witness")
    # A witness is done only once all else is written.
    sinks.append(witness.withColumn("status", F.lit("begun")), args.tables, "witness")
    for name, rows in fresh.items():
        sinks.append(rows, args.tables, name)
    stored = table(spark, args.tables, "witness").where("status != 'begun'")
    sinks.replace(stored.unionByName(witness), args.tables, "witness")


def _frame(spark, args) -> None:
    framed, measures = pipeline.frame(table(spark, args.tables, "claim"), table(spark, args.tables, "witness"))
    sinks.replace(framed, args.tables, "framed")
    sinks.replace(measures, args.tables, "measure")


def _rule(spark, args) -> None:
    _frame(spark, args)
    verdicts = pipeline.rule(table(spark, args.tables, "framed"), table(spark, args.tables, "measure"))
    sinks.replace(store.number_rows(verdicts, ["claim_a", "claim_b"], "verdict_id"), args.tables, "verdict")
    if args.adviser and not args.no_escalate:
        module, _, name = args.adviser.partition(":")
        noted = pipeline.escalate(table(spark, args.tables, "verdict"), getattr(importlib.import_module(module), name)())
        sinks.replace(noted, args.tables, "note")


def _quarantine(spark, args) -> None:
    for rows in reports.quarantine_report(table(spark, args.tables, "quarantine"), table(spark, args.tables, "witness")):
        rows.show(reports.QUARANTINED, truncate=60)


def _export(spark, args) -> None:
    sinks.export_json(reports.export_top(table(spark, args.tables, "verdict"), table(spark, args.tables, "claim")), args.file)


def _stats(spark, args) -> None:
    there = _there(spark, args)
    reports.corpus_stats(there).show(truncate=False)
    if "verdict" in there:
        there["verdict"].groupBy("verdict", "rule_id").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "rule_id").show(40, truncate=False)


def _cases(spark, args) -> None:
    reports.example_cases(table(spark, args.tables, "verdict"), table(spark, args.tables, "claim")).show(truncate=False)


def _build(spark, args) -> None:
    _ingest(spark, args)
    _rule(spark, args)
    _stats(spark, args)


def _checkpoint(spark, args) -> None:
    for name in TABLES:
        if sinks._exists(spark, f"{args.tables}/{name}.parquet"):
            sinks.compact(spark, args.tables, name)


def _reset(spark, args) -> None:
    sinks.reset(spark, args.tables, TABLES, sure=args.yes)


def main(argv: list[str] | None = None, spark=None) -> int:
    parser = argparse.ArgumentParser(prog="claimloom")
    commands = parser.add_subparsers(dest="command", required=True)
    for name, run in {"ingest": _ingest, "frame": _frame, "adjudicate": _rule, "quarantine": _quarantine, "export": _export, "stats": _stats, "cases": _cases, "build": _build, "checkpoint": _checkpoint, "reset": _reset}.items():
        sub = commands.add_parser(name)
        sub.add_argument("tables")
        if name in ("ingest", "build"):
            sub.add_argument("files")
            sub.add_argument("--pattern", default="*.txt")
        if name in ("adjudicate", "build"):
            sub.add_argument("--adviser", help="MODULE:CLASS of a second opinion on the gravest contradictions")
            sub.add_argument("--no-escalate", action="store_true")
        if name == "export":
            sub.add_argument("file")
        if name == "reset":
            sub.add_argument("--yes", action="store_true")
        sub.set_defaults(run=run)
    args = parser.parse_args(argv)
    spark = spark or build_session()
    args.run(spark, args)
    clean(spark)
    return 0


if __name__ == "__main__":
    raise SystemExit(main())
