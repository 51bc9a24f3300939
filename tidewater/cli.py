"""Command line: ``python -m tidewater.cli scan FILE`` and ``profile FILE``."""

from __future__ import annotations

import argparse
import json
import sys
from pathlib import Path

from pyspark.sql import SparkSession

from tidewater.errors import TidewaterError
from tidewater.quality.profile import profile
from tidewater.sources.csv import read_csv, scan_csv
from tidewater.sources.jsonl import read_jsonl
from tidewater.sources.parquet import read_parquet


def parser() -> argparse.ArgumentParser:
    top = argparse.ArgumentParser(prog="tidewater", description="Scan and profile tabular files.")
    sub = top.add_subparsers(dest="command", required=True)
    for name, doc in (("scan", "column types from a sample"), ("profile", "data quality of a whole file")):
        p = sub.add_parser(name, help=doc)
        p.add_argument("path")
        p.add_argument("--format", choices=["text", "json", "markdown"] if name == "profile" else ["text", "json"], default="text")
        p.add_argument("--delimiter")
        p.add_argument("--output", help="file to write to instead of the terminal")
        if name == "scan":
            p.add_argument("--sample-size", type=int)
        else:
            p.add_argument("--redact", action="store_true", help="hide sample values")
    return top


def _read(path: str, delimiter: str | None):
    suffix = Path(path).suffix.lower()
    if suffix in (".jsonl", ".ndjson"):
        return read_jsonl(path)
    if suffix in (".parquet", ".pq"):
        return read_parquet(path)
    return read_csv(path, delimiter=delimiter or ",")


def main(args: list[str] | None = None) -> int:
    options = parser().parse_args(args)
    try:
        if options.command == "scan":
            types = scan_csv(options.path, delimiter=options.delimiter, sample_size=options.sample_size)
            body = json.dumps(types, indent=2) if options.format == "json" else "\n".join(f"{c}: {t}" for c, t in types.items())
        else:
            report = profile(_read(options.path, options.delimiter))
            if options.format == "json":
                body = report.to_json(indent=2, redact_sample_values=options.redact)
            elif options.format == "markdown":
                body = report.to_markdown()
            else:
                body = "\n".join(f"{k}: {v}" for k, v in report.summary().items())
    except (TidewaterError, OSError, ValueError) as error:
        print(f"tidewater: {error}", file=sys.stderr)
        return 1
    if options.output:
        Path(options.output).write_text(body + "\n", encoding="utf-8")
    else:
        print(body)
    return 0


if __name__ == "__main__":
    SparkSession.builder.master("local[*]").appName("tidewater").config("spark.ui.enabled", "false").getOrCreate()
    sys.exit(main())
