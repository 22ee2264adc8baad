"""Whole runs: manifests to canonical records, projections, logs and the command line."""

from __future__ import annotations

import argparse
import json
import os
import sys
from collections.abc import Mapping
from dataclasses import dataclass
from typing import Any

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerloom.operators import canonical as C
from ledgerloom.operators.ledger import build_ledger, extract, source_log
from ledgerloom.plans.projection import ProjectionError, project_json
from ledgerloom.sources.adapters import Adapter
from ledgerloom.sources.manifests import read_documents, read_manifests


@dataclass
class Report:
    """The results of a run, each a DataFrame keyed by candidate_id."""

    canonical: DataFrame  # with validation_errors
    output: DataFrame  # candidate_id, output (JSON text), projection_error
    source_log: DataFrame
    ledger: DataFrame

    def ledger_sizes(self) -> DataFrame:
        return self.ledger.groupBy("candidate_id").agg(F.count("*").alias("claims"))

    def release(self) -> None:
        """Lets go of the kept ledger, once nothing more is read from the report."""
        self.ledger.unpersist()


def run_documents(documents: DataFrame, config: Mapping[str, Any] | None = None, adapters: dict[str, Adapter] | None = None, partitions: int | None = None, pretty: bool = False) -> Report:
    """A run over documents (candidate_id, pos, type, path, timestamp, trust, content) of any number of candidates.

    The ledger is dealt by candidate once (to ``partitions``, else the
    session's shuffle partitions) and kept until the report is released, so no
    reduction exchanges it again.
    """
    extracted = extract(documents, adapters)
    n = partitions or int(documents.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ledger = build_ledger(extracted).repartition(n, "candidate_id").persist()
    records = C.canonical_records(ledger, documents.select("candidate_id"))
    flag = lambda key: config is None or (config.get(key) if isinstance(config.get(key), bool) else True)
    if not flag("include_confidence"):
        records = C.without_confidence(records)
    if not flag("include_provenance"):
        records = C.without_provenance(records)
    checked = C.validate(records)
    output = project_json(records, config, pretty, keep=("candidate_id",))
    return Report(checked, output, source_log(extracted), ledger)


def run_manifests(spark: SparkSession, manifests: str | list[str], config: Mapping[str, Any] | None = None, **options) -> Report:
    """A run over manifest files; documents are looked up in the manifests' folders."""
    paths = [manifests] if isinstance(manifests, str) else list(manifests)
    folders = sorted({os.path.dirname(os.path.abspath(p)) if "://" not in p else p.rsplit("/", 1)[0] for p in paths})
    sources = read_manifests(spark, paths)
    return run_documents(read_documents(spark, sources, folders), config, **options)


def main(arguments: list[str] | None = None, spark: SparkSession | None = None) -> int:
    """Exit status: 0 valid, 1 a canonical record has errors (the output is written all the same), 2 usage, input or projection errors."""
    parser = argparse.ArgumentParser(prog="ledgerloom", description="Consolidates the documents of a manifest into one record.")
    parser.add_argument("--manifest", required=True, help="the manifest (JSON)")
    parser.add_argument("--config", help="projection configuration (JSON)")
    parser.add_argument("--out", help="write the result here, not to stdout")
    parser.add_argument("--explain", action="store_true", help="print the extraction log to stderr")
    try:
        args = parser.parse_args(arguments)
    except SystemExit as e:
        return 2 if e.code else 0
    try:
        config = None
        if args.config:
            with open(args.config, encoding="utf-8") as f:
                config = json.load(f)
            config = config if isinstance(config, dict) else None
        if not os.path.exists(args.manifest):
            raise OSError(f"no manifest {args.manifest}")
        spark = spark or SparkSession.builder.config("spark.sql.session.timeZone", "UTC").getOrCreate()
        report = run_manifests(spark, args.manifest, config, pretty=True)
        row = report.output.join(report.canonical.select("candidate_id", "validation_errors"), "candidate_id").first()
    except (OSError, ProjectionError) as e:
        print(f"{'projection/validation' if isinstance(e, ProjectionError) else 'input'} error: {e}", file=sys.stderr)
        return 2
    except Exception as e:
        if "manifest is not a JSON object" not in str(e):
            raise
        print(f"input error: manifest is not a JSON object: {args.manifest}", file=sys.stderr)
        return 2
    if args.explain and not row["projection_error"]:
        explain(report, row["validation_errors"])
    report.release()
    if row["projection_error"]:
        print(f"projection/validation error: {row['projection_error']}", file=sys.stderr)
        return 2
    if args.out:
        with open(args.out, "w", encoding="utf-8") as f:
            f.write(row["output"] + "\n")
        print(f"wrote {args.out}", file=sys.stderr)
    else:
        print(row["output"])
    return 1 if row["validation_errors"] else 0


def explain(report: Report, errors: list[str]) -> None:
    """The source log of one candidate, to stderr."""
    for s in report.source_log.orderBy("pos").collect():
        print(f"  {s['type'] or 'null':<16} " + (f"OK  {s['claims']:2d} claims" if s["ok"] else f"SKIP ({s['error']})"), file=sys.stderr)
    print(f"  ledger: {report.ledger.count()} claims", file=sys.stderr)
    print(f"  VALIDATION ERRORS: {errors}" if errors else "  canonical schema: VALID", file=sys.stderr)
