"""Runs from the command line: ``python -m cartulary medallion ROOT role=path ...`` and its kin."""

from __future__ import annotations

import argparse
import importlib
import json
import time
from datetime import UTC, datetime
from pathlib import Path

from cartulary.plans import assistant, jobs, medallion
from cartulary.session import session
from cartulary.sources import lake, stores

RETENTION_DAYS = 180


def _named(name: str):
    """A function given as ``module:function``."""
    module, function = name.split(":")
    return getattr(importlib.import_module(module), function)


def parser() -> argparse.ArgumentParser:
    whole = argparse.ArgumentParser(prog="cartulary")
    commands = whole.add_subparsers(dest="command", required=True)
    for name in ("medallion", "crosswalk"):
        one = commands.add_parser(name)
        one.add_argument("root")
        one.add_argument("sources", nargs="+", help="role=path")
        one.add_argument("--cycles", type=int, default=3)
        one.add_argument("--year", type=int)
        one.add_argument("--version", default=f"{name}_v1")
        one.add_argument("--database", help="where the marts become tables")
    one = commands.add_parser("ingest")
    one.add_argument("catalog", type=Path)
    one.add_argument("root")
    one.add_argument("--downloads", type=Path, default=Path("downloads"))
    one = commands.add_parser("sync")
    one.add_argument("catalog", type=Path)
    one.add_argument("--downloads", type=Path, default=Path("downloads"))
    one = commands.add_parser("towns")
    one.add_argument("source")
    one.add_argument("root")
    one.add_argument("--version", default="v1")
    one = commands.add_parser("reindex")
    one.add_argument("towns", help="a dataset, or with --latest a folder of datasets")
    one.add_argument("index")
    one.add_argument("--embedder", type=_named, default=jobs.hashed_words, help="module:function")
    one.add_argument("--collection", default=jobs.COLLECTIONS[0])
    one.add_argument("--latest", nargs="+", metavar="PATTERN", help="take the last name in the folder that matches")
    one.add_argument("--force", action="store_true")
    one = commands.add_parser("export")
    one.add_argument("dataset")
    one.add_argument("target")
    one.add_argument("--salt", default="")
    one.add_argument("--whole", action="store_true", help="keep every column")
    one.add_argument("--anonymize", action="store_true")
    one.add_argument("--gold", nargs="*", help="folders of the gold layer")
    one.add_argument("--store", help="a folder of any file system")
    one = commands.add_parser("prioritize")
    one.add_argument("catalog")
    one.add_argument("report")
    one = commands.add_parser("metrics")
    one.add_argument("events")
    one = commands.add_parser("retention")
    one.add_argument("folders", nargs="+")
    one.add_argument("--days", type=int, default=RETENTION_DAYS)
    one = commands.add_parser("backup")
    one.add_argument("database", type=Path)
    one.add_argument("folder", type=Path)
    one = commands.add_parser("restore")
    one.add_argument("copy", type=Path)
    one.add_argument("database", type=Path)
    return whole


def run(given: argparse.Namespace):
    if given.command == "backup":
        return {"backup": str(stores.backup(given.database, given.folder, datetime.now(UTC).strftime("%Y%m%d_%H%M%S")))}
    if given.command == "restore":
        return {"restored": str(stores.restore(given.copy, given.database))}
    if given.command == "sync":
        return jobs.sync(json.loads(given.catalog.read_text()), given.downloads)
    spark = session()
    if given.command in ("medallion", "crosswalk"):
        inputs = medallion.Inputs(dict(s.split("=", 1) for s in given.sources), given.cycles, given.year, database=given.database)
        return (medallion.run if given.command == "medallion" else jobs.crosswalk)(spark, inputs, given.root, given.version)
    if given.command == "ingest":
        given.downloads.mkdir(parents=True, exist_ok=True)
        return jobs.ingest(spark, json.loads(given.catalog.read_text()), given.root, given.downloads)
    if given.command == "towns":
        return jobs.publish_towns(spark, given.source, given.root, given.version)
    if given.command == "reindex":
        towns = lake.latest_file(spark, given.towns, given.latest) if given.latest else given.towns
        if towns is None:
            raise FileNotFoundError(f"nothing like {given.latest} in {given.towns}")
        return jobs.reindex(spark, towns, given.index, given.embedder, given.collection, given.force)
    if given.command == "export":
        return jobs.export(spark, given.dataset, given.target, given.salt, not given.whole, given.anonymize, given.gold, given.store)
    if given.command == "prioritize":
        return jobs.prioritize(spark, given.catalog, given.report)
    if given.command == "metrics":
        return assistant.snapshot(spark, given.events)
    before = int((time.time() - given.days * 86400) * 1000)
    return {folder: lake.expire(spark, folder, before) for folder in given.folders}


def main(argv: list[str] | None = None) -> None:
    print(json.dumps(run(parser().parse_args(argv)), ensure_ascii=False, indent=2, default=str))


if __name__ == "__main__":
    main()
