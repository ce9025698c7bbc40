"""python -m lectern.cli HOME COMMAND ...: the archive from the command line."""

from __future__ import annotations

import argparse
import json
import sys
from pathlib import Path

from . import __version__
from .engine import Archive
from .session import local_session, ship


def main(argv: list[str] | None = None) -> int:
    p = argparse.ArgumentParser(prog="lectern")
    p.add_argument("home")
    c = p.add_subparsers(dest="command", required=True)
    for name, args in {"add": ["path"], "find": ["phrase"], "evidence": ["question"], "report": ["title", "phrase"], "backup": ["target"], "restore": ["source"], "task": ["file"], "verify": ["run"], "ask": ["question"], "status": [], "rebuild": [], "doctor": [], "version": []}.items():
        sub = c.add_parser(name)
        for a in args:
            sub.add_argument(a)
        if name in ("find", "evidence"):
            sub.add_argument("--limit", type=int, default=8)
    a = p.parse_args(argv)
    if a.command == "version":
        print(__version__)
        return 0
    spark = local_session()
    spark.sparkContext.setLogLevel("ERROR")
    ship(spark)
    archive = Archive(spark, a.home)
    show = lambda rows: [print(json.dumps(r.asDict(recursive=True), default=str, ensure_ascii=False)) for r in rows.toLocalIterator()]
    if a.command == "doctor":
        print(json.dumps({"faults": archive.doctor(), "spark": spark.version, "java": spark._jvm.java.lang.System.getProperty("java.version"), "python": sys.version.split()[0]}))
    elif a.command in ("add",):
        print(json.dumps(archive.add(a.path)))
        print(json.dumps(archive.rebuild()))
    elif a.command == "task":
        run = archive.run_task(Path(a.file).read_text())
        print(json.dumps(run))
        return int(run["state"] != "succeeded")
    elif a.command == "verify":
        faults = archive.verify_task(a.run)
        print(json.dumps(faults))
        return int(bool(faults))
    elif a.command == "ask":
        print(json.dumps(archive.ask(a.question)))
    elif a.command in ("rebuild", "status"):
        print(json.dumps(getattr(archive, a.command)()))
    elif a.command == "find":
        show(archive.find(a.phrase, a.limit))
    elif a.command == "evidence":
        show(archive.evidence(a.question, a.limit))
    elif a.command == "report":
        rows, errors = archive.report(a.title, a.phrase)
        show(rows)
        return int(not errors.isEmpty())
    elif a.command == "backup":
        archive.backup(a.target)
    elif a.command == "restore":
        Archive.restore(spark, a.source, a.home)
    return 0


if __name__ == "__main__":
    sys.exit(main())
