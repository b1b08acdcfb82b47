"""Command line: init, transit, polish, extract, retranslate, review, export, status, segment, terms, unlock. Exit codes: 0 done, 1 error, 2 done in part."""

from __future__ import annotations

import argparse
import json
import sys

from pyspark.sql import SparkSession

from quire.sources.state import Options, read_options
from quire.workflow import Workflow


def parser() -> argparse.ArgumentParser:
    top = argparse.ArgumentParser(prog="quire", description=__doc__)
    top.add_argument("--state", default="state", help="state folder, any file system that Spark reaches")
    top.add_argument("--config", help="TOML file of options")
    to = top.add_subparsers(dest="command", required=True)
    to.add_parser("init").add_argument("path")
    for name in ("transit", "polish", "review", "status", "extract", "retranslate", "unlock", "segment"):
        to.add_parser(name).add_argument("project")
    to.choices["retranslate"].add_argument("term", help="whose titles and segments are translated anew")
    one = to.choices["segment"]
    one.add_argument("id")
    one.add_argument("--revision", type=int, help="the revision that an edit is based on")
    one.add_argument("--expected", help="the text that an edit is based on")
    edit = one.add_mutually_exclusive_group()
    edit.add_argument("--target")
    edit.add_argument("--restore", type=int)
    edit.add_argument("--adopt")
    edit.add_argument("--preview", action="store_true")
    to.choices["transit"].add_argument("--chapter", type=int)
    out = to.add_parser("export")
    out.add_argument("project")
    out.add_argument("output")
    out.add_argument("--format", choices=("txt", "epub"), default="txt")
    out.add_argument("--bilingual", action="store_true")
    out.add_argument("--source-first", action="store_true")
    terms = to.add_parser("terms").add_subparsers(dest="action", required=True)
    terms.add_parser("list")
    terms.add_parser("conflicts")
    fix = terms.add_parser("resolve")
    fix.add_argument("source")
    fix.add_argument("target")
    return top


def run(args: argparse.Namespace, spark: SparkSession) -> int:
    options = Options()
    if args.config:
        with open(args.config, encoding="utf-8") as f:
            options = read_options(f.read())
    own = Workflow(spark, args.state, options=options)
    if args.command == "init":
        print("\n".join(own.add(args.path)))
    elif args.command == "transit":
        return 2 if own.translate(args.project, args.chapter) else 0
    elif args.command == "polish":
        return 2 if own.polish(args.project) else 0
    elif args.command == "review":
        name, issues = own.review(args.project)
        count = issues.count()
        print(f"{name}: {count} issues")
        return 2 if count else 0
    elif args.command == "status":
        for r in own.status(args.project).toLocalIterator():
            print(f"{r.translated}/{r.total}\t{r.title}")
    elif args.command == "extract":
        print(f"{own.extract(args.project)} terms")
    elif args.command == "retranslate":
        return 2 if own.retranslate(args.project, args.term) else 0
    elif args.command == "unlock":
        own.unlock(args.project)
    elif args.command == "segment":
        if args.preview:
            found = own.preview(args.project, args.id)
        elif (args.target, args.restore, args.adopt) != (None, None, None):
            found = own.save(args.project, args.id, args.revision, args.expected, args.target, args.restore, args.adopt)
        else:
            found = own.detail(args.project, args.id)
        print(json.dumps(found, ensure_ascii=False, indent=1))
    elif args.command == "export":
        with open(args.output, "wb") as f:
            f.write(bytes(own.export(args.project, args.bilingual, args.source_first, args.format).first().content))
    elif args.action == "resolve":
        own.resolve(args.source, args.target)
    else:
        rows = own.terms().where("not deleted")
        for r in (rows.where("status = 'conflict'") if args.action == "conflicts" else rows).orderBy("source").toLocalIterator():
            print(f"{r.source}\t{r.target}\t{r.status}\t{r.policy}")
    return 0


def main(argv: list[str] | None = None) -> int:
    args = parser().parse_args(argv)
    spark = SparkSession.builder.appName("quire").config("spark.sql.session.timeZone", "UTC").getOrCreate()
    try:
        return run(args, spark)
    except Exception as e:  # noqa: BLE001 - a command ends with its message
        print(f"error: {e}", file=sys.stderr)
        return 1


if __name__ == "__main__":
    sys.exit(main())
