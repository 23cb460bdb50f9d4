"""Command line: ``python -m lodestone.plans.cli index --repo PATH --query TEXT``."""

from __future__ import annotations

import argparse
import os
import sys
from collections.abc import Sequence

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from lodestone.operators.records import PREFIX, resolved_settings, settings_error, settings_json
from lodestone.operators.retrieve import TOOL_TOP_K, TOP_K
from lodestone.plans.repo_index import SECTIONS, RepoIndex
from lodestone.sources.tasks import read_tasks


def _count(value: str) -> int:
    if not value.lstrip("+").isdigit() or int(value) < 1:
        raise argparse.ArgumentTypeError("top_k must be >= 1.")
    return int(value)


def parser() -> argparse.ArgumentParser:
    own = argparse.ArgumentParser(prog="lodestone", description="Text-corpus queries over a file tree.")
    commands = own.add_subparsers(dest="command", required=True)
    for command, about in (("load-task", "print a task manifest"), ("run", "print a task manifest; there is no agent runtime")):
        commands.add_parser(command, help=about).add_argument("--task-file", required=True)
    for command, top_k, needs_query in (("index", TOP_K, False), ("retrieve", TOOL_TOP_K, True)):
        sub = commands.add_parser(command)
        sub.add_argument("--repo", required=True)
        sub.add_argument("--query", required=needs_query, default="")
        sub.add_argument("--top-k", type=_count, default=top_k)
    config = commands.add_parser("config", help="print the resolved settings")
    config.add_argument("--check-api-key", action="store_true")
    return own


def main(argv: Sequence[str] | None = None, spark: SparkSession | None = None) -> int:
    args = parser().parse_args(argv)
    spark = spark or SparkSession.builder.appName("lodestone").getOrCreate()
    if args.command in ("load-task", "run"):
        task = read_tasks(spark, args.task_file).first()
        if task.error:
            raise ValueError(task.error)
        print(task.text)
    elif args.command == "index":
        sections = RepoIndex(spark, args.repo).snapshot(args.query, args.top_k)
        print("\n\n".join(f"# {title}\n{sections[section]}" for section, title in SECTIONS.items()))
    elif args.command == "retrieve":
        print(RepoIndex(spark, args.repo).retrieve(args.query, args.top_k))
    else:
        env = {k: v for k, v in os.environ.items() if k.startswith((PREFIX, "OPENAI_"))}
        one = spark.createDataFrame([(env,)], "env map<string,string>").select(resolved_settings(F.col("env")).alias("s"))
        row = one.select(settings_json(F.col("s")).alias("json"), settings_error(F.col("s")).alias("error")).first()
        if args.check_api_key and row.error:
            raise RuntimeError(row.error)
        print(row.json)
    return 0


if __name__ == "__main__":
    sys.exit(main())
