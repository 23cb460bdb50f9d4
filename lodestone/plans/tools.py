"""Named tools over a file tree, as one table of argument checks and plans.

A tool is a row of the registry: a name, a description and a plan, a function of
the call's arguments that returns a DataFrame whose first row has ``ok`` and
``output`` (and ``content`` for an edit).  Spark reports errors when a plan runs,
so running a tool runs its plan and turns what goes wrong into a result.  The
only thing the driver writes is the one file that an edit names; whether that lies
below the root is decided twice, by the rules and just before it is opened.
"""

from __future__ import annotations

import contextlib
import json
import os
from collections.abc import Callable
from typing import Any, NamedTuple

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestone.functions.paths import skipped
from lodestone.operators import edit, policy
from lodestone.operators import files as files_ops
from lodestone.operators.retrieve import TOOL_TOP_K, positive, retrieval_notes
from lodestone.sources.repo import checked_root, links_on, scan_entries

# What tools are called, what is said about them, and their messages.
ABOUT = {
    "list_files": '{"path": "."} list repository files under path.',
    "read_file": '{"path": "relative.py", "limit": 12000} read a text file.',
    "grep": '{"pattern": "regex", "path": "."} search text files with a regex.',
    "retrieve_context": '{"query": "symbol or task", "top_k": 5} retrieve relevant code snippets.',
    "replace_in_file": '{"path": "file.py", "old": "exact text", "new": "replacement"} make one exact replacement.',
    "write_file": '{"path": "file.py", "content": "full content"} overwrite a file.',
    "finish": '{"summary": "final answer"} finish the task.',
}
NOT_AN_OBJECT = "Tool arguments must be a JSON object."


class ToolResult(NamedTuple):
    ok: bool
    output: str
    blocked: bool = False
    reason: str = ""


class Refused(ValueError):
    """Arguments that a tool does not take."""


class Blocked(ValueError):
    """What a plan raises where a rule forbids the call; the result is marked as blocked."""


Plan = Callable[[dict[str, Any]], DataFrame]


def _required(checks: list[tuple[bool, str]]) -> None:
    """The message of the first check that fails."""
    for passed, message in checks:
        if not passed:
            raise Refused(message)


def _checked(check: Callable, *values: Any) -> Any:
    try:
        return check(*values)
    except ValueError as e:
        raise Refused(str(e)) from e


class ToolRegistry:
    """name -> (description, plan), in the order of first entry; a later entry of a name replaces it."""

    def __init__(self, **tools: tuple[str, Plan]) -> None:
        self.tools: dict[str, tuple[str, Plan]] = {}
        for name, (about, plan) in tools.items():
            self.register(name, about, plan)

    def register(self, name: str, description: str, plan: Plan) -> None:
        blank = [what for what, value in (("name", name), ("description", description)) if not value.strip()]
        if blank:
            raise ValueError(f"Tool {blank[0]} must be non-empty.")
        self.tools[name] = (description.strip(), plan)

    @property
    def tool_names(self) -> list[str]:
        return list(self.tools)

    def descriptions(self) -> str:
        return "\n".join(["Available tools:", *(f"- {name}: {about}" for name, (about, _) in self.tools.items())])

    def catalog(self, spark: SparkSession) -> DataFrame:
        """(ord, name, description) of the tools."""
        return spark.createDataFrame([(i, n, d) for i, (n, (d, _)) in enumerate(self.tools.items())], "ord int, name string, description string")

    def row(self, name: str, arguments: object) -> dict[str, Any]:
        """The first row of the tool's plan, or one that says why there is none."""
        try:
            _required([(name in self.tools, f"Unknown tool: {name}"), (isinstance(arguments, dict), NOT_AN_OBJECT)])
            made = self.tools[name][1](dict(arguments))
            _required([(isinstance(made, DataFrame) and {"ok", "output"} <= set(made.columns), f"Tool error: {name} returned an invalid result.")])
            return made.first().asDict()
        except Refused as e:
            return {"ok": False, "output": str(e)}
        except Blocked as e:
            return {"ok": False, "output": str(e), "blocked": True}
        except Exception as e:  # whatever a plan raises becomes an observation
            return {"ok": False, "output": _told(e)}

    def run(self, name: str, arguments: object) -> ToolResult:
        return result_of(self.row(name, arguments))


def _told(error: Exception) -> str:
    return f"Tool error: {type(error).__name__}: {error}"


def result_of(row: dict[str, Any]) -> ToolResult:
    blocked = bool(row.get("blocked"))
    return ToolResult(row["ok"], row["output"], blocked, row["output"] if blocked else "")


def read_plans(spark: SparkSession, root: str) -> dict[str, Plan]:
    """The plans that only read; each scans no more than the path that it is about."""

    def rows(base: str = ".", contents: bool = True) -> DataFrame:
        return scan_entries(spark, root, base, contents).where(~F.col("is_symlink"))

    def found(arguments: dict[str, Any]) -> str:
        path = relative(root, arguments.get("path", "."))
        _required([(os.path.exists(os.path.join(root, path)), f"Path does not exist: {arguments.get('path', '.')}")])
        return path

    def list_files(arguments: dict[str, Any]) -> DataFrame:
        base = found(arguments)
        return files_ops.list_report(rows(base, contents=False), base)

    def read_file(arguments: dict[str, Any]) -> DataFrame:
        file = one_file(spark, root, arguments)
        limit = _checked(positive, arguments.get("limit", files_ops.READ_CHARS), "read_file limit must be a positive integer.")
        return files_ops.read_text(file, limit).select(F.lit(True).alias("ok"), "output")

    def grep(arguments: dict[str, Any]) -> DataFrame:
        pattern, base = _checked(files_ops.checked_pattern, arguments.get("pattern")), found(arguments)
        return files_ops.grep_report(rows(base), pattern, base, names=rows(base, contents=False))

    def retrieve_context(arguments: dict[str, Any]) -> DataFrame:
        query = arguments.get("query")
        _required([(isinstance(query, str) and bool(query.strip()), "retrieve_context requires a non-empty query.")])
        return retrieval_notes(rows().where(~skipped(F.col("path"))), query, _checked(positive, arguments.get("top_k", TOOL_TOP_K)))

    def finish(arguments: dict[str, Any]) -> DataFrame:
        return spark.range(1).select(F.lit(str(arguments.get("summary") or "Finished.")).alias("output"))

    def done(plan: Plan) -> Plan:
        return lambda arguments: plan(arguments).select(F.lit(True).alias("ok"), "output")

    plans = {"list_files": list_files, "grep": grep, "retrieve_context": retrieve_context, "finish": finish}
    return {**{name: done(plan) for name, plan in plans.items()}, "read_file": read_file}


def edit_plans(spark: SparkSession, root: str) -> dict[str, Plan]:
    """The plans of edits: the first row has the new content."""

    def replace_in_file(arguments: dict[str, Any]) -> DataFrame:
        old, new = arguments.get("old"), arguments.get("new")
        texts = isinstance(old, str) and isinstance(new, str)
        _required([(texts, "replace_in_file requires string old and new fields."), (old != "", "replace_in_file requires a non-empty old snippet.")])
        file = one_file(spark, root, arguments)
        edits = spark.createDataFrame([(relative(root, arguments["path"]), old, new)], "path string, old string, new string")
        return edit.apply_replacements(file, edits)

    def write_file(arguments: dict[str, Any]) -> DataFrame:
        path, content = relative(root, arguments["path"]), arguments.get("content")
        is_folder = os.path.isdir(os.path.join(root, path))
        _required([(isinstance(content, str), "write_file requires string content."), (not is_folder, f"Path is not a file: {arguments['path']}")])
        edits = spark.createDataFrame([(path, content)], "path string, content string")
        return edit.apply_writes(scan_entries(spark, root, path), edits)

    return {"replace_in_file": replace_in_file, "write_file": write_file}


def relative(root: str, path: str) -> str:
    return os.path.relpath(os.path.join(root, path), root).replace(os.sep, "/")


def one_file(spark: SparkSession, root: str, arguments: dict[str, Any]) -> DataFrame:
    path = relative(root, arguments["path"])
    _required([(os.path.isfile(os.path.join(root, path)), f"File not found: {arguments['path']}")])
    try:
        os.close(os.open(os.path.join(root, path), os.O_RDONLY))
    except OSError as e:
        raise Refused(f"{files_ops.UNREADABLE}{e}") from e
    return scan_entries(spark, root, path)


class RepoTools:
    """The tools of one local tree."""

    def __init__(self, spark: SparkSession, root: str) -> None:
        self.spark, self.root = spark, checked_root(root)
        plans = {**read_plans(spark, self.root), **edit_plans(spark, self.root)}
        self.registry = ToolRegistry(**{name: (about, plans[name]) for name, about in ABOUT.items()})

    def run(self, name: str, arguments: object = None) -> ToolResult:
        """Judged by the rules, run, saved if it is an edit, and noted."""
        arguments = {} if arguments is None else arguments
        try:
            text = json.dumps(arguments if isinstance(arguments, dict) else None, allow_nan=False)
        except (TypeError, ValueError):
            text = "null"
        if text == "null":
            return ToolResult(False, NOT_AN_OBJECT)
        try:
            return self._run(name, arguments, text)
        except Exception as e:  # also what a path does that no file can have
            return ToolResult(False, _told(e))

    def _run(self, name: str, arguments: dict[str, Any], text: str) -> ToolResult:
        path = arguments.get("path", ".")
        links = F.array(*[F.lit(x) for x in links_on(self.root, path)] if isinstance(path, str) else []).cast("array<string>")
        call = self.spark.createDataFrame([(name, text)], "tool string, arguments string")
        blocked = call.select(policy.tool_call_verdict(F.col("tool"), F.parse_json("arguments"), self.root, links, commands=False).alias("v")).first().v
        if blocked:
            return ToolResult(False, blocked, True, blocked)
        found = self.registry.row(name, arguments)
        if found["ok"] and found.get("content") is not None:
            try:
                self._save(path, found["content"])
            except Blocked as e:
                found = {"ok": False, "output": str(e), "blocked": True}
            except Exception as e:
                found = {"ok": False, "output": _told(e)}
        result = result_of(found)
        if result.blocked:
            return result
        note = self.spark.createDataFrame([(name, found["ok"])], "tool string, ok boolean").select(policy.post_tool_note(F.col("tool"), F.col("ok")).alias("n")).first().n
        return result._replace(output=f"{result.output}\n\nHook note: {note}") if note else result

    def _save(self, path: str, content: str) -> None:
        """Writes one file, if it lies below the root by then.

        Folders and the file are opened one from the other and no link is followed,
        so what was found below the root is what is written.
        """
        target = os.path.realpath(os.path.join(self.root, path))
        if not target.startswith(self.root.rstrip("/") + "/"):
            raise Blocked(f"Path escapes repository root: {path}")
        *folders, name = os.path.relpath(target, self.root).split(os.sep)
        at = os.open(self.root, os.O_RDONLY | os.O_DIRECTORY)
        try:
            for folder in folders:
                with contextlib.suppress(FileExistsError):
                    os.mkdir(folder, dir_fd=at)
                below = os.open(folder, os.O_RDONLY | os.O_DIRECTORY | os.O_NOFOLLOW, dir_fd=at)
                os.close(at)
                at = below
            handle = os.open(name, os.O_WRONLY | os.O_CREAT | os.O_TRUNC | os.O_NOFOLLOW, 0o666, dir_fd=at)
        finally:
            os.close(at)
        with os.fdopen(handle, "w", encoding="utf-8") as file:
            file.write(content)
