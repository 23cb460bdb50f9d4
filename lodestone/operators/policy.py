"""Which tool calls and test commands are allowed, as verdict columns: a message, or null.

The first rule that is broken gives the message.  Only splitting a command line
into words needs Python (``shlex``, in a pandas UDF); the rules are expressions.
Paths are judged by their text, and against known links where they are given.
"""

from __future__ import annotations

import shlex

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, StringType

from lodestone.functions.paths import path_verdict
from lodestone.functions.text import let, strip

# What the rules look for, and their messages.
DANGEROUS = ("rm -rf", "sudo", "mkfs", "dd ", ":(){", "chmod -r 777", "chown -r", "curl ", "wget ", "killall", "pkill")
SHELL_TOKENS = ("|", ">", "<", ";", "&&", "||", "`", "$(")
DEFAULT_COMMAND = "pytest -q"
PYTEST_PATH_OPTIONS = (
    "--basetemp", "--cache-dir", "--confcutdir", "--cov-config", "--cov-report", "--html",
    "--json-report-file", "--junit-xml", "--junitxml", "--log-file", "--rootdir", "--template",
)
UNITTEST_PATH_OPTIONS = ("-s", "--start-directory", "-t", "--top-level-directory")
REPORT_KINDS = ("annotate", "html", "json", "lcov", "term", "term-missing", "xml")
NOT_ALLOWED = "Test command is not in allowlist. Use pytest, python -m pytest, python -m unittest, npm test, npm run test, pnpm test, or yarn test."
EDITED_NOTE = "File edited. Inspect git_diff or run tests before finishing."
FAILED_NOTE = "Tests failed. Inspect stdout and stderr before editing again."
DEFAULT_ROOT = "/repo"


@F.pandas_udf(ArrayType(StringType()))
def command_words(command: pd.Series) -> pd.Series:
    """The words of a command line; null where quoting does not end."""

    def split(text):
        try:
            return shlex.split(text)
        except ValueError:
            return None

    return pd.Series([None if c is None else split(c) for c in command], dtype=object)


def has_shell_token(command: Column) -> Column:
    return F.exists(F.array(*[F.lit(t) for t in SHELL_TOKENS]), lambda t: F.contains(command, t))


def has_dangerous_part(command: Column) -> Column:
    return F.exists(F.array(*[F.lit(t) for t in DANGEROUS]), lambda t: F.contains(F.lower(command), t))


def _program(words: Column) -> Column:
    return F.lower(F.element_at(F.split(F.get(words, 0), "/"), -1))


def _is_python(program: Column) -> Column:
    return program.startswith("python")


def is_allowed_runner(words: Column) -> Column:
    """pytest, python -m pytest or unittest, npm test, npm run test, pnpm test, yarn test."""
    program, first, second = _program(words), F.get(words, 1), F.get(words, 2)
    module = _is_python(program) & (first == "-m") & second.isin("pytest", "unittest")
    script = ((program == "npm") & ((first == "test") | ((first == "run") & (second == "test")))) | (program.isin("pnpm", "yarn") & (first == "test"))
    return F.coalesce((program == "pytest") | module | script, F.lit(False))


def _looks_like_path(value: Column) -> Column:
    return F.split_part(value, F.lit("::"), F.lit(1)).rlike(r"^\.|[/\\]")


def _path_of(value: Column) -> Column:
    """The path in an argument: without a test id behind ``::`` and a report kind before ``:``."""
    path = F.split_part(value, F.lit("::"), F.lit(1))
    known = r"^(?:" + "|".join(REPORT_KINDS) + r"):(.+)$"
    return F.when(path.rlike(f"(?s){known}"), F.regexp_extract(path, f"(?s){known}", 1)).otherwise(path)


def _argument_paths(args: Column, options: tuple[str, ...]) -> Column:
    """found: the paths among arguments, in order; open: an option that waits for its path."""
    start = F.struct(F.array().cast("array<string>").alias("found"), F.lit(None).cast("string").alias("open"))
    names = F.array(*[F.lit(o) for o in options]).cast("array<string>")

    def step(acc: Column, token: Column) -> Column:
        value = F.substr(token, F.instr(token, "=") + 1)
        own_value = F.exists(names, lambda o: F.startswith(token, F.concat(o, F.lit("="))))
        inline = F.startswith(token, F.lit("--")) & F.contains(token, F.lit("="))
        path = (
            F.when(acc["open"].isNotNull(), token)
            .when(F.array_contains(names, token), F.lit(None))
            .when(own_value, value)
            .when(inline, F.when(_looks_like_path(value), value))
            .when(F.startswith(token, F.lit("-")), F.lit(None))
            .otherwise(F.when(_looks_like_path(token), token))
        )
        opened = F.when(acc["open"].isNull() & F.array_contains(names, token), token)
        return F.struct(F.when(path.isNull(), acc.found).otherwise(F.array_append(acc.found, path)).alias("found"), opened.alias("open"))

    return F.aggregate(args, start, step)


def _paths_verdict(args: Column, options: tuple[str, ...], root: str, links: Column | None) -> Column:
    def one(value: Column) -> Column:
        path = _path_of(value)
        return F.when(path == "", F.lit("Test command path must be non-empty.")).otherwise(path_verdict(path, root, links))

    def judged(read: Column) -> Column:
        waiting = F.when(read["open"].isNotNull(), F.concat(F.lit("Test command option requires a path: "), read["open"]))
        return F.coalesce(F.get(F.filter(F.transform(read.found, one), lambda v: v.isNotNull()), F.lit(0)), waiting)

    return let(_argument_paths(args, options), judged)


def arguments_verdict(words: Column, root: str, links: Column | None = None) -> Column:
    """What speaks against the arguments of an allowed runner."""
    rest = lambda n: F.slice(words, n + 1, F.greatest(F.size(words) - n, F.lit(0)))
    program = _program(words)
    module = _is_python(program) & (F.get(words, 1) == "-m") & (F.size(words) >= 3)
    unit, py = module & (F.get(words, 2) == "unittest"), module & (F.get(words, 2) == "pytest")

    def pytest_verdict(args: Column) -> Column:
        banned = F.when(F.array_contains(args, "--pyargs"), F.lit("pytest --pyargs is not allowed for repository-scoped test runs."))
        return F.coalesce(banned, _paths_verdict(args, PYTEST_PATH_OPTIONS, root, links))

    def unittest_verdict(args: Column) -> Column:
        first = F.get(F.filter(args, lambda a: ~F.startswith(a, F.lit("-"))), F.lit(0))
        scoped = F.when(first != "discover", F.lit("unittest commands must use repository-scoped discover."))
        return F.coalesce(scoped, _paths_verdict(args, UNITTEST_PATH_OPTIONS, root, links))

    return F.when(unit, let(rest(3), unittest_verdict)).when(py, let(rest(3), pytest_verdict)).when(program == "pytest", let(rest(1), pytest_verdict)).otherwise(let(rest(1), lambda a: _paths_verdict(a, (), root, links)))


def command_verdict(command: Column, root: str = DEFAULT_ROOT, links: Column | None = None) -> Column:
    """Why a test command may not run, or null; null and blank stand for the default command."""
    given = F.coalesce(command, F.lit(""))
    normal = F.when(strip(given) == "", F.lit(DEFAULT_COMMAND)).otherwise(strip(given))
    said = lambda text: F.concat(F.lit(f"{text}: "), given)
    parsed = lambda w: F.when(w.isNull(), said("Test command cannot be parsed")).when(~is_allowed_runner(w), F.lit(NOT_ALLOWED)).otherwise(arguments_verdict(w, root, links))
    return F.when(has_shell_token(normal), said("Dangerous shell syntax blocked")).when(has_dangerous_part(normal), said("Dangerous command blocked")).otherwise(let(command_words(normal), parsed))


def tool_call_verdict(tool: Column, arguments: Column, root: str = DEFAULT_ROOT, links: Column | None = None, commands: bool = True) -> Column:
    """Why a tool call is blocked before it runs, or null.  ``arguments`` is a variant; tools without a rule pass.

    Without ``commands`` no call is a test command, and their rules are left out of the plan.
    """
    field = lambda key: F.try_variant_get(arguments, f"$.{key}", "variant")
    kind = lambda v: F.regexp_extract(F.schema_of_variant(v), "^[A-Z]+", 0)
    path, shape = field("path"), F.schema_of_variant(arguments)
    text = F.when(kind(path) == "STRING", F.try_variant_get(path, "$", "string"))
    # What Python takes for false: absent, null, empty, zero.
    empty = path.isNull() | F.coalesce(F.to_json(path).isin("null", '""', "0", "0.0", "false", "[]", "{}"), F.lit(True))
    needed = F.when(empty, F.concat(tool, F.lit(" requires a path."))).otherwise(path_verdict(text, root, links))
    optional = path_verdict(F.when(path.isNull(), F.lit(".")).otherwise(text), root, links)
    command = field("command")
    given = F.when(command.isNull() | F.to_json(command).isin("null", '""', "0", "false", "[]", "{}"), F.lit(DEFAULT_COMMAND)).otherwise(F.try_variant_get(command, "$", "string"))
    verdict = (
        F.when(~F.startswith(shape, F.lit("OBJECT")), F.lit("Tool arguments must be a JSON object."))
        .when(tool.isin("read_file", "write_file", "replace_in_file"), needed)
        .when(tool.isin("list_files", "grep"), optional)
    )
    return verdict.when(tool == "run_tests", command_verdict(given, root, links)) if commands else verdict


def post_tool_note(tool: Column, ok: Column) -> Column:
    """What is added to the output of a tool, or null."""
    return F.when(tool.isin("write_file", "replace_in_file") & ok, F.lit(EDITED_NOTE)).when((tool == "run_tests") & ~ok, F.lit(FAILED_NOTE))
