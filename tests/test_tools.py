from __future__ import annotations

import json
import os

import pytest
from pyspark.sql import functions as F

from lodestone.operators import policy
from lodestone.plans import cli
from lodestone.plans import tools as tools_module
from lodestone.plans.tools import Blocked, RepoTools, ToolRegistry, ToolResult

from .test_files import write


@pytest.fixture
def tools(spark, tmp_path):
    write(tmp_path, {"calc.py": "def minus(a, b):\n    return a - b\n", "d/x.txt": "needle\nneedle\n", "credentials.json": "needle"})
    return RepoTools(spark, str(tmp_path)), tmp_path


def test_registry(spark):
    own = ToolRegistry()
    for bad in (("", "x"), ("x", " ")):
        with pytest.raises(ValueError):
            own.register(*bad, None)
    one = lambda _: spark.range(1).select(F.lit(True).alias("ok"), F.lit("fine").alias("output"))
    own.register("b", " first ", one)
    own.register("a", "second", lambda _: spark.range(1))
    own.register("late", "fails when it runs", lambda _: spark.range(1).select(F.lit(True).alias("ok"), F.raise_error(F.lit("boom")).cast("string").alias("output")))
    assert own.tool_names == ["b", "a", "late"]
    assert own.descriptions().split("\n")[:3] == ["Available tools:", "- b: first", "- a: second"]
    assert [(r.ord, r.name) for r in own.catalog(spark).orderBy("ord").collect()] == [(0, "b"), (1, "a"), (2, "late")]
    assert own.run("b", {}) == ToolResult(True, "fine")
    assert own.run("zz", {}).output == "Unknown tool: zz"
    assert own.run("b", []).output == "Tool arguments must be a JSON object."
    assert own.run("a", {}).output == "Tool error: a returned an invalid result."
    late = own.run("late", {})
    assert not late.ok and late.output.startswith("Tool error: ") and "boom" in late.output
    own.register("a", "again", one)
    assert own.tool_names == ["b", "a", "late"] and own.run("a", {}).ok


def test_reading_tools(tools):
    run, _ = tools[0].run, tools[1]
    assert run("list_files").output == "calc.py\nd/x.txt"
    assert run("list_files", {"path": "nope"}) == ToolResult(False, "Path does not exist: nope")
    assert run("read_file", {"path": "calc.py", "limit": 3}).output == "def\n... file truncated"
    assert run("read_file", {"path": "no.py", "limit": 0}).output == "File not found: no.py"
    assert run("read_file", {"path": "calc.py", "limit": True}).output == "read_file limit must be a positive integer."
    assert run("grep", {"pattern": "needle"}).output == "d/x.txt:1: needle\nd/x.txt:2: needle"
    assert run("grep", {"pattern": "["}).output.startswith("Invalid regex: ")
    assert run("grep", {}).output == "grep requires a non-empty pattern."
    assert run("retrieve_context", {"query": "minus"}).output.startswith("## calc.py score=6.39")
    assert run("retrieve_context", {"query": "needle"}).output.count("## ") == 1
    assert run("retrieve_context", {"query": " "}).output == "retrieve_context requires a non-empty query."
    assert run("retrieve_context", {"query": "x", "top_k": 0}).output == "top_k must be >= 1."
    assert run("finish").output == "Finished." and run("finish", {"summary": "all"}).output == "all"
    assert run("grep", [1]).output == "Tool arguments must be a JSON object."


def test_edits_are_saved_and_noted(tools):
    run, root = tools[0].run, tools[1]
    done = run("replace_in_file", {"path": "calc.py", "old": "a - b", "new": "b - a"})
    assert done.ok and "+    return b - a" in done.output and done.output.endswith(f"\n\nHook note: {policy.EDITED_NOTE}")
    assert (root / "calc.py").read_text() == "def minus(a, b):\n    return b - a\n"
    twice = run("replace_in_file", {"path": "d/x.txt", "old": "needle", "new": "n"})
    assert not twice.ok and twice.output.startswith("old text occurs 2 times")
    assert run("replace_in_file", {"path": "d/x.txt", "old": "", "new": "n"}).output == "replace_in_file requires a non-empty old snippet."
    assert run("replace_in_file", {"path": "d/x.txt", "old": 1, "new": "n"}).output == "replace_in_file requires string old and new fields."
    assert run("write_file", {"path": "new/f.txt", "content": "hi\n"}).ok and (root / "new/f.txt").read_text() == "hi\n"
    assert run("write_file", {"path": "d", "content": ""}).output == "Path is not a file: d"
    assert run("write_file", {"path": "q.txt"}).output == "write_file requires string content."


def test_blocked_calls(tools):
    run, root = tools[0].run, tools[1]
    (root / "link").symlink_to("/etc")
    for name, arguments in (("read_file", {"path": "../x"}), ("write_file", {"path": ".git/x", "content": ""}), ("read_file", {"path": "credentials.json"}), ("list_files", {"path": "link/passwd"}), ("read_file", {})):
        result = run(name, arguments)
        assert result.blocked and not result.ok and result.reason == result.output


def test_no_link_leads_out_of_the_root(tools, tmp_path_factory):
    """Also not one that ``..`` leaves again, or one to a folder within the tree."""
    run, root = tools[0].run, tools[1]
    outside = tmp_path_factory.mktemp("outside")
    (outside / "sub").mkdir()
    (root / "link").symlink_to(outside / "sub")
    (root / "inner").symlink_to(root / "d")
    write = ("write_file", {"content": "x"})
    calls = [(*write, path) for path in ("link/../evil.txt", "link/x.txt", f"{root}/link/../evil.txt")]
    calls += [("read_file", {}, "link/../calc.py"), ("list_files", {}, "d/../link/.."), ("replace_in_file", {"old": "a", "new": "b"}, "inner/x.txt")]
    for name, more, path in calls:
        result = run(name, {"path": path, **more})
        assert result.blocked and result.reason == f"Refusing to follow symlink path: {path}", (name, path)
    assert sorted(p.name for p in outside.rglob("*")) == ["sub"] and "evil.txt" not in {p.name for p in root.iterdir()}
    with pytest.raises(Blocked, match="^Path escapes repository root: link/../evil.txt$"):
        tools[0]._save("link/../evil.txt", "x")
    # A folder that became a link after it was resolved is not followed.
    (root / "late").symlink_to(outside)
    with pytest.raises(Blocked):
        tools[0]._save("late/x.txt", "x")
    assert run("read_file", {"path": "d/../calc.py"}).ok and run("read_file", {"path": f"{root}/calc.py"}).ok


def test_a_plan_can_refuse(spark):
    def refuse(arguments):
        raise Blocked(f"not {arguments['what']}")

    own = ToolRegistry(no=("never", refuse))
    assert own.run("no", {"what": "this"}) == ToolResult(False, "not this", True, "not this")
    assert own.run("no", {}) == ToolResult(False, "Tool error: KeyError: 'what'")


def test_every_failure_is_a_result(tools):
    run, root = tools[0].run, tools[1]
    for path in ("calc.py/x.txt", "calc.py/y/x.txt", "nul\0.txt", "a" * 300):
        result = run("write_file", {"path": path, "content": "x"})
        assert not result.ok and result.output.startswith("Tool error: ") and policy.EDITED_NOTE not in result.output, path
    (root / "ro").mkdir()
    (root / "ro").chmod(0o555)
    if not os.access(root / "ro", os.W_OK):
        assert run("write_file", {"path": "ro/x.txt", "content": "x"}).output.startswith("Tool error: PermissionError")
    (root / "ro").chmod(0o755)
    assert not run("read_file", {"path": "nul\0.txt"}).ok


def test_why_a_file_cannot_be_read(tools, monkeypatch):
    real = os.open

    def denied(path, *a, **b):
        if str(path).endswith("calc.py"):
            raise PermissionError(13, "Permission denied", path)
        return real(path, *a, **b)

    monkeypatch.setattr(tools_module.os, "open", denied)
    for name, more in (("read_file", {}), ("replace_in_file", {"old": "a", "new": "b"})):
        assert tools[0].run(name, {"path": "calc.py", **more}).output.startswith("File could not be read: [Errno 13] Permission denied")


def test_calls_read_what_they_are_about(spark, tools, monkeypatch):
    seen = []
    real = tools_module.scan_entries
    monkeypatch.setattr(tools_module, "scan_entries", lambda s, root, base=".", contents=True: seen.append((base, contents)) or real(s, root, base, contents))
    run = tools[0].run
    assert run("read_file", {"path": "calc.py"}).ok and run("finish").ok and run("list_files", {"path": "d"}).output == "d/x.txt"
    assert run("grep", {"pattern": "needle", "path": "d/x.txt"}).output.startswith("d/x.txt:1: needle")
    assert seen == [("calc.py", True), ("d", False), ("d/x.txt", True), ("d/x.txt", False)]


def test_arguments_that_are_no_json(tools):
    for arguments in ({"path": {1, 2}}, {"limit": float("nan")}, "x", 3):
        assert tools[0].run("read_file", arguments) == ToolResult(False, "Tool arguments must be a JSON object.")


def test_command_line(spark, tools, capsys, tmp_path_factory):
    root = tools[1]
    assert cli.main(["retrieve", "--repo", str(root), "--query", "minus", "--top-k", "1"], spark) == 0
    assert capsys.readouterr().out.startswith("## calc.py score=6.39")
    assert cli.main(["index", "--repo", str(root)], spark) == 0
    out = capsys.readouterr().out
    titles = [line[2:] for line in out.split("\n") if line.startswith("# ")]
    assert titles == ["Repository tree", "Symbol index", "Retrieval notes", "Project rules", "Important file previews"]
    task = tmp_path_factory.mktemp("task") / "t.json"
    task.write_text('{"repo": "r", "task": "t"}')
    assert cli.main(["load-task", "--task-file", str(task)], spark) == 0
    assert capsys.readouterr().out.startswith("id: unknown\n")
    assert cli.main(["config"], spark) == 0
    assert "api_key" not in json.loads(capsys.readouterr().out)
    for bad in (["retrieve", "--repo", str(root), "--query", "x", "--top-k", "0"], ["nothing"]):
        with pytest.raises(SystemExit) as stop:
            cli.main(bad, spark)
        assert stop.value.code == 2
