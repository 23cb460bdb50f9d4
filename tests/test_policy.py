from __future__ import annotations

import json

import pytest
from pyspark.sql import functions as F

from lodestone.functions.paths import path_verdict
from lodestone.operators import policy

ROOT = "/work/repo"


def verdicts(spark, values, build):
    df = spark.createDataFrame(list(enumerate(values)), "i int, x string")
    return [r.v for r in df.select("i", build(F.col("x")).alias("v")).orderBy("i").collect()]


def test_paths(spark):
    cases = {
        "a.py": None,
        ".": None,
        "a/../b.py": None,
        f"{ROOT}/x/y.txt": None,
        "": "Path must be non-empty.",
        "  ": "Path must be non-empty.",
        "../x": "Path escapes repository root: ../x",
        "a/../../x": "Path escapes repository root: a/../../x",
        "/etc/passwd": "Path escapes repository root: /etc/passwd",
        "/work/repo2/x": "Path escapes repository root: /work/repo2/x",
        ".git/config": f"Refusing to access generated or internal path: {ROOT}/.git/config",
        "x/build/y": f"Refusing to access generated or internal path: {ROOT}/x/build/y",
        "deep/.ENV": "Refusing to access protected file: .ENV",
        "k.Pem": "Refusing to access protected file: k.Pem",
        "build/id_rsa": f"Refusing to access generated or internal path: {ROOT}/build/id_rsa",
    }
    assert verdicts(spark, list(cases), lambda c: path_verdict(c, ROOT)) == list(cases.values())
    assert verdicts(spark, [None], lambda c: path_verdict(c, ROOT)) == ["Path must be a string."]


def test_links(spark):
    links = F.array(F.lit("link"), F.lit("d/l.py"))
    cases = {"link": True, "link/x": True, "d/l.py": True, "d/other": False, "d/../link/y": True, "links": False}
    got = verdicts(spark, list(cases), lambda c: path_verdict(c, ROOT, links))
    assert got == [f"Refusing to follow symlink path: {p}" if bad else None for p, bad in cases.items()]


COMMANDS = {
    "": None,
    "pytest -q": None,
    "pytest -s": None,
    "/usr/bin/pytest tests/test_a.py::test_b": None,
    "python3 -m pytest -k 'a or b'": None,
    "python -m unittest": None,
    "python -m unittest discover -s tests": None,
    "npm test": None,
    "npm run test": None,
    "pnpm test -- --watch": None,
    "yarn test": None,
    "pytest --cov-report xml:cov.xml": None,
    "pytest | cat": "Dangerous shell syntax blocked: pytest | cat",
    "pytest; ls": "Dangerous shell syntax blocked: pytest; ls",
    "sudo pytest": "Dangerous command blocked: sudo pytest",
    'pytest -k "add x"': 'Dangerous command blocked: pytest -k "add x"',
    "pytest 'open": "Test command cannot be parsed: pytest 'open",
    "make test": policy.NOT_ALLOWED,
    "python -m pip": policy.NOT_ALLOWED,
    "npm install": policy.NOT_ALLOWED,
    "pytest --pyargs os": "pytest --pyargs is not allowed for repository-scoped test runs.",
    "pytest ../x": "Path escapes repository root: ../x",
    "pytest /tmp/t.py::a": "Path escapes repository root: /tmp/t.py",
    "pytest --rootdir=/etc": "Path escapes repository root: /etc",
    "pytest --rootdir ../y": "Path escapes repository root: ../y",
    "pytest --rootdir": "Test command option requires a path: --rootdir",
    "pytest --rootdir=": "Test command path must be non-empty.",
    "pytest --cov-report html:/tmp/h": "Path escapes repository root: /tmp/h",
    "pytest --other=/etc/x": "Path escapes repository root: /etc/x",
    "pytest --other=plain": None,
    "python -m unittest os.path": "unittest commands must use repository-scoped discover.",
    "python -m unittest discover -s /tmp": "Path escapes repository root: /tmp",
    "yarn test ../z": "Path escapes repository root: ../z",
    "pytest ./.env": "Refusing to access protected file: .env",
    "pytest ../x --rootdir": "Path escapes repository root: ../x",
}


def test_commands(spark):
    assert dict(zip(COMMANDS, verdicts(spark, list(COMMANDS), lambda c: policy.command_verdict(c, ROOT)), strict=True)) == COMMANDS
    assert verdicts(spark, [None], lambda c: policy.command_verdict(c, ROOT)) == [None]


@pytest.mark.parametrize(
    ("tool", "arguments", "want"),
    [
        ("read_file", {}, "read_file requires a path."),
        ("read_file", {"path": ""}, "read_file requires a path."),
        ("read_file", {"path": None}, "read_file requires a path."),
        ("read_file", {"path": 7}, "Path must be a string."),
        ("read_file", {"path": "a.py"}, None),
        ("write_file", {"path": "../a.py"}, "Path escapes repository root: ../a.py"),
        ("replace_in_file", {"path": ".env"}, "Refusing to access protected file: .env"),
        ("list_files", {}, None),
        ("grep", {"path": None}, "Path must be a string."),
        ("grep", {"path": ".git"}, f"Refusing to access generated or internal path: {ROOT}/.git"),
        ("run_tests", {}, None),
        ("run_tests", {"command": "curl x"}, "Dangerous command blocked: curl x"),
        ("anything", {"path": "/etc"}, None),
        ("grep", [1], "Tool arguments must be a JSON object."),
    ],
)
def test_tool_calls(spark, tool, arguments, want):
    df = spark.createDataFrame([(tool, json.dumps(arguments))], "tool string, a string")
    assert df.select(policy.tool_call_verdict(F.col("tool"), F.parse_json("a"), ROOT).alias("v")).first().v == want


def test_notes(spark):
    rows = [("write_file", True), ("replace_in_file", False), ("run_tests", False), ("run_tests", True), ("grep", True)]
    df = spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "i int, tool string, ok boolean")
    got = [r.n for r in df.select("i", policy.post_tool_note(F.col("tool"), F.col("ok")).alias("n")).orderBy("i").collect()]
    assert got == [policy.EDITED_NOTE, None, policy.FAILED_NOTE, None, None]
