from __future__ import annotations

import datetime as dt
import json

import pytest
from pyspark.sql import functions as F

from lodestone.operators import edit, records
from lodestone.sources.tasks import read_tasks
from lodestone.streaming.records import stream_tool_calls

CALLS = {
    '{"tool": " grep ", "arguments": {"a": [1, null]}, "reason": " why "}': None,
    '{"tool": "grep", "reason": "no arguments"}': None,
    "{": "ToolCall JSON is invalid.",
    "[]": "ToolCall must be a JSON object.",
    '{"tool": " ", "reason": "x"}': "ToolCall.tool must be a non-empty string.",
    '{"tool": 7, "reason": "x"}': "ToolCall.tool must be a non-empty string.",
    '{"tool": "shell", "arguments": [], "reason": ""}': "Unknown tool: shell",
    '{"tool": "grep", "arguments": [], "reason": ""}': "ToolCall.arguments must be a JSON object.",
    '{"tool": "grep", "arguments": null, "reason": "x"}': "ToolCall.arguments must be a JSON object.",
    '{"tool": "grep", "arguments": {}, "reason": " "}': "ToolCall.reason must be a non-empty string.",
    '{"tool": "grep", "arguments": {}}': "ToolCall.reason must be a non-empty string.",
}


def test_tool_calls(spark):
    df = spark.createDataFrame([(t,) for t in CALLS], "text string")
    rows = {r.text: r for r in records.parse_tool_calls(df, "text", ["grep"]).withColumn("arguments", F.to_json("arguments")).collect()}
    assert {t: r.error for t, r in rows.items()} == CALLS
    first = rows[next(iter(CALLS))]
    assert (first.tool, json.loads(first.arguments), first.reason) == ("grep", {"a": [1, None]}, "why")
    assert rows[list(CALLS)[1]].arguments == "{}"
    assert records.parse_tool_calls(df).where("error like 'Unknown%'").count() == 0


def test_tool_calls_on_a_stream(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a.txt").write_text("\n".join(CALLS))
    out = stream_tool_calls(spark, str(tmp_path / "in"), ["grep"]).select("text", "error")
    run = out.writeStream.format("memory").queryName("calls").option("checkpointLocation", str(tmp_path / "state")).trigger(availableNow=True).start()
    run.awaitTermination(60)
    assert {r.text: r.error for r in spark.table("calls").collect()} == CALLS


def test_results_and_events_as_json(spark):
    df = spark.createDataFrame([("é", "r1", '{"k": null}', dt.datetime(2024, 5, 6, 7, 8, 9))], "event string, run_id string, payload string, at timestamp_ntz")
    line = df.select(records.trace_event_json(F.col("event"), F.parse_json("payload"), F.col("run_id"), F.col("at")).alias("j")).first().j
    assert line.index('"time"') < line.index('"run_id"') < line.index('"event"') < line.index('"payload"')
    assert json.loads(line) == {"time": "2024-05-06T07:08:09", "run_id": "r1", "event": "é", "payload": {"k": None}} and "é" in line
    result = records.tool_result(F.lit(True), F.lit("out"))
    call = F.struct(F.lit("grep").alias("tool"), F.parse_json(F.lit("{}")).alias("arguments"), F.lit("why").alias("reason"))
    row = spark.range(1).select(records.tool_result_json(result).alias("r"), records.tool_record_json(call, result).alias("b"), records.tool_call_json(call.tool, call.arguments, call.reason).alias("c")).first()
    assert json.loads(row.r) == {"ok": True, "output": "out", "blocked": False, "reason": ""}
    assert json.loads(row.b) == {"call": json.loads(row.c), "result": json.loads(row.r)}


def test_output_of_a_test_run(spark):
    row = spark.range(1).select(records.test_output(F.lit(1), F.lit(" a\n"), F.lit("b ")).alias("o")).first()
    assert row.o == "exit_status: 1\nstdout:\na\nstderr:\nb"


def test_event_and_state_checks(spark):
    df = spark.createDataFrame([("e", "r"), (" ", "r"), ("e", "")], "event string, run_id string")
    assert [r.x for r in df.select(records.trace_event_error(F.col("event"), F.col("run_id")).alias("x")).collect()] == [None, "TraceEvent.event must be non-empty.", "TraceEvent.run_id must be non-empty."]
    states = {r.repo_path: r for r in records.initial_states(spark.createDataFrame([("a", " fix it "), ("b", " ")], "repo_path string, task string")).collect()}
    good = states["a"]
    assert (good.task, good.steps, good.max_steps, good.done, good.tool_history, good.test_command, good.error) == ("fix it", 0, 8, False, [], None, None)
    assert len(good.run_id) == 36 and good.run_id != states["b"].run_id
    assert states["b"].error == "AgentState.task must be non-empty."


def test_task_manifests(spark, tmp_path):
    texts = {
        "a.json": ('{"id": "7",\n "repo": "r", "task": "t", "test_command": ""}', "id: 7\nsource: local\nrepo: r\ntask: t\ntest_command: not configured", None),
        "b.json": ('{"repo": "r", "task": "t", "source": "s", "test_command": "pytest"}', "id: unknown\nsource: s\nrepo: r\ntask: t\ntest_command: pytest", None),
        "c.json": ("[1]", None, "Task file must contain one JSON object."),
        "d.json": ('{"repo": " ", "task": "t"}', None, "Task file requires a non-empty 'repo' field."),
        "e.json": ('{"repo": "r", "task": 3}', None, "Task file requires a non-empty 'task' field."),
    }
    for name, (text, _, _) in texts.items():
        (tmp_path / name).write_text(text)
    got = {r.file.rsplit("/", 1)[1]: (r.text, r.error) for r in read_tasks(spark, str(tmp_path)).collect()}
    assert got == {name: (text, error) for name, (_, text, error) in texts.items()}


@pytest.mark.parametrize(
    ("env", "want", "error"),
    [
        ({}, {"provider": "openai", "use_fake_llm": False, "max_steps": 8, "base_url": None, "api_key_configured": False}, "No API key"),
        ({"LODESTONE_LLM_PROVIDER": " FAKE "}, {"provider": "fake", "use_fake_llm": True}, None),
        ({"LODESTONE_USE_FAKE_LLM": "Yes", "LODESTONE_MAX_STEPS": "3"}, {"provider": "openai", "use_fake_llm": True, "max_steps": 3}, None),
        ({"LODESTONE_API_KEY": "", "OPENAI_API_KEY": "k", "OPENAI_BASE_URL": "u"}, {"api_key_configured": True, "base_url": "u", "temperature": 0.1}, None),
        ({"LODESTONE_LLM_PROVIDER": "other", "LODESTONE_API_KEY": "k"}, {"provider": "other"}, "Unsupported LODESTONE_LLM_PROVIDER='other'. Supported providers: fake, openai."),
    ],
)
def test_settings(spark, env, want, error):
    df = spark.createDataFrame([(env,)], "env map<string,string>").select(records.resolved_settings(F.col("env")).alias("s"))
    row = df.select(records.settings_json(F.col("s")).alias("j"), records.settings_error(F.col("s")).alias("e")).first()
    got = json.loads(row.j)
    assert {k: got[k] for k in want} == want and "api_key" not in got
    assert (row.e is None) if error is None else row.e.startswith(error)


def test_edits(spark):
    files = spark.createDataFrame([("a.py", "x = 1\ny = 2\n"), ("b.py", "z\nz\n"), ("c.py", None)], "path string, content string")
    edits = spark.createDataFrame([("a.py", "x = 1", "x = 3"), ("b.py", "z", "w"), ("c.py", "q", ""), ("no.py", "a", "b")], "path string, old string, new string")
    done = edit.apply_replacements(files, edits)
    got = {r.path: r for r in done.collect()}
    assert got["a.py"].output == "--- a/a.py\n+++ b/a.py\n@@ -1,2 +1,2 @@\n-x = 1\n+x = 3\n y = 2"
    assert got["b.py"].output == "old text occurs 2 times; provide a more specific snippet." and not got["b.py"].ok
    assert got["c.py"].ok is False and got["no.py"].output == "File not found: no.py"
    after = {r.path: r.content for r in edit.updated_files(files, done).collect()}
    assert after == {"a.py": "x = 3\ny = 2\n", "b.py": "z\nz\n", "c.py": None}
    writes = edit.apply_writes(files, spark.createDataFrame([("a.py", "x = 1\ny = 2\n"), ("new/n.py", "hi")], "path string, content string"))
    got = {r.path: r.output for r in writes.collect()}
    assert got == {"a.py": "Wrote a.py with no textual diff.", "new/n.py": "--- a/new/n.py\n+++ b/new/n.py\n@@ -0,0 +1 @@\n+hi"}


def test_replace_once(spark):
    files = spark.createDataFrame([("a", "one the two"), ("b", "the the"), ("c", "")], "path string, content string")
    got = {r.path: (r.ok, r.error, r.content) for r in edit.replace_once(files, F.lit("the"), F.lit("THE")).collect()}
    assert got == {
        "a": (True, None, "one THE two"),
        "b": (False, "old text occurs 2 times; provide a more specific snippet.", "the the"),
        "c": (False, "old text not found; inspect the file before retrying.", ""),
    }
