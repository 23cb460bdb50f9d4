"""Typed records in JSON lines: tool calls, tool results, run states, trace events, task manifests, settings.

Dynamic parts are variants.  A check gives an error column, null where a record
is good; the first broken rule counts.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodestone.functions.text import is_true, strip

ALL_FIELDS = {"ignoreNullFields": "false"}
#: Providers that are known, and the defaults of settings.
PROVIDERS = ("fake", "openai")
DEFAULTS = {"MODEL": "gpt-4o-mini", "TEMPERATURE": "0.1", "MAX_STEPS": "8", "COMMAND_TIMEOUT": "60", "TRACE_DIR": "traces"}
#: The settings are read from names with this prefix.
PREFIX = "LODESTONE_"


def _kind(variant: Column) -> Column:
    return F.regexp_extract(F.schema_of_variant(variant), "^[A-Z]+", 0)


def _text(record: Column, key: str) -> Column:
    """A field that is a string, else null."""
    value = F.try_variant_get(record, f"$.{key}", "variant")
    return F.when(_kind(value) == "STRING", F.try_variant_get(value, "$", "string"))


def _blank(value: Column) -> Column:
    return value.isNull() | (strip(value) == "")


def parse_tool_calls(rows: DataFrame, text: str = "text", allowed: Sequence[str] | None = None) -> DataFrame:
    """Adds tool, arguments, reason and error, from a column of JSON texts."""
    record = F.try_parse_json(text)
    tool, reason, arguments = _text(F.col("record"), "tool"), _text(F.col("record"), "reason"), F.try_variant_get("record", "$.arguments", "variant")
    known = F.lit(True) if allowed is None else strip(tool).isin(*allowed) if allowed else F.lit(False)
    error = (
        F.when(F.col("record").isNull(), F.lit("ToolCall JSON is invalid."))
        .when(_kind(F.col("record")) != "OBJECT", F.lit("ToolCall must be a JSON object."))
        .when(_blank(tool), F.lit("ToolCall.tool must be a non-empty string."))
        .when(~known, F.concat(F.lit("Unknown tool: "), strip(tool)))
        .when(arguments.isNotNull() & (_kind(arguments) != "OBJECT"), F.lit("ToolCall.arguments must be a JSON object."))
        .when(_blank(reason), F.lit("ToolCall.reason must be a non-empty string."))
    )
    judged = rows.withColumn("record", record).withColumn("error", error)
    good = F.col("error").isNull()
    return judged.select(
        *rows.columns,
        F.when(good, strip(tool)).alias("tool"),
        F.when(good, F.coalesce(arguments, F.parse_json(F.lit("{}")))).alias("arguments"),
        F.when(good, strip(reason)).alias("reason"),
        "error",
    )


def tool_call_json(tool: Column, arguments: Column, reason: Column) -> Column:
    return F.to_json(F.struct(tool.alias("tool"), arguments.alias("arguments"), reason.alias("reason")), ALL_FIELDS)


def tool_result(ok: Column, output: Column, blocked: Column | None = None, reason: Column | None = None) -> Column:
    no, none = F.lit(False), F.lit("")
    return F.struct(ok.alias("ok"), output.alias("output"), (no if blocked is None else blocked).alias("blocked"), (none if reason is None else reason).alias("reason"))


def tool_result_json(result: Column) -> Column:
    return F.to_json(result, ALL_FIELDS)


def tool_record_json(call: Column, result: Column) -> Column:
    return F.to_json(F.struct(call.alias("call"), result.alias("result")), ALL_FIELDS)


def initial_states(tasks: DataFrame) -> DataFrame:
    """Run states for tasks (repo_path, task[, test_command, max_steps, run_id]), and an error for blank tasks."""
    given = lambda name, default: F.coalesce(F.col(name), default) if name in tasks.columns else default
    none = F.lit(None).cast("string")
    history = F.array().cast("array<struct<call:struct<tool:string,arguments:variant,reason:string>,result:struct<ok:boolean,output:string,blocked:boolean,reason:string>>>")
    run_id = F.coalesce(F.nullif(F.col("run_id"), F.lit("")), F.uuid()) if "run_id" in tasks.columns else F.uuid()
    return tasks.select(
        "repo_path",
        strip(F.col("task")).alias("task"),
        run_id.alias("run_id"),
        (F.col("test_command") if "test_command" in tasks.columns else none).alias("test_command"),
        *[F.lit("").alias(c) for c in ("repo_context", "project_rules", "plan")],
        history.alias("tool_history"),
        F.lit(0).alias("steps"),
        given("max_steps", F.lit(8)).alias("max_steps"),
        none.alias("trace_path"),
        *[F.lit("").alias(c) for c in ("review", "final_answer")],
        F.lit(False).alias("done"),
        F.when(_blank(F.col("task")), F.lit("AgentState.task must be non-empty.")).alias("error"),
    )


def test_output(status: Column, out: Column, err: Column) -> Column:
    """What a test run printed, as the text of its result."""
    return F.concat(F.lit("exit_status: "), status.cast("string"), F.lit("\nstdout:\n"), strip(out), F.lit("\nstderr:\n"), strip(err))


def trace_event_error(event: Column, run_id: Column) -> Column:
    return F.when(_blank(event), F.lit("TraceEvent.event must be non-empty.")).when(_blank(run_id), F.lit("TraceEvent.run_id must be non-empty."))


def trace_event_json(event: Column, payload: Column, run_id: Column, time: Column | None = None) -> Column:
    """One JSON line; ``time`` is a timestamp (default: now), written to the second."""
    at = F.localtimestamp() if time is None else time
    return F.to_json(F.struct(F.date_format(at, "yyyy-MM-dd'T'HH:mm:ss").alias("time"), run_id.alias("run_id"), event.alias("event"), payload.alias("payload")), ALL_FIELDS)


def state_trace_events(states: DataFrame, event: Column, payload: Column, time: Column | None = None) -> DataFrame:
    """Run states with ``trace``, a trace event of their run as a JSON line, and ``trace_error``."""
    run_id = F.col("run_id")
    return states.withColumns({"trace_error": trace_event_error(event, run_id), "trace": F.when(trace_event_error(event, run_id).isNull(), trace_event_json(event, payload, run_id, time))})


def task_error(record: Column) -> Column:
    """Of a task manifest as a variant."""
    check = F.when(record.isNull() | (_kind(record) != "OBJECT"), F.lit("Task file must contain one JSON object."))
    for key in ("repo", "task"):
        check = check.when(_blank(_text(record, key)), F.lit(f"Task file requires a non-empty '{key}' field."))
    return check


def task_text(record: Column) -> Column:
    """A task manifest as five lines."""
    field = lambda key: F.try_variant_get(record, f"$.{key}", "string")
    command = F.coalesce(F.nullif(field("test_command"), F.lit("")), F.lit("not configured"))
    values = {"id": F.coalesce(field("id"), F.lit("unknown")), "source": F.coalesce(field("source"), F.lit("local")), "repo": field("repo"), "task": field("task"), "test_command": command}
    return F.concat_ws("\n", *[F.concat(F.lit(f"{k}: "), v) for k, v in values.items()])


def resolved_settings(env: Column, prefix: str = PREFIX) -> Column:
    """Settings from a map of environment values, with defaults and fallbacks."""
    get = lambda name: F.try_element_at(env, F.lit(name))
    own = lambda name: F.coalesce(get(prefix + name), F.lit(DEFAULTS.get(name))) if name in DEFAULTS else get(prefix + name)
    provider = F.lower(strip(F.coalesce(get(f"{prefix}LLM_PROVIDER"), F.lit("openai"))))
    fallback = lambda name: F.coalesce(F.nullif(get(prefix + name), F.lit("")), F.nullif(get(f"OPENAI_{name}"), F.lit("")))
    return F.struct(
        provider.alias("provider"),
        F.coalesce(fallback("API_KEY"), F.lit("")).alias("api_key"),
        fallback("BASE_URL").alias("base_url"),
        own("MODEL").alias("model"),
        own("TEMPERATURE").cast("double").alias("temperature"),
        own("MAX_STEPS").cast("int").alias("max_steps"),
        own("COMMAND_TIMEOUT").cast("int").alias("command_timeout"),
        own("TRACE_DIR").alias("trace_dir"),
        (is_true(F.coalesce(get(f"{prefix}USE_FAKE_LLM"), F.lit(""))) | (provider == "fake")).alias("use_fake_llm"),
    )


def settings_error(settings: Column, prefix: str = PREFIX, with_key: bool = True) -> Column:
    """What is wrong with settings, or null: the provider, then (with_key) a missing key."""
    unknown = F.concat(F.lit(f"Unsupported {prefix}LLM_PROVIDER='"), settings.provider, F.lit(f"'. Supported providers: {', '.join(PROVIDERS)}."))
    check = F.when(~settings.provider.isin(*PROVIDERS), unknown)
    no_key = F.lit(f"No API key configured. Set {prefix}API_KEY or OPENAI_API_KEY, or set {prefix}LLM_PROVIDER=fake for local tests.")
    return check.when(~settings.use_fake_llm & (settings.api_key == ""), no_key) if with_key else check


def settings_json(settings: Column) -> Column:
    """The settings without the key; only whether there is one."""
    fields = ("provider", "base_url", "model", "temperature", "max_steps", "command_timeout", "trace_dir", "use_fake_llm")
    return F.to_json(F.struct(*[settings[f].alias(f) for f in fields], (settings.api_key != "").alias("api_key_configured")), ALL_FIELDS | {"pretty": "true"})
