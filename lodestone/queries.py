"""Queries over the driver's tables, each with the same result as SQL.

A document stands for a file: its path is ``source/lang/doc_id.md``, its content
the text.  Where a query is about other paths, commands or records, they are
made of columns of the tables in the query and in the SQL alike.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestone.functions import text as T
from lodestone.functions.paths import is_ignored, is_protected, is_text_file, path_verdict
from lodestone.operators import chunks, edit, links, policy, records, trigrams
from lodestone.operators import files as files_ops
from lodestone.operators.many import retrieve_many
from lodestone.operators.retrieve import retrieval_notes, retrieve, score_files
from lodestone.operators.symbols import symbol_report, symbols
from lodestone.plans import table_functions
from lodestone.plans.repo_index import NO_QUERY, SECTIONS, as_context, snapshot
from lodestone.sources.repo import scan_repo, write_tree
from lodestone.sources.scratch import scratch_folder, written

QUERY = "the retrieval of 42 The"
PATTERN = r"\bthe\b.*\."
#: What Python takes for characters of a word, in SQL's regular expressions.
WORD = r"\p{L}\p{N}_"


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _files(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = F.concat_ws("/", "source", "lang", F.concat(F.col("doc_id").cast("string"), F.lit(".md")))
    return _table(spark, sf_dir, "documents").select(path.alias("path"), F.col("text").alias("content"))


FILES_SQL = "files AS (SELECT concat_ws('/', source, lang, doc_id::VARCHAR || '.md') AS path, text AS content FROM documents)"


def retrieve_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return retrieve(_files(spark, sf_dir), QUERY).select("path", F.round("score", 6).alias("score"), "excerpt")


def score_all(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score_files(_files(spark, sf_dir), QUERY).select("path", F.round("score", 6).alias("score"))


def _score_sql(prelude: str = FILES_SQL, files: str = "files", content: str = "content", terms=(("the", 2), ("retrieval", 1), ("of", 1), ("42", 1))) -> str:
    """score of each file that has a text."""
    hits = []
    for term, n in terms:
        for of, weight in (("low", 1), ("lower(path)", 3)):
            count = f"((length({of}) - length(replace({of}, '{term}', ''))) // {len(term)})"
            hits.append(f"{n} * CASE WHEN {count} > 0 THEN {weight} + ln(1 + {count}) ELSE 0 END")
        count = f"len(regexp_extract_all(low, '\\b(?:async\\s+def|def|class)\\s+{term}\\b'))"
        hits.append(f"{n} * CASE WHEN {count} > 0 THEN 4 + ln(1 + {count}) ELSE 0 END")
    return f"{prelude}, lowered AS (SELECT *, lower({content}) AS low FROM {files} WHERE content IS NOT NULL), scored AS (SELECT *, {' + '.join(hits)} AS score FROM lowered)"


_TRIM = "regexp_replace(regexp_replace({}, '^\\s+', ''), '\\s+$', '')"
_CENTER = "least(" + ", ".join(f"nullif(instr(low, '{t}'), 0)" for t in ("the", "retrieval", "of", "42")) + ")"

_BEST_SQL = f"SELECT path, score, {_TRIM.format(f'substr(content, greatest(0, coalesce({_CENTER}, 1) - 1 - 466)::BIGINT + 1, 1400)')} AS excerpt FROM scored WHERE score > 0 ORDER BY score DESC, path LIMIT 8"


def tokenize_count(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = _table(spark, sf_dir, "documents").select("doc_id", T.terms(F.col("text")).alias("t"))
    return found.select("doc_id", F.size("t").cast("long").alias("n_terms"), F.size(F.array_distinct("t")).cast("long").alias("n_distinct"), F.get("t", F.lit(0)).alias("first_term"))


def substring_count(spark: SparkSession, sf_dir: str) -> DataFrame:
    low = F.lower("text")
    return _table(spark, sf_dir, "conversations").select("conv_id", "turn", T.occurrences(low, "the").alias("n_the"), T.occurrences(low, "en").alias("n_en"), T.occurrences(low, "anan").alias("n_anan"))


def grep_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return files_ops.grep(_files(spark, sf_dir), PATTERN)


LINES_SQL = f"""{FILES_SQL},
parts AS (SELECT path, regexp_split_to_array(content, '\\r\\n|[\\n\\x0b\\x0c\\r\\x1c-\\x1e\\x{{85}}\\x{{2028}}\\x{{2029}}]') AS ls FROM files WHERE content IS NOT NULL),
each AS (SELECT path, unnest(range(1, len(ls) + 1)) AS line_no, unnest(ls) AS line FROM parts),
hits AS (SELECT path, line_no::INTEGER AS line_no, line FROM each WHERE regexp_matches(line, '(^|[^{WORD}])the(\\.|[^{WORD}].*\\.)'))"""


def grep_words(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines that begin with four words of any language."""
    return files_ops.grep(_files(spark, sf_dir), r"^(?P<first>\w+) \w+ \w+ \w+\b")


RARE_PATTERN = r"(?i)\blicense\b|\w@mail\d"
RARE_QUERY = "license mail5 reserved License"


def index_grep(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines found through a trigram index of all documents."""
    return trigrams.build(_files(spark, sf_dir), scratch_folder(spark, "trigrams")).grep(RARE_PATTERN)


def index_retrieve(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The best documents of a query, found through a trigram index of all documents."""
    found = trigrams.build(_files(spark, sf_dir), scratch_folder(spark, "trigrams")).retrieve(RARE_QUERY, 20)
    return found.select("path", F.round("score", 6).alias("score"))


def retrieve_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The best three documents of every benchmark text, taken as a query."""
    asked = _table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("query_id"), F.col("text").alias("query"))
    found = retrieve_many(_files(spark, sf_dir), asked, 3, 300)
    return found.select(F.col("query_id").alias("item_id"), "rank", "path", F.round("score", 6).alias("score"), "excerpt")


def grep_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    return files_ops.grep_report(_files(spark, sf_dir), PATTERN)


def html_tag_grep(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = _table(spark, sf_dir, "pages").select(F.concat(F.col("page_id").cast("string"), F.lit(".html")).alias("path"), F.col("html").alias("content"))
    return files_ops.grep(pages, r"<(h[1-6]|title)\b")


def list_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return files_ops.list_report(_files(spark, sf_dir))


def tree_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return files_ops.tree_lines(_files(spark, sf_dir))


def tree_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    return files_ops.tree_report(_files(spark, sf_dir))


def read_truncated(spark: SparkSession, sf_dir: str) -> DataFrame:
    return files_ops.read_text(_files(spark, sf_dir))


def preview(spark: SparkSession, sf_dir: str) -> DataFrame:
    return files_ops.previews(_files(spark, sf_dir))


#: Suffixes and folders that paths are made of, by remainder of the text's length.
_NAMES = ("a.py", "B.MD", "notes.tar.gz", ".env", "id_rsa", "key.pem", "Credentials.json", "noext", ".hidden", "x.yaml")
_DIRS = ("src", "build", "a/../b", "../out", "node_modules/m", "deep/./er", ".", "/repo/src", "/etc")


def _made_path(n: Column) -> Column:
    pick = lambda values: F.element_at(F.array(*[F.lit(v) for v in values]), (n % len(values) + 1).cast("int"))
    return F.concat(pick(_DIRS), F.lit("/"), pick(_NAMES))


def path_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = F.col("path")
    rows = _table(spark, sf_dir, "documents").select("doc_id", _made_path(F.length("text")).alias("path"))
    return rows.select("doc_id", "path", is_text_file(path).alias("is_text"), is_ignored(path).alias("is_ignored"), is_protected(path).alias("is_protected"), path_verdict(path, policy.DEFAULT_ROOT).alias("verdict"))


def _list_sql(values) -> str:
    return "[" + ", ".join("'" + v.replace("'", "''") + "'" for v in values) + "]"


def _path_rules_sql() -> str:
    from lodestone.functions.paths import IGNORED_DIRS, PROTECTED_NAMES, PROTECTED_SUFFIXES, TEXT_SUFFIXES

    # Of each made folder, what it normalises to below the root; null where it leaves the root.
    normal = {"src": "src", "build": "build", "a/../b": "b", "../out": None, "node_modules/m": "node_modules/m", "deep/./er": "deep/er", ".": "", "/repo/src": "src", "/etc": None}
    below = "[" + ", ".join("NULL" if normal[d] is None else f"'{normal[d]}'" for d in _DIRS) + "]"
    return f"""
WITH made AS (
  SELECT doc_id, {_list_sql(_DIRS)}[length(text) % {len(_DIRS)} + 1] || '/' || {_list_sql(_NAMES)}[length(text) % {len(_NAMES)} + 1] AS path,
         {below}[length(text) % {len(_DIRS)} + 1] AS below, {_list_sql(_NAMES)}[length(text) % {len(_NAMES)} + 1] AS name FROM documents),
named AS (SELECT *, lower(name) AS low, lower(regexp_extract(name, '^.+(\\.[^.]+)$', 1)) AS suffix FROM made),
judged AS (
  SELECT *, suffix IN {tuple(TEXT_SUFFIXES)} AS is_text, list_has_any(string_split(path, '/'), {_list_sql(IGNORED_DIRS)}) AS is_ignored,
         low IN {tuple(PROTECTED_NAMES)} OR suffix IN {tuple(PROTECTED_SUFFIXES)} AS is_protected FROM named)
SELECT doc_id, path, is_text, is_ignored, is_protected,
       CASE WHEN below IS NULL THEN 'Path escapes repository root: ' || path
            WHEN list_has_any(string_split(below, '/'), {_list_sql(IGNORED_DIRS)})
              THEN 'Refusing to access generated or internal path: /repo/' || below || '/' || name
            WHEN is_protected THEN 'Refusing to access protected file: ' || name END AS verdict
FROM judged"""


def replace_once(spark: SparkSession, sf_dir: str) -> DataFrame:
    return edit.replace_once(_files(spark, sf_dir), F.lit(" the "), F.lit(" THE "))


def unified_diff(spark: SparkSession, sf_dir: str) -> DataFrame:
    files = _files(spark, sf_dir)
    return files.select("path", edit.unified_diff(F.col("path"), F.col("content"), F.replace("content", F.lit("the"), F.lit("THE"))).alias("diff"))


_COMMANDS = ("pytest -q", "rm -rf /", "pytest tests | tee log", "python -m unittest discover -s tests", "npm run test", "make all", "pytest -k dd x", "pytest ../other", "yarn test", "python -m pytest --rootdir=/etc")
_VERDICTS = (None, "Dangerous command blocked: rm -rf /", "Dangerous shell syntax blocked: pytest tests | tee log", None, None, policy.NOT_ALLOWED, "Dangerous command blocked: pytest -k dd x",
             "Path escapes repository root: ../other", None, "Path escapes repository root: /etc")


def command_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    pick = F.element_at(F.array(*[F.lit(c) for c in _COMMANDS]), (F.length("text") % len(_COMMANDS) + 1).cast("int"))
    rows = _table(spark, sf_dir, "conversations").select("conv_id", "turn", pick.alias("command"))
    return rows.select("conv_id", "turn", "command", policy.command_verdict(F.col("command")).alias("verdict"))


def shell_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    text = F.coalesce("html", F.lit(""))
    return _table(spark, sf_dir, "pages").select("page_id", policy.has_shell_token(text).alias("has_token"), policy.has_dangerous_part(text).alias("has_dangerous"))


_TOOLS = ("click", "view", "purchase")


def tool_calls(spark: SparkSession, sf_dir: str) -> DataFrame:
    reason = F.when(F.col("event_id") % 7 == 0, F.lit(" ")).otherwise(F.concat(F.lit(" user "), F.col("user_id").cast("string")))
    arguments = F.when(F.col("event_id") % 11 == 0, F.lit("[1]")).otherwise(F.col("props"))
    text = F.concat(F.lit('{"tool": "'), "event_type", F.lit('", "arguments": '), arguments, F.lit(', "reason": "'), reason, F.lit('"}'))
    text = F.when(F.col("event_id") % 13 == 0, F.lit("{")).when(F.col("event_id") % 17 == 0, F.lit("[]")).otherwise(text)
    rows = _table(spark, sf_dir, "events").select("event_id", text.alias("text"))
    return records.parse_tool_calls(rows, "text", _TOOLS).select("event_id", "tool", "reason", "error")


TOOL_CALLS_SQL = f"""
SELECT event_id, CASE WHEN error IS NULL THEN event_type END AS tool, CASE WHEN error IS NULL THEN 'user ' || user_id END AS reason, error
FROM (SELECT *, CASE WHEN event_id % 13 = 0 THEN 'ToolCall JSON is invalid.'
                     WHEN event_id % 17 = 0 THEN 'ToolCall must be a JSON object.'
                     WHEN event_type NOT IN {_TOOLS} THEN 'Unknown tool: ' || event_type
                     WHEN event_id % 11 = 0 THEN 'ToolCall.arguments must be a JSON object.'
                     WHEN event_id % 7 = 0 THEN 'ToolCall.reason must be a non-empty string.' END AS error FROM events)"""


def trace_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Trace events written as JSON lines and read back."""
    events = _table(spark, sf_dir, "events")
    line = records.trace_event_json(F.col("event_type"), F.parse_json("props"), F.col("user_id").cast("string"), F.col("ts"))
    back = events.select("event_id", F.parse_json(line).alias("r"))
    return back.select("event_id", *[F.try_variant_get("r", f"$.{k}", "string").alias(k) for k in ("time", "run_id", "event")])


def task_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    record = F.to_json(F.struct(F.col("doc_id").cast("string").alias("id"), F.col("source").alias("repo"), F.col("lang").alias("task")))
    return _table(spark, sf_dir, "documents").select("doc_id", records.task_text(F.parse_json(record)).alias("text"))


def symbols_ast(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Symbols of one generated Python file a document."""
    n = F.col("doc_id").cast("string")
    source = F.concat(F.lit("class C"), n, F.lit(":\n    def inner(self):\n        pass\n\n\n@property\nasync def f"), n, F.lit("():\n    pass\n"))
    files = _table(spark, sf_dir, "documents").select(F.concat(n, F.lit(".py")).alias("path"), F.when(F.col("doc_id") % 5 == 0, F.lit("def broken(")).otherwise(source).alias("content"))
    return symbols(files)


def tool_notes(spark: SparkSession, sf_dir: str) -> DataFrame:
    tool = F.element_at(F.array(F.lit("write_file"), F.lit("run_tests"), F.lit("grep")), (F.length("props") % 3 + 1).cast("int"))
    rows = _table(spark, sf_dir, "events").select("event_id", tool.alias("tool"), (F.length("event_type") % 2 == 0).alias("ok"))
    return rows.select("event_id", policy.post_tool_note(F.col("tool"), F.col("ok")).alias("note"))


def _tree_sql(files: str) -> str:
    return f"""SELECT string_agg(line, chr(10) ORDER BY f, depth) || (SELECT CASE WHEN count(*) > 80 THEN chr(10) || '... ' || (count(*) - 80) || ' more files omitted' ELSE '' END FROM {files}) AS output FROM (
      WITH p AS (SELECT path, string_split(path, '/') AS p FROM {files} ORDER BY path LIMIT 80),
      dirs AS (SELECT path, p, unnest(range(1, len(p))) AS n FROM p), once AS (SELECT p[1:n] AS d, min(path) AS f FROM dirs GROUP BY ALL)
      SELECT f, len(d) - 1 AS depth, repeat('  ', len(d) - 1) || '- ' || d[-1] || '/' AS line FROM once
      UNION ALL SELECT path, len(p) - 1, repeat('  ', len(p) - 1) || '- ' || p[-1] FROM p)"""


def _project(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A tree of several kinds of files: the documents, a rules file of the regions, and a Python file a customer."""
    regions = _table(spark, sf_dir, "region").agg(F.array_join(F.sort_array(F.collect_list(F.concat(F.lit("- "), "r_name"))), "\n").alias("content"))
    key = F.col("c_custkey").cast("string")
    segment = F.lower("c_mktsegment")
    source = F.concat(F.lit("class Customer"), key, F.lit(":\n    def "), segment, F.lit("(self):\n        return "), F.col("c_nationkey").cast("string"), F.lit("\n"))
    # Customers that owe have a file that does not parse.
    source = F.when(F.col("c_acctbal") < 0, F.concat(F.lit("def "), segment, F.lit("(:\n"))).otherwise(source)
    scripts = _table(spark, sf_dir, "customer").select(F.concat(F.lit("zz/c"), key, F.lit(".py")).alias("path"), source.alias("content"))
    return _files(spark, sf_dir).union(regions.select(F.lit("AGENT.md"), "content")).union(scripts)


PROJECT_SQL = f"""{FILES_SQL},
scripts AS (SELECT c_custkey, c_acctbal < 0 AS broken, lower(c_mktsegment) AS segment, c_nationkey, 'zz/c' || c_custkey || '.py' AS path FROM customer),
project AS (
  SELECT * FROM files UNION ALL SELECT 'AGENT.md', string_agg('- ' || r_name, chr(10) ORDER BY r_name) FROM region
  UNION ALL SELECT path, CASE WHEN broken THEN 'def ' || segment || '(:' || chr(10)
    ELSE 'class Customer' || c_custkey || ':' || chr(10) || '    def ' || segment || '(self):' || chr(10) || '        return ' || c_nationkey || chr(10) END FROM scripts),
project_symbols AS (
  SELECT path, ord, path || ':' || line || ': ' || kind || ' ' || name AS line FROM (
    SELECT path, 0 AS ord, 1 AS line, 'class' AS kind, 'Customer' || c_custkey AS name FROM scripts WHERE NOT broken
    UNION ALL SELECT path, 1, 2, 'function', segment FROM scripts WHERE NOT broken))"""


def _sections_sql() -> dict[str, str]:
    """SQL of each section of a snapshot of the project, after PROJECT_SQL and the scores."""
    trimmed = _TRIM.format(f"content[1:{files_ops.PREVIEW_CHARS}]")
    return {
        "tree": _tree_sql("project"),
        "symbols": "SELECT string_agg(line, chr(10) ORDER BY path, ord) AS output FROM (SELECT * FROM project_symbols ORDER BY path, ord LIMIT 120)",
        "notes": f"SELECT string_agg('## ' || path || ' score=' || printf('%.2f', score) || chr(10) || '```' || chr(10) || excerpt || chr(10) || '```', chr(10) || chr(10) ORDER BY score DESC, path) AS output FROM ({_BEST_SQL})",
        "rules": "SELECT content AS output FROM project WHERE path = 'AGENT.md'",
        "previews": f"SELECT string_agg('## ' || path || chr(10) || '```' || chr(10) || preview || chr(10) || '```', chr(10) || chr(10) ORDER BY path) AS output FROM (SELECT path, {trimmed} AS preview FROM (SELECT * FROM project ORDER BY path LIMIT 80)) WHERE preview <> ''",
    }


def repo_snapshot(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All sections of a snapshot."""
    return snapshot(_project(spark, sf_dir), QUERY).select("section", "output")


def repo_context(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A snapshot without a query, as one text."""
    return as_context(snapshot(_project(spark, sf_dir)))


def notes_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    return retrieval_notes(_project(spark, sf_dir), QUERY)


def rules_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    return files_ops.rules_report(_project(spark, sf_dir))


def symbols_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    return symbol_report(_project(spark, sf_dir))


def definition_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scores of texts that define what the query asks for."""
    defined = F.replace(F.replace("content", F.lit(" the "), F.lit(" def  the ")), F.lit(" of "), F.lit(" async def of "))
    return score_files(_files(spark, sf_dir).withColumn("content", defined), QUERY).select("path", F.round("score", 6).alias("score"))


def _parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A file of one line for each part."""
    return _table(spark, sf_dir, "part").select(F.concat(F.lit("parts/"), F.col("p_partkey").cast("string"), F.lit(".txt")).alias("path"), F.col("p_name").alias("content"), "p_brand", "p_size")


PARTS_SQL = "parts AS (SELECT 'parts/' || p_partkey || '.txt' AS path, p_name AS content, p_brand, p_size FROM part)"
#: The diff of files of one line, without an end of line.
_DIFF_SQL = "'--- a/' || path || chr(10) || '+++ b/' || path || chr(10) || '@@ -1 +1 @@' || chr(10) || '-' || content || chr(10) || '+' || {}"


def one_line_diffs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _parts(spark, sf_dir).select("path", edit.unified_diff(F.col("path"), F.col("content"), F.replace("content", F.lit("widget"), F.lit("gadget"))).alias("diff"))


def file_replacements(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One edit a part: some snippets are there once, some never or twice, some empty; some files are not there."""
    files = _parts(spark, sf_dir)
    old = F.when(F.col("p_size") % 5 == 0, F.lit("")).when(F.col("p_size") % 5 == 1, F.lit("d")).otherwise(F.lit("widget"))
    path = F.when(F.col("p_size") % 7 == 0, F.concat("path", F.lit(".gone"))).otherwise(F.col("path"))
    edits = files.select(path.alias("path"), old.alias("old"), F.when(F.col("p_size") % 11 > 0, F.col("p_brand")).alias("new"))
    return edit.apply_replacements(files, edits)


def chunk_grep(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines that begin with four words, of documents that are cut every 500 characters."""
    return chunks.grep(chunks.chunked(_files(spark, sf_dir), 500), r"^\w+ \w+ \w+ \w+\b")


def chunk_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scores of documents that are cut every 500 characters."""
    return chunks.score(chunks.chunked(_files(spark, sf_dir), 500), QUERY).select("path", F.round("score", 6).alias("score"))


def link_targets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Where chains of links between the documents of a source lead: those of an odd length are links to the document with half the id."""
    docs = _table(spark, sf_dir, "documents")
    target = F.concat(F.lit("./x/../../d/"), F.floor(F.col("doc_id") / 2).cast("string"))
    made = docs.where(F.length("text") % 3 > 0).select(F.lit("all").alias("repo"), F.concat(F.lit("d/"), F.col("doc_id").cast("string")).alias("path"), target.alias("target"))
    return links.resolved(made, written)


def written_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The files of the parts after the edits, written as a tree and scanned again."""
    files = _parts(spark, sf_dir)
    old = F.when(F.col("p_size") % 5 == 1, F.lit("d")).otherwise(F.lit("widget"))
    edits = files.select("path", old.alias("old"), F.col("p_brand").alias("new"))
    root = scratch_folder(spark, "tree")
    write_tree(edit.updated_files(files, edit.apply_replacements(files, edits)), root.removeprefix("file:"))
    return scan_repo(spark, root.removeprefix("file:"))


def sql_grep(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines found by the table function of SQL."""
    table_functions.register(spark)
    return spark.sql("SELECT path, line_no, line FROM grep_files(TABLE({files}), {pattern}) WHERE error IS NULL", files=_files(spark, sf_dir), pattern=RARE_PATTERN)


def sql_best_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The best two documents of each language: scores come from the table function, and a task sends two a language."""
    table_functions.register(spark)
    files = _files(spark, sf_dir).withColumn("lang", F.split("path", "/")[1])
    ranked = "SELECT path, score, row_number() OVER (PARTITION BY lang ORDER BY score DESC, path) AS rank FROM file_scores(TABLE({files}), {query})"
    found = spark.sql(f"SELECT * FROM ({ranked}) WHERE rank <= 2", files=files, query=QUERY)
    return found.select("path", "rank", F.round("score", 6).alias("score"))


def file_writes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One write a part: changed, unchanged and new files, and contents that are null."""
    files = _parts(spark, sf_dir)
    content = F.when(F.col("p_size") % 4 == 0, F.col("content")).when(F.col("p_size") % 4 > 1, F.col("p_brand"))
    return edit.apply_writes(files.where("p_size % 6 > 0"), files.select("path", content.alias("content")))


def document_commands(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Test commands about the documents: the language gives the runner, the length what is asked for."""
    runner = F.create_map(*[F.lit(x) for pair in _RUNNERS.items() for x in pair])[F.col("lang")]
    argument = reduce(lambda acc, x: acc.when(F.col("n_chars") < x[0], F.concat(F.lit(x[1]), "source", F.lit(x[2]))), _ARGUMENTS[1:], F.when(F.col("n_chars") < _ARGUMENTS[0][0], F.concat(F.lit(_ARGUMENTS[0][1]), "source", F.lit(_ARGUMENTS[0][2]))))
    command = F.concat_ws(" ", runner, argument)
    return _table(spark, sf_dir, "documents").select("doc_id", command.alias("command"), policy.command_verdict(command).alias("verdict"))


_RUNNERS = {"en": "pytest -q", "de": "python3 -m pytest", "fr": "python -m unittest discover -s", "es": "npm run test --"}
#: (below this length, before the source, behind it); from the last length on there is no argument.
_ARGUMENTS = ((800, "--cov-report=html:../", "/x"), (1200, "--junitxml=/etc/", ".xml"), (1600, "", "/t.py::test_a"), (2400, "'", "/build/x'"), (3200, "./", "/k.pem"), (4800, "--rootdir=", ""))


def document_tool_calls(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Verdicts on tool calls whose path is that of a page's address, as it is."""
    tool = F.when(F.col("url").contains("utm_"), F.lit("read_file")).when(F.col("url").contains("/es/"), F.lit("list_files")).otherwise(F.lit("write_file"))
    path = F.regexp_replace("url", "^[a-z]+://[^/]*", "")
    path = F.when(F.col("url").contains("/de/"), path).when(F.col("url").contains("/fr/"), F.concat(F.lit("dist"), path)).otherwise(F.substr(path, F.lit(2)))
    pages = _table(spark, sf_dir, "pages").select("page_id", tool.alias("tool"), F.to_json(F.struct(path.alias("path"))).alias("arguments"))
    return pages.select("page_id", "tool", policy.tool_call_verdict(F.col("tool"), F.parse_json("arguments")).alias("verdict"))


def task_checks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Task manifests made of messages, some without a task or no object, and their errors or texts."""
    record = F.struct(F.col("role").alias("repo"), F.when(F.length("text") % 5 > 0, F.substring("text", 1, 40)).otherwise(F.lit(" ")).alias("task"), F.when(F.length("text") % 3 == 0, F.lit("pytest")).alias("test_command"))
    text = F.when(F.length("text") % 7 == 0, F.lit("[1]")).otherwise(F.to_json(record))
    rows = _table(spark, sf_dir, "conversations").select("conv_id", "turn", F.try_parse_json(text).alias("record"))
    error = records.task_error(F.col("record"))
    return rows.select("conv_id", "turn", error.alias("error"), F.when(error.isNull(), records.task_text(F.col("record"))).alias("text"))


def settings_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Settings from maps of values that customers give, as JSON that is read again."""
    values = {
        "LLM_PROVIDER": F.when(F.col("c_nationkey") % 4 == 0, F.lit(" Fake ")).when(F.col("c_nationkey") % 4 == 1, F.lit("OpenAI")).when(F.col("c_nationkey") % 4 == 2, F.col("c_mktsegment")),
        "API_KEY": F.when(F.col("c_acctbal") > 5000, F.col("c_name")).when(F.col("c_acctbal") > 0, F.lit("")),
        "MODEL": F.when(F.col("c_acctbal") > 2000, F.col("c_mktsegment")),
        "MAX_STEPS": F.when(F.col("c_nationkey") > 8, F.col("c_nationkey").cast("string")),
        "USE_FAKE_LLM": F.when(F.col("c_nationkey") % 3 == 0, F.lit(" YES ")).otherwise(F.lit("no")),
    }
    pairs = F.array(*[F.struct(F.lit(records.PREFIX + k).alias("key"), v.alias("value")) for k, v in values.items()])
    env = F.map_from_entries(F.filter(pairs, lambda x: x.value.isNotNull()))
    rows = _table(spark, sf_dir, "customer").select("c_custkey", records.resolved_settings(env).alias("s"))
    read = rows.select("c_custkey", F.parse_json(records.settings_json(F.col("s"))).alias("j"), records.settings_error(F.col("s")).alias("error"))
    fields = {"provider": "string", "model": "string", "max_steps": "int", "use_fake_llm": "boolean", "api_key_configured": "boolean"}
    return read.select("c_custkey", "error", *[F.try_variant_get("j", f"$.{k}", t).alias(k) for k, t in fields.items()])


def run_states(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Run states of orders, and a trace event of each as JSON that is read again."""
    orders = _table(spark, sf_dir, "orders")
    task = F.when(F.col("o_orderstatus") != "P", F.concat(F.lit("  "), "o_orderpriority", F.lit("\t")))
    tasks = orders.select(F.col("o_orderstatus").alias("repo_path"), task.alias("task"), F.col("o_orderkey").cast("string").alias("run_id"), F.col("o_orderpriority").alias("test_command"), F.when(F.col("o_totalprice") > 200_000, F.lit(3)).alias("max_steps"), "o_orderdate")
    states = records.initial_states(tasks)
    traced = records.state_trace_events(states, F.coalesce("task", F.lit(" ")), F.parse_json(F.lit('{"a": 1}')), F.to_timestamp(F.lit("2024-01-02 03:04:05")))
    read = F.try_parse_json("trace")
    return traced.select("run_id", "repo_path", "task", "test_command", "max_steps", "done", "error", "trace_error", F.try_variant_get(read, "$.run_id", "string").alias("traced_run"), F.try_variant_get(read, "$.time", "string").alias("traced_at"))


def tool_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Records of calls and results, and outputs of test runs, as JSON that is read again."""
    events = _table(spark, sf_dir, "events")
    call = F.struct(F.col("event_type").alias("tool"), F.parse_json("props").alias("arguments"), F.col("user_id").cast("string").alias("reason"))
    result = records.tool_result(F.col("value") > 100, records.test_output(F.col("user_id"), F.concat(F.lit(" "), "event_type"), F.col("props")), blocked=F.col("value") < 10)
    lines = events.select("event_id", F.parse_json(records.tool_record_json(call, result)).alias("r"), F.parse_json(records.tool_call_json(call.tool, call.arguments, call.reason)).alias("c"))
    get = lambda v, path, kind: F.try_variant_get(v, path, kind)
    return lines.select(
        "event_id", get("r", "$.call.tool", "string").alias("tool"), get("c", "$.reason", "string").alias("reason"), get("r", "$.result.ok", "boolean").alias("ok"),
        get("r", "$.result.blocked", "boolean").alias("blocked"), get("r", "$.result.reason", "string").alias("result_reason"), get("r", "$.result.output", "string").alias("output"),
    )


def _more_sql() -> dict[str, str]:
    project = _score_sql(PROJECT_SQL, "project")
    sections = _sections_sql()
    each = " UNION ALL ".join(f"SELECT '{name}' AS section, output FROM ({sql})" for name, sql in sections.items())
    context = " || chr(10) || chr(10) || ".join(f"'# {SECTIONS[name]}' || chr(10) || " + (f"'{NO_QUERY}'" if name == "notes" else f"(SELECT output FROM ({sections[name]}))") for name in ("tree", "symbols", "notes", "previews"))
    defined = "replace(replace(content, ' the ', ' def  the '), ' of ', ' async def of ')"
    parse = "length(text) % 7 = 0"
    blank = "length(text) % 5 = 0 OR trim(text[1:40], ' ' || chr(9) || chr(10) || chr(13)) = ''"
    runner = "CASE lang " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in _RUNNERS.items()) + " END"
    quoted = lambda x: "'" + x.replace("'", "''") + "'"
    argument = "CASE " + " ".join(f"WHEN n_chars < {n} THEN {quoted(a)} || source || {quoted(b)}" for n, a, b in _ARGUMENTS) + " END"
    return {
        "repo_snapshot": f"WITH {project} {each}",
        "repo_context": f"WITH {PROJECT_SQL} SELECT {context} || chr(10) AS output",
        "notes_report": f"WITH {project} {sections['notes']}",
        "rules_report": f"WITH {PROJECT_SQL} {sections['rules']}",
        "symbols_report": f"WITH {PROJECT_SQL} {sections['symbols']}",
        "definition_scores": f"WITH {_score_sql(content=defined)} SELECT path, round(score, 6) AS score FROM scored",
        "one_line_diffs": f"WITH {PARTS_SQL}, changed AS (SELECT *, replace(content, 'widget', 'gadget') AS after FROM parts) SELECT path, CASE WHEN after = content THEN '' ELSE {_DIFF_SQL.format('after')} END AS diff FROM changed",
        "file_replacements": f"""WITH {PARTS_SQL}, asked AS (
              SELECT path, CASE WHEN p_size % 7 = 0 THEN path || '.gone' ELSE path END AS asked, content, CASE p_size % 5 WHEN 0 THEN '' WHEN 1 THEN 'd' ELSE 'widget' END AS old, CASE WHEN p_size % 11 > 0 THEN p_brand END AS new FROM parts),
            counted AS (SELECT *, (length(content) - length(replace(content, old, ''))) // greatest(1, length(old)) AS n FROM asked),
            judged AS (SELECT *, CASE WHEN new IS NULL THEN 'replace_in_file requires string old and new fields.' WHEN old = '' THEN 'replace_in_file requires a non-empty old snippet.' WHEN asked <> path THEN 'File not found: ' || asked
              WHEN n = 0 THEN 'old text not found; inspect the file before retrying.' WHEN n > 1 THEN 'old text occurs ' || n || ' times; provide a more specific snippet.' END AS error FROM counted)
            SELECT asked AS path, error IS NULL AS ok, coalesce(error, {_DIFF_SQL.format('replace(content, old, new)')}) AS output,
                   CASE WHEN error IS NULL THEN replace(content, old, new) WHEN asked <> path THEN '' ELSE content END AS content FROM judged""",
        "file_writes": f"""WITH {PARTS_SQL}, asked AS (
              SELECT path, CASE WHEN p_size % 6 > 0 THEN content ELSE '' END AS content, CASE WHEN p_size % 4 = 0 THEN content WHEN p_size % 4 > 1 THEN p_brand END AS after FROM parts)
            SELECT path, after IS NOT NULL AS ok, CASE WHEN after IS NULL THEN 'write_file requires string content.' WHEN after = content THEN 'Wrote ' || path || ' with no textual diff.'
              WHEN content = '' THEN '--- a/' || path || chr(10) || '+++ b/' || path || chr(10) || '@@ -0,0 +1 @@' || chr(10) || '+' || after ELSE {_DIFF_SQL.format('after')} END AS output,
              coalesce(after, content) AS content FROM asked""",
        "document_commands": f"""SELECT doc_id, concat_ws(' ', {runner}, {argument}) AS command, CASE
              -- unittest takes what follows -s as a path, whatever it begins with.
              WHEN n_chars < 1200 AND lang = 'fr' THEN NULL
              WHEN n_chars < 800 THEN 'Path escapes repository root: ../' || source || '/x'
              WHEN n_chars < 1200 THEN 'Path escapes repository root: /etc/' || source || '.xml'
              WHEN n_chars < 1600 THEN NULL
              WHEN n_chars < 2400 THEN 'Refusing to access generated or internal path: /repo/' || source || '/build/x'
              WHEN n_chars < 3200 THEN 'Refusing to access protected file: k.pem'
              WHEN n_chars < 4800 THEN NULL
              WHEN lang = 'fr' THEN 'Test command option requires a path: -s' END AS verdict FROM documents""",
        "document_tool_calls": """WITH t AS (
              SELECT page_id, url, CASE WHEN contains(url, 'utm_') THEN 'read_file' WHEN contains(url, '/es/') THEN 'list_files' ELSE 'write_file' END AS tool, regexp_replace(url, '^[a-z]+://[^/]*', '') AS p FROM pages)
            SELECT page_id, tool, CASE WHEN contains(url, '/de/') THEN CASE WHEN p = '' THEN tool || ' requires a path.' ELSE 'Path escapes repository root: ' || p END
              WHEN contains(url, '/fr/') THEN 'Refusing to access generated or internal path: /repo/dist' || rtrim(p, '/') END AS verdict FROM t""",
        "task_checks": f"""SELECT conv_id, turn, CASE WHEN {parse} THEN 'Task file must contain one JSON object.' WHEN {blank} THEN 'Task file requires a non-empty ''task'' field.' END AS error,
            CASE WHEN NOT ({parse} OR {blank}) THEN 'id: unknown' || chr(10) || 'source: local' || chr(10) || 'repo: ' || role || chr(10) || 'task: ' || text[1:40] || chr(10) || 'test_command: ' || CASE WHEN length(text) % 3 = 0 THEN 'pytest' ELSE 'not configured' END END AS text FROM conversations""",
        "settings_rows": f"""WITH s AS (
              SELECT c_custkey, CASE c_nationkey % 4 WHEN 0 THEN 'fake' WHEN 2 THEN lower(c_mktsegment) ELSE 'openai' END AS provider, CASE WHEN c_acctbal > 2000 THEN c_mktsegment ELSE '{records.DEFAULTS["MODEL"]}' END AS model,
                CASE WHEN c_nationkey > 8 THEN c_nationkey ELSE {records.DEFAULTS["MAX_STEPS"]} END::INTEGER AS max_steps, c_acctbal > 5000 AS api_key_configured, c_nationkey % 3 = 0 AS yes FROM customer)
            SELECT c_custkey, CASE WHEN provider NOT IN {records.PROVIDERS} THEN 'Unsupported {records.PREFIX}LLM_PROVIDER=''' || provider || '''. Supported providers: {", ".join(records.PROVIDERS)}.'
              WHEN NOT (yes OR provider = 'fake') AND NOT api_key_configured THEN 'No API key configured. Set {records.PREFIX}API_KEY or OPENAI_API_KEY, or set {records.PREFIX}LLM_PROVIDER=fake for local tests.' END AS error,
              provider, model, max_steps, yes OR provider = 'fake' AS use_fake_llm, api_key_configured FROM s""",
        "run_states": """SELECT o_orderkey::VARCHAR AS run_id, o_orderstatus AS repo_path, CASE WHEN o_orderstatus <> 'P' THEN o_orderpriority END AS task, o_orderpriority AS test_command, CASE WHEN o_totalprice > 200000 THEN 3 ELSE 8 END AS max_steps, false AS done,
            CASE WHEN o_orderstatus = 'P' THEN 'AgentState.task must be non-empty.' END AS error, CASE WHEN o_orderstatus = 'P' THEN 'TraceEvent.event must be non-empty.' END AS trace_error,
            CASE WHEN o_orderstatus <> 'P' THEN o_orderkey::VARCHAR END AS traced_run, CASE WHEN o_orderstatus <> 'P' THEN '2024-01-02T03:04:05' END AS traced_at FROM orders""",
        "tool_records": """SELECT event_id, event_type AS tool, user_id::VARCHAR AS reason, value > 100 AS ok, value < 10 AS blocked, '' AS result_reason,
            'exit_status: ' || user_id || chr(10) || 'stdout:' || chr(10) || event_type || chr(10) || 'stderr:' || chr(10) || props AS output FROM events""",
    }


_BUILDERS = (
    retrieve_topk, score_all, tokenize_count, substring_count, grep_lines, grep_words, index_grep, index_retrieve, retrieve_table, sql_grep, sql_best_files, chunk_grep, chunk_scores, link_targets, written_tree, grep_report, html_tag_grep, list_files, tree_lines, tree_report, read_truncated,
    preview, path_rules, replace_once, unified_diff, command_rules, shell_tokens, tool_calls, trace_events, task_texts, symbols_ast, tool_notes,
    repo_snapshot, repo_context, notes_report, rules_report, symbols_report, definition_scores, one_line_diffs, file_replacements, file_writes,
    document_commands, document_tool_calls, task_checks, settings_rows, run_states, tool_records,
)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in _BUILDERS}


_START = "greatest(0, coalesce(list_min(list_filter(list_transform(t, lambda x: instr(low, x)), lambda i: i > 0)), 1) - 1 - 100)::BIGINT + 1"
RETRIEVE_TABLE_SQL = f"""WITH {FILES_SQL},
asked AS (SELECT item_id, list_transform(regexp_extract_all(coalesce(text, ''), '[A-Za-z_][A-Za-z0-9_]*|\\p{{Nd}}+|[\\x{{4e00}}-\\x{{9fff}}]+'), lambda x: lower(x)) AS t FROM benchmark),
times AS (SELECT item_id, term, count(*) AS times FROM (SELECT item_id, unnest(t) AS term FROM asked) GROUP BY ALL),
lowered AS (SELECT path, content, lower(content) AS low FROM files WHERE content IS NOT NULL),
counted AS (
  SELECT path, term, (length(low) - length(replace(low, term, ''))) // length(term) AS n, (length(lower(path)) - length(replace(lower(path), term, ''))) // length(term) AS np,
         CASE WHEN contains(low, term) AND (contains(low, 'def') OR contains(low, 'class')) THEN len(regexp_extract_all(low, '\\b(?:async\\s+def|def|class)\\s+' || term || '\\b')) ELSE 0 END AS nd
  FROM lowered, (SELECT DISTINCT term FROM times)),
weighed AS (
  SELECT path, term, CASE WHEN n > 0 THEN 1 + ln(1 + n) ELSE 0 END + CASE WHEN np > 0 THEN 3 + ln(1 + np) ELSE 0 END + CASE WHEN nd > 0 THEN 4 + ln(1 + nd) ELSE 0 END AS w
  FROM counted WHERE n > 0 OR np > 0 OR nd > 0),
best AS (
  SELECT item_id, path, round(sum(times * w), 9) AS score, row_number() OVER (PARTITION BY item_id ORDER BY round(sum(times * w), 9) DESC, path)::INTEGER AS rank
  FROM weighed JOIN times USING (term) GROUP BY item_id, path)
SELECT item_id, rank, path, round(score, 6) AS score, {_TRIM.format(f'substr(content, {_START}, 300)')} AS excerpt
FROM best JOIN asked USING (item_id) JOIN lowered USING (path) WHERE rank <= 3"""


def oracle_sql() -> dict[str, str]:
    tokens = r"regexp_extract_all(coalesce(text, ''), '[A-Za-z_][A-Za-z0-9_]*|\p{Nd}+|[\x{4e00}-\x{9fff}]+')"
    count = lambda t: f"((length(lower(text)) - length(replace(lower(text), '{t}', ''))) // {len(t)})::BIGINT"
    any_of = lambda column, values: " OR ".join(f"contains({column}, '{v}')" for v in values)
    order = "string_split(path, '/')"
    return {
        "retrieve_topk": f"WITH {_score_sql()} SELECT path, round(score, 6) AS score, {_TRIM.format(f'substr(content, greatest(0, coalesce({_CENTER}, 1) - 1 - 466)::BIGINT + 1, 1400)')} AS excerpt FROM scored WHERE score > 0 ORDER BY scored.score DESC, path LIMIT 8",
        "score_all": f"WITH {_score_sql()} SELECT path, round(score, 6) AS score FROM scored",
        "tokenize_count": f"SELECT doc_id, len(t)::BIGINT AS n_terms, len(list_distinct(list_transform(t, lambda x: lower(x))))::BIGINT AS n_distinct, lower(t[1]) AS first_term FROM (SELECT doc_id, {tokens} AS t FROM documents)",
        "substring_count": f"SELECT conv_id, turn, {count('the')} AS n_the, {count('en')} AS n_en, {count('anan')} AS n_anan FROM conversations",
        "grep_lines": f"WITH {LINES_SQL} SELECT path, line_no, line FROM hits",
        "grep_report": f"WITH {LINES_SQL}, first AS (SELECT * FROM hits ORDER BY {order}, line_no LIMIT 80) SELECT string_agg(path || ':' || line_no || ': ' || line, chr(10) ORDER BY {order}, line_no) || CASE WHEN count(*) >= 80 THEN chr(10) || '... matches truncated' ELSE '' END AS output FROM first",
        "grep_words": f"WITH {LINES_SQL.rpartition('hits AS')[0]} hits AS (SELECT path, line_no::INTEGER AS line_no, line FROM each WHERE regexp_matches(line, '^[{WORD}]+ [{WORD}]+ [{WORD}]+ [{WORD}]+')) SELECT path, line_no, line FROM hits",
        "index_grep": f"WITH {LINES_SQL.rpartition('hits AS')[0]} hits AS (SELECT path, line_no::INTEGER AS line_no, line FROM each WHERE regexp_matches(line, '(?i)(^|[^{WORD}])license($|[^{WORD}])|[{WORD}]@mail\\p{{Nd}}')) SELECT path, line_no, line FROM hits",
        "index_retrieve": f"WITH {_score_sql(terms=(('license', 2), ('mail5', 1), ('reserved', 1)))} SELECT path, round(score, 6) AS score FROM scored WHERE score > 0 ORDER BY scored.score DESC, path LIMIT 20",
        "retrieve_table": RETRIEVE_TABLE_SQL,
        "link_targets": """WITH RECURSIVE l AS (SELECT doc_id, doc_id // 2 AS target FROM documents WHERE length(text) % 3 > 0),
            walk AS (SELECT doc_id, target, 1 AS n FROM l UNION ALL SELECT walk.doc_id, l.target, n + 1 FROM walk JOIN l ON walk.target = l.doc_id WHERE n < 100),
            ends AS (SELECT doc_id, arg_max(target, n) AS target, max(n) AS n FROM walk GROUP BY doc_id)
            SELECT 'all' AS repo, 'd/' || doc_id AS path, CASE WHEN n = 100 THEN 'loop' ELSE 'inside' END AS status, CASE WHEN n < 100 THEN 'd/' || target END AS final FROM ends""",
        "chunk_grep": f"WITH {LINES_SQL.rpartition('hits AS')[0]} hits AS (SELECT path, line_no::INTEGER AS line_no, line FROM each WHERE regexp_matches(line, '^[{WORD}]+ [{WORD}]+ [{WORD}]+ [{WORD}]+')) SELECT path, line_no, line FROM hits",
        "chunk_scores": f"WITH {_score_sql()} SELECT path, round(score, 6) AS score FROM scored",
        "sql_grep": f"WITH {LINES_SQL.rpartition('hits AS')[0]} hits AS (SELECT path, line_no::INTEGER AS line_no, line FROM each WHERE regexp_matches(line, '(?i)(^|[^{WORD}])license($|[^{WORD}])|[{WORD}]@mail\\p{{Nd}}')) SELECT path, line_no, line FROM hits",
        "sql_best_files": f"WITH {_score_sql()}, ranked AS (SELECT path, round(score, 9) AS score, row_number() OVER (PARTITION BY string_split(path, '/')[2] ORDER BY round(score, 9) DESC, path)::INTEGER AS rank FROM scored WHERE score > 0) SELECT path, rank, round(score, 6) AS score FROM ranked WHERE rank <= 2",
        "written_tree": f"WITH {PARTS_SQL}, e AS (SELECT path, content, p_brand, CASE WHEN p_size % 5 = 1 THEN 'd' ELSE 'widget' END AS old FROM parts) SELECT path, CASE WHEN (length(content) - length(replace(content, old, ''))) // length(old) = 1 THEN replace(content, old, p_brand) ELSE content END AS content FROM e",
        "html_tag_grep": r"WITH parts AS (SELECT page_id || '.html' AS path, regexp_split_to_array(html, '\r\n|[\n\x0b\x0c\r\x1c-\x1e\x{85}\x{2028}\x{2029}]') AS ls FROM pages WHERE html IS NOT NULL), each AS (SELECT path, unnest(range(1, len(ls) + 1))::INTEGER AS line_no, unnest(ls) AS line FROM parts) SELECT path, line_no, line FROM each WHERE regexp_matches(line, '<(h[1-6]|title)($|[^\p{L}\p{N}_])')",
        "list_files": f"WITH {FILES_SQL}, first AS (SELECT path FROM files ORDER BY {order} LIMIT 120) SELECT string_agg(path, chr(10) ORDER BY {order}) || CASE WHEN count(*) >= 120 THEN chr(10) || '... output truncated' ELSE '' END AS output FROM first",
        "tree_lines": f"""WITH {FILES_SQL}, p AS (SELECT path, string_split(path, '/') AS p FROM files),
            dirs AS (SELECT path, p, unnest(range(1, len(p))) AS n FROM p), once AS (SELECT p[1:n] AS d, min(path) AS first_path FROM dirs GROUP BY ALL)
            SELECT first_path, (len(d) - 1)::INTEGER AS depth, repeat('  ', len(d) - 1) || '- ' || d[-1] || '/' AS line FROM once
            UNION ALL SELECT path, (len(p) - 1)::INTEGER, repeat('  ', len(p) - 1) || '- ' || p[-1] FROM p""",
        "tree_report": f"WITH {FILES_SQL} {_tree_sql('files')}",
        "read_truncated": f"WITH {FILES_SQL} SELECT path, CASE WHEN length(content) > {files_ops.READ_CHARS} THEN content[1:{files_ops.READ_CHARS}] || chr(10) || '... file truncated' ELSE coalesce(content, '') END AS output FROM files",
        "preview": f"WITH {FILES_SQL} SELECT path, {_TRIM.format(f'content[1:{files_ops.PREVIEW_CHARS}]')} AS preview FROM files WHERE {_TRIM.format(f'content[1:{files_ops.PREVIEW_CHARS}]')} <> ''",
        "path_rules": _path_rules_sql(),
        "replace_once": f"""WITH {FILES_SQL}, counted AS (SELECT path, coalesce(content, '') AS c, (length(c) - length(replace(c, ' the ', ''))) // 5 AS n FROM files)
            SELECT path, n = 1 AS ok, CASE WHEN n = 0 THEN 'old text not found; inspect the file before retrying.' WHEN n > 1 THEN 'old text occurs ' || n || ' times; provide a more specific snippet.' END AS error,
                   CASE WHEN n = 1 THEN replace(c, ' the ', ' THE ') ELSE c END AS content FROM counted""",
        "command_rules": f"SELECT conv_id, turn, {_list_sql(_COMMANDS)}[length(text) % {len(_COMMANDS)} + 1] AS command, [{', '.join('NULL' if v is None else repr(v) for v in _VERDICTS)}][length(text) % {len(_COMMANDS)} + 1] AS verdict FROM conversations",
        "shell_tokens": f"SELECT page_id, {any_of(chr(104) + 'tml', policy.SHELL_TOKENS)} AS has_token, {any_of('lower(html)', policy.DANGEROUS)} AS has_dangerous FROM (SELECT page_id, coalesce(html, '') AS html FROM pages)",
        "tool_calls": TOOL_CALLS_SQL,
        "trace_events": "SELECT event_id, strftime(ts, '%Y-%m-%dT%H:%M:%S') AS time, user_id::VARCHAR AS run_id, event_type AS event FROM events",
        "task_texts": "SELECT doc_id, 'id: ' || doc_id || chr(10) || 'source: local' || chr(10) || 'repo: ' || source || chr(10) || 'task: ' || lang || chr(10) || 'test_command: not configured' AS text FROM documents",
        "symbols_ast": """SELECT doc_id || '.py' AS path, s.ord, s.kind, CASE s.name WHEN 'C' THEN 'C' || doc_id WHEN 'f' THEN 'f' || doc_id ELSE s.name END AS name, s.line
            FROM documents, (VALUES (0, 'class', 'C', 1), (1, 'function', 'f', 7), (2, 'function', 'inner', 2)) AS s(ord, kind, name, line) WHERE doc_id % 5 <> 0""",
        **_more_sql(),
        "tool_notes": f"SELECT event_id, CASE WHEN length(props) % 3 = 0 AND length(event_type) % 2 = 0 THEN '{policy.EDITED_NOTE}' WHEN length(props) % 3 = 1 AND length(event_type) % 2 = 1 THEN '{policy.FAILED_NOTE}' END AS note FROM events",
    }
