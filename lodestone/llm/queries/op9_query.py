"""op9_chat_formatting: all of ``conversations`` in reply order, without quotes."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from lodestone.llm.chat import format_chats
from lodestone.llm.common import table


def op9_chat_formatting(spark: SparkSession, sf_dir: str) -> DataFrame:
    columns = ("conv_id", "turn", "role", "message_no", "reply_to", "branch", "position", "n_quoted_lines", "n_links", "content", "formatted")
    return format_chats(table(spark, sf_dir, "conversations")).select(*columns)


#: Ordering of messages of one turn by hash is the only thing that SQL leaves out: it expects distinct turns.
CHAT_SQL = r"""
WITH RECURSIVE msgs AS (
  SELECT conv_id, turn, coalesce(role, 'unknown') AS role, coalesce(text, '') AS text,
         row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST) - 1 AS seq FROM conversations),
split AS (SELECT conv_id, seq, string_split(text, chr(10)) AS ls FROM msgs),
lines AS (SELECT conv_id, seq, unnest(range(0, len(ls))) AS i, unnest(ls) AS line FROM split),
marked AS (SELECT *, regexp_extract(line, '^((?:[ \t]*>)+)', 1) AS marks FROM lines),
levels AS (
  SELECT conv_id, seq, i, line, length(regexp_replace(marks, '[^>]', '', 'g')) AS level, substr(line, length(marks) + 1) AS content FROM marked),
runs AS (
  SELECT *, i - row_number() OVER (PARTITION BY conv_id, seq, level ORDER BY i) AS island,
         lead(level) OVER (PARTITION BY conv_id, seq ORDER BY i) AS next_level FROM levels),
passages AS (
  SELECT conv_id, seq, level, min(i) AS passage, string_agg(content, ' ' ORDER BY i) AS text FROM runs GROUP BY conv_id, seq, level, island),
sentences AS (
  SELECT DISTINCT conv_id, seq, level, passage, trim(regexp_replace(lower(s), '[^\p{L}\p{N}]+', ' ', 'g')) AS s
  FROM (SELECT conv_id, seq, level, passage, unnest(regexp_split_to_array(text, '[.!?]+')) AS s FROM passages)),
firsts AS (SELECT conv_id, s, min(seq) AS first FROM sentences WHERE level = 0 AND s <> '' GROUP BY conv_id, s),
targets AS (
  SELECT q.conv_id, q.seq, q.passage, q.level, f.first, count(*) AS n
  FROM sentences AS q JOIN firsts AS f ON q.conv_id IS NOT DISTINCT FROM f.conv_id AND q.s = f.s
  WHERE q.level > 0 AND f.first < q.seq GROUP BY ALL),
links AS (
  SELECT conv_id, seq, arg_max(first, (-level, n, first)) AS linked, count(DISTINCT passage) AS n_links FROM targets GROUP BY conv_id, seq),
replies AS (
  SELECT m.conv_id, m.seq, coalesce(l.linked, CASE WHEN m.seq > 0 THEN m.seq - 1 END) AS reply_to, coalesce(n_links, 0) AS n_links
  FROM msgs AS m LEFT JOIN links AS l ON m.conv_id IS NOT DISTINCT FROM l.conv_id AND m.seq = l.seq),
ranked AS (
  SELECT *, reply_to IS NULL OR row_number() OVER (PARTITION BY conv_id, reply_to ORDER BY seq) > 1 AS begins FROM replies),
chain AS (
  SELECT conv_id, seq, seq AS branch, 0::BIGINT AS position FROM ranked WHERE begins
  UNION ALL
  SELECT r.conv_id, r.seq, c.branch, c.position + 1
  FROM chain AS c JOIN ranked AS r ON r.conv_id IS NOT DISTINCT FROM c.conv_id AND r.reply_to = c.seq AND NOT r.begins),
own AS (
  SELECT conv_id, seq, count(*) FILTER (level > 0) AS n_quoted,
         trim(coalesce(string_agg(line, chr(10) ORDER BY i) FILTER (
           level = 0 AND NOT (coalesce(next_level, 0) > 0 AND regexp_matches(line, '(?i)^\s*on\s.*\swrote:\s*$'))), ''), chr(32) || chr(9) || chr(13) || chr(10)) AS kept
  FROM runs GROUP BY conv_id, seq),
chats AS (
  SELECT m.conv_id, m.turn, m.role, m.seq AS message_no, r.reply_to, c.branch, c.position, n_quoted AS n_quoted_lines, r.n_links,
         CASE WHEN n_quoted > 0 THEN kept ELSE m.text END AS content
  FROM msgs AS m
  JOIN replies AS r ON m.conv_id IS NOT DISTINCT FROM r.conv_id AND m.seq = r.seq
  JOIN chain AS c ON m.conv_id IS NOT DISTINCT FROM c.conv_id AND m.seq = c.seq
  JOIN own AS o ON m.conv_id IS NOT DISTINCT FROM o.conv_id AND m.seq = o.seq)
SELECT *, '<|' || role || '|>' || chr(10) || replace(content, '<|', '< |') || '<|end|>' || chr(10) AS formatted FROM chats"""

QUERIES = {"op9_chat_formatting": op9_chat_formatting}
ORACLE_SQL = {"op9_chat_formatting": CHAT_SQL}
