"""Session-shaped views of the given tables, in SQL that both Spark and other engines read alike."""

from __future__ import annotations

import re
import zlib

from pyspark.sql import DataFrame, SparkSession

VIEWS = {
    "fx_messages": """
SELECT concat('c', CAST(conv_id AS VARCHAR(20))) AS session_id, turn + 1 AS row_id,
       concat('c', CAST(conv_id AS VARCHAR(20)), ':', CAST(turn AS VARCHAR(20))) AS entry_id,
       CASE WHEN role = 'system' THEN 'custom' ELSE role END AS role, text,
       CAST(ceil(length(text) / 4.0) AS BIGINT) AS tokens, conv_id * 86400000 + turn * 60000 AS ts_ms
FROM conversations""",
    "fx_tool_messages": """
SELECT session_id, row_id, entry_id, role, text, CAST(ceil(length(text) / 4.0) AS BIGINT) AS tokens, ts_ms,
       CASE WHEN event_id % 97 = 0 THEN ts_ms END AS removed_at_ms
FROM (SELECT concat('u', CAST(user_id AS VARCHAR(20))) AS session_id,
             CAST(row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS BIGINT) AS row_id,
             concat('e', CAST(event_id AS VARCHAR(20))) AS entry_id, event_id, event_id * 1000 AS ts_ms,
             CASE event_id % 4 WHEN 0 THEN 'user' WHEN 1 THEN 'assistant' ELSE 'toolResult' END AS role,
             CASE event_id % 4 WHEN 0 THEN concat('please look at ', event_type)
                  WHEN 1 THEN concat('[tool:', event_type, '] ', props)
                  WHEN 2 THEN concat('value ', props)
                  ELSE concat('tool ', event_type, ' ', props) END AS text
      FROM events) e""",
    "fx_cut_messages": """
SELECT session_id, row_id, CASE WHEN session_id LIKE '%1' THEN CASE WHEN row_id = 1 THEN 'user' WHEN row_id % 3 = 0 THEN 'toolResult' ELSE 'assistant' END
       WHEN session_id LIKE '%2' THEN 'assistant' WHEN session_id LIKE '%3' THEN CASE WHEN row_id = 1 THEN 'user' ELSE 'toolResult' END
       WHEN session_id LIKE '%4' THEN CASE WHEN row_id % 40 = 39 THEN 'user' ELSE 'assistant' END ELSE role END AS role,
       CASE WHEN row_id % 11 = 5 THEN NULL ELSE tokens END AS tokens
FROM fx_tool_messages""",
    "fx_leaves": """
SELECT session_id, CAST(floor((row_id - 1) / 3.0) AS BIGINT) AS chunk,
       min(row_id) AS lo, max(row_id) AS hi, CAST(sum(tokens) AS BIGINT) AS tokens
FROM fx_messages GROUP BY session_id, CAST(floor((row_id - 1) / 3.0) AS BIGINT)""",
    "fx_condensed": """
SELECT session_id, min(lo) AS lo, max(hi) AS hi, CAST(sum(tokens) AS BIGINT) AS tokens
FROM fx_leaves WHERE chunk < 2 GROUP BY session_id HAVING count(*) = 2""",
    "fx_summaries": """
SELECT session_id, chunk + 1 AS id, 'leaf' AS kind, 0 AS depth,
       concat(session_id, ':', CAST(lo - 1 AS VARCHAR(20))) AS first_entry_id,
       concat(session_id, ':', CAST(hi - 1 AS VARCHAR(20))) AS last_entry_id, tokens,
       CASE WHEN (chunk + hi) % 5 = 0 THEN 'mechanical' WHEN (chunk + hi) % 7 = 0 THEN 'clipped' ELSE 'clean' END AS quality,
       'committed' AS status
FROM fx_leaves
UNION ALL
SELECT session_id, 100 AS id, 'condensed', 1, concat(session_id, ':', CAST(lo - 1 AS VARCHAR(20))),
       concat(session_id, ':', CAST(hi - 1 AS VARCHAR(20))), tokens, 'clean', 'committed' FROM fx_condensed""",
    "fx_provenance": """
SELECT session_id, CAST(floor((row_id - 1) / 3.0) AS BIGINT) + 1 AS summary_id, 'message' AS child_type, row_id AS child_id
FROM fx_messages WHERE row_id < 8
UNION ALL
SELECT s.session_id, 100, 'summary', l.id FROM fx_summaries s JOIN fx_summaries l
  ON s.session_id = l.session_id AND s.id = 100 AND l.id <= 2 AND l.kind = 'leaf'""",
    "fx_metrics": """
SELECT event_id AS pos, concat('s', CAST(user_id AS VARCHAR(20))) AS session, event_id * 60000 AS ts,
       CASE event_type WHEN 'view' THEN 'usage' ELSE 'lcm' END AS event,
       CASE event_type WHEN 'click' THEN 'context-decision' WHEN 'purchase' THEN 'summarizer-usage'
            WHEN 'error' THEN 'summarizer-error' WHEN 'signup' THEN 'swap-applied' END AS kind,
       CASE event_type WHEN 'click' THEN value / 100 END AS occupancy,
       CASE event_type WHEN 'signup' THEN CAST(floor(CAST(regexp_extract(props, '[0-9]+', 0) AS BIGINT) / 10.0) AS BIGINT) END AS cut_count,
       CASE event_type WHEN 'purchase' THEN concat('m', CAST(event_id % 3 AS VARCHAR(20))) END AS model,
       CASE event_type WHEN 'purchase' THEN CASE event_id % 2 WHEN 0 THEN 'blocking' ELSE 'async' END END AS stage,
       CAST(regexp_extract(props, '[0-9]+', 0) AS BIGINT) AS input, value AS cost_total
FROM events""",
    "fx_files": """
SELECT doc_id, concat(source, '/', CAST(doc_id AS VARCHAR(20)), CASE doc_id % 4 WHEN 0 THEN '.md' WHEN 1 THEN '.txt' WHEN 2 THEN '.py' ELSE '.csv' END) AS path, text
FROM documents""",
}
#: Files of every kind, made of documents.
VIEWS["fx_kinds"] = """
SELECT doc_id, doc_id % 9 AS form, concat('f/', CAST(doc_id AS VARCHAR(20)), CASE doc_id % 9 WHEN 4 THEN '.py' WHEN 5 THEN '.sql' WHEN 6 THEN '.md' WHEN 7 THEN '.sh' ELSE '.dat' END) AS path,
  CASE doc_id % 9
    WHEN 0 THEN concat('{"n": ', CAST(doc_id AS VARCHAR(20)), ', "who": "', source, '", "zone": {"b": 1, "a": [', CAST(n_chars AS VARCHAR(20)), ']}, "list": [', CASE WHEN doc_id % 2 = 0 THEN '"x", "y"' ELSE '' END, '], "none": null, "on": true}')
    WHEN 1 THEN concat('[{"z": ', CAST(n_chars AS VARCHAR(20)), ', "a": "', source, '"}, {"z": 2}]')
    WHEN 2 THEN concat('{"z": 1, "', source, '": 2}', chr(10), chr(10), '{"a": ', CAST(n_chars AS VARCHAR(20)), '}')
    WHEN 3 THEN concat('name', CASE WHEN doc_id % 2 = 0 THEN ',' ELSE chr(9) END, ' ', source, chr(10), '1', CASE WHEN doc_id % 2 = 0 THEN ',' ELSE chr(9) END, '2', chr(10))
    WHEN 4 THEN concat('import os', chr(10), 'class ', upper(source), ':', chr(10), '    def inner(self): pass', chr(10), 'async def f', CAST(doc_id AS VARCHAR(20)), '(x):', chr(10), '    return x')
    WHEN 5 THEN concat('create or replace view ', source, ' as select 1;', chr(10), 'CREATE TABLE IF NOT EXISTS t', CAST(doc_id AS VARCHAR(20)), ' (a int);', chr(10), 'select 1')
    WHEN 6 THEN concat('# ', source, chr(10), chr(10), 'words here', chr(10), '### part ', CAST(n_chars AS VARCHAR(20)))
    WHEN 7 THEN concat('run', CAST(doc_id AS VARCHAR(20)), '() {', chr(10), '  true', chr(10), '}', chr(10), 'run', CAST(doc_id AS VARCHAR(20)))
    ELSE text END AS text
FROM documents"""
#: A telemetry log of all kinds of rows.
VIEWS["fx_log"] = """
SELECT *, CASE WHEN k < 2 THEN 'projection' WHEN k = 2 THEN 'compaction-checkpoint' WHEN k = 3 THEN 'pass' WHEN k = 4 THEN 'summary-stored' WHEN k = 5 THEN 'summary-replaced'
    WHEN k = 6 AND j % 2 = 0 THEN 'summary-skipped-existing' WHEN k = 6 THEN 'summary-fallback-stored' WHEN k = 7 THEN 'summarizer-usage' WHEN k = 8 AND j % 3 = 0 THEN 'summarizer-capped' WHEN k = 8 THEN 'summarizer-error'
    WHEN k = 9 THEN 'compaction-abandoned' WHEN k = 10 THEN 'heal-complete' WHEN k = 11 THEN 'recall' WHEN j % 7 = 0 THEN 'frontier-over-target' ELSE 'reader' END AS kind,
  CASE WHEN k < 2 THEN CASE j % 5 WHEN 0 THEN 'swap' WHEN 1 THEN 'kick' WHEN 2 THEN 'bail' WHEN 3 THEN 'reapply' ELSE 'quiet' END WHEN k = 2 THEN CASE j % 3 WHEN 0 THEN 'checkpoint' WHEN 1 THEN 'skip' ELSE 'fail' END END AS action,
  CASE WHEN k < 2 AND j % 11 > 0 THEN concat('r', CAST(j % 7 AS VARCHAR(20))) WHEN k = 12 AND j % 7 = 0 THEN concat('r', CAST(j % 2 AS VARCHAR(20))) END AS reason,
  CASE k WHEN 3 THEN CASE j % 3 WHEN 0 THEN 'stored' WHEN 1 THEN 'nothing' ELSE 'failed' END WHEN 11 THEN CASE j % 4 WHEN 0 THEN 'hit' WHEN 1 THEN 'miss' WHEN 2 THEN 'refused' ELSE 'error' END WHEN 12 THEN CASE j % 3 WHEN 0 THEN 'answered' WHEN 1 THEN 'failed' ELSE 'timeout' END END AS outcome,
  CASE WHEN k IN (4, 5, 7) THEN CASE j % 2 WHEN 0 THEN 'leaf' ELSE 'condensed' END END AS stage, CASE WHEN j % 10 < 9 THEN concat('t', CAST(j % 9 AS VARCHAR(20))) END AS tool, CASE WHEN j % 4 > 0 THEN pos * 37 % 5000 END AS duration_ms,
  j % 3 AS leaf, j % 2 AS condensed, j % 5 AS dropped, j % 4 AS repaired, j % 3 AS improved, j % 2 AS failed, j % 6 AS blocked, j % 2 AS blocked_source, j % 8 AS calls, j % 3 AS skipped, j % 2 AS changed, j % 5 AS not_attempted,
  CASE j % 3 WHEN 0 THEN 'done' WHEN 1 THEN 'max-nodes' ELSE 'max-calls' END AS stop, CASE WHEN j % 9 > 0 THEN occ END AS occupancy, CASE WHEN j % 6 > 0 THEN 0.85 END AS commit_at, pos % 5000 AS tokens, pos % 777 AS chars,
  j % 4 = 0 AS estimated, j % 5 = 0 AS rejected, CASE WHEN j % 3 = 0 THEN j END AS summary_id, CASE WHEN j % 3 = 1 THEN concat('e', CAST(j AS VARCHAR(20))) END AS entry_id, pos % 900 AS before_tokens, pos % 700 AS after_tokens,
  pos % 400 AS frontier_tokens, 100 + j % 50 AS target_tokens, CASE j % 3 WHEN 0 THEN 'tool' WHEN 1 THEN 'loop' END AS caller, j % 5 = 1 AS oversized, j % 6 = 2 AS truncated
FROM (SELECT event_id AS pos, event_id % 13 AS k, j13 AS j, concat('s', CAST(user_id AS VARCHAR(20))) AS session, 86400000 + event_id * 60000 AS ts, 'lcm' AS event, value / 100 AS occ FROM (SELECT *, CAST(floor(event_id / 13.0) AS BIGINT) AS j13 FROM events) x) e"""
#: Broken summaries and edges, one defect a session, for integrity checks and repairs.
VIEWS |= {
    "bad_summaries": """
SELECT session_id, id, kind, depth, first_entry_id, last_entry_id, tokens, quality, status, CAST(NULL AS VARCHAR(20)) AS run FROM fx_summaries
UNION ALL SELECT session_id, 200, 'leaf', 0, 'missing', last_entry_id, tokens, quality, 'committed', NULL FROM fx_summaries WHERE id = 1 AND length(session_id) % 2 = 0
UNION ALL SELECT session_id, 201, 'leaf', 0, last_entry_id, first_entry_id, tokens, quality, 'committed', NULL FROM fx_summaries WHERE id = 1 AND first_entry_id <> last_entry_id AND session_id LIKE '%1'
UNION ALL SELECT session_id, 202, 'leaf', 3, first_entry_id, last_entry_id, tokens, quality, 'committed', NULL FROM fx_summaries WHERE id = 1 AND session_id LIKE '%2'
UNION ALL SELECT session_id, 203, kind, depth, first_entry_id, last_entry_id, tokens, quality, 'committed', NULL FROM fx_summaries WHERE id = 1 AND session_id LIKE '%3'
UNION ALL SELECT session_id, 204, 'condensed', 2, first_entry_id, last_entry_id, tokens, quality, 'pending', 'dead' FROM fx_summaries WHERE id = 1 AND session_id LIKE '%4'""",
    "bad_provenance": """
SELECT session_id, summary_id, child_type, child_id FROM fx_provenance
UNION ALL SELECT session_id, 100, 'summary', 999 FROM fx_summaries WHERE id = 100 AND session_id LIKE '%5'
UNION ALL SELECT session_id, 1, 'summary', 100 FROM fx_summaries WHERE id = 100 AND session_id LIKE '%6'
UNION ALL SELECT session_id, 202, 'message', 1 FROM fx_summaries WHERE id = 1 AND session_id LIKE '%2'""",
}
#: Graphs of some depth: a binary tree over the leaves of each session with a cycle in some, and chains, broken at the end in some.
VIEWS |= {
    "deep_provenance": """
SELECT session_id, 1000000 * level + CAST(floor((row_id - 1) / width) AS BIGINT) AS summary_id, 'summary' AS child_type,
       1000000 * (level - 1) + CAST(floor((row_id - 1) / (width / 2)) AS BIGINT) AS child_id
FROM fx_tool_messages CROSS JOIN (VALUES (1, 16.0), (2, 32.0), (3, 64.0), (4, 128.0), (5, 256.0)) AS l(level, width)
GROUP BY session_id, level, CAST(floor((row_id - 1) / width) AS BIGINT), CAST(floor((row_id - 1) / (width / 2)) AS BIGINT)
UNION ALL SELECT session_id, CAST(floor((row_id - 1) / 8.0) AS BIGINT), 'message', row_id FROM fx_tool_messages
UNION ALL SELECT session_id, CAST(0 AS BIGINT), 'summary', CAST(3000000 AS BIGINT) FROM fx_tool_messages WHERE row_id = 1 AND session_id LIKE '%7'""",
    "deep_summaries": """
SELECT session_id, summary_id AS id, CAST(floor(summary_id / 1000000.0) AS INTEGER) AS depth,
       CASE WHEN summary_id % 1000000 % 9 = 2 THEN 'mechanical' WHEN summary_id % 1000000 % 13 = 4 THEN 'clipped' WHEN summary_id % 1000000 % 17 = 6 THEN 'derived' ELSE 'clean' END AS quality,
       'committed' AS status, 100 + summary_id % 13 AS tokens
FROM deep_provenance GROUP BY session_id, summary_id""",
    "heal_attempts": """
SELECT session_id, id, tokens + CASE WHEN id % 1000000 % 19 = 2 THEN 1 ELSE 0 END AS expected_tokens,
       CASE WHEN id % 1000000 % 16 = 3 THEN 0 WHEN id % 1000000 % 21 = 4 THEN 900 ELSE 40 END AS new_tokens,
       CASE WHEN id % 1000000 % 14 = 11 THEN 3 ELSE 1 END AS new_level,
       CASE WHEN id % 1000000 % 31 = 6 THEN NULL WHEN id % 1000000 % 3 = 1 THEN 'clipped' WHEN id % 1000000 % 11 = 2 THEN 'derived' ELSE 'clean' END AS source_quality
FROM deep_summaries WHERE id % 1000000 % 37 <> 5""",
    "chain_summaries": """
SELECT session_id, row_id AS id, CASE WHEN row_id = 30 AND session_id LIKE '%5' THEN 'pending' ELSE 'committed' END AS status FROM fx_tool_messages WHERE row_id <= 40""",
    "chain_provenance": """
SELECT session_id, row_id AS summary_id, 'summary' AS child_type, row_id - 1 AS child_id FROM fx_tool_messages
WHERE row_id <= 40 AND (row_id > 1 OR session_id LIKE '%3' OR session_id LIKE '%5')""",
}
BASE = ("conversations", "events", "documents", "orders", "customer")


def with_views(sql: str) -> str:
    """``sql`` with the views that it names, and those that they name, as common table expressions."""
    needed: list[str] = []

    def add(text: str) -> None:
        for name in VIEWS:
            if re.search(rf"\b{name}\b", text) and name not in needed:
                add(VIEWS[name])
                needed.append(name)

    add(sql)
    views = ", ".join(f"{name} AS ({VIEWS[name]})" for name in VIEWS if name in needed)
    if not views:
        return sql
    body = sql.strip()
    recursive = "RECURSIVE " if re.match(r"WITH\s+RECURSIVE\b", body, re.I) else ""
    if re.match(r"WITH\b", body, re.I):
        return f"WITH {recursive}{views}, " + re.sub(r"^WITH\s+(RECURSIVE\s+)?", "", body, flags=re.I)
    return f"WITH {views} {body}"


def view(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of the views over the tables in ``sf_dir``."""
    return over_tables(spark, sf_dir, with_views(f"SELECT * FROM {name}"))


def over_tables(spark: SparkSession, sf_dir: str, sql: str) -> DataFrame:
    """``sql`` over the tables in ``sf_dir``; they stand in temporary views of names of their own, so none of the session's is replaced."""
    for table in BASE:
        if re.search(rf"\b{table}\b", sql):
            own = f"sessionloom_{table}_{zlib.crc32(sf_dir.encode()):08x}"
            spark.read.parquet(f"{sf_dir}/{table}.parquet").createOrReplaceTempView(own)
            sql = re.sub(rf"\b{table}\b", own, sql)
    return spark.sql(sql)
