"""Queries of host histories, views, and evaluation."""

from __future__ import annotations

import uuid
from urllib.parse import quote

import pandas as pd
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import functions as F

from sessionloom.jobs.dag_queries import _BELOW, _FRONTIER, _graph
from sessionloom.operators import compact as P
from sessionloom.operators import dag as D
from sessionloom.operators import evaluation as L
from sessionloom.operators import ingest as C
from sessionloom.operators import reports as K
from sessionloom.operators import search as E
from sessionloom.operators import views as V
from sessionloom.registry import query
from sessionloom.sources import sessions as A
from sessionloom.sources.fixtures import view


def _events(spark, d):
    return spark.read.parquet(f"{d}/events.parquet")


def _messages(spark, d):
    return view(spark, d, "fx_messages")


@query("a01_read_messages", "SELECT conv_id, turn, role, text FROM conversations")
def read_messages(spark, d):
    return A.read_messages(spark, f"{d}/conversations.parquet").select("conv_id", "turn", "role", "text")


@query(
    "a02_session_headers",
    """SELECT session_id AS file, concat('id-', session_id) AS session_id, concat('/work/', count(*) % 3) AS cwd, CASE WHEN count(*) % 2 = 0 THEN 1700000000000 ELSE min(ts_ms) END AS when_ms
       FROM fx_messages WHERE NOT session_id LIKE '%9' GROUP BY session_id""",
)
def headers(spark, d):
    m = _messages(spark, d)
    n = m.groupBy("session_id").agg(F.count("*").alias("n"))
    stamp = F.when(F.col("n") % 2 == 0, F.lit("2023-11-14T22:13:20Z"))
    head = F.when(F.col("session_id").like("%9"), F.lit("oops")).otherwise(F.to_json(F.struct(F.lit("session").alias("type"), F.concat(F.lit("/work/"), (F.col("n") % 3).cast("string")).alias("cwd"), F.concat(F.lit("id-"), "session_id").alias("id"), stamp.alias("timestamp"))))
    lines = m.join(n, "session_id").select(F.col("session_id").alias("file"), F.col("row_id").alias("line_no"), F.when(F.col("row_id") == 1, head).otherwise(F.col("text")).alias("line"), F.col("ts_ms").alias("mtime_ms"))
    return A.session_headers(lines)


def _session_files(spark, d, rows):
    """Rows (session_id, row_id, line) written as text files, one a session, and their folder.

    Tasks write the files themselves, all of a task in one folder: a folder for each session would have to be moved by the driver and listed
    on its own. A task that runs again replaces its files.
    """
    path = f"{D.shared_folder(spark)}/files-{uuid.uuid4().hex}"

    def write(batches):
        store, base = fs.FileSystem.from_uri(path)
        folder = f"{base}/part-{TaskContext.get().partitionId():05d}"
        store.create_dir(folder)
        last = out = None
        n = 0
        for pdf in batches:
            for session, line in zip(pdf["session_id"], pdf["line"], strict=True):
                if session != last:
                    if out is not None:
                        out.close()
                    last, n = session, n + 1
                    out = store.open_output_stream(f"{folder}/session_id={quote(session, safe='')}.txt", compression=None)
                out.write(((line or "") + "\n").encode())
        if out is not None:
            out.close()
        yield pd.DataFrame({"n": [n]})

    rows.repartition(F.xxhash64("session_id")).sortWithinPartitions("session_id", "row_id").mapInPandas(write, "n long").agg(F.sum("n")).collect()
    return path


@query(
    "a02_read_headers",
    """SELECT concat('id-', session_id) AS session_id, concat('/work/', count(*) % 3) AS cwd, count(*) % 2 = 0 AS stamped, CASE WHEN count(*) % 2 = 0 THEN 1700000000000 END AS when_ms
       FROM fx_messages WHERE NOT session_id LIKE '%9' GROUP BY session_id""",
)
def read_headers(spark, d):
    """Files of each session with a header as the first line; in half of them the file's own time counts."""
    m = _messages(spark, d)
    n = m.groupBy("session_id").agg(F.count("*").alias("n"))
    stamp = F.when(F.col("n") % 2 == 0, F.lit("2023-11-14T22:13:20Z"))
    head = F.when(F.col("session_id").like("%9"), F.lit("oops")).otherwise(F.to_json(F.struct(F.lit("session").alias("type"), F.concat(F.lit("/work/"), (F.col("n") % 3).cast("string")).alias("cwd"), F.concat(F.lit("id-"), "session_id").alias("id"), stamp.alias("timestamp"))))
    rows = n.select("session_id", F.lit(0).cast("long").alias("row_id"), head.alias("line")).unionByName(m.select("session_id", "row_id", F.to_json(F.struct("role", "text")).alias("line")))
    found = A.read_session_headers(spark, _session_files(spark, d, rows))
    stamped = F.col("when_ms") == 1_700_000_000_000
    return found.select("session_id", "cwd", stamped.alias("stamped"), F.when(stamped, F.col("when_ms")).alias("when_ms"))


@query("a08_read_inventory", "SELECT session_id, CAST(sum(strlen(text) + 1) AS BIGINT) AS bytes FROM (SELECT session_id, replace(replace(text, chr(10), ' '), chr(13), ' ') AS text FROM fx_messages) q GROUP BY session_id")
def read_inventory(spark, d):
    """Sizes of files written of each session's texts."""
    m = _messages(spark, d)
    files = A.read_inventory(spark, _session_files(spark, d, m.select("session_id", "row_id", F.translate("text", "\n\r", "  ").alias("line"))))
    return files.select(F.url_decode(F.regexp_extract("path", r"session_id=([^/]*)\.txt$", 1)).alias("session_id"), "bytes")


@query("a08_inventory", "SELECT path, CAST(length(text) AS BIGINT) AS mtime_ms FROM fx_files WHERE doc_id <> 7 ORDER BY mtime_ms DESC, path")
def inventory(spark, d):
    f = view(spark, d, "fx_files").filter("doc_id <> 7")
    return A.inventory(f.select("path", F.length("text").cast("long").alias("mtime_ms")), "none")


@query("b06_tool_text", "SELECT event_id, concat('tool ', event_type, ' ', props, chr(10), CASE WHEN event_id % 3 = 0 THEN concat('error: ', event_id) WHEN event_id % 3 = 1 THEN CAST(event_id AS VARCHAR) ELSE '' END) AS text FROM events")
def tool_text(spark, d):
    n = F.col("event_id").cast("string")
    return _events(spark, d).select("event_id", A.tool_text(F.col("event_type"), F.col("props"), F.when(F.col("event_id") % 3 == 1, n), F.when(F.col("event_id") % 3 == 0, n)).alias("text"))


@query("b25_b26_billed", "SELECT event_id, CAST(event_id AS DOUBLE) AS input, CASE WHEN event_id % 2 = 0 THEN CAST(event_id * 2 AS DOUBLE) END AS cache_read, CASE WHEN event_id % 2 = 0 THEN CAST(event_id * 3 AS DOUBLE) END AS used FROM events")
def billed(spark, d):
    n = F.col("event_id").cast("string")
    usage = F.concat(F.lit('{"input":'), n, F.when(F.col("event_id") % 2 == 0, F.concat(F.lit(',"cache":{"read":'), (F.col("event_id") * 2).cast("string"), F.lit("}}"))).otherwise(F.lit(',"output":"x"}')))
    e = _events(spark, d).select("event_id", usage.alias("usage"))
    return e.select("event_id", *A.billed(F.col("usage")), A.input_tokens(F.col("usage")).alias("used")).drop("output", "cost_total")


@query(
    "b25_usage_rows",
    """SELECT event_id, CASE WHEN event_id % 4 = 0 THEN CAST(event_id AS DOUBLE) END AS input, CASE WHEN event_id % 4 = 1 THEN CAST(event_id * 2 AS DOUBLE) END AS cache_read, CASE WHEN event_id % 4 = 1 THEN value END AS cost_total, event_id % 8 = 0 AS estimated
 FROM events WHERE event_id % 4 < 2""",
)
def usage_rows(spark, d):
    """Usage objects with a counter, with nested ones, with texts in place of numbers, and none."""
    n = F.col("event_id").cast("string")
    first = F.concat(F.lit('{"input":'), n, F.when(F.col("event_id") % 8 == 0, F.lit(',"estimated":true}')).otherwise(F.lit("}")))
    second = F.concat(F.lit('{"cacheRead":'), (F.col("event_id") * 2).cast("string"), F.lit(',"cost":{"total":'), F.col("value").cast("string"), F.lit("}}"))
    usage = F.when(F.col("event_id") % 4 == 0, first).when(F.col("event_id") % 4 == 1, second).when(F.col("event_id") % 4 == 2, F.concat(F.lit('{"input":"'), n, F.lit('"}')))
    return A.usage_rows(_events(spark, d).select("event_id", usage.alias("usage"))).select("event_id", "input", "cache_read", "cost_total", "estimated")


@query("b32_attachments", "SELECT event_id, CASE event_id % 3 WHEN 0 THEN event_type WHEN 1 THEN concat(event_type, chr(10), '[attachments: a', event_id, ', b]') ELSE concat(event_type, chr(10), '[attachments: 2]') END AS text FROM events")
def attachments(spark, d):
    i = F.col("event_id")
    names = F.when(i % 3 == 0, F.array().cast("array<string>")).when(i % 3 == 1, F.array(F.concat(F.lit("a"), i.cast("string")), F.lit(""), F.lit("b"))).otherwise(F.array(F.lit(""), F.lit("")))
    return _events(spark, d).select("event_id", A.prompt_text(F.col("event_type"), names).alias("text"))


_REPLY = """CASE CAST(regexp_extract(props, '[0-9]+', 0) AS BIGINT) % 6 WHEN 0 THEN upper(event_type) WHEN 1 THEN concat('No ', event_type) WHEN 2 THEN concat('Refused: ', props)
 WHEN 3 THEN '  ' WHEN 4 THEN concat('nothing ', event_type) ELSE concat(event_type, ' ', props) END"""


@query("b33_outcomes", f"SELECT event_id, CASE WHEN lower(r) LIKE 'error%' THEN 'error' WHEN lower(r) LIKE 'refused%' THEN 'refused' WHEN lower(r) LIKE 'no %' OR trim(r) = '' THEN 'miss' ELSE 'hit' END AS outcome FROM (SELECT event_id, {_REPLY} AS r FROM events) q")
def outcomes(spark, d):
    return _events(spark, d).select("event_id", A.query_outcome(F.expr(_REPLY)).alias("outcome"))


@query("b34_host_text", "SELECT event_id, CASE WHEN event_type = 'click' THEN concat('$ ', props, chr(10), event_id) ELSE event_type END AS text FROM events")
def host_text(spark, d):
    e = _events(spark, d)
    role = F.when(F.col("event_type") == "click", "bashExecution").otherwise("user")
    return e.select("event_id", A.host_text(role, F.col("event_type"), F.col("props"), F.col("event_id").cast("string")).alias("text"))


@query("c05_path_hints", "SELECT event_id, concat('/f/', CASE WHEN event_id % 10 = 9 THEN event_id ELSE (event_id // 10) * 10 + 9 END) AS path FROM events WHERE (event_id // 10) * 10 + 9 <= (SELECT max(event_id) FROM events)")
def hints(spark, d):
    e = _events(spark, d)
    top = e.agg(F.max("event_id").alias("top"))
    group = F.floor(F.col("event_id") / 10)
    rows = e.join(F.broadcast(top), group * 10 + 9 <= F.col("top")).select("event_id", F.lit("s").alias("session_id"), group.cast("string").alias("call_id"), F.col("event_id").alias("pos"))
    key = F.when(F.col("event_id") % 2 == 0, "path").otherwise("filePath")
    calls = rows.withColumn("arguments", F.concat(F.lit('{"'), key, F.lit('":"/f/'), F.col("event_id").cast("string"), F.lit('"}')))
    return A.path_hints(calls.drop("event_id"), rows).select("event_id", "path")


_PARTS = """p AS (SELECT event_id, concat('s', user_id) AS session_id, concat('m', event_id // 50) AS message_id, event_id AS pos, CASE event_type WHEN 'click' THEN 'tool' WHEN 'signup' THEN 'prompt' ELSE 'text' END AS type,
 CASE WHEN event_id % 7 = 0 THEN '' ELSE event_type END AS text, concat('k', event_id) AS call_id, CASE WHEN event_id % 3 = 0 THEN 'running' ELSE 'completed' END AS status FROM events)"""


@query(
    "c06_entry_ids",
    f"""WITH {_PARTS}, o AS (SELECT *, count(*) FILTER (type = 'text') OVER (PARTITION BY session_id, message_id ORDER BY pos) - 1 AS ordinal FROM p)
        SELECT event_id, CASE WHEN type = 'prompt' THEN concat(session_id, ':prompt:', message_id) WHEN type = 'text' THEN concat(session_id, ':text:', message_id, ':', ordinal) ELSE concat(session_id, ':tool:', message_id, ':', call_id) END AS entry_id
        FROM o WHERE type = 'prompt' OR type = 'text' AND text <> '' OR type = 'tool' AND status = 'completed'""",
)
def entry_ids(spark, d):
    return A.entry_ids(_parts(spark, d)).select("event_id", "entry_id")


def _parts(spark, d):
    i = F.col("event_id")
    kind = F.when(F.col("event_type") == "click", "tool").when(F.col("event_type") == "signup", "prompt").otherwise("text")
    name = lambda p, c: F.concat(F.lit(p), c.cast("string"))
    return _events(spark, d).select("event_id", name("s", F.col("user_id")).alias("session_id"), name("m", F.floor(i / 50)).alias("message_id"), i.alias("at"), kind.alias("type"), F.when(i % 7 == 0, "").otherwise(F.col("event_type")).alias("text"), name("k", i).alias("call_id"), F.when(i % 3 == 0, "running").otherwise("completed").alias("status"))


@query(
    "c07_silent_messages",
    f"WITH {_PARTS} SELECT session_id, message_id FROM p GROUP BY 1, 2 HAVING count(*) FILTER (type = 'prompt' OR type = 'text' AND text <> '' OR type = 'tool' AND status = 'completed') = 0",
)
def silent(spark, d):
    parts = _parts(spark, d)
    return A.silent_messages(parts.select("session_id", "message_id").distinct(), A.entry_ids(parts))


@query("c10_compaction_marks", "SELECT session_id, left(sha256(string_agg(entry_id, ':' ORDER BY row_id)), 24) AS mark, count(*) AS n FROM fx_messages GROUP BY session_id")
def marks(spark, d):
    return A.compaction_marks(_messages(spark, d).withColumn("pos", F.col("row_id")))


@query("d14_point_reads", "SELECT session_id, row_id, entry_id FROM fx_messages WHERE row_id IN (2, 5)")
def reads(spark, d):
    m = _messages(spark, d)
    return m.join(m.filter("row_id in (2, 5)").select("session_id", "entry_id"), ["session_id", "entry_id"], "left_semi").select("session_id", "row_id", "entry_id")


def _links(spark, d):
    return _messages(spark, d).filter("row_id % 2 = 0").select("session_id", "row_id", F.concat(F.lit("f"), (F.col("row_id") % 4).cast("string")).alias("file_id"))


_EDGES = _BELOW.format(p="fx_provenance") + ", e AS (SELECT DISTINCT b.session_id, b.node AS id, p.child_id AS row_id FROM below b JOIN fx_provenance p ON p.session_id = b.session_id AND p.summary_id = b.child AND p.child_type = 'message')"


@query("d12_d13_files_of_summaries", _EDGES + " SELECT DISTINCT session_id, id, concat('f', row_id % 4) AS file_id FROM e WHERE row_id % 2 = 0")
def node_files(spark, d):
    _, _, p = _graph(spark, d)
    return V.files_of_summaries(p, _links(spark, d))


@query(
    "e12_describe",
    _EDGES + """ SELECT s.session_id, s.id, count(e.row_id) AS messages, count(DISTINCT CASE WHEN e.row_id % 2 = 0 THEN e.row_id % 4 END) AS files FROM fx_summaries s LEFT JOIN e ON e.session_id = s.session_id AND e.id = s.id GROUP BY 1, 2""",
)
def described(spark, d):
    m, s, p = _graph(spark, d)
    return V.describe(s, m, p, _links(spark, d)).select("session_id", "id", "messages", "files")


@query(
    "e12_described_nodes",
    _EDGES + """, t AS (SELECT s.session_id, s.id, coalesce(sum(m.tokens), 0) AS source_tokens FROM fx_summaries s LEFT JOIN e ON e.session_id = s.session_id AND e.id = s.id LEFT JOIN fx_messages m ON m.session_id = e.session_id AND m.row_id = e.row_id GROUP BY 1, 2)
 SELECT s.session_id, s.id, kind, depth, quality, first_entry_id, last_entry_id, tokens, CAST(source_tokens AS BIGINT) AS source_tokens, CASE WHEN s.id % 2 = 0 THEN concat('long ', s.id) ELSE concat('short ', s.id) END AS text FROM fx_summaries s JOIN t ON t.session_id = s.session_id AND t.id = s.id""",
)
def described_nodes(spark, d):
    m, s, p = _graph(spark, d)
    n = F.col("id").cast("string")
    s = s.withColumn("text", F.concat(F.lit("short "), n)).withColumn("thorough_text", F.when(F.col("id") % 2 == 0, F.concat(F.lit("long "), n)))
    return V.describe(s, m, p, _links(spark, d)).select("session_id", "id", "kind", "depth", "quality", "first_entry_id", "last_entry_id", "tokens", "source_tokens", "text")


@query("e06_hidden_hits", "SELECT session_id, count(*) FILTER (removed_at_ms IS NULL) AS visible, count(removed_at_ms) AS hidden FROM fx_tool_messages WHERE text LIKE '%click%' GROUP BY session_id")
def hidden(spark, d):
    m = view(spark, d, "fx_tool_messages")
    hits = E.ranked_search(m, ["click"], removed=True).join(m.select("session_id", "row_id", "removed_at_ms"), ["session_id", "row_id"])
    return hits.groupBy("session_id").agg(F.count_if(F.col("removed_at_ms").isNull()).alias("visible"), F.count("removed_at_ms").alias("hidden"))


@query("e03_e05_scoped_search", "SELECT session_id, row_id FROM fx_tool_messages WHERE removed_at_ms IS NULL AND text LIKE '%click%' AND role = 'toolResult' AND text LIKE 'tool click %'")
def scoped(spark, d):
    m = view(spark, d, "fx_tool_messages")
    return E.ranked_search(m, ["tool", "click"], role="toolResult").join(E.tool_scope(m, "click"), ["session_id", "row_id"], "left_semi").select("session_id", "row_id")


@query("e11_newest_sessions", "SELECT session_id, max(ts_ms) AS when_ms FROM fx_messages WHERE session_id <> 'c3' GROUP BY session_id ORDER BY when_ms DESC, session_id LIMIT 20")
def newest(spark, d):
    h = _messages(spark, d).groupBy("session_id").agg(F.max("ts_ms").alias("when_ms"))
    return A.newest_sessions(h, 20, but="c3")


@query(
    "e16_history",
    _FRONTIER + """, o AS (SELECT session_id, id, CASE WHEN quality = 'mechanical' THEN 1 ELSE 0 END AS overlap, row_number() OVER (PARTITION BY session_id ORDER BY first_row, last_row DESC, depth DESC, id DESC) AS position FROM f),
 q AS (SELECT *, row_number() OVER (PARTITION BY session_id ORDER BY overlap DESC, position) AS place, count(*) OVER (PARTITION BY session_id) AS n FROM o) SELECT session_id, id, place, greatest(n - 1, 0) AS omitted FROM q WHERE place <= 1""",
)
def history(spark, d):
    m, s, p = _graph(spark, d)
    return V.history(D.frontier(s, m, p).withColumn("text", F.col("quality")), "what is mechanical?", 1).select("session_id", "id", "place", "omitted")


@query(
    "e16_history_costs",
    _FRONTIER + """, o AS (SELECT session_id, id, CASE WHEN quality = 'mechanical' THEN 1 ELSE 0 END AS overlap, row_number() OVER (PARTITION BY session_id ORDER BY first_row, last_row DESC, depth DESC, id DESC) AS position FROM f),
 q AS (SELECT *, row_number() OVER (PARTITION BY session_id ORDER BY overlap DESC, position) AS place FROM o),
 b AS (SELECT session_id, summary_id AS id, child_id AS row_id FROM fx_provenance WHERE child_type = 'message' UNION ALL SELECT x.session_id, x.summary_id, y.child_id FROM fx_provenance x JOIN fx_provenance y ON x.child_type = 'summary' AND y.session_id = x.session_id AND y.summary_id = x.child_id)
 SELECT q.session_id, q.id, place, (SELECT count(*) FROM b WHERE b.session_id = q.session_id AND b.id = q.id) AS messages FROM q WHERE place <= 2""",
)
def history_costs(spark, d):
    m, s, p = _graph(spark, d)
    return V.history(D.frontier(s, m, p).withColumn("text", F.col("quality")), "what is mechanical?", 2, D.node_costs(s, m, p)).select("session_id", "id", "place", "messages")


@query(
    "e17_files_manifest",
    """WITH l AS (SELECT session_id, row_id, concat('f', row_id % 4) AS file_id FROM fx_messages WHERE row_id % 2 = 0), f AS (SELECT session_id, file_id, min(row_id) AS first FROM l GROUP BY 1, 2),
 c AS (SELECT session_id, count(*) AS files, count(*) FILTER (first >= 4) AS uncovered FROM f GROUP BY 1), i AS (SELECT session_id, count(*) AS large_inline FROM fx_messages WHERE length(text) >= 300 AND row_id % 2 = 1 GROUP BY 1)
 SELECT coalesce(c.session_id, i.session_id) AS session_id, coalesce(files, 0) AS files, coalesce(uncovered, 0) AS uncovered, coalesce(large_inline, 0) AS large_inline FROM c FULL JOIN i ON i.session_id = c.session_id""",
)
def manifest(spark, d):
    m = _messages(spark, d)
    return V.files_manifest(m, _links(spark, d), m.filter("row_id < 4"), 300)


@query("e17_large_inline", "SELECT session_id, row_id FROM fx_messages WHERE length(text) >= 300 AND row_id % 2 = 1")
def inline(spark, d):
    return V.large_inline(_messages(spark, d), _links(spark, d), 300)


@query("f15_pass_outcome", "SELECT session_id, 0 AS leaves, 'covered' AS outcome FROM fx_messages GROUP BY session_id HAVING max(row_id) < 8 UNION ALL SELECT session_id, 1, 'stored' FROM fx_messages GROUP BY session_id HAVING max(row_id) >= 8")
def outcome(spark, d):
    m, s, p = _graph(spark, d)
    left = D.uncovered(m, p, s)
    return V.pass_outcome(m, left, P.compact_mechanically(left))


@query(
    "f15_pass_counts",
    """SELECT session_id, CASE WHEN max(row_id) >= 8 THEN 1 ELSE 0 END AS leaves, (SELECT count(*) FROM fx_summaries s WHERE s.session_id = m.session_id AND s.kind = 'condensed') AS condensed, count(*) FILTER (row_id > 3) AS ingested,
  CASE WHEN max(row_id) >= 8 OR EXISTS (SELECT 1 FROM fx_summaries s WHERE s.session_id = m.session_id AND s.kind = 'condensed') THEN 'stored' ELSE 'covered' END AS outcome FROM fx_messages m GROUP BY session_id""",
)
def pass_counts(spark, d):
    m, s, p = _graph(spark, d)
    left = D.uncovered(m, p, s)
    return V.pass_outcome(m, left, P.compact_mechanically(left), s.filter("kind = 'condensed'"), m.filter("row_id > 3"))


@query("g07_boundary_covered", _FRONTIER + " , l AS (SELECT session_id, max(last_row) AS reached FROM f GROUP BY 1) SELECT m.session_id, coalesce(l.reached = m.top, false) AS covered FROM (SELECT session_id, max(row_id) AS top FROM fx_messages GROUP BY 1) m LEFT JOIN l USING (session_id)")
def boundary(spark, d):
    m, s, p = _graph(spark, d)
    spans = D.span_bounds(m, m)
    return V.boundary_covered(D.frontier(s, m, p), spans)


_REQUESTS = """q AS (SELECT session, pos, occupancy, CASE WHEN pos % 101 < 90 THEN 'm1' ELSE 'm2' END AS model, CASE WHEN pos % 13 = 0 THEN 'tail-mismatch' WHEN pos % 29 = 0 THEN 'tail-shrunk' END AS tail,
 CASE WHEN pos % 7 = 0 THEN 'summary-missing' WHEN pos % 11 = 0 THEN 'no-boundary' END AS blocked, row_number() OVER (PARTITION BY session ORDER BY pos) AS n FROM fx_metrics WHERE occupancy IS NOT NULL)"""


@query(
    "g08_replay",
    f"""WITH RECURSIVE {_REQUESTS},
 w AS (SELECT session, n, pos, model, false AS was, pos < 0 AS bailed, occupancy >= 0.7 AS tries, occupancy >= 0.7 AND blocked IS NULL AS pinned, tail, blocked FROM q WHERE n = 1
   UNION ALL SELECT q.session, q.n, q.pos, q.model, w.pinned AND w.model = q.model, w.pinned AND w.model = q.model AND q.tail IS NOT NULL,
     occupancy >= CASE WHEN w.pinned AND w.model = q.model THEN 0.85 ELSE 0.7 END,
     CASE WHEN w.pinned AND w.model = q.model THEN q.tail IS NULL ELSE occupancy >= 0.7 AND q.blocked IS NULL END, q.tail, q.blocked FROM w JOIN q ON q.session = w.session AND q.n = w.n + 1)
 SELECT session, pos, CASE WHEN bailed THEN 'bail' WHEN NOT tries THEN CASE WHEN was THEN 'reapply' ELSE 'quiet' END WHEN blocked = 'summary-missing' THEN 'kick' WHEN blocked IS NOT NULL THEN 'bail' ELSE 'swap' END AS outcome,
   CASE WHEN bailed THEN tail WHEN tries THEN blocked END AS reason FROM w""",
)
def replayed(spark, d):
    """Requests one after the other in SQL, by windows here."""
    log = view(spark, d, "fx_metrics").filter("occupancy is not null")
    p = F.col("pos")
    return V.replay(log.select("session", "pos", "occupancy", F.lit(0.7).alias("swap"), F.lit(0.85).alias("recut"), F.when(p % 101 < 90, "m1").otherwise("m2").alias("model"), F.lit(1000).alias("window"), F.when(p % 13 == 0, "tail-mismatch").when(p % 29 == 0, "tail-shrunk").alias("tail"), F.when(p % 7 == 0, "summary-missing").when(p % 11 == 0, "no-boundary").alias("blocked")))


@query("g11_compaction_span", "SELECT session_id, row_id AS pos FROM fx_messages WHERE row_id >= 2 AND row_id < 5 AND row_id <> 3 AND session_id IN (SELECT session_id FROM fx_messages WHERE row_id = 5)")
def spans(spark, d):
    m = _messages(spark, d).withColumn("pos", F.col("row_id")).withColumn("compaction", F.col("row_id") == 3)
    pick = lambda n, c: m.filter(F.col("row_id") == n).select("session_id", F.col("entry_id").alias(c))
    return V.compaction_spans(m, pick(2, "previous").join(pick(5, "kept"), "session_id"))


@query("h03_hash_problems", "SELECT left(sha256(text), 16) AS file_id FROM fx_files WHERE doc_id % 5 = 0 OR doc_id % 7 = 0 GROUP BY 1")
def hashes(spark, d):
    f = view(spark, d, "fx_files")
    text_hash = F.sha2("text", 256)
    rows = f.select(F.left(text_hash, F.lit(16)).alias("file_id"), (F.length("text") + F.when(F.col("doc_id") % 5 == 0, 1).otherwise(0)).alias("bytes"), F.when(F.col("doc_id") % 7 == 0, "0").otherwise(text_hash).alias("sha256"), "text")
    return V.hash_problems(rows).distinct()


@query("i06_dangling_links", "SELECT session_id, row_id, concat('f', row_id % 4) AS file_id FROM fx_messages WHERE row_id % 2 = 0 AND (row_id % 4 = 2 OR row_id = 4)")
def dangling(spark, d):
    m, links = _messages(spark, d), _links(spark, d)
    return V.dangling_links(links, m.filter("row_id <> 4"), links.filter("file_id <> 'f2'").select("file_id").distinct()).select("session_id", "row_id", "file_id")


@query("i07_coverage", "SELECT count(*) AS messages, count(*) FILTER (row_id >= 8) AS uncovered FROM fx_messages")
def coverage(spark, d):
    m, s, p = _graph(spark, d)
    return m.agg(F.count("*").alias("messages")).join(D.uncovered(m, p, s).agg(F.count("*").alias("uncovered")), F.lit(True))


def _cut_sql(size: int) -> str:
    """The end of the slice that starts at ``done``: a marker may begin from 95 % of the size on up to the limit."""
    low, limit = f"(done + {size * 95 // 100})", f"(done + {size})"

    def behind(sign: str, n: int) -> str:
        part = f"substring(text, CAST({low} + 1 AS BIGINT), {size - size * 95 // 100 + n})"
        return f"CASE WHEN contains({part}, {sign}) THEN least({limit}, {low} + length({part}) - strpos(reverse({part}), reverse({sign})) + 1) END"

    return f"CASE WHEN done + {size} >= length(text) THEN length(text) ELSE coalesce({behind('chr(10) || chr(10)', 2)}, {behind('chr(10)', 1)}, {behind(chr(39) + '. ' + chr(39), 2)}, {behind(chr(39) + ' ' + chr(39), 1)}, {limit}) END"


def _windows_sql(items: str, size: int, most: int | None = None) -> str:
    """Slices of ``items`` (node, item, text) packed into windows of ``size``, of nodes that ``most`` of these can hold where that is given: p (node, item, part, start, fin, pack)."""
    able = f", able AS (SELECT node FROM items GROUP BY 1 HAVING sum(length(text)) <= {most * size})" if most else ""
    return f"""WITH RECURSIVE items AS ({items}){able},
 w AS (SELECT node, item, text, CAST(-1 AS BIGINT) AS n, CAST(0 AS BIGINT) AS start, CAST(0 AS BIGINT) AS done FROM items WHERE text IS NOT NULL AND node {"IN (SELECT node FROM able)" if most else "IS NOT NULL"}
 UNION ALL SELECT node, item, text, n + 1, done, CAST({_cut_sql(size)} AS BIGINT) FROM w WHERE done < length(text)),
 s AS (SELECT node, item, n AS part, start, done AS fin, row_number() OVER (PARTITION BY node ORDER BY item, n) AS k FROM w WHERE n >= 0),
 p AS (SELECT *, CAST(0 AS BIGINT) AS pack, fin - start AS fill FROM s WHERE k = 1
 UNION ALL SELECT s.*, CASE WHEN p.fill + s.fin - s.start > {size} THEN p.pack + 1 ELSE p.pack END, CASE WHEN p.fill + s.fin - s.start > {size} THEN s.fin - s.start ELSE p.fill + s.fin - s.start END FROM p JOIN s ON s.node = p.node AND s.k = p.k + 1)"""


@query(
    "j06_heal_windows",
    _windows_sql("SELECT doc_id // 3 AS node, doc_id AS item, text FROM documents", 2000) + """ SELECT node, item, part, start, fin AS "end", pack AS "window" FROM p""",
)
def windows(spark, d):
    """Three documents a node, however many windows these need."""
    docs = spark.read.parquet(f"{d}/documents.parquet").select(F.floor(F.col("doc_id") / 3).alias("node"), F.col("doc_id").alias("item"), "text")
    return V.heal_windows(docs, 2000)


@query(
    "j05_source_facts",
    _windows_sql("SELECT concat(p.session_id, '#', p.summary_id) AS node, m.row_id AS item, m.text FROM fx_provenance p JOIN fx_messages m ON m.session_id = p.session_id AND m.row_id = p.child_id AND m.row_id <> 5 WHERE p.child_type = 'message'", 250, 8)
    + """, c AS (SELECT p.session_id, p.summary_id AS id, count(*) AS named, count(coalesce(m.row_id, s.id)) AS found, coalesce(sum(length(coalesce(m.text, concat('told ', s.id)))), 0) AS chars, bool_or(coalesce(s.quality, 'clean') <> 'clean') AS unclean
  FROM fx_provenance p LEFT JOIN fx_messages m ON p.child_type = 'message' AND m.session_id = p.session_id AND m.row_id = p.child_id AND m.row_id <> 5 LEFT JOIN fx_summaries s ON p.child_type = 'summary' AND s.session_id = p.session_id AND s.id = p.child_id GROUP BY 1, 2),
 x AS (SELECT node, max(pack) + 1 AS windows FROM p GROUP BY node HAVING max(pack) < 8),
 f AS (SELECT s.session_id, s.id, s.kind, CASE WHEN c.id IS NULL THEN 'no-source' WHEN found < named THEN 'source-missing' END AS problem, chars, unclean, CASE WHEN chars > 250 THEN x.windows END AS windows
  FROM fx_summaries s LEFT JOIN c ON c.session_id = s.session_id AND c.id = s.id LEFT JOIN x ON s.kind = 'leaf' AND x.node = concat(s.session_id, '#', s.id))
 SELECT session_id, id, problem, CASE WHEN problem IS NULL THEN CASE WHEN kind = 'leaf' THEN CASE WHEN chars <= 250 OR windows IS NOT NULL THEN 'clean' ELSE 'clipped' END WHEN unclean THEN 'derived' ELSE 'clean' END END AS source_quality,
  CASE WHEN problem IS NULL THEN CAST(chars AS BIGINT) END AS source_chars, CASE WHEN problem IS NULL THEN CAST(ceil(chars / 4.0) AS BIGINT) END AS source_tokens, CASE WHEN problem IS NULL THEN windows END AS windows FROM f""",
)
def source_facts(spark, d):
    """Sources of all nodes, each session's fifth message being lost, in windows of 250 characters."""
    m, s, p = _graph(spark, d)
    s = s.withColumn("text", F.concat(F.lit("told "), F.col("id").cast("string")))
    return V.heal_sources(s, m.filter("row_id <> 5"), p, 250, redactor=lambda t: t)


@query("k10_spend_by_caller", "SELECT session, CAST(sum(input) AS BIGINT) AS input, count(DISTINCT model) AS models, count(*) FILTER (stage = 'blocking') AS blocking FROM fx_metrics WHERE kind = 'summarizer-usage' GROUP BY session")
def callers(spark, d):
    rows = K.of_kind(view(spark, d, "fx_metrics"), "summarizer-usage")
    return rows.groupBy("session").agg(F.sum("input").alias("input"), F.count_distinct("model").alias("models"), F.count_if(F.col("stage") == "blocking").alias("blocking"))


@query("k11_window_overflow", "SELECT session, count(*) AS n, max(input) AS most, arg_max(cut_count, pos) AS last_window FROM fx_metrics WHERE kind = 'swap-applied' GROUP BY session")
def overflow(spark, d):
    rows = K.of_kind(view(spark, d, "fx_metrics"), "swap-applied")
    return rows.groupBy("session").agg(F.count("*").alias("n"), F.max("input").alias("most"), F.max_by("cut_count", "pos").alias("last_window"))


@query("k12_branch_navigation", "SELECT session_id, count(*) FILTER (row_id % 5 = 0 AND removed_at_ms IS NULL) AS removed, count(*) FILTER (row_id % 5 <> 0 AND removed_at_ms IS NOT NULL) AS restored FROM fx_tool_messages GROUP BY session_id")
def branches(spark, d):
    m = view(spark, d, "fx_tool_messages")
    changed = C.reconcile(m, m.filter("row_id % 5 <> 0"), 7)
    return changed.groupBy("session_id").agg(F.count_if(F.col("changed") & F.col("removed_at_ms").isNotNull()).alias("removed"), F.count_if(F.col("changed") & F.col("removed_at_ms").isNull()).alias("restored"))


@query("k16_freed_tokens", "SELECT strftime(make_timestamp(ts * 1000), '%Y-%m-%d') AS day, CAST(sum(greatest(0, input - cut_count)) AS BIGINT) AS freed FROM fx_metrics WHERE kind = 'swap-applied' AND ts <> 0 GROUP BY 1")
def freed(spark, d):
    rows = K.of_kind(view(spark, d, "fx_metrics"), "swap-applied").filter("ts <> 0")
    return rows.groupBy(K.utc_day(F.col("ts")).alias("day")).agg(F.sum(F.greatest(F.lit(0), F.col("input") - F.col("cut_count"))).alias("freed"))


@query("l01_plant", "SELECT session_id, row_id, CASE WHEN needle IS NULL THEN text ELSE concat(left(text, CAST(length(text) // 2 AS BIGINT)), ' ', needle, ' ', substring(text, CAST(length(text) // 2 + 1 AS BIGINT))) END AS text, needle FROM (" + L.NEEDLES_SQL + ") q")
def planted(spark, d):
    return L.plant(view(spark, d, "fx_tool_messages"), 6).select("session_id", "row_id", "text", "needle")


@query("l02_l05_fidelity", "SELECT session_id, least(6, count(*)) AS needles, least(6, count(*)) AS stored, least(6, count(*)) AS covered FROM fx_tool_messages GROUP BY session_id")
def fidelity(spark, d):
    return L.fidelity(L.plant(view(spark, d, "fx_tool_messages"), 6)).drop("shown")
