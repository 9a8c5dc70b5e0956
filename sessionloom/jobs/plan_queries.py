"""Queries of compaction, context budgets, healing, retention and streaming."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from sessionloom.functions import scalars as S
from sessionloom.jobs.dag_queries import _FRONTIER, _graph
from sessionloom.jobs.scalar_queries import _redact_sql
from sessionloom.operators import compact as P
from sessionloom.operators import dag as D
from sessionloom.operators import heal as J
from sessionloom.operators import policy as G
from sessionloom.operators import retention as M
from sessionloom.registry import query
from sessionloom.sources.fixtures import view
from sessionloom.streaming import ingest as N

_CHUNKS = """WITH RECURSIVE w AS (SELECT session_id, row_id, tokens, row_id AS start, tokens AS total FROM {m} m WHERE NOT EXISTS (SELECT 1 FROM {m} x WHERE x.session_id = m.session_id AND x.row_id = m.row_id - 1)
 UNION ALL SELECT m.session_id, m.row_id, m.tokens, CASE WHEN w.total + m.tokens > {b} THEN m.row_id ELSE w.start END, CASE WHEN w.total + m.tokens > {b} THEN m.tokens ELSE w.total + m.tokens END
   FROM w JOIN {m} m ON m.session_id = w.session_id AND m.row_id = w.row_id + 1),
 c AS (SELECT session_id, row_id, dense_rank() OVER (PARTITION BY session_id ORDER BY start) - 1 AS chunk FROM w)"""


@query("f01_chunks", _CHUNKS.format(m="fx_tool_messages", b=60) + " SELECT session_id, row_id, chunk FROM c")
def chunks(spark, d):
    return P.chunk_contiguous(view(spark, d, "fx_tool_messages"), 60)


@query(
    "f02_merge_chunks",
    _CHUNKS.format(m="fx_tool_messages", b=60) + ", n AS (SELECT *, max(chunk) OVER (PARTITION BY session_id) + 1 AS n FROM c) SELECT session_id, row_id, CAST(floor(chunk / CASE WHEN n > 4 THEN ceil(n / 4.0) ELSE 1 END) AS BIGINT) AS chunk FROM n",
)
def merged(spark, d):
    return P.merge_chunks(P.chunk_contiguous(view(spark, d, "fx_tool_messages"), 60), 4)


_MECH = """k AS (SELECT *, role <> 'user' AND (text LIKE '[tool:click]%' OR text LIKE 'tool click %') AS direct, text NOT LIKE 'value %' AND role <> 'user' AS named FROM fx_tool_messages),
 g AS (SELECT *, direct OR role = 'toolResult' AND NOT named AND coalesce(lag(direct) OVER (PARTITION BY session_id ORDER BY row_id), false) AS mechanical FROM k)"""


@query("f03_mechanical", f"WITH {_MECH} SELECT session_id, row_id, direct, mechanical FROM g")
def mechanical(spark, d):
    return P.mechanical(view(spark, d, "fx_tool_messages"), ["click"]).select("session_id", "row_id", "direct", "mechanical")


@query(
    "f04_split_by_flag",
    _CHUNKS.format(m="fx_tool_messages", b=60)
    + f", {_MECH}, j AS (SELECT g.session_id, g.row_id, g.mechanical, c.chunk FROM g JOIN c ON c.session_id = g.session_id AND c.row_id = g.row_id),"
    + """ x AS (SELECT *, coalesce(lag(mechanical) OVER o <> mechanical OR lag(chunk) OVER o <> chunk, false) AS new FROM j WINDOW o AS (PARTITION BY session_id ORDER BY row_id))
 SELECT session_id, row_id, CAST(sum(CAST(new AS INT)) OVER (PARTITION BY session_id ORDER BY row_id) AS BIGINT) AS chunk FROM x""",
)
def split(spark, d):
    m = P.mechanical(view(spark, d, "fx_tool_messages"), ["click"])
    joined = m.join(P.chunk_contiguous(m, 60), ["session_id", "row_id"])
    return P.split_by_flag(joined).select("session_id", "row_id", "chunk")


_LEAVES = _CHUNKS.format(m="fx_messages", b=1000) + f""", j AS (SELECT m.session_id, m.row_id, m.role, m.tokens, {_redact_sql("m.text")} AS text, c.chunk FROM fx_messages m JOIN c ON c.session_id = m.session_id AND c.row_id = m.row_id),""" + """
 s AS (SELECT session_id, chunk, min(row_id) AS first_row, max(row_id) AS last_row, CAST(sum(tokens) AS BIGINT) AS source_tokens,
   string_agg(concat('[', role, ']', chr(10), CASE WHEN length(text) > 4000 THEN concat(left(text, 4000), '[lcm:more ', length(text) - 4000, ' chars]') ELSE text END), concat(chr(10), chr(10)) ORDER BY row_id) AS source FROM j GROUP BY 1, 2),
 l AS (SELECT *, concat('[lcm:truncated]', chr(10), CASE WHEN length(source) <= 800 THEN source ELSE concat(left(source, 560), chr(10), chr(10), '[…truncated…]', chr(10), chr(10), right(source, 160)) END) AS text FROM s)"""


@query("f05_f06_mechanical_leaves", _LEAVES + " SELECT session_id, chunk, first_row, last_row, source_tokens, text, CAST(ceil(length(text) / 4.0) AS BIGINT) AS tokens FROM l")
def leaves(spark, d):
    return P.compact_mechanically(view(spark, d, "fx_messages"), 1000, 200).select("session_id", "chunk", "first_row", "last_row", "source_tokens", "text", "tokens")


@query(
    "f07_escalation",
    """WITH r AS (SELECT session_id, row_id, ceil(length(text) / 4.0) AS ts, ceil(ceil(length(text) * 0.5) / 4.0) AS t1, CASE WHEN row_id % 2 = 0 THEN ceil(ceil(length(text) * 0.25) / 4.0) END AS t2 FROM fx_messages),
       k AS (SELECT *, t1 < ts AND t1 > 40 AND coalesce(t2 < t1, false) AS tighter FROM r)
       SELECT session_id, row_id, CASE WHEN t1 < ts AND NOT tighter THEN 1 WHEN tighter OR coalesce(t2 < ts, false) THEN 2 ELSE 3 END AS level FROM k""",
)
def escalation(spark, d):
    part = lambda share: F.left("text", F.ceil(F.length("text") * share).cast("int"))
    rows = view(spark, d, "fx_messages").select("session_id", "row_id", F.col("text").alias("source"), part(0.5).alias("l1"), F.when(F.col("row_id") % 2 == 0, part(0.25)).alias("l2"))
    return P.escalate(rows, 20).select("session_id", "row_id", "level")


@query("f08_quality", "SELECT session_id, id, CASE WHEN id % 3 = 0 THEN 'mechanical' WHEN quality = 'clipped' THEN 'clipped' ELSE 'clean' END AS leaf, CASE WHEN id % 3 = 0 THEN 'mechanical' WHEN quality <> 'clean' THEN 'derived' ELSE 'clean' END AS condensed FROM fx_summaries")
def quality(spark, d):
    level = F.when(F.col("id") % 3 == 0, 3).otherwise(1)
    return view(spark, d, "fx_summaries").select("session_id", "id", P.leaf_quality(level, F.col("quality") == "clipped").alias("leaf"), P.condensed_quality(level, F.col("quality") != "clean").alias("condensed"))


_FLAT = "WITH f AS (SELECT session_id, row_id AS position, (row_id - 1) // 3 % 2 AS depth, tokens FROM fx_tool_messages)"


def _flat(spark, d):
    return view(spark, d, "fx_tool_messages").select("session_id", F.col("row_id").alias("position"), (F.floor((F.col("row_id") - 1) / 3) % 2).alias("depth"), "tokens")


@query(
    "f09_condensation_group",
    _FLAT
    + """, r AS (SELECT *, position - row_number() OVER (PARTITION BY session_id, depth ORDER BY position) AS run FROM f), n AS (SELECT *, count(*) OVER (PARTITION BY session_id, depth, run) AS length, row_number() OVER (PARTITION BY session_id, depth, run ORDER BY position) AS k FROM r),
 b AS (SELECT session_id, arg_min(position, depth * 1000000 + position) AS first, min(depth) AS depth FROM n WHERE length >= 2 AND k = 1 GROUP BY session_id)
 SELECT n.session_id, n.position FROM n JOIN b ON b.session_id = n.session_id AND b.depth = n.depth AND n.position - n.k + 1 = b.first WHERE n.k <= 2""",
)
def group(spark, d):
    return P.condensation_group(_flat(spark, d), fan_out=2).select("session_id", "position")


def _condense_sql(target: int, node_tokens: int, fan_out: int = 8, levels: int = 8) -> str:
    """Frontiers l0, l1, ... after each depth; what is merged at depth k is m<k>."""
    steps = [_FLAT.replace("WITH f", "f", 1) + """, l0 AS (SELECT f.session_id, position AS id, position, depth, tokens, CAST(position AS VARCHAR(20)) AS a, CAST(position AS VARCHAR(20)) AS b FROM f)"""]
    for k in range(levels):
        steps.append(
            f"""r{k} AS (SELECT *, sum(tokens) OVER (PARTITION BY session_id) AS total, row_number() OVER (PARTITION BY session_id ORDER BY position) - row_number() OVER (PARTITION BY session_id, depth ORDER BY position) AS run FROM l{k}),
 k{k} AS (SELECT *, (row_number() OVER (PARTITION BY session_id, run ORDER BY position) - 1) // {fan_out} AS part FROM r{k} WHERE depth = {k} AND total > {target}),
 g{k} AS (SELECT session_id, run, part, any_value(total) AS total, min(position) AS position, sum(tokens) AS source, least({node_tokens}, sum(tokens)) AS tokens, list(id ORDER BY position) AS kids, arg_min(a, position) AS a, arg_max(b, position) AS b FROM k{k} GROUP BY 1, 2, 3 HAVING count(*) > 1),
 t{k} AS (SELECT *, total - coalesce(sum(source - tokens) OVER (PARTITION BY session_id ORDER BY position ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS have FROM g{k}),
 m{k} AS (SELECT t.session_id, n.top + row_number() OVER (PARTITION BY t.session_id ORDER BY position) AS id, position, {k + 1} AS depth, tokens, a, b, kids FROM t{k} t JOIN (SELECT session_id, max(id) AS top FROM ({' UNION ALL '.join(['SELECT session_id, id FROM l0', *(f'SELECT session_id, id FROM m{j}' for j in range(k))])}) q GROUP BY 1) n ON n.session_id = t.session_id WHERE have > {target}),
 l{k + 1} AS (SELECT l.* FROM l{k} l WHERE NOT EXISTS (SELECT 1 FROM m{k} m WHERE m.session_id = l.session_id AND list_contains(m.kids, l.id)) UNION ALL SELECT session_id, id, position, depth, tokens, a, b FROM m{k})"""
        )
    return "WITH " + ", ".join(steps) + ", made AS (" + " UNION ALL ".join(f"SELECT * FROM m{k}" for k in range(levels)) + ")"


@query("f10_condense", _condense_sql(100, 8) + " SELECT session_id, count(*) AS nodes, CAST(max(depth) AS BIGINT) AS deepest, CAST(sum(tokens) AS BIGINT) AS tokens FROM l8 GROUP BY session_id")
def condense(spark, d):
    return P.condense_counts(_flat(spark, d), 100, node_tokens=8)


def _condensed(spark, d):
    rows = _flat(spark, d)
    return P.condense(rows.withColumns({"id": F.col("position"), "quality": F.lit("clean"), "first_entry_id": F.col("position").cast("string"), "last_entry_id": F.col("position").cast("string")}), 100, node_tokens=8)


@query("f10_condensed_nodes", _condense_sql(100, 8) + " SELECT session_id, CAST(id AS BIGINT) AS id, CAST(depth AS BIGINT) AS depth, CAST(tokens AS BIGINT) AS tokens, 'mechanical' AS quality, a AS first_entry_id, b AS last_entry_id FROM made")
def condensed_nodes(spark, d):
    return _condensed(spark, d).nodes


@query("f10_condensed_edges", _condense_sql(100, 8) + " SELECT session_id, CAST(id AS BIGINT) AS summary_id, CAST(unnest(kids) AS BIGINT) AS child_id FROM made")
def condensed_edges(spark, d):
    return _condensed(spark, d).edges


@query(
    "f12_stalls",
    _FLAT + " SELECT session_id, CAST(sum(tokens) AS BIGINT) AS tokens, min(depth) AS min_depth, count(*) AS nodes, 'no-same-depth-run' AS reason FROM f GROUP BY session_id HAVING sum(tokens) > 300",
)
def stalls(spark, d):
    return P.stall_report(_flat(spark, d), 300)


@query(
    "f13_render_frontier",
    _FRONTIER
    + """, texts AS (SELECT session_id, string_agg(concat('[lcm:summary #', id, ' depth ', depth, ' span ', first_entry_id, '..', last_entry_id, ']', chr(10), quality), concat(chr(10), chr(10)) ORDER BY first_row, last_row DESC, depth DESC, id DESC) AS rendered FROM f GROUP BY session_id)
 SELECT session_id, rendered, CAST(ceil(length(rendered) / 4.0) AS BIGINT) AS tokens FROM texts""",
)
def rendered(spark, d):
    m, s, p = _graph(spark, d)
    return P.render(D.frontier(s, m, p).withColumn("text", F.col("quality")))


_REQ = """q AS (SELECT event_id, user_id, (event_id % 5) * 50000 AS w, CASE WHEN event_id % 3 = 0 THEN event_id * 10 END AS st, CASE WHEN event_id % 4 = 0 THEN event_id * 11 END AS rt, CASE WHEN event_id % 7 = 0 THEN 60000 END AS z, CASE WHEN event_id % 2 = 0 THEN 0.6 END AS sr FROM events)"""


def _requests(spark, d):
    e = spark.read.parquet(f"{d}/events.parquet")
    i = F.col("event_id")
    return e.select("event_id", ((i % 5) * 50000).alias("window"), F.when(i % 3 == 0, i * 10).alias("swap_tokens"), F.when(i % 4 == 0, i * 11).alias("recut_tokens"), F.when(i % 7 == 0, 60000).alias("smart_zone"), F.when(i % 2 == 0, F.lit(0.6)).alias("swap_ratio"), F.lit(None).cast("double").alias("recut_ratio"), "value")


_THRESHOLDS = f"""WITH {_REQ}, r AS (SELECT *, coalesce(nullif(st, 0) / w, z / w, sr, 0.7) AS swap0, coalesce(nullif(rt, 0) / w, z * 1.18 / w, 0.85) AS recut0 FROM q),
 c AS (SELECT *, least(swap0, 0.9) AS low FROM r), t AS (SELECT *, least(greatest(recut0, low + 0.01), 0.95) AS high FROM c),
 o AS (SELECT event_id, round(CASE WHEN w > 0 THEN low ELSE coalesce(sr, 0.7) END, 9) AS swap, round(CASE WHEN w > 0 THEN high ELSE 0.85 END, 9) AS recut, w > 0 AND (low <> swap0 OR high <> recut0) AS clamped FROM t)"""


@query("g01_thresholds", _THRESHOLDS + " SELECT * FROM o")
def thresholds(spark, d):
    return G.thresholds(_requests(spark, d)).select("event_id", F.round("swap", 9).alias("swap"), F.round("recut", 9).alias("recut"), "clamped")


@query(
    "g02_g03_decisions",
    _THRESHOLDS
    + """ SELECT event_id, CASE WHEN event_id % 2 = 0 THEN CASE WHEN occ >= recut THEN 'recommit' ELSE 'stable' END ELSE CASE WHEN occ >= swap THEN 'consider-apply' ELSE 'quiet' END END AS action
 FROM o JOIN (SELECT event_id, CASE WHEN value < 0.25 * 100 THEN 100 ELSE value END / 120 AS occ FROM events) v USING (event_id)""",
)
def decisions(spark, d):
    t = G.thresholds(_requests(spark, d)).withColumn("swap", F.round("swap", 9)).withColumn("recut", F.round("recut", 9))
    occ = G.occupancy(F.col("value"), F.lit(100), F.lit(120))
    return t.select("event_id", G.next_action(occ, F.col("swap"), F.col("recut"), F.col("event_id") % 2 == 0).alias("action"))


@query(
    "g02_g03_windows_and_cuts",
    """SELECT event_id, round(value / CASE WHEN event_id % 3 = 0 AND event_id % 5 = 0 THEN 70 WHEN event_id % 5 = 0 THEN 70 WHEN event_id % 3 = 0 THEN 90 ELSE 120 END, 6) AS occ,
 event_id % 4 = 0 OR event_id % 10 >= event_id % 7 AS may_replace FROM events""",
)
def windows_and_cuts(spark, d):
    e = spark.read.parquet(f"{d}/events.parquet")
    n = F.col("event_id")
    window = G.effective_window(F.lit(120), F.when(n % 3 == 0, 90), F.when(n % 5 == 0, 70))
    return e.select("event_id", F.round(G.occupancy(F.col("value"), F.lit(0), window), 6).alias("occ"), G.cut_may_replace(F.when(n % 4 != 0, n % 7), n % 10).alias("may_replace"))


@query("g05_tail_keys", "SELECT session_id, row_id, CASE WHEN role IS NULL THEN '' ELSE CAST(to_json([role, left(text, 200)]) AS VARCHAR) END AS tail FROM fx_messages")
def tail_keys(spark, d):
    return view(spark, d, "fx_messages").select("session_id", "row_id", G.tail_key(F.col("role"), F.col("text")).alias("tail"))


def _cuts_sql(table: str, keep: int) -> str:
    """Cuts of rows numbered from 0: the point from the tail on, then what is looked for before and behind it."""
    return f"""n AS (SELECT session_id, row_id, role, row_number() OVER (PARTITION BY session_id ORDER BY row_id) - 1 AS k, sum(coalesce(tokens, 0)) OVER (PARTITION BY session_id ORDER BY row_id DESC) AS tail FROM {table}),
 i AS (SELECT session_id, coalesce(max(k) FILTER (k > 0 AND tail >= {keep}), 0) AS i FROM n GROUP BY session_id),
 u AS (SELECT i.session_id, i, (SELECT max(k) FROM n WHERE n.session_id = i.session_id AND k <= i AND role = 'user') AS user_k FROM i),
 cuts AS (SELECT session_id, CASE WHEN user_k > 0 OR user_k = 0 AND i = 0 THEN user_k WHEN user_k = 0 THEN (SELECT max(k) FROM n WHERE n.session_id = u.session_id AND k BETWEEN 1 AND i AND role <> 'toolResult')
   ELSE (SELECT min(k) FROM n WHERE n.session_id = u.session_id AND k > i AND role = 'user') END AS k FROM u),
 c AS (SELECT cuts.session_id, n.row_id AS cut FROM cuts LEFT JOIN n ON n.session_id = cuts.session_id AND n.k = cuts.k)"""


@query("g04_cut_index", f"WITH {_cuts_sql('fx_messages', 200)} SELECT session_id, cut FROM c")
def cuts(spark, d):
    return G.cut_index(view(spark, d, "fx_messages"), 200)


@query("g04_cut_index_tools", f"WITH {_cuts_sql('fx_cut_messages', 60)} SELECT session_id, cut FROM c")
def tool_cuts(spark, d):
    """Sessions with tool results, some of one user row at the start, in the middle or nowhere, and rows of unknown size."""
    return G.cut_index(view(spark, d, "fx_cut_messages"), 60)


@query(
    "g06_degrade",
    f"""WITH r AS (SELECT session_id, row_id AS id, row_id % 2 AS depth, entry_id, {_redact_sql('text')} AS text, CASE WHEN row_id % 3 = 0 THEN {_redact_sql("concat(text, ' ', text)")} END AS thorough FROM fx_messages),
 h AS (SELECT *, concat('[lcm:summary #', id, ' depth ', depth, ' span ', entry_id, '..', entry_id, ']', chr(10)) AS head,
   concat(left(trim(regexp_replace(text, '\\s+', ' ', 'g')), 200), ' [lcm:stub, ', length(text), ' chars elided; lcm_describe(', id, ') has the full summary]') AS stub FROM r),
 g AS (SELECT session_id, id, unnest([{{'step': 0, 'body': coalesce(thorough, text)}}, {{'step': 1, 'body': text}}, {{'step': 2, 'body': stub}}]) AS t, head, thorough FROM h),
 b AS (SELECT session_id, id, t.step AS step, concat(head, t.body) AS body FROM g WHERE t.step <> 1 OR thorough IS NOT NULL),
 l AS (SELECT *, length(body) - lag(length(body)) OVER (PARTITION BY session_id, id ORDER BY step) AS more FROM b),
 w AS (SELECT session_id, sum(length(body)) + 2 * (count(*) - 1) AS whole FROM b WHERE step = 0 GROUP BY 1),
 a AS (SELECT l.session_id, id, step, whole + sum(more) OVER (PARTITION BY l.session_id ORDER BY id, step) AS after FROM l JOIN w ON w.session_id = l.session_id WHERE step > 0),
 f AS (SELECT w.session_id, CASE WHEN ceil(whole / 4.0) <= 500 THEN [0, 0] ELSE (SELECT min([a.id, a.step]) FROM a WHERE a.session_id = w.session_id AND ceil(after / 4.0) <= 500) END AS stop FROM w),
 e AS (SELECT b.session_id, b.id, max(b.step) AS step, arg_max(body, b.step) AS rendered FROM b JOIN f USING (session_id) WHERE step = 0 OR stop IS NULL OR [b.id, b.step] <= stop GROUP BY 1, 2)
 SELECT session_id, id, CASE step WHEN 0 THEN 'rich' WHEN 1 THEN 'terse' ELSE 'stub' END AS tier, rendered FROM e""",
)
def degrade(spark, d):
    """Messages stand for nodes; every third has a thorough text."""
    m = view(spark, d, "fx_messages")
    nodes = m.select("session_id", F.col("row_id").alias("id"), (F.col("row_id") % 2).alias("depth"), F.col("entry_id").alias("first_entry_id"), F.col("entry_id").alias("last_entry_id"), F.col("row_id").alias("position"), "text", F.when(F.col("row_id") % 3 == 0, F.concat("text", F.lit(" "), "text")).alias("thorough"))
    return G.degrade(nodes, 500).select("session_id", "id", "tier", "rendered")


@query(
    "g09_calibrate",
    """WITH s AS (SELECT session, pos, input * 40 + pos AS chars, input * 10 + pos // 4 AS tokens FROM fx_metrics), e AS (SELECT session, pos, chars - lag(chars) OVER o AS c, tokens - lag(tokens) OVER o AS t FROM s WINDOW o AS (PARTITION BY session ORDER BY pos)),
       r AS (SELECT session, pos, c / t AS r FROM e WHERE c > 0 AND t > 0), l AS (SELECT session, pos, list_sort(list(r) OVER (PARTITION BY session ORDER BY pos ROWS BETWEEN 7 PRECEDING AND CURRENT ROW)) AS x FROM r),
       m AS (SELECT *, x[len(x) // 2 + 1] AS median FROM l)
       SELECT session, pos, CASE WHEN len(x) >= 3 AND len(list_filter(x, lambda v: abs(v - median) / median > 0.25)) = 0 AND median BETWEEN 2 AND 8 THEN round(median, 2) END AS ratio FROM m""",
)
def calibrate(spark, d):
    i, pos = F.col("input"), F.col("pos")
    samples = view(spark, d, "fx_metrics").select("session", "pos", (i * 40 + pos).alias("chars"), (i * 10 + F.floor(pos / 4)).alias("tokens"))
    return G.calibrate(samples)


@query("g10_model_state", "SELECT model, arg_max(input, ts) AS ratio, arg_max(cut, ts) FILTER (cut IS NOT NULL) AS window FROM (SELECT *, CASE WHEN pos % 3 = 0 THEN pos END AS cut FROM fx_metrics WHERE model IS NOT NULL) q GROUP BY model".replace("AS window", 'AS "window"'))
def state(spark, d):
    rows = view(spark, d, "fx_metrics").filter("model is not null")
    return G.model_state(rows.select("model", "ts", F.col("input").alias("ratio"), F.when(F.col("pos") % 3 == 0, F.col("pos")).alias("window")))


@query("n05_retry_due", "SELECT session, kind AS boundary, count(*) AS attempts, max(ts) AS last_ts, count(*) < 3 OR 300000000 - max(ts) >= 600000 AS due FROM fx_metrics WHERE kind IS NOT NULL GROUP BY 1, 2")
def retries(spark, d):
    rows = view(spark, d, "fx_metrics").filter("kind is not null").withColumn("boundary", F.col("kind"))
    return G.retry_due(rows, 300_000_000)


@query("j01_tainted", "SELECT session_id, id FROM fx_summaries WHERE quality <> 'clean'")
def tainted(spark, d):
    return J.tainted(view(spark, d, "fx_summaries")).select("session_id", "id")


_HURT = "WITH h AS (SELECT DISTINCT p.session_id, p.summary_id AS id FROM fx_provenance p JOIN fx_summaries c ON c.session_id = p.session_id AND c.id = p.child_id WHERE p.child_type = 'summary' AND c.quality <> 'clean')"


@query("j02_backfill_quality", _HURT + " SELECT s.session_id, s.id, CASE WHEN s.quality = 'clean' AND EXISTS (SELECT 1 FROM h WHERE h.session_id = s.session_id AND h.id = s.id) THEN 'derived' ELSE s.quality END AS quality FROM fx_summaries s")
def backfill(spark, d):
    _, s, p = _graph(spark, d)
    return J.backfill_quality(s, p).select("session_id", "id", "quality")


@query(
    "j03_heal_plan",
    _HURT
    + """, c AS (SELECT * FROM fx_summaries s WHERE quality <> 'clean' OR EXISTS (SELECT 1 FROM h WHERE h.session_id = s.session_id AND h.id = s.id))
 SELECT session_id, id, row_number() OVER (PARTITION BY session_id ORDER BY depth, CASE quality WHEN 'mechanical' THEN 0 WHEN 'derived' THEN 1 WHEN 'clean' THEN 2 ELSE 3 END, id) AS step, quality <> 'clean' AS tainted FROM c""",
)
def plan(spark, d):
    _, s, p = _graph(spark, d)
    return J.heal_plan(s, p).select("session_id", "id", "step", "tainted")


@query("j04_source_budget", "SELECT event_id, least(least(24000, greatest(3000, 8 * event_id)), 60000 - event_id - 1024) AS budget FROM events")
def budgets(spark, d):
    return spark.read.parquet(f"{d}/events.parquet").select("event_id", J.source_budget(F.col("event_id")).alias("budget"))


@query(
    "j07_fair_shares",
    """WITH m AS (SELECT session_id, row_id, length(text) AS chars FROM fx_messages), l AS (SELECT session_id, max(l) AS l FROM (SELECT m.session_id, r.l, sum(least(m.chars, r.l)) AS used FROM m, range(0, 2001) r(l) GROUP BY 1, 2) q WHERE used <= 2000 GROUP BY 1)
       SELECT session_id, 1 AS node, row_id AS item, CAST(least(chars, l) AS BIGINT) AS share FROM m JOIN l USING (session_id)""",
)
def shares(spark, d):
    rows = view(spark, d, "fx_messages").select("session_id", F.lit(1).alias("node"), F.col("row_id").alias("item"), F.length("text").cast("long").alias("chars"))
    return J.share_chars(rows, 2000)


def _heal_sql(levels: int = 6, target: int = 200, most: int = 12) -> str:
    """Outcomes level by level; the views' graphs have six levels."""
    judged = f"""CASE WHEN a.source_quality IS NULL OR a.new_level = 3 OR a.new_tokens = 0 OR a.new_tokens > {2 * target} THEN 'failed' WHEN a.expected_tokens <> s.tokens THEN 'changed' WHEN a.source_quality = 'clean' THEN 'repaired' ELSE 'improved' END"""
    why = f"""CASE WHEN a.source_quality IS NULL THEN 'source-missing' WHEN a.new_level = 3 THEN 'level-3' WHEN a.new_tokens = 0 THEN 'empty' WHEN a.new_tokens > {2 * target} THEN 'oversized' WHEN a.expected_tokens <> s.tokens THEN 'concurrent-change' END"""
    steps = []
    for d in range(levels):
        lower = " UNION ALL ".join(f"SELECT session_id, id, outcome, reason FROM o{k}" for k in range(d)) or "SELECT session_id, id, '' AS outcome, '' AS reason FROM v WHERE false"
        steps.append(f"""b{d} AS (SELECT e.session_id, e.parent AS id, bool_or(outcome IN ('failed', 'changed') OR outcome = 'blocked' AND reason = 'dependency-failed') AS stuck, bool_or(outcome IN ('repaired', 'improved')) AS renewed
 FROM e JOIN ({lower}) x ON x.session_id = e.session_id AND x.id = e.id WHERE e.depth = {d} GROUP BY 1, 2),
 o{d} AS (SELECT *, CASE WHEN stuck THEN 'blocked' WHEN idle THEN 'skipped' WHEN unclean THEN 'blocked' ELSE verdict END AS outcome,
   CASE WHEN stuck THEN 'dependency-failed' WHEN idle THEN 'clean' WHEN unclean THEN 'source-over-budget' ELSE own_reason END AS reason
  FROM (SELECT v.*, coalesce(stuck, false) AS stuck, NOT tainted AND NOT coalesce(renewed, false) AS idle, coalesce(source_quality, 'clean') <> 'clean' AND quality <> 'mechanical' AND NOT coalesce(renewed, false) AS unclean
   FROM v LEFT JOIN b{d} b ON b.session_id = v.session_id AND b.id = v.id WHERE v.depth = {d}) q)""")
    every = " UNION ALL ".join(f"SELECT * FROM o{d}" for d in range(levels))
    return f"""WITH RECURSIVE up AS (SELECT session_id, id FROM deep_summaries WHERE quality <> 'clean'
  UNION SELECT p.session_id, p.summary_id FROM up JOIN deep_provenance p ON p.session_id = up.session_id AND p.child_type = 'summary' AND p.child_id = up.id),
 v AS (SELECT s.session_id, s.id, s.depth, s.quality, s.quality <> 'clean' AS tainted, a.source_quality, {judged} AS verdict, {why} AS own_reason,
   row_number() OVER (PARTITION BY s.session_id ORDER BY s.depth, CASE s.quality WHEN 'mechanical' THEN 0 WHEN 'derived' THEN 1 WHEN 'clean' THEN 2 ELSE 3 END, s.id) AS step
  FROM deep_summaries s JOIN up ON up.session_id = s.session_id AND up.id = s.id LEFT JOIN heal_attempts a ON a.session_id = s.session_id AND a.id = s.id),
 e AS (SELECT DISTINCT p.session_id, p.child_id AS id, p.summary_id AS parent, n.depth FROM deep_provenance p JOIN v c ON c.session_id = p.session_id AND c.id = p.child_id JOIN v n ON n.session_id = p.session_id AND n.id = p.summary_id
  WHERE p.child_type = 'summary' AND c.depth < n.depth),
 {", ".join(steps)},
 w AS (SELECT *, outcome <> 'skipped' AND coalesce(reason, '') <> 'dependency-failed' AS wanted, outcome IN ('repaired', 'improved', 'changed') OR outcome = 'failed' AND reason <> 'source-missing' AS tried FROM ({every}) q),
 n AS (SELECT *, coalesce(count(*) FILTER (tried) OVER (PARTITION BY session_id ORDER BY step ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM w),
 z AS (SELECT session_id, min(step) AS stop FROM n WHERE wanted AND before >= {most} GROUP BY 1),
 y AS (SELECT n.*, stop, coalesce(step >= stop, false) AS late FROM n LEFT JOIN z USING (session_id)),
 m AS (SELECT DISTINCT e.session_id, e.parent AS id FROM e JOIN y ON y.session_id = e.session_id AND y.id = e.id WHERE NOT late AND outcome IN ('repaired', 'improved', 'changed')),
 healed AS (SELECT y.session_id, y.id, y.step, y.tainted, CASE WHEN late THEN 'notAttempted' ELSE outcome END AS outcome, CASE WHEN NOT late THEN reason END AS reason,
   CASE WHEN NOT late AND outcome = 'repaired' THEN 'clean' WHEN NOT late AND outcome = 'improved' THEN source_quality WHEN quality = 'clean' AND (m.id IS NOT NULL OR wanted AND (NOT late OR step = stop)) THEN 'derived' ELSE quality END AS quality_after
  FROM y LEFT JOIN m ON m.session_id = y.session_id AND m.id = y.id)"""


@query("j08_heal_outcomes", _heal_sql() + " SELECT * FROM healed")
def outcomes(spark, d):
    """Graphs of six levels with a cycle in some; at most twelve attempts a session."""
    s, p, tries = (view(spark, d, n) for n in ("deep_summaries", "deep_provenance", "heal_attempts"))
    return J.heal_outcomes(s, p, tries, 200, 12).drop("quality")


_COUNTED = ", ".join(f"count(*) FILTER (outcome = '{o}') AS {o}" for o in ("repaired", "improved", "failed", "blocked", "skipped", "changed", "notAttempted"))


@query(
    "j08_j09_heal_counts",
    _heal_sql(most=1_000_000)
    + f""" SELECT session_id, count(*) AS candidates, count(*) FILTER (tainted) AS tainted, count(*) FILTER (outcome IN ('repaired', 'improved', 'changed') OR outcome = 'failed' AND reason <> 'source-missing') AS attempted,
 count(*) FILTER (reason = 'source-over-budget') AS blockedSource, {_COUNTED} FROM healed GROUP BY session_id""",
)
def verdicts(spark, d):
    s, p, tries = (view(spark, d, n) for n in ("deep_summaries", "deep_provenance", "heal_attempts"))
    return J.heal_counts(J.heal_outcomes(s, p, tries, 200))


@query(
    "m01_by_lifecycle",
    """SELECT CASE WHEN doc_id % 5 = 0 THEN concat('scratch-', doc_id) ELSE left(sha256(path), 16) END AS name, CASE WHEN doc_id % 5 = 0 THEN 'scratch-expired' ELSE 'session-gone' END AS reason FROM fx_files
       WHERE doc_id % 7 <> 0 AND CASE WHEN doc_id % 5 = 0 THEN (500 - doc_id) > 30 ELSE doc_id % 2 = 1 END""",
)
def lifecycle(spark, d):
    f = view(spark, d, "fx_files")
    name = F.when(F.col("doc_id") % 5 == 0, F.concat(F.lit("scratch-"), F.col("doc_id").cast("string"))).otherwise(S.session_hash(F.col("path")))
    stores = f.select(name.alias("name"), (F.col("doc_id") * M.DAY_MS).alias("mtime_ms"), (F.col("doc_id") % 7 == 0).alias("live"))
    return M.by_lifecycle(stores, f.filter("doc_id % 2 = 0"), 500 * M.DAY_MS)


@query(
    "m02_by_age",
    """WITH f AS (SELECT concat('u', user_id) AS stem, user_id, event_id * 60000 AS mtime_ms FROM events WHERE user_id % 3 > 0 OR event_id < (SELECT max(event_id) FROM events) // 2), n AS (SELECT max(event_id) * 60000 + 1800000 AS now FROM events),
 a AS (SELECT stem, max(now) - max(mtime_ms) AS age_ms FROM f, n WHERE user_id % 4 <> 0 GROUP BY stem)
 SELECT stem, age_ms, CASE WHEN age_ms < 3600000 THEN 'grace' WHEN age_ms < 86400000 THEN 'young' ELSE 'old' END AS state FROM a WHERE age_ms > 2700000""",
)
def age(spark, d):
    """Families last written between minutes and days ago; those of every fourth user are open."""
    e = spark.read.parquet(f"{d}/events.parquet")
    last = e.agg(F.max("event_id")).first()[0]
    stem = F.concat(F.lit("u"), F.col("user_id").cast("string")).alias("stem")
    files = e.filter((F.col("user_id") % 3 > 0) | (F.col("event_id") < last // 2)).select(stem, (F.col("event_id") * 60_000).alias("mtime_ms"))
    return M.by_age(files, e.filter("user_id % 4 = 0").select(stem).distinct(), last * 60_000 + 1_800_000, 2_700_000 / M.DAY_MS)


@query("n03_daily_health", "SELECT strftime(make_timestamp(ts * 1000), '%Y-%m-%d') AS day, kind, count(*) AS n FROM fx_metrics WHERE kind IS NOT NULL GROUP BY 1, 2")
def daily(spark, d):
    return N.daily_health(view(spark, d, "fx_metrics").filter("kind is not null"))


@query(
    "n01_streaming_ingest",
    "SELECT concat('u', user_id) AS session_id, CAST(count(*) AS BIGINT) AS entries, CAST(max(event_id) AS BIGINT) AS last_pos FROM events GROUP BY user_id",
)
def stream(spark, d):
    """Events arrive as a file stream; the result is what is stored."""
    folder = f"{D.shared_folder(spark)}/stream-{uuid.uuid4().hex}"
    path = f"{d}/events.parquet"
    schema = spark.read.parquet(path).schema
    events = spark.readStream.schema(schema).parquet(f"{d}/events.parque[t]")
    n = F.col("event_id").cast("string")
    entries = events.select(F.concat(F.lit("u"), F.col("user_id").cast("string")).alias("session_id"), F.concat(F.lit("e"), n).alias("entry_id"), F.col("event_id").alias("pos"), F.lit("user").alias("role"), F.col("event_type").alias("text"))
    N.ingest_stream(entries, f"{folder}/table", f"{folder}/state").awaitTermination()
    return spark.read.parquet(f"{folder}/table").groupBy("session_id").agg(F.count("*").alias("entries"), F.max("pos").alias("last_pos"))


FLAGSHIP = "f05_f06_mechanical_leaves"
