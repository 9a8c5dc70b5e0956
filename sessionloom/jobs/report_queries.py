"""Queries of reports, transfer and recall."""

from __future__ import annotations

from pyspark.sql import functions as F

from sessionloom.jobs.dag_queries import _BELOW, _graph
from sessionloom.operators import dag as D
from sessionloom.operators import reports as K
from sessionloom.operators import search as E
from sessionloom.operators import transfer as H
from sessionloom.registry import query
from sessionloom.sources import telemetry
from sessionloom.sources.fixtures import view


def _log(spark, d):
    return view(spark, d, "fx_metrics")


@query(
    "a04_normalize_rows",
    "SELECT pos, CAST(ts AS DOUBLE) AS ts, kind, CASE WHEN pos % 4 <> 1 THEN CAST(input AS DOUBLE) END AS input, session FROM fx_metrics WHERE pos % 7 <> 0",
)
def normalize(spark, d):
    log = _log(spark, d)
    body = F.to_json(F.struct("ts", "event", "kind", "session", F.when(F.col("pos") % 4 == 1, F.concat(F.lit('"'), F.col("input").cast("string"))).otherwise(F.lit(None)).alias("odd"), F.col("input")))
    wrong = F.regexp_replace(body, r'"input":(\d+)', '"input":"$1"')
    line = F.when(F.col("pos") % 7 == 0, F.when(F.col("pos") % 2 == 0, F.lit("{broken")).otherwise(F.lit("[1]"))).when(F.col("pos") % 4 == 1, wrong).otherwise(body)
    return telemetry.parse_rows(log.select("pos", line.alias("raw"))).select("pos", "ts", "kind", "input", "session")


@query("k01_log_window", "SELECT count(*) AS n_rows, min(ts) AS first_ts, max(ts) AS last_ts FROM fx_metrics")
def window(spark, d):
    return K.log_window(_log(spark, d))


@query(
    "k02_occupancy",
    """SELECT CASE WHEN b >= 10 THEN '100%+' ELSE concat(b * 10, '-', b * 10 + 10, '%') END AS bucket, count(*) AS decisions
       FROM (SELECT least(10, CAST(floor(coalesce(occupancy, 0) * 10) AS INT)) AS b FROM fx_metrics WHERE kind = 'context-decision') q GROUP BY 1""",
)
def occupancy(spark, d):
    return K.occupancy_dwell(_log(spark, d))


@query(
    "k03_swap_cadence",
    """WITH r AS (SELECT session, ts, row_number() OVER (PARTITION BY session, cut_count ORDER BY pos) = 1 AND pos % 3 <> 0 AS boundary FROM fx_metrics WHERE kind = 'swap-applied'),
       g AS (SELECT session, ts - lag(ts) OVER (PARTITION BY session ORDER BY ts) AS gap FROM r WHERE boundary), m AS (SELECT session, median(gap) / 60000.0 AS median_minutes FROM g GROUP BY session)
       SELECT r.session, count(*) AS applications, count(*) FILTER (boundary) AS boundaries, CAST(any_value(median_minutes) AS DOUBLE) AS median_minutes FROM r LEFT JOIN m ON m.session = r.session GROUP BY r.session""",
)
def cadence(spark, d):
    """Every third row says that its boundary isn't distinct."""
    return K.swap_cadence(_log(spark, d).withColumn("distinct_boundary", F.when(F.col("pos") % 3 == 0, F.lit(False))))


@query(
    "k04_cache_economics",
    """WITH f AS (SELECT min(ts) AS t FROM fx_metrics WHERE kind = 'swap-applied'), u AS (SELECT m.*, CASE WHEN ts >= t THEN 'after first swap' ELSE 'before first swap' END AS phase FROM fx_metrics m, f WHERE event = 'usage')
       SELECT coalesce(phase, 'total') AS phase, count(*) AS turns, CAST(sum(input) AS BIGINT) AS input, round(sum(cost_total), 4) AS cost FROM u GROUP BY ROLLUP (phase)""",
)
def economics(spark, d):
    return K.cache_economics(_log(spark, d))


@query(
    "k05_summarizer_spend",
    """WITH r AS (SELECT * FROM fx_metrics WHERE kind = 'summarizer-usage')
       SELECT model, stage, count(*) AS calls, CAST(sum(input) AS BIGINT) AS input, round(sum(cost_total), 4) AS cost FROM r GROUP BY 1, 2
       UNION ALL SELECT 'total', '', count(*), CAST(sum(input) AS BIGINT), round(sum(cost_total), 4) FROM r""",
)
def spend(spark, d):
    return K.summarizer_spend(_log(spark, d))


@query("k06_latency", "SELECT stage, count(*) AS n, quantile_disc(input, 0.5) AS p50, quantile_disc(input, 0.95) AS p95 FROM fx_metrics WHERE input IS NOT NULL GROUP BY stage")
def latency(spark, d):
    return K.latency(_log(spark, d), "stage", "input")


@query("k07_slowest", "SELECT kind, max(input) AS largest, arg_min(pos, pos) FILTER (input = top) AS pos FROM (SELECT *, max(input) OVER (PARTITION BY kind) AS top FROM fx_metrics) q GROUP BY kind")
def slowest(spark, d):
    return K.slowest(_log(spark, d), "kind", "input")


@query(
    "k09_calls_after_swap",
    """WITH f AS (SELECT session, min(ts) AS t FROM fx_metrics WHERE kind = 'swap-applied' GROUP BY session), c AS (SELECT session, ts FROM fx_metrics WHERE kind = 'summarizer-error')
       SELECT coalesce(f.session, c.session) AS session, count(c.ts) AS calls, count(*) FILTER (c.ts >= f.t) AS after_swap, max(f.t) IS NOT NULL AS swapped FROM f FULL JOIN c ON f.session = c.session GROUP BY 1""",
)
def after_swap(spark, d):
    return K.calls_after_swap(_log(spark, d), "summarizer-error")


@query(
    "k13_health_by_day",
    """SELECT strftime(make_timestamp(ts * 1000), '%Y-%m-%d') AS day, count(*) FILTER (kind = 'summarizer-error') AS "summarizer-error", count(*) FILTER (kind = 'swap-applied') AS "swap-applied" FROM fx_metrics
       WHERE kind IN ('summarizer-error', 'swap-applied') AND ts <> 0 GROUP BY 1""",
)
def health(spark, d):
    return K.health_by_day(_log(spark, d).filter("ts <> 0"), ("summarizer-error", "swap-applied"))


@query("k14_causes", "SELECT model AS cause, count(*) AS n FROM fx_metrics WHERE model IS NOT NULL GROUP BY model")
def causes(spark, d):
    return K.top_causes(_log(spark, d), "model")


@query("k15_worst_by_day", "SELECT strftime(make_timestamp(ts * 1000), '%Y-%m-%d') AS day, count(*) AS n, round(max(cost_total / input), 6) AS worst FROM fx_metrics WHERE input > 0 AND ts <> 0 GROUP BY 1")
def worst(spark, d):
    return K.worst_ratio_by_day(_log(spark, d).filter("ts <> 0"), "cost_total", "input")


@query(
    "k17_per_session",
    """SELECT session, count(*) AS n_rows, count(*) FILTER (kind = 'context-decision') AS decisions, count(*) FILTER (kind = 'swap-applied') AS swaps, count(*) FILTER (kind = 'summarizer-error') AS errors,
       arg_max(occupancy, pos) FILTER (kind = 'context-decision') AS last_occupancy, max(pos) AS last_pos FROM fx_metrics GROUP BY session""",
)
def sessions(spark, d):
    return K.per_session(_log(spark, d))


def _report_sql() -> str:
    count = lambda condition, name: f"count(*) FILTER ({condition}) AS {name}"
    total = lambda k, c, name=None: f"CAST(coalesce(sum({c}) FILTER (kind = '{k}'), 0) AS BIGINT) AS {name or c}"
    timed = "kind IN ('summary-stored', 'summary-replaced', 'summary-skipped-existing')"
    columns = [
        "count(*) AS n_rows",
        count("kind = 'projection'", "projections"),
        *[count(f"kind = 'compaction-checkpoint' AND action = '{a}'", name) for a, name in (("checkpoint", "written"), ("skip", "checkpoints_skipped"), ("fail", "checkpoints_failed"))],
        "arg_max(chars, pos) FILTER (kind = 'compaction-checkpoint' AND action = 'checkpoint') AS last_chars",
        count("kind = 'pass'", "passes"),
        *[count(f"kind = 'pass' AND outcome = '{o}'", f"passes_{o}") for o in ("stored", "nothing", "failed")],
        total("pass", "leaf"),
        total("pass", "condensed"),
        count("kind = 'summary-stored'", "nodes"),
        *[count(f"kind = 'summary-stored' AND stage = '{x}'", f"{x}_nodes") for x in ("leaf", "condensed")],
        *[count(f"kind = 'summary-{k}'", name) for k, name in (("replaced", "replaced"), ("skipped-existing", "existing"), ("fallback-stored", "fallbacks"))],
        f"count(duration_ms) FILTER ({timed}) AS timed",
        f"quantile_disc(duration_ms, 0.5) FILTER ({timed}) AS p50",
        f"quantile_disc(duration_ms, 0.95) FILTER ({timed}) AS p95",
        count("kind = 'summarizer-usage'", "calls"),
        count("kind = 'summarizer-usage' AND estimated", "estimated"),
        count("kind = 'summarizer-error'", "errors"),
        count("kind = 'summarizer-capped'", "capped"),
        count("kind = 'compaction-abandoned'", "abandoned"),
        total("compaction-abandoned", "dropped"),
        count("kind = 'heal-complete'", "heals"),
        *[total("heal-complete", c) for c in ("repaired", "improved", "failed", "blocked", "blocked_source", "skipped", "changed", "not_attempted")],
        total("heal-complete", "calls", "heal_calls"),
        "arg_max(stop, pos) FILTER (kind = 'heal-complete') AS last_stop",
        count("kind = 'reader'", "readers"),
        *[count(f"kind = 'reader' AND outcome = '{o}'", f"readers_{o}") for o in ("answered", "failed", "timeout")],
        "CAST(coalesce(round(avg(duration_ms) FILTER (kind = 'reader')), 0) AS BIGINT) AS reader_ms",
        *[f"arg_max_null({c}, pos) FILTER (kind = 'projection') AS last_{c}" for c in ("action", "occupancy", "tokens")],
    ]
    tops = """r AS (SELECT session, action, reason, count(*) AS n, row_number() OVER (PARTITION BY session, action ORDER BY count(*) DESC, reason) AS k FROM fx_log WHERE kind = 'projection' AND action IN ('kick', 'bail') AND reason IS NOT NULL GROUP BY 1, 2, 3),
 rr AS (SELECT session, string_agg(concat(reason, ' ', n), ', ' ORDER BY k) FILTER (action = 'kick' AND k <= 3) AS kick_reasons, string_agg(concat(reason, ' ', n), ', ' ORDER BY k) FILTER (action = 'bail' AND k <= 3) AS bail_reasons FROM r GROUP BY 1),
 a AS (SELECT session, string_agg(concat(action, ' ', n), ', ' ORDER BY action) AS actions FROM (SELECT session, action, count(*) AS n FROM fx_log WHERE kind = 'projection' AND action IS NOT NULL GROUP BY 1, 2) q GROUP BY 1),
 o AS (SELECT session, coalesce(tool, '(unrecorded)') AS tool, outcome, count(*) AS n FROM fx_log WHERE kind = 'recall' GROUP BY 1, 2, 3),
 t AS (SELECT session, tool, CAST(sum(n) AS BIGINT) AS n, string_agg(concat(outcome, ' ', n), ' ' ORDER BY CASE outcome WHEN 'hit' THEN 0 WHEN 'miss' THEN 1 WHEN 'refused' THEN 2 ELSE 3 END) AS detail FROM o GROUP BY 1, 2),
 u AS (SELECT *, row_number() OVER (PARTITION BY session ORDER BY n DESC, tool) AS k FROM t),
 tt AS (SELECT session, string_agg(concat(tool, ' ', n, ' (', detail, ')'), ', ' ORDER BY k) FILTER (k <= 5) AS recall, greatest(count(*) - 5, 0) AS more_tools FROM u GROUP BY 1)"""
    return f"""WITH c AS (SELECT session, {", ".join(columns)} FROM fx_log GROUP BY session), {tops}
 SELECT c.*, CASE WHEN nodes + replaced > 0 THEN round(100.0 * fallbacks / (nodes + replaced), 1) END AS fallback_percent, actions, kick_reasons, bail_reasons, recall, coalesce(more_tools, 0) AS more_tools
 FROM c LEFT JOIN a USING (session) LEFT JOIN rr USING (session) LEFT JOIN tt USING (session)"""


@query("k17_session_report", _report_sql())
def session_report(spark, d):
    return K.session_report(view(spark, d, "fx_log"))


@query("k02_recut_share", "SELECT count(*) AS decisions, count(*) FILTER (occupancy >= commit_at) AS at_recut FROM fx_log WHERE kind = 'projection' AND occupancy IS NOT NULL AND commit_at IS NOT NULL")
def recut_share(spark, d):
    return K.recut_share(view(spark, d, "fx_log"))


@query("k05_spend_quality", "SELECT stage, count(*) AS calls, count(*) FILTER (rejected) AS rejected, count(*) FILTER (estimated) AS estimated, CAST(sum(tokens) AS BIGINT) AS tokens FROM fx_log WHERE kind = 'summarizer-usage' GROUP BY stage")
def spend_quality(spark, d):
    return K.spend_quality(view(spark, d, "fx_log"))


@query(
    "k07_fallback_share",
    """WITH w AS (SELECT * FROM fx_log WHERE kind IN ('summary-stored', 'summary-replaced')), f AS (SELECT count(*) AS fallbacks FROM fx_log WHERE kind = 'summary-fallback-stored')
 SELECT (SELECT count(*) FROM w) AS writes, fallbacks, round(fallbacks / (SELECT count(*) FROM w), 6) AS share, (SELECT max(duration_ms) FROM w) AS slowest_ms, (SELECT min(pos) FROM w WHERE duration_ms = (SELECT max(duration_ms) FROM w)) AS slowest_pos FROM f""",
)
def fallback_share(spark, d):
    return K.fallback_share(view(spark, d, "fx_log"))


@query("k09_recall_callers", "SELECT coalesce(tool, '(unrecorded)') AS tool, coalesce(caller, '(unrecorded)') AS caller, count(*) AS calls FROM fx_log WHERE kind = 'recall' GROUP BY 1, 2")
def recall_callers(spark, d):
    return K.recall_callers(view(spark, d, "fx_log"))


@query("k10_reader_addressing", "SELECT CASE WHEN summary_id IS NOT NULL THEN 'summary' WHEN entry_id IS NOT NULL THEN 'entry' ELSE 'searched' END AS addressed, count(*) AS n, CAST(sum(tokens) AS BIGINT) AS tokens FROM fx_log WHERE kind = 'reader' GROUP BY 1")
def reader_addressing(spark, d):
    return K.reader_addressing(view(spark, d, "fx_log"))


@query("k15_stalls", "SELECT strftime(make_timestamp(ts * 1000), '%Y-%m-%d') AS day, reason, count(*) AS n, round(max(frontier_tokens / target_tokens), 6) AS worst FROM fx_log WHERE kind = 'frontier-over-target' GROUP BY 1, 2")
def stalls(spark, d):
    return K.stalls(view(spark, d, "fx_log"))


@query(
    "k16_losses_by_day",
    """SELECT strftime(make_timestamp(ts * 1000), '%Y-%m-%d') AS day, CAST(sum(greatest(0, before_tokens - after_tokens)) AS BIGINT) AS freed, count(*) FILTER (oversized) AS oversized, count(*) FILTER (truncated) AS truncated
 FROM fx_log WHERE kind IN ('summary-stored', 'summary-replaced') GROUP BY 1""",
)
def losses(spark, d):
    return K.losses_by_day(view(spark, d, "fx_log"))


@query("k18_newest_rows", "SELECT session, pos FROM (SELECT *, row_number() OVER (PARTITION BY session ORDER BY pos DESC) AS n FROM fx_metrics) q WHERE n <= 25")
def newest(spark, d):
    return K.newest_rows(_log(spark, d)).select("session", "pos")


@query("k18_kind_tally", "SELECT coalesce(kind, event) AS kind, count(*) AS n FROM fx_metrics GROUP BY 1")
def tally(spark, d):
    return K.kind_tally(_log(spark, d))


@query(
    "a06_export",
    """WITH o AS (SELECT session_id, id, row_number() OVER (PARTITION BY session_id ORDER BY id) - 1 AS ordinal FROM fx_summaries)
       SELECT session_id, 'message' AS row_type, row_id AS ordinal, 0 AS refs FROM fx_messages
       UNION ALL SELECT s.session_id, 'summary', o.ordinal, (SELECT count(*) FROM fx_provenance p WHERE p.session_id = s.session_id AND p.summary_id = s.id) FROM fx_summaries s JOIN o ON o.session_id = s.session_id AND o.id = s.id""",
)
def export(spark, d):
    m, s, p = _graph(spark, d)
    lines = H.export_rows(m, s, p)
    r = F.from_json("line", H.EXPORT)
    return lines.select("session_id", "row_type", "ordinal", (F.greatest(F.size(F.coalesce(r["entries"], F.array())), F.lit(0)) + F.greatest(F.size(F.coalesce(r["children"], F.array())), F.lit(0))).cast("long").alias("refs"))


@query(
    "a07_parse_export",
    """SELECT session_id, min(row_id) AS line_no, CASE WHEN min(row_id) % 3 = 0 THEN 'not JSON' ELSE 'row type' END AS problem FROM fx_messages WHERE row_id % 3 = 0 OR row_id % 5 = 2 GROUP BY session_id""",
)
def parse(spark, d):
    m, s, p = _graph(spark, d)
    lines = H.export_rows(m, s, p).filter("row_type = 'message'").withColumn("line_no", F.col("ordinal"))
    broken = F.when(F.col("line_no") % 3 == 0, F.lit("{oops")).when(F.col("line_no") % 5 == 2, F.regexp_replace("line", '"rowType":"message"', '"rowType":"other"')).otherwise(F.col("line"))
    return H.first_problems(H.parse_lines(lines.select("session_id", "line_no", broken.alias("line"))))


@query("h01_depth_problems", "SELECT p.session_id, p.summary_id, p.child_id FROM bad_provenance p JOIN bad_summaries s ON s.session_id = p.session_id AND s.id = p.summary_id LEFT JOIN bad_summaries c ON c.session_id = p.session_id AND c.id = p.child_id WHERE p.child_type = 'summary' AND (c.id IS NULL OR c.depth >= s.depth)")
def depth_problems(spark, d):
    _, s, p = _graph(spark, d, bad=True)
    return H.depth_problems(s, p)


@query("h02_conflicts", "SELECT session_id, entry_id, 2 AS texts FROM fx_messages WHERE row_id % 4 = 1")
def conflicts(spark, d):
    m = view(spark, d, "fx_messages")
    return H.conflicting_entries(m.unionByName(m.withColumn("text", F.when(F.col("row_id") % 4 == 1, F.concat("text", F.lit("!"))).otherwise(F.col("text")))))


@query("h04_clashes", "SELECT session_id, entry_id, 'clash' AS what FROM fx_messages WHERE row_id % 4 = 1 UNION ALL SELECT session_id, entry_id, 'foreign' FROM fx_messages WHERE row_id = 3")
def clash(spark, d):
    m = view(spark, d, "fx_messages")
    given = m.filter("row_id <> 3").withColumn("text", F.when(F.col("row_id") % 4 == 1, F.concat("text", F.lit("!"))).otherwise(F.col("text")))
    return H.clashes(m, given).withColumn("what", F.lit("clash")).unionByName(H.foreign_entries(m, given).withColumn("what", F.lit("foreign")))


_BM25 = """WITH t AS (SELECT session_id, row_id, list_filter(regexp_split_to_array(lower(text), '[^\\p{L}\\p{N}]+'), lambda x: x <> '') AS t FROM fx_messages),
 c AS (SELECT session_id, row_id, len(t) AS length, len(list_filter(t, lambda x: x = 'the')) AS f0, len(list_filter(t, lambda x: x = 'on')) AS f1 FROM t),
 n AS (SELECT session_id, count(*) AS n, avg(length) AS mean, count(*) FILTER (f0 > 0) AS n0, count(*) FILTER (f1 > 0) AS n1 FROM c GROUP BY 1),
 h AS (SELECT session_id, row_id, round(ln(1 + (n - n0 + 0.5) / (n0 + 0.5)) * f0 * 2.2 / (f0 + 1.2 * (0.25 + 0.75 * length / mean)) + ln(1 + (n - n1 + 0.5) / (n1 + 0.5)) * f1 * 2.2 / (f1 + 1.2 * (0.25 + 0.75 * length / mean)), 6) AS score FROM c JOIN n USING (session_id) WHERE f0 > 0 AND f1 > 0)"""


@query("e01_ranked_search", _BM25 + " SELECT * FROM h")
def ranked(spark, d):
    return E.ranked_search(view(spark, d, "fx_messages"), ["the", "on"])


@query("e02_match_count", _BM25 + " SELECT session_id, count(*) AS n FROM h GROUP BY session_id")
def count(spark, d):
    return E.ranked_search(view(spark, d, "fx_messages"), ["the", "on"]).groupBy("session_id").agg(F.count("*").alias("n"))


@query("e01_phrase", "SELECT session_id, row_id FROM fx_tool_messages WHERE text LIKE 'please look at%' AND removed_at_ms IS NULL")
def phrase(spark, d):
    return E.phrase_hits(view(spark, d, "fx_tool_messages"), ["look", "at"])


@query("e08_regex_scan", "SELECT session_id, row_id, length(string_split_regex(text, '(?i)th[ae]\\w+')[1]) AS at, CAST(len(regexp_extract_all(text, '(?i)th[ae]\\w+')) AS INTEGER) AS matches, false AS partial FROM fx_messages WHERE regexp_matches(text, '(?i)th[ae]\\w+')")
def scan(spark, d):
    return E.regex_scan(view(spark, d, "fx_messages"), r"th[ae]\w+")


@query(
    "e04_tool_scope",
    """WITH k AS (SELECT session_id, row_id, CASE WHEN role <> 'user' AND (text LIKE '%[tool:click]%' OR text LIKE 'tool click %') THEN 'anchor' WHEN role <> 'toolResult' OR text LIKE 'tool %' THEN 'break' END AS kind FROM fx_tool_messages),
       l AS (SELECT *, last_value(kind IGNORE NULLS) OVER (PARTITION BY session_id ORDER BY row_id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS last FROM k)
       SELECT session_id, row_id FROM l WHERE kind = 'anchor' OR kind IS NULL AND last = 'anchor'""",
)
def scope(spark, d):
    return E.tool_scope(view(spark, d, "fx_tool_messages"), "click")


@query(
    "e10_cross_session",
    _BM25 + """, r AS (SELECT *, row_number() OVER (PARTITION BY session_id ORDER BY score DESC, row_id) AS rank FROM h), s AS (SELECT session_id, max(ts_ms) AS when_ms FROM fx_messages GROUP BY 1 ORDER BY when_ms DESC, session_id LIMIT 20)
 SELECT session_id, row_id, score, rank, when_ms FROM r JOIN s USING (session_id) WHERE rank <= 10 ORDER BY when_ms DESC, session_id, rank LIMIT 40""",
)
def cross(spark, d):
    m = view(spark, d, "fx_messages")
    return E.top_per_session(E.ranked_search(m, ["the", "on"]), 10, m.groupBy("session_id").agg(F.max("ts_ms").alias("when_ms")))


@query(
    "e13_expand",
    _BELOW.format(p="fx_provenance")
    + """, e AS (SELECT DISTINCT b.session_id, b.node, p.child_id AS row_id FROM below b JOIN fx_provenance p ON p.session_id = b.session_id AND p.summary_id = b.child AND p.child_type = 'message'),
 k AS (SELECT *, row_number() OVER (PARTITION BY session_id, node ORDER BY row_id) - 1 AS k FROM e)
 SELECT session_id, node, row_id, role, text FROM k JOIN fx_messages USING (session_id, row_id) WHERE k >= 1 AND k < 3""",
)
def expand(spark, d):
    m, _, p = _graph(spark, d)
    return E.expand_page(D.covered_edges(p, D.closure(p)), m, 1, 2)


@query(
    "e15_overlap_order",
    """WITH o AS (SELECT session_id, row_id AS position, len(list_intersect(['between', 'from', 'that', 'this'][3:4], list_distinct(regexp_split_to_array(lower(text), '[^a-z0-9]+')))) AS overlap FROM fx_messages)
       SELECT session_id, position, overlap, row_number() OVER (PARTITION BY session_id ORDER BY overlap DESC, position) AS place FROM o""".replace("['between', 'from', 'that', 'this'][3:4]", "['answer', 'thing']"),
)
def overlap(spark, d):
    m = view(spark, d, "fx_messages").withColumn("position", F.col("row_id"))
    return E.order_by_overlap(m, "What is that thing of the answer?").select("session_id", "position", "overlap", "place")


@query(
    "e18_read_budget",
    """WITH b AS (SELECT session_id, row_id AS place, length(text) AS chars, coalesce(sum(length(text)) OVER (PARTITION BY session_id ORDER BY row_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS used FROM fx_messages),
       g AS (SELECT *, greatest(0, least(chars, 2000 - used)) AS granted FROM b)
       SELECT session_id, place, CAST(granted AS BIGINT) AS granted, CASE WHEN granted = chars THEN 'full' WHEN granted > 0 THEN 'partial' ELSE 'refused' END AS outcome FROM g""",
)
def budgeted(spark, d):
    reads = view(spark, d, "fx_messages").select("session_id", F.col("row_id").alias("place"), F.length("text").cast("long").alias("chars"))
    return E.read_budget(reads, 500).select("session_id", "place", "granted", "outcome")
