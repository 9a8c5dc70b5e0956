"""Queries over the summary graph, its integrity and its repairs."""

from __future__ import annotations

from pyspark.sql import functions as F

from sessionloom.operators import dag as D
from sessionloom.operators import ingest as C
from sessionloom.operators import integrity as I
from sessionloom.registry import query
from sessionloom.sources.fixtures import view


def _graph(spark, d, bad=False):
    names = ("fx_messages", "bad_summaries", "bad_provenance") if bad else ("fx_messages", "fx_summaries", "fx_provenance")
    return [view(spark, d, n) for n in names]


@query("c01_ingestible", "SELECT session_id, row_id FROM fx_messages WHERE turn_text <> ''".replace("turn_text", "trim(text)"))
def ingestible(spark, d):
    return C.ingestible(view(spark, d, "fx_messages")).select("session_id", "row_id")


def _redelivered(spark, d):
    m = view(spark, d, "fx_messages").withColumn("pos", F.col("row_id"))
    again = m.filter("row_id % 3 = 0").withColumn("pos", F.col("row_id") + 1000).withColumn("text", F.lit("altered"))
    blank = m.filter("row_id = 1").withColumn("pos", F.lit(5000).cast("long")).withColumn("entry_id", F.concat("entry_id", F.lit("x"))).withColumn("text", F.lit("  "))
    return m.filter("row_id % 2 = 1"), m.unionByName(again).unionByName(blank)


@query(
    "c02_insert_new",
    """WITH old AS (SELECT session_id, max(row_id) AS top FROM fx_messages WHERE row_id % 2 = 1 GROUP BY session_id)
       SELECT m.session_id, m.entry_id, o.top + row_number() OVER (PARTITION BY m.session_id ORDER BY m.row_id) AS row_id, m.role, m.tokens
       FROM fx_messages m JOIN old o USING (session_id) WHERE m.row_id % 2 = 0""",
)
def insert_new(spark, d):
    stored, entries = _redelivered(spark, d)
    return C.insert_new(stored, entries.drop("row_id")).select("session_id", "entry_id", "row_id", "role", "tokens")


@query(
    "c02_insert_twins",
    """SELECT session_id, entry_id, row_number() OVER (PARTITION BY session_id ORDER BY row_id) AS row_id, text FROM fx_messages WHERE trim(text) <> ''""",
)
def insert_twins(spark, d):
    """Each entry arrives three times within one batch, at one place or later, with another text; one row of each is stored."""
    m = view(spark, d, "fx_messages").withColumn("pos", F.col("row_id")).drop("row_id")
    twins = m.withColumn("text", F.concat("text", F.lit(" again"))).filter(F.trim("text") != "again")
    later = m.withColumn("text", F.lit("!")).withColumn("pos", F.col("pos") + 500)
    blank = view(spark, d, "fx_messages").filter("trim(text) = ''").select("session_id", "entry_id")
    entries = twins.unionByName(m).unionByName(m).unionByName(later).join(blank, ["session_id", "entry_id"], "left_anti")
    none = spark.createDataFrame([], "session_id string, entry_id string, row_id long")
    return C.insert_new(none, entries).select("session_id", "entry_id", "row_id", "text")


@query(
    "c02_insert_counts",
    "SELECT session_id, CAST(count(*) FILTER (row_id % 2 = 0) AS BIGINT) AS inserted, CAST(count(*) FILTER (row_id % 2 = 1) + count(*) FILTER (row_id % 3 = 0) AS BIGINT) AS skipped FROM fx_messages GROUP BY session_id",
)
def insert_counts(spark, d):
    stored, entries = _redelivered(spark, d)
    return C.insert_counts(stored, entries.drop("row_id"))


@query(
    "c03_delta",
    """SELECT session_id, entry_id, session_id LIKE '%7' AS reset FROM fx_messages WHERE session_id LIKE '%7' OR row_id > 2
       UNION ALL SELECT session_id, entry_id, true FROM fx_messages WHERE row_id <= 2 AND NOT session_id LIKE '%7' AND session_id NOT IN (SELECT session_id FROM fx_messages WHERE row_id = 2)""",
)
def delta(spark, d):
    m = view(spark, d, "fx_messages").withColumn("pos", F.col("row_id"))
    marks = m.filter("row_id = 2 and not session_id like '%7'")
    return C.delta_after(m, marks).select("session_id", "entry_id", "reset")


@query("c03_watermark", "SELECT session_id, arg_max(entry_id, row_id) AS entry_id FROM fx_messages GROUP BY session_id")
def watermark(spark, d):
    return C.next_watermark(view(spark, d, "fx_messages").withColumn("pos", F.col("row_id")))


@query(
    "c04_externalize",
    "SELECT left(sha256(text), 16) AS file_id, min(doc_id) AS doc_id, CAST(min(length(text)) AS BIGINT) AS bytes FROM fx_files WHERE length(text) >= 6000 GROUP BY 1",
)
def externalize(spark, d):
    return C.externalize(view(spark, d, "fx_files"), 6000)[0].select("file_id", "doc_id", "bytes")


@query(
    "c11_reconcile",
    """SELECT session_id, entry_id, CASE WHEN row_id % 5 = 0 THEN coalesce(removed_at_ms, 7) END AS removed_at_ms,
       (row_id % 5 = 0) <> (removed_at_ms IS NOT NULL) AS changed FROM fx_tool_messages""",
)
def reconcile(spark, d):
    m = view(spark, d, "fx_tool_messages")
    return C.reconcile(m, m.filter("row_id % 5 <> 0"), 7).select("session_id", "entry_id", "removed_at_ms", "changed")


@query("c12_families", "SELECT split_part(entry_id, ':', 1) AS family, count(*) AS n FROM fx_messages GROUP BY 1")
def families(spark, d):
    return C.family_counts(view(spark, d, "fx_messages"))


@query(
    "d01_span_bounds",
    "SELECT session_id, arg_min(entry_id, row_id) AS first_entry_id, arg_max(entry_id, row_id) AS last_entry_id FROM fx_messages WHERE row_id % 2 = 0 GROUP BY session_id",
)
def bounds(spark, d):
    m = view(spark, d, "fx_messages")
    return D.span_bounds(m, m.filter("row_id % 2 = 0"))


_ENDS = "SELECT s.*, a.row_id AS first_row, b.row_id AS last_row FROM fx_summaries s LEFT JOIN fx_messages a ON a.session_id = s.session_id AND a.entry_id = s.first_entry_id LEFT JOIN fx_messages b ON b.session_id = s.session_id AND b.entry_id = s.last_entry_id"


@query("d02_messages_in_spans", f"WITH e AS ({_ENDS}) SELECT e.session_id, e.id, m.row_id FROM e JOIN fx_messages m ON m.session_id = e.session_id AND m.row_id BETWEEN first_row AND last_row")
def spans(spark, d):
    m, s, _ = _graph(spark, d)
    return D.messages_in_spans(s, m, "id", 4).select("session_id", "id", "row_id")


@query("d03_uncovered", "SELECT session_id, row_id FROM fx_messages WHERE row_id >= 8")
def uncovered(spark, d):
    m, s, p = _graph(spark, d)
    return D.uncovered(m, p, s).select("session_id", "row_id")


@query("d04_covering_leaf", "SELECT session_id, row_id, CAST(floor((row_id - 1) / 3.0) AS BIGINT) + 1 AS summary_id FROM fx_messages WHERE row_id < 8")
def covering(spark, d):
    m, s, p = _graph(spark, d)
    return D.covering_leaf(m, p, s)


_BELOW = """WITH RECURSIVE below AS (SELECT DISTINCT session_id, summary_id AS node, summary_id AS child FROM {p}
 UNION SELECT b.session_id, b.node, p.child_id FROM below b JOIN {p} p ON p.session_id = b.session_id AND p.summary_id = b.child AND p.child_type = 'summary')"""


@query("d05_closure", _BELOW.format(p="bad_provenance") + " SELECT session_id, node, child FROM below")
def closure(spark, d):
    return D.closure(_graph(spark, d, bad=True)[2])


@query("d05_closure_deep", _BELOW.format(p="deep_provenance") + " SELECT session_id, node, count(*) AS n, min(child) AS least, CAST(sum(child) AS BIGINT) AS total FROM below GROUP BY session_id, node")
def closure_deep(spark, d):
    """Six levels, with a cycle from a leaf to the fourth in some sessions."""
    found = D.closure(view(spark, d, "deep_provenance"))
    return found.groupBy("session_id", "node").agg(F.count("*").alias("n"), F.min("child").alias("least"), F.sum("child").alias("total"))


@query(
    "d06_covered_size",
    _BELOW.format(p="bad_provenance")
    + """, e AS (SELECT DISTINCT b.session_id, b.node, b.child, p.child_id FROM below b JOIN bad_provenance p ON p.session_id = b.session_id AND p.summary_id = b.child AND p.child_type = 'message')
 SELECT e.session_id, e.node, count(*) AS messages, CAST(sum(m.tokens) AS BIGINT) AS tokens FROM e JOIN fx_messages m ON m.session_id = e.session_id AND m.row_id = e.child_id GROUP BY 1, 2""",
)
def sizes(spark, d):
    m, _, p = _graph(spark, d, bad=True)
    return D.covered_size(m, D.covered_edges(p, D.closure(p)))


_FRONTIER = f"""WITH e AS ({_ENDS}), t AS (SELECT * FROM e WHERE NOT EXISTS (SELECT 1 FROM fx_provenance p WHERE p.session_id = e.session_id AND p.child_type = 'summary' AND p.child_id = e.id)),
 r AS (SELECT *, max(last_row) OVER (PARTITION BY session_id ORDER BY first_row, last_row DESC, depth DESC, id DESC ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS reach FROM t),
 f AS (SELECT * FROM r WHERE last_row > coalesce(reach, -1))"""


@query("d07_frontier", _FRONTIER + " SELECT session_id, id, row_number() OVER (PARTITION BY session_id ORDER BY first_row, last_row DESC, depth DESC, id DESC) AS position FROM f")
def frontier(spark, d):
    m, s, p = _graph(spark, d)
    return D.frontier(s, m, p).select("session_id", "id", "position")


@query(
    "d08_parents_children",
    """SELECT s.session_id, s.id, (SELECT string_agg(p.summary_id, ',' ORDER BY p.summary_id) FROM fx_provenance p WHERE p.session_id = s.session_id AND p.child_type = 'summary' AND p.child_id = s.id) AS parents,
       (SELECT string_agg(p.child_id, ',' ORDER BY p.child_id) FROM fx_provenance p WHERE p.session_id = s.session_id AND p.child_type = 'summary' AND p.summary_id = s.id) AS children FROM fx_summaries s""",
)
def relatives(spark, d):
    _, s, p = _graph(spark, d)
    r = D.parents_and_children(p, s)
    text = lambda c: F.array_join(F.col(c).cast("array<string>"), ",").alias(c)
    return r.select("session_id", "id", text("parents"), text("children"))


@query(
    "d09_merge_summaries",
    "SELECT session_id, id + 500 AS id FROM fx_summaries WHERE id % 2 = 0 AND id <> 100 ",
)
def merge(spark, d):
    _, s, _ = _graph(spark, d)
    return D.merge_summaries(s.filter("id % 2 = 1 or id = 100"), s.withColumn("id", F.col("id") + 500)).select("session_id", "id")


@query(
    "d10_replace_if_smaller",
    """SELECT session_id, id, tokens > 0 AND floor(tokens * (id % 4) / 3.0) <= 0.75 * tokens AND NOT EXISTS (SELECT 1 FROM fx_provenance p WHERE p.session_id = s.session_id AND p.child_type = 'summary' AND p.child_id = s.id)
       AND NOT (quality = 'clean' AND id % 2 = 0) AS replaced FROM fx_summaries s""",
)
def replace(spark, d):
    _, s, p = _graph(spark, d)
    tries = s.select("session_id", "id", F.floor(F.col("tokens") * (F.col("id") % 4) / 3.0).alias("new_tokens"), F.when(F.col("id") % 2 == 0, "clipped").otherwise("clean").alias("new_quality"))
    return D.replace_if_smaller(s, tries, p).select("session_id", "id", "replaced")


@query(
    "d10_replaced_texts",
    """WITH r AS (SELECT *, tokens > 0 AND floor(tokens * (id % 4) / 3.0) <= 0.75 * tokens AND NOT EXISTS (SELECT 1 FROM fx_provenance p WHERE p.session_id = s.session_id AND p.child_type = 'summary' AND p.child_id = s.id) AND NOT (quality = 'clean' AND id % 2 = 0) AS hit FROM fx_summaries s)
 SELECT session_id, id, CASE WHEN hit THEN concat('new ', id) ELSE concat('old ', id) END AS text, CASE WHEN id % 5 = 1 THEN 'given' WHEN hit THEN concat('old ', id) END AS thorough_text, CAST(CASE WHEN hit THEN floor(tokens * (id % 4) / 3.0) ELSE tokens END AS BIGINT) AS tokens,
  CASE WHEN hit THEN CASE WHEN id % 2 = 0 THEN 'clipped' ELSE 'clean' END ELSE quality END AS quality FROM r""",
)
def replaced_texts(spark, d):
    _, s, p = _graph(spark, d)
    n = F.col("id").cast("string")
    s = s.select("session_id", "id", F.concat(F.lit("old "), n).alias("text"), F.when(F.col("id") % 5 == 1, "given").alias("thorough_text"), "tokens", "quality")
    tries = s.select("session_id", "id", F.concat(F.lit("new "), n).alias("new_text"), F.floor(F.col("tokens") * (F.col("id") % 4) / 3.0).alias("new_tokens"), F.when(F.col("id") % 2 == 0, "clipped").otherwise("clean").alias("new_quality"))
    return D.replaced_summaries(s, tries, p)


@query(
    "d11_ordered_sources",
    """WITH c AS (SELECT p.*, CASE p.child_type WHEN 'message' THEN p.child_id ELSE (SELECT min(m.row_id) FROM fx_summaries s JOIN fx_messages m ON m.session_id = s.session_id AND m.entry_id = s.first_entry_id WHERE s.session_id = p.session_id AND s.id = p.child_id) END AS place_at FROM fx_provenance p)
       SELECT session_id, summary_id, row_number() OVER (PARTITION BY session_id, summary_id ORDER BY place_at NULLS LAST, child_id) - 1 AS place, child_type, child_id FROM c""",
)
def sources(spark, d):
    m, s, p = _graph(spark, d)
    return D.ordered_sources(s, m, p)


@query(
    "d15_store_stats",
    """SELECT session_id, count(*) AS messages, CAST(sum(tokens) AS BIGINT) AS tokens, count(removed_at_ms) AS removed, 0 AS summaries FROM fx_tool_messages GROUP BY session_id""",
)
def stats(spark, d):
    m = view(spark, d, "fx_tool_messages")
    return D.store_stats(m, view(spark, d, "fx_summaries"))


@query(
    "d15_payloads_and_files",
    """SELECT m.session_id, count(*) AS messages, CAST(sum(tokens) AS BIGINT) AS tokens, 0 AS removed, count(*) FILTER (row_id % 3 = 0) AS payloads, CAST(coalesce(sum(strlen(text)) FILTER (row_id % 3 = 0), 0) AS BIGINT) AS payload_bytes,
  (SELECT count(*) FROM fx_summaries s WHERE s.session_id = m.session_id) AS summaries, count(*) FILTER (row_id % 2 = 0) AS files, CAST(coalesce(sum(length(text)) FILTER (row_id % 2 = 0), 0) AS BIGINT) AS file_bytes FROM fx_messages m GROUP BY m.session_id""",
)
def payloads_and_files(spark, d):
    m, s, _ = _graph(spark, d)
    rows = m.withColumns({"payload": F.when(F.col("row_id") % 3 == 0, F.col("text")), "removed_at_ms": F.lit(None).cast("long")})
    return D.store_stats(rows, s, m.filter("row_id % 2 = 0").select("session_id", F.length("text").cast("long").alias("bytes")))


@query("d17_depth_stats", "SELECT depth, count(*) AS n, CAST(sum(tokens) AS BIGINT) AS tokens, CAST(round(avg(tokens)) AS BIGINT) AS average FROM fx_summaries GROUP BY depth")
def depths(spark, d):
    return D.depth_stats(view(spark, d, "fx_summaries"))


@query(
    "d18_node_costs",
    _BELOW.format(p="fx_provenance")
    + """, e AS (SELECT DISTINCT b.session_id, b.node, b.child, p.child_id FROM below b JOIN fx_provenance p ON p.session_id = b.session_id AND p.summary_id = b.child AND p.child_type = 'message'),
 c AS (SELECT e.session_id, e.node, count(*) AS messages, sum(m.tokens) AS tokens FROM e JOIN fx_messages m ON m.session_id = e.session_id AND m.row_id = e.child_id GROUP BY 1, 2),
 k AS (SELECT p.session_id, p.summary_id, sum(s.tokens) AS tokens FROM fx_provenance p JOIN fx_summaries s ON s.session_id = p.session_id AND s.id = p.child_id WHERE p.child_type = 'summary' GROUP BY 1, 2)
 SELECT s.session_id, s.id, coalesce(c.messages, 0) AS messages, CAST(coalesce(c.tokens, 0) AS BIGINT) AS source_tokens, CAST(s.tokens + coalesce(k.tokens, 0) AS BIGINT) AS subtree_tokens
 FROM fx_summaries s LEFT JOIN c ON c.session_id = s.session_id AND c.node = s.id LEFT JOIN k ON k.session_id = s.session_id AND k.summary_id = s.id""",
)
def costs(spark, d):
    m, s, p = _graph(spark, d)
    return D.node_costs(s, m, p)


_BAD_ENDS = "SELECT s.*, a.row_id AS first_row, b.row_id AS last_row FROM bad_summaries s LEFT JOIN fx_messages a ON a.session_id = s.session_id AND a.entry_id = s.first_entry_id LEFT JOIN fx_messages b ON b.session_id = s.session_id AND b.entry_id = s.last_entry_id"
_FOUND = f"""WITH e AS ({_BAD_ENDS}),
 k AS (SELECT e.*, (SELECT count(*) FROM bad_provenance p WHERE p.session_id = e.session_id AND p.summary_id = e.id AND p.child_type = 'message') AS nm,
              (SELECT count(*) FROM bad_provenance p WHERE p.session_id = e.session_id AND p.summary_id = e.id AND p.child_type = 'summary') AS nc FROM e),
 f AS (SELECT 'summary-span' AS kind, session_id, id FROM e WHERE first_row IS NULL OR last_row IS NULL
   UNION ALL SELECT DISTINCT 'summary-shape', session_id, id FROM k WHERE kind = 'leaf' AND (depth <> 0 OR nm = 0) OR kind = 'condensed' AND nc = 0 OR first_row > last_row
   UNION ALL SELECT DISTINCT 'orphan-child', p.session_id, p.summary_id FROM bad_provenance p JOIN bad_summaries s ON s.session_id = p.session_id AND s.id = p.summary_id AND s.status = 'committed'
     WHERE p.child_type = 'summary' AND NOT EXISTS (SELECT 1 FROM bad_summaries x WHERE x.session_id = p.session_id AND x.id = p.child_id)
   UNION ALL SELECT 'duplicate-span', session_id, id FROM (SELECT *, count(*) OVER (PARTITION BY session_id, first_entry_id, last_entry_id, kind) AS n FROM bad_summaries) q WHERE n > 1
   UNION ALL SELECT 'dead-run', session_id, id FROM bad_summaries WHERE status = 'pending')"""


@query(
    "i01_i08_findings",
    _FOUND
    + """, o AS (SELECT kind, concat(session_id, '#', id) AS node, row_number() OVER (PARTITION BY kind ORDER BY concat(session_id, '#', id)) AS k, count(*) OVER (PARTITION BY kind) AS n FROM f)
 SELECT kind, 'error' AS severity, n, string_agg(node, ',' ORDER BY node) FILTER (k <= 10) AS sample FROM o GROUP BY kind, n""",
)
def found(spark, d):
    """The graph is checkpointed first, so its views are computed once."""
    m, s, p = map(D.cut_lineage, _graph(spark, d, bad=True))
    return I.findings(s, m, p, spark.createDataFrame([("open",)], "run string"))


@query("i09_drop_orphan_spans", f"WITH e AS ({_BAD_ENDS}) SELECT session_id, id FROM e WHERE first_row IS NOT NULL AND last_row IS NOT NULL OR status <> 'committed'")
def orphan_spans(spark, d):
    m, s, _ = _graph(spark, d, bad=True)
    return I.drop_orphan_spans(s, m).select("session_id", "id")


@query(
    "i10_dedupe_spans",
    """WITH n AS (SELECT s.*, (SELECT count(*) FROM bad_provenance p WHERE p.session_id = s.session_id AND p.summary_id = s.id) AS edges FROM bad_summaries s)
       SELECT session_id, id FROM (SELECT *, row_number() OVER (PARTITION BY session_id, first_entry_id, last_entry_id, kind ORDER BY edges DESC, id DESC) AS k FROM n) q WHERE k = 1""",
)
def dedupe(spark, d):
    _, s, p = _graph(spark, d, bad=True)
    return I.dedupe_spans(s, p).select("session_id", "id")


@query(
    "i11_orphan_fixpoint",
    """WITH RECURSIVE lost AS (
         SELECT DISTINCT p.session_id, p.summary_id AS id FROM bad_provenance p WHERE p.child_type = 'summary' AND NOT EXISTS (SELECT 1 FROM bad_summaries x WHERE x.session_id = p.session_id AND x.id = p.child_id)
         UNION SELECT p.session_id, p.summary_id FROM lost l JOIN bad_provenance p ON p.session_id = l.session_id AND p.child_type = 'summary' AND p.child_id = l.id)
       SELECT session_id, id FROM bad_summaries s WHERE NOT EXISTS (SELECT 1 FROM lost l WHERE l.session_id = s.session_id AND l.id = s.id)""",
)
def fixpoint(spark, d):
    _, s, p = _graph(spark, d, bad=True)
    return I.drop_orphan_parents(s, p).select("session_id", "id")


@query(
    "i11_orphan_fixpoint_deep",
    """WITH RECURSIVE lost AS (
         SELECT p.session_id, p.summary_id AS id FROM chain_provenance p JOIN chain_summaries s ON s.session_id = p.session_id AND s.id = p.summary_id AND s.status = 'committed' WHERE p.child_id = 0
         UNION SELECT p.session_id, p.summary_id FROM lost l JOIN chain_provenance p ON p.session_id = l.session_id AND p.child_id = l.id JOIN chain_summaries s ON s.session_id = p.session_id AND s.id = p.summary_id AND s.status = 'committed')
       SELECT session_id, id FROM chain_summaries s WHERE NOT EXISTS (SELECT 1 FROM lost l WHERE l.session_id = s.session_id AND l.id = s.id)""",
)
def fixpoint_deep(spark, d):
    """Chains of up to 40 nodes whose last child is missing in some sessions; an open node ends the loss."""
    return I.drop_orphan_parents(view(spark, d, "chain_summaries"), view(spark, d, "chain_provenance")).select("session_id", "id")


@query("i12_commit_run", "SELECT session_id, id, CASE WHEN run = 'dead' THEN 'committed' ELSE status END AS status, CAST(NULL AS VARCHAR) AS run FROM bad_summaries")
def commit(spark, d):
    """The run's pending rows become everyone's; its orphans are reaped no more."""
    _, s, _ = _graph(spark, d, bad=True)
    return I.commit_run(s, "dead").select("session_id", "id", "status", "run")


@query("i12_reap_pending", "SELECT session_id, id FROM bad_summaries WHERE status <> 'pending'")
def reap(spark, d):
    _, s, _ = _graph(spark, d, bad=True)
    return I.reap_pending(s, spark.createDataFrame([("open",)], "run string")).select("session_id", "id")
