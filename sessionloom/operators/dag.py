"""The summary graph of many sessions: spans, coverage, closure, frontier, and rows derived from them.

Every join has ``session_id`` among its keys; ranges are only compared within a session.
"""

from __future__ import annotations

import tempfile

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

def shared_folder(spark: SparkSession) -> str:
    """The folder that ``spark.checkpoint.dir`` names; a temporary one where that is unset in local mode, an error on a cluster."""
    conf = spark.sparkContext.getConf()
    folder = conf.get("spark.checkpoint.dir", None)
    if folder:
        return folder.rstrip("/")
    if not conf.get("spark.master", "").startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    return f"file://{tempfile.mkdtemp(prefix='sessionloom-')}"


def cut_lineage(df: DataFrame) -> DataFrame:
    """``df`` checkpointed in the shared folder."""
    context = df.sparkSession.sparkContext
    if not context.getCheckpointDir():
        context.setCheckpointDir(shared_folder(df.sparkSession))
    return df.checkpoint()


def visible(run: str | None = None) -> Column:
    """Committed nodes, and those of the given open run."""
    committed = F.col("status") == "committed"
    return committed if run is None else committed | (F.col("run") == run)


def with_rows(summaries: DataFrame, messages: DataFrame) -> DataFrame:
    """Summaries with ``first_row`` and ``last_row``; null where an end is not in the log."""
    rows = messages.select("session_id", "entry_id", "row_id")
    first = rows.select("session_id", F.col("entry_id").alias("first_entry_id"), F.col("row_id").alias("first_row"))
    last = rows.select("session_id", F.col("entry_id").alias("last_entry_id"), F.col("row_id").alias("last_row"))
    return summaries.join(first, ["session_id", "first_entry_id"], "left").join(last, ["session_id", "last_entry_id"], "left")


def span_bounds(messages: DataFrame, wanted: DataFrame) -> DataFrame:
    """Oldest and newest of the wanted (session_id, entry_id)."""
    found = messages.join(wanted.select("session_id", "entry_id"), ["session_id", "entry_id"], "left_semi")
    return found.groupBy("session_id").agg(F.min_by("entry_id", "row_id").alias("first_entry_id"), F.max_by("entry_id", "row_id").alias("last_entry_id"))


def messages_in_spans(spans: DataFrame, messages: DataFrame, key: str, bucket: int = 1000) -> DataFrame:
    """Messages of each span, by row range; a span with an unknown end has none.

    Spans are spread over buckets of ``bucket`` rows, so the join has equal keys only and a long session is cut.
    """
    ends = with_rows(spans, messages).filter("first_row is not null and last_row is not null and first_row <= last_row")
    cut = lambda c: F.floor(F.col(c) / bucket)
    spread = ends.select("session_id", key, "first_row", "last_row", F.explode(F.sequence(cut("first_row"), cut("last_row"))).alias("bucket"))
    rows = messages.select("session_id", "row_id", "entry_id", "role", "text", "tokens").withColumn("bucket", cut("row_id"))
    met = spread.join(rows, ["session_id", "bucket"]).filter(F.col("row_id").between(F.col("first_row"), F.col("last_row")))
    return met.drop("bucket", "first_row", "last_row")


def uncovered(messages: DataFrame, provenance: DataFrame, summaries: DataFrame, run: str | None = None) -> DataFrame:
    """Messages that no visible summary names."""
    seen = summaries.filter(visible(run)).select("session_id", F.col("id").alias("summary_id"))
    edges = provenance.filter("child_type = 'message'").join(seen, ["session_id", "summary_id"], "left_semi")
    return messages.join(edges.select("session_id", F.col("child_id").alias("row_id")), ["session_id", "row_id"], "left_anti")


def covering_leaf(messages: DataFrame, provenance: DataFrame, summaries: DataFrame, run: str | None = None) -> DataFrame:
    """(session_id, row_id, summary_id): the visible parent of least depth, the newest of these."""
    nodes = summaries.filter(visible(run)).select("session_id", F.col("id").alias("summary_id"), "depth")
    edges = provenance.filter("child_type = 'message'").select("session_id", "summary_id", F.col("child_id").alias("row_id"))
    found = edges.join(nodes, ["session_id", "summary_id"]).join(messages.select("session_id", "row_id"), ["session_id", "row_id"], "left_semi")
    order = F.struct(-F.col("depth"), F.col("summary_id"))
    return found.groupBy("session_id", "row_id").agg(F.max_by("summary_id", order).alias("summary_id"))


def closure(provenance: DataFrame) -> DataFrame:
    """(session_id, node, child): all nodes at or below each node, ends of cycles included once.

    Rounds double the length of paths until nothing new is found, whatever the depth; ids alone take part.
    """
    edges = provenance.filter("child_type = 'summary'").select("session_id", F.col("summary_id").alias("node"), F.col("child_id").alias("child"))
    own = provenance.select("session_id", F.col("summary_id").alias("node"), F.col("summary_id").alias("child"))
    paths = cut_lineage(edges.unionByName(own).distinct())
    size, now = -1, paths.count()
    while now != size:
        step = paths.select("session_id", F.col("node").alias("child"), F.col("child").alias("far"))
        longer = paths.join(step, ["session_id", "child"]).select("session_id", "node", F.col("far").alias("child"))
        paths = cut_lineage(paths.unionByName(longer).distinct())
        size, now = now, paths.count()
    return paths


def above(seeds: DataFrame, edges: DataFrame, longest: int = 16) -> DataFrame:
    """(session_id, id): the seeds and every node above one, out of edges (session_id, id, parent).

    Only sessions with a seed take part. Steps go upwards from what is new only, so rows follow the part above the seeds. Where three steps
    don't reach the end, shortcuts of exactly 2, 4, ... up to ``longest`` edges are made, in a chain no more of each than edges; the longest
    are taken until nothing is new, then each shorter kind once from all that was seen, which makes up every distance. Cycles end.
    """
    key = ["session_id", "id"]
    seen = new = cut_lineage(seeds.select(*key).distinct())
    own = edges.select(*key, "parent").filter("parent is not null").join(seen.select("session_id").distinct(), "session_id", "left_semi")
    kinds = [cut_lineage(own.distinct())]

    def step(some: DataFrame, by: DataFrame, seen: DataFrame) -> DataFrame:
        up = some.join(by, key).select("session_id", F.col("parent").alias("id")).distinct()
        return cut_lineage(up.join(seen, key, "left_anti"))

    for _ in range(3):
        new = step(new, kinds[0], seen)
        if new.isEmpty():
            return seen
        seen = seen.unionByName(new)
    while 2 ** len(kinds) <= longest:
        far = kinds[-1].select("session_id", F.col("id").alias("parent"), F.col("parent").alias("far"))
        longer = cut_lineage(kinds[-1].join(far, ["session_id", "parent"]).select(*key, F.col("far").alias("parent")).distinct())
        if longer.isEmpty():
            break
        kinds.append(longer)
    new = seen
    while not (new := step(new, kinds[-1], seen)).isEmpty():
        seen = seen.unionByName(new)
    for by in reversed(kinds[:-1]):
        seen = seen.unionByName(step(seen, by, seen))
    return seen


def covered_edges(provenance: DataFrame, paths: DataFrame) -> DataFrame:
    """(session_id, node, summary_id, row_id): the message edges below each node, each once."""
    leaves = provenance.filter("child_type = 'message'").select("session_id", F.col("summary_id").alias("child"), F.col("child_id").alias("row_id"))
    return paths.join(leaves, ["session_id", "child"]).select("session_id", "node", F.col("child").alias("summary_id"), "row_id").distinct()


def covered_size(messages: DataFrame, edges: DataFrame) -> DataFrame:
    """Messages and tokens below each node; a message under two leaves counts twice."""
    joined = edges.join(messages.select("session_id", "row_id", "tokens"), ["session_id", "row_id"])
    return joined.groupBy("session_id", "node").agg(F.count("*").alias("messages"), F.sum("tokens").alias("tokens"))


def frontier(summaries: DataFrame, messages: DataFrame, provenance: DataFrame, run: str | None = None) -> DataFrame:
    """The smallest top-level cover of each session, in order.

    Of visible nodes without a visible parent, ordered by start, longer and deeper ones first, those stay that reach
    beyond every earlier one.
    """
    nodes = with_rows(summaries.filter(visible(run)), messages).filter("first_row is not null and last_row is not null")
    parents = provenance.filter("child_type = 'summary'").join(nodes.select("session_id", F.col("id").alias("summary_id")), ["session_id", "summary_id"], "left_semi")
    top = nodes.join(parents.select("session_id", F.col("child_id").alias("id")), ["session_id", "id"], "left_anti")
    order = Window.partitionBy("session_id").orderBy(F.asc("first_row"), F.desc("last_row"), F.desc("depth"), F.desc("id"))
    reach = F.max("last_row").over(order.rowsBetween(Window.unboundedPreceding, -1))
    kept = top.withColumn("reach", reach).filter(F.col("last_row") > F.coalesce("reach", F.lit(-1)))
    return kept.drop("reach").withColumn("position", F.row_number().over(order).cast("long"))


def parents_and_children(provenance: DataFrame, summaries: DataFrame, run: str | None = None) -> DataFrame:
    """(session_id, id, parents, children): visible parents and children of every node, ascending."""
    seen = summaries.filter(visible(run)).select("session_id", "id")
    edges = provenance.filter("child_type = 'summary'").select("session_id", "summary_id", "child_id")
    edges = edges.join(seen.withColumnRenamed("id", "summary_id"), ["session_id", "summary_id"], "left_semi")
    up = edges.groupBy("session_id", F.col("child_id").alias("id")).agg(F.sort_array(F.collect_set("summary_id")).alias("parents"))
    down = edges.groupBy("session_id", F.col("summary_id").alias("id")).agg(F.sort_array(F.collect_set("child_id")).alias("children"))
    return seen.join(up, ["session_id", "id"], "left").join(down, ["session_id", "id"], "left")


def merge_summaries(stored: DataFrame, new: DataFrame) -> DataFrame:
    """New summaries whose (first, last, kind) neither a stored nor an earlier new one holds."""
    key = ["session_id", "first_entry_id", "last_entry_id", "kind"]
    first = Window.partitionBy(*key).orderBy("id")
    return new.withColumn("n", F.row_number().over(first)).filter("n = 1").drop("n").join(stored.select(*key), key, "left_anti")


def replace_if_smaller(stored: DataFrame, attempts: DataFrame, provenance: DataFrame) -> DataFrame:
    """Attempts (session_id, id, new_tokens, new_quality) with ``replaced``.

    A parentless node gives way to a text of at most three quarters of its tokens, never a clean one to another
    quality, nor one that was not mechanical to a mechanical one.
    """
    child = provenance.filter("child_type = 'summary'").select("session_id", F.col("child_id").alias("id")).distinct().withColumn("has_parent", F.lit(True))
    both = attempts.join(stored.select("session_id", "id", "tokens", "quality"), ["session_id", "id"]).join(child, ["session_id", "id"], "left")
    worse = (F.col("quality") == "clean") & (F.col("new_quality") != "clean") | (F.col("quality") != "mechanical") & (F.col("new_quality") == "mechanical")
    fits = (F.col("tokens") > 0) & (F.col("new_tokens") <= 0.75 * F.col("tokens"))
    return both.withColumn("replaced", fits & F.col("has_parent").isNull() & ~worse).drop("has_parent")


def replaced_summaries(stored: DataFrame, attempts: DataFrame, provenance: DataFrame) -> DataFrame:
    """``stored`` (with text and thorough_text) after the attempts (as for ``replace_if_smaller``, with new_text); a replaced text becomes the thorough one where there is none."""
    taken = replace_if_smaller(stored, attempts, provenance).filter("replaced").select("session_id", "id", "new_text", "new_tokens", "new_quality", "replaced")
    both = stored.join(taken, ["session_id", "id"], "left")
    hit = F.coalesce("replaced", F.lit(False))
    new = {"thorough_text": F.when(hit, F.coalesce("thorough_text", "text")).otherwise(F.col("thorough_text"))}
    new |= {c: F.when(hit, F.col(f"new_{c}")).otherwise(F.col(c)) for c in ("text", "tokens", "quality")}
    return both.select(*[new.get(c, F.col(c)).alias(c) for c in stored.columns])


def store_stats(messages: DataFrame, summaries: DataFrame, files: DataFrame | None = None) -> DataFrame:
    """Messages, tokens, removed messages and summaries of each session; payloads and their bytes where messages have a ``payload``, files and their bytes where these (session_id, bytes) are given."""
    payloads = [F.count("payload").alias("payloads"), F.coalesce(F.sum(F.octet_length("payload")), F.lit(0)).cast("long").alias("payload_bytes")] if "payload" in messages.columns else []
    m = messages.groupBy("session_id").agg(F.count("*").alias("messages"), F.sum("tokens").alias("tokens"), F.count("removed_at_ms").alias("removed"), *payloads)
    s = summaries.groupBy("session_id").agg(F.count("*").alias("summaries"))
    both = m.join(s, "session_id", "left").na.fill(0, ["summaries"])
    if files is None:
        return both
    f = files.groupBy("session_id").agg(F.count("*").alias("files"), F.sum("bytes").alias("file_bytes"))
    return both.join(f, "session_id", "left").na.fill(0, ["files", "file_bytes"])


def depth_stats(summaries: DataFrame) -> DataFrame:
    return summaries.groupBy("depth").agg(F.count("*").alias("n"), F.sum("tokens").alias("tokens"), F.round(F.avg("tokens")).cast("long").alias("average"))


def node_costs(summaries: DataFrame, messages: DataFrame, provenance: DataFrame) -> DataFrame:
    """For each node the tokens and messages that it stands for, and its own and its children's tokens."""
    sizes = covered_size(messages, covered_edges(provenance, closure(provenance))).select("session_id", F.col("node").alias("id"), F.col("messages"), F.col("tokens").alias("source_tokens"))
    child = provenance.filter("child_type = 'summary'").join(summaries.select("session_id", F.col("id").alias("child_id"), F.col("tokens").alias("child_tokens")), ["session_id", "child_id"])
    below = child.groupBy("session_id", F.col("summary_id").alias("id")).agg(F.sum("child_tokens").alias("below"))
    joined = summaries.select("session_id", "id", "tokens").join(sizes, ["session_id", "id"], "left").join(below, ["session_id", "id"], "left")
    zero = lambda c: F.coalesce(F.col(c), F.lit(0))
    return joined.select("session_id", "id", zero("messages").alias("messages"), zero("source_tokens").alias("source_tokens"), (F.col("tokens") + zero("below")).alias("subtree_tokens"))


def ordered_sources(summaries: DataFrame, messages: DataFrame, provenance: DataFrame) -> DataFrame:
    """(session_id, summary_id, place, child_type, child_id): messages by row, children by where their span starts."""
    starts = with_rows(summaries, messages).select("session_id", F.lit("summary").alias("child_type"), F.col("id").alias("child_id"), F.col("first_row").alias("at"))
    rows = messages.select("session_id", F.lit("message").alias("child_type"), F.col("row_id").alias("child_id"), F.col("row_id").alias("at"))
    joined = provenance.join(starts.unionByName(rows), ["session_id", "child_type", "child_id"], "left")
    order = Window.partitionBy("session_id", "summary_id").orderBy(F.asc_nulls_last("at"), "child_id")
    return joined.select("session_id", "summary_id", (F.row_number().over(order) - 1).cast("long").alias("place"), "child_type", "child_id")
