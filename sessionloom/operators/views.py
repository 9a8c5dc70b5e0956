"""Views for many sessions at once: node descriptions, file manifests, histories, spans and final texts."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sessionloom.functions.redact import redact
from sessionloom.operators import dag as D
from sessionloom.operators.search import order_by_overlap


def files_of_summaries(provenance: DataFrame, message_files: DataFrame) -> DataFrame:
    """(session_id, id, file_id): files linked to a node's messages, inherited by every node above."""
    edges = D.covered_edges(provenance, D.closure(provenance))
    return edges.join(message_files, ["session_id", "row_id"]).select("session_id", F.col("node").alias("id"), "file_id").distinct()


def describe(summaries: DataFrame, messages: DataFrame, provenance: DataFrame, message_files: DataFrame) -> DataFrame:
    """Every node with kind, depth, quality, ends and its text (the thorough one first) where ``summaries`` have them, its costs, parents, children and number of files."""
    files = files_of_summaries(provenance, message_files).groupBy("session_id", "id").agg(F.count("*").alias("files"))
    joined = D.node_costs(summaries, messages, provenance).join(D.parents_and_children(provenance, summaries), ["session_id", "id"]).join(files, ["session_id", "id"], "left")
    own = [F.col(c) for c in ("kind", "depth", "quality", "first_entry_id", "last_entry_id", "tokens") if c in summaries.columns]
    if "text" in summaries.columns:
        own.append((F.coalesce("thorough_text", "text") if "thorough_text" in summaries.columns else F.col("text")).alias("text"))
    return joined.na.fill(0, ["files"]).join(summaries.select("session_id", "id", *own), ["session_id", "id"])


def history(frontier: DataFrame, question: str, most: int, costs: DataFrame | None = None) -> DataFrame:
    """The nodes of each session that share most words with the question, how many are left out, and what they cost where ``costs`` (as of ``node_costs``) are given."""
    placed = order_by_overlap(frontier, question)
    n = F.count("*").over(Window.partitionBy("session_id"))
    kept = placed.withColumn("omitted", F.greatest(n - most, F.lit(0))).filter(F.col("place") <= most)
    return kept if costs is None else kept.join(costs, ["session_id", "id"], "left")


def files_manifest(messages: DataFrame, message_files: DataFrame, covered: DataFrame, least: int = 32_000) -> DataFrame:
    """By session: distinct linked files, those no covered message (session_id, row_id) links, and large texts without a file."""
    of_covered = message_files.join(covered.select("session_id", "row_id"), ["session_id", "row_id"], "left_semi").select("session_id", "file_id").distinct().withColumn("seen", F.lit(1))
    files = message_files.select("session_id", "file_id").distinct().join(of_covered, ["session_id", "file_id"], "left")
    counts = files.groupBy("session_id").agg(F.count("*").alias("files"), F.count_if(F.col("seen").isNull()).alias("uncovered"))
    large = large_inline(messages, message_files, least).groupBy("session_id").agg(F.count("*").alias("large_inline"))
    return counts.join(large, "session_id", "full").na.fill(0, ["files", "uncovered", "large_inline"])


def large_inline(messages: DataFrame, message_files: DataFrame, least: int = 32_000) -> DataFrame:
    return messages.filter(F.length("text") >= least).join(message_files, ["session_id", "row_id"], "left_anti").select("session_id", "row_id")


def boundary_covered(frontier: DataFrame, spans: DataFrame) -> DataFrame:
    """(session_id, covered): whether the newest node of the frontier ends where the aged span does."""
    last = frontier.groupBy("session_id").agg(F.max_by("last_entry_id", "position").alias("reached"))
    return spans.join(last, "session_id", "left").select("session_id", F.coalesce(F.col("reached") == F.col("last_entry_id"), F.lit(False)).alias("covered"))


def compaction_spans(entries: DataFrame, marks: DataFrame) -> DataFrame:
    """Rows from the previous first-kept entry to the new one, without compaction rows.

    Where the previous one is unknown the span starts after the last compaction row.
    """
    at = lambda c: F.max(F.when(F.col("entry_id") == F.col(c), F.col("pos"))).alias(f"{c}_pos")
    joined = entries.join(marks, "session_id")
    ends = joined.groupBy("session_id").agg(at("previous"), at("kept"), F.max(F.when(F.col("compaction"), F.col("pos"))).alias("last_mark"))
    start = F.coalesce("previous_pos", F.col("last_mark") + 1, F.lit(0))
    return entries.join(ends, "session_id").filter((F.col("pos") >= start) & (F.col("pos") < F.col("kept_pos")) & ~F.col("compaction")).select("session_id", "pos")


def final_text(rendered: DataFrame, previous: DataFrame, target: int) -> DataFrame:
    """The rendered history behind the previous summary where it starts with the span; above twice the target it is cut to the target."""
    from sessionloom.functions.scalars import deterministic_truncate, estimate_tokens

    joined = rendered.join(previous, "session_id", "left")
    text = F.concat_ws("\n\n", "previous", "rendered")
    return joined.select("session_id", F.when(estimate_tokens(text) > 2 * target, deterministic_truncate(text, target)).otherwise(text).alias("text"))


def reduce_lone(frontier: DataFrame, stored: DataFrame, provenance: DataFrame, told: DataFrame, target: int) -> DataFrame:
    """``stored`` summaries after frontiers of one node that is over twice the target were told again.

    ``told`` has (session_id, id, new_text, new_tokens, new_level). A new text of level 3 is mechanical, others keep the node's quality; it replaces the old one
    only as ``replace_if_smaller`` allows.
    """
    lone = frontier.groupBy("session_id").agg(F.count("*").alias("n"), F.first("id").alias("id"), F.first("tokens").alias("held")).filter((F.col("n") == 1) & (F.col("held") > 2 * target))
    tries = told.join(lone.select("session_id", "id"), ["session_id", "id"]).join(stored.select("session_id", "id", "quality"), ["session_id", "id"])
    tries = tries.select("session_id", "id", "new_text", "new_tokens", F.when(F.col("new_level") == 3, "mechanical").otherwise(F.col("quality")).alias("new_quality"))
    return D.replaced_summaries(stored, tries, provenance)


def pass_outcome(messages: DataFrame, open_messages: DataFrame, leaves: DataFrame, condensed: DataFrame | None = None, ingested: DataFrame | None = None) -> DataFrame:
    """stored, covered or no-entries for every session, with the number of leaves, and of condensed nodes and ingested messages where these are given."""
    total = messages.groupBy("session_id").agg(F.count("*").alias("n"))
    left = open_messages.groupBy("session_id").agg(F.count("*").alias("open"))
    made = leaves.groupBy("session_id").agg(F.count("*").alias("leaves"))
    joined = total.join(left, "session_id", "left").join(made, "session_id", "left")
    more = [(name, df) for name, df in (("condensed", condensed), ("ingested", ingested)) if df is not None]
    for name, df in more:
        joined = joined.join(df.groupBy("session_id").agg(F.count("*").alias(name)), "session_id", "left")
    joined = joined.na.fill(0)
    some = F.col("leaves") + (F.col("condensed") if condensed is not None else F.lit(0)) > 0
    return joined.select("session_id", "leaves", *[name for name, _ in more], F.when(some, "stored").when(F.col("n") > 0, "covered").otherwise("no-entries").alias("outcome"))


def dangling_links(links: DataFrame, rows: DataFrame, files: DataFrame) -> DataFrame:
    """Links whose message or file is gone."""
    lost_rows = links.join(rows.select("session_id", "row_id"), ["session_id", "row_id"], "left_anti")
    return lost_rows.unionByName(links.join(files.select("file_id"), "file_id", "left_anti")).distinct()


def hash_problems(files: DataFrame) -> DataFrame:
    """Files (file_id, bytes, sha256, text) whose text has another length or digest."""
    return files.filter((F.length("text") != F.col("bytes")) | (F.sha2("text", 256) != F.col("sha256"))).select("file_id")


def replay(requests: DataFrame) -> DataFrame:
    """(session, pos, outcome, reason) of requests (session, pos, occupancy, swap, recut, model, window, tail, blocked).

    A request that crosses the swap line, or the recut line while a cut is pinned, tries a new cut: ``blocked`` says why
    it can't have one (``summary-missing`` kicks a summarizer, anything else bails), null that it swaps, which pins.
    ``tail`` says why a pinned cut no longer fits the messages; then the request bails and the pin is cleared. A change
    of model or window clears it before the request.

    Each row turns the pin on, off or around, or keeps it: what holds before a row is the last row that set it for
    sure, turned around once for every turning row since.
    """
    order = Window.partitionBy("session").orderBy("pos")
    changed = ~F.lag("model").over(order).eqNullSafe(F.col("model")) | ~F.lag("window").over(order).eqNullSafe(F.col("window"))
    rows = requests.withColumn("segment", F.sum(changed.cast("long")).over(order))
    pins, loose = F.coalesce(F.col("occupancy") >= F.col("swap"), F.lit(False)) & F.col("blocked").isNull(), F.col("tail").isNotNull()
    rows = rows.withColumn("sets", F.when(pins & ~loose, True).when(~pins & loose, False)).withColumn("turns", (pins & loose).cast("long"))
    inside = Window.partitionBy("session", "segment").orderBy("pos").rowsBetween(Window.unboundedPreceding, -1)
    rows = rows.withColumn("turned", F.sum("turns").over(inside.rowsBetween(Window.unboundedPreceding, 0)))
    last = F.last(F.when(F.col("sets").isNotNull(), F.struct("sets", "turned")), ignorenulls=True).over(inside)
    rows = rows.withColumn("last", last)
    since = F.coalesce("turned", F.lit(0)) - F.col("turns") - F.coalesce("last.turned", F.lit(0))
    pinned = F.coalesce("last.sets", F.lit(False)) != (since % 2 == 1)
    tries = F.when(pinned, F.col("occupancy") >= F.col("recut")).otherwise(F.col("occupancy") >= F.col("swap"))
    outcome = F.when(pinned & loose, "bail").when(~tries, F.when(pinned, "reapply").otherwise("quiet")).when(F.col("blocked") == "summary-missing", "kick").when(F.col("blocked").isNotNull(), "bail").otherwise("swap")
    reason = F.when(pinned & loose, F.col("tail")).when(tries, F.col("blocked"))
    return rows.select("session", "pos", outcome.alias("outcome"), reason.alias("reason"))


def slice_end(text: str, start: int, most: int) -> int:
    """Where the slice from ``start`` of at most ``most`` characters ends: behind the last paragraph, line, sentence or word that begins in its last twentieth or at its limit, never inside a line break."""
    limit = min(len(text), start + most)
    if limit == len(text):
        return limit
    low = start + most * 95 // 100
    for sign in ("\n\n", "\n", ". ", " "):
        at = text.rfind(sign, low, limit + len(sign))
        if at >= 0:
            return min(limit, at + len(sign))
    inside = text[limit - 1] == "\r" and text[limit] == "\n" and limit - 1 > start
    return limit - 1 if inside else limit


def slices(text: str, most: int) -> Iterator[tuple[int, int]]:
    at = 0
    while at < len(text):
        end = slice_end(text, at, most)
        yield at, end
        at = end


def heal_windows(texts: DataFrame, most_chars: int, most_windows: int | None = None) -> DataFrame:
    """(node, item, part, start, end, window): slices of the texts (node, item, text) of each node, packed in order into as many windows of ``most_chars`` as these need.

    A slice that doesn't fit into the current window begins the next. Only where ``most_windows`` is given has a node that needs more
    none. Null and empty texts have no slices, nor have those of no node.

    Texts are cut where they stand; only the places of their slices are brought together by node, and stream through in order while the window's fill is held,
    so a node may be of any size.

    Nodes are dealt by a hash of their own: a shuffle by the node itself is dropped behind a join by node, and where that join turns
    into a broadcast one at run time its rows stand as they were read, a node's in several tasks.

    Texts (node, text) without items stand alone: each slice is a window, (node, window, start, end), however many there are.
    """
    some = texts.filter(F.length("text") > 0)
    kind = some.schema["node"].dataType.simpleString()

    def alone(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = [(node, n, at, end) for node, text in zip(pdf["node"], pdf["text"], strict=True) for n, (at, end) in enumerate(slices(text, most_chars))]
            yield pd.DataFrame(rows, columns=["node", "window", "start", "end"])

    if "item" not in texts.columns:
        return some.select("node", "text").mapInPandas(alone, f"node {kind}, window long, start long, end long")

    def cut(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = [(node, item, part, at, end) for node, item, text in zip(pdf["node"], pdf["item"], pdf["text"], strict=True) for part, (at, end) in enumerate(slices(text, most_chars))]
            yield pd.DataFrame(rows, columns=["node", "item", "part", "start", "end"])

    def pack(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        last, window, fill = None, 0, 0
        for pdf in batches:
            windows = []
            for node, chars in zip(pdf["node"], pdf["end"] - pdf["start"], strict=True):
                if node != last:
                    last, window, fill = node, 0, 0
                if fill and fill + chars > most_chars:
                    window, fill = window + 1, 0
                fill += chars
                windows.append(window)
            yield pdf.assign(window=windows)

    places = f"node {kind}, item long, part long, start long, end long"
    parts = some.filter(F.col("node").isNotNull()).select("node", "item", "text").mapInPandas(cut, places)
    found = parts.repartition(F.xxhash64("node")).sortWithinPartitions("node", "item", "part").mapInPandas(pack, f"{places}, window long")
    if most_windows is None:
        return found
    many = found.filter(F.col("window") >= most_windows).select("node").distinct()
    return found.join(many, "node", "left_anti")


def heal_items(summaries: DataFrame, messages: DataFrame, provenance: DataFrame, redactor: Callable[[Column], Column] | None = None) -> DataFrame:
    """(session_id, id, kind, place, role, text, unclean): what a node is derived from again, one row for each edge, in order.

    A leaf reads its messages, redacted, or their file's preview where ``messages`` have one; a condensed node reads its children as they are now. The
    text of a missing source is null.
    """
    nodes = summaries.select("session_id", "id", "kind")
    edges = provenance.withColumnRenamed("summary_id", "id").join(nodes, ["session_id", "id"])
    body = F.coalesce("preview", "text") if "preview" in messages.columns else F.col("text")
    rows = messages.select("session_id", F.lit("message").alias("child_type"), F.col("row_id").alias("child_id"), F.col("row_id").alias("place"), "role", redact(body, redactor=redactor).alias("text"), F.lit(False).alias("unclean"))
    starts = D.with_rows(summaries, messages).select("session_id", F.lit("summary").alias("child_type"), F.col("id").alias("child_id"), F.coalesce("first_row", F.lit(0)).alias("place"), F.lit("summary").alias("role"), "text", (F.col("quality") != "clean").alias("unclean"))
    wanted = edges.filter((F.col("kind") == "leaf") == (F.col("child_type") == "message"))
    return wanted.join(rows.unionByName(starts), ["session_id", "child_type", "child_id"], "left").select("session_id", "id", "kind", "place", "child_id", "role", "text", "unclean")


def heal_sources(summaries: DataFrame, messages: DataFrame, provenance: DataFrame, max_chars: int, most_windows: int = 8, redactor: Callable[[Column], Column] | None = None) -> DataFrame:
    """session_id, id, problem, source_quality, source_chars, source_tokens and windows of every node's source.

    ``no-source``: it names nothing; ``source-missing``: something that it names is gone. A condensed source is clean, or derived where a child isn't clean. A
    leaf's is clean if it fits ``max_chars`` or ``most_windows`` exact windows of these, whose number is told; else it is clipped. Texts are only
    brought together for leaves beyond one window, and never in one row.
    """
    key = ["session_id", "id"]
    items = heal_items(summaries, messages, provenance, redactor)
    facts = items.groupBy(*key).agg(F.count("*").alias("named"), F.count("text").alias("found"), F.coalesce(F.sum(F.length("text")), F.lit(0)).alias("source_chars"), F.max(F.coalesce("unclean", F.lit(False))).alias("unclean"))
    facts = D.cut_lineage(summaries.select(*key, "kind").join(facts, key, "left").na.fill(0, ["named", "found", "source_chars"]))
    large = facts.filter((F.col("kind") == "leaf") & (F.col("source_chars") > max_chars) & (F.col("found") == F.col("named")))
    texts = items.join(large.select(*key), key, "left_semi").select(F.to_json(F.struct(*key)).alias("node"), F.col("place").alias("item"), "text")
    windows = heal_windows(texts, max_chars, most_windows).groupBy("node").agg((F.max("window") + 1).alias("windows"))
    windows = windows.select(*[F.from_json("node", "session_id string, id long")[c].alias(c) for c in key], "windows")
    problem = F.when(F.col("named") == 0, "no-source").when(F.col("found") < F.col("named"), "source-missing")
    fits = (F.col("source_chars") <= max_chars) | F.col("windows").isNotNull()
    quality = F.when(F.col("kind") == "leaf", F.when(fits, "clean").otherwise("clipped")).otherwise(F.when(F.col("unclean"), "derived").otherwise("clean"))
    told = facts.join(windows, key, "left").withColumn("problem", problem)
    whole = F.col("problem").isNull()
    return told.select(*key, "problem", F.when(whole, quality).alias("source_quality"), F.when(whole, F.col("source_chars")).alias("source_chars"), F.when(whole, F.ceil(F.col("source_chars") / 4)).alias("source_tokens"), F.when(whole, F.col("windows")).alias("windows"))
