"""Compaction: chunking of uncovered messages, leaves, condensation groups, escalation and rendering."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import reduce
from typing import NamedTuple

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sessionloom.functions import redact as R
from sessionloom.functions import scalars as S
from sessionloom.operators.dag import cut_lineage

CHUNK_TOKENS, MOST_CHUNKS, MOST_FANOUT, MOST_DEPTH, LEAF_TOKENS = 3000, 24, 8, 8, 512
PREFIX = f"{S.MARK}truncated]\n"


def islands(messages: DataFrame) -> DataFrame:
    """``island``: the same for rows that follow each other without a gap."""
    order = Window.partitionBy("session_id").orderBy("row_id")
    return messages.withColumn("island", F.col("row_id") - F.row_number().over(order))


def chunk_contiguous(messages: DataFrame, budget: int = CHUNK_TOKENS) -> DataFrame:
    """(session_id, row_id, chunk): adjacent rows while their tokens fit; a larger row is a chunk of its own, an unknown number counts as 0.

    The running sum starts anew at each chunk, which no window can express: (row_id, tokens), without texts, are sorted
    by island and stream through a function that holds the sum only, so a long session needs no more memory than a short one.
    """

    def cut(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        group, total, first = None, 0, 0
        for pdf in batches:
            starts = []
            for session, island, row, tokens in zip(pdf["session_id"], pdf["island"], pdf["row_id"], pdf["tokens"], strict=True):
                if (session, island) != group or total + tokens > budget:
                    group, first, total = (session, island), row, 0
                total += tokens
                starts.append(first)
            yield pdf.assign(start=starts)[["session_id", "row_id", "start"]]

    rows = islands(messages).select("session_id", "island", "row_id", F.coalesce("tokens", F.lit(0)).alias("tokens"))
    dealt = rows.repartition("session_id", "island").sortWithinPartitions("session_id", "island", "row_id")
    found = dealt.mapInPandas(cut, "session_id string, row_id long, start long")
    order = Window.partitionBy("session_id").orderBy("start")
    return found.select("session_id", "row_id", (F.dense_rank().over(order) - 1).cast("long").alias("chunk"))


def merge_chunks(chunked: DataFrame, most: int = MOST_CHUNKS) -> DataFrame:
    """At most ``most`` chunks a session: neighbours join in equal groups."""
    n = F.max("chunk").over(Window.partitionBy("session_id")) + 1
    group = F.when(n > most, F.ceil(n / most)).otherwise(F.lit(1))
    return chunked.withColumn("chunk", F.floor(F.col("chunk") / group).cast("long"))


def mechanical(messages: DataFrame, tools: list[str]) -> DataFrame:
    """``direct`` and ``mechanical``: rows of listed tools, and unnamed results right behind them."""
    name = S.tool_name(F.col("text"), F.col("role"))
    listed = F.array_contains(S.normalize_tools(F.array(*map(F.lit, tools))), name)
    order = Window.partitionBy("session_id").orderBy("row_id")
    marked = messages.withColumn("direct", F.coalesce(listed, F.lit(False))).withColumn("named", name.isNotNull())
    follows = (F.col("role") == "toolResult") & ~F.col("named") & F.coalesce(F.lag("direct").over(order), F.lit(False))
    return marked.withColumn("mechanical", F.col("direct") | follows).drop("named")


def split_by_flag(chunked: DataFrame, flag: str = "mechanical") -> DataFrame:
    """Chunks cut again where the flag changes."""
    order = Window.partitionBy("session_id").orderBy("row_id")
    changes = (F.lag(flag).over(order) != F.col(flag)) | (F.lag("chunk").over(order) != F.col("chunk"))
    return chunked.withColumn("chunk", F.sum(F.coalesce(changes, F.lit(False)).cast("long")).over(order))


def source_block(columns: list[str], most_chars: int, redactor: Callable[[Column], Column] | None = None) -> Column:
    """What a summarizer reads of a message: ``[role]`` and its text, redacted whole and then clipped; a file's preview instead, where one is given."""
    body = S.clipped(R.redact(F.col("text"), redactor=redactor), most_chars)
    if "preview" in columns:
        body = F.coalesce(R.redact(F.col("preview"), redactor=redactor), body)
    return F.concat(F.lit("["), "role", F.lit("]\n"), body)


def leaf_sources(messages: DataFrame, chunked: DataFrame, most_tokens: int = CHUNK_TOKENS, redactor: Callable[[Column], Column] | None = None) -> DataFrame:
    """(session_id, chunk, first/last row, source, source_clipped): each chunk's messages as ``[role]`` blocks, long ones clipped.

    Rows that ``chunked`` marks as ``mechanical`` stay in the span but aren't read, unless all of a chunk's are; a source that
    leaves out anything is clipped.
    """
    flag = F.coalesce("mechanical", F.lit(False)) if "mechanical" in chunked.columns else F.lit(False)
    columns = ["role", "text", "tokens", "entry_id", *(["preview"] if "preview" in messages.columns else [])]
    joined = chunked.select("session_id", "row_id", "chunk", flag.alias("noisy")).join(messages.select("session_id", "row_id", *columns), ["session_id", "row_id"])
    joined = joined.withColumn("read", ~F.col("noisy") | ~F.max(~F.col("noisy")).over(Window.partitionBy("session_id", "chunk")))
    most = S.DEFAULT_CHARS_PER_TOKEN * most_tokens
    one, clipped = source_block(columns, most, redactor), F.length(R.redact(F.col("text"), redactor=redactor)) > most
    if "preview" in columns:
        clipped = clipped & F.col("preview").isNull()
    ordered = F.sort_array(F.collect_list(F.when(F.col("read"), F.struct("row_id", one.alias("one")))))
    return joined.groupBy("session_id", "chunk").agg(
        F.min("row_id").alias("first_row"),
        F.max("row_id").alias("last_row"),
        F.min_by("entry_id", "row_id").alias("first_entry_id"),
        F.max_by("entry_id", "row_id").alias("last_entry_id"),
        F.sum("tokens").alias("source_tokens"),
        F.array_join(F.transform(ordered, lambda x: x["one"]), "\n\n").alias("source"),
        F.max(~F.col("read") | clipped).alias("source_clipped"),
    )


def truncated_leaves(messages: DataFrame, chunked: DataFrame, most_tokens: int = CHUNK_TOKENS, tokens: int = LEAF_TOKENS) -> DataFrame:
    """What ``mechanical_leaves`` makes of ``leaf_sources``, without ever holding a chunk's texts together.

    Lengths tell where each message stands in its chunk's source; only those that reach into the kept head or tail join
    their texts, a bounded number whatever the chunk's size.
    """
    key, most = ["session_id", "row_id"], S.DEFAULT_CHARS_PER_TOKEN * tokens
    block = source_block(messages.columns, S.DEFAULT_CHARS_PER_TOKEN * most_tokens)
    sized = chunked.select(*key, "chunk").join(messages.select(*key, "tokens", "entry_id", F.length(block).cast("long").alias("size")), key)
    wholes = sized.groupBy("session_id", "chunk").agg(
        F.min("row_id").alias("first_row"),
        F.max("row_id").alias("last_row"),
        F.min_by("entry_id", "row_id").alias("first_entry_id"),
        F.max_by("entry_id", "row_id").alias("last_entry_id"),
        F.sum("tokens").alias("source_tokens"),
        F.coalesce(F.sum(F.col("size") + 2) - 2, F.lit(0)).alias("total"),
    )
    upto = Window.partitionBy("session_id", "chunk").orderBy("row_id").rowsBetween(Window.unboundedPreceding, 0)
    placed = sized.select(*key, "chunk", "size", (F.sum(F.col("size") + 2).over(upto) - 2).alias("end")).withColumn("start", F.col("end") - F.col("size"))
    near = placed.join(wholes.select("session_id", "chunk", "total"), ["session_id", "chunk"]).filter((F.col("start") < most) | (F.col("end") > F.col("total") - most))
    pieces = near.select(*key, "chunk", "start").join(messages.select(*key, block.alias("block")), key)
    held = pieces.groupBy("session_id", "chunk").agg(F.sort_array(F.collect_list(F.struct("row_id", "start", "block"))).alias("held"))
    joined = lambda parts: F.array_join(F.transform(parts, lambda x: x["block"]), "\n\n")
    head = F.left(joined(F.filter("held", lambda x: x["start"] < most)), F.lit(most * 7 // 10))
    cut = F.when(F.col("total") <= most, joined(F.col("held"))).otherwise(F.concat(head, F.lit(S.TRUNCATED), F.right(joined(F.col("held")), F.lit(most * 2 // 10))))
    text = F.concat(F.lit(PREFIX), F.coalesce(cut, F.lit("")))
    leaves = wholes.join(held, ["session_id", "chunk"], "left").withColumn("text", text).drop("held", "total")
    return leaves.withColumn("tokens", S.estimate_tokens(F.col("text"))).withColumn("quality", F.lit("mechanical")).withColumn("level", F.lit(3))


def mechanical_leaves(sources: DataFrame, tokens: int = LEAF_TOKENS) -> DataFrame:
    text = F.concat(F.lit(PREFIX), S.deterministic_truncate(F.col("source"), tokens))
    return sources.withColumn("text", text).withColumn("tokens", S.estimate_tokens(text)).withColumn("quality", F.lit("mechanical")).withColumn("level", F.lit(3))


def escalate(rows: DataFrame, target: int) -> DataFrame:
    """Which of the texts ``l1``, ``l2`` and the truncated ``source`` is kept, and at which level.

    The first answer counts if it is shorter than the source; above twice the target the second replaces it where
    shorter still. Without either the source is truncated.
    """
    t1, t2, ts = (S.estimate_tokens(F.col(c)) for c in ("l1", "l2", "source"))
    ok1, ok2 = F.coalesce(t1 < ts, F.lit(False)), F.coalesce(t2 < ts, F.lit(False))
    tighter = ok1 & (t1 > 2 * target) & F.coalesce(t2 < t1, F.lit(False))
    level = F.when(ok1 & ~tighter, 1).when(tighter | ok2, 2).otherwise(3)
    text = F.when(level == 1, F.col("l1")).when(level == 2, F.col("l2")).otherwise(F.concat(F.lit(PREFIX), S.deterministic_truncate(F.col("source"), target)))
    return rows.withColumn("level", level).withColumn("text", text).withColumn("thorough_text", F.when(tighter, F.col("l1")))


def leaf_quality(level: Column, clipped: Column) -> Column:
    return F.when(level == 3, "mechanical").when(clipped, "clipped").otherwise("clean")


def condensed_quality(level: Column, any_unclean_child: Column) -> Column:
    return F.when(level == 3, "mechanical").when(any_unclean_child, "derived").otherwise("clean")


def condensation_group(frontier: DataFrame, most_depth: int = MOST_DEPTH, fan_out: int = MOST_FANOUT) -> DataFrame:
    """The nodes of each session to condense next: of runs of equal depth the shallowest, oldest, its first ``fan_out``."""
    order = Window.partitionBy("session_id").orderBy("position")
    run = F.sum((F.lag("depth").over(order) != F.col("depth")).cast("long")).over(order)
    runs = frontier.withColumn("run_no", F.coalesce(run, F.lit(0)))
    inside = Window.partitionBy("session_id", "run_no")
    runs = runs.withColumn("length", F.count("*").over(inside)).withColumn("k", F.row_number().over(inside.orderBy("position")))
    fit = runs.filter((F.col("length") >= 2) & (F.col("depth") + 1 <= most_depth))
    first = fit.groupBy("session_id").agg(F.min_by("run_no", F.struct("depth", "run_no")).alias("run_no"))
    return fit.join(first, ["session_id", "run_no"]).filter(F.col("k") <= fan_out).drop("length", "k")


def stall_report(frontier: DataFrame, target: int, most_depth: int = MOST_DEPTH) -> DataFrame:
    """Sessions whose frontier is above the target, and why nothing more condenses."""
    sums = frontier.groupBy("session_id").agg(F.sum("tokens").alias("tokens"), F.min("depth").alias("min_depth"), F.count("*").alias("nodes"))
    reason = F.when(F.col("min_depth") + 1 > most_depth, "depth-cap").otherwise("no-same-depth-run")
    return sums.filter(F.col("tokens") > target).withColumn("reason", reason)


def header() -> Column:
    """The line above a node's text (id, depth, first_entry_id, last_entry_id)."""
    return F.concat(F.lit(f"{S.MARK}summary #"), F.col("id").cast("string"), F.lit(" depth "), F.col("depth").cast("string"), F.lit(" span "), "first_entry_id", F.lit(".."), "last_entry_id", F.lit("]"))


def render(frontier: DataFrame) -> DataFrame:
    """One text per session: a header and the text of each node, in order."""
    head = F.concat(header(), F.lit("\n"), "text")
    ordered = F.sort_array(F.collect_list(F.struct("position", head.alias("one"))))
    joined = frontier.groupBy("session_id").agg(F.array_join(F.transform(ordered, lambda x: x["one"]), "\n\n").alias("rendered"))
    return joined.withColumn("tokens", S.estimate_tokens(F.col("rendered")))


def compact_mechanically(messages: DataFrame, budget: int = CHUNK_TOKENS, leaf_tokens: int = LEAF_TOKENS) -> DataFrame:
    """Leaves of all sessions without a summarizer: chunk, render, truncate."""
    chunked = merge_chunks(chunk_contiguous(messages, budget))
    return truncated_leaves(messages, chunked, budget, leaf_tokens)


class Condensed(NamedTuple):
    """What condensing adds to the graph, and the frontier that is left."""

    nodes: DataFrame  # session_id, id, depth, tokens, quality, first_entry_id, last_entry_id
    edges: DataFrame  # session_id, summary_id, child_id
    frontier: DataFrame  # session_id, id, position, depth, tokens, quality, first_entry_id, last_entry_id


_NODE = ("session_id", "id", "position", "depth", "tokens", "quality", "first_entry_id", "last_entry_id")


def condense(frontier: DataFrame, target: int, most_depth: int = MOST_DEPTH, fan_out: int = MOST_FANOUT, node_tokens: int = LEAF_TOKENS, summarizer: Callable[[DataFrame], DataFrame] | None = None) -> Condensed:
    """Condenses the frontiers (columns of ``Condensed.frontier``) of all sessions until each fits ``target`` or nothing condenses.

    The next group is always the first one of the least depth that has a run of two or more, so all groups of a depth come
    before those of the next, and merging never makes a new run of the same depth. So one round takes a whole depth of
    all sessions: runs are cut into groups of ``fan_out``, a running sum of what the groups save tells which of them
    come before their session fits, and these become nodes one deeper, from the first child's start to the last one's end, with ids
    behind the session's last one in that order. Rounds are as many as depths; each frontier is checkpointed.

    ``summarizer`` turns groups (session_id, group, first_position, child_ids, source_tokens, any_unclean) into the same with ``tokens`` and ``level``,
    for all groups of a round; without it a node has ``node_tokens`` at most and is mechanical.
    """
    now = cut_lineage(frontier.select(*_NODE))
    last = now.groupBy("session_id").agg(F.max("id").alias("last"))
    made: list[DataFrame] = []
    order = Window.partitionBy("session_id").orderBy("position")
    over = lambda: now.groupBy("session_id").agg(F.sum("tokens").alias("total")).filter(F.col("total") > target)
    open_ = over()
    for depth in range(most_depth):
        run = F.sum(F.coalesce(F.lag("depth").over(order) != F.col("depth"), F.lit(False)).cast("long")).over(order)
        runs = now.join(open_, "session_id")
        runs = runs.withColumn("run", run).filter(F.col("depth") == depth)
        placed = runs.withColumn("k", F.row_number().over(Window.partitionBy("session_id", "run").orderBy("position")))
        group = F.struct(F.col("run"), F.floor((F.col("k") - 1) / fan_out).alias("part"))
        ends = lambda f, c: f(F.struct("position", c))[c].alias(c)
        groups = placed.groupBy("session_id", group.alias("group")).agg(
            F.first("total").alias("total"),
            F.count("*").alias("n"),
            F.min("position").alias("first_position"),
            F.sum("tokens").alias("source_tokens"),
            F.max(F.coalesce("quality", F.lit("clean")) != "clean").alias("any_unclean"),
            F.transform(F.sort_array(F.collect_list(F.struct("position", "id"))), lambda x: x["id"]).alias("child_ids"),  # fan_out at most
            ends(F.min, "first_entry_id"),
            ends(F.max, "last_entry_id"),
        )
        fit = groups.filter("n > 1")
        told = summarizer(fit) if summarizer else fit.withColumns({"tokens": F.least(F.lit(node_tokens), F.col("source_tokens")).cast("long"), "level": F.lit(3)})
        inside = Window.partitionBy("session_id").orderBy("first_position")
        before = F.coalesce(F.sum(F.col("source_tokens") - F.col("tokens")).over(inside.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
        # Savings may be negative where a user's text is longer than its source, so the first group that isn't reached ends the walk.
        reached = F.min((F.col("total") - F.col("before") > target).cast("int")).over(inside) == 1
        taken = told.withColumn("before", before).withColumn("reached", reached).filter("reached")
        numbered = taken.join(last, "session_id").withColumn("id", F.col("last") + F.row_number().over(inside))
        quality = condensed_quality(F.col("level"), F.col("any_unclean"))
        new = cut_lineage(numbered.select("session_id", "id", F.col("first_position").alias("position"), F.lit(depth + 1).cast(now.schema["depth"].dataType).alias("depth"), "tokens", quality.alias("quality"), "first_entry_id", "last_entry_id", "child_ids"))
        gone = new.select("session_id", F.explode("child_ids").alias("id"))
        if not new.isEmpty():
            now = cut_lineage(now.join(gone, ["session_id", "id"], "left_anti").unionByName(new.select(*_NODE)))
            last = cut_lineage(last.join(new.groupBy("session_id").agg(F.max("id").alias("new")), "session_id", "left").select("session_id", F.greatest("last", "new").alias("last")))
            made.append(new)
        open_ = over()
        if open_.isEmpty() or now.filter(F.col("depth") > depth).isEmpty():
            break
    nodes = reduce(DataFrame.unionByName, made) if made else now.limit(0).withColumn("child_ids", F.array("id"))
    edges = nodes.select("session_id", F.col("id").alias("summary_id"), F.explode("child_ids").alias("child_id"))
    return Condensed(nodes.drop("child_ids", "position"), edges, now)


def condense_counts(frontier: DataFrame, target: int, most_depth: int = MOST_DEPTH, fan_out: int = MOST_FANOUT, node_tokens: int = LEAF_TOKENS) -> DataFrame:
    """(session_id, nodes, deepest, tokens) of what ``condense`` leaves of frontiers (session_id, position, depth, tokens)."""
    whole = frontier.select("session_id", "position", "depth", "tokens", F.row_number().over(Window.partitionBy("session_id").orderBy("position")).cast("long").alias("id"))
    ends = whole.withColumns({"quality": F.lit("clean"), "first_entry_id": F.col("position").cast("string"), "last_entry_id": F.col("position").cast("string")})
    left = condense(ends, target, most_depth, fan_out, node_tokens).frontier
    return left.groupBy("session_id").agg(F.count("*").alias("nodes"), F.max("depth").cast("long").alias("deepest"), F.sum("tokens").alias("tokens"))


def summarize(rows: DataFrame, function, text: str = "source", into: str = "l1") -> DataFrame:
    """Calls a user's Series-to-Series summarizer; write the result before using it twice, so calls aren't repeated."""
    from pyspark.sql import types as T

    @F.pandas_udf(T.StringType())
    def call(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for batch in batches:
            yield function(batch)

    return rows.withColumn(into, call(text))
