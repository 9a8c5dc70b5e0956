"""Transcript export and import: rows of three types, validation, and what an import would change."""

from __future__ import annotations

from functools import reduce
from typing import NamedTuple

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from sessionloom.operators.dag import cut_lineage
from sessionloom.operators.ingest import ingestible, insert_new

#: What a summary that was only cut begins with; must be as given.
MECHANICAL_PREFIX = "[lcm:truncated]"


def export_rows(messages: DataFrame, summaries: DataFrame, provenance: DataFrame, files: DataFrame | None = None) -> DataFrame:
    """(session_id, row_type, ordinal, line): messages by row, then summaries by id with entry ids or child ordinals, then files.

    ``summaries`` may have a text. ``files`` are rows (session_id, file_id, path, bytes, sha256, kind, preview, entry_ids).
    """
    by_id = Window.partitionBy("session_id").orderBy("id")
    numbered = summaries.withColumn("ordinal", (F.row_number().over(by_id) - 1).cast("long"))
    ordinals = numbered.select("session_id", F.col("id").alias("child_id"), F.col("ordinal").alias("child"))
    kids = provenance.filter("child_type = 'summary'").join(ordinals, ["session_id", "child_id"])
    kids = kids.groupBy("session_id", F.col("summary_id").alias("id")).agg(F.sort_array(F.collect_list("child")).alias("children"))
    own = provenance.filter("child_type = 'message'").join(messages.select("session_id", F.col("row_id").alias("child_id"), "entry_id"), ["session_id", "child_id"])
    entries = own.groupBy("session_id", F.col("summary_id").alias("id")).agg(F.transform(F.sort_array(F.collect_list(F.struct("child_id", "entry_id"))), lambda x: x["entry_id"]).alias("entries"))
    full = numbered.join(kids, ["session_id", "id"], "left").join(entries, ["session_id", "id"], "left")
    m = messages.select("session_id", F.lit("message").alias("row_type"), F.col("row_id").alias("ordinal"), F.to_json(F.struct(F.lit(1).alias("v"), F.lit("message").alias("rowType"), "entry_id", "role", "text", "tokens", "ts_ms")).alias("line"))
    s = full.select("session_id", F.lit("summary").alias("row_type"), "ordinal", F.to_json(F.struct(F.lit(1).alias("v"), F.lit("summary").alias("rowType"), "ordinal", "kind", "depth", "first_entry_id", "last_entry_id", "tokens", "quality", "entries", "children", *(["text"] if "text" in summaries.columns else []))).alias("line"))
    if files is None:
        return m.unionByName(s)
    order = Window.partitionBy("session_id").orderBy("file_id")
    f = files.withColumn("ordinal", (F.row_number().over(order) - 1).cast("long"))
    f = f.select("session_id", F.lit("file").alias("row_type"), "ordinal", F.to_json(F.struct(F.lit(1).alias("v"), F.lit("file").alias("rowType"), "file_id", "path", "bytes", "sha256", "kind", "preview", "entry_ids")).alias("line"))
    return m.unionByName(s).unionByName(f)


EXPORT = "v int,rowType string,entry_id string,role string,text string,tokens long,ts_ms long,ordinal long,kind string,depth int,first_entry_id string,last_entry_id string,quality string,entries array<string>,children array<long>,file_id string,path string,bytes long,sha256 string,preview string,entry_ids array<string>"


def parse_lines(lines: DataFrame) -> DataFrame:
    """(session_id, line_no, line) parsed, with ``problem`` where a line can't be used."""
    row = F.from_json("line", EXPORT)
    parsed = lines.filter(F.trim("line") != "").withColumn("r", row)
    problem = (
        F.when(F.try_parse_json("line").isNull(), "not JSON")
        .when(F.col("r.v").isNull() | (F.col("r.v") != 1), "version")
        .when(~F.coalesce(F.col("r.rowType"), F.lit("")).isin("message", "summary", "file"), "row type")
        .when((F.col("r.rowType") == "message") & F.col("r.entry_id").isNull(), "entry id")
        .when((F.col("r.rowType") == "summary") & (F.col("r.ordinal").isNull() | F.col("r.depth").isNull()), "ordinal or depth")
        .when((F.col("r.rowType") == "file") & (F.col("r.file_id").isNull() | F.col("r.bytes").isNull() | F.col("r.sha256").isNull()), "file fields")
    )
    return parsed.withColumn("problem", problem)


def first_problems(parsed: DataFrame) -> DataFrame:
    return parsed.filter("problem is not null").groupBy("session_id").agg(F.min("line_no").alias("line_no"), F.min_by("problem", "line_no").alias("problem"))


def conflicting_entries(rows: DataFrame) -> DataFrame:
    """Entries that come with different texts."""
    return rows.groupBy("session_id", "entry_id").agg(F.count_distinct(F.sha2("text", 256)).alias("texts")).filter("texts > 1")


def clashes(stored: DataFrame, rows: DataFrame) -> DataFrame:
    """Entries whose stored text differs from the file's, by digest."""
    mine = stored.select("session_id", "entry_id", F.sha2("text", 256).alias("stored"))
    theirs = rows.select("session_id", "entry_id", F.sha2("text", 256).alias("given"))
    return mine.join(theirs, ["session_id", "entry_id"]).filter("stored <> given").select("session_id", "entry_id")


def foreign_entries(stored: DataFrame, rows: DataFrame) -> DataFrame:
    return stored.join(rows, ["session_id", "entry_id"], "left_anti").select("session_id", "entry_id")


def depth_problems(summaries: DataFrame, provenance: DataFrame) -> DataFrame:
    """Edges to a missing child, or to one that isn't less deep."""
    node = summaries.select("session_id", F.col("id").alias("summary_id"), "depth")
    child = summaries.select("session_id", F.col("id").alias("child_id"), F.col("depth").alias("child_depth"))
    edges = provenance.filter("child_type = 'summary'").join(node, ["session_id", "summary_id"]).join(child, ["session_id", "child_id"], "left")
    return edges.filter("child_depth is null or child_depth >= depth").select("session_id", "summary_id", "child_id")


class Parsed(NamedTuple):
    """Rows of export files by type, and what can't be read."""

    messages: DataFrame  # session_id, pos, entry_id, role, text
    summaries: DataFrame  # session_id, ordinal, kind, depth, first_entry_id, last_entry_id, tokens, quality, text, entries, children
    files: DataFrame  # session_id, file_id, path, bytes, sha256, kind, preview, entry_ids
    problems: DataFrame  # session_id, problem


def split_rows(parsed: DataFrame) -> Parsed:
    """The rows of ``parse_lines`` by type, parsed once; each line's number is a message's position."""
    parsed = cut_lineage(parsed.select("session_id", "line_no", "problem", "r"))
    good = parsed.filter("problem is null")
    of = lambda kind, *columns: good.filter(F.col("r.rowType") == kind).select("session_id", *[F.col(f"r.{c}").alias(c) for c in columns])
    messages = good.filter("r.rowType = 'message'").select("session_id", F.col("line_no").alias("pos"), F.col("r.entry_id").alias("entry_id"), F.col("r.role").alias("role"), F.col("r.text").alias("text"))
    summaries = of("summary", "ordinal", "kind", "depth", "first_entry_id", "last_entry_id", "tokens", "quality", "text", "entries", "children")
    files = of("file", "file_id", "path", "bytes", "sha256", "kind", "preview", "entry_ids")
    return Parsed(messages, summaries, files, parsed.filter("problem is not null").select("session_id", F.lit("line").alias("problem")))


def import_problems(rows: Parsed, messages: DataFrame, summaries: DataFrame, live_runs: DataFrame) -> DataFrame:
    """(session_id, problem, n): everything that forbids to import a session into the store of ``messages`` and ``summaries``.

    line: a line can't be read. run: an open run holds pending rows. file-entry, summary-entry: an entry that the file
    doesn't hold. child, child-depth: a child that it doesn't hold, or that isn't less deep. repeat: one entry with two texts.
    file-hash: an entry of another length or digest than its file. stored-text: the store has another text for a file's
    entry. foreign: the store has entries that the file lacks. Texts are compared by digest where an entry has one.
    """
    key = ["session_id", "entry_id"]
    first = rows.messages.groupBy(*key).agg(F.min("pos").alias("pos"))
    held = rows.messages.join(first, [*key, "pos"]).select(*key, F.length("text").alias("chars"), F.sha2("text", 256).alias("digest")).groupBy(*key).agg(F.min_by("chars", "digest").alias("chars"), F.min("digest").alias("digest"))
    held = cut_lineage(held)
    named = rows.files.select("session_id", "file_id", "bytes", "sha256", F.explode("entry_ids").alias("entry_id")).join(held.withColumn("held", F.lit(True)), key, "left")
    leaf = rows.summaries.select("session_id", F.explode("entries").alias("entry_id")).join(held, key, "left_anti")
    nodes = rows.summaries.groupBy("session_id", "ordinal").agg(F.max("depth").alias("child_depth")).withColumnRenamed("ordinal", "child")
    kids = rows.summaries.select("session_id", "depth", F.explode("children").alias("child")).join(nodes, ["session_id", "child"], "left")
    mine = messages.select(*key, F.sha2("text", 256).alias("stored"))
    linked = named.filter("held").select(*key, "digest").distinct().join(mine, key).filter("stored <> digest")
    given = rows.messages.select("session_id").unionByName(rows.summaries.select("session_id")).unionByName(rows.files.select("session_id")).distinct()
    named, kids = cut_lineage(named), cut_lineage(kids)
    found = {
        "run": summaries.filter("status = 'pending'").join(live_runs.select("run"), "run", "left_semi").join(given, "session_id", "left_semi"),
        "file-entry": named.filter("held is null"),
        "summary-entry": leaf,
        "child": kids.filter("child_depth is null"),
        "child-depth": kids.filter("child_depth >= depth"),
        "repeat": conflicting_entries(rows.messages),
        "file-hash": named.filter("held and (chars <> bytes or digest <> sha256)"),
        "stored-text": linked,
        "foreign": foreign_entries(messages, rows.messages).join(given, "session_id", "left_semi"),
    }
    every = [df.select("session_id", F.lit(name).alias("problem")) for name, df in found.items()]
    return reduce(DataFrame.unionByName, every, rows.problems).groupBy("session_id", "problem").agg(F.count("*").alias("n"))


class Imported(NamedTuple):
    """What an import adds to the store, and what it says of each session."""

    messages: DataFrame
    files: DataFrame
    links: DataFrame  # session_id, row_id, file_id
    summaries: DataFrame
    edges: DataFrame  # session_id, summary_id, child_type, child_id
    report: DataFrame  # session_id, refused, messages, messages_skipped, summaries, summaries_skipped


def import_sessions(rows: Parsed, messages: DataFrame, summaries: DataFrame, live_runs: DataFrame) -> Imported:
    """Parsed export files into the store of ``messages`` and ``summaries`` (session_id, id, kind, first_entry_id, last_entry_id, status, run).

    A session with any problem is refused whole and adds nothing; ``refused`` names its problems. Else its messages are
    inserted as in ``insert_new``; files are linked to the rows of their entries; summaries get ids after the session's last one in order
    of depth and ordinal. One whose ends and kind the store or an earlier row of the file has takes that id and adds
    nothing. All edges go through the map of entries to rows and of ordinals to ids. Without a quality a summary is
    mechanical if its text says so, else clean.
    """
    key, span = ["session_id", "entry_id"], ["session_id", "first_entry_id", "last_entry_id", "kind"]
    problems = import_problems(rows, messages, summaries, live_runs)
    refused = cut_lineage(problems.groupBy("session_id").agg(F.array_join(F.sort_array(F.collect_set("problem")), ",").alias("refused")))  # ten kinds
    free = lambda df: df.join(refused.select("session_id"), "session_id", "left_anti")
    entries, nodes, files = free(rows.messages), free(rows.summaries), free(rows.files)

    added = cut_lineage(insert_new(messages, entries))
    rows_of = messages.select(*key, "row_id").unionByName(added.select(*key, "row_id"))
    links = files.select("session_id", "file_id", F.explode("entry_ids").alias("entry_id")).join(rows_of, key).select("session_id", "row_id", "file_id").distinct()

    order = F.struct("depth", "ordinal")
    known = summaries.groupBy(*span).agg(F.min("id").alias("known"))
    last = summaries.groupBy("session_id").agg(F.max("id").alias("last"))
    firsts = nodes.groupBy(*span).agg(F.min(order).alias("o")).join(known, span, "left").join(last, "session_id", "left")
    by_order = Window.partitionBy("session_id").orderBy("o")
    new = firsts.filter("known is null").withColumn("id", F.coalesce("last", F.lit(0)) + F.row_number().over(by_order))
    ids = new.select(*span, "id", F.col("o.ordinal").alias("made")).unionByName(firsts.filter("known is not null").select(*span, F.col("known").alias("id"), F.lit(None).cast("long").alias("made")))
    named = cut_lineage(nodes.join(ids, span))
    made = named.filter("ordinal = made")
    quality = F.coalesce("quality", F.when(F.startswith("text", F.lit(MECHANICAL_PREFIX)), "mechanical"), F.lit("clean"))
    to_rows = made.select("session_id", F.col("id").alias("summary_id"), F.explode("entries").alias("entry_id")).join(rows_of, key).select("session_id", "summary_id", F.lit("message").alias("child_type"), F.col("row_id").alias("child_id"))
    by_ordinal = named.select("session_id", F.col("ordinal").alias("child"), F.col("id").alias("child_id"))
    to_nodes = made.select("session_id", F.col("id").alias("summary_id"), F.explode("children").alias("child")).join(by_ordinal, ["session_id", "child"]).select("session_id", "summary_id", F.lit("summary").alias("child_type"), "child_id")

    n = lambda df, name: df.groupBy("session_id").agg(F.count("*").alias(name))
    every = rows.messages.select("session_id").unionByName(rows.summaries.select("session_id")).unionByName(rows.files.select("session_id")).unionByName(rows.problems.select("session_id")).distinct()
    counts = every.join(refused, "session_id", "left")
    for df, name in ((added, "messages"), (ingestible(entries), "read"), (made, "summaries"), (nodes, "nodes")):
        counts = counts.join(n(df, name), "session_id", "left")
    counts = counts.na.fill(0, ["messages", "read", "summaries", "nodes"])
    report = counts.select("session_id", "refused", "messages", (F.col("read") - F.col("messages")).alias("messages_skipped"), "summaries", (F.col("nodes") - F.col("summaries")).alias("summaries_skipped"))
    stored = made.withColumn("quality", quality).withColumn("status", F.lit("committed")).select("session_id", "id", "kind", "depth", "first_entry_id", "last_entry_id", "tokens", "quality", "status", "text")
    return Imported(added, files.dropDuplicates(["session_id", "file_id"]), links, stored, to_rows.unionByName(to_nodes).distinct(), report)
