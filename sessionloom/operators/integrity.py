"""Integrity findings over the summary graph, and repairs."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from sessionloom.operators.dag import above, cut_lineage, with_rows

KEY = ["session_id", "first_entry_id", "last_entry_id", "kind"]
_WRONG_SHAPE = "kind = 'leaf' and (depth <> 0 or n_messages = 0) or kind = 'condensed' and n_children = 0 or first_row > last_row"


def _kids(provenance: DataFrame) -> DataFrame:
    return provenance.groupBy("session_id", F.col("summary_id").alias("id")).agg(F.count_if(F.col("child_type") == "message").alias("n_messages"), F.count_if(F.col("child_type") == "summary").alias("n_children"))


def bad_spans(summaries: DataFrame, messages: DataFrame) -> DataFrame:
    return with_rows(summaries, messages).filter("first_row is null or last_row is null").select("session_id", "id")


def bad_shapes(summaries: DataFrame, messages: DataFrame, provenance: DataFrame) -> DataFrame:
    """Leaves that are deep or empty, condensed nodes without children, spans that end before they start."""
    nodes = with_rows(summaries, messages).join(_kids(provenance), ["session_id", "id"], "left").na.fill(0, ["n_messages", "n_children"])
    return nodes.filter(_WRONG_SHAPE).select("session_id", "id").distinct()


def orphan_parents(summaries: DataFrame, provenance: DataFrame) -> DataFrame:
    """Committed nodes that name a missing child."""
    edges = provenance.filter("child_type = 'summary'").join(summaries.filter("status = 'committed'").select("session_id", F.col("id").alias("summary_id")), ["session_id", "summary_id"], "left_semi")
    lost = edges.join(summaries.select("session_id", F.col("id").alias("child_id")), ["session_id", "child_id"], "left_anti")
    return lost.select("session_id", F.col("summary_id").alias("id")).distinct()


def duplicate_spans(summaries: DataFrame) -> DataFrame:
    many = summaries.groupBy(*KEY).agg(F.count("*").alias("n")).filter("n > 1").select(*KEY)
    return summaries.join(many, KEY, "left_semi").select("session_id", "id")


def dead_runs(summaries: DataFrame, runs: DataFrame) -> DataFrame:
    return summaries.filter("status = 'pending'").join(runs.select("run"), "run", "left_anti").select("session_id", "id")


def findings(summaries: DataFrame, messages: DataFrame, provenance: DataFrame, runs: DataFrame) -> DataFrame:
    """(kind, severity, n, sample): one row for each check that found something.

    Every node meets its rows, edges, twins and run once and names the checks that it fails; each of 64 parts of a kind
    keeps its count and ten smallest nodes.
    """
    key, flag = ["session_id", "id"], F.lit(True)
    nodes = with_rows(summaries, messages).join(_kids(provenance), key, "left").na.fill(0, ["n_messages", "n_children"])
    nodes = nodes.join(orphan_parents(summaries, provenance).withColumn("orphan", flag), key, "left").join(runs.select("run").distinct().withColumn("known", flag), "run", "left")
    nodes = nodes.withColumn("twins", F.count("*").over(Window.partitionBy(*KEY)))
    checks = {
        "summary-span": F.col("first_row").isNull() | F.col("last_row").isNull(),
        "summary-shape": F.expr(_WRONG_SHAPE),
        "orphan-child": F.col("orphan"),
        "duplicate-span": F.col("twins") > 1,
        "dead-run": (F.col("status") == "pending") & F.col("known").isNull(),
    }
    kinds = F.array_compact(F.array(*[F.when(failed, kind) for kind, failed in checks.items()]))
    named = nodes.select(F.explode(kinds).alias("kind"), F.concat_ws("#", "session_id", F.col("id").cast("string")).alias("node"))
    salted = named.withColumn("salt", F.pmod(F.xxhash64("node"), F.lit(64)))
    part = Window.partitionBy("kind", "salt")
    numbered = salted.withColumn("k", F.row_number().over(part.orderBy("node"))).withColumn("of", F.count("*").over(part)).filter("k <= 10")
    found = numbered.groupBy("kind").agg(F.sum(F.when(F.col("k") == 1, F.col("of"))).alias("n"), F.sort_array(F.collect_list("node")).alias("nodes"))  # 640 nodes at most
    return found.select("kind", F.lit("error").alias("severity"), "n", F.array_join(F.slice("nodes", 1, 10), ",").alias("sample"))


def drop_orphan_spans(summaries: DataFrame, messages: DataFrame) -> DataFrame:
    return summaries.join(bad_spans(summaries.filter("status = 'committed'"), messages), ["session_id", "id"], "left_anti")


def dedupe_spans(summaries: DataFrame, provenance: DataFrame) -> DataFrame:
    """Of each span the node with most edges, the newest of these."""
    edges = provenance.groupBy("session_id", F.col("summary_id").alias("id")).agg(F.count("*").alias("edges"))
    order = Window.partitionBy(*KEY).orderBy(F.desc_nulls_last("edges"), F.desc("id"))
    ranked = summaries.join(edges, ["session_id", "id"], "left").withColumn("n", F.row_number().over(order))
    return ranked.filter("n = 1").drop("n", "edges")


def drop_orphan_parents(summaries: DataFrame, provenance: DataFrame) -> DataFrame:
    """Summaries without those that name a missing child, and so on upwards until none is left.

    A lost node is one with a missing child, or a committed one above; the walk starts at the former. Ids and edges are worked out once.
    """
    nodes = cut_lineage(summaries.select("session_id", "id", "status"))
    children = cut_lineage(provenance.filter("child_type = 'summary'").select("session_id", "summary_id", "child_type", "child_id"))
    edges = children.join(nodes.filter("status = 'committed'").select("session_id", F.col("id").alias("summary_id")), ["session_id", "summary_id"], "left_semi")
    lost = above(orphan_parents(nodes, children), edges.select("session_id", F.col("child_id").alias("id"), F.col("summary_id").alias("parent")))
    return summaries.join(lost, ["session_id", "id"], "left_anti")


def reap_pending(summaries: DataFrame, runs: DataFrame) -> DataFrame:
    return summaries.join(dead_runs(summaries, runs), ["session_id", "id"], "left_anti")


def commit_run(summaries: DataFrame, run: str) -> DataFrame:
    mine = F.coalesce(F.col("run") == run, F.lit(False))
    return summaries.withColumn("status", F.when(mine, "committed").otherwise(F.col("status"))).withColumn("run", F.when(~mine, F.col("run")))
