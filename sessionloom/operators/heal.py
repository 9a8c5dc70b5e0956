"""Quality taint, heal plans, budgets, and verdicts on replacements."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sessionloom.operators.dag import above, cut_lineage, visible

RANK = {"mechanical": 0, "derived": 1, "clean": 2, "clipped": 3}


def tainted(summaries: DataFrame) -> DataFrame:
    return summaries.filter((F.col("status") == "committed") & (F.col("quality") != "clean"))


def with_ancestors(seeds: DataFrame, provenance: DataFrame) -> DataFrame:
    """(session_id, id): the seeds and every node above one."""
    return above(seeds, _parents(provenance))


def _parents(provenance: DataFrame) -> DataFrame:
    return provenance.filter("child_type = 'summary'").select("session_id", F.col("child_id").alias("id"), F.col("summary_id").alias("parent"))


def backfill_quality(summaries: DataFrame, provenance: DataFrame) -> DataFrame:
    """Clean nodes above a tainted one become derived."""
    below = with_ancestors(tainted(summaries), provenance).withColumn("hit", F.lit(True))
    joined = summaries.join(below, ["session_id", "id"], "left")
    return joined.withColumn("quality", F.when(F.col("hit") & (F.col("quality") == "clean"), "derived").otherwise(F.col("quality"))).drop("hit")


def heal_plan(summaries: DataFrame, provenance: DataFrame) -> DataFrame:
    """Nodes to derive again, deepest last, the worst first; ``step`` is their order within the session."""
    rank = F.coalesce(*[F.when(F.col("quality") == q, F.lit(n)) for q, n in RANK.items()], F.lit(9))
    order = Window.partitionBy("session_id").orderBy("depth", rank, "id")
    chosen = summaries.join(with_ancestors(tainted(summaries), provenance), ["session_id", "id"], "left_semi")
    return chosen.withColumn("step", F.row_number().over(order).cast("long")).withColumn("tainted", F.col("quality") != "clean")


def source_budget(target: Column, call_budget: int = 60_000) -> Column:
    wanted = F.least(F.lit(24_000), F.greatest(F.lit(3_000), 8 * target))
    return F.least(wanted, F.lit(call_budget) - target - 1024)


def share_chars(lengths: DataFrame, budget: int) -> DataFrame:
    """(session_id, node, item, share): a budget filled evenly over items, what short ones leave going to the others.

    Sorted by length, the level is found where the shorter items' sum and the level for the rest meet the budget.
    """
    up = Window.partitionBy("session_id", "node").orderBy("chars", "item")
    whole = Window.partitionBy("session_id", "node")
    ranked = lengths.withColumn("n", F.count("*").over(whole)).withColumn("k", F.row_number().over(up)).withColumn("below", F.coalesce(F.sum("chars").over(up.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    level = F.floor((F.lit(budget) - F.col("below")) / (F.col("n") - F.col("k") + 1))
    cut = ranked.withColumn("level", level).withColumn("over", F.col("chars") > F.col("level"))
    first = F.min(F.when(F.col("over"), F.col("k"))).over(whole)
    at = F.min(F.when(F.col("over"), F.struct("k", "level"))).over(whole)
    return cut.withColumn("first", first).withColumn("at", at).select("session_id", "node", "item", F.when(F.col("first").isNull() | (F.col("k") < F.col("first")), F.col("chars")).otherwise(F.greatest(F.lit(0), F.col("at.level"))).alias("share"))


def verdicts(attempts: DataFrame, stored: DataFrame, target: int) -> DataFrame:
    """Attempts (session_id, id, expected_tokens, new_tokens, new_level, source_quality) with what each would come to, were it made.

    A text of level 3, an empty one and one of over twice the target fail. A node that isn't as expected any more has
    changed. Otherwise it is repaired where its source is clean, else improved. Without a source the node fails.
    """
    both = attempts.join(stored.select("session_id", "id", "tokens"), ["session_id", "id"])
    reason = F.when(F.col("source_quality").isNull(), "source-missing").when(F.col("new_level") == 3, "level-3").when(F.col("new_tokens") == 0, "empty").when(F.col("new_tokens") > 2 * target, "oversized")
    verdict = F.when(reason.isNotNull(), "failed").when(F.col("expected_tokens") != F.col("tokens"), "changed").when(F.col("source_quality") == "clean", "repaired").otherwise("improved")
    return both.withColumn("reason", F.coalesce(reason, F.when(verdict == "changed", "concurrent-change"))).withColumn("verdict", verdict).drop("tokens")


def heal_outcomes(summaries: DataFrame, provenance: DataFrame, attempts: DataFrame, target: int, max_nodes: int | None = None) -> DataFrame:
    """session_id, id, step, tainted, outcome, reason, quality and quality_after of every node of the heal plan.

    Nodes are judged level by level, children first. One above a failed or changed node is blocked, and so is
    whatever stands above it. A clean node without a new child is skipped. A node whose source isn't clean, that isn't mechanical and
    has no new child, is blocked by its source, which blocks nothing above. The others come to their own verdict; a
    candidate without an attempt fails. From the first node beyond ``max_nodes`` attempts of a session on nothing is attempted. Clean
    nodes that were to be repaired and didn't come to it, or whose child got a new text or was changed by others, become derived.

    An edge counts if the child is less deep than the parent, as in every graph without problems; so cycles end. Each
    level is checkpointed and meets only its own edges. Nodes and edges, which are asked for several times, are worked out once.
    """
    key = ["session_id", "id"]
    nodes = cut_lineage(summaries.filter(visible()).select(*key, "depth", "quality", "status", "tokens"))
    provenance = cut_lineage(provenance.filter("child_type = 'summary'").select("session_id", "summary_id", "child_type", "child_id"))
    judged = verdicts(attempts, nodes, target).select(*key, "verdict", "source_quality", F.col("reason").alias("own_reason"))
    plan = cut_lineage(heal_plan(nodes, provenance).select(*key, "depth", "step", "tainted", "quality").join(judged, key, "left"))
    edges = _parents(provenance).distinct().join(plan.select(*key, F.col("depth").alias("child_depth")), key).join(plan.select("session_id", F.col("id").alias("parent"), "depth"), ["session_id", "parent"])
    edges = cut_lineage(edges.filter("child_depth < depth").select("session_id", "id", "parent", "depth"))
    levels: list[DataFrame] = []
    for (depth,) in plan.select("depth").distinct().orderBy("depth").collect():  # as many rows as levels
        own = plan.filter(F.col("depth") == depth)
        if levels:
            below = edges.filter(F.col("depth") == depth).join(reduce(DataFrame.unionByName, levels).select(*key, "outcome", "reason"), key)
            stuck = F.col("outcome").isin("failed", "changed") | (F.col("outcome") == "blocked") & (F.col("reason") == "dependency-failed")
            flags = below.groupBy("session_id", F.col("parent").alias("id")).agg(F.max(stuck).alias("stuck"), F.max(F.col("outcome").isin("repaired", "improved")).alias("renewed"))
            own = own.join(flags, key, "left").na.fill(False, ["stuck", "renewed"])
        else:
            own = own.withColumns({"stuck": F.lit(False), "renewed": F.lit(False)})
        idle, unclean = ~F.col("tainted") & ~F.col("renewed"), (F.col("source_quality") != "clean") & (F.col("quality") != "mechanical") & ~F.col("renewed")
        outcome = F.when(F.col("stuck"), "blocked").when(idle, "skipped").when(unclean, "blocked").otherwise(F.coalesce("verdict", F.lit("failed")))
        reason = F.when(F.col("stuck"), "dependency-failed").when(idle, "clean").when(unclean, "source-over-budget").when(F.col("verdict").isNull(), "source-missing").otherwise(F.col("own_reason"))
        levels.append(cut_lineage(own.withColumn("outcome", outcome).withColumn("reason", reason)))
    if not levels:
        return plan.select(*key, "step", "tainted", F.lit("").alias("outcome"), F.lit("").alias("reason"), "quality", F.col("quality").alias("quality_after"))
    found = reduce(DataFrame.unionByName, levels).withColumn("wanted", ~F.col("outcome").isin("skipped") & (F.coalesce("reason", F.lit("")) != "dependency-failed"))
    found = found.withColumn("tried", _tried(F.col("outcome"), F.col("reason"))).withColumn("stop", F.lit(None).cast("long"))
    if max_nodes is not None:
        order = Window.partitionBy("session_id").orderBy("step")
        counted = found.withColumn("before", F.coalesce(F.sum(F.col("tried").cast("int")).over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
        first = counted.filter(F.col("wanted") & (F.col("before") >= max_nodes)).groupBy("session_id").agg(F.min("step").alias("stop"))
        found = counted.drop("stop", "before").join(first, "session_id", "left")
    late = F.coalesce(F.col("step") >= F.col("stop"), F.lit(False))
    found = cut_lineage(found.withColumn("late", late))
    moved = edges.join(found.filter(~F.col("late") & F.col("outcome").isin("repaired", "improved", "changed")).select(*key), key, "left_semi").select("session_id", F.col("parent").alias("id"), F.lit(True).alias("moved")).distinct()
    stale = (F.col("quality") == "clean") & (F.coalesce("moved", F.lit(False)) | F.col("wanted") & (~F.col("late") | (F.col("step") == F.col("stop"))))
    after = F.when(~F.col("late") & (F.col("outcome") == "repaired"), "clean").when(~F.col("late") & (F.col("outcome") == "improved"), F.col("source_quality")).when(stale, "derived").otherwise(F.col("quality"))
    result = found.join(moved, key, "left").withColumn("quality_after", after)
    return result.select(*key, "step", "tainted", F.when(F.col("late"), "notAttempted").otherwise(F.col("outcome")).alias("outcome"), F.when(~F.col("late"), F.col("reason")).alias("reason"), "quality", "quality_after")


def _tried(outcome: Column, reason: Column) -> Column:
    return outcome.isin("repaired", "improved", "changed") | (outcome == "failed") & (reason != "source-missing")


def heal_counts(outcomes: DataFrame) -> DataFrame:
    """The eleven counts of a heal run by session."""
    n = lambda o: F.count_if(F.col("outcome") == o).alias(o)
    by_source = F.count_if((F.col("outcome") == "blocked") & (F.col("reason") == "source-over-budget")).alias("blockedSource")
    every = [n(o) for o in ("repaired", "improved", "failed", "blocked", "skipped", "changed", "notAttempted")]
    return outcomes.groupBy("session_id").agg(F.count("*").alias("candidates"), F.count_if("tainted").alias("tainted"), F.count_if(_tried(F.col("outcome"), F.col("reason"))).alias("attempted"), by_source, *every)
