"""Reports over the telemetry log; each section is one small DataFrame from one pass of grouped aggregates."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sessionloom.functions.scalars import utc_day
from sessionloom.sources.sessions import sanitized

# The event of history rows in the log, and the kinds that tell of trouble.
HISTORY = "lcm"
HEALTH_KINDS = ("summarizer-error", "summarizer-capped", "summarizer-fallback", "summary-fallback-stored", "compaction-error", "compaction-stale", "compaction-abandoned")


def of_kind(log: DataFrame, kind: str) -> DataFrame:
    return log.filter((F.col("event") == HISTORY) & (F.col("kind") == kind))


def log_window(log: DataFrame) -> DataFrame:
    return log.agg(F.count("*").alias("n_rows"), F.min("ts").alias("first_ts"), F.max("ts").alias("last_ts"))


def occupancy_dwell(log: DataFrame) -> DataFrame:
    bucket = F.least(F.lit(10), F.floor(F.coalesce("occupancy", F.lit(0.0)) * 10)).cast("int")
    label = F.when(bucket >= 10, "100%+").otherwise(F.concat((bucket * 10).cast("string"), F.lit("-"), (bucket * 10 + 10).cast("string"), F.lit("%")))
    return of_kind(log, "context-decision").groupBy(label.alias("bucket")).agg(F.count("*").alias("decisions"))


def swap_cadence(log: DataFrame) -> DataFrame:
    """Applications, distinct boundaries and the median minutes between these, by session.

    A boundary is the first row of a cut in log order, unless that row's ``distinct_boundary`` is false; later rows of the
    cut are none either way.
    """
    distinct = F.coalesce("distinct_boundary", F.lit(True)) if "distinct_boundary" in log.columns else F.lit(True)
    swaps = of_kind(log, "swap-applied").select(F.coalesce("session", F.lit("(no session)")).alias("session"), F.coalesce(F.col("cut_count").cast("string"), F.lit("(no cut)")).alias("cut"), F.coalesce("ts", F.lit(0)).alias("ts"), "pos", distinct.alias("new"))
    cuts = swaps.groupBy("session", "cut").agg(F.count("*").alias("n"), F.min_by(F.struct("ts", "new"), "pos").alias("first"))
    cuts = cuts.select("session", "cut", "n", F.col("first.new").alias("new"), F.col("first.ts").alias("ts"))
    order = Window.partitionBy("session", "new").orderBy("ts", "cut")
    gaps = cuts.withColumn("gap", F.when(F.col("new"), F.col("ts") - F.lag("ts").over(order)) / 60000)
    return gaps.groupBy("session").agg(F.sum("n").alias("applications"), F.count_if("new").alias("boundaries"), F.expr("percentile(gap, 0.5)").alias("median_minutes"))


def cache_economics(log: DataFrame) -> DataFrame:
    """Usage before and after the first swap of all, and in total; the first swap is one broadcast row."""
    first = of_kind(log, "swap-applied").agg(F.min(F.coalesce("ts", F.lit(0))).alias("first_swap"))
    usage = log.filter("event = 'usage'").join(F.broadcast(first), F.lit(True))  # one row
    phase = F.when(F.coalesce("ts", F.lit(0)) >= F.col("first_swap"), "after first swap").otherwise("before first swap")
    rolled = usage.withColumn("phase", phase).rollup("phase").agg(F.count("*").alias("turns"), F.sum("input").alias("input"), F.sum("cost_total").alias("cost"))
    return rolled.select(F.coalesce("phase", F.lit("total")).alias("phase"), "turns", "input", F.round("cost", 4).alias("cost"))


def summarizer_spend(log: DataFrame) -> DataFrame:
    rows = of_kind(log, "summarizer-usage")
    sums = (F.count("*").alias("calls"), F.sum("input").alias("input"), F.round(F.sum("cost_total"), 4).alias("cost"))
    parts = rows.groupBy("model", "stage").agg(*sums)
    return parts.unionByName(rows.agg(*sums).select(F.lit("total").alias("model"), F.lit("").alias("stage"), "calls", "input", "cost"))


def latency(log: DataFrame, by: str, value: str) -> DataFrame:
    """Nearest-rank median and 95th percentile."""
    rank = lambda p: F.expr(f"percentile_disc({p}) within group (order by {value})")
    return log.filter(F.col(value).isNotNull()).groupBy(by).agg(F.count("*").alias("n"), rank(0.5).alias("p50"), rank(0.95).alias("p95"))


def slowest(log: DataFrame, by: str, value: str) -> DataFrame:
    """The largest value of each group and where it first stood."""
    return log.filter(F.col(value).isNotNull()).groupBy(by).agg(F.max(value).alias("largest"), F.min_by("pos", F.struct(-F.col(value), F.col("pos"))).alias("pos"))


def calls_after_swap(log: DataFrame, call_kind: str) -> DataFrame:
    """For each session its calls, those at or after its first swap, and whether it swapped."""
    flag = (F.col("event") == HISTORY) & (F.col("kind") == "swap-applied")
    firsts = log.filter(flag).groupBy("session").agg(F.min("ts").alias("first_swap"))
    calls = of_kind(log, call_kind).groupBy("session", "ts").agg(F.count("*").alias("n"))
    both = firsts.join(calls, "session", "full")
    return both.groupBy("session").agg(F.coalesce(F.sum("n"), F.lit(0)).alias("calls"), F.coalesce(F.sum(F.when(F.col("ts") >= F.col("first_swap"), F.col("n"))), F.lit(0)).alias("after_swap"), (F.max("first_swap").isNotNull()).alias("swapped"))


def health_by_day(log: DataFrame, kinds: tuple[str, ...] = HEALTH_KINDS) -> DataFrame:
    days = log.filter((F.col("event") == HISTORY) & F.col("kind").isin(*kinds)).groupBy(utc_day(F.col("ts")).alias("day"))
    return days.pivot("kind", list(kinds)).count().na.fill(0)


def top_causes(log: DataFrame, column: str) -> DataFrame:
    return log.filter(F.col(column).isNotNull()).groupBy(F.col(column).alias("cause")).agg(F.count("*").alias("n"))


def worst_ratio_by_day(log: DataFrame, top: str, bottom: str) -> DataFrame:
    return log.filter(F.col(bottom) > 0).groupBy(utc_day(F.col("ts")).alias("day")).agg(F.count("*").alias("n"), F.round(F.max(F.col(top) / F.col(bottom)), 6).alias("worst"))


def per_session(log: DataFrame) -> DataFrame:
    kind = lambda k: F.count_if(F.coalesce((F.col("event") == HISTORY) & (F.col("kind") == k), F.lit(False)))
    decided = F.when(F.col("kind") == "context-decision", F.col("pos"))
    return log.groupBy("session").agg(
        F.count("*").alias("n_rows"),
        kind("context-decision").alias("decisions"),
        kind("swap-applied").alias("swaps"),
        kind("summarizer-error").alias("errors"),
        F.max_by("occupancy", decided).alias("last_occupancy"),
        F.max("pos").alias("last_pos"),
    )


def _tops(rows: DataFrame, by: list[str], what: str, most: int, label: Column) -> DataFrame:
    """(by, top, kinds): the ``most`` frequent values of ``what`` in each group as text, and how many there are."""
    counts = rows.filter(F.col(what).isNotNull()).groupBy(*by, what).agg(F.count("*").alias("n"))
    return _ranked(counts, by, what, most, label)


def _ranked(counts: DataFrame, by: list[str], what: str, most: int, label: Column) -> DataFrame:
    order = Window.partitionBy(*by).orderBy(F.desc("n"), what)
    ranked = counts.withColumn("k", F.row_number().over(order))
    told = F.sort_array(F.collect_list(F.when(F.col("k") <= most, F.struct("k", label.alias("label")))))  # most entries
    return ranked.groupBy(*by).agg(F.array_join(F.transform(told, lambda x: x["label"]), ", ").alias("top"), F.count("*").alias("kinds"))


def session_report(log: DataFrame) -> DataFrame:
    """What became of each session: decisions with their most frequent reasons, checkpoints, passes, nodes, latency, calls, heals, recall by tool, readers and the last decision.

    One conditional aggregate makes all counts; the texts of frequent values come from counts by value, of which each group keeps the
    first three reasons or five tools. Ties go to the smaller name. A kind without rows counts 0, its texts are null.
    """
    kind, action, outcome, stage = F.col("kind"), F.col("action"), F.col("outcome"), F.col("stage")
    n = lambda condition, name: F.count_if(F.coalesce(condition, F.lit(False))).alias(name)
    total = lambda k, c, name=None: F.coalesce(F.sum(F.when(kind == k, F.col(c))), F.lit(0)).alias(name or c)
    last = lambda k, c, name, more=F.lit(True): F.max_by(c, F.when((kind == k) & more, F.col("pos"))).alias(name)
    timed = F.when(kind.isin("summary-stored", "summary-replaced", "summary-skipped-existing"), F.col("duration_ms"))
    rank = lambda p: F.expr(f"percentile_disc({p}) within group (order by timed)")
    counts = log.filter(F.col("event") == HISTORY).withColumn("timed", timed).groupBy("session").agg(
        F.count("*").alias("n_rows"),
        n(kind == "projection", "projections"),
        *[n((kind == "compaction-checkpoint") & (action == a), name) for a, name in (("checkpoint", "written"), ("skip", "checkpoints_skipped"), ("fail", "checkpoints_failed"))],
        last("compaction-checkpoint", "chars", "last_chars", action == "checkpoint"),
        n(kind == "pass", "passes"),
        *[n((kind == "pass") & (outcome == o), f"passes_{o}") for o in ("stored", "nothing", "failed")],
        total("pass", "leaf"),
        total("pass", "condensed"),
        n(kind == "summary-stored", "nodes"),
        *[n((kind == "summary-stored") & (stage == x), f"{x}_nodes") for x in ("leaf", "condensed")],
        n(kind == "summary-replaced", "replaced"),
        n(kind == "summary-skipped-existing", "existing"),
        n(kind == "summary-fallback-stored", "fallbacks"),
        F.count("timed").alias("timed"),
        rank(0.5).alias("p50"),
        rank(0.95).alias("p95"),
        n(kind == "summarizer-usage", "calls"),
        n((kind == "summarizer-usage") & F.col("estimated"), "estimated"),
        n(kind == "summarizer-error", "errors"),
        n(kind == "summarizer-capped", "capped"),
        n(kind == "compaction-abandoned", "abandoned"),
        total("compaction-abandoned", "dropped"),
        n(kind == "heal-complete", "heals"),
        *[total("heal-complete", c) for c in ("repaired", "improved", "failed", "blocked", "blocked_source", "skipped", "changed", "not_attempted")],
        total("heal-complete", "calls", "heal_calls"),
        last("heal-complete", "stop", "last_stop"),
        n(kind == "reader", "readers"),
        *[n((kind == "reader") & (outcome == o), f"readers_{o}") for o in ("answered", "failed", "timeout")],
        F.coalesce(F.round(F.avg(F.when(kind == "reader", F.col("duration_ms")))).cast("long"), F.lit(0)).alias("reader_ms"),
        *[last("projection", c, f"last_{c}") for c in ("action", "occupancy", "tokens")],
    )
    writes = F.col("nodes") + F.col("replaced")
    counts = counts.withColumn("fallback_percent", F.when(writes > 0, F.round(100 * F.col("fallbacks") / writes, 1)))
    decided = log.filter((F.col("event") == HISTORY) & (kind == "projection"))
    with_n = F.concat_ws(" ", F.col("reason"), F.col("n").cast("string"))
    reasons = _tops(decided.filter(action.isin("kick", "bail")), ["session", "action"], "reason", 3, with_n)
    reasons = reasons.groupBy("session").agg(*[F.max(F.when(action == a, F.col("top"))).alias(f"{a}_reasons") for a in ("kick", "bail")])
    actions = decided.filter(action.isNotNull()).groupBy("session", "action").agg(F.count("*").alias("n"))
    actions = actions.groupBy("session").agg(F.array_join(F.sort_array(F.collect_list(F.concat_ws(" ", "action", F.col("n").cast("string")))), ", ").alias("actions"))  # a few kinds
    named = log.filter((F.col("event") == HISTORY) & (kind == "recall")).withColumn("tool", F.coalesce("tool", F.lit("(unrecorded)")))
    outcomes = ("hit", "miss", "refused", "error")
    tools = named.groupBy("session", "tool").agg(F.count("*").alias("n"), *[n(outcome == o, o) for o in outcomes])
    detail = F.array_join(F.array_compact(F.array(*[F.when(F.col(o) > 0, F.concat_ws(" ", F.lit(o), F.col(o).cast("string"))) for o in outcomes])), " ")
    tools = _ranked(tools, ["session"], "tool", 5, F.concat("tool", F.lit(" "), F.col("n").cast("string"), F.lit(" ("), detail, F.lit(")"))).select("session", F.col("top").alias("recall"), "kinds")
    joined = counts.join(actions, "session", "left").join(reasons, "session", "left").join(tools, "session", "left")
    return joined.withColumn("more_tools", F.greatest(F.coalesce("kinds", F.lit(0)) - 5, F.lit(0))).drop("kinds")


def recut_share(log: DataFrame) -> DataFrame:
    """Of the decisions with an occupancy and a recut line, how many reach it."""
    both = F.col("occupancy").isNotNull() & F.col("commit_at").isNotNull()
    rows = of_kind(log, "projection").filter(both)
    return rows.agg(F.count("*").alias("decisions"), F.count_if(F.col("occupancy") >= F.col("commit_at")).alias("at_recut"))


def fallback_share(log: DataFrame) -> DataFrame:
    """Level-3 texts of all stored and replaced nodes, and the slowest of these by its first row."""
    rows = log.filter((F.col("event") == HISTORY) & F.col("kind").isin("summary-stored", "summary-replaced", "summary-fallback-stored"))
    write = F.col("kind") != "summary-fallback-stored"
    slow = F.when(write & F.col("duration_ms").isNotNull(), F.struct((-F.col("duration_ms")).alias("less"), F.col("pos")))
    sums = rows.agg(F.count_if(write).alias("writes"), F.count_if(~write).alias("fallbacks"), F.min(slow).alias("slow"))
    return sums.select("writes", "fallbacks", F.round(F.col("fallbacks") / F.nullif("writes", F.lit(0)), 6).alias("share"), (-F.col("slow.less")).alias("slowest_ms"), F.col("slow.pos").alias("slowest_pos"))


def spend_quality(log: DataFrame) -> DataFrame:
    """Calls of summarizers by stage, with how many were rejected or estimated."""
    rows = of_kind(log, "summarizer-usage")
    return rows.groupBy("stage").agg(F.count("*").alias("calls"), F.count_if("rejected").alias("rejected"), F.count_if("estimated").alias("estimated"), F.sum("tokens").alias("tokens"))


def heal_stops(log: DataFrame) -> DataFrame:
    """Heal runs by what ended them, with their sums."""
    sums = [F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in ("repaired", "improved", "failed", "blocked", "blocked_source", "skipped", "calls")]
    return of_kind(log, "heal-complete").groupBy(F.coalesce("stop", F.lit("(unrecorded)")).alias("stop")).agg(F.count("*").alias("n"), *sums)


def recall_callers(log: DataFrame) -> DataFrame:
    """Who calls recall tools, by tool."""
    rows = of_kind(log, "recall").withColumn("caller", F.coalesce("caller", F.lit("(unrecorded)")))
    return rows.groupBy(F.coalesce("tool", F.lit("(unrecorded)")).alias("tool"), "caller").agg(F.count("*").alias("calls"))


def reader_addressing(log: DataFrame) -> DataFrame:
    """Readers by whether they name a summary, an entry or neither and search; a summary counts first."""
    how = F.when(F.col("summary_id").isNotNull(), "summary").when(F.col("entry_id").isNotNull(), "entry").otherwise("searched")
    return of_kind(log, "reader").groupBy(how.alias("addressed")).agg(F.count("*").alias("n"), F.sum("tokens").alias("tokens"))


def stalls(log: DataFrame) -> DataFrame:
    """Passes that end over their target, by day and reason, with the worst ratio."""
    rows = of_kind(log, "frontier-over-target").filter(F.col("target_tokens") > 0)
    return rows.groupBy(utc_day(F.col("ts")).alias("day"), F.coalesce("reason", F.lit("(unrecorded)")).alias("reason")).agg(F.count("*").alias("n"), F.round(F.max(F.col("frontier_tokens") / F.col("target_tokens")), 6).alias("worst"))


def losses_by_day(log: DataFrame) -> DataFrame:
    """Tokens freed by stored nodes, and how many are oversized or truncated, by day."""
    rows = log.filter((F.col("event") == HISTORY) & F.col("kind").isin("summary-stored", "summary-replaced"))
    freed = F.sum(F.greatest(F.lit(0), F.col("before_tokens") - F.col("after_tokens"))).alias("freed")
    return rows.groupBy(utc_day(F.col("ts")).alias("day")).agg(freed, F.count_if("oversized").alias("oversized"), F.count_if("truncated").alias("truncated"))


def newest_rows(log: DataFrame, most: int = 25) -> DataFrame:
    order = Window.partitionBy("session").orderBy(F.desc("pos"))
    return log.withColumn("n", F.row_number().over(order)).filter(F.col("n") <= most).drop("n")


def sanitized_rows(log: DataFrame, home: str, most: int = 25, clean: tuple[str, ...] | None = None) -> DataFrame:
    """``newest_rows`` with every column but the keys sanitized after its type: paths bound, texts of others redacted."""
    rows = newest_rows(log, most)
    skip = ("session", "pos")
    return rows.select(*[F.col(f.name) if f.name in skip or clean is not None and f.name not in clean else sanitized(F.col(f.name), f.dataType, home, f.name).alias(f.name) for f in rows.schema.fields])


def kind_tally(log: DataFrame) -> DataFrame:
    return log.groupBy(F.coalesce("kind", "event").alias("kind")).agg(F.count("*").alias("n"))


def recall_use(calls: DataFrame) -> DataFrame:
    """(tool, calls, hit, miss, error); an outcome that is neither hit nor miss is an error."""
    n = lambda v: F.count_if(F.coalesce(F.col("outcome"), F.lit("")) == v).alias(v)
    error = F.count_if(~F.coalesce("outcome", F.lit("")).isin("hit", "miss")).alias("error")
    return calls.groupBy(F.coalesce("tool", F.lit("(unrecorded)")).alias("tool")).agg(F.count("*").alias("calls"), n("hit"), n("miss"), error)
