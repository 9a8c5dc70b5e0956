"""Context budget: thresholds, cut points, degrading frontiers, calibration and decisions over request logs."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sessionloom.functions import redact as R
from sessionloom.functions import scalars as S
from sessionloom.operators import compact as P

SWAP, RECUT, CEILING, RECUT_CEILING, MARGIN, ZONE_MARGIN = 0.7, 0.85, 0.9, 0.95, 0.01, 1.18
SPREAD, LEAST_SAMPLES, SAMPLES, LOWEST, HIGHEST = 0.25, 3, 8, 2, 8
STALE_SHARE = 0.25


def _positive(c: str) -> Column:
    return F.when(F.col(c) > 0, F.col(c))


def thresholds(requests: DataFrame) -> DataFrame:
    """``swap``, ``recut`` and ``clamped`` from the columns window, swap_tokens, recut_tokens, smart_zone, swap_ratio, recut_ratio."""
    w = _positive("window")
    swap = F.coalesce(_positive("swap_tokens") / w, _positive("smart_zone") / w, F.col("swap_ratio"), F.lit(SWAP))
    raw = F.coalesce(_positive("recut_tokens") / w, _positive("smart_zone") * ZONE_MARGIN / w, F.col("recut_ratio"), F.lit(RECUT))
    low = F.least(swap, F.lit(CEILING))
    high = F.least(F.greatest(raw, low + MARGIN), F.lit(RECUT_CEILING))
    known = w.isNotNull()
    return requests.select("*", F.when(known, low).otherwise(F.coalesce("swap_ratio", F.lit(SWAP))).alias("swap"), F.when(known, high).otherwise(RECUT).alias("recut"), (known & ((low != swap) | (high != raw))).alias("clamped"))


def occupancy(reported: Column, estimated: Column, window: Column) -> Column:
    """A report below a quarter of the estimate belongs to another context; then the estimate counts."""
    used = F.when(reported < STALE_SHARE * estimated, estimated).otherwise(F.coalesce(reported, estimated))
    return used / window


def effective_window(believed: Column, provider: Column, floor: Column) -> Column:
    """The smallest window that is known: the believed one, the provider's, and one that a refused request has shown."""
    return F.least(believed, provider, floor)  # nulls don't count


def cut_may_replace(previous: Column, new: Column) -> Column:
    """A pinned cut only moves forwards; without one any cut will do."""
    return F.coalesce(new >= previous, F.lit(True))


def tail_key(role: Column, text: Column, chars: int = 200) -> Column:
    """What tells whether the message before a cut is still the same: its role and the start of its text, as JSON; empty without a message."""
    pair = F.to_json(F.array(role, F.left(F.coalesce(text, F.lit("")), F.lit(chars))))
    return F.when(role.isNull(), "").otherwise(pair)


def next_action(occ: Column, swap: Column, recut: Column, pinned: Column) -> Column:
    return F.when(pinned, F.when(occ >= recut, "recommit").otherwise("stable")).otherwise(F.when(occ >= swap, "consider-apply").otherwise("quiet"))


def cut_index(messages: DataFrame, keep_tokens: int) -> DataFrame:
    """(session_id, cut): the row from which on a session's messages are sent as they are; null where it can't be cut.

    The point is the newest row but the first from which the tail has ``keep_tokens``, else the first row. The cut is the
    last user row up to the point. Where that is the first row, which would cut nothing, it is the last row up to the
    point, but the first, that is no tool result; where there is no user row up to the point, the next one behind it.
    """
    back = Window.partitionBy("session_id").orderBy(F.desc("row_id"))
    rows = messages.select("session_id", "row_id", "role", F.sum(F.coalesce("tokens", F.lit(0))).over(back).alias("tail"))
    ends = rows.groupBy("session_id").agg(F.min("row_id").alias("first"), F.max(F.when(F.col("tail") >= keep_tokens, F.col("row_id"))).alias("reach"))
    placed = rows.join(ends.select("session_id", "first", F.coalesce("reach", "first").alias("at")), "session_id")
    row, user, upto = F.col("row_id"), F.col("role") == "user", F.col("row_id") <= F.col("at")
    found = placed.groupBy("session_id").agg(
        F.first("first").alias("first"),
        F.first("at").alias("at"),
        F.max(F.when(user & upto, row)).alias("user"),
        F.max(F.when((F.col("role") != "toolResult") & upto & (row > F.col("first")), row)).alias("other"),
        F.min(F.when(user & ~upto, row)).alias("ahead"),
    )
    cut = F.when(F.col("user").isNull(), F.col("ahead")).when((F.col("user") > F.col("first")) | (F.col("at") == F.col("first")), F.col("user")).otherwise(F.col("other"))
    return found.select("session_id", cut.alias("cut"))


def context_chars(messages: DataFrame) -> DataFrame:
    return messages.groupBy("session_id").agg(F.sum(F.length(F.to_json(F.struct("role", "text")))).alias("chars"))


STUB_CHARS = 200


def rendered_tiers(text: Column, thorough: Column, stub_chars: int = STUB_CHARS) -> dict[str, Column]:
    """The body of a node in each tier; a stub is the start of its text on one line and a note of what is left out."""
    flat = F.regexp_replace(F.regexp_replace(text, r"(?U)\s+", " "), "^ | $", "")
    note = F.concat(F.lit(f" {S.MARK}stub, "), F.length(text).cast("string"), F.lit(" chars elided; lcm_describe("), F.col("id").cast("string"), F.lit(") has the full summary]"))
    return {"rich": F.coalesce(thorough, text), "terse": text, "stub": F.concat(F.left(flat, F.lit(stub_chars)), note)}


def degrade(frontier: DataFrame, budget_tokens: int, stub_chars: int = STUB_CHARS, redactor: Callable[[Column], Column] | None = None) -> DataFrame:
    """``tier`` (rich, terse or stub) and ``rendered``, header and body, of each node (session_id, id, depth, first_entry_id, last_entry_id, position, text[, thorough]).

    From the oldest node on, one with a thorough text becomes terse and then a stub, others a stub, until the session's whole
    render, headers and gaps included, fits the budget; the walk may end between the two steps of a node. Texts
    are redacted first (``redactor`` as in ``redact``), so no cut leaves a part of a secret.

    Each step saves a number of characters, which may be negative. A running sum over the steps, without texts, finds the first
    one after which the whole fits.
    """
    key = ["session_id", "id"]
    thorough = R.redact(F.col("thorough"), redactor=redactor) if "thorough" in frontier.columns else F.lit(None).cast("string")
    texts = frontier.withColumn("thorough", thorough).withColumn("text", R.redact(F.col("text"), redactor=redactor))
    tiers = rendered_tiers(F.col("text"), F.col("thorough"), stub_chars)
    head = P.header()
    sized = texts.select(*key, "position", F.col("thorough").isNotNull().alias("both"), (F.length(head) + 1).cast("long").alias("head"), *[F.length(body).cast("long").alias(tier) for tier, body in tiers.items()])
    totals = sized.groupBy("session_id").agg((F.sum(F.col("head") + F.col("rich")) + 2 * (F.count("*") - 1)).alias("total"))
    step = lambda tier, saved: F.struct(F.lit(tier).alias("step"), saved.alias("saved"))
    last = step(2, F.col("terse") - F.col("stub"))
    steps = sized.select(*key, "position", F.explode(F.when(F.col("both"), F.array(step(1, F.col("rich") - F.col("terse")), last)).otherwise(F.array(last))).alias("s")).select(*key, "position", "s.*")
    order = Window.partitionBy("session_id").orderBy("position", "id", "step")
    summed = steps.withColumn("n", F.row_number().over(order)).withColumn("left", F.sum("saved").over(order)).join(totals, "session_id")
    fits = lambda chars: F.ceil(chars / S.DEFAULT_CHARS_PER_TOKEN) <= budget_tokens
    stop = summed.groupBy("session_id").agg(F.when(fits(F.first("total")), F.lit(0)).otherwise(F.min(F.when(fits(F.col("total") - F.col("left")), F.col("n")))).alias("stop"))
    taken = summed.join(stop, "session_id").groupBy(*key).agg(F.max(F.when(F.col("stop").isNull() | (F.col("n") <= F.col("stop")), F.col("step"))).alias("step"))
    done = texts.join(taken, key).withColumn("tier", F.when(F.col("step") == 1, "terse").when(F.col("step") == 2, "stub").otherwise("rich"))
    body = F.when(F.col("tier") == "rich", tiers["rich"]).when(F.col("tier") == "terse", tiers["terse"]).otherwise(tiers["stub"])
    return done.withColumn("rendered", F.concat(head, F.lit("\n"), body)).drop("step", "thorough")


def calibrate(samples: DataFrame) -> DataFrame:
    """(session, pos, ratio): characters a token over the last eight deltas; null where too few or too spread."""
    order = Window.partitionBy("session").orderBy("pos")
    deltas = samples.select("session", "pos", (F.col("chars") - F.lag("chars").over(order)).alias("c"), (F.col("tokens") - F.lag("tokens").over(order)).alias("t"))
    ratios = deltas.filter("c > 0 and t > 0").withColumn("r", F.col("c") / F.col("t"))
    last = F.sort_array(F.collect_list("r").over(order.rowsBetween(-(SAMPLES - 1), 0)))
    held = ratios.withColumn("last", last).withColumn("median", F.element_at("last", (F.floor(F.size("last") / 2) + 1).cast("int")))
    bad = F.exists("last", lambda r: F.abs(r - F.col("median")) / F.col("median") > SPREAD) | ~F.col("median").between(LOWEST, HIGHEST)
    return held.select("session", "pos", F.when((F.size("last") >= LEAST_SAMPLES) & ~bad, F.round("median", 2)).alias("ratio"))


def model_state(rows: DataFrame) -> DataFrame:
    """Per model the last ratio and the last window, each on its own."""
    last = lambda c: F.max_by(c, F.when(F.col(c).isNotNull(), F.col("ts"))).alias(c)
    return rows.groupBy("model").agg(last("ratio"), last("window"))


def retry_due(attempts: DataFrame, now_ms: int, most: int = 3, wait_ms: int = 600_000) -> DataFrame:
    """Boundaries that may be tried again: under three attempts, or ten minutes after the last."""
    sums = attempts.groupBy("session", "boundary").agg(F.count("*").alias("attempts"), F.max("ts").alias("last_ts"))
    return sums.withColumn("due", (F.col("attempts") < most) | (now_ms - F.col("last_ts") >= wait_ms))


def projected(frontier_text: DataFrame, messages: DataFrame, cuts: DataFrame) -> DataFrame:
    """What a session sends: its rendered history as one row, then the messages from the cut on; all messages where there is no cut."""
    tail = messages.join(cuts, "session_id").filter(F.col("cut").isNull() | (F.col("row_id") >= F.col("cut"))).select("session_id", "row_id", "role", "text")
    heads = frontier_text.join(cuts.filter("cut is not null"), "session_id", "left_semi")
    head = heads.select("session_id", F.lit(0).cast("long").alias("row_id"), F.lit("user").alias("role"), F.col("rendered").alias("text"))
    return head.unionByName(tail).withColumn("tokens", S.estimate_tokens(F.col("text")))
