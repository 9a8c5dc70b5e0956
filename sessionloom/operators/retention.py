"""Retention: which stores may go."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sessionloom.functions.scalars import session_hash

DAY_MS = 86_400_000


def by_lifecycle(stores: DataFrame, sessions: DataFrame, now_ms: int, days: int = 30) -> DataFrame:
    """Stores (name, mtime_ms, live) that are old scratch, or whose session is gone."""
    known = sessions.select(session_hash(F.col("path")).alias("name")).distinct().withColumn("known", F.lit(True))
    rows = stores.filter(~F.col("live")).join(known, "name", "left")
    scratch = F.col("name").startswith("scratch-")
    reason = F.when(scratch, F.when(now_ms - F.col("mtime_ms") > days * DAY_MS, "scratch-expired")).when(F.col("known").isNull(), "session-gone")
    return rows.withColumn("reason", reason).filter("reason is not null").select("name", "reason")


GRACE_MS, YOUNG_MS = 3_600_000, DAY_MS


def by_age(files: DataFrame, open_stems: DataFrame, now_ms: int, days: float = 30, forced: bool = False) -> DataFrame:
    """(stem, age_ms, state) of families of files (stem, mtime_ms) older than ``days``; open ones never, a time in the future is age 0.

    A family of less than an hour is in its ``grace`` and stays unless ``forced``, one of less than a day is ``young`` and worth a warning, others are ``old``.
    """
    newest = files.groupBy("stem").agg(F.max("mtime_ms").alias("mtime_ms")).join(open_stems, "stem", "left_anti")
    age = F.greatest(F.lit(0), now_ms - F.col("mtime_ms"))
    state = F.when((F.col("age_ms") < GRACE_MS) & ~F.lit(forced), "grace").when(F.col("age_ms") < YOUNG_MS, "young").otherwise("old")
    return newest.select("stem", age.alias("age_ms")).filter(F.col("age_ms") > days * DAY_MS).withColumn("state", state)


def export_before_delete(lines: DataFrame, candidates: DataFrame, path: str) -> None:
    """Writes the export lines (session_id, row_type, ordinal, line) of the candidates (session_id) as JSON lines, a folder and a file for each session, messages first."""
    own = lines.join(candidates.select("session_id").distinct(), "session_id", "left_semi")
    kind = F.when(F.col("row_type") == "message", 0).when(F.col("row_type") == "summary", 1).otherwise(2)
    ordered = own.withColumn("kind", kind).repartition("session_id").sortWithinPartitions("session_id", "kind", "ordinal")
    ordered.select("session_id", "line").write.partitionBy("session_id").text(path)
