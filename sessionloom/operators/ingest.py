"""Ingest: idempotent inserts, deltas after a watermark, tombstones, large bodies."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from sessionloom.functions import scalars as S

LARGE_FILE_CHARS = 32_000


def ingestible(entries: DataFrame) -> DataFrame:
    return entries.filter((F.coalesce("entry_id", F.lit("")) != "") & (S.trimmed(F.coalesce("text", F.lit(""))) != ""))


def insert_new(stored: DataFrame, entries: DataFrame) -> DataFrame:
    """Rows to append: one of each entry id that is not stored yet, numbered after the session's last row.

    Of rows with one id the first counts, and of several at its place that with the smallest role and text. Keys
    alone are compared and ranked; texts join by key once, for what is new.
    """
    key = ["session_id", "entry_id"]
    good = ingestible(entries)
    first = good.groupBy(*key).agg(F.min("pos").alias("pos"))
    new = first.join(stored.select(*key), key, "left_anti")
    top = stored.groupBy("session_id").agg(F.max("row_id").alias("top"))
    order = Window.partitionBy("session_id").orderBy("pos")
    numbered = new.withColumn("n", F.row_number().over(order)).join(top, "session_id", "left")
    numbered = numbered.select(*key, "pos", (F.coalesce("top", F.lit(0)) + F.col("n")).cast("long").alias("row_id"))
    others = [c for c in entries.columns if c not in key]
    whole = good.select(*key, F.struct(*others).alias("e"))
    met = numbered.join(whole, key).filter(F.col("e.pos") == F.col("pos")).groupBy(*key).agg(F.first("row_id").alias("row_id"), F.min_by("e", F.struct("e.role", "e.text")).alias("e"))
    rows = met.select(*key, "row_id", *[F.col(f"e.{c}") for c in others])
    return rows.withColumn("tokens", S.estimate_tokens(F.col("text"))).withColumn("role", S.normalize_role(F.col("role")))


def insert_counts(stored: DataFrame, entries: DataFrame) -> DataFrame:
    new = insert_new(stored, entries).groupBy("session_id").agg(F.count("*").alias("inserted"))
    seen = ingestible(entries).groupBy("session_id").agg(F.count("*").alias("seen"))
    both = seen.join(new, "session_id", "left").na.fill(0, ["inserted"])
    return both.select("session_id", "inserted", (F.col("seen") - F.col("inserted")).alias("skipped"))


def delta_after(entries: DataFrame, watermarks: DataFrame) -> DataFrame:
    """Entries behind the last occurrence of their session's watermark, with ``reset`` where it wasn't found."""
    marks = watermarks.select("session_id", F.col("entry_id").alias("mark"))
    joined = entries.join(marks, "session_id", "left")
    at = joined.groupBy("session_id").agg(F.max(F.when(F.col("entry_id") == F.col("mark"), F.col("pos"))).alias("at"))
    return entries.join(at, "session_id").filter(F.col("pos") > F.coalesce("at", F.lit(-1))).withColumn("reset", F.col("at").isNull()).drop("at")


def next_watermark(entries: DataFrame) -> DataFrame:
    return entries.groupBy("session_id").agg(F.max_by("entry_id", "pos").alias("entry_id"))


def reconcile(messages: DataFrame, active: DataFrame, at_ms: int) -> DataFrame:
    """Messages with ``removed_at_ms`` set where the entry left the branch and cleared where it came back."""
    now = active.select("session_id", "entry_id").distinct().withColumn("active", F.lit(True))
    joined = messages.join(now, ["session_id", "entry_id"], "left")
    removed = F.when(F.col("active").isNull(), F.coalesce("removed_at_ms", F.lit(at_ms)))
    return joined.withColumn("changed", removed.isNull() != F.col("removed_at_ms").isNull()).withColumn("removed_at_ms", removed).drop("active")


def externalize(entries: DataFrame, large: int = LARGE_FILE_CHARS) -> tuple[DataFrame, DataFrame]:
    """Descriptors of large bodies with a path, the first of each; and the large bodies without one."""
    big = entries.filter(F.length("text") >= large)
    files = big.filter("path is not null").select("doc_id", "path", *S.file_descriptor(F.col("path"), F.col("text")))
    return files.groupBy("file_id").agg(F.min_by(F.struct("doc_id", "path", "bytes", "kind"), "doc_id").alias("f")).select("file_id", "f.*"), big.filter("path is null").select("doc_id", F.length("text").alias("chars"))


def family_counts(messages: DataFrame) -> DataFrame:
    """Entries by the first part of their id."""
    return messages.groupBy(F.element_at(F.split("entry_id", ":"), 1).alias("family")).agg(F.count("*").alias("n"))
