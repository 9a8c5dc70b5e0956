"""The telemetry log: tolerant JSONL reader, writer, and export files of transcripts."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

NUMBERS = ("ts", "occupancy", "commit", "cut_count", "input", "output", "cost_total")
STRINGS = ("event", "kind", "session", "model", "stage", "reason", "category")


def read_lines(spark: SparkSession, path: str) -> DataFrame:
    """Lines of all generations with their place: numbered generations in order, the live file last."""
    name = F.col("_metadata.file_name")
    generation = F.coalesce(F.regexp_extract(name, r"\.jsonl\.(\d+)$", 1).try_cast("long"), F.lit((1 << 62)))
    return spark.read.text(path).select(generation.alias("generation"), F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("line"), F.trim("value").alias("raw"))


def parse_rows(lines: DataFrame) -> DataFrame:
    """One row per JSON object; blank and malformed lines are skipped, values of a wrong type are null."""
    v = F.try_parse_json("raw")
    parsed = lines.filter("raw like '{%'").withColumn("v", v).filter("v is not null")
    typed = lambda name, kinds, cast: F.when(F.schema_of_variant(F.try_variant_get("v", f"$.{name}", "variant")).rlike(kinds), F.try_variant_get("v", f"$.{name}", cast)).alias(name)
    return parsed.select(*[c for c in lines.columns if c != "raw"], *[typed(n, "^(BIGINT|DOUBLE|DECIMAL|INT|FLOAT)", "double") for n in NUMBERS], *[typed(n, "^STRING$", "string") for n in STRINGS])


def write_rows(rows: DataFrame, path: str) -> None:
    """Appends rows as JSONL by UTC day."""
    day = F.date_format(F.timestamp_millis("ts"), "yyyy-MM-dd")
    rows.withColumn("day", day).write.mode("append").partitionBy("day").json(path)
