"""Queries that run as streams over several micro-batches."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sessionloom.operators import dag as D
from sessionloom.registry import query
from sessionloom.sources.fixtures import view
from sessionloom.streaming import stateful as T


def _streamed(rows: DataFrame, batch: Column, n: int, start) -> DataFrame:
    """What ``start`` (rows, target, checkpoint) writes of ``rows`` that arrive as ``n`` files, a micro-batch each."""
    spark, folder = rows.sparkSession, f"{D.shared_folder(rows.sparkSession)}/stream-{uuid.uuid4().hex}"
    held = D.cut_lineage(rows.withColumn("batch", batch))
    for k in range(n):  # one after the other, as files are taken in order of their times
        held.filter(F.col("batch") == k).drop("batch").coalesce(1).write.mode("append").parquet(f"{folder}/in")
    arriving = spark.readStream.schema(rows.schema).option("maxFilesPerTrigger", 1).parquet(f"{folder}/in")
    start(arriving, f"{folder}/out", f"{folder}/state").awaitTermination()
    return spark.read.parquet(f"{folder}/out")


_ARRIVAL = """a AS (SELECT kind, ts, CASE WHEN pos % 10 = 3 AND pos < n - n // 50 THEN 3 WHEN pos < n // 2 THEN 0 WHEN pos < n - n // 50 THEN 1 ELSE 2 END AS batch FROM fx_metrics, (SELECT max(pos) + 1 AS n FROM fx_metrics) m WHERE kind IS NOT NULL)"""


@query(
    "n03_health_stream",
    f"""WITH {_ARRIVAL}, w AS (SELECT *, ts // 3600000 * 3600000 AS start, (SELECT coalesce(max(b.ts), 0) - 3600000 FROM a b WHERE b.batch < a.batch - 1) AS mark FROM a)
 SELECT start, kind, count(*) AS n FROM w WHERE batch < 2 OR start + 3600000 > mark GROUP BY start, kind HAVING start + 3600000 <= (SELECT max(ts) - 3600000 FROM a)""",
)
def health_stream(spark, d):
    """Hours of a log of which a tenth comes last, most of it too late; the watermark that drops rows is that of the batch before."""
    log = view(spark, d, "fx_metrics").filter("kind is not null").select("pos", "kind", "ts")
    n = log.sparkSession.read.parquet(f"{d}/events.parquet").agg(F.max("event_id")).first()[0] + 1
    late = (F.col("pos") % 10 == 3) & (F.col("pos") < n - n // 50)
    batch = F.when(late, 3).when(F.col("pos") < n // 2, 0).when(F.col("pos") < n - n // 50, 1).otherwise(2)
    return _streamed(log, batch, 4, lambda rows, target, state: T.health_stream(rows, target, state, "1 hour", "1 hour"))


@query(
    "n02_delta_stream",
    """WITH m AS (SELECT session_id, entry_id, row_id AS pos, session_id LIKE '%3' AS lost FROM fx_messages)
 SELECT session_id, entry_id, pos, true AS reset FROM m WHERE pos <= 2 UNION ALL SELECT session_id, entry_id, pos, lost AS reset FROM m WHERE pos BETWEEN 3 AND 5 AND (NOT lost OR pos >= 4)
 UNION ALL SELECT session_id, entry_id, pos, false FROM m WHERE pos > 5""",
)
def delta_stream(spark, d):
    """Histories that arrive in three overlapping pieces; where a piece lacks the last known entry it is taken whole."""
    m = view(spark, d, "fx_messages").select("session_id", "entry_id", F.col("row_id").alias("pos"))
    piece = F.explode(F.array_compact(F.array(F.when(F.col("pos") <= 2, 0), F.when(F.col("pos").between(2, 5) & ~(F.col("session_id").endswith("3") & (F.col("pos") < 4)), 1), F.when(F.col("pos") >= 5, 2))))
    pieces = m.select("session_id", "entry_id", "pos", piece.alias("piece"))
    return _streamed(pieces, F.col("piece"), 3, T.delta_stream)


@query(
    "n05_retry_stream",
    """WITH RECURSIVE w AS (SELECT concat('s', pos % 2) AS session, kind AS boundary, ts + 86400000 AS ts, row_number() OVER (PARTITION BY pos % 2, kind ORDER BY ts) AS k FROM fx_metrics WHERE kind IS NOT NULL),
 s AS (SELECT session, boundary, ts, k, true AS made, 1 AS attempts, ts AS last FROM w WHERE k = 1
 UNION ALL SELECT w.session, w.boundary, w.ts, w.k, s.attempts < 3 OR w.ts - s.last >= 600000, s.attempts + CASE WHEN s.attempts < 3 OR w.ts - s.last >= 600000 THEN 1 ELSE 0 END, CASE WHEN s.attempts < 3 OR w.ts - s.last >= 600000 THEN w.ts ELSE s.last END
  FROM s JOIN w ON w.session = s.session AND w.boundary = s.boundary AND w.k = s.k + 1)
 SELECT session, boundary, ts, CASE WHEN made THEN 'attempt' ELSE 'refused' END AS what, attempts FROM s
 UNION ALL SELECT session, boundary, ts + 600000, 'opened', attempts FROM s x WHERE made AND attempts >= 3
  AND (EXISTS (SELECT 1 FROM s y WHERE y.session = x.session AND y.boundary = x.boundary AND y.made AND y.k > x.k) OR ts + 600000 < (SELECT max(ts) - 30000 FROM w))""",
)
def retry_stream(spark, d):
    """Wishes to try a boundary, in three batches of some hours."""
    log = view(spark, d, "fx_metrics").filter("kind is not null")
    wishes = log.select(F.concat(F.lit("s"), (F.col("pos") % 2).cast("string")).alias("session"), F.col("kind").alias("boundary"), (F.col("ts") + 86_400_000).alias("ts"))
    n = spark.read.parquet(f"{d}/events.parquet").agg(F.max("event_id")).first()[0] + 1
    return _streamed(wishes, F.floor((F.col("ts") - 86_400_000) / 60000 * 3 / n).cast("int"), 3, T.latch_stream)
