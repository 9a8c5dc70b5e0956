"""Long-context evaluation: needles planted in the rows of sessions, and what compaction keeps of them."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sessionloom.functions.scalars import estimate_tokens
from sessionloom.operators import compact as P
from sessionloom.operators.search import terms_of

#: What ``plant`` does with six needles, in SQL over a view of messages.
NEEDLES_SQL = """SELECT m.session_id, m.row_id, m.text, printf('N%02d=%d', k.i, 1000 + (m.row_id * 37 + k.i * 101) % 9000) AS needle
 FROM fx_tool_messages m LEFT JOIN (SELECT session_id, CAST(floor(i * n / 6.0) AS BIGINT) + 1 AS row_id, max(i) AS i FROM (SELECT session_id, max(row_id) AS n FROM fx_tool_messages GROUP BY 1) t, range(0, 6) r(i) GROUP BY 1, 2) k
 ON k.session_id = m.session_id AND k.row_id = m.row_id"""


def plant(messages: DataFrame, needles: int) -> DataFrame:
    """Messages with ``needle``: needle i of a session of n rows stands in the middle of row floor(i * n / needles), the last one where several meet.

    Rows are numbered from 1 without gaps. A needle is a name and a value of four digits that follows from row and number.
    """
    sizes = messages.groupBy("session_id").agg(F.max("row_id").alias("n"))
    places = sizes.select("session_id", "n", F.explode(F.sequence(F.lit(0), F.lit(needles - 1))).alias("i"))
    places = places.groupBy("session_id", (F.floor(F.col("i") * F.col("n") / needles) + 1).alias("row_id")).agg(F.max("i").alias("i"))
    value = 1000 + (F.col("row_id") * 37 + F.col("i") * 101) % 9000
    needle = F.when(F.col("i").isNotNull(), F.format_string("N%02d=%d", F.col("i"), value))
    half = F.floor(F.length("text") / 2).cast("int")
    joined = messages.join(places, ["session_id", "row_id"], "left").withColumn("needle", needle)
    text = F.when(F.col("needle").isNull(), F.col("text")).otherwise(F.concat(F.substring("text", F.lit(1), half), F.lit(" "), "needle", F.lit(" "), F.expr("substring(text, cast(floor(length(text) / 2) as int) + 1)")))
    return joined.withColumn("text", text).withColumn("tokens", estimate_tokens(F.col("text"))).drop("i")


def fidelity(entries: DataFrame, budget: int = 2000, target: int = 400) -> DataFrame:
    """By session: needles, those stored verbatim, those covered by a leaf, and those that leaves still show."""
    chunked = P.merge_chunks(P.chunk_contiguous(entries, budget))
    leaves = P.truncated_leaves(entries, chunked, budget, target).select("session_id", "chunk", F.col("text").alias("leaf"))
    planted = entries.filter("needle is not null").join(chunked, ["session_id", "row_id"], "left").join(leaves, ["session_id", "chunk"], "left")
    count = lambda c: F.count_if(F.coalesce(c, F.lit(False)))
    return planted.groupBy("session_id").agg(F.count("*").alias("needles"), count(F.contains("text", "needle")).alias("stored"), count(F.col("leaf").isNotNull()).alias("covered"), count(F.contains("leaf", "needle")).alias("shown"))


def recall(entries: DataFrame, budget: int = 2000, target: int = 400) -> DataFrame:
    """By session: needles, those answered from leaves or else by a term search of the log, and those neither finds."""
    chunked = P.merge_chunks(P.chunk_contiguous(entries, budget))
    leaves = P.truncated_leaves(entries, chunked, budget, target).groupBy("session_id").agg(F.collect_list("text").alias("leaves"))
    asked = entries.filter("needle is not null").select("session_id", "needle")
    name, value = F.substring_index("needle", "=", 1), F.substring_index("needle", "=", -1)
    found = asked.join(leaves, "session_id", "left").withColumn("shown", F.exists("leaves", lambda t: F.contains(t, F.col("needle"))))
    # a needle's name is a term of its own: the search is an equi join of asked names with the terms of the log
    terms = entries.select("session_id", F.explode(F.array_distinct(terms_of(F.col("text")))).alias("term"))
    logged = found.join(terms.withColumnRenamed("term", "name"), (found["session_id"] == terms["session_id"]) & (F.lower(name) == F.col("name")), "left_semi")
    logged = logged.join(terms.withColumnRenamed("term", "value"), (logged["session_id"] == terms["session_id"]) & (value == F.col("value")), "left_semi")
    hits = logged.select("session_id", "needle", F.lit(True).alias("searched")).distinct()
    answered = F.coalesce(F.col("shown"), F.lit(False)) | F.coalesce(F.col("searched"), F.lit(False))
    return found.join(hits, ["session_id", "needle"], "left").groupBy("session_id").agg(F.count("*").alias("needles"), F.count_if(answered).alias("answered"), F.count_if(~answered).alias("failed"))
