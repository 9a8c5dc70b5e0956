"""What a reviewer found in the fourth round."""

import duckdb
from pyspark.sql import functions as F

from sessionloom import registry
from sessionloom.jobs import host_queries
from sessionloom.llm import simhash
from sessionloom.llm.common import stored
from sessionloom.operators import views as V


def test_exploded_fingerprints_are_not_broadcast(spark):
    """1,057 rows a crowded fingerprint, and the variants of halves, were broadcast where what they come from is small."""
    fps = stored(spark.createDataFrame([(n * 7,) for n in range(200)], "fp long"), "fps")
    for found in (simhash.centre_links(fps), simhash.variant_links(stored(simhash.segments(fps).filter(F.col("segment") >= 1 << 32), "parts"))):
        found.collect()
        plan = found._jdf.queryExecution().executedPlan().toString()
        assert "SortMergeJoin" in plan and "Broadcast" not in plan


def test_windows_of_large_nodes(spark, tmp_path):
    """every node has its windows, however many; texts that are null, empty or without an id have none."""
    texts = {0: "a word. " * 900, 1: "b" * 30_000, 2: "line\n" * 700, 3: "c" * 17_000, 5: "short", 6: None, 7: "", 8: "d e\n\n" * 2_000, 9: "y" * 16_000, None: "no id"}
    folder = tmp_path / "documents.parquet"
    spark.createDataFrame([(n, t) for n, t in texts.items()], "doc_id long, text string").write.parquet(str(folder))
    got = [tuple(r) for r in host_queries.windows(spark, str(tmp_path)).collect()]
    con = duckdb.connect()
    con.sql(f"CREATE VIEW documents AS SELECT * FROM '{folder}/*.parquet'")
    assert sorted(got) == sorted(con.sql(registry.ORACLES["j06_heal_windows"]).fetchall())
    for doc, text in texts.items():
        parts = sorted((part, at, end) for _, item, part, at, end, _ in got if item == doc)
        assert "".join(text[at:end] for _, at, end in parts) == ("" if doc is None else text or "")
    assert {node: max(w for n, *_, w in got if n == node) for node in range(4)} == {0: 20, 1: 8, 2: 4, 3: 7}


def test_windows_up_to_a_limit(spark):
    """a limit that is asked for still leaves out the nodes that need more, and no others."""
    texts = spark.createDataFrame([(n, k, "x" * 60) for n in (7, 8, 9) for k in range(n)], "node long, item long, text string")
    assert sorted({r["node"] for r in V.heal_windows(texts, 100, 8).collect()}) == [7, 8]
    assert sorted({r["node"] for r in V.heal_windows(texts, 100).collect()}) == [7, 8, 9]
