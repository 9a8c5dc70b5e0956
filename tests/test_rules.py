"""Small hand-made cases of single rules."""

import random
import sys

import pytest
from pyspark.sql import functions as F

from sessionloom.functions import redact as R
from sessionloom.functions import scalars as S
from sessionloom.operators import compact as P
from sessionloom.operators import heal as J
from sessionloom.operators import ingest as C
from sessionloom.operators import search as E
from sessionloom.operators import views as V
from sessionloom.streaming import ingest as N


def values(spark, texts, column):
    return [r[0] for r in spark.createDataFrame([(t,) for t in texts], "x string").select(column(F.col("x"))).collect()]


def test_redaction(spark):
    texts = ["API_KEY=abcdefgh", "key = abcdefgh", "key = abcdefg1", 'token: "abcdefgh1"', "sk-" + "a" * 20, "password", None, "const keyword = items.reduce("]
    assert values(spark, texts, R.redact) == ["API_KEY=[REDACTED]", "key = abcdefgh", "key = [REDACTED]", 'token: "[REDACTED]"', "[REDACTED]", "password", None, "const keyword = items.reduce("]
    assert values(spark, ["API_KEY=abcdefgh"], lambda c: R.redact(c, enabled=False)) == ["API_KEY=abcdefgh"]


def test_windows_and_failures(spark):
    texts = ["prompt is too long: 210,000 tokens > 200,000 maximum", "maximum context length is 128000 tokens", "exceeds the limit of 12", "nothing", None]
    assert values(spark, texts, S.window_from_error) == [200_000, 128_000, None, None, None]
    assert values(spark, ["401", "rate limit", "502 Bad Gateway", "aborted", "output limit", "?", None], S.classify_failure) == ["auth", "rate-limit", "unavailable", "timeout", "length", "unknown", "unknown"]


def test_tool_names(spark):
    rows = [("assistant", "[tool:Read] {}\n[tool:Grep] {}"), ("assistant", "I call\n[tool:Read] {}"), ("toolResult", "\ntool Bash ls"), ("toolResult", "x\n[tool:Read]"), ("user", "tool Read")]
    got = spark.createDataFrame(rows, "role string, text string").select(S.tool_name(F.col("text"), F.col("role"))).collect()
    assert [r[0] for r in got] == ["read", None, "bash", None, None]


def test_file_kinds(spark):
    rows = [("a.ts", "[1, 2]"), ("a.txt", '{"a":1}\n{"b":2}'), ("a.md", "x,y\n1,2"), ("a", "x\ty\n1\t2"), ("b.py", "print(1)"), (".py", "print(1)")]
    got = spark.createDataFrame(rows, "p string, t string").select(S.file_kind(F.col("p"), F.col("t"))).collect()
    assert [r[0] for r in got] == ["json", "jsonl", "csv", "tsv", "code", "text"]


def test_trim_and_length(spark):
    assert values(spark, ["  x\t\n"], S.trimmed) == ["x"]
    assert values(spark, ["a\U0001f600b"], S.utf16_length) == [4]


def test_chunks_stay_within_budget_unless_single(spark):
    rows = [("s", i, t) for i, t in enumerate([5, 5, 20, 1, 1, 30, 2], 1)] + [("s", 20, 1)]
    got = P.chunk_contiguous(spark.createDataFrame(rows, "session_id string, row_id long, tokens long"), 10)
    assert {r["row_id"]: r["chunk"] for r in got.collect()} == {1: 0, 2: 0, 3: 1, 4: 2, 5: 2, 6: 3, 7: 4, 20: 5}


def test_shares_fill_the_budget(spark):
    rows = [("s", 1, i, c) for i, c in enumerate([10, 100, 1000, 1000])]
    got = {r["item"]: r["share"] for r in J.share_chars(spark.createDataFrame(rows, "session_id string, node long, item long, chars long"), 510).collect()}
    assert got == {0: 10, 1: 100, 2: 200, 3: 200}
    small = {r["item"]: r["share"] for r in J.share_chars(spark.createDataFrame(rows, "session_id string, node long, item long, chars long"), 5000).collect()}
    assert small == {0: 10, 1: 100, 2: 1000, 3: 1000}


def test_ingest_again_adds_nothing(spark):
    rows = spark.createDataFrame([("s", "a", 1, "user", "hi"), ("s", "a", 2, "user", "other"), ("s", "b", 3, "odd", "x"), ("s", "", 4, "user", "x"), ("s", "c", 5, "user", " ")], "session_id string, entry_id string, pos long, role string, text string")
    none = spark.createDataFrame([], "session_id string, entry_id string, row_id long")
    first = C.insert_new(none, rows)
    assert [(r["entry_id"], r["row_id"], r["role"], r["text"]) for r in first.orderBy("row_id").collect()] == [("a", 1, "user", "hi"), ("b", 2, "custom", "x")]
    assert C.insert_new(first, rows).count() == 0


def test_streams(spark, tmp_path):
    rows = [("s", i, 100 * i, 25 * i) for i in range(1, 12)]
    source = tmp_path / "in"
    spark.createDataFrame(rows, "session string, pos long, chars long, tokens long").coalesce(1).write.parquet(str(source))
    stream = spark.readStream.schema("session string, pos long, chars long, tokens long").parquet(str(source))
    q = N.running_samples(stream).writeStream.format("memory").queryName("running").outputMode("update").option("checkpointLocation", str(tmp_path / "state")).trigger(availableNow=True).start()
    q.awaitTermination()
    assert [tuple(r) for r in spark.sql("select * from running").collect()] == [("s", 8, 4.0)]


def test_planted_needles(spark):
    from sessionloom.operators.evaluation import plant

    rows = [(f"s{n}", k, "user", f"text of row {k}") for n in (1, 5, 48) for k in range(1, n + 1)]
    got = plant(spark.createDataFrame(rows, "session_id string, row_id long, role string, text string"), 6).filter("needle is not null").collect()
    places = {s: sorted(r["row_id"] for r in got if r["session_id"] == s) for s in ("s1", "s5", "s48")}
    assert places == {"s1": [1], "s5": [1, 2, 3, 4, 5], "s48": [1, 9, 17, 25, 33, 41]}
    assert all(f" {r['needle']} " in r["text"] for r in got) and {r["needle"][:4] for r in got if r["session_id"] == "s48"} == {f"N0{i}=" for i in range(6)}


def test_heal_windows_end_at_breaks(spark):
    from sessionloom.operators.views import heal_windows

    text = "word " * 500
    got = heal_windows(spark.createDataFrame([(1, text), (2, ""), (3, "x" * 250)], "node long, text string"), 100).orderBy("node", "window").collect()
    assert "".join(text[r["start"] : r["end"]] for r in got if r["node"] == 1) == text
    assert [(r["start"], r["end"]) for r in got if r["node"] == 3] == [(0, 100), (100, 200), (200, 250)]


def test_search_reads_whole_texts(spark):
    long = "x " * 110_000 + "needle end " + "the " * 150
    rows = spark.createDataFrame([("s", 1, "user", long), ("s", 2, "user", "short text")], "session_id string, row_id long, role string, text string")
    assert [r["row_id"] for r in E.ranked_search(rows, ["needle"]).collect()] == [1] == [r["row_id"] for r in E.phrase_hits(rows, ["needle", "end"]).collect()]
    assert E.ranked_search(rows, ["needle"], indexed_chars=1000).count() == E.phrase_hits(rows, ["needle", "end"], indexed_chars=1000).count() == 0
    assert [tuple(r) for r in E.regex_scan(rows, "the").collect()] == [("s", 1, long.index("the"), 150, False)]
    assert [tuple(r) for r in E.regex_scan(rows, "x", scanned_chars=400, most_matches=100).collect() if r["row_id"] == 1] == [("s", 1, 0, 100, True)]


def test_assignments_equal_a_plain_scan(spark):
    """One pass from left to right per shape, in which an assignment that stays takes up its characters."""
    import re

    name = r"\b[a-z0-9_-]*(?:key|token|secret|password|passwd|credential)[a-z0-9_-]*\b[\"']?\s*[:=]\s*"
    shapes = (re.compile(rf"({name}[\"'])([^\s\"']{{8,}})", re.I), re.compile(rf"({name})([A-Za-z0-9_+/\-@#$%^&*!~]{{8,}})", re.I))

    def judged(m):
        return m[1] + R.REDACTED if re.search(r"\S=[\"']?\s*$", m[1]) or re.search("[0-9]", m[2]) else m[0]

    def plain(text):
        for shape in shapes:
            text = shape.sub(judged, text)
        return text

    pieces = ["token", "my_key", "secret-key", " ", "=", ":", '"', "'", "abcdefgh", "abc12345", "password", "x", "\n", "longer-value-here", "9", "API_TOKEN", "="]
    r = random.Random(8)
    texts = ["".join(r.choice(pieces) for _ in range(r.randint(1, 14))) for _ in range(3000)] + ["token: password=abc12345", "key= 'abcdefgh'", None, ""]
    got = spark.createDataFrame([(k, t) for k, t in enumerate(texts)], "k long, t string").select("k", R.redact(F.col("t")).alias("t")).collect()
    assert [(r["k"], texts[r["k"]], r["t"]) for r in got if r["t"] != (None if texts[r["k"]] is None else plain(texts[r["k"]]))] == []


def test_condensing_equals_a_plain_loop(spark):
    """Runs of equal depth, the shallowest and oldest first, become one node until all fits."""
    r = random.Random(2)
    rows = [(f"s{s}", p, r.randint(0, 2), r.randint(1, 40)) for s in range(60) for p in range(r.randint(1, 25))]
    got = {x["session_id"]: (x["nodes"], x["deepest"], x["tokens"]) for x in P.condense_counts(spark.createDataFrame(rows, "session_id string, position long, depth long, tokens long"), 60, most_depth=4, fan_out=3, node_tokens=9).collect()}
    for s in {x[0] for x in rows}:
        nodes = [[d, t] for q, _, d, t in rows if q == s]
        while sum(t for _, t in nodes) > 60:
            starts = [k for k in range(len(nodes) - 1) if nodes[k][0] == nodes[k + 1][0] and (k == 0 or nodes[k - 1][0] != nodes[k][0]) and nodes[k][0] < 4]
            if not starts:
                break
            k = min(starts, key=lambda x: (nodes[x][0], x))
            n = 1
            while n < 3 and k + n < len(nodes) and nodes[k + n][0] == nodes[k][0]:
                n += 1
            nodes[k : k + n] = [[nodes[k][0] + 1, min(9, sum(t for _, t in nodes[k : k + n]))]]
        assert got[s] == (len(nodes), max(d for d, _ in nodes), sum(t for _, t in nodes)), s


def test_scans_and_filters_are_refused(spark):
    m = spark.createDataFrame([("s", 1, "user", "xfoo foo aXa", 5)], "session_id string, row_id long, role string, text string, ts_ms long")
    assert E.regex_scan(m, r"\bfoo").first()["at"] == 5 and E.regex_scan(m, r"(?<=a)x(a)\b").first()["at"] == 10 and E.regex_scan(m, "(x)foo( )foo|\\1").first()["at"] == 0
    assert E.regex_scan(m, "FOO").count() == 1 and E.regex_scan(m, "FOO", case_sensitive=True).count() == 0
    for pattern in ("", "x*", "a?|b", "^"):
        with pytest.raises(ValueError):
            E.regex_scan(m, pattern)
    for wrong in ({"role": "robot"}, {"start_ms": -1}, {"end_ms": float("nan")}, {"tool": " "}):
        with pytest.raises(ValueError):
            E.filtered(m, **wrong)
    with pytest.raises(ValueError):
        E.search_query(m, '"(')


def test_long_texts_are_searched_whole(spark):
    m = spark.createDataFrame([("s", 1, "user", "word " * 60_000 + "needle", 5)], "session_id string, row_id long, role string, text string, ts_ms long")
    assert E.ranked_search(m, ["needle"]).count() == 1 and E.regex_scan(m, "need[l]e").first()["at"] == 300_000 and E.search_query(m, '"word needle"').count() == 1


def test_null_texts_have_no_windows(spark):
    assert V.heal_windows(spark.createDataFrame([(1, None), (2, ""), (3, "x" * 5)], "node long, text string"), 4).collect() == [(3, 0, 0, 4), (3, 1, 4, 5)]


def test_redelivered_twins_in_a_stream(spark, tmp_path):
    """Two files with the same entries, one of which holds each twice: one row of each is stored, and a later run adds nothing."""
    rows = [("s", f"e{k}", k, "user", f"text {k}") for k in range(20)]
    ddl = "session_id string, entry_id string, pos long, role string, text string"
    for k, some in enumerate((rows + rows, rows[10:] + [("t", "e1", 1, "user", "other")], rows)):
        spark.createDataFrame(some, ddl).coalesce(1).write.mode("append").parquet(f"file://{tmp_path}/in")
        N.ingest_stream(spark.readStream.schema(ddl).parquet(f"file://{tmp_path}/in"), f"file://{tmp_path}/table", f"file://{tmp_path}/state").awaitTermination()
    got = spark.read.parquet(f"file://{tmp_path}/table")
    assert got.count() == got.select("session_id", "entry_id").distinct().count() == 21 and got.filter("session_id = 's'").agg(F.max("row_id")).first()[0] == 20


def test_chunks_of_a_long_session_stream(spark):
    rows = [("a", k, k % 7) for k in range(1, 30_000) if k % 1000] + [("b", 1, 50), ("b", 2, 1)]
    got = {(r["session_id"], r["row_id"]): r["chunk"] for r in P.chunk_contiguous(spark.createDataFrame(rows, "session_id string, row_id long, tokens long"), 20).collect()}
    chunk, total, last = {"a": -1, "b": -1}, 0, None
    for s, k, t in rows:
        if last != (s, k - 1) or total + t > 20:
            chunk[s], total = chunk[s] + 1, 0
        total, last = total + t, (s, k)
        assert got[s, k] == chunk[s]


def test_entry_without_training_data(monkeypatch):
    import __spark_entry__ as entry

    monkeypatch.setitem(sys.modules, "corpus_pipeline", None)
    assert entry._training_data() == ({}, {})


def test_truncated_leaves_equal_those_of_whole_sources(spark):
    r = random.Random(6)
    rows = [(f"s{s}", k, "user", None if r.random() < 0.05 else "w" * r.choice([0, 3, 40, 900, 9000]), f"e{k}", 3, k // r.choice([4, 4, 4])) for s in range(12) for k in range(1, 30)]
    m = spark.createDataFrame(rows, "session_id string, row_id long, role string, text string, entry_id string, tokens long, chunk long")
    chunked, columns = m.select("session_id", "row_id", "chunk"), ["session_id", "chunk", "first_row", "last_row", "first_entry_id", "last_entry_id", "source_tokens", "text", "tokens", "quality", "level"]
    for tokens in (5, 60, 500):
        whole = P.mechanical_leaves(P.leaf_sources(m.drop("chunk"), chunked, 1000), tokens).select(columns)
        assert sorted(map(str, P.truncated_leaves(m.drop("chunk"), chunked, 1000, tokens).select(columns).collect())) == sorted(map(str, whole.collect()))
