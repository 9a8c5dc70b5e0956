"""Whole imports: nothing of a refused session, nothing twice."""

from sessionloom.operators import transfer as H

M = "session_id string, row_id long, entry_id string, role string, text string, tokens long, ts_ms long"
S = "session_id string, id long, kind string, depth int, first_entry_id string, last_entry_id string, tokens long, quality string, status string, run string, text string"
P = "session_id string, summary_id long, child_type string, child_id long"


def store(spark, sessions):
    m = spark.createDataFrame([(x, i, f"{x}{i}", "user", f"text {i}", 2, i) for x in sessions for i in (1, 2, 3)], M)
    s = spark.createDataFrame([(x, i, kind, depth, f"{x}{a}", f"{x}{b}", 2, "clean", "committed", None, "told") for x in sessions for i, kind, depth, a, b in ((5, "leaf", 0, 1, 1), (6, "leaf", 0, 2, 3), (9, "condensed", 1, 1, 3))], S)
    p = spark.createDataFrame([(x, n, kind, c) for x in sessions for n, kind, c in ((5, "message", 1), (6, "message", 2), (6, "message", 3), (9, "summary", 5), (9, "summary", 6))], P)
    return m, s, p


def imported(spark, sent, m, s, alter=None):
    lines = [(r["session_id"], k, r["line"]) for k, r in enumerate(sorted(H.export_rows(*sent).collect(), key=lambda r: (r["session_id"], r["row_type"], r["ordinal"])))]
    lines = spark.createDataFrame([(x, k, alter(x, line) if alter else line) for x, k, line in lines], "session_id string, line_no long, line string")
    return H.import_sessions(H.split_rows(H.parse_lines(lines)), m, s, spark.createDataFrame([], "run string"))


def test_round_trip_and_again(spark):
    m, s, p = store(spark, ["a"])
    none_m, none_s = m.limit(0), s.limit(0)
    first = imported(spark, (m, s, p), none_m, none_s)
    nodes = {r["id"]: (r["kind"], r["depth"], r["first_entry_id"], r["last_entry_id"], r["quality"], r["text"]) for r in first.summaries.collect()}
    assert nodes == {1: ("leaf", 0, "a1", "a1", "clean", "told"), 2: ("leaf", 0, "a2", "a3", "clean", "told"), 3: ("condensed", 1, "a1", "a3", "clean", "told")}
    assert sorted(tuple(r) for r in first.edges.collect()) == [("a", 1, "message", 1), ("a", 2, "message", 2), ("a", 2, "message", 3), ("a", 3, "summary", 1), ("a", 3, "summary", 2)]
    assert [tuple(r) for r in first.report.collect()] == [("a", None, 3, 0, 3, 0)]
    again = imported(spark, (m, s, p), m, s)
    assert again.messages.count() == again.summaries.count() == again.edges.count() == 0
    assert [tuple(r) for r in again.report.collect()] == [("a", None, 0, 3, 0, 3)]


def test_a_refused_session_leaves_nothing(spark):
    m, s, p = store(spark, ["a", "b", "c", "d"])
    spoil = {"a": ('"depth":1', '"depth":0'), "b": ('"v":1,"rowType":"summary"', '"v":2,"rowType":"summary"'), "c": ('"entries":["c2"', '"entries":["other"')}
    got = imported(spark, (m, s, p), m.limit(0), s.limit(0), lambda x, line: line.replace(*spoil.get(x, ("", ""))))
    assert {r["session_id"]: r["refused"] for r in got.report.collect()} == {"a": "child-depth", "b": "line", "c": "summary-entry", "d": None}
    for part in (got.messages, got.summaries, got.edges):
        assert {r["session_id"] for r in part.select("session_id").distinct().collect()} == {"d"}
