"""Walks up the summary graph, and what heal attempts come to."""

import pytest

from sessionloom.operators import dag, heal

NODES = "session_id string, id long, depth int, quality string, tokens long, status string"
EDGES = "session_id string, summary_id long, child_type string, child_id long"
TRIES = "session_id string, id long, expected_tokens long, new_tokens long, new_level int, source_quality string"


def graph(spark, nodes, edges):
    s = spark.createDataFrame([("s", i, depth, q, 10, "committed") for i, depth, q in nodes], NODES)
    return s, spark.createDataFrame([("s", a, "summary", b) for a, b in edges], EDGES)


def tries(spark, rows):
    return spark.createDataFrame([("s", i, expected, new, level, source) for i, expected, new, level, source in rows], TRIES)


def outcomes(spark, nodes, edges, rows, **more):
    found = heal.heal_outcomes(*graph(spark, nodes, edges), tries(spark, rows), 100, **more).collect()
    return {r["id"]: (r["outcome"], r["reason"], r["quality_after"]) for r in found}


def test_walk_up_a_long_chain_and_around_a_cycle(spark):
    edges = spark.createDataFrame([("s", i, i + 1) for i in range(200)] + [("c", 1, 2), ("c", 2, 3), ("c", 3, 1), ("c", 4, 1)], "session_id string, id long, parent long")
    seeds = spark.createDataFrame([("s", 150), ("s", 150), ("c", 1), ("x", 7)], "session_id string, id long")
    got = sorted((r["session_id"], r["id"]) for r in dag.above(seeds, edges).collect())
    assert got == sorted([("c", 1), ("c", 2), ("c", 3), ("x", 7)] + [("s", i) for i in range(150, 201)])


@pytest.mark.parametrize("attempt", [(1, 10, 40, 3, "clean"), (1, 10, 0, 1, "clean"), (1, 10, 201, 1, "clean"), (1, 10, 40, 1, None), (1, 11, 40, 1, "clean")])
def test_a_failed_or_changed_node_blocks_all_above(spark, attempt):
    nodes = [(1, 0, "mechanical"), (2, 1, "clean"), (3, 2, "mechanical"), (4, 0, "clean")]
    got = outcomes(spark, nodes, [(2, 1), (3, 2), (3, 4)], [attempt, (2, 10, 40, 1, "clean"), (3, 10, 40, 1, "clean")])
    changed = attempt[1] == 11
    assert got[1][0] == ("changed" if changed else "failed") and got[1][2] == "mechanical"
    assert got[2] == ("blocked", "dependency-failed", "derived" if changed else "clean") and got[3] == ("blocked", "dependency-failed", "mechanical") and 4 not in got


def test_a_new_child_lets_its_parent_be_repaired(spark):
    got = outcomes(spark, [(1, 0, "clipped"), (2, 1, "clean")], [(2, 1)], [(1, 10, 40, 1, "clean"), (2, 10, 40, 1, "derived")])
    assert got == {1: ("repaired", None, "clean"), 2: ("improved", None, "derived")}


def test_a_clipped_source_blocks_its_node_but_not_a_mechanical_parent(spark):
    rows = [(1, 10, 40, 1, "clipped"), (2, 10, 40, 1, "clipped"), (3, 10, 40, 1, "clean")]
    got = outcomes(spark, [(1, 0, "clipped"), (2, 1, "mechanical"), (3, 1, "clean")], [(2, 1), (3, 1)], rows, max_nodes=1)
    assert got == {1: ("blocked", "source-over-budget", "clipped"), 2: ("improved", None, "clipped"), 3: ("skipped", "clean", "clean")}


def test_attempts_are_bounded_in_the_order_of_the_plan(spark):
    rows = [(i, 10, 40, 1, "clean") for i in (1, 2, 3)]
    got = outcomes(spark, [(1, 0, "clipped"), (2, 0, "mechanical"), (3, 1, "clean")], [(3, 1), (3, 2)], rows, max_nodes=1)
    assert got == {1: ("notAttempted", None, "clipped"), 2: ("repaired", None, "clean"), 3: ("notAttempted", None, "derived")}
    counts = heal.heal_counts(heal.heal_outcomes(*graph(spark, [(1, 0, "clipped"), (2, 0, "mechanical"), (3, 1, "clean")], [(3, 1), (3, 2)]), tries(spark, rows), 100, 1)).first()
    assert counts.asDict() == {"session_id": "s", "candidates": 3, "tainted": 2, "attempted": 1, "blockedSource": 0, "repaired": 1, "improved": 0, "failed": 0, "blocked": 0, "skipped": 0, "changed": 0, "notAttempted": 2}


def test_no_plan_no_outcomes(spark):
    assert outcomes(spark, [(1, 0, "clean")], [], []) == {}
