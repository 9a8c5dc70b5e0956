"""Queries read as trees, and what they find."""

import pytest

from sessionloom.operators import search as E

ROWS = [("s", 1, "the API key is set", None), ("s", 2, "set api_key now, then api_key again", None), ("s", 3, "nothing here", None), ("s", 4, "the key was removed", 5), ("s", 5, "keys and keyrings", None), ("t", 1, "a key", None)]


def leaf(*terms, prefix=False):
    return E.Leaf(terms, prefix)


@pytest.mark.parametrize(
    ("text", "tree"),
    [
        ("a b", E.Both("AND", leaf("a"), leaf("b"))),
        ("a OR b c", E.Both("OR", leaf("a"), E.Both("AND", leaf("b"), leaf("c")))),
        ("a OR b AND c NOT d", E.Both("OR", leaf("a"), E.Both("AND", leaf("b"), E.Both("NOT", leaf("c"), leaf("d"))))),
        ("(a OR b) api_key", E.Both("AND", E.Both("OR", leaf("a"), leaf("b")), leaf("api", "key"))),
        ('"Look AT" ke*', E.Both("AND", leaf("look", "at"), leaf("ke", prefix=True))),
        ('"two wo"*', leaf("two", "wo", prefix=True)),
        ("and or not", E.Both("AND", E.Both("AND", leaf("and"), leaf("or")), leaf("not"))),
        *[(bad, None) for bad in ('"a', "a AND", "NOT a", "(a", "a)", "a + b", "()", "a (", '""', "", "a OR OR b")],
    ],
)
def test_read_query(text, tree):
    assert E.read_query(text) == tree


def test_what_queries_find(spark):
    m = spark.createDataFrame(ROWS, "session_id string, row_id long, text string, removed_at_ms long")
    found = lambda q, **k: sorted((r["session_id"], r["row_id"]) for r in E.search_query(m, q, **k).collect())
    assert found("api_key") == found('"api key"') == found("api key") == [("s", 1), ("s", 2)]
    assert found("key NOT api") == [("t", 1)] and found("key NOT api", removed=True) == [("s", 4), ("t", 1)]
    assert found("key*") == [("s", 1), ("s", 2), ("s", 5), ("t", 1)]
    assert found("set OR nothing") == [("s", 1), ("s", 2), ("s", 3)] and found('"is set') == [("s", 1)]
    best = [(r["row_id"], r["rank"]) for r in E.search_query(m, "api_key", limit=1).collect()]
    assert best == [(2, 1)]  # it holds the phrase twice
    assert [(r["row_id"], r["rank"]) for r in E.search_query(m, "api_key", offset=1, limit=5).collect()] == [(1, 2)]
    with pytest.raises(ValueError):
        E.search_query(m, "!?")
