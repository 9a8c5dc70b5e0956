"""Cut points, tiers of a rendered history, slices of long texts and redaction before a cut, against plain rules."""

import math
import random
import re

import pytest

from sessionloom.functions import redact as R
from sessionloom.functions import scalars as S
from sessionloom.operators import policy as G
from sessionloom.operators import views as V
from sessionloom.sources import sessions as A
from pyspark.sql import functions as F

TURN = {"u": "user", "a": "assistant", "t": "toolResult", "c": "custom"}


def plain_cut(roles, tokens, keep):
    """Walks from the newest row back, as the rule is told; rows count from 1."""
    at, tail = len(roles), 0
    while at > 1:
        tail += tokens[at - 1] or 0
        if tail >= keep:
            break
        at -= 1
    users = [k for k, r in enumerate(roles, 1) if r == "u"]
    before = [k for k in users if k <= at]
    if not before:
        return min((k for k in users if k > at), default=None)
    if before[-1] > 1 or at == 1:
        return before[-1]
    return max((k for k in range(2, at + 1) if roles[k - 1] != "t"), default=None)


def test_cut_index(spark):
    r = random.Random(4)
    cases = [("uata", 60, [50] * 4, 2), ("aaua", 110, [50] * 4, 3), ("utttt", 60, [50] * 5, None), ("aaaa", 60, [50] * 4, None), ("u", 10, [5], 1)]
    cases += [(roles, 60, [r.choice([10, 30, None]) for _ in roles], None) for roles in ("".join(r.choice("uattc") for _ in range(r.randint(1, 9))) for _ in range(120))]
    rows = [(f"s{k}-{keep}", i, TURN[x], tokens[i - 1]) for k, (roles, keep, tokens, _) in enumerate(cases) for i, x in enumerate(roles, 1)]
    m = spark.createDataFrame(rows, "session_id string, row_id long, role string, tokens long")
    got = {x["session_id"]: x["cut"] for keep in (60, 110, 10) for x in G.cut_index(m.filter(F.col("session_id").endswith(f"-{keep}")), keep).collect()}
    for k, (roles, keep, tokens, told) in enumerate(cases):
        assert got[f"s{k}-{keep}"] == plain_cut(roles, tokens, keep), (roles, tokens)
        assert k > 4 or told == plain_cut(roles, tokens, keep)


def test_tiers_equal_a_walk_over_the_nodes(spark):
    r = random.Random(6)
    nodes = {f"s{s}": [(i, "x " * r.randint(0, 400), "y " * r.randint(200, 600) if r.random() < 0.5 else None) for i in range(r.randint(1, 6))] for s in range(40)}
    rows = [(s, i, 0, "a", "b", i, t, th) for s, own in nodes.items() for i, t, th in own]
    f = spark.createDataFrame(rows, "session_id string, id long, depth int, first_entry_id string, last_entry_id string, position long, text string, thorough string")
    got = {(x["session_id"], x["id"]): (x["tier"], x["rendered"]) for x in G.degrade(f, 300).collect()}
    for s, own in nodes.items():
        tiers = {i: "rich" for i, *_ in own}
        body = lambda i, t, th, tier: {"rich": th if th is not None else t, "terse": t}.get(tier, f"{re.sub(r'\s+', ' ', t).strip()[:200]} [lcm:stub, {len(t)} chars elided; lcm_describe({i}) has the full summary]")
        text = lambda: "\n\n".join(f"[lcm:summary #{i} depth 0 span a..b]\n{body(i, t, th, tiers[i])}" for i, t, th in own)
        for i, _, th in own:
            for tier in ("terse", "stub") if th is not None else ("stub",):
                if math.ceil(len(text()) / 4) > 300:
                    tiers[i] = tier
        assert {i: got[s, i][0] for i, *_ in own} == tiers
        assert "\n\n".join(got[s, i][1] for i, *_ in own) == text()


@pytest.mark.parametrize(
    ("text", "end"),
    [("x" * 95 + " " + "yyyy" + " zz", 100), ("x" * 96 + "\n\n" + "y" * 9, 98), ("x" * 50 + " " + "y" * 80, 100), ("x" * 99 + "\r\n" + "y" * 9, 100), ("x" * 100, 100), ("x" * 98 + ". " + "y" * 9, 100), ("x" * 94 + " " + "y" * 20, 100)],
)
def test_slices_end_at_a_boundary(text, end):
    assert V.slice_end(text, 0, 100) == end


def test_line_breaks_stay_whole():
    assert V.slice_end("x" * 9 + "\r\n" + "y" * 9, 0, 10) in (9, 10) and V.slice_end("\r\n", 0, 1) == 1


def test_a_secret_across_a_cut_is_gone(spark):
    secret = "sk-" + "a1" * 20
    texts = ["w" * 390 + " " + secret, f"token={'9a' * 10} " * 30, "\ufdd0 password: abcd1234efgh \ufdd1\ufdd3\ufdd2", None]
    df = spark.createDataFrame([(k, t) for k, t in enumerate(texts)], "k long, t string")
    part, *_ = S.char_window(F.col("t"), F.lit(380), 30)
    rows = df.select("k", S.snippet(F.col("t")).alias("line"), part.alias("part"), R.redact(F.col("t")).alias("whole")).orderBy("k").collect()
    assert all("a1a1" not in (r["line"] or "") and "a1a1" not in (r["part"] or "") and "9a9a" not in (r["line"] or "") for r in rows)
    assert rows[2]["whole"] == f"\ufdd0 password: {R.REDACTED} \ufdd1\ufdd3\ufdd2" and rows[3]["whole"] is None


def test_json_of_any_shape_is_sanitized(spark):
    line = '{"a": {"error": ["token=abcd12345678", {"note": "password: abc12345xyz", "p": "/home/me/x"}], "n": 1.5}, "t": "token=abcd12345678", "q": "say \\"hi\\"", "w": "C:/x", "z": null}'
    got = spark.createDataFrame([(line,), (None,), ("not json",)], "line string").select(A.sanitized_json(F.col("line"), "/home/me").alias("x")).collect()
    assert got[0]["x"] == '{"a": {"error": ["token=[REDACTED]", {"note": "password: [REDACTED]", "p": "~/x"}], "n": 1.5}, "t": "token=abcd12345678", "q": "say \\"hi\\"", "w": "<path>", "z": null}'
    assert got[1]["x"] is None and got[2]["x"] == "not json"
