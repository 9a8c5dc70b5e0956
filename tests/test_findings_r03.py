"""What a reviewer found in the third round."""

import gzip

import duckdb
from pyspark.sql import functions as F

from sessionloom import registry
from sessionloom.functions import scalars as S
from sessionloom.jobs import host_queries, more_queries
from sessionloom.operators import dag as D
from sessionloom.operators import search
from sessionloom.operators import views as V
from sessionloom.sources import sessions as A


def test_sizes_round_like_printf(spark):
    """ties of the exact value go to the even digit; decimals that only look like ties go where the binary value lies."""
    sizes = [1048576, 262144 * 777, 262144 * 779, 1048576 * 10 - 1, 2**40 + 2**18]
    got = spark.createDataFrame([(n,) for n in sizes], "n long").select(S.fmt_bytes(F.col("n"))).collect()
    assert [r[0] for r in got] == [f"{n / 1048576:.1f}M" for n in sizes] == ["1.0M", "194.2M", "194.8M", "10.0M", "1048576.2M"]
    whole = [*range(1000, 60000, 7), *range(1050, 60000, 100)]
    got = spark.createDataFrame([(n,) for n in whole], "n long").select(S.fmt_tokens(F.col("n")), S.fmt_duration(F.col("n")), S.fmt_tokens(-F.col("n"))).collect()
    assert [tuple(r) for r in got] == [(f"{n / 1000:.1f}k", f"{n / 1000:.1f}s", f"{-n / 1000:.1f}k") for n in whole]


def test_prose_with_equal_commas(spark, tmp_path):
    """documents are texts, whatever their commas."""
    texts = {8: "one, two\nthree, four", 17: "a,b\tc\nd,e\tf", 26: "plain"}
    folder = tmp_path / "documents.parquet"
    spark.createDataFrame([(n, t, "en", "web", 9) for n, t in texts.items()], "doc_id long, text string, lang string, source string, n_chars long").write.parquet(str(folder))
    got = {r["doc_id"]: r["line"] for r in more_queries.structure(spark, str(tmp_path)).collect()}
    con = duckdb.connect()
    con.sql(f"CREATE VIEW documents AS SELECT * FROM '{folder}/*.parquet'")
    assert got == dict(con.sql(registry.ORACLES["b17_structure"]).fetchall())
    assert got[8] == "2 lines, 1 paragraph(s); first line: one, two"


def test_windows_shuffle_behind_the_join(spark):
    """a shuffle by node is dropped behind the join by node, which may turn into a broadcast one at run time; nodes are dealt by another key."""
    texts = spark.createDataFrame([(n // 3, n, "x" * 60) for n in range(40)], "node long, item long, text string")
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        found = V.heal_windows(texts, 100)
        assert "REPARTITION_BY_COL" in found._jdf.queryExecution().executedPlan().toString()
        assert sorted((r["item"], r["window"]) for r in found.collect()) == [(n, n % 3) for n in range(40)]
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)


def test_texts_are_judged_once(spark):
    """strings of a line, what they become and texts to redact are worked out once each, whatever names them."""
    line = '{"note": "password: abcdefg1", "at": "/home/me/x", "to": ["/etc", "C:\\\\x", null], "n": 1}'
    done = spark.createDataFrame([(line,), (None,)], "x string").select(A.sanitized_json(F.col("x"), "/home/me").alias("y"))
    assert [r[0] for r in done.collect()] == ['{"note": "password: [REDACTED]", "at": "~/x", "to": ["<path>", "<path>", null], "n": 1}', None]
    plan = done._jdf.queryExecution().analyzed().toString()
    assert plan.count("split(") == plan.count("aggregate(") == 1 and plan.count("BEGIN [A-Z ]*PRIVATE KEY") == 1


def test_phrases_are_tried_once(spark):
    """a number out of range leaves the word to later phrases, and each phrase stands once in the plan."""
    texts = ["Model with 5000 Maximum Context Length is 9 tokens", "CONTEXT LENGTH (4,096 tokens)", "range of input length should be [1, 32768]", "exceeds the limit of 99999999999999999999", "maximum context length is ,"]
    done = spark.createDataFrame([(t,) for t in texts], "x string").select(S.window_from_error(F.col("x")).alias("y"))
    assert [r[0] for r in done.collect()] == [5000, 4096, 32768, None, None]
    assert done._jdf.queryExecution().analyzed().toString().count("regexp_extract(") == len(S.WINDOW_PHRASES)


def _written(spark):
    rows = spark.createDataFrame([("a/b %41", 2, None), ("a/b %41", 1, '{"type":"session","id":"i","cwd":"/w","timestamp":"2023-11-14T22:13:20Z"}'), ("é", 1, "oops"), *[(f"c{n}", 1, "x" * n) for n in range(30)]], "session_id string, row_id long, line string")
    return host_queries._session_files(spark, "", rows)


def test_inventory_of_written_files(spark):
    """a file a session, whatever its name, in as many folders as tasks."""
    sizes = {r["path"]: r["bytes"] for r in A.read_inventory(spark, _written(spark)).collect()}
    assert sorted(sizes.values()) == sorted([75, 5, *[n + 1 for n in range(30)]])
    assert len({p.rsplit("/", 1)[0] for p in sizes}) <= 4 and sum("a%2Fb%20%2541" in p for p in sizes) == 1


def test_headers_of_written_files(spark):
    """F8: lines stand in order, so the first one is the header."""
    found = A.read_session_headers(spark, _written(spark)).collect()
    assert [(r["session_id"], r["cwd"], r["when_ms"]) for r in found] == [("i", "/w", 1_700_000_000_000)] and found[0]["file"].count("part-") == 1


def _header(name):
    return f'{{"type":"session","id":"{name}","cwd":"/w","timestamp":"none"}}'.encode()


def test_headers_of_files_of_any_length(spark, tmp_path):
    """F8: a file is read to the end of its first line, not of its second one of 3 GB (a hole on disk)."""
    (tmp_path / "a.txt").write_bytes(_header("a" * 50_000) + b"\n")
    with (tmp_path / "a.txt").open("r+b") as f:
        f.truncate(3 << 30)
    found = A.read_session_headers(spark, f"file://{tmp_path}").collect()
    assert [r["session_id"] for r in found] == ["a" * 50_000]


def test_tasks_of_many_files(spark, tmp_path):
    """F8: tasks are as many as a shuffle has, not more with each few files, and Spark lists none on the driver."""
    for n in range(300):
        (tmp_path / f"d{n % 3}").mkdir(exist_ok=True)
        (tmp_path / f"d{n % 3}" / f"{n}.txt").write_bytes(_header(n) + b"\nx\n")
    for found in (A.read_session_headers(spark, str(tmp_path)), A.read_inventory(spark, str(tmp_path))):
        assert "FileScan" not in found._jdf.queryExecution().executedPlan().toString() and found.count() == 300
        assert found.rdd.getNumPartitions() <= int(spark.conf.get("spark.sql.shuffle.partitions"))


def test_files_are_those_of_sparks_readers(spark, tmp_path, monkeypatch):
    """F8: names, times, sizes and first lines are what Spark's own readers give; these still take what Arrow can't open, and pass over empty files."""
    for name in ("a.txt", "é +&=;,'()!~$@.txt", "b %41#?[x]{y}^`|<>\"\\.txt", "sub/deep/c.txt", "session_id=1/_d=2.txt", ".hidden.txt", "_hidden/e.txt", ".h/f.txt", "g.txt._COPYING_"):
        (tmp_path / name).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / name).write_bytes(_header(len(name)) + b"\r\n" + _header("second") + b"\n")
    (tmp_path / "bom.txt").write_bytes(b"\xef\xbb\xbf" + _header("bom"))
    (tmp_path / "return.txt").write_bytes(_header("return") + b"\rx")
    (tmp_path / "z.txt.gz").write_bytes(gzip.compress(_header("z") + b"\n"))
    for name, content in (("none.txt", b""), ("blank.txt", b"\n" + _header("late")), ("odd.txt", b"\xff\xfe\n")):
        (tmp_path / name).write_bytes(content)
    (tmp_path / "empty").mkdir()

    def both(path):
        return [sorted(map(tuple, f(spark, path).collect())) for f in (A.read_session_headers, A.read_inventory)]

    assert A._uri(spark, str(tmp_path)) and not any(A._uri(spark, x) for x in ("viewfs://store/in", "here", f"{tmp_path}/*", f"{tmp_path}/a.txt", f"{tmp_path}/gone"))
    paths = (str(tmp_path), f"file://{tmp_path}/", f"file:{tmp_path}")
    ours = [both(x) for x in paths]
    single = A.read_session_headers(spark, f"{tmp_path}/a.txt").collect()
    monkeypatch.setattr(A, "_uri", lambda *_: None)
    empty = [r for r in ours[0][1] if not r[1]]
    assert len(ours[0][0]) == 8 and len(ours[0][1]) == 11 and [r[0] for r in empty] == [f"file:{tmp_path}/none.txt"]
    assert ours == [[headers, sorted(found + empty)] for headers, found in map(both, paths)]
    assert [r["session_id"] for r in single] == ["5"]


def test_source_facts_of_scattered_rows(spark, tmp_path):
    """where the join of texts with their nodes turns into a broadcast one at run time, a node's texts stay together all the same."""
    rows = [(n, turn, "user", f"{turn} " + "word " * (20 + (n + turn) % 30)) for n in range(400) for turn in range(7)]
    folder = tmp_path / "conversations.parquet"
    spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").repartition(8).write.parquet(str(folder))
    con = duckdb.connect()
    con.sql(f"CREATE VIEW conversations AS SELECT * FROM '{folder}/*.parquet'")
    expected = con.sql(registry.ORACLES["j05_source_facts"]).fetchall()
    before = {k: spark.conf.get(k) for k in ("spark.sql.autoBroadcastJoinThreshold", "spark.sql.shuffle.partitions", "spark.sql.adaptive.coalescePartitions.enabled")}
    try:
        for k, v in zip(before, ("100k", "7", "false"), strict=True):
            spark.conf.set(k, v)
        got = [tuple(r) for r in host_queries.source_facts(spark, str(tmp_path)).collect()]
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)
    assert sorted(map(str, got)) == sorted(map(str, expected)) and {r[-1] for r in got} == {None, 2, 3}


def test_shortcuts_are_no_more_than_edges(spark, monkeypatch):
    """each kind of shortcut in a chain has fewer rows than the chain's edges, and sessions without a seed take no part."""
    sizes, cut = [], D.cut_lineage
    monkeypatch.setattr(D, "cut_lineage", lambda df: (done := cut(df), sizes.append(done.count()))[0])
    edges = [("s", n, n + 1) for n in range(60)] + [("t", n, n + 1) for n in range(60)]
    random = [("r", a, (a * 7 + k * 11) % 97) for a in range(97) for k in range(a % 3)] + [("r", a, a + 1) for a in range(200, 245)] + [("r", 245, 210), ("r", 230, 5)]
    found = D.above(spark.createDataFrame([("s", 2), ("r", 203)], "session_id string, id long"), spark.createDataFrame(edges + random, "session_id string, id long, parent long"))
    seen, todo = {("s", 2), ("r", 203)}, [("s", 2), ("r", 203)]
    while todo:
        s, n = todo.pop()
        new = {(s, b) for x, a, b in edges + random if (x, a) == (s, n)} - seen
        seen, todo = seen | new, todo + list(new)
    got = [tuple(r) for r in found.collect()]
    assert sorted(got) == sorted(seen)
    sizes.clear()
    D.above(spark.createDataFrame([("s", 2)], "session_id string, id long"), spark.createDataFrame(edges, "session_id string, id long, parent long"))
    assert max(sizes) == 60


def test_phrases_of_long_texts(spark):
    """TESTS: a filter on the count of a phrase splits a text once, not once for each of its terms."""
    rows = spark.createDataFrame([("s", 1, "a b a b c " * 400), ("s", 2, "b a"), ("s", 3, None)], "session_id string, row_id long, text string")
    found = search.search_query(rows, '"a b a"')
    filters = [line for line in found._jdf.queryExecution().optimizedPlan().toString().splitlines() if "Filter " in line and "split(" in line]
    assert filters and all(line.count("split(") == 1 for line in filters)
    assert [r["row_id"] for r in found.collect()] == [1] and [r["row_id"] for r in search.search_query(rows, '"a b" OR "b a"').orderBy("row_id").collect()] == [1, 2]
