"""The pipeline against a plain version of each stage."""

import re
import zlib
from collections import defaultdict

import numpy as np
from pyspark.sql import functions as F

import corpus_pipeline
from sessionloom.llm import secret_scan, toxicity
from sessionloom.llm.common import TextEncoder, word_vocabulary

from .test_operators import SF, brute_groups


def expected_texts(spark):
    docs = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    model = toxicity.learned(spark, SF)
    scores = {r["doc_id"]: r["score"] for r in toxicity.score_texts(spark.read.parquet(f"{SF}/documents.parquet"), model, "score").collect()}
    docs = {i: t for i, t in docs.items() if scores[i] < 0.5}
    docs = {i: docs[i] for i, _, component in brute_groups(sorted(docs.items())) if i == component}
    plain = lambda t: " ".join(re.findall(r"\w+", t.lower()))
    items = [plain(r["text"]) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    docs = {i: t for i, t in docs.items() if not any(x in plain(t) for x in items)}
    scanner = secret_scan.Scanner()
    return {i: secret_scan.masked(t, scanner.spans(t), "[SECRET]") for i, t in docs.items()}


def test_pipeline(spark):
    got = corpus_pipeline.run(spark, SF).collect()
    encoder = TextEncoder(word_vocabulary())
    pieces = defaultdict(dict)
    for r in got:
        pieces[r["doc_id"]][r["piece"]] = (r["start"], r["length"], r["ids_crc32"])
    texts = expected_texts(spark)
    assert set(pieces) == set(texts)
    for i, t in texts.items():
        ids = np.array([*encoder.whole.encode(t, add_special_tokens=False).ids, 0], "<u4")
        parts = [ids[k : k + 2048] for k in range(0, len(ids), 2048)]
        assert pieces[i] == {k: (2048 * k, len(x), zlib.crc32(x.tobytes())) for k, x in enumerate(parts)}
    bins = defaultdict(int)
    for r in got:
        bins[r["sequence_id"]] += r["length"]
    assert max(bins.values()) <= 2048


def test_stages_keep_the_columns(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").limit(40)
    for _, stage in corpus_pipeline.STAGES[:-1]:
        assert stage(spark, docs, SF).dtypes == docs.dtypes


ROWS = [(3, "one two three four five six seven eight nine"), (3, "one two three four five six seven eight nine"), (None, "one two three four five six seven eight nine"), (None, "alone without an id but with words of its own"), (None, "alone without an id but with words of its own"), (4, None), (5, ""), (None, None)]


def test_near_copies_without_an_id_of_their_own(spark):
    """Rows without a doc_id, or with a shared one, are documents like any other: one of each group stays; empty ones stay."""
    docs = spark.createDataFrame([(i, t, "x", 1.5, "y") for i, t in ROWS], "doc_id long, text string, row string, toxicity double, key string")
    got = corpus_pipeline.keep_one_of_each_group(spark, docs, SF)
    assert got.dtypes == docs.dtypes
    assert sorted(((r["doc_id"], r["text"]) for r in got.collect()), key=str) == sorted([ROWS[0], ROWS[3], (4, None), (5, ""), (None, None)], key=str)


def test_contaminated_documents_without_an_id_go(spark):
    item = spark.read.parquet(f"{SF}/benchmark.parquet").first()["text"]
    rows = [(None, f"some words. {item} and more"), (None, "clean words that stay here"), (7, item), (7, "clean words of a shared id"), (8, None), (None, "")]
    docs = spark.createDataFrame([(i, t, "x") for i, t in rows], "doc_id long, text string, key string")
    got = corpus_pipeline.drop_contaminated(spark, docs, SF)
    assert got.dtypes == docs.dtypes and sorted(((r["doc_id"], r["text"]) for r in got.collect()), key=str) == sorted([rows[1], *rows[3:]], key=str)


def test_own_columns_pass_through(spark):
    """Columns with the names of helpers keep their values, in every stage but the last."""
    docs = spark.read.parquet(f"{SF}/documents.parquet").limit(30)
    for c in ("toxicity", "row", "key", "secret_spans", "score"):
        docs = docs.withColumn(c, F.lit(f"own {c}"))
    for _, stage in corpus_pipeline.STAGES[:-1]:
        got = stage(spark, docs, SF)
        assert got.dtypes == docs.dtypes and {tuple(r) for r in got.select("toxicity", "row", "key", "secret_spans", "score").distinct().collect()} == {("own toxicity", "own row", "own key", "own secret_spans", "own score")}


def test_empty_documents(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").limit(0)
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, docs, SF).collect() == []


def test_a_missing_library_is_an_error(monkeypatch):
    """The entry passes over the absence of the subpackage itself, not of what it needs."""
    import sys

    import pytest

    import __spark_entry__ as entry

    for name in [n for n in sys.modules if n == "corpus_pipeline" or n.startswith("sessionloom.llm")]:
        monkeypatch.delitem(sys.modules, name)
    monkeypatch.setitem(sys.modules, "zstandard", None)
    with pytest.raises(ModuleNotFoundError):
        entry._training_data()
