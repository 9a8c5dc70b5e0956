"""SimHash groups, integer k-means and phrase counting against brute force, and their edge cases."""

import hashlib
import random
import re
from collections import Counter

import numpy as np
import pytest
import xxhash
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from sessionloom.llm import centroids, phrases, simhash
from sessionloom.llm.common import stored

SF = "/root/testdata/sf0.001"
ODD = [(1, None), (None, "no id"), (2, ""), (3, "same text here"), (4, "Same TEXT here"), (4, "same text here"), (5, " \n\t "), (6, "é́ ΑΣ 😀 x\x1cy"), (7, "word " * 30_000), (None, None), (8, "two words")]


def lower(text):
    return re.sub("[A-Z]", lambda m: m[0].lower(), text or "")


def components(nodes, linked):
    """Smallest node that each reaches, by plain search."""
    root = {}
    for node in sorted(nodes):
        if node in root:
            continue
        root[node], open_ = node, [node]
        while open_:
            x = open_.pop()
            for y in nodes:
                if y not in root and linked(x, y):
                    root[y] = node
                    open_.append(y)
    return root


def plain_fingerprint(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", lower(text))
    grams = [" ".join(words[i : i + 3]) for i in range(max(1, len(words) - 2))] if words else []
    hashes = [xxhash.xxh64_intdigest(g.encode(), 42) for g in grams]
    return sum(1 << b for b in range(64) if sum(h >> b & 1 for h in hashes) * 2 > len(hashes))


def plain_groups(rows):
    prints = [plain_fingerprint(t) for _, t in rows]
    near = components(set(prints), lambda x, y: (x ^ y).bit_count() <= 3)
    least = {}
    for (i, _), p in zip(rows, prints, strict=True):
        least[near[p]] = min((x for x in (i, least.get(near[p])) if x is not None), default=None)
    return sorted((i, f"{p:016x}", least[near[p]]) for i, p in ((i, p) for (i, _), p in zip(rows, prints, strict=True)) if i is not None), Counter(p for (i, _), p in zip(rows, prints, strict=True) if i is None)


@pytest.mark.parametrize("crowded", [0, 2, 32])
def test_simhash_equals_brute_force(spark, crowded):
    r = random.Random(5)
    base = [[r.choice("abcdefghij") * 2 for _ in range(n)] for n in (4, 6, 300, 400)]
    rows = list(ODD)
    for i in range(160):
        words = list(r.choice(base))
        for _ in range(r.choice([0, 1, 1, 2])):
            words[r.randrange(len(words))] = r.choice("abcdefghijklmnop") * 2
        rows.append((100 + r.randrange(150), " ".join(words)))
    docs = spark.createDataFrame([(i, t, "x", i) for i, t in rows], "doc_id long, text string, fp string, component_id long").repartition(3)
    got = simhash.near_groups(docs, crowded=crowded).select("doc_id", F.lpad(F.lower(F.hex("fingerprint")), 16, "0").alias("f"), "component_id").collect()
    expected, without_id = plain_groups(rows)
    assert sorted((x["doc_id"], x["f"], x["component_id"]) for x in got if x["doc_id"] is not None) == expected
    assert Counter(int(x["f"], 16) for x in got if x["doc_id"] is None) == without_id
    assert len({c for *_, c in expected}) < len({f for _, f, _ in expected})  # some texts link


@pytest.mark.parametrize("crowded", [0, 1, 1000])
def test_simhash_links_of_clustered_bits(spark, crowded):
    """Fingerprints a few random bits from some centres: the components of the links are those of all pairs."""
    r = random.Random(crowded)
    prints = set()
    for centre in (0, (1 << 64) - 1, r.getrandbits(64), r.getrandbits(64)):
        for _ in range(70):
            prints.add(centre ^ sum(1 << b for b in r.sample(range(64), r.choice([0, 1, 2, 4, 5, 6]))))
    signed = {p - (1 << 64) if p >> 63 else p for p in prints}
    fps = stored(spark.createDataFrame([(p,) for p in signed], "fp long"), "fps")
    found = [(x["a"], x["b"]) for x in simhash.links(fps, crowded).collect()]
    bits = lambda x, y: ((x ^ y) & (1 << 64) - 1).bit_count()
    if crowded == 1000:
        assert sorted(found) == sorted((x, y) for x in signed for y in signed if x < y and bits(x, y) <= 3)
    pairs = {*found, *((b, a) for a, b in found)}
    assert components(signed, lambda x, y: (x, y) in pairs) == components(signed, lambda x, y: bits(x, y) <= 3)


def test_crowded_fingerprints_make_no_pairs(spark):
    """A thousand fingerprints that agree in one half: rows grow with them and not with their pairs."""
    r = random.Random(3)
    prints = {r.getrandbits(31) for _ in range(1000)}
    fps = stored(spark.createDataFrame([(p,) for p in prints], "fp long"), "fps")
    found = simhash.links(fps)
    assert found.count() <= 32 * len(prints)
    assert simhash.segments(fps).groupBy("segment").count().filter(F.col("count") == len(prints)).count() == 1


def test_simhash_on_an_empty_table(spark):
    assert simhash.near_groups(spark.createDataFrame([], "doc_id long, text string")).count() == 0


@settings(max_examples=150, deadline=None)
@given(st.integers(0, 10_000), st.integers(1, 6), st.integers(1, 40), st.sampled_from([1, 3, 50, 10**7, (1 << 27) - 1]))
def test_nearest_equals_all_distances(seed, k, n, reach):
    r = np.random.default_rng(seed)
    c, v = r.integers(-reach, reach + 1, (k, 5)), r.integers(-reach, reach + 1, (n, 5))
    c[-1] = c[0]
    v[0] = c[0]
    pivots = c[centroids.choose_pivots(c, 3)]
    far = np.sqrt(np.stack([centroids.squared(v, p[None]) for p in pivots], 1))
    cluster, distance, computed = centroids.nearest(v, far, c, pivots)
    every = [[sum((int(x) - int(y)) ** 2 for x, y in zip(a, b, strict=True)) for b in c] for a in v]
    assert distance.tolist() == [min(d) for d in every] and cluster.tolist() == [d.index(min(d)) for d in every]
    assert n <= computed <= n * k


def test_pivots_spare_distances():
    r = np.random.default_rng(1)
    c = r.integers(-3000, 3000, (16, 64))
    v = c[r.integers(0, 16, 2000)] + r.integers(-20, 20, (2000, 64))
    pivots = c[centroids.choose_pivots(c, 8)]
    far = np.sqrt(np.stack([centroids.squared(v, p[None]) for p in pivots], 1))
    assert centroids.nearest(v, far, c, pivots)[2] < 1.2 * len(v)


def plain_clusters(rows, k, rounds, width, scale=64):
    kept = [(i, [int(np.floor(np.float64(x) * scale)) for x in v]) for i, v in rows if v is not None and len(v) == width and all(x is not None and np.isfinite(x) for x in v)]
    key = lambda x: (x[0] is None, hashlib.sha256(f"1:{x[0]}".encode()).hexdigest() if x[0] is not None else "", x[1])
    c = [v for _, v in sorted(kept, key=key)[:k]]
    nearest = lambda v: min((sum((a - b) ** 2 for a, b in zip(v, x, strict=True)), j) for j, x in enumerate(c))
    for _ in range(rounds):
        own = [nearest(v)[1] for _, v in kept]
        for j in range(len(c)):
            if some := [v for (_, v), o in zip(kept, own, strict=True) if o == j]:
                c[j] = [sum(x) // len(some) for x in zip(*some, strict=True)]
    return sorted(((i if i is not None else -1, *reversed(nearest(v))) for i, v in kept), key=str), c


def test_clusters_equal_brute_force(spark):
    r = random.Random(2)
    rows = [(i, [r.uniform(-2, 2) for _ in range(4)]) for i in range(60)]
    rows += [(None, [0.5, 0.5, 0.5, 0.5]), (3, rows[3][1]), (7, [1.0, -1.0, 0.25, 0.0]), (100, None), (101, []), (102, [1.0, 2.0, 3.0]), (103, [1.0, None, 1.0, 1.0])]
    rows += [(104, [1.0, float("nan"), 1.0, 1.0]), (105, [float("inf"), 1.0, 1.0, 1.0]), (106, [float("-inf")] * 4)]
    vectors = spark.createDataFrame([(i, v, 1, [0.0]) for i, v in rows], "vec_id long, embedding array<double>, cluster int, v array<double>").repartition(3)
    for k in (1, 5, 200):
        assigned, c = centroids.cluster_vectors(vectors, k=k, dimensions=4, n_pivots=2)
        expected, plain = plain_clusters(rows, k, 3, 4)
        assert c.tolist() == plain
        assert sorted(((x["vec_id"] if x["vec_id"] is not None else -1, x["cluster"], x["distance"]) for x in assigned.collect()), key=str) == expected


def test_clusters_of_nothing_and_of_huge_components(spark):
    ddl = "vec_id long, embedding array<float>"
    assert centroids.cluster_vectors(spark.createDataFrame([], ddl))[0].count() == 0
    huge = spark.createDataFrame([(1, [3e38, 1.0]), (2, [1.0, 1.0]), (3, [-3e38, 0.0])], ddl)
    assert [x["vec_id"] for x in centroids.cluster_vectors(huge, dimensions=2)[0].collect()] == [2]


def plain_phrases(rows, least, top):
    counts, n = {}, Counter()
    for lang, text in rows:
        lang = lang if lang is not None else "und"
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", lower(text)):
            words = re.findall(r"[^\x20\x09]+", piece)
            n[lang] += len(words)
            for size in range(1, 5):
                for i in range(len(words) - size + 1):
                    counts.setdefault(lang, Counter())[tuple(words[i : i + size])] += 1
    out = []
    for lang, f in counts.items():
        often = {p: a for p, a in f.items() if a >= least}
        scored = []
        for p, a in often.items():
            if len(p) == 1:
                continue
            longer = [b for q, b in often.items() if len(q) > len(p) and any(q[i : i + len(p)] == p for i in range(len(q) - len(p) + 1))]
            if any(100 * b >= 80 * a for b in longer):
                continue
            score, k = min((2_000_000 * a // (f[p[:k]] + f[p[k:]]), k) for k in range(1, len(p)))
            scored.append((-score, -a, " ".join(p).encode(), f[p[:k]], f[p[k:]]))
        for rank, (score, a, phrase, left, right) in enumerate(sorted(scored)[:top], 1):
            out.append((lang, rank, phrase.decode(), -a, left, right, n[lang], -score))
    return sorted(out)


COLUMNS = ("lang", "rank", "phrase", "a", "l", "r", "n", "score")


@pytest.mark.parametrize(("shards", "slots", "top"), [(1, None, 2000), (3, None, 7), (4, 1 << 6, 2000)])
def test_phrases_equal_brute_force(spark, shards, slots, top):
    r = random.Random(shards)
    texts = [" ".join(r.choice(["a", "b", "c", "D", "éa", "new york", "new york city hall", "x\x1cy", "z,", "z", "."]) for _ in range(r.choice([0, 1, 5, 60]))) for _ in range(90)]
    rows = [(r.choice(["en", "en", "de", None, "und"]), t) for t in texts] + [("en", None), (None, ""), ("fr", "!?\n"), ("en", "b b b b b b b\tb\r\nb"), ("long", "q w " * 3000)]
    docs = spark.createDataFrame([(1, lang, t, "x", 5) for lang, t in rows], "doc_id long, lang string, text string, phrase string, n long").repartition(4)
    got = phrases.phrase_collocations(docs, shards=shards, least=12, top=top, chunk_words=700, slots=slots)
    assert tuple(got.columns) == COLUMNS
    assert sorted(tuple(x) for x in got.collect()) == plain_phrases(rows, 12, top)


def test_every_phrase_is_counted_in_one_cycle(spark):
    """Longer phrases start within the first cycle and end in a later one; each shard is seen once."""
    rows = [("en", "one two three four five. " * 5)] * 40
    docs = spark.createDataFrame([(lang, t) for lang, t in rows], "lang string, text string").repartition(8)
    table = phrases.shard_table(docs, 3, 100)
    done = phrases.count_phrases(table, 3, 30)
    held = [(size, start, n) for x in done.collect() for size, start, n in zip(x["size"], x["start"], np.frombuffer(x["count"], "<i8").tolist(), strict=True)]
    assert {n for _, _, n in held} == {200} and Counter(s for s, _, _ in held) == {1: 5, 2: 4, 3: 3, 4: 2}
    assert {start for size, start, _ in held if size == 1} == {0}
    assert all(start in (size - 1,) for size, start, _ in held)  # reached within one shard each, long before the cycle ends


def test_phrases_of_nothing(spark):
    docs = spark.createDataFrame([], "doc_id long, lang string, text string")
    assert phrases.phrase_collocations(docs).count() == 0
    assert phrases.phrase_collocations(spark.createDataFrame([(None, None)], "lang string, text string")).count() == 0


def test_products_beyond_a_long(spark):
    a = 1 << 60
    found = spark.createDataFrame([("en", "x", 1, a + 2), ("en", "y", 1, a + 1), ("en", "x y", 2, a)], "lang string, phrase string, size int, f long")
    totals = spark.createDataFrame([("en", 4 * a)], "lang string, n long")
    assert [tuple(x) for x in phrases.collocations(found, totals).collect()] == [("en", 1, "x y", a, a + 2, a + 1, 4 * a, 2_000_000 * a // (2 * a + 3))]


def test_a_long_list_of_unlinked_documents_is_searched_in_pairs_of_blocks(spark):
    """Four thousand documents of like size, each a component of its own, and a large component, in one list."""
    from sessionloom.llm import ngram_join

    rows = [(7, i, 100 + i % 5, 3, i) for i in range(4000)] + [(7, 10_000 + i, 102, 3, 10_000) for i in range(3000)]
    lists = stored(spark.createDataFrame(rows, "hash long, node long, n long, place long, label long"), "lists")
    groups = ngram_join.list_groups(lists).persist()
    largest = groups.groupBy("g", "part").count().agg(F.max("count")).first()[0]
    assert largest <= 2.5 * ngram_join.LIST_BLOCK and groups.count() <= 32 * len(rows)
    met = groups.filter("query").select("g", "part", F.col("node").alias("q")).join(groups.filter("not query").select("g", "part", F.col("node").alias("m")), ["g", "part"])
    met = met.filter("q <> m").select(F.least("q", "m").alias("a"), F.greatest("q", "m").alias("b")).distinct()
    assert met.count() == 4000 * 3999 // 2 + 4000 * 3000  # every pair that may link stands together once


def test_long_lists_of_other_sizes_do_not_meet(spark):
    from sessionloom.llm import ngram_join

    rows = [(7, i, 100 if i % 2 else 300, 3, i) for i in range(40)]
    groups = ngram_join.list_groups(stored(spark.createDataFrame(rows, "hash long, node long, n long, place long, label long"), "lists")).collect()
    nodes = {}
    for r in groups:
        nodes.setdefault(r["part"], set()).add(r["node"] % 2)
    assert all(len(x) == 1 for x in nodes.values())


def test_documents_of_one_id_or_none_are_judged_apart(spark):
    from sessionloom.llm import decontaminate

    item = "please compute how many apples the farmer will sell at the market when every basket holds some of them today"
    half = item.split()
    first, second = " ".join(half[:10]), " ".join(half[10:])
    rows = [(1, first), (1, second), (None, first), (None, second), (2, item), (2, item), (None, item), (None, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    bench = spark.createDataFrame([(5, item), (None, item)], "item_id long, text string")
    got = [(r["doc_id"], r["item_id"], r["coverage"]) for r in decontaminate.contaminated(docs, bench).collect()]
    assert sorted(got, key=str) == sorted([(2, 5, 1.0), (2, 5, 1.0), (None, 5, 1.0)], key=str)


def test_thousands_of_items_of_one_template(spark):
    from sessionloom.llm import decontaminate

    items = spark.range(3000).select(F.col("id").alias("item_id"), F.concat(F.lit("tell me what is the sum of "), "id", F.lit(" and "), F.col("id") + 7, F.lit(" when both are taken together")).alias("text"))
    docs = spark.createDataFrame([(1, "tell me what is the sum of 12 and 99 when both are taken together"), (2, "nothing of that kind is said in this text of some words")], "doc_id long, text string")
    found = decontaminate.contaminated(docs, items)
    assert found.groupBy("doc_id").count().collect() == [(1, 3000)]


def test_automata_are_built_in_tasks(spark, monkeypatch):
    from sessionloom.llm import language_id

    samples = {f"l{k}": " ".join("abcdefghij"[(k * i) % 10] * (1 + i % 3) for i in range(60)) for k in range(12)}
    plain = language_id.Parser(tuple(sorted(samples)), tuple(samples[k] for k in sorted(samples)))
    monkeypatch.setattr(language_id.Language, "of", None)  # in this process only
    made = language_id.built(spark, samples)
    texts = ["aab cc dde", "jjj x a", ""]
    assert made.langs == plain.langs and made.phrases(texts).tolist() == plain.phrases(texts).tolist() and np.allclose(made.weights, plain.weights)


def test_held_out_is_never_null(spark, tmp_path):
    from sessionloom.llm import language_id, toxicity

    docs = spark.createDataFrame([(None if k % 5 == 0 else k, f"some text {'bad' if k % 2 else 'good'} number {k}", "en" if k % 3 else "de") for k in range(60)], "doc_id long, text string, lang string")
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(k, 1, k % 2) for k in range(60)], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    for query in (toxicity.op1_toxicity, language_id.op6_language_id):
        got = query(spark, str(tmp_path)).select("doc_id", "held_out").collect()
        assert len(got) == 60 and all(r["held_out"] is not None for r in got) and not any(r["held_out"] for r in got if r["doc_id"] is None)
