"""Operators against brute force, round trips and held-out accuracy, and their edge cases."""

import hashlib
import random
import re
import struct
import zlib
from collections import defaultdict
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from sessionloom.llm import audio, automaton, decontaminate, language_id, ngram_join, packing, secret_scan, substring_dedup, token_store, toxicity, warc
from sessionloom.llm.common import TextEncoder, hot_join, stored, text_encoder, word_vocabulary, work_path

SF = "/root/testdata/sf0.001"
ODD = [(1, None), (None, "no id"), (2, ""), (3, "same text here"), (4, "same text here"), (4, "same text here"), (5, " \n\t "), (6, "é́ ΑΣ 😀 <|endoftext|> don't we're !!'s x" * 3), (7, "word " * 30_000)]
DDL = "doc_id long, text string, extra string"


def docs(spark, rows):
    return spark.createDataFrame([(i, t, "x") for i, t in rows], DDL)


def words(text):
    return re.findall(r"[^\x20\x09-\x0D]+", text or "")


@pytest.fixture(scope="module")
def encoder():
    return TextEncoder(word_vocabulary())


pieces_of_text = st.text(alphabet=st.sampled_from("aAéÉ ́ΣσİǅñÑß1²٣ \n\t\x1c\x85 '!.,stmdrevl|<>😀가힣ﬁ"), max_size=60)


@settings(max_examples=300, deadline=None)
@given(st.lists(pieces_of_text, max_size=4))
def test_encoder_equals_whole_texts(texts):
    e = text_encoder(word_vocabulary())
    for text, blob in zip(texts, e.encode(texts), strict=True):
        assert np.frombuffer(blob, e.dtype).tolist() == e.whole.encode(text, add_special_tokens=False).ids


@settings(max_examples=200, deadline=None)
@given(st.lists(st.integers(0, 3000), max_size=700))
def test_elias_fano(steps):
    values = np.cumsum(steps) if steps else np.empty(0, int)
    code, end = token_store.EliasFano.parse(memoryview(b"xx" + token_store.EliasFano.of(values).to_bytes() + b"y"), 2)
    assert [code.select(i) for i in range(len(values))] == values.tolist()
    with pytest.raises(IndexError):
        code.select(len(values))


def test_token_store(spark, encoder):
    path = work_path(spark, "test")
    token_store.write_tokens(docs(spark, ODD), path, word_vocabulary(), segment_ids=50)
    got = token_store.read_tokens(spark, path, token_store.digests, "doc_id long,start long,n_tokens long,ids_crc32 long").collect()
    at = 0
    rows = sorted(ODD, key=lambda r: (r[0] is not None, r[0] or 0, r[1] or ""))
    assert [r["doc_id"] for r in sorted(got, key=lambda r: r["start"])] == [r[0] for r in rows]
    for (_, text), r in zip(rows, sorted(got, key=lambda r: r["start"]), strict=True):
        ids = encoder.whole.encode(text or "", add_special_tokens=False).ids + [1]
        assert (r["start"], r["n_tokens"], r["ids_crc32"]) == (at, len(ids), zlib.crc32(struct.pack(f"<{len(ids)}I", *ids)))
        at += len(ids)
    raw = spark.read.parquet(path).filter("n_docs > 0").first()["data"]
    segment = token_store.Segment(bytes(raw))
    assert sum(len(segment.doc(i)) for i in range(segment.n_docs)) == segment.n_ids


def test_offsets_come_from_the_stored_codes(monkeypatch):
    """A digest follows what select says of the stored codes, and asks for each document's bounds only."""
    raw = token_store.Segment.pack([3, 5, 9], [b"\1\0\2\0", b"\3\0", b"\4\0\5\0\6\0"], 2)
    asked, plain = [], token_store.EliasFano.select
    monkeypatch.setattr(token_store.EliasFano, "select", lambda self, i: asked.append(i) or plain(self, i))
    got = token_store.digests(token_store.Segment(raw), 100)
    assert (got["doc_id"], got["start"], got["n_tokens"]) == ([3, 5, 9], [100, 102, 103], [2, 1, 3]) and sorted(asked) == [0, 0, 1, 1, 2, 2]
    assert not hasattr(token_store.EliasFano, "all")


def test_packing(spark, encoder):
    rows = [(i, "word " * random.Random(i).randint(0, 900)) for i in range(300)] + ODD
    parts = packing.pieces(docs(spark, rows), word_vocabulary())
    got = packing.pack(stored(parts, "test"), per_task=40).toPandas()
    assert len(got) == parts.count()
    total = 0
    for _, bin_ in got.groupby("sequence_id"):
        bin_ = bin_.sort_values("offset")
        assert bin_["offset"].tolist() == [0, *np.cumsum(bin_["length"])[:-1]]
        assert bin_["length"].sum() <= packing.SIZE
    for text in (t for _, t in rows):
        total += len(encoder.whole.encode(text or "", add_special_tokens=False).ids) + 1
    assert got["length"].sum() == total
    assert got["sequence_id"].nunique() <= 1.02 * total / packing.SIZE + 1


def test_best_fit_takes_the_tightest_room():
    assert packing.best_fit([7, 6, 3, 4], 10) == [[0, 2], [1, 3]]


def test_best_fit_by_counts_equals_best_fit():
    for seed in range(30):
        r = random.Random(seed)
        size = r.choice([10, 64, 300])
        lengths = sorted((r.randint(1, size) for _ in range(r.randint(0, 200))), reverse=True)
        counts = {n: lengths.count(n) for n in lengths}
        bins = defaultdict(list)
        plan = packing.fit_counts(counts, size)
        for length, n in counts.items():
            for rank in range(n):
                _, at, per, number, offset = [row for row in plan.tolist() if row[0] == length and row[1] <= rank][-1]
                bins[number + (rank - at) // per].append((offset + (rank - at) % per * length, length))
        assert len(bins) == len(packing.best_fit(lengths, size))
        for held in map(sorted, bins.values()):
            assert [at for at, _ in held] == [0, *np.cumsum([n for _, n in held])[:-1]] and sum(n for _, n in held) <= size


def test_packing_deals_underfull_bins_to_many_tasks(spark, monkeypatch):
    """No two pieces fit together, so all bins stay underfull: no task may get them all."""
    seen, plain = work_path(spark, "seen").removeprefix("file://"), packing.best_fit

    def noted(lengths, size):
        import os
        import uuid

        os.makedirs(seen, exist_ok=True)
        with open(f"{seen}/{uuid.uuid4().hex}", "w") as f:
            f.write(str(len(lengths)))
        return plain(lengths, size)

    monkeypatch.setattr(packing, "best_fit", noted)
    parts = spark.range(8000).selectExpr("id AS doc_id", "0 AS piece", "0L AS start", "1030 + id % 900 AS length", "id AS ids_crc32")
    got = packing.pack(stored(parts, "test")).toPandas()
    assert len(got) == got["sequence_id"].nunique() == 8000 and (got["offset"] == 0).all()
    import pathlib

    most = [int(f.read_text()) for f in pathlib.Path(seen).iterdir()]
    assert sum(most) == 8000 and max(most) < 4000


def test_packing_merges_underfull_bins_of_all_partitions(spark):
    parts = spark.range(8000).selectExpr("id AS doc_id", "0 AS piece", "0L AS start", "200 + (id * 7919) % 501 AS length", "id AS ids_crc32")
    got = packing.pack(stored(parts, "test")).toPandas()
    assert len(got) == got["doc_id"].nunique() == 8000
    for _, held in got.sort_values("offset").groupby("sequence_id"):
        assert held["offset"].tolist() == [0, *np.cumsum(held["length"])[:-1]] and held["length"].sum() <= packing.SIZE
    assert got["sequence_id"].nunique() <= 1.1 * got["length"].sum() / packing.SIZE


def brute_substrings(rows, window=20):
    seen, texts = {}, [(i, words(t)) for i, t in rows]
    key = lambda i: -(1 << 63) if i is None else i
    for i, w in texts:
        for s in range(len(w) - window + 1):
            k = tuple(w[s : s + window])
            seen[k] = min(seen.get(k, (key(i), s)), (key(i), s))
    out = []
    for i, w in texts:
        gone = set()
        for s in range(len(w) - window + 1):
            if seen[tuple(w[s : s + window])] < (key(i), s):
                gone.update(range(s, s + window))
        kept = " ".join(x for k, x in enumerate(w) if k not in gone)
        out.append((i, len(w), len(gone), hashlib.sha256(kept.encode()).hexdigest()))
    return sorted(out, key=str)


def planted(seed, n=60):
    """Documents of random words with shared passages, repeats and copies."""
    r = random.Random(seed)
    passages = [[f"p{k}w{j}" for j in range(r.randint(15, 60))] for k in range(4)]
    rows = []
    for i in range(n):
        w = [f"w{r.randint(0, 400)}" for _ in range(r.randint(0, 120))]
        for _ in range(r.randint(0, 2)):
            p, at = r.choice(passages), r.randint(0, len(w))
            w[at:at] = p[r.randint(0, 5) :]
        rows.append((i, " ".join(w)))
    return rows + [(n + k, rows[k][1]) for k in range(5)] + [(n + 9, "a b " * 40)]


def test_substring_dedup(spark, monkeypatch):
    rows = planted(1)
    monkeypatch.setattr(substring_dedup.chunks, "__defaults__", (700,))
    got = [tuple(r) for r in substring_dedup.drop_repeats(docs(spark, rows).repartition(5)).drop("kept").collect()]
    assert sorted(got, key=str) == brute_substrings(rows)
    odd = [r for r in ODD if r[0] != 7]
    got = [tuple(r) for r in substring_dedup.drop_repeats(docs(spark, odd)).drop("kept").collect()]
    assert sorted(got, key=str) == brute_substrings(odd)


def test_cover_meets_every_shift():
    d, v = substring_dedup.COVER, substring_dedup.PERIOD
    assert {(a - b) % v for a in d for b in d} == set(range(v))


def brute_groups(rows):
    sets = []
    for i, t in rows:
        w = words((t or "").encode().lower().decode())
        sets.append((i, {tuple(w[k : k + 5]) for k in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} if w else set()))
    parent = list(range(len(sets)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for x in range(len(sets)):
        for y in range(x):
            a, b = sets[x][1], sets[y][1]
            if a and b and 4 * min(len(a), len(b)) >= 3 * max(len(a), len(b)) and find(x) != find(y) and 100 * len(a & b) >= 75 * len(a | b):
                parent[find(x)] = find(y)
    smallest = defaultdict(list)
    for x in range(len(sets)):
        if sets[x][0] is not None:
            smallest[find(x)].append(sets[x][0])
    return sorted(((i, len(s), (min(smallest[find(x)]) if smallest[find(x)] else None) if s else i) for x, (i, s) in enumerate(sets)), key=str)


def near_copies(seed, n, size=60):
    r = random.Random(seed)
    base = [f"b{seed}w{k}" for k in range(size)]
    rows = []
    for _ in range(n):
        w = list(base)
        for _ in range(r.randint(0, 4)):
            w[r.randrange(len(w))] = f"x{r.randint(0, 10**6)}"
        rows.append(" ".join(w))
    return rows


def test_ngram_join(spark):
    texts = near_copies(1, 90) + near_copies(2, 10, 12) + [t for _, t in planted(3, 40)] + near_copies(1, 5) + ["One two", "one TWO", "one"]
    rows = list(enumerate(texts))
    random.Random(5).shuffle(rows)
    got = [tuple(r) for r in ngram_join.near_groups(docs(spark, rows)).collect()]
    assert sorted(got, key=str) == brute_groups(rows)


def test_ngram_join_odd_rows(spark):
    got = [tuple(r) for r in ngram_join.near_groups(docs(spark, ODD)).collect()]
    assert sorted(got, key=str) == brute_groups(ODD)


@settings(max_examples=200, deadline=None)
@given(st.lists(st.sets(st.integers(0, 40), min_size=1, max_size=30), min_size=2, max_size=12))
def test_divide_skip(sets):
    query, members = sorted(sets[0]), [sorted(s) for s in sets[1:]]
    lists = {h: [m for m, s in enumerate(members) if h in s] for h in query}
    found = ngram_join.divide_skip(query, lists, [len(s) for s in members])
    assert sorted(found) == [m for m, s in enumerate(members) if 100 * len(sets[0] & set(s)) >= 75 * len(sets[0] | set(s))]


def test_components(spark):
    pairs = [(i, i + 1) for i in range(0, 40)] + [(100, 105), (105, 103), (200, 200)]
    got = {r["node"]: r["label"] for r in ngram_join.components(spark.createDataFrame(pairs, "a long, b long")).collect()}
    assert got == {i: 0 for i in range(41)} | {100: 100, 103: 100, 105: 100}


def test_ngram_join_links_through_documents_without_id(spark):
    """1 and 2 link only through a document without an id; three near copies without ids are a component without a name."""
    base = [f"w{k}" for k in range(40)]
    tail, head = [f"x{k}" for k in range(5)], [f"y{k}" for k in range(5)]
    bridge = " ".join([*base[:35], *tail])
    rows = [(1, " ".join(base)), (None, bridge), (2, " ".join([*head, *base[5:35], *tail])), (None, bridge), (5, "five words that stand alone here")]
    rows += [(None, " ".join(f"v{k}" for k in range(30 + n))) for n in range(3)] + [(7, None), (7, ""), (8, " ".join([*base[:39], "z"]))]
    got = [tuple(r) for r in ngram_join.near_groups(docs(spark, rows).repartition(3)).collect()]
    assert sorted(got, key=str) == brute_groups(rows)
    assert {i: c for i, _, c in got if i in (1, 2, 8)} == {1: 1, 2: 1, 8: 1}


def test_ngram_join_long_lists_of_several_components(spark, monkeypatch):
    """Some thousand documents share the rarest shingles that they link by; most are one chain or star, others stand apart or bridge."""
    r = random.Random(11)
    shared, rows = [f"s{k}" for k in range(60)], []
    for k in range(2400):
        w = list(shared)
        if k % 3 == 0:
            w += [f"g{k % 7}t{j}" for j in range(40)]  # seven groups that share 60 of 100 words
        elif k % 3 == 1:
            w[50:] = [f"u{k}v{j}" for j in range(r.randint(5, 30))]
        w.append(f"e{k}")
        rows.append((k, " ".join(w)))
    monkeypatch.setattr(ngram_join.list_groups, "__defaults__", (ngram_join.PERCENT, 40))
    got = [tuple(r) for r in ngram_join.near_groups(docs(spark, rows)).collect()]
    assert sorted(got, key=str) == brute_groups(rows)


def test_lists_over_the_exact_frequencies_stay_rows(spark, monkeypatch):
    monkeypatch.setattr(ngram_join, "EXACT", 4)
    rows = list(enumerate(near_copies(1, 60) + near_copies(2, 9, 12) + near_copies(3, 30, 25)))
    got = [tuple(r) for r in ngram_join.near_groups(docs(spark, rows)).collect()]
    assert sorted(got, key=str) == brute_groups(rows)


SECRETS = ['token = "33e61083db5dbdf4bd2369d2f80176e57f7fda21"', "PASSWORD:abc", "api_key=abcdef and apikey = 'zzzzzz'", "AKIA" + "B" * 16 + " AKIAB", "f" * 23 + " " + "0a" * 12, "ghp_" + "a1" * 20, "tokenſecret=abcdefgh", "secret  :  \n abcdefg", "secret=ab.cd secret=secret=abcdef", "AIza" + "x" * 35, "xoxb-12345-abcdef", "sk_live_" + "a1" * 12, "-----BEGIN RSA PRIVATE KEY-----", "eyJ" + "a" * 12 + "." + "b" * 12 + ".c"]
BASE = {"assign": (r"""(?ai)(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 6), "access": (r"AKIA[A-Z0-9]+", 0, 20), "hex": (r"[0-9a-f]+", 0, 24)}


def test_secret_scan(spark):
    rows = list(enumerate(SECRETS + [t for _, t in ODD] + ["é" * 5 + s for s in SECRETS]))
    got = {r["doc_id"]: r["secret_spans"] for r in secret_scan.find_secrets(docs(spark, rows)).collect()}
    for i, t in rows:
        expected = [(name, m.start(), m.end()) for name, (p, g, n) in BASE.items() for m in re.finditer(p, t or "") if len(m[g]) >= n]
        assert sorted((s["kind"], s["start"], s["end"]) for s in got[i] if s["kind"] in BASE) == sorted(expected)
    kinds = {s["kind"] for spans in got.values() for s in spans}
    assert kinds == {kind for kind, *_ in secret_scan.RULES}
    masked = {r["doc_id"]: r["text"] for r in secret_scan.redact_secrets(docs(spark, rows)).collect()}
    assert masked[0] == "[SECRET]\"" and masked[3].startswith("[SECRET] AKIAB") and secret_scan.redact_secrets(docs(spark, rows)).columns == ["doc_id", "text", "extra"]


PATTERNS = [r"a[ab]{2,}0", r"(x|ab)+\-?=[0-9]*:", r"b{3}", r"_ ?_", r"a{1,3}x?0"]
BOTH_WAYS = lru_cache(lambda: [automaton.compile_rules([turn(automaton.parsed(p)) for p in PATTERNS]) for turn in (lambda t: t, automaton.backwards)])


@settings(max_examples=300, deadline=None)
@given(st.text(alphabet="ab0_x=: -", max_size=40))
def test_automaton_finds_what_re_finds(text):
    patterns, (a, back) = PATTERNS, BOTH_WAYS()
    ends = {n: mask for n, mask in a.ends(text.encode())}
    for n in range(len(text) + 1):
        assert ends.get(n, 0) == sum(1 << k for k, p in enumerate(patterns) if re.search(f"(?:{p})$", text[:n]))
    starts = {len(text) - n: mask for n, mask in back.ends(text[::-1].encode())}
    for n in range(len(text) + 1):
        assert starts.get(n, 0) == sum(1 << k for k, p in enumerate(patterns) if re.match(p, text[n:]))


SCRAPS = ["token", "Secret", "passwd", "api_key", "=", ":", " ", "'", '"', "abc", "f0", "0a" * 11, "AKIA", "Z9" * 7, "ghp_", "a1B2" * 9, "xoxb-", "AIza", "sk_live_", "eyJ", "eyJeyJ", ".", "-", "_", "-----BEGIN ", "RSA ", "PRIVATE KEY-----", "é", "😀", "\n", "x"]


SCANNER = lru_cache(secret_scan.Scanner)


@settings(max_examples=500, deadline=None)
@given(st.lists(st.sampled_from(SCRAPS), max_size=30))
def test_secret_spans_equal_those_of_re(scraps):
    scanner = SCANNER()
    text = "".join(scraps)
    expected = []
    for k, (kind, pattern, counted) in enumerate(secret_scan.RULES):
        expected += [(m.start(), k, m.end(), kind) for m in re.finditer(pattern, text) if not counted or re.fullmatch(counted, m[0])]
    assert scanner.spans(text) == [(kind, a, b) for a, _, b, kind in sorted(expected)]


def test_secret_spans_come_from_the_automata(monkeypatch):
    """Without accepting states nothing is found; own rules with a fixed prefix and counts over the depth are exact; runs are read once."""
    assert not hasattr(secret_scan, "re")
    own = secret_scan.Scanner((("x", "abc[0-9]+", "abc[0-9]{5,}"), ("y", "q[a-z]{40}", None), ("z", "[ab]+c?", None)))
    assert own.spans("abc12 abc12345 q" + "m" * 39) == [("z", 0, 3), ("x", 6, 14), ("z", 6, 9)] and own.spans("é q" + "m" * 41) == [("y", 2, 43)]
    scanner = secret_scan.Scanner()
    assert scanner.spans("token=abcdefgh") == [("assign", 0, 14)]
    long = "0a" * 200_000 + " " + "eyJ" * 100_000
    assert scanner.spans(long) == [("hex", 0, 400_000)]
    monkeypatch.setattr(scanner.whole, "found", dict.fromkeys(scanner.whole.found, 0))
    assert scanner.spans("token=abcdefgh") == []


def test_audio(spark):
    got = {}
    stored_features = audio.audio_features(audio.store_media(docs(spark, ODD)))
    for r in audio.media_digests(stored_features).collect():
        got.setdefault(r["doc_id"], r)
    for i, t in ODD:
        raw = (t or "").encode()
        payload = raw + b"\0" * ((-len(raw)) % 64 if raw else 64)
        r = got[i]
        assert (r["n_bytes"], r["payload_bytes"], r["payload_sha256"], r["tail_crc32"]) == (len(raw), len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-64:]))
    assert got[1]["feature"] == got[2]["feature"] and got[3]["feature"] == got[4]["feature"]
    for r in stored_features.collect():  # the feature is brute-forced from the text; tensors and spans are what is stored
        text = next(t for i, t in ODD if i == r["doc_id"])
        mel = audio.log_mel(np.frombuffer((text or "").encode().ljust(max(1, -(-len((text or "").encode()) // 64)) * 64, b"\0"), np.uint8))
        table = pa.ipc.open_stream(r["tensors"]).read_all()
        assert table.schema.field("log_mel").type.shape == [audio.PATCH, audio.MELS] and table["start_ms"][0].as_py() == 0
        assert np.array_equal(audio.from_tensor_stream(r["tensors"]), mel)
        assert [(s["start_ms"], s["end_ms"]) for s in r["segments"]] == [(20 * a, 20 * b) for a, b in audio.loud_spans(mel)]
        spans = np.array(audio.loud_spans(mel), "<i8")
        assert f"frames={len(mel)};" in got[r["doc_id"]]["feature"] and got[r["doc_id"]]["feature"].endswith(f"spans_crc={zlib.crc32(spans.tobytes()):08x};mel_crc={zlib.crc32(mel.tobytes()):08x}")
    other = stored_features.filter("doc_id = 6").withColumn("tensors", F.lit(bytearray(audio.tensor_stream(np.ones((3, audio.MELS), np.int16)))))
    assert audio.media_digests(other).first()["feature"].startswith("frames=3;")  # digests follow the stored tensors


def test_audio_blocks_and_resampling(monkeypatch):
    x = (128 + 100 * np.sin(np.arange(40_000) / 9)).astype(np.uint8)
    whole = audio.log_mel(x)
    monkeypatch.setattr(audio, "BLOCK_FRAMES", 7)
    assert np.array_equal(whole, audio.log_mel(x))
    bank, signal = audio._filters(audio.UP, audio.DOWN, audio.TAPS), (x[:500].astype(np.float32) - 128) / 128
    filled = np.zeros(500 * audio.UP, np.float32)
    filled[:: audio.UP] = signal
    taps = bank[:, ::-1].T.ravel()
    assert np.allclose(np.convolve(filled, taps)[:: audio.DOWN][:200], audio.resample(x[:500], 0, 200), atol=1e-4)


def test_warc(spark):
    big = "<p>" + "x" * 200
    rows = [(5, "http://a b\r\n", big), (2, None, big), (9, "u", big), (3, "u", "small"), (1, "u", "small"), (4, "u", None), (None, "u", big), (8, "u", "ü" * 70_000)]
    pages = spark.createDataFrame([(*r, 1) for r in rows], "page_id long, url string, html string, other int")
    files = warc.write_archives(pages.coalesce(1))
    index = warc.normalise(files)
    got = {r["page_id"]: (r["payload_bytes"], r["payload_digest"], r["record_type"], r["refers_to"]) for r in warc.read_records(index).collect()}
    digest = lambda t: hashlib.sha256((t or "").encode()).hexdigest()
    assert got == {i: (len((h or "").encode()), digest(h), "revisit" if i in (5, 9) else "response", 2 if i in (5, 9) else None) for i, _, h in rows}
    raw = warc._open(files.first()["path"])
    assert len(list(warc.split_stream(warc.inflate(raw, 100)))) == len(rows)
    first = index.orderBy("offset").first()
    member = zlib.decompress(warc._open(first["path"])[first["offset"] : first["offset"] + first["length"]], 31)
    assert member.startswith(b"WARC/1.1")


ITEM = "A train leaves Oldtown with 12 boxes of 40 kg and a driver named Tom at 9 and again 12 boxes are loaded onto it by Tom before noon"


def test_decontamination(spark):
    changed = ITEM.replace("12", "57").replace("40 kg", "8 tons").replace("Oldtown", "Ravenna").replace("Tom", "Zoe").replace("9", "11")
    mixed = changed.replace("57 boxes of", "3 boxes of")
    rows = [(1, "intro words first. " + ITEM + " more"), (2, "some text, then: " + changed), (3, "unrelated " * 50), (4, " ".join(ITEM.split()[:9])), (5, None), (None, ITEM), (6, ITEM), (6, ITEM), (7, mixed.replace("driver named", "pilot called"))]
    bench = spark.createDataFrame([(10, ITEM, 1), (11, None, 1), (12, "short one", 1)], "item_id long, text string, z int")
    got = {(r["doc_id"], r["item_id"]) for r in decontaminate.contaminated(docs(spark, rows), bench).collect()}
    assert {(1, 10), (6, 10), (None, 10)} <= got and (2, 10) in got
    assert not got & {(3, 10), (4, 10), (5, 10)}
    none = decontaminate.contaminated(docs(spark, []), bench)
    assert none.count() == 0 and decontaminate.contaminated(docs(spark, rows), bench.limit(0)).count() == 0


def test_decontamination_of_items_full_of_slots(spark):
    items = {20: "What is 12 times 7?", 21: "Compute 3 + 4 * 5", 22: "Solve 17 x 23", 23: "Tom has 3 kg, Ann has 5 kg, Bob has 7 kg, Sue has 9 kg", 24: "31 47 55 62 70 88 93 14 26 77"}
    other = {20: "What is 31 times 9?", 21: "Compute 8 + 2 * 6", 22: "Solve 4 x 88", 23: "Jim has 2 kg, Eve has 4 kg, Max has 6 kg, Ida has 8 kg"}
    rows = [(k, "some words before this: " + t + " and more after it") for k, t in items.items()]
    rows += [(k + 100, "words go before, so " + t + " and more after it") for k, t in items.items()]
    rows += [(k + 200, "some words before this. " + t + " and more after it") for k, t in other.items()]
    rows += [(1, "quiet plain words without any of those " * 9), (2, "1 2 3 4 5 6 7 8 9 10 11 12 13 14"), (3, "He sold 17 y 23 in May"), (4, "Some have 3 kg, Ann had 5 kg")]
    bench = spark.createDataFrame(list(items.items()), "item_id long, text string")
    got = {(r["doc_id"], r["item_id"]) for r in decontaminate.contaminated(docs(spark, rows), bench).collect()}
    assert got == {(k, k) for k in items} | {(k + 100, k) for k in items} | {(k + 200, k) for k in other}


def brute_contaminated(rows, items):
    """Every window of an item against every place of a document, token by token."""
    found = set()
    for doc_id, text in rows:
        t = decontaminate.Templates([text], decontaminate.Tokens())
        for item_id, item in items:
            u = decontaminate.Templates([item], decontaminate.Tokens())
            met = []
            for starts, _, size, kind, named in decontaminate.item_windows(u, decontaminate.WINDOW):
                for s in starts.tolist():
                    own = [(int(u.kind[k]), 0 if u.kind[k] and kind != decontaminate.VERBATIM else int(u.words[k])) for k in range(s, s + size)]
                    if named:
                        own[0] = (3, 0)
                    for p in range(len(t.doc) - size + 1):
                        other = [(int(t.kind[k]), 0 if t.kind[k] and kind != decontaminate.VERBATIM else int(t.words[k])) for k in range(p, p + size)]
                        if [x[1] for x in own] == [x[1] for x in other] and (kind == decontaminate.VERBATIM or [x[0] for x in own] == [x[0] for x in other]):
                            mine = [u.value(s)] * named + u.slots(s, size) if kind != decontaminate.VERBATIM else []
                            met.append((p - s, s, size, list(zip(mine, t.slots(p, size) if kind != decontaminate.VERBATIM else [], strict=True))))
            covered = set()
            for shift in {m[0] for m in met}:
                values = defaultdict(lambda: defaultdict(int))
                for _, _, _, slots in (m for m in met if m[0] == shift):
                    for a, b in slots:
                        values[a][b] += 1
                total = sum(sum(v.values()) for v in values.values())
                if not total or sum(max(v.values()) for v in values.values()) >= decontaminate.LEAST_CONSISTENCY * total:
                    covered |= {k for m in met if m[0] == shift for k in range(m[1], m[1] + m[2])}
            if len(u.doc) and len(covered) >= decontaminate.LEAST_COVERAGE * len(u.doc):
                found.add((doc_id, item_id))
    return found


NAMES = ["Tom", "Ann Lee", "Maria", "Bob", "Van Der Berg", "Zoe", "Ravenna", "Oldtown", "Max Otto Kern"]
FRAMES = [
    "a train leaves {n0} at {d0} with {d1} boxes of {d2} {u0} each and a driver named {n1} adds {d3} more before it stops",
    "in the shop of {n0} there are {d0} red and {d1} blue marbles so how many does {n1} hold after {n0} gives away {d0} of them",
    "if {n0} walks {d0} {u0} every day and {n1} walks {d1} {u0} less then how far do both walk in {d2} weeks together",
    "What is {d0} plus {d1}?",
    "{n0} bought {d0} {u0} of rice while {n1} sold {d1} {u0} of it",
    "the quiet river bends twice behind the old mill and nobody has ever counted the stones there",
]


def filled(frame, r):
    slots = {f"n{k}": r.choice(NAMES) for k in range(2)} | {f"d{k}": str(r.randint(2, 999)) for k in range(4)} | {"u0": r.choice(["kg", "km", "miles", "litres", "m"])}
    return frame.format(**slots)


def test_decontamination_equals_brute_force(spark):
    r = random.Random(12)
    word = lambda: "".join(r.choice("abcdeilmnorst") for _ in range(r.randint(2, 7)))
    items = [(k, filled(FRAMES[k % len(FRAMES)], r)) for k in range(12)] + [(50, "one two"), (51, "")]
    rows = []
    for k in range(60):
        w = [r.choice([word(), word(), str(r.randint(1, 50)), r.choice(NAMES)]) for _ in range(r.randint(0, 30))]
        part = r.choice([filled(FRAMES[k % len(FRAMES)], r), r.choice(items)[1], " ".join(filled(r.choice(FRAMES), r).split()[:7])])
        w.insert(r.randint(0, len(w)), part)
        rows.append((k, " ".join(w)))
    bench = spark.createDataFrame(items, "item_id long, text string")
    got = {(x["doc_id"], x["item_id"]) for x in decontaminate.contaminated(docs(spark, rows), bench).collect()}
    assert got == brute_contaminated(rows, items) and len(got) > 30


def test_decontamination_finds_items_with_other_values(spark):
    """Items whose numbers, units and names, of one or several words, are others; clean documents have as many of them."""
    r = random.Random(4)
    word = lambda: "".join(r.choice("abcdeilmnorst") for _ in range(r.randint(2, 8)))
    frames = [" ".join([*(word() for _ in range(r.randint(2, 5))), "{n0}", *(word() for _ in range(r.randint(3, 6))), "{d0}", "{u0}", *(word() for _ in range(r.randint(2, 6))), "{n1}", word(), "{d1}", *(word() for _ in range(r.randint(2, 6)))]) for _ in range(120)]
    items = [(k, filled(f, r)) for k, f in enumerate(frames)]
    around = lambda: " ".join(r.choice([word(), word(), word(), str(r.randint(1, 99)), r.choice(NAMES)]) for _ in range(40))
    rows = [(k, f"{around()} {filled(f, r)} {around()}") for k, f in enumerate(frames)] + [(1000 + k, around() + " " + around()) for k in range(200)]
    got = {(x["doc_id"], x["item_id"]) for x in decontaminate.contaminated(docs(spark, rows), spark.createDataFrame(items, "item_id long, text string")).collect()}
    assert len(got & {(k, k) for k in range(120)}) >= 0.9 * 120 and not [x for x in got if x[0] >= 1000]


def test_toxicity_learns_misspellings(spark):
    r = random.Random(4)
    clean = lambda n: [f"{r.choice('bcdfg')}{r.choice('aeiou')}{r.choice('lmnr')}{r.choice('aeiou')}{r.choice('st')}" for _ in range(n)]
    texts, labels = [], []
    for k in range(300):
        w = clean(60)
        if k % 3 == 0:
            w[r.randrange(60)] = r.choice(["idiotic", "worthless", "stupidly"])
        texts.append(" ".join(w))
        labels.append(int(k % 3 == 0))
    model = toxicity.fit(texts, labels)
    rows = [(1, " ".join([*clean(40), "worthlesss", *clean(10)])), (2, " ".join(clean(90))), (3, None), (4, "")]
    got = {r["doc_id"]: r["toxicity"] for r in toxicity.score_texts(docs(spark, rows), model).collect()}
    assert got[1] > 0.5 > got[2] and got[3] == got[4] == 0
    assert toxicity.fit(["a"], [1]) is None and toxicity.score_texts(docs(spark, rows), None).filter("toxicity = 0").count() == 4


def test_toxicity_reads_texts_without_blanks(spark):
    r = random.Random(4)
    word = lambda: f"{r.choice('bcdfg')}{r.choice('aeiou')}{r.choice('lmnr')}{r.choice('aeiou')}{r.choice('st')}"
    texts = [" ".join([*(word() for _ in range(59)), "worthless" if k % 3 == 0 else word()]) for k in range(300)]
    model = toxicity.fit(texts, [int(k % 3 == 0) for k in range(300)])
    clean = lambda by: by.join(word() for _ in range(60))
    rows = [(k, clean(by) + by + "worthless" + by + clean(by)) for k, by in enumerate("_/,-")] + [(k + 10, clean(by)) for k, by in enumerate("_/,-")]
    got = {r["doc_id"]: r["toxicity"] for r in toxicity.score_texts(docs(spark, rows), model).collect()}
    assert min(got[k] for k in range(4)) > 0.5 > max(got[k] for k in range(10, 14)), got


def test_suffix_automaton_knows_all_substrings():
    text = [1, 2, 1, 3, 1, 2, 2, 1]
    moves = language_id.suffix_automaton(text)
    subs = {tuple(text[i:j]) for i in range(8) for j in range(i + 1, 9)}
    todo, found = [(0, ())], set()
    while todo:
        s, path = todo.pop()
        found.add(path)
        todo += [(t, (*path, c)) for c, t in moves[s].items()]
    assert found - {()} == subs


def test_language_id(spark):
    rows = [(1, "the cat and the dog"), (2, "der Hund und die Katze"), (3, None), (4, "123 !!"), (5, "中文")]
    samples = {"en": "the cat sat on the mat and the dog ran after the ball", "de": "der hund und die katze und der ball liegen auf dem boden"}
    got = {r["doc_id"]: r["lang_pred"] for r in language_id.identify(docs(spark, rows), samples).collect()}
    assert got[1] == "en" and got[2] == "de" and got[3] == got[4] == "und" and got[5] in samples
    parser = language_id.Parser(("en",), ("abcab",))
    assert language_id.Parser(("en", "xx"), ("abcab", "xd")).phrases(["abxxcd", "ab..cd"]).tolist() == [[5, 6], [3, 4]]  # ab, c, and the letters that a language doesn't have

    def plain(text):
        n, at = 0, 0
        while at < len(text):
            end = at + 1
            while end <= len(text) and text[at:end] in "abcab":
                end += 1
            at = max(at + 1, end - 1)
            n += 1
        return n

    for text in ("abc", "abcab", "ccc", "cabcabx"[:6], "bcbcab", "abcabab" * 7):
        assert parser.phrases([text])[0][0] == plain(text)


SCRIPTS = {
    "ar": "ذهب الولد الى المدرسة في الصباح وقرأ كتابا عن البحر والسماء ثم عاد الى البيت مع صديقه",
    "el": "το παιδί πήγε στο σχολείο το πρωί και διάβασε ένα βιβλίο για τη θάλασσα και τον ουρανό",
    "en": "the child went to school in the morning and read a book about the sea and the sky then came home",
    "hi": "बच्चा सुबह स्कूल गया और समुद्र और आकाश के बारे में एक किताब पढ़ी फिर अपने दोस्त के साथ घर आया",
    "ja": "子供は朝学校に行って海と空についての本を読みそれから友達と一緒に家に帰りました",
    "ru": "мальчик пошёл утром в школу и прочитал книгу о море и небе а потом вернулся домой с другом",
    "zh": "孩子早上去学校读了一本关于大海和天空的书然后和朋友一起回家吃了晚饭",
    "got": "𐌰𐍄𐍄𐌰 𐌿𐌽𐍃𐌰𐍂 𐌸𐌿 𐌹𐌽 𐌷𐌹𐌼𐌹𐌽𐌰𐌼 𐍅𐌴𐌹𐌷𐌽𐌰𐌹 𐌽𐌰𐌼𐍉 𐌸𐌴𐌹𐌽",
}


def test_language_id_of_many_scripts_and_languages(spark):
    """Over 62 letters and 32 languages, letters beyond the first plane, and unequal samples."""
    samples = {lang: f"{t} " * (40 if lang == "en" else 2) for lang, t in SCRIPTS.items()}
    samples |= {f"x{k:02d}": " ".join(f"{chr(97 + k % 26)}{chr(97 + j % 26)}q{chr(97 + (k + j) % 26)}" for j in range(60)) for k in range(26)}
    rows = [(k, " ".join(t.split()[-6:]) if " " in t else t[8:30]) for k, t in enumerate(samples.values())]
    got = {r["doc_id"]: r["lang_pred"] for r in language_id.identify(docs(spark, rows), samples).collect()}
    assert [lang for k, lang in enumerate(samples) if got[k] != lang] == []
    learnt = language_id.sample_languages(spark.createDataFrame([(k, f"text number {k}", f"l{k % 50}") for k in range(500)], "doc_id long, text string, lang string"), 40)
    assert len(learnt) == 50 and all(30 <= len(t) <= 45 for t in learnt.values())


SF_LABELS = "/root/testdata/sf0.1"


def test_toxicity_held_out_recall(spark):
    """Labels are learnt from four fifths of the documents; the others are judged."""
    labels = spark.read.parquet(f"{SF_LABELS}/labels.parquet").filter("toxic is not null").select("doc_id", "toxic").distinct()
    got = toxicity.op1_toxicity(spark, SF_LABELS).filter("held_out").join(labels, "doc_id").groupBy("toxic").agg(F.avg("predicted").alias("p")).collect()
    share = {r["toxic"]: r["p"] for r in got}
    assert share[1] >= 0.9 and share[0] <= 0.02, share


def test_held_out_accuracy(spark):
    for name, column, least in (("op6_language_id", "lang_pred", 0.97),):
        got = language_id.op6_language_id(spark, SF).filter("held_out").join(spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "lang"), "doc_id")
        assert got.filter(F.col(column) == F.col("lang")).count() >= least * got.count()


def tokens_back(d):
    path = work_path(d.sparkSession, "t")
    token_store.write_tokens(d, path, word_vocabulary())
    return token_store.read_tokens(d.sparkSession, path, token_store.digests, "doc_id long,start long,n_tokens long,ids_crc32 long")


PAGES = lambda d: d.select(F.col("doc_id").alias("page_id"), F.col("extra").alias("url"), F.col("text").alias("html"))
EVERY = {
    "toxicity": lambda d: toxicity.score_texts(d, toxicity.fit_sample(toxicity.sample_labelled(d, d.select("doc_id", F.lit(1).alias("toxic"))))),
    "tokens": tokens_back,
    "packing": lambda d: packing.pack(stored(packing.pieces(d, word_vocabulary()), "t")),
    "substrings": substring_dedup.drop_repeats,
    "warc": lambda d: warc.read_records(warc.normalise(warc.write_archives(PAGES(d)))),
    "languages": lambda d: language_id.identify(d, language_id.sample_languages(d.withColumn("lang", F.col("extra")))),
    "secrets": secret_scan.find_secrets,
    "ngrams": ngram_join.near_groups,
    "audio": lambda d: audio.media_digests(audio.audio_features(audio.store_media(d))),
    "decontamination": lambda d: decontaminate.contaminated(d, d.select(F.col("doc_id").alias("item_id"), "text")),
}


@pytest.mark.parametrize("name", EVERY)
def test_empty_tables(spark, name):
    assert EVERY[name](docs(spark, [])).collect() == []


@pytest.mark.parametrize("name", EVERY)
def test_columns_with_clashing_names(spark, name):
    """Columns that have the names of results or helpers change no row."""
    rows = ODD[:6] + [(9, "a text of several plain words, ten of them in all"), (10, "ten")]
    plain, result = docs(spark, rows), EVERY[name](docs(spark, rows))
    clashing = plain
    for c in ("score", "toxicity", "node", "chunk", "bucket", "hash", "n", "c", "salt", "is_hot", "copies", "label", "fill", "rank", "parts", "digest", "payload", "first", "refers_to", "media", "row", "key", "secret_spans", "held_out", "place", "slots"):
        clashing = clashing.withColumn(c, F.lit("clash"))
    got = EVERY[name](clashing)
    kept = [c for c in result.columns if c not in ("sequence_id", "offset")]
    assert sorted(map(str, got.select(kept).collect())) == sorted(map(str, result.select(kept).collect()))


def test_hot_keys_join_like_others(spark):
    """Over a thousandth of the rows, fewer, none and null keys."""
    left = spark.range(30_000).selectExpr("id", "CASE WHEN id % 3 = 0 THEN 'hot' WHEN id % 3 = 1 THEN concat('k', id % 5000) WHEN id % 9 = 2 THEN NULL ELSE 'none' END AS k", "7 AS extra")
    right = left.filter("k <> 'none'").groupBy("k").agg(F.count("*").alias("c"), F.min("id").alias("v")).withColumn("w", F.when(F.col("k") == "hot", None).otherwise(F.col("v") + 1))
    got = hot_join(left, right, ["k"], "c", ["id"])
    assert got.columns == ["id", "k", "extra", "v", "w"] and sorted(got.collect()) == sorted(left.join(right.drop("c"), "k", "left").select(got.columns).collect())
