"""Phrase collocations by dynamic itemset counting over cyclic scans of shards.

Everything is per language. Texts are lower-cased (A-Z), cut at ``[.,;:!?`` and line ends into pieces, and those at blanks and tabs
into words. A phrase is frequent if it occurs ``LEAST`` times, overlaps included.

1. ``shard_table``: words as numbers in compressed chunks of one language, each in one of ``SHARDS`` shards; written once.
2. ``count_phrases``: step t scans shard t mod ``SHARDS`` and counts phrases of all lengths that are active then. Words are
   active from step 0. As soon as the counts so far of both subphrases (all words but the last, all but the first) reach the
   threshold, at whatever point of the cycle, the longer phrase is active from the next step on, and it is counted
   until it has seen every shard once. The scan ends when every active phrase has completed its cycle.
   Chunks send counts to hash buckets as sorted arrays; a bucket adds them to what it holds of unfinished phrases.
   Workers learn what has reached the threshold from one byte a slot of the hash space, the step from which on it holds
   (``MOST_SLOTS`` bounds that broadcast). Phrases that share a slot can only start longer ones earlier; those are still counted over
   exactly one cycle, so counts are exact whatever the slots.
3. ``frequent_phrases``: of each frequent phrase one chunk that holds it is known, and that chunk gives its text.
4. ``collocations``: the lowest score over all cuts of a phrase, joined from the counts of its parts; phrases inside a longer one that
   is nearly as frequent are dropped; the first ``TOP`` of each language stay, which each task cuts before they are shuffled.

Phrases are told apart by 80 bits of hashes of their words and language. Nulls: a null language is ``und``, a null text is
empty, doc_id is not read. Texts without words count nothing. Ties are ordered by the phrase's bytes. Repeated rows
count as often as they stand there. An empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

from array import array
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from sessionloom.llm.common import arrow_schema, hot_join, partitions, slices, stored
from sessionloom.llm.words import bucket_of, mix, windows

LEAST, LONGEST, TOP, SHARDS = 30, 4, 2000, 3
CHUNK_WORDS, PLACE_BITS = 500_000, 20
#: Powers of two: slots of the array of steps at least and at most, and slots for each word by ``LEAST``.
LEAST_SLOTS, MOST_SLOTS, SLOTS_A_PHRASE = 16, 27, 8
CHUNKS_A_BUCKET = 8
#: Score of a cut: this times a, by l + r. Containing phrases count from this share of a on, in percent.
FACTOR, SHARE = 2_000_000, 80
_BREAK = b"\xff"
_SIGNS = bytes.maketrans(b".,;:!?\n\x0b\x0c\r\t", _BREAK * 10 + b" ")
_CHUNK = "shard int,chunk long,lang string,words long,payload binary"
_PARTS = (("high", "<u8"), ("low", "<u2"), ("size", "u1"), ("start", "u1"), ("count", "<i8"), ("chunk", "<i8"))
_STEP = "bucket int,kind string,first long," + ",".join(f"{c} binary" for c, _ in _PARTS)
_SENT = "bucket int,chunk long," + ",".join(f"{c} binary" for c, _ in _PARTS[:-1])


class PhraseChunk:
    """Distinct words and, for each place, the number of its word; 0 ends a piece."""

    def __init__(self, words: list[bytes], ids: np.ndarray, lang: str):
        self.words, self.ids = words, ids
        base = xxhash.xxh3_64_intdigest(lang.encode("utf-8", "surrogatepass"))
        self.hashes = np.fromiter((0, *(xxhash.xxh3_64_intdigest(w, base) for w in words)), np.uint64, len(words) + 1)[ids]
        #: How many words follow in the same piece, the place itself included.
        ends = np.flatnonzero(ids == 0)
        self.left = np.repeat(ends, np.diff(np.concatenate([[-1], ends]))) - np.arange(len(ids))

    @staticmethod
    def pack(words: list[bytes], ids: array) -> bytes:
        raw = b"\xff".join(words)
        return zstandard.ZstdCompressor(level=3).compress(np.array([len(words), len(raw)], "<i8").tobytes() + raw + np.array(ids, "<i4").tobytes())

    @classmethod
    def unpack(cls, packed: bytes, lang: str) -> PhraseChunk:
        raw = zstandard.ZstdDecompressor().decompress(packed)
        n, size = np.frombuffer(raw, "<i8", 2).tolist()
        return cls(raw[16 : 16 + size].split(b"\xff") if n else [], np.frombuffer(raw, "<i4", offset=16 + size), lang)

    def keys(self, size: int) -> tuple[np.ndarray, np.ndarray]:
        """Hashes of the ``size`` words from each place on; valid where ``left`` is at least ``size``."""
        high = windows(self.hashes, size)
        return mix(high), windows(self.hashes, size, 1)

    def phrase(self, at: int, size: int) -> str:
        return b" ".join(self.words[k - 1] for k in self.ids[at : at + size].tolist()).decode("utf-8", "surrogatepass")


class Numbers(dict):
    """Numbers of words in the order in which they are met; a break is 0."""

    def __init__(self):
        super().__init__({_BREAK: 0})

    def __missing__(self, word: bytes) -> int:
        self[word] = n = len(self)
        return n

    def words(self) -> list[bytes]:
        return list(self)[1:]


def tokens(text: str | None) -> list[bytes]:
    """Words in order, with a ``_BREAK`` after each piece."""
    raw = (text or "").encode("utf-8", "surrogatepass").lower().translate(_SIGNS)
    return (raw.replace(_BREAK, b" \xff ") + b" \xff").split()


def shard_table(docs: DataFrame, shards: int = SHARDS, chunk_words: int = CHUNK_WORDS) -> DataFrame:
    """Written (shard, chunk, lang, words, payload), a folder a shard. A task holds at most ``chunk_words`` words of all languages."""
    schema = arrow_schema(_CHUNK)

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        held: dict[str, tuple[Numbers, array]] = {}
        size, task, number = 0, TaskContext.get().partitionId(), 0

        def chunk(lang: str) -> pa.RecordBatch:
            nonlocal size, number
            known, ids = held.pop(lang)
            size -= len(ids)
            number += 1
            row = ((task + number) % shards, task << PLACE_BITS | number, lang, len(ids) - ids.count(0), PhraseChunk.pack(known.words(), ids))
            return pa.RecordBatch.from_arrays([pa.array([v], f.type) for v, f in zip(row, schema, strict=True)], schema=schema)

        for part in slices(batches, 64):
            for lang, text in zip(part["lang"], part["text"], strict=True):
                found = tokens(text)
                known, ids = held[lang] if lang in held else held.setdefault(lang, (Numbers(), array("i")))
                ids.extend(map(known.__getitem__, found))
                size += len(found)
                while size >= chunk_words:
                    yield chunk(max(held, key=lambda x: len(held[x][1])))
        for lang in list(held):
            yield chunk(lang)

    rows = docs.select(F.coalesce(F.col("lang").cast("string"), F.lit("und")).alias("lang"), F.col("text").cast("string").alias("text"))
    return stored(rows.mapInArrow(pack, _CHUNK), "phrase-chunks", partition_by="shard")


def active_phrases(chunk: PhraseChunk, steps: np.ndarray, t: int, shards: int, longest: int = LONGEST) -> Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """(size, places, high, low, start) of the occurrences in ``chunk`` of phrases that are active at step ``t``."""
    shift = np.uint64(65 - len(steps).bit_length())
    reached = None  # of each place, from which step on the phrase of the size before counts as frequent; 0 is never
    for size in range(1, longest + 1):
        n = len(chunk.ids) - size + 1
        if n <= 0 or size > 1 and not reached.any():
            return
        if size == 1:
            active = (chunk.left >= 1) & (t < shards)
            start = np.zeros(n, np.uint8)
        else:
            ready = (reached[:n] > 0) & (reached[1 : n + 1] > 0) & (chunk.left[:n] >= size)
            start = np.where(ready, np.maximum(reached[:n], reached[1 : n + 1]), 0).astype(np.uint8)
            active = ready & (t < start.astype(np.int64) + shards)
        high, low = chunk.keys(size)
        places = np.flatnonzero(active)
        if len(places):
            yield size, places, high[places], low[places].astype(np.uint16), start[places]
        reached = np.where(chunk.left[:n] >= size, steps[(high >> shift).astype(np.int64)], 0)


def _grouped(high: np.ndarray, low: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """An order in which equal keys stand together, high ascending, and where in it each key starts."""
    order = np.argsort(high, kind="stable")
    h, k = high[order], low[order]
    same = h[1:] == h[:-1]
    if (same & (k[1:] != k[:-1])).any():
        order = np.lexsort((low, high))
        h, k = high[order], low[order]
        same = (h[1:] == h[:-1]) & (k[1:] == k[:-1])
    return order, np.flatnonzero(np.concatenate([[True], ~same])) if len(h) else np.empty(0, np.int64)


def _runs(high: np.ndarray, buckets: int) -> Iterator[tuple[int, slice]]:
    b = bucket_of(high, buckets)
    edges = np.flatnonzero(np.diff(b)) + 1
    for lo, hi in zip([0, *edges.tolist()], [*edges.tolist(), len(high)], strict=True):
        if hi > lo:
            yield int(b[lo]), slice(lo, hi)


def scan_shard(table: DataFrame, steps: np.ndarray, t: int, shards: int, buckets: int, longest: int = LONGEST) -> DataFrame:
    """Counts of the active phrases in each chunk of step ``t``'s shard, by bucket."""
    schema = arrow_schema(_SENT)
    shared = table.sparkSession.sparkContext.broadcast((len(steps), zstandard.ZstdCompressor(level=1).compress(steps.tobytes())))  # MOST_SLOTS bounds it

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = np.frombuffer(zstandard.ZstdDecompressor().decompress(shared.value[1]), np.uint8) if shared.value[0] else np.empty(0, np.uint8)
        for part in slices(batches, 1):
            found: list[tuple[np.ndarray, ...]] = []
            for size, _, high, low, start in active_phrases(PhraseChunk.unpack(part["payload"][0], part["lang"][0]), known, t, shards, longest):
                order, at = _grouped(high, low)
                first = order[at]
                found.append((high[first], low[first], np.full(len(at), size, np.uint8), start[first], np.diff(np.append(at, len(order)))))
            if found:
                high, low, size, start, count = (np.concatenate(x) for x in zip(*found, strict=True))
                order = np.argsort(high, kind="stable")
                columns = dict(zip((c for c, _ in _PARTS), (high[order], low[order], size[order], start[order], count[order]), strict=False))
                runs = list(_runs(columns["high"], buckets))
                sent = {"bucket": [b for b, _ in runs], "chunk": part["chunk"] * len(runs)}
                yield pa.RecordBatch.from_pydict(sent | {c: [columns[c][r].astype(k).tobytes() for _, r in runs] for c, k in _PARTS[:-1]}, schema=schema)

    return table.filter(F.col("shard") == t % shards).mapInArrow(run, _SENT)


def merge_counts(sent: DataFrame, carried: DataFrame | None, t: int, shards: int, least: int, slots: int, buckets: int) -> DataFrame:
    """Written rows of three kinds by bucket: ``open`` phrases with their counts so far, ``done`` ones that are frequent, and ``reached`` bits of slots of phrases that reached the threshold in this step, with the longest length that isn't final in ``bucket``'s ``size``."""
    schema = arrow_schema(_STEP)
    shift = np.uint64(65 - slots.bit_length())
    as_sent = sent.select("bucket", F.lit("sent").alias("kind"), "chunk", *[F.col(c) for c, _ in _PARTS[:-1]])
    as_sent = as_sent.select("bucket", "kind", F.col("chunk").alias("first"), *[c for c, _ in _PARTS[:-1]], F.lit(None).cast("binary").alias("chunk"))
    rows = as_sent if carried is None else as_sent.unionByName(carried)

    def row(bucket: int, kind: str, first: int, values: dict[str, bytes]) -> dict:
        return {"bucket": bucket, "kind": kind, "first": first} | {c: values.get(c) for c, _ in _PARTS}

    def meet(rows: pa.Table) -> pa.Table:
        bucket = rows.column("bucket")[0].as_py()
        kinds, firsts = rows.column("kind").to_pylist(), rows.column("first").to_pylist()
        arrays = {c: [np.frombuffer(x.as_py() or b"", k) for x in rows.column(c)] for c, k in _PARTS}
        lengths = [len(x) for x in arrays["high"]]
        arrays["chunk"] = [np.full(n, first, np.int64) if kind == "sent" else chunk for n, kind, first, chunk in zip(lengths, kinds, firsts, arrays["chunk"], strict=True)]
        before = np.repeat([k == "open" for k in kinds], lengths)
        # One chunk of a phrase's will give its text; buckets start from different ones.
        mixed = np.random.default_rng(bucket).permutation(len(lengths))
        whole = {c: np.concatenate([arrays[c][k] for k in mixed]) for c, _ in _PARTS}
        before = np.concatenate([before[e - n : e] for n, e in zip(np.array(lengths)[mixed].tolist(), np.cumsum(lengths)[mixed].tolist(), strict=True)])
        order, at = _grouped(whole["high"], whole["low"])
        first = order[at]
        count = np.add.reduceat(whole["count"][order], at) if len(at) else whole["count"][:0]
        known = np.add.reduceat((whole["count"] * before)[order], at) if len(at) else whole["count"][:0]
        held = {c: whole[c][first] for c, _ in _PARTS} | {"count": count}
        done = held["start"].astype(np.int64) + shards - 1 <= t
        new = (count >= least) & (known < least)
        out = []
        for kind, keep in (("open", ~done), ("done", done & (count >= least))):
            if keep.any():
                out.append(row(bucket, kind, 0, {c: held[c][keep].astype(k).tobytes() for c, k in _PARTS}))
        if new.any():
            slot = np.unique((held["high"][new] >> shift).astype(np.int64))
            bits = np.zeros(int(slot[-1] - slot[0]) + 1, bool)
            bits[slot - slot[0]] = True
            out.append(row(bucket, "reached", int(slot[0]), {"high": np.packbits(bits).tobytes(), "size": held["size"][new].min().tobytes()}))
        return pa.Table.from_pylist(out, schema=schema)

    return stored(rows.repartition(buckets, "bucket").groupBy("bucket").applyInArrow(meet, _STEP), "phrase-step")


def count_phrases(table: DataFrame, shards: int = SHARDS, least: int = LEAST, longest: int = LONGEST, slots: int | None = None) -> DataFrame:
    """Rows of ``done`` phrases by bucket: every phrase that occurs ``least`` times, with its count and a chunk that holds it."""
    n, words = table.agg(F.count("*"), F.sum("words")).first()
    buckets = max(partitions(table.sparkSession), -(-n // CHUNKS_A_BUCKET))
    if slots is None:
        slots = 1 << min(MOST_SLOTS, max(LEAST_SLOTS, (SLOTS_A_PHRASE * (words or 0) // least).bit_length()))
    steps = np.zeros(slots, np.uint8)
    carried, done, t, last = None, [], 0, 0
    while t < last + shards:
        met = merge_counts(scan_shard(table, steps, t, shards, buckets, longest), carried, t, shards, least, slots, buckets)
        for r in met.filter("kind = 'reached'").select("first", "high", "size").toLocalIterator():  # slots / 8 bytes at most
            bits = np.unpackbits(np.frombuffer(r["high"], np.uint8)).astype(bool)[: slots - r["first"]]
            part = steps[r["first"] : r["first"] + len(bits)]
            part[bits & (part == 0)] = t + 1
            last = max(last, t + 1 if r["size"][0] < longest else 0)
        carried = met.filter("kind = 'open'")
        done.append(met.filter("kind = 'done'"))
        t += 1
    return reduce(DataFrame.unionByName, done)


def frequent_phrases(table: DataFrame, counted: DataFrame, longest: int = LONGEST) -> DataFrame:
    """Written (lang, phrase, size, f) of the phrases in ``counted``."""
    wanted_ddl = "chunk long," + ",".join(f"{c} binary" for c in ("high", "low", "size", "count"))
    wanted_schema = arrow_schema(wanted_ddl)
    kinds = dict(_PARTS)

    def by_chunk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches, 1):
            held = {c: np.frombuffer(part[c][0], k) for c, k in _PARTS}
            order = np.argsort(held["chunk"], kind="stable")
            chunks, at = np.unique(held["chunk"][order], return_index=True)
            runs = [order[a:b] for a, b in zip(at.tolist(), [*at[1:].tolist(), len(order)], strict=True)]
            yield pa.RecordBatch.from_pydict({"chunk": chunks} | {c: [held[c][r].astype(kinds[c]).tobytes() for r in runs] for c in ("high", "low", "size", "count")}, schema=wanted_schema)

    wanted = counted.mapInArrow(by_chunk, wanted_ddl).groupBy("chunk").agg(F.collect_list(F.struct("high", "low", "size", "count")).alias("wanted"))
    ddl = "lang string,phrase string,size int,f long"
    schema = arrow_schema(ddl)

    def spell(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches, 1):
            chunk = PhraseChunk.unpack(part["payload"][0], part["lang"][0])
            high, low, sizes, count = (np.concatenate([np.frombuffer(w[c], kinds[c]) for w in part["wanted"][0]]) for c in ("high", "low", "size", "count"))
            for size in range(1, longest + 1):
                own = np.flatnonzero(sizes == size)
                if not len(own):
                    continue
                here, check = chunk.keys(size)
                places = np.flatnonzero(chunk.left[: len(here)] >= size)
                order = places[np.argsort(here[places], kind="stable")]
                found = []
                for k, lo, hi in zip(own.tolist(), np.searchsorted(here[order], high[own]).tolist(), np.searchsorted(here[order], high[own], side="right").tolist(), strict=True):
                    at = next(p for p in order[lo:hi].tolist() if check[p].astype(np.uint16) == low[k])
                    found.append((part["lang"][0], chunk.phrase(at, size), size, int(count[k])))
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*found, strict=True), schema, strict=True)], schema=schema)

    return stored(table.join(wanted, "chunk").mapInArrow(spell, ddl), "phrases")


def collocations(found: DataFrame, totals: DataFrame, top: int = TOP) -> DataFrame:
    """lang, rank, phrase, a, l, r, n, score of the frequent phrases ``found``; ``totals`` has n by lang."""
    exact = lambda c: F.col(c).cast("decimal(19,0)")
    words = F.split("phrase", " ")
    joined = lambda at, n: F.array_join(F.slice(F.col("w"), at, n), " ")
    long = found.filter("size > 1").select("lang", "phrase", "size", F.col("f").alias("a"), words.alias("w"))
    cuts = long.withColumn("k", F.explode(F.sequence(F.lit(1), F.col("size") - 1)))
    parts = cuts.select("lang", "phrase", "k", "a", F.explode(F.array(F.struct(F.lit("l").alias("side"), joined(F.lit(1), F.col("k")).alias("part")), F.struct(F.lit("r").alias("side"), joined(F.col("k") + 1, F.col("size") - F.col("k")).alias("part")))).alias("p")).select("lang", "phrase", "k", "a", "p.side", "p.part")
    uses = parts.groupBy("lang", "part").agg(F.count("*").alias("c"))
    known = stored(uses.join(found.select("lang", F.col("phrase").alias("part"), "f"), ["lang", "part"]), "phrase-parts")
    met = hot_join(parts, known, ["lang", "part"], "c", ["phrase"])
    side = lambda x: F.max(F.when(F.col("side") == x, F.col("f"))).alias(x)
    cut = met.groupBy("lang", "phrase", "k").agg(F.max("a").alias("a"), side("l"), side("r"))
    cut = cut.withColumn("score", F.expr(f"cast({FACTOR} as decimal(10,0)) * cast(a as decimal(19,0)) div (cast(l as decimal(19,0)) + cast(r as decimal(19,0)))"))
    scored = cut.groupBy("lang", "phrase").agg(F.max("a").alias("a"), F.min(F.struct("score", "k", "l", "r")).alias("m"))
    inner = F.flatten(F.transform(F.sequence(F.lit(2), F.col("size") - 1), lambda n: F.transform(F.sequence(F.lit(1), F.col("size") - n + 1), lambda at: F.array_join(F.slice(F.col("w"), at, n), " "))))
    outer = long.filter("size > 2").select("lang", "a", F.explode(inner).alias("phrase")).groupBy("lang", "phrase").agg(F.max("a").alias("longer"))
    kept = scored.join(outer, ["lang", "phrase"], "left").filter(F.col("longer").isNull() | (exact("longer") * 100 < exact("a") * SHARE))
    order = Window.partitionBy("lang").orderBy(F.desc("score"), F.desc("a"), "phrase")
    ranked = kept.select("lang", "phrase", "a", "m.l", "m.r", "m.score").withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= top)
    return ranked.join(totals, "lang").select("lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", "l", "r", "n", "score")


def phrase_collocations(docs: DataFrame, shards: int = SHARDS, least: int = LEAST, top: int = TOP, longest: int = LONGEST, chunk_words: int = CHUNK_WORDS, slots: int | None = None) -> DataFrame:
    """The best collocations of each language: lang, rank, phrase, a, l, r, n, score."""
    table = shard_table(docs, shards, chunk_words)
    found = frequent_phrases(table, count_phrases(table, shards, least, longest, slots), longest)
    return collocations(found, table.groupBy("lang").agg(F.sum("words").alias("n")), top)


def op13_phrases(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first 2,000 collocations of every language in all ``documents``."""
    return phrase_collocations(spark.read.parquet(f"{sf_dir}/documents.parquet"))


def _oracle() -> str:
    grams = " UNION ALL ".join(f"SELECT lang, {n} AS size, array_to_string(w[i:i + {n - 1}], ' ') AS phrase FROM (SELECT lang, w, unnest(range(1, len(w) - {n - 2})) AS i FROM pieces)" for n in range(1, LONGEST + 1))
    return rf"""
WITH pieces AS (SELECT lang, regexp_extract_all(piece, '[^\x20\x09]+') AS w FROM (
 SELECT coalesce(lang, 'und') AS lang, unnest(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) AS piece FROM documents)),
f AS (SELECT lang, size, phrase, count(*) AS f FROM ({grams}) GROUP BY ALL HAVING count(*) >= {LEAST}),
n AS (SELECT lang, CAST(sum(len(w)) AS BIGINT) AS n FROM pieces GROUP BY lang),
c AS (SELECT lang, size, phrase, f AS a, string_split(phrase, ' ') AS w FROM f WHERE size > 1),
cuts AS (SELECT *, array_to_string(w[1:k], ' ') AS p, array_to_string(w[k + 1:], ' ') AS q FROM (SELECT *, unnest(range(1, size)) AS k FROM c)),
s AS (SELECT x.lang, x.phrase, x.a, x.k, l.f AS l, r.f AS r, CAST(CAST({FACTOR} AS HUGEINT) * x.a // (CAST(l.f AS HUGEINT) + r.f) AS BIGINT) AS score FROM cuts x JOIN f l ON l.lang = x.lang AND l.phrase = x.p JOIN f r ON r.lang = x.lang AND r.phrase = x.q),
m AS (SELECT * FROM s QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, k) = 1),
inner_phrases AS (SELECT lang, a, array_to_string(w[i:i + n - 1], ' ') AS phrase FROM (SELECT *, unnest(range(1, size - n + 2)) AS i FROM (SELECT *, unnest(range(2, size)) AS n FROM c WHERE size > 2))),
o AS (SELECT lang, phrase, max(a) AS longer FROM inner_phrases GROUP BY ALL)
SELECT lang, CAST(row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS BIGINT) AS rank, phrase, a, l, r, n, score
FROM m JOIN n USING (lang) LEFT JOIN o USING (lang, phrase) WHERE longer IS NULL OR CAST(longer AS HUGEINT) * 100 < CAST(a AS HUGEINT) * {SHARE} QUALIFY rank <= {TOP}
"""


QUERIES = {"op13_phrases": op13_phrases}
ORACLES = {"op13_phrases": _oracle()}
