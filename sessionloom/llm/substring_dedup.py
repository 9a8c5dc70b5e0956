"""Substring deduplication with difference-cover anchors.

A word window of ``window`` words is removed where the same words also start earlier (smaller doc_id, or the same
document further left). Windows are compared in three steps over a written table of chunks of documents:

1. Anchors. Windows of ``window - period + 1`` words are hashed only at word places that lie in a difference cover
   modulo ``period``. For any two equal windows some shift below ``period`` puts both on cover places, so they share
   an anchor there. Chunks send their distinct anchor hashes to hash buckets, as arrays; a bucket answers with a
   bit for each: does another chunk have it too?
2. Windows. Only windows that hold a repeated anchor, extended to their full length, are hashed in full (96 bits).
   Of equal windows in a chunk the earliest alone goes to its bucket, which answers with those that start earlier in
   another chunk.
3. Removal. Each chunk drops the words of all windows so found.

No pair of occurrences is ever made, and a sequence that many documents hold enters a bucket once per chunk,
so hot passages cost no more than others.

Nulls: a null text has no words. A null doc_id comes before all others. Rows with the same doc_id are one place in
the order, so equal windows at equal starts of them stay. An empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from itertools import compress

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sessionloom.llm.common import arrow_schema, partitions, slices, stored
from sessionloom.llm.words import Flat, WordHashes, bucket_of, split_words, windows

WINDOW, PERIOD = 20, 13
#: Residues whose differences give every residue modulo 13 (a perfect difference set).
COVER = (0, 1, 3, 9)
CHUNK_WORDS = 500_000
#: Chunks of a partition, and documents of a chunk, are fewer than two to this power.
PLACE_BITS = 20
#: Hash buckets are at least the number of chunks by this, so what one holds doesn't grow with the table; some share a task.
CHUNKS_A_BUCKET, BUCKETS_A_TASK = 8, 4
NULL_ID = -(1 << 63)
_CHUNKS = "chunk long,payload binary"
_RESULT = "doc_id long,n_words long,n_removed long,kept_sha256 string,kept string"


class Chunk:
    """Documents in ascending order of doc_id."""

    def __init__(self, doc_ids: np.ndarray, texts: list[str | None]):
        self.doc_ids, self.texts = doc_ids, texts

    def pack(self) -> bytes:
        raw = [(t or "").encode("utf-8", "surrogatepass") for t in self.texts]
        sizes = np.array([len(r) for r in raw], "<i8")
        head = np.array([len(raw)], "<i8").tobytes() + self.doc_ids.astype("<i8").tobytes() + sizes.tobytes()
        return zstandard.ZstdCompressor(level=3).compress(head + b"".join(raw))

    @classmethod
    def unpack(cls, packed: bytes) -> Chunk:
        raw = memoryview(zstandard.ZstdDecompressor().decompress(packed))
        n = int(np.frombuffer(raw, "<i8", 1)[0])
        ids, sizes = np.frombuffer(raw, "<i8", n, 8), np.frombuffer(raw, "<i8", n, 8 + 8 * n)
        ends = 8 + 16 * n + np.cumsum(sizes)
        return cls(ids, [str(raw[e - s : e], "utf-8", "surrogatepass") for e, s in zip(ends.tolist(), sizes.tolist(), strict=True)])

    def flat(self, hashes: WordHashes) -> tuple[list[list[bytes]], Flat]:
        words = [split_words(t) for t in self.texts]
        return words, Flat(words, hashes)


def chunks(docs: DataFrame, words: int = CHUNK_WORDS) -> DataFrame:
    """The documents as a written table of compressed chunks of about ``words`` words, one chunk a row."""
    schema = arrow_schema(_CHUNKS)

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        held: list[tuple[int, str]] = []
        size, number = 0, TaskContext.get().partitionId() << PLACE_BITS

        def chunk() -> pa.RecordBatch:
            held.sort()
            packed = Chunk(np.array([x[0] for x in held], np.int64), [x[1] for x in held]).pack()
            return pa.RecordBatch.from_pydict({"chunk": [number], "payload": [packed]}, schema=schema)

        for part in slices(batches):
            for doc_id, text in zip(part["doc_id"], part["text"], strict=True):
                held.append((NULL_ID if doc_id is None else doc_id, text or ""))
                size += 1 + len(text or "") // 6
                if size >= words:
                    yield chunk()
                    held, size, number = [], 0, number + 1
        if held:
            yield chunk()

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return stored(rows.mapInArrow(pack, _CHUNKS), "chunks")


def anchors(flat: Flat, window: int, period: int, cover: tuple[int, ...]) -> tuple[np.ndarray, np.ndarray]:
    """Places and hashes of the anchors of documents that have a whole window."""
    size = window - period + 1
    places = np.flatnonzero(np.isin(flat.at % period, cover) & (flat.at + size <= flat.n[flat.doc]) & (flat.n[flat.doc] >= window))
    found = windows(flat.hashes, size)
    return places, found[places] if len(places) else found[:0]


def bucket_count(table: DataFrame) -> int:
    return max(BUCKETS_A_TASK * partitions(table.sparkSession), -(-table.count() // CHUNKS_A_BUCKET))


def by_bucket(h: np.ndarray, buckets: int) -> Iterator[tuple[int, slice]]:
    """Runs of equal bucket in ascending hashes."""
    b = bucket_of(h, buckets)
    edges = np.flatnonzero(np.diff(b)) + 1
    for lo, hi in zip([0, *edges.tolist()], [*edges.tolist(), len(h)], strict=True):
        if hi > lo:
            yield int(b[lo]), slice(lo, hi)


def repeated_windows(table: DataFrame, window: int = WINDOW, period: int = PERIOD, cover: tuple[int, ...] = COVER) -> DataFrame:
    """(chunk, places): the places in each chunk's word array at which a window starts that also starts earlier."""
    buckets = bucket_count(table)
    sent = arrow_schema("bucket int,chunk long,hashes binary")

    def send_anchors(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes = WordHashes()
        for part in slices(batches, 1):
            _, flat = Chunk.unpack(part["payload"][0]).flat(hashes)
            found = np.unique(anchors(flat, window, period, cover)[1])
            runs = list(by_bucket(found, buckets))
            yield pa.RecordBatch.from_pydict({"bucket": [b for b, _ in runs], "chunk": part["chunk"] * len(runs), "hashes": [found[r].astype("<u8").tobytes() for _, r in runs]}, schema=sent)

    answered = arrow_schema("chunk long,bucket int,bits binary")

    def meet_anchors(rows: pa.Table) -> pa.Table:
        arrays = [np.frombuffer(x.as_py(), "<u8") for x in rows.column("hashes")]
        found, counts = np.unique(np.concatenate(arrays), return_counts=True)
        many = found[counts > 1]
        bits = [np.packbits(_member(a, many)).tobytes() for a in arrays]
        return pa.table({"chunk": rows.column("chunk"), "bucket": rows.column("bucket"), "bits": bits}).cast(answered)

    anchored = table.mapInArrow(send_anchors, "bucket int,chunk long,hashes binary")
    bits = anchored.repartition(buckets // BUCKETS_A_TASK, "bucket").groupBy("bucket").applyInArrow(meet_anchors, "chunk long,bucket int,bits binary")
    bits = bits.groupBy("chunk").agg(F.sort_array(F.collect_list(F.struct("bucket", "bits"))).alias("answers"))

    full = arrow_schema("bucket int,chunk long,places binary,ids binary,starts binary,high binary,low binary")

    def send_windows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes = WordHashes()
        for part in slices(batches, 1):
            chunk = Chunk.unpack(part["payload"][0])
            _, flat = chunk.flat(hashes)
            places, h = anchors(flat, window, period, cover)
            found, back, counts = np.unique(h, return_inverse=True, return_counts=True)
            known = counts > 1
            sizes = dict(by_bucket(found, buckets))
            for answer in part["answers"][0] or []:
                run = sizes[answer["bucket"]]
                known[run] |= np.unpackbits(np.frombuffer(answer["bits"], np.uint8), count=run.stop - run.start).astype(bool)
            starts = _holding(places[known[back]], flat, window, period)
            high, low = windows(flat.hashes, window)[starts], windows(flat.hashes, window, 1)[starts].astype(np.uint32)
            ids, at = chunk.doc_ids[flat.doc[starts]], flat.at[starts]
            order = np.lexsort((at, ids, low, high))
            new = np.ones(len(order), bool)
            new[1:] = (high[order][1:] != high[order][:-1]) | (low[order][1:] != low[order][:-1])
            head = order[np.maximum.accumulate(np.where(new, np.arange(len(order)), 0))]
            earliest = (ids[order] == ids[head]) & (at[order] == at[head])
            here = np.sort(starts[order[~earliest]])
            first = order[earliest]  # ascending in high
            runs = list(by_bucket(high[first], buckets))
            columns = {"places": (starts, "<u4"), "ids": (ids, "<i8"), "starts": (at, "<u4"), "high": (high, "<u8"), "low": (low, "<u4")}
            out = {"bucket": [-1] + [b for b, _ in runs], "chunk": part["chunk"] * (len(runs) + 1)}
            out |= {n: [here.astype("<u4").tobytes() if n == "places" else b""] + [a[first[r]].astype(k).tobytes() for _, r in runs] for n, (a, k) in columns.items()}
            yield pa.RecordBatch.from_pydict(out, schema=full)

    def meet_windows(rows: pa.Table) -> pa.Table:
        if rows.column("bucket")[0].as_py() < 0:
            return rows.select(["chunk", "places"])
        column = lambda n, k: [np.frombuffer(x.as_py(), k) for x in rows.column(n)]
        places = column("places", "<u4")
        ids, at, high, low = (np.concatenate(column(n, k)) for n, k in (("ids", "<i8"), ("starts", "<u4"), ("high", "<u8"), ("low", "<u4")))
        order = np.lexsort((at, ids, low, high))
        new = np.ones(len(order), bool)
        new[1:] = (high[order][1:] != high[order][:-1]) | (low[order][1:] != low[order][:-1])
        head = order[np.maximum.accumulate(np.where(new, np.arange(len(order)), 0))]
        later = np.zeros(len(order), bool)
        later[order] = (ids[order] != ids[head]) | (at[order] != at[head])
        ends = np.cumsum([len(p) for p in places])
        found = [p[later[e - len(p) : e]].tobytes() for p, e in zip(places, ends.tolist(), strict=True)]
        return pa.table({"chunk": rows.column("chunk"), "places": pa.array(found, pa.binary())})

    sent_windows = table.join(bits, "chunk", "left").mapInArrow(send_windows, "bucket int,chunk long,places binary,ids binary,starts binary,high binary,low binary")
    local = sent_windows.withColumn("key", F.when(F.col("bucket") < 0, -1 - F.pmod("chunk", F.lit(buckets)).cast("int")).otherwise(F.col("bucket")))
    return local.repartition(2 * buckets // BUCKETS_A_TASK, "key").groupBy("key").applyInArrow(lambda t: meet_windows(t.drop_columns(["key"])), "chunk long,places binary")


def _member(values: np.ndarray, ascending: np.ndarray) -> np.ndarray:
    if not len(ascending):
        return np.zeros(len(values), bool)
    return ascending[np.minimum(np.searchsorted(ascending, values), len(ascending) - 1)] == values


def _holding(places: np.ndarray, flat: Flat, window: int, period: int) -> np.ndarray:
    """Starts of the windows that have one of the anchor ``places`` within their first ``period`` words."""
    marks = np.zeros(len(flat.hashes) + 1, np.int32)
    low = np.maximum(places - (period - 1), flat.start[flat.doc[places]]) if len(places) else places
    np.add.at(marks, low, 1)
    np.add.at(marks, places + 1, -1)
    return np.flatnonzero((np.cumsum(marks)[:-1] > 0) & (flat.at + window <= flat.n[flat.doc]))


def drop_repeats(docs: DataFrame, window: int = WINDOW, period: int = PERIOD, cover: tuple[int, ...] = COVER) -> DataFrame:
    """doc_id, n_words, n_removed, kept_sha256 and ``kept``, the words that stay joined by one blank."""
    table = chunks(docs)
    found = repeated_windows(table, window, period, cover).groupBy("chunk").agg(F.collect_list("places").alias("places"))
    schema = arrow_schema(_RESULT)

    def remove(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches, 1):
            chunk = Chunk.unpack(part["payload"][0])
            words = [split_words(t) for t in chunk.texts]
            n = np.array([len(w) for w in words], np.int64)
            marks = np.zeros(int(n.sum()) + window + 1, np.int32)
            for raw in part["places"][0] or []:
                places = np.frombuffer(raw, "<u4")
                np.add.at(marks, places, 1)
                np.add.at(marks, places + window, -1)
            kept = np.cumsum(marks) == 0
            out: dict[str, list] = {c: [] for c in schema.names}
            at = 0
            for doc_id, own in zip(chunk.doc_ids.tolist(), words, strict=True):
                stays = kept[at : at + len(own)]
                at += len(own)
                n_kept = int(stays.sum())
                text = b" ".join(own if n_kept == len(own) else list(compress(own, stays.tolist())))
                row = (None if doc_id == NULL_ID else doc_id, len(own), len(own) - n_kept, hashlib.sha256(text).hexdigest(), text.decode("utf-8", "surrogatepass"))
                for name, value in zip(schema.names, row, strict=True):
                    out[name].append(value)
            yield pa.RecordBatch.from_pydict(out, schema=schema)

    return table.join(found, "chunk", "left").mapInArrow(remove, _RESULT)


def op4_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All ``documents`` without the words of windows of 20 that also start earlier."""
    return drop_repeats(spark.read.parquet(f"{sf_dir}/documents.parquet")).drop("kept")


_ORACLE = r"""
WITH w AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
g AS (SELECT doc_id, unnest(range(1, len(w) - 18)) AS pos, w FROM w WHERE len(w) >= 20),
k AS (SELECT doc_id, pos, sha256(array_to_string(w[pos:pos + 19], ' ')) AS h FROM g),
f AS (SELECT doc_id, pos, first_value(doc_id) OVER o AS d, first_value(pos) OVER o AS a FROM k WINDOW o AS (PARTITION BY h ORDER BY doc_id, pos)),
x AS (SELECT DISTINCT doc_id, unnest(range(pos, pos + 20)) AS pos FROM f WHERE d < doc_id OR d = doc_id AND a < pos),
p AS (SELECT doc_id, unnest(w) AS word, unnest(range(1, len(w) + 1)) AS pos FROM w),
j AS (SELECT p.doc_id, string_agg(p.word, ' ' ORDER BY p.pos) FILTER (x.pos IS NULL) AS kept, count(x.pos) AS gone FROM p LEFT JOIN x ON x.doc_id = p.doc_id AND x.pos = p.pos GROUP BY p.doc_id)
SELECT w.doc_id, len(w.w) AS n_words, coalesce(j.gone, 0) AS n_removed, sha256(coalesce(j.kept, '')) AS kept_sha256 FROM w LEFT JOIN j ON j.doc_id = w.doc_id
"""
QUERIES = {"op4_substring_dedup": op4_substring_dedup}
ORACLES = {"op4_substring_dedup": _ORACLE}
