"""Token-ID output: concatenated ids with Elias-Fano coded document boundaries.

``write_tokens`` encodes texts and writes segments in ascending ``doc_id`` order; ``read_tokens`` opens them again.
A segment is one binary value of a Parquet file: a header, the Elias-Fano codes of the document ends and of the
sorted document ids, and the ids of all its documents one after the other, two bytes each where the vocabulary
allows. Segments hold about ``segment_ids`` ids, so neither a writer nor a reader needs more than one in memory,
and Spark commits the files, so a lost executor leaves no half-written segment.

Nulls: a null text has no ids but its end id; a null ``doc_id`` sorts before all others. Rows that repeat a
``doc_id`` stay, ordered by text. An empty table gives an empty store. Other columns are ignored.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from sessionloom.llm.common import arrow_schema, partitions, slices, text_encoder, word_vocabulary, work_path

END_ID = 1
SAMPLE = 256
_CODE = struct.Struct("<qqBq")
_HEAD = struct.Struct("<4sBqqqqq")


class EliasFano:
    """A non-decreasing sequence of integers from 0 in about ``2 + log2(u / n)`` bits each.

    The low bits stand packed; the high bits in unary, with the place of every 256th one (``samples``), so that
    ``select`` reads a few words only. Nothing is ever unpacked as a whole.
    """

    def __init__(self, n: int, low_bits: int, low: bytes, high: bytes, samples: np.ndarray):
        self.n, self.low_bits, self.low, self.high, self.samples = n, low_bits, low, high, samples

    @classmethod
    def of(cls, values: np.ndarray) -> EliasFano:
        values = np.asarray(values, dtype=np.int64)
        n = len(values)
        top = int(values[-1]) if n else 0
        low_bits = max(0, (top // n).bit_length() - 1) if n else 0
        places = (values >> low_bits) + np.arange(n)
        bits = np.zeros(int(places[-1]) + 1 if n else 0, dtype=np.uint8)
        bits[places] = 1
        low = (values[:, None] >> np.arange(low_bits)) & 1
        return cls(n, low_bits, np.packbits(low.astype(np.uint8).ravel(), bitorder="little").tobytes(), np.packbits(bits, bitorder="little").tobytes(), places[::SAMPLE].astype("<i8"))

    def to_bytes(self) -> bytes:
        return _CODE.pack(self.n, len(self.low), self.low_bits, len(self.high)) + self.low + self.high + self.samples.tobytes()

    @classmethod
    def parse(cls, raw: memoryview, at: int) -> tuple[EliasFano, int]:
        n, n_low, low_bits, n_high = _CODE.unpack_from(raw, at)
        at += _CODE.size
        low, high = bytes(raw[at : at + n_low]), bytes(raw[at + n_low : at + n_low + n_high])
        at += n_low + n_high
        n_samples = -(-n // SAMPLE)
        return cls(n, low_bits, low, high, np.frombuffer(raw, "<i8", n_samples, at)), at + 8 * n_samples

    def select(self, i: int) -> int:
        """Value ``i``: from the nearest sampled place on, words of 64 high bits are counted until its bit is met."""
        if not 0 <= i < self.n:
            raise IndexError(i)
        place, left = int(self.samples[i // SAMPLE]), i % SAMPLE
        byte = place // 8
        word = int.from_bytes(self.high[byte : byte + 8], "little") >> place % 8 << place % 8
        while (ones := word.bit_count()) <= left:
            left, byte = left - ones, byte + 8
            word = int.from_bytes(self.high[byte : byte + 8], "little")
        for _ in range(left):
            word &= word - 1
        high = 8 * byte + (word & -word).bit_length() - 1 - i
        at = i * self.low_bits
        low = int.from_bytes(self.low[at // 8 : (at + self.low_bits + 7) // 8], "little") >> (at % 8)
        return high << self.low_bits | low & ((1 << self.low_bits) - 1)


class Segment:
    """One written segment: the ids of ``n_docs`` documents."""

    def __init__(self, raw: bytes):
        view = memoryview(raw)
        magic, width, self.n_docs, self.n_null, self.first_id, self.n_ids, _ = _HEAD.unpack_from(view)
        if magic != b"EFT1":
            raise ValueError("not a token segment")
        self.ends, at = EliasFano.parse(view, _HEAD.size)
        self.doc_codes, at = EliasFano.parse(view, at)
        self.ids = np.frombuffer(view, f"<u{width}", self.n_ids, at)

    @staticmethod
    def pack(doc_ids: list[int | None], blobs: list[bytes], width: int) -> bytes:
        ends = np.cumsum([len(b) // width for b in blobs])
        known = np.array([d for d in doc_ids if d is not None], dtype=np.int64)
        first = int(known[0]) if len(known) else 0
        head = _HEAD.pack(b"EFT1", width, len(blobs), len(doc_ids) - len(known), first, int(ends[-1]) if len(ends) else 0, 0)
        return b"".join([head, EliasFano.of(ends).to_bytes(), EliasFano.of(known - first).to_bytes(), *blobs])

    def bounds(self, i: int) -> tuple[int, int]:
        """Where document ``i`` begins and ends; two selects, no table of offsets."""
        return self.ends.select(i - 1) if i else 0, self.ends.select(i)

    def doc(self, i: int) -> np.ndarray:
        """The ids of document ``i``."""
        begin, end = self.bounds(i)
        return self.ids[begin:end]

    def doc_id(self, i: int) -> int | None:
        return None if i < self.n_null else self.first_id + self.doc_codes.select(i - self.n_null)


_SEGMENTS = "shard long,segment int,n_docs long,n_ids long,start_in_shard long,data binary"


def write_tokens(docs: DataFrame, path: str, tokenizer: str, end_id: int = END_ID, segment_ids: int = 1_000_000) -> None:
    """Encode ``docs`` (doc_id, text) and write the segments of all documents, in ascending ``doc_id`` order.

    Texts are range-partitioned once by ``doc_id`` and encoded after that, so the partition bounds are found
    without encoding anything; shard numbers ascend with the ids.
    """
    schema = arrow_schema(_SEGMENTS)

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        shard, encoder = TaskContext.get().partitionId(), text_encoder(tokenizer)
        width, end, written, number = int(encoder.dtype[-1]), encoder.end(end_id), 0, 0
        ids: list = []
        blobs: list[bytes] = []

        def segment() -> pa.RecordBatch:
            n = sum(map(len, blobs)) // width
            return pa.RecordBatch.from_pydict({"shard": [shard], "segment": [number], "n_docs": [len(blobs)], "n_ids": [n], "start_in_shard": [written], "data": [Segment.pack(ids, blobs, width)]}, schema=schema)

        held = 0
        for part in slices(batches, 768):
            for doc_id, blob in zip(part["doc_id"], encoder.encode(part["text"]), strict=True):
                ids.append(doc_id)
                blobs.append(blob + end)
                held += len(blobs[-1]) // width
                if held >= segment_ids:
                    yield segment()
                    written, number, held, ids, blobs = written + held, number + 1, 0, [], []
        if blobs:
            yield segment()

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    spread = rows.repartitionByRange(partitions(docs.sparkSession), "doc_id").sortWithinPartitions("doc_id", "text")
    spread.mapInArrow(pack, _SEGMENTS).write.option("compression", "none").parquet(path)


def read_tokens(spark: SparkSession, path: str, each: Callable[[Segment, int], dict[str, list]], schema: str) -> DataFrame:
    """Rows that ``each(segment, ids before it)`` gives for every written segment.

    The start of a shard is the sum of the shards before it: a window over one row per shard, whose number is
    that of the write's partitions, which also bounds the broadcast.
    """
    segments = spark.read.parquet(path)
    sizes = segments.groupBy("shard").agg(F.sum("n_ids").alias("n"))
    before = F.sum("n").over(Window.orderBy("shard").rowsBetween(Window.unboundedPreceding, -1))
    starts = sizes.select("shard", F.coalesce(before, F.lit(0)).alias("shard_start"))
    out = arrow_schema(schema)

    def unpack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                row = batch.slice(i, 1)
                data, start = row.column("data")[0].as_py(), row.column("start")[0].as_py()
                yield pa.RecordBatch.from_pydict(each(Segment(data), start), schema=out)

    placed = segments.join(F.broadcast(starts), "shard").select("data", (F.col("shard_start") + F.col("start_in_shard")).alias("start"))
    return placed.mapInArrow(unpack, schema)


def digests(segment: Segment, start: int) -> dict[str, list]:
    """One row for each document of a segment; every boundary is a select in the stored codes."""
    raw = memoryview(segment.ids.astype("<u4").tobytes())
    out: dict[str, list] = {"doc_id": [], "start": [], "n_tokens": [], "ids_crc32": []}
    end = 0
    for i in range(segment.n_docs):
        begin, end = end, segment.ends.select(i)
        for name, value in zip(out, (segment.doc_id(i), start + begin, end - begin, zlib.crc32(raw[4 * begin : 4 * end])), strict=True):
            out[name].append(value)
    return out


def op2_token_store(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Encode and write all ``documents``, then digest what is read back; one row per document."""
    path = work_path(spark, "tokens")
    write_tokens(spark.read.parquet(f"{sf_dir}/documents.parquet"), path, word_vocabulary())
    return read_tokens(spark, path, digests, "doc_id long,start long,n_tokens long,ids_crc32 long")


QUERIES = {"op2_token_store": op2_token_store}
