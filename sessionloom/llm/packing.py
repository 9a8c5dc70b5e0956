"""Best-fit packing by hierarchical residual rounds.

``pieces`` cuts documents into runs of at most ``size`` tokens. ``pack`` places the pieces: each partition packs
its own by best fit, longest first, and emits the bins that are nearly full, and those that the smallest
underfull bin of all no longer fits into. The other underfull bins are the items of the next round, over as many
partitions as their fewer number asks for, and so on until a round leaves hardly fewer of them. What then
stays open is packed by the number of bins for every fill, ``size`` numbers at most, which the driver packs by best
fit (``fit_counts``): equal bins are made all at once, and each finds its place by its fill and its rank among
the bins of that fill, over many partitions. So no task reads more where more bins stay open. A full piece
is a bin of its own from the start. Every round is a written table, so a lost executor repeats one task and not the
rounds before it.

Nulls: a null text is a document of its end id alone; a null ``doc_id`` is kept. Repeated rows are separate
documents. An empty table gives no rows. Other columns are ignored.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from sessionloom.llm.common import arrow_schema, partitions, slices, stored, text_encoder, word_vocabulary

SIZE = 2048
END_ID = 0
#: Items that a task packs, and where the places of the last round's sequences start.
PER_TASK, LAST_ROUND = 20_000, 120
_PIECES = "doc_id long,piece int,start long,length long,ids_crc32 long"
_PART = "array<struct<doc_id:long,piece:int,start:long,length:long,ids_crc32:long>>"
_BINS = f"partition int,number int,fill long,rank long,parts {_PART}"
_PLACED = f"sequence_id long,first long,parts {_PART}"


def pieces(docs: DataFrame, tokenizer: str, size: int = SIZE, end_id: int = END_ID) -> DataFrame:
    """The pieces of every document: doc_id, piece, start, length, ids_crc32."""
    schema = arrow_schema(_PIECES)

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = text_encoder(tokenizer)
        end = encoder.end(end_id)
        for part in slices(batches, 768):
            out: dict[str, list] = {n: [] for n in schema.names}
            for doc_id, blob in zip(part["doc_id"], encoder.encode(part["text"]), strict=True):
                raw = memoryview(np.frombuffer(blob + end, encoder.dtype).astype("<u4").tobytes())
                for piece, at in enumerate(range(0, len(raw) // 4, size)):
                    ids = raw[4 * at : 4 * (at + size)]
                    for name, value in zip(schema.names, (doc_id, piece, at, len(ids) // 4, zlib.crc32(ids)), strict=True):
                        out[name].append(value)
            yield pa.RecordBatch.from_pydict(out, schema=schema)

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(cut, _PIECES)


def best_fit(lengths: list[int], size: int) -> list[list[int]]:
    """Bins of indexes, by best fit in the given order.

    ``open_bins[r]`` has the bins with room ``r``; the set bits of ``rooms`` say which lists are not empty, so the
    tightest room for an item is one shift and one lowest bit away.
    """
    open_bins: list[list[int]] = [[] for _ in range(size + 1)]
    bins: list[list[int]] = []
    rooms = 0
    for i, length in enumerate(lengths):
        fitting = rooms >> length
        if fitting:
            room = length + (fitting & -fitting).bit_length() - 1
            b = open_bins[room].pop()
            if not open_bins[room]:
                rooms &= ~(1 << room)
            bins[b].append(i)
        else:
            b, room = len(bins), size
            bins.append([i])
        if left := room - length:
            open_bins[left].append(b)
            rooms |= 1 << left
    return bins


def fit_counts(counts: dict[int, int], size: int) -> np.ndarray:
    """Best fit, longest first, of ``counts[length]`` items of every length, without a list of the items.

    Rows (length, rank, per, bin, offset), by length and rank: items of that length from that rank on lie ``per`` to
    a bin, from that bin and that offset on. Bins with the same lengths are kept as one group, so there are
    about as many groups as lengths.
    """
    open_groups: list[list[tuple[int, list[tuple[int, int, int]]]]] = [[] for _ in range(size + 1)]
    rooms = 0
    for length in sorted(counts, reverse=True):
        rank, left = 0, counts[length]
        while left:
            fitting = rooms >> length
            if fitting:
                room = length + (fitting & -fitting).bit_length() - 1
                bins, held = open_groups[room].pop()
            else:
                room, bins, held = size, left, []
            per = min(room // length, left)
            taken = min(bins, left // per)
            if fitting and taken < bins:
                open_groups[room].append((bins - taken, [(n, at + taken * k, k) for n, at, k in held]))
            if not open_groups[room]:
                rooms &= ~(1 << room)
            open_groups[room - per * length].append((taken, [*held, (length, rank, per)]))
            rooms |= 1 << room - per * length
            rank, left = rank + taken * per, left - taken * per
    rows, number = [], 0
    for bins, held in (g for groups in open_groups for g in groups):
        offset = 0
        for length, rank, per in held:
            rows.append((length, rank, per, number, offset))
            offset += per * length
        number += bins
    return np.array(sorted(rows), np.int64).reshape(-1, 5)


def pack(pieces: DataFrame, size: int = SIZE, slack: int = 8, per_task: int = PER_TASK) -> DataFrame:
    """``pieces`` with sequence_id and offset; a bin is nearly full when at most ``slack`` tokens are free.

    A task packs about ``per_task`` items. Rounds go on while each leaves a tenth fewer underfull bins than the one before.
    """
    spark = pieces.sparkSession
    struct_type = pa.list_(pa.struct(list(arrow_schema(_PIECES))))
    schema = pa.schema([("partition", pa.int32()), ("number", pa.int32()), ("fill", pa.int64()), ("rank", pa.int64()), ("parts", struct_type)])
    placed_schema = pa.schema([("sequence_id", pa.int64()), ("first", pa.int64()), ("parts", struct_type)])

    def pack_own(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        items = [(fill, parts) for batch in batches for fill, parts in zip(batch.column("fill").to_pylist(), batch.column("parts").to_pylist(), strict=True)]
        items.sort(key=lambda x: (-x[0], [(p["doc_id"] is not None, p["doc_id"] or 0, p["piece"], p["ids_crc32"]) for p in x[1][:1]]))
        bins = best_fit([x[0] for x in items], size)
        seen = [0] * (size + 1)  # bins of each fill so far
        for at in range(0, len(bins), 256):
            some = bins[at : at + 256]
            fills = [sum(items[i][0] for i in b) for b in some]
            ranks = []
            for f in fills:
                ranks.append(seen[f])
                seen[f] += 1
            yield pa.RecordBatch.from_pydict({"partition": [TaskContext.get().partitionId()] * len(some), "number": list(range(at, at + len(some))), "fill": fills, "rank": ranks, "parts": [[p for i in b for p in items[i][1]] for b in some]}, schema=schema)

    def sequence(number: int):
        return F.lit(number).cast("long") * F.lit(1 << 56) + F.col("partition").cast("long") * F.lit(1 << 32) + F.col("number")

    part = F.array(F.struct("doc_id", "piece", "start", "length", "ids_crc32"))
    whole = pieces.filter(F.col("length") >= size).select(F.spark_partition_id().alias("partition"), F.monotonically_increasing_id().bitwiseAND((1 << 31) - 1).cast("int").alias("number"), part.alias("parts"))
    whole = stored(whole.select(sequence(0).alias("sequence_id"), F.lit(0).cast("long").alias("first"), "parts"), "packed")
    left = pieces.filter(F.col("length") < size).select(F.col("length").alias("fill"), part.alias("parts"))
    total = left.count()
    count, open_before, done = max(1, min(partitions(spark), total // 1000), -(-total // per_task)), total, []
    items = left
    while True:
        bins = stored(items.repartition(count, F.xxhash64("parts")).mapInArrow(pack_own, _BINS), "packed")
        smallest = bins.filter(F.col("fill") < size - slack).agg(F.min("fill")).first()[0] or size
        full = F.col("fill") >= min(size - slack, size - smallest + 1)  # by fill alone, so ranks stay whole
        done.append(bins.filter(full).select(sequence(1 + len(done)).alias("sequence_id"), F.lit(0).cast("long").alias("first"), "parts"))
        underfull = bins.filter(~full)
        n_open = underfull.count()
        if n_open <= per_task or n_open > 0.9 * open_before or len(done) > 100:
            break
        items, count, open_before = underfull.select("fill", "parts"), -(-n_open // per_task), n_open
    closed = reduce(DataFrame.unionByName, done)
    tally = underfull.groupBy("partition", "fill").agg(F.count("*").alias("n"))
    plan = fit_counts({r["fill"]: r["n"] for r in tally.groupBy("fill").agg(F.sum("n").alias("n")).collect()}, size)  # ``size`` rows at most
    shared = spark.sparkContext.broadcast(plan)

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        length, rank, per, number, offset = shared.value.T
        keys = length << 40 | rank
        for batch in batches:
            fills, ranks = batch.column("fill").to_numpy(), batch.column("rank").to_numpy()
            row = np.searchsorted(keys, fills << 40 | ranks, side="right") - 1
            after = ranks - rank[row]
            sequences = (LAST_ROUND << 56) + number[row] + after // per[row]
            yield pa.RecordBatch.from_arrays([pa.array(sequences), pa.array(offset[row] + after % per[row] * fills), batch.column("parts").cast(struct_type)], schema=placed_schema)

    before_own = Window.partitionBy("fill").orderBy("partition").rowsBetween(Window.unboundedPreceding, -1)
    bases = tally.select("partition", "fill", F.coalesce(F.sum("n").over(before_own), F.lit(0)).alias("base"))
    ranked = underfull.join(bases, ["partition", "fill"]).select("fill", (F.col("base") + F.col("rank")).alias("rank"), "parts")
    packed = whole.unionByName(closed).unionByName(ranked.mapInArrow(place, _PLACED))
    before = F.aggregate(F.slice("parts", F.lit(1), F.col("at")), F.lit(0).cast("long"), lambda sum_, p: sum_ + p["length"])
    rows = packed.select("sequence_id", "first", "parts", F.posexplode("parts").alias("at", "p"))
    return rows.select("p.*", "sequence_id", (F.col("first") + F.when(F.col("at") == 0, F.lit(0).cast("long")).otherwise(before)).alias("offset"))


def op8_best_fit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All ``documents`` packed into sequences of at most 2048 tokens; one row per piece."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return pack(stored(pieces(docs, word_vocabulary()), "pieces"))


QUERIES = {"op8_best_fit": op8_best_fit}
