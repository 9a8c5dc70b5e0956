"""SimHash near-duplicate groups by one-wildcard variants of half fingerprints.

A fingerprint has 64 bits; bit b is 1 if it is set in over half the XXH64 (seed 42) of a document's 3-word shingles,
repeats included. Fingerprints of at most ``MOST_BITS`` = 3 differing bits link.

1. ``fingerprints``: one pass over the texts. From here on equal fingerprints are one row.
2. ``variants``: two segments of 32 bits are few enough that of two linked fingerprints one segment differs by at most one
   bit. A segment's one-wildcard variants are what it becomes when one of its bits is deleted, that is, cleared; deleting a
   bit that is 0 gives the segment itself, so these are one row, and a segment has one variant more than it has ones.
3. ``variant_links``: an equality join of variants with segments, and the exact distance. Of two segments that differ in one bit, the one
   in which it is 1 has the other as a variant. A pair is reported by the first segment that finds it, so once.
4. Segments that more than ``CROWDED`` fingerprints share, as in large groups of near copies, would make all pairs of a
   group. Fingerprints with such a segment, or one a bit from it, are connected through ``centres`` instead: of three differing
   bits two lie in one half, so any two linked fingerprints have a centre that is at most one flipped bit away from one of them and at most
   one bit, or two bits of one half, away from the other; and whatever is that near to a centre which some fingerprint is at most one bit
   from is linked with that fingerprint. Each fingerprint meets 65 + 992 centres and a centre at most 65 + 992 fingerprints, so rows
   grow with the fingerprints, whatever the groups.
5. Links are closed to components (``ngram_join.components``).

Nulls: a null text, or one without words, has fingerprint zero and links like any other; a text of fewer than three words
has its whole sequence as its only shingle. A document with a null doc_id links like any other, but its id never
names a component; a component of such documents alone has none. Repeated rows have equal fingerprints. An
empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from sessionloom.llm.common import arrow_schema, hot_join, slices, stored
from sessionloom.llm.ngram_join import components
from sessionloom.llm.words import split_words

SHINGLE, SEED, MOST_BITS, CROWDED = 3, 42, 3, 32
HALF = 32


def shingle_hashes(text: str | None, size: int = SHINGLE) -> np.ndarray:
    """XXH64 of every run of ``size`` words joined by one blank; of all words where there are fewer."""
    words = split_words(text, lower=True)
    if not words:
        return np.empty(0, np.uint64)
    joined = b" ".join(words)
    ends = np.cumsum([len(w) + 1 for w in words]) - 1
    starts = np.concatenate([[0], ends[:-1] + 1])
    n = max(1, len(words) - size + 1)
    digest = xxhash.xxh64_intdigest
    return np.fromiter((digest(joined[a:b], SEED) for a, b in zip(starts[:n].tolist(), ends[-n:].tolist(), strict=True)), np.uint64, n)


def fingerprint(hashes: np.ndarray) -> int:
    """As a signed 64-bit integer."""
    ones = np.zeros(64, np.int64)
    for at in range(0, len(hashes), 100_000):
        part = hashes[at : at + 100_000].astype("<u8")
        ones += np.unpackbits(part.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * ones > len(hashes), bitorder="little").view("<i8")[0])


def fingerprints(docs: DataFrame, size: int = SHINGLE) -> DataFrame:
    """doc_id and fingerprint (long) of all rows."""
    ddl = "doc_id long,fingerprint long"
    schema = arrow_schema(ddl)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches, 64):
            yield pa.RecordBatch.from_pydict({"doc_id": part["doc_id"], "fingerprint": [fingerprint(shingle_hashes(t, size)) for t in part["text"]]}, schema=schema)

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(run, ddl)


def _half(fp: Column, half: int) -> Column:
    return F.shiftrightunsigned(fp, 32) if half else fp.bitwiseAND(F.lit((1 << HALF) - 1))


def segments(fps: DataFrame) -> DataFrame:
    """(segment, fp): both halves of each ``fp``; bit 32 of the segment tells which half it is."""
    return fps.select(F.explode(F.array(*[_half(F.col("fp"), half) + F.lit(half << HALF) for half in (0, 1)])).alias("segment"), "fp")


def shuffled_join(exploded: DataFrame, other: DataFrame, key: str) -> DataFrame:
    """An inner join by ``key`` that shuffles both sides: Spark takes exploded rows for as few as those they come from, and would broadcast up to a thousand times what it allows."""
    return exploded.hint("merge").join(other, key)


def variants(parts: DataFrame) -> DataFrame:
    """(key, fp): each segment as it is, and with one of its ones deleted."""
    ones = F.filter(F.array(*[F.lit(1 << bit) for bit in range(HALF)]), lambda b: F.col("segment").bitwiseAND(b) != 0)
    return parts.select(F.explode(F.concat(F.array("segment"), F.transform(ones, lambda b: F.col("segment") - b))).alias("key"), "fp")


def variant_links(parts: DataFrame, most: int = MOST_BITS) -> DataFrame:
    """Pairs (a, b) of linked fingerprints, each once, out of segments (segment, fp) of which no value is crowded."""
    met = shuffled_join(variants(parts).withColumnRenamed("fp", "x"), parts.select(F.col("segment").alias("key"), F.col("fp").alias("y")), "key")
    differing = F.col("x").bitwiseXOR(F.col("y"))
    low, high = (F.bit_count(_half(differing, half)) for half in (0, 1))
    upper = F.shiftright("key", HALF) == 1
    once = ((low > 0) | upper | (F.col("x") < F.col("y"))) & ((high > 0) | ~upper | (F.col("x") < F.col("y")))
    return met.filter((F.col("x") != F.col("y")) & (F.bit_count(differing) <= most) & (~upper | (low > 1)) & once).select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b"))


def _flips(fps: DataFrame, masks: list[int]) -> DataFrame:
    signed = [m - (1 << 64) if m >> 63 else m for m in masks]
    return fps.withColumn("centre", F.explode(F.transform(F.array(*[F.lit(m).cast("long") for m in signed]), lambda m: m.bitwiseXOR(F.col("fp")))))


def centre_links(fps: DataFrame) -> DataFrame:
    """Pairs (a, b) that connect whatever links among ``fps``, and nothing else: each fingerprint near a centre with the smallest one that is at most one bit from it."""
    one = [0, *[1 << b for b in range(64)]]
    two = [1 << half + a | 1 << half + b for half in (0, HALF) for a in range(HALF) for b in range(a)]
    near = stored(_flips(fps, one), "centres")
    least = near.groupBy("centre").agg(F.min("fp").alias("a"))
    return shuffled_join(near.unionByName(_flips(fps, two)), least, "centre").filter("a <> fp").select("a", F.col("fp").alias("b")).distinct()


def links(fps: DataFrame, crowded: int = CROWDED) -> DataFrame:
    """Written pairs (a, b) that connect what links among the distinct fingerprints ``fps`` (fp), a written table."""
    parts = segments(fps)
    full = stored(parts.groupBy("segment").agg(F.count("*").alias("c")).filter(F.col("c") > crowded), "crowded-segments")
    if full.isEmpty():
        return stored(variant_links(parts), "links")
    one_bit = F.transform(F.array(F.lit(0), *[F.lit(1 << bit) for bit in range(HALF)]), lambda b: F.col("segment").bitwiseXOR(b.cast("long")))
    around = full.select(F.explode(one_bit).alias("segment"), "c").groupBy("segment").agg(F.max("c").alias("c"))
    around = stored(around.join(full.select("segment", F.lit(True).alias("is_full")), "segment", "left"), "around-crowded")
    met = stored(hot_join(parts, around.withColumn("n", F.col("c")), ["segment"], "c", ["fp"]), "segments")
    through = centre_links(stored(met.filter("n is not null").select("fp").distinct(), "crowded"))
    return stored(variant_links(met.filter("is_full is null").select("segment", "fp")).unionByName(through).distinct(), "links")


def near_groups(docs: DataFrame, size: int = SHINGLE, crowded: int = CROWDED) -> DataFrame:
    """doc_id, fingerprint (long), component_id: the smallest doc_id that links lead to."""
    signed = stored(fingerprints(docs, size), "fingerprints")
    classes = stored(signed.groupBy(F.col("fingerprint").alias("fp")).agg(F.min("doc_id").alias("rep"), F.count("*").alias("c")), "classes")
    labels = components(links(classes.select("fp"), crowded)).withColumnRenamed("node", "fp")
    named = classes.join(labels, "fp", "left").withColumn("label", F.coalesce("label", "fp"))
    names = stored(named.groupBy("label").agg(F.min("rep").alias("component_id"), F.count("*").alias("k")), "names")
    of_class = stored(hot_join(named, names, ["label"], "k", ["fp"]).select(F.col("fp").alias("fingerprint"), "component_id", "c"), "class-names")
    return hot_join(signed, of_class, ["fingerprint"], "c", ["doc_id"])


def op11_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Groups of all ``documents`` whose SimHash fingerprints are connected by steps of at most three bits."""
    found = near_groups(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return found.select("doc_id", F.lpad(F.lower(F.hex("fingerprint")), 16, "0").alias("fingerprint"), "component_id")


QUERIES = {"op11_simhash": op11_simhash}
