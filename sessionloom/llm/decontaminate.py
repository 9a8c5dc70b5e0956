"""Benchmark decontamination by template canonicalisation.

Texts become sequences of template tokens: words in lower case, with typed placeholders for numbers, for units after
a number and for names (runs of capitalised words within a sentence). Windows of ``WINDOW`` template tokens of documents are
hash-joined with those of the benchmark, so a question whose numbers and names were replaced still meets its item.
Along each alignment of a document with an item the slots must then be consistent: one value of the item stands for
one value of the document. A document is contaminated by an item when consistent windows cover enough of it.

Documents are read once: their windows first meet a bit array of the benchmark's hashes, of ``MOST_BITS`` at most, built in
tasks and broadcast; those that pass it are joined with the items' windows by hash, frequent hashes being dealt to
several tasks; a template that very many items share stands in blocks of ``ITEM_BLOCK`` windows. A larger benchmark lets more windows pass to the join, which drops them.

A window that is mostly slots would meet too much by its template. It counts with its tokens as they stand, so that a
verbatim copy is found, and the smallest window of twice, four times ... the size that starts there and has enough
plain words counts with its template. Where such windows cover too little of an item, the item is one more window
as a whole; one plain word is enough for it, a first word that would be a name within a sentence is tried as one,
and left off where enough plain words follow. An item without any plain word is met verbatim only.

Nulls: a null text has no tokens; null ids are kept as they are in documents and are ignored in the benchmark. An item shorter than a window is one shorter window, compared as a whole with windows of
its length. Every row of documents is judged for itself, whatever its id, so
repeated rows and rows that share an id or have none are each reported, as are repeated items. Empty tables give no rows; other columns are ignored.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sessionloom.llm.common import arrow_schema, hot_join, slices, stored
from sessionloom.llm.words import mix, windows

WINDOW, LEAST_WORDS = 8, 4
#: Powers of two: bits of the array at least and at most, and of the parts in which tasks make it.
LEAST_BITS, MOST_BITS, PART_BITS = 22, 30, 20
LEAST_COVERAGE, LEAST_CONSISTENCY = 0.6, 0.75
#: Windows of items with one hash that are held together.
ITEM_BLOCK = 256
# Words that are units where they follow a number.
UNITS = frozenset("% mm cm m km in ft yd mi mg g kg t lb oz ml l s sec seconds min minutes h hours days weeks months years euro euros dollar dollars cents percent degrees".split())
OUTER = "".join(c for c in map(chr, range(33, 127)) if not c.isalnum() and c not in "%$")
NUMBER = re.compile(r"[$€£]?[+-]?\d[\d.,:/]*[%a-z]{0,3}")
TITLE, IS_NUMBER, IS_UNIT, ENDS, EMPTY = 1, 2, 4, 8, 16
#: Kinds of windows: template with enough plain words, tokens as they stand, template of a whole item.
TEMPLATE, VERBATIM, WHOLE = 0, 1, 2
_SLOT_HASH = {kind: np.uint64(xxhash.xxh3_64_intdigest(f"<{kind}>")) for kind in ("number", "unit", "name")}


class Tokens:
    """What each blank-separated chunk is, remembered by chunk: the hash of its word, and flags."""

    def __init__(self, most: int = 500_000):
        self.most = most
        self.number: dict[str, int] = {}
        self.hashes, self.flags = np.empty(0, np.uint64), np.empty(0, np.uint8)

    def learn(self, new: list[str]) -> None:
        hashes, kinds = [], []
        for chunk in new:
            if chunk.isalpha() and chunk.islower():  # most of them
                hashes.append(xxhash.xxh3_64_intdigest(chunk))
                kinds.append(IS_UNIT if chunk in UNITS else 0)
                continue
            word = chunk.strip(OUTER)
            low = word.lower()
            flags = 0 if word else EMPTY
            if word[:1].isupper() and (len(word) == 1 or word[1:].islower()):
                flags |= TITLE
            if (word[:1].isdigit() or word[1:2].isdigit()) and NUMBER.fullmatch(low):
                flags |= IS_NUMBER
            if low in UNITS:
                flags |= IS_UNIT
            if chunk[-1:] in ".!?:" or chunk[-2:-1] in (".", "!", "?"):
                flags |= ENDS
            hashes.append(xxhash.xxh3_64_intdigest(low))
            kinds.append(flags)
        self.number.update(zip(new, range(len(self.number), len(self.number) + len(new)), strict=True))
        self.hashes = np.concatenate([self.hashes, np.array(hashes, np.uint64)])
        self.flags = np.concatenate([self.flags, np.array(kinds, np.uint8)])

    def of(self, chunks: list[list[str]]) -> tuple[np.ndarray, np.ndarray]:
        if len(self.number) > self.most:
            self.number, self.hashes, self.flags = {}, self.hashes[:0], self.flags[:0]
        self.learn(list(set().union(*chunks).difference(self.number)))
        ids = np.fromiter(map(self.number.__getitem__, chain.from_iterable(chunks)), np.int64, sum(map(len, chunks)))
        return self.hashes[ids], self.flags[ids]


class Templates:
    """Template tokens of many texts in flat arrays.

    ``hashes`` has placeholders for slots, ``kind`` says which tokens are slots (0 none, 1 number, 2 unit, 3 name);
    ``doc`` and ``at`` give each token's text and place in it.
    """

    def __init__(self, texts: list[str | None], tokens: Tokens):
        chunks = [(t or "").split() for t in texts]
        hashes, flags = tokens.of(chunks)
        self.all, kept = list(chain.from_iterable(chunks)), np.flatnonzero(flags & EMPTY == 0)
        hashes, flags = hashes[kept], flags[kept]
        doc = np.repeat(np.arange(len(texts)), [len(c) for c in chunks])[kept]
        first = np.ones(len(doc), bool)
        first[1:] = doc[1:] != doc[:-1]
        number, ends = flags & IS_NUMBER > 0, flags & ENDS > 0
        after_number, after_end = np.roll(number, 1) & ~first, np.roll(ends, 1) | first  # of the token before
        unit = (flags & IS_UNIT > 0) & after_number & ~number
        name = (flags & TITLE > 0) & ~after_end & ~number & ~unit
        starts = np.flatnonzero(~(name & np.roll(name, 1) & ~first))  # a name of several words is one token
        self.words = np.add.reduceat(mix(hashes), starts) if len(starts) else hashes
        self.spans, self.doc, self.title = np.append(kept[starts], len(self.all)), doc[starts], (flags & TITLE > 0)[starts]
        self.n = np.bincount(self.doc, minlength=len(texts))
        self.at = np.arange(len(self.doc)) - (np.cumsum(self.n) - self.n)[self.doc]
        self.kind, self.hashes = np.zeros(len(starts), np.uint8), self.words.copy()
        for k, (slot, where) in enumerate((("number", number), ("unit", unit), ("name", name)), 1):
            self.kind[where[starts]] = k
            self.hashes[where[starts]] = _SLOT_HASH[slot]
        self.plain = np.concatenate([[0], np.cumsum(self.kind == 0)])

    def n_plain(self, starts: np.ndarray, size: int) -> np.ndarray:
        return self.plain[starts + size] - self.plain[starts]

    def within(self, starts: np.ndarray, size: int) -> np.ndarray:
        """Those of ``starts`` whose window ends within their text."""
        return starts[self.at[starts] + size <= self.n[self.doc[starts]]]

    def windows(self, size: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Starts and hashes of the windows within one text that have enough plain words, and starts of the others."""
        found = windows(self.hashes, size)
        starts = np.flatnonzero(self.at + size <= self.n[self.doc])
        enough = self.n_plain(starts, size) >= min(LEAST_WORDS, size)
        return starts[enough], found[starts[enough]] if len(starts) else found[:0], starts[~enough]

    def hashed(self, starts: np.ndarray, size: int, kind: int, named: bool = False) -> np.ndarray:
        """Hashes of single windows; ``named`` takes their first word for a name."""
        source = self.words if kind == VERBATIM else self.hashes
        odd = mix(np.arange(1, size + 1, dtype=np.uint64)) | np.uint64(1)
        total = np.full(len(starts), 2 * kind + 1, np.uint64)
        for k in range(size):
            total += (_SLOT_HASH["name"] if named and k == 0 else source[starts + k]) * odd[k : k + 1]
        return mix(total)

    def longer(self, starts: np.ndarray, size: int, most: int) -> Iterator[tuple[np.ndarray, int]]:
        """For starts of windows with few plain words the smallest windows of a doubled size that have enough."""
        while (size := 2 * size) <= most and len(starts := self.within(starts, size)):
            enough = self.n_plain(starts, size) >= LEAST_WORDS
            yield starts[enough], size
            starts = starts[~enough]

    def slots(self, start: int, size: int) -> list[str]:
        """Slot values of a window, in order."""
        return [self.value(start + k) for k in np.flatnonzero(self.kind[start : start + size]).tolist()]

    def value(self, token: int) -> str:
        if self.kind[token] != 3:
            return self.all[self.spans[token]].strip(OUTER).lower()
        words = (w.strip(OUTER).lower() for w in self.all[self.spans[token] : self.spans[token + 1]])
        return " ".join(w for w in words if w)


def item_windows(t: Templates, size: int) -> Iterator[tuple[np.ndarray, np.ndarray, int, int, bool]]:
    """Windows of benchmark items: starts, hashes, size, kind, and whether the first word is taken for a name."""
    turns = (t.at == 0) & t.title & (t.kind == 0)  # the first words that are names within a sentence
    cover = np.zeros(len(t.doc) + 1, np.int64)
    for n in range(1, size + 1):
        starts, found, few = t.windows(n)
        if n < size:  # whole short texts
            whole = t.n[t.doc[starts]] == n
            starts, found, few = starts[whole], found[whole], few[t.n[t.doc[few]] == n]
        yield starts, found, n, TEMPLATE, False
        yield few, t.hashed(few, n, VERBATIM), n, VERBATIM, False
        made = [(starts, n)]
        if n == size:
            for some, m in t.longer(few, size, int(t.n.max(initial=0))):
                yield some, t.hashed(some, m, TEMPLATE), m, TEMPLATE, False
                made.append((some, m))
        for some, m in made:
            some = some[~turns[some]]
            np.add.at(cover, some, 1)
            np.add.at(cover, some + m, -1)
    covered = np.bincount(t.doc, np.cumsum(cover[:-1]) > 0, len(t.n))
    first = np.flatnonzero(t.at == 0)
    first = first[covered[t.doc[first]] < LEAST_COVERAGE * t.n[t.doc[first]]]
    for n in sorted(set(t.n[t.doc[first]].tolist())):
        some = first[t.n[t.doc[first]] == n]
        for named in (False, True):
            some = some[t.n_plain(some, n) > named]
            some = some[turns[some]] if named else some
            yield some, t.hashed(some, n, WHOLE, named), n, WHOLE, named
        rest = some[t.n_plain(some + 1, n - 1) >= LEAST_WORDS] + 1  # another name may stand first, as a plain word
        yield rest, t.hashed(rest, n - 1, WHOLE), n - 1, WHOLE, False


class Shapes:
    """Sizes of the windows that items have: what is to be looked for in documents."""

    def __init__(self, rows: list[tuple[int, int, int]], size: int):
        self.size = size
        self.sizes = sorted({size} | {n for n, kind, _ in rows if kind != WHOLE and n < size})
        self.verbatim = {n for n, kind, _ in rows if kind == VERBATIM}
        self.most = max((n for n, kind, _ in rows if kind == TEMPLATE), default=0)
        self.whole: dict[int, list[int]] = {}
        for n, kind, plain in sorted(rows):
            if kind == WHOLE:
                self.whole.setdefault(n, []).append(plain)

    def windows(self, t: Templates) -> Iterator[tuple[np.ndarray, np.ndarray, int, int, bool]]:
        for n in self.sizes:
            starts, found, few = t.windows(n)
            yield starts, found, n, TEMPLATE, False
            if n in self.verbatim:
                yield few, t.hashed(few, n, VERBATIM), n, VERBATIM, False
            if n == self.size:
                for some, m in t.longer(few, n, self.most):
                    yield some, t.hashed(some, m, TEMPLATE), m, TEMPLATE, False
        for n, plain in self.whole.items():
            some = t.within(np.arange(len(t.doc)), n)
            some = some[np.isin(t.n_plain(some, n), plain)]
            yield some, t.hashed(some, n, WHOLE), n, WHOLE, False


_WINDOWS = "hash long,place int,n int,size int,kind int,plain int,slots array<string>"


class HashBits:
    """A bit array in which each hash of a set has two bits."""

    def __init__(self, bits: np.ndarray, power: int):
        self.bits, self.power = bits, power

    @staticmethod
    def places(hashes: np.ndarray, power: int, second: bool) -> np.ndarray:
        return ((mix(hashes ^ np.uint64(0x51ED27)) if second else hashes) & np.uint64((1 << power) - 1)).astype(np.int64)

    def _is_set(self, places: np.ndarray) -> np.ndarray:
        return np.flatnonzero(self.bits[places >> 3] >> (places & 7).astype(np.uint8) & 1)

    def may_hold(self, hashes: np.ndarray) -> np.ndarray:
        """Indexes of the hashes that may be of the set."""
        near = self._is_set(self.places(hashes, self.power, False))
        return near[self._is_set(self.places(hashes[near], self.power, True))]


def hash_bits(hashes: DataFrame) -> HashBits:
    """The array of ``hashes`` (hash), 64 bits for each where the limits allow; tasks make its parts."""
    power = min(MOST_BITS, max(LEAST_BITS, (64 * hashes.count()).bit_length()))
    ddl = "part long,bits binary"
    split = arrow_schema("part long,place long")
    schema = arrow_schema(ddl)

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            h = batch.column(0).to_numpy().view(np.uint64)
            at = np.concatenate([HashBits.places(h, power, second) for second in (False, True)])
            yield pa.RecordBatch.from_arrays([pa.array(at >> PART_BITS), pa.array(at & (1 << PART_BITS) - 1)], schema=split)

    def mark(rows: pa.Table) -> pa.Table:
        bits = np.zeros(1 << PART_BITS, bool)
        bits[rows.column("place").to_numpy()] = True
        return pa.table({"part": rows.column("part").slice(0, 1), "bits": pa.array([np.packbits(bits, bitorder="little").tobytes()], pa.binary())}, schema=schema)

    marks = hashes.select("hash").mapInArrow(place, "part long,place long").distinct()
    whole = np.zeros(1 << power - 3, np.uint8)
    for r in marks.groupBy("part").applyInArrow(mark, ddl).toLocalIterator():  # 2 ** MOST_BITS bits at most
        at = r["part"] << PART_BITS - 3
        whole[at : at + (1 << PART_BITS - 3)] = np.frombuffer(r["bits"], np.uint8)
    return HashBits(whole, power)


def template_windows(texts: DataFrame, key: str, size: int = WINDOW, only: HashBits | None = None, shapes: Shapes | None = None) -> DataFrame:
    """(key, hash, place, n, size, kind, plain, slots) for windows of the texts.

    With ``only`` the texts are documents: windows of ``shapes`` whose hashes may be of that set, with ``row``, a number that each
    row of documents has for itself. Otherwise they are benchmark items.
    """
    schema = pa.schema([(key, pa.int64()), ("row", pa.int64()), ("hash", pa.int64()), *[(c, pa.int32()) for c in ("place", "n", "size", "kind", "plain")], ("slots", pa.list_(pa.string()))])
    shared = texts.sparkSession.sparkContext.broadcast(only)  # 2 ** MOST_BITS bits at most

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        tokens, wanted, row = Tokens(), shared.value, TaskContext.get().partitionId() << 40
        for part in slices(batches):
            t = Templates(part["text"], tokens)
            out: dict[str, list] = {n: [] for n in schema.names}
            for starts, found, n, kind, named in item_windows(t, size) if wanted is None else shapes.windows(t):
                if wanted is not None:
                    near = wanted.may_hold(found)
                    starts, found = starts[near], found[near]
                docs = t.doc[starts]
                out[key] += [part[key][k] for k in docs.tolist()]
                out["row"] += (row + docs).tolist()
                out["hash"] += found.view(np.int64).tolist()
                out["place"] += t.at[starts].tolist()
                out["n"] += t.n[docs].tolist()
                out["size"] += [n] * len(starts)
                out["kind"] += [kind] * len(starts)
                out["plain"] += (t.n_plain(starts, n) - named).tolist()
                out["slots"] += [[] if kind == VERBATIM else [t.value(k)] * named + t.slots(k, n) for k in starts.tolist()]
            row += len(part["text"])
            yield pa.RecordBatch.from_pydict(out, schema=schema)

    rows = texts.select(F.col(key).cast("long").alias(key), F.col("text").cast("string").alias("text"))
    return rows.mapInArrow(find, f"{key} long,row long,{_WINDOWS}")


def contaminated(docs: DataFrame, benchmark: DataFrame, size: int = WINDOW) -> DataFrame:
    """(doc_id, item_id, n_windows, coverage, consistency) for every document and item that it holds."""
    items = stored(template_windows(benchmark.filter("item_id is not null"), "item_id", size), "benchmark-windows")
    shapes = Shapes([tuple(r) for r in items.select("size", "kind", F.when(F.col("kind") == WHOLE, F.col("plain")).otherwise(0)).distinct().collect()], size)  # by item lengths, not by items
    window = F.struct("item_id", F.col("place").alias("item_place"), F.col("n").alias("item_n"), F.col("size").alias("length"), F.col("slots").alias("item_slots"))
    sizes = stored(items.groupBy("hash").agg(F.count("*").alias("c")).withColumn("blocks", F.ceil(F.col("c") / ITEM_BLOCK)), "benchmark-hashes")
    dealt = hot_join(items, sizes, ["hash"], "c", ["item_id", "place"]).withColumn("block", F.pmod(F.xxhash64("item_id", "place"), "blocks"))
    by_block = dealt.groupBy("hash", "block").agg(F.collect_list(window).alias("windows"))  # about ITEM_BLOCK windows
    hits = stored(template_windows(docs, "doc_id", size, hash_bits(items.select("hash").distinct()), shapes).select("doc_id", "row", "hash", "place", "slots"), "template-hits")
    counted = stored(hits.groupBy("hash").agg(F.count("*").alias("c")).join(sizes.select("hash", "blocks"), "hash"), "template-counts")
    asked = hot_join(hits, counted, ["hash"], "c", ["row", "place"]).filter("blocks is not null").withColumn("block", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)))
    answers = stored(by_block.join(counted, "hash").select("hash", "block", "windows", "c"), "template-items")
    met = hot_join(asked.drop("blocks"), answers, ["hash", "block"], "c", ["row", "place"]).select("doc_id", "row", "place", "slots", F.explode("windows").alias("w")).select("doc_id", "row", "place", "slots", "w.*")
    met = met.filter(F.size("slots") == F.size("item_slots")).withColumn("shift", F.col("place") - F.col("item_place"))
    pairs = met.select("row", "item_id", "shift", F.explode(F.arrays_zip("item_slots", "slots")).alias("s")).groupBy("row", "item_id", "shift", "s.item_slots", "s.slots").agg(F.count("*").alias("n"))
    by_value = pairs.groupBy("row", "item_id", "shift", "item_slots").agg(F.max("n").alias("best"), F.sum("n").alias("n"))
    agreed = by_value.groupBy("row", "item_id", "shift").agg((F.sum("best") / F.sum("n")).alias("consistency"))
    sound = met.join(agreed, ["row", "item_id", "shift"], "left").withColumn("consistency", F.coalesce("consistency", F.lit(1.0)))
    sound = sound.filter(F.col("consistency") >= LEAST_CONSISTENCY)
    found = sound.groupBy("row", "item_id").agg(F.first("doc_id").alias("doc_id"), F.count("*").alias("n_windows"), F.collect_set(F.struct("item_place", "length")).alias("at"), F.first("item_n").alias("item_n"), F.min("consistency").alias("consistency"))
    covered = F.size(F.array_distinct(F.flatten(F.transform("at", lambda w: F.sequence(w["item_place"], w["item_place"] + w["length"] - 1)))))
    return found.select("doc_id", "item_id", "n_windows", (covered / F.col("item_n")).alias("coverage"), "consistency").filter(F.col("coverage") >= LEAST_COVERAGE)


def op3_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents that hold items of ``benchmark``, verbatim or with other numbers, names and units."""
    return contaminated(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


QUERIES = {"op3_decontaminate": op3_decontaminate}
