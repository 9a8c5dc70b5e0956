"""N-gram Jaccard self-join by T-occurrence search (DivideSkip), and its connected groups.

Documents link when their sets of 5-word shingles have a Jaccard similarity of at least ``percent`` / 100.

1. ``frequencies``: how many documents hold each shingle. Documents stand in a written table of chunks, which send
   distinct shingles to hash buckets and get a byte for each back.
2. ``prefix_postings``: each document's set size and a 128-bit digest of its set, equal sets being one class from here
   on; and of each set the rarest shingles, as many as any linked set must meet one of (size minus required overlap
   plus one), without those of one document only. A class is named by the place of one of its documents in the table
   of chunks, so it needs no doc_id. ``short_lists`` and ``long_lists``: a shingle's list gives all pairs that size
   and place allow while it is short, and pairs with its likeliest origin where it is long. Lists of more than 200
   documents are rows of a Spark table and never stand in one task.
3. ``search``: for each class and a block of its candidates, a T-occurrence search: short inverted lists are merged on
   a heap, long ones probed by binary search, and documents reaching the required overlap are kept.
4. Links are closed to components by alternating large-star and small-star rounds. In long lists that then still hold
   several components, members outside of the main one are searched against those members, block by block, whose
   sizes can link with theirs. Pairs within a component need no check, so no link between components is lost, and
   groups of near copies are never expanded into all pairs.

Joins on shingles, classes, hubs and labels go through ``hot_join``, so no frequent one lands in a single task.

Nulls: a null text has no shingles and links with nothing, as does a document without words; one of fewer than five
words has its whole sequence as its only shingle. A document with a null doc_id links like any other, but its id is
never the name of a component; a component of such documents alone has none. Repeated
rows are equal sets. An empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import math
from bisect import bisect_left
from collections import defaultdict
from collections.abc import Iterator
from heapq import merge

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sessionloom.llm.common import arrow_schema, hot_join, partitions, slices, stored
from sessionloom.llm.substring_dedup import BUCKETS_A_TASK, NULL_ID, PLACE_BITS, Chunk, bucket_count, by_bucket, chunks
from sessionloom.llm.words import Flat, WordHashes, mix, split_words, windows

SHINGLE, PERCENT = 5, 75
SHORT_LIST = 64
BLOCK, LIST_BLOCK = 64, 512
#: Frequencies up to this are exact in a byte; the lists of more frequent shingles are rows of a table.
EXACT = 200


def least_overlap(a: int, b: int, percent: int = PERCENT) -> int:
    """The smallest intersection of sets of ``a`` and ``b`` that links them: 100 i >= percent (a + b - i)."""
    return -(-percent * (a + b) // (100 + percent))


def shingle_sets(texts: list[str | None], hashes: WordHashes, size: int = SHINGLE) -> tuple[np.ndarray, np.ndarray]:
    """Distinct shingle hashes of all texts, ascending within each text, and how many each text has."""
    flat = Flat([split_words(t, lower=True) for t in texts], hashes)
    places = flat.window_places(size)
    found, doc = windows(flat.hashes, size)[places] if len(places) else np.empty(0, np.uint64), flat.doc[places]
    few = np.flatnonzero((flat.n > 0) & (flat.n < size))
    whole = [mix(np.array([sum(int(h) * (2 * k + 3) for k, h in enumerate(flat.hashes[flat.start[d] : flat.start[d] + flat.n[d]])) + int(flat.n[d]) & (1 << 64) - 1], np.uint64))[0] for d in few]
    found, doc = np.concatenate([found, np.array(whole, np.uint64)]), np.concatenate([doc, few])
    order = np.lexsort((found, doc))
    found, doc = found[order], doc[order]
    new = np.ones(len(doc), bool)
    new[1:] = (found[1:] != found[:-1]) | (doc[1:] != doc[:-1])
    return found[new], np.bincount(doc[new], minlength=len(texts))


def set_digests(found: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Two 64-bit sums over each set."""
    ends = np.concatenate([[0], np.cumsum(sizes)])
    sums = []
    for h in (mix(found ^ np.uint64(0xA5A5A5A5)), mix(mix(found + np.uint64(77)))):
        total = np.concatenate([np.zeros(1, np.uint64), np.cumsum(h, dtype=np.uint64)])
        sums.append(total[ends[1:]] - total[ends[:-1]])
    return sums[0], sums[1]


def frequency_class(df: np.ndarray) -> np.ndarray:
    """Document frequencies as one byte that never falls: exact to ``EXACT``, by quarters of a power of two beyond, where it is larger."""
    return np.where(df <= EXACT, df, np.minimum(255, EXACT + 1 + 4 * np.log2(np.maximum(df, EXACT) / EXACT)).astype(np.int64)).astype(np.uint8)


class ChunkSets:
    """Shingle sets of a chunk's documents; equal sets within it count once."""

    def __init__(self, payload: bytes, hashes: WordHashes, size: int):
        self.chunk = Chunk.unpack(payload)
        self.found, self.sizes = shingle_sets(self.chunk.texts, hashes, size)
        self.d1, self.d2 = set_digests(self.found, self.sizes)
        order = np.lexsort((self.d2, self.d1))
        first = np.zeros(len(order), bool)
        if len(order):
            first[order] = np.concatenate([[True], (self.d1[order][1:] != self.d1[order][:-1]) | (self.d2[order][1:] != self.d2[order][:-1])])
        doc = np.repeat(np.arange(len(self.sizes)), self.sizes)
        keep = first[doc]
        self.own, self.doc = self.found[keep], doc[keep]
        self.kept = np.where(first, self.sizes, 0)
        #: The upper 40 bits stand for a shingle where only its frequency matters.
        self.keys, self.back, self.counts = np.unique(self.own >> np.uint64(24), return_inverse=True, return_counts=True)


def frequencies(table: DataFrame, size: int, buckets: int) -> DataFrame:
    """(chunk, answers): for each chunk, by bucket, the frequency class of each of its distinct shingles, in order.

    Chunks send distinct shingles as sorted differences, with counts; a bucket adds the counts up and answers with
    a byte for each. A shingle enters a bucket once per chunk, however many documents hold it.
    """
    ddl = "bucket int,chunk long,first long,gaps binary,counts binary"
    sent, answered = arrow_schema(ddl), arrow_schema("chunk long,bucket int,classes binary")

    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes = WordHashes()
        for part in slices(batches, 1):
            sets = ChunkSets(part["payload"][0], hashes, size)
            runs = list(by_bucket(sets.keys << np.uint64(24), buckets))
            gaps = [np.diff(sets.keys[r]) for _, r in runs]
            gaps = [g.astype("<u4" if not len(g) or g.max() < 1 << 32 else "<u8").tobytes() for g in gaps]
            yield pa.RecordBatch.from_pydict({"bucket": [b for b, _ in runs], "chunk": part["chunk"] * len(runs), "first": [int(sets.keys[r.start]) for _, r in runs], "gaps": gaps, "counts": [sets.counts[r].astype("<u4").tobytes() for _, r in runs]}, schema=sent)

    def meet(rows: pa.Table) -> pa.Table:
        keys, counts = [], []
        for first, gaps, n in zip(rows.column("first").to_pylist(), rows.column("gaps"), rows.column("counts"), strict=True):
            counts.append(np.frombuffer(n.as_py(), "<u4").astype(np.int64))
            raw = gaps.as_py()
            wide = len(counts[-1]) > 1 and len(raw) == 8 * (len(counts[-1]) - 1)
            keys.append(np.cumsum(np.concatenate([[first], np.frombuffer(raw, "<u8" if wide else "<u4").astype(np.int64)])))
        _, back = np.unique(np.concatenate(keys), return_inverse=True)
        classes = frequency_class(np.bincount(back, np.concatenate(counts)).astype(np.int64))[back]
        ends = np.cumsum([len(k) for k in keys]).tolist()
        return pa.table({"chunk": rows.column("chunk"), "bucket": rows.column("bucket"), "classes": pa.array([classes[e - len(k) : e].tobytes() for e, k in zip(ends, keys, strict=True)], pa.binary())}).cast(answered)

    answers = table.mapInArrow(send, ddl).repartition(buckets // BUCKETS_A_TASK, "bucket").groupBy("bucket").applyInArrow(meet, "chunk long,bucket int,classes binary")
    return answers.groupBy("chunk").agg(F.sort_array(F.collect_list(F.struct("bucket", "classes"))).alias("answers"))


_POSTINGS = "node long,doc_id long,n long,d1 long,d2 long,bucket int,hashes binary,classes binary,sizes binary,places binary,hash long,place long"


def prefix_postings(table: DataFrame, size: int, percent: int, buckets: int) -> DataFrame:
    """Written rows of three kinds: of every document its ``node``, doc_id, n, d1 and d2; postings of the rarest shingles of each set by bucket; and single postings (hash, d1, n, place) of frequent ones.

    Shingles of one document only are in no list.
    """
    schema = arrow_schema(_POSTINGS)

    def rows(count: int, columns: dict) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(columns[f.name], f.type) if f.name in columns else pa.nulls(count, f.type) for f in schema], schema=schema)

    def post(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes = WordHashes()
        for part in slices(batches, 1):
            sets = ChunkSets(part["payload"][0], hashes, size)
            rarity = np.frombuffer(b"".join(x["classes"] for x in part["answers"][0] or []), np.uint8)[sets.back]
            order = np.lexsort((sets.own, rarity, sets.doc))
            found, doc, rarity = sets.own[order], sets.doc[order], rarity[order]
            place = np.arange(len(found)) - (np.cumsum(sets.kept) - sets.kept)[doc]
            prefix = sets.sizes - -(-percent * sets.sizes // 100) + 1
            use = (place < prefix[doc]) & (rarity > 1)
            found, doc, place, often = found[use], doc[use], place[use], rarity[use] > EXACT
            ids = [None if x == NULL_ID else x for x in sets.chunk.doc_ids.tolist()]
            nodes = (part["chunk"][0] << PLACE_BITS) + np.arange(len(ids))
            yield rows(len(ids), {"node": nodes, "doc_id": ids, "n": sets.sizes, "d1": sets.d1.view(np.int64), "d2": sets.d2.view(np.int64)})
            few, many = doc[~often], doc[often]
            for at in range(0, len(many), 100_000):
                some = slice(at, at + 100_000)
                yield rows(len(many[some]), {"hash": found[often][some].view(np.int64), "d1": sets.d1[many[some]].view(np.int64), "n": sets.sizes[many[some]], "place": place[often][some]})
            order = np.argsort(found[~often], kind="stable")
            few, h, place = few[order], found[~often][order], place[~often][order]
            runs = list(by_bucket(h, buckets))
            columns = (("hashes", h, "<u8"), ("classes", sets.d1[few], "<u8"), ("sizes", sets.sizes[few], "<u4"), ("places", place, "<u4"))
            yield rows(len(runs), {"bucket": [b for b, _ in runs]} | {c: [a[r].astype(k).tobytes() for _, r in runs] for c, a, k in columns})

    return stored(table.join(frequencies(table, size, buckets), "chunk", "left").mapInArrow(post, _POSTINGS), "postings")


def short_lists(postings: DataFrame, buckets: int, percent: int = PERCENT, short: int = SHORT_LIST) -> DataFrame:
    """Written rows of lists of at most about ``EXACT`` members: pairs (a, b) of class digests to verify, or members (hash, d1, n, place) of those over ``short``."""
    ddl = "a long,b long,hash long,d1 long,n long,place long"
    out = arrow_schema(ddl)

    def meet(rows: pa.Table) -> pa.Table:
        column = lambda n, k: np.concatenate([np.frombuffer(x.as_py(), k) for x in rows.column(n)])
        h, cls, n, place = column("hashes", "<u8"), column("classes", "<u8").view(np.int64), column("sizes", "<u4").astype(np.int64), column("places", "<u4").astype(np.int64)
        order = np.lexsort((cls, h))
        h, cls, n, place = h[order], cls[order], n[order], place[order]
        new = np.ones(len(h), bool)
        new[1:] = (h[1:] != h[:-1]) | (cls[1:] != cls[:-1])
        h, cls, n, place = h[new], cls[new], n[new], place[new]
        starts = np.flatnonzero(np.concatenate([[True], h[1:] != h[:-1]])) if len(h) else np.empty(0, int)
        sizes = np.diff(np.append(starts, len(h)))
        pairs = np.empty((0, 2), np.int64)
        for length in np.unique(sizes[(sizes > 1) & (sizes <= short)]).tolist():
            own, (i, j) = starts[sizes == length], np.triu_indices(length, 1)
            step = max(1, 2_000_000 // len(i))
            for at in range(0, len(own), step):
                x, y = ((own[at : at + step, None] + k).ravel() for k in (i, j))
                able = 1 + np.minimum(n[x] - place[x] - 1, n[y] - place[y] - 1) >= -(-percent * (n[x] + n[y]) // (100 + percent))
                some = np.column_stack([cls[x[able]], cls[y[able]]])  # classes ascend within a list
                pairs = np.unique(np.concatenate([pairs, some]), axis=0)
        long = np.repeat(sizes > short, sizes)
        none, pad = pa.nulls(len(pairs), pa.int64()), pa.nulls(int(long.sum()), pa.int64())
        columns = [pa.chunked_array([pairs[:, k], pad]) for k in (0, 1)] + [pa.chunked_array([none, pa.array(c[long])]) for c in (h.view(np.int64), cls, n, place)]
        return pa.table(columns, schema=out)

    return stored(postings.repartition(buckets // BUCKETS_A_TASK, "bucket").groupBy("bucket").applyInArrow(meet, ddl), "lists")


def long_lists(lists: DataFrame, percent: int = PERCENT) -> DataFrame:
    """Pairs (a, b) of members (hash, node, n, place) of long lists with ``a``, the member of least place in each: it has the fewest rarer shingles, so it is the likeliest origin."""
    origin = lists.groupBy("hash").agg(F.min_by(F.struct("node", "n", "place"), F.struct("place", "node")).alias("o"), F.count("*").alias("c"))
    origin = stored(origin.select("hash", F.col("o.node").alias("a"), F.col("o.n").alias("o_n"), F.col("o.place").alias("o_place"), "c"), "origins")
    met = hot_join(lists, origin, ["hash"], "c", ["node"])
    able = F.least(F.col("n") - F.col("place"), F.col("o_n") - F.col("o_place")) * (100 + percent) >= percent * (F.col("n") + F.col("o_n"))
    return met.filter((F.col("a") != F.col("node")) & able).select("a", F.col("node").alias("b"))


def divide_skip(query: list[int], lists: dict[int, list[int]], sizes: list[int], percent: int = PERCENT) -> list[int]:
    """Members of the inverted ``lists`` whose overlap with ``query`` reaches what their size requires.

    With L of the longest lists set aside, a member that reaches T overlaps at least T - L of the short ones.
    """
    least = min((least_overlap(len(query), n, percent) for n in sizes), default=1)
    own = sorted((lists[h] for h in query if h in lists), key=len)
    longest = max((len(x) for x in own), default=0)
    n_long = min(len(own), max(0, least - 1), int(least / (0.01 * math.log2(max(2, longest)) + 1)))
    short, long = own[: len(own) - n_long], own[len(own) - n_long :]
    found: list[int] = []

    def close(member: int, count: int) -> None:
        need = least_overlap(len(query), sizes[member], percent)
        if count < need - n_long:
            return
        for k, probed in enumerate(long):
            if count + n_long - k < need:
                return
            at = bisect_left(probed, member)
            count += at < len(probed) and probed[at] == member
        if count >= need:
            found.append(member)

    member, count = -1, 0
    for x in merge(*short):
        if x != member:
            if count:
                close(member, count)
            member, count = x, 0
        count += 1
    if count:
        close(member, count)
    return found


def texts_of(nodes: DataFrame, table: DataFrame) -> DataFrame:
    """(node, salt, text) of ``nodes`` (node, copies), ``copies`` rows each, out of the table of chunks."""
    schema = arrow_schema("node long,salt long,text string")
    held = nodes.groupBy(F.shiftright("node", PLACE_BITS).alias("chunk")).agg(F.collect_list(F.struct(F.col("node"), F.col("copies"))).alias("wanted"))

    def pick(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches, 1):
            texts = Chunk.unpack(part["payload"][0]).texts
            wanted = sorted((w["node"], salt) for w in part["wanted"][0] for salt in range(w["copies"]))
            for at in range(0, len(wanted), 1024):
                some = wanted[at : at + 1024]
                yield pa.RecordBatch.from_pydict({"node": [n for n, _ in some], "salt": [k for _, k in some], "text": [texts[n & (1 << PLACE_BITS) - 1] for n, _ in some]}, schema=schema)

    return table.join(held, "chunk").mapInArrow(pick, "node long,salt long,text string")


def search(groups: DataFrame, table: DataFrame, size: int = SHINGLE, percent: int = PERCENT) -> DataFrame:
    """Written pairs (a, b), a < b, of nodes that link, out of groups (g, part, node, query, label).

    In each (g, part) every query is searched in the inverted lists of the other nodes; those of its own label
    are known to be connected and left out. A node of over a thousandth of all rows has its text copied, so that its
    rows are dealt to several tasks; fewer than a thousand nodes are so frequent, and their numbers are broadcast.
    """
    ddl = "a long,b long"
    schema = arrow_schema(ddl)

    def run(rows: pa.Table) -> pa.Table:
        hashes, own_rows = WordHashes(), defaultdict(list)
        g, part, nodes, is_query, labels = (rows.column(c).to_pylist() for c in ("g", "part", "node", "query", "label"))
        for k, key in enumerate(zip(g, part, strict=True)):
            own_rows[key].append(k)
        texts, found = rows.column("text"), set()
        for own in own_rows.values():
            hashed, sizes = shingle_sets([texts[k].as_py() for k in own], hashes, size)
            ends = np.cumsum(sizes).tolist()
            sets = [hashed[e - n : e].tolist() for e, n in zip(ends, sizes.tolist(), strict=True)]
            queries = [(k, s) for k, s in zip(own, sets, strict=True) if is_query[k]]
            members = [(k, s) for k, s in zip(own, sets, strict=True) if not is_query[k]]
            wanted = set().union(*(s for _, s in queries))
            lists: dict[int, list[int]] = defaultdict(list)
            for m, (_, s) in enumerate(members):
                for h in s:
                    if h in wanted:
                        lists[h].append(m)
            for k, s in queries:
                for m in divide_skip(s, lists, [len(x) for _, x in members], percent):
                    other = members[m][0]
                    if nodes[other] != nodes[k] and (labels[k] is None or labels[k] != labels[other]):
                        found.add((min(nodes[k], nodes[other]), max(nodes[k], nodes[other])))
        return pa.table({"a": [x for x, _ in found], "b": [y for _, y in found]}, schema=schema)

    groups = stored(groups, "groups")
    total = groups.count()
    if not total:
        return groups.select(F.col("node").alias("a"), F.col("node").alias("b"))
    copies = F.when(F.col("c") * 1000 > total, F.ceil(F.col("c") * 1000 / total)).otherwise(1).cast("long")
    needed = groups.groupBy("node").agg(F.count("*").alias("c")).select("node", copies.alias("copies"))
    hot = needed.filter("copies > 1")
    dealt = groups.join(F.broadcast(hot), "node", "left").withColumn("salt", F.coalesce(F.pmod(F.xxhash64("g", "part"), "copies"), F.lit(0).cast("long"))).drop("copies")
    with_text = dealt.join(texts_of(needed, table), ["node", "salt"]).drop("salt")
    keys = max(8 * partitions(table.sparkSession), total // 512)
    keyed = with_text.withColumn("key", F.pmod(F.xxhash64("g", "part"), F.lit(keys)))
    return stored(keyed.groupBy("key").applyInArrow(lambda t: run(t.drop_columns(["key"])), ddl), "links")


def pair_groups(pairs: DataFrame, block: int = BLOCK) -> DataFrame:
    """Groups to search for candidate pairs (a, b), a written table: each ``a`` against blocks of about ``block`` of its candidates."""
    blocks = pairs.groupBy("a").agg(F.count("*").alias("c"), F.ceil(F.count("*") / block).alias("blocks"))
    cut = hot_join(pairs, blocks, ["a"], "c", ["b"], pairs.count()).select(F.col("a").alias("g"), F.pmod(F.xxhash64("b"), F.col("blocks")).alias("part"), "b")
    no_label = F.lit(None).cast("long").alias("label")
    queries = cut.select("g", "part", F.col("g").alias("node"), F.lit(True).alias("query"), no_label).distinct()
    return cut.select("g", "part", F.col("b").alias("node"), F.lit(False).alias("query"), no_label).unionByName(queries)


def list_groups(lists: DataFrame, percent: int = PERCENT, block: int = LIST_BLOCK) -> DataFrame:
    """Groups to search for long lists (hash, node, n, place, label), a written table, that hold several components.

    A member of size n that meets others at its place can link with sizes from ``low`` to ``high`` only. Members
    stand in bands of sizes, those of the list's largest component apart, and bands are dealt into blocks. A group is a
    pair of blocks: members outside of that component, as queries, and others whose sizes can link with theirs; two blocks of such
    members meet once. So a group never has more than about two blocks, and a list's rows are its members times
    the blocks that sizes and places admit, one for each ``block`` members.
    """
    band_of = lambda n: F.floor(F.log(n.cast("double")) * 16).cast("long")
    by_label = lists.groupBy("hash", "label").agg(F.count("*").alias("c"))
    mixed = by_label.groupBy("hash").agg(F.max_by("label", F.struct("c", "label")).alias("main"), F.count("*").alias("labels"), F.sum("c").alias("c")).filter("labels > 1").drop("labels")
    own = hot_join(lists, stored(mixed, "mixed-lists"), ["hash"], "c", ["node"]).filter("main is not null")
    low, high = F.ceil(F.col("n") * percent / 100), F.floor((F.col("n") - F.col("place")) * (100 + percent) / percent) - F.col("n")
    able = own.withColumn("low", low).withColumn("high", F.least(high, F.floor(F.col("n") * 100 / percent))).filter("low <= high").withColumn("band", band_of(F.col("n"))).withColumn("other", F.col("label") != F.col("main"))
    able = stored(able, "mixed-members")
    cell = ["hash", "band", "other"]
    cells = stored(able.groupBy(*cell).agg(F.count("*").alias("c"), F.ceil(F.count("*") / block).alias("blocks")), "cells")
    placed = hot_join(able, cells, cell, "c", ["node"]).withColumn("salt", F.pmod(F.xxhash64("node"), "blocks"))
    placed = stored(placed.select(*cell, "salt", "node", "n", "low", "high", "label"), "mixed-blocks")
    blocks = stored(placed.groupBy(*cell, "salt").agg(F.min("n").alias("least_n"), F.max("n").alias("most_n"), F.min("low").alias("least_low"), F.max("high").alias("most_high")), "blocks")
    asking = blocks.filter("other").select("hash", *[F.col(c).alias(f"q_{c}") for c in blocks.columns if c not in ("hash", "other")])
    meet = "least_n <= q_most_high and most_n >= q_least_low and q_least_n <= most_high and q_most_n >= least_low and (not other or struct(band, salt) <= struct(q_band, q_salt))"
    pairs = stored(asking.join(blocks, "hash").filter(meet).withColumn("part", F.xxhash64("q_band", "q_salt", "band", "other", "salt")), "block-pairs")
    queries = placed.filter("other").select("hash", F.col("band").alias("q_band"), F.col("salt").alias("q_salt"), "node", "n", "low", "high", "label")
    queries = queries.join(pairs.select("hash", "q_band", "q_salt", "part", "least_n", "most_n", "least_low", "most_high"), ["hash", "q_band", "q_salt"]).filter("least_n <= high and most_n >= low and n between least_low and most_high")
    members = placed.join(pairs.select(*cell, "salt", "part"), [*cell, "salt"])
    row = lambda df, query: df.select(F.col("hash").alias("g"), "part", "node", F.lit(query).alias("query"), "label")
    return row(members, False).unionByName(row(queries, True))


def components(links: DataFrame) -> DataFrame:
    """(node, label): for every end of a link the smallest node of its component.

    Large-star and small-star rounds until the edges no longer change; each round is a written table. A hub's edges
    are dealt to several tasks.
    """
    edges = stored(links.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).filter("u <> v").distinct(), "edges")
    state = lambda: tuple(edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())
    before, now = None, state()
    while now != before:
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"), F.count("*").alias("c"))
        large = hot_join(both.filter("v > u"), least, ["u"], "c", ["v"], 2 * now[0]).select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m"), F.count("*").alias("c"))
        small = hot_join(large, least, ["u"], "c", ["v"], now[0]).filter("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(least.select("u", F.col("m").alias("v")))
        edges = stored(small.filter("u <> v").distinct(), "edges")
        before, now = now, state()
    roots = edges.select(F.col("v").alias("node"), F.col("v").alias("label")).distinct()
    return edges.select(F.col("u").alias("node"), F.col("v").alias("label")).unionByName(roots)


def near_groups(docs: DataFrame, size: int = SHINGLE, percent: int = PERCENT) -> DataFrame:
    """doc_id, n_shingles, component_id: the smallest doc_id that links lead to."""
    table = chunks(docs)
    buckets = bucket_count(table)
    postings = prefix_postings(table, size, percent, buckets)
    signed = postings.filter("node is not null").select("node", "doc_id", "n", "d1", "d2")
    classes = stored(signed.filter("n > 0").groupBy("d1", "d2").agg(F.min("node").alias("node"), F.min("doc_id").alias("rep"), F.count("*").alias("c")), "classes")
    named = classes.select("d1", "node")

    found = short_lists(postings.filter("bucket is not null").select("bucket", "hashes", "classes", "sizes", "places"), buckets, percent)
    ends = lambda c, to: named.select(F.col("d1").alias(c), F.col("node").alias(to))
    short = found.filter("hash is null").select("a", "b").distinct().join(ends("a", "x"), "a").join(ends("b", "y"), "b").select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b"))
    often = postings.filter("hash is not null").select("hash", "d1", "n", "place").unionByName(found.filter("hash is not null").select("hash", "d1", "n", "place"))
    lists = stored(often.join(named, "d1").select("hash", "node", "n", "place").distinct(), "long-lists")
    links = search(pair_groups(stored(short.unionByName(long_lists(lists, percent)).distinct(), "pairs")), table, size, percent)
    labels = components(links)
    labelled = lists.join(labels, "node", "left").select("hash", "node", "n", "place", F.coalesce("label", "node").alias("label"))
    across = search(list_groups(stored(labelled, "labelled-lists"), percent), table, size, percent)
    if not across.isEmpty():
        labels = components(links.unionByName(across))
    members = classes.join(labels, "node", "left")
    names = members.filter("label is not null").groupBy("label").agg(F.min("rep").alias("name"), F.count("*").alias("k"))
    reps = hot_join(members, names, ["label"], "k", ["node"], classes.count()).select("d1", "d2", F.when(F.col("label").isNull(), F.col("rep")).otherwise(F.col("name")).alias("component"), "c")
    out = hot_join(signed, reps, ["d1", "d2"], "c", ["node"], signed.count())
    return out.select("doc_id", F.col("n").alias("n_shingles"), F.when(F.col("n") > 0, F.col("component")).otherwise(F.col("doc_id")).alias("component_id"))


def op9_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Near-duplicate groups of all ``documents`` at a Jaccard similarity of 0.75 on word 5-grams."""
    return near_groups(spark.read.parquet(f"{sf_dir}/documents.parquet"))


_ORACLE = r"""
WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
s AS (SELECT DISTINCT doc_id, unnest(CASE WHEN len(w) >= 5 THEN list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' ')) WHEN len(w) > 0 THEN [array_to_string(w, ' ')] ELSE [] END) AS g FROM w),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY 1),
p AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS i FROM s a JOIN s b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY 1, 2),
l AS (SELECT a, b FROM p JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * i >= 75 * (x.n + y.n - i)),
e AS (SELECT a, b FROM l UNION SELECT b, a FROM l),
r AS (SELECT doc_id, doc_id AS to_id FROM documents UNION SELECT r.doc_id, e.b FROM r JOIN e ON r.to_id = e.a)
SELECT r.doc_id, coalesce(any_value(n.n), 0) AS n_shingles, min(r.to_id) AS component_id FROM r LEFT JOIN n ON n.doc_id = r.doc_id GROUP BY r.doc_id
"""
QUERIES = {"op9_ngram_join": op9_ngram_join}
ORACLES = {"op9_ngram_join": _ORACLE}
