"""Toxicity by subword-bag embeddings averaged into a linear softmax.

A word is the bag of its character n-grams and itself, hashed into ``BUCKETS`` rows of an embedding table; a span
of ``SPAN`` distinct words of a document, in order of first use, is the average of its rows, and a linear softmax
over it gives the probability. Embeddings and softmax are trained jointly in numpy, so an unseen misspelling shares most of its vectors with the word it bends.
A document scores as its worst span, so a long text does not dilute an insult; training alternates between
choosing the spans that speak for a document's label and gradient steps on them.

Words stand between blanks. A chunk of more than ``LONG`` characters, as in texts without blanks, is read as overlapping
words of ``PART`` characters each, so that all of its n-grams count and a span stays short.

The fit sees at most ``per_class`` labelled documents of each class, those with the smallest hash of doc_id; the
model has a fixed size. Scoring reads every whole text.

Nulls: a null text, or one without a word, scores 0. Labels that are null, repeated or
have no document are ignored, and without labels of both classes every score is 0. Repeated documents are scored
each; an empty table gives no rows; other columns pass through ``score_texts``.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sessionloom.llm.common import with_column
from sessionloom.llm.words import mix, windows

BUCKETS, WIDTH, SPAN = 1 << 17, 4, 2
GRAMS = (3, 4, 5)
#: An average is taken over this many rows at least, so that a lone word isn't a whole span.
LEAST = 30
PER_CLASS = 1500
LONG, PART, STEP = 64, 16, 8
EDGE = "".join(c for c in map(chr, range(33, 127)) if not c.isalnum())


def distinct_words(text: str) -> list[str]:
    """Distinct words in order of first use: blank-separated chunks, long ones cut."""
    words = list(dict.fromkeys(text.split()))
    if len(text) <= LONG or max(map(len, words), default=0) <= LONG:
        return words
    return list(dict.fromkeys(w for c in words for w in ([c] if len(c.strip(EDGE)) <= LONG else (c[at : at + PART] for at in range(0, len(c) - PART + STEP, STEP)))))


def subwords(chunks: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Buckets of words (``distinct_words``) one after the other, and how many each has.

    They are those of the word without outer punctuation and of its character n-grams, ends being marked.
    """
    words = [f"<{c.strip(EDGE).lower()}>" for c in chunks]
    lengths = np.array([len(w) for w in words], np.int64)
    points = np.frombuffer("".join(words).encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64)
    word = np.repeat(np.arange(len(words)), lengths)
    place = np.arange(len(points)) - (np.cumsum(lengths) - lengths)[word]
    spread = mix(points + np.uint64(1))
    whole = np.zeros(len(words), np.uint64)
    if len(words):
        whole = mix(np.add.reduceat(mix(spread + place.astype(np.uint64) * np.uint64(0x100000001B3)), np.cumsum(lengths) - lengths))
    owners, found = [np.flatnonzero(lengths > 2)], [whole[lengths > 2]]
    for n in GRAMS:
        h = windows(spread, n)
        at = np.flatnonzero((place + n <= lengths[word]) & (lengths[word] > 2))
        owners.append(word[at])
        found.append(h[at] + np.uint64(n))
    owner, rows = np.concatenate(owners), np.concatenate(found)
    order = np.argsort(owner, kind="stable")
    return (rows[order] >> np.uint64(20)).astype(np.int64) % BUCKETS, np.bincount(owner, minlength=len(words))


class Bags:
    """Texts as spans of words, words as bags of buckets, all in flat arrays."""

    def __init__(self, texts: list[str]):
        words: dict[str, int] = {}
        ids = [[words.setdefault(c, len(words)) for c in distinct_words(t)] for t in texts]
        parts = [subwords(p) for p in (list(words)[at : at + 50_000] for at in range(0, len(words), 50_000))]
        self.rows = np.concatenate([np.empty(0, np.int32), *(p[0].astype(np.int32) for p in parts)])
        self.sizes = np.concatenate([np.empty(0, np.int64), *(p[1] for p in parts)])
        self.row_start = np.concatenate([[0], np.cumsum(self.sizes)])
        held = [np.unique(np.concatenate([np.empty(0, np.int64), *(self.rows[self.row_start[w] : self.row_start[w + 1]] for w in x)])) for x in ids]
        self.held = held
        self.spans = [np.array(x[at : at + SPAN], np.int64) for x in ids for at in range(0, max(1, len(x)), SPAN)]
        self.doc = np.repeat(np.arange(len(texts)), [max(1, -(-len(x) // SPAN)) for x in ids])

    def sums(self, values: np.ndarray) -> np.ndarray:
        """For every word the sum of its buckets' values."""
        total = np.zeros(len(self.sizes), np.float32)
        some = self.sizes > 0
        if some.any():
            total[some] = np.add.reduceat(values.astype(np.float32)[self.rows], self.row_start[:-1][some])
        return total

    def docs_with_label(self, chosen: np.ndarray) -> np.ndarray:
        """For every bucket the number of chosen documents that hold it."""
        return np.bincount(np.concatenate([np.empty(0, np.int64), *(h for h, c in zip(self.held, chosen, strict=True) if c)]), minlength=BUCKETS)

    def flat(self, chosen: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Bucket rows of the chosen spans one after the other, and how many each has."""
        words = np.concatenate([self.spans[i] for i in chosen])
        sizes = self.sizes[words]
        skipped = np.repeat(self.row_start[words] - (np.cumsum(sizes) - sizes), sizes)
        owner = np.repeat(np.arange(len(chosen)), [len(self.spans[i]) for i in chosen])
        return self.rows[skipped + np.arange(len(skipped))], np.bincount(owner, sizes, len(chosen)).astype(int)


class Model:
    """What one bucket adds to the log odds (averaging and softmax are linear in it), and the bias."""

    def __init__(self, odds: np.ndarray, bias: float):
        self.odds, self.bias = odds, bias

    @classmethod
    def of(cls, embeddings: np.ndarray, weights: np.ndarray, bias: np.ndarray) -> Model:
        return cls((embeddings @ (weights[:, 1] - weights[:, 0])).astype(np.float32), float(bias[1] - bias[0]))


def fit(texts: list[str], labels: list[int], rounds: int = 5, steps: int = 2, least_steps: int = 100, rate: float = 0.5, least_docs: int = 3, batch: int = 256, seed: int = 7) -> Model | None:
    """Embeddings, weights and bias together by AdaGrad on softmax cross-entropy; None without both classes.

    Buckets that fewer than ``least_docs`` documents hold keep a zero embedding.
    """
    y = np.array(labels)
    if len(set(labels)) < 2:
        return None
    rng, bags = np.random.default_rng(seed), Bags(texts)
    e = np.zeros((BUCKETS, WIDTH), np.float32)  # what was never seen says nothing
    w, b = rng.normal(0, 0.5, (WIDTH, 2)).astype(np.float32), np.zeros(2, np.float32)
    w2, b2 = np.full_like(w, 1e-4), np.full_like(b, 1e-4)
    lengths = np.array([max(LEAST, bags.sizes[s].sum()) for s in bags.spans], np.float32)
    e2 = np.full(BUCKETS, 1e-4, np.float32)
    steady = (bags.docs_with_label(y >= 0) >= least_docs).astype(np.float32)  # what few documents hold says nothing either
    tox = y.sum()
    often = [np.log((bags.docs_with_label(y == k) + 0.5) / (n + 1)) for k, n in ((1, tox), (0, len(y) - tox))]
    hint = bags.sums((often[0] - often[1]) * steady) / np.maximum(bags.sizes, 8)
    first = np.searchsorted(bags.doc, np.arange(len(y)))
    for r in range(rounds):
        words = bags.sums(e @ (w[:, 1] - w[:, 0]))
        score = np.array([words[s].sum() for s in bags.spans]) / lengths + b[1] - b[0]
        toxic = y[bags.doc] == 1
        if r == 0:  # nothing is learnt yet: go by the word that toxic documents hold most more often than others
            score = np.array([hint[x].max(initial=-9) for x in bags.spans])
        order = np.lexsort((-score, bags.doc))
        rank = np.empty(len(score), int)
        rank[order] = np.arange(len(score)) - first[bags.doc[order]]
        # of toxic documents the spans that show it, of others the nearest misses and some at random
        chosen = np.flatnonzero(np.where(toxic, rank < 1, (rank < 3) | (rng.random(len(score)) < 0.1)))
        size = min(batch, max(16, len(chosen) // 8))
        for _ in range(max(steps, -(-least_steps * size // len(chosen)))):
            rng.shuffle(chosen)
            for at in range(0, len(chosen), size):
                some = chosen[at : at + size]
                rows, n = bags.flat(some)
                owner = np.repeat(np.arange(len(some)), n)
                n = np.maximum(n, LEAST)
                h = np.stack([np.bincount(owner, e[rows, k], len(some)) for k in range(WIDTH)], axis=1) / n[:, None]
                z = h @ w + b
                p = np.exp(z - z.max(axis=1, keepdims=True))
                p /= p.sum(axis=1, keepdims=True)
                p[np.arange(len(some)), y[bags.doc[some]]] -= 1
                gw, gb, gh = h.T @ p / len(some), p.mean(axis=0), (p @ w.T / n[:, None]).astype(np.float32)
                used, back = np.unique(rows, return_inverse=True)
                ge = np.stack([np.bincount(back, gh[owner, k], len(used)) for k in range(WIDTH)], axis=1).astype(np.float32)
                e2[used] += (ge**2).mean(axis=1)
                e[used] -= rate * ge * (steady[used] / np.sqrt(e2[used]))[:, None]
                w2 += gw**2
                b2 += gb**2
                w -= 0.05 * gw / np.sqrt(w2)
                b -= 0.05 * gb / np.sqrt(b2)
    # with fewer documents of one class than of the other, half of what that adds to the bias is taken off again
    return Model.of(e, w, b - np.array([0, np.log(y.mean() / (1 - y.mean())) / 2]))


def sample_labelled(docs: DataFrame, labels: DataFrame, per_class: int = PER_CLASS) -> DataFrame:
    """(doc_id, toxic, text) of at most ``per_class`` labelled documents of each class."""
    known = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("toxic").cast("int").alias("toxic")).filter("doc_id is not null and toxic in (0, 1)")
    picked = None
    for label in (0, 1):
        some = known.filter(F.col("toxic") == label).distinct().orderBy(F.xxhash64("doc_id"), "doc_id").limit(per_class)
        picked = some if picked is None else picked.unionByName(some)
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).filter("text is not null")
    return texts.join(F.broadcast(picked), "doc_id").select("doc_id", "toxic", "text")  # 2 * per_class rows


def fit_sample(sample: DataFrame) -> Model | None:
    """The model of a bounded sample, fitted in one task so that the driver holds the finished numbers only."""
    schema = pa.schema([("bias", pa.float64()), ("odds", pa.binary())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = sorted({x for b in batches for x in zip(*(b.column(c).to_pylist() for c in ("doc_id", "toxic", "text")), strict=True)})
        rows = [r for k, r in enumerate(rows) if k == 0 or r[0] != rows[k - 1][0]]
        model = fit([r[2] for r in rows], [r[1] for r in rows])
        if model is not None:
            yield pa.RecordBatch.from_pydict({"bias": [model.bias], "odds": [model.odds.tobytes()]}, schema=schema)

    found = sample.repartition(1).mapInArrow(run, "bias double, odds binary").collect()
    return Model(np.frombuffer(found[0]["odds"], np.float32), found[0]["bias"]) if found else None


def score_texts(docs: DataFrame, model: Model | None, column: str = "toxicity") -> DataFrame:
    """``docs`` with ``column``, the probability of the worst span; an existing column of that name is replaced."""
    kept = [c for c in docs.columns if c != column]
    shared = docs.sparkSession.sparkContext.broadcast(model)  # BUCKETS floats

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        known: dict[str, int] = {}
        odds, sizes = np.empty(0), np.empty(0, np.int64)
        for batch in batches:
            for lo in range(0, batch.num_rows, 512):
                some, scores = batch.slice(lo, 512), []
                docs_chunks = [distinct_words(t.as_py() or "") for t in some.column(some.schema.get_field_index("text"))]
                if m is None:
                    yield pa.RecordBatch.from_arrays([*some.columns, pa.array([0.0] * some.num_rows, pa.float64())], names=[*some.schema.names, column])
                    continue
                if len(known) > 200_000:
                    known, odds, sizes = {}, odds[:0], sizes[:0]
                new = list(set().union(*docs_chunks).difference(known))
                rows, n = subwords(new)
                known.update(zip(new, range(len(known), len(known) + len(new)), strict=True))
                odds = np.concatenate([odds, np.bincount(np.repeat(np.arange(len(new)), n), m.odds[rows], len(new))])
                sizes = np.concatenate([sizes, n])
                for chunks in docs_chunks:
                    ids = np.fromiter(map(known.__getitem__, chunks), np.int64, len(chunks))
                    at = np.arange(0, len(ids), SPAN)
                    if not sizes[ids].any():
                        scores.append(0.0)
                        continue
                    best = (np.add.reduceat(odds[ids], at) / np.maximum(np.add.reduceat(sizes[ids], at), LEAST)).max()
                    scores.append(float(1 / (1 + np.exp(-np.clip(best + m.bias, -60, 60)))))
                yield pa.RecordBatch.from_arrays([*some.columns, pa.array(scores, pa.float64())], names=[*some.schema.names, column])

    chosen = docs.select(*kept)
    return chosen.mapInArrow(score, with_column(chosen, column, "double"))


def learned(spark: SparkSession, sf_dir: str) -> Model | None:
    """The model of the query and of the pipeline: learnt from labels whose crc32(doc_id) mod 5 is not 0."""
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet").filter(F.crc32(F.col("doc_id").cast("string")) % 5 != 0)
    return fit_sample(sample_labelled(spark.read.parquet(f"{sf_dir}/documents.parquet"), labels))


def op1_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scores of all ``documents``; one without a doc_id is not held out, and none of its labels is learnt."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    scored = score_texts(docs, learned(spark, sf_dir), "score")
    held_out = F.crc32(F.col("doc_id").cast("string")) % 5 == 0
    return scored.select("doc_id", F.coalesce(held_out, F.lit(False)).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


QUERIES = {"op1_toxicity": op1_toxicity}
