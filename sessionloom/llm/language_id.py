"""Language identification by cross-parsing entropy.

For each language a suffix automaton of labelled text recognises every substring of that text. A document is cut
greedily into the longest phrases that the automaton knows. The number of phrases times the logarithm of the learnt
text's length estimates the cross entropy, so languages with unequal samples compare; the lowest one wins.

Every letter and mark that any language has is a symbol, whatever its script; one that a language doesn't have costs
that language a phrase. The transitions of all automata stand in one array in which the rows of states overlap
(each cell names the state it belongs to), so their size follows the learnt text and not the alphabet, and
thousands of pieces of text advance together, one symbol a step, in numpy.

The fit takes whole documents, those with the smallest hash of doc_id, of all languages: at most ``SAMPLE_CHARS``
characters of each, and at most ``ALL_CHARS`` divided by the number of languages. Every whole document is then parsed,
in pieces of ``PIECE`` symbols, each of which may cost every language one more phrase.

Nulls: a null text or one without a letter is ``und`` with score 0; a null ``lang`` is not learnt. Repeated rows
are predicted each. Equal estimates go to the language that sorts first. Without labelled text all are ``und``.
An empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import math
import re
import sys
import unicodedata
from collections.abc import Iterator
from functools import lru_cache
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from sessionloom.llm.common import arrow_schema, slices

SAMPLE_CHARS, ALL_CHARS, PIECE = 60_000, 2_000_000, 1024
LETTER = re.compile(r"[^\W\d_]")


def suffix_automaton(symbols: list[int]) -> list[dict[int, int]]:
    """Transitions of the smallest automaton that knows every substring of ``symbols``; state 0 is the root."""
    moves: list[dict[int, int]] = [{}]
    link, length, last = [-1], [0], 0
    for c in symbols:
        new = len(moves)
        moves.append({})
        length.append(length[last] + 1)
        link.append(0)
        p = last
        while p >= 0 and c not in moves[p]:
            moves[p][c] = new
            p = link[p]
        if p >= 0:
            q = moves[p][c]
            if length[q] == length[p] + 1:
                link[new] = q
            else:
                twin = len(moves)
                moves.append(dict(moves[q]))
                length.append(length[p] + 1)
                link.append(link[q])
                while p >= 0 and moves[p].get(c) == q:
                    moves[p][c] = twin
                    p = link[p]
                link[q] = link[new] = twin
        last = new
    return moves


class Cells:
    """Rows of transitions laid over each other: ``base[state] + symbol`` is the cell of a transition."""

    def __init__(self, first: int):
        self.first, self.used, self.found = first, bytearray(first + 1), []
        self.used[:first] = b"\1" * first

    def place(self, symbols: list[int], tries: int = 8) -> int:
        """A base at which all ``symbols`` find free cells, which are then taken."""
        at = self.first
        while True:
            slot = self.used.find(0, at) if tries else max(at, len(self.used))
            slot = len(self.used) if slot < 0 else slot
            base = slot - symbols[0]
            self.used.extend(bytes(max(0, base + symbols[-1] + 1 - len(self.used))))
            if at == self.first:
                self.first = slot
            if not any(self.used[base + s] for s in symbols):
                for s in symbols:
                    self.used[base + s] = 1
                return base
            at, tries = slot + 1, max(0, tries - 1)


def is_letter(c: str) -> bool:
    return unicodedata.category(c)[0] in "LM"


def letters_of(samples: list[str]) -> str:
    return "".join(sorted({c for s in samples for c in s.lower() if is_letter(c)}))


@lru_cache(maxsize=1)
def _codes(letters: str) -> np.ndarray:
    """The symbol of every character: 1 for blanks, from 2 on for letters, 0 for the rest."""
    codes = np.zeros(sys.maxunicode + 1, np.int32)
    codes[[k for k in range(1 << 16) if chr(k).isspace()]] = 1
    for k, c in enumerate(letters, 2):
        for same in {c, c.upper(), c.title()}:
            if len(same) == 1:
                codes[ord(same)] = k
    return codes


def to_symbols(text: str, letters: str) -> np.ndarray:
    return _codes(letters)[np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)]


class Language(NamedTuple):
    """The automaton of one language as flat arrays."""

    weight: float
    base: np.ndarray  # of each state
    cells: np.ndarray  # which state a cell belongs to in its upper half, the next state in its lower half
    begin: np.ndarray  # for each symbol the state after a new phrase that begins with it, the root (0) where it can't

    @classmethod
    def of(cls, sample: str, letters: str) -> Language:
        coded, width = to_symbols(sample, letters), len(letters) + 2
        automaton = suffix_automaton(coded.tolist())
        moves = [{c: t for c, t in found.items() if c} for found in automaton]
        cells, base = Cells(width), np.zeros(len(moves), np.int32)
        for state in sorted(range(len(moves)), key=lambda k: -len(moves[k])):
            if moves[state]:
                base[state] = cells.place(sorted(moves[state]))
        laid = np.full(int(base.max(initial=0)) + width, -1, np.int64)
        for state, found in enumerate(moves):
            for c, target in found.items():
                laid[base[state] + c] = state << 32 | target
        begin = np.zeros(width, np.int32)
        for c, target in (moves[0] if moves else {}).items():
            begin[c] = target
        return cls(math.log2(np.count_nonzero(coded) + 2), base, laid, begin)


class Parser:
    """Automata of several languages, one behind the other in the same arrays.

    Symbol 0 stands for all that is neither blank nor a letter which some language has; it ends a phrase for every
    language alike and is not counted.
    """

    def __init__(self, langs: tuple[str, ...], samples: tuple[str, ...]):
        letters = letters_of(list(samples))
        self._join(langs, letters, [Language.of(s, letters) for s in samples])

    @classmethod
    def join(cls, langs: tuple[str, ...], letters: str, parts: list[Language]) -> Parser:
        parser = cls.__new__(cls)
        parser._join(langs, letters, parts)
        return parser

    def _join(self, langs: tuple[str, ...], letters: str, parts: list[Language]) -> None:
        self.langs, self.letters, self.width = langs, letters, len(letters) + 2
        self.weights = np.array([p.weight for p in parts], float)
        self.roots = np.cumsum([0, *(len(p.base) for p in parts)])[: len(parts)].astype(np.int32)
        places = np.cumsum([0, *(len(p.cells) for p in parts)])[: len(parts)]
        whole = lambda arrays, kind: np.concatenate([np.empty(0, kind), *arrays]).astype(kind)
        self.base = whole([p.base + at for p, at in zip(parts, places, strict=True)], np.int32)
        self.cells = whole([np.where(p.cells < 0, -1, p.cells + (int(root) << 32 | int(root))) for p, root in zip(parts, self.roots, strict=True)], np.int64)
        self.begin = whole([p.begin + root for p, root in zip(parts, self.roots, strict=True)], np.int32)

    def symbols(self, text: str) -> np.ndarray:
        return to_symbols(text, self.letters)

    def phrases(self, texts: list[str]) -> np.ndarray:
        """Phrase counts, texts by languages."""
        pieces = [(d, x[at : at + PIECE]) for d, x in enumerate(map(self.symbols, texts)) for at in range(0, len(x), PIECE)]
        pieces.sort(key=lambda p: -len(p[1]))
        sizes = np.array([len(p[1]) for p in pieces], np.int64)
        lanes = np.zeros((int(sizes[0]) if len(sizes) else 0, len(pieces)), np.int32)
        for k, (_, x) in enumerate(pieces):
            lanes[: len(x), k] = x
        roots, offsets = self.roots[:, None], (np.arange(len(self.langs)) * self.width)[:, None]
        state = np.repeat(roots, len(pieces), axis=1)
        count = np.zeros(state.shape, np.int64)
        active = np.searchsorted(-sizes, -np.arange(len(lanes)), side="left")
        for j, n in enumerate(active.tolist()):
            s, now = lanes[j, :n], state[:, :n]
            cell = self.cells.take(self.base.take(now) + s)
            goes = cell >> 32 == now
            count[:, :n] += (~goes | (now == roots)) & (s > 0)
            state[:, :n] = np.where(goes, cell & 0xFFFFFFFF, self.begin.take(offsets + s))
        counts = np.zeros((len(texts), len(self.langs)), np.int64)
        np.add.at(counts, [p[0] for p in pieces], count.T)
        return counts


def sample_languages(docs: DataFrame, chars: int = SAMPLE_CHARS, most: int = ALL_CHARS) -> dict[str, str]:
    """For each language up to ``chars`` characters of text (up to ``most`` of all), documents in hash order.

    Row counts and mean lengths by language give the hash range to read, so a few times the wanted characters are sorted.
    """
    known = docs.filter("lang is not null and text is not null").select("doc_id", "lang", "text")
    sizes = known.groupBy("lang").agg(F.count("*").alias("n"), F.avg(F.length("text")).alias("mean")).cache()
    chars = min(chars, most // max(1, sizes.count()))
    wanted = 4 * chars / F.greatest("mean", F.lit(1)) + 32
    share = F.pmod(F.xxhash64("doc_id"), F.lit(1 << 30)) / float(1 << 30)
    bounds = sizes.select("lang", (wanted / F.col("n")).alias("range"))
    some = known.join(bounds, "lang").filter(share <= F.col("range")).withColumn("text", F.substring("text", 1, chars)).withColumn("size", F.length("text"))
    order = Window.partitionBy("lang").orderBy(F.xxhash64("doc_id"), "doc_id", "text")
    before = F.coalesce(F.sum("size").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    rows = some.withColumn("before", before).filter(F.col("before") < chars).withColumn("text", F.expr(f"substring(text, 1, {chars} - before)")).orderBy("lang", "before").collect()
    sizes.unpersist()
    found: dict[str, str] = {}
    for r in rows:  # at most ``chars`` characters of each language, ``most`` of all
        found[r["lang"]] = f"{found[r['lang']]}\n{r['text']}" if r["lang"] in found else r["text"]
    return {lang: text.lower() for lang, text in found.items()}


def built(spark: SparkSession, samples: dict[str, str]) -> Parser:
    """The parser of all ``samples``, each language's automaton built in a task of its own; flat arrays alone reach the driver."""
    langs = tuple(sorted(samples))
    letters = letters_of(list(samples.values()))
    ddl = "lang string,weight double,base binary,cells binary,begin binary"
    schema = arrow_schema(ddl)

    def build(rows: pa.Table) -> pa.Table:
        made = Language.of(rows.column("text")[0].as_py(), letters)
        return pa.table({"lang": rows.column("lang"), "weight": [made.weight], "base": [made.base.tobytes()], "cells": [made.cells.tobytes()], "begin": [made.begin.tobytes()]}, schema=schema)

    if not langs:
        return Parser((), ())
    rows = spark.createDataFrame([(k, samples[k]) for k in langs], "lang string, text string")
    made = {r["lang"]: r for r in rows.repartition(len(langs), "lang").groupBy("lang").applyInArrow(build, ddl).collect()}  # ALL_CHARS bounds it
    read = lambda r: Language(r["weight"], np.frombuffer(r["base"], np.int32), np.frombuffer(r["cells"], np.int64), np.frombuffer(r["begin"], np.int32))
    return Parser.join(langs, letters, [read(made[k]) for k in langs])


def identify(docs: DataFrame, samples: dict[str, str]) -> DataFrame:
    """doc_id, lang_pred, score."""
    ddl = "doc_id long,lang_pred string,score double"
    schema = arrow_schema(ddl)
    langs = tuple(sorted(samples))
    shared = docs.sparkSession.sparkContext.broadcast(built(docs.sparkSession, samples))  # ALL_CHARS bounds it

    def predict(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value
        for part in slices(batches):
            texts = [t or "" for t in part["text"]]
            preds, scores = ["und"] * len(texts), [0.0] * len(texts)
            if langs:
                bits = model.phrases(texts) * model.weights
                best = bits.argmin(axis=1)
                phrases = (bits - bits.min(axis=1, keepdims=True)) / model.weights.max()
                sure = 1 / np.exp(-np.minimum(phrases, 60)).sum(axis=1)
                for k, t in enumerate(texts):
                    if LETTER.search(t):
                        preds[k], scores[k] = langs[best[k]], float(sure[k])
            yield pa.RecordBatch.from_pydict({"doc_id": part["doc_id"], "lang_pred": preds, "score": scores}, schema=schema)

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(predict, ddl)


def op6_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Languages of all ``documents``, learnt from those whose crc32(doc_id) mod 4 is not 2; one without a doc_id is neither learnt from nor held out."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text", "lang")
    fold = F.crc32(F.col("doc_id").cast("string")) % 4
    found = identify(docs, sample_languages(docs.filter(fold != 2)))
    return found.select("doc_id", F.coalesce(fold == 2, F.lit(False)).alias("held_out"), "lang_pred", "score")


QUERIES = {"op6_language_id": op6_language_id}
