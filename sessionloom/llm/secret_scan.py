"""Secret scans by combined automata.

All rules are compiled into one minimal deterministic automaton over bytes (``automaton``) of the reversed rules. One
pass over a text, last byte first, tells every place at which a match of some rule starts. A second minimal automaton
of all rules, which matches from one place on, then reads the bytes of those matches only and gives their
ends, so spans come from transition arrays alone. The longest match at a place counts; matches of one rule do not overlap.
A repetition at the end of a rule is asked for ``DEPTH`` times only in the first automaton, which keeps it small; the second
one counts in full.

Rules are (kind, pattern, counted): of leftmost non-overlapping matches of ``pattern`` those stay that ``counted``, where
given, matches from end to end. A match that fails still takes up its bytes. Patterns are over UTF-8 bytes.

Spans are code points, end exclusive. Nulls: a null text has no spans; null and repeated ids stay as they are;
an empty table gives no rows; other columns pass through ``find_secrets`` and ``redact_secrets``.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sessionloom.llm.automaton import backwards, bits_of, compile_rules, parsed, shortened
from sessionloom.llm.common import with_column

DEPTH = 6
_ASSIGN = r"""([pP][aA][sS][sS][wW][oO][rR][dD]|[pP][aA][sS][sS][wW][dD]|[sS][eE][cC][rR][eE][tT]|[tT][oO][kK][eE][nN]|[aA][pP][iI]_?[kK][eE][yY])["']?\x20*[:=]\x20*["']?[A-Za-z0-9+/_.=\-]"""
# Kind, pattern, and what a match must be to count. Base rules come first. A run of too few hex digits, or of
# too few signs after AKIA, hides no longer one, so these patterns have their least length.
RULES = (
    ("assign", _ASSIGN + "+", _ASSIGN + "{6,}"),
    ("access", r"AKIA[A-Z0-9]{16,}", None),
    ("hex", r"[0-9a-f]{24,}", None),
    ("github", r"gh[opsu]_[A-Za-z0-9]{36,}", None),
    ("slack", r"xox[abprs]-[A-Za-z0-9\-]{10,}", None),
    ("google", r"AIza[A-Za-z0-9_\-]{35}", None),
    ("stripe", r"sk_live_[A-Za-z0-9]{24,}", None),
    ("jwt", r"eyJ[A-Za-z0-9_\-]{10,}\.[A-Za-z0-9_\-]{10,}\.[A-Za-z0-9_\-]+", None),
    ("pem", r"-----BEGIN [A-Z ]*PRIVATE KEY-----", None),
)
BASE = 3


class Scanner:
    """Both automata of a set of rules; its size depends on the rules alone."""

    def __init__(self, rules=RULES, depth: int = DEPTH):
        self.kinds = [kind for kind, *_ in rules]
        trees = [parsed(pattern) for _, pattern, _ in rules]
        self.starts = compile_rules([backwards(shortened(t, depth)) for t in trees])
        counted = [(k, parsed(c)) for k, (_, _, c) in enumerate(rules) if c]
        self.whole = compile_rules([*trees, *(t for _, t in counted)], anchored=True)
        self.counts = {k: 1 << len(trees) + n for n, (k, _) in enumerate(counted)}

    def spans(self, text: str | None) -> list[tuple[str, int, int]]:
        """(kind, start, end) by start, then in the rules' order."""
        data = (text or "").encode("utf-8", "replace")
        marks = self.starts.ends(data[::-1])
        if not marks:
            return []
        found, free = [], [0] * len(self.kinds)
        columns = data.translate(self.whole.columns)
        for n, mask in reversed(marks):
            at = len(data) - n
            for k, (end, bits) in self._ends(columns, at, sum(1 << k for k in bits_of(mask) if free[k] <= at)).items():
                free[k] = end
                if bits & self.counts.get(k, bits):
                    found.append((at, k, end))
        if not text.isascii():
            before = np.concatenate([[0], np.cumsum((np.frombuffer(data, np.uint8) & 0xC0) != 0x80)])
            found = [(int(before[a]), k, int(before[b])) for a, k, b in found]
        return [(self.kinds[k], a, b) for a, k, b in sorted(found)]

    def _ends(self, columns: bytes, at: int, wanted: int) -> dict[int, tuple[int, int]]:
        """For each wanted rule that matches from ``at`` on, the longest end and all bits of the state there."""
        ends: dict[int, tuple[int, int]] = {}
        if not wanted:
            return ends
        table, first, found, state, dead = self.whole.table, self.whole.first_accepting, self.whole.found, self.whole.start, self.whole.dead
        for place in range(at, len(columns)):
            state = table[state + columns[place]]
            if state == dead:
                break
            if state >= first:
                for k in bits_of(found[state] & wanted):
                    ends[k] = (place + 1, found[state])
        return ends


_SPAN = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64())]))


def _scanned(docs: DataFrame, text: str, rules) -> Callable[[Iterator[pa.RecordBatch]], Iterator[tuple[pa.RecordBatch, list]]]:
    """Batches of 1024 rows at most with the spans of each row's text."""
    shared = docs.sparkSession.sparkContext.broadcast(Scanner(rules))

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.RecordBatch, list]]:
        scanner = shared.value
        for batch in (b.slice(at, 1024) for b in batches for at in range(0, b.num_rows, 1024)):
            yield batch, [scanner.spans(value.as_py()) for value in batch.column(batch.schema.get_field_index(text))]

    return scan


def find_secrets(docs: DataFrame, text: str = "text", rules=RULES) -> DataFrame:
    """``docs`` with ``secret_spans``, an array of (kind, start, end); an existing column of that name is replaced."""
    chosen = docs.select(*[c for c in docs.columns if c != "secret_spans"])
    scan = _scanned(docs, text, rules)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, spans in scan(batches):
            found = pa.array([[{"kind": k, "start": s, "end": e} for k, s, e in x] for x in spans], _SPAN)
            yield pa.RecordBatch.from_arrays([*batch.columns, found], names=[*batch.schema.names, "secret_spans"])

    return chosen.mapInArrow(run, with_column(chosen, "secret_spans", "array<struct<kind:string,start:long,end:long>>"))


def masked(text: str, spans: list[tuple[str, int, int]], mask: str) -> str:
    """``text`` with each run of overlapping spans replaced."""
    out, at = [], 0
    for _, start, end in spans:
        if start >= at:
            out += [text[at:start], mask]
        at = max(at, end)
    return "".join([*out, text[at:]])


def redact_secrets(docs: DataFrame, mask: str = "[SECRET]", rules=RULES) -> DataFrame:
    """Documents with each run of overlapping spans replaced by ``mask``; ``n_chars`` follows where it exists."""
    scan = _scanned(docs, "text", rules)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, spans in scan(batches):
            columns = dict(zip(batch.schema.names, batch.columns, strict=True))
            texts = [t.as_py() for t in columns["text"]]
            new = [masked(t, x, mask) if x else t for t, x in zip(texts, spans, strict=True)]
            columns["text"] = pa.array(new, columns["text"].type)
            if "n_chars" in columns:
                kind = columns["n_chars"].type
                columns["n_chars"] = pa.array([len(t) if x else n for t, x, n in zip(new, spans, columns["n_chars"].to_pylist(), strict=True)], kind)
            yield pa.RecordBatch.from_pydict(columns, schema=batch.schema)

    return docs.mapInArrow(run, docs.schema)


def op7_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Secrets of all ``documents``: counts and the digest of base spans, and all spans as text."""
    found = find_secrets(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")).drop("text")
    names = [name for name, *_ in RULES[:BASE]]
    listed = lambda spans: F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")
    count = lambda name: F.size(F.filter("secret_spans", lambda s: s["kind"] == name)).cast("long").alias(f"n_{name}")
    base = F.filter("secret_spans", lambda s: s["kind"].isin(names))
    return found.select("doc_id", *map(count, names), F.sha2(listed(base), 256).alias("base_sha256"), listed(F.col("secret_spans")).alias("spans"))


QUERIES = {"op7_secret_scan": op7_secret_scan}
