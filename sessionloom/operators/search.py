"""Recall: ranked term search, regular-expression scans, tool scopes and views over many sessions."""

from __future__ import annotations

import re
from typing import NamedTuple

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sessionloom.functions import scalars as S
from sessionloom.functions.redact import once
from sessionloom.operators.dag import covering_leaf

K1, B = 1.2, 0.75


def terms_of(text: Column, indexed_chars: int | None = None) -> Column:
    """Terms of whole texts, or of their first ``indexed_chars`` characters."""
    part = text if indexed_chars is None else F.substring(text, 1, indexed_chars)
    return F.filter(F.split(F.lower(part), r"[^\p{L}\p{N}]+"), lambda t: t != "")


def visible_rows(messages: DataFrame, removed: bool = False) -> DataFrame:
    """Without removed rows, unless these are asked for."""
    return messages if removed or "removed_at_ms" not in messages.columns else messages.filter("removed_at_ms is null")


def ranked_search(messages: DataFrame, terms: list[str], any_term: bool = False, role: str | None = None, removed: bool = False, indexed_chars: int | None = None) -> DataFrame:
    """(session_id, row_id, score): BM25 by session over messages that hold all (or any) terms.

    Texts are tokenised where they stand; only counts of the query's terms, one row per hit, and one row of
    totals per session are shuffled. A term ending in ``*`` matches by prefix.
    """
    tokens = visible_rows(messages, removed).select("session_id", "row_id", "role", terms_of(F.col("text"), indexed_chars).alias("t"))

    def count(term: str) -> Column:
        hit = (lambda t: t.startswith(term[:-1])) if term.endswith("*") else (lambda t: t == term)
        return F.size(F.filter("t", hit))

    wanted = [t.lower() for t in terms]
    counted = tokens.select("session_id", "row_id", "role", F.size("t").alias("length"), *[count(t).alias(f"f{k}") for k, t in enumerate(wanted)])
    totals = counted.groupBy("session_id").agg(F.count("*").alias("n"), F.avg("length").alias("mean"), *[F.count_if(F.col(f"f{k}") > 0).alias(f"n{k}") for k in range(len(wanted))])
    has = [F.col(f"f{k}") > 0 for k in range(len(wanted))]
    match = has[0]
    for h in has[1:]:
        match = match | h if any_term else match & h
    hits = counted.filter(match if role is None else match & (F.col("role") == role)).join(totals, "session_id")
    score = sum((F.log(1 + (F.col("n") - F.col(f"n{k}") + 0.5) / (F.col(f"n{k}") + 0.5)) * F.col(f"f{k}") * (K1 + 1) / (F.col(f"f{k}") + K1 * (1 - B + B * F.col("length") / F.col("mean"))) for k in range(len(wanted))), F.lit(0.0))
    return hits.select("session_id", "row_id", F.round(score, 6).alias("score"))


def phrase_hits(messages: DataFrame, phrase: list[str], indexed_chars: int | None = None, removed: bool = False) -> DataFrame:
    """Messages that hold the words of a phrase one after the other."""
    joined = F.concat(F.lit("\0"), F.array_join(terms_of(F.col("text"), indexed_chars), "\0"), F.lit("\0"))  # terms are letters and digits
    return visible_rows(messages, removed).filter(F.contains(joined, F.lit("\0" + "".join(f"{w}\0" for w in phrase)))).select("session_id", "row_id")


def top_per_session(hits: DataFrame, per_session: int = 10, sessions: DataFrame | None = None, most_sessions: int = 20, most: int = 40) -> DataFrame:
    """The best of each session, newest sessions first."""
    order = Window.partitionBy("session_id").orderBy(F.desc("score"), "row_id")
    best = hits.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= per_session)
    if sessions is None:
        return best
    newest = sessions.orderBy(F.desc("when_ms"), "session_id").limit(most_sessions)
    return best.join(F.broadcast(newest), "session_id").orderBy(F.desc("when_ms"), "session_id", "rank").limit(most)


SKIPS = ("missing", "unreadable", "older-generation")


def search_counts(hits: DataFrame, refs: DataFrame, per_session: int = 10, most_sessions: int = 20, most: int = 40) -> DataFrame:
    """One row: how many sessions (session_id, when_ms, skip) a search goes through, newest first, how many it skips and why, whether it ends before the last one, and its hits.

    A session gives ``per_session`` hits at most, one that ``skip`` names a reason for gives none; after ``most`` hits no further session is opened.
    """
    newest = refs.orderBy(F.desc("when_ms"), "session_id").limit(most_sessions)
    found = hits.groupBy("session_id").agg(F.least(F.count("*"), F.lit(per_session)).alias("found"))
    rows = newest.join(found, "session_id", "left").withColumn("found", F.when(F.col("skip").isNull(), F.coalesce("found", F.lit(0))).otherwise(0))
    before = F.sum("found").over(Window.orderBy(F.desc("when_ms"), "session_id").rowsBetween(Window.unboundedPreceding, -1))  # most_sessions rows
    seen = rows.withColumn("seen", F.coalesce(before, F.lit(0)) < most)
    skipped = [F.count_if(F.col("seen") & F.coalesce(F.col("skip") == s, F.lit(False))).alias(s.replace("-", "_")) for s in SKIPS]
    total = F.coalesce(F.sum(F.when(F.col("seen"), F.col("found"))), F.lit(0))
    return seen.agg(F.count_if(F.col("seen") & F.col("skip").isNull()).alias("scanned"), *skipped, F.coalesce(F.max(~F.col("seen")), F.lit(False)).alias("truncated"), F.least(total, F.lit(most)).alias("hits"))


ROLES = ("user", "assistant", "toolResult", "custom")


def refused_filter(role: str | None = None, start_ms: float | None = None, end_ms: float | None = None, tool: str | None = None) -> str | None:
    """Why a search's filters are refused, before anything is read; None where they are sound."""
    if role is not None and role not in ROLES:
        return f"unknown role {role!r}; one of {', '.join(ROLES)}"
    for name, value in (("start_ms", start_ms), ("end_ms", end_ms)):
        if value is not None and not (isinstance(value, (int, float)) and 0 <= value < float("inf")):
            return f"{name} must be a time of 0 or later"
    if tool is not None and not tool.strip():
        return "a tool has a name"
    return None


def filtered(messages: DataFrame, role: str | None = None, start_ms: float | None = None, end_ms: float | None = None, tool: str | None = None) -> DataFrame:
    """Messages of a role, a time span and a tool's scope; unsound filters are refused."""
    if reason := refused_filter(role, start_ms, end_ms, tool):
        raise ValueError(reason)
    if tool is not None:
        messages = messages.join(tool_scope(messages, tool), ["session_id", "row_id"], "left_semi")
    for condition in (role is not None and F.col("role") == role, start_ms is not None and F.col("ts_ms") >= start_ms, end_ms is not None and F.col("ts_ms") <= end_ms):
        messages = messages if condition is False else messages.filter(condition)
    return messages


class Leaf(NamedTuple):
    """Terms that follow each other; with ``prefix`` the last one is the beginning of a term."""

    terms: tuple[str, ...]
    prefix: bool = False

    def count(self, t: Column) -> Column:
        """How often it stands in the terms ``t``, which are worked out once: a filter on the count would work them out again for each term."""

        def here(words: Column, x: Column, i: Column) -> Column:
            hit = F.lit(True)
            for k, term in enumerate(self.terms):
                word = x if k == 0 else F.get(words, i + k)
                hit = hit & F.coalesce(F.startswith(word, F.lit(term)) if self.prefix and k == len(self.terms) - 1 else word == term, F.lit(False))
            return hit

        return once(t, lambda words: F.size(F.filter(words, lambda x, i: here(words, x, i))))


class Both(NamedTuple):
    """``op`` (AND, OR, NOT) of two parts; NOT means the left one without the right one."""

    op: str
    left: Leaf | Both
    right: Leaf | Both


def query_terms(text: str) -> tuple[str, ...]:
    return tuple(w for w in re.split(r"[\W_]+", text.lower()) if w)


_PIECES = re.compile(r'\s+|"((?:[^"]|"")*)"(\*?)|([()])|(\w+)(\*?)|(.)', re.S)
#: From loose to tight; words without a sign between them bind tightest.
_LEVELS = ("OR", "AND", "NOT", "")


def read_query(text: str) -> Leaf | Both | None:
    """A query of terms, ``prefix*``, "phrases", AND, OR, NOT and parentheses; None where it doesn't read as one.

    A term that holds several words, as ``api_key`` does, is a phrase.
    """
    pieces: list[str | Leaf] = []
    for m in _PIECES.finditer(text):
        quoted, star, bracket, word, word_star, other = m.groups()
        if other:
            return None
        if bracket or word in _LEVELS and not word_star:
            pieces.append(bracket or word)
        elif quoted is not None or word:
            leaf = Leaf(query_terms(quoted if word is None else word), bool(star or word_star))
            if not leaf.terms:
                return None
            pieces.append(leaf)

    def part(level: int) -> Leaf | Both | None:
        if level == len(_LEVELS):
            first = pieces.pop(0) if pieces else None
            if first != "(":
                return first if isinstance(first, Leaf) else None
            inside = part(0)
            return inside if pieces and pieces.pop(0) == ")" else None
        found = part(level + 1)
        sign = _LEVELS[level]
        while found is not None and pieces and (pieces[0] == sign if sign else isinstance(pieces[0], Leaf) or pieces[0] == "("):
            if sign:
                pieces.pop(0)
            right = part(level + 1)
            found = right and Both(sign or "AND", found, right)
        return found

    query = part(0)
    return None if pieces else query


def boolean_search(messages: DataFrame, query: Leaf | Both, removed: bool = False, offset: int = 0, limit: int | None = None, indexed_chars: int | None = None) -> DataFrame:
    """(session_id, row_id, score, rank) of the messages that ``query`` holds for, best first by session; a page of them where a limit is given.

    One pass counts each of the query's phrases in a message; the tree over these counts selects, and BM25 by session ranks by
    all phrases that aren't excluded. Only counts and totals are shuffled.
    """
    leaves: list[Leaf] = []
    ranked: set[Leaf] = set()

    def collect(part: Leaf | Both, counts: bool) -> None:
        if isinstance(part, Leaf):
            leaves.extend([part] if part not in leaves else [])
            ranked.update([part] if counts else [])
        else:
            collect(part.left, counts)
            collect(part.right, counts and part.op != "NOT")

    def holds(part: Leaf | Both) -> Column:
        if isinstance(part, Leaf):
            return F.col(f"f{leaves.index(part)}") > 0
        left, right = holds(part.left), holds(part.right)
        return left & right if part.op == "AND" else left | right if part.op == "OR" else left & ~right

    collect(query, True)
    tokens = visible_rows(messages, removed).select("session_id", "row_id", terms_of(F.col("text"), indexed_chars).alias("t"))
    counted = tokens.select("session_id", "row_id", F.size("t").alias("length"), *[leaf.count(F.col("t")).alias(f"f{k}") for k, leaf in enumerate(leaves)])
    scored = [k for k, leaf in enumerate(leaves) if leaf in ranked]
    totals = counted.groupBy("session_id").agg(F.count("*").alias("n"), F.avg("length").alias("mean"), *[F.count_if(F.col(f"f{k}") > 0).alias(f"n{k}") for k in scored])
    hits = counted.filter(holds(query)).join(totals, "session_id")
    score = sum((F.log(1 + (F.col("n") - F.col(f"n{k}") + 0.5) / (F.col(f"n{k}") + 0.5)) * F.col(f"f{k}") * (K1 + 1) / (F.col(f"f{k}") + K1 * (1 - B + B * F.col("length") / F.col("mean"))) for k in scored), F.lit(0.0))
    order = Window.partitionBy("session_id").orderBy(F.desc("score"), "row_id")
    placed = hits.select("session_id", "row_id", F.round(score, 6).alias("score")).withColumn("rank", F.row_number().over(order))
    return placed if limit is None else placed.filter((F.col("rank") > offset) & (F.col("rank") <= offset + limit))


def search_query(messages: DataFrame, query: str, removed: bool = False, offset: int = 0, limit: int | None = None) -> DataFrame:
    """``boolean_search`` of a written query; one that doesn't read as such is searched as a phrase, and one without any letter or digit is refused."""
    words = query_terms(query)
    if not words:
        raise ValueError(f"nothing to search in {query!r}")
    return boolean_search(messages, read_query(query) or Leaf(words), removed, offset, limit)


def with_covering_leaf(hits: DataFrame, provenance: DataFrame, summaries: DataFrame) -> DataFrame:
    """Hits with ``summary_id`` of the leaf that covers them, null where none does."""
    return hits.join(covering_leaf(hits, provenance, summaries), ["session_id", "row_id"], "left")


def regex_scan(messages: DataFrame, pattern: str, after_row: int = 0, scanned_chars: int | None = None, most_matches: int | None = None, case_sensitive: bool = False) -> DataFrame:
    """(session_id, row_id, at, matches, partial): first place and number of matches in whole texts.

    ``scanned_chars`` scans that many first characters only (``partial`` tells where more follow), ``most_matches`` bounds the count.
    A pattern that is empty, unreadable or matches the empty string is refused.
    """
    part = F.col("text") if scanned_chars is None else F.substring("text", 1, scanned_chars)
    partial = F.lit(False) if scanned_chars is None else F.length("text") > scanned_chars
    regex = pattern if case_sensitive else f"(?i){pattern}"
    empty = messages.sparkSession.range(1).select(F.lit("").rlike(regex))
    if not pattern or empty.first()[0]:
        raise ValueError(f"pattern {pattern!r} matches the empty string")
    rows = messages.filter((F.col("row_id") > after_row) & part.rlike(regex))
    before = rf"{'' if case_sensitive else '(?i)'}^[\s\S]*?(?=(?:{pattern}))"  # all up to the first match, lookarounds included
    at = F.length(F.regexp_extract(part, before, 0))
    matches = F.regexp_count(part, F.lit(regex))
    matches = matches if most_matches is None else F.least(matches, F.lit(most_matches))
    return rows.select("session_id", "row_id", at.alias("at"), matches.alias("matches"), partial.alias("partial"))


def page_of(hits: DataFrame, offset: int = 0, limit: int = 200) -> DataFrame:
    """A page of each session's hits in row order, with ``more``, whether others follow it; the offset counts hits."""
    order = Window.partitionBy("session_id").orderBy("row_id")
    placed = hits.withColumn("k", F.row_number().over(order)).filter((F.col("k") > offset) & (F.col("k") <= offset + limit + 1))
    more = F.max("k").over(Window.partitionBy("session_id")) > offset + limit
    return placed.withColumn("more", more).filter(F.col("k") <= offset + limit).drop("k")


def tool_scope(messages: DataFrame, tool: str) -> DataFrame:
    """Rows that name the tool, and the results that follow until another row breaks off."""
    named = S.tool_name(F.col("text"), F.col("role"))
    anchor = (~F.col("role").isin("user", "custom")) & (F.contains("text", F.lit(f"[tool:{tool}]")) | F.coalesce(named == tool, F.lit(False)))
    ends = (F.col("role") != "toolResult") | named.isNotNull() | F.contains("text", F.lit("[tool:"))
    kind = F.when(anchor, "anchor").when(ends, "break")
    order = Window.partitionBy("session_id").orderBy("row_id").rowsBetween(Window.unboundedPreceding, 0)
    marked = messages.select("session_id", "row_id", kind.alias("kind"))
    return marked.withColumn("last", F.last("kind", ignorenulls=True).over(order)).filter("kind = 'anchor' or kind is null and last = 'anchor'").select("session_id", "row_id")


def expand_page(edges: DataFrame, messages: DataFrame, offset: int, limit: int, anchor: DataFrame | None = None) -> DataFrame:
    """A page of the messages below each node, in row order; centred on ``anchor`` (session_id, node, row_id) where given."""
    order = Window.partitionBy("session_id", "node").orderBy("row_id")
    rows = edges.select("session_id", "node", "row_id").distinct().withColumn("k", F.row_number().over(order) - 1)
    sizes = rows.groupBy("session_id", "node").agg(F.count("*").alias("n"))
    if anchor is None:
        starts = sizes.withColumn("start", F.lit(offset))
    else:
        at = rows.join(anchor, ["session_id", "node", "row_id"]).select("session_id", "node", F.col("k").alias("at"))
        centred = F.greatest(F.lit(0), F.least(F.col("at") - limit // 2, F.col("n") - limit))
        starts = sizes.join(at, ["session_id", "node"], "left").withColumn("start", F.coalesce(centred, F.lit(offset)))
    page = rows.join(starts, ["session_id", "node"]).filter((F.col("k") >= F.col("start")) & (F.col("k") < F.col("start") + limit))
    return page.join(messages.select("session_id", "row_id", "role", "text"), ["session_id", "row_id"]).select("session_id", "node", "row_id", "role", "text")


def query_words(question: str) -> list[str]:
    return sorted({w for w in re.split(r"[^a-z0-9]+", question.lower()) if len(w) > 2 and w not in S.STOP_WORDS})


def order_by_overlap(nodes: DataFrame, question: str, text: str = "text") -> DataFrame:
    """Nodes with ``overlap``, the number of the question's words in them, and ``place`` within their session."""
    words = F.array(*map(F.lit, query_words(question))).cast("array<string>")
    score = F.size(F.array_intersect(words, F.split(F.lower(F.col(text)), "[^a-z0-9]+")))
    order = Window.partitionBy("session_id").orderBy(F.desc("overlap"), "position")
    return nodes.withColumn("overlap", score).withColumn("place", F.row_number().over(order))


def read_budget(reads: DataFrame, budget_tokens: int) -> DataFrame:
    """What of ordered reads fits a budget: all, a part, or nothing."""
    most = 4 * budget_tokens
    order = Window.partitionBy("session_id").orderBy("place")
    before = F.coalesce(F.sum("chars").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    got = F.greatest(F.lit(0), F.least(F.col("chars"), most - before))
    return reads.withColumn("granted", got).withColumn("outcome", F.when(F.col("granted") == F.col("chars"), "full").when(F.col("granted") > 0, "partial").otherwise("refused"))
