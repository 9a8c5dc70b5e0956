"""Scalar rules of session histories as Column functions; all run inside the JVM."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from sessionloom.functions.redact import redact

ROLES = ("user", "assistant", "toolResult", "custom")
DEFAULT_CHARS_PER_TOKEN = 4
# Fixed value: how marks in stored texts begin.
MARK = "[lcm:"
TRUNCATED = "\n\n[…truncated…]\n\n"
# Phrases by which providers state their context window, in the order in which they are tried, and words that stand in each.
WINDOW_PHRASES = {
    r"prompt is too long:[^>]*>\s*([\d,]+)\s*maximum": "prompt is too long:",
    r"maximum context length of\s*([\d,]+)\s*tokens?": "maximum context length of",
    r"maximum context length is\s*([\d,]+)\s*tokens?": "maximum context length is",
    r"context length\s*\(([\d,]+)(?:\s*tokens?)?\)": "context length",
    r"maximum number of tokens allowed\s*\(([\d,]+)\)": "maximum number of tokens allowed",
    r"maximum prompt length is\s*([\d,]+)": "maximum prompt length is",
    r"model with\s*([\d,]+)\s*maximum context length": "maximum context length",
    r"configured context size is\s*([\d,]+)\s*tokens?": "configured context size is",
    r"exceeds the limit of\s*([\d,]+)": "exceeds the limit of",
    r"maximum allowed input length of\s*([\d,]+)": "maximum allowed input length of",
    r"model token limit:?\s*([\d,]+)": "model token limit",
    r"range of input length should be\s*\[[\d,]+\s*,\s*([\d,]+)\]": "range of input length should be",
}
# Failure categories and the words that show them, first match wins.
FAILURES = (
    ("auth", r"\b(401|403|unauthoriz|forbidden|invalid api key|api key|authentication)\b"),
    ("rate-limit", r"\b(429|rate ?limit|too many requests|quota|overloaded)\b"),
    ("unavailable", r"\b(50\d|service unavailable|bad gateway|econnreset|econnrefused|enotfound|socket hang up|model not found|unknown model|does not exist)\b"),
    ("timeout", r"\b(timeout|timed out|etimedout|deadline|aborted|abort)\b"),
    ("length", r"\b(token cap|max(imum)? tokens|output limit|length limit)\b"),
)
# Words that don't count when texts are ordered by overlap.
STOP_WORDS = tuple("a,an,and,are,as,at,be,but,by,for,from,had,has,have,how,i,in,is,it,its,of,on,or,that,the,their,then,there,these,they,this,to,was,were,what,when,where,which,who,with,you,your".split(","))


def trimmed(text: Column) -> Column:
    """Without white space at either end, Unicode's included."""
    return F.regexp_replace(text, r"(?U)^\s+|\s+$", "")


def utf16_length(text: Column) -> Column:
    return (F.octet_length(F.encode(text, "UTF-16BE")) / 2).cast("long")


def estimate_tokens(text: Column) -> Column:
    return F.ceil(F.length(text) / DEFAULT_CHARS_PER_TOKEN)


def scaled_budget(tokens: Column, chars_per_token: Column) -> Column:
    scaled = F.round(tokens * chars_per_token / DEFAULT_CHARS_PER_TOKEN).cast("long")
    keep = chars_per_token.isNull() | (chars_per_token == DEFAULT_CHARS_PER_TOKEN)
    return F.when(keep, tokens).when(tokens > 0, F.greatest(scaled, F.lit(1))).otherwise(scaled)


def normalize_role(role: Column) -> Column:
    return F.when(role.isin(*ROLES), role).otherwise("custom")


def host_role(role: Column) -> Column:
    return F.when(role == "tool", "toolResult").when(role == "system", "custom").otherwise(normalize_role(role))


def session_hash(path: Column) -> Column:
    return F.left(F.sha2(path, 256), F.lit(16))


def safe_id(value: Column) -> Column:
    return F.regexp_replace(value, "[^A-Za-z0-9_-]", "_")


def model_key(provider: Column, model: Column) -> Column:
    present = (F.coalesce(provider, F.lit("")) != "") & (F.coalesce(model, F.lit("")) != "")
    return F.when(present, F.concat_ws("/", provider, model)).otherwise("")


def span_fingerprint(first: Column, last: Column, chain: Column) -> Column:
    return F.concat(first, F.lit(".."), last, F.lit("|"), F.array_join(chain, ","))


def window_from_error(message: Column) -> Column:
    """The first stated window between a thousand and a hundred million tokens.

    A phrase is tried where its fixed words stand in the text, and its number is told once and held while it is judged.
    """
    low, found = F.lower(message), []
    for phrase, words in WINDOW_PHRASES.items():
        n = F.regexp_replace(F.regexp_extract(message, f"(?i){phrase}", 1), ",", "").try_cast("long")
        stated = F.get(F.filter(F.array(n), lambda x: x.between(1_000, 100_000_000)), F.lit(0))
        found.append(F.when(F.contains(low, F.lit(words)), stated))
    return F.coalesce(*found)


def classify_failure(message: Column) -> Column:
    kind = F.lit("unknown")
    for name, words in reversed(FAILURES):
        kind = F.when(message.rlike(f"(?i){words}"), name).otherwise(kind)
    return kind


def retriable(category: Column) -> Column:
    return category.isin("unavailable", "timeout")


def utc_day(ts_ms: Column) -> Column:
    day = F.date_format(F.timestamp_millis(ts_ms), "yyyy-MM-dd")
    return F.when(ts_ms.isNull() | (ts_ms == 0), "(unknown)").otherwise(day)


def deterministic_truncate(text: Column, tokens: int) -> Column:
    """Texts of over 4 characters a token keep 70 % of that at the start and 20 % at the end."""
    most = DEFAULT_CHARS_PER_TOKEN * tokens
    cut = F.concat(F.left(text, F.lit(most * 7 // 10)), F.lit(TRUNCATED), F.right(text, F.lit(most * 2 // 10)))
    return F.when(F.length(text) <= most, text).otherwise(cut)


def char_window(text: Column, offset: Column, most: int, payload: Column | None = None, redactor: Callable[[Column], Column] | None = None) -> tuple[Column, Column, Column, Column]:
    """The slice from ``offset``, its end, the total length, and whether more follows, of a body: ``payload`` where given, else the text, redacted whole."""
    text = redact(text if payload is None else F.coalesce(payload, text), redactor=redactor)
    total = F.length(text)
    start = F.greatest(F.lit(0), F.least(offset, total))
    end = F.least(start + most, total)
    return F.substring(text, (start + 1).cast("int"), F.lit(most)), end, total, end < total


def clipped(text: Column, most: int) -> Column:
    note = F.concat(F.lit(f"{MARK}more "), F.length(text) - most, F.lit(" chars]"))
    return F.when(F.length(text) > most, F.concat(F.left(text, F.lit(most)), note)).otherwise(text)


def snippet(text: Column, most: int = 400, redactor: Callable[[Column], Column] | None = None) -> Column:
    """A text on one line, redacted whole and then cut."""
    return clipped(redact(trimmed(F.regexp_replace(text, r"(?U)\s+", " ")), redactor=redactor), most)


def one_decimal(v: Column) -> Column:
    """A double with one decimal, rounded from its binary value with ties to even, as ``printf`` does.

    ``format_string`` rounds the shortest decimal that tells the double, ties up. The product by ten is told with what its rounding lost: a
    float's 24 bits and the 29 below them times ten are exact.
    """
    size, ten = F.abs(v), F.abs(v) * 10
    high = size.cast("float").cast("double")
    lost, whole = high * 10 - ten + (size - high) * 10, F.floor(ten)
    over = ten - whole - 0.5
    up = F.when(over != 0, over > 0).when(lost != 0, lost > 0).otherwise(whole % 2 == 1)
    tenths = whole + up.cast("long")
    return F.concat(F.when(v < 0, "-").otherwise(""), F.floor(tenths / 10).cast("string"), F.lit("."), (tenths % 10).cast("string"))


def fmt_tokens(n: Column) -> Column:
    return F.when(F.abs(n) >= 1_000_000, F.concat(one_decimal(n / 1e6), F.lit("M"))).when(F.abs(n) >= 1_000, F.concat(one_decimal(n / 1e3), F.lit("k"))).otherwise(F.round(n).cast("long").cast("string"))


def fmt_bytes(n: Column) -> Column:
    return F.when(n >= 1 << 20, F.concat(one_decimal(n / float(1 << 20)), F.lit("M"))).when(n >= 1024, F.concat(F.round(n / 1024.0).cast("long").cast("string"), F.lit("K"))).otherwise(F.round(n).cast("long").cast("string"))


def fmt_duration(ms: Column) -> Column:
    """Milliseconds below a second, tenths of seconds below a minute, else minutes and the seconds that are left."""
    n = F.greatest(F.lit(0), F.round(ms).cast("long"))
    minutes, seconds = F.floor(n / 60_000).cast("string"), F.round(F.pmod(n, F.lit(60_000)) / 1000.0).cast("long")
    long = F.when(seconds == 0, F.concat(minutes, F.lit("m"))).otherwise(F.concat(minutes, F.lit("m "), seconds.cast("string"), F.lit("s")))
    return F.when(n < 1000, F.concat(n.cast("string"), F.lit("ms"))).when(n < 60_000, F.concat(one_decimal(n / 1000.0), F.lit("s"))).otherwise(long)


def fts_phrase(text: Column) -> Column:
    return F.concat(F.lit('"'), F.replace(text, F.lit('"'), F.lit('""')), F.lit('"'))


def tool_marker(tool: Column) -> Column:
    return F.concat(F.lit("[tool:"), tool, F.lit("]"))


def normalize_tools(tools: Column) -> Column:
    return F.array_distinct(F.filter(F.transform(tools, lambda t: F.lower(trimmed(t))), lambda t: t != ""))


MARKER = r"(?i)^\s*(?:\[tool:([^\]]+)\]|tool[_-]?call:\s*([A-Za-z0-9_:\-/.]+))"
ONLY_CALLS = r"(?i)^\s*(?:tool\s+[A-Za-z0-9_:\-/.]+|\[tool:[^\]]+\]|tool[_-]?call:\s*[A-Za-z0-9_:\-/.]+)"


def _none_if_empty(c: Column) -> Column:
    return F.when(c != "", c)


def tool_name(text: Column, role: Column, payload: Column | None = None) -> Column:
    """The tool that a message names: at its head, by a marker on a line, or in its JSON payload."""
    lines = F.filter(F.split(text, "\n"), lambda x: trimmed(x) != "")
    marked = F.transform(lines, lambda x: _none_if_empty(F.lower(trimmed(F.coalesce(_none_if_empty(F.regexp_extract(x, MARKER, 1)), F.regexp_extract(x, MARKER, 2))))))
    head = _none_if_empty(F.lower(F.regexp_extract(text, r"(?i)^\s*tool\s+([A-Za-z0-9_:\-/.]+)", 1)))
    by_line = F.when(role == "toolResult", F.get(marked, F.lit(0))).otherwise(F.get(F.filter(marked, lambda x: x.isNotNull()), F.lit(0)))
    found = F.coalesce(head, by_line)
    if payload is not None:
        v = F.try_parse_json(payload)
        named = [_none_if_empty(F.lower(trimmed(F.try_variant_get(v, path, "string")))) for key in ("name", "tool", "toolName") for path in (f"$[0].{key}", f"$.{key}")]
        found = F.coalesce(found, *named)
    talks = (role == "assistant") & (trimmed(text) != "") & ~F.forall(lines, lambda x: x.rlike(ONLY_CALLS))
    return F.when(role.isin("user", "custom") | talks, F.lit(None).cast("string")).otherwise(found)


def cite_ids(answer: Column, most: int = 20) -> Column:
    """Summary marks as ``#N``, then ``[a:b]`` entry ids, each once, the first ``most``."""
    summaries = F.transform(F.regexp_extract_all(answer, F.lit(rf"\{MARK}summary #(\d+)"), 1), lambda n: F.concat(F.lit("#"), n))
    entries = F.regexp_extract_all(answer, F.lit(r"\[([A-Za-z0-9_]+:[A-Za-z0-9_]+)\]"), 1)
    return F.slice(F.array_distinct(F.concat(summaries, entries)), 1, most)


# Extensions of source code and markup.
CODE_EXTENSIONS = ("ts", "tsx", "mts", "cts", "js", "jsx", "mjs", "cjs", "py", "rs", "go", "java", "rb", "sh", "sql", "css", "html", "yml", "yaml", "toml", "md")


def extension(path: Column) -> Column:
    name = F.element_at(F.split(path, "/"), -1)
    return F.lower(F.regexp_extract(name, r"^.+\.([^.]*)$", 1))


def file_kind(path: Column, text: Column) -> Column:
    """json, jsonl, tsv, csv, code or text; structure counts before the extension."""
    is_json = lambda c: c.rlike(r"^\s*[{\[]") & c.rlike(r"[}\]]\s*$") & F.try_parse_json(c).isNotNull()
    lines = F.filter(F.split(text, "\n"), lambda x: trimmed(x) != "")
    first = F.slice(lines, 1, 20)
    columns = lambda x, d: F.size(F.split(x, d))
    table = lambda d: (F.size(lines) >= 2) & (columns(F.get(first, F.lit(0)), d) >= 2) & F.forall(first, lambda x: columns(x, d) == columns(F.get(first, F.lit(0)), d))
    return (
        F.when((F.size(lines) >= 2) & F.forall(lines, is_json), "jsonl")  # the parser would stop after a first line
        .when(is_json(text), "json")
        .when(table("\t"), "tsv")
        .when(table(","), "csv")
        .when(extension(path).isin(*CODE_EXTENSIONS), "code")
        .otherwise("text")
    )


def file_descriptor(path: Column, text: Column) -> list[Column]:
    """file_id, bytes (characters), sha256, kind and the first 1200 characters on one line."""
    digest = F.sha2(text, 256)
    flat = F.left(trimmed(F.regexp_replace(text, r"(?U)\s+", " ")), F.lit(1200))
    return [F.left(digest, F.lit(16)).alias("file_id"), F.length(text).cast("long").alias("bytes"), digest.alias("sha256"), file_kind(path, text).alias("kind"), flat.alias("preview")]


def blocks_to_text(content: Column) -> Column:
    """Text of a message's content: a string as it is; of blocks the texts, ``[tool:NAME] JSON`` and ``[image]``, by line."""
    v = F.try_parse_json(content)
    blocks = F.try_variant_get(v, "$", "array<variant>")

    def one(b: Column) -> Column:
        kind = F.try_variant_get(b, "$.type", "string")
        args = F.coalesce(F.try_variant_get(b, "$.arguments", "variant"), F.try_variant_get(b, "$.input", "variant"), F.parse_json(F.lit("{}")))
        call = F.concat(F.lit("[tool:"), F.try_variant_get(b, "$.name", "string"), F.lit("] "), F.to_json(args))
        return F.when(kind == "text", F.try_variant_get(b, "$.text", "string")).when(kind.isin("toolCall", "tool_use"), call).when(kind == "image", "[image]")

    rendered = F.array_join(F.filter(F.transform(blocks, one), lambda x: x.isNotNull()), "\n")
    return F.coalesce(rendered, F.try_variant_get(v, "$", "string"), content)


def lossy_payload(content: Column) -> Column:
    """The JSON of blocks of which some lose content as text, else null."""
    blocks = F.try_variant_get(F.try_parse_json(content), "$", "array<variant>")

    def loses(b: Column) -> Column:
        kind = F.try_variant_get(b, "$.type", "string")
        has = lambda key: F.try_variant_get(b, f"$.{key}", "variant").isNotNull()
        text = (kind == "text") & F.try_variant_get(b, "$.text", "string").isNotNull()
        call = kind.isin("toolCall", "tool_use") & ~(has("arguments") & has("input"))
        return ~F.coalesce(text | call, F.lit(False))

    return F.when(F.exists(blocks, loses), content)
