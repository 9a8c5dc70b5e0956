"""Session files and host histories as tables."""

from __future__ import annotations

import re
from collections.abc import Iterator
from urllib.parse import quote

import pandas as pd
import pyarrow as pa
from pyarrow import fs
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sessionloom.functions import scalars as S
from sessionloom.functions.redact import once, redact


def read_messages(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path)


def session_headers(lines: DataFrame) -> DataFrame:
    """(file, session_id, cwd, when_ms) from the first line of each file; files without a valid one are left out."""
    return _headers(lines.groupBy("file").agg(F.min_by("line", "line_no").alias("line"), F.min("mtime_ms").alias("mtime_ms")))


def _headers(first: DataFrame) -> DataFrame:
    h = F.from_json("line", "type string,cwd string,id string,timestamp string")
    parsed = first.withColumn("h", h).filter("h.type = 'session' and h.id is not null and h.cwd is not null")
    stamp = F.try_to_timestamp(F.col("h.timestamp"))
    return parsed.select("file", F.col("h.id").alias("session_id"), F.col("h.cwd").alias("cwd"), F.coalesce(F.unix_millis(stamp), "mtime_ms").alias("when_ms"))


#: Rows of a listing that stand in memory as a data frame.
ROWS = 10_000
#: Bytes that are read at a time until the first line ends, and characters of lines that stand in memory besides the last.
BLOCK, HELD = 8_192, 1 << 22
#: What ``Path.toUri`` of Hadoop escapes in a name.
_ESCAPED = re.compile(r'[\x00-\x20"#%<>?\[\\\]^`{|}\x7f]')


def _uri(spark: SparkSession, path: str) -> str | None:
    """The folder ``path`` as a URI where Arrow reads its store too; null for patterns, single files, names that URIs escape and other stores."""
    if path.startswith("/"):
        path = spark.sparkContext._jsc.hadoopConfiguration().get("fs.defaultFS").rstrip("/") + path
    if not re.fullmatch(r"[a-z0-9]+:/[\w./:=@+-]+", path, re.ASCII):
        return None
    try:
        store, base = fs.FileSystem.from_uri(path)
        if store.get_file_info(base).type != fs.FileType.Directory:
            return None
    except (pa.ArrowInvalid, pa.ArrowNotImplementedError, OSError):
        return None
    return re.sub("^file:/+", "file:/", path).rstrip("/")


def _files(spark: SparkSession, uri: str) -> DataFrame:
    """(path, bytes, mtime_ms) of all files below a folder, without the hidden ones that Spark's readers pass over.

    A task lists the folder, others what stands in it, one folder at a time; so no list of all files is made on the driver, as Spark's own would be.
    """
    kind = "path string,folder boolean,bytes long,mtime_ms long"

    def entries(at: str) -> pd.DataFrame:
        store, base = fs.FileSystem.from_uri(uri)
        seen = [x for x in store.get_file_info(fs.FileSelector(base + at)) if x.type in (fs.FileType.File, fs.FileType.Directory) and not re.match(r"\.|_(?!.*=)|.*\._COPYING_$", x.base_name)]
        rows = [(x.path[len(base) :], x.type == fs.FileType.Directory, x.size, x.mtime_ns // 1_000_000) for x in seen]
        return pd.DataFrame(rows, columns=["path", "folder", "bytes", "mtime_ms"]).astype({"folder": bool})

    def parts(found: pd.DataFrame) -> Iterator[pd.DataFrame]:
        return (found[k : k + ROWS] for k in range(0, len(found), ROWS))

    def top(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for _ in range(len(pdf)):
                yield from parts(entries(""))

    def walk(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            yield pdf[~pdf["folder"]]
            todo = list(pdf["path"][pdf["folder"]])
            while todo:
                found = entries(todo.pop())
                todo.extend(found["path"][found["folder"]])
                yield from parts(found[~found["folder"]])

    listed = _dealt(spark.range(0, 1, 1, 1).mapInPandas(top, kind)).mapInPandas(walk, kind)
    return listed.select(F.concat(F.lit(uri), "path").alias("path"), "bytes", "mtime_ms")


def _dealt(rows: DataFrame) -> DataFrame:
    """Few small rows that stand for much work, one after the other to as many tasks as a shuffle has."""
    return rows.repartition(int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")))


def _first_lines(files: DataFrame, uri: str) -> DataFrame:
    """(file, mtime_ms, line) of files below ``uri``, as Spark's reader of texts gives them; what stands behind the first line isn't read."""

    def first(f: pa.NativeFile) -> str:
        line = []
        while block := f.read(BLOCK):
            end = re.search(rb"[\r\n]", block)
            line.append(block[: end.start()] if end else block)
            if end:
                break
        return b"".join(line).decode("utf-8-sig", "replace")

    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        store, base = fs.FileSystem.from_uri(uri)
        for pdf in batches:
            rows, size = [], 0
            for path, mtime_ms in zip(pdf["path"], pdf["mtime_ms"], strict=True):
                with store.open_input_stream(base + path[len(uri) :]) as f:
                    rows.append((_ESCAPED.sub(lambda m: quote(m[0]), path), mtime_ms, first(f)))
                size += len(rows[-1][-1])
                if size > HELD:
                    yield pd.DataFrame(rows, columns=names)
                    rows, size = [], 0
            if rows:
                yield pd.DataFrame(rows, columns=names)

    names = ["file", "mtime_ms", "line"]
    return _dealt(files.select("path", "mtime_ms")).mapInPandas(read, "file string,mtime_ms long,line string")


def read_session_headers(spark: SparkSession, path: str) -> DataFrame:
    """``session_headers`` of the files below ``path``, the file's time standing in for an unreadable stamp.

    Tasks open the files themselves: Spark's reader of texts takes several times as long to open one as its header takes to read, and reads it to
    its end. It is left to stores that only Spark reads. There only the first block of a file holds its first line, and rows come in the order of the file; the
    others are dropped in the scan.
    """
    if uri := _uri(spark, path):
        return _headers(_first_lines(_files(spark, uri), uri))
    lines = spark.read.text(path, recursiveFileLookup=True).select(F.col("_metadata.file_path").alias("file"), F.unix_millis("_metadata.file_modification_time").alias("mtime_ms"), F.col("value").alias("line"), F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("line_no"))
    return session_headers(lines.filter("block = 0"))


def read_inventory(spark: SparkSession, path: str, but: str | None = None) -> DataFrame:
    """(path, bytes, mtime_ms) of all files below ``path``, newest first, but one; contents aren't read. In stores that only Spark reads, empty files are left out."""
    if uri := _uri(spark, path):
        return inventory(_files(spark, uri), but)
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
    return inventory(files.select("path", F.col("length").alias("bytes"), F.unix_millis("modificationTime").alias("mtime_ms")), but)


def inventory(files: DataFrame, but: str | None = None) -> DataFrame:
    """Files (path, length, modificationTime) newest first, but one."""
    kept = files if but is None else files.filter(F.col("path") != but)
    return kept.orderBy(F.desc("mtime_ms"), "path")


def newest_sessions(headers: DataFrame, most: int, cwd: str | None = None, but: str | None = None) -> DataFrame:
    chosen = headers if cwd is None else headers.filter(F.col("cwd") == cwd)
    return (chosen if but is None else chosen.filter(F.col("session_id") != but)).orderBy(F.desc("when_ms"), "session_id").limit(most)


def tool_text(tool: Column, call: Column, result: Column, error: Column) -> Column:
    """``tool NAME INPUT`` and on the next line what came back."""
    body = F.when(error.isNotNull(), F.concat(F.lit("error: "), error)).otherwise(F.coalesce(result, F.lit("")))
    return F.concat(F.lit("tool "), tool, F.lit(" "), call, F.lit("\n"), body)


def prompt_text(text: Column, names: Column) -> Column:
    """A prompt and its attachments, by name, or their number where none has one."""
    named = F.filter(names, lambda n: n.isNotNull() & (n != ""))
    listed = F.when(F.size(named) > 0, F.array_join(named, ", ")).otherwise(F.size(names).cast("string"))
    return F.when(F.size(names) > 0, F.concat(text, F.lit("\n[attachments: "), listed, F.lit("]"))).otherwise(text)


def host_text(role: Column, text: Column, command: Column, output: Column) -> Column:
    return F.when(role == "bashExecution", F.concat(F.lit("$ "), command, F.lit("\n"), output)).otherwise(text)


def query_outcome(reply: Column) -> Column:
    """hit, miss, refused or error by how a reply begins."""
    low = F.lower(reply)
    return F.when(low.startswith("error"), "error").when(low.startswith("refused"), "refused").when(low.startswith("no ") | (S.trimmed(reply) == ""), "miss").otherwise("hit")


def billed(usage: Column) -> list[Column]:
    """Finite counters of a usage object."""
    v = F.try_parse_json(usage)
    return [F.try_variant_get(v, f"$.{name}", "double").alias(alias) for name, alias in (("input", "input"), ("output", "output"), ("cache.read", "cache_read"), ("cost.total", "cost_total"))]


def usage_rows(rows: DataFrame) -> DataFrame:
    """Rows (…, usage) with their counters, only those that were billed at all, and ``estimated`` where the usage says so."""
    v = F.try_parse_json("usage")
    counters = {"input": "input", "output": "output", "cache_read": "cacheRead", "cache_write": "cacheWrite", "cost_input": "cost.input", "cost_output": "cost.output", "cost_total": "cost.total"}
    numbers = {c: F.when(F.schema_of_variant(F.try_variant_get(v, f"$.{name}", "variant")).isin("BIGINT", "DOUBLE", "FLOAT") | F.schema_of_variant(F.try_variant_get(v, f"$.{name}", "variant")).startswith("DECIMAL"), F.try_variant_get(v, f"$.{name}", "double")) for c, name in counters.items()}
    told = rows.withColumns(numbers | {"estimated": F.coalesce(F.try_variant_get(v, "$.estimated", "boolean"), F.lit(False))})
    return told.filter(F.coalesce(*counters).isNotNull())


def input_tokens(usage: Column) -> Column:
    """Input and cached tokens; null where either is missing."""
    v = F.try_parse_json(usage)
    return F.try_variant_get(v, "$.input", "double") + F.try_variant_get(v, "$.cache.read", "double")


def path_hints(blocks: DataFrame, results: DataFrame) -> DataFrame:
    """Results (session_id, call_id, ...) with the path of the call they answer; the last call of an id wins.

    ``blocks`` are calls (session_id, call_id, pos, arguments as JSON).
    """
    v = F.try_parse_json("arguments")
    path = F.coalesce(*[F.try_variant_get(v, f"$.{k}", "string") for k in ("path", "file_path", "filePath")])
    calls = blocks.withColumn("path", path).groupBy("session_id", "call_id").agg(F.max_by("path", "pos").alias("path"))
    return results.join(calls, ["session_id", "call_id"], "left")


def entry_ids(parts: DataFrame) -> DataFrame:
    """Parts (session_id, message_id, at, type, call_id, status) with their entry ids; parts without one are left out.

    Texts are numbered within their message, empty ones too; tool calls count once they are completed or failed.
    """
    order = Window.partitionBy("session_id", "message_id").orderBy("at")
    ordinal = F.sum(F.when(F.col("type") == "text", 1).otherwise(0)).over(order) - 1
    done = (F.col("type") == "tool") & F.col("status").isin("completed", "error")
    id_ = (
        F.when(F.col("type") == "prompt", F.concat_ws(":", "session_id", F.lit("prompt"), "message_id"))
        .when((F.col("type") == "text") & (F.coalesce("text", F.lit("")) != ""), F.concat_ws(":", "session_id", F.lit("text"), "message_id", F.col("ordinal").cast("string")))
        .when(done, F.concat_ws(":", "session_id", F.lit("tool"), "message_id", "call_id"))
    )
    return parts.withColumn("ordinal", ordinal).withColumn("entry_id", id_).filter("entry_id is not null").drop("ordinal")


def silent_messages(messages: DataFrame, entries: DataFrame) -> DataFrame:
    return messages.join(entries.select("session_id", "message_id"), ["session_id", "message_id"], "left_anti")


def compaction_marks(entries: DataFrame) -> DataFrame:
    """(session_id, mark, n): 24 hex digits of the digest of a session's ordered ids, and how many there are."""
    ids = F.transform(F.sort_array(F.collect_list(F.struct("pos", "entry_id"))), lambda x: x["entry_id"])
    return entries.groupBy("session_id").agg(F.left(F.sha2(F.array_join(ids, ":"), 256), F.lit(24)).alias("mark"), F.count("*").alias("n"))


def bus_entries(events: DataFrame) -> DataFrame:
    """Entries (session_id, entry_id, pos, role, text) of bus events as JSON; other and malformed events are skipped."""
    e = F.from_json("event", "id string,type string,data struct<sessionID:string,assistantMessageID:string,ordinal:long,text:string,reason:string>")
    parsed = events.withColumn("e", e)
    ended, compacted = F.col("e.type") == "session.text.ended", F.col("e.type") == "session.compaction.ended"
    d = "e.data"
    text_id = F.concat_ws(":", f"{d}.sessionID", F.lit("text"), f"{d}.assistantMessageID", F.col(f"{d}.ordinal").cast("string"))
    id_ = F.when(ended & F.col(f"{d}.assistantMessageID").isNotNull() & F.col(f"{d}.ordinal").isNotNull(), text_id).when(compacted, F.concat_ws(":", f"{d}.sessionID", F.lit("compaction"), "e.id"))
    role = F.when(ended, "assistant").otherwise("custom")
    return parsed.select(F.col(f"{d}.sessionID").alias("session_id"), id_.alias("entry_id"), "pos", role.alias("role"), F.col(f"{d}.text").alias("text")).filter("session_id is not null and entry_id is not null and text is not null")


def checkpoints(messages: DataFrame) -> DataFrame:
    """Sessions whose first message is a finished compaction with a usable marker."""
    first = messages.groupBy("session_id").agg(F.min_by(F.struct("type", "status", "metadata"), "pos").alias("m"))
    v = F.try_parse_json("m.metadata")
    nodes = F.try_variant_get(v, "$.nodes", "array<bigint>")
    return first.withColumn("nodes", nodes).filter((F.col("m.type") == "compaction") & ~F.coalesce(F.col("m.status"), F.lit("")).isin("running", "failed") & (F.size("nodes") > 0)).select("session_id", "nodes")


def render_part(kind: Column, name: Column, arguments: Column, text: Column) -> Column:
    return F.when(kind == "text", text).when(kind == "tool-call", F.concat(F.lit("tool-call: "), name, F.lit(" "), arguments)).when(kind == "tool-result", text)


#: Fields whose texts others wrote.
FOREIGN_FIELDS = ("error", "errorMessage", "message", "detail", "note")


def sanitize_path(value: Column, home: str) -> Column:
    """The home folder becomes ``~``; another absolute path ``<path>``."""

    def bound(v: Column) -> Column:
        inside = (v == home) | v.startswith(f"{home}/")
        return F.when(inside, F.concat(F.lit("~"), F.substring(v, len(home) + 1, 1 << 30))).when(v.rlike(r"^(/|[A-Za-z]:[\\/])"), "<path>").otherwise(v)

    return once(value, bound)


def sanitized(value: Column, kind: T.DataType, home: str, name: str = "", fields: tuple[str, ...] = FOREIGN_FIELDS, every: bool = False) -> Column:
    """``value`` of any type with paths bound and the texts of ``fields`` (``every``: all texts) redacted, at whatever depth.

    The rewrite follows the schema: fields of structs by their names, elements of arrays by the array's name, values of
    maps by their keys. A VARIANT is rewritten as JSON by ``sanitized_json``.
    """
    if isinstance(kind, T.StringType):
        return sanitize_path(redact(value) if every or name in fields else value, home)
    if isinstance(kind, T.ArrayType):
        return F.transform(value, lambda x: sanitized(x, kind.elementType, home, name, fields, every))
    if isinstance(kind, T.MapType):
        told = lambda k, v: F.when(k.isin(*fields), sanitized(v, kind.valueType, home, fields[0], fields, every)).otherwise(sanitized(v, kind.valueType, home, "", fields, every))
        return F.transform_values(value, told)
    if isinstance(kind, T.StructType):
        parts = [sanitized(value[f.name], f.dataType, home, f.name, fields, every).alias(f.name) for f in kind.fields]
        return F.when(value.isNotNull(), F.struct(*parts))
    if isinstance(kind, T.VariantType):
        return F.try_parse_json(sanitized_json(F.to_json(value), home, fields, every))
    return value


#: A string of a JSON text with what tells its field: the text is cut at these.
_STRING = r'"(?:[^"\\]|\\.)*"'


def sanitized_json(line: Column, home: str, fields: tuple[str, ...] = FOREIGN_FIELDS, every: bool = False) -> Column:
    """A JSON text whose string values are sanitized like ``sanitized`` does, of any shape and depth.

    The text is cut into strings and what stands between them. A string before a colon is a name; it holds for the value behind
    it and for all elements of an array, until the next name; so a string that follows an object within one array goes by that object's
    last name. Names are left as they are, null stays null. Strings, gaps and what becomes of them are worked out once a line, not once for
    each of its strings.
    """

    def step(state: Column, x: Column) -> Column:
        inside = F.lit(True) if every else state["name"].isin(*fields)
        coded = lambda clean: once(F.to_json(F.array(clean)), lambda c: F.substring(c, F.lit(2), F.length(c) - 2))
        new = lambda plain: once(sanitize_path(F.when(inside, redact(plain)).otherwise(plain), home), lambda clean: F.when(clean == plain, x["s"]).otherwise(coded(clean)))
        told = lambda plain: F.struct(F.concat(state["out"], F.array(F.when(x["is_name"], x["s"]).otherwise(new(plain)))).alias("out"), F.when(x["is_name"], plain).otherwise(state["name"]).alias("name"))
        return once(F.get(F.from_json(F.concat(F.lit("["), x["s"], F.lit("]")), "array<string>"), F.lit(0)), told)

    begin = F.struct(F.array().cast("array<string>").alias("out"), F.lit("").alias("name"))

    def joined(gaps: Column) -> Column:
        paired = F.transform(F.regexp_extract_all(line, F.lit(_STRING), F.lit(0)), lambda s, k: F.struct(s.alias("s"), F.get(gaps, k + 1).rlike(r"^\s*:").alias("is_name")))
        done = F.aggregate(paired, begin, step, lambda s: s["out"])
        return once(done, lambda d: F.array_join(F.transform(gaps, lambda g, k: F.concat(g, F.coalesce(F.get(d, k), F.lit("")))), ""))

    return F.when(line.isNotNull(), once(F.split(line, _STRING), joined))
