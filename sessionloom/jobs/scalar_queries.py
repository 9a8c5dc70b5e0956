"""Queries of the scalar rules over whole tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from sessionloom.functions import redact as R
from sessionloom.functions import scalars as S
from sessionloom.registry import query
from sessionloom.sources.fixtures import over_tables, view


@query("b01_estimate_tokens", "SELECT doc_id, CAST(ceil(length(text) / 4.0) AS BIGINT) AS tokens FROM documents")
def estimate(spark, d):
    return spark.read.parquet(f"{d}/documents.parquet").select("doc_id", S.estimate_tokens(F.col("text")).alias("tokens"))


@query(
    "b02_scaled_budget",
    """SELECT event_id, CASE WHEN event_id % 5 = 0 OR event_id % 3 + 2 + event_id % 4 * 0.25 = 4 THEN event_id
       ELSE greatest(CAST(floor(event_id * (event_id % 3 + 2 + event_id % 4 * 0.25) / 4 + 0.5) AS BIGINT), CASE WHEN event_id > 0 THEN 1 ELSE 0 END) END AS budget FROM events""",
)
def budget(spark, d):
    e = spark.read.parquet(f"{d}/events.parquet").select("event_id")
    ratio = F.when(F.col("event_id") % 5 != 0, F.col("event_id") % 3 + 2 + F.col("event_id") % 4 * 0.25)
    return e.select("event_id", S.scaled_budget(F.col("event_id"), ratio).alias("budget"))


@query(
    "b03_roles",
    """SELECT conv_id, turn, CASE WHEN role IN ('user','assistant','toolResult','custom') THEN role ELSE 'custom' END AS role,
       CASE WHEN role = 'system' THEN 'custom' ELSE role END AS host_role FROM conversations""",
)
def roles(spark, d):
    c = spark.read.parquet(f"{d}/conversations.parquet")
    return c.select("conv_id", "turn", S.normalize_role(F.col("role")).alias("role"), S.host_role(F.col("role")).alias("host_role"))


_BLOCKS = """concat('[{"type":"text","text":"', role, '"},{"type":"toolCall","name":"read","arguments":{"turn":', CAST(turn AS VARCHAR(9)), '}},{"type":"image","data":"x"},{"type":"odd"}]')"""


@query("b04_blocks_to_text", "SELECT conv_id, turn, concat(role, chr(10), '[tool:read] {\"turn\":', CAST(turn AS VARCHAR), '}', chr(10), '[image]') AS text FROM conversations")
def blocks(spark, d):
    c = spark.read.parquet(f"{d}/conversations.parquet").withColumn("content", F.expr(_BLOCKS))
    return c.select("conv_id", "turn", S.blocks_to_text(F.col("content")).alias("text"))


@query("b05_lossy_payload", "SELECT conv_id, turn, turn % 2 = 0 AS lossy FROM conversations")
def lossy(spark, d):
    c = spark.read.parquet(f"{d}/conversations.parquet").withColumn("content", F.when(F.col("turn") % 2 == 0, F.expr(_BLOCKS)).otherwise('[{"type":"text","text":"a"},{"type":"tool_use","name":"x","input":{}}]'))
    return c.select("conv_id", "turn", S.lossy_payload(F.col("content")).isNotNull().alias("lossy"))


@query(
    "b08_tool_name",
    """SELECT entry_id, CASE WHEN role = 'user' THEN NULL
         WHEN role = 'assistant' THEN lower(regexp_extract(text, '^\\[tool:([^\\]]+)\\]', 1))
         WHEN text LIKE 'tool %' THEN lower(regexp_extract(text, '^tool ([A-Za-z0-9_:/.-]+)', 1)) END AS tool FROM fx_tool_messages""",
)
def tool_names(spark, d):
    return view(spark, d, "fx_tool_messages").select("entry_id", S.tool_name(F.col("text"), F.col("role")).alias("tool"))


@query("b09_tool_membership", "SELECT event_id, event_type IN ('click', 'signup') AS listed FROM events")
def membership(spark, d):
    tools = S.normalize_tools(F.array(F.lit(" Click"), F.lit("SIGNUP "), F.lit("click"), F.lit(" ")))
    return spark.read.parquet(f"{d}/events.parquet").select("event_id", F.array_contains(tools, F.col("event_type")).alias("listed"))


def _redact_sql(text: str) -> str:
    """The same passes over ``text`` by regular expressions of another engine."""
    replaced = lambda t, pattern, by: "regexp_replace({}, '{}', '{}', 'g')".format(t, pattern.replace("'", "''"), by)
    for pattern in R.TOKEN_PATTERNS:
        text = replaced(text, pattern, R.REDACTED)
    for direct, other, value in R.SHAPES:
        text = replaced(text, f"(?i)(?:({direct})|({other}))({value})", rf"\1{R.A}\2{R.B}\3{R.C}")
        text = replaced(text, f"{R.A}{R.B}[^{R.C}]*{R.C}", R.REDACTED)
        text = replaced(text, f"{R.A}([^{R.B}]*){R.B}[^0-9{R.C}]*[0-9][^{R.C}]*{R.C}", rf"\1{R.REDACTED}")
        text = f"translate({text}, '{R.A}{R.B}{R.C}', '')"
    return text


@query(
    "b10_redact_tokens",
    f"""SELECT doc_id, CAST(length(text) AS INTEGER) AS before, CAST(length(t) AS INTEGER) AS after, CAST(len(string_split(t, '[REDACTED]')) - 1 AS INTEGER) AS n_redacted, left(sha256(t), 16) AS digest
        FROM (SELECT doc_id, text, {_redact_sql('text')} AS t FROM documents) q""",
)
def redact_texts(spark, d):
    docs = spark.read.parquet(f"{d}/documents.parquet").select("doc_id", "text")
    done = docs.select("doc_id", F.length("text").alias("before"), R.redact(F.col("text")).alias("text"))
    return done.select("doc_id", "before", F.length("text").alias("after"), F.regexp_count("text", F.lit(r"\[REDACTED\]")).alias("n_redacted"), F.left(F.sha2("text", 256), F.lit(16)).alias("digest"))


@query(
    "b11_snippet",
    f"""WITH o AS (SELECT doc_id, trim(regexp_replace(text, '\\s+', ' ', 'g')) AS o FROM documents), f AS (SELECT doc_id, {_redact_sql('o')} AS t FROM o)
       SELECT doc_id, CASE WHEN length(t) > 400 THEN concat(left(t, 400), '[lcm:more ', length(t) - 400, ' chars]') ELSE t END AS line FROM f""",
)
def snippets(spark, d):
    return spark.read.parquet(f"{d}/documents.parquet").select("doc_id", S.snippet(F.col("text")).alias("line"))


@query(
    "b12_char_window",
    f"""WITH f AS (SELECT doc_id, {_redact_sql("CASE WHEN doc_id % 5 = 0 THEN concat('payload ', source, ' ', text) ELSE text END")} AS text FROM documents)
       SELECT doc_id, substring(text, CAST(least(doc_id, length(text)) + 1 AS BIGINT), 200) AS slice, least(least(doc_id, length(text)) + 200, length(text)) AS upto,
       CAST(length(text) AS BIGINT) AS total, least(doc_id, length(text)) + 200 < length(text) AS more FROM f""",
)
def windows(spark, d):
    payload = F.when(F.col("doc_id") % 5 == 0, F.concat(F.lit("payload "), "source", F.lit(" "), "text"))
    part, end, total, more = S.char_window(F.col("text"), F.col("doc_id"), 200, payload)
    return spark.read.parquet(f"{d}/documents.parquet").select("doc_id", part.alias("slice"), end.cast("long").alias("upto"), total.cast("long").alias("total"), more.alias("more"))


@query("b13_clip", "SELECT doc_id, CASE WHEN length(text) > 100 THEN concat(left(text, 100), '[lcm:more ', length(text) - 100, ' chars]') ELSE text END AS text FROM documents")
def clip(spark, d):
    return spark.read.parquet(f"{d}/documents.parquet").select("doc_id", S.clipped(F.col("text"), 100).alias("text"))


@query(
    "b14_truncate",
    "SELECT doc_id, CASE WHEN length(text) <= 2048 THEN text ELSE concat(left(text, 1433), chr(10), chr(10), '[…truncated…]', chr(10), chr(10), right(text, 409)) END AS text FROM documents",
)
def truncate(spark, d):
    return spark.read.parquet(f"{d}/documents.parquet").select("doc_id", S.deterministic_truncate(F.col("text"), 512).alias("text"))


@query(
    "b15_conversation_render",
    "SELECT session_id, string_agg(concat('[', role, ']', chr(10), text), concat(chr(10), chr(10)) ORDER BY row_id) AS rendered FROM fx_messages GROUP BY session_id",
)
def render(spark, d):
    m = view(spark, d, "fx_messages").withColumn("one", F.concat(F.lit("["), "role", F.lit("]\n"), "text"))
    ordered = F.transform(F.sort_array(F.collect_list(F.struct("row_id", "one"))), lambda x: x["one"])
    return m.groupBy("session_id").agg(F.array_join(ordered, "\n\n").alias("rendered"))


@query(
    "b16_file_kind",
    r"""WITH l AS (SELECT doc_id, path, text, list_filter(string_split(text, chr(10)), lambda x: length(trim(x)) > 0) AS lines FROM fx_files)
        SELECT doc_id, CASE WHEN len(lines) >= 2 AND len(string_split(lines[1], chr(9))) >= 2 AND len(list_filter(lines[1:20], lambda x: len(string_split(x, chr(9))) <> len(string_split(lines[1], chr(9))))) = 0 THEN 'tsv'
          WHEN len(lines) >= 2 AND len(string_split(lines[1], ',')) >= 2 AND len(list_filter(lines[1:20], lambda x: len(string_split(x, ',')) <> len(string_split(lines[1], ',')))) = 0 THEN 'csv'
          WHEN path LIKE '%.md' OR path LIKE '%.py' THEN 'code' ELSE 'text' END AS kind FROM l""",
)
def kinds(spark, d):
    return view(spark, d, "fx_files").select("doc_id", S.file_kind(F.col("path"), F.col("text")).alias("kind"))


@query("b18_file_descriptor", "SELECT doc_id, left(sha256(text), 16) AS file_id, CAST(length(text) AS BIGINT) AS bytes, sha256(text) AS sha256, left(trim(regexp_replace(text, '\\s+', ' ', 'g')), 1200) AS preview FROM fx_files")
def descriptors(spark, d):
    f = view(spark, d, "fx_files")
    return f.select("doc_id", *S.file_descriptor(F.col("path"), F.col("text"))).drop("kind")


@query(
    "b19_b20_ids",
    "SELECT doc_id, left(sha256(path), 16) AS session_hash, regexp_replace(path, '[^A-Za-z0-9_-]', '_', 'g') AS safe FROM fx_files",
)
def ids(spark, d):
    return view(spark, d, "fx_files").select("doc_id", S.session_hash(F.col("path")).alias("session_hash"), S.safe_id(F.col("path")).alias("safe"))


_MESSAGES = """SELECT event_id, CASE event_id % 6 WHEN 0 THEN concat('prompt is too long: 9 > ', event_id * 37, ' maximum') WHEN 1 THEN concat('This model''s maximum context length is ', event_id, ',000 tokens')
 WHEN 2 THEN '429 Too many requests' WHEN 3 THEN '503 Service Unavailable' WHEN 4 THEN 'request timed out' ELSE 'invalid api key' END AS message FROM events"""


@query(
    "b21_window_from_error",
    f"""WITH m AS ({_MESSAGES}), w AS (SELECT event_id, CASE event_id % 6 WHEN 0 THEN event_id * 37 WHEN 1 THEN event_id * 1000 END AS n FROM m)
        SELECT event_id, CASE WHEN n BETWEEN 1000 AND 100000000 THEN n END AS stated FROM w""",
)
def window_stated(spark, d):
    return over_tables(spark, d, _MESSAGES).select("event_id", S.window_from_error(F.col("message")).alias("stated"))


@query(
    "b22_classify_failure",
    """WITH n AS (SELECT event_id, CASE event_id % 6 WHEN 0 THEN CAST(event_id * 37 AS VARCHAR) WHEN 1 THEN CAST(event_id AS VARCHAR) END AS code FROM events),
 c AS (SELECT event_id, CASE WHEN event_id % 6 = 5 OR code IN ('401', '403') THEN 'auth' WHEN event_id % 6 = 2 OR code = '429' THEN 'rate-limit' WHEN event_id % 6 = 3 OR code LIKE '50_' THEN 'unavailable'
   WHEN event_id % 6 = 4 THEN 'timeout' ELSE 'unknown' END AS category FROM n)
 SELECT event_id, category, category IN ('unavailable', 'timeout') AS retriable FROM c""",
)
def failures(spark, d):
    kind = S.classify_failure(F.col("message"))
    return over_tables(spark, d, _MESSAGES).select("event_id", kind.alias("category"), S.retriable(kind).alias("retriable"))


@query(
    "b23_b24_keys",
    """SELECT event_id, CASE WHEN event_id % 3 = 0 THEN '' ELSE concat(event_type, '/m', event_id % 3) END AS model_key,
       concat('e', event_id, '..', 'e', event_id + 2, '|', event_type, ',x') AS fingerprint FROM events""",
)
def keys(spark, d):
    e = spark.read.parquet(f"{d}/events.parquet")
    entry = lambda n: F.concat(F.lit("e"), (F.col("event_id") + n).cast("string"))
    model = F.when(F.col("event_id") % 3 != 0, F.concat(F.lit("m"), (F.col("event_id") % 3).cast("string")))
    return e.select("event_id", S.model_key(F.col("event_type"), model).alias("model_key"), S.span_fingerprint(entry(0), entry(2), F.array("event_type", F.lit("x"))).alias("fingerprint"))


@query("b27_citations", "SELECT event_id, concat('#', event_id, ',c', event_id, ':1') AS cited FROM events")
def citations(spark, d):
    e = spark.read.parquet(f"{d}/events.parquet")
    n = F.col("event_id").cast("string")
    answer = F.concat(F.lit("see [c"), n, F.lit(":1] and [lcm:summary #"), n, F.lit(" d0], again [c"), n, F.lit(":1]"))
    return e.select("event_id", F.array_join(S.cite_ids(answer), ",").alias("cited"))


@query(
    "b29_sizes_and_times",
    """SELECT event_id, CASE WHEN b >= 1048576 THEN concat(printf('%.1f', b / 1048576.0), 'M') WHEN b >= 1024 THEN concat(CAST(round(b / 1024.0) AS BIGINT), 'K') ELSE CAST(b AS VARCHAR) END AS bytes,
  CASE WHEN t < 1000 THEN concat(greatest(t, 0), 'ms') WHEN t < 60000 THEN concat(printf('%.1f', t / 1000.0), 's') WHEN CAST(round(t % 60000 / 1000.0) AS BIGINT) = 0 THEN concat(t // 60000, 'm') ELSE concat(t // 60000, 'm ', CAST(round(t % 60000 / 1000.0) AS BIGINT), 's') END AS took
 FROM (SELECT event_id, event_id * 777 AS b, event_id * 40 - 500 AS t FROM events) q""",
)
def sizes_and_times(spark, d):
    n = F.col("event_id")
    return spark.read.parquet(f"{d}/events.parquet").select("event_id", S.fmt_bytes(n * 777).alias("bytes"), S.fmt_duration(n * 40 - 500).alias("took"))


@query(
    "b29_b30_formats",
    """SELECT event_id, CASE WHEN event_id * 200 + 3 >= 1000000 THEN concat(printf('%.1f', (event_id * 200 + 3) / 1e6), 'M') WHEN event_id * 200 + 3 >= 1000 THEN concat(printf('%.1f', (event_id * 200 + 3) / 1e3), 'k') ELSE CAST(event_id * 200 + 3 AS VARCHAR) END AS tokens,
       CASE WHEN event_id = 0 THEN '(unknown)' ELSE strftime(make_timestamp(event_id * 60000 * 1000), '%Y-%m-%d') END AS day FROM events""",
)
def formats(spark, d):
    e = spark.read.parquet(f"{d}/events.parquet")
    return e.select("event_id", S.fmt_tokens(F.col("event_id") * 200 + 3).alias("tokens"), S.utc_day(F.col("event_id") * 60000).alias("day"))


@query("b31_search_terms", "SELECT conv_id, turn, concat('\"', replace(text, '\"', '\"\"'), '\"') AS phrase, concat('[tool:', role, ']') AS marker FROM conversations")
def terms(spark, d):
    c = spark.read.parquet(f"{d}/conversations.parquet")
    return c.select("conv_id", "turn", S.fts_phrase(F.col("text")).alias("phrase"), S.tool_marker(F.col("role")).alias("marker"))
