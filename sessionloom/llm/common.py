"""Helpers shared by the training-data operators."""

from __future__ import annotations

import os
import tempfile
import unicodedata
import uuid
from array import array
from collections.abc import Iterator
from functools import lru_cache, reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


def work_path(spark: SparkSession, name: str) -> str:
    """A new folder below ``spark.checkpoint.dir``, which all executors share.

    Only where that setting is empty in local mode, as in tests, is a temporary folder made for the session; on a cluster
    that is an error.
    """
    conf = spark.sparkContext.getConf()
    base = conf.get("spark.checkpoint.dir", None) or spark.conf.get("sessionloom.work.dir", None)
    if not base and not conf.get("spark.master", "").startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    if not base:
        base = "file://" + tempfile.mkdtemp(prefix="sessionloom-")
        spark.conf.set("sessionloom.work.dir", base)
    return f"{base.rstrip('/')}/sessionloom/{name}-{uuid.uuid4().hex}"


def stored(df: DataFrame, name: str, partition_by: str | None = None) -> DataFrame:
    """``df`` written as Parquet in the shared folder and read again: lineage ends there."""
    spark, path = df.sparkSession, work_path(df.sparkSession, name)
    writer = df.write.option("compression", "zstd")
    (writer.partitionBy(partition_by) if partition_by else writer).parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def hot_join(left: DataFrame, right: DataFrame, keys: list[str], count: str, spread_by: list[str], total: int | None = None) -> DataFrame:
    """``left`` with the columns of ``right``, which has one row for a key, by a left join that no frequent key clogs.

    ``count`` says how many rows of ``left`` (or more) have the key. Keys with over a thousandth of ``total``, the sum
    of counts, are fewer than a thousand, so their rows are broadcast; rows of ``left`` with such a key are
    shuffled by ``spread_by``, all others by key. Null keys join nothing.
    """
    if total is None:
        total = right.agg(F.sum(count)).first()[0] or 0
    values = [c for c in right.columns if c not in keys and c != count]
    hot = right.filter(F.col(count) * 1000 > total).select(*keys, *[F.col(c).alias(f"hot_{c}") for c in values], F.lit(True).alias("is_hot"))
    cold = right.filter(F.col(count) * 1000 <= total).select(*keys, *values, F.lit(0).alias("salt"))
    apart = F.coalesce("is_hot", F.lit(False)) | reduce(lambda a, b: a | b, [F.col(k).isNull() for k in keys])
    marked = left.join(F.broadcast(hot), keys, "left").withColumn("salt", F.when(apart, 1 + F.pmod(F.xxhash64(*spread_by), F.lit(4096)).cast("int")).otherwise(0))
    joined = marked.join(cold, [*keys, "salt"], "left")
    return joined.select(*left.columns, *[F.coalesce(f"hot_{c}", c).alias(c) for c in values])


def with_column(df: DataFrame, name: str, kind: str) -> T.StructType:
    """The schema of ``df`` and one more column."""
    return T.StructType([*df.schema.fields, T.StructField(name, T._parse_datatype_string(kind))])


def fresh(df: DataFrame, name: str) -> str:
    """A column name that ``df`` doesn't have."""
    while name.lower() in {c.lower() for c in df.columns}:
        name += "_"
    return name


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def slices(batches: Iterator[pa.RecordBatch], rows: int = 512) -> Iterator[dict[str, list]]:
    """Column lists of at most ``rows`` rows, so that a worker holds few Python strings at once."""
    for batch in batches:
        for at in range(0, batch.num_rows, rows):
            yield batch.slice(at, rows).to_pydict()


def arrow_schema(ddl: str) -> pa.Schema:
    """The Arrow schema of simple ``name type`` lists, as ``mapInArrow`` results need it."""
    kinds = {"long": pa.int64(), "int": pa.int32(), "string": pa.string(), "binary": pa.binary(), "double": pa.float64(), "boolean": pa.bool_()}
    return pa.schema([(n, kinds[k]) for n, k in (x.split() for x in ddl.split(","))])


class TextEncoder:
    """Token ids of whole texts by the ``tokenizers`` library, as little-endian blobs.

    This vocabulary lower-cases a normalised text, drops white space, and cuts the rest into runs of letters, single
    digits, runs of other signs and some endings after an apostrophe; no piece's ids depend on its neighbours. So
    the texts of a batch are cut by numpy, the library encodes each distinct piece once, and a text's ids
    are those of its pieces in turn. Texts for which cutting first isn't safe (special tokens' strings, characters
    beyond the first plane) are encoded as a whole. ``tests/llm`` holds this against encoding whole texts.
    """

    def __init__(self, path: str, most: int = 300_000):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer
        from tokenizers.pre_tokenizers import ByteLevel

        self.whole = Tokenizer.from_file(path)
        self.by_piece = Tokenizer(self.whole.model)  # the same model, without normaliser and pre-tokeniser
        self.by_piece.pre_tokenizer = ByteLevel(add_prefix_space=False, use_regex=False)
        self.dtype = "<u2" if self.whole.get_vocab_size() <= 1 << 16 else "<u4"
        self.known: dict[str, bytes] = {}
        self.most = most

    def end(self, token: int) -> bytes:
        return token.to_bytes(int(self.dtype[-1]), "little")

    def _learn(self, pieces: list[str]) -> None:
        kind = "H" if self.dtype == "<u2" else "I"
        if len(self.known) > self.most:
            self.known = {}
        new = [p for p in pieces if p not in self.known]
        for at in range(0, len(new), 4096):
            part = new[at : at + 4096]
            for piece, coded in zip(part, self.by_piece.encode_batch_fast(part, add_special_tokens=False), strict=True):
                self.known[piece] = array(kind, coded.ids).tobytes()

    def encode(self, texts: list[str | None]) -> list[bytes]:
        """A null text counts as empty."""
        ready, apart = [], {}
        for k, t in enumerate(texts):
            t = t or ""
            if "<|" in t or not t.isascii() and max(t) > "\uffff":
                apart[k], t = np.array(self.whole.encode(t, add_special_tokens=False).ids, self.dtype).tobytes(), ""
            elif not t.isascii():
                t = unicodedata.normalize("NFC", t).replace("\u03a3", "\u03c3")
            ready.append(t.lower())
        joined = "".join(ready)
        if not joined:
            return [apart.get(k, b"") for k in range(len(texts))]
        doc_at = np.concatenate([[0], np.cumsum([len(t) for t in ready])])
        starts, byte_at = cut(joined, doc_at)
        pieces = pa.StringArray.from_buffers(len(starts), pa.py_buffer(np.append(byte_at[starts], byte_at[-1]).astype(np.int32)), pa.py_buffer(joined.encode("utf-8", "surrogatepass"))).dictionary_encode()
        distinct = pieces.dictionary.to_pylist()
        spaces = np.array([SPACE[ord(p[0])] for p in distinct])
        self._learn([p for p, blank in zip(distinct, spaces, strict=True) if not blank])
        coded = [b"" if blank else self.known[p] for p, blank in zip(distinct, spaces, strict=True)]
        flat = np.frombuffer(b"".join(coded), self.dtype)
        lengths = np.array([len(c) for c in coded]) // int(self.dtype[-1])
        first = np.cumsum(lengths) - lengths
        order = pieces.indices.to_numpy()
        n = lengths[order]
        ends = np.concatenate([[0], np.cumsum(n)])
        ids = flat[np.repeat(first[order] - ends[:-1], n) + np.arange(ends[-1])].tobytes()
        doc_ends = ends[np.searchsorted(starts, doc_at)] * int(self.dtype[-1])
        return [apart[k] if k in apart else ids[a:b] for k, (a, b) in enumerate(zip(doc_ends[:-1].tolist(), doc_ends[1:].tolist(), strict=True))]


def _kinds() -> np.ndarray:
    """Of every character of the first plane: 0 white space, 1 letter, 2 number, 3 other."""
    names = {"L": 1, "N": 2}
    kinds = np.array([names.get(unicodedata.category(chr(c))[0], 3) for c in range(1 << 16)], np.uint8)
    kinds[[*range(9, 14), 0x20, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000]] = 0
    return kinds


KINDS = _kinds()
SPACE = KINDS == 0


def cut(text: str, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Where the pieces of ``text`` start (white space is a piece too) and each character's place in UTF-8.

    A piece also starts at each of ``bounds``. An apostrophe that starts a run of signs and is followed by
    s, t, m, d, re, ve or ll is a piece together with those letters.
    """
    points = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
    byte_at = np.concatenate([[0], np.cumsum(1 + (points >= 0x80) + (points >= 0x800))])
    kind = KINDS[points]
    start = np.empty(len(points), bool)
    start[0] = True
    np.not_equal(kind[1:], kind[:-1], out=start[1:])
    start |= kind == 2
    start[bounds[bounds < len(points)]] = True
    for p in np.flatnonzero((points == 39) & start).tolist():
        end = bounds[np.searchsorted(bounds, p, side="right")]
        after = text[p + 1 : min(p + 3, end)]
        n = 1 if after[:1] in ("s", "t", "m", "d") else 2 if after in ("re", "ve", "ll") else 0
        if n:
            start[p + 1] = False
            start[p + n + 1 : p + n + 2] = True
    return np.flatnonzero(start), byte_at


@lru_cache(maxsize=2)
def text_encoder(path: str) -> TextEncoder:
    """One for all tasks of a Python worker."""
    return TextEncoder(path)


def word_vocabulary() -> str:
    """Where the installed package keeps the word vocabulary; the default of the ``tokenizer`` parameters."""
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")
