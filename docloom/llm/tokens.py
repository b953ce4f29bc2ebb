"""Token ids of whole texts under a public byte-level BPE vocabulary.

The rank file is read once on the driver (under 1 MB, a fixed file) and broadcast, so that executors
need no copy of it. Each Python worker builds one encoder and keeps it. Long texts are cut where the
vocabulary's own splitting pattern is certain to end a piece, so the ids are those of the whole text
while no regex call sees more than a bounded stretch.

Defined cases: a null or empty text gives an empty list; text that looks like a special token is plain
text; repeated rows are encoded each for itself; further columns are ignored.
"""

from __future__ import annotations

import base64
import os

import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docloom.llm.arrow import batch, flag, map_batches
from docloom.session import spread, table

# Fixed value: the splitting pattern that belongs to the 50k byte-level rank file.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
DEFAULT_FOLDER = "/opt/tokenizers"
LONG = 50_000
#: A blank after a letter, digit or mark always begins a new piece, whatever surrounds it.
SAFE = regex.compile(r"(?<=[\p{L}\p{N}\p{P}\p{S}\p{M}])(?=[ \n])")

_encoders: dict[int, object] = {}


def content_of(spark: SparkSession, path: str) -> bytes:
    """A small file's bytes, from the driver's disk or, by the session's file systems, from any shared storage."""
    if os.path.exists(path):
        with open(path, "rb") as file:
            return file.read()
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    stream = where.getFileSystem(spark._jsc.hadoopConfiguration()).open(where)
    try:
        return bytes(spark._jvm.org.apache.commons.io.IOUtils.toByteArray(stream))
    finally:
        stream.close()


def encoder(content: bytes):
    """The encoder of a rank file's content, built once per process."""
    import tiktoken

    key = hash(content)
    if key not in _encoders:
        ranks = {base64.b64decode(token): int(rank) for token, rank in (line.split() for line in content.splitlines() if line.strip())}
        _encoders[key] = tiktoken.Encoding("local_ranks", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})
    return _encoders[key]


def stretches(text: str, size: int = LONG) -> list[str]:
    """Cut a long text at safe boundaries only; a stretch without one stays whole."""
    if len(text) <= size:
        return [text]
    parts, start = [], 0
    while len(text) - start > size:
        found = SAFE.search(text, start + size)
        if not found:
            break
        parts.append(text[start : found.start()])
        start = found.start()
    return [*parts, text[start:]]


def encode(text: str | None, enc) -> list[int]:
    if not text:
        return []
    if len(text) <= LONG:
        return enc.encode_ordinary(text)
    return [i for part in stretches(text) for i in enc.encode_ordinary(part)]


def decode(ids: list[int], enc) -> str:
    """Join the raw bytes of all ids before reading them as UTF-8: one character may span several ids."""
    return b"".join(enc.decode_single_token_bytes(i) for i in ids).decode("utf-8")


def with_ids(df: DataFrame, key: str, text: str, path: str) -> DataFrame:
    """``key`` and ``ids ARRAY<INT>`` of every row of ``df``."""
    ranks = df.sparkSession.sparkContext.broadcast(content_of(df.sparkSession, path))
    schema = pa.schema([(key, pa.int64()), ("ids", pa.list_(pa.int32()))])

    def run(rows: pa.RecordBatch):
        enc = encoder(ranks.value)
        yield batch(schema, rows.column(0), [encode(t, enc) for t in rows.column(1).to_pylist()])

    return map_batches(spread(df.select(F.col(key).cast("long"), F.col(text).cast("string"))), run, f"`{key}` long, ids array<int>")


def round_trip(df: DataFrame, key: str, text: str, path: str) -> DataFrame:
    """Per row: number of ids, and whether raw-byte decoding gives back the text."""
    ranks = df.sparkSession.sparkContext.broadcast(content_of(df.sparkSession, path))
    schema = pa.schema([(key, pa.int64()), ("n_ids", pa.int64()), ("same", pa.bool_())])

    def run(rows: pa.RecordBatch):
        enc = encoder(ranks.value)
        texts = rows.column(1).to_pylist()
        ids = [encode(t, enc) for t in texts]
        yield batch(schema, rows.column(0), [len(i) for i in ids], [decode(i, enc) == (t or "") for i, t in zip(ids, texts, strict=True)])

    return map_batches(spread(df.select(F.col(key).cast("long"), F.col(text).cast("string"))), run, f"`{key}` long, n_ids long, same boolean")


def vocabulary(spark, name: str = "byte_bpe_50k.tiktoken") -> str:
    return os.path.join(flag(spark, "tokenizers", DEFAULT_FOLDER), name)


def p7_ids(spark, sf_dir: str) -> DataFrame:
    return with_ids(table(spark, sf_dir, "documents"), "doc_id", "text", vocabulary(spark))


def p7_round_trip(spark, sf_dir: str) -> DataFrame:
    """Documents and ids by language and outcome of the round trip; one that is not the same is an error."""
    docs = table(spark, sf_dir, "documents")
    checked = round_trip(docs, "doc_id", "text", vocabulary(spark))
    return checked.groupBy("same").agg(F.count("*").alias("docs"), F.sum("n_ids").alias("ids"))



QUERIES = {"p7_ids": p7_ids, "p7_round_trip": p7_round_trip}
SQL: dict[str, str] = {}
