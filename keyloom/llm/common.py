"""Shared helpers of the llm operators: words, batches, shared storage."""

from __future__ import annotations

import ctypes
import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from keyloom.sources.files import Files
from keyloom.sources.shared import materialise, shared_dir

__all__ = [
    "as_binary", "blocks", "delete_stored", "map_batches", "materialise", "read_table", "shared_dir", "stored", "text_rows", "words_of"
]

#: Bytes of text that one block of vectorised work holds; a longer text makes a block of its own.
BLOCK_BYTES = 1 << 19

#: Bytes of rows that come to a Python worker at once, and the setting that says so; a longer row comes alone.
BATCH_BYTES = 4 << 20
BATCH_SETTING = "spark.sql.execution.arrow.maxBytesPerBatch"

#: Maps A-Z to a-z and every byte that no word holds to a space. Words are runs of 0-9, a-z and non-ASCII characters.
WORD_TABLE = bytes(
    c + 32 if 65 <= c <= 90 else c if 48 <= c <= 57 or 97 <= c <= 122 or c >= 128 else 32 for c in range(256)
)


def words_of(text: bytes | None) -> list[bytes]:
    """The lower-cased words of a UTF-8 text; none of a null."""
    return text.translate(WORD_TABLE).split() if text else []


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def stored(df: DataFrame) -> DataFrame:
    """df written as Parquet to the shared folder and read again: its lineage is cut, and readers get only the columns that
    they ask for."""
    path = f"{shared_dir(df.sparkSession)}/table-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def delete_stored(df: DataFrame) -> None:
    """Removes the files of a stored table that nothing reads any more."""
    spark = df.sparkSession
    for folder in {f.rsplit("/", 1)[0] for f in df.inputFiles()}:
        Files(spark, folder).delete("")


def as_binary(column: str) -> F.Column:
    return F.col(column).cast("binary").alias(column)


def text_rows(df: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """key as long and text as UTF-8 bytes; other columns are dropped, so clashing names do no harm."""
    return df.select(F.col(key).cast("long").alias(key), as_binary(text))


def map_batches(df: DataFrame, run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], schema) -> DataFrame:
    """df.mapInArrow in bounded memory: batches are bounded by bytes, as texts may be long (the session's bound is lowered
    if it is higher), and a worker, which Spark keeps for later tasks, gives back what a task freed."""
    session = df.sparkSession.conf
    if int(session.get(BATCH_SETTING).removesuffix("b")) > BATCH_BYTES:
        session.set(BATCH_SETTING, str(BATCH_BYTES))

    def bounded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from run(batches)
        pa.default_memory_pool().release_unused()
        if trim := getattr(ctypes.CDLL(None), "malloc_trim", None):  # glibc
            trim(0)

    return df.mapInArrow(bounded, schema)


def blocks(batches: Iterator[pa.RecordBatch], limit: int = BLOCK_BYTES) -> Iterator[tuple[list, list]]:
    """Regroup (key, bytes) batches to lists of keys and texts of about limit bytes."""
    keys: list = []
    texts: list = []
    size = 0
    for batch in batches:
        for key, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            keys.append(key)
            texts.append(text)
            size += len(text) + 64 if text else 64
            if size >= limit:
                yield keys, texts
                keys, texts, size = [], [], 0
    if keys:
        yield keys, texts
