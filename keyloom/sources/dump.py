"""Flat dump files: the magic, then for each row the lengths of key and value and their bytes, in key order.

A Python data source, `kvdump`. Writing goes through one sorted partition, as the format is one ordered stream; the bytes
go out as they come, never all at once. Reading streams a file record by record; several files are read in parallel.
"""

from __future__ import annotations

import os
import struct
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceWriter, InputPartition, WriterCommitMessage

from keyloom.model import KEY, SEQ, VALUE

# Fixed values of the format.
MAGIC = b"PDBD"
LENGTHS = struct.Struct("<ii")
SCHEMA = "seq long, key binary, value binary"


def _open(path: str, mode: str):
    from pyarrow import fs

    system, name = fs.FileSystem.from_uri(path if "://" in path or path.startswith("file:") else os.path.abspath(path))
    if mode == "r":
        return system.open_input_stream(name)
    system.create_dir(os.path.dirname(name), recursive=True)
    return system.open_output_stream(name)


class KvDump(DataSource):
    @classmethod
    def name(cls) -> str:
        return "kvdump"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> DataSourceReader:
        return _Reader(self.options)

    def writer(self, schema, overwrite: bool) -> DataSourceWriter:
        return _Writer(self.options, schema)


class _Reader(DataSourceReader):
    def __init__(self, options: dict):
        self.paths = options["path"].split(",")

    def partitions(self) -> list[InputPartition]:
        return [InputPartition(p) for p in self.paths]

    def read(self, partition: InputPartition) -> Iterator[pa.RecordBatch]:
        with _open(partition.value, "r") as f:
            if f.read(4) != MAGIC:
                raise ValueError(f"{partition.value} is no dump")
            seq, rows, size = 0, ([], [], []), 0
            while head := f.read(LENGTHS.size):
                k, v = LENGTHS.unpack(head)
                for column, x in zip(rows, (seq, f.read(k), f.read(v)), strict=True):
                    column.append(x)
                seq, size = seq + 1, size + k + v
                if size > 4 << 20:
                    yield _batch(rows)
                    rows, size = ([], [], []), 0
            yield _batch(rows)


def _batch(rows: tuple) -> pa.RecordBatch:
    kinds = (pa.int64(), pa.binary(), pa.binary())
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(rows, kinds, strict=True)], names=["seq", "key", "value"])


class _Writer(DataSourceWriter):
    def __init__(self, options: dict, schema):
        self.path = options["path"]
        self.places = [schema.fieldNames().index(n) for n in (KEY, VALUE)]

    def write(self, rows: Iterator) -> WriterCommitMessage:
        with _open(self.path, "w") as f:
            f.write(MAGIC)
            for row in rows:
                key, value = (bytes(row[i]) for i in self.places)
                f.write(LENGTHS.pack(len(key), len(value)))
                f.write(key)
                f.write(value)
        return WriterCommitMessage()


def dump(snapshot: DataFrame, path: str) -> None:
    """Writes key, value (binary), in key order, to one file."""
    snapshot.sparkSession.dataSource.register(KvDump)
    ordered = snapshot.select(KEY, VALUE).coalesce(1).sortWithinPartitions(KEY)
    ordered.write.format("kvdump").mode("append").option("path", path).save()


def restore(spark: SparkSession, path: str) -> DataFrame:
    """seq, key, value of a dump; the first row of a repeated key is to win, as try_add does."""
    spark.dataSource.register(KvDump)
    return spark.read.format("kvdump").option("path", path).load().select(SEQ, KEY, VALUE)
