"""Stores: an append-only log of delta folders over a compacted base, published by numbered manifests.

root/<tablespace>/
    MANIFEST-<generation>.json    what belongs to the store; the largest number is current
    base-<id>/  delta-<id>/       Parquet, sorted by key inside files; row-group statistics and bloom filters prune
    LOCK                          of the one writer: owner and the time until which it holds
    PIN-<id>                      of a reader: the generation that it reads

A commit writes its files first and then creates the next manifest, which fails if another commit made it; readers keep
the generation they opened, and vacuum spares it until they close. Each delta holds one row per key with its sequence
number, and the largest number wins, so an operation that is committed late doesn't undo a newer one. put, add and remove
take the next number of the store. Compaction drops removals, so they are remembered until then.

Levels: from AUTO_COMPACT deltas on they are merged into one; only where they hold a LEVEL_RATIO-th of the base's bytes is
the base rewritten. A commit's rows are so written again about LEVEL_RATIO times, not once for every commit.
"""

from __future__ import annotations

import json
import os
import re
import socket
import time
import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from keyloom.model import DELETED, KEY, SEQ, VALUE, AlreadyLocked, BadStore, KeyExists, ReadOnly
from keyloom.operators import info, lookup, merge, mutate
from keyloom.sources.files import Files

MODES = ("readwrite", "create", "existing", "readonly", "packed", "repair")
NAME = re.compile(r"[a-z0-9_.-]+", re.I)
#: Deltas from which a commit merges them, and the part of the base's bytes from which they go into it.
AUTO_COMPACT, LEVEL_RATIO = 32, 4
#: Seconds after its last commit that a writer's lock holds, and that a reader's pin does.
LOCK_SECONDS, PIN_SECONDS = 3600, 86_400
#: What to do on opening with deltas that can't be read: fail when they are, leave out broken files, or leave out the first
#: broken delta and all after it.
BROKEN = ("fail", "skip", "stop")


class Store:
    """A handle on one tablespace. Reads are DataFrames pinned to the generation of the handle."""

    def __init__(
        self,
        spark: SparkSession,
        root: str,
        mode: str = "readwrite",
        tablespace: str = "default",
        key: T.DataType | None = None,
        value: T.DataType | None = None,
        compression: str = "zstd",
        auto_compact: int = AUTO_COMPACT,
        broken: str = "fail",
        on_broken: Callable[[str], None] | None = None,
        lock_seconds: int = LOCK_SECONDS,
    ):
        if broken not in BROKEN:
            raise ValueError(f"broken is one of {BROKEN}")
        if mode not in MODES:
            raise ValueError(f"mode is one of {MODES}")
        if not NAME.fullmatch(tablespace):
            raise ValueError(f"bad tablespace name {tablespace!r}")
        self.spark, self.mode, self.tablespace = spark, mode, tablespace
        self.compression, self.auto_compact = compression, auto_compact
        self.stale: list[Column] = []
        self.on_commit: list[Callable[[int], None]] = []
        self.on_merge: list[Callable[[list[str], str], None]] = []  # parts that were merged, and what they became
        self.on_broken = on_broken or (lambda name: None)
        self.broken, self.lock_seconds = broken, lock_seconds
        self.locked, self.pin = False, None
        if mode == "packed":
            self.files = Files(spark, root)
            if not self.files.exists():
                raise BadStore(f"no pack at {root}")
            schema = spark.read.parquet(root).schema
            self.key, self.value = schema[KEY].dataType, schema[VALUE].dataType
            self.manifest = {"generation": 0, "base": root, "deltas": [], "next": 0}
            return
        self.files = Files(spark, f"{root.rstrip('/')}/{tablespace}")
        found = self._generations()
        if found and mode == "create":
            raise BadStore(f"{root} has a store already")
        if not found and mode in ("existing", "readonly", "repair"):
            raise BadStore(f"no store at {root}")
        if not self.read_only:
            self._lock()
        try:
            if found:
                self.manifest = json.loads(self.files.read(f"MANIFEST-{found[-1]:010d}.json"))
                self.key, self.value = (T._parse_datatype_json_value(self.manifest[k]) for k in (KEY, VALUE))
                if (key and key != self.key) or (value and value != self.value):
                    raise BadStore("the store has other types")
                if self.read_only:
                    self._pin()
                if broken != "fail" and mode != "repair":
                    self._leave_out_broken()
            else:
                self.key, self.value = key or T.BinaryType(), value or T.BinaryType()
                self.manifest = {"generation": 0, "base": None, "deltas": [], "next": 0}
                self._publish(base=None, deltas=[])
            if mode == "repair":
                self.repair()
        except BaseException:
            self.close()
            raise

    # --- housekeeping ---

    @property
    def read_only(self) -> bool:
        return self.mode in ("readonly", "packed")

    @property
    def generation(self) -> int:
        return self.manifest["generation"]

    @property
    def next_seq(self) -> int:
        """Over every sequence number in the store."""
        return self.manifest.get("next", 0)

    def _generations(self) -> list[int]:
        return sorted(int(m[1]) for x in self.files.list() if (m := re.fullmatch(r"MANIFEST-(\d+)\.json", x)))

    def _lock(self) -> None:
        """Takes the lock, or that of an owner whose time is over or whose process on this machine is gone."""
        self.owner = f"{socket.gethostname()}:{os.getpid()}:{uuid.uuid4().hex}"
        for _ in range(2):
            if self.files.create("LOCK", self._claim()):
                self.locked = True
                return
            try:
                held = json.loads(self.files.read("LOCK"))
            except Exception:  # just released, or half written
                held = {}
            host, _, pid = str(held.get("owner", "")).rpartition(":")[0].rpartition(":")
            dead = host == socket.gethostname() and pid.isdigit() and not os.path.exists(f"/proc/{pid}")
            if held and held.get("until", 0) >= time.time() and not dead:
                break
            self.files.delete("LOCK")
        raise AlreadyLocked(self.files.root)

    def _claim(self) -> str:
        return json.dumps({"owner": self.owner, "until": time.time() + self.lock_seconds})

    def _renew(self) -> None:
        """The lock for another while; an error if another writer has taken it meanwhile."""
        if json.loads(self.files.read("LOCK")).get("owner") != self.owner:
            raise AlreadyLocked("the lock went to another writer")
        self.files.delete("LOCK")
        if not self.files.create("LOCK", self._claim()):
            raise AlreadyLocked("the lock went to another writer")

    def _pin(self) -> None:
        """Tells vacuum what this reader reads; without effect where the store's folder can't be written."""
        name = f"PIN-{uuid.uuid4().hex}"
        try:
            self.files.create(name, json.dumps({"generation": self.generation, "until": time.time() + PIN_SECONDS}))
            self.pin = name
        except Exception:
            self.pin = None

    def close(self) -> None:
        if self.locked:
            self.files.delete("LOCK")
            self.locked = False
        if self.pin:
            self.files.delete(self.pin)
            self.pin = None

    def __enter__(self) -> Store:
        return self

    def __exit__(self, *_: object) -> None:
        self.close()

    def _writable(self) -> None:
        if self.read_only:
            raise ReadOnly(self.files.root)

    def _publish(self, base: str | None, deltas: list[str], next_seq: int | None = None) -> None:
        if self.locked:
            self._renew()
        manifest = {
            "next": self.next_seq if next_seq is None else next_seq,
            "generation": self.generation + 1,
            "base": base,
            "deltas": deltas,
            "key": self.key.jsonValue(),
            "value": self.value.jsonValue(),
            "committed_at": int(time.time()),
        }
        if not self.files.create(f"MANIFEST-{manifest['generation']:010d}.json", json.dumps(manifest)):
            raise AlreadyLocked("another writer committed")
        self.manifest = manifest
        for told in self.on_commit:
            told(self.generation)

    def _write(self, rows: DataFrame, kind: str, one_file: bool = False) -> str:
        name = f"{kind}-{uuid.uuid4().hex}"
        ranged = rows.coalesce(1) if one_file else rows.repartitionByRange(KEY)
        (
            ranged.sortWithinPartitions(KEY)
            .write.option("compression", self.compression)
            .option(f"parquet.bloom.filter.enabled#{KEY}", "true")
            .option("parquet.bloom.filter.adaptive.enabled", "true")  # else each file has a filter of the largest size
            .parquet(f"{self.files.root}/{name}")
        )
        return name

    # --- reading ---

    def _part(self, name: str, leave_out: bool = False) -> DataFrame:
        fields = [
            T.StructField(KEY, self.key),
            T.StructField(VALUE, self.value),
            T.StructField(SEQ, T.LongType()),
            T.StructField(DELETED, T.BooleanType()),
        ]
        read = self.spark.read.schema(T.StructType(fields))
        if leave_out or self.broken == "skip":
            read = read.option("ignoreCorruptFiles", "true")
        return read.parquet(name if self.mode == "packed" else f"{self.files.root}/{name}")

    def _run(self, name: str) -> DataFrame:
        part = self._part(name)
        return part.withColumns({SEQ: F.coalesce(SEQ, F.lit(-1)), DELETED: F.coalesce(DELETED, F.lit(False))})

    def _readable(self, name: str) -> bool:
        try:
            self.spark.read.option("ignoreCorruptFiles", "false").schema(self._part(name).schema).parquet(f"{self.files.root}/{name}").write.format("noop").mode("overwrite").save()
            return True
        except Exception:
            return False

    def _leave_out_broken(self) -> None:
        """What the handle reads by its policy; the next commit publishes that. Each broken part is told of."""
        deltas = []
        for name in self.manifest["deltas"]:
            if self._readable(name):
                deltas.append(name)
                continue
            self.on_broken(name)
            if self.broken == "stop":
                break
            if self.files.exists(name):
                deltas.append(name)
        self.manifest = self.manifest | {"deltas": deltas}

    def _empty(self) -> DataFrame:
        return self.spark.createDataFrame([], T.StructType([T.StructField(KEY, self.key), T.StructField(VALUE, self.value)]))

    def _parts(self) -> list[str]:
        """Newest first."""
        m = self.manifest
        return [*reversed(m["deltas"]), *([m["base"]] if m["base"] else [])]

    def _merged(self) -> DataFrame:
        """key, value, seq of what is there."""
        return merge.live(merge.merge_by_seq([self._run(x) for x in self._parts()]))

    def snapshot(self) -> DataFrame:
        """key, value of what is there. Without deltas this is the base's scan alone, and filters reach the files."""
        m = self.manifest
        if not m["deltas"]:
            return self._part(m["base"]).select(KEY, VALUE) if m["base"] else self._empty()
        return self._merged().select(KEY, VALUE)

    def get(self, key: object) -> object:
        return lookup.get_or_raise(self.snapshot(), key)

    def scan(self) -> DataFrame:
        return lookup.scan(self.snapshot())

    def iterate(self):
        """Rows in key order, fetched partition by partition."""
        return self.scan().toLocalIterator(prefetchPartitions=True)

    def count(self) -> int:
        return self.snapshot().count()

    def statistics(self) -> DataFrame:
        return info.statistics(self.snapshot())

    def levels(self) -> DataFrame:
        """part, bytes, newest first."""
        return self.spark.createDataFrame([(p, int(self.files.size(p))) for p in self._parts()], "part string, bytes long")

    def last_commit(self) -> int:
        """Unix seconds."""
        return self.manifest.get("committed_at", 0)

    # --- changing ---

    def apply(self, ops: DataFrame) -> Store:
        """ops: seq, key, value, deleted. One commit: all or nothing. Of a key's operations, in whatever commits, that of the
        largest seq holds; of equal ones that of the last commit."""
        self._writable()
        newest = merge.newest(ops.select(KEY, VALUE, SEQ, DELETED)).select(KEY, VALUE, SEQ, DELETED)
        name = self._write(newest, "delta")
        top = self._part(name).agg(F.max(SEQ).alias("top")).first()["top"]
        self._publish(self.manifest["base"], [*self.manifest["deltas"], name], max(self.next_seq, (-1 if top is None else top) + 1))
        if len(self.manifest["deltas"]) >= self.auto_compact:
            self._level()
        return self

    def _level(self) -> None:
        """Deltas to one delta, or into the base if they hold enough."""
        base, deltas = self.manifest["base"], self.manifest["deltas"]
        if LEVEL_RATIO * sum(map(self.files.size, deltas)) >= (self.files.size(base) if base else 0):
            self.compact()
            return
        name = self._write(merge.merge_by_seq([self._run(x) for x in reversed(deltas)]), "delta")
        self._publish(base, [name])
        self._told_of_merge(deltas, name)

    def _told_of_merge(self, parts: list[str], name: str) -> None:
        for told in self.on_merge:
            told(parts, name)

    def put(self, rows: DataFrame) -> Store:
        """Upserts key, value with the next sequence number. Of rows that repeat a key the largest value holds."""
        return self.apply(rows.groupBy(KEY).agg(F.max(VALUE).alias(VALUE)).select(F.lit(self.next_seq).cast("long").alias(SEQ), KEY, VALUE, F.lit(False).alias(DELETED)))

    def remove(self, keys: DataFrame) -> Store:
        none = F.lit(None).cast(self.value).alias(VALUE)
        return self.apply(keys.select(F.lit(self.next_seq).cast("long").alias(SEQ), KEY, none, F.lit(True).alias(DELETED)).distinct())

    def add(self, ops: DataFrame) -> Store:
        """Inserts; a key that is there is an error and nothing is written."""
        self._writable()
        if not ops.join(self.snapshot().select(KEY), KEY, "left_semi").isEmpty():
            raise KeyExists(self.files.root)
        return self.put(ops)

    def try_add(self, ops: DataFrame) -> tuple[int, int]:
        """(inserted, there already); the first operation of a key wins. ops: seq, key, value."""
        self._writable()
        before = self.snapshot()
        counts = mutate.try_add_counts(before, ops).first()
        if counts["n_added"]:
            self.put(mutate.try_add(before, ops))
        return int(counts["n_added"]), int(counts["n_existing"])

    def clear(self) -> Store:
        self._writable()
        self._publish(None, [])
        return self

    def register_stale(self, predicate: Column) -> None:
        """Rows that the predicate on key and value holds for leave at compaction."""
        self.stale.append(predicate)

    def unregister_stale(self) -> None:
        self.stale.clear()

    def compact(self, full: bool = False) -> Store:
        """One base, without tombstones and stale rows; full: a single file."""
        self._writable()
        parts = self._parts()
        if not parts:
            return self
        rows = self._merged().where(~merge.stale(self.stale)).select(KEY, VALUE, SEQ)
        name = self._write(rows, "base", one_file=full)
        self._publish(name, [])
        self._told_of_merge(parts, name)
        return self

    def vacuum(self, keep_generations: int = 1) -> list[str]:
        """Deletes folders and manifests that neither the last generations nor those of open readers name."""
        self._writable()
        there = self._generations()
        pins = {x: json.loads(self.files.read(x)) for x in self.files.list() if x.startswith("PIN-")}
        pins = {x: p["generation"] for x, p in pins.items() if p["until"] >= time.time()}
        last = sorted({*there[-keep_generations:], *(set(pins.values()) & set(there))})
        wanted = {f"MANIFEST-{g:010d}.json" for g in last} | {"LOCK", *pins}
        for g in last:
            m = json.loads(self.files.read(f"MANIFEST-{g:010d}.json"))
            wanted |= {*m["deltas"], m["base"]}
        gone = [x for x in self.files.list() if x not in wanted]
        for x in gone:
            self.files.delete(x)
        return gone

    def repair(self) -> dict[str, int]:
        """Rewrites what can be read, leaving out broken files; a part that is missing whole is left out. Rows by part.
        on_broken is told of each broken or missing part."""
        readable, report = [], {}
        for name in self._parts():
            if not self._readable(name):
                self.on_broken(name)
            if self.files.exists(name):
                part = self._part(name, leave_out=True)
                report[name] = part.count()
                readable.append(part.withColumns({DELETED: F.coalesce(DELETED, F.lit(False)), SEQ: F.coalesce(SEQ, F.lit(-1))}))
        if readable:
            rows = merge.live(merge.merge_by_seq(readable))
            self._publish(self._write(rows.select(KEY, VALUE, SEQ), "base"), [])
        return report

    # --- moving ---

    def pack(self, path: str) -> None:
        """One sorted Parquet file that opens with mode 'packed'."""
        self.snapshot().coalesce(1).sortWithinPartitions(KEY).write.option("compression", self.compression).parquet(path)

    def copy_to(self, other: Store) -> Store:
        """Upserts into the other store; what it has besides stays."""
        return other.put(self.snapshot())


def tablespaces(spark: SparkSession, root: str) -> list[str]:
    """Names of the stores under a root."""
    files = Files(spark, root)
    return [x for x in files.list() if any(y.startswith("MANIFEST-") for y in files.list(x))]
