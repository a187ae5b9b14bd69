import pytest

from pyspark.sql import functions as F
from pyspark.sql import types as T

from keyloom.model import AlreadyLocked, BadStore, KeyExists, KeyMissing, ReadOnly
from keyloom.sources import dump
from keyloom.sources.store import Store, tablespaces

KINDS = {"key": T.StringType(), "value": T.StringType()}


def rows(spark, **pairs):
    return spark.createDataFrame(list(pairs.items()), "key string, value string")


def content(store):
    return {r.key: r.value for r in store.snapshot().collect()}


def test_life_of_a_store(spark, tmp_path):
    root = str(tmp_path / "s")
    with Store(spark, root, "create", **KINDS) as s:
        assert content(s) == {}
        s.put(rows(spark, a="1", b="2", c="3", d="4"))
        s.apply(spark.createDataFrame([(1, "b", "5", False), (2, "e", "6", False), (3, "d", None, True)], "seq long, key string, value string, deleted boolean"))
        assert content(s) == {"a": "1", "b": "5", "c": "3", "e": "6"}
        old = Store(spark, root, "readonly")
        with pytest.raises(AlreadyLocked):
            Store(spark, root)
        with pytest.raises(ReadOnly):
            old.put(rows(spark, z="1"))
        s.remove(rows(spark, a="").select("key"))
        assert content(old) == {"a": "1", "b": "5", "c": "3", "e": "6"} and content(s) == {"b": "5", "c": "3", "e": "6"}
        with pytest.raises(KeyMissing):
            s.get("a")
        assert s.get("b") == "5"
        with pytest.raises(KeyExists):
            s.add(rows(spark, b="x"))
        ops = spark.createDataFrame([(1, "b", "x"), (2, "q", "y"), (3, "q", "z")], "seq long, key string, value string")
        assert s.try_add(ops) == (1, 2) and s.get("q") == "y"
        s.register_stale(F.col("value") == "3")
        s.compact()
        assert content(s) == {"b": "5", "e": "6", "q": "y"} and s.levels().count() == 1
        s.vacuum()
        assert content(old) == {"a": "1", "b": "5", "c": "3", "e": "6"}  # an open reader's files stay
        old.close()
        assert len(s.vacuum()) == 3 and content(s) == {"b": "5", "e": "6", "q": "y"}
        assert [r.key for r in s.iterate()] == ["b", "e", "q"]
        s.compact(full=True)
        assert len(s.snapshot().inputFiles()) == 1
        assert s.statistics().first().n == 3
    with pytest.raises(BadStore):
        Store(spark, root, "create")
    with pytest.raises(BadStore):
        Store(spark, str(tmp_path / "none"), "existing")
    with pytest.raises(BadStore):
        Store(spark, root, key=T.LongType())
    with Store(spark, root, "existing") as s:
        assert content(s) == {"b": "5", "e": "6", "q": "y"}
        assert content(s.clear()) == {}


def test_auto_compaction_tablespaces_pack_and_copy(spark, tmp_path):
    root = str(tmp_path / "s")
    with Store(spark, root, tablespace="one", auto_compact=3, **KINDS) as a, Store(spark, root, tablespace="two", **KINDS) as b:
        for i in range(4):
            a.put(rows(spark, x=str(i), **{f"k{i}": "v"}))
        assert len(a.manifest["deltas"]) == 1 and content(a)["x"] == "3"
        b.put(rows(spark, x="b", y="b"))
        assert tablespaces(spark, root) == ["one", "two"]
        assert content(a.copy_to(b))["x"] == "3" and content(b)["y"] == "b"
        b.pack(str(tmp_path / "pack"))
    packed = Store(spark, str(tmp_path / "pack"), "packed")
    assert content(packed)["y"] == "b"
    with pytest.raises(ReadOnly):
        packed.clear()
    with pytest.raises(ValueError):
        Store(spark, root, tablespace="a/b")


def test_repair(spark, tmp_path):
    root = str(tmp_path / "s")
    with Store(spark, root, **KINDS) as s:
        s.put(rows(spark, a="1", b="2"))
        s.put(rows(spark, b="3"))
        broken = next((tmp_path / "s" / "default" / s.manifest["deltas"][1]).glob("part-*.parquet"))
    broken.write_bytes(b"garbage")
    for crc in broken.parent.glob(".*.crc"):
        crc.unlink()
    with Store(spark, root, "repair") as s:
        assert content(s) == {"a": "1", "b": "2"}


def test_dump_and_restore(spark, tmp_path):
    data = [(bytes([i % 256, i // 256]), b"v" * (i % 7)) for i in range(600)] + [(b"", b"")]
    df = spark.createDataFrame(data, "key binary, value binary").repartition(5)
    path = str(tmp_path / "out" / "x.dump")
    dump.dump(df, path)
    raw = open(path, "rb").read()
    assert raw[:4] == b"PDBD" and raw[4:12] == b"\0" * 8
    got = sorted((r.seq, bytes(r.key), bytes(r.value)) for r in dump.restore(spark, path).collect())
    assert [(k, v) for _, k, v in got] == sorted(data)


def log(spark, *ops):
    return spark.createDataFrame(list(ops), "seq long, key string, value string, deleted boolean")


def test_late_operations_do_not_win(spark, tmp_path):
    with Store(spark, str(tmp_path / "s"), **KINDS) as s:
        s.apply(log(spark, (10, "a", "100", False), (11, "b", None, True), (12, "c", "x", False)))
        s.apply(log(spark, (5, "a", "50", False), (6, "b", "late", False), (12, "c", "y", False)))
        assert content(s) == {"a": "100", "c": "y"}
        s.compact()
        s.apply(log(spark, (7, "a", "70", False)))
        assert content(s) == {"a": "100", "c": "y"} and s.next_seq == 13
        s.put(rows(spark, a="new"))
        assert content(s)["a"] == "new" and s.next_seq == 14


def test_levels_and_merge_events(spark, tmp_path):
    merged = []
    with Store(spark, str(tmp_path / "s"), auto_compact=3, **KINDS) as s:
        s.on_merge.append(lambda parts, name: merged.append((len(parts), name.split("-")[0])))
        s.put(spark.range(200_000).selectExpr("cast(id as string) as key", "uuid() as value"))
        s.compact()
        base = s.manifest["base"]
        for i in range(4):
            s.put(rows(spark, **{f"k{i}": "v", "x": str(i)}))
        s.remove(rows(spark, k0="").select("key"))
        assert s.manifest["base"] == base and merged[0] == (1, "base") and (3, "delta") in merged
        assert s.count() == 200_004 and s.get("x") == "3"


def test_broken_deltas(spark, tmp_path):
    root = str(tmp_path / "s")
    with Store(spark, root, **KINDS) as s:
        for i in range(3):
            s.put(rows(spark, **{f"k{i}": "v"}))
        names = s.manifest["deltas"]
        broken = next((tmp_path / "s" / "default" / names[1]).glob("part-*.parquet"))
    broken.write_bytes(b"garbage")
    for crc in broken.parent.glob(".*.crc"):
        crc.unlink()
    told = []
    assert content(Store(spark, root, "readonly", broken="skip", on_broken=told.append)) == {"k0": "v", "k2": "v"}
    assert content(Store(spark, root, "readonly", broken="stop", on_broken=told.append)) == {"k0": "v"}
    with pytest.raises(Exception):
        content(Store(spark, root, "readonly"))
    assert told == [names[1]] * 2
    with Store(spark, root, "repair", on_broken=told.append) as s:
        assert content(s) == {"k0": "v", "k2": "v"} and len(told) == 3


def test_lock_ends_with_its_owner(spark, tmp_path):
    import json

    root = tmp_path / "s"
    s = Store(spark, str(root), **KINDS)
    with pytest.raises(AlreadyLocked):
        Store(spark, str(root))
    lock = root / "default" / "LOCK"
    for crc in lock.parent.glob(".LOCK*.crc"):
        crc.unlink()
    lock.write_text(json.dumps(json.loads(lock.read_text()) | {"until": 0}))  # its time is over
    with Store(spark, str(root)) as other:
        with pytest.raises(AlreadyLocked):
            s.put(rows(spark, a="1"))
        other.put(rows(spark, a="2"))
    s.locked = False
    assert not lock.exists()
