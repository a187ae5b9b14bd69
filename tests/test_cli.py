import pytest

from keyloom.__main__ import run
from keyloom.functions import msgpack
from keyloom.sources.store import Store


def test_commands(spark, tmp_path):
    root = str(tmp_path / "s")
    rows = spark.createDataFrame([(b"a", b"1"), (b"b", b"22")], "key binary, value binary")
    with Store(spark, root) as s:
        s.put(rows)
        s.put(rows.limit(1))
    assert run(spark, ["info", root])[0]["n"] == 2
    run(spark, ["compact", root, "--full"])
    assert len(run(spark, ["info", root])[0]["parts"]) == 1 and run(spark, ["vacuum", root])[0]["removed"]
    run(spark, ["pack", root, str(tmp_path / "p")])
    assert Store(spark, str(tmp_path / "p"), "packed").count() == 2
    run(spark, ["dump", root, str(tmp_path / "d")])
    assert run(spark, ["restore", str(tmp_path / "t"), str(tmp_path / "d")])[0]["added"] == 2
    with pytest.raises(SystemExit):
        run(spark, ["pack", root])


def test_msgpack():
    values = [None, True, False, 0, 127, 128, 255, 256, 65536, 2**32, 2**64 - 1, -1, -32, -33, -129, -(2**15) - 1, -(2**31) - 1, -(2**63), 1.5, "", "é" * 20, "x" * 300, "y" * 70000, [], [1] * 20, list(range(70000)), {}, {"a": {"b": [None]}}, {str(i): i for i in range(40)}]
    for v in values:
        assert msgpack.unpacked(msgpack.packed(v)) == v
    assert msgpack.packed({"compact": True, "schema": 0}) == bytes.fromhex("82a7636f6d70616374c3a6736368656d6100")
    for bad in (b"", b"\xc1", b"\xa5ab", b"\x01\x01"):
        with pytest.raises(ValueError):
            msgpack.unpacked(bad)
