from pyspark.sql import functions as F
from pyspark.sql import types as T

from keyloom.sources.store import Store
from keyloom.streaming import upserts

SCHEMA = "seq long, key string, value long, deleted boolean"


def feed(spark, path, *batches):
    for b in batches:
        spark.createDataFrame(b, SCHEMA).coalesce(1).write.mode("append").parquet(path)
    return spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).parquet(path)


BATCHES = [[(1, "a", 1, False), (2, "b", 2, False)], [(3, "a", None, True), (4, "b", 5, False), (5, "c", 7, False)]]


def test_into_store(spark, tmp_path):
    ops = feed(spark, str(tmp_path / "in"), *BATCHES)
    with Store(spark, str(tmp_path / "s"), key=T.StringType(), value=T.LongType()) as store:
        upserts.into_store(ops, store, str(tmp_path / "cp")).awaitTermination()
        assert {r.key: r.value for r in store.snapshot().collect()} == {"b": 5, "c": 7}


def test_running_snapshot(spark, tmp_path):
    ops = feed(spark, str(tmp_path / "in"), *BATCHES)
    q = upserts.running_snapshot(ops).writeStream.format("memory").queryName("snap").outputMode("complete").option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
    q.awaitTermination()
    assert {r.key: r.value for r in spark.table("snap").where(~F.col("deleted")).collect()} == {"b": 5, "c": 7}


def test_read_modify_write(spark, tmp_path):
    ops = feed(spark, str(tmp_path / "in"), *BATCHES)
    q = upserts.read_modify_write(ops, lambda old, row: (old or 0) + 1).writeStream.format("memory").queryName("rmw").outputMode("append").option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
    q.awaitTermination()
    assert sorted((r.seq, r.key, r.reply) for r in spark.table("rmw").collect()) == [(1, "a", 1), (2, "b", 1), (3, "a", 2), (4, "b", 2), (5, "c", 1)]


def test_first_put_and_change_events(spark, tmp_path):
    schema = "seq long, key string, value long, at timestamp"
    for rows in ([(1, "a", 1), (2, "b", 2)], [(3, "a", 9), (4, "c", 3)]):
        df = spark.createDataFrame(rows, "seq long, key string, value long").withColumn("at", F.timestamp_seconds("seq"))
        df.coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    ops = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    q = upserts.first_put(ops, "1 hour").writeStream.format("memory").queryName("firsts").outputMode("append").option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
    q.awaitTermination()
    assert sorted(r.key for r in spark.table("firsts").collect()) == ["a", "b", "c"]
    told = []
    with Store(spark, str(tmp_path / "s"), key=T.StringType(), value=T.LongType()) as store:
        store.on_commit.append(told.append)
        store.put(spark.createDataFrame([("a", 1)], "key string, value long"))
        store.compact()
    assert told == [2, 3]
