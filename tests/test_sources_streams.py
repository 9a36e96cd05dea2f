"""Readers, written data and models, and fits over real streams."""

import json

import pytest
from pyspark.sql import functions as F

from tessel.operators.families import FAMILIES
from tessel.sources import readers
from tessel.streaming import fits

ROWS = [(1, "a", 1.5), (2, "b", None), (3, "c, \"d\"", -2.0)]


@pytest.fixture
def rows(spark):
    return spark.createDataFrame(ROWS, "k long, s string, x double")


@pytest.mark.parametrize("kind", ["parquet", "orc", "csv", "jsonl"])
def test_kinds_read_what_was_written(spark, rows, tmp_path, kind):
    path, schema = str(tmp_path / kind), "k long, s string, x double"
    {"parquet": rows.write.parquet, "orc": rows.write.orc, "csv": rows.write.option("header", True).option("escape", '"').csv, "jsonl": rows.write.json}[kind](path)
    more = {} if kind in ("parquet", "orc") else {"schema": schema}
    got = readers.open(spark, kind, path, **more) if kind != "csv" else spark.read.option("header", True).option("escape", '"').schema(schema).csv(path)
    assert sorted(map(tuple, got.select("k", "s", "x").collect())) == ROWS
    assert readers.open(spark, kind, path, columns=["k"]).columns == ["k"]


def test_other_kinds(spark, tmp_path):
    (tmp_path / "one.json").write_text(json.dumps([{"k": 1}, {"k": 2}], indent=1))
    assert {r.k for r in readers.open(spark, "json", str(tmp_path / "one.json")).collect()} == {1, 2}
    (tmp_path / "t.txt").write_text("a\nb\n")
    assert readers.open(spark, "text", str(tmp_path / "t.txt")).count() == 2 and readers.open(spark, "text", str(tmp_path / "t.txt"), whole=True).count() == 1
    assert readers.open(spark, "binary", str(tmp_path / "t.txt")).head().content == b"a\nb\n"
    with pytest.raises(ValueError, match="no reader"):
        readers.open(spark, "nothing")
    readers.reader("own")(lambda s, n: s.range(n))
    assert readers.open(spark, "own", 3).count() == 3 and "own" in readers.kinds()


def test_digest_ignores_order_and_sees_changes(spark, rows, tmp_path):
    digest = lambda df: tuple(readers.dataset_digest(df).head())
    assert digest(rows) == digest(rows.orderBy(F.desc("k")).repartition(3)) == digest(rows.select("x", "s", "k"))
    assert digest(rows) != digest(rows.withColumn("s", F.upper("s"))) and digest(rows) != digest(rows.unionByName(rows))
    readers.save_encoded(rows, str(tmp_path / "e"))
    assert sorted(map(tuple, readers.load_encoded(spark, str(tmp_path / "e")).collect())) == ROWS
    rows.limit(1).write.mode("append").parquet(str(tmp_path / "e" / "data"))
    with pytest.raises(ValueError, match="changed"):
        readers.load_encoded(spark, str(tmp_path / "e"))


def test_models_keep_versions(spark, tmp_path):
    path = str(tmp_path / "models")
    for v in (1, 2):
        readers.save_model(spark, path, "m", {"mu": v, "names": ["a"]}, v)
    assert readers.load_model(spark, path, "m")["mu"] == 2 and readers.load_model(spark, path, "m", 1) == {"mu": 1, "names": ["a"]}
    with pytest.raises(KeyError):
        readers.load_model(spark, path, "other")


def test_conform_rejects_what_it_cant_type(spark):
    rows = spark.createDataFrame([("1", "yes", "a"), ("2.0", "0", "b")], "n string, b string, c string")
    got = readers.conform(rows, {"n": "count", "b": "boolean", "c": ("categorical", ["a", "b"])}).collect()
    assert [tuple(r) for r in got] == [(1, True, "a"), (2, False, "b")]
    with pytest.raises(Exception, match="not a"):
        readers.conform(rows, {"c": ("categorical", ["a"])}).collect()


def run(spark, source, update, checkpoint):
    q = spark.readStream.schema("k long, x double").option("maxFilesPerTrigger", 1).parquet(source).writeStream.foreachBatch(update).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    q.awaitTermination()
    assert q.exception() is None


def test_streaming_fit_goes_on_after_a_restart(spark, tmp_path):
    source, state = str(tmp_path / "in"), str(tmp_path / "state")
    batches = [[1.0, 2.0, 3.0], [5.0, 7.0], [0.0, 10.0, 20.0, 2.0]]
    new = lambda: fits.StreamingFit(FAMILIES["gaussian"], "x", fits.constant(0.5), spark, state)
    for i, values in enumerate(batches[:2]):
        spark.createDataFrame([(k, v) for k, v in enumerate(values)], "k long, x double").coalesce(1).write.mode("append").parquet(source)
        run(spark, source, new().update, str(tmp_path / "c"))
    spark.createDataFrame([(k, v) for k, v in enumerate(batches[2])], "k long, x double").coalesce(1).write.mode("append").parquet(source)
    run(spark, source, new().update, str(tmp_path / "c"))
    want = None
    for values in batches:
        s = (len(values), sum(values), sum(v * v for v in values))
        want = s if want is None else tuple(0.5 * a + 0.5 * b for a, b in zip(want, s, strict=True))
    fit = new()
    assert fit.steps == 3 and [fit.state[k] for k in ("n", "s1", "s2")] == pytest.approx(list(want))
    # A batch that comes again after a failure changes nothing.
    fit.update(spark.createDataFrame([(1, 99.0)], "k long, x double"), fit.last)
    assert [new().state[k] for k in ("n", "s1", "s2")] == pytest.approx(list(want))
    assert fit.params(spark)["mu"] == pytest.approx(want[1] / want[0])


def test_windows_drop_late_rows_of_a_stream(spark, tmp_path):
    source, out = str(tmp_path / "in"), str(tmp_path / "out")
    schema = "ts timestamp, key string, value double"

    def put(rows):
        spark.createDataFrame(rows, "ts string, key string, value double").withColumn("ts", F.col("ts").cast("timestamp")).coalesce(1).write.mode("append").parquet(source)

    def go():
        stream = fits.windowed_counts(spark.readStream.schema(schema).parquet(source), "ts", "key", "value", "1 hour", "10 minutes")
        q = stream.writeStream.format("parquet").option("path", out).option("checkpointLocation", str(tmp_path / "c")).outputMode("append").trigger(availableNow=True).start()
        q.awaitTermination()

    put([("2024-01-01 00:05:00", "a", 1.0), ("2024-01-01 00:50:00", "a", 2.0), ("2024-01-01 03:00:00", "b", 5.0)])
    go()
    put([("2024-01-01 00:10:00", "a", 100.0), ("2024-01-01 05:00:00", "a", 7.0)])
    go()
    put([("2024-01-01 09:00:00", "a", 0.0)])
    go()
    got = {(str(r.start), r.key): (r.n, r.total) for r in spark.read.parquet(out).collect()}
    assert got[("2024-01-01 00:00:00", "a")] == (2, 3.0) and got[("2024-01-01 03:00:00", "b")] == (1, 5.0) and got[("2024-01-01 05:00:00", "a")] == (1, 7.0)


def test_chunks_replace_themselves_and_drift_is_noticed(spark):
    fit = fits.IncrementalFit(FAMILIES["gaussian"], "x")
    chunk = lambda *v: spark.createDataFrame([(float(x),) for x in v], "x double")
    fit.update(chunk(1, 2), 0)
    fit.update(chunk(100), 1)
    fit.update(chunk(3, 4), 1)
    assert fit.params(spark)["mu"] == pytest.approx(2.5)
    reference = spark.range(1000).select((F.col("id") % 100).cast("double").alias("x"))
    monitor = fits.DriftMonitor(reference, "x")
    monitor.update(reference, 0)
    monitor.update(reference.select((F.col("x") + 60).alias("x")), 1)
    assert [b for b, _ in monitor.alarms] == [1]
    with pytest.raises(ValueError, match="rate"):
        fits.constant(0.0)


def test_tables_are_removed_by_scopes_loops_streams_and_at_the_end(spark, tmp_path):
    import os
    import subprocess
    import sys

    from tessel.operators import kendall, rankings
    from tessel.sources import shared

    base = shared.shared_dir(spark).rsplit("/", 1)[0]
    folders = lambda: set(os.listdir(base.removeprefix("file:"))) if os.path.isdir(base.removeprefix("file:")) else set()
    rows = spark.createDataFrame([(1.0, 2.0), (2.0, 1.0), (3.0, 3.0)], "x double, y double")
    before = folders()
    kendall.counts(rows, "x", "y").collect()
    with shared.scope():
        shared.written(rows)
    monitor = fits.DriftMonitor(rows, "x")
    for k in range(20):
        monitor.update(rows, k)
    assert folders() == before
    wins = spark.createDataFrame([("a", "b", 3), ("b", "a", 1), ("b", "c", 2), ("c", "a", 1)], "a string, b string, n long")
    rankings.bradley_terry(wins, 6).collect()
    assert len(folders() - before) == 2  # the meetings and the last worths
    state = str(tmp_path / "state")
    fit = fits.IncrementalFit(FAMILIES["gaussian"], "x", spark, state)
    for k in range(4):
        fit.update(rows, k % 2)
    again = fits.IncrementalFit(FAMILIES["gaussian"], "x", spark, state)
    assert again.chunks == fit.chunks and len([n for n in os.listdir(state) if not n.startswith(".")]) == 1
    # A driver that stops its session first leaves nothing either.
    code = f"""
from pyspark.sql import SparkSession
spark = SparkSession.builder.master("local[1]").config("spark.ui.enabled", "false").config("spark.checkpoint.dir", "{tmp_path}/own").getOrCreate()
from tessel.sources.shared import written
written(spark.range(3)).count()
import os
assert any(n.startswith("tessel-") for n in os.listdir("{tmp_path}/own"))
spark.stop()
"""
    subprocess.run([sys.executable, "-c", code], check=True, capture_output=True, timeout=300, cwd=os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
    assert not [n for n in os.listdir(tmp_path / "own") if n.startswith("tessel-")]
