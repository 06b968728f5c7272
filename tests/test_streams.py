"""Stateful streams against their batch counterparts."""

from datetime import datetime, timedelta, timezone

import pytest

from wayfold.streaming import sessions

PROVIDER = "spark.sql.streaming.stateStore.providerClass"


@pytest.fixture()
def rocks(spark):
    spark.conf.set(PROVIDER, "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    yield spark
    spark.conf.unset(PROVIDER)


def drained(spark, df, name, tmp_path):
    q = df.writeStream.outputMode("append").format("memory").queryName(name).option("checkpointLocation", str(tmp_path / name)).start()
    q.processAllAvailable()
    q.stop()
    return spark.sql(f"SELECT * FROM {name}").collect()


def test_calibration_equals_its_two_passes(rocks, tmp_path):
    df = rocks.createDataFrame([(k, i, float((i * 7) % 11)) for k in ("a", "b") for i in range(20 if k == "a" else 3)], "key string, frame long, value double")
    df.coalesce(1).write.parquet(str(tmp_path / "in"))
    got = drained(rocks, sessions.calibrated(rocks.readStream.schema(df.schema).parquet(str(tmp_path / "in")), 8), "calibrated_test", tmp_path)
    assert sorted(map(tuple, got)) == sorted(tuple(r) for r in sessions.calibrated_batch(df, 8).select("key", "frame", "value", "level").collect())


def test_short_keys_are_calibrated_at_their_end(rocks, tmp_path):
    schema = "key string, frame long, value double"
    sizes = {"a": 20, "b": 3, "c": 8, "d": 1}
    rows = [(k, i, float((i * 7) % 11)) for k, n in sizes.items() for i in range(n)]
    (tmp_path / "in").mkdir()
    # b ends in a batch of its own, d in that of its row; one row of b comes late
    for i, part in enumerate([rows, [("a", None, None), ("b", None, None)], [("c", None, None), ("d", None, None), ("e", None, None), ("b", 9, 1.0)]]):
        rocks.createDataFrame(part, schema).coalesce(1).write.parquet(str(tmp_path / "in" / f"p={i}"))
    source = rocks.readStream.schema(schema).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", True).parquet(str(tmp_path / "in"))
    got = drained(rocks, sessions.calibrated_whole(source, 8), "calibrated_whole_test", tmp_path)
    want = sessions.calibrated_whole_batch(rocks.createDataFrame([*rows, ("b", None, None)], schema), 8).select("key", "frame", "value", "level", "reliable").collect()
    assert len(want) == len(rows) and {(r["key"], r["level"], r["reliable"]) for r in want} == {("a", 6.0, True), ("b", 3.0, False), ("c", 6.0, True), ("d", 0.0, False)}
    assert sorted(map(tuple, got)) == sorted([*map(tuple, want), ("b", 9, 1.0, 3.0, False)])


def test_throttle_lets_few_through(rocks, tmp_path):
    df = rocks.createDataFrame([("a", i * 100_000, i) for i in range(0, 41)], "key string, t long, done long")
    df.coalesce(1).write.parquet(str(tmp_path / "in"))
    got = drained(rocks, sessions.throttled(rocks.readStream.schema(df.schema).parquet(str(tmp_path / "in")), 1_000_000), "throttled_test", tmp_path)
    assert [(r["t"], round(r["rate"], 6)) for r in sorted(got, key=lambda r: r["t"])] == [(1_000_000, 10.0), (2_000_000, 10.0), (3_000_000, 10.0), (4_000_000, 10.0)]


def in_files(spark, tmp_path, parts, schema):
    (tmp_path / "in").mkdir()
    for i, part in enumerate(parts):
        spark.createDataFrame(part, schema).coalesce(1).write.parquet(str(tmp_path / "in" / f"p={i}"))
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", True).parquet(str(tmp_path / "in"))


def test_a_report_that_waits_goes_out_when_it_is_due(rocks, tmp_path):
    at = lambda s: datetime(2024, 1, 1, tzinfo=timezone.utc) + timedelta(seconds=s)
    # a's second report is too early, and nothing of a follows; b moves event time on; later a goes on from what went out at its turn
    parts = [[("a", at(0), 0), ("a", at(0.4), 4)], [("b", at(5), 1)], [("a", at(5.5), 55)], [("b", at(20), 2)]]
    source = in_files(rocks, tmp_path, parts, "key string, ts timestamp, done long")
    got = drained(rocks, sessions.throttled_due(source, 1_000_000), "due_test", tmp_path)
    base = int(at(0).timestamp() * 1e6)
    rows = sorted((r["key"], r["t"] - base, r["done"], round(r["rate"], 6)) for r in got)
    assert rows == [("a", 1_000_000, 4, 4.0), ("a", 5_500_000, 55, round(51 / 4.5, 6)), ("b", 20_000_000, 2, round(1 / 15, 6))]


def test_silent_keys_are_calibrated_by_a_timer(rocks, tmp_path):
    at = lambda s: datetime(2024, 1, 1, tzinfo=timezone.utc) + timedelta(seconds=s)
    rows = lambda k, n, start: [(k, at(start + i), i, float((i * 7) % 11)) for i in range(n)]
    parts = [rows("a", 10, 0) + rows("b", 3, 0), [("a", at(11), 10, 5.0)], [("z", at(100), 0, 1.0)], [("z", at(101), 1, 2.0), ("b", at(101), 0, 9.0)], [("y", at(300), 0, 3.0)]]
    source = in_files(rocks, tmp_path, parts, "key string, ts timestamp, frame long, value double")
    got = drained(rocks, sessions.calibrated_idle(source, 8, "30 seconds"), "idle_test", tmp_path)
    by = {}
    for r in got:
        by.setdefault(r["key"], []).append((r["frame"], r["value"], r["level"], r["reliable"]))
    # a has enough rows; b is flushed after 30 s of silence and begins anew; y is still held
    assert [x[0] for x in sorted(by["a"])] == list(range(11)) and {x[2:] for x in by["a"]} == {(6.0, True)}
    assert sorted(by["b"]) == [(0, 0.0, 3.0, False), (0, 9.0, 9.0, False), (1, 7.0, 3.0, False), (2, 3.0, 3.0, False)]
    assert sorted(by["z"]) == [(0, 1.0, 2.0, False), (1, 2.0, 2.0, False)] and "y" not in by
