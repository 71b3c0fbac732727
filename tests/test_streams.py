"""Streams over an event table that is a folder of part files."""

import time

import pytest
from pyspark.sql import functions as F

from tallgrass.operators import rules
from tallgrass.operators.conditions import field, rate
from tallgrass.operators.rules import Rule, Source
from tallgrass.plans import all_queries, all_sql, streams
from tallgrass.streaming import pipelines
from test_queries import SF, con, plain  # noqa: F401

STREAMS = sorted(q for q in all_queries() if q.startswith("stream_"))


@pytest.fixture(scope="module")
def parts(spark, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("parts"))
    spark.read.parquet(f"{SF}/events.parquet").repartition(3).write.parquet(f"{path}/events.parquet")
    return path


@pytest.mark.parametrize("name", ["stream_dedupe_batches", "stream_interval_join", "stream_rule", "stream_novelty"])
def test_folder_of_part_files(spark, parts, name):
    of_file, of_folder = (all_queries()[name](spark, path).toPandas() for path in (SF, parts))
    assert len(of_file) and plain(of_folder) == plain(of_file)


@pytest.mark.parametrize("name", STREAMS)
def test_folder_gives_the_rows_of_the_table(spark, con, parts, name):  # noqa: F811
    found = all_queries()[name](spark, parts)
    if name in all_sql():
        assert plain(found.toPandas()) == plain(con.sql(all_sql()[name]).df())
    else:
        assert not found.isEmpty()


def test_facts_that_are_met(spark, tmp_path):
    """The table at this scale has no fact that an event meets, so: of three purchases one lies within the hour."""
    at = lambda minute: f"2024-01-01 00:{minute:02}:00" if minute < 60 else f"2024-01-01 01:{minute - 60:02}:00"
    rows = [(1, at(10), 7, "error", 60.0), (2, at(30), 7, "purchase", 1.0), (3, at(30), 8, "purchase", 1.0), (4, at(71), 7, "purchase", 1.0), (5, at(5), 7, "purchase", 1.0)]
    table = spark.createDataFrame(rows, "event_id long, ts string, user_id long, event_type string, value double")
    table.withColumns({"ts": F.col("ts").cast("timestamp_ntz"), "props": F.lit("{}")}).write.parquet(f"{tmp_path}/events.parquet")
    assert [tuple(r) for r in all_queries()["stream_facts_ttl"](spark, str(tmp_path)).collect()] == [(2,)]


def test_no_row_that_matches(spark, tmp_path):
    spark.read.parquet(f"{SF}/events.parquet").filter("event_type = 'view'").write.parquet(f"{tmp_path}/events.parquet")
    assert all_queries()["stream_rule"](spark, str(tmp_path)).isEmpty()


def test_unread_table_fails(spark, parts, monkeypatch):
    monkeypatch.setattr(streams, "_is_folder", lambda spark, path: False)
    with pytest.raises(ValueError, match="none of the rows"):
        all_queries()["stream_rule"](spark, parts)


def files(spark, path, batches, schema):
    """A stream that reads one file a micro-batch, in this order."""
    for i, rows in enumerate(batches):
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(str(path))
        time.sleep(1.1)  # files are taken by their time, which counts in seconds
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(path))


def finished(stream, tmp_path):
    query = stream.writeStream.format("parquet").option("path", f"{tmp_path}/out").option("checkpointLocation", f"{tmp_path}/at").trigger(availableNow=True).start()
    query.awaitTermination()
    return stream.sparkSession.read.schema(stream.schema).parquet(f"{tmp_path}/out").collect()


def test_rates_of_late_events(spark, tmp_path):
    """An event that comes in a later micro-batch than younger ones counts what its own window holds."""
    batches = [[("a", 10_000), ("a", 50_000)], [("a", 12_000), ("b", 12_000)], [("a", 50_000), ("a", 55_000)]]
    rows = files(spark, tmp_path / "in", batches, "k string, ms long").withColumn("ts", F.timestamp_millis("ms"))
    found = finished(pipelines.rates(rows, "k", "ts", "ms", 5_000, "10 minutes"), tmp_path)
    assert sorted((r.k, r.ms, r.rate) for r in found) == [("a", 10_000, 1), ("a", 12_000, 2), ("a", 50_000, 1), ("a", 50_000, 2), ("a", 55_000, 3), ("b", 12_000, 1)]


def test_rates_over_time_slices(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(pipelines, "SLICE_WINDOWS", 1)
    at = [1_000 + i * 700 for i in range(40)]
    rows = files(spark, tmp_path / "in", [[("a", ms) for ms in at]], "k string, ms long").withColumn("ts", F.timestamp_millis("ms"))
    found = finished(pipelines.rates(rows, "k", "ts", "ms", 3_000, "10 minutes"), tmp_path)
    assert sorted((r.ms, r.rate) for r in found) == [(x, sum(x - 3_000 <= y <= x for y in at)) for x in at]


def test_token_bucket(spark, tmp_path):
    batches = [[("a", 0, 1), ("a", 0, 2), ("a", 0, 3), ("b", 0, 4)], [("a", 1_000, 5), ("a", 1_000, 6)]]
    rows = files(spark, tmp_path / "in", batches, "k string, ms long, id long")
    found = finished(pipelines.token_bucket(rows, ["k"], "ms", "id", 2, 1.0), tmp_path)
    assert {r.id: r.allowed for r in found} == {1: True, 2: True, 3: False, 4: True, 5: True, 6: False}


def test_rule_of_three_sources_as_on_a_table(spark, tmp_path):
    kinds = ["a", "b", "c"]
    rows = [(i, i * 40_000, 1 + i % 2, 1, kinds[i * 7 % 3], float(i)) for i in range(30)]
    schema = "event_id long, ts_ms long, user_id long, tenant_id long, event_type string, value double"
    rule = Rule("r", "r", tuple(Source(k, k) for k in kinds), within="3m", where=(field("c.value") > 4,))
    stream = files(spark, tmp_path / "in", [rows], schema).withColumn("ts", F.timestamp_millis("ts_ms"))
    ids = lambda df: df.select(*(F.col(f"{k}.event_id").alias(k) for k in kinds))
    expected = ids(rules.run(rule, spark.createDataFrame(rows, schema))).collect()
    assert expected and sorted(map(tuple, finished(ids(pipelines.rule_stream(rule, stream)), tmp_path))) == sorted(map(tuple, expected))
    with pytest.raises(ValueError, match="a rule that remembers needs"):
        pipelines.rule_stream(Rule("r", "r", (Source("a", "a"),), where=(rate(field("a.user_id"), "1m") > 1,)), stream)
