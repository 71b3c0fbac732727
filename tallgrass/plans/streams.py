"""Queries that run as streams over the event table until its files are read, and return what they wrote."""

from __future__ import annotations

import tempfile
import uuid
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallgrass.operators.conditions import field, first_seen, has_fact, rare, rate
from tallgrass.operators.rules import Fact, Rule, Source
from tallgrass.plans.common import EV, Registry, events
from tallgrass.streaming import facts, pipelines
from tallgrass.streaming.calls import STATE_STORE

registry = Registry()
add = registry.add

_own: list[str] = []
#: Of the last query that ran to its end: input rows, rows a second, seconds of its slowest micro-batch, rows of state.
last_run: dict[str, float] = {}


def _folder(spark: SparkSession) -> str:
    """A new folder in the shared one, spark.checkpoint.dir; where that is unset, in a temporary folder, on a single machine only."""
    context = spark.sparkContext
    shared = spark.conf.get("spark.checkpoint.dir", None) or context.getConf().get("spark.checkpoint.dir") or context.getCheckpointDir()
    if not shared:
        if not context.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        if not _own:
            _own.append(f"file://{tempfile.mkdtemp(prefix='tallgrass-streams-')}")
        shared = _own[0]
    return f"{shared}/stream-{uuid.uuid4().hex[:12]}"


def _is_folder(spark: SparkSession, path: str) -> bool:
    """Asked of the store that Spark reads; fails if nothing is there."""
    found = spark._jvm.org.apache.hadoop.fs.Path(path)
    return found.getFileSystem(spark._jsc.hadoopConfiguration()).getFileStatus(found).isDirectory()


def _events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The event table as a stream, whether it is a file or a folder of part files: a stream's source is a folder."""
    schema = "event_id long, ts timestamp_ntz, user_id long, event_type string, value double, props string"
    stream = spark.readStream.schema(schema)
    path = f"{sf_dir}/events.parquet"
    rows = stream.parquet(path) if _is_folder(spark, path) else stream.option("pathGlobFilter", "events.parquet").parquet(sf_dir)
    return rows.select("event_id", F.col("ts").cast("timestamp").alias("ts"), F.unix_millis(F.col("ts").cast("timestamp")).alias("ts_ms"), "user_id", (F.col("user_id") % 3).alias("tenant_id"), "event_type", "value")


def _finished(sf_dir: str, rows: DataFrame, mode: str = "append") -> DataFrame:
    spark = rows.sparkSession
    folder = _folder(spark)
    out = f"{folder}/out"
    writer = rows.writeStream.outputMode(mode).option("checkpointLocation", f"{folder}/checkpoint").trigger(availableNow=True)
    if mode == "append":
        query = writer.format("parquet").option("path", out).start()
    else:
        query = writer.foreachBatch(lambda batch, n: batch.withColumn("batch", F.lit(n)).write.mode("append").parquet(out)).start()
    query.awaitTermination()
    progress = query.recentProgress
    rows_in, took = sum(p["numInputRows"] for p in progress), [p["durationMs"].get("triggerExecution", 0) / 1000 for p in progress]
    state = [sum(o["numRowsTotal"] for o in p["stateOperators"]) for p in progress]
    last_run.update(rows=rows_in, rows_per_second=round(rows_in / max(sum(took), 0.001)), slowest_batch=max(took, default=0.0), state_rows=max(state, default=0))
    met = any(s["endOffset"] and "logOffset" in str(s["endOffset"]) for p in progress for s in p["sources"])  # a file at least
    if not met and not spark.read.parquet(f"{sf_dir}/events.parquet").isEmpty():
        raise ValueError(f"the stream read none of the rows of {sf_dir}/events.parquet")
    schema = rows.schema if mode == "append" else None
    return spark.read.schema(schema).parquet(out) if schema else spark.read.parquet(out)


@add("SELECT DISTINCT user_id, tenant_id FROM ev")
def stream_dedupe_batches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of all events of a user, taken as repetitions of one batch, the first."""
    rows = _events(spark, sf_dir).select(F.col("tenant_id"), F.lit("h").alias("host_id"), F.col("user_id").cast("string").alias("batch_id"), F.col("ts").alias("ingested_at"), "user_id")
    return _finished(sf_dir, pipelines.once_per_batch(rows, lateness="60 days").select("user_id", "tenant_id"))


@add(f"WITH {EV} SELECT e.event_id AS error_event_id, p.event_id AS purchase_event_id FROM ev e JOIN ev p ON e.user_id = p.user_id AND p.ts BETWEEN e.ts - INTERVAL 1 HOUR AND e.ts + INTERVAL 1 HOUR WHERE e.event_type = 'error' AND p.event_type = 'purchase'")
def stream_interval_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    left = _events(spark, sf_dir).filter("event_type = 'error'").select(F.col("event_id").alias("error_event_id"), F.col("user_id").alias("u"), F.col("ts").alias("error_ts"))
    right = _events(spark, sf_dir).filter("event_type = 'purchase'").select(F.col("event_id").alias("purchase_event_id"), F.col("user_id").alias("v"), F.col("ts").alias("purchase_ts"))
    pairs = pipelines.interval_pairs(left, right, F.col("u") == F.col("v"), "error_ts", "purchase_ts", "1 HOUR")
    return _finished(sf_dir, pairs.select("error_event_id", "purchase_event_id"))


@add("""SELECT event_type, time_bucket(INTERVAL '1 day', ts) AS window_start, count(value) AS n, min(value) AS least, max(value) AS most, round(avg(value), 6) AS mean FROM ev
  WHERE time_bucket(INTERVAL '1 day', ts) + INTERVAL '1 day' <= (SELECT max(ts) - INTERVAL '1 hour' FROM ev) GROUP BY ALL""")
def stream_tumbling_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Windows that the watermark has closed; the percentiles, being approximate, are left to digest_merge."""
    closed = _finished(sf_dir, pipelines.tumbling_metrics(_events(spark, sf_dir), "ts", "1 day", ["event_type"], "value").withColumn("mean", F.round("mean", 6)))
    return closed.select("event_type", F.col("window_start").cast("timestamp_ntz").alias("window_start"), "n", "least", "most", "mean")


@add("SELECT event_id, (70 + CASE WHEN value > 200 THEN 15 ELSE 0 END)::INTEGER AS score FROM ev WHERE event_type = 'error' AND value > 100")
def stream_rule(spark: SparkSession, sf_dir: str) -> DataFrame:
    rule = Rule("large_error", "Large error", (Source("e", "error"),), where=(field("e.value") > 100,), base=70, modifiers=((15, field("e.value") > 200),))
    return _finished(sf_dir, pipelines.rule_stream(rule, _events(spark, sf_dir)).select("e.event_id", "score"))


@add(f"""WITH {EV} SELECT e.event_id AS error_event_id, p.event_id AS purchase_event_id, (50 + CASE WHEN p.value > 100 THEN 20 ELSE 0 END)::INTEGER AS score FROM ev e JOIN ev p ON e.tenant_id = p.tenant_id AND e.user_id = p.user_id
  AND abs(p.ts_ms - e.ts_ms) <= 3600000 WHERE e.event_type = 'error' AND p.event_type = 'purchase' AND p.value > 0""")
def stream_rule_two_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    rule = Rule("pair", "Pair", (Source("e", "error"), Source("p", "purchase")), within="1h", where=(field("p.value") > 0,), base=50, modifiers=((20, field("p.value") > 100),))
    alerts = pipelines.rule_stream(rule, _events(spark, sf_dir))
    return _finished(sf_dir, alerts.select(F.col("e.event_id").alias("error_event_id"), F.col("p.event_id").alias("purchase_event_id"), "score"))


@add(f"""WITH {EV}, f AS (SELECT tenant_id, user_id, ts AS t0 FROM ev WHERE event_type = 'error' AND value > 50)
  SELECT event_id FROM ev WHERE event_type = 'purchase' AND EXISTS (SELECT 1 FROM f WHERE f.tenant_id = ev.tenant_id AND f.user_id = ev.user_id AND t0 <= ts AND ts < t0 + INTERVAL 1 HOUR)""")
def stream_facts_ttl(spark: SparkSession, sf_dir: str) -> DataFrame:
    marks = _events(spark, sf_dir).filter("event_type = 'error' AND value > 50")
    facts = marks.select("tenant_id", F.col("user_id").cast("string").alias("arg"), F.col("ts").alias("emitted"), F.expr("ts + INTERVAL 1 HOUR").alias("expires"))
    live = pipelines.with_live_facts(_events(spark, sf_dir).filter("event_type = 'purchase'"), facts, F.col("user_id"), "ts", "1 HOUR", "1 day")
    return _finished(sf_dir, live.select("event_id"))


@add(f"""WITH RECURSIVE {EV}, e AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts_ms, event_id) AS i FROM ev),
  s AS (SELECT user_id, ts_ms, event_id, i, 3::DOUBLE AS held FROM e WHERE i = 1
  UNION ALL SELECT e.user_id, e.ts_ms, e.event_id, e.i, least(3::DOUBLE, held - CASE WHEN held >= 1 THEN 1 ELSE 0 END + (e.ts_ms - s.ts_ms) * (1 / 86400::DOUBLE) / 1000) FROM s JOIN e ON e.user_id = s.user_id AND e.i = s.i + 1)
  SELECT user_id, ts_ms, event_id, held >= 1 AS allowed FROM s""")
def stream_token_bucket(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _finished(sf_dir, pipelines.token_bucket(_events(spark, sf_dir), ["user_id"], "ts_ms", "event_id", 3, 1 / 86_400))


@add("SELECT DISTINCT user_id, event_type FROM ev")
def stream_novelty(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _finished(sf_dir, pipelines.novelty(_events(spark, sf_dir), ["user_id", "event_type"], "ts").select("user_id", "event_type"))


@add("SELECT user_id, ts_ms, count(*) OVER (PARTITION BY user_id ORDER BY ts_ms RANGE BETWEEN 3600000 PRECEDING AND CURRENT ROW)::BIGINT AS rate FROM ev")
def stream_rate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _finished(sf_dir, pipelines.rates(_events(spark, sf_dir), "user_id", "ts", "ts_ms", 3_600_000, "60 days"))


@add(f"""WITH RECURSIVE {EV}, e AS (SELECT user_id, ts_ms, CASE event_type WHEN 'error' THEN 2 WHEN 'purchase' THEN 1 ELSE 0 END AS want, row_number() OVER (PARTITION BY user_id ORDER BY ts_ms, event_id) AS i FROM ev),
  s AS (SELECT user_id, 0::BIGINT AS i, 0 AS now, 0::BIGINT AS since, 0::BIGINT AS changes FROM (SELECT DISTINCT user_id FROM e)
  UNION ALL SELECT user_id, place, CASE WHEN m THEN want ELSE now END, CASE WHEN m THEN ts_ms WHEN want = now THEN greatest(since, ts_ms) ELSE since END, changes + m::BIGINT
  FROM (SELECT s.*, e.want, e.ts_ms, e.i AS place, now < 3 AND (want > now OR (want < now AND e.ts_ms - since >= 3600000)) AS m FROM s JOIN e ON e.user_id = s.user_id AND e.i = s.i + 1) x)
  SELECT user_id, ['ACTIVE', 'CHALLENGED', 'RESTRICTED', 'TERMINATED'][now + 1] AS state, changes FROM s QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY i DESC) = 1""")
def stream_session_state(spark: SparkSession, sf_dir: str) -> DataFrame:
    rank = F.when(F.col("event_type") == "error", 2).when(F.col("event_type") == "purchase", 1).otherwise(0)
    rows = _events(spark, sf_dir).withWatermark("ts", "1 day").select("user_id", "ts", "ts_ms", rank.alias("want"))
    states = pipelines.session_states(rows, "user_id", "want", "ts_ms", 3_600_000)
    changed = _finished(sf_dir, states, "update")
    return changed.groupBy("user_id").agg(F.max_by("state", "batch").alias("state"), F.max("changes").alias("changes"))


@contextmanager
def _on_disk(spark: SparkSession):
    """Queries that start meanwhile keep their state in RocksDB."""
    name = "spark.sql.streaming.stateStore.providerClass"
    before = spark.conf.get(name)
    spark.conf.set(name, STATE_STORE)
    try:
        yield
    finally:
        spark.conf.set(name, before)


@add(f"""WITH {EV}, f AS (SELECT *, count(*) OVER (PARTITION BY tenant_id, user_id ORDER BY ts_ms RANGE BETWEEN 21600000 PRECEDING AND CURRENT ROW) AS n FROM ev WHERE event_type = 'click' AND value > 20),
  g AS (SELECT *, value <= 60 AND row_number() OVER (PARTITION BY tenant_id, event_id % 50, value > 60 ORDER BY ts_ms, event_id) <= 3 AS x FROM f WHERE n >= 2), h AS (SELECT * FROM g WHERE value > 60 OR x)
  SELECT event_id, n::BIGINT AS n, (30 + CASE WHEN row_number() OVER (PARTITION BY tenant_id, user_id ORDER BY ts_ms, event_id) = 1 THEN 25 ELSE 0 END)::INTEGER AS score FROM h""")
def stream_rule_calls(spark: SparkSession, sf_dir: str) -> DataFrame:
    """rate, rare and first_seen of a rule over a stream, each over the rows that the rule has come to."""
    v, user = field("e.value"), field("e.user_id")
    n = rate(user, "6h")
    rule = Rule("calls", "Calls", (Source("e", "click"),), where=((v > 20) & (n >= 2), (v > 60) | rare(field("e.event_id") % 50)), let=(("n", n),), base=30, modifiers=((25, first_seen(user)),))
    with _on_disk(spark):
        return _finished(sf_dir, pipelines.rule_stream(rule, _events(spark, sf_dir), lateness="60 days").select("e.event_id", "n", "score"))


#: The ends of the four parts of the events' time that come as one trigger each.
_PARTS = ("2024-01-09", "2024-01-16", "2024-01-23")


@add(f"""WITH {EV}, p AS (SELECT *, (ts >= '2024-01-09')::INT + (ts >= '2024-01-16')::INT + (ts >= '2024-01-23')::INT AS part FROM ev),
  last AS (SELECT b.part, f.tenant_id, f.user_id, max(f.ts_ms) AS t0 FROM (VALUES (1), (2), (3)) b(part) JOIN p f ON f.part < b.part WHERE f.event_type = 'error' AND f.value > 20 GROUP BY ALL)
  SELECT event_id, 70 AS score FROM p JOIN last USING (part, tenant_id, user_id) WHERE event_type = 'purchase' AND value > 5 AND t0 <= ts_ms AND t0 + 259200000 > ts_ms""")
def stream_facts_upsert(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One rule emits facts into the store, another asks for them from the next trigger on; emitted again, a fact lasts longer."""
    folder, user = _folder(spark), field("e.user_id")
    store = facts.FactStore(spark, f"{folder}/facts")
    first = Rule("marks", "Marks", (Source("e", "error"),), where=(field("e.value") > 20,), emit=(Fact("user.failed", (user,), "3d"),))
    then = Rule("uses", "Uses", (Source("e", "purchase"),), where=((field("e.value") > 5) & has_fact("user.failed", user),), base=70)
    rows = events(spark, sf_dir).drop("attrs")
    stream = spark.readStream.schema(rows.schema).parquet(f"{folder}/in/*")
    ends = [F.lit(t).cast("timestamp") for t in _PARTS]
    for n in range(len(ends) + 1):
        part = rows.filter((F.col("ts") >= ends[n - 1]) if n else F.lit(True)).filter((F.col("ts") < ends[n]) if n < len(ends) else F.lit(True))
        part.write.parquet(f"{folder}/in/{n}")
        for rule in (then, first):
            deliver = lambda alerts, at, rule=rule: alerts.select("e.event_id", "score").write.mode("overwrite").parquet(f"{folder}/{rule.rule_id}/{at}")
            facts.run_stream(rule, stream, store, f"{folder}/at-{rule.rule_id}", deliver).awaitTermination()
    return spark.read.schema("event_id long, score int").parquet(f"{folder}/uses/*")
