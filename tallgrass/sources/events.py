"""Event tables: the wide form that rules read, and the ingest batches it comes from."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tallgrass.functions.clock import in_band, trusted_time

#: The five families of an ingest batch and the fields that each has besides pid, tgid, uid, gid and comm.
FAMILIES = {
    "process_exec": ("process_exec_events", "ppid int, filename string"),
    "file": ("file_events", "operation string, path string"),
    "net": ("net_events", "direction string, protocol string, src_ip string, dst_ip string, src_port int, dst_port int"),
    "db_query": ("db_query_events", "db_engine string, db_server string, database string, operation string, tables array<string>, statement_fingerprint string"),
    "agent_heartbeat": ("agent_heartbeats", "agent_version string, kernel_version string, events_read_total bigint, events_dropped_total bigint, queue_depth int"),
}
_COMMON = "ts_unix_ms bigint, pid bigint, tgid bigint, uid bigint, gid bigint, comm string, attrs map<string,string>"



def _batch_schema() -> str:
    lists = []
    for field, own in FAMILIES.values():
        inner = ", ".join(x.replace(" ", ": ", 1) for x in f"{_COMMON}, {own}".replace("map<string,string>", "map<string;string>").split(", "))
        lists.append(f"{field} array<struct<{inner.replace(';', ',')}>>")
    return ", ".join(["tenant_id string, host_id string, schema_version int, batch_id string, ingested_at_unix_ms bigint", *lists])


#: The schema of a batch, for readers: spark.read.schema(BATCH_SCHEMA).json(path), or readStream.
BATCH_SCHEMA = _batch_schema()


def checked(batches: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Accepted and rejected batches, the latter with a reason: a schema version from 1 to 3, and at least one row."""
    version = F.coalesce(F.col("schema_version"), F.lit(1))
    rows = reduce(lambda a, b: a + b, (F.coalesce(F.size(field), F.lit(0)) for field, _ in FAMILIES.values()))
    reason = F.when(~version.between(1, 3), F.lit("schema_version")).when(rows <= 0, F.lit("no_rows"))
    marked = batches.withColumn("schema_version", version).withColumn("reason", reason)
    return marked.filter("reason IS NULL").drop("reason"), marked.filter("reason IS NOT NULL")


def flattened(batches: DataFrame) -> DataFrame:
    """One row an event: the envelope, event_kind, the resolved time and whether it fell back to the arrival, and the event as a struct."""
    envelope = ["tenant_id", "host_id", "schema_version", "batch_id", "ingested_at_unix_ms"]
    parts = []
    for kind, (field, _) in FAMILIES.items():
        rows = batches.select(*envelope, F.explode(field).alias("event"))
        own, arrival = F.col("event.ts_unix_ms"), F.col("ingested_at_unix_ms")
        parts.append(rows.select(*envelope, F.lit(kind).alias("event_kind"), trusted_time(own, arrival).alias("ts_unix_ms"), (~in_band(own, arrival)).alias("ts_fallback"), "event"))
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), parts)


def wide(flat: DataFrame) -> DataFrame:
    """The event's fields as columns beside the envelope; fields that a kind lacks are null."""
    return flat.select("*", "event.*").drop("event")


def from_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The test table `events` as rule input: kinds, a tenant, milliseconds and attributes."""
    events = spark.read.parquet(f"{sf_dir}/events.parquet")
    return events.select(
        "event_id", F.col("ts").cast("timestamp").alias("ts"), F.unix_millis(F.col("ts").cast("timestamp")).alias("ts_ms"), "user_id",
        (F.col("user_id") % 3).alias("tenant_id"), "event_type", "value", F.from_json("props", "map<string,string>").alias("attrs"),
    )


def attribute(attrs: Column, name: str, kind: str = "string") -> Column:
    """An attribute read as the type that it is compared with; null where it is absent or reads otherwise."""
    return F.try_element_at(attrs, F.lit(name)).try_cast(kind)


def feed_entries(lines: DataFrame) -> DataFrame:
    """entry: the first word of each line of lines(value) that is neither blank nor a comment."""
    line = F.trim("value")
    return lines.filter((line != "") & ~line.startswith("#") & ~line.startswith(";") & ~line.startswith("//")).select(F.element_at(F.split(line, r"[\s,;]+"), 1).alias("entry"))
