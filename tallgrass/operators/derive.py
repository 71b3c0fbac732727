"""What is derived of single events: base risk, the wire's family, what a console shows, verdicts and health."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tallgrass.operators.graph import checkpointed, placed

#: Kinds of an agent's event: fixed values.
KINDS = {1: "process_exec", 2: "file", 3: "net", 4: "sql", 5: "ssl", 6: "dns", 7: "tc"}
#: The family of the wire's row that each kind becomes: fixed values.
WIRE_FAMILY = {"process_exec": "process_exec", "file": "file", "net": "net", "sql": "db_query", "ssl": "net", "dns": "net", "tc": "net"}
#: The engine behind a database port, and the operation of a statement kind: fixed values.
ENGINE_BY_PORT = {3306: "mysql", 5432: "postgresql"}
OPERATION = {1: "select", 2: "dml", 3: "ddl", 4: "admin"}
#: Paths that a console marks: a fixed value.
_SENSITIVE = r"(?i)shadow|authorized_keys|id_rsa"


def _lookup(key: Column, values: dict, otherwise: str) -> Column:
    table = F.create_map(*(x for k, v in values.items() for x in (F.lit(k), F.lit(v))))
    return F.coalesce(F.try_element_at(table, key), F.lit(otherwise))


def kind_name(event_type: Column) -> Column:
    return _lookup(event_type.cast("int"), KINDS, "other")


def base_risk(kind: Column, write: Column, statement_kind: Column, tls_bytes: Column, domain: Column, denied: Column) -> Column:
    """The risk that an event starts with, by kind: fixed values. Null details count as the harmless case."""
    sure = lambda c: F.coalesce(c, F.lit(False))
    sql = F.when(statement_kind == 3, 0.85).when(statement_kind == 4, 0.9).otherwise(0.4)
    return (
        F.when(kind == "process_exec", 0.5).when(kind == "file", F.when(sure(write), 0.6).otherwise(0.35)).when(kind == "net", 0.7).when(kind == "sql", sql)
        .when(kind == "ssl", F.when(sure(tls_bytes > 1 << 20), 0.85).otherwise(0.55)).when(kind == "dns", F.when(sure(F.char_length(domain) > 40), 0.7).otherwise(0.45))
        .when(kind == "tc", F.when(sure(denied), 0.95).otherwise(0.5)).otherwise(0.0)
    )


def wire_family(kind: Column) -> Column:
    return _lookup(kind, WIRE_FAMILY, "agent_heartbeat")


def wire_protocol(kind: Column) -> Column:
    return F.when(kind == "ssl", "tls").when(kind == "tc", "tc").when(kind == "dns", "dns").when(kind == "net", "tcp")


def wire_port(kind: Column, port: Column) -> Column:
    return F.when(kind == "dns", F.lit(53)).otherwise(port.cast("int"))


def engine_of(port: Column) -> Column:
    return _lookup(port.cast("int"), ENGINE_BY_PORT, "unknown")


def operation_of(statement_kind: Column) -> Column:
    return _lookup(statement_kind.cast("int"), OPERATION, "other")


def console_severity(kind: Column, rule: Column, risk: Column, path: Column, operation: Column) -> Column:
    """A matched rule by its risk, else by kind and what is touched; words and bounds are fixed values."""
    by_rule = F.when(risk >= 0.8, "crit").when(risk >= 0.4, "high").otherwise("med")
    by_kind = (
        F.when(kind == "net", "med").when(kind == "file", F.when(F.coalesce(path.rlike(_SENSITIVE), F.lit(False)), "high").otherwise("low"))
        .when(kind == "db_query", F.when(operation.isin("ddl", "admin"), "high").otherwise("med")).otherwise("low")
    )
    return F.when(F.coalesce(rule, F.lit("")) != "", by_rule).otherwise(by_kind)


def endpoint_target(address: Column, port: Column) -> Column:
    """address:port, without the port where it is unknown or 0; null without an address."""
    known = F.coalesce(port != 0, F.lit(False))
    return F.when(address != "", F.concat(address, F.when(known, F.concat(F.lit(":"), port.cast("string"))).otherwise(F.lit(""))))


def database_target(engine: Column, database: Column, tables: Column) -> Column:
    """engine/database on table, table; without any of these "db"."""
    some = lambda c: F.when(c != "", c)
    name = F.concat_ws("/", some(engine), some(database))
    of = F.when(F.size(tables) > 0, F.concat(F.lit(" on "), F.array_join(tables, ", ")))
    return F.concat(F.when(name != "", name).otherwise(F.lit("db")), F.coalesce(of, F.lit("")))


def console_description(kind: Column, rule: Column, pid: Column, comm: Column, operation: Column, target: Column, read: Column | None = None, dropped: Column | None = None) -> Column:
    """One line: who did what to what; what is unknown has a stand-in, trailing blanks go. The words are fixed values. target: see
    endpoint_target and database_target, else a path; read and dropped: the counts of a heartbeat."""
    or_else = lambda c, x: F.coalesce(F.when(c != "", c), F.lit(x))
    count = lambda c: F.coalesce(F.lit(0) if c is None else c, F.lit(0)).cast("long").cast("string")
    heartbeat = F.concat(F.lit("heartbeat read="), count(read), F.lit(" dropped="), count(dropped))
    who = or_else(comm, "proc")
    named = F.concat(F.lit("rule "), rule, F.lit(" matched (pid="), F.coalesce(pid.cast("string"), F.lit("n/a")), F.lit(")"))
    line = lambda what, default: F.rtrim(F.concat(who, F.lit(" "), what, F.lit(" "), or_else(target, default)))
    by_kind = (
        F.when(kind == "net", line(or_else(operation, "net"), "unknown-dst")).when(kind == "file", line(or_else(operation, "file_op"), ""))
        .when(kind == "db_query", line(or_else(operation, "query"), "db")).when(kind == "process_exec", line(F.lit("exec"), "")).otherwise(heartbeat)
    )
    return F.when(F.coalesce(rule, F.lit("")) != "", named).otherwise(by_kind)


def policy_verdict(block_requested: Column, enforcing: Column) -> Column:
    requested = F.coalesce(block_requested, F.lit(False))
    return F.when(requested & F.coalesce(enforcing, F.lit(False)), "block").when(requested, "would_block").otherwise("allow")


def probe_health(reported: Column, running: Column, age_s: Column, most_age_s: int, probes: Column, captured: Column, dropped: Column) -> Column:
    """unreported, stale (not running or too old), no_probes, degraded (more dropped than captured) or healthy."""
    fresh = F.coalesce(running & (age_s <= most_age_s), F.lit(False))
    return (
        F.when(~F.coalesce(reported, F.lit(False)), "unreported").when(~fresh, "stale").when(F.coalesce(F.size(probes), F.lit(0)) <= 0, "no_probes")
        .when(F.coalesce(dropped, F.lit(0)) > F.coalesce(captured, F.lit(0)), "degraded").otherwise("healthy")
    )


def with_cgroups(rows: DataFrame, cgroups: DataFrame) -> DataFrame:
    """rows(cgroup_id, ...) with path, container_id and pod_uid of cgroups(cgroup_id, path), null where unknown."""
    container = F.regexp_extract("path", r"([0-9a-f]{64})", 1)
    pod = F.regexp_replace(F.regexp_extract("path", r"pod([0-9a-f]{8}[-_][0-9a-f]{4}[-_][0-9a-f]{4}[-_][0-9a-f]{4}[-_][0-9a-f]{12})", 1), "_", "-")
    known = cgroups.groupBy("cgroup_id").agg(F.max("path").alias("path"))
    known = known.select("cgroup_id", "path", F.when(container != "", container).alias("container_id"), F.when(pod != "", pod).alias("pod_uid"))
    return rows.join(known, "cgroup_id", "left")


def inventory(programs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Programs, those attributed first, then by runs; and the sum of their locked memory."""
    return programs.orderBy(F.desc("attributed"), F.desc("run_count"), "id"), programs.agg(F.coalesce(F.sum("bytes_memlock"), F.lit(0)).alias("bytes"))


def alerts_of_sessions(alerts: DataFrame, sessions: DataFrame, live: tuple[str, ...] = ("ACTIVE", "CHALLENGED", "RESTRICTED")) -> DataFrame:
    """Alerts with each live session of the same tenant and host. sessions(session_id, tenant_id, host_id, state); alerts may be a stream."""
    return alerts.join(sessions.filter(F.col("state").isin(*live)).select("session_id", "tenant_id", "host_id", "state"), ["tenant_id", "host_id"])


def peers(sessions: DataFrame, keys: DataFrame, live: tuple[str, ...] = ("ACTIVE", "CHALLENGED", "RESTRICTED")) -> DataFrame:
    """The live sessions with each of their keys that is not revoked: what a gateway configures. sessions(session_id, tenant_id, gateway_id,
    state, ...); keys(session_id, revoked_at, ...)."""
    return sessions.filter(F.col("state").isin(*live)).join(keys.filter("revoked_at IS NULL"), "session_id")


def active_keys(sessions: DataFrame, keys: DataFrame) -> DataFrame:
    """tenant_id, active_keys: the keys of a tenant's sessions, whatever their state, that are not revoked; 0 where there are none."""
    counts = keys.groupBy("session_id").agg(F.count_if(F.col("revoked_at").isNull()).alias("n"))
    return sessions.join(counts, "session_id", "left").groupBy("tenant_id").agg(F.coalesce(F.sum("n"), F.lit(0)).alias("active_keys"))


def session_faults(sessions: DataFrame, now_s: Column, grace_s: int) -> DataFrame:
    """sessions(session_id, expires_s, heartbeat_s, ...) with fault: expired, stale, or null."""
    fault = F.when(F.col("expires_s") <= now_s - grace_s, "expired").when(now_s - F.col("heartbeat_s") > grace_s, "stale")
    return sessions.withColumn("fault", fault)


#: States in which a session holds its place: fixed values.
LIVE = ("ACTIVE", "CHALLENGED", "RESTRICTED")


def failed_over(sessions: DataFrame, gateways: DataFrame, live: tuple[str, ...] = LIVE) -> DataFrame:
    """The live sessions of gateways that are not healthy, with new_gateway: where each moves to, null where it stays because nothing is free.

    sessions(session_id, tenant_id, region, gateway_id, state); gateways(gateway_id, tenant_id, region, capacity, healthy), tenant_id null for
    those that all tenants share. No gateway gets more live sessions than its capacity. Sessions go to their region first, there to their
    tenant's own gateways, then to shared ones; what is left goes the same way to any region. In each of these four rounds a pool's free
    places stand in order of (load / capacity, gateway_id), as if one session after the other took the least loaded gateway, and meet the
    pool's sessions by number.
    """
    held = sessions.filter(F.col("state").isin(*live)).select("session_id", "tenant_id", "region", "gateway_id")
    load = held.groupBy("gateway_id").agg(F.count(F.lit(1)).alias("load"))
    # as many rows as there are gateways; a gateway has as many places as its capacity
    free = gateways.filter("healthy").join(load, "gateway_id", "left").withColumn("load", F.coalesce("load", F.lit(0)))
    places = free.filter("capacity > load").select(F.col("gateway_id").alias("new_gateway"), F.col("tenant_id").alias("owner"), F.col("region").alias("at"), "capacity", F.explode(F.sequence(F.col("load"), F.col("capacity") - 1)).alias("taken"))
    todo = held.join(gateways.filter(~F.col("healthy")).select("gateway_id"), "gateway_id", "left_semi")
    done = []
    own, near = F.col("owner").isNotNull(), F.lit(None).cast("string")
    for of_session, of_place, wanted in (
        (F.concat_ws("\x1f", "tenant_id", "region"), F.concat_ws("\x1f", "owner", "at"), own), (F.col("region"), F.col("at"), ~own),
        (F.col("tenant_id").cast("string"), F.col("owner").cast("string"), own), (F.lit("all"), F.lit("all"), ~own),
    ):
        asking = placed(todo.withColumn("__pool", F.coalesce(of_session.cast("string"), near)).filter("__pool IS NOT NULL"), "__pool", "session_id", "__place")
        order = Window.partitionBy("__pool").orderBy(F.col("taken") / F.col("capacity"), "new_gateway")
        offered = places.filter(wanted).withColumn("__pool", of_place.cast("string")).filter("__pool IS NOT NULL").withColumn("__place", (F.row_number().over(order) - 1).cast("long"))
        met = checkpointed(asking.join(offered.select("__pool", "__place", "new_gateway", "taken"), ["__pool", "__place"]).select(*held.columns, "new_gateway", "taken"))
        done.append(met.drop("taken"))
        todo = checkpointed(todo.join(met.select("session_id"), "session_id", "left_anti"))
        places = places.join(met.select("new_gateway", "taken"), ["new_gateway", "taken"], "left_anti")
    stranded = todo.withColumn("new_gateway", F.lit(None).cast(gateways.schema["gateway_id"].dataType))
    return reduce(lambda a, b: a.unionByName(b), [*done, stranded])
