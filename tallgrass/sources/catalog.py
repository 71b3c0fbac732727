"""Which names a rule may use for a field of an event, of what kind it is, and how it is read.

A catalog binds names when a rule is compiled: a path of an alias first, then values that `let` named, then the sources in their order. A
name that nothing binds is an attribute of the event; where there are no attributes it is null, never an error.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import Column
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Entry:
    """A field: its kind (see conditions.KINDS) and the column of the event it is read from, or how it is computed from the event."""

    kind: str
    read: str | Callable[[Column], Column]

    def column(self, event: Column) -> Column:
        return event[self.read] if isinstance(self.read, str) else self.read(event)


@dataclass(frozen=True)
class Catalog:
    """Entries by name for all kinds of events, and by source kind; a source kind may share the entries of a family."""

    envelope: dict[str, Entry] = field(default_factory=dict)
    families: dict[str, dict[str, Entry]] = field(default_factory=dict)
    family_of: dict[str, str] = field(default_factory=dict)
    #: The map column that holds all other attributes.
    attrs: str | None = None

    def entry(self, source_kind: str, name: str) -> Entry | None:
        family = self.families.get(self.family_of.get(source_kind, source_kind), {})
        return self.envelope.get(name) or family.get(name)


def _named(kind: str, read: str | Callable[[Column], Column], *names: str) -> dict[str, Entry]:
    return dict.fromkeys(names, Entry(kind, read))


def _attr(*keys: str, kind: str = "string") -> Callable[[Column], Column]:
    return lambda event: F.coalesce(*(F.try_element_at(event["attrs"], F.lit(k)).try_cast(kind) for k in keys))


def _or_zero(key: str) -> Callable[[Column], Column]:
    return lambda event: F.coalesce(_attr(key, kind="long")(event), F.lit(0).cast("long"))


def _direction(event: Column) -> Column:
    label = _attr("ssl_operation")(event)
    return F.when(label == "encrypt", 0).when(label == "decrypt", 1).cast("long")


_IDS = _named("int", "tgid", "tgid") | _named("int", "uid", "uid") | _named("int", "gid", "gid")
_OTHER = _IDS | _named("int", "pid", "pid", "process_id") | _named("str", "comm", "comm", "process_name")

#: The names of the five families' fields and of the sources that read them: fixed values.
EVENTS = Catalog(
    envelope=(
        _named("str", "tenant_id", "tenant_id", "tenant") | _named("str", "host_id", "host_id", "host.id", "p.host_id") | _named("str", "batch_id", "batch_id")
        | _named("int", "ts_unix_ms", "ts", "timestamp", "ts_unix_ms") | _named("str", "event_kind", "event_type", "event_kind", "kind")
    ),
    families={
        "process_exec": (
            _IDS | _named("int", "pid", "pid", "process.pid", "id", "process_id", "process.id") | _named("int", "ppid", "ppid", "process.ppid", "parent.pid", "parent.id")
            | _named("int", "tgid", "process.tgid") | _named("int", "uid", "process.uid", "user.uid") | _named("int", "gid", "process.gid")
            | _named("str", "comm", "name", "comm", "process.name", "process.comm") | _named("str", "filename", "filename", "binary.path", "binary.filename", "process.binary.filename")
            | _named("bool", lambda event: event["uid"] == 0, "elevated")
        ),
        "file": (
            _OTHER | _named("int", "pid", "file.process_id") | _named("str", "path", "path", "file.path") | _named("str", "operation", "mode", "operation", "file.mode", "file.operation")
        ),
        "net": (
            _OTHER | _named("int", "pid", "network.process_id") | _named("str", "direction", "direction", "network.direction") | _named("str", "protocol", "protocol", "proto", "network.protocol")
            | _named("ip", "src_ip", "src_ip", "network.src_ip") | _named("ip", "dst_ip", "dst_ip", "dest.ip", "dest_ip", "network.dest.ip", "network.dst_ip")
            | _named("int", "src_port", "src_port", "network.src_port") | _named("int", "dst_port", "dst_port", "dest.port", "dest_port", "network.dest.port", "network.dst_port")
            | _named("int", _or_zero("bytes_out"), "bytes_out", "network.bytes_out") | _named("int", _or_zero("bytes_in"), "bytes_in", "network.bytes_in")
            | _named("str", _attr("dest.domain", "domain"), "dest.domain", "domain", "network.dest.domain")
            | _named("str", _attr("dest.reputation", "reputation"), "dest.reputation", "reputation", "network.dest.reputation")
            | _named("str", _attr("dns_query"), "domain.value", "dns.domain.value") | _named("int", _direction, "operation", "ssl.operation")
            | _named("int", _attr("ssl_data_len", kind="long"), "data_len", "ssl.data_len")
        ),
        "db_query": (
            _OTHER | _named("int", "pid", "db.process_id", "db.pid") | _named("str", "db_engine", "db_engine", "engine", "db.engine") | _named("str", "db_server", "db_server", "server", "db.server")
            | _named("str", "database", "database", "db.database") | _named("str", "operation", "operation", "db.operation")
            | _named("str", "statement_fingerprint", "statement_fingerprint", "fingerprint", "query_hash") | _named("list", "tables", "tables", "db.tables")
        ),
        "agent_heartbeat": (
            _named("str", "agent_version", "agent_version", "heartbeat.agent_version") | _named("str", "kernel_version", "kernel_version", "heartbeat.kernel_version")
            | _named("int", "events_read_total", "events_read_total") | _named("int", "events_dropped_total", "events_dropped_total") | _named("int", "queue_depth", "queue_depth")
        ),
    },
    family_of={
        "process": "process_exec", "spawn": "process_exec", "open": "file", "network": "net", "connect": "net", "flow": "net", "dns": "net", "dns_query": "net", "ssl": "net", "ssl_event": "net",
        "query": "db_query", "sql": "db_query", "database": "db_query", "db": "db_query", "heartbeat": "agent_heartbeat", "agent": "agent_heartbeat",
    },
    attrs="attrs",
)
