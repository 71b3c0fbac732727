"""Facts that rules emit and others ask for while streams run: a keyed table, upserted by each micro-batch.

A fact is known by tenant, name and arguments. Emitted again, it lasts from its last emission (by event time) on; an older one that comes
late changes nothing. Each micro-batch of each writer owns a folder of the log and replaces it as a whole, so a batch that runs twice writes
the same once; what a batch reads leaves out its own and later folders of its writer. From time to time the log is folded into a base, from which
facts that have long expired are gone. Bases and logs are only used once they are whole.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import replace

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from tallgrass.operators import rules
from tallgrass.operators.conditions import Condition, conjuncts
from tallgrass.operators.rules import Fields, Rule
from tallgrass.streaming import pipelines

SCHEMA = "tenant_id string, fact string, args array<string>, emitted_ms long, expires_ms long"
#: Folders of the log after which it is folded into a new base.
FOLD_AFTER = 20


class FactStore:
    """The facts in a folder that all machines share."""

    def __init__(self, spark: SparkSession, folder: str) -> None:
        self.spark, self.folder = spark, folder.rstrip("/")
        path = spark._jvm.org.apache.hadoop.fs.Path(self.folder)
        self._system = path.getFileSystem(spark._jsc.hadoopConfiguration())

    def _path(self, name: str):
        return self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.folder}/{name}")

    def _whole(self, kind: str) -> list[str]:
        """The folders of a kind that were written to their end."""
        at = self._path(kind)
        if not self._system.exists(at):
            return []
        names = [f.getPath().getName() for f in self._system.listStatus(at)]
        return sorted(n for n in names if self._system.exists(self._path(f"{kind}/{n}/_SUCCESS")))

    def _folded(self) -> tuple[str | None, set[str]]:
        """The last base, and the log folders that are in it."""
        bases = self._whole("base")
        if not bases:
            return None, set()
        listed = self.spark.read.text(f"{self.folder}/base/{bases[-1]}/log").collect()  # at most FOLD_AFTER names for each fold
        return bases[-1], {r[0] for r in listed}

    def read(self, writer: str | None = None, batch: int | None = None) -> DataFrame:
        """Every fact with its last emission; for a batch of a writer without what that batch and later ones may have written before."""
        base, done = self._folded()
        paths = [f"{self.folder}/log/{n}" for n in self._whole("log") if n not in done and not (n.split("@")[0] == writer and int(n.split("@")[1]) >= batch)]
        paths += [f"{self.folder}/base/{base}/facts"] if base else []
        rows = self.spark.read.schema(SCHEMA).parquet(*paths) if paths else self.spark.createDataFrame([], SCHEMA)
        return self._last(rows)

    @staticmethod
    def _last(rows: DataFrame) -> DataFrame:
        last = F.max(F.struct("emitted_ms", F.coalesce("expires_ms", F.lit((1 << 63) - 1)).alias("until"), "expires_ms")).alias("last")
        return rows.groupBy("tenant_id", "fact", "args").agg(last).select("tenant_id", "fact", "args", "last.emitted_ms", "last.expires_ms")

    def write(self, facts: DataFrame, writer: str, batch: int) -> None:
        """What a batch emits; the same batch again replaces it."""
        if "@" in writer:
            raise ValueError(f"{writer}: a writer's name has no @")
        own = self._last(facts.select(F.col("tenant_id").cast("string").alias("tenant_id"), "fact", "args", "emitted_ms", "expires_ms"))
        own.write.mode("overwrite").parquet(f"{self.folder}/log/{writer}@{batch}")

    def fold(self, keep_ms: int = 86_400_000, least: int = FOLD_AFTER) -> None:
        """Folds a log of `least` folders or more into a new base, without facts that expired keep_ms before the last emission. Call it from
        one place, while no batch runs; the folders that a base holds go when the next one is whole."""
        base, done = self._folded()
        log = self._whole("log")
        if len([n for n in log if n not in done]) < least:
            return
        for name in done:
            self._system.delete(self._path(f"log/{name}"), True)
        rows = self.read()
        now = rows.agg(F.max("emitted_ms")).first()[0]
        live = rows if now is None else rows.filter(F.col("expires_ms").isNull() | (F.col("expires_ms") > F.lit(now - keep_ms)))
        name = f"{int(base) + 1 if base else 0:012d}"
        live.write.mode("overwrite").parquet(f"{self.folder}/base/{name}/facts")
        self.spark.createDataFrame([(n,) for n in log if n not in done], "name string").coalesce(1).write.mode("overwrite").text(f"{self.folder}/base/{name}/log")
        self._system.create(self._path(f"base/{name}/_SUCCESS"), True).close()
        for old in [n for n in self._whole("base") if n < name]:
            self._system.delete(self._path(f"base/{old}"), True)


def _asks_for_facts(condition: Condition) -> bool:
    return any(c.spec[:1] == ("has_fact",) for c in condition.calls)


def split(rule: Rule) -> tuple[Rule, Rule]:
    """The rule up to its first condition that asks for a fact, which runs on the stream, and what it asks from there on, which runs on each
    micro-batch. Calls with memory belong before facts."""
    where = [c for w in rule.where for c in conjuncts(w)]
    n = next((i for i, c in enumerate(where) if _asks_for_facts(c)), len(where))
    first = Rule(rule.rule_id, rule.name, rule.sources, on=rule.on, within=rule.within, ordered=rule.ordered, where=tuple(where[:n]), dialect=rule.dialect)
    rest = replace(rule, where=tuple(where[n:]))
    later = [*rest.where, *(e for _, e in rest.let), *(c for _, c in rest.modifiers), *rest.require, *(b.condition for b in rest.respond if b.condition is not None)]
    if any(c.spec and c.spec[0] != "has_fact" for x in later for c in x.calls):
        raise ValueError(f"{rule.rule_id}: rate, rare and first_seen stand in `where`, before the first has_fact")
    return first, rest


def run_stream(rule: Rule, events: DataFrame, store: FactStore, checkpoint: str, deliver: Callable[[DataFrame, int], None], fields: Fields = Fields(), tables: Callable[[], dict[str, dict[str, DataFrame]]] | None = None, **how) -> StreamingQuery:
    """Starts the rule over a stream: each micro-batch's alerts go to deliver(alerts, batch), then what they emit goes into the store, where
    this and all other rules find it in their next micro-batch. deliver may see a batch twice after a failure, with the same alert ids.

    tables() gives what conditions after the first has_fact look up, {"sets": {...}, "baselines": {...}}, anew for each batch (see
    sources.reference); how goes to rule_stream.
    """
    first, rest = split(rule)
    trigger = how.pop("trigger", {"availableNow": True})
    matched = pipelines.rule_stream(first, events, fields, **how).select(*(s.alias for s in rule.sources))

    def each(batch: DataFrame, n: int) -> None:
        batch.persist()
        try:
            now = tables() if tables else {}
            context = rules.context_of(rest, fields, now.get("sets"), now.get("baselines"), store.read(rule.rule_id, n))
            alerts = rules.alerts_of(rest, batch, context, fields)
            deliver(alerts, n)
            if rule.emit:
                store.write(rules.facts(rule, alerts, fields), rule.rule_id, n)
        finally:
            batch.unpersist()

    return matched.writeStream.foreachBatch(each).option("checkpointLocation", checkpoint).trigger(**trigger).start()
