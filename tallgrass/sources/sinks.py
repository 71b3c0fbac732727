"""Where results go: a chain of writers that tells failures apart, with retries, a breaker for each, and a dead-letter folder.

A writer takes the rows of a micro-batch and the batch's number, and must make a batch that it gets again replace what it wrote before; the
ones here do. So a batch that was half written, tried again, or run again after a failure of the driver is there once.
"""

from __future__ import annotations

import random
import time
from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

Writer = Callable[[DataFrame, int], None]


class PermanentError(Exception):
    """The sink refuses these rows, and will again: trying again is no use."""


class Refused(Exception):
    """No writer took the batch, and there is no place for dead letters."""


def json_lines(path: str) -> Writer:
    """JSON lines, a folder a batch."""
    return lambda rows, batch: rows.write.mode("overwrite").json(f"{path}/batch={batch}")


def jdbc(url: str, name: str, batch_column: str = "batch_id", **options: str) -> Writer:
    """Rows of a database table with their batch's number; rows of the batch that are there go first."""

    def write(rows: DataFrame, batch: int) -> None:
        spark = rows.sparkSession
        manager = spark._jvm.java.sql.DriverManager
        connection = manager.getConnection(url, options.get("user"), options.get("password")) if "user" in options else manager.getConnection(url)
        try:
            if connection.getMetaData().getTables(None, None, name, None).next():
                connection.createStatement().executeUpdate(f"DELETE FROM {name} WHERE {batch_column} = {int(batch)}")
        finally:
            connection.close()
        rows.withColumn(batch_column, F.lit(batch)).write.mode("append").format("jdbc").options(url=url, dbtable=name, **options).save()

    return write


def is_permanent(error: Exception) -> bool:
    """Faults of the rows or of the query; anything else, such as a sink that does not answer, may pass."""
    from pyspark.errors import AnalysisException, IllegalArgumentException

    return isinstance(error, (PermanentError, AnalysisException, IllegalArgumentException, TypeError, ValueError))


@dataclass
class Breaker:
    """Opens for open_s seconds after `threshold` failures in a row; then one try decides. It lives on the driver, across micro-batches."""

    threshold: int = 5
    open_s: float = 30.0
    clock: Callable[[], float] = time.monotonic
    failures: int = 0
    opened: int = 0
    until: float | None = None

    def allows(self) -> bool:
        if self.until is not None and self.clock() < self.until:
            return False
        self.until = None
        return True

    def succeeded(self) -> None:
        self.failures, self.until = 0, None

    def failed(self) -> None:
        self.failures += 1
        if self.failures >= max(1, self.threshold):
            self.failures, self.until = 0, self.clock() + self.open_s
            self.opened += 1


@dataclass
class Retries:
    """Tries of one batch at one sink; the pause doubles from first_s to most_s, with up to half of it added at random."""

    attempts: int = 3
    first_s: float = 0.2
    most_s: float = 10.0
    sleep: Callable[[float], None] = time.sleep
    random: random.Random = field(default_factory=random.Random)

    def pause(self, attempt: int) -> float:
        delay = min(self.most_s, self.first_s * 2**attempt)
        return delay + self.random.uniform(0, delay / 2)


@dataclass
class Sink:
    """A writer with its breaker; counts what happened."""

    name: str
    writer: Writer
    retries: Retries = field(default_factory=Retries)
    breaker: Breaker = field(default_factory=Breaker)
    permanent: Callable[[Exception], bool] = is_permanent
    written: int = 0
    retried: int = 0

    def take(self, rows: DataFrame, batch: int) -> str | None:
        """None if the batch is written, else why not."""
        if not self.breaker.allows():
            return f"{self.name}: circuit is open"
        for attempt in range(max(1, self.retries.attempts)):
            try:
                self.writer(rows, batch)
            except Exception as error:
                last = self.permanent(error) or attempt + 1 >= self.retries.attempts
                if last:
                    self.breaker.failed()
                    return f"{self.name}: {type(error).__name__}: {error}"[:500]
                self.retried += 1
                self.retries.sleep(self.retries.pause(attempt))
            else:
                self.breaker.succeeded()
                self.written += 1
                return None


def with_fallback(sinks: list[Sink], dead_letters: str | None) -> Writer:
    """Each sink in turn, until one takes the batch; what none takes goes to the dead-letter folder with the reasons, or, without one,
    fails the micro-batch, which then comes again. The batch is kept while it is tried, and recomputed if an executor goes."""

    def write(rows: DataFrame, batch: int) -> None:
        rows = rows.persist()
        reasons = []
        try:
            for sink in sinks:
                reason = sink.take(rows, batch)
                if reason is None:
                    return
                reasons.append(reason)
            if dead_letters is None:
                raise Refused("; ".join(reasons))
            json_lines(dead_letters)(rows.withColumn("reason", F.lit("; ".join(reasons))), batch)
        finally:
            rows.unpersist()

    return write


def stream_to(rows: DataFrame, writer: Writer, checkpoint: str, trigger: str | None = None) -> StreamingQuery:
    """Starts a streaming query into the writer."""
    out = rows.writeStream.option("checkpointLocation", checkpoint).foreachBatch(writer)
    return (out.trigger(processingTime=trigger) if trigger else out.trigger(availableNow=True)).start()


def prometheus(counters: DataFrame, name: str) -> DataFrame:
    """counters(le, n) as lines of text exposition."""
    return counters.select(F.concat(F.lit(f'{name}_bucket{{le="'), "le", F.lit('"} '), F.col("n").cast("string")).alias("value"))
