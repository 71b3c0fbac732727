"""rate, rare and first_seen of a rule over a stream: state by key in the query's checkpoint, the same answers as over a table.

A call is one stateful operator. Its keys are tenant and the call's values, and share a group's state by their hash; rows that its gate does
not let through meet no state. The calls of a rule are asked one after the other, each over the rows that the rule has come to. Within a micro-batch rows are taken in order of time and arrival;
across micro-batches in the order of these. A row is answered in its own micro-batch.

A rate keeps the times of a window before the watermark on, so an event that is late counts what its own window holds. A hot key's times are
split by slices of the time: an event is counted in its own slice and remembered in the next. `rare` keeps one number a key. What the watermark
has left behind is dropped: a rate's times after its last window, a number after `remember`, if that is given; the last by a timer a group.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from tallgrass.operators.conditions import Context, Expression

#: Windows in one time slice of a rate's state.
SLICE_WINDOWS = 24
#: Groups that keys are dealt into: each is one row of state (for a rate, one a slice) and one call for all its keys in a micro-batch.
KEY_GROUPS = {"rate": 256, "rare": 1024}
#: Keeps keyed state of any size on disk; transformWithState runs on no other.
STATE_STORE = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def _memory(names: list[str], out: str, how: str, param: int, keep_ms: int | None, drop: list[str]) -> StatefulProcessor:
    """A class of its own, which travels whole to the process that runs it: that one need not know this package."""

    class Memory(StatefulProcessor):
        """The rows of a group of keys with what the call says to each. rows: __ms, __key, __gate (whether it is asked), __own (whether it is
        answered here), __a0.. (arrival) and more. The group's keys are one row of state, their numbers packed: for a rate the key's place and
        the time of each event, else how often each key was seen, and when last."""

        def init(self, handle: StatefulProcessorHandle) -> None:
            self.handle = handle
            self.state = handle.getValueState("group", "keys array<string>, first binary, second binary")

        def _held(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
            keys, first, second = self.state.get() or ([], b"", b"")
            return np.array([*keys], object), np.frombuffer(first, np.int64), np.frombuffer(second, np.int64)

        def _hold(self, keys: np.ndarray, first: np.ndarray, second: np.ndarray) -> None:
            self.state.update((keys.tolist(), first.astype(np.int64).tobytes(), second.astype(np.int64).tobytes()))

        def _expire(self, last: int, watermark: int) -> None:
            """One timer a group, after its last row."""
            for timer in self.handle.listTimers():
                self.handle.deleteTimer(timer)
            self.handle.registerTimer(max(last + keep_ms, watermark) + 1)

        def _rates(self, asked: np.ndarray, at: np.ndarray, watermark: int) -> np.ndarray:
            keys, codes, times = self._held()
            code, kinds = pd.factorize(np.concatenate((keys, asked)))
            codes, times = np.concatenate((codes, code[len(keys) :])), np.concatenate((times, at))
            # every key has a stretch of its own on one line, a window apart from the next
            low = int(times.min()) - param
            line = codes * (int(times.max()) - low + param + 1) + (times - low)
            mine, line = line[len(line) - len(at) :], np.sort(line)
            keep = times >= watermark - param
            used, place = np.unique(codes[keep], return_inverse=True)
            self._hold(kinds[used], place, times[keep])
            self._expire(int(times.max()), watermark)
            return np.searchsorted(line, mine, "right") - np.searchsorted(line, mine - param, "left")

        def _rare(self, asked: np.ndarray, at: np.ndarray, watermark: int) -> np.ndarray:
            keys, seen, last = self._held()
            if keep_ms is not None:
                live = last + keep_ms >= watermark  # the timer of the group comes after its last key
                keys, seen, last = keys[live], seen[live], last[live]
            code, kinds = pd.factorize(np.concatenate((keys, asked)))
            mine, fresh = code[len(keys) :], np.zeros(len(kinds) - len(keys), np.int64)
            seen, last = np.concatenate((seen, fresh)), np.concatenate((last, fresh))
            order = np.argsort(mine, kind="stable")
            counts = np.bincount(mine, minlength=len(kinds))
            place = np.empty(len(mine), np.int64)
            place[order] = np.arange(len(mine)) - np.repeat(np.cumsum(counts) - counts, counts)
            answer = (seen[mine] + place < param).astype(np.int64)
            np.maximum.at(last, mine, at)
            self._hold(kinds, np.minimum(seen + counts, param), last)
            if keep_ms is not None:
                self._expire(int(last.max()), watermark)
            return answer

        def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
            frame = pd.concat(list(rows), ignore_index=True)
            frame.columns = names  # they come numbered
            arrivals = [c for c in frame.columns if c.startswith("__a")]
            frame = frame.sort_values(["__ms", *arrivals], kind="stable")
            gate, answer = frame["__gate"].to_numpy(bool), np.zeros(len(frame), np.int64)
            if gate.any():
                ask = self._rates if how == "rate" else self._rare
                answer[gate] = ask(frame["__key"].to_numpy(object)[gate], frame["__ms"].to_numpy(np.int64)[gate], timerValues.getCurrentWatermarkInMs())
            mine = frame["__own"].to_numpy(bool)
            yield frame.drop(columns=drop).assign(**{out: answer})[mine]

        def handleExpiredTimer(self, key: tuple, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
            self.state.clear()
            yield from ()

        def close(self) -> None:
            pass

    return Memory()


def _flat(rows: DataFrame) -> tuple[list[Column], list[Column]]:
    """Columns that pass through pandas unharmed (numbers and times as text), and those that make the rows of them again."""
    out, back = [], []

    def there_and_back(column: Column, kind: T.DataType, name: str) -> Column:
        if isinstance(kind, T.StructType):
            fields = [there_and_back(column[f.name], f.dataType, f"{name}__{i}").alias(f.name) for i, f in enumerate(kind)]
            out.append(column.isNotNull().alias(f"{name}__is"))
            return F.when(F.col(f"{name}__is"), F.struct(*fields))
        if isinstance(kind, (T.TimestampType, T.TimestampNTZType)):
            micros = F.unix_micros(column.cast("timestamp")).cast("string")
            out.append(micros.alias(name))
            return F.timestamp_micros(F.col(name).cast("long")).cast(kind)
        if isinstance(kind, (T.NumericType, T.BooleanType, T.DateType)):
            out.append(column.cast("string").alias(name))
            return F.col(name).cast(kind)
        out.append(column.alias(name))
        return F.col(name)

    for i, f in enumerate(rows.schema):
        back.append(there_and_back(F.col(f"`{f.name}`"), f.dataType, f"__p{i}").alias(f.name))
    return out, back


def _remembered(rows: DataFrame, context: Context, name: str, gate: Column, values: list[Column], spec: tuple, remember_ms: int | None) -> DataFrame:
    how, _, param = spec
    payload, back = _flat(rows)
    arrivals = rows.select(context.arrival.alias("at")).schema[0].dataType.names
    key = F.to_json(F.struct(context.tenant.cast("string").alias("tenant"), *(v.cast("string").alias(f"v{i}") for i, v in enumerate(values))))
    keys = [key.alias("__key"), F.coalesce(gate, F.lit(False)).alias("__gate")]
    timed = rows.select(*payload, *keys, context.now_ms.alias("__ms"), *(context.arrival[a].alias(f"__a{i}") for i, a in enumerate(arrivals)))
    # those that are not asked meet no state: they are spread by themselves
    dealt = F.when(F.col("__gate"), F.xxhash64("__key")).otherwise(F.xxhash64("__ms", *(f"__a{i}" for i in range(len(arrivals)))))
    timed = timed.withColumn("__group", F.pmod(dealt, F.lit(KEY_GROUPS[how])).cast("int"))
    if how == "rate":
        width = F.lit(param * SLICE_WINDOWS)
        own = F.floor(F.col("__ms") / width)
        here, next_one = F.struct(own.alias("slice"), F.lit(True).alias("own")), F.struct((own + 1).alias("slice"), F.lit(False).alias("own"))
        # in the next slice only times that its first windows reach count
        reaches = F.col("__gate") & (F.col("__ms") >= (own + 1) * width - F.lit(param))
        timed = timed.withColumn("__s", F.explode(F.when(reaches, F.array(here, next_one)).otherwise(F.array(here)))).select("*", F.col("__s.slice").alias("__slice"), F.col("__s.own").alias("__own")).drop("__s")
    else:
        timed = timed.withColumns({"__slice": F.lit(0).cast("long"), "__own": F.lit(True)})
    drop = ["__key", "__gate", "__group", "__slice", "__own", "__ms", *(f"__a{i}" for i in range(len(arrivals)))]
    kept = T.StructType([T.StructField(f.name, f.dataType, True) for f in timed.schema if f.name not in drop])
    processor = _memory(timed.columns, name, how, param, param if how == "rate" else remember_ms, drop)
    found = timed.groupBy("__group", "__slice").transformWithStateInPandas(processor, kept.add(name, T.LongType()), "append", "EventTime")
    answer = F.col(name) if how == "rate" else F.col(name) == 1
    return found.select(*back, answer.alias(name))


def with_stream_calls(rows: DataFrame, expression: Expression, context: Context, remember_ms: int | None = None) -> DataFrame:
    """rows, a stream with a watermark, with a column for each call of the expression that they do not have yet."""
    for call in expression.calls:
        if call.name in rows.columns:
            continue
        names = context.names(rows)
        if not call.spec:
            rows = call.add(rows, context, names, call.name, [])  # a lookup in a table
            continue
        if call.spec[0] == "has_fact":
            raise ValueError("facts change while a stream runs: use streaming.facts")
        gate = F.lit(True) if call.gate is None else call.gate.column(names)
        rows = _remembered(rows, context, call.name, gate, [v.column(names) for v in call.spec[1]], call.spec, remember_ms)
    return rows
