"""The same operators over streams: state is bounded by watermarks or time to live, and kept in the checkpoint of the query."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import replace
from functools import partial

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from tallgrass.functions.numeric import duration_ms
from tallgrass.operators import aggregates
from tallgrass.operators.joins import within_of_last
from tallgrass.operators.conditions import Names
from tallgrass.operators.rules import DEFAULT_WINDOW_MS, Fields, Rule, Source, alerts_of, context_of, correlated, join_key, residue_at, terms_between
from tallgrass.sources.events import BATCH_SCHEMA
from tallgrass.streaming.calls import SLICE_WINDOWS, STATE_STORE, with_stream_calls

#: How late an event may be: the width of the band in which its own time is trusted.
LATENESS = "24 hours"


def read_batches(spark: SparkSession, path: str, files_per_trigger: int = 100) -> DataFrame:
    """Ingest batches as they arrive as JSON files."""
    return spark.readStream.schema(BATCH_SCHEMA).option("maxFilesPerTrigger", files_per_trigger).json(path)


def read_events(spark: SparkSession, path: str, files_per_trigger: int = 100) -> DataFrame:
    """The event table as a stream of its files."""
    schema = "event_id long, ts timestamp_ntz, user_id long, event_type string, value double, props string"
    rows = spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_trigger).parquet(path)
    return rows.select("event_id", F.col("ts").cast("timestamp").alias("ts"), F.unix_millis(F.col("ts").cast("timestamp")).alias("ts_ms"), "user_id", (F.col("user_id") % 3).alias("tenant_id"), "event_type", "value")


def once_per_batch(batches: DataFrame, time: str = "ingested_at", lateness: str = LATENESS) -> DataFrame:
    """Each (tenant, host, batch id) once; a batch without an id once for its contents."""
    # without an id, a batch is only a repetition of one with the same contents
    contents = F.concat(F.lit("~"), F.sha2(F.to_json(F.struct(*batches.columns)), 256))
    marked = batches.withColumn("__id", F.when(F.trim("batch_id") != "", F.col("batch_id")).otherwise(contents))
    return marked.withWatermark(time, lateness).dropDuplicatesWithinWatermark(["tenant_id", "host_id", "__id"]).drop("__id")


def interval_pairs(left: DataFrame, right: DataFrame, on: Column, left_ts: str, right_ts: str, within: str, lateness: str = LATENESS) -> DataFrame:
    """Stream-stream join of rows at most `within` apart; both sides' state ends with the watermark."""
    left, right = left.withWatermark(left_ts, lateness), right.withWatermark(right_ts, lateness)
    gap = F.expr(f"{right_ts} BETWEEN {left_ts} - INTERVAL {within} AND {left_ts} + INTERVAL {within}")
    return left.join(right, on & gap, "inner")


def _correlated_streams(rule: Rule, events: DataFrame, fields: Fields, time: str, lateness: str) -> DataFrame:
    """Tuples of a rule's sources, one struct column an alias. Each join's state ends with the watermark of the time column."""
    window = duration_ms(rule.within) if rule.within else DEFAULT_WINDOW_MS
    reach = window if len(rule.sources) == 2 else 2 * window
    sources = tuple((s.alias, s.kind) for s in rule.sources)
    name = lambda alias, column: f"{alias}__{column}"

    def side(s: Source) -> DataFrame:
        rows = events.filter(F.col(fields.kind) == s.kind)
        if s.filter is not None:
            marked = rows.withColumn(s.alias, F.struct(*events.columns))
            rows = marked.filter(s.filter.column(Names(marked.select(s.alias), sources, fields.catalog, rule.dialect))).drop(s.alias)
        return rows.toDF(*(name(s.alias, c) for c in events.columns)).withWatermark(name(s.alias, time), lateness)

    def packed(rows: DataFrame, aliases: list[str]) -> DataFrame:
        return rows.select(*(F.struct(*(F.col(name(a, c)).alias(c) for c in events.columns)).alias(a) for a in aliases))

    def keyed(rows: DataFrame, aliases: list[str], own: list, alias: str, key: str) -> DataFrame:
        """rows with their join key; a bound name needs its alias as a struct, which goes again."""
        marked = rows.withColumns({a: F.struct(*(F.col(name(a, c)).alias(c) for c in events.columns)) for a in aliases})
        names = Names(marked.select(*aliases), sources, fields.catalog, rule.dialect)
        column = join_key([f.typed(names) for f in own], F.col(f"{alias}.{fields.tenant}"), [F.col(f"{alias}.{e}") for e in fields.entities])
        return marked.withColumn(key, column).drop(*aliases)

    first, *others = rule.sources
    rows, joined = side(first), [first.alias]
    for n, s in enumerate(others):
        given = terms_between(rule, joined, s.alias)
        anchor_alias = given[0][0].alias if given else joined[0]
        anchor, own = name(anchor_alias, time), name(s.alias, time)
        gap = f"INTERVAL {reach} MILLISECONDS"
        on = F.expr(f"{own} BETWEEN {anchor} - {'INTERVAL 0 SECONDS' if rule.ordered else gap} AND {anchor} + {gap}")
        left = keyed(rows, joined, [a for a, _ in given], anchor_alias, f"__left{n}")
        right = keyed(side(s), [s.alias], [b for _, b in given], s.alias, f"__right{n}")
        on = on & (F.col(f"__left{n}") == F.col(f"__right{n}"))
        for other in joined:
            on = on & (F.col(name(other, fields.arrival)) != F.col(name(s.alias, fields.arrival)))
        rows = left.join(right, on).drop(f"__left{n}", f"__right{n}")
        rest, joined = residue_at(rule, joined, s.alias), [*joined, s.alias]
        for condition in rest:
            marked = rows.withColumns({a: F.struct(*(F.col(name(a, c)).alias(c) for c in events.columns)) for a in joined})
            rows = marked.filter(condition.column(Names(marked.select(*joined), sources, fields.catalog, rule.dialect))).drop(*joined)
    rows = packed(rows, joined)
    if len(joined) > 2:
        rows = rows.filter(within_of_last([(F.col(f"{a}.{fields.time_ms}"), F.col(f"{a}.{fields.arrival}")) for a in joined], window))
    return rows


def rule_stream(rule: Rule, events: DataFrame, fields: Fields = Fields(), time: str = "ts", lateness: str = LATENESS, sets: dict[str, DataFrame] | None = None, baselines: dict[str, DataFrame] | None = None, remember_ms: int | None = None) -> DataFrame:
    """A rule over a stream, of one source or of several that are joined as they come, with the calls that `calls` keeps state for; sets and
    baselines are tables. Rules on facts of other rules run in `facts.run_batches`."""
    parts = [*(s.filter for s in rule.sources if s.filter is not None), *rule.where, *(e for _, e in rule.let), *(c for _, c in rule.modifiers), *rule.require]
    parts += [b.condition for b in rule.respond if b.condition is not None]
    context = replace(context_of(rule, fields, sets, baselines), calls=partial(with_stream_calls, remember_ms=remember_ms))
    spark = events.sparkSession
    if any(c.spec for p in parts for c in p.calls):
        if spark.conf.get("spark.sql.streaming.stateStore.providerClass") != STATE_STORE:
            raise ValueError(f"a rule that remembers needs spark.sql.streaming.stateStore.providerClass = {STATE_STORE}")
        events = events.withWatermark(time, lateness) if len(rule.sources) == 1 else events
    if len(rule.sources) > 1 and any(s.filter is not None and s.filter.calls for s in rule.sources):
        raise ValueError("a source's filter cannot call where streams are joined: put the call into `where`")
    rows = correlated(rule, events, fields, lookups=context) if len(rule.sources) == 1 else _correlated_streams(rule, events, fields, time, lateness)
    return alerts_of(rule, rows, context, fields)


def with_live_facts(events: DataFrame, facts: DataFrame, target: Column, ts: str, longest: str, lateness: str = LATENESS) -> DataFrame:
    """events(tenant_id, ...) for which a fact of the tenant names the target and has not expired; facts(tenant_id, arg, emitted, expires) is a
    stream too. No fact lasts longer than `longest`, so both sides' state ends with the watermark."""
    named = facts.select(F.col("tenant_id").alias("__tenant"), F.col("arg").alias("__arg"), F.col("emitted").alias("__from"), F.col("expires").alias("__to")).withWatermark("__from", lateness)
    live = F.expr(f"{ts} >= __from AND {ts} < __to AND {ts} <= __from + INTERVAL {longest}")
    return events.withWatermark(ts, lateness).join(named, (F.col("tenant_id") == F.col("__tenant")) & (target.cast("string") == F.col("__arg")) & live, "left_semi")


def token_bucket(events: DataFrame, keys: list[str], time_ms: str, arrival: str, capacity: float, per_second: float) -> DataFrame:
    """keys, time, arrival and allowed: each key has a bucket of `capacity` tokens that fills up by per_second; an event takes one, or is refused.
    State is a row of two numbers for each key, for good."""
    names = [*keys, time_ms, arrival]

    def step(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        rows = pd.concat(list(batches)).sort_values([time_ms, arrival])
        tokens, last = state.get if state.exists else (float(capacity), int(rows[time_ms].iloc[0]))
        allowed = []
        for at in rows[time_ms].tolist():
            tokens, last = min(float(capacity), tokens + max(at - last, 0) * per_second / 1000), max(at, last)
            allowed.append(tokens >= 1)
            tokens -= allowed[-1]
        state.update((tokens, last))
        yield rows[names].assign(allowed=allowed)

    kinds = ", ".join(f"{n} {events.schema[n].dataType.simpleString()}" for n in names)
    return events.select(*names).groupBy(*keys).applyInPandasWithState(step, f"{kinds}, allowed boolean", "tokens double, last long", "append", GroupStateTimeout.NoTimeout)


def tumbling_metrics(events: DataFrame, time: str, width: str, keys: list[str], value: str, lateness: str = "1 hour") -> DataFrame:
    return aggregates.metric_summary(events.withWatermark(time, lateness), time, width, keys, value)


def sessions(events: DataFrame, entity: str, time: str, gap: str, lateness: str = "1 hour") -> DataFrame:
    """Spells of activity of an entity, closed by a gap."""
    grouped = events.withWatermark(time, lateness).groupBy(F.session_window(time, gap).alias("w"), entity)
    return grouped.agg(F.count(F.lit(1)).alias("n")).select(entity, F.col("w.start").alias("start"), F.col("w.end").alias("end"), "n")


def novelty(events: DataFrame, keys: list[str], time: str, remember: str | None = None) -> DataFrame:
    """The first event of each key. A key is remembered for good, a row of state a key; or for `remember` after it was last new."""
    return events.dropDuplicates(keys) if remember is None else events.withWatermark(time, remember).dropDuplicatesWithinWatermark(keys)


#: Session states from free to closed; a session only moves up by itself: fixed values.
STATES = ("ACTIVE", "CHALLENGED", "RESTRICTED", "TERMINATED")


def session_states(events: DataFrame, session: str, rank: str, time_ms: str, cooldown_ms: int, idle_ms: int = 86_400_000) -> DataFrame:
    """session, state, changes: the state of each session after its events so far.

    rank is the state that an event asks for (0 to 3). A session moves up at once, down only after cooldown_ms without a move up, and never
    leaves the last state. A session without events for idle_ms of event time is forgotten; events needs a watermark.
    """

    def step(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        now, since, changes = state.get if state.exists else (0, 0, 0)
        rows = pd.concat(list(batches)).sort_values(time_ms)
        for want, at in zip(rows[rank].tolist(), rows[time_ms].tolist(), strict=True):
            if now < len(STATES) - 1 and (want > now or (want < now and at - since >= cooldown_ms)):
                now, since, changes = int(want), int(at), changes + 1
            elif want == now:
                since = max(since, int(at))
        state.update((now, since, changes))
        state.setTimeoutTimestamp(max(int(rows[time_ms].max()), state.getCurrentWatermarkMs()) + idle_ms)
        yield pd.DataFrame({session: [key[0]], "state": [STATES[now]], "changes": [changes]})

    kind = events.schema[session].dataType.simpleString()
    return events.groupBy(session).applyInPandasWithState(step, f"{session} {kind}, state string, changes long", "now int, since long, changes long", "update", GroupStateTimeout.EventTimeTimeout)


#: Groups that the keys of `rates` are dealt into: each is one row of state and one call for many keys.
KEY_GROUPS = 64


def rates(events: DataFrame, key: str, time: str, time_ms: str, window_ms: int, lateness: str = LATENESS, groups: int = KEY_GROUPS) -> DataFrame:
    """Each event with the number of events of its key that have come so far in the window up to its time, across micro-batches.

    State holds the keys' times from a window before the watermark on, so an event that is late counts what its own window holds; later ones
    are dropped. A time is forgotten once the watermark has passed its window. Keys share a group's state by their hash, and a hot key's
    state is split by time slices of `SLICE_WINDOWS` windows: an event is counted in its own slice and, if the next one's first windows
    reach it, remembered there.
    """
    width = window_ms * SLICE_WINDOWS
    own = F.floor(F.col(time_ms) / width)
    text = F.coalesce(F.concat(F.lit("="), F.col(key).cast("string")), F.lit("null")).alias("__key")
    spread = events.withWatermark(time, lateness).select(time, key, text, F.col(time_ms).cast("long").alias("__ms"), F.pmod(F.xxhash64(key), F.lit(groups)).cast("int").alias("__group"), own.alias("__own_slice"))
    here, next_one = F.struct(F.lit(True).alias("own"), F.col("__own_slice").alias("slice")), F.struct(F.lit(False).alias("own"), (F.col("__own_slice") + 1).alias("slice"))
    reaches = F.col("__ms") >= (F.col("__own_slice") + 1) * F.lit(width) - F.lit(window_ms)
    spread = spread.withColumn("__s", F.explode(F.when(reaches, F.array(here, next_one)).otherwise(F.array(here)))).select(time, key, "__key", "__ms", "__group", F.col("__s.own").alias("__own"), F.col("__s.slice").alias("__slice"))

    def step(name: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        rows = pd.concat(list(batches), ignore_index=True)
        at = rows["__ms"].to_numpy(np.int64)
        keys, times = state.get if state.exists else ([], [])
        code, kinds = pd.factorize(np.concatenate((np.array(keys, object), rows["__key"].to_numpy(object))))
        times = np.concatenate((np.array(times, np.int64), at))
        # every key has a stretch of its own on one line, a window apart from the next
        low = int(times.min()) - window_ms
        step_of = int(times.max()) - low + window_ms + 1
        line = code.astype(np.int64) * step_of + (times - low)
        order = np.argsort(line, kind="stable")
        mine = line[len(keys) :]
        count = np.searchsorted(line[order], mine, "right") - np.searchsorted(line[order], mine - window_ms, "left")
        keep = order[times[order] >= max(state.getCurrentWatermarkMs() - window_ms, name[1] * width - window_ms)]
        state.update((kinds[code[keep]].tolist(), times[keep].tolist()))
        state.setTimeoutTimestamp(max(int(times.max()) + window_ms, state.getCurrentWatermarkMs()) + 1)
        here = rows["__own"].to_numpy(bool)
        yield pd.DataFrame({key: rows[key][here], time_ms: at[here], "rate": count[here]})

    kind = events.schema[key].dataType.simpleString()
    return spread.groupBy("__group", "__slice").applyInPandasWithState(step, f"{key} {kind}, {time_ms} long, rate long", "keys array<string>, times array<bigint>", "append", GroupStateTimeout.EventTimeTimeout)
