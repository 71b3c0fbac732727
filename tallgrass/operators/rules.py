"""Detection rules as DataFrame pipelines: sources, correlation, filters, derived values, score, facts and responses.

A rule's conditions and values are expressions over its aliases (`field("e.value") > 100`, see conditions), which become Columns, so
Catalyst pushes the parts on one alias below the join, prunes columns and compiles the rest. `run` works on a table; for streams see
streaming.pipelines.rule_stream.
"""

from __future__ import annotations

from dataclasses import dataclass, field, replace
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallgrass.functions import numeric
from tallgrass.functions.numeric import duration_ms
from tallgrass.functions.text import fnv1a64
from tallgrass.operators import graph
from tallgrass.operators.conditions import Condition, Context, Expression, Field, Names, equal_terms, fields_of, with_calls
from tallgrass.operators.joins import aliased, interval_join, within_of_last
from tallgrass.sources.catalog import Catalog

#: The window of a rule that names none, in milliseconds: a fixed value.
DEFAULT_WINDOW_MS = 300_000
#: Severity by score where no branch of the response applies: fixed values.
SEVERITY_BY_SCORE = ((80, "critical"), (60, "high"))


@dataclass(frozen=True)
class Source:
    alias: str
    kind: str
    filter: Condition | None = None


@dataclass(frozen=True)
class Branch:
    """actions that apply if the condition holds; an action is a name, its argument and, if it has one, a message."""

    condition: Condition | None
    actions: tuple[tuple[str, ...], ...]


@dataclass(frozen=True)
class Fact:
    name: str
    args: tuple[Expression, ...]
    expires: str | None = None


@dataclass(frozen=True)
class Rule:
    rule_id: str
    name: str
    sources: tuple[Source, ...]
    #: What the sources are joined by: pairs of fields, as alias.field, or a condition, whose equal terms become keys while the rest is
    #: checked in the join. Empty, or where none of an event's key fields is known: the same entity.
    on: tuple[tuple[str, str], ...] | Condition = ()
    within: str | None = None
    ordered: bool = False
    #: A pattern of edges between the sources, which are then vertices: (alias, kind of edge or None, alias). See graph_alerts.
    graph: tuple[tuple[str, str | None, str], ...] = ()
    where: tuple[Condition, ...] = ()
    let: tuple[tuple[str, Expression], ...] = ()
    base: int = 0
    modifiers: tuple[tuple[int, Condition], ...] = ()
    require: tuple[Condition, ...] = ()
    emit: tuple[Fact, ...] = ()
    respond: tuple[Branch, ...] = ()
    #: Paths that a rule wants verified; reported, never evaluated.
    verify: tuple[str, ...] = field(default=())
    #: How values compare: "central", or "agent", where every order is one of numbers.
    dialect: str = "central"


@dataclass(frozen=True)
class Fields:
    """Names of the columns of the events that a rule needs."""

    kind: str = "event_type"
    time_ms: str = "ts_ms"
    arrival: str = "event_id"
    #: Fields that are equal where a rule names none, such as host and process.
    entities: tuple[str, ...] = ("user_id",)
    tenant: str = "tenant_id"
    #: What names mean beside the columns themselves.
    catalog: Catalog | None = None


def _checked(condition: Condition) -> Condition:
    if not isinstance(condition, Condition):
        raise TypeError(f"{condition!r} is no condition: write it with conditions.field")
    return condition


def _truth(condition: Condition, names: Names) -> Column:
    return _checked(condition).column(names)


def terms_of(rule: Rule) -> tuple[list[tuple[Field, Field]], list[Condition]]:
    """The equalities that a rule's sources are joined by, and what its `on` asks for beside them."""
    if isinstance(rule.on, Condition):
        if rule.on.calls:
            raise ValueError(f"{rule.on}: calls have no place in `on`")
        return equal_terms(rule.on)
    return [(Field(a), Field(b)) for a, b in rule.on], []


def fields_read(rule: Rule) -> list[str]:
    """The names of all fields that a rule's join, conditions and values read."""
    terms, rest = terms_of(rule)
    parts = [f for t in terms for f in t] + rest + [s.filter for s in rule.sources if s.filter is not None] + list(rule.where) + [e for _, e in rule.let]
    parts += [c for _, c in rule.modifiers] + list(rule.require) + [a for f in rule.emit for a in f.args] + [b.condition for b in rule.respond if b.condition is not None]
    return fields_of(*parts)


def _rendered(key: Column, kind: str) -> Column:
    """A key as it is compared: as text, whole numbers alike whatever their type, null as a mark of its own, so that it meets null."""
    if kind == "float":
        whole = key.cast("double").try_cast("decimal(20,0)")
        key = F.when(whole.cast("double") == key, whole.cast("string")).otherwise(key.cast("double").cast("string"))
    return F.coalesce(key.cast("string"), F.lit("\0null"))


def join_key(keys: list[tuple[Column, str]], tenant: Column, entity: list[Column]) -> Column:
    """One text for the fields (column, kind) that an event joins by. If none of them is known, or there are none, the entity's: else all
    events without them would meet."""
    text = lambda parts: F.concat_ws("\x1f", *parts)
    own = text([F.lit("\0entity"), *(_rendered(e, "any") for e in entity)])
    if keys:
        known = reduce(lambda a, b: a | b, (k.isNotNull() for k, _ in keys))
        own = F.when(known, text([F.lit("\0key"), *(_rendered(k, kind) for k, kind in keys)])).otherwise(own)
    return text([_rendered(tenant, "any"), own])


def terms_between(rule: Rule, joined: list[str], alias: str) -> list[tuple[Field, Field]]:
    """The equal terms of a source and those joined before it; the source's own field second."""
    pairs = [(a, b) if b.alias == alias else (b, a) for a, b in terms_of(rule)[0] if alias in (a.alias, b.alias)]
    return [(a, b) for a, b in pairs if a.alias in joined]


def residue_at(rule: Rule, joined: list[str], alias: str) -> list[Condition]:
    """What `on` asks for beside keys that can be checked once this source is joined: it speaks of it, and of no source to come."""
    aliases = {s.alias for s in rule.sources}
    spoken = lambda c: {n.partition(".")[0] for n in fields_of(c)} & aliases
    return [c for c in terms_of(rule)[1] if alias in (spoken(c) or {rule.sources[-1].alias}) and spoken(c) <= {*joined, alias}]


def correlated(rule: Rule, events: DataFrame, fields: Fields = Fields(), include_self: bool = False, lookups: Context | None = None) -> DataFrame:
    """One struct column an alias. Tuples are of one tenant; without `on`, of one entity; of two sources at most the window apart, of
    more each within the window of the last to arrive. An event does not pair with itself, unless include_self."""

    def side(s: Source) -> DataFrame:
        # a source's own filter speaks of its alias
        own = aliased(events.filter(F.col(fields.kind) == s.kind), s.alias)
        if s.filter is None:
            return own
        context = context_of(Rule(rule.rule_id, rule.name, (s,), dialect=rule.dialect), fields, *((lookups.sets, lookups.baselines, lookups.facts) if lookups else ()))
        context = replace(context, calls=lookups.calls if lookups else None)
        own = with_calls(own, s.filter, context)
        return own.filter(_truth(s.filter, context.names(own))).select(s.alias)

    def names(rows: DataFrame) -> Names:
        return Names(rows, tuple((s.alias, s.kind) for s in rule.sources), fields.catalog, rule.dialect)

    rows = side(rule.sources[0])
    window = duration_ms(rule.within) if rule.within else DEFAULT_WINDOW_MS
    joined = [rule.sources[0].alias]
    reach = window if len(rule.sources) == 2 else 2 * window
    for s in rule.sources[1:]:
        given, right = terms_between(rule, joined, s.alias), side(s)
        anchor = given[0][0].alias if given else joined[0]
        entity = lambda alias: [F.col(f"{alias}.{e}") for e in fields.entities]
        left_names, right_names = names(rows), names(right)
        pair = (
            join_key([a.typed(left_names) for a, _ in given], F.col(f"{anchor}.{fields.tenant}"), entity(anchor)),
            join_key([b.typed(right_names) for _, b in given], F.col(f"{s.alias}.{fields.tenant}"), entity(s.alias)),
        )
        rows = interval_join(rows, right, [pair], F.col(f"{anchor}.{fields.time_ms}"), F.col(f"{s.alias}.{fields.time_ms}"), reach, rule.ordered)
        for condition in residue_at(rule, joined, s.alias):
            rows = rows.filter(_truth(condition, names(rows)))
        if not include_self:
            for other in joined:
                rows = rows.filter(F.col(f"{other}.{fields.arrival}") != F.col(f"{s.alias}.{fields.arrival}"))
        joined.append(s.alias)
    if len(joined) > 2:
        rows = rows.filter(within_of_last([(F.col(f"{a}.{fields.time_ms}"), F.col(f"{a}.{fields.arrival}")) for a in joined], window))
    return rows


def context_of(rule: Rule, fields: Fields = Fields(), sets: dict[str, DataFrame] | None = None, baselines: dict[str, DataFrame] | None = None, facts: DataFrame | None = None) -> Context:
    """What the calls of a rule ask for. A tuple's time is the latest of its events, its arrival that of the last to arrive."""
    of = lambda name: [F.col(f"{s.alias}.{name}") for s in rule.sources]
    most = lambda name: reduce(F.greatest, of(name)) if len(rule.sources) > 1 else of(name)[0]
    arrival = F.struct(most(fields.arrival), *(c.alias(f"_{i}") for i, c in enumerate(of(fields.arrival))))
    sources = tuple((s.alias, s.kind) for s in rule.sources)
    return Context(F.col(f"{rule.sources[0].alias}.{fields.tenant}"), most(fields.time_ms), arrival, sets or {}, baselines or {}, facts, sources, fields.catalog, rule.dialect)


def scored(rule: Rule, rows: DataFrame, context: Context | None = None) -> DataFrame:
    """where, then let by let, score and require; what `where` says cannot see lets. A call is evaluated over the rows that have passed the
    conditions before it. The score stops at the ends of 32 bits."""
    context = context or context_of(rule)

    def filtered(rows: DataFrame, condition: Condition) -> DataFrame:
        rows = with_calls(rows, _checked(condition), context)
        return rows.filter(_truth(condition, context.names(rows)))

    for condition in rule.where:
        rows = filtered(rows, condition)
    for name, expression in rule.let:
        rows = with_calls(rows, expression, context)
        rows = rows.withColumn(name, expression.column(context.names(rows)))
    for _, condition in rule.modifiers:
        rows = with_calls(rows, condition, context)
    low, high = F.lit(-(1 << 31)), F.lit((1 << 31) - 1)
    score = F.lit(rule.base).cast("long")
    names = context.names(rows)
    for delta, condition in rule.modifiers:
        score = F.greatest(low, F.least(high, score + F.when(_truth(condition, names), F.lit(delta)).otherwise(F.lit(0))))
    rows = rows.withColumn("score", score.cast("int"))
    for condition in rule.require:
        rows = filtered(rows, condition)
    return rows


def severity_of(score: Column) -> Column:
    out = F.lit("medium")
    for least, name in reversed(SEVERITY_BY_SCORE):
        out = F.when(score >= least, name).otherwise(out)
    return out


_ACTION = "array<struct<action:string,argument:string,message:string>>"


def answered(rule: Rule, rows: DataFrame, context: Context | None = None) -> DataFrame:
    """actions of the first branch that applies; severity is the one of its first alert, high if it has none, by score if no branch applies;
    message is that of its first alert with a message, else the rule's name;
    block_egress and block_query tell whether these are among the actions."""
    none, names = F.array().cast(_ACTION), (context or context_of(rule)).names(rows)
    actions = none
    for b in reversed(rule.respond):
        own = F.array(*(F.struct(*(F.lit(x).cast("string").alias(n) for x, n in zip((*a, None)[:3], ("action", "argument", "message"), strict=True))) for a in b.actions)) if b.actions else none
        actions = F.when(F.lit(True) if b.condition is None else _truth(b.condition, names), own).otherwise(actions)
    rows = rows.withColumn("actions", actions)
    alert = F.get(F.filter("actions", lambda a: a["action"] == "alert"), 0)["argument"]
    message = F.get(F.filter("actions", lambda a: (a["action"] == "alert") & a["message"].isNotNull()), 0)["message"]
    severity = F.when(F.size("actions") == 0, severity_of(F.col("score"))).otherwise(F.coalesce(alert, F.lit("high")))
    has = lambda name: F.exists("actions", lambda a: a["action"] == name)
    return rows.withColumns({"severity": severity, "message": F.coalesce(message, F.lit(rule.name)), "block_egress": has("block_egress"), "block_query": has("block_query")})


def alert_id(rule_id: str, tenant: Column, identities: list[Column]) -> Column:
    """alt_<rule>_<64-bit hash of rule, tenant and the events' identities in order>: the same events give the same id on a replay."""
    named = F.array_sort(F.array(*identities))
    text = F.concat(F.lit(f"{rule_id}\x1f"), tenant.cast("string"), F.array_join(F.transform(named, lambda x: F.concat(F.lit("\x1e"), x)), ""))
    return F.concat(F.lit(f"alt_{rule_id}_"), fnv1a64(text))


def facts(rule: Rule, rows: DataFrame, fields: Fields = Fields(), keep: tuple[str, ...] = ()) -> DataFrame:
    """tenant_id, fact, args, emitted_ms, expires_ms of every fact that the alerts of rows emit, beside the expressions in keep."""
    context = context_of(rule, fields)
    names, out = context.names(rows), []
    if not rule.emit:
        none = F.lit(None).cast("string")
        return rows.filter("false").select(*map(F.expr, keep), context.tenant.alias("tenant_id"), none.alias("fact"), F.array(none).alias("args"), context.now_ms.alias("emitted_ms"), context.now_ms.alias("expires_ms"))
    for f in rule.emit:
        now = context.now_ms
        expires = numeric.add(now, F.lit(duration_ms(f.expires)).cast("long")) if f.expires else F.lit(None).cast("long")
        args = F.array(*(a.column(names).cast("string") for a in f.args))
        out.append(rows.select(*map(F.expr, keep), context.tenant.alias("tenant_id"), F.lit(f.name).alias("fact"), args.alias("args"), now.alias("emitted_ms"), expires.alias("expires_ms")))
    return reduce(lambda a, b: a.unionByName(b), out)


def alerts_of(rule: Rule, rows: DataFrame, context: Context, fields: Fields = Fields()) -> DataFrame:
    """The alerts of tuples that have passed the rule's join, see run."""
    rows = scored(rule, rows, context)
    for b in rule.respond:
        rows = rows if b.condition is None else with_calls(rows, b.condition, context)
    rows = answered(rule, rows, context)
    identities = [F.col(f"{s.alias}.{fields.arrival}").cast("string") for s in rule.sources]
    return rows.withColumns({"rule_id": F.lit(rule.rule_id), "tenant_id": context.tenant, "alert_id": alert_id(rule.rule_id, context.tenant, identities)})


def run(rule: Rule, events: DataFrame, fields: Fields = Fields(), include_self: bool = False, sets: dict[str, DataFrame] | None = None, baselines: dict[str, DataFrame] | None = None, facts: DataFrame | None = None) -> DataFrame:
    """The rule's alerts: alert_id, rule_id, tenant_id, score, severity, actions, flags, message, let values and the matched events."""
    context = context_of(rule, fields, sets, baselines, facts)
    return alerts_of(rule, correlated(rule, events, fields, include_self, context), context, fields)


def graph_alerts(rule: Rule, vertices: DataFrame, edges: DataFrame, fields: Fields = Fields(kind="label", time_ms="last_seen", arrival="id"), **lookups) -> DataFrame:
    """The alerts of a rule over a graph: one for each way its pattern lies in edges(src, dst, kind). Its sources are vertices(id, label,
    last_seen, tenant_id, ...), a source's kind is their label, its filter speaks of its alias; different sources are different vertices,
    of one tenant."""
    context = context_of(rule, fields, **lookups)
    rows = graph.motif(edges, list(rule.graph)).withColumnsRenamed({s.alias: f"__v_{s.alias}" for s in rule.sources})
    first = rule.sources[0].alias
    for s in rule.sources:
        own = aliased(vertices.filter(F.col(fields.kind) == s.kind), s.alias)
        if s.filter is not None:
            own = own.filter(_truth(s.filter, Names(own, ((s.alias, s.kind),), fields.catalog, rule.dialect)))
        rows = rows.join(own, F.col(f"__v_{s.alias}") == F.col(f"{s.alias}.id")).drop(f"__v_{s.alias}")
        if s.alias != first:
            rows = rows.filter(F.col(f"{first}.{fields.tenant}").eqNullSafe(F.col(f"{s.alias}.{fields.tenant}")))
    return alerts_of(rule, rows, context, fields)


def run_all(rules: list[Rule], events: DataFrame, fields: Fields = Fields(), sets: dict[str, DataFrame] | None = None, baselines: dict[str, DataFrame] | None = None, facts_before: DataFrame | None = None) -> DataFrame:
    """Alerts of several rules, in their order, with the matched events as JSON. A rule sees the facts that are given and those that the
    rules before it emit."""
    parts, known = [], facts_before
    for rule in rules:
        rows = run(rule, events, fields, sets=sets, baselines=baselines, facts=known)
        if rule.emit:
            emitted = facts(rule, rows, fields)
            known = emitted if known is None else known.unionByName(emitted)
        matched = F.to_json(F.struct(*(s.alias for s in rule.sources)))
        parts.append(rows.select("alert_id", "rule_id", "tenant_id", "score", "severity", "message", "actions", "block_egress", "block_query", matched.alias("matched")))
    return reduce(lambda a, b: a.unionByName(b), parts)


def counters(rules: list[Rule], events: DataFrame, fields: Fields = Fields(), fallback: str | None = None, facts_before: DataFrame | None = None, **lookups) -> DataFrame:
    """One row: rules_active, events_evaluated, events_ts_fallback (those for which the column `fallback` is true), matches_total (tuples that a
    rule joins), alerts_emitted and facts_active, the facts that have not expired at the last event."""
    late = F.count_if(F.col(fallback)) if fallback else F.lit(0).cast("long")
    seen = events.agg(F.lit(len(rules)).cast("long").alias("rules_active"), F.count(F.lit(1)).alias("events_evaluated"), late.alias("events_ts_fallback"), F.max(fields.time_ms).alias("__now"))
    one = lambda rows, name: rows.select(F.lit(name).alias("what"))
    parts, known = [], facts_before
    for rule in rules:
        context = context_of(rule, fields, facts=known, **lookups)
        joined = correlated(rule, events, fields, lookups=context)
        alerts = alerts_of(rule, joined, context, fields)
        parts += [one(joined, "matches_total"), one(alerts, "alerts_emitted")]
        if rule.emit:
            emitted = facts(rule, alerts, fields)
            known = emitted if known is None else known.unionByName(emitted)
    counted = reduce(lambda a, b: a.unionByName(b), parts).agg(*(F.count_if(F.col("what") == n).alias(n) for n in ("matches_total", "alerts_emitted")))
    row = seen.join(counted)  # one row each
    if known is None:
        return row.withColumn("facts_active", F.lit(0).cast("long")).drop("__now")
    last = known.groupBy("tenant_id", "fact", "args").agg(F.max_by("expires_ms", "emitted_ms").alias("until"), F.count_if(F.col("expires_ms").isNull()).alias("for_good"))
    live = last.join(seen.select("__now")).agg(F.count_if((F.col("for_good") > 0) | (F.col("until") > F.col("__now"))).alias("facts_active"))
    return row.join(live).drop("__now")


def explain(rule: Rule) -> list[tuple[str, str]]:
    """The steps of the rule, in order; DataFrame.explain() shows what Spark makes of them."""
    steps = [("subscribe", f"{s.kind} as {s.alias}") for s in rule.sources]
    steps += [("graph", f"{a} -{kind or 'any'}-> {b}") for a, kind, b in rule.graph]
    steps += [("correlate", " and ".join([f"{a} = {b}" for a, b in terms_of(rule)[0]] + [str(c) for c in terms_of(rule)[1]]) or "same entity"), ("window", rule.within or f"{DEFAULT_WINDOW_MS} ms")] if len(rule.sources) > 1 and not rule.graph else []
    steps += [("filter", str(w)) for w in rule.where] + [("let", f"{n} = {e}") for n, e in rule.let]
    steps += [("score", f"{rule.base}" + "".join(f" {d:+d} if {c}" for d, c in rule.modifiers))] + [("require", str(r)) for r in rule.require]
    steps += [("emit", f"{f.name}({', '.join(map(str, f.args))})") for f in rule.emit] + [("verify", v) for v in rule.verify]
    return steps + [("respond", f"{b.condition or 'otherwise'}: {', '.join(a for a, _ in b.actions)}") for b in rule.respond]
