"""The functions that a rule may call by name, with what they take: `call("unusual_for", field("n.domain"), field("n.host_id"))`.

A name that is not known and a wrong number of arguments are errors when the rule is written. What an argument is, is known when the rule
is bound: the agent dialect gives null, false in a condition, for an argument of another kind than declared; central takes any value as
the text that it writes. Lookups (intel.domains, baseline.image, baseline.workload, host, user) read the sets and baselines of the run.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from tallgrass.functions import numeric
from tallgrass.operators import joins, standard
from tallgrass.operators.conditions import Condition, Expression, Names, _called, as_expression, first_seen, rare, rate

#: What each takes, and gives: fixed values.
SIGNATURES = {
    "count": (("Any",), "Int"), "len": (("Str|Set",), "Int"), "max": (("Set",), "Int"), "min": (("Set",), "Int"), "sum": (("Set",), "Int"), "avg": (("Set",), "Float"), "distinct": (("Set",), "Set"),
    "rate": (("Str", "Duration"), "Int"), "is_shell": (("Process",), "Bool"), "rare": (("Str",), "Bool"), "unusual_for": (("Str", "Str"), "Bool"), "intel.domains": (("Str",), "Set"),
    "baseline.image": (("Str",), "Profile"), "baseline.workload": (("Str", "Str"), "Profile"), "host": (("Str",), "Profile"), "user": (("Str",), "Profile"),
}
ALIASES = {"unusualfor": "unusual_for"}
#: Names under which a feed's set may be known, the first that is there counts: fixed values.
FEED_NAMES = ("{}", "intel.domains.{}", "org.threat_intel.{}")
_TAKES = {"Str": ("str", "attr", "ip"), "Set": ("list",), "Str|Set": ("str", "attr", "ip", "list"), "Any": ()}


def _fits(kind: str, wanted: str) -> bool:
    return not _TAKES[wanted] or kind in (*_TAKES[wanted], "any")


def _text(x: Expression) -> Expression:
    """The value as text; null is the empty text (central) or none at all (agent)."""

    def build(names: Names) -> tuple[Column, str]:
        c, kind = x.typed(names)
        if names.dialect == "agent" and not _fits(kind, "Str"):
            return F.lit(None).cast("string"), "str"
        return (c.cast("string") if names.dialect == "agent" else F.coalesce(c.cast("string"), F.lit(""))), "str"

    return Expression(build, str(x), (x,))


def _there(*xs: Expression) -> Condition:
    """Whether the agent may call: all arguments are texts; central always may."""

    def build(names: Names) -> tuple[Column, str]:
        out = F.lit(True)
        for x in xs if names.dialect == "agent" else ():
            c, kind = x.typed(names)
            out = out & (c.isNotNull() if _fits(kind, "Str") else F.lit(False))
        return out, "bool"

    return Condition(build, f"given({', '.join(map(str, xs))})", xs)


def _length(x: Expression, name: str) -> Expression:
    def build(names: Names) -> tuple[Column, str]:
        c, kind = x.typed(names)
        if kind == "list":
            return F.coalesce(F.when(c.isNotNull(), F.size(c)), F.lit(0)).cast("long"), "int"
        if kind in ("str", "attr", "ip", "any"):
            size = F.octet_length(c) if names.dialect == "central" else F.char_length(c)
            return (F.coalesce(size, F.lit(0)) if names.dialect == "central" or name == "count" else size).cast("long"), "int"
        return (F.lit(0).cast("long") if names.dialect == "central" or name == "count" else F.lit(None).cast("long")), "int"

    return Expression(build, f"{name}({x})", (x,))


def _over_list(x: Expression, name: str) -> Expression:
    def build(names: Names) -> tuple[Column, str]:
        c, kind = x.typed(names)
        if kind != "list":
            return F.lit(None).cast("double"), "float"
        if name == "distinct":
            return F.array_distinct(c), "list"
        return numeric.list_aggregate(F.transform(c, lambda i: i.try_cast("double")), name), "float"

    return Expression(build, f"{name}({x})", (x,))


class Profile:
    """What a baseline knows of an entity: `call("host", field("n.host_id"))["domains"]` is a list, null if the entity is unknown.

    Each list is the table baselines["<name>.<list>"](entity, values)."""

    def __init__(self, name: str, *key: Expression) -> None:
        self.name, self.key = name, key

    def __getitem__(self, part: str) -> Expression:
        table = f"{self.name}.{part}"

        def add(rows, ctx, names, out, keys):
            entity = F.concat_ws("/", *(F.trim(k.column(names).cast("string")) for k in self.key))
            given = F.when(entity != "", entity)
            if table not in ctx.baselines:
                return rows.withColumn(out, F.lit(None).cast("array<string>"))
            return joins.with_baseline(rows, given, ctx.baselines[table], out)

        return _called(f"{self.name}({', '.join(map(str, self.key))}).{part}", add, self.key, "list")


class Feed(Expression):
    """A named set of domains; only ever asked whether it holds a value."""

    def __init__(self, feed: str) -> None:
        super().__init__(lambda n: (F.lit(None), "null"), f"intel.domains({feed})")
        self.feed = feed.strip()

    def holds(self, value: Expression) -> Condition:
        def add(rows, ctx, names, out, keys):
            found = [n.format(self.feed) for n in FEED_NAMES if n.format(self.feed) in ctx.sets]
            return joins.marked_in_set(rows, value.column(names), ctx.sets[found[0]], out) if self.feed and found else rows.withColumn(out, F.lit(False))

        return _called(f"{value} in {self}", add, (value,))


def call(name: str, *args) -> Expression | Profile:
    """A call by name; `rate` takes its window as text ("5m"), is_shell the alias of a process event."""
    known = ALIASES.get(name.strip().lower(), name.strip().lower())
    if known not in SIGNATURES:
        raise ValueError(f"{name} is no callable: {', '.join(sorted(SIGNATURES))}")
    takes, _ = SIGNATURES[known]
    if len(args) != len(takes):
        raise ValueError(f"{name} takes {len(takes)} arguments, not {len(args)}")
    if known == "is_shell":
        return standard.is_shell(args[0])
    if known == "intel.domains":
        return Feed(args[0])
    if known == "rate":
        return rate(_text(as_expression(args[0])), args[1])
    values = tuple(map(as_expression, args))
    if known in ("count", "len"):
        return _length(values[0], known)
    if known == "rare":
        return _there(*values) & rare(_text(values[0]))
    if known == "unusual_for":
        return _there(*values) & first_seen(*map(_text, reversed(values)))
    if known in ("baseline.image", "baseline.workload", "host", "user"):
        return Profile(known, *values)
    return _over_list(values[0], known)
