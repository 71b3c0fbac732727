"""What rules say, as trees of Python expressions over fields: `(field("e.uid") != 0) & ~field("e.path").under("/usr")`.

An expression is built before there is a session. When a rule runs, it is bound to the rows at hand: names are looked up (see
sources.catalog), every operand gets a kind, and each comparison is chosen by both kinds, so values of unlike kinds are parsed or unequal,
never an error. Every condition is only ever true or false (see twovalued): null differs from 0, `~` of an unknown comparison is true, an
order with null is false. Being trees, conditions can be read: `conjuncts`, `equal_terms` and `fields_of` tell a rule what it joins on and
what it reads. Named predicates are Python functions and variables (operators.standard has some), named sets are looked up by name.

Calls depend on other rows or tables: rate, rare, first_seen, in a named set, known to a baseline, has_fact. A rule evaluates a call over
the rows that pass all that stands before it: the conditions before, the conjuncts to its left, and, behind `|`, the rows for which
the left side is false. All rows go through one plan; the rows that do not count are kept apart by the key of the call's state.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field as _field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tallgrass.functions import numeric, twovalued
from tallgrass.functions.numeric import duration_ms
from tallgrass.operators import joins, stateful
from tallgrass.sources.catalog import Catalog


class Names:
    """What names mean for some rows: their columns, the aliases with their source kinds in order, the catalog and the dialect."""

    def __init__(self, rows: DataFrame, sources: tuple[tuple[str, str], ...] = (), catalog: Catalog | None = None, dialect: str = "central") -> None:
        self.rows, self.sources, self.catalog, self.dialect = rows, sources, catalog, dialect
        self.schema = rows.schema

    def kind(self, column: Column) -> str:
        """The kind of a column that is no plain field, as Spark's analysis gives it."""
        return twovalued.kind_of(self.rows.select(column.alias("x")).schema[0].dataType)

    def _struct(self, alias: str) -> T.StructType | None:
        found = [f.dataType for f in self.schema if f.name == alias]
        return found[0] if found and isinstance(found[0], T.StructType) else None

    def _path(self, column: Column, kind: T.DataType, path: str) -> tuple[Column, str] | None:
        for part in path.split("."):
            if not isinstance(kind, T.StructType) or part not in kind.names:
                return None
            column, kind = column[part], kind[part].dataType
        return column, twovalued.kind_of(kind)

    def _of_source(self, alias: str, source_kind: str, name: str, attributes: bool) -> tuple[Column, str] | None:
        struct = self._struct(alias)
        entry = self.catalog.entry(source_kind, name) if self.catalog and struct else None
        if entry and (not isinstance(entry.read, str) or entry.read in struct.names):
            return entry.column(F.col(alias)), entry.kind
        plain = self._path(F.col(alias), struct, name) if struct else None
        if plain or not (attributes and self.catalog and self.catalog.attrs and struct and self.catalog.attrs in struct.names):
            return plain
        return F.try_element_at(F.col(alias)[self.catalog.attrs], F.lit(name)), "attr"

    def find(self, name: str) -> tuple[Column, str]:
        """Column and kind: alias.path, then a value of the rows themselves, then the first source that has it and is not null."""
        alias, _, rest = name.partition(".")
        source_kind = dict(self.sources).get(alias, "")
        if rest and self._struct(alias) is not None and (found := self._of_source(alias, source_kind, rest, True)):
            return found
        if name in self.schema.names:
            return F.col(f"`{name}`"), twovalued.kind_of(self.schema[name].dataType)
        found = [x for s, k in self.sources if (x := self._of_source(s, k, name, False))] or [x for s, k in self.sources if (x := self._of_source(s, k, name, True))]
        if found:
            kinds = {k for _, k in found}
            return F.coalesce(*(c for c, _ in found)) if len(kinds) == 1 else found[0][0], found[0][1]
        if self.catalog:
            return F.lit(None), "null"
        return F.col(name), "any"


@dataclass(frozen=True)
class Context:
    """What calls may ask for: the matched rows' tenant, time, arrival; sets (entry), baselines (entity, values) and facts; and what names mean."""

    tenant: Column
    now_ms: Column
    arrival: Column
    sets: dict[str, DataFrame] = _field(default_factory=dict)
    baselines: dict[str, DataFrame] = _field(default_factory=dict)
    facts: DataFrame | None = None
    sources: tuple[tuple[str, str], ...] = ()
    catalog: Catalog | None = None
    dialect: str = "central"
    #: What adds the calls' columns, if not `with_calls` itself.
    calls: Callable[[DataFrame, Expression, Context], DataFrame] | None = None

    def names(self, rows: DataFrame) -> Names:
        return Names(rows, self.sources, self.catalog, self.dialect)


@dataclass(frozen=True)
class Call:
    """A column that a rule adds to its rows before it evaluates the condition that asks for it. add(rows, context, names, column, keys):
    rows that differ in one of the keys are nothing to each other."""

    name: str
    gate: Condition | None
    add: Callable[[DataFrame, Context, Names, str, list[Column]], DataFrame]
    #: What a stream needs to know to do the same: (function, its arguments, its parameter).
    spec: tuple = ()


class Expression:
    """A value over the fields of the matched events: how it is made of its parts, given the kinds of these."""

    def __init__(self, typed: Callable[[Names], tuple[Column, str]], text: str, parts: tuple[Expression, ...] = (), calls: tuple[Call, ...] | None = None) -> None:
        self.typed, self.text, self.parts = typed, text, parts
        self.calls = tuple(c for p in parts for c in p.calls) if calls is None else calls

    def column(self, names: Names) -> Column:
        return self.typed(names)[0]

    def __repr__(self) -> str:
        return self.text

    __hash__ = object.__hash__

    def _compare(self, sign: str, other) -> Condition:
        return Comparison(sign, self, as_expression(other))

    def __eq__(self, other) -> Condition:  # type: ignore[override]
        return self._compare("==", other)

    def __ne__(self, other) -> Condition:  # type: ignore[override]
        return self._compare("!=", other)

    def __lt__(self, other) -> Condition:
        return self._compare("<", other)

    def __gt__(self, other) -> Condition:
        return self._compare(">", other)

    def __le__(self, other) -> Condition:
        return self._compare("<=", other)

    def __ge__(self, other) -> Condition:
        return self._compare(">=", other)

    def between(self, low, high) -> Condition:
        return (self >= low) & (self <= high)

    def is_in(self, items) -> Condition:
        """Among the items by ==: a list of values, an expression that is a list, or a feed; nothing is in a null list."""
        if hasattr(items, "holds"):
            return items.holds(self)
        if isinstance(items, Expression):
            return Condition(lambda n: (_in_list(*self.typed(n), *items.typed(n)), "bool"), f"{self} in {items}", (self, items))

        def test(names: Names) -> tuple[Column, str]:
            x, kind = self.typed(names)
            alike = [i for i in items if twovalued.kind_of_value(i) == kind and kind in ("int", "str", "bool") and names.dialect == "central"]
            rest = [i for i in items if not any(i is j for j in alike)]
            out = F.coalesce(x.isin(alike), F.lit(False)) if alike else F.lit(False)
            for i in rest:
                out = out | twovalued.equal(x, kind, F.lit(i), twovalued.kind_of_value(i), names.dialect)
            return (out, "bool") if kind != "any" else (twovalued.is_in(x, items), "bool")

        return Condition(test, f"{self} in {items!r}", (self,))

    def _text_test(self, how, text: str, item=None) -> Condition:
        def test(names: Names) -> tuple[Column, str]:
            x, kind = self.typed(names)
            if kind == "list" and item is not None:
                return _in_list(F.lit(item), twovalued.kind_of_value(item), x, "list"), "bool"
            if names.dialect == "agent" and kind not in ("list", "other"):
                return how(x.cast("string"), "agent"), "bool"
            if kind == "attr":  # an attribute that spells a number or a truth value is no text
                return how(x, "central") & ~F.coalesce(x.rlike("^([+-]?[0-9]+|true|false)$"), F.lit(False)), "bool"
            return (how(x, "central") if kind in ("str", "ip", "any") else F.lit(False)), "bool"

        return Condition(test, f"{self} {text}", (self,))

    def contains(self, part: str) -> Condition:
        """The text holds the part, or the list the item."""
        return self._text_test(lambda c, d: twovalued.contains(c, part, d), f"contains {part!r}", part)

    def starts_with(self, part: str) -> Condition:
        return self._text_test(lambda c, d: twovalued.starts_with(c, part, d), f"starts with {part!r}")

    def ends_with(self, part: str) -> Condition:
        return self._text_test(lambda c, d: twovalued.ends_with(c, part, d), f"ends with {part!r}")

    def under(self, prefixes: str | list[str]) -> Condition:
        return self._text_test(lambda c, d: twovalued.under(c, prefixes), f"under {prefixes!r}")

    def matches(self, pattern: str | list[str]) -> Condition:
        return self._text_test(lambda c, d: twovalued.matches(c, pattern, d), f"matches {pattern!r}")

    def is_true(self) -> Condition:
        """Null, 0, NaN, the empty text and the empty list are false."""

        def test(names: Names) -> tuple[Column, str]:
            x, kind = self.typed(names)
            if kind == "attr":
                return F.coalesce(~x.isin("", "0", "false"), F.lit(False)), "bool"
            how = {"bool": "boolean", "int": "number", "float": "number", "str": "string", "list": "list", "ip": "ip"}.get(kind)
            if how is None:
                return (F.coalesce(x.cast("boolean"), F.lit(False)) if kind == "any" else F.lit(False)), "bool"
            return twovalued.truthy(x, how), "bool"

        return Condition(test, f"{self} is true", (self,))

    def _arithmetic(self, sign: str, other) -> Expression:
        other = as_expression(other)
        whole = {"+": numeric.add, "-": numeric.subtract, "*": numeric.multiply, "%": F.try_mod}
        loose = {"+": F.try_add, "-": F.try_subtract, "*": F.try_multiply, "%": F.try_mod}

        def build(names: Names) -> tuple[Column, str]:
            (a, ka), (b, kb) = self.typed(names), other.typed(names)
            if "any" in (ka, kb):
                return (numeric.divide(a, b, "agent"), "any") if sign == "/" else (loose[sign](a, b), "any")
            if names.dialect == "agent" or "attr" in (ka, kb):
                a, b = twovalued._as_number(a, ka), twovalued._as_number(b, kb)
                ka = kb = "float"
                if a is None or b is None:
                    return F.lit(None).cast("double"), "null"
            if ka == kb == "str" and sign == "+":
                return F.concat(a, b), "str"
            if not {ka, kb} <= {"int", "float"}:
                return F.lit(None), "null"
            if sign == "/":
                return numeric.divide(a, b, "agent"), "float"
            if ka == kb == "int":
                return whole[sign](a.cast("long"), b.cast("long")), "int"
            return loose[sign](a.cast("double"), b.cast("double")), "float"

        return Expression(build, f"({self} {sign} {other})", (self, other))

    def __add__(self, other) -> Expression:
        return self._arithmetic("+", other)

    def __sub__(self, other) -> Expression:
        return self._arithmetic("-", other)

    def __mul__(self, other) -> Expression:
        return self._arithmetic("*", other)

    def __truediv__(self, other) -> Expression:
        return self._arithmetic("/", other)

    def __mod__(self, other) -> Expression:
        return self._arithmetic("%", other)

    def __abs__(self) -> Expression:
        return self.apply(F.abs, "abs")

    def apply(self, function: Callable[[Column], Column], name: str) -> Expression:
        """Any function of one column: `field("n.domain").apply(text.length_of, "len")`."""

        def build(names: Names) -> tuple[Column, str]:
            out = function(self.column(names))
            return out, names.kind(out)

        return Expression(build, f"{name}({self})", (self,))

    # calls

    def in_set(self, name: str) -> Condition:
        """Among the entries of the named set, whatever the case; null is in no set."""
        return _called(f"{self} in {name}", lambda rows, ctx, n, out, keys: joins.marked_in_set(rows, self.column(n), ctx.sets[name], out), (self,))

    def known_to(self, name: str, entity: Expression) -> Condition:
        """Among the entity's values in the named baseline; an entity that it does not hold knows everything."""

        def add(rows: DataFrame, ctx: Context, n: Names, out: str, keys: list[Column]) -> DataFrame:
            met = joins.with_baseline(rows, entity.column(n), ctx.baselines[name], f"{out}_values")
            return met.withColumn(out, joins.known_to(F.col(f"{out}_values"), self.column(n))).drop(f"{out}_values")

        return _called(f"{self} known to {name}({entity})", add, (self, entity))


def _in_list(x: Column, kind: str, items: Column, list_kind: str) -> Column:
    if list_kind == "null":
        return F.lit(False)
    return F.coalesce(F.exists(items, lambda i: i.cast("string").eqNullSafe(x.cast("string"))), F.lit(False))


class Condition(Expression):
    """An expression that is true or false."""

    def __and__(self, other: Condition) -> Condition:
        return Both(self, other)

    def __or__(self, other: Condition) -> Condition:
        typed = lambda n: (self.column(n) | other.column(n), "bool")
        return Condition(typed, f"({self} or {other})", (self, other), self.calls + _gated(other.calls, ~self))

    def __invert__(self) -> Condition:
        return Condition(lambda n: (~self.column(n), "bool"), f"not {self}", (self,))

    def is_true(self) -> Condition:
        return self


class Both(Condition):
    def __init__(self, left: Condition, right: Condition) -> None:
        super().__init__(lambda n: (left.column(n) & right.column(n), "bool"), f"({left} and {right})", (left, right), left.calls + _gated(right.calls, left))


class Comparison(Condition):
    def __init__(self, sign: str, left: Expression, right: Expression) -> None:
        super().__init__(self._typed, f"{left} {sign} {right}", (left, right))
        self.sign, self.left, self.right = sign, left, right

    def _typed(self, names: Names) -> tuple[Column, str]:
        (a, ka), (b, kb), d = self.left.typed(names), self.right.typed(names), names.dialect
        out = {
            "==": lambda: twovalued.equal(a, ka, b, kb, d), "!=": lambda: ~twovalued.equal(a, ka, b, kb, d),
            "<": lambda: twovalued.before(a, ka, b, kb, d), ">": lambda: twovalued.before(b, kb, a, ka, d),
            "<=": lambda: twovalued.before(a, ka, b, kb, d, False), ">=": lambda: twovalued.before(b, kb, a, ka, d, False),
        }
        return out[self.sign](), "bool"


class Field(Expression):
    def __init__(self, name: str) -> None:
        super().__init__(lambda n: n.find(name), name)
        self.name = name

    @property
    def alias(self) -> str:
        return self.name.partition(".")[0]


def _gated(calls: tuple[Call, ...], by: Condition) -> tuple[Call, ...]:
    return tuple(Call(c.name, by if c.gate is None else by & c.gate, c.add, c.spec) for c in calls)


_number = iter(range(1 << 62))


def _called(text: str, add: Callable, parts: tuple[Expression, ...] = (), kind: str = "bool", spec: tuple = ()):
    name = f"__call{next(_number)}"
    before = tuple(c for p in parts for c in p.calls)
    value = (lambda n: (F.coalesce(F.col(name), F.lit(False)), "bool")) if kind == "bool" else (lambda n: (F.col(name), kind))
    return (Condition if kind == "bool" else Expression)(value, text, parts, (*before, Call(name, None, add, spec)))


def as_expression(x) -> Expression:
    return x if isinstance(x, Expression) else Expression(lambda n: (F.lit(x), twovalued.kind_of_value(x)), repr(x))


def field(name: str) -> Expression:
    """A field of a matched event, as alias.field; or a value that `let` named before; or score."""
    return Field(name)


def attribute(attrs: str, name: str, kind: str = "string") -> Expression:
    """An attribute of a matched event, read as the type that it is compared with; null where it is absent or reads otherwise."""

    def build(names: Names) -> tuple[Column, str]:
        out = F.try_element_at(F.col(attrs), F.lit(name)).try_cast(kind)
        return out, names.kind(out)

    return Expression(build, f"{attrs}[{name!r}]", (Field(attrs),))


def conjuncts(condition: Condition) -> list[Condition]:
    return [c for p in condition.parts for c in conjuncts(p)] if isinstance(condition, Both) else [condition]


def equal_terms(condition: Condition) -> tuple[list[tuple[Field, Field]], list[Condition]]:
    """The equalities of fields of two aliases among the conjuncts, each once and in a fixed order, and the conjuncts that are none."""
    terms, rest = {}, []
    for c in conjuncts(condition):
        if isinstance(c, Comparison) and c.sign == "==" and isinstance(c.left, Field) and isinstance(c.right, Field) and c.left.alias != c.right.alias:
            a, b = sorted((c.left, c.right), key=lambda f: f.name)
            terms[a.name, b.name] = (a, b)
        else:
            rest.append(c)
    return [terms[k] for k in sorted(terms)], rest


def fields_of(*expressions: Expression) -> list[str]:
    """The names of the fields that the expressions read, each once, sorted."""
    found, todo = set(), list(expressions)
    while todo:
        e = todo.pop()
        if isinstance(e, Field):
            found.add(e.name)
        todo += e.parts
    return sorted(found)


def rate(key: Expression, window: str) -> Expression:
    """How many of the rows so far that the rule has come to have this key of the tenant, in the window up to the row's time."""

    def add(rows: DataFrame, ctx: Context, n: Names, out: str, keys: list[Column]) -> DataFrame:
        timed = rows.withColumns({f"{out}_ms": ctx.now_ms, f"{out}_key": key.column(n), f"{out}_tenant": ctx.tenant})
        own = [F.col(f"{out}_tenant"), F.col(f"{out}_key"), *keys]
        return stateful.rate_sliced(timed, own, f"{out}_ms", duration_ms(window), out).drop(f"{out}_ms", f"{out}_key", f"{out}_tenant")

    return _called(f"rate({key}, {window})", add, (key,), "int", ("rate", (key,), duration_ms(window)))


def rare(value: Expression, most: int = 3) -> Condition:
    """One of the first `most` rows of the tenant with this value that the rule has come to."""

    def add(rows: DataFrame, ctx: Context, n: Names, out: str, keys: list[Column]) -> DataFrame:
        timed = rows.withColumns({f"{out}_at": F.struct(ctx.now_ms, ctx.arrival), f"{out}_tenant": ctx.tenant})
        return stateful.among_first(timed, [F.col(f"{out}_tenant"), value.column(n), *keys], [f"{out}_at"], most, out).drop(f"{out}_at", f"{out}_tenant")

    return _called(f"rare({value})", add, (value,), spec=("rare", (value,), most))


def first_seen(*values: Expression) -> Condition:
    """The first row of the tenant with these values that the rule has come to: `first_seen(domain, host)` is a domain unusual for the host."""

    def add(rows: DataFrame, ctx: Context, n: Names, out: str, keys: list[Column]) -> DataFrame:
        timed = rows.withColumn(f"{out}_at", F.struct(ctx.now_ms, ctx.arrival))
        return stateful.first_seen(timed, [ctx.tenant, *(v.column(n) for v in values), *keys], [f"{out}_at"], out).drop(f"{out}_at")

    return _called(f"first_seen({', '.join(map(str, values))})", add, values, spec=("rare", values, 1))


def has_fact(name: str, target: Expression) -> Condition:
    """A fact of this name and the row's tenant has the target among its arguments, and has not expired."""

    def add(rows: DataFrame, ctx: Context, n: Names, out: str, keys: list[Column]) -> DataFrame:
        if ctx.facts is None:
            return rows.withColumn(out, F.lit(False))
        named = ctx.facts.filter(F.col("fact") == name)
        return joins.marked_with_fact(rows, named, ctx.tenant, target.column(n), ctx.now_ms, out)

    return _called(f"has_fact({name}, {target})", add, (target,), spec=("has_fact", (target,), name))


def with_calls(rows: DataFrame, expression: Expression, context: Context) -> DataFrame:
    """rows with a column for each call of the expression that they do not have yet. Behind a gate the state of a call knows two groups of
    rows, those that the gate lets through and the others, whose answer nobody asks for. A stream has its own way (context.calls)."""
    if context.calls is not None:
        return context.calls(rows, expression, context)
    for call in expression.calls:
        if call.name in rows.columns:
            continue
        if call.gate is None:
            rows = call.add(rows, context, context.names(rows), call.name, [])
            continue
        gate = f"{call.name}_gate"
        rows = rows.withColumn(gate, call.gate.column(context.names(rows)))
        rows = call.add(rows, context, context.names(rows), call.name, [F.col(gate)]).drop(gate)
    return rows
