"""Comparisons and predicates that are only ever true or false, in the two dialects of the rule language.

Spark's own operators give null for null operands; a rule takes null for a value of its own: null equals null, nothing else equals it,
and an order with null is false. `central` orders values of one type and lets <= and >= hold for two nulls; `agent` compares numbers
only, reads numeric text as numbers, and lets no order hold for null.
"""

from __future__ import annotations

import re

from pyspark.errors import IllegalArgumentException
from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tallgrass.functions import network

#: Floating-point values closer than this are equal: a fixed value.
EPSILON = 2.220446049250313e-16

Operand = Column | str | int | float | bool | None


def value(x: Operand) -> Column:
    return x if isinstance(x, Column) else F.lit(x)


def is_nan(x: Operand) -> Column:
    """Whether it is the floating-point value NaN; false for text, whatever it says."""
    x = value(x)
    return _sure(F.typeof(x).isin("double", "float") & (x.cast("string") == "NaN"))


def _sure(c: Column) -> Column:
    return F.coalesce(c, F.lit(False))


def eq(a: Operand, b: Operand) -> Column:
    """Null equals null. NaN equals nothing."""
    a, b = value(a), value(b)
    return a.eqNullSafe(b) & ~is_nan(a)


def eq_float(a: Operand, b: Operand) -> Column:
    a, b = value(a).cast("double"), value(b).cast("double")
    near = (F.abs(a - b) < F.lit(EPSILON)) & ~F.isnan(a) & ~F.isnan(b)
    return F.when(a.isNull() | b.isNull(), a.isNull() & b.isNull()).otherwise(near)


def ne(a: Operand, b: Operand) -> Column:
    return ~eq(a, b)


def _ordered(c: Column, a: Operand, b: Operand) -> Column:
    """An order in which NaN, which Spark puts last, has no place."""
    return _sure(c) & ~is_nan(a) & ~is_nan(b)


def lt(a: Operand, b: Operand) -> Column:
    return _ordered(value(a) < value(b), a, b)


def gt(a: Operand, b: Operand) -> Column:
    return _ordered(value(a) > value(b), a, b)


def le(a: Operand, b: Operand, dialect: str = "central") -> Column:
    return lt(a, b) | eq(a, b) if dialect == "central" else _ordered(value(a) <= value(b), a, b)


def ge(a: Operand, b: Operand, dialect: str = "central") -> Column:
    return gt(a, b) | eq(a, b) if dialect == "central" else _ordered(value(a) >= value(b), a, b)


def between(x: Operand, lo: Operand, hi: Operand) -> Column:
    return ge(x, lo) & le(x, hi)


def truthy(x: Operand, kind: str = "boolean") -> Column:
    """Null is false; 0, NaN, the empty text and the empty list are false."""
    x = value(x)
    by_kind = {
        "boolean": x, "number": (x != 0) & ~F.isnan(x.cast("double")), "string": x != F.lit(""), "list": F.size(x) > 0, "ip": x.isNotNull(), "duration": x > 0,
    }
    return _sure(by_kind[kind])


#: Kinds of values as a rule sees them. "attr" is a text whose kind its own letters decide; "any" leaves the choice to Spark.
KINDS = ("null", "bool", "int", "float", "str", "attr", "ip", "list", "other", "any")
_WHOLE = r"^[+-]?[0-9]+$"


def kind_of(t: T.DataType) -> str:
    if isinstance(t, T.NullType):
        return "null"
    if isinstance(t, T.BooleanType):
        return "bool"
    if isinstance(t, T.IntegralType):
        return "int"
    if isinstance(t, (T.FractionalType, T.DecimalType)):
        return "float"
    if isinstance(t, (T.StringType, T.CharType, T.VarcharType)):
        return "str"
    return "list" if isinstance(t, T.ArrayType) else "other"


def kind_of_value(x: object) -> str:
    by_class = {type(None): "null", bool: "bool", int: "int", float: "float", str: "str", list: "list", tuple: "list"}
    return by_class.get(type(x), "other")


def _whole(text: Column) -> Column:
    """A text as the whole number that it spells, null if it spells none."""
    return F.when(text.rlike(_WHOLE), text.try_cast("long"))


def _as_number(x: Column, kind: str) -> Column | None:
    """The agent's reading: numbers, and text that spells one."""
    if kind in ("int", "float"):
        return x.cast("double")
    return F.trim(x).try_cast("double") if kind in ("str", "attr", "ip") else None


def equal(a: Column, ka: str, b: Column, kb: str, dialect: str = "central") -> Column:
    """eq for values of known kinds. Null equals null whatever the kinds; a whole number equals the text that spells it (central) and an
    address the text that names it; other values of unlike kinds differ."""
    if "any" in (ka, kb):
        return eq(a, b)
    nulls = a.isNull() & b.isNull()
    same = None
    if kb == "attr" and ka != "attr":
        a, ka, b, kb = b, kb, a, ka
    numbers = ("int", "float")
    if ka == "attr":
        if kb == "bool":
            same = F.when(a.isin("true", "false"), a == "true") == b
        elif kb == "int":
            same = _whole(a) == b
        elif kb == "float":
            same = F.abs(_whole(a).cast("double") - b) < F.lit(EPSILON)
        elif kb in ("str", "attr", "ip"):
            same = a == b
    elif ka in numbers and kb in numbers:
        same = a == b if ka == kb == "int" else F.abs(a.cast("double") - b.cast("double")) < F.lit(EPSILON)
        if ka == kb == "float":
            same = same | (a == b)  # so that infinity equals itself
        same = same & ~is_nan(a) & ~is_nan(b)
    elif {ka, kb} == {"int", "str"} and dialect == "central":
        same = (_whole(a) == b) if ka == "str" else (_whole(b) == a)
    elif {ka, kb} <= {"str", "ip"}:
        if "ip" in (ka, kb) or dialect == "agent":
            x, y = network.ipv4(F.trim(a)), network.ipv4(F.trim(b))
            same = F.when(x.isNotNull() & y.isNotNull(), x == y).otherwise(a == b)
        else:
            same = a == b
    elif ka == kb and ka != "null":
        same = a == b
    return nulls if same is None else nulls | _sure(same)


def before(a: Column, ka: str, b: Column, kb: str, dialect: str = "central", strictly: bool = True) -> Column:
    """a < b, or with strictly=False a <= b, for values of known kinds. central: numbers with numbers and text with text; agent: as numbers."""
    if "any" in (ka, kb):
        return lt(a, b) if strictly else le(a, b, dialect)
    if dialect == "agent":
        x, y = _as_number(a, ka), _as_number(b, kb)
        if x is None or y is None:
            return F.lit(False)
        return _ordered(x < y if strictly else x <= y, x, y)
    less = F.lit(False)
    if ka == "attr" or kb == "attr":
        whole = lambda x, k: _whole(x) if k == "attr" else x
        if {ka, kb} <= {"attr", "int", "float"}:
            less = _ordered(whole(a, ka) < whole(b, kb), whole(a, ka), whole(b, kb))
        if {ka, kb} <= {"attr", "str"}:
            spelled = F.lit(False)
            for x, k in ((a, ka), (b, kb)):
                spelled = spelled | _whole(x).isNotNull() if k == "attr" else spelled
            less = less | (~spelled & _sure(a < b))
    elif {ka, kb} <= {"int", "float"} or (ka == kb and ka in ("str", "other")):
        less = _ordered(a < b, a, b)
    return less if strictly else less | equal(a, ka, b, kb, dialect)


def is_in(x: Operand, items: list | Column) -> Column:
    """Membership by eq: null is in a list that holds null."""
    x = value(x)
    if isinstance(items, Column):
        return _sure(F.exists(items, lambda y: x.eqNullSafe(y)))
    known = [i for i in items if i is not None]
    found = _sure(x.isin(known)) if known else F.lit(False)
    return found | x.isNull() if len(known) < len(items) else found


def not_in(x: Operand, items: list | Column) -> Column:
    return ~is_in(x, items)


def _texts(dialect: str, *xs: Operand) -> list[Column]:
    """agent turns everything into text, null into the empty one; central leaves null, which makes the predicate false."""
    return [F.coalesce(value(x).cast("string"), F.lit("")) if dialect == "agent" else value(x) for x in xs]


def contains(x: Operand, part: Operand, dialect: str = "central") -> Column:
    x, part = _texts(dialect, x, part)
    return _sure(x.contains(part))


def starts_with(x: Operand, part: Operand, dialect: str = "central") -> Column:
    x, part = _texts(dialect, x, part)
    return _sure(x.startswith(part))


def ends_with(x: Operand, part: Operand, dialect: str = "central") -> Column:
    x, part = _texts(dialect, x, part)
    return _sure(x.endswith(part))


def under(x: Operand, prefixes: str | list[str]) -> Column:
    """Starts with the prefix, or with one of them."""
    out = F.lit(False)
    for p in [prefixes] if isinstance(prefixes, str) else prefixes:
        out = out | starts_with(x, p)
    return out


def wildcard_pattern(pattern: str) -> str:
    """An anchored regular expression: * any run, ? one character, (a|b) alternatives, backslash escapes."""
    out, i = "", 0
    while i < len(pattern):
        c = pattern[i]
        if c == "\\" and i + 1 < len(pattern):
            i += 1
            out += re.escape(pattern[i])
        else:
            out += {"*": ".*", "?": "."}.get(c) or (c if c in "(|)" else re.escape(c))
        i += 1
    return f"(?s)^(?:{out})$"


def _java_pattern(pattern: str) -> str | None:
    """The pattern as the engine that runs it writes it; None if it is no pattern to that engine."""
    translated = re.sub(r"\(\?P<([A-Za-z][A-Za-z0-9]*)>", r"(?<\1>", pattern)
    session = SparkSession.getActiveSession()
    if session is None:
        raise RuntimeError("a pattern is compiled in a session")
    try:
        session._jvm.java.util.regex.Pattern.compile(translated)
    except IllegalArgumentException:  # what PySpark makes of a PatternSyntaxException
        return None
    return translated


def matches(x: Operand, pattern: str | list[str], dialect: str = "central") -> Column:
    """central: a whole match of the glob if there is * or ?, else a regular expression anywhere, else the text itself anywhere.
    agent: a whole match of the wildcard pattern. Of a list, any. What is no text matches nothing (central)."""
    if isinstance(pattern, list):
        out = F.lit(False)
        for p in pattern:
            out = out | matches(x, p, dialect)
        return out
    if dialect == "agent":
        (x,) = _texts(dialect, x)
        written = _java_pattern(wildcard_pattern(pattern))
        return x.rlike(written) if written else F.lit(False)
    x = value(x)
    out = F.lit(False)
    if "*" in pattern or "?" in pattern:
        glob = "".join({"*": ".*", "?": "."}.get(c) or re.escape(c) for c in pattern)
        out = out | _sure(x.rlike(f"(?s)^(?:{glob})$"))
    written = _java_pattern(pattern)
    return out | _sure(x.contains(pattern) if written is None else x.rlike(written))
