"""The console's filter line as a condition over event rows: `comm == bash and port > 1000 and shadow`.

Clauses stand between ` and `: a field, one of ==, != , >=, <=, >, <, ~ and a value, which may be quoted; anything else is free text. Text
compares whatever the case, orders compare numbers, ~ looks for a part. A field that a row does not have fulfils nothing, not even !=.
Free text is looked for in the whole row.
"""

from __future__ import annotations

import re
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: The form of a clause and the short names of fields: fixed values.
CLAUSE = re.compile(r"^([A-Za-z_][A-Za-z0-9_.]*)\s*(==|!=|>=|<=|>|<|~)\s*(.+)$", re.DOTALL)
ALIASES = {"name": "comm", "process": "comm", "ip": "dst_ip", "port": "dst_port", "kind": "event_kind"}
_ORDERS = {">": lambda a, b: a > b, "<": lambda a, b: a < b, ">=": lambda a, b: a >= b, "<=": lambda a, b: a <= b}


def parsed(line: str) -> tuple[list[tuple[str, str, str]], list[str]]:
    """The clauses (field, operator, value) and the free texts of a line."""
    clauses, terms = [], []
    for part in filter(None, (p.strip() for p in re.split(r"\s+and\s+", line, flags=re.IGNORECASE))):
        if found := CLAUSE.match(part):
            field, sign, value = found.groups()
            clauses.append((field, sign, re.sub("^[\"']|[\"']$", "", value.strip())))
        else:
            terms.append(part.lower())
    return clauses, terms


def _text(column: Column, kind: T.DataType) -> Column:
    """As it is shown: whole numbers without a point, lists by commas."""
    if isinstance(kind, (T.DoubleType, T.FloatType)):
        whole = column == F.floor(column)
        return F.when(whole, column.cast("decimal(20,0)").cast("string")).otherwise(column.cast("string"))
    if isinstance(kind, T.ArrayType):
        return F.array_join(column.cast("array<string>"), ",")
    return F.to_json(F.struct(column)) if isinstance(kind, (T.StructType, T.MapType)) else column.cast("string")


def _places(rows: DataFrame, field: str, event: str, attrs: str) -> list[Column]:
    """Where a field may be, in order: the row, the event, its attributes, these by the last part of the name, and its short name."""
    schema = rows.schema
    inner = schema[event].dataType if event in schema.names and isinstance(schema[event].dataType, T.StructType) else T.StructType()
    own = inner if attrs in inner.names else schema
    attributes = (F.col(f"{event}.{attrs}") if attrs in inner.names else F.col(attrs)) if attrs in own.names and isinstance(own[attrs].dataType, T.MapType) else None
    of_row = lambda n: [_text(F.col(f"`{n}`"), schema[n].dataType)] if n in schema.names else []
    of_event = lambda n: [_text(F.col(event)[n], inner[n].dataType)] if n in inner.names else []
    of_attrs = lambda n: [F.try_element_at(attributes, F.lit(n))] if attributes is not None else []
    stripped = field.removeprefix(f"{event}.")
    tail = stripped.split(".")[-1]
    found = of_row(field) + of_event(stripped) + of_attrs(stripped) + of_event(tail) + of_attrs(tail)
    return found + (of_event(ALIASES[tail]) + of_row(ALIASES[tail]) if tail in ALIASES else [])


def _number(text: Column) -> Column:
    """A text as a number; the empty one is 0, infinity and what is none are null."""
    number = F.when(F.trim(text) == "", F.lit(0.0)).otherwise(F.trim(text).try_cast("double"))
    number = F.when(text == "true", F.lit(1.0)).when(text == "false", F.lit(0.0)).otherwise(number)
    return F.when(F.abs(number) < F.lit(float("inf")), number)


def condition(rows: DataFrame, line: str, event: str = "event", attrs: str = "attrs") -> Column:
    """The line as a condition over rows; true for an empty line."""
    clauses, terms = parsed(line)
    tests = []
    for field, sign, value in clauses:
        places = _places(rows, field, event, attrs)
        actual = F.coalesce(*places) if places else F.lit(None).cast("string")
        if sign in _ORDERS:
            test = _ORDERS[sign](_number(actual), _number(F.lit(value)))
        elif sign == "~":
            test = F.contains(F.lower(actual), F.lit(value.lower()))
        else:
            test = F.lower(actual) == F.lit(value.lower())
            test = ~test if sign == "!=" else test
        tests.append(F.coalesce(test, F.lit(False)))
    if terms:
        whole = F.lower(F.to_json(F.struct(*(F.col(f"`{c}`") for c in rows.columns))))
        tests += [F.contains(whole, F.lit(t)) for t in terms]
    return reduce(lambda a, b: a & b, tests, F.lit(True))


def matching(rows: DataFrame, line: str, event: str = "event", attrs: str = "attrs") -> DataFrame:
    return rows.filter(condition(rows, line, event, attrs))
