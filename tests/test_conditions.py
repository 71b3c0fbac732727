"""Expression trees: kinds, names, keys, and calls in one pass."""

import pytest
from pyspark.sql import functions as F

from tallgrass.functions import twovalued
from tallgrass.operators import rules
from tallgrass.operators.conditions import conjuncts, equal_terms, field, fields_of, first_seen, rare, rate
from tallgrass.operators.rules import Branch, Fields, Rule, Source
from tallgrass.sources.catalog import EVENTS

NAN = float("nan")
#: Values by kind, null in each; whole numbers and the texts that spell them stand on the same row.
COLUMNS = {"n": [5, 7, None, -3, 0], "d": [5.0, 7.5, None, NAN, 0.0], "s": ["5", "abc", None, "-3", ""], "b": [True, False, None, True, False], "l": [["5"], [], None, ["x", None], ["abc"]], "ip": ["10.0.0.1", "5", None, "::1", ""]}
SCHEMA = "event_id long, ts_ms long, user_id long, tenant_id long, event_type string, n long, d double, s string, b boolean, l array<string>, ip string"


@pytest.fixture(scope="module")
def rows(spark):
    return spark.createDataFrame([(i, i, 1, 1, "x", *(COLUMNS[c][i] for c in COLUMNS)) for i in range(5)], SCHEMA)


def found(rows, *where, dialect="central", **more):
    rule = Rule("r", "r", (Source("e", "x"),), where=where, dialect=dialect)
    return sorted(r[0] for r in rules.run(rule, rows, **more).select("e.event_id").collect())


def spelled(x):
    try:
        return int(x) if isinstance(x, str) and x.lstrip("+-").isdigit() else None
    except ValueError:
        return None


def equal(a, b, dialect):
    """Written from the rule language's words: null is null; numbers by value; text that spells a whole number; the rest only its own kind."""
    if a is None or b is None:
        return a is None and b is None
    number = lambda x: isinstance(x, (int, float)) and not isinstance(x, bool)
    if number(a) and number(b):
        return a == b
    if number(a) != number(b) and dialect == "central" and {type(a), type(b)} == {int, str}:
        return (spelled(a) if isinstance(a, str) else a) == (spelled(b) if isinstance(b, str) else b)
    return type(a) is type(b) and a == b


def before(a, b, dialect):
    if a is None or b is None:
        return False
    if dialect == "agent":
        try:
            return not isinstance(a, (bool, list)) and not isinstance(b, (bool, list)) and float(a) < float(b)
        except ValueError:
            return False
    number = lambda x: isinstance(x, (int, float)) and not isinstance(x, bool)
    return (number(a) and number(b) or type(a) is type(b) is str) and a < b


@pytest.mark.parametrize("dialect", ["central", "agent"])
@pytest.mark.parametrize("a", ["n", "d", "s", "b"])
def test_every_kind_with_every_other(rows, a, dialect):
    got = rows.select(F.struct("*").alias("e"))
    from tallgrass.operators.conditions import Names

    names, other = Names(got, (("e", "x"),), None, dialect), [c for c in COLUMNS if c not in ("ip",)]
    literals = [5, 5.0, "5", "abc", True, None, -3]
    tests = {}
    for b in other:
        tests |= {(a, "==", b): field(f"e.{a}") == field(f"e.{b}"), (a, "<", b): field(f"e.{a}") < field(f"e.{b}"), (a, ">=", b): field(f"e.{a}") >= field(f"e.{b}")}
    for x in literals:
        tests |= {(a, "==", repr(x)): field(f"e.{a}") == x, (a, "!=", repr(x)): field(f"e.{a}") != x, (a, ">", repr(x)): field(f"e.{a}") > x}
    result = got.select(*(c.column(names).alias(f"c{i}") for i, c in enumerate(tests.values()))).collect()
    for r, row in enumerate(result):
        for i, (left, sign, right) in enumerate(tests):
            x = COLUMNS[left][r]
            y = COLUMNS[right][r] if right in COLUMNS else eval(right)
            want = {"==": equal(x, y, dialect), "!=": not equal(x, y, dialect), "<": before(x, y, dialect), ">": before(y, x, dialect)}
            want[">="] = before(y, x, dialect) or (equal(x, y, dialect) if dialect == "central" else x is not None and y is not None and before(x, y, dialect) is False and _number(x) is not None and _number(x) == _number(y))
            assert row[i] == want[sign], (x, sign, y, dialect)


def _number(x):
    try:
        return None if isinstance(x, (bool, list)) or x is None else float(x)
    except ValueError:
        return None


def test_unlike_kinds_in_rules(rows):
    e = lambda n: field(f"e.{n}")
    assert found(rows, field("e.event_type") != 5) == [0, 1, 2, 3, 4]
    assert found(rows, field("e.event_type") < 5) == [] and found(rows, field("e.event_type").is_in([1, 2])) == []
    assert found(rows, e("s").is_in([5, "abc"])) == [0, 1] and found(rows, e("n").is_in(["5", None])) == [0, 2]
    assert found(rows, e("n").contains("5")) == [] and found(rows, e("n").contains("5"), dialect="agent") == [0]
    assert found(rows, e("l").contains("5")) == [0] and found(rows, e("s").is_in(e("l"))) == [0]
    assert found(rows, e("b").is_true()) == [0, 3] and found(rows, e("l").is_true()) == [0, 3, 4] and found(rows, e("n").is_true()) == [0, 1, 3]
    assert found(rows, (e("n") + e("s")) == None) == [0, 1, 2, 3, 4]  # noqa: E711
    assert found(rows, (e("s") + "x") == "5x") == [0] and found(rows, (e("n") + e("d")) >= 10) == [0, 1]


def test_patterns_that_only_one_engine_reads(rows):
    s = field("e.s")
    assert found(rows, s.matches("(?P<a>b)c")) == [1]  # written the Java way
    assert found(rows, s.matches("(?P<a>b)(?P=a)")) == []  # no Java pattern: taken as a text
    assert found(rows, s.matches("[a-")) == [] and found(rows, field("e.n").matches("5")) == []
    assert twovalued.wildcard_pattern("a*") == "(?s)^(?:a.*)$"


PAIR = (Source("a", "a"), Source("b", "b"))


def joined(rule, events, **more):
    return sorted(tuple(r) for r in rules.correlated(rule, events, **more).select("a.event_id", "b.event_id").collect())


def test_events_without_any_key_field_meet_by_entity(spark):
    rows = [(1, 0, 7, 1, "a", None, None), (2, 1, 8, 1, "b", None, None), (3, 1, 7, 1, "b", None, None), (4, 1, 8, 1, "b", "k", None), (5, 2, 9, 1, "a", "k", None), (6, 2, 9, 1, "a", None, "z"), (7, 2, 3, 1, "b", None, "z")]
    events = spark.createDataFrame(rows, "event_id long, ts_ms long, user_id long, tenant_id long, event_type string, k string, m string")
    assert joined(Rule("r", "r", PAIR, on=(("a.k", "b.k"),)), events) == [(1, 3), (5, 4)]
    # null still meets null beside a field that is known
    assert joined(Rule("r", "r", PAIR, on=(("a.k", "b.k"), ("a.m", "b.m"))), events) == [(1, 3), (5, 4), (6, 7)]


def test_on_as_a_condition(spark):
    rows = [(1, 0, 7, 1, "a", 5, 1.0), (2, 1, 8, 1, "b", 5, 3.0), (3, 1, 8, 1, "b", 5, 0.5), (4, 1, 8, 1, "b", 6, 9.0)]
    events = spark.createDataFrame(rows, "event_id long, ts_ms long, user_id long, tenant_id long, event_type string, port int, size double")
    on = (field("b.port") == field("a.port")) & (field("b.size") > field("a.size") * 2)
    assert [tuple(f.name for f in t) for t in equal_terms(on)[0]] == [("a.port", "b.port")] and len(equal_terms(on)[1]) == 1
    rule = Rule("r", "r", PAIR, on=on, where=(field("b.size") > 0,))
    assert joined(rule, events) == [(1, 2)]
    assert rules.fields_read(rule) == ["a.port", "a.size", "b.port", "b.size"]
    assert dict(rules.explain(rule))["correlate"] == "a.port = b.port and b.size > (a.size * 2)"
    plan = rules.correlated(rule, events)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Join") == 1 and "Filter" not in plan.split("Join")[0]  # the residue is a part of the join
    # an equality behind `or` is no key
    assert equal_terms((field("a.port") == field("b.port")) | (field("a.size") == 1))[0] == []
    with pytest.raises(ValueError, match="no place"):
        rules.correlated(Rule("r", "r", PAIR, on=rate(field("a.port"), "1m") > 1), events)


def test_whole_keys_of_different_types_meet(spark):
    rows = [(1, 0, 7, 1, "a", 5, None), (2, 1, 8, 1, "b", None, 5.0), (3, 1, 8, 1, "b", None, 5.5)]
    events = spark.createDataFrame(rows, "event_id long, ts_ms long, user_id long, tenant_id long, event_type string, n int, d double")
    assert joined(Rule("r", "r", PAIR, on=(("a.n", "b.d"),)), events) == [(1, 2)]


def test_conjuncts_and_fields():
    a, b, c = field("e.a") == 1, field("e.b") > field("f.c"), field("e.d").is_in([1])
    assert list(map(str, conjuncts(a & (b & c)))) == [str(a), str(b), str(c)] and len(conjuncts(a | b)) == 1
    assert fields_of(a & ~(b | c), rate(field("e.k"), "1m")) == ["e.a", "e.b", "e.d", "e.k", "f.c"]


@pytest.fixture(scope="module")
def flat(spark):
    schema = "event_id long, ts_ms long, tenant_id string, host_id string, event_kind string, pid long, uid long, comm string, dst_ip string, dst_port int, attrs map<string,string>, user_id long"
    rows = [
        (1, 0, "t", "h", "process_exec", 10, 0, "bash", None, None, {"signed": "false", "level": "7"}, 1), (2, 1, "t", "h", "net", 10, 5, "bash", "10.0.0.1", 443, {"bytes_out": "2000", "domain": "x.io"}, 1),
        (3, 2, "t", "h", "net", 11, 5, "curl", "10.0.0.9", 80, {"bytes_out": "many"}, 1),
    ]
    return spark.createDataFrame(rows, schema)


FIELDS = Fields(kind="event_kind", catalog=EVENTS)


def test_names_of_the_catalog(flat):
    one = lambda kind, *where: found_by(flat, kind, *where)
    assert one("process_exec", field("p.elevated").is_true(), field("p.process.pid") == "10", field("p.name") == "bash") == [1]
    assert one("net", field("p.bytes_out") > 100) == [2] and one("net", field("p.bytes_out") == 0) == [3]
    assert one("net", field("p.network.dest.ip") == "10.0.0.1") == [2] and one("net", field("p.domain").ends_with(".io")) == [2]
    # attributes take the kind that their letters spell; unknown names are null
    assert one("process_exec", field("p.signed") == False, field("p.level") > 5, field("p.nowhere") == None) == [1]  # noqa: E711, E712
    assert one("process_exec", field("p.level").contains("7")) == []
    # without an alias: the first source that has the field
    assert one("net", field("dst_port") == 443) == [2]


def found_by(flat, kind, *where):
    rule = Rule("r", "r", (Source("p", kind),), where=where)
    return sorted(r[0] for r in rules.run(rule, flat, FIELDS).select("p.event_id").collect())


def test_names_join_families(flat):
    rule = Rule("r", "r", (Source("p", "process_exec"), Source("n", "net")), on=field("n.process_id") == field("p.id"))
    assert [tuple(r) for r in rules.correlated(rule, flat, FIELDS).select("p.event_id", "n.event_id").collect()] == [(1, 2)]


def test_calls_in_source_filters(spark):
    rows = spark.createDataFrame([(i, i * 1000, 1, 1, "a" if i < 6 else "b", "k") for i in range(8)], "event_id long, ts_ms long, user_id long, tenant_id long, event_type string, key string")
    rule = Rule("r", "r", (Source("a", "a", rate(field("a.key"), "10s") >= 5), Source("b", "b")))
    assert joined(rule, rows) == [(4, 6), (4, 7), (5, 6), (5, 7)]


def calls(n):
    """n calls, each behind `|`: of those rows that none before it has taken."""
    v, key = field("e.value"), field("e.key")
    out = v > 100
    for i in range(n):
        out = out | ((v >= i * 3) & (rate(key, "10s") == i + 1))
    return out


def by_hand(values, n):
    """The same, one row after the other: a call counts the rows that came to it."""
    came, got = [0] * n, []
    for i, v in enumerate(values):
        hit = v > 100
        for c in range(n):
            if not hit and v >= c * 3:
                came[c] += 1
                hit = came[c] == c + 1
        got += [i] if hit else []
    return got


def test_calls_behind_or_scan_once(spark, tmp_path):
    values = [float(i * 7 % 20) for i in range(60)] + [200.0]
    schema = "event_id long, ts_ms long, user_id long, tenant_id long, event_type string, key string, value double"
    spark.createDataFrame([(i, i, 1, 1, "x", "k", v) for i, v in enumerate(values)], schema).write.parquet(f"{tmp_path}/t")
    rows = spark.read.parquet(f"{tmp_path}/t")
    rule = Rule("r", "r", (Source("e", "x"),), where=(calls(5),))
    result = rules.run(rule, rows)
    assert result._jdf.queryExecution().optimizedPlan().toString().count("Relation") == 1
    assert sorted(r[0] for r in result.select("e.event_id").collect()) == by_hand(values, 5)


def test_rare_and_first_seen_behind_or(spark):
    rows = spark.createDataFrame([(i, i * 1000, 1, 1, "x", "k" if i % 2 else "m", float(i)) for i in range(12)], "event_id long, ts_ms long, user_id long, tenant_id long, event_type string, key string, value double")
    v, key = field("e.value"), field("e.key")
    assert found(rows, (v < 4) | rare(key, 2)) == [0, 1, 2, 3, 4, 5, 6, 7]
    assert found(rows, (v < 4) | first_seen(key)) == [0, 1, 2, 3, 4, 5]


def test_answers_of_the_agent_dialect(rows):
    rule = Rule("r", "r", (Source("e", "x"),), dialect="agent", base=1, modifiers=((10, field("e.s") < 6),), respond=(Branch(field("e.s") < 0, (("alert", "low"),)), Branch(None, (("alert", "high"),))))
    got = {r[0]: (r[1], r[2]) for r in rules.run(rule, rows).select("e.event_id", "score", "severity").collect()}
    assert got == {0: (11, "high"), 1: (1, "high"), 2: (1, "high"), 3: (11, "low"), 4: (1, "high")}


def test_callables_check_names_and_arguments(rows):
    from tallgrass.operators.callables import SIGNATURES, call

    assert len(SIGNATURES) == 16
    with pytest.raises(ValueError, match="no callable"):
        call("median", field("e.l"))
    with pytest.raises(ValueError, match="2 arguments"):
        call("rate", field("e.s"))
    e = lambda n: field(f"e.{n}")
    # central takes any value as text, the agent texts only
    assert found(rows, call("rare", e("n"))) == [0, 1, 2, 3, 4] and found(rows, call("rare", e("n")), dialect="agent") == []
    assert found(rows, call("UnusualFor", e("s"), e("ip")), dialect="agent") == [0, 1, 3, 4]
    assert found(rows, call("len", e("l")) == 2) == [3] and found(rows, call("len", e("n")) == 0) == [0, 1, 2, 3, 4] and found(rows, call("len", e("n")) == None, dialect="agent") == [0, 1, 2, 3, 4]  # noqa: E711
    assert found(rows, call("max", e("l")) == 5) == [0] and found(rows, call("sum", e("s")) == None) == [0, 1, 2, 3, 4]  # noqa: E711
    # an entity that no baseline knows, and a feed that is not there, hold nothing
    assert found(rows, e("s").is_in(call("host", e("s"))["domains"])) == [] and found(rows, e("s").is_in(call("intel.domains", "none"))) == []
