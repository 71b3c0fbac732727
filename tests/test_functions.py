"""Scalar functions: null and type semantics of both dialects, on hand-made rows."""

import math
from collections import Counter

import pytest
from pyspark.sql import functions as F

from tallgrass.functions import clock, network, numeric, text
from tallgrass.functions import twovalued as t


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first().x


def null():
    return F.lit(None).cast("long")


def test_null_is_a_value(spark):
    assert one(spark, t.eq(null(), null())) is True
    assert one(spark, t.ne(null(), 0)) is True
    assert one(spark, ~t.truthy(null(), "number")) is True
    assert one(spark, t.lt(null(), 5)) is False
    assert one(spark, t.is_in(null(), [1, None])) is True
    assert one(spark, t.is_in(null(), [1])) is False
    assert one(spark, t.not_in(null(), [1])) is True


def test_order_by_dialect(spark):
    assert one(spark, t.le(null(), null())) is True
    assert one(spark, t.le(null(), null(), "agent")) is False
    assert one(spark, t.ge(null(), 1)) is False


def test_nan_equals_nothing(spark):
    nan = F.lit(math.nan)
    assert one(spark, t.eq_float(nan, nan)) is False
    assert one(spark, t.truthy(nan, "number")) is False


def test_nan_has_no_order(spark):
    nan = F.lit(math.nan)
    for c in (t.eq(nan, nan), t.gt(nan, 1.0), t.lt(1.0, nan), t.ge(nan, nan), t.between(nan, 0.0, 1.0)):
        assert one(spark, c) is False
    assert one(spark, t.ne(nan, nan)) is True and one(spark, t.eq(F.lit("NaN"), "NaN")) is True


def test_text_predicates(spark):
    none = F.lit(None).cast("string")
    assert one(spark, t.starts_with(none, "")) is False
    assert one(spark, t.starts_with(none, "", "agent")) is True
    assert one(spark, t.under(F.lit("/tmp/x"), ["/var", "/tmp"])) is True


@pytest.mark.parametrize(
    ("value", "pattern", "central", "agent"),
    [("bash", "(zsh|bash|sh)", True, True), ("xbash", "bash", True, False), ("abc", "a?c", True, True), ("a.c", "a[", False, False), ("/home/a/.ssh/id_rsa", "/home/*/.ssh/id_rsa", True, True), ("a*c", "a\\*c", True, True)],
)
def test_matches(spark, value, pattern, central, agent):
    assert one(spark, t.matches(F.lit(value), pattern)) is central
    assert one(spark, t.matches(F.lit(value), pattern, "agent")) is agent


def test_saturating(spark):
    most, least = F.lit((1 << 63) - 1), F.lit(-(1 << 63))
    one_ = F.lit(1).cast("long")
    assert one(spark, numeric.add(most, one_)) == (1 << 63) - 1
    assert one(spark, numeric.subtract(least, one_)) == -(1 << 63)
    assert one(spark, numeric.multiply(most, F.lit(-2).cast("long"))) == -(1 << 63)
    assert one(spark, numeric.add(null(), one_)) is None


def test_division(spark):
    assert one(spark, numeric.divide(F.lit(-7).cast("long"), F.lit(2).cast("long"))) == -3
    assert one(spark, numeric.divide(F.lit(-7).cast("long"), F.lit(2).cast("long"), "agent")) == -3.5
    assert one(spark, numeric.divide(F.lit(1).cast("long"), F.lit(0).cast("long"))) is None
    assert one(spark, numeric.divide(F.lit(-(1 << 63)), F.lit(-1).cast("long"))) == (1 << 63) - 1


def test_list_aggregates(spark):
    xs, none = F.array(F.lit(1.0), F.lit(3.0)), F.lit(None).cast("array<double>")
    assert [one(spark, numeric.list_aggregate(xs, h)) for h in ("max", "min", "sum", "avg", "count")] == [3.0, 1.0, 4.0, 2.0, 2]
    assert [one(spark, numeric.list_aggregate(none, h)) for h in ("max", "sum", "avg", "count")] == [None, 0.0, None, 0]
    assert one(spark, numeric.list_aggregate(F.array(F.lit(1.0), F.lit(None).cast("double")), "max")) is None


def test_durations(spark):
    assert numeric.duration_ns("5m") == 300 * 10**9
    assert numeric.duration_ms("10ns") == 1
    assert numeric.duration_ns("1m") == numeric.duration_ns("60s")
    assert one(spark, numeric.duration_column(F.lit("90s"))) == 90 * 10**9
    assert one(spark, numeric.duration_column(F.lit("90x"))) is None


def test_hashes(spark):
    assert one(spark, text.fnv1a32(F.lit("abc"))) == 440920331
    assert one(spark, text.fnv1a32(F.lit(""))) == 2166136261
    assert one(spark, text.fnv1a64(F.lit(""))) == "cbf29ce484222325"
    assert one(spark, text.fnv1a64(F.lit("foobar"))) == "85944171f73967e8"
    assert one(spark, text.fingerprint(F.lit(""))) == 0


def test_entropy(spark):
    assert one(spark, text.entropy(F.lit("abab"))) == 1.0
    assert one(spark, text.entropy(F.lit(""))) == 0.0 and one(spark, text.entropy(F.lit("aaa"))) == 0.0
    data = "ünd so weiter, " * 30
    share = [n / len(data.encode()) for n in Counter(data.encode()).values()]
    assert one(spark, text.entropy(F.lit(data))) == pytest.approx(-sum(p * math.log2(p) for p in share))
    assert one(spark, text.length_of(F.lit("é"))) == 2
    assert one(spark, text.length_of(F.lit("é"), "agent")) == 1


@pytest.mark.parametrize(
    ("statement", "redacted"),
    [
        ("update shelf set label='tin', weight=7 where bin in (3,4)", "update shelf set label=?, weight=? where bin in (?,?)"),
        ("select 'it''s two ''quotes'' here'", "select ?"),
        (r"select 'back\\slash \' inside', 8", "select ?, ?"),
        ("insert into log values (1, 'never closed", "insert into log values (?, ?"),
        ("do $fn$ begin 'x'; end $fn$ language sql", "do ? language sql"),
        ("select $$open ended", "select ?"),
        ("select $2, price -- trailing 12\nfrom crate", "select $2, price from crate"),
        ("select a /* one /* two */ 'three' */ , b", "select a , b"),
        ("delete/* */from/* */crate", "delete from crate"),
        ("select '/* no comment */' || '--'", "select ? || ?"),
        ("select x9, y_2 from t3 limit 2.5e10", "select x9, y_2 from t3 limit ?"),
        ('select "two   blanks", `three   here`   from t', 'select "two   blanks", `three   here` from t'),
        ("", ""),
        (None, None),
    ],
)
def test_redaction(spark, statement, redacted):
    rows = spark.createDataFrame([(statement,)], "s string")
    assert rows.select(text.redact("s").alias("x")).first().x == redacted


@pytest.mark.parametrize(
    ("statement", "tables"),
    [
        ("select ? from depot d left join carrier c on c.id = d.id join depot on ?", ["depot", "carrier"]),
        ("create table if not exists depot (n int)", ["depot"]),
        ("insert into table ops.depot, x", ["table", "ops.depot"]),
        ("select ? from (select n from (select ? from `deep`) y) z", ["deep"]),
        ('delete from "depot"; truncate table ops.stock;', ["depot", "ops.stock"]),
        ("update ? set from = 3 from 77", []),
        ("select x.from depot, fromage camembert", []),
        ("", []),
    ],
)
def test_tables(spark, statement, tables):
    assert one(spark, text.tables_of(F.lit(statement))) == tables


def test_packed_tables(spark):
    names = F.array(*(F.lit(f"ops.storage_bay_{i:02d}") for i in range(9)))
    packed = one(spark, text.pack_tables(names))
    assert len(packed) <= 64 and packed.split(",")[-1].startswith("storage_bay_")
    assert one(spark, text.database_of(names)) == "ops"
    assert one(spark, text.database_of(F.array(F.lit("a.x"), F.lit("y")))) is None


def test_unpacked_tables(spark):
    found = lambda packed: tuple(one(spark, text.unpack_tables(F.lit(packed))))
    assert found("ops.depot,ops.stock") == ("ops", ["depot", "stock"])
    assert found("ops.depot,stock") == ("ops", ["depot", "stock"])
    assert found("ops.depot,,hr.staff,.x,y.") == (None, ["depot", "staff", ".x", "y."])
    assert found("") == (None, [])


def test_djb2(spark):
    def plain(data):
        h = 5381
        for b in data:
            h = (h * 33 + b) % (1 << 64)
        return h

    for x in ("", "a", "é and some more text " * 20):
        assert one(spark, text.djb2(F.lit(x))) % (1 << 64) == plain(x.encode())
        assert one(spark, text.djb2_shard(F.lit(x))) == plain(x.encode()) % 32


def test_log_parts(spark):
    assert tuple(one(spark, text.log_parts(F.lit(" 2024-01-01 10:00 gate it  broke ")))) == ("2024-01-01", "10:00", "gate", "it  broke")
    assert tuple(one(spark, text.log_parts(F.lit("word")))) == ("word", None, None, None)


def test_kinds(spark):
    for word, kind in (("(select", 1), ("insert", 2), ("DROP", 3), ("grant;", 4), ("vacuum", 0), ("", 0)):
        assert one(spark, text.statement_kind(F.lit(word))) == kind


def test_key_values(spark):
    assert one(spark, text.key_values(F.lit("evt a=1 b=x=y a=2 stray"))) == {"a": "2", "b": "x=y"}


def test_network(spark):
    ip = network.ipv4
    assert one(spark, ip(F.lit("10.0.0.1"))) == 167772161
    assert one(spark, ip(F.lit("10.0.0.256"))) is None
    assert one(spark, ip(F.lit(None).cast("string"))) is None
    for address, inside in (("172.31.0.1", True), ("172.32.0.1", False), ("192.168.1.1", True), ("8.8.8.8", False), ("169.254.1.1", True), ("127.0.0.1", True)):
        assert one(spark, network.is_internal(ip(F.lit(address)))) is inside
    for name, good in (("localhost", True), ("a.b.", True), ("1.2.3.4", False), ("nodot", False), ("", False)):
        assert one(spark, network.looks_like_domain(F.lit(name))) is good


def test_clock(spark):
    assert one(spark, clock.trusted_time(null(), F.lit(10).cast("long"))) == 10
    assert one(spark, clock.in_band(F.lit(0).cast("long"), F.lit(86_400_000).cast("long"))) is True
    ts = F.lit("2024-01-06 10:00:00").cast("timestamp")
    assert one(spark, clock.weekday(ts)) == "saturday" and one(spark, clock.is_business_hour(ts)) is False
