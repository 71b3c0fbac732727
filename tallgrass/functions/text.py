"""Text functions of rules and statement analytics; all but `redact` are plain expressions."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType


def length_of(text: Column, dialect: str = "central") -> Column:
    """central counts bytes, agent characters."""
    return (F.octet_length(text) if dialect == "central" else F.char_length(text)).cast("long")


def key_of(text: Column) -> Column:
    """The form under which stateful functions remember a value."""
    return F.lower(F.trim(text))


def slug(text: Column) -> Column:
    return F.trim(F.regexp_replace(F.lower(text), "[^a-z0-9]+", "_"), F.lit("_"))


def _bytes(text: Column) -> Column:
    """The UTF-8 bytes as numbers."""
    digits = F.hex(F.encode(text, "UTF-8"))
    places = F.sequence(F.lit(1), F.greatest(F.length(digits) - 1, F.lit(1)), F.lit(2))
    return F.when(F.length(digits) > 0, F.transform(places, lambda i: F.conv(F.substr(digits, i, F.lit(2)), 16, 10).cast("long"))).otherwise(F.array().cast("array<bigint>"))


def fnv1a32(text: Column) -> Column:
    """FNV-1a, 32 bits."""
    return F.aggregate(_bytes(text), F.lit(2166136261).cast("long"), lambda h, b: (h.bitwiseXOR(b) * 16777619).bitwiseAND(F.lit(4294967295)))


def fnv1a64(text: Column) -> Column:
    """FNV-1a, 64 bits, as 16 hex digits. The product with 2^40 + 435 is put together from 32-bit halves, so nothing overflows."""
    low32 = F.lit(4294967295)
    start = F.struct(F.lit(3421674724).cast("long").alias("hi"), F.lit(2216829733).cast("long").alias("lo"))

    def step(h: Column, b: Column) -> Column:
        lo = h["lo"].bitwiseXOR(b)
        product = lo * 435
        hi = h["hi"] * 435 + F.shiftright(product, 32) + F.shiftleft(lo.bitwiseAND(F.lit((1 << 24) - 1)), 8)
        return F.struct(hi.bitwiseAND(low32).alias("hi"), product.bitwiseAND(low32).alias("lo"))

    part = lambda c: F.lpad(F.lower(F.hex(c)), 8, "0")
    return F.aggregate(_bytes(text), start, step, lambda h: F.concat(part(h["hi"]), part(h["lo"])))


def entropy(text: Column) -> Column:
    """Shannon entropy of the bytes, in bits; 0 for the empty text.

    With equal bytes side by side, one walk adds up k * log2(k) of each run's k; a last item that is no byte ends the last run.
    """
    sorted_bytes = F.concat(F.array_sort(_bytes(text)), F.array(F.lit(-1).cast("long")))
    start = F.struct(F.lit(-1).cast("long").alias("last"), F.lit(0.0).alias("run"), F.lit(0.0).alias("sum"), F.lit(0.0).alias("n"))

    def step(a: Column, b: Column) -> Column:
        same = a["last"] == b
        done = F.when(same | (a["run"] < 1), a["sum"]).otherwise(a["sum"] + a["run"] * F.log2(a["run"]))
        return F.struct(b.alias("last"), F.when(same, a["run"] + 1).otherwise(F.lit(1.0)).alias("run"), done.alias("sum"), (a["n"] + 1).alias("n"))

    def finish(a: Column) -> Column:
        n = a["n"] - 1
        return F.when(n > 0, F.greatest(F.log2(n) - a["sum"] / n, F.lit(0.0))).otherwise(F.lit(0.0))

    return F.aggregate(sorted_bytes, start, step, finish)


def djb2(text: Column) -> Column:
    """The hash that starts at 5381 and takes 33 times itself plus each byte, modulo 2^64, as a signed number."""
    low = F.lit((1 << 32) - 1)

    def step(h: Column, b: Column) -> Column:
        lo = h["lo"] * 33 + b
        return F.struct((h["hi"] * 33 + F.shiftright(lo, 32)).bitwiseAND(low).alias("hi"), lo.bitwiseAND(low).alias("lo"))

    start = F.struct(F.lit(0).cast("long").alias("hi"), F.lit(5381).cast("long").alias("lo"))
    return F.aggregate(_bytes(text), start, step, lambda h: F.shiftleft(h["hi"], 32).bitwiseOR(h["lo"]))


def djb2_shard(text: Column, shards: int = 32) -> Column:
    """The shard, of a power of two, of a key by djb2."""
    return F.pmod(djb2(text), F.lit(shards)).cast("int")


def key_values(line: Column) -> Column:
    """'tag a=1 b=2' as a map; words without = are left out, the last of repeated keys counts."""
    pairs = F.filter(F.split(F.trim(line), r"\s+"), lambda w: w.contains("="))
    entries = F.transform(pairs, lambda w: F.struct(F.substring_index(w, "=", 1).alias("key"), F.substr(w, F.instr(w, "=") + 1).alias("value")))
    last = F.filter(entries, lambda e, i: ~F.exists(F.slice(entries, i + 2, F.greatest(F.size(entries) - i - 1, F.lit(0))), lambda o: o["key"] == e["key"]))
    return F.map_from_entries(last)


def log_parts(line: Column) -> Column:
    """date, time, source and message of 'date time source message', null where a part is missing."""
    parts = F.split(F.trim(line), r"\s+", 4)
    return F.struct(*(F.get(parts, i).alias(name) for i, name in enumerate(("date", "time", "source", "message"))))


def log_level(line: Column) -> Column:
    """error, warn, debug or info by the first of these words that the line holds."""
    upper = F.upper(line)
    return F.when(upper.contains("ERROR"), "error").when(upper.contains("WARN"), "warn").when(upper.contains("DEBUG"), "debug").otherwise("info")


# --- statements ---------------------------------------------------------------------------------------------------------

#: The statement kinds by first word: fixed values.
STATEMENT_KINDS = {
    1: ["SELECT", "WITH", "SHOW", "DESCRIBE", "EXPLAIN"],
    2: ["INSERT", "UPDATE", "DELETE", "REPLACE", "MERGE"],
    3: ["CREATE", "DROP", "ALTER", "TRUNCATE", "RENAME"],
    4: ["GRANT", "REVOKE", "SET", "CALL", "EXEC", "EXECUTE"],
}

#: What one step of the scan of a statement takes, first match first.
_TOKENS = r"""(?xs)
    (?P<string>'(?:\\.|''|[^'\\])*(?:'|\\?\Z))        # quotes are doubled or escaped; cut off at the end counts
  | (?P<dollar>\$(?P<tag>[A-Za-z_]\w*)?\$.*?(?:\$(?(tag)(?P=tag))\$|\Z))
  | (?P<comment>--[^\n]*)
  | (?P<block>/\*)
  | (?P<name>"[^"]*(?:"|\Z)|`[^`]*(?:`|\Z))
  | (?P<word>[A-Za-z_$][\w$]*)
  | (?P<number>\d[\d.e]*)
  | (?P<blank>\s+)
"""


def redact_one(statement: str | None, scanner) -> str | None:
    """Literals become ?, comments go, quoted names stay, blanks collapse."""
    if statement is None:
        return None
    out, at = [], 0
    while at < len(statement):
        m = scanner(statement, at)
        kind = m and m.lastgroup
        if kind == "block":
            depth, at = 1, at + 2
            while depth and at < len(statement):
                step = statement[at : at + 2]
                depth += (step == "/*") - (step == "*/")
                at += 2 if step in ("/*", "*/") else 1
            out.append(" ")
            continue
        out.append("?" if kind in ("string", "dollar", "number") else " " if kind in ("comment", "blank") else m[0] if m else statement[at])
        at = m.end() if m else at + 1
    text = "".join(out)
    quoted = []  # blanks inside quoted names stay as they are
    import re

    kept = re.sub(r'"[^"]*"?|`[^`]*`?', lambda m: quoted.append(m[0]) or f"\0{len(quoted) - 1}\0", text)
    kept = re.sub(r"[ ]+", " ", kept).rstrip()
    return re.sub("\0(\\d+)\0", lambda m: quoted[int(m[1])], kept)


@F.pandas_udf(StringType())
def redact(statements: Iterator[pd.Series]) -> Iterator[pd.Series]:
    """redact_one over Arrow batches: nesting comments and escapes are beyond a regular expression."""
    import re

    scanner = re.compile(_TOKENS).match
    groups = ("string", "dollar", "comment", "block", "name", "word", "number", "blank")

    class Kind:
        def __init__(self, m) -> None:
            self.m, self.lastgroup = m, next(g for g in groups if m[g] is not None)

        def __getitem__(self, i):
            return self.m[i]

        def end(self) -> int:
            return self.m.end()

    def scan(text: str, at: int):
        m = scanner(text, at)
        return Kind(m) if m else None

    for batch in statements:
        yield batch.map(lambda s: redact_one(s, scan), na_action="ignore")


def statement_kind(redacted: Column) -> Column:
    """0 other, 1 select, 2 change of rows, 3 change of tables, 4 administration."""
    word = F.upper(F.trim(F.regexp_extract(redacted, r"^\s*(\S*)", 1), F.lit("();")))
    out = F.lit(0)
    for kind, words in STATEMENT_KINDS.items():
        out = F.when(word.isin(words), F.lit(kind)).otherwise(out)
    return out


#: The words that a table's name follows: fixed values.
TABLE_INTRODUCERS = ["FROM", "JOIN", "INTO", "UPDATE", "TABLE"]
#: An introducer, a conditional clause as DDL has it, and a name that may be qualified, bracketed or quoted.
_NAMED_TABLE = rf"(?i)(?<!\S)[^\p{{L}}\p{{N}}\s]*(?:{'|'.join(TABLE_INTRODUCERS)})[^\p{{L}}\p{{N}}\s]*(?=\s+(?:IF\s+(?:NOT\s+)?EXISTS\s+)?[(),;\"`]*([\p{{L}}\p{{N}}_.$]+)[(),;\"`]*(?!\S))"


def tables_of(redacted: Column) -> Column:
    """The tables that a redacted statement names, each once, in order: the name that stands after an introducer, neither a number nor a
    nested SELECT."""
    names = F.regexp_extract_all(redacted, F.lit(_NAMED_TABLE), F.lit(1))
    return F.array_distinct(F.filter(names, lambda x: ~x.rlike(r"^[0-9]+$") & (F.upper(x) != "SELECT")))


def pack_tables(tables: Column, room: int = 64) -> Column:
    """Names joined by commas, as many as fit into `room` bytes whole."""
    bare = F.transform(tables, lambda t: F.element_at(F.split(t, r"\."), -1))
    zero = F.lit("")
    joined = lambda acc, t: F.when(acc == "", t).otherwise(F.concat(acc, F.lit(","), t))
    return F.aggregate(bare, zero, lambda acc, t: F.when(F.octet_length(joined(acc, t)) <= room, joined(acc, t)).otherwise(acc))


def unpack_tables(packed: Column) -> Column:
    """database and tables of names joined by commas: the database where all qualified names agree on it, and the bare names."""
    names = F.filter(F.split(packed, ","), lambda x: x != "")
    qualified = r"^(.+)\.([^.]+)$"
    qualifiers = F.array_distinct(F.filter(F.transform(names, lambda x: F.regexp_extract(x, qualified, 1)), lambda q: q != ""))
    tables = F.transform(names, lambda x: F.when(x.rlike(qualified), F.regexp_extract(x, qualified, 2)).otherwise(x))
    return F.struct(F.when(F.size(qualifiers) == 1, F.get(qualifiers, 0)).alias("database"), tables.alias("tables"))


def database_of(tables: Column) -> Column:
    """The qualifier, if all names have the same one."""
    quals = F.array_distinct(F.transform(tables, lambda t: F.when(t.contains("."), F.regexp_extract(t, r"^(.*)\.[^.]*$", 1)).otherwise(F.lit(""))))
    return F.when((F.size(quals) == 1) & (F.get(quals, 0) != ""), F.get(quals, 0))


def fingerprint(redacted: Column) -> Column:
    """FNV-1a of the redacted text; 0 for the empty one."""
    return F.when(redacted == "", F.lit(0).cast("long")).otherwise(fnv1a32(redacted))
