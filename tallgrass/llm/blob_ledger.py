"""Secrets in every version of every file, each content scanned once for each version of each rule.

A text's address is its SHA-256, so copies, moves and versions that come back are one blob. The ledger, a table of (blob, rules it was
scanned for, spans found), tells which pairs of blob and rule version are new; only those texts move to be scanned, and what is found goes
into the ledger and back to every row that has the blob. A run that fails leaves the ledger as it was; a second one scans what is still new.

All work is done by DataFrame functions: a rule's matches and the texts between them, whose lengths add up to the places of the matches.
Copies of one text are combined before they move. A blob that many rows have is met by its rows in several parts.

Null text counts as empty. Repeated rows each get their spans. Places are code points from 0, the end exclusive. No rows give no rows. A
result column takes the place of an input column of its name, and no other name can clash.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tallgrass.llm.shared import BROADCAST_ROWS, discard, new_folder, shielded, stored

#: A blob that more than one in so many rows have is met in parts, so that no part has more than that share.
PARTS = 256


@dataclass(frozen=True)
class Rule:
    """A kind of secret: matches of the pattern, from left to right, whose part `value` (0: the whole) has `least` characters or more.
    A new `version` has every blob scanned for this rule again. Patterns use what all engines read alike and never match nothing."""

    kind: str
    pattern: str
    value: int = 0
    least: int = 1
    version: int = 1

    @property
    def key(self) -> str:
        return f"{self.kind}@{self.version}"


def either_case(word: str) -> str:
    """A pattern for ASCII letters in either case; other characters stay."""
    return "".join(f"[{c.upper()}{c.lower()}]" if c.isalpha() else c for c in word)


_NAMES = "|".join(either_case(w) for w in ("password", "passwd", "secret", "token", "api_?key"))

#: The three base rules, in the order in which their spans stand, then those that the method adds.
RULES = (
    Rule("assign", rf"(?:{_NAMES})[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)", 1, 6),
    Rule("access", r"AKIA[A-Z0-9]+", 0, 20),
    # runs are matched whole, so asking for the length in the pattern finds the same and passes by the short ones
    Rule("hex", r"[0-9a-f]{24,}", 0, 24),
    Rule("pem", r"-----BEGIN [A-Z0-9 ]*PRIVATE KEY-----"),
    Rule("jwt", r"eyJ[A-Za-z0-9_-]+\.eyJ[A-Za-z0-9_-]+\.[A-Za-z0-9_-]+", 0, 40),
    Rule("hosted", r"gh[pousr]_[A-Za-z0-9]+", 0, 40),
    Rule("chat", r"xox[abprs]-[A-Za-z0-9-]+", 0, 20),
    Rule("login", r"[a-z][a-z0-9+.-]*://[^/?#@:\x09-\x0D\x20]+:([^/?#@\x09-\x0D\x20]+)@", 1, 6),
)

_MATCH = "array<struct<rule:string,i:int,gap:int,size:int,kept:boolean>>"
LEDGER = "blob binary, rules array<string>, spans array<struct<rule:string,start:int,end:int>>"


def address(text: Column) -> Column:
    return F.unhex(F.sha2(F.coalesce(text, F.lit("")).cast("binary"), 256))


def open_ledger(spark, folder: str) -> DataFrame:
    """The ledger in a folder, which is made if it is not there."""
    at = spark._jvm.org.apache.hadoop.fs.Path(folder)
    at.getFileSystem(spark._jsc.hadoopConfiguration()).mkdirs(at)
    return spark.read.schema(LEDGER).parquet(folder)


def _matches(rule: Rule) -> Column:
    """Of each match of the rule in the column text, in order: the characters between it and the one before, its own, and whether it is long
    enough; then a row without a size for what comes after the last. Null if the rule is not asked for or matches nothing."""
    text, pattern = F.col("text"), F.lit(rule.pattern)
    whole, value = F.regexp_extract_all(text, pattern, F.lit(0)), F.regexp_extract_all(text, pattern, F.lit(rule.value))
    both = F.arrays_zip(F.split(text, rule.pattern, -1).alias("gap"), whole.alias("whole"), value.alias("value"))
    row = lambda z, i: F.struct(F.lit(rule.key).alias("rule"), i.alias("i"), F.length(z["gap"]).alias("gap"), F.length(z["whole"]).alias("size"), (F.length(z["value"]) >= rule.least).alias("kept"))
    return F.when(F.array_contains("todo", rule.key) & text.rlike(rule.pattern), F.transform(both, row))


def _scanned(texts: DataFrame, rules: tuple[Rule, ...]) -> DataFrame:
    """The ledger's rows for texts(blob, text, todo), one a blob."""
    matches = F.concat(*(F.coalesce(m, F.array().cast(_MATCH)) for m in map(_matches, rules)))
    rows = texts.select("blob", "todo", F.explode_outer(matches).alias("m")).select("blob", "todo", "m.*")
    # no shuffle from here on: a blob's rows are where its text was
    along = Window.partitionBy("blob", "rule").orderBy("i").rowsBetween(Window.unboundedPreceding, 0)
    placed = rows.withColumn("end", F.sum(F.col("gap") + F.col("size")).over(along).cast("int"))
    span = F.struct("rule", (F.col("end") - F.col("size")).alias("start"), "end")
    return placed.groupBy("blob").agg(F.first("todo").alias("rules"), F.collect_list(F.when(F.col("kept"), span)).alias("spans"))


def unseen(addressed: DataFrame, ledger: DataFrame, keys: list[str]) -> DataFrame:
    """blob, todo: the rules that the ledger has not scanned the blob for; blobs with nothing to do are left out."""
    done = ledger.groupBy("blob").agg(F.array_distinct(F.flatten(F.collect_set("rules"))).alias("done"))
    pairs = addressed.select("blob").distinct().join(done, "blob", "left")
    return pairs.select("blob", F.array_except(F.array(*map(F.lit, keys)), F.coalesce("done", F.array().cast("array<string>"))).alias("todo")).filter(F.size("todo") > 0)


def update(addressed: DataFrame, folder: str, rules: tuple[Rule, ...] = RULES) -> int:
    """Scans what is new in addressed(blob, text), appends it to the ledger, and tells how many pairs of blob and rule were new."""
    spark = addressed.sparkSession
    ledger = open_ledger(spark, folder)
    todo = stored(unseen(addressed, ledger, [r.key for r in rules]), "unseen")
    facts = todo.agg(F.count(F.lit(1)).alias("blobs"), F.sum(F.size("todo")).alias("pairs")).first()
    if facts["blobs"]:
        few = facts["blobs"] <= BROADCAST_ROWS
        wanted = addressed.join(F.broadcast(todo.select("blob")), "blob", "left_semi") if few else addressed
        # copies are combined before the shuffle; the same address, so the same text
        texts = wanted.select("blob", F.coalesce("text", F.lit("")).alias("text")).groupBy("blob").agg(F.first("text").alias("text"))
        _scanned(texts.join(todo.hint("shuffle_hash"), "blob"), rules).select("blob", "rules", "spans").write.mode("append").parquet(folder)
    discard(todo)
    return facts["pairs"] or 0


def _in_parts(paths: DataFrame, found: DataFrame) -> DataFrame:
    """Left join on blob. At most PARTS blobs have more than one row in PARTS; their rows are dealt over several copies of what was found."""
    rows = paths.count()
    hot = paths.groupBy("blob").count().filter(F.col("count") * PARTS > rows).select("blob", F.ceil(F.col("count") * PARTS / F.lit(rows)).cast("int").alias("__parts"))
    hot = F.broadcast(hot)
    left = paths.join(hot, "blob", "left").withColumn("__part", F.pmod(F.monotonically_increasing_id(), F.coalesce("__parts", F.lit(1))).cast("int")).drop("__parts")
    right = found.join(hot, "blob", "left").withColumn("__part", F.explode(F.sequence(F.lit(0), F.coalesce("__parts", F.lit(1)) - 1))).drop("__parts")
    return left.join(right, ["blob", "__part"], "left").drop("__part")


def scan(versions: DataFrame, ledger: str | None = None, rules: tuple[Rule, ...] = RULES, text: str = "text") -> DataFrame:
    """Every row of versions without its text, with blob (hex) and spans, an array of (kind, start, end) by start, then by the rule's place
    in `rules`. ledger: its folder in a store that driver and executors share; without one, a new one that goes with the application."""
    spark = versions.sparkSession
    folder = ledger or new_folder(spark, "ledger")
    hidden, restore = shielded(versions.withColumnRenamed(text, "text"), ["text"])
    addressed = hidden.withColumn("blob", address(F.col("text")))
    paths = stored(addressed.drop("text"), "paths")
    update(addressed.select("blob", "text"), folder, rules)
    keys = [r.key for r in rules]
    current = lambda spans: F.filter(spans, lambda s: s["rule"].isin(keys))
    # a blob has one row for each run that scanned it for new rules
    found = open_ledger(spark, folder).select("blob", current(F.col("spans")).alias("spans")).filter(F.size("spans") > 0)
    found = found.groupBy("blob").agg(F.array_distinct(F.flatten(F.collect_list("spans"))).alias("spans"))
    of = F.create_map(*(x for n, r in enumerate(rules) for x in (F.lit(r.key), F.struct(F.lit(n).alias("rank"), F.lit(r.kind).alias("kind")))))
    ranked = F.array_sort(F.transform("spans", lambda s: F.struct(s["start"], of[s["rule"]]["rank"].alias("rank"), s["end"], of[s["rule"]]["kind"].alias("kind"))))
    found = found.select("blob", F.transform(ranked, lambda s: F.struct(s["kind"].alias("kind"), s["start"].alias("start"), s["end"].alias("end"))).alias("spans"))
    joined = _in_parts(paths, found)
    spans = F.coalesce("spans", F.array().cast("array<struct<kind:string,start:int,end:int>>"))
    return restore(joined.withColumns({"blob": F.lower(F.hex("blob")), "spans": spans}))


def findings(scanned: DataFrame) -> DataFrame:
    """One row a span: scanned's columns with kind, start and end."""
    return scanned.withColumn("__s", F.explode("spans")).select(*(c for c in scanned.columns if c not in ("spans", "kind", "start", "end")), "__s.*")


def written(spans: Column) -> Column:
    """kind:start:end of each span, comma-joined."""
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")
