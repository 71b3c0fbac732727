"""Reference data and settings that change while a stream runs: read again when their generation does, the last good one kept.

A folder holds generations: `generation=<number>/` with the files of one state of the data, and in it an empty file `_SUCCESS` once it is whole.
`Reloading.now()` is asked once a micro-batch (inside foreachBatch) and lists the folder; only a new generation is read. One that cannot be
read, or does not pass its check, is reported and passed over.
"""

from __future__ import annotations

import json
import logging
from collections.abc import Callable
from typing import Generic, TypeVar

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallgrass.functions.network import without_prefix
from tallgrass.sources.events import feed_entries

Loaded = TypeVar("Loaded")
log = logging.getLogger(__name__)


class Reloading(Generic[Loaded]):
    """What load(spark, folder of a generation) gives, of the last generation for which it does not fail."""

    def __init__(self, spark: SparkSession, folder: str, load: Callable[[SparkSession, str], Loaded]) -> None:
        self.spark, self.folder, self.load = spark, folder.rstrip("/"), load
        self.generation, self.refused, self.loaded = -1, set[int](), None

    def _generations(self) -> list[int]:
        path = self.spark._jvm.org.apache.hadoop.fs.Path
        system = path(self.folder).getFileSystem(self.spark._jsc.hadoopConfiguration())
        if not system.exists(path(self.folder)):
            return []
        names = [f.getPath().getName() for f in system.listStatus(path(self.folder)) if f.isDirectory()]
        numbers = {int(n.partition("=")[2]): n for n in names if n.startswith("generation=") and n.partition("=")[2].isdigit()}
        return sorted(n for n, name in numbers.items() if system.exists(path(f"{self.folder}/{name}/_SUCCESS")))

    def now(self) -> Loaded:
        newer = [n for n in self._generations() if n > self.generation and n not in self.refused]
        for n in reversed(newer):
            try:
                self.loaded = self.load(self.spark, f"{self.folder}/generation={n}")
            except Exception as e:
                log.warning("generation %d of %s is refused: %s", n, self.folder, e)
                self.refused.add(n)
                continue
            self.generation = n
            break
        if self.loaded is None:
            raise ValueError(f"{self.folder} has no generation that can be read")
        return self.loaded


#: Entries up to which a set is taken from one generation; more is taken for a fault of the feed.
MOST_ENTRIES = 50_000_000


def load_sets(spark: SparkSession, folder: str) -> dict[str, DataFrame]:
    """Named sets of a generation: folder sets/<name>, of text files with an entry a line. Entries are lower-cased and lose /32 and /128; an
    empty set, or none, is refused."""
    path = spark._jvm.org.apache.hadoop.fs.Path
    at = path(f"{folder}/sets")
    system = at.getFileSystem(spark._jsc.hadoopConfiguration())
    out = {}
    for f in system.listStatus(at):
        name = f.getPath().getName().removesuffix(".txt")
        entries = feed_entries(spark.read.text(f.getPath().toString())).select(without_prefix(F.lower(F.trim("entry"))).alias("entry")).distinct()
        n = entries.count()
        if not 0 < n <= MOST_ENTRIES:
            raise ValueError(f"set {name} has {n} entries")
        out[name] = entries
    if not out:
        raise ValueError("no sets")
    return out


#: The lists that a baseline knows of each kind of entity: fixed values.
BASELINES = {"hosts": ("host", ("domains", "ips", "processes", "users")), "users": ("user", ("countries", "hosts", "geos", "login_hours")), "images": ("baseline.image", ("allowed_processes",)), "workloads": ("baseline.workload", ("allowed_processes",))}
ARTIFACT_VERSION = 1


def load_baselines(spark: SparkSession, folder: str) -> dict[str, DataFrame]:
    """baselines["host.domains"](entity, values) and so on, of a lookup artifact: JSON files of one object {"version": 1, "hosts": {id:
    {"domains": [...]}}, ...}. Lists become texts. Another version, or an object that is no artifact, is refused."""
    lists = {k: f"map<string, struct<{', '.join(f'{x}: array<string>' for x in names)}>>" for k, (_, names) in BASELINES.items()}
    schema = "version int, " + ", ".join(f"{k} {t}" for k, t in lists.items())
    rows = spark.read.schema(schema).option("multiLine", True).option("mode", "FAILFAST").json(f"{folder}/baselines*.json")
    wrong = rows.filter(~F.col("version").eqNullSafe(F.lit(ARTIFACT_VERSION))).count()
    if wrong or rows.isEmpty():
        raise ValueError(f"{wrong} lookup artifacts are not of version {ARTIFACT_VERSION}")
    out = {}
    for kind, (name, parts) in BASELINES.items():
        each = rows.select(F.explode(kind).alias("entity", "known"))
        for part in parts:
            out[f"{name}.{part}"] = each.groupBy(F.trim("entity").alias("entity")).agg(F.flatten(F.collect_set(F.coalesce(F.col(f"known.{part}"), F.array().cast("array<string>")))).alias("values"))
    return out


def load_settings(build: Callable[[dict], Loaded]) -> Callable[[SparkSession, str], Loaded]:
    """For rules with settings: reads settings.json and builds the rules with it, which fails where the settings do not fit."""

    def load(spark: SparkSession, folder: str) -> Loaded:
        text = "\n".join(r[0] for r in spark.read.option("wholetext", True).text(f"{folder}/settings.json").collect())
        return build(json.loads(text))

    return load
