"""Working tables in the cluster's shared folder, joins with a side of checked size, and column names that cannot clash."""

from __future__ import annotations

import atexit
import os
import shutil
import tempfile
import uuid
from collections.abc import Callable, Iterator
from weakref import WeakKeyDictionary

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rows up to which a narrow side (a few numbers a row) is broadcast; beyond it the join is salted.
BROADCAST_ROWS = 50_000
#: A key is hot if it has more than this share of all rows; so there are at most 20,000 hot keys, whatever the data.
HOT_SHARE = 1 / 20_000
#: Stands in for a null doc_id inside an operator: no id is larger. `freed` sees to it that no row has it as its own id.
NO_ID = (1 << 63) - 1

_own_folder: dict[str, str] = {}
_path_of: WeakKeyDictionary[DataFrame, str] = WeakKeyDictionary()


def shared_folder(spark: SparkSession) -> str:
    """spark.checkpoint.dir, or the context's checkpoint folder; a temporary folder of ours only on a single machine, as in tests."""
    context = spark.sparkContext
    found = spark.conf.get("spark.checkpoint.dir", None) or context.getConf().get("spark.checkpoint.dir") or context.getCheckpointDir()
    if found:
        return found.rstrip("/")
    if not context.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    app = context.applicationId
    if app not in _own_folder:
        _own_folder[app] = tempfile.mkdtemp(prefix="tallgrass-")
        atexit.register(shutil.rmtree, _own_folder[app], ignore_errors=True)
    return f"file://{_own_folder[app]}"


def _file_system(spark: SparkSession, path: str):
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark._jsc.hadoopConfiguration()), at


def new_folder(spark: SparkSession, name: str) -> str:
    """A new folder for working files; it goes when the application ends, if `delete` has not taken it before."""
    path = f"{shared_folder(spark)}/tallgrass-{name}-{uuid.uuid4().hex[:12]}"
    system, at = _file_system(spark, path)
    system.mkdirs(at)
    system.deleteOnExit(at)
    return path


def delete(spark: SparkSession, path: str) -> None:
    system, at = _file_system(spark, path)
    system.delete(at, True)


def stored(df: DataFrame, name: str) -> DataFrame:
    """Writes df as a table in the shared folder and reads it back: its lineage ends here, and a lost executor costs nothing already computed."""
    path = new_folder(df.sparkSession, name)
    df.write.mode("overwrite").parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    _path_of[out] = path
    return out


def discard(*tables: DataFrame) -> None:
    """Deletes stored tables that nothing still to be computed reads."""
    for df in tables:
        if path := _path_of.pop(df, None):
            delete(df.sparkSession, path)


def shielded(df: DataFrame, uses: list[str]) -> tuple[DataFrame, Callable[[DataFrame], DataFrame]]:
    """df with every column but `uses` under the name __c0, __c1, ..., so that no name of an operator's own can meet it; and what puts
    the names back. A result column takes the place of an input column of its name."""
    hidden = [c if c in uses else f"__c{i}" for i, c in enumerate(df.columns)]
    names = {h: c for h, c in zip(hidden, df.columns, strict=True) if h != c}

    def restore(out: DataFrame) -> DataFrame:
        results = {c.lower() for c in out.columns if c not in names}
        kept = [c for c in out.columns if c not in names or names[c].lower() not in results]
        return out.select(*kept).toDF(*(names.get(c, c) for c in kept))

    return df.toDF(*hidden), restore


def freed(docs: DataFrame, id: str = "doc_id") -> tuple[DataFrame, Callable[[Column], Column]]:
    """docs in which no row has NO_ID as its id, and what turns an id of them back. Only where one has it: n distinct ids leave one of the
    values 0 .. n unused; the ids above that move down by one, in their order."""
    own = F.col(id).cast("long")
    if docs.filter(own == F.lit(NO_ID)).isEmpty():
        return docs, lambda c: c
    ids = docs.select(own.alias("id")).filter("id IS NOT NULL").distinct()
    unused = docs.sparkSession.range(ids.count() + 1).join(ids, "id", "left_anti").agg(F.min("id")).first()[0]
    moved = F.when(own > F.lit(unused), own - 1).otherwise(own)
    return docs.withColumn(id, moved), lambda c: F.when(c >= F.lit(unused), c + 1).otherwise(c)


def _on_mount(folder: str) -> str | None:
    """The folder as a path if it is on a mount, else None."""
    return folder.removeprefix("file://") if folder.startswith("file:") else None if "://" in folder else folder


def save(folder: str, name: str, data: bytes | memoryview) -> None:
    """Writes a file of the shared folder, in a task: under a name of its own, then renamed, so a task may run twice."""
    path = _on_mount(folder)
    if path:
        os.makedirs(path, exist_ok=True)
        with open(temporary := f"{path}/.{name}-{uuid.uuid4().hex}", "wb") as out:
            out.write(data)
        os.replace(temporary, f"{path}/{name}")
        return
    system, at = fs.FileSystem.from_uri(folder)
    system.create_dir(at, recursive=True)
    with system.open_output_stream(f"{at}/{name}") as out:
        out.write(data)


_fetched: dict[str, str] = {}


def file_of(folder: str, name: str) -> str | None:
    """The path of a file that `save` wrote, in a task: in place on a mount, else a copy that goes when the worker ends; None if there is
    no such file."""
    path = _on_mount(folder)
    if path is None:
        if folder not in _fetched:
            _fetched[folder] = tempfile.mkdtemp()
            atexit.register(shutil.rmtree, _fetched[folder], ignore_errors=True)
        path = _fetched[folder]
        system, at = fs.FileSystem.from_uri(folder)
        if not os.path.exists(f"{path}/{name}") and system.get_file_info(f"{at}/{name}").type == fs.FileType.File:
            fs.copy_files(f"{at}/{name}", f"{path}/{name}", source_filesystem=system, destination_filesystem=fs.LocalFileSystem())
    return f"{path}/{name}" if os.path.exists(f"{path}/{name}") else None


def gathered(batches: Iterator[pa.RecordBatch], at: int, size: int) -> Iterator[pa.RecordBatch]:
    """In a task: the same rows in batches of about `size` bytes in column `at`."""
    held, now = [], 0
    for batch in batches:
        held.append(batch)
        now += batch.column(at).nbytes
        if now >= size:
            yield from pa.Table.from_batches(held).combine_chunks().to_batches()
            held, now = [], 0
    if held:
        yield from pa.Table.from_batches(held).combine_chunks().to_batches()


def id_text(column: str = "doc_id") -> Column:
    """The id as text; null counts as empty text."""
    return F.coalesce(F.col(column).cast("string"), F.lit(""))


def crc_mod(modulus: int, column: str = "doc_id") -> Column:
    return F.crc32(id_text(column).cast("binary")) % F.lit(modulus)


def join_small(big: DataFrame, small: DataFrame, keys: list[str], rows: int | None = None, salts: int = 64) -> DataFrame:
    """Left join on null-safe keys, for a small side with one row a key. Broadcast only after its rows are counted; a larger one
    is copied `salts` times and joined on the salted keys, so a key that holds a third of the big side is spread over many tasks."""
    n = small.count() if rows is None else rows
    for k in keys:
        small = small.withColumnRenamed(k, f"__{k}")
    on = [F.col(k).eqNullSafe(F.col(f"__{k}")) for k in keys]
    if n <= BROADCAST_ROWS:
        joined = big.join(F.broadcast(small), on, "left")
    else:
        small = small.withColumn("__salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
        big = big.withColumn("__at", F.pmod(F.xxhash64(*big.columns), F.lit(salts)).cast("int"))
        joined = big.join(small, [*on, F.col("__at") == F.col("__salt")], "left").drop("__salt", "__at")
    return joined.drop(*[f"__{k}" for k in keys])


def join_counted(big: DataFrame, small: DataFrame, key: str, n: str, rows: int) -> DataFrame:
    """Inner join of big, of `rows` rows, with small, which has one row a key and in column n how many rows of big the key has. The keys
    with more than HOT_SHARE of the rows, at most 1 / HOT_SHARE of them, are broadcast, so no key gathers in one task."""
    limit = F.lit(rows * HOT_SHARE)
    hot = F.broadcast(small.filter(F.col(n) > limit))
    rest = big.join(F.broadcast(hot.select(key)), key, "left_anti").join(small.filter(F.col(n) <= limit).hint("merge"), key)
    return big.join(hot, key).unionByName(rest)
