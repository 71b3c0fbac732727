"""The corpus pipeline: five stages over documents, each written as a table and read again as the next one's input.

Every stage gets (spark, docs, sf_dir) and returns a DataFrame; all but the last return the columns of documents, whatever their names: a
stage hides those that it does not use while it works.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tallgrass.llm import balanced_mix, decontaminate, ngram_join, quality_model, shard_table
from tallgrass.llm.shared import NO_ID, crc_mod, freed, shielded, stored

#: A document below this score goes.
LEAST_QUALITY = 0.3


def _id() -> Column:
    return F.coalesce(F.col("doc_id"), F.lit(NO_ID)).alias("__id")


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops the documents that the quality classifier rejects. It learns from labels of documents outside the fifth held out."""
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet").filter(crc_mod(5) != 0)
    rows, restore = shielded(docs, ["doc_id", "text"])
    model = quality_model.learned_from_texts(rows, labels)
    return restore(quality_model.score_texts(rows, model).filter(F.col("score") >= LEAST_QUALITY).select(*rows.columns))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of documents linked by 5-word shingles (Jaccard 0.8 or more) one stays: the one with the smallest id.

    Rows without an id are documents of their own: one of a group that holds no id stays, and each of those without words. Rows that
    share an id are documents by their texts: if several of a group have its smallest id, the one with the least text stays, and each of
    them that leads a group of its own; of those without words one of each text.
    """
    rows, restore = shielded(docs, ["doc_id", "text"])
    rows, back = freed(rows)
    return restore(_led(rows).withColumn("doc_id", back(F.col("doc_id"))))


def _led(docs: DataFrame) -> DataFrame:
    groups = ngram_join.grouped(docs.select("doc_id", "text"))
    named = docs.withColumn("__id", _id())
    again = stored(named.groupBy("__id").count().filter("count > 1").select("__id"), "repeated-ids")
    # the group's smallest id is the own id of the row that stays
    if again.isEmpty():
        return named.join(groups.filter("doc = component").select(F.col("doc").alias("__id")), "__id", "left_semi").select(*docs.columns)
    leads = stored(groups.filter("doc = component"), "leads")
    without = F.col("__id") == F.lit(NO_ID)
    repeated = again.filter(~without)
    kept = named.filter(~without).join(leads.filter(F.col("doc") != F.lit(NO_ID)).select(F.col("doc").alias("__id")).distinct(), "__id", "left_semi")
    rest = [c for c in docs.columns if c != "text"]
    # maps have no order
    ordered = [F.to_json(F.struct(f.name)) if "map<" in f.dataType.simpleString() else F.col(f.name) for f in docs.schema if f.name != "text"]

    def least(rows: DataFrame, keys: list[str]) -> DataFrame:
        """Of the rows with the same keys the one with the least text; with __size and the keys."""
        order = F.struct(F.col("__size") == 0, F.coalesce("text", F.lit("")), F.col("text"), *ordered)
        row = F.min_by(F.struct("text", *rest, "__size"), order).alias("__row")
        found = rows.groupBy(*(F.col(k).alias(f"__key{i}") for i, k in enumerate(keys))).agg(row)
        return found.select(*(F.col("__row")[c].alias(c) for c in [*docs.columns, "__size"]), *(F.col(f"__key{i}").alias(k) for i, k in enumerate(keys)))

    of_set = [F.col(c).alias(f"__{c}") for c in ("one", "two", "group", "group2")]
    once = kept.join(repeated, "__id", "left_anti").select(*docs.columns)
    # rows of one id that do not lead their own group go before one of each group is taken; those without words are told apart by their texts
    led = leads.filter("size > 0").join(repeated, F.col("doc") == F.col("__id"), "left_semi").select(F.col("doc").alias("__id"), *of_set).distinct()
    more = ngram_join.with_set_keys(kept.join(repeated, "__id", "left_semi"))
    words = more.filter("__size > 0").join(led, ["__id", "__one", "__two"])
    wordless = more.filter("__size = 0").withColumns({"__group": F.xxhash64("text"), "__group2": F.hash("text").cast("long")})
    shared = least(words.unionByName(wordless), ["__id", "__group", "__group2"])
    # rows without an id: equal sets first, so that the join meets each set once
    keyed = ngram_join.with_set_keys(named.filter(without))
    free = leads.filter((F.col("doc") == F.lit(NO_ID)) & (F.col("size") > 0)).select(*of_set).distinct()
    single = least(least(keyed.filter("__size > 0"), ["__one", "__two"]).join(free, ["__one", "__two"]), ["__group", "__group2"])
    blank = keyed.filter("__size = 0")
    return once.unionByName(shared.select(*docs.columns)).unionByName(single.select(*docs.columns)).unionByName(blank.select(*docs.columns))


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents that hold ten consecutive words of a benchmark item, or a whole shorter item: one such passage is enough."""
    items = spark.read.parquet(f"{sf_dir}/benchmark.parquet")
    rows, restore = shielded(docs, ["text"])
    return restore(decontaminate.scan(rows, items).filter(F.col("n_hit") == 0).select(*rows.columns))


def mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each source to its target weight: a document is repeated as often as the mix takes it, or goes."""
    named, restore = shielded(docs, ["doc_id", "text", "source"])
    keys = {"doc_id": "__id", "text_key": "__key", "source": "__source"}
    taken = balanced_mix.mix(named).groupBy(*keys).agg(F.sum("copies").alias("__copies"), F.count(F.lit(1)).alias("__rows"))
    taken = stored(taken.filter("__copies > 0").withColumnsRenamed(keys), "copies")
    same = F.col("doc_id").eqNullSafe(F.col("__id")) & (balanced_mix.text_key() == F.col("__key")) & F.col("source").cast("string").eqNullSafe(F.col("__source"))
    rows = named.join(taken.filter("__rows = 1"), same)
    again = taken.filter("__rows > 1")
    if not again.isEmpty():
        # rows with the same id, text and source share their copies
        place = F.row_number().over(Window.partitionBy(*keys.values()).orderBy("__rows"))
        shared = named.join(again, same).withColumn("__copies", F.floor((F.col("__copies") + F.col("__rows") - place) / F.col("__rows")))
        rows = rows.unionByName(shared.filter("__copies > 0"))
    return restore(rows.select(*named.columns, F.explode(F.sequence(F.lit(1).cast("long"), F.col("__copies"))).alias("__n")).drop("__n"))


def sharding(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Adds slot and shard by the id."""
    return shard_table.place(docs)


STAGES = [
    ("quality classifier", quality),
    ("n-gram Jaccard join", near_duplicates),
    ("benchmark decontamination", decontamination),
    ("mixing sources to target weights", mixture),
    ("sharding", sharding),
]

#: No stage before the last can be put in SQL; the tests hold the pipeline against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir), f"stage-{name.replace(' ', '-')}")
    return STAGES[-1][1](spark, docs, sf_dir)
