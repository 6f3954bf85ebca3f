"""A corpus pipeline over the documents table.

Each stage is a function of (spark, docs, sf_dir) that works on all that the stage before kept; its
result is written as Parquet and read again as the next one's docs.  Quality and decontamination
decide by doc_id (rows with one id are kept if any of them is), near-dedup by doc_id and text; null
texts are empty; further columns are carried along; an empty table stays empty.
"""

from __future__ import annotations

from functools import reduce

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from crewspark.llm import decontamination, minhash_dedup, packing, quality_lm, secret_scan
from crewspark.llm.common import shared_dir, slices, stage, table
from crewspark.shipping import map_in_arrow

#: Rows up to which a stage's decisions are broadcast (16 bytes each); more are joined by shuffle.
BROADCAST_IDS = 1_000_000


def _with_ids(docs: DataFrame, ids: DataFrame, how: str) -> DataFrame:
    ids = stage(ids.select(F.col("doc_id").alias("__id")))
    own = F.broadcast(ids) if ids.count() <= BROADCAST_IDS else ids
    return docs.join(own, docs["doc_id"].cast("long").eqNullSafe(own["__id"]), how)


def _text_hash():
    return F.xxhash64(F.coalesce("text", F.lit("")))


def _with_texts(docs: DataFrame, keys: DataFrame, how: str) -> DataFrame:
    """docs joined to keys (doc_id, txt)."""
    keys = stage(keys.select(F.col("doc_id").alias("__id"), F.col("txt").alias("__txt")))
    own = F.broadcast(keys) if keys.count() <= BROADCAST_IDS else keys
    return docs.join(own, docs["doc_id"].cast("long").eqNullSafe(own["__id"]) & (_text_hash() == own["__txt"]), how)


def _without(docs: DataFrame, judged: DataFrame, good: str) -> DataFrame:
    """docs without the ids of which no judged row is good."""
    bad = judged.groupBy("doc_id").agg(F.max(good).alias("good")).where("NOT good")
    return _with_ids(docs, bad, "left_anti")


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    trusted = table(spark, sf_dir, "labels").where("quality = 1").select("doc_id")
    return _without(docs, quality_lm.classify(docs, trusted), "keep")


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group stays, that with the least doc_id; among its rows with several texts
    that with the least hash, and one of equal rows.  Texts are told apart under one id."""
    found = minhash_dedup.near_duplicates(docs)
    own = stage(found.groupBy("doc_id", "txt").agg(F.count("*").alias("n"), F.first("component").alias("component"), F.max("kept").alias("kept")))
    several = own.where("kept AND component IS NOT NULL").groupBy("component").agg(F.min("txt").alias("least"), F.count("*").alias("texts")).where("texts > 1")
    second = own.where("kept").join(several, "component").where("txt <> least")
    bad = own.where("NOT kept").select("doc_id", "txt").union(second.select("doc_id", "txt"))
    kept = _with_texts(docs, bad, "left_anti")
    again = stage(own.where("n > 1").select("doc_id", "txt"))
    if not again.limit(1).count():
        return kept
    equal = _with_texts(kept, again, "left_semi").withColumn("__txt", _text_hash()).dropDuplicates(["doc_id", "__txt"]).drop("__txt")
    return _with_texts(kept, again, "left_anti").unionByName(equal)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    found = decontamination.find_leaks(docs, table(spark, sf_dir, "benchmark"))
    return _without(docs, found.select("doc_id", (~F.col("contaminated")).alias("clean")), "clean")


def redact_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    at = docs.columns.index("text")

    def run(batches):
        enc = secret_scan.encoder()
        for whole in batches:
            for batch in slices(whole, at):
                texts = [secret_scan.redact(t, secret_scan.spans_of(t, enc)) for t in batch.column(at).to_pylist()]
                columns = list(batch.columns)
                columns[at] = pa.array(texts, type=columns[at].type)
                yield pa.RecordBatch.from_arrays(columns, schema=batch.schema)

    clean = map_in_arrow(docs, run, docs.schema)
    if "n_chars" in docs.columns:
        clean = clean.withColumn("n_chars", F.char_length(F.coalesce("text", F.lit(""))).cast(docs.schema["n_chars"].dataType))
    return clean


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return packing.pack(docs)


STAGES = [
    ("quality classifier", quality),
    ("minhash near-dedup", near_dedup),
    ("benchmark decontamination", decontaminate),
    ("secret scans", redact_secrets),
    ("packing", pack),
]

#: No SQL expresses the models and automata; the tests hold run() against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    def step(docs: DataFrame, function) -> DataFrame:
        path = shared_dir(spark)
        function(spark, docs, sf_dir).write.parquet(path)
        return spark.read.parquet(path)

    return reduce(step, [f for _, f in STAGES], table(spark, sf_dir, "documents"))
