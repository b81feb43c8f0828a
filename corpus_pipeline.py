"""From documents to shards: language, near-duplicates, contamination, mixture, shards.

Each stage takes what its predecessor kept, written as Parquet. The first four return the columns of ``documents``:
rows are dropped, or repeated by the mixture; the last returns where each row goes. Its places name documents by id, so
the texts are not moved again.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from basketspark.functions import ensure_checkpoint_dir, stable, stored
from basketspark.llm.decontaminate import contaminated_texts
from basketspark.llm.language import UNKNOWN, learn_languages, predict_languages, usual_fit
from basketspark.llm.mixing import mix_sources
from basketspark.llm.near_dedup import near_groups
from basketspark.llm.sharding import byte_shards
from basketspark.llm.tables import broadcast_if_small

SHARDS = 40
LESS, FAR = 2.5, 4
HAS_WORD = r"[^\x20\x09-\x0D]"

#: A sum of probabilities over segmentations and a Newton iteration are not SQL; tests compare with plain loops.
ORACLE_SQL = None


def _without(docs: DataFrame, keys: DataFrame, key: str) -> DataFrame:
    return docs.join(broadcast_if_small(keys), key, "left_anti")


def keep_known_languages(spark: SparkSession, docs: DataFrame, folder: str) -> DataFrame:
    """Documents with letters in one of the learned languages, by a model of all labelled rows.

    A posterior tells which language is likeliest, and is near one for any text of some length. What is rejected is text
    that its likeliest language explains less well than that language's own documents: by more than ``LESS`` nats a byte,
    and by more than ``FAR`` of the standard deviations of a text of its length.
    """
    model = learn_languages(docs)
    told = stored(predict_languages(docs, model).where(F.col("lang_pred") != UNKNOWN))  # what is usual is read from it too
    usual = F.broadcast(usual_fit(told).select(F.col("lang").alias("lang_pred"), "mean", "spread"))  # one row a language
    told = told.join(usual, "lang_pred", "left")
    short = F.col("mean") - F.col("fit")
    strange = (short > LESS) & (short * F.sqrt(F.col("fit_bytes")) > FAR * F.sqrt("spread"))
    return told.where(~F.coalesce(strange, F.lit(False))).select(*docs.columns)


def keep_one_of_each(spark: SparkSession, docs: DataFrame, folder: str) -> DataFrame:
    """One row of each group of near-duplicate texts: the one with the smallest id, missing ids last.

    Texts are told by their hashes, so ids may repeat or be missing: a row goes only if its own text is in the group.
    Texts without words are near nothing and stay.
    """
    text, row = F.xxhash64("text"), F.xxhash64("text", "doc_id")
    worded = F.coalesce(F.col("text").rlike(HAS_WORD), F.lit(False))
    first = F.struct(F.col("doc_id").isNull().alias("missing"), "doc_id", "_row")
    rows = docs.where(worded).select(text.alias("_text"), row.alias("_row"), "doc_id")
    rows = stable(rows.groupBy("_text", "_row", "doc_id").agg(F.count(F.lit(1)).alias("n")))
    texts = stable(rows.groupBy("_text").agg(F.min(first).alias("first")))
    copies = rows.join(texts.select(F.col("first._row").alias("_row")), "_row", "left_anti").select("_row").distinct()
    named = docs.withColumns({"_text": text, "_row": F.when(worded, row)})
    one = _without(named, copies, "_row")
    # rows that repeat text and id: the first is as good as any
    again = rows.where("n > 1").select("_row").distinct()
    once = one.join(broadcast_if_small(again), "_row", "left_semi").dropDuplicates(["_row"])
    one = _without(one, again, "_row").unionByName(once)

    groups = near_groups(one.where("_row is not null").select("_text", "text"), id_col="_text")
    members = stable(groups.select(F.col("doc_id").alias("_text"), "component_id").join(texts, "_text"))
    kept = members.groupBy("component_id").agg(F.min("first").alias("first")).select(F.col("first._row").alias("_row"))
    near = members.select(F.col("first._row").alias("_row")).join(kept, "_row", "left_anti")
    return _without(one, near, "_row").select(*docs.columns)


def drop_contaminated(spark: SparkSession, docs: DataFrame, folder: str) -> DataFrame:
    """Documents without half or more of a benchmark item; told by their texts, so ids may repeat or be missing."""
    benchmark = spark.read.parquet(f"{folder}/benchmark.parquet")
    gone = contaminated_texts(docs, benchmark)[0].select("doc").distinct()
    return docs.join(broadcast_if_small(gone), F.xxhash64("text") == F.col("doc"), "left_anti")


def mix(spark: SparkSession, docs: DataFrame, folder: str) -> DataFrame:
    """Each document as often as the mixture takes it."""
    copies = F.explode(F.array_repeat(F.lit(0), F.col("copies").cast("int"))).alias("_copy")
    return mix_sources(docs).select(*docs.columns, copies).drop("_copy")


def shard(spark: SparkSession, docs: DataFrame, folder: str) -> DataFrame:
    """The documents' columns but the text, with size, checksum, shard and place in the shard."""
    return byte_shards(docs, SHARDS, carry=[c for c in docs.columns if c != "text"])


STAGES = [
    ("language", keep_known_languages),
    ("near_dedup", keep_one_of_each),
    ("decontamination", drop_contaminated),
    ("mixing", mix),
    ("sharding", shard),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents of ``sf_dir``; what each one keeps is written to the shared folder and reread."""
    ensure_checkpoint_dir(spark)
    base = f"{spark.sparkContext.getCheckpointDir()}/pipeline-{uuid.uuid4().hex}"
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        stage(spark, docs, sf_dir).write.parquet(f"{base}/{name}")
        docs = spark.read.parquet(f"{base}/{name}")
    return docs
