"""Documents to training sequences: language ID, near-dedup, secret scan, source mix, packing.

Each stage takes the documents its predecessor kept and returns documents again (the last one returns packed pieces).
``run`` stores every stage as Parquet in the shared folder and reads it back, so a lost executor repeats one stage at most.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from featsieve.functions import bounded_rows
from featsieve.llm import credential_links, crf_language, dart_minhash, packing, poisson_mix
from featsieve.llm.common import CORE, own_names, stored, text_or_empty


BATCHES, BATCH_BYTES = "spark.sql.execution.arrow.maxBytesPerBatch", "2m"


def small_batches(spark: SparkSession) -> None:
    """Texts go to Python in batches of 2 MB from now on, unless the session has a limit of its own; results are the same.

    By default 10,000 documents make a batch, 35 MB on the check's table, which a worker holds whole beside its own arrays.
    """
    if BATCHES not in spark.conf.getAll:
        spark.conf.set(BATCHES, BATCH_BYTES)


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 4: documents without a determined language, or with a weak one, go; without any labelled row nothing is judged.

    Null and empty texts have no language and go; repeated rows are judged alike; other columns keep any name.
    """
    small_batches(spark)
    model = crf_language.learn(docs)
    if not model.langs:
        return docs
    plain, back = own_names(docs, CORE)
    labelled = crf_language.predict_languages(plain, model)
    return labelled.filter((F.col("lang_pred") != crf_language.UNDETERMINED) & (F.col("score") >= crf_language.MIN_SCORE)).select(*back)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 1: of each class the first row by doc_id stays; repeated rows of one doc_id and text are one.

    Rows with a null doc_id take no part and stay; texts of one doc_id that are not alike stay too.
    """
    small_batches(spark)
    keys = ["_doc", *(f"_{t}" for t in dart_minhash.TEXT_KEY)]
    classes = stored(dart_minhash.near_classes(docs.select("doc_id", "text")).toDF(*keys, "_class", "_least"), "classes")
    counted = classes.groupBy("_class", *keys).count()
    firsts = classes.groupBy("_class").agg(F.min(F.struct(*keys)).alias("_first"))
    judged = stored(counted.join(firsts, "_class").select(*keys, "count", (F.struct(*keys) != F.col("_first")).alias("_late")), "judged")
    plain, back = own_names(docs, CORE)
    named = plain.select("*", F.col("doc_id").cast("long").alias(keys[0]), *[c.alias(k) for c, k in zip(dart_minhash.text_keys(text_or_empty()), keys[1:])])
    gone, few = bounded_rows(judged.filter("_late").select(*keys))
    left = named.join(F.broadcast(gone) if few else gone, keys, "left_anti").select(*named.columns)
    repeated = judged.filter("not _late and count > 1").select(*keys)
    if not repeated.limit(1).count():
        return left.select(*back)
    once = left.join(repeated, keys, "left_semi").select(*named.columns).dropDuplicates(keys)
    return left.join(repeated, keys, "left_anti").select(*back).union(once.select(*back))


def secret_scan(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 8: what the spans cover is replaced in the text; n_chars follows. All documents stay.

    A null text stays as the empty one; texts are searched whole; repeated rows are treated alike; other columns keep any name.
    """
    small_batches(spark)
    plain, back = own_names(docs, CORE)
    found = credential_links.scan_secrets(plain)
    n_chars = F.when(F.col("spans") != "", F.length("safe_text").cast("long")).otherwise(F.col("n_chars"))
    return found.withColumn("n_chars", n_chars).withColumn("text", F.col("safe_text")).select(*back)


def source_mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 7: documents are repeated to their sources' target weights and shuffled.

    A null source is a source of its own, null texts weigh nothing, rows of one doc_id draw alike; other columns keep any name.
    """
    small_batches(spark)
    plain, back = own_names(docs, CORE)
    return poisson_mix.mix_sources(plain).select(*back)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 3: pieces of sequences of 2048 tokens; null texts are their end id alone, other columns are not read."""
    small_batches(spark)
    return packing.packing_rows(docs)


STAGES = [("language_id", language_id), ("near_dedup", near_dedup), ("secret_scan", secret_scan), ("source_mix", source_mix), ("packing", pack)]
#: The first stage is a fitted model; tests hold the stages against plain versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
