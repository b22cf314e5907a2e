"""Operator 7: mixing sources to target weights by Poisson replication.

Every document of a source is repeated a Poisson number of times whose mean is the source's repetition rate: target
weight times all characters, over the source's characters. The number is the inverse of the Poisson distribution at a
uniform draw hashed from (seed, doc_id), so a retry, another layout or another engine repeats the same documents.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from featsieve.functions import bounded_rows

from .common import CORE, own_names

SEED = 42
EXPONENT = 0.5
MAX_BROADCAST_SOURCES = 50_000
PART_RATE = 30.0
#: Fixed: digits of the md5 that make a draw, and its range.
DRAW_DIGITS, DRAW_RANGE = 13, 16.0**13


def draw(seed: int, *parts: Column) -> Column:
    """Uniform number in [0, 1) from the leading md5 digits of the seed and the parts."""
    text = F.concat_ws(":", F.lit(str(seed)), *[F.coalesce(p.cast("string"), F.lit("~")) for p in parts])
    return F.conv(F.substring(F.md5(text), 1, DRAW_DIGITS), 16, 10).cast("long").cast("double") / F.lit(DRAW_RANGE)


def _inverse(rate: Column, uniform: Column) -> Column:
    """Least k with P(Poisson(rate) <= k) above the draw, for rates whose exp(-rate) is a normal number."""
    top = F.ceil(rate + 12 * F.sqrt(rate) + 30).cast("int")  # the tail beyond is below any draw's resolution
    start = F.struct(F.exp(-rate).alias("p"), F.exp(-rate).alias("cdf"), F.lit(0).alias("k"))

    def step(state: Column, i: Column) -> Column:
        p = state["p"] * rate / i
        return F.struct(p.alias("p"), (state["cdf"] + p).alias("cdf"), (state["k"] + F.when(state["cdf"] <= uniform, 1).otherwise(0)).alias("k"))

    return F.aggregate(F.sequence(F.lit(1), top), start, step, lambda s: s["k"])


def poisson_count(rate: Column, seed: int, key: Column) -> Column:
    """Poisson number of a key: the sum of independent inverses for equal parts of the rate, each at most PART_RATE.

    A null, zero or negative rate gives 0.
    """
    parts = F.greatest(F.lit(1), F.ceil(rate / PART_RATE).cast("int"))
    counted = F.aggregate(F.sequence(F.lit(1), parts), F.lit(0), lambda n, j: n + _inverse(rate / parts, draw(seed, key, j)))
    return F.when(rate > 0, counted).otherwise(F.lit(0))


def source_rates(docs: DataFrame, targets: dict[str, float] | None = None, exponent: float = EXPONENT) -> DataFrame:
    """(source, rate) for every source, null included, over all documents.

    ``targets`` names weights by source (others get none); without it the weight is the source's character share to
    the power ``exponent``, rescaled. A source without characters gets its rate from its documents being all empty: 1.
    """
    sizes = docs.groupBy(F.col("source").cast("string").alias("source")).agg(F.sum(F.coalesce(F.length("text"), F.lit(0))).cast("double").alias("chars"))
    if targets is not None:
        pairs = F.create_map(*[F.lit(x) for item in targets.items() for x in item]) if targets else F.lit(None).cast("map<string,double>")
        sizes = sizes.withColumn("weight", F.coalesce(F.try_element_at(pairs, "source"), F.lit(0.0)))
    else:
        sizes = sizes.withColumn("weight", F.pow("chars", F.lit(exponent)))
    all_chars, all_weight = sizes.agg(F.sum("chars"), F.sum("weight")).first()
    scale = F.lit(all_chars or 0.0) / F.lit(all_weight or 1.0)
    return sizes.select("source", F.when(F.col("chars") > 0, F.col("weight") * scale / F.col("chars")).otherwise(F.lit(1.0)).alias("rate"))


def mix_sources(docs: DataFrame, targets: dict[str, float] | None = None, exponent: float = EXPONENT, seed: int = SEED) -> DataFrame:
    """Documents repeated to their sources' weights and shuffled over all partitions.

    Adds rate, copy_no (from 1) and shuffle_key (md5); columns of these names in the input are replaced, all others stay.
    A null source is a source of its own, a null text has no characters, a null doc_id draws as one id; repeated rows
    draw alike, as their ids do; other columns may have any name; an empty table gives no rows.
    """
    added = ("rate", "copy_no", "shuffle_key")
    rates, small = bounded_rows(source_rates(docs, targets, exponent), MAX_BROADCAST_SOURCES)
    docs, back = own_names(docs.select(*[F.col(f"`{c}`") for c in docs.columns if c not in added]), CORE)
    kept = docs.columns
    if small:
        joined = docs.select(*kept, F.col("source").cast("string").alias("_source")).join(
            F.broadcast(rates.withColumnRenamed("source", "_of")), F.col("_source").eqNullSafe(F.col("_of")), "left").drop("_of", "_source")
    else:  # salted, as one source may hold much of the rows
        salts = 64
        left = docs.select(*kept, F.col("source").cast("string").alias("_source"), F.pmod(F.xxhash64("doc_id"), F.lit(salts)).alias("_salt"))
        right = rates.withColumnRenamed("source", "_of").withColumn("_at", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(salts - 1).cast("long"))))
        joined = left.join(right, F.col("_source").eqNullSafe(F.col("_of")) & (F.col("_salt") == F.col("_at")), "left").drop("_of", "_source", "_salt", "_at")
    counted = joined.withColumn("_copies", poisson_count(F.col("rate"), seed, F.col("doc_id"))).filter("_copies > 0")
    copies = counted.withColumn("copy_no", F.explode(F.sequence(F.lit(1), F.col("_copies")))).drop("_copies")
    key = F.md5(F.concat_ws(":", F.lit(f"shuffle{seed}"), F.coalesce(F.col("doc_id").cast("string"), F.lit("~")), F.col("copy_no").cast("string")))
    return copies.withColumn("shuffle_key", key).repartition("shuffle_key").sortWithinPartitions("shuffle_key").select(*back, *added)


def op7_poisson_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix_sources(spark.read.parquet(f"{sf_dir}/documents.parquet")).withColumn("rate", F.round("rate", 9))


def twin(table: str, columns: str) -> str:
    """DuckDB SQL of ``mix_sources`` with its default parameters over ``table``."""
    return f"""
WITH RECURSIVE sizes AS (SELECT source, sum(coalesce(length(text), 0))::DOUBLE AS chars FROM {table} GROUP BY source),
whole AS (SELECT sum(chars) AS all_chars, sum(pow(chars, {EXPONENT})) AS all_weight FROM sizes),
rates AS (SELECT source, CASE WHEN chars > 0 THEN pow(chars, {EXPONENT}) * (all_chars / all_weight) / chars ELSE 1.0 END AS rate FROM sizes, whole),
parted AS (SELECT source, rate, greatest(1, ceil(rate / {PART_RATE}))::INTEGER AS parts, rate / greatest(1, ceil(rate / {PART_RATE})) AS r FROM rates),
terms AS (SELECT source, rate, parts, r, 0 AS k, exp(-r) AS p, exp(-r) AS cdf FROM parted
          UNION ALL SELECT source, rate, parts, r, k + 1, p * r / (k + 1), cdf + p * r / (k + 1) FROM terms WHERE k < ceil(r + 12 * sqrt(r) + 30)),
keyed AS (SELECT d.*, r.rate, unnest(range(1, r.parts + 1)) AS j FROM {table} d JOIN parted r ON r.source IS NOT DISTINCT FROM d.source),
drawn AS (SELECT *, (('0x' || substr(md5('{SEED}:' || coalesce(doc_id::VARCHAR, '~') || ':' || j::VARCHAR), 1, {DRAW_DIGITS}))::BIGINT)::DOUBLE / {DRAW_RANGE:.1f} AS u FROM keyed),
counted AS (SELECT d.doc_id, d.text, d.lang, d.source, d.n_chars, d.rate, count(*) AS copies
            FROM drawn d JOIN terms t ON t.source IS NOT DISTINCT FROM d.source AND t.cdf <= d.u GROUP BY ALL)
SELECT {columns} FROM (SELECT *, unnest(range(1, copies + 1))::INTEGER AS copy_no FROM counted)"""


TWIN = twin("documents", f"doc_id, text, lang, source, n_chars, round(rate, 9) AS rate, copy_no, md5('shuffle{SEED}:' || coalesce(doc_id::VARCHAR, '~') || ':' || copy_no::VARCHAR) AS shuffle_key")
