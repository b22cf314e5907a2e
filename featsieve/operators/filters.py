"""Filter rankers that share one pass of per-class statistics: correlation, chi-square, Fisher ratio."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

from ..functions import safe_div

WIDE_LIMIT = 16


def long_form(df: DataFrame, features: Sequence[str], keep: Sequence[str]) -> DataFrame:
    """(keep..., pos, value): one row per row and feature."""
    pairs = F.array(*[F.struct(F.lit(i).alias("pos"), F.col(f"`{c}`").cast("double").alias("value")) for i, c in enumerate(features)])
    return df.select(*keep, F.explode(pairs).alias("_p")).select(*keep, "_p.pos", "_p.value")


def class_stats(df: DataFrame, label: str, features: Sequence[str]) -> DataFrame:
    """(pos, y, n, mean, var, min, max) per feature and class in a single scan.

    A few columns are aggregated side by side; many are unpivoted first, so that
    the aggregate keeps one small set of buffers and stays compiled.
    """
    y = F.col(label).cast("double").alias("y")
    if len(features) > WIDE_LIMIT:
        rows = long_form(df.select(y, *[F.col(f"`{c}`") for c in features]), features, ["y"])
        return rows.groupBy("pos", "y").agg(*_five(F.col("value")))
    aggs = [a.alias(f"{name}{i}") for i, c in enumerate(features) for name, a in zip(_NAMES, _five(F.col(f"`{c}`").cast("double")))]
    wide = df.groupBy(y).agg(*aggs)
    rows = F.array(*[F.struct(F.lit(i).alias("pos"), *[F.col(f"{n}{i}").alias(n) for n in _NAMES]) for i in range(len(features))])
    return wide.select("y", F.explode(rows).alias("s")).select("s.pos", "y", *[f"s.{n}" for n in _NAMES])


_NAMES = ("n", "mean", "var", "min", "max")


def _five(v: Column) -> list[Column]:
    aggs = [F.count(v), F.avg(v), F.var_pop(v), F.min(v), F.max(v)]
    return [a.alias(n) for n, a in zip(_NAMES, aggs)]


def _totals(stats: DataFrame) -> DataFrame:
    """Add the feature's overall count, mean, minimum, maximum and label mean (features x classes rows)."""
    f = Window.partitionBy("pos")
    return (
        stats.withColumn("total", F.sum("n").over(f))
        .withColumn("mu", safe_div(F.sum(F.col("n") * F.col("mean")).over(f), F.col("total")))
        .withColumn("ybar", safe_div(F.sum(F.col("n") * F.col("y")).over(f), F.col("total")))
        .withColumn("lo", F.min("min").over(f)).withColumn("hi", F.max("max").over(f))
    )


def pearson_scores(stats: DataFrame) -> DataFrame:
    """Absolute correlation with the label code; 0 when either side is constant."""
    d, e = F.col("mean") - F.col("mu"), F.col("y") - F.col("ybar")
    s = _totals(stats).groupBy("pos").agg(
        F.sum(F.col("n") * d * e).alias("cov"),
        F.sum(F.col("n") * (F.col("var") + d * d)).alias("vx"),
        F.sum(F.col("n") * e * e).alias("vy"),
        F.max(F.col("lo") == F.col("hi")).alias("flat"),
    )
    corr = F.abs(safe_div(F.col("cov"), F.sqrt(F.col("vx")) * F.sqrt(F.col("vy"))))
    return s.select("pos", F.when(F.col("flat"), 0.0).otherwise(corr).alias("score"))


def chi2_scores(stats: DataFrame) -> DataFrame:
    """Chi-square of per-class sums of min-max scaled values; 0 for a constant column."""
    scaled = safe_div(F.col("n") * (F.col("mean") - F.col("lo")), F.col("hi") - F.col("lo"))
    seen = _totals(stats).withColumn("obs", scaled)
    expected = F.sum("obs").over(Window.partitionBy("pos")) * safe_div(F.col("n"), F.col("total"))
    parts = seen.withColumn("exp", expected)
    gap = F.col("obs") - F.col("exp")
    return parts.groupBy("pos").agg(F.sum(safe_div(gap * gap, F.col("exp"))).alias("score"))


def fisher_scores(stats: DataFrame) -> DataFrame:
    """Between-class over within-class scatter, population variance."""
    d = F.col("mean") - F.col("mu")
    return _totals(stats).groupBy("pos").agg(
        (F.sum(F.col("n") * d * d) / (F.sum(F.col("n") * F.col("var")) + F.lit(1e-12))).alias("score")
    )


STATS_SCORES = {"pearson": pearson_scores, "chi2": chi2_scores, "fisher": fisher_scores}
