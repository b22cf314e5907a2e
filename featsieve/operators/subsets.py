"""Cut rankings into candidate feature subsets."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

from ..functions import safe_div

QUANTILES = {"q25": 0.25, "q50": 0.50, "q75": 0.75}
CRITERIA = (*QUANTILES, "elbow")
RANKING = ("dataset", "method", "family")


def _elbow_positions(ok: DataFrame) -> DataFrame:
    """(dataset, method, family, elbow): first rank with the largest vertical distance from the line first to last score."""
    w = Window.partitionBy(*RANKING)  # the features of one ranking
    ordered = w.orderBy("rank").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    s = F.when(F.isnan("score"), 0.0).otherwise(F.coalesce("score", F.lit(0.0)))
    y = (F.col("s") - F.min("s").over(w)) / (F.max("s").over(w) - F.min("s").over(w) + 1e-12)
    at = ok.withColumn("s", s).withColumn("y", y).withColumn("n", F.count("*").over(w)).withColumn("at", F.row_number().over(w.orderBy("rank")))
    first, last = F.first("y").over(ordered), F.last("y").over(ordered)
    line = first + (last - first) * safe_div(F.col("at") - 1, F.col("n") - 1)
    # rounded so that float noise cannot decide between equal distances
    gap = F.round(F.abs(F.col("y") - line), 9)
    return at.withColumn("gap", gap).groupBy(*RANKING).agg(F.min_by("at", F.struct(-F.col("gap"), F.col("at"))).alias("elbow"))


def _size(criterion: str, n: Column, elbow: Column, min_features: int) -> Column:
    if criterion in QUANTILES:
        k = F.ceil(n * F.lit(QUANTILES[criterion]))
    elif criterion == "elbow":
        k = F.when(n <= min_features, n).otherwise(elbow)
    else:
        raise ValueError(f"unsupported subset criterion: {criterion}")
    return F.least(n, F.greatest(F.lit(min_features), k)).cast("int")


def subset_sizes(rankings: DataFrame, criteria: Sequence[str] = CRITERIA, min_features: int = 3) -> DataFrame:
    """(dataset, method, family, criterion, num_features) for the successful rankings."""
    ok = rankings.filter("status = 'ok'")
    sizes = ok.groupBy(*RANKING).agg(F.count("*").alias("n"))
    if "elbow" in criteria:
        sizes = sizes.join(_elbow_positions(ok), list(RANKING))
    else:
        sizes = sizes.withColumn("elbow", F.lit(None).cast("int"))
    cuts = F.array(*[
        F.struct(F.lit(c).alias("criterion"), _size(c, F.col("n"), F.col("elbow"), min_features).alias("num_features")) for c in criteria
    ])
    return sizes.select(*RANKING, F.explode(cuts).alias("c")).select(*RANKING, "c.criterion", "c.num_features")


def candidate_sets(rankings: DataFrame, criteria: Sequence[str] = CRITERIA, min_features: int = 3) -> DataFrame:
    """Candidate table: the first k features of each ranking under each criterion."""
    ok = rankings.filter("status = 'ok'")
    ranked = ok.groupBy(*RANKING).agg(F.array_sort(F.collect_list(F.struct("rank", "feature"))).alias("ranked"))  # features of one ranking
    features = F.transform(F.slice("ranked", F.lit(1), F.col("num_features")), lambda r: r["feature"])
    out = subset_sizes(rankings, criteria, min_features).join(ranked, list(RANKING)).withColumn("features", features)
    set_id = F.concat_ws("__", "dataset", "method", "criterion", F.concat(F.lit("k"), F.col("num_features").cast("string")))
    return out.select(
        *RANKING, "criterion", set_id.alias("feature_set_id"), "num_features",
        F.array_join("features", ";").alias("selected_features"), "features",
    )


def with_features(candidates: DataFrame) -> DataFrame:
    """Add the array form of ``selected_features`` (empty entries dropped)."""
    parts = F.filter(F.split(F.coalesce("selected_features", F.lit("")), ";"), lambda x: x != "")
    return candidates.withColumn("features", parts)


def candidate_problems(candidates: DataFrame, known_features: DataFrame) -> DataFrame:
    """(feature_set_id, problem, feature): unknown features, repeated features, empty sets."""
    sets = with_features(candidates).select("feature_set_id", "features").distinct()
    each = sets.select("feature_set_id", F.explode("features").alias("feature"))
    unknown = each.distinct().join(known_features.select("feature"), "feature", "left_anti").select(
        "feature_set_id", F.lit("unknown").alias("problem"), "feature")
    twice = each.groupBy("feature_set_id", "feature").count().filter("count > 1").select(
        "feature_set_id", F.lit("duplicate").alias("problem"), "feature")
    empty = sets.filter(F.size("features") == 0).select("feature_set_id", F.lit("empty").alias("problem"), F.lit("").alias("feature"))
    return unknown.unionByName(twice).unionByName(empty)


def usable_candidates(candidates: DataFrame, known_features: DataFrame) -> DataFrame:
    """Raise on unknown or repeated features, skip empty sets."""
    bad = candidate_problems(candidates, known_features).filter("problem <> 'empty'").limit(20).collect()
    if bad:
        raise ValueError(f"candidates with unknown or duplicate features: {[tuple(r) for r in bad]}")
    return with_features(candidates).filter(F.size("features") > 0)
