"""Pareto fronts, zones and champions per (dataset, classifier, scenario)."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame, Window, functions as F

KEYS = ("dataset", "classifier", "scenario")
SLICES, LEVELS = 1024, 2

Zones = Mapping[str, Mapping[str, float]]


def _above_bar(rows: DataFrame, by: list[str], cell: str, eff: str, efs: str) -> DataFrame:
    """Rows in SLICES equal slices (``cell``) of the range of ``eff`` within ``by``, without those a higher slice beats."""
    span = rows.groupBy(*by).agg(F.min(eff).alias("_low"), F.max(eff).alias("_high"))
    # null-safe: a null key is a group of its own
    same = lambda keys, tag: [F.col(k).eqNullSafe(F.col(f"{tag}{k}")) for k in keys]
    tagged = lambda df, keys, tag: df.withColumnsRenamed({k: f"{tag}{k}" for k in keys})
    share = (F.col(eff) - F.col("_low")) / F.nullif(F.col("_high") - F.col("_low"), F.lit(0.0))
    part = F.least(F.lit(SLICES - 1), F.greatest(F.lit(0), F.floor(share * SLICES).cast("int")))
    rows = rows.join(tagged(span, by, "_s_"), same(by, "_s_")).withColumn(cell, part).select(*rows.columns, cell)
    tops = rows.groupBy(*by, cell).agg(F.max(efs).alias("_top"))  # at most SLICES rows per group
    above = Window.partitionBy(*by).orderBy(F.desc(cell)).rowsBetween(Window.unboundedPreceding, -1)
    bars = tops.withColumn("_bar", F.max("_top").over(above)).select(*by, cell, "_bar")
    at = [*by, cell]
    # a higher slice is strictly better on the first score, so equal second scores lose as well
    return rows.join(tagged(bars, at, "_b_"), same(at, "_b_")).filter(F.col("_bar").isNull() | (F.col(efs) > F.col("_bar"))).select(*rows.columns)


def pareto_front(
    scored: DataFrame, keys: tuple[str, ...] = KEYS, eff: str = "effectiveness_score", efs: str = "efficiency_score", levels: int = LEVELS
) -> DataFrame:
    """Rows no other row of the group beats: at least as good on both scores and better on one.

    Scores may have any range. Each group is cut into equal slices of its own range of the first score; the best second
    score of the higher slices removes most rows right after the scan. The rows left are cut again, each slice by its own range,
    ``levels`` times in all, so a dense slice or an outlier does not leave a group in one window. The survivors are
    reduced to distinct points and compared within their slice only. Exact duplicates of a front point all stay.
    """
    keys = list(keys)
    alive, cells = scored, []
    for i in range(levels):
        alive = _above_bar(alive, [*keys, *cells], f"_cell{i}", eff, efs)
        cells.append(f"_cell{i}")
    points = alive.groupBy(*keys, *cells, F.col(eff).alias("_eff")).agg(F.max(efs).alias("_efs"))
    better = Window.partitionBy(*keys, *cells).orderBy(F.desc("_eff")).rowsBetween(Window.unboundedPreceding, -1)
    front = points.withColumn("_best", F.max("_efs").over(better)).filter("_best IS NULL OR _efs > _best")
    front = front.select(*[F.col(k).alias(f"_{k}") for k in keys], "_eff", "_efs")
    match = [F.col(k) == F.col(f"_{k}") for k in keys] + [F.col(eff) == F.col("_eff"), F.col(efs) == F.col("_efs")]
    return alive.join(front, match, "left_semi").drop(*cells)


def zone_members(
    front: DataFrame, zones: Zones, keys: tuple[str, ...] = KEYS, eff: str = "effectiveness_score", efs: str = "efficiency_score"
) -> DataFrame:
    """Front rows per zone: both scores at or above the zone's quantiles; the whole front where that is empty."""
    keys = list(keys)
    probs = {z: (float(c.get("effectiveness_quantile_min", 0.0)), float(c.get("efficiency_quantile_min", 0.0))) for z, c in zones.items()}
    cuts = front.groupBy(*keys).agg(*[
        F.round(F.percentile(c, p), 12).alias(f"_{side}{i}")
        for i, (pe, ps) in enumerate(probs.values()) for side, c, p in (("e", eff, pe), ("s", efs, ps))
    ])
    each = F.array(*[
        F.struct(F.lit(i).alias("zone_idx"), F.lit(z).alias("zone"),
                 ((F.col(eff) >= F.col(f"_e{i}")) & (F.col(efs) >= F.col(f"_s{i}"))).alias("_in"))
        for i, z in enumerate(probs)
    ])
    tagged = front.join(cuts, keys).withColumn("_z", F.explode(each)).select(*front.columns, "_z.*")
    filled = tagged.groupBy(*keys, "zone").agg(F.max("_in").alias("_any"))
    return tagged.join(filled, [*keys, "zone"]).filter(F.col("_in") | ~F.col("_any")).drop("_in", "_any").select(*front.columns, "zone_idx", "zone")


def champions(
    members: DataFrame, keys: tuple[str, ...] = KEYS, eff: str = "effectiveness_score", efs: str = "efficiency_score"
) -> DataFrame:
    """Per zone the row nearest to the zone's own utopia point; ties to the smallest feature_set_id."""
    by = [*keys, "zone"]
    utopia = members.groupBy(*by).agg(F.max(eff).alias("local_utopia_effectiveness"), F.max(efs).alias("local_utopia_efficiency"))
    de, ds = F.col("local_utopia_effectiveness") - F.col(eff), F.col("local_utopia_efficiency") - F.col(efs)
    near = members.join(utopia, by).withColumn("local_utopia_distance", F.round(F.sqrt(de * de + ds * ds), 12))
    rest = [c for c in near.columns if c not in by]
    best: Column = F.min_by(F.struct(*rest), F.struct("local_utopia_distance", "feature_set_id"))
    return near.groupBy(*by).agg(best.alias("_c")).select(*by, *[F.col(f"_c.{c}").alias(c) for c in rest])
