"""Mutual information of continuous features with a discrete label.

``knn_scores`` is the nearest-neighbour estimate in one dimension, where the k
neighbours of a value are contiguous in sorted order: two sorts per feature.
Past ``rows_per_sort`` rows per feature both sorts are cut into value ranges
that are processed independently, with neighbours carried across the edges.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window, functions as F

from ..functions import digamma_int, hash32, spread_broadcast
from .filters import long_form

NEIGHBORS = 3
TIE_NOISE = 1e-10
MAX_RANGES = 2000


def knn_scores(
    df: DataFrame, label: str, key: str, features: Sequence[str], k: int = NEIGHBORS, seed: int = 42,
    rows_per_sort: int = 1_000_000,
) -> DataFrame:
    """(pos, score): k-nearest-neighbour mutual information, clipped at 0."""
    features = list(features)
    sizes = df.agg(F.count("*").alias("n"), *[F.max(F.abs(F.col(f"`{c}`").cast("double"))).alias(f"m{i}") for i, c in enumerate(features)]).head()
    scale = F.element_at(F.array(*[F.lit(float(sizes[f"m{i}"] or 1.0)) for i in range(len(features))]), F.col("pos") + 1)
    noise = (hash32(F.concat_ws(":", F.col("key"), F.col("pos").cast("string")), seed) * F.lit(2.0) / F.lit(2.0**32) - 1.0) * F.lit(TIE_NOISE) * scale
    rows = long_form(df.withColumns({"key": F.col(key).cast("string"), "y": F.col(label)}), features, ["key", "y"])
    points = rows.select("pos", "key", "y", (F.col("value") + noise).alias("z"))
    ranges = min(MAX_RANGES, math.ceil(sizes["n"] / rows_per_sort))
    if ranges > 1:
        splits = points.groupBy("pos").agg(F.percentile_approx("z", [i / ranges for i in range(1, ranges)], 10 * MAX_RANGES).alias("s"))
        bounds = {r["pos"]: np.asarray(r["s"]) for r in splits.collect()}
        points = points.withColumn("b", _range_of(bounds)("pos", "z"))
    else:
        bounds = None
        points = points.withColumn("b", F.lit(0))
    counted = _with_radius(points, k, None if bounds is None else rows_per_sort)
    return _estimate(_with_inner_count(counted, bounds), k)


def _range_of(bounds: dict[int, np.ndarray]):
    @F.pandas_udf("int")
    def find(pos: pd.Series, value: pd.Series) -> pd.Series:
        out = np.zeros(len(pos), dtype=np.int32)
        p, v = pos.to_numpy(), value.to_numpy()
        for f in np.unique(p):
            mine = p == f
            out[mine] = np.searchsorted(bounds[int(f)], v[mine], side="left")
        return pd.Series(out)

    return find


def _interval(k: int) -> tuple[Column, Column, Column]:
    """Radius to the k'-th same-label neighbour and, where a row marks it, the left or right end of the interval.

    Works on the columns l1..lk and r1..rk, the values of the neighbours on both sides.
    """
    z = F.col("z")
    left, right = [z, *[F.col(f"l{i}") for i in range(1, k + 1)]], [z, *[F.col(f"r{i}") for i in range(1, k + 1)]]
    # i neighbours on the left, k - i on the right; a window that leaves the class is null
    spans = [(left[i], right[k - i]) for i in range(k + 1)]
    widths = [F.when(a.isNotNull() & b.isNotNull(), F.greatest(z - a, b - z)) for a, b in spans]
    d = F.least(*widths)
    lo = F.coalesce(*[F.when((w == d) & (z - a >= b - z), a) for (a, b), w in zip(spans, widths)])
    hi = F.coalesce(*[F.when((w == d) & (b - z >= z - a), b) for (a, b), w in zip(spans, widths)])
    # a class of at most k rows: its farthest row
    a, b = F.coalesce(*left[:0:-1], z), F.coalesce(*right[:0:-1], z)
    few = F.col("n_c") <= k
    return (
        F.when(few, F.greatest(z - a, b - z)).otherwise(d),
        F.when(few, F.when(z - a >= b - z, a)).otherwise(lo), F.when(few, F.when(b - z >= z - a, b)).otherwise(hi),
    )


def _with_radius(points: DataFrame, k: int, block_rows: int | None) -> DataFrame:
    """Add n_c, k' = min(k, n_c - 1) and the neighbour interval; labels with a single row are dropped."""
    sizes = spread_broadcast(points.groupBy("pos", "y").agg(F.count("*").alias("n_c")))
    if block_rows is None:
        w = Window.partitionBy("pos", "y").orderBy("z", "key")
        placed = points.join(sizes, ["pos", "y"]).withColumn("own", F.lit(True))
    else:
        # exact rank in (feature, label): rank in the value range plus the sizes of the earlier ranges
        per_range = points.groupBy("pos", "y", "b").agg(F.count("*").alias("c"))
        earlier = Window.partitionBy("pos", "y").orderBy("b").rowsBetween(Window.unboundedPreceding, -1)
        shift = per_range.select("pos", "y", "b", F.coalesce(F.sum("c").over(earlier), F.lit(0)).alias("shift"))
        ranked = (
            points.withColumn("r", F.row_number().over(Window.partitionBy("pos", "y", "b").orderBy("z", "key")))
            .join(shift, ["pos", "y", "b"]).join(sizes, ["pos", "y"])
            .withColumn("r", F.col("r") + F.col("shift") - 1)
        )
        # equal blocks of ranks; rows within k of an edge are seen by the next block too
        home = F.floor(F.col("r") / block_rows)
        seen = F.array_distinct(F.array(F.floor((F.col("r") - k) / block_rows), home, F.floor((F.col("r") + k) / block_rows)))
        placed = ranked.withColumn("home", home).withColumn("block", F.explode(seen)).withColumn("own", F.col("block") == F.col("home"))
        w = Window.partitionBy("pos", "y", "block").orderBy("r")
    sides = {f"l{i}": F.lag("z", i).over(w) for i in range(1, k + 1)} | {f"r{i}": F.lead("z", i).over(w) for i in range(1, k + 1)}
    d, lo, hi = _interval(k)
    return (
        placed.withColumns(sides).filter(F.col("own") & (F.col("n_c") > 1))
        .select("pos", "key", "n_c", F.least(F.col("n_c") - 1, F.lit(k)).alias("k_c"), "z", "b", d.alias("d"), lo.alias("lo"), hi.alias("hi"))
    )


def _with_inner_count(points: DataFrame, bounds: dict[int, np.ndarray] | None) -> DataFrame:
    """Add m: rows of the feature, any label, strictly closer than the radius (the row itself included)."""
    tie = F.col("d") == 0
    lo = F.coalesce(F.col("lo"), F.col("z") - F.col("d"))
    hi = F.coalesce(F.col("hi"), F.col("z") + F.col("d"))
    # order at equal value: 0 = probe before the data, 1 = data, 2 = probe after the data
    marks = F.array(
        F.struct(F.col("z").alias("v"), F.lit(1).alias("kind"), F.lit(0).alias("sign")),
        F.struct(lo.alias("v"), F.when(tie, 0).otherwise(2).alias("kind"), F.lit(-1).alias("sign")),
        F.struct(hi.alias("v"), F.when(tie, 2).otherwise(0).alias("kind"), F.lit(1).alias("sign")),
    )
    marked = points.select("pos", "key", "n_c", "k_c", F.explode(marks).alias("t")).select("pos", "key", "n_c", "k_c", "t.*")
    data = F.when(F.col("kind") == 1, 1).otherwise(0)
    if bounds is None:
        w = Window.partitionBy("pos").orderBy("v", "kind").rowsBetween(Window.unboundedPreceding, 0)
        counted = marked.withColumn("upto", F.sum(data).over(w))
    else:
        marked = marked.withColumn("b", _range_of(bounds)("pos", "v"))
        w = Window.partitionBy("pos", "b").orderBy("v", "kind").rowsBetween(Window.unboundedPreceding, 0)
        earlier = Window.partitionBy("pos").orderBy("b").rowsBetween(Window.unboundedPreceding, -1)
        shift = marked.groupBy("pos", "b").agg(F.sum(data).alias("c")).select(
            "pos", "b", F.coalesce(F.sum("c").over(earlier), F.lit(0)).alias("shift"))
        counted = marked.withColumn("within", F.sum(data).over(w)).join(shift, ["pos", "b"]).withColumn("upto", F.col("within") + F.col("shift"))
    return counted.groupBy("pos", "key").agg(
        F.max("n_c").alias("n_c"), F.max("k_c").alias("k_c"), F.sum(F.col("sign") * F.col("upto")).alias("m"))


def _estimate(rows: DataFrame, k: int) -> DataFrame:
    per = rows.groupBy("pos").agg(
        F.count("*").alias("n"), F.avg(digamma_int(F.col("k_c"))).alias("k_term"),
        F.avg(digamma_int(F.col("n_c"))).alias("c_term"), F.avg(digamma_int(F.greatest("m", F.lit(1)))).alias("m_term"),
    )
    score = digamma_int(F.col("n")) + F.col("k_term") - F.col("c_term") - F.col("m_term")
    return per.select("pos", F.greatest(F.lit(0.0), score).alias("score"))


def binned_scores(df: DataFrame, label: str, features: Sequence[str], bins: int = 32) -> DataFrame:
    """(pos, score): plug-in estimate on equal-width bins; one scan for the ranges, one for the counts."""
    features = list(features)
    ends = df.agg(*[a for i, c in enumerate(features) for a in (
        F.min(F.col(f"`{c}`").cast("double")).alias(f"lo{i}"), F.max(F.col(f"`{c}`").cast("double")).alias(f"hi{i}"))]).head()
    cells = []
    for i, c in enumerate(features):
        lo, hi = ends[f"lo{i}"], ends[f"hi{i}"]
        cell = F.lit(0) if lo is None or lo == hi else F.least(
            F.floor((F.col(f"`{c}`").cast("double") - F.lit(lo)) / F.lit(hi - lo) * F.lit(float(bins))), F.lit(bins - 1))
        cells.append(F.struct(F.lit(i).alias("pos"), cell.cast("int").alias("bin")))
    joint = (
        df.select(F.col(label).alias("y"), F.explode(F.array(*cells)).alias("t"))
        .groupBy("t.pos", "t.bin", "y").agg(F.count("*").cast("double").alias("n"))
    )
    # from here on features x bins x classes rows
    total = F.sum("n").over(Window.partitionBy("pos"))
    by_bin, by_class = F.sum("n").over(Window.partitionBy("pos", "bin")), F.sum("n").over(Window.partitionBy("pos", "y"))
    parts = joint.withColumn("_t", total).withColumn("_term", F.col("n") / total * F.log(F.col("n") * total / (by_bin * by_class)))
    return parts.groupBy("pos").agg(F.greatest(F.lit(0.0), F.sum("_term")).alias("score"))
