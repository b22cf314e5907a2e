"""Exact column quantiles without sorting a whole column in one task.

A mergeable sketch brackets each quantile, then only the values inside the
bracket are counted by value and ranked. Brackets that still hold too many
rows are narrowed again. Only per-column numbers reach the driver.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import DataFrame, Window, functions as F

from ..functions import finite

SKETCH_ACCURACY = 10_000


def exact_quantiles(
    df: DataFrame,
    columns: Sequence[str],
    probs: Sequence[float] = (0.5,),
    max_ranked_rows: int = 5_000_000,
) -> dict[tuple[str, float], float | None]:
    """Linearly interpolated quantiles of the finite values, {(column, prob): value}."""
    columns, probs = list(columns), list(probs)
    if not columns:
        return {}
    data = df.select(*[finite(F.col(f"`{c}`")).alias(f"v{i}") for i, c in enumerate(columns)])
    slack = 4.0 / SKETCH_ACCURACY
    wanted = sorted({b for p in probs for b in (max(0.0, p - slack), min(1.0, p + slack))} | {0.0, 1.0})
    aggs = []
    for i in range(len(columns)):
        aggs += [
            F.count(f"v{i}").alias(f"n{i}"),
            F.percentile_approx(f"v{i}", wanted, SKETCH_ACCURACY).alias(f"s{i}"),
        ]
    first = data.agg(*aggs).head()
    out: dict[tuple[str, float], float | None] = {}
    targets = []  # [column index, prob, n, low, high, low end, high end]
    for i, c in enumerate(columns):
        n = first[f"n{i}"]
        if n == 0:
            out.update({(c, p): None for p in probs})
            continue
        at = dict(zip(wanted, first[f"s{i}"]))
        for p in probs:
            targets.append([i, p, n, at[max(0.0, p - slack)], at[min(1.0, p + slack)], at[0.0], at[1.0]])
    if not targets:
        return out
    if any(2 * slack * t[2] > max_ranked_rows for t in targets):
        _narrow(data, targets, max_ranked_rows)
    values = _ranked_values(data, targets)
    missed = [k for k, v in values.items() if v is None]
    if missed:  # the sketch bracket was off: rank over the full range of those columns
        again = [targets[k][:3] + [targets[k][5], targets[k][6], targets[k][5], targets[k][6]] for k in missed]
        for k, v in _ranked_values(data, again).items():
            values[missed[k]] = v
    for k, t in enumerate(targets):
        out[(columns[t[0]], t[1])] = values[k]
    return out


def _narrow(data: DataFrame, targets: list[list], max_ranked_rows: int) -> None:
    """Shrink brackets that hold too many rows, all targets in one job per round."""
    for _ in range(4):
        aggs = []
        for k, (i, _p, _n, lo, hi, *_ends) in enumerate(targets):
            v = F.col(f"v{i}")
            inside = F.when((v >= lo) & (v <= hi), v)
            aggs += [F.count_if(v < lo).alias(f"b{k}"), F.count(inside).alias(f"i{k}")]
        seen = data.agg(*aggs).head()
        wide = []
        for k, (i, p, n, lo, hi, *_ends) in enumerate(targets):
            if lo < hi and seen[f"i{k}"] > max_ranked_rows:
                mid = (p * (n - 1) - seen[f"b{k}"]) / max(1, seen[f"i{k}"])
                near = 4.0 / SKETCH_ACCURACY
                wide.append((k, [min(1.0, max(0.0, mid - near)), min(1.0, max(0.0, mid + near))]))
        if not wide:
            return
        cut = data.agg(*[
            F.percentile_approx(
                F.when(F.col(f"v{targets[k][0]}").between(targets[k][3], targets[k][4]), F.col(f"v{targets[k][0]}")),
                ps, SKETCH_ACCURACY,
            ).alias(f"q{k}")
            for k, ps in wide
        ]).head()
        before = [(t[3], t[4]) for t in targets]
        for k, _ps in wide:
            targets[k][3], targets[k][4] = cut[f"q{k}"]
        if before == [(t[3], t[4]) for t in targets]:
            return


def _ranked_values(data: DataFrame, targets: list[list]) -> dict[int, float | None]:
    """Interpolated order statistics from the counted values of each bracket."""
    # values below the bracket share the null group, so they are counted, not kept
    tagged = F.array(*[
        F.when(
            F.col(f"v{i}") <= F.lit(hi),
            F.struct(F.lit(k).alias("k"), F.when(F.col(f"v{i}") >= F.lit(lo), F.col(f"v{i}")).alias("v")),
        )
        for k, (i, _p, _n, lo, hi, *_ends) in enumerate(targets)
    ])
    counted = (
        data.select(F.explode(tagged).alias("t")).filter(F.col("t").isNotNull())
        .groupBy(F.col("t.k").alias("k"), F.col("t.v").alias("v")).agg(F.count("*").alias("c"))
    )
    w = Window.partitionBy("k").orderBy(F.col("v").asc_nulls_first()).rowsBetween(Window.unboundedPreceding, 0)
    ranked = counted.withColumn("upto", F.sum("c").over(w)).withColumn("before", F.col("upto") - F.col("c"))
    hit = F.lit(False)
    for k, (_i, p, n, *_r) in enumerate(targets):
        pos = p * (n - 1)
        for r in {math.floor(pos), math.ceil(pos)}:
            hit = hit | ((F.col("k") == k) & (F.col("before") <= r) & (F.col("upto") > r))
    rows = ranked.filter(hit & F.col("v").isNotNull()).collect()
    out: dict[int, float | None] = {}
    for k, (_i, p, n, *_r) in enumerate(targets):
        pos = p * (n - 1)

        def at(rank: int) -> float | None:
            return next((r["v"] for r in rows if r["k"] == k and r["before"] <= rank < r["upto"]), None)

        low, high = at(math.floor(pos)), at(math.ceil(pos))
        out[k] = None if low is None or high is None else low + (high - low) * (pos - math.floor(pos))
    return out
