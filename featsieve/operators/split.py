"""Stratified holdout, folds and samples as pure functions of (row key, seed).

The rows of a class are ordered by hash and cut at exact ranks. The cut points
are found from hash-bucket counts: only the rows of the one bucket that holds a
cut are ever sorted, and the big table itself is never shuffled. It is scanned
again with the cut points (a few per class) at hand.
"""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window, functions as F

from ..functions import cut_lineage, hash32, local_table

BUCKET_BITS = 16
MAX_CLASSES = 100_000

Sizes = dict[object, list[int]]  # class -> rows in part 1, 2, ...


def _bucket(h: Column) -> Column:
    return F.shiftright(h, 32 - BUCKET_BITS)


def holdout_sizes(counts: dict[object, int], test_rows: int) -> Sizes:
    """[test, train] rows per class. The train side gets its proportional shares by largest remainder, ties to the smaller label."""
    total = sum(counts.values())
    kept = max(0, total - test_rows)
    whole = {c: n * kept // total for c, n in counts.items()}
    left = kept - sum(whole.values())
    for c in sorted(counts, key=lambda c: (-(counts[c] * kept % total), c))[:left]:
        whole[c] += 1
    return {c: [n - whole[c], whole[c]] for c, n in counts.items()}


def fold_sizes(counts: dict[object, int], k: int) -> Sizes:
    """Rows per class in folds 1..k: the label-sorted table is dealt round-robin."""
    out, start = {}, 0
    for c in sorted(counts):
        end = start + counts[c]
        # positions p < x with p mod k = f
        upto = [[(x - f + k - 1) // k for x in (start, end)] for f in range(k)]
        out[c] = [hi - lo for lo, hi in upto]
        start = end
    return out


def _with_parts(df: DataFrame, label: str, key: str, seed: int, sizes_of: Callable[[dict[object, int]], Sizes], out: str) -> DataFrame:
    """Number the rows of each class 1, 2, ... by hash order, with part sizes computed from the class counts.

    What reaches the driver: one count per class and one cut point per class and part.
    """
    spark = df.sparkSession
    rows = df.select(F.col(label).alias("_class"), F.col(key).alias("_key"), hash32(F.col(key), seed).alias("_h"))
    rows = rows.filter(F.col("_class").isNotNull()).withColumn("_b", _bucket(F.col("_h")))
    counts = rows.groupBy("_class", "_b").agg(F.count("*").alias("_n")).persist()  # classes x buckets rows
    found = counts.groupBy("_class").agg(F.sum("_n")).limit(MAX_CLASSES + 1).collect()
    if len(found) > MAX_CLASSES:
        raise ValueError(f"{label!r} has more than {MAX_CLASSES} classes")
    sizes = sizes_of({r[0]: r[1] for r in found})
    parts = max((len(v) for v in sizes.values()), default=1)
    kind = df.schema[label].dataType.simpleString()
    ranks = [(c, i + 1, sum(v[: i + 1])) for c, v in sizes.items() for i in range(len(v) - 1) if sum(v[: i + 1])]
    wanted = local_table(spark, ranks, f"_class {kind}, cut int, rank bigint")
    running = Window.partitionBy("_class").orderBy("_b").rowsBetween(Window.unboundedPreceding, 0)
    spans = counts.withColumn("_upto", F.sum("_n").over(running)).withColumn("_before", F.col("_upto") - F.col("_n"))
    at = spans.join(F.broadcast(wanted), "_class").filter("rank > _before AND rank <= _upto")
    places = at.select("_class", "_b", "cut", (F.col("rank") - F.col("_before")).cast("int").alias("_pos")).collect()
    counts.unpersist()
    where = local_table(spark, places, at.select("_class", "_b", "cut", F.lit(1).alias("_pos")).schema)
    # only the buckets that hold a cut are ranked: about rows / 2^16 each
    near = rows.join(F.broadcast(where.select("_class", "_b").distinct()), ["_class", "_b"], "left_semi")
    ranked = near.withColumn("_pos", F.row_number().over(Window.partitionBy("_class", "_b").orderBy("_h", "_key")))
    cuts: dict[object, list] = {c: [None] * (parts - 1) for c in sizes}
    for r in ranked.join(F.broadcast(where), ["_class", "_b", "_pos"]).select("_class", "cut", "_h", "_key").collect():
        cuts[r["_class"]][r["cut"] - 1] = (r["_h"], r["_key"])
    key_kind = df.schema[key].dataType.simpleString()
    table = local_table(spark, list(cuts.items()), f"_class {kind}, _cuts array<struct<_h: bigint, _key: {key_kind}>>")
    here = df.withColumn("_here", F.struct(hash32(F.col(key), seed).alias("_h"), F.col(key).alias("_key")))
    joined = here.join(F.broadcast(table), here[label] == table["_class"], "left")
    part = F.lit(1)
    for i in range(parts - 1):
        # no cut point means rank 0: every row lies behind it
        part = part + F.coalesce(F.col("_here") > F.col("_cuts")[i], F.lit(True)).cast("int")
    return joined.withColumn(out, part).select(*df.columns, out)


def stratified_holdout(
    df: DataFrame, label: str, key: str, seed: int = 42, test_size: float | int = 0.2, out: str = "split"
) -> DataFrame:
    """Add 'train'/'test' with class-proportional test rows: ceil(test_size * n) of them, or that many when an int."""

    def sizes(counts: dict[object, int]) -> Sizes:
        n = sum(counts.values())
        return holdout_sizes(counts, min(n, test_size) if isinstance(test_size, int) else math.ceil(round(n * test_size, 9)))

    parts = _with_parts(df, label, key, seed, sizes, "_part")
    return parts.withColumn(out, F.when(F.col("_part") == 1, "test").otherwise("train")).drop("_part")


def stratified_folds(df: DataFrame, label: str, key: str, k: int, seed: int = 42, out: str = "fold") -> DataFrame:
    """Add fold 1..k; fold sizes differ by at most one row within a class."""
    return _with_parts(df, label, key, seed, lambda counts: fold_sizes(counts, k), out)


def fold_membership(folded: DataFrame, key: str, k: int, fold: str = "fold") -> DataFrame:
    """Each row once per fold: validation in its own fold, train in the k - 1 others."""
    return folded.select(
        key, F.col(fold).alias("_own"), F.explode(F.sequence(F.lit(1), F.lit(k))).alias("fold"),
    ).select(key, "fold", F.when(F.col("_own") == F.col("fold"), "validation").otherwise("train").alias("split"))


def stratified_sample(df: DataFrame, label: str, key: str, max_rows: int, seed: int = 42) -> DataFrame:
    """Exactly ``max_rows`` rows with class-proportional counts; the table itself when it is not larger."""
    if not max_rows or df.limit(max_rows + 1).count() <= max_rows:
        return df
    return stratified_holdout(df, label, key, seed, int(max_rows), "_split").filter("_split = 'test'").drop("_split")


def shuffled(df: DataFrame, key: str, seed: int = 42) -> DataFrame:
    """Rows in a seeded random order (a distributed range sort by hash)."""
    return df.orderBy(hash32(F.col(key), seed), F.col(key))


def with_position(ordered: DataFrame, name: str = "position") -> DataFrame:
    """Number the rows of an ordered table from 0 in the order they stand in.

    The table is stored first, so that rows and the counts of their partitions come from one sort.
    """
    at = F.col("_at")
    rows = cut_lineage(ordered.withColumn("_at", F.monotonically_increasing_id()))  # partition number in the upper bits
    sizes = rows.groupBy(F.shiftright(at, 33).alias("_part")).agg(F.count(F.lit(1)).alias("_n"))
    # one row per partition
    before = F.coalesce(F.sum("_n").over(Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    starts = sizes.select("_part", before.alias("_before"))
    numbered = rows.withColumn("_part", F.shiftright(at, 33)).join(F.broadcast(starts), "_part")
    return numbered.withColumn(name, F.col("_before") + at.bitwiseAND(F.lit((1 << 33) - 1))).select(*ordered.columns, name)
