"""Row identity and the hash every sample, split and tie-break is derived from.

A DataFrame has no row position, so each row carries a key and all "random"
choices are pure functions of (key, seed). Results therefore do not depend on
partitioning, on retries or on lost executors.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F, types as T

HASH_BITS = 32


def hash32(key: Column, *salts: object) -> Column:
    """Unsigned 32-bit hash of ``key`` and the salts as BIGINT (leading md5 digits)."""
    text = F.concat_ws(":", key.cast("string"), *[F.lit(str(s)) for s in salts])
    return F.conv(F.substring(F.md5(text), 1, 8), 16, 10).cast("bigint")


def portable_key(*cols: str | Column) -> Column:
    """Key text built from columns whose text form is the same in every engine."""
    parts = [F.col(c) if isinstance(c, str) else c for c in cols]
    return F.concat_ws("|", *[F.coalesce(p.cast("string"), F.lit("")) for p in parts])


def with_row_key(
    df: DataFrame,
    unique: str | None = None,
    key: Column | None = None,
    name: str = "row_key",
    copies_per_task: int = 1_000_000,
) -> DataFrame:
    """Add a unique string key.

    With a ``unique`` column the key is its text. Otherwise equal rows are
    numbered 0, 1, ... within their group of copies. Copies are interchangeable,
    so no per-group sort is needed: rows are counted (partial aggregation makes
    a hot group cheap) and the count is expanded again. A group larger than
    ``copies_per_task`` is cut into pieces that are spread over tasks first.
    """
    if unique is not None:
        return df.withColumn(name, F.col(unique).cast("string"))
    if key is None:
        key = F.md5(F.concat(*[_text_of(f) for f in df.schema.fields]))
    cols = df.columns
    counted = df.groupBy(*cols).agg(F.count("*").alias("_copies"))

    def numbered(part: DataFrame, first: Column, last: Column) -> DataFrame:
        return part.withColumn("_copy", F.explode(F.sequence(first, last)))

    few = numbered(counted.filter(F.col("_copies") <= copies_per_task), F.lit(0).cast("bigint"), F.col("_copies") - 1)
    pieces = (
        counted.filter(F.col("_copies") > copies_per_task)
        .withColumn("_from", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("_copies") - 1, F.lit(copies_per_task).cast("bigint"))))
        .repartition(F.xxhash64(*cols), F.col("_from"))
    )
    many = numbered(pieces, F.col("_from"), F.least(F.col("_from") + copies_per_task, F.col("_copies")) - 1)
    rows = few.unionByName(many.drop("_from"))
    return rows.withColumn(name, F.concat_ws("#", key, F.col("_copy").cast("string"))).select(*cols, name)


def _text_of(field: T.StructField) -> Column:
    # the length in front keeps field ends apart, whatever the text holds; null and the empty string differ
    text = F.col(f"`{field.name}`").cast("string")
    return F.coalesce(F.concat(F.length(text).cast("string"), F.lit("="), text), F.lit("~"))


def require_unique(df: DataFrame, column: str) -> None:
    """Raise when a key column holds nulls or a value twice; equal values combine before the shuffle."""
    groups = df.groupBy(F.col(column).cast("string").alias("v")).count()
    if groups.filter("v is null or count > 1").limit(1).count():
        raise ValueError(f"column {column!r} cannot be a row key: its values are not unique or some are null")
