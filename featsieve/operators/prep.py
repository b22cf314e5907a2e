"""Train-fitted preprocessing: roles, imputation, population scaling, ordinal and label encoding.

The fitted state is one number or text per column, which is applied as
literals, plus the category dictionaries, which stay tables and are joined.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window, functions as F, types as T

from ..functions import bounded_rows, cut_lineage, finite, local_table, stripped
from .quantiles import exact_quantiles
from .target import null_tokens

MAX_PLAIN_DICTIONARY = 200_000
HEAD_VALUES = 10_000


def drop_roles(df: DataFrame, target: str, *roles: Sequence[str]) -> DataFrame:
    """Drop identifier, leakage and other configured columns; unknown names are ignored."""
    names = [c for role in roles for c in role]
    if target in names:
        raise ValueError(f"target column {target!r} cannot also be dropped")
    return df.drop(*dict.fromkeys(names))


def project_features(df: DataFrame, target: str, features: Sequence[str]) -> DataFrame:
    missing = [f for f in features if f not in df.columns]
    if missing:
        raise ValueError(f"selected features not found: {missing[:20]}")
    return df.select(*features, target)


@dataclass(frozen=True)
class Recipe:
    """Dataset-specific clean-up: nulls to constants, value replacements, label text repairs."""

    drop: tuple[str, ...] = ()
    fill: tuple[tuple[str, object], ...] = ()
    replace: tuple[tuple[str, str, str], ...] = ()
    label_null: str | None = None
    label_replace: tuple[tuple[str, str], ...] = ()


# fixed values: the two recipes of the legacy dataset, by target column
_ENDPOINTS = ("srcip", "sport", "dstip", "dsport")
_FILL = (("ct_flw_http_mthd", 0), ("is_ftp_login", 0))
_REPLACE = (("service", "-", "service_unknown"),)
LEGACY_RECIPES = {
    "label": Recipe(("attack_cat", *_ENDPOINTS), _FILL, _REPLACE),
    "attack_cat": Recipe(("label", *_ENDPOINTS), _FILL, _REPLACE, "normal", (("backdoors", "backdoor"),)),
}


def apply_recipe(df: DataFrame, target: str, recipe: Recipe) -> DataFrame:
    df = df.drop(*recipe.drop)
    for name, value in recipe.fill:
        if name in df.columns:
            df = df.withColumn(name, F.coalesce(F.col(name), F.lit(value)))
    for name, old, new in recipe.replace:
        if name in df.columns:
            df = df.replace({old: new}, subset=[name])
    if recipe.label_null is not None:
        text = F.lower(stripped(F.coalesce(F.col(target).cast("string"), F.lit(recipe.label_null))))
        for old, new in recipe.label_replace:
            text = F.replace(text, F.lit(old), F.lit(new))
        df = df.withColumn(target, text)
    return df


def split_types(df: DataFrame, target: str, numeric_columns: Sequence[str] = ()) -> tuple[list[str], list[str]]:
    """(numeric, categorical) feature names, each in column order.

    ``numeric_columns`` are text columns to be read as numbers.
    """
    numeric, categorical = [], []
    for f in df.schema.fields:
        if f.name == target:
            continue
        if isinstance(f.dataType, (T.ArrayType, T.MapType, T.StructType, T.BinaryType)):
            raise ValueError(f"column {f.name!r} has type {f.dataType.simpleString()}; features must be primitive")
        (numeric if isinstance(f.dataType, T.NumericType) or f.name in numeric_columns else categorical).append(f.name)
    return numeric, categorical


def finite_values(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Infinities and NaN become null."""
    return df.withColumns({c: _number(df, c) for c in columns})


def _number(df: DataFrame, name: str) -> Column:
    c = F.col(f"`{name}`")
    return finite(c.try_cast("double") if isinstance(df.schema[name].dataType, T.StringType) else c)


def category_counts(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """(feature, value, n) over all categorical columns in one scan; equal values combine before the shuffle."""
    pairs = F.array(*[F.struct(F.lit(c).alias("feature"), F.col(f"`{c}`").cast("string").alias("value")) for c in columns])
    return df.select(F.explode(pairs).alias("p")).groupBy("p.feature", "p.value").agg(F.count("*").alias("n"))


def modes(counts: DataFrame) -> DataFrame:
    """Most frequent non-null value per feature, ties to the smallest text."""
    best = F.min(F.struct((-F.col("n")).alias("neg"), F.col("value").alias("value")))
    return counts.filter(F.col("value").isNotNull()).groupBy("feature").agg(best.alias("best")).select("feature", F.col("best.value").alias("fill"))


def category_codes(values: DataFrame, max_plain_rows: int = MAX_PLAIN_DICTIONARY) -> DataFrame:
    """Codes 0..m-1 in sorted order per feature for distinct (feature, value) rows.

    A dictionary beyond ``max_plain_rows`` is range-partitioned, numbered inside
    each partition and shifted by the sizes of the earlier ones. The partition
    numbers are written to a checkpoint, as range bounds are sampled.
    """
    if values.limit(max_plain_rows + 1).count() <= max_plain_rows:
        code = F.row_number().over(Window.partitionBy("feature").orderBy("value")) - 1
        return values.select("feature", "value", code.cast("int").alias("code"))
    parts = values.select("feature", "value").repartitionByRange("feature", "value").withColumn("_part", F.spark_partition_id())
    parts = cut_lineage(parts)
    sizes = parts.groupBy("feature", "_part").agg(F.count("*").alias("_size"))
    earlier = Window.partitionBy("feature").orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    shift = sizes.select("feature", "_part", F.coalesce(F.sum("_size").over(earlier), F.lit(0)).alias("_shift"))
    within = F.row_number().over(Window.partitionBy("feature", "_part").orderBy("value")) - 1
    return (
        parts.withColumn("_within", within).join(F.broadcast(shift), ["feature", "_part"])  # at most partitions x features rows
        .select("feature", "value", (F.col("_within") + F.col("_shift")).cast("int").alias("code"))
    )


def encode_column(df: DataFrame, name: str, dictionary: DataFrame, out: str, unseen: int = -1, head_values: int = HEAD_VALUES) -> DataFrame:
    """Replace the text of ``name`` by its code from (value, n, code), ``unseen`` when absent.

    A small dictionary is broadcast. Of a larger one the most frequent values
    are broadcast, together with the values, known or not, that are most frequent
    in ``df`` itself. Only rows of other values are joined by shuffle, and each of
    those values is rare, so no hot value meets one task.
    """
    table = dictionary.select(F.col("value").alias("_value"), F.col("code").alias("_code"))
    small, proven = bounded_rows(table, head_values)
    text = F.col(f"`{name}`").cast("string")
    if proven:
        joined = df.withColumn("_value", text).join(F.broadcast(small), "_value", "left").drop("_value")
        return joined.withColumn(out, F.coalesce("_code", F.lit(unseen))).drop("_code")
    head = dictionary.orderBy(F.desc("n"), "value").limit(head_values).select(F.col("value").alias("_value"), F.col("code").alias("_code"))
    # what is frequent in the table at hand need not be frequent, or known, in the dictionary
    rest = df.select(text.alias("_value")).filter("_value is not null").join(F.broadcast(head), "_value", "left_anti").groupBy("_value").agg(F.count("*").alias("_n"))
    heavy = rest.orderBy(F.desc("_n"), "_value").limit(head_values).join(table, "_value", "left").select("_value", F.coalesce("_code", F.lit(unseen)).alias("_code"))
    coded = df.withColumn("_value", text).join(F.broadcast(head.union(heavy)), "_value", "left")  # at most twice head_values rows
    open_ = F.col("_code").isNull() & F.col("_value").isNotNull()
    rare = coded.filter(open_).drop("_code").join(table, "_value", "left")
    known = coded.filter(~open_).unionByName(rare)
    return known.withColumn(out, F.coalesce("_code", F.lit(unseen))).drop("_value", "_code")


@dataclass
class PrepModel:
    """Fitted state. ``numeric``: name -> (fill, mean, std); ``categorical``: name -> fill."""

    target: str
    numeric: dict[str, tuple[float, float, float]]
    categorical: dict[str, str]
    dictionary: DataFrame | None
    labels: DataFrame
    numeric_text: tuple[str, ...] = ()
    tokens: tuple[str, ...] = ()

    @property
    def features(self) -> list[str]:
        return [*self.numeric, *self.categorical]

    def imputed(self, df: DataFrame) -> DataFrame:
        df = null_tokens(df, self.tokens, self.target)
        filled = {c: F.coalesce(_number(df, c), F.lit(fill)) for c, (fill, _m, _s) in self.numeric.items()}
        filled |= {c: F.coalesce(F.col(f"`{c}`").cast("string"), F.lit(fill)) for c, fill in self.categorical.items()}
        return df.withColumns(filled)

    def transform(self, df: DataFrame, keep: Sequence[str] = (), label_out: str = "label") -> DataFrame:
        """Keep columns + one float column per feature + the encoded label; unseen categories are -1, unseen labels raise."""
        df = self.imputed(df)
        for i, c in enumerate(self.categorical):
            df = encode_column(df, c, self.dictionary.filter(F.col("feature") == c), f"_code{i}")
        target = F.col(f"`{self.target}`").cast("string")
        df = df.withColumn("_label", target).join(F.broadcast(self.labels.select(F.col("value").alias("_label"), F.col("code").alias("_y"))), "_label", "left")
        y = F.when(F.col("_y").isNull(), F.raise_error(F.concat(F.lit("label not seen in training: "), F.col("_label")))).otherwise(F.col("_y"))
        scaled = [((F.col(f"`{c}`") - F.lit(m)) / F.lit(s)).cast("float").alias(c) for c, (_f, m, s) in self.numeric.items()]
        codes = [F.col(f"_code{i}").cast("float").alias(c) for i, c in enumerate(self.categorical)]
        return df.select(*keep, *scaled, *codes, y.cast("int").alias(label_out))

    def artifacts(self) -> DataFrame:
        """(pos, feature, kind, fill, mean, std) per feature."""
        spark = self.labels.sparkSession
        rows = [(i, c, "numeric", str(f), m, s) for i, (c, (f, m, s)) in enumerate(self.numeric.items())]
        rows += [(len(rows) + i, c, "categorical", f, None, None) for i, (c, f) in enumerate(self.categorical.items())]
        return local_table(spark, rows, "pos int, feature string, kind string, fill string, mean double, std double")


def encode_labels(df: DataFrame, target: str) -> DataFrame:
    """(value, code) of the label texts in sorted order; a missing label is no class."""
    values = df.select(F.lit(target).alias("feature"), F.col(f"`{target}`").cast("string").alias("value")).filter("value is not null").distinct()
    return category_codes(values).select("value", "code")


def population_scale(df: DataFrame, medians: dict[str, float]) -> dict[str, tuple[float, float]]:
    """(mean, population std) of each column after median filling, one aggregate; zero spread scales by 1."""
    if not medians:
        return {}
    aggs = []
    for i, (c, fill) in enumerate(medians.items()):
        v = F.coalesce(_number(df, c), F.lit(fill))
        aggs += [F.avg(v).alias(f"m{i}"), F.stddev_pop(v).alias(f"s{i}")]
    row = df.agg(*aggs).head()
    return {c: (row[f"m{i}"], row[f"s{i}"] or 1.0) for i, c in enumerate(medians)}


def fit(
    df: DataFrame, target: str, keep: Sequence[str] = (), numeric_columns: Sequence[str] = (), tokens: Sequence[str] = ()
) -> PrepModel:
    """Fit on the training rows. ``keep`` names key columns that are not features."""
    df = null_tokens(df.drop(*[c for c in keep if c != target]), tokens, target)
    numeric, categorical = split_types(df, target, numeric_columns)
    medians = exact_quantiles(finite_values(df, numeric), numeric)
    empty = [c for c in numeric if medians[(c, 0.5)] is None]
    fills: dict[str, str] = {}
    dictionary = None
    if categorical:
        counts = category_counts(df, categorical).persist()
        fills = {r["feature"]: r["fill"] for r in modes(counts).collect()}
        empty += [c for c in categorical if c not in fills]
        values = counts.filter(F.col("value").isNotNull())
        dictionary = category_codes(values).join(values, ["feature", "value"])
    if empty:
        raise ValueError(f"columns without any value cannot be imputed: {empty}")
    fill = {c: medians[(c, 0.5)] for c in numeric}
    scale = population_scale(df, fill)
    labels, proven = bounded_rows(encode_labels(df, target))
    if not proven:
        raise ValueError(f"target {target!r} has too many classes")
    return PrepModel(
        target, {c: (fill[c], *scale[c]) for c in numeric}, {c: fills[c] for c in categorical},
        dictionary, labels, tuple(numeric_columns), tuple(tokens),
    )
