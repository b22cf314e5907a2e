"""Preprocessing and splitting."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from featsieve.functions import cut_lineage, local_table
from featsieve.operators import prep, split, target
from featsieve.operators.quantiles import exact_quantiles

from .base import (
    DOCUMENTS, EVENTS, ORDERS, SEED, documents, events, folds_sql, holdout_sql, lineitem, load, orders, r6, rounded, share, with_,
)

TOKENS = ["7", "70", "NA"]
NUMERIC = ["value", "user_id", "hour", "k"]


def with_gaps(df: DataFrame) -> DataFrame:
    """Event values with not-a-number and infinities where k says so, k as a number with token gaps."""
    odd = F.when(F.col("k") == "1", float("nan")).when(F.col("k") == "2", float("inf")).when(F.col("k") == "3", -float("inf"))
    return target.null_tokens(df.withColumn("value", odd.otherwise(F.col("value"))), TOKENS).withColumn("k", F.col("k").try_cast("int"))


def role_projection(spark: SparkSession, d: str) -> DataFrame:
    return prep.drop_roles(load(spark, d, "orders"), "o_orderstatus", ["o_orderkey"], ["o_orderdate", "absent"], ["o_custkey", "o_orderkey"])


def feature_projection(spark: SparkSession, d: str) -> DataFrame:
    return prep.project_features(lineitem(spark, d), "l_linestatus", ["l_tax", "l_quantity"])


def finite_values(spark: SparkSession, d: str) -> DataFrame:
    return prep.finite_values(with_gaps(events(spark, d)), ["value"]).select("event_id", "value")


def type_split(spark: SparkSession, d: str) -> DataFrame:
    """Feature order: numeric block, then categorical block, with the rows that have a value."""
    df = with_gaps(events(spark, d)).drop("row_key", "event_id")
    numeric, categorical = prep.split_types(df, "event_type")
    counted = df.agg(*[F.count(F.when(~F.isnan(c), F.col(c)) if c == "value" else F.col(c)).alias(c) for c in numeric + categorical])
    rows = F.array(*[F.struct(F.lit(i).alias("pos"), F.lit(c).alias("feature"), F.lit("numeric" if c in numeric else "categorical").alias("kind"), F.col(c).alias("n"))
                     for i, c in enumerate(numeric + categorical)])
    return counted.select(F.explode(rows).alias("r")).select("r.*")


def impute_median(spark: SparkSession, d: str) -> DataFrame:
    found = exact_quantiles(with_gaps(events(spark, d)), NUMERIC)
    return local_table(spark, [(c, found[(c, 0.5)]) for c in NUMERIC], "feature string, fill double")


def scale_population(spark: SparkSession, d: str) -> DataFrame:
    df = with_gaps(events(spark, d))
    found = exact_quantiles(df, NUMERIC)
    scale = prep.population_scale(df, {c: found[(c, 0.5)] for c in NUMERIC})
    return rounded(local_table(spark, [(c, *scale[c]) for c in NUMERIC], "feature string, mean double, std double"), 5)


def impute_mode(spark: SparkSession, d: str) -> DataFrame:
    rows = target.null_tokens(events(spark, d), TOKENS).withColumn("dow", F.col("dow").cast("string"))
    return prep.modes(prep.category_counts(rows, ["k", "dow", "event_type"]))


def ordinal_encode(spark: SparkSession, d: str) -> DataFrame:
    counts = prep.category_counts(load(spark, d, "part"), ["p_name", "p_brand", "p_type"]).filter("value IS NOT NULL")
    return prep.category_codes(counts).join(counts, ["feature", "value"])


def encode_unseen(spark: SparkSession, d: str) -> DataFrame:
    """Codes learnt from the events of the first two hours of the day, applied to all events."""
    rows = events(spark, d).withColumn("pair", F.concat_ws("/", "k", F.col("user_id").cast("int").cast("string")))
    counts = prep.category_counts(rows.filter("hour < 2"), ["pair"])
    dictionary = prep.category_codes(counts).join(counts, ["feature", "value"])
    return prep.encode_column(rows, "pair", dictionary, "code").select("event_id", "code")


def label_encode(spark: SparkSession, d: str) -> DataFrame:
    return prep.encode_labels(events(spark, d), "event_type")


def apply_fitted(spark: SparkSession, d: str) -> DataFrame:
    """Fit on the train rows, transform the test rows."""
    rows = with_gaps(events(spark, d)).withColumn("dow", F.col("dow").cast("string")).select("row_key", "event_id", "event_type", *NUMERIC, "dow")
    parts = cut_lineage(split.stratified_holdout(rows, "event_type", "row_key", SEED, 0.2))  # read by every fitting pass
    model = prep.fit(parts.filter("split = 'train'").drop("split"), "event_type", ["row_key", "event_id"])
    out = model.transform(parts.filter("split = 'test'"), ["event_id"])
    return out.select("event_id", *[r6(F.col(c).cast("double"), 4).alias(c) for c in model.features], "label")


def fit_artifacts(spark: SparkSession, d: str) -> DataFrame:
    rows = orders(spark, d).drop("row_key", "y")
    return rounded(prep.fit(rows, "o_orderstatus").artifacts(), 5).drop("fill")


def legacy_recipe(spark: SparkSession, d: str) -> DataFrame:
    """The legacy clean-up on events dressed as that table."""
    t = F.col("event_type")
    rows = events(spark, d).select(
        "event_id", F.when(t == "view", "-").otherwise(t).alias("service"), F.when(F.col("k").isin(*TOKENS), None).otherwise(F.col("hour")).alias("ct_flw_http_mthd"),
        F.col("user_id").alias("srcip"), F.col("dow").alias("label"),
        F.when(t == "error", " Backdoors ").when(t == "click", "DoS").alias("attack_cat"))
    return prep.apply_recipe(rows, "attack_cat", prep.LEGACY_RECIPES["attack_cat"])


def stratified_holdout(spark: SparkSession, d: str) -> DataFrame:
    return split.stratified_holdout(events(spark, d), "event_type", "row_key", SEED, 0.2).select("event_id", "event_type", "split")


def stratified_folds(spark: SparkSession, d: str) -> DataFrame:
    return split.stratified_folds(events(spark, d), "event_type", "row_key", 10, SEED).select("event_id", "event_type", "fold")


def fold_membership(spark: SparkSession, d: str) -> DataFrame:
    folded = split.stratified_folds(orders(spark, d), "o_orderstatus", "row_key", 5, SEED)
    return split.fold_membership(folded, "row_key", 5)


def stratified_sample(spark: SparkSession, d: str) -> DataFrame:
    return split.stratified_sample(documents(spark, d).withColumn("key", F.col("doc_id").cast("string")), "quality", "key", 60, SEED).select("doc_id", "quality")


def class_weights(spark: SparkSession, d: str) -> DataFrame:
    return rounded(target.class_weights(documents(spark, d), "quality"))


QUERIES = {f.__name__: f for f in (
    role_projection, feature_projection, finite_values, type_split, impute_median, scale_population, impute_mode, ordinal_encode,
    encode_unseen, label_encode, apply_fitted, fit_artifacts, legacy_recipe, stratified_holdout, stratified_folds, fold_membership,
    stratified_sample, class_weights,
)}

_TOKEN_LIST = ", ".join(f"'{t}'" for t in TOKENS)
GAPS = f"""gp AS (SELECT row_key, event_id, event_type, CASE WHEN k IN ('1', '2', '3') THEN NULL ELSE value END AS value, user_id, hour, dow,
  CASE WHEN k IN ({_TOKEN_LIST}) THEN NULL ELSE CAST(k AS INT) END AS k FROM ev)"""


def _medians(table: str) -> str:
    return "md AS (SELECT " + ", ".join(f"median({c}) AS {c}" for c in NUMERIC) + f" FROM {table})"


def _filled(table: str, keep: str) -> str:
    return f"SELECT {keep}, " + ", ".join(f"coalesce({table}.{c}, md.{c}) AS {c}" for c in NUMERIC) + f" FROM {table}, md"


def _per_feature(table: str, expr: str) -> str:
    return "\nUNION ALL\n".join("SELECT '%s' AS feature, %s FROM %s" % (c, expr.replace("?", c), table) for c in NUMERIC)


_CAT = "SELECT '{0}' AS feature, CAST({1} AS VARCHAR) AS value FROM {2}"

SQL = {
    "role_projection": "SELECT o_orderstatus, o_totalprice, o_orderpriority FROM orders",
    "feature_projection": "SELECT l_tax, l_quantity, l_linestatus FROM lineitem",
    "finite_values": with_(EVENTS, GAPS, select="SELECT event_id, value FROM gp"),
    "type_split": with_(EVENTS, GAPS, select="\nUNION ALL\n".join(
        f"SELECT {i} AS pos, '{c}' AS feature, 'numeric' AS kind, " + ("count(*) FILTER (WHERE k IS NULL OR k <> 1)" if c == "value" else f"count({c})") + " AS n FROM gp"
        for i, c in enumerate(["value", "user_id", "hour", "dow", "k"]))),
    "impute_median": with_(EVENTS, GAPS, select=_per_feature("gp", "median(?) AS fill")),
    "scale_population": with_(EVENTS, GAPS, _medians("gp"), "fl AS (" + _filled("gp", "event_id") + ")",
                              select=_per_feature("fl", "round(avg(?), 5) AS mean, round(stddev_pop(?), 5) AS std")),
    "impute_mode": with_(EVENTS, "vs AS (" + " UNION ALL ".join((
        _CAT.format("k", f"CASE WHEN k IN ({_TOKEN_LIST}) THEN NULL ELSE k END", "ev"), _CAT.format("dow", "dow", "ev"), _CAT.format("event_type", "event_type", "ev"))) + ")",
        select="SELECT feature, value AS fill FROM (SELECT feature, value, row_number() OVER (PARTITION BY feature ORDER BY count(*) DESC, value) AS r FROM vs WHERE value IS NOT NULL GROUP BY feature, value) WHERE r = 1"),
    "ordinal_encode": with_("vs AS (" + " UNION ALL ".join(_CAT.format(c, c, "part") for c in ("p_name", "p_brand", "p_type")) + ")",
                            select="SELECT feature, value, count(*) AS n, CAST(row_number() OVER (PARTITION BY feature ORDER BY value) - 1 AS INT) AS code FROM vs GROUP BY feature, value"),
    "encode_unseen": with_(EVENTS, "pr AS (SELECT event_id, hour, concat(k, '/', CAST(user_id AS INT)) AS pair FROM ev)",
                           "dt AS (SELECT pair, CAST(row_number() OVER (ORDER BY pair) - 1 AS INT) AS code FROM pr WHERE hour < 2 GROUP BY pair)",
                           select="SELECT event_id, coalesce(code, -1) AS code FROM pr LEFT JOIN dt USING (pair)"),
    "label_encode": with_(EVENTS, select="SELECT event_type AS value, CAST(row_number() OVER (ORDER BY event_type) - 1 AS INT) AS code FROM ev GROUP BY 1"),
    "apply_fitted": with_(
        EVENTS, GAPS, holdout_sql("gp", "event_type", "row_key", share("gp", 0.2)), "tr AS (SELECT * FROM h_split WHERE split = 'train')",
        "te AS (SELECT * FROM h_split WHERE split = 'test')", _medians("tr"), "ft AS (" + _filled("tr", "event_id") + ")", "fe AS (" + _filled("te", "event_id, event_type, dow") + ")",
        "st AS (SELECT " + ", ".join(f"avg({c}) AS m_{c}, stddev_pop({c}) AS s_{c}" for c in NUMERIC) + " FROM ft)",
        "dd AS (SELECT CAST(dow AS VARCHAR) AS v, row_number() OVER (ORDER BY CAST(dow AS VARCHAR)) - 1 AS code FROM tr GROUP BY 1)",
        "ll AS (SELECT event_type, CAST(row_number() OVER (ORDER BY event_type) - 1 AS INT) AS label FROM tr GROUP BY 1)",
        select="SELECT event_id, " + ", ".join(f"round(CAST(CAST(({c} - m_{c}) / s_{c} AS FLOAT) AS DOUBLE), 4) AS {c}" for c in NUMERIC)
        + ", CAST(coalesce(dd.code, -1) AS DOUBLE) AS dow, label FROM fe JOIN st ON true LEFT JOIN dd ON dd.v = CAST(fe.dow AS VARCHAR) JOIN ll USING (event_type)"),
    "fit_artifacts": with_(ORDERS, select="\nUNION ALL\n".join(
        f"SELECT {i} AS pos, '{c}' AS feature, 'numeric' AS kind, round(avg({c}), 5) AS mean, round(stddev_pop({c}), 5) AS std FROM od"
        for i, c in enumerate(["o_totalprice", "custkey", "month", "day", "priority"]))),
    "legacy_recipe": with_(EVENTS, select=f"""SELECT event_id, CASE WHEN event_type = 'view' THEN 'service_unknown' ELSE event_type END AS service,
CASE WHEN k IN ({_TOKEN_LIST}) THEN 0 ELSE hour END AS ct_flw_http_mthd,
CASE event_type WHEN 'error' THEN 'backdoor' WHEN 'click' THEN 'dos' ELSE 'normal' END AS attack_cat FROM ev"""),
    "stratified_holdout": with_(EVENTS, holdout_sql("ev", "event_type", "row_key", share("ev", 0.2)), select="SELECT event_id, event_type, split FROM h_split"),
    "stratified_folds": with_(EVENTS, folds_sql("ev", "event_type", "row_key", 10), select="SELECT event_id, event_type, fold FROM f_folds"),
    "fold_membership": with_(ORDERS, folds_sql("od", "o_orderstatus", "row_key", 5),
                             select="SELECT row_key, CAST(g.fold AS INT) AS fold, CASE WHEN f.fold = g.fold THEN 'validation' ELSE 'train' END AS split FROM f_folds f, (SELECT unnest(range(1, 6)) AS fold) g"),
    "stratified_sample": with_(DOCUMENTS, "dk AS (SELECT *, CAST(doc_id AS VARCHAR) AS key FROM dc)", holdout_sql("dk", "quality", "key", "60"),
                               select="SELECT doc_id, quality FROM h_split WHERE split = 'test'"),
    "class_weights": with_(DOCUMENTS, select="SELECT quality, count(*) AS n_rows, round(sum(count(*)) OVER () / (count(*) OVER () * count(*)), 6) AS weight FROM dc GROUP BY quality"),
}
