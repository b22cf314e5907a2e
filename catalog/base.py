"""Tables the queries run on, and the SQL text shared by their twins."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from featsieve.operators import filters

SEED = 42


def load(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def r6(c: Column | str, digits: int = 6) -> Column:
    return F.round(F.col(c) if isinstance(c, str) else c, digits)


def rounded(df: DataFrame, digits: int = 6) -> DataFrame:
    """Round every double column, so that both engines print the same value."""
    return df.select(*[F.round(c, digits).alias(c) if t == "double" else F.col(c) for c, t in df.dtypes])


def events(spark: SparkSession, d: str) -> DataFrame:
    """Five classes, unique key; k is text, '7' and '70' count as missing tokens."""
    return load(spark, d, "events").select(
        F.col("event_id").cast("string").alias("row_key"), "event_id", "event_type", "value",
        F.col("user_id").cast("double").alias("user_id"), F.hour("ts").alias("hour"), F.dayofweek("ts").alias("dow"),
        F.get_json_object("props", "$.k").alias("k"))


def orders(spark: SparkSession, d: str) -> DataFrame:
    return load(spark, d, "orders").select(
        F.col("o_orderkey").cast("string").alias("row_key"), "o_orderstatus", "o_totalprice",
        F.col("o_custkey").cast("double").alias("custkey"), F.month("o_orderdate").cast("double").alias("month"),
        F.dayofmonth("o_orderdate").cast("double").alias("day"), F.substring("o_orderpriority", 1, 1).cast("double").alias("priority"),
        coded("o_orderstatus", "F", "O", "P").alias("y"))


def lineitem(spark: SparkSession, d: str) -> DataFrame:
    return load(spark, d, "lineitem").select(
        *LINEITEM_FEATURES, "l_returnflag", "l_linestatus", coded("l_returnflag", "A", "N", "R").alias("y"))


def embeddings(spark: SparkSession, d: str) -> DataFrame:
    """64 float columns e00..e63, ten classes."""
    return load(spark, d, "embeddings").select(
        F.col("vec_id").cast("string").alias("row_key"), F.col("label").alias("y"),
        *[F.col("embedding")[i].cast("double").alias(e) for i, e in enumerate(EMBEDDING_FEATURES)])


def documents(spark: SparkSession, d: str) -> DataFrame:
    """Unbalanced binary target ``quality`` on features of the whole texts."""
    text = F.col("text")
    spaces = F.length(text) - F.length(F.replace(text, F.lit(" "), F.lit("")))
    # numbers are joined, not texts; runs of other characters go at once
    numbers = load(spark, d, "documents").select(
        "doc_id", "lang", "source", F.col("n_chars").cast("double").alias("n_chars"), (spaces + 1).cast("double").alias("words"),
        F.length(F.regexp_replace(text, "[^0-9]+", "")).cast("double").alias("digits"))
    return numbers.join(load(spark, d, "labels"), "doc_id").select("doc_id", "quality", "toxic", "lang", "source", "n_chars", "words", "digits")


def coded(name: str, *labels: str) -> Column:
    out = F.when(F.col(name) == labels[0], 0)
    for i, label in enumerate(labels[1:], start=1):
        out = out.when(F.col(name) == label, i)
    return out


LINEITEM_FEATURES = ["l_quantity", "l_extendedprice", "l_discount", "l_tax", "l_linenumber"]
ORDERS_FEATURES = ["o_totalprice", "custkey", "month", "day", "priority"]
EMBEDDING_FEATURES = [f"e{i:02d}" for i in range(64)]
EVENT_TYPES = ("click", "error", "purchase", "signup", "view")

# the same tables as SQL
EVENTS = """ev AS (SELECT CAST(event_id AS VARCHAR) AS row_key, event_id, event_type, value, CAST(user_id AS DOUBLE) AS user_id,
  CAST(hour(ts) AS INT) AS hour, CAST(dayofweek(ts) + 1 AS INT) AS dow, json_extract_string(props, '$.k') AS k FROM events)"""
ORDERS = """od AS (SELECT CAST(o_orderkey AS VARCHAR) AS row_key, o_orderstatus, o_totalprice, CAST(o_custkey AS DOUBLE) AS custkey,
  CAST(month(o_orderdate) AS DOUBLE) AS month, CAST(day(o_orderdate) AS DOUBLE) AS day,
  CAST(substr(o_orderpriority, 1, 1) AS DOUBLE) AS priority,
  CASE o_orderstatus WHEN 'F' THEN 0 WHEN 'O' THEN 1 WHEN 'P' THEN 2 END AS y FROM orders)"""
LINEITEM = """li AS (SELECT l_quantity, l_extendedprice, l_discount, l_tax, l_linenumber, l_returnflag, l_linestatus,
  CASE l_returnflag WHEN 'A' THEN 0 WHEN 'N' THEN 1 WHEN 'R' THEN 2 END AS y FROM lineitem)"""
EMBEDDINGS = "em AS (SELECT CAST(vec_id AS VARCHAR) AS row_key, label AS y, %s FROM embeddings)" % ", ".join(
    f"CAST(embedding[{i + 1}] AS DOUBLE) AS {e}" for i, e in enumerate(EMBEDDING_FEATURES))
DOCUMENTS = """dc AS (SELECT d.doc_id, quality, toxic, lang, source, CAST(n_chars AS DOUBLE) AS n_chars,
  CAST(len(string_split(text, ' ')) AS DOUBLE) AS words, CAST(length(regexp_replace(text, '[^0-9]', '', 'g')) AS DOUBLE) AS digits
  FROM documents d JOIN labels USING (doc_id))"""


def h32(key: str, *salts: object) -> str:
    parts = ", ".join([f"CAST({key} AS VARCHAR)", *[f"'{s}'" for s in salts]])
    return f"CAST(CAST(('0x' || substr(md5(concat_ws(':', {parts})), 1, 8)) AS UBIGINT) AS BIGINT)"


def holdout_sql(table: str, label: str, key: str, test_rows: str, prefix: str = "h", seed: int = SEED) -> str:
    """CTEs ending in <prefix>_split: the table with column split."""
    p = prefix
    return f"""{p}_n AS (SELECT {label} AS c, count(*)::HUGEINT AS n FROM {table} GROUP BY 1),
{p}_t AS (SELECT sum(n)::HUGEINT AS total, greatest(sum(n)::HUGEINT - least(sum(n)::HUGEINT, CAST({test_rows} AS HUGEINT)), 0) AS kept FROM {p}_n),
{p}_w AS (SELECT c, n, (n * kept) // total AS whole, (n * kept) % total AS rest, kept FROM {p}_n, {p}_t),
{p}_q AS (SELECT c, n - whole - CASE WHEN row_number() OVER (ORDER BY rest DESC, c) <= kept - sum(whole) OVER () THEN 1 ELSE 0 END AS take FROM {p}_w),
{p}_r AS (SELECT *, row_number() OVER (PARTITION BY {label} ORDER BY {h32(key, seed)}, {key}) AS rn FROM {table}),
{p}_split AS (SELECT {p}_r.* EXCLUDE (rn), CASE WHEN rn <= take THEN 'test' ELSE 'train' END AS split FROM {p}_r JOIN {p}_q ON c = {label})"""


def share(table: str, size: float) -> str:
    return f"(SELECT ceil(round(count(*) * {size}, 9)) FROM {table})"


def folds_sql(table: str, label: str, key: str, k: int, prefix: str = "f", seed: int = SEED) -> str:
    """CTEs ending in <prefix>_folds: the table with column fold."""
    p = prefix

    def upto(end: str) -> str:
        return f"CAST(floor(({end} - (fold - 1) + {k - 1}) / {k}.0) AS BIGINT)"

    return f"""{p}_n AS (SELECT {label} AS c, count(*)::BIGINT AS n FROM {table} GROUP BY 1),
{p}_o AS (SELECT c, n, CAST(sum(n) OVER (ORDER BY c ROWS UNBOUNDED PRECEDING) AS BIGINT) AS hi FROM {p}_n),
{p}_e AS (SELECT c, fold, CAST(sum({upto('hi')} - {upto('(hi - n)')}) OVER (PARTITION BY c ORDER BY fold ROWS UNBOUNDED PRECEDING) AS BIGINT) AS upto
  FROM {p}_o, (SELECT unnest(range(1, {k + 1})) AS fold)),
{p}_r AS (SELECT *, row_number() OVER (PARTITION BY {label} ORDER BY {h32(key, seed)}, {key}) AS rn FROM {table}),
{p}_folds AS (SELECT r.* EXCLUDE (rn), CAST(e.fold AS INT) AS fold FROM {p}_r r JOIN
  (SELECT c, fold, upto, lag(upto, 1, 0) OVER (PARTITION BY c ORDER BY fold) AS below FROM {p}_e) e
  ON e.c = r.{label} AND r.rn > e.below AND r.rn <= e.upto)"""


def with_(*ctes: str, select: str) -> str:
    return "WITH " + ",\n".join(ctes) + "\n" + select


def stats_scores(df: DataFrame, features: list[str], method: str) -> DataFrame:
    return filters.STATS_SCORES[method](filters.class_stats(df, "y", features))
