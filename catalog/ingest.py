"""Sources, guards and audit."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from featsieve import sources
from featsieve.operators import audit, split, target
from featsieve.functions import hash32, portable_key

from .base import EVENTS, LINEITEM, SEED, DOCUMENTS, documents, events, h32, holdout_sql, lineitem, load, with_

SEGMENTS = {" Building ": "fixed", "AUTOMOBILE": "mobile", "machinery": "mobile"}
TOKENS = ["7", "70", "NA"]


def read_table(spark: SparkSession, d: str) -> DataFrame:
    return sources.read_tables(spark, [f"{d}/orders.parquet"], "parquet").select("o_orderkey", "o_custkey", "o_orderstatus", "o_totalprice", "o_orderpriority")


def normalized_columns(spark: SparkSession, d: str) -> DataFrame:
    raw = load(spark, d, "customer").toDF(" C_CustKey", "C_ Name ", "C_NationKey", "C_AcctBal ", "C_MktSegment")
    clean = sources.normalize_columns(raw)
    sources.check_columns(clean.columns, "c_mktsegment")
    return clean


def label_mapping(spark: SparkSession, d: str) -> DataFrame:
    rows = load(spark, d, "customer").select("c_custkey", F.concat(F.lit("\t"), "c_mktsegment", F.lit(" \n")).alias("c_mktsegment"))
    return target.map_labels(rows, "c_mktsegment", SEGMENTS, case_insensitive=True, default="other")[0]


def unmapped_labels(spark: SparkSession, d: str) -> DataFrame:
    return target.unmapped_labels(load(spark, d, "customer"), "c_mktsegment", SEGMENTS, case_insensitive=True)


def target_guards(spark: SparkSession, d: str) -> DataFrame:
    return target.target_facts(events(spark, d), "event_type")


def task_inference(spark: SparkSession, d: str) -> DataFrame:
    tables = {"lineitem": (lineitem(spark, d), "l_linestatus"), "events": (events(spark, d), "event_type"), "documents": (documents(spark, d), "quality")}
    return audit.combine([target.target_facts(df, t).select(F.lit(n).alias("dataset"), "n_classes", "task") for n, (df, t) in tables.items()])


def missing_tokens(spark: SparkSession, d: str) -> DataFrame:
    return target.null_tokens(events(spark, d), TOKENS, "event_type").select("event_id", "event_type", "k")


def shuffled_rows(spark: SparkSession, d: str) -> DataFrame:
    """The place of every event in the shuffled table."""
    rows = split.with_position(split.shuffled(events(spark, d).select("event_id", "row_key"), "row_key", SEED))
    return rows.select("event_id", "position", hash32(F.col("row_key"), SEED).alias("shuffle_key"))


def row_cap(spark: SparkSession, d: str) -> DataFrame:
    return split.stratified_sample(events(spark, d), "event_type", "row_key", 500, SEED).select("event_id", "event_type")


def content_fingerprint(spark: SparkSession, d: str) -> DataFrame:
    return sources.content_fingerprint(events(spark, d), portable_key("event_id", "event_type", "k"))


def file_fingerprint(spark: SparkSession, d: str) -> DataFrame:
    return sources.file_fingerprint(spark, d, "*.parquet")


def loader_metadata(spark: SparkSession, d: str) -> DataFrame:
    spec = {"name": "orders", "path": f"{d}/orders.parquet", "format": "parquet", "target_col": "o_orderstatus"}
    return sources.loader_metadata(sources.load_dataset(spark, spec))


def dataset_change_guard(spark: SparkSession, d: str) -> DataFrame:
    """Event types whose rows change when k is lower-cased and tokens are dropped: stored against current fingerprint."""
    rows = events(spark, d)

    def prints(df: DataFrame) -> DataFrame:
        h = hash32(portable_key("event_id", "k"), "content").cast("decimal(38,0)")
        return df.groupBy(F.col("event_type").alias("dataset")).agg(F.sum(h).cast("string").alias("dataset_fingerprint"))

    cleaned = rows.withColumn("k", F.when((F.col("event_type") == "view") & F.col("k").isin(*TOKENS), None).otherwise(F.col("k")))
    return sources.changed_since(prints(rows), prints(cleaned)).select("dataset", "old_fingerprint", "new_fingerprint")


def split_feasibility(spark: SparkSession, d: str) -> DataFrame:
    return target.split_feasibility(documents(spark, d), "quality", 10)


def validate_report(spark: SparkSession, d: str) -> DataFrame:
    tables = {"lineitem": (lineitem(spark, d).drop("y"), "l_returnflag"), "events": (events(spark, d).drop("row_key"), "event_type")}
    return audit.combine([audit.validation_report(n, df, t, 10) for n, (df, t) in tables.items()])


def audit_summary(spark: SparkSession, d: str) -> DataFrame:
    rows = target.null_tokens(events(spark, d).drop("row_key", "event_id"), TOKENS, "event_type")
    return audit.audit_summary(rows, "event_type", "events", ["click", "view"])


def label_counts(spark: SparkSession, d: str) -> DataFrame:
    return audit.label_counts(load(spark, d, "documents").join(load(spark, d, "labels"), "doc_id", "left"), "quality", "documents")


def benign_counts(spark: SparkSession, d: str) -> DataFrame:
    return audit.benign_counts(events(spark, d), "event_type", ["CLICK", "view"])


def duplicate_rows(spark: SparkSession, d: str) -> DataFrame:
    return audit.duplicate_rows(lineitem(spark, d).select("l_quantity", "l_discount", "l_tax", "l_returnflag", "l_linestatus"))


def combined_audit(spark: SparkSession, d: str) -> DataFrame:
    parts = [
        audit.audit_summary(lineitem(spark, d).drop("y"), "l_linestatus", "lineitem", ["f"]),
        audit.audit_summary(documents(spark, d).drop("toxic"), "quality", "documents"),
    ]
    return audit.combine(parts)


QUERIES = {f.__name__: f for f in (
    read_table, normalized_columns, label_mapping, unmapped_labels, target_guards, task_inference, missing_tokens, shuffled_rows,
    row_cap, content_fingerprint, file_fingerprint, loader_metadata, dataset_change_guard, split_feasibility, validate_report,
    audit_summary, label_counts, benign_counts, duplicate_rows, combined_audit,
)}


def _mapped(default: str) -> str:
    return f"CASE lower(trim(c_mktsegment)) WHEN 'building' THEN 'fixed' WHEN 'automobile' THEN 'mobile' WHEN 'machinery' THEN 'mobile' ELSE {default} END"


def _audit(table: str, cols: str, goal: str, name: str, benign: str | None, extra: str = "") -> str:
    hit = f"CAST(count(*) FILTER (WHERE {benign}) AS BIGINT)" if benign else "CAST(NULL AS BIGINT)"
    rest = f"CAST(count(*) FILTER (WHERE NOT ({benign})) AS BIGINT)" if benign else "CAST(NULL AS BIGINT)"
    names = [c.strip() for c in cols.split(",")]
    missing = " + ".join(f"CASE WHEN {c} IS NULL THEN 1 ELSE 0 END" for c in names)
    return f"""SELECT '{name}' AS dataset, count(*) AS raw_total_rows_after_loading, CAST({len(names)} AS BIGINT) AS num_columns_after_loading,
CAST({len(names) - 1} AS BIGINT) AS num_features_before_preprocessing, '{goal}' AS target_column,
CASE WHEN count(DISTINCT {goal}) = 2 THEN 'binary' ELSE 'multiclass' END AS task, count(DISTINCT {goal}) AS num_target_classes,
{hit} AS benign_or_normal_count, {rest} AS malicious_or_attack_count, CAST(sum({missing}) AS BIGINT) AS missing_values_total,
count(*) - (SELECT count(*) FROM (SELECT DISTINCT {cols} FROM {table})) AS duplicate_rows, '' AS dataset_fingerprint FROM {table}"""


_TOKEN_LIST = ", ".join(f"'{t}'" for t in TOKENS)


def _facts(table: str, goal: str) -> str:
    return f"""(SELECT CAST(sum(n) AS BIGINT) AS n_rows, CAST(coalesce(sum(n) FILTER (WHERE c IS NULL), 0) AS BIGINT) AS null_targets,
count(c) AS n_classes, CAST(min(n) FILTER (WHERE c IS NOT NULL) AS BIGINT) AS smallest_class,
CASE WHEN count(c) = 2 THEN 'binary' ELSE 'multiclass' END AS task FROM (SELECT {goal} AS c, count(*) AS n FROM {table} GROUP BY 1))"""


SQL = {
    "read_table": "SELECT o_orderkey, o_custkey, o_orderstatus, o_totalprice, o_orderpriority FROM orders",
    "normalized_columns": "SELECT * FROM customer",
    "label_mapping": f"SELECT c_custkey, {_mapped(chr(39) + 'other' + chr(39))} AS c_mktsegment FROM customer",
    "unmapped_labels": f"SELECT lower(trim(c_mktsegment)) AS label, count(*) AS n_rows FROM customer WHERE {_mapped('NULL')} IS NULL GROUP BY 1",
    "target_guards": with_(EVENTS, select=f"SELECT * FROM {_facts('ev', 'event_type')}"),
    "task_inference": with_(EVENTS, LINEITEM, DOCUMENTS, select="\nUNION ALL\n".join(
        f"SELECT '{n}' AS dataset, n_classes, task FROM {_facts(t, g)}"
        for n, t, g in (("lineitem", "li", "l_linestatus"), ("events", "ev", "event_type"), ("documents", "dc", "quality")))),
    "missing_tokens": with_(EVENTS, select=f"SELECT event_id, event_type, CASE WHEN k IN ({_TOKEN_LIST}) THEN NULL ELSE k END AS k FROM ev"),
    "shuffled_rows": with_(EVENTS, select=f"SELECT event_id, row_number() OVER (ORDER BY {h32('row_key', SEED)}, row_key) - 1 AS position, {h32('row_key', SEED)} AS shuffle_key FROM ev"),
    "row_cap": with_(EVENTS, holdout_sql("ev", "event_type", "row_key", "500"), select="SELECT event_id, event_type FROM h_split WHERE split = 'test'"),
    "content_fingerprint": with_(EVENTS, select=f"SELECT count(*) AS n_rows, CAST(sum({h32('concat(event_id, chr(124), event_type, chr(124), k)', 'content')}) AS VARCHAR) AS hash_sum FROM ev"),
    "dataset_change_guard": with_(EVENTS, select=f"""SELECT dataset, old_fingerprint, new_fingerprint FROM (SELECT event_type AS dataset,
CAST(sum({h32("concat_ws('|', event_id, k)", 'content')}) AS VARCHAR) AS old_fingerprint,
CAST(sum({h32(f"concat_ws('|', event_id, CASE WHEN event_type = 'view' AND k IN ({_TOKEN_LIST}) THEN '' ELSE k END)", 'content')}) AS VARCHAR) AS new_fingerprint
FROM ev GROUP BY 1) WHERE old_fingerprint <> new_fingerprint"""),
    "split_feasibility": with_(DOCUMENTS, select=f"SELECT n_classes, smallest_class, 10 AS n_splits, smallest_class >= 10 AS feasible FROM {_facts('dc', 'quality')}"),
    "validate_report": with_(EVENTS, LINEITEM, select="\nUNION ALL\n".join(
        f"SELECT '{n}' AS dataset, n_rows AS rows, CAST({w} AS BIGINT) AS features, n_classes AS classes, smallest_class, null_targets, task, smallest_class >= 10 AS splittable FROM {_facts(t, g)}"
        for n, t, g, w in (("lineitem", "li", "l_returnflag", 6), ("events", "ev", "event_type", 6)))),
    "audit_summary": with_(EVENTS, f"tk AS (SELECT event_type, value, user_id, hour, dow, CASE WHEN k IN ({_TOKEN_LIST}) THEN NULL ELSE k END AS k FROM ev)",
                           select=_audit("tk", "event_type, value, user_id, hour, dow, k", "event_type", "events", "lower(trim(event_type)) IN ('click', 'view')")),
    "label_counts": "SELECT 'documents' AS dataset, CAST(quality AS VARCHAR) AS label, count(*) AS count FROM documents LEFT JOIN labels USING (doc_id) GROUP BY 2",
    "benign_counts": "SELECT count(*) FILTER (WHERE lower(trim(event_type)) IN ('click', 'view')) AS benign_or_normal_count, count(*) FILTER (WHERE lower(trim(event_type)) NOT IN ('click', 'view')) AS malicious_or_attack_count FROM events",
    "duplicate_rows": "SELECT count(*) - (SELECT count(*) FROM (SELECT DISTINCT l_quantity, l_discount, l_tax, l_returnflag, l_linestatus FROM lineitem)) AS duplicate_rows FROM lineitem",
    "combined_audit": with_(LINEITEM, DOCUMENTS, select=_audit(
        "li", "l_quantity, l_extendedprice, l_discount, l_tax, l_linenumber, l_returnflag, l_linestatus", "l_linestatus", "lineitem", "lower(trim(l_linestatus)) IN ('f')")
        + "\nUNION ALL\n" + _audit("dc", "doc_id, quality, lang, source, n_chars, words, digits", "quality", "documents", None)),
}
