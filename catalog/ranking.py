"""Feature rankers and the ranking suite."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from featsieve.operators import mrmr, mutual_info, prep, shadows, suite
from featsieve.operators.relief import relief_scores

from .base import (
    EMBEDDING_FEATURES, EMBEDDINGS, LINEITEM, LINEITEM_FEATURES, ORDERS, ORDERS_FEATURES, SEED, documents, embeddings, h32, holdout_sql, lineitem,
    orders, rounded, stats_scores, with_,
)

DIGITS = 8
DOCUMENT_FEATURES = ("n_chars", "words", "digits", "lang", "source")


def _ranked(scores: DataFrame, features: list[str]) -> DataFrame:
    return rounded(suite.ranked(scores, features, DIGITS))


def rank_pearson(spark: SparkSession, d: str) -> DataFrame:
    return _ranked(stats_scores(lineitem(spark, d), LINEITEM_FEATURES, "pearson"), LINEITEM_FEATURES)


def rank_chi2(spark: SparkSession, d: str) -> DataFrame:
    return _ranked(stats_scores(lineitem(spark, d), LINEITEM_FEATURES, "chi2"), LINEITEM_FEATURES)


def rank_fisher(spark: SparkSession, d: str) -> DataFrame:
    return _ranked(stats_scores(lineitem(spark, d), LINEITEM_FEATURES, "fisher"), LINEITEM_FEATURES)


def rank_wide(spark: SparkSession, d: str) -> DataFrame:
    """64 features: the long form of the statistics pass."""
    return _ranked(stats_scores(embeddings(spark, d), EMBEDDING_FEATURES, "fisher"), EMBEDDING_FEATURES)


def rank_mi_binned(spark: SparkSession, d: str) -> DataFrame:
    return _ranked(mutual_info.binned_scores(lineitem(spark, d), "y", LINEITEM_FEATURES), LINEITEM_FEATURES)


def rank_mi_knn(spark: SparkSession, d: str) -> DataFrame:
    return _ranked(mutual_info.knn_scores(orders(spark, d), "y", "row_key", ORDERS_FEATURES, seed=SEED), ORDERS_FEATURES)


def rank_relieff(spark: SparkSession, d: str) -> DataFrame:
    return _ranked(relief_scores(embeddings(spark, d), "y", "row_key", EMBEDDING_FEATURES, max_rows=None, seed=SEED), EMBEDDING_FEATURES)


def rank_mrmr(spark: SparkSession, d: str) -> DataFrame:
    df = orders(spark, d)
    relevance = mutual_info.knn_scores(df, "y", "row_key", ORDERS_FEATURES, seed=SEED)
    return _ranked(mrmr.mrmr_scores(df, ORDERS_FEATURES, relevance), ORDERS_FEATURES)


def rank_suite(spark: SparkSession, d: str) -> DataFrame:
    """Three filters and one unknown method on all orders."""
    out = suite.run_suite("orders", orders(spark, d), "y", "row_key", ORDERS_FEATURES, ["pearson", "chi2", "fisher", "unknown"], seed=SEED)
    return rounded(out.drop("runtime_seconds"))


def _context(spark: SparkSession, d: str) -> suite.FitContext:
    """All orders, scaled."""
    rows = orders(spark, d).drop("o_orderstatus")
    scaled = prep.fit(rows, "y", ["row_key"]).transform(rows, ["row_key"])
    return suite.FitContext(scaled.persist(), "label", "row_key", ORDERS_FEATURES, SEED)


def _document_context(spark: SparkSession, d: str) -> suite.FitContext:
    """All labelled documents, encoded and scaled: the table for rankers that grow hundreds of trees."""
    rows = documents(spark, d).select("doc_id", F.col("quality").alias("y"), *DOCUMENT_FEATURES).persist()  # the texts are read once
    model = prep.fit(rows, "y", ["doc_id"])
    scaled = model.transform(rows, ["doc_id"]).persist()
    scaled.count()
    rows.unpersist()
    return suite.FitContext(scaled, "label", "doc_id", list(model.features), SEED)


def _model_ranker(method: str, context=_context):
    def rank(spark: SparkSession, d: str) -> DataFrame:
        x = context(spark, d)
        found = suite.rank_features(x, method)
        x.df.unpersist()
        return found

    rank.__name__ = f"rank_{method}"
    return rank


def shadow_columns(spark: SparkSession, d: str) -> DataFrame:
    """Shuffled copies of all columns of the orders hold the columns' values, each as often."""
    return rounded(shadows.shadow_report(orders(spark, d), "y", "row_key", ORDERS_FEATURES, SEED), 2)


QUERIES = {f.__name__: f for f in (rank_pearson, rank_chi2, rank_fisher, rank_wide, rank_mi_binned, rank_mi_knn, rank_relieff, rank_mrmr, rank_suite, shadow_columns)}
QUERIES |= {
    "rank_lasso": _model_ranker("lasso_c1.0"), "rank_elasticnet": _model_ranker("elasticnet_c1.0"), "rank_rfe": _model_ranker("rfe"), "rank_rfecv": _model_ranker("rfecv"),
    "rank_ga": _model_ranker("ga"), "rank_pso": _model_ranker("pso"), "rank_mi_rfe": _model_ranker("mi_rfe"), "rank_mi_ga": _model_ranker("mi_ga"),
    "rank_rf": _model_ranker("rf", _document_context), "rank_gbt": _model_ranker("gbt", _document_context), "rank_gbt_splits": _model_ranker("lightgbm", _document_context),
    "rank_boruta": _model_ranker("boruta", _document_context), "rank_chi2_boruta": _model_ranker("chi2_boruta", _document_context),
    "rank_chi2_xgboost": _model_ranker("chi2_xgboost", _document_context), "rank_fisher_lightgbm": _model_ranker("fisher_lightgbm", _document_context),
}


# --- SQL ---------------------------------------------------------------------------------------

def unpivot(table: str, features: list[str], keep: str, name: str = "lg") -> str:
    return f"{name} AS (" + " UNION ALL ".join(f"SELECT {keep}, {i} AS pos, '{c}' AS feature, CAST({c} AS DOUBLE) AS v FROM {table}" for i, c in enumerate(features)) + ")"


def score_sql(method: str, src: str = "lg") -> str:
    """(pos, feature, score) from long rows (y, pos, feature, v)."""
    if method == "pearson":
        return f"SELECT pos, feature, CASE WHEN min(v) = max(v) OR min(y) = max(y) THEN 0.0 ELSE abs(corr(v, y)) END AS score FROM {src} GROUP BY 1, 2"
    if method == "fisher":
        return f"""SELECT pos, feature, sum(n * (m - mu) * (m - mu)) / (sum(n * s) + 1e-12) AS score FROM (
  SELECT pos, feature, y, count(*) AS n, avg(v) AS m, var_pop(v) AS s, any_value(mu) AS mu
  FROM {src} JOIN (SELECT pos, avg(v) AS mu FROM {src} GROUP BY 1) USING (pos) GROUP BY 1, 2, 3) GROUP BY 1, 2"""
    return f"""SELECT pos, feature, coalesce(sum((o - e) * (o - e) / nullif(e, 0)), 0.0) AS score FROM (
  SELECT pos, feature, o, sum(o) OVER (PARTITION BY pos) * n / sum(n) OVER (PARTITION BY pos) AS e FROM (
    SELECT pos, feature, y, count(*) AS n, sum(CASE WHEN hi = lo THEN 0.0 ELSE (v - lo) / (hi - lo) END) AS o
    FROM {src} JOIN (SELECT pos, min(v) AS lo, max(v) AS hi FROM {src} GROUP BY 1) USING (pos) GROUP BY 1, 2, 3)) GROUP BY 1, 2"""


def ranked_sql(scores: str, extra: str = "") -> str:
    return f"SELECT {extra}CAST(row_number() OVER (ORDER BY round(score, {DIGITS}) DESC, pos DESC) AS INT) AS rank, feature, round(score, 6) AS score FROM ({scores})"


def psi(n: str) -> str:
    y = f"({n} + 16.0)"
    back = " - ".join(f"1 / ({n} + {float(i)})" for i in range(16))
    return f"(ln{y} - 1 / (2 * {y}) - 1 / (12 * {y}**2) + 1 / (120 * {y}**4) - 1 / (252 * {y}**6) - {back})"


def knn_mi_sql(k: int = 3) -> str:
    """CTEs ending in mi (pos, feature, score), from long rows lg (row_key, y, pos, feature, v); every label has more than k rows."""
    spans = []
    for i in range(k + 1):
        left = f"lag(z, {i}) OVER w" if i else "z"
        right = f"lead(z, {k - i}) OVER w" if k - i else "z"
        spans.append(f"""CASE WHEN {left} IS NOT NULL AND {right} IS NOT NULL THEN greatest(z - {left}, {right} - z) END AS d{i},
  {left} AS l{i}, {right} AS r{i}""")
    least = "least(" + ", ".join(f"d{i}" for i in range(k + 1)) + ")"
    pick_l = "CASE " + " ".join(f"WHEN d{i} = d AND z - l{i} >= r{i} - z THEN l{i}" for i in range(k + 1)) + " ELSE z - d END"
    pick_r = "CASE " + " ".join(f"WHEN d{i} = d AND r{i} - z >= z - l{i} THEN r{i}" for i in range(k + 1)) + " ELSE z + d END"
    key = "concat(row_key, ':', pos)"
    return f"""sc AS (SELECT pos, max(abs(v)) AS a FROM lg GROUP BY 1),
pt AS (SELECT pos, feature, row_key, y, v + ({h32(key, SEED)} * 2.0 / 4294967296.0 - 1.0) * 1e-10 * a AS z FROM lg JOIN sc USING (pos)),
sp AS (SELECT *, count(*) OVER (PARTITION BY pos, y) AS n_c, {', '.join(spans)} FROM pt WINDOW w AS (PARTITION BY pos, y ORDER BY z, row_key)),
ds AS (SELECT *, {least} AS d FROM sp),
nb AS (SELECT pos, feature, row_key, n_c, z, {pick_l} AS lo, {pick_r} AS hi FROM ds),
mk AS (SELECT pos, row_key, z AS v, 1 AS kind, 0 AS sign FROM nb UNION ALL SELECT pos, row_key, lo, 2, -1 FROM nb UNION ALL SELECT pos, row_key, hi, 0, 1 FROM nb),
ct AS (SELECT pos, row_key, sign, sum(CASE WHEN kind = 1 THEN 1 ELSE 0 END) OVER (PARTITION BY pos ORDER BY v, kind ROWS UNBOUNDED PRECEDING) AS upto FROM mk),
mm AS (SELECT pos, row_key, greatest(1, sum(sign * upto)) AS m FROM ct GROUP BY 1, 2),
mi AS (SELECT pos, feature, greatest(0.0, {psi('count(*)')} + {psi(f'{float(k)}')} - avg({psi('n_c')}) - avg({psi('m')})) AS score
  FROM nb JOIN mm USING (pos, row_key) GROUP BY 1, 2)"""


def _binned(bins: int = 32) -> str:
    return f"""SELECT pos, feature, greatest(0.0, sum(n / t * ln(n * t / (nb * ny)))) AS score FROM (
  SELECT pos, feature, CAST(n AS DOUBLE) AS n, sum(n) OVER (PARTITION BY pos) AS t, sum(n) OVER (PARTITION BY pos, bin) AS nb, sum(n) OVER (PARTITION BY pos, y) AS ny FROM (
    SELECT pos, feature, y, least(floor((v - lo) / (hi - lo) * {bins}.0), {bins - 1}) AS bin, count(*) AS n
    FROM lg JOIN (SELECT pos, min(v) AS lo, max(v) AS hi FROM lg GROUP BY 1) USING (pos) GROUP BY 1, 2, 3, 4)) GROUP BY 1, 2"""


_LI = unpivot("li", LINEITEM_FEATURES, "y")
_OD = unpivot("od", ORDERS_FEATURES, "row_key, y")
_EM = unpivot("em", EMBEDDING_FEATURES, "row_key, y")

RELIEF = """vx AS (SELECT CAST(vec_id AS VARCHAR) AS row_key, label AS y, CAST(embedding AS DOUBLE[]) AS x FROM embeddings),
nn AS (SELECT a.row_key AS a, b.row_key AS b, a.y = b.y AS hit,
  row_number() OVER (PARTITION BY a.row_key ORDER BY round(list_distance(a.x, b.x), 9), b.row_key) AS r FROM vx a JOIN vx b ON a.row_key <> b.row_key),
gp AS (SELECT a, hit, p.pos, avg(abs(va.x[p.pos + 1] - vb.x[p.pos + 1])) AS gap FROM nn JOIN vx va ON va.row_key = a JOIN vx vb ON vb.row_key = b,
  (SELECT unnest(range(64)) AS pos) p WHERE r <= 10 GROUP BY 1, 2, 3)"""

MRMR = """cr AS (SELECT a.pos AS i, b.pos AS j, abs(corr(a.v, b.v)) AS c FROM lg a JOIN lg b USING (row_key) GROUP BY 1, 2),
gr AS (SELECT 0 AS step, CAST([] AS INT[]) AS chosen, CAST(NULL AS INT) AS pos, CAST(NULL AS DOUBLE) AS score
  UNION ALL
  SELECT step + 1, list_append(chosen, best.pos), best.pos, best.score FROM (
    SELECT g.step, g.chosen, arg_min({'pos': m.pos, 'score': m.score - coalesce(u.c, 0)}, {'s': -round(m.score - coalesce(u.c, 0), 12), 'p': m.pos}) AS best
    FROM gr g JOIN mi m ON NOT list_contains(g.chosen, m.pos)
    LEFT JOIN (SELECT g2.step AS st, cr.i, avg(cr.c) AS c FROM gr g2 JOIN cr ON list_contains(g2.chosen, cr.j) GROUP BY 1, 2) u ON u.i = m.pos AND u.st = g.step
    GROUP BY 1, 2))"""

SQL = {
    "rank_pearson": with_(LINEITEM, _LI, select=ranked_sql(score_sql("pearson"))),
    "rank_chi2": with_(LINEITEM, _LI, select=ranked_sql(score_sql("chi2"))),
    "rank_fisher": with_(LINEITEM, _LI, select=ranked_sql(score_sql("fisher"))),
    "rank_wide": with_(EMBEDDINGS, _EM, select=ranked_sql(score_sql("fisher"))),
    "rank_mi_binned": with_(LINEITEM, _LI, select=ranked_sql(_binned())),
    "rank_mi_knn": with_(ORDERS, _OD, knn_mi_sql(), select=ranked_sql("SELECT * FROM mi")),
    "rank_relieff": with_(RELIEF, select=ranked_sql(
        "SELECT pos, 'e' || lpad(CAST(pos AS VARCHAR), 2, '0') AS feature, sum(CASE WHEN hit THEN -gap ELSE gap END) / (SELECT count(*) FROM vx) AS score FROM gp GROUP BY pos")),
    "rank_mrmr": with_(ORDERS, _OD, knn_mi_sql(), MRMR, select="SELECT step AS rank, feature, round(gr.score, 6) AS score FROM gr JOIN (SELECT pos, feature FROM mi) USING (pos) WHERE step > 0").replace("WITH ", "WITH RECURSIVE ", 1),
    "shadow_columns": with_(ORDERS, _OD, select="""SELECT feature, count(*) AS rows, count(DISTINCT v) AS distinct_values, round(sum(v), 2) AS total, CAST(0 AS BIGINT) AS unmatched, true AS shuffled FROM lg GROUP BY feature"""),
    "rank_suite": with_(
        ORDERS, _OD,
        "ok AS (" + " UNION ALL ".join(ranked_sql(score_sql(m), f"'orders' AS dataset, '{m}' AS method, 'filter' AS family, ") for m in ("pearson", "chi2", "fisher")) + ")",
        select=f"""SELECT *, '{{"seed": {SEED}}}' AS params_json, 'ok' AS status, '' AS error FROM ok
UNION ALL SELECT 'orders', 'unknown', 'unknown', NULL, '', NULL, '{{}}', 'failed', 'no ranker is called unknown'"""),
}
