"""Operator 5: quality scores by co-training of a text view and a metadata view.

Two logistic classifiers see different columns: one the text alone, one the metadata alone (source, lang, stated length).
They start from the same labelled sample. In each round each gives the other its confident labels on an unlabelled pool.
Each view is then calibrated on labelled rows neither has seen, and the calibrated log-odds are added for every document.

Fitted on bounded samples drawn by a hash: about ``labelled`` labelled rows and ``pool`` unlabelled ones. All
documents are scored, whole texts.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F

from featsieve.functions import local_table

from .common import sliced

LABELLED, POOL = 4_000, 6_000
ROUNDS, CONFIDENT, GIVEN = 3, 0.95, 200
HASHED = 256  # hashed word shapes and word ends of the text view
META_HASHED = 128
KEEP = 0.5

_TOKEN = re.compile(r"\S+")


def text_features(text: str | None) -> np.ndarray:
    """Dense statistics and hashed word shapes of one whole text."""
    text = text or ""
    code = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
    n = max(1, len(code))
    ascii_ = code[code < 128]
    table = np.bincount(ascii_, minlength=128)
    upper, lower, digit = table[65:91].sum(), table[97:123].sum(), table[48:58].sum()
    blank = table[32] + table[10] + table[9] + table[13]
    mark = table[33:127].sum() - upper - lower - digit
    stop = table[ord(".")] + table[ord(",")]
    words = _TOKEN.findall(text)
    m = max(1, len(words))
    lines = text.split("\n")
    dense = [
        np.log1p(len(code)) / 10, upper / n, lower / n, digit / n, blank / n, mark / n, (mark - stop) / n, stop / n, (n - len(ascii_)) / n,
        len(set(words)) / m, len(code) / m / 10, 1 - len(set(lines)) / len(lines), len(lines) / m, max(map(len, words), default=0) / 100, float(not words)]
    hashed = np.zeros(HASHED)
    shapes = [w[-3:].encode("utf-8", "surrogatepass") for w in words]
    if shapes:
        counted = np.bincount([zlib.crc32(s) % HASHED for s in shapes], minlength=HASHED)
        hashed = np.sqrt(counted / m)
    return np.concatenate([dense, hashed])


def meta_features(source: str | None, lang: str | None, n_chars: int | None) -> np.ndarray:
    out = np.zeros(META_HASHED + 2)
    for name, value in (("source", source), ("lang", lang)):
        out[zlib.crc32(f"{name}={value}".encode("utf-8", "surrogatepass")) % META_HASHED] = 1.0
    out[-2] = np.log1p(max(0, n_chars or 0)) / 10
    out[-1] = float(n_chars is None)
    return out


@dataclass
class Linear:
    mean: np.ndarray
    spread: np.ndarray
    weights: np.ndarray
    slope: float = 1.0
    shift: float = 0.0

    def margin(self, x: np.ndarray) -> np.ndarray:
        z = np.clip((x - self.mean) / self.spread, -8, 8)
        return z @ self.weights[:-1] + self.weights[-1]

    def probability(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.slope * self.margin(x) + self.shift, -30, 30)))


def _newton(x: np.ndarray, y: np.ndarray, ridge: float, rounds: int = 25) -> np.ndarray:
    """Ridge logistic regression; the last column of x is the constant."""
    w = np.zeros(x.shape[1])
    penalty = np.full(x.shape[1], ridge)
    penalty[-1] = 1e-6
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        h = (x * (p * (1 - p) + 1e-9)[:, None]).T @ x + np.diag(penalty)
        change = np.linalg.solve(h, x.T @ (y - p) - penalty * w)
        w += change * min(1.0, 5 / max(1e-12, np.abs(change).max()))
        if np.abs(change).max() < 1e-6:
            break
    return w


def _fit_view(x: np.ndarray, y: np.ndarray) -> Linear:
    mean, spread = x.mean(axis=0), x.std(axis=0)
    spread = np.where(spread > 1e-9, spread, 1.0)
    z = np.clip((x - mean) / spread, -8, 8)
    return Linear(mean, spread, _newton(np.c_[z, np.ones(len(z))], y, ridge=10.0))


def _calibrate(view: Linear, x: np.ndarray, y: np.ndarray) -> None:
    """Platt scaling with smoothed targets."""
    positive, negative = y.sum(), len(y) - y.sum()
    if not positive or not negative:
        return
    smooth = np.where(y == 1, (positive + 1) / (positive + 2), 1 / (negative + 2))
    view.slope, view.shift = _newton(np.c_[view.margin(x), np.ones(len(y))], smooth, ridge=1e-3).tolist()
    view.slope = max(0.0, view.slope)


@dataclass
class CoTrained:
    text: Linear | None
    meta: Linear | None
    prior: float

    def scores(self, text_x: np.ndarray, meta_x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(text, metadata, combined) probabilities of good quality."""
        if self.text is None or self.meta is None:
            flat = np.full(len(text_x), self.prior)
            return flat, flat, flat
        a, b = self.text.probability(text_x), self.meta.probability(meta_x)
        odds = np.log(a / (1 - a)) + np.log(b / (1 - b)) - np.log(self.prior / (1 - self.prior))
        return a, b, 1 / (1 + np.exp(-np.clip(odds, -30, 30)))


def co_train(views: tuple[np.ndarray, np.ndarray], y: np.ndarray, pool: tuple[np.ndarray, np.ndarray], rounds: int = ROUNDS) -> CoTrained:
    """``y``: labels 0 or 1 of the rows of ``views``; every fifth row only calibrates."""
    prior = float((y.sum() + 1) / (len(y) + 2)) if len(y) else 0.5
    if len(np.unique(y)) < 2:
        return CoTrained(None, None, prior)
    kept = np.arange(len(y)) % 5 != 0
    if len(np.unique(y[kept])) < 2:
        kept[:] = True
    seen = ~kept if len(np.unique(y[~kept])) == 2 else kept
    taught_x, taught_y = [v[kept] for v in views], [y[kept], y[kept]]
    free = [np.ones(len(pool[0]), bool), np.ones(len(pool[0]), bool)]
    models = []
    for turn in range(rounds + 1):
        models = [_fit_view(taught_x[v], taught_y[v]) for v in (0, 1)]
        for v in (0, 1):
            _calibrate(models[v], views[v][seen], y[seen])
        if turn == rounds or not len(pool[0]):
            break
        for v in (0, 1):  # view v teaches the other one
            other = 1 - v
            p = models[v].probability(pool[v])
            for label, sure in ((1.0, p), (0.0, 1 - p)):
                ready = np.flatnonzero(free[other] & (sure >= CONFIDENT))
                share = prior if label else 1 - prior
                chosen = ready[np.argsort(-sure[ready], kind="stable")][: max(1, round(GIVEN * share))]
                free[other][chosen] = False
                taught_x[other] = np.r_[taught_x[other], pool[other][chosen]]
                taught_y[other] = np.r_[taught_y[other], np.full(len(chosen), label)]
    return CoTrained(models[0], models[1], prior)


def _with_features(docs: DataFrame, model: object | None) -> DataFrame:
    """(doc_id, text_x, meta_x) without a model, (doc_id, text_score, meta_score, quality_score) with one."""
    rows = docs.select(
        F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), F.col("source").cast("string").alias("source"),
        F.col("lang").cast("string").alias("lang"), F.col("n_chars").cast("long").alias("n_chars"))
    shipped = docs.sparkSession.sparkContext.broadcast(model)

    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = shipped.value
        for batch in sliced(batches, "text"):
            values = batch.to_pydict()
            text_x = np.stack([text_features(t) for t in values["text"]])
            meta_x = np.stack([meta_features(*x) for x in zip(values["source"], values["lang"], values["n_chars"])])
            if own is None:
                yield pa.RecordBatch.from_pydict({"doc_id": batch.column(0), "text_x": pa.array(list(text_x)), "meta_x": pa.array(list(meta_x))})
            else:
                a, b, c = own.scores(text_x, meta_x)
                yield pa.RecordBatch.from_pydict({"doc_id": batch.column(0), "text_score": pa.array(a), "meta_score": pa.array(b), "quality_score": pa.array(c)})

    made = "text_x array<double>, meta_x array<double>" if model is None else "text_score double, meta_score double, quality_score double"
    return rows.mapInArrow(apply, f"doc_id long, {made}")


def _drawn(salt: str, share: float):
    return F.pmod(F.xxhash64(F.lit(salt), "doc_id"), F.lit(1 << 30)).cast("double") / float(1 << 30) < share


def learn(docs: DataFrame, labels: DataFrame, labelled: int = LABELLED, pool: int = POOL) -> CoTrained:
    """Co-trained model from about ``labelled`` labelled and ``pool`` unlabelled documents."""
    marked = labels.filter("doc_id is not null and quality is not null").groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.max("quality").cast("int").alias("quality"))
    n_labels = marked.count()
    chosen = marked.filter(_drawn("label", min(1.0, labelled / max(1, n_labels)))).limit(2 * labelled).collect()
    truth = {r["doc_id"]: float(r["quality"] > 0) for r in chosen}
    known = docs.filter("doc_id is not null")
    n_docs = known.count()
    names = local_table(docs.sparkSession, [(d,) for d in truth], "doc_id long")
    wanted = known.join(F.broadcast(names.withColumn("_in", F.lit(True))), "doc_id", "left")
    wanted = wanted.filter(F.col("_in").isNotNull() | _drawn("pool", min(1.0, pool / max(1, n_docs)))).limit(3 * (labelled + pool))
    rows = sorted(_with_features(wanted, None).collect(), key=lambda r: (r["doc_id"], r["text_x"]))
    width = (len(text_features("")), META_HASHED + 2)
    inside, outside = [r for r in rows if r["doc_id"] in truth], [r for r in rows if r["doc_id"] not in truth]

    def stack(part: list, v: int) -> np.ndarray:
        return np.asarray([r["meta_x" if v else "text_x"] for r in part], float).reshape(len(part), width[v])

    y = np.asarray([truth[r["doc_id"]] for r in inside])
    return co_train((stack(inside, 0), stack(inside, 1)), y, (stack(outside, 0), stack(outside, 1)))


def score_quality(docs: DataFrame, model: CoTrained) -> DataFrame:
    """(doc_id, text_score, meta_score, quality_score) of every document.

    A null or empty text has the features of the empty text, null metadata is a value of its own, a null doc_id stays null.
    Without labels of both classes every score is the prior (0.5 without any label). Repeated rows score alike; an empty
    table gives no rows.
    """
    return _with_features(docs, model)


def op5_cotrain_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    model = learn(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return score_quality(docs, model).withColumn("keep", F.col("quality_score") >= KEEP)
