"""Operator 4: language identification by a linear-chain conditional random field over words.

A word's state is its language. Emission scores sum hashed affix and character n-gram weights and lexicon weights,
transitions are learned, and forward-backward gives each word's marginals, so text that switches languages keeps a
label per word. A document's language is the one with the largest mean marginal over its words.

Fitted on a bounded sample of labelled rows: about ``sample_docs`` documents per language (drawn by a hash) of at most
``sample_chars`` characters. Their sentences-long runs are dealt into chains in random order, so chains switch languages
and transitions between languages are seen. Everything else reads all rows and whole texts.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from ..functions import local_table
from .common import sliced
from .near_sets import mixed

SAMPLE_DOCS, SAMPLE_CHARS, MAX_LANGS = 250, 20_000, 1_000
BUCKETS = 1 << 16
RUN_WORDS, CHAIN_WORDS = 15, 90  # training: words of a run, words of a chain
SCORED_CHAIN = 128  # prediction: words of a chain; a longer text is several chains
ROUNDS, RATE, DECAY = 5, 0.25, 1e-5
LEXICON_COUNT, LEXICON_SHARE = 3, 0.9
MIN_SCORE = 0.4  # pipeline: documents below are rejected
UNDETERMINED = "und"

_WORDS = re.compile(r"[^\W\d_]+")


@dataclass
class Model:
    langs: list[str]
    emission: np.ndarray  # (BUCKETS + languages, languages); the last rows belong to the lexicon of a language
    transition: np.ndarray
    start: np.ndarray
    lexicon: dict[str, int]


def held_out() -> Column:
    return F.coalesce(F.pmod(F.crc32(F.col("doc_id").cast("string").cast("binary")), F.lit(3)) == 1, F.lit(False))


def word_features(words: list[str], lexicon: dict[str, int]) -> tuple[np.ndarray, np.ndarray]:
    """(word number, feature) for all words, ordered by word: affixes of 1 to 4, inner n-grams of 1 to 3, lexicon."""
    lengths = np.asarray([len(w) for w in words], np.int64)
    owners, features = [], []
    known = [(i, BUCKETS + lexicon[w]) for i, w in enumerate(words) if w in lexicon]
    if known:
        owners.append(np.asarray([i for i, _ in known]))
        features.append(np.asarray([f for _, f in known]))
    class_of = np.ceil(np.log2(np.maximum(lengths, 8))).astype(int)
    for c in np.unique(class_of):
        rows = np.flatnonzero(class_of == c)
        width = 1 << int(c)
        codes = np.asarray([words[i] for i in rows], dtype=f"<U{width}").view(np.uint32).reshape(len(rows), width).astype(np.uint64)
        n = lengths[rows]
        gram = np.zeros_like(codes)
        for size in range(1, 5):
            span = width - size + 1
            gram = mixed(gram[:, :span] * np.uint64(0x9E3779B97F4A7C15) + codes[:, size - 1 : size - 1 + span])
            inside = np.arange(span)[None, :] + size <= n[:, None]
            if size < 4:
                r, at = np.nonzero(inside)
                owners.append(rows[r])
                features.append((gram[r, at] % np.uint64(BUCKETS)).astype(np.int64))
            fits = np.flatnonzero(n >= size)
            for salt, at in ((1, np.zeros(len(fits), np.int64)), (2, n[fits] - size)):
                owners.append(rows[fits])
                features.append((mixed(gram[fits, at] + np.uint64(salt)) % np.uint64(BUCKETS)).astype(np.int64))
    owner, feature = np.concatenate(owners), np.concatenate(features)
    order = np.argsort(owner, kind="stable")
    return owner[order], feature[order]


def emissions(model: Model, words: list[str]) -> np.ndarray:
    owner, feature = word_features(words, model.lexicon)
    first = np.flatnonzero(np.diff(owner, prepend=-1))
    return np.add.reduceat(model.emission[feature], first, axis=0)


def marginals(score: np.ndarray, lengths: np.ndarray, transition: np.ndarray, start: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Forward-backward over chains laid end to end: word marginals, summed pair marginals, first-word marginals.

    Chains run side by side, longest first, so a step is one product for all chains that are still going.
    """
    n_states = score.shape[1]
    e = np.exp(score - score.max(axis=1, keepdims=True))
    a = np.exp(transition - transition.max())
    order = np.argsort(-lengths, kind="stable")
    first, long_ = (np.cumsum(lengths) - lengths)[order], lengths[order]
    steps = int(long_[0]) if len(long_) else 0
    going = [int(np.searchsorted(-long_, -t, side="left")) for t in range(steps)]  # chains with more than t words
    forward, backward = np.zeros_like(e), np.ones_like(e)
    alpha = np.exp(start - start.max())[None, :].repeat(len(long_), axis=0)
    for t in range(steps):
        at = first[: going[t]] + t
        alpha = (alpha[: going[t]] if t == 0 else alpha[: going[t]] @ a) * e[at]
        alpha /= alpha.sum(axis=1, keepdims=True)
        forward[at] = alpha
    pairs = np.zeros((n_states, n_states))
    for t in range(steps - 2, -1, -1):
        here, ahead = first[: going[t + 1]] + t, first[: going[t + 1]] + t + 1
        message = e[ahead] * backward[ahead]
        message /= message.sum(axis=1, keepdims=True)
        back = message @ a.T
        norm = (forward[here] * back).sum(axis=1, keepdims=True)
        pairs += a * ((forward[here] / norm).T @ message)
        backward[here] = back / back.sum(axis=1, keepdims=True)
    both = forward * backward
    both /= both.sum(axis=1, keepdims=True)
    return both, pairs, both[first[: len(long_)]].sum(axis=0) if len(long_) else np.zeros(n_states)


def fit(texts: list[str], langs: list[str], rounds: int = ROUNDS, seed: int = 7) -> Model:
    """Conditional log-likelihood by adaptive gradient steps on batches of chains."""
    names = sorted(set(langs))
    k, code = len(names), {x: i for i, x in enumerate(sorted(set(langs)))}
    rng = np.random.default_rng(seed)
    runs: list[tuple[list[str], int]] = []
    counts: Counter = Counter()
    for text, lang in zip(texts, langs):
        words = _WORDS.findall(text.lower())
        counts.update((w, code[lang]) for w in words)
        runs += [(words[i : i + RUN_WORDS], code[lang]) for i in range(0, len(words), RUN_WORDS)]
    totals: Counter = Counter()
    for (w, _), n in counts.items():
        totals[w] += n
    lexicon = {w: c for (w, c), n in counts.items() if n >= LEXICON_COUNT and n >= LEXICON_SHARE * totals[w]}
    model = Model(names, np.zeros((BUCKETS + k, k)), np.zeros((k, k)), np.zeros(k), lexicon)
    if k < 2 or not runs:
        return model
    vocabulary, index = pd.factorize(np.asarray([w for r, _ in runs for w in r], dtype=object))[::-1]
    words = vocabulary.tolist()
    owner, feature = word_features(words, lexicon)
    n_features = np.bincount(owner, minlength=len(words))
    begin = np.cumsum(n_features) - n_features
    run_sizes = np.asarray([len(r) for r, _ in runs])
    run_begin, run_lang = np.cumsum(run_sizes) - run_sizes, np.asarray([c for _, c in runs])
    squares = [np.full_like(p, 1e-6) for p in (model.emission, model.transition, model.start)]

    def step(which: int, values: np.ndarray, gradient: np.ndarray) -> None:
        squares[which] += gradient**2
        values += RATE * gradient / np.sqrt(squares[which]) - RATE * DECAY * values

    per_chain = CHAIN_WORDS // RUN_WORDS
    for _ in range(rounds):
        dealt = rng.permutation(len(runs))
        for i in range(0, len(dealt), per_chain * 256):
            batch = dealt[i : i + per_chain * 256]
            chain_of = np.arange(len(batch)) // per_chain
            at = np.concatenate([np.arange(run_begin[r], run_begin[r] + run_sizes[r]) for r in batch])
            label = np.repeat(run_lang[batch], run_sizes[batch])
            chain = np.repeat(chain_of, run_sizes[batch])
            lengths = np.bincount(chain)
            used, local = np.unique(index[at], return_inverse=True)
            pick = np.repeat(begin[used] - (np.cumsum(n_features[used]) - n_features[used]), n_features[used]) + np.arange(int(n_features[used].sum()))
            weights = model.emission[feature[pick]]
            score = np.add.reduceat(weights, np.cumsum(n_features[used]) - n_features[used], axis=0)[local]
            p, pairs, firsts = marginals(score, lengths, model.transition, model.start)
            gap = -p
            gap[np.arange(len(label)), label] += 1
            per_word = np.stack([np.bincount(local, weights=gap[:, c], minlength=len(used)) for c in range(k)], axis=1)
            spread = np.repeat(per_word, n_features[used], axis=0)
            touched, slot = np.unique(feature[pick], return_inverse=True)
            g = np.stack([np.bincount(slot, weights=spread[:, c], minlength=len(touched)) for c in range(k)], axis=1) / len(label) * 100
            squares[0][touched] += g**2
            model.emission[touched] += RATE * g / np.sqrt(squares[0][touched]) - RATE * DECAY * model.emission[touched]
            head = np.cumsum(lengths) - lengths
            inner = np.ones(len(label), bool)
            inner[head] = False
            follow = np.flatnonzero(inner)
            observed = np.zeros((k, k))
            np.add.at(observed, (label[follow - 1], label[follow]), 1)
            step(1, model.transition, (observed - pairs) / len(label) * 100)
            step(2, model.start, (np.bincount(label[head], minlength=k) - firsts) / len(lengths))
    return model


def sample(docs: DataFrame, per_lang: int = SAMPLE_DOCS, max_chars: int = SAMPLE_CHARS, max_langs: int = MAX_LANGS) -> tuple[list[str], list[str]]:
    """Texts and labels of about ``per_lang`` training rows of each language (never held-out ones), in a fixed order.

    Of a text longer than ``max_chars`` a window of that length at a hashed place is taken. A row is drawn by its doc_id and
    text, so rows of one id are drawn each for itself. Of more than ``max_langs`` labels the most frequent are learned.
    """
    known = docs.filter(~held_out() & F.col("doc_id").isNotNull() & F.col("lang").isNotNull() & F.col("text").isNotNull())
    known = known.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("lang").cast("string").alias("lang"), F.col("text").cast("string").alias("text"))
    sizes = known.groupBy("lang").count().orderBy(F.desc("count"), "lang").limit(max_langs).collect()
    if not sizes:
        return [], []
    shares = local_table(docs.sparkSession, [(r["lang"], min(1.0, per_lang / r["count"])) for r in sizes], "lang string, share double")
    place = F.xxhash64(F.lit("sample"), "doc_id", "text")
    drawn = F.pmod(place, F.lit(1 << 30)).cast("double") / float(1 << 30)
    first = (F.pmod(F.shiftright(place, 30), F.greatest(F.lit(1), F.length("text") - max_chars + 1)) + 1).cast("int")
    rows = known.join(F.broadcast(shares), "lang").withColumn("_drawn", drawn).filter(F.col("_drawn") < F.col("share"))
    rows = rows.select("doc_id", "lang", F.substring(F.col("text"), first, F.lit(max_chars)).alias("text"), "_drawn")
    rows = rows.orderBy("_drawn", "doc_id", "text", "lang").limit(2 * per_lang * len(sizes)).collect()
    rows.sort(key=lambda r: (r["doc_id"], r["text"], r["lang"]))
    return [r["text"] for r in rows], [r["lang"] for r in rows]


def label_texts(model: Model, texts: list[str | None], chain_words: int = SCORED_CHAIN) -> list[tuple[str, float]]:
    """(language, mean marginal) of each text."""
    found = [_WORDS.findall((t or "").lower()) for t in texts]
    found = [f if any(c.isalpha() for w in f for c in w) else [] for f in found]
    counts = np.asarray([len(f) for f in found], np.int64)
    out: list[tuple[str, float]] = [(UNDETERMINED, 0.0)] * len(texts)
    if not model.langs or not counts.sum():
        return out
    index, vocabulary = pd.factorize(np.asarray([w for f in found for w in f], dtype=object))
    score = emissions(model, vocabulary.tolist())[index]
    pieces = -(-counts // chain_words)
    lengths = np.full(int(pieces.sum()), chain_words, np.int64)
    ends = np.cumsum(pieces)[counts > 0] - 1
    lengths[ends] = counts[counts > 0] - (pieces[counts > 0] - 1) * chain_words
    p, _, _ = marginals(score, lengths, model.transition, model.start)
    worded = np.flatnonzero(counts)
    mean = np.add.reduceat(p, (np.cumsum(counts) - counts)[worded], axis=0) / counts[worded, None]
    best = mean.argmax(axis=1)
    for i, d in enumerate(worded.tolist()):
        out[d] = (model.langs[int(best[i])], float(min(1.0, max(0.0, mean[i, best[i]]))))
    return out


def word_languages(model: Model, text: str) -> list[tuple[str, str]]:
    """Each word of one text with its most likely language."""
    words = _WORDS.findall(text.lower())
    if not words or not model.langs:
        return []
    p, _, _ = marginals(emissions(model, words), np.asarray([len(words)]), model.transition, model.start)
    return [(w, model.langs[int(i)]) for w, i in zip(words, p.argmax(axis=1))]


def predict_languages(docs: DataFrame, model: Model, carried: list[str] | None = None) -> DataFrame:
    """Columns ``carried`` of ``docs`` (all by default) with lang_pred and score, which replace columns of these names.

    Null texts and texts without letters are ``und`` with score 0, as is every text when nothing could be learned (no
    labelled rows); with one learned language all other texts get it with score 1. Equal scores go to the first language in
    sorted order. Repeated rows are labelled alike; an empty table gives no rows.
    """
    kept = [c for c in (docs.columns if carried is None else carried) if c not in ("lang_pred", "score")]
    read = kept if "text" in kept else [*kept, "text"]
    rows = docs.select(*[F.col("text").cast("string").alias("text") if c == "text" else F.col(f"`{c}`") for c in read])
    shipped = docs.sparkSession.sparkContext.broadcast(model)
    slice_bytes = max(50_000, 4_000_000 // max(4, len(model.langs)))

    def predict(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = shipped.value
        for batch in sliced(batches, "text", slice_bytes):
            labels = label_texts(own, batch.column(batch.schema.get_field_index("text")).to_pylist())
            new = [pa.array([x for x, _ in labels], pa.string()), pa.array([s for _, s in labels], pa.float64())]
            yield pa.RecordBatch.from_arrays([batch.column(i) for i in range(len(kept))] + new, names=[*kept, "lang_pred", "score"])

    return rows.mapInArrow(predict, rows.select(*[f"`{c}`" for c in kept]).schema.add("lang_pred", "string").add("score", "double"))


def learn(docs: DataFrame) -> Model:
    return fit(*sample(docs))


def op4_crf_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    model = learn(docs)
    return predict_languages(docs, model, ["doc_id"]).select("doc_id", held_out().alias("held_out"), "lang_pred", "score")
