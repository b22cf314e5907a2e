"""Operator 1: near-duplicate documents by DartMinHash.

A document is its set of five-word shingles. The signatures take weights; the operator gives all shingles the weight one,
so that the similarity that is searched is the one that decides. Darts fall on the plane of weight and time, a unit Poisson process seeded by the shingle alone, so documents that share a shingle share its darts. Each dart
that lands below a shingle's weight goes to one coordinate, and a coordinate keeps its earliest dart. Two documents agree
in a coordinate with the probability of their weighted Jaccard similarity. A document looks only as far in time as it
takes to fill its coordinates, so large documents cost a hash or two for each shingle, whatever the number of coordinates.

Bands of four coordinates propose candidates; the exact Jaccard similarity of the shingle sets decides.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from featsieve.functions import bounded_rows

from .common import sliced, stored, text_or_empty
from .near_sets import distinct_items, grouped_lists, mixed, shingle_items, similar_classes

WORDS, THRESHOLD = 5, 0.8
BANDS, ROWS = 20, 4
_CELL = 4.0  # area of the largest cell


def _edges(j: int) -> tuple[float, float]:
    """Time span of the j-th slab: 1/8 wide, then doubling up to the largest cell, then of that width."""
    if j == 0:
        return 0.0, 0.125
    if j <= 5:
        return 0.125 * 2 ** (j - 1), 0.125 * 2**j
    return _CELL * (j - 5), _CELL * (j - 4)


def _poisson_steps(area: float) -> np.ndarray:
    terms = [np.exp(-area)]
    while len(terms) < 40:
        terms.append(terms[-1] * area / len(terms))
    return np.cumsum(terms)


def dart_signatures(doc: np.ndarray, value: np.ndarray, weight: np.ndarray, n: int, k: int) -> np.ndarray:
    """Earliest dart per coordinate, (n, k) unsigned 64-bit; documents without items keep zeros.

    ``doc`` ascends; (doc, value) are distinct; weights are positive.
    """
    signature, filled = np.zeros((n, k), np.uint64), np.zeros((n, k), bool)
    total = np.bincount(doc, weights=weight, minlength=n)
    has = total > 0
    if not has.any():
        return signature
    # unit cells along the weight axis; the last one of a shingle may be a part
    tall = np.ceil(weight - 1e-12).astype(np.int64)
    level = np.arange(int(tall.sum())) - np.repeat(np.cumsum(tall) - tall, tall)
    cell_doc, height = np.repeat(doc, tall), np.minimum(1.0, np.repeat(weight, tall) - level)
    cell = mixed(np.repeat(value, tall) + level.astype(np.uint64) * np.uint64(0xD1342543DE82EF95))
    horizon = np.where(has, (k * np.log(k) + 2 * k) / np.where(has, total, 1.0), 0.0)
    begin = np.zeros(n, np.int64)
    while True:
        end = begin.copy()
        last = int(np.maximum(0, 4 + np.ceil(horizon.max() / _CELL)).item()) + 2
        for j in range(last):
            end[has & (_edges(j)[0] < horizon)] = np.maximum(end[has & (_edges(j)[0] < horizon)], j + 1)
        slots, times, names = [], [], []
        for j in range(int(begin[has].min()), int(end.max())):
            active_doc = (begin <= j) & (j < end)
            active = np.flatnonzero(active_doc[cell_doc])
            if not len(active):
                continue
            low, high = _edges(j)
            slab = mixed(cell[active] + np.uint64((j + 1) * 0x8CB92BA72F3D8DD7 & 0xFFFFFFFFFFFFFFFF))
            count = np.searchsorted(_poisson_steps(high - low), (slab >> np.uint64(11)).astype(np.float64) / 2.0**53, side="right")
            hit = np.flatnonzero(count)
            count = count[hit]
            number = np.arange(int(count.sum())) - np.repeat(np.cumsum(count) - count, count)
            owner = np.repeat(active[hit], count)
            dart = mixed(np.repeat(slab[hit], count) + (number + 1).astype(np.uint64) * np.uint64(0xA24BAED4963EE407))
            place = mixed(dart + np.uint64(0x9FB21C651E98DF25))
            kept = (place >> np.uint64(32)).astype(np.float64) / 2.0**32 < height[owner]
            owner, dart, place = owner[kept], dart[kept], place[kept]
            slots.append(cell_doc[owner] * k + ((place & np.uint64(0xFFFFFFFF)) % np.uint64(k)).astype(np.int64))
            times.append(low + (dart >> np.uint64(11)).astype(np.float64) / 2.0**53 * (high - low))
            names.append(dart)
        if slots:
            slot, time, name = np.concatenate(slots), np.concatenate(times), np.concatenate(names)
            order = np.lexsort((time, slot))
            slot, name = slot[order], name[order]
            first = np.ones(len(slot), bool)
            first[1:] = slot[1:] != slot[:-1]
            slot, name = slot[first], name[first]
            free = ~filled.ravel()[slot]  # earlier slabs win
            signature.ravel()[slot[free]] = name[free]
            filled.ravel()[slot[free]] = True
        short = has & ~filled.all(axis=1)
        if not short.any():
            return signature
        begin = end
        horizon = np.where(short, horizon * 2 + 1e-9, 0.0)


def band_hashes(signature: np.ndarray, bands: int, rows: int) -> np.ndarray:
    out = np.zeros((len(signature), bands), np.uint64)
    for r in range(rows):
        out = mixed(out * np.uint64(0x9E3779B97F4A7C15) + signature[:, r : bands * rows : rows])
    return mixed(out + np.arange(bands, dtype=np.uint64))


def _set_keys(doc: np.ndarray, value: np.ndarray, n: int) -> np.ndarray:
    """128-bit keys of the shingle sets, (2, n)."""
    keys = np.zeros((2, n), np.uint64)
    for row, salt in enumerate((0x5851F42D4C957F2D, 0x14057B7EF767814F)):
        np.add.at(keys[row], doc, mixed(value + np.uint64(salt)))
    return keys


def _sketches(docs: DataFrame, words: int, bands: int, rows: int) -> DataFrame:
    """(doc_id, k1, k2, bands): a 128-bit key of the shingle set and the band hashes; no bands without words.

    Further columns of ``docs`` after doc_id and text are longs and are passed on.
    """
    further = docs.columns[2:]

    def sketch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import hashlib

        for batch in sliced(batches, "text"):
            texts = batch.column(1).to_pylist()
            n = len(texts)
            doc, value, _ = distinct_items(*shingle_items(texts, words))
            signature = dart_signatures(doc, value, np.ones(len(doc)), n, bands * rows)
            keys = _set_keys(doc, value, n)
            wordless = np.setdiff1d(np.arange(n), doc)
            for i in wordless.tolist():  # compared by their text
                keys[:, i] = np.frombuffer(hashlib.md5(texts[i].encode("utf-8", "surrogatepass")).digest(), np.uint64)
            hashes = band_hashes(signature, bands, rows)
            worded = np.ones(n, bool)
            worded[wordless] = False
            owner = np.repeat(np.flatnonzero(worded), bands)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(keys[0].view(np.int64)), pa.array(keys[1].view(np.int64)), grouped_lists(owner, hashes[worded].ravel().view(np.int64), n, pa.int64()),
                 *batch.columns[2:]],
                names=["doc_id", "k1", "k2", "bands", *further])

    return docs.mapInArrow(sketch, "doc_id long, k1 long, k2 long, bands array<long>" + "".join(f", {c} long" for c in further))


def shingle_sets(docs: DataFrame, words: int = WORDS) -> DataFrame:
    """(id, items): the distinct shingles of each text."""

    def items(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in sliced(batches, "text"):
            doc, value, _ = distinct_items(*shingle_items(batch.column(1).to_pylist(), words))
            yield pa.RecordBatch.from_arrays([batch.column(0), grouped_lists(doc, value.view(np.int64), batch.num_rows, pa.int64())], names=["id", "items"])

    return docs.mapInArrow(items, "id long, items array<long>")


def _keyed_sets(texts: DataFrame, words: int) -> DataFrame:
    """(k1, k2, items): the distinct shingles of each text under the key of their set."""

    def items(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in sliced(batches, "text"):
            n = batch.num_rows
            doc, value, _ = distinct_items(*shingle_items(batch.column(0).to_pylist(), words))
            keys = _set_keys(doc, value, n).view(np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(keys[0]), pa.array(keys[1]), grouped_lists(doc, value.view(np.int64), n, pa.int64())], names=["k1", "k2", "items"])

    return texts.select("text").mapInArrow(items, "k1 long, k2 long, items array<long>")


def _distinct_sets(sketches: DataFrame) -> DataFrame:
    """(k1, k2, first, id) of the sets: their least doc_id, and a long that no two of them share."""
    firsts = stored(sketches.groupBy("k1", "k2").agg(F.min("doc_id").alias("first")), "firsts")
    salt = 0
    while True:
        named = firsts.withColumn("id", F.xxhash64("k1", "k2", F.lit(salt)))
        if not named.groupBy("id").count().filter("count > 1").limit(1).count():
            return named
        salt += 1


TEXT_KEY = ("t1", "t2")


def text_keys(text: Column) -> list[Column]:
    """A 128-bit key of a text."""
    return [F.xxhash64(text).alias(TEXT_KEY[0]), F.xxhash64(F.lit(1), text).alias(TEXT_KEY[1])]


def near_classes(docs: DataFrame, threshold: float = THRESHOLD, words: int = WORDS, bands: int = BANDS, rows: int = ROWS) -> DataFrame:
    """(doc_id, t1, t2, class_key, class_id) of every row with a doc_id: the keys of its text and class, the class's least doc_id.

    Sets are named by their own keys, so rows of one doc_id with several texts are as many documents; two classes can
    have the same least doc_id, but not the same ``class_key``.
    """
    known = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_or_empty().alias("text")).filter("doc_id is not null")
    sketches = stored(_sketches(known.select("doc_id", "text", *text_keys(F.col("text"))), words, bands, rows), "darts")
    sets = _distinct_sets(sketches)
    banded = sketches.filter(F.size("bands") > 0).select("k1", "k2", "doc_id", "bands").join(sets.withColumnRenamed("first", "doc_id"), ["k1", "k2", "doc_id"])
    banded = banded.groupBy("id").agg(F.min("bands").alias("bands"))

    def sets_of(ids: DataFrame) -> DataFrame:
        named = sets.join(ids, "id", "left_semi")
        wanted, small = bounded_rows(named.select(F.col("first").alias("doc_id")).distinct())
        texts = known.join(F.broadcast(wanted) if small else wanted, "doc_id", "left_semi")
        # other texts of the documents go by the join with the wanted sets
        return _keyed_sets(texts, words).join(named.select("k1", "k2", "id"), ["k1", "k2"]).groupBy("id").agg(F.min("items").alias("items"))

    labels = similar_classes(banded, sets_of, threshold)
    linked = sets.join(labels, "id").select("id", "label", "first")
    least = linked.groupBy("label").agg(F.min("first").alias("least"))
    joined = linked.join(least, "label").select("id", "label", "least")
    classes = sets.join(joined, "id", "left").select("k1", "k2", F.coalesce("label", "id").alias("class_key"), F.coalesce("least", "first").alias("class_id"))
    return sketches.join(classes, ["k1", "k2"]).select("doc_id", *TEXT_KEY, "class_key", "class_id")


def near_duplicates(docs: DataFrame, threshold: float = THRESHOLD, words: int = WORDS, bands: int = BANDS, rows: int = ROWS) -> DataFrame:
    """(doc_id, class_id) of every row: the least doc_id among the documents linked to it.

    Documents with one shingle set are one class from the start, whatever their number; links join different sets of a
    similarity of ``threshold`` or more. Texts without words are alike only if equal. A null text is empty; a null doc_id
    takes no part and has a null class; repeated rows share their class, rows of one doc_id with several texts each have
    that of their text; an empty table gives no rows.
    """
    done = near_classes(docs, threshold, words, bands, rows).select("doc_id", "class_id")
    nameless = docs.select(F.col("doc_id").cast("long").alias("doc_id")).filter("doc_id is null")
    return done.union(nameless.select("doc_id", F.lit(None).cast("long").alias("class_id")))


def op1_dart_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(spark.read.parquet(f"{sf_dir}/documents.parquet"))
