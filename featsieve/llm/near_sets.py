"""Classes of similar sets from banded signatures: exact verification, components, no pair list of a whole group.

1. A bucket is all ids with one band hash. Its centre is the member whose buckets are largest in sum (the least edited
   copy of a group); every member is verified against the centre, so a group of n copies costs n checks, not n * n.
2. Buckets that still hold several components are searched whole, in square blocks of bounded size: short signatures
   rule out pairs far below the threshold, the others are compared exactly inside the task, and only pairs of components
   with a link leave it. No link between two members of a bucket is lost but by the chance that the signature estimate
   is four standard deviations low.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from .common import stored

BLOCK = 512
COORDINATES = 128
SLACK = 4 * (0.8 * 0.2 / COORDINATES) ** 0.5
SHARD_ITEMS = 2_000_000  # set members a task takes at once, 8 bytes each


def mixed(x: np.ndarray) -> np.ndarray:
    """Bijective scrambling of 64-bit integers (the published splitmix64 finaliser)."""
    x = x.astype(np.uint64, copy=True)
    x ^= x >> np.uint64(30)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


def shingle_items(texts: list[str | None], words: int = 5) -> tuple[np.ndarray, np.ndarray]:
    """(text number, 64-bit shingle) of every run of ``words`` lower-case words; a shorter text is one shingle of all its words."""
    import re

    find = re.compile(r"\w+").findall
    found = [find((t or "").lower()) for t in texts]
    counts = np.asarray([len(f) for f in found], np.int64)
    if not counts.sum():
        return np.zeros(0, np.int64), np.zeros(0, np.uint64)
    codes, names = pd.factorize(np.asarray([w for f in found for w in f], dtype=object))
    hashed = pd.util.hash_array(names, categorize=False)[codes]
    room = counts + words - 1  # zeros after each text stand for missing words
    flat = np.zeros(int(room.sum()), np.uint64)
    first = np.concatenate([[0], np.cumsum(room)[:-1]])
    own = np.repeat(first - np.concatenate([[0], np.cumsum(counts)[:-1]]), counts) + np.arange(len(hashed))
    flat[own] = hashed
    n = np.where(counts > 0, np.maximum(counts - words + 1, 1), 0)
    doc = np.repeat(np.arange(len(texts)), n)
    start = np.repeat(first - np.concatenate([[0], np.cumsum(n)[:-1]]), n) + np.arange(int(n.sum()))
    value = np.zeros(len(start), np.uint64)
    for i in range(words):
        value = mixed(value * np.uint64(0x9E3779B97F4A7C15) + flat[start + i] + np.uint64(i + 1))
    return doc, value


def distinct_items(doc: np.ndarray, value: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct (doc, value) in order, and how often each occurs."""
    order = np.lexsort((value, doc))
    doc, value = doc[order], value[order]
    new = np.ones(len(doc), bool)
    new[1:] = (doc[1:] != doc[:-1]) | (value[1:] != value[:-1])
    at = np.flatnonzero(new)
    return doc[at], value[at], np.diff(np.append(at, len(doc)))


def grouped_lists(doc: np.ndarray, values: np.ndarray, n: int, kind: pa.DataType) -> pa.ListArray:
    """Values as one Arrow list per document (``doc`` ascending)."""
    offsets = np.concatenate([[0], np.cumsum(np.bincount(doc, minlength=n))]).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(values, kind))


def components(links: DataFrame) -> DataFrame:
    """(id, label) of every id on a link (a, b); the label is the smallest id of its component.

    Each round every id points to the first of itself and its neighbours by a scrambled order (so a chain in the order of ids
    is no long way), pointers are followed, and the links are carried to what their ends point at. Links within one
    such id and repeated ones vanish, so a round has a fraction of the links of the one before. Rounds
    are stored, so a lost executor never sets the iteration back.
    """
    # xxhash64 of one long gives each long once, so the scrambled ids stand for the ids
    ends = stored(links.select("a", "b").distinct(), "ends")
    edges = ends.select(F.xxhash64("a").alias("a"), F.xxhash64("b").alias("b"))
    rounds: list[DataFrame] = []
    while True:
        both = edges.union(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        step = both.groupBy("a").agg(F.min("b").alias("m")).select(F.col("a").alias("id"), F.least("a", "m").alias("to"))
        rounds.append(stored(_followed(step, step, "to"), "pointers"))
        to = [rounds[-1].select(F.col("id").alias(c), F.col("to").alias(f"_{c}")) for c in "ab"]
        carried = edges.join(to[0], "a").join(to[1], "b").filter("_a <> _b").select(F.least("_a", "_b").alias("a"), F.greatest("_a", "_b").alias("b"))
        edges = stored(carried.distinct(), "edges")
        if not edges.limit(1).count():
            break
    roots = rounds.pop()
    while rounds:
        roots = _followed(rounds.pop(), roots, "to")
    ids = ends.select("a").union(ends.select("b")).distinct().select(F.col("a").alias("own"), F.xxhash64("a").alias("id"))
    named = stored(ids.join(roots, "id").select(F.col("own").alias("id"), "to"), "roots")
    least = named.groupBy("to").agg(F.min("id").alias("label"))
    return stored(named.join(least, "to").select("id", "label"), "labels")


def _followed(first: DataFrame, then: DataFrame, column: str) -> DataFrame:
    """(id, ``column``) of ``first``, carried on by ``then`` where that goes on."""
    on = then.select(F.col("id").alias("of"), F.col(column).alias("further"))
    return first.join(on, F.col(column) == F.col("of"), "left").select("id", F.coalesce("further", column).alias(column))


def verified(pairs: DataFrame, sets: DataFrame, threshold: float) -> DataFrame:
    """Pairs (a, b) whose item sets have an exact Jaccard similarity of ``threshold`` at least.

    The evenly spread side b is joined first: the shuffle by a is then large enough for a hot centre to be split.
    """
    left = sets.select(F.col("id").alias("a"), F.col("items").alias("_a"))
    right = sets.select(F.col("id").alias("b"), F.col("items").alias("_b"))
    common = F.size(F.array_intersect("_a", "_b"))
    # ten digits: 0.8 itself is a quotient that must pass
    near = F.round(common / (F.size("_a") + F.size("_b") - common), 10) >= F.lit(threshold)
    return pairs.join(right, "b").join(left, "a").filter(near).select("a", "b")


def _signatures(sets: DataFrame) -> DataFrame:
    """(id, items, sig): 128 MinHash coordinates of the items, 16 bits each."""

    def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seeds = mixed(np.arange(1, COORDINATES + 1, dtype=np.uint64))
        for batch in batches:
            out = []
            for items in batch.column(1):
                own = np.asarray(items.values.to_numpy(zero_copy_only=False)).astype(np.int64).view(np.uint64)
                least = np.full(COORDINATES, np.uint64(0xFFFFFFFFFFFFFFFF))
                for i in range(0, len(own), 4096):
                    least = np.minimum(least, mixed(own[i : i + 4096, None] ^ seeds[None, :]).min(axis=0))
                out.append((least & np.uint64(0xFFFF)).astype("<u2").tobytes())
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(out, pa.binary())], names=["id", "items", "sig"])

    return sets.select("id", "items").mapInArrow(sign, "id long, items array<long>, sig binary")


def _jaccard(items: np.ndarray, others: list[np.ndarray]) -> np.ndarray:
    """Similarity of one sorted set to each of the others."""
    sizes = np.asarray([len(o) for o in others])
    flat = np.concatenate(others)
    at = np.minimum(np.searchsorted(items, flat), len(items) - 1)
    common = np.add.reduceat((items[at] == flat).astype(np.int64), np.cumsum(sizes) - sizes)
    return common / (len(items) + sizes - common)


def _joining_links(threshold: float):
    """Pairs of labels with similar members in each block, as many as it takes to join them.

    Signatures rule out pairs far below the threshold, the others are compared exactly, in the task. A pair is looked at in
    the first band both share, so it is compared once whatever the number of shared buckets.
    """

    def search(_: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        found: list[tuple[int, int]] = []
        rows = rows.sort_values(["band", "bucket", "low", "high"], ignore_index=True)
        every = [rows[c].to_numpy() for c in ("band", "bucket", "low", "high")]
        new = np.flatnonzero(np.any([c[1:] != c[:-1] for c in every], axis=0)) + 1
        all_ids, all_labels, all_chunks, all_items = (rows[c].to_numpy() for c in ("id", "label", "chunk", "items"))
        all_sig = np.frombuffer(b"".join(rows["sig"]), "<u2").reshape(len(rows), -1)
        all_bands = np.stack(rows["bands"].to_numpy())
        for first, stop in zip([0, *new.tolist()], [*new.tolist(), len(rows)]):
            ids, labels, chunk = all_ids[first:stop], all_labels[first:stop].copy(), all_chunks[first:stop]
            sig, bands = all_sig[first:stop], all_bands[first:stop]
            items = [np.sort(x) for x in all_items[first:stop]]
            band, low, high = (int(every[i][first]) for i in (0, 2, 3))
            left, right = np.flatnonzero(chunk == low), np.flatnonzero(chunk == high)
            for i in left:
                others = right[(labels[right] != labels[i]) & ((ids[right] > ids[i]) if low == high else (ids[right] != ids[i]))]
                if len(others):
                    others = others[(sig[others] == sig[i]).mean(axis=1) >= threshold - SLACK]
                if band and len(others):
                    others = others[~(bands[others, :band] == bands[i, :band]).any(axis=1)]
                if not len(others):
                    continue
                near = others[np.round(_jaccard(items[i], [items[j] for j in others]), 10) >= threshold]
                for label in np.unique(labels[near]):
                    found.append((int(labels[i]), int(label)))
                    labels[labels == label] = labels[i]
        return pd.DataFrame(found, columns=["a", "b"], dtype="int64")

    return search


def similar_classes(banded: DataFrame, sets_of: Callable[[DataFrame], DataFrame], threshold: float, block: int = BLOCK) -> DataFrame:
    """(id, label) of every id that is linked to another one.

    ``banded`` has distinct long ids with ``bands``, an array of band hashes; ``sets_of`` gives (id, items) for
    the ids of a DataFrame, where items is an array of distinct longs. Two ids are linked if they share a band and
    their sets are similar to ``threshold``; labels are the least ids of the components.
    """
    spread = banded.select("id", F.posexplode("bands").alias("band", "bucket"))
    sizes = spread.groupBy("band", "bucket").agg(F.count(F.lit(1)).alias("n")).filter("n > 1")
    shared = stored(spread.join(sizes, ["band", "bucket"]), "buckets")
    sets = stored(sets_of(shared.select("id").distinct()), "sets")

    weight = shared.groupBy("id").agg(F.sum("n").alias("weight"))
    centre: Column = F.max(F.struct("weight", (-F.col("id")).alias("minus")))
    centres = shared.join(weight, "id").groupBy("band", "bucket").agg(centre.alias("c")).select("band", "bucket", (-F.col("c.minus")).alias("c"))
    stars = shared.join(centres, ["band", "bucket"]).filter("id <> c").select(F.col("c").alias("a"), F.col("id").alias("b")).distinct()
    tested = stored(stars, "stars")
    links = stored(verified(tested, sets, threshold), "links")
    labels = components(links)

    labelled = shared.filter("n > 2").join(labels, "id", "left").withColumn("label", F.coalesce("label", "id"))
    open_ = labelled.groupBy("band", "bucket").agg(F.min("label").alias("_l"), F.max("label").alias("_m")).filter("_l <> _m").select("band", "bucket")
    rest = stored(labelled.join(open_, ["band", "bucket"], "left_semi"), "open")
    if not rest.limit(1).count():
        return labels
    signed = _signatures(sets.join(rest.select("id").distinct(), "id", "left_semi")).join(banded.select("id", "bands"), "id")
    chunks = F.ceil(F.col("n") / block).cast("int")
    cells = rest.withColumn("chunk", F.pmod(F.xxhash64("id"), chunks).cast("int")).withColumn("_other", F.explode(F.sequence(F.lit(0), chunks - 1)))
    cells = cells.withColumn("low", F.least("chunk", "_other")).withColumn("high", F.greatest("chunk", "_other"))
    weight_of = rest.join(sets.select("id", F.size("items").alias("size")), "id").agg(F.sum(F.col("size") * F.ceil(F.col("n") / block))).first()[0] or 0
    cell_key = F.xxhash64("band", "bucket", "low", "high")
    key = F.when(F.col("n") > block, cell_key).otherwise(F.pmod(cell_key, F.lit(max(1, -(-weight_of // SHARD_ITEMS)))))
    cells = cells.select(key.alias("shard"), "band", "bucket", "low", "high", "chunk", "id", "label").join(signed, "id")
    more = stored(cells.groupBy("shard").applyInPandas(_joining_links(threshold), "a long, b long"), "links")
    if not more.limit(1).count():
        return labels
    # only labels are joined; an id without one stands for itself
    joined = components(more)
    alone = joined.join(labels, "id", "left_anti").select("id", F.col("id").alias("label"))
    return stored(_followed(labels.union(alone), joined, "label"), "labels")
