"""Operator 6: repeated passages by paragraph MinHash banding.

A text is cut into paragraphs at line ends and sentence ends. Lines or sentences of less than five words in a row are joined,
and stretches of some length without an end are cut, at places chosen by the words around them, so a passage is cut alike
wherever it stands. Equal paragraphs are one from the start. The others are banded by MinHash; the number of bands is the
least that finds a pair at the threshold with the wanted probability. Colliding paragraphs are verified by exact Jaccard similarity, components are the classes, and neighbouring repeated
paragraphs join to passages. Of a class the first occurrence stays, all others are to be removed.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from featsieve.functions import bounded_rows

from .common import sliced, stored, text_or_empty
from .near_sets import distinct_items, grouped_lists, mixed, similar_classes

WORDS, THRESHOLD, RECALL = 5, 0.8, 0.997
MIN_WORDS = 5  # shorter paragraphs are never matched
MIN_BANDED = 8  # paragraphs below hold too few shingles for a near match; they are matched as they are
MIN_PASSAGE = 25  # words of neighbouring repeated paragraphs that make a passage
GAP = 60  # characters between paragraphs that still are neighbours; a single paragraph between them does not part them either
LONG_LINE, LONG_STRETCH, LONG_WORD = 200, 32, 40  # characters, words, characters from which more cuts are made
NEAR, WIDEST = MIN_WORDS - 1, 24  # words: a cut chosen by content is the least among so many on either side; the widest gap
ROWS = 2
# bits of a bitmap of ids; the last bounds what is broadcast (128 MB)
BITS_PER_ID, LEAST_FILTER_BITS, MOST_FILTER_BITS = 64, 1 << 16, 1 << 30

_NEVER = np.uint64(0xFFFFFFFFFFFFFFFF)
_STOPS, _CLOSING = ".!?", "\"')]\u2019\u201d\u00bb"
_FULL_STOPS = "\u3002\uff01\uff0e\uff1f\u0964"  # sentence ends without white space after them
#: Thai, Lao, Myanmar, Khmer, kana, Han: each letter is a word.
_UNSPACED = ((0x0E00, 0x0EFF), (0x1000, 0x109F), (0x1780, 0x17FF), (0x3040, 0x30FF), (0x3400, 0x4DBF), (0x4E00, 0x9FFF), (0xF900, 0xFAFF), (0x20000, 0x3FFFF))


def tuned_bands(threshold: float = THRESHOLD, recall: float = RECALL, rows: int = ROWS) -> int:
    """Least number of bands of ``rows`` coordinates that finds a pair at the threshold with probability ``recall``."""
    return int(np.ceil(np.log(1 - recall) / np.log(1 - threshold**rows)))


def _least_places(priority: np.ndarray, group: np.ndarray) -> np.ndarray:
    """Places whose priority is the least among the NEAR places on either side within their group, the left one of equals.

    What is chosen depends on its surroundings alone. Gaps over WIDEST, rare but in monotonous text, get their least
    places one after the other.
    """
    chosen = priority < _NEVER
    for k in range(1, NEAR + 1):
        same = group[k:] == group[:-k]
        chosen[k:] &= ~(same & (priority[:-k] <= priority[k:])) | (priority[k:] == 0)
        chosen[:-k] &= ~(same & (priority[k:] < priority[:-k]))
    last = np.append(group[1:] != group[:-1], True) if len(group) else np.zeros(0, bool)
    stops = np.flatnonzero(chosen | last)
    starts = np.concatenate([[0], stops[:-1] + 1]) if len(stops) else stops
    for i in np.flatnonzero(stops - starts >= WIDEST).tolist():
        at, stop = int(starts[i]), int(stops[i])
        while stop - at >= WIDEST:
            low, high = at + NEAR, min(at + WIDEST, stop - NEAR)
            best = low + int(np.argmin(priority[low:high]))
            if priority[best] == _NEVER:
                more = np.flatnonzero(priority[high : stop - NEAR] < _NEVER)
                if not len(more):
                    break
                best = high + int(more[0])
            chosen[best] = True
            at = best + 1
    return chosen


def _characters(text: str) -> tuple[np.ndarray, ...]:
    """(lower-case code points, word characters, those that are words alone, white space, stops, closing marks, full stops)."""
    code = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), "<u4").astype(np.intp)
    # tables by code point, filled for those that occur: nothing is sorted
    seen = np.zeros(int(code.max(initial=0)) + 1, bool)
    seen[code] = True
    known = np.flatnonzero(seen)
    chars = [chr(c) for c in known.tolist()]
    lower, kinds = np.zeros(len(seen), np.uint64), np.zeros(len(seen), np.uint8)
    lower[known] = [ord(c.lower()[0]) for c in chars]
    word = np.asarray([c.isalnum() or c == "_" for c in chars], bool)
    alone = np.zeros(len(chars), bool)
    for low, high in _UNSPACED:
        alone |= (known >= low) & (known <= high)
    flags = [word, alone & word, [c.isspace() for c in chars], *[[c in marks for c in chars] for marks in (_STOPS, _CLOSING, _FULL_STOPS)]]
    for i, flag in enumerate(flags):
        kinds[known] |= np.asarray(flag, np.uint8) << i
    kind = kinds[code]
    return lower[code], *[(kind & (1 << i)).astype(bool) for i in range(len(flags))]


def _words(code: np.ndarray, word: np.ndarray, alone: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(start, end, hash) of the words: runs of word characters; scripts without spaces and overlong runs are cut further."""
    before = np.concatenate([[False], word[:-1]])
    begins = word & (~before | alone | np.concatenate([[False], alone[:-1]]))
    start = np.flatnonzero(begins)
    stop = np.flatnonzero(word & np.append(begins[1:] | ~word[1:], True)) + 1
    long_ = np.flatnonzero(stop - start > LONG_WORD)
    if len(long_):
        size = (stop - start)[long_]
        group = np.repeat(long_, size)
        place = np.repeat(start[long_] - np.concatenate([[0], np.cumsum(size)[:-1]]), size) + np.arange(int(size.sum()))
        gram = np.zeros(len(place), np.uint64)
        for i in range(4):
            gram = mixed(gram * np.uint64(0x9E3779B97F4A7C15) + code[np.maximum(place - i, start[group])])
        gram[place == stop[group] - 1] = _NEVER
        cut = place[_least_places(np.where(gram == 0, np.uint64(1), gram), group)] + 1
        start, stop = np.sort(np.append(start, cut)), np.sort(np.append(stop, cut))
    if not len(start):
        return start, stop, np.zeros(0, np.uint64)
    size = stop - start
    owner = np.repeat(np.arange(len(start)), size)
    place = np.flatnonzero(word)
    rank = (place - start[owner]).astype(np.uint64)
    first = np.concatenate([[0], np.cumsum(size)[:-1]])
    return start, stop, mixed(np.add.reduceat(mixed(code[place] + rank * np.uint64(0xD1342543DE82EF95)), first))


def _units(texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(text number, (start, end) in code points, first word, words) of the paragraphs, and the hashes of all words."""
    base = np.concatenate([[0], np.cumsum([len(t) + 1 for t in texts])]).astype(np.int64)
    code, word, alone, space, stops, closing, full_stops = _characters("\n".join(texts))
    start, stop, hashed = _words(code, word, alone)
    n = len(start)
    if not n:
        return np.zeros(0, np.int64), np.zeros((0, 2), np.int64), np.zeros(0, np.int64), np.zeros(0, np.int64), hashed
    text = np.searchsorted(base, start, "right") - 1
    # place i lies between word i and word i + 1, in the characters low to high
    low, high = stop, np.append(start[1:], len(code))
    final = np.append(text[1:] != text[:-1], True)
    ends = stops & np.append(space[1:] | closing[1:], True) | full_stops

    def within(flags: np.ndarray) -> np.ndarray:
        total = np.concatenate([[0], np.cumsum(flags)])
        return total[high] > total[low]

    line = within(code == 10) | final
    sentence = within(ends) | line
    # stretches between sentence or line ends
    last = np.flatnonzero(sentence)
    first = np.concatenate([[0], last[:-1] + 1])
    size = last - first + 1
    stretch = np.repeat(np.arange(len(last)), size)
    short = size < MIN_WORDS
    next_short = np.append(short[1:], False) & ~final[last]
    # runs of short stretches
    inner = short & next_short
    run = np.cumsum(np.concatenate([[True], ~inner[:-1]])) - 1
    run_words = np.bincount(run, weights=size)[run]
    glued = short & ~next_short & (run_words < MIN_WORDS) & ~line[last]
    priority = mixed(hashed * np.uint64(0x9E3779B97F4A7C15) + np.append(hashed[1:], np.uint64(0))) >> np.uint64(1) | np.uint64(1)
    long_ = (size > LONG_STRETCH) | (stop[last] - start[first] > LONG_LINE)
    priority = np.where(sentence, priority, np.where(long_[stretch], priority | np.uint64(1 << 63), _NEVER))
    priority[last[~inner & ~glued]] = 0
    priority[last[glued]] = _NEVER
    cut = _least_places(priority, text)
    at = np.flatnonzero(cut)
    # a piece ends at the line end, or where the white space after it ends
    solid = np.append(np.flatnonzero(~space), len(code))
    breaks, blanks = (np.append(np.flatnonzero(f), len(code)) for f in (code == 10, space))
    newline, blank = (x[np.searchsorted(x, low[at])] for x in (breaks, blanks))
    by_line = (newline < high[at]) & ~final[at]
    onward = np.where(by_line, solid[np.searchsorted(solid, newline)], np.where(blank < high[at], solid[np.searchsorted(solid, blank)], high[at]))
    limit = base[text[at] + 1] - 1
    tail = solid[np.searchsorted(solid, limit) - 1] + 1
    end = np.where(final[at], tail, np.where(by_line, newline, onward))
    opening = solid[np.searchsorted(solid, base[text[at]])]
    begin = np.where(np.concatenate([[True], final[at][:-1]]), opening, np.concatenate([[0], onward[:-1]]))
    head = np.concatenate([[0], at[:-1] + 1])
    owner = text[at]
    return owner, np.stack([begin, end], 1) - base[owner][:, None], head, at - head + 1, hashed


def paragraphs(text: str) -> list[tuple[int, int]]:
    """(start, end) of the paragraphs in code points; only white space lies between them."""
    return [tuple(x) for x in _units([text])[1].tolist()]


def _keyed(texts: list[str], words: int) -> tuple[np.ndarray, ...]:
    """(text, (start, end), words, number in the text) of the paragraphs of MIN_WORDS or more, (paragraph, shingle) in text order, 64-bit keys."""
    owner, spans, head, n_words, hashed = _units(texts)
    nth = np.arange(len(owner)) - np.searchsorted(owner, owner)
    good = n_words >= MIN_WORDS
    owner, spans, head, n_words, nth = owner[good], spans[good], head[good], n_words[good], nth[good]
    n_shingles = np.maximum(n_words - words + 1, 1)
    doc = np.repeat(np.arange(len(owner)), n_shingles)
    position = np.arange(len(doc)) - np.repeat(np.cumsum(n_shingles) - n_shingles, n_shingles)
    value = np.zeros(len(doc), np.uint64)
    for i in range(words):
        own = np.where(position + i < n_words[doc], hashed[np.minimum(head[doc] + position + i, len(hashed) - 1)], np.uint64(0)) if len(doc) else value
        value = mixed(value * np.uint64(0x9E3779B97F4A7C15) + own + np.uint64(i + 1))
    key = np.zeros(len(owner), np.uint64)
    np.add.at(key, doc, mixed(value + position.astype(np.uint64) * np.uint64(0xD1342543DE82EF95)))
    return owner, spans, n_words, nth, doc, value, mixed(key)


def _occurrences(docs: DataFrame, words: int, bands: int, rows: int) -> DataFrame:
    names = [f"b{i}" for i in range(bands)]

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seeds = mixed(np.arange(1, bands * rows + 1, dtype=np.uint64))
        for batch in sliced(batches, "text"):
            owner, spans, n_words, nth, doc, value, key = _keyed(batch.column(1).to_pylist(), words)
            if not len(owner):
                continue
            banded = n_words >= MIN_BANDED
            use = banded[doc]
            first = np.flatnonzero(np.diff(doc[use], prepend=-1))
            own = value[use]
            hashes = np.zeros((bands, len(owner)), np.uint64)
            rank = np.flatnonzero(banded)
            if len(own):
                for band in range(bands):
                    for r in range(rows):
                        least = np.minimum.reduceat(mixed(own ^ seeds[band * rows + r]), first)
                        hashes[band, rank] = mixed(hashes[band, rank] * np.uint64(0x9E3779B97F4A7C15) + least)
            at = spans.astype(np.int32)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).take(pa.array(owner)), pa.array(at[:, 0]), pa.array(at[:, 1]), pa.array(n_words.astype(np.int32)), pa.array(nth.astype(np.int32)),
                 pa.array(key.view(np.int64)), *[pa.array(hashes[i].view(np.int64), mask=~banded) for i in range(bands)]],
                names=["doc_id", "start", "end", "n_words", "nth", "pid", *names])

    return docs.mapInArrow(read, "doc_id long, start int, end int, n_words int, nth int, pid long, " + ", ".join(f"{b} long" for b in names))


def _bit_filter(ids: DataFrame) -> np.ndarray:
    """A bitmap of the low bits of each id (a hash already), sized by the number of ids up to MOST_FILTER_BITS."""
    n = ids.count()
    bits = min(MOST_FILTER_BITS, max(LEAST_FILTER_BITS, 1 << (max(1, n) * BITS_PER_ID - 1).bit_length()))
    low = F.col("id").bitwiseAND(F.lit(bits - 1))
    bit = F.expr("shiftleft(1L, cast(low & 7 as int))")
    words = ids.select(low.alias("low")).groupBy(F.shiftright("low", 3).cast("int").alias("place")).agg(F.bit_or(bit).cast("int").alias("byte")).toArrow()
    out = np.zeros(bits // 8, np.uint8)
    out[words["place"].to_numpy()] = words["byte"].to_numpy().astype(np.uint8)
    return out


def _in_filter(bitmap: np.ndarray, values: np.ndarray) -> np.ndarray:
    low = (values & np.uint64(8 * len(bitmap) - 1)).astype(np.int64)
    return (bitmap[low >> 3] >> (low & 7).astype(np.uint8)) & 1 == 1


def _sharing(occurrences: DataFrame, names: list[str]) -> DataFrame:
    """Rows of ``occurrences`` (bands, pid and doc_id) that may share a bucket with another row.

    Buckets are counted by 32 bits of their hash; what the bitmap of those met twice lets through by chance has no
    partner later. Only the counted keys are shuffled, not the rows.
    """
    keys = occurrences.filter("b0 is not null").select(F.explode(F.array(*[F.shiftright(F.shiftleft(b, 32), 32).cast("int") for b in names])).alias("key"))
    # stored, as the bitmap is sized by their number: all bands would be counted twice otherwise
    twice = stored(keys.groupBy("key").count().filter("count > 1").select(F.col("key").cast("long").alias("id")), "keys")
    shipped = occurrences.sparkSession.sparkContext.broadcast(_bit_filter(twice))

    def keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            hit = np.zeros(batch.num_rows, bool)
            for i in range(len(names)):
                hit |= _in_filter(shipped.value, batch.column(i).to_numpy(zero_copy_only=False).view(np.uint64))
            yield batch.filter(pa.array(hit))

    rows = occurrences.filter("b0 is not null").select(*names, "pid", "doc_id")
    return rows.mapInArrow(keep, rows.schema)


def _paragraph_sets(docs: DataFrame, words: int, bitmap: np.ndarray) -> DataFrame:
    """(id, items) of the paragraphs whose key is in the bitmap."""
    shipped = docs.sparkSession.sparkContext.broadcast(bitmap)

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in sliced(batches, "text"):
            *_, doc, value, key = _keyed(batch.column(1).to_pylist(), words)
            if not len(key):
                continue
            wanted = _in_filter(shipped.value, key)
            doc, value, _ = distinct_items(doc[wanted[doc]], value[wanted[doc]])
            lists = grouped_lists(doc, value.view(np.int64), len(key), pa.int64())
            keep = pa.array(np.flatnonzero(wanted))
            yield pa.RecordBatch.from_arrays([pa.array(key.view(np.int64)).take(keep), lists.take(keep)], names=["id", "items"])

    return docs.mapInArrow(read, "id long, items array<long>")


def repeated_passages(docs: DataFrame, threshold: float = THRESHOLD, words: int = WORDS, min_passage: int = MIN_PASSAGE) -> DataFrame:
    """One row per repeated paragraph of a passage: doc_id, start, end, n_words, class_id, keep, passage_start, passage_words.

    A paragraph is repeated if its class stands in two documents or more; ``keep`` marks the class's first
    occurrence by (doc_id, start). Null or empty texts have no paragraphs; rows with a null doc_id take no part; repeated rows
    are one document and give their rows once each; an empty table gives no rows. Offsets are code points, ends exclusive.
    """
    known = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_or_empty().alias("text")).filter("doc_id is not null")
    bands = tuned_bands(threshold)
    names = [f"b{i}" for i in range(bands)]
    occurrences = stored(_occurrences(known, words, bands, ROWS), "paragraphs")
    # all rows of a paragraph have the same bands, so its least doc_id is among them
    distinct = stored(_sharing(occurrences, names).groupBy(F.col("pid").alias("id")).agg(*[F.min(b).alias(b) for b in names], F.min("doc_id").alias("doc_id")), "candidates")

    def sets_of(ids: DataFrame) -> DataFrame:
        homes = distinct.select("doc_id", "id").join(ids, "id", "left_semi")
        chosen, few = bounded_rows(homes.select("doc_id").distinct())
        texts = known.select("doc_id", "text")
        if few:
            texts = texts.join(F.broadcast(chosen), "doc_id", "left_semi").select("doc_id", "text")
        # the bitmap lets few others through, and the join takes those out
        return _paragraph_sets(texts, words, _bit_filter(ids)).join(ids, "id", "left_semi").groupBy("id").agg(F.min("items").alias("items"))

    labels = similar_classes(distinct.select("id", F.array(*names).alias("bands")), sets_of, threshold)
    found = occurrences.select("doc_id", "start", "end", "n_words", "nth", "pid")
    classes = found.groupBy("pid").agg(F.min("doc_id").alias("low"), F.max("doc_id").alias("high"))
    # a paragraph of one document without a label is no one's copy
    classes = classes.join(labels, F.col("pid") == F.col("id"), "left").filter("low <> high or label is not null").withColumn("class_id", F.coalesce("label", "pid"))
    wide = classes.groupBy("class_id").agg(F.min("low").alias("first_doc"), F.max("high").alias("last_doc")).filter("first_doc <> last_doc")
    repeated = stored(classes.join(wide, "class_id").select("pid", "class_id", "first_doc"), "repeated")
    rows = found.join(repeated, "pid").distinct()
    order = Window.partitionBy("doc_id").orderBy("start", "end", "class_id")
    before = F.max(F.struct("end", "nth")).over(order.rowsBetween(Window.unboundedPreceding, -1))
    far = (F.col("start") - before["end"] > GAP) & (F.col("nth") - before["nth"] > 2)
    rows = rows.withColumn("_new", F.when(before.isNull() | far, F.col("start")))
    rows = rows.withColumn("passage_start", F.last("_new", ignorenulls=True).over(order.rowsBetween(Window.unboundedPreceding, 0)))
    once = F.row_number().over(Window.partitionBy("doc_id", "class_id").orderBy("start", "end"))
    rows = rows.withColumn("keep", (F.col("doc_id") == F.col("first_doc")) & (once == 1))
    rows = rows.withColumn("passage_words", F.sum("n_words").over(Window.partitionBy("doc_id", "passage_start"))).filter(F.col("passage_words") >= min_passage)
    return rows.select("doc_id", "start", "end", "n_words", "class_id", "keep", "passage_start", "passage_words")


def op6_paragraph_banding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repeated_passages(spark.read.parquet(f"{sf_dir}/documents.parquet"))
