"""Operator 10: token ids as directly addressable codes.

An id is cut into byte chunks. Level k holds chunk k of every id that has one, a bitmap says which of its ids go on
to level k + 1, and a rank directory (one count per 512 bits, one per 64 bits) turns a bit's place into the place in the
next level. Any id of a segment is read by one look per level; nothing else is decoded.

The file is Parquet: a row is a segment of whole documents, files and rows are in ascending doc_id order, and only the
segment directory (partition, place, sizes) is needed to find a token's segment.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from .common import new_path, sliced, text_or_empty
from .tokens import default_tokenizer, worker_encoder

SEGMENT_TOKENS = 65_536
_SCHEMA = (
    "part int, segment int, part_start long, n_tokens long, doc_ids array<long>, doc_tokens array<long>, "
    "chunks array<binary>, more array<binary>, ranks_512 array<binary>, ranks_64 array<binary>"
)


def encode_ids(ids: np.ndarray) -> dict[str, list[bytes]]:
    """Levels of a segment: chunk bytes, continuation bitmap, and the two parts of its rank directory."""
    levels: dict[str, list[bytes]] = {"chunks": [], "more": [], "ranks_512": [], "ranks_64": []}
    rest = ids.astype(np.uint32)
    while len(rest):
        goes_on = rest > 0xFF
        words = np.zeros((len(rest) + 511) // 512 * 8, np.uint64)
        packed = np.packbits(goes_on, bitorder="little")
        words.view(np.uint8)[: len(packed)] = packed
        before = np.concatenate([[0], np.cumsum(np.bitwise_count(words).astype(np.int64))])[:-1]
        levels["chunks"].append((rest & np.uint32(0xFF)).astype(np.uint8).tobytes())
        levels["more"].append(words.tobytes())
        levels["ranks_512"].append(before[::8].astype(np.uint32).tobytes())
        levels["ranks_64"].append((before - np.repeat(before[::8], 8)).astype(np.uint16).tobytes())
        rest = rest[goes_on] >> np.uint32(8)
    return levels


def ids_at(levels: dict[str, list[bytes]], places: np.ndarray) -> np.ndarray:
    """Ids at the given places of a segment, by rank look-ups only."""
    places = np.asarray(places, np.int64)
    out = np.zeros(len(places), np.uint32)
    open_, at = np.arange(len(places)), places
    for level, chunk in enumerate(levels["chunks"]):
        out[open_] |= np.frombuffer(chunk, np.uint8)[at].astype(np.uint32) << np.uint32(8 * level)
        words = np.frombuffer(levels["more"][level], np.uint64)
        word, bit = words[at >> 6], (at & 63).astype(np.uint64)
        on = (word >> bit) & np.uint64(1) == 1
        within = np.bitwise_count(word & ((np.uint64(1) << bit) - np.uint64(1))).astype(np.int64)
        rank = np.frombuffer(levels["ranks_512"][level], np.uint32)[at >> 9].astype(np.int64)
        rank += np.frombuffer(levels["ranks_64"][level], np.uint16)[at >> 6].astype(np.int64) + within
        open_, at = open_[on], rank[on]
        if not len(open_):
            break
    return out


def decode_ids(levels: dict[str, list[bytes]], n: int) -> np.ndarray:
    """All ids of a segment, level by level from the last."""
    above = np.zeros(0, np.uint32)
    for level in range(len(levels["chunks"]) - 1, -1, -1):
        own = np.frombuffer(levels["chunks"][level], np.uint8).astype(np.uint32)
        on = np.unpackbits(np.frombuffer(levels["more"][level], np.uint8), bitorder="little", count=len(own)).astype(bool)
        own[on] |= above << np.uint32(8)
        above = own
    return above if n else np.zeros(0, np.uint32)


def write_codes(docs: DataFrame, path: str, tokenizer_file: str | None = None, end_id: int = 0, segment_tokens: int = SEGMENT_TOKENS) -> None:
    """Encode every whole text and write the segments in ascending doc_id order.

    Null texts are empty (they hold the end id alone); a null doc_id sorts first; rows with the same doc_id are
    ordered by their text, copies follow one another. A segment is closed at the first document end after
    ``segment_tokens`` ids, so a very long document is a segment of its own. An empty table gives files without rows.
    """
    spark = docs.sparkSession
    definition = open(tokenizer_file or default_tokenizer(), encoding="utf-8").read()
    shipped = spark.sparkContext.broadcast(definition)

    def segments(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        encoder, part = worker_encoder(shipped.value), TaskContext.get().partitionId()
        state = {"segment": 0, "start": 0}
        pending: list[tuple[object, np.ndarray]] = []
        held = 0

        def close() -> pa.RecordBatch:
            ids = np.concatenate([x for _, x in pending])
            levels = encode_ids(ids)
            row = {
                "part": [part], "segment": [state["segment"]], "part_start": [state["start"]], "n_tokens": [len(ids)],
                "doc_ids": [[d for d, _ in pending]], "doc_tokens": [[len(x) for _, x in pending]], **{k: [v] for k, v in levels.items()}}
            state["segment"] += 1
            state["start"] += len(ids)
            pending.clear()
            return pa.RecordBatch.from_pydict(row, schema=schema)

        schema = pa.schema([
            ("part", pa.int32()), ("segment", pa.int32()), ("part_start", pa.int64()), ("n_tokens", pa.int64()),
            ("doc_ids", pa.list_(pa.int64())), ("doc_tokens", pa.list_(pa.int64())), *[(k, pa.list_(pa.binary())) for k in ("chunks", "more", "ranks_512", "ranks_64")]])
        end = np.asarray([end_id], np.uint32)
        for batch in sliced(batches, "text", 4_000_000, caching=True):
            ids, counts = encoder.encode(batch.column(1))
            at = 0
            for doc_id, count in zip(batch.column(0).to_pylist(), counts.tolist()):
                pending.append((doc_id, np.concatenate([ids[at : at + count], end])))
                at, held = at + count, held + count + 1
                if held >= segment_tokens:
                    yield close()
                    held = 0
        if pending:
            yield close()

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_or_empty().alias("text"))
    tie = F.xxhash64("text")
    spread = F.monotonically_increasing_id()  # copies of one row need not share a task
    ordered = rows.withColumn("_tie", tie).withColumn("_spread", spread).repartitionByRange("doc_id", "_tie", "_spread")
    ordered = ordered.sortWithinPartitions("doc_id", "_tie", "_spread").select("doc_id", "text")
    ordered.mapInArrow(segments, _SCHEMA).write.option("compression", "zstd").parquet(path)


def read_segments(spark: SparkSession, path: str) -> DataFrame:
    """Segments with ``first``: the ids before the segment in the whole stream."""
    segments = spark.read.schema(_SCHEMA).parquet(path)
    # one row per written partition
    totals = segments.groupBy("part").agg(F.sum("n_tokens").alias("_in_part"))
    before = F.coalesce(F.sum("_in_part").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    starts = totals.select("part", before.cast("long").alias("_before"))
    return segments.join(F.broadcast(starts), "part").withColumn("first", F.col("_before") + F.col("part_start")).drop("_before")


def _levels(row: dict) -> dict[str, list[bytes]]:
    return {k: row[k] for k in ("chunks", "more", "ranks_512", "ranks_64")}


def read_documents(spark: SparkSession, path: str) -> DataFrame:
    """Documents of the files: doc_id, start, n_tokens, ids (little-endian unsigned 32-bit integers)."""

    def documents(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in (batch.slice(i, 1).to_pylist()[0] for i in range(batch.num_rows)):
                ids = decode_ids(_levels(row), row["n_tokens"]).astype("<u4")
                ends = np.cumsum(row["doc_tokens"])
                starts = ends - row["doc_tokens"]
                yield pa.RecordBatch.from_pydict({
                    "doc_id": pa.array(row["doc_ids"], pa.int64()), "start": pa.array(starts + row["first"], pa.int64()),
                    "n_tokens": pa.array(row["doc_tokens"], pa.int64()), "ids": pa.array([ids[a:b].tobytes() for a, b in zip(starts, ends)], pa.binary())})

    needed = read_segments(spark, path).select("first", "n_tokens", "doc_ids", "doc_tokens", "chunks", "more", "ranks_512", "ranks_64")
    return needed.mapInArrow(documents, "doc_id long, start long, n_tokens long, ids binary")


def tokens_at(spark: SparkSession, path: str, positions: DataFrame) -> DataFrame:
    """(position, id) for each stream position of ``positions``; places outside the stream give no row."""
    segments = read_segments(spark, path).filter("n_tokens > 0")
    width = F.lit(SEGMENT_TOKENS)
    cells = F.sequence(F.floor(F.col("first") / width), F.floor((F.col("first") + F.col("n_tokens") - 1) / width))
    wanted = positions.select(F.col("position").cast("long").alias("position"), F.floor(F.col("position") / width).alias("_cell"))
    hits = segments.withColumn("_cell", F.explode(cells)).join(wanted, "_cell")
    hits = hits.filter("position >= first and position < first + n_tokens")

    def look(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = batch.to_pylist()
            yield pa.RecordBatch.from_pydict({
                "position": pa.array([r["position"] for r in rows], pa.int64()),
                "id": pa.array([int(ids_at(_levels(r), [r["position"] - r["first"]])[0]) for r in rows], pa.int64())})

    return hits.select("position", "first", "chunks", "more", "ranks_512", "ranks_64").mapInArrow(look, "position long, id long")


def op10_addressable_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = new_path(spark, "codes")
    write_codes(spark.read.parquet(f"{sf_dir}/documents.parquet"), path)
    return read_documents(spark, path).select("doc_id", "start", "n_tokens", F.crc32("ids").alias("ids_crc32"))
