"""Operator 3: cost-balanced packing of token ids into sequences of fixed length.

The cost of a piece of n ids is ``linear * n + quadratic * n * n`` (attention stays inside a piece). Pieces are dealt to
shards of bounded size by a hash; in a shard they go, by falling cost, each to the cheapest sequence that still has room.
A shard opens just as many sequences as its ids need, so a piece that fits nowhere whole is cut over the roomiest ones
and padding stays below one sequence a shard.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, functions as F

from ..functions import bounded_rows
from .common import drop_worker_cache, give_back_memory, sliced, text_or_empty
from .tokens import default_tokenizer, worker_encoder

SHARD_BYTES = 8_000_000
# late in a pipeline the JVM holds its whole heap, so two workers must do with little: near 250 MB each
SLICE_BYTES, MEMO_UNITS = 1_000_000, 400_000
COPIES = 64  # equal rows that may share a shard by their hash
LINEAR, QUADRATIC = 1.0, 1.0 / 2048
PIECES = "doc_id long, start long, length long, doc_tokens long, sequence_id long, offset long, ids binary"


def assign(lengths: np.ndarray, capacity: int, linear: float = LINEAR, quadratic: float = QUADRATIC) -> list[tuple[int, int, int, int, int]]:
    """Pack pieces of at most ``capacity`` ids: (piece, first id in it, length, sequence, offset) for every part."""
    cost = linear * lengths + quadratic * lengths.astype(float) ** 2
    n_sequences = max(1, math.ceil(int(lengths.sum()) / capacity))
    room = np.full(n_sequences, capacity, np.int64)
    load = np.zeros(n_sequences)
    placed = []

    def put(piece: int, first: int, length: int, sequence: int) -> None:
        placed.append((piece, first, length, sequence, capacity - int(room[sequence])))
        room[sequence] -= length
        load[sequence] += linear * length + quadratic * length * length

    for piece in np.lexsort((np.arange(len(lengths)), -cost)).tolist():
        length = int(lengths[piece])
        fits = np.flatnonzero(room >= length)
        if len(fits):
            put(piece, 0, length, int(fits[np.argmin(load[fits])]))
            continue
        first = 0
        while first < length:
            sequence = int(np.argmax(room))
            part = min(length - first, int(room[sequence]))
            put(piece, first, part, sequence)
            first += part
    return placed


def pack_documents(
    docs: DataFrame, capacity: int = 2048, end_id: int = 1, tokenizer_file: str | None = None, linear: float = LINEAR, quadratic: float = QUADRATIC, shard_bytes: int = SHARD_BYTES
) -> DataFrame:
    """One row per piece: doc_id, start, length, doc_tokens, sequence_id, offset, ids (little-endian unsigned 32-bit).

    Every id of every whole text and its end id lies in exactly one piece. Null texts are empty and hold the end id
    alone; a null doc_id stays null; repeated rows are packed each for itself; a long text is cut into pieces of
    ``capacity`` ids; ties in cost go by doc_id, start and ids; other columns are not read, whatever their names; an
    empty table gives no rows. The result does not depend on the partitioning of the input.
    """
    spark = docs.sparkSession
    shipped = spark.sparkContext.broadcast(open(tokenizer_file or default_tokenizer(), encoding="utf-8").read())
    rows = _numbered(docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_or_empty().alias("text")))
    total = docs.select(text_or_empty().alias("text")).agg(F.sum(F.octet_length("text") + 1)).first()[0] or 0
    shards = max(1, math.ceil(total / shard_bytes))  # a byte-level id stands for one byte at least
    schema = pa.schema([("doc_id", pa.int64()), ("place", pa.int64()), ("start", pa.int64()), ("doc_tokens", pa.int64()), ("ids", pa.binary())])

    def pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = worker_encoder(shipped.value, MEMO_UNITS)
        for batch in sliced(batches, "text", SLICE_BYTES, caching=True):
            ids, counts = encoder.encode(batch.column(1))
            # every text's ids with the end id behind them, and the places where pieces begin
            sizes = counts + 1
            ends = np.cumsum(sizes)
            stream = np.full(int(ends[-1]), end_id, "<u4")
            inner = np.ones(len(stream), bool)
            inner[ends - 1] = False
            stream[inner] = ids
            per_text = -(-sizes // capacity)
            owner = np.repeat(np.arange(len(sizes)), per_text)
            start = capacity * (np.arange(len(owner)) - np.repeat(np.cumsum(per_text) - per_text, per_text))
            bounds = np.concatenate([(ends - sizes)[owner] + start, ends[-1:]]) * 4
            cut = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(owner), [None, pa.py_buffer(bounds.astype(np.int64)), pa.py_buffer(stream)]).cast(pa.binary())
            at = pa.array(owner)
            yield pa.RecordBatch.from_arrays([batch.column(0).take(at), batch.column(2).take(at), pa.array(start), pa.array(sizes[owner]), cut], schema=schema)

    def packed(key: tuple, part: pa.Table) -> pa.Table:
        drop_worker_cache()  # the stage before has filled it with words
        part = part.sort_by([("doc_id", "ascending"), ("start", "ascending"), ("ids", "ascending")])
        lengths = pc.binary_length(part["ids"]).to_numpy().astype(np.int64) // 4
        piece, first, length, sequence, offset = np.asarray(assign(lengths, capacity, linear, quadratic), np.int64).reshape(-1, 5).T
        ids = part["ids"].combine_chunks()
        out = [part["doc_id"].take(piece), pa.array(part["start"].to_numpy()[piece] + first), pa.array(length), part["doc_tokens"].take(piece), pa.array((key[0].as_py() << 32) + sequence), pa.array(offset),
               pa.array([ids[p].as_py()[4 * a : 4 * (a + n)] for p, a, n in zip(piece.tolist(), first.tolist(), length.tolist())], pa.binary())]
        table = pa.table(out, names=["doc_id", "start", "length", "doc_tokens", "sequence_id", "offset", "ids"])
        del part, ids, out
        give_back_memory()  # else idle workers keep what the stage freed
        return table

    cut = rows.mapInArrow(pieces, "doc_id long, place long, start long, doc_tokens long, ids binary")
    shard = F.pmod(F.xxhash64("place", "start"), F.lit(shards))
    return cut.withColumn("shard", shard).drop("place").groupBy("shard").applyInArrow(packed, PIECES)


def _numbered(rows: DataFrame) -> DataFrame:
    """doc_id, text and ``place``, a hash of both; copies of one row beyond ``COPIES`` are spread by a number.

    Which copy has which number does not matter, so such a group is counted and its count expanded. The result does not
    depend on how the input is partitioned.
    """
    named = rows.withColumn("_hash", F.xxhash64("doc_id", "text"))
    groups = named.groupBy("doc_id", "_hash").count().filter(F.col("count") > COPIES)
    hot, few = bounded_rows(groups)
    plain = named.select("doc_id", "text", F.col("_hash").alias("place"))
    if few and not hot.limit(1).count():
        return plain
    same = named["doc_id"].eqNullSafe(F.col("_id")) & (named["_hash"] == F.col("_key"))
    keys = hot.select(F.col("doc_id").alias("_id"), F.col("_hash").alias("_key"), F.col("count").alias("_copies"))
    keys = F.broadcast(keys) if few else keys
    rest = named.join(keys, same, "left_anti").select("doc_id", "text", F.col("_hash").alias("place"))
    # of a hot group one row is read for every text; the hash may stand for several texts, which are counted apart
    counted = named.join(keys, same, "left_semi").groupBy("doc_id", "text", "_hash").count()
    width, last = F.lit(COPIES).cast("long"), F.col("count") - 1
    parts = counted.withColumn("_from", F.explode(F.sequence(F.lit(0).cast("long"), last, width))).repartition("_hash", "_from")
    copies = F.explode(F.sequence("_from", F.least(F.col("_from") + width - 1, last)))
    spread = parts.withColumn("_copy", copies).select("doc_id", "text", F.xxhash64("_hash", "_copy").alias("place"))
    return rest.union(spread)


def op3_cost_balanced_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing_rows(spark.read.parquet(f"{sf_dir}/documents.parquet"))


def packing_rows(docs: DataFrame) -> DataFrame:
    """Pieces with the checksum of their ids in place of the ids."""
    return pack_documents(docs).withColumn("ids_crc32", F.crc32("ids")).drop("ids")
