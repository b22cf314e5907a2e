"""Operator 12: byte-level BPE encoding and decoding by a file of ranks.

The tokenizers library gets the ranks as a vocabulary and merges over characters that stand for bytes. A rank file names
no merges. Where a token arises in a text, the joins inside it were made in the same order as in the token alone, because
each was the lowest rank at its time; so a token has one merge, found by merging its own bytes, and the library then does
what the ranks ask for. Decoding maps ids to bytes by the reversed table; a character may be spread over several tokens.
"""

from __future__ import annotations

import base64
import json
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, functions as F, types as T

from .common import sliced, text_or_empty
from .tokens import worker_encoder


def default_ranks() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_multi_50k.tiktoken")


def byte_characters() -> list[str]:
    """The printable character that stands for each byte: itself in Latin-1, or the next free one from U+0100 on."""
    shown = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    free = iter(range(0x100, 0x200))
    return [chr(b if b in shown else next(free)) for b in range(256)]


def read_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as lines:
        return {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, lines)}


def merge_of(token: bytes, ranks: dict[bytes, int]) -> tuple[bytes, bytes] | None:
    """The last two parts of a token when its own bytes are merged, lowest rank first; None if more cannot be joined."""
    parts = [token[i : i + 1] for i in range(len(token))]
    while len(parts) > 2:
        known = [(ranks[a + b], i) for i, (a, b) in enumerate(zip(parts, parts[1:])) if a + b in ranks]
        if not known:
            return None
        i = min(known)[1]
        parts[i : i + 2] = [parts[i] + parts[i + 1]]
    return parts[0], parts[1]


def definition(ranks: dict[bytes, int], pattern: str) -> str:
    """A tokenizer of the library (JSON) with the ranks' ids; words found whole in the vocabulary are one token."""
    from tokenizers import Regex, Tokenizer, models, pre_tokenizers

    shown = byte_characters()
    names = {t: "".join(shown[b] for b in t) for t in ranks}
    pairs = [merge_of(t, ranks) for t in sorted(ranks, key=ranks.__getitem__) if len(t) > 1]
    model = models.BPE(vocab={names[t]: r for t, r in ranks.items()}, merges=[(names[p[0]], names[p[1]]) for p in pairs if p], ignore_merges=True)
    tokenizer = Tokenizer(model)
    words = pre_tokenizers.Split(Regex(pattern), "isolated")
    tokenizer.pre_tokenizer = pre_tokenizers.Sequence([words, pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)])
    return tokenizer.to_str()


class ByteTable:
    """Bytes of every id: the reversed byte-to-character table of a definition's vocabulary."""

    def __init__(self, definition_: str):
        back = {c: b for b, c in enumerate(byte_characters())}
        vocabulary = json.loads(definition_)["model"]["vocab"]
        size = max(vocabulary.values(), default=-1) + 1
        self.size, tokens = np.full(size, -1, np.int64), [b""] * size
        for name, i in vocabulary.items():
            tokens[i] = bytes(back[c] for c in name)
            self.size[i] = len(tokens[i])
        self.first = np.concatenate([[0], np.cumsum(np.maximum(self.size, 0))])[:-1]
        self.pool = np.frombuffer(b"".join(tokens), np.uint8)

    def decode(self, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(bytes of all ids, bytes per id); an id without a token raises."""
        ids = ids.astype(np.int64)
        if len(ids) and (ids.min() < 0 or ids.max() >= len(self.size) or (self.size[ids] < 0).any()):
            raise ValueError("an id is not in the vocabulary")
        sizes = self.size[ids]
        ends = np.cumsum(sizes)
        total = int(ends[-1]) if len(ends) else 0
        return self.pool[np.repeat(self.first[ids] - (ends - sizes), sizes) + np.arange(total)], sizes


def character_offsets(data: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Code points a token touches (start, end), from the bytes of a whole UTF-8 text and the bytes per token.

    A character spread over several tokens belongs to each of them.
    """
    begins = (data & 0xC0) != 0x80
    upto = np.concatenate([[0], np.cumsum(begins)])
    ends = np.cumsum(sizes)
    starts = ends - sizes
    return upto[np.minimum(starts + 1, len(data))] - (len(data) > 0), upto[ends]


def whole_characters(pieces: list[bytes]) -> list[str]:
    """Text per token: bytes of an unfinished character wait for the token that ends it; broken ones become U+FFFD."""
    import codecs

    reader = codecs.getincrementaldecoder("utf-8")("replace")
    return [reader.decode(p, final=i == len(pieces) - 1) for i, p in enumerate(pieces)]


def _table(definition_: str) -> ByteTable:
    import hashlib

    from .common import worker_cache

    return worker_cache(("bytes", hashlib.md5(definition_.encode()).hexdigest()), lambda: ByteTable(definition_))


def _binary(values: np.ndarray, counts: np.ndarray) -> pa.Array:
    """One binary value per row, holding the row's little-endian 32-bit values."""
    bounds = np.concatenate([[0], np.cumsum(counts)]).astype(np.int64) * 4
    return pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(counts), [None, pa.py_buffer(bounds), pa.py_buffer(values.astype("<u4"))]).cast(pa.binary())


def encode_texts(docs: DataFrame, ranks_file: str | None = None, pattern: str | None = None, offsets: bool = True) -> DataFrame:
    """One row per document: doc_id, n_tokens, ids and, with ``offsets``, starts and ends (code points, end exclusive).

    ids, starts and ends are little-endian unsigned 32-bit integers. Strings of special tokens are ordinary text. Null
    texts are empty and have no ids; a null doc_id stays null; every one of repeated rows has its own row; a long text
    is encoded whole; other columns are not read, whatever their names; an empty table gives no rows.
    """
    import public_tokenizers

    spark = docs.sparkSession
    shipped = spark.sparkContext.broadcast(definition(read_ranks(ranks_file or default_ranks()), pattern or public_tokenizers.PATTERN))
    places = ["starts", "ends"] if offsets else []
    schema = pa.schema([("doc_id", pa.int64()), ("n_tokens", pa.int64()), ("ids", pa.binary()), *[(c, pa.binary()) for c in places]])

    def encoded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, table = worker_encoder(shipped.value), _table(shipped.value)
        for batch in sliced(batches, "text", 2_000_000, caching=True):
            ids, counts = encoder.encode(batch.column(1))
            out = [batch.column(0), pa.array(counts), _binary(ids, counts)]
            if offsets:
                data, sizes = table.decode(ids)
                start, end = character_offsets(data, sizes)
                # from the batch's characters to the text's
                edges = np.concatenate([[0], np.cumsum(counts)])[:-1]
                base = np.repeat(np.concatenate([start, [0]])[np.minimum(edges, len(start))], counts)
                out += [_binary(start - base, counts), _binary(end - base, counts)]
            yield pa.RecordBatch.from_arrays(out, schema=schema)

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_or_empty().alias("text"))
    return rows.mapInArrow(encoded, "doc_id long, n_tokens long, ids binary" + "".join(f", {c} binary" for c in places))


def decode_ids(coded: DataFrame, ranks_file: str | None = None, pattern: str | None = None, as_text: bool = False) -> DataFrame:
    """``coded`` with ``decoded`` (the bytes of its ids) added, and ``text`` (broken characters as U+FFFD) on request.

    A null ``ids`` column counts as empty; an id without a token raises. Columns of ``coded`` with the names of the
    added ones are replaced, all others stay as they are.
    """
    import public_tokenizers
    from pyspark.sql.pandas.types import to_arrow_schema

    shipped = coded.sparkSession.sparkContext.broadcast(definition(read_ranks(ranks_file or default_ranks()), pattern or public_tokenizers.PATTERN))
    added = ["decoded", "text"] if as_text else ["decoded"]
    kept = coded.select(*[F.col(f"`{c}`") for c in coded.columns if c.lower() not in added])
    where = [c.lower() for c in kept.columns].index("ids")
    plain = kept.toDF(*[f"_{i}" for i in range(len(kept.columns))])  # names with dots cannot go to a worker
    schema = T.StructType([*plain.schema.fields, T.StructField("decoded", T.BinaryType()), *[T.StructField("text", T.StringType())] * as_text])
    arrow = to_arrow_schema(schema)

    def decoded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = _table(shipped.value)
        for batch in sliced(batches, f"_{where}", 4_000_000, caching=True):
            column = pc.fill_null(batch.column(where), b"").cast(pa.large_binary())
            bounds = np.frombuffer(column.buffers()[1], np.int64, len(column) + 1, column.offset * 8)
            whole = np.frombuffer(column.buffers()[2], np.uint8)[bounds[0] : bounds[-1]] if bounds[-1] else np.zeros(0, np.uint8)
            data, sizes = table.decode(whole.view("<u4"))
            upto = np.concatenate([[0], np.cumsum(sizes)])[(bounds - bounds[0]) // 4].astype(np.int64)
            found = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(column), [None, pa.py_buffer(upto), pa.py_buffer(data)]).cast(pa.binary())
            texts = [pa.array([x.decode("utf-8", "replace") for x in found.to_pylist()], pa.string())] if as_text else []
            yield pa.RecordBatch.from_arrays([c.cast(f.type) for c, f in zip([*batch.columns, found, *texts], arrow)], schema=arrow)

    return plain.mapInArrow(decoded, schema).toDF(*kept.columns, *added)


def op12_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents of ``documents``: doc_id, n_tokens, and digests of the ids and of the bytes they decode to."""
    coded = encode_texts(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return decode_ids(coded.drop("starts", "ends")).select("doc_id", "n_tokens", F.sha2("ids", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))
