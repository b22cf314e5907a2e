"""Token ids of whole texts with the tokenizers library, each distinct word encoded once per worker."""

from __future__ import annotations

from collections.abc import Sequence
from itertools import chain, compress

import numpy as np
import pyarrow as pa

MEMO_UNITS = 800_000  # words a worker remembers, near 200 MB
LONGEST = 64  # bytes; longer units are rare and large: not worth keeping

# byte classes of texts that are cut into units; ``_LETTER`` covers ASCII letters and the two bytes of U+00C0..U+00FF
_OTHER, _SPACE, _LETTER, _DIGIT, _MARK = range(5)
_CLASS = np.full(256, _OTHER, np.uint8)
_CLASS[33:127] = _MARK
_CLASS[[9, 10, 32]] = _SPACE
_CLASS[48:58] = _DIGIT
_CLASS[[*range(65, 91), *range(97, 123), *range(0x80, 0xC0), 0xC3]] = _LETTER


def default_tokenizer() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def _flat(texts: pa.Array | Sequence[str]) -> tuple[np.ndarray, np.ndarray]:
    """(all bytes, where each text begins and the last one ends)."""
    column = (texts if isinstance(texts, pa.Array) else pa.array(list(texts), pa.string())).cast(pa.large_string())
    if not len(column):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    _valid, offsets, data = column.buffers()
    at = np.frombuffer(offsets, np.int64, len(column) + 1, column.offset * 8)
    whole = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return whole[at[0] : at[-1]], at - at[0]


def _shifted(x: np.ndarray, first: int) -> np.ndarray:
    """``x`` moved on by one place, of the same type."""
    out = np.empty_like(x)
    out[:1], out[1:] = first, x[:-1]
    return out


def unit_starts(data: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Places where units begin; no piece of the byte-level pre-tokenizer crosses one.

    A cut stands before the last character of white space in front of a word (before the run and the one character
    otherwise left over), after a white-space character that is no blank, and where a run of letters or digits ends or
    a run of digits begins. Texts with characters beyond ASCII and Latin letters (controls included) are one unit.
    """
    n = len(data)
    if not n:
        return np.zeros(0, np.int64)
    kind = _CLASS[data]
    odd = kind == _OTHER
    after_lead = _shifted(data == 0xC3, False)
    odd |= ((data >= 0x80) & (data < 0xC0) & ~after_lead) | (after_lead & ((data == 0x97) | (data == 0xB7)))
    filled = at[:-1] < at[1:]
    first = at[:-1][filled]
    whole = np.logical_or.reduceat(odd, first) if len(first) else np.zeros(0, bool)
    del odd, after_lead

    space = kind == _SPACE
    before = _shifted(kind, 255)
    was_space = before == _SPACE
    was_space[first] = False
    next_space = np.concatenate([space[1:], [True]])
    last = np.concatenate([first[1:], [n]]) - 1
    ends_text = np.zeros(n, bool)
    ends_text[last] = True
    cut = space & ~was_space
    cut |= space & was_space & ~next_space & ~ends_text
    cut |= ~space & was_space & _shifted(data != 32, False)
    cut |= ~space & ~was_space & (kind != before) & ((before == _LETTER) | (before == _DIGIT) | (kind == _DIGIT))
    if whole.any():
        spans = np.zeros(n + 1, np.int8)
        spans[first[whole]] += 1
        spans[last[whole] + 1] -= 1
        cut &= np.cumsum(spans[:-1], dtype=np.int8) == 0
    cut[first] = True
    return np.flatnonzero(cut)


class Encoder:
    """Encodes batches of texts; strings of special tokens in a text are ordinary text."""

    def __init__(self, definition: str, memo_units: int | None = None):
        from tokenizers import Tokenizer

        self.memo_units = memo_units or MEMO_UNITS
        self.tokenizer = Tokenizer.from_str(definition)
        self.tokenizer.encode_special_tokens = True
        self.splittable = '"ByteLevel"' in definition and self.tokenizer.normalizer is None
        self.reset()

    def reset(self) -> None:
        self.memo: dict[bytes, int] = {}
        self.pool, self.used = np.zeros(1 << 16, np.uint32), 0
        self.first, self.size, self.uses = np.zeros(1 << 12, np.int64), np.zeros(1 << 12, np.int32), np.zeros(1 << 12, np.int64)

    def _forget_rare(self) -> None:
        """Keep the more used half of the memo; what was seen once goes."""
        n = len(self.memo)  # rows are numbered in the memo's order
        best = np.argsort(-self.uses[:n], kind="stable")[: self.memo_units // 2]
        kept = np.zeros(n, bool)
        kept[best[self.uses[best] > 1]] = True
        units, size = list(compress(self.memo, kept.tolist())), self.size[:n][kept]
        ids = self.pool[: self.used][np.repeat(kept, self.size[:n])]  # the pool is in the order of the rows
        self.reset()  # the old memo goes before the new one is built
        self._add(units, size, ids)

    def _add(self, units: list[bytes], size: np.ndarray, ids: np.ndarray) -> np.ndarray:
        """Remember new units, how many ids each has, and all their ids in order; returns their rows."""
        row, n = len(self.memo), len(self.memo) + len(units)
        while self.used + len(ids) > len(self.pool):
            self.pool = np.concatenate([self.pool, np.zeros_like(self.pool)])
        while n > len(self.first):
            self.first, self.size, self.uses = (np.concatenate([x, np.zeros_like(x)]) for x in (self.first, self.size, self.uses))
        self.pool[self.used : self.used + len(ids)] = ids
        self.first[row:n], self.size[row:n] = self.used + np.cumsum(size) - size, size
        self.used += len(ids)
        self.memo.update(zip(units, range(row, n)))
        return np.arange(row, n)

    def _library(self, units: list[bytes]) -> list[list[int]]:
        out = []
        for i in range(0, len(units), 4096):
            part = [u.decode() for u in units[i : i + 4096]]
            out += [code.ids for code in self.tokenizer.encode_batch_fast(part, add_special_tokens=False)]
        return out

    def encode(self, texts: pa.Array | Sequence[str]) -> tuple[np.ndarray, np.ndarray]:
        """(all ids in order, ids per text)."""
        if len(self.memo) > self.memo_units:
            self._forget_rare()
        data, at = _flat(texts)
        starts = unit_starts(data, at) if self.splittable else np.unique(at[:-1][at[:-1] < at[1:]])
        if not len(starts):
            return np.zeros(0, np.uint32), np.zeros(len(at) - 1, np.int64)
        # 32-bit places where they suffice: one for each unit and id, they are most of a batch's memory
        small = len(data) < 2**31
        bounds = np.empty(len(starts) + 1, np.int32 if small else np.int64)
        bounds[:-1], bounds[-1] = starts, len(data)
        edges = np.searchsorted(starts, at)
        del starts
        kind = (pa.BinaryArray, pa.binary()) if small else (pa.LargeBinaryArray, pa.large_binary())
        coded = kind[0].from_buffers(kind[1], len(bounds) - 1, [None, pa.py_buffer(bounds), pa.py_buffer(np.ascontiguousarray(data))]).dictionary_encode()
        distinct, which = coded.dictionary.to_numpy(zero_copy_only=False).tolist(), coded.indices.to_numpy()
        del coded, bounds

        rows = np.fromiter(map(self.memo.get, distinct, (-1,) * len(distinct)), np.int64, len(distinct))
        new = np.flatnonzero(rows < 0)
        long_ids: list[list[int]] = []
        if len(new):
            units = [distinct[k] for k in new.tolist()]
            coded_units = self._library(units)
            size = np.fromiter(map(len, coded_units), np.int64, len(units))
            short = np.fromiter(map(len, units), np.int64, len(units)) <= LONGEST
            kept = compress(coded_units, short.tolist())
            flat = np.fromiter(chain.from_iterable(kept), np.uint32, int(size[short].sum()))
            rows[new[short]] = self._add(list(compress(units, short.tolist())), size[short], flat)
            long_ids = list(compress(coded_units, (~short).tolist()))
            rows[new[~short]] = -1 - np.arange(len(long_ids))
            del units, coded_units
        known = rows >= 0
        self.uses[rows[known]] += np.bincount(which, minlength=len(distinct))[known]
        pool, first, size = self.pool[: self.used], np.zeros(len(rows), np.int64), np.zeros(len(rows), np.int64)
        first[known], size[known] = self.first[rows[known]], self.size[rows[known]]
        if long_ids:
            own = np.fromiter(map(len, long_ids), np.int64, len(long_ids))
            at_own = -1 - rows[~known]
            first[~known], size[~known] = (len(pool) + np.cumsum(own) - own)[at_own], own[at_own]
            pool = np.concatenate([pool, *[np.asarray(x, np.uint32) for x in long_ids]])

        total = int(size @ np.bincount(which, minlength=len(size)))
        place = np.int32 if max(total, len(pool)) < 2**31 else np.int64
        sizes = size.astype(place)[which]
        before = np.zeros(len(sizes) + 1, place)
        np.cumsum(sizes, out=before[1:])
        source = np.repeat(first.astype(place)[which] - before[:-1], sizes)
        source += np.arange(total, dtype=place)
        # a text's ids end where the last unit that begins before its end ends
        return pool[source], np.diff(before[edges].astype(np.int64))


def worker_encoder(definition: str, memo_units: int | None = None) -> Encoder:
    """The worker process's encoder for a tokenizer definition (JSON text, about 1.5 MB, sent with the task)."""
    import hashlib
    import os

    from .common import drop_worker_cache, worker_cache

    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    key = ("encoder", hashlib.md5(definition.encode()).hexdigest(), memo_units)

    def fresh() -> Encoder:
        drop_worker_cache()  # what other operators left
        return Encoder(definition, memo_units)

    return worker_cache(key, fresh)
