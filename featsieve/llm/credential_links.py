"""Operator 8: multipart credential linking.

Strong parts are found by pattern alone. Weak parts (login names, bare high-entropy strings, endpoints) are common and
mostly harmless; one is reported only if a complementary part lies at most ``reach`` code points from it, or on another line
of its block of settings, or in its innermost braces: an identifier or an endpoint needs a secret, a bare secret needs an
identifier or an endpoint. The interval join runs over the parts of one text in the order of their starts, so it needs no shuffle and its work grows with the parts, not with their pairs.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F

from .common import sliced, text_or_empty

REACH = 240
KINDS = ("assign", "access", "hex", "login", "bare", "endpoint")

# The base patterns and the least length of what they must match.
_ASSIGN = re.compile(r"""(?ai:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""")
_ACCESS = re.compile(r"AKIA[A-Z0-9]+")
_HEX = re.compile(r"[0-9a-f]{32,}")
_ASSIGN_LEAST, _ACCESS_LEAST = 8, 16

_LOGIN = re.compile(r"""(?ai:user(?:name)?|login|account|client_?id|access_?key_?id)["']?\x20*[:=]\x20*["']?[A-Za-z0-9@_.+-]{3,}""")
_BARE = re.compile(r"[A-Za-z0-9+/_-]{20,}={0,2}")
_ENDPOINT = re.compile(r"[a-z][a-z0-9+.-]{1,20}://[^\s\"'<>]{4,}|(?<![0-9.])(?:[0-9]{1,3}\.){3}[0-9]{1,3}(?::[0-9]{2,5})?(?![0-9.])")


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, kind, end) of the strong parts, each kind leftmost and not overlapping itself."""
    spans = [(m.start(), 0, m.end()) for m in _ASSIGN.finditer(text) if m.end(1) - m.start(1) >= _ASSIGN_LEAST]
    if "AKIA" in text:
        spans += [(m.start(), 1, m.end()) for m in _ACCESS.finditer(text) if m.end() - m.start() >= _ACCESS_LEAST]
    spans += [(m.start(), 2, m.end()) for m in _HEX.finditer(text)]
    return sorted(spans)


def _mixed(word: str) -> bool:
    """A bare string that looks drawn at random: digits, and letters of both cases or a hexadecimal run."""
    return any(c.isdigit() for c in word) and any(c.islower() for c in word) and any(c.isupper() for c in word)


def weak_spans(text: str, taken: list[tuple[int, int, int]]) -> list[tuple[int, int, int]]:
    """Weak candidates that no strong part overlaps."""
    found = [(m.start(), 3, m.end()) for m in _LOGIN.finditer(text)]
    found += [(m.start(), 4, m.end()) for m in _BARE.finditer(text) if _mixed(m.group())]
    found += [(m.start(), 5, m.end()) for m in _ENDPOINT.finditer(text)]
    if not found or not taken:
        return sorted(found)
    starts = np.asarray([s for s, _, _ in taken])
    last_end = np.maximum.accumulate([e for _, _, e in taken])
    before = np.searchsorted(starts, [e for _, _, e in found], "left") - 1
    return sorted(x for x, i in zip(found, before.tolist()) if i < 0 or last_end[i] <= x[0])


def linked(strong: list[tuple[int, int, int]], weak: list[tuple[int, int, int]], reach: int = REACH) -> list[tuple[int, int, int]]:
    """Weak candidates with a complementary part whose start is at most ``reach`` from theirs."""
    if not weak:
        return []
    parts = strong + weak
    secrets = np.sort([s for s, k, _ in parts if k in (0, 2, 4)])
    others = np.sort([s for s, k, _ in parts if k in (1, 3, 5)])

    def near(sorted_starts: np.ndarray, start: int) -> bool:
        return bool(np.searchsorted(sorted_starts, start + reach, "right") > np.searchsorted(sorted_starts, start - reach, "left"))

    return [x for x in weak if near(others if x[1] == 4 else secrets, x[0])]


_SETTING = re.compile(r"""[ \t]*(?:[-*][ \t]+)?(?:export[ \t]+)?["']?[A-Za-z_][\w.-]*["']?[ \t]*[:=].*|[ \t]*[\[({})\],;]+[ \t]*|[ \t]*(?:#|//|;).*|[ \t]*\[[\w.: -]+\][ \t]*""")


def _blocks(text: str, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of each start: its line, its run of setting lines and its innermost closed braces (-1 where there is none)."""
    first, run, at, last = [], [], 0, -1
    for i, line in enumerate(text.split("\n")):
        first.append(at)
        at += len(line) + 1
        if not _SETTING.fullmatch(line.rstrip("\r")):
            last = -1
        elif last < 0:
            last = i
        run.append(last)
    line_of = np.searchsorted(first, starts, "right") - 1
    closed, opened = [], []
    for m in re.finditer("[{}]", text):
        if m.group() == "{":
            opened.append(m.start())
        elif opened:
            closed.append((opened.pop(), m.start()))
    edges = sorted([(a, a) for a, _ in closed] + [(b, -1) for _, b in closed])
    places, owner, inside = [e for e, _ in edges], [], []
    for _, mark in edges:
        inside.append(mark) if mark >= 0 else inside.pop()
        owner.append(inside[-1] if inside else -1)
    braces = np.asarray([-1, *owner])[np.searchsorted(places, starts, "right")]
    return line_of, np.asarray(run)[line_of], braces


def linked_parts(text: str, strong: list[tuple[int, int, int]], weak: list[tuple[int, int, int]], reach: int = REACH) -> list[tuple[int, int, int]]:
    """Weak candidates with a complementary part at most ``reach`` from end to start, or in the same block."""
    if not weak:
        return []
    parts = sorted(strong + weak)
    spans = np.asarray(parts, np.int64)
    secret = np.isin(spans[:, 1], (0, 2, 4))
    if secret.all() or not secret.any():
        return []
    line, run, braces = _blocks(text, spans[:, 0])
    near = np.zeros(len(spans), bool)
    for own in (secret, ~secret):
        other = spans[~own]
        reached = np.concatenate([[-reach - 1], np.maximum.accumulate(other[:, 2])])
        near[own] = reached[np.searchsorted(other[:, 0], spans[own, 2] + reach, "right")] >= spans[own, 0] - reach
        near[own] |= (braces[own] >= 0) & np.isin(braces[own], braces[~own])
        lines: dict[int, set[int]] = {}
        for r, at in zip(run[~own].tolist(), line[~own].tolist()):
            lines.setdefault(r, set()).add(at)
        near[own] |= [r >= 0 and bool(x := lines.get(r)) and (len(x) > 1 or at not in x) for r, at in zip(run[own].tolist(), line[own].tolist())]
    chosen = {x for x, n in zip(parts, near.tolist()) if n}
    return [x for x in weak if x in chosen]


def joined(spans: list[tuple[int, int, int]]) -> str:
    return ",".join(f"{KINDS[k]}:{s}:{e}" for s, k, e in sorted(spans))


def redacted(text: str, spans: list[tuple[int, int, int]], mark: str = "[SECRET]") -> str:
    """The text with every maximal run of overlapping spans replaced by ``mark``."""
    out, at = [], 0
    for start, _, end in sorted(spans):
        if end <= at:
            continue
        if start >= at:
            out += [text[at:start], mark]
        at = end
    return "".join([*out, text[at:]])


def scan_secrets(docs: DataFrame, reach: int = REACH, carried: list[str] | None = None, safe: bool = True) -> DataFrame:
    """Columns ``carried`` of ``docs`` (all by default) and n_assign, n_access, n_hex, base, spans and, if ``safe``, safe_text.

    ``base`` and ``spans`` are kind:start:end in code points, joined by commas in the order of start, then kind; safe_text is the
    text without what ``spans`` covers, null for a null text. Added columns replace the input's of the same names. A null or
    empty text has no spans; texts are read whole; repeated rows give repeated results; an empty table gives no rows.
    """
    added = ["n_assign", "n_access", "n_hex", "base", "spans", *(["safe_text"] if safe else [])]
    kept = [c for c in (docs.columns if carried is None else carried) if c not in added]
    read = kept if "text" in kept else [*kept, "text"]
    rows = docs.select(*[F.col("text").cast("string").alias("text") if c == "text" else F.col(f"`{c}`") for c in read])

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in sliced(batches, "text"):
            out: dict[str, list] = {c: [] for c in added}
            for text in batch.column(batch.schema.get_field_index("text")).to_pylist():
                strong = base_spans(text or "")
                spans = strong + linked_parts(text or "", strong, weak_spans(text or "", strong), reach)
                for i, c in enumerate(added[:3]):
                    out[c].append(sum(k == i for _, k, _ in strong))
                out["base"].append(joined(strong))
                out["spans"].append(joined(spans))
                if safe:
                    out["safe_text"].append(redacted(text, spans) if text is not None and spans else text)
            new = [pa.array(out[c], pa.int64() if c.startswith("n_") else pa.string()) for c in added]
            yield pa.RecordBatch.from_arrays([batch.column(i) for i in range(len(kept))] + new, names=[*kept, *added])

    schema = rows.select(*[f"`{c}`" for c in kept]).schema
    for c in added:
        schema = schema.add(c, "long" if c.startswith("n_") else "string")
    return rows.mapInArrow(scan, schema)


def op8_credential_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return scan_secrets(docs, carried=["doc_id"], safe=False).select("doc_id", "n_assign", "n_access", "n_hex", F.sha2("base", 256).alias("base_sha256"), "spans")

