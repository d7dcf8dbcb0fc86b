"""Fragments: runs of consecutive k-windows that share one minimizer.

For windows of ``k`` units (words or bytes), the minimizer of a window is the
leftmost q-gram with the smallest hash among its ``k - q + 1`` q-grams.  Equal
windows have the same minimizer at the same place, so

* a window can be repeated only where its minimizer hash is, and
* consecutive windows with one minimizer place form a *fragment* (about one
  for each ``(k - q) / 2`` units) that can be shuffled instead of them.

Two occurrences of a fragment with the same content (by a 128-bit BLAKE2b
digest of it) have all windows in common.  Only fragments that share a
minimizer hash and differ in content need a look at single windows.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stratagraph.llm import textnum as T
from stratagraph.llm.session import drop, materialise

BASE = 0xC2B2AE3D27D4EB4F | 1
#: Another order of minimizers, for those that meet too many fragments.
SECOND = 0x165667B19E3779F9 | 1
#: 64-bit values of single bytes, for byte windows.
_BYTE_VALUE = T.mix((np.arange(256, dtype=np.uint64) + np.uint64(1)) * np.uint64(0x9E3779B97F4A7C15))

FRAGMENT = "doc_id long, k long, h long, d1 long, d2 long, start long, cnt int"


class Units:
    """The units (words or bytes) of a run of documents.

    ``values`` are 64-bit hashes, ``first`` is each document's first unit, and
    unit i is ``raw[place[i]:place[i + 1]]`` (a word with one space after it).
    """

    def __init__(self, unit: str, data: np.ndarray, offsets: np.ndarray):
        if unit == "byte":
            self.values, self.first, self.raw, self.place = _BYTE_VALUE[data], offsets, data, None
            return
        starts, ends, self.first = T.words(data, offsets)
        self.values = T.hash_spans(data, starts, ends)
        self.raw = _pack(data, starts, ends, 1)
        self.place = np.concatenate([[0], np.cumsum(ends - starts + 1)])

    def digests(self, starts: np.ndarray, stops: np.ndarray) -> tuple[pa.Array, pa.Array]:
        """128-bit BLAKE2b digests of the content of spans of units, as two columns."""
        a, b = (starts, stops) if self.place is None else (self.place[starts], self.place[stops])
        view = memoryview(np.ascontiguousarray(self.raw))
        made = b"".join([hashlib.blake2b(view[x:y], digest_size=16).digest() for x, y in zip(a.tolist(), b.tolist())])
        both = np.frombuffer(made, np.int64).reshape(-1, 2)
        return pa.array(np.ascontiguousarray(both[:, 0])), pa.array(np.ascontiguousarray(both[:, 1]))


def _window_starts(first: np.ndarray, k: int, n: int) -> np.ndarray:
    size = np.diff(first)
    change = np.zeros(n + 1, np.int32)
    has = size >= k
    np.add.at(change, first[:-1][has], 1)
    np.add.at(change, first[1:][has] - k + 1, -1)
    return np.flatnonzero(np.cumsum(change[:n]) > 0)


def cut(values: np.ndarray, first: np.ndarray, k: int, q: int, base: int = BASE) -> tuple[np.ndarray, ...]:
    """(document row, h, first unit, windows) of each fragment."""
    empty = (np.zeros(0, np.int64), np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, np.int64))
    if len(values) < k:
        return empty
    grams = T.Rolling(values, base).windows(q)
    least = T.sliding_min(grams, k - q + 1)
    at = _window_starts(first, k, len(values))
    if not len(at):
        return empty
    new = np.ones(len(at), bool)
    before, here = at[:-1], at[1:]
    new[1:] = (here != before + 1) | (grams[before] == least[before]) | (least[here] < least[before])
    begin = np.flatnonzero(new)
    count = np.diff(np.append(begin, len(at)))
    start = at[begin]
    # Window starts of two documents are never neighbours, so a document's first window begins a fragment.
    return np.searchsorted(first, start, side="right") - 1, least[start], start, count


def fragments(docs: DataFrame, unit: str, k: int, q: int) -> DataFrame:
    """All fragments of (doc_id, k, text) rows as ``FRAGMENT``."""
    window = k

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, keys = batch.column("doc_id"), batch.column("k")
            for a, _, data, offsets in T.runs(batch.column("text")):
                u = Units(unit, data, offsets)
                row, h, at, count = cut(u.values, u.first, window, q)
                if len(row):
                    take = pa.array(row + a)
                    yield pa.RecordBatch.from_arrays(
                        [ids.take(take), keys.take(take), pa.array(h.view(np.int64)), *u.digests(at, at + count + window - 1), pa.array(at - u.first[row]), pa.array(count.astype(np.int32))],
                        names=["doc_id", "k", "h", "d1", "d2", "start", "cnt"],
                    )

    return docs.select("doc_id", "k", "text").mapInArrow(run, FRAGMENT)


def _minimizers(docs: DataFrame, unit: str, k: int, q: int) -> DataFrame:
    """(h, n): how often each minimizer hash is in a run of documents."""
    window = k

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for _, _, data, offsets in T.runs(batch.column("text")):
                u = Units(unit, data, offsets)
                h, n = np.unique(cut(u.values, u.first, window, q)[1], return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array(h.view(np.int64)), pa.array(n)], names=["h", "n"])

    return docs.select("text").mapInArrow(run, "h long, n long")


def candidates(docs: DataFrame, unit: str, k: int, q: int) -> DataFrame:
    """Fragments whose minimizer hash occurs more than once, written; nothing repeated is outside them."""
    # Written first, so that Spark can split a very frequent hash in the join.
    repeated = materialise(_minimizers(docs, unit, k, q).groupBy("h").agg(F.sum("n").alias("n")).where("n > 1").select("h"), "repeated")
    found = materialise(fragments(docs, unit, k, q).join(repeated, "h"), "fragments")
    drop(repeated)
    return found


def spans_by_document(spans: DataFrame) -> DataFrame:
    """(doc_id, k, start, length) rows -> one row a document with the list of its spans."""
    return spans.groupBy("doc_id", "k").agg(F.collect_list(F.struct("start", "length")).alias("spans"))


def with_spans(docs: DataFrame, spans: DataFrame, how: str = "left", extra: tuple[str, ...] = ()) -> DataFrame:
    """Documents with ``spans`` (and the columns ``extra``); a null id equals a null id."""
    s = spans.withColumnRenamed("doc_id", "_d").withColumnRenamed("k", "_k")
    return docs.join(s, (docs["k"] == s["_k"]) & docs["doc_id"].eqNullSafe(s["_d"]), how).select("doc_id", "k", "text", "spans", *extra)


def _flat(column: pa.Array, a: int, b: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    part = column.slice(a, b - a)
    sizes = np.array([0 if s is None else s for s in part.value_lengths().to_pylist()], np.int64)
    flat = part.flatten()
    return np.repeat(np.arange(b - a), sizes), flat.field("start").to_numpy(zero_copy_only=False), flat.field("length").to_numpy(zero_copy_only=False)


def _pack(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, pad: int) -> np.ndarray:
    """The bytes of the spans one after the other, ``pad`` spaces after each."""
    lengths = ends - starts
    width = lengths + pad
    first = np.cumsum(width) - width
    out = np.full(int(width.sum()), 32, np.uint8)
    place = np.arange(int(lengths.sum())) - np.repeat(np.cumsum(lengths) - lengths, lengths)
    out[place + np.repeat(first, lengths)] = data[place + np.repeat(starts, lengths)]
    return out


def remove(docs: DataFrame, unit: str, want_text: bool = False, extra: tuple[str, ...] = ()) -> DataFrame:
    """Apply ``spans``: sizes, removed units, removed runs, digest of what is kept (and the kept text)."""
    schema = "doc_id long, k long, n_units long, n_removed long, n_spans long, kept_sha256 string" + ", kept binary" * want_text
    schema += "".join(f", `{f.name}` {f.dataType.simpleString()}" for f in docs.select(*extra).schema.fields)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a, b, data, offsets in T.runs(batch.column("text")):
                if unit == "byte":
                    starts, first = None, offsets
                    n = len(data)
                else:
                    starts, ends, first = T.words(data, offsets)
                    n = len(starts)
                row, at, length = _flat(batch.column("spans"), a, b)
                gone = T.covered(first[row] + at, length, n)
                total = np.concatenate([[0], np.cumsum(gone)])
                removed = total[first[1:]] - total[first[:-1]]
                opens = gone.copy()
                opens[1:] &= ~gone[:-1]
                inner = first[(first < n)]
                opens[inner] = gone[inner]
                runs_ = np.concatenate([[0], np.cumsum(opens)])
                n_spans = runs_[first[1:]] - runs_[first[:-1]]
                keep = ~gone
                kept_before = np.concatenate([[0], np.cumsum(keep)])[first]
                if unit == "byte":
                    out, edge, pad = data[keep], kept_before, 0
                else:
                    s, e = starts[keep], ends[keep]
                    out, pad = _pack(data, s, e, 1), 1
                    edge = np.concatenate([[0], np.cumsum(e - s + 1)])[kept_before]
                view = memoryview(np.ascontiguousarray(out))
                texts = [view[x : max(x, y - pad)] for x, y in zip(edge[:-1].tolist(), edge[1:].tolist())]
                columns = [batch.column("doc_id").slice(a, b - a), batch.column("k").slice(a, b - a), pa.array(np.diff(first)), pa.array(removed), pa.array(n_spans), pa.array([hashlib.sha256(t).hexdigest() for t in texts])]
                names = ["doc_id", "k", "n_units", "n_removed", "n_spans", "kept_sha256"]
                if want_text:
                    columns.append(pa.array([t.tobytes() for t in texts], pa.binary()))
                    names.append("kept")
                yield pa.RecordBatch.from_arrays([*columns, *(batch.column(c).slice(a, b - a) for c in extra)], names=[*names, *extra])

    return docs.mapInArrow(run, schema)
