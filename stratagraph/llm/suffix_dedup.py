"""Removal of byte strings that also start earlier, by a family of suffix arrays.

The corpus is first reduced, without loss, to what a suffix array can decide:
fragments (runs of 100-byte windows with one minimizer, see ``fragments``)
whose minimizer hash occurs twice.  Before anything is indexed, copies are
aggregated: of fragments with one content (by a 128-bit BLAKE2b digest) all
but the first lose every window, and only the first goes on.  First
occurrences that share a minimizer with other content go to the index family,
partitioned by minimizer hash (equal windows always share it).  Fragments
around a minimizer that meets more than ``HOT`` windows are cut by a second,
independent minimizer first, so that no hash gathers them in one task.

``IndexFamily`` takes them in corpus order as batches.  A batch gets a suffix
array of the suffixes that are at least ``window`` bytes long, ordered to that
depth; it is merge-scanned against the suffix array of every level, where a
match of ``window`` bytes is an earlier start, and then becomes a level
itself.  Levels of one size merge, so that a suffix takes part in a
logarithmic number of merges.  A level holds its text and positions, not
copies of suffixes.  A task's memory is bounded by choosing the number of
partitions from the number of windows.

Order is (doc_id, start); a null id comes first.  Windows of rows with equal
ids have the same coordinates if they start at the same place, so neither is
earlier than the other.  Null
texts are empty; other columns are ignored; an empty table gives an empty one.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stratagraph.llm import fragments as G
from stratagraph.llm import textnum as T
from stratagraph.llm.session import drop, keyed, materialise

WINDOW = 100
GRAM = 20
#: Suffixes of one batch, and about as many windows as one partition holds.
BATCH = 1 << 17
PARTITION = 1 << 19
#: Suffixes of a level that a merge scan looks at together.
BLOCK = 1 << 14
#: Windows around one minimizer from which on its fragments are cut by a second one.
HOT = 1 << 15


class IndexFamily:
    """Suffix arrays (batches, text, positions in suffix order), each level larger than the next."""

    def __init__(self, window: int):
        self.window = window
        self.levels: list[tuple[int, np.ndarray, np.ndarray]] = []

    def _suffixes(self, text: np.ndarray, at: np.ndarray) -> np.ndarray:
        """The first ``window`` bytes of the suffixes at some positions; these bytes order them."""
        rows = np.lib.stride_tricks.sliding_window_view(text, self.window)[at]
        return np.ascontiguousarray(rows).view(f"S{self.window}").ravel()

    def _merge_scan(self, suffixes: np.ndarray, text: np.ndarray, array: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Each sorted suffix's place in a level, and whether the level has a match of ``window`` bytes there."""
        place, match = np.full(len(suffixes), len(array)), np.zeros(len(suffixes), bool)
        done = 0
        for a in range(0, len(array), BLOCK):
            block = self._suffixes(text, array[a : a + BLOCK])
            upto = int(np.searchsorted(suffixes, block[-1], side="right"))
            part = suffixes[done:upto]
            here = np.searchsorted(block, part)
            place[done:upto] = a + here
            match[done:upto] = block[here] == part
            done = upto
        return place, match

    def add(self, data: np.ndarray, starts: np.ndarray, order: np.ndarray) -> np.ndarray:
        """Index a batch; ``order`` ranks coordinates, ascending (equal rank: same coordinates).

        Returns a mask of suffixes whose window starts earlier, in the batch or in a level.
        """
        suffixes = self._suffixes(data, starts)
        array = np.argsort(suffixes, kind="stable")  # ties stay in corpus order
        suffixes, rank = suffixes[array], order[array]
        head = np.ones(len(array), bool)
        head[1:] = suffixes[1:] != suffixes[:-1]
        group = np.cumsum(head) - 1
        earlier = rank > rank[head][group]
        suffixes, at = suffixes[head], starts[array[head]]
        known = np.zeros(len(at), bool)
        for _, text, level in self.levels:
            known |= self._merge_scan(suffixes, text, level)[1]
        earlier |= known[group]
        self._push(data, at[~known], suffixes[~known])
        out = np.empty(len(earlier), bool)
        out[array] = earlier
        return out

    def _push(self, text: np.ndarray, array: np.ndarray, suffixes: np.ndarray) -> None:
        """A batch's new suffixes become a level; levels that aren't larger merge into it."""
        if not len(array):
            return
        size, text = 1, text.copy()
        while self.levels and self.levels[-1][0] <= size:
            had, old, level = self.levels.pop()
            # No suffix is in both: what a level knew was dropped from the batch.
            place = self._merge_scan(suffixes, old, level)[0]
            array = np.insert(level, place, array + len(old))
            text, size = np.concatenate([old, text]), had + size
            if self.levels and self.levels[-1][0] <= size:
                suffixes = self._suffixes(text, array)
        self.levels.append((size, text, array))


def _binary(data: np.ndarray, starts: np.ndarray, sizes: np.ndarray) -> pa.Array:
    """The byte strings at ``starts``."""
    at = np.concatenate([[0], np.cumsum(sizes)])
    place = np.arange(int(at[-1])) + np.repeat(starts - at[:-1], sizes)
    return pa.Array.from_buffers(pa.large_binary(), len(starts), [None, pa.py_buffer(at.astype(np.int64)), pa.py_buffer(np.ascontiguousarray(data[place]))]).cast(pa.binary())


def _content(docs: DataFrame, window: int, gram: int) -> DataFrame:
    """The bytes of the fragments in ``spans`` (h, start, cnt, hot), cut again by a second minimizer where hot."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a, b, data, offsets in T.runs(batch.column("text")):
                lists = batch.column("spans").slice(a, b - a)
                row = np.repeat(np.arange(b - a), np.array(lists.value_lengths().to_pylist(), np.int64))
                flat = lists.flatten()
                start, count, h, hot = (flat.field(f).to_numpy(zero_copy_only=False) for f in ("start", "cnt", "h", "hot"))
                if hot.any():
                    # Equal windows have the same second minimizer too.
                    at, size = offsets[row[hot]] + start[hot], count[hot] + window - 1
                    inner = np.concatenate([[0], np.cumsum(size)])
                    content = data[np.arange(inner[-1]) + np.repeat(at - inner[:-1], size)]
                    piece, h2, place, n = G.cut(G.Units("byte", content, inner).values, inner, window, gram, G.SECOND)
                    cool = ~hot
                    row = np.concatenate([row[cool], row[hot][piece]])
                    start = np.concatenate([start[cool], start[hot][piece] + place - inner[piece]])
                    h = np.concatenate([h[cool], T.mix(h[hot][piece].view(np.uint64) ^ h2).view(np.int64)])
                    count = np.concatenate([count[cool], n])
                take = pa.array(row + a)
                yield pa.RecordBatch.from_arrays(
                    [batch.column("doc_id").take(take), batch.column("k").take(take), pa.array(h), pa.array(start), _binary(data, offsets[row] + start, count + window - 1)],
                    names=["doc_id", "k", "h", "start", "content"],
                )

    return docs.mapInArrow(run, "doc_id long, k long, h long, start long, content binary")


def _scan(content: DataFrame, window: int) -> DataFrame:
    """Removed windows of fragments that come in corpus order, partitioned by minimizer."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        family, held, waiting = IndexFamily(window), [], 0

        def flush(last: bool) -> tuple[pa.RecordBatch, list[pa.RecordBatch]]:
            """Earlier windows, and the fragments that later ones may still overlap.

            Texts that share an id overlap in coordinates, so only windows before
            the last fragment are decided as long as others may come.
            """
            batch = pa.Table.from_batches(held).combine_chunks()
            data, offsets = T.buffers(batch["content"])
            data, offsets = data[offsets[0] : offsets[-1]], offsets - offsets[0]
            count = np.diff(offsets) - window + 1
            row = np.repeat(np.arange(len(count)), count)
            place = np.arange(len(row)) - np.repeat(np.cumsum(count) - count, count)
            ids, start = batch["doc_id"], batch["start"].to_numpy()
            docs = np.where(np.asarray(ids.is_null()), np.iinfo(np.int64).min, ids.fill_null(0).to_numpy())
            at = start[row] + place
            until = np.where(last | (docs != docs[-1]), count, np.clip(start[-1] - start, 0, count))
            pick = np.lexsort((at, docs[row]))  # corpus order of single windows
            pick = pick[(place < until[row])[pick]]
            d, p = docs[row][pick], at[pick]
            rank = np.zeros(len(pick), np.int64)
            rank[1:] = np.cumsum((d[1:] != d[:-1]) | (p[1:] != p[:-1]))
            gone = pick[np.flatnonzero(family.add(data, (offsets[row] + place)[pick], rank))] if len(pick) else pick
            rest = np.flatnonzero(until < count)
            keep = [batch.take(pa.array(rest)).combine_chunks().to_batches()[0]] if len(rest) else []
            if keep:
                cut = [data[offsets[i] + until[i] : offsets[i + 1]].tobytes() for i in rest.tolist()]
                moved = {"start": pa.array(start[rest] + until[rest]), "content": pa.array(cut, pa.binary())}
                keep = [pa.RecordBatch.from_arrays([moved.get(c, keep[0].column(c)) for c in keep[0].schema.names], schema=keep[0].schema)]
            gone.sort()
            new = np.ones(len(gone), bool)
            new[1:] = (gone[1:] != gone[:-1] + 1) | (row[gone[1:]] != row[gone[:-1]])
            head = np.flatnonzero(new)
            length = np.diff(np.append(head, len(gone))) + window - 1
            take = pa.array(row[gone[head]])
            return pa.RecordBatch.from_arrays([ids.combine_chunks().take(take), batch["k"].combine_chunks().take(take), pa.array(at[gone[head]]), pa.array(length.astype(np.int64))], names=["doc_id", "k", "start", "length"]), keep

        for batch in batches:
            data, offsets = T.buffers(batch.column("content"))
            a = 0
            sizes = np.concatenate([[0], np.cumsum(np.diff(offsets) - window + 1)])
            while a < len(batch):
                b = min(len(batch), max(a + 1, int(np.searchsorted(sizes, sizes[a] + BATCH - waiting))))
                held.append(batch.slice(a, b - a))
                waiting += int(sizes[b] - sizes[a])
                a = b
                if waiting >= BATCH:
                    out, held = flush(False)
                    waiting = 0
                    yield out
        if held:
            yield flush(True)[0]

    return content.mapInArrow(run, "doc_id long, k long, start long, length long")


def earlier_spans(docs: DataFrame, window: int = WINDOW, gram: int = GRAM) -> DataFrame:
    """(doc_id, k, start, length): byte spans of ``keyed`` documents that also start earlier."""
    found = G.candidates(docs, "byte", window, gram)
    same = ["h", "d1", "d2", "cnt"]
    first = found.groupBy(*same).agg(F.min(F.struct("doc_id", "start", "k")).alias("source"), F.count("*").alias("n"), (F.min("k") != F.max("k")).alias("mixed"))
    first = materialise(first, "first")
    copies = found.join(first.where("n > 1").select(*same, "source"), same)
    later = ~(F.col("doc_id").eqNullSafe(F.col("source.doc_id")) & (F.col("start") == F.col("source.start")))
    copies = materialise(copies.where(later).select("doc_id", "k", "start", (F.col("cnt") + window - 1).cast("long").alias("length")), "copies")
    branching = first.groupBy("h").agg(F.count("*").alias("variants"), F.sum("cnt").alias("windows")).where("variants > 1")
    branching = materialise(branching.select("h", "windows", (F.col("windows") > HOT).alias("hot")), "branching")
    total = branching.agg(F.sum("windows")).first()[0] or 0
    parts = max(docs.sparkSession.sparkContext.defaultParallelism, -(-total // PARTITION))
    branching = branching.select("h", "hot")
    opened = first.join(branching, "h").select("source.doc_id", "source.k", F.struct("h", "source.start", "cnt", "hot").alias("span"))
    mixed = first.where("mixed")
    if not mixed.isEmpty():
        # Texts of one id that have a fragment at the source's place are no copies: their windows are looked at like its own.
        tied = found.join(mixed.join(branching, "h").select(*same, "source", "hot"), same).where(~later & (F.col("k") != F.col("source.k")))
        opened = opened.unionByName(tied.select("doc_id", "k", F.struct("h", "start", "cnt", "hot").alias("span")).distinct())
    opened = materialise(opened.groupBy("doc_id", "k").agg(F.collect_list("span").alias("spans")), "opened")
    drop(found, first)
    content = _content(G.with_spans(docs, opened, "inner"), window, gram)
    content = content.repartition(int(parts), "h").sortWithinPartitions("doc_id", "start")
    scanned = materialise(_scan(content, window), "earlier")
    drop(opened)
    return copies.unionByName(scanned)


def remove_earlier(documents: DataFrame, window: int = WINDOW, gram: int = GRAM, want_text: bool = False) -> DataFrame:
    """Documents without the bytes that windows which also start earlier cover.

    Returns doc_id, n_bytes, n_removed, n_spans, kept_sha256 and, on demand, ``kept`` (binary).
    """
    docs = keyed(documents)
    spans = G.spans_by_document(earlier_spans(docs, window, gram))
    out = G.remove(G.with_spans(docs, spans), "byte", want_text)
    return out.select("doc_id", F.col("n_units").alias("n_bytes"), "n_removed", "n_spans", "kept_sha256", *(["kept"] if want_text else []))
