"""Best-fit packing of tokenised documents by linear grouping.

One pass encodes every document, cuts those that are too long and counts each
task's pieces by length.  The plan then needs only the number of pieces of
each length (at most ``capacity`` numbers, however large the corpus):

1. pieces as long as a sequence take one each;
2. other large lengths (over ``capacity / SMALL``) are sorted and dealt into
   ``GROUPS`` groups of equal cardinality, each rounded up to its largest;
3. a linear program over configurations of the few rounded sizes is solved by
   column generation (a knapsack for each new configuration), its whole parts are used;
4. actual lengths take the groups' places, group by group;
5. what is left and all small lengths are put where they fit best, longest first.

Equal bins are one class with a multiplicity all the way, so the plan's size
depends on the number of different lengths only.  Its segments ("pieces of
length l with rank a to b") are broadcast, and every piece finds its place
from its rank among the pieces of its length: the number of its length in
earlier tasks and in its own.  No task sees more than its own pieces.

Defined results: null and empty texts are one end token; repeated rows are
documents of their own; other columns are ignored; an empty table gives an
empty table.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from stratagraph.llm import bpe
from stratagraph.llm.session import materialise, small_batches

CAPACITY = 4096
END = 1
GROUPS = 24
SMALL = 8
MAX_COLUMNS = 400

#: Bins with the same content: number, free room, runs of (length, how many).
Bins = tuple[int, int, tuple[tuple[int, int], ...]]


def knapsack(sizes: np.ndarray, worth: np.ndarray, capacity: int) -> tuple[float, np.ndarray]:
    """The configuration (count of each size) of the most worth."""
    best = np.zeros(capacity + 1)
    choice = np.full(capacity + 1, -1)
    low = int(sizes.min())
    for room in range(low, capacity + 1):
        fits = sizes <= room
        value = np.where(fits, best[np.maximum(room - sizes, 0)] + worth, 0.0)
        i = int(value.argmax())
        if value[i] > best[room - 1] + 1e-12:
            best[room], choice[room] = value[i], i
        else:
            best[room] = best[room - 1]
    out, room = np.zeros(len(sizes), np.int64), capacity
    while room >= low:
        if choice[room] < 0:
            room -= 1
        else:
            out[choice[room]] += 1
            room -= int(sizes[choice[room]])
    return float(best[capacity]), out


def configurations(sizes: np.ndarray, demand: np.ndarray, capacity: int) -> list[tuple[int, np.ndarray]]:
    """(how many bins, configuration): whole parts of a basic solution of the configuration program."""
    k = len(sizes)
    basis = np.diag(capacity // sizes).astype(float)
    for _ in range(MAX_COLUMNS):
        inverse = np.linalg.inv(basis)
        worth, column = knapsack(sizes, np.maximum(np.ones(k) @ inverse, 0), capacity)
        if worth <= 1 + 1e-9:
            break
        level, direction = inverse @ demand, inverse @ column
        with np.errstate(divide="ignore", invalid="ignore"):
            ratio = np.where(direction > 1e-9, level / direction, np.inf)
        basis[:, int(ratio.argmin())] = column
    level = np.linalg.solve(basis, demand)
    return [(int(x + 1e-7), basis[:, i].round().astype(np.int64)) for i, x in enumerate(level) if x >= 1 - 1e-7]


def _take(queue: list[list[int]], n: int) -> list[tuple[int, int]]:
    """The next n pieces of a queue of (length, count), as such runs."""
    out = []
    while n and queue:
        length, have = queue[-1]
        m = min(n, have)
        out.append((length, m))
        n -= m
        if m == have:
            queue.pop()
        else:
            queue[-1][1] -= m
    return out


def plan(lengths: dict[int, int], capacity: int = CAPACITY, groups: int = GROUPS) -> list[Bins]:
    """Classes of equal bins that hold ``lengths`` (length: number of pieces)."""
    left = {x: n for x, n in lengths.items() if n}
    done: list[Bins] = []
    if n := left.pop(capacity, 0):
        done.append((n, 0, ((capacity, 1),)))
    large = sorted((x for x in left if x > capacity // SMALL), reverse=True)
    total = sum(left[x] for x in large)
    open_: list[Bins] = []
    if total:
        share = -(-total // groups)
        queues: list[list[list[int]]] = []
        runs = [[x, left.pop(x)] for x in reversed(large)]
        while runs:
            queues.append([[x, m] for x, m in reversed(_take(runs, share))])
        sizes = np.array([q[-1][0] for q in queues])
        demand = np.array([sum(m for _, m in q) for q in queues], float)
        # Equal roundings are one size for the program; their queues follow each other.
        distinct = sorted(set(sizes.tolist()), reverse=True)
        merged = [[r for q, s in zip(reversed(queues), reversed(sizes)) if s == d for r in q] for d in distinct]
        need = np.array([demand[sizes == d].sum() for d in distinct])
        for bins, column in configurations(np.array(distinct), need, capacity):
            parts: list[Bins] = [(bins, capacity, ())]
            for size, times in enumerate(column.tolist()):
                for _ in range(times):
                    parts = _fill(parts, merged[size])
            open_ += parts
        for queue in merged:
            for x, m in queue:
                left[x] = left.get(x, 0) + m
    return done + _best_fit(open_, left, capacity)


def _fill(parts: list[Bins], queue: list[list[int]]) -> list[Bins]:
    """One piece from the queue into each bin, as far as there are some; a change of length splits a class."""
    out: list[Bins] = []
    for bins, room, runs in parts:
        for x, m in _take(queue, bins):
            out.append((m, room - x, _with(runs, x, 1)))
            bins -= m
        if bins:
            out.append((bins, room, runs))
    return out


def _with(runs: tuple[tuple[int, int], ...], length: int, n: int) -> tuple[tuple[int, int], ...]:
    if runs and runs[-1][0] == length:
        return (*runs[:-1], (length, runs[-1][1] + n))
    return (*runs, (length, n))


def _best_fit(open_: list[Bins], left: dict[int, int], capacity: int) -> list[Bins]:
    """Longest first, each into the fullest bin that has room, or into a new one."""
    by_room: list[list[Bins]] = [[] for _ in range(capacity + 1)]
    for b in open_:
        by_room[b[1]].append(b)
    used = np.array([bool(x) for x in by_room])
    for x in sorted(left, reverse=True):
        n = left[x]
        while n:
            at = x + int(used[x:].argmax()) if used[x:].any() else -1
            bins, room, runs = by_room[at].pop() if at >= 0 else (-(-n // (capacity // x)), capacity, ())
            each = room // x
            full, rest = min(bins, n // each), 0
            if full < bins and n - full * each:
                rest = min(n - full * each, each)
            for m, k in ((full, each), (int(rest > 0), rest), (bins - full - (rest > 0), 0)):
                if m:
                    to = room - k * x
                    if k or runs:
                        by_room[to].append((m, to, _with(runs, x, k) if k else runs))
                        used[to] = True
            if at >= 0:
                used[at] = bool(by_room[at])
            n -= full * each + rest
    return [b for bins in by_room for b in bins]


def segments(bins: list[Bins]) -> dict[str, np.ndarray]:
    """Where the pieces of each length go, by their rank: sorted by (length, first rank)."""
    rank: dict[int, int] = {}
    rows, sequence = [], 0
    for n, _, runs in bins:
        offset = 0
        for x, k in runs:
            rows.append((x, rank.get(x, 0), sequence, offset, k))
            rank[x] = rank.get(x, 0) + n * k
            offset += x * k
        sequence += n
    table = np.array(sorted(rows), np.int64).reshape(-1, 5)
    return {"key": (table[:, 0] << 48) | table[:, 1], **{name: table[:, i] for i, name in enumerate(("length", "rank", "sequence", "offset", "each"))}}


def pieces(documents: DataFrame, path: str, capacity: int = CAPACITY, end: int = END) -> DataFrame:
    """All pieces, with the task that made them and their rank among its pieces of that length."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = bpe.load(path)
        tail = end.to_bytes(4, "little")
        task, seen = TaskContext.get().partitionId(), {}
        for batch in batches:
            for at in range(0, len(batch), 1024):
                part = batch.slice(at, 1024)
                row, rows = [], []
                for i, text in enumerate(part.column("text").to_pylist()):
                    ids = coder.packed(text or "") + tail
                    n = len(ids) // 4
                    for k, start in enumerate(range(0, n, capacity)):
                        size = min(capacity, n - start)
                        rank = seen[size] = seen.get(size, -1) + 1
                        row.append(i)
                        rows.append((k, start, size, zlib.crc32(ids[4 * start : 4 * (start + size)]), task, rank))
                kinds = (pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int64())
                yield pa.RecordBatch.from_arrays([part.column("doc_id").take(pa.array(row)), *(pa.array(c, k) for c, k in zip(zip(*rows), kinds))], names=["doc_id", "piece", "start", "length", "ids_crc32", "task", "rank"])

    docs = small_batches(documents).select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    return docs.mapInArrow(run, "doc_id long, piece int, start long, length long, ids_crc32 long, task int, rank long")


def pack(documents: DataFrame, path: str, capacity: int = CAPACITY, end: int = END) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32, sequence_id, offset for each piece."""
    made = materialise(pieces(documents, path, capacity, end), "pieces")
    counts = made.groupBy("task", "length").agg(F.count("*").alias("n"))
    before = F.sum("n").over(Window.partitionBy("length").orderBy("task")) - F.col("n")
    counts = materialise(counts.select("task", "length", "n", before.alias("before")), "counts")
    total = {r["length"]: r["n"] for r in counts.groupBy("length").agg(F.sum("n").alias("n")).collect()}
    places = documents.sparkSession.sparkContext.broadcast(segments(plan(total, capacity)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        p = places.value
        for batch in batches:
            length, rank = (batch.column(c).to_numpy() for c in ("length", "rank"))
            at = np.searchsorted(p["key"], (length << 48) | rank, side="right") - 1
            inner = rank - p["rank"][at]
            each = p["each"][at]
            columns = [batch.column(c) for c in ("doc_id", "piece", "start", "length", "ids_crc32")]
            yield pa.RecordBatch.from_arrays([*columns, pa.array(p["sequence"][at] + inner // each), pa.array(p["offset"][at] + inner % each * length)], names=["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"])

    # The counts grow with tasks and lengths, so they are shuffled, not broadcast.
    ranked = made.join(counts.select("task", "length", "before").hint("shuffle_merge"), ["task", "length"]).withColumn("rank", F.col("rank") + F.col("before"))
    return ranked.select("doc_id", "piece", "start", "length", "ids_crc32", "rank").mapInArrow(run, "doc_id long, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long")
