"""Toxicity: a linear classifier on character n-grams scaled by naive Bayes log-count ratios.

Features say whether a text holds an n-gram of 4 to 6 lower-cased characters
(case and characters beyond Latin-1 are folded to one byte each; an n-gram is
kept exactly as a 64-bit number).  Document counts of all n-grams in both
classes are summed by Spark, the ``FEATURES`` n-grams that tell the classes
apart best are scaled by their log-count ratio, and a logistic regression with
an L2 penalty is fitted on them.

``TRAIN_ROWS`` bounds the labelled rows that are used for fitting: those with
the smallest hash of their id, from all that are not held out (crc32 of the id
as text, modulo 4, is 2).  Scoring reads every whole text once, without any
shuffle; only the fitted features (at most 16 bytes each) are broadcast.

Defined results: null texts are empty and score like a text without features;
labels that are null, or whose document is missing, are ignored; a document
labelled twice counts twice; without two classes the score is the share of
label 1 (0 without labels); a null id is not held out.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, IntegerType, StructField, StructType

from stratagraph.llm import textnum as T
from stratagraph.llm.session import drop, materialise, small_batches

SIZES = (4, 5, 6)
TRAIN_ROWS = 12_000
FEATURES = 8192
SUPPORT = 5
SLOTS = 1 << 20
#: Bytes of text whose n-grams are held together while they are counted; about 25 times as much memory.
COUNT_RUN = 1 << 20
PENALTY = 1e-4
STEPS = 300
THRESHOLD = 0.3

_FOLD = np.arange(256, dtype=np.uint8)
_FOLD[65:91] += 32
_FOLD[192:223] += 32
_FOLD[[9, 10, 13, 160]] = 32


def folded(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """One byte for each character of a run of UTF-8 texts, and offsets in characters."""
    points = np.frombuffer(data.tobytes().decode("utf-8", "replace").encode("utf-32-le", "replace"), np.uint32)
    at = np.concatenate([[0], np.cumsum((data & 0xC0) != 0x80)])[offsets]
    wide = points > 255
    out = _FOLD[np.where(wide, 128 + points % 31, points)]
    return out, at


def grams(chars: np.ndarray, offsets: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """(place, number) of the n-grams of one size that lie within a document."""
    n = len(chars) - size + 1
    if n <= 0:
        return np.zeros(0, np.int64), np.zeros(0, np.uint64)
    number = np.full(n, size, np.uint64)
    for i in range(size):
        number <<= np.uint64(8)
        number |= chars[i : i + n]
    inside = np.ones(n, bool)
    for edge in range(1, size):
        cut = offsets[1:-1] - edge
        inside[cut[(cut >= 0) & (cut < n)]] = False
    at = np.flatnonzero(inside)
    return at, number[at]


def _counts(train: DataFrame) -> DataFrame:
    """(gram, pos, neg): in how many texts of each class an n-gram is."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            label = batch.column("toxic").to_numpy(zero_copy_only=False).astype(bool)
            for a, _, data, offsets in T.runs(batch.column("text"), COUNT_RUN):
                chars, at = folded(data, offsets)
                for size in SIZES:  # one after the other: the places of one size are held at a time
                    place, number = grams(chars, at, size)
                    edge = np.searchsorted(place, at)
                    each: dict[bool, list[np.ndarray]] = {True: [], False: []}
                    for i, (x, y) in enumerate(zip(edge[:-1].tolist(), edge[1:].tolist())):
                        each[bool(label[a + i])].append(np.unique(number[x:y]))
                    del place, number
                    for kind, parts in each.items():
                        gram, n = np.unique(np.concatenate(parts) if parts else np.zeros(0, np.uint64), return_counts=True)
                        zero = np.zeros(len(n), np.int64)
                        yield pa.RecordBatch.from_arrays([pa.array(gram.view(np.int64)), pa.array(n if kind else zero), pa.array(zero if kind else n)], names=["gram", "pos", "neg"])

    return train.select("text", "toxic").mapInArrow(run, "gram long, pos long, neg long").groupBy("gram").agg(F.sum("pos").alias("pos"), F.sum("neg").alias("neg"))


class Lookup:
    """Finds the features of a run of texts: a small table by hash, then the exact n-gram."""

    def __init__(self, features: np.ndarray):
        self.features = features
        self.order = np.argsort(features)
        self.sorted = features[self.order]
        self.table = np.zeros(SLOTS, bool)
        self.table[self.slot(features)] = True

    @staticmethod
    def slot(number: np.ndarray) -> np.ndarray:
        return ((number * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(44)).astype(np.int64)

    def find(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Distinct (document row, feature) pairs."""
        rows, which = [], []
        if len(self.features):
            chars, at = folded(data, offsets)
            for size in SIZES:
                place, number = grams(chars, at, size)
                maybe = self.table[self.slot(number)]
                place, number = place[maybe], number[maybe]
                near = np.minimum(np.searchsorted(self.sorted, number), len(self.sorted) - 1)
                exact = self.sorted[near] == number
                rows.append(np.searchsorted(at, place[exact], side="right") - 1)
                which.append(self.order[near[exact]])
        if not rows:
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        pair = np.unique(np.concatenate(rows) * len(self.features) + np.concatenate(which))
        return pair // len(self.features), pair % len(self.features)


def _logistic(rows: np.ndarray, which: np.ndarray, label: np.ndarray, scale: np.ndarray) -> tuple[np.ndarray, float]:
    """Weights of the scaled features and the intercept; full gradients with momentum, always the same steps."""
    n, k = len(label), len(scale)
    value = scale[which]
    bound = 0.25 * np.bincount(rows, value**2, n).max(initial=1.0)  # the curvature is at most this
    rate = 1.0 / bound
    w, b, w_old, b_old = np.zeros(k), float(np.log((label.mean() + 1e-6) / (1 - label.mean() + 1e-6))), np.zeros(k), 0.0
    b_old = b
    for step in range(STEPS):
        mass = step / (step + 3)
        v, c = w + mass * (w - w_old), b + mass * (b - b_old)
        p = 1 / (1 + np.exp(-np.clip(np.bincount(rows, v[which] * value, n) + c, -40, 40)))
        error = p - label
        w_old, b_old = w, b
        w = v - rate * 20 * (np.bincount(which, error[rows] * value, k) / n + PENALTY * v)
        b = c - 0.5 * error.mean()
    return w, b


def fit(documents: DataFrame, labels: DataFrame, train_rows: int = TRAIN_ROWS) -> dict:
    """{'features', 'weights', 'intercept'} from the labelled rows that are not held out."""
    small_batches(documents)
    usable = labels.where("toxic IS NOT NULL AND doc_id IS NOT NULL").where(~held_out("doc_id"))
    usable = usable.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("toxic").cast("int").alias("toxic"))
    usable = usable.orderBy(F.xxhash64("doc_id"), "doc_id", "toxic").limit(train_rows)
    docs = documents.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    # The sample's bound is a parameter, so it can be sent to every executor (12 bytes a row).
    train = materialise(docs.join(F.broadcast(usable), "doc_id").select("toxic", "text"), "labelled")
    total = {bool(r["toxic"]): r["n"] for r in train.groupBy("toxic").agg(F.count("*").alias("n")).collect()}
    n1, n0 = total.get(True, 0), total.get(False, 0)
    empty = {"features": np.zeros(0, np.uint64), "weights": np.zeros(0)}
    if not n1 or not n0:
        return empty | {"intercept": -40.0 if not n1 else 40.0}
    apart = F.abs(F.col("pos") / n1 - F.col("neg") / n0) / F.sqrt((F.col("pos") + F.col("neg") + 1) / (n1 + n0))
    chosen = _counts(train).where(F.col("pos") + F.col("neg") >= SUPPORT).orderBy(F.desc(apart), "gram").limit(FEATURES).toPandas()
    if not len(chosen):
        return empty | {"intercept": float(np.log(n1 / n0))}
    ratio = np.log((chosen["pos"].to_numpy() + 1) / (n1 + 2)) - np.log((chosen["neg"].to_numpy() + 1) / (n0 + 2))
    features = chosen["gram"].to_numpy(np.int64).view(np.uint64)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lookup = Lookup(features)
        for batch in batches:
            for a, b, data, offsets in T.runs(batch.column("text")):
                rows, which = lookup.find(data, offsets)
                edge = np.searchsorted(rows, np.arange(b - a + 1))
                lists = [which[x:y].astype(np.int32).tobytes() for x, y in zip(edge[:-1], edge[1:])]
                yield pa.RecordBatch.from_arrays([batch.column("toxic").slice(a, b - a), pa.array(lists, pa.binary())], names=["toxic", "which"])

    found = train.select("toxic", "text").mapInArrow(run, "toxic int, which binary").toArrow()
    drop(train)
    lists = [np.frombuffer(x, np.int32) for x in found["which"].to_pylist()]
    rows = np.repeat(np.arange(len(lists)), [len(x) for x in lists])
    label = (found["toxic"].to_numpy() != 0).astype(np.float64)
    weights, intercept = _logistic(rows, np.concatenate(lists).astype(np.int64), label, ratio)
    return {"features": features, "weights": weights * ratio, "intercept": intercept}


def held_out(column: str) -> Column:
    """Whether a row is kept from training: a fixed share of ids."""
    return F.coalesce(F.crc32(F.col(column).cast("string").cast("binary")) % 4 == 2, F.lit(False))


def score(documents: DataFrame, model: dict, threshold: float = THRESHOLD, keep: list[str] | None = None) -> DataFrame:
    """doc_id (or the columns ``keep``), score and predicted for every row."""
    names = keep or ["doc_id"]
    docs = small_batches(documents).select(*names, *(["text"] if "text" not in names else []))
    schema = StructType([*docs.select(*names).schema.fields, StructField("score", DoubleType()), StructField("predicted", IntegerType())])
    known = documents.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = known.value
        lookup = Lookup(model["features"])
        for batch in batches:
            for a, b, data, offsets in T.runs(batch.column("text")):
                rows, which = lookup.find(data, offsets)
                z = np.bincount(rows, model["weights"][which], b - a) if len(rows) else np.zeros(b - a)
                p = 1 / (1 + np.exp(-np.clip(z + model["intercept"], -40, 40)))
                part = batch.slice(a, b - a)
                yield pa.RecordBatch.from_arrays([*(part.column(c) for c in names), pa.array(p), pa.array((p >= threshold).astype(np.int32))], names=[*names, "score", "predicted"])

    return docs.mapInArrow(run, schema)


def classify(documents: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, held_out, score, predicted for every document."""
    out = score(documents.select(F.col("doc_id").cast("long").alias("doc_id"), "text"), fit(documents, labels))
    return out.select("doc_id", held_out("doc_id").alias("held_out"), "score", "predicted")
