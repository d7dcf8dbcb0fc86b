"""Exact Jaccard self-join of word n-gram sets, as classes of linked documents.

1. One pass gives each document its set's size, a 64-bit digest (the node of
   all documents with that set), a profile for the suffix filter, and its
   prefix: the first ``n - ceil(t n) + 1`` n-grams, rare ones first.  The
   order is a function of the n-gram alone, so any such order gives the same
   result; it decides the cost.  A quarter of all n-grams (by hash) is counted
   over all documents: first come those of them that occur once, then n-grams
   that weren't counted, then counted ones that repeat (a bitmap of
   ``2**BITS`` bits holds them), last the ``FREQUENT`` most frequent by count.
2. Prefix n-grams are grouped; those with two or more nodes give candidates
   under the length filter and the positional filter.
3. Star rounds first test each node against the most central node that it
   shares most prefix n-grams with.  Linked nodes become one component; the
   second round takes the nodes with most links for central.
4. All candidates between different components follow: per n-gram, nodes
   outside its largest component against all others.  So large groups of near
   copies cost no pairs within a component and no link can be missed.
5. The suffix filter bounds a pair's distance from below, first by parity
   sketches inside the join (so that unlike members of a large group leave no
   rows behind), then by sizes over ranges of the hash; what is left is made
   distinct and verified once on the whole sets.

Defined results: null or blank texts have an empty set, link with nothing and
are their own component; rows that repeat an id are separate rows with the
same component; a null id never names a component that has other ids; other
columns are ignored; an empty table gives an empty table.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stratagraph.llm import textnum as T
from stratagraph.llm.components import components
from stratagraph.llm.session import drop, keyed, materialise, small, with_key

BASE = 0x27D4EB2F165667C5 | 1
#: Entries of the broadcast table of frequent n-grams (16 bytes each).
FREQUENT = 1 << 16
RANGES = 128
#: 64-bit words of the parity sketch: bit i is the parity of the number of n-grams whose hash falls on i.
SKETCH = 8
#: Bits of the broadcast bitmap of repeated n-grams (16 MB), and the share of n-grams that is counted.
BITS = 27
COUNTED = 4
#: Rows of ids that may be broadcast (24 bytes each); more are shuffled.
BROADCAST_ROWS = 500_000
_BITS = [f"s{i}" for i in range(SKETCH)]


def _sets(data: np.ndarray, offsets: np.ndarray, size: int) -> list[np.ndarray]:
    """The sorted distinct n-gram hashes of each document of a run."""
    data = T.lower_ascii(data)
    starts, ends, first = T.words(data, offsets)
    rolling = T.Rolling(T.hash_spans(data, starts, ends), BASE)
    grams = rolling.windows(size)
    n = np.diff(first)
    short = (n > 0) & (n < size)
    alone = iter(rolling.spans(first[:-1][short], first[1:][short]).reshape(-1, 1))
    out = []
    for a, m in zip(first[:-1].tolist(), n.tolist()):
        if m < size:
            out.append(next(alone) if m else grams[:0])
            continue
        x = np.sort(grams[a : a + m - size + 1])
        keep = np.ones(len(x), bool)
        keep[1:] = x[1:] != x[:-1]
        out.append(x[keep])
    return out


def _repeated(docs: DataFrame, size: int) -> DataFrame:
    """(token, n): n-grams in two or more documents of one run, with how many."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for _, _, data, offsets in T.runs(batch.column("text")):
                x = np.sort(np.concatenate(_sets(data, offsets, size)))
                head = np.flatnonzero(np.concatenate([[True], x[1:] != x[:-1]])) if len(x) else np.zeros(0, np.int64)
                count = np.diff(np.append(head, len(x)))
                more = count > 1
                yield pa.RecordBatch.from_arrays([pa.array(x[head[more]].view(np.int64)), pa.array(count[more])], names=["token", "n"])

    return docs.select("text").mapInArrow(run, "token long, n long")


def _frequent(docs: DataFrame, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes, ascending, and counts of the most frequent n-grams; at most ``FREQUENT``."""
    top = _repeated(docs, size).groupBy("token").agg(F.sum("n").alias("n")).where("n > 3").orderBy(F.desc("n"), "token").limit(FREQUENT).toPandas()
    token = top["token"].to_numpy(np.int64).view(np.uint64)
    by = np.argsort(token)
    return token[by], top["n"].to_numpy(np.int64)[by]


def _bitmap(docs: DataFrame, size: int) -> np.ndarray:
    """One bit for each 27-bit prefix of a counted n-gram's hash that occurs in two or more documents."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for _, _, data, offsets in T.runs(batch.column("text")):
                x = np.concatenate(_sets(data, offsets, size))
                x = x[x % np.uint64(COUNTED) == 0] >> np.uint64(32)
                yield pa.RecordBatch.from_arrays([pa.array(x.astype(np.uint32).view(np.int32))], names=["t"])

    twice = docs.select("text").mapInArrow(run, "t int").groupBy("t").agg(F.count("*").alias("n")).where("n > 1")
    place = F.shiftrightunsigned("t", 32 - BITS).cast("long")
    rows = twice.groupBy(F.bitmap_bucket_number(place).alias("b")).agg(F.bitmap_construct_agg(F.bitmap_bit_position(place)).alias("bits")).toArrow()
    out = np.zeros((2**BITS >> 15) + 2, "V4096").view(np.uint8).reshape(-1, 4096)
    for b, bits in zip(rows["b"].to_pylist(), rows["bits"].to_pylist()):
        out[b] = np.frombuffer(bits, np.uint8)
    return out


def _repeats(x: np.ndarray, bitmap: np.ndarray) -> np.ndarray:
    """Whether the bit of each hash is set; buckets count from 1 as Spark's do for places after 0."""
    place = (x >> np.uint64(64 - BITS)).astype(np.int64)
    bucket = np.where(place > 0, 1 + (place - 1) // 32768, 0)
    at = np.where(place > 0, (place - 1) % 32768, 0)
    return (bitmap[bucket, at >> 3] >> (at & 7).astype(np.uint8)) & 1 == 1


def _sketch(x: np.ndarray) -> np.ndarray:
    """Parity of the n-grams on each of ``64 * SKETCH`` places; two sets differ in at least as many n-grams as bits."""
    odd = np.bincount((T.mix(x) >> np.uint64(16)).astype(np.int64) % (64 * SKETCH), minlength=64 * SKETCH) & 1
    return np.packbits(odd.astype(np.uint8)).view(np.int64)


def _profiles(docs: DataFrame, size: int, percent: int, frequent: tuple[np.ndarray, np.ndarray], bitmap: np.ndarray) -> DataFrame:
    """One row a document: set size, node, suffix-filter profile, prefix."""
    known = docs.sparkSession.sparkContext.broadcast((*frequent, bitmap))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes, counts, bitmap = known.value
        for batch in batches:
            for a, b, data, offsets in T.runs(batch.column("text")):
                sizes, nodes, profile, prefix, sketch = [], [], [], [], []
                for x in _sets(data, offsets, size):
                    n = len(x)
                    sizes.append(n)
                    nodes.append(T.mix(T.mix(x ^ np.uint64(0x5851F42D4C957F2D)).sum(keepdims=True, dtype=np.uint64) + np.uint64(n))[0] if n else np.uint64(0))
                    sketch.append(_sketch(x))
                    profile.append(np.diff(np.searchsorted(x, np.arange(1, RANGES, dtype=np.uint64) << np.uint64(57)), prepend=0, append=n).clip(max=127).astype(np.int8))
                    if n:
                        often = np.where(x % np.uint64(COUNTED) == 0, np.where(_repeats(x, bitmap), 2, 0), 1)
                        if len(hashes):
                            at = np.minimum(np.searchsorted(hashes, x), len(hashes) - 1)
                            often = np.where(hashes[at] == x, counts[at] + 2, often)
                        x = x[np.argsort(often, kind="stable")]
                    prefix.append(x[: n - -(-percent * n // 100) + 1].view(np.int64) if n else x.view(np.int64))
                yield pa.RecordBatch.from_arrays(
                    [batch.column("doc_id").slice(a, b - a), batch.column("k").slice(a, b - a), pa.array(sizes, pa.int64()), pa.array(np.array(nodes, np.uint64).view(np.int64)), pa.array(profile, pa.list_(pa.int8())), pa.array(prefix, pa.list_(pa.int64())), *(pa.array(c) for c in np.array(sketch).reshape(-1, SKETCH).T)],
                    names=["doc_id", "k", "n", "node", "profile", "prefix", *_BITS],
                )

    return docs.mapInArrow(run, "doc_id long, k long, n long, node long, profile array<tinyint>, prefix array<long>" + "".join(f", {c} long" for c in _BITS))


def _fetch(docs: DataFrame, wanted: DataFrame) -> DataFrame:
    """(node, text): a text for each of ``wanted`` (node, doc_id, k); texts shuffle smaller than sets."""
    w = small(wanted.select("node", F.col("doc_id").alias("_d"), F.col("k").alias("_k")), BROADCAST_ROWS)
    return docs.join(w, (docs["k"] == w["_k"]) & docs["doc_id"].eqNullSafe(w["_d"])).select("node", "text")


def _verify(pairs: DataFrame, texts: DataFrame, size: int, percent: int) -> DataFrame:
    """Pairs (a, b) whose whole sets reach the threshold."""
    left, right = texts.toDF("a", "x"), texts.toDF("b", "y")
    both = pairs.select("a", "b").join(left, "a").join(right, "b")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i, j, data, offsets in T.runs(batch.column("x")):
                keep = []
                other, at = T.buffers(batch.column("y").slice(i, j - i))
                for x, y in zip(_sets(data, offsets, size), _sets(other[at[0] : at[-1]], at - at[0], size)):
                    both = np.sort(np.concatenate([x, y]))
                    common = int((both[1:] == both[:-1]).sum())
                    keep.append(100 * common >= percent * (len(x) + len(y) - common))
                yield pa.RecordBatch.from_arrays([batch.column(c).slice(i, j - i).filter(pa.array(keep, pa.bool_())) for c in ("a", "b")], names=["a", "b"])

    # A repeated row has given its text twice.
    return both.select("a", "b", "x", "y").mapInArrow(run, "a long, b long").distinct()


def _possible(percent: int, na: str, nb: str, pa_: str, pb: str):
    """Length filter and positional filter for a common prefix n-gram at places pa, pb."""
    length = (F.lit(100) * F.least(na, nb) >= F.lit(percent) * F.greatest(na, nb))
    reach = F.least(pa_, pb) + 1 + F.least(F.col(na) - F.col(pa_) - 1, F.col(nb) - F.col(pb) - 1)
    return length & ((100 + percent) * reach >= percent * (F.col(na) + F.col(nb)))


def _near(percent: int, na: str, nb: str, a: str, b: str):
    """Suffix filter on the sketches with suffixes a, b: |A| + |B| - 2 common <= (|A| + |B|) (100 - p) / (100 + p)."""
    apart = sum((F.bit_count(F.col(c + a).bitwiseXOR(F.col(c + b))) for c in _BITS[1:]), F.bit_count(F.col(_BITS[0] + a).bitwiseXOR(F.col(_BITS[0] + b))))
    return apart * (100 + percent) <= (F.col(na) + F.col(nb)) * (100 - percent)


def _suffix_filter(pairs: DataFrame, nodes: DataFrame, percent: int) -> DataFrame:
    """Pairs whose sets may still be close enough: the sizes of their parts in ranges of the hash differ little."""
    a = nodes.select(F.col("node").alias("a"), F.col("n").alias("na"), F.col("profile").alias("fa"))
    b = nodes.select(F.col("node").alias("b"), F.col("n").alias("nb"), F.col("profile").alias("fb"))
    apart = F.aggregate(F.zip_with("fa", "fb", lambda x, y: F.abs(x.cast("int") - y.cast("int")).cast("long")), F.lit(0).cast("long"), lambda s, x: s + x)
    # |A|+|B| - 2 common <= (|A|+|B|) (100-p)/(100+p)
    return pairs.join(a, "a").join(b, "b").where(apart * (100 + percent) <= (F.col("na") + F.col("nb")) * (100 - percent)).select("a", "b")


def _texts(docs: DataFrame, nodes: DataFrame, pairs: DataFrame) -> DataFrame:
    """(node, text) of all nodes in ``pairs``, written."""
    wanted = pairs.select(F.col("a").alias("node")).union(pairs.select("b")).distinct()
    return materialise(_fetch(docs, nodes.join(wanted, "node", "left_semi")), "texts")


def link_classes(documents: DataFrame, size: int = 5, percent: int = 80) -> DataFrame:
    """(doc_id, k, n_shingles, component_id, label): classes of documents linked by Jaccard >= percent/100.

    ``label`` is one value for each class with words, null for empty texts.
    """
    docs = keyed(documents)
    whole = materialise(_profiles(docs, size, percent, _frequent(docs, size), _bitmap(docs, size)), "profiles")
    nodes = whole.where("n > 0").groupBy("node").agg(F.min(F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "k")).alias("at"), F.first("n").alias("n"), F.first("profile").alias("profile"), F.count("*").alias("copies"), *(F.first(c).alias(c) for c in _BITS))
    nodes = materialise(nodes.select("node", "at.doc_id", "at.k", "n", "profile", "copies", *_BITS), "nodes")

    # Of exact copies one row speaks for all.
    copied = small(nodes.where("copies > 1").select("node", F.col("doc_id").alias("_d"), F.col("k").alias("_k")), BROADCAST_ROWS)
    alone = whole.where("n > 0").join(copied, "node", "left").where(F.col("_k").isNull() | (F.col("doc_id").eqNullSafe(F.col("_d")) & (F.col("k") == F.col("_k"))))
    posts = alone.select("node", "n", F.posexplode("prefix").alias("at", "token"))
    shared = materialise(posts.groupBy("token").agg(F.count("*").alias("c")).where("c > 1").select("token"), "shared")
    posts = materialise(posts.join(shared, "token"), "posts")
    drop(shared)
    edges = tested = labels = None
    for _ in range(2):
        now = posts if labels is None else posts.join(labels, "node", "left")
        now = now.withColumn("label", F.lit(None).cast("long") if labels is None else F.coalesce("label", "node"))
        # Of near copies, the least edited shares most of its prefix, and then the one with most links is central.
        central = posts.groupBy("node").agg((F.count("*") / (F.first("n") - F.ceil(F.first("n") * percent / 100) + 1)).alias("share"))
        if edges is not None:
            links = edges.select(F.col("a").alias("node")).unionAll(edges.select("b")).groupBy("node").agg(F.count("*").alias("links"))
            central = central.join(links, "node", "left").withColumn("share", F.coalesce("links", F.lit(0)) + F.col("share") / 2)
        pivots = now.join(central, "node").groupBy("token").agg(F.max(F.struct("share", "node", "n", "at", "label")).alias("p"))
        pivots = pivots.select("token", F.col("p.node").alias("pivot"), F.col("p.n").alias("pn"), F.col("p.at").alias("pat"), F.col("p.label").alias("plabel"))
        star = now.join(pivots, "token").where("node <> pivot AND (label IS NULL OR label <> plabel)").where(_possible(percent, "n", "pn", "at", "pat"))
        star = star.groupBy("node", "pivot").agg(F.count("*").alias("c")).groupBy("node").agg(F.max(F.struct("c", "pivot")).alias("p"))
        pairs = star.select(F.least("node", "p.pivot").alias("a"), F.greatest("node", "p.pivot").alias("b")).distinct()
        if tested is not None:
            pairs = pairs.join(tested, ["a", "b"], "left_anti")
        pairs = materialise(_suffix_filter(pairs, nodes, percent), "pairs")
        texts = _texts(docs, nodes, pairs)
        found = materialise(_verify(pairs, texts, size, percent), "edges")
        drop(texts)
        tested, edges = (pairs, found) if tested is None else (tested.unionByName(pairs), edges.unionByName(found))
        labels = components(edges)

    named = posts.join(labels, "node", "left").join(nodes.select("node", *_BITS), "node").select("token", "node", "n", "at", *_BITS, F.coalesce("label", "node").alias("label"))
    named = materialise(named, "named")
    drop(posts, labels)
    shares = named.groupBy("token", "label").agg(F.count("*").alias("c"))
    major = shares.groupBy("token").agg(F.count("*").alias("labels"), F.max(F.struct("c", "label")).alias("m")).where("labels > 1").select("token", F.col("m.label").alias("major"))
    major = materialise(major, "major")
    minor = named.join(major, "token").where("label <> major").select("token", "major", *(F.col(c).alias(f"{c}_a") for c in ("node", "n", "at", "label", *_BITS)))
    others = named.select("token", *(F.col(c).alias(f"{c}_b") for c in ("node", "n", "at", "label", *_BITS)))
    minor = materialise(minor, "minor")
    cross = minor.join(others, "token").where("label_a <> label_b AND (label_b = major OR node_a < node_b)")
    cross = cross.where(_possible(percent, "n_a", "n_b", "at_a", "at_b")).where(_near(percent, "n_a", "n_b", "_a", "_b"))
    cross = materialise(cross.select(F.least("node_a", "node_b").alias("a"), F.greatest("node_a", "node_b").alias("b")).distinct(), "cross")
    drop(named, major, minor)
    close = materialise(_suffix_filter(cross, nodes, percent), "close")
    drop(cross)
    cross = materialise(close.join(tested, ["a", "b"], "left_anti"), "pairs")
    drop(close)
    texts = _texts(docs, nodes, cross)
    more = materialise(edges.unionByName(_verify(cross, texts, size, percent)), "edges")
    drop(texts, cross)
    labels = components(more)
    drop(more)

    classes = nodes.select("node", "doc_id").join(labels, "node", "left").select("node", "doc_id", F.coalesce("label", "node").alias("label"))
    least = classes.groupBy("label").agg(F.min("doc_id").alias("component_id"))
    classes = classes.join(least, "label").select("node", "component_id", "label")
    empty = whole.where("n = 0").select("doc_id", "k", F.col("n").alias("n_shingles"), F.col("doc_id").alias("component_id"), F.lit(None).cast("long").alias("label"))
    return whole.where("n > 0").join(classes, "node").select("doc_id", "k", F.col("n").alias("n_shingles"), "component_id", "label").unionByName(empty)


def keep_one(documents: DataFrame, size: int = 5, percent: int = 80) -> DataFrame:
    """The rows of ``documents`` with the smallest id of each class; texts without words all stay."""
    classes = link_classes(documents, size, percent)
    first = classes.where("label IS NOT NULL").groupBy("label").agg(F.min(F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "k")).alias("at"))
    stays = first.select("at.doc_id", "at.k").unionByName(classes.where("label IS NULL").select("doc_id", "k").distinct())
    stays = stays.select(F.col("doc_id").alias("_d"), F.col("k").alias("_k"), F.xxhash64("doc_id", "k").alias("_key"))
    docs = with_key(documents, "_row").withColumn("_key", F.xxhash64(F.col("doc_id").cast("long"), "_row"))
    found = docs.join(stays, "_key").where(F.col("doc_id").cast("long").eqNullSafe(F.col("_d")) & (F.col("_row") == F.col("_k")))
    # A row that repeats another row is a copy of it; the join has dealt both to the same task.
    return found.dropDuplicates(["_key", "_d", "_k"]).select(*documents.columns)
