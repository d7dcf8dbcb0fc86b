"""Exact removal of long repeated word spans on a compacted De Bruijn graph.

Edges are the ``k``-word windows of all documents, nodes their first and last
k-1 words.  A document is a walk.  Its stretches are compacted before any
shuffle into fragments (consecutive edges with one minimizer, see
``fragments``), as minimizer-partitioned construction does.  Then Spark

1. keeps fragments whose minimizer hash occurs twice and counts equal ones,
2. makes the repeated part of the graph: a fragment that occurs twice and meets
   no other content at its minimizer is one arc, all others are expanded into
   single edges, which are counted; arcs that occur once are dropped,
3. counts each node's arcs in and out, and joins arcs end to start at nodes
   with one of each: first along the source document, then by pointer jumping
   between such runs, so that every nonbranching path gets one name and each
   arc its offset there,
4. lays the paths over the documents again: an occurrence of an arc has a
   source coordinate, and occurrences that follow each other in a document and
   on a path are one long span.

Every arc and edge is compared at its source coordinates (document, word): its
identity is a 128-bit BLAKE2b digest of the words that stand there, taken anew
from the text for each occurrence.

Defined results: null or blank texts have no words; a row that repeats
another row is a document of its own (so both lose their windows); other
columns of the input are ignored; an empty table gives an empty table.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from stratagraph.llm import fragments as G
from stratagraph.llm import textnum as T
from stratagraph.llm.session import drop, keyed, materialise

WINDOW = 35
GRAM = 12
_NODE = 0x27D4EB2F165667C5 | 1

_ARC = "doc_id long, k long, a1 long, a2 long, src long, dst long, start long, cnt int, weight long"


def _arcs(docs: DataFrame, k: int) -> DataFrame:
    """Arcs of the fragments in ``spans`` (start, cnt, weight, branching); single edges of those that branch."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a, b, data, offsets in T.runs(batch.column("text")):
                u = G.Units("word", data, offsets)
                nodes = T.Rolling(u.values, _NODE).windows(k - 1)
                lists = batch.column("spans").slice(a, b - a)
                row = np.repeat(np.arange(b - a), np.array(lists.value_lengths().to_pylist(), np.int64))
                flat = lists.flatten()
                start, count, weight, branching = (flat.field(f).to_numpy(zero_copy_only=False) for f in ("start", "cnt", "weight", "branching"))
                pieces = np.where(branching, count, 1)
                arc = np.repeat(np.arange(len(row)), pieces)
                inner = np.arange(len(arc)) - np.repeat(np.cumsum(pieces) - pieces, pieces)
                place = start[arc] + inner
                size = np.where(branching, 1, count)[arc]
                at = u.first[row[arc]] + place
                take = pa.array(row[arc] + a)
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column("doc_id").take(take), batch.column("k").take(take), *u.digests(at, at + size + k - 1),
                        pa.array(nodes[at].view(np.int64)), pa.array(nodes[at + size].view(np.int64)), pa.array(place), pa.array(size.astype(np.int32)), pa.array(weight[arc]),
                    ],
                    names=["doc_id", "k", "a1", "a2", "src", "dst", "start", "cnt", "weight"],
                )

    return docs.mapInArrow(run, _ARC)


def _through(arcs: DataFrame) -> DataFrame:
    """Nodes with one arc in and one arc out."""
    ends = arcs.select(F.col("src").alias("node"), F.lit(1).alias("out"), F.lit(0).alias("into")).unionAll(arcs.select("dst", F.lit(0), F.lit(1)))
    return ends.groupBy("node").agg(F.sum("out").alias("out"), F.sum("into").alias("into")).where("out = 1 AND into = 1").select("node")


def compact(arcs: DataFrame) -> DataFrame:
    """(a1, a2, cnt, p1, p2, offset): each arc's nonbranching path and the windows before it there.

    ``arcs`` has a1, a2, cnt, src, dst and the coordinates doc_id, k, start of
    one occurrence.  A path is named by its first arc; arcs of a cycle without
    any branch are paths of their own, run by run.
    """
    inner = materialise(_through(arcs), "inner")
    arcs = arcs.join(inner.withColumnRenamed("node", "src").withColumn("goes_on", F.lit(True)), "src", "left")
    # Neighbours in the source document that meet at such a node.
    by = Window.partitionBy("doc_id", "k").orderBy("start", "a1", "a2")
    follows = F.col("goes_on") & (F.lag("dst").over(by) == F.col("src")) & (F.lag(F.col("start") + F.col("cnt")).over(by) == F.col("start"))
    marked = arcs.withColumn("head", ~F.coalesce(follows, F.lit(False)))
    first = lambda c: F.last(F.when(F.col("head"), F.col(c)), ignorenulls=True).over(by)
    placed = marked.select("a1", "a2", "cnt", "src", "dst", first("a1").alias("r1"), first("a2").alias("r2"), (F.col("start") - first("start")).alias("inside"), "goes_on", "head")
    placed = materialise(placed, "runs")
    starts = placed.where("head").select("r1", "r2", "src", "goes_on")
    ends = placed.groupBy("r1", "r2").agg(F.max_by("dst", "inside").alias("dst"), F.max(F.col("inside") + F.col("cnt")).alias("size"))
    runs = starts.join(ends, ["r1", "r2"])
    # Runs that meet at a node with one arc in and one out: each points to the run before it.
    before = runs.select(F.col("dst").alias("src"), F.col("r1").alias("b1"), F.col("r2").alias("b2"), F.col("size").alias("far"))
    chain = materialise(runs.where("goes_on").join(before, "src").select("r1", "r2", "b1", "b2", "far", F.lit(True).alias("open")), "chain")
    n, reach = chain.count(), 1
    while reach <= 2 * n and not chain.where("open").isEmpty():
        # A pointer to a run that points on itself moves to that run's target: each round doubles its reach.
        onward = chain.select(F.col("r1").alias("b1"), F.col("r2").alias("b2"), F.col("b1").alias("c1"), F.col("b2").alias("c2"), F.col("far").alias("more"))
        moved = chain.join(onward, ["b1", "b2"], "left").select(
            "r1", "r2", F.coalesce("c1", "b1").alias("b1"), F.coalesce("c2", "b2").alias("b2"), (F.col("far") + F.coalesce("more", F.lit(0))).alias("far"), F.col("c1").isNotNull().alias("open")
        )
        old, chain, reach = chain, materialise(moved, "chain"), 2 * reach
        drop(old)
    # Pointers that are still open run round a cycle.
    named = placed.join(chain.where("NOT open").drop("open"), ["r1", "r2"], "left")
    paths = named.select("a1", "a2", "cnt", F.coalesce("b1", "r1").alias("p1"), F.coalesce("b2", "r2").alias("p2"), (F.col("inside") + F.coalesce("far", F.lit(0))).alias("offset"))
    paths = materialise(paths, "paths")
    drop(inner, placed, chain)
    return paths


def long_spans(occurrences: DataFrame, window: int) -> DataFrame:
    """(doc_id, k, start, length, p1, p2, offset): occurrences that follow each other in a document and on a path, as one span."""
    by = Window.partitionBy("doc_id", "k", "p1", "p2", "turn").orderBy("start")
    o = occurrences.withColumn("turn", F.col("offset") - F.col("start")).withColumn("stop", F.col("start") + F.col("cnt"))
    o = o.withColumn("new", F.coalesce(F.col("start") > F.max("stop").over(by.rowsBetween(Window.unboundedPreceding, -1)), F.lit(True)))
    o = o.withColumn("island", F.sum(F.col("new").cast("long")).over(by))
    spans = o.groupBy("doc_id", "k", "p1", "p2", "turn", "island").agg(F.min("start").alias("start"), F.max("stop").alias("stop"))
    return spans.select("doc_id", "k", "start", (F.col("stop") - F.col("start") + window - 1).cast("long").alias("length"), "p1", "p2", (F.col("turn") + F.col("start")).alias("offset"))


def repeated_spans(docs: DataFrame, window: int = WINDOW, gram: int = GRAM) -> DataFrame:
    """(doc_id, k, start, length, p1, p2, offset): word spans of ``keyed`` documents that repeated windows cover.

    (p1, p2) names the nonbranching path on which the span lies, ``offset`` its
    first window there; both are null where a fragment that branches inside
    was repeated as a whole.
    """
    found = G.candidates(docs, "word", window, gram)
    same = ["h", "d1", "d2", "cnt"]
    classes = materialise(found.groupBy(*same).agg(F.count("*").alias("weight"), F.min(F.struct("doc_id", "k", "start")).alias("source")), "classes")
    branching = materialise(classes.groupBy("h").agg(F.count("*").alias("n")).where("n > 1").select("h", F.lit(True).alias("branching")), "branching")
    marked = classes.join(branching, "h", "left").withColumn("branching", F.coalesce("branching", F.lit(False)))
    wanted = marked.where("weight > 1 OR branching").select("source.doc_id", "source.k", F.struct("source.start", "cnt", "weight", "branching").alias("span"))
    wanted = materialise(wanted.groupBy("doc_id", "k").agg(F.collect_list("span").alias("spans")), "wanted")
    arcs = materialise(_arcs(G.with_spans(docs, wanted, "inner"), window), "arcs")
    drop(wanted)
    graph = arcs.groupBy("a1", "a2", "cnt").agg(F.sum("weight").alias("weight"), F.min(F.struct("doc_id", "k", "start")).alias("at"), F.first("src").alias("src"), F.first("dst").alias("dst"))
    graph = materialise(graph.where("weight > 1").select("a1", "a2", "cnt", "src", "dst", "at.doc_id", "at.k", "at.start"), "graph")
    paths = compact(graph)
    drop(graph)
    on_path = paths.select(F.col("a1").alias("d1"), F.col("a2").alias("d2"), "cnt", "p1", "p2", "offset")
    here = found.join(on_path, ["d1", "d2", "cnt"]).select("doc_id", "k", "start", "cnt", "p1", "p2", "offset")
    single = arcs.where("weight = 1").join(paths, ["a1", "a2", "cnt"]).select("doc_id", "k", "start", "cnt", "p1", "p2", "offset")
    spans = materialise(long_spans(here.unionByName(single), window), "spans")
    # Copies of a fragment of which only the source's edges are in the graph.
    whole = found.join(marked.where("weight > 1 AND branching").select(*same), same)
    none = F.lit(None).cast("long")
    whole = materialise(whole.select("doc_id", "k", "start", (F.col("cnt") + window - 1).cast("long").alias("length"), none.alias("p1"), none.alias("p2"), none.alias("offset")), "spans")
    drop(found, classes, branching, arcs, paths)
    return spans.unionByName(whole)


def remove_repeats(documents: DataFrame, window: int = WINDOW, gram: int = GRAM, want_text: bool = False, extra: tuple[str, ...] = ()) -> DataFrame:
    """Documents without the words that repeated windows of ``window`` words cover.

    Returns doc_id, n_words, n_removed, n_spans, kept_sha256, the columns
    ``extra`` and, on demand, ``kept`` (the kept words joined by one space).
    """
    docs = keyed(documents, *extra)
    spans = G.spans_by_document(repeated_spans(docs, window, gram))
    out = G.remove(G.with_spans(docs, spans, extra=extra), "word", want_text, extra)
    kept = [F.col("kept").cast("string").alias("kept")] if want_text else []
    return out.select("doc_id", F.col("n_units").alias("n_words"), "n_removed", "n_spans", "kept_sha256", *kept, *extra)
