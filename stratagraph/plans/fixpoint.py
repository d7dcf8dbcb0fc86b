"""Fixed points over edge relations: closures, labelled reach, best-ranked paths.

Every loop works on the delta of the last round only, carries a ``seed`` column so
that many questions share one loop, and cuts its lineage each round into the
shared checkpoint folder.  A round is a shuffle of the delta by node; the
edges keep their partitioning by source for the whole loop.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from stratagraph.plans.graph import cut, drop

ROUNDS = 10_000
#: Steps that one round of ``spread`` takes; hubs of a component.
HOPS, HUBS = 4, 4


def closure(edges: DataFrame, seeds: DataFrame, max_depth: int | None = None) -> DataFrame:
    """(seed, id, depth): nodes reachable from each seed over ``edges`` (src, dst), the seed's own at depth 0.

    ``seeds`` has (seed, id).  Depth is the fewest steps.  Cycles and repeated edges do no harm.
    """
    way = F.lit(0).alias("way")
    return _closure(edges.select(way, "src", "dst"), seeds.select("seed", way, "id"), max_depth).drop("way")


def _closure(edges: DataFrame, seeds: DataFrame, max_depth: int | None) -> DataFrame:
    """The closure of several edge sets at once: ``way`` keeps them apart."""
    steps = edges.where("src IS NOT NULL AND dst IS NOT NULL").distinct().persist()
    key = ["seed", "way", "id"]
    try:
        seen = delta = cut(seeds.select(*key).distinct().withColumn("depth", F.lit(0)))
        parts = [seen]
        for depth in range(1, (max_depth if max_depth is not None else ROUNDS) + 1):
            d = delta.select("seed", "way", F.col("id").alias("src"))
            found = d.join(steps, ["way", "src"]).select("seed", "way", F.col("dst").alias("id")).distinct()
            delta = cut(found.join(seen, key, "left_anti").withColumn("depth", F.lit(depth)))
            if delta.isEmpty():
                drop(delta)
                break
            seen = seen.unionByName(delta)
            parts.append(delta)
            if len(parts) >= 6:  # few files to read in each round; what was folded goes, but for the delta that is still read
                seen = cut(seen)
                drop(*parts[:-1])
                parts = [delta, seen]
        return seen
    finally:
        steps.unpersist()


def labelled(edges: DataFrame, seeds: DataFrame, max_depth: int | None = None) -> DataFrame:
    """(seed, id, depth, resolution): 'exact' if exact edges alone reach a node, else 'possible'.

    ``edges`` has (src, dst, exact).  The depth is that of the better label.  Both
    reachabilities share one loop.
    """
    ways = lambda df, ways, *cols: df.withColumn("way", F.explode(ways)).select("way", *cols)
    both = F.array(F.lit(0), F.lit(1))
    steps = ways(edges, F.when(F.col("exact"), both).otherwise(F.array(F.lit(1))), "src", "dst")
    found = _closure(steps, ways(seeds, both, "seed", "id"), max_depth)
    return found.groupBy("seed", "id").agg(F.min_by("depth", "way").alias("depth"), F.when(F.min("way") == 0, "exact").otherwise("possible").alias("resolution"))


def best_paths(edges: DataFrame, seeds: DataFrame, cost: list[Column], max_steps: int | None = None) -> DataFrame:
    """(seed, id, rank, path): the least path to each node by a rank that adds up along it.

    ``cost`` lists expressions over an edge (src, dst, ...), most important first; the
    first is combined by maximum, the others by sum.  Ties go to the smaller path.
    The loop ends when no path gets better: ranks only fall, so that comes.
    With ``max_steps`` only paths of so many edges count.
    """
    n = len(cost)
    steps = cut(edges.select("src", "dst", *[c.cast("int").alias(f"c{i}") for i, c in enumerate(cost)]).distinct())
    zero = F.struct(*[F.lit(0).alias(f"r{i}") for i in range(n)])
    best = cut(seeds.select("seed", "id", zero.alias("rank"), F.array("id").alias("path")))
    delta = best
    for _ in range(ROUNDS if max_steps is None else max_steps):
        rank = F.struct(F.greatest(F.col("rank.r0"), F.col("c0")).alias("r0"), *[(F.col(f"rank.r{i}") + F.col(f"c{i}")).alias(f"r{i}") for i in range(1, n)])
        moved = delta.join(steps, delta["id"] == steps["src"]).where(~F.array_contains("path", F.col("dst")))
        moved = moved.select("seed", F.col("dst").alias("id"), rank.alias("rank"), F.concat("path", F.array("dst")).alias("path"))
        moved = moved.groupBy("seed", "id").agg(F.min(F.struct("rank", "path")).alias("n"))
        old = best.select("seed", "id", F.struct("rank", "path").alias("o"))
        better = moved.join(old, ["seed", "id"], "left").where("o IS NULL OR n < o").select("seed", "id", "n.rank", "n.path")
        before, delta = delta, cut(better)
        if delta.isEmpty():
            drop(delta)
            break
        last, best = best, cut(best.join(delta, ["seed", "id"], "left_anti").unionByName(delta))
        drop(*{id(x): x for x in (before, last)}.values())
    return best


def spread(steps: DataFrame, start: DataFrame, key: list[str]) -> DataFrame:
    """What ``start`` reaches; several steps a round, since no depth is asked for.

    ``steps`` has (src, dst, stop) beside columns of ``key``, ``start`` has ``key`` and ``bits``; a step into a node
    whose ``stop`` shares a bit with the row's ``bits`` isn't taken.
    """
    on = [c for c in key if c in steps.columns]
    both = [*on, "src"]
    parts = max(1, int(steps.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    stay = steps.select(*on, F.col("src").alias("dst")).unionByName(steps.select(*on, "dst")).distinct().select(*on, F.col("dst").alias("src"), "dst", F.lit(0).alias("stop"))
    held = steps.where("src <> dst").unionByName(stay).repartition(parts, *both).persist()
    try:
        seen = delta = cut(start.select(*key, "bits").distinct())
        pieces = [seen]
        for _ in range(ROUNDS):
            at = delta
            for _ in range(HOPS):
                at = at.withColumnRenamed("id", "src").join(held, both).where("bits & stop = 0").withColumnRenamed("dst", "id").select(*key, "bits").distinct()
            delta = cut(at.join(seen, key, "left_anti"))
            if delta.isEmpty():
                drop(delta)
                break
            seen = seen.unionByName(delta)
            pieces.append(delta)
            if len(pieces) >= 6:
                seen = cut(seen)
                drop(*pieces[:-1])
                pieces = [delta, seen]
        return seen
    finally:
        held.unpersist()


def components(edges: DataFrame) -> DataFrame:
    """(id, part): the weakly connected part of every node of ``edges`` (src, dst) that has an edge to another.

    Each round hooks every node to its smallest neighbour and renames the edges, so rounds are logarithmically many.
    """
    ends = lambda a, b: (F.least(a, b).alias("src"), F.greatest(a, b).alias("dst"))
    left = cut(edges.where("src <> dst").select(*ends("src", "dst")).distinct())
    out = left.select(F.col("src").alias("id")).union(left.select("dst")).distinct().withColumn("part", F.col("id"))
    while not left.isEmpty():
        hook = left.union(left.select("dst", "src")).groupBy("src").agg(F.min("dst").alias("to"))
        hook = cut(hook.select("src", F.least("src", "to").alias("to")))
        out = out.join(hook, out["part"] == hook["src"], "left").select("id", F.coalesce("to", "part").alias("part"))
        a, b = hook.toDF("src", "p"), hook.toDF("dst", "q")
        left = cut(left.join(a, "src").join(b, "dst").where("p <> q").select(*ends("p", "q")).distinct())
    return cut(out)


def reach(edges: DataFrame, seeds: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Which nodes each seed reaches over ``edges`` (src, dst), itself included, without a row for each pair.

    Most pairs of a large graph pass by a few nodes.  Every weakly connected part gets up to ``HUBS`` hubs, each known
    by a bit; two walks along all edges mark the nodes that a hub reaches and those that reach it.  A seed's own walk
    stops where it meets what one of its hubs reaches, since everything behind is reached by that hub too.  So the
    result is exact for any choice of hubs: (seed, id) of the pairs that pass by none, (seed, part, bits) with the
    hubs that a seed reaches, and (id, part, bits) with the hubs that reach a node.  A pair of one part whose bits
    meet is reachable, and isn't among the first.
    """
    steps = cut(edges.select("src", "dst").where("src IS NOT NULL AND dst IS NOT NULL AND src <> dst").distinct())
    part = components(steps)
    # Nothing is asked of parts without a seed.
    part = cut(part.join(part.join(seeds.select("id").distinct(), "id").select("part").distinct(), "part", "left_semi").select("id", "part"))
    steps = cut(steps.join(part.select(F.col("id").alias("src")), "src", "left_semi"))
    degree = steps.select(F.col("src").alias("id"), F.lit(1).alias("o"), F.lit(0).alias("i")).unionAll(steps.select("dst", F.lit(0), F.lit(1))).groupBy("id").agg((F.sum("o") * F.sum("i")).alias("n"))
    bit = F.pmod(F.hash("id"), F.lit(HUBS)).alias("bit")
    hubs = degree.where("n > 0").join(part, "id").groupBy("part", bit).agg(F.max_by("id", F.struct("n", "id")).alias("id"))
    ways = lambda way, a, b: steps.select(F.lit(way).alias("way"), F.col(a).alias("src"), F.col(b).alias("dst"), F.lit(0).alias("stop"))
    begin = hubs.select(F.explode(F.array(F.lit(0), F.lit(1))).alias("way"), "bit", "id", F.lit(0).alias("bits"))
    marks = spread(ways(0, "src", "dst").unionByName(ways(1, "dst", "src")), begin, ["way", "bit", "id"])
    one = lambda way: F.bit_or(F.when(F.col("way") == way, F.expr("shiftleft(1, bit)")).otherwise(0))
    marks = marks.groupBy("id").agg(one(0).alias("below"), one(1).alias("above"))
    marks = cut(part.join(marks, "id", "left").select("id", "part", F.coalesce("below", F.lit(0)).alias("below"), F.coalesce("above", F.lit(0)).alias("above")))

    own = seeds.select("seed", "id").distinct().join(marks, "id", "left")
    per = own.groupBy("seed", "part").agg(F.bit_or("above").alias("bits"))
    origins = cut(per.where("bits <> 0"))
    begin = own.alias("o").join(per.alias("p"), F.expr("o.seed = p.seed AND o.part <=> p.part")).selectExpr("o.seed", "o.id", "coalesce(p.bits, 0) AS bits").where("coalesce(below, 0) & coalesce(p.bits, 0) = 0")
    walked = spread(steps.join(marks.select(F.col("id").alias("dst"), F.col("below").alias("stop")), "dst"), begin, ["seed", "id"])
    return walked.select("seed", "id"), origins, marks.where("below <> 0").select("id", "part", F.col("below").alias("bits"))


def pairs(edges: DataFrame, seeds: DataFrame, ends: DataFrame) -> DataFrame:
    """(seed, id): every pair of ``reach`` whose node is among ``ends`` (id); other columns of ``ends`` come along."""
    ends, side = ends.distinct(), 16
    more = [c for c in ends.columns if c != "id"]
    near, origins, marks = reach(edges, seeds)
    # A part may hold most of the graph: its pairs are dealt to side * side tasks.
    deal = lambda c: F.pmod(F.xxhash64(c), F.lit(side))
    every = F.explode(F.sequence(F.lit(0), F.lit(side - 1)))
    a = origins.select("seed", "part", F.col("bits").alias("above"), deal("seed").cast("int").alias("i"), every.alias("j"))
    b = marks.join(ends, "id").select("id", *more, "part", F.col("bits").alias("below"), every.alias("i"), deal("id").cast("int").alias("j"))
    return near.join(ends, "id").select("seed", "id", *more).unionByName(a.join(b, ["part", "i", "j"]).where("above & below <> 0").select("seed", "id", *more))


def reach_counts(edges: DataFrame, seeds: DataFrame) -> DataFrame:
    """(id, n): by how many seeds each node is reached, without the pairs where a seed starts as that node itself."""
    side = 16
    near, origins, marks = reach(edges, seeds)
    n = origins.groupBy("part", F.col("bits").alias("above")).agg(F.count("*").alias("n"))
    kinds = marks.select("part", F.col("bits").alias("below")).distinct()
    n = n.join(kinds, "part").where("above & below <> 0").groupBy("part", F.col("below").alias("bits")).agg(F.sum("n").alias("n"))
    # Few (part, bits) may hold most nodes.
    n = n.withColumn("i", F.explode(F.sequence(F.lit(0), F.lit(side - 1))))
    far = marks.withColumn("i", F.pmod(F.xxhash64("id"), F.lit(side)).cast("int")).join(n, ["part", "bits", "i"]).select("id", "n")
    own = seeds.where("seed = id").select("seed", "id").distinct()
    own = own.join(origins.toDF("seed", "part", "above"), "seed").join(marks, ["id", "part"]).where("above & bits <> 0").select("id", F.lit(-1).cast("long").alias("n"))
    walked = near.where("seed <> id").groupBy("id").agg(F.count("*").alias("n"))
    return far.unionByName(own).unionByName(walked).groupBy("id").agg(F.sum("n").alias("n")).where("n > 0")


def nearest(edges: DataFrame, ends: DataFrame, wanted: DataFrame) -> DataFrame:
    """(id, path): the way from each node of ``wanted`` (id) to the nearest of ``ends`` (id) over ``edges`` (src, dst).

    Of ends as near, the smallest; of its ways as short, the smallest.  All nodes share one walk back from the ends,
    which keeps one path a node: the best of a node goes on with the best of the next one, since both
    choose by the same order.  It stops when all of ``wanted`` are met.
    """
    steps = edges.select("src", "dst").where("src IS NOT NULL AND dst IS NOT NULL").distinct().persist()
    try:
        left = cut(wanted.select("id").where("id IS NOT NULL").distinct())
        seen = delta = cut(ends.select("id").where("id IS NOT NULL").distinct().select("id", F.col("id").alias("end"), F.array("id").alias("path")))
        parts = [seen]
        for _ in range(ROUNDS):
            last, left = left, cut(left.join(delta, "id", "left_anti"))
            drop(last)
            if left.isEmpty():
                break
            found = steps.join(delta.withColumnRenamed("id", "dst"), "dst").join(seen.select(F.col("id").alias("src")), "src", "left_anti")
            found = found.groupBy(F.col("src").alias("id")).agg(F.min(F.struct("end", "path")).alias("n"))
            delta = cut(found.select("id", "n.end", F.concat(F.array("id"), "n.path").alias("path")))
            if delta.isEmpty():
                drop(delta)
                break
            seen = seen.unionByName(delta)
            parts.append(delta)
            if len(parts) >= 6:
                seen = cut(seen)
                drop(*parts[:-1])
                parts = [delta, seen]
        drop(left)
        return seen.join(wanted.select("id").distinct(), "id", "left_semi").select("id", "path")
    finally:
        steps.unpersist()
