"""Bottom-k sketches of word shingles with DataFrame functions only.

A sketch is the ``k`` smallest distinct 48-bit hashes of a text's shingles,
ascending.  Sketches of parts merge into the sketch of the whole; two of them
estimate resemblance and containment, one estimates the number of distinct
shingles.  With fewer than ``k`` shingles all these are exact.

Defined results: null and blank texts have an empty sketch; a text shorter
than a shingle has one shingle, all its words; two empty sketches have
resemblance 1, an empty and another one 0.  Rows of one id follow each other
by the hash of their texts, a null id comes before all others; a repeated row
is followed by its copy, a single row by itself; other columns are ignored; an
empty table gives an empty table.
"""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

K = 128
SHINGLE = 5
BITS = 48
#: Rows of a bucket in which a document meets its successor, and how many buckets there are at most.
BUCKET = 4096
BUCKETS = 1 << 16


def with_sketch(df: DataFrame, text: str, name: str, k: int = K, size: int = SHINGLE) -> DataFrame:
    """``df`` with the sketch of column ``text`` as array<long> column ``name``."""
    words, n = f"_{name}_words", F.size(f"_{name}_words")
    split = df.withColumn(words, F.array_remove(F.split(F.coalesce(F.col(text), F.lit("")), r"[\x20\x09-\x0D]+"), ""))
    hashes = F.when(n >= size, F.transform(F.sequence(F.lit(1), n - (size - 1)), lambda i: F.shiftrightunsigned(F.xxhash64(F.slice(words, i, size)), 64 - BITS)))
    hashes = hashes.when(n > 0, F.array(F.shiftrightunsigned(F.xxhash64(words), 64 - BITS))).otherwise(F.array().cast("array<bigint>"))
    return split.withColumn(name, F.slice(F.sort_array(F.array_distinct(hashes)), 1, k)).drop(words)


def as_text(sketch: str | Column) -> Column:
    """Twelve hex digits for each hash, ascending."""
    return F.array_join(F.transform(sketch, lambda x: F.lpad(F.hex(x), BITS // 4, "0")), "")


def resemblance(a: str, b: str, k: int = K) -> Column:
    """Estimated Jaccard similarity: the share of the union's ``k`` smallest that both have."""
    union = F.slice(F.sort_array(F.array_union(a, b)), 1, k)
    return F.when((F.size(a) == 0) & (F.size(b) == 0), F.lit(1.0)).otherwise(F.size(F.array_intersect(union, F.array_intersect(a, b))) / F.greatest(F.size(union), F.lit(1)))


def distinct_shingles(sketch: str | Column, k: int = K) -> Column:
    """Estimated number of distinct shingles; exact below ``k``."""
    return F.when(F.size(sketch) < k, F.size(sketch).cast("double")).otherwise((k - 1) * F.lit(2.0**BITS) / F.element_at(sketch, k))


def containment(a: str, b: str, k: int = K) -> Column:
    """Estimated share of a's shingles that b has too."""
    union = F.slice(F.sort_array(F.array_union(a, b)), 1, k)
    whole = resemblance(a, b, k) * distinct_shingles(union, k)
    return F.when(F.size(a) == 0, F.lit(1.0)).otherwise(F.least(F.lit(1.0), whole / distinct_shingles(a, k)))


def merged(parts: DataFrame, key: str, sketch: str, k: int = K, fan_in: int = 256) -> DataFrame:
    """(key, sketch): one sketch for each key; rounds of groups of about ``fan_in`` parts, however hot a key is."""
    smallest = F.slice(F.sort_array(F.array_distinct(F.flatten(F.collect_list("s")))), 1, k)
    rows = parts.select(F.col(key).alias("key"), F.col(sketch).alias("s"))
    left = rows.groupBy("key").count().agg(F.max("count")).first()[0] or 0
    while left > fan_in:
        groups = -(-left // fan_in)
        rows = rows.groupBy("key", F.pmod(F.hash("s"), F.lit(groups)).alias("g")).agg(smallest.alias("s")).select("key", "s")
        left = groups
    return rows.groupBy("key").agg(smallest.alias("s")).select(F.col("key").alias(key), F.col("s").alias(sketch))


def _place() -> Column:
    """What rows are ordered by: a null id first, then ids, then the tie."""
    return F.struct(F.col("doc_id").isNotNull().alias("has"), F.coalesce("doc_id", F.lit(0)).alias("id"), F.col("tie").alias("tie"))


def _heads(docs: DataFrame) -> list[tuple[bool, int, int]]:
    """The first row of each bucket, ascending; buckets come from a sample of the order, so any ids give even ones."""
    ids = docs.select(_place().alias("place"))
    buckets = min(BUCKETS, -(-ids.count() // BUCKET))
    if not buckets:
        return []
    rows = ids.repartitionByRange(buckets, "place").groupBy(F.spark_partition_id()).agg(F.min("place").alias("place")).collect()
    return sorted((r["place"]["has"], r["place"]["id"], r["place"]["tie"]) for r in rows)


def with_successor(docs: DataFrame, columns: list[str]) -> DataFrame:
    """Each row of ``docs`` (doc_id, tie, ...) with struct ``next``: ``columns`` of the row after it, cyclically.

    Rows are ordered by (doc_id, tie), a null id first.  They meet in buckets,
    ranges of about ``BUCKET`` rows (more where ``BUCKETS`` are full, or rows are
    equal); each bucket also gets the first row of the one after it, so rows are
    moved once and no task sees more than a bucket.  The buckets' first rows, at
    most ``BUCKETS`` of 24 bytes, are a constant in the plan.
    """
    heads = _heads(docs)
    if not heads:
        return docs.withColumn("next", F.struct(*columns))
    width = int(len(heads) ** 0.5) + 1
    row = lambda h: {"has": h[0], "id": h[1], "tie": h[2]}
    kind = "struct<has:boolean,id:bigint,tie:bigint>"
    groups = [heads[i : i + width] for i in range(0, len(heads), width)]
    outer = F.from_json(F.lit(json.dumps([row(g[0]) for g in groups])), f"array<{kind}>")
    inner = F.from_json(F.lit(json.dumps([[row(h) for h in g] for g in groups])), f"array<array<{kind}>>")
    # How many heads of groups, and then how many in the group, come at or before the row.
    group = F.size(F.filter(outer, lambda h: h <= F.col("_place")))
    placed = docs.withColumn("_place", _place()).withColumn("_group", group).withColumn("_heads", F.element_at(inner, F.col("_group")))
    placed = placed.withColumn("_rank", F.size(F.filter("_heads", lambda h: h <= F.col("_place"))))
    bucket = (F.col("_group") - 1) * width + F.col("_rank") - 1
    placed = placed.withColumn("bucket", bucket.cast("long")).withColumn("_first", F.element_at("_heads", F.col("_rank")) == F.col("_place"))
    inside = ("_place", "_group", "_heads", "_rank", "_first")
    guests = placed.where("_first").withColumn("bucket", F.pmod(F.col("bucket") - 1, F.lit(len(heads)).cast("long"))).drop(*inside).withColumn("guest", F.lit(1))
    rows = placed.drop(*inside).withColumn("guest", F.lit(0)).unionByName(guests)
    w = Window.partitionBy("bucket").orderBy("guest", F.col("doc_id").asc_nulls_first(), "tie")
    return rows.withColumn("next", F.lead(F.struct(*columns)).over(w)).where("guest = 0").drop("guest", "bucket")


def neighbours(documents: DataFrame, k: int = K, size: int = SHINGLE) -> DataFrame:
    """Fingerprints of every document and of its text edited with the next document's."""
    docs = documents.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    docs = with_sketch(docs.withColumn("tie", F.xxhash64("text")), "text", "sketch", k, size)
    docs = with_successor(docs, ["text", "sketch"]).withColumn("n_chars", F.char_length("text").cast("long"))
    half = F.floor(F.col("n_chars") / 2).cast("int")
    edited = F.concat(F.col("text").substr(F.lit(1), F.col("n_chars").cast("int") - half), F.col("next.text").substr(F.lit(1), half))
    docs = docs.select("doc_id", "n_chars", "sketch", F.col("next.sketch").alias("next_sketch"), edited.alias("edited"))
    docs = docs.withColumn("edited_sha256", F.sha2("edited", 256))
    docs = with_sketch(docs, "edited", "edited_sketch", k, size)
    return docs.select(
        "doc_id", "n_chars", "edited_sha256",
        as_text("sketch").alias("fingerprint"), as_text("edited_sketch").alias("edited_fingerprint"),
        resemblance("sketch", "edited_sketch", k).alias("near_edited"), resemblance("sketch", "next_sketch", k).alias("near_next"),
        distinct_shingles("sketch", k).alias("est_shingles"), containment("sketch", "edited_sketch", k).alias("kept_share"),
    )
