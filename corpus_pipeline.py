"""From raw documents to packed training sequences.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame that is written
and read again as the next stage's ``docs``; all but the last return the
columns of ``documents``.

Defined results, for every stage: a null text counts as empty, and a clean one
is kept; a row that repeats another row's id is a row of its own, a null id is
one too; of rows with one text the near-copy stage keeps one, but texts without
words all stay; columns beyond those of ``documents`` are carried along by the
first four stages, whatever their names; an empty table gives an empty one; the
length of a text makes no difference, stages read it whole.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import wraps

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from stratagraph.llm import ngram_join, packing, pii, substring_dedup, toxicity
from stratagraph.llm.session import drop, materialise

#: The stages can't be expressed in SQL: two of them apply trained models.
ORACLE_SQL = None


Stage = Callable[[SparkSession, DataFrame, str], DataFrame]
#: Columns that stages read or write; all others get names of their own on the way through.
OWN = ("doc_id", "text", "n_chars")


def _carrying(stage: Stage) -> Stage:
    """A stage for which other columns can't clash with what the operators call theirs."""

    @wraps(stage)
    def run_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        names = [c if c in OWN else f"_carried_{i}" for i, c in enumerate(docs.columns)]
        return stage(spark, docs.toDF(*names), sf_dir).select(*names).toDF(*docs.columns)

    return run_stage


def _vocabulary() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


@_carrying
def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier, fitted on the labelled ones, doesn't reject."""
    labels = spark.read.parquet(f"{sf_dir.rstrip('/')}/labels.parquet")
    scored = toxicity.score(docs, toxicity.fit(docs, labels), keep=docs.columns)
    return scored.where("predicted = 0").select(*docs.columns)


@_carrying
def keep_one_of_each(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each class of near copies: five words, similarity 0.8 or more."""
    return ngram_join.keep_one(docs, size=5, percent=80)


@_carrying
def drop_repeated_spans(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without the words of repeated 35-word windows; others stay as they are."""
    extra = tuple(c for c in docs.columns if c not in OWN)
    out = substring_dedup.remove_repeats(docs.withColumn("_text", F.col("text")), want_text=True, extra=(*extra, "_text"))
    text = F.when(F.col("n_removed") > 0, F.col("kept")).otherwise(F.col("_text"))
    return _columns(out.withColumn("text", text), docs)


@_carrying
def redact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts with a placeholder for each span of personal data."""
    found = pii.find(docs, pii.fit(docs), keep=[c for c in docs.columns if c != "text"], redact=True)
    return _columns(found.withColumn("text", F.col("redacted")), docs)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sequences of at most 4096 tokens."""
    return packing.pack(docs, _vocabulary())


def _columns(out: DataFrame, docs: DataFrame) -> DataFrame:
    if "n_chars" in docs.columns:
        out = out.withColumn("n_chars", F.char_length("text").cast("long"))
    return out.select(*docs.columns)


STAGES = [
    ("toxicity", drop_toxic),
    ("ngram_join", keep_one_of_each),
    ("substring_dedup", drop_repeated_spans),
    ("pii", redact),
    ("packing", pack),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; each stage's input is deleted once the next one's is written."""
    docs = spark.read.parquet(f"{sf_dir.rstrip('/')}/documents.parquet")
    before = None
    for name, stage in STAGES:
        docs = materialise(stage(spark, docs, sf_dir), name)
        if before is not None:
            drop(before)
        before = docs
    return docs
