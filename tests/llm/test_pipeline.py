"""The corpus pipeline: each stage on odd rows, and all of them against plain versions."""

import collections
import random

import brute
import pytest
from conftest import frame

import corpus_pipeline

NAMES = [name for name, _ in corpus_pipeline.STAGES]
STAGE = dict(corpus_pipeline.STAGES)
BAD = "you stupid hateful idiot shut up nobody wants you here "


@pytest.fixture(scope="module")
def sf_dir(spark, odd, tmp_path_factory):
    """A table folder with clashing columns, nulls, repeated rows and ids, and labels that mark a word."""
    rng = random.Random(4)
    words = lambda n: " ".join(rng.choice("river stone letter morning garden window paper street music winter".split()) + str(rng.randrange(60)) for _ in range(n))
    passage = words(50)
    rows = [(i, (BAD * 3 + words(20)) if i % 4 == 0 else words(60)) for i in range(160)]
    rows += [(200 + i, words(30) + " " + passage + " " + words(30)) for i in range(6)]
    copy = words(80)
    rows += [(300, copy), (301, copy), (302, copy + " edited"), (303, None), (304, ""), (305, " \n "), (None, None), (None, words(40)), (300, copy), (306, "write to ann.lee@mail.example.org or 10.20.30.40 now " + words(20)), (307, words(9000))]
    path = str(tmp_path_factory.mktemp("pipeline") / "sf")
    frame(spark, rows).write.parquet(f"{path}/documents.parquet")
    spark.createDataFrame([(i, 0, int(i % 4 == 0)) for i in range(160)] + [(None, 1, 1), (999, None, None)], "doc_id long, quality int, toxic int").write.parquet(f"{path}/labels.parquet")
    return path


def test_stages(spark, sf_dir):
    """Every stage against its plain version on what the one before it kept."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    columns = docs.columns
    texts = lambda df: sorted((str(r["doc_id"]), r["text"] or "") for r in df.select("doc_id", "text").collect())
    for name in NAMES[:-1]:
        out = STAGE[name](spark, docs, sf_dir).persist()
        assert out.columns == columns
        before, after = texts(docs), texts(out)
        if name == "toxicity":
            assert after == [x for x in before if BAD not in x[1]]
        elif name == "ngram_join":
            rows = [(None if d == "None" else int(d), t) for d, t in before]
            kept = collections.Counter(t for _, t in after)
            classes = collections.defaultdict(set)
            for (d, t), (_, n, least) in zip(rows, brute.op3(rows, 5, 80)):
                classes[least if n and least is not None else t].add(t)
            assert sum(kept.values()) == len([1 for _, t in rows if not t.strip()]) + len([c for c in classes.values() if any(t.strip() for t in c)])
            assert all(any(t in kept for t in c) for c in classes.values())
        elif name == "substring_dedup":
            want = brute.op2([(d, t) for d, t in before])
            assert sum(len(brute.WORD.findall(t)) for _, t in after) == sum(n - gone for _, n, gone, _ in want)
            assert [d for d, _ in after] == [d for d, _ in before]
            untouched = {(d, t) for (d, t), (_, _, gone, _) in zip(before, want) if not gone}
            assert untouched <= set(after)
        else:
            assert len(after) == len(before) and not any("ann.lee@" in t or "10.20.30.40" in t for _, t in after)
            assert [t for d, t in after if d == "306"][0].startswith("write to [EMAIL] or [IP] now ")
        docs = out
    packed = STAGE["packing"](spark, docs, sf_dir).collect()
    assert collections.Counter(r["doc_id"] for r in packed if r["piece"] == 0) == collections.Counter(r["doc_id"] for r in docs.select("doc_id").collect())
    ends = collections.defaultdict(list)
    for r in packed:
        ends[r["sequence_id"]].append((r["offset"], r["offset"] + r["length"]))
    for spans in ends.values():
        spans.sort()
        assert spans[0][0] == 0 and spans[-1][1] <= 4096 and all(a[1] == b[0] for a, b in zip(spans, spans[1:]))


def test_empty_table(spark, sf_dir, none, tmp_path):
    none.write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0
