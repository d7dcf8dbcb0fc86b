import hashlib
import random

import brute
import numpy as np
import pytest
from conftest import frame

from stratagraph.llm import ngram_join, session, substring_dedup, suffix_dedup
from stratagraph.llm.components import components


def key(rows):
    return sorted(tuple("" if v is None else str(v) for v in r) for r in rows)


def test_substring(docs, rows, none):
    got = substring_dedup.remove_repeats(docs).select("doc_id", "n_words", "n_removed", "kept_sha256").collect()
    assert key(got) == key(brute.op2(rows))
    assert substring_dedup.remove_repeats(none).count() == 0


def test_substring_odd(odd, odd_rows):
    got = substring_dedup.remove_repeats(odd, want_text=True, extra=("lang",)).select("doc_id", "n_words", "n_removed", "kept_sha256").collect()
    assert key(got) == key(brute.op2(odd_rows))


def test_suffix(docs, rows, none):
    got = suffix_dedup.remove_earlier(docs).select("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256").collect()
    assert key(got) == key(brute.op6(rows))
    assert suffix_dedup.remove_earlier(none).count() == 0


def test_suffix_odd(odd, odd_rows):
    assert suffix_dedup.remove_earlier(odd).count() == len(odd_rows)


def test_index_family_levels():
    rng = random.Random(1)
    text = bytes(rng.choice(b"ab\0") for _ in range(900))
    family, seen, got, want = suffix_dedup.IndexFamily(6), set(), [], []
    data = np.frombuffer(text, np.uint8)
    for a in range(0, 880, 20):
        starts = np.arange(a, a + 20)
        got += family.add(data, starts, starts).tolist()
        for s in starts:
            want.append(text[s : s + 6] in seen)
            seen.add(text[s : s + 6])
    assert got == want and len(family.levels) < 10
    assert all(x[0] > y[0] for x, y in zip(family.levels, family.levels[1:]))


@pytest.mark.parametrize("size,percent", [(4, 85), (5, 80)])
def test_join(docs, rows, size, percent):
    got = ngram_join.link_classes(docs, size, percent).select("doc_id", "n_shingles", "component_id").collect()
    assert key(got) == key(brute.op3(rows, size, percent))


def test_join_odd(odd, odd_rows, none):
    got = ngram_join.link_classes(odd, 4, 85).select("doc_id", "n_shingles", "component_id").collect()
    assert key(got) == key(brute.op3(odd_rows))
    assert ngram_join.link_classes(none, 4, 85).count() == 0


def test_keep_one(odd, odd_rows):
    kept = ngram_join.keep_one(odd, 5, 80)
    assert kept.columns == odd.columns
    ids = [r["doc_id"] for r in kept.select("doc_id").collect()]
    want = {c for _, n, c in brute.op3(odd_rows, 5, 80) if n}
    assert want - {None} <= set(ids) and len([i for i in ids if i is not None]) == len({i for i in ids if i is not None}) + (1 if ids.count(5) == 2 else 0)


def test_components(spark):
    rng = random.Random(3)
    edges = [(rng.randrange(300), rng.randrange(300)) for _ in range(180)] + [(1000 + i, 1001 + i) for i in range(60)]
    parent = {}

    def root(x):
        while parent.setdefault(x, x) != x:
            x = parent[x]
        return x

    for a, b in edges:
        if a != b:
            parent[root(a)] = root(b)
    got = {r["node"]: r["label"] for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert set(got) == {x for a, b in edges if a != b for x in (a, b)}
    assert len(set(got.values())) == len({root(x) for x in got})
    assert all(got[a] == got[b] for a, b in edges if a != b)


@pytest.fixture(scope="module")
def unnamed_rows():
    """2,000 distinct texts without an id and 500 of one id; two passages are in many of them, at many places."""
    rng = random.Random(11)
    words = lambda n: ["".join(rng.choice("abcdefgh") for _ in range(6)) for _ in range(n)]
    passages = [words(40), words(40)]
    texts = []
    for i in range(2500):
        w, at = words(60), i % 50 + 1
        texts.append(" ".join(w if i % 3 else w[:at] + passages[i % 2] + w[at:]))
    return [(None if i < 2000 else 7, t) for i, t in enumerate(texts)]


def earlier(rows, k=100):
    """brute.op6 with the least (doc_id, start) of a window as its first, where rows share an id."""
    place = lambda d, i: (d is not None, d or 0, i)
    first, out = {}, []
    rows = [(d, t.encode()) for d, t in rows]
    for d, x in rows:
        for i in range(len(x) - k + 1):
            w = x[i : i + k]
            first[w] = min(first.get(w, place(d, i)), place(d, i))
    for d, x in rows:
        gone = bytearray(len(x))
        for i in range(len(x) - k + 1):
            if first[x[i : i + k]] != place(d, i):
                gone[i : i + k] = b"\1" * k
        kept = bytes(b for b, g in zip(x, gone) if not g)
        out.append((d, len(x), sum(gone), hashlib.sha256(kept).hexdigest()))
    return out


def test_substring_unnamed(spark, unnamed_rows):
    got = substring_dedup.remove_repeats(frame(spark, unnamed_rows)).select("doc_id", "n_words", "n_removed", "kept_sha256").collect()
    assert key(got) == key(brute.op2(unnamed_rows))


def test_suffix_unnamed(spark, unnamed_rows, monkeypatch):
    monkeypatch.setattr(suffix_dedup, "BATCH", 2000)
    got = suffix_dedup.remove_earlier(frame(spark, unnamed_rows)).select("doc_id", "n_bytes", "n_removed", "kept_sha256").collect()
    assert key(got) == key(earlier(unnamed_rows))


def test_join_unnamed(spark, unnamed_rows):
    pairs = [(d, f"{t} {i}") for i, (d, t) in enumerate(unnamed_rows)] + [(None, f"{t} edited") for _, t in unnamed_rows[:300]]
    got = ngram_join.link_classes(frame(spark, pairs), 4, 85).select("doc_id", "n_shingles", "component_id", "label").collect()
    want = brute.op3(pairs)
    assert key(r[:3] for r in got) == key(want)
    assert len({r["label"] for r in got}) == 2500


def test_keep_one_unnamed(spark, unnamed_rows):
    blanks = [(None, " " * n) for n in range(1, 40)]
    kept = ngram_join.keep_one(frame(spark, [*unnamed_rows, *blanks]), 5, 80)
    assert key(kept.select("doc_id", "text").collect()) == key([*unnamed_rows, *blanks])


def test_keys_beyond_broadcast(spark, odd, odd_rows, monkeypatch):
    monkeypatch.setattr(session, "REPEATED_IDS", 0)
    got = substring_dedup.remove_repeats(odd).select("doc_id", "n_words", "n_removed", "kept_sha256").collect()
    assert key(got) == key(brute.op2(odd_rows))


def test_compact(spark):
    """A path over two documents, a branch, a cycle without a branch, and a long chain of single arcs."""
    arcs = [
        (1, 2, 10, 11, 1, 0, 0), (2, 1, 11, 12, 1, 0, 2), (3, 4, 12, 13, 2, 0, 7), (4, 1, 13, 14, 2, 0, 11), (5, 1, 13, 15, 3, 0, 0),
        (6, 1, 20, 21, 4, 0, 0), (7, 1, 21, 20, 5, 0, 0),
        *[(100 + i, 1, 1000 + i, 1001 + i, 50 + i, 0, 3) for i in range(37)],
    ]
    df = spark.createDataFrame([(a, -a, cnt, src, dst, d, k, start) for a, cnt, src, dst, d, k, start in arcs], "a1 long, a2 long, cnt int, src long, dst long, doc_id long, k long, start long")
    got = {r["a1"]: (r["p1"], r["p2"], r["offset"]) for r in substring_dedup.compact(df).collect()}
    assert got == {
        1: (1, -1, 0), 2: (1, -1, 2), 3: (1, -1, 3), 4: (4, -4, 0), 5: (5, -5, 0), 6: (6, -6, 0), 7: (7, -7, 0), **{100 + i: (100, -100, i) for i in range(37)}
    }


def test_long_spans(spark):
    rows = [(1, 0, 5, 2, 9, 9, 0), (1, 0, 7, 3, 9, 9, 2), (1, 0, 20, 1, 9, 9, 15), (1, 0, 30, 1, 9, 9, 0), (None, 0, 4, 1, 8, 8, 4)]
    df = spark.createDataFrame(rows, "doc_id long, k long, start long, cnt int, p1 long, p2 long, offset long")
    got = sorted((str(r["doc_id"]), r["start"], r["length"], r["offset"]) for r in substring_dedup.long_spans(df, 35).collect())
    assert got == [("1", 5, 39, 0), ("1", 20, 35, 15), ("1", 30, 35, 0), ("None", 4, 35, 4)]


def test_suffix_hot(spark, odd, odd_rows, monkeypatch):
    """Fragments around frequent minimizers are cut by a second one, with the same result."""
    monkeypatch.setattr(suffix_dedup, "HOT", 10)
    got = suffix_dedup.remove_earlier(odd).select("doc_id", "n_bytes", "n_removed", "kept_sha256").collect()
    assert key(got) == key(earlier([(d, t or "") for d, t in odd_rows]))


def test_sketch_bounds():
    """The parity sketch never says that two sets are farther apart than they are."""
    rng = np.random.default_rng(2)
    for n in (1, 30, 400, 3000):
        x = rng.integers(0, 2**63, n).astype(np.uint64)
        y = np.concatenate([x[: n - n // 4], rng.integers(0, 2**63, n // 3).astype(np.uint64)])
        a, b = ngram_join._sketch(x).view(np.uint8), ngram_join._sketch(y).view(np.uint8)
        apart = len(np.setxor1d(x, y))
        assert int(np.unpackbits(a ^ b).sum()) <= apart
