import collections
import hashlib
import random
import re
import struct
import zlib

import numpy as np
import pytest
from conftest import frame

from stratagraph.llm import bpe, fingerprints, media, packing, pii, toxicity, url_rules

tokenizers = pytest.importorskip("tokenizers")
public = pytest.importorskip("public_tokenizers")
PATH = public.path("word_bpe_49k.json")


def test_media(odd, odd_rows, none):
    got = media.media_features(media.encode_media(odd)).collect()
    want = collections.Counter()
    for d, t in odd_rows:
        b = (t or "").encode()
        p = b.ljust(max(192, -(-len(b) // 192) * 192))
        want[d, len(b), len(p), hashlib.sha256(p).hexdigest(), zlib.crc32(p[-16:])] += 1
    assert collections.Counter(tuple(r)[:5] for r in got) == want
    same = collections.defaultdict(set)
    for r in got:
        same[r["payload_sha256"]].add((r["media_sha256"], r["media_bytes"], r["feature"]))
    assert all(len(v) == 1 for v in same.values())
    assert media.media_features(media.encode_media(none)).count() == 0


def test_png_filters_and_checksums():
    rng = np.random.default_rng(0)
    payload = rng.integers(0, 256, 192 * 11, np.uint8).tobytes()
    for kinds in (rng.integers(0, 5, 11).astype(np.uint8), *(np.full(11, k, np.uint8) for k in range(5))):
        image = media.to_png(payload, kinds)
        assert media.read_png(image).tobytes() == payload
    for at in (3, 20, 60, len(image) - 14, len(image) - 2):
        broken = bytearray(image)
        broken[at] ^= 1
        with pytest.raises(ValueError):
            media.read_png(bytes(broken))
    with pytest.raises(ValueError):
        media.read_png(image[:-12])


def test_bpe_matches_library(odd, odd_rows):
    t = tokenizers.Tokenizer.from_file(PATH)
    rng = random.Random(1)
    texts = [x or "" for _, x in odd_rows] + ["DON'T 'll \x1c\x85y İstanbul ΣΑΣ ﬁ ́x 日本 12 <|endoftext|>a<|startoftext|>", "  "]
    texts += ["".join(rng.choice("abe'sltré 1!日\n\u3000") for _ in range(120)) for _ in range(200)]
    coder = bpe.load(PATH)
    for x in texts:
        ids = t.encode(x, add_special_tokens=False).ids
        assert coder.encode(x) == ids
        assert coder.decode(ids) == t.decode(ids, skip_special_tokens=False)
    got = bpe.round_trip(odd, PATH).collect()
    want = collections.Counter()
    for d, x in odd_rows:
        ids = t.encode(x or "", add_special_tokens=False).ids
        want[d, len(ids), hashlib.sha256(struct.pack(f"<{len(ids)}I", *ids)).hexdigest(), hashlib.sha256(t.decode(ids, skip_special_tokens=False).encode()).hexdigest()] += 1
    assert collections.Counter(map(tuple, got)) == want
    back = {(r["doc_id"], r["text"]) for r in bpe.decode(bpe.encode(odd, PATH), PATH).collect()}
    assert back == {(d, t.decode(t.encode(x or "", add_special_tokens=False).ids, skip_special_tokens=False)) for d, x in odd_rows}


def test_packing(odd, odd_rows, none):
    t = tokenizers.Tokenizer.from_file(PATH)
    got = packing.pack(odd, PATH).collect()
    bins = collections.defaultdict(list)
    want = collections.Counter()
    for d, x in odd_rows:
        ids = t.encode(x or "", add_special_tokens=False).ids + [1]
        for k, s in enumerate(range(0, len(ids), 4096)):
            part = ids[s : s + 4096]
            want[d, k, s, len(part), zlib.crc32(struct.pack(f"<{len(part)}I", *part))] += 1
    assert collections.Counter(tuple(r)[:5] for r in got) == want
    for r in got:
        bins[r["sequence_id"]].append((r["offset"], r["length"]))
    for v in bins.values():
        at = 0
        for offset, length in sorted(v):
            assert offset == at
            at += length
        assert at <= 4096
    assert len(bins) <= -(-sum(r["length"] for r in got) // 4096) + 1
    assert packing.pack(none, PATH).count() == 0


@pytest.mark.parametrize("seed", range(6))
def test_plan(seed):
    rng = random.Random(seed)
    lengths = collections.Counter(rng.choice([rng.randint(1, 100), rng.randint(1, 30), 60]) for _ in range(rng.choice([1, 20, 2000])))
    out = packing.plan(dict(lengths), 100, 6)
    held = collections.Counter()
    for n, room, runs in out:
        assert n > 0 and room >= 0 and room + sum(x * k for x, k in runs) == 100
        for x, k in runs:
            held[x] += n * k
    assert held == lengths
    lower = max(-(-sum(x * n for x, n in lengths.items()) // 100), sum(n for x, n in lengths.items() if x > 50))
    assert sum(n for n, _, _ in out) <= 1.12 * lower + 2
    table = packing.segments(out)
    assert (np.diff(table["key"]) > 0).all()


def test_base_spans():
    email = re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
    rng = random.Random(2)
    for _ in range(2000):
        text = "".join(rng.choice("ab1.@-%+ _") for _ in range(40))
        assert [(m.start(), 0, m.end()) for m in email.finditer(text)] == [s for s in pii.base_spans(text) if s[1] == 0]
    text = "é call +1 (988) 555-2485 or bob.42@mail8.example.com 4337166598464399; 42.144.35.254, 999.1.1.1"
    assert [(text[a:b], pii.KINDS[k]) for a, k, b in pii.base_spans(text)] == [("+1 (988) 555-2485", "phone"), ("bob.42@mail8.example.com", "email"), ("4337166598464399", "card"), ("42.144.35.254", "ip")]
    assert pii.luhn("4337166598464399") and not pii.luhn("4337166598464398")


def test_tagger_gradients():
    x, y = pii.training_windows(["plain words 12 and more words here"], 1)
    x, y = x[:12, :4], y[:12, :4]
    model = pii.Tagger(3)
    model.p = {k: v.astype(np.float64) for k, v in model.p.items()}
    _, grad = model.gradients(x, y)
    for name in ("emb", "wf", "ub", "cf", "out", "bias", "trans"):
        at = np.unravel_index(np.abs(grad[name]).argmax(), grad[name].shape)
        old, loss = model.p[name][at], []
        for d in (1e-3, -1e-3):
            model.p[name][at] = old + d
            loss.append(model.gradients(x, y)[0])
        model.p[name][at] = old
        assert abs((loss[0] - loss[1]) / 2e-3 - grad[name][at]) < 2e-2 * max(1, abs(grad[name][at]))


def test_pii(odd, odd_rows, none):
    weights = pii.fit(odd, 50)
    got = pii.find(odd, weights, redact=True).collect()
    texts = collections.defaultdict(set)
    for d, t in odd_rows:
        texts[d].add(t or "")
    for r in got:
        match = [t for t in texts[r["doc_id"]] if hashlib.sha256(pii.digest_form(pii.base_spans(t)).encode()).hexdigest() == r["base_sha256"]]
        assert match
        base = pii.digest_form(pii.base_spans(match[0])).split(",")
        assert set(base) <= set(r["spans"].split(","))
    assert len(got) == len(odd_rows)
    assert pii.redacted("ab cd@e.fg hi", [(3, 0, 10)]) == "ab [EMAIL] hi"
    assert pii.detect(none, 5).count() == 0
    model = pii.Tagger()
    model.p = weights
    found = pii.all_spans(["please write to mara.12 [at] lenor [dot] com today", "nothing here", ""], model)
    assert found[1] == ([], []) and found[2] == ([], [])


def test_pii_spelled_without_digits(spark):
    """Spans without a digit or an at-sign, in texts without either, are found and redacted."""
    model = pii.Tagger()
    model.p = pii.fit(spark.read.parquet("/root/testdata/sf0.001/documents.parquet"))
    # Leaving out stretches that can't pay changes nothing: each text has its best path.
    texts = ["a letter (at noon) for jane.doe [at] example [dot] com, 10.1.2.3 " * n for n in (1, 8, 3)] + ["", "call (312) 555-0199", "x"]
    e, first = pii.emissions(texts, model)
    got = model.viterbi(e, first[first < len(e)])
    for a, t in zip(first, texts):
        if t:
            assert (got[a : a + len(t)] == model._decode(e[a : a + len(t)][:, None], model.p["trans"])[:, 0]).all()
    plain = "the old man said that it is late. " * 6
    for span in ("jane.doe [at] example [dot] com", "name (at) site (dot) org"):
        text = f"{plain}write to {span} {plain}"
        ((base, found),) = pii.all_spans([text], model)
        assert base == [] and [(k, text[a:b]) for a, k, b in found] == [(0, span)]
        assert pii.redacted(text, found) == f"{plain}write to [EMAIL] {plain}"
    assert pii.all_spans([plain], model) == [([], [])]


def test_viterbi_is_global():
    """Random emissions and transitions, texts of every length: always the path that full decoding finds."""
    rng = np.random.default_rng(3)
    model = pii.Tagger()
    for trial in range(60):
        model.p["trans"] = rng.normal(0, 2, (pii.TAGS, pii.TAGS)).astype(np.float32)
        sizes = rng.integers(1, 40, 20)
        first = np.cumsum(sizes) - sizes
        e = rng.normal(0, 3, (sizes.sum(), pii.TAGS)).astype(np.float32)
        e[:, 0] += rng.choice([0, 4, 8, 14])
        got = model.viterbi(e, first)
        for a, n in zip(first, sizes):
            assert (got[a : a + n] == model._decode(e[a : a + n][:, None], model.p["trans"])[:, 0]).all()


def test_pii_held_out(spark):
    """Spans of a generator run that training has not seen, in texts it has not seen: found, and look-alikes left alone."""
    docs = [r["text"] for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").where("text IS NOT NULL").orderBy("doc_id").collect()]
    model = pii.Tagger()
    model.p = pii.train(docs[::2])
    rng = random.Random(99)
    hits = total = false = others = 0
    for _ in range(400):
        span, kind = pii._variants(rng)
        text = rng.choice(docs[1::2])
        at = rng.randrange(len(text) + 1)
        left, right = text[max(0, at - 150) : at], text[at : at + 150]
        ((base, found),) = pii.all_spans([f"{left} {span} {right}"], model)
        a = len(left) + 1
        if kind is None:
            others += 1
            false += any(s not in base and s[0] < a + len(span) and a < s[2] for s in found)
        elif kind != 2 or pii.luhn(re.sub("[^0-9]", "", span)):
            total += 1
            hits += (a, kind, a + len(span)) in found
    assert hits >= 0.9 * total and false <= 0.05 * others


def plain_base(text):
    """The four patterns as the contract words them, by ``re`` alone."""
    digits = lambda m: re.sub("[^0-9]", "", m)
    luhn = lambda d: sum(sum(divmod(int(c) * (1 + i % 2), 10)) for i, c in enumerate(reversed(d))) % 10 == 0
    rules = [
        (r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", lambda m: True),
        (r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", lambda m: all(int(p) <= 255 for p in m.split("."))),
        (r"[0-9]([\x20-]?[0-9])+", lambda m: 12 <= len(digits(m)) <= 19 and luhn(digits(m))),
        (r"\+[0-9][\x20().0-9-]+[0-9]", lambda m: 9 <= len(digits(m)) <= 15),
    ]
    return sorted((m.start(), k, m.end()) for k, (p, good) in enumerate(rules) for m in re.finditer(p, text) if good(m.group()))


def test_base_spans_of_all_kinds():
    rng = random.Random(4)
    pieces = ["+1 (988) 555-2485", "+44 20 7946 0958", "4337166598464399", "4337 1665 9846 4399", "1.2.3.4", "1.2.3.4.5", "256.1.1.1", "a@b.c", "12", "-", " ", ".", "+", "(", "0000000000000", "x", "\n", "é", "٣"]
    for _ in range(4000):
        text = "".join(rng.choice(pieces) for _ in range(rng.randint(0, 14)))
        assert pii.base_spans(text) == plain_base(text), text


def test_toxicity(spark):
    sf = "/root/testdata/sf0.01"
    d, labels = (spark.read.parquet(f"{sf}/{t}.parquet") for t in ("documents", "labels"))
    got = toxicity.classify(d, labels)
    rows = got.join(labels.select("doc_id", "toxic"), "doc_id").where("held_out").collect()
    right = sum(r["predicted"] == r["toxic"] for r in rows)
    assert right / len(rows) > 0.92
    assert sum(r["predicted"] for r in rows if not r["toxic"]) <= 0.03 * len(rows)
    assert all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 4 == 2) and 0 <= r["score"] <= 1 for r in got.collect())


def test_toxicity_edges(spark, odd, odd_rows, none):
    labels = spark.createDataFrame([(i, i % 2, None) for i in range(40)] + [(None, 1, None), (3, None, None)], "doc_id long, toxic int, quality int")
    assert toxicity.classify(odd, labels).count() == len(odd_rows)
    assert toxicity.classify(odd, labels.limit(0)).where("score > 0.01").count() == 0
    assert toxicity.classify(none, labels).count() == 0


def test_urls(spark):
    urls = [None, "", "nothing", "http://www.Example.com/en/1", "https://a.b.example.com/en/x?y#z", "http://x.net/es/", "http://net/fr/a", "http://anet/fr/", "http://example.com", "http://example.com?a/en/", "ftp://m.example.com/en", "http://www.example.com/en/?q=://z", "http://..com/", "http://com/", "x://y://example.com/en/"]
    pages = spark.createDataFrame([(i, u, "h", "x") for i, u in enumerate([*urls, *urls])], "page_id long, url string, host string, verdict string")
    rules = [("allow", "com", "/"), ("block", "example.com", "/en/"), ("allow", "www.example.com", "/en/"), ("block", "net", "/es/"), ("block", "net", "/fr/")]

    def plain(u):
        host = path = ""
        if u and "://" in u:
            rest = u.split("://", 1)[1]
            host = re.match(r"[^/?#]*", rest).group()
            path = re.match(r"[^?#]*", rest[len(host) :]).group()
            host = "".join(c.lower() if "A" <= c <= "Z" else c for c in host)
        hit = [(len(h + p), h + p, v) for v, h, p in rules if (host == h or host.endswith("." + h)) and path.startswith(p)]
        return (host, path, max(hit)[1], max(hit)[2]) if hit else (host, path, None, "allow")

    got = url_rules.judge(pages, url_rules.rules_frame(spark, rules)).collect()
    assert sorted(map(str, (tuple(g) for g in got))) == sorted(str((i, *plain(u))) for i, u in enumerate([*urls, *urls]))
    assert url_rules.judge(pages, url_rules.rules_frame(spark, rules).limit(0)).where("rule IS NOT NULL").count() == 0
    assert url_rules.judge(pages.limit(0), url_rules.rules_frame(spark, rules)).count() == 0


def shingles(t):
    w = re.findall(r"[^\x20\x09-\x0D]+", t)
    return {tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} if w else set()


def test_fingerprints(docs, rows, none):
    got = {r["doc_id"]: r for r in fingerprints.neighbours(docs).collect()}
    order = sorted((d, t or "") for d, t in rows)
    near = lambda a, b: len(a & b) / len(a | b) if a | b else 1.0
    for i, (d, t) in enumerate(order):
        after = order[(i + 1) % len(order)][1]
        half = len(t) // 2
        edited = t[: len(t) - half] + after[:half]
        r = got[d]
        assert r["n_chars"] == len(t) and r["edited_sha256"] == hashlib.sha256(edited.encode()).hexdigest()
        a, b, c = shingles(t), shingles(edited), shingles(after)
        if len(a | b) < 128:
            assert r["near_edited"] == pytest.approx(near(a, b))
        if len(a | c) < 128:
            assert r["near_next"] == pytest.approx(near(a, c))
        assert abs(r["near_edited"] - near(a, b)) < 0.2
        assert abs(r["est_shingles"] - len(a)) <= 0.35 * len(a)
    by = collections.defaultdict(set)
    for d, t in order:
        by[t].add(got[d]["fingerprint"])
    assert all(len(v) == 1 for v in by.values())
    assert fingerprints.neighbours(none).count() == 0


def test_successor(spark, odd, odd_rows, monkeypatch):
    """Buckets of seven rows and ids far apart: every row has the one after it, the last the first."""
    monkeypatch.setattr(fingerprints, "BUCKET", 7)
    far = [*odd_rows, (10**15, "far away"), (-(10**15), "before all"), *[(None, f"no id {i}") for i in range(40)]]
    docs = frame(spark, far).selectExpr("doc_id", "coalesce(text, '') AS text", "xxhash64(coalesce(text, '')) AS tie")
    rows = [(r["doc_id"], r["tie"], r["text"]) for r in docs.collect()]
    got = collections.Counter((r["doc_id"], r["text"], r["next"]["text"]) for r in fingerprints.with_successor(docs, ["text"]).collect())
    rows.sort(key=lambda r: (r[0] is not None, r[0] or 0, r[1]))
    assert got == collections.Counter((d, t, rows[(i + 1) % len(rows)][2]) for i, (d, _, t) in enumerate(rows))
    one = frame(spark, [(1, "alone")]).selectExpr("doc_id", "text", "1L AS tie")
    assert [r["next"]["text"] for r in fingerprints.with_successor(one, ["text"]).collect()] == ["alone"]


def test_fingerprints_odd_and_merge(spark, odd, odd_rows):
    assert fingerprints.neighbours(odd).count() == len(odd_rows)
    d = fingerprints.with_sketch(odd.select("doc_id", "text", (odd["doc_id"] % 2).alias("g")).where("doc_id IS NOT NULL"), "text", "s", k=16)
    one = {r["g"]: r["s"] for r in fingerprints.merged(d, "g", "s", k=16, fan_in=4).collect()}
    for g, sketch in one.items():
        want = sorted({x for r in d.where(f"g = {g}").collect() for x in r["s"]})[:16]
        assert sketch == want
