"""Personal data: base patterns, and a character BiLSTM with CRF transitions that adds spans.

Base spans come from four patterns and their checks.  The model reads
characters as 48 classes (letters, digits and marks folded), runs an LSTM in
both directions and decodes tags O and B/I of each kind with a linear-chain
CRF; everything is numpy.  It is trained on spans that the patterns find in a
bounded sample of documents (``SAMPLE`` texts, ``BASE_WINDOWS`` windows), and on
``VARIANTS`` generated windows with spans that the patterns don't know (spelled
or spaced separators, numbers with other marks), which are what it is there for.

A whole text is read in windows of ``SPAN`` characters that overlap by 32.
Where two windows give emissions for a character, these are averaged, weighted
by the distance from the window's edge.  The document's whole sequence of
emissions is then decoded at once: one Viterbi path for each text.  Stretches
on which no path away from O can pay (a bound on every interval's gain shows
it) are O without being decoded, so the path is the best one of the whole text.
A model span is kept if it has the characters its kind needs and meets no base
span.

Offsets are code points, ends exclusive.  Null texts are empty.  Rows that
repeat an id are rows of their own.  Base spans of different kinds may overlap
and all count; redaction then puts one placeholder for the first.  Other
columns are ignored; an empty table gives an empty one.
"""

from __future__ import annotations

import hashlib
import random
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stratagraph.llm.session import small_batches

KINDS = ("email", "ip", "card", "phone")
SAMPLE = 400
HIDDEN, EMBED, CLASSES = 8, 8, 48
WINDOW = 64
#: Whole texts are read in windows of ``SPAN`` characters that begin every ``STRIDE`` characters.
SPAN, STRIDE = 256, 224
TAGS = 1 + 2 * len(KINDS)
SEED = 7
STEPS, BATCH, RATE = 260, 64, 0.02
#: Training windows around base spans, at most, and around generated variants.
BASE_WINDOWS, VARIANTS = 2400, 2400
#: Characters whose emissions are held together; a longer text is held whole.
TOGETHER = 1 << 19

_DOMAIN = re.compile(r"@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_IP = re.compile(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)")
_CARD = re.compile(r"[0-9]([\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
#: What an e-mail has: an at-sign or the word, then a dot or the word.
_MARKED = re.compile(r"(@|\bat\b).*(\.|\bdot\b)", re.S | re.I)
_DIGIT = re.compile(r"[0-9]")


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = int(c) * (1 + i % 2)
        total += d - 9 * (d > 9)
    return total % 10 == 0


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, kind, end), sorted: leftmost non-overlapping matches of each kind that pass its check."""
    out = []
    at = text.find("@")
    done = 0
    while at >= 0:
        # A match is a maximal run of local characters that ends here, after the last match, and a domain.
        start = at
        while start > done and text[start - 1] in _LOCAL:
            start -= 1
        m = _DOMAIN.match(text, at) if start < at else None
        if m:
            out.append((start, 0, m.end()))
            done = m.end()
        at = text.find("@", m.end() if m else at + 1)
    if _DIGIT.search(text):
        for m in _IP.finditer(text):
            if all(int(p) <= 255 if len(p) < 20 else int(p[-20:]) <= 255 and not p[:-20].strip("0") for p in m.group().split(".")):
                out.append((m.start(), 1, m.end()))
        for m in _CARD.finditer(text):
            if m.end() - m.start() < 12:
                continue
            digits = m.group().replace(" ", "").replace("-", "")
            if 12 <= len(digits) <= 19 and luhn(digits):
                out.append((m.start(), 2, m.end()))
        for m in _PHONE.finditer(text):
            if 9 <= sum(c in "0123456789" for c in m.group()) <= 15:
                out.append((m.start(), 3, m.end()))
    return sorted(out)


def digest_form(spans: list[tuple[int, int, int]]) -> str:
    return ",".join(f"{KINDS[k]}:{a}:{b}" for a, k, b in spans)


# --- the model ---------------------------------------------------------------

_MARKS = "\n .,@+-()[]{}<>_%:;/\\'\"|#*=&!?"


def _classes() -> np.ndarray:
    table = np.full(65536, 1, np.int8)
    for c in range(65536):
        ch = chr(c)
        if ch.isalpha():
            table[c] = 2
    for c in "0123456789":
        table[ord(c)] = 3
    for c in "adotAT":  # letters of spelled separators
        table[ord(c)] = 4 + "adotAT".index(c)
    for i, c in enumerate(_MARKS):
        table[ord(c)] = 10 + i
    return table


_CLASS = _classes()


def classes(text: str) -> np.ndarray:
    points = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
    return _CLASS[np.minimum(points, 65535)]


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-x))


class Tagger:
    """BiLSTM emissions and CRF transitions."""

    def __init__(self, seed: int = SEED):
        rng = np.random.default_rng(seed)
        h, e = HIDDEN, EMBED
        g = lambda *s: (rng.standard_normal(s) / np.sqrt(s[0])).astype(np.float32)
        self.p = {"emb": g(CLASSES, e) * 2, "out": g(2 * h, TAGS), "bias": np.zeros(TAGS, np.float32), "trans": np.zeros((TAGS, TAGS), np.float32)}
        for d in "fb":
            self.p |= {f"w{d}": g(e, 4 * h), f"u{d}": g(h, 4 * h), f"c{d}": np.repeat(np.float32([0, 1, 0, 0]), h)}

    def _run(self, x: np.ndarray, d: str, keep: list | None = None) -> np.ndarray:
        """Hidden states of one direction for (time, batch) classes."""
        p, h = self.p, HIDDEN
        inputs = p["emb"] @ p[f"w{d}"] + p[f"c{d}"]  # one row for each class
        t_all, n = x.shape
        out = np.empty((t_all, n, h), np.float32)
        hid, cell = np.zeros((n, h), np.float32), np.zeros((n, h), np.float32)
        for t in range(t_all) if d == "f" else range(t_all - 1, -1, -1):
            z = hid @ p[f"u{d}"]
            z += inputs.take(x[t], 0, mode="clip")
            s = _sigmoid(z[:, : 3 * h])
            g = np.tanh(z[:, 3 * h :])
            before, old = cell, hid
            cell = s[:, h : 2 * h] * cell + s[:, :h] * g
            tc = np.tanh(cell)
            hid = s[:, 2 * h :] * tc
            out[t] = hid
            if keep is not None:
                keep.append((t, s, g, before, tc, old))
        return out

    def _read(self, x: np.ndarray, d: str, out: np.ndarray) -> None:
        """``_run`` without anything kept: one row for each gate, in place, into ``out`` (time, hidden, batch).

        tanh(v) is 2 sigmoid(2 v) - 1, so all gates take one exponential.
        """
        p, h, n = self.p, HIDDEN, x.shape[1]
        double = np.repeat(np.float32([-1, -1, -1, -2]), h)
        inputs = np.ascontiguousarray(((p["emb"] @ p[f"w{d}"] + p[f"c{d}"]) * double).T.astype(np.float32))
        onward = np.ascontiguousarray((p[f"u{d}"] * double).T.astype(np.float32))
        hid, cell, part = (np.zeros((h, n), np.float32) for _ in range(3))
        z, step = np.empty((4 * h, n), np.float32), np.empty((4 * h, n), np.float32)
        i, f, o, g = (z[k * h : (k + 1) * h] for k in range(4))
        for t in range(len(x)) if d == "f" else range(len(x) - 1, -1, -1):
            np.matmul(onward, hid, out=z)
            np.take(inputs, x[t], axis=1, out=step, mode="clip")
            z += step
            np.exp(z, out=z)
            z += 1
            np.reciprocal(z, out=z)
            g *= 2
            g -= 1
            g *= i
            cell *= f
            cell += g
            np.multiply(cell, -2, out=part)
            np.exp(part, out=part)
            part += 1
            np.divide(2, part, out=part)
            part -= 1
            hid = out[t]
            np.multiply(part, o, out=hid)

    def emissions(self, x: np.ndarray) -> np.ndarray:
        """(time, batch, tag) for (time, batch) classes."""
        both = np.empty((x.shape[0], 2 * HIDDEN, x.shape[1]), np.float32)
        x = x.astype(np.intp)
        with np.errstate(over="ignore"):
            self._read(x, "f", both[:, :HIDDEN])
            self._read(x, "b", both[:, HIDDEN:])
        return np.matmul(self.p["out"].T.astype(np.float32), both).transpose(0, 2, 1) + self.p["bias"].astype(np.float32)

    def viterbi(self, e: np.ndarray, first: np.ndarray) -> np.ndarray:
        """Best tags of texts with emissions ``e`` (character, tag) one after the other; ``first``: where texts begin."""
        tags = np.zeros(len(e), np.int8)
        away = self.p["trans"].astype(np.float64) - self.p["trans"][0, 0]
        # What an interval off O gains is at most its characters' gains, the steps within, and those into and out of it
        # (one of which is missing at a text's edge).
        into, out = float(away[0, 1:].max()), float(away[1:, 0].max())
        total = np.cumsum((e[:, 1:].max(1) - e[:, 0]).astype(np.float64) + max(float(away[1:, 1:].max()), 0.0))
        before = np.concatenate([[0.0], total[:-1]])
        best = np.maximum.accumulate(total[::-1])[::-1] - np.minimum.accumulate(before) + max(into + out, into, out, 0.0)
        place = np.flatnonzero(best > -1e-3)
        if not len(place):
            return tags
        begins = np.zeros(len(e) + 1, bool)
        begins[first] = begins[-1] = True
        new = np.ones(len(place), bool)
        new[1:] = (place[1:] != place[:-1] + 1) | begins[place[1:]]
        start = place[new]
        stop = start + np.diff(np.append(np.flatnonzero(new), len(place)))
        # One character of O on each side, where the text goes on.
        left, right = ~begins[start], ~begins[stop]
        start, stop = start - left, stop + right
        turn = np.where(right, 1, -1)  # stretches that end with their text are read backwards
        whole = ~left & ~right
        # Stretches of about one length go together, so that few are carried along for a long one.
        octave = np.where(whole, -1, np.log2(stop - start).astype(np.int64))
        groups = [g for k in np.unique(octave[octave >= 0]) for all_ in [np.flatnonzero(octave == k)] for g in np.array_split(all_, -(-len(all_) // 2048))]
        groups += [np.flatnonzero(whole & (stop - start == n)) for n in np.unique((stop - start)[whole])]
        for g in groups:
            size = stop[g] - start[g]
            step = np.arange(size.max())[:, None]
            at = np.where(turn[g] > 0, start[g], stop[g] - 1) + turn[g] * np.minimum(step, size - 1)
            part = e[at]
            part[0, (np.where(turn[g] > 0, left[g], right[g])), 1:] = -1e4
            part[step >= size - (np.where(turn[g] > 0, right[g], left[g]))] = [0] + [-1e4] * (TAGS - 1)
            for way, trans in ((1, self.p["trans"]), (-1, self.p["trans"].T)):
                some = np.flatnonzero(turn[g] == way)
                if len(some):
                    path, inside = self._decode(part[:, some], trans), step < size[some]
                    tags[at[:, some][inside]] = path[inside]
        return tags

    @staticmethod
    def _decode(e: np.ndarray, trans: np.ndarray) -> np.ndarray:
        """Best tags for (time, batch) emissions."""
        score = e[0]
        back = np.empty(e.shape, np.int8)
        few = e.shape[1] <= 64  # then one step for all pairs of tags is cheaper than nine
        for t in range(1, len(e)):
            if few:
                pairs = score[:, :, None] + trans
                back[t] = pairs.argmax(1)
                score = pairs.max(1) + e[t]
                continue
            best, pick = score[:, :1] + trans[0], np.zeros(e.shape[1:], np.int8)
            for k in range(1, TAGS):
                other = score[:, k : k + 1] + trans[k]
                np.copyto(pick, k, where=other > best)
                np.maximum(best, other, out=best)
            back[t] = pick
            score = best + e[t]
        tags = np.empty(e.shape[:2], np.int8)
        tags[-1] = score.argmax(1)
        rows = np.arange(e.shape[1])
        for t in range(len(e) - 1, 0, -1):
            tags[t - 1] = back[t, rows, tags[t]]
        return tags

    def gradients(self, x: np.ndarray, y: np.ndarray) -> tuple[float, dict[str, np.ndarray]]:
        """Mean negative log-likelihood of the tag paths and its gradients."""
        p, h, (t_all, n) = self.p, HIDDEN, x.shape
        kept: dict[str, list] = {"f": [], "b": []}
        both = np.concatenate([self._run(x, d, kept[d]) for d in "fb"], axis=2)
        e, trans = both @ p["out"] + p["bias"], p["trans"]

        def lse(v: np.ndarray, axis: int) -> np.ndarray:
            m = v.max(axis, keepdims=True)
            return (m + np.log(np.exp(v - m).sum(axis, keepdims=True))).squeeze(axis)

        alpha, beta = np.empty_like(e), np.zeros_like(e)
        alpha[0] = e[0]
        for t in range(1, t_all):
            alpha[t] = lse(alpha[t - 1][:, :, None] + trans, 1) + e[t]
        for t in range(t_all - 2, -1, -1):
            beta[t] = lse(trans[None] + (e[t + 1] + beta[t + 1])[:, None, :], 2)
        z = lse(alpha[-1], 1)
        rows = np.arange(n)
        gold = e[np.arange(t_all)[:, None], rows, y].sum(0) + trans[y[:-1], y[1:]].sum(0)
        de = np.exp(alpha + beta - z[None, :, None])
        dtrans = np.zeros_like(trans)
        for t in range(1, t_all):
            dtrans += np.exp(alpha[t - 1][:, :, None] + trans + (e[t] + beta[t])[:, None, :] - z[:, None, None]).sum(0)
        np.add.at(dtrans, (y[:-1], y[1:]), -1)
        de[np.arange(t_all)[:, None], rows, y] -= 1
        de /= n
        grad = {"trans": dtrans / n, "out": np.einsum("tnh,tnk->hk", both, de), "bias": de.sum((0, 1)), "emb": np.zeros_like(p["emb"])}
        dboth = de @ p["out"].T
        for i, d in enumerate("fb"):
            dout = dboth[:, :, i * h : (i + 1) * h]
            dw_in = np.zeros((CLASSES, 4 * h), np.float32)
            du = np.zeros_like(p[f"u{d}"])
            dh, dc = np.zeros((n, h), np.float32), np.zeros((n, h), np.float32)
            for t, s, g, before, tc, old in reversed(kept[d]):
                dh = dh + dout[t]
                si, sf, so = s[:, :h], s[:, h : 2 * h], s[:, 2 * h :]
                dc = dc + dh * so * (1 - tc**2)
                dz = np.concatenate([dc * g * si * (1 - si), dc * before * sf * (1 - sf), dh * tc * so * (1 - so), dc * si * (1 - g**2)], axis=1)
                np.add.at(dw_in, x[t], dz)
                du += old.T @ dz
                dh, dc = dz @ p[f"u{d}"].T, dc * sf
            grad[f"u{d}"], grad[f"c{d}"], grad[f"w{d}"] = du, dw_in.sum(0), p["emb"].T @ dw_in
            grad["emb"] += dw_in @ p[f"w{d}"].T
        return float((z - gold).mean()), grad


def _variants(rng: random.Random) -> tuple[str, int] | tuple[str, None]:
    """A span that the patterns don't find, with its kind; or a look-alike without kind."""
    word = lambda a, b: "".join(rng.choice("aeionrtsldm") for _ in range(rng.randint(a, b)))
    num = lambda n: "".join(rng.choice("0123456789") for _ in range(n))
    pick = rng.random()
    if pick < 0.25:
        at, dot = rng.choice([(" [at] ", " [dot] "), (" (at) ", " (dot) "), ("[at]", "[dot]"), (" @ ", ".")])
        return f"{word(3, 8)}{rng.choice([num(2), f'.{num(2)}', f'_{num(2)}', f'.{word(3, 8)}', f'_{word(3, 8)}', ''])}{at}{word(3, 8)}{dot}{rng.choice(['com', 'net', 'org'])}", 0
    if pick < 0.4:
        return rng.choice(["[.]", " . ", "(.)"]).join(str(rng.randint(1, 254)) for _ in range(4)), 1
    if pick < 0.55:
        sep = rng.choice([".", "  ", "/"])
        return sep.join(num(4) for _ in range(4)), 2
    if pick < 0.75:
        return rng.choice(["({0}) {1}-{2}", "{0}-{1}-{2}", "{0}.{1}.{2}", "00{3} {0} {1} {2}"]).format(num(3), num(3), num(4), num(2)), 3
    return rng.choice([num(rng.randint(1, 6)), f"{num(4)}-{num(2)}-{num(2)}", f"{num(2)}:{num(2)}", f"{num(3)}.{num(2)}", f"{num(1)}.{num(1)}.{num(2)}", f"@{word(3, 8)}", f"{num(2)}%", f"{word(2, 6)}{num(3)}", f"{word(3, 8)} at {word(3, 8)}", f"{word(3, 8)} (at {word(3, 8)})", f"{word(3, 8)}. {word(3, 8)}"]), None


def _mask(text: str) -> bytearray:
    out = bytearray(len(text))
    for a, _, b in base_spans(text):
        out[a:b] = b"\1" * (b - a)
    return out


def training_windows(texts: list[str], seed: int = SEED) -> tuple[np.ndarray, np.ndarray]:
    """(time, example) classes and tags: windows around base spans, and texts with generated variants put in."""
    rng = random.Random(seed)
    rows, tags = [], []

    def add(text: str, spans: list[tuple[int, int, int]], middle: int) -> None:
        start = max(0, middle - rng.randint(8, WINDOW - 8))
        x, y = np.zeros(WINDOW, np.int8), np.zeros(WINDOW, np.int8)
        part = classes(text[start : start + WINDOW])
        x[: len(part)] = part
        for a, k, b in spans:
            lo, hi = max(a - start, 0), min(b - start, WINDOW)
            if lo < hi:
                y[lo:hi] = 2 + 2 * k
                if a >= start:
                    y[lo] = 1 + 2 * k
        rows.append(x)
        tags.append(y)

    plain = texts or ["the quick brown fox jumps over the lazy dog and runs on. " * 3]
    known: list[tuple[str, list[tuple[int, int, int]], int]] = []
    for text in plain:
        found: list[tuple[int, int, int]] = []
        for a, k, b in base_spans(text):
            if not found or a >= found[-1][2]:
                found.append((a, k, b))
        known += [(text, found, (a + b) // 2) for a, _, b in found]
    for text, found, middle in rng.sample(known, min(len(known), BASE_WINDOWS)):
        add(text, found, middle)
    bare = [re.sub("\0+", " ", "".join("\0" if cut else c for c, cut in zip(t, _mask(t)))) for t in plain]
    for _ in range(VARIANTS):
        text = rng.choice(bare)
        at = rng.randrange(len(text) + 1)
        left, right = text[max(0, at - 80) : at], text[at : at + 80]
        span, kind = _variants(rng)
        whole = f"{left} {span} {right}"
        a = len(left) + 1
        add(whole, [] if kind is None else [(a, kind, a + len(span))], a + len(span) // 2)
    return np.array(rows).T.copy(), np.array(tags).T.copy()


def train(texts: list[str], steps: int = STEPS, seed: int = SEED) -> dict[str, np.ndarray]:
    """Weights after ``steps`` of Adam on the training windows of ``texts``."""
    x, y = training_windows(texts, seed)
    model, rng = Tagger(seed), np.random.default_rng(seed)
    m = {k: np.zeros_like(v) for k, v in model.p.items()}
    v2 = {k: np.zeros_like(v) for k, v in model.p.items()}
    for step in range(1, steps + 1):
        pick = rng.integers(0, x.shape[1], BATCH)
        _, grad = model.gradients(x[:, pick], y[:, pick])
        norm = float(np.sqrt(sum((g**2).sum() for g in grad.values())))
        for k, g in grad.items():
            g = g * min(1.0, 5.0 / (norm + 1e-9))
            m[k] = 0.9 * m[k] + 0.1 * g
            v2[k] = 0.99 * v2[k] + 0.01 * g * g
            size = RATE * (1 - 0.9 * step / steps)
            model.p[k] = (model.p[k] - size * (m[k] / (1 - 0.9**step)) / (np.sqrt(v2[k] / (1 - 0.99**step)) + 1e-8)).astype(np.float32)
    return model.p


def _window_starts(length: int) -> np.ndarray:
    """Starts of the windows that read a text of ``length`` characters; the first begins before it by half an overlap."""
    half = (SPAN - STRIDE) // 2
    return np.arange(-(-(length + half) // STRIDE) if length else 0) * STRIDE - half


def _plausible(kind: int, text: str) -> bool:
    digits = sum(c in "0123456789" for c in text)
    if kind == 0:
        return bool(_MARKED.search(text)) and any(c.isalpha() for c in text)
    if kind == 1:
        parts = re.findall(r"[0-9]+", text)
        return len(parts) == 4 and all(len(p) <= 3 and int(p) <= 255 for p in parts)
    if kind == 2:
        return 12 <= digits <= 19 and luhn("".join(c for c in text if c in "0123456789"))
    return 9 <= digits <= 15


def emissions(texts: list[str], model: Tagger) -> tuple[np.ndarray, np.ndarray]:
    """Emissions (character, tag) of texts one after the other, windows reconciled; where each text begins."""
    sizes = np.array([len(t) for t in texts], np.int64)
    first = np.cumsum(sizes) - sizes
    places, docs, rows = [], [], []
    for i, text in enumerate(texts):
        at = _window_starts(len(text))
        if len(at):
            whole = np.zeros(len(text) + 2 * SPAN, np.int8)
            whole[SPAN : SPAN + len(text)] = classes(text)
            places.append(at)
            docs.append(np.full(len(at), i))
            rows.append(whole[at[:, None] + SPAN + np.arange(SPAN)])
    out = np.zeros((int(sizes.sum()), TAGS), np.float32)
    if not rows:
        return out, first
    place, doc, windows = np.concatenate(places), np.concatenate(docs), np.concatenate(rows)
    weight = np.minimum(np.arange(SPAN) + 1, SPAN - np.arange(SPAN)).astype(np.float32)[:, None]
    share = np.zeros((len(out), 1), np.float32)
    for a in range(0, len(windows), 1024):
        e = model.emissions(np.ascontiguousarray(windows[a : a + 1024].T)).transpose(1, 0, 2) * weight
        at = place[a : a + 1024, None] + np.arange(SPAN)
        inside = (at >= 0) & (at < sizes[doc[a : a + 1024], None])
        at += first[doc[a : a + 1024], None]
        # The windows of one parity don't overlap, so plain indexing adds each once.
        for turn in (0, 1):
            pick = inside[turn::2]
            out[at[turn::2][pick]] += e[turn::2][pick]
            share[at[turn::2][pick]] += np.broadcast_to(weight, e[turn::2].shape[:2] + (1,))[pick]
    out /= share
    return out, first


def model_spans(texts: list[str], model: Tagger) -> list[list[tuple[int, int, int]]]:
    """Spans on the best tag path of each text."""
    out: list[list[tuple[int, int, int]]] = [[] for _ in texts]
    a = 0
    while a < len(texts):
        b, held = a, 0
        while b < len(texts) and (b == a or held + len(texts[b]) <= TOGETHER):
            held += len(texts[b])
            b += 1
        e, first = emissions(texts[a:b], model)
        some = first < len(e)
        tags = model.viterbi(e, first[some]) if len(e) else np.zeros(0, np.int8)
        place = np.flatnonzero(tags)
        tag = tags[place]
        doc = np.searchsorted(first, place, side="right") - 1
        begin = np.ones(len(place), bool)
        begin[1:] = (doc[1:] != doc[:-1]) | (place[1:] != place[:-1] + 1) | (tag[1:] % 2 == 1) | ((tag[1:] - 1) // 2 != (tag[:-1] - 1) // 2)
        heads = np.flatnonzero(begin)
        for x, y in zip(heads.tolist(), (np.append(heads[1:], len(place)) - 1).tolist()):
            i, kind = int(doc[x]), int(tag[x] - 1) // 2
            start, end = int(place[x] - first[i]), int(place[y] - first[i]) + 1
            if tag[x] % 2 == 1 and _plausible(kind, texts[a + i][start:end]):
                out[a + i].append((start, kind, end))
        a = b
    return out


def all_spans(texts: list[str], model: Tagger) -> list[tuple[list, list]]:
    """(base spans, base and model spans) of each text."""
    out = []
    for text, extra in zip(texts, model_spans(texts, model)):
        base = base_spans(text)
        new = [s for s in extra if not any(a < s[2] and s[0] < b for a, _, b in base)]
        out.append((base, sorted([*base, *new])))
    return out


def fit(documents: DataFrame, sample: int = SAMPLE) -> dict[str, np.ndarray]:
    """Train on at most ``sample`` texts, those with the smallest hash among different texts with a digit or at-sign.

    Hashes are chosen first, so that only the texts of the sample are sent to the driver.
    """
    rows = documents.where(F.col("text").rlike("[0-9@]")).select("text", F.xxhash64("text").alias("h"))
    chosen = [r["h"] for r in rows.select("h").distinct().orderBy("h").limit(sample).collect()]
    texts = rows.where(F.col("h").isin(chosen)).groupBy("h").agg(F.min("text").alias("text")).orderBy("h").collect() if chosen else []
    return train([r["text"] for r in texts])


def find(documents: DataFrame, weights: dict[str, np.ndarray], keep: list[str] | None = None, redact: bool = False) -> DataFrame:
    """Counts, digest and spans of every document; with ``redact`` also the text with ``[KIND]`` for each span."""
    names = keep or ["doc_id"]
    docs = small_batches(documents).select(*names, F.coalesce("text", F.lit("")).alias("_text"))
    shapes = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.drop("_text").schema.fields)
    schema = shapes + ", n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, spans string" + ", redacted string" * redact
    known = documents.sparkSession.sparkContext.broadcast(weights)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = Tagger()
        model.p = known.value
        for batch in batches:
            for at in range(0, len(batch), 512):
                part = batch.slice(at, 512)
                texts = part.column("_text").to_pylist()
                found = all_spans(texts, model)
                counts = [[sum(k == kind for _, k, _ in base) for base, _ in found] for kind in range(len(KINDS))]
                columns = [*(pa.array(c, pa.int64()) for c in counts), pa.array([hashlib.sha256(digest_form(b).encode()).hexdigest() for b, _ in found]), pa.array([digest_form(s) for _, s in found], pa.string())]
                if redact:
                    columns.append(pa.array([redacted(t, s) for t, (_, s) in zip(texts, found)], pa.string()))
                yield pa.RecordBatch.from_arrays([*(part.column(c) for c in names), *columns], names=[*names, "n_email", "n_ip", "n_card", "n_phone", "base_sha256", "spans", *["redacted"] * redact])

    return docs.mapInArrow(run, schema)


def redacted(text: str, spans: list[tuple[int, int, int]]) -> str:
    """``text`` with a placeholder for each span; of overlapping spans, one for all."""
    if not spans:
        return text
    out, at = [], 0
    for a, k, b in spans:
        if a >= at:
            out += [text[at:a], f"[{KINDS[k].upper()}]"]
        at = max(at, b)
    return "".join([*out, text[at:]])


def detect(documents: DataFrame, sample: int = SAMPLE) -> DataFrame:
    """Fit on a sample, then find in every whole text."""
    docs = documents.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    return find(docs, fit(docs, sample))
