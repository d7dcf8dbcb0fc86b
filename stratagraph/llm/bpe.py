"""BPE encoding by backtracking over longest matches, decoding by an offset table.

A word is encoded left to right: an Aho-Corasick pass gives the longest token
at each place; a token may follow another only if the merge order would leave
the border between them alone (the pair-compatibility test, remembered for
each pair), else the next shorter token is tried, else the last token is
taken back and its end is marked, so each place fails at most once.

The tokenizer file is a parameter.  What it says about the text before
merging (normal form, lower case, split pattern, white space) is followed
here for the kind of file named ``word_bpe``: NFC, white space dropped, lower
case of each character, words by pattern, byte-level symbols, ``</w>`` at word
ends, special tokens found in the raw text.

Defined results: null and empty texts have no tokens and decode to "".  A row
that repeats an id or a text is a row of its own, with the same tokens; texts
of any length are encoded whole; other columns are ignored; an empty table
gives an empty table.
"""

from __future__ import annotations

import hashlib
import json
import re
import struct
import unicodedata
from collections.abc import Callable, Iterator

import ahocorasick
import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from stratagraph.llm.session import small_batches

MARK = "\0"
#: Chunks and words that a worker remembers (about 250 bytes each), and how long they are at most; its memory starts anew when full.
REMEMBERED, LONGEST = 800_000, 64
# White space as Unicode has it, and the control characters that only str.split() takes for it.
SPACE = re.compile("[\t-\r \x85\xa0  -     　]+")
NOT_SPACE = ("\x1c", "\x1d", "\x1e", "\x1f")


def byte_symbols() -> list[str]:
    """The printable character that stands for each byte in byte-level vocabularies."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    hidden = [b for b in range(256) if b not in shown]
    return [chr(b) if b in shown else chr(256 + hidden.index(b)) for b in range(256)]


def chunks(text: str) -> list[str]:
    """The parts of a text between white space."""
    if any(c in text for c in NOT_SPACE):
        return [c for c in SPACE.split(text) if c]
    return text.split()


class Memory(dict):
    """Packed ids by chunk or word (a chunk that is a word has the word's ids); what is missing is encoded, and kept unless long."""

    def __init__(self, encode: Callable[[str], bytes]):
        self.encode = encode

    def __missing__(self, chunk: str) -> bytes:
        out = self.encode(chunk)
        if len(chunk) <= LONGEST:
            self[chunk] = out
        return out


class WordBpe:
    """Encoder and decoder for one tokenizer file."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model = spec["model"]
        if model["type"] != "BPE" or model.get("end_of_word_suffix") != "</w>":
            raise ValueError("a BPE file with word ends is expected")
        vocab = model["vocab"]
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.split_special = re.compile("|".join(map(re.escape, self.special))) if self.special else None
        pattern = next(p["pattern"]["Regex"] for p in spec["pre_tokenizer"]["pretokenizers"] if p["type"] == "Split")
        self.pattern = regex.compile(pattern)
        size = max([*vocab.values(), *self.special.values()]) + 1
        self.strings: list[str] = [""] * size
        for s, i in [*vocab.items(), *self.special.items()]:
            self.strings[i] = s
        marked = {(s[:-4] + MARK if s.endswith("</w>") and len(s) > 4 else s): i for s, i in vocab.items()}
        # A token stands for its merge: the rank of the merge that makes it, base symbols before all.
        self.left, self.right, self.rank = [-1] * size, [-1] * size, [-1] * size
        self.pairs: dict[tuple[int, int], int] = {}
        for r, merge in enumerate(model["merges"]):
            a, b = merge if isinstance(merge, list) else merge.split(" ")
            a, b, made = vocab[a], vocab[b], vocab[a + b]
            self.pairs[a, b] = r
            if self.rank[made] < 0:
                self.left[made], self.right[made], self.rank[made] = a, b, r
        self.length = [0] * size
        self.shorter = [-1] * size
        self.matcher = ahocorasick.Automaton()
        for s, i in marked.items():
            self.length[i] = len(s)
            self.shorter[i] = next((marked[s[:n]] for n in range(len(s) - 1, 0, -1) if s[:n] in marked), -1)
            self.matcher.add_word(s, i)
        self.matcher.make_automaton()
        self.symbols = byte_symbols()
        self.fits: dict[int, bool] = {}
        blobs = [s.encode() + b" " for s in self.strings]
        self.sizes = np.array([len(b) for b in blobs], np.int64)
        self.offsets = np.cumsum(self.sizes) - self.sizes
        self.blob = np.frombuffer(b"".join(blobs), np.uint8)
        self.memory = self.words = Memory(self.encode_chunk)
        whole = Tokenizer.from_file(path)
        self.normal, self.prepare = whole.normalizer, whole.pre_tokenizer

    def compatible(self, a: int, b: int) -> bool:
        """Whether merging in rank order leaves the border between tokens a and b alone.

        Both tokens are taken apart from their latest merge on.  At each step
        the two symbols at the border would have merged, unless one of them
        was consumed first; of equal ranks the one on the left goes first.
        """
        key, rank, until = a << 20 | b, self.rank, float("inf")
        while True:
            r = self.pairs.get((a, b))
            if r is not None and r < until:
                good = False
                break
            if rank[a] < 0 and rank[b] < 0:
                good = True
                break
            if rank[a] > rank[b]:
                until, a = rank[a], self.right[a]
            else:
                until, b = rank[b] + 1, self.left[b]
        if len(self.fits) > 1 << 20:
            self.fits.clear()
        self.fits[key] = good
        return good

    def merge(self, word: str) -> list[int]:
        """Token ids of one word of byte symbols that ends with MARK."""
        length, shorter, fits, compatible = self.length, self.shorter, self.fits, self.compatible
        # Ends come in order, so the last token for a start is the longest.
        longest = {end - length[token]: token for end, token in self.matcher.iter(word)}
        out: list[int] = []
        dead: set[int] = set()
        at, stop, last, token = 0, len(word), -1, longest[-1]
        while at < stop:
            while token >= 0:
                if at + length[token] not in dead:
                    if last < 0:
                        break
                    fit = fits.get(last << 20 | token)
                    if compatible(last, token) if fit is None else fit:
                        break
                token = shorter[token]
            if token >= 0:
                out.append(token)
                at += length[token]
                last, token = token, longest.get(at - 1, -1)
            elif out:
                dead.add(at)
                token = out.pop()
                at -= length[token]
                last, token = out[-1] if out else -1, shorter[token]
            else:
                raise ValueError(f"no tokens for {word!r}")
        return out

    def encode_chunk(self, chunk: str) -> bytes:
        """Packed ids of a text without white space."""
        if self.split_special is not None and "<|" in chunk:
            out, at = [], 0
            for m in self.split_special.finditer(chunk):
                out += [self._plain(chunk[at : m.start()]), self.special[m.group()].to_bytes(4, "little")]
                at = m.end()
            return b"".join([*out, self._plain(chunk[at:])])
        return self._plain(chunk)

    def _plain(self, chunk: str) -> bytes:
        if chunk.isascii():
            # Nearly all chunks are one word, or one with a mark after it.
            if chunk.isalpha():
                chunk = chunk.lower()
                return self.words.get(chunk) or self._word(chunk)
            head, mark = chunk[:-1], chunk[-1:]
            if head.isalpha() and mark in ".,":
                head = head.lower()
                return (self.words.get(head) or self._word(head)) + (self.words.get(mark) or self._word(mark))
            words = self.pattern.findall(chunk.lower())
        elif max(chunk) < "\u0180":
            words = self.pattern.findall("".join(map(str.lower, unicodedata.normalize("NFC", chunk))))
        else:
            # Characters whose class may depend on the Unicode version: the library's own preparation.
            words = [w for w, _ in self.prepare.pre_tokenize_str(self.normal.normalize_str(chunk))]
            return b"".join(self._pack(self.merge(w + MARK)) for w in words)
        return b"".join(self.words.get(w) or self._word(w) for w in words)

    def _word(self, word: str) -> bytes:
        symbols = word if word.isalpha() and word.isascii() else "".join(map(self.symbols.__getitem__, word.encode()))
        out = self._pack(self.merge(symbols + MARK))
        if len(word) <= LONGEST:
            self.words[word] = out
        return out

    @staticmethod
    def _pack(ids: list[int]) -> bytes:
        return struct.pack(f"<{len(ids)}I", *ids)

    def packed(self, text: str) -> bytes:
        """Ids of a text as little-endian unsigned 32-bit integers."""
        memory = self.memory
        if len(memory) > REMEMBERED:
            memory.clear()
        return b"".join(map(memory.__getitem__, chunks(text)))

    def encode(self, text: str) -> list[int]:
        return np.frombuffer(self.packed(text), "<u4").tolist()

    def decode_packed(self, ids: np.ndarray) -> bytes:
        """UTF-8 of the tokens' strings, one space between them, gathered through the offset table."""
        sizes = self.sizes[ids]
        place = np.arange(int(sizes.sum())) - np.repeat(np.cumsum(sizes) - sizes - self.offsets[ids], sizes)
        return self.blob[place].tobytes()[:-1]

    def decode(self, ids: list[int]) -> str:
        return self.decode_packed(np.array(ids, np.int64)).decode()


_loaded: dict[str, WordBpe] = {}


def load(path: str) -> WordBpe:
    """The worker's encoder for a file; it keeps it for all its tasks."""
    if path not in _loaded:
        _loaded[path] = WordBpe(path)
    return _loaded[path]


def _each(documents: DataFrame, schema: str, types: list[pa.DataType], one: Callable[[str], tuple]) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, len(batch), 512):
                part = batch.slice(at, 512)
                found = [one(t or "") for t in part.column("text").to_pylist()]
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), *(pa.array(c, k) for c, k in zip(zip(*found), types))], names=[f.split()[0] for f in schema.split(", ")])

    return small_batches(documents).select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, schema)


def encode(documents: DataFrame, path: str) -> DataFrame:
    """(doc_id, ids): every whole text's token ids."""
    return _each(documents, "doc_id long, ids array<int>", [pa.list_(pa.int32())], lambda t: (np.frombuffer(load(path).packed(t), "<u4").astype(np.int32),))


def decode(encoded: DataFrame, path: str) -> DataFrame:
    """(doc_id, text) of (doc_id, ids)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [load(path).decode(ids or []) for ids in batch.column("ids").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(texts, pa.string())], names=["doc_id", "text"])

    return encoded.select("doc_id", "ids").mapInArrow(run, "doc_id long, text string")


def round_trip(documents: DataFrame, path: str) -> DataFrame:
    """Token counts and digests of the ids and of the text decoded from them."""

    def one(text: str) -> tuple[int, str, str]:
        bpe = load(path)
        packed = bpe.packed(text)
        ids = np.frombuffer(packed, "<u4")
        # Long texts are decoded in parts, so that memory doesn't follow their length.
        decoded = hashlib.sha256()
        for at in range(0, len(ids), 1 << 16):
            decoded.update(b" " * (at > 0) + bpe.decode_packed(ids[at : at + (1 << 16)].astype(np.int64)))
        return len(ids), hashlib.sha256(packed).hexdigest(), decoded.hexdigest()

    return _each(documents, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string", [pa.int64(), pa.string(), pa.string()], one)
