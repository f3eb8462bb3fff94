"""Token ids of texts with a tokenizer file of the tokenizers library, word by word.

The tokenizer drops white space and never joins across it, so the ids of a text are those of its words
one after another. Each worker keeps the ids of words it has met, up to a bounded number. New words of
lower-case letters, with or without a few marks after them, take the file's merges in numpy, all words of one
length together; other words go through the library. Strings of the file's special tokens are ordinary text or,
with ``special``, give these tokens' ids as the library does by default: texts that may hold one, in any case of
letters, go through the library whole. Whether the short way gives the library's ids with this
file is checked once, when the file is loaded, and it is not taken otherwise.
"""

from __future__ import annotations

import json
import os
import re
from unicodedata import is_normalized

import numpy as np
from pyspark import Broadcast
from pyspark.sql import SparkSession

#: Words that a worker keeps; beyond that it starts anew.
KEPT_WORDS = 1 << 19
MARKS = b".,!?;:"
NO_RANK = np.int32(2 ** 31 - 1)
PROBES = ["a", "the", "international", "zzzzqqq", "internationalisation", "xylophone", "straße", "garçon", "ñandú", "aaaaaaaa",
          "ththerein", "mentmentelle", "über", "weiß", "жизнь", "日本語", "lly", "ss", "re", "ve", "ll"]
_encoders: dict[int, "WordEncoder"] = {}


class Merges:
    """The merges of a byte-level BPE file whose words end with a suffix, applied to many words at once."""

    def __init__(self, model: dict):
        vocab, end = model["vocab"], model.get("end_of_word_suffix") or ""
        pairs = [m.split(" ") if isinstance(m, str) else m for m in model["merges"]]
        plain = [*range(33, 127), *range(161, 173), *range(174, 256)]  # bytes that stand for themselves
        sign = {b: chr(b) for b in plain} | {b: chr(256 + i) for i, b in enumerate(b for b in range(256) if b not in set(plain))}
        self.inner = np.array([vocab[sign[b]] for b in range(256)], np.int64)
        self.last = np.array([vocab[sign[b] + end] for b in range(256)], np.int64)
        key = np.array([vocab[a] << 32 | vocab[b] for a, b in pairs], np.int64)
        order = np.argsort(key, kind="stable")
        self.key, self.rank = key[order], order.astype(np.int32)
        self.to = np.array([vocab[a + b] for a, b in pairs], np.int64)[order]

    def _look_up(self, a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        pair = a << 32 | b
        at = np.minimum(np.searchsorted(self.key, pair), len(self.key) - 1)
        hit = self.key[at] == pair
        return np.where(hit, self.rank[at], NO_RANK), self.to[at]

    def ids(self, words: list[bytes]) -> list[bytes]:
        """The ids (little-endian, unsigned 32-bit) of words of one length in bytes: again and again the pair of
        least rank, the first of equal ones, becomes one symbol."""
        n, size = len(words), len(words[0])
        raw = np.frombuffer(b"".join(words), np.uint8).reshape(n, size)
        sym = self.inner[raw]
        sym[:, -1] = self.last[raw[:, -1]]
        count = np.full(n, size)
        rank, to = self._look_up(sym[:, :-1], sym[:, 1:])
        live, out = np.arange(n), np.zeros((n, size), "<u4")
        while size > 1 and len(live):
            p = rank.argmin(1)
            row = np.arange(len(live))
            more = rank[row, p] < NO_RANK
            if not more.all():
                out[live[~more], :sym.shape[1]] = sym[~more]
                live, sym, rank, to, p = (x[more] for x in (live, sym, rank, to, p))
                row = np.arange(len(live))
                if not len(live):
                    break
            sym[row, p] = to[row, p]
            m = sym.shape[1] - 1
            after = np.arange(m) + (np.arange(m) > p[:, None])
            sym = np.take_along_axis(sym, after, 1)
            count[live] -= 1
            if m == 1:
                out[live, :1] = sym
                break
            gone = np.arange(m - 1) + (np.arange(m - 1) >= p[:, None])
            rank, to = np.take_along_axis(rank, gone, 1), np.take_along_axis(to, gone, 1)
            for at, ok in ((p - 1, p > 0), (p, p < m - 1)):
                r, i = row[ok], at[ok]
                rank[r, i], to[r, i] = self._look_up(sym[r, i], sym[r, i + 1])
        if size == 1:
            out[:] = sym
        return [out[i, :c].tobytes() for i, c in enumerate(count.tolist())]


class WordEncoder:
    def __init__(self, content: str, special: bool = False, kept: int = KEPT_WORDS):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer
        self.tokenizer = Tokenizer.from_str(content)
        self.tokenizer.encode_special_tokens = True  # their strings in a text are ordinary text
        self.known: dict[bytes, bytes] = {}
        self.kept = kept
        self.marks = None
        if special:
            names = [t["content"].lower() for t in json.loads(content).get("added_tokens", [])]
            self.marks = re.compile("|".join(map(re.escape, names))) if names else None
            self.sign = re.match(r"[^\w]*", os.path.commonprefix(names))[0]  # what all begin with, as far as it has no case
        self.merges = None
        try:
            merges = Merges(json.loads(content)["model"])
            if all(merges.ids([w.encode()]) == self._library([w]) for w in PROBES) and self._library(["AÉ"]) == self._library(["aé"]):
                self.merges = merges
        except (KeyError, TypeError, ValueError):
            pass  # another kind of file

    def _library(self, words: list[str]) -> list[bytes]:
        return [np.array(e.ids, "<u4").tobytes() for e in self.tokenizer.encode_batch_fast(words, add_special_tokens=False)]

    def _learn(self, new: set[bytes]) -> None:
        by_length: dict[int, list[tuple[bytes, bytes]]] = {}
        other = []
        for w in new:
            stem = w.rstrip(MARKS) if self.merges else b""
            text = stem.decode()
            if text.isalpha() and (text.isascii() or text.islower() and is_normalized("NFC", text)):
                by_length.setdefault(len(stem), []).append((stem, w))
            else:
                other.append(w)
        tails = sorted({w[len(s):] for own in by_length.values() for s, w in own if len(w) > len(s)})
        tail = dict(zip(tails, self._library([t.decode() for t in tails]))) | {b"": b""}
        for own in by_length.values():
            stems = sorted({s for s, _ in own})
            ids = dict(zip(stems, self.merges.ids(stems)))
            self.known.update((w, ids[s] + tail[w[len(s):]]) for s, w in own)
        self.known.update(zip(other, self._library([w.decode() for w in other])))

    def encode(self, texts: list[str]) -> list[bytes]:
        """Each text's ids as little-endian unsigned 32-bit numbers."""
        if self.marks and (held := [i for i, t in enumerate(texts) if self.sign in t and self.marks.search(t.lower())]):
            rest = set(range(len(texts))).difference(held)
            out = self._words([t if i in rest else "" for i, t in enumerate(texts)])
            self.tokenizer.encode_special_tokens = False  # one instance for both ways: it is large
            for i, ids in zip(held, self._library([texts[i] for i in held])):
                out[i] = ids
            self.tokenizer.encode_special_tokens = True
            return out
        return self._words(texts)

    def _words(self, texts: list[str]) -> list[bytes]:
        cut = [t.encode("utf-8", "replace") for t in texts]
        cut = [(t.lower() if self.merges else t).split() for t in cut]
        if len(self.known) > self.kept:
            self.known = {}
        new: set[bytes] = set().union(*cut).difference(self.known) if cut else set()
        if new:
            self._learn(new)
        get = self.known.__getitem__
        return [b"".join(map(get, c)) for c in cut]


def shipped(spark: SparkSession, path: str) -> Broadcast:
    """The tokenizer file's content, for the workers (its size is that of one vocabulary)."""
    with open(path, encoding="utf-8") as f:
        return spark.sparkContext.broadcast(f.read())


def encoder(content: Broadcast, special: bool = False, kept: int = KEPT_WORDS) -> WordEncoder:
    """This worker's encoder, made once."""
    key = hash((content.value, special))
    if key not in _encoders:
        _encoders.clear()
        _encoders[key] = WordEncoder(content.value, special, kept)
    return _encoders[key]


def runs(texts: list[str], most: int = 1 << 22):
    """First and last row (exclusive) of runs of texts with about ``most`` characters."""
    first, size = 0, 0
    for i, t in enumerate(texts):
        size += len(t)
        if size >= most:
            yield first, i + 1
            first, size = i + 1, 0
    if first < len(texts):
        yield first, len(texts)
