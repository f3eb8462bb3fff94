"""Secrets in texts: fixed patterns and a battery of randomness tests.

The patterns give the base spans. Beyond them, every run of 20 or more characters of the usual encodings
is a candidate, without a name glued to it by '=' or, if it is like ordinary writing, by a mark of the encodings. Its encoding is the smallest alphabet that holds all its characters, and it must pass three
tests as a uniform random string over it: chi-squared on the counts of its symbols, runs about the median
symbol, and serial correlation of neighbouring symbols. A string that passes is reported only if it is also
unlikely to be ordinary writing. How likely character pairs are in ordinary writing is counted over the whole
corpus by one aggregation (a table of fixed size): changes between lower case, upper case and digits, and pairs
of letters. The likelihood under these, within the string's alphabet, over that of a uniform string is a p-value
(Markov's inequality: ordinary writing is x times as likely under the uniform law with chance 1 / x at most).
These p-values are judged by Benjamini and Hochberg's procedure over all candidates of the corpus, apart for
each class of lengths. The procedure needs only counts per class and step of p (a table of fixed size), so it
covers every document.
"""

from __future__ import annotations

import re
from bisect import bisect_right
from collections.abc import Iterator
from functools import cached_property
from math import erfc, exp, lgamma, log, sqrt

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rentlens.llm.common import ids_like, slices, workers

KINDS = ("assign", "access", "hex", "random")
ASSIGN = re.compile(r"""(?ia:(password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""")
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
#: Maximal runs of fewer characters fail, and no match begins inside one of them that is long enough.
HEX = re.compile(r"(?<![0-9a-f])[0-9a-f]{32,}")
#: '=' is padding at the end only: after any other one a run starts anew.
CANDIDATE = re.compile(r"(?<![A-Za-z0-9+/_-])[A-Za-z0-9+/_-]{20,}(?:={1,6}(?![A-Za-z0-9+/_=-]))?")
#: Words of a run, each with the marks behind it; those marks that one of base64 and base64url lacks.
PART = re.compile(r"[A-Za-z0-9]*[+/_-]*")
FOREIGN = (re.compile("[_-]+"), re.compile("[+/]+"))
#: A value ends before, and starts after, words that make it this much (in powers of e) more like ordinary writing.
MARGIN = 8.0
DIGITS, LOWER, UPPER = "0123456789", "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
#: Encodings by size of their alphabets, in the order of their symbols' values.
ENCODINGS = [("decimal", DIGITS), ("hex", DIGITS + "abcdef"), ("hex", DIGITS + "ABCDEF"), ("lower", LOWER),
             ("upper", UPPER), ("base32", UPPER + "234567"), ("base36", DIGITS + LOWER), ("base36", DIGITS + UPPER),
             ("base62", UPPER + LOWER + DIGITS), ("base64", UPPER + LOWER + DIGITS + "+/"),
             ("base64url", UPPER + LOWER + DIGITS + "-_")]
VALUES = [(a, {c: i for i, c in enumerate(a)}) for _, a in ENCODINGS]
#: Frequencies of the letters a to z in English writing, in per cent.
LETTERS = (8.2, 1.5, 2.8, 4.3, 12.7, 2.2, 2.0, 6.1, 7.0, 0.15, 0.77, 4.0, 2.4, 6.7, 7.5, 1.9, 0.095, 6.0, 6.3, 9.1,
           2.8, 0.98, 2.4, 0.15, 2.0, 0.074)
#: What ordinary writing is taken for before anything is counted: from the start of a word, a lower-case letter, an
#: upper-case letter or a digit to a lower-case letter, an upper-case letter or a digit.
CHANGES = ((0.85, 0.1, 0.05), (0.985, 0.005, 0.01), (0.7, 0.28, 0.02), (0.04, 0.04, 0.92))
#: Characters that this counts as: for the letters' frequencies, and for each row of a table.
PRIOR, ROW_PRIOR = 1000.0, 50.0
#: Long runs, which may be keys themselves, count at most this share of what the short ones and a row of the prior count.
LONG_SHARE = 1 / 3
#: Codes of characters: 0 for others (a word starts after them), then a to z, A to Z, 0 to 9.
CODES = 63
CODE = np.zeros(256, np.uint8)
CODE[list((LOWER + UPPER + DIGITS).encode())] = np.arange(1, CODES)
IN_RUN = CODE > 0
IN_RUN[list(b"+/_-")] = True
KIND = np.repeat([0, 1, 2, 3], [1, 26, 26, 10])
LETTER = np.r_[26, np.arange(26), np.arange(26), [26] * 10]
COUNT_BYTES = 1 << 20
#: Tests of randomness reject below this; p-values of reported strings are judged at this rate.
REJECT, RATE = 0.001, 0.01
CLASSES = (20, 24, 32, 48, 64, 128)
STEPS = 200  # steps of p, a fifth of a power of ten each


def _gamma_upper(a: float, x: float) -> float:
    """Regularised upper incomplete gamma function."""
    if x <= 0:
        return 1.0
    front = exp(-x + a * log(x) - lgamma(a))
    if x < a + 1:
        term = total = 1 / a
        k = a
        while term > total * 1e-12:
            k += 1
            term *= x / k
            total += term
        return max(0.0, 1 - total * front)
    b, c = x + 1 - a, 1e300
    d = h = 1 / b
    for i in range(1, 500):
        an = -i * (i - a)
        b += 2
        d = 1 / (an * d + b)
        c = b + an / c
        h *= d * c
        if abs(d * c - 1) < 1e-12:
            break
    return front * h


def uniformity(x: list[int], size: int) -> float:
    """p-value of the counts of the symbols 0 to size - 1 (chi-squared, too many repeats)."""
    counts = [0] * size
    for v in x:
        counts[v] += 1
    n = len(x)
    return _gamma_upper((size - 1) / 2, (sum(c * c for c in counts) * size / n - n) / 2)


def runs(x: list[int]) -> float:
    """p-value of the number of runs above and below the median (two sides)."""
    mid = sorted(x)[len(x) // 2]
    up = [v >= mid for v in x]
    a = sum(up)
    b = len(x) - a
    if not a or not b:
        return 0.0
    n = a + b
    mean = 2 * a * b / n + 1
    var = (mean - 1) * (mean - 2) / (n - 1)
    seen = 1 + sum(p != q for p, q in zip(up, up[1:]))
    return erfc(abs(seen - mean) / sqrt(2 * var)) if var > 0 else 1.0


def serial(x: list[int]) -> float:
    """p-value of the correlation of neighbours, the last with the first (two sides)."""
    n, s = len(x), sum(x)
    q = sum(v * v for v in x) - s * s / n
    if q <= 0:
        return 0.0
    r = (sum(a * b for a, b in zip(x, x[1:] + x[:1])) - s * s / n) / q
    return erfc(abs(r + 1 / (n - 1)) * sqrt((n - 1) / 2))


class Ordinary:
    """Ordinary writing: counts of pairs of codes, by a table with a row for what is before."""

    def __init__(self, counts: np.ndarray | None = None):
        n = np.zeros((CODES, CODES)) if counts is None else np.asarray(counts, float).reshape(CODES, CODES).copy()
        n[:, 0] = 0
        kinds = np.zeros((4, 3))
        np.add.at(kinds, (KIND[:, None], KIND[None, 1:] - 1), n[:, 1:])
        letters = np.zeros((27, 27))
        np.add.at(letters, (LETTER[:, None], LETTER[None, :]), n)
        kinds = (kinds + ROW_PRIOR * np.array(CHANGES)) / (kinds.sum(1, keepdims=True) + ROW_PRIOR)
        letters = letters[:, :26]
        each = letters.sum(0) + PRIOR * np.array(LETTERS) / sum(LETTERS)
        letters = (letters + ROW_PRIOR * each / each.sum()) / (letters.sum(1, keepdims=True) + ROW_PRIOR)
        p = np.zeros((CODES, CODES))
        p[:, 1:27] = kinds[KIND, 0, None] * letters[LETTER]
        p[:, 27:53] = kinds[KIND, 1, None] * letters[LETTER]
        p[:, 53:] = kinds[KIND, 2, None] / 10
        self.gains = {a: self._gain(p, a) for _, a in ENCODINGS}

    @staticmethod
    def _gain(p: np.ndarray, alphabet: str) -> np.ndarray:
        """By the code before and the code: the logarithm of the uniform law over the ordinary one, both within the
        alphabet. Characters that are no letters or digits tell nothing."""
        own = np.unique(CODE[list(alphabet.encode())])
        own = own[own > 0]
        out = np.zeros((CODES, CODES))
        out[:, own] = np.log(p[:, own].sum(1, keepdims=True) / len(own)) - np.log(p[:, own])
        return out

    def values(self, run: str) -> list[tuple[int, int, int]]:
        """Stretches of a run that may be values of one encoding apart from names glued to them: start, end, among how
        many. A run with the marks of two alphabets is cut at either's. Whole words are added to a stretch as long as
        they do not make it MARGIN more like ordinary writing."""
        bare = run.rstrip("=")
        if bare.isalnum():
            return [(0, len(run), 1)]
        if all(f.search(bare) for f in FOREIGN):
            pieces = sorted({x for f in FOREIGN for x in _between(f, bare)}, key=lambda x: (x[0] - x[1], x))
        else:
            pieces = [(0, len(bare))]
        out: list[tuple[float, int, int]] = []
        tried = 0
        for a, b in pieces:
            gain = np.r_[0, np.cumsum(self.gain(bare[a:b], ENCODINGS[-1][1]))]
            start, peak, base = 0, 0.0, 0.0
            for m in PART.finditer(bare, a, b):
                i, j = m.start() - a, m.end() - a
                if i == j:
                    continue
                tried += 1
                now = float(gain[j]) - base
                if now < peak - MARGIN:
                    out.append((peak, a + start, a + max(start, i - 1)))  # without the mark before the word
                    start, peak, base = j, 0.0, float(gain[j])
                else:
                    peak = max(peak, now)
            out.append((peak, a + start, b))
        taken: list[tuple[int, int, int]] = []
        for gain, a, b in sorted(out, reverse=True):
            b = len(run) if b == len(bare) else b
            if gain > 0 and b - a >= CLASSES[0] and not any(s < b and a < e for s, e, _ in taken):
                taken.append((a, b, tried))
        return sorted(taken)

    def gain(self, token: str, alphabet: str) -> np.ndarray:
        code = CODE[np.frombuffer(token.encode(), np.uint8)]
        return self.gains[alphabet][np.r_[0, code[:-1]], code]


def _between(mark: re.Pattern, text: str) -> Iterator[tuple[int, int]]:
    at = 0
    for m in mark.finditer(text):
        yield at, m.start()
        at = m.end()
    yield at, len(text)


def parts(batch: pa.RecordBatch, text_at: int) -> Iterator[pa.RecordBatch]:
    """The rows of a batch, some with about COUNT_BYTES of text at a time: so much is held as Python strings."""
    for first, last, _, _ in slices(batch.column(text_at), COUNT_BYTES):
        yield batch.slice(first, last - first)


def _pair_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    n = np.zeros(2 * CODES * CODES, np.int64)
    for batch in batches:
        for _, _, data, offs in slices(batch.column(0), COUNT_BYTES):
            if not len(data):
                continue
            starts = offs[:-1][offs[:-1] < len(data)]
            code, inside = CODE[data].astype(np.int32), IN_RUN[data]
            before, begin = np.r_[0, code[:-1]], inside & ~np.r_[False, inside[:-1]]
            before[starts] = 0
            begin[starts] = inside[starts]
            run = np.cumsum(begin)
            long = np.bincount(run[inside], minlength=int(run[-1]) + 1)[run] >= CLASSES[0]
            n += np.bincount(((long * CODES + before) * CODES + code)[code > 0], minlength=len(n))
    at = np.flatnonzero(n)
    yield pa.RecordBatch.from_arrays([pa.array(at, pa.int32()), pa.array(n[at])], ["pair", "n"])


def pair_counts(docs: DataFrame, text_col: str = "text") -> np.ndarray:
    """How often each pair of codes is in the texts, CODES x CODES; pairs of long runs count less where they are many."""
    texts = docs.select(F.col(text_col).cast("string"))
    rows = workers(texts).mapInArrow(_pair_rows, "pair int, n long").groupBy("pair").agg(F.sum("n").alias("n")).collect()
    n = np.zeros(2 * CODES * CODES)  # a row per pair at most
    for r in rows:
        n[r["pair"]] = r["n"]
    short, long = n.reshape(2, CODES, CODES)
    return short + long * min(1.0, LONG_SHARE * (short.sum() + ROW_PRIOR) / max(1.0, long.sum()))


def encoding(token: str) -> tuple[str, dict[str, int], str] | None:
    """The inferred encoding's alphabet, its symbols' values, and the string without padding."""
    bare = token.rstrip("=")
    used = set(bare)
    for alphabet, values in VALUES:
        if used <= values.keys():
            return alphabet, values, bare
    return None


def p_value(token: str, model: Ordinary | None = None) -> float:
    """1 if the string fails a test of randomness, else its chance as ordinary writing."""
    found = encoding(token)
    if not found or len(found[2]) < CLASSES[0]:
        return 1.0
    alphabet, values, bare = found
    gain = float((model or Ordinary()).gain(bare, alphabet).sum())
    if gain <= 0:
        return 1.0
    x = [values[c] for c in bare]
    if uniformity(x, len(values)) < REJECT or runs(x) < REJECT or serial(x) < REJECT:
        return 1.0
    return exp(-gain)


def length_class(n: int) -> int:
    return max(i for i, least in enumerate(CLASSES) if n >= least)


def step(p: float) -> int:
    """The step of p: 10 ** (-step / 5) is not below p."""
    return min(STEPS - 1, int(-5 * log(p) / log(10))) if p > 0 else STEPS - 1


def _tested(pairs: np.ndarray):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = Ordinary(pairs)
        for batch in batches:
            seen: dict[tuple[int, int], int] = {}
            for part in parts(batch, 0):
                for text in part.column(0).to_pylist():
                    for _, _, *at in judged(text or "", model):
                        seen[tuple(at)] = seen.get(tuple(at), 0) + 1
            yield pa.RecordBatch.from_arrays([pa.array([k[0] for k in seen], pa.int32()), pa.array(
                [k[1] for k in seen], pa.int32()), pa.array(list(seen.values()), pa.int64())], ["class", "step", "n"])
    return run


def judged(text: str, model: Ordinary) -> Iterator[tuple[int, int, int, int]]:
    """Start, end, class and step of p of the candidates; a run without a likely value counts as one of p = 1."""
    for m in CANDIDATE.finditer(text):
        at, run = m.start(), m.group()
        values = model.values(run)
        for a, b, tried in values:
            yield at + a, at + b, length_class(b - a), step(min(1.0, tried * p_value(run[a:b], model)))
        if not values:
            yield at, m.end(), length_class(len(run)), 0


class Cuts(dict):
    """For each class of lengths the least step of p that is a discovery (none: left out), and the pairs of ordinary
    writing that p was found with."""

    def __init__(self, pairs: np.ndarray):
        super().__init__()
        self.pairs = pairs

    @cached_property
    def model(self) -> Ordinary:
        return Ordinary(self.pairs)


def discovery_steps(docs: DataFrame, text_col: str = "text", rate: float = RATE) -> Cuts:
    """The cuts by Benjamini and Hochberg's procedure at the rate."""
    texts = docs.select(F.col(text_col).cast("string"))
    pairs = pair_counts(docs, text_col)
    counts = (workers(texts).mapInArrow(_tested(pairs), "class int, step int, n long").groupBy("class", "step")
              .agg(F.sum("n").alias("n")).collect())  # at most classes x STEPS rows
    out = Cuts(pairs)
    for c in {r["class"] for r in counts}:
        own = {r["step"]: r["n"] for r in counts if r["class"] == c}
        total, taken = sum(own.values()), 0
        for s in sorted(own, reverse=True):
            taken += own[s]
            if s and 10 ** (-s / 5) * total <= rate * taken:
                out[c] = s
    return out


def spans(text: str | None, cuts: Cuts | dict) -> tuple[list[tuple[int, int, int]], list[tuple[int, int, int]]]:
    """(start, kind, end) of the base spans and of all spans, each in order of start and kind."""
    if not text:
        return [], []
    base = [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if m.end(2) - m.start(2) >= 8]
    if "AKIA" in text:
        base += [(m.start(), 1, m.end()) for m in ACCESS.finditer(text) if m.end() - m.start() >= 16]
    base += [(m.start(), 2, m.end()) for m in HEX.finditer(text)]
    base.sort()
    starts: list[int] = []  # the stretches that base spans cover, in order
    ends: list[int] = []
    for s, _, e in base:
        if ends and s <= ends[-1]:
            ends[-1] = max(ends[-1], e)
        else:
            starts.append(s)
            ends.append(e)
    more = []
    for a, b, size, found in judged(text, cuts.model) if cuts else ():
        if found >= cuts.get(size, STEPS):
            i = bisect_right(ends, a)
            if i == len(starts) or starts[i] >= b:
                more.append((a, 3, b))
    return base, sorted(base + more)


def redacted(text: str, found: list[tuple[int, int, int]], mark: str) -> str:
    """The text with each stretch of overlapping spans replaced."""
    out, at, end = [], 0, -1
    for s, _, e in found:
        if s >= end:
            out += [text[at:s], mark]
        end = at = max(end, e)
    return "".join(out) + text[at:]


def _scan(cuts: Cuts):
    def run(batches):
        kinds = [pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64())]))] * 2
        for batch in (p for b in batches for p in parts(b, 1)):
            got = [spans(t, cuts) for t in batch.column(1).to_pylist()]
            cols = [pa.array([[{"kind": KINDS[k], "start": s, "end": e} for s, k, e in pick] for pick in side], t)
                    for side, t in zip(zip(*got) if got else ((), ()), kinds)]
            yield pa.RecordBatch.from_arrays([batch.column(0), *cols], ["id", "base", "spans"])
    return run


def secret_spans(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", rate: float = RATE) -> DataFrame:
    """One row per row of ``docs``: ``id_col``, base and spans, arrays of (kind, start, end) in code points,
    end exclusive, by start and then kind as in KINDS. Null and empty texts have none. The whole text is
    read whatever its length. An empty table gives an empty result; other columns are ignored."""
    slim = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
    span = "array<struct<kind: string, start: long, end: long>>"
    out = workers(slim).mapInArrow(_scan(discovery_steps(slim, "text", rate)),
                                   f"id {ids_like(slim, 'id')}, base {span}, spans {span}")
    return out.withColumnRenamed("id", id_col)


def _redact(cuts: Cuts, text_at: int, count_at: int, mark: str):
    def run(batches):
        for batch in (p for b in batches for p in parts(b, text_at)):
            texts, cols = batch.column(text_at).to_pylist(), list(batch.columns)
            counts = batch.column(count_at).to_pylist() if count_at >= 0 else []
            for i, t in enumerate(texts):
                if found := spans(t, cuts)[1]:
                    texts[i] = redacted(t, found, mark)
                    if count_at >= 0 and counts[i] is not None:
                        counts[i] = len(texts[i])
            cols[text_at] = pa.array(texts, cols[text_at].type)
            if count_at >= 0:
                cols[count_at] = pa.array(counts, cols[count_at].type)
            yield pa.RecordBatch.from_arrays(cols, schema=batch.schema)
    return run


def redact_secrets(docs: DataFrame, text_col: str = "text", count_col: str = "n_chars", rate: float = RATE,
                   mark: str = "[SECRET]") -> DataFrame:
    """``docs`` with every span replaced by ``mark`` and, where a text changed, ``count_col`` (if there is such
    a column and it is not null) set to its new length. All rows stay, other texts and columns as they are."""
    cuts = discovery_steps(docs, text_col, rate)
    at = docs.columns.index(count_col) if count_col in docs.columns else -1
    return workers(docs).mapInArrow(_redact(cuts, docs.columns.index(text_col), at, mark), docs.schema)
