"""SentencePiece encoding and decoding with a batched Viterbi in numpy.

A text is cut into segments that no piece crosses: a mark of white space with the characters after it. The
different segments of a batch are grouped by length, and all segments of one length advance together: at
each position the substrings that end there are looked up by polynomial hash among the sorted hashes of
the pieces of that length, and the best way to end there is a maximum over the lengths, whose place is the
backpointer.

The way's value depends on the model. For a unigram model it is the sum of the pieces' scores. A BPE model's
own result is not the way with the best sum, so there a step is allowed (0) or not (minus infinity): piece t
may follow the last piece p of the best way to its start if BPE itself, on the text of p and t, leaves the
border between them alone. Merges inside two neighbours only depend on these two, so the one way whose
borders all hold is what BPE gives. Whether a border holds is found once for each pair and remembered.
Segments with several marks of white space in a row or with characters that are no piece are rare and go
through plain BPE, one at a time, remembered as well.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator
from heapq import heappop, heappush

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rentlens.llm.common import ids_like, workers

MARK = "▁"
#: Segments that a worker keeps; beyond that it starts anew.
KEPT = 1 << 19
#: Bits of the tables that tell which hashes can be pieces, and of the table of borders.
FEW_BITS, PAIR_BITS = 18, 21
U = np.uint64
BASE = U(0x9E3779B97F4A7C15)
NO = -1e18


class Vocabulary:
    """A model's pieces; it is small, bounded by the model file, and sent to the workers as it is."""

    def __init__(self, path: str, kind: str = "bpe"):
        from sentencepiece import SentencePieceProcessor
        sp = SentencePieceProcessor(model_file=path)
        if kind not in ("bpe", "unigram"):
            raise ValueError(kind)
        n = sp.get_piece_size()
        self.kind, self.size, self.unknown = kind, n, sp.unk_id()
        self.texts = [sp.id_to_piece(i) for i in range(n)]
        self.bytes = {int(self.texts[i][3:5], 16): i for i in range(n) if sp.is_byte(i)}
        plain = [i for i in range(n) if not (sp.is_byte(i) or sp.is_control(i) or sp.is_unknown(i) or sp.is_unused(i))]
        self.scores = {self.texts[i]: sp.get_score(i) for i in plain}
        self.ids = {self.texts[i]: i for i in plain}


def plain_bpe(text: str, scores: dict[str, float]) -> list[str]:
    """BPE as SentencePiece does it: again and again the neighbours whose joint piece scores best, the first of
    equal ones. A heap holds the joints; those whose parts have gone are passed over, so n characters take about
    n log n steps, whatever they are."""
    n = len(text)
    parts: list[str] = list(text)
    after, before = list(range(1, n + 1)), list(range(-1, n - 1))
    heap: list[tuple[float, int, str, str]] = []

    def joint(i: int) -> None:
        j = after[i]
        if j < n and (s := scores.get(parts[i] + parts[j])) is not None:
            heappush(heap, (-s, i, parts[i], parts[j]))
    for i in range(n - 1):
        joint(i)
    while heap:
        _, i, left, right = heappop(heap)
        j = after[i]
        if parts[i] != left or j >= n or parts[j] != right:
            continue
        parts[i], parts[j] = left + right, ""
        after[i] = after[j]
        if after[i] < n:
            before[after[i]] = i
        joint(i)
        if before[i] >= 0:
            joint(before[i])
    return [p for p in parts if p]


def _hashes(words: np.ndarray) -> np.ndarray:
    """Polynomial hashes of the prefixes (row by row, from the empty one)."""
    out = np.zeros((len(words), words.shape[1] + 1), U)
    for i in range(words.shape[1]):
        out[:, i + 1] = out[:, i] * BASE + words[:, i].astype(U) + U(1)
    return out


class Encoder:
    """One worker's encoder."""

    def __init__(self, vocabulary: Vocabulary):
        v = self.v = vocabulary
        inside = {c for t in v.ids if len(t) > 1 for c in t} - {MARK}
        joining = "".join(map(re.escape, sorted(inside)))
        self.segments = re.compile(f"{MARK}{{2,}}[{joining}]*|{MARK}[{joining}]*|[{joining}]+|.", re.S)
        usable = [(t, i) for t, i in v.ids.items() if len(t) == 1 or v.kind == "unigram" or plain_bpe(t, v.scores) == [t]]
        self.longest = max((len(t) for t, _ in usable), default=1)
        self.keys, self.piece, self.score = [], [], []
        for n in range(1, self.longest + 1):
            own = [(t, i) for t, i in usable if len(t) == n]
            codes = np.array([[ord(c) for c in t] for t, _ in own], np.int64).reshape(len(own), n)
            h = _hashes(codes)[:, n]
            order = np.argsort(h)
            self.keys.append(h[order])
            self.piece.append(np.array([i for _, i in own], np.int64)[order])
            self.score.append(np.array([v.scores[t] for t, _ in own])[order])
        self.power = np.cumprod(np.r_[U(1), np.full(self.longest, BASE, U)])
        self.maybe = []  # for each length, which leading bits of a hash occur
        for keys in self.keys:
            self.maybe.append(np.zeros(1 << FEW_BITS, bool))
            self.maybe[-1][keys >> U(64 - FEW_BITS)] = True
        self.known: dict[str, bytes] = {}
        self.pair_key = np.full(1 << PAIR_BITS, -1, np.int64)  # borders found, each at its hash's place
        self.pair_holds = np.zeros(1 << PAIR_BITS, bool)
        raw = {i: bytes([b]) for b, i in v.bytes.items()}
        self.out = [raw.get(i, t.replace(MARK, " ").encode()) for i, t in enumerate(v.texts)]
        for i, t in enumerate(v.texts):
            if i not in raw and v.ids.get(t) != i:
                self.out[i] = "⁇ ".encode().rstrip() if i == v.unknown else b""

    def _holds(self, before: np.ndarray, piece: np.ndarray) -> np.ndarray:
        """Whether BPE keeps the border between two pieces (before -1: the start)."""
        free = before < 0
        pair = before * self.v.size + piece
        at = ((pair.astype(U) * BASE) >> U(64 - PAIR_BITS)).astype(np.int64)
        new = np.flatnonzero((self.pair_key[at] != pair) & ~free)
        held = self.pair_holds[at] | free
        if len(new):
            each, inverse = np.unique(pair[new], return_inverse=True)
            found = []
            for p in each.tolist():
                a, b = (self.v.texts[x] for x in divmod(p, self.v.size))
                found.append(plain_bpe(a + b, self.v.scores) == [a, b])
            found = np.array(found, bool)[inverse]
            held[new] = found
            # of pairs with one place the last stays: whole entries, as each is written from one row
            self.pair_key[at[new]], self.pair_holds[at[new]] = pair[new], found
            lost = self.pair_key[at[new]] != pair[new]
            self.pair_key[at[new][lost]] = -1
        return held

    def viterbi(self, words: np.ndarray) -> list[bytes]:
        """The ids of words of one length, given as code points row by row; every character is a piece."""
        rows, n = words.shape
        prefix = np.ascontiguousarray(_hashes(words).T)
        best = np.full((n + 1, rows), NO)
        best[0] = 0
        last = np.full((n + 1, rows), -1, np.int64)
        back = np.zeros((n + 1, rows), np.int64)
        for i in range(1, n + 1):
            most = min(i, self.longest)
            value = np.full((most, rows), NO)
            ids = np.full((most, rows), -1, np.int64)
            for k in range(1, most + 1):
                keys = self.keys[k - 1]
                if not len(keys):
                    continue
                h = prefix[i] - prefix[i - k] * self.power[k]
                hit = np.flatnonzero(self.maybe[k - 1][h >> U(64 - FEW_BITS)] & (best[i - k] > NO))
                at = np.minimum(np.searchsorted(keys, h[hit]), len(keys) - 1)
                real = keys[at] == h[hit]
                hit, at = hit[real], at[real]
                if not len(hit):
                    continue
                piece = self.piece[k - 1][at]
                if self.v.kind == "bpe":
                    gain = np.where(self._holds(last[i - k, hit], piece), 0.0, NO)
                else:
                    gain = best[i - k, hit] + self.score[k - 1][at]
                value[k - 1, hit], ids[k - 1, hit] = gain, piece
            k = value.argmax(0)
            every = np.arange(rows)
            best[i], last[i], back[i] = value[k, every], ids[k, every], k + 1
        way = np.zeros((rows, n), "<u4")  # filled from the right, all words a step at a time
        at, count, live = np.full(rows, n), np.zeros(rows, np.int64), np.arange(rows)
        while len(live):
            count[live] += 1
            way[live, n - count[live]] = last[at[live], live]
            at[live] -= back[at[live], live]
            live = live[at[live] > 0]
        raw, ends = way.tobytes(), (np.arange(rows) + 1) * n * 4
        return [raw[e - 4 * c:e] for e, c in zip(ends.tolist(), count.tolist())]

    def _alone(self, segment: str) -> list[int]:
        v = self.v
        if v.kind == "bpe":
            parts = plain_bpe(segment, v.scores)
        else:  # unknown characters stand between known stretches
            parts, run = [], ""
            for c in segment + "\0":
                if c in v.ids and c != "\0":
                    run += c
                    continue
                if run:
                    way = self.viterbi(np.array([[ord(x) for x in run]]))[0]
                    parts += [v.texts[i] for i in np.frombuffer(way, "<u4")]
                run = ""
                parts.append(c)
            parts.pop()
        ids: list[int] = []
        for p in parts:
            if p in v.ids:
                ids.append(v.ids[p])
            elif v.bytes:
                ids += [v.bytes[b] for b in p.encode("utf-8", "replace")]
            else:
                ids.append(v.unknown)
        return ids

    def _learn(self, new: list[str]) -> None:
        by_length: dict[int, list[str]] = {}
        for s in new:
            if all(c in self.v.ids for c in set(s)) and not (self.v.kind == "bpe" and s.startswith(MARK * 2)):
                by_length.setdefault(len(s), []).append(s)
            else:
                self.known[s] = np.array(self._alone(s), "<u4").tobytes()
        for n, own in by_length.items():
            codes = np.frombuffer("".join(own).encode("utf-32-le"), np.uint32).reshape(len(own), n)
            for i in range(0, len(own), 4096):
                self.known.update(zip(own[i:i + 4096], self.viterbi(codes[i:i + 4096].astype(np.int64))))

    def encode(self, texts: list[str]) -> list[bytes]:
        """Each text's ids as little-endian unsigned 32-bit numbers."""
        cut = [self.segments.findall(MARK + t.replace(" ", MARK)) if t else [] for t in texts]
        if len(self.known) > KEPT:
            self.known = {}
        new = {s for c in cut for s in c}.difference(self.known)
        self._learn(sorted(new))
        get = self.known.__getitem__
        return [b"".join(map(get, c)) for c in cut]

    def decode(self, ids: bytes) -> str:
        """The text of ids: marks are spaces, the one before the first word goes, bytes are UTF-8."""
        raw = b"".join(map(self.out.__getitem__, np.frombuffer(ids, "<u4").tolist()))
        text = raw.decode("utf-8", "replace")
        return text[1:] if text.startswith(" ") else text


_encoders: dict[int, Encoder] = {}


def _encoder(shipped) -> Encoder:
    key = id(shipped.value)
    if key not in _encoders:
        _encoders.clear()
        _encoders[key] = Encoder(shipped.value)
    return _encoders[key]


def shipped(spark: SparkSession, model_path: str, kind: str = "bpe"):
    return spark.sparkContext.broadcast(Vocabulary(model_path, kind))


#: Characters that are encoded together, about.
BATCH_CHARS = 1 << 22


def _batches(texts: list[str]) -> Iterator[tuple[int, int]]:
    first, size = 0, 0
    for i, t in enumerate(texts):
        size += len(t)
        if size >= BATCH_CHARS:
            yield first, i + 1
            first, size = i + 1, 0
    if first < len(texts):
        yield first, len(texts)


def _encode_rows(model):
    def run(batches):
        encoder = _encoder(model)
        for batch in batches:
            texts = [t or "" for t in batch.column("text").to_pylist()]
            for a, b in _batches(texts):
                yield pa.RecordBatch.from_arrays([batch.column("id").slice(a, b - a),
                                                  pa.array(encoder.encode(texts[a:b]), pa.binary())], ["id", "ids"])
    return run


def encoded(docs: DataFrame, model_path: str, kind: str = "bpe", id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of ``docs``: ``id_col``, ids (binary, little-endian unsigned 32-bit). Null and empty texts have
    no ids. An empty table gives an empty result; other columns are ignored."""
    slim = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
    return workers(slim).mapInArrow(_encode_rows(shipped(docs.sparkSession, model_path, kind)),
                                    f"id {ids_like(slim, 'id')}, ids binary").withColumnRenamed("id", id_col)


def _decode_rows(model):
    def run(batches):
        encoder = _encoder(model)
        for batch in batches:
            yield pa.RecordBatch.from_arrays(
                [batch.column("id"), pa.array([encoder.decode(x or b"") for x in batch.column("ids").to_pylist()], pa.string())],
                ["id", "text"])
    return run


def decoded(rows: DataFrame, model_path: str, kind: str = "bpe", id_col: str = "doc_id", ids_col: str = "ids") -> DataFrame:
    """The texts of ids: ``id_col``, text. Null ids give the empty text."""
    slim = rows.select(F.col(id_col).alias("id"), F.col(ids_col).cast("binary").alias("ids"))
    return workers(slim).mapInArrow(_decode_rows(shipped(rows.sparkSession, model_path, kind)),
                                    f"id {ids_like(slim, 'id')}, text string").withColumnRenamed("id", id_col)


def _round_trip(model):
    def run(batches):
        encoder = _encoder(model)
        for batch in batches:
            texts = [t or "" for t in batch.column("text").to_pylist()]
            for a, b in _batches(texts):
                ids = encoder.encode(texts[a:b])
                same = [encoder.decode(x) == t for x, t in zip(ids, texts[a:b])]
                yield pa.RecordBatch.from_arrays(
                    [batch.column("id").slice(a, b - a), pa.array([len(x) // 4 for x in ids], pa.int64()),
                     pa.array([zlib.crc32(x) for x in ids], pa.int64()), pa.array(same, pa.bool_())],
                    ["id", "n_ids", "ids_crc32", "decodes"])
    return run


def round_trips(docs: DataFrame, model_path: str, kind: str = "bpe", id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Encodes and decodes each text in one pass: ``id_col``, n_ids, ids_crc32, decodes (whether decoding gives the
    text again, which holds but for texts with U+2581)."""
    slim = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
    return workers(slim).mapInArrow(_round_trip(shipped(docs.sparkSession, model_path, kind)),
                                    f"id {ids_like(slim, 'id')}, n_ids long, ids_crc32 long, decodes boolean").withColumnRenamed("id", id_col)
