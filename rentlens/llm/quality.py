"""Quality by ridge regression on random Fourier features of document statistics.

Each text becomes ``STATISTICS`` numbers (lengths, shares of kinds of bytes, repetition of words, pairs of
words and lines), computed on whole Arrow buffers. Standardised with the moments of the labelled rows, they
go through cos(Wx + b) with fixed random W and b, whose products approximate a Gaussian kernel. Tasks add up
the normal equations of their labelled rows, by ``FOLDS`` parts that a hash of the text names; Spark adds the
tasks' blocks. Every labelled row that is not held out counts, whatever their number: only ``FEATURES``^2
numbers a part come to the driver. From the sums without one part follow scores for that part's rows, so the
ridge's weight is chosen, and the scores are calibrated by isotonic regression (on counts per step of the raw
score), on rows the scores have not seen. The final fit uses all parts.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rentlens.llm import shingles
from rentlens.llm.common import ids_like, saved, slices, workers

FEATURES, FOLDS, STEPS, BLOCK = 256, 4, 2048, 32
#: Ridge weights tried, as shares of the number of examples.
WEIGHTS = (1e-6, 1e-5, 1e-4, 1e-3, 1e-2)
#: Standardised statistics end here; labelled rows that one task adds up.
CLIP, TASK_ROWS = 6.0, 1 << 16
#: The raw score's part in a score: it orders texts that calibration puts on one level.
TILT = 0.01
GOOD = 0.7


def held_out(id_col: str) -> Column:
    """Rows whose labels are never learnt."""
    return F.coalesce(F.crc32(F.col(id_col).cast("string").cast("binary")) % 4 == 2, F.lit(False))


def _class_of_bytes() -> np.ndarray:
    """Which share each byte counts for: column by kind."""
    kind = np.zeros((256, len(KINDS)))
    for i, chars in enumerate(KINDS):
        kind[list(chars), i] = 1
    return kind


KINDS = (range(97, 123), range(65, 91), range(48, 58), b" ", b"\n\r", b"\t\v\f", b".,", b";:'\"!?()-", b"#$%&*|<>=+/\\^_~@[]{}`",
         range(128, 192), range(192, 256), [*range(0, 9), *range(14, 32), 127])
BY_KIND = _class_of_bytes()
STATISTICS = len(KINDS) + 17


def _per_text(of: np.ndarray, n: int, weight=None) -> np.ndarray:
    return np.bincount(of, weight, n).astype(float)


def _repeats(key: np.ndarray, of: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Of each text's keys: how many different ones, how often the most frequent one."""
    order = np.lexsort((key, of))
    k, o = key[order], of[order]
    first = np.ones(len(k), bool)
    first[1:] = (k[1:] != k[:-1]) | (o[1:] != o[:-1])
    at = np.flatnonzero(first)
    times = np.diff(np.r_[at, len(k)])
    most = np.zeros(n)
    np.maximum.at(most, o[at], times)
    return _per_text(o[at], n), most


def statistics(data: np.ndarray, offs: np.ndarray) -> np.ndarray:
    """One row of STATISTICS numbers for each text data[offs[i]:offs[i + 1]]; of empty texts zeros."""
    n = len(offs) - 1
    size = np.diff(offs).astype(float)
    safe = np.maximum(size, 1)
    text = np.repeat(np.arange(n), np.diff(offs))
    counts = np.bincount(text * 256 + data, minlength=n * 256).reshape(n, 256).astype(float)
    shares = counts @ BY_KIND / safe[:, None]
    p = counts / safe[:, None]
    entropy = -(p * np.log2(np.where(p > 0, p, 1))).sum(1)
    ascii_letters = counts[:, 97:123].sum(1) + counts[:, 65:91].sum(1)
    upper = counts[:, 65:91].sum(1) / np.maximum(ascii_letters, 1)
    chars = size - counts[:, 128:192].sum(1)
    # words
    edge = np.zeros(len(data) + 1, bool)
    edge[offs] = True
    word = ~shingles.WHITE[data]
    left, right = np.ones(len(data), bool), np.ones(len(data), bool)
    left[1:] = ~word[:-1] | edge[1:-1]
    right[:-1] = left[1:] | ~word[1:]
    starts, ends = np.flatnonzero(word & left), np.flatnonzero(word & right) + 1
    h, of = shingles.word_hashes(data, offs)
    words = _per_text(of, n)
    some = np.maximum(words, 1)
    length = (ends - starts).astype(float)
    mean = _per_text(of, n, length) / some
    spread = np.sqrt(np.maximum(_per_text(of, n, length * length) / some - mean * mean, 0))
    letter = np.zeros(256, bool)
    letter[[*range(65, 91), *range(97, 123), *range(128, 256)]] = True
    plain_end = letter.copy()
    plain_end[list(b".,;:!?0123456789")] = True
    odd_end = _per_text(of, n, ~plain_end[data[ends - 1]]) / some if len(ends) else np.zeros(n)
    letters = np.r_[0, np.cumsum(letter[data])]
    no_letter = _per_text(of, n, letters[ends] == letters[starts]) / some
    different, top = _repeats(h, of, n)
    pair = of[1:] == of[:-1] if len(of) else np.zeros(0, bool)
    pairs = shingles.mix(h[:-1] * shingles.PLACE[0] + h[1:])[pair] if len(h) else h
    pair_of = of[1:][pair] if len(of) else of
    n_pairs = np.maximum(_per_text(pair_of, n), 1)
    different_pairs, _ = _repeats(pairs, pair_of, n)
    again = _per_text(pair_of, n, (h[1:] == h[:-1])[pair]) / n_pairs if len(h) else np.zeros(n)
    # lines: a hash of each from sums over its words
    lines_before = np.r_[0, np.cumsum(data == 10)]
    line = lines_before[starts] + of  # one more at each new text
    number, place = np.unique(line, return_inverse=True) if len(line) else (line, line)
    order = np.arange(len(h)) - np.r_[0, np.flatnonzero(np.diff(line)) + 1][place] if len(line) else line
    total = np.zeros(len(number), np.uint64)
    np.add.at(total, place, shingles.mix(h + order.astype(np.uint64) * shingles.PLACE[1]))
    line_of = np.zeros(len(number), np.int64)
    line_of[place] = of
    lines = np.maximum(_per_text(line_of, n), 1)
    different_lines, _ = _repeats(total, line_of, n)
    # the longest run of one byte
    change = np.flatnonzero(np.r_[True, (data[1:] != data[:-1]) | edge[1:-1]]) if len(data) else np.zeros(0, np.int64)
    run = np.zeros(n)
    np.maximum.at(run, text[change], np.diff(np.r_[change, len(data)]))
    sentences = counts[:, [33, 46, 63]].sum(1) + 1
    out = np.column_stack([
        shares, np.log1p(chars), np.log1p(words), np.log1p(mean), np.log1p(spread), upper, entropy, odd_end, no_letter,
        different / some, top / some, different_pairs / n_pairs, again, np.log1p(words / sentences), np.log1p(lines),
        different_lines / lines, np.log1p(words / lines), np.log1p(run)])
    out[size == 0] = 0
    return out


def _statistic_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for a, b, data, offs in slices(batch.column("text"), shingles.SLICE):
            own = statistics(data, offs).astype(np.float32)
            values = pa.FixedSizeListArray.from_arrays(pa.array(own.reshape(-1)), STATISTICS).cast(pa.list_(pa.float32()))
            yield pa.RecordBatch.from_arrays([batch.column("id").slice(a, b - a), batch.column("fold").slice(a, b - a), values],
                                             ["id", "fold", "x"])


def document_statistics(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of ``docs``: id, fold (by the text's hash), x (its statistics). Null texts count as empty."""
    slim = docs.select(F.col(id_col).alias("id"), F.pmod(F.xxhash64(F.col(text_col).cast("string")), F.lit(FOLDS)).cast("int").alias("fold"),
                       F.col(text_col).cast("string").alias("text"))
    return workers(slim).mapInArrow(_statistic_rows, f"id {ids_like(slim, 'id')}, fold int, x array<float>")


def _rows_of(column: pa.Array) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), STATISTICS).astype(float)


@dataclass
class Features:
    """Standardisation, then random cosines; the same in every process."""
    mean: np.ndarray
    spread: np.ndarray
    size: int = FEATURES

    def __call__(self, x: np.ndarray) -> np.ndarray:
        rng = np.random.Generator(np.random.PCG64(12))
        w = rng.normal(size=(x.shape[1], self.size)) / np.sqrt(x.shape[1])
        b = rng.uniform(0, 2 * np.pi, self.size)
        z = np.clip((x - self.mean) / self.spread, -CLIP, CLIP)
        return np.column_stack([np.cos(z @ w + b) * np.sqrt(2 / self.size), np.ones(len(x))])


def _moment_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    total = np.zeros((3, STATISTICS))
    for batch in batches:
        x = _rows_of(batch.column("x"))
        total += [np.full(STATISTICS, len(x)), x.sum(0), (x * x).sum(0)]
    yield pa.RecordBatch.from_arrays([pa.array(np.arange(STATISTICS), pa.int32()), *map(pa.array, total)], ["i", "n", "s", "q"])


def _equation_rows(features: Features):
    """The normal equations of a task's rows, for each fold in blocks of BLOCK rows."""
    def run(batches):
        m = features.size + 2  # features, the constant, the label
        total = np.zeros((FOLDS, m, m))
        for batch in batches:
            z = np.column_stack([features(_rows_of(batch.column("x"))), batch.column("label").to_numpy(zero_copy_only=False)])
            fold = batch.column("fold").to_numpy(zero_copy_only=False)
            for f in range(FOLDS):
                own = z[fold == f]
                total[f] += own.T @ own
        keys = [(f, i) for f in range(FOLDS) for i in range(0, m, BLOCK) if total[f, -2, -2] > 0]
        if keys:
            yield pa.RecordBatch.from_arrays(
                [pa.array([f * m + i for f, i in keys], pa.int32()),
                 pa.array([np.ascontiguousarray(total[f, i:i + BLOCK, i:]).tobytes() for f, i in keys], pa.binary())], ["block", "sums"])
    return run


def _added_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Blocks of one key added up as they come; all of a key are in one partition."""
    total: dict[int, np.ndarray] = {}
    for batch in batches:
        for key, raw in zip(batch.column("block").to_pylist(), batch.column("sums").to_pylist()):
            total[key] = total.get(key, 0) + np.frombuffer(raw)
    yield pa.RecordBatch.from_arrays([pa.array(list(total), pa.int32()), pa.array([v.tobytes() for v in total.values()], pa.binary())],
                                     ["block", "sums"])


def isotonic(value: np.ndarray, weight: np.ndarray) -> np.ndarray:
    """The rising values nearest to ``value`` by weighted squares."""
    parts: list[list[float]] = []
    for v, w in zip(value.tolist(), weight.tolist()):
        parts.append([v * w, w, 1])
        while len(parts) > 1 and parts[-2][0] * parts[-1][1] >= parts[-1][0] * parts[-2][1]:
            s, w2, k = parts.pop()
            parts[-1] = [parts[-1][0] + s, parts[-1][1] + w2, parts[-1][2] + k]
    return np.repeat([s / w for s, w, _ in parts], [k for *_, k in parts])


@dataclass
class Model:
    """What workers score with; ``constant`` where there is nothing to learn from."""
    features: Features | None
    weights: np.ndarray
    at: np.ndarray
    values: np.ndarray
    constant: float = 0.0

    def raw(self, x: np.ndarray) -> np.ndarray:
        return self.features(x) @ self.weights

    def scores(self, x: np.ndarray) -> np.ndarray:
        if self.features is None:
            return np.full(len(x), self.constant)
        raw = self.raw(x)
        level = np.interp(raw, self.at, self.values)
        return np.clip((1 - TILT) * level + TILT * np.clip((raw + 0.5) / 2, 0, 1), 0, 1)


def _step(raw: np.ndarray) -> np.ndarray:
    return np.clip((raw + 0.5) * STEPS / 2, 0, STEPS - 1).astype(np.int64)  # raw scores lie around 0 and 1


def _calibration_rows(features: Features, weights: np.ndarray):
    """Counts and sums by step of the raw score that the sums without a row's fold give."""
    def run(batches):
        total = np.zeros((3, STEPS))
        for batch in batches:
            z = features(_rows_of(batch.column("x")))
            fold = batch.column("fold").to_numpy(zero_copy_only=False)
            raw = (z * weights[fold]).sum(1)
            y = batch.column("label").to_numpy(zero_copy_only=False)
            at = _step(raw)
            total += [np.bincount(at, w, STEPS) for w in (np.ones(len(y)), y, np.clip(raw, -0.5, 1.5))]
        some = np.flatnonzero(total[0])
        yield pa.RecordBatch.from_arrays([pa.array(some, pa.int32()), *map(pa.array, total[:, some])], ["step", "n", "y", "raw"])
    return run


def fit(stats: DataFrame, labels: DataFrame, id_col: str = "doc_id") -> Model:
    """Learns from labelled rows that are not held out. ``stats``: of document_statistics; ``labels``: ``id_col``, quality
    (null: no label; of several labels of an id the greatest counts; any but 0 counts as 1). Without rows of both
    labels every score is the labels' mean (0 without labels)."""
    known = (labels.filter(F.col(id_col).isNotNull() & F.col("quality").isNotNull() & ~held_out(id_col))
             .groupBy(F.col(id_col).alias("id")).agg(F.max((F.col("quality") != 0).cast("double")).alias("label")))
    rows = saved(stats.filter(~held_out("id")).join(known, "id").select("fold", "label", "x"))
    got = rows.agg(F.count("label").alias("n"), F.sum("label").alias("y")).first()
    n, y = got["n"], got["y"] or 0.0
    if not 0 < y < n:
        return Model(None, np.zeros(0), np.zeros(0), np.zeros(0), y / n if n else 0.0)
    few = workers(rows).coalesce(-(-n // TASK_ROWS))
    moments = (few.mapInArrow(_moment_rows, "i int, n double, s double, q double").groupBy("i")
               .agg(*[F.sum(c).alias(c) for c in "nsq"]).orderBy("i").collect())
    mean = np.array([r["s"] / r["n"] for r in moments])
    spread = np.sqrt(np.maximum([r["q"] / r["n"] - (r["s"] / r["n"]) ** 2 for r in moments], 0))
    features = Features(mean, np.where(spread > 1e-9, spread, 1.0))
    m = features.size + 2
    parts = few.mapInArrow(_equation_rows(features), "block int, sums binary")
    blocks = parts.repartition("block").mapInArrow(_added_rows, "block int, sums binary").collect()
    total = np.zeros((FOLDS, m, m))
    for r in blocks:
        f, i = divmod(r["block"], m)
        total[f, i:i + BLOCK, i:] = np.frombuffer(r["sums"]).reshape(-1, m - i)
    for f in range(FOLDS):
        total[f] = np.triu(total[f]) + np.triu(total[f], 1).T

    def solve(sums: np.ndarray, ridge: float) -> np.ndarray:
        keep = np.eye(m - 1) * ridge * sums[-2, -2]
        keep[-1, -1] = 0  # the constant is free
        return np.linalg.lstsq(sums[:-1, :-1] + keep, sums[:-1, -1], rcond=None)[0]
    every = total.sum(0)
    best = None
    for ridge in WEIGHTS:
        own = [solve(every - t, ridge) if (every - t)[-2, -2] > 0 else np.r_[np.zeros(m - 2), y / n] for t in total]
        loss = sum(w @ t[:-1, :-1] @ w - 2 * w @ t[:-1, -1] + t[-1, -1] for w, t in zip(own, total))
        if best is None or loss < best[0]:
            best = loss, ridge, np.array(own)
    _, ridge, own = best
    steps = (few.mapInArrow(_calibration_rows(features, own), "step int, n double, y double, raw double").groupBy("step")
             .agg(*[F.sum(c).alias(c) for c in ("n", "y", "raw")]).orderBy("step").collect())
    count = np.array([r["n"] for r in steps])
    values = isotonic(np.array([r["y"] / r["n"] for r in steps]), count)
    _, level = np.unique(values, return_inverse=True)
    of_level = np.bincount(level, count)
    # each level is mixed with one average row, so that no score is surer than its rows allow
    values = isotonic(((np.bincount(level, count * values) + y / n) / (of_level + 1))[level], count)
    return Model(features, solve(every, ridge), np.array([r["raw"] / r["n"] for r in steps]), values)


def _score_rows(model):
    def run(batches):
        m = model.value
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column("id"), pa.array(m.scores(_rows_of(batch.column("x"))))], ["id", "score"])
    return run


def scored(stats: DataFrame, model: Model, id_col: str = "doc_id") -> DataFrame:
    """One row per row of ``stats``: ``id_col``, held_out, score (0 to 1; of empty texts too), predicted (1 from 0.7 on)."""
    shipped = stats.sparkSession.sparkContext.broadcast(model)  # FEATURES + STEPS numbers
    out = workers(stats).mapInArrow(_score_rows(shipped), f"id {ids_like(stats, 'id')}, score double")
    return out.select(F.col("id").alias(id_col), held_out("id").alias("held_out"), "score", (F.col("score") >= GOOD).cast("int").alias("predicted"))


def quality(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Statistics, fit and scores in one: texts are read once, their statistics are kept as a table. An empty table of
    documents gives an empty result; null ids and repeated rows are scored, too; other columns are ignored."""
    stats = saved(document_statistics(docs, id_col, text_col))
    return scored(stats, fit(stats, labels, id_col), id_col)
