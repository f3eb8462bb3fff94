"""Toxicity by the nearest labelled examples.

A bounded sample of labelled texts is the collection (``EXAMPLES`` of each label, a parameter; of near copies
one). Every word that two examples hold is a term. Document frequencies come from all documents. Examples and
texts are TF-IDF vectors over all terms, of unit length, with a term's weight 1 + log(count) times log(documents
/ documents with it) times the root of how far it depends on the examples' labels (G statistic); no term is left
out. The examples' inverted index is cut into blocks of ``BLOCK`` examples with each term's greatest weight in
the block: the sum of these bounds the cosine of any example there, so the blocks with the greatest bounds are read,
then those whose bounds reach the k-th best cosine. The k neighbours are exact, and all that tie with the k-th vote too.
They vote with weight 1 / (distance + 0.05); the vote is calibrated on the examples' own votes, each without
itself, by isotonic regression with the labels weighted as they are among all labelled rows. Texts without any
term take the share among such examples.
"""

from __future__ import annotations

import re
import sys
from collections import Counter
from collections.abc import Iterator
from functools import cache
from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rentlens.llm import shingles
from rentlens.llm.common import ids_like, saved, slices, workers
from rentlens.llm.near_dedup import signatures

EXAMPLES, BLOCK, NEIGHBOURS = 3000, 64, 31
#: How many times the examples are drawn, so that copies among them can be replaced.
DRAWN = 2
#: Frequent terms whose weights are kept as a matrix, and queries multiplied with it at once.
DENSE, TOGETHER = 512, 128
#: Blocks that a query reads before it chooses the others.
FIRST = 8
#: G statistic that a term has at least, so that none is without weight.
LEAST_G = 0.1
WORD = re.compile(r"[^\W\d_]+")
REJECT = 0.7


def held_out(id_col: str) -> Column:
    """Rows whose labels are never learnt."""
    return F.coalesce(F.crc32(F.col(id_col).cast("string").cast("binary")) % 3 == 1, F.lit(False))


@cache
def _letters() -> np.ndarray:
    """Which code points are part of a WORD."""
    letter = np.zeros(sys.maxunicode + 1, bool)
    for run in WORD.finditer(np.arange(len(letter), dtype=np.uint32).tobytes().decode("utf-32-le", "surrogatepass")):
        letter[run.start():run.end()] = True
    return letter


#: ASCII bytes, lower case: what is no letter becomes a blank.
ASCII = bytes(c if chr(c).islower() and c < 128 else 32 for c in range(256))


def terms_of(text: str) -> list[str]:
    """All matches of WORD in the text in lower case: what is no letter becomes a blank, which is faster."""
    text = text.lower()
    if text.isascii():
        return text.encode().translate(ASCII).decode().split()
    code = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
    return np.where(_letters().take(code), code, np.uint32(32)).tobytes().decode("utf-32-le").split()


def _term_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        counts: Counter = Counter()
        for text in batch.column("text").to_pylist():
            counts.update(set(terms_of(text or "")))
        yield pa.RecordBatch.from_arrays([pa.array(list(counts), pa.string()), pa.array(list(counts.values()), pa.int64())],
                                         ["term", "n"])


class Vectors:
    """Counts of the vocabulary's terms in texts."""

    def __init__(self, vocabulary: list[str]):
        self.at = {t: i for i, t in enumerate(vocabulary)}

    def counts(self, text: str | None) -> dict[int, int]:
        return dict(zip(*(x.tolist() for x in self.arrays(text))))

    def ids(self, text: str | None) -> np.ndarray:
        """The terms of the text that are in the vocabulary, in order, as often as they occur."""
        words = terms_of(text) if text and self.at else []
        ids = np.fromiter(map(self.at.get, words, repeat(-1)), np.int64, len(words))
        ids.sort()
        return ids[ids.searchsorted(0):]

    def arrays(self, text: str | None) -> tuple[np.ndarray, np.ndarray]:
        """The text's terms in order, and their counts."""
        ids = self.ids(text)
        new = np.ones(len(ids) + 1, bool)
        np.not_equal(ids[1:], ids[:-1], out=new[1:-1])
        at = np.flatnonzero(new)
        return ids.take(at[:-1]), at[1:] - at[:-1]


def _df_rows(vocabulary):
    def run(batches):
        vectors = Vectors(vocabulary.value)
        df = np.zeros(len(vocabulary.value) + 1, np.int64)
        for batch in batches:
            seen, held = [np.zeros(0, np.int64)], 0
            for text in batch.column(0):
                seen.append(vectors.arrays(text.as_py())[0])
                held += len(seen[-1])
                if held > 1 << 18:
                    df += np.bincount(np.concatenate(seen), minlength=len(df))
                    seen, held = seen[:1], 0
            df += np.bincount(np.concatenate(seen), minlength=len(df))
            df[-1] += len(batch)
        some = np.flatnonzero(df)
        yield pa.RecordBatch.from_arrays([pa.array(some, pa.int64()), pa.array(df[some])], ["term", "n"])
    return run


def _count_rows(vocabulary):
    def run(batches):
        vectors = Vectors(vocabulary.value)
        for batch in batches:
            got = [vectors.arrays(t) for t in batch.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [batch.column("id"), batch.column("label"), *(pa.array([x.astype(np.int32).tobytes() for x in side], pa.binary())
                                                                       for side in (zip(*got) if got else ((), ())))], ["id", "label", "terms", "counts"])
    return run


def first_of_copies(sets: list[np.ndarray], sigs: np.ndarray, percent: int = 80) -> list[int]:
    """The rows that stay, in order: of near copies (``percent`` of their shingle sets, confirmed), and rows linked through
    near copies, the first. Rows that share four neighbouring MinHash values are compared. Empty sets stay."""
    group = np.arange(len(sets))
    for at in range(0, sigs.shape[1], 4):
        buckets: dict[bytes, list[int]] = {}
        for row in range(len(sets)):
            if len(sets[row]):
                buckets.setdefault(sigs[row, at:at + 4].tobytes(), []).append(row)
        for rows in (np.array(b) for b in buckets.values() if len(b) > 1):
            for j in range(1, len(rows)):
                row, apart = rows[j], rows[:j][group[rows[:j]] != group[rows[j]]]
                # values agree in five standard errors less than the share, or the sets need not be looked at
                near = apart[np.count_nonzero(sigs[apart] == sigs[row], axis=1) * 100 >= (percent - 18) * sigs.shape[1]]
                for other in near.tolist():
                    if group[other] != group[row]:
                        both = shingles.shared(sets[other], sets[row])
                        if both * 100 >= percent * (len(sets[other]) + len(sets[row]) - both):
                            low, high = sorted((group[other], group[row]))
                            group[group == high] = low
    return np.flatnonzero(group == np.arange(len(sets))).tolist()


def _single(table: pa.Table) -> pa.Table:
    table = table.sort_by([("place", "ascending")])
    sets, sigs = [], [np.zeros((0, 4), np.uint16)]
    for _, _, data, offs in slices(table.column("text"), shingles.SLICE):
        some = shingles.shingle_sets(data, offs, 5)
        sets += some
        sigs.append(signatures(some))
    return table.select(["id", "label"]).take(first_of_copies(sets, np.concatenate(sigs[1:] or sigs)))


def without_copies(texts: DataFrame) -> DataFrame:
    """Of the examples drawn (id, label, text), those (id, label) that stay when near copies of one label count once: the
    chance words of a text copied fifty times would look telling. A label's examples, bounded in number, are one task."""
    placed = texts.withColumn("place", F.xxhash64(F.col("id").cast("string")))
    return workers(placed).groupBy("label").applyInArrow(_single, f"id {ids_like(texts, 'id')}, label int")


def _spread(low: np.ndarray, n: np.ndarray) -> np.ndarray:
    """The numbers low[i] to low[i] + n[i] - 1 for each i, joined."""
    return np.repeat(low - (np.cumsum(n) - n), n) + np.arange(n.sum())


class BlockMaxIndex:
    """Unit vectors as postings by term. The postings of the ``DENSE`` terms that most vectors have are rows of a matrix.
    Of the other terms, those with at least as many postings as there are blocks of vectors have their greatest weight in
    each block and the place of its postings; a rarer one's postings are no more than its bounds would be and are read."""

    def __init__(self, vectors: list[tuple[np.ndarray, np.ndarray]], n_terms: int, block: int = BLOCK):
        self.block, self.blocks, self.size = block, -(-len(vectors) // block), len(vectors)
        term = np.concatenate([t for t, _ in vectors]) if vectors else np.zeros(0, np.int64)
        weight = np.concatenate([w for _, w in vectors]) if vectors else np.zeros(0)
        doc = np.repeat(np.arange(len(vectors)), [len(t) for t, _ in vectors])
        held = np.bincount(term, minlength=n_terms)
        often = np.argsort(-held, kind="stable")[:DENSE]
        often = often[held[often] * 16 > self.size]
        self.row = np.full(n_terms, -1, np.int32)  # in the matrix
        self.row[often] = np.arange(len(often))
        self.matrix = np.zeros((len(often), self.blocks * block))
        own = self.row[term] >= 0
        self.matrix[self.row[term[own]], doc[own]] = weight[own]
        term, weight, doc = term[~own], weight[~own], doc[~own]
        order = np.lexsort((doc, term))
        self.doc, self.weight, term = doc[order].astype(np.int32), weight[order], term[order]
        self.start = np.searchsorted(term, np.arange(n_terms + 1))
        bounded = np.flatnonzero(np.diff(self.start) >= max(1, self.blocks))
        self.bounds = np.full(n_terms, -1, np.int32)  # the row in tops and places
        self.bounds[bounded] = np.arange(len(bounded))
        self.tops = np.zeros((len(bounded), self.blocks))
        row = self.bounds[term]
        np.maximum.at(self.tops, (row[row >= 0], self.doc[row >= 0] // block), self.weight[row >= 0])
        self.places = np.searchsorted(term * self.blocks + self.doc // block,
                                      bounded[:, None] * self.blocks + np.arange(self.blocks + 1)).astype(np.int32)

    def nearest(self, terms: np.ndarray, weights: np.ndarray, k: int, without: int = -1) -> tuple[np.ndarray, np.ndarray]:
        """The k vectors with the greatest cosines over 0 and all that tie with the last of them (to 9 digits), and the
        cosines, the greatest first."""
        return self.all_nearest([(terms, weights)], k, [without])[0]

    def all_nearest(self, queries: list[tuple[np.ndarray, np.ndarray]], k: int, without: list[int] | None = None):
        """``nearest`` of each query; what frequent terms add is one matrix product of ``TOGETHER`` queries."""
        out = []
        for a in range(0, len(queries), TOGETHER):
            some = queries[a:a + TOGETHER]
            q = np.zeros((len(some), len(self.matrix)))
            rest = []
            for i, (terms, weights) in enumerate(some):
                row = self.row[terms]
                q[i, row[row >= 0]] = weights[row >= 0]
                rest.append((terms[row < 0], weights[row < 0]))
            scores = q @ self.matrix
            out += [self._rest(scores[i], *rest[i], k, without[a + i] if without else -1) for i in range(len(some))]
        return out

    def _added(self, first: np.ndarray, last: np.ndarray, weights: np.ndarray) -> np.ndarray:
        """What the postings first[i] to last[i] - 1, times weights[i], add to each score."""
        at = _spread(first, last - first)
        return np.bincount(self.doc.take(at), np.repeat(weights, last - first) * self.weight.take(at), self.blocks * self.block)

    def _rest(self, score: np.ndarray, terms: np.ndarray, weights: np.ndarray, k: int, without: int):
        """Adds the other terms' part to the scores, rare terms first, then block by block: a block's bound is its best
        score so far and each term's greatest weight there. The ``FIRST`` blocks with the greatest bounds give a k-th
        best; of the others those whose bounds reach it are read at once."""
        row = self.bounds.take(terms)
        rare, row, often = row < 0, row[row >= 0], weights[row >= 0]
        score = score + self._added(self.start.take(terms[rare]), self.start.take(terms[rare] + 1), weights[rare])
        if without >= 0:
            score[without] = -1e9
        by_block = score.reshape(-1, self.block)
        bound = by_block.max(1) + often @ self.tops.take(row, 0)
        order = np.argsort(-bound, kind="stable")
        order = order[bound[order] > 0]
        places = self.places.take(row, 0)
        done = np.zeros(by_block.shape)
        kth = 0.0
        for some in (order[:FIRST], order[FIRST:]):
            some = np.sort(some[bound[some] + 2e-9 >= kth])
            if len(some):
                first, last = places[:, some].ravel(), places[:, some + 1].ravel()
                part = self._added(first, last, np.repeat(often, len(some)))
                done[some] = by_block[some] + part.reshape(by_block.shape)[some]
                if not kth and done[some].size >= k:
                    kth = max(0.0, np.partition(done[some], -k, axis=None)[-k])
        done = done.reshape(-1)
        hit = np.flatnonzero(done + 2e-9 >= kth)  # rounding moves none over another of these
        cosines = np.round(done[hit], 9)
        hit, cosines = hit[cosines > 0], cosines[cosines > 0]
        if len(hit) > k:
            near = cosines >= np.partition(cosines, -k)[-k]
            hit, cosines = hit[near], cosines[near]
        best = np.lexsort((hit, -cosines))
        return hit[best], cosines[best]


Counts = dict[int, int] | tuple[np.ndarray, np.ndarray]


def _arrays(counts: Counts) -> tuple[np.ndarray, np.ndarray]:
    """Terms in order, and their counts."""
    if isinstance(counts, dict):
        t, n = np.fromiter(counts.keys(), np.int64, len(counts)), np.fromiter(counts.values(), np.int64, len(counts))
        order = np.argsort(t)
        return t[order], n[order]
    return counts


def dependence(n_terms: int, labels: list[int], counts: list[tuple[np.ndarray, np.ndarray]]) -> np.ndarray:
    """How far each term depends on the examples' labels: the G statistic of its 2 x 2 table, at least LEAST_G, over
    the number of examples."""
    y = np.array(labels, bool)
    with_ = [np.bincount(np.concatenate([np.zeros(0, np.int64), *(t for (t, _), own in zip(counts, y) if own == want)]),
                         minlength=n_terms) for want in (True, False)]
    total, n = with_[0] + with_[1], len(labels)
    g = np.zeros(n_terms)
    for got, size in zip(with_, (int(y.sum()), int((~y).sum()))):
        for seen, all_of in ((got, total), (size - got, n - total)):
            some = seen > 0
            g[some] += 2 * seen[some] * np.log(seen[some] * n / (all_of[some] * size))
    return np.maximum(g, LEAST_G) / max(1, n)


def isotonic(x: np.ndarray, y: np.ndarray, weight: np.ndarray, prior: float = 10.0) -> tuple[np.ndarray, np.ndarray]:
    """Steps of the increasing function nearest to y: least x of each step, value. Each step is mixed with ``prior``
    examples that have the mean label and weigh as the step's own do on average, so that a few examples alone do not
    make a high score, and many of a rare label do."""
    xs, inverse = np.unique(x, return_inverse=True)
    w, v, n = np.bincount(inverse, weight), np.bincount(inverse, weight * y), np.bincount(inverse)
    steps: list[list[float]] = []
    for a, wi, vi, ni in zip(xs, w, v, n):
        steps.append([a, wi, vi, ni])
        while len(steps) > 1 and steps[-2][2] / steps[-2][1] >= steps[-1][2] / steps[-1][1]:
            _, *more = steps.pop()
            steps[-1][1:] = [p + q for p, q in zip(steps[-1][1:], more)]
    base = (weight * y).sum() / weight.sum()
    own = [prior * s[1] / s[3] for s in steps]
    return np.array([s[0] for s in steps]), np.array([(s[2] + o * base) / (s[1] + o) for s, o in zip(steps, own)])


class Model:
    """What workers score with; its size is bounded by EXAMPLES and the terms of an example."""

    def __init__(self, vocabulary, idf, ids, labels, counts, share: dict[int, float], k: int = NEIGHBOURS):
        self.vocabulary, self.k = vocabulary, k
        counts = [_arrays(c) for c in counts]
        self.idf = idf * np.sqrt(dependence(len(vocabulary), labels, counts)) if ids else idf
        # examples with the same heaviest terms are neighbours, so that blocks' bounds differ; places change no vote
        vectors = {i: self.vector(counts[i]) for i in range(len(ids)) if len(counts[i][0])}
        some = sorted(vectors, key=lambda i: (vectors[i][0][np.argsort(-vectors[i][1], kind="stable")[:8]].tolist(), str(ids[i])))
        self.ids, self.labels = [str(ids[i]) for i in some], np.array([labels[i] for i in some], float)
        self.weight = np.array([share[labels[i]] for i in some])
        self.index = BlockMaxIndex([vectors[i] for i in some], len(vocabulary))
        blank = [labels[i] for i in range(len(ids)) if not len(counts[i][0])]
        toxic, all_ = (sum(share[y] for y in blank if y or not one) for one in (True, False))
        self.blank = toxic / all_ if all_ else 0.0
        near = self.index.all_nearest([vectors[i] for i in some], k, list(range(len(some))))
        raw = np.array([self.vote(*x) for x in near])
        self.steps, self.values = isotonic(raw, self.labels, self.weight) if some else (np.zeros(1), np.zeros(1))

    def vector(self, counts: Counts) -> tuple[np.ndarray, np.ndarray]:
        t, n = _arrays(counts)
        w = (1 + np.log(n)) * self.idf[t]
        return t, w / np.sqrt((w * w).sum())

    def vote(self, docs: np.ndarray, cosines: np.ndarray) -> float:
        if not len(docs):
            return self.blank
        w = self.weight[docs] / (1.05 - np.minimum(cosines, 1))
        return float((w * self.labels[docs]).sum() / w.sum())

    def score(self, counts: Counts) -> tuple[float, list[tuple[str, int, float]]]:
        return self.scores([counts])[0]

    def scores(self, counts: list[Counts]) -> list[tuple[float, list[tuple[str, int, float]]]]:
        """Each text's score and evidence."""
        some = [i for i, c in enumerate(counts) if len(_arrays(c)[0])]
        out: list = [(self.blank, [])] * len(counts)
        for i, (docs, cosines) in zip(some, self.index.all_nearest([self.vector(counts[i]) for i in some], self.k)):
            at = max(0, int(np.searchsorted(self.steps, self.vote(docs, cosines) + 1e-12)) - 1)
            out[i] = float(self.values[at]), [(self.ids[d], int(self.labels[d]), round(float(c), 6)) for d, c in zip(docs[:3], cosines)]
        return out


def fit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", examples: int = EXAMPLES) -> Model:
    """Learns from labelled rows that are not held out. ``labels``: ``id_col``, toxic (null: no label; of several
    labels of an id the greatest counts). Of DRAWN x ``examples`` rows of a label, in the order of their ids' hashes,
    near copies go and the first ``examples`` stay. Without examples of both labels, every score is the labels' mean."""
    known = (labels.filter(F.col(id_col).isNotNull() & F.col("toxic").isNotNull() & ~held_out(id_col))
             .groupBy(id_col).agg(F.max("toxic").cast("int").alias("label")))
    total = {r["label"]: r["count"] for r in known.groupBy("label").count().collect()}
    order = F.xxhash64(F.col(id_col).cast("string"))
    drawn = [r for y in (0, 1) for r in known.filter(F.col("label") == y).orderBy(order, id_col).limit(DRAWN * examples).collect()]
    spark = docs.sparkSession
    sample = spark.createDataFrame([(r[0], r[1]) for r in drawn], known.schema).toDF("id", "label")  # 2 x DRAWN x examples rows
    texts = saved(docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
                  .join(F.broadcast(sample), "id").select("id", "label", "text"))
    kept = {tuple(r) for r in without_copies(texts).collect()}
    chosen = [(i, y) for y in (0, 1) for i in [r[0] for r in drawn if (r[0], y) in kept][:examples]]
    chosen = spark.createDataFrame(chosen, known.schema).toDF("id", "label")
    texts = saved(texts.join(F.broadcast(chosen), ["id", "label"], "left_semi"))
    n = {r["label"]: r["count"] for r in texts.groupBy("label").count().collect()}
    vocabulary: list[str] = []
    if n.get(0) and n.get(1):
        vocabulary = (workers(texts).mapInArrow(_term_rows, "term string, n long").groupBy("term")
                      .agg(F.sum("n").alias("n")).filter("n >= 2").select("term").orderBy("term").toArrow()["term"].to_pylist())
    if not vocabulary:
        model = Model([], np.zeros(0), [], [], [], {})
        model.blank = total.get(1, 0) / max(1, sum(total.values()))
        return model
    sent = spark.sparkContext.broadcast(vocabulary)  # bounded by the examples' words
    every = docs.select(F.col(text_col).cast("string").alias("text"))
    found = (workers(every).mapInArrow(_df_rows(sent), "term long, n long").groupBy("term").agg(F.sum("n").alias("n"))
             .toArrow())  # a row per term
    df = np.zeros(len(vocabulary) + 1)
    df[found["term"].to_numpy()] = found["n"].to_numpy()
    idf = np.log((1 + df[-1]) / (1 + df[:-1])) + 1e-3
    rows = texts.mapInArrow(_count_rows(sent), f"id {ids_like(texts, 'id')}, label int, terms binary, counts binary").collect()
    rows.sort(key=lambda r: str(r["id"]))
    return Model(vocabulary, idf, [r["id"] for r in rows], [r["label"] for r in rows],
                 [tuple(np.frombuffer(r[c], np.int32).astype(np.int64) for c in ("terms", "counts")) for r in rows], {y: total[y] / n[y] for y in n})


def _scores(model: Model, vectors: Vectors, texts: pa.Array) -> Iterator[tuple[float, list]]:
    """Each text's score and evidence, TOGETHER texts at a time."""
    for a in range(0, len(texts), TOGETHER):
        yield from model.scores([vectors.arrays(t.as_py()) for t in texts.slice(a, TOGETHER)])


def _score_rows(model):
    def run(batches):
        m = model.value
        vectors = Vectors(m.vocabulary)
        for batch in batches:
            scores, evidence = [], []
            for s, near in _scores(m, vectors, batch.column("text")):
                scores.append(s)
                evidence.append([{"id": i, "toxic": y, "cosine": c} for i, y, c in near])
            kind = pa.list_(pa.struct([("id", pa.string()), ("toxic", pa.int32()), ("cosine", pa.float64())]))
            yield pa.RecordBatch.from_arrays([batch.column("id"), batch.column("print"), pa.array(scores, pa.float64()),
                                              pa.array(evidence, kind)], ["id", "print", "score", "evidence"])
    return run


def scored(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of ``docs``: ``id_col``, print (a hash of the text), held_out, score, predicted (1 from 0.7
    on), evidence (the three nearest examples: id, toxic, cosine). Null and empty texts have no terms. An empty
    table gives an empty result; other columns are ignored."""
    slim = docs.select(F.col(id_col).alias("id"), F.xxhash64(F.col(text_col).cast("string")).alias("print"),
                       F.col(text_col).cast("string").alias("text"))
    out = workers(slim).mapInArrow(_score_rows(docs.sparkSession.sparkContext.broadcast(model)),
                                   f"id {ids_like(slim, 'id')}, print long, score double, evidence array<struct<id: string, toxic: int, cosine: double>>")
    return out.select(F.col("id").alias(id_col), "print", held_out("id").alias("held_out"), "score",
                      (F.col("score") >= REJECT).cast("int").alias("predicted"), "evidence")


def _keep_rows(model, text_at: int):
    def run(batches):
        m = model.value
        vectors = Vectors(m.vocabulary)
        for batch in batches:
            keep = [s < REJECT for s, _ in _scores(m, vectors, batch.column(text_at))]
            yield batch.filter(pa.array(keep, pa.bool_()))
    return run


def without_toxic(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` without the rows that are predicted toxic; scored where they are, so nothing is shuffled."""
    model = docs.sparkSession.sparkContext.broadcast(fit(docs, labels, id_col, text_col))
    return workers(docs).mapInArrow(_keep_rows(model, docs.columns.index(text_col)), docs.schema)
