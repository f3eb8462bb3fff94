"""Near duplicates: MinHash signatures, a multi-index Hamming join, exact confirmation.

A text's signature has ``SYMBOLS`` MinHash values of 16 bits. The first ``KEYED`` are split into ``CHUNKS``
chunks; two signatures that differ there in at most CHUNKS * 2 - 1 symbols differ in at most one symbol of
some chunk (pigeonhole), so they agree there on all symbols but one. Each chunk is therefore filed under
the values of its symbols with each one left out in turn: whatever the wrong symbol's value, one of these
keys is common. All pairs within that distance share a bucket. Of the pairs that share one, those whose sets'
sizes allow the similarity and whose whole signatures are nearer than ``far`` (which texts at the least
similarity exceed with probability under 1e-9) are confirmed on the full shingle sets.

No bucket is ever expanded into its pairs:
1. texts with the same set are one class, found first, by two levels of grouping;
2. each member of a bucket is paired with the bucket's least member only, and confirmed links become
   components;
3. members of a bucket that are still in different components are compared with each other inside a task, in
   blocks of bounded size that are dealt out as cells: first by signatures, to learn which members have
   anyone near, then, for these alone, on the full sets. A cell keeps the components it joins, passes over
   pairs within one, and gives back only links that join two, fewer than it has members.
Pairs inside a component add nothing to it, so the components are those of all pairs.
"""

from __future__ import annotations

from collections.abc import Iterator
from math import comb

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from rentlens.llm import shingles as S
from rentlens.llm.common import fresh, ids_like, null_safe_semi, saved, slices, workers

SYMBOLS, KEYED, CHUNKS = 128, 32, 8
PER = KEYED // CHUNKS
MULT = np.random.Generator(np.random.PCG64(11)).integers(0, 1 << 63, SYMBOLS, np.uint64) * np.uint64(2) + np.uint64(1)
#: Members and shingles of a bucket that one side of a cell holds, about; members that are confirmed against one
#: head by one task.
BLOCK, BLOCK_SHINGLES, PART = 2048, 500_000, 512


def far(percent: int) -> int:
    """The least distance that a pair of that similarity exceeds with probability under 1e-9."""
    j, tail = percent / 100, 0.0
    for d in range(SYMBOLS, 0, -1):
        tail += comb(SYMBOLS, d) * (1 - j) ** d * j ** (SYMBOLS - d)
        if tail >= 1e-9:
            return d
    return 0


def signatures(sets: list[np.ndarray]) -> np.ndarray:
    """A row of ``SYMBOLS`` 16-bit values for each set; an empty set has zeros."""
    out = np.zeros((len(sets), SYMBOLS), np.uint16)
    some = np.flatnonzero([len(s) > 0 for s in sets])
    if len(some):
        flat = np.concatenate([sets[i] for i in some])
        starts = np.cumsum([0] + [len(sets[i]) for i in some[:-1]])
        for i, m in enumerate(MULT):
            low = np.minimum.reduceat(flat * m, starts)
            out[some, i] = (S.mix(low) >> np.uint64(48)).astype(np.uint16)
    return out


def _sign(words: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a, b, data, offs in slices(batch.column("text"), S.SLICE):
                sets = S.shingle_sets(data, offs, words)
                sums = [np.array([f(s).sum(dtype=np.uint64) for s in sets], np.uint64).view(np.int64)
                        for f in (lambda s: s, lambda s: S.mix(s + np.uint64(1)))]
                yield pa.RecordBatch.from_arrays(
                    [batch.column(c).slice(a, b - a) for c in ("id", "print")]
                    + [pa.array([len(s) for s in sets], pa.int64()), *map(pa.array, sums),
                       pa.array([r.tobytes() for r in signatures(sets)], pa.binary())],
                    ["id", "print", "n", "c1", "c2", "sig"])
    return run


def _key_columns() -> list[Column]:
    keys = []
    for c in range(CHUNKS):
        for gap in range(PER):
            rest = [F.substring("sig", 2 * (c * PER + j) + 1, 2) for j in range(PER) if j != gap]
            keys.append(F.xxhash64(F.lit(c * PER + gap), *rest))
    return keys


def _matrix(col: pa.Array) -> np.ndarray:
    return np.frombuffer(b"".join(col.to_pylist()), np.uint16).reshape(len(col), SYMBOLS)


def _sizes_allow(m: np.ndarray, n: np.ndarray, percent: int) -> np.ndarray:
    return 100 * np.minimum(m, n) >= percent * np.maximum(m, n)


def _nearer(percent: int):
    most = far(percent)

    def run(batches):
        for b in batches:
            if b.num_rows:
                near = (_matrix(b.column("sa")) != _matrix(b.column("sb"))).sum(1) <= most
                near &= _sizes_allow(np.array(b.column("na")), np.array(b.column("nb")), percent)
                yield b.select(["a", "b"]).filter(pa.array(near))
    return run


def _first_slot(equal: np.ndarray) -> np.ndarray:
    """The first key that pairs have in common, from which of their symbols are equal (a row for each pair)."""
    chunks = equal[:, :KEYED].reshape(len(equal), CHUNKS, PER)
    same = chunks.sum(2)
    c = (same >= PER - 1).argmax(1)
    row = np.arange(len(equal))
    return c * PER + np.where(same[row, c] == PER, 0, chunks[row, c].argmin(1))


def _groups(batches: Iterator[pa.RecordBatch], key: list[str]) -> Iterator[tuple[bool, pa.RecordBatch]]:
    """Runs of rows with the same key in sorted batches; True where a run begins."""
    last = None
    for b in batches:
        if not b.num_rows:
            continue
        k = np.stack([b.column(c).to_numpy(zero_copy_only=False) for c in key])
        cuts = [0, *(np.flatnonzero((k[:, 1:] != k[:, :-1]).any(0)) + 1), b.num_rows]
        for i, j in zip(cuts, cuts[1:]):
            now = tuple(k[:, i])
            yield now != last, b.slice(i, j - i)
            last = now


def _confirm(words: int, percent: int):
    def run(batches):
        head = None
        for new, b in _groups(batches, ["a", "part"]):
            links = []
            ids = b.column("b").to_pylist()
            for i, j, data, offs in slices(b.column("text"), S.SLICE):
                for id_, s in zip(ids[i:j], S.shingle_sets(data, offs, words)):
                    if id_ is None:  # the head comes first; the rows of a copied id are alike
                        head = s
                    else:
                        both = S.shared(head, s)
                        if 100 * both >= percent * (len(head) + len(s) - both):
                            links.append(id_)
            if links:
                yield pa.RecordBatch.from_arrays(
                    [pa.array([b.column("a")[0].as_py()] * len(links), pa.int64()), pa.array(links, pa.int64())],
                    ["a", "b"])
    return run


def confirmed(pairs: DataFrame, texts: DataFrame, words: int, percent: int) -> DataFrame:
    """The pairs (a, b) whose full sets are similar enough. A head's members are dealt to several tasks."""
    size = pairs.groupBy("a").agg(F.expr(f"count(*) div {PART} + 1").alias("parts"))
    dealt = pairs.join(size, "a").select("a", F.expr("pmod(xxhash64(b), parts)").alias("part"), "b")
    heads = dealt.select("a", "part").distinct().withColumn("b", F.lit(None).cast("long"))
    rows = (heads.join(texts, F.col("a") == F.col("rid")).unionByName(dealt.join(texts, F.col("b") == F.col("rid")))
            .select("a", "part", "b", "text"))
    rows = rows.repartition("a", "part").sortWithinPartitions("a", "part", F.col("b").asc_nulls_first())
    return rows.mapInArrow(_confirm(words, percent), "a long, b long").distinct()


def components(edges: DataFrame) -> DataFrame:
    """node, comp: the least node that can be reached, for every node of an edge (a, b). Each round takes
    the least label of the neighbours and then the label of the label, so long chains halve."""
    both = saved(edges.select("a", "b").unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))))
    now = saved(both.groupBy("a").agg(F.min("b").alias("m"))
                .select(F.col("a").alias("node"), F.least("a", "m").alias("comp")))
    while True:
        near = both.join(now, F.col("b") == F.col("node")).groupBy("a").agg(F.min("comp").alias("m"))
        step = now.join(near, F.col("a") == F.col("node")).select(
            "node", F.col("comp").alias("old"), F.least("comp", "m").alias("via"))
        jump = now.select(F.col("node").alias("via"), "comp")
        new = saved(step.join(jump, "via").select("node", "old", F.least("via", "comp").alias("comp")))
        if new.filter("comp <> old").isEmpty():
            return new.select("node", "comp")
        now = new.select("node", "comp")


class _Side:
    """The members of a cell's block."""

    def __init__(self, columns: list[tuple]):
        self.rid, self.comp, self.n, self.sig, self.sets = (list(c) for c in zip(*columns))
        self.rid, self.comp, self.n = (np.concatenate(c) for c in (self.rid, self.comp, self.n))
        self.sig, self.sets = np.concatenate(self.sig), [s for part in self.sets for s in part]


def _candidates(x: _Side, i: int, y: _Side, alone: bool, slot: int, percent: int, most: int) -> np.ndarray:
    """The members of ``y`` that ``x``'s i-th must be compared with here: in another component, of fitting size, with
    this key as the first in common, and near enough by signature."""
    j = np.flatnonzero((y.comp != x.comp[i]) & _sizes_allow(y.n, x.n[i], percent))
    if alone:
        j = j[j > i]
    equal = y.sig[j, :KEYED] == x.sig[i, :KEYED]
    keep = equal.reshape(len(j), CHUNKS, PER).sum(2).max(1, initial=0) >= PER - 1
    j, equal = j[keep], equal[keep]
    if len(j):
        j = j[_first_slot(equal) == slot]
    return j[(y.sig[j] != x.sig[i]).sum(1) <= most]


def _flagged(x: _Side, y: _Side, alone: bool, slot: int, percent: int, most: int) -> tuple[list, list]:
    """The members with any candidate (the key's own column is added outside)."""
    hit = [np.zeros(len(x.rid), bool), np.zeros(len(y.rid), bool)]
    for i in range(len(x.rid)):
        j = _candidates(x, i, y, alone, slot, percent, most)
        if len(j):
            hit[0][i] = True
            hit[1][j] = True
    rids = np.union1d(x.rid[hit[0]], y.rid[hit[1]]).tolist()
    return rids, rids


def _links(x: _Side, y: _Side, alone: bool, slot: int, percent: int, most: int) -> tuple[list, list]:
    """Links between different components, each joining two that were not joined here before."""
    each, ids = np.unique(np.concatenate(y.sets), return_inverse=True)
    starts = np.cumsum([0] + [len(s) for s in y.sets[:-1]])
    links: tuple[list, list] = ([], [])
    for i in range(len(x.rid)):
        j = _candidates(x, i, y, alone, slot, percent, most)
        if not len(j):
            continue
        own = np.zeros(len(each) + 1, np.int64)
        at = np.searchsorted(each, x.sets[i])
        at[at == len(each)] = 0
        own[at[each[at] == x.sets[i]]] = 1
        both = np.add.reduceat(own[ids], starts)[j]
        for k in j[100 * both >= percent * (x.n[i] + y.n[j] - both)]:
            a, b = x.comp[i], y.comp[k]
            if a != b:
                links[0].append(min(x.rid[i], y.rid[k]))
                links[1].append(max(x.rid[i], y.rid[k]))
                for side in (x, y):
                    side.comp[side.comp == max(a, b)] = min(a, b)
    return links


def _cells(work, percent: int, words: int | None):
    """Runs ``work`` on each cell of rows sorted by (key, i, j); rows have texts if ``words`` is given."""
    most = far(percent)

    def run(batches):
        parts: list[list] = [[], []]
        where: tuple = ()

        def done() -> Iterator[pa.RecordBatch]:
            if where and parts[0] and (where[1] == where[2] or parts[1]):
                key, i, j, slot = where
                x = _Side(parts[0])
                a, b = work(x, x if i == j else _Side(parts[1]), i == j, slot, percent, most)
                if a:
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(a, pa.int64()), pa.array(b if words else [key] * len(a), pa.int64())], ["a", "b"])
        for new, b in _groups(batches, ["key", "i", "j"]):
            if new:
                yield from done()
                parts, where = [[], []], tuple(b.column(c)[0].as_py() for c in ("key", "i", "j", "slot"))
            part = np.array(b.column("side"))
            for s in (0, 1):
                if (m := part == s).any():
                    own = b.filter(pa.array(m))
                    sets = [z for _, _, data, offs in slices(own.column("text"), S.SLICE)
                            for z in S.shingle_sets(data, offs, words)] if words else []
                    parts[s].append((*(np.array(own.column(c)) for c in ("rid", "comp", "n")), _matrix(own.column("sig")), sets))
        yield from done()
    return run


def _dealt(live: DataFrame) -> DataFrame:
    """Cells of rows (key, ..., rid, n): a bucket is cut into blocks, and each two blocks meet in a cell of their own."""
    size = live.groupBy("key").agg(F.expr(f"count(*) div {BLOCK} + sum(n) div {BLOCK_SHINGLES} + 1").alias("blocks"))
    dealt = live.join(size, "key").withColumn("block", F.expr("pmod(xxhash64(rid), blocks)"))
    cells = dealt.withColumn("other", F.explode(F.expr("sequence(0L, blocks - 1)"))).select(
        *live.columns, F.least("block", "other").alias("i"), F.greatest("block", "other").alias("j"),
        F.expr("if(block <= other, 0, 1)").alias("side"))
    return cells.repartition("key", "i", "j").sortWithinPartitions("key", "i", "j")


def across(live: DataFrame, texts: DataFrame, words: int, percent: int) -> DataFrame:
    """Of rows (key, slot, rid, comp, n, sig): links (a, b) that join the components of members of one key as all
    links would. ``texts``: rid, text (alike where a rid repeats)."""
    flagged = _dealt(live).mapInArrow(_cells(_flagged, percent, None), "rid long, key long").distinct()
    some = saved(live.join(flagged, ["key", "rid"]).select(*live.columns))
    full = some.join(texts.dropDuplicates(["rid"]), "rid").select(*live.columns, "text")
    return _dealt(full).mapInArrow(_cells(_links, percent, words), "a long, b long").distinct()


def near_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = 5,
                percent: int = 80) -> DataFrame:
    """One row per row of ``docs``: ``id_col``, n_shingles, component_id, kept, and print (a hash of the text).

    Words are runs of characters outside ASCII white space with A-Z lower-cased; a set holds the distinct
    shingles of ``words`` words (fewer words: the sequence as one). Two texts are linked if 100 times their
    sets' intersection is at least ``percent`` times the union. Null, empty and blank texts have empty sets
    and no links. component_id is the least id reachable (nulls are passed over; null if there is no other),
    kept says whether a row's id is that one; rows that share id and text share all answers. An empty table
    gives an empty result; other columns are ignored.
    """
    slim = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
    slim = slim.withColumn("print", F.xxhash64("text"))
    kind = ids_like(slim, "id")
    signed = workers(slim).mapInArrow(_sign(words), f"id {kind}, print long, n long, c1 long, c2 long, sig binary")
    signed = saved(signed.select("*", F.monotonically_increasing_id().alias("rid"),
                                 F.spark_partition_id().alias("part")))
    same = ["n", "c1", "c2"]
    best = F.min(F.struct("rid", "id", "print", "sig")).alias("best")
    local = saved(signed.filter("n > 0").groupBy("part", *same).agg(best, F.min("id").alias("least")))
    classes = saved(local.groupBy(*same).agg(F.min("best").alias("best"), F.min("least").alias("least"))
                    .select(*same, "best.*", "least"))
    keys = classes.select("rid", F.posexplode(F.array(*_key_columns())).alias("slot", "key"))
    shared = keys.groupBy("key").agg(F.min("rid").alias("head"), F.max("rid").alias("tail")).filter("head < tail")
    filed = saved(keys.join(shared.select("key", "head"), "key"))
    sig = classes.select("rid", "n", "sig")
    stars = filed.filter("rid <> head").select(F.col("head").alias("a"), F.col("rid").alias("b")).distinct()
    stars = saved(stars.join(sig.toDF("a", "na", "sa"), "a").join(sig.toDF("b", "nb", "sb"), "b")
                  .mapInArrow(_nearer(percent), "a long, b long"))
    wanted = classes.join(filed.select("rid").distinct(), "rid").select("rid", F.col("id").alias("id_"),
                                                                        F.col("print").alias("print_"))
    found = slim.filter(F.col("text").isNotNull()).join(
        wanted, (F.col("print") == F.col("print_")) & F.col("id").eqNullSafe(F.col("id_")))
    texts = saved(found.select("rid", "text"))
    edges = saved(confirmed(stars, texts, words, percent))
    comps = components(edges)
    placed = (filed.join(comps, F.col("rid") == F.col("node"), "left")
              .select("key", "slot", "rid", F.coalesce("comp", "rid").alias("comp")))
    open_ = placed.groupBy("key").agg(F.min("comp").alias("lo"), F.max("comp").alias("hi")).filter("lo < hi")
    live = placed.join(open_.select("key"), "key").join(sig, "rid").select("key", "slot", "rid", "comp", "n", "sig")
    late = saved(across(live, texts, words, percent))
    if not late.isEmpty():
        comps = components(edges.unionByName(late))
    reach = classes.join(comps, F.col("rid") == F.col("node"), "left").select(
        *same, "least", F.coalesce("comp", "rid").alias("comp"))
    reach = saved(reach)
    low = reach.groupBy("comp").agg(F.min("least").alias("component_id"))
    by_class = reach.join(low, "comp").select(*same, "component_id")
    by_part = local.select("part", *same).join(by_class, same)
    out = signed.join(by_part, ["part", *same], "left").withColumn(
        "component_id", F.when(F.col("n") > 0, F.col("component_id")).otherwise(F.col("id")))
    return out.select(F.col("id").alias(id_col), F.col("n").alias("n_shingles"), "component_id",
                      F.col("id").eqNullSafe(F.col("component_id")).alias("kept"), "print")


def drop_near_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = 5,
                     percent: int = 80) -> DataFrame:
    """``docs`` with one row of each group of near copies; rows without words stay."""
    tag, nth = fresh(docs, "print_of_text"), fresh(docs, "row_of_key")
    groups = near_groups(docs, id_col, text_col, words, percent)
    stay = groups.filter("kept").select(F.col(id_col), F.col("print").alias(tag)).distinct()
    tagged = docs.withColumn(tag, F.xxhash64(F.col(text_col).cast("string")))
    w = Window.partitionBy(id_col, tag).orderBy(F.lit(0))
    blank = F.trim(F.regexp_replace(F.coalesce(F.col(text_col).cast("string"), F.lit("")), r"[\x20\x09-\x0D]", "")) == ""
    return (null_safe_semi(tagged, stay, [id_col, tag]).withColumn(nth, F.row_number().over(w))
            .filter((F.col(nth) == 1) | blank).select(*docs.columns))
