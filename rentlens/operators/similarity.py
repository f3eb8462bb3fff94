"""Exact top-k cosine similarity (K1, J5) and the listing vector table.

Plan (blocked nested loop, exact):
  1. vectors are unit-normalised inside the cells (numpy, vectorised);
  2. optional item filters (rent limits) run before anything else, so they push
     into the scan — the reference's "filter first, exact" path;
  3. queries are hashed into ``nq`` blocks and items into ``ni`` blocks, sized from
     their counts (``BLOCKS`` of them while a block's vectors are few enough for a task's memory); each query row
     is replicated to the ``ni`` item blocks and each item to the ``nq`` query
     blocks, and the (query block, item block) cells are co-grouped;
  4. each cell is numpy matrix products of at most ``block_rows``² scores (Arrow batches in, no per-row Python),
     and emits only its k best items per query (score desc, id asc);
  5. a ``row_number`` per query over its ≤ ni·k candidates gives the final k.

Block keys come from the facet (when matches are restricted to equal facets) and a hash of the id, with as many
blocks as the facet's own rows need, so no facet value (a city holding a third of all listings) can make one cell
large and no product is spent on pairs of different facets. Shuffle volume is Q·ni + N·nq rows per facet; the
number of blocks of each facet is a written table, joined to the rows.

``topk_few`` is the plan for a search form's few queries: their vectors go to the tasks, items are scored where
they lie, and each task gives back at most k per query. Items are not shuffled at all.

``topk_lsh`` looks into the buckets of a random-projection index only: cells are those of equal buckets.

Items rank by their full score; ``decimals`` compares scores rounded to so many places instead, for results
that engines with another order of summation must repeat.
"""

from __future__ import annotations

from itertools import combinations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from rentlens.functions.features import add_vectors
from rentlens.session import materialize, ship_package

MAX_ITEM_BLOCK = 1 << 18  # item rows per cell at most (vectors of one cell stay well under 1 GB)
#: Blocks on each side that many rows are dealt into, as long as a block's vectors, as doubles, stay below so many bytes.
BLOCKS, BLOCK_BYTES = 16, 1 << 25


def _unit_rows(m: np.ndarray) -> np.ndarray:
    """Divide each row by its L2 norm unless the norm is 0."""
    n = np.sqrt((m * m).sum(axis=1, keepdims=True))
    return np.divide(m, n, out=m.copy(), where=n > 0)


def _top_per_row(S: np.ndarray, qids: np.ndarray, iids: np.ndarray, kk: int) -> pd.DataFrame:
    """k best (score desc, id asc) finite entries of each row of ``S``.

    ``np.partition`` finds each row's k-th score in linear time; only entries at
    or above it (ties included, so the cut stays exact) are sorted."""
    nq = S.shape[0]
    if S.shape[1] > kk:
        kth = -np.partition(-S, kk - 1, axis=1)[:, kk - 1]
        rows, cols = np.nonzero(S >= kth[:, None])
    else:
        rows, cols = np.nonzero(np.ones(S.shape, dtype=bool))
    sc = S[rows, cols]
    ids = iids[cols]
    order = np.lexsort((ids, -sc, rows))
    rows, sc, ids = rows[order], sc[order], ids[order]
    rank = np.arange(len(rows)) - np.searchsorted(rows, np.arange(nq))[rows]
    keep = (rank < kk) & np.isfinite(sc)
    return pd.DataFrame({"query_id": qids[rows[keep]], "item_id": ids[keep], "score": sc[keep]})


def _best_of_cell(Q: np.ndarray, I: np.ndarray, qids: np.ndarray, iids: np.ndarray, k: int, exclude_self: bool,
                  decimals: int | None, tile: int) -> pd.DataFrame:
    """k best items of each row of ``Q``, from score matrices of at most ``tile``² entries: a score below the k-th best of
    the items before is not looked at again (equal scores are, as ids break ties)."""
    out = []
    for a in range(0, len(Q), tile):
        q, qi = Q[a:a + tile], qids[a:a + tile]
        step = max(tile, tile * tile // len(q))
        rows, ids, sc, kth = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0), np.full(len(q), -np.inf)
        for b in range(0, len(I), step):
            S = q @ I[b:b + step].T
            S, ii = S if decimals is None else np.round(S, decimals), iids[b:b + step]
            if exclude_self:
                S = np.where(qi[:, None] != ii[None, :], S, -np.inf)
            if b == 0 and S.shape[1] > k:
                kth = np.nan_to_num(-np.partition(-S, k - 1, axis=1)[:, k - 1], nan=-np.inf, neginf=-np.inf)
            r, c = np.nonzero((S >= kth[:, None]) & np.isfinite(S))
            rows, ids, sc = np.concatenate([rows, r]), np.concatenate([ids, ii[c]]), np.concatenate([sc, S[r, c]])
            order = np.lexsort((ids, -sc, rows))
            rows, ids, sc = rows[order], ids[order], sc[order]
            rank = np.arange(len(rows)) - np.searchsorted(rows, np.arange(len(q)))[rows]
            rows, ids, sc, rank = (x[rank < k] for x in (rows, ids, sc, rank))
            kth[rows[rank == k - 1]] = sc[rank == k - 1]
        out.append(pd.DataFrame({"query_id": qi[rows], "item_id": ids, "score": sc}))
    return pd.concat(out)


def topk_similar(queries: DataFrame, items: DataFrame, k: int = 8, *,
                 q_id: str = "query_id", q_vec: str = "vector",
                 i_id: str = "item_id", i_vec: str = "vector",
                 q_facet: str | None = None, i_facet: str | None = None,
                 exclude_self: bool = False, block_rows: int = 4096,
                 item_cols: list[str] | None = None, decimals: int | None = None) -> DataFrame:
    """For each query row, the ``k`` items of highest cosine similarity.

    ``q_facet``/``i_facet`` restrict matches to equal facet values (same city /
    same label). ``exclude_self`` drops item == query (for self-similarity).
    Output: query_id, item_id, rank, score [, item_cols…]."""
    cand = _cells(queries, items, k, q_id, q_vec, i_id, i_vec, q_facet, i_facet, exclude_self, block_rows, decimals)
    return _ranked(cand, items, k, i_id, item_cols)


def _ranked(cand: DataFrame, items: DataFrame, k: int, i_id: str, item_cols: list[str] | None) -> DataFrame:
    """The k best candidates of each query, with the items' columns."""
    w = Window.partitionBy("query_id").orderBy(F.col("score").desc(), F.col("item_id"))
    top = cand.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= k)
    if item_cols:
        meta = items.select(F.col(i_id).cast("long").alias("item_id"), *item_cols)
        top = top.join(meta, "item_id", "left")
    return top


def _cells(queries: DataFrame, items: DataFrame, k: int, q_id: str, q_vec: str, i_id: str, i_vec: str, q_facet: str | None,
           i_facet: str | None, exclude_self: bool, block_rows: int, decimals: int | None) -> DataFrame:
    """The k best items of each query in each cell: query_id, item_id, score."""
    ship_package(queries.sparkSession)
    facet = q_facet is not None and i_facet is not None

    def vec(df: DataFrame, c: str):  # floats are shuffled as they are and become doubles in the cells
        return F.col(c) if df.schema[c].dataType == T.ArrayType(T.FloatType(), df.schema[c].dataType.containsNull) else F.col(c).cast("array<double>")
    q = queries.select(F.col(q_id).cast("long").alias("qid"), vec(queries, q_vec).alias("qv"),
                       (F.col(q_facet).cast("string") if facet else F.lit(None).cast("string")).alias("qf"))
    it = items.select(F.col(i_id).cast("long").alias("iid"), vec(items, i_vec).alias("iv"),
                      (F.col(i_facet).cast("string") if facet else F.lit(None).cast("string")).alias("if_"))
    # Rows are copied once for each block of the other side: many rows are dealt into few, large blocks, bounded by the
    # bytes of their vectors, and a cell goes through its scores by tiles of block_rows² entries; few queries
    # give few, tall item blocks (less per-cell overhead). With a facet every facet has blocks of its own, sized from
    # its own counts, so a query meets the items of its facet alone; rows without a facet match nothing.
    if facet:
        q, it = q.where(F.col("qf").isNotNull()), it.where(F.col("if_").isNotNull())
    sizes = (q.select(F.col("qf").alias("f"), F.lit(1).alias("q"), F.lit(0).alias("i"), F.size("qv").alias("d"))
             .unionByName(it.select(F.col("if_").alias("f"), F.lit(0).alias("q"), F.lit(1).alias("i"), F.size("iv").alias("d")))
             .groupBy("f").agg(F.sum("q").alias("q"), F.sum("i").alias("i"), F.max("d").alias("d")).where("q > 0 AND i > 0"))
    most = F.greatest(F.lit(block_rows), F.floor(F.lit(BLOCK_BYTES) / (8 * F.greatest(F.col("d"), F.lit(1)))))
    nq = F.ceil(F.col("q") / F.least(F.greatest(F.lit(block_rows), F.ceil(F.col("q") / BLOCKS)), most))
    q_per = F.greatest(F.ceil(F.col("q") / nq), F.lit(1))
    tall = F.greatest(F.lit(block_rows), F.floor(F.lit(block_rows * block_rows) / q_per))
    i_per = F.least(F.greatest(tall, F.least(F.ceil(F.col("i") / BLOCKS), most)), F.lit(MAX_ITEM_BLOCK))
    sizes = materialize(sizes.select("f", nq.cast("int").alias("nq"), F.greatest(F.ceil(F.col("i") / i_per), F.lit(1)).cast("int").alias("ni")))
    # (the concatenations give the joined facet a column of its own on each side; without one the counts are one row)
    def sized(df: DataFrame, own: str) -> DataFrame:
        if facet:
            return df.join(sizes, F.col(own) == F.col("f"))
        return df.withColumns({"f": F.col(own), "nq": sizes.select("nq").scalar(), "ni": sizes.select("ni").scalar()})
    qb = (sized(q, "qf").withColumn("qb", F.pmod(F.xxhash64("qid"), F.col("nq")).cast("int"))
          .withColumn("ib", F.explode(F.expr("sequence(0, ni - 1)"))).select("qid", "qv", F.concat("f", F.lit("")).alias("f"), "qb", "ib"))
    ib = (sized(it, "if_").withColumn("ib", F.pmod(F.xxhash64("iid"), F.col("ni")).cast("int"))
          .withColumn("qb", F.explode(F.expr("sequence(0, nq - 1)"))).select("iid", "iv", F.concat("f", F.lit("")).alias("f"), "qb", "ib"))

    out_schema = T.StructType([T.StructField("query_id", T.LongType()), T.StructField("item_id", T.LongType()),
                               T.StructField("score", T.DoubleType())])

    def cell(qpdf: pd.DataFrame, ipdf: pd.DataFrame) -> pd.DataFrame:
        if qpdf.empty or ipdf.empty:
            return pd.DataFrame({"query_id": pd.Series([], dtype="int64"),
                                 "item_id": pd.Series([], dtype="int64"),
                                 "score": pd.Series([], dtype="float64")})
        Q = _unit_rows(np.stack(qpdf["qv"].to_numpy()).astype(np.float64))
        I = _unit_rows(np.stack(ipdf["iv"].to_numpy()).astype(np.float64))
        return _best_of_cell(Q, I, qpdf["qid"].to_numpy(np.int64), ipdf["iid"].to_numpy(np.int64), k, exclude_self, decimals, block_rows)

    return (qb.groupBy("f", "qb", "ib").cogroup(ib.groupBy("f", "qb", "ib"))
            .applyInPandas(cell, schema=out_schema))


def _codes(df: DataFrame, id_col: str, vec_col: str, tables: int, bits: int, flips: int, seed: int) -> DataFrame:
    """Rows (id, vec, bucket), one for each table and each code within ``flips`` least certain bits of the vector's own:
    a code has a bit for the side of each of ``bits`` random planes."""
    probes = [np.array(c, np.int64) for n in range(flips + 1) for c in combinations(range(bits), n)]
    power = 1 << np.arange(bits)

    def run(batches):
        for b in batches:
            if b.empty:
                continue
            unit = _unit_rows(np.stack(b["vec"].to_numpy()).astype(np.float64))
            side = unit @ np.random.default_rng(seed).standard_normal((tables * bits, unit.shape[1])).T
            own = ((side > 0).reshape(-1, tables, bits) * power).sum(2)
            names = [[f"{t}:{own[r, t] ^ int(power[p].sum())}" for t in range(tables) for p in probes] for r in range(len(b))]
            yield pd.DataFrame({"id": b["id"], "vec": b["vec"], "buckets": names})
    slim = df.select(F.col(id_col).cast("long").alias("id"), F.col(vec_col).cast("array<double>").alias("vec"))
    return (slim.mapInPandas(run, "id long, vec array<double>, buckets array<string>")
            .select("id", "vec", F.explode("buckets").alias("bucket")))


def topk_lsh(queries: DataFrame, items: DataFrame, k: int = 8, *, q_id: str = "query_id", q_vec: str = "vector",
             i_id: str = "item_id", i_vec: str = "vector", tables: int = 6, bits: int = 5, flips: int = 1, seed: int = 11,
             exclude_self: bool = False, block_rows: int = 4096, item_cols: list[str] | None = None,
             decimals: int | None = None) -> DataFrame:
    """``topk_similar`` by an index of random projections: items lie in one bucket of each of ``tables`` tables, queries
    also look into the buckets within ``flips`` bits of their own, and what they meet is scored exactly. A bucket is
    worked on in cells of bounded size, so a crowded one (copies, one hot code) is neither cut nor one task.

    A neighbour at angle a is met in one table with the chance of at most ``flips`` differences in ``bits`` draws of a / pi,
    so near neighbours are met almost surely and others less often; ``topk_similar`` is the exact way. Vectors of
    nulls or without a direction belong to the callers' filters, as there. Empty tables give an empty result."""
    ship_package(queries.sparkSession)
    qc = _codes(queries, q_id, q_vec, tables, bits, flips, seed)
    ic = _codes(items, i_id, i_vec, tables, bits, 0, seed)
    cand = _cells(qc, ic, k, "id", "vec", "id", "vec", "bucket", "bucket", exclude_self, block_rows, decimals)
    cand = cand.groupBy("query_id", "item_id").agg(F.max("score").alias("score"))  # met in several tables
    return _ranked(cand, items, k, i_id, item_cols)


#: Queries of a search at most; their vectors pass through the driver.
FEW_QUERIES = 1024


def topk_few(queries: DataFrame, items: DataFrame, k: int = 8, *, q_id: str = "query_id", q_vec: str = "vector",
             i_id: str = "item_id", i_vec: str = "vector", q_facet: str | None = None, i_facet: str | None = None,
             exclude_self: bool = False, item_cols: list[str] | None = None, decimals: int | None = None) -> DataFrame:
    """``topk_similar`` for at most ``FEW_QUERIES`` queries (more raise an error)."""
    ship_package(queries.sparkSession)
    facet = q_facet is not None and i_facet is not None
    rows = queries.select(F.col(q_id).cast("long").alias("i"), F.col(q_vec).cast("array<double>").alias("v"),
                          (F.col(q_facet).cast("string") if facet else F.lit(None).cast("string")).alias("f")
                          ).limit(FEW_QUERIES + 1).collect()
    if len(rows) > FEW_QUERIES:
        raise ValueError(f"more than {FEW_QUERIES} queries: use topk_similar")
    schema = "query_id long, item_id long, score double"
    if not rows:
        return queries.sparkSession.createDataFrame([], schema + ", rank int")
    qids, Q = np.array([r["i"] for r in rows]), _unit_rows(np.array([r["v"] for r in rows], np.float64))
    wanted = np.array([r["f"] for r in rows], object)

    def run(batches):
        best = None
        for b in batches:
            if b.empty:
                continue
            S = Q @ _unit_rows(np.stack(b["iv"].to_numpy()).astype(np.float64)).T
            S = S if decimals is None else np.round(S, decimals)
            iids = b["iid"].to_numpy(np.int64)
            if exclude_self:
                S[qids[:, None] == iids[None, :]] = -np.inf
            if facet:
                names, codes = np.unique(b["f"].fillna("").to_numpy(str), return_inverse=True)
                own = np.array([np.flatnonzero(names == w)[0] if w is not None and w in names else -1 for w in wanted])
                S[own[:, None] != np.where(b["f"].isna(), -2, codes)[None, :]] = -np.inf
            top = _top_per_row(S, qids, iids, min(k, S.shape[1]))
            best = top if best is None else pd.concat([best, top])
            best = best.sort_values(["query_id", "score", "item_id"], ascending=[True, False, True]).groupby("query_id").head(k)
        if best is not None:
            yield best

    cand = items.select(F.col(i_id).cast("long").alias("iid"), F.col(i_vec).cast("array<double>").alias("iv"),
                        (F.col(i_facet).cast("string") if facet else F.lit(None).cast("string")).alias("f")
                        ).mapInPandas(run, schema)
    w = Window.partitionBy("query_id").orderBy(F.col("score").desc(), F.col("item_id"))
    top = cand.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= k)
    if item_cols:
        meta = items.select(F.col(i_id).cast("long").alias("item_id"), *item_cols)
        top = top.join(meta, "item_id", "left")
    return top


def rent_limits(items: DataFrame, min_rent: float | None = None, max_rent: float | None = None,
                rent: str = "rent") -> DataFrame:
    """Item filter of the search: None or 0 means no limit (as in the reference)."""
    out = items
    if max_rent:
        out = out.filter(F.col(rent) <= max_rent)
    if min_rent:
        out = out.filter(F.col(rent) >= min_rent)
    return out


VECTOR_META = ["city", "bhk", "size", "bathroom", "furnishing", "rent", "floor_txt", "locality", "tenant",
               "price_per_sqft"]


def listing_vector_table(listings: DataFrame) -> DataFrame:
    """Id + unit vector + metadata (flattened, so metadata filters push down).
    The id is a deterministic hash of the listing key; ``upsert_latest`` keeps one
    row per id."""
    from rentlens.sources.listings import with_listing_id
    df = with_listing_id(listings)
    return add_vectors(df, keep=["listing_id"] + [c for c in VECTOR_META if c in df.columns])


def upsert_latest(table: DataFrame, ts: str, id_col: str = "listing_id") -> DataFrame:
    """Upsert semantics over an append log: the newest row per id wins. A
    ``max_by`` aggregate (partially aggregated before the shuffle), so an id with
    very many versions costs one partial row per task, not one sorted partition."""
    others = [c for c in table.columns if c != id_col]
    latest = table.groupBy(id_col).agg(F.max_by(F.struct(*others), F.col(ts)).alias("_row"))
    return latest.select(id_col, *[F.col("_row")[c].alias(c) for c in others])


def find_similar(queries: DataFrame, vector_table: DataFrame, k: int = 8, same_city: bool = False,
                 min_rent: float | None = None, max_rent: float | None = None) -> DataFrame:
    """K1/J5 over listings, the search form: ``queries`` are at most ``FEW_QUERIES`` listing-shaped rows with a
    ``query_id``; their vectors are built like the items'."""
    qv = add_vectors(queries, keep=["query_id", "city"])
    items = rent_limits(vector_table, min_rent, max_rent)
    return topk_few(qv, items, k, q_id="query_id", q_vec="vector", i_id="listing_id", i_vec="vector",
                    q_facet="city" if same_city else None, i_facet="city" if same_city else None,
                    item_cols=[c for c in VECTOR_META if c in items.columns])
