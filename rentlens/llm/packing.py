"""Best-fit packing of token sequences in a tree of partitions.

Items are dealt to nodes of bounded size. Each node packs its items best-fit, longest first; sequences
that are nearly full are done, and the others go up as items to the next level, where ``fan_in`` nodes
meet and pack again, until one node is left. After a pass at most one sequence of a node is half empty
(two would have been joined), so what goes up is little; should more than ``carry`` sequences of a node be
left over, the fullest beyond that number are done as they are. No row is ever left out.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rentlens.llm import tokens
from rentlens.llm.common import ids_like, saved, workers

NODE_ITEMS, FAN_IN, CARRY = 65_536, 8, 2048


def _pieces(content, capacity: int, end_id: int, with_ids: bool, kept_words: int):
    end = end_id.to_bytes(4, "little")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = tokens.encoder(content, special=True, kept=kept_words)
        for batch in batches:
            texts = [t or "" for t in batch.column(1).to_pylist()]
            for first, last in tokens.runs(texts):
                row, piece, start, length, crc, ids = [], [], [], [], [], []
                for i, raw in enumerate(encoder.encode(texts[first:last])):
                    raw += end
                    for k, at in enumerate(range(0, len(raw), 4 * capacity)):
                        part = raw[at:at + 4 * capacity]
                        row.append(first + i)
                        piece.append(k)
                        start.append(at // 4)
                        length.append(len(part) // 4)
                        crc.append(zlib.crc32(part))
                        ids.append(part if with_ids else None)
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).take(pa.array(row, pa.int64())), pa.array(piece, pa.int32()),
                     *(pa.array(x, pa.int64()) for x in (start, length, crc)), pa.array(ids, pa.binary())],
                    ["id", "piece", "start", "length", "ids_crc32", "ids"])
    return run


def token_pieces(docs: DataFrame, tokenizer_path: str, capacity: int, end_id: int, id_col: str = "doc_id",
                 text_col: str = "text", with_ids: bool = False, kept_words: int = tokens.KEPT_WORDS) -> DataFrame:
    """Each text's ids and ``end_id`` after them, cut into pieces of ``capacity`` where it is longer: id, piece,
    start, length, ids_crc32, ids (little-endian unsigned 32-bit; null unless ``with_ids``). Null is empty. Strings of
    special tokens in a text give these tokens' ids, as the tokenizers library does by default."""
    slim = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
    content = tokens.shipped(docs.sparkSession, tokenizer_path)
    return workers(slim).mapInArrow(
        _pieces(content, capacity, end_id, with_ids, kept_words), f"id {ids_like(slim, 'id')}, piece int, start long, length long, ids_crc32 long, ids binary")


def best_fit(fills: list[int], capacity: int) -> tuple[list[int], list[int], list[int]]:
    """Best-fit for items in the given order: each item's bin (the number of its first item), its place in it,
    and the bins' fills by that number. Free rooms are bits of one number; the least that fits is its lowest bit."""
    rooms: list[list[int]] = [[] for _ in range(capacity + 1)]
    free, to, at, fill = 0, [], [], [0] * len(fills)
    for i, size in enumerate(fills):
        fits = free >> size
        if fits:
            room = size + (fits & -fits).bit_length() - 1
            b = rooms[room].pop()
            if not rooms[room]:
                free ^= 1 << room
        else:
            room, b = capacity, i
        to.append(b)
        at.append(capacity - room)
        fill[b] = capacity - room + size
        if left := room - size:
            rooms[left].append(b)
            free |= 1 << left
    return to, at, fill


def _level(capacity: int, nearly: int, carry: int, last: bool):
    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        bins = pdf.drop_duplicates("seq").sort_values(["fill", "seq"], ascending=[False, True])
        to, at, fill = best_fit(bins["fill"].tolist(), capacity)
        names = bins["seq"].to_numpy()
        where = pd.Series(np.arange(len(names)), index=names)
        k = where.loc[pdf["seq"]].to_numpy()
        to, at, fill = np.array(to), np.array(at), np.array(fill)
        done = fill >= nearly
        left = np.flatnonzero((fill > 0) & ~done)
        if last:
            done[:] = True
        elif len(left) > carry:
            done[left[np.argsort(-fill[left], kind="stable")][:len(left) - carry]] = True
        return pd.DataFrame({"node": pdf["node"], "rid": pdf["rid"], "seq": names[to[k]], "off": pdf["off"] + at[k],
                             "fill": fill[to[k]], "done": done[to[k]]})
    return run


def packed(items: DataFrame, capacity: int, node_items: int = NODE_ITEMS, fan_in: int = FAN_IN,
           carry: int = CARRY) -> DataFrame:
    """Items (rid long and unique, length from 1 to ``capacity``) in sequences: rid, seq, off."""
    if capacity < 1 or fan_in < 2:
        raise ValueError("capacity and fan_in")
    full = items.filter(F.col("length") == capacity).select("rid", F.col("rid").alias("seq"), F.lit(0).cast("long").alias("off"))
    rest = items.filter(F.col("length") < capacity)
    nodes = max(1, -(-rest.count() // node_items))
    state = rest.select(F.expr(f"pmod(xxhash64(rid), {nodes})").alias("node"), "rid", F.col("rid").alias("seq"),
                        F.lit(0).cast("long").alias("off"), F.col("length").alias("fill"))
    schema, nearly, done = "node long, rid long, seq long, off long, fill long, done boolean", capacity - capacity // 128, [full]
    while True:
        state = saved(state.groupBy("node").applyInPandas(_level(capacity, nearly, carry, nodes == 1), schema))
        done.append(state.filter("done").select("rid", "seq", "off"))
        if nodes == 1:
            return reduce(DataFrame.unionByName, done)
        nodes = -(-nodes // fan_in)
        state = state.filter(~F.col("done")).withColumn("node", F.expr(f"node div {fan_in}")).drop("done")


def packed_documents(docs: DataFrame, tokenizer_path: str, capacity: int = 4096, end_id: int = 1, id_col: str = "doc_id",
                     text_col: str = "text", with_ids: bool = False, node_items: int = NODE_ITEMS,
                     kept_words: int = tokens.KEPT_WORDS) -> DataFrame:
    """One row per piece: ``id_col``, piece, start, length, ids_crc32, sequence_id, offset (and ids).

    Each row of ``docs`` is a document of its own, also where ids repeat or are null. A null or empty text
    is its end id alone. An empty table gives an empty result; other columns are ignored. ``kept_words``: words whose
    ids a worker keeps, also for later jobs (some 150 bytes each).
    """
    pieces = saved(token_pieces(docs, tokenizer_path, capacity, end_id, id_col, text_col, with_ids, kept_words)
                   .withColumn("rid", F.monotonically_increasing_id()))
    out = pieces.join(packed(pieces.select("rid", "length"), capacity, node_items), "rid")
    return out.select(F.col("id").alias(id_col), "piece", "start", "length", "ids_crc32",
                      F.col("seq").alias("sequence_id"), F.col("off").alias("offset"), *["ids"] * with_ids)


def sequences(placed: DataFrame) -> DataFrame:
    """The packed sequences themselves (from rows with ids): sequence_id, n_tokens, ids, ends (where pieces end)."""
    parts = F.sort_array(F.collect_list(F.struct("offset", "length", "ids")))  # at most ``capacity`` pieces
    return placed.groupBy("sequence_id").agg(F.sum("length").alias("n_tokens"), parts.alias("p")).select(
        "sequence_id", "n_tokens", F.expr("aggregate(p.ids, cast('' as binary), (a, b) -> a || b)").alias("ids"),
        F.expr("transform(p, x -> x.offset + x.length)").alias("ends"))


def density(placed: DataFrame, capacity: int) -> DataFrame:
    """How full the sequences are: sequences, tokens, least (sequences that any packing needs)."""
    return placed.agg(F.countDistinct("sequence_id").alias("sequences"), F.sum("length").alias("tokens")).withColumn(
        "least", F.ceil(F.col("tokens") / capacity))
