"""Alignment of two tokenizers' tokens by the bytes they cover.

A text's tokens by tokenizer A (a byte-level BPE file) and B (a SentencePiece model) both cover a space and the
text, so the byte offsets where tokens end are two rising sequences. The texts of a batch are put one after
another, which makes two long sequences, merged by merge path: the merge is cut into pieces of ``PIECE`` steps by
binary searches along the diagonals of its grid, all at once; pieces then advance together, one step of each at
a time, whatever text they lie in. Each step that reaches a new offset emits the one pair of tokens that overlap
in the stretch before it; a step at an offset where the other tokenizer's token has just ended closes a group.
Pieces number the groups they close from 0, and a prefix sum over the pieces stitches these numbers together.

Texts are encoded once. Per document, the different linked pairs of ids and how often each occurs are kept in a
table; Spark counts the documents of each pair. The counts come back to the documents in blocks of whole A ids
with at most ``BLOCK_PAIRS`` pairs (and one id's more), each sent to the tasks: one block as a rule, more are
added up by document.
"""

from __future__ import annotations

import hashlib
import json
import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rentlens.llm.common import ids_like, saved, workers
from rentlens.llm.tokens import runs

PIECE = 64
#: Pairs with counts that are sent to the tasks at once; characters encoded together.
BLOCK_PAIRS, RUN_CHARS = 1 << 21, 1 << 21
END = np.iinfo(np.int64).max
#: Letters and marks that were assigned long ago, so that all libraries' tables of characters agree on them.
SETTLED = re.compile("[\t-\r\x20-ɏΑ-ΡΣ-ωА-я‐-‧‰-⁞ぁ-ゔァ-ヺ一-龥가-힣]*")
#: How byte-level BPE files of this kind cut a text before merging (fixed by the tokenizer).
CUT = r"""'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""


def byte_signs() -> dict[str, int]:
    """The characters that byte-level BPE files write bytes as."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    other = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(other)}


class ByteBpe:
    """Tokenizer A: ids by the library, or by tiktoken with the file's own vocabulary where that is the same."""

    def __init__(self, content: str):
        import os
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer
        self.library = Tokenizer.from_str(content)
        self.library.encode_special_tokens = True
        vocab = {t: i for t, i in self.library.get_vocab(with_added_tokens=True).items()}
        sign = byte_signs()
        self.bytes = [b""] * (max(vocab.values(), default=-1) + 1)
        for t, i in vocab.items():
            self.bytes[i] = bytes(sign[c] for c in t) if all(c in sign for c in t) else t.encode()
        self.fast = self._fast(json.loads(content))

    def _fast(self, file: dict):
        model, cut = file["model"], file.get("pre_tokenizer") or {}
        merges = [m.split(" ") if isinstance(m, str) else m for m in model.get("merges", [])]
        ids = [model["vocab"].get(a + b, -1) for a, b in merges]
        same = (cut.get("type") == "ByteLevel" and not cut.get("add_prefix_space") and cut.get("use_regex", True)
                and not file.get("normalizer") and ids and ids == sorted(ids) and ids[0] == 256 and not model.get("ignore_merges")
                and len(set(model["vocab"].values())) == len(model["vocab"]) == 256 + len(ids) + sum(
                    a["special"] for a in file.get("added_tokens", []) if a["content"] in model["vocab"]))
        if not same:
            return None
        import tiktoken
        special = {a["content"] for a in file.get("added_tokens", [])}
        ranks = {self.bytes[i]: i for t, i in model["vocab"].items() if t not in special}
        return tiktoken.Encoding("file", pat_str=CUT, mergeable_ranks=ranks, special_tokens={})

    def encode(self, texts: list[str]) -> list[np.ndarray]:
        out: list = [None] * len(texts)
        slow = []
        for i, t in enumerate(texts):
            if self.fast and SETTLED.fullmatch(t):
                out[i] = np.array(self.fast.encode_ordinary(t), np.int64)
            else:
                slow.append(i)
        for i, e in zip(slow, self.library.encode_batch_fast([texts[i] for i in slow], add_special_tokens=False)):
            out[i] = np.array(e.ids, np.int64)
        return out


class PieceBpe:
    """Tokenizer B: the library's ids; U+2581 stands for a space, <0xHH> for a byte."""

    def __init__(self, model: bytes):
        from sentencepiece import SentencePieceProcessor
        self.sp = SentencePieceProcessor(model_proto=model)
        n = self.sp.get_piece_size()
        text = [self.sp.id_to_piece(i) for i in range(n)]
        self.bytes = [bytes([int(t[3:5], 16)]) if self.sp.is_byte(i) else t.replace("▁", " ").encode() for i, t in enumerate(text)]

    def encode(self, texts: list[str]) -> list[np.ndarray]:
        return [np.array(x, np.int64) for x in self.sp.encode(texts, num_threads=1)] if texts else []


def merge_path(a: np.ndarray, b: np.ndarray, piece: int = PIECE) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Merges two rising sequences of ends with a common last one (equal ends: A's first). Returns the links (places in a
    and b) in order, and for each end in a and in b the number of its group."""
    na, nb = len(a), len(b)
    steps = na + nb
    ea, eb = np.append(a, END), np.append(b, END)
    starts = np.arange(0, steps, piece)
    low, high = np.maximum(0, starts - nb), np.minimum(starts, na)
    while (low < high).any():  # how many of the first steps are A's: all diagonals at once
        mid = (low + high) // 2
        more = (ea[mid] <= eb[np.maximum(starts - 1 - mid, 0)]) & (low < high)
        low, high = np.where(more, mid + 1, low), np.where(more, high, np.minimum(mid, high))
    i, j = low, starts - low
    lanes = len(starts)
    at_a, at_b = np.empty((lanes, piece), np.int64), np.empty((lanes, piece), np.int64)
    is_a, link = np.empty((lanes, piece), bool), np.empty((lanes, piece), bool)
    for s in range(piece):  # a step of every piece
        one = ea[i] <= eb[j]
        tie = ~one & (i > 0) & (ea[i - 1] == eb[j])
        at_a[:, s], at_b[:, s], is_a[:, s], link[:, s] = i, j, one, ~tie
        i, j = np.minimum(i + one, na), np.minimum(j + ~one, nb)
    past = (np.arange(piece) + starts[:, None]) >= steps
    link[past] = False
    closes = ~link & ~past
    own = np.cumsum(closes, 1) - closes  # groups a piece has closed before each step
    before = np.cumsum(own[:, -1] + closes[:, -1]) - (own[:, -1] + closes[:, -1])
    number = (own + before[:, None])[~past]
    at_a, at_b, is_a, link = at_a[~past], at_b[~past], is_a[~past], link[~past]
    group_a, group_b = np.empty(na, np.int64), np.empty(nb, np.int64)
    group_a[at_a[is_a]], group_b[at_b[~is_a]] = number[is_a], number[~is_a]
    return at_a[link], at_b[link], group_a, group_b


def _ends(ids: list[np.ndarray], size: np.ndarray, base: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """All texts' ids one after another, where each token ends, and each token's text."""
    count = [len(x) for x in ids]
    flat = np.concatenate(ids) if ids else np.zeros(0, np.int64)
    of = np.repeat(np.arange(len(ids)), count)
    ends = np.cumsum(size[flat])
    first = np.r_[0, np.cumsum(count)][:-1]
    before = np.r_[0, ends][first]
    return flat, ends - before[of] + base[of], of


class Aligner:
    """One worker's tokenizers and tables."""

    def __init__(self, a: str, b: bytes):
        self.a, self.b = ByteBpe(a), PieceBpe(b)
        self.size_a, self.size_b = (np.array([len(x) for x in t.bytes], np.int64) for t in (self.a, self.b))
        n = len(self.a.bytes)
        self.written = [b"%d," % i for i in range(n)] + [b"%d|" % i for i in range(n)]
        m = len(self.b.bytes)
        self.written += [b"%d," % i for i in range(m)] + [b"%d;" % i for i in range(m)]

    def pair(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        return a * len(self.b.bytes) + b

    def align(self, texts: list[str | None]) -> dict[str, list]:
        """For each text n_a, n_b, n_groups, n_links, groups_sha256, its different pairs and how often each occurs."""
        n = len(texts)
        out = {k: np.zeros(n, np.int64) for k in ("n_a", "n_b", "n_groups", "n_links")}
        raw = [(" " + t).encode("utf-8", "surrogatepass") if t else b"" for t in texts]
        some = [i for i in range(n) if raw[i]]
        ids_a = self.a.encode([" " + texts[i] for i in some])
        ids_b = self.b.encode([texts[i] for i in some])
        get_a, get_b = self.a.bytes.__getitem__, self.b.bytes.__getitem__
        keep = [x for x in range(len(some)) if b"".join(map(get_a, ids_a[x].tolist())) == raw[some[x]]
                and b"".join(map(get_b, ids_b[x].tolist())) == raw[some[x]]]
        own, ids_a, ids_b = np.array([some[x] for x in keep], np.int64), [ids_a[x] for x in keep], [ids_b[x] for x in keep]
        sha, pairs, times = [""] * n, [np.zeros(0, np.int64)] * n, [np.zeros(0, np.int64)] * n
        if len(own):
            length = np.array([len(raw[i]) for i in own], np.int64)
            base = np.cumsum(length) - length
            flat_a, end_a, of_a = _ends(ids_a, self.size_a, base)
            flat_b, end_b, of_b = _ends(ids_b, self.size_b, base)
            link_a, link_b, group_a, group_b = merge_path(end_a, end_b)
            groups = int(group_a[-1]) + 1
            k = len(own)
            group_of = np.zeros(groups, np.int64)
            group_of[group_a] = of_a
            out["n_a"][own], out["n_b"][own] = np.bincount(of_a, minlength=k), np.bincount(of_b, minlength=k)
            out["n_groups"][own] = np.bincount(group_of, minlength=k)
            out["n_links"][own] = np.bincount(of_a[link_a], minlength=k)
            sha_of = self._written(flat_a, flat_b, group_a, group_b, of_a, of_b, k)
            wide = len(self.a.bytes) * len(self.b.bytes)
            key = np.sort(of_a[link_a] * wide + self.pair(flat_a[link_a], flat_b[link_b]))
            first = np.flatnonzero(np.r_[True, key[1:] != key[:-1]])
            count, (doc, pair) = np.diff(np.r_[first, len(key)]), np.divmod(key[first], wide)
            cut = np.searchsorted(doc, np.arange(k + 1)).tolist()
            for x, i in enumerate(own.tolist()):
                sha[i], pairs[i], times[i] = sha_of[x], pair[cut[x]:cut[x + 1]], count[cut[x]:cut[x + 1]]
        return {**out, "groups_sha256": sha, "pairs": pairs, "times": times}

    def _written(self, flat_a, flat_b, group_a, group_b, of_a, of_b, k: int) -> list[str]:
        """The hash of each text's groups as text: a token's number with the mark after it, in the order of groups."""
        last_a, last_b = np.r_[group_a[1:] != group_a[:-1], True], np.r_[group_b[1:] != group_b[:-1], True]
        n, m = len(self.a.bytes), len(self.b.bytes)
        code = np.empty(len(flat_a) + len(flat_b), np.int64)
        # before an A token stand the B tokens of the groups before its own, before a B token the A tokens up to its own
        code[np.arange(len(flat_a)) + np.searchsorted(group_b, group_a, "left")] = flat_a + n * last_a
        code[np.arange(len(flat_b)) + np.searchsorted(group_a, group_b, "right")] = flat_b + 2 * n + m * last_b
        cut = np.cumsum(np.bincount(of_a, minlength=k) + np.bincount(of_b, minlength=k))
        get, out, start, codes = self.written.__getitem__, [], 0, code.tolist()
        for end in cut.tolist():
            out.append(hashlib.sha256(b"".join(map(get, codes[start:end]))[:-1]).hexdigest())
            start = end
        return out


_aligners: dict[int, Aligner] = {}


def aligner(shipped) -> Aligner:
    """This worker's aligner, made once."""
    key = id(shipped.value)
    if key not in _aligners:
        _aligners.clear()
        _aligners[key] = Aligner(*shipped.value)
    return _aligners[key]


def shipped(spark: SparkSession, a_path: str, b_path: str):
    """Both tokenizer files, for the workers (their size is that of two vocabularies)."""
    with open(a_path, encoding="utf-8") as a, open(b_path, "rb") as b:
        return spark.sparkContext.broadcast((a.read(), b.read()))


def _lists(rows: list[np.ndarray]) -> pa.Array:
    offs = np.r_[0, np.cumsum([len(r) for r in rows])]
    return pa.ListArray.from_arrays(pa.array(offs, pa.int32()), pa.array(np.concatenate(rows).astype(np.int32) if rows else [], pa.int32()))


NUMBERS = ("n_a", "n_b", "n_groups", "n_links")


def _align_rows(files):
    def run(batches):
        own = aligner(files)
        for batch in batches:
            texts = batch.column("text").to_pylist()
            for first, last in runs([t or "" for t in texts], RUN_CHARS):
                got = own.align(texts[first:last])
                yield pa.RecordBatch.from_arrays(
                    [batch.column("id").slice(first, last - first), *[pa.array(got[c]) for c in NUMBERS],
                     pa.array(got["groups_sha256"], pa.string()), _lists(got["pairs"]), _lists(got["times"])],
                    ["id", *NUMBERS, "groups_sha256", "pairs", "times"])
    return run


def alignments(docs: DataFrame, files, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of ``docs``: id, n_a, n_b, n_groups, n_links, groups_sha256, pairs (different linked ids, as
    A id x number of B ids + B id), times (occurrences of each). Vocabularies' sizes must have a product below 2^31."""
    slim = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
    return workers(slim).mapInArrow(_align_rows(files), f"id {ids_like(slim, 'id')}, " + ", ".join(f"{c} long" for c in NUMBERS)
                                    + ", groups_sha256 string, pairs array<int>, times array<int>")


def _sum_rows(block):
    def run(batches):
        pair, count, best = block.value
        for batch in batches:
            pairs, times = batch.column("pairs"), batch.column("times")
            offs = pairs.offsets.to_numpy().astype(np.int64)
            code = pairs.values.to_numpy()[offs[0]:offs[-1]]
            often = times.flatten().to_numpy().astype(np.int64)
            at = np.minimum(np.searchsorted(pair, code), max(0, len(pair) - 1))
            hit = pair[at] == code if len(pair) else np.zeros(len(code), bool)
            sums = [np.r_[0, np.cumsum(np.where(hit, often * x[at], 0))] if len(pair) else np.zeros(len(code) + 1, np.int64) for x in (best, count)]
            yield pa.RecordBatch.from_arrays([batch.column("row"), *[pa.array((s[offs[1:] - offs[0]] - s[offs[:-1] - offs[0]])) for s in sums]],
                                             ["row", "n_best", "count_sum"])
    return run


def pair_blocks(counts: DataFrame, wide: int, most: int = BLOCK_PAIRS):
    """The counted pairs in blocks of whole A ids: sorted pairs, counts, whether a pair is the highest of its A id."""
    a = F.expr(f"pair div {wide}")
    per_id = sorted(map(tuple, counts.groupBy(a.alias("a")).count().collect()))  # a row per id of a vocabulary
    first, size = None, 0
    for k, (i, n) in enumerate(per_id):
        first = i if first is None else first
        size += n
        if size >= most or k == len(per_id) - 1:
            rows = counts.filter(a.between(first, i)).toArrow()
            pair, count = (rows.column(c).combine_chunks().to_numpy().astype(np.int64) for c in ("pair", "n"))
            order = np.argsort(pair)
            pair, count = pair[order], count[order]
            ids = pair // wide
            start = np.flatnonzero(np.r_[True, ids[1:] != ids[:-1]])
            top = np.repeat(np.maximum.reduceat(count, start), np.diff(np.r_[start, len(ids)]))
            yield pair, count, (count == top).astype(np.int64)
            first, size = None, 0


def aligned(docs: DataFrame, a_path: str, b_path: str, id_col: str = "doc_id", text_col: str = "text",
            block_pairs: int = BLOCK_PAIRS) -> DataFrame:
    """One row per row of ``docs``: ``id_col``, n_a, n_b, n_groups, n_links, n_best (links whose pair is in as many
    documents as any pair of its A id), count_sum (documents of each link's pair, added up), groups_sha256. Null and
    empty texts, and texts that a tokenizer does not give back byte by byte, have zeros and an empty groups_sha256.
    Repeated rows count as documents of their own. An empty table gives an empty result; other columns are ignored."""
    spark = docs.sparkSession
    files = shipped(spark, a_path, b_path)
    rows = saved(alignments(docs, files, id_col, text_col).withColumn("row", F.monotonically_increasing_id()))
    counts = saved(rows.select(F.explode("pairs").alias("pair")).groupBy("pair").agg(F.count("pair").alias("n")))
    wide = len(PieceBpe(files.value[1]).bytes)
    blocks = [spark.sparkContext.broadcast(b) for b in pair_blocks(counts, wide, block_pairs)]
    if not blocks:
        sums = rows.select("row", F.lit(0).cast("long").alias("n_best"), F.lit(0).cast("long").alias("count_sum"))
        return _with_sums(rows, sums, id_col)
    if len(blocks) == 1:  # sums go straight with their rows
        carried = ["id", *NUMBERS, "groups_sha256"]
        schema = f"id {ids_like(rows, 'id')}, " + ", ".join(f"{c} long" for c in NUMBERS) + ", groups_sha256 string, n_best long, count_sum long"

        def both(batches, one=_sum_rows(blocks[0])):
            for batch in batches:
                sums = next(iter(one([batch])))
                yield pa.RecordBatch.from_arrays([*[batch.column(c) for c in carried], sums.column("n_best"), sums.column("count_sum")],
                                                 [*carried, "n_best", "count_sum"])
        out = workers(rows).mapInArrow(both, schema)
        return out.select(F.col("id").alias(id_col), *NUMBERS, "n_best", "count_sum", "groups_sha256")
    parts = None
    for b in blocks:
        own = workers(rows).select("row", "pairs", "times").mapInArrow(_sum_rows(b), "row long, n_best long, count_sum long")
        parts = own if parts is None else parts.unionByName(own)
    return _with_sums(rows, parts.groupBy("row").agg(F.sum("n_best").alias("n_best"), F.sum("count_sum").alias("count_sum")), id_col)


def _with_sums(rows: DataFrame, sums: DataFrame, id_col: str) -> DataFrame:
    return rows.join(sums, "row").select(F.col("id").alias(id_col), *NUMBERS, "n_best", "count_sum", "groups_sha256")
