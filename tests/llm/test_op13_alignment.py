import hashlib
import random

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F

from rentlens.llm import alignment, queries

A, B = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")
ODD = ["", None, "a", " ", "  \n\t x", "Hello, world! It's <|endoftext|> and </s> <s> <unk> here", "日本語のテキスト 한국어 ไทย 🙂👍🏽 \U0001fae8", "é é ﬁ ½ ²",
       "a▁b", "x\x00y", "    ﻿", "aaaa" * 900, "1234567890 " * 40, "don't we'll I've’s", "\r\n\r\n  end  ", "ß" * 77, "don'T"]


def plain(texts):
    """All numbers by plain loops over the libraries' tokens."""
    import sentencepiece
    from tokenizers import Tokenizer
    t = Tokenizer.from_file(A)
    t.encode_special_tokens = True
    sp = sentencepiece.SentencePieceProcessor(model_file=B)
    sign = alignment.byte_signs()
    docs, holds = [], {}
    for n, text in enumerate(texts):
        raw = (" " + (text or "")).encode()
        a = t.encode(" " + text, add_special_tokens=False).ids if text else []
        b = sp.encode(text) if text else []
        bytes_a = [bytes(sign[c] for c in t.id_to_token(i)) for i in a]
        bytes_b = [bytes([int(p[3:5], 16)]) if sp.is_byte(i) else p.replace("▁", " ").encode() for i in b for p in [sp.id_to_piece(i)]]
        if not text or b"".join(bytes_a) != raw or b"".join(bytes_b) != raw:
            docs.append(([], [], [], ""))
            continue
        span_a, span_b = [], []
        for parts, spans in ((bytes_a, span_a), (bytes_b, span_b)):
            at = 0
            for p in parts:
                spans.append((at, at + len(p)))
                at += len(p)
        ends = sorted({e for _, e in span_a} & {e for _, e in span_b})
        groups, start = [], 0
        for e in ends:
            groups.append("|".join(",".join(str(i) for i, (s, f) in zip(ids, spans) if start <= s and f <= e)
                                   for ids, spans in ((a, span_a), (b, span_b))))
            start = e
        links, j0 = [], 0
        for i, (s, e) in zip(a, span_a):
            while span_b[j0][1] <= s:
                j0 += 1
            j = j0
            while j < len(b) and span_b[j][0] < e:
                links.append((i, b[j]))
                j += 1
        for p in set(links):
            holds.setdefault(p, set()).add(n)
        docs.append((a, b, links, ";".join(groups)))
    best = {}
    for (i, _), of in holds.items():
        best[i] = max(best.get(i, 0), len(of))
    return [(len(a), len(b), groups.count(";") + 1 if groups else 0, len(links), sum(len(holds[p]) == best[p[0]] for p in links),
             sum(len(holds[p]) for p in links), hashlib.sha256(groups.encode()).hexdigest() if groups else "")
            for a, b, links, groups in docs]


COLUMNS = ["n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"]


@pytest.mark.parametrize("block_pairs", [alignment.BLOCK_PAIRS, 50])
def test_odd_texts_against_plain_loops(spark, block_pairs):
    texts = ODD + ODD[:8] + ["Hello, world! It's here"] * 5
    df = spark.createDataFrame([(i, t, "x") for i, t in enumerate(texts)], "doc_id long, text string, pairs string").repartition(4)
    got = {r.doc_id: r for r in alignment.aligned(df, A, B, block_pairs=block_pairs).collect()}
    for i, want in enumerate(plain(texts)):
        assert tuple(got[i][c] for c in COLUMNS) == want, (i, texts[i])
    assert sum(w[0] > 0 for w in plain(texts)) > 15


def test_query_against_plain_loops(spark):
    sf = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()
    got = {r.doc_id: r for r in queries.QUERIES["op13_alignment"](spark, sf).collect()}
    assert len(got) == len(docs)
    for r, want in zip(docs, plain([r.text for r in docs])):
        assert tuple(got[r.doc_id][c] for c in COLUMNS) == want


def test_merge_path_against_a_plain_merge():
    rng = random.Random(5)
    for trial in range(200):
        end = rng.randint(1, 400)
        a = sorted(rng.sample(range(1, end + 1), rng.randint(1, end)) if end > 1 else [1])
        b = sorted(rng.sample(range(1, end + 1), rng.randint(1, end)) if end > 1 else [1])
        a, b = [x for x in a if x != end] + [end], [x for x in b if x != end] + [end]
        la, lb, ga, gb = alignment.merge_path(np.array(a), np.array(b), rng.choice([1, 2, 3, 7, 64]))
        spans = [list(zip([0, *x], x)) for x in (a, b)]
        want = [(i, j) for i, (s, e) in enumerate(spans[0]) for j, (u, v) in enumerate(spans[1]) if s < v and u < e]
        assert sorted(zip(la.tolist(), lb.tolist())) == want
        common = sorted(set(a) & set(b))
        assert ga.tolist() == [sum(c < x for c in common) for x in a] and gb.tolist() == [sum(c < x for c in common) for x in b]


def test_fast_ids_are_the_librarys():
    one = alignment.ByteBpe(open(A, encoding="utf-8").read())
    assert one.fast is not None
    rng = random.Random(2)
    signs = "ab Z9'sdmtlvre.,!\n\t\r\x0b\x0c éßÀ ¼²ªº×÷ΩжЯ漢字ひカ한—’…​"
    texts = ["".join(rng.choices(signs, k=rng.randint(1, 40))) for _ in range(4000)]
    fast = one.encode(texts)
    one.fast = None
    for t, x, y in zip(texts, fast, one.encode(texts)):
        assert x.tolist() == y.tolist(), t


def test_long_texts_and_odd_tables(spark, edge, clashing, empty):
    long = [(1, "x" * 200_000), (2, "word " * 100_000), (3, "é漢 " * 50_000)]
    got = {r.doc_id: r for r in alignment.aligned(spark.createDataFrame(long, "doc_id long, text string"), A, B).collect()}
    assert all(got[i].n_a > 0 and got[i].n_links >= got[i].n_groups for i in (1, 2, 3))
    a, b = (sorted(map(str, alignment.aligned(d, A, B).collect())) for d in (edge, clashing.withColumns({"pairs": F.lit(1), "n_a": F.lit(2)})))
    assert a == b and len(a) == 11
    assert alignment.aligned(empty, A, B).count() == 0
    assert alignment.aligned(edge.filter("text is null"), A, B).select("n_best", "groups_sha256").collect() == [(0, "")]
