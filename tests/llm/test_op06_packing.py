import zlib

import numpy as np
import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from rentlens.llm import packing, queries, tokens

PATH = public_tokenizers.path("word_bpe_49k.json")


def sound(p, capacity):
    for _, own in p.sort_values("offset").groupby("sequence_id"):
        assert own.offset.tolist() == np.r_[0, own.length.cumsum()[:-1]].tolist()
        assert own.length.sum() <= capacity


def test_query(spark, sf_small):
    p = queries.QUERIES["op6_packed"](spark, sf_small).toPandas()
    sound(p, 4096)
    docs = {r.doc_id: r.text for r in spark.read.parquet(f"{sf_small}/documents.parquet").collect()}
    tok = Tokenizer.from_file(PATH)
    for i, own in p.sort_values("piece").groupby("doc_id"):
        ids = tok.encode(docs.pop(i), add_special_tokens=False).ids + [1]
        assert own.piece.tolist() == list(range(-(-len(ids) // 4096)))
        for r in own.itertuples():
            part = ids[r.start:r.start + r.length]
            assert r.start == 4096 * r.piece and r.length == min(4096, len(ids) - r.start)
            assert r.ids_crc32 == zlib.crc32(np.array(part, "<u4").tobytes())
    assert not docs
    assert p.sequence_id.nunique() <= -(-p.length.sum() // 4096) + 2


@pytest.mark.parametrize("short_way", [True, False])
def test_words_give_the_ids_of_whole_texts(spark, sf_small, short_way):
    tok = Tokenizer.from_file(PATH)
    tok.encode_special_tokens = True
    with open(PATH, encoding="utf-8") as f:
        enc = tokens.WordEncoder(f.read())
    assert enc.merges is not None
    if not short_way:
        enc.merges = None
    texts = [r.text for r in spark.read.parquet(f"{sf_small}/documents.parquet").collect()] + [
        "", " ", "a\x1cb\x85c d", "It's  the dog's. dogs'. don't! x's, 's. s. i'll; we'd: o'clock.", "x\u0000y \ufeff",
        "ÉCLAIR é ΣΑΣ ß 漢字😀 <|endoftext|> 12345 don't", "é. É wait... what?! ok,, no.. 'tis. it.'s A.B. ª º. ǅ ǆ. ʰ. ½.",
        "naïve. ĳ ﬁ. Ω Å K. hello.\x0bworld\x0c! ﷺ.", "İstanbul KK", "ǉ ß. ẞ. ﬀ. ա. ა Ა. ꭰ Ꭰ. ᾳ ᾼ.", "e\u0301 E\u0301. I\u0307"]
    for t, raw in zip(texts, enc.encode(texts)):
        assert np.frombuffer(raw, "<u4").tolist() == tok.encode(t, add_special_tokens=False).ids, t[:80]


@settings(deadline=None, max_examples=60)
@given(st.lists(st.integers(1, 50), max_size=80))
def test_best_fit_against_a_plain_search(sizes):
    sizes.sort(reverse=True)
    to, at, fill = packing.best_fit(sizes, 50)
    bins: dict[int, int] = {}
    for i, s in enumerate(sizes):
        fits = [b for b in bins if bins[b] + s <= 50]
        room = min((50 - bins[b] for b in fits), default=None)
        if room is None:
            assert to[i] == i and at[i] == 0
        else:
            assert 50 - bins[to[i]] == room and at[i] == bins[to[i]]
        bins[to[i]] = bins.get(to[i], 0) + s
    assert {b: f for b, f in enumerate(fill) if f} == bins


@pytest.mark.parametrize("low,high,carry", [(1, 400, 2048), (600, 1000, 5), (300, 700, 2048), (1000, 1000, 1)])
def test_tree_of_many_nodes(spark, low, high, carry):
    rng = np.random.default_rng(4)
    sizes = rng.integers(low, high + 1, 3000).tolist()
    items = spark.createDataFrame([(i, s) for i, s in enumerate(sizes)], "rid long, length long")
    p = packing.packed(items, 1000, node_items=100, fan_in=3, carry=carry).toPandas()
    p = p.rename(columns={"seq": "sequence_id", "off": "offset"})
    p["length"] = [sizes[i] for i in p.rid]
    assert sorted(p.rid) == list(range(3000))
    sound(p, 1000)
    one = packing.best_fit(sorted(sizes, reverse=True), 1000)[2]
    assert p.sequence_id.nunique() <= sum(f > 0 for f in one) * 1.06 + 1  # nodes of 100 items; sequences stay whole on their way up


def test_edges_and_sequences(spark, edge, clashing, empty):
    for docs in (edge, clashing):
        p = packing.packed_documents(docs, PATH, 64, node_items=4, with_ids=True).toPandas()
        sound(p, 64)
        assert p[(p.doc_id == 3) | (p.doc_id == 4)].length.tolist() == [1, 1]
        assert p[p.doc_id == 2].piece.tolist() == [0, 0] and p.doc_id.isna().any()
        assert p[p.doc_id == 6].length.sum() == 60_001
    assert packing.packed_documents(empty, PATH).count() == 0
    placed = packing.packed_documents(edge, PATH, 64, with_ids=True)
    parts = {(r.sequence_id, r.offset): r for r in placed.collect()}
    for s in packing.sequences(placed).collect():
        assert len(s.ids) == 4 * s.n_tokens and s.ends[-1] == s.n_tokens
        for a, b in zip([0, *s.ends], s.ends):
            assert bytes(s.ids[4 * a:4 * b]) == bytes(parts[s.sequence_id, a].ids)
    d = packing.density(placed, 64).first()
    assert d.least <= d.sequences <= d.least + 3


def test_special_strings_give_the_librarys_ids(spark):
    tok = Tokenizer.from_file(PATH)
    texts = ["a <|endoftext|> b", "<|startoftext|>Hello<|endoftext|>", "mid<|endoftext|>word's <|ENDOFTEXT|> É", "<|endoftext|>" * 3,
             "no marks <| endoftext |>", "<|endoftext", "<|<|endoftext|>|>", " <|startoftext|> \n", "plain words here", "", "<|EndOfText|>x"]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string")
    got = {r.doc_id: np.frombuffer(r.ids, "<u4").tolist() for r in packing.packed_documents(df, PATH, with_ids=True).collect()}
    for i, t in enumerate(texts):
        assert got[i] == tok.encode(t, add_special_tokens=False).ids + [1], t
    assert 49407 in got[0][:-1]
