import numpy as np
import public_tokenizers
import pytest
import sentencepiece

from rentlens.llm import pieces, queries

PATH = public_tokenizers.path("piece_bpe_32k.model")
TEXTS = ["", " ", "  a  b\n\n c", "Hi  there\nworld <s> é漢字😀", "a" * 50, " lead", "trail ", "\t tab", "日本語テキスト",
         "x\u0000y", "    four", "if (a) {\n        return b;\n}", "word " * 20, "aaa aaaa aaaaa banana bananas", "  \xa0x"]


def ids(raw):
    return np.frombuffer(raw, "<u4").tolist()


def test_ids_and_texts_are_the_librarys(spark, sf_small):
    sp = sentencepiece.SentencePieceProcessor(model_file=PATH)
    docs = spark.read.parquet(f"{sf_small}/documents.parquet")
    texts = {r.doc_id: r.text for r in docs.collect()}
    got = pieces.encoded(docs, PATH)
    rows = {r.doc_id: r.ids for r in got.collect()}
    assert rows.keys() == texts.keys()
    assert all(ids(rows[i]) == sp.encode(t) for i, t in texts.items())
    assert {r.doc_id: r.text for r in pieces.decoded(got, PATH).collect()} == texts
    e = pieces.Encoder(pieces.Vocabulary(PATH))
    for t, raw in zip(TEXTS, e.encode(TEXTS)):
        assert ids(raw) == sp.encode(t) and e.decode(raw) == sp.decode(sp.encode(t)) == t


def test_unigram_way_is_the_best_sum():
    """Against a plain Viterbi over strings."""
    v = pieces.Vocabulary(PATH, "unigram")
    rng = np.random.default_rng(0)
    v.scores = {t: float(np.round(-rng.random() * 9 * len(t) ** 0.5, 3)) for t in v.ids}
    e = pieces.Encoder(v)

    def best(s):
        top = [0.0] + [-1e18] * len(s)
        for i in range(1, len(s) + 1):
            for j in range(max(0, i - 16), i):
                if s[j:i] in v.scores:
                    top[i] = max(top[i], top[j] + v.scores[s[j:i]])
        return top[-1]
    for w in ("▁internationalisation", "▁the", "x", "▁Überraschung", "▁aaaaaaaa"):
        way = [v.texts[i] for i in ids(e.encode([w[1:] if w[0] == "▁" else w])[0])]
        full = "".join(way)
        assert full == "▁" + w.lstrip("▁")
        assert sum(v.scores[t] for t in way) == pytest.approx(best(full))


def test_query_and_edges(spark, sf_small, edge, clashing, empty):
    p = queries.QUERIES["op3_pieces"](spark, sf_small).toPandas()
    assert len(p) == 200 and p.decodes.all() and (p.n_ids > 0).all()
    want = sorted(((r.doc_id or -1, len(sentencepiece.SentencePieceProcessor(model_file=PATH).encode(r.text or "")))
                   for r in edge.collect()))
    for docs in (edge, clashing):
        assert sorted((r.doc_id or -1, r.n_ids) for r in pieces.round_trips(docs, PATH).collect()) == want
    assert pieces.encoded(empty, PATH).count() == pieces.round_trips(empty, PATH).count() == 0
    with pytest.raises(ValueError):
        pieces.Vocabulary(PATH, "other")


def scanned_bpe(text, scores):
    """Merge by merge, the whole list looked at each time."""
    parts = list(text)
    while True:
        near = [(scores[a + b], -i) for i, (a, b) in enumerate(zip(parts, parts[1:])) if a + b in scores]
        if not near:
            return parts
        i = -max(near)[1]
        parts[i:i + 2] = [parts[i] + parts[i + 1]]


def test_merges_of_any_order_and_long_runs():
    import random
    import time
    rng = random.Random(5)
    for _ in range(300):
        known = ["".join(rng.choices("ab", k=rng.randint(2, 5))) for _ in range(8)]
        scores = {t: rng.randint(-4, 0) / 2 for t in known}
        text = "".join(rng.choices("ab", k=rng.randint(0, 40)))
        assert pieces.plain_bpe(text, scores) == scanned_bpe(text, scores)
    scores = pieces.Vocabulary(PATH).scores
    began = time.perf_counter()
    out = pieces.plain_bpe(pieces.MARK * 200_000, scores)
    assert "".join(out) == pieces.MARK * 200_000 and time.perf_counter() - began < 10
