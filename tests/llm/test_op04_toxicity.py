import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from rentlens.llm import queries, toxicity

SF = "/root/testdata/sf0.1"


def test_held_out_labels_are_predicted(spark):
    p = queries.QUERIES["op4_toxicity"](spark, SF).toPandas().set_index("doc_id")
    assert len(p) == 10000 and p.score.between(0, 1).all() and (p.predicted == (p.score >= 0.7)).all()
    assert all(h == (zlib.crc32(str(i).encode()) % 3 == 1) for i, h in p.held_out.items())
    y = spark.read.parquet(f"{SF}/labels.parquet").toPandas().set_index("doc_id").toxic
    q = p.join(y, how="inner")
    q = q[q.held_out]
    toxic, clean = q[q.toxic == 1], q[q.toxic == 0]
    assert len(toxic) > 100 and clean.predicted.mean() <= 0.005
    assert toxic.predicted.mean() >= 0.8 and (p.evidence.str.len() > 0).mean() >= 0.95 and (q.predicted == q.toxic).mean() >= 0.96
    ranks = q.score.rank()
    assert (ranks[q.toxic == 1].sum() - len(toxic) * (len(toxic) + 1) / 2) / (len(toxic) * len(clean)) >= 0.95


def test_block_max_search_is_exact():
    rng = np.random.default_rng(2)
    vectors = []
    for _ in range(700):
        t = np.sort(rng.choice(40, rng.integers(1, 7), replace=False))
        w = rng.integers(1, 4, len(t)).astype(float)
        vectors.append((t, w / np.sqrt((w * w).sum())))
    index = toxicity.BlockMaxIndex(vectors, 40, 16)
    dense = np.zeros((700, 40))
    for i, (t, w) in enumerate(vectors):
        dense[i, t] = w
    for i in range(0, 700, 7):
        cos = np.round(dense @ dense[i], 9)
        cos[i] = -1
        kth = np.sort(cos)[-15]  # all that tie with the 15th are neighbours
        want = [d for d in np.lexsort((np.arange(700), -cos)) if cos[d] > 0 and cos[d] >= kth]
        docs, scores = index.nearest(*vectors[i], 15, i)
        assert docs.tolist() == want and np.allclose(scores, cos[want])


def test_block_max_search_reads_no_posting_twice(monkeypatch):
    """Frequent terms are a matrix, middling ones have bounds, rare ones are read: never more than all postings."""
    rng = np.random.default_rng(5)
    share = 1 / np.arange(1, 1201) ** 0.7
    vectors = []
    for i in range(1500):  # texts of ten kinds, each with words of its own
        t = np.unique(np.r_[rng.choice(1200, 30, p=share / share.sum()), 1200 + i // 150 * 10 + rng.choice(10, 4)])
        w = rng.integers(1, 4, len(t)).astype(float)
        vectors.append((t, w / np.sqrt((w * w).sum())))
    index = toxicity.BlockMaxIndex(vectors, 1300, 64)
    dense = np.zeros((1500, 1300))
    for i, (t, w) in enumerate(vectors):
        dense[i, t] = w
    held = (dense > 0).sum(0)
    read, spread = [], toxicity._spread
    monkeypatch.setattr(toxicity, "_spread", lambda low, n: read.append(int(n.sum())) or spread(low, n))
    most = 0
    for i in range(0, 1500, 11):
        cos = np.round(dense @ dense[i], 9)
        cos[i] = -1
        kth = np.sort(cos)[-31]
        want = [d for d in np.lexsort((np.arange(1500), -cos)) if cos[d] > 0 and cos[d] >= kth]
        docs, scores = index.nearest(*vectors[i], 31, i)
        assert docs.tolist() == want and np.allclose(scores, cos[want])
        most += int(held[[t for t in vectors[i][0] if index.row[t] < 0]].sum())
    assert 0 < sum(read) <= most
    empty = toxicity.BlockMaxIndex([], 3)
    assert [x.tolist() for x in empty.nearest(np.array([1]), np.ones(1), 31)] == [[], []]


def test_terms_are_runs_of_letters():
    texts = ["".join(map(chr, range(a, a + 97))) for a in range(0, 0x30000, 97)]
    texts += ["", "_a_b1c", "A\x00B\x1fC\x85D\u2028E\u3000F", "ΣΑΣ ΟΔΟΣ İI ß", "ab²c½d٣e", "x" * 5000, "caf\u0301e", "\ud800a"]
    for text in texts:
        assert toxicity.terms_of(text) == toxicity.WORD.findall(text.lower())


def test_terms_are_counted_as_they_are_learnt():
    texts = ["Idiot, idiots! an IDIOT_1 idiot2", "lowei Loweisch loweixx9lowei", "", None, "x²idiot ½ idiot½", "ÉCLAIRS éclair eclairs",
             "straße Straßen STRASSE", "the therein thereinafter"]
    terms = sorted({t for x in texts for t in toxicity.terms_of(x or "")})
    vectors = toxicity.Vectors(terms)
    for x in texts:
        want: dict[str, int] = {}
        for t in toxicity.terms_of(x or ""):
            want[t] = want.get(t, 0) + 1
        assert {terms[i]: n for i, n in vectors.counts(x).items()} == want
    assert toxicity.Vectors([]).counts("idiot") == {}


def test_isotonic_steps():
    x, v = toxicity.isotonic(np.array([0.1, 0.2, 0.3, 0.4]), np.array([0.0, 1, 0, 1]), np.ones(4), 0)
    assert x.tolist() == [0.1, 0.2, 0.4] and np.allclose(v, [0, 0.5, 1])
    x, v = toxicity.isotonic(np.arange(4.0), np.array([0.0, 0, 0, 1]), np.ones(4), 1)
    assert np.allclose(v, [0.0625, 0.625]) or np.allclose(v, [0.125, 0.125, 0.125, 0.625])


@pytest.fixture(scope="module")
def small(spark):
    import random
    rng = random.Random(1)
    words = [f"{a}{b}lk" for a in "bcdfgmnprst" for b in "aeiou"]
    rows = [(i, " ".join(rng.choices(words, k=12)) + (" you idiot" if i % 4 == 0 else " dear friend"), int(i % 4 == 0))
            for i in range(400)]
    df = spark.createDataFrame(rows, "doc_id long, text string, toxic int")
    return df.select("doc_id", "text"), df.select("doc_id", "toxic")


def test_edges(small, edge, clashing, empty):
    model = toxicity.fit(*small)
    want = [(r.doc_id, round(r.score, 9), r.predicted) for r in toxicity.scored(edge, model).orderBy("doc_id", "score").collect()]
    got = [(r.doc_id, round(r.score, 9), r.predicted) for r in toxicity.scored(clashing, model).orderBy("doc_id", "score").collect()]
    assert got == want and len(want) == 11 and {p for _, _, p in want} == {0}
    assert toxicity.scored(empty, model).count() == 0
    assert toxicity.scored(small[0], model).filter((F.col("predicted") == 1) != (F.col("doc_id") % 4 == 0)).count() == 0
    left = toxicity.without_toxic(clashing.unionByName(clashing), small[1])
    assert left.columns == clashing.columns
    assert toxicity.without_toxic(empty, small[1]).count() == 0


def test_without_labels_or_with_one(small):
    docs, labels = small
    none = toxicity.fit(docs, labels.filter("false"))
    assert {r.score for r in toxicity.scored(docs, none).collect()} == {0.0}
    one = toxicity.fit(docs, labels.filter("toxic = 0").unionByName(labels.limit(3).withColumn("toxic", F.lit(None).cast("int"))))
    assert {r.score for r in toxicity.scored(docs, one).collect()} == {0.0}


def test_held_out_labels_do_not_matter(small):
    docs, labels = small
    flipped = labels.withColumn("toxic", F.when(toxicity.held_out("doc_id"), 1 - F.col("toxic")).otherwise(F.col("toxic")))
    a, b = (sorted(map(tuple, toxicity.scored(docs, toxicity.fit(docs, x)).select("doc_id", "score").collect()))
            for x in (labels, flipped))
    assert a == b


def test_near_copies_among_examples_count_once(spark):
    """A long toxic text that is copied with small changes teaches its telling word, not all its words."""
    import random
    rng = random.Random(3)
    common = [f"w{c}x" for c in "abcdefghijklmnopqrstuvwxyz"]
    rows = [(i, " ".join(rng.choice(common) for _ in range(30)) + (" idiot" if i % 2 else ""), i % 2) for i in range(300)]
    odd = [f"odd{a}{b}" for a in "abcdefgh" for b in "abcdefgh"]
    rows += [(1000 + i, " ".join(odd[:i % 60] + ["changed"] + odd[i % 60:]) + " idiot", 1) for i in range(60)]
    df = spark.createDataFrame(rows, "doc_id long, text string, toxic int")
    model = toxicity.fit(df.select("doc_id", "text"), df.select("doc_id", "toxic"))
    assert "idiot" in model.vocabulary and not [t for t in model.vocabulary if t.startswith("odd")]


def test_rare_toxic_labels_can_reach_a_high_score():
    """300 toxic among 300,000 clean labels, of which 81 in 1200 hold a term of the vocabulary."""
    clean = [{1: 1 + i % 3} if i % 1200 < 81 else {} for i in range(3000)]
    model = toxicity.Model(["idiot", "odd"], np.ones(2), list(range(3300)), [1] * 300 + [0] * 3000,
                           [{0: 1 + i % 3} for i in range(300)] + clean, {1: 1.0, 0: 100.0})
    assert model.score({0: 1})[0] >= toxicity.REJECT and model.score({1: 1})[0] < 0.01 and model.score({})[0] < 0.01
    few = toxicity.Model(["idiot", "odd"], np.ones(2), list(range(3005)), [1] * 5 + [0] * 3000,
                         [{0: 1}] * 5 + clean, {1: 1.0, 0: 100.0})
    assert few.score({0: 1})[0] < toxicity.REJECT  # a few examples alone do not
