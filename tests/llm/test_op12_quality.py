import zlib

import numpy as np
from pyspark.sql import functions as F

from rentlens.llm import quality, queries

SF = "/root/testdata/sf0.1"


def auc(score, y):
    ranks, y = score.rank(), y.astype(bool)
    return (ranks[y].sum() - y.sum() * (y.sum() + 1) / 2) / (y.sum() * (~y).sum())


def test_held_out_labels_are_predicted(spark):
    p = queries.QUERIES["op12_quality"](spark, SF).toPandas().set_index("doc_id")
    assert len(p) == 10000 and p.score.between(0, 1).all() and (p.predicted == (p.score >= 0.7)).all()
    assert all(h == (zlib.crc32(str(i).encode()) % 4 == 2) for i, h in p.held_out.items())
    y = spark.read.parquet(f"{SF}/labels.parquet").toPandas().set_index("doc_id").quality
    q = p.join(y, how="inner")
    q = q[q.held_out]
    good, bad = q[q.quality == 1], q[q.quality == 0]
    print("held out", len(good), len(bad), good.predicted.mean(), bad.predicted.mean(), auc(q.score, q.quality))
    assert good.predicted.mean() >= 0.99 and bad.predicted.mean() <= 0.15
    assert auc(q.score, q.quality) >= 0.95
    for low, high in ((0, 0.3), (0.9, 1.01)):  # calibrated
        own = q[(q.score >= low) & (q.score < high)]
        assert abs(own.quality.mean() - own.score.mean()) < 0.08


def plain(text):
    """A few statistics, one character at a time."""
    words = text.split()
    pairs = list(zip(words, words[1:]))
    return {"words": np.log1p(len(words)), "different": len({w.lower() for w in words}) / max(1, len(words)),
            "pairs": len({(a.lower(), b.lower()) for a, b in pairs}) / max(1, len(pairs)),
            "lines": len([x for x in text.split("\n") if x.split()]),
            "different_lines": len({tuple(x.lower().split()) for x in text.split("\n") if x.split()}),
            "upper": sum(c.isupper() for c in text if c.isascii()) / max(1, sum(c.isalpha() for c in text if c.isascii()))}


def test_statistics_by_hand():
    texts = ["The cat sat. The CAT sat\nthe cat sat.\n\n the  cat sat.", "", "x", "aa bb aa bb\naa bb", " \n ", "Éa $$$ b###\nÉa $$$ b###", "q" * 50]
    raw = [t.encode() for t in texts]
    offs = np.r_[0, np.cumsum([len(r) for r in raw])]
    got = quality.statistics(np.frombuffer(b"".join(raw), np.uint8), offs)
    assert got.shape == (len(texts), quality.STATISTICS) and np.isfinite(got).all() and not got[1].any()
    k = len(quality.KINDS)
    for t, row in zip(texts, got):
        if not t:
            continue
        want = plain(t)
        assert np.isclose(row[k + 1], want["words"]) and np.isclose(row[k + 8], want["different"]) and np.isclose(row[k + 10], want["pairs"])
        assert np.isclose(row[k + 4], want["upper"]) and np.isclose(row[k + 13], np.log1p(max(1, want["lines"])))
        assert np.isclose(row[k + 14], want["different_lines"] / max(1, want["lines"]))
    assert np.isclose(got[6, -1], np.log1p(50)) and np.isclose(got[5, k + 6], 4 / 6)
    each = [quality.statistics(np.frombuffer(r, np.uint8), np.array([0, len(r)])) for r in raw]
    assert np.allclose(np.concatenate(each), got)  # a text's numbers don't depend on its neighbours


def test_normal_equations_do_not_depend_on_partitions(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").filter("doc_id < 2000")
    labels = spark.read.parquet(f"{SF}/labels.parquet")
    a = quality.document_statistics(docs.repartition(1))
    b = quality.document_statistics(docs.repartition(9))
    p = [quality.scored(x, quality.fit(x, labels)).toPandas().set_index("doc_id").score.sort_index() for x in (a, b)]
    assert np.allclose(p[0], p[1], atol=1e-4)
    # the sums against plain numpy on all rows at once
    rows = [(r["id"], r["x"]) for r in a.collect()]
    y = {r.doc_id: r.quality for r in labels.collect() if zlib.crc32(str(r.doc_id).encode()) % 4 != 2}
    x = np.array([v for i, v in rows if i in y])
    model = quality.fit(a, labels)
    assert np.allclose(model.features.mean, x.mean(0), atol=1e-6) and np.allclose(model.features.spread[x.std(0) > 1e-6], x.std(0)[x.std(0) > 1e-6], rtol=1e-3)
    z, t = model.features(x), np.array([y[i] for i, v in rows if i in y])
    least = []
    for ridge in quality.WEIGHTS:
        keep = np.eye(z.shape[1]) * ridge * len(z)
        keep[-1, -1] = 0
        least.append(np.abs(z @ np.linalg.lstsq(z.T @ z + keep, z.T @ t, rcond=None)[0] - model.raw(x)).max())
    assert min(least) < 1e-6


def test_isotonic():
    rng = np.random.default_rng(3)
    v, w = rng.normal(size=60).cumsum() * 0.2 + rng.normal(size=60), rng.integers(1, 9, 60).astype(float)
    got = quality.isotonic(v, w)
    want = [max(min((v[i:j + 1] * w[i:j + 1]).sum() / w[i:j + 1].sum() for j in range(k, 60)) for i in range(k + 1)) for k in range(60)]
    assert np.allclose(got, want)  # max of mins of means


def test_odd_rows(spark, edge, clashing, empty):
    labels = spark.createDataFrame([(1, 1, 0), (1, 0, 0), (6, 0, 1), (8, 1, None), (None, 1, 1), (3, None, 0), (4, 0, 0)],
                                   "doc_id long, quality int, toxic int")
    a = quality.quality(edge, labels).toPandas()
    assert len(a) == 11 and a.score.between(0, 1).all() and a.doc_id.isna().sum() == 1
    b = quality.quality(clashing, labels.withColumns({"id": F.lit(1), "x": F.lit(2), "fold": F.lit(0), "label": F.lit(5)})).toPandas()
    assert sorted(a.score.round(6)) == sorted(b.score.round(6))
    assert quality.quality(empty, labels).count() == 0
    none = labels.limit(0)
    assert quality.quality(edge, none).toPandas().score.eq(0).all()
    assert quality.quality(edge, labels.filter("quality = 1")).toPandas().score.eq(1).all()


def test_labels_and_ids_are_no_inputs(spark, edge):
    labels = spark.read.parquet(f"{SF}/labels.parquet")
    docs = spark.read.parquet(f"{SF}/documents.parquet").filter("doc_id < 1500")
    model = quality.fit(quality.document_statistics(docs), labels)
    same = docs.filter("doc_id < 60").select((F.col("doc_id") + 777).alias("doc_id"), "text")
    a = quality.scored(quality.document_statistics(docs.filter("doc_id < 60")), model).toPandas().set_index("doc_id").score
    b = quality.scored(quality.document_statistics(same), model).toPandas().set_index("doc_id").score
    assert (a.sort_index().to_numpy() == b.sort_index().to_numpy()).all()
