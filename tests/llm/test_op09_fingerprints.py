import hashlib
import random
import re
import string
import struct

import pytest
import xxhash

from rentlens.llm import fingerprints, queries


def signed(x):
    return x - (1 << 64) if x >> 63 else x


def chosen(text, k, w):
    """Positions and hashes by the definition, window by window."""
    words = [x for x in re.split(r"[\x20\x09-\x0D]+", text.lower()) if x]
    h = [signed(xxhash.xxh64_intdigest(x.encode(), 42)) for x in words]

    def of(values):
        seed = 42
        for v in values:
            seed = xxhash.xxh64_intdigest(struct.pack("<q", v), seed)
        return signed(seed)
    grams = [of(h[i:i + k]) for i in range(len(h) - k + 1)] or ([of(h)] if h else [])
    at = []
    for i in range(max(1, len(grams) - w + 1) if grams else 0):
        window = grams[i:i + w]
        p = i + max(j for j, g in enumerate(window) if g == min(window))
        if p not in at:
            at.append(p)
    return at, [grams[p] for p in at]


def likeness(a, b):
    a, b = set(a), set(b)
    return len(a & b) / len(a | b) if a | b else 1.0


def brute(rows, k=3, w=4):
    rows = sorted(rows, key=lambda r: (r.doc_id is not None, r.doc_id or 0, r.text or ""))
    out = []
    for i, r in enumerate(rows):
        text, nxt = r.text or "", rows[(i + 1) % len(rows)].text or ""
        q = len(text) // 4
        new = text[:len(text) - q] + nxt[:q]
        a, b, c = (chosen(t, k, w) for t in (text, new, nxt))
        out.append((r.doc_id, len(text), hashlib.sha256(new.encode()).hexdigest(), a, b, likeness(a[1], b[1]), likeness(a[1], c[1])))
    return out


def rows_of(df):
    return sorted(((r.doc_id, r.n_chars, r.edited_sha256, (r.fingerprint.positions, r.fingerprint.hashes),
                    (r.edited_fingerprint.positions, r.edited_fingerprint.hashes), r.near_edited, r.near_next)
                   for r in df.collect()), key=repr)


def test_all_documents(spark, sf_small, monkeypatch):
    monkeypatch.setattr(fingerprints, "BUCKET_ROWS", 17)
    docs = spark.read.parquet(f"{sf_small}/documents.parquet")
    assert rows_of(fingerprints.edited_likeness(docs)) == sorted(brute(docs.collect()), key=repr)


def test_query(spark, sf_small):
    p = queries.QUERIES["op9_winnowing"](spark, sf_small).toPandas()
    assert len(p) == 200 and (p.near_edited - p.near_next).mean() > 0.4
    docs = spark.read.parquet(f"{sf_small}/documents.parquet").toPandas()
    q = p.merge(docs, on="doc_id")
    assert q.groupby("text").fingerprint.nunique().max() == 1 and p.fingerprint.str.len().eq(64).all()


def test_edges(spark, edge, clashing, empty):
    want = sorted(brute(edge.collect()), key=repr)
    for docs in (edge, clashing):
        assert rows_of(fingerprints.edited_likeness(docs)) == want
    assert fingerprints.edited_likeness(empty).count() == 0
    one = spark.createDataFrame([(7, "a b c d e f g h")], "doc_id long, text string")
    assert rows_of(fingerprints.edited_likeness(one)) == brute(one.collect())
    gaps = spark.createDataFrame([(i * i * i * 1000 - 5, f"text {i} " * i) for i in range(60)], "doc_id long, text string")
    fingerprints.BUCKET_ROWS, old = 3, fingerprints.BUCKET_ROWS
    try:
        assert rows_of(fingerprints.edited_likeness(gaps)) == sorted(brute(gaps.collect()), key=repr)
    finally:
        fingerprints.BUCKET_ROWS = old


def test_shared_passages_share_a_hash():
    """Any common run of w + k - 1 words."""
    a, b = "q w e r t y u i o p".split(), "z x c v b n m".split()
    for run in range(3):
        common = [f"s{run}{i}" for i in range(6)]
        x, y = chosen(" ".join(a + common + b), 3, 4), chosen(" ".join(b + common + a), 3, 4)
        assert set(x[1]) & set(y[1])


def test_texts_without_white_space(spark):
    """Three quarters of a text stay: most of its fingerprint must, whatever parts words."""
    rng = random.Random(2)
    alphabets = ["".join(chr(0x4E00 + i) for i in range(2000)), "".join(chr(0x0E01 + i) for i in range(40)), "abcdef(){};=+,.",
                 string.ascii_letters + string.digits + "+/"]
    rows = [(i, "".join(rng.choice(alphabets[i % 4]) for _ in range(rng.randint(200, 3000)))) for i in range(40)]
    rows += [(40 + i, "a short start and then " + "".join(rng.choice(alphabets[0]) for _ in range(400))) for i in range(10)]
    got = fingerprints.edited_likeness(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert len(got) == 50 and all(0.4 < r.near_edited < 0.8 and r.near_next < 0.05 for r in got)
    one = {r.doc_id: r.fingerprint for r in got}[0]
    low = dict(rows)[0].lower()
    h = [signed(xxhash.xxh64_intdigest(c.encode(), 42)) for c in low]

    def of(values):
        seed = 42
        for v in values:
            seed = xxhash.xxh64_intdigest(struct.pack("<q", v), seed)
        return signed(seed)
    pieces = [of(h[i:i + 8]) for i in range(len(h) - 7)]
    grams = [of(pieces[i:i + 3]) for i in range(len(pieces) - 2)]
    want = sorted({max(j for j in range(i, i + 4) if grams[j] == min(grams[i:i + 4])) for i in range(len(grams) - 3)})
    assert one.positions == want and one.hashes == [grams[i] for i in want]


def test_a_long_line_takes_time_in_proportion(spark):
    rng = random.Random(6)
    rows = [(1, "".join(rng.choices(string.ascii_lowercase, k=100_000)))]
    got = fingerprints.edited_likeness(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert len(got[0].fingerprint.positions) > 30_000


@pytest.mark.parametrize("kind", ["outlier", "string"])
def test_next_rows_of_ids_of_any_spread(spark, monkeypatch, kind):
    """Outliers, the least and the greatest long, nulls, ids that are no numbers: buckets stay near their size."""
    monkeypatch.setattr(fingerprints, "BUCKET_ROWS", 100)
    ids = [None, *range(2000), 2 ** 61, 2 ** 63 - 1, -2 ** 63]
    if kind == "string":
        ids = [None if i is None else f"doc,{i:x}é" for i in ids] + ["", "doc,"]
    rows = [(i, f"text of {i}") for i in ids]
    df = spark.createDataFrame(rows, f"id {'string' if kind == 'string' else 'long'}, text string").repartition(5)
    got = {r.id: r.next_text for r in fingerprints.with_next(df, "id", "text", ["text"]).collect()}
    order = sorted(rows, key=lambda r: (r[0] is not None, r[0].encode() if isinstance(r[0], str) else r[0] or 0))
    assert got == {a[0]: b[1] for a, b in zip(order, order[1:] + order[:1])}
    sizes = [r["count"] for r in fingerprints.with_buckets(df, "id").groupBy("__bucket").count().collect()]
    assert max(sizes) <= (400 if kind == "outlier" else 1200)
