import zlib

import pytest
from pyspark.sql import functions as F

from rentlens.llm import queries, sharding


@pytest.mark.parametrize("dims,bits", [(2, 4), (3, 3), (4, 4)])
def test_curve_visits_every_cell_in_unit_steps(spark, dims, bits):
    rows = sharding.hilbert_table(spark, dims, bits).orderBy("place").collect()
    assert [r.place for r in rows] == list(range(1 << dims * bits))
    xs = [[r.cell >> bits * i & (1 << bits) - 1 for i in range(dims)] for r in rows]
    assert all(sum(abs(p - q) for p, q in zip(a, b)) == 1 for a, b in zip(xs, xs[1:]))


def _sound(p, n, shards):
    assert len(p) == n
    for _, own in p.groupby("shard"):
        assert sorted(own.slot) == list(range(len(own)))
    if n >= shards:
        assert p.groupby("shard").size().reindex(range(shards), fill_value=0).agg(["min", "max"]).diff().iloc[1] <= 1


def test_all_documents(spark, sf_small):
    p = queries.QUERIES["op1_hilbert_shards"](spark, sf_small).toPandas()
    docs = spark.read.parquet(f"{sf_small}/documents.parquet").toPandas().set_index("doc_id").text
    _sound(p, len(docs), 40)
    assert set(p.law) == {"rows"} and p.grown_shard.isna().all()
    for r in p.itertuples():
        raw = docs[r.doc_id].encode()
        assert (r.size, r.text_crc32) == (len(raw) + 16, zlib.crc32(raw))
    q = p.sort_values(["shard", "slot"])
    assert q.curve_place.is_monotonic_increasing


def test_edges(edge, clashing, empty):
    for docs in (edge, clashing):
        p = sharding.document_shards(docs, 4).toPandas()
        _sound(p, 11, 4)
        assert p[p.doc_id == 3][["size", "text_crc32"]].values.tolist() == [[16, 0]]
    assert sharding.document_shards(empty, 4).count() == 0
    _sound(sharding.document_shards(edge, 40).toPandas(), 11, 40)


def test_equal_bytes(spark):
    rows = spark.range(5000, numPartitions=7).select(F.col("id"), (F.col("id") % 97 + 1).alias("w"))
    out = sharding.hilbert_shards(rows, [sharding.magnitude(F.col("w"), 2, 0), F.lit(0)], ["id"], 10, "bytes", "w", 2)
    p = out.toPandas()
    sums = p.groupby("shard").w.sum()
    assert len(sums) == 10 and sums.max() - sums.min() <= 2 * 97
    _sound(p, 5000, 10 ** 9)
    with pytest.raises(ValueError):
        sharding.hilbert_shards(rows, [F.lit(0)], ["id"], 10, "key")


def test_files_prune(spark, sf_small, tmp_path):
    docs = spark.read.parquet(f"{sf_small}/documents.parquet")
    manifest = sharding.write_shards(docs, sharding.document_shards(docs, 16), str(tmp_path / "s"))
    hit = [r.shard for r in sharding.shards_for(manifest, source=("src3", "src3"), doc_id=(0, 60)).collect()]
    want = docs.filter("source = 'src3' and doc_id between 0 and 60").count()
    got = spark.read.parquet(str(tmp_path / "s")).filter(F.col("shard").isin(hit))
    assert got.filter("source = 'src3' and doc_id between 0 and 60").count() == want
    assert len(hit) < 16
