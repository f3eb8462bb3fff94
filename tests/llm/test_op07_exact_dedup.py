import hashlib
import re

import pytest

from rentlens.llm import exact_dedup


def brute(rows):
    norm = [re.sub(r"[\x20\x09-\x0D]", "", r.text or "") for r in rows]
    out = []
    for r, n in zip(rows, norm):
        group = [x for x, m in zip(rows, norm) if m == n]
        keep = min(group, key=lambda x: (-len(x.text or ""), (x.doc_id is not None, x.doc_id or 0))).doc_id
        out.append((r.doc_id, keep, len(group), r.doc_id == keep, hashlib.sha256(n.encode()).hexdigest()))
    return sorted(out, key=repr)


@pytest.mark.parametrize("fan_in", [2, 16])
def test_edges(edge, clashing, empty, fan_in):
    for docs in (edge, clashing):
        got = sorted(map(tuple, exact_dedup.exact_groups(docs, fan_in=fan_in).collect()), key=repr)
        assert got == brute(docs.collect())
    assert exact_dedup.exact_groups(empty, fan_in=fan_in).count() == 0


def test_one_hot_text_over_many_runs(spark):
    from pyspark.sql import functions as F
    docs = spark.range(3000, numPartitions=37).select(
        F.col("id").alias("doc_id"),
        F.when(F.col("id") % 3 == 0, F.concat(F.lit("same"), F.repeat(F.lit(" "), (F.col("id") % 5).cast("int"))))
        .otherwise(F.concat(F.lit("t"), (F.col("id") % 700).cast("string"))).alias("text"))
    got = sorted(map(tuple, exact_dedup.exact_groups(docs, fan_in=3).collect()), key=repr)
    assert got == brute(docs.collect())


def test_filter_keeps_columns_and_one_row_of_each_text(clashing, empty):
    out = exact_dedup.drop_exact_copies(clashing)
    assert out.columns == clashing.columns
    rows = out.collect()
    texts = [re.sub(r"[\x20\x09-\x0D]", "", r.text or "") for r in rows]
    assert len(texts) == len(set(texts)) == 7
    assert any(r.doc_id is None for r in rows)
    assert exact_dedup.drop_exact_copies(empty).count() == 0
