import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from rentlens.llm import queries, token_files

PATH = public_tokenizers.path("word_bpe_49k.json")


def test_query(spark, sf_small):
    rows = queries.QUERIES["op10_token_counts"](spark, sf_small).collect()
    tok = Tokenizer.from_file(PATH)
    want = sorted(len(tok.encode(r.text, add_special_tokens=False).ids)
                  for r in spark.read.parquet(f"{sf_small}/documents.parquet").collect())
    assert sorted(r.n_tokens for r in rows) == want and all(r.ended for r in rows)


def brute(files, sep):
    out = []
    for name, ids in files.items():
        start, n = 0, 0
        for i, x in enumerate(ids):
            if x == sep:
                out.append((name, n, start, i - start, True))
                start, n = i + 1, n + 1
        if start < len(ids):
            out.append((name, n, start, len(ids) - start, False))
    return sorted(out)


@pytest.mark.parametrize("size", [1, 3, 16, 1000])
def test_blocks_of_any_size(spark, size):
    rng = np.random.default_rng(size)
    files = {f"f{i}": rng.choice([5, 6, 7, 9], n, p=[0.5, 0.3, 0.15, 0.05]).tolist() for i, n in enumerate((0, 1, 7, 400, 900))}
    files |= {"none": [5] * 50, "only": [9] * 40, "long": [5] * 200 + [9] + [6] * 200 + [9], "tail": [9, 5]}
    rows = [(f, b, np.array(ids[b * size:(b + 1) * size], "<u2").tobytes()) for f, ids in files.items()
            for b in range(-(-len(ids) // size))]
    blocks = spark.createDataFrame([(f, b, bytearray(d)) for f, b, d in rows], "file string, block long, data binary").repartition(7)
    assert sorted(map(tuple, token_files.document_tokens(blocks, 9).collect())) == brute(files, 9)


def test_files_written_and_read(spark, edge, empty, tmp_path):
    path = str(tmp_path / "flat")
    token_files.write_flat(edge, PATH, 49407, path, file_documents=2)
    got = token_files.document_tokens(token_files.read_blocks(spark, path, 64), 49407).collect()
    tok = Tokenizer.from_file(PATH)
    assert sorted(r.n_tokens for r in got) == sorted(len(tok.encode(r.text or "", add_special_tokens=False).ids) for r in edge.collect())
    token_files.write_flat(empty, PATH, 49407, str(tmp_path / "none"))
    assert token_files.document_tokens(token_files.read_blocks(spark, str(tmp_path / "none")), 49407).count() == 0
    with pytest.raises(ValueError):
        token_files.write_flat(edge, PATH, 1 << 16, path)
    with pytest.raises(ValueError):
        token_files.read_blocks(spark, path, 3)


def test_null_data_and_clashing_names(spark):
    from pyspark.sql import functions as F
    rows = [("a", 0, bytearray(np.array([1, 2], "<u2").tobytes())), ("a", 1, None), ("a", 2, bytearray(np.array([9, 4], "<u2").tobytes()))]
    blocks = spark.createDataFrame(rows, "file string, block long, data binary").withColumns({c: F.lit(1) for c in ("n", "at", "base", "docs", "open")})
    assert sorted(map(tuple, token_files.document_tokens(blocks, 9).collect())) == [("a", 0, 0, 2, True), ("a", 1, 3, 1, False)]


def test_files_larger_than_a_range(spark, tmp_path):
    """One file of many ranges, one document across more than three of them, is read by many tasks."""
    rng = np.random.default_rng(4)
    ids = rng.choice([5, 6, 7, 9], 6000, p=[0.5, 0.3, 0.15, 0.05]).tolist()
    ids[1000:1400] = [5] * 400  # ranges hold 64 ids
    folder = tmp_path / "with blank"
    folder.mkdir()
    (folder / "big.bin").write_bytes(np.array(ids, "<u2").tobytes())
    (folder / "none.bin").write_bytes(b"")
    want = [x[1:] for x in brute({"big": ids}, 9)]
    got = token_files.file_tokens(spark, str(folder), 9, 128)
    assert sorted(r[1:] for r in map(tuple, got.collect())) == want
    blocks = token_files.read_blocks(spark, str(folder), 128)
    assert blocks.count() == -(-12000 // 128) and blocks.rdd.getNumPartitions() > 1
    assert sorted(r[1:] for r in map(tuple, token_files.document_tokens(blocks, 9).collect())) == want
