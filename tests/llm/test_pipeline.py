import re

import public_tokenizers
import pytest
from tokenizers import Tokenizer

import __spark_entry__
import corpus_pipeline
from rentlens.llm import secrets, toxicity
from tests.llm.test_op02_near_dedup import brute


def test_stages_against_brute_force(spark, sf_small):
    docs = spark.read.parquet(f"{sf_small}/documents.parquet")
    model = toxicity.fit(docs, spark.read.parquet(f"{sf_small}/labels.parquet"))
    vectors = toxicity.Vectors(model.vocabulary)
    rows = [r for r in docs.collect() if model.score(vectors.counts(r.text))[0] < 0.7]
    stage = dict(corpus_pipeline.STAGES)
    out = stage["toxicity"](spark, docs, sf_small)
    assert sorted(map(tuple, out.collect())) == sorted(map(tuple, rows)) and out.columns == docs.columns

    best = {}
    for r in rows:
        key = re.sub(r"[\x20\x09-\x0D]", "", r.text)
        best[key] = min(best.get(key, r), r, key=lambda x: (-len(x.text), x.doc_id))
    rows = list(best.values())
    out = stage["exact_dedup"](spark, out, sf_small)
    assert sorted(map(tuple, out.collect())) == sorted(map(tuple, rows))

    kept = {i for i, _, _, k in brute(rows, 5, 80) if k}
    rows = [r for r in rows if r.doc_id in kept]
    out = stage["near_dedup"](spark, out, sf_small)
    assert sorted(map(tuple, out.collect())) == sorted(map(tuple, rows))

    cuts = secrets.discovery_steps(out)
    texts = {r.doc_id: secrets.redacted(r.text, secrets.spans(r.text, cuts)[1], "[SECRET]") for r in rows}
    out = stage["secret_scan"](spark, out, sf_small)
    assert {r.doc_id: (r.text, r.n_chars) for r in out.collect()} == {i: (t, len(t)) for i, t in texts.items()}

    p = corpus_pipeline.run(spark, sf_small).toPandas()
    tok = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    n = {i: len(tok.encode(t, add_special_tokens=False).ids) + 1 for i, t in texts.items()}
    assert p.groupby("doc_id").length.sum().to_dict() == n
    assert p.groupby("sequence_id").length.sum().max() <= 4096


def test_stages_on_edges(spark, clashing, empty, sf_small):
    for docs in (clashing, empty):
        for name, stage in corpus_pipeline.STAGES[:-1]:
            out = stage(spark, docs, sf_small)
            assert out.columns == docs.columns, name
            docs = out
        assert (corpus_pipeline.STAGES[-1][1](spark, docs, sf_small).count() > 0) == (docs.count() > 0)


def test_registered():
    names = __spark_entry__.queries()
    assert "pipeline" in names and all(any(n.startswith(f"op{i}_") for n in names) for i in range(1, 11))


@pytest.mark.parametrize("name", ["toxicity", "exact_dedup", "near_dedup", "secret_scan", "packing"])
def test_order(name):
    assert [n for n, _ in corpus_pipeline.STAGES].index(name) == ["toxicity", "exact_dedup", "near_dedup", "secret_scan", "packing"].index(name)
