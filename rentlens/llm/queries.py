"""The registered queries of this subpackage and, where SQL can say it, their DuckDB SQL."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rentlens.llm import (alignment, exact_dedup, fingerprints, near_dedup, packing, pieces, quality, secrets, sharding,
                          token_files, tool_calls, toxicity, whitening)
from rentlens.llm.common import table
from rentlens.session import ensure_checkpoint_dir

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def add(f):
        QUERIES[name] = f
        if sql:
            ORACLES[name] = sql
        return f
    return add


@query("op1_hilbert_shards")
def op1(spark, sf_dir):
    """All documents in 40 shards along a Hilbert curve, counts at most one apart."""
    placed = sharding.document_shards(table(spark, sf_dir, "documents"), 40)
    return placed.select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot",
                         F.lit(None).cast("int").alias("grown_shard"), "curve_place")


@query("op7_exact_groups", r"""
    WITH d AS (SELECT doc_id, length(coalesce(text, '')) AS n,
                      sha256(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]', '', 'g')) AS text_sha256
               FROM documents),
         g AS (SELECT *, first_value(doc_id) OVER (PARTITION BY text_sha256 ORDER BY n DESC, doc_id) AS keep_id,
                      count(*) OVER (PARTITION BY text_sha256) AS group_size FROM d)
    SELECT doc_id, keep_id, group_size, doc_id = keep_id AS kept, text_sha256 FROM g""")
def op7(spark, sf_dir):
    """Every document with the row of its group of equal texts that stays."""
    return exact_dedup.exact_groups(table(spark, sf_dir, "documents"))


@query("op2_near_groups")
def op2(spark, sf_dir):
    """Every document with its component of near copies (3 words, 85 %)."""
    return near_dedup.near_groups(table(spark, sf_dir, "documents"), words=3, percent=85).drop("print")


@query("op4_toxicity")
def op4(spark, sf_dir):
    """Every document's toxicity by its nearest labelled examples."""
    docs = table(spark, sf_dir, "documents")
    return toxicity.scored(docs, toxicity.fit(docs, table(spark, sf_dir, "labels"))).drop("print")


@query("op6_packed")
def op6(spark, sf_dir):
    """All documents' tokens in sequences of at most 4096."""
    import public_tokenizers
    return packing.packed_documents(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"),
                                    kept_words=1 << 20)


@query("op8_secrets")
def op8(spark, sf_dir):
    """Every document's secrets."""
    found = secrets.secret_spans(table(spark, sf_dir, "documents"))

    def joined(spans):
        return F.array_join(F.transform(spans, lambda x: F.concat_ws(":", x["kind"], x["start"], x["end"])), ",")
    n = {k: F.size(F.expr(f"filter(base, x -> x.kind = '{k}')")).cast("long").alias(f"n_{k}")
         for k in ("assign", "access", "hex")}
    return found.select("doc_id", *n.values(), F.sha2(joined(F.col("base")), 256).alias("base_sha256"),
                        joined(F.col("spans")).alias("spans"))


@query("op9_winnowing")
def op9(spark, sf_dir):
    """Every document's fingerprint, that of its edited text, and their likeness."""
    out = fingerprints.edited_likeness(table(spark, sf_dir, "documents"))
    return out.withColumns({c: fingerprints.digest(F.col(c)) for c in ("fingerprint", "edited_fingerprint")})


@query("op3_pieces")
def op3(spark, sf_dir):
    """Every document encoded into pieces and decoded again."""
    import public_tokenizers
    return pieces.round_trips(table(spark, sf_dir, "documents"), public_tokenizers.path("piece_bpe_32k.model"))


@query("op10_token_counts")
def op10(spark, sf_dir):
    """The documents' tokens in flat files, and the tokens of each document found there again."""
    import public_tokenizers
    path = f"{ensure_checkpoint_dir(spark).rstrip('/')}/flat/{uuid.uuid4().hex}"
    end = 49407  # <|endoftext|>, which no text gives
    token_files.write_flat(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"), end, path)
    out = token_files.file_tokens(spark, path, end)
    return out.withColumn("file", F.element_at(F.split("file", "/"), -1))


@query("op5_tool_calls", """
    WITH RECURSIVE
    c AS (SELECT conv_id, 'call-' || conv_id || '-' || turn AS call_id, 'call-' || conv_id || '-' || (turn - 2) AS parent,
                 min({'turn': turn, 'text': text}) AS x, count(*) AS n_calls
          FROM conversations WHERE role = 'user' GROUP BY ALL),
    r AS (SELECT conv_id, 'call-' || conv_id || '-' || (turn - 1) AS call_id, min({'turn': turn, 'text': text}) AS y,
                 count(*) AS n_results
          FROM conversations WHERE role = 'assistant' GROUP BY ALL),
    l AS (SELECT conv_id, call_id, 0 AS level FROM c WHERE NOT EXISTS (FROM c AS p WHERE p.call_id = c.parent)
          UNION ALL SELECT c.conv_id, c.call_id, l.level + 1 FROM l JOIN c ON c.parent = l.call_id),
    b AS (SELECT coalesce(c.conv_id, r.conv_id) AS conv_id, coalesce(c.call_id, r.call_id) AS call_id,
                 coalesce(x.turn, y.turn) AS turn, level, x IS NOT NULL AS called, x.text AS said, y.text AS result,
                 coalesce(n_calls, 0) AS n_calls, coalesce(n_results, 0) AS n_results,
                 CASE WHEN x IS NULL THEN 'no_call' WHEN y IS NULL THEN 'no_result' ELSE 'linked' END AS status
          FROM (c LEFT JOIN l USING (conv_id, call_id)) c FULL JOIN r USING (conv_id, call_id))
    SELECT conv_id, call_id, turn, level, n_calls, n_results, status,
           CASE WHEN called THEN length(coalesce(said, '')) > 0 END AS valid,
           sha256('{' || CASE WHEN called THEN '"arguments":' || CASE WHEN said IS NULL THEN '{' ELSE
               '{"text":' || to_json(said)::VARCHAR || ',' END || '"turn":' || turn || '},' ELSE '' END
               || '"id":' || to_json(call_id)::VARCHAR || CASE WHEN called THEN ',"level":' || level || ',"name":"reply"' ELSE '' END
               || CASE WHEN result IS NOT NULL THEN ',"result":' || to_json(result)::VARCHAR ELSE '' END
               || ',"status":"' || status || '"}') AS json_sha256
    FROM b""")
def op5(spark, sf_dir):
    """Every exchange of the conversations as a call linked to its result, in topological levels."""
    out = tool_calls.linked_calls(*tool_calls.exchanges(table(spark, sf_dir, "conversations")))
    return out.select("conv_id", "call_id", "turn", "level", "n_calls", "n_results", "status", "valid",
                      F.sha2("json", 256).alias("json_sha256"))


@query("op11_whitening")
def op11(spark, sf_dir):
    """Every usable embedding on the first four components of the different quantised ones."""
    vectors = table(spark, sf_dir, "embeddings")
    return whitening.whitened(vectors, whitening.fit(vectors, k=4))


@query("op12_quality")
def op12(spark, sf_dir):
    """Every document's quality by its statistics."""
    return quality.quality(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


@query("op13_alignment")
def op13(spark, sf_dir):
    """Every document's tokens by two tokenizers, aligned, with the corpus-wide counts of linked ids."""
    import public_tokenizers
    return alignment.aligned(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"),
                             public_tokenizers.path("piece_bpe_32k.model"))
