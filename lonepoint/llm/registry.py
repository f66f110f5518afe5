"""The queries of this subpackage and the DuckDB SQL of those that SQL can express."""

from __future__ import annotations

import public_tokenizers

import corpus_pipeline
from lonepoint.llm import bpe, exact_dedup, html_extract, line_dedup, mixing, ngram_join, packing, quality, toxicity, vector_dedup
from lonepoint.llm.common import read

QUERIES, ORACLES = {}, {}


def query(f):
    QUERIES[f.__name__] = f
    return f


@query
def op1_line_dedup(spark, sf_dir):
    return line_dedup.deduplicated(read(spark, sf_dir, "documents"))


@query
def op2_line_crf(spark, sf_dir):
    return quality.score(read(spark, sf_dir, "documents"), read(spark, sf_dir, "labels"))


@query
def op3_byte_bpe(spark, sf_dir):
    docs = read(spark, sf_dir, "documents")
    return bpe.transcode(docs, public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN, ("n_tokens", "ids_sha256", "decoded_sha256"))


@query
def op4_token_packing(spark, sf_dir):
    docs = read(spark, sf_dir, "documents")
    return packing.pack(docs, public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN, end_id=50256)


@query
def op5_html_extract(spark, sf_dir):
    return html_extract.extract_pages(read(spark, sf_dir, "pages"))


@query
def op6_source_mix(spark, sf_dir):
    return mixing.amounts(read(spark, sf_dir, "documents"))


@query
def op7_exact_dedup(spark, sf_dir):
    return exact_dedup.exact_dedup(read(spark, sf_dir, "documents"))


ORACLES["op7_exact_dedup"] = r"""
WITH d AS (
    SELECT doc_id, coalesce(text, '') AS t, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]', '', 'g') AS k FROM documents
), g AS (
    SELECT k, count(*) AS group_size, first(doc_id ORDER BY length(t) DESC, doc_id NULLS LAST) AS keep_id FROM d GROUP BY k
)
SELECT d.doc_id, g.keep_id, g.group_size, d.doc_id IS NOT DISTINCT FROM g.keep_id AS kept, sha256(d.k) AS text_sha256
FROM d JOIN g USING (k)
"""


@query
def op8_toxicity(spark, sf_dir):
    return toxicity.score(read(spark, sf_dir, "documents"), read(spark, sf_dir, "labels"))


@query
def op9_ngram_join(spark, sf_dir):
    return ngram_join.near_duplicates(read(spark, sf_dir, "documents"))


#: All pairs that share a shingle, in full.
ORACLES["op9_ngram_join"] = r"""
WITH RECURSIVE d AS (
    SELECT doc_id, list_filter(regexp_split_to_array(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda w: w <> '') AS w FROM documents
), s AS (
    SELECT DISTINCT doc_id, unnest(CASE WHEN len(w) < 5 THEN [w] ELSE list_transform(range(1, len(w) - 3), lambda i: w[i:i + 4]) END) AS g FROM d WHERE len(w) > 0
), n AS (
    SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id
), p AS (
    SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS shared FROM s a JOIN s b ON a.g = b.g AND a.doc_id <> b.doc_id GROUP BY ALL
), l AS (
    SELECT a, b FROM p JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 5 * shared >= 4 * (x.n + y.n - shared)
), r AS (
    SELECT doc_id AS a, doc_id AS c FROM documents UNION SELECT l.b, r.c FROM r JOIN l ON l.a = r.a
), c AS (
    SELECT a AS doc_id, min(c) AS class_id FROM r GROUP BY a
)
SELECT doc_id, class_id, (SELECT count(*) FROM l WHERE l.a = c.doc_id) AS n_links, doc_id = class_id AS kept FROM c
"""


@query
def op10_vector_dedup(spark, sf_dir):
    return vector_dedup.near_duplicates(read(spark, sf_dir, "embeddings"))


ORACLES["op10_vector_dedup"] = r"""
WITH RECURSIVE v AS (
    SELECT vec_id, label, embedding::DOUBLE[] AS x FROM embeddings
    WHERE label IS NOT NULL AND embedding IS NOT NULL AND list_count(embedding) = len(embedding)
      AND NOT list_contains(list_transform(embedding, lambda z: isfinite(z)), false) AND list_contains(list_transform(embedding, lambda z: z <> 0), true)
), n AS (
    SELECT *, sqrt(list_sum(list_transform(x, lambda z: z * z))) AS s FROM v
), l AS (
    SELECT a.vec_id AS a, b.vec_id AS b FROM n a JOIN n b ON a.label = b.label AND a.vec_id <> b.vec_id AND len(a.x) = len(b.x)
    WHERE list_sum(list_transform(list_zip(a.x, b.x), lambda z: z[1] * z[2])) / (a.s * b.s) >= 0.93
), r AS (
    SELECT vec_id AS a, vec_id AS c FROM embeddings UNION SELECT l.b, r.c FROM r JOIN l ON l.a = r.a
), c AS (
    SELECT a AS vec_id, min(c) AS component_id FROM r GROUP BY a
)
SELECT vec_id, (SELECT count(*) FROM l WHERE l.a = c.vec_id) AS n_links, component_id, vec_id = component_id AS kept FROM c
"""


QUERIES["pipeline"] = corpus_pipeline.run
if corpus_pipeline.ORACLE_SQL:
    ORACLES["pipeline"] = corpus_pipeline.ORACLE_SQL
