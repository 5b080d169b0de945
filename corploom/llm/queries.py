"""Registered queries of this subpackage, each over its whole table with production parameters, and their SQL."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corploom.llm import langid, quality, toxicity
from corploom.llm.ann import nearest
from corploom.llm.chat import rotate
from corploom.llm.divergence import divergence
from corploom.llm.jaccard import near_duplicates
from corploom.llm.mixing import mix
from corploom.llm.packing import pack_documents
from corploom.llm.piece_bpe import decode, encode
from corploom.llm.pq import near_vectors
from corploom.llm.scratch import Scratch
from corploom.llm.tokencount import token_counts
from corploom.llm.whitening import whiten


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_quality_qda(spark: SparkSession, sf_dir: str) -> DataFrame:
    with Scratch(spark, "quality") as scratch:
        return quality.score(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"), scratch)


def op2_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    with Scratch(spark, "mixing") as scratch:
        return mix(_table(spark, sf_dir, "documents"), scratch).select("doc_id", "size", "source_size", "target", "taken")


def op3_ngram_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(_table(spark, sf_dir, "documents"), width=3, threshold="0.9")


def op4_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    with Scratch(spark, "langid") as scratch:
        return langid.identify_pages(_table(spark, sf_dir, "pages"), _table(spark, sf_dir, "documents"), scratch)


def op5_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    with Scratch(spark, "packing") as scratch:
        return pack_documents(_table(spark, sf_dir, "documents"), scratch, public_tokenizers.path("byte_bpe_50k.json"))


def op6_toxic_segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    return toxicity.score(docs, toxicity.fit(docs, _table(spark, sf_dir, "labels")))


def op7_pq_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    with Scratch(spark, "pq") as scratch:
        return near_vectors(_table(spark, sf_dir, "embeddings"), scratch)


def op8_chat_rotation(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rotate(_table(spark, sf_dir, "conversations"))


def op9_trie_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts(_table(spark, sf_dir, "documents"), public_tokenizers.path("piece_bpe_32k.model"))


def op10_collision_ann(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = _table(spark, sf_dir, "embeddings")
    with Scratch(spark, "ann") as scratch:
        return nearest(vectors, vectors.where("vec_id % 100 = 0"), scratch)


def op11_piece_encoding(spark: SparkSession, sf_dir: str) -> DataFrame:
    model = public_tokenizers.path("piece_bpe_32k.model")
    rows = decode(encode(_table(spark, sf_dir, "documents"), model), model)
    return rows.select("doc_id", (F.octet_length("ids") / 4).cast("long").alias("n_tokens"), F.sha2("ids", 256).alias("ids_sha256"), F.sha2("text", 256).alias("decoded_sha256"))


def op12_source_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    with Scratch(spark, "divergence") as scratch:
        return divergence(_table(spark, sf_dir, "documents"), scratch)


def op13_embedding_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    with Scratch(spark, "whitening") as scratch:
        return whiten(_table(spark, sf_dir, "embeddings"), scratch)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_quality_qda": op1_quality_qda,
        "op2_source_mixing": op2_source_mixing,
        "op3_ngram_jaccard": op3_ngram_jaccard,
        "op4_language_id": op4_language_id,
        "op5_best_fit_packing": op5_best_fit_packing,
        "op6_toxic_segments": op6_toxic_segments,
        "op7_pq_near_dedup": op7_pq_near_dedup,
        "op8_chat_rotation": op8_chat_rotation,
        "op9_trie_token_counts": op9_trie_token_counts,
        "op10_collision_ann": op10_collision_ann,
        "op11_piece_encoding": op11_piece_encoding,
        "op12_source_divergence": op12_source_divergence,
        "op13_embedding_whitening": op13_embedding_whitening,
    }


_OP2 = r"""
WITH rows_ AS (
  SELECT doc_id, source, CAST(coalesce(length(regexp_replace(regexp_replace(text, '[^\x20\x09-\x0D]+', chr(1), 'g'), '[\x20\x09-\x0D]+', '', 'g')), 0) AS BIGINT) AS size,
         ('0x' || substr(md5(coalesce(CAST(doc_id AS VARCHAR), '\N') || '|' || coalesce(text, '\N')), 1, 15))::BIGINT AS h,
         row_number() OVER (PARTITION BY source, doc_id, text) - 1 AS number
  FROM documents),
sized AS (SELECT doc_id, source, size, CASE WHEN number = 0 THEN h ELSE ('0x' || substr(md5(h || '|' || number), 1, 15))::BIGINT END AS h FROM rows_),
sources AS (
  SELECT source, CAST(sum(size) AS BIGINT) AS source_size,
         CAST((row_number() OVER (ORDER BY encode(source) NULLS LAST) - 1) % 3 + 1 AS DOUBLE) AS weight
  FROM sized GROUP BY source),
limited AS (SELECT *, CAST(source_size AS DOUBLE) * 3 AS cap, sum(CAST(source_size AS DOUBLE)) OVER () AS total FROM sources),
levels AS (
  SELECT *, (total - coalesce(sum(cap) OVER (ORDER BY cap / weight, encode(source) NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))
            / sum(weight) OVER (ORDER BY cap / weight, encode(source) NULLS LAST ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level FROM limited),
final AS (SELECT *, arg_min(CASE WHEN cap >= level * weight THEN level END, CASE WHEN cap >= level * weight THEN cap / weight END) OVER () AS fin FROM levels),
shares AS (SELECT source, source_size, CASE WHEN fin IS NULL OR cap < fin * weight THEN cap ELSE fin * weight END AS target FROM final),
budgets AS (SELECT *, CASE WHEN source_size > 0 THEN CAST(floor(target / source_size) AS BIGINT) ELSE 0 END AS passes FROM shares),
ranked AS (
  SELECT s.doc_id, s.size, b.source_size, b.target, b.passes, CAST(floor(b.target) AS BIGINT) - b.passes * b.source_size AS budget,
         sum(s.size) OVER (PARTITION BY s.source ORDER BY s.h RANGE BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS upto
  FROM sized s JOIN budgets b ON s.source IS NOT DISTINCT FROM b.source)
SELECT doc_id, size, source_size, target, CAST(size * least(passes + CASE WHEN upto <= budget THEN 1 ELSE 0 END, 3) AS BIGINT) AS taken FROM ranked
"""


_OP8 = r"""
WITH r AS (SELECT conv_id, turn, CASE WHEN trim(role) <> '' THEN trim(role) END AS speaker, coalesce(text, '') AS text FROM conversations),
people AS (SELECT DISTINCT conv_id AS c, speaker AS perspective FROM r WHERE speaker IS NOT NULL AND speaker <> 'system'),
placed AS (
  SELECT r.*, perspective, coalesce(speaker = perspective, false) AS own,
         CASE WHEN speaker = perspective THEN 'assistant' WHEN speaker = 'system' THEN 'system' ELSE 'user' END AS role
  FROM r JOIN people ON conv_id IS NOT DISTINCT FROM c),
named AS (SELECT *, CASE WHEN role = 'user' THEN coalesce(speaker, 'unknown') END AS name FROM placed),
rendered AS (SELECT *, '<|' || role || '|>' || coalesce('name=' || name, '') || chr(10) || text || '<|end|>' || chr(10) AS rendered FROM named)
SELECT conv_id, perspective, CAST(row_number() OVER w - 1 AS INTEGER) AS position, turn, role, name, rendered,
       CAST(coalesce(sum(length(rendered)) OVER (PARTITION BY conv_id, perspective ORDER BY turn NULLS FIRST, speaker NULLS FIRST, text ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS start,
       CAST(own AS INTEGER) AS mask
FROM rendered WINDOW w AS (PARTITION BY conv_id, perspective ORDER BY turn NULLS FIRST, speaker NULLS FIRST, text)
"""


_OP12 = r"""
WITH d AS (SELECT coalesce(lang, '') AS lang, coalesce(source, '') AS source, row_number() OVER () AS doc,
                  regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x40\x5B-\x60\x7B-\x7F]+') AS ts FROM documents),
w AS (SELECT lang, source, doc, unnest(ts) AS term FROM d),
v AS (SELECT lang, term, count(*) AS n FROM w GROUP BY 1, 2 HAVING count(DISTINCT doc) >= 3),
vs AS (SELECT lang, count(*) AS v, sum(n) AS n FROM v GROUP BY 1),
g AS (SELECT DISTINCT lang, source FROM d),
c AS (SELECT lang, source, term, count(*) AS n FROM w SEMI JOIN v USING (lang, term) GROUP BY 1, 2, 3),
gn AS (SELECT g.lang, g.source, coalesce(sum(n), 0) AS n FROM g LEFT JOIN c USING (lang, source) GROUP BY 1, 2),
p AS (SELECT gn.lang, gn.source, v.term, coalesce(c.n, 0) AS n, CAST(1 + (1000000000::HUGEINT * (coalesce(c.n, 0) + 1)) // (gn.n + vs.v) AS HUGEINT) AS p,
             CAST(1 + (1000000000::HUGEINT * (v.n + 1)) // (vs.n + vs.v) AS HUGEINT) AS q
      FROM gn JOIN vs USING (lang) JOIN v USING (lang) LEFT JOIN c ON c.lang = gn.lang AND c.source = gn.source AND c.term = v.term),
pairs AS (SELECT a.lang, a.source, b.source AS item, sum((a.p - b.p) * (a.p - b.p) // b.p) AS value FROM p a JOIN p b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY 1, 2, 3),
allpairs AS (SELECT a.lang, a.source, b.source AS item, CAST(coalesce(value, 0) AS BIGINT) AS value FROM g a JOIN g b ON a.lang = b.lang AND a.source <> b.source
             LEFT JOIN pairs ON pairs.lang = a.lang AND pairs.source = a.source AND pairs.item = b.source),
single AS (SELECT lang, source, term AS item, CAST((p - q) * (p - q) // q AS BIGINT) AS value FROM p WHERE n > 0 AND p > q)
SELECT lang, source, 'pair' AS part, item, value, CAST(row_number() OVER (PARTITION BY lang, source ORDER BY value DESC, encode(item)) AS INTEGER) AS rank FROM allpairs
UNION ALL
SELECT lang, source, 'term', item, value, CAST(row_number() OVER (PARTITION BY lang, source ORDER BY value DESC, encode(item)) AS INTEGER) AS rank FROM single QUALIFY rank <= 200
"""


def oracle_sql() -> dict[str, str]:
    return {"op12_source_divergence": _OP12, "op2_source_mixing": _OP2, "op8_chat_rotation": _OP8}
