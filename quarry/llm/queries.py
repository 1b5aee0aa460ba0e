"""The thin queries of this subpackage, and SQL for those that DuckDB can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from quarry.llm import bpe, embdup, langid, minhash, mixing, pii, secrets, sharding, topk, toxicity
from quarry.llm.common import read

VOCABULARY = "word_bpe_49k.json"
N_SHARDS = 24


def vocabulary() -> str:
    import public_tokenizers

    return public_tokenizers.path(VOCABULARY)


def op1_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.encode(read(spark, sf_dir, "documents"), vocabulary(), with_ids=False)


def op2_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.taken(read(spark, sf_dir, "documents"))


def op3_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    return sharding.digest(sharding.write_shards(docs, N_SHARDS, sharding.default_path(docs)))


def op4_langid(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    return langid.identify(docs, langid.train(docs))


def op5_embdup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embdup.near_duplicates(read(spark, sf_dir, "embeddings"))


def op6_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.digest(pii.find(read(spark, sf_dir, "documents")))


def op7_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.digest(secrets.find(read(spark, sf_dir, "documents")))


def op8_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    return toxicity.scored(docs, toxicity.train(docs, read(spark, sf_dir, "labels")))


def op9_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash.near_duplicates(read(spark, sf_dir, "documents"))


def op10_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return topk.top_k(read(spark, sf_dir, "embeddings"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in (op1_bpe, op2_mixing, op3_sharding, op4_langid, op5_embdup, op6_pii, op7_secrets, op8_toxicity, op9_minhash, op10_topk)}


#: Each vertex reaches itself and, over links in both directions, others; its component is the least one.
REACH = "reach(id, root) AS (SELECT id, id FROM ids UNION SELECT l.b, r.root FROM reach r JOIN (SELECT a, b FROM links UNION ALL SELECT b, a FROM links) l ON l.a = r.id), comp AS (SELECT id, min(root) AS component_id FROM reach GROUP BY id)"

SQL = {
    "op5_embdup": f"WITH RECURSIVE v AS (SELECT vec_id, label, CAST(embedding AS DOUBLE[]) AS e FROM embeddings), links AS (SELECT x.vec_id AS a, y.vec_id AS b FROM v x JOIN v y ON x.label = y.label AND x.vec_id < y.vec_id WHERE list_cosine_similarity(x.e, y.e) >= 0.93), ids AS (SELECT vec_id AS id FROM v), {REACH}, n AS (SELECT id, count(*) AS n_links FROM (SELECT a AS id FROM links UNION ALL SELECT b FROM links) GROUP BY id) SELECT id AS vec_id, coalesce(n_links, 0) AS n_links, component_id, id = component_id AS kept FROM comp LEFT JOIN n USING (id)",
    "op9_minhash": rf"WITH RECURSIVE w AS (SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda t: t <> '') AS w FROM documents), s AS (SELECT doc_id, list_distinct(CASE WHEN len(w) < 5 THEN CASE WHEN len(w) = 0 THEN [] ELSE [array_to_string(w, ' ')] END ELSE list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' ')) END) AS s FROM w), x AS (SELECT doc_id, len(s) AS n, unnest(s) AS g FROM s), p AS (SELECT y.doc_id AS a, z.doc_id AS b, any_value(y.n) AS na, any_value(z.n) AS nb, count(*) AS c FROM x y JOIN x z ON y.g = z.g AND y.doc_id < z.doc_id GROUP BY ALL), links AS (SELECT a, b FROM p WHERE 100 * c >= 85 * (na + nb - c)), ids AS (SELECT doc_id AS id FROM documents), {REACH} SELECT doc_id, len(s) AS n_shingles, component_id, doc_id = component_id AS kept FROM s JOIN comp ON id = doc_id",
    "op10_topk": "WITH v AS (SELECT vec_id, list_transform(CAST(embedding AS DOUBLE[]), lambda x: CAST(floor(64 * x) AS BIGINT)) AS q FROM embeddings), p AS (SELECT a.vec_id AS query_id, b.vec_id, CAST(list_sum(list_transform(range(1, len(a.q) + 1), lambda i: a.q[i] * b.q[i])) AS BIGINT) AS score FROM v a JOIN v b ON a.vec_id <> b.vec_id AND a.vec_id % 20 = 0) SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank, vec_id, score FROM p QUALIFY rank <= 20",
}


def oracle_sql() -> dict[str, str]:
    """The other operators hash, train or tokenise as no SQL does; tests hold them against brute force."""
    return SQL
