"""Queries: keyword, BM25, vector and hybrid search; the query text and vector are parameters."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from repoloom.functions.text import STOP_WORDS
from repoloom.operators import retrieval
from repoloom.session import table

QUERY = "where is the lease cache rebuilt and how does the parser handle an empty bucket"
RERANK_QUERY = "save_invoice segment limit parser"


def _docs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents")


def _query_vector(vectors: DataFrame) -> list[float]:
    """The vector with the lowest id stands for an embedded query text."""
    return [float(x) for x in vectors.orderBy("vec_id").select("embedding").first()[0]]


def keyword_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return retrieval.keyword_topk(_docs(spark, sf_dir), QUERY, 25)


def bm25_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return retrieval.bm25_topk(_docs(spark, sf_dir), QUERY, 25)


def bm25_postings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return retrieval.bm25_index(_docs(spark, sf_dir)).select("term", "doc_id", "tf", F.col("len").cast("bigint").alias("len"))


def l2_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = table(spark, sf_dir, "embeddings")
    return retrieval.l2_topk(v, _query_vector(v), 20)


def cosine_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = table(spark, sf_dir, "embeddings")
    return retrieval.cosine_topk(v, _query_vector(v), 20)


def cosine_filtered_pre(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The filter goes to the store: before the top k."""
    v = table(spark, sf_dir, "embeddings")
    return retrieval.cosine_topk(v.where("label = 3"), _query_vector(v), 20)


def l2_filtered_post(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The filter comes after the top k and may leave fewer."""
    v = table(spark, sf_dir, "embeddings")
    return retrieval.l2_topk(v, _query_vector(v), 100).join(v.select("vec_id", "label"), "vec_id").where("label = 3")


def nearest_many(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = table(spark, sf_dir, "embeddings")
    return retrieval.nearest_many(v.where("vec_id % 100 = 0"), v, 10)


def minmax_norm(spark: SparkSession, sf_dir: str) -> DataFrame:
    return retrieval.min_max(retrieval.bm25_topk(_docs(spark, sf_dir), QUERY, 25), "score", "scaled").select("doc_id", F.round("scaled", 6).alias("scaled"))


def hybrid_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = table(spark, sf_dir, "embeddings")
    return retrieval.hybrid_topk(_docs(spark, sf_dir), v, QUERY, _query_vector(v), 25)


def lexical_rerank(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _docs(spark, sf_dir)
    hits = retrieval.bm25_topk(docs, RERANK_QUERY, 50).join(docs.select("doc_id", "text"), "doc_id")
    return retrieval.lexical_rerank(hits, RERANK_QUERY, 20).select("doc_id", "score", "rerank_score")


def hybrid_search_full(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Filters, pool, fusion and rerank in the order of the search tool."""
    docs = retrieval.Filters(language="EN", path_prefix=None).apply(_docs(spark, sf_dir), language="lang")
    v = table(spark, sf_dir, "embeddings")
    fused = retrieval.hybrid_topk(docs, v, RERANK_QUERY, _query_vector(v), 20, pool=20, alpha=0.35)
    return retrieval.lexical_rerank(fused.join(docs.select("doc_id", "text"), "doc_id"), RERANK_QUERY, 5).select("doc_id", "score", "rerank_score")


QUERIES = {f.__name__: f for f in (hybrid_topk, keyword_topk, bm25_topk, bm25_postings, l2_topk, cosine_topk, cosine_filtered_pre, l2_filtered_post, nearest_many, minmax_norm, lexical_rerank, hybrid_search_full)}

_TOKENS = "list_transform(regexp_extract_all(coalesce(text, ''), '[A-Za-z0-9_]+'), lambda x: lower(x))"
_STOP = ", ".join(f"'{w}'" for w in STOP_WORDS)
_Q = "(SELECT embedding FROM embeddings ORDER BY vec_id LIMIT 1)"


def _bm25(query: str, source: str = "documents") -> str:
    terms = ", ".join(f"('{t}')" for t in dict.fromkeys(query.lower().replace("_", "_").split()))
    return f"""
        tok AS (SELECT doc_id, {_TOKENS} AS tokens FROM {source}), stats AS (SELECT count(*) AS n, avg(len(tokens)) AS a FROM tok), q(term) AS (VALUES {terms}),
        tf AS (SELECT doc_id, len(tokens) AS l, term, len(list_filter(tokens, lambda x: x = term)) AS tf FROM tok, q), df AS (SELECT term, count(*) AS df FROM tf WHERE tf > 0 GROUP BY term),
        bm AS (SELECT doc_id, sum(ln(1 + (n - df + 0.5) / (df + 0.5)) * tf / (tf + 1.5 * (0.25 + 0.75 * l / a))) AS b FROM tf JOIN df USING (term), stats WHERE tf > 0 GROUP BY doc_id)"""


def _hybrid(query: str, source: str, alpha: float, k: int) -> str:
    return f"""{_bm25(query, source)},
        vec AS (SELECT vec_id, round(1 / (1 + list_sum(list_transform(list_zip(embedding, {_Q}), lambda z: (z[1]::DOUBLE - z[2]) * (z[1]::DOUBLE - z[2])))), 6) AS s,
                       round(list_sum(list_transform(list_zip(embedding, {_Q}), lambda z: (z[1]::DOUBLE - z[2]) * (z[1]::DOUBLE - z[2]))), 6) AS d FROM embeddings),
        hit AS (SELECT vec_id AS doc_id, s FROM vec ORDER BY d, vec_id LIMIT 20),
        v AS (SELECT doc_id, CASE WHEN max(s) OVER () = min(s) OVER () THEN 1.0 ELSE (s - min(s) OVER ()) / (max(s) OVER () - min(s) OVER ()) END AS vs FROM hit),
        ball AS (SELECT d.doc_id, coalesce(b, 0) AS b FROM {source} d LEFT JOIN bm USING (doc_id)),
        bs AS (SELECT doc_id, CASE WHEN max(b) OVER () = min(b) OVER () THEN 1.0 ELSE (b - min(b) OVER ()) / (max(b) OVER () - min(b) OVER ()) END AS bs FROM ball),
        fused AS (SELECT doc_id, round(coalesce(vs, 0), 6) AS vector_score, round(bs, 6) AS bm25_score, round({alpha} * coalesce(vs, 0) + {1 - alpha} * bs, 6) AS score FROM bs LEFT JOIN v USING (doc_id) ORDER BY score DESC, doc_id LIMIT {k})"""


def _rerank(terms: list[str]) -> str:
    return " + ".join(f"(CASE WHEN contains(coalesce(text, ''), 'def {t}') OR contains(coalesce(text, ''), 'class {t}') THEN 2.0 ELSE 0 END) + (CASE WHEN contains(coalesce(text, ''), '{t}') THEN 0.5 ELSE 0 END)" for t in terms)


_L2 = f"list_sum(list_transform(list_zip(embedding, {_Q}), lambda z: (z[1]::DOUBLE - z[2]) * (z[1]::DOUBLE - z[2])))"
_COS = f"list_sum(list_transform(list_zip(embedding, {_Q}), lambda z: z[1]::DOUBLE * z[2])) / (sqrt(list_sum(list_transform(embedding, lambda x: x::DOUBLE * x))) * sqrt((SELECT list_sum(list_transform(embedding, lambda x: x::DOUBLE * x)) FROM embeddings WHERE vec_id = (SELECT min(vec_id) FROM embeddings))) + 1e-10)"
ORACLES = {
    "hybrid_topk": f"WITH {_hybrid(QUERY, 'documents', 0.5, 25)} SELECT * FROM fused",
    "keyword_topk": f"""
        SELECT doc_id, len(list_intersect({_TOKENS}, list_filter(string_split('{QUERY}', ' '), lambda x: x NOT IN ({_STOP}))))::INT AS score FROM documents ORDER BY score DESC, doc_id LIMIT 25""",
    "bm25_topk": f"WITH {_bm25(QUERY)} SELECT doc_id, round(b, 6) AS score FROM bm ORDER BY score DESC, doc_id LIMIT 25",
    "bm25_postings": f"SELECT term, doc_id, count(*) AS tf, any_value(l)::BIGINT AS len FROM (SELECT doc_id, len({_TOKENS}) AS l, unnest({_TOKENS}) AS term FROM documents) GROUP BY term, doc_id",
    "l2_topk": f"SELECT vec_id, round({_L2}, 6) AS distance, round(1 / (1 + {_L2}), 6) AS score FROM embeddings ORDER BY distance, vec_id LIMIT 20",
    "cosine_topk": f"SELECT vec_id, round({_COS}, 6) AS score FROM embeddings ORDER BY score DESC, vec_id LIMIT 20",
    "cosine_filtered_pre": f"SELECT vec_id, round({_COS}, 6) AS score FROM embeddings WHERE label = 3 ORDER BY score DESC, vec_id LIMIT 20",
    "l2_filtered_post": f"SELECT * FROM (SELECT vec_id, round({_L2}, 6) AS distance, round(1 / (1 + {_L2}), 6) AS score, label FROM embeddings ORDER BY distance, vec_id LIMIT 100) WHERE label = 3",
    "nearest_many": """
        SELECT query_id, vec_id, distance, rank::INT AS rank FROM (SELECT q.vec_id AS query_id, e.vec_id, round(list_sum(list_transform(list_zip(e.embedding, q.embedding), lambda z: (z[1]::DOUBLE - z[2]) * (z[1]::DOUBLE - z[2]))), 6) AS distance,
            row_number() OVER (PARTITION BY q.vec_id ORDER BY round(list_sum(list_transform(list_zip(e.embedding, q.embedding), lambda z: (z[1]::DOUBLE - z[2]) * (z[1]::DOUBLE - z[2]))), 6), e.vec_id) AS rank
            FROM embeddings q, embeddings e WHERE q.vec_id % 100 = 0) WHERE rank <= 10""",
    "minmax_norm": f"WITH {_bm25(QUERY)}, t AS (SELECT doc_id, round(b, 6) AS s FROM bm ORDER BY s DESC, doc_id LIMIT 25) SELECT doc_id, round((s - min(s) OVER ()) / (max(s) OVER () - min(s) OVER ()), 6) AS scaled FROM t",
    "lexical_rerank": f"""
        WITH {_bm25(RERANK_QUERY)}, t AS (SELECT doc_id, round(b, 6) AS score FROM bm ORDER BY score DESC, doc_id LIMIT 50)
        SELECT doc_id, score, ({_rerank(RERANK_QUERY.split())})::DOUBLE AS rerank_score FROM t JOIN documents USING (doc_id) ORDER BY rerank_score DESC, score DESC, doc_id LIMIT 20""",
    "hybrid_search_full": f"""
        WITH src AS (SELECT * FROM documents WHERE lower(lang) = 'en'), {_hybrid(RERANK_QUERY, 'src', 0.35, 20)}
        SELECT doc_id, score, ({_rerank(RERANK_QUERY.split())})::DOUBLE AS rerank_score FROM fused JOIN src USING (doc_id) ORDER BY rerank_score DESC, score DESC, doc_id LIMIT 5""",
}
