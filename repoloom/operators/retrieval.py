"""Keyword, BM25, vector and hybrid retrieval over chunk or document tables."""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from repoloom.functions.text import keywords, words
from repoloom.session import cut, materialise, spread

K1, B = 1.5, 0.75
ALPHA = 0.5


@dataclass(frozen=True)
class Filters:
    """Metadata filters; a falsy one is no filter. Language and symbol kind ignore case, the prefix does not."""

    language: str | None = None
    path_prefix: str | None = None
    symbol_kind: str | None = None

    def apply(self, df: DataFrame, language: str = "language", path: str = "file_path", kind: str = "symbol_kind") -> DataFrame:
        if self.language:
            df = df.where(F.lower(language) == self.language.lower())
        if self.path_prefix:
            df = df.where(F.startswith(F.col(path), F.lit(self.path_prefix)))
        if self.symbol_kind:
            df = df.where(F.lower(kind) == self.symbol_kind.lower())
        return df


def keyword_topk(docs: DataFrame, query: str, k: int = 5, key: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``key, score``: shared distinct words with the query, ties by key; without query words the first ``k`` rows.

    ``k`` below 1 gives no row. Rows that share nothing still fill up the ``k``; a null text shares nothing.
    """
    if k < 1 or not query.strip():
        return docs.select(key, F.lit(0).alias("score")).limit(0)
    wanted = keywords(F.lit(query))
    score = F.coalesce(F.size(F.array_intersect(keywords(F.col(text_col)), wanted)), F.lit(0))
    return docs.select(key, F.greatest(score, F.lit(0)).alias("score")).orderBy(F.desc("score"), key).limit(k)


@dataclass(frozen=True)
class Postings:
    """An inverted index: ``term, key, tf, len`` and one row ``n, avg`` of corpus figures."""

    rows: DataFrame
    totals: DataFrame
    key: str = "doc_id"

    def save(self, path: str) -> Postings:
        """The index written to shared storage, its rows together by term, to be asked many times."""
        spark = self.rows.sparkSession
        self.rows.repartition(F.col("term")).sortWithinPartitions("term").write.mode("overwrite").parquet(f"{path}/rows")
        self.totals.write.mode("overwrite").parquet(f"{path}/totals")
        return Postings.load(spark, path, self.key)

    @staticmethod
    def load(spark: SparkSession, path: str, key: str = "doc_id") -> Postings:
        return Postings(spark.read.parquet(f"{path}/rows"), spark.read.parquet(f"{path}/totals"), key)


def _terms(query: str) -> list[str]:
    return list(dict.fromkeys(w.lower() for w in re.findall(r"[A-Za-z0-9_]+", query)))


def postings(docs: DataFrame, key: str = "doc_id", text_col: str = "text") -> Postings:
    """The index of a corpus, not yet computed; a null text has no tokens and length 0."""
    source = spread(docs.select(key, text_col), key)
    tokens = F.coalesce(words(F.col(text_col)), F.array().cast("array<string>"))
    tokenised = source.select(key, tokens.alias("tokens"))
    totals = tokenised.agg(F.count("*").alias("n"), F.avg(F.size("tokens")).alias("avg"))
    rows = tokenised.select(key, F.size("tokens").alias("len"), F.explode("tokens").alias("term")).groupBy("term", key).agg(F.count("*").alias("tf"), F.first("len").alias("len"))
    return Postings(rows, totals, key)


def bm25_scores(docs: DataFrame | Postings, query: str, key: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``key, score`` (score > 0) of every document with a query word: BM25 with k1 1.5, b 0.75 and the +1 idf.

    Plain lower-case word tokens. A repeated query word counts once. Lengths and averages are those of all rows. A
    stored index is read for the terms of the query only. Without one the texts are read once: the corpus figures are
    observed on the way, and only the counts of documents that have a word of the query are written.
    """
    terms = _terms(query)
    if not terms:
        source = docs.rows if isinstance(docs, Postings) else docs
        return source.select(docs.key if isinstance(docs, Postings) else key, F.lit(0.0).alias("score")).limit(0)
    if isinstance(docs, Postings):
        key = docs.key
        hits = docs.rows.where(F.col("term").isin(terms))
        figures = hits.groupBy("term").agg(F.count("*").alias("df")).crossJoin(F.broadcast(docs.totals))  # a row for each term of the query
        idf = F.log(1 + (F.col("n") - F.col("df") + 0.5) / (F.col("df") + 0.5))
        weights = figures.select("term", idf.alias("idf"), F.when(F.col("avg") > 0, F.col("avg")).otherwise(1.0).alias("avg"))
        gain = F.col("idf") * F.col("tf") / (F.col("tf") + K1 * (1 - B + B * F.col("len") / F.col("avg")))
        return hits.join(F.broadcast(weights), "term").groupBy(key).agg(F.sum(gain).alias("score")).where("score > 0")

    def times(term: str) -> Column:
        return F.size(F.filter("hits", lambda x: x == F.lit(term)))

    tokens = F.coalesce(words(F.col(text_col)), F.array().cast("array<string>"))
    split = spread(docs.select(key, text_col), key).select(key, tokens.alias("tokens"))
    counted = split.select(key, F.size("tokens").alias("len"), F.filter("tokens", lambda x: x.isin(terms)).alias("hits"))
    seen = Observation()
    observed = counted.observe(seen, F.count(F.lit(1)).alias("n"), F.sum(F.col("len").cast("double")).alias("all"))
    found = materialise(observed.where(F.size("hits") > 0).select(key, "len", *[times(t).alias(f"tf{i}") for i, t in enumerate(terms)]), "bm25-hits")
    n, average = seen.get["n"], (seen.get["all"] or 0.0) / max(1, seen.get["n"]) or 1.0
    having = found.agg(*[F.count_if(F.col(f"tf{i}") > 0).alias(f"df{i}") for i in range(len(terms))]).first()
    norm = K1 * (1 - B + B * F.col("len") / F.lit(float(average)))
    score: Column = F.lit(0.0)
    for i in range(len(terms)):
        idf = float(np.log(1 + (n - having[f"df{i}"] + 0.5) / (having[f"df{i}"] + 0.5)))
        score = score + F.lit(idf) * F.col(f"tf{i}") / (F.col(f"tf{i}") + norm)
    return found.select(key, score.alias("score")).where("score > 0")


def bm25_topk(docs: DataFrame | Postings, query: str, k: int = 20, key: str = "doc_id", text_col: str = "text") -> DataFrame:
    key = docs.key if isinstance(docs, Postings) else key
    return bm25_scores(docs, query, key, text_col).select(key, F.round("score", 6).alias("score")).orderBy(F.desc("score"), key).limit(k)


def bm25_index(docs: DataFrame, key: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Postings ``term, key, tf, len`` to be stored once for many queries; see :class:`Postings`."""
    return postings(docs, key, text_col).rows


def _dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y), F.lit(0.0), lambda s, v: s + v)


def _squared_distance(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: (x.cast("double") - y) * (x.cast("double") - y)), F.lit(0.0), lambda s, v: s + v)


def _vector(query: list[float]) -> Column:
    return F.array(*[F.lit(float(x)) for x in query])


def l2_topk(vectors: DataFrame, query: list[float], k: int = 10, key: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """``key, distance, score``: the ``k`` nearest by squared L2 distance, score 1 / (1 + distance), ties by key."""
    distance = _squared_distance(F.col(vector_col), _vector(query))
    scored = vectors.select(key, F.round(distance, 6).alias("distance"), F.round(1 / (1 + distance), 6).alias("score"))
    return scored.orderBy("distance", key).limit(k)


def cosine_topk(vectors: DataFrame, query: list[float], k: int = 10, key: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """``key, score``: cosine with 1e-10 added to the product of the norms; a query without length scores 0 everywhere."""
    length = float(np.linalg.norm(np.asarray(query, float)))
    v = F.col(vector_col)
    score = F.lit(0.0) if length < 1e-10 else _dot(v, _vector(query)) / (F.sqrt(_dot(v, v)) * length + 1e-10)
    return vectors.select(key, F.round(score, 6).alias("score")).orderBy(F.desc("score"), key).limit(k)


#: Bytes of query vectors that go to every task at once, and queries that are compared at once.
QUERY_BYTES, QUERY_BLOCK = 64 << 20, 1024


def nearest_many(queries: DataFrame, vectors: DataFrame, k: int = 10, key: str = "vec_id", vector_col: str = "embedding", query_bytes: int = QUERY_BYTES) -> DataFrame:
    """``query_id, key, distance, rank``: the ``k`` nearest rows of each query row, exact, ties by key.

    Query vectors go to the tasks in sets of at most ``query_bytes`` (their size is bounded by that, not by the data),
    one scan of the vectors for each set; a task compares block by block and keeps its ``k`` best of each query over
    all its rows, so that the shuffle carries ``k`` rows per query and task. Null vectors take no part.
    """
    ids = queries.select(F.col(key).alias("q"), F.col(vector_col).alias("v")).where("v is not null and q is not null")
    size = ids.agg(F.count("*").alias("n"), F.max(F.size("v")).alias("d")).first()
    sets = max(1, -(-size.n * 8 * (size.d or 1) // query_bytes))
    numbered = ids.withColumn("b", F.pmod(F.xxhash64("q"), F.lit(sets)))
    parts = []
    for b in range(sets):
        rows = numbered.where(F.col("b") == b).select("q", "v").collect()
        if not rows:
            continue
        names = np.array([r.q for r in rows], np.int64)
        matrix = np.array([r.v for r in rows], np.float64)

        def best(batches: Iterator[pa.RecordBatch], names=names, matrix=matrix) -> Iterator[pa.RecordBatch]:
            distance = np.full((len(names), 0), np.inf)
            found = np.zeros((len(names), 0), np.int64)
            for batch in batches:
                data = np.array(batch.column(1).to_pylist(), np.float64)
                if not len(data):
                    continue
                own = batch.column(0).to_numpy(zero_copy_only=False)
                new_distance, new_found = [], []
                for low in range(0, len(names), QUERY_BLOCK):
                    part = matrix[low : low + QUERY_BLOCK]
                    near = np.maximum((part**2).sum(1)[:, None] - 2 * part @ data.T + (data**2).sum(1)[None], 0)
                    near = np.concatenate([distance[low : low + QUERY_BLOCK], near], 1)
                    keys = np.concatenate([found[low : low + QUERY_BLOCK], np.broadcast_to(own, (len(part), len(own)))], 1)
                    top = np.lexsort((keys, np.round(near, 6)))[:, :k]
                    new_distance.append(np.take_along_axis(near, top, 1))
                    new_found.append(np.take_along_axis(keys, top, 1))
                distance, found = np.concatenate(new_distance), np.concatenate(new_found)
            q = np.repeat(names, found.shape[1])
            yield pa.RecordBatch.from_arrays([pa.array(q), pa.array(found.ravel()), pa.array(distance.ravel())], names=["query_id", key, "distance"])

        parts.append(vectors.select(key, vector_col).where(F.col(vector_col).isNotNull()).mapInArrow(best, f"query_id bigint, {key} bigint, distance double"))
    if not parts:
        return vectors.limit(0).select(F.col(key).alias("query_id"), key, F.lit(0.0).alias("distance"), F.lit(0).alias("rank"))
    union = parts[0]
    for p in parts[1:]:
        union = union.unionByName(p)
    w = Window.partitionBy("query_id").orderBy(F.round("distance", 6), key)
    return union.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k).select("query_id", key, F.round("distance", 6).alias("distance"), "rank")


def min_max(df: DataFrame, column: str, out: str) -> DataFrame:
    """Scores of hits scaled to 0..1 over all of them; all equal means 1. The hits are checkpointed, to be found once."""
    df = cut(df)
    low, high = df.agg(F.min(column), F.max(column)).first()
    if low is None or high == low:
        return df.withColumn(out, F.when(F.col(column).isNotNull(), F.lit(1.0)))
    return df.withColumn(out, (F.col(column) - F.lit(float(low))) / F.lit(float(high) - float(low)))


def hybrid_topk(docs: DataFrame, vectors: DataFrame, query: str, vector: list[float], k: int = 25, pool: int = 20, alpha: float = ALPHA, key: str = "doc_id", vector_key: str = "vec_id", text_col: str = "text", index: Postings | None = None) -> DataFrame:
    """``key, vector_score, bm25_score, score``: alpha times the vector leg plus the rest times the BM25 leg.

    The vector leg is scaled over its ``pool`` hits, the BM25 leg over all documents, of which those without a query
    word have 0; a missing leg counts 0. Ties go to the lower key. With a stored ``index`` no text is read. Only hits,
    the pool and the first ``k`` keys, which fill up where there are too few, can be among the best; the others are
    never brought together.
    """
    nearest = l2_topk(vectors, vector, pool, vector_key).select(F.col(vector_key).alias(key), F.col("score").alias("v_raw"))
    legs_v = min_max(nearest, "v_raw", "vector_score").select(key, "vector_score")
    found = bm25_scores(index or docs, query, key, text_col).select(key, F.col("score").alias("b_raw"))
    first = docs.select(key).orderBy(key).limit(k + pool)
    # the BM25 leg: where some document has no hit the least score is 0, and where none has one all are equal
    n = docs.agg(F.count("*").alias("n"))
    ends = found.agg(F.min("b_raw").alias("low"), F.max("b_raw").alias("high"), F.count("*").alias("hits")).crossJoin(F.broadcast(n)).select(F.when(F.col("hits") < F.col("n"), 0.0).otherwise(F.col("low")).alias("low"), F.coalesce("high", F.lit(0.0)).alias("high"))
    in_docs = docs.select(key).join(F.broadcast(legs_v), key)  # of the pool those that are documents
    one = lambda df, v, b: df.select(key, v.alias("vector_score"), b.alias("b_raw"))
    zero = F.lit(0.0)
    candidates = one(found, zero, F.col("b_raw")).unionAll(one(in_docs, F.col("vector_score"), zero)).unionAll(one(first, zero, zero))
    both = candidates.groupBy(key).agg(F.max("vector_score").alias("vector_score"), F.max("b_raw").alias("b_raw")).crossJoin(F.broadcast(ends))
    scaled = F.when(F.col("high") == F.col("low"), 1.0).otherwise((F.col("b_raw") - F.col("low")) / (F.col("high") - F.col("low")))
    both = both.withColumn("bm25_score", scaled)
    score = F.round(F.lit(alpha) * F.col("vector_score") + F.lit(1 - alpha) * F.col("bm25_score"), 6)
    return both.select(key, F.round("vector_score", 6).alias("vector_score"), F.round("bm25_score", 6).alias("bm25_score"), score.alias("score")).orderBy(F.desc("score"), key).limit(k)


def lexical_rerank(hits: DataFrame, query: str, k: int | None = None, key: str = "doc_id", text_col: str = "text", symbol_col: str | None = None, order_col: str = "score") -> DataFrame:
    """Hits again by how the query's identifiers occur: +3 as the symbol or a dotted part of it, +2 after ``def`` or
    ``class``, +0.5 anywhere; repeated identifiers count again; ties keep the order of ``order_col``, then of the key."""
    terms = [t for t in re.findall(r"[A-Za-z_][A-Za-z0-9_]*", query) if len(t) > 1]
    text = F.coalesce(F.col(text_col), F.lit(""))
    points: Column = F.lit(0.0)
    for t in terms:
        if symbol_col:
            parts = F.split(F.coalesce(F.col(symbol_col), F.lit("")), r"\.")
            points = points + F.when((F.col(symbol_col) == t) | F.array_contains(parts, t), 3.0).otherwise(0.0)
        points = points + F.when(F.contains(text, F.lit(f"def {t}")) | F.contains(text, F.lit(f"class {t}")), 2.0).otherwise(0.0)
        points = points + F.when(F.contains(text, F.lit(t)), 0.5).otherwise(0.0)
    out = hits.withColumn("rerank_score", points).orderBy(F.desc("rerank_score"), F.desc(order_col), key)
    return out.limit(k) if k else out
