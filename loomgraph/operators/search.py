"""Retrieval over texts and vectors: BM25, cosine nearest neighbours and their fusion."""

from __future__ import annotations

from collections.abc import Callable
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

K1, B = 1.2, 0.75
#: Queries that are compared with all rows at a time; what is broadcast is at most this many vectors.
QUERY_BLOCK = 8000


def hashed_embedding(text: str, size: int = 128) -> np.ndarray:
    """A deterministic embedding without a model: signed hashed words, scaled to length one (zeros for no words)."""
    import re
    import zlib

    v = np.zeros(size)
    for w in re.findall(r"[^\W_]+", (text or "").lower()):
        h = zlib.crc32(w.encode())
        v[h % size] += 1 if h & 0x80000000 else -1
    n = np.linalg.norm(v)
    return v / n if n else v


@lru_cache(maxsize=256)
def embed_query(text: str, size: int = 128) -> tuple[float, ...]:
    """The embedding of a query, kept for the latest 256."""
    return tuple(hashed_embedding(text, size))


def embed(rows: DataFrame, text: str, size: int = 128, model: Callable[[list[str]], np.ndarray] | None = None) -> DataFrame:
    """``rows`` with ``vector``, the embedding of a text column; null texts are embedded as empty.

    ``model`` gives a row of numbers for each of a batch of texts; it is called on the executors, so it has to be
    picklable. Without one, words are hashed.
    """

    @F.pandas_udf("array<float>")
    def vector(texts: pd.Series) -> pd.Series:
        if model is not None:
            return pd.Series(list(np.asarray(model(texts.tolist()), np.float32)), index=texts.index)
        return texts.map(lambda t: hashed_embedding(t, size).astype(np.float32))

    return rows.withColumn("vector", vector(F.coalesce(text, F.lit(""))))


def tokens(text: Column) -> Column:
    """The words of a text in lower case; cut first, as lower case may part letters into marks."""
    return F.transform(F.regexp_extract_all(text, F.lit(r"(\p{L}+)"), 1), F.lower)


def cosine(a: Column, b: Column) -> Column:
    """Cosine of two arrays of numbers of equal size; null where one has no length or sizes differ."""
    dot = F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)
    norm = lambda v: F.sqrt(F.aggregate(v, F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double")))
    length = norm(a) * norm(b)
    return F.when((F.size(a) == F.size(b)) & (length > 0), dot / length)


def knn(rows: DataFrame, queries: DataFrame, key: str, vector: str, k: int, exclude_self: bool = True) -> DataFrame:
    """(query_id, id, similarity, rank): the k rows with the greatest cosine for each query row.

    A stated set of queries against all rows, in blocks: the queries of a block (at most ``QUERY_BLOCK``) are broadcast as
    one matrix, each task keeps its k best for each query, and only those are shuffled. Similarity is rounded to 6
    decimals; equal values go to the smaller id. Vectors that are null, of another size than the
    block's first, not finite or of no length are passed over.
    """
    spark = rows.sparkSession
    usable = F.col(vector).isNotNull() & F.col(key).isNotNull()
    rows = rows.where(usable).select(F.col(key).cast("bigint").alias("id"), F.col(vector).alias("v"))
    out = None
    for block in _blocks(queries.where(usable).select(F.col(key).cast("bigint").alias("id"), F.col(vector).alias("v"))):
        size = len(block[0]["v"])
        block = [r for r in block if len(r["v"]) == size]
        q = np.array([r["v"] for r in block], np.float64)
        norms = np.linalg.norm(q, axis=1)
        good = np.isfinite(norms) & (norms > 0)
        shared = spark.sparkContext.broadcast((np.array([r["id"] for r in block])[good], q[good] / norms[good][:, None]))

        def scan(batches):
            ids, matrix = shared.value
            best: list[pd.DataFrame] = []
            for pdf in batches:
                pdf = pdf[[len(v) == matrix.shape[1] for v in pdf["v"]]]
                if not len(pdf):
                    continue
                v = np.stack(pdf["v"].to_numpy()).astype(np.float64)
                n = np.linalg.norm(v, axis=1)
                keep = np.isfinite(n) & (n > 0)
                own = pdf["id"].to_numpy()[keep]
                s = np.round(matrix @ (v[keep] / n[keep][:, None]).T, 6)
                if exclude_self:
                    s[ids[:, None] == own[None, :]] = -2
                m = min(k, s.shape[1])
                if m == 0:
                    continue
                edge = -np.partition(-s, m - 1, axis=1)[:, m - 1 : m]
                a, b = np.nonzero((s >= edge) & (s > -2))
                best.append(pd.DataFrame({"query_id": ids[a], "id": own[b], "similarity": s[a, b]}))
                best = [_top(pd.concat(best), k)]
            yield from best

        found = rows.mapInPandas(scan, "query_id bigint, id bigint, similarity double")
        out = found if out is None else out.unionByName(found)
    if out is None:
        return spark.createDataFrame([], "query_id long, id long, similarity double, rank int")
    order = Window.partitionBy("query_id").orderBy(F.col("similarity").desc(), "id")
    return out.distinct().withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def _top(rows: pd.DataFrame, k: int) -> pd.DataFrame:
    rows = rows.drop_duplicates().sort_values(["query_id", "similarity", "id"], ascending=[True, False, True], kind="stable")
    return rows[rows.groupby("query_id").cumcount() < k]


def _blocks(queries: DataFrame):
    block = []
    for r in queries.orderBy("id").toLocalIterator():
        block.append(r)
        if len(block) == QUERY_BLOCK:
            yield block
            block = []
    if block:
        yield block


def _count(words: str, term: str) -> Column:
    """How often a term is among the words."""
    return F.size(F.filter(words, lambda x: x == F.lit(term)))


def bm25(documents: DataFrame, key: str, text: str, terms: list[str], k: int | None = None) -> DataFrame:
    """(key, score): Okapi BM25 of a query's terms, rounded to 6 decimals; only texts with a term, the k best if given.

    Document frequencies and lengths are of all texts. Only counts of the query's terms leave the scan; no
    text's words are shuffled. Null texts count as empty.
    """
    terms = list(dict.fromkeys(t.lower() for t in terms))
    words = tokens(F.coalesce(text, F.lit("")))
    rows = documents.select(F.col(key), words.alias("w")).select(key, F.size("w").alias("len"), *[_count("w", t).alias(f"tf{i}") for i, t in enumerate(terms)])
    # One row of statistics, which every score needs.
    stats = rows.agg(F.count("*").alias("n"), F.avg("len").alias("avg"), *[F.sum((F.col(f"tf{i}") > 0).cast("bigint")).alias(f"df{i}") for i in range(len(terms))]).first()
    n, average = F.lit(stats["n"]), F.lit(float(stats["avg"] or 1))
    score = F.lit(0.0)
    for i in range(len(terms)):
        tf, df = F.col(f"tf{i}"), F.lit(stats[f"df{i}"] or 0)
        idf = F.log(1 + (n - df + 0.5) / (df + 0.5))
        score = score + F.when(tf > 0, idf * tf * (K1 + 1) / (tf + K1 * (1 - B + B * F.col("len") / average))).otherwise(0.0)
    scored = rows.select(key, F.round(score, 6).alias("score")).where("score > 0")
    return scored.orderBy(F.col("score").desc(), key).limit(k) if k else scored


def postings(documents: DataFrame, key: str, text: str) -> DataFrame:
    """(term, key, tf, len): an inverted index: how often each word is in each text, and the text's words. Texts without words have no row."""
    words = documents.select(key, tokens(F.coalesce(text, F.lit(""))).alias("w")).select(key, F.size("w").alias("len"), F.explode("w").alias("term"))
    return words.groupBy("term", key, "len").agg(F.count("*").alias("tf")).select("term", key, "tf", "len")


def bm25_index(index: DataFrame, key: str, terms: list[str], texts: int, words: int, k: int | None = None) -> DataFrame:
    """``bm25`` from ``postings``, of ``texts`` texts with ``words`` words in all: only the terms' postings are read."""
    terms = list(dict.fromkeys(t.lower() for t in terms))
    own = index.where(F.col("term").isin(*terms))
    idf = own.groupBy("term").agg(F.count("*").alias("df")).select("term", F.log(1 + (texts - F.col("df") + 0.5) / (F.col("df") + 0.5)).alias("idf"))
    average = words / max(texts, 1) or 1.0
    part = F.col("idf") * F.col("tf") * (K1 + 1) / (F.col("tf") + K1 * (1 - B + B * F.col("len") / average))
    # A row a term of the query.
    scored = own.join(F.broadcast(idf), "term").groupBy(key).agg(F.round(F.sum(part), 6).alias("score")).where("score > 0")
    return scored.orderBy(F.col("score").desc(), key).limit(k) if k else scored


def fuse(dense: DataFrame, sparse: DataFrame, key: str, alpha: float = 0.5, k: int = 5) -> DataFrame:
    """(key, score): the k best of alpha x dense + (1 - alpha) x sparse score, each scaled to 0..1 over its own results.

    A row that only one side found has 0 on the other; where all scores of a side are equal they scale to 1.
    """

    def scaled(rows: DataFrame, name: str) -> DataFrame:
        low, high = F.min("score").over(Window.partitionBy()), F.max("score").over(Window.partitionBy())
        return rows.select(key, F.when(high > low, (F.col("score") - low) / (high - low)).otherwise(1.0).alias(name))

    both = scaled(dense, "d").join(scaled(sparse, "s"), key, "full_outer")
    score = F.round(F.lit(alpha) * F.coalesce("d", F.lit(0.0)) + F.lit(1 - alpha) * F.coalesce("s", F.lit(0.0)), 6)
    return both.select(key, score.alias("score")).orderBy(F.col("score").desc(), key).limit(k)


def snippet(chunks: DataFrame, symbol: str) -> DataFrame:
    """The chunk that a symbol means: by name, by its last part, by the end of an id, or by a part of a name; one row, ties by id."""
    clean = symbol.split(".")[-1].split("::")[-1]
    rank = F.when(F.col("name") == symbol, 1).when(F.col("name") == clean, 2).when(F.col("node_id").endswith("::" + symbol), 3).when(F.lower("name").contains(clean.lower()), 4)
    return chunks.withColumn("match", rank).where("match is not null").orderBy("match", "node_id").limit(1)
