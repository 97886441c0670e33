"""Vector, lexical and hybrid search, and retrieval metrics. vectors: id, embedding. nodes as in graph.py, with text."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from codeweft.functions import exprs as E

#: Vectors of a block: a task holds one of queries and one of vectors.
BLOCK = 20_000
#: Folders that stored postings lie in, by a hash of the term.
BUCKETS = 64
WORD = r"((?U)\w+)"
RRF, LEXICAL_WEIGHT = 60, 0.4


def knn(vectors: DataFrame, query: list[float], k: int) -> DataFrame:
    """id, dist of the k nearest to one vector."""
    q = F.array(*[F.lit(float(x)) for x in query])
    return vectors.where("embedding is not null").select("id", F.round(E.cosine_distance(F.col("embedding"), q), 6).alias("dist")).orderBy("dist", "id").limit(k)


def _matrix(column: pa.ChunkedArray) -> np.ndarray:
    """Unit vectors in double precision; a zero vector stays zero."""
    rows = column.combine_chunks()
    rows = rows.chunk(0) if isinstance(rows, pa.ChunkedArray) else rows
    m = rows.flatten().to_numpy(zero_copy_only=False).astype(float).reshape(len(rows), -1)
    return m / np.maximum(np.linalg.norm(m, axis=1, keepdims=True), 1e-300)


def _nearest(k: int):
    def nearest(q, v):
        if not q.num_rows or not v.num_rows:
            return pa.table({"a": pa.array([], pa.string()), "b": pa.array([], pa.string()), "dist": pa.array([], pa.float64())})
        v = v.sort_by("v_id")
        ids, m, own = v["v_id"].to_numpy(zero_copy_only=False).astype(str), _matrix(v["v_vector"]), q["q_id"].to_numpy(zero_copy_only=False).astype(str)
        x, found = _matrix(q["q_vector"]), [[], [], []]
        for at in range(0, len(x), 512):
            d = np.round(1 - x[at : at + 512] @ m.T, 6)
            d[ids[None, :] == own[at : at + 512, None]] = np.inf
            top = np.argsort(d, axis=1, kind="stable")[:, :k]
            row = np.repeat(np.arange(len(top)), top.shape[1])
            near = d[row, top.ravel()]
            keep = np.isfinite(near)
            for out, values in zip(found, (own[at : at + 512][row], ids[top.ravel()], near)):
                out.append(values[keep])
        return pa.table({c: pa.array(np.concatenate(f)) for c, f in zip(("a", "b", "dist"), found)})

    return nearest


def knn_join(queries: DataFrame, vectors: DataFrame, k: int, block: int = BLOCK) -> DataFrame:
    """a, b, dist, rank: the k nearest vectors of each query, itself left out. Exact: blocks of queries meet blocks of
    vectors in tasks, by matrix products, so no task (nor the driver) holds more than a block of each, and no pair beyond
    the k best of a block is written. Both are dealt by hash; each travels once for each block of the other.

    Null vectors are left out; a zero vector is at distance 1 from all."""
    q, v = (x.where("embedding is not null").select(F.col("id").alias(f"{c}_id"), F.col("embedding").alias(f"{c}_vector")) for c, x in (("q", queries), ("v", vectors)))
    n_q, n_v = (max(1, -(-x.count() // block)) for x in (q, v))
    # enough tasks for all cores even if there are few vectors: smaller blocks of queries
    n_q = max(n_q, min(-(-vectors.sparkSession.sparkContext.defaultParallelism // n_v), 64))
    own = lambda c, n: F.pmod(F.xxhash64(c), F.lit(n)).cast("int")
    each = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    left = q.select("*", own("q_id", n_q).alias("q_i"), each(n_v).alias("q_j")).groupBy("q_i", "q_j")
    right = v.select("*", own("v_id", n_v).alias("v_j"), each(n_q).alias("v_i")).groupBy("v_i", "v_j")
    found = left.cogroup(right).applyInArrow(_nearest(k), "a string, b string, dist double")
    return found.withColumn("rank", F.row_number().over(Window.partitionBy("a").orderBy("dist", "b"))).where(F.col("rank") <= k)


def postings(texts: DataFrame) -> DataFrame:
    """term, id, tf of all words of three letters or more: what lexical() needs of the texts. Stored (see Store), a
    question reads its own terms only."""
    words = texts.select("id", F.explode(F.filter(F.regexp_extract_all(F.lower("text"), F.lit(WORD), F.lit(1)), lambda w: F.length(w) >= 3)).alias("term"))
    return words.groupBy("term", "id").agg(F.count("*").alias("tf"))


def question_terms(question: str) -> Column:
    return F.array_distinct(F.filter(F.regexp_extract_all(F.lit(question.lower()), F.lit(WORD), F.lit(1)), lambda w: F.length(w) >= 3))


def lexical(texts: DataFrame, question: str, limit: int, stored: DataFrame | None = None) -> DataFrame:
    """id, score: any of the question's words; sum of tf * ln(1 + N / df), highest first. texts: id, text. stored:
    postings() of the texts, instead of their words."""
    terms = question_terms(question)
    if stored is None:
        asked = F.filter(F.regexp_extract_all(F.lower("text"), F.lit(WORD), F.lit(1)), lambda w: F.array_contains(terms, w))
        tf = texts.select("id", F.explode(asked).alias("term")).groupBy("id", "term").agg(F.count("*").alias("tf"))
    else:
        asked = [r[0] for r in texts.sparkSession.range(1).select(F.explode(terms)).collect()]  # a question's words
        tf = stored.where(F.col("term").isin(asked))
        tf = (tf.where(F.col("bucket").isin(_buckets(texts, asked))) if "bucket" in stored.columns else tf).select("id", "term", "tf")
    df = tf.groupBy("term").agg(F.count("*").alias("df"))
    n = texts.agg(F.count("*").alias("n"))
    scored = tf.join(F.broadcast(df), "term").join(F.broadcast(n)).groupBy("id").agg(F.round(F.sum(F.col("tf") * F.log(1 + F.col("n") / F.col("df"))), 6).alias("score"))
    return scored.orderBy(F.desc("score"), "id").limit(limit)


def bucket_of(term: Column) -> Column:
    return F.pmod(F.xxhash64(term), F.lit(BUCKETS)).cast("int")


def _buckets(df: DataFrame, terms: list[str]) -> list[int]:
    if not terms:
        return []
    found = df.sparkSession.range(1).select(F.explode(F.array(*map(F.lit, terms))).alias("t")).select(bucket_of(F.col("t")))
    return sorted({r[0] for r in found.collect()})


def fuse(rankings: list[tuple[DataFrame, float, list[Column]]], constant: int = RRF) -> DataFrame:
    """id, score by reciprocal ranks: sum of weight / (constant + rank from 0)."""
    parts = [r.withColumn("rank", F.row_number().over(Window.orderBy(*order)) - 1).select("id", (F.lit(w) / (constant + F.col("rank"))).alias("part")) for r, w, order in rankings]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out.groupBy("id").agg(F.sum("part").alias("score"))


def search(nodes: DataFrame, vectors: DataFrame, query: list[float], question: str = "", k: int = 8, cand: int = 60, test_penalty: float = 0.5, drop_generic: bool = True, kind: str = "all", hybrid: bool = False, reranker=None, stored: DataFrame | None = None) -> DataFrame:
    """id, label, file_type, source_file, score: nearest vectors (and text matches), filtered, fused, tests demoted.

    Filters follow the candidate limits; if they leave nothing all candidates return. reranker: a function of (question,
    text) columns whose scores, scaled to 0..1, replace the fused ones for the first max(4 k, 30) rows; a node without
    text is judged by its label. stored: see lexical()."""
    want = cand if kind == "all" else max(cand, 8 * k)
    vec = knn(vectors, query, want)
    lex = lexical(nodes.select("id", "text"), question, want, stored) if hybrid else None
    ids = vec.select("id") if lex is None else vec.select("id").unionByName(lex.select("id")).distinct()
    keep = E.kind_matches(F.col("source_file"), F.col("file_type"), kind) & (~E.is_generic(F.col("label")) if drop_generic else F.lit(True))
    found = nodes.join(ids, "id").withColumn("keep", keep)
    found = found.withColumn("any", F.max("keep").over(Window.partitionBy())).where("keep or not any").drop("keep", "any")
    kept = found.select("id")
    rankings = [(vec.join(kept, "id"), 1.0, [F.col("dist"), F.col("id")])]
    if lex is not None:
        rankings.append((lex.join(kept, "id"), LEXICAL_WEIGHT, [F.desc("score"), F.col("id")]))
    test = E.is_test_path(F.col("source_file"))
    out = fuse(rankings).join(found, "id").withColumn("score", F.col("score") * F.when(test, 1 - test_penalty).otherwise(1.0))
    if reranker is not None:
        pool = out.orderBy(F.desc("score"), "id").limit(max(4 * k, 30)).withColumn("raw", reranker(F.lit(question), F.when(E.text(F.col("text")) == "", F.col("label")).otherwise(F.col("text"))))
        w = Window.partitionBy()
        span = F.max("raw").over(w) - F.min("raw").over(w)
        out = pool.withColumn("score", (F.col("raw") - F.min("raw").over(w)) / F.when(span == 0, 1.0).otherwise(span) - F.when(test, test_penalty).otherwise(0.0))
    return out.select("id", "label", "file_type", "source_file", F.round("score", 6).alias("score")).orderBy(F.desc("score"), "id").limit(k)


def metrics(ranked: DataFrame, expected: DataFrame) -> DataFrame:
    """recall_5, recall_10, mrr_10, misses over all queries of expected (query, id). ranked: query, id, rank from 1."""
    first = expected.join(ranked, ["query", "id"], "left").groupBy("query").agg(F.min("rank").alias("r"))
    hit = lambda n: F.avg(F.coalesce((F.col("r") <= n).cast("double"), F.lit(0.0)))
    return first.agg(F.round(hit(5), 6).alias("recall_5"), F.round(hit(10), 6).alias("recall_10"), F.round(F.avg(F.when(F.col("r") <= 10, 1 / F.col("r")).otherwise(0.0)), 6).alias("mrr_10"), F.count_if(F.col("r").isNull()).alias("misses"))
