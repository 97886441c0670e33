"""Retrieval quality of four search configurations over golden questions."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from codeweft.functions import embed as M
from codeweft.operators import search as S

CONFIGS = (
    ("vector", {"hybrid": False, "drop_generic": False, "test_penalty": 0.0}, False),
    ("filtered", {"hybrid": False, "drop_generic": True, "test_penalty": 0.5}, False),
    ("hybrid", {"hybrid": True, "drop_generic": True, "test_penalty": 0.5}, False),
    ("reranked", {"hybrid": True, "drop_generic": True, "test_penalty": 0.5}, True),
)


def run_eval(nodes: DataFrame, vectors: DataFrame, golden: DataFrame, embed, model: str = M.MODEL, reranker=None, k: int = 10) -> tuple[DataFrame, DataFrame]:
    """config, recall_5, recall_10, mrr_10, misses for each configuration; and the questions that the last one missed.

    golden (q, expect) is written by hand and small: each question is one search."""
    questions = golden.collect()
    asked = [(i, r.q, M.query_vector(nodes.sparkSession, r.q, embed, model)) for i, r in enumerate(questions)]
    wanted = nodes.sparkSession.createDataFrame([(i, r.q, [e.lower() for e in r.expect or []]) for i, r in enumerate(questions)], "query int, q string, expect array<string>")
    out, missed = None, None
    for name, options, rerank in CONFIGS:
        found = None
        for i, q, vector in asked:
            got = S.search(nodes, vectors, vector, q, k=k, reranker=reranker if rerank else None, **options).withColumn("rank", F.row_number().over(Window.orderBy(F.desc("score"), "id"))).withColumn("query", F.lit(i))
            found = got if found is None else found.unionByName(got)
        if found is None:
            break
        hit = F.exists("expect", lambda e: F.lower("source_file").contains(e) | F.lower("label").contains(e))
        first = found.join(F.broadcast(wanted), "query").where(hit).groupBy("query").agg(F.min("rank").alias("r"))
        x = wanted.select("query", "q").join(first, "query", "left")
        within = lambda n: F.round(F.avg(F.coalesce((F.col("r") <= n).cast("double"), F.lit(0.0))), 6)
        row = x.agg(within(5).alias("recall_5"), within(10).alias("recall_10"), F.round(F.avg(F.when(F.col("r") <= 10, 1 / F.col("r")).otherwise(0.0)), 6).alias("mrr_10"), F.count_if(F.col("r").isNull()).alias("misses"))
        row = row.select(F.lit(name).alias("config"), "*")
        out, missed = row if out is None else out.unionByName(row), x.where("r is null").select("q")
    if out is None:
        out = nodes.sparkSession.createDataFrame([], "config string, recall_5 double, recall_10 double, mrr_10 double, misses long")
        missed = golden.select("q")
    return out, missed
