"""An inverted file for vectors: approximate nearest neighbours that read a few lists instead of all rows.

Centroids are fitted by spherical k-means on a bounded sample (SAMPLE rows of least seeded hash); every row is then put
into the list of its nearest centroid, and the table is written with a folder for each list, so that a query reads only
the lists it probes. tuned_probes() picks the number of probes by recall against exact search on sample queries.

Null vectors are left out; a zero vector lies in the first list and is at distance 1 from all."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from codeweft.operators.search import BLOCK, _matrix, _nearest, knn_join

#: Rows that centroids are fitted on, lists at most, rounds of k-means.
SAMPLE, LISTS, ROUNDS, SEED = 50_000, 4096, 12, "vector-index-1"


def _sampled(vectors: DataFrame, rows: int) -> DataFrame:
    order = F.md5(F.concat_ws("|", F.lit(SEED), "id"))
    return vectors.where("embedding is not null").orderBy(order, "id").limit(rows)


def fit(vectors: DataFrame, lists: int | None = None, sample: int = SAMPLE) -> np.ndarray:
    """Centroids of unit length, one a list: about the square root of the number of rows, LISTS at most."""
    total = vectors.where("embedding is not null").count()
    if not total:
        return np.zeros((0, 0))
    x = _matrix(_sampled(vectors.select("id", "embedding"), sample).toArrow()["embedding"])
    k = int(min(lists or max(1, round(total**0.5)), LISTS, len(x)))
    rng = np.random.default_rng(17)
    c = x[rng.choice(len(x), k, replace=False)]
    for _ in range(ROUNDS):
        of = (x @ c.T).argmax(1)
        total_of = np.zeros_like(c)
        np.add.at(total_of, of, x)
        norm = np.linalg.norm(total_of, axis=1, keepdims=True)
        c = np.where(norm > 1e-12, total_of / np.maximum(norm, 1e-12), c)
    return c


def assigned(vectors: DataFrame, centroids: np.ndarray) -> DataFrame:
    """id, embedding, list: every row with a vector."""

    def assign(batches):
        for b in batches:
            if b.num_rows:
                of = (_matrix(pa.chunked_array([b.column("embedding")])) @ centroids.T).argmax(1)
                yield pa.RecordBatch.from_arrays([b.column("id"), b.column("embedding"), pa.array(of.astype(np.int32))], ["id", "embedding", "list"])

    return vectors.where("embedding is not null").select("id", "embedding").mapInArrow(assign, "id string, embedding array<float>, list int")


def build(vectors: DataFrame, path: str, lists: int | None = None, sample: int = SAMPLE) -> None:
    """Writes the index: lists/ (a folder a list) and centroids/."""
    c = fit(vectors, lists, sample)
    c = c if len(c) else np.zeros((1, 1))  # no rows: one empty list
    assigned(vectors, c).repartition("list").write.mode("overwrite").partitionBy("list").parquet(f"{path}/lists")
    rows = [(i, [float(x) for x in r]) for i, r in enumerate(c)]
    vectors.sparkSession.createDataFrame(rows, "list int, centroid array<double>").coalesce(1).write.mode("overwrite").parquet(f"{path}/centroids")


def load(spark: SparkSession, path: str) -> tuple[DataFrame, np.ndarray]:
    """The lists, and the centroids (LISTS rows at most)."""
    c = spark.read.parquet(f"{path}/centroids").orderBy("list").collect()
    return spark.read.schema("id string, embedding array<float>, list int").parquet(f"{path}/lists"), np.array([r.centroid for r in c])


def index_join(queries: DataFrame, index: tuple[DataFrame, np.ndarray], k: int, probes: int, block: int = BLOCK) -> DataFrame:
    """a, b, dist, rank as knn_join(), from the `probes` lists nearest to each query. A list of more than a block of
    vectors is dealt over several tasks, each of which meets the list's queries."""
    rows, c = index
    probes = min(probes, len(c))

    def probe(batches):
        for b in batches:
            if b.num_rows:
                near = np.argsort(-(_matrix(pa.chunked_array([b.column("embedding")])) @ c.T), axis=1, kind="stable")[:, :probes]
                yield pa.RecordBatch.from_arrays([b.column("id"), b.column("embedding"), pa.array(list(near.astype(np.int32)), pa.list_(pa.int32()))], ["q_id", "q_vector", "lists"])

    asked = queries.where("embedding is not null").select("id", "embedding").mapInArrow(probe, "q_id string, q_vector array<float>, lists array<int>")
    asked = asked.select("q_id", "q_vector", F.explode("lists").alias("q_list"))
    sizes = rows.groupBy("list").agg(F.ceil(F.count("*") / F.lit(block)).cast("int").alias("parts"))
    sizes = F.broadcast(sizes)  # LISTS rows at most
    left = asked.join(sizes.withColumnRenamed("list", "q_list"), "q_list").withColumn("q_part", F.explode(F.sequence(F.lit(0), F.col("parts") - 1))).groupBy("q_list", "q_part")
    right = rows.join(sizes, "list").select(F.col("id").alias("v_id"), F.col("embedding").alias("v_vector"), F.col("list").alias("v_list"), F.pmod(F.xxhash64("id"), F.col("parts")).cast("int").alias("v_part")).groupBy("v_list", "v_part")
    found = left.cogroup(right).applyInArrow(_nearest(k), "a string, b string, dist double")
    return found.withColumn("rank", F.row_number().over(Window.partitionBy("a").orderBy("dist", "b"))).where(F.col("rank") <= k)


def recall(found: DataFrame, exact: DataFrame) -> float:
    """The share of exact neighbours that were found."""
    both = exact.select("a", "b").join(found.select("a", "b", F.lit(1).alias("hit")), ["a", "b"], "left")
    return float(both.agg(F.avg(F.coalesce("hit", F.lit(0)))).first()[0] or 0.0)


def tuned_probes(vectors: DataFrame, index: tuple[DataFrame, np.ndarray], k: int = 10, target: float = 0.9, queries: int = 200) -> int:
    """The least of 1, 2, 4, ... lists whose recall of the k nearest reaches the target, on `queries` rows by hash."""
    asked = _sampled(vectors.select("id", "embedding"), queries)
    exact, probes = knn_join(asked, vectors, k), 1
    exact = exact.sparkSession.createDataFrame(exact.select("a", "b").collect(), "a string, b string")  # queries times k rows
    while probes < len(index[1]) and recall(index_join(asked, index, k, probes), exact) < target:
        probes *= 2
    return min(probes, max(1, len(index[1])))
