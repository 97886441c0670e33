"""Sharding by proportional stratified interleaving.

Rows are shuffled by a seeded hash within each stratum (source) and ranked; rank r of n rows gets the fractional rank
(2r - 1) / 2n. All rows sorted by fractional rank interleave the strata in proportion, so that any run of the order
has the mixture of the whole. The order is cut into runs whose lengths differ by one at most (law "rows").

The ranks are found without a global sort or a window over a whole stratum: rows fall into hash ranges, small tables
of counts give each range its offset, and windows only rank the rows of a range.

The running offsets of the ranges are summed by one task for each stratum, and by one for all: a row for each
RANGE_ROWS rows of the input.

Defined results: null ids, texts and sources are kept (a null source is a stratum of its own; a null or empty text has
size 1); equal fractions are ordered by stratum, then hash; rows equal in id and text are interchangeable and each has
its place; the length of a text doesn't matter; an empty table gives no rows; other columns, whatever their names, are
kept.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from codeweft.llm.common import free_name, hash_share, materialise, numbered, packed, row_hash, table, unpacked

SEED = "interleave-1"
RANGE_ROWS = 20_000


def _running(counts: DataFrame, order: str, *by: str) -> DataFrame:
    """Adds how many rows the ranges before this one hold."""
    w = Window.partitionBy(*by).orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    return counts.withColumn("before", F.coalesce(F.sum("n").over(w), F.lit(0)))


def assign(docs: DataFrame, n_shards: int = 8, seed: str = SEED, range_rows: int = RANGE_ROWS) -> DataFrame:
    """A row for each document: doc_id, size, text_crc32, row_key, stratum, fraction, shard, slot."""
    base = materialise(
        docs.select(
            F.col("doc_id"),
            (F.coalesce(F.octet_length("text"), F.lit(0)) + 1).cast("long").alias("size"),
            F.crc32(F.coalesce("text", F.lit(""))).alias("text_crc32"),
            F.coalesce(F.concat(F.lit("s"), F.col("source").cast("string")), F.lit("n")).alias("stratum"),
            row_hash(F.col("doc_id"), F.col("text"), seed).alias("row_key"),
        ),
        "shard-rows",
    )
    total = base.count()
    ranges = max(1, -(-total // range_rows))
    base = base.withColumn("part", F.floor(hash_share(F.col("row_key")) * ranges))
    counts = base.groupBy("stratum", "part").agg(F.count("*").alias("n"))
    offsets = _running(counts, "part", "stratum").withColumn("rows", F.sum("n").over(Window.partitionBy("stratum"))).drop("n")
    within = F.row_number().over(Window.partitionBy("stratum", "part").orderBy("row_key"))
    ranked = (
        base.withColumn("rank", within)
        .join(offsets, ["stratum", "part"])
        .withColumn("fraction", (2 * (F.col("rank") + F.col("before")) - 1).cast("double") / (2 * F.col("rows")).cast("double"))
        .withColumn("lane", F.floor(F.col("fraction") * ranges))
        .drop("part", "rank", "before", "rows")
    )
    ranked = materialise(ranked, "shard-ranks")
    lanes = _running(ranked.groupBy("lane").agg(F.count("*").alias("n")), "lane").drop("n")
    order = F.row_number().over(Window.partitionBy("lane").orderBy("fraction", "stratum", "row_key")) - 1
    place = F.col("place")
    return (
        ranked.withColumn("order", order)
        .join(lanes, "lane")
        .withColumn("place", (F.col("order") + F.col("before")).cast("long"))
        .withColumn("shard", F.floor(place * n_shards / F.lit(max(total, 1))).cast("int"))
        .withColumn("shard", F.when(place < F.ceil(F.col("shard") * F.lit(total) / n_shards), F.col("shard") - 1).otherwise(F.col("shard")))
        .withColumn("slot", (place - F.ceil(F.col("shard") * F.lit(total) / n_shards)).cast("long"))
        .drop("lane", "order", "before", "place")
    )


def interleave(docs: DataFrame, n_shards: int = 8, seed: str = SEED) -> DataFrame:
    """The documents themselves with shard and slot (shard_ and slot_ beside columns of these names). Rows are matched to
    their places by key and running number."""
    places = numbered(assign(docs, n_shards, seed).select("row_key", "shard", "slot"), "row_key", "copy")
    rows = docs.select(row_hash(F.col("doc_id"), F.col("text"), seed).alias("row_key"), packed(docs).alias("row"))
    joined = numbered(rows, "row_key", "copy").join(places, ["row_key", "copy"])
    return joined.select(*unpacked("row", docs.columns), *[F.col(c).alias(free_name(docs, c)) for c in ("shard", "slot")])


def op8_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return assign(table(spark, sf_dir, "documents").select("doc_id", "text", "source")).select(
        "doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard")
    )


QUERIES = {"op8_sharding": op8_sharding}
#: DuckDB has no crc32, so it is written out, with a table made from its polynomial.
ORACLES = {
    "op8_sharding": f"""
WITH tab AS (SELECT list(list_reduce(list_prepend(i, range(0, 8)), lambda c, x: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END) ORDER BY i) AS t FROM range(0, 256) r(i)),
d AS (SELECT doc_id, CAST(octet_length(encode(coalesce(text, ''))) + 1 AS BIGINT) AS size, coalesce(concat('s', source), 'n') AS stratum,
 list_transform(regexp_extract_all(hex(encode(coalesce(text, ''))), '..'), lambda x: CAST('0x' || x AS BIGINT)) AS b,
 md5(concat_ws('|', '{SEED}', coalesce(CAST(doc_id AS VARCHAR), '~'), coalesce(md5(text), '~'))) AS k FROM documents),
r AS (SELECT *, CAST(2 * row_number() OVER (PARTITION BY stratum ORDER BY k) - 1 AS DOUBLE) / CAST(2 * count(*) OVER (PARTITION BY stratum) AS DOUBLE) AS f, count(*) OVER () AS n FROM d),
p AS (SELECT *, row_number() OVER (ORDER BY f, stratum, k) - 1 AS place FROM r)
SELECT doc_id, size, xor(list_reduce(list_prepend(4294967295, b), lambda c, x: xor(c >> 8, t[(xor(c, x) & 255) + 1])), 4294967295) AS text_crc32, 'rows' AS law,
 CAST(8 * place // n AS INTEGER) AS shard, CAST(place - ((8 * place // n) * n + 7) // 8 AS BIGINT) AS slot, CAST(NULL AS INTEGER) AS grown_shard FROM p, tab
""",
}
