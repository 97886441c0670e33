"""Mixing sources to target weights by Sainte-Lague apportionment.

Sources, in order of code points with null last, weigh 3, 1, 2, repeating, and share 150 % of all words; a target stops
at twice its source's words and the excess is reshared by weight. The targets are votes: equal blocks of words are
seats, given by highest quotients votes / (2 seats + 1). A source's seats are split over its shards (streams of its
seeded-shuffled documents) in the same way, which gives integer quotas per shard. In a shard every block is taken
quota // blocks times, and the rest is a run of blocks from a seeded start, around the end if need be; as the stream
is shuffled, that is a random choice that cuts two documents of a shard at most.

The plan of the sources is made in one task with a row for each source, that of a source's shards in one task with a
row for each shard (MOST at most); documents are never gathered: a window ranks those of one shard.

Defined results: null or empty text counts no words and takes none (a mix has no row of it); a null source is a source
of its own; rows equal in id and text are interchangeable and each counts; equal quotients go to the earlier source or
shard; a very long text is a document like others, cut where a block ends; an empty table gives no rows; other columns,
whatever their names, don't matter and are kept in the mix.
"""

from __future__ import annotations

import heapq

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from codeweft.llm.common import SPACED, hash_share, materialise, numbered, packed, row_hash, table, unpacked

WEIGHTS = (3, 1, 2)
SHARE, REPEATS = 1.5, 2
SEED = "mix-1"
GAP = r"[\x20\x09-\x0D]*"
#: A block has 1/400 of the smallest target, at most BLOCK words. A shard has about SHARD words; a source has MOST shards at most.
FINE, BLOCK, SHARD, MOST = 400, 1024, 1 << 18, 1 << 16


def water_fill(sizes: np.ndarray, weights: np.ndarray, total: float, caps: np.ndarray) -> np.ndarray:
    """Shares total by weight; what exceeds a cap is reshared by weight until none is above."""
    out, open_ = np.zeros(len(sizes)), np.ones(len(sizes), bool)
    left = float(total)
    while open_.any():
        share = left * weights / weights[open_].sum()
        over = open_ & (share >= caps)
        if not over.any():
            out[open_] = share[open_]
            break
        out[over] = caps[over]
        left -= caps[over].sum()
        open_ &= ~over
    return out


def sainte_lague(votes: np.ndarray, seats: int, caps: np.ndarray) -> np.ndarray:
    """Seats by highest quotients votes / (2 s + 1), never more than caps; ties go to the earlier party.

    A divisor found by bisection gives all but a few seats at once; a heap of quotients gives those."""
    votes, caps = np.asarray(votes, float), np.asarray(caps, np.int64)
    seats = int(min(seats, caps[votes > 0].sum()))
    given = lambda d: np.minimum(caps, np.floor(votes / d + 0.5).astype(np.int64))
    out = np.zeros(len(votes), np.int64)
    if seats <= 0:
        return out
    low, high = votes.sum() / (4 * seats + 4 * len(votes) + 4), 4 * votes.sum() + 1
    while given(low).sum() < seats and low > 1e-300:
        low /= 16
    for _ in range(200):
        mid = (low + high) / 2
        low, high = (mid, high) if given(mid).sum() >= seats else (low, mid)
    out = given(high)
    heap = [(-votes[i] / (2 * out[i] + 1), i) for i in range(len(votes)) if votes[i] > 0 and out[i] < caps[i]]
    heapq.heapify(heap)
    for _ in range(seats - int(out.sum())):
        _, i = heapq.heappop(heap)
        out[i] += 1
        if out[i] < caps[i]:
            heapq.heappush(heap, (-votes[i] / (2 * out[i] + 1), i))
    return out


def _plan_sources(pdf: pd.DataFrame) -> pd.DataFrame:
    """Targets and seats; there is one row for each source."""
    order = sorted(range(len(pdf)), key=lambda i: (pdf["source"].iloc[i] is None, pdf["source"].iloc[i] or ""))
    pdf = pdf.iloc[order].reset_index(drop=True)
    words = pdf["words"].to_numpy(np.int64)
    weights = np.array([WEIGHTS[i % len(WEIGHTS)] for i in range(len(pdf))], float)
    target = water_fill(words, weights, SHARE * words.sum(), REPEATS * words.astype(float))
    some = target[target > 0]
    block = int(np.clip(some.min() // FINE, 1, BLOCK)) if len(some) else 1
    caps = np.floor(REPEATS * words / block + 0.5).astype(np.int64)
    seats = sainte_lague(target, int(round(target.sum() / block)), caps)
    shards = np.clip(-(-words // SHARD), 1, MOST)
    return pd.DataFrame({"source": pdf["source"], "source_size": words, "target": target, "seats": seats, "block": block, "shards": shards})


def _plan_shards(pdf: pd.DataFrame) -> pd.DataFrame:
    """The quota of each shard of one source (MOST at most), and the run of words taken once more."""
    pdf = pdf.sort_values("shard").reset_index(drop=True)
    words, block = pdf["words"].to_numpy(np.int64), int(pdf["block"].iloc[0])
    blocks = np.where(words > 0, np.maximum(1, np.round(words / block)), 0).astype(np.int64)
    quota = sainte_lague(words, int(pdf["seats"].iloc[0]), REPEATS * blocks)
    some = np.maximum(blocks, 1)
    whole, run = quota // some, quota % some
    start = np.floor(pdf["start"].to_numpy() * some).astype(np.int64)
    edge = lambda k: np.array([int(a) * int(b) // int(c) for a, b, c in zip(k, words, some)], np.int64)
    to = start + run
    return pd.DataFrame(
        {"source": pdf["source"], "shard": pdf["shard"], "quota": quota, "whole": whole, "lo": edge(start), "hi": edge(np.minimum(to, some)), "wrap": edge(np.maximum(to - some, 0))}
    )


def mix(docs: DataFrame, seed: str = SEED) -> DataFrame:
    """A row for each document: doc_id, row_key, source, size, source_size, target, shard, whole (complete copies),
    pieces (spans of words taken once more: array of from, to) and taken."""
    base = materialise(
        docs.select("doc_id", F.col("source").cast("string").alias("source"), F.coalesce(F.regexp_count("text", F.lit(SPACED)), F.lit(0)).cast("long").alias("size"), row_hash(F.col("doc_id"), F.col("text"), seed).alias("row_key")),
        "mix-rows",
    )
    sources = base.groupBy("source").agg(F.sum("size").alias("words"))
    sources = materialise(
        sources.withColumn("all", F.lit(0)).groupBy("all").applyInPandas(_plan_sources, "source string, source_size long, target double, seats long, block long, shards long"), "mix-sources"
    ).withColumnRenamed("source", "of")
    same = F.col("source").eqNullSafe(F.col("of"))
    rows = base.join(sources, same).drop("of").withColumn("shard", F.floor(hash_share(F.col("row_key")) * F.col("shards")).cast("int"))
    streams = rows.groupBy("source", "shard").agg(F.sum("size").alias("words"), F.first("seats").alias("seats"), F.first("block").alias("block"))
    streams = streams.withColumn("start", hash_share(F.md5(F.concat_ws("|", F.lit(seed), F.coalesce("source", F.lit("~")), "shard"))))
    plan = streams.groupBy("source").applyInPandas(_plan_shards, "source string, shard int, quota long, whole long, lo long, hi long, wrap long")
    plan = materialise(plan, "mix-plan").withColumnRenamed("source", "of").withColumnRenamed("shard", "of_shard")
    w = Window.partitionBy("source", "shard").orderBy("row_key")
    placed = rows.withColumn("end", F.sum("size").over(w.rowsBetween(Window.unboundedPreceding, 0))).withColumn("begin", F.col("end") - F.col("size"))
    joined = placed.join(plan, same & (F.col("shard") == F.col("of_shard")))
    piece = lambda lo, hi: F.struct((F.greatest(F.col("begin"), lo) - F.col("begin")).alias("from"), (F.least(F.col("end"), hi) - F.col("begin")).alias("to"))
    joined = joined.withColumn("pieces", F.filter(F.array(piece(F.lit(0), F.col("wrap")), piece(F.col("lo"), F.col("hi"))), lambda x: x["from"] < x["to"]))
    taken = F.col("size") * F.col("whole") + F.aggregate("pieces", F.lit(0).cast("long"), lambda a, x: a + x["to"] - x["from"])
    return joined.select("doc_id", "row_key", "source", "size", "source_size", "target", "shard", "whole", "pieces", taken.alias("taken"))


def mixed_documents(docs: DataFrame, seed: str = SEED) -> DataFrame:
    """The mix itself, with the columns of docs: each complete copy is a row, each piece a row with those words only and
    the white space between them. n_chars, if there, is that of the piece."""
    plan = numbered(mix(docs, seed).where("taken > 0").select("row_key", "whole", "pieces"), "row_key", "copy")
    rows = docs.select(row_hash(F.col("doc_id"), F.col("text"), seed).alias("row_key"), packed(docs).alias("row"))
    joined = numbered(rows, "row_key", "copy").join(plan, ["row_key", "copy"])
    none = F.struct(F.lit(None).cast("long").alias("from"), F.lit(None).cast("long").alias("to"))
    parts = joined.withColumn("part", F.explode(F.concat(F.array_repeat(none, F.col("whole").cast("int")), F.col("pieces"))))
    words = F.regexp_extract_all(F.col("row.text"), F.lit(f"{SPACED}{GAP}"), F.lit(0))  # each with the white space after it
    some = F.slice(words, (F.col("part.from") + 1).cast("int"), (F.col("part.to") - F.col("part.from")).cast("int"))
    cut = F.when(F.col("part.from").isNull(), F.col("row.text")).otherwise(F.rtrim(F.array_join(some, ""), F.lit(" \t\n\x0b\x0c\r")))
    out = parts.withColumn("cut", cut)
    made = {"text": F.col("cut")}
    if "n_chars" in docs.columns:
        made["n_chars"] = F.when(F.col("part.from").isNull(), F.col("row.n_chars")).otherwise(F.length("cut")).cast(docs.schema["n_chars"].dataType)
    return out.select(*[made[c].alias(c) if c in made else x for c, x in zip(docs.columns, unpacked("row", docs.columns))])


def op1_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix(table(spark, sf_dir, "documents").select("doc_id", "text", "source")).select("doc_id", "size", "source_size", "target", "taken", "source", "shard")


QUERIES = {"op1_mixing": op1_mixing}

#: Seats by ranking all quotients that caps allow, where the operator finds a divisor first: for small tables.
ORACLES = {
    "op1_mixing": rf"""
WITH d AS (SELECT doc_id, source, CAST(len(regexp_extract_all(coalesce(text, ''), '{SPACED}')) AS BIGINT) AS size, md5(concat_ws('|', '{SEED}', coalesce(CAST(doc_id AS VARCHAR), '~'), coalesce(md5(text), '~'))) AS k FROM documents),
src AS (SELECT source, sum(size)::BIGINT AS words, [3, 1, 2][(row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1] AS w, row_number() OVER (ORDER BY source NULLS LAST) AS o FROM d GROUP BY source),
-- targets: those whose cap is least for their weight stop first
fill AS (SELECT *, coalesce(sum(2.0 * words) OVER f, 0) AS capped, sum(w) OVER () - coalesce(sum(w) OVER f, 0) AS open_, sum(words) OVER () * CAST(1.5 AS DOUBLE) AS total FROM src WINDOW f AS (ORDER BY words * 2.0 / w, o ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
stop AS (SELECT *, (total - capped) * w / open_ >= 2.0 * words AS over_ FROM fill),
flow AS (SELECT *, bool_and(over_) OVER (ORDER BY words * 2.0 / w, o) AS stops FROM stop),
level AS (SELECT any_value(total) - coalesce(sum(2.0 * words) FILTER (stops), 0) AS rest, sum(w) FILTER (NOT stops) AS open_w FROM flow),
tgt AS (SELECT source, words, o, CAST(CASE WHEN stops THEN 2.0 * words ELSE rest * w / open_w END AS DOUBLE) AS target FROM flow, level),
blk AS (SELECT CAST(least(greatest(floor(min(target) FILTER (target > 0) / {FINE}), 1), {BLOCK}) AS BIGINT) AS block, sum(target) AS whole FROM tgt),
party AS (SELECT t.*, block, CAST(floor(2 * words / block + 0.5) AS BIGINT) AS cap, least(greatest((words + {SHARD - 1}) // {SHARD}, 1), {MOST}) AS shards, CAST(round_even(whole / block, 0) AS BIGINT) AS wanted FROM tgt t, blk),
won AS (SELECT o FROM (SELECT o, wanted, target, unnest(range(0, cap)) AS s FROM party WHERE target > 0) QUALIFY row_number() OVER (ORDER BY target / (2 * s + 1) DESC, o) <= wanted),
seat AS (SELECT o, count(*) AS seats FROM won GROUP BY o),
r AS (SELECT d.*, p.words, p.target, p.block, coalesce(seats, 0) AS seats, p.o, CAST(floor(CAST('0x' || substr(k, 1, 8) AS BIGINT) / CAST(4294967296 AS DOUBLE) * shards) AS INTEGER) AS shard FROM d JOIN party p ON d.source IS NOT DISTINCT FROM p.source LEFT JOIN seat s ON s.o = p.o),
st AS (SELECT o, shard, any_value(source) AS source, sum(size)::BIGINT AS sw, any_value(seats) AS seats, any_value(block) AS block FROM r GROUP BY o, shard),
bs AS (SELECT *, CASE WHEN sw > 0 THEN greatest(1, CAST(round_even(sw / block, 0) AS BIGINT)) ELSE 0 END AS blocks, CAST('0x' || substr(md5(concat_ws('|', '{SEED}', coalesce(source, '~'), shard)), 1, 8) AS BIGINT) / CAST(4294967296 AS DOUBLE) AS share FROM st),
got AS (SELECT o, shard FROM (SELECT o, shard, seats, sw, unnest(range(0, 2 * blocks)) AS s FROM bs WHERE sw > 0) QUALIFY row_number() OVER (PARTITION BY o ORDER BY sw / (2 * s + 1) DESC, shard) <= seats),
q AS (SELECT b.*, greatest(blocks, 1) AS many, coalesce(n, 0) AS quota FROM bs b LEFT JOIN (SELECT o, shard, count(*) AS n FROM got GROUP BY o, shard) g USING (o, shard)),
e AS (SELECT *, quota // many AS times, CAST(floor(share * many) AS BIGINT) AS a, CAST(floor(share * many) AS BIGINT) + quota % many AS z FROM q),
cut AS (SELECT o, shard, times, a * sw // many AS lo, least(z, many) * sw // many AS hi, greatest(z - many, 0) * sw // many AS wrap FROM e),
pl AS (SELECT r.*, sum(size) OVER (PARTITION BY o, shard ORDER BY k ROWS UNBOUNDED PRECEDING) - size AS b FROM r)
SELECT doc_id, size, words AS source_size, target, CAST(size * times + greatest(0, least(b + size, wrap) - b) + greatest(0, least(b + size, hi) - greatest(b, lo)) AS BIGINT) AS taken, source, shard FROM pl JOIN cut USING (o, shard)
""",
}
