"""Benchmark decontamination by a prefix-filtered set join, in DataFrame operations only.

An item's windows are WINDOW consecutive words (one shorter window if it has fewer words). A window's shingles of
SHINGLE words (all of a shorter window is one shingle) are ordered by rarity, i.e. by how often they stand in the
documents. A text contains a window only if it contains all its shingles, so the necessary prefix is one token: the
rarest. Documents join on that shingle alone; the shingle's place in the window gives the only position where the
window can stand (positional bound), which must lie inside the text (length bound), and the words there are compared
one by one.

The documents are read once: their shingles explode and probe the benchmark's shingles in one stage that carries the
words along by reference, without a shuffle of texts. Only shingles that the benchmark has are written, with the words
around them; rarity, the prefix join, the bounds and the comparison work on that small table. Windows are probed in
blocks of BLOCK, so that what is broadcast stays bounded for any benchmark. Results are gathered per distinct text
(copies add nothing) and joined back to the documents.

Defined results: null or empty text has no words, hits or items, and the digest of the empty string; items without
words have no windows; equal items count by item_id; a null item_id counts as no item; repeated documents are judged
each and alike; shingles of equal rarity are taken by place, then hash; a very long text is searched whole; an empty
benchmark leaves all documents clean, an empty document table gives no rows; other columns, whatever their names, are
kept.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from codeweft.llm.common import alnum_words, materialise, packed, table, unpacked

WINDOW, SHINGLE, BLOCK = 13, 5, 200_000
WINDOW_MOST = 13


def shingles_of(words: Column, k: int) -> Column:
    """Hashes of k consecutive words, in order."""
    n = F.size(words)
    part = lambda i: F.xxhash64(*[F.element_at(words, i + j) for j in range(k)])
    return F.when(n >= k, F.transform(F.sequence(F.lit(1), n - (k - 1)), part)).otherwise(F.array().cast("array<bigint>"))


def _cut(items: DataFrame, window: int) -> DataFrame:
    """A row for each window of each item: its columns but w, and words."""
    n = F.size("w")
    starts = F.when(n <= window, F.array(F.lit(1))).otherwise(F.sequence(F.lit(1), n - (window - 1)))
    kept = [c for c in items.columns if c != "w"]
    return items.where(n > 0).select(*kept, "w", F.explode(starts).alias("at")).select(*kept, F.slice("w", F.col("at"), F.lit(window)).alias("words"))


def _windows(benchmark: DataFrame, window: int) -> DataFrame:
    """Distinct windows: window_id, words, k (words in its shingles)."""
    out = _cut(benchmark.select(alnum_words(F.col("text")).alias("w")), window).distinct()
    return out.withColumn("k", F.least(F.size("words"), F.lit(SHINGLE))).withColumn("window_id", F.monotonically_increasing_id())


def _window_shingles(windows: DataFrame, k: int) -> DataFrame:
    return windows.where(F.col("k") == k).select("window_id", "words", F.posexplode(shingles_of(F.col("words"), k)).alias("offset", "shingle"))


def text_key(text: Column) -> Column:
    return F.md5(F.coalesce(text, F.lit("")))


def _probe(docs: DataFrame, tokens: DataFrame, k: int) -> DataFrame:
    """Positions whose shingle the benchmark has, with the words from around - before to around + after; besides, each
    document's first position (pos 0) in any case. docs: doc_id, text."""
    words = docs.select("doc_id", text_key(F.col("text")).alias("key"), alnum_words(F.col("text")).alias("words"))
    at = words.select("doc_id", "key", "words", F.explode(F.sequence(F.lit(0), F.greatest(F.lit(0), F.size("words") - k))).alias("pos"))
    hashed = F.xxhash64(*[F.get("words", F.col("pos") + j) for j in range(k)])
    at = at.withColumn("shingle", F.when(F.size("words") >= k, hashed))
    known = tokens.select("shingle").distinct().withColumn("known", F.lit(True))
    at = at.join(F.broadcast(known), "shingle", "left").where("known or pos = 0")
    begin = F.greatest(F.lit(0), F.col("pos") - (WINDOW_MOST - 1))
    around = F.when(F.col("known"), F.slice("words", begin + 1, F.lit(2 * WINDOW_MOST - 1)))
    return at.select("doc_id", "key", F.size("words").cast("long").alias("n_words"), "pos", F.when(F.col("known"), F.col("shingle")).alias("shingle"), begin.alias("begin"), around.alias("around"))


def _hits(probed: DataFrame, tokens: DataFrame) -> DataFrame:
    """Verified occurrences: key, start (from 0), length, window_id."""
    seen = probed.where("shingle is not null").select("key", "n_words", "pos", "shingle", "begin", "around")
    often = seen.groupBy("shingle").agg(F.count("*").alias("often"))
    # a window with a shingle that no document has can't occur: it comes first, and finds nothing
    rarest = F.row_number().over(Window.partitionBy("window_id").orderBy(F.coalesce("often", F.lit(0)), "offset", "shingle"))
    prefix = tokens.join(often, "shingle", "left").withColumn("r", rarest).where("r = 1 and often > 0")
    prefix = prefix.select("window_id", "offset", "shingle", F.col("words").alias("expected"))
    start, length = F.col("pos") - F.col("offset"), F.size("expected")
    found = seen.join(prefix, "shingle").where((start >= 0) & (start + length <= F.col("n_words")))
    found = found.where(F.slice("around", start - F.col("begin") + 1, length) == F.col("expected"))
    return found.select("key", start.alias("start"), length.alias("length"), "window_id").distinct()


def contaminated_texts(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, block: int = BLOCK) -> tuple[DataFrame, DataFrame]:
    """All documents (doc_id, key, n_words), and for each distinct text with a hit: key, n_hit, items (sorted ids as
    strings). docs: doc_id, text. window: WINDOW_MOST at most."""
    windows = materialise(_windows(benchmark, window), "bench-windows")
    blocks = max(1, -(-windows.count() // block))
    sizes = sorted({SHINGLE} | {r.k for r in windows.select("k").distinct().collect()})  # SHINGLE values at most
    rows, found = None, None
    for k in sizes:
        for part in range(blocks):
            tokens = _window_shingles(windows.where(F.pmod(F.xxhash64("window_id"), F.lit(blocks)) == part), k)
            probed = materialise(_probe(docs, tokens, k), "bench-probe")
            rows = probed.where("pos = 0").select("doc_id", "key", "n_words") if rows is None else rows
            hits = _hits(probed, tokens)
            found = hits if found is None else found.unionByName(hits)
    found = materialise(found, "bench-hits")
    # words inside any occurrence: of each, those beyond the furthest end so far
    w = Window.partitionBy("key").orderBy("start", "length", "window_id")
    end = F.col("start") + F.col("length")
    furthest = F.coalesce(F.max(end).over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    hit = found.withColumn("fresh", F.greatest(F.lit(0), end - F.greatest("start", furthest))).groupBy("key").agg(F.sum("fresh").alias("n_hit"))
    owners = _cut(benchmark.where(F.col("item_id").isNotNull()).select(F.col("item_id").cast("string").alias("item"), alnum_words(F.col("text")).alias("w")), window)
    owners = owners.join(windows, "words").select("item", "window_id").distinct()
    items = found.select("key", "window_id").distinct().join(owners, "window_id").select("key", "item").distinct()
    items = items.groupBy("key").agg(F.array_sort(F.collect_list("item")).alias("items"))
    return rows, materialise(hit.join(items, "key", "left"), "bench-texts")


def _judged(rows: DataFrame, hits: DataFrame) -> DataFrame:
    n_hit = F.coalesce("n_hit", F.lit(0)).cast("long")
    out = rows.join(hits, "key", "left").withColumn("n_hit", n_hit).withColumn("items", F.coalesce("items", F.array().cast("array<string>")))
    return out.withColumn("contaminated", (F.col("n_hit") > 0) & (20 * F.col("n_hit") >= F.col("n_words")))


def decontaminate(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, block: int = BLOCK) -> DataFrame:
    """A row for each document: doc_id, key (of its text), n_words, n_hit, items, contaminated."""
    return _judged(*contaminated_texts(docs.select("doc_id", "text"), benchmark.select("item_id", "text"), window, block))


def clean_documents(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, block: int = BLOCK) -> DataFrame:
    """docs without the contaminated ones. Verdicts depend on the text alone, so texts are dropped by key."""
    bad = decontaminate(docs, benchmark, window, block).where("contaminated").select("key").distinct()
    rows = docs.select(text_key(F.col("text")).alias("key"), packed(docs).alias("row"))
    return rows.join(bad, "key", "left_anti").select(*unpacked("row", docs.columns))


def op5_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark")).select(
        "doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"), F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), "contaminated"
    )


QUERIES = {"op5_decontaminate": op5_decontaminate}
_WORDS = r"regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"
ORACLES = {
    "op5_decontaminate": f"""
WITH d AS (SELECT doc_id, {_WORDS} AS w FROM documents),
b AS (SELECT item_id, {_WORDS} AS w FROM benchmark),
win AS (SELECT DISTINCT item_id, len(w) AS n, array_to_string(w[i:i + 12], ' ') AS t, least(len(w), 13) AS l
        FROM (SELECT *, unnest(range(1, greatest(len(w) - 12, 1) + 1)) AS i FROM b WHERE len(w) > 0)),
lens AS (SELECT DISTINCT l FROM win),
dw AS (SELECT doc_id, p, l, array_to_string(w[p:p + l - 1], ' ') AS t
       FROM (SELECT doc_id, w, l, unnest(range(1, len(w) - l + 2)) AS p FROM d, lens WHERE len(w) >= l)),
occ AS (SELECT DISTINCT dw.doc_id, dw.p, dw.l, win.item_id FROM dw JOIN win ON dw.t = win.t AND dw.l = win.l),
hit AS (SELECT doc_id, count(DISTINCT q) AS n_hit FROM (SELECT doc_id, unnest(range(p, p + l)) AS q FROM occ) GROUP BY 1),
it AS (SELECT doc_id, count(DISTINCT item_id) AS n_items, string_agg(DISTINCT CAST(item_id AS VARCHAR), ',' ORDER BY CAST(item_id AS VARCHAR)) AS ids FROM occ GROUP BY 1)
SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit, CAST(coalesce(n_items, 0) AS BIGINT) AS n_items,
       sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(w) AS contaminated
FROM d LEFT JOIN hit ON d.doc_id = hit.doc_id LEFT JOIN it ON d.doc_id = it.doc_id
""",
}
