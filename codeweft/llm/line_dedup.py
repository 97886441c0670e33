"""Line dedup by winnowing over line hashes, in DataFrame operations only.

A document is its sequence of trimmed lines that aren't blank, as hashes. The windows are its shortest runs of whole
lines that hold MIN_WORDS words: one from each line on, and one up to each line; equal lines have equal windows,
wherever they stand. Of each window the line of least hash is selected, a fingerprint: every passage of MIN_WORDS words
or more has one, the same in each of its copies.

Positions are joined by fingerprint: one that stands at a single place of all documents has nothing to say. Matches of
the others are extended both ways by their windows, which lie around the fingerprint: a window whose lines stand at an
earlier place too (documents in order of doc_id, then of a hash) is a repeat. Windows that overlap make up runs, and
the lines of these later runs are deleted. That is exact: in a run of lines that occurs earlier and has MIN_WORDS words
or more, each line lies in a window within the run - the one from it on, the one up to it or, if both would leave the
run, the one from the run's first line.

Only whether a fingerprint has a second place, and the first place of each window, are needed, so occurrences are never
paired with all others: no group is gathered, however frequent a line or passage.

Defined results: null or empty text has no lines; rows equal in id and text share their fate (the first of them isn't
told apart); of places in one document the earlier comes first; a null doc_id comes after all others; a text of any
length is one row, whose work does not depend on how often its lines repeat; empty tables give no rows; other
columns, whatever their names, are kept. Words of a line: its spaces plus one.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from codeweft.llm.common import materialise, packed, row_hash, table, unpacked

MIN_WORDS, SEED = 50, "lines-1"


def _lines(text: Column) -> Column:
    """Lines that aren't blank: number in the text, hash, words."""
    line = lambda x: F.btrim(x, F.lit(" \t\r\x0b\x0c"))
    words = lambda x: F.length(x) - F.length(F.replace(x, F.lit(" "), F.lit(""))) + 1
    trimmed = F.transform(F.split(F.coalesce(text, F.lit("")), "\n"), lambda x, i: F.struct(i.alias("p"), line(x).alias("x")))
    return F.transform(F.filter(trimmed, lambda s: s["x"] != ""), lambda s: F.struct(s["p"].alias("p"), F.xxhash64(s["x"]).alias("h"), words(s["x"]).alias("w")))


def _windows(lines: Column) -> Column:
    """Shortest runs of MIN_WORDS words from each line on and up to each line: hash g, first line at (from 0), end, the
    fingerprint f and its line pos.

    Each line has a word, so a window has MIN_WORDS lines at most: its length is found by halving steps."""
    hashes, words = F.transform(lines, lambda s: s["h"]), F.transform(lines, lambda s: s["w"].cast("long"))

    def of(h: Column, w: Column, back: Column) -> Column:
        n = F.size(h)

        def along(v: Column, turn) -> Column:
            total = lambda i, k: F.aggregate(F.slice(v, i + 1, k), F.lit(0).cast("long"), lambda a, x: a + x)
            out = F.transform(F.sequence(F.lit(0), n - 1), lambda i: F.struct(i.alias("i"), F.lit(0).alias("k"), F.lit(0).cast("long").alias("sum")))

            def longer(step: int):
                def by(x: Column) -> Column:
                    more = F.array(x["sum"] + total(x["i"] + x["k"], F.lit(step)))
                    fits = lambda m: (m < MIN_WORDS) & (x["i"] + x["k"] + step <= n)
                    return F.get(F.transform(more, lambda m: F.when(fits(m), F.struct(x["i"].alias("i"), (x["k"] + step).alias("k"), m.alias("sum"))).otherwise(x)), F.lit(0))

                return by

            for bit in reversed(range((MIN_WORDS - 1).bit_length())):
                out = F.transform(out, longer(1 << bit))
            whole = F.filter(out, lambda x: x["i"] + x["k"] < n)  # one line more completes the window
            return F.transform(whole, lambda x: turn(x["i"], x["i"] + x["k"] + 1))

        # a place as one number: distinct numbers are found by hashing, structs by comparing all pairs
        pair = lambda start, end: F.shiftleft(start.cast("long"), 32) + end
        ends = along(back, lambda i, end: pair(n - end, n - i))
        places = F.array_distinct(F.concat(along(w, pair), ends))
        places = F.transform(places, lambda s: F.struct(F.shiftright(s, 32).cast("int").alias("at"), s.bitwiseAND(F.lit(0xFFFFFFFF)).cast("int").alias("end")))
        least = lambda s, x: (s["at"] + F.array_position(x, F.array_min(x)).cast("int") - 1).alias("pos")
        made = lambda s, x: F.struct(F.xxhash64(x).alias("g"), s["at"].alias("at"), s["end"].alias("end"), F.array_min(x).alias("f"), least(s, x))
        return F.transform(places, lambda s: F.get(F.transform(F.array(F.slice(h, s["at"] + 1, s["end"] - s["at"])), lambda x: made(s, x)), F.lit(0)))

    # through a one-element array, so that each array is computed once and not for each element
    made = F.struct(hashes.alias("h"), words.alias("w"), F.reverse(words).alias("back"))
    found = F.transform(F.array(made), lambda x: of(x["h"], x["w"], x["back"]))
    none = F.expr("cast(array() as array<struct<g:bigint,at:int,end:int,f:bigint,pos:int>>)")
    return F.when(F.aggregate(words, F.lit(0).cast("long"), lambda a, x: a + x) >= MIN_WORDS, F.get(found, F.lit(0))).otherwise(none)


def repeats(docs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """All documents (doc_id, key, n_lines), and the deleted lines of each key as disjoint runs (runs: array of start,
    end) with their number and words."""
    key = row_hash(F.col("doc_id"), F.col("text"), SEED)
    base = docs.select("doc_id", key.alias("key"), _lines(F.col("text")).alias("lines"))
    part = lambda f: F.transform("lines", lambda s: s[f])
    base = materialise(base.select("doc_id", "key", part("h").alias("h"), part("w").alias("w"), part("p").alias("p"), _windows(F.col("lines")).alias("windows")), "line-rows")
    # fingerprints that stand at two places or more
    places = F.transform(F.array_distinct(F.transform("windows", lambda x: x["pos"])), lambda i: F.struct(i.alias("pos"), F.get("h", i).alias("f")))
    prints = base.select("key", F.explode(places).alias("a")).select("key", "a.pos", "a.f")
    spot = F.struct("key", "pos")
    again = prints.groupBy("f").agg(F.min(spot).alias("one"), F.max(spot).alias("other")).where("one <> other").select("f")
    place = F.struct(F.col("doc_id").isNull().alias("no"), F.col("doc_id").alias("doc_id"), F.col("key").alias("key"), F.col("x.at").alias("at"))
    windows = base.select("key", F.explode("windows").alias("x"), "doc_id").select(F.col("x.f").alias("f"), F.col("x.g").alias("g"), "key", F.col("x.at").alias("at"), F.col("x.end").alias("end"), place.alias("place"))
    windows = materialise(windows.join(again, "f", "left_semi").drop("f"), "line-windows")
    # extended both ways, a match is a window that has an earlier place
    firsts = windows.groupBy("g").agg(F.min("place").alias("first"), F.max("place").alias("last")).where("first <> last").select("g", F.col("first.key").alias("of"), F.col("first.at").alias("of_at"))
    runs = windows.select("g", "key", "at", "end").join(firsts, "g").where("key <> of or at <> of_at").select("key", F.col("at").alias("start"), "end").distinct()
    w = Window.partitionBy("key").orderBy("start", "end")
    before = F.coalesce(F.max("end").over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(-1))
    merged = runs.withColumn("before", before).withColumn("from", F.greatest("start", "before")).where(F.col("from") < F.col("end"))
    gone = merged.groupBy("key").agg(F.array_sort(F.collect_list(F.struct(F.col("from").alias("start"), "end"))).alias("runs"))
    long_ = lambda f: F.aggregate("runs", F.lit(0).cast("long"), lambda a, r: a + f(r))
    words = lambda r: F.aggregate(F.slice("w", r["start"] + 1, r["end"] - r["start"]), F.lit(0).cast("long"), lambda a, x: a + x)
    deleted = gone.join(base.select("key", "w").dropDuplicates(["key"]), "key").select("key", long_(lambda r: r["end"] - r["start"]).alias("n_removed"), long_(words).alias("removed_words"), "runs")
    return base.select("doc_id", "key", F.size("h").cast("long").alias("n_lines"), "p"), materialise(deleted, "line-deleted")


def dedup_lines(docs: DataFrame) -> DataFrame:
    """docs with the repeated lines deleted from text."""
    rows, deleted = repeats(docs.select("doc_id", "text"))
    gone = deleted.join(rows.select("key", "p").dropDuplicates(["key"]), "key")
    gone = gone.select("key", F.flatten(F.transform("runs", lambda r: F.slice("p", r["start"] + 1, r["end"] - r["start"]))).alias("gone"))
    rows = docs.select(row_hash(F.col("doc_id"), F.col("text"), SEED).alias("key"), packed(docs).alias("row")).join(gone, "key", "left")
    numbers = lambda lines: F.array_except(F.sequence(F.lit(0), F.size(lines) - 1), F.col("gone"))  # noqa: E731 - by a hash set, so in linear time
    kept = F.get(F.transform(F.array(F.split("row.text", "\n")), lambda lines: F.array_join(F.transform(numbers(lines), lambda i: F.get(lines, i)), "\n")), F.lit(0))
    text = F.when(F.col("gone").isNull(), F.col("row.text")).otherwise(kept)
    return rows.select(*[text.alias(c) if c == "text" else x for c, x in zip(docs.columns, unpacked("row", docs.columns))])


def op6_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows, deleted = repeats(table(spark, sf_dir, "documents").select("doc_id", "text"))
    zero = lambda c: F.coalesce(c, F.lit(0)).cast("long").alias(c)
    return rows.join(deleted, "key", "left").select("doc_id", "n_lines", zero("n_removed"), zero("removed_words"))


QUERIES = {"op6_line_dedup": op6_line_dedup}
_BLANK = "concat(' ', chr(9), chr(13), chr(11), chr(12))"
ORACLES = {
    "op6_line_dedup": f"""
WITH l AS (SELECT doc_id, unnest(s) AS x, generate_subscripts(s, 1) AS p FROM (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS s FROM documents)),
t AS (SELECT doc_id, trim(x, {_BLANK}) AS x, row_number() OVER (PARTITION BY doc_id ORDER BY p) - 1 AS i FROM l WHERE trim(x, {_BLANK}) <> ''),
n AS (SELECT *, len(x) - len(replace(x, ' ', '')) + 1 AS w FROM t),
c AS (SELECT *, sum(w) OVER (PARTITION BY doc_id ORDER BY i) AS till, till - w AS since, CAST(till AS BIGINT) - 50 AS back, CAST(since AS BIGINT) + 50 AS onward FROM n),
win AS (SELECT a.doc_id, a.i AS start_, b.i + 1 AS end_ FROM c a ASOF JOIN c b ON a.doc_id = b.doc_id AND a.onward <= b.till
 UNION SELECT a.doc_id, b.i, a.i + 1 FROM c a ASOF JOIN c b ON a.doc_id = b.doc_id AND a.back >= b.since),
h AS (SELECT doc_id, list(md5(x) ORDER BY i) AS h FROM n GROUP BY doc_id),
g AS (SELECT doc_id, start_, end_, row_number() OVER (PARTITION BY md5(array_to_string(h[start_ + 1:end_], '')) ORDER BY doc_id NULLS LAST, start_) AS k FROM win JOIN h USING (doc_id)),
gone AS (SELECT DISTINCT doc_id, unnest(range(start_, end_)) AS i FROM g WHERE k > 1),
r AS (SELECT doc_id, count(*) AS n_removed, CAST(sum(w) AS BIGINT) AS removed_words FROM gone JOIN n USING (doc_id, i) GROUP BY doc_id)
SELECT d.doc_id, coalesce(len(h), 0) AS n_lines, coalesce(n_removed, 0) AS n_removed, coalesce(removed_words, 0) AS removed_words
FROM documents d LEFT JOIN h USING (doc_id) LEFT JOIN r USING (doc_id)
""",
}
