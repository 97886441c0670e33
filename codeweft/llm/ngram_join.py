"""N-gram Jaccard join by MinHash banding, verified on full n-gram sets.

A document's n-grams are sequences of WORDS lower-cased words (all of a shorter text is one). Documents with equal sets
form a class (copies), of which one member goes on. Band and row counts are chosen for the target recall: the least
number of bands that misses a pair at the threshold with a probability below 1 - RECALL. Classes that share a band hash
are tied to the bucket's least class (its centre), never to each other, and the ties' components are the only groups in
which links can lie.

A group is one block, or, if it holds more than MEMBERS classes or HASHES n-grams, its classes of one least centre are
dealt to blocks of about that size. Pairs are verified on full sets within each block and between blocks that share a
bucket: a task counts intersections by matrix products, and returns for each class the number of documents linked and
the least class that its links lead to instead of the pairs. Small groups share a task. The components of those ties
are the near-duplicate classes.

No pairs are ever written, no member is dropped, and a group of any size is dealt over many tasks. A set travels once
for each block that its own block meets: in a group of m different texts that all share buckets that is m / MEMBERS
times, as each pair has to be looked at.

Defined results: null text or text without words has no n-grams: no links, its own class. class_id is the least doc_id
of the class (null if all are null); n_links counts the other documents with similarity of at least the threshold,
copies included. Repeated rows are copies of each other; ties between rows go to the lesser doc_id, then hash; a very
long text has all its n-grams; an empty table gives no rows; other columns, whatever their names, are kept.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from codeweft.llm.common import chunks, fold, materialise, mix, numbered, packed, prefix_sums, row_hash, shingle_hashes, span_hash, spans, table, unpacked
from codeweft.llm.components import star_components

WORDS, THRESHOLD, RECALL, ROWS = 5, 0.8, 0.99995, 4
MEMBERS, HASHES, PACK = 1024, 4_000_000, 250_000
SEED = "near-1"
#: Beyond so many meetings of classes with blocks, texts are fetched by a shuffle join instead of a broadcast of their keys.
BROADCAST = 500_000


def bands_for(threshold: float, recall: float, rows: int) -> int:
    return int(np.ceil(np.log(1 - recall) / np.log(1 - threshold**rows)))


def ngram_sets(data: np.ndarray, offsets: np.ndarray, words: int) -> tuple[np.ndarray, np.ndarray]:
    """The distinct n-gram hashes of each text of a chunk, sorted, and each text's first (one more)."""
    data = fold(data)
    starts, ends, first = spans(data, offsets, "alnum")
    h, begin = shingle_hashes(span_hash(prefix_sums(data), starts, ends), first, words)
    row = np.repeat(np.arange(len(begin) - 1), np.diff(begin))
    order = np.argsort(h, kind="stable")
    order = order[np.argsort(row[order], kind="stable")]
    h, row = h[order], row[order]
    new = np.ones(len(h), bool)
    new[1:] = (h[1:] != h[:-1]) | (row[1:] != row[:-1])
    return h[new], np.r_[0, np.cumsum(np.bincount(row[new], minlength=len(offsets) - 1))]


def _signature_udf(words: int, n_bands: int, rows: int):
    rng = np.random.default_rng(5)
    odd = (rng.integers(0, 1 << 63, n_bands * rows, dtype=np.uint64) << np.uint64(1)) | np.uint64(1)

    @F.arrow_udf("struct<a:bigint,b:bigint,n:bigint,bands:array<bigint>>")
    def sign(texts: pa.Array) -> pa.Array:
        got: list[list] = [[], [], [], [], []]
        for _, n, data, offsets in chunks(texts):
            h, begin = ngram_sets(data, offsets, words)
            size = np.diff(begin)
            some = np.flatnonzero(size)
            at = begin[:-1][some]
            a, b = np.zeros(n, np.uint64), np.zeros(n, np.uint64)
            bands = np.zeros((len(some), n_bands), np.uint64)
            if len(some):
                with np.errstate(over="ignore"):
                    a[some] = np.add.reduceat(mix(h), at)
                    b[some] = np.add.reduceat(mix(h ^ np.uint64(0x5851F42D4C957F2D)), at)
                    for i in range(n_bands):
                        x = np.full(len(some), i + 1, np.uint64)
                        for j in range(rows):
                            x = mix(x * np.uint64(31) + np.minimum.reduceat(h * odd[i * rows + j], at))
                        bands[:, i] = x
            for k, v in enumerate((a.view(np.int64), b.view(np.int64), size.astype(np.int64), np.where(size > 0, n_bands, 0), bands.ravel().view(np.int64))):
                got[k].append(v)
        flat = [np.concatenate(v) if v else np.zeros(0, np.int64) for v in got]
        lists = pa.ListArray.from_arrays(pa.array(np.r_[0, np.cumsum(flat[3])], pa.int32()), pa.array(flat[4], pa.int64()))
        return pa.StructArray.from_arrays([*(pa.array(v, pa.int64()) for v in flat[:3]), lists], ["a", "b", "n", "bands"])

    return sign


def _sets_udf(words: int):
    @F.arrow_udf("array<bigint>")
    def sets(texts: pa.Array) -> pa.Array:
        out, sizes = [], []
        for _, _, data, offsets in chunks(texts):
            h, begin = ngram_sets(data, offsets, words)
            out.append(h.view(np.int64))
            sizes.append(np.diff(begin))
        flat = lambda v: np.concatenate(v) if v else np.zeros(0, np.int64)
        return pa.ListArray.from_arrays(pa.array(np.r_[0, np.cumsum(flat(sizes))], pa.int32()), pa.array(flat(out), pa.int64()))

    return sets


def intersections(sets: list[np.ndarray]) -> np.ndarray:
    """Sizes of all pairwise intersections. N-grams that stand in the same sets count as one column with a weight."""
    m = len(sets)
    row = np.repeat(np.arange(m), [len(s) for s in sets])
    _, col, number = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    keep = number[col] > 1
    row, col = row[keep], col[keep]
    if not len(col):
        return np.zeros((m, m), np.float32)
    salt = mix(np.arange(1, m + 1, dtype=np.uint64))
    order = np.argsort(col, kind="stable")
    row, col = row[order], col[order]
    begin = np.flatnonzero(np.r_[True, col[1:] != col[:-1]])
    with np.errstate(over="ignore"):
        pattern = np.add.reduceat(salt[row], begin)
    _, one, weight = np.unique(pattern, return_index=True, return_counts=True)
    size = np.diff(np.r_[begin, len(col)])
    out = np.zeros((m, m), np.float32)
    for at in range(0, len(one), 2048):
        part = one[at : at + 2048]
        length = size[part]
        c = np.repeat(np.arange(len(part)), length)
        r = row[np.repeat(begin[part], length) + np.arange(len(c)) - np.repeat(np.cumsum(length) - length, length)]
        x = np.zeros((m, len(part)), np.float32)
        x[r, c] = 1
        out += (x * weight[at : at + 2048].astype(np.float32)) @ x.T
    return out


def least_linked(linked: np.ndarray) -> np.ndarray:
    """The least member of each member's component, by a symmetric boolean matrix."""
    out, open_ = np.arange(len(linked)), np.ones(len(linked), bool)
    for seed in range(len(linked)):
        if not open_[seed]:
            continue
        open_[seed] = False
        queue = [seed]
        while queue:
            new = np.flatnonzero(linked[queue.pop()] & open_)
            open_[new] = False
            out[new] = seed
            queue += new.tolist()
    return out


def _verify(threshold: float):
    up, down = float(threshold).as_integer_ratio() if threshold != 0.8 else (4, 5)

    def verify(pdf: pd.DataFrame) -> pd.DataFrame:
        ids, links, least = [], [], []
        for (i, j), g in pdf.drop_duplicates(["i", "j", "set_id"]).groupby(["i", "j"]):
            g = g.sort_values("set_id")
            name, n, copies, block = (g[c].to_numpy() for c in ("set_id", "n", "copies", "block"))
            inter = intersections([np.asarray(s) for s in g["hashes"]])
            linked = down * inter.astype(np.float64) >= up * (n[:, None] + n[None, :] - inter)
            np.fill_diagonal(linked, False)
            if i != j:
                linked &= block[:, None] != block[None, :]
            ids.append(name)
            links.append(linked @ copies)
            least.append(name[least_linked(linked)])
        return pd.DataFrame({"set_id": np.concatenate(ids), "links": np.concatenate(links).astype(np.int64), "least": np.concatenate(least)})

    return verify


def near_duplicates(docs: DataFrame, words: int = WORDS, threshold: float = THRESHOLD, recall: float = RECALL, rows: int = ROWS) -> DataFrame:
    """A row for each document: doc_id, row_key, n_shingles, class_id, n_links, first (whether it has the least row
    of its class by doc_id, then row_key; each document without n-grams is first)."""
    n_bands = bands_for(threshold, recall, rows)
    base = docs.select("doc_id", "text").withColumn("s", _signature_udf(words, n_bands, rows)("text"))
    set_id = F.concat(F.lpad(F.hex("s.a"), 16, "0"), F.lpad(F.hex("s.b"), 16, "0"))
    base = materialise(base.select("doc_id", row_hash(F.col("doc_id"), F.col("text"), SEED).alias("row_key"), F.when(F.col("s.n") > 0, set_id).alias("set_id"), F.col("s.n").alias("n"), "s.bands"), "near-signatures")
    order = F.struct(F.col("doc_id").isNull().alias("no"), F.col("doc_id").alias("doc_id"), F.col("row_key").alias("row_key"))
    classes = materialise(
        base.where("n > 0").groupBy("set_id").agg(F.count("*").alias("copies"), F.min(order).alias("least"), F.first("n").alias("n"), F.first("bands").alias("bands")), "near-classes"
    )
    buckets = classes.select("set_id", F.explode("bands").alias("h"))
    centres = buckets.groupBy("h").agg(F.min("set_id").alias("v"), F.count("*").alias("c")).where("c > 1").select("h", "v")
    ties = materialise(buckets.join(centres, "h").select(F.col("set_id").alias("u"), "v").distinct(), "near-ties")
    groups = star_components(ties, "near-groups")
    members = groups.join(classes.select("set_id", "copies", "n", F.col("least.row_key").alias("key")), F.col("node") == F.col("set_id"))
    parts = lambda: F.greatest(F.ceil(F.count("*") / MEMBERS), F.ceil(F.sum("n") / HASHES)).cast("int").alias("parts")
    # a group that fits is one block; else its classes of one least centre are dealt to blocks
    whole = members.groupBy("label").agg(parts()).select("label", F.when(F.col("parts") == 1, F.col("parts")).alias("single"))
    split = members.join(whole.where("single is null").select("label"), "label", "left_semi").groupBy("centre").agg(parts())
    block = F.when(F.col("single") == 1, F.col("label")).otherwise(F.concat_ws(":", "centre", F.pmod(F.xxhash64("set_id"), F.col("parts"))))
    members = materialise(members.join(whole, "label").join(split, "centre", "left").select("set_id", "key", "copies", "n", block.alias("block"), F.col("single").isNotNull().alias("single")), "near-blocks")
    # a block meets itself and the blocks it shares a bucket with; groups of one block share tasks
    at = members.where("not single").select("set_id", "block").join(buckets, "set_id").join(centres.select("h"), "h", "left_semi").select("h", "block").distinct()
    met = at.select("h", F.col("block").alias("i")).join(at.select("h", F.col("block").alias("j")), "h").where("i <= j").select("i", "j").distinct()
    meetings = met.select(F.explode(F.array_distinct(F.array("i", "j"))).alias("block"), F.struct("i", "j").alias("pair")).groupBy("block").agg(F.collect_list("pair").alias("pairs"))
    itself = F.array(F.struct(F.col("block").alias("i"), F.col("block").alias("j")))
    members = materialise(members.join(meetings, "block", "left").withColumn("pairs", F.coalesce("pairs", itself)), "near-members")
    known = members.agg(F.sum(F.size("pairs")).alias("c"), F.sum(F.when(F.col("single"), F.col("n"))).alias("s")).first()
    packs = max(1, int((known["s"] or 0) // PACK) + 1)
    wanted = F.broadcast(members) if (known["c"] or 0) <= BROADCAST else members
    texts = docs.select(row_hash(F.col("doc_id"), F.col("text"), SEED).alias("key"), "text").join(wanted, "key")
    sets = texts.select("set_id", "copies", "n", "block", "single", "pairs", _sets_udf(words)("text").alias("hashes"))
    task = F.when(F.col("single"), F.pmod(F.xxhash64("block"), F.lit(packs)).cast("string")).otherwise(F.concat_ws("+", "pair.i", "pair.j"))
    dealt = sets.withColumn("pair", F.explode("pairs")).select("set_id", "copies", "n", "block", "hashes", "pair.i", "pair.j", task.alias("task"))
    found = materialise(dealt.groupBy("task").applyInPandas(_verify(threshold), "set_id string, links long, least string"), "near-links")
    links = found.groupBy("set_id").agg(F.sum("links").alias("links"))
    trees = star_components(found.select(F.col("set_id").alias("u"), F.col("least").alias("v")).distinct(), "near-classes-of")
    joined = classes.select("set_id", "copies", "least").join(links, "set_id", "left").join(trees, F.col("set_id") == F.col("node"), "left")
    joined = materialise(joined.select("set_id", "least", F.coalesce("label", "set_id").alias("label"), (F.col("copies") - 1 + F.coalesce("links", F.lit(0))).alias("n_links")), "near-linked")
    heads = joined.groupBy("label").agg(F.min("least").alias("head"))
    of = joined.join(heads, "label").select("set_id", "head", "n_links")
    rows_ = base.select("doc_id", "row_key", "set_id", F.col("n").alias("n_shingles")).join(of, "set_id", "left")
    return rows_.select(
        "doc_id", "row_key", "n_shingles",
        F.when(F.col("set_id").isNull(), F.col("doc_id")).otherwise(F.col("head.doc_id")).alias("class_id"),
        F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"),
        (F.col("set_id").isNull() | (F.col("row_key") == F.col("head.row_key"))).alias("first"),
    )


def distinct_documents(docs: DataFrame) -> DataFrame:
    """docs with one document of each class."""
    keep = near_duplicates(docs).where("first").groupBy("row_key").agg(F.max(F.col("n_shingles") == 0).alias("empty"))
    rows = docs.select(row_hash(F.col("doc_id"), F.col("text"), SEED).alias("row_key"), packed(docs).alias("row"))
    kept = numbered(rows.join(keep, "row_key"), "row_key", "copy").where("copy = 1 or empty")
    return kept.select(*unpacked("row", docs.columns))


def op7_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents").select("doc_id", "text")).select("doc_id", "class_id", "n_links", "n_shingles")


QUERIES = {"op7_ngram_join": op7_ngram_join}
#: All pairs, by a join on every n-gram: for small tables.
ORACLES = {
    "op7_ngram_join": r"""
WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
s AS (SELECT doc_id, list_distinct(CASE WHEN len(w) >= 5 THEN list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' ')) WHEN len(w) > 0 THEN [array_to_string(w, ' ')] ELSE [] END) AS g FROM w),
p AS (SELECT doc_id, len(g) AS n, unnest(g) AS h FROM s),
m AS (SELECT a.doc_id AS a, b.doc_id AS b, any_value(a.n) AS na, any_value(b.n) AS nb, count(*) AS m FROM p a JOIN p b ON a.h = b.h AND a.doc_id <> b.doc_id GROUP BY 1, 2),
e AS (SELECT a, b FROM m WHERE 5 * m >= 4 * (na + nb - m)),
c(id, class_id) USING KEY (id) AS (SELECT doc_id, doc_id FROM s UNION SELECT e.b, min(c.class_id) FROM c JOIN e ON e.a = c.id JOIN recurring.c AS was ON was.id = e.b WHERE c.class_id < was.class_id GROUP BY e.b)
SELECT s.doc_id, c.class_id, coalesce(l.n, 0) AS n_links, CAST(len(s.g) AS BIGINT) AS n_shingles FROM s JOIN c ON c.id = s.doc_id LEFT JOIN (SELECT a, count(*) AS n FROM e GROUP BY a) l ON l.a = s.doc_id
""",
}
