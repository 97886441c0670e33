"""Toxicity by a factorization machine over hashed terms.

Terms are lower-cased words and their prefixes of PREFIXES bytes (inflected forms), as 64-bit hashes. From a bounded
sample of labelled rows (PER_CLASS of each label, by seeded hash) TERMS are kept: the most telling ones by a
log-likelihood ratio of document counts, and the COMMON most frequent others of toxic texts, which tell nothing alone
but may beside another. The machine scores the set of terms that a text has: a bias, a weight for each
term and, by the inner products of FACTORS numbers, for each pair of terms, so that two terms can mean more together
than the sum of each. It is fitted by AdaGrad in numpy; class weights restore the shares of the labels.
Every fifth sample row, left out of a first fit, tells how margins are shifted to suit THRESHOLD.

Defined results: null or empty text gets the score of no terms; without labelled rows of both kinds (an empty label
table included) the score is the share of toxic labels (0 without any); equal texts score alike, and repeated rows of a
labelled document count each time; terms of equal ratio or count are taken by hash; a very long text is scored whole, by
the set of its terms; an empty table gives no rows; other columns, whatever their names, are kept.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from codeweft.llm.common import Slots, chunks, discard, fold, free_name, labelled_sample, materialise, prefix_sums, remainder, span_hash, spans, table

PER_CLASS, SEED = 4000, "toxic-1"
PREFIXES, TERMS, COMMON, LEAST, FACTORS = (5, 6, 7), 4096, 256, 12.0, 8
EPOCHS, BATCH, RATE, L2 = 40, 256, 0.08, 2e-4
THRESHOLD = 0.3
SLOTS = 20


def terms(data: np.ndarray, offsets: np.ndarray):
    """Hashes of a chunk's terms with their rows: words, then prefixes of longer words."""
    data = fold(data)
    starts, ends, first = spans(data, offsets, "alnum")
    row = np.repeat(np.arange(len(offsets) - 1), np.diff(first))
    sums = prefix_sums(data)
    yield span_hash(sums, starts, ends), row
    for k in PREFIXES:
        long_ = ends - starts > k
        yield span_hash(sums, starts[long_], starts[long_] + k) ^ np.uint64(k * 0x9E3779B97F4A7C15 % (1 << 64)), row[long_]


class Machine:
    def __init__(self, hashes: np.ndarray, bias: float, w: np.ndarray, v: np.ndarray):
        """find: numbers of terms by hash, -1 for unknown ones."""
        self.find, self.bias, self.w, self.v = Slots(hashes, SLOTS), bias, w, v

    def score(self, row: np.ndarray, term: np.ndarray, n: int) -> np.ndarray:
        """row, term: distinct pairs."""
        linear = np.bincount(row, self.w[term], minlength=n)
        s = np.stack([np.bincount(row, self.v[term, f], minlength=n) for f in range(FACTORS)], 1)
        q = np.bincount(row, (self.v[term] ** 2).sum(1), minlength=n)
        return 1 / (1 + np.exp(-np.clip(self.bias + linear + 0.5 * ((s**2).sum(1) - q), -30, 30)))


def fit(rows: np.ndarray, ids: np.ndarray, y: np.ndarray, weight: np.ndarray, n_terms: int) -> tuple[float, np.ndarray, np.ndarray]:
    """rows (sorted), ids: the distinct terms of each sample row. AdaGrad on logistic loss."""
    rng = np.random.default_rng(7)
    w, v = np.zeros(n_terms), rng.normal(0, 0.02, (n_terms, FACTORS))
    rate = np.clip(np.average(y, weights=weight), 1e-4, 1 - 1e-4)
    bias, gb = float(np.log(rate / (1 - rate))), 1e-6
    gw, gv = np.full(n_terms, 1e-6), np.full((n_terms, FACTORS), 1e-4)
    bounds = np.searchsorted(rows, np.arange(len(y) + 1))
    for _ in range(EPOCHS):
        order = rng.permutation(len(y))
        for at in range(0, len(y), BATCH):
            pick = order[at : at + BATCH]
            size = bounds[pick + 1] - bounds[pick]
            r = np.repeat(np.arange(len(pick)), size)
            t = ids[np.repeat(bounds[pick], size) + np.arange(len(r)) - np.repeat(np.cumsum(size) - size, size)]
            vt = v[t]
            s = np.stack([np.bincount(r, vt[:, f], minlength=len(pick)) for f in range(FACTORS)], 1)
            q = np.bincount(r, (vt**2).sum(1), minlength=len(pick))
            m = bias + np.bincount(r, w[t], minlength=len(pick)) + 0.5 * ((s**2).sum(1) - q)
            d = weight[pick] * (1 / (1 + np.exp(-np.clip(m, -30, 30))) - y[pick]) / len(pick)
            used, inv = np.unique(t, return_inverse=True)
            dw = np.bincount(inv, d[r], minlength=len(used)) + L2 * w[used]
            dv = np.stack([np.bincount(inv, d[r] * (s[r, f] - vt[:, f]), minlength=len(used)) for f in range(FACTORS)], 1) + L2 * v[used]
            gw[used] += dw**2
            gv[used] += dv**2
            gb += d.sum() ** 2
            w[used] -= RATE * dw / np.sqrt(gw[used])
            v[used] -= 0.25 * RATE * dv / np.sqrt(gv[used])
            bias -= 0.25 * RATE * d.sum() / np.sqrt(gb)
    return bias, w, v


def _term_sets(texts: pa.Array) -> pa.Array:
    """The distinct term hashes of each text."""
    out, sizes = [], []
    for _, n, data, offsets in chunks(texts):
        h, row = (np.concatenate(x) for x in zip(*terms(data, offsets)))
        order = np.lexsort((h, row))
        h, row = h[order], row[order]
        new = np.r_[True, (h[1:] != h[:-1]) | (row[1:] != row[:-1])] if len(h) else np.zeros(0, bool)
        out.append(h[new].view(np.int64))
        sizes.append(np.bincount(row[new], minlength=n))
    size = np.concatenate(sizes) if sizes else np.zeros(0, np.int64)
    return pa.ListArray.from_arrays(pa.array(np.r_[0, np.cumsum(size)], pa.int32()), pa.array(np.concatenate(out) if out else np.zeros(0, np.int64)))


def _chosen(sets: DataFrame, toxic: int, clean: int) -> np.ndarray:
    """Hashes of the terms to keep, counted where the sample lies: the most telling ones by log-likelihood ratio, then
    the most frequent others of toxic texts, which may matter beside others only."""
    one = sets.select(F.explode("terms").alias("h"), "y").groupBy("h").agg(F.count_if(F.col("y") == 1).cast("double").alias("a"), F.count_if(F.col("y") != 1).cast("double").alias("b"))
    every, has = float(toxic + clean), F.col("a") + F.col("b")

    def part(k, total, of):  # k of total rows, where `of` of every row would be expected to be spread evenly
        return F.when(k > 0, k * F.log(k * every / (of * total))).otherwise(0.0)

    ratio = 2 * (part(F.col("a"), toxic, has) + part(F.col("b"), clean, has) + part(toxic - F.col("a"), toxic, every - has) + part(clean - F.col("b"), clean, every - has))
    told = one.withColumn("ratio", F.round(ratio, 6))
    best = told.where(F.col("ratio") >= LEAST).orderBy(F.desc("ratio"), "h").limit(TERMS - COMMON).select("h").toArrow()["h"].to_numpy()
    also = told.where("a >= 3").orderBy(F.desc("a"), "h").limit(TERMS).select("h").toArrow()["h"].to_numpy()
    return np.concatenate([best, also[~np.isin(also, best)][:COMMON]]).astype(np.int64).view(np.uint64)


def train(docs: DataFrame, labels: DataFrame, label: str = "toxic", per_class: int = PER_CLASS) -> Machine:
    """The driver gets the numbers of kept terms only: two bytes for each of a sample row's, TERMS at most."""
    sample = labelled_sample(labels.select("doc_id", label), label, per_class, SEED)
    sets = F.arrow_udf(_term_sets, "array<bigint>")
    rows = docs.join(F.broadcast(sample), docs["doc_id"] == F.col("id")).select("id", sets("text").alias("terms"), "y", "of")
    rows = materialise(rows, "toxic-sample")
    share = {float(r.y): r.n for r in rows.groupBy("y").agg(F.count("*").alias("n")).collect()}  # two labels
    toxic, clean = share.get(1.0, 0), sum(n for y, n in share.items() if y != 1.0)
    if not toxic or not clean:
        discard(rows)
        return Machine(np.zeros(0, np.uint64), 30.0 if toxic else -30.0, np.zeros(0), np.zeros((0, FACTORS)))
    hashes = _chosen(rows, toxic, clean)
    known = Slots(hashes, SLOTS)

    @F.arrow_udf("binary")
    def numbers(terms: pa.Array) -> pa.Array:
        found = known(terms.flatten().to_numpy(zero_copy_only=False).astype(np.int64).view(np.uint64))
        ends = np.cumsum([len(x) if x.is_valid else 0 for x in terms])
        return pa.array([np.sort(x[x >= 0]).astype(np.uint16).tobytes() for x in np.split(found, ends[:-1])] if len(terms) else [], pa.binary())

    got = rows.select("id", numbers("terms").alias("ids"), "y", "of").toArrow().sort_by([("id", "ascending"), ("ids", "ascending")])
    discard(rows)
    y = (got["y"].to_numpy().astype(float) == 1).astype(float)
    each = [np.frombuffer(x.as_buffer(), np.uint16) for x in got["ids"]]
    row, ids = np.repeat(np.arange(len(y)), [len(x) for x in each]), np.concatenate(each).astype(np.int64)
    of = got["of"].to_numpy().astype(float)
    weight = np.where(y == 1, of / toxic, of / clean)
    weight = weight / weight.mean()
    bias, w, v = fit(row, ids, y, weight, len(hashes))
    return Machine(hashes, bias + shift(row, ids, y, weight, len(hashes)), w, v)


def shift(row: np.ndarray, ids: np.ndarray, y: np.ndarray, weight: np.ndarray, n_terms: int) -> float:
    """What to add to margins so that THRESHOLD is where a machine fitted without every fifth row judges those rows
    best (by F1 of the weighted counts). 0 if they are too few to tell."""
    check = np.arange(len(y)) % 5 == 4
    if min(y[check].sum(), (1 - y[check]).sum()) < 20:
        return 0.0
    of = lambda rows: (np.cumsum(rows)[row[rows[row]]] - 1, ids[rows[row]])
    machine = Machine(np.zeros(0, np.uint64), *fit(*of(~check), y[~check], weight[~check], n_terms))
    score, toxic, share = machine.score(*of(check), int(check.sum())), y[check] == 1, weight[check]
    logit = lambda p: np.log(p / (1 - p))
    best = (-1.0, 0.0, 0.0)
    for t in np.arange(0.1, 0.51, 0.05):
        said = score >= t
        f1 = 2 * share[said & toxic].sum() / max(share[said].sum() + share[toxic].sum(), 1e-9)
        best = max(best, (f1, -abs(t - THRESHOLD), logit(THRESHOLD) - logit(t)))
    return float(best[2])


def score_udf(model: Machine):
    @F.arrow_udf("double")
    def toxicity(texts: pa.Array) -> pa.Array:
        out = []
        for _, n, data, offsets in chunks(texts):
            pairs = [np.zeros(0, np.int64)]
            for h, row in terms(data, offsets):
                at = model.find(h)
                pairs.append(row[at >= 0] * TERMS + at[at >= 0])
            pair = np.unique(np.concatenate(pairs))
            out.append(model.score(pair // TERMS, pair % TERMS, n))
        return pa.array(np.concatenate(out) if out else np.zeros(0), pa.float64())

    return toxicity


def scored(docs: DataFrame, labels: DataFrame, fold_of: int = 4, held_out: int = 2) -> DataFrame:
    """docs with a column `toxicity` (`toxicity_` beside one of that name), learnt from labelled rows outside the
    held-out fold."""
    known = labels.where(remainder(F.col("doc_id"), fold_of) != held_out)
    return docs.withColumn(free_name(docs, "toxicity"), score_udf(train(docs.select("doc_id", "text"), known))("text"))


def op4_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = scored(table(spark, sf_dir, "documents").select("doc_id", "text"), table(spark, sf_dir, "labels"))
    return out.select("doc_id", (remainder(F.col("doc_id"), 4) == 2).alias("held_out"), F.col("toxicity").alias("score"), (F.col("toxicity") >= THRESHOLD).cast("int").alias("predicted"))


QUERIES = {"op4_toxicity": op4_toxicity}
#: A fitted model can't be written in SQL; tested by held-out accuracy.
ORACLES: dict[str, str] = {}
