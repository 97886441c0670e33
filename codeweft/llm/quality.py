"""Quality rules: gradient-boosted trees over document statistics, with monotonic constraints.

Statistics are counted over whole texts, vectorised over the bytes of Arrow batches. The trees are grown in numpy from
a bounded sample of labelled rows (PER_CLASS of each label, by seeded hash) and flattened into node arrays, which score
a batch level by level. MONOTONE says in which direction the probability of good quality may move with a feature: a
split against it is not taken, and child values are kept within the bounds that splits above have set.

Defined results: null or empty text has no words and fails the base rule; without labelled rows of both kinds, or with
an empty label table, the verdict is the base rule's; equal rows are judged alike, and repeated rows of a labelled
document count each time; of splits of equal gain the first feature and threshold win; a very long text is counted
whole; an empty table gives no rows; other columns, whatever their names, are kept.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from codeweft.llm.common import chunks, fold, free_name, labelled_sample, mix, per_row, prefix_sums, span_hash, spans, struct_array, table

PER_CLASS, SEED = 4000, "quality-1"
TREES, DEPTH, BINS, RATE, LEAF, RIDGE = 60, 3, 32, 0.15, 20, 1.0
THRESHOLD = 0.35
COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_upper", "n_digits", "n_punct", "n_lines", "n_distinct", "n_chars")
FEATURES = ("log_words", "word_length", "symbols", "dup_lines", "repeats", "upper", "digits", "punct", "line_words", "distinct")
MONOTONE = {"symbols": -1, "dup_lines": -1, "repeats": -1}
_symbol, _upper, _digit, _punct = (np.zeros(256, bool) for _ in range(4))
_symbol[list(b"#*$%&|<>")] = _upper[65:91] = _digit[48:58] = _punct[list(b"!?.,;:")] = True


def count_chunk(data: np.ndarray, offsets: np.ndarray) -> dict[str, np.ndarray]:
    """COUNTS of each text of a chunk."""
    starts, ends, first = spans(data, offsets)
    n = len(offsets) - 1
    words = np.diff(first)
    point = (data & 0xC0) != 0x80
    space = np.zeros(256, bool)
    space[[32, 9, 10, 11, 12, 13]] = True
    out = {"n_words": words, "word_chars": per_row(point & ~space[data], offsets), "n_chars": per_row(point, offsets)}
    for name, mark in (("n_symbols", _symbol), ("n_upper", _upper), ("n_digits", _digit), ("n_punct", _punct)):
        out[name] = per_row(mark[data], offsets)
    sums = prefix_sums(data)
    row = np.repeat(np.arange(n), words)
    salt = mix(np.arange(n, dtype=np.uint64) + np.uint64(1))
    h = span_hash(sums, starts, ends)
    # three-word windows that stand twice or more in their text
    repeated = np.zeros(len(h) + 1, np.int64)
    if len(h) >= 3:
        with np.errstate(over="ignore"):
            three = mix((h[:-2] * np.uint64(3) + h[1:-1]) * np.uint64(0x9E3779B97F4A7C15) + h[2:]) ^ salt[row[:-2]]
        whole = np.flatnonzero(row[:-2] == row[2:])
        _, inverse, number = np.unique(three[whole], return_inverse=True, return_counts=True)
        at = whole[number[inverse] > 1]
        np.add.at(repeated, at, 1)
        np.add.at(repeated, at + 3, -1)
    out["n_repeat_words"] = per_row(np.cumsum(repeated[:-1]) > 0, first)
    distinct = np.unique(h ^ salt[row]) if len(h) else h
    # lines with a word, equal to an earlier line
    cut = np.flatnonzero(data == 10)
    cut = cut[np.searchsorted(cut, offsets[0]) :]
    begin = np.unique(np.r_[offsets[:-1][np.diff(offsets) > 0], cut + 1])
    begin = begin[begin < len(data)]
    end = np.r_[begin[1:], len(data)].astype(np.int64)[: len(begin)]
    if len(begin):
        end = np.where((end > begin) & (data[np.maximum(end - 1, 0)] == 10), end - 1, end)
    has = np.searchsorted(starts, end) > np.searchsorted(starts, begin)
    begin, end = begin[has], end[has]
    line_row = np.searchsorted(offsets, begin, "right") - 1
    line = span_hash(sums, begin, end) ^ salt[line_row] if len(begin) else np.zeros(0, np.uint64)
    out["n_lines"] = np.bincount(line_row, minlength=n)
    first_seen = np.unique(line, return_index=True)[1]
    out["n_dup_lines"] = out["n_lines"] - np.bincount(line_row[first_seen], minlength=n)
    order = np.unique(h ^ salt[row], return_index=True)[1] if len(distinct) else np.zeros(0, np.int64)
    out["n_distinct"] = np.bincount(row[order], minlength=n)
    return {k: out[k].astype(np.int64) for k in COUNTS}


def features(c: dict[str, np.ndarray]) -> np.ndarray:
    words, chars = np.maximum(c["n_words"], 1), np.maximum(c["n_chars"], 1)
    x = [
        np.log1p(c["n_words"]), c["word_chars"] / words, c["n_symbols"] / words, c["n_dup_lines"] / np.maximum(c["n_lines"], 1), c["n_repeat_words"] / words,
        c["n_upper"] / chars, c["n_digits"] / chars, c["n_punct"] / words, c["n_words"] / np.maximum(c["n_lines"], 1), c["n_distinct"] / words,
    ]
    return np.stack(x, 1).astype(np.float32)


class Trees:
    """Flat node arrays: feature (-1: leaf), threshold (right if above), child (left; right is the next), value."""

    def __init__(self, feature, threshold, child, value, roots, base):
        self.feature, self.threshold, self.child, self.value, self.roots, self.base = feature, threshold, child, value, roots, base

    def score(self, x: np.ndarray) -> np.ndarray:
        at = np.tile(self.roots, (len(x), 1))
        rows = np.arange(len(x))[:, None]
        for _ in range(DEPTH):
            f = self.feature[at]
            go = self.child[at] + (x[rows, np.maximum(f, 0)] > self.threshold[at])
            at = np.where(f < 0, at, go)
        return 1 / (1 + np.exp(-(self.base + self.value[at].sum(1))))


def fit(x: np.ndarray, y: np.ndarray, weight: np.ndarray, monotone: dict[int, int]) -> Trees:
    """Newton boosting of logistic loss over quantile bins."""
    edges = [np.unique(np.quantile(x[:, j], np.linspace(0, 1, BINS + 1)[1:-1])) for j in range(x.shape[1])]
    binned = np.stack([np.searchsorted(e, x[:, j]) for j, e in enumerate(edges)], 1)
    rate = np.clip(np.average(y, weights=weight), 1e-4, 1 - 1e-4)
    base = float(np.log(rate / (1 - rate)))
    nodes: dict[str, list] = {"feature": [], "threshold": [], "child": [], "value": []}
    margin, roots = np.full(len(y), base), []

    def add() -> int:
        for k, v in (("feature", -1), ("threshold", 0.0), ("child", 0), ("value", 0.0)):
            nodes[k].append(v)
        return len(nodes["value"]) - 1

    def grow(at: int, rows: np.ndarray, depth: int, low: float, high: float) -> None:
        G, H = g[rows].sum(), h[rows].sum()
        nodes["value"][at] = float(np.clip(-G / (H + RIDGE), low, high)) * RATE
        best = (1e-6, None)
        for j in range(x.shape[1]) if depth < DEPTH and len(rows) >= 2 * LEAF else ():
            b = binned[rows, j]
            gl, hl, nl = (np.cumsum(np.bincount(b, v, minlength=len(edges[j]) + 1))[:-1] for v in (g[rows], h[rows], np.ones(len(rows))))
            left, right = np.clip(-gl / (hl + RIDGE), low, high), np.clip(-(G - gl) / (H - hl + RIDGE), low, high)
            cost = lambda v, gg, hh: gg * v + 0.5 * (hh + RIDGE) * v * v
            gain = cost(np.clip(-G / (H + RIDGE), low, high), G, H) - cost(left, gl, hl) - cost(right, G - gl, H - hl)
            ok = (nl >= LEAF) & (len(rows) - nl >= LEAF) & ((right - left) * monotone.get(j, 0) >= 0)
            if ok.any() and gain[k := int(np.argmax(np.where(ok, gain, -np.inf)))] > best[0]:
                best = (gain[k], (j, k, float(left[k]), float(right[k])))
        if best[1] is None:
            margin[rows] += nodes["value"][at]
            return
        j, k, vl, vr = best[1]
        left, right = add(), add()
        nodes["feature"][at], nodes["threshold"][at], nodes["child"][at] = j, float(edges[j][k]), left
        mid, way = (vl + vr) / 2, monotone.get(j, 0)
        grow(left, rows[binned[rows, j] <= k], depth + 1, mid if way < 0 else low, mid if way > 0 else high)
        grow(right, rows[binned[rows, j] > k], depth + 1, mid if way > 0 else low, mid if way < 0 else high)

    for _ in range(TREES):
        p = 1 / (1 + np.exp(-margin))
        g, h = weight * (p - y), weight * p * (1 - p)
        roots.append(add())
        grow(roots[-1], np.arange(len(y)), 0, -4.0, 4.0)
    return Trees(*(np.array(nodes[k]) for k in ("feature", "threshold", "child", "value")), np.array(roots), base)


_COUNT_TYPES = {k: pa.int64() for k in COUNTS}


def counts_udf(model: Trees | None):
    """COUNTS and the model's probability of good quality (null without a model)."""

    @F.arrow_udf("struct<" + ",".join(f"{k}:bigint" for k in COUNTS) + ",good:double>")
    def judge(texts: pa.Array) -> pa.Array:
        got: dict[str, list] = {k: [] for k in (*COUNTS, "good")}
        for _, n, data, offsets in chunks(texts):
            c = count_chunk(data, offsets)
            for k in COUNTS:
                got[k].append(c[k])
            got["good"].append(model.score(features(c)) if model else np.ones(n))
        return struct_array(got, _COUNT_TYPES | {"good": pa.float64()})

    return judge


def train(docs: DataFrame, labels: DataFrame, label: str = "quality", per_class: int = PER_CLASS) -> Trees | None:
    """Grows trees from a bounded sample of labelled documents; None unless both labels occur."""
    sample = labelled_sample(labels.select("doc_id", label), label, per_class, SEED)
    got = docs.join(F.broadcast(sample), docs["doc_id"] == F.col("id")).select(counts_udf(None)("text").alias("c"), "y", "of").select("c.*", "y", "of").toPandas()
    if got["y"].nunique() < 2:
        return None
    x = features({k: got[k].to_numpy() for k in COUNTS})
    y = got["y"].to_numpy(float)
    weight = (got["of"] / got.groupby("y")["y"].transform("size")).to_numpy(float)
    return fit(x, y, weight / weight.mean(), {FEATURES.index(k): v for k, v in MONOTONE.items()})


def judged(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """docs with a struct column `judged` (`judged_` beside one of that name): COUNTS, good (probability), base_failed,
    kept."""
    model = train(docs.select("doc_id", "text"), labels)
    name = free_name(docs, "judged")
    out = docs.withColumn(name, counts_udf(model)("text"))
    c = lambda k: F.col(f"{name}.{k}")
    failed = (c("n_words") < 50) | (100 * c("n_repeat_words") > 50 * c("n_words"))
    fields = [c(k).alias(k) for k in (*COUNTS, "good")]
    return out.withColumn(name, F.struct(*fields, failed.alias("base_failed"), (~failed & (c("good") >= threshold)).alias("kept")))


def op3_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = judged(table(spark, sf_dir, "documents").select("doc_id", "text"), table(spark, sf_dir, "labels"))
    return out.select("doc_id", *[F.col(f"judged.{k}") for k in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "good")])


QUERIES = {"op3_quality": op3_quality}
#: Trained trees can't be written in SQL; the counts are tested against brute force.
ORACLES: dict[str, str] = {}
