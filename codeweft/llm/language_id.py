"""Language identification by error-correcting output codes.

Each language gets a codeword; a binary classifier over hashed byte n-grams (of lower-cased text with every run of
other ASCII read as one gap) predicts each bit. Codewords are drawn from a fixed seed so that the least distance
between two is large. Decoding adds up each bit's logistic loss for each codeword, weighted by how reliable the bit was
on a validation part of the sample, and takes the least; `ambiguous` marks a runner-up that is nearly as close.

The classifiers are fitted in numpy on a bounded sample: PER_LANGUAGE rows of each language, by seeded hash, but no
more than SAMPLE rows in all (one of each language at least), so that the driver holds SAMPLE times 32 KB however many
languages there are.

Defined results: null text or text without a letter is `und` with score 0; if nothing can be learnt all are `und`; with
one language all text with a letter is of that; ties go to the language first in order of code points; equal texts get
equal results and repeated rows count each time; a very long text is read whole, by counts of n-grams; an empty table
gives no rows; other columns, whatever their names, are kept.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from codeweft.llm.common import chunks, fold, free_name, labelled_sample, remainder, table

#: Rows of each language, and of all: with more languages each has fewer.
PER_LANGUAGE, SAMPLE, SEED = 800, 6400, "language-1"
BITS, GRAMS = 12, (2, 3)
MARGIN = 0.15
_letters = np.full(256, 32, np.uint8)
_letters[97:123] = np.arange(97, 123)
_letters[128:] = np.arange(128, 256)


def gram_counts(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Rows of n-gram counts, 2 ** BITS for each length, as square roots scaled to unit length. No n-gram crosses rows."""
    n = len(offsets) - 1
    data = _letters[fold(data)].astype(np.uint32)
    row = np.repeat(np.arange(n), np.diff(offsets))
    out = np.zeros((n, len(GRAMS) << BITS), np.float32)
    for g, k in enumerate(GRAMS):
        if len(data) < k:
            continue
        h = np.zeros(len(data) - k + 1, np.uint32)
        gap = np.zeros(len(h), bool)
        for j in range(k):
            part = data[j : len(data) - k + 1 + j]
            with np.errstate(over="ignore"):
                h = (h ^ part) * np.uint32(0x01000193) + np.uint32(j + 1)
            if j:
                gap |= (part == 32) & (data[j - 1 : len(data) - k + j] == 32)
        with np.errstate(over="ignore"):
            h = (h * np.uint32(0x9E3779B1)) >> np.uint32(32 - BITS)
        whole = (row[: len(h)] == row[k - 1 :]) & ~gap
        size = 1 << BITS
        out[:, g * size : (g + 1) * size] = np.bincount(row[: len(h)][whole] * size + h[whole], minlength=n * size).reshape(n, size)
    np.sqrt(out, out)
    return out / np.maximum(np.sqrt((out**2).sum(1, keepdims=True)), 1e-9)


def _counted(data: np.ndarray, offsets: np.ndarray, at: int, rows: int = 256) -> np.ndarray:
    """gram_counts() of some rows of a chunk."""
    cut = offsets[at : at + rows + 1]
    return gram_counts(data[cut[0] : cut[-1]], cut - cut[0])


def codebook(n: int) -> np.ndarray:
    """n codewords of -1 and 1, of 3 log2 n + 4 bits at least: the best of many seeded draws by least distance."""
    bits = 3 * max(1, int(np.ceil(np.log2(max(n, 2))))) + 4
    rng, best = np.random.default_rng(11), (-1, None)
    for _ in range(400 if n <= 200 else 20):
        code = rng.choice(np.array([-1, 1]), (n, bits))
        flat = np.abs(code.sum(0)) == n
        code[0, flat] *= -1  # each bit must tell some languages apart
        d = (bits - code @ code.T) // 2 + np.eye(n, dtype=int) * bits
        if d.min() > best[0]:
            best = (int(d.min()), code)
    return best[1]


class Coder:
    def __init__(self, languages: list[str], code: np.ndarray, w: np.ndarray, bias: np.ndarray, trust: np.ndarray):
        self.languages, self.code, self.w, self.bias, self.trust = languages, code, w, bias, trust

    def decode(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Number of the language, score from 0 to 1, ambiguous."""
        m = x @ self.w + self.bias
        loss = np.stack([(self.trust * np.logaddexp(0, -m * c)).sum(1) for c in self.code], 1)
        e = np.exp(loss.min(1, keepdims=True) - loss)
        p = e / e.sum(1, keepdims=True)
        top = p.max(1)
        second = np.partition(p, -2, axis=1)[:, -2] if p.shape[1] > 1 else np.zeros(len(p))
        return loss.argmin(1), top, top - second < MARGIN


def fit(x: np.ndarray, y: np.ndarray, languages: list[str]) -> Coder:
    """Logistic regression for each bit by full-batch Nesterov steps; every fifth row only weighs the bits."""
    code = codebook(len(languages))
    target = code[y]
    check = np.arange(len(y)) % 5 == 4
    a, t = x[~check], target[~check]
    share = np.bincount(y[~check], minlength=len(languages))
    weight = (1 / np.maximum(share, 1))[y[~check]][:, None]
    weight = weight / weight.sum()
    w, bias = np.zeros((x.shape[1], code.shape[1]), np.float32), np.zeros(code.shape[1], np.float32)
    vw, vb, step = np.zeros_like(w), np.zeros_like(bias), 8.0
    for i in range(200):
        m = a @ (w + 0.9 * vw) + bias + 0.9 * vb
        g = (-t / (1 + np.exp(np.clip(m * t, -30, 30))) * weight).astype(np.float32)
        vw = 0.9 * vw - step * (a.T @ g + 1e-5 * w)
        vb = 0.9 * vb - step * g.sum(0)
        w, bias = w + vw, bias + vb
    rows = check if check.any() else ~check
    right = ((x[rows] @ w + bias) * target[rows] > 0).mean(0)
    return Coder(languages, code, w, bias, np.clip(2 * right - 1, 0.05, 1))


def train(docs: DataFrame, per_language: int = PER_LANGUAGE) -> Coder | None:
    """docs: doc_id, text, lang. None if no row has a language and text."""
    known = docs.select("doc_id", "text", "lang").where("lang is not null")
    languages = max(1, known.select("lang").distinct().count())
    sample = labelled_sample(known.select("doc_id", "lang"), "lang", max(1, min(per_language, SAMPLE // languages)), SEED)
    dims = len(GRAMS) << BITS

    @F.arrow_udf("binary")
    def grams(texts: pa.Array) -> pa.Array:
        return pa.array([r.tobytes() for _, n, data, offsets in chunks(texts) for at in range(0, n, 256) for r in _counted(data, offsets, at).astype(np.float16)], pa.binary())

    got = known.join(F.broadcast(sample), (F.col("doc_id") == F.col("id")) & (F.col("lang") == F.col("y"))).select("id", "y", grams("text").alias("g")).toArrow()
    if not got.num_rows:
        return None
    order = np.lexsort((got["y"].to_numpy(zero_copy_only=False).astype(str), got["id"].to_numpy()))
    languages = sorted(set(got["y"].to_pylist()))
    y = np.searchsorted(np.array(languages), got["y"].to_numpy(zero_copy_only=False).astype(str))[order]
    x = np.frombuffer(b"".join(got["g"].to_pylist()), np.float16).reshape(-1, dims)[order].astype(np.float32)
    return fit(x, y, languages)


def predicted(docs: DataFrame, model: Coder | None) -> DataFrame:
    """docs with a struct column `language` (`language_` beside one of that name): lang, score, ambiguous."""

    @F.arrow_udf("struct<lang:string,score:double,ambiguous:boolean>")
    def tell(texts: pa.Array) -> pa.Array:
        lang, score, unsure = [], [], []
        for _, n, data, offsets in chunks(texts, 1 << 20):
            for at in range(0, n, 256):
                m = min(256, n - at)
                k, p, a = model.decode(_counted(data, offsets, at)) if model else (np.zeros(m, int), np.zeros(m), np.ones(m, bool))
                lang += [model.languages[i] if model else "und" for i in k]
                score.append(p)
                unsure.append(a)
        flat = lambda v: np.concatenate(v) if v else np.zeros(0)
        return pa.StructArray.from_arrays([pa.array(lang, pa.string()), pa.array(flat(score).astype(float)), pa.array(flat(unsure).astype(bool))], ["lang", "score", "ambiguous"])

    none = F.struct(F.lit("und").alias("lang"), F.lit(0.0).alias("score"), F.lit(True).alias("ambiguous"))
    lettered = F.coalesce(F.col("text").rlike(r"\p{L}"), F.lit(False))
    return docs.withColumn(free_name(docs, "language"), F.when(lettered, tell("text")).otherwise(none))


def op10_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    model = train(docs.where(remainder(F.col("doc_id"), 5) != 0))
    out = predicted(docs, model)
    return out.select("doc_id", (remainder(F.col("doc_id"), 5) == 0).alias("held_out"), F.col("language.lang").alias("lang_pred"), F.col("language.score").alias("score"), F.col("language.ambiguous").alias("ambiguous"))


QUERIES = {"op10_language": op10_language}
#: A fitted model can't be written in SQL; tested by held-out accuracy.
ORACLES: dict[str, str] = {}
