"""LM scoring: corpus unigrams and a gated recurrent model with a class-factored softmax (see gru.py).

Training words are counted exactly: each task adds up its own, then their hashes meet. One pass turns each text into
numbers of the FREQUENT most frequent words and hashes of the rest, written to the shared folder; everything later
reads that. Rare words meet their counts in a join on their hashes; no vocabulary is ever broadcast beyond FREQUENT
words.

The recurrent model knows the most frequent words, as many as the square root of the training tokens (a corpus' words
grow about so; MODEL_WORDS at least, FREQUENT at most), the end, and one class of all other words; a word of that class
gets the model's probability of the class times the word's smoothed share of it by the corpus counts, so that scores
stay probabilities of whole texts.

Training takes every training text once, in ROUNDS shares by a hash of the row. In a round the share is dealt by that
hash to units of about UNIT tokens (more for a large model, see unit_tokens()). Each unit is trained from the round's
start, its texts in order of the hash, and the units' parameters are averaged by tokens, FAN at a time. So neither the
files' layout nor the number of tasks has a say in the model.

Defined results: null text is empty: its end is its only token. Without training texts every count is 0. Repeated rows
count each time, and equal texts score alike (to rounding, which the texts beside it and the order of sums move).
Words of equal count are numbered by hash. A text of any length is scored whole, with the state carried to its end.
Other columns don't matter.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from codeweft.llm.common import Slots, chunks, discard, fold, materialise, prefix_sums, remainder, span_hash, spans, table
from codeweft.llm.gru import Gru, class_cuts

FREQUENT, SLOTS = 65_000, 21
MODEL_WORDS, HIDDEN = 512, 16
ROUNDS, FAN, UNIT, PARTITIONS = 2, 16, 1 << 20, 10_000
RARE = 65_535
#: Words that a task holds while it counts.
HELD = 1 << 20
#: Tokens of a training lane: with windows of 16, a lane's length over 16 updates whatever the unit's size.
LANE = 2048
#: Tokens scored at a time; a longer text comes alone.
PART = 4 << 20


def unit_tokens(model: Gru) -> int:
    """Two bytes a token and four a parameter: what units write is then half of what they read at most."""
    return max(UNIT, 4 * len(model.flat()))


def _word_hashes(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    data = fold(data)
    starts, ends, first = spans(data, offsets)
    return span_hash(prefix_sums(data), starts, ends), first


def _word_counts(docs: DataFrame) -> DataFrame:
    """h, c: how often training texts have each word."""

    def count(batches):
        words, counts = np.zeros(0, np.uint64), np.zeros(0, np.int64)
        flush = lambda: pa.RecordBatch.from_arrays([pa.array(words.view(np.int64)), pa.array(counts)], ["h", "c"])
        for b in batches:
            for _, _, data, offsets in chunks(b.column(0), 8 << 20):
                h, c = np.unique(_word_hashes(data, offsets)[0], return_counts=True)
                words, inverse = np.unique(np.concatenate([words, h]), return_inverse=True)
                counts = np.bincount(inverse, np.concatenate([counts, c]), minlength=len(words)).astype(np.int64)
                if len(words) > HELD:
                    yield flush()
                    words, counts = words[:0], counts[:0]
        yield flush()

    return docs.where("not held_out").select("text").mapInArrow(count, "h long, c long").groupBy("h").agg(F.sum("c").alias("c"))


def _encode(docs: DataFrame, lookup: Slots) -> DataFrame:
    """row_id, key, doc_id, held_out, n_tokens, ids (two bytes a word), rare (hashes). row_id tells rows apart; key is a
    hash of the row."""

    def encode(batches):
        task, done = TaskContext.get().partitionId(), 0
        for b in batches:
            for at, n, data, offsets in chunks(b.column(3)):
                h, first = _word_hashes(data, offsets)
                ids = lookup(h)
                rare = ids < 0
                ids = np.where(rare, RARE, ids).astype(np.uint16)
                begin = np.r_[0, np.cumsum(rare)][first]
                raw = pa.LargeBinaryArray.from_buffers(pa.large_binary(), n, [None, pa.py_buffer((first * 2).astype(np.int64).tobytes()), pa.py_buffer(ids.tobytes())])
                lists = pa.ListArray.from_arrays(pa.array(begin, pa.int32()), pa.array(h[rare].view(np.int64)))
                row = np.arange(n, dtype=np.int64) + done + (task << 33)
                done += n
                kept = [b.column(i).slice(at, n) for i in range(3)]
                yield pa.RecordBatch.from_arrays([pa.array(row), *kept, pa.array(np.diff(first) + 1, pa.int64()), raw.cast(pa.binary()), lists], ["row_id", "key", "doc_id", "held_out", "n_tokens", "ids", "rare"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    key = F.xxhash64(F.col("doc_id").cast("string"), "text")
    return docs.select(key.alias("key"), "doc_id", "held_out", "text").mapInArrow(encode, f"row_id long, key long, doc_id {kind}, held_out boolean, n_tokens long, ids binary, rare array<long>")


def _model_ids(ids: np.ndarray, n_words: int) -> np.ndarray:
    return np.where(ids < n_words, ids, n_words + 1).astype(np.int32)


def _rare_sums(encoded: DataFrame, words: DataFrame) -> DataFrame:
    """For each text: sum of log10(count + 0.5) of its rare words, and how many of them training texts have. Texts
    without rare words are left out. A join that Spark can split, if a word's hash is hot."""
    met = encoded.select("row_id", F.explode("rare").alias("h")).join(words, "h", "left")
    return met.groupBy("row_id").agg(F.sum(F.log10(F.coalesce("c", F.lit(0)) + F.lit(0.5))).alias("rare_log"), F.count("c").alias("rare_known"))


def _learner(flat: np.ndarray, cuts: np.ndarray, hidden: int):
    def learn(t):
        m = Gru(cuts, hidden, {}).with_flat(flat)
        t = t.sort_by([("key", "ascending"), ("ids", "ascending")])
        done, texts, held = 0, [], 0
        for ids in t["ids"]:
            texts.append(_model_ids(np.frombuffer(ids.as_buffer(), np.uint16), m.n_words))
            held += len(texts[-1])
            if held > 1 << 20:
                done, texts, held = done + m.train(texts, max(8, held // LANE), 16), [], 0
        done += m.train(texts, max(8, held // LANE), 16)
        return pa.table({"unit": [t["unit"][0].as_py()], "n": [float(done)], "flat": pa.array([m.flat().tobytes()], pa.binary())})

    return learn


def _averaged(t):
    t = t.sort_by("unit")
    n, total = 0.0, 0.0
    for k, v in zip(t["n"].to_pylist(), t["flat"]):
        total, n = total + np.frombuffer(v.as_buffer(), np.float32).astype(np.float64) * k, n + k
    return pa.table({"unit": [t["unit"][0].as_py() // FAN], "n": [n], "flat": pa.array([(total / n).astype(np.float32).tobytes()], pa.binary())})


def _train(encoded: DataFrame, model: Gru, tokens: int) -> Gru:
    """Rounds of local training and averaging, over disjoint shares that make up all training texts."""
    units = max(1, -(-tokens // (ROUNDS * unit_tokens(model))))
    rows = encoded.where("not held_out").select("key", "ids", F.pmod("key", F.lit(ROUNDS)).alias("round"), F.pmod(F.shiftright("key", 8), F.lit(units)).cast("long").alias("unit"))
    kind = "unit long, n double, flat binary"
    for r in range(ROUNDS):
        mine, left = rows.where(F.col("round") == r).select("unit", "key", "ids"), units
        # a partition for each unit: training takes long for its bytes, so none should be merged
        got = materialise(mine.repartition(min(units, PARTITIONS), "unit").groupBy("unit").applyInArrow(_learner(model.flat(), model.cuts, model.hidden), kind), "lm-params")
        while left > 1:
            new, left = materialise(got.groupBy(F.floor(F.col("unit") / FAN)).applyInArrow(_averaged, kind), "lm-params"), -(-left // FAN)
            discard(got)
            got = new
        one = got.first()
        discard(got)
        if one is not None:
            model = model.with_flat(np.frombuffer(one["flat"], np.float32))
    return model


def _scored(encoded: DataFrame, model: Gru, counts: np.ndarray) -> DataFrame:
    """Of each text: sums over its frequent words, and the model's log10 probability of its word classes."""
    logs = np.r_[np.log10(counts + 0.5), np.zeros(RARE + 1 - len(counts))]
    known = np.r_[counts > 0, np.zeros(RARE + 1 - len(counts), bool)]
    flat, cuts, hidden = model.flat(), model.cuts, model.hidden
    made = ["model_log", "frequent_log", "frequent_known", "other_log", "n_other"]

    def score(batches):
        m = Gru(cuts, hidden, {}).with_flat(flat)
        for b in batches:
            raw = [np.frombuffer(x.as_buffer(), np.uint16) for x in b.column("ids")]
            p = np.zeros(len(raw))
            at = 0
            while at < len(raw):  # about PART tokens at a time
                size = np.cumsum([len(x) for x in raw[at:]])
                to = at + max(1, int(np.searchsorted(size, PART)))
                p[at:to] = m.score([_model_ids(x, m.n_words) for x in raw[at:to]], 512, 32) / np.log(10)
                at = to
            cols = [p, [logs[x].sum() for x in raw], [int(known[x].sum()) for x in raw], [logs[x[x >= m.n_words]].sum() for x in raw], [int((x >= m.n_words).sum()) for x in raw]]
            kinds = [pa.float64(), pa.float64(), pa.int64(), pa.float64(), pa.int64()]
            kept = [b.column(c) for c in ("row_id", "doc_id", "held_out", "n_tokens")]
            yield pa.RecordBatch.from_arrays([*kept, *(pa.array(c, k) for c, k in zip(cols, kinds))], ["row_id", "doc_id", "held_out", "n_tokens", *made])

    kind = encoded.schema["doc_id"].dataType.simpleString()
    return encoded.select("row_id", "doc_id", "held_out", "n_tokens", "ids").mapInArrow(score, f"row_id long, doc_id {kind}, held_out boolean, n_tokens long, model_log double, frequent_log double, frequent_known long, other_log double, n_other long")


def score_documents(docs: DataFrame) -> DataFrame:
    """docs: doc_id, text, held_out. Returns doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score."""
    words = materialise(_word_counts(docs), "lm-words")
    top = words.orderBy(F.desc("c"), "h").limit(FREQUENT).toArrow()
    hashes, counts = top["h"].to_numpy().astype(np.int64).view(np.uint64), top["c"].to_numpy().astype(np.int64)
    encoded = materialise(_encode(docs, Slots(hashes, SLOTS)), "lm-texts")
    rare = _rare_sums(encoded, words)
    totals = encoded.where("not held_out").agg(F.count("*").alias("texts"), F.sum("n_tokens").alias("tokens")).first()
    texts, tokens = totals["texts"] or 0, int(totals["tokens"] or 0)
    distinct = words.count() + (texts > 0)
    n_words = int(min(max(MODEL_WORDS, tokens**0.5), len(hashes)))
    inside = int(counts[:n_words].sum())
    other, other_words = tokens - inside - texts, distinct - n_words - (texts > 0)
    model = Gru(class_cuts(counts[:n_words], tokens), HIDDEN, counts=np.r_[counts[:n_words], texts, other])
    model = _train(encoded, model, tokens)
    rows = _scored(encoded, model, counts).join(rare, "row_id", "left")
    rare_log = F.coalesce("rare_log", F.lit(0.0))
    base = F.col("frequent_log") + rare_log + F.lit(float(np.log10(texts + 0.5))) - F.col("n_tokens") * F.lit(float(np.log10(tokens + 0.5 * (distinct + 1))))
    score = F.col("model_log") + F.col("other_log") + rare_log - F.col("n_other") * F.lit(float(np.log10(other + 0.5 * (other_words + 1))))
    known = F.col("frequent_known") + F.coalesce("rare_known", F.lit(0)) + F.lit(int(texts > 0))
    return rows.select("doc_id", "held_out", "n_tokens", known.cast("long").alias("n_known"), F.lit(tokens).cast("long").alias("train_tokens"), base.alias("base_score"), score.alias("score"))


def op2_lm_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return score_documents(docs.withColumn("held_out", remainder(F.col("doc_id"), 5) == 1))


QUERIES = {"op2_lm_score": op2_lm_score}
#: A trained model can't be written in SQL; the base columns are tested against brute force.
ORACLES: dict[str, str] = {}
