"""Clashing columns, empty tables, nulls, repeated rows and ties for each operator and pipeline stage; results against
brute force and SQL."""

import collections
import re
import zlib

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from codeweft.llm import common, decontaminate, gru, language_id, license_scan, line_dedup, lm_score, mixing, ngram_join, quality, sharding, toxicity

SF = "/root/testdata/sf0.001"
CLASH = ("shard", "slot", "toxicity", "Judged", "language", "scan", "id", "y", "key", "row", "row_key", "copy", "part", "size", "set_id", "class_id", "terms", "words", "gone", "__words", "a.b")
TEXT = "the cat and the dog sat on a mat by the door of that old house near our town and under the MIT license\n"
ROWS = [(1, TEXT * 4, "en", "a"), (1, TEXT * 4, "en", "a"), (2, TEXT * 4, "en", None), (None, "another text that stands alone and has words of its own", None, "b"), (None, None, None, None), (3, None, "de", "b"), (4, "", "de", "a"), (5, "1 2 3", "de", "a"), (6, "der hund und die katze", "de", "b")]


@pytest.fixture(scope="module")
def docs(spark):
    df = spark.createDataFrame(ROWS, "doc_id long, text string, lang string, source string")
    return df.select("*", *[F.concat(F.lit(f"{c} of "), F.coalesce(F.col("doc_id").cast("string"), F.lit("?"))).alias(c) for c in CLASH])


@pytest.fixture(scope="module")
def labels(spark):
    return spark.createDataFrame([(1, 1, 0), (2, 0, 1), (6, None, None), (None, 1, 1), (77, 0, 0)], "doc_id long, quality int, toxic int")


@pytest.fixture(scope="module")
def benchmark(spark):
    return spark.createDataFrame([(1, "der hund und die katze"), (None, "1 2 3"), (2, None), (3, "")], "item_id long, text string")


def kept(df):
    """The clashing columns' values as they came, row by row."""
    names = [f"`{c}`" for c in ("doc_id", *CLASH)]
    return collections.Counter(tuple(r) for r in df.select(*names).collect())


ADDING = {
    "toxicity": (lambda d, x: toxicity.scored(d, x), ["toxicity_"]),
    "judged": (lambda d, x: quality.judged(d, x), ["judged_"]),
    "language": (lambda d, x: language_id.predicted(d, language_id.train(d)), ["language_"]),
    "scan": (lambda d, x: license_scan.scan(d), ["scan_"]),
    "interleave": (lambda d, x: sharding.interleave(d), ["shard_", "slot_"]),
}


@pytest.mark.parametrize("name", ADDING)
def test_added_columns_leave_others_alone(docs, labels, name):
    f, added = ADDING[name]
    out = f(docs, labels)
    assert out.columns == [*docs.columns, *added]
    assert kept(out) == kept(docs)
    empty = f(docs.limit(0), labels.limit(0))
    assert empty.columns == out.columns and empty.count() == 0
    plain = docs.select("doc_id", "text", "lang", "source")
    assert f(plain, labels).columns == [*plain.columns, *(c.rstrip("_") for c in added)]


def test_operators_that_drop_or_repeat_rows_keep_columns(docs, benchmark):
    before = kept(docs)
    clean = decontaminate.clean_documents(docs, benchmark)
    assert clean.columns == docs.columns and kept(clean) == kept(docs.where("doc_id is null or doc_id <> 6").where("text is null or text <> '1 2 3'"))
    one = ngram_join.distinct_documents(docs)
    got = kept(one)
    assert one.columns == docs.columns and all(got[k] <= before[k] for k in got)
    assert collections.Counter(k[0] for k in got.elements()) == {1: 1, None: 2, 3: 1, 4: 1, 5: 1, 6: 1}  # 1, 1 and 2 are copies; the other null has no text
    mixed = mixing.mixed_documents(docs)
    assert mixed.columns == docs.columns and set(kept(mixed)) <= set(before)
    lines = line_dedup.dedup_lines(docs)
    assert lines.columns == docs.columns and kept(lines) == before
    for f in (lambda d: decontaminate.clean_documents(d, benchmark.limit(0)), ngram_join.distinct_documents, mixing.mixed_documents, line_dedup.dedup_lines):
        assert f(docs.limit(0)).count() == 0
    assert decontaminate.clean_documents(docs, benchmark.limit(0)).count() == len(ROWS)


def test_slots_find_all_hashes():
    rng = np.random.default_rng(0)
    known = np.unique(rng.integers(0, 1 << 63, 5000, dtype=np.uint64))
    known = np.concatenate([known, np.arange(40, dtype=np.uint64) + (np.uint64(7) << np.uint64(60))])  # all in one slot
    other = rng.integers(0, 1 << 63, 5000, dtype=np.uint64)
    find = common.Slots(known, 12)
    assert (find(known) == np.arange(len(known))).all()
    assert (find(other) == np.array([np.flatnonzero(known == h)[0] if (known == h).any() else -1 for h in other])).all()
    assert (common.Slots(known[:0], 12)(other) == -1).all()


def test_quality_counts_against_brute_force(spark):
    rng = np.random.default_rng(8)
    pieces = ["a", "Bee", "#tag", "x|y", "été", "<b>", "50%", " ", "  ", "\n", "\n\n", "\t", "a b c", "\r\n", "\x0b", "日本"]
    texts = ["".join(pieces[i] for i in rng.integers(0, len(pieces), rng.integers(0, 200))) for _ in range(200)] + [None, "", "\n", "w " * 49, "w%d " * 60 % tuple(range(60))]
    got = [r.judged for r in quality.judged(spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string"), spark.createDataFrame([], "doc_id long, quality int")).orderBy("doc_id").collect()]
    for t, r in zip(texts, got):
        t = t or ""
        w = re.findall(r"[^\x20\x09-\x0D]+", t)
        three = collections.Counter(zip(w, w[1:], w[2:]))
        repeats = {i + j for i, x in enumerate(zip(w, w[1:], w[2:])) if three[x] > 1 for j in range(3)}
        lines = [x for x in t.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
        want = (len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", t)), len(lines) - len(set(lines)), len(repeats))
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == want, t
        assert r.base_failed == (len(w) < 50 or 100 * len(repeats) > 50 * len(w)) and r.kept == (not r.base_failed)


def test_toxicity_score_against_brute_force(spark):
    """The vectorised score of whole texts is the machine's sum over single terms and all pairs."""
    texts = ["bad people are so bad", "good folk", "", None, "BAD, folk! terribleness terribly"]
    train = spark.createDataFrame([(i, f"{'bad' if i % 2 else 'good'} {'people' if i % 3 else 'folk'} number{i}") for i in range(80)], "doc_id long, text string")
    model = toxicity.train(train, spark.createDataFrame([(i, i % 2) for i in range(80)], "doc_id long, toxic int"))
    got = [r[0] for r in spark.createDataFrame([(t,) for t in texts], "t string").coalesce(1).select(toxicity.score_udf(model)("t")).collect()]

    def one(t):
        ids = set()
        data = np.frombuffer((t or "").encode(), np.uint8)
        for h, _ in toxicity.terms(data, np.array([0, len(data)])):
            ids |= {int(i) for i in model.find(h) if i >= 0}
        ids = sorted(ids)
        m = model.bias + sum(model.w[i] for i in ids) + sum(float(model.v[i] @ model.v[j]) for k, i in enumerate(ids) for j in ids[:k])
        return 1 / (1 + np.exp(-m))

    assert np.allclose(got, [one(t) for t in texts], atol=1e-9) and got[0] > 0.5 > got[1]


def test_toxicity_learns_a_neutral_term_beside_another(spark):
    """Toxic is an insult beside a mention; either alone is clean, so the mention's own ratio says nothing."""
    rng = np.random.default_rng(1)
    rows, y = [], []
    for i in range(1200):
        insult, mention = rng.random() < 0.4, rng.random() < 0.5
        rows.append((i, " ".join([f"w{rng.integers(0, 40)}" for _ in range(12)] + ["vermin"] * insult + ["tribe"] * mention)))
        y.append((i, int(insult and mention)))
    d, lab = spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(y, "doc_id long, toxic int")
    got = {r.doc_id: r.toxicity for r in toxicity.scored(d, lab).collect()}
    held = [i for i, _ in rows if zlib.crc32(str(i).encode()) % 4 == 2]
    assert np.mean([(got[i] >= toxicity.THRESHOLD) == bool(y[i][1]) for i in held]) > 0.95


def test_toxicity_held_out(spark):
    rows = [r for r in toxicity.op4_toxicity(spark, "/root/testdata/sf0.01").collect() if r.held_out]
    y = {r.doc_id: r.toxic for r in common.table(spark, "/root/testdata/sf0.01", "labels").collect()}
    pos, neg = ([r.predicted for r in rows if y.get(r.doc_id) == k] for k in (1, 0))
    assert len(pos) > 10 and np.mean(pos) > 0.5 and np.mean(neg) < 0.02


def test_language_decoding_against_brute_force():
    rng = np.random.default_rng(2)
    names, x = [f"l{i}" for i in range(5)], rng.normal(size=(200, 30)).astype(np.float32)
    y = rng.integers(0, 5, 200)
    x[np.arange(200), y] += 4
    model = language_id.fit(x, y, names)
    lang, score, unsure = model.decode(x)
    for i in range(200):
        margin = [float(x[i] @ model.w[:, b] + model.bias[b]) for b in range(model.code.shape[1])]
        loss = np.array([sum(t * np.log1p(np.exp(-m * c)) for t, m, c in zip(model.trust, margin, word)) for word in model.code])
        p = np.exp(loss.min() - loss) / np.exp(loss.min() - loss).sum()
        assert lang[i] == loss.argmin() and abs(score[i] - p.max()) < 1e-5 and unsure[i] == (np.sort(p)[-1] - np.sort(p)[-2] < language_id.MARGIN)
    assert (lang == y).mean() > 0.95


def test_language_sample_is_bounded(spark, monkeypatch):
    monkeypatch.setattr(language_id, "SAMPLE", 12)
    seen, fit = [], language_id.fit
    monkeypatch.setattr(language_id, "fit", lambda x, y, names: seen.append(len(x)) or fit(x, y, names))
    language_id.train(spark.createDataFrame([(i, "abc def", f"l{i % 6}") for i in range(60)], "doc_id long, text string, lang string"))
    assert seen == [12]


def test_lm_scores_do_not_depend_on_the_layout(spark):
    rng = np.random.default_rng(3)
    rows = [(i, " ".join(f"w{int(x)}" for x in rng.zipf(1.4, rng.integers(0, 300)) % 900), i % 5 == 1) for i in range(120)] + [(3, None, False), (None, "w1 w2", True)]
    df = spark.createDataFrame(rows, "doc_id long, text string, held_out boolean")
    one, many = ({(r.doc_id, r.n_tokens): r.score for r in lm_score.score_documents(x).collect()} for x in (df.coalesce(1), df.repartition(6)))
    assert one.keys() == many.keys() and all(abs(one[k] - many[k]) <= 1e-5 * abs(one[k]) for k in one)


def rows_of(df, names):
    return sorted(map(str, zip(*[df[c] for c in names])))


def test_pipeline_stage_by_stage(spark, tmp_path):
    """Each stage's rows against SQL over the rows that it was given; toxicity against the model's own verdicts."""
    import corpus_pipeline

    con = duckdb.connect()
    con.sql(f"CREATE VIEW benchmark AS SELECT * FROM '{SF}/benchmark.parquet'")
    docs = common.table(spark, SF, "documents")
    tables = [docs.toPandas()]
    for i, (_, stage) in enumerate(corpus_pipeline.STAGES):
        stage(spark, docs, SF).write.parquet(str(tmp_path / str(i)))
        docs = spark.read.parquet(str(tmp_path / str(i)))
        tables.append(docs.toPandas())
        assert i == 4 or docs.columns == common.table(spark, SF, "documents").columns

    def sql(given, name, module):
        con.register("documents", given)
        return con.sql(module.ORACLES[name]).df()

    start, clean, single, checked, mixed, sharded = tables
    bad = {r.doc_id for r in toxicity.op4_toxicity(spark, SF).collect() if r.predicted}
    assert bad and set(clean.doc_id) == set(start.doc_id) - bad
    near = sql(clean, "op7_ngram_join", ngram_join)
    assert sorted(single.doc_id) == sorted(near.doc_id[near.doc_id == near.class_id]) and len(single) < len(clean)
    found = sql(single, "op5_decontaminate", decontaminate)
    assert sorted(checked.doc_id) == sorted(found.doc_id[~found.contaminated])
    plan = sql(checked, "op1_mixing", mixing)
    size = mixed.text.fillna("").map(lambda t: len(re.findall(r"[^\x20\x09-\x0D]+", t))).groupby(mixed.doc_id).sum()
    assert size.to_dict() == plan[plan.taken > 0].set_index("doc_id").taken.to_dict()
    whole = dict(zip(checked.doc_id, checked.text))
    assert all(t in whole[d] for d, t in zip(mixed.doc_id, mixed.text))
    placed = sql(mixed, "op8_sharding", sharding)
    sharded["text_crc32"] = sharded.text.fillna("").map(lambda t: zlib.crc32(t.encode()))
    names = ["doc_id", "text_crc32", "shard", "slot"]
    assert rows_of(sharded, names) == rows_of(placed, names)


def test_pipeline_stages_on_edge_cases(spark, docs, labels, benchmark, tmp_path):
    import corpus_pipeline

    labels.write.parquet(str(tmp_path / "labels.parquet"))
    benchmark.write.parquet(str(tmp_path / "benchmark.parquet"))
    for d in (docs, docs.limit(0)):
        for name, stage in corpus_pipeline.STAGES:
            out = stage(spark, d, str(tmp_path))
            assert out.columns[: len(docs.columns)] == docs.columns and set(kept(out)) <= set(kept(d)), name
    d.write.parquet(str(tmp_path / "documents.parquet"))
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0


def test_files_on_the_way_go(spark):
    from pathlib import Path

    folder = Path(common.shared_dir(spark))
    count = lambda: {p.name for p in folder.iterdir()}
    common.materialise(spark.range(3), "before")
    before = count()
    with common.intermediate(spark) as keep:
        common.materialise(spark.range(3), "way")
        out = keep(common.materialise(spark.range(5), "result"))
    assert len(count() - before) == 1 and out.count() == 5
    common.discard(out)
    common.discard(spark.range(1))
    assert count() == before


def test_class_cuts_cost_little_and_hold_all_words():
    counts = np.sort(np.random.default_rng(0).zipf(1.3, 3000))[::-1].clip(max=100_000).astype(float)
    total = counts.sum() * 1.5
    cuts = gru.class_cuts(counts, total)
    size = np.diff(cuts)
    cost = len(size) + sum(s * counts[a:b].sum() / total for s, a, b in zip(size, cuts, cuts[1:]))
    assert cuts[0] == 0 and cuts[-1] == 3000 and (size > 0).all() and cost < 2 * 3000**0.5
    assert gru.class_cuts(counts[:0], 0).tolist() == [0]


def test_gru_probabilities_sum_to_one_and_gradients_are_right():
    rng = np.random.default_rng(5)
    m = gru.Gru(np.array([0, 1, 3, 7]), 3, counts=np.arange(9) + 1.0)
    s = rng.normal(size=(1, 3)).astype(np.float32)
    p = [float(np.exp(m._output(s, np.array([i]), None)[0][0])) for i in range(9)]
    assert abs(sum(p) - 1) < 1e-5
    assert np.allclose(p, [float(np.exp(m._output(s, np.array([i]), None, (1e9, np.full(3, 1e9)))[0][0])) for i in range(9)], atol=1e-6)
    ids = np.array([0, 2, 5, 7, 8, 6])
    s = rng.normal(size=(6, 3)).astype(np.float32)
    grads = {k: np.zeros_like(v) for k, v in m.params.items()}
    _, ds = m._output(s, ids, grads)
    loss = lambda: -m._output(s, ids, None)[0].sum()
    for name, at in (("Wc", (1, 2)), ("bc", (4,)), ("Wk", (5, 1)), ("bk", (2,))):
        v = m.params[name]
        old, v[at] = v[at], v[at] + 1e-2
        up = loss()
        v[at] = old - 1e-2
        down, v[at] = loss(), old
        assert abs((up - down) / 2e-2 - grads[name][at]) < 2e-3, name
    old, s[2, 1] = s[2, 1], s[2, 1] + 1e-2
    up = loss()
    s[2, 1] = old - 1e-2
    assert abs((up - loss()) / 2e-2 - ds[2, 1]) < 2e-3
