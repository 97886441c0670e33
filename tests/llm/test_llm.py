"""Each operator on small tables: nulls, empty and long texts, ties, repeated rows, empty tables, clashing columns;
and against brute force."""

import collections
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from codeweft.llm import decontaminate, gru, language_id, license_scan, line_dedup, lm_score, mixing, ngram_join, quality, sharding, toxicity
from codeweft.llm.common import table

SF = "/root/testdata/sf0.001"
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, size string, key string"
EN = "the cat and the dog sat on a mat by the door of that old house near our town "
DE = "der hund und die katze sitzen auf einer matte vor dem alten haus in unserer stadt "
ROWS = [
    (1, EN * 6, "en", "a", 0, "x", "k"), (2, DE * 6, "de", "a", 0, "x", "k"), (3, None, "en", None, 0, "x", "k"), (4, "", None, "b", 0, "x", "k"), (None, EN * 3, "en", "b", 0, "x", "k"),
    (5, "one two three", "en", "c", 0, "x", "k"), (6, EN * 6, "en", "b", 0, "x", "k"), (6, EN * 6, "en", "b", 0, "x", "k"), (7, (EN + "zebra %d ") * 2000 % tuple(range(2000)), "en", "a", 0, "x", "k"), (8, "1 2 3 !!", None, "c", 0, "x", "k"),
]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(ROWS, SCHEMA)


@pytest.fixture(scope="module")
def labels(spark):
    return spark.createDataFrame([(1, 1, 0), (2, 1, 1), (5, 0, 0), (6, 1, 0), (7, 0, 1), (99, 1, 1), (None, 1, 1)], "doc_id long, quality int, toxic int")


def words(t, pattern=r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"):
    return re.findall(pattern, "".join(c.lower() if "A" <= c <= "Z" else c for c in t or ""))


def test_sainte_lague_matches_seat_by_seat():
    rng = np.random.default_rng(0)
    for _ in range(30):
        v, caps = rng.integers(0, 50, 6).astype(float), rng.integers(0, 30, 6)
        seats = int(rng.integers(0, 60))
        want = np.zeros(6, int)
        for _ in range(min(seats, int(caps[v > 0].sum()))):
            want[max((i for i in range(6) if want[i] < caps[i] and v[i] > 0), key=lambda i: (v[i] / (2 * want[i] + 1), -i))] += 1
        assert mixing.sainte_lague(v, seats, caps).tolist() == want.tolist()


def test_mixing(docs):
    rows = mixing.mix(docs).collect()
    assert len(rows) == len(ROWS)
    by = collections.defaultdict(lambda: [0, 0.0])
    for r in rows:
        assert r["size"] == len(words(next(x[1] for x in ROWS if x[0] == r.doc_id), r"[^\x20\x09-\x0D]+")) and r.taken <= 2 * r["size"]
        by[r.source] = [by[r.source][0] + r.taken, r.target]
    assert all(abs(k - t) <= max(2, 0.01 * t) for k, t in by.values())
    assert sorted(map(str, rows)) == sorted(map(str, mixing.mix(docs).collect()))
    out = mixing.mixed_documents(docs)
    assert out.columns == docs.columns
    assert sum(len(words(r.text, r"[^\x20\x09-\x0D]+")) for r in out.collect()) == sum(r.taken for r in rows)
    assert mixing.mix(docs.limit(0)).count() == 0


def test_sharding(docs, spark):
    rows = sharding.assign(docs.unionByName(docs).unionByName(docs), 4, range_rows=5).collect()
    n = collections.Counter(r.shard for r in rows)
    assert len(rows) == 30 and max(n.values()) - min(n.values()) <= 1
    for s in n:
        assert sorted(r.slot for r in rows if r.shard == s) == list(range(n[s]))
    assert all(r.text_crc32 == zlib.crc32((next(x[1] for x in ROWS if x[0] == r.doc_id) or "").encode()) for r in rows)
    assert sharding.interleave(docs, 4).columns == [*docs.columns, "shard", "slot"] and sharding.interleave(docs, 4).count() == 10
    assert sharding.assign(docs.limit(0)).count() == 0
    # every shard has the mixture
    many = spark.range(400).select(F.col("id").alias("doc_id"), F.lit("t").alias("text"), F.when(F.col("id") % 4 == 0, "x").otherwise("y").alias("source"))
    got = collections.Counter((r.shard, r.stratum) for r in sharding.assign(many, 8, range_rows=50).collect())
    assert all(abs(got[s, "sx"] - 12.5) <= 1 for s in range(8))


def test_decontaminate(docs, spark):
    bench = spark.createDataFrame([(1, "The CAT"), (2, " ".join(words(EN)[:14])), (3, None), (None, "katze sitzen"), (4, "one two three"), (4, "one two three")], "item_id long, text string")
    rows = {(r.doc_id, r.n_words, r.n_hit, ",".join(r["items"]), r.contaminated) for r in decontaminate.decontaminate(docs, bench, block=3).collect()}
    w = words(EN)
    items = [(str(i), words(t)) for i, t in ((1, "The CAT"), (2, " ".join(w[:14])), (None, "katze sitzen"), (4, "one two three"))]
    want = set()
    for d, t, *_ in ROWS:
        x, hit, who = words(t), set(), set()
        for i, it in items:
            for win in {tuple(it[k : k + 13]) for k in range(max(1, len(it) - 12))}:
                for p in range(len(x) - len(win) + 1):
                    if tuple(x[p : p + len(win)]) == win:
                        hit |= set(range(p, p + len(win)))
                        who |= {i} - {"None"}
        want.add((d, len(x), len(hit), ",".join(sorted(who)), len(hit) > 0 and 20 * len(hit) >= len(x)))
    assert rows == want
    assert decontaminate.clean_documents(docs, bench).columns == docs.columns
    assert not decontaminate.decontaminate(docs, bench.limit(0)).where("n_hit > 0").count()
    assert decontaminate.decontaminate(docs.limit(0), bench).count() == 0


def brute_links(texts, k=5):
    sets = [{tuple(w[i : i + k]) for i in range(len(w) - k + 1)} or ({tuple(w)} if w else set()) for w in map(words, texts)]
    near = lambda a, b: 5 * len(a & b) >= 4 * len(a | b) > 0
    return [sum(near(a, b) for j, b in enumerate(sets) if j != i) for i, a in enumerate(sets)]


def test_ngram_join(docs, spark, monkeypatch):
    monkeypatch.setattr(ngram_join, "MEMBERS", 3)  # several blocks in a group
    base = [f"w{i}" for i in range(120)]
    near = [(100 + j, " ".join(base[:j] + [f"x{j}"] + base[j + 1 :])) for j in range(0, 120, 10)] + [(300, " ".join(base)), (301, " ".join(base).upper()), (302, "a b"), (303, "A, b!")]
    rows = spark.createDataFrame(near, "doc_id long, text string")
    got = {r.doc_id: (r.class_id, r.n_links) for r in ngram_join.near_duplicates(rows).collect()}
    assert [got[d][1] for d, _ in near] == brute_links([t for _, t in near])
    assert {got[d][0] for d, _ in near} == {100, 302}
    all_ = ngram_join.near_duplicates(docs).collect()
    assert len(all_) == 10 and {r.n_links for r in all_ if r.doc_id in (3, 4)} == {0}
    assert sorted(x.doc_id for x in ngram_join.distinct_documents(docs).collect() if x.doc_id in (3, 4, 6)) == [3, 4]
    assert ngram_join.near_duplicates(docs.limit(0)).count() == 0


def test_line_dedup(spark, docs):
    line = lambda c, n: " ".join(f"{c}{i}" for i in range(n))
    a, b, c = line("a", 30), line("b", 30), line("c", 60)
    rows = [(1, f"x\n{a}\n{b}\nq"), (2, f"z\n\n {a}\n{b} \nr"), (3, None), (4, c), (5, f"k\n{c}\n{c}"), (6, f"x\n{a}"), (None, f"q\n{a}\n{b}")]
    got = {r.doc_id: r.text for r in line_dedup.dedup_lines(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == {1: rows[0][1], 2: "z\n\nr", 3: None, 4: c, 5: "k", 6: f"x\n{a}", None: "q"}
    assert line_dedup.dedup_lines(docs).columns == docs.columns
    assert line_dedup.dedup_lines(docs.limit(0)).count() == 0


def test_line_dedup_against_brute_force(spark):
    """Passages whose first part stands alone earlier (A: L1 L2; B, C: L1 L2 L3), and random lines of 1 to 60 words."""
    line = lambda c, n: " ".join(f"{c}{i}" for i in range(n))
    rows = [(10 * k + j, "\n".join(line(f"{x}{k}_", 20) for x in "abc"[: 2 if j == 0 else 3])) for k in range(20) for j in range(3)]
    rng = np.random.default_rng(5)
    pool = [line(f"p{i}_", int(n)) for i, n in enumerate(rng.choice([1, 2, 5, 10, 24, 26, 49, 60], 12))]
    rows += [(1000 + i, "\n".join(pool[j] for j in rng.integers(0, 12, rng.integers(0, 90)))) for i in range(40)]
    want, seen = {}, []
    for d, text in rows:
        mine, gone = text.split("\n"), set()
        n = [x.count(" ") + 1 for x in mine]
        for other in [*seen, mine]:
            for delta in range(1 - len(mine), len(other)) if other is not mine else range(1 - len(mine), 0):
                run = []
                for i in range(max(0, -delta), min(len(mine), len(other) - delta) + 1):
                    if i < min(len(mine), len(other) - delta) and mine[i] == other[i + delta]:
                        run.append(i)
                        continue
                    gone |= set(run) if sum(n[j] for j in run) >= 50 else set()
                    run = []
        seen.append(mine)
        want[d] = "\n".join(x for i, x in enumerate(mine) if i not in gone)
    got = {r.doc_id: r.text for r in line_dedup.dedup_lines(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == want


def test_license_scan(spark, docs):
    texts = ["Released under the MIT\nLicense.", "GNU Lesser General Public License v3", "SPDX-License-Identifier: Apache-2.0", "All rights reserved. mit license", None, "", "no words of it"]
    rows = [r.scan for r in license_scan.scan(spark.createDataFrame([(t,) for t in texts], "text string")).collect()]
    assert [sorted({d.label for d in r.found or []}) for r in rows] == [["mit"], ["lgpl"], ["apache"], ["all-rights-reserved", "mit"], [], [], []]
    assert [[tuple(b) for b in r.base] for r in rows] == [[(3, "mit")], [(2, "gpl")], [], [(3, "mit")], [], [], []]
    assert [r.n_words for r in rows] == [len(words(t)) for t in texts]
    assert len(license_scan.NAMES) * len(license_scan.TEMPLATES) > 300
    assert license_scan.scan(docs).count() == 10


def test_license_gate_and_identifiers(spark):
    cases = {"MIT-0": "mit-0", "MIT-style": "mit", "MIT/X11": "mit", "ASL 2.0": "apache", "BSL-1.0": "boost", "CeCILL-B": "cecill", "CC BY-NC 4.0": "cc-by-nc", "Berkeley Software Distribution License": "bsd"}
    cases |= {f"SPDX-License-Identifier: {x}": x.split("-")[0].lower() for x in ("MIT", "ISC", "Zlib", "Artistic-2.0", "Apache-2.0")}
    cases |= {"SPDX-License-Identifier: MIT-0": "mit-0", "Licensed under MIT": "mit", "Licensed under the ISC": "isc", "a cat with mit and ruby": None}
    rows = [r.scan for r in license_scan.scan(spark.createDataFrame([(t,) for t in cases], "text string")).collect()]
    best = [{d.label for d in r.found or [] if d.priority == min(e.priority for e in r.found)} for r in rows]
    assert best == [{x} if x else set() for x in cases.values()]
    assert [r.found[0].priority for t, r in zip(cases, rows) if t.startswith("SPDX")] == [1] * 6


def test_quality_counts_and_monotone_trees(docs, labels):
    rows = quality.judged(docs, labels).collect()
    for r in rows:
        w = re.findall(r"[^\x20\x09-\x0D]+", r.text or "")
        tri = [tuple(w[i : i + 3]) for i in range(len(w) - 2)]
        n = collections.Counter(tri)
        rep = {i + j for i, t in enumerate(tri) if n[t] > 1 for j in range(3)}
        assert (r.judged.n_words, r.judged.word_chars, r.judged.n_repeat_words) == (len(w), sum(map(len, w)), len(rep))
    assert not any(r.judged.kept for r in rows if r.judged.base_failed)
    rng = np.random.default_rng(1)
    x = rng.random((800, 10)).astype(np.float32)
    y = (x[:, 2] + 0.3 * rng.random(800) > 0.6).astype(float)
    model = quality.fit(x, y, np.ones(800), {2: -1})
    grid = np.tile(x[:50], (20, 1, 1)).reshape(-1, 10)
    grid[:, 2] = np.repeat(np.linspace(0, 1, 20), 50)
    assert (np.diff(model.score(grid).reshape(20, 50), axis=0) <= 1e-9).all()
    free = quality.fit(x, y, np.ones(800), {})
    assert ((free.score(x) > 0.5) == (y > 0.5)).mean() > 0.9
    assert quality.train(docs, labels.limit(0)) is None


def test_factorization_machine_learns_pairs():
    rng = np.random.default_rng(2)
    has = rng.random((3000, 4)) < 0.5
    y = (has[:, 0] & has[:, 1]).astype(float)
    rows, ids = np.nonzero(has)
    m = toxicity.Machine(np.arange(4, dtype=np.uint64) << np.uint64(60), *toxicity.fit(rows, ids, y, np.ones(3000), 4))
    assert ((m.score(rows, ids, 3000) > 0.5) == (y > 0.5)).mean() > 0.97


def test_toxicity_small(docs, labels):
    out = toxicity.scored(docs, labels)
    assert out.columns == [*docs.columns, "toxicity"]
    assert all(0 <= r.toxicity <= 1 for r in out.collect())
    assert max(r.toxicity for r in toxicity.scored(docs, labels.limit(0)).collect()) < 1e-9


def test_gru_gradient_and_carried_state():
    m = gru.Gru(np.array([0, 1, 3, 6]), 4, counts=np.arange(8) + 1.0)
    rng = np.random.default_rng(3)
    texts = [rng.integers(0, 8, n) for n in (70, 3, 0, 33)]
    texts = [np.where(t == 6, 7, t) for t in texts]
    alone = [m.score([t])[0] for t in texts]
    assert np.allclose(m.score(texts, lanes=3, window=8), alone, atol=1e-3)
    before = sum(alone)
    for _ in range(30):
        m.train([t for t in texts for _ in range(5)], lanes=2, window=10)
    assert m.score(texts).sum() > before + 20


def test_lm_base_scores(docs):
    held = docs.withColumn("held_out", F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit(""))) % 5 == 1)
    rows = lm_score.score_documents(held).collect()
    tokens = lambda t: (t or "").encode().lower().split() + [None]
    c = collections.Counter(w for d, t, *_ in ROWS if zlib.crc32(("" if d is None else str(d)).encode()) % 5 != 1 for w in tokens(t))
    n, v = sum(c.values()), len(c)
    want = sorted((len(tokens(t)), sum(w in c for w in tokens(t)), round(sum(np.log10((c[w] + 0.5) / (n + 0.5 * (v + 1))) for w in tokens(t)), 4)) for _, t, *_ in ROWS)
    assert sorted((r.n_tokens, r.n_known, round(r.base_score, 4)) for r in rows) == want and {r.train_tokens for r in rows} == {n}
    assert lm_score.score_documents(held.limit(0)).count() == 0


@pytest.fixture(scope="module")
def lm_model(spark):
    """The model fitted to 300 texts (2.4 million tokens): of 8000 words, a hundredth of which is the text's own."""
    filler = " ".join(f"f{i}" for i in range(200))
    texts = [(d, f"{filler} own{d} own{d} " * 38 + " ".join(f"w{(53 * d + i) % 3000}" for i in range(200)), False) for d in range(300)]
    seen, real = [], lm_score._scored
    with pytest.MonkeyPatch.context() as m:
        m.setattr(lm_score, "_scored", lambda encoded, model, counts: seen.append(model) or real(encoded, model, counts))
        lm_score.score_documents(spark.createDataFrame(texts, "doc_id long, text string, held_out boolean"))
    return seen[0]


def test_lm_trains_on_every_text(lm_model):
    start = gru.Gru(lm_model.cuts, lm_model.hidden, counts=np.ones(lm_model.n_words + 2)).params["E"]
    moved = (lm_model.params["E"] != start).any(1)
    assert lm_model.n_words > 500 and moved[:500].all()  # the fillers and every text's own word


def test_lm_vocabulary_grows_with_the_tokens(lm_model):
    assert 1400 < lm_model.n_words < 1600  # the root of 2.4 million tokens


def test_language(docs, spark):
    model = language_id.train(docs)
    got = {r.doc_id: r.language for r in language_id.predicted(docs, model).collect()}
    assert got[1].lang == "en" and got[2].lang == "de" and got[3].lang == got[4].lang == got[8].lang == "und"
    assert language_id.train(docs.limit(0)) is None
    code = language_id.codebook(12)
    d = (code.shape[1] - code @ code.T) // 2
    assert (d + 99 * np.eye(12)).min() >= 4


def test_held_out_accuracy(spark):
    langs = {r.doc_id: r.lang for r in table(spark, SF, "documents").collect()}
    rows = [r for r in language_id.op10_language(spark, SF).collect() if r.held_out]
    assert np.mean([r.lang_pred == langs[r.doc_id] for r in rows]) > 0.95
    scores = [r for r in lm_score.op2_lm_score(spark, SF).collect() if r.held_out]
    assert sum(r.score for r in scores) > sum(r.base_score for r in scores)


def test_pipeline(spark):
    import corpus_pipeline

    out = corpus_pipeline.run(spark, SF)
    assert out.count() > 100 and [n for n, _ in corpus_pipeline.STAGES][0] == "toxicity"


def shortest(pattern: str) -> str:
    """A short text that a regex matches."""

    def of(parsed) -> str:
        out = ""
        for op, arg in parsed:
            name = str(op)
            if name == "LITERAL":
                out += chr(arg)
            elif name == "IN":
                out += chr(arg[0][1] if str(arg[0][0]) == "LITERAL" else arg[0][1][0])
            elif name == "MAX_REPEAT":
                out += of(arg[2]) * arg[0]
            elif name == "SUBPATTERN":
                out += of(arg[3])
            elif name == "BRANCH":
                out += of(arg[1][0])
            else:
                raise ValueError(name)
        return out

    return of(re._parser.parse(pattern))


def test_license_rules_pass_their_gate(spark, monkeypatch):
    """Every name, shortest and in full, alone and in each template, with the gate and without."""
    names = [(label, shortest(x)) for label, _, x in license_scan.NAMES for x in (x, x.replace(")?", ")").replace("{0,6}", "{1,6}"))]
    texts = [t for _, t in names] + [f"{shortest(before)} {t}" for _, _, before in license_scan.TEMPLATES[:2] for _, t in names]
    texts += [f"{shortest(before)} {shortest(x)}" for _, _, before in license_scan.IDENTIFIED for _, _, x in license_scan.IDENTIFIERS]
    labels = [x for x, _ in names] * 3 + [x for x, _, _ in license_scan.IDENTIFIERS] * 2
    df = spark.createDataFrame([(i, f"Zebra {t.title()}, zebra.") for i, t in enumerate(texts)], "i int, text string").repartition(8)
    found = lambda: {r.i: r.scan.found or [] for r in license_scan.scan(df).select("i", "scan").collect()}
    gated = found()
    assert [t for i, t in enumerate(texts) if not gated[i]] == []
    # a name that lies within another is suppressed, so not every label stays; one that holds all its words does
    assert np.mean([labels[i] in {d.label for d in gated[i]} for i in range(len(texts))]) > 0.95
    monkeypatch.setattr(license_scan, "GATE", (("",),))
    assert found() == gated
    assert len(license_scan.NAMES) + len(license_scan.IDENTIFIERS) + len(license_scan.TEMPLATES) > 250


def test_license_base_and_suppression_against_brute_force(spark):
    rng = np.random.default_rng(6)
    pool = ["MIT", "license", "Licence", "apache", "general", "public", "gnu", "lesser", "v2", "the", "under", "licensed", "2", "0", "bsd", "3", "clause", "mozilla", "cat"]
    texts = [" ".join(pool[i] for i in rng.integers(0, len(pool), rng.integers(0, 60))) for _ in range(150)] + [None, "", "mit\n\tLICENSE, general-public license"]
    rows = [r.scan for r in license_scan.scan(spark.createDataFrame([(t,) for t in texts], "text string")).collect()]
    for t, r in zip(texts, rows):
        w = words(t)
        base = sorted((i, label) for phrase, label in license_scan.BASE.items() for i in range(len(w)) if w[i : i + phrase.count(" ") + 1] == phrase.split())
        assert r.n_words == len(w) and sorted((b.start, b.label) for b in r.base) == base
        every = set()
        for i, x in enumerate(w):
            left, right = " ".join(w[max(0, i - license_scan.LEFT) : i]), " ".join(w[i : i + license_scan.RIGHT])
            for names, templates in ((license_scan.NAMES, license_scan.TEMPLATES), (license_scan.IDENTIFIERS, license_scan.IDENTIFIED)):
                for label, key, name in names:
                    m = re.match(f"(?:{name})(?= |$)", right) if key == x else None
                    for p, score, before in templates if m else ():
                        b = re.search(f"(?:^| )({before})$", left) if before else None
                        if b or not before:
                            start = i - (len(b[1].split()) if b else 0)
                            every.add((start, i + len(m[0].split()), p, label, score))
        kept = {d for d in every if not any(e[0] <= d[0] and e[1] >= d[1] and (e[2] < d[2] or (e[2] == d[2] and e[1] - e[0] > d[1] - d[0])) for e in every)}
        assert {tuple(d) for d in r.found or []} == kept
