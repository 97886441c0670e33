"""Vector and lexical search and near-duplicates against brute force."""

import math
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from codeweft.functions import exprs as E
from codeweft.operators import dupes, search, vector_index


@pytest.mark.parametrize("block", [20_000, 7])
def test_knn_join_against_brute_force(spark, block):
    rng = np.random.default_rng(3)
    m = rng.normal(size=(40, 5)).astype(np.float32)
    m[7], m[8] = m[3], 0  # a tie, and a zero vector
    rows = [(f"v{i:02}", [float(x) for x in r]) for i, r in enumerate(m)] + [("none", None)]
    v = spark.createDataFrame(rows, "id string, embedding array<float>")
    got = {}
    for r in search.knn_join(v, v, 3, block).orderBy("a", "rank").collect():
        got.setdefault(r.a, []).append((r.b, r.dist))
    unit = m.astype(float) / np.maximum(np.linalg.norm(m.astype(float), axis=1, keepdims=True), 1e-300)
    d = np.round(1 - unit @ unit.T, 6)
    for i in range(40):
        want = sorted((d[i, j], f"v{j:02}") for j in range(40) if j != i)[:3]
        assert [(b, x) for x, b in want] == [(b, pytest.approx(x)) for b, x in got[f"v{i:02}"]]
    assert "none" not in got and all(x == 1 for _, x in got["v08"])
    assert search.knn_join(v.limit(0), v, 3).count() == 0 and search.knn_join(v, v.limit(0), 3).count() == 0


def test_lexical_with_and_without_stored_postings(spark):
    texts = [("a", "Pay the bill, pay!"), ("b", "the Mail goes out"), ("c", None), ("d", ""), ("e", "bill of mail")]
    t = spark.createDataFrame(texts, "id string, text string")
    words = {i: re.findall(r"\w+", (x or "").lower()) for i, x in texts}
    terms = ["pay", "mail", "bill"]
    df = {w: sum(w in x for x in words.values()) for w in terms}
    want = sorted(((-round(sum(x.count(w) * math.log(1 + 5 / df[w]) for w in terms), 6), i) for i, x in words.items() if set(x) & set(terms)))
    stored = search.postings(t).withColumn("bucket", search.bucket_of(F.col("term")))
    for s in (None, stored, stored.drop("bucket")):
        assert [(-r.score, r.id) for r in search.lexical(t, "pay MAIL a bill pay", 10, s).collect()] == want
    assert search.lexical(t, "a b", 10, stored).count() == 0


def test_literal_pairs_against_brute_force(spark):
    rng = np.random.default_rng(4)
    texts = [(i, " ".join(f"w{x}" for x in rng.integers(0, 6, rng.integers(0, 30)))) for i in range(60)]
    texts += [(100 + i, "the same common words here " + " ".join(f"u{i}_{j}" for j in range(k))) for i, k in enumerate([0, 1, 2, 3, 40, 41])] + [(200, None), (201, ""), (202, "a b"), (203, "a b")]
    sets = {i: set(zip(*[t[j:] for j in range(4)])) or ({tuple(t)} if t else set()) for i, x in texts for t in [(x or "").split()]}
    want = {(a, b): round(len(x & y) / len(x | y), 6) for a, x in sets.items() for b, y in sets.items() if a < b and x and y and len(x & y) / len(x | y) >= 0.45}
    got = {(r.a, r.b): r.jaccard for r in dupes.literal_pairs(spark.createDataFrame(texts, "id long, text string")).collect()}
    assert got == want and (202, 203) in got
    assert dupes.literal_pairs(spark.createDataFrame([], "id long, text string")).count() == 0


def test_literal_pairs_in_little_room(spark):
    rng = np.random.default_rng(8)
    texts = [(i, " ".join(f"w{x}" for x in rng.integers(0, 5000, 300))) for i in range(1500)]
    texts += [(2000 + i, t + " and more") for i, t in texts[:50]] + [(3000 + i, t) for i, t in texts[:50]]
    t = spark.createDataFrame(texts, "id long, text string").repartition(4).localCheckpoint()
    files = spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager()
    room = lambda: {(f := x.next()).getName(): f.length() for x in [files.getAllFiles().iterator()] for _ in iter(x.hasNext, False)}
    before = room()
    got = dupes.literal_pairs(t).select("a", "b").collect()
    assert {(r.a, r.b) for r in got} == {p for i in range(50) for p in ((i, 2000 + i), (i, 3000 + i), (2000 + i, 3000 + i))} and len(got) == 150
    assert sum(n for f, n in room().items() if f not in before) < 3 * sum(len(x) for _, x in texts)


def test_similar_and_members(spark):
    body = " ".join(f"t{i}" for i in range(30))
    rows = [("a", "PayBill", "x/A.cs", "L1", body), ("b", "SendBill", "y/B.cs", "L9", body + " more"), ("c", "Other", "y/C.cs", "L3", "nothing alike at all here"), ("d", "Same", "x/A.cs", "L2", body), ("e", "PayBillHandler", "z/E.cs", "L1", body)]
    nodes = spark.createDataFrame([(i, label, "code", f, at, t) for i, label, f, at, t in rows], "id string, label string, file_type string, source_file string, source_location string, text string")
    edges = spark.createDataFrame([("a", "x", "calls"), ("b", "x", "calls"), ("c", "x", "calls")], "src string, dst string, relation string")
    vectors = spark.createDataFrame([("a", [1.0, 0.0]), ("b", [1.0, 0.1]), ("c", [1.0, 0.05]), ("d", [1.0, 0.0]), ("e", [1.0, 0.0])], "id string, embedding array<float>")
    near = dupes.similar(nodes, edges, vectors, "a")
    assert [(r.id, r.jaccard > 0.9) for r in near.collect()] == [("c", False), ("b", True)]  # same file and family are out
    by_length = lambda a, b: F.length(b)
    assert [r.id for r in dupes.similar(nodes, edges, vectors, "a", reranker=by_length).collect()] == ["b", "c"]
    assert dupes.similar(nodes, edges, vectors, "zz").count() == 0
    found = spark.createDataFrame([("a", "b"), ("b", "c")], "a string, b string")
    assert [(r.place, r.id) for r in dupes.members(nodes, found).orderBy("place").collect()] == [(1, "a"), (2, "b"), (3, "c")]  # by file and location


def test_white_space_and_families(spark):
    x = spark.createDataFrame([(" \t .Foo()  ", " \t\n", "PayCommand", "PayCommandHandler")], "a string, b string, c string, d string")
    row = x.select(E.norm(F.col("a")), E.is_generic(F.col("b")), E.is_family_pair(F.col("c"), F.col("d")), E.is_family_pair(F.col("c"), F.col("c")), E.is_family_pair(F.col("d"), F.lit("Command")), E.text_jaccard(F.lit("a b c d"), F.lit("a b c d e"))).first()
    assert tuple(row) == ("foo", True, True, False, False, 0.5)


def test_vector_index(spark, tmp_path):
    rng = np.random.default_rng(9)
    middle = rng.normal(size=(30, 8))
    m = (middle[rng.integers(0, 30, 900)] + 0.25 * rng.normal(size=(900, 8))).astype(np.float32)
    v = spark.createDataFrame([(f"v{i}", [float(x) for x in r]) for i, r in enumerate(m)] + [("none", None), ("zero", [0.0] * 8)], "id string, embedding array<float>")
    vector_index.build(v, str(tmp_path / "index"), sample=400)
    index = vector_index.load(spark, str(tmp_path / "index"))
    assert index[0].count() == 901 and len(index[1]) == 30
    asked = v.where("try_cast(substring(id, 2) as int) % 50 = 0")
    exact = search.knn_join(asked, v, 10).cache()
    probes = vector_index.tuned_probes(v, index)
    found = vector_index.index_join(asked, index, 10, probes).cache()
    assert probes < 30 and vector_index.recall(found, exact) >= 0.9
    split = vector_index.index_join(asked, index, 10, probes, block=7)
    assert sorted(map(tuple, split.collect())) == sorted(map(tuple, found.collect()))
    whole = vector_index.index_join(asked, index, 10, 30)
    assert sorted(map(tuple, whole.collect())) == sorted(map(tuple, exact.collect()))

    assert "PartitionFilters: [isnotnull(list" in index[0].where("list = 3")._jdf.queryExecution().toString()
    vector_index.build(v.limit(0), str(tmp_path / "empty"))
