"""Answers as text, evaluation and the share that a reranker keeps."""

import pytest
from pyspark.sql import Row
from pyspark.sql import functions as F

from codeweft.functions import embed as M
from codeweft.operators import dupes
from codeweft.plans import evaluate, report

S = Row("relation", "bridge", "composed")


def test_path_line():
    line = lambda labels, steps: report.path_line("g", Row(labels=labels, steps=steps))
    assert line(["A", "B"], [S("calls", False, False)]) == "[g] A  ─calls→  B"
    assert line(["A", "B"], [S("impl_of", True, False)]) == "[g] A  ⋯impl_of→  B   (⋯ derived: impl_of)"
    assert line(["A", "B"], [S("calls", False, True)]).endswith("(composed: direction is approximate)")


def test_tree():
    R = Row("id", "parent", "relation", "label")
    rows = [R("b", "a", "calls", "B"), R("d", "a", "guessed", "D"), R("c", "b", "method", "C")]
    assert report.tree("a", "A", rows) == ["  A", "    ─ calls → B", "      ─ method → C", "    ⋯ guessed → D (inferred)"]
    assert len(report.tree("a", "A", [R(f"x{i}", "a", "calls", "X") for i in range(99)])) == report.LINES + 1


def test_best_share(spark):
    x = spark.createDataFrame([("a", "b", 1.0), ("a", "c", 3.0), ("a", "d", 2.0), ("a", "e", 2.0)], "a string, b string, s double")
    assert {r.b for r in dupes.best_share(x, F.col("s")).collect()} == {"c", "d", "e"}
    assert dupes.best_share(x.limit(0), F.col("s")).isEmpty()


@pytest.mark.parametrize("asked", [1, 0])
def test_eval(spark, asked):
    embed = M.embedder()
    nodes = spark.createDataFrame([("1", "PayBill", "code", "a/PayBill.cs", "pay a bill"), ("2", "SendMail", "code", "a/SendMail.cs", "send the mail")], "id string, label string, file_type string, source_file string, text string")
    golden = spark.createDataFrame([("send the mail", ["SENDMAIL"])][:asked], "q string, expect array<string>")
    table, missed = evaluate.run_eval(nodes, nodes.select("id", embed("text").alias("embedding")), golden, embed)
    assert missed.isEmpty() and [tuple(r) for r in table.collect()] == [(c[0], 1.0, 1.0, 1.0, 0) for c in evaluate.CONFIGS][: 4 * asked]
