"""Routes on small graphs, and the texts around declarations."""

import pytest
from pyspark.sql import functions as F

from codeweft.functions import exprs as E
from codeweft.operators import routes

NODES = [
    ("ctl", "Controller", "code", "Api/Controller.cs", "L1"), ("cmd", "PayCommand", "code", "App/PayCommand.cs", "L1"), ("han", "PayCommandHandler", "code", "App/PayCommandHandler.cs", "L1"),
    ("svc", "PayService", "code", "App/PayService.cs", "L1"), ("isvc", "IPayService", "code", "App/Interfaces/IPayService.cs", "L1"), ("file", "PayService.cs", "code", "App/PayService.cs", "L1"),
    ("db", "Ledger", "code", "Infra/Ledger.cs", "L1"), ("db2", "Ledger", "code", "", ""), ("out", "Mailer", "code", "Infra/Mailer.cs", "L1"), ("hub", "string", "code", "x.cs", "L1"), ("far", "Faraway", "code", "y.cs", "L1"),
]
EDGES = [("ctl", "cmd", "calls"), ("han", "isvc", "calls"), ("file", "out", "imports"), ("svc", "db2", "references"), ("db", "out", "calls"), ("ctl", "hub", "references"), ("far", "hub", "references")]


@pytest.fixture(scope="module")
def g(spark):
    nodes = spark.createDataFrame(NODES, "id string, label string, file_type string, source_file string, source_location string").cache()
    edges = spark.createDataFrame(EDGES, "src string, dst string, relation string").cache()
    rows = {r.id: r for r in nodes.collect()}
    return nodes, edges, rows


def told(df):
    row = df.first()
    return row and (row.labels, [(s.relation, s.bridge, s.composed) for s in row.steps], row.reversed)


def test_direct_and_back(g):
    n, e, r = g
    assert told(routes.bridged(n, e, r["ctl"], r["cmd"])) == (["Controller", "PayCommand"], [("calls", False, False)], False)
    assert told(routes.bridged(n, e, r["cmd"], r["ctl"])) == (["PayCommand", "Controller"], [("calls", False, False)], True)


def test_partner_by_name(g):
    n, e, r = g
    assert told(routes.bridged(n, e, r["cmd"], r["han"])) == (["PayCommand", "PayCommandHandler"], [("handled_by", True, False)], False)


def test_one_end_bridged(g):
    n, e, r = g
    assert told(routes.bridged(n, e, r["han"], r["svc"])) == (["PayCommandHandler", "IPayService", "PayService"], [("calls", False, False), ("impl_of", True, False)], False)
    assert told(routes.bridged(n, e, r["svc"], r["out"])) == (["PayService", "PayService.cs", "Mailer"], [("in_file", True, False), ("imports", False, False)], False)


def test_instances_of_a_name(g):
    n, e, r = g
    assert told(routes.bridged(n, e, r["svc"], r["db"])) == (["PayService", "Ledger"], [("references", False, False)], False)


def test_composed_route(g):
    n, e, r = g
    assert routes.bridged(n, e, r["ctl"], r["svc"]).isEmpty()
    labels, steps, back = told(routes.find_route(n, e, r["ctl"], r["svc"]))
    assert labels == ["Controller", "PayCommand", "PayCommandHandler", "IPayService", "PayService"] and all(s[2] for s in steps) and not back
    assert [s[:2] for s in steps] == [("calls", False), ("handled_by", True), ("calls", False), ("impl_of", True)]
    assert routes.composed(n, e, r["ctl"], r["far"]).isEmpty()  # only over a generic name
    assert routes.composed(n, e, r["ctl"], r["svc"], label_cap=1).isEmpty()
    assert routes.composed(n, e, r["db"], r["db2"]).isEmpty()


def test_related(g):
    n, e, r = g
    assert {(x.relation, x.direction, x.id) for x in routes.related(n, e, "cmd").collect()} == {("handled_by", None, "han"), ("calls", "in", "ctl")}


SOURCE = "import x\n/// <summary>\n/// Pays a bill.\n/// </summary>\n[Attr]\n\nvoid Pay() {\n  a;\n}\n"
SCREEN = 'function View() {\n return <div className="px-2 mt-1" title="Pay now"><b>Total sum</b> {t("menu:pay")} "Save it all" "save IT all" </div>\n}'


def test_texts(spark):
    x = spark.createDataFrame([(SOURCE, SCREEN)], "s string, u string").select(E.split_lines(F.col("s")).alias("s"), E.split_lines(F.col("u")).alias("u"))
    at = lambda n: F.lit(f"L{n}")
    row = x.select(
        F.size("s").alias("n"), E.leading_comment(F.col("s"), at(7)).alias("c"), E.leading_comment(F.col("s"), at(2)).alias("none"), E.leading_comment(F.col("s"), at(90)).alias("past"),
        E.leading_comment(F.lit(None).cast("array<string>"), at(1)).alias("lost"), E.snippet(F.col("s"), F.lit("L7-L9")).alias("body"),
        E.ui_text(F.lit("src/View.tsx"), F.col("u"), at(1)).alias("ui"), E.ui_text(F.lit("src/View.cs"), F.col("u"), at(1)).alias("no_ui"), E.ui_text(F.lit("src/View.tsx"), F.col("u"), F.lit(None).cast("string")).alias("nowhere"),
        E.entity_text(F.lit("Pay"), F.lit("a/B.cs"), at(7), F.col("s"), F.lit("code"), F.lit("Billing")).alias("text"),
    ).first()
    assert row.n == 9 and row.c == "Pays a bill." and row.none == row.past == row.lost == "" and row.body == "void Pay() {\n  a;\n}"
    assert row.ui == "Total sum | Pay now | Save it all" and row.no_ui == row.nowhere == ""
    assert row.text == "Pay | void Pay() {\n  a;\n} | Pays a bill. | a B cs | Billing | code"
