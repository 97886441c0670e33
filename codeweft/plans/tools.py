"""The engine's answers as ten functions of a store, for a command line or an agent. TOOLS lists them by name.

Each returns lines of text; those about a graph begin with how far it lags behind its working tree."""

from __future__ import annotations

from functools import wraps

from pyspark.sql import functions as F

from codeweft.functions import embed as M
from codeweft.operators import dupes as D
from codeweft.operators import graph as G
from codeweft.operators import search as S
from codeweft.plans import report
from codeweft.sources import files
from codeweft.sources.git_state import freshness, freshness_line, freshness_report
from codeweft.sources.store import Store

TOOLS: dict = {}


def _tool(f):
    TOOLS[f.__name__] = f
    return f


def _about_graph(f):
    @wraps(f)
    def told(store: Store, name: str, *args, **options) -> list[str]:
        return [freshness_line(freshness(store.state("meta").get(name)))] + f(store, name, *args, **options)

    return _tool(told)


def _lines_of(store: Store, name: str):
    """The project's source files, where they can be read."""
    root = store.state("registry").get(name)
    return files.source_files(store.spark, root) if root and files.exists(store.spark, root) else None


@_tool
def list_graphs(store: Store) -> list[str]:
    return [f"{r.graph}\t{r.path or '?'}" for r in store.graphs().collect()]


@_tool
def status(store: Store, name: str, root: str | None = None) -> list[str]:
    return freshness_report(name, freshness(store.state("meta").get(name), root)).split("\n")


@_about_graph
def search(store: Store, name: str, question: str, k: int = 8, kind: str = "all", hybrid: bool = False, neighbours: int = 4, snippet: bool = False, embed=None, reranker=None) -> list[str]:
    """Nodes that answer a question, each with its nearest neighbours, on request with source lines."""
    config = store.state("config")
    M.check_model(config, M.MODEL, M.VERSION)
    nodes, edges = store.graph(name)
    q = M.query_vector(store.spark, question, embed or M.choose_embedder(config)[0])
    found = G.cut(S.search(nodes, nodes.select("id", "embedding"), q, question, k, kind=kind, hybrid=hybrid, reranker=reranker, stored=store.postings(name)))
    ids = found.select("id")
    ends = edges.join(ids.select(F.col("id").alias("src")), "src", "left_semi").unionByName(edges.join(ids.select(F.col("id").alias("dst")), "dst", "left_semi")).distinct()
    near: dict[str, list[str]] = {}
    if neighbours:
        for r in G.neighbours(nodes, ends, neighbours).join(ids, "id", "left_semi").orderBy("id", F.desc("direction"), "relation", "label").collect():
            near.setdefault(r.id, []).append(f"{r.relation} {'→' if r.direction == 'out' else '←'} {r.label}")
    source = _lines_of(store, name) if snippet else None
    quoted = {}
    if source is not None:
        quoted = {r.id: r.lines for r in report.snippets(found.select("id").join(nodes, "id"), source).collect()}
    out = [f"[{name}] {question}"]
    for r in found.orderBy(F.desc("score"), "id").collect():
        out += [f"  {r.score:.4f}  {r.label} ({r.file_type}, {r.source_file})", *(f"      {x}" for x in near.get(r.id, [])), *(f"      | {x}" for x in (quoted.get(r.id) or "").split("\n") if x)]
    return out if len(out) > 1 else [*out, "  nothing found"]


@_about_graph
def explain(store: Store, name: str, symbol: str, neighbours: int = 10) -> list[str]:
    return report.explain(name, *store.graph(name), symbol, neighbours, _lines_of(store, name))


@_about_graph
def find_path(store: Store, name: str, source: str, target: str, max_hops: int = 6) -> list[str]:
    return report.trace(name, *store.graph(name), source, target, max_hops)


@_about_graph
def tests(store: Store, name: str, symbol: str, max_hops: int = 2) -> list[str]:
    return report.tests(name, *store.graph(name), symbol, max_hops)


@_about_graph
def impact(store: Store, name: str, symbol: str, max_hops: int = 2) -> list[str]:
    return report.impact(name, *store.graph(name), symbol, max_hops)


@_about_graph
def trace(store: Store, name: str, source: str, target: str = "", max_hops: int = 4, with_references: bool = False) -> list[str]:
    return report.trace(name, *store.graph(name), source, target, max_hops, with_references)


@_about_graph
def similar(store: Store, name: str, symbol: str, k: int = 6, threshold: float = 0.10, kind: str = "all", reranker=None) -> list[str]:
    nodes, edges = store.graph(name)
    r = G.resolve(nodes, edges, symbol).first()
    if r is None:
        return [f"[{name}] no symbol '{symbol}'"]
    return report.similar(name, r.label, D.similar(nodes.drop("embedding"), edges, nodes.select("id", "embedding"), r.id, k, threshold, kind, reranker))


@_about_graph
def dupes(store: Store, name: str, kind: str = "prod", threshold: float = 0.06, topk: int = 4, pairs: bool = False, include_framework: bool = False, limit: int = 20, reranker=None) -> list[str]:
    nodes, edges = store.graph(name)
    found = G.cut(D.pairs(nodes.drop("embedding"), edges, nodes.select("id", "embedding"), kind, threshold, topk, include_framework, reranker))
    if pairs:
        return report.pairs(name, nodes, found, limit)
    groups = G.cut(D.clusters(nodes, found))
    return report.clusters(name, groups, limit, D.members(nodes, found))
