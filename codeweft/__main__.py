"""Command line: python -m codeweft STORE COMMAND ..."""

from __future__ import annotations

import argparse
import threading

from pyspark.sql import SparkSession

from codeweft.functions import embed as M
from codeweft.plans import evaluate, load
from codeweft.plans import tools as T
from codeweft.sources import embed_service, graph_json
from codeweft.sources.store import Store


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="codeweft")
    p.add_argument("store", help="the folder that holds the graphs")
    commands = p.add_subparsers(dest="command", required=True)

    def command(name, *words, **options):
        c = commands.add_parser(name)
        for w in words:
            c.add_argument(w)
        for k, v in options.items():
            c.add_argument("--" + k.replace("_", "-"), **({"action": "store_true"} if v is False else {"default": v, "type": type(v) if v is not None else str}))

    command("load", "graph", "project", graph_json=None, labels=None, no_snippets=False, no_cache=False, force=False)
    command("list")
    command("status", "graph", root=None)
    command("query", "graph", "question", k=8, kind="all", hybrid=False, snippet=False)
    command("tests", "graph", "symbol", hops=2)
    command("impact", "graph", "symbol", hops=2)
    command("explain", "graph", "symbol", neighbors=10)
    command("trace", "graph", "symbol", to="", hops=4, references=False)
    command("similar", "graph", "symbol", k=6, threshold=0.10, kind="all")
    command("dupes", "graph", kind="prod", threshold=0.06, topk=4, pairs=False, framework=False, limit=20)
    command("path", "graph", "source", "target", hops=6)
    command("eval", "graph", "golden")
    command("up", port=8080, host="127.0.0.1")
    command("down")
    return p


def answer(spark: SparkSession, a: argparse.Namespace) -> list[str]:
    store = Store(spark, a.store)
    if a.command == "up":  # until interrupted
        server = embed_service.serve(a.port, a.host)
        store.update_config(embed_url=f"http://{a.host}:{server.server_address[1]}")
        threading.Event().wait()
    if a.command == "down":
        was = store.state("config").get("embed_url") or "unset"
        store.update_config(embed_url="")
        return [f"embed_url was {was}"]
    if a.command == "load":
        embed, why = M.choose_embedder(store.state("config"))
        done = load.load(store, a.graph, a.project, a.graph_json, a.labels, None if a.no_snippets else a.project, embed=embed, force=a.force, use_cache=not a.no_cache)
        return [f"{k}: {v}" for k, v in done.items()] + [f"embedder: {why}"]
    if a.command == "eval":
        nodes, _ = store.graph(a.graph)
        table, missed = evaluate.run_eval(nodes, nodes.select("id", "embedding"), graph_json.read_golden(spark, a.golden), M.choose_embedder(store.state("config"))[0])
        return [f"{r.config:<10} {r.recall_5:.2f} {r.recall_10:.2f} {r.mrr_10:.3f}" for r in table.collect()] + [f"  missed: {r.q}" for r in missed.collect()]
    calls = {
        "list": lambda: T.list_graphs(store),
        "status": lambda: T.status(store, a.graph, a.root),
        "query": lambda: T.search(store, a.graph, a.question, a.k, a.kind, a.hybrid, snippet=a.snippet),
        "tests": lambda: T.tests(store, a.graph, a.symbol, a.hops),
        "impact": lambda: T.impact(store, a.graph, a.symbol, a.hops),
        "explain": lambda: T.explain(store, a.graph, a.symbol, a.neighbors),
        "trace": lambda: T.trace(store, a.graph, a.symbol, a.to, a.hops, a.references),
        "path": lambda: T.find_path(store, a.graph, a.source, a.target, a.hops),
        "similar": lambda: T.similar(store, a.graph, a.symbol, a.k, a.threshold, a.kind),
        "dupes": lambda: T.dupes(store, a.graph, a.kind, a.threshold, a.topk, a.pairs, a.framework, a.limit),
    }
    return calls[a.command]()


if __name__ == "__main__":
    print("\n".join(answer(SparkSession.builder.appName("codeweft").getOrCreate(), parser().parse_args())))
