"""Answers as text. Results are limited before they are fetched, so the driver holds a page of lines at most."""

from __future__ import annotations

from pyspark.sql import DataFrame, Row
from pyspark.sql import functions as F

from codeweft.functions import exprs as E
from codeweft.functions import vocab as V
from codeweft.operators import dupes, graph, routes

CATEGORIES = ("tests", "frontend", "backend", "contract", "docs", "other")
LINES = 40


def header(name: str, verb: str, r: Row) -> list[str]:
    note = f", {r.n_candidates} definitions{' (ambiguous)' if r.ambiguous else ''}" if r.n_candidates > 1 else f", {r.fragments} references" if r.fragments else ""
    return [f"[{name}] {verb}: {r.label} ({r.file_type}, {r.source_file}:{r.source_location}){note}"]


def path_line(name: str, route: Row) -> str:
    out = route.labels[0]
    for label, s in zip(route.labels[1:], route.steps):
        mark = "⋯" if s.bridge else "─"
        out += f"  {mark}{s.relation}→  {label}"
    derived = list(dict.fromkeys(s.relation for s in route.steps if s.bridge))
    out += f"   (⋯ derived: {', '.join(derived)})" if derived else ""
    out += "   (composed: direction is approximate)" if any(s.composed for s in route.steps) else ""
    return f"[{name}] {out}"


def tree(root_id: str, root_label: str, rows: list[Row], most: int = LINES) -> list[str]:
    """rows: id, parent, relation, label. Depth first; relations that aren't structural are marked."""
    below: dict[str, list[Row]] = {}
    for r in rows:
        below.setdefault(r.parent, []).append(r)
    out, stack = [f"  {root_label}"], [(r, 1) for r in reversed(below.get(root_id, []))]
    while stack and len(out) <= most:
        r, depth = stack.pop()
        solid = r.relation in V.STRUCTURAL
        out.append("  " * (depth + 1) + f"{'─' if solid else '⋯'} {r.relation} → {r.label}{'' if solid else ' (inferred)'}")
        stack += [(x, depth + 1) for x in reversed(below.get(r.id, []))]
    return out


def _one(nodes: DataFrame, node_id: str) -> DataFrame:
    return nodes.where(F.col("id") == node_id).select("id")


def _hints(nodes: DataFrame, edges: DataFrame, node_id: str) -> list[str]:
    arrow = {None: "⋯{}→", "out": "─{}→", "in": "←{}─"}
    return [f"  {arrow[r.direction].format(r.relation)} {r.label} ({r.source_file})" for r in routes.related(nodes, edges, node_id).limit(16).collect()]


def tests(name: str, nodes: DataFrame, edges: DataFrame, symbol: str, max_hops: int = 2) -> list[str]:
    """Test files within reach of a symbol's definitions, then tests by name in other files."""
    r = graph.resolve(nodes, edges, symbol).first()
    if r is None:
        return [f"[{name}] no symbol '{symbol}'"]
    found = graph.tests_for(nodes, edges, graph.definition_ids(nodes, r.label), max_hops)
    named = graph.convention_links(nodes).where((F.col("src_id") == r.id) & (F.col("relation") == "tested_by")).join(nodes.select("id", "source_file"), "id").join(found.select("source_file"), "source_file", "left_anti")
    rows = found.orderBy("hop", "source_file").limit(LINES).collect()
    out = header(name, "tests", r) + [f"  {x.source_file} ({x.hop} hops)" for x in rows] + [f"  {x.source_file} (by naming)" for x in named.select("source_file").distinct().orderBy("source_file").limit(LINES).collect()]
    return out if len(out) > 1 else [*out, "  no tests found"]


def impact(name: str, nodes: DataFrame, edges: DataFrame, symbol: str, max_hops: int = 2) -> list[str]:
    """What contains any definition of a symbol, what depends on them by category (LINES nodes at most, which is told),
    and partners by name."""
    r = graph.resolve(nodes, edges, symbol).first()
    if r is None:
        return [f"[{name}] no symbol '{symbol}'"]
    starts = graph.cut(graph.definition_ids(nodes, r.label))
    reach = graph.cut(graph.bfs(edges, starts, "in", V.DEPENDENCY, max_hops, LINES))
    rows = {x.category: x for x in graph.by_category(reach.join(nodes, "id")).collect()}
    out = header(name, "impact", r)
    holders = graph.bfs(edges, starts, "in", V.CONTAINMENT, 1).join(nodes.select("id", "label"), "id").orderBy("label", "id").limit(5).collect()
    out += [f"  defined in: {', '.join(f'{x.label} ({x.relation})' for x in holders)}"] if holders else []
    least = len(out)
    for c in CATEGORIES:
        if c in rows:
            more = rows[c].n - min(rows[c].n, 10)
            out.append(f"  {c} ({rows[c].n}): {rows[c].labels}{f' (+{more} more)' if more else ''}")
    cut_off = reach.select("truncated").first()
    out += [f"  (cut at {LINES} nodes)"] if cut_off and cut_off.truncated else []
    linked = graph.convention_links(nodes, edges, canonical=True).where(F.col("src_id") == r.id).join(reach.select("id"), "id", "left_anti").join(nodes.select("id", "label", "source_file"), "id")
    out += [f"  ⋯{x.relation}→ {x.label} ({x.source_file}, by naming)" for x in linked.orderBy("relation", "id").limit(LINES).collect()]
    return out if len(out) > least else [*out, "  nothing depends on it"]


def trace(name: str, nodes: DataFrame, edges: DataFrame, source: str, target: str = "", max_hops: int = 4, with_references: bool = False) -> list[str]:
    """The calls that start at a symbol as a tree, or the route to a target."""
    a = graph.resolve(nodes, edges, source).first()
    b = graph.resolve(nodes, edges, target).first() if target else None
    if a is None or target and b is None:
        return [f"[{name}] no symbol '{source if a is None else target}'"]
    if target:
        route = routes.find_route(nodes, edges, a, b, max_hops).first()
        return [path_line(name, route)] if route else [f"[{name}] no path {a.label} → {b.label} (≤{max_hops})", *_hints(nodes, edges, a.id)]
    reach = graph.bfs(edges, _one(nodes, a.id), "out", V.FLOW + (("references",) if with_references else ()), max_hops, LINES)
    rows = reach.join(nodes.select("id", "label"), "id").orderBy("hop", "parent", "id").collect()
    out = header(name, "trace", a)
    if not rows:
        return [*out, "  no outgoing flow", *_hints(nodes, edges, a.id)]
    return out + tree(a.id, a.label, rows) + (["  (cut; narrow the symbol or the hops)"] if rows[0].truncated else [])


def snippets(nodes: DataFrame, files: DataFrame) -> DataFrame:
    """id, lines: the source lines of each node whose file is known."""
    return nodes.join(files, "source_file").select("id", E.snippet(F.col("lines"), F.col("source_location")).alias("lines"))


def explain(name: str, nodes: DataFrame, edges: DataFrame, symbol: str, neighbours: int = 10, files: DataFrame | None = None) -> list[str]:
    """A symbol's definition, snippet, neighbours and its file's imports. files: source_file, lines."""
    r = graph.resolve(nodes, edges, symbol).first()
    if r is None:
        return [f"[{name}] no symbol '{symbol}'"]
    out = header(name, "explain", r)
    if files is not None:
        text = files.where(F.col("source_file") == r.source_file).select(E.snippet(F.col("lines"), F.lit(r.source_location)).alias("s")).first()
        out += [f"    {line}" for line in text.s.split("\n")] if text and text.s else []
    near = graph.neighbours(nodes, edges.where((F.col("src") == r.id) | (F.col("dst") == r.id)), neighbours).where(F.col("id") == r.id)
    out += [f"  {'─' + x.relation + '→' if x.direction == 'out' else '←' + x.relation + '─'} {x.label}" for x in near.orderBy(F.desc("direction"), "relation", "label").collect()]
    if r.file_type == "code":
        out += [f"  file {x.relation}: {x.target}" for x in graph.file_imports(nodes, edges).where(F.col("id") == r.id).orderBy("relation", "target").collect()]
    return out


def histogram(distances: DataFrame) -> list[str]:
    return [f"  < {r.upper:.2f}: {r.n}" for r in dupes.histogram(distances).orderBy("upper").limit(LINES).collect()]


def pairs(name: str, nodes: DataFrame, found: DataFrame, limit: int = 20) -> list[str]:
    """Pairs by Jaccard, then distance; numbers of literal and of all."""
    count = found.agg(F.count("*").alias("n"), F.count_if("literal").alias("literal")).first()
    end = lambda c: nodes.select(F.col("id").alias(c), F.concat_ws(" ", "label", F.concat(F.lit("("), "source_file", F.lit(")"))).alias(f"{c}_at"))
    top = dupes.by_likeness(found).limit(limit).join(end("a"), "a").join(end("b"), "b")
    rows = dupes.by_likeness(top).collect()
    more = count.n - len(rows)
    return [f"[{name}] {count.n} pairs, {count.literal} literal", *[f"  {r.a_at} ~ {r.b_at}: distance {r.dist:.4f}, Jaccard {r.jaccard:.2f}{' literal' if r.literal else ''}" for r in rows], *([f"  (+{more} more)"] if more else []), *histogram(found)]


def clusters(name: str, found: DataFrame, limit: int = 20, members: DataFrame | None = None, most: int = 10) -> list[str]:
    """Clusters by score, then component; with members (see dupes.members()) the first ones of each."""
    count = found.agg(F.count("*").alias("n"), F.count_if("literal").alias("literal")).first()
    rows = found.orderBy(F.desc("score"), "component").limit(limit).collect()
    kind = lambda r: "contract" if r.contract else "same name" if r.shared_name else "literal" if r.literal else "semantic"
    who: dict[str, list[str]] = {}
    if members is not None and rows:
        for m in members.where(F.col("component").isin([r.component for r in rows]) & (F.col("place") <= most)).orderBy("component", "place").collect():
            who.setdefault(m.component, []).append(f"      {m.label} ({m.source_file}:{m.source_location})")
    out = [f"[{name}] {count.n} clusters, {count.literal} literal"]
    for r in rows:
        out += [f"  {r.component}: {r.size} members, distance {r.min_dist:.4f} to {r.max_dist:.4f}, Jaccard {r.max_jaccard:.2f}, {kind(r)}", *who.get(r.component, [])]
    return out + ([f"  (+{count.n - len(rows)} more)"] if count.n > len(rows) else []) + histogram(found.select(F.col("min_dist").alias("dist")))


def similar(name: str, symbol: str, rows: DataFrame) -> list[str]:
    found = [f"  {r.label} ({r.source_file}): distance {r.dist:.4f}, Jaccard {r.jaccard:.2f}{' literal' if r.jaccard >= V.LITERAL else ''}" for r in rows.limit(LINES).collect()]
    return [f"[{name}] similar to {symbol}", *(found or ["  nothing near enough"])]
