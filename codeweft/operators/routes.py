"""Routes between two symbols: direct, over one bridge, between instances of the names, composed over labels.

A route is a DataFrame of one row (none without a route): labels from source to target, steps (relation, bridge,
composed) between them, and reversed if its real edges run from target to source. Bridges stand for edges that names
imply. A route has a few rows at most, so these are fetched to the driver; searches stay distributed."""

from __future__ import annotations

from pyspark.sql import DataFrame, Row, Window
from pyspark.sql import functions as F

from codeweft.functions import exprs as E
from codeweft.functions import vocab as V
from codeweft.operators import graph as G

ROUTE = "labels array<string>, steps array<struct<relation:string,bridge:boolean,composed:boolean>>, reversed boolean"
FANOUT, LABEL_CAP = 300, 2000
_none = lambda: F.lit(None).cast("string")


def _route(nodes: DataFrame, found: tuple | None) -> DataFrame:
    return nodes.sparkSession.createDataFrame([found] if found else [], ROUTE)


def _ids(nodes: DataFrame, ids: list[str]) -> DataFrame:
    return nodes.sparkSession.createDataFrame([(i,) for i in ids], "id string")


def aliases(nodes: DataFrame, node_id: str) -> DataFrame:
    """id, bridge, place: what may stand for a node: itself (no bridge), partners by convention, its file's node."""
    own = nodes.where(F.col("id") == node_id)
    named = G.convention_links(nodes, of=node_id).where(F.col("relation").isin(*V.ROUTING)).select("id", F.col("relation").alias("bridge"), F.lit(1).alias("place"))
    beside = nodes.join(own.select("source_file").distinct(), "source_file", "left_semi")
    file = G.file_nodes(beside).where((F.col("id") == node_id) & (F.col("file_id") != node_id)).select(F.col("file_id").alias("id"), F.lit("in_file").alias("bridge"), F.lit(2).alias("place"))
    every = own.select("id", _none().alias("bridge"), F.lit(0).alias("place")).unionByName(named).unionByName(file)
    return every.groupBy("id").agg(F.min(F.struct("place", "bridge")).alias("m")).select("id", "m.bridge", "m.place")


def _direct(nodes: DataFrame, edges: DataFrame, a: list[str], b: list[str], max_hops: int) -> tuple | None:
    """node ids, labels, steps and reversed of the shortest path between two sets of nodes, told from a to b."""
    goals = [x for x in b if x not in a]
    if not a or not goals:
        return None
    row = G.shortest_path(edges, _ids(nodes, a), _ids(nodes, goals), max_hops).first()
    if row is None:
        return None
    ids, relations = (row.nodes[::-1], row.relations[::-1]) if row.reversed else (row.nodes, row.relations)
    label = {r.id: r.label for r in nodes.where(F.col("id").isin(*ids)).select("id", "label").collect()}
    return ids, [label.get(i) for i in ids], [(r, False, False) for r in relations], row.reversed


def instances(nodes: DataFrame, label: str, limit: int = 40) -> list[str]:
    """Ids of the candidates that share a normalised name, fragments included."""
    named = nodes.sparkSession.range(1).select(E.bare(F.lit(label)).alias("b"), E.norm(F.lit(label)).alias("n")).first()
    return [r.id for r in G.candidates(nodes, named.b, limit).where(E.norm(F.col("label")) == named.n).select("id").collect()]


def bridged(nodes: DataFrame, edges: DataFrame, a: Row, b: Row, max_hops: int = 6) -> DataFrame:
    """a and b: rows with id and label. In order: a path; partners by name; a path with one end bridged; a path between
    any instances of the two names. Paths between alias sets are one search over the set, not one for each pair."""
    found = _direct(nodes, edges, [a.id], [b.id], max_hops)
    if found:
        return _route(nodes, found[1:])
    ways = []
    for side, (own, other) in enumerate(((a, b), (b, a))):
        alias = [r for r in aliases(nodes, own.id).orderBy("place", "bridge", "id").collect() if r.bridge]
        hit = next((r for r in alias if r.id == other.id), None)
        if hit:
            return _route(nodes, ([a.label, b.label], [(hit.bridge, True, False)], False))
        ways.append({r.id: r.bridge for r in alias})
    best = None
    for side in (0, 1):
        over = list(ways[side])
        p = _direct(nodes, edges, over, [b.id], max_hops) if side == 0 else _direct(nodes, edges, [a.id], over, max_hops)
        if p and (best is None or len(p[1]) + 1 < len(best[0])):
            ids, labels, steps, back = p
            bridge = [(ways[side][ids[0] if side == 0 else ids[-1]], True, False)]
            best = ([a.label, *labels], bridge + steps, back) if side == 0 else ([*labels, b.label], steps + bridge, back)
    if best is None:
        p = _direct(nodes, edges, instances(nodes, a.label), instances(nodes, b.label), max_hops)
        best = p and p[1:]
    return _route(nodes, best)


def logical_links(nodes: DataFrame, edges: DataFrame, fanout: int = FANOUT) -> DataFrame:
    """label, relation, neighbour, bridge: the graph with equal labels as one. The first fanout links of a label count,
    then those over soft relations or to generic names go; partners by convention are added."""
    named = nodes.select("id", "label")
    side = lambda key, out: named.select(F.col("id").alias(key), F.col("label").alias(out))
    x = G.both_ways(edges).join(side("a", "label"), "a").join(side("b", "neighbour"), "b").where("label <> neighbour").select("label", "relation", "neighbour").distinct()
    x = x.withColumn("r", F.row_number().over(Window.partitionBy("label").orderBy("relation", "neighbour"))).where(F.col("r") <= fanout)
    x = x.where(~F.col("relation").isin(*V.SOFT) & ~E.is_generic(F.col("neighbour"))).select("label", "relation", "neighbour", F.lit(False).alias("bridge"))
    by_name = G.convention_links(nodes).where(F.col("relation").isin(*V.ROUTING)).join(side("src_id", "label"), "src_id").join(side("id", "neighbour"), "id")
    return x.unionByName(by_name.select("label", "relation", "neighbour", F.lit(True).alias("bridge")).distinct())


def composed(nodes: DataFrame, edges: DataFrame, a: Row, b: Row, max_hops: int = 6, label_cap: int = LABEL_CAP) -> DataFrame:
    """Search from both ends over logical links, by normalised label, until the sides meet. None if the names are equal
    or more than label_cap labels were expanded. Within a layer the least (parent, relation, label) wins."""
    ends = nodes.sparkSession.createDataFrame([(0, a.label), (1, b.label)], "side int, label string").select("side", E.norm(F.col("label")).alias("norm"), "label", _none().alias("parent"), _none().alias("relation"), F.lit(False).alias("bridge"), F.lit(0).alias("hop"))
    seen = [G.cut(ends.where(F.col("side") == i).drop("side")) for i in (0, 1)]
    if seen[0].first().norm == seen[1].first().norm:
        return _route(nodes, None)
    links = G.cut(logical_links(nodes, edges).select(F.col("label").alias("at"), "relation", "neighbour", "bridge", E.norm(F.col("neighbour")).alias("norm")))
    expanded = 0
    for hop in range(1, (max_hops + 1) // 2 + 1):
        for i in (0, 1):
            front = seen[i].where(F.col("hop") == hop - 1)
            expanded += front.count()
            if expanded > label_cap:
                return _route(nodes, None)
            step = F.min(F.struct(F.col("parent"), F.col("relation"), F.col("neighbour"), F.col("bridge"))).alias("m")
            reached = links.join(front.select(F.col("label").alias("at"), F.col("norm").alias("parent")), "at").groupBy("norm").agg(step)
            fresh = G.cut(reached.join(seen[i].select("norm"), "norm", "left_anti").select("norm", F.col("m.neighbour").alias("label"), "m.parent", "m.relation", "m.bridge", F.lit(hop).alias("hop")))
            seen[i] = seen[i].unionByName(fresh)
            met = fresh.join(seen[1 - i].select("norm"), "norm", "left_semi").orderBy("parent", "relation", "norm").first()
            if met:
                return _route(nodes, join_halves(_up(seen[0], met.norm), _up(seen[1], met.norm)))
    return _route(nodes, None)


def _up(seen: DataFrame, norm: str | None) -> list[Row]:
    """From a label to the end its side started at: at most half of max_hops rows."""
    out = []
    while norm is not None:
        out.append(seen.where(F.col("norm") == norm).first())
        norm = out[-1].parent
    return out


def join_halves(forth: list, back: list) -> tuple:
    """Both halves begin where they meet. Each row but the last holds the step towards the next."""
    labels = [r.label for r in reversed(forth)] + [r.label for r in back[1:]]
    steps = [(r.relation, r.bridge, True) for r in [*reversed(forth[:-1]), *back[:-1]]]
    return labels, steps, False


def find_route(nodes: DataFrame, edges: DataFrame, a: Row, b: Row, max_hops: int = 6) -> DataFrame:
    found = bridged(nodes, edges, a, b, max_hops)
    return composed(nodes, edges, a, b, max_hops) if found.isEmpty() else found


def related(nodes: DataFrame, edges: DataFrame, node_id: str, limit: int = 8) -> DataFrame:
    """relation, direction (null: by naming), id, label, source_file: what is near when there is no route."""
    named = G.convention_links(nodes, of=node_id).select(F.lit(0).alias("part"), "relation", _none().alias("direction"), "id")
    near = G.bfs(edges, _ids(nodes, [node_id]), "both", ("references", "imports", "imports_from", "calls"), 1, limit)
    first = named.orderBy("relation", "id").limit(limit).unionByName(near.select(F.lit(1).alias("part"), "relation", "direction", "id"))
    return first.join(nodes.select("id", "label", "source_file"), "id").orderBy("part", "relation", "id").drop("part")
