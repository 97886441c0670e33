"""Graph operators: relation sets, fragments, resolution, neighbours, conventions, layered BFS, shortest paths,
components. nodes: id, label, file_type, source_file, source_location. edges: src, dst, relation.

Every limit has a total order that ends in id. Loops cut their lineage with reliable checkpoints."""

from __future__ import annotations

import tempfile

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from codeweft.functions import exprs as E
from codeweft.functions import vocab as V


def cut(df: DataFrame) -> DataFrame:
    """A checkpoint in spark.checkpoint.dir; in local mode a temporary folder does if that is unset."""
    sc = df.sparkSession.sparkContext
    if not df.sparkSession.conf.get("spark.checkpoint.dir", None) and sc.getCheckpointDir() is None:
        if not sc.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        sc.setCheckpointDir(tempfile.mkdtemp(prefix="codeweft"))
    return df.checkpoint()


def load_edges(links: DataFrame, nodes: DataFrame) -> DataFrame:
    """Edges with both ends among the nodes; defaults for relation and weight."""
    ids = nodes.select("id")
    out = links.select(E.strip_control(F.col("source")).alias("src"), E.strip_control(F.col("target")).alias("dst"), F.coalesce("relation", F.lit("link")).alias("relation"), F.coalesce("weight", F.lit(1.0)).alias("weight"))
    return out.join(ids.withColumnRenamed("id", "src"), "src").join(ids.withColumnRenamed("id", "dst"), "dst").select("src", "dst", "relation", "weight")


def both_ways(edges: DataFrame) -> DataFrame:
    out = edges.select(F.col("src").alias("a"), F.col("dst").alias("b"), "relation", F.lit("out").alias("direction"))
    return out.unionByName(edges.select(F.col("dst").alias("a"), F.col("src").alias("b"), "relation", F.lit("in").alias("direction")))


def relation_map(edges: DataFrame) -> DataFrame:
    """id, relations: distinct incident relations, sorted."""
    return both_ways(edges).groupBy(F.col("a").alias("id")).agg(F.sort_array(F.collect_set("relation")).alias("relations"))


def with_fragment(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """nodes with fragment: stubs and nodes that are only referred to."""
    return nodes.join(relation_map(edges), "id", "left").withColumn("fragment", E.is_fragment(F.col("source_file"), F.col("source_location"), F.col("relations"))).drop("relations")


def _rank(kind):
    return F.when(kind == "code", 0).when(kind == "concept", 1).when(kind == "rationale", 2).when(kind == "document", 3).otherwise(4)


def resolve_all(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """The canonical definition of each normalised name: norm, id, n_candidates, fragments, ambiguous."""
    x = with_fragment(nodes, edges).withColumn("norm", E.norm(F.col("label"))).withColumn("test", E.is_test_path(F.col("source_file")))
    order = Window.partitionBy("norm").orderBy("fragment", "test", _rank(F.col("file_type")), E.text(F.col("source_location")) == "", F.length(E.text(F.col("source_file"))), "id")
    best = x.withColumn("r", F.row_number().over(order)).where("r = 1").select("norm", "id")
    real = ~F.col("fragment")
    counts = x.groupBy("norm").agg(
        F.greatest(F.lit(1), F.count_if(real)).cast("long").alias("n_candidates"), F.count_if("fragment").alias("fragments"), (F.count_if(real & ~F.col("test")) > 1).alias("ambiguous")
    )
    return best.join(counts, "norm")


def candidates(nodes: DataFrame, symbol: str, limit: int = 40) -> DataFrame:
    """Nodes named so (any case) or with the symbol in their label (same case), best first."""
    same = F.lower("label") == symbol.lower()
    return nodes.where(same | F.col("label").contains(symbol)).orderBy(F.coalesce(same, F.lit(False)).desc(), _rank(F.col("file_type")), "id").limit(limit)


def resolve(nodes: DataFrame, edges: DataFrame, symbol: str, limit: int = 40) -> DataFrame:
    """One row for a symbol (none if unknown): the best candidate with n_candidates, fragments, ambiguous, alternatives."""
    target = E.norm(F.lit(symbol))
    c = with_fragment(candidates(nodes, symbol, limit), edges).withColumn("exact", E.norm(F.col("label")) == target).withColumn("test", E.is_test_path(F.col("source_file")))
    order = Window.orderBy((~F.col("exact")), "fragment", "test", _rank(F.col("file_type")), E.text(F.col("source_location")) == "", F.length(E.text(F.col("source_file"))), "id")
    every = Window.partitionBy()
    c = c.withColumn("r", F.row_number().over(order)).withColumn("n_exact", F.count_if("exact").over(every))
    real = F.col("exact") & ~F.col("fragment")
    defs = real & ~F.col("test")
    any_exact = F.col("n_exact") > 0
    alt = F.when(any_exact, defs).otherwise(F.lit(True)) & (F.col("r") > 1) & (E.text(F.col("source_file")) != "")
    c = (
        c.withColumn("n_candidates", F.when(any_exact, F.greatest(F.lit(1), F.count_if(real).over(every))).otherwise(F.count("*").over(every)))
        .withColumn("fragments", F.when(any_exact, F.col("n_exact") - F.count_if(real).over(every)).otherwise(0))
        .withColumn("ambiguous", F.when(any_exact, F.count_if(defs).over(every) > 1).otherwise(F.count("*").over(every) > 1))
        .withColumn("alternatives", F.slice(F.transform(F.array_sort(F.collect_list(F.when(alt, F.struct("r", "id", "label", "source_file"))).over(every)), lambda s: s["id"]), 1, 3))
    )
    return c.where("r = 1").select("id", "label", "file_type", "source_file", "source_location", F.when(F.col("exact"), "exact").otherwise("substring").alias("match"), "n_candidates", "fragments", "ambiguous", "alternatives")


def definition_ids(nodes: DataFrame, symbol: str) -> DataFrame:
    """All nodes with the symbol's normalised name, definitions outside tests first."""
    return nodes.where(E.norm(F.col("label")) == E.norm(F.lit(symbol))).select("id", E.is_test_path(F.col("source_file")).alias("test")).orderBy("test", "id").select("id")


def neighbours(nodes: DataFrame, edges: DataFrame, limit: int = 6) -> DataFrame:
    """One hop from every node: distinct (direction, relation, label); outgoing rows keep half of the limit where
    incoming ones exist, which fill the rest."""
    x = both_ways(edges).join(nodes.select(F.col("id").alias("b"), "label"), "b").select("a", "direction", "relation", "label").distinct()
    # rows beyond the limit go before the shuffle, so a hub's window holds a few rows of each task
    first = x.withColumn("r", F.row_number().over(Window.partitionBy("a", "direction").orderBy("relation", "label"))).where(F.col("r") <= limit)
    counts = x.groupBy("a").agg(F.count_if(F.col("direction") == "in").alias("ins"), F.count_if(F.col("direction") == "out").alias("outs"))
    keep_out = F.when(F.col("ins") == 0, limit).otherwise(max(1, (limit + 1) // 2))
    x = first.join(counts.select("a", F.least("outs", keep_out).alias("keep_out")), "a")
    return x.where(F.col("r") <= F.when(F.col("direction") == "out", F.col("keep_out")).otherwise(limit - F.col("keep_out"))).select(F.col("a").alias("id"), "direction", "relation", "label")


def file_nodes(nodes: DataFrame) -> DataFrame:
    """id and file_id: the node of the file that holds a node."""
    files = nodes.where((E.text(F.col("source_file")) != "") & (F.col("label") == E.basename(F.col("source_file")))).groupBy("source_file").agg(F.min("id").alias("file_id"))
    return nodes.select("id", "source_file").join(files, "source_file").select("id", "file_id")


def file_imports(nodes: DataFrame, edges: DataFrame, limit: int = 6) -> DataFrame:
    """What the file of each node imports; nothing for the file's own node."""
    of = file_nodes(nodes).where("id <> file_id")
    links = edges.where(F.col("relation").isin("imports", "imports_from")).join(nodes.select(F.col("id").alias("dst"), F.col("label").alias("target"), F.col("source_file").alias("target_file")), "dst")
    x = of.join(links, of["file_id"] == links["src"]).select("id", "relation", "target", "target_file").distinct()
    return x.withColumn("r", F.row_number().over(Window.partitionBy("id").orderBy("relation", "target", "target_file"))).where(F.col("r") <= limit).drop("r")


def convention_links(nodes: DataFrame, edges: DataFrame | None = None, canonical: bool = False, of: str | None = None) -> DataFrame:
    """src_id, relation, id: nodes that belong to a node by name (of: that node only). With canonical, fragments go
    unless only they remain."""
    names = (nodes if of is None else nodes.where(F.col("id") == of)).select(F.col("id").alias("src_id"), E.bare(F.col("label")).alias("own"), F.posexplode(E.conventions(F.col("label"))).alias("k", "c"))
    targets = (with_fragment(nodes, edges) if canonical else nodes.withColumn("fragment", F.lit(False))).select("id", "label", "fragment")
    x = names.join(targets, F.col("c.target") == F.col("label")).where("own <> label and src_id <> id")
    if canonical:
        x = x.withColumn("all", F.min(F.col("fragment").cast("int")).over(Window.partitionBy("src_id", "c.target"))).where((F.col("all") == 1) | ~F.col("fragment"))
    first = Window.partitionBy("src_id", "id").orderBy("k")
    return x.withColumn("r", F.row_number().over(first)).where("r = 1").select("src_id", F.col("c.relation").alias("relation"), "id")


def bfs(edges: DataFrame, starts: DataFrame, direction: str, relations=(), max_hops: int = 2, node_cap: int | None = None, until: DataFrame | None = None) -> DataFrame:
    """Layered search from starts (id): hop, parent, relation, id, direction; in arrivals before out, then by parent and
    relation. node_cap keeps the first nodes of that order and adds truncated. until: ids; the first layer that holds one
    is the last."""
    both = both_ways(edges)
    both = both.where(F.col("relation").isin(*relations)) if relations else both
    both = both.where(F.col("direction") == direction) if direction != "both" else both
    empty = starts.select(F.lit(0).alias("hop"), F.lit(None).cast("string").alias("parent"), F.lit(None).cast("string").alias("relation"), "id", F.lit(None).cast("string").alias("direction")).distinct()
    seen = cut(empty)
    for hop in range(1, max_hops + 1):
        front = seen.where(F.col("hop") == hop - 1).select(F.col("id").alias("a"))
        reached = both.join(front, "a").groupBy(F.col("b").alias("id")).agg(F.min(F.struct(F.col("direction"), F.col("a").alias("parent"), "relation")).alias("m"))
        fresh = cut(reached.join(seen.select("id"), "id", "left_anti").select(F.lit(hop).alias("hop"), "m.parent", "m.relation", "id", "m.direction"))
        if fresh.isEmpty():
            break
        seen = seen.unionByName(fresh)
        if until is not None and not fresh.join(until.select("id"), "id", "left_semi").isEmpty():
            break
    out = seen.where("hop > 0")
    if node_cap is None:
        return out
    out = out.withColumn("r", F.row_number().over(Window.orderBy("hop", "direction", "parent", "id"))).where(F.col("r") <= node_cap + 1)
    return out.withColumn("truncated", F.max("r").over(Window.partitionBy()) > node_cap).where(F.col("r") <= node_cap).drop("r")


def shortest_path(edges: DataFrame, a: DataFrame, b: DataFrame, max_hops: int = 6) -> DataFrame:
    """One row (none without a path): the shortest directed path between the id sets a and b, forward first in ties.
    nodes and relations in order, reversed if it runs from b to a."""
    out = None
    for back, (s, t) in enumerate(((a, b), (b, a))):
        if out is not None:  # the way back has to be shorter
            forth = out.first()
            max_hops = forth.hop - 1 if forth else max_hops
        tree = bfs(edges, s, "out", (), max_hops, until=t)
        ends = tree.join(t.select("id"), "id", "left_semi").orderBy("hop", "id").limit(1)
        walk = ends.select("hop", F.col("id").alias("at"), F.array("id").alias("nodes"), F.array().cast("array<string>").alias("relations"))
        up = tree.select(F.col("id").alias("at"), "parent", "relation")
        for _ in range(max_hops):
            walk = walk.join(up, "at", "left").select("hop", F.col("parent").alias("at"), F.when(F.col("parent").isNull(), F.col("nodes")).otherwise(F.concat(F.array("parent"), "nodes")).alias("nodes"), F.when(F.col("parent").isNull(), F.col("relations")).otherwise(F.concat(F.array("relation"), "relations")).alias("relations"))
        walk = walk.select("hop", "nodes", "relations", F.lit(bool(back)).alias("reversed"))
        out = cut(walk) if out is None else out.unionByName(walk)
    return out.orderBy("hop", "reversed").limit(1)


def tests_for(nodes: DataFrame, edges: DataFrame, ids: DataFrame, max_hops: int = 2) -> DataFrame:
    """Test files within reach, the nearest node of each."""
    x = bfs(edges, ids, "both", V.DEPENDENCY + V.CONTAINMENT, max_hops).join(nodes, "id").where(E.is_test_path(F.col("source_file")))
    return x.withColumn("r", F.row_number().over(Window.partitionBy("source_file").orderBy("hop", "id"))).where("r = 1").select("source_file", "hop", "id")


def impact(nodes: DataFrame, edges: DataFrame, ids: DataFrame, max_hops: int = 2) -> DataFrame:
    """What depends on the ids, by category: number and first ten labels."""
    return by_category(bfs(edges, ids, "in", V.DEPENDENCY, max_hops).join(nodes, "id"))


def by_category(reached: DataFrame) -> DataFrame:
    """category, n, labels of the first ten. Rows are ranked before they are gathered, so a group stays small."""
    x = reached.withColumn("category", E.impact_category(F.col("label"), F.col("source_file"), F.col("file_type")))
    total = x.groupBy("category").agg(F.count("*").alias("n"))
    first = x.withColumn("r", F.row_number().over(Window.partitionBy("category").orderBy("hop", "id"))).where("r <= 10")
    named = first.groupBy("category").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("r", "label"))), lambda s: s["label"]), ",").alias("labels"))
    return total.join(named, "category")


def trace(edges: DataFrame, ids: DataFrame, max_hops: int = 4, with_references: bool = False) -> DataFrame:
    return bfs(edges, ids, "out", V.FLOW + (("references",) if with_references else ()), max_hops)


def components(pairs: DataFrame, most: int = 100) -> DataFrame:
    """pairs: a, b. id and component (the least id), by min labels with pointer jumping. A component of n nodes takes
    about log2 n rounds; more than `most` raise an error."""
    both = cut(pairs.select("a", "b").unionByName(pairs.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct())
    labels = cut(both.groupBy(F.col("a").alias("id")).agg(F.min("b").alias("m")).select("id", F.least("id", "m").alias("component")))
    for _ in range(most):
        sent = both.join(labels, both["b"] == labels["id"]).groupBy("a").agg(F.min("component").alias("m"))
        merged = labels.join(sent, labels["id"] == sent["a"]).select("id", F.col("component").alias("was"), F.least("component", "m").alias("component"))
        onward = merged.select(F.col("id").alias("component"), F.col("component").alias("onward"))
        new = cut(merged.join(onward, "component").select("id", "was", F.least("component", "onward").alias("component")))
        if new.where("component <> was").isEmpty():
            return new.select("id", "component")
        labels = new.select("id", "component")
    raise RuntimeError(f"components need more than {most} rounds")
