"""The queries of the graph engine over the driver's tables, and their SQL oracles.

There are no graph tables, so nodes and edges are derived from part and lineitem by SQL that both engines run."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from codeweft.functions import exprs as E
from codeweft.functions import vocab as V
from codeweft.operators import dupes, graph, routes, search

NODES = """SELECT concat('n', CAST(k AS STRING)) AS id,
 CASE r WHEN 0 THEN concat('Svc',s,'Command') WHEN 1 THEN concat('Svc',s,'CommandHandler') WHEN 2 THEN concat('Svc',s,'CommandHandlerTests')
  WHEN 3 THEN concat('ISvc',s,'Repository') WHEN 4 THEN concat('Svc',s,'Repository') WHEN 5 THEN concat('.Export',CAST(k % 50 AS STRING),'()')
  WHEN 6 THEN concat('Svc',s,'View') ELSE CASE k % 3 WHEN 0 THEN 'Task' WHEN 1 THEN concat('Svc',s,'Doc') ELSE concat('Svc',s,'Command') END END AS label,
 CASE WHEN r = 7 AND k % 3 = 1 THEN 'document' ELSE 'code' END AS file_type,
 CASE r WHEN 0 THEN concat('backend/App/Svc',s,'/Svc',s,'Command.cs') WHEN 1 THEN concat('backend/App/Svc',s,'/Svc',s,'CommandHandler.cs')
  WHEN 2 THEN concat('backend/Tests/Svc',s,'CommandHandlerTests.cs') WHEN 3 THEN concat('backend/App/Interfaces/ISvc',s,'Repository.cs')
  WHEN 4 THEN concat('backend/Infra/Svc',s,'Repository.cs') WHEN 5 THEN concat('backend/App/Svc',s,'/Export.cs')
  WHEN 6 THEN concat('frontend/src/Svc',s,'View.tsx') ELSE CASE k % 3 WHEN 0 THEN '' WHEN 1 THEN concat('docs/Svc',s,'.md') ELSE concat('backend/Api/Svc',s,'Controller.cs') END END AS source_file,
 CASE WHEN r = 7 AND k % 3 = 0 THEN '' ELSE concat('L', CAST(1 + k % 300 AS STRING)) END AS source_location
FROM (SELECT p_partkey AS k, p_partkey % 8 AS r, CAST(CAST((p_partkey - p_partkey % 8) / 8 AS BIGINT) AS STRING) AS s FROM {part}) p"""
EDGES = """SELECT DISTINCT concat('n', CAST(a.l_partkey AS STRING)) AS src, concat('n', CAST(b.l_partkey AS STRING)) AS dst,
 CASE (a.l_partkey + b.l_partkey) % 8 WHEN 0 THEN 'calls' WHEN 1 THEN 'references' WHEN 2 THEN 'method' WHEN 3 THEN 'contains' WHEN 4 THEN 'imports' WHEN 5 THEN 'imports_from' WHEN 6 THEN 'implements' ELSE 'conceptually_related_to' END AS relation,
 CAST(1.0 AS DOUBLE) AS weight
FROM {lineitem} a JOIN {lineitem} b ON a.l_orderkey = b.l_orderkey AND b.l_linenumber = a.l_linenumber + 1
WHERE a.l_partkey <> b.l_partkey"""
#: As extractors make them: a node for each source file, which imports what the nodes in it import.
FILE_IMPORTS = """SELECT DISTINCT concat('f', md5(n.source_file)) AS src, e.dst, e.relation, e.weight FROM {edges} e JOIN {nodes} n ON n.id = e.src
WHERE e.relation IN ('imports', 'imports_from') AND n.source_file <> ''"""


def _read(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def nodes(spark: SparkSession, sf: str) -> DataFrame:
    return spark.sql(NODES, part=_read(spark, sf, "part"))


def _cut_nodes(spark: SparkSession, sf: str) -> DataFrame:
    """As they would come from a stored graph: else each use of a label or path repeats the CASE that makes it."""
    return graph.cut(nodes(spark, sf))


def edges(spark: SparkSession, sf: str) -> DataFrame:
    return spark.sql(EDGES, lineitem=_read(spark, sf, "lineitem"))


def vectors(spark: SparkSession, sf: str) -> DataFrame:
    return _read(spark, sf, "embeddings").select(F.concat(F.lit("n"), F.col("vec_id").cast("string")).alias("id"), "embedding")


def with_text(spark: SparkSession, sf: str) -> DataFrame:
    docs = _read(spark, sf, "documents").select(F.concat(F.lit("n"), F.col("doc_id").cast("string")).alias("id"), "text")
    return _cut_nodes(spark, sf).join(docs, "id", "left").withColumn("text", F.coalesce("text", F.lit("")))


def _cut_edges(spark: SparkSession, sf: str) -> DataFrame:
    """For queries that read the edges in many steps, as they would a stored graph."""
    return graph.cut(edges(spark, sf))


def _seed(e: DataFrame) -> DataFrame:
    """The node with the most outgoing edges, ties by id."""
    return e.groupBy(F.col("src").alias("id")).agg(F.count("*").alias("n")).orderBy(F.desc("n"), "id").limit(1).select("id")


def _query_vector(spark: SparkSession, sf: str) -> list[float]:
    return list(_read(spark, sf, "embeddings").where("vec_id = 1").select("embedding").first()[0])


def _label_flags(s, d):
    c = F.col
    return _cut_nodes(s, d).select(
        "id", E.norm(c("label")).alias("norm"), E.bare(c("label")).alias("bare"), E.is_generic(c("label")).alias("generic"), E.is_noise(c("label")).alias("noise"), E.is_test_path(c("source_file")).alias("test"),
        E.layer_of(c("source_file")).alias("layer"), E.impact_category(c("label"), c("source_file"), c("file_type")).alias("category"), E.is_interface_member(c("label"), c("source_file")).alias("interface"), E.is_symbol(c("label"), c("source_file")).alias("symbol"),
    )


def _kind(kind):
    return lambda s, d: nodes(s, d).where(E.kind_matches(F.col("source_file"), F.col("file_type"), kind)).select("id", "label")


def _demoted(s, d):
    return search.search(with_text(s, d), vectors(s, d), _query_vector(s, d))


def _hybrid(s, d):
    return search.search(with_text(s, d), vectors(s, d), _query_vector(s, d), question="the handler thing and ereat", hybrid=True)


def _bfs(direction, relations, hops):
    return _walked(lambda s, d, e: graph.bfs(e, _seed(e), direction, relations, hops).select("id", F.col("hop").cast("long").alias("hop")))


def _walked(f):
    return lambda s, d: f(s, d, _cut_edges(s, d))


def _path_len(s, d):
    e = _cut_edges(s, d)
    seed = graph.cut(_seed(e))
    far = graph.cut(graph.bfs(e, seed, "out", (), 4).orderBy(F.desc("hop"), "id").limit(1).select("id"))
    return graph.shortest_path(e, seed, far, 6).select(F.col("hop").cast("long").alias("hops"), F.concat_ws(" > ", "nodes").alias("nodes"), F.concat_ws(" > ", "relations").alias("relations"), "reversed")


def _route(maker):
    """From the busiest node to the first node of a name."""

    def run(s, d):
        n, e = graph.cut(nodes(s, d)), _cut_edges(s, d)
        a = n.join(_seed(e), "id").first()
        found = maker(n, e, a, n.where("label = 'ISvc3Repository'").orderBy("id").first())
        out = found.select(F.concat_ws(" > ", "labels").alias("labels"), F.size("steps").cast("long").alias("hops"), "reversed")
        return out if maker is routes.bridged else out.select(F.substring_index("labels", " > ", 1).alias("source"), F.substring_index("labels", " > ", -1).alias("target"), "hops")

    return run


def _lines(s, d):
    c = F.col
    x = _read(s, d, "documents").select("doc_id", E.split_lines(c("text")).alias("lines"))
    return x.select("doc_id", F.size("lines").cast("long").alias("n"), E.snippet(c("lines"), F.lit("L1-L2")).alias("snippet"))


def _around(s, d):
    c = F.col
    x = _read(s, d, "documents").select("doc_id", E.split_lines(c("text")).alias("lines"))
    return x.select("doc_id", E.leading_comment(c("lines"), F.lit("L3")).alias("comment"), E.ui_text(F.lit("web/View.tsx"), c("lines"), F.lit("L1")).alias("ui"))


def _dupe_pairs(s, d):
    return dupes.pairs(with_text(s, d), edges(s, d), vectors(s, d), kind="code", threshold=0.65)


def _metrics(s, d):
    v = vectors(s, d)
    ranked = search.knn_join(v.where("substring(id, 2) % 50 = 0"), v, 10).select(F.col("a").alias("query"), F.col("b").alias("id"), "rank")
    kinds = _read(s, d, "embeddings").select(F.concat(F.lit("n"), F.col("vec_id").cast("string")).alias("id"), "label")
    q = kinds.join(ranked.select("query").distinct(), F.col("query") == F.col("id")).select("query", "label")
    return search.metrics(ranked, q.join(kinds, "label").where("query <> id").select("query", "id"))


def _cache(s, d):
    docs = _read(s, d, "documents").select("doc_id", E.text_hash(F.lit("model-a"), F.col("text")).alias("hash"))
    cached = docs.join(_read(s, d, "labels").select("doc_id"), "doc_id", "left_semi").select("hash").distinct().withColumn("hit", F.lit(True))
    x = docs.join(cached, "hash", "left")
    return x.agg(F.count_if("hit").alias("reused"), F.count_distinct(F.when(F.col("hit").isNull(), F.col("hash"))).alias("missing"))


def _dangling(s, d):
    n = nodes(s, d).where("source_file <> ''")
    return graph.load_edges(edges(s, d).select(F.col("src").alias("source"), F.col("dst").alias("target"), "relation", "weight"), n).groupBy("relation").agg(F.count("*").alias("n"))


def _joined_text(s, d):
    c = F.col
    return with_text(s, d).select("id", E.node_text(c("label"), c("file_type"), F.translate("source_file", "/.", "  "), c("text")).alias("node_text"))


def queries() -> dict:
    return {
        "label_flags": _label_flags,
        **{f"kind_filter_{k}": _kind(k) for k in ("code", "tests", "docs", "prod", "frontend", "backend")},
        "node_counts": lambda s, d: nodes(s, d).groupBy("file_type").agg(F.count("*").alias("n")),
        "relation_kinds": lambda s, d: edges(s, d).groupBy(E.relation_kind(F.col("relation")).alias("kind")).agg(F.count("*").alias("n")),
        "rel_map": lambda s, d: graph.relation_map(edges(s, d)).select("id", F.array_join("relations", ",").alias("relations")),
        "fragments": lambda s, d: graph.with_fragment(_cut_nodes(s, d), edges(s, d)).where("fragment").select("id"),
        "resolve_symbols": _walked(lambda s, d, e: graph.resolve_all(_cut_nodes(s, d), e)),
        "resolve_one": lambda s, d: graph.resolve(_cut_nodes(s, d), edges(s, d), "Svc3Command").select("id", "match", "n_candidates", F.array_join("alternatives", ",").alias("alternatives")),
        "definition_ids": lambda s, d: graph.definition_ids(nodes(s, d), ".Export5()"),
        "neighbors": _walked(lambda s, d, e: graph.neighbours(_cut_nodes(s, d), e)),
        "file_nodes": lambda s, d: graph.file_nodes(nodes(s, d).unionByName(_file_rows(s, d))),
        "file_imports": lambda s, d: graph.file_imports(nodes(s, d).unionByName(_file_rows(s, d)), edges(s, d).unionByName(s.sql(FILE_IMPORTS, edges=edges(s, d), nodes=nodes(s, d)))),
        "bfs_in_2": _bfs("in", V.DEPENDENCY, 2),
        "bfs_out_4": _bfs("out", (), 4),
        "bfs_both_2": _bfs("both", V.DEPENDENCY + V.CONTAINMENT, 2),
        "trace_flow": _walked(lambda s, d, e: graph.trace(e, _seed(e)).select("id", F.col("hop").cast("long").alias("hop"))),
        "tests_for_symbol": _walked(lambda s, d, e: graph.tests_for(_cut_nodes(s, d), e, _seed(e)).select("source_file", F.col("hop").cast("long").alias("hop"))),
        "impact_summary": _walked(lambda s, d, e: graph.impact(_cut_nodes(s, d), e, _seed(e), 3).select("category", "n", "labels")),
        "convention_links": lambda s, d: graph.convention_links(_cut_nodes(s, d)),
        "convention_canonical": lambda s, d: graph.convention_links(_cut_nodes(s, d), edges(s, d), canonical=True),
        "shortest_path_len": _path_len,
        "bridged_route": _route(routes.bridged),
        "composed_route": _route(routes.composed),
        "logical_neighbours": lambda s, d: routes.logical_links(_cut_nodes(s, d), edges(s, d)),
        "source_lines": _lines,
        "source_comments": _around,
        "degree_stats": lambda s, d: graph.both_ways(edges(s, d)).groupBy(F.col("a").alias("id")).agg(F.count_if(F.col("direction") == "out").alias("outgoing"), F.count_if(F.col("direction") == "in").alias("incoming")),
        "components": lambda s, d: graph.components(edges(s, d).select(F.col("src").alias("a"), F.col("dst").alias("b"))),
        "knn_query": lambda s, d: search.knn(vectors(s, d), _query_vector(s, d), 10),
        "knn_self_top4": lambda s, d: search.knn_join(vectors(s, d), vectors(s, d), 4).select("a", "b", "dist"),
        "demoted_search": _demoted,
        "lexical_search": lambda s, d: search.lexical(with_text(s, d).select("id", "text"), "the handler thing and ereat", 20),
        "hybrid_rrf": _hybrid,
        "shingle_counts": lambda s, d: _read(s, d, "documents").select("doc_id", F.size(E.shingles(F.col("text"))).cast("long").alias("n")),
        "literal_pairs": lambda s, d: dupes.literal_pairs(_read(s, d, "documents").select(F.col("doc_id").alias("id"), "text")),
        "similar_symbol": lambda s, d: dupes.similar(with_text(s, d), edges(s, d), vectors(s, d), "n4", threshold=0.9),
        "dupe_pairs": _dupe_pairs,
        "dupe_clusters": lambda s, d: dupes.clusters(_cut_nodes(s, d), graph.cut(_dupe_pairs(s, d))),
        "dist_histogram": lambda s, d: dupes.histogram(search.knn_join(vectors(s, d), vectors(s, d), 4)),
        "eval_metrics": _metrics,
        "cache_hits_missing": _cache,
        "edge_load_dangling": _dangling,
        "node_text": _joined_text,
        "text_hash": lambda s, d: _read(s, d, "documents").select("doc_id", E.text_hash(F.lit("model-a"), E.strip_control(F.col("text"))).alias("hash")),
    }


def _file_rows(s, d):
    """A node for each source file, as extractors make them."""
    return nodes(s, d).where("source_file <> ''").select("source_file").distinct().select(F.concat(F.lit("f"), F.md5("source_file")).alias("id"), E.basename(F.col("source_file")).alias("label"), F.lit("code").alias("file_type"), "source_file", F.lit("L1").alias("source_location"))


# SQL side --------------------------------------------------------------------------------------------------------

_CTE = f"""WITH RECURSIVE nodes AS ({NODES.format(part="part")}), edges AS ({EDGES.format(lineitem="lineitem")}),
both_ways AS (SELECT src AS a, dst AS b, relation, 'out' AS direction FROM edges UNION ALL SELECT dst, src, relation, 'in' FROM edges),
seed AS (SELECT src AS id FROM edges GROUP BY src ORDER BY count(*) DESC, src LIMIT 1),
vecs AS (SELECT concat('n', CAST(vec_id AS STRING)) AS id, embedding::DOUBLE[64] AS e, label AS kind FROM embeddings),
texts AS (SELECT n.*, coalesce(d.text, '') AS text FROM nodes n LEFT JOIN documents d ON n.id = concat('n', CAST(d.doc_id AS STRING))),
relmap AS (SELECT a AS id, list_sort(list(DISTINCT relation)) AS relations FROM both_ways GROUP BY a),
frag AS (SELECT n.*, (source_file = '' AND source_location = '') OR (len(coalesce(relations, [])) > 0 AND len(list_filter(relations, lambda x: x NOT IN ('references','imports','imports_from'))) = 0) AS fragment FROM nodes n LEFT JOIN relmap USING (id))
"""
_PATH = """, {p}step AS (SELECT id, 0 AS hop FROM {start} UNION SELECT e.dst, hop + 1 FROM {p}step JOIN edges e ON e.src = {p}step.id WHERE hop < {hops}),
{p}hop AS (SELECT id, min(hop) AS hop FROM {p}step GROUP BY id),
{p}tree AS (SELECT h.id, h.hop, min({{'parent': e.src, 'relation': e.relation}}) AS m FROM {p}hop h JOIN edges e ON e.dst = h.id JOIN {p}hop g ON g.id = e.src AND g.hop = h.hop - 1 GROUP BY h.id, h.hop),
{p}walk AS (SELECT hop AS whole, id AS at, hop AS togo, [id] AS nodes, CAST([] AS VARCHAR[]) AS relations FROM {p}hop WHERE id IN (SELECT id FROM {goal}) AND hop > 0
 UNION ALL SELECT whole, m.parent, w.togo - 1, list_prepend(m.parent, nodes), list_prepend(m.relation, relations) FROM {p}walk w JOIN {p}tree t ON t.id = w.at WHERE w.togo > 0)"""
#: The shortest of the ways there and back, there first in ties.
_BOTH_PATHS = "ends AS (SELECT whole AS hops, nodes, relations, false AS reversed FROM f_walk WHERE togo = 0 UNION ALL SELECT whole, nodes, relations, true FROM b_walk WHERE togo = 0), best AS (SELECT * FROM ends ORDER BY hops, reversed LIMIT 1)"
_BARE = "rtrim(ltrim(trim(label), '.'), '()')"
_TEST = "(contains(lower(source_file), '.test.') OR contains(lower(source_file), '.spec.') OR regexp_matches(lower(source_file), 'tests?\\.cs$') OR regexp_matches(lower(source_file), '(^|/)(tests?|[^/]*-tests?|[^/]*\\.tests)(/|$)'))"
_in = lambda names: "(" + ", ".join(f"'{x}'" for x in names) + ")"
_GENERIC = f"(trim(label) = '' OR rtrim(lower(trim(label)), '()') IN {_in(V.GENERIC)} OR regexp_matches(trim(label), '^[A-Z][A-Za-z]?$'))"
_EXT = "CASE WHEN contains(source_file, '.') THEN lower(regexp_extract(source_file, '\\.([^./]*)$', 1)) ELSE '' END"
_LAYER = f"CASE WHEN {_EXT} IN {_in(V.BACK_EXT)} THEN 'backend' WHEN {_EXT} IN {_in(V.FRONT_EXT)} THEN 'frontend' WHEN regexp_matches(lower(source_file), '(^|/)(backend|server|api)(/|$)') THEN 'backend' WHEN regexp_matches(lower(source_file), '(^|/)(frontend|client|web|webapp|ui)(/|$)') THEN 'frontend' END"
_CATEGORY = f"CASE WHEN {_TEST} THEN 'tests' WHEN source_file LIKE 'frontend/%' OR regexp_matches(source_file, '\\.(ts|tsx|vue|jsx)$') THEN 'frontend' WHEN file_type IN ('document','concept','rationale') THEN 'docs' WHEN regexp_matches(concat(label, ' ', source_file), '(?i)(dto|contract|request|response|command|query|payload)') THEN 'contract' WHEN file_type = 'code' THEN 'backend' ELSE 'other' END"
_INTERFACE = f"(regexp_matches(source_file, '(^|/)I[A-Z][^/]*$') OR contains(lower(source_file), '/interfaces/') OR regexp_matches({_BARE}, '^I[A-Z]'))"
_SYMBOL = f"(label <> '' AND NOT regexp_matches(lower(source_file), '\\.(csproj|props|sln|json|xml|yml|yaml|md|txt|sh|env|config|lock)$') AND NOT regexp_matches(lower(label), '\\.({'|'.join(V.FRONT_EXT + V.BACK_EXT)})$'))"
_CODE = f"file_type = 'code' AND NOT {_TEST}"
_KIND = {
    "code": _CODE, "tests": _TEST, "docs": "file_type IN ('document','concept','rationale')", "frontend": f"{_CODE} AND {_LAYER} = 'frontend'", "backend": f"{_CODE} AND {_LAYER} = 'backend'",
    "prod": f"{_CODE} AND NOT contains(lower(source_file), '.generated.') AND NOT regexp_matches(lower(source_file), '(^|/)(migrations|obj|bin|node_modules|dist|__generated__)(/|$)')",
}


def _walk(direction: str, relations, hops: int) -> str:
    """CTE reach(id, hop): least hop of every node within reach."""
    keep = f"AND relation IN {_in(relations)}" if relations else ""
    way = "" if direction == "both" else f"AND direction = '{direction}'"
    return f""", steps AS (SELECT id, 0 AS hop FROM seed UNION SELECT w.b, hop + 1 FROM steps JOIN both_ways w ON w.a = steps.id WHERE hop < {hops} {keep} {way}),
reach AS (SELECT id, CAST(min(hop) AS BIGINT) AS hop FROM steps GROUP BY id HAVING min(hop) > 0)"""


_RANKED = "ORDER BY fragment, test, CASE file_type WHEN 'code' THEN 0 WHEN 'concept' THEN 1 WHEN 'rationale' THEN 2 WHEN 'document' THEN 3 ELSE 4 END, source_location = '', length(source_file), id"
_CONV = f""", own AS (SELECT id, label, {_BARE} AS b FROM nodes),
conv AS (SELECT id AS src_id, b, label, 0 AS k, 'tested_by' AS relation, concat(b, 'Tests') AS target FROM own UNION ALL SELECT id, b, label, 1, 'tested_by', concat(b, 'Test') FROM own
 UNION ALL SELECT id, b, label, 2, 'handled_by', concat(b, 'Handler') FROM own WHERE regexp_matches(b, '(Command|Query)$')
 UNION ALL SELECT id, b, label, 3, 'handles', regexp_replace(b, 'Handler$', '') FROM own WHERE b LIKE '%Handler'
 UNION ALL SELECT id, b, label, 4, 'impl_of', CASE WHEN regexp_matches(b, '^I[A-Z]') THEN substr(b, 2) ELSE concat('I', b) END FROM own),
linked AS (SELECT c.*, f.id, f.fragment FROM conv c JOIN frag f ON c.target = f.label WHERE c.b <> f.label AND c.src_id <> f.id)"""
_KNN = ", near AS (SELECT a.id AS a, b.id AS b, round(array_cosine_distance(a.e, b.e), 6) AS dist, row_number() OVER (PARTITION BY a.id ORDER BY round(array_cosine_distance(a.e, b.e), 6), b.id) AS rank FROM {q} a JOIN vecs b ON a.id <> b.id)"
_SH = r"list_distinct(CASE WHEN len(t) >= 4 THEN list_transform(range(1, len(t) - 2), lambda i: array_to_string(t[i:i + 3], ' ')) WHEN len(t) > 0 THEN [array_to_string(t, ' ')] ELSE [] END)"
_TOKENS = r"regexp_extract_all(text, '[A-Za-z_][A-Za-z0-9_]*|[^\sA-Za-z0-9_]')"
_VEC = ", qv AS (SELECT embedding::DOUBLE[64] AS q FROM embeddings WHERE vec_id = 1), vec AS (SELECT id, round(array_cosine_distance(e, q), 6) AS dist FROM vecs, qv ORDER BY dist, id LIMIT {n})"
_LEX = r""", words AS (SELECT id, unnest(regexp_extract_all(lower(text), '[\p{{L}}\p{{N}}_]+')) AS term FROM texts),
tf AS (SELECT id, term, count(*) AS tf FROM words WHERE term IN ('the','handler','thing','and','ereat') GROUP BY 1, 2), df AS (SELECT term, count(*) AS df FROM tf GROUP BY 1),
lex AS (SELECT id, round(sum(tf * ln(1 + (SELECT count(*) FROM texts) / df)), 6) AS score FROM tf JOIN df USING (term) GROUP BY id ORDER BY score DESC, id LIMIT {n})"""


def _fused(rankings: str) -> str:
    return f""", kept AS (SELECT t.* FROM texts t JOIN ids USING (id) WHERE NOT {_GENERIC}), parts AS ({rankings})
SELECT id, label, file_type, source_file, round(sum(part) * CASE WHEN {_TEST} THEN 0.5 ELSE 1.0 END, 6) AS score FROM parts JOIN kept USING (id) GROUP BY id, label, file_type, source_file ORDER BY score DESC, id LIMIT 8"""


_PAIRS = f""", scan AS (SELECT * FROM frag WHERE {_CODE} AND {_SYMBOL} AND NOT {_GENERIC} AND lower({_BARE}) NOT IN {_in(V.FRAMEWORK)} AND NOT fragment){_KNN.format(q="(SELECT v.* FROM vecs v JOIN scan USING (id))")},
keyed AS (SELECT least(a, b) AS a, greatest(a, b) AS b, min(dist) AS dist FROM near WHERE rank <= 4 AND dist <= 0.65 GROUP BY 1, 2),
toks AS (SELECT id, {_SH} AS s FROM (SELECT id, {_TOKENS} AS t FROM texts WHERE id IN (SELECT a FROM keyed UNION SELECT b FROM keyed))),
named AS (SELECT *, {_BARE} AS bare FROM scan),
pairs AS (SELECT k.a, k.b, k.dist, round(CASE WHEN len(ta.s) = 0 OR len(tb.s) = 0 THEN 0 ELSE len(list_intersect(ta.s, tb.s)) / len(list_distinct(list_concat(ta.s, tb.s))) END, 6) AS jaccard
 FROM keyed k JOIN named x ON k.a = x.id JOIN named y ON k.b = y.id JOIN toks ta ON ta.id = k.a JOIN toks tb ON tb.id = k.b
 WHERE NOT (x.source_file <> '' AND x.source_file = y.source_file)
 AND NOT ({" OR ".join(f"x.bare = concat(y.bare, '{f}') OR y.bare = concat(x.bare, '{f}')" for f in V.FAMILY)})
 AND (k.a, k.b) NOT IN (SELECT (least(src, dst), greatest(src, dst)) FROM edges))"""
_LOGICAL = f""", pairs_ AS (SELECT DISTINCT m.label, w.relation, n.label AS neighbour FROM both_ways w JOIN nodes m ON w.a = m.id JOIN nodes n ON w.b = n.id WHERE m.label <> n.label),
first_ AS (SELECT * FROM pairs_ QUALIFY row_number() OVER (PARTITION BY label ORDER BY relation, neighbour) <= 300),
logical AS (SELECT label, relation, neighbour, false AS bridge FROM first_ WHERE relation NOT IN {_in(V.SOFT)} AND NOT {_GENERIC.replace("label", "neighbour")}
 UNION ALL SELECT DISTINCT l.label, l.relation, n.label, true FROM (SELECT * FROM linked QUALIFY row_number() OVER (PARTITION BY src_id, id ORDER BY k) = 1) l JOIN nodes n ON l.id = n.id WHERE l.relation IN {_in(V.ROUTING)})"""
_SIMILAR = f"""{_KNN.format(q="(SELECT * FROM vecs WHERE id = 'n4')")}, me AS (SELECT *, {_BARE} AS bare FROM texts WHERE id = 'n4'),
x AS (SELECT f.*, t.text, n.dist, {_BARE.replace("label", "f.label")} AS bare FROM near n JOIN frag f ON f.id = n.b JOIN texts t ON t.id = n.b WHERE n.rank <= 48 AND n.dist <= 0.9 AND n.b NOT IN (SELECT b FROM both_ways WHERE a = 'n4')),
y AS (SELECT x.* FROM x, me WHERE NOT fragment AND {_SYMBOL.replace("label", "x.label").replace("source_file", "x.source_file")} AND NOT {_GENERIC.replace("label", "x.label")} AND lower(x.bare) NOT IN {_in(V.FRAMEWORK)} AND NOT (me.source_file <> '' AND me.source_file = x.source_file)
 AND NOT ({" OR ".join(f"x.bare = concat(me.bare, '{f}') OR me.bare = concat(x.bare, '{f}')" for f in V.FAMILY)}) ORDER BY dist, x.id LIMIT 6),
toks AS (SELECT id, {_SH} AS s FROM (SELECT id, {_TOKENS} AS t FROM texts WHERE id = 'n4' OR id IN (SELECT id FROM y)))
SELECT y.id, label, source_file, dist, round(CASE WHEN len(a.s) = 0 OR len(b.s) = 0 THEN 0 ELSE len(list_intersect(a.s, b.s)) / len(list_distinct(list_concat(a.s, b.s))) END, 6) AS jaccard FROM y JOIN toks b ON b.id = y.id, (SELECT s FROM toks WHERE id = 'n4') a"""
_FILES = """, files AS (SELECT DISTINCT concat('f', md5(source_file)) AS id, regexp_extract(source_file, '([^/]*)$', 1) AS label, source_file FROM nodes WHERE source_file <> ''),
allnodes AS (SELECT id, label, source_file FROM nodes UNION ALL SELECT * FROM files),
filenode AS (SELECT source_file, min(id) AS file_id FROM allnodes WHERE source_file <> '' AND label = regexp_extract(source_file, '([^/]*)$', 1) GROUP BY 1), offile AS (SELECT n.id, file_id FROM allnodes n JOIN filenode USING (source_file))"""


def oracle_sql() -> dict:
    q = {
        "label_flags": f"SELECT id, lower({_BARE}) AS norm, {_BARE} AS bare, {_GENERIC} AS generic, {_GENERIC} OR lower({_BARE}) IN {_in(V.FRAMEWORK)} AS noise, {_TEST} AS test, {_LAYER} AS layer, {_CATEGORY} AS category, {_INTERFACE} AS interface, {_SYMBOL} AS symbol FROM nodes",
        **{f"kind_filter_{k}": f"SELECT id, label FROM nodes WHERE {x}" for k, x in _KIND.items()},
        "node_counts": "SELECT file_type, count(*) AS n FROM nodes GROUP BY 1",
        "relation_kinds": f"SELECT CASE WHEN relation IN {_in(V.STRUCTURAL)} THEN 'structural' ELSE 'inferred' END AS kind, count(*) AS n FROM edges GROUP BY 1",
        "rel_map": "SELECT id, array_to_string(relations, ',') AS relations FROM relmap",
        "fragments": "SELECT id FROM frag WHERE fragment",
        "resolve_symbols": f", x AS (SELECT *, lower({_BARE}) AS norm, {_TEST} AS test FROM frag), b AS (SELECT norm, id FROM x QUALIFY row_number() OVER (PARTITION BY norm {_RANKED}) = 1), c AS (SELECT norm, greatest(1, count(*) FILTER (NOT fragment)) AS n_candidates, count(*) FILTER (fragment) AS fragments, count(*) FILTER (NOT fragment AND NOT test) > 1 AS ambiguous FROM x GROUP BY norm) SELECT b.norm, id, n_candidates, fragments, ambiguous FROM b JOIN c USING (norm)",
        "definition_ids": f"SELECT id FROM nodes WHERE lower({_BARE}) = 'export5'",
        "neighbors": ", x AS (SELECT DISTINCT a AS id, direction, relation, label FROM both_ways w JOIN nodes n ON w.b = n.id), y AS (SELECT *, row_number() OVER (PARTITION BY id, direction ORDER BY relation, label) AS r, count(*) FILTER (direction = 'in') OVER (PARTITION BY id) AS ins, count(*) FILTER (direction = 'out') OVER (PARTITION BY id) AS outs FROM x), z AS (SELECT *, least(outs, CASE WHEN ins = 0 THEN 6 ELSE 3 END) AS keep_out FROM y) SELECT id, direction, relation, label FROM z WHERE r <= CASE WHEN direction = 'out' THEN keep_out ELSE 6 - keep_out END",
        "file_nodes": f"{_FILES} SELECT id, file_id FROM offile",
        "file_imports": f"{_FILES}, alledges AS (SELECT * FROM edges UNION ALL {FILE_IMPORTS.format(edges="edges", nodes="nodes")}), x AS (SELECT DISTINCT o.id, e.relation, n.label AS target, n.source_file AS target_file FROM offile o JOIN alledges e ON e.src = o.file_id JOIN allnodes n ON n.id = e.dst WHERE o.id <> o.file_id AND e.relation IN ('imports', 'imports_from')) SELECT * FROM x QUALIFY row_number() OVER (PARTITION BY id ORDER BY relation, target, target_file) <= 6",
        "bfs_in_2": f"{_walk('in', V.DEPENDENCY, 2)} SELECT id, hop FROM reach",
        "bfs_out_4": f"{_walk('out', (), 4)} SELECT id, hop FROM reach",
        "bfs_both_2": f"{_walk('both', V.DEPENDENCY + V.CONTAINMENT, 2)} SELECT id, hop FROM reach",
        "trace_flow": f"{_walk('out', V.FLOW, 4)} SELECT id, hop FROM reach",
        "tests_for_symbol": f"{_walk('both', V.DEPENDENCY + V.CONTAINMENT, 2)} SELECT source_file, min(hop) AS hop FROM reach JOIN nodes USING (id) WHERE {_TEST} GROUP BY 1",
        "impact_summary": f"{_walk('in', V.DEPENDENCY, 3)} , x AS (SELECT *, {_CATEGORY} AS category FROM reach JOIN nodes USING (id)), y AS (SELECT *, row_number() OVER (PARTITION BY category ORDER BY hop, id) AS r, count(*) OVER (PARTITION BY category) AS n FROM x) SELECT category, n, string_agg(label, ',' ORDER BY r) AS labels FROM y WHERE r <= 10 GROUP BY category, n",
        "convention_links": f"{_CONV} SELECT src_id, relation, id FROM linked QUALIFY row_number() OVER (PARTITION BY src_id, id ORDER BY k) = 1",
        "convention_canonical": f"{_CONV}, kept AS (SELECT *, bool_and(fragment) OVER (PARTITION BY src_id, target) AS alone FROM linked) SELECT src_id, relation, id FROM kept WHERE alone OR NOT fragment QUALIFY row_number() OVER (PARTITION BY src_id, id ORDER BY k) = 1",
        "shortest_path_len": f"{_walk('out', (), 4)}, far AS (SELECT id FROM reach ORDER BY hop DESC, id LIMIT 1)" + _PATH.format(p="f_", start="seed", goal="far", hops=6) + _PATH.format(p="b_", start="far", goal="seed", hops=6) + f", {_BOTH_PATHS} SELECT CAST(hops AS BIGINT) AS hops, array_to_string(nodes, ' > ') AS nodes, array_to_string(relations, ' > ') AS relations, reversed FROM best",
        "bridged_route": ", goal AS (SELECT id FROM nodes WHERE label = 'ISvc3Repository' ORDER BY id LIMIT 1)" + _PATH.format(p="f_", start="seed", goal="goal", hops=6) + _PATH.format(p="b_", start="goal", goal="seed", hops=6) + f", {_BOTH_PATHS}, told AS (SELECT hops, reversed, CASE WHEN reversed THEN list_reverse(nodes) ELSE nodes END AS ids FROM best), named AS (SELECT hops, reversed, unnest(ids) AS id, generate_subscripts(ids, 1) AS k FROM told) SELECT string_agg(label, ' > ' ORDER BY k) AS labels, CAST(hops AS BIGINT) AS hops, reversed FROM named JOIN nodes USING (id) GROUP BY hops, reversed",
        "composed_route": f"{_CONV}{_LOGICAL}, norms AS (SELECT DISTINCT lower(rtrim(ltrim(trim(label), '.'), '()')) AS a, lower(rtrim(ltrim(trim(neighbour), '.'), '()')) AS b FROM logical), goal AS (SELECT label FROM nodes WHERE label = 'ISvc3Repository' LIMIT 1), walk AS (SELECT lower({_BARE}) AS a, 0 AS hop FROM nodes JOIN seed USING (id) UNION SELECT n.b, hop + 1 FROM walk w JOIN norms n ON w.a = n.a WHERE hop < 6) SELECT (SELECT label FROM nodes JOIN seed USING (id)) AS source, label AS target, (SELECT CAST(min(hop) AS BIGINT) FROM walk WHERE a = lower({_BARE})) AS hops FROM goal",
        "resolve_one": f", c AS (SELECT *, lower({_BARE}) = 'svc3command' AS exact, {_TEST} AS test FROM frag JOIN (SELECT id FROM nodes WHERE lower(label) = 'svc3command' OR contains(label, 'Svc3Command') ORDER BY lower(label) = 'svc3command' DESC, CASE file_type WHEN 'code' THEN 0 WHEN 'concept' THEN 1 WHEN 'rationale' THEN 2 WHEN 'document' THEN 3 ELSE 4 END, id LIMIT 40) USING (id)), r AS (SELECT *, row_number() OVER ({_RANKED.replace('ORDER BY ', 'ORDER BY NOT exact, ')}) AS r FROM c), a AS (SELECT count(*) FILTER (exact) AS n_exact, count(*) FILTER (exact AND NOT fragment) AS n_real, count(*) AS n, coalesce(list(id ORDER BY r) FILTER (r > 1 AND source_file <> '' AND exact AND NOT fragment AND NOT test), []) AS defs, coalesce(list(id ORDER BY r) FILTER (r > 1 AND source_file <> ''), []) AS others FROM r) SELECT id, CASE WHEN exact THEN 'exact' ELSE 'substring' END AS match, CASE WHEN n_exact > 0 THEN greatest(1, n_real) ELSE n END AS n_candidates, array_to_string((CASE WHEN n_exact > 0 THEN defs ELSE others END)[1:3], ',') AS alternatives FROM r, a WHERE r = 1",
        "logical_neighbours": f"{_CONV}{_LOGICAL} SELECT * FROM logical",
        "degree_stats": "SELECT a AS id, count(*) FILTER (direction = 'out') AS outgoing, count(*) FILTER (direction = 'in') AS incoming FROM both_ways GROUP BY a",
        "components": ", r(id, component) USING KEY (id) AS (SELECT DISTINCT a, a FROM both_ways UNION SELECT w.b, min(r.component) FROM r JOIN both_ways w ON w.a = r.id JOIN recurring.r AS was ON was.id = w.b WHERE r.component < was.component GROUP BY w.b) SELECT * FROM r",
        "knn_query": f"{_VEC.format(n=10)} SELECT * FROM vec",
        "knn_self_top4": f"{_KNN.format(q='vecs')} SELECT a, b, dist FROM near WHERE rank <= 4",
        "demoted_search": _VEC.format(n=60) + ", ids AS (SELECT id FROM vec)" + _fused("SELECT id, 1.0 / (60 + row_number() OVER (ORDER BY dist, id) - 1) AS part FROM vec JOIN kept USING (id)"),
        "lexical_search": f"{_LEX.format(n=20)} SELECT * FROM lex",
        "hybrid_rrf": _VEC.format(n=60) + _LEX.format(n=60) + ", ids AS (SELECT id FROM vec UNION SELECT id FROM lex)" + _fused("SELECT id, CAST(1.0 AS DOUBLE) / (60 + row_number() OVER (ORDER BY dist, id) - 1) AS part FROM vec JOIN kept USING (id) UNION ALL SELECT id, CAST(0.4 AS DOUBLE) / (60 + row_number() OVER (ORDER BY score DESC, id) - 1) FROM lex JOIN kept USING (id)"),
        "similar_symbol": _SIMILAR,
        "dupe_pairs": f"{_PAIRS} SELECT *, jaccard >= 0.45 AS literal FROM pairs",
        "dupe_clusters": f"{_PAIRS}, c AS (SELECT a, b FROM pairs UNION SELECT b, a FROM pairs), r AS (SELECT a AS id, a AS o FROM c UNION SELECT c.b, o FROM r JOIN c ON c.a = r.id), comp AS (SELECT id, min(o) AS component FROM r GROUP BY id), st AS (SELECT component, min(dist) AS min_dist, max(dist) AS max_dist, max(jaccard) AS max_jaccard FROM pairs JOIN comp ON a = id GROUP BY 1), mem AS (SELECT component, count(*) AS size, count(DISTINCT lower({_BARE})) = 1 AS shared_name, bool_or({_INTERFACE}) AS i FROM comp JOIN nodes USING (id) GROUP BY 1) SELECT component, size, min_dist, max_dist, max_jaccard, max_jaccard >= 0.45 AS literal, shared_name, shared_name AND i AS contract, round(size * (1 + max_jaccard) / (min_dist + 0.005), 4) AS score FROM st JOIN mem USING (component)",
        "dist_histogram": f"{_KNN.format(q='vecs')} SELECT round((floor(dist / 0.02) + 1) * 0.02, 4) AS upper, count(*) AS n FROM near WHERE rank <= 4 GROUP BY 1",
        "eval_metrics": f"{_KNN.format(q='(SELECT * FROM vecs WHERE CAST(substr(id, 2) AS INT) % 50 = 0)')}, f AS (SELECT q.id, min(rank) AS r FROM vecs q JOIN vecs x ON q.kind = x.kind AND q.id <> x.id LEFT JOIN near ON a = q.id AND b = x.id AND rank <= 10 WHERE CAST(substr(q.id, 2) AS INT) % 50 = 0 GROUP BY 1) SELECT round(avg(CASE WHEN r <= 5 THEN 1.0 ELSE 0.0 END), 6) AS recall_5, round(avg(CASE WHEN r <= 10 THEN 1.0 ELSE 0.0 END), 6) AS recall_10, round(avg(CASE WHEN r <= 10 THEN 1.0 / r ELSE 0.0 END), 6) AS mrr_10, count(*) FILTER (r IS NULL) AS misses FROM f",
        "edge_load_dangling": ", known AS (SELECT id FROM nodes WHERE source_file <> '') SELECT relation, count(*) AS n FROM edges WHERE src IN (SELECT id FROM known) AND dst IN (SELECT id FROM known) GROUP BY 1",
        "node_text": "SELECT id, array_to_string(list_filter([label, file_type, translate(source_file, '/.', '  '), text], lambda x: x <> ''), ' | ') AS node_text FROM texts",
    }
    out = {k: _CTE + v for k, v in q.items()}
    lines = r"regexp_split_to_array(text, '\r\n|[\n\r\x0b\x0c\x1c-\x1e\x{85}\x{2028}\x{2029}]')"
    out["source_lines"] = f"WITH l AS (SELECT doc_id, CASE WHEN text = '' THEN [] WHEN {lines}[-1] = '' THEN {lines}[:-2] ELSE {lines} END AS l FROM documents) SELECT doc_id, len(l) AS n, coalesce(substr(trim(array_to_string(l[1:2], chr(10)), concat(' ', chr(9), chr(10), chr(11), chr(12), chr(13))), 1, 500), '') AS snippet FROM l"
    out["shingle_counts"] = f"SELECT doc_id, len({_SH}) AS n FROM (SELECT doc_id, {_TOKENS} AS t FROM documents)"
    out["literal_pairs"] = f"WITH s AS (SELECT doc_id AS id, {_SH} AS g FROM (SELECT doc_id, {_TOKENS} AS t FROM documents)), p AS (SELECT id, unnest(g) AS h FROM s), n AS (SELECT id, len(g) AS n FROM s), m AS (SELECT x.id AS a, y.id AS b, count(*) AS m FROM p x JOIN p y ON x.h = y.h AND x.id < y.id GROUP BY 1, 2) SELECT a, b, round(m / (na.n + nb.n - m), 6) AS jaccard FROM m JOIN n na ON na.id = a JOIN n nb ON nb.id = b WHERE m / (na.n + nb.n - m) >= 0.45"
    hashed = "sha1(concat('model-a', chr(0), {t}))"
    out["text_hash"] = "SELECT doc_id, " + hashed.format(t=r"regexp_replace(text, '[\x00-\x08\x0b\x0c\x0e-\x1f\x7f-\x{9f}]', '', 'g')") + " AS hash FROM documents"
    out["cache_hits_missing"] = f"WITH d AS (SELECT doc_id, {hashed.format(t='text')} AS hash FROM documents), c AS (SELECT DISTINCT hash FROM d WHERE doc_id IN (SELECT doc_id FROM labels)) SELECT count(*) FILTER (c.hash IS NOT NULL) AS reused, count(DISTINCT CASE WHEN c.hash IS NULL THEN d.hash END) AS missing FROM d LEFT JOIN c ON d.hash = c.hash"
    return out
