"""Queries of the graph, diffusion and analytics operators over all symbols and edges."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.functions import text as T
from millrace.operators import analytics as A
from millrace.operators import diffusion as D
from millrace.operators import graph as G

from .base import BOTH, COLLAPSED, EDGES, NODES, TRANSITION, case_weights, collapsed, edges, nodes, table


def seeds(spark: SparkSession, d: str) -> DataFrame:
    """(query, id, weight): of each repository the symbol with most outgoing edges, the smallest id among equals."""
    n = nodes(spark, d).select("id", "repo_id")
    out = edges(spark, d).groupBy(F.col("src").alias("id")).agg(F.count("*").alias("n"))
    j = n.join(out, "id").groupBy("repo_id").agg(F.max_by("id", F.struct("n", -F.col("id"))).alias("id"))
    return j.select(F.col("repo_id").alias("query"), "id", F.lit(1.0).alias("weight"))


def roots(spark: SparkSession, d: str) -> DataFrame:
    """Of each repository the symbol that most others use, the smallest id among equals."""
    n = nodes(spark, d).select("id", "repo_id")
    into = edges(spark, d).groupBy(F.col("dst").alias("id")).agg(F.count("*").alias("n"))
    return n.join(into, "id").groupBy("repo_id").agg(F.max_by("id", F.struct("n", -F.col("id"))).alias("id"))


def membership(spark: SparkSession, d: str) -> DataFrame:
    """A partition of the symbols by repository and subsystem of the path."""
    return nodes(spark, d).select("id", F.concat_ws(":", "repo_id", T.subsystem(F.col("file_path"))).alias("community"))


def transition(spark: SparkSession, d: str) -> DataFrame:
    return G.normalize_rows(collapsed(spark, d).where("weight > 0"))


def edge_merge(spark: SparkSession, d: str) -> DataFrame:
    return collapsed(spark, d).select("src", "dst", F.round("weight", 6).alias("weight"))


def row_normalize(spark: SparkSession, d: str) -> DataFrame:
    return transition(spark, d).select("src", "dst", F.round("weight", 6).alias("weight"))


def layer_mix_transition(spark: SparkSession, d: str) -> DataFrame:
    e = G.with_reverse_containment(edges(spark, d))
    return G.mix_layers(e, G.relation_weights("bugfix")).select("src", "dst", F.round("weight", 8).alias("weight"))


def transpose(spark: SparkSession, d: str) -> DataFrame:
    return G.transpose(collapsed(spark, d)).select("src", "dst", F.round("weight", 6).alias("weight"))


def degrees(spark: SparkSession, d: str) -> DataFrame:
    return G.degrees(edges(spark, d))


def layer_counts(spark: SparkSession, d: str) -> DataFrame:
    e = edges(spark, d)
    return e.groupBy("relation", G.relation_class(F.col("relation")).alias("relation_class")).agg(F.count("*").alias("edges"), F.countDistinct("src").alias("sources"), F.round(F.avg("weight"), 6).alias("mean_weight"))


def neighborhood(spark: SparkSession, d: str) -> DataFrame:
    n = G.neighborhood(edges(spark, d), seeds(spark, d), hops=2)
    return n.select("seed", "id", "relation", "direction", F.col("hop").cast("bigint").alias("hop"), F.round("weight", 6).alias("weight"))


def induced_subgraph(spark: SparkSession, d: str) -> DataFrame:
    """Edges among documented symbols."""
    return G.induced(edges(spark, d), nodes(spark, d).where("docstring is not null")).select("src", "dst", "relation", F.round("weight", 6).alias("weight"))


def symmetrize(spark: SparkSession, d: str) -> DataFrame:
    return G.symmetrize(edges(spark, d))


def graph_stats(spark: SparkSession, d: str) -> DataFrame:
    n = nodes(spark, d)
    out = edges(spark, d).groupBy(F.col("src").alias("id")).agg(F.count("*").alias("n"))
    return n.join(out, "id", "left").groupBy("kind").agg(F.count("*").alias("symbols"), F.sum("token_cost").alias("tokens"), F.round(F.avg(F.coalesce("n", F.lit(0))), 6).alias("out_degree"), F.count("docstring").alias("documented"))


def dense_reindex(spark: SparkSession, d: str) -> DataFrame:
    n = nodes(spark, d).select("id", "repo_id", "file_path")
    return G.dense_index(n, "repo_id", ["file_path", "id"]).select("id", "dense_id")


def _fixed(c: str):  # noqa: ANN202
    """Six digits; the offset keeps exact halves, whose last bit depends on the order of a sum, on one side."""
    return F.round(F.col(c) + 1e-10, 6).alias(c)


def ppr_steps(spark: SparkSession, d: str) -> DataFrame:
    s = D.ppr(transition(spark, d), seeds(spark, d), steps=4)
    return s.select("query", "id", _fixed("p").alias("p"), _fixed("r").alias("r"))


def ppr_push(spark: SparkSession, d: str) -> DataFrame:
    """Exact push from each repository's seed, a kernel per repository."""
    own = nodes(spark, d).select(F.col("id").alias("src"), F.col("repo_id").alias("query"))
    s = D.ppr_grouped(transition(spark, d).join(own, "src"), seeds(spark, d))
    return s.select("query", "id", _fixed("p"), _fixed("r"))


def ppr_task(spark: SparkSession, d: str) -> DataFrame:
    t = G.mix_layers(G.with_reverse_containment(edges(spark, d)), G.relation_weights("refactor"))
    return D.ppr(t, seeds(spark, d), steps=3).select("query", "id", _fixed("p").alias("p"))


def ppr_error_bound(spark: SparkSession, d: str) -> DataFrame:
    s = D.ppr(transition(spark, d), seeds(spark, d), steps=4)
    return D.error_bounds(s, collapsed(spark, d)).select("query", "id", _fixed("bound").alias("bound"))


def pagerank_uniform(spark: SparkSession, d: str) -> DataFrame:
    r = D.pagerank(transition(spark, d), nodes(spark, d), "repo_id", steps=5)
    return r.select("query", "id", F.round("p", 8).alias("p"))


def central_hubs(spark: SparkSession, d: str) -> DataFrame:
    """Fifteen hubs: in-degree and PageRank."""
    r = D.pagerank(transition(spark, d), nodes(spark, d), "repo_id", steps=5)
    into = collapsed(spark, d).groupBy(F.col("dst").alias("id")).agg(F.count("*").alias("in_degree"))
    x = r.join(into, "id", "left").select("id", F.coalesce("in_degree", F.lit(0)).alias("in_degree"), F.round(F.coalesce("in_degree", F.lit(0)) * 10 + F.col("p") * 1000, 4).alias("score"))
    return x.orderBy(F.desc("score"), "id").limit(15)


def community_boost(spark: SparkSession, d: str) -> DataFrame:
    s = D.ppr(transition(spark, d), seeds(spark, d), steps=3).select("query", "id", "p")
    m = membership(spark, d)
    own = seeds(spark, d).join(m, "id").select("query", "community").distinct()
    members = own.join(m, "community").select("query", "id")
    return D.boost(s, members, 0.5).select("query", "id", _fixed("p").alias("p"))


def evidence_kernel(spark: SparkSession, d: str) -> DataFrame:
    k = D.evidence_kernel(nodes(spark, d), edges(spark, d), G.relation_weights())
    return k.groupBy("src").agg(F.count("*").alias("targets"), F.round(F.sum("k"), 5).alias("mass"), F.round(F.max("k"), 5).alias("most"))


def prob_coverage(spark: SparkSession, d: str) -> DataFrame:
    """Coverage that the documented symbols of each repository give."""
    n = nodes(spark, d)
    k = D.evidence_kernel(n, edges(spark, d), G.relation_weights())
    chosen = n.where("docstring is not null").select(F.col("repo_id").alias("query"), "id")
    return D.coverage(k, chosen).select("query", F.round("coverage", 4).alias("coverage"))


def modularity_potts(spark: SparkSession, d: str) -> DataFrame:
    return A.modularity_potts(edges(spark, d), membership(spark, d)).select(F.round("modularity", 6).alias("modularity"))


def modularity_directed(spark: SparkSession, d: str) -> DataFrame:
    return A.modularity_directed(edges(spark, d), membership(spark, d)).select(F.round("modularity", 6).alias("modularity"))


def coupling_matrix(spark: SparkSession, d: str) -> DataFrame:
    return A.coupling(edges(spark, d), membership(spark, d))


def community_stats(spark: SparkSession, d: str) -> DataFrame:
    c = A.community_stats(nodes(spark, d), edges(spark, d), membership(spark, d))
    return c.withColumn("density", F.round("density", 6)).withColumn("purity", F.round("purity", 6))


def arch_drift(spark: SparkSession, d: str) -> DataFrame:
    m = nodes(spark, d).select("id", F.col("repo_id").cast("string").alias("community"))
    return A.drift(nodes(spark, d), edges(spark, d), m, least=0.05).withColumn("score", F.round("score", 6))


def layer_classify(spark: SparkSession, d: str) -> DataFrame:
    """Architectural layer of every subsystem of every repository."""
    n = nodes(spark, d).select("id", "repo_id", T.subsystem(F.col("file_path")).alias("s"), T.subsystem_folder(F.col("file_path")).alias("f"))
    e = edges(spark, d).select("src", "dst").distinct()
    j = e.join(n.select(F.col("id").alias("src"), F.col("repo_id"), F.col("s").alias("a")), "src").join(n.select(F.col("id").alias("dst"), F.col("s").alias("b")), "dst")
    out = j.groupBy("repo_id", F.col("a").alias("s")).agg(F.sum((F.col("a") != F.col("b")).cast("int")).alias("o"))
    into = j.groupBy("repo_id", F.col("b").alias("s")).agg(F.sum((F.col("a") != F.col("b")).cast("int")).alias("i"))
    base = n.groupBy("repo_id", "s").agg(F.min("f").alias("f"))
    x = base.join(out, ["repo_id", "s"], "left").join(into, ["repo_id", "s"], "left")
    z = lambda c: F.coalesce(c, F.lit(0))
    return x.select("repo_id", F.col("s").alias("subsystem"), T.layer(F.col("s"), F.col("f"), z("i"), z("o")).alias("layer"))


def impact_bfs(spark: SparkSession, d: str) -> DataFrame:
    return A.impact(edges(spark, d), roots(spark, d)).select("root", "id", F.col("depth").cast("bigint").alias("depth"))


def risk_level(spark: SparkSession, d: str) -> DataFrame:
    return A.impact_report(nodes(spark, d), edges(spark, d), roots(spark, d)).withColumn("risk_score", F.round("risk_score", 6))


def paths_topk(spark: SparkSession, d: str) -> DataFrame:
    e = G.with_reverse_containment(edges(spark, d))
    p = A.paths(e, seeds(spark, d), max_depth=3)
    return p.select("source", "target", F.array_join("path", ">").alias("path"), F.array_join("relations", ">").alias("relations"), F.round("score", 6).alias("score"))


def boltzmann_paths(spark: SparkSession, d: str) -> DataFrame:
    e = G.with_reverse_containment(edges(spark, d))
    p = A.paths(e, seeds(spark, d), max_depth=3)
    rel = nodes(spark, d).select("id", (F.col("token_cost") / 100.0).alias("relevance"))
    b = A.boltzmann(p, rel, G.relation_weights())
    return b.select("source", F.array_join("path", ">").alias("path"), F.array_join("relations", ">").alias("relations"), F.round("energy", 6).alias("energy"), F.round("probability", 6).alias("probability"))


def path_coverage(spark: SparkSession, d: str) -> DataFrame:
    """Coverage of each found path by the documented symbols: each node of a path of n covers 1 - 0.05^(1/n) of it."""
    e = G.with_reverse_containment(edges(spark, d))
    p = A.paths(e, seeds(spark, d), max_depth=2).select("source", "target", "path", "relations", F.size("path").alias("n"))
    k = 1 - F.pow(F.lit(0.05), 1.0 / F.col("n"))
    hit = p.select("source", "path", "relations", "n", F.explode("path").alias("id")).join(nodes(spark, d).where("docstring is not null").select("id"), "id")
    c = hit.groupBy("source", "path", "relations").agg((1 - F.exp(F.sum(F.ln(1 - k)))).alias("c"))
    return c.groupBy("source").agg(F.count("*").alias("paths"), F.round(F.sum("c"), 5).alias("coverage"))


def inspect(spark: SparkSession, d: str) -> DataFrame:
    """Card of each repository's seed: what it uses and what uses it."""
    n = nodes(spark, d).select("id", "name")
    t = transition(spark, d)
    s = seeds(spark, d).select(F.col("id").alias("symbol"))
    out = t.join(s, t["src"] == s["symbol"]).join(n, n["id"] == t["dst"]).select("symbol", F.lit("uses").alias("direction"), n["id"], n["name"], F.round("weight", 6).alias("probability"))
    into = t.join(s, t["dst"] == s["symbol"]).join(n, n["id"] == t["src"]).select("symbol", F.lit("used_by").alias("direction"), n["id"], n["name"], F.round("weight", 6).alias("probability"))
    return out.unionByName(into)


def resolve_refs(spark: SparkSession, d: str) -> DataFrame:
    """Targets of all imported names: in the file, in its folder for Go, by a unique name, else the nearest path."""
    from millrace.operators.resolve import resolve

    i = table(spark, d, "imports").where("imported_name is not null").select("repo_id", T.normalized_path(F.col("file_path")).alias("file_path"), F.col("imported_name").alias("ident")).distinct()
    s = nodes(spark, d).select("id", "repo_id", T.normalized_path(F.col("file_path")).alias("file_path"), "name")
    return resolve(i, s).select("repo_id", "file_path", "ident", "id", "confidence", F.col("priority").cast("bigint").alias("priority"))


def louvain(spark: SparkSession, d: str) -> DataFrame:
    return A.louvain(nodes(spark, d), edges(spark, d), "repo_id")


def louvain_hierarchy(spark: SparkSession, d: str) -> DataFrame:
    x = A.louvain(nodes(spark, d), edges(spark, d), "repo_id", (0.5, 1.0, 2.5))
    return x.groupBy("grp", "resolution").agg(F.countDistinct("community").alias("communities"))


def label_propagation(spark: SparkSession, d: str) -> DataFrame:
    return A.label_propagation(edges(spark, d), nodes(spark, d), rounds=5)


def topo_sort(spark: SparkSession, d: str) -> DataFrame:
    return A.topological_files(nodes(spark, d), edges(spark, d))


_SEEDS = "o AS (SELECT src AS id, count(*) AS k FROM e GROUP BY 1), s AS (SELECT repo_id AS query, id FROM (SELECT n.repo_id, o.id, row_number() OVER (PARTITION BY n.repo_id ORDER BY o.k DESC, o.id) AS rn FROM n JOIN o ON o.id = n.id) WHERE rn = 1)"
_ROOTS = "o AS (SELECT dst AS id, count(*) AS k FROM e GROUP BY 1), r AS (SELECT id FROM (SELECT n.repo_id, o.id, row_number() OVER (PARTITION BY n.repo_id ORDER BY o.k DESC, o.id) AS rn FROM n JOIN o ON o.id = n.id) WHERE rn = 1)"
_PARTS = "list_filter(string_split(regexp_replace(replace(file_path, '\\', '/'), '^(\\./)+', ''), '/'), lambda x: x <> '')"
_SUB = """CASE WHEN len(p) = 0 THEN 'root' WHEN len(p) >= 2 AND lower(p[1]) IN ('crates','packages','apps','services','modules') THEN p[1] || '-' || p[2]
 WHEN len(p) >= 2 AND lower(p[1]) IN ('src','app','lib','pkg') THEN p[2] WHEN len(p) >= 2 THEN p[1] ELSE 'core' END"""
_FOLDER = """CASE WHEN len(p) >= 2 AND lower(p[1]) IN ('crates','packages','apps','services','modules','src','app','lib','pkg') THEN p[1] || '/' || p[2] WHEN len(p) >= 2 THEN p[1] ELSE '.' END"""
_MEMBERS = f"mp AS (SELECT id, repo_id, {_PARTS} AS p FROM n), m AS (SELECT id, CAST(repo_id AS VARCHAR) || ':' || {_SUB} AS community FROM mp)"
_D = "regexp_replace(regexp_replace(replace(file_path, '\\', '/'), '^(\\./)+', ''), '/?[^/]*$', '')"
_COUPLE = "q AS (SELECT a.community AS src_community, b.community AS dst_community, count(*) AS n FROM (SELECT DISTINCT src, dst FROM e) e JOIN m a ON a.id = e.src JOIN m b ON b.id = e.dst GROUP BY 1, 2)"


def _ppr(k: int, transition_sql: str = "t", seeds_sql: str = "SELECT query, id, 1.0 AS r FROM s") -> str:
    out = [f"p0 AS (SELECT query, id, 0.0 AS p, CAST(r AS DOUBLE) AS r FROM ({seeds_sql}))"]
    for i in range(k):
        out.append(
            f"""p{i + 1} AS (SELECT query, id, sum(p) AS p, sum(r) AS r FROM (
            SELECT x.query, x.id, x.p + CASE WHEN g.src IS NULL THEN x.r ELSE 0.15 * x.r END AS p, 0.0 AS r FROM p{i} x LEFT JOIN (SELECT DISTINCT src FROM {transition_sql}) g ON g.src = x.id
            UNION ALL SELECT x.query, y.dst, 0.0, 0.85 * x.r * y.weight FROM p{i} x JOIN {transition_sql} y ON y.src = x.id) GROUP BY 1, 2)"""
        )
    return ", ".join(out)


def _mixed(task: str) -> str:
    return f"mx AS (SELECT src, dst, sum(weight * {case_weights(G.relation_weights(task))}) AS weight FROM b GROUP BY 1, 2), u AS (SELECT src, dst, weight / sum(weight) OVER (PARTITION BY src) AS weight FROM mx WHERE weight > 0)"


_HOPF = "CASE relation " + " ".join(f"WHEN '{k}' THEN {min(max(w / 2.0, 0.1), 1.0)}" for k, w in G.relation_weights().items()) + " END"
_GAIN = "CASE WHEN o.container_name IS NOT NULL AND o.container_name = t.container_name THEN 1.25 * 1.15 WHEN o.file_path = t.file_path THEN 1.25 ELSE 1.0 END"
_KERNEL = f"""h AS (SELECT src AS a, dst AS b, max({_HOPF}) AS f FROM e GROUP BY 1, 2),
 k1 AS (SELECT h.a AS src, h.b AS dst, least(exp(-0.5) * h.f * {_GAIN}, 1.0) AS k FROM h JOIN n o ON o.id = h.a JOIN n t ON t.id = h.b),
 k2 AS (SELECT k1.src, h.b AS dst, least(k1.k * exp(-0.5) * h.f * {_GAIN}, 1.0) AS k FROM k1 JOIN h ON h.a = k1.dst JOIN n o ON o.id = k1.src JOIN n t ON t.id = h.b WHERE k1.k >= 1e-4 AND k1.src <> h.b),
 kk AS (SELECT src, dst, max(k) AS k FROM (SELECT * FROM k1 WHERE k >= 1e-4 UNION ALL SELECT * FROM k2 WHERE k >= 1e-4 UNION ALL SELECT id, id, 1.0 FROM n) GROUP BY 1, 2)"""


def _paths(depth: int) -> str:
    rel = ", ".join(f"'{r}'" for r in A.PATH_RELATIONS)
    out = [f"pe AS (SELECT * FROM b WHERE relation IN ({rel}) AND weight >= 0.05)", "w0 AS (SELECT id AS source, id AS target, [id] AS path, CAST([] AS VARCHAR[]) AS relations, CAST([] AS DOUBLE[]) AS weights, 0.0::DOUBLE AS score FROM s)"]
    for i in range(depth):
        out.append(
            f"w{i + 1} AS (SELECT x.source, pe.dst AS target, list_append(x.path, pe.dst) AS path, list_append(x.relations, pe.relation) AS relations, list_append(x.weights, pe.weight) AS weights, x.score + pe.weight - 0.10 AS score FROM w{i} x JOIN pe ON pe.src = x.target WHERE NOT list_contains(x.path, pe.dst))"
        )
    union = " UNION ALL ".join(f"SELECT * FROM w{i + 1}" for i in range(depth))
    order = "score DESC, len(relations), path, relations"
    out.append(f"wa AS (SELECT source, target, path, relations, weights, round(score, 9) AS score FROM ({union}))")
    out.append(f"wb AS (SELECT *, row_number() OVER (PARTITION BY source, target ORDER BY {order}) AS rn FROM wa)")
    out.append(f"wc AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY source ORDER BY {order}) AS rm FROM wb WHERE rn <= 3) WHERE rm <= 50)")
    return ", ".join(out)


_BFS = """back AS (SELECT DISTINCT dst AS at, src AS id FROM e), bfs AS (
 WITH RECURSIVE z(root, id, depth) AS (SELECT id, id, 0 FROM r UNION SELECT z.root, back.id, z.depth + 1 FROM z JOIN back ON back.at = z.id WHERE z.depth < 8) SELECT root, id, min(depth) AS depth FROM z GROUP BY 1, 2 HAVING min(depth) > 0)"""
_TEST = """(regexp_matches(lower(replace(file_path, '\\', '/')), '(^|/)tests/|test_|_test\\.(rs|go)$|\\.(test|spec)\\.(ts|tsx|js)$') OR regexp_matches(lower(name), '^test_|_test$') OR starts_with(name, 'Test') OR regexp_matches(concat_ws(' ', signature, docstring), '#\\[(tokio::)?test\\]'))"""

_ROUNDS = "".join(
    f", l{i + 1} AS (SELECT id, lab FROM (SELECT id, lab, row_number() OVER (PARTITION BY id ORDER BY sum(w) DESC, lab) AS rn FROM (SELECT y.id, l{i}.lab, y.w FROM y JOIN l{i} ON l{i}.id = y.near UNION ALL SELECT id, lab, 1.0 FROM l{i}) GROUP BY 1, 2) WHERE rn = 1)"
    for i in range(5)
)

QUERIES = {
    f.__name__: f
    for f in (edge_merge, row_normalize, layer_mix_transition, transpose, degrees, layer_counts, neighborhood, induced_subgraph, symmetrize, graph_stats, dense_reindex, ppr_steps, ppr_push, ppr_task, ppr_error_bound, pagerank_uniform, central_hubs, community_boost, evidence_kernel, prob_coverage,
              modularity_potts, modularity_directed, coupling_matrix, community_stats, arch_drift, layer_classify, impact_bfs, risk_level, paths_topk, boltzmann_paths, path_coverage, inspect, resolve_refs, louvain, louvain_hierarchy, label_propagation, topo_sort)
}

ORACLES = {
    "edge_merge": f"WITH {COLLAPSED} SELECT src, dst, round(weight, 6) AS weight FROM c",
    "row_normalize": f"WITH {TRANSITION} SELECT src, dst, round(weight, 6) AS weight FROM t",
    "layer_mix_transition": f"WITH {BOTH}, {_mixed('bugfix')} SELECT src, dst, round(weight, 8) AS weight FROM u",
    "transpose": f"WITH {COLLAPSED} SELECT dst AS src, src AS dst, round(weight, 6) AS weight FROM c",
    "degrees": f"WITH {EDGES}, x AS (SELECT src AS id, 1 AS o, 0 AS i FROM e UNION ALL SELECT dst, 0, 1 FROM e) SELECT id, CAST(sum(o) AS BIGINT) AS out_degree, CAST(sum(i) AS BIGINT) AS in_degree, count(*) AS degree FROM x GROUP BY 1",
    "layer_counts": f"WITH {EDGES} SELECT relation, CASE relation " + " ".join(f"WHEN '{k}' THEN '{c}'" for k, (_, c) in G.RELATIONS.items()) + " END AS relation_class, count(*) AS edges, count(DISTINCT src) AS sources, round(avg(weight), 6) AS mean_weight FROM e GROUP BY 1, 2",
    "neighborhood": f"""WITH {NODES}, {EDGES}, {_SEEDS}, one AS (SELECT s.id AS seed, e.dst AS id, relation, 'out' AS direction, 1 AS hop, weight FROM e JOIN s ON s.id = e.src
        UNION ALL SELECT s.id, e.src, relation, 'in', 1, weight FROM e JOIN s ON s.id = e.dst), f AS (SELECT DISTINCT seed, id FROM one),
        two AS (SELECT f.seed, e.dst AS id, e.relation, max(e.weight * 0.5) AS weight FROM f JOIN e ON e.src = f.id WHERE e.dst <> f.seed GROUP BY 1, 2, 3)
        SELECT seed, id, relation, direction, CAST(hop AS BIGINT) AS hop, round(weight, 6) AS weight FROM one UNION ALL SELECT t.seed, t.id, t.relation, 'out', 2, round(t.weight, 6) FROM two t LEFT JOIN f ON f.seed = t.seed AND f.id = t.id WHERE f.id IS NULL""",
    "induced_subgraph": f"WITH {NODES}, {EDGES}, d AS (SELECT id FROM n WHERE docstring IS NOT NULL) SELECT src, dst, relation, round(weight, 6) AS weight FROM e WHERE src IN (SELECT id FROM d) AND dst IN (SELECT id FROM d)",
    "symmetrize": f"WITH {EDGES} SELECT least(src, dst) AS a, greatest(src, dst) AS b, CAST(count(*) AS DOUBLE) AS weight FROM e GROUP BY 1, 2",
    "graph_stats": f"WITH {NODES}, {EDGES}, o AS (SELECT src AS id, count(*) AS k FROM e GROUP BY 1) SELECT kind, count(*) AS symbols, CAST(sum(token_cost) AS BIGINT) AS tokens, round(avg(coalesce(k, 0)), 6) AS out_degree, count(docstring) AS documented FROM n LEFT JOIN o ON o.id = n.id GROUP BY 1",
    "dense_reindex": f"WITH {NODES} SELECT id, row_number() OVER (ORDER BY repo_id, file_path, id) - 1 AS dense_id FROM n",
    "ppr_steps": f"WITH {NODES}, {TRANSITION}, {_SEEDS}, {_ppr(4)} SELECT query, id, round(p + 1e-10, 6) AS p, round(r + 1e-10, 6) AS r FROM p4",
    "ppr_task": f"WITH {NODES}, {BOTH}, {_mixed('refactor')}, {_SEEDS}, {_ppr(3, 'u')} SELECT query, id, round(p + 1e-10, 6) AS p FROM p3",
    "ppr_error_bound": f"""WITH {NODES}, {TRANSITION}, {_SEEDS}, {_ppr(4)}, wo AS (SELECT query, max(r) AS worst FROM p4 GROUP BY 1), ind AS (SELECT dst AS id, count(*) AS k FROM c GROUP BY 1)
        SELECT p4.query, p4.id, round(greatest(1e-4, worst) / 0.15 * greatest(coalesce(k, 0), 1) + 1e-10, 6) AS bound FROM p4 JOIN wo ON wo.query = p4.query LEFT JOIN ind ON ind.id = p4.id""",
    "pagerank_uniform": f"WITH {NODES}, {TRANSITION}, {_ppr(5, 't', 'SELECT repo_id AS query, id, 1.0 / count(*) OVER (PARTITION BY repo_id) AS r FROM n')} SELECT query, id, round(p, 8) AS p FROM p5",
    "central_hubs": f"""WITH {NODES}, {TRANSITION}, {_ppr(5, 't', 'SELECT repo_id AS query, id, 1.0 / count(*) OVER (PARTITION BY repo_id) AS r FROM n')}, ind AS (SELECT dst AS id, count(*) AS k FROM c GROUP BY 1)
        SELECT p5.id, coalesce(k, 0) AS in_degree, round(coalesce(k, 0) * 10 + p * 1000, 4) AS score FROM p5 LEFT JOIN ind ON ind.id = p5.id ORDER BY score DESC, p5.id LIMIT 15""",
    "community_boost": f"""WITH {NODES}, {TRANSITION}, {_SEEDS}, {_MEMBERS}, {_ppr(3)}, own AS (SELECT DISTINCT s.query, m.community FROM s JOIN m ON m.id = s.id), mem AS (SELECT DISTINCT own.query, m.id FROM own JOIN m ON m.community = own.community)
        SELECT p3.query, p3.id, round(CASE WHEN mem.id IS NULL THEN p ELSE p * 1.5 END + 1e-10, 6) AS p FROM p3 LEFT JOIN mem ON mem.query = p3.query AND mem.id = p3.id""",
    "evidence_kernel": f"WITH {NODES}, {EDGES}, {_KERNEL} SELECT src, count(*) AS targets, round(sum(k), 5) AS mass, round(max(k), 5) AS most FROM kk GROUP BY 1",
    "prob_coverage": f"""WITH {NODES}, {EDGES}, {_KERNEL}, x AS (SELECT n.repo_id AS query, kk.dst, 1 - exp(sum(ln(1 - least(kk.k, 1 - 1e-7)))) AS c FROM kk JOIN n ON n.id = kk.src WHERE n.docstring IS NOT NULL GROUP BY 1, 2)
        SELECT query, round(sum(c), 4) AS coverage FROM x GROUP BY 1""",
    "modularity_potts": f"WITH {NODES}, {EDGES}, {_MEMBERS}, {_COUPLE}, tot AS (SELECT sum(n) AS mm FROM q), pc AS (SELECT src_community AS c, sum(n) AS k, sum(CASE WHEN src_community = dst_community THEN n ELSE 0 END) AS inside FROM q GROUP BY 1) SELECT round(sum(inside / mm - (k / (2 * mm)) * (k / (2 * mm))), 6) AS modularity FROM pc, tot",
    "modularity_directed": f"""WITH {NODES}, {EDGES}, {_MEMBERS}, {_COUPLE}, tot AS (SELECT sum(n) AS mm FROM q), po AS (SELECT src_community AS c, sum(n) AS k, sum(CASE WHEN src_community = dst_community THEN n ELSE 0 END) AS inside FROM q GROUP BY 1), pi AS (SELECT dst_community AS c, sum(n) AS k FROM q GROUP BY 1)
        SELECT round(sum(coalesce(po.inside, 0) / mm - coalesce(po.k, 0) * coalesce(pi.k, 0) / (mm * mm)), 6) AS modularity FROM po FULL JOIN pi ON po.c = pi.c, tot""",
    "coupling_matrix": f"WITH {NODES}, {EDGES}, {_MEMBERS}, {_COUPLE} SELECT * FROM q",
    "community_stats": f"""WITH {NODES}, {EDGES}, {_MEMBERS}, {_COUPLE}, x AS (SELECT m.community, n.id, n.name, n.token_cost, {_D} AS folder FROM n JOIN m ON m.id = n.id),
        base AS (SELECT community, count(*) AS symbols, CAST(sum(token_cost) AS BIGINT) AS tokens FROM x GROUP BY 1), cc AS (SELECT src_community AS community, sum(n) AS incident, sum(CASE WHEN src_community = dst_community THEN n ELSE 0 END) AS internal FROM q GROUP BY 1),
        dom AS (SELECT community, folder, k FROM (SELECT community, folder, count(*) AS k, row_number() OVER (PARTITION BY community ORDER BY count(*) DESC, hex(folder) DESC) AS rn FROM x GROUP BY 1, 2) WHERE rn = 1),
        od AS (SELECT src AS id, count(*) AS k FROM (SELECT DISTINCT src, dst FROM e) GROUP BY 1), ld AS (SELECT community, name FROM (SELECT x.community, x.name, row_number() OVER (PARTITION BY x.community ORDER BY coalesce(od.k, 0) DESC, x.id) AS rn FROM x LEFT JOIN od ON od.id = x.id) WHERE rn = 1)
        SELECT base.community, symbols, tokens, CAST(coalesce(internal, 0) AS BIGINT) AS internal, CAST(coalesce(incident, 0) AS BIGINT) AS incident, round(CASE WHEN symbols <= 1 THEN 1.0 ELSE least(coalesce(internal, 0) / (symbols * (symbols - 1)), 1.0) END, 6) AS density,
        dom.folder AS dominant, round(dom.k / symbols, 6) AS purity, ld.name AS lead FROM base LEFT JOIN cc USING (community) JOIN dom USING (community) JOIN ld USING (community)""",
    "arch_drift": f"""WITH {NODES}, {EDGES}, x AS (SELECT id, CAST(repo_id AS VARCHAR) AS community, {_D} AS folder FROM n),
        dom AS (SELECT community, folder AS dominant FROM (SELECT community, folder, row_number() OVER (PARTITION BY community ORDER BY count(*) DESC, hex(folder) DESC) AS rn FROM x GROUP BY 1, 2) WHERE rn = 1),
        st AS (SELECT x.*, dom.dominant FROM x JOIN dom USING (community) WHERE folder <> dominant AND folder <> '' AND dominant <> ''),
        j AS (SELECT st.id, st.community, st.dominant, count(*) AS degree, sum(CASE WHEN y.folder = st.dominant THEN 1 ELSE 0 END) AS hit FROM st JOIN (SELECT DISTINCT src, dst FROM e) e ON e.src = st.id JOIN x y ON y.id = e.dst GROUP BY 1, 2, 3)
        SELECT id, community, dominant, round(hit / degree, 6) AS score FROM j WHERE degree >= 2 AND hit / degree >= 0.05""",
    "layer_classify": f"""WITH {NODES}, {EDGES}, x0 AS (SELECT id, repo_id, {_PARTS} AS p FROM n), x AS (SELECT id, repo_id, {_SUB} AS s, {_FOLDER} AS f FROM x0),
        j AS (SELECT a.repo_id, a.s AS a, b.s AS b FROM (SELECT DISTINCT src, dst FROM e) e JOIN x a ON a.id = e.src JOIN x b ON b.id = e.dst),
        o AS (SELECT repo_id, a AS s, sum(CASE WHEN a <> b THEN 1 ELSE 0 END) AS o FROM j GROUP BY 1, 2), i AS (SELECT repo_id, b AS s, sum(CASE WHEN a <> b THEN 1 ELSE 0 END) AS i FROM j GROUP BY 1, 2),
        base AS (SELECT repo_id, s, min(f) AS f FROM x GROUP BY 1, 2), z AS (SELECT base.repo_id, base.s, base.f, coalesce(i.i, 0) AS i, coalesce(o.o, 0) AS o FROM base LEFT JOIN o USING (repo_id, s) LEFT JOIN i USING (repo_id, s))
        SELECT repo_id, s AS subsystem, CASE """
    + " ".join(f"WHEN regexp_matches(lower(s), '{'|'.join(a)}') OR regexp_matches(lower(f), '{'|'.join(b)}') THEN '{k}'" for k, a, b in T.LAYER_KEYWORDS)
    + " WHEN o > 0 AND i = 0 THEN 'Presentation' WHEN i > 0 AND o = 0 THEN 'Core' ELSE 'Domain' END AS layer FROM z",
    "impact_bfs": f"WITH {NODES}, {EDGES}, {_ROOTS}, {_BFS} SELECT root, id, CAST(depth AS BIGINT) AS depth FROM bfs",
    "risk_level": f"""WITH {NODES}, {EDGES}, {_ROOTS}, {_BFS}, x AS (SELECT id, file_path, {_TEST} AS t FROM n), own AS (SELECT r.id AS root, x.file_path AS own_file FROM r JOIN x ON x.id = r.id),
        a AS (SELECT bfs.root, sum(CASE WHEN depth = 1 AND NOT t THEN 1 ELSE 0 END) AS direct, sum(CASE WHEN depth > 1 AND NOT t THEN 1 ELSE 0 END) AS trans, sum(CASE WHEN t THEN 1 ELSE 0 END) AS tests, count(DISTINCT CASE WHEN x.file_path <> own_file THEN x.file_path END) + 1 AS files
        FROM bfs JOIN x ON x.id = bfs.id JOIN own ON own.root = bfs.root GROUP BY 1), ind AS (SELECT dst AS root, count(*) AS k FROM (SELECT DISTINCT src, dst FROM e) GROUP BY 1),
        z AS (SELECT own.root, CAST(coalesce(direct, 0) AS BIGINT) AS direct, CAST(coalesce(trans, 0) AS BIGINT) AS transitive, CAST(coalesce(tests, 0) AS BIGINT) AS tests, CAST(coalesce(files, 1) AS BIGINT) AS files, CAST(coalesce(k, 0) AS BIGINT) AS in_degree FROM own LEFT JOIN a USING (root) LEFT JOIN ind USING (root)),
        y AS (SELECT *, least(greatest((direct * 0.15 + transitive * 0.05 + in_degree * 0.10 + files * 0.10) / 3.0, 0.0), 1.0) AS sc FROM z)
        SELECT root, direct, transitive, tests, files, in_degree, round(CAST(sc AS DOUBLE), 6) AS risk_score, CASE WHEN in_degree >= 15 OR sc >= 0.75 THEN 'CRITICAL' WHEN transitive >= 10 OR files >= 3 OR sc >= 0.5 THEN 'HIGH' WHEN direct >= 1 OR sc >= 0.25 THEN 'MEDIUM' ELSE 'LOW' END AS risk_level FROM y""",
    "paths_topk": f"WITH {NODES}, {BOTH}, {_SEEDS}, {_paths(3)} SELECT source, target, array_to_string(path, '>') AS path, array_to_string(relations, '>') AS relations, round(score, 6) AS score FROM wc",
    "boltzmann_paths": f"""WITH {NODES}, {BOTH}, {_SEEDS}, {_paths(3)}, kx AS (SELECT *, row_number() OVER () AS pid FROM wc), nr AS (SELECT pid, sum(n.token_cost / 100.0) AS nodes FROM (SELECT pid, unnest(path) AS id FROM kx) y JOIN n ON n.id = y.id GROUP BY 1),
        er AS (SELECT pid, sum(w * {case_weights(G.relation_weights(), 'r')}) AS edge FROM (SELECT pid, unnest(relations) AS r, unnest(weights) AS w FROM kx) GROUP BY 1),
        en AS (SELECT source, path, relations, nodes + edge - 0.25 * len(relations) AS energy FROM kx JOIN nr USING (pid) JOIN er USING (pid)), ez AS (SELECT *, exp(energy - max(energy) OVER (PARTITION BY source)) AS z FROM en)
        SELECT source, array_to_string(path, '>') AS path, array_to_string(relations, '>') AS relations, round(energy, 6) AS energy, round(z / sum(z) OVER (PARTITION BY source), 6) AS probability FROM ez""",
    "path_coverage": f"""WITH {NODES}, {BOTH}, {_SEEDS}, {_paths(2)}, kx AS (SELECT *, row_number() OVER () AS pid FROM wc), y AS (SELECT source, pid, len(path) AS k, unnest(path) AS id FROM kx),
        z AS (SELECT source, pid, 1 - exp(sum(ln(power(0.05, 1.0 / k)))) AS c FROM y JOIN n ON n.id = y.id WHERE n.docstring IS NOT NULL GROUP BY 1, 2) SELECT source, count(*) AS paths, round(sum(c), 5) AS coverage FROM z GROUP BY 1""",
    "inspect": f"""WITH {NODES}, {TRANSITION}, {_SEEDS} SELECT s.id AS symbol, 'uses' AS direction, n.id, n.name, round(weight, 6) AS probability FROM t JOIN s ON s.id = t.src JOIN n ON n.id = t.dst
        UNION ALL SELECT s.id, 'used_by', n.id, n.name, round(weight, 6) FROM t JOIN s ON s.id = t.dst JOIN n ON n.id = t.src""",
    "resolve_refs": """WITH i AS (SELECT DISTINCT repo_id, regexp_replace(replace(file_path, '\\', '/'), '^(\\./)+', '') AS file_path, imported_name AS ident FROM imports WHERE imported_name IS NOT NULL),
        s AS (SELECT DISTINCT id, repo_id, regexp_replace(replace(file_path, '\\', '/'), '^(\\./)+', '') AS sp, name FROM symbols), cnt AS (SELECT repo_id, name, count(*) AS k FROM s GROUP BY 1, 2),
        j AS (SELECT i.*, s.id, s.sp, cnt.k, string_split(i.file_path, '/') AS x, string_split(s.sp, '/') AS y, regexp_replace(i.file_path, '/?[^/]*$', '') = regexp_replace(s.sp, '/?[^/]*$', '') AS same_dir FROM i JOIN s ON s.repo_id = i.repo_id AND s.name = i.ident JOIN cnt ON cnt.repo_id = s.repo_id AND cnt.name = s.name),
        d AS (SELECT *, CASE WHEN file_path = sp THEN 0 WHEN same_dir THEN 1 ELSE len(x) + len(y) - 2 * coalesce(list_position(list_transform(range(1, least(len(x), len(y)) + 1), lambda q: x[q] = y[q]), false) - 1, least(len(x), len(y))) END AS dist FROM j),
        c AS (SELECT *, CASE WHEN file_path = sp THEN 3 WHEN same_dir AND ends_with(file_path, '.go') AND ends_with(sp, '.go') THEN 4 WHEN k = 1 THEN 6 ELSE 8 END AS priority, CAST(CASE WHEN file_path = sp THEN 1.0 WHEN same_dir AND ends_with(file_path, '.go') AND ends_with(sp, '.go') THEN 1.0 WHEN dist = 1 THEN 0.85 WHEN dist = 2 THEN 0.6 ELSE 0.3 END AS DOUBLE) AS confidence FROM d)
        SELECT repo_id, file_path, ident, id, confidence, CAST(priority AS BIGINT) AS priority FROM (SELECT *, row_number() OVER (PARTITION BY repo_id, file_path, ident ORDER BY priority, confidence DESC, id) AS rn FROM c) WHERE rn = 1""",
    "label_propagation": f"""WITH {NODES}, {EDGES}, u AS (SELECT least(src, dst) AS a, greatest(src, dst) AS b, CAST(count(*) AS DOUBLE) AS w FROM e GROUP BY 1, 2), y AS (SELECT a AS id, b AS near, w FROM u UNION ALL SELECT b, a, w FROM u), l0 AS (SELECT id, id AS lab FROM n){_ROUNDS} SELECT id, lab AS community FROM l5""",
}
