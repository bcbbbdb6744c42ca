"""Communities, coupling, impact and paths over graphs."""

from __future__ import annotations


import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from millrace.functions import text as T

from . import graph
from .checkpoints import materialize


def folder(c: str = "file_path"):  # noqa: ANN201
    return F.regexp_replace(T.normalized_path(F.col(c)), "/?[^/]*$", "")


def modularity_potts(edges: DataFrame, membership: DataFrame, resolution: float = 1.0, textbook: bool = False) -> DataFrame:
    """(modularity) of a partition: internal share less the squared share of outgoing ends (of all ends if `textbook`)."""
    s = membership.select(F.col("id").alias("src"), F.col("community").alias("cs"))
    d = membership.select(F.col("id").alias("dst"), F.col("community").alias("cd"))
    j = edges.select("src", "dst").distinct().join(s, "src").join(d, "dst")
    m = j.agg(F.count("*").alias("m"))
    inside = (F.col("cs") == F.col("cd")).cast("int")
    per = j.groupBy(F.col("cs").alias("c")).agg(F.sum(inside).alias("inside"), F.count("*").alias("k"))
    if textbook:
        per_in = j.groupBy(F.col("cd").alias("c")).agg(F.count("*").alias("ki"))
        per = per.join(per_in, "c", "full").select("c", F.coalesce("inside", F.lit(0)).alias("inside"), (F.coalesce("k", F.lit(0)) + F.coalesce("ki", F.lit(0))).alias("k"))
    share = F.col("k") / (2 * F.col("m"))
    return per.join(F.broadcast(m)).agg(F.sum(F.col("inside") / F.col("m") - resolution * share * share).alias("modularity"))  # one row on the right


def modularity_directed(edges: DataFrame, membership: DataFrame, resolution: float = 1.0) -> DataFrame:
    c = coupling(edges, membership)
    m = c.agg(F.sum("n").alias("m"))
    out = c.groupBy(F.col("src_community").alias("c")).agg(F.sum("n").alias("k_out"), F.sum(F.when(F.col("src_community") == F.col("dst_community"), F.col("n")).otherwise(0)).alias("inside"))
    into = c.groupBy(F.col("dst_community").alias("c")).agg(F.sum("n").alias("k_in"))
    j = out.join(into, "c", "full").join(F.broadcast(m))  # one row on the right
    z = lambda x: F.coalesce(x, F.lit(0))
    return j.agg(F.sum(z("inside") / F.col("m") - resolution * z("k_out") * z("k_in") / (F.col("m") * F.col("m"))).alias("modularity"))


def coupling(edges: DataFrame, membership: DataFrame) -> DataFrame:
    """(src_community, dst_community, n): edges between and within communities."""
    s = membership.select(F.col("id").alias("src"), F.col("community").alias("src_community"))
    d = membership.select(F.col("id").alias("dst"), F.col("community").alias("dst_community"))
    return edges.select("src", "dst").distinct().join(s, "src").join(d, "dst").groupBy("src_community", "dst_community").agg(F.count("*").alias("n"))


def community_stats(nodes: DataFrame, edges: DataFrame, membership: DataFrame) -> DataFrame:
    """Size, tokens, internal and incident edges, density, dominant folder, purity and leading symbol of each community."""
    n = nodes.join(membership, "id").withColumn("folder", folder())
    e = edges.select("src", "dst").distinct()
    outd = e.groupBy(F.col("src").alias("id")).agg(F.count("*").alias("out"))
    base = n.groupBy("community").agg(F.count("*").alias("symbols"), F.sum("token_cost").alias("tokens"))
    c = coupling(edges, membership).groupBy(F.col("src_community").alias("community")).agg(F.sum(F.when(F.col("src_community") == F.col("dst_community"), F.col("n")).otherwise(0)).alias("internal"), F.sum("n").alias("incident"))
    per_folder = n.groupBy("community", "folder").agg(F.count("*").alias("k"))
    dominant = per_folder.groupBy("community").agg(F.max_by(F.struct("folder", "k"), F.struct("k", F.hex("folder"))).alias("d"))
    lead = n.join(outd, "id", "left").groupBy("community").agg(F.max_by("name", F.struct(F.coalesce("out", F.lit(0)), -F.col("id"))).alias("lead"))
    j = base.join(c, "community", "left").join(dominant, "community").join(lead, "community")
    internal = F.coalesce("internal", F.lit(0))
    density = F.when(F.col("symbols") <= 1, 1.0).otherwise(F.least(internal / (F.col("symbols") * (F.col("symbols") - 1)), F.lit(1.0)))
    return j.select("community", "symbols", "tokens", internal.alias("internal"), F.coalesce("incident", F.lit(0)).alias("incident"), density.alias("density"), F.col("d.folder").alias("dominant"), (F.col("d.k") / F.col("symbols")).alias("purity"), "lead")


def drift(nodes: DataFrame, edges: DataFrame, membership: DataFrame, least: float = 0.4, min_degree: int = 2) -> DataFrame:
    """(id, community, dominant, score) of nodes that live outside their community's folder but mostly call into it."""
    n = nodes.join(membership, "id").withColumn("folder", folder()).select("id", "community", "folder")
    per = n.groupBy("community", "folder").agg(F.count("*").alias("k"))
    dominant = per.groupBy("community").agg(F.max_by("folder", F.struct("k", F.hex("folder"))).alias("dominant"))
    strays = n.join(dominant, "community").where("folder <> dominant and folder <> '' and dominant <> ''")
    e = edges.select("src", "dst").distinct().join(n.select(F.col("id").alias("dst"), F.col("folder").alias("to")), "dst")
    j = strays.join(e, strays["id"] == e["src"]).groupBy("id", "community", "dominant").agg(F.count("*").alias("degree"), F.sum((F.col("to") == F.col("dominant")).cast("int")).alias("into"))
    return j.where(F.col("degree") >= min_degree).withColumn("score", F.col("into") / F.col("degree")).where(F.col("score") >= least).select("id", "community", "dominant", "score")


def impact(edges: DataFrame, roots: DataFrame, max_depth: int = 9) -> DataFrame:
    """(root, id, depth) of everything that depends on a root, level by level against the edges; depth 1 are the callers.

    `roots` (id), or (root, id) where several nodes are changed together under one name.
    """
    back = edges.select(F.col("dst").alias("at"), F.col("src").alias("id")).distinct()
    seen = roots.select(F.col("root" if "root" in roots.columns else "id").alias("root"), "id", F.lit(0).alias("depth")).distinct()
    frontier = seen
    for depth in range(1, max_depth):
        nxt = frontier.select("root", F.col("id").alias("at")).join(back, "at").select("root", "id").distinct().join(seen, ["root", "id"], "left_anti")
        frontier = materialize(nxt.withColumn("depth", F.lit(depth)))
        if frontier.isEmpty():
            break
        seen = seen.unionByName(frontier)
    return seen.where("depth > 0")


def risk(direct, transitive, in_degree, files):  # noqa: ANN001, ANN201 - columns
    """(score, level) columns of a change."""
    score = F.least(F.greatest((direct * 0.15 + transitive * 0.05 + in_degree * 0.10 + files * 0.10) / 3.0, F.lit(0.0)), F.lit(1.0))
    level = F.when((in_degree >= 15) | (score >= 0.75), "CRITICAL").when((transitive >= 10) | (files >= 3) | (score >= 0.5), "HIGH").when((direct >= 1) | (score >= 0.25), "MEDIUM").otherwise("LOW")
    return score, level


def impact_report(nodes: DataFrame, edges: DataFrame, roots: DataFrame) -> DataFrame:
    """One row per changed symbol: direct and transitive dependents, tests, files, risk."""
    n = nodes.select("id", "file_path", T.is_test(F.col("name"), F.col("file_path"), F.col("signature"), F.col("docstring")).alias("is_test"))
    hit = impact(edges, roots).join(n, "id")
    own = roots.select(F.col("id").alias("root")).distinct().join(n.select(F.col("id").alias("root"), F.col("file_path").alias("own_file")), "root")
    indeg = edges.select("src", "dst").distinct().groupBy(F.col("dst").alias("root")).agg(F.count("*").alias("in_degree"))
    agg = hit.join(own, "root").groupBy("root").agg(
        F.sum(((F.col("depth") == 1) & ~F.col("is_test")).cast("int")).alias("direct"),
        F.sum(((F.col("depth") > 1) & ~F.col("is_test")).cast("int")).alias("transitive"),
        F.sum(F.col("is_test").cast("int")).alias("tests"),
        (F.countDistinct(F.when(F.col("file_path") != F.col("own_file"), F.col("file_path"))) + 1).alias("files"),
    )
    z = lambda c, v=0: F.coalesce(c, F.lit(v)).cast("bigint")
    j = own.select("root").join(agg, "root", "left").join(indeg, "root", "left").select("root", z("direct").alias("direct"), z("transitive").alias("transitive"), z("tests").alias("tests"), z("files", 1).alias("files"), z("in_degree").alias("in_degree"))
    score, level = risk(F.col("direct"), F.col("transitive"), F.col("in_degree"), F.col("files"))
    return j.select("*", score.alias("risk_score"), level.alias("risk_level"))


PATH_RELATIONS = ("Calls", "References", "Inherits", "Implements", "Contains", "BelongsTo", "IsTestedBy", "Reads", "Writes", "CoChangesWith")


def paths(edges: DataFrame, sources: DataFrame, max_depth: int = 4, per_target: int = 3, total: int = 50, min_weight: float = 0.05, relations: tuple[str, ...] = PATH_RELATIONS) -> DataFrame:
    """(source, target, path, relations, weights, score, hops): the best loop-free paths from each source.

    Depth by depth join; at most `per_target` paths of a target and `total` of a
    source are reported, best score first, shorter paths and smaller ids first among equals.
    """
    e = edges.where(F.col("relation").isin(*relations) & (F.col("weight") >= min_weight)).select(F.col("src").alias("at"), F.col("dst").alias("to"), "relation", "weight")
    grown = sources.select(F.col("id").alias("source"), F.col("id").alias("target"), F.array("id").alias("path"), F.array().cast("array<string>").alias("relations"), F.array().cast("array<double>").alias("weights"), F.lit(0.0).alias("score"))
    all_paths = None
    for _ in range(max_depth):
        grown = grown.join(e, grown["target"] == e["at"]).where(~F.array_contains("path", F.col("to"))).select(
            "source", F.col("to").alias("target"), F.concat("path", F.array("to")).alias("path"), F.concat("relations", F.array("relation")).alias("relations"),
            F.concat("weights", F.array("weight")).alias("weights"), (F.col("score") + F.col("weight") - 0.10).alias("score"),
        )
        grown = materialize(grown)
        all_paths = grown if all_paths is None else all_paths.unionByName(grown)
    x = all_paths.withColumn("hops", F.size("relations")).withColumn("score", F.round("score", 9))
    order = [F.desc("score"), "hops", F.col("path"), F.col("relations")]
    x = x.withColumn("n", F.row_number().over(Window.partitionBy("source", "target").orderBy(*order))).where(F.col("n") <= per_target)
    x = x.withColumn("m", F.row_number().over(Window.partitionBy("source").orderBy(*order))).where(F.col("m") <= total)
    return x.drop("n", "m")


def boltzmann(found: DataFrame, relevance: DataFrame, weights: dict[str, float], temperature: float = 1.0, length_penalty: float = 0.25) -> DataFrame:
    """`found` with the energy of each path and its softmax probability among its source's paths."""
    rel = F.create_map(*[F.lit(x) for kv in weights.items() for x in kv])
    edge = F.aggregate(F.zip_with("relations", "weights", lambda r, w: rel[r] * w), F.lit(0.0), lambda a, b: a + b)
    keyed = found.withColumn("__k", F.xxhash64("source", F.to_json("path"), F.to_json("relations")))
    node = keyed.select("__k", F.explode("path").alias("id")).join(relevance.select("id", "relevance"), "id", "left").groupBy("__k").agg(F.sum(F.coalesce("relevance", F.lit(0.0))).alias("nodes"))
    x = keyed.join(node, "__k").withColumn("energy", F.col("nodes") + edge - length_penalty * F.col("hops"))
    w = Window.partitionBy("source")
    t = max(temperature, 1e-5)
    x = x.withColumn("z", F.exp((F.col("energy") - F.max("energy").over(w)) / t))
    return x.withColumn("probability", F.col("z") / F.sum("z").over(w)).drop("z", "nodes", "__k")


def louvain_kernel(ids: list[int], pairs: list[tuple[int, int, float]], resolution: float, sweeps: int = 25, gain: float = 1e-5, coarse: bool = True) -> dict[int, int]:
    """Community of each node: sequential local moves by id, ties to the smallest community, one coarse level."""
    adj: dict[int, dict[int, float]] = {i: {} for i in ids}
    for a, b, w in pairs:
        adj[a][b] = adj[a].get(b, 0.0) + w
        adj[b][a] = adj[b].get(a, 0.0) + w
    degree = {i: sum(adj[i].values()) for i in ids}
    m2 = sum(degree.values())
    if m2 <= 0:
        return {i: i for i in ids}

    def move(order: list[int], near: dict[int, dict[int, float]], deg: dict[int, float]) -> dict[int, int]:
        own = {i: i for i in order}
        tot = dict(deg)
        for _ in range(sweeps):
            moved = 0
            for i in order:
                k, cur = deg[i], own[i]
                links: dict[int, float] = {}
                for j, w in near[i].items():
                    links[own[j]] = links.get(own[j], 0.0) + w
                stay = links.get(cur, 0.0) / m2 - resolution * k * (tot[cur] - k) / (m2 * m2)
                best, top = cur, 0.0
                for c in sorted(links):
                    if c != cur:
                        d = links[c] / m2 - resolution * k * tot[c] / (m2 * m2) - stay
                        if d > top:
                            best, top = c, d
                if best != cur and top > gain:
                    tot[cur] -= k
                    tot[best] += k
                    own[i] = best
                    moved += 1
            if not moved:
                break
        return own

    own = move(sorted(ids), adj, degree)
    groups = sorted(set(own.values()))
    if coarse and 1 < len(groups) < len(ids):
        near: dict[int, dict[int, float]] = {g: {} for g in groups}
        deg = dict.fromkeys(groups, 0.0)
        for i in ids:
            deg[own[i]] += degree[i]
        for a, b, w in pairs:
            x, y = own[a], own[b]
            if x != y:
                near[x][y] = near[x].get(y, 0.0) + w
                near[y][x] = near[y].get(x, 0.0) + w
        upper = move(groups, near, deg)
        own = {i: upper[c] for i, c in own.items()}
    return own


def louvain(nodes: DataFrame, edges: DataFrame, group: str, resolutions: tuple[float, ...] = (1.0,)) -> DataFrame:
    """(group, resolution, id, community) of every node; each group and resolution is one sequential kernel.

    A community is named by its smallest node id.
    """
    pairs = graph.symmetrize(edges)
    g = nodes.select(F.col(group).alias("g"), "id")
    rows = g.select("g", F.col("id").alias("a"), F.lit(None).cast("bigint").alias("b"), F.lit(0.0).alias("w")).unionByName(pairs.join(g.withColumnRenamed("id", "a"), "a").select("g", "a", "b", F.col("weight").alias("w")))
    rows = rows.withColumn("resolution", F.explode(F.array(*[F.lit(float(r)) for r in resolutions])))

    def run(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        single = pdf["b"].isna()
        ids = sorted({int(x) for x in pdf.loc[single, "a"]})
        have = set(ids)
        rest = pdf[~single]
        edges_ = sorted((int(a), int(b), float(w)) for a, b, w in zip(rest["a"], rest["b"], rest["w"], strict=True) if int(b) in have)
        own = louvain_kernel(ids, edges_, key[1])
        name: dict[int, int] = {}
        for i in ids:
            name.setdefault(own[i], i)
        return pd.DataFrame({"grp": key[0], "resolution": key[1], "id": ids, "community": [name[own[i]] for i in ids]})

    return rows.groupBy("g", "resolution").applyInPandas(run, "grp bigint, resolution double, id bigint, community bigint")


def label_propagation(edges: DataFrame, nodes: DataFrame, rounds: int = 10) -> DataFrame:
    """(id, community) by synchronous label propagation, for graphs too large for one kernel: the most frequent
    label among neighbours, the smallest among equals, a node's own label counting once."""
    pairs = graph.symmetrize(edges)
    both = pairs.select(F.col("a").alias("id"), F.col("b").alias("near"), "weight").unionByName(pairs.select(F.col("b").alias("id"), F.col("a").alias("near"), "weight"))
    labels = nodes.select("id", F.col("id").alias("community"))
    for _ in range(rounds):
        votes = both.join(labels.withColumnRenamed("id", "near"), "near").select("id", "community", "weight").unionByName(labels.select("id", "community", F.lit(1.0).alias("weight")))
        votes = votes.groupBy("id", "community").agg(F.sum("weight").alias("v"))
        new = materialize(votes.groupBy("id").agg(F.max_by("community", F.struct("v", -F.col("community"))).alias("community")))
        moved = new.join(labels.withColumnRenamed("community", "old"), "id").where("community <> old").isEmpty()
        labels = new
        if moved:
            break
    return labels


def topological_order(files: list[str], uses: list[tuple[str, str]]) -> list[str]:
    """Files so that what is used comes first; alphabetical among the ready ones, cycles at the end."""
    import heapq

    need = {f: set() for f in files}
    users: dict[str, set[str]] = {f: set() for f in files}
    for a, b in uses:
        if a != b and a in need and b in need:
            need[a].add(b)
            users[b].add(a)
    ready = [f for f in files if not need[f]]
    heapq.heapify(ready)
    out = []
    while ready:
        f = heapq.heappop(ready)
        out.append(f)
        for u in users[f]:
            need[u].discard(f)
            if not need[u]:
                heapq.heappush(ready, u)
    done = set(out)
    return out + sorted(f for f in files if f not in done)


def topological_files(nodes: DataFrame, edges: DataFrame, group: str = "repo_id") -> DataFrame:
    """(group, position, file_path): the files of each group in dependency order."""
    n = nodes.select(F.col(group).alias("g"), "id", "file_path")
    uses = edges.select("src", "dst").join(n.select(F.col("id").alias("src"), "g", F.col("file_path").alias("a")), "src").join(n.select(F.col("id").alias("dst"), F.col("file_path").alias("b")), "dst").where("a <> b").select("g", "a", "b").distinct()
    rows = n.select("g", F.col("file_path").alias("a"), F.lit(None).cast("string").alias("b")).distinct().unionByName(uses)

    def run(batches: pd.DataFrame) -> pd.DataFrame:
        single = batches["b"].isna()
        order = topological_order(sorted(batches.loc[single, "a"]), list(zip(batches.loc[~single, "a"], batches.loc[~single, "b"], strict=True)))
        return pd.DataFrame({"grp": batches["g"].iloc[0], "position": range(len(order)), "file_path": order})

    return rows.groupBy("g").applyInPandas(run, "grp bigint, position bigint, file_path string")


