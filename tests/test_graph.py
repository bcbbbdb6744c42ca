"""Graph, diffusion and analytics operators on small graphs with known answers."""

import itertools
import random

import pytest
from pyspark.sql import functions as F

from millrace.operators import analytics as A
from millrace.operators import diffusion as D
from millrace.operators import graph as G


def typed(spark, rows):
    return spark.createDataFrame(rows, "src long, dst long, relation string, weight double")


def cliques(spark):
    e = [(i, j, "Calls", 1.0) for i, j in itertools.combinations(range(5), 2)] + [(i, j, "Calls", 1.0) for i, j in itertools.combinations(range(5, 10), 2)] + [(4, 5, "Calls", 1.0)]
    n = spark.createDataFrame([(i, 1, f"s{i}", "Function", "src/auth.rs" if i < 5 else "src/billing.rs", "fn x()", None, 5, None) for i in range(10)], "id long, repo_id long, name string, kind string, file_path string, signature string, docstring string, token_cost int, container_name string")
    return n, typed(spark, e)


def test_two_cliques(spark):
    n, e = cliques(spark)
    own = {r["id"]: r["community"] for r in A.louvain(n, e, "repo_id").collect()}
    assert len(set(own.values())) == 2
    assert {own[i] for i in range(5)} != {own[i] for i in range(5, 10)}
    m = spark.createDataFrame([(i, str(c)) for i, c in own.items()], "id long, community string")
    assert A.modularity_potts(e, m, textbook=True).first()[0] > 0.35
    stats = {r["community"]: r for r in A.community_stats(n, e, m).collect()}
    assert all(s["symbols"] == 5 and s["purity"] == 1.0 for s in stats.values())
    spread = {r["id"]: r["community"] for r in A.label_propagation(e, n).collect()}
    assert len({spread[i] for i in range(4)}) == 1


def test_clean_merge_normalize(spark):
    e = typed(spark, [(1, 2, "Calls", 2.0), (1, 2, "Calls", 2.0), (1, 2, "Imports", None), (1, 1, "Calls", 1.0), (2, 3, "Contains", 1.0), (None, 3, "Calls", 1.0)])
    c = G.clean_edges(e)
    assert sorted(tuple(r) for r in c.collect()) == [(1, 2, "Calls", 2.0), (1, 2, "Imports", 1.0), (2, 3, "Contains", 1.0)]
    assert sorted(tuple(r) for r in G.merge_parallel(c).collect()) == [(1, 2, 3.0), (2, 3, 1.0)]
    assert ("BelongsTo", 3, 2) in {(r["relation"], r["src"], r["dst"]) for r in G.with_reverse_containment(c).collect()}
    total = G.normalize_rows(G.merge_parallel(c)).groupBy("src").agg(F.sum("weight").alias("w")).collect()
    assert all(abs(r["w"] - 1) < 1e-12 for r in total)
    assert sorted(tuple(r) for r in G.transpose(G.merge_parallel(c)).collect()) == [(2, 1, 3.0), (3, 2, 1.0)]
    assert {r["id"]: (r["out_degree"], r["in_degree"]) for r in G.degrees(c).collect()} == {1: (2, 0), 2: (1, 2), 3: (0, 1)}
    assert G.clean_edges(e.limit(0)).count() == 0


def test_dense_index(spark):
    df = spark.createDataFrame([(g, i) for g in (3, 1, 2) for i in range(4)], "g long, i long")
    assert [r["dense_id"] for r in G.dense_index(df, "g", ["i"]).orderBy("g", "i").collect()] == list(range(12))


def test_impact_chain(spark):
    chain = typed(spark, [(3, 2, "Calls", 1.0), (2, 1, "Calls", 1.0), (1, 0, "Calls", 1.0), *[(t, 1, "Calls", 1.0) for t in (4, 5, 6, 7)]])
    files = {0: "src/a.rs", 1: "src/b.rs", 2: "src/c.rs", 3: "src/d.rs", 4: "tests/x.rs", 5: "tests/test_x.py", 6: "x_test.go", 7: "x.test.ts", 8: "src/z.rs"}
    n = spark.createDataFrame([(i, f"f{i}", p, "fn f()", None) for i, p in files.items()], "id long, name string, file_path string, signature string, docstring string")
    root = n.where("id = 0").select("id")
    assert {(r["id"], r["depth"]) for r in A.impact(chain, root).collect()} == {(1, 1), (2, 2), (4, 2), (5, 2), (6, 2), (7, 2), (3, 3)}
    r = A.impact_report(n, chain, root).first()
    assert (r["direct"], r["transitive"], r["tests"]) == (1, 2, 4)
    assert r["risk_score"] > 0.3 and r["risk_level"] == "HIGH"


def test_paths(spark):
    e = typed(spark, [(0, 1, "Calls", 0.95), (1, 2, "Calls", 0.9), (2, 3, "Calls", 0.9), (3, 4, "Calls", 0.85), (2, 4, "References", 0.7), (0, 5, "Contains", 0.6), (4, 0, "Calls", 0.9)])
    src = spark.createDataFrame([(0,)], "id long")
    p = A.paths(e, src, max_depth=4)
    found = sorted(tuple(r["path"]) for r in p.where("target = 4").collect())
    assert found == [(0, 1, 2, 3, 4), (0, 1, 2, 4)]
    rel = spark.createDataFrame([(i, 0.1 * i) for i in range(6)], "id long, relevance double")
    b = A.boltzmann(p, rel, G.relation_weights())
    assert abs(b.agg(F.sum("probability")).first()[0] - 1) < 1e-9
    sharp = A.boltzmann(p, rel, G.relation_weights(), temperature=0.1).agg(F.max("probability")).first()[0]
    assert sharp > b.agg(F.max("probability")).first()[0]


@pytest.mark.parametrize("seed", [1, 2])
def test_ppr_mass_and_bound(spark, seed):
    rng = random.Random(seed)
    rows = {(rng.randrange(15), rng.randrange(15)) for _ in range(40)}
    e = spark.createDataFrame([(a, b, rng.random() + 0.1) for a, b in rows if a != b], "src long, dst long, weight double")
    t = G.normalize_rows(G.merge_parallel(e))
    seeds = spark.createDataFrame([(7, rows_[0], 1.0) for rows_ in list(rows)[:2]] + [(8, 0, -1.0), (8, 1, 2.0)], "query long, id long, weight double")
    for options in ({"steps": 3}, {"epsilon": 1e-2}):
        s = D.ppr(t, seeds, **options)
        for r in s.groupBy("query").agg(F.sum(F.col("p") + F.col("r")).alias("m")).collect():
            assert abs(r["m"] - 1) < 1e-9
    near = {}
    for r in t.collect():
        near.setdefault(r["src"], []).append((r["dst"], r["weight"]))
    exact = {q: D.push_kernel(near, {r["id"]: r["weight"] for r in seeds.where(f"query = {q}").collect()}, epsilon=1e-10)[0] for q in (7, 8)}
    rough = D.ppr(t, seeds, epsilon=1e-2)
    for r in D.error_bounds(rough, e, epsilon=1e-2).collect():
        assert abs(exact[r["query"]].get(r["id"], 0.0) - r["p"]) <= r["bound"] + 1e-4


def test_push_kernel_agrees_with_the_joins(spark):
    rng = random.Random(4)
    rows = {(rng.randrange(12), rng.randrange(12)) for _ in range(30)}
    t = G.normalize_rows(G.merge_parallel(spark.createDataFrame([(a, b, 1.0) for a, b in rows if a != b], "src long, dst long, weight double")))
    seeds = spark.createDataFrame([(1, min(rows)[0], 1.0), (1, 99, -1.0), (2, 0, 0.0)], "query long, id long, weight double")
    joins = {r["id"]: r["p"] for r in D.ppr(t, seeds, epsilon=1e-2).where("query = 1").collect()}
    kernel = {(r["query"], r["id"]): (r["p"], r["r"]) for r in D.ppr_grouped(t.withColumn("query", F.lit(1)), seeds, epsilon=1e-8).collect()}
    assert {q for q, _ in kernel} == {1}
    assert abs(sum(p + r for p, r in kernel.values()) - 1) < 1e-9
    assert all(abs(kernel.get((1, i), (0.0, 0.0))[0] - p) < 0.2 for i, p in joins.items())


def test_kernel_and_coverage(spark):
    n, e = cliques(spark)
    k = D.evidence_kernel(n, e, G.relation_weights())
    assert k.where("k > 1 or k <= 0").count() == 0 and k.where("src = dst and k = 1").count() == 10
    one = spark.createDataFrame([(1, 0)], "query long, id long")
    two = spark.createDataFrame([(1, 0), (1, 9)], "query long, id long")
    assert D.coverage(k, two).first()["coverage"] > D.coverage(k, one).first()["coverage"] > 1


def test_topological_order():
    assert A.topological_order(["a", "b", "c"], [("a", "b"), ("b", "c")]) == ["c", "b", "a"]
    assert A.topological_order(["x", "y", "z"], [("x", "y"), ("y", "x")]) == ["z", "x", "y"]


def test_neighborhood_and_induced(spark):
    e = typed(spark, [(1, 2, "Calls", 1.0), (3, 1, "Imports", 0.5), (2, 4, "Calls", 0.8)])
    s = spark.createDataFrame([(1,)], "id long")
    got = {(r["id"], r["direction"], r["hop"], r["weight"]) for r in G.neighborhood(e, s, hops=2).collect()}
    assert got == {(2, "out", 1, 1.0), (3, "in", 1, 0.5), (4, "out", 2, 0.4)}
    assert G.neighborhood(e, s, relations=["Imports"]).count() == 1
    assert [tuple(r) for r in G.induced(e, spark.createDataFrame([(1,), (2,)], "id long")).collect()] == [(1, 2, "Calls", 1.0)]


def test_drift(spark):
    n = spark.createDataFrame([(1, "a/x.rs"), (2, "b/y.rs"), (3, "b/z.rs"), (4, "b/w.rs")], "id long, file_path string")
    m = n.select("id", F.lit("c").alias("community"))
    e = typed(spark, [(1, 2, "Calls", 1.0), (1, 3, "Calls", 1.0)])
    r = A.drift(n, e, m).first()
    assert (r["id"], r["dominant"], r["score"]) == (1, "b", 1.0)
