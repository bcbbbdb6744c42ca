"""Relevance diffusion over transition edges: personalised PageRank, its bounds and evidence kernels.

State tables are keyed by (query, id), so any number of seed sets diffuse in one
job. Only nodes with residual are joined to the edges; each step is written out,
which keeps the plan short and survives lost executors.
"""

from __future__ import annotations

from collections import deque

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .checkpoints import materialize

ALPHA, EPSILON = 0.15, 1e-4


def normalized_seeds(seeds: DataFrame) -> DataFrame:
    """(query, id, r): weights of each query's seeds, negatives as 0, summing to 1."""
    s = seeds.groupBy("query", "id").agg(F.sum(F.greatest(F.col("weight"), F.lit(0.0))).alias("w"))
    total = s.groupBy("query").agg(F.sum("w").alias("t")).where("t > 0")
    return s.join(total, "query").select("query", "id", (F.col("w") / F.col("t")).alias("r"))


def ppr(transition: DataFrame, seeds: DataFrame, alpha: float = ALPHA, steps: int | None = None, epsilon: float = EPSILON, max_steps: int = 60, checkpoint_every: int = 4) -> DataFrame:
    """(query, id, p, r) by synchronous forward push.

    With `steps`, so many rounds push every residual; else rounds push residuals of
    at least `epsilon` until none is left or `max_steps` is reached. A sink keeps
    all of its residual. The sum of p and r of a query is 1.
    """
    out = transition.select(F.col("src").alias("id"), "dst", F.col("weight").alias("w"), F.lit(False).alias("stays"))
    # a row of its own for each node with edges tells what stays there, so that one join does both; a sink has no row
    t = out.unionByName(out.select("id", F.col("id").alias("dst"), F.lit(0.0).alias("w"), F.lit(True).alias("stays")).distinct())
    t = materialize(t) if steps is None or steps > 2 else t
    state = normalized_seeds(seeds).select("query", "id", F.lit(0.0).alias("p"), "r")
    rounds = steps if steps is not None else max_steps
    live = F.col("r") >= epsilon if steps is None else F.col("r") > 0
    stays, sink = F.coalesce("stays", F.lit(True)), F.col("stays").isNull()
    for k in range(rounds):
        x = state.join(t, "id", "left").where(stays | live)
        kept = F.col("p") + F.when(live, F.when(sink, F.col("r")).otherwise(alpha * F.col("r"))).otherwise(0.0)
        left = F.when(stays, F.when(live, 0.0).otherwise(F.col("r"))).otherwise((1 - alpha) * F.col("r") * F.col("w"))
        x = x.select("query", F.coalesce("dst", "id").alias("id"), F.when(stays, kept).otherwise(0.0).alias("p"), left.alias("r"))
        state = x.groupBy("query", "id").agg(F.sum("p").alias("p"), F.sum("r").alias("r"))
        if (k + 1) % checkpoint_every == 0:
            state = materialize(state)
            # rounds after the last live residual change nothing, so looking at every few is enough
            if steps is None and state.where(F.col("r") >= epsilon).isEmpty():
                break
    return state


def push_kernel(near: dict[int, list[tuple[int, float]]], seeds: dict[int, float], alpha: float = ALPHA, epsilon: float = EPSILON, max_pushes: int = 100_000) -> tuple[dict[int, float], dict[int, float]]:
    """(p, r) by first-in-first-out forward push of one query; a sink keeps all of its residual."""
    total = sum(max(w, 0.0) for w in seeds.values())
    if total <= 0:
        return {}, {}
    p: dict[int, float] = {}
    r = {i: w / total for i, w in sorted(seeds.items()) if w > 0}
    queue = deque(i for i, w in r.items() if w >= epsilon)
    waiting = set(queue)
    for _ in range(max_pushes):
        if not queue:
            break
        i = queue.popleft()
        waiting.discard(i)
        x = r.get(i, 0.0)
        if x < epsilon:
            continue
        r[i] = 0.0
        out = near.get(i)
        if not out:
            p[i] = p.get(i, 0.0) + x
            continue
        p[i] = p.get(i, 0.0) + alpha * x
        for j, w in out:
            v = r[j] = r.get(j, 0.0) + (1 - alpha) * x * w
            if v >= epsilon and j not in waiting:
                queue.append(j)
                waiting.add(j)
    return p, r


def ppr_grouped(transition: DataFrame, seeds: DataFrame, alpha: float = ALPHA, epsilon: float = EPSILON) -> DataFrame:
    """(query, id, p, r) by exact push where each query has its own graph: `transition` (query, src, dst, weight).

    One kernel per query, side by side; for a graph that all queries share, `ppr` is the distributed form.
    """

    def run(key: tuple, edges: pd.DataFrame, own: pd.DataFrame) -> pd.DataFrame:
        near: dict[int, list[tuple[int, float]]] = {}
        for a, b, w in edges.sort_values(["src", "dst"])[["src", "dst", "weight"]].itertuples(index=False):
            near.setdefault(int(a), []).append((int(b), float(w)))
        wanted: dict[int, float] = {}
        for i, w in own[["id", "weight"]].itertuples(index=False):
            wanted[int(i)] = wanted.get(int(i), 0.0) + float(w)
        p, r = push_kernel(near, wanted, alpha, epsilon)
        ids = sorted(set(p) | set(r))
        return pd.DataFrame({"query": key[0], "id": ids, "p": [p.get(i, 0.0) for i in ids], "r": [r.get(i, 0.0) for i in ids]})

    left = transition.select("query", "src", "dst", "weight").groupBy("query")
    return left.cogroup(seeds.select("query", "id", "weight").groupBy("query")).applyInPandas(run, "query bigint, id bigint, p double, r double")


def error_bounds(scores: DataFrame, edges: DataFrame, alpha: float = ALPHA, epsilon: float = EPSILON) -> DataFrame:
    """(query, id, p, bound) of every scored node: the largest residual or epsilon, over alpha, times its in-degree."""
    worst = scores.groupBy("query").agg(F.max("r").alias("worst"))
    indeg = edges.groupBy(F.col("dst").alias("id")).agg(F.count("*").alias("indeg"))
    j = scores.join(worst, "query").join(indeg, "id", "left")
    bound = F.greatest(F.lit(epsilon), F.col("worst")) / F.lit(alpha) * F.greatest(F.coalesce("indeg", F.lit(0)), F.lit(1))
    return j.select("query", "id", "p", bound.alias("bound"))


def pagerank(transition: DataFrame, nodes: DataFrame, groups: str, steps: int = 10, alpha: float = ALPHA) -> DataFrame:
    """(query, id, p): PageRank with uniform seeds within each group of nodes."""
    seeds = nodes.select(F.col(groups).alias("query"), "id", F.lit(1.0).alias("weight"))
    return ppr(transition, seeds, alpha, steps=steps).select("query", "id", "p")


def boost(scores: DataFrame, members: DataFrame, factor: float) -> DataFrame:
    """Scores of nodes in a community that holds a seed, raised by `factor`; members(query, id) lists them."""
    m = members.select("query", "id").distinct().withColumn("hit", F.lit(True))
    return scores.join(m, ["query", "id"], "left").withColumn("p", F.when(F.col("hit"), F.col("p") * (1 + factor)).otherwise(F.col("p"))).drop("hit")


def evidence_kernel(nodes: DataFrame, edges: DataFrame, weights: dict[str, float], decay: float = 0.5, containment: float = 1.25, least: float = 1e-4) -> DataFrame:
    """(src, dst, k): the best evidence of a node for another within two hops; 1 for itself.

    A hop costs exp(-decay) and its relation's factor, and gains where the target
    shares the origin's file or container.
    """
    import math

    factor = F.create_map(*[F.lit(x) for k, w in weights.items() if w > 0 for x in (k, min(max(w / 2.0, 0.1), 1.0))])[F.col("relation")]
    hop = edges.select(F.col("src").alias("a"), F.col("dst").alias("b"), factor.alias("f")).where("f is not null").groupBy("a", "b").agg(F.max("f").alias("f"))
    where = nodes.select("id", "file_path", "container_name")

    def near(df: DataFrame) -> DataFrame:
        o = where.select(F.col("id").alias("src"), F.col("file_path").alias("of"), F.col("container_name").alias("oc"))
        d = where.select(F.col("id").alias("dst"), F.col("file_path").alias("tf"), F.col("container_name").alias("tc"))
        gain = F.when(F.col("oc").isNotNull() & (F.col("oc") == F.col("tc")), containment * 1.15).when(F.col("of") == F.col("tf"), containment).otherwise(1.0)
        j = df.join(o, "src").join(d, "dst")
        k = F.least(F.col("k") * math.exp(-decay) * F.col("f") * gain, F.lit(1.0))
        return j.select("src", "dst", k.alias("k")).where(F.col("k") >= least)

    one = near(hop.select(F.col("a").alias("src"), F.col("b").alias("dst"), F.lit(1.0).alias("k"), "f")).groupBy("src", "dst").agg(F.max("k").alias("k"))
    two = near(one.join(hop, one["dst"] == hop["a"]).select("src", F.col("b").alias("dst"), "k", "f").where("src <> dst"))
    own = where.select(F.col("id").alias("src"), F.col("id").alias("dst"), F.lit(1.0).alias("k"))
    return one.unionByName(two).unionByName(own).groupBy("src", "dst").agg(F.max("k").alias("k"))


def coverage(kernel: DataFrame, selected: DataFrame, relevance: DataFrame | None = None) -> DataFrame:
    """(query, coverage): probability mass that the selected nodes cover, 1 - prod(1 - k) for each target."""
    j = kernel.join(selected.select("query", F.col("id").alias("src")).distinct(), "src")
    per = j.groupBy("query", "dst").agg((1 - F.exp(F.sum(F.ln(1 - F.least("k", F.lit(1 - 1e-7)))))).alias("c"))
    if relevance is not None:
        per = per.join(relevance.select(F.col("id").alias("dst"), "relevance"), "dst").withColumn("c", F.col("c") * F.col("relevance"))
    return per.groupBy("query").agg(F.sum("c").alias("coverage"))
