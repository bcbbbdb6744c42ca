"""Queries of budgeted selection, evaluation and sessions."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from millrace.functions import text as T
from millrace.operators import analytics as A
from millrace.operators import diffusion as D
from millrace.operators import graph as G
from millrace.operators import selection as S
from millrace.operators import sessions as N

from .base import EDGES, NODES, TRANSITION, collapsed, edges, nodes, table, tokens_sql
from .graph_queries import _ppr, _SEEDS, seeds, transition

BUDGET = 300


def scores(spark: SparkSession, d: str) -> DataFrame:
    """(query, id, score) by three rounds of diffusion from each repository's seed."""
    return D.ppr(transition(spark, d), seeds(spark, d), steps=3).select("query", "id", F.col("p").alias("score"))


def candidates(spark: SparkSession, d: str) -> DataFrame:
    """Scored symbols with cost, place, neighbours and the cost of each level of detail."""
    n = nodes(spark, d)
    body = F.coalesce(F.ceil((F.col("span.end_byte") - F.col("span.start_byte")) / 4).cast("bigint"), F.col("token_cost").cast("bigint"))
    doc = T.token_estimate(F.coalesce("docstring", F.lit("")))
    lv = F.array(F.col("token_cost").cast("bigint"), F.col("token_cost") + doc, F.greatest((F.floor(body / 2) + 2).cast("bigint"), F.col("token_cost").cast("bigint")), F.greatest(body, F.col("token_cost").cast("bigint")))
    near = collapsed(spark, d).groupBy(F.col("src").alias("id")).agg(F.sort_array(F.collect_list("dst")).alias("near"))
    x = n.select("id", F.col("token_cost").cast("bigint").alias("cost"), F.col("file_path").alias("file"), F.col("container_name").alias("container"), lv.alias("levels")).join(near, "id", "left")
    return scores(spark, d).join(x, "id").where(F.col("score") >= S.MIN_RELEVANCE)


def _rounded(x: DataFrame) -> DataFrame:
    return x.withColumn("gain", F.round("gain", 6)).withColumn("utility", F.round("utility", 6))


def celf_select(spark: SparkSession, d: str) -> DataFrame:
    return _rounded(S.select(candidates(spark, d), BUDGET))


def threshold_greedy(spark: SparkSession, d: str) -> DataFrame:
    return _rounded(S.select(candidates(spark, d), BUDGET, S.threshold_greedy))


def mckp_select(spark: SparkSession, d: str) -> DataFrame:
    return _rounded(S.select(candidates(spark, d), BUDGET, S.multiple_choice))


def knapsack_exact(spark: SparkSession, d: str) -> DataFrame:
    """Exact best relevance of each repository's twelve best candidates within a budget of 60."""
    w = Window.partitionBy("query").orderBy(F.desc(F.round("score", 9)), "id")
    top = candidates(spark, d).withColumn("r", F.row_number().over(w)).where("r <= 12").select("query", "id", "cost", "score")

    def run(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("id")
        value, chosen = S.exact_knapsack(pdf["cost"].tolist(), pdf["score"].tolist(), 60)
        return pd.DataFrame({"query": [key[0]], "value": [round(value, 9)], "items": [len(chosen)]})

    return top.groupBy("query").applyInPandas(run, "query bigint, value double, items bigint").select("query", F.round("value", 6).alias("value"))


def submodular_select(spark: SparkSession, d: str) -> DataFrame:
    """Selection of each repository by the multi-objective utility over its scored candidates."""
    import numpy as np
    n = nodes(spark, d)
    k = D.evidence_kernel(n, edges(spark, d), G.relation_weights()).where("src <> dst")
    k = k.groupBy(F.col("src").alias("id")).agg(F.collect_list(F.struct("dst", "k")).alias("row"))
    c = candidates(spark, d).select("query", "id", "cost", "score", "file", "container").join(k, "id", "left").where("score >= 1e-3")

    def run(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("id").reset_index(drop=True)
        at = {int(i): p for p, i in enumerate(pdf["id"])}
        m = np.eye(len(pdf))
        for p, row in enumerate(pdf["row"]):
            for e in row if row is not None else ():
                if e["dst"] in at:
                    m[p, at[e["dst"]]] = e["k"]
        u = S.Utility(pdf["score"].to_numpy(), m, list(pdf["file"]), [x if isinstance(x, str) else None for x in pdf["container"]])
        out = S.submodular_greedy(u, [int(x) for x in pdf["cost"]], BUDGET)
        return pd.DataFrame([(key[0], s, int(pdf["id"][i]), round(g, 6)) for s, (i, g) in enumerate(out, start=1)], columns=["query", "step", "id", "gain"])

    return c.groupBy("query").applyInPandas(run, "query bigint, step bigint, id bigint, gain double")


def auto_budget(spark: SparkSession, d: str) -> DataFrame:
    return S.auto_budget(candidates(spark, d), 100, 1000)


def stability_index(spark: SparkSession, d: str) -> DataFrame:
    s = D.ppr(transition(spark, d), seeds(spark, d), steps=3)
    b = D.error_bounds(s, collapsed(spark, d), epsilon=0.0)
    return S.stability(candidates(spark, d), b, BUDGET).withColumn("stability", F.round("stability", 6))


def assign_lod(spark: SparkSession, d: str) -> DataFrame:
    c = candidates(spark, d)
    sel = S.select(c, BUDGET).select("query", "id")
    s = seeds(spark, d).select("query", "id", F.lit(True).alias("seed"))
    return S.assign_levels(sel.join(c, ["query", "id"]).join(s, ["query", "id"], "left").select("query", "id", "score", F.coalesce("seed", F.lit(False)).alias("seed"), "levels"), 2 * BUDGET)


def _curve(spark: SparkSession, d: str) -> DataFrame:
    """Utility over tokens when the candidates of a repository are taken by score per token."""
    w = Window.partitionBy("query").orderBy(F.desc(F.round(F.col("score") / F.greatest("cost", F.lit(1)), 9)), "id")
    upto = w.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return candidates(spark, d).select("query", "id", "score", "cost", F.row_number().over(w).alias("step"), F.sum("cost").over(upto).alias("tokens"), F.sum("score").over(upto).alias("utility"))


def kneedle(spark: SparkSession, d: str) -> DataFrame:
    c = _curve(spark, d).select("query", "step", F.col("tokens").cast("double").alias("cost"), F.round("utility", 9).alias("utility"))
    return S.knees(c).select("query", F.col("step").cast("bigint").alias("step"), F.col("cost").cast("bigint").alias("cost"), F.round("utility", 6).alias("utility"))


def omission_reasons(spark: SparkSession, d: str) -> DataFrame:
    """Why candidates after the budget's end were left out."""
    c = _curve(spark, d)
    used = c.where(F.col("tokens") <= BUDGET).groupBy("query").agg(F.max("tokens").alias("used"))
    x = c.where(F.col("tokens") > BUDGET).join(used, "query", "left")
    remaining = BUDGET - F.coalesce("used", F.lit(0))
    gain = F.round(F.col("score") / F.col("step"), 9)
    r = S.omission_reason(F.col("score"), F.col("cost"), gain, remaining, BUDGET, 1e-4)
    return x.select("query", r.alias("reason")).groupBy("query", "reason").agg(F.count("*").alias("symbols"))


def confidence_score(spark: SparkSession, d: str) -> DataFrame:
    c = _curve(spark, d)
    x = c.groupBy("query").agg(F.sum(F.when(F.col("tokens") <= BUDGET, F.col("score")).otherwise(0.0)).alias("s"), F.sum("score").alias("t"), F.max(F.when(F.col("tokens") <= BUDGET, F.col("tokens")).otherwise(0)).alias("u"))
    return x.select("query", F.round(S.confidence(F.col("s"), F.col("t"), F.col("u"), F.lit(float(BUDGET)), F.lit(0.5)), 6).alias("confidence"))


def pareto_frontier(spark: SparkSession, d: str) -> DataFrame:
    """Levels of detail of each symbol that are on the upper hull of utility over cost."""
    x = nodes(spark, d).where("span is not null")
    body = F.ceil((F.col("span.end_byte") - F.col("span.start_byte")) / 4).cast("bigint")
    sig, doc = T.token_estimate(F.col("signature")), T.token_estimate(F.coalesce("docstring", F.lit("")))
    lv = x.select("id", F.array(sig, sig + doc, (F.floor(body / 2) + 2).cast("bigint"), body).alias("costs"))

    @F.pandas_udf("array<bigint>")
    def hull(costs: pd.Series) -> pd.Series:
        return pd.Series([[p[0] for p in S.frontier(tuple(int(v) for v in c))[1:]] for c in costs])

    return lv.select("id", F.array_join(F.transform(hull("costs"), lambda v: v.cast("string")), ",").alias("levels"))


def truncate_to_budget(spark: SparkSession, d: str) -> DataFrame:
    """How many lines of each document fit into 200 tokens, counted from its start."""
    lines = F.split("text", "\n")
    empty = F.struct(F.lit(0).cast("bigint").alias("total"), F.lit(0).cast("bigint").alias("kept"), F.lit(None).cast("bigint").alias("tokens"))

    def step(acc, line):  # noqa: ANN001, ANN202 - columns
        after = lambda t: F.struct(t.alias("total"), (acc["kept"] + (t <= 200).cast("bigint")).alias("kept"), F.when(t <= 200, t).otherwise(acc["tokens"]).alias("tokens"))
        # lines behind the budget are not read; the estimate is made once, as an element
        return F.when(acc["total"] > 200, acc).otherwise(F.element_at(F.transform(F.array(acc["total"] + T.token_estimate(line)), after), 1))

    x = table(spark, d, "documents").where("text is not null").select("doc_id", F.size(lines).cast("bigint").alias("lines"), F.aggregate(lines, empty, step).alias("x"))
    return x.select("doc_id", "lines", "x.kept", "x.tokens")


def two_hop_ground_truth(spark: SparkSession, d: str) -> DataFrame:
    """(query, id, hop): neighbours of a seed either way, and what those use."""
    e = edges(spark, d).select("src", "dst").distinct()
    s = seeds(spark, d).select("query", "id")
    n1 = e.join(s, e["src"] == s["id"]).select("query", F.col("dst").alias("id")).union(e.join(s, e["dst"] == s["id"]).select("query", F.col("src"))).distinct()
    n2 = e.join(n1, e["src"] == n1["id"]).select("query", F.col("dst").alias("id")).distinct().join(n1, ["query", "id"], "left_anti").join(s, ["query", "id"], "left_anti")
    return n1.withColumn("hop", F.lit(1)).unionByName(n2.withColumn("hop", F.lit(2))).select("query", "id", F.col("hop").cast("bigint").alias("hop"))


def _strategies(spark: SparkSession, d: str) -> DataFrame:
    """(strategy, query, id): ten symbols of each repository by diffusion, by degree, by the seed's file, by name."""
    n = nodes(spark, d)
    top = lambda x, by: x.withColumn("r", F.row_number().over(Window.partitionBy("query").orderBy(F.desc(by), "id"))).where("r <= 10").select("query", "id")
    diff = top(scores(spark, d).withColumn("k", F.round("score", 9)), "k").withColumn("strategy", F.lit("diffusion"))
    deg = G.degrees(edges(spark, d)).join(n.select("id", F.col("repo_id").alias("query")), "id")
    deg = top(deg, "degree").withColumn("strategy", F.lit("degree"))
    seed = seeds(spark, d).select("query", F.col("id").alias("seed")).join(n.select(F.col("id").alias("seed"), F.col("file_path").alias("f"), F.col("name").alias("sn")), "seed")
    whole = n.select("id", F.col("repo_id").alias("query"), "file_path", "name").join(seed, "query")
    file = whole.where("file_path = f").select("query", "id", F.lit("whole_file").alias("strategy"))
    lex = whole.withColumn("k", F.round(T.set_jaccard(T.trigrams(F.col("name")), T.trigrams(F.col("sn"))), 9))
    lex = top(lex, "k").withColumn("strategy", F.lit("lexical"))
    return diff.unionByName(deg).unionByName(file.select("query", "id", "strategy")).unionByName(lex)


def _metrics(spark: SparkSession, d: str) -> DataFrame:
    truth = two_hop_ground_truth(spark, d)
    picked = _strategies(spark, d).join(nodes(spark, d).select("id", "token_cost"), "id")
    own = seeds(spark, d).select("query", "id", F.lit(True).alias("is_seed"))
    x = picked.join(truth, ["query", "id"], "left").join(own, ["query", "id"], "left")
    sizes = truth.groupBy("query").agg(F.sum((F.col("hop") == 1).cast("int")).alias("n1"), F.sum((F.col("hop") == 2).cast("int")).alias("n2"))
    agg = x.groupBy("strategy", "query").agg(F.count("*").alias("selected"), F.sum("token_cost").alias("tokens"), F.sum((F.col("hop") == 1).cast("int")).alias("h1"), F.sum((F.col("hop") == 2).cast("int")).alias("h2"), F.sum((F.col("hop").isNotNull() | F.col("is_seed").isNotNull()).cast("int")).alias("good"))
    j = agg.join(sizes, "query")
    z = lambda c: F.coalesce(c, F.lit(0))
    return j.select(
        "strategy", "query", "selected", "tokens", F.when(F.col("n1") == 0, 100.0).otherwise(100.0 * z("h1") / F.col("n1")).alias("direct_recall"),
        F.when(F.col("n2") == 0, 100.0).otherwise(100.0 * z("h2") / F.col("n2")).alias("transitive_recall"), (100.0 * F.col("good") / F.col("selected")).alias("precision"),
    )


def recall_precision(spark: SparkSession, d: str) -> DataFrame:
    return _metrics(spark, d).select("strategy", "query", "selected", "tokens", *(F.round(c, 4).alias(c) for c in ("direct_recall", "transitive_recall", "precision")))


def benchmark_summary(spark: SparkSession, d: str) -> DataFrame:
    m = _metrics(spark, d)
    return m.groupBy("strategy").agg(F.count("*").alias("scenarios"), *(F.round(F.avg(c), 4).alias(c) for c in ("selected", "tokens", "direct_recall", "transitive_recall", "precision")))


def debounce_session(spark: SparkSession, d: str) -> DataFrame:
    return N.debounce(table(spark, d, "events"), "user_id", "event_type", "ts", 3600.0).select("user_id", "session", "event_type", F.unix_micros(F.col("first_ts").cast("timestamp")).alias("first_us"), F.unix_micros(F.col("last_ts").cast("timestamp")).alias("last_us"), "n")


def session_totals(spark: SparkSession, d: str) -> DataFrame:
    """Users' event sessions read as tool sessions: an event's value is its tokens."""
    s = N.sessionize(table(spark, d, "events"), "user_id", "ts", 3600.0)
    x = s.select(F.concat_ws(":", "user_id", "session").alias("session"), F.col("event_type").alias("item"), F.floor(F.coalesce("value", F.lit(0.0))).cast("bigint").alias("tokens"), (F.col("event_type") != "error").alias("ok"))
    return N.session_totals(x).withColumn("per_1000", F.round("per_1000", 4))


def harness_summary(spark: SparkSession, d: str) -> DataFrame:
    """Sessions of each user without errors against all of them."""
    s = table(spark, d, "events").select(F.col("user_id").alias("session"), F.col("event_type").alias("item"), F.floor(F.coalesce("value", F.lit(0.0))).cast("bigint").alias("tokens"), (F.col("event_type") != "error").alias("ok"))
    before = N.session_totals(s).withColumnRenamed("session", "scenario")
    after = N.session_totals(s.where("ok")).withColumnRenamed("session", "scenario")
    return N.compare(before, after).select("scenarios", F.round("token_reduction", 4).alias("token_reduction"), F.round("call_reduction", 4).alias("call_reduction"))


def incremental_antijoin(spark: SparkSession, d: str) -> DataFrame:
    """Files whose content is not in the snapshot of all loads before the last day of loading."""
    f = table(spark, d, "file_sources").where("content is not null").select("file_id", F.sha2("content", 256).alias("h"), "loaded_at")
    last = f.agg(F.max("loaded_at").alias("m"))
    x = f.join(F.broadcast(last))  # one row
    old = x.where(F.col("loaded_at") < F.date_trunc("day", "m")).select("file_id", "h").distinct()
    return x.where(F.col("loaded_at") >= F.date_trunc("day", "m")).select("file_id", "h").distinct().join(old, ["file_id", "h"], "left_anti")


def cache_report(spark: SparkSession, d: str) -> DataFrame:
    """Loads of each repository that a content cache would have served."""
    f = table(spark, d, "file_sources").select("repo_id", "file_id", F.sha2(F.coalesce("content", F.lit("")), 256).alias("h"), F.col("content").isNull().alias("skipped"), "loaded_at")
    seen = F.row_number().over(Window.partitionBy("file_id", "h").orderBy("loaded_at")) > 1
    x = f.withColumn("hit", seen)
    hits = F.sum((F.col("hit") & ~F.col("skipped")).cast("int"))
    g = x.groupBy("repo_id").agg(F.count("*").alias("total"), F.sum(F.col("skipped").cast("int")).alias("skipped"), hits.alias("cached"))
    return g.select("repo_id", "total", "skipped", "cached", (F.col("total") - F.col("skipped") - F.col("cached")).alias("recomputed"), F.round(F.when(F.col("total") > F.col("skipped"), F.col("cached") / (F.col("total") - F.col("skipped"))).otherwise(0.0), 6).alias("hit_ratio"))


def navigate(spark: SparkSession, d: str) -> DataFrame:
    n = nodes(spark, d)
    s = scores(spark, d)
    top = F.max("score").over(Window.partitionBy("query"))
    rel = s.withColumn("relevance", F.col("score") / F.greatest(top, F.lit(1e-9))).select("query", "id", "relevance")
    x = n.select("id", F.col("repo_id").alias("query"), "kind", F.col("token_cost").alias("tokens"), T.is_test(F.col("name"), F.col("file_path"), F.col("signature"), F.col("docstring")).alias("is_test"))
    return N.navigate(x.join(rel, ["query", "id"], "left").withColumn("relevance", F.coalesce("relevance", F.lit(0.0))), edges(spark, d), seeds(spark, d))


def structured_context(spark: SparkSession, d: str) -> DataFrame:
    """One row per repository: its selection with edges, totals and confidence as a JSON document."""
    c = candidates(spark, d)
    sel = S.select(c, BUDGET)
    n = nodes(spark, d).select("id", "name", "kind", "file_path", "signature")
    s = sel.join(c.select("query", "id", "score"), ["query", "id"]).join(n, "id")
    sym = s.groupBy("query").agg(F.sort_array(F.collect_list(F.struct("step", "id", "name", "kind", "file_path", "signature", "score", "cost"))).alias("symbols"), F.sum("score").alias("rel"), F.sum("cost").alias("used"))
    e = collapsed(spark, d).join(sel.select("query", F.col("id").alias("src")), "src").join(sel.select(F.col("query").alias("q2"), F.col("id").alias("dst")), "dst").where("query = q2")
    e = e.groupBy("query").agg(F.sort_array(F.collect_list(F.struct("src", "dst", "weight"))).alias("edges"))
    total = c.groupBy("query").agg(F.sum("score").alias("all_rel"))
    j = sym.join(e, "query", "left").join(total, "query")
    conf = S.confidence(F.col("rel"), F.col("all_rel"), F.col("used"), F.lit(float(BUDGET)), F.lit(None).cast("double"))
    return j.select("query", F.to_json(F.struct("symbols", "edges", F.lit(BUDGET).alias("budget"), F.col("used").alias("tokens"), conf.alias("confidence"))).alias("context"))


def expand(spark: SparkSession, d: str) -> DataFrame:
    """Selection around each seed with the best path to every pick."""
    sel = S.select(candidates(spark, d), BUDGET).select(F.col("query"), F.col("id").alias("target"))
    p = A.paths(G.with_reverse_containment(edges(spark, d)), seeds(spark, d), max_depth=3, per_target=1)
    s = seeds(spark, d).select("query", F.col("id").alias("source"))
    return sel.join(s, "query").join(p, ["source", "target"], "left").select("query", "source", "target", F.array_join("path", ">").alias("path"))


def locate(spark: SparkSession, d: str) -> DataFrame:
    """Entry points for the words of a task: exact name, part of a name, or a hub; the best reason of each symbol."""
    words = ["journal", "archive", "ledger"]
    n = nodes(spark, d).select("id", F.col("repo_id").alias("query"), F.lower("name").alias("name"))
    toks = T.tokenize_ident(F.col("name"))
    exact = n.where(F.col("name").isin(words)).select("query", "id", F.lit("exact").alias("reason"), F.lit(1.0).alias("score"))
    part = n.where(F.arrays_overlap(toks, F.array(*[F.lit(w) for w in words]))).select("query", "id", F.lit("part").alias("reason"), F.lit(0.85).alias("score"))
    hubs = G.degrees(edges(spark, d)).join(n.select("id", "query"), "id").withColumn("r", F.row_number().over(Window.partitionBy("query").orderBy(F.desc("degree"), "id"))).where("r <= 3").select("query", "id", F.lit("hub").alias("reason"), F.lit(0.3).alias("score"))
    every = exact.unionByName(part).unionByName(hubs)
    best = every.groupBy("query", "id").agg(F.max_by("reason", "score").alias("reason"), F.max("score").alias("score"))
    return best.withColumn("r", F.row_number().over(Window.partitionBy("query").orderBy(F.desc("score"), "id"))).where("r <= 10").select("query", "id", "reason", "score")


_CAND = f"""{NODES}, {TRANSITION}, {_SEEDS}, {_ppr(3)}, cd AS (SELECT p3.query, n.id, p3.p AS score, CAST(n.token_cost AS BIGINT) AS cost FROM p3 JOIN n ON n.id = p3.id WHERE p3.p >= 1e-5),
 cu AS (SELECT *, row_number() OVER w AS step, sum(cost) OVER w AS tokens, sum(score) OVER w AS utility FROM cd WINDOW w AS (PARTITION BY query ORDER BY round(score / greatest(cost, 1), 9) DESC, id ROWS UNBOUNDED PRECEDING))"""
_TRUTH = f"""{NODES}, {EDGES}, {_SEEDS}, de AS (SELECT DISTINCT src, dst FROM e), h1 AS (SELECT s.query, de.dst AS id FROM de JOIN s ON s.id = de.src UNION SELECT s.query, de.src FROM de JOIN s ON s.id = de.dst),
 h2 AS (SELECT DISTINCT h1.query, de.dst AS id FROM de JOIN h1 ON h1.id = de.src EXCEPT SELECT query, id FROM h1 EXCEPT SELECT query, id FROM s), tr AS (SELECT query, id, 1 AS hop FROM h1 UNION ALL SELECT query, id, 2 FROM h2)"""
_G3 = "CASE WHEN length({0}) < 3 THEN [{0}] ELSE list_distinct(list_transform(range(1, length({0}) - 1), lambda i: substr({0}, i, 3))) END"
_STRAT = f"""{_TRUTH}, b AS (SELECT * FROM e UNION ALL SELECT dst, src, 'BelongsTo', weight FROM e WHERE relation = 'Contains'), @TRANS@, {_ppr(3)},
 sd AS (SELECT s.query, s.id AS seed, n.file_path AS f, n.name AS sn FROM s JOIN n ON n.id = s.id), wf AS (SELECT n.repo_id AS query, n.id, n.file_path, f, lower(n.name) AS a, lower(sn) AS c FROM n JOIN sd ON sd.query = n.repo_id),
 g3 AS (SELECT query, id, {_G3.format('a')} AS x, {_G3.format('c')} AS y FROM wf), lx AS (SELECT query, id, round(len(list_intersect(x, y)) / CAST(len(list_distinct(x || y)) AS DOUBLE), 9) AS k FROM g3),
 dg AS (SELECT n.repo_id AS query, z.id, count(*) AS k FROM (SELECT src AS id FROM e UNION ALL SELECT dst FROM e) z JOIN n ON n.id = z.id GROUP BY 1, 2),
 sg AS (SELECT 'diffusion' AS strategy, query, id FROM (SELECT query, id, row_number() OVER (PARTITION BY query ORDER BY round(p, 9) DESC, id) AS r FROM p3) WHERE r <= 10 UNION ALL
 SELECT 'degree', query, id FROM (SELECT query, id, row_number() OVER (PARTITION BY query ORDER BY k DESC, id) AS r FROM dg) WHERE r <= 10 UNION ALL SELECT 'whole_file', query, id FROM wf WHERE file_path = f UNION ALL
 SELECT 'lexical', query, id FROM (SELECT query, id, row_number() OVER (PARTITION BY query ORDER BY k DESC, id) AS r FROM lx) WHERE r <= 10),
 ag AS (SELECT sg.strategy, sg.query, count(*) AS selected, CAST(sum(n.token_cost) AS BIGINT) AS tokens, count(*) FILTER (tr.hop = 1) AS a1, count(*) FILTER (tr.hop = 2) AS a2, count(*) FILTER (tr.hop IS NOT NULL OR s.id IS NOT NULL) AS good FROM sg JOIN n ON n.id = sg.id LEFT JOIN tr ON tr.query = sg.query AND tr.id = sg.id LEFT JOIN s ON s.query = sg.query AND s.id = sg.id GROUP BY 1, 2),
 ns AS (SELECT query, count(*) FILTER (hop = 1) AS n1, count(*) FILTER (hop = 2) AS n2 FROM tr GROUP BY 1),
 me AS (SELECT strategy, ag.query, selected, tokens, CASE WHEN n1 = 0 THEN 100.0 ELSE 100.0 * a1 / n1 END AS direct_recall, CASE WHEN n2 = 0 THEN 100.0 ELSE 100.0 * a2 / n2 END AS transitive_recall, 100.0 * good / selected AS precision FROM ag JOIN ns ON ns.query = ag.query)"""
_STRAT = _STRAT.replace("@TRANS@", TRANSITION[TRANSITION.index("c AS (") :])
_SESS = """ev AS (SELECT *, epoch_us(ts) AS us FROM events), nw AS (SELECT *, CASE WHEN lag(us) OVER w IS NULL OR us - lag(us) OVER w > 3600000000 THEN 1 ELSE 0 END AS new FROM ev WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)),
 ss AS (SELECT *, CAST(sum(new) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS BIGINT) AS session FROM nw)"""

QUERIES = {
    f.__name__: f
    for f in (celf_select, threshold_greedy, mckp_select, knapsack_exact, submodular_select, auto_budget, stability_index, assign_lod, kneedle, omission_reasons, confidence_score, pareto_frontier, truncate_to_budget, two_hop_ground_truth, recall_precision, benchmark_summary, debounce_session, session_totals,
              harness_summary, incremental_antijoin, cache_report, navigate, structured_context, expand, locate)
}
ORACLES = {
    "kneedle": f"""WITH {_CAND}, r AS (SELECT query, step, CAST(tokens AS DOUBLE) AS cost, round(utility, 9) AS utility FROM cu), x AS (SELECT *, count(*) OVER (PARTITION BY query) AS n, first_value(cost) OVER w AS x0, last_value(cost) OVER w AS x1, first_value(utility) OVER w AS y0, last_value(utility) OVER w AS y1, first_value(step) OVER w AS s0, last_value(step) OVER w AS s1 FROM r
        WINDOW w AS (PARTITION BY query ORDER BY step ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING)), d AS (SELECT *, CASE WHEN n <= 2 THEN CASE WHEN step = s1 THEN 1.0 ELSE 0.0 END WHEN x1 - x0 <= 1e-6 OR y1 - y0 <= 1e-6 THEN CASE WHEN step = s0 THEN 1.0 ELSE 0.0 END
        WHEN utility / greatest(y1, 1e-6) >= 0.35 THEN round((utility - y0) / (y1 - y0) - (cost - x0) / (x1 - x0), 9) END AS d FROM x)
        SELECT query, step, CAST(cost AS BIGINT) AS cost, round(utility, 6) AS utility FROM (SELECT *, row_number() OVER (PARTITION BY query ORDER BY d DESC, step) AS rn FROM d WHERE d IS NOT NULL) WHERE rn = 1""",
    "omission_reasons": f"""WITH {_CAND}, u AS (SELECT query, max(tokens) AS used FROM cu WHERE tokens <= {BUDGET} GROUP BY 1), x AS (SELECT cu.*, {BUDGET} - coalesce(u.used, 0) AS rem, round(score / step, 9) AS gain FROM cu LEFT JOIN u ON u.query = cu.query WHERE tokens > {BUDGET})
        SELECT query, CASE WHEN score < 1e-4 THEN 'below_threshold' WHEN cost > rem OR cost > {BUDGET} THEN 'budget_exhausted' WHEN gain <= 0.15 * score OR gain <= 0 THEN 'redundant' ELSE 'outranked' END AS reason, count(*) AS symbols FROM x GROUP BY 1, 2""",
    "confidence_score": f"""WITH {_CAND}, x AS (SELECT query, sum(CASE WHEN tokens <= {BUDGET} THEN score ELSE 0.0 END) AS s, sum(score) AS t, max(CASE WHEN tokens <= {BUDGET} THEN tokens ELSE 0 END) AS u FROM cu GROUP BY 1)
        SELECT query, round(least(greatest(0.7 * CASE WHEN t > 1e-6 THEN least(greatest(s / t, 0.0), 1.0) WHEN s > 0 THEN 1.0 ELSE 0.0 END + 0.2 * least(u / {BUDGET}.0, 1.0) + 0.05, 0.0), 1.0), 6) AS confidence FROM x""",
    "pareto_frontier": f"""WITH {NODES}, x AS (SELECT id, {tokens_sql('signature')} AS sg, {tokens_sql("coalesce(docstring, '')")} AS dc, CAST(ceil((span.end_byte - span.start_byte) / 4.0) AS BIGINT) AS bd FROM n WHERE span IS NOT NULL),
        l AS (SELECT id, greatest(sg, 1) AS c1, greatest(sg + dc, sg, 1) AS c2, greatest(CAST(floor(bd / 2.0) + 2 AS BIGINT), sg + dc, sg, 1) AS c3, greatest(bd, CAST(floor(bd / 2.0) + 2 AS BIGINT), sg + dc, sg, 1) AS c4 FROM x),
        p AS (SELECT id, 0 AS k, 0 AS c, 0.0 AS u FROM l UNION ALL SELECT id, 1, c1, 0.35 FROM l UNION ALL SELECT id, 2, c2, 0.6 FROM l UNION ALL SELECT id, 3, c3, 0.85 FROM l UNION ALL SELECT id, 4, c4, 1.0 FROM l),
        m AS (SELECT p.* FROM p WHERE NOT EXISTS (SELECT 1 FROM p q WHERE q.id = p.id AND q.k > p.k AND q.c = p.c)),
        g AS (SELECT m.* FROM m WHERE m.k = 0 OR NOT EXISTS (SELECT 1 FROM m a, m b WHERE a.id = m.id AND b.id = m.id AND a.k < m.k AND b.k > m.k AND (m.u - a.u) * (b.c - m.c) <= (b.u - m.u) * (m.c - a.c)))
        SELECT id, string_agg(CAST(k AS VARCHAR), ',' ORDER BY k) AS levels FROM g WHERE k > 0 GROUP BY 1""",
    "truncate_to_budget": f"""WITH l AS (SELECT doc_id, string_split(text, chr(10)) AS a FROM documents WHERE text IS NOT NULL), x AS (SELECT doc_id, unnest(range(1, len(a) + 1)) AS n, unnest(a) AS line FROM l), y AS (SELECT doc_id, n, {tokens_sql('line')} AS tokens FROM x),
        z AS (SELECT *, CAST(sum(tokens) OVER (PARTITION BY doc_id ORDER BY n ROWS UNBOUNDED PRECEDING) AS BIGINT) AS total FROM y) SELECT doc_id, count(*) AS lines, count(*) FILTER (total <= 200) AS kept, max(total) FILTER (total <= 200) AS tokens FROM z GROUP BY 1""",
    "two_hop_ground_truth": f"WITH {_TRUTH} SELECT query, id, CAST(hop AS BIGINT) AS hop FROM tr",
    "recall_precision": f"WITH {_STRAT} SELECT strategy, query, selected, tokens, round(CAST(direct_recall AS DOUBLE), 4) AS direct_recall, round(CAST(transitive_recall AS DOUBLE), 4) AS transitive_recall, round(CAST(precision AS DOUBLE), 4) AS precision FROM me",
    "benchmark_summary": f"WITH {_STRAT} SELECT strategy, count(*) AS scenarios, round(avg(selected), 4) AS selected, round(avg(tokens), 4) AS tokens, round(avg(CAST(direct_recall AS DOUBLE)), 4) AS direct_recall, round(avg(CAST(transitive_recall AS DOUBLE)), 4) AS transitive_recall, round(avg(CAST(precision AS DOUBLE)), 4) AS precision FROM me GROUP BY 1",
    "debounce_session": f"WITH {_SESS} SELECT user_id, session, event_type, min(us) AS first_us, max(us) AS last_us, count(*) AS n FROM ss GROUP BY 1, 2, 3",
    "session_totals": f"""WITH {_SESS}, x AS (SELECT CAST(user_id AS VARCHAR) || ':' || CAST(session AS VARCHAR) AS session, event_type AS item, CAST(floor(coalesce(value, 0)) AS BIGINT) AS tokens, event_type <> 'error' AS ok FROM ss)
        SELECT session, count(*) AS calls, CAST(sum(tokens) AS BIGINT) AS tokens, count(DISTINCT item) AS items, count(*) FILTER (ok) AS succeeded, round(CASE WHEN sum(tokens) > 0 THEN count(DISTINCT item) * 1000.0 / sum(tokens) ELSE 0.0 END, 4) AS per_1000 FROM x GROUP BY 1""",
    "harness_summary": """WITH x AS (SELECT user_id, CAST(floor(coalesce(value, 0)) AS BIGINT) AS tokens, event_type <> 'error' AS ok FROM events), b AS (SELECT user_id, sum(tokens) AS t, count(*) AS c FROM x GROUP BY 1), a AS (SELECT user_id, sum(tokens) AS t, count(*) AS c FROM x WHERE ok GROUP BY 1)
        SELECT count(*) AS scenarios, round(avg(greatest(1 - a.t / greatest(b.t, 1), 0.0) * 100), 4) AS token_reduction, round(avg(greatest(1 - a.c / greatest(b.c, 1), 0.0) * 100), 4) AS call_reduction FROM a JOIN b USING (user_id)""",
    "incremental_antijoin": """WITH f AS (SELECT file_id, sha256(content) AS h, loaded_at, date_trunc('day', max(loaded_at) OVER ()) AS m FROM file_sources WHERE content IS NOT NULL)
        SELECT DISTINCT file_id, h FROM f WHERE loaded_at >= m AND NOT EXISTS (SELECT 1 FROM f o WHERE o.file_id = f.file_id AND o.h = f.h AND o.loaded_at < o.m)""",
    "cache_report": """WITH f AS (SELECT repo_id, content IS NULL AS skipped, row_number() OVER (PARTITION BY file_id, sha256(coalesce(content, '')) ORDER BY loaded_at) > 1 AS hit FROM file_sources), g AS (SELECT repo_id, count(*) AS total, count(*) FILTER (skipped) AS skipped, count(*) FILTER (hit AND NOT skipped) AS cached FROM f GROUP BY 1)
        SELECT repo_id, total, skipped, cached, total - skipped - cached AS recomputed, round(CASE WHEN total > skipped THEN cached / (total - skipped) ELSE 0.0 END, 6) AS hit_ratio FROM g""",
    "locate": f"""WITH {NODES}, {EDGES}, t AS (SELECT id, repo_id AS query, lower(name) AS name, list_filter(string_split(regexp_replace(regexp_replace(regexp_replace(lower(name), '[^\\p{{L}}\\p{{N}}]+', ' ', 'g'), '([0-9])([^0-9 ])', '\\1 \\2', 'g'), '([^0-9 ])([0-9])', '\\1 \\2', 'g'), ' '), lambda w: w <> '') AS w FROM n),
        dg AS (SELECT z.id, count(*) AS k FROM (SELECT src AS id FROM e UNION ALL SELECT dst FROM e) z GROUP BY 1), hb AS (SELECT query, id FROM (SELECT t.query, t.id, row_number() OVER (PARTITION BY t.query ORDER BY dg.k DESC, t.id) AS r FROM t JOIN dg ON dg.id = t.id) WHERE r <= 3),
        ev AS (SELECT query, id, 'exact' AS reason, 1.0 AS score FROM t WHERE name IN ('journal', 'archive', 'ledger') UNION ALL SELECT query, id, 'part', 0.85 FROM t WHERE list_has_any(w, ['journal', 'archive', 'ledger']) UNION ALL SELECT query, id, 'hub', 0.3 FROM hb),
        bs AS (SELECT query, id, arg_max(reason, score) AS reason, CAST(max(score) AS DOUBLE) AS score FROM ev GROUP BY 1, 2) SELECT query, id, reason, score FROM (SELECT *, row_number() OVER (PARTITION BY query ORDER BY score DESC, id) AS r FROM bs) WHERE r <= 10""",
    "knapsack_exact": f"""WITH {_CAND}, tp AS (SELECT query, cost, score, r FROM (SELECT query, cost, score, row_number() OVER (PARTITION BY query ORDER BY round(score, 9) DESC, id) - 1 AS r FROM cd) WHERE r < 12),
        mk AS (SELECT unnest(range(0, 4096)) AS mask), sm AS (SELECT query, mask, sum(CASE WHEN (mask >> r) & 1 = 1 THEN cost ELSE 0 END) AS c, sum(CASE WHEN (mask >> r) & 1 = 1 THEN score ELSE 0.0 END) AS v FROM tp, mk GROUP BY 1, 2)
        SELECT query, round(round(max(v), 9), 6) AS value FROM sm WHERE c <= 60 GROUP BY 1""",
}
