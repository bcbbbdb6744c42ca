"""Queries of retrieval and of change history."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.functions import text as T
from millrace.operators import history as H
from millrace.operators import retrieval as R

from .base import EDGES, NODES, TRANSITION, nodes, table, words_sql
from .graph_queries import transition

#: The stated queries.
SEARCHES = [(1, "seal archive journal"), (2, "the token window helpers"), (3, "collectHiddenFixture"), (4, "rank_frontier_basket")]


def _docs(spark: SparkSession, d: str) -> DataFrame:
    return R.documents(nodes(spark, d))


def doc_freq(spark: SparkSession, d: str) -> DataFrame:
    return R.doc_freq(_docs(spark, d))


def bm25_fielded(spark: SparkSession, d: str) -> DataFrame:
    s = R.bm25(_docs(spark, d), R.query_table(spark, SEARCHES))
    return s.select("query", "id", F.round("score", 4).alias("score"))


def _names(spark: SparkSession, d: str) -> DataFrame:
    stated = F.array(*[F.struct(F.lit(q).alias("query"), F.lit(t.lower()).alias("q")) for q, t in SEARCHES])
    x = nodes(spark, d).select("id", "name", F.explode(stated).alias("s"))
    sim = T.set_jaccard(T.trigrams(F.col("name")), T.trigrams(F.col("s.q")))
    return x.select(F.col("s.query").alias("query"), "id", F.round(sim, 9).alias("score")).where("score > 0")


def rrf_fusion(spark: SparkSession, d: str) -> DataFrame:
    """Twenty best of each query, fused from the fielded score and name similarity."""
    lexical = R.bm25(_docs(spark, d), R.query_table(spark, SEARCHES)).withColumn("score", F.round("score", 9))
    f = R.rrf([(lexical, 1.0), (_names(spark, d), 0.7)]).withColumn("score", F.round("score", 9))
    return R.top_k(f, 20).select("query", "id", F.round("score", 6).alias("score"), F.col("rank").cast("bigint").alias("rank"))


def rocchio_terms(spark: SparkSession, d: str) -> DataFrame:
    q = R.query_table(spark, SEARCHES)
    s = R.bm25(_docs(spark, d), q).withColumn("score", F.round("score", 9))
    return R.rocchio(nodes(spark, d), q, s).select("query", "term", F.round("weight", 6).alias("weight"))


def hybrid_search(spark: SparkSession, d: str) -> DataFrame:
    return R.search(nodes(spark, d), R.query_table(spark, SEARCHES), 10)


def hash_embed(spark: SparkSession, d: str) -> DataFrame:
    """Length and norm of the embedding of every document's text."""
    e = R.hash_embed(table(spark, d, "documents").select("doc_id", F.coalesce("text", F.lit("")).alias("text")), "text")
    sq = F.aggregate(F.transform("embedding", lambda x: x.cast("double") * x.cast("double")), F.lit(0.0), lambda a, b: a + b)
    return e.select("doc_id", F.size("embedding").alias("dims"), F.round(F.sqrt(sq), 3).alias("norm"))


def cosine_topk(spark: SparkSession, d: str) -> DataFrame:
    v = table(spark, d, "embeddings")
    r = R.cosine_topk(v, v.where("vec_id % 20 = 0"), 10)
    return r.select("query", "id", F.round("score", 5).alias("score"), F.col("rank").cast("bigint").alias("rank"))


def _suppliers(spark: SparkSession, d: str) -> DataFrame:
    """Orders as commits and suppliers as the items they touch."""
    o = table(spark, d, "orders").select("o_orderkey", F.unix_timestamp("o_orderdate").alias("ts"))
    li = table(spark, d, "lineitem").select(F.col("l_orderkey").alias("o_orderkey"), F.col("l_suppkey").alias("item"), F.col("l_partkey").alias("path"))
    return li.join(o, "o_orderkey").select(F.lit(1).alias("grp"), F.col("o_orderkey").alias("commit"), "ts", "item", "path")


def coedit_top_pairs(spark: SparkSession, d: str) -> DataFrame:
    p = H.couplings(_suppliers(spark, d)).where("src < dst")
    x = p.select("src", "dst", "raw_count", F.round("support", 4).alias("support"), F.round("jaccard", 4).alias("jaccard"))
    return x.orderBy(F.desc("support"), F.desc("raw_count"), "src", "dst").limit(20)


def _commits(spark: SparkSession, d: str, grp: str = "run_id") -> DataFrame:
    c = table(spark, d, "commit_symbols").where(f"{grp} is not null and commit_hash is not null")
    return c.select(F.col(grp).alias("grp"), F.lower("commit_hash").alias("commit"), F.col("commit_ts").alias("ts"), F.col("symbol_id").alias("item"), T.normalized_path(F.col("file_path")).alias("path"))


def coedit_pairs(spark: SparkSession, d: str) -> DataFrame:
    p = H.couplings(_commits(spark, d))
    return p.select("grp", "src", "dst", "raw_count", *(F.round(c, 4).alias(c) for c in ("support", "confidence", "jaccard")))


def megacommit_filter(spark: SparkSession, d: str) -> DataFrame:
    """Commits of each run that count, are too large, or touch too little."""
    c = H.commit_sizes(_commits(spark, d))
    k = lambda x: F.sum(F.expr(x).cast("int")).alias
    return c.groupBy(F.col("grp").alias("run_id")).agg(F.count("*").alias("commits"), k("megacommit")("megacommits"), k("valid")("valid"), k("not megacommit and not valid")("small"))


def coedit_counts(spark: SparkSession, d: str) -> DataFrame:
    """In how many valid commits of each run a symbol is, and their weight."""
    return H.valid_items(_commits(spark, d)).groupBy("grp", "item").agg(F.count("*").alias("commits"), F.round(F.sum("w"), 4).alias("weight"))


def coedit_edges(spark: SparkSession, d: str) -> DataFrame:
    return H.directed_edges(H.couplings(_commits(spark, d))).withColumn("weight", F.round("weight", 4))


def coedit_per_source(spark: SparkSession, d: str) -> DataFrame:
    """The five most confident partners of each symbol."""
    x = H.couplings(_commits(spark, d)).withColumn("confidence", F.round("confidence", 9))
    return H.couplings_of(x, 5).select("grp", "src", "dst", "rank", F.round("confidence", 4).alias("confidence"))


def coedit_lookup(spark: SparkSession, d: str) -> DataFrame:
    """Confidence of every call between symbols that a run touched, 0 for those not coupled."""
    from .base import edges

    calls = edges(spark, d).where("relation = 'Calls'").select("src", "dst").distinct()
    seen = _commits(spark, d).where("item is not null").select("grp", F.col("item").alias("src")).distinct()
    x = H.confidence_of(H.couplings(_commits(spark, d)), seen.join(calls, "src"))
    return x.select("grp", "src", "dst", *(F.round(c, 4).alias(c) for c in ("confidence", "jaccard")))


def _layers(spark: SparkSession, d: str) -> DataFrame:
    from .base import edges

    layer = F.create_map(*[F.lit(x) for x in ("Contains", "AST Parent", "Calls", "Call", "References", "Type Ref", "Imports", "Import")])[F.col("relation")]
    e = edges(spark, d).select("src", "dst", layer.alias("layer")).where("layer is not null")
    n = nodes(spark, d).select("id", "repo_id")
    return e.unionByName(e.where("layer = 'AST Parent'").select(F.col("dst").alias("src"), F.col("src").alias("dst"), "layer")).distinct().join(n.withColumnRenamed("id", "src"), "src")


def _repo_couplings(spark: SparkSession, d: str) -> DataFrame:
    return H.couplings(_commits(spark, d, "repo_id"))


def _rates(spark: SparkSession, d: str) -> DataFrame:
    p = _repo_couplings(spark, d).select(F.col("grp").alias("repo_id"), "src", "dst", "support")
    x = _layers(spark, d).join(p, ["repo_id", "src", "dst"], "left").groupBy("repo_id", "layer").agg(F.count("*").alias("edge_count"), F.count("support").alias("cochanged"), F.coalesce(F.sum("support"), F.lit(0.0)).alias("mass"))
    frame = nodes(spark, d).select("repo_id").distinct().select("repo_id", F.explode(F.array(*[F.lit(k) for k in H.LAYER_DEFAULTS])).alias("layer"))
    z = lambda c, v: F.coalesce(c, F.lit(v)).alias(c)
    j = frame.join(x, ["repo_id", "layer"], "left").select("repo_id", "layer", z("edge_count", 0), z("cochanged", 0), z("mass", 0.0))
    return j.withColumn("rate", F.col("mass") / (F.col("edge_count") + 1))


def layer_rates(spark: SparkSession, d: str) -> DataFrame:
    return _rates(spark, d).select("repo_id", "layer", "edge_count", "cochanged", F.round("mass", 4).alias("mass"), F.round("rate", 6).alias("rate"))


def learned_weights(spark: SparkSession, d: str) -> DataFrame:
    valid = H.commit_sizes(_commits(spark, d, "repo_id")).where("valid").groupBy("grp").agg(F.count("*").alias("valid"))
    conf = _repo_couplings(spark, d).groupBy("grp").agg(F.avg("confidence").alias("mean_confidence"))
    rates = _rates(spark, d).select(F.col("repo_id").alias("grp"), "layer", "rate")
    return H.learned_weights(rates, valid, conf).select("grp", "layer", F.round("weight", 2).alias("weight"))


def mrr(spark: SparkSession, d: str) -> DataFrame:
    """How high a symbol's most likely neighbours rank among its co-changed ones, per repository."""
    n = nodes(spark, d).select(F.col("id").alias("src"), F.col("repo_id").alias("grp"))
    ranked = transition(spark, d).join(n, "src").select("grp", "src", "dst", F.round("weight", 9).alias("score"))
    return H.mean_reciprocal_rank(ranked, _repo_couplings(spark, d)).select("grp", "sources", F.round("mrr", 6).alias("mrr"))


def _diffs(spark: SparkSession, d: str) -> DataFrame:
    """A diff per repository: in every file, the first row of its first symbol is replaced and two rows are added after it."""
    s = nodes(spark, d).where("span is not null").groupBy("repo_id", T.normalized_path(F.col("file_path")).alias("p")).agg(F.min("span.start_row").alias("r"))
    text = F.format_string("diff --git a/%1$s b/%1$s\n--- a/%1$s\n+++ b/%1$s\n@@ -%2$d,2 +%2$d,4 @@ x\n-old\n+new\n+more\n context", F.col("p"), F.col("r") + 1)
    return s.groupBy(F.col("repo_id").alias("key")).agg(F.array_join(F.array_sort(F.collect_list(text)), "\n").alias("diff"))


def parse_unified_diff(spark: SparkSession, d: str) -> DataFrame:
    return H.parse_diff(_diffs(spark, d))


def diff_to_symbols(spark: SparkSession, d: str) -> DataFrame:
    s = nodes(spark, d).where("span is not null").select("id", F.col("repo_id").alias("key"), "file_path", "span.start_row", "span.end_row")
    return H.changed_symbols(H.parse_diff(_diffs(spark, d)), s).select("key", "id", F.col("hits").cast("bigint").alias("hits"))


_TOK = f"""{NODES}, dd AS (SELECT id, name, {words_sql('name')} AS a, {words_sql('signature')} AS b, {words_sql('file_path')} AS c, {words_sql("coalesce(docstring, '')")} AS d FROM n)"""
_STOP = ", ".join(f"'{w}'" for w in T.STOPWORDS)
_QUERY_ROWS = ", ".join(f"({q}, '{t}')" for q, t in SEARCHES)
_QT = f"""qs AS (SELECT CAST(column0 AS BIGINT) AS query, column1 AS text FROM (VALUES {_QUERY_ROWS}) v(column0, column1)), qt0 AS (SELECT query, text, {words_sql('text')} AS w FROM qs),
 qt AS (SELECT query, text, CASE WHEN len(list_filter(w, lambda x: x NOT IN ({_STOP}) AND strlen(x) > 1)) > 0 THEN list_filter(w, lambda x: x NOT IN ({_STOP}) AND strlen(x) > 1) ELSE w END AS terms FROM qt0), te AS (SELECT DISTINCT query, unnest(terms) AS term FROM qt)"""
_TFS = " + ".join(f"{w} * (tf_{k} / greatest({1.0 - b} + {b} * (l_{k} / greatest(avg_{k}, 1.0)), 0.2))" for (f, w, b), k in zip(R.FIELDS, "abcd", strict=True))


def _g(x: str) -> str:
    parts = " || ".join(f"list_transform(range(1, greatest(length({x}) - {n - 2}, 1)), lambda i: substr({x}, i, {n}))" for n in (3, 4, 5))
    return f"CASE WHEN length({x}) < 3 THEN [{x}] ELSE list_distinct({parts}) END"


_BM25 = f"""{_TOK}, {_QT}, st AS (SELECT count(*) AS nd, avg(len(a)) AS avg_a, avg(len(b)) AS avg_b, avg(len(c)) AS avg_c, avg(len(d)) AS avg_d FROM dd), wt AS (SELECT DISTINCT term FROM te),
 pf AS (SELECT dd.id, wt.term, len(a) AS l_a, len(b) AS l_b, len(c) AS l_c, len(d) AS l_d, len(list_filter(a, lambda x: x = wt.term)) AS tf_a, len(list_filter(b, lambda x: x = wt.term)) AS tf_b, len(list_filter(c, lambda x: x = wt.term)) AS tf_c, len(list_filter(d, lambda x: x = wt.term)) AS tf_d FROM dd, wt),
 ph AS (SELECT * FROM pf WHERE tf_a + tf_b + tf_c + tf_d > 0), dfs AS (SELECT term, count(*) AS df FROM ph GROUP BY 1),
 sc AS (SELECT ph.id, ph.term, greatest(ln((nd - df + 0.5) / (df + 0.5) + 1.0), 0.15) AS idf, {_TFS} AS tf FROM ph JOIN dfs USING (term), st),
 lx AS (SELECT te.query, sc.id, sum(idf * (tf * 2.2 / (tf + 1.2) + 0.5)) AS s FROM sc JOIN te USING (term) GROUP BY 1, 2),
 eb AS (SELECT qs.query, dd.id, a, lower(trim(qs.text)) AS q, '<' || array_to_string(a, '') || '>' AS nm, '<' || lower(trim(qs.text)) || '>' AS qn FROM dd, qs), ec AS (SELECT *, {_g('nm')} AS gn, {_g('qn')} AS gq FROM eb),
 ed AS (SELECT query, id, CASE WHEN array_to_string(a, '') = q OR array_to_string(a, '_') = q THEN 40.0 WHEN list_contains(a, q) THEN 20.0 ELSE 0.0 END AS x, len(list_intersect(gq, gn)) / CAST(len(list_distinct(gq || gn)) AS DOUBLE) AS j FROM ec),
 bn AS (SELECT query, id, CAST(x AS DOUBLE) + CASE WHEN j > 0.35 THEN j * 15.0 ELSE 0.0 END AS s FROM ed),
 bm AS (SELECT query, id, sum(s) AS score FROM (SELECT * FROM lx UNION ALL SELECT * FROM bn WHERE s > 0) GROUP BY 1, 2)"""


def _coedits(source: str) -> str:
    """Couplings of rows (grp, h, item, ts, p)."""
    return f"""ci AS ({source}), sz AS (SELECT grp, h, count(DISTINCT item) AS n, count(DISTINCT p) AS f, max(ts) AS t FROM ci GROUP BY 1, 2), la AS (SELECT grp, max(t) AS lt FROM sz GROUP BY 1),
 ok AS (SELECT sz.grp, sz.h, least(greatest(power(2.0, -greatest(lt - t, 0) / 7776000.0), 0.001), 1.0) AS w FROM sz JOIN la USING (grp) WHERE n BETWEEN 2 AND 40 AND f <= 25),
 v AS (SELECT DISTINCT ci.grp, ci.h, ci.item, ok.w FROM ci JOIN ok ON ok.grp = ci.grp AND ok.h = ci.h WHERE ci.item IS NOT NULL),
 one AS (SELECT grp, item, sum(w) AS c FROM v GROUP BY 1, 2), pr AS (SELECT a.grp, a.item AS u, b.item AS v, count(*) AS raw_count, sum(a.w) AS support FROM v a JOIN v b ON a.grp = b.grp AND a.h = b.h AND a.item < b.item GROUP BY 1, 2, 3 HAVING count(*) >= 2),
 pj AS (SELECT pr.*, x.c AS cu, y.c AS cv, support / greatest(x.c + y.c - support, 1e-6) AS jaccard FROM pr JOIN one x ON x.grp = pr.grp AND x.item = pr.u JOIN one y ON y.grp = pr.grp AND y.item = pr.v),
 pp AS (SELECT grp, u AS src, v AS dst, raw_count, support, least(support / greatest(cu, 1e-6), 1.0) AS confidence, jaccard FROM pj WHERE jaccard >= 0.05 UNION ALL SELECT grp, v, u, raw_count, support, least(support / greatest(cv, 1e-6), 1.0), jaccard FROM pj WHERE jaccard >= 0.05)"""


_P = "regexp_replace(replace(file_path, '\\', '/'), '^(\\./)+', '')"
_RUNS = _coedits(f"SELECT run_id AS grp, lower(commit_hash) AS h, symbol_id AS item, commit_ts AS ts, {_P} AS p FROM commit_symbols WHERE run_id IS NOT NULL AND commit_hash IS NOT NULL")
_REPOS = _coedits(f"SELECT repo_id AS grp, lower(commit_hash) AS h, symbol_id AS item, commit_ts AS ts, {_P} AS p FROM commit_symbols WHERE repo_id IS NOT NULL AND commit_hash IS NOT NULL")
_RATES = """le0 AS (SELECT DISTINCT src, dst, CASE relation WHEN 'Contains' THEN 'AST Parent' WHEN 'Calls' THEN 'Call' WHEN 'References' THEN 'Type Ref' WHEN 'Imports' THEN 'Import' END AS layer FROM typed_edges WHERE src <> dst),
 le AS (SELECT * FROM le0 WHERE layer IS NOT NULL UNION SELECT dst, src, layer FROM le0 WHERE layer = 'AST Parent'), lr AS (SELECT n.repo_id, le.* FROM le JOIN n ON n.id = le.src),
 lx AS (SELECT lr.repo_id, layer, count(*) AS edge_count, count(support) AS cochanged, coalesce(sum(support), 0.0) AS mass FROM lr LEFT JOIN pp ON pp.grp = lr.repo_id AND pp.src = lr.src AND pp.dst = lr.dst GROUP BY 1, 2),
 fr AS (SELECT DISTINCT repo_id, l.layer FROM n, (VALUES ('AST Parent', 0.8), ('Call', 1.0), ('Type Ref', 0.6), ('Import', 0.3)) l(layer, d)),
 rt AS (SELECT fr.repo_id, fr.layer, coalesce(edge_count, 0) AS edge_count, coalesce(cochanged, 0) AS cochanged, coalesce(mass, 0.0) AS mass, coalesce(mass, 0.0) / (coalesce(edge_count, 0) + 1) AS rate FROM fr LEFT JOIN lx USING (repo_id, layer))"""
_FIRST = f"fs AS (SELECT repo_id, {_P} AS p, min(span.start_row) AS r FROM n WHERE span IS NOT NULL GROUP BY 1, 2)"

QUERIES = {
    f.__name__: f
    for f in (doc_freq, bm25_fielded, rrf_fusion, rocchio_terms, hybrid_search, hash_embed, cosine_topk, coedit_top_pairs, coedit_pairs, megacommit_filter, coedit_counts, coedit_edges, coedit_per_source, coedit_lookup, layer_rates, learned_weights, mrr, parse_unified_diff, diff_to_symbols)
}
ORACLES = {
    "doc_freq": f"WITH {_TOK}, x AS (SELECT id, unnest(list_distinct(a || b || c || d)) AS term FROM dd) SELECT term, count(*) AS df FROM x GROUP BY 1",
    "bm25_fielded": f"WITH {_BM25} SELECT query, id, round(score, 4) AS score FROM bm",
    "rrf_fusion": f"""WITH {_BM25}, t3 AS (SELECT qs.query, n.id, lower(n.name) AS s, lower(qs.text) AS t FROM n, qs), t4 AS (SELECT query, id, CASE WHEN length(s) < 3 THEN [s] ELSE list_distinct(list_transform(range(1, length(s) - 1), lambda i: substr(s, i, 3))) END AS a,
        CASE WHEN length(t) < 3 THEN [t] ELSE list_distinct(list_transform(range(1, length(t) - 1), lambda i: substr(t, i, 3))) END AS b FROM t3),
        t5 AS (SELECT query, id, round(len(list_intersect(a, b)) / CAST(len(list_distinct(a || b)) AS DOUBLE), 9) AS score FROM t4), r1 AS (SELECT query, id, 1.0 / (60 + row_number() OVER (PARTITION BY query ORDER BY round(score, 9) DESC, id)) AS s FROM bm),
        r2 AS (SELECT query, id, 0.7 / (60 + row_number() OVER (PARTITION BY query ORDER BY score DESC, id)) AS s FROM t5 WHERE score > 0), f AS (SELECT query, id, round(sum(s), 9) AS score FROM (SELECT * FROM r1 UNION ALL SELECT * FROM r2) GROUP BY 1, 2)
        SELECT query, id, round(score, 6) AS score, rank FROM (SELECT *, row_number() OVER (PARTITION BY query ORDER BY score DESC, id) AS rank FROM f) WHERE rank <= 20""",
    "rocchio_terms": f"""WITH {_BM25}, b3 AS (SELECT query, id, rk FROM (SELECT query, id, row_number() OVER (PARTITION BY query ORDER BY round(score, 9) DESC, id) AS rk FROM bm) WHERE rk <= 3),
        tx AS (SELECT b3.query, rk, qt.terms, unnest({words_sql("concat_ws(' ', n.name, n.signature, n.docstring)")}) AS term FROM b3 JOIN n ON n.id = b3.id JOIN qt ON qt.query = b3.query),
        tw AS (SELECT query, term, sum(1.0 / sqrt(rk)) AS weight FROM tx WHERE strlen(term) >= 3 AND NOT list_contains(terms, term) AND term NOT IN ({_STOP}) GROUP BY 1, 2)
        SELECT query, term, round(weight, 6) AS weight FROM (SELECT *, row_number() OVER (PARTITION BY query ORDER BY round(weight, 9) DESC, term) AS rn FROM tw) WHERE rn <= 4""",
    "cosine_topk": """WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: CAST(x AS DOUBLE)) AS e FROM embeddings), s AS (SELECT q.vec_id AS query, v.vec_id AS id, round(list_cosine_similarity(q.e, v.e), 9) AS score FROM v q, v WHERE q.vec_id % 20 = 0 AND q.vec_id <> v.vec_id)
        SELECT query, id, round(score, 5) AS score, rank FROM (SELECT *, row_number() OVER (PARTITION BY query ORDER BY score DESC, id) AS rank FROM s) WHERE rank <= 10""",
    "coedit_top_pairs": f"""WITH {_coedits("SELECT 1 AS grp, o_orderkey AS h, l_suppkey AS item, epoch(o_orderdate) AS ts, l_partkey AS p FROM lineitem JOIN orders ON o_orderkey = l_orderkey")}
        SELECT src, dst, raw_count, round(support, 4) AS support, round(jaccard, 4) AS jaccard FROM pp WHERE src < dst ORDER BY round(support, 4) DESC, raw_count DESC, src, dst LIMIT 20""",
    "coedit_pairs": f"WITH {_RUNS} SELECT grp, src, dst, raw_count, round(support, 4) AS support, round(confidence, 4) AS confidence, round(jaccard, 4) AS jaccard FROM pp",
    "megacommit_filter": f"""WITH c AS (SELECT run_id, lower(commit_hash) AS h, count(DISTINCT symbol_id) AS n, count(DISTINCT {_P}) AS f FROM commit_symbols WHERE run_id IS NOT NULL AND commit_hash IS NOT NULL GROUP BY 1, 2)
        SELECT run_id, count(*) AS commits, count(*) FILTER (f > 25 OR n > 40) AS megacommits, count(*) FILTER (NOT (f > 25 OR n > 40) AND n >= 2) AS valid, count(*) FILTER (NOT (f > 25 OR n > 40) AND n < 2) AS small FROM c GROUP BY 1""",
    "coedit_counts": f"WITH {_RUNS} SELECT grp, item, count(*) AS commits, round(sum(w), 4) AS weight FROM v GROUP BY 1, 2",
    "coedit_edges": f"WITH {_RUNS} SELECT grp, src, dst, 'CoChangesWith' AS relation, round(confidence, 4) AS weight FROM pp WHERE confidence >= 0.3",
    "coedit_per_source": f"""WITH {_RUNS} SELECT grp, src, dst, rank, round(confidence, 4) AS confidence FROM (SELECT grp, src, dst, round(confidence, 9) AS confidence,
        row_number() OVER (PARTITION BY grp, src ORDER BY round(confidence, 9) DESC, raw_count DESC, dst) AS rank FROM pp) WHERE rank <= 5""",
    "coedit_lookup": f"""WITH {EDGES}, {_RUNS}, ca AS (SELECT DISTINCT src, dst FROM e WHERE relation = 'Calls'), se AS (SELECT DISTINCT grp, item AS src FROM ci WHERE item IS NOT NULL)
        SELECT se.grp, ca.src, ca.dst, round(coalesce(pp.confidence, 0.0), 4) AS confidence, round(coalesce(pp.jaccard, 0.0), 4) AS jaccard FROM se JOIN ca USING (src) LEFT JOIN pp ON pp.grp = se.grp AND pp.src = ca.src AND pp.dst = ca.dst""",
    "layer_rates": f"WITH {NODES}, {_REPOS}, {_RATES} SELECT repo_id, layer, edge_count, cochanged, round(mass, 4) AS mass, round(rate, 6) AS rate FROM rt",
    "learned_weights": f"""WITH {NODES}, {_REPOS}, {_RATES}, va AS (SELECT grp, count(*) AS valid FROM sz WHERE n BETWEEN 2 AND 40 AND f <= 25 GROUP BY 1),
        x AS (SELECT rt.repo_id AS grp, layer, rate, valid, CASE layer WHEN 'AST Parent' THEN 0.8 WHEN 'Call' THEN 1.0 WHEN 'Type Ref' THEN 0.6 ELSE 0.3 END::DOUBLE AS d, max(rate) OVER (PARTITION BY rt.repo_id) AS top, least(greatest(exp(-valid / 50.0), 0.10), 0.85) AS lam FROM rt JOIN va ON va.grp = rt.repo_id),
        y AS (SELECT *, greatest((1 - lam) * CASE WHEN top > 0 THEN rate / top ELSE d END + lam * d, 0.15) AS raw FROM x), cf AS (SELECT grp, avg(confidence) AS mc FROM pp GROUP BY 1)
        SELECT grp, layer, round(floor(raw / greatest(max(raw) OVER (PARTITION BY grp), 0.01) * 100 + 0.5) / 100, 2) AS weight FROM y
        UNION ALL SELECT va.grp, 'Git Co-Edit', round(coalesce(floor(least(greatest(0.35 + 0.45 * mc, 0.2), 0.9) * 100 + 0.5) / 100, 0.5), 2) FROM va LEFT JOIN cf USING (grp)""",
    "mrr": f"""WITH {NODES}, {TRANSITION}, {_REPOS}, rk AS (SELECT n.repo_id AS grp, t.src, t.dst, row_number() OVER (PARTITION BY t.src ORDER BY round(t.weight, 9) DESC, t.dst) AS rank FROM t JOIN n ON n.id = t.src),
        hit AS (SELECT rk.grp, rk.src, min(rank) AS first FROM rk JOIN pp ON pp.grp = rk.grp AND pp.src = rk.src AND pp.dst = rk.dst GROUP BY 1, 2), so AS (SELECT DISTINCT grp, src FROM pp)
        SELECT so.grp, count(*) AS sources, round(avg(coalesce(1.0 / first, 0.0)), 6) AS mrr FROM so LEFT JOIN hit ON hit.grp = so.grp AND hit.src = so.src GROUP BY 1""",
    "parse_unified_diff": f"WITH {NODES}, {_FIRST} SELECT repo_id AS key, p AS path, r + unnest([0, 1]) AS row FROM fs",
    "diff_to_symbols": f"""WITH {NODES}, {_FIRST}, rw AS (SELECT repo_id, p, r + unnest([0, 1]) AS row FROM fs), s AS (SELECT id, repo_id, {_P} AS p, span.start_row AS a, span.end_row AS b FROM n WHERE span IS NOT NULL),
        h AS (SELECT s.repo_id AS key, s.p, s.id, sum(CASE WHEN row BETWEEN a AND b THEN 1 ELSE 0 END) AS hits FROM s JOIN rw ON rw.repo_id = s.repo_id AND rw.p = s.p GROUP BY 1, 2, 3), g AS (SELECT *, max(hits) OVER (PARTITION BY key, p) AS most FROM h)
        SELECT key, id, CAST(greatest(hits, 1) AS BIGINT) AS hits FROM g WHERE hits > 0 OR most = 0""",
    "hash_embed": """SELECT doc_id, 128 AS dims, CASE WHEN regexp_matches(coalesce(text, ''), '[^\\s\\x0b\\x{85}\\p{Z}]') THEN 1.0 ELSE 0.0 END AS norm FROM documents""",
}
