"""Queries of parsing, rendering and streaming."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from millrace.operators import analytics as A
from millrace.operators import graph as G
from millrace.operators import history as H
from millrace.operators import resolve as Rs
from millrace.operators import selection as S
from millrace.sources import files as Fs
from millrace.sources import parse as P
from millrace.sources import slicing as Sl
from millrace.streaming import watch as W

from .base import BOTH, EDGES, NODES, case_weights, edges, nodes, table
from .graph_queries import _ROOTS, _SEEDS, _paths
from .retrieval_queries import _BM25, _FIRST, _P
from .selection_queries import BUDGET, candidates


def _files(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "file_sources").where("content is not null").select("file_id", "repo_id", "file_path", "content")


def parse_symbols(spark: SparkSession, d: str) -> DataFrame:
    return P.parse_symbols(_files(spark, d)).select("file_id", "name", "kind", "start_row", "end_row", "container_name").distinct()


def parse_imports(spark: SparkSession, d: str) -> DataFrame:
    return P.parse_imports(_files(spark, d)).drop("file_path").distinct()


def module_paths(spark: SparkSession, d: str) -> DataFrame:
    return Rs.resolve_modules(table(spark, d, "imports"), table(spark, d, "file_sources"))


def symbol_agreement(spark: SparkSession, d: str) -> DataFrame:
    """How many of the given symbols the parser finds, by kind."""
    mine = P.parse_symbols(_files(spark, d)).select("file_id", "name").distinct().withColumn("found", F.lit(1))
    return nodes(spark, d).join(mine, ["file_id", "name"], "left").groupBy("kind").agg(F.count("*").alias("symbols"), F.count("found").alias("found"))


def render_markdown(spark: SparkSession, d: str) -> DataFrame:
    sel = S.select(candidates(spark, d), BUDGET).select("query", "step", "id")
    return Fs.markdown(sel.join(nodes(spark, d).select("id", "file_path", "signature", "docstring"), "id"))


def render_mermaid(spark: SparkSession, d: str) -> DataFrame:
    """Containment of each repository as a chart."""
    n = nodes(spark, d)
    e = edges(spark, d).where("relation = 'Contains'")
    j = e.join(n.select(F.col("id").alias("src"), F.col("repo_id").alias("query"), F.col("name").alias("src_name")), "src").join(n.select(F.col("id").alias("dst"), F.col("name").alias("dst_name")), "dst")
    return Fs.mermaid(j)


def stream_sessions(spark: SparkSession, d: str) -> DataFrame:
    """Event bursts of the event stream, those that the watermark has closed; one batch of all files, so no stored row is late."""
    path = f"{d}/events.parquet"
    s = W.watch(spark, path, spark.read.parquet(path).schema, per_trigger=2**31 - 1)
    x = W.drain(W.debounced(s, "user_id", "event_type", "ts", "1 hour", "1 hour"))
    return x.select("user_id", "event_type", F.unix_micros("start").alias("start_us"), F.unix_micros("end").alias("end_us"), "n")


def stream_upsert(spark: SparkSession, d: str) -> DataFrame:
    """Loads of files as a stream of changes: a repeated load is no event."""
    path = f"{d}/file_sources.parquet"
    s = W.watch(spark, path, spark.read.parquet(path).schema)
    c = s.select(F.col("file_id").cast("string").alias("path"), F.unix_micros(F.col("loaded_at").cast("timestamp")).alias("seq"), F.sha2("content", 256).alias("hash"))
    return W.drain(W.upserts(c)).groupBy("event").agg(F.count("*").alias("events"), F.countDistinct("path").alias("files"))


def slice_bodies(spark: SparkSession, d: str) -> DataFrame:
    """How many lines of each symbol's source its slice keeps."""
    f = table(spark, d, "file_sources").where("content is not null").select("file_id", "content").dropDuplicates(["file_id"])
    n = nodes(spark, d).where("span is not null").select("id", "file_id", "file_path", F.col("span.start_byte").alias("a"), F.col("span.end_byte").alias("b"))
    j = n.join(f, "file_id").withColumn("bytes", F.encode("content", "UTF-8"))
    src = F.decode(F.substring(F.col("bytes"), F.col("a").cast("int") + 1, (F.col("b") - F.col("a")).cast("int")), "UTF-8")
    return Sl.slice_symbols(j.select("id", "file_path", src.alias("source"))).select("id", "lines", "kept")


def impact_from_diff(spark: SparkSession, d: str) -> DataFrame:
    """What depends on the symbols that each repository's diff changes, all of them together."""
    from .retrieval_queries import _diffs

    s = nodes(spark, d).where("span is not null").select("id", F.col("repo_id").alias("key"), "file_path", "span.start_row", "span.end_row")
    hit = H.changed_symbols(H.parse_diff(_diffs(spark, d)), s)
    return A.impact(edges(spark, d), hit.select(F.col("key").alias("root"), "id")).select("root", "id", F.col("depth").cast("bigint").alias("depth"))


def trace_paths(spark: SparkSession, d: str) -> DataFrame:
    """The best paths from each repository's seed to its most used symbol, with their probabilities."""
    from .graph_queries import roots, seeds

    r = roots(spark, d).select(F.col("id").alias("target"))
    p = A.paths(G.with_reverse_containment(edges(spark, d)), seeds(spark, d), max_depth=3, total=1_000_000).join(r, "target", "left_semi")
    rel = nodes(spark, d).select("id", (F.col("token_cost") / 100.0).alias("relevance"))
    b = A.boltzmann(p, rel, G.relation_weights())
    text = F.array_join(F.zip_with(F.slice("path", 2, 99), "relations", lambda x, y: F.concat(F.lit("--["), y, F.lit("]--> "), x.cast("string"))), " ")
    return b.select("source", "target", F.concat(F.col("source").cast("string"), F.lit(" "), text).alias("trace"), F.round("probability", 6).alias("probability"))


def blueprint_anchors(spark: SparkSession, d: str) -> DataFrame:
    """At most twenty anchors of each stated task: the twelve best retrieved symbols, then symbols with its words in their name."""
    from millrace.functions import text as T
    from millrace.operators import retrieval as R

    from .retrieval_queries import SEARCHES

    q = R.query_table(spark, SEARCHES)
    n = nodes(spark, d)
    best = R.top_k(R.bm25(R.documents(n), q).withColumn("score", F.round("score", 9)), 12).select("query", "id", F.col("score"), F.lit(0).alias("tier"))
    stated = F.array(*[F.struct(F.lit(k).alias("query"), F.lit(t).alias("t")) for k, t in SEARCHES])
    x = n.select("id", T.tokenize_ident(F.col("name")).alias("w"), F.explode(stated).alias("s"))
    hits = F.size(F.array_intersect("w", T.query_terms(F.col("s.t"))))
    words = x.select(F.col("s.query").alias("query"), "id", hits.cast("double").alias("score"), F.lit(1).alias("tier")).where("score > 0").join(best, ["query", "id"], "left_anti")
    w = Window.partitionBy("query").orderBy("tier", F.desc("score"), "id")
    every = best.unionByName(words).withColumn("rank", F.row_number().over(w)).where("rank <= 20")
    return every.select("query", "id", F.col("rank").cast("bigint").alias("rank"), F.col("tier").cast("bigint").alias("tier"))


QUERIES = {f.__name__: f for f in (parse_symbols, parse_imports, module_paths, symbol_agreement, render_markdown, render_mermaid, slice_bodies, impact_from_diff, trace_paths, blueprint_anchors, stream_sessions, stream_upsert)}
_BFS = """back AS (SELECT DISTINCT dst AS at, src AS id FROM e), bfs AS (
 WITH RECURSIVE z(root, id, depth) AS (SELECT id, id, 0 FROM r UNION SELECT z.root, back.id, z.depth + 1 FROM z JOIN back ON back.at = z.id WHERE z.depth < 8) SELECT root, id, min(depth) AS depth FROM z GROUP BY 1, 2 HAVING min(depth) > 0)"""
_ALL_PATHS = _paths(3).replace("WHERE rm <= 50", "WHERE rm <= 1000000")

ORACLES = {
    "impact_from_diff": f"""WITH {NODES}, {EDGES}, {_FIRST}, rw AS (SELECT repo_id, p, r + unnest([0, 1]) AS row FROM fs), sy AS (SELECT id, repo_id, {_P} AS p, span.start_row AS a, span.end_row AS b FROM n WHERE span IS NOT NULL),
        h AS (SELECT sy.repo_id AS key, sy.p, sy.id, sum(CASE WHEN row BETWEEN a AND b THEN 1 ELSE 0 END) AS hits FROM sy JOIN rw ON rw.repo_id = sy.repo_id AND rw.p = sy.p GROUP BY 1, 2, 3), g AS (SELECT *, max(hits) OVER (PARTITION BY key, p) AS most FROM h),
        r AS (SELECT key, id FROM g WHERE hits > 0 OR most = 0), {_BFS.replace("SELECT id, id, 0 FROM r", "SELECT key, id, 0 FROM r")} SELECT root, id, CAST(depth AS BIGINT) AS depth FROM bfs""",
    "trace_paths": f"""WITH {NODES}, {BOTH}, {_SEEDS}, {_ROOTS.replace("o AS (", "o2 AS (").replace(" o.", " o2.").replace("JOIN o ON", "JOIN o2 ON").replace("(SELECT n.repo_id, o.id", "(SELECT n.repo_id, o2.id")}, {_ALL_PATHS},
        kx AS (SELECT *, row_number() OVER () AS pid FROM wc WHERE target IN (SELECT id FROM r)), nr AS (SELECT pid, sum(n.token_cost / 100.0) AS nodes FROM (SELECT pid, unnest(path) AS id FROM kx) y JOIN n ON n.id = y.id GROUP BY 1),
        er AS (SELECT pid, sum(w * {case_weights(G.relation_weights(), 'r')}) AS edge FROM (SELECT pid, unnest(relations) AS r, unnest(weights) AS w FROM kx) GROUP BY 1),
        en AS (SELECT source, target, path, relations, nodes + edge - 0.25 * len(relations) AS energy FROM kx JOIN nr USING (pid) JOIN er USING (pid)), ez AS (SELECT *, exp(energy - max(energy) OVER (PARTITION BY source)) AS z FROM en)
        SELECT source, target, CAST(source AS VARCHAR) || ' ' || array_to_string(list_transform(range(1, len(relations) + 1), lambda i: '--[' || relations[i] || ']--> ' || CAST(path[i + 1] AS VARCHAR)), ' ') AS trace, round(z / sum(z) OVER (PARTITION BY source), 6) AS probability FROM ez""",
    "blueprint_anchors": f"""WITH {_BM25}, b12 AS (SELECT query, id, score, 0 AS tier FROM (SELECT query, id, round(score, 9) AS score, row_number() OVER (PARTITION BY query ORDER BY round(score, 9) DESC, id) AS r FROM bm) WHERE r <= 12),
        wd AS (SELECT qt.query, dd.id, CAST(len(list_intersect(dd.a, qt.terms)) AS DOUBLE) AS score, 1 AS tier FROM dd, qt), wn AS (SELECT wd.* FROM wd LEFT JOIN b12 ON b12.query = wd.query AND b12.id = wd.id WHERE wd.score > 0 AND b12.id IS NULL),
        ev AS (SELECT *, row_number() OVER (PARTITION BY query ORDER BY tier, score DESC, id) AS rank FROM (SELECT * FROM b12 UNION ALL SELECT * FROM wn)) SELECT query, id, rank, CAST(tier AS BIGINT) AS tier FROM ev WHERE rank <= 20""",
    "stream_sessions": """WITH ev AS (SELECT user_id, event_type, epoch_us(ts) AS us FROM events), nw AS (SELECT *, CASE WHEN lag(us) OVER w IS NULL OR us - lag(us) OVER w >= 3600000000 THEN 1 ELSE 0 END AS new FROM ev WINDOW w AS (PARTITION BY user_id, event_type ORDER BY us)),
        ss AS (SELECT *, sum(new) OVER (PARTITION BY user_id, event_type ORDER BY us ROWS UNBOUNDED PRECEDING) AS s FROM nw), g AS (SELECT user_id, event_type, s, min(us) AS start_us, max(us) + 3600000000 AS end_us, count(*) AS n FROM ss GROUP BY 1, 2, 3)
        SELECT user_id, event_type, start_us, end_us, n FROM g WHERE end_us <= (SELECT (max(us) // 1000) * 1000 - 3600000000 FROM ev)""",
    "render_mermaid": f"""WITH {NODES}, {EDGES}, x AS (SELECT a.repo_id AS query, '  ' || a.name || ' -->|' || e.relation || '| ' || b.name AS l FROM e JOIN n a ON a.id = e.src JOIN n b ON b.id = e.dst WHERE e.relation = 'Contains')
        SELECT query, 'graph LR' || chr(10) || string_agg(l, chr(10) ORDER BY l) AS diagram FROM x GROUP BY 1""",
    "stream_upsert": """SELECT 'patched' AS event, count(DISTINCT file_id) AS events, count(DISTINCT file_id) AS files FROM file_sources WHERE content IS NOT NULL""",
}
