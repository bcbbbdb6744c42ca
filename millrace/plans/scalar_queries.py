"""Queries of the scalar functions over whole tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.functions import registry
from millrace.functions import text as T

from .base import NODES, nodes, table, tokens_sql, words_sql


def tokenize_ident(spark: SparkSession, d: str) -> DataFrame:
    return nodes(spark, d).select("id", F.array_join(T.tokenize_ident(F.col("signature")), " ").alias("tokens"))


def char_ngrams(spark: SparkSession, d: str) -> DataFrame:
    return nodes(spark, d).select("name").distinct().select("name", F.array_join(T.char_ngrams(F.col("name")), "|").alias("grams"))


def ngram_jaccard(spark: SparkSession, d: str) -> DataFrame:
    """Similarity of each method's name and its container's."""
    n = nodes(spark, d).where("container_name is not null")
    return n.select("id", F.round(T.set_jaccard(T.char_ngrams(F.col("name")), T.char_ngrams(F.col("container_name"))), 6).alias("similarity"))


def trigram_similarity(spark: SparkSession, d: str) -> DataFrame:
    n = nodes(spark, d).where("container_name is not null")
    return n.select("id", F.round(T.set_jaccard(T.trigrams(F.col("name")), T.trigrams(F.col("container_name"))), 6).alias("similarity"))


def token_estimate(spark: SparkSession, d: str) -> DataFrame:
    t = T.token_estimate(F.coalesce("text", F.lit("")))
    return table(spark, d, "documents").select("doc_id", t.alias("tokens")).withColumn("calibrated", T.token_calibrated(F.col("tokens")))


def sql_functions(spark: SparkSession, d: str) -> DataFrame:
    """The token estimate and the language of each loaded file, by the registered SQL functions."""
    registry.register(spark)
    table(spark, d, "file_sources").createOrReplaceTempView("millrace_files")
    return spark.sql("SELECT DISTINCT file_id, token_estimate(coalesce(content, '')) AS tokens, language_of(file_path) AS language FROM millrace_files")


def cost_breakdown(spark: SparkSession, d: str) -> DataFrame:
    """Token cost of a symbol at each level of detail: signature, with documentation, sliced and full body."""
    n = nodes(spark, d)
    signature = T.token_estimate(F.col("signature"))
    doc = T.token_estimate(F.coalesce("docstring", F.lit("")))
    metadata = T.token_estimate(F.concat_ws(" ", "name", "kind", "file_path"))
    body = F.ceil((F.col("span.end_byte") - F.col("span.start_byte")) / 4).cast("bigint")
    x = n.select("id", signature.alias("signature_tokens"), doc.alias("doc_tokens"), metadata.alias("metadata_tokens"), F.coalesce(body, signature).alias("full_tokens"))
    return x.select("*", (F.col("signature_tokens") + F.col("doc_tokens")).alias("documented_tokens"), (F.floor(F.col("full_tokens") / 2) + 2).cast("bigint").alias("sliced_tokens"), (F.col("full_tokens") + F.col("metadata_tokens") + 7).alias("total_tokens"))


def lang_from_path(spark: SparkSession, d: str) -> DataFrame:
    f = table(spark, d, "file_sources").select("file_id", T.language_of(F.col("file_path")).alias("language")).distinct()
    return f.groupBy("language").agg(F.count("*").alias("files"))


def node_type_infer(spark: SparkSession, d: str) -> DataFrame:
    return nodes(spark, d).select("id", T.node_type(F.col("name"), F.col("file_path"), F.col("kind")).alias("node_type"))


def is_test_predicate(spark: SparkSession, d: str) -> DataFrame:
    return nodes(spark, d).select("id", T.is_test(F.col("name"), F.col("file_path"), F.col("signature"), F.col("docstring")).alias("is_test"))


def subsystem_of_path(spark: SparkSession, d: str) -> DataFrame:
    f = table(spark, d, "file_sources").select("file_path").distinct()
    return f.select("file_path", T.subsystem(F.col("file_path")).alias("subsystem"), T.subsystem_folder(F.col("file_path")).alias("folder"))


def task_kind(spark: SparkSession, d: str) -> DataFrame:
    """Task kinds of issues and other requests, read over the whole texts."""
    t = table(spark, d, "documents").where("text is not null")
    return t.groupBy("doc_type", T.task_kind(F.col("text")).alias("task")).agg(F.count("*").alias("docs"))


def model_profile(spark: SparkSession, d: str) -> DataFrame:
    """Profile that each team's checkouts would get, the team's name taken for the model's."""
    r = table(spark, d, "repositories").select("repo_id", F.coalesce("owner_team", F.lit("")).alias("team"), F.element_at(F.array(*[F.lit(x) for x in ("claude-sonnet", "GPT-4o", "deepseek-v3", "local-llama", "other")]), (F.col("repo_id") % 5 + 1).cast("int")).alias("model"))
    p = T.model_profile(F.col("model"))
    return r.select("repo_id", "model", *(p[c].alias(c) for c in ("context_window", "min_tokens", "max_tokens", "sensitivity")))


def path_distance(spark: SparkSession, d: str) -> DataFrame:
    """Distances over all call edges."""
    from .base import edges

    n = nodes(spark, d).select("id", "file_path")
    e = edges(spark, d).where("relation = 'Calls'").select("src", "dst")
    j = e.join(n.withColumnsRenamed({"id": "src", "file_path": "a"}), "src").join(n.withColumnsRenamed({"id": "dst", "file_path": "b"}), "dst")
    dist = T.path_distance(F.col("a"), F.col("b"))
    return j.select(dist.cast("bigint").alias("distance"), T.scope_score(dist).alias("score")).groupBy("distance", "score").agg(F.count("*").alias("edges"))


def public_api_catalog(spark: SparkSession, d: str) -> DataFrame:
    """First 30 public symbols by subsystem, kind and name."""
    n = nodes(spark, d)
    public = F.col("signature").startswith("pub ") | F.col("signature").startswith("export ") | F.col("kind").isin("Trait", "Struct", "Enum")
    n = n.where(public & ((F.col("kind") != "Method") | F.col("signature").contains("pub fn")))
    order = F.create_map(*[F.lit(x) for i, k in enumerate(("Function", "Method", "Struct", "Enum", "Trait", "TypeAlias", "Module")) for x in (k, i)])[F.col("kind")]
    return n.select("id", T.subsystem(F.col("file_path")).alias("subsystem"), "kind", "name", "token_cost").orderBy("subsystem", order, "name", "id").limit(30)


def recency_decay(spark: SparkSession, d: str) -> DataFrame:
    c = table(spark, d, "commit_symbols").where("run_id is not null").select("run_id", F.lower("commit_hash").alias("h"), "commit_ts")
    c = c.groupBy("run_id", "h").agg(F.max("commit_ts").alias("ts"))
    last = c.groupBy("run_id").agg(F.max("ts").alias("last_ts"))
    return c.join(last, "run_id").groupBy("run_id").agg(F.count("*").alias("commits"), F.round(F.sum(T.recency_weight(F.col("last_ts") - F.col("ts"))), 4).alias("weight"))


def valid_revision(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "commit_symbols").select(F.col("commit_hash").alias("revision")).union(table(spark, d, "commit_symbols").select("file_path")).distinct().select("revision", T.valid_revision(F.col("revision")).alias("valid")).groupBy("valid").agg(F.count("*").alias("revisions"))


def _grams(x: str, sizes: tuple[int, ...] = (3, 4, 5)) -> str:
    parts = [f"list_transform(range(1, greatest(length({x}) - {n - 2}, 1)), lambda i: substr({x}, i, {n}))" for n in sizes]
    return f"CASE WHEN length({x}) < {min(sizes)} THEN [{x}] ELSE list_sort(list_distinct({' || '.join(parts)})) END"


def _jaccard(a: str, b: str) -> str:
    return f"round(CASE WHEN len(list_distinct({a} || {b})) = 0 THEN 1.0 ELSE len(list_intersect({a}, {b})) / CAST(len(list_distinct({a} || {b})) AS DOUBLE) END, 6)"


_SUB = """CASE WHEN len(p) = 0 THEN 'root' WHEN len(p) >= 2 AND lower(p[1]) IN ('crates','packages','apps','services','modules') THEN p[1] || '-' || p[2]
 WHEN len(p) >= 2 AND lower(p[1]) IN ('src','app','lib','pkg') THEN p[2] WHEN len(p) >= 2 THEN p[1] ELSE 'core' END"""
_FOLDER = """CASE WHEN len(p) >= 2 AND lower(p[1]) IN ('crates','packages','apps','services','modules','src','app','lib','pkg') THEN p[1] || '/' || p[2] WHEN len(p) >= 2 THEN p[1] ELSE '.' END"""
_PARTS = "list_filter(string_split(regexp_replace(replace(file_path, '\\', '/'), '^(\\./)+', ''), '/'), lambda x: x <> '')"
_TASK = "CASE " + " ".join(f"WHEN list_has_any(w, [{', '.join(repr(k) for k in v)}]) THEN '{t}'" for t, v in T.TASK_KEYWORDS.items()) + " ELSE 'general' END"
_TYPE = "CASE kind WHEN 'Enum' THEN 'Type' WHEN 'TypeAlias' THEN 'Type' WHEN 'Trait' THEN 'Interface' ELSE kind END"

QUERIES = {
    f.__name__: f
    for f in (tokenize_ident, char_ngrams, ngram_jaccard, trigram_similarity, token_estimate, sql_functions, cost_breakdown, lang_from_path, node_type_infer, is_test_predicate, subsystem_of_path, task_kind, model_profile, path_distance, public_api_catalog, recency_decay, valid_revision)
}
ORACLES = {
    "tokenize_ident": f"WITH {NODES} SELECT id, array_to_string({words_sql('signature')}, ' ') AS tokens FROM n",
    "char_ngrams": f"WITH x AS (SELECT DISTINCT name, '<' || lower(trim(name)) || '>' AS t FROM symbols) SELECT name, array_to_string({_grams('t')}, '|') AS grams FROM x",
    "ngram_jaccard": f"""WITH {NODES}, x AS (SELECT id, '<' || lower(trim(name)) || '>' AS s, '<' || lower(trim(container_name)) || '>' AS t FROM n WHERE container_name IS NOT NULL),
        y AS (SELECT id, {_grams('s')} AS a, {_grams('t')} AS b FROM x) SELECT id, {_jaccard('a', 'b')} AS similarity FROM y""",
    "trigram_similarity": f"""WITH {NODES}, x AS (SELECT id, lower(name) AS s, lower(container_name) AS t FROM n WHERE container_name IS NOT NULL),
        y AS (SELECT id, {_grams('s', (3,))} AS a, {_grams('t', (3,))} AS b FROM x) SELECT id, {_jaccard('a', 'b')} AS similarity FROM y""",
    "token_estimate": f"""WITH x AS (SELECT doc_id, {tokens_sql("coalesce(text, '')")} AS tokens FROM documents)
        SELECT doc_id, tokens, CAST(greatest(floor(0.96 * tokens + 0.5), 1) AS BIGINT) AS calibrated FROM x""",
    "sql_functions": f"""SELECT DISTINCT file_id, {tokens_sql("coalesce(content, '')")} AS tokens, CASE lower(regexp_extract(file_path, '\\.([^./\\\\]+)$', 1)) """
    + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in T.LANGUAGES.items())
    + " END AS language FROM file_sources",
    "cost_breakdown": f"""WITH {NODES}, x AS (SELECT id, {tokens_sql('signature')} AS signature_tokens, {tokens_sql("coalesce(docstring, '')")} AS doc_tokens,
        {tokens_sql("(name || ' ' || kind || ' ' || file_path)")} AS metadata_tokens, CAST(ceil((span.end_byte - span.start_byte) / 4.0) AS BIGINT) AS body FROM n),
        y AS (SELECT id, signature_tokens, doc_tokens, metadata_tokens, coalesce(body, signature_tokens) AS full_tokens FROM x)
        SELECT *, signature_tokens + doc_tokens AS documented_tokens, CAST(floor(full_tokens / 2.0) + 2 AS BIGINT) AS sliced_tokens, full_tokens + metadata_tokens + 7 AS total_tokens FROM y""",
    "lang_from_path": "WITH x AS (SELECT DISTINCT file_id, CASE lower(regexp_extract(file_path, '\\.([^./\\\\]+)$', 1)) "
    + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in T.LANGUAGES.items())
    + " END AS language FROM file_sources) SELECT language, count(*) AS files FROM x GROUP BY 1",
    "node_type_infer": f"""WITH {NODES}, x AS (SELECT id, kind, regexp_matches(replace(file_path, '\\', '/'), '(^|/)(tests|test|[^/]*_test\\.rs|[^/]*_test\\.go)(/|$)') OR regexp_matches(name, '^(test_|Test|prop_)|(_test|Test)$') AS t FROM n)
        SELECT id, CASE WHEN t AND kind IN ('Function', 'Method') THEN 'Test' ELSE {_TYPE} END AS node_type FROM x""",
    "is_test_predicate": f"""WITH {NODES} SELECT id, (regexp_matches(lower(replace(file_path, '\\', '/')), '(^|/)tests/|test_|_test\\.(rs|go)$|\\.(test|spec)\\.(ts|tsx|js)$')
        OR regexp_matches(lower(name), '^test_|_test$') OR starts_with(name, 'Test') OR regexp_matches(concat_ws(' ', signature, docstring), '#\\[(tokio::)?test\\]')) AS is_test FROM n""",
    "subsystem_of_path": f"WITH x AS (SELECT DISTINCT file_path, {_PARTS} AS p FROM file_sources) SELECT file_path, {_SUB} AS subsystem, {_FOLDER} AS folder FROM x",
    "task_kind": f"""WITH x AS (SELECT doc_type, string_split(regexp_replace(lower(text), '[^\\p{{L}}\\p{{N}}]+', ' ', 'g'), ' ') AS w FROM documents WHERE text IS NOT NULL)
        SELECT doc_type, {_TASK} AS task, count(*) AS docs FROM x GROUP BY 1, 2""",
    "model_profile": """WITH x AS (SELECT repo_id, ['claude-sonnet', 'GPT-4o', 'deepseek-v3', 'local-llama', 'other'][CAST(repo_id % 5 + 1 AS INT)] AS model FROM repositories)
        SELECT repo_id, model, CASE repo_id % 5 WHEN 0 THEN 200000 WHEN 1 THEN 128000 WHEN 2 THEN 64000 WHEN 3 THEN 16000 ELSE 64000 END AS context_window,
        CASE repo_id % 5 WHEN 0 THEN 800 WHEN 1 THEN 600 WHEN 2 THEN 500 WHEN 3 THEN 400 ELSE 600 END AS min_tokens, CASE repo_id % 5 WHEN 0 THEN 6000 WHEN 1 THEN 5000 WHEN 2 THEN 4000 WHEN 3 THEN 2000 ELSE 4000 END AS max_tokens,
        CAST(CASE repo_id % 5 WHEN 2 THEN 1.1 WHEN 3 THEN 1.2 ELSE 1.0 END AS DOUBLE) AS sensitivity FROM x""",
    "path_distance": f"""WITH {NODES}, e AS (SELECT DISTINCT src, dst FROM typed_edges WHERE relation = 'Calls' AND src <> dst),
        j AS (SELECT a.file_path AS a, b.file_path AS b, string_split(a.file_path, '/') AS x, string_split(b.file_path, '/') AS y FROM e JOIN n a ON a.id = e.src JOIN n b ON b.id = e.dst),
        k AS (SELECT a, b, x, y, coalesce(list_position(list_transform(range(1, least(len(x), len(y)) + 1), lambda i: x[i] = y[i]), false) - 1, least(len(x), len(y))) AS same FROM j),
        z AS (SELECT CASE WHEN a = b THEN 0 WHEN regexp_replace(a, '/?[^/]*$', '') = regexp_replace(b, '/?[^/]*$', '') THEN 1 ELSE len(x) + len(y) - 2 * same END AS distance FROM k)
        SELECT CAST(distance AS BIGINT) AS distance, CAST(CASE distance WHEN 0 THEN 1.0 WHEN 1 THEN 0.85 WHEN 2 THEN 0.6 ELSE 0.3 END AS DOUBLE) AS score, count(*) AS edges FROM z GROUP BY 1, 2""",
    "public_api_catalog": f"""WITH {NODES}, x AS (SELECT id, kind, name, token_cost, {_PARTS} AS p FROM n WHERE (starts_with(signature, 'pub ') OR starts_with(signature, 'export ') OR kind IN ('Trait', 'Struct', 'Enum'))
        AND (kind <> 'Method' OR contains(signature, 'pub fn'))), y AS (SELECT id, {_SUB} AS subsystem, kind, name, token_cost FROM x)
        SELECT * FROM y ORDER BY subsystem, list_position(['Function', 'Method', 'Struct', 'Enum', 'Trait', 'TypeAlias', 'Module'], kind), name, id LIMIT 30""",
    "recency_decay": """WITH c AS (SELECT run_id, lower(commit_hash) AS h, max(commit_ts) AS ts FROM commit_symbols WHERE run_id IS NOT NULL GROUP BY 1, 2), l AS (SELECT run_id, max(ts) AS last_ts FROM c GROUP BY 1)
        SELECT run_id, count(*) AS commits, round(sum(least(greatest(power(2.0, -greatest(last_ts - ts, 0) / 7776000.0), 0.001), 1.0)), 4) AS weight FROM c JOIN l USING (run_id) GROUP BY 1""",
    "valid_revision": """WITH x AS (SELECT commit_hash AS r FROM commit_symbols UNION SELECT file_path FROM commit_symbols)
        SELECT regexp_matches(trim(r), '^[A-Za-z0-9._/~^@{}][A-Za-z0-9._/~^@{}-]*$') AS valid, count(*) AS revisions FROM x GROUP BY 1""",
}
