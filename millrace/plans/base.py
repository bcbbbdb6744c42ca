"""Tables of the queries and the SQL that all oracles share."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.operators import graph


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Symbols, each once."""
    return table(spark, sf_dir, "symbols").drop("ast_hash").dropDuplicates(["id"])


def edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Typed edges, each once."""
    return graph.clean_edges(table(spark, sf_dir, "typed_edges"))


def collapsed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(src, dst, weight) of all relations with their default weights, containment in both directions."""
    e = graph.with_reverse_containment(edges(spark, sf_dir))
    w = graph.relation_weights()
    m = F.create_map(*[F.lit(x) for kv in w.items() for x in kv])[F.col("relation")]
    return graph.merge_parallel(e.withColumn("weight", F.col("weight") * m))


NODES = "n AS (SELECT DISTINCT id, repo_id, file_id, name, kind, file_path, signature, docstring, token_cost, container_name, trait_name, span FROM symbols)"
EDGES = "e AS (SELECT src, dst, relation, coalesce(max(weight), 1.0) AS weight FROM typed_edges WHERE src <> dst AND relation IS NOT NULL GROUP BY 1, 2, 3)"
BOTH = EDGES + ", b AS (SELECT * FROM e UNION ALL SELECT dst, src, 'BelongsTo', weight FROM e WHERE relation = 'Contains')"


def case_weights(weights: dict[str, float], column: str = "relation") -> str:
    return "CASE " + column + " " + " ".join(f"WHEN '{k}' THEN {w}" for k, w in weights.items()) + " END"


COLLAPSED = BOTH + f", c AS (SELECT src, dst, sum(weight * {case_weights(graph.relation_weights())}) AS weight FROM b GROUP BY 1, 2)"
TRANSITION = COLLAPSED + ", t AS (SELECT src, dst, weight / sum(weight) OVER (PARTITION BY src) AS weight FROM c WHERE weight > 0)"


def words_sql(x: str) -> str:
    """Identifier tokens of a DuckDB text expression."""
    x = f"regexp_replace({x}, '[^\\p{{L}}\\p{{N}}]+', ' ', 'g')"
    for p in ("(\\p{Lu}{2,})(\\p{Lu}\\p{Ll})", "(\\p{Ll})(\\p{Lu})", "([0-9])([^0-9 ])", "([^0-9 ])([0-9])"):
        x = f"regexp_replace({x}, '{p}', '\\1 \\2', 'g')"
    return f"list_filter(string_split(lower(trim({x})), ' '), lambda w: w <> '')"


def tokens_sql(x: str) -> str:
    """Token estimate of a DuckDB text expression."""
    ops = "::|->|=>|==|!=|<=|>="
    plain = f"regexp_replace({x}, '{ops}', ' ', 'g')"

    def n(text: str, pattern: str) -> str:
        return f"len(regexp_extract_all({text}, '{pattern}'))"

    parts = [n(x, ops), *(n(plain, p) for p in ("[!-/:-@\\[-`{-~]", "[\\p{L}\\p{N}]+", "\\p{Ll}\\p{Lu}", "\\p{L}[0-9]", "[0-9]\\p{L}", "\\p{Lu}\\p{Lu}\\p{Ll}", "[^\\p{L}\\p{N}\\s\\x0b\\x{85}\\p{Z}!-/:-@\\[-`{-~]"))]
    return f"CAST(CASE WHEN NOT regexp_matches({x}, '[^\\s\\x0b\\x{{85}}\\p{{Z}}]') THEN 0 ELSE greatest({' + '.join(parts)}, ceil(octet_length(encode({x})) / 4.0)) END AS BIGINT)"
