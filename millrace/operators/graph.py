"""Typed multi-layer graphs as DataFrames: nodes(id, ...) and edges(src, dst, relation, weight).

Aggregations combine map-side; joins are on node ids. Edges of every relation
share one table with `relation` as a column, so that a filter on it prunes.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# Default weight and class of each relation, and overrides by kind of task.
RELATIONS = {
    "Imports": (0.4, "import"), "Calls": (1.0, "behavioral"), "References": (0.6, "type"), "Inherits": (0.8, "structural"), "Implements": (0.9, "structural"), "Contains": (0.7, "structural"), "BelongsTo": (0.8, "structural"),
    "Returns": (0.5, "type"), "Accepts": (0.5, "type"), "Reads": (0.6, "behavioral"), "Writes": (0.7, "behavioral"), "Configures": (0.4, "configuration"), "IsTestedBy": (0.7, "evidence"), "CoChangesWith": (0.6, "evidence"),
}
TASK_WEIGHTS = {
    "bugfix": {"Calls": 1.2, "IsTestedBy": 1.6, "CoChangesWith": 1.2, "Writes": 1.0, "Reads": 0.8, "BelongsTo": 0.9},
    "test_creation": {"IsTestedBy": 2.5, "Calls": 1.3, "Contains": 1.0, "BelongsTo": 1.0, "CoChangesWith": 0.9},
    "refactor": {"Inherits": 1.6, "Implements": 1.6, "Contains": 1.3, "BelongsTo": 1.3, "References": 1.1, "Imports": 0.9},
    "feature": {"Calls": 1.1, "Implements": 1.3, "Inherits": 1.1, "Contains": 1.0, "Imports": 0.7},
    "exploration": {"Imports": 1.5, "Implements": 1.5, "Inherits": 1.3, "Contains": 1.2, "Calls": 1.1},
    "documentation": {"Contains": 1.6, "BelongsTo": 1.3, "References": 0.9, "Calls": 0.4, "CoChangesWith": 0.2},
    "general": {},
}


def relation_weights(task: str = "general") -> dict[str, float]:
    return {k: w for k, (w, _) in RELATIONS.items()} | TASK_WEIGHTS[task]


def relation_class(relation: Column) -> Column:
    return F.create_map(*[F.lit(x) for k, (_, c) in RELATIONS.items() for x in (k, c)])[relation]


def clean_edges(edges: DataFrame, default_weight: float = 1.0) -> DataFrame:
    """Each typed edge once, without self-loops and dangling ends; a missing weight becomes the default."""
    e = edges.where("src is not null and dst is not null and src <> dst and relation is not null")
    return e.groupBy("src", "dst", "relation").agg(F.coalesce(F.max("weight"), F.lit(default_weight)).alias("weight"))


def with_reverse_containment(edges: DataFrame) -> DataFrame:
    """Adds BelongsTo for every Contains."""
    back = edges.where("relation = 'Contains'").select(F.col("dst").alias("src"), F.col("src").alias("dst"), F.lit("BelongsTo").alias("relation"), "weight")
    return edges.select("src", "dst", "relation", "weight").unionByName(back)


def merge_parallel(edges: DataFrame) -> DataFrame:
    """One edge per pair of nodes with the summed weight."""
    return edges.where("src <> dst").groupBy("src", "dst").agg(F.sum("weight").alias("weight"))


def normalize_rows(edges: DataFrame) -> DataFrame:
    """Weights as transition probabilities of each source; sources of no weight fall out."""
    total = F.sum("weight").over(Window.partitionBy("src"))
    return edges.withColumn("total", total).where("total > 0").select("src", "dst", (F.col("weight") / F.col("total")).alias("weight"))


def mix_layers(edges: DataFrame, weights: dict[str, float]) -> DataFrame:
    """Layers summed with their weights, then made transition probabilities."""
    kept = {k: w for k, w in weights.items() if w > 0}
    w = F.create_map(*[F.lit(x) for kv in kept.items() for x in kv])[F.col("relation")]
    mixed = edges.withColumn("weight", F.col("weight") * w).where("weight is not null")
    return normalize_rows(merge_parallel(mixed))


def transpose(edges: DataFrame) -> DataFrame:
    return edges.withColumnsRenamed({"src": "__s"}).withColumnRenamed("dst", "src").withColumnRenamed("__s", "dst").select(*edges.columns)


def degrees(edges: DataFrame) -> DataFrame:
    """(id, out_degree, in_degree, degree) of every node with an edge."""
    ends = edges.select(F.explode(F.array(F.struct(F.col("src").alias("id"), F.lit(1).alias("o"), F.lit(0).alias("i")), F.struct(F.col("dst").alias("id"), F.lit(0).alias("o"), F.lit(1).alias("i")))).alias("x"))
    return ends.groupBy("x.id").agg(F.sum("x.o").alias("out_degree"), F.sum("x.i").alias("in_degree"), F.count("*").alias("degree"))


def induced(edges: DataFrame, selected: DataFrame) -> DataFrame:
    """Edges with both ends among the ids of `selected`."""
    ids = selected.select("id").distinct()
    return edges.join(ids.withColumnRenamed("id", "src"), "src", "left_semi").join(ids.withColumnRenamed("id", "dst"), "dst", "left_semi").select(*edges.columns)


def neighborhood(edges: DataFrame, seeds: DataFrame, relations: list[str] | None = None, hops: int = 1) -> DataFrame:
    """(seed, id, relation, direction, hop, weight) around each seed: both ways for one hop, outwards at half weight for the second."""
    e = edges.where(F.col("relation").isin(relations)) if relations else edges
    s = seeds.select(F.col("id").alias("seed")).distinct()
    out = e.join(s, e["src"] == s["seed"]).select("seed", F.col("dst").alias("id"), "relation", F.lit("out").alias("direction"), F.lit(1).alias("hop"), "weight")
    into = e.join(s, e["dst"] == s["seed"]).select("seed", F.col("src").alias("id"), "relation", F.lit("in").alias("direction"), F.lit(1).alias("hop"), "weight")
    one = out.unionByName(into)
    if hops == 1:
        return one
    first = one.select("seed", "id").distinct()
    e2 = e.select(F.col("src").alias("mid"), F.col("dst").alias("far"), F.col("relation").alias("r2"), F.col("weight").alias("w2"))
    two = first.join(e2, first["id"] == e2["mid"]).where("far <> seed").groupBy("seed", F.col("far").alias("id"), F.col("r2").alias("relation")).agg(F.max(F.col("w2") * 0.5).alias("weight"))
    two = two.join(first, ["seed", "id"], "left_anti").select("seed", "id", "relation", F.lit("out").alias("direction"), F.lit(2).alias("hop"), "weight")
    return one.unionByName(two)


def symmetrize(edges: DataFrame) -> DataFrame:
    """(a, b, weight), a < b: every directed edge between two nodes adds 1."""
    return edges.where("src <> dst").groupBy(F.least("src", "dst").alias("a"), F.greatest("src", "dst").alias("b")).agg(F.count("*").cast("double").alias("weight"))


def dense_index(rows: DataFrame, group: str, order: list[str], name: str = "dense_id") -> DataFrame:
    """Numbers 0.. over the whole table in the order of `group` then `order`, without sorting it in one task:
    rows are numbered within a group and groups are offset by the sizes of those before them."""
    within = F.row_number().over(Window.partitionBy(group).orderBy(*order)) - 1
    sizes = rows.groupBy(group).agg(F.count("*").alias("n"))
    offsets = sizes.select(group, (F.sum("n").over(Window.orderBy(group).rowsBetween(Window.unboundedPreceding, Window.currentRow)) - F.col("n")).alias("offset"))
    return rows.withColumn("__w", within).join(offsets, group).withColumn(name, (F.col("__w") + F.col("offset")).cast("bigint")).drop("__w", "offset")
